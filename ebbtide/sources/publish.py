"""Versions that appear whole or not at all.

A version is written to a folder of its own and then committed: a small file in ``_commits`` names
what belongs to it.  The commit file is created only if its name is free, so of two writers one
wins and the other takes the next number.  Readers resolve committed versions only; a writer that
dies before its commit leaves a folder that nobody reads, and nothing is ever overwritten.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"


class Commit(NamedTuple):
    number: int
    content: dict


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text; False if the name is taken."""
    target, files = _hadoop(spark, path)
    try:
        out = files.create(target, False)
    except Py4JJavaError as taken:
        if files.exists(target):
            return False
        raise taken
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """Valid commits in ascending order; one that was cut off while it was written counts as none."""
    folder, files = _hadoop(spark, f"{root}/{COMMITS}")
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if not name.removesuffix(".json").isdigit():
            continue
        with_text = files.open(status.getPath())
        try:
            text = bytes(with_text.readAllBytes()).decode()
        finally:
            with_text.close()
        try:
            found.append(Commit(int(name.removesuffix(".json")), json.loads(text)))
        except json.JSONDecodeError:
            continue
    return sorted(found)


def new_folder(root: str, part: str) -> str:
    """A folder for one attempt at writing a part of a version."""
    return f"{root}/{part}/attempt-{uuid.uuid4().hex}"


def _taken(spark: SparkSession, root: str) -> int:
    folder, files = _hadoop(spark, f"{root}/{COMMITS}")
    if not files.exists(folder):
        return -1
    names = [s.getPath().getName().removesuffix(".json") for s in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def commit(spark: SparkSession, root: str, content: dict, number: int | None = None) -> Commit | None:
    """Publish a version.  With a ``number`` None says that it is committed already."""
    text = json.dumps(content, ensure_ascii=False)
    if number is not None:
        if any(c.number == number for c in commits(spark, root)):
            return None
        path = f"{root}/{COMMITS}/{number:012d}.json"
        if not _create(spark, path, text):
            target, files = _hadoop(spark, path)  # a commit that was cut off: nobody reads it
            files.delete(target, False)
            if not _create(spark, path, text):
                return None
        return Commit(number, content)
    while True:
        number = _taken(spark, root) + 1
        if _create(spark, f"{root}/{COMMITS}/{number:012d}.json", text):
            return Commit(number, content)


def latest(spark: SparkSession, root: str, number: int | None = None) -> Commit | None:
    """The last committed version, or the given one."""
    found = [c for c in commits(spark, root) if number is None or c.number == number]
    return found[-1] if found else None


def read_committed(spark: SparkSession, root: str, part: str) -> DataFrame | None:
    """All committed folders of a part as one table; None before the first commit."""
    folders = [c.content[part] for c in commits(spark, root) if part in c.content]
    return spark.read.parquet(*folders) if folders else None
