"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Every near pair is a shorter (or equally long) word ``x`` of ``n`` code points and a word ``y``
of ``n`` or ``n + 1``.  ``x`` contributes two disjoint chunks, its first and its second half; ``y``
contributes positional grams of those lengths, at the place of the chunk or one further.  One
edit lies in one chunk, so the other one is preserved: the first at its place, the second at its
place (replacement) or shifted by one (insertion).

Half a short word is shared by very many words.  A chunk therefore goes with the part of the
other chunk that the edit leaves as well: that one is cut in two, and one of its parts is intact.
This gives four keys a word, each with the chunk and about half of the rest, and no pair is lost.

Where several keys of a pair agree, the one of the leftmost difference counts, so a pair comes
up once and nothing has to be made distinct.  All steps after the word counts are DataFrame
operations; a key that very many words share is an inner sort-merge join partition, which the
adaptive planner splits.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.blobs import byte_slices
from ebbtide.llm.common import narrow, texts_of
from ebbtide.sources.staging import stage

LEAST_LENGTH, LEAST_COUNT, MUTE = 5, 3, 97
#: Runs of these code points are words; only A-Z is lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")
SLICE_BYTES = 4 << 20
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000


def document_words(doc_id: int | None, text: str, least: int, mute: int, counts: dict[str, int]) -> None:
    """Add the words of a text to ``counts``.

    A run whose crc32 with the document's id is a multiple of ``mute`` loses one code point.
    Without an id no run loses any.
    """
    runs = _RUN.findall(text.encode().lower().decode())  # bytes.lower changes A-Z only
    own: dict[str, int] = {}
    for run in runs:
        own[run] = own.get(run, 0) + 1
    start = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
    for run, n in own.items():
        if start is not None:
            h = zlib.crc32(run.encode(), start)
            if h % mute == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        if len(run) >= least:
            counts[run] = counts.get(run, 0) + n


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, mute: int = MUTE) -> DataFrame:
    """``word, n``: words with their occurrences in all documents, counted in the tasks first."""
    def run(batches):
        counts: dict[str, int] = {}

        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in byte_slices(batches, 1, SLICE_BYTES):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                document_words(doc_id, text, least_length, mute, counts)
                if len(counts) >= HELD_WORDS:
                    yield handed_on()
                    counts.clear()
        yield handed_on()

    counted = narrow(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, length: Column, n: Column) -> list[Column]:
    """Keys of a word as, or against, a word of ``n`` code points: what one edit in the first or
    second part of the first or second chunk leaves at both ends.

    ``length`` is the word's own; the end is taken from it, which is the shift by one.
    """
    half = F.floor(n / 2)
    first, second = F.floor(half / 2), half + F.floor((n - half) / 2)  # cuts inside the chunks

    def key(kind: int, front: Column, back: Column) -> Column:
        return F.xxhash64(F.lit(kind), n, F.substring(word, F.lit(1), front.cast("int")),
                          F.substring(word, (length - back + 1).cast("int"), back.cast("int")))

    none = F.lit(0)
    return [key(0, second, none),     # edit in the last quarter: first chunk and third quarter
            key(1, half, n - second),  # in the third: first chunk and last quarter
            key(2, first, n - half),   # in the second: first quarter and second chunk
            key(3, none, n - first)]   # in the first: second quarter and second chunk


def _agree(a: Column, b: Column, upto: Column) -> Column:
    return F.substring(a, F.lit(1), upto.cast("int")) == F.substring(b, F.lit(1), upto.cast("int"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``x, x_n, y, y_n``: every pair of words exactly one edit apart, once; ``x`` is not longer."""
    sized = words.select("word", "n", F.char_length("word").alias("size"))

    def keyed(size: Column, word: str, n: str) -> DataFrame:
        return sized.select(
            F.col("word").alias(word), F.col("n").alias(n), F.col("size").alias(f"{word}_size"),
            F.posexplode(F.array(*_keys(F.col("word"), F.col("size"), size))).alias("kind", "key"))

    chunks = keyed(F.col("size"), "x", "x_n")
    grams = keyed(F.col("size"), "y", "y_n").unionByName(keyed(F.col("size") - 1, "y", "y_n"))
    half = F.floor(F.col("x_size") / 2)
    first, second = F.floor(half / 2), half + F.floor((F.col("x_size") - half) / 2)
    x, y = F.col("x"), F.col("y")
    # The key of the quarter that holds the leftmost difference.
    own = (F.when(_agree(x, y, second), 0).when(_agree(x, y, half), 1).when(_agree(x, y, first), 2).otherwise(3))
    one_edit = F.levenshtein(x, y, 1) == 1
    return (chunks.join(grams, ["key", "kind"])
            .where((F.col("y_size") > F.col("x_size")) | (F.col("y_size") == F.col("x_size")) & (x < y))
            .where(F.col("y_size") <= F.col("x_size") + 1)
            .where(one_edit).where(own == F.col("kind"))
            .select("x", "x_n", "y", "y_n"))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word of each chain, by doubling.

    Forms must not run in a circle.  A round looks up the form of every form reached so far and
    is written; the number of rounds is the logarithm of the longest chain.
    """
    reached = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(reached.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        reached = step.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      mute: int = MUTE, factor: int = 2) -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``.

    The form is the near word with the most occurrences (ties: the least in code-point order) if
    it has at least ``factor`` times those of the word; the root is the end of the chain of
    forms, the word itself without a form.  A null text has no words; a null ``doc_id`` takes
    part with its text unchanged; repeated rows count each.  Very long words are words.  An
    empty table gives an empty result, other columns are not read.
    """
    words = stage(word_counts(docs, least_length, least_count, mute), "words")
    pairs = stage(near_pairs(words), "near")
    # One row a direction; the most frequent near word is the least by (-n, word).
    sides = pairs.select(F.col("x").alias("word"), F.struct((-F.col("y_n")).alias("rank"), F.col("y").alias("form")).alias("best")).unionByName(
        pairs.select(F.col("y").alias("word"), F.struct((-F.col("x_n")).alias("rank"), F.col("x").alias("form")).alias("best")))
    best = sides.groupBy("word").agg(F.min("best").alias("best"), F.count("*").alias("n_near"))
    named = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(-F.col("best.rank") >= factor * F.col("n"), value).alias(name)
          for name, value in (("form", F.col("best.form")), ("form_n", -F.col("best.rank")))]), "forms")
    roots = follow(named.where("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
