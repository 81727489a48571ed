"""Quality rules of whole texts, and verdicts on hosts shrunk by an empirical beta prior.

Each document is tested on its own words.  Failures are then counted per host (a map-side
sum, so a host with a third of all rows is one counter), the failure rate of a host is shrunk
towards the rate of all hosts by a beta prior fitted to the hosts, and the host's verdict is
joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import bytes_of, id_type, map_rows, narrow
from ebbtide.sources.staging import stage

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host whose shrunk failure rate is above this is rejected.
    max_host_rate: float = 0.5


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside a window of ``size`` words that occurs twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter([codes.setdefault(w, len(codes)) for w in words], np.int64, len(words))
    key = ids[:n]
    for k in range(1, size):  # named pair by pair, so the product stays below 2**63
        key = key * len(codes) + ids[k:k + n]
        if k < size - 1 and len(codes) > 2_000_000:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k:k + n] |= twice
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()  # bytes split at space and 0x09-0x0D only
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(b"".join(words).decode()), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words))


def document_counts(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """``doc_id, host``, the counts and ``base_failed`` of each row."""
    def work(batch):
        counts = [text_counts(t) for t in bytes_of(batch.column(1))]
        return [batch.column(0), batch.column(2), *([c[k] for c in counts] for k in range(5))]

    schema = (f"doc_id {id_type(docs)}, host string, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long")
    columns = narrow(docs, "doc_id", "text").columns
    picked = docs.select(*columns, F.col(f"`{host}`").cast("string").alias("host"))
    failed = ((F.col("n_words") < rules.min_words)
              | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    return map_rows(picked, schema, work).withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters by the moments of the hosts' failure rates.

    The spread that binomial sampling alone would give is taken off the spread of the rates.
    With no spread left the prior weighs as much as all documents together.
    """
    rate = F.col("fails") / F.col("n")
    row = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("fails").alias("fails"),
                    F.var_samp(rate).alias("spread"), F.avg(1 / F.col("n")).alias("inverse")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = (row["fails"] + 0.5) / (row["n"] + 1.0)
    noise = mean * (1 - mean) * row["inverse"]
    spread = row["spread"] if row["k"] > 1 else 0.0
    own = spread - noise
    weight = max((mean * (1 - mean) - spread) / own, 1.0) if own > 0 else float(row["n"])
    weight = min(weight, float(row["n"]))
    return mean * weight, (1 - mean) * weight


def host_rates(counts: DataFrame) -> DataFrame:
    """One row per host: ``host, n, fails, host_rate``; null is a host of its own."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    hosts = stage(hosts, "hosts")
    a, b = beta_prior(hosts)
    return hosts.withColumn("host_rate", (F.col("fails") + F.lit(a)) / (F.col("n") + F.lit(a + b)))


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def apply_rules(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """Per row: counts, ``base_failed``, ``host_rate``, ``host_failed`` and ``kept``.

    Null texts have no words, so they fail.  A null host is a host of its own.  Repeated rows
    are separate rows and count each.  Empty tables give empty tables; other columns are not
    read, whatever their names.  Texts of any length are counted whole.  The counts are written once to the shared folder and read for both the host sums and
    the join back; the host table has one row per host and its join follows the size Spark sees.
    """
    counts = stage(document_counts(docs, rules, host), "counts")
    rates = host_rates(counts).select(F.col("host").alias("_host"), "host_rate")
    joined = counts.join(rates, _same(counts["host"], rates["_host"]), "left").drop("_host")
    failed = F.col("host_rate") > rules.max_host_rate
    return joined.withColumns({"host_failed": failed, "kept": ~F.col("base_failed") & ~failed})


def keep_good(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that ``apply_rules`` keeps; the texts are not shuffled.

    The texts are counted once for the hosts' rates and again, with their rows, for the filter.
    Null and empty texts go; a null id or host is kept with a good text; repeated rows are judged
    alike and stay repeated; an empty table gives an empty one; columns named like the counts stay.
    """
    rates = host_rates(document_counts(docs, rules, host)).select(F.col("host").alias("_host"), "host_rate")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("text").alias("_text"), F.col(f"`{host}`").cast("string").alias("_own"))

    def work(batch):
        counts = [text_counts(t) for t in bytes_of(batch.column(1))]
        good = [c[0] >= rules.min_words and 100 * c[4] <= rules.max_repeat_percent * c[0] for c in counts]
        return [batch.column(0), batch.column(2), good]

    judged = map_rows(rows, f"_row {rows.schema['_row'].dataType.simpleString()}, _own string, _good boolean", work)
    joined = judged.where("_good").join(rates, _same(judged["_own"], rates["_host"]), "left")
    return joined.where(F.col("host_rate") <= rules.max_host_rate).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
