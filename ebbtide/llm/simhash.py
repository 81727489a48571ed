"""Near duplicates by 64-bit fingerprints within a few bits of each other.

The fingerprint is cut into two-bit segments; the ones of each segment form a vector.  The
Manhattan distance of two vectors is at most the number of differing bits, so close
fingerprints are close vectors.  The segments form three groups; if the whole distance is at
most four, it is at most one in some group.  So each vector is placed in its grid cell of each
group and probes the cells one step up, cells are joined, and the bits are compared exactly.
For very many fingerprints two groups and cells up to two steps away are used instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import bytes_of, id_type, map_rows, narrow, text_code, text_code_column
from ebbtide.llm.components import components
from ebbtide.sources.staging import stage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Rows of one cell that one task compares; a larger cell is split into blocks.
CELL_ROWS = 8192
#: Distinct fingerprints beyond which a grid with fewer, larger groups is cheaper.
FINE_GRID_FROM = 30_000_000
_PAIRS_AT_ONCE = 1 << 20
_LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, space and 0x09-0x0D
    if not words:
        return 0
    joined, n = b" ".join(words), max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[-n:].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(hashes[k:k + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""
    def work(batch):
        bits = np.array([fingerprint(t, shingle) for t in bytes_of(batch.column(1))], dtype=np.uint64)
        return [batch.column(0), pa.array(bits.view(np.int64))]

    return map_rows(narrow(docs, "doc_id", "text"), f"doc_id {id_type(docs)}, fp long", work)


def segment_counts(bits: np.ndarray) -> np.ndarray:
    """Ones of each two-bit segment, kept in the segment's own two bits."""
    return (bits & _LOW) + ((bits >> np.uint64(1)) & _LOW)


def group_masks(groups: int) -> list[np.uint64]:
    """Masks of the segments of each group, as even as 32 segments allow."""
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    return [np.uint64(((1 << 2 * (b - a)) - 1) << 2 * a) for a, b in zip(edges, edges[1:])]


def _probes(segments: list[int], radius: int) -> list[list[tuple[int, int]]]:
    """Steps ``(segment, change)`` to the cells within ``radius`` whose first change is upwards.

    Of two cells each other's neighbours, one reaches the other that way.
    """
    out = [[(s, 1)] for s in segments] if radius else []
    if radius >= 2:
        out += [[(s, 2)] for s in segments]
        out += [[(s, 1), (t, change)] for s in segments for t in segments if s < t for change in (1, -1)]
    return out


def _cells(batch: pa.RecordBatch, groups: int, radius: int) -> list[np.ndarray]:
    """Columns grp, cell, kind, fp: kind 0 in its own cell, kind 1 in the cells it probes."""
    fp = batch.column(0).to_numpy().view(np.uint64)
    counts, out = segment_counts(fp), []
    for g, mask in enumerate(group_masks(groups)):
        own = counts & mask
        out.append((g, own, 0, fp))
        for steps in _probes([s for s in range(32) if int(mask) >> 2 * s & 1], radius):
            there, cell = np.ones(len(own), bool), own
            for s, change in steps:
                level = ((own >> np.uint64(2 * s)) & np.uint64(3)).astype(np.int64) + change
                there &= (level >= 0) & (level <= 2)
                cell = cell + np.uint64(change << 2 * s) if change > 0 else cell - np.uint64(-change << 2 * s)
            out.append((g, cell[there], 1, fp[there]))
    size = [len(o[1]) for o in out]
    return [np.repeat([o[0] for o in out], size).astype(np.int32),
            np.concatenate([o[1] for o in out]).view(np.int64),
            np.repeat([o[2] for o in out], size).astype(np.int32),
            np.concatenate([o[3] for o in out]).view(np.int64)]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) that connect what the pairs connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), ends[:len(a)], ends[len(a):]
    while True:
        least = np.minimum(label[x], label[y])
        moved = label.copy()
        np.minimum.at(moved, label[x], least)
        np.minimum.at(moved, label[y], least)
        moved = moved[moved]
        while (moved[moved] != moved).any():
            moved = moved[moved]
        if (moved == label).all():
            break
        label = moved
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def close_pairs(run: np.ndarray, kind: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of rows at ``most`` bits or fewer inside each run of equal ``run`` values.

    Rows are sorted by (run, kind).  Each row is compared with the kind-0 rows before it in its
    run, a bounded number of pairs at a time.
    """
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    start = np.repeat(first, np.diff(np.r_[first, len(run)]))
    own = np.repeat(np.add.reduceat((kind == 0).astype(np.int64), first), np.diff(np.r_[first, len(run)]))
    partners = np.minimum(np.arange(len(run)) - start, own)
    upto = np.cumsum(partners)
    found_a, found_b, row = [], [], 0
    while row < len(run):
        base = upto[row - 1] if row else 0
        stop = max(int(np.searchsorted(upto, base + _PAIRS_AT_ONCE, "right")), row + 1)
        n = partners[row:stop]
        left = np.repeat(np.arange(row, stop), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[row:stop], n)
        x, y = bits[left], bits[right]
        hit = (np.bitwise_count(x ^ y) <= most) & (x != y)
        if hit.any():
            a, b = spanning(x[hit], y[hit])
            found_a.append(a)
            found_b.append(b)
        row = stop
    if not found_a:
        return bits[:0], bits[:0]
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def _link_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges of the cells of a sorted partition; whole cells are compared together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(columns):
        run, kind, bits = columns
        a, b = close_pairs(run, kind, bits.view(np.uint64), most)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    held = None
    for batch in batches:
        new = [batch.column(k).to_numpy() for k in range(3)]
        held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        if len(held[0]) >= 100_000 and held[0][0] != held[0][-1]:
            cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
            yield edges([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield edges(held)


def close_links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints at ``most`` bits or fewer.

    Per cell only the edges of a spanning star leave the task, so a group of near copies gives
    as many edges as members.  A cell of more than ``CELL_ROWS`` rows is cut into blocks and
    each pair of blocks is one unit of work.
    """
    # With most // 2 + 1 groups some group has a distance of one or less.  With fewer and larger
    # groups that is two or less: more probes each, but far fewer fingerprints share a cell.
    groups = most // 2 + 1 if fps.count() <= FINE_GRID_FROM else max(most // 3 + 1, 1)
    placed = stage(map_rows(fps.select("fp"), "grp int, cell long, kind int, fp long",
                            lambda batch: _cells(batch, groups, most // groups)), "cells")
    large = (placed.groupBy("grp", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
             .select("grp", "cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("blocks")))
    split = placed.join(large, ["grp", "cell"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    with_blocks = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    mine = F.coalesce(own, F.lit(0))
    keyed = with_blocks.select(
        F.xxhash64("grp", "cell", F.least(mine, F.col("other")), F.greatest(mine, F.col("other"))).alias("run"), "kind", "fp")
    sorted_runs = keyed.repartition(F.col("run")).sortWithinPartitions("run", "kind")
    return sorted_runs.mapInArrow(lambda batches: _link_runs(batches, most), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least ``doc_id`` reachable over links of ``most`` bits or fewer.
    Equal fingerprints are one node, so exact copies make no pairs.  A null or empty text has
    fingerprint zero and is linked like any other.  A null ``doc_id`` stays null and takes
    part with its text; a component of such rows only has a null id.  Repeated rows give
    repeated rows, empty tables an empty result; other columns are not read.
    """
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_links(nodes, most))
    rooted = stage(nodes.join(roots, nodes["fp"] == roots["node"], "left")
                   .select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the least ``doc_id``, all columns.

    Rows without a ``doc_id`` stay.  Of several rows with the kept ``doc_id`` all stay.  Where one
    ``doc_id`` has texts of several components, each text is kept or removed on its own.
    """
    named = stage(near_duplicates(docs, shingle, most), "named")
    stands = F.col("doc_id") == F.col("component_id")
    ids = named.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(stands).alias("some"), F.bool_and(stands).alias("all"))
    kept = docs.join(ids.where("NOT some").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    mixed = stage(ids.where("some AND NOT all").select("doc_id"), "mixed")
    if mixed.isEmpty():
        return kept

    def coded(batch):
        texts = bytes_of(batch.column(1))
        fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
        return [batch.column(0), [text_code(t) for t in texts], fps.tolist()]

    texts = map_rows(narrow(docs.join(mixed, "doc_id", "left_semi"), "doc_id", "text"), f"doc_id {id_type(docs)}, __code binary, fp long", coded)
    removed = texts.withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0")).join(
        named.where(~stands).select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_semi").select("doc_id", "__code")
    several = docs.join(mixed, "doc_id", "left_semi").withColumn("__code", text_code_column(F.col("text")))
    return kept.join(mixed, "doc_id", "left_anti").select(*docs.columns).unionByName(
        several.join(removed, ["doc_id", "__code"], "left_anti").select(*docs.columns))
