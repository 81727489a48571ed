"""Exact silhouettes of Euclidean distance, for several assignments in one pass over block pairs.

Equal points with equal labels are collapsed to one with a number of copies, and equal points of a
block are measured once.  Points lie in blocks
of bounded size, each within one cluster of the finest assignment; a block is one row.  The
distances of a pair of blocks are computed once and added up per cluster of every assignment, so no
pair of points is ever a row.  Neither is a pair of blocks ever written: a task reads its own blocks
and a stripe of the others from the written table, and only sums per block and stripe move.

A point needs its mean distance to its own cluster, and to the nearest other one.  The mean
distance to a cluster is at least the distance to its mean, and at most the root of the mean
squared distance, which mean and variance of the cluster give.  A cluster whose lower bound is
above the least upper bound cannot be the nearest; pairs of blocks that no point needs are skipped.

A point that lacks a coordinate has no distances: its silhouette is 0, and the sums over its cluster
leave it out, while it counts in the size of the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.binning import vector_length
from ebbtide.operators.kmeans import squared_distances
from ebbtide.sources.staging import stage

#: Most points of a block, blocks that are aimed at so that few points keep all cores busy, and
#: points of either side whose distances are in memory at a time.
BLOCK_ROWS, LEAST_BLOCKS, ROWS_AT_ONCE, OTHERS_AT_ONCE = 16_384, 8, 1_024, 128
#: Bytes of blocks that a task meets its own blocks with, blocks whose sums it holds, and partial
#: sums of a block that are added at a time.
STRIPE_BYTES, HELD_BLOCKS, PARTS = 256 << 20, 4, 16
_BLOCK = "block long, points int, rows int, x binary, place binary, copies binary, labels binary, needs array<int>, holds array<int>"


def _collapsed(df: DataFrame, labels: list[str], features: str) -> DataFrame:
    vector = isinstance(df.schema[features].dataType, VectorUDT)
    values = (vector_to_array(features) if vector else F.col(features)).alias("x")
    kept = df.select(values, F.array(*[F.col(c).cast("int") for c in labels]).alias("labels"))
    return kept.where(~F.exists("labels", lambda c: c.isNull())).groupBy("x", "labels").agg(F.count("*").alias("copies"))


def _gap() -> Column:
    """Whether a point lacks a coordinate."""
    return F.coalesce(F.exists("x", lambda v: v.isNull()), F.lit(True))


class _Clusters:
    """Sizes, mean and mean squared deviation of every cluster of every assignment, side by side.

    ``size`` counts all points, ``share`` is that of the points without a gap, which have the moments.
    """

    def __init__(self, rows: list, labels: int):
        self.first, self.names = [0], []
        for m in range(labels):
            own = sorted((r for r in rows if r.m == m), key=lambda r: r.label)
            self.names.append({r.label: k for k, r in enumerate(own, self.first[-1])})
            self.first.append(self.first[-1] + len(own))
        ordered = sorted(rows, key=lambda r: (r.m, r.label))
        self.size = np.array([r.n for r in ordered], float)
        self.share = np.array([r.whole for r in ordered]) / self.size
        self.mean = np.array([r.mean if r.whole else [0.0] * len(r.mean) for r in ordered])
        self.spread = np.maximum(np.array([r.square or 0.0 for r in ordered]) - (self.mean ** 2).sum(1), 0.0)

    def columns(self, labels: np.ndarray) -> np.ndarray:
        """Numbers of the clusters of every point, an assignment a column."""
        return np.column_stack([[self.names[m][c] for c in labels[:, m].tolist()] for m in range(labels.shape[1])])

    def needed(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which clusters each point has to be measured against."""
        lower = squared_distances(x, self.mean)
        upper = lower + self.spread
        with np.errstate(invalid="ignore"):
            # Sums over the points without a gap are divided by the size of the whole cluster.
            lower, upper = (np.where(self.share > 0, bound * self.share ** 2, np.inf) for bound in (lower, upper))
        out = np.zeros(lower.shape, bool)
        rows = np.arange(len(x))
        for m, (a, b) in enumerate(zip(self.first, self.first[1:])):
            other = upper[:, a:b].copy()
            other[rows, own[:, m] - a] = np.inf
            # Room for the rounding of the matrix product.
            out[:, a:b] = lower[:, a:b] <= other.min(axis=1, initial=np.inf)[:, None] * (1 + 1e-9) + 1e-9
            out[rows, own[:, m]] = True
        return out & (self.share > 0)


def _clusters(points: DataFrame, labels: int, width: int) -> _Clusters:
    each = points.select("copies", "x", F.posexplode("labels").alias("m", "label"))
    weight = F.when(~_gap(), F.col("copies"))
    means = [(F.sum(F.col("x")[i] * weight) / F.sum(weight)) for i in range(width)]
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    rows = each.groupBy("m", "label").agg(
        F.sum("copies").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("whole"), F.array(*means).alias("mean"),
        (F.sum(square * weight) / F.sum(weight)).alias("square"))
    return _Clusters(rows.collect(), labels)  # a row per cluster


def _read(points: int, rows: int, raw: bytes, place: bytes, copies: bytes, labels: bytes):
    """Distinct points of a block, the place of every row among them, its copies and its clusters."""
    return (np.frombuffer(raw).reshape(points, -1), np.frombuffer(place, np.int32), np.frombuffer(copies),
            np.frombuffer(labels, np.int64).reshape(rows, -1))


def _add_distances(sums: np.ndarray, x: np.ndarray, y: np.ndarray, copies: np.ndarray, clusters: np.ndarray) -> None:
    """Add the distances of every point of ``x`` to the rows of ``y``, up to the clusters of these."""
    # Rows of the same clusters side by side: their distances are added up before they go to the clusters.
    kinds, kind = np.unique(clusters, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    y, copies, kind = y[order], copies[order], kind.ravel()[order]
    hot = np.zeros((len(kinds), sums.shape[1]))
    hot[np.arange(len(kinds))[:, None], kinds] = 1.0
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left, right = np.column_stack([x, xx, np.ones(len(x))]), np.vstack([-2.0 * y.T, np.ones(len(y)), yy])
    for to in range(0, len(y), OTHERS_AT_ONCE):
        theirs = slice(to, to + OTHERS_AT_ONCE)
        first, last = kind[theirs][0], kind[theirs][-1] + 1
        into = np.zeros((len(y[theirs]), last - first))
        into[np.arange(len(into)), kind[theirs] - first] = copies[theirs]
        if last - first >= sums.shape[1]:
            into, first, last = into @ hot[first:last], 0, 0
        most = yy[theirs].max()
        for at in range(0, len(x), ROWS_AT_ONCE):
            mine = slice(at, at + ROWS_AT_ONCE)
            far = left[mine] @ right[:, theirs]
            # The matrix product loses digits where points are close: those are measured again.
            close = far <= 1e-6 * (xx[mine, None] + most)
            if close.any():
                i, j = np.nonzero(close)
                own = far[i, j] <= 1e-6 * (xx[mine][i] + yy[theirs][j])
                i, j = i[own], j[own]
                far[i, j] = ((x[mine][i] - y[theirs][j]) ** 2).sum(1)
            added = np.sqrt(far, out=far) @ into
            sums[mine] += added @ hot[first:last] if last else added


def silhouettes(df: DataFrame, labels: list[str], features: str = "features", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``assignment, silhouette, n``: mean silhouette of every label column.

    A point alone in its cluster has silhouette 0; so have all points of an assignment with one
    cluster.  Rows without a label in some column are left out; an empty frame gives no row.
    Points that lack a coordinate have silhouette 0.
    """
    spark, width = df.sparkSession, vector_length(df, features)
    every = stage(_collapsed(df, labels, features), "points")
    if every.isEmpty():
        return spark.createDataFrame([], "assignment string, silhouette double, n long")
    points = every.where(~_gap())
    n, known = points.count(), _clusters(every, len(labels), width)
    finest = int(np.argmax(np.diff(known.first)))
    aimed = min(block_rows, max(-(-n // LEAST_BLOCKS), 1))
    cell = F.col("labels")[finest]
    sizes = points.groupBy(cell.alias("cell")).agg(F.ceil(F.count("*") / aimed).alias("parts"))
    dealt = points.withColumn("cell", cell).join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("x"), "parts"))

    def pack(group: pa.Table) -> pa.Table:
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        own = group.column("labels").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        block = (group.column("cell")[0].as_py() << 32) + group.column("part")[0].as_py()
        own = known.columns(own).astype(np.int64)
        need = np.zeros(known.first[-1], bool)
        for at in range(0, len(x), ROWS_AT_ONCE):
            need |= known.needed(x[at:at + ROWS_AT_ONCE], own[at:at + ROWS_AT_ONCE]).any(axis=0)
        points, place = np.unique(x, axis=0, return_inverse=True)
        columns = (points, place.ravel().astype(np.int32), group.column("copies").to_numpy().astype(float), own)
        return pa.table({"block": pa.array([block], pa.int64()), "points": pa.array([len(points)], pa.int32()), "rows": pa.array([len(x)], pa.int32()),
                         **{c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in zip(("x", "place", "copies", "labels"), columns)},
                         **{c: pa.array([v.tolist()], pa.list_(pa.int32())) for c, v in (("needs", np.flatnonzero(need)), ("holds", np.unique(own)))}})

    blocks = stage(dealt.groupBy("cell", "part").applyInArrow(pack, _BLOCK), "blocks")
    count, size = blocks.agg(F.count("*"), F.sum(sum((F.octet_length(c) for c in ("place", "copies", "labels")), F.octet_length("x")))).first()
    stripes = max(-(-(size or 0) // STRIPE_BYTES), 1)
    # The blocks that hold a cluster which some point of a block needs.
    columns = ("points", "rows", "x", "place", "copies", "labels")
    theirs = blocks.select(*[F.col(c).alias(f"other_{c}") for c in columns], "holds").repartition(stripes)
    met = blocks.select("block", "points", "x", "needs").repartition(max(count, 1)).join(
        theirs.hint("shuffle_replicate_nl"), F.arrays_overlap("needs", "holds")).select(
        "block", "points", "x", *[f"other_{c}" for c in columns])

    def measure(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % PARTS, {}

        def emitted():
            for block, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
                                                 names=["block", "part", "sums"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                block, count, raw, *their_raw = (c[k].as_py() for c in batch.columns)
                y, place, copies, clusters = _read(*their_raw)
                if block not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield from emitted()
                    held[block] = np.zeros((count, known.first[-1]))
                _add_distances(held[block], np.frombuffer(raw).reshape(count, -1), y[place], copies, clusters)
        yield from emitted()

    schema = "block long, part int, sums binary"

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw) for raw in group.column("sums").to_pylist())
        return pa.table([group.column("block")[:1], group.column("part")[:1], pa.array([total.tobytes()], pa.binary())], names=["block", "part", "sums"])

    sums = met.mapInArrow(measure, schema)
    for key in (["block", "part"], ["block"]) if stripes > PARTS else (["block"],):
        sums = sums.groupBy(*key).applyInArrow(added, schema)

    def score(batches):
        totals = np.zeros((len(labels), 2))
        for batch in batches:
            for k in range(batch.num_rows):
                count, n, *raw, sums = (c[k].as_py() for c in batch.columns)
                x, place, copies, own = _read(count, n, *raw)
                far, rows = np.frombuffer(sums).reshape(count, -1)[place], np.arange(n)
                need = known.needed(x[place], own)
                for m, (a, b) in enumerate(zip(known.first, known.first[1:])):
                    mean = np.where(need[:, a:b], far[:, a:b] / known.size[a:b], np.inf)
                    mine = own[:, m] - a
                    size = known.size[own[:, m]]
                    inner = far[rows, own[:, m]] / np.maximum(size - 1, 1)
                    mean[rows, mine] = np.inf
                    outer = mean.min(axis=1, initial=np.inf)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        s = np.where((size > 1) & np.isfinite(outer), (outer - inner) / np.maximum(outer, inner), 0.0)
                    totals[m] += (np.nan_to_num(s) * copies).sum(), copies.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(labels)), pa.int32()), pa.array(totals[:, 0]), pa.array(totals[:, 1])], names=["m", "s", "n"])

    scored = blocks.join(sums.select("block", "sums"), "block").select(*columns, "sums").mapInArrow(score, "m int, s double, n double")
    without = every.where(_gap()).select(F.posexplode("labels").alias("m", "label"), "copies").select(
        "m", F.lit(0.0).alias("s"), F.col("copies").cast("double").alias("n"))
    scored = scored.unionByName(without)
    name = F.element_at(F.array(*[F.lit(c) for c in labels]), F.col("m") + 1)
    return scored.groupBy("m").agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.sum("n").cast("long").alias("n")).select(
        name.alias("assignment"), "silhouette", "n")
