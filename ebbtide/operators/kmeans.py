"""K-means of many numbers of clusters and starts in one scan per iteration.

All runs ``(k, start)`` read the rows together: a task measures its rows against the centres of
every run that still moves and adds up sums, counts and costs.  At most ``PARTS`` partial tables, each
as large as the centres, reach the driver; those of more tasks are added up in tasks before.  Runs
that have converged leave the scans.  The starts of all numbers of clusters come from one chain of seeds per start.

Seeding is greedy: a step draws several rows with a chance proportional to their squared distance
from the seeds so far and keeps the one that lowers the cost most.  The draw is a race of
exponential keys that depend on the row, so the seeds do not depend on how rows are dealt.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.assemble import FEATURES
from ebbtide.operators.binning import matrix, vector_length
from ebbtide.operators.boosting import mixed

_PART = "run int, part int, sums binary"
#: Rows that are measured against all centres at a time, and partial sums that the driver adds up.
ROWS_AT_ONCE, PARTS = 4_096, 64


class Run(NamedTuple):
    k: int
    start: int
    centres: np.ndarray
    cost: float        # sum of squared distances to the centres, as of the last scan
    iterations: int
    converged: bool


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)
    return np.maximum(out, 0.0)


def _chunks(batches, width: int):
    for batch in batches:
        x, key = matrix(batch.column(0), width), batch.column(1).to_numpy()
        for at in range(0, len(x), ROWS_AT_ONCE):
            yield x[at:at + ROWS_AT_ONCE], key[at:at + ROWS_AT_ONCE]


def _added(parts: DataFrame, shapes: dict[int, tuple[int, ...]], tasks: int) -> dict[int, np.ndarray]:
    """Sums of the arrays of all tasks, by run."""
    def together(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw) for raw in group.column("sums").to_pylist())
        return pa.table([group.column("run")[:1], group.column("part")[:1], pa.array([total.tobytes()], pa.binary())], names=["run", "part", "sums"])

    if tasks > PARTS:
        parts = parts.groupBy("run", "part").applyInArrow(together, _PART)
    out: dict[int, np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.run, r.part)):
        sums = np.frombuffer(bytes(r.sums)).reshape(shapes[r.run])
        out[r.run] = out[r.run] + sums if r.run in out else sums
    return out


def _emit(sums: dict[int, np.ndarray]):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % PARTS
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()),
         pa.array([np.ascontiguousarray(v, "f8").tobytes() for v in sums.values()], pa.binary())], names=["run", "part", "sums"])


def _moments(rows: DataFrame, width: int, tasks: int) -> tuple[int, np.ndarray]:
    """Number of rows and variance of every feature, around the mean of the first rows."""
    def task(batches):
        total = np.zeros((3, width))
        for x, _ in _chunks(batches, width):
            total += (np.full(width, len(x)), x.sum(0), (x * x).sum(0))
        yield _emit({0: total})

    n, s, q = _added(rows.mapInArrow(task, _PART), {0: (3, width)}, tasks)[0]
    return int(n[0]), np.maximum(q / n - (s / n) ** 2, 0.0)


def greedy_seeds(rows: DataFrame, width: int, k: int, starts: Iterable[int], trials: int, seed: int, tasks: int = PARTS + 1) -> dict[int, np.ndarray]:
    """``k`` seeds of every start, all starts in the same scans; fewer if there are fewer distinct rows."""
    starts = list(starts)
    seeds: dict[int, np.ndarray] = {s: np.zeros((0, width)) for s in starts}
    for step in range(k):
        now, draws = dict(seeds), trials if step else 1
        schema = "start int, trial int, key double, x binary"

        def draw(batches):
            best: dict[tuple[int, int], tuple[float, bytes]] = {}
            for x, key in _chunks(batches, width):
                for s, centres in now.items():
                    far = squared_distances(x, centres).min(axis=1) if step else np.ones(len(x))
                    # Rows equal to a seed are not drawn; the matrix product leaves them a rounding error.
                    far = np.where(far > 1e-9 * (1 + (x * x).sum(1)), far, 0.0)
                    for t in range(draws):
                        u = mixed(key, ((seed + s) * 1_009 + step) * 101 + t)
                        with np.errstate(divide="ignore"):
                            race = np.where(far > 0, -np.log1p(-u) / far, np.inf)
                        at = int(race.argmin()) if len(race) else -1
                        if at >= 0 and race[at] < best.get((s, t), (np.inf,))[0]:
                            best[s, t] = (float(race[at]), x[at].tobytes())
            columns = list(zip(*[(s, t, key, x) for (s, t), (key, x) in best.items()])) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.binary()))],
                                             names=["start", "trial", "key", "x"])

        drawn = rows.mapInArrow(draw, schema)
        if tasks > PARTS:
            drawn = drawn.groupBy("start", "trial").agg(F.min(F.struct("key", "x")).alias("m")).select("start", "trial", "m.*")
        first = {}
        for r in drawn.collect():
            first[r.start, r.trial] = min((r.key, bytes(r.x)), first.get((r.start, r.trial), (np.inf, b"")))
        candidates: dict[int, np.ndarray] = {}
        for (s, _), (_, x) in sorted(first.items()):
            candidates[s] = np.vstack([candidates.get(s, np.zeros((0, width))), np.frombuffer(x)])
        if not candidates:
            break
        if draws > 1:
            def cost(batches):
                total = {s: np.zeros(len(c)) for s, c in candidates.items()}
                for x, _ in _chunks(batches, width):
                    for s, c in candidates.items():
                        near = squared_distances(x, now[s]).min(axis=1)
                        total[s] += np.minimum(squared_distances(x, c), near[:, None]).sum(axis=0)
                yield _emit(total)

            costs = _added(rows.mapInArrow(cost, _PART), {s: (len(c),) for s, c in candidates.items()}, tasks)
            candidates = {s: c[[int(costs[s].argmin())]] for s, c in candidates.items()}
        seeds = {s: np.vstack([seeds[s], candidates[s]]) if s in candidates else seeds[s] for s in starts}
    return seeds


def fit_runs(df: DataFrame, ks: Iterable[int], starts: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42) -> list[Run]:
    """All runs to convergence: ``df`` has a vector column ``features`` and is read once per iteration.

    A run has converged when its centres together move by no more than ``tol`` times the mean
    variance of the features (squared).  A cluster that loses all rows keeps its centre.
    """
    ks, width = sorted(set(ks)), vector_length(df, FEATURES)
    values = vector_to_array(FEATURES)
    rows = df.select(values.alias("x"), F.xxhash64(values).alias("key"))
    if not width:
        return []
    tasks = rows.rdd.getNumPartitions()
    _, variance = _moments(rows, width, tasks)
    limit = tol * float(variance.mean())
    seeds = greedy_seeds(rows, width, ks[-1], range(starts), 2 + int(np.log(ks[-1])), seed, tasks)
    runs = [Run(k, s, seeds[s][:k], np.inf, 0, False) for k in ks for s in range(starts)]
    for iteration in range(max_iter + 1):
        moving = {i: r.centres for i, r in enumerate(runs) if not r.converged}
        if not moving:
            break
        ends = np.cumsum([len(c) for c in moving.values()])
        every = np.vstack(list(moving.values()))

        def scan(batches):
            total = {i: np.zeros((len(c), width + 2)) for i, c in moving.items()}
            for x, _ in _chunks(batches, width):
                far = squared_distances(x, every)
                own = np.column_stack([x, np.ones(len(x))])
                for (i, c), end in zip(moving.items(), ends):
                    part = far[:, end - len(c):end]
                    nearest = part.argmin(axis=1)
                    hot = np.zeros((len(c), len(x)))
                    hot[nearest, np.arange(len(x))] = 1.0
                    total[i][:, :-1] += hot @ own
                    total[i][:, -1] += np.bincount(nearest, weights=part[np.arange(len(x)), nearest], minlength=len(c))
            yield _emit(total)

        sums = _added(rows.mapInArrow(scan, _PART), {i: (len(c), width + 2) for i, c in moving.items()}, tasks)
        for i, s in sums.items():
            run, counts = runs[i], s[:, width]
            centres = np.where(counts[:, None] > 0, s[:, :width] / np.maximum(counts, 1)[:, None], run.centres)
            still = float(((centres - run.centres) ** 2).sum()) <= limit
            # The cost is that of the centres before the step: once they stand still it is theirs.
            done = still or iteration == max_iter
            runs[i] = Run(run.k, run.start, run.centres if done else centres, float(s[:, -1].sum()), iteration, done)
    return runs


def best_runs(runs: list[Run]) -> dict[int, Run]:
    """The run of the lowest cost per number of clusters, the first of equal ones."""
    out: dict[int, Run] = {}
    for run in runs:
        if run.k not in out or run.cost < out[run.k].cost:
            out[run.k] = run
    return out


class Centres(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Nearest-centre assignment; ``clusterCenters`` and ``trainingCost`` as MLlib names them."""

    state = Param(Params._dummy(), "state", "centres as JSON", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column", TypeConverters.toString)

    @classmethod
    def of(cls, run: Run, column: str = "cluster") -> Centres:
        model = cls()
        model._set(state=json.dumps({"centres": run.centres.tolist(), "cost": run.cost}), predictionCol=column)
        return model

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in json.loads(self.getOrDefault("state"))["centres"]]

    @property
    def trainingCost(self) -> float:
        return json.loads(self.getOrDefault("state"))["cost"]

    def _transform(self, df: DataFrame) -> DataFrame:
        centres = np.array(self.clusterCenters())

        @F.pandas_udf("int")
        def nearest(column):
            x = np.stack(column.to_numpy()) if len(column) else np.zeros((0, centres.shape[1]))
            return type(column)(squared_distances(np.nan_to_num(x), centres).argmin(axis=1).astype(np.int32))

        return df.withColumn(self.getOrDefault("predictionCol"), nearest(vector_to_array(FEATURES)))
