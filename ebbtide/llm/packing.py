"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths.

1. Every document is encoded, closed with an end id and cut into pieces of at most ``limit``
   tokens (the first one takes the remainder).  The pieces are written once; a piece knows its
   task and its rank among the task's pieces of the same length.
2. Pieces of one length are interchangeable, so the packing is decided on the counts per length
   alone: best fit in descending order of length, where a step places as many pieces of a length
   into as many equally full sequences as there are.  The result is that of best fit over the
   single pieces, in steps that depend on ``limit`` and not on the number of documents.
3. The plan is a table of slots: for a run of ranks within a length, the sequences and offsets
   they take.  Pieces get their global rank from the counts per task and length, and their place
   from an equality join on the length and a range condition on the rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.blobs import byte_slices
from ebbtide.llm.common import id_type, narrow
from ebbtide.llm.words import SLICE_BYTES, worker_ids
from ebbtide.sources.staging import stage

LIMIT, END_ID = 1024, 2
_PIECE = "piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"
_SLOT = "length long, low long, high long, per long, first_sequence long, first_offset long"


def plan_slots(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, ...]]:
    """Best-fit-decreasing packing of ``histogram`` (length to count): rows of ``_SLOT``.

    A row says: the pieces of ``length`` with ranks ``low <= r < high`` go ``per`` to a sequence,
    side by side from ``first_offset``, to the sequences from ``first_sequence`` on.  A length
    splits at most one group of equally filled sequences in two and opens at most two, so there
    are at most ``4 * limit`` groups and, as a sequence holds at most ``sqrt(2 * limit)``
    different lengths, a number of rows that ``limit`` alone bounds.
    """
    # room left -> groups of equally filled sequences: (how many, ((length, per, offset), ...))
    open_groups: list[list[tuple[int, tuple]]] = [[] for _ in range(limit + 1)]

    def put(many: int, room: int, filled: tuple, length: int, per: int) -> None:
        open_groups[room - per * length].append((many, (*filled, (length, per, limit - room))))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= limit:
            raise ValueError(f"length {length} is not between 1 and {limit}")
        for room in range(length, limit):  # the tightest sequences first
            fit = room // length
            while left and open_groups[room]:
                many, filled = open_groups[room].pop()
                full = min(many, left // fit)
                left -= full * fit
                if full:
                    put(full, room, filled, length, fit)
                if full < many:  # fewer than ``fit`` pieces are left for one more of these sequences
                    if left:
                        put(1, room, filled, length, left)
                    rest = many - full - (left > 0)
                    left = 0
                    if rest:
                        open_groups[room].append((rest, filled))
            if not left:
                break
        fit = limit // length
        if left >= fit:
            put(left // fit, limit, (), length, fit)
        if left % fit:
            put(1, limit, (), length, left % fit)
    slots, ranks, sequences = [], dict.fromkeys(histogram, 0), 0
    for groups in open_groups:
        for many, filled in groups:
            for length, per, offset in filled:
                low, ranks[length] = ranks[length], ranks[length] + many * per
                slots.append((length, low, ranks[length], per, sequences, offset))
            sequences += many
    return slots


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each piece among those of its length so far; ``seen`` is carried on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    begins = np.flatnonzero(np.diff(ordered, prepend=-1))
    counts = np.diff(np.append(begins, len(ordered)))
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = np.arange(len(ordered)) - np.repeat(begins, counts) + seen[ordered]
    seen[ordered[begins]] += counts
    return ranks


def _cut(ids: np.ndarray, offsets: np.ndarray, limit: int, end_id: int):
    """Ids with the end ids put in; per piece its document (number), number, start and length."""
    documents = len(offsets) - 1
    tokens = np.diff(offsets)
    closed = np.full(len(ids) + documents, end_id, "<u4")
    closed[np.arange(len(ids)) + np.repeat(np.arange(documents), tokens)] = ids
    n = tokens + 1
    pieces = -(-n // limit)
    document = np.repeat(np.arange(documents), pieces)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (n - limit * (pieces - 1))[document]
    start = np.where(piece == 0, 0, first + (piece - 1) * limit)
    return closed, document, piece, start, np.where(piece == 0, first, limit)


def cut_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document, with its ids and its rank within task and length.

    ``part`` and ``rank`` hold for one run of a task, so write the table before it is used twice.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"doc_id {id_type(docs)}, {_PIECE}"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        from pyspark import TaskContext

        table, seen, part = worker_ids(tokenizer), np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        for batch in byte_slices(batches, 1, SLICE_BYTES):
            closed, document, piece, start, length = _cut(*table.encode(batch.column(1)), limit, end_id)
            raw = memoryview(closed).cast("B")
            ends = 4 * np.cumsum(length)
            begins = ends - 4 * length
            checks = [zlib.crc32(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            ids = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(raw)])
            columns = [batch.column(0).take(pa.array(document)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                       pa.array(checks, pa.int64()), ids.cast(pa.binary()), pa.array(np.full(len(ends), part, np.int32)),
                       pa.array(_ranks(length, seen))]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return narrow(docs, "doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, ids`` (little-endian unsigned 32-bit).

    A null or empty text is one piece with the end id alone.  A null ``doc_id`` stays null;
    repeated rows are documents of their own; a document of any length is cut, an empty table
    gives an empty result, and other columns are not read.  Ties are free: pieces of one length
    change places without changing the number of sequences, which is that of best fit
    decreasing.  What reaches the driver is one count per length, at most ``limit`` rows.
    """
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, tokenizer, limit, end_id), "pieces")
    sizes = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "sizes")
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan_slots(histogram, limit), _SLOT)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("rank") - F.col("low")
    return (pieces.join(before, ["part", "length"])
            .join(F.broadcast(slots), "length").where("before + rank >= low AND before + rank < high")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("first_sequence") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
                    (F.col("first_offset") + F.pmod(place, F.col("per")) * F.col("length")).alias("offset"), "ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the packed sequences themselves, each at most ``limit`` tokens."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))
