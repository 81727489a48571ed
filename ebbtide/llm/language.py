"""Language of a text by cross-parsing with suffix automata.

For each language a suffix automaton of labelled text knows all substrings of that text.  A
document is parsed greedily into the longest phrases the automaton knows.  Text of the same
language needs few phrases.  The number of phrases, normalised by the length of the document
and by the logarithm of the length of the language's text, estimates the cross entropy in bits
a letter; the language with the least wins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import id_type, map_rows, narrow, texts_of, worker_store
from ebbtide.sources.staging import stage

#: Bound of the labelled sample per language: letters (and gaps) of text, and rows, from each of
#: which a passage at a place given by its hash is taken.
SAMPLE_SYMBOLS, SAMPLE_ROWS = 20_000, 200
#: Letters of a language with a symbol of their own; any other letter is written as three digits.
OWN_LETTERS, DIGIT_BITS = 64, 7
ALPHABET = 1 + OWN_LETTERS + (1 << DIGIT_BITS)
GAP, SPELT = 0, 255
#: Bytes of parsing tables that travel to the tasks at a time.
TABLE_BYTES = 96 << 20
UNDETERMINED = "und"
#: A document is parsed in blocks of this many symbols, many blocks side by side.
BLOCK, LANES = 256, 4096
#: How fast the score falls with the distance to the best language, in bits a letter.
SHARPNESS = 4.0


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter; built once per worker."""
    return worker_store("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def clean(text: str) -> np.ndarray:
    """Code points of the letters; what lies between is one space."""
    points = code_points(text)
    letter = letter_table()[points]
    return np.where(letter, points, 32)[letter | np.r_[True, letter[:-1]]] if len(points) else points


def own_letters(points: np.ndarray) -> np.ndarray:
    """The most frequent letters of a language's text."""
    found, counts = np.unique(points[points != 32], return_counts=True)
    return np.sort(found[np.lexsort((found, -counts))][:OWN_LETTERS])


def spell(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of clean text in a language's alphabet, and how many each code point has.

    No two letters share a spelling, whatever their scripts.
    """
    table = np.full(sys.maxunicode + 1, SPELT, np.uint8)
    table[32] = GAP
    table[own] = np.arange(1, 1 + len(own))
    symbols = table[points]
    spelt = symbols == SPELT
    width = np.where(spelt, 3, 1)
    if spelt.any():
        out = np.repeat(symbols, width)
        first = (np.cumsum(width) - width)[spelt]
        for k in range(3):
            out[first + k] = 1 + OWN_LETTERS + ((points[spelt] >> (DIGIT_BITS * (2 - k))) & ((1 << DIGIT_BITS) - 1))
        symbols = out
    return symbols, width


def automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Parsing table of the suffix automaton of a text.

    ``table[state + symbol]`` is twice the next state, plus one if a phrase ends before the symbol;
    states are numbered in steps of the row width.  The last column is padding: it stays.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    width, unknown = alphabet + 1, len(step)
    restart = np.full(alphabet, unknown * width, np.int64)  # an unknown symbol is a phrase by itself
    for c, t in step[0].items():
        restart[c] = t * width
    table = np.empty((unknown + 1, width), np.int32)
    table[:, :alphabet] = restart * 2 + 1
    table[0, :alphabet] = restart * 2
    table[:, alphabet] = np.arange(unknown + 1) * width * 2
    for k, moves in enumerate(step):
        for c, t in moves.items():
            table[k, c] = t * width * 2
    return table.ravel()


@dataclass
class Model:
    """Languages by name and the clean sample text of each."""

    languages: list[str]
    texts: list[np.ndarray]

    @property
    def sizes(self) -> list[int]:
        return [len(t) for t in self.texts]

    @property
    def tables(self) -> list[np.ndarray]:
        return [parsing_table(t) for t in self.texts]


def parsing_table(text: np.ndarray) -> np.ndarray:
    return automaton(spell(text, own_letters(text))[0].tolist(), ALPHABET)


def phrases(symbols: np.ndarray, starts: np.ndarray, table: np.ndarray, alphabet: int) -> np.ndarray:
    """Phrases of each document ``symbols[starts[k]:starts[k + 1]]``, block by block."""
    size = np.diff(starts)
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = starts[owner] + number * BLOCK
    count = np.minimum(size[owner] - number * BLOCK, BLOCK)
    out = np.zeros(len(size), np.int64)
    padded = np.concatenate([symbols, np.full(BLOCK, alphabet, symbols.dtype)])
    for a in range(0, len(begin), LANES):
        lane, n = begin[a:a + LANES], count[a:a + LANES]
        steps = np.arange(int(n.max()))
        grid = np.where(steps[:, None] < n, padded[lane + steps[:, None]], alphabet).astype(np.int32)
        state, ended = np.zeros(len(lane), np.int32), np.ones(len(lane), np.int64)  # the last phrase counts
        for row in grid:
            move = table[state + row]
            ended += move & 1
            state = move >> 1
        out += np.bincount(owner[a:a + LANES], ended, len(size)).astype(np.int64)
    return out


def entropies(texts: list[str], alphabets: list[np.ndarray], tables: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Bits a letter of each text (column) by each language (row)."""
    pieces = [clean(t) for t in texts]
    points = np.concatenate([*pieces, np.zeros(0, np.uint32)])
    starts = np.cumsum([0, *map(len, pieces)])
    size = np.maximum(np.diff(starts), 1)
    out = np.empty((len(tables), len(texts)))
    for k, (own, table, n) in enumerate(zip(alphabets, tables, sizes)):
        symbols, width = spell(points, own)
        ends = np.concatenate([[0], np.cumsum(width)])
        out[k] = phrases(symbols, ends[starts], table, ALPHABET) * np.log2(max(n, 2)) / size
    return out


def _unseen(batches):
    """Of the rows with one ``lang`` and ``h`` the first that the task sees."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        new = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def _sample(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """Clean text of each language from its picked passages, ``symbols`` code points at most."""
    for batch in batches:
        names, out = [], []
        for lang, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            joined = clean(" ".join([*texts, ""]))[:symbols]
            if (joined != 32).any():
                names.append(lang)
                out.append(joined.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["lang", "sample"])


def learn(docs: DataFrame, where: str, symbols: int = SAMPLE_SYMBOLS, rows: int = SAMPLE_ROWS) -> Model:
    """A bounded sample of the labelled rows that meet ``where`` (SQL), for every ``lang`` value.

    Per language ``rows`` distinct texts are picked by a hash of the text.  Each gives a passage, of
    twice its share of ``symbols``, at a place that the hash names; passages are joined until there
    are ``symbols`` letters and gaps.  The distinct texts are counted first, so that only about four
    times the texts wanted are gathered, whatever the size of a language or of a group of copies; a
    language with fewer distinct texts than wanted has all of them in its sample.  The driver gets the
    names and samples alone.  A language without a letter in its sample is not learned.
    """
    labelled = docs.where(where).where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    # Written first: its size is then known, so that the join sends the counts, not the texts.
    counts = stage(labelled.groupBy("lang").agg(F.greatest(F.approx_count_distinct("h"), F.lit(1)).alias("texts")), "languages")
    low = F.pmod(F.col("h"), F.lit(1 << 30))
    length = F.ceil(F.lit(2.0 * symbols) / F.least("texts", F.lit(rows))).cast("int")
    room = F.greatest(F.length("text") - length, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64("h"), room.cast("long")) + 1).cast("int")
    # About four times the texts wanted pass the hash threshold, before anything is shuffled.  The
    # least are picked, so the estimate (5 %) matters for the length of the passages only.
    near = (labelled.join(counts, "lang").where(low < F.least(F.lit(1.0), 4.0 * rows / F.col("texts")) * (1 << 30))
            .select("lang", "h", F.substr(F.col("text"), place, length).alias("text")))
    near = near.mapInArrow(_unseen, near.schema).dropDuplicates(["lang", "h"])
    chosen = F.slice(F.sort_array(F.collect_list(F.struct(low.alias("low"), "h", "text"))), 1, rows)
    picked = near.groupBy("lang").agg(chosen.alias("picked")).select("lang", F.col("picked.text").alias("texts"))
    samples = picked.mapInArrow(lambda batches: _sample(batches, symbols), "lang string, sample binary").collect()
    samples = sorted((r.lang, bytes(r.sample)) for r in samples)
    return Model([lang for lang, _ in samples], [np.frombuffer(raw, "<u4") for _, raw in samples])


def _blocks(model: Model, most: int) -> Iterator[tuple[list[str], list[np.ndarray], list[np.ndarray], list[int]]]:
    """Languages with their tables, as many as fit ``most`` bytes, one at least."""
    block, used = ([], [], [], []), 0
    for lang, text in zip(model.languages, model.texts):
        table = parsing_table(text)
        if block[0] and used + table.nbytes > most:
            yield block
            block, used = ([], [], [], []), 0
        for part, value in zip(block, (lang, own_letters(text), table, len(text))):
            part.append(value)
        used += table.nbytes
    if block[0]:
        yield block


def identify(docs: DataFrame, model: Model, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per row: ``doc_id, lang_pred, score``, from the whole text alone, of any length.

    ``und`` with score 0 for a text without a letter (or null), or if nothing was learned; of equal
    languages the first by name.  Repeated rows and null ids are kept; empty tables give empty ones.
    Languages are tried in blocks whose tables have a bounded size; a block is a pass over the texts
    in the same task, which hands on the least bits and the sum that the score needs.
    """
    kind = id_type(docs)
    rows = narrow(docs, "doc_id", "text").select(
        "doc_id", "text", F.lit(UNDETERMINED).alias("lang"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("total"))
    for block in _blocks(model, table_bytes):
        # Plain values: broadcasts are unpickled without the package.
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def work(batch, sent=sent):
            languages, alphabets, tables, sizes = sent.value
            found = entropies(texts_of(batch.column(1)), alphabets, tables, sizes)
            before, total = (np.array(batch.column(k).to_pylist(), float) for k in (3, 4))
            least = np.minimum(before, found.min(axis=0))
            # Sums are kept relative to the least bits so far.
            fell = np.where(np.isinf(before), 0.0, np.exp(-SHARPNESS * (np.where(np.isinf(before), least, before) - least)))
            total = total * fell + np.exp(-SHARPNESS * (found - least)).sum(axis=0)
            names = [languages[b] if new < old else name for b, new, old, name in zip(
                found.argmin(axis=0).tolist(), least.tolist(), before.tolist(), batch.column(2).to_pylist())]
            return [batch.column(0), batch.column(1), names, least.tolist(), total.tolist()]

        rows = map_rows(rows, f"doc_id {kind}, text string, lang string, bits double, total double", work)

    def finish(batch):
        letters = [bool((clean(t) != 32).any()) for t in texts_of(batch.column(1))]
        names = [name if ok else UNDETERMINED for name, ok in zip(batch.column(2).to_pylist(), letters)]
        scores = [1.0 / t if ok and t else 0.0 for t, ok in zip(batch.column(4).to_pylist(), letters)]
        return [batch.column(0), names, scores]

    return map_rows(rows, f"doc_id {kind}, lang_pred string, score double", finish)
