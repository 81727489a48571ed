"""Alignment of two tokenizers over the bytes of each text, by composing fragments.

A *fragment* is what a byte range of a text knows: the tokens up to its first common end of both
tokenizers (open prefix), the closed groups behind it, and the tokens after its last common end
(open suffix).  Two neighbours compose into the fragment of both ranges: the suffix of the left
and the prefix of the right close into one group.  Composition is associative and a text that
either tokenizer does not reproduce is its absorbing element, so the byte ranges of a very long
document are worked on in different tasks and reduced as a tree.

Tokens of a range are exact without the rest of the text: neither tokenizer joins across a
position where a non-space is followed by a space (``encoder``; no piece of the second
vocabulary has its space mark after another character, which is checked).  A range is therefore
encoded from the boundary before it to the boundary after it, and takes the tokens that end in it.

A link is a pair of ids whose ranges end together, so the bytes of one are a suffix of the
other's.  The vocabularies therefore bound the pairs (about the sum of all token lengths), and
with them every table of counts, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.blobs import byte_slices
from ebbtide.llm.common import bytes_of, id_type, map_rows, narrow, text_code, worker_store
from ebbtide.llm.encoder import Encoder
from ebbtide.llm.words import SLICE_BYTES, SpacedIds, WordTable, gather, words_of
from ebbtide.sources.staging import stage

#: Bytes of a range of a long text, and fragments that one step of the tree composes.
RANGE_BYTES, FAN_IN = 32 << 10, 16
#: Ranges whose words are looked up together.
RANGES_AT_ONCE = 128
#: A range may end inside a piece of at most this many bytes; a longer piece goes to one range.
SHARED_PIECE = 4 << 10
#: Bytes of word results that a worker keeps.
KEPT_BYTES = 80 << 20


def byte_level_bytes() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def _by_bytes(all_bytes: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, x in enumerate(all_bytes):
        if x:
            out.setdefault(x, []).append(i)
    return out


class Tokenizers:
    """Both tokenizers: ids of texts with a space before them, and the bytes of every id."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = Encoder(byte_level, kept=20_000)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_level_bytes()
        entries = sorted((i, t) for t, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items())
        self.a_bytes = [b""] * (entries[-1][0] + 1)
        for i, token in entries:
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece joins across a space: ranges would not be exact")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode()
                        for i, n in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.a_text = [b"%d" % i for i in range(len(self.a_bytes))]
        self.b_text = [b"%d" % i for i in range(len(self.b_bytes))]
        self.pairs = self._pairs()

    def _pairs(self) -> np.ndarray:
        """All ids that can be linked, ascending, as ``a * len(b) + b``."""
        a, b = _by_bytes(self.a_bytes), _by_bytes(self.b_bytes)
        codes = set()
        for x, ids in a.items():
            codes.update(i * len(self.b_bytes) + j for k in range(len(x)) for j in b.get(x[k:], ()) for i in ids)
        for y, ids in b.items():
            codes.update(i * len(self.b_bytes) + j for k in range(1, len(y)) for i in a.get(y[k:], ()) for j in ids)
        return np.array(sorted(codes), np.int64)

    def spaced(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for texts that stand after a space."""
        a = [np.frombuffer(raw, "<u4").tolist() for raw in self.a.direct([" " + t for t in texts])]
        return a, self.pieces(texts)

    def pieces(self, texts: list[str]) -> list[list[int]]:
        return [ids if t else [self.space] for t, ids in zip(texts, self.b.encode(texts, num_threads=1))]

    def same_bytes(self, a: list[int], b: list[int], content: bytes) -> bool:
        return (b"".join([self.a_bytes[i] for i in a]) == content
                and b"".join([self.b_bytes[i] for i in b]) == content)

    def common(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        """The positions behind the tokens that end together, and the numbers of their links."""
        at = np.searchsorted(b_ends, a_ends)
        met = np.append(b_ends, -1)[at] == a_ends
        behind_a, behind_b = np.flatnonzero(met) + 1, at[met] + 1
        links = np.searchsorted(self.pairs, a[behind_a - 1].astype(np.int64) * len(self.b_bytes) + b[behind_b - 1])
        return behind_a, behind_b, links.astype("<i4")

    def group_texts(self, a: np.ndarray, b: np.ndarray, behind_a: np.ndarray, behind_b: np.ndarray) -> list[bytes]:
        """Texts of the groups that end at the given positions, the first from the start on."""
        x, y = [self.a_text[i] for i in a.tolist()], [self.b_text[i] for i in b.tolist()]
        p, q = [0, *behind_a.tolist()], [0, *behind_b.tolist()]
        return [b",".join(x[i:j]) + b"|" + b",".join(y[k:m]) for i, j, k, m in zip(p, p[1:], q, q[1:])]


def worker_tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return worker_store(f"pair:{byte_level}:{pieces}", lambda: Tokenizers(byte_level, pieces))


# --- fragments --------------------------------------------------------------------------

@dataclass
class Fragment:
    """What a byte range knows; ids and links are little-endian 32-bit integers."""

    good: bool = True        # both tokenizers reproduce the bytes
    a: int = 0               # tokens that end in the range
    b: int = 0
    met: bool = False        # whether some end is common
    groups: int = 0          # closed groups
    prefix_a: bytes = b""    # tokens up to the first common end; all tokens if there is none
    prefix_b: bytes = b""
    closed: bytes = b""      # text of the closed groups
    suffix_a: bytes = b""
    suffix_b: bytes = b""
    links: bytes = b""


SPOILT = Fragment(good=False)


def _ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def _joined(*texts: bytes) -> bytes:
    return b";".join([t for t in texts if t])


def group_text(a: bytes, b: bytes) -> bytes:
    """Text of a group from its ids, as fragments hold them."""
    return b",".join([b"%d" % i for i in _ids(a)]) + b"|" + b",".join([b"%d" % i for i in _ids(b)])


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; it needs no tokenizer."""
    if not (f.good and g.good):
        return SPOILT
    a, b, links = f.a + g.a, f.b + g.b, f.links + g.links
    if not f.met:
        return Fragment(True, a, b, g.met, g.groups, f.prefix_a + g.prefix_a, f.prefix_b + g.prefix_b,
                        g.closed, g.suffix_a, g.suffix_b, links)
    if not g.met:
        return Fragment(True, a, b, True, f.groups, f.prefix_a, f.prefix_b, f.closed,
                        f.suffix_a + g.prefix_a, f.suffix_b + g.prefix_b, links)
    middle = group_text(f.suffix_a + g.prefix_a, f.suffix_b + g.prefix_b)
    return Fragment(True, a, b, True, f.groups + 1 + g.groups, f.prefix_a, f.prefix_b,
                    _joined(f.closed, middle, g.closed), g.suffix_a, g.suffix_b, links)


def fragment(t: Tokenizers, a: np.ndarray, b: np.ndarray, low: int, high: int) -> Fragment:
    """The fragment of the bytes ``low < end <= high`` of a run of tokens."""
    a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    in_a, in_b = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
    a, b = a[in_a].astype("<u4"), b[in_b].astype("<u4")
    behind_a, behind_b, links = t.common(a, b, a_ends[in_a], b_ends[in_b])
    if not len(behind_a):
        return Fragment(True, len(a), len(b), False, 0, a.tobytes(), b.tobytes())
    p, q, r, s = behind_a[0], behind_b[0], behind_a[-1], behind_b[-1]
    closed = t.group_texts(a[p:], b[q:], behind_a[1:] - p, behind_b[1:] - q)
    return Fragment(True, len(a), len(b), True, len(closed), a[:p].tobytes(), b[:q].tobytes(), b";".join(closed),
                    a[r:].tobytes(), b[s:].tobytes(), links.tobytes())


def finish(f: Fragment) -> tuple[int, int, int, bytes, str]:
    """``n_a, n_b, n_groups, links, groups_sha256`` of the fragment of a whole text."""
    if not f.good or not f.met:
        return 0, 0, 0, b"", ""
    text = _joined(group_text(f.prefix_a, f.prefix_b), f.closed)
    return f.a, f.b, f.groups + 1, f.links, hashlib.sha256(text).hexdigest()


def _boundary(text: bytes, at: int) -> bool:
    """Whether a space at ``at`` follows a character that is no white space."""
    start = at - 1
    while start > 0 and text[start] & 0xC0 == 0x80:
        start -= 1
    return at > 0 and text[at] == 0x20 and not text[start:at].decode(errors="replace").isspace()


def boundary_before(text: bytes, at: int) -> int:
    """The last boundary at or before ``at``, 0 if there is none."""
    at = text.rfind(b" ", 0, at + 1)
    while at > 0 and not _boundary(text, at):
        at = text.rfind(b" ", 0, at)
    return max(at, 0)


def boundary_after(text: bytes, at: int) -> int:
    """The first boundary after ``at``, the end of the text if there is none."""
    at = text.find(b" ", at + 1)
    while at >= 0 and not _boundary(text, at):
        at = text.find(b" ", at + 1)
    return len(text) if at < 0 else at


def ranges(text: bytes, size: int, shared: int = SHARED_PIECE) -> list[tuple[bytes, int, int]]:
    """Byte ranges of a text with a space before it: the segment to encode, and which ends count."""
    text = b" " + text
    cuts: list[tuple[int, int, int]] = [(0, 0, 0)]  # cut, boundary before it, boundary after it
    for target in range(size, len(text), size):
        if target <= cuts[-1][0]:
            continue
        before, after = boundary_before(text, target), boundary_after(text, target)
        cut = (target, before, after) if after - before <= shared else (after, after, after)
        if cut[0] < len(text):
            cuts.append((target, target, target) if before == target else cut)
    cuts.append((len(text),) * 3)
    return [(text[p:r], low - p, high - p) for (low, p, _), (high, _, r) in zip(cuts, cuts[1:])]


# --- words ------------------------------------------------------------------------------

class AlignedWords(WordTable):
    """Ids, groups and links of `` word`` for words of texts."""

    def __init__(self, t: Tokenizers, kept: int = KEPT_BYTES):
        self.t, self.ids_after_space = t, SpacedIds(t.a)
        super().__init__(kept)

    def clear(self) -> None:
        super().clear()
        self.state = np.full(1, -1, np.int8)  # 1: aligned, 0: bytes differ, -1: depends on what follows
        self.n_a, self.n_b, self.n_groups = (np.zeros(1, np.int64) for _ in range(3))
        self.start_a, self.start_b, self.start_links = (np.zeros(1, np.int64) for _ in range(3))
        self.a, self.b = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.links = np.zeros(0, "<i4")
        self.texts = [b""]
        self.text_bytes = 0

    def size(self) -> int:
        arrays = (self.state, self.n_a, self.n_b, self.n_groups, self.start_a, self.start_b, self.start_links, self.a, self.b, self.links)
        return self.known.nbytes + sum(x.nbytes for x in arrays) + self.text_bytes + 41 * len(self.texts)

    def add(self, words: list[str]) -> None:
        t = self.t
        state = np.full(len(words), -1, np.int8)
        regular = [k for k, w in enumerate(words) if w and not w[-1].isspace()]
        chosen = [words[k] for k in regular]
        a, b = self.ids_after_space.ids(chosen), t.pieces(chosen)
        content = b"".join([b" " + w.encode() for w in chosen])
        good = [True] * len(chosen)
        if not t.same_bytes([i for x in a for i in x], [i for x in b for i in x], content):
            good = [t.same_bytes(x, y, b" " + w.encode()) for x, y, w in zip(a, b, chosen)]
        state[regular] = good
        kept = [k for k, g in zip(regular, good) if g]
        a, b = [x for x, g in zip(a, good) if g], [y for y, g in zip(b, good) if g]
        flat_a, flat_b = (np.array([i for x in lists for i in x], np.uint32) for lists in (a, b))
        behind_a, behind_b, links = t.common(flat_a, flat_b, np.cumsum(t.a_size[flat_a]), np.cumsum(t.b_size[flat_b]))
        groups = t.group_texts(flat_a, flat_b, behind_a, behind_b)
        n_a, n_b, n_groups = (np.zeros(len(words), np.int64) for _ in range(3))
        n_a[kept], n_b[kept] = [len(x) for x in a], [len(y) for y in b]
        # Every word ends at a common end: its groups are those behind its tokens.
        upto = np.searchsorted(behind_a, np.cumsum(n_a), "right")
        n_groups[:] = np.diff(upto, prepend=0)
        texts = [b";".join(groups[j - n:j]) for n, j in zip(n_groups.tolist(), upto.tolist())]
        for name, n, base in (("a", n_a, len(self.a)), ("b", n_b, len(self.b)), ("links", n_groups, len(self.links))):
            starts = base + np.cumsum(n) - n
            setattr(self, f"start_{name}", np.concatenate([getattr(self, f"start_{name}"), starts]))
        self.state = np.concatenate([self.state, state])
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.n_groups = np.concatenate([self.n_groups, n_groups])
        self.a, self.b = np.concatenate([self.a, flat_a]), np.concatenate([self.b, flat_b])
        self.links = np.concatenate([self.links, links])
        self.texts += texts
        self.text_bytes += sum(map(len, texts))

    def states(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.state[at], -1)

    def tokens(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both for segments that begin with a space, and whether the bytes agree."""
        words, first = words_of(pa.array([x[1:] for x in segments], pa.large_string()))
        at = self.numbers(words)
        plain = np.concatenate([[0], np.cumsum(self.states(at) == 1)])[first]
        out = []
        runs = [(gather(values, starts[at], n[at]), np.concatenate([[0], np.cumsum(n[at])])[first])
                for values, starts, n in ((self.a, self.start_a, self.n_a), (self.b, self.start_b, self.n_b))]
        for k, segment in enumerate(segments):
            if plain[k + 1] - plain[k] == first[k + 1] - first[k]:
                out.append((*(ids[ends[k]:ends[k + 1]] for ids, ends in runs), True))
                continue
            (a,), (b,) = self.t.spaced([segment[1:]])
            out.append((np.array(a, np.uint32), np.array(b, np.uint32), self.t.same_bytes(a, b, segment.encode())))
        return out


def worker_words(byte_level: str, pieces: str) -> AlignedWords:
    return worker_store(f"aligned:{byte_level}:{pieces}", lambda: AlignedWords(worker_tokenizers(byte_level, pieces)))


def align_texts(table: AlignedWords, column: pa.Array) -> list[tuple[int, int, int, bytes, str]]:
    """``finish`` of every text of a slice, from the results of its words."""
    words, first = words_of(column)
    if not len(words):
        return []
    at = table.numbers(words)
    state = table.states(at)
    sums = {}
    for name, values in (("odd", state < 0), ("bad", state == 0), ("a", table.n_a[at]), ("b", table.n_b[at]), ("g", table.n_groups[at])):
        sums[name] = np.diff(np.concatenate([[0], np.cumsum(values)])[first]).tolist()
    links = gather(table.links, table.start_links[at], table.n_groups[at])
    ends = np.concatenate([[0], np.cumsum(sums["g"])]).tolist()
    numbers, texts, edges = at.tolist(), table.texts, first.tolist()
    out = []
    for k in range(len(column)):
        if sums["bad"][k]:
            out.append((0, 0, 0, b"", ""))
        elif sums["odd"][k]:
            text = column[k].as_py() or ""
            if not text:
                out.append((0, 0, 0, b"", ""))
                continue
            (a,), (b,) = table.t.spaced([text])
            content = b" " + text.encode()
            good = table.t.same_bytes(a, b, content)
            whole = fragment(table.t, np.array(a, np.uint32), np.array(b, np.uint32), 0, len(content)) if good else SPOILT
            out.append(finish(whole))
        else:
            text = b";".join(map(texts.__getitem__, numbers[edges[k]:edges[k + 1]]))
            out.append((sums["a"][k], sums["b"][k], sums["g"][k], links[ends[k]:ends[k + 1]].tobytes(), hashlib.sha256(text).hexdigest()))
    return out


# --- tables -----------------------------------------------------------------------------

_ALIGNED = "n_a long, n_b long, n_groups long, links binary, groups_sha256 string"
_FRAGMENT = ("copies long, good boolean, a long, b long, met boolean, groups long, prefix_a binary, prefix_b binary, "
             "closed binary, suffix_a binary, suffix_b binary, links binary")


def _short(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"doc_id {id_type(docs)}, {_ALIGNED}"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        table = worker_words(byte_level, pieces)
        for batch in byte_slices(batches, 1, SLICE_BYTES):
            rows = align_texts(table, batch.column(1))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), target.types[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=target)

    return docs.mapInArrow(run, schema)


def _long(docs: DataFrame, byte_level: str, pieces: str, size: int, fan_in: int) -> DataFrame:
    """The same for texts of several ranges: a task per range, then a tree of compositions.

    A row is known by its id and its text; equal rows share their fragments and are counted.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = id_type(docs)
    schema = f"doc_id {kind}, {_ALIGNED}"
    target = to_arrow_schema(_parse_datatype_string(schema))
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0

    def split(batch):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
            code = text_code(text)
            rows += [(doc_id, code, k, *part) for k, part in enumerate(ranges(text, size))]
        return list(zip(*rows)) or [[]] * 6

    parts = map_rows(docs, f"doc_id {kind}, code binary, number long, segment binary, low long, high long", split)

    def first_level(batch):
        table, rows = worker_words(byte_level, pieces), []
        for at in range(0, batch.num_rows, RANGES_AT_ONCE):
            segments, low, high = (c.slice(at, RANGES_AT_ONCE).to_pylist() for c in batch.columns[3:6])
            for (a, b, good), x, y in zip(table.tokens([x.decode() for x in segments]), low, high):
                rows.append((1, *astuple(fragment(table.t, a, b, x, y) if good else SPOILT)))
        return [*(batch.column(k) for k in range(3)), *zip(*rows)] if rows else [[]] * 15

    level = map_rows(parts.repartition("doc_id", "code", "number"),
                     f"doc_id {kind}, code binary, number long, {_FRAGMENT}", first_level)

    def whole(group: pa.Table) -> tuple:
        """Number, copies and fragment of the neighbours of a group."""
        rows = sorted(zip(*(group.column(k).to_pylist() for k in range(2, group.num_columns))), key=lambda r: r[0])
        copies = sum(r[1] for r in rows if r[0] == rows[0][0])
        done, last = None, None
        for number, _, *values in rows:
            if number != last:
                done = Fragment(*values) if done is None else compose(done, Fragment(*values))
                last = number
        return rows[0][0] // fan_in, copies, done

    def composed(group: pa.Table) -> pa.Table:
        number, copies, done = whole(group)
        columns = [group.column(0)[0].as_py(), group.column(1)[0].as_py(), number, copies, *astuple(done)]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(group.schema, columns)}, schema=group.schema)

    def ended(group: pa.Table) -> pa.Table:
        _, copies, done = whole(group)
        columns = [group.column(0)[0].as_py(), *finish(done)]
        return pa.table({f.name: pa.array([v] * copies, f.type) for f, v in zip(target, columns)}, schema=target)

    # The last step of the tree ends the text, so no task has two Python workers.
    width = fan_in
    while width <= longest // size + 1:
        level = level.groupBy("doc_id", "code", F.expr(f"number div {fan_in}")).applyInArrow(composed, level.schema)
        width *= fan_in
    return level.groupBy("doc_id", "code").applyInArrow(ended, schema)


def aligned(docs: DataFrame, byte_level: str, pieces: str, size: int = RANGE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, links, groups_sha256``.

    ``links`` holds the numbers (little-endian 32 bits) of the linked id pairs among
    ``Tokenizers.pairs``, in the order of the text.
    """
    rows = narrow(docs, "doc_id", "text")
    beyond = F.coalesce(F.octet_length("text") > size, F.lit(False))
    return _short(rows.where(~beyond), byte_level, pieces).unionByName(
        _long(rows.where(beyond), byte_level, pieces, size, fan_in))


def link_counts(done: DataFrame, t: Tokenizers) -> DataFrame:
    """``pair, a_id, b_id, n``: links of every id pair, at most one row per pair of the vocabularies."""
    n_pairs, n_b = len(t.pairs), len(t.b_bytes)

    def count(batches):
        seen = np.zeros(n_pairs, np.int64)
        for batch in batches:
            links = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            seen += np.bincount(links, minlength=n_pairs)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(seen[found])], names=["pair", "n"])

    sums = done.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = done.sparkSession.createDataFrame(
        pa.table({"pair": np.arange(n_pairs), "a_id": t.pairs // n_b, "b_id": t.pairs % n_b}))
    return sums.join(pairs, "pair")


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, size: int = RANGE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A null or empty text, and one that either tokenizer does not reproduce, has zeros and an
    empty digest, and its links are not counted.  A null ``doc_id`` stays null; repeated rows are
    repeated and counted each; several pairs with the highest count of a ``b`` id are all best.
    An empty table gives an empty result, other columns are not read.  The counts that every
    task needs are one number per pair of the vocabularies (about half a million), whatever the
    corpus.
    """
    spark = docs.sparkSession
    t = Tokenizers(byte_level, pieces)
    done = stage(aligned(docs, byte_level, pieces, size, fan_in), "aligned")
    found = link_counts(done, t).select("pair", "b_id", "n").toArrow()
    counts = np.zeros(len(t.pairs), np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    highest = np.zeros(len(t.b_bytes), np.int64)
    np.maximum.at(highest, t.pairs % len(t.b_bytes), counts)
    best = (counts > 0) & (counts == highest[t.pairs % len(t.b_bytes)])
    known = spark.sparkContext.broadcast((counts, best))

    def scored(batch):
        counts, best = known.value
        links = [np.frombuffer(x, "<i4") for x in batch.column(4).to_pylist()]
        return [*(batch.column(k) for k in range(4)), [len(x) for x in links],
                [int(best[x].sum()) for x in links], [int(counts[x].sum()) for x in links], batch.column(5)]

    return map_rows(done, f"doc_id {id_type(docs)}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                          "count_sum long, groups_sha256 string", scored)
