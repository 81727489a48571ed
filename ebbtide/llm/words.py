"""Results per distinct word, looked up for whole slices of texts at a time.

Texts are cut at single spaces.  What a word gives (token ids, say) is worked out once per
worker and kept in flat arrays; a slice is then one hash lookup and one gather.  The memory is
bounded by bytes: beyond the bound the table starts anew with the words of the slice at hand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ebbtide.llm.common import worker_store
from ebbtide.llm.encoder import Encoder

#: Bytes that a table keeps, and the longest word (in bytes) that it takes.
KEPT_BYTES, KEPT_WORD = 80 << 20, 96
#: Text bytes of one lookup, and new words whose results are Python objects at a time.
SLICE_BYTES, ADDED_AT_ONCE = 8 << 20, 20_000
#: Pre-tokens that stand alone whatever surrounds them: letters, then punctuation (no apostrophe,
#: which may begin a contraction), and the same again after a line feed.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(f"({_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?")


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``source`` one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts of the texts between single spaces, and where each text's parts begin (and the end).

    A null text is empty; a text without a space is one part.
    """
    parts = pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), " ")
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    return parts.flatten(), offsets - offsets[0]


class WordTable:
    """Number of each word; subclasses keep what the words give under these numbers."""

    def __init__(self, kept: int = KEPT_BYTES):
        self.kept = kept
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([""], pa.large_string())  # the empty word is irregular in every table

    def size(self) -> int:
        return self.known.nbytes

    def add(self, words: list[str]) -> None:
        raise NotImplementedError

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers in the table, after new words were added; -1 for very long words."""
        fits = pc.less_equal(pc.binary_length(words), KEPT_WORD)
        at = pc.index_in(words, value_set=self.known)
        if pc.and_(at.is_null(), fits).true_count:
            if self.size() > self.kept:
                self.clear()
                at = pa.nulls(len(words), pa.int32())
            lacking = words.filter(pc.and_(at.is_null(), fits))
            new = lacking.unique()
            for start in range(0, len(new), ADDED_AT_ONCE):  # lists of ids are many times the kept arrays
                self.add(new.slice(start, ADDED_AT_ONCE).to_pylist())
            base = len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            found = np.array(pc.fill_null(at, -1))
            found[np.asarray(at.is_null()) & np.asarray(fits)] = np.asarray(pc.index_in(lacking, value_set=new)) + base
        else:
            found = np.asarray(pc.fill_null(at, -1))
        pa.default_memory_pool().release_unused()  # the lookup's hash table is as large as the known words
        return found


class SpacedIds:
    """Token ids of `` word`` as the tokenizer itself gives them."""

    def __init__(self, encoder: Encoder):
        from tokenizers.pre_tokenizers import ByteLevel

        self.encoder, self.model = encoder, encoder.tokenizer.model
        self.marks: dict[str, list[int]] = {}
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100)]
        self.alphabet = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in letters}

    def _letters(self, letters: str) -> list[int]:
        """Ids of one pre-token: the model is asked for its byte-level form at once."""
        return [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.translate(self.alphabet))]

    def _marks(self, marks: str) -> list[int]:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = np.frombuffer(self.encoder.direct([marks])[0], "<u4").tolist()
        return self.marks[marks]

    def ids(self, words: list[str]) -> list[list[int]]:
        """For words that do not end in white space; what is not plain goes through the tokenizer."""
        out: list = [None] * len(words)
        other = []
        for k, w in enumerate(words):
            plain = _PLAIN.fullmatch(w)
            if plain is None:
                other.append(k)
                continue
            core, marks, line, line_marks = plain.groups()
            ids = [t.id for t in self.model.tokenize("Ġ" + (core if core.isascii() else core.translate(self.alphabet)))]
            if marks:
                ids += self._marks(marks)
            if line:
                ids += self._marks("\n")
                ids += self._letters(line)
                if line_marks:
                    ids += self._marks(line_marks)
            out[k] = ids
        for k, raw in zip(other, self.encoder.direct([" " + words[k] for k in other])):
            out[k] = np.frombuffer(raw, "<u4").tolist()
        return out


class IdTable(WordTable):
    """Token ids of the words of texts, as flat arrays; equal to the tokenizer's for any text."""

    def __init__(self, encoder: Encoder, kept: int = KEPT_BYTES):
        self.encoder, self.spaced = encoder, SpacedIds(encoder)
        super().__init__(kept)

    def clear(self) -> None:
        super().clear()
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(1, np.int64), np.full(1, -1, np.int64)

    def size(self) -> int:
        return self.known.nbytes + self.ids.nbytes + self.starts.nbytes + self.lengths.nbytes

    def add(self, words: list[str]) -> None:
        # Words that are empty or end in white space depend on what follows: length -1.
        regular = [k for k, w in enumerate(words) if w and not w[-1].isspace()]
        lengths = np.full(len(words), -1, np.int64)
        lists = self.spaced.ids([words[k] for k in regular])
        lengths[regular] = [len(x) for x in lists]
        flat = np.array([i for x in lists for i in x], np.uint32)
        ends = np.cumsum(np.maximum(lengths, 0))
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - np.maximum(lengths, 0)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (and the end)."""
        words, first = words_of(column)
        if not len(words):
            return self.ids[:0], np.zeros(1, np.int64)
        at = self.numbers(words)
        lengths, starts = np.where(at >= 0, self.lengths[at], -1), self.starts[at]
        heads = first[:-1]
        odd = lengths < 0
        odd[heads] = False
        odd = np.diff(np.concatenate([[0], np.cumsum(odd)])[first]) > 0
        # The first part has no space before it; an odd text is encoded as a whole in its place.
        texts = words.take(pa.array(heads)).to_pylist()
        whole = {int(k): column[int(k)].as_py() for k in np.flatnonzero(odd)}
        own = self.encoder.direct([texts[k] for k in range(len(texts)) if k not in whole])
        plain = iter(own)
        own = [b"".join(self.encoder.pieces(whole[k])[1]) if k in whole else next(plain) for k in range(len(texts))]
        lengths[np.repeat(odd, np.diff(first))] = 0
        lengths[heads] = [len(x) // 4 for x in own]
        starts[heads] = len(self.ids) + np.cumsum(lengths[heads]) - lengths[heads]
        source = np.concatenate([self.ids, np.frombuffer(b"".join(own), "<u4")])
        return gather(source, starts, lengths), np.concatenate([[0], np.cumsum(lengths)])[first]


def worker_ids(path: str) -> IdTable:
    """The id table of this Python worker; it lasts over the worker's tasks."""
    return worker_store(f"ids:{path}", lambda: IdTable(Encoder(path, kept=100_000)))
