"""Exact cached encoding of whole texts with a byte-level BPE tokenizer file.

A position where a non-space character is followed by a space is a *stable boundary*: the
split pattern has no alternative that crosses it, it looks ahead from a run of spaces only,
and no special token contains a space.  So a text may be cut there, the pieces encoded
alone, and the ids joined.  Pieces repeat, so each worker keeps their ids.
"""

from __future__ import annotations

import os

import numpy as np

from ebbtide.llm.common import worker_store

#: Pieces a worker keeps; beyond it the older half is forgotten.
KEPT_PIECES = 400_000
#: Pieces longer than this are encoded but not kept.
KEPT_CHARS = 48


class Encoder:
    """Token ids as little-endian 32-bit integers, equal to the tokenizer's own for any text."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept = kept
        self.spaced: dict[str, bytes] = {}  # word -> ids of " " + word
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.after_space = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.after_space[i] = token.startswith("Ġ")  # the byte-level alphabet's space

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids from the tokenizer itself."""
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in done]

    def _encode_words(self, words: list[str]) -> None:
        """Keep the ids of `` word`` for words without a space that end in a non-space."""
        for start in range(0, len(words), 4000):
            lists = [words[i:i + 400] for i in range(start, min(start + 4000, len(words)), 400)]
            joined = self.direct([" " + " ".join(group) for group in lists])
            for group, raw in zip(lists, joined):
                ids = np.frombuffer(raw, dtype="<u4")
                starts = np.flatnonzero(self.after_space[ids])
                if len(starts) == len(group) and starts[0] == 0:
                    ends = [*(4 * starts[1:]).tolist(), len(raw)]
                    self.spaced.update(zip(group, (raw[a:b] for a, b in zip((4 * starts).tolist(), ends))))
                else:
                    self.spaced.update(zip(group, self.direct([" " + w for w in group])))

    def learn(self, words: set[str]) -> None:
        """Fill the memory for words (without a space, not ending in a space) it lacks."""
        new = [w for w in words if w not in self.spaced and w and not w[-1].isspace() and len(w) <= KEPT_CHARS]
        if not new:
            return
        if len(self.spaced) > self.kept:
            self.spaced = dict(list(self.spaced.items())[len(self.spaced) // 2:])
        # Between a Latin letter and a following run of stops there is always a boundary too.
        cut = {}
        for w in new:
            core = w.rstrip(".,")
            if core and len(core) < len(w) and core[-1].isalpha() and core[-1] < "ɐ":
                cut[w] = (core, w[len(core):])
        cores = {core for core, _ in cut.values()}
        cores.update(w for w in new if w not in cut)
        self._encode_words([w for w in cores if w not in self.spaced])
        tails = list({tail for _, tail in cut.values()})
        ids = dict(zip(tails, self.direct(tails)))
        for w, (core, tail) in cut.items():
            self.spaced[w] = self.spaced[core] + ids[tail]

    def ids_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, in order."""
        words = [t.split(" ") for t in texts]
        unseen: set[str] = set()
        for parts in words:
            unseen |= set(parts).difference(self.spaced)
        self.learn(unseen)
        heads = self.direct([parts[0] for parts in words])
        out = []
        for text, head, parts in zip(texts, heads, words):
            try:
                out.append(head + b"".join([self.spaced[w] for w in parts[1:]]))
            except KeyError:  # runs of spaces, other white space at a cut, or a very long word
                out.append(b"".join(self.pieces(text)[1]))
        return out

    def pieces(self, text: str) -> tuple[list[str], list[bytes]]:
        """The text cut at all its stable boundaries, and the ids of each piece."""
        pieces = cut_stable(text)
        self.learn({p[1:] for p in pieces[1:] if " " not in p[1:]})
        found = [self.spaced.get(p[1:]) if k else None for k, p in enumerate(pieces)]
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(missing, self.direct([pieces[k] for k in missing])):
            found[k] = ids
        return pieces, found


def cut_stable(text: str) -> list[str]:
    """Pieces whose concatenation is the text; all but the first begin at a stable boundary."""
    parts = text.split(" ")
    pieces, run = [], [parts[0]]
    inside = bool(parts[0]) and parts[0][-1].isspace()
    for part in parts[1:]:
        if not inside:
            pieces.append("".join(run))
            run = []
        run += [" ", part]
        inside = not part or part[-1].isspace()
    return [*pieces, "".join(run)]


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its memory lasts over the worker's tasks."""
    return worker_store(f"encoder:{path}", lambda: Encoder(path))
