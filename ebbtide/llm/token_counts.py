"""Token counts of whole texts; huge texts are counted from overlapping chunks.

A text longer than a chunk is encoded by the tokenizer in chunks that overlap, with the place
where each token ends.  Two neighbours are spliced at a boundary that is proven: a space behind
a non-space (``encoder``) where a token ends in both chunks, and from which both have the same
tokens up to the next such place.  What is left of it comes from the left chunk, the rest from
the right one.  Where the overlap has none, it is doubled, at last up to the whole left chunk, and
the two are then encoded as one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from ebbtide.llm.common import id_type, map_rows, narrow, texts_of
from ebbtide.llm.encoder import Encoder, worker_encoder

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 128
#: White space as Python sees it holds all that the split pattern calls so.
_STABLE = re.compile(r"(?<=\S) ")


def _encode(encoder: Encoder, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``text[start:end]`` and where in the text each token ends."""
    done = encoder.tokenizer.encode(text[start:end], add_special_tokens=False)
    return np.array(done.ids, "<u4"), start + np.array([b for _, b in done.offsets], np.int64)


def _tokens_before(ends: np.ndarray, place: int) -> int | None:
    """How many tokens end at or before a place, if one ends there."""
    n = int(np.searchsorted(ends, place, "right"))
    return n if n and ends[n - 1] == place else None


def _splice(text: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray],
            start: int, end: int) -> tuple[int, int, int] | None:
    """First agreed boundary in the overlap ``text[start:end]``: the place, tokens before it."""
    places = [m.start() for m in _STABLE.finditer(text, start + 1, end)]
    cuts = [(p, _tokens_before(left[1], p), _tokens_before(right[1], p)) for p in places]
    cuts = [c for c in cuts if c[1] is not None and c[2] is not None]
    for (place, i, j), (_, next_i, next_j) in zip(cuts, cuts[1:]):
        if np.array_equal(left[0][i:next_i], right[0][j:next_j]):
            return place, i, j
    return None


def encode_chunked(encoder: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> bytes:
    """Ids of a text from overlapping chunks, equal to encoding it at once.

    A text without any boundary is encoded in chunks that double, so the work stays in
    proportion to its length.
    """
    done: list[np.ndarray] = []
    start, end, step = 0, min(chunk, len(text)), chunk
    left = _encode(encoder, text, start, end)
    while end < len(text):
        new_end, wide = min(end + step, len(text)), overlap
        while True:
            begin = max(start, end - wide)
            right = _encode(encoder, text, begin, new_end)
            if begin == start:  # encoded as one with the left chunk
                left, step = right, 2 * step
                break
            met = _splice(text, left, right, begin, end)
            if met:
                start, i, j = met
                done.append(left[0][:i])
                left, step = (right[0][j:], right[1][j:]), chunk
                break
            wide *= 2
        end = new_end
    return np.concatenate([*done, left[0]]).tobytes()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    One narrow pass, no shuffle.  A text of any length is counted whole, in chunks beyond ``chunk``
    characters.  A null text counts as empty (0 bytes, 0 tokens); a null
    ``doc_id`` stays null; repeated rows give repeated rows; an empty table gives an empty one;
    other columns are not read.
    """
    def work(batch):
        encoder = worker_encoder(tokenizer)
        texts = texts_of(batch.column(1))
        short = [k for k, t in enumerate(texts) if len(t) <= chunk]
        counts = [0] * len(texts)
        for k, ids in zip(short, encoder.ids_many([texts[k] for k in short])):
            counts[k] = len(ids) // 4
        for k, t in enumerate(texts):
            if len(t) > chunk:
                counts[k] = len(encode_chunked(encoder, t, chunk, overlap)) // 4
        sizes = [len(t.encode()) for t in texts]
        return [batch.column(0), sizes, counts, [n > limit for n in counts]]

    schema = f"doc_id {id_type(docs)}, n_bytes long, n_tokens long, over_limit boolean"
    return map_rows(narrow(docs, "doc_id", "text"), schema, work)
