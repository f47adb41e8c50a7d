"""Exact byte-level BPE ids of whole texts, with each distinct stretch of a piece encoded once.

The splitting pattern of these tokenizers never puts white space behind other characters into one part, so a text may
be cut before any white space that follows a character known not to be white space, and the ids of the parts are the
ids of the text. The cuts leave about a word each; a piece has far fewer distinct ones than it has words.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import SPACE, strings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Larger pieces have fewer distinct stretches for their size.
BPE_BYTES = 6_000_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Made in the worker from the vocabulary, which travels as a broadcast."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, k in vocabulary.items():
            self.length[k] = len(piece)

    def _parts(self, column: pa.Array):
        buf, off = strings(column)
        if not len(buf):
            return None, np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        space = SPACE[buf]
        solid = ~space & (buf < 0x80) & (buf > 32)
        solid[1:] |= buf[:-1] == 0xC3  # letters of two bytes, and the signs for times and divided by
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = space[1:] & solid[:-1]
        cut[off] = True
        at = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        return parts.dictionary, parts.indices.to_numpy().astype(np.int64), np.searchsorted(at, off)

    def _encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, ids before each part)."""
        texts = parts.cast(pa.large_string()).to_pylist()
        joined = [k for k, t in enumerate(texts) if t[0].isspace() and t[0] in " \t\n\r\v\f" and not t[-1].isspace()]
        alone = sorted({*range(len(texts))} - {*joined})
        ids: list[np.ndarray] = []
        count = np.zeros(len(texts), np.int64)
        if joined:
            got = np.array(self.coder.encode_ordinary("".join([texts[k] for k in joined])), np.int64)
            end = np.cumsum([len(texts[k].encode()) for k in joined])
            upto = np.searchsorted(np.cumsum(self.length[got]), end, "left") + 1
            count[joined] = np.diff(np.append(0, upto))
            ids.append(got)
        for k in alone:
            got = np.array(self.coder.encode_ordinary(texts[k]), np.int64)
            count[k] = len(got)
            ids.append(got)
        order = np.array(joined + alone, np.int64)
        start = np.zeros(len(texts) + 1, np.int64)
        begin = np.append(0, np.cumsum(count[order]))[:-1]
        where = np.zeros(len(texts), np.int64)
        where[order] = begin
        start[1:] = np.cumsum(count)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        pick = np.repeat(where - start[:-1], count) + np.arange(start[-1])
        return flat[pick], start

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids before each text)."""
        parts, which, before = self._parts(column)
        if parts is None:
            return np.zeros(0, np.int64), before
        flat, start = self._encode(parts)
        count = np.diff(start)[which]
        end = np.append(0, np.cumsum(count))
        return flat[np.repeat(start[which] - end[:-1], count) + np.arange(end[-1])], end[before]

    def counts(self, column: pa.Array) -> np.ndarray:
        parts, which, before = self._parts(column)
        if parts is None:
            return np.zeros(len(column), np.int64)
        end = np.append(0, np.cumsum(np.diff(self._encode(parts)[1])[which]))
        return np.diff(end[before])
