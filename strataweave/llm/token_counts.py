"""Token counts by a linear longest-match automaton over the trie of a word-piece vocabulary.

A word is cut by taking the longest piece of the vocabulary again and again. Pieces that begin with the mark for a
word's start match there only. If the mark alone is a piece too, it stands for itself where no longer piece with a mark
matches, and counts one; otherwise pieces without a mark match at a word's start as well, and the mark costs nothing. The trie of the pieces gets failure links: where a node has no child for a byte, the
pieces that longest match would take from what was read are popped, and the link leads to the node for the rest. Links
and the numbers of pieces popped on the way are worked out beforehand for every node and byte, so a word costs one
step a byte and only a count is kept; pieces are never built. Bytes that no piece covers count one each.

Steps are taken for all distinct words of a piece of the table at once.

Defined cases: null and empty texts, and texts of white space, count 0 words and 0 tokens; null ids stay null;
repeated rows repeat. Words are runs of characters other than ASCII white space. Extra columns are left alone.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import NOT_SPACE, documents, pieces, spans, strings

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def word_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]


class Automaton:
    """step[node, byte] is the next node and popped[node, byte] the pieces popped on the way; ending[node] the pieces popped at a word's end.

    Node 0 is the start of a word, behind its mark, node 1 the place behind a piece.
    """

    def __init__(self, vocabulary: list[str], mark: str = MARK):
        alone = mark in vocabulary
        first, inner = {p.removeprefix(mark).encode() for p in vocabulary if p.startswith(mark) and p != mark}, {p.encode() for p in vocabulary if p and not p.startswith(mark)}
        inner |= {bytes([b]) for b in range(256)}  # unknown bytes are pieces of one byte
        names = first if alone else first | inner, inner
        child: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root in (0, 1):
            for name in names[root]:
                u = root
                for b in name:
                    v = child[u].get(b)
                    if v is None:
                        v = child[u][b] = len(child)
                        child.append({})
                        piece.append(False)
                    u = v
                piece[u] = True
        n = len(child)
        self.step = np.zeros((n, 256), np.int32)
        self.popped = np.zeros((n, 256), np.int32)
        self.ending = np.zeros(n, np.int64)
        link, pops, depth = [-1] * n, [0] * n, [0] * n
        if alone:
            link[0], pops[0] = 1, 1
        queue = [1, 0]
        for u in queue:
            for b, v in child[u].items():
                depth[v] = depth[u] + 1
                if piece[v]:
                    link[v], pops[v] = 1, 1
                else:  # what is left behind the pieces that longest match pops from the node above
                    z, k = link[u], pops[u]
                    while b not in child[z]:
                        k += pops[z]
                        z = link[z]
                    link[v], pops[v] = child[z][b], k
                queue.append(v)
        for u in queue:
            if link[u] >= 0:
                self.step[u] = self.step[link[u]]
                self.popped[u] = self.popped[link[u]] + pops[u]
                self.ending[u] = pops[u] + self.ending[link[u]]
            for b, v in child[u].items():
                self.step[u, b], self.popped[u, b] = v, 0

    def count(self, words: pa.Array) -> np.ndarray:
        """Tokens of each word."""
        buf, off = strings(words)
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        at, sizes = off[:-1][order], size[order]
        node, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        alive = len(at) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1)) if len(at) else []
        for k, m in enumerate(alive):
            b = buf[at[:m] + k]
            total[:m] += self.popped[node[:m], b]
            node[:m] = self.step[node[:m], b]
        out = np.zeros(len(at), np.int64)
        out[order] = total + self.ending[node]
        return out


def automaton(vocabulary: list[str]) -> Automaton:
    """Kept by the worker process: it is larger than the vocabulary it follows from."""
    kept = sys.__dict__.setdefault("_kept_automata", {})
    key = hash(tuple(vocabulary))
    if key not in kept:
        kept.clear()
        kept[key] = Automaton(vocabulary)
    return kept[key]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | list[str] = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    docs = documents(docs, id_col, text_col)
    names = docs.sparkSession.sparkContext.broadcast(word_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary)

    def count(batches):
        machine = automaton(names.value)
        for batch in batches:
            for piece in pieces(batch, "text"):
                buf, off = strings(piece["text"])
                starts, ends, before = spans(buf, off, NOT_SPACE)
                size = ends - starts
                total = np.zeros(len(size) + 1, np.int64)
                if len(size):
                    solid = np.ascontiguousarray(buf[NOT_SPACE[buf]])
                    coded = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(solid)]).dictionary_encode()
                    np.cumsum(machine.count(coded.dictionary)[coded.indices.to_numpy()], out=total[1:])
                yield pa.record_batch({"doc_id": piece["doc_id"], "n_words": pa.array(np.diff(before)), "n_tokens": pa.array(np.diff(total[before]))})

    return docs.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
