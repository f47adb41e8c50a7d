"""Document fingerprints by consistent weighted sampling.

A document is its words (letters, digits and underlines in lower case) weighted by how often they occur in it. For
each of SAMPLES independent samples, each word draws r and c from Gamma(2, 1) and b from [0, 1), all from hashes of the
word, so alike in every document; with weight w, t = floor(ln w / r + b), ln y = r (t - b), and the word with the least
ln a = ln c - ln y - r is sampled. The signature holds a 32-bit hash of (word, t) for each sample. Two documents agree
in a sample with the probability sum(min w) / sum(max w), their generalised Jaccard similarity. The gamma draws are the
middles of STEPS equal parts of probability, which moves that probability by less than one part in a thousand.

Defined cases: a row with a null id keeps its null id. A null or empty text, or one without words, gets an empty
signature. Rows are taken one by one, so repeated rows repeat. Ties go to the word of the least hash.
Extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, WORD, documents, hashes, mix, owners, pieces, spans, strings

SAMPLES = 64
STEPS = 1 << 16


def gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middles of STEPS equal parts of probability, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(STEPS) + 0.5) / STEPS
    x = np.where(p < 0.3, np.sqrt(2 * p), 1.0 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-9)
    return x


def draws(word: np.ndarray, sample: int, gamma: np.ndarray):
    """(r, c, b) of each word hash for a sample, in double precision."""
    h = mix(word ^ mix(np.array([sample + 1], U64))[0])
    low = U64(STEPS - 1)
    return gamma[(h & low).astype(np.int64)], gamma[(h >> U64(16) & low).astype(np.int64)], (h >> U64(32)).astype(np.float64) / 2**32


def sample(word: np.ndarray, weight: np.ndarray, before: np.ndarray, samples: int, gamma: np.ndarray) -> np.ndarray:
    """A row of `samples` 32-bit hashes for each owner that has words; words of an owner are distinct and ascend."""
    some = np.diff(before) > 0
    first = before[:-1][some]
    out = np.zeros((len(first), samples), np.int32)
    if not len(word):
        return out
    names, at = np.unique(word, return_inverse=True)
    heavy = np.flatnonzero(weight > 1)
    ln = np.log(weight[heavy])
    owner = np.repeat(np.arange(len(first)), np.diff(before)[some])
    for k in range(samples):
        r, c, b = draws(names, k, gamma)
        cost = (np.log(c) - r * (1 - b))[at]  # of weight 1, where t = 0
        t = np.zeros(len(heavy))
        if len(heavy):
            rh, bh = r[at[heavy]], b[at[heavy]]
            t = np.floor(ln / rh + bh)
            cost[heavy] = np.log(c)[at[heavy]] - rh * (t - bh + 1)
        least = np.minimum.reduceat(cost, first)
        hit = np.flatnonzero(cost == least[owner])
        hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]
        step = np.zeros(len(word), np.int64)
        step[heavy] = t
        out[:, k] = (mix(word[hit] + step[hit].astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its signature, an array of `samples` ints."""
    docs = documents(docs, id_col, text_col)

    def sign(batches):
        gamma = gamma_quantiles()
        for batch in batches:
            for piece in pieces(batch, "text"):
                buf, off = strings(piece["text"], lower=True)
                starts, ends, before = spans(buf, off, WORD)
                word, own = hashes(buf, starts, ends), owners(before)
                order = np.lexsort((word, own)) if own.size and own[-1] >= 1 << 16 else np.argsort(own.astype(U64) << U64(48) | word >> U64(16))
                word, own = word[order], own[order]
                new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (own[1:] != own[:-1])]) if len(word) else np.zeros(0, np.int64)
                weight = np.diff(np.append(new, len(word))).astype(np.float64)
                word, own = word[new], own[new]
                rows = np.searchsorted(own, np.arange(piece.num_rows + 1))
                size = np.where(np.diff(rows) > 0, samples, 0)
                flat = sample(word, weight, rows, samples, gamma).reshape(-1)
                yield pa.record_batch({"doc_id": piece["doc_id"], "signature": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))})

    return docs.mapInArrow(sign, "doc_id long, signature array<int>")


def similarity(a: str, b: str):
    """The share of samples that agree: an estimate of the generalised Jaccard similarity; null for an empty signature."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.size(a))
