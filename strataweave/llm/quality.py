"""A quality classifier learnt from positive and unlabelled documents by the non-negative unbiased risk.

A document is described by the square roots of the shares of its pairs of neighbouring byte classes (lower case, upper case, digits,
marks of several kinds and so on), by its words and by a constant. For the words, a first pass over the whole text of all
documents counts the documents that hold each word, among all and among the trusted positives, in 2**WORD_BITS hashed
buckets. A word's level is how much rarer (or more frequent) it is in the positives than in the table, as far as that is
certain (DOUBT standard deviations); each level describes a document by whether, and by the square root of how often,
such words occur. So words of toxic prose, which no byte class shows, reach the classifier. The score g is linear in them. With the loss (1 - y g)^2 / 4, the
class prior p, trusted positives P and the whole table as unlabelled text U, the risk is
p E_P[(1 - g)^2] / 4 + max(0, E_U[(1 + g)^2] / 4 - p E_P[(1 + g)^2] / 4). It is the larger of two convex quadratics of the
weights, whose coefficients are the second moments of the description over P and over U: a second pass over the table
gathers them in a size that doesn't grow, and the risk is then minimised exactly, over the mixtures of the two.

The prior is estimated from the scores of a first classifier, P against U, over the whole table: the least upper bound of
the ratio of the shares of U and of held-out positives above a threshold (best-bin estimation). A document is accepted
if g > 0, that is, if a good one is more likely.

A word can only be told from chance if DOUBT allows it: one that no positive holds has to be expected in more than 12 of
the positives, so with few labels, or for rare insults, toxic documents in ordinary prose are still accepted.

Trusted positives are documents with a label of quality 1 and none of quality 0 or of toxicity; at most
MOST_POSITIVES of them are used, those whose hashed ids are least. A quarter of them are held out for the prior.

Defined cases: a null text, and a text of less than two bytes, has a null score and is rejected. A null id can't be labelled but is
scored. Repeated rows count and are scored each; conflicting labels make no trusted positive. Without trusted positives
nothing can be learnt: scores are null and every text of two bytes or more is accepted. Ties (g = 0) are rejected.
Extra columns are left alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, WORD, documents, filtered, hashes, integer_id, owners, pieces, quoted, ready, spans, strings

MOST_POSITIVES = 20_000
RIDGE = 1e-4
BINS = 2000
BLOCK = 1 << 13
#: Bytes of text described at once: arrays of this size stay in the processor's cache.
PIECE = 500_000

CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", ":;", "'\"`", "()[]{}", "|", "#$%&*+=@^~<>\\", "-/_")
CLASS = np.full(256, len(CLASSES), np.uint16)
for _k, _c in enumerate(CLASSES):
    CLASS[list(_c.encode())] = _k
CLASS[128:192], CLASS[192:] = len(CLASSES) + 1, len(CLASSES) + 2
KINDS = len(CLASSES) + 3

#: Buckets of hashed words, as bits.
WORD_BITS = 18
#: Standard deviations, of the square root of a count of positives, within which a difference counts as chance.
DOUBT = 2.0
#: Words have level 1, 2 or 3 if they are this much rarer in positives than in the table, and level 4 if they are MORE times as frequent.
RARER, MORE = (0.75, 0.5, 0.25), 4 / 3
LEVELS = len(RARER) + 1
WIDTH = KINDS * KINDS + 2 * LEVELS + 1


class Model(NamedTuple):
    weights: np.ndarray | None
    prior: float
    levels: np.ndarray | None = None


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each word."""
    buf, off = strings(column, lower=True)
    starts, ends, before = spans(buf, off, WORD)
    return (hashes(buf, starts, ends) >> U64(64 - WORD_BITS)).astype(np.int64), owners(before)


def describe(column: pa.Array, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(descriptions, whether the text has two bytes or more). Without levels, words don't count."""
    buf, off = strings(column)
    size = np.diff(off)
    pairs = np.zeros((len(size), WIDTH), np.float32)
    if len(buf) > 1:
        kind = CLASS[buf].astype(np.int64)
        pair = kind[:-1] * KINDS + kind[1:]
        own = np.repeat(np.arange(len(size)) * KINDS * KINDS, size)[:-1]
        whole = np.ones(len(pair), bool)
        whole[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))] - 1] = False
        pairs[:, : KINDS * KINDS] = np.bincount((own + pair)[whole], minlength=len(size) * KINDS * KINDS).reshape(len(size), -1)
    pairs[:, : KINDS * KINDS] = np.sqrt(pairs[:, : KINDS * KINDS] / np.maximum(1, size - 1)[:, None])
    if levels is not None:
        bucket, own = word_buckets(column)
        count = np.bincount(own * (LEVELS + 1) + levels[bucket], minlength=len(size) * (LEVELS + 1)).reshape(len(size), -1)
        pairs[:, KINDS * KINDS : -1 - LEVELS] = count[:, 1:] > 0
        pairs[:, -1 - LEVELS : -1] = np.sqrt(count[:, 1:] / np.maximum(1, count.sum(axis=1))[:, None])
    pairs[:, -1] = 1
    return pairs, size > 1


def summed(rows: DataFrame) -> DataFrame:
    """Sums vectors of doubles by block, in two steps so that no group grows with the number of tasks beyond its square root."""

    def add(key, table):
        total = 0.0
        for x in table["sums"]:
            total = total + np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, task int, sums binary"
    return rows.groupBy("block", F.expr("task div 1024").alias("part")).applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)


def known(piece: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    return np.isin(piece["doc_id"].fill_null(0).to_numpy(), ids) & piece["doc_id"].is_valid().to_numpy(zero_copy_only=False)


def totals(docs: DataFrame, length: int, add) -> np.ndarray:
    """The sum over all tasks of a vector of that length, to which add(vector, piece) adds."""

    def gather(batches):
        total = np.zeros(length + -length % BLOCK)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                add(total[:length], piece)
        flat = total.reshape(-1, BLOCK)
        task = TaskContext.get().partitionId()
        yield pa.record_batch({"block": pa.array(np.arange(len(flat)), pa.int32()), "task": pa.array(np.full(len(flat), task, np.int32)), "sums": pa.array([r.tobytes() for r in flat], pa.binary())})

    rows = summed(docs.mapInArrow(gather, "block int, task int, sums binary")).collect()
    flat = np.zeros(length + -length % BLOCK)
    for r in rows:
        flat[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["sums"]), np.float64)
    return flat[:length]


def word_levels(docs: DataFrame, chosen: np.ndarray) -> np.ndarray:
    """The level of each bucket of words; 0 if its words are about as frequent in documents of the chosen ids as in all."""
    ids, size = docs.sparkSession.sparkContext.broadcast(chosen), 1 << WORD_BITS

    def add(total, piece):
        bucket, own = word_buckets(piece["text"])
        pair = np.unique(own << WORD_BITS | bucket)
        own, bucket = pair >> WORD_BITS, pair & (size - 1)
        good = known(piece, ids.value)
        for k, mine in enumerate((np.ones(len(good), bool), good)):
            total[k * size : (k + 1) * size] += np.bincount(bucket[mine[own]], minlength=size)
            total[2 * size + k] += mine.sum()

    flat = totals(docs, 2 * size + 2, add)
    u, p = flat[: 2 * size].reshape(2, -1)
    expected = u * flat[-1] / max(1, flat[-2])
    high, low = (np.sqrt(p + 1) + DOUBT) ** 2, np.maximum(0, np.sqrt(p) - DOUBT) ** 2
    out = np.sum([high < r * expected for r in RARER], axis=0).astype(np.uint8)
    out[low > MORE * expected] = LEVELS
    return out


def moments(docs: DataFrame, chosen: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the products of descriptions, over all documents and over those of the chosen ids; the last entry is their number."""
    shared = docs.sparkSession.sparkContext.broadcast((chosen, levels))

    def add(total, piece):
        both = total.reshape(2, WIDTH, WIDTH)
        ids, level = shared.value
        x, ok = describe(piece["text"], level)
        good = known(piece, ids) & ok
        both[0] += x[ok].T @ x[ok]
        if good.any():
            both[1] += x[good].T @ x[good]

    both = totals(docs, 2 * WIDTH * WIDTH, add).reshape(2, WIDTH, WIDTH)
    return both[0], both[1]


def minimum(u: np.ndarray, p: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """The weights of least non-negative risk, from mean products of descriptions over unlabelled and positive text."""
    mu, mp = u[-1], p[-1]

    def of(mix: float) -> np.ndarray:
        # mix * (unbiased risk) + (1 - mix) * (risk of the positives alone)
        a = (mix * u + (1 - mix) * prior * p) / 2 + ridge * np.eye(len(u))
        b = mix * (prior * mp - mu / 2) + (1 - mix) * prior * mp / 2
        return np.linalg.solve(a, b)

    def excess(w: np.ndarray) -> float:
        return (1 + 2 * w @ mu + w @ u @ w) / 4 - prior * (1 + 2 * w @ mp + w @ p @ w) / 4

    if excess(of(1.0)) >= 0:
        return of(1.0)
    low, high = 0.0, 1.0  # at the least maximum of two convex functions both are equal
    for _ in range(50):
        mid = (low + high) / 2
        if excess(of(mid)) > 0:
            low = mid
        else:
            high = mid
    return of(low)


def estimated_prior(u: np.ndarray, p: np.ndarray, sure: float = 0.1, gamma: float = 0.01) -> float:
    """From counts by ascending score of unlabelled documents and of held-out positives."""
    nu, np_ = u.sum(), p.sum()
    above_u, above_p = np.cumsum(u[::-1])[::-1] / nu, np.cumsum(p[::-1])[::-1] / np_
    ok = above_p > 0
    doubt = np.sqrt(np.log(4 / sure) / 2 / nu) + np.sqrt(np.log(4 / sure) / 2 / np_)
    bound = (above_u[ok] + (1 + gamma) * doubt) / above_p[ok]
    k = int(bound.argmin())
    return float(np.clip(above_u[ok][k] / above_p[ok][k], 0.01, 0.99))


def histogram(docs: DataFrame, weights: np.ndarray, held: np.ndarray, bins: int = BINS, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many of all documents, and of those of the held ids, score in each of the bins between -2 and 2."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, held, levels))

    def count(batches):
        w, ids, level = shared.value
        total = np.zeros((2, bins), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                x, ok = describe(piece["text"], level)
                at = np.clip((x @ w + 2) * bins / 4, 0, bins - 1).astype(np.int64)
                total[0] += np.bincount(at[ok], minlength=bins)
                total[1] += np.bincount(at[ok & known(piece, ids)], minlength=bins)
        some = np.flatnonzero(total[0])
        yield pa.record_batch({"bin": pa.array(some, pa.int32()), "u": pa.array(total[0, some]), "p": pa.array(total[1, some])})

    out = np.zeros((2, bins))
    for r in docs.mapInArrow(count, "bin int, u long, p long").groupBy("bin").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect():
        out[:, r["bin"]] = r["u"], r["p"]
    return out[0], out[1]


def trusted(labels: DataFrame, most: int, label_id: str, quality_col: str, toxic_col: str) -> np.ndarray:
    """Ids of the trusted positives, by hash."""
    good = labels.select(integer_id(labels, label_id).alias("doc_id"), quoted(quality_col).alias("quality"), quoted(toxic_col).alias("toxic"))
    good = good.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    rows = good.where("low = 1 and high = 1 and toxic = 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.array([r["doc_id"] for r in rows], np.int64)


def fitted(docs: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES, ridge: float = RIDGE, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> Model:
    """The classifier; the prior is estimated unless given."""
    ready(docs.sparkSession)
    docs = documents(docs, id_col, text_col).where("text is not null")
    ids = trusted(labels, most_positives, label_id, quality_col, toxic_col)
    held = np.arange(len(ids)) % 4 == 3
    levels = word_levels(docs, np.sort(ids[~held])) if len(ids) else None
    u, p = moments(docs, np.sort(ids[~held]), levels)
    if not p[-1, -1] or not u[-1, -1]:
        return Model(None, float("nan"))
    u, p = u / u[-1, -1], p / p[-1, -1]
    if prior is None:
        first = np.linalg.solve((u + p) / 2 + ridge * np.eye(WIDTH), (p[-1] - u[-1]) / 2)
        first = first / max(1e-12, np.abs(first).sum() / 4)
        least, positives = histogram(docs, first, np.sort(ids[held]), levels=levels)
        prior = estimated_prior(least, positives) if positives.sum() else 0.5
    return Model(minimum(u, p, prior, ridge), prior, levels)


def judged(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, whether there is a score, whether the text is accepted)."""
    x, ok = describe(column, model.levels)
    if model.weights is None:
        return np.zeros(len(ok)), np.zeros(len(ok), bool), ok
    score = x.astype(np.float64) @ model.weights
    return score, ok, ok & (score > 0)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and accepted of every row."""
    docs = documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                score, known, good = judged(piece["text"], shared.value)
                yield pa.record_batch({"doc_id": piece["doc_id"], "score": pa.array(score, mask=~known), "accepted": pa.array(good)})

    return docs.mapInArrow(judge, "doc_id long, score double, accepted boolean")


def only_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The accepted documents in all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, text_col, lambda column: judged(column, shared.value)[2], PIECE)
