"""Language identification by interpolated Kneser-Ney character models.

For each language that the table names, 5-grams of the characters of its words (lower case, four marks before and one
behind each) are counted over its documents. The highest order uses these counts, the lower ones the numbers of
different characters seen in front; each order is discounted by n1 / (n1 + 2 n2), or by a half where n1 or n2 is 0,
and interpolated with the next lower one, the last with a uniform distribution over the characters seen and one more.
Grams are named by 64-bit hashes. A first pass over the table gathers every 5-gram of every document, whatever its
label, so each model can give each of them its probability beforehand: scoring looks a 5-gram up once and for all
languages. Each document goes to the language with the lowest cross-entropy in bits a character.

No gram is dropped, so the models grow with the different grams of the input; they stay distributed. Only the most
frequent grams, as many as ARRAYS_BYTES hold, are broadcast, in sorted arrays of hashes. A document's other grams are
joined to the rest of the models, and both sums are added, so that the result doesn't depend on that size.

Rejection is calibrated on documents that trained nothing: those whose hashed text falls into the last of FOLDS folds.
Of these, the ones whose label and result agree give, for each language and length (by powers of four characters), the
median and the upper quartile; a document is rejected if its cross-entropy is above the median plus SPREAD times the
distance of the two. Up to a quarter of junk can't raise that limit. Where a language and length has fewer than LEAST
such documents, the limit is made of the language's median over all its documents and of how far the documents of all
languages are from theirs, and widened for texts shorter than usual by the square root of how much shorter they are.

Defined cases: a null or empty text and one of white space has a null language and cross-entropy and is rejected;
labels that are null train nothing, without labels every language is null, and without a document to calibrate on
everything is rejected. Ties go to the first language by name. Null ids stay null; repeated rows repeat. Very long
texts and words are read whole. Labels are expected to be few: their names are collected, and a gram has a number for
each of them. Extra columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOT_SPACE, U64, documents, mix, pieces, ready, signed, spans, strings

ORDER = 5
SPREAD, FOLDS, LEAST = 6.0, 10, 30
ARRAYS_BYTES = 48_000_000
PIECE = 2_000_000
START, END = U64(2), U64(3)
#: Different grams of a language that a task gathers before it hands them on.
GATHERED = 300_000


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(different words, which one each word is)."""
    size = ends - starts
    cover = np.zeros(len(buf) + 1, np.int8)
    cover[starts] += 1
    cover[ends] -= 1
    solid = np.ascontiguousarray(buf[np.cumsum(cover[:-1]).astype(bool)])
    coded = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(solid)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


class Line:
    """The characters of words in a row, with their marks; a position is a character of a word or its end."""

    def __init__(self, words: pa.Array, order: int):
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64) + U64(4)
        pad = order - 1
        #: Positions before each word.
        self.before = np.append(0, np.cumsum(size + 1))
        own = np.repeat(np.arange(len(size)), size)
        self.line = np.full(int(self.before[-1]) + len(size) * pad, START)
        self.line[np.arange(len(points)) + own * order + pad] = points
        self.line[self.before[1:] + np.arange(1, len(size) + 1) * pad - 1] = END
        self.at = np.arange(int(self.before[-1])) + (np.repeat(np.arange(len(size)), size + 1) + 1) * pad

    def context(self, k: int, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), U64(0xABCD0000 + k))
        for i in range(k - 1, 0, -1):
            out = (out ^ self.line[at - i]) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(32)
        return out

    def grams(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the k characters that end at each position."""
        at = self.at if at is None else at
        return mix((self.context(k, at) ^ self.line[at]) * U64(0xC2B2AE3D27D4EB4F) + U64(1))

    def rows(self, first: np.ndarray, order: int) -> np.ndarray:
        """At some positions, the grams of order to 1 characters, then their contexts."""
        at = self.at[first]
        return np.stack([self.grams(k, at) for k in range(order, 0, -1)] + [mix(self.context(k, at)) for k in range(order, 0, -1)], axis=1)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows with different first columns, and the sums of their numbers."""
    rows, n = np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])
    _, first, at = np.unique(rows[:, 0], return_index=True, return_inverse=True)
    return rows[first], np.bincount(at, n, len(first)).astype(np.int64)


def gram_counts(docs: DataFrame, names: list[str], order: int) -> DataFrame:
    """g5..g1, c5..c1 (contexts), n0.. (how often each language of the names has the gram) and n (how often all documents have it)."""
    columns = [f"g{k}" for k in range(order, 0, -1)] + [f"c{k}" for k in range(order, 0, -1)]

    def count(batches):
        kept: dict[int, list] = {}

        def out(code):
            rows, n = merged(kept.pop(code))
            return pa.record_batch([pa.array(np.full(len(n), code, np.int32)), *(pa.array(signed(rows[:, k])) for k in range(2 * order)), pa.array(n)], names=["code", *columns, "n"])

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                code = pc.index_in(piece["lang"], pa.array(names, pa.string())).fill_null(-1).to_numpy()
                buf, off = strings(piece["text"], lower=True)
                starts, ends, before = spans(buf, off, NOT_SPACE)
                of = np.repeat(code, np.diff(before))
                for c in np.unique(of).tolist():
                    mine = of == c
                    words, which = distinct_words(buf, starts[mine], ends[mine])
                    line = Line(words, order)
                    weight = np.repeat(np.bincount(which, minlength=len(words)), np.diff(line.before))
                    _, first, same = np.unique(line.grams(order), return_index=True, return_inverse=True)
                    kept.setdefault(c, []).append((line.rows(first, order), np.bincount(same, weight, len(first)).astype(np.int64)))
                    if sum(len(n) for _, n in kept[c]) > GATHERED * 4 // 3:
                        kept[c] = [merged(kept[c])]
                        if len(kept[c][0][1]) > GATHERED:
                            yield out(c)
        for c in list(kept):
            yield out(c)

    schema = "code int, " + ", ".join(f"{c} long" for c in columns) + ", n long"
    found = docs.select("lang", "text").mapInArrow(count, schema)
    each = [F.sum(F.when(F.col("code") == j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(len(names))]
    return found.groupBy(*columns).agg(*each, F.sum("n").alias("n"))


def train(docs: DataFrame, names: list[str], order: int = ORDER) -> DataFrame:
    """g (hash of a gram of the highest order), n (its occurrences in all documents) and x (its log probability in each of the languages), for all grams of the table."""
    ready(docs.sparkSession)
    each = range(len(names))
    level = {order: gram_counts(docs, names, order).checkpoint()}
    for k in range(order - 1, 0, -1):
        keys = [f"{c}{i}" for c in "gc" for i in range(k, 0, -1)]
        level[k] = level[k + 1].groupBy(*keys).agg(*[F.sum((F.col(f"n{j}") > 0).cast("long")).alias(f"n{j}") for j in each]).checkpoint()
    found = None
    for k, rows in level.items():
        told = rows.agg(F.lit(k).alias("k"), *[F.sum((F.col(f"n{j}") == v).cast("long")).alias(f"n{j}_{v}") for j in each for v in (1, 2)], *[F.sum((F.col(f"n{j}") > 0).cast("long")).alias(f"types{j}") for j in each])
        found = told if found is None else found.union(told)
    told = {r["k"]: r.asDict() for r in found.collect()}
    under: list[Column] = [F.lit(1.0 / ((told[1][f"types{j}"] or 0) + 1)) for j in each]
    lower = None
    for k in range(1, order + 1):
        a, b = ([told[k][f"n{j}_{v}"] or 0 for j in each] for v in (1, 2))
        discount = [x / (x + 2 * y) if x and y else 0.5 for x, y in zip(a, b)]
        context = level[k].groupBy(f"c{k}").agg(*[F.sum(f"n{j}").alias(f"total{j}") for j in each], *[F.sum((F.col(f"n{j}") > 0).cast("long")).alias(f"types{j}") for j in each])
        rows = level[k].join(context, f"c{k}")
        if lower is not None:
            rows, under = rows.join(lower, f"g{k - 1}"), [F.col(f"p{j}") for j in each]
        p = [F.when(F.col(f"total{j}") > 0, (F.greatest(F.col(f"n{j}") - d, F.lit(0.0)) + d * F.col(f"types{j}") * u) / F.col(f"total{j}")).otherwise(u) for j, d, u in zip(each, discount, under)]
        lower = rows.select(f"g{k}", *(["n"] if k == order else []), *[x.alias(f"p{j}") for j, x in zip(each, p)])
    return lower.select(F.col(f"g{order}").alias("g"), "n", F.array(*[F.log(f"p{j}").cast("float") for j in each]).alias("x")).checkpoint()


class Arrays:
    """Sorted hashes and their values; start has the place of the first hash for each value of the upper bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length())
        self.start = np.searchsorted(self.keys >> U64(64 - self.bits), np.arange(1 << self.bits, dtype=U64)).astype(np.int32)

    def places(self, want: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(want), -1)
        out = self.start[(want >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        last, todo = len(self.keys) - 1, np.arange(len(want))
        np.minimum(out, last, out=out)
        while len(todo):
            todo = todo[(self.keys[out[todo]] < want[todo]) & (out[todo] < last)]
            out[todo] += 1
        return np.where(self.keys[out] == want, out, -1)


def split(model: DataFrame, most: int) -> tuple[Arrays, DataFrame]:
    """The most frequent grams, at most that many, as arrays, and the others as a table."""
    rank = F.floor(2 * F.log2(F.col("n").cast("double"))).cast("int")
    number, least = 0, None
    for r in sorted(model.groupBy(rank.alias("rank")).count().collect(), key=lambda r: -r["rank"]):
        number += r["count"]
        if number > most:
            break
        least = r["rank"]
    if least is None:
        return Arrays(np.zeros(0, U64), np.zeros((0, 1), np.float32)), model
    t = model.where(rank >= least).select("g", "x").toArrow()
    return Arrays(t["g"].to_numpy().view(U64), t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)), model.where(rank < least)


def scores(docs: DataFrame, model: DataFrame, names: list[str], order: int, arrays_bytes: int) -> DataFrame:
    """doc_id, lang, held, language, bits (cross-entropy of it), margin (to the second) and chars of each row."""
    many = len(names)
    common, rest = split(model, arrays_bytes // (8 + 4 * many + 4))
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def score(batches):
        known = shared.value
        sums = lambda x, b: np.diff(np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])[b], axis=0)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                buf, off = strings(piece["text"], lower=True)
                starts, ends, before = spans(buf, off, NOT_SPACE)
                total, size = np.zeros((piece.num_rows, many)), np.zeros(piece.num_rows, np.int64)
                rare, hold = pa.array([[]] * piece.num_rows, RARE), np.zeros(0, np.int64)
                if len(starts):
                    words, which = distinct_words(buf, starts, ends)
                    line = Line(words, order)
                    gram = line.grams(order)
                    place = known.places(gram)
                    there = place >= 0
                    value = known.values[np.maximum(place, 0)] * there[:, None] if there.any() else np.zeros((len(gram), many))
                    total = sums(sums(value, line.before)[which], before)
                    size = np.diff(np.append(0, np.cumsum(np.diff(line.before)[which]))[before])
                    hold = np.flatnonzero(~there)
                if len(hold):
                    # the grams that aren't in the arrays, of each document: those of its words, word by word
                    first = np.searchsorted(hold, line.before)
                    count = np.diff(first)[which]
                    own = np.repeat(np.repeat(np.arange(piece.num_rows), np.diff(before)), count)
                    at = np.arange(len(own)) + np.repeat(first[which] - (np.cumsum(count) - count), count)
                    names_, at = np.unique(gram[hold[at]], return_inverse=True)
                    pair, n = np.unique(own * len(names_) + at, return_counts=True)
                    rows = pa.StructArray.from_arrays([pa.array(signed(names_[pair % len(names_)])), pa.array(n)], names=["g", "n"])
                    rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair // len(names_), np.arange(piece.num_rows + 1)).astype(np.int32)), rows)
                flat = pa.ListArray.from_arrays(pa.array((np.arange(piece.num_rows + 1) * many).astype(np.int32)), pa.array(total.reshape(-1)))
                yield pa.record_batch({"row": piece["row"], "doc_id": piece["doc_id"], "lang": piece["lang"], "held": piece["held"], "sums": flat, "chars": pa.array(size), "rare": rare})

    schema = "row long, doc_id long, lang string, held boolean, sums array<double>, chars long, rare array<struct<g: long, n: long>>"
    part = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, schema).checkpoint()
    extra = part.select("row", F.inline("rare")).join(rest.select("g", "x"), "g").groupBy("row").agg(F.array(*[F.sum(F.col("x")[j] * F.col("n")) for j in range(many)]).alias("extra"))
    total = part.join(extra, "row", "left").select("doc_id", "lang", "held", "chars", F.coalesce(F.zip_with("sums", "extra", lambda x, y: x + y), F.col("sums")).alias("sums"))
    bits = F.zip_with("sums", F.array(*[F.lit(n) for n in names]), lambda s, name: F.struct((-s / F.col("chars") / math.log(2)).alias("bits"), name.alias("name")))
    total = total.withColumn("best", F.when(F.col("chars") > 0, F.array_sort(bits)))
    margin = F.col("best")[1]["bits"] - F.col("best")[0]["bits"] if many > 1 else F.lit(None).cast("double")
    return total.select("doc_id", "lang", "held", F.col("best")[0]["name"].alias("language"), F.col("best")[0]["bits"].alias("bits"), margin.alias("margin"), "chars")


RARE = pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())]))


def limits(found: DataFrame, spread: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """limit by language and size, where there are enough documents; centre by language; shift, width and usual number of characters of all."""
    right, held = found.where("lang = language"), found.where("held and lang = language")
    q = lambda c: F.percentile_approx(c, F.array(F.lit(0.5), F.lit(0.75)), 10000)
    fine = held.groupBy("language", "size").agg(q("bits").alias("q"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    centre = right.groupBy("language").agg(q("bits")[0].alias("centre"))
    whole = held.join(F.broadcast(centre), "language").agg(q(F.col("bits") - F.col("centre")).alias("q"), F.percentile_approx("chars", 0.5, 10000).alias("usual"))
    width = (spread * (F.col("q")[1] - F.col("q")[0])).alias("width")
    return fine.select("language", "size", (F.col("q")[0] + width).alias("limit")), centre, whole.select(F.col("q")[0].alias("shift"), width, "usual")


def identified(docs: DataFrame, order: int = ORDER, spread: float = SPREAD, folds: int = FOLDS, least: int = LEAST, arrays_bytes: int = ARRAYS_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, language, bits a character, margin to the second language, and accepted."""
    ready(docs.sparkSession)
    docs = documents(docs, id_col, text_col, **{lang_col: "lang"}).withColumn("held", F.coalesce(F.pmod(F.xxhash64("text"), F.lit(folds)) == folds - 1, F.lit(False)))
    names = [r["lang"] for r in docs.where("lang is not null and text is not null").select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return docs.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("bits"), F.lit(None).cast("double").alias("margin"), F.lit(False).alias("accepted"))
    model = train(docs.select("text", F.when(~F.col("held"), F.col("lang")).alias("lang")), names, order)
    found = scores(docs, model, names, order, arrays_bytes).withColumn("size", F.floor(F.log(4.0, F.greatest("chars", F.lit(1))))).checkpoint()
    fine, centre, whole = limits(found, spread, least)
    shift, width, usual = whole.first()
    # a row for each language and power of four, at most
    out = found.join(F.broadcast(fine), ["language", "size"], "left").join(F.broadcast(centre), "language", "left")
    wide = F.col("centre") + F.lit(shift) + F.lit(width) * F.greatest(F.lit(1.0), F.sqrt(F.lit(usual) / F.col("chars")))
    return out.select("doc_id", "language", "bits", "margin", F.coalesce(F.col("bits") <= F.coalesce("limit", wide) + 1e-9, F.lit(False)).alias("accepted"))
