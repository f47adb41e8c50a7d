"""Repeated passages: hashed units, grouped globally; the earliest ranked occurrence stays.

Units are normalised (letters, digits and underlines in lower case, nothing else counts). Every line that has a
word is a unit as a whole, however short. As passages are also pasted into the middle of lines, where hashing lines can't find them, so are
windows of WORDS consecutive words: of every REACH windows in a row the ones with the least hash are taken, so each
passage of WORDS + REACH - 1 words (50) or more that occurs twice has a unit in common, at most REACH - 1 words from
either end, wherever it stands; shorter passages inside lines are found only by chance. Digests are grouped over the whole table; the earliest occurrence, by doc_id and
offset, stays and the others are removed. Overlapping removals are joined into spans. A span that begins or ends with a window
is extended, by up to REACH - 1 words, as long as its words equal those beside the occurrence that stays.

Defined cases: a row whose doc_id or text is null, and a text without words, has no spans. Rows that repeat
an id are one document; where their texts differ around a span's end, it isn't extended. A passage that repeats within a document loses its later occurrence; where that overlaps the
first, the first is kept whole. Offsets count characters of the original text from 0. Extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import U64, WORD, char_index, documents, hashes, member, membership, mix, owners, pieces, ready, signed, spans, strings

WORDS = 40
REACH = 11
BITMAP_BITS = 28
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), U64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U64(pow(base, k, 1 << 64))
        k += m
    return out


def units(piece: pa.RecordBatch, text: str, words: int, reach: int):
    """(hash, document, first character, end) of the lines and chosen windows of a piece; hashes of lines are odd, those of windows even."""
    buf, off = strings(piece[text], lower=True)
    starts, ends, before = spans(buf, off, WORD)
    n, own = len(starts), owners(before)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U64), empty, empty, empty
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes(buf, starts, ends) * powers(BASE, n), out=total[1:])
    back = powers(INVERSE, n)
    m = max(0, n - words + 1)
    window = mix((total[words:] - total[:m]) * back[:m]) if m else np.zeros(0, U64)
    inside = own[:m] == own[words - 1 :][:m]
    last = np.zeros(m, U64)
    k = m - reach + 1
    if k > 0:
        least = window[:k].copy()
        for i in range(1, reach):
            np.minimum(least, window[i : i + k], out=least)
        least[~(inside[:k] & (own[:k] == own[reach + words - 2 :]))] = 0
        for i in range(reach):
            np.maximum(last[i : i + k], least, out=last[i : i + k])
    at = np.flatnonzero((last == window) & inside)
    cuts = np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1])
    line = np.unique(np.searchsorted(starts, np.sort(cuts)))
    line = np.append(line[line < n], n)
    a, b = line[:-1], line[1:]
    digest = mix((total[b] - total[a]) * back[a] + U64(1))
    char = char_index(buf)
    first, end = np.concatenate([at, a]), np.concatenate([at + words, b]) - 1
    doc = own[first]
    base = char[off[:-1]][doc]
    return np.concatenate([window[at] & ~U64(1), digest | U64(1)]), doc, char[starts[first]] - base, char[ends[end]] - base


def contexts(docs: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """doc_id, at, left, and up to that many words before (left) or behind each point, from the nearest on: their text and outer edges."""

    def read(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                buf, off = strings(piece["text"], lower=True)
                starts, ends, before = spans(buf, off, WORD)
                char, rows = char_index(buf), []
                for k, (i, asked) in enumerate(zip(piece["doc_id"].to_pylist(), piece["points"].to_pylist())):
                    a, b, base = before[k], before[k + 1], char[off[k]]
                    for p in asked:
                        j = a + int(np.searchsorted(char[starts[a:b]] - base, p["at"]))
                        near = np.arange(j - 1, max(a, j - most) - 1, -1) if p["left"] else np.arange(j, min(b, j + most))
                        edge = char[(starts if p["left"] else ends)[near]] - base
                        rows.append((i, p["at"], p["left"], [buf[starts[x] : ends[x]].tobytes() for x in near], edge.tolist()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "at", "left", "words", "edges"])

    asked = points.groupBy("doc_id").agg(F.collect_set(F.struct("at", "left")).alias("points"))
    found = docs.join(asked, "doc_id").select("doc_id", "text", "points").mapInArrow(read, "doc_id long, at long, left boolean, words array<binary>, edges array<long>")
    found = found.groupBy("doc_id", "at", "left").agg(F.collect_set(F.struct("words", "edges")).alias("found")).where(F.size("found") == 1)
    return found.select("doc_id", "at", "left", F.col("found")[0]["words"].alias("words"), F.col("found")[0]["edges"].alias("edges"))


def islands(rows: DataFrame) -> DataFrame:
    """Numbers the groups of overlapping spans of each document."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    rows = rows.withColumn("reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reached"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def extended(docs: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """The spans, made longer at ends that are windows by the words that equal those beside the kept occurrence."""
    head, tail = F.col("head.start") == F.col("start"), F.col("tail.end") == F.col("end")
    ends = [(head, "doc_id", "start", True), (head, "head.kept_doc_id", "head.kept_start", True), (tail, "doc_id", "end", False), (tail, "tail.kept_doc_id", "tail.kept_end", False)]
    points = [found.where(on).select(F.col(i).alias("doc_id"), F.col(at).alias("at"), F.lit(left).alias("left")) for on, i, at, left in ends]
    near = contexts(docs, points[0].union(points[1]).union(points[2]).union(points[3]), most).checkpoint()
    for k, (on, i, at, left) in enumerate(ends):
        side = near.where(F.col("left") == F.lit(left)).select(F.col("doc_id").alias("i"), F.col("at").alias("p"), F.col("words").alias(f"w{k}"), F.col("edges").alias(f"e{k}"))
        found = found.join(side, on & (F.col(i) == F.col("i")) & (F.col(at) == F.col("p")), "left").drop("i", "p")

    def same(a, b):  # how many words are equal
        alike = [(F.size(a) >= n) & (F.size(b) >= n) & (F.slice(a, 1, n) == F.slice(b, 1, n)) for n in range(1, most + 1)]
        return sum((F.coalesce(x, F.lit(False)).cast("int") for x in alike), F.lit(0))

    found = found.withColumn("before", same("w0", "w1")).withColumn("behind", same("w2", "w3"))
    start = F.when(F.col("before") > 0, F.element_at("e0", F.greatest("before", F.lit(1)))).otherwise(F.col("start"))
    start = F.when(F.col("doc_id") == F.col("head.kept_doc_id"), F.greatest(start, F.least("start", "head.kept_end"))).otherwise(start)
    end = F.when(F.col("behind") > 0, F.element_at("e2", F.greatest("behind", F.lit(1)))).otherwise(F.col("end"))
    moved = F.when(F.col("before") > 0, F.struct(F.col("head.kept_doc_id").alias("kept_doc_id"), F.element_at("e1", F.greatest("before", F.lit(1))).alias("kept_start")))
    kept = F.coalesce(moved, F.struct(F.col("kept.kept_doc_id").alias("kept_doc_id"), F.col("kept.kept_start").alias("kept_start")))
    return found.select("doc_id", start.alias("start"), end.alias("end"), kept.alias("kept"), "units")


def repeated_spans(docs: DataFrame, words: int = WORDS, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans to remove: doc_id, start, end (characters of the text), kept_doc_id and kept_start of the occurrence that stays, units found in it."""
    ready(docs.sparkSession)
    docs = documents(docs, id_col, text_col).where("doc_id is not null and text is not null")

    def digests(batches, repeated=None):
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, doc, first, end = units(piece, "text", words, reach)
                if repeated is not None:
                    some = np.flatnonzero(member(repeated.value, h))
                    h, doc, first, end = h[some], doc[some], first[some], end[some]
                if len(h):
                    yield pa.record_batch({"h": pa.array(signed(h)), "doc_id": piece["doc_id"].take(pa.array(doc)), "span": pa.array(first << 32 | end)})

    shape = "h long, doc_id long, span long"
    # partial aggregation leaves one row a task of a line that is everywhere; the join back splits its rows where they are many
    kept = docs.mapInArrow(digests, shape).groupBy("h").agg(F.min(F.struct("doc_id", "span")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = kept.select("h", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.span").alias("kept")).checkpoint()
    repeated = docs.sparkSession.sparkContext.broadcast(membership(kept, "h", BITMAP_BITS))
    later = docs.mapInArrow(lambda batches: digests(batches, repeated), shape).join(kept, "h").select((F.col("h").bitwiseAND(F.lit(1)) == 0).alias("window"), "doc_id", "span", "kept_doc_id", "kept")
    later = later.where((F.col("doc_id") != F.col("kept_doc_id")) | (F.col("span") != F.col("kept")))
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    start = F.when(F.col("doc_id") == F.col("kept_doc_id"), F.greatest(F.shiftright("span", 32), low("kept"))).otherwise(F.shiftright("span", 32))
    later = later.select("window", "doc_id", start.alias("start"), (start == F.shiftright("span", 32)).alias("whole"), low("span").alias("end"), "kept_doc_id", F.shiftright("kept", 32).alias("kept_start"), low("kept").alias("kept_end")).where("start < end")
    head = F.min(F.when(F.col("window") & F.col("whole"), F.struct("start", "kept_doc_id", "kept_start", "kept_end"))).alias("head")
    tail = F.max(F.when(F.col("window"), F.struct("end", "kept_doc_id", "kept_end"))).alias("tail")
    out = islands(later).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kept_doc_id", "kept_start")).alias("kept"), head, tail, F.count(F.lit(1)).alias("units"))
    out = islands(extended(docs, out.checkpoint(), reach - 1)).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kept")).alias("first"), F.sum("units").alias("units"))
    return out.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "first.kept.kept_doc_id", F.col("first.kept.kept_start").cast("int").alias("kept_start"), "units")
