"""Benchmark decontamination by SimHash of item-sized windows.

Documents and items are sequences of words (letters, digits and underlines in lower case). A window has as many words
as an item has, or is the whole document where that is shorter. Its runs of SHINGLE words are weighted by their
rarity among the items, in whole sixteenths of ln(1 + items / items with it); runs that no item has count as those of one
item. The weighted shingles of a window vote on the 64 bits of its SimHash. Fingerprints are cut into BLOCKS blocks;
two within RADIUS bits agree in one block up to RADIUS // BLOCKS bits, so looking a window's blocks up among all
values near those of the items finds every item within the radius. Candidates are verified by their exact weighted
Jaccard similarity of shingles, counted with repetition, which must reach THRESHOLD.

Only windows that can pass are fingerprinted: one whose shingles known from items weigh too little for the threshold
with any item of its size is left out, which never loses a result. The index of the items is a broadcast of bounded
size: a benchmark of more than SLICE_ITEMS items, or SLICE_SHINGLES shingles in all, takes a pass over the documents for
each slice of it. Items of fewer than SHINGLE words have no shingle; they are searched as phrases, word for word.

Defined cases: a row whose doc_id or text is null, and a text without words, has no leak. Items with null id or text and
items without words match nothing; an item of one or two words matches wherever it stands (leave such items out of the
benchmark if they are no evidence); repeated items count once. Several rows of an id are searched each and give one result for each item, that of the greatest similarity, then
of the least offset, which also breaks ties within a text. Without documents or items the result is empty. Extra
columns are left alone.
"""

from __future__ import annotations

import sys
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, WORD, char_index, documents, filtered, hashes, integer_id, mix, owners, pieces, quoted, ready, spans, strings

SHINGLE = 3
THRESHOLD = 0.6
RADIUS = 19
BLOCKS = 5
SLICE_ITEMS = 4000
SLICE_SHINGLES = 1_000_000
SCALE = 16


def block_bits(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block of 64 bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def near_masks(bits: int, most: int) -> np.ndarray:
    """All patterns of at most so many ones."""
    return np.array([sum(1 << b for b in c) for k in range(min(most, bits) + 1) for c in combinations(range(bits), k)], U64)


def shingle_words(column: pa.Array, n: int):
    """(start of each text, starts and ends of words, words before each text, hash of the shingle at each word, whether there is one, text of each word, bytes)."""
    buf, off = strings(column, lower=True)
    starts, ends, before = spans(buf, off, WORD)
    words, own = hashes(buf, starts, ends), owners(before)
    m = max(0, len(words) - n + 1)
    inside = own[:m] == own[n - 1 : n - 1 + m]
    return off, starts, ends, before, runs(words, n), inside, own, buf


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, U64)
    for k in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) ^ words[k : k + m])
    return out


class Index:
    """The items of a slice, ready for look-ups."""

    def __init__(self, lengths: np.ndarray, shingles: np.ndarray, before: np.ndarray, known: np.ndarray, weight: np.ndarray, unknown: int, radius: int, blocks: int):
        self.lengths, self.known, self.weight, self.unknown, self.radius = lengths, known, weight, unknown, radius
        n = len(lengths)
        own = np.repeat(np.arange(n), np.diff(before))
        at = np.searchsorted(known, shingles)
        self.total = np.bincount(own, weight[at], n).astype(np.int64)
        self.print = simhash(shingles, weight[at], before[:-1], before[1:])
        pair, count = np.unique(own * len(known) + at, return_counts=True)
        self.pair, self.count = pair, count
        back = np.argsort(pair % len(known), kind="stable")
        self.item_of = (pair // len(known))[back]
        self.items_before = np.searchsorted((pair % len(known))[back], np.arange(len(known) + 1))
        self.least = np.full(int(lengths.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(self.least, lengths, self.total)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(known >> U64(48)).astype(np.int64)] = True
        self.blocks = []
        for first, bits in block_bits(blocks):
            value = self.print >> U64(first) & U64((1 << bits) - 1)
            near = (value[:, None] ^ near_masks(bits, radius // blocks)[None, :]).astype(np.int64)
            key = (near << 32 | lengths[:, None]).reshape(-1)
            order = np.argsort(key, kind="stable")
            self.blocks.append((first, bits, key[order], np.repeat(np.arange(n), near.shape[1])[order]))

    def find(self, shingles: np.ndarray) -> np.ndarray:
        """The place of each shingle among the known ones, or -1."""
        out = np.full(len(shingles), -1, np.int64)
        some = np.flatnonzero(self.gate[(shingles >> U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, shingles[some]), len(self.known) - 1)
        right = self.known[at] == shingles[some]
        out[some[right]] = at[right]
        return out

    def candidates(self, prints: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of the window's length within the radius of its fingerprint."""
        found = []
        for first, bits, key, item in self.blocks:
            want = (prints >> U64(first) & U64((1 << bits) - 1)).astype(np.int64) << 32 | lengths
            a, b = np.searchsorted(key, want), np.searchsorted(key, want, "right")
            window = np.repeat(np.arange(len(want)), b - a)
            place = np.arange(len(window)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            found.append(window * len(self.lengths) + item[place])
        both = np.unique(np.concatenate(found))
        window, item = both // len(self.lengths), both % len(self.lengths)
        near = np.bitwise_count(prints[window] ^ self.print[item]) <= self.radius
        return window[near], item[near]


def simhash(shingles: np.ndarray, weight: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of shingles; a bit is set if the weight for it is greater than that against it."""
    out = np.zeros(len(first), U64)
    total = np.zeros(len(shingles) + 1, np.int64)
    for bit in range(64):
        np.cumsum(np.where(shingles >> U64(bit) & U64(1), weight, -weight), out=total[1:])
        out |= (total[end] > total[first]).astype(U64) << U64(bit)
    return out


def weights(frequency: np.ndarray, items: int) -> np.ndarray:
    return np.maximum(1, np.rint(SCALE * np.log1p(items / frequency))).astype(np.int64)


def leaks_in(column: pa.Array, index: Index, n: int, threshold: float):
    """(text, item, first character, end, similarity, distance) of the best window of each text and item."""
    off, starts, ends, before, gram, inside, own, buf = shingle_words(column, n)
    empty = np.zeros(0, np.int64)
    nothing = (empty, empty, empty, empty, np.zeros(0), empty)
    valid = np.flatnonzero(inside)
    place = np.full(len(gram), -1, np.int64)
    place[valid] = index.find(gram[valid])
    hit = np.flatnonzero(place >= 0)
    if not len(hit):
        return nothing
    # which items a text may hold at all: the shingles it shares with them must weigh enough
    a, b = index.items_before[place[hit]], index.items_before[place[hit] + 1]
    who = np.repeat(np.arange(len(hit)), b - a)
    item = index.item_of[np.arange(len(who)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
    pair, at = np.unique(own[hit[who]] * len(index.lengths) + item, return_inverse=True)
    held = np.bincount(at, index.weight[place[hit[who]]], len(pair))
    pair = pair[held >= threshold * index.total[pair % len(index.lengths)] - 1e-9]
    if not len(pair):
        return nothing
    most = len(index.least)
    todo = np.unique(pair // len(index.lengths) * most + index.lengths[pair % len(index.lengths)])
    text, length = todo // most, todo % most
    # all windows of these texts and lengths
    words = np.diff(before)[text]
    count = np.maximum(1, words - length + 1)
    of = np.repeat(np.arange(len(todo)), count)
    first = before[text][of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
    size = length[of]
    last = first + np.minimum(size, words[of]) - n + 1  # behind its last shingle
    weight = np.where(place >= 0, index.weight[place], index.unknown) * inside
    known, every = np.append(0, np.cumsum(weight * (place >= 0))), np.append(0, np.cumsum(weight))
    has, total = known[last] - known[first], every[last] - every[first]
    least = index.least[size]
    able = np.flatnonzero(has * (1 + threshold) >= threshold * (total + least) - 1e-6)
    if not len(able):
        return nothing
    of, first, size, last, has, total = of[able], first[able], size[able], last[able], has[able], total[able]
    # fingerprints, over the words of these texts alone
    mine = np.unique(text[of])
    begin, stop = before[mine], np.minimum(before[mine + 1], len(gram))
    move = np.append(0, np.cumsum(stop - begin))
    pick = np.repeat(begin - move[:-1], stop - begin) + np.arange(move[-1])
    shift = (begin - move[:-1])[np.searchsorted(mine, text[of])]
    prints = simhash(gram[pick], weight[pick], first - shift, last - shift)
    window, item = index.candidates(prints, size)
    if not len(window):
        return nothing
    bound = np.minimum(has[window], index.total[item])
    bound = bound / (total[window] + index.total[item] - bound)
    good = bound >= threshold - 1e-9
    window, item, bound = window[good], item[good], bound[good]
    group = text[of[window]] * len(index.lengths) + item
    score = np.full(len(window), -1.0)
    names, which = np.unique(group, return_inverse=True)
    order = np.lexsort((first[window], -bound, which))
    head = order[np.r_[True, which[order][1:] != which[order][:-1]]] if len(order) else order
    best = np.full(len(names), threshold - 1e-9)
    for rest in (head, None):
        if rest is None:
            rest = np.flatnonzero((score < 0) & (bound >= best[which] - 1e-12))
        score[rest] = similarities(index, place, total, first, last, window[rest], item[rest])
        np.maximum.at(best, which[rest], score[rest])
    order = np.lexsort((first[window], -score, which))
    order = order[np.r_[True, which[order][1:] != which[order][:-1]]] if len(order) else order
    order = order[score[order] >= threshold - 1e-9]
    window, item, score = window[order], item[order], score[order]
    char = char_index(buf)
    doc = text[of[window]]
    base = char[off[:-1]][doc]
    return doc, item, char[starts[first[window]]] - base, char[ends[last[window] + n - 2]] - base, score, np.bitwise_count(prints[window] ^ index.print[item]).astype(np.int64)


def phrases_in(column: pa.Array, phrases: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(text, item, first character, end, 1, 0) of the first place of each phrase in each text; phrases has sorted hashes and items by number of words."""
    buf, off = strings(column, lower=True)
    starts, ends, before = spans(buf, off, WORD)
    words, own, char = hashes(buf, starts, ends), owners(before), char_index(buf)
    out = []
    for m, (known, item) in phrases.items():
        gram = runs(words, m)
        low, high = np.searchsorted(known, gram), np.searchsorted(known, gram, "right")
        at = np.flatnonzero((high > low) & (own[: len(gram)] == own[m - 1 : m - 1 + len(gram)]))
        count = (high - low)[at]
        place = np.repeat(at, count)
        which = item[np.arange(len(place)) + np.repeat(low[at] - (np.cumsum(count) - count), count)]
        _, first = np.unique(np.stack([own[place], which]), axis=1, return_index=True) if len(place) else (None, np.zeros(0, np.int64))
        place, which = place[first], which[first]
        base = char[off[:-1]][own[place]]
        out.append((own[place], which, char[starts[place]] - base, char[ends[place + m - 1]] - base, np.ones(len(place)), np.zeros(len(place), np.int64)))
    return out


def similarities(index: Index, place, total, first, last, window, item) -> np.ndarray:
    """Weighted Jaccard similarity of each window with its item."""
    size = (last - first)[window]
    which = np.repeat(np.arange(len(window)), size)
    at = place[np.repeat(first[window] - (np.cumsum(size) - size), size) + np.arange(len(which))]
    which, at = which[at >= 0], at[at >= 0]
    pair, count = np.unique(which * len(index.known) + at, return_counts=True)
    which, at = pair // len(index.known), pair % len(index.known)
    want = item[which] * len(index.known) + at
    there = np.minimum(np.searchsorted(index.pair, want), len(index.pair) - 1)
    both = np.where(index.pair[there] == want, np.minimum(count, index.count[there]), 0) * index.weight[at]
    shared = np.bincount(which, both, len(window))
    return shared / (total[window] + index.total[item] - shared)


def _kept(key, make):
    """Kept by the worker process, as it is larger than what it is made of."""
    kept = sys.__dict__.setdefault("_kept_leak_index", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def slices(benchmark: DataFrame, n: int, slice_items: int, slice_shingles: int, id_col: str, text_col: str):
    """The item ids, what an Index is made of (None without items of n words) and the short items as phrases, for each slice of the benchmark."""
    items = benchmark.select(integer_id(benchmark, id_col).alias("item_id"), quoted(text_col).alias("text")).where("item_id is not null and text is not null").distinct()

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, starts, ends, before, gram, inside, own, buf = shingle_words(piece["text"], n)
                gram, own = gram[inside], own[: len(gram)][inside]
                words, all_words = np.diff(before), hashes(buf, starts, ends)
                for m in range(1, n):
                    short = np.flatnonzero(words == m)
                    gram, own = np.append(gram, runs(all_words, m)[before[short]]), np.append(own, short)
                order = np.argsort(own, kind="stable")
                gram, own = gram[order], own[order]
                rows = np.searchsorted(own, np.arange(piece.num_rows + 1))
                ok = np.flatnonzero(words > 0)
                grams = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(gram.view(np.int64)))
                yield pa.record_batch({"item_id": piece["item_id"].take(pa.array(ok)), "words": pa.array(words[ok]), "grams": grams.take(pa.array(ok))})

    items = items.mapInArrow(cut, "item_id long, words long, grams array<long>").checkpoint()
    long = items.where(F.col("words") >= n)
    number = long.count()
    every = items.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("grams")).alias("shingles")).first()
    parts = max(-(-every["items"] // slice_items), -(-(every["shingles"] or 0) // slice_shingles))
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "grams"), F.lit(parts)) == k)
        rows = sorted(((r.item_id, r.words, list(r.grams)) for r in mine.collect()), key=lambda r: (r[1] < n, r[0], r[2]))
        phrases, ids = {}, np.array([r[0] for r in rows])
        for m in range(1, n):
            some = sorted((r[2][0] % (1 << 64), k) for k, r in enumerate(rows) if r[1] == m)
            if some:
                phrases[m] = np.array([h for h, _ in some], np.uint64), np.array([k for _, k in some], np.int64)
        rows = [r for r in rows if r[1] >= n]
        if not rows:
            if phrases:
                yield ids, None, phrases
            continue
        grams = long.select(F.explode(F.array_distinct("grams")).alias("g"))
        grams = grams.groupBy("g").count()
        if parts > 1:
            grams = grams.join(mine.select(F.explode("grams").alias("g")).distinct(), "g", "left_semi")
        frequency = grams.toArrow()
        known = frequency["g"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        weight = weights(frequency["count"].to_numpy()[order], number)
        before = np.append(0, np.cumsum([len(r[2]) for r in rows]))
        flat = np.concatenate([np.array(r[2], np.int64) for r in rows]).view(np.uint64)
        yield ids, (np.array([r[1] for r in rows], np.int64), flat, before, known[order], weight, int(weights(np.ones(1), number)[0])), phrases


def _searcher(spark, part, n, threshold, radius, blocks):
    shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

    def search(column: pa.Array):
        ids, made_of, phrases = shared.value
        found = phrases_in(column, phrases) if phrases else []
        if made_of is not None:
            found.append(leaks_in(column, _kept(name, lambda: Index(*made_of, radius, blocks)), n, threshold))
        doc, item, first, end, score, distance = (np.concatenate(c) for c in zip(*found))
        return doc, ids[item], first, end, score, distance

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_items: int = SLICE_ITEMS, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """doc_id, item_id, start and end (characters of the text) of the most similar window, its similarity and the distance of the fingerprints."""
    spark = ready(docs.sparkSession)
    docs = documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, start int, end int, similarity double, distance int"
    out = spark.createDataFrame([], schema)
    for part in slices(benchmark, n, slice_items, slice_shingles, item_col, item_text_col):
        search = _searcher(spark, part, n, threshold, radius, blocks)

        def found(batches, search=search):
            for batch in batches:
                for piece in pieces(batch, "text"):
                    doc, item, first, end, score, distance = search(piece["text"])
                    if len(doc):
                        yield pa.record_batch([piece["doc_id"].take(pa.array(doc)), pa.array(item), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(score), pa.array(distance.astype(np.int32))], names=["doc_id", "item_id", "start", "end", "similarity", "distance"])

        out = out.union(docs.mapInArrow(found, schema))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "end", "distance")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.start", "b.end", (-F.col("b.s")).alias("similarity"), "b.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS, n: int = SHINGLE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_items: int = SLICE_ITEMS, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """The documents without those that hold a leak, in all their columns; rows are judged one by one, so nothing is shuffled."""
    spark, out = ready(docs.sparkSession), docs
    for part in slices(benchmark, n, slice_items, slice_shingles, item_col, item_text_col):
        search = _searcher(spark, part, n, threshold, radius, blocks)

        def clean(column, search=search):
            ok = np.ones(len(column), bool)
            ok[search(column)[0]] = False
            return ok

        out = filtered(out, text_col, clean)
    return out
