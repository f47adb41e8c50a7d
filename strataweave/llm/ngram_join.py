"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word 3-grams (letters, digits and underlines in lower case; a document of one or two
words is one gram of them). Equal sets are one set. Grams are ordered by rarity, counted over the whole table. If the
prefixes of two sets are lengthened by l - 1 grams, similar sets share at least l grams in them: for each set the l of
least estimated cost is taken (grams looked up, times their counts, plus the verifications that their matches can
lead to at most), and only pairs with l shared prefix grams are verified, on their whole sets.

Thousands of near copies would make that many squared rows of the same few pairs, each repeated for every gram they
share. So each set also names two lead grams, its least under two random orders, by 32 bits. Sets with the same lead
are brought together once and compared there; the prefix join leaves such pairs out, which are nine in ten of those
that are similar at all. A lead that more than BLOCK sets, or sets of more than BLOCK_GRAMS grams in all, share isn't
used as a lead, so that a group's memory is bounded; these pairs stay in the prefix join. Both ways are exact.

Pairs aren't listed where they are found: each group counts the links of its sets and gives each set the least one it
is connected with, which is a row a set however many pairs there are. ``classes`` joins these into one row a document;
``similar_pairs`` lists the pairs themselves, for those who ask for them.

Defined cases: rows whose doc_id is null have no row. Null texts and texts without words match nothing: their class is
their own. Rows that repeat an id and a text count once; several texts of one id belong to one document, whose copies
and links are added up, and never relate it to itself. Extra columns are left alone. Grams and sets are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import (
    U64, WORD, Seen, counts_sketch, documents, free, hashes, integer_id, lists, member, membership, mix, ngrams, pieces, rarity, ready,
    set_keys, signed, spans, strings, unique_by_owner,
)

N = 3
THRESHOLD = 0.7
MOST_MATCHES = 4
VERIFY_COST = 8.0
BLOCK = 4000
BLOCK_GRAMS = 4_000_000
TOGETHER = 1000
SKETCH_BITS = 20
BITMAP_BITS = 28


def grams(piece: pa.RecordBatch, text: str, n: int):
    buf, off = strings(piece[text], lower=True)
    starts, ends, before = spans(buf, off, WORD)
    return ngrams(hashes(buf, starts, ends), before, n)


def gram_sets(piece: pa.RecordBatch, text: str, n: int, ranks: np.ndarray):
    """(grams of each document without repetition by rarity, their ranks, grams before each document)."""
    gram, own = grams(piece, text, n)
    gram, own, rank = unique_by_owner(gram, own, ranks[(gram >> U64(64 - len(ranks).bit_length() + 1)).astype(np.int64)])
    return gram, rank, np.searchsorted(own, np.arange(piece.num_rows + 1))


def prefix_lengths(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets that look up others of their size or smaller, and of the sets that are looked up."""
    look = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    index = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
    return np.where(n > 0, look, 0), np.where(n > 0, index, 0)


def matches(n: np.ndarray, before: np.ndarray, look: np.ndarray, cost: np.ndarray, threshold: float, most: int, verify: float) -> np.ndarray:
    """For each set the number of shared prefix grams to ask for: that with the least estimated cost."""
    total = np.append(0.0, np.cumsum(cost))
    best, ell = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for l in range(1, most + 1):
        looked = total[before[:-1] + np.minimum(look + l - 1, n)] - total[before[:-1]]
        now = np.where((l == 1) | (l <= threshold * n / 2), looked * (1 + verify / l), np.inf)
        ell, best = np.where(now < best, l, ell), np.minimum(now, best)
    return ell


def leads(gram: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of all grams of each set under two random orders, by the upper 32 bits and never 0: two sets share each with the probability of their similarity."""
    some = np.flatnonzero(np.diff(before))
    out = np.zeros((2, len(before) - 1), U64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)):
        if len(some):
            out[k, some] = np.minimum.reduceat(mix(gram ^ U64(salt)), before[some])
    out = np.maximum(mix(out) >> U64(32), U64(1)) << U64(32)
    return out[0], out[1]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n is connected with."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


PAIRS, LINKS = "sa long, sb long, jaccard double", "s long, label long, links long"


def told(s: np.ndarray, a: np.ndarray, b: np.ndarray, jaccard: np.ndarray, listed: bool) -> pa.Table:
    """What a group says of its similar pairs (places in s, which ascends): the pairs, or each set's least connected set and its number of links."""
    if listed:
        return pa.table({"sa": pa.array(s[a]), "sb": pa.array(s[b]), "jaccard": pa.array(jaccard)})
    links, label = np.bincount(a, minlength=len(s)) + np.bincount(b, minlength=len(s)), components(len(s), a, b)
    some = links > 0
    return pa.table({"s": pa.array(s[some]), "label": pa.array(s[label[some]]), "links": pa.array(links[some])})


def verified(pairs: DataFrame, met: DataFrame, full: DataFrame, threshold: float, listed: bool) -> DataFrame:
    """What is to be told of the similar ones of the pairs (sa, sb); full has the grams of each set s, met pairs found before.

    Sets of a crowd of near copies have hundreds of partners each. So that their grams aren't sent once a pair, sets
    are named after the least set they meet, which is much the same throughout a crowd, and the pairs of two names are
    verified together, in blocks of TOGETHER sets.
    """
    both = lambda df: df.select(F.inline(F.array(F.struct(F.col("sa").alias("s"), F.col("sb").alias("o")), F.struct(F.col("sb").alias("s"), F.col("sa").alias("o")))))
    name = both(pairs.union(met)).groupBy("s").agg(F.least(F.first("s"), F.min("o")).alias("name"))
    named = pairs.join(name.select(F.col("s").alias("sa"), F.col("name").alias("na")), "sa").join(name.select(F.col("s").alias("sb"), F.col("name").alias("nb")), "sb")
    named = named.select("sa", "sb", F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb")).checkpoint()
    size = named.select("na", "nb", F.explode(F.array("sa", "sb")).alias("s")).distinct().groupBy("na", "nb").count()
    parts = F.ceil(F.col("count") / F.lit(TOGETHER))
    block = named.join(size, ["na", "nb"]).select("sa", "sb", F.xxhash64("na", "nb", F.pmod(F.xxhash64("sa"), parts), F.pmod(F.xxhash64("sb"), parts)).alias("block"))
    total = size.agg(F.sum("count")).first()[0] or 0
    block = block.select(F.pmod("block", F.lit(total // TOGETHER + 1)).alias("block"), "sa", "sb")
    sets = block.select("block", F.explode(F.array("sa", "sb")).alias("s")).distinct().join(full, "s").select("block", "s", "grams")

    def check(left, right):
        s = left["s"].to_numpy()
        order = np.argsort(s)
        s, grams = s[order], left["grams"].combine_chunks().take(pa.array(order))
        size = np.diff(grams.offsets.to_numpy()) if len(s) else np.zeros(0, np.int64)
        names, flat = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        start = np.append(0, np.cumsum(size)).astype(np.int64)
        a, b = np.searchsorted(s, right["sa"].to_numpy()), np.searchsorted(s, right["sb"].to_numpy())
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        shared, on = np.zeros(len(a), np.int64), np.zeros(len(names), np.uint8)
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        for i, j in zip(cuts, np.r_[cuts[1:], len(a)]):
            mine, width = flat[start[a[i]] : start[a[i] + 1]], size[b[i:j]].astype(np.int64)
            on[mine] = 1
            first = np.cumsum(width) - width
            at = np.repeat(start[b[i:j]] - first, width) + np.arange(width.sum())
            shared[i:j] = np.add.reduceat(on[flat[at]], first, dtype=np.int64)
            on[mine] = 0
        j = shared / (size[a] + size[b] - shared)
        hit = j >= threshold - 1e-9
        return told(s, a[hit], b[hit], j[hit], listed)

    linked = block.select(F.col("block").alias("place"), "sa", "sb")
    return sets.groupBy("block").cogroup(linked.groupBy("place")).applyInArrow(check, PAIRS if listed else LINKS)


def similar_sets(docs: DataFrame, threshold: float, n: int, most: int, verify: float, block: int, block_grams: int, sketch_bits: int, bitmap_bits: int, listed: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id and its set s for each document; sa, sb and jaccard of the pairs of different similar sets, or s, label and links, a row for each group)."""
    spark = ready(docs.sparkSession)
    share = spark.sparkContext.broadcast
    counts = counts_sketch(docs, "text", lambda p: grams(p, "text", n)[0], sketch_bits)
    usual = float(np.median(counts))
    ranks, price = share(rarity(counts)), share(np.maximum(1.0, 2 ** (np.arange(256) / 2) - usual))

    def heads(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                gram, _, before = gram_sets(piece, "text", n, ranks.value)
                size = np.diff(before)
                use = np.flatnonzero(size > 0)
                one, two = leads(gram, before)
                yield pa.record_batch({"doc_id": piece["doc_id"].take(pa.array(use)), "s": pa.array(signed(set_keys(gram, before)[use])), "one": pa.array(signed(one[use])), "two": pa.array(signed(two[use])), "size": pa.array(size[use])})

    head = docs.mapInArrow(heads, "doc_id long, s long, one long, two long, size long").checkpoint()
    sets = head.select("s", "one", "two", "size").distinct()
    by = lambda which, lead: sets.groupBy(F.lit(which).alias("which"), F.col(lead).alias("lead")).agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("grams"))
    crowd = by(1, "one").union(by(2, "two")).where("count > 1").withColumn("over", (F.col("count") > block) | (F.col("grams") > block_grams)).checkpoint()
    over = {w: share(np.sort(np.array([r.lead for r in crowd.where((F.col("which") == w) & F.col("over")).select("lead").collect()], np.int64).view(U64))) for w in (1, 2)}
    held = {w: share(membership(crowd.where((F.col("which") == w) & ~F.col("over")), "lead", bitmap_bits)) for w in (1, 2)}

    def usable(lead, w):
        """The lead, or 0 if too many share it."""
        return np.where(np.isin(lead, over[w].value), U64(0), lead)

    def whole(batches, w):
        seen = Seen()
        for batch in batches:
            for piece in pieces(batch, "text"):
                gram, _, before = gram_sets(piece, "text", n, ranks.value)
                size, key = np.diff(before), set_keys(gram, before)
                one, two = leads(gram, before)
                own = (one, two)[w - 1]
                at = np.flatnonzero((size > 0) & member(held[w].value, own) & ~np.isin(own, over[w].value))
                at = at[seen.new(key[at])]
                yield pa.record_batch({"lead": pa.array(signed(own[at])), "s": pa.array(signed(key[at])), "one": pa.array(signed(usable(one, 1)[at])), "grams": lists(signed(gram), before).take(pa.array(at))})

    def compare(w):
        def run(key, table):
            s = table["s"].to_numpy()
            first = np.unique(s, return_index=True)[1]
            table = table.take(pa.array(first))
            s, one, size = table["s"].to_numpy(), table["one"].to_numpy(), table["grams"].combine_chunks().value_lengths().to_numpy()
            order = np.argsort(size, kind="stable")
            rows = table["grams"].combine_chunks().take(pa.array(order))
            size, name = size[order].astype(np.int64), one[order]
            grams, flat = np.unique(rows.flatten().to_numpy(), return_inverse=True)
            start, on = np.append(0, np.cumsum(size)), np.zeros(len(grams), np.uint8)
            links, label = np.zeros(len(s), np.int64), np.arange(len(s))
            out = ([], [], [])
            for x in range(1, len(s)):
                y0 = int(np.searchsorted(size, threshold * size[x] - 1e-9))
                if y0 >= x:
                    continue
                mine = flat[start[x] : start[x + 1]]
                on[mine] = 1
                got = np.add.reduceat(on[flat[start[y0] : start[x]]], start[y0:x] - start[y0], dtype=np.int64)
                on[mine] = 0
                j = got / (size[x] + size[y0:x] - got)
                new = (j >= threshold - 1e-9) & ((w == 1) | (name[y0:x] != name[x]) | (name[x] == 0))
                hit = np.flatnonzero(new) + y0
                if not len(hit):
                    continue
                if listed:
                    for column, values in zip(out, (np.full(len(hit), order[x]), order[hit], j[hit - y0])):
                        column.append(values)
                    continue
                links[x] += len(hit)
                links[hit] += 1
                roots = np.unique(label[hit])
                label[x] = roots[0]
                for r in roots[1:]:
                    label[:x][label[:x] == r] = roots[0]
            if listed:
                a, b, j = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, float)))
                return told(s, a, b, j, True)
            low = np.full(len(s), len(s))
            np.minimum.at(low, label, order)
            some = links > 0
            return pa.table({"s": pa.array(s[order[some]]), "label": pa.array(s[low[label[some]]]), "links": pa.array(links[some])})

        table = docs.select("text").mapInArrow(lambda b: whole(b, w), "lead long, s long, one long, grams array<long>")
        return table.groupBy("lead").applyInArrow(run, PAIRS if listed else LINKS)

    met = compare(1).union(compare(2)).checkpoint()

    def entries(batches):
        seen = Seen()
        for batch in batches:
            for piece in pieces(batch, "text"):
                gram, rank, before = gram_sets(piece, "text", n, ranks.value)
                size, key = np.diff(before), set_keys(gram, before)
                use = seen.new(key)
                look, index = prefix_lengths(size, threshold)
                ell = matches(size, before, look, price.value[rank], threshold, most, verify)
                one, two = leads(gram, before)
                lead = usable(one, 1) | (usable(two, 2) >> U64(32))
                length = np.where(use, np.minimum(np.maximum(look + ell - 1, index + most - 1), size), 0)
                own = np.repeat(np.arange(len(size)), length)
                pos = np.arange(len(own)) - (np.cumsum(length) - length)[own]
                yield pa.record_batch({"gram": pa.array(signed(gram[before[own] + pos])), "s": pa.array(signed(key[own])), "lead": pa.array(signed(lead[own])), "meta": pa.array(size[own] << 33 | pos << 4 | ell[own])})

    entry = docs.select("text").mapInArrow(entries, "gram long, s long, lead long, meta long").repartition("gram").dropDuplicates(["gram", "s", "lead", "meta"])
    size, pos, ell = (lambda a: f"shiftright({a}.meta, 33)"), (lambda a: f"(shiftright({a}.meta, 4) & {(1 << 29) - 1}L)"), (lambda a: f"({a}.meta & 15L)")
    part = lambda a, t: f"({size(a)} - ceil({t!r}D * {size(a)} - 1e-9D))"
    joined = (
        entry.alias("y")
        .join(entry.alias("x"), F.expr("x.gram = y.gram"))
        .where(F.expr(f"({size('y')} < {size('x')} or ({size('y')} = {size('x')} and y.s < x.s)) and {size('y')} >= {threshold!r}D * {size('x')} - 1e-9D"))
        # one condition of both sides: two of one side each would be pushed below the shuffle, which then couldn't be shared
        .where(F.expr(f"least({part('x', threshold)} - {pos('x')}, {part('y', 2 * threshold / (1 + threshold))} - {pos('y')}) + {ell('x')} > 0"))
        # pairs that a lead brings together are compared there; a lead of 0 brings none together
        .where(F.expr("(shiftright(x.lead, 32) != shiftright(y.lead, 32) or shiftright(x.lead, 32) = 0) and ((x.lead & 4294967295L) != (y.lead & 4294967295L) or (x.lead & 4294967295L) = 0)"))
        .groupBy(F.col("x.s").alias("sa"), F.col("y.s").alias("sb"))
        .agg(F.count(F.lit(1)).alias("found"), F.max("x.meta").alias("mx"), F.max("y.meta").alias("my"))
    )
    nx, ny = F.shiftright("mx", 33), F.shiftright("my", 33)
    last = lambda c: F.shiftright(c, 4).bitwiseAND(F.lit((1 << 29) - 1).cast("long"))
    pairs = joined.where((F.col("found") >= F.col("mx").bitwiseAND(F.lit(15).cast("long"))) & (F.col("found") + F.least(nx - last("mx"), ny - last("my")) - 1 >= F.lit(threshold / (1 + threshold)) * (nx + ny) - 1e-9)).select("sa", "sb").checkpoint()
    wanted = share(membership(pairs.select(F.explode(F.array("sa", "sb")).alias("s")), "s", bitmap_bits))

    def chosen(batches):
        seen = Seen()
        for batch in batches:
            for piece in pieces(batch, "text"):
                gram, _, before = gram_sets(piece, "text", n, ranks.value)
                key = set_keys(gram, before)
                at = np.flatnonzero((np.diff(before) > 0) & member(wanted.value, key))
                at = at[seen.new(key[at])]
                yield pa.record_batch({"s": pa.array(signed(key[at])), "grams": lists(signed(gram), before).take(pa.array(at))})

    full = docs.select("text").mapInArrow(chosen, "s long, grams array<long>").dropDuplicates(["s"])
    near = met.select(F.col(met.columns[0]).alias("sa"), F.col(met.columns[1]).alias("sb"))
    return head.select("doc_id", "s").distinct(), met.union(verified(pairs, near, full, threshold, listed))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_MATCHES, verify: float = VERIFY_COST, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, sketch_bits: int = SKETCH_BITS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """A row for each doc_id: class_id, the smallest doc_id that it is connected with by equal or similar sets; copies, how many other documents have its set; links, how many different sets are similar to it."""
    docs = documents(docs, id_col, text_col).where("doc_id is not null")
    head, found = similar_sets(docs.where("text is not null"), threshold, n, most, verify, block, block_grams, sketch_bits, bitmap_bits, False)
    head, found = head.checkpoint(), found.checkpoint()
    first = head.groupBy("s").agg(F.min("doc_id").alias("rep"), (F.count(F.lit(1)) - 1).alias("copies"))
    star = found.where("s != label").select("s", "label").distinct()
    star = star.join(first.select("s", F.col("rep").alias("ra")), "s").join(first.select(F.col("s").alias("label"), F.col("rep").alias("rb")), "label").select("ra", "rb")
    each = head.join(first, "s").join(found.groupBy("s").agg(F.sum("links").alias("links")), "s", "left").checkpoint()
    edge = star.union(each.select("rep", "doc_id")).where("ra != rb").select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"))
    counted = each.groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    out = docs.select("doc_id").distinct().join(counted, "doc_id", "left").join(group_of(edge), "doc_id", "left")
    return out.select("doc_id", F.coalesce("group", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_MATCHES, verify: float = VERIFY_COST, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, sketch_bits: int = SKETCH_BITS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """doc_a < doc_b and their jaccard.

    Documents with equal sets hang on the smallest doc_id among them, with a jaccard of 1; different sets that are
    similar give one pair of their smallest doc_ids. A crowd of near copies has that many squared of them.
    """
    docs = documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    head, similar = similar_sets(docs, threshold, n, most, verify, block, block_grams, sketch_bits, bitmap_bits, True)
    first = head.groupBy("s").agg(F.min("doc_id").alias("rep"))
    copies = head.join(first, "s").where(F.col("doc_id") > F.col("rep")).select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    near = similar.join(first.select(F.col("s").alias("sa"), F.col("rep").alias("ra")), "sa").join(first.select(F.col("s").alias("sb"), F.col("rep").alias("rb")), "sb")
    near = near.where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"), "jaccard")
    return copies.union(near).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def group_of(pairs: DataFrame) -> DataFrame:
    """doc_id and the smallest doc_id it is connected with (group), for every doc_id of the pairs.

    Each round every id takes the smallest label of its neighbours, and then that label's own label, so that chains
    shorten by half; it ends when nothing changes.
    """
    ready(pairs.sparkSession)
    edge = pairs.select(F.inline(F.array(F.struct(F.col("doc_a").alias("doc_id"), F.col("doc_b").alias("to")), F.struct(F.col("doc_b").alias("doc_id"), F.col("doc_a").alias("to"))))).distinct().checkpoint()
    label = edge.groupBy("doc_id").agg(F.least(F.col("doc_id"), F.min("to")).alias("group")).checkpoint()
    while True:
        near = edge.join(label.select(F.col("doc_id").alias("to"), "group"), "to").groupBy("doc_id").agg(F.min("group").alias("near"))
        moved = label.join(near, "doc_id").select("doc_id", F.col("group").alias("old"), F.least("group", "near").alias("mid"))
        jumped = moved.join(label.select(F.col("doc_id").alias("mid"), F.col("group").alias("far")), "mid", "left").select("doc_id", "old", F.least("mid", F.coalesce("far", "mid")).alias("group")).checkpoint()
        if jumped.where(F.col("old") != F.col("group")).isEmpty():
            return jumped.select("doc_id", "group")
        label = jumped.select("doc_id", "group")


def without_copies(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those whose class, in the rows of ``classes``, has a smaller doc_id."""
    name = free(docs, "gone")
    gone = found.where(F.col("class_id") < F.col("doc_id")).select(F.col("doc_id").alias(name))
    return docs.join(gone, integer_id(docs, id_col) == F.col(name), "left_anti")
