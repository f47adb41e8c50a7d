"""Decontamination against all windows and items compared one by one."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataweave.llm import decontamination as d


def brute(rows, items, threshold, radius, n=d.SHINGLE):
    """For each document and item the best of all windows within the radius and above the threshold."""
    items = sorted({(i, t) for i, t in items if i is not None and t is not None})
    cut = {}
    for i, t in items:
        _, _, _, before, gram, inside, _, _ = d.shingle_words(pa.array([t]), n)
        if before[-1] >= n:
            cut[i, t] = (int(before[-1]), [int(g) for g, ok in zip(gram, inside) if ok])
    frequency = Counter(g for _, grams in cut.values() for g in set(grams))
    weight = lambda g: int(d.weights(np.array([max(1, frequency[g])]), len(cut))[0])

    def print_of(grams):
        votes = [sum(weight(g) if g >> b & 1 else -weight(g) for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if votes[b] > 0)

    out = {}
    for doc, text in rows:
        said = " " + " ".join((text or "").lower().split()) + " "
        for item, t in items:
            if doc is not None and 0 < len(t.split()) < n and f" {t} " in said:
                out[doc, item] = 1.0
    for doc, text in rows:
        if doc is None or text is None:
            continue
        _, _, _, before, gram, inside, _, _ = d.shingle_words(pa.array([text]), n)
        grams, words = [int(g) for g in gram], int(before[-1])
        for (item, _), (length, wanted) in cut.items():
            for a in range(max(1, words - length + 1)):
                window = grams[a : a + min(length, words) - n + 1]
                if not window:
                    continue
                x, y = Counter(window), Counter(wanted)
                low, high = (sum(f(x[g], y[g]) * weight(g) for g in x | y) for f in (min, max))
                if low / high >= threshold - 1e-9 and (print_of(window) ^ print_of(wanted)).bit_count() <= radius:
                    out[doc, item] = max(out.get((doc, item), 0), low / high)
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(80)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 14)))) for k in range(8)] + [(20, "w1 w2"), (23, "w7"), (24, "w1 w2"), (25, "--"), (21, None), (None, "w1 w2 w3 w4 w5 w6"), (0, "w9 w9 w9 w9 w9 w9 w9")]
    rows = []
    for k in range(25):
        w = [word() for _ in range(rng.randint(0, 30))]
        if k % 2:
            leak = items[rng.randrange(8)][1].split()
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = leak
        rows.append((k, " ".join(w)))
    return rows + [(50, None), (None, items[0][1]), (51, ""), (52, items[3][1].rsplit(" ", 1)[0]), (53, "w9 " * 40), (3, items[2][1])], items


def frames(spark, rows, items):
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, similarity double, item_id int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("threshold", "slice_items"), [(0.6, 4000), (0.4, 4000), (0.6, 3)])
def test_all_within_the_radius(spark, threshold, slice_items):
    rows, items = made(3)
    docs, bench = frames(spark, rows, items)
    found = d.leaks(docs, bench, threshold, slice_items=slice_items).collect()
    got, want = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}, brute(rows, items, threshold, d.RADIUS)
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    gone = {i for i, _ in want}
    left = d.without_leaks(docs, bench, threshold, slice_items=slice_items)
    assert left.dtypes == docs.dtypes
    assert {r["doc_id"] for r in left.collect()} >= {i for i, _ in rows} - gone - {None}
    assert gone & {r["doc_id"] for r in left.collect()} <= {3}  # the other row of that id


def test_offsets_and_recall(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"t{rng.randrange(5000)}" for _ in range(30))) for k in range(40)]
    rows = [(k, f"Été — é{k} und so. " * 3 + t + " end " * 9) for k, t in items] + [(100 + k, " ".join(f"t{rng.randrange(5000)}" for _ in range(60))) for k in range(40)]
    docs, bench = frames(spark, rows, items)
    got = {r["doc_id"]: r for r in d.leaks(docs, bench).collect()}
    assert got.keys() == {k for k, _ in items}
    for k, t in items:
        assert got[k]["item_id"] == k and got[k]["distance"] == 0 and dict(rows)[k][got[k]["start"] : got[k]["end"]] == t


def test_short_items(spark):
    docs, bench = frames(spark, [(1, "So: What is 2+2? said"), (2, "what is 2"), (3, "Oui, NON"), (4, "non oui")], [(7, "What is 2+2"), (8, "oui non")])
    assert {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in d.leaks(docs, bench).collect()} == {(1, 7, 4, 15), (3, 8, 0, 8)}


def test_nothing(spark):
    docs, bench = frames(spark, [], [])
    full, items = frames(spark, [(1, "a b c d e f g")], [(1, "a b c d e f g")])
    assert d.leaks(docs, items).count() == 0 and d.leaks(full, bench).count() == 0 and d.without_leaks(full, bench).count() == 1
