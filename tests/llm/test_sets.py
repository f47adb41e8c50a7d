"""Line dedup, n-gram join and substring dedup against brute force on small tables."""

import itertools
import random
import re

import pytest

from strataweave.llm import line_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, lang string, n_chars long, jaccard double, line int"


def words(text):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", text.lower())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or ""), 0.5, 7) for i, t in rows], SCHEMA)


def made(seed, docs=40, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, size))] for _ in range(docs // 3)]
    rows = []
    for k in range(docs):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        cuts = sorted(rng.sample(range(len(w)), min(2, len(w) - 1)))
        rows.append((k, " ".join(w[: cuts[0]]) + "\n" + " ".join(w[cuts[0] :])))
    return rows + [(None, "w1 w2 w3"), (100, None), (101, ""), (102, "\n \n--"), (3, rows[3][1]), (103, "é ü " * 3000)]


def brute_lines(rows, threshold):
    lines = {}
    for i, t in rows:
        if i is not None and t is not None:
            for k, x in enumerate(t.split("\n")):
                if words(x):
                    lines.setdefault((i, k), set()).add(frozenset(words(x)))
    out = set()
    flat = sorted((key, s) for key, sets in lines.items() for s in sets)
    for key, s in flat:
        for other, z in flat:
            if other < key and len(s & z) / len(s | z) >= threshold - 1e-9:
                out.add((*key, *other))
                break
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_line_dedup(spark, threshold):
    rows = made(1)
    got = {tuple(r)[:4] for r in line_dedup.removed_lines(frame(spark, rows), threshold).collect()}
    assert got == brute_lines(rows, threshold)


def test_line_dedup_of_nothing(spark):
    empty = frame(spark, [])
    assert line_dedup.removed_lines(empty).count() == 0 and line_dedup.without_lines(empty, line_dedup.removed_lines(empty)).count() == 0


def test_lines_go_and_columns_stay(spark):
    docs = frame(spark, [(1, "a b c d\nkeep this line"), (2, "a b c d\nand this one"), (3, "keep this line"), (None, "a b c d"), (4, None)])
    out = line_dedup.without_lines(docs, line_dedup.removed_lines(docs))
    assert out.dtypes == docs.dtypes
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, "a b c d\nkeep this line"), (2, "and this one"), (None, "a b c d"), (4, None)}


def grams(text):
    w = words(text)
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)]) if w else frozenset()


def brute_sets(rows, threshold):
    """(ids by set, similar pairs of different sets with their jaccard)."""
    by_set = {}
    for i, t in rows:
        if i is not None and t is not None and grams(t):
            by_set.setdefault(grams(t), set()).add(i)
    near = {}
    for a, b in itertools.combinations(by_set, 2):
        j = len(a & b) / len(a | b)
        if j >= threshold - 1e-9:
            near[a, b] = j
    return by_set, near


WAYS = [(0.7, 4000, 4_000_000), (0.4, 4000, 4_000_000), (0.7, 2, 4_000_000), (0.7, 4000, 90)]


@pytest.mark.parametrize(("threshold", "block", "block_grams"), WAYS)
def test_ngram_pairs(spark, threshold, block, block_grams):
    rows = made(2)
    by_set, near = brute_sets(rows, threshold)
    want = {}
    for ids in by_set.values():
        want |= {(min(ids), i): 1.0 for i in ids if i > min(ids)}
    for (a, b), j in near.items():
        x, y = sorted((min(by_set[a]), min(by_set[b])))
        if x != y:
            want[x, y] = max(j, want.get((x, y), 0))
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.similar_pairs(frame(spark, rows), threshold, block=block, block_grams=block_grams).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(("threshold", "block", "block_grams"), WAYS)
def test_ngram_classes(spark, threshold, block, block_grams):
    rows = made(3) + [(200, "one two"), (201, "Two words, three"), (201, "quite another text of one id"), (202, "Quite another text of one id!"), (203, "two words three")]
    by_set, near = brute_sets(rows, threshold)
    label = {i: i for i, _ in rows if i is not None}
    groups = [list(ids) for ids in by_set.values()] + [[*by_set[a], *by_set[b]] for a, b in near]
    while any(len({label[i] for i in g}) > 1 for g in groups):
        for g in groups:
            low = min(label[i] for i in g)
            label |= {i: low for i in g}
    links = {s: sum(s in pair for pair in near) for s in by_set}
    want = {(i, label[i], sum(len(ids) - 1 for ids in by_set.values() if i in ids), sum(links[s] for s, ids in by_set.items() if i in ids)) for i in label}
    assert {tuple(r) for r in ngram_join.classes(frame(spark, rows), threshold, block=block, block_grams=block_grams).collect()} == want


def test_groups_and_copies(spark):
    pairs = spark.createDataFrame([(5, 6, 1.0), (6, 9, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "doc_a long, doc_b long, jaccard double")
    groups = ngram_join.group_of(pairs)
    assert {tuple(r) for r in groups.collect()} == {(5, 5), (6, 5), (9, 5), (1, 1), (2, 1), (3, 1), (4, 1)}
    docs = spark.createDataFrame([(k, "x", k) for k in range(1, 11)] + [(None, "x", 3)], "doc_id long, text string, gone int")
    left = ngram_join.without_copies(docs, groups.withColumnRenamed("group", "class_id"))
    assert {r["doc_id"] for r in left.collect()} == {1, 5, 7, 8, 10, None} and left.dtypes == docs.dtypes
    none = frame(spark, [])
    assert ngram_join.without_copies(none, ngram_join.classes(none)).count() == 0


def test_ids_are_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        ngram_join.classes(spark.createDataFrame([("a1", "x")], "doc_id string, text string"))


def test_substrings(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(60)
    rows = [(1, fresh(30) + " " + passage + " " + fresh(20)), (2, fresh(70)), (3, fresh(15) + "\n" + passage), (4, passage.upper()), (5, None), (None, passage), (6, "")]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(frame(spark, rows)).collect()}
    assert got.keys() == {3, 4}
    for i in (3, 4):
        text, r = dict(rows)[i], got[i]
        removed = text[r["start"] : r["end"]].lower()
        assert removed in passage and len(removed.split()) >= 60 - 2 * substring_dedup.REACH and r["kept_doc_id"] in (1, 3)
    assert substring_dedup.repeated_spans(frame(spark, [])).count() == 0


def test_short_lines_and_ends_of_passages(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    line, passage = "Licensed under the Été License", fresh(70)
    rows = [(1, fresh(20) + " " + passage + " " + fresh(9) + "\n" + line + "\n--\n" + fresh(3))]
    rows += [(2, "é " + fresh(25) + " " + passage.upper() + ", " + fresh(20)), (3, fresh(4) + "\n  " + line.upper() + "!\n--\n" + fresh(2)), (4, passage), (5, "--")]
    rows += [(6, fresh(12) + " " + passage + " " + fresh(12))] * 2
    texts, first = dict(rows), rows[0][1]
    got = [r for r in substring_dedup.repeated_spans(frame(spark, rows)).collect()]
    assert sorted((r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]].lower()) for r in got if r["doc_id"] < 6) == [(2, passage), (3, line.lower()), (4, passage)]
    assert all(first[r["kept_start"] :].lower().startswith(texts[r["doc_id"]][r["start"] : r["end"]].lower()) and r["kept_doc_id"] == 1 for r in got if r["doc_id"] < 6)
    assert any(passage in texts[6][r["start"] : r["end"]] for r in got if r["doc_id"] == 6)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    """Every word of a repeated line, or of a passage of 50 words that stands earlier, goes; and no other but in repeats of 40 words."""
    rng = random.Random(seed)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]
    passages, lines = [fresh(rng.randint(45, 90)) for _ in range(4)], [fresh(rng.randint(1, 15)) for _ in range(4)]
    rows = []
    for k in range(30):
        parts = [fresh(rng.randint(5, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts[rng.randrange(3)][3:3] = rng.choice(passages)
        parts.insert(rng.randrange(4), rng.choice(lines))
        rows.append((k, "\n".join(" ".join(p) for p in parts)))
    rows += [(40, None), (None, rows[0][1]), (41, ""), (42, rows[3][1].upper()), (43, " ".join(passages[0] * 3)), (44, "\n".join([" ".join(lines[0])] * 4))]
    places, seen, where = [], {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for number, line in enumerate(t.split("\n")):
            places += [(i, m.start(), m.end(), m[0].lower(), number) for m in re.finditer(r"\w+", line)]
            where.setdefault((i, number), len(places) - len(words(line)))
    offsets = {i: [0] for i, _ in rows}
    for i, t in rows:
        for line in (t or "").split("\n"):
            offsets[i].append(offsets[i][-1] + len(line) + 1)
    places = [(i, offsets[i][n] + a, offsets[i][n] + b, w, n) for i, a, b, w, n in places]
    must, may = set(), set()
    for size, hit in ((50, must), (40, may)):
        first = {}
        for p in range(len(places) - size + 1):
            if places[p][0] == places[p + size - 1][0]:
                q = first.setdefault(tuple(x[3] for x in places[p : p + size]), p)
                if q + size <= p or (q != p and places[q][0] != places[p][0]):
                    hit.update(range(p, p + size))
    for (i, number), p in where.items():
        line = tuple(x[3] for x in itertools.takewhile(lambda x: x[0] == i and x[4] == number, places[p:]))
        if line and seen.setdefault(line, (i, number)) != (i, number):
            must.update(range(p, p + len(line)))
    gone = set()
    for r in substring_dedup.repeated_spans(frame(spark, rows)).collect():
        gone |= {p for p, x in enumerate(places) if x[0] == r["doc_id"] and r["start"] <= x[1] and x[2] <= r["end"]}
    assert must and must <= gone <= must | may
