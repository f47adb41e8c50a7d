"""Packing, token counts, token store, fingerprints and languages on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strataweave.llm import fingerprints, language_id, packing, token_counts, token_output

DATA = "/root/testdata/sf0.001"
TEXTS = [(1, "The quick brown fox."), (2, None), (3, ""), (None, "Été à l'école — naïve 你好"), (4, " \n\t "), (5, "word " * 5000), (1, "The quick brown fox."), (6, "x" * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, lang string, bin int, n_tokens int")


def test_packing_holds_every_token_once(spark):
    import tiktoken

    from strataweave.llm import bpe

    coder = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})
    rows = packing.packed(frame(spark, TEXTS), 256).collect()
    want = Counter((i, len(coder.encode_ordinary(t or ""))) for i, t in TEXTS)
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == Counter({i: sum(n * c for (j, n), c in want.items() if j == i) for i, _ in want})
    bins = {}
    for r in rows:
        if r["bin"] is None:
            assert r["n_tokens"] == 0
        else:
            bins.setdefault(r["bin"], []).append((r["position"], r["n_tokens"]))
    for pieces in bins.values():
        pieces.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 256
    assert packing.packed(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_close_to_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 30), rng.randint(20, 200), 256]) for _ in range(2000)]
    runs, bins = packing.plan(dict(Counter(lengths)), 256)
    assert sum(runs[:, 2]) == len(lengths) and bins >= -(-sum(lengths) // 256)
    open_ = []
    for n in sorted(lengths, reverse=True):  # brute force: best-fit decreasing
        fits = [k for k, room in enumerate(open_) if room >= n]
        if fits:
            open_[min(fits, key=lambda k: open_[k])] -= n
        else:
            open_.append(256 - n)
    assert bins <= 1.06 * len(open_) + packing.GROUPS


def greedy(word, names, inner, alone=False):
    count, at = 0, 0
    data = word.encode()
    if alone and not any(data[:e] in names for e in range(1, len(data) + 1)):
        count, names = 1, inner
    while at < len(data):
        table = names if at == 0 else inner
        end = next((e for e in range(len(data), at, -1) if data[at:e] in table), at + 1)
        count, at = count + 1, end
    return count


def test_token_counts(spark):
    vocabulary = ["▁the", "▁qu", "ick", "b", "rown", "fo", "x", "xx", "xxx", "wor", "d", "é", "▁É", "or", "ordinary"]
    first = {p.removeprefix("▁").encode() for p in vocabulary}
    inner = {p.encode() for p in vocabulary if p[0] != "▁"}
    got = Counter(map(tuple, token_counts.token_counts(frame(spark, TEXTS), vocabulary=vocabulary).collect()))
    want = Counter((i, len((t or "").split()), sum(greedy(w, first, inner) for w in (t or "").split())) for i, t in TEXTS)
    assert got == want
    real = token_counts.word_pieces(token_counts.VOCABULARY)
    names = {p.removeprefix("▁").encode() for p in real if p[0] == "▁" and p != "▁"}, {p.encode() for p in real if p[0] != "▁"}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {}
    for r in token_counts.token_counts(docs).collect():
        words = re.findall(r"[^ \t\n\r\v\f]+", texts[r["doc_id"]])
        known |= {w: greedy(w, *names, alone="▁" in real) for w in words if w not in known}
        assert r["n_tokens"] == sum(known[w] for w in words)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_long_pieces_and_the_mark_alone(spark):
    docs = spark.createDataFrame([(1, "a" * 298 + "b"), (2, "ab b"), (3, "a" * 300)], "doc_id long, text string")
    count = lambda vocabulary: {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, vocabulary=vocabulary).collect()}
    assert count(["a" * 300]) == {1: 299, 2: 3, 3: 1}
    assert count(["▁", "▁a", "ab"]) == {1: 1 + 296 + 1, 2: 2 + 2, 3: 300}


def test_store_round_trip(spark):
    import tiktoken

    from strataweave.llm import bpe

    coder = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})
    rows = token_output.tokens(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(frame(spark, TEXTS).selectExpr("doc_id + 100000", "text"))).collect()
    head = next(r for r in rows if r["kind"] == "dictionary")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()} | {i + 100000: t for i, t in TEXTS if i}
    for r in rows:
        if r["kind"] == "document" and r["doc_id"] is not None:
            ids = token_output.read_tokens(bytes(r["payload"]), bytes(head["payload"]), r["dict_hash"])
            assert ids.tolist() == coder.encode_ordinary(texts[r["doc_id"]] or "") and len(ids) == r["n_tokens"]
    store = spark.createDataFrame(rows, token_output.SCHEMA)
    for most_bytes in (1 << 20, 900):
        blocks: dict = {}
        for r in token_output.shards(store, most_bytes).collect():
            blocks.setdefault(r["shard"], []).append((r["start"], bytes(r["data"])))
        for r in rows:
            if r["kind"] == "document":
                start, data = max(b for b in blocks[r["shard"]] if b[0] <= r["offset"])
                assert data[r["offset"] - start :][: r["length"]] == bytes(r["payload"])
    with pytest.raises(ValueError):
        token_output.read_tokens(b"", b"another", head["dict_hash"])
    assert token_output.tokens(frame(spark, [])).where("kind = 'document'").count() == 0


def test_dictionary_sample_is_even(spark):
    long = "".join(f"{k:07d} " for k in range(40_000))
    docs = spark.createDataFrame([(None, long)] + [(k, f"short text number {k}") for k in range(500)] + [(k, "copy") for k in range(500)], "doc_id long, text string")
    whole = token_output.sampled(docs, 10_000)
    assert len(whole) == len(set(whole)) == 1 + 500 + -(-len(long) // token_output.BLOCK_CHARS)
    part = token_output.sampled(docs, 200)
    ends = [int(p[-9:].split()[-1]) for p in part if len(p) > 1000]
    assert 40 < len(part) < 200 and max(ends) > 30_000 and min(ends) < 15_000


def test_fingerprints_estimate_similarity(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(20, 80)))) for k in range(12)]
    got = {r["doc_id"]: np.array(r["signature"]) for r in fingerprints.fingerprints(frame(spark, rows), samples=512).collect()}
    for a, x in rows:
        for b, y in rows:
            c, d = Counter(x.split()), Counter(y.split())
            j = sum((c & d).values()) / sum((c | d).values())
            assert abs((got[a] == got[b]).mean() - j) < 0.11
    odd = {(r["doc_id"], len(r["signature"])) for r in fingerprints.fingerprints(frame(spark, TEXTS)).collect()}
    assert odd == {(1, 64), (2, 0), (3, 0), (None, 64), (4, 0), (5, 64), (6, 64)}


class Brute:
    """An interpolated Kneser-Ney model, straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order + 1)]
        for word in " ".join(texts).lower().split():
            line = "^" * (order - 1) + word + "$"
            self.count[order].update(line[i - order + 1 : i + 1] for i in range(order - 1, len(line)))
        for k in range(order - 1, 0, -1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.letters = sorted(self.count[1])

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.letters) + 1)
        one, two = (sum(n == v for n in self.count[k].values()) for v in (1, 2))
        d = one / (one + 2 * two) if one and two else 0.5
        seen = [n for g, n in self.count[k].items() if g[:-1] == gram[:-1]]
        if not seen:
            return self.p(gram[1:])
        return (max(self.count[k][gram] - d, 0) + d * len(seen) * self.p(gram[1:])) / sum(seen)

    def bits(self, text):
        lines = ["^" * (self.order - 1) + w + "$" for w in text.lower().split()]
        logs = [np.log2(self.p(x[i - self.order + 1 : i + 1])) for x in lines for i in range(self.order - 1, len(x))]
        return -sum(logs) / len(logs)


@pytest.mark.parametrize("arrays_bytes", [48_000_000, 400, 0])
def test_language_models_against_brute_force(spark, arrays_bytes):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 6)))
    rows = [(k, " ".join(word(letters) for _ in range(12)), lang) for k in range(40) for lang, letters in (("x", "abcé"), ("y", "ABdß"))]
    rows += [(90, "Zz abqd a", None), (91, None, "x"), (92, " \n", "y"), (None, "abba", "x"), (93, "w" * 40_000, None), (3, rows[0][1], "x")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, bits double, n int")
    held = {r["text"] for r in docs.selectExpr("text", "pmod(xxhash64(text), 10) = 9 as held").where("held").collect()}
    brute = {lang: Brute([t for _, t, x in rows if x == lang and t is not None and t not in held], 3) for lang in "xy"}
    for model in brute.values():
        for context in ("", "a", "^a", "ab", "q", "zz"):
            assert sum(model.p(context + c) for c in [*model.letters, "☃"]) == pytest.approx(1)
    got = language_id.identified(docs, 3, arrays_bytes=arrays_bytes).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    text = {(i, t) for i, t, _ in rows}
    for r in got:
        mine = [{x: brute[x].bits(t) for x in "xy"} for i, t in text if i == r["doc_id"] and t and t.strip()]
        if not mine:
            assert r["language"] is None and r["bits"] is None and not r["accepted"]
        else:
            assert any(r["language"] == min(b, key=b.get) and r["bits"] == pytest.approx(min(b.values()), abs=1e-5) and r["margin"] == pytest.approx(max(b.values()) - min(b.values()), abs=1e-5) for b in mine)


def test_languages_that_were_not_trained_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = spark.createDataFrame([(10**6 + k, "".join(random.Random(k).choices("0123456789abcdef#%&", k=900)), None) for k in range(30)], "doc_id long, text string, lang string")
    table = docs.selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, lang) as lang").union(junk)
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id", "quality")
    rows = language_id.identified(table).join(docs.select("doc_id", "lang"), "doc_id", "left").join(good, "doc_id", "left").collect()
    fresh = [r for r in rows if r["doc_id"] % 5 == 0 and r["doc_id"] < 10**6]
    assert np.mean([r["language"] == r["lang"] for r in fresh]) > 0.98 and np.mean([r["accepted"] for r in fresh]) > 0.9
    assert np.mean([r["accepted"] for r in fresh if r["quality"]]) > 0.97
    assert not any(r["accepted"] for r in rows if r["doc_id"] >= 10**6)


def test_no_languages(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in language_id.identified(docs).collect()} == {(1, None, None, None, False), (2, None, None, None, False)}
    assert language_id.identified(docs.limit(0)).count() == 0


def test_language_models_keep_every_gram(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 40_000))) for _ in range(54)]
    model = language_id.train(spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string"), ["zh"], 2)
    points = [np.r_[2, np.array([ord(c) for c in t]) + 4, 3] for t in texts]
    pairs = np.unique(np.concatenate([p[:-1] << 20 | p[1:] for p in points]))
    assert model.count() == len(pairs) > 2_000_000
