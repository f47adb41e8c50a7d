"""The pipeline: its stages run one after the other, keep the columns of documents, and do what brute force says they must."""

import random
from collections import Counter

import corpus_pipeline
import test_decontamination
import test_sets
from strataweave.llm import bpe, decontamination, packing, quality

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, class_id string, new_text string"


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    line = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, line(12)) for k in range(4)] + [(9, None), (None, "a b c d")]
    rows = [[k, [line(rng.randint(8, 20)) for _ in range(rng.randint(1, 4))]] for k in range(40)]
    for k in range(0, 12, 2):  # near copies of a whole document, line by line too far apart for line dedup
        rows[k + 20][1] = [" ".join([*x.split()[:-1], word()]) for x in rows[k][1]]
    for k in (3, 5, 33):
        rows[k][1].append(rows[1][1][0])
    rows[17][1].append(bench[2][1])
    rows[18][1].insert(0, " ".join([*bench[0][1].split()[:-1], "other"]))
    out = [(k, "\n".join(x)) for k, x in rows]
    return [*out, (3, out[3][1]), (None, out[1][1]), (50, None), (51, ""), (52, "é"), (53, " \n"), (54, "-- \n --"), (None, None), (60, out[7][1]), (61, out[7][1].upper())], bench


def write(spark, folder, rows, bench):
    spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "a", None) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_against_brute_force(spark, tmp_path):
    rows, bench = made(1)
    folder = write(spark, tmp_path, rows, bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    shape, now = docs.dtypes, Counter(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        before = list(now.elements())
        if name == "quality_classifier":  # without labels all texts of two bytes or more stay
            now = Counter(r for r in before if r[1] is not None and len(r[1].encode()) > 1)
        elif name == "line_dedup":
            lost = {(i, k) for i, k, *_ in test_sets.brute_lines(before, 0.9)}
            cut = [(i, t if not any(i == j for j, _ in lost) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in lost)) for i, t in before]
            now = Counter(r for r, old in zip(cut, before) if r == old or r[1].strip())
            assert now != Counter(before)
        elif name == "ngram_jaccard_join":
            by_set, near = test_sets.brute_sets(before, 0.7)
            label = {i: i for i, _ in before}
            groups = [list(ids) for ids in by_set.values()] + [[*by_set[a], *by_set[b]] for a, b in near]
            for _ in groups:
                for g in groups:
                    label |= dict.fromkeys(g, min(label[i] for i in g))
            now = Counter(r for r in before if label[r[0]] == r[0])
            assert len(now) <= len(before) - 3
        elif name == "benchmark_decontamination":
            gone = {i for i, _ in test_decontamination.brute(before, bench, decontamination.THRESHOLD, decontamination.RADIUS)}
            now = Counter(r for r in before if r[0] not in gone)
            assert {17, 18} <= gone
        assert docs.dtypes == shape and texts(docs) == now
    coder = bpe.Encoder(bpe.ranks(bpe.VOCABULARY)).coder
    want, got, bins = Counter(), Counter(), Counter()
    for i, t in now.elements():
        want[i] += len(coder.encode_ordinary(t))
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        got[r["doc_id"]] += r["n_tokens"]
        bins[r["bin"]] += r["n_tokens"]
    assert got == want and max(bins.values()) <= packing.CAPACITY
    again = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["n_tokens"] for r in again) == sum(want.values())


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).count() == 0


def test_classifier_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, DATA).collect()}
    model = quality.fitted(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert kept == {r["doc_id"] for r in quality.scored(docs, model).where("accepted").collect()}
