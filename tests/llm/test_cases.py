"""The defined cases of every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns, other ids."""

import pytest
from pyspark.sql import functions as F

from strataweave.llm import decontamination, fingerprints, language_id, line_dedup, ngram_join, packing, quality, substring_dedup, token_counts, token_output

LONG = "".join(f"Word{k % 977} und {k % 31}," + ("\n" if k % 50 == 0 else " ") for k in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nSecond line of it", "en"), (2, "The quick brown fox jumps over the lazy dog.\nAnother line here", "en"), (2, "The quick brown fox jumps over the lazy dog.\nAnother line here", "en"),
    (3, None, "en"), (4, "", "de"), (5, " \n\t\n ", None), (None, "The quick brown fox jumps over the lazy dog.", "en"), (None, None, None), (6, LONG, "de"), (7, LONG, "de"), (8, "x" * 300_000, None), (9, "--\n..", "fr"), (2**62, "é ü ß 你好 \U0001f600", "fr"), (-5, "the quick brown fox jumps over the lazy dog", "en"),
]
NAMES = """s h g n k x word line span bin piece score accepted language bits margin held row chars gone own_id lost_lines new_text n_chars kind shard offset signature class_id group rep
    one two lead meta mask jaccard item_id start end similarity total n_tokens start_token position rank quality toxic code sums rare extra best size limit part `a.b`""".replace("`", "").split()
BENCH = [(1, "brown fox jumps over the lazy"), (2, None), (None, "x"), (3, ""), (4, "quick")]
LABELS = [(1, 1, 0), (1, 1, 0), (2, 1, None), (6, 0, 0), (7, None, 1), (None, 1, 0), (99, 1, 0)]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


#: Each operator, and whether it gives a row for each row of the table.
OPERATORS = {
    "fingerprints": (lambda s, d: fingerprints.fingerprints(d), True),
    "line_dedup": (lambda s, d: line_dedup.removed_lines(d), False),
    "token_output": (lambda s, d: token_output.tokens(d).where("kind = 'document'").drop("shard", "offset"), True),
    "packing": (lambda s, d: packing.packed(d), False),
    "language_id": (lambda s, d: language_id.identified(d).withColumns({"bits": F.round("bits", 4), "margin": F.round("margin", 4)}), True),
    "substring_dedup": (lambda s, d: substring_dedup.repeated_spans(d), False),
    "decontamination": (lambda s, d: decontamination.leaks(d, benchmark(s)), False),
    "ngram_join": (lambda s, d: ngram_join.classes(d), False),
    "quality": (lambda s, d: quality.scored(d, quality.fitted(d, labels(s))).withColumn("score", F.round("score", 3)), True),
    "token_counts": (lambda s, d: token_counts.token_counts(d), True),
}


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    run, each = OPERATORS[name]
    plain = documents(spark)
    crowded = plain.select("*", *[F.lit("odd").alias(n) for n in NAMES])
    got, usual = rows_of(run(spark, crowded)), run(spark, plain)
    assert got == rows_of(usual) and (not each or len(got) == len(ROWS))
    assert run(spark, crowded.limit(0)).count() == 0
    nulls = documents(spark, [(None, None, None)] * 3 + [(1, None, None)])
    assert run(spark, nulls).count() == (4 if each or name == "packing" else name == "ngram_join")
    with pytest.raises(TypeError, match="integers"):
        run(spark, plain.withColumn("doc_id", F.concat(F.lit("a"), "doc_id")))
    small = plain.withColumn("doc_id", F.when(F.abs("doc_id") < 100, F.col("doc_id")).cast("int"))
    assert run(spark, small).schema == usual.schema


def test_rows_stay_whole(spark):
    """Functions that take documents away leave the others as they are, in all their columns."""
    docs = documents(spark).select("*", *[F.lit("odd").alias(n) for n in NAMES if n != "n_chars"], F.length("text").alias("n_chars"))
    model = quality.fitted(docs, labels(spark))
    for out in (line_dedup.without_lines(docs, line_dedup.removed_lines(docs)), ngram_join.without_copies(docs, ngram_join.classes(docs)), decontamination.without_leaks(docs, benchmark(spark)), quality.only_accepted(docs, model)):
        assert out.dtypes == docs.dtypes and {r["a.b"] for r in out.collect()} == {"odd"}
