"""A virtual project made of relational tables: customers and suppliers are code, their orders symbols, documents documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import category
from ..functions.paths import basename, top_area
from ..model import Graph, edges_frame, nodes_frame


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The tables of a folder; the schema of each is read once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = table(self.spark, self.sf_dir, name)
        return self.known[name]


def customer_path() -> Column:
    return _text("customers/n", F.col("c_nationkey"), "/c", F.col("c_custkey"), ".py")


def supplier_path() -> Column:
    return _text("suppliers/n", F.col("s_nationkey"), "/s", F.col("s_suppkey"), ".go")


def nation_path(key: str = "n_nationkey") -> Column:
    return _text("nations/", F.col(key), ".toml")


def document_path() -> Column:
    return _text("docs/", F.col("lang"), "/d", F.col("doc_id"), ".md")


def files(t: Tables) -> DataFrame:
    """path, size of all files."""
    out = t("customer").select(customer_path().alias("path"), F.length("c_name").cast("long").alias("size"))
    out = out.union(t("supplier").select(supplier_path(), F.length("s_name").cast("long")))
    out = out.union(t("nation").select(nation_path(), F.length("n_name").cast("long")))
    out = out.union(t("region").select(_text("docs/region", F.col("r_regionkey"), ".md"), F.length("r_name").cast("long")))
    return out.union(t("documents").select(document_path(), F.col("n_chars")))


def orders(t: Tables) -> DataFrame:
    """o_orderkey, o_custkey, o_orderdate, file and id of the order as a symbol."""
    rows = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), customer_path().alias("file")), "o_custkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "file", _text(F.col("file"), "#o", F.col("o_orderkey")).alias("id"))


def edges(t: Tables) -> DataFrame:
    """All edges; a filter on the type prunes the tables of the others."""
    sales = orders(t)
    kind = lambda df, name: df.select("src", "dst", F.lit(name).alias("type"))
    out = kind(files(t).select(F.col("path").alias("src"), _text("area:", top_area(F.col("path"))).alias("dst")), "belongs_to")
    out = out.union(kind(sales.select(F.col("file").alias("src"), F.col("id").alias("dst")), "defines"))
    before = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    out = out.union(kind(sales.select(F.col("id").alias("src"), before.alias("dst")).where("dst is not null"), "calls"))
    first = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    bought = sales.select("o_orderkey", F.col("file").alias("src")).join(first, "o_orderkey").join(t("supplier").select("s_suppkey", supplier_path().alias("dst")), "s_suppkey")
    out = out.union(kind(bought.select("src", "dst").distinct(), "imports"))
    out = out.union(kind(t("supplier").select(supplier_path().alias("src"), nation_path("s_nationkey").alias("dst")), "imports"))
    out = out.union(kind(t("nation").select(_text("docs/region", F.col("n_regionkey"), ".md").alias("src"), nation_path().alias("dst")), "references"))
    judged = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    out = out.union(kind(judged.select(document_path().alias("src"), _text("decision:ADR-", F.col("quality")).alias("dst")).distinct(), "mentions"))
    seen = t("events").select(F.col("user_id").alias("c_custkey"), _text("session:", F.date_format("ts", "yyyy-MM-dd")).alias("src")).join(t("customer"), "c_custkey")
    return out.union(kind(seen.select("src", customer_path().alias("dst")).distinct(), "touches"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = Tables(spark, sf_dir)
    path = files(t)
    nodes = nodes_frame(path.select(F.col("path").alias("id"), F.lit("file").alias("kind"), basename(F.col("path")).alias("label"), "path", category(F.col("path")).alias("category"), "size"))
    nodes = nodes.union(nodes_frame(path.select(top_area(F.col("path")).alias("label")).distinct().select(_text("area:", F.col("label")).alias("id"), F.lit("area").alias("kind"), "label")))
    sale = orders(t)
    nodes = nodes.union(nodes_frame(sale.select("id", F.lit("symbol").alias("kind"), _text("o", F.col("o_orderkey")).alias("label"), F.col("file").alias("path"), F.col("o_orderkey").alias("line"), F.lit("function").alias("symbol"))))
    ruled = t("labels").join(t("documents"), "doc_id", "left_semi").select(_text("ADR-", F.col("quality")).alias("label")).distinct()
    nodes = nodes.union(nodes_frame(ruled.select(_text("decision:", F.col("label")).alias("id"), F.lit("decision").alias("kind"), "label")))
    days = t("events").join(t("customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").select(F.date_format("ts", "yyyy-MM-dd").alias("label")).distinct()
    nodes = nodes.union(nodes_frame(days.select(_text("session:", F.col("label")).alias("id"), F.lit("session").alias("kind"), "label", F.col("label").alias("date"))))
    return Graph(nodes, edges_frame(edges(t)), "star")
