"""Readers. Every one declares its schema, so nothing is inferred and columns are pruned at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes a core for which a table counts as small.
SMALL = 16_000_000
METADATA = "map<string, struct<citations:int, year:int, venue:string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is too small to be many tasks' input, dealt to all cores; any other one as it is.

    The size is Spark's own estimate, so a shuffle is only ever made of what each core would read in a moment.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines `{_id, title, text}` as doc_id and text (title, a space, text; nulls count as empty)."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("doc_id"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def query_texts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines `{_id, text}` as query_id and text."""
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query, document and score below a header; short rows are left out and the last of repeated pairs wins.

    The place of a row is its file's name and its place there; Spark numbers rows within a file's split in reading order.
    """
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, doc_id string, score string")
    rows = rows.withColumn("at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rows = rows.filter(F.col("query_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("score").isNotNull())
    last = rows.groupBy("query_id", "doc_id").agg(F.max_by("score", "at").alias("score"))
    return last.select("query_id", "doc_id", F.col("score").cast("double").cast("int").alias("gain"))


def judged_sets(qrels: DataFrame) -> DataFrame:
    """Each document once for each side on which some query judges it."""
    return qrels.select("doc_id", (F.col("gain") >= 1).alias("relevant")).distinct()


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object from document id to a record or null: doc_id, has_record, citations, year, venue."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", METADATA)).alias("doc_id", "m"))
    return text.select("doc_id", F.col("m").isNotNull().alias("has_record"), "m.citations", "m.year", "m.venue")


def bibliography(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """A CSV dump of bibliographic rows, only those of `wanted` (column cord_uid) if it is given."""
    columns = ("cord_uid", "doi", "publish_time", "journal", "s2_id", "pubmed_id")
    rows = spark.read.csv(path, header=True, multiLine=True, mode="PERMISSIVE", quote='"', escape='"').select(*columns)
    rows = rows.withColumn("row_pos", F.monotonically_increasing_id())
    return rows if wanted is None else rows.join(wanted, "cord_uid", "left_semi")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both tables joined by their key; running it fails if a key stands on one side only or twice on one."""
    counts = [side.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{n}")) for n, side in (("l", left), ("r", right))]
    odd = counts[0].join(counts[1], key, "full").filter("coalesce(_nl, 0) <> 1 OR coalesce(_nr, 0) <> 1")
    checked = odd.agg(F.count(F.lit(1)).alias("_odd"))
    joined = left.join(right, key).crossJoin(F.broadcast(checked))
    return joined.filter(F.assert_true(F.col("_odd") == 0, F.concat(F.col("_odd"), F.lit(" keys aren't on both sides once"))).isNull()).drop("_odd")


def require_texts(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """ids with their texts; running it fails if a text is missing."""
    found = ids.join(texts, "query_id", "left")
    return found.filter(F.assert_true(F.col("text").isNotNull(), F.concat(F.lit("no text for query "), "query_id")).isNull())


def first_supplied(rows: DataFrame, key: str, order: str, field: str) -> DataFrame:
    """Of rows with the same key the first, or the first that supplies `field` if the first one doesn't."""
    by = Window.partitionBy(key).orderBy((F.coalesce(field, F.lit("")) == "").asc(), order)
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
