"""Generation over retrieved contexts: tasks, records, and what is measured on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import citation_numbers, hash_unit, judged_scores

CONTEXT, SHOWN = 5, 1200


def contexts(run: DataFrame, corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each ranking (`by`: its columns) `doc_ids` and `context`: its first documents, numbered, SHOWN characters of title and text."""
    by = by or ["query_id"]
    shown = F.substring(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))), 1, SHOWN)
    top = run.filter(F.col("rank") <= CONTEXT).join(corpus.select("doc_id", shown.alias("shown")), "doc_id")
    grouped = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "shown"))).alias("docs"))
    parts = F.transform("docs", lambda d: F.concat(F.lit("["), d["rank"].cast("string"), F.lit("] "), d["shown"]))
    return grouped.select(*by, F.transform("docs", lambda d: d["doc_id"]).alias("doc_ids"), F.array_join(parts, "\n\n").alias("context"))


def sampled_queries(queries: DataFrame, most: int = 50, seed: int = 20260813, by: str = "dataset") -> DataFrame:
    """At most `most` queries of each dataset, those with the smallest md5 of seed and id."""
    order = Window.partitionBy(by).orderBy(hash_unit(F.lit(seed), F.col("query_id")), "query_id")
    return queries.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most).drop("_at")


def tasks(runs: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, systems: tuple[str, ...] = ("Neural-Hybrid", "CA-HR"), most: int = 50) -> DataFrame:
    """What is to be generated: for sampled queries (query_id, dataset, text) and each system its context, and how many relevant documents it holds."""
    asked = sampled_queries(queries, most).select("dataset", "query_id", F.col("text").alias("question"))
    made = contexts(runs.filter(F.col("method").isin(*systems)).join(asked.select("query_id"), "query_id", "left_semi"), corpus, ["method", "query_id"])
    good = qrels.filter("gain >= 1").groupBy("query_id").agg(F.collect_set("doc_id").alias("good"))
    held = F.size(F.array_intersect("doc_ids", F.coalesce("good", F.array().cast(f"array<{dict(qrels.dtypes)['doc_id']}>"))))
    return asked.join(made, "query_id").join(good, "query_id", "left").select("dataset", "query_id", F.col("method").alias("system"), "question", "doc_ids", held.alias("n_rel_context"), "context")


def answered(asked: DataFrame, client: Callable[[str], str], prompt: Callable[[str, str], str], judge: Callable[[str, str], str]) -> DataFrame:
    """`asked` with an `answer` and a `verdict` from a language model, given as a function from a prompt to a text.

    prompt and judge make its inputs from question and context, and from question and answer. A failing call leaves both null and says why in `error`.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for question, context in zip(frame.question, frame.context):
                try:
                    answer = client(prompt(question, context))
                    rows.append((answer, client(judge(question, answer)), None))
                except OSError as error:
                    rows.append((None, None, str(error)))
            yield frame.assign(**{c: [r[i] for r in rows] for i, c in enumerate(("answer", "verdict", "error"))})

    return asked.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in asked.dtypes) + ", answer string, verdict string, error string")


def citation_precision(records: DataFrame, qrels: DataFrame) -> DataFrame:
    """`records` (query_id, doc_ids, answer) with how many documents the answer cites and the share of relevant ones among them."""
    cited = records.withColumn("numbers", citation_numbers(F.col("answer"), F.size("doc_ids")))
    good = qrels.filter("gain >= 1").groupBy("query_id").agg(F.collect_set("doc_id").alias("good"))
    ids = F.transform("numbers", lambda n: F.element_at("doc_ids", n))
    out = cited.join(good, "query_id", "left").withColumn("n_citations", F.size("numbers"))
    hits = F.size(F.filter(ids, lambda d: F.array_contains(F.coalesce("good", F.array().cast(dict(qrels.dtypes)["doc_id"].join(("array<", ">")))), d)))
    return out.withColumn("citation_precision", F.when(F.col("n_citations") > 0, hits / F.col("n_citations"))).drop("numbers", "good")


def judged(records: DataFrame) -> DataFrame:
    """`records` with relevance and faithfulness from `verdict`, a judge's answer."""
    return records.withColumn("_j", judged_scores(F.col("verdict"))).select("*", "_j.relevance", "_j.faithfulness").drop("_j")


def scored_well(records: DataFrame) -> DataFrame:
    """Records without an error and with a relevance other than zero."""
    kept = F.coalesce("relevance", F.lit(0)) != 0
    return records.filter(kept & F.col("error").isNull() if "error" in records.columns else kept)


def summary(records: DataFrame, measures: list[str]) -> DataFrame:
    """Mean, standard deviation and number of each measure by system, and by dataset and system."""
    aggregates = [a for m in measures for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_n"))]
    rows = records.rollup("system", "dataset").agg(F.grouping("dataset").alias("over_all"), F.grouping("system").alias("total"), *aggregates)
    return rows.filter("total = 0").drop("total", "over_all")


def paired(records: DataFrame, measures: list[str], first: str, second: str, least: int = 10) -> DataFrame:
    """`measure`, `query_id`, `dataset`, `a`, `b`, `diff` where both systems have a value, for measures with at least so many pairs.

    A system's last record (by `turn`) of a query counts.
    """
    value = lambda system: F.max_by(F.struct(*measures), F.when(F.col("system") == system, F.col("turn")))
    wide = records.filter(F.col("system").isin(first, second)).groupBy("dataset", "query_id").agg(value(first).alias("a"), value(second).alias("b"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"a.{m}").cast("double").alias("a"), F.col(f"b.{m}").cast("double").alias("b")) for m in measures]))
    rows = wide.select("dataset", "query_id", each.alias("m")).select("m.measure", "dataset", "query_id", "m.a", "m.b").filter("a IS NOT NULL AND b IS NOT NULL")
    enough = rows.groupBy("measure").count().filter(F.col("count") >= least).select("measure")
    return rows.join(F.broadcast(enough), "measure").withColumn("diff", F.col("a") - F.col("b"))
