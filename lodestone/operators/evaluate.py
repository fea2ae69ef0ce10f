"""Quality and load metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extraction_scores(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row of true_positives, false_positives, false_negatives, precision, recall and f1 over distinct keys; nulls in keys are
    equal to each other."""
    e, a = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), actual.select(*keys).distinct().withColumn("_a", F.lit(1))
    both = e.unionByName(a, allowMissingColumns=True).groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    n = both.agg(F.count_if(F.expr("_e = 1 AND _a = 1")).alias("true_positives"), F.count_if(F.expr("_e IS NULL")).alias("false_positives"), F.count_if(F.expr("_a IS NULL")).alias("false_negatives"))
    ratio = lambda of, all_: F.when(all_ > 0, of / all_).otherwise(1.0)
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def retrieval_quality(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, expected, hit, recall, traced, located) for found (query_id, title, document_id, locator) and expected (query_id,
    fragment): a fragment is hit if a found title holds it."""
    held = expected.join(found.select("query_id", "title"), "query_id", "left").groupBy("query_id", "fragment").agg(F.max(F.coalesce(F.contains(F.lower("title"), F.lower("fragment")), F.lit(False))).alias("hit"))
    recall = held.groupBy("query_id").agg(F.count("*").alias("expected"), F.count_if("hit").alias("hit"))
    traced = found.groupBy("query_id").agg(F.avg(F.col("document_id").isNotNull().cast("int")).alias("traced"), F.avg((F.coalesce("locator", F.lit("")) != "").cast("int")).alias("located"))
    return recall.join(traced, "query_id", "left").withColumn("recall", F.col("hit") / F.col("expected"))


def latency(samples: DataFrame, group: list[str], value: str = "ms") -> DataFrame:
    """Count, p50, p95 (linear between neighbours) and maximum by group."""
    return samples.groupBy(*group).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max"))


def request_metrics(log: DataFrame) -> DataFrame:
    """(method, path, requests, errors, avg_ms, max_ms) of a request log (method, path, status, ms)."""
    return log.groupBy("method", "path").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))


def readiness(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(name, n, least, ok) for each table."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(least.get(name, 0)).alias("least"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("ok", F.col("n") >= F.col("least"))


def embedding_coverage(documents: DataFrame, embeddings: DataFrame, model: Column | str) -> DataFrame:
    """One row: documents, embedded and coverage for a model."""
    done = embeddings.where(F.col("model") == model).select("document_id").distinct().withColumn("_done", F.lit(1))
    n = documents.join(done, "document_id", "left").agg(F.count("*").alias("documents"), F.count("_done").alias("embedded"))
    return n.withColumn("coverage", F.when(F.col("documents") > 0, F.col("embedded") / F.col("documents")).otherwise(1.0))
