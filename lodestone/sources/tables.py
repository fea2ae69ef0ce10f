"""Typed table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIMENTS = "experiment_id string, source_title string, title string, year int, geography string, material string, process string, conditions_json string, metrics_json string, result_summary string, reliability_score double, team string"
EXPERTS = "name string, organization string, geography string, expertise array<string>, contact string"


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiments from CSV: materials split at commas, conditions and metrics as maps."""
    rows = spark.read.schema(EXPERIMENTS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    maps = {name: F.from_json(f"{name}_json", "map<string,string>") for name in ("conditions", "metrics")}
    return rows.withColumns({"materials": F.transform(F.split("material", ","), lambda m: F.trim(m)), **maps}).drop("conditions_json", "metrics_json")


def experts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERTS).option("multiLine", True).json(path)


def experiment_edges(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object, confidence): an experiment is validated by its process and uses its materials."""
    process = rows.select(F.col("title").alias("subject"), F.lit("validated_by").alias("predicate"), F.col("process").alias("object"), F.lit(1.0).alias("confidence"))
    used = rows.select(F.col("title").alias("subject"), F.lit("uses_material").alias("predicate"), F.explode("materials").alias("object"), F.lit(1.0).alias("confidence"))
    return process.unionByName(used).where("object IS NOT NULL AND object <> ''")


def expert_edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("name").alias("subject"), F.lit("expert_in").alias("predicate"), F.explode("expertise").alias("object"), F.lit(0.9).alias("confidence"))


def attach_to_first_chunk(curated: DataFrame, chunks: DataFrame) -> DataFrame:
    """Curated rows (source_id, ...) with the document_id of their source's first chunk."""
    first = chunks.groupBy("source_id").agg(F.min_by("document_id", F.struct("chunk_no", "document_id")).alias("document_id"))
    return curated.join(first, "source_id", "left")
