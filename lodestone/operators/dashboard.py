"""Dashboard aggregates over the sources that a role may see, and their facts, edges and disputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import both_ways, low_connectivity, shared_table


def of_sources(rows: DataFrame, sources: DataFrame, column: str = "source_id") -> DataFrame:
    """Rows of the given sources, and rows without a source."""
    ids = sources.select(F.col("id").alias(column))
    return rows.join(ids, column, "left_semi").unionByName(rows.where(F.col(column).isNull()))


def counts_by(df: DataFrame, column: str, name: str | None = None, missing: str = "unknown") -> DataFrame:
    """(name, n): rows by a column, where a missing or empty value counts as `missing`."""
    value = F.when(F.col(column).isNull() | (F.col(column).cast("string") == ""), missing).otherwise(F.col(column).cast("string"))
    return df.groupBy(value.alias(name or column)).agg(F.count("*").alias("n"))


def entities_by_type(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(type, n): distinct entities at either end of the edges."""
    ends = both_ways(edges.select("subject_id", "object_id")).select(F.col("node").alias("id")).distinct()
    return entities.join(ends, "id", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


def coverage_by_property(facts: DataFrame, limit: int = 25) -> DataFrame:
    """(property, facts, sources, verified, flagged), most facts first."""
    return (
        facts.groupBy("property").agg(
            F.count("*").alias("facts"), F.countDistinct("source_id").alias("sources"),
            F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("validation_status") == "suspicious").alias("flagged"),
        ).orderBy(F.col("facts").desc(), "property").limit(limit)
    )


def freshness(sources: DataFrame, limit: int = 20) -> DataFrame:
    """(year, n), newest first and unknown last."""
    return sources.groupBy("year").agg(F.count("*").alias("n")).orderBy(F.coalesce("year", F.lit(0)).desc()).limit(limit).select(F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year"), "n")


def stale(sources: DataFrame, as_of_year: int, age: int = 5) -> DataFrame:
    return sources.where(F.col("year").isNull() | (F.col("year") < as_of_year - age))


def stale_list(sources: DataFrame, as_of_year: int, limit: int = 25) -> DataFrame:
    return stale(sources, as_of_year).orderBy(F.col("year").asc_nulls_first(), "id").limit(limit)


def disputes_by_severity(disputes: DataFrame) -> DataFrame:
    return disputes.groupBy("severity", "status").agg(F.count("*").alias("n"))


def overdue(disputes: DataFrame, as_of: Column) -> DataFrame:
    return disputes.where((F.col("status") != "resolved") & (F.col("due_at") < as_of))


def overdue_list(disputes: DataFrame, as_of: Column, limit: int = 25) -> DataFrame:
    return overdue(disputes, as_of).orderBy("due_at", "id").limit(limit)


def reviewer_activity(reviews: DataFrame) -> DataFrame:
    """(reviewer, n, latest)."""
    return reviews.groupBy("reviewer").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))


def audit_activity(audit: DataFrame, prefixes: list[str]) -> DataFrame:
    """(prefix, role, n): actions by the first listed prefix that they begin with."""
    prefix = F.coalesce(*(F.when(F.col("action").startswith(p), F.lit(p)) for p in prefixes))
    return audit.withColumn("prefix", prefix).where("prefix IS NOT NULL").groupBy("prefix", "role").agg(F.count("*").alias("n"))


def manager_summary(sources: DataFrame, facts: DataFrame, disputes: DataFrame, as_of: Column, as_of_year: int) -> DataFrame:
    """One row of totals."""
    s = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("year").isNull() | (F.col("year") < as_of_year - 5)).alias("stale_sources"))
    f = facts.agg(F.count("*").alias("facts"), F.count_if(F.col("status") == "verified").alias("verified_facts"), F.count_if(F.col("status") == "contradicted").alias("contradicted_facts"), F.count_if(F.col("validation_status") == "suspicious").alias("flagged_facts"))
    open_ = F.col("status") != "resolved"
    d = disputes.agg(F.count_if(open_).alias("open_disputes"), F.count_if(open_ & (F.col("due_at") < as_of)).alias("overdue_disputes"))
    return s.crossJoin(f).crossJoin(d)


def board(sources: DataFrame, facts: DataFrame, edges: DataFrame, entities: DataFrame, disputes: DataFrame, reviews: DataFrame, experiments: DataFrame, access: Column, as_of: Column, as_of_year: int) -> dict[str, DataFrame]:
    """All panels as one viewer sees them: of the sources that `access` allows, and of the facts, edges, disputes (fact_id) and reviews (fact_id,
    reviewer, created_at) that belong to these; what has no source is in no panel. Experiments have no access filter, as in the surveyed system.

    The sources that may be seen are found once, and so are the ids of their facts; the rest are semi-joins to these."""
    seen = shared_table(sources.where(access))
    mine = facts.where("source_id IS NOT NULL")
    mine = of_sources(mine, seen)
    ids = shared_table(mine.select(F.col("id").alias("fact_id")).distinct())
    ends = of_sources(edges.where("source_id IS NOT NULL"), seen)
    disputed, reviewed = disputes.join(ids, "fact_id", "left_semi"), reviews.join(ids, "fact_id", "left_semi")
    return {
        "sources_by_type": counts_by(seen, "source_type"), "entities_by_type": entities_by_type(ends, entities), "facts_by_status": counts_by(mine, "status", missing="candidate"),
        "facts_by_validation": counts_by(mine, "validation_status", missing="valid"), "coverage": coverage_by_property(mine), "freshness": freshness(seen), "stale": stale_list(seen, as_of_year),
        "disputes": disputes_by_severity(disputed), "overdue": overdue_list(disputed, as_of), "reviewers": reviewer_activity(reviewed), "experiments": counts_by(experiments, "process"),
        "low_connectivity": low_connectivity(entities, ends, ["Process", "Material"]), "summary": manager_summary(seen, mine, disputed, as_of, as_of_year),
    }
