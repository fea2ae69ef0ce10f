"""Sinks: evidence tables, linked data and reports, as rows of text that any Spark writer can store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of the evidence table, in order.
EVIDENCE = (
    "query_id", "fact_id", "source_id", "source_title", "year", "geography", "subject", "predicate", "property", "comparator", "value", "min_value",
    "max_value", "unit", "confidence", "status", "document_id", "evidence_locator", "evidence_start", "evidence",
)
BASE = "https://lodestone.example/ontology#"


def evidence_table(facts: DataFrame) -> DataFrame:
    """The fixed evidence columns; those that facts lacks are null."""
    have = set(facts.columns)
    return facts.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EVIDENCE))


def write_evidence(facts: DataFrame, path: str) -> None:
    evidence_table(facts).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_ld(edges: DataFrame) -> DataFrame:
    """(id, line): one JSON-LD relation for each edge (id, subject, predicate, object, confidence, source); nulls are left out."""
    node = F.struct(
        F.lit(BASE).alias("@vocab_"), F.concat(F.lit("urn:edge:"), "id").alias("@id_"), F.lit("RelationAssertion").alias("@type_"),
        F.struct(F.col("subject").alias("name")).alias("subject"), F.col("predicate"), F.struct(F.col("object").alias("name")).alias("object"), F.col("confidence"), F.col("source"),
    )
    text = F.to_json(node)
    for key in ("@vocab", "@id", "@type"):
        text = F.replace(text, F.lit(f'"{key}_"'), F.lit('"@context":{"@vocab"' if key == "@vocab" else f'"{key}"'))
    closed = F.replace(text, F.lit(f'"@vocab":"{BASE}"'), F.lit(f'"@vocab":"{BASE}"}}'))
    return edges.select("id", closed.alias("line"))


def _literal(value: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), value, F.lit('"'))


def turtle(edges: DataFrame) -> DataFrame:
    """(id, line): the Turtle statement of each edge."""
    subject = F.concat(F.lit("<urn:edge:"), "id", F.lit(">"))
    parts = [F.concat(F.lit("  l:subject "), _literal(F.col("subject"))), F.concat(F.lit("  l:predicate "), _literal(F.col("predicate"))), F.concat(F.lit("  l:object "), _literal(F.col("object"))), F.when(F.col("confidence").isNotNull(), F.concat(F.lit("  l:confidence "), F.format_number("confidence", 3)))]
    return edges.select("id", F.concat(subject, F.lit(" a l:RelationAssertion ;\n"), F.concat_ws(" ;\n", *parts), F.lit(" .")).alias("line"))


def write_reports(reports: DataFrame, path: str) -> None:
    """A folder for each query with its report text (query_id, markdown)."""
    reports.select("query_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("query_id").text(path)


def write_payloads(rows: DataFrame, path: str) -> None:
    """A folder for each query with its rows as JSON."""
    rows.write.mode("overwrite").partitionBy("query_id").json(path)
