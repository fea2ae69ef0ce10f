"""Document-level ingest: one pass from texts to the tables of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_language, front_matter, pipe_table
from ..sources.files import path_metadata
from .chunk import chunk
from .extract import cooccurrence, entities, facts
from .graph import insert_edges, shared_table, upsert_entities
from .retrieve import embed


def build_tables(docs: DataFrame, terms: DataFrame, units: DataFrame, reliability: float = 0.5) -> dict[str, DataFrame]:
    """The tables sources, documents (chunks), tables, entities, edges, facts, embeddings and failures from docs (source_id, text,
    and optionally title and more; reliability_score is the confidence of a source's facts). Chunks are cut once and checkpointed; everything else comes from them. A document without a chunk is
    a failure."""
    cut = chunk(docs.select("source_id", "text")).withColumn("document_id", F.xxhash64("source_id", "chunk_no"))
    chunks = shared_table(cut)
    hits = shared_table(entities(chunks.select("document_id", "source_id", "text"), terms))
    edges = cooccurrence(hits).withColumnRenamed("object", "object_name").withColumnRenamed("subject", "subject_name")
    named = hits.select("type", F.col("canonical").alias("name"), F.struct("document_id", "start").alias("seq"))
    evidence = chunks.select("document_id", F.substring("text", 1, 300).alias("evidence"))
    edges = insert_edges(edges.join(evidence, "document_id"), ("source_id", "subject_name", "predicate", "object_name", "evidence"))
    tables = chunks.select("source_id", "document_id", "locator", pipe_table(F.col("text")).alias("t")).where("t IS NOT NULL").select("source_id", "document_id", "locator", "t.*")
    told = chunks.select("document_id", "source_id", "text", "start_char", "locator")
    if "reliability_score" in docs.columns:
        told = told.join(docs.select("source_id", "reliability_score"), "source_id", "left")
    return {
        "sources": docs.drop("text"),
        "documents": chunks,
        "tables": tables,
        "entities": upsert_entities(named),
        "edges": edges,
        "facts": facts(told, terms, units, reliability),
        "embeddings": embed(chunks),
        "failures": docs.select("source_id").join(chunks.select("source_id"), "source_id", "left_anti").withColumn("error", F.lit("no_chunks")),
    }


#: What a document is where neither its front matter, its path nor the defaults of the run say so.
LAST_DEFAULTS = {"source_type": "uploaded_document", "geography": "unknown", "reliability_score": "0.55", "confidentiality": "internal"}
FIELDS = ("title", "source_type", "language", "geography", "additional_geography", "year", "date", "reliability_score", "confidentiality")
ABSTRACT = 500


def described(files: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """(source_id, path, text, abstract, metadata, and FIELDS) of files (source_id, path, text): what the front matter says comes before the defaults of
    the run, these before what the path says (title, kind, year), and that before LAST_DEFAULTS and the language of the text. The text is what follows the
    front matter; metadata holds all that it said. A number that cannot be read counts as not said."""
    said, body = front_matter(F.col("text"))
    by_path, defaults = path_metadata(F.col("path")), defaults or {}
    told = files.select("source_id", "path", said.alias("metadata"), body.alias("text"), *(by_path[c].alias(f"_{c}") for c in ("title", "source_type", "year")))
    own = lambda c: F.when(F.try_element_at("metadata", F.lit(c)) != "", F.try_element_at("metadata", F.lit(c)))
    path_kind = F.when(F.col("_source_type") != "document", F.col("_source_type"))
    path_value = {"title": F.col("_title"), "source_type": path_kind, "year": F.col("_year").cast("string")}
    last = {c: F.lit(v) for c, v in LAST_DEFAULTS.items()} | {"language": detect_language(F.col("text"))}
    values = {}
    for c in FIELDS:
        sources = [own(c), *([F.lit(str(defaults[c]))] if c in defaults else []), *([path_value[c]] if c in path_value else []), *([last[c]] if c in last else [])]
        if c in ("year", "reliability_score"):
            sources = [x.try_cast("int" if c == "year" else "double") for x in sources]
        values[c] = F.coalesce(*sources).alias(c)
    return told.select("source_id", "path", "text", F.substring("text", 1, ABSTRACT).alias("abstract"), "metadata", *values.values())


def ingest_documents(files: DataFrame, terms: DataFrame, units: DataFrame, defaults: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """build_tables of files (source_id, path, text) with the metadata of described()."""
    return build_tables(shared_table(described(files, defaults)), terms, units)
