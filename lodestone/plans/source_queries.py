"""Queries on sources, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import backfill, evaluate
from ..sources import files, sinks
from . import mapping
from .mapping import table
from .register import registry
from .text_queries import NORMAL

QUERIES, ORACLES, query = registry()

SUFFIX = "CASE doc_id % 6 WHEN 0 THEN 'md' WHEN 1 THEN 'csv' WHEN 2 THEN 'docx' WHEN 3 THEN 'zip' WHEN 4 THEN 'exe' ELSE '' END"
PATH = f"'/corpus/' || source || '/' || (1990 + doc_id % 40) || '/' || doc_id || CASE WHEN {SUFFIX} = '' THEN '' ELSE '.' || {SUFFIX} END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus of files: a folder for each source and year, suffixes in turn, sizes up to some 100 MB."""
    docs = table(spark, sf_dir, "documents")
    kind = F.expr(SUFFIX)
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), (F.lit(1990) + F.col("doc_id") % 40).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.when(kind == "", "").otherwise(F.concat(F.lit("."), kind)))
    return docs.select(path.alias("path"), (F.col("n_chars") * 4096).alias("length"), F.encode("text", "UTF-8").alias("content"), "doc_id")


@query(f"""
WITH f AS (SELECT {PATH} AS path, source, {SUFFIX} AS suffix, n_chars * 4096 AS length, doc_id FROM documents),
d AS (
  SELECT 'suffix' AS dimension, suffix AS value, length FROM f UNION ALL SELECT 'folder', source, length FROM f
  UNION ALL SELECT 'language', 'en', length FROM f
  UNION ALL SELECT 'size', CASE WHEN length < 1048576 THEN '<1MB' WHEN length < 10485760 THEN '1-10MB' WHEN length < 52428800 THEN '10-50MB' WHEN length < 104857600 THEN '50-100MB' ELSE '>=100MB' END, length FROM f
  UNION ALL SELECT 'status', CASE WHEN suffix IN ('md', 'csv', 'docx') THEN 'supported' WHEN suffix = 'zip' THEN 'supported_archive' ELSE 'unsupported' END, length FROM f
  UNION ALL SELECT 'reason', CASE WHEN suffix IN ('md', 'csv') THEN 'text' WHEN suffix = 'docx' THEN 'office' WHEN suffix = 'zip' THEN 'archive' WHEN suffix = '' THEN 'no_suffix' ELSE 'suffix_exe' END, length FROM f
  UNION ALL SELECT 'year', unnest(list_distinct(list_filter([(1990 + doc_id % 40)::VARCHAR, CASE WHEN doc_id BETWEEN 1900 AND 2099 THEN doc_id::VARCHAR END], lambda y: y IS NOT NULL))), length FROM f)
SELECT dimension, value, count(*) AS files, sum(length)::BIGINT AS bytes FROM d GROUP BY 1, 2""")
def a1_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inventory(_files(spark, sf_dir), "/corpus")


@query(f"SELECT {PATH} AS path, n_chars * 4096 AS length FROM documents ORDER BY 2 DESC, 1 LIMIT 20")
def a1_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.largest(_files(spark, sf_dir))


@query(f"SELECT {PATH} AS path, doc_id::VARCHAR AS title, 'document' AS source_type, 1990 + (doc_id % 40) AS year FROM documents".replace("1990 + (doc_id % 40) AS year", "(1990 + doc_id % 40)::INT AS year"))
def a3_path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", *(c.alias(n) for n, c in files.path_metadata(F.col("path")).items()))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def a4_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", files.checksum(F.col("content")).alias("checksum"))


@query(f"""
WITH f AS (SELECT sha256(text) AS checksum, n_chars * 4096 AS length, {PATH} AS path FROM documents)
SELECT checksum, length, n, array_to_string(list_slice(paths, 1, 10), ' ') AS paths, n > 10 AS truncated FROM (
  SELECT checksum, length, count(*) AS n, list(path ORDER BY path) AS paths FROM f GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1 DESC, 2 DESC LIMIT 20)""")
def a4a_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select("path", files.checksum(F.col("content")).alias("checksum"), "length")
    return files.duplicate_groups(rows, ["checksum", "length"]).withColumn("paths", F.array_join("paths", " "))


@query("SELECT doc_id, 'doc ' || doc_id AS title, doc_id AS number, md5(trim(coalesce(text, ''), ' ')) AS body_md5 FROM documents")
def a5_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter put before each text is read back."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    whole = F.concat(F.lit('---\ntitle: "doc '), F.col("doc_id").cast("string"), F.lit('"\nnumber: '), F.col("doc_id").cast("string"), F.lit("\n--- "), "text")
    meta, body = text.front_matter(whole)
    return docs.select("doc_id", meta.alias("m"), body.alias("b")).select("doc_id", F.col("m")["title"].alias("title"), files.typed_value(F.col("m")["number"])["n"].alias("number"), F.md5("b").alias("body_md5"))


@query("SELECT 'csv' AS sheet, n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS line FROM nation")
def a6_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.csv_text(table(spark, sf_dir, "nation"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the documents has been seen: most are indexed, one in ten failed."""
    rows = _files(spark, sf_dir)
    status = F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("indexed")
    seen = rows.where(F.col("doc_id") % 2 == 0)
    return seen.select("path", files.checksum(F.col("content")).alias("checksum"), status.alias("status"), F.col("doc_id").alias("source_id"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("updated_at"))


PLAN = f"""
WITH f AS (SELECT {PATH} AS path, sha256(text) AS checksum, {SUFFIX} AS suffix, doc_id FROM documents),
new AS (SELECT *, suffix IN ('exe', '') AS bad FROM f WHERE doc_id % 2 = 1),
known AS (SELECT checksum, min(path) AS known FROM f WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0 GROUP BY 1),
firsts AS (SELECT checksum, min(path) AS f FROM new WHERE NOT bad GROUP BY 1)
"""


@query(PLAN + "SELECT path, CASE WHEN bad THEN 'unsupported' WHEN known IS NOT NULL OR f <> path THEN 'duplicate_skipped' ELSE 'pending' END AS status, CASE WHEN NOT bad THEN coalesce(known, CASE WHEN f <> path THEN f END) END AS duplicate_of FROM new LEFT JOIN known USING (checksum) LEFT JOIN firsts USING (checksum)")
def a13_incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select("path", files.checksum(F.col("content")).alias("checksum"), files.triage(F.col("path"))["status"].alias("triage"))
    return files.plan_load(rows, _manifest(spark, sf_dir)).select("path", "status", "duplicate_of")


@query(f"""
SELECT {PATH} AS path, CASE WHEN doc_id % 3 = 0 THEN 'reindexed' WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'indexed' END AS status,
  CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS checksum, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS updated_at FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def a14_manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = _files(spark, sf_dir).where(F.col("doc_id") % 3 == 0).select("path", F.lit(None).cast("string").alias("checksum"), F.lit("reindexed").alias("status"), F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("string").alias("error"), F.lit(2).alias("updated_at"))
    return files.upsert_manifest(_manifest(spark, sf_dir), news).select("path", "status", "checksum", "updated_at")


@query(f"""
WITH f AS (SELECT {SUFFIX} AS suffix, CASE WHEN doc_id % 2 = 1 THEN 'pending' WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'indexed' END AS status FROM documents)
SELECT suffix, status, count(*) AS n, CASE status WHEN 'pending' THEN 'ingest' WHEN 'failed' THEN 'inspect_error_and_retry' ELSE 'none' END AS action FROM f GROUP BY 1, 2""")
def a15_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.progress(_files(spark, sf_dir), _manifest(spark, sf_dir))


#: Documents as files of ten kinds in their source's folder; two in three are in the manifest, with files that are elsewhere.
REPORTED = """
WITH k AS (SELECT doc_id, ['md', 'doc', 'rar', 'part2.rar', 'zip', '001', '002', 'png', 'docx', 'xyz'][doc_id % 10 + 1] AS kind, coalesce(source, '') AS folder FROM documents),
f AS (SELECT *, '/root/' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE folder || '/' END || doc_id || '.' || kind AS path, regexp_extract(kind, '[^.]+$') AS suffix FROM k),
m AS (
  SELECT *, CASE WHEN doc_id % 3 = 1 THEN ['indexed', 'failed', 'unsupported', 'duplicate_skipped'][doc_id // 7 % 4 + 1] ELSE ['archive_indexed', 'failed'][doc_id // 7 % 2 + 1] END AS status, CASE WHEN doc_id // 14 % 3 = 0 THEN 'no_chunks' WHEN doc_id // 14 % 3 = 1 THEN 'image' END AS error FROM f WHERE doc_id % 3 > 0),
b AS (
  SELECT path, suffix, kind, folder, doc_id, NULL AS status, NULL AS error, true AS there, false AS listed FROM f WHERE doc_id % 3 = 0 UNION ALL SELECT path, suffix, kind, folder, doc_id, status, error, true, true FROM m
  UNION ALL SELECT '/old/' || doc_id || '.md', 'md', 'md', folder, doc_id, 'indexed', NULL, false, true FROM f WHERE doc_id % 9 = 0),
t AS (
  SELECT *, there AND NOT listed AS pending, CASE WHEN kind = 'zip' THEN 'supported_archive' WHEN kind IN ('md', 'docx') THEN 'supported' ELSE 'unsupported' END AS triage,
    CASE kind WHEN 'doc' THEN 'install_soffice_for_legacy_office' WHEN 'rar' THEN 'ingest_with_unrar_extraction' WHEN 'part2.rar' THEN 'skip_auxiliary_rar_volume' WHEN 'zip' THEN 'ingest_zip_archive' WHEN '001' THEN 'ingest_split_archive_reconstruction'
      WHEN '002' THEN 'skip_auxiliary_split_archive_part' WHEN 'png' THEN 'requires_image_ocr_pipeline' WHEN 'xyz' THEN 'manual_format_triage' ELSE 'continue_batch_ingest' END AS action,
    CASE WHEN status = 'unsupported' THEN CASE WHEN error = 'image' THEN 'wait_for_image_ocr_pipeline' WHEN kind = 'rar' THEN 'retry_unsupported_with_unrar' WHEN kind = 'part2.rar' THEN 'skip_auxiliary_rar_volume' WHEN kind = '001' THEN 'retry_split_archive_reconstruction'
      WHEN kind = '002' THEN 'skip_auxiliary_split_archive_part' WHEN kind = 'png' THEN 'wait_for_image_ocr_pipeline' ELSE 'manual_format_triage' END
      WHEN status = 'failed' AND error = 'no_chunks' THEN 'requires_ocr_for_failed_document' WHEN status = 'failed' THEN 'retry_failed_after_error_triage' END AS retry FROM b),
rows AS (
  SELECT path, 'total' AS part, 'files' AS key, false AS sampled FROM t WHERE there UNION ALL SELECT path, 'total', 'manifest', false FROM t WHERE listed UNION ALL SELECT path, 'total', 'manifested', false FROM t WHERE there AND listed
  UNION ALL SELECT path, 'total', 'pending', false FROM t WHERE pending UNION ALL SELECT path, 'total', 'done', false FROM t WHERE there AND status IN ('indexed', 'archive_indexed', 'duplicate_skipped') UNION ALL SELECT path, 'total', 'elsewhere', false FROM t WHERE NOT there
  UNION ALL SELECT path, 'status', status, false FROM t WHERE listed UNION ALL SELECT path, 'suffix_status', suffix || ':' || status, false FROM t WHERE listed UNION ALL SELECT path, 'root_status', status, false FROM t WHERE listed AND there
  UNION ALL SELECT path, 'pending_status', triage, true FROM t WHERE pending UNION ALL SELECT path, 'pending_suffix', suffix, false FROM t WHERE pending UNION ALL SELECT path, 'pending_folder', CASE WHEN doc_id % 4 = 0 THEN '<root>' ELSE folder END, false FROM t WHERE pending
  UNION ALL SELECT path, 'pending_action', action, true FROM t WHERE pending UNION ALL SELECT path, 'error', coalesce(error, '<unknown>'), true FROM t WHERE status = 'failed' UNION ALL SELECT path, 'retry_action', retry, true FROM t WHERE retry IS NOT NULL)
SELECT part, key, count(*) AS n, CASE WHEN any_value(sampled) THEN array_to_string(list_sort(list(path))[1:4], ' ') END AS samples FROM rows GROUP BY 1, 2"""


@query(REPORTED)
def a15_progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, states, folders, failure groups, actions and samples, with a RAR tool at hand and no office converter."""
    key = F.col("doc_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n.cast("int") + 1)
    told = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/root/"), F.when(key % 4 == 0, "").otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit("/"))), key, F.lit("."), pick(["md", "doc", "rar", "part2.rar", "zip", "001", "002", "png", "docx", "xyz"], key % 10)).alias("path"))
    seventh = F.floor(key / 7)
    status = F.when(key % 3 == 1, pick(["indexed", "failed", "unsupported", "duplicate_skipped"], seventh % 4)).otherwise(pick(["archive_indexed", "failed"], seventh % 2))
    error = F.when(F.floor(key / 14) % 3 == 0, "no_chunks").when(F.floor(key / 14) % 3 == 1, "image")
    listed = told.where("doc_id % 3 > 0").select("path", status.alias("status"), error.alias("error"))
    elsewhere = told.where("doc_id % 9 = 0").select(F.concat(F.lit("/old/"), key, F.lit(".md")).alias("path"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error"))
    found = files.progress_report(told.select("path"), listed.unionByName(elsewhere), "/root", 4, extracts_rar=True)
    return found.select("part", "key", "n", F.array_join("samples", " ").alias("samples"))


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def a16_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit("m").alias("model"))
    return files.missing_embeddings(mapping.chunks(spark, sf_dir).select("document_id"), have, "m")


#: Documents as the chunks of fifty sources, some with a page marker, and facts with six forms of evidence.
BACKFILL = r"""
WITH raw AS (SELECT doc_id AS document_id, doc_id % 50 AS source_id, doc_id // 50 AS chunk_no, CASE WHEN doc_id % 7 = 0 THEN '[page ' || doc_id || '] ' ELSE '' END || text AS text, CASE WHEN doc_id % 3 = 0 THEN 'page ' || doc_id END AS locator FROM documents),
c AS (SELECT * REPLACE (coalesce(locator, CASE WHEN document_id % 7 = 0 THEN 'page ' || document_id ELSE 'chunk ' || (chunk_no + 1) END) AS locator), {normal} AS body FROM raw),
f AS (
  SELECT document_id AS fact_id, CASE WHEN document_id % 13 > 0 THEN source_id END AS source_id, CASE WHEN document_id % 6 = 5 OR document_id % 11 = 3 THEN document_id END AS own, CASE WHEN document_id % 6 = 5 THEN 5 END AS own_start,
    CASE document_id % 6 WHEN 0 THEN text[length(text) // 2 + 1:length(text) // 2 + 300] WHEN 1 THEN body[1:130] || ' zz ' || document_id WHEN 2 THEN text[length(text) // 2 + 1:length(text) // 2 + 30] WHEN 3 THEN 'zz absent ' || document_id WHEN 5 THEN 'x' END AS text FROM c),
n AS (SELECT *, substring({normal}, 1, 260) AS needle FROM f),
hit AS (
  SELECT fact_id, arg_min({{'d': document_id, 's': CASE WHEN contains(body, needle) THEN strpos(body, needle) ELSE strpos(body, needle[1:120]) END - 1, 'n': CASE WHEN contains(body, needle) THEN length(needle) ELSE 120 END}}, chunk_no) AS h
  FROM n JOIN c ON c.source_id = n.source_id AND (contains(body, needle) OR (length(needle) >= 40 AND contains(body, needle[1:120]))) WHERE needle <> '' AND (own IS NULL OR own_start IS NULL) GROUP BY 1),
spot AS (
  SELECT fact_id, h.d AS document_id, h.s AS start, h.s + h.n AS stop FROM hit
  UNION ALL SELECT fact_id, x.document_id, 0, CASE WHEN length(x.text) > 0 THEN length(x.text) ELSE length(n.text) END FROM n JOIN c x ON x.document_id = coalesce(own, (SELECT arg_min(y.document_id, y.chunk_no) FROM c y WHERE y.source_id = n.source_id))
  WHERE needle <> '' AND n.source_id IS NOT NULL AND (own IS NULL OR own_start IS NULL) AND fact_id NOT IN (SELECT fact_id FROM hit))
"""


def _backfilling(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, chunks, and the chunks that have tables."""
    i, none = F.col("document_id"), F.lit(None)
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), (F.col("doc_id") % 50).alias("source_id"), F.floor(F.col("doc_id") / 50).alias("chunk_no"),
        F.concat(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("[page "), "doc_id", F.lit("] "))).otherwise(""), "text").alias("text"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("page "), "doc_id")).alias("locator"), none.cast("string").alias("locator_type"), none.cast("int").alias("start_char"), none.cast("int").alias("end_char"),
    )
    half = F.floor(F.length("text") / 2).cast("int") + 1
    evidence = (
        F.when(i % 6 == 0, F.substring(F.col("text"), half, F.lit(300))).when(i % 6 == 1, F.concat(F.substring(text.normalize_text(F.col("text")), 1, 130), F.lit(" zz "), i))
        .when(i % 6 == 2, F.substring(F.col("text"), half, F.lit(30))).when(i % 6 == 3, F.concat(F.lit("zz absent "), i)).when(i % 6 == 5, "x")
    )
    rows = raw.select(
        i.alias("fact_id"), F.when(i % 13 > 0, F.col("source_id")).alias("source_id"), F.when((i % 6 == 5) | (i % 11 == 3), i).alias("document_id"), evidence.alias("evidence"),
        none.cast("string").alias("evidence_locator"), F.when(i % 6 == 5, 5).alias("evidence_start"), none.cast("int").alias("evidence_end"),
    )
    return rows, raw, raw.where("document_id % 2 = 0").select("document_id")


@query(BACKFILL.format(normal=NORMAL) + """
SELECT fact_id, coalesce(own, spot.document_id) AS document_id, locator AS evidence_locator, coalesce(own_start, start)::INT AS evidence_start, stop::INT AS evidence_end
FROM f LEFT JOIN spot USING (fact_id) LEFT JOIN c ON c.document_id = coalesce(spot.document_id, CASE WHEN own_start IS NOT NULL THEN own END)""")
def a17_evidence_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from the middle or the begin of chunks, with another end, absent, missing, or placed already."""
    rows, raw, _ = _backfilling(spark, sf_dir)
    return backfill.placed_facts(rows, backfill.with_locators(raw)).select("fact_id", "document_id", "evidence_locator", "evidence_start", "evidence_end")


@query(BACKFILL.format(normal=NORMAL) + """
SELECT document_id, c.locator, len(rows) - CASE WHEN named THEN 1 ELSE 0 END AS n_rows FROM c JOIN (
  SELECT *, len(rows[1]) = width AND len(list_filter(rows[1], lambda x: x = '')) = 0 AS named FROM (
    SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM (
      SELECT document_id, list_transform(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda s: contains(s, ' | ')), lambda s: list_transform(string_split(trim(s), '|'), lambda x: trim(x))) AS rows FROM c) WHERE len(rows) >= 2) WHERE width >= 2) USING (document_id)
WHERE document_id % 2 = 1""")
def a17_missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of the chunks that have none yet."""
    _, raw, tables = _backfilling(spark, sf_dir)
    return backfill.missing_tables(backfill.with_locators(raw), tables).select("document_id", "locator", "n_rows")


@query("""
SELECT document_id, locator, CASE WHEN document_id % 3 = 0 THEN NULL WHEN document_id % 7 = 0 THEN 'page' ELSE 'chunk' END AS locator_type FROM c""".replace("SELECT", BACKFILL.format(normal=NORMAL) + "SELECT", 1))
def a17_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators by marker or number where chunks have none."""
    return backfill.with_locators(_backfilling(spark, sf_dir)[1]).select("document_id", "locator", "locator_type")


@query("SELECT 'documents' AS name, count(*) AS n, 100 AS least, count(*) >= 100 AS ok FROM documents UNION ALL SELECT 'pages', count(*), 1000000, count(*) >= 1000000 FROM pages")
def a18_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.readiness({n: table(spark, sf_dir, n) for n in ("documents", "pages")}, {"documents": 100, "pages": 1_000_000})


@query("SELECT count(*) AS documents, count(vec_id) AS embedded, round(count(vec_id) / count(*), 6) AS coverage FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def a18_embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit("m").alias("model"))
    return evaluate.embedding_coverage(mapping.chunks(spark, sf_dir), have, "m").withColumn("coverage", F.round("coverage", 6))


@query("SELECT (l_orderkey * 10 + l_linenumber) AS fact_id, l_returnflag AS property, l_quantity AS min_value, NULL::VARCHAR AS evidence, NULL::VARCHAR AS geography FROM lineitem")
def a19_evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.evidence_table(mapping.facts(spark, sf_dir)).select("fact_id", "property", "min_value", "evidence", "geography")


@query("""SELECT n_nationkey::BIGINT AS id, '{"@context":{"@vocab":"https://lodestone.example/ontology#"},"@id":"urn:edge:' || n_nationkey || '","@type":"RelationAssertion","subject":{"name":"' || n_name || '"},"predicate":"in_region","object":{"name":"' || r_name || '"},"confidence":0.5}' AS line
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def a20_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_ld(_place_names(spark, sf_dir))


@query("""SELECT n_nationkey::BIGINT AS id, '<urn:edge:' || n_nationkey || '> a l:RelationAssertion ;' || chr(10) || '  l:subject "' || n_name || '" ;' || chr(10) || '  l:predicate "in_region" ;' || chr(10) || '  l:object "' || r_name || '" ;' || chr(10) || '  l:confidence 0.500 .' AS line
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def a21_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.turtle(_place_names(spark, sf_dir))


def _place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("subject"), F.lit("in_region").alias("predicate"), F.col("r_name").alias("object"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("source"))
