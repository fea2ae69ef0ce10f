"""Queries on hybrid ranking, experiments, experts, gaps and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..operators import extract, facts, graph, retrieve
from ..sources import tables
from . import mapping
from .mapping import table
from .register import registry

QUERIES, ORACLES, query = registry()


@query("""
SELECT source_id, count(*) AS n_names, md5(string_agg(name, '|' ORDER BY name)) AS names FROM (
  SELECT DISTINCT l_suppkey AS source_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT l_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1""")
def c7_source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names at the edges of each supplier: its parts' and its own."""
    entities = mapping.supply_entities(spark, sf_dir).withColumn("normalized_name", F.col("name"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_suppkey") + 10_000_000).alias("subject_id"), F.col("l_partkey").alias("object_id"))
    return retrieve.entity_names(edges, entities).select("source_id", F.size("names").cast("long").alias("n_names"), F.md5(F.array_join(F.array_sort("names"), "|")).alias("names"))


#: Each part as a candidate: brand and type are wanted terms, the name's words are alias tokens.
SCORED = """
WITH s AS (
  SELECT p_partkey AS document_id, p_size % 5 AS query_id, p_partkey % 97 AS source_id,
    floor((CASE WHEN p_size % 10 = 0 THEN 0.5 ELSE (p_size % 10) / 10.0 END + 0.25 / (1 + p_size) + 0.55 * (p_size % 3) / 4.0 + CASE WHEN p_partkey % 2 = 0 THEN 0.45 ELSE 0.25 END + 0.03) * 1000 + 0.5 + 1e-9) / 1000 AS score, p_partkey % 2 = 0 AS matched
  FROM part)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wanted, low = F.array(F.lower("p_type")), F.lower(F.concat_ws(" ", "p_type", "p_name"))
    names = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lower("p_type"))).otherwise(F.array().cast("array<string>"))
    score = retrieve.hybrid_score(-F.col("p_size").cast("double"), (F.col("p_size") % 3) / 4, (F.col("p_size") % 10) / 10, wanted, names, F.array(F.lower("p_type")), low)
    return part.select(F.col("p_partkey").alias("document_id"), (F.col("p_size") % 5).alias("query_id"), (F.col("p_partkey") % 97).alias("source_id"), score.alias("score"), F.array_intersect(wanted, names).alias("matched_entities"), F.col("p_partkey").alias("candidate_rank"))


@query(SCORED + "SELECT document_id, query_id, round(score, 3) AS score FROM s")
def c8_hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("document_id", "query_id", "score")


BEST = SCORED + """, b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY round(score, 3) DESC, document_id) = 1)
"""


@query(BEST + "SELECT query_id, source_id, document_id FROM b")
def c9_best_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.best_of_sources(_scored(spark, sf_dir)).select("query_id", "source_id", "document_id")


@query(BEST + "SELECT query_id, document_id FROM (SELECT *, max(round(score, 3)) OVER (PARTITION BY query_id) AS top FROM b) WHERE top < 1.5 OR round(score, 3) >= greatest(1.0, 0.3 * top) OR matched")
def c10_relative_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.relative_cut(retrieve.best_of_sources(_scored(spark, sf_dir))).select("query_id", "document_id")


@query("SELECT query_id, document_id FROM (SELECT s.query_id, doc_id AS document_id, row_number() OVER (PARTITION BY s.query_id ORDER BY (doc_id % 10) / 10.0 DESC, CASE WHEN doc_id % 16 < 15 THEN doc_id % 16 END DESC NULLS LAST, doc_id DESC) AS nth FROM documents, (SELECT unnest([1, 2]) AS query_id) s WHERE doc_id % 2 = s.query_id - 1) WHERE nth <= 80")
def c5_supplemental(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = mapping.sources(spark, sf_dir).select(F.col("id").alias("document_id"), "reliability_score", "year", (F.col("id") % 2 + 1).cast("int").alias("query_id"))
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    return retrieve.supplemental(asked, sources, 8).select("query_id", "document_id")


@query("""
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_returnflag AS property, 1 - l_discount AS confidence, l_quantity AS lo, l_quantity + 20 AS hi, l_partkey FROM lineitem),
g AS (SELECT *, lo <= 12 AND hi >= 10 AS numeric_match, count(*) OVER (PARTITION BY fact_id) AS n FROM f)
SELECT fact_id, numeric_match FROM g WHERE property = 'R' AND confidence >= 0.95 AND n = 1 ORDER BY numeric_match DESC, confidence DESC, fact_id LIMIT 24""")
def c12_search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.facts(spark, sf_dir).withColumns({"evidence": F.lit("line item"), "unit": F.lit(None).cast("string")})
    once = rows.groupBy("fact_id").agg(F.count("*").alias("n")).where("n = 1").select("fact_id")
    rows = rows.join(once, "fact_id", "left_semi").where("property = 'R'")
    wanted = spark.createDataFrame([(1, "R")], "query_id int, property string")
    asked = spark.createDataFrame([(1, "R", "between", None, 10.0, 12.0, None)], "query_id int, property string, comparator string, value double, min_value double, max_value double, unit string")
    core = spark.createDataFrame([(1, "nothing has this")], "query_id int, term string")
    return facts.search_facts(rows, wanted, asked, core, k=8, min_confidence=0.95).select("fact_id", "numeric_match")


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as experiments: brand is the material, type the process."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("experiment_key"), F.col("p_name").alias("title"), F.col("p_brand").alias("material"), F.col("p_type").alias("process"), F.lit("").alias("result_summary"), F.lit("x").alias("geography"), (F.lit(2000) + F.col("p_size")).alias("year"), (F.col("p_size") % 7 / 7).alias("reliability_score"))


@query("""
WITH q AS (SELECT DISTINCT p_type, dense_rank() OVER (ORDER BY p_type) AS query_id FROM part),
t AS (SELECT query_id, p_partkey, p_size, p_size >= 40 + query_id % 20 AS fits FROM part p JOIN q ON contains(lower(p.p_name || ' ' || p.p_brand || ' ' || p.p_type), lower(q.p_type))),
a AS (SELECT query_id, bool_or(fits) AS any_fits FROM t GROUP BY 1),
e AS (SELECT query_id, p_partkey, fits, row_number() OVER (PARTITION BY query_id ORDER BY (p_size % 7) / 7 DESC, p_size DESC, p_partkey) AS nth FROM t JOIN a USING (query_id) WHERE fits OR NOT any_fits)
SELECT query_id, p_partkey AS experiment_key, fits AS exact FROM e WHERE nth <= 10""")
def c16_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part type as a process from some year on; for half of them no part is so new, and near misses are found."""
    from pyspark.sql import Window

    types = table(spark, sf_dir, "part").select("p_type").distinct().withColumn("query_id", F.dense_rank().over(Window.orderBy("p_type")).cast("long"))
    none = F.array().cast("array<string>")
    asked = types.select("query_id", none.alias("materials"), F.array("p_type").alias("processes"), none.alias("geography"), (F.lit(2040) + F.col("query_id") % 20).cast("int").alias("year_from"), F.lit(None).cast("int").alias("year_to"))
    return facts.search_experiments(_experiments(spark, sf_dir), asked).select("query_id", "experiment_key", "exact")


@query("""
SELECT query_id, name, score FROM (SELECT q.query_id, s_name AS name, CASE WHEN s_nationkey = q.query_id THEN 1 ELSE 0 END AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN s_nationkey = q.query_id THEN 1 ELSE 0 END DESC, s_name) AS nth
  FROM supplier, (SELECT n_nationkey AS query_id FROM nation) q WHERE s_nationkey = q.query_id) WHERE nth <= 10""")
def c17_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as experts in their nation's topic."""
    topic = lambda c: F.array(F.concat(F.lit("Topic <"), F.col(c), F.lit(">")))
    experts = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), topic("s_nationkey").alias("expertise"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), topic("n_nationkey").alias("topics"))
    return facts.search_experts(experts, asked).select("query_id", "name", "score")


@query("""
SELECT c_custkey AS query_id, 'no_documents' AS gap FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'no_experiments' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT c_custkey, 'building_untested' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority[1] = '1')""")
def c18_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    asked = customer.select(F.col("c_custkey").alias("query_id"), F.array("c_mktsegment").alias("terms"))
    docs = orders.select(F.col("o_custkey").alias("query_id"))
    tried = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("BUILDING"))).otherwise(F.array(F.lit("none"))).alias("terms"))
    rules = spark.createDataFrame([("building_untested", ["BUILDING"])], "gap string, required_terms array<string>")
    return facts.gaps(asked, docs, tried, docs, asked.select("query_id").limit(0), rules)


@query("""
WITH s AS (SELECT l_suppkey AS query_id, l_orderkey AS id, (l_tax * 100)::INT AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax DESC, l_orderkey) AS nth FROM lineitem),
f AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS id, ((1 - l_discount) * 100)::INT AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY 1 - l_discount DESC, l_orderkey * 10 + l_linenumber) AS nth FROM lineitem)
SELECT query_id, sources, facts FROM (SELECT query_id, md5(string_agg(id || ':' || score, ',' ORDER BY nth)) AS sources FROM s WHERE nth <= 30 GROUP BY 1)
JOIN (SELECT query_id, md5(string_agg(id || ':' || score, ',' ORDER BY nth)) AS facts FROM f WHERE nth <= 30 GROUP BY 1) USING (query_id)""")
def c20_evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty sources and facts of each supplier, in order, with their scores in hundredths."""
    li = table(spark, sf_dir, "lineitem").withColumn("query_id", F.col("l_suppkey"))
    found = li.select("query_id", F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("document_id"), F.col("l_tax").alias("score"))
    rows = mapping.facts(spark, sf_dir).withColumn("query_id", F.col("source_id"))
    told = lambda c, key, score: F.md5(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[key], F.round(x[score] * 100).cast("int"))), ","))
    return facts.evidence_pack(found, rows).select("query_id", told("sources", "source_id", "score").alias("sources"), told("facts", "fact_id", "confidence").alias("facts"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 4 > 1 OR o_orderkey % 5 = 0 THEN 'gap_analysis' WHEN o_orderstatus = 'F' THEN 'comparison' WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'protocol' ELSE 'review' END AS mode FROM orders""")
def c22_answer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions: with gaps, with the word in them, and of each intent."""
    said = F.when(F.col("o_orderkey") % 10 == 0, "A GAP here").when(F.col("o_orderkey") % 5 == 0, "где Пробелы").otherwise("other")
    intent = F.when(F.col("o_orderstatus") == "F", "comparison").when(F.col("o_orderstatus") == "P", "experts").when(F.col("o_custkey") % 3 == 0, "experiments").otherwise("review")
    gaps = F.greatest(F.lit(0), F.col("o_custkey") % 4 - 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", facts.answer_mode(gaps, said, intent).alias("mode"))


@query("""
SELECT n_regionkey::BIGINT AS query_id, '## Sources' || chr(10) || string_agg('* ' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || '## Totals' || chr(10) || count(*) AS markdown FROM nation GROUP BY 1""")
def c23_answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("query_id", F.col("n_regionkey").cast("long"))
    lines = nation.select("query_id", F.lit("1 Sources").alias("section"), F.col("n_nationkey").alias("position"), F.concat(F.lit("* "), "n_name").alias("line"))
    totals = nation.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit("2 Totals").alias("section"), F.lit(0).alias("position"), F.col("n").cast("string").alias("line"))
    return facts.report(lines.unionByName(totals))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'comparison' WHEN 1 THEN 'experts' ELSE 'review' END AS intent,
  CASE WHEN o_orderkey % 3 = 0 THEN 2015 WHEN o_orderkey % 3 = 1 THEN 2022 ELSE year(o_orderdate) + 20 END::INT AS year_from, CASE WHEN o_orderkey % 3 = 0 THEN 2019 WHEN o_orderkey % 3 = 1 THEN 2024 ELSE year(o_orderdate) + 20 END::INT AS year_to FROM orders""")
def b26_query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions in one of three forms."""
    said = F.when(F.col("o_orderkey") % 3 == 0, "сравнить с 2015 по 2019").when(F.col("o_orderkey") % 3 == 1, "эксперты за последние 3 лет").otherwise(F.concat(F.lit("обзор "), (F.year("o_orderdate") + 20).cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("q"))
    return rows.select("o_orderkey", facts.query_intent(F.col("q")).alias("intent"), facts.query_years(F.col("q"), 2024).alias("y")).select("o_orderkey", "intent", "y.*")


@query("""
WITH one AS (SELECT p_type, min(p_brand) AS alias FROM part GROUP BY 1),
w AS (SELECT p_type, regexp_extract_all(lower(p_type || ' ' || replace(p_type, '_', ' ') || ' ' || alias), '[a-z0-9]{3,}') AS words FROM one)
SELECT p_type AS query_id, array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), ' ') AS tokens FROM w""")
def b27_alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as canonical names with one alias each; the tokens in order."""
    one = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_brand").alias("alias"))
    terms = one.select(F.lit("materials").alias("category"), F.col("p_type").alias("canonical"), "alias")
    parsed = one.select(F.col("p_type").alias("query_id"), F.col("p_type").alias("canonical"))
    return retrieve.alias_tokens(parsed, terms).select("query_id", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT p_name AS subject, 'validated_by' AS predicate, p_type AS object FROM part UNION ALL SELECT p_name, 'uses_material', unnest([p_brand, 'steel']) FROM part")
def b24_experiment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _experiments(spark, sf_dir).withColumn("materials", F.array("material", F.lit("steel")))
    return tables.experiment_edges(rows).select("subject", "predicate", "object")


@query("SELECT s_name AS subject, 'n' || s_nationkey AS object, 0.9::DOUBLE AS confidence FROM supplier")
def b24_expert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.array(F.concat(F.lit("n"), F.col("s_nationkey"))).alias("expertise"))
    return tables.expert_edges(rows).select("subject", "object", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT o_orderkey, o_custkey AS source_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS document_id FROM orders")
def b25_curated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"))
    chunks = orders.select("source_id", F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("chunk_no"))
    return tables.attach_to_first_chunk(orders, chunks)


@query("""
WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), m AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey = 1)
SELECT CASE WHEN l_suppkey = 1 AND l_partkey IN (SELECT l_partkey FROM m) THEN 99999999 ELSE l_suppkey + 10000000 END AS subject_id, count(*) AS edges, sum(l_partkey)::BIGINT AS parts, min(l_partkey) AS first_part, max(l_partkey) AS last_part FROM e GROUP BY 1""")
def d8_split_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier's returned parts go to a new entity."""
    edges = mapping.supply_edges(spark, sf_dir)
    entities = mapping.supply_entities(spark, sf_dir)
    new = spark.createDataFrame([(99_999_999, "Process", "split")], "id long, type string, name string")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_suppkey = 1").select((F.col("l_suppkey") + 10_000_000).alias("s"), "l_partkey").distinct()
    listed = returned.select(F.xxhash64("s", "l_partkey").alias("edge_id"))
    _, _, moved = graph.split_entity(entities, edges.select("id", "subject_id", "object_id"), edges, 10_000_001, new, listed.select(F.col("edge_id").alias("fact_id")), listed)
    return moved.groupBy("subject_id").agg(F.count("*").alias("edges"), F.sum("object_id").alias("parts"), F.min("object_id").alias("first_part"), F.max("object_id").alias("last_part"))


@query()
def b12_property_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric conditions over whole documents with their inferred property; few or none occur in synthetic prose."""
    terms = spark.createDataFrame([("properties", "recovery", "the")], "category string, canonical string, alias string")
    units = spark.createDataFrame([("dollar", "$$$"), ("percent", "%%%")], "canonical string, alias string")
    return extract.conditions(table(spark, sf_dir, "documents").select("doc_id", "text"), terms, units).select("doc_id", "property", "comparator", "value", "unit")


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(lang || ' ' || source), '[a-z0-9]{3,}'))) AS n FROM documents")
def b2_source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(search_tokens(F.concat_ws(" ", "lang", "source")))).cast("long").alias("n"))
