"""Whole search requests over a stored index: questions told from benchmark items and nations, asked of all documents and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.access import may_see
from ..operators import report, request, retrieve
from ..operators.graph import shared_path
from ..operators.index import TextIndex, ranks
from . import mapping
from .mapping import table
from .register import registry
from .text_queries import NOISE, NORMAL, PLAIN, RANKS, STOPS, WANTED

QUERIES, ORACLES, query = registry()

AS_OF_YEAR = 2024
TERMS = [
    ("processes", "licensing", "licensed"), ("processes", "licensing", "released under"), ("processes", "that_run", "that"), ("materials", "apache", "Apache License"), ("materials", "mit", "MIT"),
    ("materials", "than_ore", "than"), ("equipment", "token", "token"), ("properties", "version", "version"), ("properties", "recovery", "from"), ("geography", "thonland", "thon"),
]
UNITS = [("mg_l", "mg/l"), ("percent", "%")]
RULES = [("untested_pair", ["licensing"], ["apache"])]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each benchmark item, with some filters in turn, and one for each nation, in five forms."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("long").alias("query_id"), "text", F.when(F.col("item_id") % 5 == 2, 2015).cast("int").alias("year_from"),
        F.when(F.col("item_id") % 3 == 1, 0.95).otherwise(0.0).alias("min_confidence"), (F.col("item_id") % 4 != 3).alias("include_internal"), F.lit(False).alias("strict"),
    )
    n = F.col("n_nationkey")
    said = (
        F.when(n % 5 == 0, "licensed under the Apache License with than").when(n % 5 == 1, "сравнить MIT licensed с 2012 по 2020")
        .when(n % 5 == 2, F.concat(F.lit("эксперимент: token version ≤ "), n, F.lit(" %"))).when(n % 5 == 3, F.concat(F.lit("zzqx"), n, F.lit("w"))).otherwise("icense")
    )
    more = table(spark, sf_dir, "nation").select((F.lit(100_000) + n).cast("long").alias("query_id"), said.alias("text"), F.lit(None).cast("int").alias("year_from"), F.lit(0.0).alias("min_confidence"), F.lit(True).alias("include_internal"), (n > 10).alias("strict"))
    return items.unionByName(more)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each line item; its source is the document with the part's number, which about half of them do not have."""
    li, flag = table(spark, sf_dir, "lineitem"), F.col("l_returnflag")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("fact_id"), F.col("l_partkey").alias("source_id"),
        F.when(F.col("l_partkey") % 7 == 0, "Licensing").otherwise(F.concat(F.lit("part "), "l_partkey")).alias("subject"), F.when(F.col("l_suppkey") % 11 == 0, "than_ore").alias("object"),
        F.when(F.col("l_linenumber") == 7, "recommendation").otherwise("measured").alias("predicate"), F.when(flag == "R", "version").when(flag == "A", "recovery").otherwise("temperature").alias("property"),
        F.lit("between").alias("comparator"), F.lit(None).cast("double").alias("value"), F.col("l_quantity").cast("double").alias("min_value"), (F.col("l_quantity") + 20).cast("double").alias("max_value"),
        F.when(flag == "R", "percent").otherwise("mg_l").alias("unit"), (1 - F.col("l_discount")).cast("double").alias("confidence"), (1 - F.col("l_tax")).cast("double").alias("extraction_confidence"),
        F.when(F.col("l_tax") > 0.05, "suspicious").otherwise("valid").alias("validation_status"), F.concat(F.lit("line "), "l_linenumber").alias("evidence_locator"), F.lit("line item").alias("evidence"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> request.Corpus:
    """Documents as chunks in a new index with vectors beside it."""
    docs = table(spark, sf_dir, "documents")
    index, chunks = TextIndex(spark, shared_path(spark, "index")), mapping.chunks(spark, sf_dir)
    index.add(chunks, retrieve.embed_md5)
    place = F.when(F.col("id") % 3 == 0, "thonland").when(F.col("id") % 3 == 1, "else")
    names = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "than_ore"), F.when(F.col("doc_id") % 3 == 0, "licensing")))
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    experiments = part.select(
        F.col("p_partkey").alias("experiment_key"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 == 0, "than_ore").when(F.col("p_size") % 3 == 1, "mit").alias("material"), F.when(F.col("p_size") % 4 == 0, "licensing").otherwise("that run").alias("process"),
        F.lit("").alias("result_summary"), F.when(F.col("p_partkey") % 2 == 0, "thonland").alias("geography"), (F.lit(2000) + F.col("p_size")).alias("year"), (F.col("p_size") % 7 / 7).alias("reliability_score"),
    )
    topic = F.when(F.col("s_nationkey") % 3 == 0, "than_ore").when(F.col("s_nationkey") % 3 == 1, "version").otherwise("that run")
    experts = supplier.select(F.col("s_name").alias("name"), F.array(topic).alias("expertise"), F.concat(F.lit("team "), "s_nationkey").alias("organization"))
    return request.Corpus(
        index, chunks, mapping.sources(spark, sf_dir).withColumn("geography", place), docs.select(F.col("doc_id").alias("source_id"), names.alias("names")), facts(spark, sf_dir), experiments, experts,
        may_see(F.col("confidentiality"), "researcher"), retrieve.embed_md5,
    )


def terms_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "category string, canonical string, alias string")


def asked_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    terms = terms_of(spark)
    asked, groups = request.with_tokens(request.parse(requests(spark, sf_dir), terms, spark.createDataFrame(UNITS, "canonical string, alias string"), AS_OF_YEAR), terms)
    return retrieve.shared_table(asked), retrieve.shared_table(groups)


_LIST = lambda category: f"coalesce(list(DISTINCT canonical ORDER BY canonical) FILTER (category = '{category}'), [])"
_WORDS = lambda text: f"list_filter(regexp_extract_all(lower(translate({text}, 'ёЁ', 'еЕ')), '[a-zа-я0-9]{{3,}}'), lambda w: w NOT IN ({STOPS}))"
_ONCE = lambda words: f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"

REQUESTS = f"""
said AS (
  SELECT item_id::BIGINT AS query_id, text, CASE WHEN item_id % 5 = 2 THEN 2015 END AS year_from, NULL::INT AS year_to, CASE WHEN item_id % 3 = 1 THEN 0.95 ELSE 0 END AS min_confidence, item_id % 4 <> 3 AS internal, false AS strict, 'review' AS intent, NULL::DOUBLE AS bound FROM benchmark
  UNION ALL SELECT 100000 + n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'licensed under the Apache License with than' WHEN 1 THEN 'сравнить MIT licensed с 2012 по 2020'
    WHEN 2 THEN 'эксперимент: token version ≤ ' || n_nationkey || ' %' WHEN 3 THEN 'zzqx' || n_nationkey || 'w' ELSE 'icense' END, CASE WHEN n_nationkey % 5 = 1 THEN 2012 END, CASE WHEN n_nationkey % 5 = 1 THEN 2020 END, 0, true, n_nationkey > 10,
    CASE n_nationkey % 5 WHEN 1 THEN 'comparison' WHEN 2 THEN 'experiments' ELSE 'review' END, CASE WHEN n_nationkey % 5 = 2 THEN n_nationkey END FROM nation),
terms(category, canonical, alias) AS (VALUES {", ".join(f"('{c}', '{n}', '{a}')" for c, n, a in TERMS)}),
seen AS (
  SELECT query_id, category, canonical FROM said, terms
  WHERE CASE WHEN contains(alias, ' ') THEN contains(lower({NORMAL}), lower(alias)) ELSE regexp_matches({NORMAL}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || alias || '([^\\p{{L}}\\p{{N}}_]|$)') END GROUP BY ALL),
kinds AS (SELECT query_id, {", ".join(f"{_LIST(c)} AS {c}" for c in ("materials", "processes", "equipment", "properties", "geography"))} FROM said LEFT JOIN seen USING (query_id) GROUP BY 1),
spelled AS (SELECT category, canonical, canonical || ' ' || replace(canonical, '_', ' ') || ' ' || string_agg(alias, ' ' ORDER BY alias) AS words FROM terms GROUP BY category, canonical),
alias_words AS (SELECT query_id, string_agg(words, ' ' ORDER BY category, canonical) AS words FROM seen JOIN spelled USING (category, canonical) GROUP BY 1),
asked AS (
  SELECT *, CASE WHEN len(once) > 0 THEN list_slice(once, 1, 18) ELSE list_slice(raw, 1, 18) END AS tokens FROM (
    SELECT *, {_ONCE("good")} AS once FROM (SELECT *, list_filter(list_concat(aliases, raw), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({NOISE})) AS good FROM (
      SELECT *, {_ONCE("alias_list")} AS aliases FROM (SELECT s.*, k.* EXCLUDE (query_id), {_WORDS("coalesce(words, '')")} AS alias_list, list_slice({_WORDS("text")}, 1, 32) AS raw FROM said s JOIN kinds k USING (query_id) LEFT JOIN alias_words USING (query_id)))))),
sets AS (
  SELECT query_id, category, canonical, {_ONCE("words")}[1:5] AS prefixes FROM (SELECT query_id, category, canonical, list_filter({_WORDS("words")}, lambda w: w NOT IN ({NOISE})) AS words FROM seen JOIN spelled USING (category, canonical) WHERE category IN ('materials', 'processes', 'geography'))),
groups AS (SELECT query_id, canonical AS group_id, unnest(prefixes) AS prefix FROM sets WHERE len(prefixes) > 0 AND query_id IN (SELECT query_id FROM sets WHERE len(prefixes) > 0 GROUP BY 1 HAVING count(*) >= 2)),
sources AS (SELECT doc_id AS source_id, source AS title, CASE WHEN doc_id % 16 < 15 THEN 2010 + doc_id % 16 END AS year, (doc_id % 10) / 10.0 AS rel, doc_id % 4 AS level, CASE doc_id % 3 WHEN 0 THEN 'thonland' WHEN 1 THEN 'else' END AS place FROM documents WHERE doc_id % 4 < 2),
t AS (SELECT doc_id, regexp_extract_all({PLAIN}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS words FROM documents),
size AS (SELECT count(*) AS n_all, avg(len(words)) AS mean FROM t),
p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS token FROM t) GROUP BY ALL),
prefixes AS (SELECT prefix FROM groups UNION SELECT unnest(tokens) FROM asked),
hits AS (SELECT prefix, doc_id, sum(tf) AS f FROM p JOIN prefixes ON starts_with(token, prefix) GROUP BY ALL),
weights AS (SELECT prefix, CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_all - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT prefix, count(*) AS n FROM hits GROUP BY 1), size),
scores AS (SELECT prefix, doc_id, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean)) AS score FROM hits JOIN weights USING (prefix) JOIN t USING (doc_id), size),
fitting AS (
  SELECT query_id, source_id AS doc_id, year, rel FROM asked, sources
  WHERE (year_from IS NULL OR year >= year_from) AND (year_to IS NULL OR year <= year_to) AND (len(geography) = 0 OR list_contains(geography, place)) AND (internal OR level = 0)),
strict AS (
  SELECT query_id, doc_id, -sum(score) AS rank FROM groups JOIN scores USING (prefix) WHERE (query_id, doc_id) IN (
    SELECT (query_id, doc_id) FROM (SELECT query_id, doc_id, count(DISTINCT group_id) AS met FROM groups JOIN hits USING (prefix) GROUP BY ALL) JOIN (SELECT query_id, count(DISTINCT group_id) AS needed FROM groups GROUP BY 1) USING (query_id) WHERE met = needed) GROUP BY ALL),
loose AS (SELECT query_id, doc_id, -sum(score) AS rank FROM (SELECT query_id, unnest(tokens) AS prefix FROM asked) JOIN scores USING (prefix) GROUP BY ALL),
tier1 AS (SELECT query_id, doc_id, rank, 'structured' AS method FROM strict JOIN fitting USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), rel DESC, year DESC NULLS LAST, doc_id) <= 16),
tier2 AS (SELECT query_id, doc_id, rank, 'bm25' AS method FROM loose JOIN fitting USING (query_id, doc_id) WHERE query_id NOT IN (SELECT query_id FROM tier1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), rel DESC, year DESC NULLS LAST, doc_id) <= 16),
tier3 AS (
  SELECT query_id, doc_id, 0.0 AS rank, 'like' AS method FROM fitting JOIN asked USING (query_id) JOIN documents USING (doc_id)
  WHERE query_id NOT IN (SELECT query_id FROM tier1 UNION SELECT query_id FROM tier2) AND len(list_filter(list_slice(tokens, 1, 8), lambda w: contains(lower(documents.text), w))) > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, year DESC NULLS LAST, doc_id) <= 16),
tier4 AS (
  SELECT query_id, doc_id, NULL::DOUBLE AS rank, 'supplemental' AS method FROM fitting WHERE query_id NOT IN (SELECT query_id FROM tier1 UNION SELECT query_id FROM tier2 UNION SELECT query_id FROM tier3)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, year DESC NULLS LAST, doc_id DESC) <= 80),
candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) NULLS LAST, rel DESC, year DESC NULLS LAST, CASE WHEN method = 'supplemental' THEN -doc_id ELSE doc_id END) AS nth
  FROM (FROM tier1 UNION ALL FROM tier2 UNION ALL FROM tier3 UNION ALL FROM tier4) JOIN fitting USING (query_id, doc_id)),
texts AS (SELECT 'd' || doc_id AS k, text FROM documents UNION ALL SELECT 'q' || query_id, concat_ws(' ', text, array_to_string(list_concat(list_concat(list_concat(list_concat(list_concat(materials, processes), equipment), properties), geography), aliases), ' ')) FROM asked),
numbers AS (SELECT k, ('0x' || md5(token)[1:8])::BIGINT AS h, count(*) AS w FROM (SELECT k, token, unnest(range(n)) FROM (SELECT k, token, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS token FROM texts) GROUP BY ALL)) GROUP BY ALL),
buckets AS (SELECT k, h % 96 AS b, sum(CASE WHEN h % 2 = 0 THEN w ELSE -w END)::DOUBLE AS w FROM numbers GROUP BY ALL),
vectors AS (SELECT k, b, (w / sqrt(sum(w * w) OVER (PARTITION BY k)))::FLOAT::DOUBLE AS v FROM buckets),
near AS (SELECT c.query_id, c.doc_id, greatest(0, sum(a.v * b.v)) AS vec FROM candidates c JOIN vectors a ON a.k = 'd' || c.doc_id JOIN vectors b ON b.k = 'q' || c.query_id AND a.b = b.b GROUP BY ALL),
told AS (SELECT doc_id, lower(trim(regexp_replace(translate(coalesce(source, '') || ' ' || coalesce(text, ''), 'ёЁ', 'еЕ'), '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) AS low, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'than_ore' END, CASE WHEN doc_id % 3 = 0 THEN 'licensing' END], lambda x: x IS NOT NULL) AS names FROM documents),
scored AS (
  SELECT c.query_id, c.doc_id, method, nth, c.year, c.rel, list_sort(list_intersect(wanted, names)) AS matched,
    round(CASE WHEN coalesce(c.rel, 0) = 0 THEN 0.5 ELSE c.rel END + 0.25 * coalesce(1 / (1 + abs(c.rank)), 0) + 0.55 * coalesce(vec, 0)
      + coalesce(list_sum(list_transform(wanted, lambda w: CASE WHEN list_contains(names, w) THEN 0.45 WHEN contains(low, w) OR contains(low, replace(w, '_', ' ')) THEN 0.25 ELSE 0 END)), 0) + 0.03 * len(list_filter(aliases, lambda w: contains(low, w))), 3) AS score
  FROM candidates c JOIN (SELECT query_id AS asked_id, list_distinct(list_concat(list_concat(materials, processes), properties)) AS wanted, aliases FROM asked) ON asked_id = c.query_id JOIN told ON told.doc_id = c.doc_id LEFT JOIN near ON near.query_id = c.query_id AND near.doc_id = c.doc_id),
chosen AS (
  SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM scored) WHERE top < 1.5 OR score >= greatest(1.0, 0.3 * top) OR len(matched) > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(year, 0) DESC, nth) <= 8)"""

FACTS = """,
f AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS fact_id, l_partkey AS source_id, CASE WHEN l_partkey % 7 = 0 THEN 'licensing' ELSE 'part ' || l_partkey END AS subject, CASE WHEN l_suppkey % 11 = 0 THEN 'than_ore' END AS object,
    l_linenumber = 7 AS recommends, CASE l_returnflag WHEN 'R' THEN 'version' WHEN 'A' THEN 'recovery' ELSE 'temperature' END AS property, l_quantity::DOUBLE AS lo, l_quantity + 20.0 AS hi, CASE WHEN l_returnflag = 'R' THEN 'percent' ELSE 'mg_l' END AS unit,
    (1 - l_discount)::DOUBLE AS confidence, (1 - l_tax)::DOUBLE AS extraction_confidence, l_tax > 0.05 AS suspicious FROM lineitem),
seen_facts AS (SELECT f.*, s.year, s.level FROM f LEFT JOIN sources s USING (source_id) WHERE s.source_id IS NOT NULL OR source_id NOT IN (SELECT doc_id FROM documents)),
wishes AS (SELECT *, list_distinct(list_concat(properties, CASE WHEN bound IS NOT NULL THEN ['version'] ELSE [] END)) AS props, list_concat(materials, processes) AS core, query_id IN (SELECT query_id FROM chosen) AS sourced FROM asked),
wished AS (
  SELECT w.query_id, f.*, sourced AND len(core) > 0 AND (list_has_any(core, coalesce(names, [])) OR list_contains(core, subject) OR coalesce(list_contains(core, object), false)) AS is_core,
    coalesce(bound IS NOT NULL AND property = 'version' AND unit = 'percent' AND lo <= bound, false) AS numeric_match
  FROM wishes w JOIN seen_facts f ON CASE WHEN sourced THEN (w.query_id, f.source_id) IN (SELECT (query_id, doc_id) FROM chosen) ELSE true END LEFT JOIN told ON told.doc_id = f.source_id
  WHERE (len(props) = 0 OR list_contains(props, property) OR recommends) AND (internal OR coalesce(level, 0) = 0) AND confidence >= min_confidence AND (NOT strict OR bound IS NULL OR (property = 'version' AND unit = 'percent' AND lo <= bound))),
found AS (
  SELECT * FROM (SELECT *, bool_or(is_core) OVER (PARTITION BY query_id) AS any_core FROM wished) WHERE is_core OR NOT any_core
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY numeric_match DESC, confidence DESC, year DESC NULLS LAST, fact_id) <= 24)"""


@query("WITH " + REQUESTS.strip() + """
SELECT query_id, array_to_string(materials, ',') AS materials, array_to_string(processes, ',') AS processes, array_to_string(equipment, ',') AS equipment, array_to_string(properties, ',') AS properties, array_to_string(geography, ',') AS geography,
  intent, year_from::INT AS year_from, year_to::INT AS year_to, CASE WHEN bound IS NOT NULL THEN 'version <= ' || bound::INT || ' percent' ELSE '' END AS conditions, array_to_string(tokens, ' ') AS tokens FROM asked""")
def b26_request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every request names: terms of five kinds, intent, years, numeric conditions, and its search tokens."""
    asked = asked_of(spark, sf_dir)[0]
    told = F.array_join(F.transform("conditions", lambda c: F.concat_ws(" ", c["property"], c["comparator"], c["value"].cast("int"), c["unit"])), "; ")
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return asked.select(
        "query_id", joined("materials", "materials"), joined("processes", "processes"), joined("equipment", "equipment"), joined("properties", "properties"), joined("geography_terms", "geography"),
        "intent", "year_from", "year_to", told.alias("conditions"), F.array_join("tokens", " ").alias("tokens"),
    )


@query("WITH " + REQUESTS.strip() + "\nSELECT query_id, doc_id AS source_id, method, score, array_to_string(matched, ',') AS matched_entities FROM chosen")
def c24_request_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every request: structured match, BM25, substrings or the most reliable ones, by the hybrid score."""
    asked, groups = asked_of(spark, sf_dir)
    found = request.documents(asked, groups, corpus(spark, sf_dir))
    return found.select("query_id", "source_id", "method", "score", F.array_join("matched_entities", ",").alias("matched_entities"))


@query("WITH " + REQUESTS.strip() + FACTS + "\nSELECT query_id, fact_id, numeric_match, source_id FROM found")
def c24_request_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every request, from the sources that it found."""
    asked, groups = asked_of(spark, sf_dir)
    held = corpus(spark, sf_dir)
    return request.facts(asked, request.documents(asked, groups, held), held).select("query_id", "fact_id", "numeric_match", "source_id")


ANSWERS = """,
tries AS (
  SELECT p_partkey AS key, lower(concat_ws(' ', p_name, CASE p_size % 3 WHEN 0 THEN 'than_ore' WHEN 1 THEN 'mit' END, CASE WHEN p_size % 4 = 0 THEN 'licensing' ELSE 'that run' END, '')) AS said, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'thonland' END AS place, 2000 + p_size AS year, p_size % 7 / 7.0::DOUBLE AS rel FROM part),
tested AS (
  SELECT query_id, key, title, tries.year, tries.place, rel, len(list_filter(materials, lambda m: contains(said, m))) AS n_m, len(list_filter(processes, lambda w: contains(said, w) OR contains(said, replace(w, '_', ' ')))) AS n_p,
    len(list_filter(list_concat(materials, processes), lambda w: contains(said, w))) > 0 AS near,
    (len(geography) = 0 OR coalesce(list_contains(geography, tries.place), false)) AND (year_from IS NULL OR tries.year >= year_from) AND (year_to IS NULL OR tries.year <= year_to)
      AND (len(materials) = 0 OR n_m > 0) AND (len(processes) = 0 OR n_p > 0 OR n_m >= 2) AS exact
  FROM asked, tries),
experiments AS (
  SELECT * FROM tested WHERE exact OR (near AND query_id NOT IN (SELECT query_id FROM tested WHERE exact))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, year DESC, key) <= 8),
clashes AS (
  SELECT query_id, subject, property, unit, count(*) AS n_facts, CASE WHEN max(lo) > min(hi) THEN 'contradiction' ELSE 'range_divergence' END AS kind FROM (SELECT * REPLACE (CASE WHEN subject = 'licensing' THEN 'Licensing' ELSE subject END AS subject) FROM found)
  GROUP BY query_id, subject, property, unit HAVING count(*) >= 2 AND (max(lo) > min(hi) OR count(DISTINCT (round(lo, 6), round(hi, 6))) > 1)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY subject, property, unit) <= 10),
missing AS (
  SELECT query_id, 'no_documents' AS gap FROM asked WHERE query_id NOT IN (SELECT query_id FROM chosen)
  UNION ALL SELECT query_id, 'no_experiments' FROM asked WHERE len(materials) + len(processes) > 0 AND query_id NOT IN (SELECT query_id FROM experiments)
  UNION ALL SELECT query_id, 'untested_pair' FROM asked WHERE list_contains(processes, 'licensing') AND list_contains(materials, 'apache') AND query_id NOT IN (SELECT query_id FROM experiments WHERE exact)
  UNION ALL SELECT query_id, 'no_numeric_match' FROM asked WHERE bound IS NOT NULL AND query_id IN (SELECT query_id FROM found) AND query_id NOT IN (SELECT query_id FROM found WHERE numeric_match)),
marks AS (
  SELECT query_id, rel::DOUBLE AS s FROM chosen UNION ALL SELECT query_id, unnest([confidence, extraction_confidence]) FROM found UNION ALL SELECT query_id, rel FROM experiments),
sums AS (
  SELECT a.query_id, (SELECT count(*) FROM chosen x WHERE x.query_id = a.query_id) AS n_docs, (SELECT count(*) FROM found x WHERE x.query_id = a.query_id) AS n_facts, (SELECT count(*) FROM experiments x WHERE x.query_id = a.query_id) AS n_tried,
    (SELECT count(*) FROM missing x WHERE x.query_id = a.query_id) AS n_gaps, (SELECT count(*) FROM clashes x WHERE x.query_id = a.query_id) AS n_clashes, (SELECT count(*) FROM found x WHERE x.query_id = a.query_id AND suspicious) AS n_doubt,
    (SELECT avg(s) FROM marks x WHERE x.query_id = a.query_id) AS mean FROM asked a),
answers AS (
  SELECT query_id, CASE WHEN n_gaps > 0 THEN 'gap_analysis' WHEN intent = 'comparison' THEN 'comparison' WHEN intent = 'experiments' THEN 'protocol' ELSE 'review' END AS mode, n_docs, n_facts, n_tried, n_gaps, n_clashes, n_doubt,
    CASE WHEN mean IS NULL THEN 0.2 ELSE round(least(1, greatest(0, mean + least(0.12, 0.02 * (n_docs + n_tried)) - least(0.25, 0.08 * n_gaps) - least(0.15, 0.05 * n_clashes) - least(0.12, 0.015 * n_doubt))), 2) END AS confidence
  FROM sums JOIN asked USING (query_id))"""


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rules = spark.createDataFrame(RULES, "gap string, process_terms array<string>, material_terms array<string>")
    return request.run(requests(spark, sf_dir), corpus(spark, sf_dir), terms_of(spark), spark.createDataFrame(UNITS, "canonical string, alias string"), rules, AS_OF_YEAR)


@query("WITH " + REQUESTS.strip() + FACTS + ANSWERS + "\nSELECT query_id, mode, confidence, n_gaps::INT AS gaps, n_clashes::INT AS contradictions, n_doubt::INT AS suspicious FROM answers")
def c24_request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and confidence of every request, and what they rest on."""
    return _run(spark, sf_dir)["answers"]


@query("WITH " + REQUESTS.strip() + FACTS + ANSWERS + """
SELECT query_id, '01 Answer' AS section, 1::BIGINT AS n_lines, md5(CASE WHEN n_docs > 0 THEN 'Found ' || n_docs || ' sources, ' || n_tried || ' experiments and ' || n_facts || ' facts. Confidence: ' || printf('%.2f', confidence) ELSE 'No sources found. Confidence: ' || printf('%.2f', confidence) END) AS said FROM answers
UNION ALL SELECT query_id, '03 Gap analysis', 1, md5('- Sources: ' || n_docs || '; facts: ' || n_facts || '; located: ' || n_facts) FROM answers WHERE mode = 'gap_analysis'
UNION ALL SELECT query_id, '06 Sources', count(*), md5(string_agg(nth || '. **' || label || '** ' || CASE WHEN id % 4 = 0 THEN 'public' ELSE 'internal' END || ', ' || printf('%.3f', score), chr(10) ORDER BY nth)) FROM (
  SELECT query_id, chosen.doc_id AS id, score, concat_ws(' / ', title, chosen.year, place) AS label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(chosen.year, 0) DESC, nth) AS nth FROM chosen JOIN sources ON source_id = chosen.doc_id) GROUP BY 1
UNION ALL SELECT query_id, '05 Experiments', count(*), md5(string_agg('- **' || key || ' ' || title || '** (' || concat_ws(', ', year, place) || ')', chr(10) ORDER BY exact DESC, rel DESC, year DESC, key)) FROM experiments GROUP BY 1
UNION ALL SELECT query_id, '07 Contradictions', count(*), md5(string_agg('- **' || subject || ' / ' || property || '**: ' || kind || ' of ' || n_facts, chr(10) ORDER BY subject, property, unit)) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY subject, property, unit) AS nth FROM clashes) WHERE nth <= 5 GROUP BY 1
UNION ALL SELECT query_id, '08 Gaps', count(*), md5(string_agg('- ' || gap, chr(10) ORDER BY gap)) FROM missing GROUP BY 1
UNION ALL SELECT query_id, '10 Conclusion', 1, md5(CASE WHEN n_gaps > 0 THEN 'A draft: gaps or divergences need an expert''s review.' ELSE 'Documents, experiments, conditions and experts suffice for a first review.' END) FROM answers""")
def c23_request_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sections of every request's report, each by its number of lines and a digest of them."""
    lines = report.sections(_run(spark, sf_dir)).where("section NOT IN ('02 Understood', '03 Comparison', '03 Protocol', '03 Evidence table', '04 Facts', '09 Experts')")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("query_id", "section").agg(F.count("*").alias("n_lines"), F.md5(body).alias("said"))


@query(RANKS + "\nSELECT query_id, doc_id AS document_id, round(rank, 6) AS rank FROM r")
def c2_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from a stored index that grew in two steps; only shards that may hold a wanted prefix are read."""
    chunks = mapping.chunks(spark, sf_dir)
    index = TextIndex(spark, shared_path(spark, "index"))
    index.add(chunks.where("document_id % 2 = 0"))
    index.add(chunks)
    wanted = spark.createDataFrame(WANTED, "query_id int, prefix string")
    return ranks(index.hits(wanted, chunks.schema["document_id"].dataType), wanted).select("query_id", "document_id", F.round("rank", 6).alias("rank"))
