"""Queries on the graph, dashboards and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.access import may_see
from ..operators import curate, dashboard, graph
from . import mapping
from .mapping import table
from .register import registry

QUERIES, ORACLES, query = registry()

AS_OF = "1997-01-01"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("""
WITH k AS (SELECT o_orderstatus AS type, o_orderpriority AS name, lower(trim(o_orderpriority)) AS normalized_name, o_orderkey AS seq FROM orders)
SELECT type, normalized_name, arg_min(name, seq) AS name, count(DISTINCT name) - 1 AS n_aliases FROM k GROUP BY 1, 2""")
def b19_upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("seq"))
    return graph.upsert_entities(hits).select("type", "normalized_name", "name", F.size("aliases").cast("long").alias("n_aliases"))


@query("""
WITH e AS (SELECT l_suppkey AS subject_id, l_partkey AS object_id, CASE WHEN l_quantity < 5 THEN NULL ELSE l_returnflag END AS evidence FROM lineitem)
SELECT subject_id, object_id, evidence, count(*) AS n FROM (SELECT DISTINCT * FROM e WHERE evidence IS NOT NULL UNION ALL SELECT * FROM e WHERE evidence IS NULL) GROUP BY ALL""")
def b20_insert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("object_id"), F.when(F.col("l_quantity") >= 5, F.col("l_returnflag")).alias("evidence"))
    return graph.insert_edges(edges, ("subject_id", "object_id", "evidence")).groupBy("subject_id", "object_id", "evidence").agg(F.count("*").alias("n"))


@query("""
SELECT id, type, name FROM (
  SELECT p_partkey AS id, 'Material' AS type, p_name AS name FROM part UNION ALL SELECT s_suppkey + 10000000, 'Process', s_name FROM supplier)
WHERE contains(lower(trim(name)), 'supplier#00000000') ORDER BY CASE WHEN lower(trim(name)) = 'supplier#00000000' THEN 0 ELSE 1 END, type, lower(name), id LIMIT 5""".replace("lower(name), id", "name, id"))
def d1_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup(mapping.supply_entities(spark, sf_dir), "Supplier#00000000")


PLACES = """
WITH RECURSIVE e AS (
  SELECT (n_nationkey + 101)::BIGINT AS a, (n_regionkey + 1)::BIGINT AS b FROM nation UNION ALL SELECT c_custkey + 1001, (c_nationkey + 101)::BIGINT FROM customer),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(seed, node, depth) AS (
  SELECT r_regionkey + 1, (r_regionkey + 1)::BIGINT, 0 FROM region
  UNION SELECT r.seed, b.b, r.depth + 1 FROM r JOIN b ON r.node = b.a WHERE r.depth < 2)
"""


@query(PLACES + "SELECT seed::BIGINT AS seed, count(DISTINCT node) AS reached FROM r GROUP BY 1")
def d3_reach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("seed"))
    return graph.reach_counts(mapping.place_edges(spark, sf_dir), seeds, 2)


@query(PLACES + "SELECT seed::BIGINT AS seed, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2")
def d2_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("seed"))
    return graph.neighborhood(mapping.place_edges(spark, sf_dir), seeds, 2, fan_out=1_000_000)


#: Budgets of the bounded neighborhoods below, and hops.
LIMIT, FAN_OUT, HOPS = 30, 12, 4

BOUNDED = f"""
WITH l AS (SELECT DISTINCT l_suppkey + 10000000 AS s, l_partkey AS p FROM lineitem),
g AS (SELECT s * 1000000 + p AS id, s, p FROM l WHERE p % 7 = 0 OR (p % 10) % 4 < 2),
both_ AS (SELECT s AS node, p AS other, id FROM g UNION ALL SELECT p, s, id FROM g),
e AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY node ORDER BY id) <= {FAN_OUT}),
f0 AS (SELECT s_nationkey AS seed, s_suppkey + 10000000 AS node, 0 AS depth, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier QUALIFY nth <= {LIMIT}),
seen0 AS (FROM f0)""" + "".join(f""",
w{h} AS (SELECT seed, nth AS by_, e.node, other, id, {h} AS depth FROM f{h - 1} JOIN e USING (node)),
f{h} AS (
  SELECT seed, node, {h} AS depth, taken + row_number() OVER (PARTITION BY seed ORDER BY found, node) AS nth FROM (
    SELECT seed, other AS node, min({{'by_': by_, 'id': id}}) AS found FROM w{h} WHERE (seed, other) NOT IN (SELECT (seed, node) FROM seen{h - 1}) GROUP BY ALL) JOIN (SELECT seed, count(*) AS taken FROM seen{h - 1} GROUP BY 1) USING (seed)
  QUALIFY nth <= {LIMIT}),
seen{h} AS (FROM seen{h - 1} UNION ALL FROM f{h})""" for h in range(1, HOPS + 1))


def _bounded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each nation as a seed that begins at its suppliers, over suppliers and parts; a part's number tells its edges' source, one in seven
    has none."""
    p = F.col("object_id")
    edges = mapping.supply_edges(spark, sf_dir).withColumns({"id": F.col("subject_id") * 1_000_000 + p, "source_id": F.when(p % 7 != 0, p % 10)})
    sources = spark.range(10).select("id", F.expr(mapping.LEVEL.format("id")).alias("confidentiality"))
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("seed"), (F.col("s_suppkey") + 10_000_000).alias("node"))
    return graph.bounded_graph(edges, seeds, HOPS, LIMIT, FAN_OUT, sources.where(may_see(F.col("confidentiality"), "researcher")))


@query(BOUNDED + f"SELECT seed, node, depth, nth::INT AS nth FROM seen{HOPS}")
def d2_bounded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within four hops of each seed, thirty at most, through edges that a researcher may see."""
    return _bounded(spark, sf_dir)[0].select("seed", "node", "depth", "nth")


@query(BOUNDED + f""",
met AS ({" UNION ALL ".join(f"FROM w{h}" for h in range(1, HOPS + 1))}),
once AS (SELECT seed, id, min({{'depth': depth, 'by_': by_}}) AS found FROM met WHERE (seed, node) IN (SELECT (seed, node) FROM seen{HOPS}) AND (seed, other) IN (SELECT (seed, node) FROM seen{HOPS}) GROUP BY ALL)
SELECT seed, g.id, s AS subject_id, p AS object_id, found.depth AS depth, row_number() OVER (PARTITION BY seed ORDER BY found, once.id)::INT AS nth FROM once JOIN g ON g.id = once.id QUALIFY nth <= {2 * LIMIT}""")
def d2_bounded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between those nodes, sixty a seed at most."""
    return _bounded(spark, sf_dir)[1]


@query("SELECT l_partkey::VARCHAR AS subject_id, count(*) AS n FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1")
def d4_fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.facts_of(mapping.facts(spark, sf_dir).withColumnRenamed("subject", "subject_id"), ["verified"])


@query("""
SELECT event_id AS id, user_id AS source_id FROM events WHERE user_id % 4 < 2 ORDER BY 1 LIMIT 200""")
def d5_edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.access import may_see

    edges = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"))
    sources = edges.select(F.col("source_id").alias("id")).distinct().withColumn("confidentiality", F.expr(mapping.LEVEL.format("id")))
    return graph.edge_scan(edges, sources, may_see(F.col("confidentiality"), "researcher"))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey + 10000000 AS s, l_partkey AS o FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 4),
d AS (SELECT node, count(*) AS edges FROM (SELECT s AS node FROM e UNION ALL SELECT o FROM e) GROUP BY 1 HAVING count(*) = 1),
n AS (SELECT p_partkey AS id, 'Material' AS type, p_name AS name FROM part UNION ALL SELECT s_suppkey + 10000000, 'Process', s_name FROM supplier)
SELECT id, type, name, edges FROM n JOIN d ON id = node ORDER BY type, name, id LIMIT 20""")
def d6_low_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity < 4").select((F.col("l_suppkey") + 10_000_000).alias("subject_id"), F.col("l_partkey").alias("object_id")).distinct().withColumn("id", F.xxhash64("subject_id", "object_id"))
    return graph.low_connectivity(mapping.supply_entities(spark, sf_dir), few, ["Process", "Material"])


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS o FROM lineitem),
m AS (SELECT DISTINCT CASE WHEN s % 10 = 0 AND s > 10 THEN 10 ELSE s END AS s, o FROM e)
SELECT s + 10000000 AS id, count(*) AS edges, sum(o)::BIGINT AS parts, CASE WHEN s = 10 THEN (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_suppkey % 10 = 0 AND s_suppkey > 10) ELSE '' END AS aliases FROM m WHERE s IN (SELECT s_suppkey FROM supplier) GROUP BY s""")
def d7_merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth supplier is merged into the first such one, which takes their names as aliases and their edges, each part once."""
    entities = mapping.supply_entities(spark, sf_dir).withColumns({"aliases": F.array().cast("array<string>")})
    edges = mapping.supply_edges(spark, sf_dir)
    pairs = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0 AND s_suppkey > 10").select((F.col("s_suppkey") + 10_000_000).alias("old_id"), F.lit(10_000_010).cast("long").alias("new_id"))
    facts = edges.select("id", "subject_id", "object_id")
    kept, _, merged = graph.merge_entities(entities, facts, edges, pairs)
    counts = merged.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("edges"), F.sum("object_id").alias("parts"))
    return kept.where("type = 'Process'").join(counts, "id").select("id", "edges", "parts", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT source AS source_type, count(*) AS n FROM documents GROUP BY 1")
def e1_sources_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counts_by(mapping.sources(spark, sf_dir), "source_type")


@query("SELECT 'Material' AS type, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'Process', count(DISTINCT l_suppkey) FROM lineitem")
def e2_entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.entities_by_type(mapping.supply_edges(spark, sf_dir), mapping.supply_entities(spark, sf_dir))


@query("SELECT CASE WHEN l_linestatus = 'O' THEN 'candidate' ELSE 'verified' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def e3_facts_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counts_by(mapping.facts(spark, sf_dir), "status")


@query("SELECT CASE WHEN l_tax > 0.05 THEN 'suspicious' ELSE 'valid' END AS validation_status, count(*) AS n FROM lineitem GROUP BY 1")
def e3_facts_by_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counts_by(mapping.facts(spark, sf_dir), "validation_status")


@query("SELECT l_returnflag AS property, count(*) AS facts, count(DISTINCT l_suppkey) AS sources, count(*) FILTER (l_linestatus <> 'O') AS verified, count(*) FILTER (l_tax > 0.05) AS flagged FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def e4_property_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.coverage_by_property(mapping.facts(spark, sf_dir))


YEARS = "(SELECT doc_id AS id, CASE WHEN doc_id % 16 < 15 THEN 2010 + doc_id % 16 END AS year FROM documents)"


@query(f"SELECT coalesce(year::VARCHAR, 'unknown') AS year, n FROM (SELECT year, count(*) AS n FROM {YEARS} GROUP BY 1 ORDER BY coalesce(year, 0) DESC LIMIT 20)")
def e5_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.freshness(mapping.sources(spark, sf_dir))


@query(f"SELECT id, year::INT AS year FROM {YEARS} WHERE year IS NULL OR year < 2019 ORDER BY year NULLS FIRST, id LIMIT 25")
def e6_stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.stale_list(mapping.sources(spark, sf_dir), 2024).select("id", "year")


DISPUTES = """
WITH d AS (SELECT o_orderkey AS id, CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END AS status, CASE WHEN o_orderpriority[1] <> '5' THEN o_orderdate + INTERVAL 30 DAYS END AS due_at FROM orders)
"""


@query(DISPUTES + "SELECT severity, status, count(*) AS n FROM d GROUP BY 1, 2")
def e7_disputes_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.disputes_by_severity(mapping.disputes(spark, sf_dir))


@query(DISPUTES + f"SELECT id, due_at FROM d WHERE status <> 'resolved' AND due_at < TIMESTAMP '{AS_OF}' ORDER BY due_at, id LIMIT 25")
def e8_overdue_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.overdue_list(mapping.disputes(spark, sf_dir), _as_of()).select("id", "due_at")


@query("SELECT user_id::VARCHAR AS reviewer, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1")
def e9_reviewer_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.reviewer_activity(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("reviewer"), F.col("ts").alias("created_at")))


@query("SELECT CASE WHEN event_type LIKE 'p%' THEN 'p' ELSE 'cl' END AS prefix, 'role' || (user_id % 3) AS role, count(*) AS n FROM events WHERE event_type LIKE 'p%' OR event_type LIKE 'cl%' GROUP BY 1, 2")
def e10_audit_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.concat(F.lit("role"), F.col("user_id") % 3).alias("role"))
    return dashboard.audit_activity(audit, ["p", "cl"])


@query("SELECT p_type AS process, count(*) AS n FROM part GROUP BY 1")
def e11_experiments_by_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counts_by(table(spark, sf_dir, "part"), "p_type", "process")


@query(DISPUTES + f"""
SELECT (SELECT count(*) FROM documents) AS sources, (SELECT count(*) FROM {YEARS} WHERE year IS NULL OR year < 2019) AS stale_sources, count(*) AS facts,
  count(*) FILTER (l_linestatus <> 'O') AS verified_facts, 0::BIGINT AS contradicted_facts, count(*) FILTER (l_tax > 0.05) AS flagged_facts,
  (SELECT count(*) FROM d WHERE status <> 'resolved') AS open_disputes, (SELECT count(*) FROM d WHERE status <> 'resolved' AND due_at < TIMESTAMP '{AS_OF}') AS overdue_disputes FROM lineitem""")
def e12_manager_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.manager_summary(mapping.sources(spark, sf_dir), mapping.facts(spark, sf_dir), mapping.disputes(spark, sf_dir), _as_of(), 2024)


BOARD = DISPUTES.replace("WITH d AS", "WITH d0 AS") + f""",
s AS (SELECT doc_id AS id, source AS source_type, CASE WHEN doc_id % 16 < 15 THEN 2010 + doc_id % 16 END AS year FROM documents WHERE doc_id % 4 < 2),
f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source_id, l_returnflag AS property, CASE WHEN l_linestatus = 'O' THEN 'candidate' ELSE 'verified' END AS status, CASE WHEN l_tax > 0.05 THEN 'suspicious' ELSE 'valid' END AS validation_status FROM lineitem WHERE l_partkey IN (SELECT id FROM s)),
e AS (SELECT DISTINCT l_suppkey + 10000000 AS a, l_partkey AS b FROM lineitem WHERE l_partkey IN (SELECT id FROM s)),
d AS (SELECT * FROM d0 WHERE id * 10 + 1 IN (SELECT id FROM f)),
v AS (SELECT event_type AS reviewer FROM events WHERE user_id * 10 + 1 IN (SELECT id FROM f)),
ends AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e),
low AS (SELECT 'Material' AS type, p_name AS name, node FROM ends JOIN part ON p_partkey = node GROUP BY ALL HAVING count(*) = 1 UNION ALL SELECT 'Process', s_name, node FROM ends JOIN supplier ON s_suppkey + 10000000 = node GROUP BY ALL HAVING count(*) = 1),
late AS (SELECT * FROM d WHERE status <> 'resolved' AND due_at < TIMESTAMP '{AS_OF}')
"""


@query(BOARD + """
SELECT 'sources_by_type' AS panel, source_type AS key, count(*) AS n FROM s GROUP BY 2
UNION ALL SELECT 'entities_by_type', CASE WHEN node >= 10000000 THEN 'Process' ELSE 'Material' END, count(DISTINCT node) FROM ends GROUP BY 2
UNION ALL SELECT 'facts_by_status', status, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'facts_by_validation', validation_status, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'coverage', property || ':' || unnest(['facts', 'sources', 'verified', 'flagged']), unnest([count(*), count(DISTINCT source_id), count(*) FILTER (status = 'verified'), count(*) FILTER (validation_status = 'suspicious')]) FROM f GROUP BY property
UNION ALL SELECT 'freshness', coalesce(year::VARCHAR, 'unknown'), count(*) FROM s GROUP BY year
UNION ALL (SELECT 'stale', id::VARCHAR, coalesce(year, 0) FROM s WHERE year IS NULL OR year < 2019 ORDER BY year NULLS FIRST, id LIMIT 25)
UNION ALL SELECT 'disputes', severity || ':' || status, count(*) FROM d GROUP BY 2
UNION ALL (SELECT 'overdue', id::VARCHAR, 1 FROM late ORDER BY due_at, id LIMIT 25)
UNION ALL SELECT 'reviewers', reviewer, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'experiments', p_type, count(*) FROM part GROUP BY 2
UNION ALL (SELECT 'low_connectivity', name, 1 FROM low ORDER BY type, name, node LIMIT 20)
UNION ALL SELECT 'summary', unnest(['sources', 'stale_sources', 'facts', 'verified_facts', 'contradicted_facts', 'flagged_facts', 'open_disputes', 'overdue_disputes']), unnest([(SELECT count(*) FROM s), (SELECT count(*) FROM s WHERE year IS NULL OR year < 2019), (SELECT count(*) FROM f),
  (SELECT count(*) FROM f WHERE status = 'verified'), 0, (SELECT count(*) FROM f WHERE validation_status = 'suspicious'), (SELECT count(*) FROM d WHERE status <> 'resolved'), (SELECT count(*) FROM late)])""")
def e_board_under_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every panel of the dashboard as a researcher sees it; half of the documents, and most parts, are hidden or no sources."""
    facts = mapping.facts(spark, sf_dir).withColumn("source_id", F.col("subject").cast("long"))
    edges = mapping.supply_edges(spark, sf_dir).withColumn("source_id", F.col("object_id"))
    disputes = mapping.disputes(spark, sf_dir).withColumn("fact_id", F.col("id") * 10 + 1)
    reviews = mapping.reviews(spark, sf_dir).select((F.col("fact_id") * 10 + 1).alias("fact_id"), "reviewer", F.col("at").alias("created_at"))
    panels = dashboard.board(mapping.sources(spark, sf_dir), facts, edges, mapping.supply_entities(spark, sf_dir), disputes, reviews, table(spark, sf_dir, "part").select(F.col("p_type").alias("process")), may_see(F.col("confidentiality"), "researcher"), _as_of(), 2024)
    keys = {"sources_by_type": "source_type", "entities_by_type": "type", "facts_by_status": "status", "facts_by_validation": "validation_status", "freshness": "year", "reviewers": "reviewer", "experiments": "process"}
    each = lambda names: F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("long").alias("n")) for c in names)))
    row = lambda panel, key, n=F.col("n"): panels[panel].select(F.lit(panel).alias("panel"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    out = [row(panel, F.col(key)) for panel, key in keys.items()]
    out += [row("stale", F.col("id"), F.coalesce("year", F.lit(0))), row("disputes", F.concat_ws(":", "severity", "status")), row("overdue", F.col("id"), F.lit(1)), row("low_connectivity", F.col("name"), F.col("edges"))]
    out.append(panels["coverage"].select("property", each(["facts", "sources", "verified", "flagged"]).alias("x")).select(F.lit("coverage").alias("panel"), F.concat_ws(":", "property", "x.c").alias("key"), "x.n"))
    out.append(panels["summary"].select(each(panels["summary"].columns).alias("x")).select(F.lit("summary").alias("panel"), F.col("x.c").alias("key"), "x.n"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


REVIEWS = """
WITH c AS (SELECT event_id AS seq, user_id AS fact_id, ts, CASE event_type WHEN 'click' THEN 'verify' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'comment' WHEN 'purchase' THEN 'contradict' ELSE 'supersede' END AS action, event_type FROM events)
"""


def _user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().select("id", F.lit("candidate").alias("status"), none.cast("string").alias("verified_by"), none.cast("timestamp_ntz").alias("verified_at"))


@query(REVIEWS + """
SELECT fact_id AS id, coalesce(CASE arg_max(action, seq) FILTER (action <> 'comment') WHEN 'verify' THEN 'verified' WHEN 'reject' THEN 'rejected' WHEN 'contradict' THEN 'contradicted' WHEN 'supersede' THEN 'superseded' END, 'candidate') AS status,
  CASE WHEN arg_max(action, seq) FILTER (action <> 'comment') = 'verify' THEN arg_max(ts, seq) FILTER (action <> 'comment') END AS verified_at FROM c GROUP BY 1""")
def f1_review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _, _ = curate.review_facts(_user_facts(spark, sf_dir), mapping.reviews(spark, sf_dir))
    return after.select("id", "status", "verified_at")


ASSIGN = """
WITH c AS (SELECT event_id AS seq, user_id AS fact_id, CASE event_type WHEN 'view' THEN 'assign' WHEN 'click' THEN 'assign' WHEN 'purchase' THEN 'complete' ELSE 'release' END AS action, event_type AS assignee, ts AS moment FROM events),
w AS (SELECT *, lag(action) OVER o AS before, lead(action) OVER o AS next, lead(moment) OVER o AS until FROM c WINDOW o AS (PARTITION BY fact_id ORDER BY seq))
"""


def _assign_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type").isin("view", "click"), "assign").when(F.col("event_type") == "purchase", "complete").otherwise("release")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("fact_id"), action.alias("action"), F.col("event_type").alias("assignee"), F.col("ts").alias("at"))


@query(ASSIGN + "SELECT seq, fact_id, assignee, until AS released_at, CASE WHEN next IS NULL THEN 'active' WHEN next = 'complete' THEN 'completed' ELSE 'released' END AS status FROM w WHERE action = 'assign'")
def f2_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.assign_facts(_assign_commands(spark, sf_dir))[0].select("seq", "fact_id", "assignee", "released_at", "status")


@query(ASSIGN + """, a AS (SELECT seq, fact_id, moment, until, CASE WHEN next IS NULL THEN 'active' WHEN next = 'complete' THEN 'completed' ELSE 'released' END AS status FROM w WHERE action = 'assign'),
d AS (SELECT a.seq, min(e.ts) AS closed FROM a JOIN events e ON a.fact_id = e.user_id AND e.ts >= a.moment AND e.event_type <> 'view' WHERE status = 'active' GROUP BY 1)
SELECT a.seq, fact_id, coalesce(closed, until) AS released_at, CASE WHEN closed IS NOT NULL THEN 'completed' ELSE status END AS status FROM a LEFT JOIN d ON a.seq = d.seq""")
def f1_closed_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that change a status complete the active assignment of their fact."""
    decided = mapping.reviews(spark, sf_dir).where("action <> 'comment'").select("fact_id", "at")
    return curate.close_assignments(curate.assign_facts(_assign_commands(spark, sf_dir))[0], decided).select("seq", "fact_id", "released_at", "status")


@query(ASSIGN + "SELECT seq, fact_id FROM w WHERE action <> 'assign' AND before IS DISTINCT FROM 'assign'")
def f2_rejected_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.assign_facts(_assign_commands(spark, sf_dir))[1].select("seq", "fact_id")


@query("""
WITH c AS (SELECT user_id AS dispute_id, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'open' WHEN event_type = 'purchase' THEN 'resolve' ELSE 'comment' END AS action, ts FROM events),
f AS (SELECT *, min(seq) FILTER (action = 'resolve') OVER (PARTITION BY dispute_id) AS done FROM c)
SELECT dispute_id, CASE WHEN max(done) IS NULL THEN 'open' ELSE 'resolved' END AS status, count(*) FILTER (action = 'comment') AS n_comments,
  count(*) FILTER (action = 'resolve' AND seq > done) AS n_rejected, arg_min(ts, seq) FILTER (action = 'resolve') AS resolved_at FROM f GROUP BY 1""")
def f3_dispute_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    none = lambda kind: F.lit(None).cast(kind)
    commands = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("dispute_id"), F.col("user_id").alias("fact_id"), F.col("event_id").alias("seq"), F.when(nth == 1, "open").when(F.col("event_type") == "purchase", "resolve").otherwise("comment").alias("action"),
        F.lit("low").alias("severity"), none("string").alias("assignee"), F.lit("me").alias("actor"), none("timestamp").alias("due_at"), none("string").alias("resolution"), none("string").alias("fact_status"), F.col("ts").alias("at"),
    )
    return curate.fold_disputes(commands).select("dispute_id", "status", "n_comments", F.size("rejected").cast("long").alias("n_rejected"), F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"))


#: Events as commands on their users' disputes, of all kinds and in any order.
SETTLED = """
WITH c AS (
  SELECT user_id AS d, event_id AS seq, ts, event_type AS actor, CASE event_id % 7 WHEN 2 THEN 'assign' WHEN 3 THEN 'escalate' WHEN 4 THEN 'open' WHEN 5 THEN 'escalate' WHEN 6 THEN CASE WHEN event_id % 5 = 0 THEN 'resolve' ELSE 'close' END ELSE 'comment' END AS action,
    CASE WHEN event_id % 7 = 4 THEN 'medium' WHEN event_id % 14 = 5 THEN 'high' WHEN event_id % 14 = 12 THEN '' END AS severity FROM events),
o AS (SELECT *, min(seq) FILTER (action = 'open') OVER (PARTITION BY d) AS o FROM c),
e AS (SELECT *, min(seq) FILTER (action = 'resolve' AND seq > o) OVER (PARTITION BY d) AS e FROM o),
v AS (SELECT * FROM e WHERE seq = o OR (seq > o AND (action = 'comment' OR seq = e OR (action IN ('assign', 'escalate') AND (e IS NULL OR seq < e))))),
n AS (SELECT *, max(seq) FILTER (action = 'escalate' AND severity <> '') OVER (PARTITION BY d) AS named FROM v),
s AS (
  SELECT d, max(e) AS e, count(*) FILTER (action = 'comment') AS n_comments, count(*) FILTER (action = 'escalate') AS escalations, count(*) FILTER (action = 'escalate' AND coalesce(severity, '') = '' AND seq > coalesce(named, -1)) AS steps, max(named) AS named,
    arg_max(seq, seq) FILTER (action = 'assign') AS assigned, arg_max(actor, seq) FILTER (action = 'resolve') AS resolved_by, max(ts) FILTER (action = 'escalate') AS escalated_at FROM n GROUP BY 1)
"""


def _settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    i, none = F.col("event_id"), F.lit(None)
    kind = F.when(i % 7 == 2, "assign").when((i % 7 == 3) | (i % 7 == 5), "escalate").when(i % 7 == 4, "open").when((i % 7 == 6) & (i % 5 == 0), "resolve").when(i % 7 == 6, "close").otherwise("comment")
    return curate.settle_disputes(table(spark, sf_dir, "events").select(
        F.col("user_id").alias("dispute_id"), F.col("user_id").alias("fact_id"), i.alias("seq"), kind.alias("action"), F.when(i % 7 == 4, "medium").when(i % 14 == 5, "high").when(i % 14 == 12, "").alias("severity"),
        F.concat(F.lit("a"), i).alias("assignee"), F.col("event_type").alias("actor"), none.cast("timestamp_ntz").alias("due_at"), none.cast("string").alias("resolution"), F.when(i % 2 == 0, "verified").alias("fact_status"), F.col("ts").alias("at"),
    ))


@query(SETTLED + """
SELECT s.d AS dispute_id, CASE WHEN e IS NOT NULL THEN 'resolved' WHEN escalations > 0 THEN 'escalated' ELSE 'open' END AS status, ['low', 'medium', 'high', 'critical'][least(CASE WHEN named IS NULL THEN 1 ELSE 2 END + steps, 3) + 1] AS severity,
  'a' || coalesce(assigned, (SELECT min(o) FROM o WHERE o.d = s.d)) AS assignee, resolved_by, CASE WHEN e % 2 = 0 THEN 'verified' ELSE 'contradicted' END AS fact_status, n_comments, escalated_at FROM s""")
def f3_dispute_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputes after openings, comments, escalations, assignments and resolutions."""
    return _settled(spark, sf_dir)[0].select("dispute_id", "status", "severity", "assignee", "resolved_by", "fact_status", "n_comments", "escalated_at")


@query(SETTLED + """
SELECT 'review' AS kind, d AS id, seq, CASE action WHEN 'open' THEN 'open_dispute' ELSE 'resolve_dispute' END AS action, actor FROM v WHERE action IN ('open', 'resolve')
UNION ALL SELECT 'comment', d, seq, NULL, actor FROM v WHERE action = 'comment' UNION ALL SELECT 'reject', d, seq, action, actor FROM c WHERE seq NOT IN (SELECT seq FROM v)""")
def f3_dispute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews and comments that disputes leave, and the commands that did not apply."""
    _, comments, reviews, rejects = _settled(spark, sf_dir)
    out = reviews.select(F.lit("review").alias("kind"), F.col("fact_id").alias("id"), "seq", "action", F.col("reviewer").alias("actor"))
    out = out.unionByName(comments.select(F.lit("comment").alias("kind"), F.col("dispute_id").alias("id"), F.col("comment_id").alias("seq"), F.lit(None).cast("string").alias("action"), F.col("author").alias("actor")))
    return out.unionByName(rejects.select(F.lit("reject").alias("kind"), F.col("dispute_id").alias("id"), "seq", "action", "actor"))


@query(DISPUTES + f"""
SELECT d.id, CASE WHEN status = 'resolved' THEN 'closed' WHEN due_at IS NULL THEN 'unassigned_sla' WHEN due_at < TIMESTAMP '{AS_OF}' THEN 'overdue' ELSE 'within_sla' END AS sla_state, coalesce(n, 0) AS n_comments
FROM d LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = d.id""")
def f4_dispute_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("dispute_id"))
    return curate.dispute_list(mapping.disputes(spark, sf_dir), comments, _as_of()).select("id", "sla_state", "n_comments")


@query("""
SELECT o_orderkey AS id, CASE WHEN n.new_id IS NOT NULL THEN 'superseded' ELSE 'candidate' END AS status, CASE WHEN p.prev IS NOT NULL THEN 2 ELSE 1 END AS version, p.prev AS supersedes_fact_id
FROM orders o LEFT JOIN (SELECT o_orderkey AS old_id, o_orderkey + 1 AS new_id FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders)) n ON n.old_id = o_orderkey
LEFT JOIN (SELECT o_orderkey + 1 AS new_id, o_orderkey AS prev FROM orders WHERE o_orderkey % 4 = 1) p ON p.new_id = o_orderkey""")
def f5_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order's fact is replaced by the next one's."""
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("candidate").alias("status"), F.lit(1).alias("version"), F.lit(None).cast("long").alias("supersedes_fact_id"))
    pairs = facts.where("id % 4 = 1").select(F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"))
    pairs = pairs.join(facts.select(F.col("id").alias("new_id")), "new_id", "left_semi")
    return curate.supersede_facts(facts, pairs)


@query("""
SELECT user_id AS id, count(*) AS n_reviews, min(event_id) AS first_seq FROM events GROUP BY 1""")
def f6_fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _user_facts(spark, sf_dir).withColumn("supersedes_fact_id", F.lit(None).cast("long"))
    assignments, _ = curate.assign_facts(_assign_commands(spark, sf_dir))
    disputes = mapping.disputes(spark, sf_dir).select(F.col("id").alias("dispute_id"), "fact_id", "severity")
    history = curate.fact_history(facts, mapping.reviews(spark, sf_dir), assignments, disputes)
    return history.select("id", F.size("reviews").cast("long").alias("n_reviews"), F.element_at("reviews", 1)["seq"].alias("first_seq"))


#: Orders as facts in chains: each customer's orders replace one another in the order of their numbers, and every eleventh order is no fact.
CHAINED = """
WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey, 1 + o_orderkey % 3 AS version FROM orders WHERE o_orderkey % 11 <> 5),
cmd AS (SELECT o_orderkey AS seq, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old_id, o_orderkey AS new_id FROM orders),
valid AS (SELECT * FROM cmd WHERE old_id IN (SELECT id FROM o) AND new_id IN (SELECT id FROM o)),
walk(id, version, root, place) AS (
  SELECT id, version, id, 0::BIGINT FROM o WHERE id NOT IN (SELECT new_id FROM valid)
  UNION ALL SELECT o.id, greatest(o.version, w.version + 1), w.root, w.place + 1 FROM walk w JOIN valid ON old_id = w.id JOIN o ON o.id = new_id)
"""


def _chained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    rows = orders.where("o_orderkey % 11 <> 5").select(F.col("o_orderkey").alias("id"), F.lit("candidate").alias("status"), (F.lit(1) + F.col("o_orderkey") % 3).cast("long").alias("version"), F.lit(None).cast("long").alias("supersedes_fact_id"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    commands = orders.select(F.col("o_orderkey").alias("seq"), before.alias("old_id"), F.col("o_orderkey").alias("new_id"), F.lit("r").alias("reviewer"), F.lit("analyst").alias("role"), F.lit(None).cast("string").alias("comment")).where("old_id IS NOT NULL")
    return curate.supersede_chains(rows, commands)


@query(CHAINED + "SELECT w.id, CASE WHEN w.id IN (SELECT old_id FROM valid) THEN 'superseded' ELSE 'candidate' END AS status, version::BIGINT AS version, old_id AS supersedes_fact_id FROM walk w LEFT JOIN valid ON new_id = w.id")
def f5_supersede_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as one chain of replacements, in one call."""
    return _chained(spark, sf_dir)[0]


@query(CHAINED + """,
h AS (
  SELECT user_id AS id, 'review' AS kind, event_id AS ref, event_type AS actor, CASE event_type WHEN 'click' THEN 'verify' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'comment' WHEN 'purchase' THEN 'contradict' ELSE 'supersede' END AS said FROM events
  UNION ALL SELECT o_custkey, 'assignment', o_orderkey, o_orderstatus, 'active' FROM orders
  UNION ALL SELECT o_custkey, 'dispute', o_orderkey, NULL, CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END || ' ' || CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END FROM orders
  UNION ALL SELECT o_custkey, 'dispute_comment', l_linenumber, l_returnflag, 'part ' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT new_id, 'supersedes', old_id, NULL, CASE WHEN new_id IN (SELECT old_id FROM valid) THEN 'superseded' ELSE 'candidate' END FROM valid
  UNION ALL SELECT old_id, 'superseded_by', new_id, NULL, CASE WHEN new_id IN (SELECT old_id FROM valid) THEN 'superseded' ELSE 'candidate' END FROM valid
  UNION ALL SELECT id, 'chain', root, NULL, place::VARCHAR FROM walk WHERE place > 0)
SELECT kind, id, count(*) AS n, sum(ref)::BIGINT AS refs, min(actor) AS first_actor, min(said) AS first_said, max(said) AS last_said FROM h WHERE id IN (SELECT id FROM o) GROUP BY 1, 2""")
def f6_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that happened to each fact: reviews, assignments, disputes with comments, replacements and chains."""
    rows, orders = _chained(spark, sf_dir)[0], table(spark, sf_dir, "orders")
    assignments = orders.select(F.col("o_custkey").alias("fact_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("assignee"), F.lit("active").alias("status"))
    disputes = mapping.disputes(spark, sf_dir).select(F.col("id").alias("dispute_id"), "fact_id", "severity", "status")
    comments = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dispute_id"), F.col("l_linenumber").alias("comment_id"), F.col("l_returnflag").alias("author"), F.concat(F.lit("part "), "l_partkey").alias("comment"))
    found = curate.history_rows(rows, mapping.reviews(spark, sf_dir), assignments, disputes, comments)
    return found.groupBy("kind", "id").agg(F.count("*").alias("n"), F.sum("ref").alias("refs"), F.min("actor").alias("first_actor"), F.min("said").alias("first_said"), F.max("said").alias("last_said"))


@query("""
WITH a AS (SELECT event_id, user_id FROM events)
SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linestatus = 'O' ORDER BY 1 - l_discount DESC, 1 DESC LIMIT 100""".replace("WITH a AS (SELECT event_id, user_id FROM events)\n", ""))
def f7_pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignments, _ = curate.assign_facts(_assign_commands(spark, sf_dir))
    return curate.pending_queue(mapping.facts(spark, sf_dir), assignments).select("id")
