"""Queries on access, inspection, export and the directory, and on quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access
from ..operators import evaluate, governance
from . import mapping
from .mapping import table
from .register import registry

QUERIES, ORACLES, query = registry()

LEVEL = "(['public', 'internal', 'confidential', 'secret'])[({0} % 4) + 1]"
ROLE = "(['external_partner', 'researcher', 'analyst', 'manager', 'admin'])[(c_custkey % 5) + 1]"


@query(f"SELECT doc_id AS id, {LEVEL.format('doc_id')} AS confidentiality FROM documents WHERE doc_id % 4 < 3")
def g1_confidentiality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.sources(spark, sf_dir).where(access.may_see(F.col("confidentiality"), "analyst")).select("id", "confidentiality")


@query(f"""
WITH s AS (SELECT doc_id AS id, doc_id % 4 AS level, CASE WHEN doc_id % 3 = 0 THEN 'building' END AS department FROM documents),
u AS (SELECT DISTINCT c_custkey % 5 AS rank, lower(c_mktsegment) AS department FROM customer),
see AS (SELECT *, CASE WHEN rank >= 3 THEN 3 ELSE rank END AS top FROM u)
SELECT see.rank AS rank, see.department AS department, count(*) AS visible FROM s JOIN see ON s.level <= see.top AND (see.rank = 4 OR s.department IS NULL OR s.department = see.department) GROUP BY 1, 2""")
def g2_attribute_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of user (role and department) may see; kinds are few, and they are broadcast by Spark's own choice."""
    sources = mapping.sources(spark, sf_dir).select("id", "confidentiality", F.when(F.col("id") % 3 == 0, F.array(F.lit("Building"))).alias("departments"))
    kinds = mapping.users(spark, sf_dir).select("role", "department").distinct()
    none = F.lit(None).cast("string")
    allowed = access.may_access(F.col("confidentiality"), F.col("departments"), F.lit(None).cast("array<string>"), none, F.col("role"), F.col("department"), none, none)
    return sources.join(kinds, allowed).groupBy(access.rank_of(F.col("role"), access.ROLES).cast("long").alias("rank"), "department").agg(F.count("*").alias("visible"))


@query("SELECT c_custkey, c_name AS name, '[MASKED]' AS contact, '[SECRET]' AS api_key FROM customer")
def g4_mask_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("contact"), F.col("c_name").alias("api_key"))
    return access.mask_fields(rows, "researcher")


@query(r"""
WITH r(rule, pattern) AS (VALUES ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ('card', '(?:^|[^0-9])[0-9]{16}(?:[^0-9]|$)'), ('secret', '(?i)(?:password|secret|token|api_?key) *[:=] *["'']?[A-Za-z0-9+/_.=-]{8,}')),
c AS (SELECT rule, doc_id, len(regexp_extract_all(text, pattern)) AS n FROM documents, r)
SELECT rule, sum(n)::BIGINT AS matches, array_to_string(list_slice(list(doc_id || ':text' ORDER BY doc_id), 1, 5), ' ') AS paths FROM c WHERE n > 0 GROUP BY 1""")
def g5_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = governance.string_paths(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return governance.inspect(texts).select("rule", "matches", F.array_join("paths", " ").alias("paths"))


@query(f"SELECT source, array_to_string(list_sort(list(DISTINCT {LEVEL.format('doc_id')})), ',') AS levels, {LEVEL.format('max(doc_id % 4)')} AS max_level FROM documents GROUP BY 1")
def g6_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.classify(mapping.sources(spark, sf_dir).withColumnRenamed("title", "source"), "source").withColumn("levels", F.array_join("levels", ","))


@query(f"""
WITH q AS (SELECT c_custkey, c_custkey % 5 AS rank, c_custkey % 4 AS level, c_acctbal < 0 AS blocked FROM customer)
SELECT c_custkey, NOT blocked AND level <= CASE rank WHEN 4 THEN 3 WHEN 3 THEN 2 ELSE rank END AS allowed,
  CASE WHEN blocked THEN 'blocked_by_rule' WHEN level <= CASE rank WHEN 4 THEN 3 WHEN 3 THEN 2 ELSE rank END THEN 'allowed' ELSE 'role_below_level' END AS reason FROM q""")
def g7_export_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").join(mapping.users(spark, sf_dir).select(F.col("id").cast("long").alias("c_custkey"), "role"), "c_custkey").withColumns({"max_level": F.expr(mapping.LEVEL.format("c_custkey")), "blocked": F.col("c_acctbal") < 0})
    return governance.export_decisions(asked).select("c_custkey", "allowed", "reason")


@query("""
SELECT n_regionkey, sha256(array_to_string(list(sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') ORDER BY sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}')), '')) AS payload_hash FROM nation GROUP BY 1""")
def g8_payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.payload_hash(table(spark, sf_dir, "nation"), "n_regionkey")


@query("""
WITH u AS (SELECT o_orderkey AS seq, o_custkey AS id, o_orderstatus, o_orderdate FROM orders),
t AS (SELECT u.*, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_custkey % 3 = 0 THEN 'not_approved' WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'expired' WHEN o_orderstatus <> 'F' THEN 'mismatch' END AS bad FROM u LEFT JOIN customer ON c_custkey = id)
SELECT seq, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY id, bad IS NULL ORDER BY seq) > 1 THEN 'already_used' ELSE 'used' END) AS outcome FROM t""")
def g9_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders use their customers' approvals: pending for one in three, expired in 1997, for finished orders only."""
    fixed = {"requester": F.lit("r"), "action": F.lit("export"), "export_format": F.lit("csv"), "object_type": F.lit("o"), "payload_hash": F.lit("h")}
    approvals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("approved").alias("status"), F.lit("1997-01-01").cast("timestamp_ntz").alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("consumed_at"), F.lit("F").alias("object_id")).withColumns(fixed)
    uses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("object_id"), F.col("o_orderdate").alias("at")).withColumns(fixed)
    return governance.consume_approvals(approvals, uses)[1].select("seq", "outcome")


@query("""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN true WHEN event_type = 'purchase' THEN user_id % 2 = 0 ELSE false END AS allowed,
  CASE WHEN event_type IN ('view', 'click') THEN 'role_allowed' WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'role_allowed' WHEN event_type = 'purchase' THEN 'role_not_allowed' ELSE 'unknown_action' END AS reason FROM events""")
def g10_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame([("view", ["analyst", "viewer"]), ("click", ["analyst", "viewer"]), ("purchase", ["analyst"])], "action string, roles array<string>")
    asked = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"), F.when(F.col("user_id") % 2 == 0, "analyst").otherwise("viewer").alias("role"))
    return governance.policy_decisions(asked, policies).select("event_id", "allowed", "reason")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500")
def g11_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action"))
    return governance.log_page(log, action="error").select("id", "created_at")


@query("SELECT c_custkey, c_name AS plain, true AS sealed, '[ENCRYPTED]' AS without_key FROM customer")
def g13_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lit("0123456789abcdef")
    # a nonce is drawn for each value, so the sealed text is another one each time; that it opens again is what counts
    rows = table(spark, sf_dir, "customer").select("c_custkey", governance.encrypt(F.col("c_name"), key).alias("sealed"))
    return rows.select("c_custkey", governance.decrypt(F.col("sealed"), key).alias("plain"), F.col("sealed").startswith(governance.PREFIX).alias("sealed"), governance.decrypt(F.col("sealed"), None).alias("without_key"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 5 = 1 THEN 'created' WHEN c_custkey % 5 = 2 THEN 'updated' ELSE 'unchanged' END AS change FROM customer""")
def g14_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("user_name"), F.col("c_acctbal").alias("amount"))
    new = rows.where("id % 5 <> 0").withColumn("amount", F.when(F.col("id") % 5 == 2, F.col("amount") + 1).otherwise(F.col("amount")))
    return governance.snapshot_diff(rows.where("id % 5 <> 1"), new, "id")


@query("""
SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 IN (1, 2) THEN 'manager' ELSE """ + ROLE + """ END AS role, CASE WHEN c_custkey % 5 IN (1, 2) THEN true ELSE c_custkey % 7 > 0 END AS active FROM customer""")
def g14a_directory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = mapping.users(spark, sf_dir).drop("nation")
    kind = F.col("id").cast("long") % 5
    snapshot = users.where(kind > 0).select("id", "user_name", F.when(kind <= 2, "Manager").otherwise("nobody").alias("role"), "department", F.lit(True).alias("active"))
    return governance.sync_users(users, snapshot, F.lit("1998-01-01").cast("timestamp_ntz"))[0].select("id", "role", "active")


#: Nations as groups, customers as members, and orders as commands on the groups of five times as many numbers; some have no id but a name.
GROUPS = """
WITH g AS (SELECT n_nationkey::VARCHAR AS id, n_name AS display_name, CASE WHEN n_regionkey = 0 THEN 'analyst' END AS role, NULL::VARCHAR AS external_id FROM nation),
c AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'delete' WHEN o_orderkey % 17 = 1 THEN 'rename' ELSE 'upsert' END AS action, CASE WHEN o_orderkey % 7 > 0 THEN (o_custkey % 125)::VARCHAR END AS group_id, CASE WHEN o_orderkey % 5 > 0 THEN ' name ' || o_custkey % 30 || ' ' END AS display_name,
    CASE o_orderkey % 4 WHEN 0 THEN 'Manager' WHEN 1 THEN 'nobody' WHEN 2 THEN '' END AS role FROM orders),
k AS (SELECT *, coalesce(group_id, CASE WHEN action = 'upsert' THEN trim(display_name) END) AS id FROM c),
f AS (SELECT *, lag(action) OVER (PARTITION BY id ORDER BY seq) AS before FROM k WHERE id IS NOT NULL AND (action = 'delete' OR (action = 'upsert' AND coalesce(role, '') <> 'nobody'))),
v AS (SELECT * FROM f WHERE action = 'upsert' OR coalesce(before = 'upsert', id IN (SELECT id FROM g))),
l AS (SELECT id, arg_max({'action': action, 'name': coalesce(trim(display_name), id), 'role': CASE WHEN role = 'Manager' THEN 'manager' END}, seq) AS x, bool_or(action = 'delete') AS gone FROM v GROUP BY 1)
"""


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("display_name"), F.when(F.col("n_regionkey") == 0, "analyst").alias("role"), none.alias("external_id"))
    members = mapping.users(spark, sf_dir).select(F.col("nation").cast("string").alias("group_id"), F.col("id").alias("user_id"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    commands = table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.when(k % 3 == 0, "delete").when(k % 17 == 1, "rename").otherwise("upsert").alias("action"), F.when(k % 7 > 0, (c % 125).cast("string")).alias("group_id"), F.when(k % 5 > 0, F.concat(F.lit(" name "), c % 30, F.lit(" "))).alias("display_name"),
        F.when(k % 4 == 0, "Manager").when(k % 4 == 1, "nobody").when(k % 4 == 2, "").alias("role"), none.alias("external_id"),
    )
    return governance.apply_group_commands(groups, members, commands)


@query(GROUPS + "SELECT coalesce(l.id, g.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.x.name ELSE g.display_name END AS display_name, CASE WHEN l.id IS NOT NULL THEN l.x.role ELSE g.role END AS role FROM g FULL JOIN l ON l.id = g.id WHERE l.id IS NULL OR l.x.action = 'upsert'")
def g14a_group_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups after upserts and deletions in order."""
    return _grouped(spark, sf_dir)[0].select("id", "display_name", "role")


@query(GROUPS + "SELECT c_nationkey::VARCHAR AS group_id, c_custkey::VARCHAR AS user_id, 'member' AS kind FROM customer WHERE c_nationkey::VARCHAR NOT IN (SELECT id FROM l WHERE gone) UNION ALL SELECT NULL, seq::VARCHAR, 'reject' FROM c WHERE seq NOT IN (SELECT seq FROM v)")
def g14a_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that no deletion took, and the commands that were rejected."""
    _, members, rejects = _grouped(spark, sf_dir)
    return members.withColumn("kind", F.lit("member")).unionByName(rejects.select(F.lit(None).cast("string").alias("group_id"), F.col("seq").cast("string").alias("user_id"), F.lit("reject").alias("kind")))


@query("SELECT n_nationkey::BIGINT AS group_id, c_custkey::VARCHAR AS user_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 OR c_custkey % 2 = 0")
def g14b_replace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = mapping.users(spark, sf_dir)
    members = users.select(F.col("nation").cast("long").alias("group_id"), F.col("id").alias("user_id"))
    first = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("group_id"))
    commands = members.join(first, "group_id", "left_semi").where(F.col("user_id").cast("long") % 2 == 0)
    unknown = commands.select("group_id", F.concat(F.lit("x"), "user_id").alias("user_id"))
    return governance.replace_members(members, commands.unionByName(unknown), users)[0]


@query("SELECT c_name AS asked, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_custkey::VARCHAR FROM customer")
def g15_user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = mapping.users(spark, sf_dir).withColumn("external_id", F.concat(F.lit("ext"), "id"))
    return governance.find_users(users, users.select(F.col("user_name").alias("asked")).unionByName(users.select(F.col("id").alias("asked"))))


@query(f"""
SELECT c_custkey::VARCHAR AS id, (['external_partner', 'researcher', 'analyst', 'manager', 'admin'])[greatest(c_custkey % 5, n_regionkey) + 1] AS role
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 > 0""")
def g16_effective_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's group is the nation, whose role is that of its region's number."""
    users = mapping.users(spark, sf_dir)
    role = F.element_at(F.array(*(F.lit(r) for r in access.ROLES)), F.col("n_regionkey") + 1)
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), role.alias("role"))
    return governance.effective_roles(users, groups, users.select(F.col("nation").alias("group_id"), F.col("id").alias("user_id")))


@query("SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'analyst' ELSE 'manager' END AS role FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def g17_claim_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("/groups/"), "c_mktsegment").alias("claim"))
    more = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"), F.lit("CN=Leads,OU=x").alias("claim"))
    mapping_ = spark.createDataFrame([("building", "analyst"), ("machinery", "researcher"), ("leads", "manager")], "claim string, role string")
    return governance.roles_of_claims(claims.unionByName(more), mapping_)


@query("""
WITH e AS (SELECT doc_id FROM labels WHERE quality = 0), a AS (SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE regexp_matches(text, '[#$%&*]{3}'))
SELECT tp AS true_positives, (SELECT count(*) FROM a) - tp AS false_positives, (SELECT count(*) FROM e) - tp AS false_negatives,
  round(tp / (SELECT count(*) FROM a), 6) AS precision, round(tp / (SELECT count(*) FROM e), 6) AS recall, round(2 * tp / ((SELECT count(*) FROM a) + (SELECT count(*) FROM e)), 6) AS f1
FROM (SELECT count(*) AS tp FROM a JOIN e USING (doc_id))""")
def h1_extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag computed from the texts (runs of symbols) against the label of low quality."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    flagged = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[#$%&*]{3}")).join(labels, "doc_id", "left_semi")
    scores = evaluate.extraction_scores(labels.where("quality = 0"), flagged, ["doc_id"])
    return scores.select("true_positives", "false_positives", "false_negatives", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""
WITH f AS (SELECT o_custkey AS query_id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS document_id FROM orders),
x AS (SELECT c_custkey AS query_id, fragment FROM customer, (VALUES ('urgent'), ('low')) v(fragment)),
h AS (SELECT x.query_id, fragment, max(coalesce(contains(lower(title), fragment), false)) AS hit FROM x LEFT JOIN f USING (query_id) GROUP BY 1, 2),
t AS (SELECT query_id, avg(CASE WHEN document_id IS NULL THEN 0 ELSE 1 END) AS traced FROM f GROUP BY 1)
SELECT query_id, count(*) FILTER (hit) / 2 AS recall, round(any_value(traced), 6) AS traced FROM h LEFT JOIN t USING (query_id) GROUP BY 1""")
def h2_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("document_id"), F.lit("chunk 1").alias("locator"))
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.array(F.lit("urgent"), F.lit("low"))).alias("fragment"))
    return evaluate.retrieval_quality(found, expected).select("query_id", "recall", F.round("traced", 6).alias("traced"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events GROUP BY 1")
def h3_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "max")


@query("SELECT event_type AS method, '/' || (user_id % 10) AS path, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM events GROUP BY 1, 2")
def h4_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.concat(F.lit("/"), F.col("user_id") % 10).alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("ms"))
    return evaluate.request_metrics(log).withColumn("avg_ms", F.round("avg_ms", 6))
