"""The property graph: upserts, lookups, bounded neighborhoods, merges and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_key

EDGE_KEY = ("source_id", "subject_id", "predicate", "object_id", "evidence")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. A local session that names none gets one of its own; on a cluster, whose
    machines would not see it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    made = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: The most rows of a side that is sent whole to every task.
MOST_SENT = 100_000


def sent(df: DataFrame) -> DataFrame:
    """df to be joined where the other side is read, so that rows which meet nothing are not shuffled; with more than MOST_SENT rows as it is. The
    planner does not know the size of a checkpoint or of rows from the driver, and would shuffle both sides."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def upsert_entities(hits: DataFrame, order: str = "seq") -> DataFrame:
    """One entity for each (type, normalized name) of hits (type, name, order); the first spelling stays, the rest are aliases."""
    keyed = hits.select("type", "name", order, normalize_key(F.col("name")).alias("normalized_name")).where("normalized_name <> ''")
    one = keyed.groupBy("type", "normalized_name").agg(F.min_by("name", F.struct(order, "name")).alias("name"), F.array_sort(F.collect_set("name")).alias("names"))
    return one.select(F.xxhash64("type", "normalized_name").alias("id"), "type", "name", "normalized_name", F.array_remove("names", F.col("name")).alias("aliases"))


def insert_edges(edges: DataFrame, key: tuple[str, ...] = EDGE_KEY, order: str | None = None) -> DataFrame:
    """Edges without repeats of a full key; a null in the key is never a repeat. With `order` the first one stays."""
    full = ~F.greatest(*(F.col(c).isNull() for c in key))
    if order is None:
        return edges.where(full).dropDuplicates(list(key)).unionByName(edges.where(~full))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return edges.where(full).withColumn("_nth", nth).where("_nth = 1").drop("_nth").unionByName(edges.where(~full))


def both_ways(edges: DataFrame, subject: str = "subject_id", object_: str = "object_id") -> DataFrame:
    """(node, other, and the other columns): every edge from both ends, so an either-end join is an equi-join."""
    rest = [c for c in edges.columns if c not in (subject, object_)]
    one = edges.select(F.col(subject).alias("node"), F.col(object_).alias("other"), *rest)
    return one.unionByName(edges.select(F.col(object_).alias("node"), F.col(subject).alias("other"), *rest))


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, fan_out: int | None = 100, order: str = "id") -> DataFrame:
    """(seed, node, depth) of the nodes within `depth` hops of each seed, edges taken either way; depth is the least one.

    From a node at most `fan_out` edges are followed, those of least `order` (None: all). Hops are joins of the frontier;
    each hop's result is checkpointed, and nothing but whether a frontier is empty comes to the driver."""
    ends = both_ways(edges.where("subject_id <> object_id"))
    if fan_out is not None:
        ends = ends.withColumn("_nth", F.row_number().over(Window.partitionBy("node").orderBy(order, "other"))).where(F.col("_nth") <= fan_out)
    ends = ends.select("node", "other").distinct()
    seen = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.select("seed", "node").join(ends, "node").select("seed", F.col("other").alias("node")).distinct()
        frontier = shared_table(reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Parts into which a hub's edges are dealt before the first of them are chosen.
SALTS = 16


def _first_edges(ends: DataFrame, fan_out: int) -> DataFrame:
    """The fan_out edges of least id of each node: first of each salted part of its edges, then of what those leave, so no task sorts a
    hub's whole adjacency."""
    salt = F.pmod(F.hash("id"), F.lit(SALTS))
    part = F.row_number().over(Window.partitionBy("node", "_salt").orderBy("id", "other"))
    some = ends.withColumn("_salt", salt).withColumn("_nth", part).where(F.col("_nth") <= fan_out)
    return some.withColumn("_nth", F.row_number().over(Window.partitionBy("node").orderBy("id", "other"))).where(F.col("_nth") <= fan_out).select("node", "other", "id")


def bounded_graph(edges: DataFrame, seeds: DataFrame, depth: int, limit: int = 60, fan_out: int = 100, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The neighborhood of each seed under budgets: nodes (seed, node, depth, nth), at most `limit`, and edges (seed, id, subject_id,
    object_id, depth, nth), at most twice as many. seeds (seed, node): a seed may begin at several nodes; edges (id, subject_id,
    object_id, and source_id if `sources`, the ids that may be seen, is given; an edge without a source may be).

    Hops go through edges that may be seen, from each node the fan_out of least id. New nodes come in the order of the node
    that found them and the edge's id, and are taken while the seed's budget lasts; what is beyond it is not followed. An edge counts if both of
    its nodes were taken; edges come in the order of hop, finding node and id. Each hop reads only edges at its frontier, and
    its frontier, of at most `limit` rows a seed, is checkpointed."""
    if sources is not None:
        allowed = sources.select(F.col("id").alias("source_id")).distinct()
        edges = edges.join(allowed, "source_id", "left_semi").select(*edges.columns).unionByName(edges.where("source_id IS NULL"))
    plain = edges.select("id", "subject_id", "object_id").where("subject_id <> object_id")
    ends = both_ways(plain)
    first = seeds.select("seed", "node").distinct()
    order = Window.partitionBy("seed").orderBy("node")
    seen = shared_table(first.withColumns({"depth": F.lit(0), "nth": F.row_number().over(order)}).where(F.col("nth") <= limit))
    frontier, met = seen, None
    for hop in range(1, depth + 1):
        near = _first_edges(ends.join(frontier.select("node").distinct(), "node", "left_semi"), fan_out)
        walked = frontier.select("seed", "node", F.col("nth").alias("by")).join(near, "node").select("seed", "by", "id", "node", "other", F.lit(hop).alias("depth"))
        walked = shared_table(walked)
        met = walked if met is None else met.unionByName(walked)
        new = walked.groupBy("seed", F.col("other").alias("node")).agg(F.min(F.struct("by", "id")).alias("found")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        taken = seen.groupBy("seed").agg(F.count("*").alias("taken"))
        numbered = new.join(taken, "seed").withColumn("nth", (F.col("taken") + F.row_number().over(Window.partitionBy("seed").orderBy("found", "node"))).cast("int"))
        frontier = shared_table(numbered.where(F.col("nth") <= limit).select("seed", "node", F.lit(hop).alias("depth"), "nth"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if met is None:
        return seen, plain.limit(0).select(F.lit(None).cast(seeds.schema["seed"].dataType).alias("seed"), "id", "subject_id", "object_id", F.lit(0).alias("depth"), F.lit(0).alias("nth"))
    inside = seen.select("seed", "node")
    once = met.join(inside, ["seed", "node"], "left_semi").join(inside.withColumnRenamed("node", "other"), ["seed", "other"], "left_semi").groupBy("seed", "id").agg(F.min(F.struct("depth", "by")).alias("found"))
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("found", "id"))
    kept = once.withColumn("nth", nth).where(F.col("nth") <= 2 * limit)
    return seen, kept.join(plain, "id").select("seed", "id", "subject_id", "object_id", "found.depth", "nth")


def reach_counts(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, reached): distinct nodes within depth of each seed, the seed included."""
    return neighborhood(edges, seeds, depth, fan_out=None).groupBy("seed").agg(F.count("*").alias("reached"))


def lookup(entities: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Entities whose name holds the query: exact ones first, then by type and name."""
    key = " ".join(query.lower().replace("ё", "е").split())
    name = normalize_key(F.col("name"))
    exact = F.when(name == key, 0).otherwise(1)
    return entities.where(name.contains(key)).orderBy(exact, "type", "name", "id").limit(limit)


def facts_of(facts: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """(subject_id, n) of the facts in the given statuses."""
    kept = facts if statuses is None else facts.where(F.col("status").isin(statuses))
    return kept.groupBy("subject_id").agg(F.count("*").alias("n"))


def edge_scan(edges: DataFrame, sources: DataFrame, access: Column, limit: int | None = 200) -> DataFrame:
    """Edges that a role may see, in the order of id: those without a source, or whose source `access` allows. The filter comes
    before the limit."""
    allowed = sources.where(access).select(F.col("id").alias("source_id"))
    kept = edges.where("source_id IS NULL").unionByName(edges.join(allowed, "source_id", "left_semi").select(*edges.columns))
    kept = kept.orderBy("id")
    return kept if limit is None else kept.limit(limit)


def low_connectivity(entities: DataFrame, edges: DataFrame, types: list[str], include_isolated: bool = False, limit: int = 20) -> DataFrame:
    """Entities of the given types with one edge (or none, if wanted), by name."""
    degree = both_ways(edges.select("id", "subject_id", "object_id")).groupBy("node").agg(F.countDistinct("id").alias("edges"))
    joined = entities.where(F.col("type").isin(types)).join(degree, F.col("id") == F.col("node"), "left" if include_isolated else "inner")
    return joined.withColumn("edges", F.coalesce("edges", F.lit(0))).where("edges <= 1").select("id", "type", "name", "edges").orderBy("type", "name", "id").limit(limit)


def _repointed(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        to = mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("_new"))
        df = df.join(to, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def merge_entities(entities: DataFrame, facts: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, facts and edges after merging old_id into new_id (mapping): survivors take the names and aliases of the merged,
    facts and edges are pointed to them, and edges that became equal are dropped."""
    gone = mapping.join(entities, F.col("old_id") == F.col("id")).select("new_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    more = gone.groupBy("new_id").agg(F.collect_set("alias").alias("more"))
    kept = entities.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti").join(more, F.col("id") == F.col("new_id"), "left")
    aliases = F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))))
    kept = kept.withColumn("aliases", F.array_remove(aliases, F.col("name"))).select(*entities.columns)
    moved_facts = _repointed(facts, mapping, ["subject_id", "object_id"]).select(*facts.columns)
    moved_edges = _repointed(edges, mapping, ["subject_id", "object_id"]).select(*edges.columns)
    return kept, moved_facts, insert_edges(moved_edges, order="id")


def split_entity(entities: DataFrame, facts: DataFrame, edges: DataFrame, old_id: int, new: DataFrame, fact_ids: DataFrame, edge_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, facts and edges after a new entity (one row) took over the listed facts (fact_id) and edges (edge_id) of old_id."""
    new_id = new.select("id").first()[0]

    def moved(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
        marked = df.join(listed.select(F.col(key).alias("id"), F.lit(True).alias("_listed")).distinct(), "id", "left")
        to = lambda c: F.when(F.col("_listed") & (F.col(c) == old_id), F.lit(new_id)).otherwise(F.col(c))
        return marked.withColumns({"subject_id": to("subject_id"), "object_id": to("object_id")}).select(*df.columns)

    return entities.unionByName(new, allowMissingColumns=True), moved(facts, fact_ids, "fact_id"), insert_edges(moved(edges, edge_ids, "edge_id"), order="id")


def domain_range_report(edges: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (predicate, subject type, object type) is not in allowed (predicate, domain, range)."""
    subject = entities.select(F.col("id").alias("subject_id"), F.col("type").alias("domain"))
    object_ = entities.select(F.col("id").alias("object_id"), F.col("type").alias("range"))
    return edges.join(subject, "subject_id").join(object_, "object_id").join(allowed, ["predicate", "domain", "range"], "left_anti")
