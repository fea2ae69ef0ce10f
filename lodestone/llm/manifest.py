"""Merkle manifests by time-forward processing: every group's leaves under a tree of fan-out 8, the groups' roots under one more.

A node's label is (the last leaf below it, its level), so children have lesser labels than their parents. Upwards, a node is
processed when its label is due and sends its digest to its parent through a priority queue ordered by the receiver's label;
downwards the sweep runs in reversed order and sends each child the siblings that its proof needs, in front of those that its
parent got.

The queue is external: trees are cut into blocks of FAN_OUT^LEVELS leaves, messages between blocks are rows that Spark's
sorted shuffle delivers in the order of (group, block, place) and spills to disk, and only messages inside a block are held in a heap, a few
for each level. A block's root is a leaf of the blocks one step above; so a group of any size, be it a third of all rows, is
spread over all tasks, and the number of steps is the logarithm of the largest group to the base FAN_OUT^LEVELS. Digests alone are
moved, never texts: leaves are digested as they are read, in built-in functions. Every step is written to the shared folder.

Defined results: null fields count as `-`; rows of one doc_id, or of none (which come first), stand in the order of their leaf digests,
and rows with equal leaves share their place's proofs in any order; a group of one row has its leaf as its root; a null group is
a group; texts of any length are one leaf; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, let_go, table, write_shared

FAN_OUT, LEVELS = 8, 4
#: Rows of a batch of proofs.
ROWS = 1024
PATH = "array<struct<place:int,others:string>>"


def digest_of(columns: list[Column]) -> Column:
    """H of fields: each `-` if null, else its UTF-8 bytes, a colon and the value."""

    def told(c: Column) -> Column:
        said = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))

    return F.sha2(F.concat(*map(told, columns)), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give: at each level the siblings to its left, the digest, and those to its right."""
    width = 64
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(F.substring(x.others, F.lit(1), x.place * width), d, F.substring(x.others, x.place * width + 1, F.length(x.others))), 256))


def siblings(path: Column) -> Column:
    """The digests that a path holds, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: x.others), "")


def _height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def _label(level: int, i: int, m: int) -> tuple[int, int]:
    return min((i + 1) * FAN_OUT**level, m), level


def climb(leaves: list[str], levels: int) -> list[list[str]]:
    """Digests of a block's nodes, a list for each level from the leaves up to `levels`."""
    m, queue, nodes = len(leaves), [], [[] for _ in range(levels + 1)]

    def settled(level: int, digest: str) -> None:
        i = len(nodes[level])
        nodes[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (_label(level + 1, i // FAN_OUT, m), i, digest))

    for now, leaf in enumerate(leaves, 1):
        settled(0, leaf)
        while queue and queue[0][0][0] == now:
            due, sent = queue[0][0], []
            while queue and queue[0][0] == due:
                sent.append(heapq.heappop(queue)[2])
            settled(due[1], hashlib.sha256("".join(sent).encode()).hexdigest())
    return nodes


def descend(nodes: list[list[str]]) -> list:
    """For each leaf of a block its path inside the block, as (place, others, the rest) up to None at the block's root."""
    m, out = len(nodes[0]), [None] * len(nodes[0])
    queue = [((-m, 1 - len(nodes)), 0, None)]
    while queue:
        (_, minus), i, rest = heapq.heappop(queue)
        if minus == 0:
            out[i] = rest
            continue
        children, level = nodes[-minus - 1][i * FAN_OUT : (i + 1) * FAN_OUT], -minus - 1
        for place in range(len(children)):
            end, _ = _label(level, i * FAN_OUT + place, m)
            heapq.heappush(queue, ((-end, -level), i * FAN_OUT + place, (place, "".join(children[:place] + children[place + 1 :]), rest)))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """((group, block), rows) of sorted batches, one block at a time."""
    held, now = [], None
    for batch in batches:
        keys = list(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist()))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                if keys[begin] != now and held:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = keys[begin]
                held.append(batch.slice(begin, i - begin))
                begin = i
    if held:
        yield now, pa.Table.from_batches(held)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", "at")


def _block(height: int) -> Column:
    return F.floor(F.col("at") / FAN_OUT**height).alias("block")


def ranked(nodes: DataFrame, order: list[Column], name: str) -> DataFrame:
    """nodes (g and more) with their place in their group (at) by `order`, and the group's size (n); written twice.

    Rows are dealt by ranges of (g, order) and numbered as they stand; the sum of what earlier tasks hold of the group makes these
    places in it. That sum runs over one row for each task and group that meet."""
    by = [F.col("g").asc_nulls_first(), *order]
    # rows equal in all of `order` are told apart by their number, so that they spread as well
    told = nodes.withColumn("number", F.monotonically_increasing_id())
    placed = write_shared(told.repartitionByRange(*by, F.col("number")).sortWithinPartitions(*by, F.col("number")).drop("number").withColumn("row", F.monotonically_increasing_id()), name)
    task = F.shiftright("row", 33)
    shares = placed.groupBy("g", task.alias("task")).agg(F.min("row").alias("first"), F.count("*").alias("m"))
    group = Window.partitionBy("g")
    before = F.sum("m").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.select(F.col("g").alias("of_g"), "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(group).alias("n"))
    joined = placed.join(shares, F.col("g").eqNullSafe(F.col("of_g")) & (task == F.col("task")))
    return write_shared(joined.select(*nodes.columns, (F.col("row") + F.col("shift")).alias("at"), "n"), f"{name}-places")


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """The roots of the blocks of nodes (g, at, n, digest), in the same columns."""
    kind = nodes.schema["g"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for (g, block), rows in _blocks(batches):
            n = rows["n"][0].as_py()
            levels = min(height, _height(n))
            root = climb(rows["digest"].to_pylist(), levels)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([g], rows.schema.field("g").type), pa.array([block], pa.int64()), pa.array([-(-n // FAN_OUT**levels)], pa.int64()), pa.array([root])], names=["g", "at", "n", "digest"])

    return _dealt(nodes.select("g", _block(height), "at", "n", "digest")).mapInArrow(run, f"g {kind}, at long, n long, digest string")


def _paths(inner: list, path: list[dict], kind: pa.DataType) -> pa.Array:
    places, others, offsets = [], [], [0]
    outer_places, outer_others = [x["place"] for x in path], [x["others"] for x in path]
    for step in inner:
        while step is not None:
            places.append(step[0])
            others.append(step[1])
            step = step[2]
        places += outer_places
        others += outer_others
        offsets.append(len(places))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(others, pa.string())], fields=list(kind.value_type)))


def _down(nodes: DataFrame, messages: DataFrame, keep: list[str], height: int) -> DataFrame:
    """nodes (g, at, n, digest, and keep) with what messages (g, block, path, subroot, root) tell each block, and each one's own path."""
    told = ["path", "subroot", "root"]
    rows = nodes.select("g", _block(height), "at", "n", "digest", *keep, F.lit(None).cast(PATH).alias("path"), *(F.lit(None).cast("string").alias(c) for c in told[1:]))
    # a block's message stands before its rows
    sent = messages.select("g", F.col("block").cast("long").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in keep), *told)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["g", "at", "digest", *keep, *told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for _, block in _blocks(batches):
            head, leaves = block.slice(0, 1), block.slice(1)
            path, subroot, root = (head[c][0].as_py() for c in told)
            inner = descend(climb(leaves["digest"].to_pylist(), min(height, _height(leaves["n"][0].as_py()))))
            for at in range(0, len(inner), ROWS):
                part = leaves.slice(at, ROWS).combine_chunks()
                own = _paths(inner[at : at + ROWS], path, block.schema.field("path").type)
                columns = [part[c].combine_chunks() for c in names[: -len(told)]]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, own, pa.array([subroot] * part.num_rows, pa.string()), pa.array([root] * part.num_rows, pa.string())], names=names)

    return _dealt(rows.unionByName(sent)).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _tree(leaves: DataFrame, name: str, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The written steps from ranked leaves upwards, and (g, digest) of the groups' roots."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    steps = [leaves]
    for _ in range(max(1, -(-_height(largest) // height))):
        steps.append(write_shared(_up(steps[-1], height), f"{name}-{len(steps)}"))
    return steps[:-1], steps[-1].select("g", "digest")


def _proven(steps: list[DataFrame], messages: DataFrame, keep: list[str], name: str, height: int) -> DataFrame:
    """The lowest step's rows with their paths, by sweeps from the highest step down."""
    for i in range(len(steps) - 1, 0, -1):
        below = _down(steps[i], messages, [], height)
        messages = write_shared(below.select("g", F.col("at").alias("block"), "path", "subroot", "root"), f"{name}-down-{i}")
    return _down(steps[0], messages, keep, height)


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", digest: str = "leaf", keep: tuple[str, ...] = (), height: int = LEVELS) -> DataFrame:
    """(the columns group, order, digest and keep, subroot, root, path) of rows with a digest each: a tree for each group, its leaves in
    ascending `order`, and a tree over the groups' roots, ordered by group, null first. path: for each level from the leaf to
    the root its place in its run and the others of the run, as one text of hexadecimal digests. height: the levels of a block."""
    bounded_batches(rows.sparkSession)
    told = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(digest).alias("digest"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    leaves = ranked(write_shared(told, "leaves"), [F.col("o").asc_nulls_first(), F.col("digest")], "ranked")
    steps, subroots = _tree(leaves, "step", height)
    tops = subroots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("of_group"), "digest")
    tops = ranked(write_shared(tops, "subroots"), [F.col("of_group").asc_nulls_first()], "groups")
    top_steps, root = _tree(tops, "top", height)
    begin = root.select("g", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    groups = _proven(top_steps, begin, ["of_group"], "top", height)
    sent = write_shared(groups.select(F.col("of_group").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root"), "sent")
    kept = ["o", *(f"k{i}" for i in range(len(keep)))]
    found = _proven(steps, sent, kept, "step", height)
    return found.select(F.col("g").alias(group), F.col("o").alias(order), F.col("digest").alias(digest), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "subroot", "root", "path")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "lang", digest_of([*named, text]).alias("leaf"), F.when(tampered, digest_of([*named, lowered])).alias("probe"))
    found = manifest(leaves, keep=("probe",)).withColumn("folded_root", folded(F.coalesce("probe", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of a text of ASCII letters, bit by bit.
_SQL_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"

ORACLE_OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang AS g, {_sql_leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_SQL_CRC} % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS probe FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes(g, level, pos, n, digest) AS (
  SELECT g, 0, pos, n, leaf FROM placed
  UNION ALL SELECT g, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 8),
subroots AS (SELECT g, level AS height, digest AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 8),
steps AS (
  SELECT p.r, p.g, level::BIGINT AS level, (p.pos // (8 ** level)::BIGINT) AS mine FROM placed p JOIN subroots s ON p.g IS NOT DISTINCT FROM s.g, range(0, 12) t(level) WHERE level < s.height
  UNION ALL SELECT p.r, p.g, 100 + level, (s.pos // (8 ** level)::BIGINT) FROM placed p JOIN subroots s ON p.g IS NOT DISTINCT FROM s.g, range(0, 12) t(level) WHERE level < (SELECT max(level) FROM tops)),
near AS (
  SELECT s.r, s.level, s.mine, n.pos, n.digest FROM steps s LEFT JOIN (SELECT g, level::BIGINT AS level, pos, digest FROM nodes) n ON s.level < 100 AND n.g IS NOT DISTINCT FROM s.g AND n.level = s.level AND n.pos // 8 = s.mine // 8 WHERE s.level < 100
  UNION ALL SELECT s.r, s.level, s.mine, n.pos, n.digest FROM steps s JOIN tops n ON n.level + 100 = s.level AND n.pos // 8 = s.mine // 8),
sides AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS k, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > mine), '') AS after FROM near GROUP BY r, level),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY k) AS proof FROM sides GROUP BY 1),
folds(r, k, digest) AS (
  SELECT r, 0::BIGINT, coalesce(probe, leaf) FROM leaves
  UNION ALL SELECT f.r, s.k, sha256(s.before || f.digest || s.after) FROM folds f JOIN sides s ON f.r = s.r AND s.k = f.k + 1),
ends AS (SELECT r, arg_max(digest, k) AS folded_root FROM folds GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON p.g IS NOT DISTINCT FROM s.g LEFT JOIN proofs USING (r) JOIN ends USING (r), (SELECT digest AS root FROM tops WHERE n = 1)"""
