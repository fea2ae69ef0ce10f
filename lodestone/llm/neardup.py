"""MinHash near-duplicates: exact links, found by banding.

1. Each text gets the set of its distinct shingles of `shingle` words, as 64-bit hashes, and a signature: the minima of
   `bands * rows` functions of a strongly universal family, the high half of a * x + b modulo 2^64, over the set.
2. Texts with equal sets collapse into one representative, so a group of exact copies costs one row from here on.
3. Signatures are cut into bands; representatives that agree on a band share a bucket. With the default 48 bands of 5
   minima, a pair at the threshold of 0.8 misses every bucket with a chance below 1e-8.
4. Not all pairs of a bucket are made. First every member meets one hub, the least of its buckets' least members: the pair is
   checked on signatures and confirmed on the full sets, and components are taken. Most buckets then lie within one
   component and are done. In each of the rest, once for buckets of the same members, everything outside the bucket's largest
   component is compared with everything in it, in blocks of `BLOCK` by `BLOCK` documents: pairs of one component are passed
   over, the others are verified on signatures and then on full sets, and a block returns only links that join components.
   No link between different components is lost; those within a component are not all listed.
5. Components come from alternating large-star and small-star.

Counts by bucket and set are grouped sums, combined in each task; joins on hot buckets may be split by adaptive execution,
and those on hubs are salted. The sets of the candidates alone are kept, found by a fixed-size bitmap that only ever lets too
much through.

Defined results: a text without words, or null, has no shingles and is linked with nothing; rows that share a doc_id count
as one document, and what they link joins; a null doc_id is linked with nothing, has a null component and is kept;
repeated rows each get their row; very long texts are taken whole; extra columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, kept, of, table, texts_of, write_shared
from .components import components

SHINGLE, BANDS, ROWS, SEED = 2, 48, 5, 20_177
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Signatures that agree less than the threshold by this much are not checked further (six standard deviations of 240 minima).
SLACK = 0.16
#: The bitmap that tells candidates has so many bits, however many documents there are.
BITMAP_BITS = 1 << 26
#: Documents on either side of one exact comparison.
BLOCK = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words; known words cost a lookup. It starts afresh when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingles of a text, as hashes. Words are parted by ASCII white space; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(kept("words", Words).__getitem__, words), np.uint64, len(words))
    size = min(k, len(hashes))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(out)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    a, b = draw.integers(0, 1 << 64, (2, n, 1), np.uint64)
    return a, b


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> bytes:
    """16 bits of each function's minimum over the set."""
    x = shingles >> np.uint64(32)
    a, b = functions
    least = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(x), 256):
        np.minimum(least, (a * x[None, at : at + 256] + b).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u2").tobytes()


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (together the set's identity) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _functions(bands * rows)
        for batch in batches:
            sizes, k1, k2, sigs = [], [], [], []
            for text in texts_of(batch.column("text")):
                s = shingle_set(text, shingle)
                sizes.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                k2.append(int(_mixed(s ^ np.uint64(SEED)).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append(signature(s, functions) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _buckets(firsts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node, n) for the buckets of two members or more; firsts has node and sig."""
    width = 2 * rows
    banded = firsts.select("node", F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("sig", width * i + 1, width)) for i in range(bands)))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    return banded.join(shared, "bucket")


def _bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    slot = F.pmod(F.xxhash64("node"), F.lit(bits))
    words = nodes.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {bits}L) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.word] = r.bit
    return out.view(np.uint64)


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(node, set) of the documents that the bitmap of nodes lets through, and perhaps a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            mine = np.nonzero((bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))[0]
            picked = batch.take(pa.array(mine))
            sets = [shingle_set(t, shingle).tobytes() for t in texts_of(picked.column("text"))]
            yield pa.RecordBatch.from_arrays([picked.column("doc_id"), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["node", "set"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    return rows.mapInArrow(run, "node long, set binary")


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of minima that two signatures have in common."""
    return pd.Series([float((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean()) for x, y in zip(a, b)], dtype="float64")


def _linked(percent: int):
    @F.pandas_udf(T.BooleanType())
    def confirm(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype="bool")

    return confirm


def _check(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for the pairs whose signatures are close enough, confirmed on full sets and written."""
    of = lambda side, t, c: t.select(F.col("node").alias(side), F.col(c).alias(f"{c}_{side}"))
    near = pairs.join(of("a", sigs, "sig"), "a").join(of("b", sigs, "sig"), "b").where(_agreement("sig_a", "sig_b") >= percent / 100 - SLACK).select("a", "b")
    full = near.join(of("a", sets, "set"), "a").join(of("b", sets, "set"), "b")
    return write_shared(full.select("a", "b", _linked(percent)("set_a", "set_b").alias("linked")), "links")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _joining_links(table: pa.Table, percent: int) -> pa.Table:
    """(a, b): links between the group's sides `asking` and not, as many as join components of either side and no more."""
    asking = np.array(table["asking"].to_pylist(), bool)
    nodes, comps = np.array(table["node"].to_pylist(), np.int64), np.array(table["c"].to_pylist(), np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
    sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(len(nodes), -1)
    mine, parent = np.nonzero(asking)[0], {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out_a, out_b = [], []
    for j in np.nonzero(~asking)[0]:
        apart = mine[comps[mine] != comps[j]]
        near = apart[(sigs[apart] == sigs[j]).mean(axis=1) >= percent / 100 - SLACK] if len(apart) else apart
        for i in near:
            x, y = root(int(comps[i])), root(int(comps[j]))
            if x != y:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[max(x, y)] = min(x, y)
                    out_a.append(int(nodes[i]))
                    out_b.append(int(nodes[j]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _links_within_buckets(open_: DataFrame, found: DataFrame, sets: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Links between components, for buckets (bucket, node) that span several of found (node, component)."""
    # buckets of the same members are one
    told = open_.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"))
    one = told.groupBy("n", "low", "all").agg(F.min("bucket").alias("bucket"))
    placed = open_.join(one.select("bucket"), "bucket").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    placed = write_shared(placed, "placed")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    plan = parts.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"))
    plan = plan.select("bucket", "largest", blocks(F.col("all") - F.col("most")).alias("askers"), blocks(F.col("all")).alias("others"))
    rows = placed.join(plan, "bucket").join(sets, "node").join(sigs, "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    known = ["bucket", "node", "c", "set", "sig"]
    asking = rows.where("c <> largest").select(*known, own(F.col("askers")).alias("i"), spread(F.col("others")).alias("j"), F.lit(True).alias("asking"))
    other = rows.select(*known, spread(F.col("askers")).alias("i"), own(F.col("others")).alias("j"), F.lit(False).alias("asking"))
    groups = asking.unionByName(other).groupBy("bucket", "i", "j")
    return groups.applyInArrow(lambda t: _joining_links(t, percent), "a long, b long")


def find_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text): the least doc_id that links reach."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    told = write_shared(sketch(docs, shingle, bands, rows), "sketch")
    known = told.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    firsts = known.join(classes, ["k1", "k2"]).where("doc_id = node").select("node", "sig")
    members = write_shared(_buckets(firsts, bands, rows), "members")
    nodes = members.select("node").distinct()
    sets = write_shared(_sets(docs, nodes, shingle, bits), "sets")
    sigs = write_shared(firsts.join(nodes, "node", "left_semi"), "signatures")
    # every member against the least hub of its buckets
    first = members.where("node <> hub").groupBy("node").agg(F.min("hub").alias("hub")).select(*_pair(F.col("node"), F.col("hub"))).distinct()
    checked = _check(first, sigs, sets, percent)
    links = checked.where("linked")
    found = components(links.select("a", "b"))
    placed = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    apart = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
    open_ = write_shared(placed.join(apart, "bucket", "left_semi").select("bucket", "node"), "open")
    if not open_.isEmpty():
        more = write_shared(_links_within_buckets(open_, found, sets, sigs, percent), "links")
        found = components(links.select("a", "b").unionByName(more))
    least = classes.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    joined = told.join(least, ["k1", "k2"], "left")
    return joined.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = find_components(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE_OP7 = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM cut),
sized AS (SELECT doc_id, len(s) AS n, s, sha256(array_to_string(list_sort(s), chr(10))) AS k FROM shingles),
classes AS (SELECT k, min(doc_id) AS node, any_value(s) AS s, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY k),
each AS (SELECT node, n, unnest(s) AS shingle FROM classes),
counted AS (
  SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.node < b.node AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY 1, 2),
links AS (SELECT a, b FROM counted WHERE 100 * common >= 80 * (na + nb - common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT node, node FROM classes
  UNION
  SELECT s.b, r.seen FROM reach r JOIN sides s ON s.a = r.node),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM sized d LEFT JOIN classes c ON d.k = c.k AND d.n > 0 LEFT JOIN least l ON l.node = c.node
"""


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keeps the least document of each group of near-duplicates, and every document without words.

    Word shingles here take five words, as near-duplicate stages do; repeated rows of one doc_id are one document and stay, as
    do rows without a doc_id. All columns keep their values, whatever their names; an empty table stays empty."""
    found = find_components(docs, shingle=5)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(of, docs.columns))
