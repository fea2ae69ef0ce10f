"""A stored prefix index of chunks: postings by ranges of tokens, lengths and vectors beside them, kept up by what is new.

Under its folder: postings/generation=g/shard=n (token, document_id, tf, len), each shard one range of (token, document_id) in order;
shards/generation=g (shard, first, last, the tokens at its ends); documents/generation=g (document_id, len, vector); words/generation=g, from
which these are made; committed/generation=g (documents, tokens), written last. A generation that is not committed, of a run that died, is never read. A search reads
the shards whose token ranges meet its prefixes, by partition filters that the plan shows, and never tokenizes a stored text again."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import sent, shared_table
from .retrieve import B, K1, index_words, plain

#: Occurrences of tokens in a shard, about, and the tasks that count and sort a shard's: their memory is that of its part.
SHARD_TOKENS, SHARD_TASKS = 20_000_000, 16
#: Texts whose tokens a worker counts at a time.
TEXTS = 256


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document_id, len, tokens, tfs) of (document_id, len, said), tokens with blanks between them: each token of a text once."""
    for whole in batches:
        for batch in (whole.slice(i, TEXTS) for i in range(0, whole.num_rows, TEXTS)):
            tokens, tfs, ends = [], [], [0]
            for said in batch.column("said").to_pylist():
                counts = Counter(said.split(" ")) if said else {}
                tokens.extend(counts)
                tfs.extend(counts.values())
                ends.append(len(tokens))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(tokens, pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("len"), *lists], ["document_id", "len", "tokens", "tfs"])


class TextIndex:
    """The index at `path`, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list:
        """(generation, documents, tokens) of the committed generations: a row for each call of add() that found something."""
        try:
            found = self.spark.read.schema("documents long, tokens long, generation string").parquet(f"{self.path}/committed").collect()
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return []
        return sorted(found, key=lambda r: r.generation)

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table's committed rows; without a generation, an empty one."""
        known = [r.generation for r in self._generations()]
        if not known:
            return self.spark.createDataFrame([], T.StructType.fromDDL(f"{schema}, generation string"))
        return self.spark.read.schema(f"{schema}, generation string").parquet(f"{self.path}/{name}").where(F.col("generation").isin(known))

    def documents(self, key: T.DataType) -> DataFrame:
        return self._read("documents", f"document_id {key.simpleString()}, len int, vector array<float>")

    def add(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, shard_tokens: int = SHARD_TOKENS) -> int:
        """Indexes the chunks (document_id, text) that the index does not have yet; the number of them. Of rows with one document_id the
        longest text counts, the greatest of equals. embed: makes (document_id, vector) of new chunks."""
        kind = chunks.schema["document_id"].dataType
        new = chunks.select("document_id", "text").where("document_id IS NOT NULL")
        if self._generations():
            new = new.join(self.documents(kind).select("document_id"), "document_id", "left_anti")
        # texts are shuffled to find the longest only if some document_id has several
        if not new.groupBy("document_id").count().where("count > 1").isEmpty():
            new = new.groupBy("document_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        generation = f"g{uuid.uuid4().hex}"
        at = lambda name: f"{self.path}/{name}/generation={generation}"
        # texts are cut into words once; blanks are in no word, so a text's words lose their accents together
        cut = new.select("document_id", index_words(F.coalesce("text", F.lit(""))).alias("words"))
        said = cut.select("document_id", F.size("words").alias("len"), plain(F.array_join("words", " ")).alias("said"))
        said.mapInArrow(_counted, f"document_id {kind.simpleString()}, len int, tokens array<string>, tfs array<long>").write.parquet(at("words"))
        told = self.spark.read.parquet(at("words"))
        lengths = told.select("document_id", "len")
        vectors = embed(new) if embed else lengths.select("document_id", F.lit(None).cast("array<float>").alias("vector")).limit(0)
        lengths.join(vectors.select("document_id", F.col("vector").cast("array<float>").alias("vector")), "document_id", "left").write.parquet(at("documents"))
        written = self.spark.read.parquet(at("documents"))
        size = written.agg(F.count("*").alias("documents"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("tokens")).first()
        if not size.documents:
            return 0
        words = told.select("document_id", "len", F.explode(F.arrays_zip("tokens", "tfs")).alias("w")).select("w.tokens", "document_id", "w.tfs", "len").toDF("token", "document_id", "tf", "len")
        ranged = words.repartitionByRange((size.tokens // shard_tokens + 1) * SHARD_TASKS, "token", "document_id")
        # the writer asks for rows by shard; one sort serves both
        shard = (F.spark_partition_id() / SHARD_TASKS).cast("int")
        ranged.withColumn("shard", shard).sortWithinPartitions("shard", "token", "document_id").write.partitionBy("shard").parquet(at("postings"))
        if size.tokens:
            stored = self.spark.read.schema(f"token string, document_id {kind.simpleString()}, tf long, len int, shard int").parquet(at("postings"))
            stored.groupBy("shard").agg(F.min("token").alias("first"), F.max("token").alias("last")).write.parquet(at("shards"))
        self.spark.createDataFrame([(size.documents, size.tokens)], "documents long, tokens long").coalesce(1).write.parquet(at("committed"))
        return size.documents

    def shards_of(self, wanted: DataFrame) -> dict[str, list[int]]:
        """The shards of each generation that may hold tokens with a wanted prefix; at most all shards' numbers come to the driver."""
        ends = self._read("shards", "shard int, first string, last string").agg(F.collect_list(F.struct("generation", "shard", "first", "last")).alias("ends"))
        meets = lambda e: (F.substring(e["first"], F.lit(1), F.length("prefix")) <= F.col("prefix")) & (e["last"] >= F.col("prefix"))
        met = wanted.select("prefix").distinct().crossJoin(F.broadcast(ends)).select(F.explode(F.filter("ends", meets)).alias("e")).select("e.generation", "e.shard").distinct()
        out: dict[str, list[int]] = {}
        for r in met.collect():
            out.setdefault(r.generation, []).append(r.shard)
        return out

    def postings(self, wanted: DataFrame, key: T.DataType) -> DataFrame:
        """(token, document_id, tf, len) of the shards that may hold a wanted (prefix)."""
        rows = self._read("postings", f"token string, document_id {key.simpleString()}, tf long, len int, shard int")
        pruned = F.lit(False)
        for generation, shards in sorted(self.shards_of(wanted).items()):
            pruned = pruned | ((F.col("generation") == generation) & F.col("shard").isin(sorted(shards)))
        return rows.where(pruned).select("token", "document_id", "tf", "len")

    def hits(self, wanted: DataFrame, key: T.DataType) -> DataFrame:
        """(prefix, document_id, f, score): occurrences of tokens with each wanted prefix, and what they add to a BM25 score.

        N and the mean length are over all documents, before any filter; an idf that is not positive counts as 1e-6. The occurrences are
        written once, and there are no more numbers of documents than wanted prefixes."""
        totals = self._generations()
        n_all = sum(r.documents for r in totals)
        mean = sum(r.tokens for r in totals) / max(1, n_all)
        asked = sent(wanted.select("prefix").distinct())
        # a token is cut to the lengths of those prefixes alone that begin as it does, over as many letters as the shortest has
        shortest = asked.agg(F.min(F.length("prefix"))).first()[0] or 0
        lengths = sent(asked.groupBy(F.substring("prefix", 1, shortest).alias("head")).agg(F.collect_set(F.length("prefix")).alias("ns")))
        met = self.postings(asked, key).withColumn("head", F.substring("token", 1, shortest)).join(lengths, "head")
        cut = met.withColumn("n", F.explode("ns")).where(F.length("token") >= F.col("n"))
        held = cut.withColumn("prefix", F.substring(F.col("token"), F.lit(1), F.col("n"))).join(asked, "prefix")
        found = shared_table(held.groupBy("prefix", "document_id").agg(F.sum("tf").alias("f"), F.max("len").alias("len")))
        n = sent(found.groupBy("prefix").agg(F.count_if(F.col("f") > 0).alias("n")))
        idf = F.log((F.lit(n_all) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        f, norm = F.col("f"), F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.lit(mean))
        return found.join(n, "prefix").select("prefix", "document_id", "f", (F.when(idf > 0, idf).otherwise(1e-6) * f * (K1 + 1) / (f + norm)).alias("score"))


def ranks(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, document_id, rank): minus the sum of the scores of all wanted (query_id, prefix), as often as each stands there."""
    times = sent(wanted.groupBy("query_id", "prefix").agg(F.count("*").alias("times")))
    return hits.join(times, "prefix").groupBy("query_id", "document_id").agg((-F.sum(F.col("score") * F.col("times"))).alias("rank"))


def meeting_all(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, document_id) that meet each group of a query: groups (query_id, group_id, prefix) are OR inside and AND between."""
    needed = groups.groupBy("query_id").agg(F.countDistinct("group_id").alias("needed"))
    met = hits.join(sent(groups), "prefix").groupBy("query_id", "document_id").agg(F.countDistinct("group_id").alias("met"))
    return met.join(needed, "query_id").where("met = needed").select("query_id", "document_id")
