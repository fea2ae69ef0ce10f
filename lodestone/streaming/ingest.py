"""Incremental ingest as a stream: new files of a folder are triaged, checked against a manifest and cut into chunks.

The stream's checkpoint replaces a resume list; the manifest is still written, for status and retries. What a batch writes
lies under its number and replaces what an earlier try of the same batch has left, so a repeated batch doubles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import front_matter
from ..operators.chunk import chunk
from ..operators.evaluate import request_metrics
from ..operators.graph import shared_table
from ..sources.files import checksum, expand_archives, office_text, plan_load, suffix, triage

FILE = "path string, modificationTime timestamp, length long, content binary"
MANIFEST = "path string, checksum string, status string, duplicate_of string, error string, batch long"
LOG = "method string, path string, status int, ms double, at timestamp"


def with_members(files: DataFrame) -> DataFrame:
    """(path, content, error): files (path, content), and the members of the archives among them as `archive!/member`."""
    archives = files.where(triage(F.col("path"))["status"] == "supported_archive")
    members = expand_archives(archives).select(F.concat_ws("!/", "path", "member").alias("path"), "content", "error")
    # an archive that cannot be opened has one row, under its own name
    broken = members.where(F.col("error").isNotNull() & ~F.col("path").contains("!/"))
    inside = members.where(F.col("path").contains("!/"))
    opened = files.select("path", "content").join(broken.select("path", "error"), "path", "left")
    return opened.unionByName(inside)


def readable(told: DataFrame) -> DataFrame:
    """(path, text, error) of files (path, content, reason): text files without their front matter, CSV files as lines of cells
    joined by ' | ', and office files as their parts, each under its locator."""
    _, body = front_matter(F.col("content").cast("string"))
    cells = F.split(F.col("content").cast("string"), r"\r?\n")
    lines = F.filter(F.transform(cells, lambda row: F.array_join(F.split(row, r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), " | ")), lambda row: F.regexp_replace(row, r"[\s|]", "") != "")
    table = F.concat(F.lit("[sheet: csv]\n"), F.array_join(lines, "\n"))
    plain = told.where("reason = 'text'").select("path", F.when(suffix(F.col("path")) == "csv", table).otherwise(body).alias("text"), F.lit(None).cast("string").alias("error"))
    parts = office_text(told.where("reason = 'office'")).withColumn("part", F.when(F.col("error").isNull(), F.concat_ws("\n", "locator", "text"))).withColumn("at", F.monotonically_increasing_id())
    office = parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "\n").alias("text"), F.max("error").alias("error"))
    return plain.unionByName(office)


def ingest_batch(batch: DataFrame, manifest: DataFrame, out: str, number: int = 0) -> None:
    """Loads one batch of files: writes chunks to out/chunks/batch=number and their status to out/manifest/batch=number. Archives
    are opened and their members loaded like files; what cannot be read, or gives no chunk, is `failed` with its error, and
    the rest of the batch goes on."""
    files = with_members(batch)
    kind = triage(F.col("path"), F.col("content"))
    state = F.when(F.col("error").isNotNull(), "failed").otherwise(kind["status"])
    told = shared_table(files.select("path", "content", "error", checksum(F.coalesce("content", F.lit("").cast("binary"))).alias("checksum"), kind["reason"].alias("reason"), state.alias("triage")))
    earlier = manifest.where(F.col("batch") != number)
    planned = plan_load(told.where("triage <> 'failed'").select("path", "checksum", "triage"), earlier)
    _load(told, planned, out, number)


def _load(told: DataFrame, planned: DataFrame, out: str, number: int) -> None:
    """Writes the chunks and the states of a batch: told (path, content, error, checksum, reason, triage), planned (path, checksum, status, duplicate_of)."""
    pending = planned.where("status = 'pending'").select("path")
    texts = shared_table(readable(told.join(pending, "path", "left_semi").where("triage = 'supported'")))
    chunks = chunk(texts.where("error IS NULL").join(planned.select("path", F.col("checksum").alias("source_id")), "path").select("path", "source_id", "text"))
    chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
    cut = told.sparkSession.read.schema(chunks.schema).parquet(f"{out}/chunks/batch={number}").select("path").distinct().withColumn("cut", F.lit(True))
    loaded = planned.join(told.select("path", "triage"), "path", "left").join(texts.select("path", "error"), "path", "left").join(cut, "path", "left")
    done = F.when(F.col("status") != "pending", F.col("status")).when(F.col("triage") == "supported_archive", "archive_indexed").when(F.col("cut"), "indexed").otherwise("failed")
    error = F.when(done == "failed", F.coalesce("error", F.lit("no_chunks")))
    rows = loaded.select("path", "checksum", done.alias("status"), "duplicate_of", error.alias("error"))
    bad = told.where("triage = 'failed'").select("path", "checksum", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("duplicate_of"), "error")
    rows.unionByName(bad).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")


def start_ingest(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes all files that are there now and stops; run it again for later ones."""
    spark.createDataFrame([], MANIFEST).drop("batch").write.mode("overwrite").parquet(f"{out}/manifest/batch=-1")
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(root)

    def load(out: str, batch: DataFrame, number: int) -> None:
        ingest_batch(batch, batch.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest"), out, number)

    return files.writeStream.foreachBatch(partial(load, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a checksum's state decides about each of its files.
DECISION = "path string, checksum string, triage string, status string, duplicate_of string"
#: Files of one micro-batch of the stateful stream, at most; its list of paths goes through the driver.
BATCH_FILES = 10_000


def decided(files: DataFrame) -> DataFrame:
    """DECISION for a stream of files (path, content): the first file of a checksum, by batch and then by path, is pending and owns it; later ones are
    duplicates of it. The owner is kept in the state store under the checksum and what reads it, so no batch reads the manifest; the
    same bytes under a suffix with another reader are another matter. What is unsupported has no state. Contents do not reach the state."""
    kind = triage(F.col("path"), F.col("content"))
    archives = files.where(triage(F.col("path"))["status"] == "supported_archive")
    members = expand_archives(archives).where("error IS NULL").select(F.concat_ws("!/", "path", "member").alias("path"), "content")
    told = files.select("path", "content").unionByName(members).select("path", checksum(F.coalesce("content", F.lit("").cast("binary"))).alias("checksum"), kind["status"].alias("triage"), kind["reason"].alias("reason"))

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).drop_duplicates("path").sort_values("path")
        owner = owner or rows["path"].iloc[0]
        state.update((owner,))
        own = rows["path"] == owner
        yield pd.DataFrame({
            "path": rows["path"], "checksum": rows["checksum"], "triage": rows["triage"], "status": own.map({True: "pending", False: "duplicate_skipped"}), "duplicate_of": [None if mine else owner for mine in own],
        })

    known = told.where("triage <> 'unsupported'").groupBy("checksum", "reason").applyInPandasWithState(decide, DECISION, "owner string", "append", "NoTimeout")
    return known.unionByName(told.where("triage = 'unsupported'").select("path", "checksum", "triage", F.lit("unsupported").alias("status"), F.lit(None).cast("string").alias("duplicate_of")))


def load_decided(batch: DataFrame, number: int, out: str) -> None:
    """Reads the pending files of one batch of decisions again, by their paths, and loads them as ingest_batch does."""
    planned = shared_table(batch)
    spark = planned.sparkSession
    paths = [r[0] for r in planned.where("status = 'pending'").select(F.regexp_replace("path", "!/.*$", "")).distinct().collect()]
    files = spark.read.format("binaryFile").schema(FILE).load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]) if paths else spark.createDataFrame([], FILE)
    held = with_members(files)
    state = F.when(F.col("error").isNotNull(), "failed").otherwise(triage(F.col("path"), F.col("content"))["status"])
    told = shared_table(held.select("path", "content", "error", checksum(F.coalesce("content", F.lit("").cast("binary"))).alias("checksum"), triage(F.col("path"), F.col("content"))["reason"].alias("reason"), state.alias("triage")))
    # an archive that cannot be opened is told as failed, by its own row
    broken = told.where("triage = 'failed'").select("path")
    _load(told.join(planned.select("path"), "path", "left_semi"), planned.drop("triage").join(broken, "path", "left_anti"), out, number)


def start_stateful_ingest(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """As start_ingest, but duplicates are known from a state store keyed by checksum, whatever the size of the manifest. A batch that is
    repeated after a crash finds the state as it was before it, and replaces what its first try has written."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", BATCH_FILES).load(root)
    return decided(files).writeStream.foreachBatch(partial(_numbered, out)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbered(out: str, batch: DataFrame, number: int) -> None:
    load_decided(batch, number, out)


def retry_ingest(spark: SparkSession, out: str, failed: bool = True, unsupported: bool = False) -> int:
    """Loads once more the files whose latest state in the manifest is failed or unsupported, as a batch of its own; the number of them. What is
    still there is read anew; what is gone stays as it is. Files of archives are retried with their archive."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    latest = manifest.groupBy("path").agg(F.max_by(F.struct("status", "checksum", "duplicate_of", "error"), "batch").alias("m")).select("path", "m.*")
    wanted = [s for s, on in (("failed", failed), ("unsupported", unsupported)) if on]
    again = shared_table(latest.where(F.col("status").isin(wanted)).select(F.regexp_replace("path", "!/.*$", "").alias("path")).distinct())
    rows = again.count()
    if not rows:
        return 0
    number = manifest.agg(F.max("batch")).first()[0] + 1_000_000
    folders = [r[0] for r in again.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).distinct().collect()]
    there = spark.read.format("binaryFile").schema(FILE).load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in folders])
    settled = latest.where(~F.col("status").isin(wanted)).withColumn("batch", F.lit(-2).cast("long"))
    ingest_batch(there.join(again, "path", "left_semi"), settled, out, number)
    return rows


def stream_request_metrics(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Request metrics of a folder of JSON logs by minute, written once a minute is ten minutes past."""
    log = spark.readStream.schema(LOG).json(root).withWatermark("at", "10 minutes")
    by_minute = log.groupBy(F.window("at", "1 minute"), "method", "path").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))
    return by_minute.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def batch_request_metrics(spark: SparkSession, root: str) -> DataFrame:
    return request_metrics(spark.read.schema(LOG).json(root))
