"""File corpora: inventory, triage, text extraction from files, and incremental loads against a manifest."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import front_matter, path_language, path_years, size_bucket

TEXT_SUFFIXES = ("md", "txt", "json", "csv")
OFFICE_SUFFIXES = ("docx", "docm", "pptx", "xlsx")
ARCHIVE_SUFFIXES = ("zip",)
#: First bytes of image files, in hexadecimal.
IMAGE_MAGIC = ("89504e470d0a1a0a", "ffd8ff", "474946383761", "474946383961", "424d", "49492a00", "4d4d002a")
#: Statuses with which a file needs no second visit.
DONE = ("indexed", "archive_indexed", "duplicate_skipped")
SHEET_ROWS = 250


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below root; columns that nobody asks for are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def top_folder(path: Column, root: str) -> Column:
    return F.regexp_extract(path, rf"{re.escape(root.rstrip('/'))}/([^/]+)/", 1)


def triage(path: Column, head: Column | None = None) -> Column:
    """struct(status, reason): supported, supported_archive or unsupported. An image by its first bytes counts as one whatever its
    suffix; images need a text recognizer, which is not part of this library."""
    kind = suffix(path)
    verdict = lambda status, reason: F.struct(F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    known = F.when(kind.isin(*TEXT_SUFFIXES), verdict("supported", "text")).when(kind.isin(*OFFICE_SUFFIXES), verdict("supported", "office"))
    known = known.when(kind.isin(*ARCHIVE_SUFFIXES), verdict("supported_archive", "archive")).when(kind == "", verdict("unsupported", "no_suffix"))
    known = known.otherwise(verdict("unsupported", F.concat(F.lit("suffix_"), kind)))
    if head is None:
        return known
    start = F.lower(F.hex(F.substring(head, 1, 16)))
    image = F.lit(False)
    for magic in IMAGE_MAGIC:
        image = image | start.startswith(magic)
    return F.when(image, verdict("unsupported", "image")).otherwise(known)


def path_metadata(path: Column, year_default: Column | None = None) -> dict[str, Column]:
    """title, source_type and year of a file by its path."""
    folder = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))
    kind = F.when(folder.rlike("protocol|протокол"), "protocol").when(folder.rlike("report|отч"), "report").when(folder.rlike("article|стат"), "article").when(folder.rlike("patent|патент"), "patent").otherwise("document")
    year = F.regexp_extract(path, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")
    return {"title": F.regexp_replace(file_name(path), r"\.[^.]+$", ""), "source_type": kind, "year": year if year_default is None else F.coalesce(year, year_default)}


def inventory(files: DataFrame, root: str = "") -> DataFrame:
    """(dimension, value, files, bytes) of files (path, length): by suffix, top folder, year, language, size, status and reason."""
    told = files.select("path", "length", triage(F.col("path")).alias("t"))
    value = lambda name, c: F.struct(F.lit(name).alias("dimension"), F.coalesce(c.cast("string"), F.lit("")).alias("value"))
    folder = top_folder(F.col("path"), root)
    single = F.array(value("suffix", suffix(F.col("path"))), value("folder", folder), value("language", path_language(F.col("path"))), value("size", size_bucket(F.col("length"))), value("status", F.col("t.status")), value("reason", F.col("t.reason")))
    years = F.transform(path_years(F.col("path")), lambda y: F.struct(F.lit("year").alias("dimension"), y.alias("value")))
    return told.select("length", F.explode(F.concat(single, years)).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def largest(files: DataFrame, n: int = 20) -> DataFrame:
    return files.select("path", "length").orderBy(F.col("length").desc(), "path").limit(n)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicate_groups(files: DataFrame, keys: list[str], path: str = "path", limit: int = 20, most_paths: int = 10) -> DataFrame:
    """The largest groups of files with equal keys: keys, n, first paths and whether there are more. Only `most_paths` paths of a
    group are gathered, by rank within small blocks of the group and then within it."""
    block = files.withColumn("_block", F.pmod(F.xxhash64(path), F.lit(64)))
    local = block.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(path))).where(F.col("_n") <= most_paths)
    first = local.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(path))).where(F.col("_n") <= most_paths)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(path)).alias("paths"))
    sizes = files.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), *(F.col(k).desc() for k in keys)).limit(limit)
    return sizes.join(listed, keys).withColumn("truncated", F.col("n") > most_paths)


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, metadata, body) of text files with front matter."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(suffix(F.col("path")).isin("md", "txt", "json"))
    meta, body = front_matter(F.col("content").cast("string"))
    return rows.select("path", meta.alias("metadata"), body.alias("body"))


def typed_value(value: Column) -> Column:
    """struct(b, d, n): a front-matter value as boolean, double and integer, where it is one."""
    return F.struct(value.try_cast("boolean").alias("b"), F.when(value.contains("."), value.try_cast("double")).alias("d"), F.when(~value.contains("."), value.try_cast("long")).alias("n"))


def csv_text(rows: DataFrame, name: str = "csv") -> DataFrame:
    """(line_no order aside) the non-empty rows of a CSV as lines of cells joined by ' | '."""
    joined = F.concat_ws(" | ", *(F.col(f"`{c}`").cast("string") for c in rows.columns))
    return rows.select(F.lit(name).alias("sheet"), joined.alias("line")).where(F.regexp_replace("line", r"[\s|]", "") != "")


def _nodes(data: bytes, tag: str) -> list[str]:
    return [e.text or "" for e in ElementTree.fromstring(data).iter() if e.tag.rsplit("}", 1)[-1] == tag]


def _cells(archive: zipfile.ZipFile, name: str, shared: list[str]) -> Iterator[list[str]]:
    for row in (e for e in ElementTree.fromstring(archive.read(name)).iter() if e.tag.endswith("}row")):
        cells = []
        for cell in row:
            value = next((e.text or "" for e in cell.iter() if e.tag.endswith(("}v", "}t"))), "")
            cells.append(shared[int(value)] if cell.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
        if any(c.strip() for c in cells):
            yield cells


def office_sections(name: str, content: bytes) -> Iterator[tuple[str, str]]:
    """(locator, text) of the parts of an office document: word parts, slides, or sheets of at most 250 rows."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = archive.namelist()
    numbered = lambda pattern: sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: (int(re.search(r"\d+", n)[0]), n))
    kind = name.lower().rsplit(".", 1)[-1]
    if kind in ("docx", "docm"):
        for part in sorted(n for n in names if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes)\.xml", n)):
            yield f"[part: {part}]", " ".join(_nodes(archive.read(part), "t"))
    elif kind == "pptx":
        for i, part in enumerate(numbered(r"ppt/slides/slide\d+\.xml"), 1):
            yield f"[slide {i}: {part}]", " ".join(_nodes(archive.read(part), "t"))
    elif kind == "xlsx":
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in root if si.tag.endswith("}si")]
        titles = []
        if "xl/workbook.xml" in names:
            titles = [e.get("name") or "" for e in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
        for i, part in enumerate(numbered(r"xl/worksheets/sheet\d+\.xml")):
            rows = list(_cells(archive, part, shared))
            lines = [" | ".join(r) for r in rows[:SHEET_ROWS]] + (["[truncated]"] if len(rows) > SHEET_ROWS else [])
            yield f"[sheet: {titles[i] if i < len(titles) else part}]", "\n".join(lines)


def office_text(files: DataFrame) -> DataFrame:
    """(path, locator, text, error) of office files (path, content), one row a part; a file that cannot be read has its error."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, locator, text, None) for locator, text in office_sections(path, content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "locator", "text", "error"])

    return files.select("path", "content").mapInPandas(extract, "path string, locator string, text string, error string")


def safe_member(name: str) -> bool:
    """Whether an archive member stays inside the folder that it is put into."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return not (clean.startswith(("/", "..")) or re.match(r"^[A-Za-z]:", clean))


def expand_archives(files: DataFrame) -> DataFrame:
    """(path, member, content, error) of the members of ZIP files (path, content); unsafe names have an error and no content."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                safe = safe_member(info.filename)
                                yield pd.DataFrame([(path, info.filename, archive.read(info) if safe else None, None if safe else "unsafe_path")], columns=["path", "member", "content", "error"])
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([(path, None, None, f"BadZipFile: {e}")], columns=["path", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(expand, "path string, member string, content binary, error string")


def plan_load(files: DataFrame, manifest: DataFrame, limit: int | None = None, retry_failed: bool = False, retry_unsupported: bool = False) -> DataFrame:
    """(path, checksum, status, duplicate_of) for new files (path, checksum, triage): pending, duplicate_skipped or unsupported.

    Files that the manifest has as done are left out, failed and unsupported ones too unless they are retried. A file whose
    checksum is indexed, or that follows another new file with it by path, is a duplicate. The limit counts pending files."""
    skip = list(DONE) + ([] if retry_failed else ["failed"]) + ([] if retry_unsupported else ["unsupported"])
    new = files.join(manifest.where(F.col("status").isin(skip)).select("path"), "path", "left_anti")
    indexed = manifest.where("status = 'indexed' AND checksum IS NOT NULL").groupBy("checksum").agg(F.min("path").alias("_known"))
    first = new.where("triage <> 'unsupported'").groupBy("checksum").agg(F.min("path").alias("_first"))
    told = new.join(indexed, "checksum", "left").join(first, "checksum", "left")
    of = F.when(F.col("triage") == "unsupported", None).otherwise(F.coalesce("_known", F.when(F.col("_first") != F.col("path"), F.col("_first"))))
    status = F.when(F.col("triage") == "unsupported", "unsupported").when(of.isNotNull(), "duplicate_skipped").otherwise("pending")
    planned = told.select("path", "checksum", status.alias("status"), of.alias("duplicate_of"))
    if limit is None:
        return planned
    chosen = planned.where("status = 'pending'").orderBy("path").limit(limit)
    return chosen.unionByName(planned.where("status <> 'pending'"))


def upsert_manifest(manifest: DataFrame, news: DataFrame) -> DataFrame:
    """The manifest after news (path, checksum, status, source_id, error, updated_at): the newest row of a path wins, but its checksum
    and source stay where the newer row has none."""
    names = ("checksum", "status", "source_id", "error", "updated_at")
    latest = news.groupBy("path").agg(*(F.max_by(c, "updated_at").alias(f"_{c}") for c in names), F.lit(True).alias("_new"))
    both = manifest.join(latest, "path", "full")
    kept = {c: F.coalesce(f"_{c}", c) for c in ("checksum", "source_id")}
    return both.select("path", *((kept[c] if c in kept else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))).alias(c) for c in names))


def progress(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(suffix, status, n, action): files against the manifest, pending where it has none, and what to do about each status."""
    joined = files.select("path").join(manifest.select("path", "status"), "path", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    action = F.when(F.col("status") == "pending", "ingest").when(F.col("status") == "failed", "inspect_error_and_retry").when(F.col("status") == "unsupported", "convert_or_exclude").otherwise("none")
    return joined.groupBy(suffix(F.col("path")).alias("suffix"), "status").agg(F.count("*").alias("n")).withColumn("action", action)


#: Suffixes by what they need, names of archive volumes, and what counts as done.
LEGACY_OFFICE, IMAGES, SPLIT = ("doc", "xls", "ppt"), ("gif", "jpg", "jpeg", "png", "tif", "tiff"), ("001", "002")
VOLUME = r"(?i)\.part0*(\d+)\.rar$"


def _volume_action(path: Column, first: Column, tools: bool) -> Column:
    """What a volume of a RAR archive needs: later ones come with the first."""
    later = F.regexp_extract(file_name(path), VOLUME, 1).try_cast("int") > 1
    return F.when(F.coalesce(later, F.lit(False)), "skip_auxiliary_rar_volume").otherwise(first)


def pending_action(path: Column, status: Column, reason: Column, converts_office: bool = False, extracts_rar: bool = False) -> Column:
    """What a file that the manifest does not have needs, by its suffix and triage, and by the tools at hand."""
    kind = suffix(path)
    return (
        F.when(reason == "image", "requires_image_ocr_pipeline")
        .when(kind.isin(*LEGACY_OFFICE), "ingest_with_soffice_conversion" if converts_office else "install_soffice_for_legacy_office")
        .when(kind == "rar", _volume_action(path, F.lit("ingest_with_unrar_extraction" if extracts_rar else "install_unrar_for_rar"), extracts_rar))
        .when(kind == "zip", "ingest_zip_archive").when(kind == "001", "ingest_split_archive_reconstruction").when(kind == "002", "skip_auxiliary_split_archive_part")
        .when(kind.isin(*IMAGES), "requires_image_ocr_pipeline").when(status == "supported", "continue_batch_ingest").when(status == "supported_archive", "continue_archive_ingest")
        .otherwise("manual_format_triage")
    )


def retry_action(path: Column, status: Column, error: Column, converts_office: bool = False, extracts_rar: bool = False) -> Column:
    """What an unsupported or failed file of the manifest waits for; null for others."""
    kind, said = suffix(path), F.coalesce(error, F.lit(""))
    unsupported = F.when(said == "image", "wait_for_image_ocr_pipeline")
    if converts_office:
        unsupported = unsupported.when(kind.isin(*LEGACY_OFFICE), "retry_unsupported_with_soffice")
    unsupported = unsupported.when(kind == "rar", _volume_action(path, F.lit("retry_unsupported_with_unrar" if extracts_rar else "manual_format_triage"), extracts_rar))
    unsupported = unsupported.when(kind == "001", "retry_split_archive_reconstruction").when(kind == "002", "skip_auxiliary_split_archive_part").when(kind.isin(*IMAGES), "wait_for_image_ocr_pipeline").otherwise("manual_format_triage")
    return F.when(status == "unsupported", unsupported).when((status == "failed") & (said == "no_chunks"), "requires_ocr_for_failed_document").when(status == "failed", "retry_failed_after_error_triage")


def progress_report(files: DataFrame, manifest: DataFrame, root: str, sample: int = 10, converts_office: bool = False, extracts_rar: bool = False) -> DataFrame:
    """(part, key, n, samples) of files (path) below root against the manifest (path, status, error): totals; the manifest by status, by suffix and status, of
    files that are there and of others; pending files by status, suffix, folder and action; failures by error; retries by action. samples:
    the first paths of pending states and actions, errors and retries.

    Files and manifest meet once, each row gives its few (part, key), and sums are combined before the shuffle; samples are the first of each
    block of a key and then of these, so a key's paths are never in one place."""
    told = triage(F.col("path"))
    both = files.select("path", F.lit(True).alias("_there")).join(manifest.select("path", "status", "error", F.lit(True).alias("_listed")), "path", "full")
    there, listed = F.coalesce("_there", F.lit(False)), F.coalesce("_listed", F.lit(False))
    folder = F.when(top_folder(F.col("path"), root) != "", top_folder(F.col("path"), root)).otherwise("<root>")
    kind = F.when(suffix(F.col("path")) != "", suffix(F.col("path"))).otherwise("<none>")
    pending, failed = there & ~listed, listed & (F.col("status") == "failed")
    retry = retry_action(F.col("path"), F.col("status"), F.col("error"), converts_office, extracts_rar)
    parts = [
        (there, "total", F.lit("files"), False), (listed, "total", F.lit("manifest"), False), (there & listed, "total", F.lit("manifested"), False), (pending, "total", F.lit("pending"), False),
        (there & listed & F.col("status").isin(*DONE), "total", F.lit("done"), False), (listed, "status", F.col("status"), False), (listed, "suffix_status", F.concat_ws(":", kind, "status"), False), (there & listed, "root_status", F.col("status"), False),
        (listed & ~there, "total", F.lit("elsewhere"), False), (pending, "pending_status", told["status"], True), (pending, "pending_suffix", kind, False), (pending, "pending_folder", folder, False),
        (pending, "pending_action", pending_action(F.col("path"), told["status"], told["reason"], converts_office, extracts_rar), True), (failed, "error", F.coalesce("error", F.lit("<unknown>")), True), (listed & retry.isNotNull(), "retry_action", retry, True),
    ]
    each = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(sampled).alias("sampled"))) for when, part, key, sampled in parts)))
    rows = both.select("path", F.explode(each).alias("x")).select("path", "x.*")
    counts = rows.groupBy("part", "key").agg(F.count("*").alias("n"))
    block = rows.where("sampled").withColumn("_block", F.pmod(F.xxhash64("path"), F.lit(64)))
    some = block.withColumn("_n", F.row_number().over(Window.partitionBy("part", "key", "_block").orderBy("path"))).where(F.col("_n") <= sample)
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy("part", "key").orderBy("path"))).where(F.col("_n") <= sample)
    return counts.join(first.groupBy("part", "key").agg(F.array_sort(F.collect_list("path")).alias("samples")), ["part", "key"], "left")


def missing_embeddings(documents: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Documents without a vector of the model."""
    return documents.join(embeddings.where(F.col("model") == model).select("document_id"), "document_id", "left_anti")
