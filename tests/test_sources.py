import io
import zipfile

from pyspark.sql import functions as F

from lodestone.sources import files, sinks, tables
from lodestone.streaming import ingest


def xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="Data"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si></sst>')
        rows = "".join(f'<row><c t="s"><v>0</v></c><c><v>{i}</v></c></row>' for i in range(251))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_office_and_archives(spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<d xmlns="w"><t>Hello</t><t>there</t></d>')
    got = files.office_text(spark.createDataFrame([("a.docx", docx.getvalue()), ("b.xlsx", xlsx()), ("c.pptx", b"broken")], "path string, content binary")).collect()
    by = {r.path: r for r in got}
    assert by["a.docx"].text == "Hello there" and by["b.xlsx"].locator == "[sheet: Data]" and by["b.xlsx"].text.endswith("[truncated]") and "BadZipFile" in by["c.pptx"].error
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("ok.txt", "fine")
        z.writestr("../evil.txt", "no")
    members = {r.member: r.error for r in files.expand_archives(spark.createDataFrame([("z.zip", archive.getvalue())], "path string, content binary")).collect()}
    assert members == {"ok.txt": None, "../evil.txt": "unsafe_path"}


def test_triage_sees_images(spark):
    rows = spark.createDataFrame([("a.txt", b"\x89PNG\r\n\x1a\nxx"), ("a.md", b"text"), ("b.zip", b"PK"), ("c", b"")], "path string, content binary")
    assert [tuple(r.t) for r in rows.select(files.triage(F.col("path"), F.col("content")).alias("t")).collect()] == [("unsupported", "image"), ("supported", "text"), ("supported_archive", "archive"), ("unsupported", "no_suffix")]


def test_limit_counts_new_files_only(spark):
    rows = spark.createDataFrame([("a", "1", "supported"), ("b", "1", "supported"), ("c", "2", "supported"), ("d", "9", "supported"), ("e", "3", "supported")], "path string, checksum string, triage string")
    manifest = spark.createDataFrame([("d", "9", "indexed"), ("x", "3", "indexed")], "path string, checksum string, status string")
    got = {r.path: (r.status, r.duplicate_of) for r in files.plan_load(rows, manifest, limit=1).collect()}
    assert got == {"a": ("pending", None), "b": ("duplicate_skipped", "a"), "e": ("duplicate_skipped", "x")}


def test_experiments_and_evidence(spark, tmp_path):
    (tmp_path / "x.csv").write_text('experiment_id,source_title,title,year,geography,material,process,conditions_json,metrics_json,result_summary,reliability_score,team\n1,s,T,2020,g,"a, b",p,"{""t"": ""5""}",,"two\nlines",0.5,me\n')
    row = tables.experiments(spark, str(tmp_path / "x.csv")).first()
    assert row.materials == ["a", "b"] and row.conditions == {"t": "5"} and row.year == 2020
    assert {(r.predicate, r.object) for r in tables.experiment_edges(tables.experiments(spark, str(tmp_path / "x.csv"))).collect()} == {("validated_by", "p"), ("uses_material", "a"), ("uses_material", "b")}
    sinks.write_evidence(spark.createDataFrame([(1, 'say "x"')], "fact_id int, evidence string"), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert tuple(back.columns) == sinks.EVIDENCE and back.first().evidence == 'say "x"'


def test_turtle_escapes(spark):
    line = sinks.turtle(spark.createDataFrame([(1, 'a"b\\c', "p", "o\nx", None)], "id int, subject string, predicate string, object string, confidence double")).first().line
    assert '"a\\"b\\\\c"' in line and '"o\\nx"' in line and line.endswith(" .")


def test_stream_resumes(spark, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    root.mkdir()
    (root / "a.txt").write_text("---\nyear: 2020\n---\nfirst text")
    (root / "b.txt").write_text("---\nyear: 2020\n---\nfirst text")
    ingest.start_ingest(spark, str(root), out, mark).awaitTermination()
    (root / "c.md").write_text("another")
    ingest.start_ingest(spark, str(root), out, mark).awaitTermination()
    status = {r.path.rsplit("/", 1)[-1]: r.status for r in spark.read.schema(ingest.MANIFEST).parquet(f"{out}/manifest").collect()}
    assert status == {"a.txt": "indexed", "b.txt": "duplicate_skipped", "c.md": "indexed"}
    assert sorted(r.text for r in spark.read.parquet(f"{out}/chunks").collect()) == ["another", "first text"]


def test_ingest_by_file_kind_and_replay(spark, tmp_path):
    import io
    import zipfile

    def office(name, body):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr(name, body)
        return held.getvalue()

    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    word = office("word/document.xml", '<w:document xmlns:w="x"><w:t>Word text</w:t></w:document>')
    sheet = office("xl/worksheets/sheet1.xml", '<s xmlns="x"><row><c><v>1</v></c><c><v>2</v></c></row></s>')
    (root / "a.md").write_text("---\nyear: 2020\n---\nmarked text")
    (root / "b.csv").write_text('x,y\n1,"2, 3"\n,,\n')
    (root / "c.docx").write_bytes(word)
    (root / "d.xlsx").write_bytes(sheet)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("in/e.txt", "inner text")
        z.writestr("../bad.txt", "unsafe")
        z.writestr("c.docx", word)
        z.writestr("f.exe", b"MZ")
    (root / "g.zip").write_bytes(held.getvalue())
    (root / "h.docx").write_bytes(b"not a zip")
    (root / "i.zip").write_bytes(b"neither")
    (root / "j.txt").write_text("  ")
    ingest.start_ingest(spark, str(root), out, str(tmp_path / "mark")).awaitTermination()
    base = f"file:{root}/"

    def state():
        rows = spark.read.schema(ingest.MANIFEST).parquet(f"{out}/manifest").where("batch >= 0").collect()
        return {r.path.replace("file://", "file:").removeprefix(base): (r.status, (r.error or "").split(":")[0]) for r in rows}, len(rows)

    expected = {
        "a.md": ("indexed", ""), "b.csv": ("indexed", ""), "c.docx": ("indexed", ""), "d.xlsx": ("indexed", ""), "g.zip": ("archive_indexed", ""), "g.zip!/in/e.txt": ("indexed", ""),
        "g.zip!/../bad.txt": ("failed", "unsafe_path"), "g.zip!/c.docx": ("duplicate_skipped", ""), "g.zip!/f.exe": ("unsupported", ""), "h.docx": ("failed", "BadZipFile"), "i.zip": ("failed", "BadZipFile"), "j.txt": ("failed", "no_chunks"),
    }
    assert state() == (expected, len(expected))
    chunks = lambda: sorted((r.path.rsplit("/", 1)[-1], r.text) for r in spark.read.parquet(f"{out}/chunks").collect())
    before = chunks()
    assert [t for _, t in before if "Word text" in t] and ("a.md", "marked text") in before and any("1 | " in t for _, t in before)
    again = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    ingest.ingest_batch(again, spark.read.schema(ingest.MANIFEST).parquet(f"{out}/manifest"), out, 0)
    assert chunks() == before and state() == (expected, len(expected))


def test_dictionaries_experts_and_reports(spark, tmp_path):
    import json

    from lodestone.operators import extract, governance

    (tmp_path / "d.json").write_text(json.dumps({"materials": {"nickel": ["никель", "Ni"]}, "geography": {"ural": ["Урал"]}}))
    assert {tuple(r) for r in extract.dictionary(spark, str(tmp_path / "d.json")).collect()} == {("materials", "nickel", "никель"), ("materials", "nickel", "Ni"), ("geography", "ural", "Урал")}
    (tmp_path / "u.json").write_text(json.dumps({"mg_l": ["мг/л", "mg/l"]}))
    assert extract.unit_dictionary(spark, str(tmp_path / "u.json")).count() == 2
    (tmp_path / "e.json").write_text(json.dumps([{"name": "A", "expertise": ["x", "y"], "geography": "g"}]))
    assert {r.object for r in tables.expert_edges(tables.experts(spark, str(tmp_path / "e.json"))).collect()} == {"x", "y"}
    sinks.write_reports(spark.createDataFrame([(1, "# one"), (2, "# two")], "query_id int, markdown string"), str(tmp_path / "r"))
    assert {(r.query_id, r.value) for r in spark.read.text(str(tmp_path / "r")).collect()} == {(1, "# one"), (2, "# two")}
    sinks.write_payloads(spark.createDataFrame([(1, "a")], "query_id int, x string"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().x == "a"
    log = spark.createDataFrame([("me", "export", "2024-01-01 10:00:00")], "actor string, action string, t string").select("actor", "action", F.to_timestamp("t").alias("created_at"))
    governance.append_audit(log, str(tmp_path / "audit"))
    governance.append_audit(log, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).where("date = '2024-01-01'").count() == 2


def test_request_log_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"method":"GET","path":"/x","status":500,"ms":5.0,"at":"2024-01-01T00:00:01Z"}\n{"method":"GET","path":"/x","status":200,"ms":15.0,"at":"2024-01-01T00:00:31Z"}\n{"method":"GET","path":"/y","status":200,"ms":1.0,"at":"2024-01-01T01:00:00Z"}\n')
    ingest.stream_request_metrics(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.path, row.requests, row.errors, row.avg_ms, row.max_ms) == ("/x", 2, 1, 10.0, 15.0)
    assert ingest.batch_request_metrics(spark, str(tmp_path / "log")).count() == 2


def states(spark, out):
    rows = spark.read.schema(ingest.MANIFEST).parquet(f"{out}/manifest").orderBy("batch").collect()
    return {r.path.rsplit("/in/", 1)[-1]: (r.status, (r.duplicate_of or "").rsplit("/in/", 1)[-1]) for r in rows}


def test_stateful_ingest_knows_earlier_batches(spark, tmp_path):
    """Duplicates across batches from the state alone, archives with members, broken files, and a repeated batch."""
    import shutil

    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    root.mkdir()
    (root / "b [1].txt").write_text("first text")
    (root / "a.txt").write_text("first text")
    (root / "x.exe").write_text("first text")
    (root / "bad.zip").write_bytes(b"PK broken")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("in.md", "inside")
        z.writestr("a.md", "first text")
    ingest.start_stateful_ingest(spark, str(root), out, mark).awaitTermination()
    first = states(spark, out)
    assert first["a.txt"] == ("indexed", "") and first["b [1].txt"] == ("duplicate_skipped", "a.txt") and first["x.exe"] == ("unsupported", "")
    assert first["bad.zip"][0] == "failed" and first["z.zip"] == ("archive_indexed", "") and first["z.zip!/in.md"] == ("indexed", "") and first["z.zip!/a.md"] == ("duplicate_skipped", "a.txt")
    # the manifest is not asked: without it the next batch still knows what came before
    shutil.move(f"{out}/manifest", str(tmp_path / "moved"))
    (root / "c.md").write_text("inside")
    (root / "d.md").write_text("new")
    (root / "e.md").write_text("  ")
    ingest.start_stateful_ingest(spark, str(root), out, mark).awaitTermination()
    second = states(spark, out)
    assert second == {"c.md": ("duplicate_skipped", "z.zip!/in.md"), "d.md": ("indexed", ""), "e.md": ("failed", "")}
    # a run that died after it wrote, before it was committed: the batch comes again and replaces itself
    last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for stale in (last, last.with_name(f".{last.name}.crc")):
        if stale.exists():
            stale.unlink()
    before = sorted(r.text for r in spark.read.parquet(f"{out}/chunks").collect())
    ingest.start_stateful_ingest(spark, str(root), out, mark).awaitTermination()
    assert states(spark, out) == second and sorted(r.text for r in spark.read.parquet(f"{out}/chunks").collect()) == before == ["first text", "inside", "new"]


def test_retry_takes_what_has_changed(spark, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.docx").write_bytes(b"broken")
    (root / "c.exe").write_text("two")
    ingest.start_stateful_ingest(spark, str(root), out, mark).awaitTermination()
    assert {k: v[0] for k, v in states(spark, out).items()} == {"a.txt": "indexed", "b.docx": "failed", "c.exe": "unsupported"}
    with zipfile.ZipFile(root / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:t>Mended</w:t></w:document>')
    assert ingest.retry_ingest(spark, out) == 1
    assert {k: v[0] for k, v in states(spark, out).items()} == {"a.txt": "indexed", "b.docx": "indexed", "c.exe": "unsupported"}
    assert ingest.retry_ingest(spark, out) == 0 and ingest.retry_ingest(spark, out, unsupported=True) == 1
    assert sorted(r.text for r in spark.read.parquet(f"{out}/chunks").collect()) == ["Mended", "one"]
