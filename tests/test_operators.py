import datetime as dt

from pyspark.sql import functions as F

from lodestone.operators import chunk, curate, evaluate, extract, facts, governance, graph, retrieve

TERMS = [("processes", "leaching", "leaching"), ("materials", "nickel", "никель"), ("materials", "nickel", "nickel"), ("properties", "temperature", "temperature"), ("properties", "flow_velocity", "flow velocity")]
UNITS = [("mg_l", "mg/l"), ("mg_l", "мг/л"), ("m_s", "m/s"), ("percent", "%"), ("celsius", "°C")]


def test_chunks_locate_pages_and_sheets():
    said = "head text\n[page 2]\nfirst page. " + "word " * 600 + "\n[page 3]\nthird\n[sheet: S; part: x]\na | b\n1 | 2"
    got = chunk.chunks_of(said)
    assert [c["locator"] for c in got if c["locator_type"] == "page"][-1] == "page 3"
    assert got[0]["locator"] == "chunk 1" and got[-1]["text"] == "a | b\n1 | 2" and got[-1]["locator"] == "S"
    assert all(len(c["text"]) <= 1800 for c in got)
    assert chunk.chunks_of(None) == [] and chunk.chunks_of("  ") == []


def test_entities_keep_borders_and_the_earliest():
    f = extract.Finder(TERMS)
    got = f.entities("Nickel и НИКЕЛЬ; nickelous; leaching leaching")
    assert [(h["type"], h["canonical"], h["start"]) for h in got] == [("Material", "nickel", 0), ("Process", "leaching", 28)]
    assert f.entities(None) == []


def test_ranges_and_limits():
    m = extract.Measures(extract.Finder(TERMS), UNITS)
    got = m.conditions("sulfates 200-300 mg/l, limit ≤1000 мг/л, flow velocity <0,10 m/s, 120 %")
    assert [(h["comparator"], h["value"], h["min_value"], h["unit"]) for h in got] == [("between", None, 200.0, "mg_l"), ("<=", 1000.0, None, "mg_l"), ("<", 0.1, None, "m_s"), ("=", 120.0, None, "percent")]
    assert got[2]["property"] == "flow_velocity"


def test_suspicious_percent(spark):
    df = spark.createDataFrame([(1, "share 120 %")], "id int, text string")
    got = extract.conditions(df, spark.createDataFrame(TERMS, "category string, canonical string, alias string"), spark.createDataFrame(UNITS, "canonical string, alias string")).first()
    assert got.validation_status == "suspicious" and got.validation_warnings == ["percent_outside_0_100"]


def test_four_hops(spark):
    edges = spark.createDataFrame([(i, i, i + 1, "next") for i in range(1, 5)], "id long, subject_id long, object_id long, predicate string")
    seeds = spark.createDataFrame([(1,)], "seed long")
    reach = lambda d: {r.node for r in graph.neighborhood(edges, seeds, d).collect()}
    assert 5 not in reach(2) and 5 in reach(4)


def test_hub_fan_out_is_bounded(spark):
    edges = spark.createDataFrame([(i, 0, i, "x") for i in range(1, 50)], "id long, subject_id long, object_id long, predicate string")
    assert graph.neighborhood(edges, spark.createDataFrame([(0,)], "seed long"), 1, fan_out=10).count() == 11


def test_null_keys_are_never_repeats(spark):
    edges = spark.createDataFrame([(1, 1, "p", 2, None)] * 2 + [(1, 1, "p", 2, "e")] * 2, "source_id int, subject_id int, predicate string, object_id int, evidence string")
    assert graph.insert_edges(edges).count() == 3


def test_merge_and_split(spark):
    entities = spark.createDataFrame([(1, "M", "a", ["x"]), (2, "M", "b", ["y"]), (3, "P", "c", [])], "id long, type string, name string, aliases array<string>")
    found = spark.createDataFrame([(10, 2, 3), (11, 1, 3)], "id long, subject_id long, object_id long")
    edges = spark.createDataFrame([(1, 1, "p", 3, "e", 5), (1, 2, "p", 3, "e", 6)], "source_id long, subject_id long, predicate string, object_id long, evidence string, id long")
    e, f, g = graph.merge_entities(entities, found, edges, spark.createDataFrame([(2, 1)], "old_id long, new_id long"))
    assert {r.id: r.aliases for r in e.collect()}[1] == ["b", "x", "y"] and {r.subject_id for r in f.collect()} == {1} and g.count() == 1
    e, f, g = graph.split_entity(entities, found, edges, 1, spark.createDataFrame([(9, "M", "new", [])], entities.schema), spark.createDataFrame([(11,)], "fact_id long"), spark.createDataFrame([(5,)], "edge_id long"))
    assert {r.id: r.subject_id for r in f.collect()} == {10: 2, 11: 9} and {r.id: r.subject_id for r in g.collect()} == {5: 9, 6: 2} and e.count() == 4


def _fact(spark, rows):
    return spark.createDataFrame(rows, "fact_id int, property string, comparator string, value double, min_value double, max_value double, unit string")


def test_unit_aware_matches(spark):
    asked = spark.createDataFrame([(1, "tds", "<=", 1.0, None, None, "g_l"), (2, "flow", "=", 3.6, None, None, "m3_h"), (3, "mass", "between", None, 1.5, 2.5, "t_day")], "query_id int, property string, comparator string, value double, min_value double, max_value double, unit string")
    got = facts.numeric_matches(_fact(spark, [(1, "tds", "<=", 1000.0, None, None, "mg_l"), (2, "flow", "=", 1.0, None, None, "l_s"), (3, "mass", "=", 2000.0, None, None, "kg_day"), (4, "tds", "=", 5.0, None, None, "celsius"), (5, "tds", None, None, None, None, "g_l")]), asked)
    assert {(r.query_id, r.fact_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_contradictions(spark):
    rows = spark.createDataFrame([("a", "p", "u", 1.0, None, None), ("a", "p", "u", 5.0, None, None), ("b", "p", None, None, 1.0, 3.0), ("b", "p", None, None, 2.0, 4.0), ("c", "p", "u", 1.0, None, None)], "subject string, property string, unit string, value double, min_value double, max_value double")
    assert {(r.subject, r.kind) for r in facts.contradictions(rows).collect()} == {("a", "contradiction"), ("b", "range_divergence")}


def test_gaps(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "query_id int, terms array<string>")
    docs = spark.createDataFrame([(1,)], "query_id int")
    exps = spark.createDataFrame([(2, ["c"])], "query_id int, terms array<string>")
    rules = spark.createDataFrame([("ab_untested", ["a", "b"])], "gap string, required_terms array<string>")
    got = {(r.query_id, r.gap) for r in facts.gaps(q, docs, exps, docs, q.select("query_id"), rules).collect()}
    assert got == {(2, "no_documents"), (1, "no_experiments"), (2, "no_numeric_facts"), (1, "ab_untested")}


def test_query_years_and_intent(spark):
    q = spark.createDataFrame([("за последние 5 лет",), ("с 2015 по 2019",), ("в 2020 и 2018",), ("сравнение протоколов",)], "q string")
    got = q.select(facts.query_years(F.col("q"), 2024).alias("y"), facts.query_intent(F.col("q")).alias("i")).collect()
    assert [tuple(r.y) for r in got] == [(2020, 2024), (2015, 2019), (2018, 2020), (None, None)] and got[3].i == "experiments"


def test_fallback_takes_the_first_that_finds(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id int, document_id int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {(r.query_id, r.document_id, r.method) for r in retrieve.with_fallback(queries, rows((1, 10)), rows((1, 11), (2, 12)), rows((3, 13))).collect()}
    assert got == {(1, 10, 0), (2, 12, 1), (3, 13, 2)}


def test_embeddings_have_length_one(spark):
    got = retrieve.embed(spark.createDataFrame([(1, "electrolyte никель"), (2, "")], "document_id int, text string")).collect()
    assert [r.document_id for r in got] == [1] and abs(sum(v * v for v in got[0].vector) - 1) < 1e-5


def test_relative_cut(spark):
    rows = spark.createDataFrame([(1, 2.0, []), (1, 0.9, []), (1, 0.8, ["e"]), (2, 1.2, []), (2, 0.1, [])], "query_id int, score double, matched_entities array<string>")
    assert sorted((r.query_id, r.score) for r in retrieve.relative_cut(rows).collect()) == [(1, 0.8), (1, 2.0), (2, 0.1), (2, 1.2)]


AT = dt.datetime(2024, 1, 1)


def test_disputes_fold_in_order(spark):
    schema = "dispute_id long, fact_id long, seq long, action string, severity string, assignee string, actor string, due_at timestamp, resolution string, fact_status string, at timestamp"
    step = lambda seq, action, **x: (1, 7, seq, action, x.get("severity"), None, "me", None, x.get("resolution"), x.get("fact_status"), AT)
    got = curate.fold_disputes(spark.createDataFrame([step(4, "escalate"), step(1, "open", severity="low"), step(2, "comment"), step(3, "resolve", resolution="ok", fact_status="verified"), step(5, "comment")], schema)).first()
    assert (got.status, got.fact_status, got.n_comments, got.rejected) == ("resolved", "verified", 2, [4])


def test_supersede_chain_in_batches(spark):
    found = spark.createDataFrame([(i, "candidate", 1, None) for i in (1, 2, 3)], "id long, status string, version int, supersedes_fact_id long")
    commands = spark.createDataFrame([(1, 1, 2), (2, 2, 3)], "seq int, old_id long, new_id long")
    for batch in curate.batches(commands):
        found = curate.supersede_facts(found, batch)
    assert {r.id: (r.status, r.version) for r in found.collect()} == {1: ("superseded", 1), 2: ("superseded", 2), 3: ("candidate", 3)}


def test_approval_is_used_once(spark):
    keys = {"requester": "r", "action": "a", "export_format": "csv", "object_type": "o", "object_id": "1", "payload_hash": "h"}
    approvals = spark.createDataFrame([(1, "pending", AT + dt.timedelta(days=1), None, *keys.values())], "id int, status string, expires_at timestamp, consumed_at timestamp, " + ", ".join(f"{k} string" for k in keys))
    approvals = governance.review_approvals(approvals, spark.createDataFrame([(1, 1, "approved"), (2, 1, "rejected")], "seq int, id int, decision string"))
    uses = spark.createDataFrame([(1, 1, *keys.values(), AT), (2, 1, *keys.values(), AT), (3, 1, *{**keys, "payload_hash": "x"}.values(), AT)], "seq int, id int, " + ", ".join(f"{k} string" for k in keys) + ", at timestamp")
    after, outcomes = governance.consume_approvals(approvals, uses)
    assert [r.outcome for r in outcomes.orderBy("seq").collect()] == ["used", "already_used", "mismatch"] and after.first().status == "used"


def test_extraction_scores_with_nulls(spark):
    a = spark.createDataFrame([("x", None), ("y", 1)], "k string, v int")
    b = spark.createDataFrame([("x", None), ("z", 1)], "k string, v int")
    row = evaluate.extraction_scores(a, b, ["k", "v"]).first()
    assert (row.true_positives, row.false_positives, row.false_negatives, row.f1) == (1, 1, 1, 0.5)


def test_percentile_is_linear(spark):
    assert abs(evaluate.latency(spark.createDataFrame([("q", float(v)) for v in (10, 20, 30, 40)], "q string, ms double"), ["q"]).first().p95 - 38.5) < 1e-9


def test_search_filters_falls_back_and_ranks(spark):
    from lodestone.functions.access import may_see

    chunks = spark.createDataFrame([(1, 1, "nickel electrolyte leaching"), (2, 2, "nickel electrolyte"), (3, 3, "nickel"), (4, 4, "xnickelx only inside")], "document_id long, source_id long, text string")
    sources = spark.createDataFrame([(1, "a", 2020, 0.9, "public", "ural", None), (2, "b", 2010, 0.9, "public", "x", "ural"), (3, "c", 2020, 0.5, "secret", "ural", None), (4, "d", 2020, 0.4, "public", "y", None)], "id long, title string, year int, reliability_score double, confidentiality string, geography string, additional_geography string")
    queries = spark.createDataFrame([(1, ["nickel"], ["nickel"], 2015, None, []), (2, ["nick"], ["nickel"], None, None, ["ural"]), (3, ["nickelx"], [], None, None, None)], "query_id int, tokens array<string>, wanted array<string>, year_from int, year_to int, geography array<string>")
    vectors, asked = retrieve.embed(chunks), retrieve.embed(queries.select("query_id", F.concat_ws(" ", "tokens").alias("text")), key="query_id")
    found = retrieve.search(chunks, sources, queries, retrieve.postings(chunks), retrieve.document_lengths(chunks), vectors, asked, may_see(F.col("confidentiality"), "analyst"))
    assert {(r.query_id, r.source_id, r.method) for r in found.collect()} == {(1, 1, 0), (2, 1, 0), (2, 2, 0), (3, 4, 1)}


def test_embedding_equals_brute_force(spark):
    import hashlib
    import re

    import pytest

    from lodestone.operators import retrieve

    def brute(text):
        vector = [0.0] * 96
        for token in re.findall("[a-zA-Zа-яА-ЯёЁ0-9_]{2,}", text.lower().replace("ё", "е")):
            features = [(token, 1.0)] + [(f"ng:{token[i : i + 3]}", 0.2) for i in range(len(token) - 2) if len(token) > 5]
            for feature, weight in features:
                number = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
                vector[number % 96] += weight if number % 2 == 0 else -weight
        norm = sum(v * v for v in vector) ** 0.5
        return [v / norm for v in vector]

    texts = ["electrolyte ele lyte electrolyte", "ёлка и циркуляция католита 2020", "a bc def ghijkl"]
    rows = retrieve.embed(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")).collect()
    for r in rows:
        assert r.vector == pytest.approx(brute(texts[r.document_id]), abs=1e-6)


def test_decisions_close_active_assignments(spark):
    from lodestone.operators import curate

    assigned = spark.createDataFrame([(1, 7, "a", 10, None, "active"), (2, 8, "b", 10, None, "active"), (3, 9, "c", 10, 20, "released")], "seq int, fact_id int, assignee string, assigned_at int, released_at int, status string")
    decided = spark.createDataFrame([(7, 12), (7, 30), (8, 5), (9, 30)], "fact_id int, at int")
    got = {r.seq: (r.status, r.released_at) for r in curate.close_assignments(assigned, decided).collect()}
    assert got == {1: ("completed", 12), 2: ("active", None), 3: ("released", 20)}


def test_search_falls_back_to_the_most_reliable(spark):
    from lodestone.operators import retrieve

    chunks = spark.createDataFrame([(i, i, f"text number {i}") for i in range(6)], "document_id int, source_id int, text string")
    sources = spark.createDataFrame([(i, f"s{i}", 2000 + i, (i + 1) / 10) for i in range(6)], "id int, title string, year int, reliability_score double")
    queries = spark.createDataFrame([(1, ["zzzz"], [], None), (2, ["number"], [], None), (3, ["zzzz"], [], 2002)], "query_id int, tokens array<string>, wanted array<string>, year_to int").withColumn("year_from", F.lit(None).cast("int"))
    found = retrieve.search(chunks, sources, queries, retrieve.postings(chunks), retrieve.document_lengths(chunks), None, None, F.lit(True), k=2).collect()
    got = {q: [r.source_id for r in found if r.query_id == q] for q in (1, 2, 3)}
    assert sorted(got[1]) == [4, 5] and sorted(got[3]) == [1, 2] and len(got[2]) == 2


def test_experiments_fall_back_to_near_misses_of_any_year_and_place(spark):
    rows = [("e1", "Flash smelting of nickel", "nickel", "flash", "", "NO", 2020, 0.9), ("e2", "nickel and copper", "copper", "", "", "CA", 2010, 0.5), ("e3", "gold", "gold", "", "", "NO", 2021, 0.7)]
    exps = spark.createDataFrame(rows, "experiment_key string, title string, material string, process string, result_summary string, geography string, year int, reliability_score double")
    asked = spark.createDataFrame(
        [(1, ["nickel"], ["flash_smelting"], [], 2015, None), (2, ["nickel", "copper"], ["leaching"], ["CA"], None, None), (3, ["gold"], [], ["CA"], None, None), (4, [], [], ["NO"], 2021, None), (5, [], ["flash_smelting"], ["CA"], None, None), (6, None, None, None, None, None), (7, [], ["zinc"], [], None, None)],
        "query_id int, materials array<string>, processes array<string>, geography array<string>, year_from int, year_to int",
    )
    got = {(r.query_id, r.experiment_key, r.exact) for r in facts.search_experiments(exps, asked).collect()}
    assert got == {(1, "e1", True), (2, "e2", True), (3, "e3", False), (4, "e3", True), (6, "e1", True), (6, "e2", True), (6, "e3", True)}
    assert facts.search_experiments(exps.limit(0), asked).count() == 0


def test_experts_by_equal_topics_then_by_topics_inside(spark):
    experts = spark.createDataFrame([("a", ["Gold", "flash smelting"]), ("b", ["gold leaching"]), ("c", None)], "name string, expertise array<string>")
    asked = spark.createDataFrame([(1, ["gold", "flash_smelting"]), (2, ["flash_smelting"]), (3, []), (4, ["none"])], "query_id int, topics array<string>")
    got = {(r.query_id, r.name, r.score) for r in facts.search_experts(experts, asked).collect()}
    assert got == {(1, "a", 1), (1, "b", 1), (2, "a", 1), (3, "a", 0), (3, "b", 0), (3, "c", 0)}
    assert [r.name for r in facts.search_experts(experts, asked, k=2).where("query_id = 3").orderBy("name").collect()] == ["a", "b"]


def test_prefix_hits_count_each_token_under_its_prefixes(spark):
    index = spark.createDataFrame([("license", 1, 2), ("licensed", 1, 1), ("li", 2, 5), ("mit", 2, 1)], "token string, document_id int, tf long")
    wanted = spark.createDataFrame([(1, "li"), (1, "licen"), (2, "zz"), (2, "li")], "query_id int, prefix string")
    assert {tuple(r) for r in retrieve.prefix_hits(index, wanted).collect()} == {("li", 1, 3), ("li", 2, 5), ("licen", 1, 3)}
    assert retrieve.prefix_hits(index, wanted.limit(0)).count() == 0


def test_words_that_no_one_wants_are_not_shuffled(spark):
    """Wanted prefixes from the driver and from a checkpoint go to where words are read; accents and letters of several code units count as before."""
    chunks = spark.createDataFrame([(1, "Crème brûlée, ÉTÉ Ёж 𝔘x ſ İstanbul"), (2, "ete ete naïve"), (3, None), (4, "")], "document_id long, text string")
    wanted = spark.createDataFrame([(1, "ete"), (1, "cre"), (2, "ёж"), (2, "nai"), (3, "zz")], "query_id int, prefix string")
    for asked in (wanted, retrieve.shared_table(wanted)):
        found = retrieve.prefix_hits(retrieve.occurrences(chunks), asked)
        assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
        assert {tuple(r) for r in found.collect()} == {("ete", 1, 1), ("cre", 1, 1), ("ete", 2, 2), ("ёж", 1, 1), ("nai", 2, 1)}
    counted = chunks.select("document_id", F.size(retrieve.index_words(F.col("text"))).alias("a"), F.size(retrieve.index_tokens(F.col("text"))).alias("b")).collect()
    assert all(r.a == r.b for r in counted)


def test_search_without_an_index_cuts_each_text_once(spark, monkeypatch):
    said = ["Crème brûlée, ÉTÉ Ёж 𝔘x ſ İstanbul", "ete ete naïve et", None, "", "été nicht nichts"]
    read = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame(list(enumerate(said)), "document_id long, text string").withColumn("source_id", F.col("document_id"))
    counted = texts.withColumn("text", F.udf(lambda t: read.add(1) or t)("text"))
    wanted = spark.createDataFrame([(1, "ete"), (1, "crem"), (2, "ёж"), (2, "nai"), (3, "zz"), (3, "nicht"), (4, None)], "query_id int, prefix string")
    rounded = lambda rows: sorted((r.query_id, r.document_id, round(r.rank, 9)) for r in rows.collect())
    for most, asked in ((2, wanted), (100, wanted), (100, wanted.union(spark.createDataFrame([(5, "")], wanted.schema))), (100, wanted.limit(0))):
        monkeypatch.setattr(retrieve, "MOST_HEADS", most)
        full = retrieve.bm25(retrieve.occurrences(texts), retrieve.document_lengths(texts), asked)
        assert rounded(retrieve.bm25(*retrieve.wanted_words(texts, asked), asked)) == rounded(full)
    assert read.value == 0 and {r.token for r in retrieve.wanted_words(texts, wanted)[0].collect()} == {"et", "ete", "ёж", "naive", "nicht", "nichts", "creme"}
    retrieve.bm25(*retrieve.wanted_words(counted, wanted), wanted).collect()
    assert read.value == len(said)
    sources = spark.createDataFrame([(i, "t", 2020, 0.5) for i in range(len(said))], "id long, title string, year int, reliability_score double")
    queries = spark.createDataFrame([(1, ["nicht"], [])], "query_id int, tokens array<string>, wanted array<string>")
    assert [r.document_id for r in retrieve.search(texts, sources, queries, None, None, None, None, F.lit(True)).collect()] == [4]


def test_entity_names_take_more_tasks_for_more_edges(spark):
    edges = [(i % 3, i % 7, 10 + i % 11) for i in range(100)] + [(5, None, 6), (6, 99, 98)]
    names = {i: f"n{i % 5}" for i in range(21)}
    got = retrieve.entity_names(spark.createDataFrame(edges, "source_id int, subject_id int, object_id int"), spark.createDataFrame(list(names.items()), "id int, normalized_name string"), task_ends=20)
    expected = {}
    for source, *ends in edges:
        for end in ends:
            if end in names:
                expected.setdefault(source, set()).add(names[end])
    assert {r.source_id: set(r.names) for r in got.collect()} == expected
    assert got.rdd.getNumPartitions() >= 11
