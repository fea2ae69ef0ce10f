"""The stored index, substring and interval joins, bounded neighborhoods, backfill, extraction in one pass: brute force and odd rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.numeric import CONVERSIONS
from lodestone.operators import backfill, extract, facts, graph, report, request, retrieve
from lodestone.operators.contain import contained, with_held
from lodestone.operators.index import TextIndex, meeting_all, ranks


FACT = "fact_id int, property string, comparator string, value double, min_value double, max_value double, unit string"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_substrings_meet_by_trigrams(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("abcä 😀") for _ in range(rnd.randrange(40)))) for i in range(200)] + [(900, None), (901, ""), (902, "(x.*) a\nb")]
    terms = ["a", "ab", "abc", "ab c", "cä", "ä😀a", "aaaa", "zzz", "", None, ".*", "a\nb", "a", "bcab a"]
    found = contained(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "k")
    assert sorted(map(tuple, found.collect())) == sorted({(k, t) for k, x in texts for t in terms if x is not None and t and t in x})
    physical = plan_of(found).split("== Physical Plan ==")[1]
    # the only rows that meet without a key are those of the lengths, one each
    assert "CartesianProduct" not in physical and all(line.endswith("BuildRight, Cross") for line in physical.splitlines() if "NestedLoop" in line)
    assert contained(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([], "term string"), "k").collect() == []


def test_texts_are_cut_into_trigrams_once(spark):
    """What is read twice is a checkpoint of the wanted runs, so the cross with the lengths is no part of the plan that follows."""
    texts = spark.createDataFrame([(1, "abcd"), (2, "xyz")], "k long, text string")
    found = contained(texts, spark.createDataFrame([("bcd",), ("q",)], "term string"), "k")
    assert "NestedLoop" not in plan_of(found) and list(map(tuple, found.collect())) == [(1, "bcd")]


def test_few_terms_are_found_as_many_are(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("abcä 😀") for _ in range(rnd.randrange(30)))) for i in range(100)] + [(900, None), (901, ""), (902, "(x.*) a\nb")]
    terms = ["a", "ab", "abc", "ab c", "cä", "ä😀a", "zzz", "", None, ".*", "a\nb", "a", "bcab a"]
    rows, asked = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted({(k, t) for k, x in texts for t in terms if x is not None and t and t in x})
    for few in (0, 64):
        assert sorted(map(tuple, contained(rows, asked, "k", few=few).collect())) == want
        held = {r.k: r.held for r in with_held(rows, asked, "k", few=few).collect()}
        assert len(held) == 103 and sorted((k, t) for k, ts in held.items() for t in ts) == want and all(ts == sorted(ts) for ts in held.values())
    # few terms cut no text into runs, and meet in no join
    assert "Join" not in plan_of(contained(rows, asked, "k")) and "regexp_extract_all" not in plan_of(contained(rows, asked, "k"))


def experiments_brute(exps, asked, k):
    out = set()
    fold = lambda ts: list(dict.fromkeys(t.lower() for t in ts or []))
    for q, ms, ps, places, low, high in asked:
        ms, ps, met, near = fold(ms), fold(ps), [], []
        for e in exps:
            said = " ".join(x for x in e[1:4] if x is not None).lower()
            n_m, n_p = sum(m in said for m in ms), sum(p in said or p.replace("_", " ") in said for p in ps)
            fits = (low is None or (e[5] is not None and e[5] >= low)) and (high is None or (e[5] is not None and e[5] <= high)) and (not places or e[4] in places)
            if fits and (not ms or n_m) and (not ps or n_p or n_m >= 2):
                met.append(e)
            elif any(t in said for t in ms + ps):
                near.append(e)
        rank = lambda e: (e[6] is None, -(e[6] or 0), e[5] is None, -(e[5] or 0), e[0])
        out |= {(q, e[0], bool(met)) for e in sorted(met or near, key=rank)[:k]}
    return out


def test_experiments_are_cut_by_kind_before_they_meet_queries(spark, monkeypatch):
    rnd = random.Random(4)
    exps = [(i, rnd.choice(["plain", "copper heap", "ore_x", None]), rnd.choice(["copper", "ore", "zinc", None]), rnd.choice(["heap leach", "heap_leach", "roast", None]), rnd.choice(["a", "b", None]), rnd.choice([2001, 2002, None]), rnd.choice([0.1, 0.5, None])) for i in range(400)]
    pick = lambda *xs: rnd.choice([None, [], *([x] for x in xs), list(xs)])
    asked = [(q, pick("copper", "Ore"), pick("heap_leach", "roast"), pick("a"), rnd.choice([None, 2002]), rnd.choice([None, 2001, 2002])) for q in range(120)] + [(500, ["absent"], [], None, None, None), (501, [""], ["ROAST"], ["c"], None, None)]
    # an empty term is no term of any text
    want = experiments_brute(exps, [(q, [m for m in ms or []] if q != 501 else ["\0"], *rest) for q, ms, *rest in asked], 3)
    kept, real = [], facts.shared_table
    monkeypatch.setattr(facts, "shared_table", lambda df: kept.append(real(df)) or kept[-1])
    rows = spark.createDataFrame(exps, "experiment_key long, title string, material string, process string, geography string, year int, reliability_score double").withColumn("result_summary", F.lit(""))
    found = facts.search_experiments(rows, spark.createDataFrame(asked, "query_id long, materials array<string>, processes array<string>, geography array<string>, year_from int, year_to int"), 3)
    assert {(r.query_id, r.experiment_key, r.exact) for r in found.collect()} == want and found.count() == len(want)
    best = kept[-1].groupBy("held", "geography", "year").count()
    assert best.where("count > 3").isEmpty() and kept[-1].count() < 400
    # one experiment or a thousand of a kind: as many rows meet the queries
    kept.clear()
    many = spark.range(1000).select(F.col("id").alias("experiment_key"), F.lit("copper").alias("title"), F.lit("ore").alias("material"), F.lit("roast").alias("process"), F.lit("").alias("result_summary"), F.lit("a").alias("geography"), F.lit(2001).alias("year"), F.lit(0.5).alias("reliability_score"))
    same = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit("copper")).alias("materials"), F.array(F.lit("roast")).alias("processes"), F.array().cast("array<string>").alias("geography"), F.lit(None).cast("int").alias("year_from"), F.lit(None).cast("int").alias("year_to"))
    assert facts.search_experiments(many, same, 8).count() == 400 and kept[-1].count() == 8


def test_facts_are_read_once_where_all_queries_have_sources(spark, tmp_path, monkeypatch):
    told = "fact_id string, source_id long, subject string, predicate string, property string, comparator string, value double, min_value double, max_value double, unit string, confidence double"
    spark.createDataFrame([(f"f{i}", i % 9, "s", "measured", "p", "=", 1.0, None, None, "g", 0.5) for i in range(60)], told).write.parquet(f"{tmp_path}/facts")
    sources = spark.createDataFrame([(i, "t", 2000, 0.5, "a", "b", "public" if i != 2 else "secret") for i in range(4)], "id long, title string, year int, reliability_score double, geography string, additional_geography string, confidentiality string")
    corpus = request.Corpus(None, None, sources, spark.createDataFrame([], "source_id long, names array<string>"), spark.read.parquet(f"{tmp_path}/facts"), None, None, F.col("confidentiality") == "public", None)
    asked = spark.createDataFrame([(1, [], [], [], [], 0.0, False, True), (2, [], [], [], [], 0.0, False, True)], f"query_id long, properties array<string>, materials array<string>, processes array<string>, conditions array<{request.CONDITION}>, min_confidence double, strict boolean, include_internal boolean")
    plans, real = [], request.shared_table
    monkeypatch.setattr(request, "shared_table", lambda df: plans.append(plan_of(df)) or real(df))
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "query_id long, source_id long")
    ids = lambda rows: {(r.query_id, r.fact_id) for r in rows.collect()}
    own = {(q, f"f{i}") for q, s in ((1, 1), (2, 3)) for i in range(60) if i % 9 == s}
    assert ids(request.facts(asked, pairs, corpus)) == own
    assert plans[-1].split("== Physical Plan ==")[1].count("FileScan") == 1
    # a query without a source still meets all facts that it may see, those of unknown sources too
    loose = sorted(f"f{i}" for i in range(60) if i % 9 != 2)
    known = [f for f in loose if int(f[1:]) % 9 < 4]
    got = ids(request.facts(asked, pairs.where("query_id = 1"), corpus))
    assert {f for q, f in got if q == 1} == {f for q, f in own if q == 1} and {f for q, f in got if q == 2} == set((known + [f for f in loose if f not in known])[:24])


DOCS = [(i, f"alpha beta{i % 7} {'gamma ' * (i % 4)}word{i}") for i in range(40)] + [(40, None), (41, ""), (42, "Café no nö")]


def test_index_grows_and_answers_as_one_pass_does(spark, tmp_path):
    chunks = spark.createDataFrame(DOCS, "document_id long, text string")
    index, kind = TextIndex(spark, f"file://{tmp_path}/index"), T.LongType()
    wanted = spark.createDataFrame([(1, "bet"), (1, "gam"), (2, "word1"), (3, "zz"), (4, "caf"), (4, "n")], "query_id int, prefix string")
    assert index.hits(wanted, kind).collect() == []
    assert index.add(chunks.where("document_id < 10"), shard_tokens=10) == 10
    # a run that died before it was committed is not read
    (tmp_path / "index" / "postings" / "generation=gdead" / "shard=0").mkdir(parents=True)
    assert index.add(chunks.unionByName(chunks.where("document_id = 20")), lambda new: new.select("document_id", F.array(F.lit(1.0)).alias("vector")), shard_tokens=10) == 33
    assert index.add(chunks) == 0
    got = {(r.query_id, r.document_id): round(r.rank, 9) for r in ranks(index.hits(wanted, kind), wanted).collect()}
    want = {(r.query_id, r.document_id): round(r.rank, 9) for r in retrieve.bm25(retrieve.postings(chunks), retrieve.document_lengths(chunks.fillna("", ["text"])), wanted).collect()}
    assert got == want and len(got) > 40
    assert index.documents(kind).where("vector IS NOT NULL").count() == 33 and index.documents(kind).count() == 43


def test_several_tasks_write_a_shard(spark, tmp_path):
    """A shard's tasks each count their own range of it, and each (token, document_id) once; so does an index whose ids repeat."""
    index, chunks = TextIndex(spark, f"file://{tmp_path}/index"), spark.createDataFrame(DOCS, "document_id long, text string")
    index.add(chunks.unionByName(chunks.where("document_id = 20")), shard_tokens=1000)
    assert index._read("shards", "shard int, first string, last string").count() == 1
    assert len(list(tmp_path.glob("index/postings/generation=*/shard=0/*.parquet"))) > 4
    rows = index._read("postings", "token string, document_id long, tf long, len int, shard int").select("token", "document_id", "tf")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, retrieve.postings(chunks).collect()))


def test_index_reads_only_the_shards_of_its_prefixes(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame(DOCS, "document_id long, text string"), shard_tokens=10)
    all_shards = index._read("shards", "shard int, first string, last string").count()
    wanted = spark.createDataFrame([("word3",), ("word3",)], "prefix string")
    picked = [s for shards in index.shards_of(wanted).values() for s in shards]
    assert 0 < len(picked) < all_shards / 2
    assert "shard#" in plan_of(index.postings(wanted, T.LongType())).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert {r.token[:5] for r in index.postings(wanted, T.LongType()).collect()} >= {"word3"}


def test_texts_are_cut_into_words_once(spark, tmp_path, monkeypatch):
    from lodestone.operators import index as module

    calls, real = [], module.index_words
    passes = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: passes.add(1) or t, "string").asNondeterministic()
    monkeypatch.setattr(module, "index_words", lambda text: calls.append(1) or real(seen(text)))
    index, chunks = TextIndex(spark, f"file://{tmp_path}/index"), spark.createDataFrame(DOCS, "document_id long, text string")
    assert index.add(chunks, shard_tokens=30) == 43 and len(calls) == 1 and passes.value == 43


def test_tokens_meet_the_lengths_of_prefixes_that_begin_alike(spark, tmp_path):
    index, chunks = TextIndex(spark, f"file://{tmp_path}/index"), spark.createDataFrame(DOCS, "document_id long, text string")
    index.add(chunks.where("document_id % 2 = 0"), shard_tokens=30)
    index.add(chunks, shard_tokens=30)
    words = [(i, w) for i, x in DOCS for w in re.findall(r"\w+", (x or "").replace("é", "e").replace("ö", "o").lower())]
    for prefixes in (["a", "bet", "beta1", "word", "word3", "n", "caf", "zz", "beta1"], ["gamma", "word12", "word1"], [""], []):
        wanted = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
        want = {}
        for p in set(prefixes):
            for i, w in words:
                if w.startswith(p):
                    want[p, i] = want.get((p, i), 0) + 1
        rows = index.hits(wanted, T.LongType()).collect()
        assert {(r.prefix, r.document_id): r.f for r in rows} == want and len(rows) == len(want)


def test_groups_are_and_of_or(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "prefix string, document_id long")
    groups = spark.createDataFrame([(1, "x", "a"), (1, "x", "c"), (1, "y", "b"), (2, "x", "b"), (3, "x", "q"), (3, "y", "b")], "query_id int, group_id string, prefix string")
    assert sorted(map(tuple, meeting_all(hits, groups).collect())) == [(1, 1), (2, 1), (2, 2)]


def matches_brute(rows, filters):
    factor = {(a, b): k for a, b, k in CONVERSIONS}
    span = lambda op, v, lo, hi: (lo, hi) if v is None or op == "between" else (None, v) if op in ("<=", "<") else (v, None) if op in (">=", ">") else (v, v)
    out = set()
    for q, qp, *cond, qu in filters:
        for f, fp, *have, fu in rows:
            a, b = span(*cond), span(*have)
            if qp and fp and qp != fp:
                continue
            if a != (None, None):
                k = 1.0 if not qu or not fu or qu == fu else factor.get((fu, qu))
                if k is None or b == (None, None):
                    continue
                b = tuple(None if x is None else x * k for x in b)
                lows, highs = [x for x in (a[0], b[0]) if x is not None], [x for x in (a[1], b[1]) if x is not None]
                if lows and highs and max(lows) > min(highs):
                    continue
            out.add((q, f))
    return out


def test_numeric_matches_meet_by_bins(spark):
    rnd = random.Random(9)
    number = lambda: rnd.choice([None, 0.0, 1.0, 1000.0, 0.001, -2.0, 24.0, 1e15, -1e-15, rnd.uniform(-50, 50)])
    make = lambda i: (i, rnd.choice(["p", "q", None]), rnd.choice(["=", "<=", ">", "between", "?", None]), number(), number(), number(), rnd.choice(["g_l", "mg_l", "m3_h", "l_s", "m3_day", "x", None]))
    rows, filters = [make(i) for i in range(250)], [make(i % 60) for i in range(80)]
    kinds = "property string, comparator string, value double, min_value double, max_value double, unit string"
    found = facts.numeric_matches(spark.createDataFrame(rows, f"fact_id long, {kinds}"), spark.createDataFrame(filters, f"query_id long, {kinds}"))
    assert {(r.query_id, r.fact_id) for r in found.collect()} == matches_brute(rows, filters)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def bounded_brute(edges, seeds, depth, limit, fan_out):
    ends = {}
    for i, a, b in sorted(edges):
        if a != b:
            ends.setdefault(a, []).append((i, b))
            ends.setdefault(b, []).append((i, a))
    nodes, kept = [], []
    for seed in sorted({s for s, _ in seeds}):
        seen = {n: (0, k) for k, n in enumerate(sorted({n for s, n in seeds if s == seed})[:limit], 1)}
        frontier, met = dict(seen), {}
        for hop in range(1, depth + 1):
            found = {}
            for node, (_, by) in frontier.items():
                for i, other in ends.get(node, [])[:fan_out]:
                    met.setdefault((i, node, other), (hop, by))
                    if other not in seen:
                        found[other] = min(found.get(other, (by, i)), (by, i))
            frontier = {}
            for node in sorted(found, key=lambda n: (found[n], n)):
                if len(seen) < limit:
                    seen[node] = frontier[node] = (hop, len(seen) + 1)
        nodes += [(seed, n, d, k) for n, (d, k) in seen.items()]
        first = {}
        for (i, node, other), at in met.items():
            if node in seen and other in seen:
                first[i] = min(first.get(i, at), at)
        kept += [(seed, i, *at[:1], k) for k, (i, at) in enumerate(sorted(first.items(), key=lambda x: (x[1], x[0])), 1) if k <= 2 * limit]
    return sorted(nodes), sorted(kept)


@pytest.mark.parametrize("limit, fan_out, depth", [(5, 3, 4), (60, 100, 2), (12, 2, 3), (3, 50, 0)])
def test_bounded_graph(spark, limit, fan_out, depth):
    rnd = random.Random(limit)
    edges = [(i, rnd.randrange(40), rnd.randrange(40)) for i in range(150)] + [(1000 + i, 7, 100 + i) for i in range(80)]
    seeds = [(s, rnd.randrange(40)) for s in range(6)] + [(0, 7), (0, 7), (9, 999)]
    source = lambda i: None if i % 5 == 0 else i % 3
    df = spark.createDataFrame([(*e, source(e[0])) for e in edges], "id long, subject_id long, object_id long, source_id long")
    nodes, kept = graph.bounded_graph(df, spark.createDataFrame(seeds, "seed long, node long"), depth, limit, fan_out, spark.createDataFrame([(0,), (1,)], "id long"))
    want = bounded_brute([e for e in edges if source(e[0]) != 2], seeds, depth, limit, fan_out)
    assert sorted(tuple(r) for r in nodes.select("seed", "node", "depth", "nth").collect()) == want[0]
    assert sorted(tuple(r) for r in kept.select("seed", "id", "depth", "nth").collect()) == want[1]


def test_evidence_is_located_in_the_first_chunk_that_has_it(spark):
    body = "The leach test gave a recovery of ninety percent at twenty degrees over two days of stirring in the tank."
    long = body * 4
    chunks = [("s", 10, 0, "nothing"), ("s", 11, 1, f"x  {long[:130]} other"), ("s", 12, 2, f"yy {long}"), ("s", 13, 3, "short ore"), ("t", 20, 0, None), ("u", 30, 0, "")]
    facts_ = [(1, "s", long), (2, "s", body[:50]), (3, "s", "ore"), (4, "s", "absent"), (5, "t", "ore"), (6, "s", " "), (7, "s", None), (8, "u", "a"), (9, "none", "ore")]
    df = spark.createDataFrame(chunks, "source_id string, document_id long, chunk_no long, text string")
    wanted = spark.createDataFrame(facts_, "fact_id long, source_id string, evidence string").withColumn("needle", F.substring(F.trim("evidence"), 1, backfill.LONG))
    got = {r.fact_id: (r.document_id, r.start, r.stop) for r in backfill.located(wanted, df).collect()}
    assert got == {1: (11, 2, 122), 2: (11, 2, 52), 3: (13, 6, 9)}


def test_locators_of_markers(spark):
    rows = [(1, 0, "[page  7] a", None), (2, 1, "[slide 3: Title part] a", None), (3, 2, "[sheet: Data; rows: 5] a", None), (4, 3, "[part: word/document.xml] a", None), (5, 4, "plain", None), (6, 5, "[page 9]", "own"), (7, 6, None, None)]
    df = spark.createDataFrame(rows, "document_id long, chunk_no long, text string, locator string").withColumns({"locator_type": F.lit(None).cast("string"), "start_char": F.lit(None).cast("int"), "end_char": F.lit(None).cast("int")})
    assert {r.document_id: r.locator for r in backfill.with_locators(df).collect()} == {1: "page 7", 2: "slide 3", 3: "Data", 4: "word/document.xml", 5: "chunk 5", 6: "own", 7: "chunk 7"}


def test_one_pass_finds_what_a_pass_for_each_category_does():
    terms = [("materials", "copper", "copper"), ("materials", "ore", "copper ore"), ("materials", "ore2", "ore"), ("processes", "leach", "heap leaching"), ("processes", "ore_run", "ore"), ("properties", "temp", "t"), ("equipment", "pump", "c++ pump"), ("geography", "x", ""), ("other", "y", "ore")]
    finder, rnd = extract.Finder(terms), random.Random(2)
    for _ in range(300):
        text = " ".join(rnd.choice(["copper", "ore", "Copper ORE", "coppery", "heap  leaching", "t", "tt", "c++ pumps", "İ", ",", "ore_", "ore-x"]) for _ in range(rnd.randrange(12)))
        flat, want = " ".join(text.split()), set()
        for category, kind in extract.CATEGORIES.items():
            mine = sorted({a for c, _, a in terms if c == category and a}, key=lambda a: (-len(a), a))
            if mine:
                best = {}
                for m in re.finditer("|".join(rf"(?<!\w){re.escape(a)}(?!\w)" if re.fullmatch(r"\w+", a) else re.escape(a) for a in mine), flat, re.IGNORECASE):
                    for c, n, a in terms:
                        if c == category and a == m[0].lower():
                            best.setdefault(n, (m.start(), m.end()))
                want |= {(kind, n, *at) for n, at in best.items()}
        assert {(h["type"], h["canonical"], h["start"], h["stop"]) for h in finder.entities(text)} == want
    assert finder.entities(None) == [] and extract.Finder([]).entities("ore") == []


def test_reports_have_eight_subjects_of_five_facts(spark):
    rows = [(1, f"f{s:02}{i:02}", f"s{s}", "p", "m", 1.0 - s / 100 - i / 1000, i % 9 == 0, 2000) for s in range(10) for i in range(7)]
    df = spark.createDataFrame(rows, "query_id int, fact_id string, subject string, property string, predicate string, confidence double, numeric_match boolean, source_year int")
    got = report.fact_groups(df).collect()
    assert {r.subject_key for r in got} == {f"s{s}" for s in range(8)} and len(got) == 40
    assert [r.fact_id for r in sorted(got, key=lambda r: (r.subject_nth, r.fact_nth))][:6] == ["f0000", "f0001", "f0002", "f0003", "f0004", "f0100"]
    lines = spark.createDataFrame([(1, "02 B", [0], "x"), (1, "10 C", [0], "z"), (1, "02 B", [1, 0], "y")], "query_id int, section string, position array<int>, line string")
    assert report.markdown(lines).first().markdown == "## B\nx\ny\n\n## C\nz"


def test_facts_and_filters_are_never_broadcast(spark):
    facts_ = spark.createDataFrame([(1, "p", "=", 1.0, None, None, "g_l")], FACT)
    asked = spark.createDataFrame([(1, "p", "<=", 1.0, None, None, "g_l"), (2, None, None, None, None, None, None)], "query_id int, property string, comparator string, value double, min_value double, max_value double, unit string")
    found = facts.numeric_matches(facts_, asked)
    assert "BroadcastHashJoin" not in plan_of(found) and {(r.query_id, r.fact_id) for r in found.collect()} == {(1, 1), (2, 1)}


def test_counts_equal_those_of_pairs_and_make_none(spark):
    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    one = lambda i: (i, pick("p", "q", None), pick("=", "<=", ">", "between", None), pick(None, 0.0, -0.0, 1.0, 1000.0, float(rnd.randrange(-5, 30))), pick(None, -3.0, 2.0, 7.0), pick(None, 1.0, 7.0, 9000.0), pick("g_l", "mg_l", "l_s", "m3_h", "m3_day", "celsius", None))
    facts_, asked = spark.createDataFrame([one(i) for i in range(150)], FACT), spark.createDataFrame([one(i) for i in range(200)], FACT).withColumnRenamed("fact_id", "query_id")
    pairs = facts.numeric_matches(facts_, asked).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("fact_id").alias("facts"))
    found = facts.match_counts(facts_, asked)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))
    # pairs of facts and filters meet in no join: the only one is that of the ranges' offsets
    assert plan_of(facts.match_counts(facts_, asked)).split("== Physical Plan ==")[1].count("Join") == 1


def test_a_chunk_without_an_end_counts_to_the_end_of_its_text(spark):
    chunks = spark.createDataFrame([("s", 1, 0, "tiny", "own")], "source_id string, document_id long, chunk_no long, text string, locator string").withColumns({"locator_type": F.lit(None).cast("string"), "start_char": F.lit(None).cast("int"), "end_char": F.lit(None).cast("int")})
    rows = spark.createDataFrame([(1, "s", None, "an evidence longer than the chunk")], "fact_id long, source_id string, document_id long, evidence string").withColumns({"evidence_locator": F.lit(None).cast("string"), "evidence_start": F.lit(None).cast("int"), "evidence_end": F.lit(None).cast("int")})
    got = backfill.backfill(rows, chunks, chunks.select("document_id"))["facts"].first()
    assert (got.document_id, got.evidence_locator, got.evidence_start, got.evidence_end) == (1, "own", 0, 4)


def test_locators_and_tables_locate_no_evidence(spark, tmp_path, monkeypatch):
    from lodestone.plans import source_queries

    spark.createDataFrame([(i, "s", f"text {i}\na | b\nc | d") for i in range(6)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(backfill, "located", lambda *_: pytest.fail("evidence was located"))
    monkeypatch.setattr(backfill, "shared_table", lambda *_: pytest.fail("texts were stored"))
    assert source_queries.a17_locators(spark, str(tmp_path)).count() == 6 and source_queries.a17_missing_tables(spark, str(tmp_path)).count() == 3


def test_missing_tables_have_all_their_rows(spark, tmp_path):
    from lodestone.plans import source_queries

    lines = "\n".join(f"{i} | x{i}" for i in range(120))
    spark.createDataFrame([(1, "s", f"a | b\n{lines}"), (3, "s", f"a | \n{lines}")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(source_queries.ORACLES["a17_missing_tables"]).fetchall()
    got = source_queries.a17_missing_tables(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.document_id: r.n_rows for r in got} == {1: 120, 3: 121}
    documents = spark.createDataFrame([("s", 1, "l", f"a | b\n{lines}")], "source_id string, document_id long, locator string, text string")
    table = backfill.missing_tables(documents, documents.where("false")).first()
    assert [{c.key: c.value for c in row} for row in table.rows] == [{"a": str(i), "b": f"x{i}"} for i in range(120)]


def test_evidence_is_located_as_by_search(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("ab é😀") for _ in range(n)).strip()
    texts = [word(rnd.randrange(1, 300)) for _ in range(60)]
    chunks = [(f"s{i % 3}", i, i // 3, texts[i // 2]) for i in range(120)]
    flat_ = {i: " ".join(t.split()) for _, i, _, t in chunks}
    wanted = []
    for f in range(200):
        body = flat_[rnd.randrange(120)]
        at = rnd.randrange(max(1, len(body)))
        needle = rnd.choice([body[at : at + rnd.randrange(1, 200)], body[at : at + 130] + " zz", word(3)]).strip()[: backfill.LONG]
        wanted.append((f, f"s{f % 4}", needle))
    want = {}
    for f, s, needle in wanted:
        for _, i, _, _ in sorted((c for c in chunks if c[0] == s), key=lambda c: c[2]):
            for part in [needle, needle[: backfill.SHORT]] if len(needle) >= backfill.LEAST else [needle]:
                if needle and f not in want and part in flat_[i]:
                    want[f] = (i, flat_[i].index(part), flat_[i].index(part) + len(part))
    got = backfill.located(spark.createDataFrame(wanted, "fact_id long, source_id string, needle string"), spark.createDataFrame(chunks, "source_id string, document_id long, chunk_no long, text string"))
    assert {r.fact_id: (r.document_id, r.start, r.stop) for r in got.collect()} == want


def test_vectors_shuffle_no_tokens_and_add_up_rows_of_one_key(spark):
    texts = ["electrolyte никель никель ёлка", "Electrolytes ab", None, "", "a", "ab ab electrolyte"]
    rows = [(i % 4, t) for i, t in enumerate(texts)] + [(9, None)]
    want = {}
    for k, t in rows:
        for token in re.findall(retrieve.TOKEN, (t or "").lower().replace("ё", "е")):
            for feature, w in [(token, 1.0), *((f"ng:{token[i : i + 3]}", 0.2) for i in range(len(token) - 2 if len(token) > 5 else 0))]:
                at, sign = retrieve._bucket(feature, retrieve.DIMS)
                want.setdefault(k, [0.0] * retrieve.DIMS)[at] += sign * w
    found = retrieve.embed(spark.createDataFrame(rows, "document_id int, text string"))
    got = {r.document_id: r.vector for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(v - w / sum(x * x for x in want[k]) ** 0.5) < 1e-6 for k in want for v, w in zip(got[k], want[k]))
    initial = plan_of(retrieve.embed(spark.createDataFrame(rows, "document_id int, text string"))).split("== Physical Plan ==")[1]
    assert initial.count("Exchange") == 1 and "Generate" not in initial


def test_sentences_about_parts_are_dealt_to_all_tasks(spark, tmp_path):
    from lodestone.plans import text_queries

    spark.range(50).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert text_queries.b11_numeric_conditions(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_are_searched_in_slices_of_a_batch(spark):
    from lodestone.operators.chunk import SLICE, chunk, chunks_of, found_in_texts

    texts = [None, "", *("word. " * n for n in range(0, 900, 7))]
    df = spark.createDataFrame([(i, t, None if i % 2 else [i]) for i, t in enumerate(texts)], "doc_id long, text string, tags array<long>").coalesce(1)
    want = [(i, None if i % 2 else [i], *c.values()) for i, t in enumerate(texts) for c in chunks_of(t)]
    got = chunk(df)
    assert got.columns == ["doc_id", "tags", "chunk_no", "text", "locator_type", "locator", "start_char", "end_char"] and sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[2])) == want
    sizes = found_in_texts(df, "text", lambda t: [{"n": 1}], "n int").select("doc_id").mapInArrow(lambda bs: bs, "doc_id long")
    assert sizes.count() == len(texts) > 2 * SLICE and "ArrowEvalPython" not in plan_of(got)
