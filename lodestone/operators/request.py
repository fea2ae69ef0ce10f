"""Whole search requests, many at once: parse, documents by tiers, facts, experiments, experts, contradictions, gaps, answer.

requests (query_id, text, and any of material, process, geography: array<string>, year_from, year_to: int, min_confidence: double,
strict, include_internal: boolean, answer_mode: string); what a request does not say comes from its text. Each tier of
documents is asked for the requests that earlier tiers left without one, by anti-joins; every found set is written once and
fanned out to what follows by query_id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.access import may_see
from ..functions.numeric import conversion_factor, interval, is_open, overlaps, scaled
from ..functions.text import NOISE_WORDS, normalize_key, ranked_tokens, search_tokens
from .extract import CATEGORIES, conditions, entities
from .facts import answer_mode, confidence, query_intent, query_years, search_experiments, search_experts
from .graph import sent, shared_table
from .index import TextIndex, meeting_all, ranks
from .retrieve import alias_tokens, best_of_sources, dot, hybrid_score, metadata_filter, relative_cut, substring_hits, top_k

#: Predicates that count as asked for whatever the property; groups of a category, of a query, and tokens of a group.
RECOMMENDED = ("recommendation", "recommended_condition")
MOST_OF_CATEGORY, MOST_GROUPS, MOST_TOKENS = 6, 8, 5
GROUPED = ("materials", "processes", "geography")
CONDITION = "struct<property:string,comparator:string,value:double,min_value:double,max_value:double,unit:string>"
OPTIONS = {
    "material": "array<string>", "process": "array<string>", "geography": "array<string>", "year_from": "int", "year_to": "int", "min_confidence": "double", "strict": "boolean",
    "include_internal": "boolean", "answer_mode": "string", "numeric_filters": f"array<{CONDITION}>",
}


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _given(own: str, parsed: Column) -> Column:
    """A request's own list, or what its text names."""
    return F.when(F.size(F.coalesce(own, _none())) > 0, F.col(own)).otherwise(parsed)


def parse(requests: DataFrame, terms: DataFrame, units: DataFrame, as_of_year: int) -> DataFrame:
    """requests with materials, processes, equipment, properties, geography_terms (sorted arrays of the names in the text), conditions (of
    the text and of numeric_filters), intent, and with year_from, year_to and geography filled from the text."""
    asked = requests.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONS.items() if c not in requests.columns})
    said = asked.select("query_id", "text")
    named = entities(said, terms).groupBy("query_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("canonical")))).alias(f"_{c}") for c, kind in CATEGORIES.items()))
    told = conditions(said, terms, units).orderBy("query_id", "start").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "property", "comparator", "value", "min_value", "max_value", "unit"))).alias("_c"))
    joined = asked.join(named, "query_id", "left").join(told, "query_id", "left").withColumns({f"_{c}": F.coalesce(f"_{c}", _none()) for c in CATEGORIES})
    fields = ["property", "comparator", "value", "min_value", "max_value", "unit"]
    own = F.coalesce(F.transform("_c", lambda c: F.struct(*(c[f].alias(f) for f in fields))), F.array().cast(f"array<{CONDITION}>"))
    years = query_years(F.col("text"), as_of_year)
    return joined.select(
        "query_id", "text", F.col("_materials").alias("materials"), F.col("_processes").alias("processes"), F.col("_equipment").alias("equipment"), F.col("_properties").alias("properties"), F.col("_geography").alias("geography_terms"),
        _given("material", F.col("_materials")).alias("wanted_materials"), _given("process", F.col("_processes")).alias("wanted_processes"), _given("geography", F.col("_geography")).alias("q_geography"),
        F.coalesce("year_from", years["year_from"]).alias("year_from"), F.coalesce("year_to", years["year_to"]).alias("year_to"), query_intent(F.col("text")).alias("intent"),
        F.concat(own, F.coalesce("numeric_filters", F.array().cast(f"array<{CONDITION}>"))).alias("conditions"), F.size(own).alias("n_own_conditions"), F.coalesce("min_confidence", F.lit(0.0)).alias("min_confidence"),
        F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("include_internal", F.lit(True)).alias("include_internal"), F.coalesce("answer_mode", F.lit("auto")).alias("asked_mode"),
    )


def _named_terms(parsed: DataFrame) -> DataFrame:
    """(query_id, category, canonical, nth): the names in each query's text, numbered in their category."""
    out = None
    for category in CATEGORIES:
        column = "geography_terms" if category == "geography" else category
        one = parsed.select("query_id", F.lit(category).alias("category"), F.posexplode(column).alias("nth", "canonical"))
        out = one if out is None else out.unionByName(one)
    return out


def with_tokens(parsed: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed with aliases and tokens, groups (query_id, group_id, prefix)): the search tokens, those of aliases first, and the groups of
    the structured match: one for each material, process and place that a query names, of queries with two at least."""
    named = _named_terms(parsed)
    aliases = alias_tokens(named.select("query_id", "canonical").distinct(), terms).withColumnRenamed("tokens", "aliases")
    joined = parsed.join(aliases, "query_id", "left").withColumn("aliases", F.coalesce("aliases", _none()))
    tokens = ranked_tokens(F.col("aliases"), search_tokens(F.col("text")))
    order = F.concat(*(F.when(F.col("category") == c, F.lit(str(i))).otherwise(F.lit("")) for i, c in enumerate(GROUPED)))
    kept = named.where(F.col("category").isin(*GROUPED) & (F.col("nth") < MOST_OF_CATEGORY)).withColumn("group_id", F.concat(order, F.lpad("nth", 2, "0"), F.lit(":"), F.col("canonical")))
    own = kept.join(terms.select("category", "canonical", "alias"), ["category", "canonical"], "left")
    ranked = top_k(own.withColumn("key", F.struct("query_id", "group_id")), 8, "alias", group="key").groupBy("query_id", "group_id", "canonical").agg(F.array_sort(F.collect_list("alias")).alias("names"))
    words = F.flatten(F.transform(F.concat(F.array("canonical"), F.split("canonical", "_"), F.col("names")), lambda w: search_tokens(w)))
    useful = F.slice(F.array_distinct(F.filter(words, lambda t: ~t.isin(*NOISE_WORDS))), 1, MOST_TOKENS)
    sets = ranked.select("query_id", "group_id", useful.alias("prefixes")).where(F.size("prefixes") > 0)
    first = top_k(sets, MOST_GROUPS, "group_id")
    enough = first.groupBy("query_id").count().where("count >= 2").select("query_id")
    groups = first.join(enough, "query_id", "left_semi").select("query_id", "group_id", F.explode("prefixes").alias("prefix"))
    return joined.withColumn("tokens", tokens), groups


@dataclass
class Corpus:
    """The tables that requests are asked of. access: a predicate on sources; embed: makes (key, vector) of (key, text)."""

    index: TextIndex
    chunks: DataFrame
    sources: DataFrame
    source_entities: DataFrame
    facts: DataFrame
    experiments: DataFrame
    experts: DataFrame
    access: Column
    embed: Callable[..., DataFrame]


def visible(corpus: Corpus) -> DataFrame:
    """(source_id, title, year, reliability_score, geography, additional_geography, confidentiality) of the sources that may be seen."""
    have = corpus.sources.columns
    columns = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("title", "year", "reliability_score", "geography", "additional_geography", "confidentiality")]
    return corpus.sources.where(corpus.access).select(F.col("id").alias("source_id"), *columns)


def documents(asked: DataFrame, groups: DataFrame, corpus: Corpus, k: int = 8) -> DataFrame:
    """The k best sources of each query: (query_id, source_id, document_id, method, rank, score, matched_entities, year, ...).

    Tiers: all groups of the structured match, any token, substrings (2k rows each, by rank, reliability, year and id), then the most
    reliable chunks that the query may see (10k, 40 to 160). Access and metadata come before every limit."""
    seen = visible(corpus)
    places = corpus.chunks.select("document_id", "source_id").join(seen, "source_id")
    told = places.select("document_id", "year", "reliability_score", "geography", "additional_geography", "confidentiality")
    limits = asked.select("query_id", "year_from", "year_to", "q_geography", "include_internal")
    fits = metadata_filter() & (F.col("include_internal") | (F.coalesce("confidentiality", F.lit("internal")) == "public"))
    sure = [F.col("reliability_score").desc_nulls_last(), F.col("year").desc_nulls_last()]

    def within(rows: DataFrame) -> DataFrame:
        return rows.join(sent(limits), "query_id").join(told, "document_id").where(fits).select("query_id", "document_id", "rank", "year", "reliability_score")

    wanted = asked.select("query_id", F.explode("tokens").alias("prefix"))
    key = corpus.chunks.schema["document_id"].dataType
    # dealt by document, hits give ranks and meet what is told of a document without another shuffle of all pairs of query and document
    by_document = corpus.index.hits(groups.select("prefix").unionByName(wanted.select("prefix")), key).repartition("document_id")
    strict = within(ranks(by_document, groups).join(meeting_all(by_document, groups), ["query_id", "document_id"], "left_semi"))
    by_rank = [F.round("rank", 9), *sure, "document_id"]
    first = shared_table(top_k(strict, 2 * k, *by_rank).withColumn("method", F.lit("structured")))
    left = asked.join(first.select("query_id").distinct(), "query_id", "left_anti")
    any_of = within(ranks(by_document, wanted.join(left.select("query_id"), "query_id", "left_semi")))
    second = shared_table(top_k(any_of, 2 * k, *by_rank).withColumn("method", F.lit("bm25")))
    left = shared_table(left.join(second.select("query_id").distinct(), "query_id", "left_anti"))
    found = first.unionByName(second)
    # texts are searched, and the most reliable chunks chosen, only if some query is left
    if not left.isEmpty():
        spoken = left.where(F.size("tokens") > 0)
        inside = substring_hits(corpus.chunks, spoken.select("query_id", "tokens")).withColumn("rank", F.lit(0.0))
        third = shared_table(top_k(within(inside), 2 * k, *sure, "document_id").withColumn("method", F.lit("like")))
        left = left.join(third.select("query_id").distinct(), "query_id", "left_anti")
        # what is left shares one choice for each set of limits; a query without tokens takes its 2k as a match
        asks = ["year_from", "year_to", "q_geography", "include_internal"]
        kinds = left.select("query_id", *asks, (F.size("tokens") == 0).alias("mute")).withColumn("kind", F.xxhash64(*asks))
        each = kinds.select("kind", *asks).dropDuplicates(["kind"])
        most = min(160, max(40, 10 * k))
        shared = top_k(each.crossJoin(told).where(fits).select("kind", "document_id", "year", "reliability_score"), most, *sure, F.col("document_id").desc(), group="kind")
        mute = top_k(each.crossJoin(told).where(fits).select("kind", "document_id", "year", "reliability_score"), 2 * k, *sure, "document_id", group="kind")
        chosen = lambda rows, mute_, rank, method: rows.join(kinds.where(F.col("mute") == mute_).select("query_id", "kind"), "kind").select("query_id", "document_id", F.lit(rank).cast("double").alias("rank"), "year", "reliability_score", F.lit(method).alias("method"))
        found = shared_table(found.unionByName(third).unionByName(chosen(mute, True, 0.0, "like")).unionByName(chosen(shared, False, None, "supplemental")))
    numbered = found.withColumn("candidate_rank", F.row_number().over(_of_query(F.round("rank", 9).asc_nulls_last(), *sure, F.when(F.col("method") == "supplemental", -F.col("document_id")).otherwise(F.col("document_id")))))
    # candidates are few: they meet texts and vectors as these are read, without a shuffle of either
    numbered = sent(shared_table(numbered.drop("year", "reliability_score")))
    rows = corpus.chunks.select("document_id", "source_id", "text").join(numbered, "document_id").join(seen, "source_id")
    want = F.array_distinct(F.concat("wanted_materials", "wanted_processes", "properties"))
    rows = rows.join(asked.select("query_id", want.alias("wanted"), F.array_distinct("aliases").alias("aliases")), "query_id")
    stored = corpus.index.documents(key).where("vector IS NOT NULL").select("document_id", F.col("vector").alias("_v")).join(numbered.select("document_id"), "document_id", "left_semi")
    query_text = F.concat_ws(" ", "text", F.array_join(F.concat("materials", "processes", "equipment", "properties", "geography_terms", "aliases"), " "))
    query_vectors = corpus.embed(asked.select("query_id", query_text.alias("text")), key="query_id").select("query_id", F.col("vector").alias("_q"))
    rows = rows.join(stored, "document_id", "left").join(query_vectors, "query_id", "left").join(corpus.source_entities, "source_id", "left")
    names, low = F.coalesce("names", _none()), normalize_key(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_low", low).withColumn("_names", names).withColumn("vector_score", dot(F.col("_v"), F.col("_q")))
    rows = rows.withColumn("score", hybrid_score(F.col("rank"), F.col("vector_score"), F.col("reliability_score"), F.col("wanted"), F.col("_names"), F.col("aliases"), F.col("_low")))
    rows = rows.withColumn("matched_entities", F.array_sort(F.array_intersect("wanted", "_names")))
    best = relative_cut(best_of_sources(rows.drop("_low", "_names", "names", "_v", "_q", "wanted", "aliases")))
    return top_k(best, k, F.col("score").desc(), F.coalesce("year", F.lit(0)).desc(), "candidate_rank")


def _of_query(*order: Column | str):
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(*order)


def _holds(condition: Column) -> Column:
    """Whether a condition holds for the fact in the row: properties agree if both have one, the fact's values come in the condition's
    unit, and the intervals meet."""
    span = interval(F.col("comparator"), F.col("value"), F.col("min_value"), F.col("max_value"))
    asks = interval(condition["comparator"], condition["value"], condition["min_value"], condition["max_value"])
    factor = conversion_factor(F.col("unit"), condition["unit"])
    same = condition["property"].isNull() | F.col("property").isNull() | (condition["property"] == F.col("property"))
    return same & (is_open(asks) | (factor.isNotNull() & ~is_open(span) & overlaps(scaled(span, factor), asks)))


def facts(asked: DataFrame, found: DataFrame, corpus: Corpus, k: int = 8) -> DataFrame:
    """The best max(20, 3k) facts of each query: of its found sources, if it has any; with a wanted property or a recommending
    predicate, if it wants any; confident enough; of sources that may be seen, or of none; those that name a core term
    (material or process: among the source's entities, as subject or as object) unless none does; by numeric match, confidence, year and id.

    A fact carries its query's few conditions beside it, so numeric matches need no join. Queries meet facts by source; those without
    a source meet them by property, or all of them where they want none, once for each set of wishes."""
    seen = visible(corpus).select("source_id", F.col("year").alias("source_year"), F.col("title").alias("source_title"), "confidentiality")
    known = corpus.sources.select(F.col("id").alias("source_id"), F.lit(True).alias("_known"))
    told = lambda rows: rows.join(known, "source_id", "left").join(seen.withColumn("_seen", F.lit(True)), "source_id", "left").where(F.col("_known").isNull() | F.col("_seen")).drop("_known", "_seen")
    props = F.array_distinct(F.concat("properties", F.filter(F.transform("conditions", lambda c: c["property"]), lambda p: p.isNotNull())))
    asks = asked.select("query_id", props.alias("_props"), "conditions", "min_confidence", "strict", "include_internal", F.transform(F.array_distinct(F.concat("materials", "processes")), lambda t: F.lower(t)).alias("_core"))
    recommends = F.coalesce(F.col("predicate").isin(*RECOMMENDED), F.lit(False))
    fits = (F.size("_props") == 0) | F.coalesce(F.array_contains("_props", F.col("property")), F.lit(False)) | recommends
    level = F.col("include_internal") | F.col("source_id").isNull() | (F.coalesce("confidentiality", F.lit("public")) == "public")
    by_source = found.select("query_id", "source_id").distinct()
    # facts meet the few found sources as they are read, and only those of found sources meet what is told of them
    named = told(corpus.facts.join(sent(by_source), "source_id")).join(asks, "query_id").withColumn("_sourced", F.lit(True))
    lone = asks.join(by_source.select("query_id").distinct(), "query_id", "left_anti")
    if not lone.isEmpty():
        # keys of a fact: its property, that it recommends, and one that all facts have; a query meets a fact by the first that both have
        wishes = lone.withColumn("_wish", F.explode(F.when(F.size("_props") == 0, F.array(F.lit("a"))).otherwise(F.concat(F.transform("_props", lambda p: F.concat(F.lit("p"), p)), F.array(F.lit("r"))))))
        keyed = told(corpus.facts).withColumn("_wish", F.explode(F.array_compact(F.array(F.lit("a"), F.when(recommends, F.lit("r")), F.when(F.col("property").isNotNull() & ~recommends, F.concat(F.lit("p"), "property"))))))
        named = named.unionByName(keyed.join(wishes, "_wish").drop("_wish").withColumn("_sourced", F.lit(False)))
    named = named.where(fits & level & (F.coalesce("confidence", F.lit(0.0)) >= F.col("min_confidence")))
    entities_ = corpus.source_entities.select("source_id", F.col("names").alias("_names"))
    core = F.coalesce(F.arrays_overlap("_core", F.coalesce("_names", _none())), F.lit(False)) | F.coalesce(F.array_contains("_core", normalize_key(F.col("subject"))), F.lit(False))
    if "object" in corpus.facts.columns:
        core = core | F.coalesce(F.array_contains("_core", normalize_key(F.col("object"))), F.lit(False))
    marked = named.join(entities_, "source_id", "left").withColumn("_is_core", core & F.col("_sourced"))
    marked = marked.withColumn("numeric_match", F.exists("conditions", _holds)).where(~F.col("strict") | (F.size("conditions") == 0) | F.col("numeric_match"))
    # both kinds are cut before they meet, and the limit keeps no more than max(20, 3k) of each
    order = [F.col("numeric_match").desc(), F.col("confidence").desc_nulls_last(), F.col("source_year").desc_nulls_last(), "fact_id"]
    most = max(20, 3 * k)
    kept = ["query_id", *corpus.facts.columns, "source_title", "source_year", "numeric_match"]
    cut = shared_table(top_k(marked.withColumn("_kind", F.struct("query_id", "_is_core")), most, *order, group="_kind").select(*kept, "_is_core", (F.size("_core") > 0).alias("_asks_core")))
    with_core = cut.groupBy("query_id").agg(F.max(F.col("_is_core") & F.col("_asks_core")).alias("_any"))
    return top_k(cut.join(with_core, "query_id").where(F.col("_is_core") | ~F.col("_any")), most, *order).select(*kept)


def contradictions(found: DataFrame, first: int = 10) -> DataFrame:
    """(query_id, subject, property, unit, n_facts, kind) among the facts of each query, the first in order of subject, property and
    unit; ranges as in facts.contradictions."""
    low = F.coalesce("value", "min_value")
    high = F.when(F.col("value").isNotNull(), F.col("value")).when(F.coalesce("max_value", F.lit(0.0)) != 0, F.col("max_value")).otherwise(F.col("min_value"))
    ends = F.struct(F.round(low, 6), F.round(high, 6))
    ranged = found.where((F.col("property") != "") & low.isNotNull())
    groups = ranged.groupBy("query_id", "subject", "property", "unit").agg(F.count("*").alias("n_facts"), F.max(low).alias("hi"), F.min(high).alias("lo"), F.min(ends).alias("a"), F.max(ends).alias("b"))
    kind = F.when(F.col("hi") > F.col("lo"), "contradiction").when(F.col("a") != F.col("b"), "range_divergence")
    rows = groups.where("n_facts >= 2").withColumn("kind", kind).where("kind IS NOT NULL").drop("hi", "lo", "a", "b")
    return top_k(rows, first, "subject", "property", "unit")


def gaps(asked: DataFrame, docs: DataFrame, found: DataFrame, tried: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, gap): no_documents; no_experiments, where materials or processes are named; rules (gap, process_terms, material_terms) whose terms a query
    names without an exact experiment for them; no_numeric_match, where the text has conditions and facts with a property exist but none matches."""
    without = lambda rows, have: rows.select("query_id").join(have.select("query_id").distinct(), "query_id", "left_anti")
    named = asked.where((F.size("wanted_materials") > 0) | (F.size("wanted_processes") > 0))
    keyed = asked.select("query_id", "processes", "materials", F.explode("processes").alias("_term")).join(rules.withColumn("_term", F.element_at("process_terms", 1)), "_term")
    met = keyed.where((F.size(F.array_except("process_terms", "processes")) == 0) & (F.size(F.array_except("material_terms", "materials")) == 0)).select("query_id", "gap")
    matched = found.where("numeric_match AND property IS NOT NULL")
    numeric = asked.where("n_own_conditions > 0").join(found.select("query_id").distinct(), "query_id", "left_semi")
    out = without(asked, docs).withColumn("gap", F.lit("no_documents")).unionByName(without(named, tried).withColumn("gap", F.lit("no_experiments")))
    exact = tried.where("exact").select("query_id").distinct()
    return out.unionByName(met.join(exact, "query_id", "left_anti")).unionByName(without(numeric, matched).withColumn("gap", F.lit("no_numeric_match")))


def run(requests: DataFrame, corpus: Corpus, terms: DataFrame, units: DataFrame, rules: DataFrame, as_of_year: int, k: int = 8) -> dict[str, DataFrame]:
    """All parts of the answers: parsed, sources, facts, experiments, experts, contradictions, gaps, and answers (query_id, mode, confidence)."""
    asked, groups = with_tokens(parse(requests, terms, units, as_of_year), terms)
    asked, groups = shared_table(asked), shared_table(groups)
    docs = shared_table(documents(asked, groups, corpus, k))
    found = shared_table(facts(asked, docs, corpus, k))
    tried = shared_table(search_experiments(corpus.experiments, asked.select("query_id", F.col("wanted_materials").alias("materials"), F.col("wanted_processes").alias("processes"), F.col("q_geography").alias("geography"), "year_from", "year_to"), k))
    people = search_experts(corpus.experts, asked.select("query_id", F.array_distinct(F.concat("materials", "processes", "equipment", "properties")).alias("topics")), k)
    against = shared_table(contradictions(found))
    missing = shared_table(gaps(asked, docs, found, tried, rules))
    counted = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").cast("int").alias(name))
    scores = docs.select("query_id", F.col("reliability_score").cast("double").alias("score")).unionByName(found.select("query_id", F.explode(F.array_compact(F.array(F.col("confidence").cast("double"), F.col("extraction_confidence").cast("double")))).alias("score"))).unionByName(tried.select("query_id", F.col("reliability_score").cast("double").alias("score"))).where("score IS NOT NULL")
    coverage = asked.select("query_id").join(counted(docs, "n_sources"), "query_id", "left").join(counted(tried, "n_experiments"), "query_id", "left").fillna(0)
    suspicious = counted(found.where("validation_status IS NOT NULL AND validation_status <> 'valid'"), "suspicious")
    penalties = asked.select("query_id").join(counted(missing, "gaps"), "query_id", "left").join(counted(against, "contradictions"), "query_id", "left").join(suspicious, "query_id", "left").fillna(0)
    sure = confidence(scores, coverage, penalties)
    auto = answer_mode(F.col("gaps"), F.col("text"), F.col("intent"))
    answers = asked.join(penalties, "query_id").join(sure, "query_id").select("query_id", F.when(F.col("asked_mode") == "auto", auto).otherwise(F.col("asked_mode")).alias("mode"), "confidence", "gaps", "contradictions", "suspicious")
    return {"parsed": asked, "sources": docs, "facts": found, "experiments": tried, "experts": people, "contradictions": against, "gaps": missing, "answers": answers}
