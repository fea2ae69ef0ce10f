"""Answer reports: the sections of many answers as lines with a sort key, and their text.

A section's lines come from bounded top lists (8 subjects by 5 facts, 12 compared facts and so on), so a query's report is of bounded
size whatever its found sets hold; sections and lines are put in order once, when the text is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many lines of each kind a report has.
SUBJECTS, FACTS_OF_SUBJECT, COMPARED, DIFFERENCES, CONTROLLED, TRIED_PROTOCOL, TABLED, TRIED, SOURCES, AGAINST, PEOPLE = 8, 5, 12, 3, 8, 5, 20, 8, 10, 5, 6
CONDITION_WORDS = {"gap_analysis": "Gap analysis", "comparison": "Comparison", "protocol": "Protocol", "evidence_table": "Evidence table"}


def _or(value: Column, default: str) -> Column:
    return F.when(value.isNull() | (value == ""), default).otherwise(value)


def value_text(comparator: str = "comparator", value: str = "value", low: str = "min_value", high: str = "max_value", unit: str = "unit") -> Column:
    """A fact's value as text: low–high unit, or comparator and value with the unit; nothing without either."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    ranged = F.col(low).isNotNull() | F.col(high).isNotNull()
    return F.trim(F.concat(F.when(ranged, F.concat(said(low), F.lit("–"), said(high))).when(F.col(value).isNotNull(), F.concat(F.coalesce(comparator, F.lit("=")), said(value))).otherwise(""), F.lit(" "), F.coalesce(unit, F.lit(""))))


def cell(text: Column, most: int = 120) -> Column:
    """A text as a table's cell: one line, no bars, cut to `most` characters."""
    flat = F.trim(F.translate(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\n", " "), "|", "/"))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def citation(title: Column, locator: Column) -> Column:
    return F.concat_ws(" · ", _or(title, "no source"), locator)


def _nth(rows: DataFrame, most: int, *order: Column | str, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= most)


def _lines(rows: DataFrame, section: str, line: Column, *position: Column | str) -> DataFrame:
    """(query_id, section, position: array<int>, line)."""
    places = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in position]
    return rows.select("query_id", F.lit(section).alias("section"), F.array(*(p.cast("int") for p in places)).alias("position"), line.alias("line"))


def fact_groups(facts: DataFrame) -> DataFrame:
    """facts (query_id, and the columns of request.facts) with subject_nth and fact_nth: the first SUBJECTS subjects of a query, in the order of
    their best fact, and the first FACTS_OF_SUBJECT facts of each; facts without a subject go by property, then by predicate.

    Two windows, the second over at most as many rows a query as there are found facts."""
    key = F.coalesce("subject", "property", "predicate", F.lit("other"))
    order = [F.col("numeric_match").desc(), F.col("confidence").desc_nulls_last(), F.col("source_year").desc_nulls_last(), "fact_id"]
    ranked = facts.withColumn("subject_key", key).withColumn("rank_", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    inside = _nth(ranked, FACTS_OF_SUBJECT, "rank_", group=("query_id", "subject_key")).withColumnRenamed("nth", "fact_nth")
    first = inside.where("fact_nth = 1").withColumn("subject_nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank_"))).where(F.col("subject_nth") <= SUBJECTS)
    return inside.join(first.select("query_id", "subject_key", "subject_nth"), ["query_id", "subject_key"])


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """(query_id, section, position, line) of the answers that request.run gives: summary, understood, the mode's own section, facts, experiments,
    sources, contradictions, gaps, experts, conclusion."""
    asked, docs, facts, tried, answers = parts["parsed"], parts["sources"], parts["facts"], parts["experiments"], parts["answers"]
    counted = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    counts = answers.join(counted(docs, "n_docs"), "query_id", "left").join(counted(facts, "n_facts"), "query_id", "left").join(counted(tried, "n_tried"), "query_id", "left").fillna(0, ["n_docs", "n_facts", "n_tried"])
    sure = F.format_number("confidence", 2)
    summary = F.when(F.col("n_docs") > 0, F.concat(F.lit("Found "), "n_docs", F.lit(" sources, "), "n_tried", F.lit(" experiments and "), "n_facts", F.lit(" facts. Confidence: "), sure)).otherwise(F.concat(F.lit("No sources found. Confidence: "), sure))
    out = [_lines(counts, "01 Answer", summary, 0)]
    # what was understood
    named = asked.where((F.size("materials") > 0) | (F.size("processes") > 0) | (F.size("geography_terms") > 0) | (F.size("conditions") > 0))
    listed = lambda c, none: _or(F.array_join(c, ", "), none)
    bounds = F.concat(F.coalesce(F.col("year_from").cast("string"), F.lit("...")), F.lit("–"), F.coalesce(F.col("year_to").cast("string"), F.lit("...")))
    told = F.array_join(F.transform("conditions", lambda c: F.concat_ws(" ", F.coalesce(c["property"], F.lit("value")), c["comparator"], F.coalesce(c["value"].cast("string"), F.concat_ws("–", c["min_value"].cast("string"), c["max_value"].cast("string"))), c["unit"])), "; ")
    understood = F.array(
        F.concat(F.lit("- Materials: "), listed("materials", "none named")), F.concat(F.lit("- Processes: "), listed("processes", "none named")), F.concat(F.lit("- Geography: "), listed("geography_terms", "any")),
        F.when(F.col("year_from").isNotNull() | F.col("year_to").isNotNull(), F.concat(F.lit("- Years: "), bounds)), F.when(F.size("conditions") > 0, F.concat(F.lit("- Conditions: "), told)),
    )
    out.append(_lines(named.select("query_id", F.posexplode(F.array_compact(understood)).alias("at", "said")), "02 Understood", F.col("said"), "at"))
    # the section of the mode
    ranked = facts.withColumn("rank_", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("numeric_match").desc(), F.col("confidence").desc_nulls_last(), F.col("source_year").desc_nulls_last(), "fact_id")))
    moded = ranked.join(answers.select("query_id", "mode"), "query_id")
    of_mode = lambda rows, mode: rows.join(answers.where(F.col("mode") == mode).select("query_id"), "query_id", "left_semi")
    cited = citation(F.col("source_title"), F.col("evidence_locator"))
    name = F.coalesce("property", "predicate")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", cell(name), cell(value_text(), 40), cell(cited, 80), cell(F.col("confidence"), 20), cell(F.col("evidence"), 140)), F.lit(" |"))
    head = of_mode(moded.where("rank_ = 1"), "comparison")
    out.append(_lines(head, "03 Comparison", F.lit("| Property | Value | Source | Confidence | Evidence |"), 0, 0))
    out.append(_lines(of_mode(moded, "comparison").where(F.col("rank_") <= COMPARED), "03 Comparison", row, 1, "rank_"))
    out.append(_lines(of_mode(_nth(parts["contradictions"], DIFFERENCES, "subject", "property", "unit"), "comparison"), "03 Comparison", F.concat(F.lit("- "), F.concat_ws(" / ", "subject", "property"), F.lit(": "), "kind"), 2, "nth"))
    out.append(_lines(of_mode(moded, "protocol").where(F.col("rank_") <= CONTROLLED), "03 Protocol", F.concat(F.lit("- "), name, F.lit(": "), value_text(), F.lit("; source: "), cited), 1, "rank_"))
    best = [F.col("exact").desc(), F.col("reliability_score").desc_nulls_last(), F.col("year").desc_nulls_last(), "experiment_key"]
    numbered = _nth(tried, TRIED, *best)
    out.append(_lines(of_mode(numbered.where(F.col("nth") <= TRIED_PROTOCOL), "protocol"), "03 Protocol", F.concat_ws(" ", F.lit("-"), "experiment_key", F.concat("title", F.lit(":")), "result_summary"), 2, "nth"))
    located = facts.where("evidence_locator IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n_located"))
    covered = of_mode(counts, "gap_analysis").join(located, "query_id", "left").fillna(0, ["n_located"])
    out.append(_lines(covered, "03 Gap analysis", F.concat(F.lit("- Sources: "), "n_docs", F.lit("; facts: "), "n_facts", F.lit("; located: "), "n_located"), 0))
    entry = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("fact_id"), 20), cell(F.col("predicate"), 50), cell(value_text(), 50), cell(F.col("source_title"), 80), cell(F.col("evidence_locator"), 40), cell(F.coalesce("validation_status", F.lit("valid")), 30)), F.lit(" |"))
    out.append(_lines(of_mode(moded, "evidence_table").where(F.col("rank_") <= TABLED), "03 Evidence table", entry, "rank_"))
    # what was found
    grouped = fact_groups(facts)
    out.append(_lines(grouped.where("fact_nth = 1"), "04 Facts", F.concat(F.lit("**"), "subject_key", F.lit("**")), "subject_nth", 0))
    doubt = F.when(F.coalesce("validation_status", F.lit("valid")) != "valid", F.concat(F.lit(" ("), "validation_status", F.lit(")"))).otherwise("")
    said = F.concat(F.lit("- "), F.concat_ws(" ", "predicate", "property", value_text()), F.when(F.col("numeric_match"), F.lit(" ✓")).otherwise(""), F.lit(". Source: "), cited, doubt)
    out.append(_lines(grouped, "04 Facts", said, "subject_nth", "fact_nth"))
    out.append(_lines(numbered, "05 Experiments", F.concat(F.lit("- **"), F.concat_ws(" ", "experiment_key", "title"), F.lit("** ("), F.concat_ws(", ", "year", "geography"), F.lit(")")), "nth"))
    placed = _nth(docs, SOURCES, F.col("score").desc(), F.coalesce("year", F.lit(0)).desc(), "candidate_rank")
    out.append(_lines(placed, "06 Sources", F.concat(F.col("nth"), F.lit(". **"), F.concat_ws(" / ", "title", "year", "geography"), F.lit("** "), F.coalesce("confidentiality", F.lit("internal")), F.lit(", "), F.format_number("score", 3)), "nth"))
    against = _nth(parts["contradictions"], AGAINST, "subject", "property", "unit")
    out.append(_lines(against, "07 Contradictions", F.concat(F.lit("- **"), F.concat_ws(" / ", "subject", "property"), F.lit("**: "), "kind", F.lit(" of "), "n_facts"), "nth"))
    out.append(_lines(_nth(parts["gaps"], 1 << 30, "gap"), "08 Gaps", F.concat(F.lit("- "), "gap"), "nth"))
    people = _nth(parts["experts"], PEOPLE, F.col("score").desc(), "name")
    out.append(_lines(people, "09 Experts", F.concat(F.lit("- **"), "name", F.lit("**, "), F.coalesce("organization", F.lit("")), F.lit(": "), F.array_join("expertise", ", ")), "nth"))
    out.append(_lines(answers, "10 Conclusion", F.when(F.col("gaps") > 0, "A draft: gaps or divergences need an expert's review.").otherwise("Documents, experiments, conditions and experts suffice for a first review."), 0))
    lines = out[0]
    for more in out[1:]:
        lines = lines.unionByName(more)
    return lines


def markdown(lines: DataFrame) -> DataFrame:
    """(query_id, markdown): sections in order, each under its heading. A query's lines are bounded by the sections' top lists."""
    bodies = lines.groupBy("query_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: F.concat(F.lit("## "), F.regexp_replace(s["section"], r"^\d+ ", ""), F.lit("\n"), s["body"]))
    return bodies.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("markdown"))
