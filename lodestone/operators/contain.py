"""Substring joins: which texts hold which terms, without comparing every text with every term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import sent, shared_table

GRAM = 3
#: Fixed value: so many terms at most are looked for in each text as it is read, which costs less than to cut it into runs.
FEW = 64


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of n characters in a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), n, F.lit("}))")), F.lit(1)))


def _few_held(text: Column, terms: DataFrame, term: str, few: int) -> Column | None:
    """The distinct terms that a text holds, in order, if there are no more than few terms; at most few + 1 come to the driver."""
    said = [r[0] for r in terms.select(term).where(F.col(term) != "").distinct().limit(few + 1).collect()]
    if len(said) > few:
        return None
    if not said:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.lit(t) for t in sorted(said))), lambda t: F.contains(text, t))


def with_held(rows: DataFrame, terms: DataFrame, key: str, text: str = "text", term: str = "term", few: int = FEW) -> DataFrame:
    """rows with held, the distinct terms that their text holds, in order. Few terms are looked for without a shuffle."""
    none = F.array().cast("array<string>")
    held = _few_held(F.col(text), terms, term, few)
    if held is not None:
        return rows.withColumn("held", F.coalesce(held, none))
    found = contained(rows, terms, key, text, term, few).groupBy(key).agg(F.array_sort(F.collect_set(term)).alias("held"))
    return rows.join(found, key, "left").withColumn("held", F.coalesce("held", none))


def contained(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", term: str = "term", few: int = FEW) -> DataFrame:
    """(key, term) of the texts that hold a term, each pair once.

    Few terms are looked for in every text as it is read. With more, a text and a term meet by the term's rarest run of three characters (of all its characters, if it has fewer), rarest by the number
    of texts that hold it; then the whole term is looked for. Only runs that some term has leave a text, and only the
    lengths that terms have are cut (one row of at most three numbers goes to every task); they are written once, since texts are dear to cut. Null and empty terms, and null texts, match nothing."""
    inside = _few_held(F.col(text), terms, term, few)
    if inside is not None:
        return texts.where(F.col(text).isNotNull()).select(key, F.explode(inside).alias(term)).distinct()
    asked = terms.select(F.col(term).alias("term")).where("term <> ''").distinct().withColumn("n", F.least(F.length("term"), F.lit(GRAM)))
    wanted = asked.select("term", "n", F.explode(_grams(F.col("term"), F.col("n"))).alias("gram"))
    lengths = asked.agg(F.collect_set("n").alias("ns"))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    cut = rows.crossJoin(F.broadcast(lengths)).withColumn("n", F.explode("ns"))
    held = shared_table(cut.select("key", F.explode(_grams(F.col("text"), F.col("n"))).alias("gram")).join(sent(wanted.select("gram").distinct()), "gram", "left_semi"))
    frequency = held.groupBy("gram").agg(F.count("*").alias("df"))
    # a run that no text holds rules its term out: it is the rarest, and meets nothing
    ranked = wanted.join(frequency, "gram", "left").withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.coalesce("df", F.lit(0)), "gram")))
    rarest = ranked.where("nth = 1").select("gram", "term")
    pairs = held.join(rarest, "gram").select("key", "term")
    return pairs.join(rows, "key").where(F.contains("text", F.col("term"))).select(F.col("key").alias(key), F.col("term").alias(term)).distinct()
