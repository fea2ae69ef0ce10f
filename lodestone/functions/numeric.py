"""Column functions on numeric conditions: comparators, units, intervals, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How comparators are written, and linear unit conversions.
COMPARATORS = {
    "≤": "<=", "<=": "<=", "=<": "<=", "не более": "<=", "до": "<=", "ниже": "<", "менее": "<", "<": "<",
    "≥": ">=", ">=": ">=", "=>": ">=", "не менее": ">=", "от": ">=", "выше": ">", "более": ">", ">": ">", "=": "=",
}
CONVERSIONS = [
    ("g_l", "mg_l", 1000.0), ("mg_l", "g_l", 0.001), ("t_day", "kg_day", 1000.0), ("kg_day", "t_day", 0.001),
    ("m3_day", "m3_h", 1.0 / 24.0), ("m3_h", "m3_day", 24.0), ("l_s", "m3_h", 3.6), ("m3_h", "l_s", 1.0 / 3.6),
]


def comparator(raw: Column) -> Column:
    """<=, <, >=, >, = or between for a written comparator; = for none; an unknown one stays as it is."""
    key = F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " ")
    names = F.create_map(*(F.lit(x) for pair in COMPARATORS.items() for x in pair))
    return F.when(raw.isNull() | (key == ""), "=").otherwise(F.coalesce(F.try_element_at(names, key), key))


def conversion_factor(have: Column, want: Column) -> Column:
    """What a value in unit `have` is multiplied by for unit `want`: 1 for equal or missing units, null for unknown pairs."""
    factors = F.create_map(*(F.lit(x) for a, b, k in CONVERSIONS for x in (f"{a}>{b}", k)))
    return F.when(have.isNull() | want.isNull() | (have == want), F.lit(1.0)).otherwise(F.try_element_at(factors, F.concat(have, F.lit(">"), want)))


def interval(op: Column, value: Column, low: Column, high: Column) -> Column:
    """struct(lo, hi), null ends being open. < counts as <=, > as >=, and an unknown comparator as =."""
    lo = F.when(value.isNull() | (op == "between"), low).when(op.isin("<=", "<"), F.lit(None)).otherwise(value)
    hi = F.when(value.isNull() | (op == "between"), high).when(op.isin(">=", ">"), F.lit(None)).otherwise(value)
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two intervals meet; a missing end is open."""
    return F.coalesce(F.greatest(a["lo"], b["lo"]) <= F.least(a["hi"], b["hi"]), F.lit(True))


def is_open(i: Column) -> Column:
    return i["lo"].isNull() & i["hi"].isNull()


def scaled(i: Column, factor: Column) -> Column:
    return F.struct((i["lo"] * factor).alias("lo"), (i["hi"] * factor).alias("hi"))


def numeric_warnings(unit: Column, value: Column, low: Column, high: Column) -> Column:
    """Names of the rules that a condition breaks; empty for a valid one. The names and bounds are fixed values."""
    values = F.array_compact(F.array(value, low, high))
    some = lambda test: F.exists(values, test)
    rule = lambda when, name: F.when(when, F.lit(name))
    return F.array_compact(F.array(
        rule(low > high, "range_min_gt_max"),
        rule(~unit.eqNullSafe("celsius") & some(lambda v: v < 0), "negative_value_for_non_temperature_unit"),
        rule(unit.eqNullSafe("percent") & some(lambda v: (v < 0) | (v > 100)), "percent_outside_0_100"),
        rule(unit.eqNullSafe("celsius") & some(lambda v: (v < -100) | (v > 2000)), "temperature_outside_expected_range"),
        rule(unit.eqNullSafe("m_s") & some(lambda v: (v < 0) | (v > 50)), "velocity_outside_expected_range"),
        rule(unit.eqNullSafe("mg_l") & some(lambda v: (v < 0) | (v > 1_000_000)), "concentration_outside_expected_range"),
        rule(unit.isin("rub_m3", "usd_m3") & some(lambda v: v <= 0), "cost_not_positive"),
    ))


def canonical_units(df: DataFrame, units: DataFrame, column: str = "unit", name: str = "unit_canonical") -> DataFrame:
    """Adds the dictionary's canonical unit (units: canonical, alias), or the normalized spelling where it has none."""
    from .text import canonical_unit_key

    known = units.select(canonical_unit_key(F.col("alias")).alias("_key"), F.col("canonical").alias("_canonical")).groupBy("_key").agg(F.min("_canonical").alias("_canonical"))
    keyed = df.withColumn("_key", canonical_unit_key(F.col(column)))
    return keyed.join(known, "_key", "left").withColumn(name, F.coalesce("_canonical", "_key")).drop("_key", "_canonical")
