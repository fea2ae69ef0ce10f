from pyspark.sql import functions as F

from lodestone.functions import access, numeric, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def test_normalize(spark):
    assert one(spark, "  Ёлка \tи \n лёд ", text.normalize_text) == "Елка и лед"
    assert one(spark, "НИКЕЛЬ  Ё", text.normalize_key) == "никель е"
    assert one(spark, None, text.normalize_text) is None


def test_tokens(spark):
    assert one(spark, "Какие методы для никеля и The Ni 123 of copper", text.search_tokens) == ["методы", "никеля", "123", "copper"]
    ranked = spark.createDataFrame([(["никель", "total"], ["123", "никель", "медь"])], "a array<string>, r array<string>").select(text.ranked_tokens(F.col("a"), F.col("r")).alias("x")).first().x
    assert ranked == ["никель", "медь"]


def test_language_and_paths(spark):
    assert [one(spark, s, text.detect_language) for s in ("привет you", "hello", "123", "")] == ["ru", "en", "unknown", "unknown"]
    assert [one(spark, s, text.path_language) for s in ("/a/б", "/б", "/a", "/1")] == ["mixed", "ru", "en", "unknown"]
    assert one(spark, "/2019/x-2019-2020/12021", text.path_years) == ["2019", "2020"]
    assert [one(spark, n << 20, text.size_bucket, "long") for n in (0, 1, 10, 50, 100)] == ["<1MB", "1-10MB", "10-50MB", "50-100MB", ">=100MB"]


def test_redaction(spark):
    said = "call +7 (912) 345-67-89 or a@b.io, token: abc123xyz, range 200-300, at 2024-01-15 10:30"
    out = one(spark, said, text.redact)
    assert "345-67" not in out and "a@b.io" not in out and "abc123xyz" not in out
    assert "200-300" in out and "2024-01-15 10:30" in out
    assert "a@b.io" in one(spark, said, lambda c: text.redact(c, contacts=False))


def test_front_matter(spark):
    row = spark.createDataFrame([("---\ntitle: \"A: b\"\nyear: 2020\n---\nbody",), ("no block",)], "v string").select(*[c.alias(n) for c, n in zip(text.front_matter(F.col("v")), "mb")]).collect()
    assert row[0].m == {"title": "A: b", "year": "2020"} and row[0].b.strip() == "body"
    assert row[1].m == {} and row[1].b == "no block"


def test_pipe_table(spark):
    got = one(spark, "a | b\n1 | 2\n3\nx | y | ", text.pipe_table)
    assert got.headers == ["column_1", "column_2", "column_3"] and got.n_rows == 3
    assert one(spark, "a | b", text.pipe_table) is None


def test_units_and_intervals(spark):
    row = spark.createDataFrame([("≤ 1 g/l",)], "v string").select(
        numeric.comparator(F.lit("не  более")).alias("c"), numeric.comparator(F.lit(None).cast("string")).alias("none"),
        numeric.conversion_factor(F.lit("l_s"), F.lit("m3_h")).alias("k"), numeric.conversion_factor(F.lit("l_s"), F.lit("mg_l")).alias("bad"),
    ).first()
    assert (row.c, row.none, row.k, row.bad) == ("<=", "=", 3.6, None)


def test_interval_overlap(spark):
    rows = spark.createDataFrame([("<=", 1.0, None, None, ">=", 1.0, None, None), ("between", None, 1.0, 2.0, ">", 3.0, None, None), ("<", 1.0, None, None, "<=", -5.0, None, None)], "a string, av double, al double, ah double, b string, bv double, bl double, bh double")
    got = rows.select(numeric.overlaps(numeric.interval(F.col("a"), F.col("av"), F.col("al"), F.col("ah")), numeric.interval(F.col("b"), F.col("bv"), F.col("bl"), F.col("bh"))).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True]


def test_warnings(spark):
    rows = spark.createDataFrame([("percent", 120.0, None, None), ("celsius", -50.0, None, None), ("mg_l", None, 5.0, 1.0), (None, -1.0, None, None)], "u string, v double, l double, h double")
    got = [r.x for r in rows.select(numeric.numeric_warnings(F.col("u"), F.col("v"), F.col("l"), F.col("h")).alias("x")).collect()]
    assert got == [["percent_outside_0_100"], [], ["range_min_gt_max"], ["negative_value_for_non_temperature_unit"]]


def test_access_is_stricter_for_export(spark):
    row = spark.range(1).select(access.may_export(F.lit("secret"), F.lit("manager")).alias("out"), access.may_export(F.lit("secret"), F.lit("admin")).alias("admin"), access.may_see(F.lit("secret"), "manager").alias("view"), access.may_export(F.lit("public"), F.lit("nobody")).alias("nobody")).first()
    assert (row.out, row.admin, row.view, row.nobody) == (False, True, True, False)


def test_mask_nested(spark):
    df = spark.createDataFrame([(("x", "mail a@b.io"), "s3cret")], "s struct<contact:string,note:string>, api_key string")
    row = access.mask_fields(df, "researcher").first()
    assert row.s.contact == "[MASKED]" and "[EMAIL]" in row.s.note and row.api_key == "[SECRET]"
    assert access.mask_fields(df, "admin").first().s.contact == "x"
