"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into words of at most `WORD` code points (an ideograph is a word of its own; longer runs without white space,
as of Thai or encoded data, have overlapping words of `WORD` code points, one from each code point). A polynomial hash rolls over
every `gram` consecutive words; in every window of `window` such hashes the least is selected, the rightmost of equal ones,
and it is kept with its position. Any passage of gram + window - 1 words that two texts share therefore yields a common
selected hash, and so does any of WORD + gram + window - 2 code points inside long runs. A text of fewer words than a gram has the one gram of all its words; one of fewer grams than a window has
one window.

Hash and position travel as one 63-bit number, hash first and position counted down, so that a plain minimum settles ties.

Defined results: a null text is empty; an empty or wordless text has an empty fingerprint, like 1 to another empty one and
0 to any other; equal texts have equal fingerprints; rows of equal doc_id follow each other in the order of their texts; a
null doc_id comes first; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

GRAM, WINDOW, WORD = 5, 4, 16
#: Modulus and base of the rolling hash; products stay below 2^62.
PRIME, BASE = (1 << 31) - 1, 1_000_003
_LOW = 1 << 32
#: Rows of consecutive documents that are sorted together, and at most so many such blocks.
BLOCK_ROWS, MOST_BLOCKS = 4096, 4096


_LETTER = r"[^\s\p{IsIdeographic}]"
#: An ideograph, a whole run of at most WORD letters, or WORD letters of a longer run from any of its code points; looked
#: for at every code point, which is then passed.
_SLIDING = rf"(?s)(?=(\p{{IsIdeographic}}|(?<!{_LETTER}){_LETTER}{{1,{WORD}}}(?!{_LETTER})|{_LETTER}{{{WORD}}}))."


def words(text: Column, sliding: bool = False) -> Column:
    """The words of a text; sliding: a run of more than WORD letters has a word at every code point with WORD letters left,
    so that its words do not depend on where it begins, otherwise it is cut into pieces."""
    if sliding:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SLIDING), F.lit(1))
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\p{{IsIdeographic}}|[^\s\p{{IsIdeographic}}]{{1,{WORD}}}"), F.lit(0))


def _shifted(c: str, n: int) -> Column:
    return F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))


def with_fingerprints(df: DataFrame, texts: dict[str, str], gram: int = GRAM, window: int = WINDOW, sliding: bool = False) -> DataFrame:
    """Adds for each entry (name of a text column, name of the new column) hash * 2^32 + (2^32 - 1 - position) of the
    selected grams as array<bigint>, in order of position.

    Every step is a column of its own, so that it is computed once for a row. Steps on shifted arrays leave nulls at the
    end, where there is no full gram or window any more; these are cut off last."""
    for text, name in texts.items():
        df = df.withColumn("_words", words(F.col(text), sliding))
        df = df.withColumn("_1", F.transform("_words", lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME))))
        have, used = 1, ["_words", "_1"]
        while have < gram:
            # hashes of `have` words become hashes of twice as many, or of one word more
            step = have if have * 2 <= gram else 1
            shift, new = F.lit(pow(BASE, step, PRIME)), f"_{have + step}"
            df = df.withColumn(new, F.zip_with(F.col(f"_{have}"), _shifted(f"_{step}", have), lambda a, b: (a * shift + b) % F.lit(PRIME)))
            used.append(new)
            have += step
        whole = F.aggregate("_1", F.lit(0).cast("long"), lambda done, h: (done * F.lit(BASE) + h) % F.lit(PRIME))
        grams = F.slice(F.col(f"_{gram}"), 1, F.greatest(F.size("_1") - (gram - 1), F.lit(0)))
        df = df.withColumn("_grams", F.when(F.size("_1") == 0, F.array().cast("array<long>")).when(F.size("_1") < gram, F.array(whole)).otherwise(grams)).drop(*used)
        df = df.withColumn("_least1", F.transform("_grams", lambda h, i: h * F.lit(_LOW) + (F.lit(_LOW - 1) - i)))
        have, used = 1, ["_grams", "_least1"]
        while have < window:
            step = min(have, window - have)
            new = f"_least{have + step}"
            df = df.withColumn(new, F.zip_with(F.col(f"_least{have}"), _shifted(f"_least{have}", step), lambda a, b: F.least(a, b)))
            used.append(new)
            have += step
        chosen = F.array_distinct(F.slice(F.col(f"_least{window}"), 1, F.greatest(F.size("_grams") - (window - 1), F.lit(0))))
        df = df.withColumn(name, F.when(F.size("_grams") == 0, F.array().cast("array<long>")).when(F.size("_grams") < window, F.array(F.array_min("_least1"))).otherwise(chosen)).drop(*used)
    return df


def hashes_of(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint, without their positions."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32)))


def as_text(fingerprint: Column) -> Column:
    """hash:position pairs, blank-separated."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat(F.shiftright(v, 32).cast("string"), F.lit(":"), (F.lit(_LOW - 1) - v.bitwiseAND(F.lit(_LOW - 1))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def with_next(docs: DataFrame, carried: str, key: str = "doc_id") -> DataFrame:
    """Adds the column `next`: `carried` of the row that follows by key and text, the first row's after the last.

    Rows are dealt to blocks of neighbouring keys (bounds are quantiles of the keys, so blocks are of like size), each block
    is ordered by itself, and only the first rows of the blocks travel between them. No task sees all rows."""
    rows = docs.count()
    blocks = max(1, min(MOST_BLOCKS, rows // BLOCK_ROWS))
    bounds = docs.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] if blocks > 1 else []
    cut = F.array(*(F.lit(b).cast("long") for b in sorted(set(bounds or [])))).cast("array<long>")
    block = F.coalesce(F.size(F.filter(cut, lambda b: b <= F.col(key))), F.lit(0))
    docs = docs.withColumn("block", block)
    begins = {r.block: r.least for r in docs.groupBy("block").agg(F.min(key).alias("least")).collect()}
    numbers = sorted(begins)
    follows = dict(zip(numbers, numbers[-1:] + numbers[:-1]))
    order = F.struct(F.col(key).isNotNull(), F.col(key), F.col("text").isNotNull(), F.col("text"), F.col(carried).alias("_carried"))
    # each block's first row, once more, behind the last row of the block before it
    candidates = docs.where(F.col(key).isin([k for k in begins.values() if k is not None]) | F.col(key).isNull())
    heads = candidates.groupBy("block").agg(F.min(order)["_carried"].alias(carried))
    before = F.create_map(*(F.lit(x) for pair in follows.items() for x in pair)) if follows else F.create_map(F.lit(0), F.lit(0))
    tails = heads.select(before[F.col("block")].alias("block"), carried, F.lit(1).alias("tail"))
    rows_ = docs.withColumn("tail", F.lit(0)).unionByName(tails, allowMissingColumns=True)
    own = Window.partitionBy("block").orderBy("tail", F.col(key).asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows_.withColumn("next", F.lead(carried).over(own)).where("tail = 0").drop("block", "tail")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "text").withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    docs = docs.withColumn("edited", F.concat(kept, F.substring(F.col("next"), F.lit(1), quarter)))
    docs = with_fingerprints(docs, {"text": "own", "edited": "other", "next": "after"}, sliding=True)
    docs = docs.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited", "next")
    docs = docs.withColumns({"a": hashes_of(F.col("own")), "b": hashes_of(F.col("other")), "c": hashes_of(F.col("after"))})
    return docs.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
