"""Column functions on text: normalization, tokens, language and path hints, pipe tables, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that search ignores, and words too common in this corpus to rank by.
STOP_WORDS = (
    "какие", "какой", "какая", "для", "при", "если", "исходная", "требуемый", "покажите", "все", "между", "последние",
    "где", "как", "что", "и", "в", "на", "по", "за", "the", "and", "or", "of", "in", "for", "with", "каковы",
    "считается", "описаны", "существуют",
)
NOISE_WORDS = (
    "есть", "методы", "подходят", "вода", "воды", "содержит", "последних", "последние", "пробелы", "комбинации",
    "concentration", "total", "dissolved", "solids",
)

#: Bounds of the size buckets, in MiB.
SIZE_BOUNDS = ((1, "<1MB"), (10, "1-10MB"), (50, "10-50MB"), (100, "50-100MB"))


def normalize_text(text: Column) -> Column:
    """ё as е, and every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, "ёЁ", "еЕ"), r"(?U)\s+", " "))


def normalize_key(text: Column) -> Column:
    return F.lower(normalize_text(text))


def search_tokens(text: Column, limit: int = 32) -> Column:
    """Words of three letters or digits and more, in lower case, without stop words; the first `limit`."""
    words = F.regexp_extract_all(F.lower(F.translate(text, "ёЁ", "еЕ")), F.lit("[a-zа-я0-9]{3,}"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), 1, limit)


def ranked_tokens(aliases: Column, raw: Column, limit: int = 18) -> Column:
    """Alias tokens before raw ones, without numbers and noise, each once; the raw ones if nothing is left."""
    good = F.array_distinct(F.filter(F.concat(aliases, raw), lambda w: ~w.rlike(r"^\d+$") & ~w.isin(*NOISE_WORDS)))
    return F.when(F.size(good) > 0, F.slice(good, 1, limit)).otherwise(F.slice(raw, 1, limit))


def detect_language(text: Column) -> Column:
    """ru if Cyrillic letters outnumber Latin ones, else en if there are any, else unknown."""
    cyrillic, latin = F.regexp_count(text, F.lit("[А-Яа-яЁё]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(cyrillic > latin, "ru").when(latin > 0, "en").otherwise("unknown")


def path_language(path: Column) -> Column:
    """The scripts of a path: mixed, ru, en or unknown."""
    cyrillic, latin = path.rlike("[А-Яа-яЁё]"), path.rlike("[A-Za-z]")
    return F.when(cyrillic & latin, "mixed").when(cyrillic, "ru").when(latin, "en").otherwise("unknown")


def size_bucket(size: Column) -> Column:
    out = F.when(size < SIZE_BOUNDS[0][0] << 20, SIZE_BOUNDS[0][1])
    for bound, name in SIZE_BOUNDS[1:]:
        out = out.when(size < bound << 20, name)
    return out.otherwise(">=100MB")


def path_years(path: Column) -> Column:
    """The distinct years 1900 to 2099 in a path."""
    return F.array_distinct(F.regexp_extract_all(path, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)))


def canonical_unit_key(unit: Column) -> Column:
    """A unit as the dictionary spells it: lower case, ³ as 3, no blanks."""
    return F.regexp_replace(F.translate(F.lower(F.trim(unit)), "³", "3"), " ", "")


def pipe_rows(text: Column) -> Column:
    """The cells of a text's lines that hold ' | '; null unless there are two such lines of two cells."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.contains(" | ") & (F.trim(s) != ""))
    rows = F.transform(lines, lambda s: F.transform(F.split(F.trim(s), r"\|"), lambda c: F.trim(c)))
    return F.when((F.size(rows) >= 2) & (F.array_max(F.transform(rows, lambda r: F.size(r))) >= 2), rows)


def pipe_table(text: Column, max_rows: int | None = 50) -> Column:
    """struct(headers, rows as maps) of a text's pipe table, or null; its first max_rows rows, or all of them with None. A first line with
    an empty cell, or shorter than the widest, is data, and the columns are called column_1 and so on."""
    rows = pipe_rows(text)
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    first = F.element_at(rows, 1)
    named = (F.size(first) == width) & ~F.exists(first, lambda h: h == "")
    headers = F.when(named, first).otherwise(F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("column_"), i)))
    data = F.when(named, F.slice(rows, 2, F.size(rows))).otherwise(rows)
    if max_rows is not None:
        data = F.slice(data, 1, max_rows)
    padded = F.transform(data, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    maps = F.transform(padded, lambda r: F.transform(F.arrays_zip(headers.alias("h"), r.alias("c")), lambda z: F.struct(z["h"].alias("key"), z["c"].alias("value"))))
    return F.when(rows.isNotNull() & (F.size(data) > 0), F.struct(headers.alias("headers"), maps.alias("rows"), F.size(data).alias("n_rows")))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![A-Za-z0-9])\+?\d[\d ()-]{8,}\d(?![A-Za-z0-9])"
SECRET = r"(?i)(password|passwd|secret|token|api_?key)(\s*[:=]\s*)[\"']?[^\s\"',;]+"


def redact(text: Column, contacts: bool = True) -> Column:
    """Masks secrets, and with contacts also e-mail addresses and phone numbers of ten digits and more; dates and times
    with hyphens are no phone numbers."""
    out = F.regexp_replace(text, SECRET, "$1$2[SECRET]")
    if not contacts:
        return out
    out = F.regexp_replace(out, EMAIL, "[EMAIL]")
    phones = F.filter(
        F.regexp_extract_all(out, F.lit(PHONE), F.lit(0)),
        lambda p: (F.length(F.regexp_replace(p, r"\D", "")) >= 10) & ~p.rlike(r"^\d{4}-\d{2}-\d{2}"),
    )
    return F.aggregate(F.array_distinct(phones), out, lambda done, p: F.replace(done, p, F.lit("[PHONE]")))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of the values between the first two ---, the body); an empty map and the whole text without such a block."""
    parts = F.split(text, "---", 3)
    has = text.startswith("---") & (F.size(parts) == 3)
    lines = F.filter(F.split(F.element_at(parts, 2), r"\r?\n"), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(s, "^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("value")))
    last = F.map_from_entries(F.filter(pairs, lambda p: F.lit(True)))
    return F.when(has, last).otherwise(F.create_map().cast("map<string,string>")), F.when(has, F.trim(F.element_at(parts, 3))).otherwise(text)
