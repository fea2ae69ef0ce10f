"""Secret scans with corpus-wide ownership frequency.

Candidates are found in each whole text: assignments to secret-like names, cloud access keys and long hexadecimal runs
(the base kinds), and bare runs of mixed, high-entropy characters (kind `bare`). Each candidate's value is hashed, and the
hashes are counted over the whole corpus by distinct repository, distinct owner and distinct text; a file copied verbatim to
twenty owners has twenty owners and one text. A value is a widely copied example if at least `shared_owners` owners hold it,
none of them has more than half of the repositories that do, and at least `least_texts` texts hold it; held mostly in one
owner's repositories it is that owner's, whoever copied it. Any value that is no such example and looks live (long and varied
enough) is an owner-specific credential. Bare candidates become spans only if they are owner-specific.

The counts run over distinct (value, text), (value, owner, repository) and (value, owner), which each task combines before
the shuffle, so a value or an owner with a third of all rows stays spread; values come back to their documents by a join that
adaptive execution may split.

Defined results: a null text is empty and has no spans; a null repository or owner counts as one unnamed repository or
owner; repeated rows, and rows without a doc_id, each get their row and count once in the ownership; very long texts are
scanned whole; extra columns are ignored, whatever their names; an empty table gives no rows. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fields, let_go, of, private, table, texts_of, write_shared

KINDS = ("assign", "access", "hex", "bare")
SHARED_OWNERS, LIVE_ENTROPY, LIVE_LENGTH = 3, 2.5, 12


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*(_any_case(w) for w in ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"])
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_BARE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")

SPAN = "struct<start:long,rank:int,stop:long,hash:string,live:boolean>"
_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("hash", pa.string()), ("live", pa.bool_())])


def entropy(value: str) -> float:
    """Bits a character, from the value's own characters."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's rank, end, value), in order of start and kind."""
    base = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    base += [(m.start(), rank, m.end(), m[0]) for rank, pattern in ((1, _ACCESS), (2, _HEX)) for m in pattern.finditer(text)]
    # base spans and bare runs are met in one pass by start; only the base spans that reach furthest matter
    held, at, reach = sorted((s, e) for s, _, e, _ in base), 0, 0
    for m in _BARE.finditer(text):
        while at < len(held) and held[at][0] < m.end():
            reach = max(reach, held[at][1])
            at += 1
        if reach <= m.start() and _varied(m[0]):
            base.append((m.start(), 3, m.end(), m[0]))
    return sorted(base)


def _varied(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and entropy(value) >= 3.5


def looks_live(value: str) -> bool:
    return len(value) >= LIVE_LENGTH and entropy(value) >= LIVE_ENTROPY


#: What scan() tells of a text.
SCAN = f"struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,found:array<{SPAN}>>"
_SCAN = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(_SPAN))])


def scan(docs: DataFrame, keep: list[str], name: str = "scan") -> DataFrame:
    """Every row of docs (with a column text) with its candidates: the columns in keep, and SCAN under the given name."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = []
            for text in texts_of(batch.column("text")):
                spans = candidates(text)
                count = [sum(s[1] == rank for s in spans) for rank in range(3)]
                digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans if k < 3).encode()).hexdigest()
                found = [{"start": s, "rank": k, "stop": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "live": looks_live(v)} for s, k, e, v in spans]
                out.append({"n_assign": count[0], "n_access": count[1], "n_hex": count[2], "base_sha256": digest, "found": found})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, _SCAN)], names=[*keep, name])

    return docs.select(*map(of, dict.fromkeys([*keep, "text"]))).mapInArrow(run, fields(docs, keep, (name, SCAN)))


def ownership(held: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners, most, n_texts) of the values in held (hash, digest, owner, repo): the repositories, owners and
    texts that hold a value, and the most repositories of one owner that do."""
    texts = held.select("hash", "digest").distinct().groupBy("hash").agg(F.count("*").alias("n_texts"))
    owners = held.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"), F.max("n").alias("most")).join(texts, "hash")


def find_secrets(docs: DataFrame, repo: Column, owner: Column, keep: list[str], shared_owners: int = SHARED_OWNERS, least_texts: int = 1, name: str = "secrets") -> DataFrame:
    """The columns of docs in keep, and a struct of the given name: n_assign, n_access, n_hex, base_sha256 and spans, an array of
    (start, rank, stop, live, shared, n_owners, n_repos, n_texts) in order.

    The scan is written to the shared folder once; what is joined after that are the candidates, not the texts."""
    keep = [c for c in docs.columns if c in keep]
    row, repo_, owner_, digest, told_ = private([*keep, "text"], "row", "repo", "owner", "digest", "scan")
    own = [repo.cast("string").alias(repo_), owner.cast("string").alias(owner_), F.sha2(F.coalesce("text", F.lit("")), 256).alias(digest)]
    told = docs.select(*map(of, dict.fromkeys([*keep, "text"])), *own)
    found = write_shared(scan(told, [*keep, repo_, owner_, digest], told_).withColumn(row, F.monotonically_increasing_id()), "secrets")
    held = found.select(F.col(row).alias("row"), F.col(repo_).alias("repo"), F.col(owner_).alias("owner"), F.col(digest).alias("digest"), F.explode(F.col(told_)["found"]).alias("s"))
    verdict = held.select("row", "s", F.col("s.hash").alias("hash")).join(ownership(held.select(F.col("s.hash").alias("hash"), "digest", "owner", "repo")), "hash")
    shared = (F.col("n_owners") >= shared_owners) & (2 * F.col("most") <= F.col("n_repos")) & (F.col("n_texts") >= least_texts)
    span = F.struct("s.start", "s.rank", "s.stop", (F.col("s.live") & ~shared).alias("live"), shared.alias("shared"), "n_owners", "n_repos", "n_texts")
    spans = verdict.where((F.col("s.rank") < 3) | (F.col("s.live") & ~shared)).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    joined = found.join(spans.select(F.col("row").alias(row), F.col("spans").alias(digest + "_spans")), row, "left")
    whole = F.struct(*(F.col(told_)[c].alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256")), F.coalesce(F.col(digest + "_spans"), empty).alias("spans"))
    return joined.select(*map(of, keep), whole.alias(name))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["rank"] + 1), F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def _where(docs: DataFrame) -> tuple[Column, Column]:
    """The documents' owner is their source; a repository is a source's documents in one language. The tables name no repository,
    so where a source has one language, its repository adds nothing to it."""
    return F.concat_ws("/", "source", "lang"), F.col("source")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = find_secrets(docs, *_where(docs), ["doc_id"])
    spans = F.col("secrets.spans")
    count = lambda p: F.size(F.filter(spans, p)).cast("long")
    widest = lambda c: F.coalesce(F.array_max(F.transform(spans, lambda s: s[c])), F.lit(0)).cast("long")
    return found.select(
        "doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", "secrets.base_sha256", spans_text(spans).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: s["shared"]).alias("n_shared"), widest("n_owners").alias("most_owners"), widest("n_repos").alias("most_repos"),
        widest("n_texts").alias("most_texts"),
    )


def mask_text(text: str, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str:
    """text with the given spans replaced; spans that overlap or touch become one mask."""
    out, at = [], 0
    for i, (start, stop) in enumerate(sorted(spans)):
        if i == 0 or start > at:
            out += [text[at:start], mask]
        at = max(at, stop)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _masked(text: pd.Series, bounds: pd.Series) -> pd.Series:
    """bounds: start and stop of each span in turn; rows without a text need no mask."""
    return pd.Series([None if t is None else mask_text(t, list(zip(b[::2].tolist(), b[1::2].tolist()))) for t, b in zip(text, bounds)], dtype=object)


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: masks all base candidates that are no shared example, of any length and entropy, and bare live ones, and
    keeps every document; n_chars follows. Here an example must also stand in SHARED_OWNERS different texts at
    least, since one file's copies may all leak one credential. Ownership is that of the stage's own input. All other columns keep their values, whatever their names; for odd input see the
    module."""
    columns = docs.columns
    name, bounds_, masked = private(columns, "secrets", "bounds", "masked")
    found = find_secrets(docs, *_where(docs), columns, least_texts=SHARED_OWNERS, name=name)
    hidden = F.filter(of(name)["spans"], lambda s: ~s["shared"])
    bounds = F.flatten(F.transform(hidden, lambda s: F.array(s["start"], s["stop"])))
    found = found.withColumn(bounds_, bounds)
    some = F.size(of(bounds_)) > 0
    # only the texts that have something to mask go through Python
    out = found.withColumn(masked, _masked(F.when(some, F.col("text")), F.col(bounds_)))
    new = {"text": F.when(some, F.col(masked)).otherwise(F.col("text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(some, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(new[c].alias(c) if c in new else of(c) for c in columns))
