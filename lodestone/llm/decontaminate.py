"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of `window` words (an item of fewer words is one window). A window's shingles of
`shingle` words are ordered by rarity over the whole corpus; a window that must be contained in a share `containment` of
its n shingles can only be met by a document that has one of its n - ceil(containment * n) + 1 rarest ones (the prefix).
Documents are joined on those shingles alone. A match at document position i of a shingle at window position p fixes
where the window would start; length and position bounds reject what cannot fit, and the rest is verified on the words.

The benchmark is the small side: it is taken in blocks of about `block_words` words (an item is never split), so what is
broadcast is bounded, and each block passes over all documents to count shingles and to match. With more than one block,
the documents are numbered and written once, blocks write the findings of the documents they hit, and these are merged.

Defined results: null and wordless texts have no words, no hits and are not contaminated; null item texts and items
without words have no windows; items with the same text all count; a repeated item_id counts once; the words of an item
whose id is null are hit like others, but it has no id to be counted or listed by. Repeated documents, and documents without
a doc_id, each get their row. Extra columns are ignored, whatever their names; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fields, let_go, of, private, table, texts_of, write_shared

WINDOW, SHINGLE, CONTAINMENT, BLOCK_WORDS = 13, 3, 1.0, 500_000
#: A document is contaminated if at least one word of so many is hit.
ONE_IN = 20

#: ASCII letters and digits and everything beyond ASCII belong to words; all else parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _shingles(words: list[bytes], k: int) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(k))))


class Block:
    """The windows of some benchmark items, by content."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, shingle: int, containment: float):
        self.containment, self.windows, self.owners, self.of_item = containment, [], [], defaultdict(int)
        seen: dict[tuple[bytes, ...], int] = {}
        for item, text in items:
            words = words_of(text)
            for at in range(max(1, len(words) - window + 1)) if words else ():
                content = tuple(words[at : at + window])
                if content not in seen:
                    seen[content] = len(self.windows)
                    self.windows.append(list(content))
                    self.owners.append(set())
                if item is not None:
                    self.owners[seen[content]].add(item)
        for owners in self.owners:
            for item in owners:
                self.of_item[item] += 1
        self.parts = [_shingles(w, min(shingle, len(w))) for w in self.windows]
        self.sizes = sorted({min(shingle, len(w)) for w in self.windows}, reverse=True)
        self.frequency: dict[tuple[bytes, ...], int] = {p: 0 for parts in self.parts for p in parts}
        self.prefix: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}

    def order(self) -> None:
        """Chooses each window's prefix, rarest shingles first."""
        for w, parts in enumerate(self.parts):
            first: dict[tuple[bytes, ...], int] = {}
            for p, part in enumerate(parts):
                first.setdefault(part, p)
            ranked = sorted(first, key=lambda part: (self.frequency[part], part))
            for part in ranked[: len(ranked) - math.ceil(self.containment * len(ranked)) + 1]:
                for p, other in enumerate(parts):
                    if other == part:
                        self.prefix.setdefault(part, []).append((w, p))

    def matches(self, words: list[bytes]) -> dict[int, set[int]]:
        """Where each window occurs, by window."""
        found: dict[int, set[int]] = defaultdict(set)
        n, tried = len(words), set()
        for k in self.sizes:
            for i, part in enumerate(zip(*(words[j:] for j in range(k)))):
                if part in self.prefix:
                    for w, p in self.prefix[part]:
                        at, window = i - p, self.windows[w]
                        if at < 0 or at + len(window) > n or (w, at) in tried:
                            continue
                        tried.add((w, at))
                        here = words[at : at + len(window)]
                        if here == window:
                            found[w].add(at)
                        elif self.containment < 1:
                            need = set(self.parts[w])
                            if len(need & set(_shingles(here, min(len(here), len(self.parts[w][0]))))) >= self.containment * len(need):
                                found[w].add(at)
        return found


def _blocks(benchmark: DataFrame, window: int, shingle: int, containment: float, block_words: int) -> Iterator[Block]:
    items: list[tuple[str | None, str]] = []
    words = 0
    for r in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        items.append((r.item_id, r.text))
        words += 1 + len(words_of(r.text))
        if words >= block_words:
            yield Block(items, window, shingle, containment)
            items, words = [], 0
    if items:
        yield Block(items, window, shingle, containment)


def _count_shingles(docs: DataFrame, block: Block) -> None:
    """Occurrences of the block's shingles over the whole corpus: counted in each task, then summed by key."""
    names = sorted(block.frequency)
    shared = docs.sparkSession.sparkContext.broadcast(({s: i for i, s in enumerate(names)}, block.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index, sizes = shared.value
        counts: dict[int, int] = defaultdict(int)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                words = words_of(text)
                for k in sizes:
                    for part in filter(index.__contains__, zip(*(words[j:] for j in range(k)))):
                        counts[index[part]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["shingle", "n"])

    for r in docs.select("text").mapInArrow(run, "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        block.frequency[names[r.shingle]] = r.n


#: What is found in a document: its number of words, the hit stretches (word offsets, start and end in turn), the items of
#: which windows occur, and the share of windows for each of them.
FOUND = "struct<n_words:long,spans:array<long>,items:array<string>,shares:array<double>>"


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _mark(docs: DataFrame, block: Block, keep: list[str], name: str, hit_only: bool = False) -> DataFrame:
    """The columns in keep and FOUND under the given name; hit_only: of documents with a hit alone."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        block = shared.value
        for batch in batches:
            out, rows = [], []
            for row, text in enumerate(texts_of(batch.column("text"))):
                words = words_of(text)
                found = block.matches(words)
                if hit_only and not found:
                    continue
                share: dict[str, int] = defaultdict(int)
                for w in found:
                    for item in block.owners[w]:
                        share[item] += 1
                items = sorted(share)
                spans = _merged([(at, at + len(block.windows[w])) for w, starts in found.items() for at in starts])
                out.append({"n_words": len(words), "spans": spans, "items": items, "shares": [share[i] / block.of_item[i] for i in items]})
                rows.append(row)
            held = batch.take(pa.array(rows, pa.int64())) if hit_only else batch
            yield pa.RecordBatch.from_arrays([*(held.column(c) for c in keep), pa.array(out, kind)], names=[*keep, name])

    return docs.mapInArrow(run, fields(docs, keep, (name, FOUND)))


@F.udf(T.ArrayType(T.LongType()))
def _united(parts: list[list[int]]) -> list[int]:
    """The stretches of several blocks as one list; only for documents that more than one block hits."""
    return _merged([(s, e) for part in parts for s, e in zip(part[::2], part[1::2])])


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, shingle: int = SHINGLE, containment: float = CONTAINMENT, block_words: int = BLOCK_WORDS, name: str = "found") -> DataFrame:
    """For each row of docs (with a column text): the columns in keep, and a struct of the given name with n_words, n_hit, spans
    (word offsets of the hit stretches, start and end in turn), items (found item ids, sorted) and max_containment (the
    largest share of an item's windows)."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c in keep]
    docs = docs.select(*map(of, dict.fromkeys([*keep, "text"])))
    blocks = _blocks(benchmark, window, shingle, containment, block_words)
    block, later = next(blocks, Block([], window, shingle, containment)), next(blocks, None)
    if later is None:
        if block.windows:
            _count_shingles(docs, block)
            block.order()
        state = _mark(docs, block, keep, name)
    else:
        (number,) = private([*keep, "text"], "row")
        docs = write_shared(docs.withColumn(number, F.monotonically_increasing_id()), "decontaminate")
        parts = []
        while block:
            _count_shingles(docs, block)
            block.order()
            parts.append(write_shared(_mark(docs, block, [number], "part", hit_only=True), "hits"))
            block, later = later, next(blocks, None)
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionByName(part)
        hits = hits.groupBy(number).agg(F.collect_list("part.spans").alias("spans"), F.array_sort(F.collect_list(F.arrays_zip("part.items", "part.shares"))).alias("parts"))
        # an item whose text stands in several rows may lie in several blocks: its share is the largest of them
        pairs = F.flatten("parts")
        hits = hits.select(number, F.when(F.size("spans") > 1, _united("spans")).otherwise(F.col("spans")[0]).alias("spans"), F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["items"]))).alias("items"), F.transform(pairs, lambda p: p["shares"]).alias("shares"))
        none = Block([], window, shingle, containment)
        state = _mark(docs, none, [*keep, number], name).join(hits.select(number, F.struct("spans", "items", "shares").alias("hits")), number, "left")
        merged = F.struct(of(name)["n_words"].alias("n_words"), *(F.coalesce(F.col("hits")[c], of(name)[c]).alias(c) for c in ("spans", "items", "shares")))
        state = state.select(*map(of, keep), merged.alias(name))
    found = of(name)
    hit = F.aggregate(F.transform(found["spans"], lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda done, x: done + x)
    whole = F.struct(found["n_words"].alias("n_words"), hit.alias("n_hit"), found["spans"].alias("spans"), found["items"].alias("items"), F.coalesce(F.array_max(found["shares"]), F.lit(0.0)).alias("max_containment"))
    return state.select(*map(of, keep), whole.alias(name))


def contaminated(found: F.Column) -> F.Column:
    return (found["n_hit"] > 0) & (ONE_IN * found["n_hit"] >= found["n_words"])


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = find_contamination(docs, benchmark, ["doc_id"])
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), contaminated(F.col("found")).alias("contaminated"))


ORACLE_OP3 = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, pos, pos + least(13, len(w)) - 1), ' ') AS content
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS pos FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM folded, sizes WHERE len(w) >= n),
hits AS (
  SELECT DISTINCT p.doc_id, p.pos, p.n, x.item_id
  FROM (SELECT doc_id, pos, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS content FROM places) p JOIN windows x ON p.n = x.n AND p.content = x.content),
counted AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT f.doc_id, len(f.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(f.w) AS contaminated
FROM folded f LEFT JOIN counted USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops the documents that the contract's rule calls contaminated; for odd input see the module. All
    columns keep their values, whatever their names."""
    (name,) = private(docs.columns, "found")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns, name=name)
    return found.where(~contaminated(of(name))).select(*map(of, docs.columns))
