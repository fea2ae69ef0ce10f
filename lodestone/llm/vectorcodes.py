"""Vector codes: vectors cut into equal parts, each part named by its nearest entry of a learned codebook, found by equal-average search.

Entries stand in the order of their components' sums. For a vector of d components the squared gap between its sum and an entry's,
divided by d, is at most their squared distance; so the search begins at the entries whose sums lie around the vector's and
expands outward on both sides, and a side ends for a vector once that bound strictly exceeds its best distance (an equal one
may still give a tie with a lower index). Vectors of near sums expand together: BLOCK entries at a time meet those that are still
open as one matrix product of whole numbers, which doubles hold exactly.

Learning: a pass over all rows sums the parts of each entry inside the tasks, so parts x entries rows a task are shuffled, and a
codebook of bounded size (parts x entries x components) comes to the driver and goes out with the next pass.

Defined results: rows whose vector is null, empty, holds null or non-finite components, or has another length than most vectors
(the longer of equally frequent ones) are dropped; the first entries come from the least keys, null ones last, ties by the
vector's numbers; repeated rows count as often as they occur; of fewer vectors than entries all are entries; null labels are
one label; an empty table gives no rows and no entries; columns other than key, vector and label are not read. Two things are errors:
a vector length that `parts` does not divide, and numbers so large that squared distances pass 2^53 (components beyond
about 8,000 at 16 a part).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, let_go, of, table, write_shared

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors that expand together, entries that they meet at once, and vectors that a task works on at once.
GROUP, BLOCK, AT_ONCE = 512, 32, 8192
#: Labels with more than this share of the rows are joined by broadcast; there are at most 1,000 of them.
HOT_SHARE = 1000


class Book:
    """The entries of one part, by sum."""

    def __init__(self, entries: np.ndarray):
        self.order = np.argsort(entries.sum(1), kind="stable")
        self.entries, self.sums, self.d = entries[self.order].astype(np.float64), entries.sum(1)[self.order], entries.shape[1]
        self.squares = (self.entries**2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row of x, the lower index among equals."""
        sums, n = x.sum(1), len(self.order)
        x = x.astype(np.float64)
        squares, by_sum = (x**2).sum(1), np.argsort(sums, kind="stable")
        best = np.full(len(x), np.iinfo(np.int64).max)  # distance x entries + index

        def look(rows: np.ndarray, begin: int, end: int) -> None:
            distance = squares[rows, None] + self.squares[None, begin:end] - 2 * (x[rows] @ self.entries[begin:end].T)
            best[rows] = np.minimum(best[rows], (distance.astype(np.int64) * n + self.order[None, begin:end]).min(1))

        def still_open(rows: np.ndarray, entry: int) -> np.ndarray:
            return rows[(sums[rows] - self.sums[entry]) ** 2 <= (best[rows] // n) * self.d]

        for at in range(0, len(x), GROUP):
            left = right = by_sum[at : at + GROUP]
            low = int(np.searchsorted(self.sums, sums[left[0]], "left"))
            high = int(np.searchsorted(self.sums, sums[left[-1]], "right"))
            if low < high:
                look(left, low, high)
            while len(left) or len(right):
                left = still_open(left, low - 1) if low > 0 else left[:0]
                if len(left):
                    look(left, max(0, low - BLOCK), low)
                    low = max(0, low - BLOCK)
                right = still_open(right, high) if high < n else right[:0]
                if len(right):
                    look(right, high, min(n, high + BLOCK))
                    high = min(n, high + BLOCK)
        return best % n, best // n


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(rows, parts, components) of the vectors in a batch; numbers too large to be exact are an error."""
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)
    if x.size and x.shape[2] * (2 * int(np.abs(x).max())) ** 2 >= 1 << 53:
        raise ValueError("components are too large for exact distances")
    return x


def _assigned(books: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for p in range(x.shape[1]):
        yield p, *Book(books[p]).nearest(np.ascontiguousarray(x[:, p]))


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of about AT_ONCE rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def numbers(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(k, v, label) of the usable rows: the vectors as whole numbers floor(scale * x)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = rows.select(of(key).alias("k"), of(vector).alias("v"), of(label).alias("label")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    return told.select("k", whole.cast("array<long>").alias("v"), "label")


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components) of kept (k, v): first the vectors of the least keys, then `rounds` rounds of assigning all
    parts and replacing each entry by the floor of its parts' mean."""
    first = kept.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r.v for r in first], np.int64)
    if books.shape[1] % parts:
        raise ValueError(f"vectors of {books.shape[1]} components cannot be cut into {parts} equal parts")
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2)
    d = books.shape[2]
    columns = [f"s{i}" for i in range(d)]
    schema = ", ".join(["part int", "entry int", "n long", *(f"{c} long" for c in columns)])
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            let_go()
            counts, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in _larger(batches):
                x = _parts(batch, len(books))
                for p, index, _ in _assigned(books, x):
                    counts[p] += np.bincount(index, minlength=books.shape[1])
                    for i in range(d):
                        # below 2^53 in a run of rows, so exact as doubles
                        totals[p, :, i] += np.rint(np.bincount(index, x[:, p, i], books.shape[1])).astype(np.int64)
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), *(pa.array(totals[part, entry, i]) for i in range(d))], names=["part", "entry", "n", *columns])

        found = kept.select("v").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect()
        books = books.copy()
        for r in found:
            books[r.part, r.entry] = [r[c] // r.n for c in columns]
    return books


def codes(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """kept (k, v, label) with code array<int> in place of v, and error, the squared distances summed over parts."""
    if not books.size:
        return kept.select("k", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in _larger(batches):
            x = _parts(batch, len(books))
            found = list(_assigned(books, x))
            code = np.stack([index for _, index, _ in found], 1).astype(np.int32)
            offsets = np.arange(0, code.size + 1, len(books), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("label"), pa.ListArray.from_arrays(offsets, code.ravel()), pa.array(sum(distance for _, _, distance in found))],
                names=["k", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"k {kinds['k']}, label {kinds['label']}, code array<int>, error long")


def decoded(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """coded with `vector`, what its code stands for: the entries' middles (an entry stands for numbers from itself up to the next)."""
    entries = F.lit([[[(int(x) + 0.5) / scale for x in entry] for entry in book] for book in books]) if books.size else F.array()
    return coded.withColumn("vector", F.flatten(F.transform("code", lambda c, p: F.get(F.get(entries, p), c))))


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over rows of its label, nulls together.

    Sums are combined before the shuffle. Labels with more than 1 / HOT_SHARE of all rows, at most HOT_SHARE of them, come to their
    rows by broadcast; the rest by a join in which no label has more rows than that."""
    totals = write_shared(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = totals.where(F.col("n") * HOT_SHARE > rows).select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"), F.lit(True).alias("is_hot"))
    marked = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    rest = totals.where(F.col("n") * HOT_SHARE <= rows).select(F.col("label").alias("own"), "label_error")
    cold = marked.where("is_hot IS NULL").join(rest, F.col("label").eqNullSafe(F.col("own"))).select(*coded.columns, "label_error")
    return marked.where("is_hot").select(*coded.columns, F.col("hot_error").alias("label_error")).unionByName(cold)


def usual_length(kept: DataFrame) -> DataFrame:
    """kept without vectors of another length than most."""
    most = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return kept.where(F.size("v") == (most.size if most else 0))


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((k, label, code, error), codebooks). The whole numbers are written once to the shared folder; all passes read them."""
    bounded_batches(rows.sparkSession)
    kept = usual_length(write_shared(numbers(rows, key, vector, label, scale), "vectors"))
    books = learn(kept, parts, entries, rounds)
    return write_shared(codes(kept, books), "codes"), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    hexes = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return label_errors(coded).select(F.col("k").alias("vec_id"), hexes.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_BOOK = """,
books{i} AS (SELECT p, e, list(x ORDER BY j) AS v FROM (
    SELECT p, e, j, floor(sum(x) / count(*)) AS x FROM (SELECT p, e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM assigned{b}) GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT p, e, v FROM books{b} ANTI JOIN assigned{b} USING (p, e))"""
_ASSIGNED = """,
assigned{i} AS (SELECT r, p, v, (best % 256)::INT AS e, best // 256 AS distance FROM (
    SELECT r, p, any_value(a.v) AS v, min((list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v))::BIGINT * 256 + e) AS best
    FROM cut a JOIN books{i} b USING (p) GROUP BY r, p))"""

ORACLE_OP12 = (
    """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM usable, range(4) t(p)),
books0 AS (SELECT p, e, c.v FROM cut c JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM usable) s USING (r) WHERE e < 256)"""
    + "".join(_ASSIGNED.format(i=i) + _BOOK.format(i=i + 1, b=i) for i in range(ROUNDS))
    + _ASSIGNED.format(i=ROUNDS)
    + f""",
told AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(distance)::BIGINT AS error FROM assigned{ROUNDS} GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM told JOIN usable USING (r), digest"""
)
