"""Best-fit packing of tokenized documents into sequences of a fixed length.

Only the histogram of piece lengths (at most `capacity` numbers) decides the packing, so it is solved on the driver
whatever the corpus' size: the configuration linear program (see `configuration`) is solved by multiplicative weights with
knapsack pricing, its solution is rounded, and what the rounding leaves is packed best-fit. Every piece then learns its
place from its number among the pieces of its length: these numbers come from counts by (length, block), with as many blocks
as the length's pieces need, so no task holds all pieces of a common length. A piece of full length is a sequence by
itself and needs no number.

Defined results: a null text is empty and packs as its end token alone; repeated rows, and rows without a doc_id, are packed
as separate documents; a very long text is cut into pieces; extra columns are ignored, whatever their names; an empty table
gives no pieces. Sequences of one full piece have negative sequence ids.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, table, write_shared
from .configuration import rounded, solve
from .tokens import encoder, vocabulary

CAPACITY, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k.json"
#: Pieces of one length that are numbered together.
BLOCK_PIECES = 1_024


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_name: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document of docs (doc_id, text): doc_id, doc_row (the document's own number), piece,
    start, length, ids_crc32, and with keep_ids the ids as little-endian unsigned 32-bit bytes."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary(vocabulary_name), spaced=True)
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                at, numbers, starts, lengths, sums, ids = [], [], [], [], [], []
                for row, coded in enumerate(code.encode(batch.column("text"))):
                    coded = memoryview(coded + end)
                    n = len(coded) // 4
                    first, begin, number = (n - 1) % capacity + 1, 0, 0
                    while begin < n:
                        stop = first + capacity * number
                        part = coded[4 * begin : 4 * stop]
                        at.append(row)
                        numbers.append(number)
                        starts.append(begin)
                        lengths.append(stop - begin)
                        sums.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(bytes(part))
                        begin, number = stop, number + 1
                take = pa.array(at, pa.int64())
                columns = [batch.column("doc_id").take(take), batch.column("doc_row").take(take), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "doc_row", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if keep_ids else []), names=names + (["ids"] if keep_ids else []))

    rows = docs.select("doc_id", "text").withColumn("doc_row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"doc_id {kind}, doc_row long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def best_fit(left: dict[int, int], capacity: int, begun: list[tuple[Counter, int]] = ()) -> list[tuple[Counter, int]]:
    """Packs lengths with counts, longest first: a piece goes to the sequence with the least room that takes it, among those
    begun and those opened; like sequences are kept together, as a pattern and how often it stands."""
    by_room: dict[int, list[tuple[Counter, int]]] = {}

    def put(pattern: Counter, times: int) -> None:
        by_room.setdefault(capacity - sum(n * k for n, k in pattern.items()), []).append((pattern, times))

    for pattern, times in begun:
        put(pattern, times)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            room = min((r for r in by_room if r >= n), default=None)
            if room is None:
                put(Counter(), count)
                continue
            pattern, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            used = min(times, count)
            if used < times:
                put(pattern, times - used)
            put(pattern + Counter({n: 1}), used)
            count -= used
    return [(pattern, times) for same in by_room.values() for pattern, times in same if pattern]


def fill(left: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Packs lengths with counts: the longest piece opens a sequence, and the longest that fits fills it; a pattern is used as
    often as its pieces last."""
    left = {n: c for n, c in left.items() if c}
    order, out = sorted(left, reverse=True), []
    while order:
        pattern: Counter = Counter()
        room = capacity
        for n in order:
            fits = min(room // n, left[n])
            if fits:
                pattern[n] = fits
                room -= n * fits
            if room < order[-1]:
                break
        times = min(left[n] // k for n, k in pattern.items())
        out.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns and how often to use each, so that exactly the given pieces are held: those of the linear program, rounded,
    and what the rounding leaves, best-fit into their room or into sequences of its own, whichever takes fewer."""
    chosen, left = rounded(solve(counts, capacity), counts)
    return min(chosen + fill(left, capacity), best_fit(left, capacity, chosen), key=lambda o: sum(times for _, times in o))


def places(chosen: list[tuple[Counter, int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first number, pieces a sequence, first sequence, first offset), by first number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, times in chosen:
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            out.setdefault(n, []).append((taken[n], k, sequence, offset))
            taken[n] += k * times
            offset += n * k
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def numbered(rows: DataFrame, counts: dict[int, int], block_pieces: int) -> DataFrame:
    """Adds `number`: each row's own number from 0 among the rows of its length. Rows are numbered within (length, block), where
    a length has as many blocks as its count needs, and each block begins where the counts of those before it end."""
    blocks = F.array(*(F.lit(max(1, -(-counts.get(n, 0) // block_pieces))) for n in range(1, max(counts, default=1) + 1)))
    block = F.pmod(F.xxhash64("doc_row", "piece"), F.element_at(blocks, F.col("length").cast("int")))
    rows = rows.withColumn("block", block)
    count = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = count.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_row", "piece"))
    return rows.withColumn("nth", nth).join(begin, ["length", "block"]).withColumn("number", F.col("begin") + F.col("nth") - 1).drop("block", "nth", "begin")


def pack(rows: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_row, piece, length and more). rows must be stable: written, not computed anew."""
    counts = {r.length: r.n for r in rows.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    alone = rows.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    others = numbered(rows.where(F.col("length") < capacity), counts, block_pieces)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema), "sequence_id long, offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for n in np.unique(length).tolist():
                mine = length == n
                table = place[n]
                found = table[np.searchsorted(table[:, 0], number[mine], side="right") - 1]
                nth = number[mine] - found[:, 0]
                sequence[mine] = found[:, 2] + nth // found[:, 1]
                offset[mine] = found[:, 3] + nth % found[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    return others.mapInArrow(run, schema).drop("number").unionByName(alone)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    rows = write_shared(tokenized_pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces of the documents that are left; for odd input see the module."""
    rows = write_shared(tokenized_pieces(docs), "pieces")
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
