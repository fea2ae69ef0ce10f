"""Byte-level BPE by vectorised pre-tokenisation and cached pair merging, and decoding by retained offsets.

The pieces of the public pattern (contractions, letters, numbers or other signs with at most one blank before them, white space)
are found without a regular expression: code points become classes by one table, two code points of lookahead settle the
classes of apostrophes and of the last white space of a run, and each class is a function between the few states of the
splitter. Composing such functions is associative, so all states come from a blocked prefix scan over the numbers of the
functions in their (finite) monoid, for all texts of a batch at once; a piece begins where state and class say so.
Pieces are slices of the UTF-8 bytes. Each distinct one is merged once for a worker, lowest rank first and leftmost among equals.

The byte at which each token ends is kept beside the ids; decoding writes every token's bytes to its place in one step, and
decodes a range of bytes by the tokens that touch it alone.

Defined results: a null text is empty and has no ids; a null key, repeated rows and ties keep a row each; a very long text is
scanned in blocks of SCAN code points with the state carried over, so only its text and ids are held, and a very long piece is
merged in n log n steps; an empty table gives no rows; columns other than those in `keep` are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, of, pieces, table, texts_of
from .tokens import vocabulary

RANKS = "byte_bpe_50k.tiktoken"
#: Code points scanned at once, and the length of the blocks inside a scan.
SCAN, BLOCK = 1 << 20, 64
#: Bytes that a worker's table of known pieces may take, what a piece takes besides its bytes and ids, and the longest piece kept.
MOST_BYTES, PIECE_BYTES, LONGEST_KEPT = 96 << 20, 180, 256

# The pattern's contractions are an apostrophe and one of these letters, or one of these pairs.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

# Classes of code points as the scan sees them. SPACE is white space with more of it (or the text's end) after it, JOINING a last
# blank before something else, ALONE any other last white space; SHORT and LONG are apostrophes that begin a contraction's letters.
LETTER, NUMBER, SIGN, SPACE, JOINING, ALONE, SHORT, LONG = range(8)
# States after a code point.
FRESH, IN_LETTERS, IN_NUMBERS, IN_SIGNS, IN_SPACE, JOINED, ONE_LEFT, TWO_LEFT = range(8)
_GOES_TO = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SIGN: IN_SIGNS, SPACE: IN_SPACE, JOINING: JOINED, ALONE: FRESH, SHORT: ONE_LEFT, LONG: TWO_LEFT}
_STAYS = {(IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_SPACE, SPACE)} | {(IN_SIGNS, c) for c in (SIGN, SHORT, LONG)}


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(state after a code point of this class, whether a piece begins at it)."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if (state, kind) in _STAYS:
        return state, False
    if state == JOINED:
        return (IN_SIGNS if kind in (SIGN, SHORT, LONG) else _GOES_TO[kind]), False
    return _GOES_TO[kind], True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that compositions of the classes' functions give: (number of each class and of each class at a text's begin,
    product table, state by [function, state before], whether a piece begins by [state, class])."""
    plain = [tuple(_step(s, c)[0] for s in range(8)) for c in range(8)]
    first = [(f[FRESH],) * 8 for f in plain]
    found = list(dict.fromkeys([tuple(range(8)), *plain, *first]))
    number = {f: i for i, f in enumerate(found)}
    for f in found:  # grows as it is walked
        for g in (*plain, *first):
            both = tuple(g[s] for s in f)
            if both not in number:
                number[both] = len(found)
                found.append(both)
    product = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], np.int16)
    begins = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)])
    return np.array([number[f] for f in (*plain, *first)], np.int16), product, np.array(found, np.uint8), begins


def _prefixes(functions: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Every prefix's composition: blocks of BLOCK in step, then the blocks' totals in the same way, then both together."""
    n, m = len(functions), len(product)
    if n <= 1:
        return functions
    table_, rows = product.ravel(), -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.int32)  # number 0 is the identity
    padded[:n] = functions
    inside = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        inside[i] = table_[inside[i - 1] * m + inside[i]]
    if rows > 1:
        before = np.zeros(rows, np.int32)
        before[1:] = _prefixes(inside[-1], product)[:-1]
        inside = table_[before[None, :] * m + inside]
    return inside.T.ravel()[:n]


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or SIGN for each code point, by the tables of the tokenizer library itself: what its patterns find among
    all code points. 1,114,112 bytes, made once on the driver."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    bytes_alone = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, SIGN, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        finder = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=bytes_alone, special_tokens={})
        out[np.frombuffer(finder.decode(finder.encode_ordinary(every)).encode("utf-32-le"), "<u4")] = kind
    return out


def piece_starts(points: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin in `points`, the code points of several texts one after another; begins: where texts begin."""
    numbers, product, state_at, is_begin = _monoid()
    n = len(points)
    heads = np.zeros(n + 3, bool)  # a text's begin, seen from the code points before it, is the end of theirs
    heads[begins[begins < n]] = True
    heads[n:] = True
    out, state = [], FRESH
    for at in range(0, n, SCAN):
        end = min(n, at + SCAN)
        near = points[at : min(n, end + 2)]
        kind = np.full(end - at + 2, SPACE, np.uint8)
        kind[: len(near)] = classes[near]
        size = end - at
        one, two = np.zeros(size, np.uint32), np.zeros(size, np.uint32)
        one[: len(near) - 1] = near[1 : size + 1]
        two[: max(0, len(near) - 2)] = near[2 : size + 2]
        ends_1, ends_2 = heads[at + 1 : end + 1], heads[at + 2 : end + 2]
        now, mine = kind[:size].copy(), near[:size]
        last = (kind[:size] == SPACE) & (kind[1 : size + 1] != SPACE) & ~ends_1
        now[last] = ALONE
        now[last & (mine == 32)] = JOINING
        apostrophe = (mine == 39) & ~ends_1
        short, long_ = np.zeros(size, bool), np.zeros(size, bool)
        for letter in ONE_LETTER:
            short |= one == ord(letter)
        for a, b in TWO_LETTERS:
            long_ |= (one == ord(a)) & (two == ord(b))
        now[apostrophe & short] = SHORT
        now[apostrophe & long_ & ~ends_2] = LONG
        starts = heads[at:end]
        functions = numbers[now.astype(np.int16) + 8 * starts].astype(np.int32)
        after = state_at[_prefixes(functions, product), state]
        before = np.empty(size, np.uint8)
        before[0], before[1:] = state, after[:-1]
        before[starts] = FRESH
        out.append(at + np.nonzero(is_begin[before, now])[0])
        state = int(after[-1])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of least rank is merged first, the leftmost among equals, until no pair has a rank."""
    whole, n = ranks.get(piece), len(piece)
    if whole is not None:
        return [whole]
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the begin of each part; an end of 0: merged into the one before
    queue = [(rank, i) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = ends[i]
        if not 0 < j < n or ranks.get(piece[i : ends[j]]) != rank:
            continue
        ends[i], ends[j] = ends[j], 0
        if ends[i] < n:
            before[ends[i]] = i
        for left in (before[i], i):
            if left >= 0 and ends[left] < n and (found := ranks.get(piece[left : ends[ends[left]]])) is not None:
                heapq.heappush(queue, (found, left))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Coder:
    """Ids and byte ends of texts by a file of ranks, and their bytes again."""

    def __init__(self, path: str, classes: np.ndarray, most_bytes: int = MOST_BYTES):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.classes, self.most_bytes, self.known, self.held = classes, most_bytes, {}, 0

    def _ids_of(self, parts: list[bytes]) -> tuple[bytes, list[int]]:
        """The ids of pieces, and the bytes that each one's ids take."""
        if self.held > self.most_bytes:
            self.known, self.held = {}, 0
        long_ = {}
        for part in set(parts).difference(self.known):
            ids = np.array(merged(part, self.ranks), "<u4").tobytes()
            if len(part) <= LONGEST_KEPT:
                self.known[part] = ids
                self.held += PIECE_BYTES + len(part) + len(ids)
            else:
                long_[part] = ids
        found = list(map(self.known.__getitem__, parts)) if not long_ else [self.known[p] if p in self.known else long_[p] for p in parts]
        return b"".join(found), list(map(len, found))

    def encode(self, texts: list[str], at_once: int = 1 << 16) -> list[tuple[bytes, bytes]]:
        """(ids, ends) of each text as little-endian unsigned 32-bit numbers; ends: the byte of the text at which each token ends."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        begins = np.concatenate(([0], np.cumsum(list(map(len, texts)), dtype=np.int64)))
        starts = piece_starts(points, begins, self.classes)
        widths = (1 + (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)).astype(np.uint8)
        sizes = np.add.reduceat(widths, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        offsets, data, coded, counts = np.concatenate(([0], np.cumsum(sizes))), whole.encode(), [], []
        for at in range(0, len(starts), at_once):
            edges = offsets[at : at + at_once + 1].tolist()
            ids, lengths = self._ids_of([data[a:b] for a, b in zip(edges, edges[1:])])
            coded.append(ids)
            counts.append(np.array(lengths, np.int64))
        ids = np.frombuffer(b"".join(coded), "<u4")
        # the first token of each text: pieces, and so tokens, never cross texts
        tokens = np.concatenate(([0], np.cumsum(np.concatenate(counts)) // 4)) if counts else np.zeros(1, np.int64)
        first = tokens[np.searchsorted(starts, begins)]
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        return [(ids[a:b].tobytes(), (ends[a + 1 : b + 1] - ends[a]).astype("<u4").tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def decode(self, ids: bytes, ends: bytes, at_once: int = 1 << 20) -> bytes:
        """The bytes of a text; ends that do not fit the ids are an error."""
        numbers, stops, out, done = np.frombuffer(ids, "<u4"), np.frombuffer(ends, "<u4").astype(np.int64), [], 0
        for at in range(0, len(numbers), at_once):
            n, stop = numbers[at : at + at_once], stops[at : at + at_once]
            size = self.sizes[n]
            start = np.concatenate(([done], stop[:-1]))
            if not np.array_equal(stop - start, size):
                raise ValueError("the ends of the tokens do not fit their ids")
            # each byte's place in the vocabulary: its token's, moved on by the byte's place in the token
            out.append(self.blob[np.repeat(self.places[n] - start, size) + np.arange(done, stop[-1])].tobytes())
            done = int(stop[-1])
        return b"".join(out)

    def decode_range(self, ids: bytes, ends: bytes, begin: int, end: int) -> bytes:
        """Bytes begin to end (exclusive) of a text, from the tokens that touch them alone."""
        stops = np.frombuffer(ends, "<u4")
        end = min(end, int(stops[-1]) if len(stops) else 0)
        if begin >= end:
            return b""
        a, b = np.searchsorted(stops, begin, side="right"), np.searchsorted(stops, end, side="left") + 1
        base = int(stops[a - 1]) if a else 0
        part = self.decode(ids[4 * a : 4 * b], (stops[a:b] - np.uint32(base)).astype("<u4").tobytes())
        return part[begin - base : end - base]


def _coder(ranks: str, classes: np.ndarray) -> Coder:
    return kept(("bpe", ranks), lambda: Coder(vocabulary(ranks), classes))


def _each(df: DataFrame, keep: list[str], read: list[str], schema: str, run) -> DataFrame:
    """Columns `keep` of df as they are, and the columns of `schema` that run(coder, batch of `read`) gives, row by row."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared, n = spark.sparkContext.broadcast(code_point_classes()), len(keep)
    told = df.select(*(of(c).alias(f"k{i}") for i, c in enumerate(keep)), *(of(c).alias(f"r{i}") for i, c in enumerate(read)))
    kinds = ", ".join([*(f"k{i} {told.schema[i].dataType.simpleString()}" for i in range(n)), schema])
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                made = run(shared.value, batch.select(list(range(n, batch.num_columns))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *names])

    return told.mapInArrow(rows, kinds).toDF(*keep, *names)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = RANKS) -> DataFrame:
    """The columns in keep, and ids and ends (see Coder.encode) of each row's text."""

    def run(classes: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
        coded = _coder(ranks, classes).encode(texts_of(batch.column(0)))
        return [pa.array([c[i] for c in coded], pa.binary()) for i in (0, 1)]

    return _each(df, list(keep), [text], "ids binary, ends binary", run)


def decode(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "ids"), ranks: str = RANKS) -> DataFrame:
    """The columns in keep, and the bytes (decoded) that ids and ends stand for."""

    def run(classes: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
        coder = _coder(ranks, classes)
        return [pa.array([coder.decode(i or b"", e or b"") for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.binary())]

    return _each(df, list(keep), ["ids", "ends"], "decoded binary", run)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"))
    n_tokens = F.octet_length("ids").cast("long") / 4
    return decode(coded).select("doc_id", n_tokens.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
