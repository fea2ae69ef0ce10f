"""Language identification by cross-parsing entropy.

One suffix automaton is built from a labelled sample of each language. A text is cut greedily into the longest phrases
that occur in the sample (a symbol that the sample lacks is a phrase by itself and counts twice); the language that needs the fewest phrases,
each costed at log2 of its sample's length and divided by the text's length, wins. All texts of an Arrow batch walk all
automata in step with numpy, so a symbol costs a few table lookups for each language. Long texts walk in blocks side by side:
each block is parsed as if a phrase began there, and then again from the state in which the block before it ends, until that
state is the one of its earlier parse. Two parses of a text soon meet in one state, so this second walk is short.

Symbols are the letters of the samples, however many, in lower case; a run of anything else is one gap, and letters that no
sample has are one symbol more, which no phrase holds. The automata's transitions lie in one double array (the entry of a
state and a symbol is at base[state] + symbol), whose size follows the samples and not their alphabets.

Defined results: a null text, or one without a letter, is `und` with score 0; with nothing to learn from every text is
`und`. A tie goes to the language that sorts first. Repeated rows each get their row. Rows with a null doc_id are
predicted but never learned from. Very long texts are parsed whole, and phrases go on over the ends of blocks. Beyond
`most_langs` distinct labels those of the most documents are learned, ties by name. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fields, held_out, let_go, of, pieces, private, table

#: The classifier is fitted on at most so many documents and code points of each language, and takes from a document at most
#: a stretch of SAMPLE_STRETCH code points, which begins at a place told by a hash of doc_id. It knows at most MOST_LANGS
#: languages, those with the most labelled documents.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_STRETCH, MOST_LANGS = 128, 32_768, 512, 256
#: Texts are parsed in blocks of so many symbols, and the states of two parses are compared after every STRIDE of them.
BLOCK, STRIDE = 512, 32
PAD, GAP, RARE, FIRST = 0, 1, 2, 3


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, stretch: int = SAMPLE_STRETCH, most_langs: int = MOST_LANGS) -> dict[str, str]:
    """A bounded labelled sample for each language, from learnable rows of (doc_id, text, lang), chosen by a hash of doc_id."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labels = docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_langs)
    known = known.join(F.broadcast(labels.select("lang")), "lang", "left_semi")  # at most most_langs rows
    begin = F.pmod(F.xxhash64("doc_id", F.lit("begin")), F.greatest(F.length("text") - stretch + 1, F.lit(1))) + 1
    part = F.substring(F.col("text"), begin.cast("int"), F.lit(stretch))
    told = known.select("lang", F.xxhash64("doc_id").alias("rank"), "doc_id", part.alias("text"))
    # at most sample_docs rows a language come to the driver, repeated rows included
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", "text"))
    rows = told.withColumn("nth", nth).where(F.col("nth") <= sample_docs).collect()
    sample: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.nth)):
        sample[r.lang] = sample.get(r.lang, "") + f"{r.text}\n"
    return {k: v[:sample_chars] for k, v in sorted(sample.items())}


def _automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of a string: for each state, the next state by symbol. State 0 is the root."""
    ways, link, size, last = [{}], [-1], [0], 0
    for c in symbols.tolist():
        new = len(ways)
        ways.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(ways)
                ways.append(dict(ways[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return ways


def _double_array(ways: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to): state s goes on with symbol c to to[base[s] + c] if owner[base[s] + c] is s."""
    base = np.zeros(len(ways), np.int32)
    used = bytearray(width)
    by_size: dict[int, list[int]] = defaultdict(list)
    for state, way in enumerate(ways):
        by_size[len(way)].append(state)
    for size in sorted(by_size, reverse=True):
        low = width
        for state in by_size[size] if size else ():
            symbols = sorted(ways[state])
            at, tries = low, 0
            while True:
                at = used.find(0, at)
                if at < 0 or tries > 32:
                    at = len(used)
                if len(used) < at + width:
                    used.extend(bytes(at + width - len(used)))
                place = at - symbols[0]
                if not any(used[place + c] for c in symbols):
                    break
                at, tries = at + 1, tries + 1
            if tries > 32 or size == 1:
                low = at
            base[state] = place
            for c in symbols:
                used[place + c] = 1
    owner, to = np.full(len(used) + width, -1, np.int32), np.zeros(len(used) + width, np.int32)
    for state, way in enumerate(ways):
        for c, next_state in way.items():
            owner[base[state] + c], to[base[state] + c] = state, next_state
    return base, owner, to


class CrossParser:
    """Automata of all languages in one double array; `phrases` counts the phrases of many texts at once."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        letters = sorted({ch for text in sample.values() for ch in text.lower() if ch.isalpha()})
        self.width = FIRST + len(letters)
        self.symbol = np.full(0x110000, GAP, np.uint16 if self.width < 1 << 16 else np.uint32)
        self.symbol[[i for i in range(0x110000) if chr(i).isalpha()]] = RARE
        self.symbol[[ord(ch) for ch in letters]] = np.arange(FIRST, self.width)
        ways: list[dict[int, int]] = []
        # the state with which a phrase begins, by language and symbol; a language's last state stands for a symbol it lacks
        self.start, self.lost, cost = np.zeros((len(self.langs), self.width), np.int32), [], []
        for row, lang in enumerate(self.langs):
            coded, at = self.code(sample[lang]), len(ways)
            own = _automaton(coded)
            ways += [{c: to + at for c, to in way.items()} for way in own] + [{}]
            self.start[row] = len(ways) - 1
            self.lost.append(len(ways) - 1)
            for c, to in own[0].items():
                self.start[row, c] = to + at
            cost.append(float(np.log2(max(2, len(coded)))))
        self.cost = np.array(cost)
        self.base, self.owner, self.to = _double_array(ways, self.width)

    def code(self, text: str) -> np.ndarray:
        """Symbols of a text: letters in lower case, and one gap for each run of anything else."""
        out = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = out == GAP
        return out[~(gap & np.concatenate(([False], gap[:-1])))] if len(out) else out

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases needed, as [text, language]."""
        size = np.array([-(-len(x) // BLOCK) for x in coded], np.int64)
        starts = np.concatenate(([0], np.cumsum(size)))
        n = int(starts[-1])
        sheet = np.full(n * BLOCK, PAD, self.symbol.dtype)
        for at, x in zip(starts, coded):
            sheet[at * BLOCK : at * BLOCK + len(x)] = x
        steps = np.ascontiguousarray(sheet.reshape(-1, BLOCK).T.astype(np.int32))
        # a column is a block in a language; a text's first block begins in the lost state, from which every symbol begins a phrase
        lost = np.repeat(np.array(self.lost, np.int32), n)
        goes_on = np.ones(n, bool)
        goes_on[starts[:-1][size > 0]] = False
        states = np.full((BLOCK // STRIDE, len(lost)), -1, np.int32)
        counts = np.zeros(states.shape, np.int32)
        entered = lost.copy()
        columns = np.arange(len(lost))
        while len(columns):
            self._walk(steps, columns, entered[columns], lost, states, counts)
            before = np.roll(states[-1], 1)
            changed = np.tile(goes_on, len(self.langs)) & (before != entered)
            entered = np.where(changed, before, entered)
            columns = np.flatnonzero(changed)
        total = np.zeros((len(self.langs), n + 1), np.int64)
        np.cumsum(counts[-1].reshape(len(self.langs), n), axis=1, out=total[:, 1:])
        return (total[:, starts[1:]] - total[:, starts[:-1]]).T

    def _walk(self, steps: np.ndarray, columns: np.ndarray, state: np.ndarray, lost: np.ndarray, states: np.ndarray, counts: np.ndarray) -> None:
        """Parses the given columns from the given states. states and counts hold each column's state and phrases so far after
        every STRIDE symbols; a column ends where its state is that of its earlier parse, and its later counts move along."""
        row, block = np.divmod(columns, max(1, steps.shape[1]))
        row, lost_, phrases, start = row * self.width, lost[columns], np.zeros(len(columns), np.int32), self.start.ravel()
        for t, step in enumerate(steps):
            symbol = step[block]
            at = self.base[state] + symbol
            ends = self.owner[at] != state
            state = np.where(ends, start[row + symbol], self.to[at])
            phrases += ends * (1 + (state == lost_)) * (symbol != PAD)
            k, rest = divmod(t + 1, STRIDE)
            if rest:
                continue
            met = states[k - 1, columns] == state
            if met.any():
                moved = columns[met]
                counts[k - 1 :, moved] += phrases[met] - counts[k - 1, moved]
                columns, row, block, lost_, phrases, state = (x[~met] for x in (columns, row, block, lost_, phrases, state))
            states[k - 1, columns], counts[k - 1, columns] = state, phrases
            if not len(columns):
                break

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [self.code(x or "") for x in texts]
        spoken = [bool((x >= RARE).any()) for x in coded]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = self.phrases(coded) * self.cost / np.maximum(1, [len(x) for x in coded])[:, None]
        best = bits.argmin(axis=1)
        weight = np.exp(bits.min(axis=1)[:, None] - bits)
        score = 1 / weight.sum(axis=1)
        return [self.langs[i] if ok else "und" for i, ok in zip(best, spoken)], [float(s) if ok else 0.0 for s, ok in zip(score, spoken)]


def identify(docs: DataFrame, sample: dict[str, str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds two columns, the language and the score, to every row of docs, which needs a column text."""
    bounded_batches(docs.sparkSession)
    # the parser's size is bounded by the sample's
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(sample))
    docs = docs.drop(*names)
    lang, score = names
    schema = fields(docs, docs.columns, (lang, "string"), (score, "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        parser = shared.value
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                langs, scores = parser.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_spoken(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents in no language (`und`). The model is learned from the stage's own input.

    Null and empty texts go; repeated rows and rows without a doc_id are judged one by one; all columns keep their values,
    whatever their names; an empty table stays empty."""
    names = private(docs.columns, "lang_pred", "score")
    return identify(docs, learn(docs), tuple(names)).where(F.col(names[0]) != "und").select(*map(of, docs.columns))
