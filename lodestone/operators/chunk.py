"""Cutting texts into located chunks. Cut points depend on what was cut before, so a text is scanned in order in an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = "chunk_no int, text string, locator_type string, locator string, start_char int, end_char int"
#: How many texts a worker has as Python objects at once, with what was found in them.
SLICE = 64
ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_MARKER = re.compile(r"^\[(page|slide|sheet|part)(?::\s*|\s+)([^\]]+)\][^\S\n]*$", re.MULTILINE)


def flat(text: str) -> str:
    """The text on one line: ё as е, single blanks."""
    return " ".join(text.translate({0x451: "е", 0x401: "Е"}).split())


def windows(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Bounds of overlapping pieces of at most `most` characters; a piece ends after the last full stop of its second half."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            stop = text.rfind(". ", at, end)
            if stop > at + most // 2:
                end = stop + 1
        lead = len(text[at:end]) - len(text[at:end].lstrip())
        body = text[at:end].strip()
        if body:
            yield at + lead, at + lead + len(body)
        if end == len(text):
            return
        at = max(at + 1, end - overlap)


def line_groups(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of groups of whole lines of at most `most` characters; a longer line stands alone."""
    begin, end, held, at = None, 0, 0, 0
    for line in text.splitlines(keepends=True):
        if line.strip():
            if begin is not None and held + len(line) > most:
                yield begin, end
                begin, held = None, 0
            begin = at if begin is None else begin
            end, held = at + len(line), held + len(line)
        at += len(line)
    if begin is not None:
        yield begin, end


def _locator(kind: str, rest: str) -> str:
    if kind in ("page", "slide"):
        return f"{kind} {rest.split(':')[0].strip()}"
    return rest.split(";")[0].strip() if kind == "sheet" else rest.strip()


def sections(text: str) -> Iterator[tuple[str | None, str | None, str]]:
    """(locator type, locator, body). Text before the first marker is a section without a locator."""
    marks = list(_MARKER.finditer(text))
    head = text[: marks[0].start()] if marks else text
    if head.strip():
        yield None, None, head
    for m, n in zip(marks, [*marks[1:], None]):
        yield m[1], _locator(m[1], m[2]), text[m.end() : n.start() if n else len(text)].strip()


def chunks_of(text: str | None, most: int = 1800, overlap: int = 200) -> list[dict]:
    out: list[dict] = []
    for kind, locator, body in sections(text or ""):
        sheet = kind == "sheet"
        body = body if sheet else flat(body)
        for start, end in line_groups(body, most) if sheet else windows(body, most, overlap):
            out.append({"chunk_no": len(out), "text": body[start:end].strip(), "locator_type": kind or "chunk", "locator": locator or f"chunk {len(out) + 1}", "start_char": start, "end_char": end})
    return out


def found_in_texts(df: DataFrame, text: str, find: Callable[[str | None], list[dict]], fields: str) -> DataFrame:
    """The columns of df but text, and a row for each thing that find tells of a text, with fields. A batch is gone through in slices, so that
    what a worker holds does not grow with the number of its rows."""
    others = [c for c in df.columns if c != text]
    added = T.StructType.fromDDL(fields)
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [find(t) for t in part.column(text).to_pylist()]
                whose = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
                rows = [x for xs in found for x in xs]
                kept = [part.column(c).take(whose) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x[n] for x in rows], ARROW[t.dataType.simpleString()]) for n, t in zip(names, added.fields))], names=[*others, *names])

    return df.select(*others, text).mapInArrow(run, T.StructType([*(df.schema[c] for c in others), *added.fields]))


def chunk(docs: DataFrame, text: str = "text", most: int = 1800, overlap: int = 200) -> DataFrame:
    """A row for each chunk: the other columns of docs, then chunk_no, text, locator_type, locator, start_char and end_char.

    Offsets are those in the normalized section (the section as it stands for sheets)."""
    return found_in_texts(docs, text, lambda t: chunks_of(t, most, overlap), CHUNK)
