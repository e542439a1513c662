"""Fill-in-the-middle: a text becomes prefix, suffix and middle between marks, or stays as it is, by a hash of its id.

Each text is decoded to an array of code points. White-space and other code points are two classes; where a neighbour's class
differs, a run ends, and the ends of the runs that aren't white space are the ends of the tokens. The cuts are two ranks of
these ends. A row needs no other row, so the job is one scan without a shuffle, and a lost task is run again from its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from meshwork.plans.workers import trimmed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space is \x20 and \x09 to \x0D.
_SPACE = np.zeros(128, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are worked on in slices of about so many bytes (four times as many as code points).
SLICE_BYTES = 1 << 24


class Plan(NamedTuple):
    """Of 100 texts ``rate`` are cut; of 100 texts that are cut ``spm_rate`` start with the suffix; ``seed`` enters the hash."""

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80


class Cut(NamedTuple):
    output: str
    form: str
    n: int
    prefix_chars: int | None
    middle_chars: int | None


def token_ends(points: np.ndarray) -> np.ndarray:
    """Where tokens end: white space with the word after it, or white space at the end of the text."""
    if not len(points):
        return np.zeros(0, np.int64)
    space = (points < 128) & _SPACE[np.minimum(points, 127)]
    ends = np.flatnonzero(np.append(space[1:] != space[:-1], True)) + 1
    return ends[~space[ends - 1] | (ends == len(points))]


def ranks(doc_id: int | None, plan: Plan) -> tuple[int, ...]:
    """h1 to h4: the first four groups of eight hex digits of the SHA-256 of seed, colon and decimal id (no id: nothing)."""
    return tuple(np.frombuffer(hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16], ">u4").tolist())


def transform(doc_id: int | None, text: str, plan: Plan) -> Cut:
    h1, h2, h3, h4 = ranks(doc_id, plan)
    raw = text.encode("utf-32-le")
    points = np.frombuffer(raw, np.uint32)
    ends = token_ends(points)
    n = len(ends)
    if not n or h3 % 100 >= plan.rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(text, "plain", n, None, None)
    at = np.append(0, ends)[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in zip((0, *at), (*at, len(points)), strict=True))
    if h4 % 100 < plan.spm_rate:
        return Cut(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", n, at[0], at[1] - at[0])
    return Cut(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", n, at[0], at[1] - at[0])


def restore(output: str, form: str) -> str:
    """The text again, from the output and its form alone; texts that hold a mark are never cut, so each mark stands once."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    starts = [output.index(m) for m in marks]
    parts = {m: output[i + len(m) : j] for m, i, j in zip(marks, starts, (*starts[1:], len(output)), strict=True)}
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of rows of about ``most`` bytes of text, never less than one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield start, stop - start
        start = stop


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n long, form, prefix_chars, middle_chars long, output, restored), a row per row of ``docs``.

    A null text is the empty one; an empty text, and one that holds a mark, stays plain. A row without an id is hashed with
    nothing after the colon. Rows that are equal have equal results; other columns, whatever their names, are left aside. An
    empty table gives an empty one. ``restored`` is made from output and form, not from the text.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in slices(batch.column("text")):
                part = batch.slice(start, count)
                cuts = [transform(i, t or "", plan) for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                columns = [pa.array([c[k] for c in cuts], kind) for k, kind in ((2, pa.int64()), (1, pa.string()), (3, pa.int64()), (4, pa.int64()), (0, pa.string()))]
                back = pa.array([restore(c.output, c.form) for c in cuts], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, back], ["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string").withColumnRenamed("id", id_col)
