"""Repeated windows of words found by the symbols of a recompression that stand for them.

Equal windows are stood for by symbols of one name (see :mod:`recompression`), so a window whose symbol, with the words that it hangs
on, occurs once in all documents is not repeated. Four jobs of one plan follow: whole documents are named, so that of equal ones only
the first is looked at; symbols are counted, and the unique ones return to their documents; windows that are left, and those no symbol
stands for, are named by their words and counted, and each name's first place returns to its document; what isn't first is removed.
Counts are group-bys with partial sums, so what is frequent arrives once a task. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.fim import slices
from meshwork.llm.recompression import Symbols, anchors, hung_names, recompress, split_words, window_names
from meshwork.plans.workers import trimmed

#: Bytes of text that a task works on at a time; the numpy arrays take some thirty times that. A longer text goes alone.
SLICE_BYTES = 1 << 21
#: Bits of a row's hash beside a window's start, which has the others: texts have up to 2^28 words.
TIE_BITS = 35


class _Part:
    """Texts of one slice of a batch, as bytes side by side, with the names and documents of their words."""

    def __init__(self, batch: pa.RecordBatch, start: int, count: int):
        self.rows = batch.slice(start, count)
        texts = self.rows.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.names, self.doc = split_words(self.bytes, self.offsets)
        self.n_words = np.bincount(self.doc, minlength=count)

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)

    def words(self, i: int) -> list[bytes]:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes().split()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, Symbols]:
        """Starts of all windows of ``n`` words, the symbol that stands for each (-1: none), and the symbols."""
        starts = np.flatnonzero(self.doc[: -n + 1 or None] == self.doc[n - 1 :]) if len(self.doc) >= n else np.zeros(0, np.int64)
        symbols = recompress(self.names, self.doc)
        return starts, anchors(symbols, starts, n), symbols

    def pending(self, n: int) -> np.ndarray:
        """Starts of the windows that may be repeated: of first documents, and not stood for by a symbol that occurs once."""
        starts, best, symbols = self.windows(n)
        first = np.array([bool(x) for x in self.rows.column("first").to_pylist()], bool)
        once = np.isin(hung_names(self.names, symbols), self.rows.column("once").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        return starts[first[self.doc[starts]] & ~((best >= 0) & once[best])] if len(starts) else starts


def _over(n: int, rows: DataFrame, job, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in slices(batch.column("text"), SLICE_BYTES):
                yield job(_Part(batch, start, count), n)

    return rows.mapInArrow(trimmed(run), schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _documents(part: _Part, n: int) -> pa.RecordBatch:
    """Names of all words of the documents that have a window."""
    long = np.flatnonzero(part.n_words >= n)
    whole = np.frombuffer(b"".join(hashlib.sha256(b" ".join(part.words(i))).digest()[:16] for i in long.tolist()), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(part.column("row")[long]), pa.array(part.column("key")[long]), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy())], ["row", "key", "a", "b"])


def _symbols(part: _Part, n: int) -> pa.RecordBatch:
    """A row per symbol that stands for some window, named by the words it hangs on, which such a window holds too."""
    _, best, symbols = part.windows(n)
    used = np.unique(best[best >= 0])
    return pa.RecordBatch.from_arrays([_signed(hung_names(part.names, symbols)[used]), pa.array(part.column("row")[part.doc[symbols.lo[used]]])], ["name", "row"])


def _windows(part: _Part, n: int) -> pa.RecordBatch:
    """A row per window that may be repeated; ``place`` is its start and, in the low bits, some of its row's hash."""
    starts = part.pending(n)
    a, b = window_names(part.names, starts, n)
    doc = part.doc[starts]
    at = (starts - np.searchsorted(part.doc, doc)).astype(np.int64)
    if len(at) and int(at.max()) >> (63 - TIE_BITS):
        raise ValueError(f"a text of more than {1 << (63 - TIE_BITS)} words")
    place = (at << TIE_BITS) | part.column("bits")[doc]
    return pa.RecordBatch.from_arrays([_signed(a), pa.array(b.astype(np.int64)), pa.array(part.column("key")[doc]), pa.array(place)], ["a", "b", "key", "place"])


def _kept(part: _Part, n: int) -> pa.RecordBatch:
    starts = part.pending(n)
    a, _ = window_names(part.names, starts, n)
    doc = part.doc[starts]
    origin = np.searchsorted(part.doc, np.arange(len(part.rows)))
    places = part.rows.column("firsts")
    counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
    flat = places.flatten()
    first_at = flat.field("at").to_numpy(zero_copy_only=False) + origin[np.repeat(np.arange(len(part.rows)), counts)]
    first = np.isin(starts, first_at)
    # a place is a first one for the window that stands there, and rows that share an id may differ there
    order = np.argsort(first_at, kind="stable")
    named = flat.field("a").to_numpy(zero_copy_only=False).view(np.uint64)[order]
    at = np.minimum(np.searchsorted(first_at[order], starts), max(len(order) - 1, 0))
    first &= named[at] == a if len(order) else False
    cover = np.zeros(len(part.doc) + 1, np.int64)
    again = starts[~first]
    np.add.at(cover, again, 1)
    np.add.at(cover, again + n, -1)
    gone = np.cumsum(cover[:-1]) > 0
    copies = np.array([not x for x in part.rows.column("first").to_pylist()], bool) & (part.n_words >= n)
    gone |= copies[part.doc] if len(gone) else gone
    removed = np.bincount(part.doc[gone], minlength=len(part.rows))
    kept, spans = [], []
    for i, (words, less) in enumerate(zip(part.n_words.tolist(), removed.tolist(), strict=True)):
        out = gone[origin[i] : origin[i] + words]
        kept.append(b" ".join(itertools.compress(part.words(i), (~out).tolist()) if less else part.words(i)))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).reshape(-1, 2)
        spans.append([{"start": x, "end": y} for x, y in edges.tolist()])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    texts = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([part.rows.column("id"), pa.array(part.n_words), pa.array(removed), pa.array(spans, span), texts], ["id", "n_words", "n_removed", "spans", "kept"])


def _row(key: Column, bits: Column) -> Column:
    """What a row and its windows have in common. Rows that have it in common by chance also share lists, whose names tell them apart."""
    return F.xxhash64(key, bits)


def substring_dedup(docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, n_removed long, spans, kept): each text less the words of windows of ``n`` words that also start earlier.

    Earlier is a smaller id, or the same id and an earlier start; rows without an id come last, as rows of one id. Of places that
    are equal in both, in rows that share an id, the row with the smaller hash is first; but rows equal in id and text have equal
    results. ``spans`` are the removed words as ranges [start, end) counted from 0, ``kept`` is the other words joined by a space.
    A null text is empty; texts of fewer than ``n`` words stay whole. Ids are longs. Other columns are left aside; an empty table
    gives an empty one.
    """
    last = F.lit(2**63 - 1)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("long"), last).alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("bits", F.xxhash64("key", "text").bitwiseAND(F.lit((1 << TIE_BITS) - 1)))
    rows = rows.select("id", "key", "bits", _row(F.col("key"), F.col("bits")).alias("row"), "text")
    whole = _over(n, rows, _documents, "row long, key long, a long, b long").groupBy("a", "b").agg(F.min(F.struct("key", "row")).alias("o"))
    once = _over(n, rows, _symbols, "name long, row long").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).where("n = 1")
    known = whole.select(F.col("o.row").alias("row"), F.lit(None).cast("long").alias("name")).unionByName(once.select("row", "name"))
    # rows meet before lists are made of them, as lists in the making are larger; a list leaves out the null that a first document brings
    known = known.repartition("row").groupBy(F.col("row").alias("r")).agg(F.collect_list("name").alias("once"), F.max(F.col("name").isNull()).alias("first"))
    held = rows.join(known, F.col("row") == F.col("r"), "left").drop("r")
    seen = _over(n, held, _windows, "a long, b long, key long, place long")
    firsts = seen.groupBy("a", "b").agg(F.min(F.struct("key", "place")).alias("o"))
    firsts = firsts.select(_row(F.col("o.key"), F.col("o.place").bitwiseAND(F.lit((1 << TIE_BITS) - 1))).alias("f"), F.shiftright("o.place", TIE_BITS).alias("at"), "a")
    firsts = firsts.repartition("f").groupBy("f").agg(F.collect_list(F.struct("at", "a")).alias("firsts"))
    out = _over(n, held.join(firsts, F.col("row") == F.col("f"), "left").drop("f"), _kept, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    return out.withColumnRenamed("id", id_col)
