"""Byte-level BPE encoding and decoding with a given public vocabulary; nothing is trained.

A text is cut into words by the vocabulary's splitting pattern. Inside a word the symbols form a doubly linked list and
a priority queue holds the rank of each adjacent pair; the lowest rank merges first, leftmost on ties. Entries whose
symbols have changed since they were queued are stale and skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from meshwork.plans.workers import trimmed

#: The splitting pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
JOINED_SPACE = re.compile(r"\s (?!\S)")
PLACE = (1 << 32) - 1
RANK, DEAD = PLACE << 32, 1 << 63  #: a rank's bits, and the mark of a pair that doesn't merge
CACHE_WORDS, CACHE_CHARS = 400_000, 48  #: words kept per process, and the longest word kept: bounds memory only
SLICE_BYTES = 4 << 20  #: text encoded before its rows are handed on


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library, model BPE, byte level)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = [vocab[c] for c in symbols]
        self.byte_words = [array("i", [i]).tobytes() for i in self.byte_ids]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self.first_pairs = [self.merges.get(a << 32 | b, DEAD) for a in self.byte_ids for b in self.byte_ids]
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}  # words that no space starts

    def encode_word(self, word: str) -> bytes:
        """Ids as packed 32-bit integers. ``pair[i]`` is rank << 32 | merged id of the symbol at i and its successor, DEAD if they don't merge.

        A queue entry is rank << 32 | place; it is stale unless the pair at its place still has its rank.
        """
        data = word.encode("utf-8", "surrogatepass")
        ids = list(map(self.byte_ids.__getitem__, data))
        first = self.first_pairs
        pair = [first[a << 8 | b] for a, b in zip(data, data[1:])]
        pair.append(DEAD)
        queue = [m & RANK | i for i, m in enumerate(pair) if m != DEAD]
        if not queue:
            return array("i", ids).tobytes()
        heapq.heapify(queue)
        pop, push, merge, n = heapq.heappop, heapq.heappush, self.merges.get, len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            i = entry & PLACE
            m = pair[i]
            if m ^ entry > PLACE:
                continue  # stale: the symbol is gone, or one of the two has merged since
            ids[i] = merged = m & PLACE
            j = nxt[i]
            ids[j], pair[j] = -1, DEAD
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                pair[i] = m = merge(merged << 32 | ids[k], DEAD)
                if m != DEAD:
                    push(queue, m & RANK | i)
            else:
                pair[i] = DEAD
            p = prev[i]
            if p >= 0:
                pair[p] = m = merge(ids[p] << 32 | merged, DEAD)
                if m != DEAD:
                    push(queue, m & RANK | p)
        return array("i", [x for x in ids if x >= 0]).tobytes()

    def _keep(self, key: str, ids: bytes) -> bytes:
        """Two generations of kept words: a full young one becomes the old one, so common words stay."""
        if len(key) <= CACHE_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old = self.young
                self.young = {}
            self.young[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word of the pattern, from the kept ones if it is there."""
        if word[0] == " " and len(word) > 1:
            chunk = word[1:]
            return self.young.get(chunk) or (self._chunk(chunk) if chunk.isalpha() else self.encode_word(word))
        ids = self.plain.get(word)
        if ids is None:
            ids = self.encode_word(word)
            if len(word) <= CACHE_CHARS:
                if len(self.plain) >= CACHE_WORDS // 4:
                    self.plain.clear()
                self.plain[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space followed by ``chunk``, which holds no space."""
        ids = self.old.get(chunk)
        if ids is not None:
            return self._keep(chunk, ids)
        if chunk.isalpha():
            return self._keep(chunk, self.encode_word(" " + chunk))
        head, last = chunk[:-1], chunk[-1:]
        if last and last in ".,;:!?" and head.isalpha():
            return (self.young.get(head) or self._chunk(head)) + self.byte_words[ord(last)]
        return b"".join(map(self._word, self.find(" " + chunk)))

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text, packed; strings of added tokens in the text become their ids.

        No word of the pattern reaches over a space that starts it, so a text is cut at its spaces first and the chunks
        are looked up; only a space with white space before it and none but white space after it would join a longer run.
        """
        out: list[bytes] = []
        for part in self.split_added.split(text) if self.split_added and any(s in text for s in self.added) else (text,):
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
            elif JOINED_SPACE.search(part):
                out.extend(map(self._word, self.find(part)))
            else:
                first, *rest = part.split(" ")
                out.extend(map(self._word, self.find(first)))
                chunk = self._chunk
                for at in range(0, len(rest), 4096):  # the young generation may change
                    get = self.young.get
                    out.extend([get(c) or chunk(c) for c in rest[at : at + 4096]])
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_packed(text or "")).tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become U+FFFD."""
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _codec(vocabulary: bytes) -> Codec:
    return Codec(vocabulary)


def load(path: str) -> bytes:
    """A vocabulary file as read on the driver (a few MB, a fixed size); it travels to executors with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[int, int]]:
    size, start = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= SLICE_BYTES:
            yield start, i + 1 - start
            size, start = 0, i + 1
    if start < len(texts):
        yield start, len(texts) - start


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int; an array already so named is replaced).

    Null and empty texts have no ids. Texts of any length are encoded whole. An empty table gives an empty table.
    """
    docs = docs.drop(ids_col)
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))  # a few MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the kept words hold no cycles, and walking over them is slow
        try:
            codec = _codec(shared.value)
            for batch in batches:
                for start, n in _slices(batch, batch.column(text_col)):
                    part = batch.slice(start, n)
                    ids = [codec.encode_packed(t) if t else b"" for t in part.column(text_col).to_pylist()]
                    ends = array("i", itertools.accumulate((len(x) // 4 for x in ids), initial=0))
                    plain = lambda b: pa.Array.from_buffers(pa.int32(), len(b) // 4, [None, pa.py_buffer(b)])
                    column = pa.ListArray.from_arrays(plain(ends.tobytes()), plain(b"".join(ids)))
                    yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids_col])
        finally:
            gc.enable()  # the worker runs other tasks later

    return docs.mapInArrow(trimmed(run), _schema(docs, ids_col, "array<int>"))


def decode(rows: DataFrame, vocabulary_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with a column of decoded text; null and empty ids decode to the empty text."""
    rows = rows.drop(text_col)
    shared = rows.sparkSession.sparkContext.broadcast(load(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(_codec(shared.value).strings, pa.large_binary())
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(part.column(ids_col), strings)], [*part.schema.names, text_col])

    return rows.mapInArrow(trimmed(run), _schema(rows, text_col, "string"))


def decoded(lists: pa.ListArray, strings: pa.LargeBinaryArray) -> pa.StringArray:
    """Texts of lists of ids: the vocabulary strings of all lists side by side, cut where the lists end."""
    data = strings.take(lists.flatten())  # flatten leaves out null lists
    bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(bounds[ends])), data.buffers()[2]])
    try:
        return texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # some bytes are no UTF-8
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _schema(df: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*df.schema.fields]).add(name, _parse_datatype_string(kind))


def digest(ids) -> str:
    """Hex SHA-256 of decimal ids joined by commas."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
