"""License scans: exact set-similarity join of text blocks (windows of words) with license templates.

Blocks are windows over the word sequence of the whole text, so a notice may be wrapped over lines, and a long line is no
block of its own. Tokens are ordered by how often the whole corpus holds them, rarest first. A block that contains at least
``threshold`` of a template's distinct tokens must hold one of the template's prefix tokens, its |T| - need + 1 rarest ones.
Each place of a prefix token is a seed, taken as the rarest of the template's tokens in its block (a block with a rarer one
has that one's seed): the block lies within a window's length on either side, and holds no token of the template that comes
before the seed's in the order. Fewer than ``need`` places there (length), or fewer than ``need`` distinct tokens from the
seed's position in the order on (position), and the seed is dropped; blocks are counted only where seeds remain.
The templates are a fixed library, so they, not the corpus, are what every task holds.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed values of the contract).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wordings of license notices and of whole licenses, by label (fixed values).
TEMPLATES = (
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "mit-whole",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
        "do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or "
        "implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
        "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd-2-whole",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution this software is provided "
        "by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
        "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
        "to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
        "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of "
        "the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc-whole",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
    ),
    (
        "apache-2-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
        "may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
)
THRESHOLD = 0.8
#: A window holds at most this many times the template's words.
SPREAD = 2.0

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BLOCKS = bytes(10 if c == 10 else _WORDS[c] for c in range(256))


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; runs of digits, a-z and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    ordered: tuple[bytes, ...]  #: distinct tokens, rarest in the corpus first
    need: int
    span: int  #: most words of a window

    @property
    def rank(self) -> dict[bytes, int]:
        """Position of each token in the order."""
        return {t: i for i, t in enumerate(self.ordered)}

    @property
    def prefix(self) -> int:
        """Tokens from this position on are too few for a window that holds none before it."""
        return len(self.ordered) - self.need + 1


def compile_templates(templates, frequency: dict[bytes, int], threshold: float, spread: float = SPREAD) -> list[Template]:
    out = []
    for label, text in templates:
        tokens = sorted(set(words(text)), key=lambda t: (frequency.get(t, 0), t))
        out.append(Template(label, tuple(tokens), max(1, math.ceil(threshold * len(tokens) - 1e-9)), math.ceil(spread * len(words(text)))))
    return out


class Matcher:
    def __init__(self, templates: list[Template]):
        self.index = {t for x in templates for t in x.ordered[: x.prefix]}
        self.holders: dict[bytes, list[tuple[int, int]]] = {}
        for k, x in enumerate(templates):
            for t, r in x.rank.items():
                self.holders.setdefault(t, []).append((k, r))
        self.templates = templates

    def windows(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        """(place of the first shared word, template, containment) of the windows that reach a template's threshold.

        For each end, the shortest window of at most ``span`` words that holds as many of the template's tokens as any such
        window; of overlapping ones the fullest, then the first, stays.
        """
        if self.index.isdisjoint(found):
            return []
        at: dict[int, tuple[list[int], list[int]]] = {}
        for i, t in enumerate(found):
            for k, r in self.holders.get(t, ()):
                places, ranks = at.setdefault(k, ([], []))
                places.append(i)
                ranks.append(r)
        out = []
        for k, (places, ranks) in at.items():
            x = self.templates[k]
            hits = [h for low, high in _reaches(x, places, ranks) for h in _full_windows(x, places[low:high], ranks[low:high])]
            kept: list[tuple[int, int]] = []
            for n, start, end in sorted(hits):
                j = bisect_left(kept, (start, end))
                if (j == 0 or kept[j - 1][1] < start) and (j == len(kept) or kept[j][0] > end):
                    kept.insert(j, (start, end))
                    out.append((start, k, -n / len(x.ordered)))
        return sorted(out)

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[int, str, float]]]:
        found = words(text)
        line = b" " + b" ".join(found) + b" "
        places = []
        for phrase, label in PHRASES:
            needle = b" " + phrase.encode() + b" "
            at = line.find(needle)
            while at >= 0:
                places.append((label, line.count(b" ", 0, at)))
                at = line.find(needle, at + 1)
        blocks = []
        if hits := self.windows(found):
            ends = list(accumulate(len(raw.split()) for raw in text.encode("utf-8", "surrogatepass").translate(_BLOCKS).split(b"\n")))
            blocks = sorted((bisect_right(ends, i), self.templates[k].label, c) for i, k, c in hits)
        return len(found), sorted(places, key=lambda p: (p[1], p[0])), blocks


def _reaches(x: Template, places: list[int], ranks: list[int]) -> list[tuple[int, int]]:
    """Stretches of ``places`` in which every window that reaches the threshold lies: the joined reaches of seeds that stay."""
    out: list[tuple[int, int]] = []
    low = high = 0
    for i, r in enumerate(ranks):
        while places[i] - places[low] >= x.span:
            low += 1
        while high < len(places) and places[high] - places[i] < x.span:
            high += 1
        if r >= x.prefix or high - low < x.need or (out and high <= out[-1][1]):
            continue  # no seed, too few places, or all of its reach is counted already
        if len({q for q in ranks[low:high] if q >= r}) < x.need:
            continue
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _full_windows(x: Template, places: list[int], ranks: list[int]) -> list[tuple[int, int, int]]:
    """(-tokens held, first place, last place) by end, for the shortest window with the most tokens, if they are enough."""
    held: Counter = Counter()
    low, hits = 0, []
    for i, r in zip(places, ranks):
        held[r] += 1
        while i - places[low] >= x.span or held[ranks[low]] > 1:
            held[ranks[low]] -= 1
            if not held[ranks[low]]:
                del held[ranks[low]]
            low += 1
        if len(held) >= x.need:
            hits.append((-len(held), places[low], i))
    return hits


def token_frequency(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often the whole corpus holds each token of the vocabulary (the templates' tokens, a fixed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(filter(vocabulary.__contains__, words(text)))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([total[k] for k in keys], pa.int64())], ["token", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}


RESULT = "n_words long, phrases array<struct<label:string,word:long>>, blocks array<struct<line:int,label:string,containment:double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, spread: float = SPREAD) -> DataFrame:
    """One row per row: id, n_words, phrases (label, place in words) and blocks (line, label, containment).

    A block is a window over the words of the whole text, across line breaks, of at most ``spread`` times the template's words;
    its line is that of its first shared word. Blocks of one template don't overlap.
    Null and empty texts have no words. Whole texts are scanned, whatever their length. Repeated rows give repeated results;
    an empty table an empty result. Only the two named columns are read, so other names cannot clash.
    """
    vocabulary = {t for _, x in templates for t in words(x)}
    ready = compile_templates(templates, token_frequency(docs, vocabulary, text_col), threshold, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(ready)
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                got = [matcher.scan(t or "") for t in part.column(1).to_pylist()]
                phrases = pa.array([[{"label": a, "word": b} for a, b in g[1]] for g in got], pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])))
                blocks = pa.array([[{"line": a, "label": b, "containment": c} for a, b, c in g[2]] for g in got], pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), phrases, blocks], [part.schema.names[0], "n_words", "phrases", "blocks"])

    thin = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = thin.schema["__id"].dataType.simpleString()
    return thin.mapInArrow(run, f"__id {kind}, {RESULT}").withColumnRenamed("__id", id_col)
