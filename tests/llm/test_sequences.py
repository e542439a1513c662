"""Tries, repeated windows and cuts of texts: the queries and odd rows against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from meshwork.llm import fim, prefix_trie, recompression, substring_dedup

SPACES = r"[\x20\x09-\x0D]"
TOKEN = re.compile(rf"{SPACES}*[^\x20\x09-\x0D]+|{SPACES}+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# conversation prefix trie


def trie_rows(turns: list[tuple], family: int = 5, most: int = 9) -> list[tuple]:
    """Brute force over rows (conv_id, turn, role, text)."""
    own: dict = {}
    for c, t, role, text in sorted((r for r in turns if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    nodes: dict = {}
    ends: dict = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        path = tuple(own.get(c - int(np.fmod(c, family)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in nodes.items()
    )


def trie_of(spark, turns: list[tuple], **kw) -> list[tuple]:
    df = spark.createDataFrame([(*t, "clash", 7, 8) for t in turns], "conv_id long, turn long, role string, text string, conv string, d int, part int")
    got = prefix_trie.prefix_trie(df, **kw)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())


def test_trie_of_odd_rows(spark):
    assert trie_of(spark, []) == []
    odd = [
        (None, 0, "user", "nobody's"), (1, None, None, None), (1, None, "", ""), (1, 3, "user", "é" * 50_000), (1, 3, "user", "b"), (1, 3, "assistant", "z"), (5, 0, "user", "hello"), (5, 1, "a" * 70, "x"),
        (5, 1, "a" * 64, "y"), (6, 0, "user", "own"), (7, 9, "user", "late"), (-3, 0, "user", "hello"), (0, 0, "user", "hello"), (0, 0, "user", "hello"), (0, 1, None, "hello"),
    ]
    assert trie_of(spark, odd) == trie_rows(odd)


def test_trie_of_hot_prefixes_and_long_conversations(spark, monkeypatch):
    """A first turn that a third shares, whole copies, one conversation of a third of all turns, stretches of a few turns."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rng = random.Random(3)
    turns = []
    for c in range(400):
        if c % 3 == 0:
            turns += [(c, t, "user", f"copy {t}") for t in range(6)]
        else:
            turns += [(c, t, rng.choice("ua"), "hi" if t == 0 and c % 3 == 1 else rng.choice("xyz") * rng.randint(1, 3)) for t in range(rng.randint(1, 9))]
    turns += [(77, t, "user", rng.choice("pq")) for t in range(10, 1300)]
    rng.shuffle(turns)
    assert trie_of(spark, turns) == trie_rows(turns)


# substring dedup


def left_of(rows: list[tuple], n: int) -> dict:
    """Brute force: id to (n_words, n_removed, kept); ids differ, none is null."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words):
        for s in range(len(words[i]) - n + 1):
            w = tuple(words[i][s : s + n])
            if w in seen:
                gone[i].update(range(s, s + n))
            seen.add(w)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in words.items()}


def dedup_of(spark, rows: list[tuple], n: int, parts: int = 3) -> list:
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id long, text string, row string, first int, once string").repartition(parts)
    return substring_dedup.substring_dedup(df, n=n).collect()


def test_substring_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 3000)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "same " * 3000), (6, "a b " * 500), (7, "a b c " * 300), (8, " ".join(passage)), (9, "\x0b".join(passage)), (10, "x " + "  ".join(passage) + "\r\ny é")]
    for i in range(11, 130):
        text = rng.choices([f"w{k}" for k in range(40 if i % 2 else 4)], k=rng.randint(0, 90))
        at, cut = rng.randint(0, len(text)), rng.randint(0, 40)
        rows.append((i, rng.choice([" ", "\n"]).join(text[:at] + passage[cut : cut + rng.randint(0, 40)] + text[at:])))
    rows += [(1000 - i, t) for i, t in rows[20:50]]
    for n in (5, 20):
        got = dedup_of(spark, rows, n)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == left_of(rows, n)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_of_odd_rows(spark):
    assert dedup_of(spark, [], 3) == []
    # equal rows have equal results; rows without an id come last; of rows that share an id the earlier start is first
    got = dedup_of(spark, [(None, "a b c d"), (2, "z a b c"), (2, "z a b c"), (3, "a b c d"), (4, "q r s t"), (4, "x q r s")], 3)
    assert sorted((r.doc_id or 99, r.kept) for r in got) == [(2, "z a b c"), (2, "z a b c"), (3, "d"), (4, "q r s t"), (4, "x"), (99, "")]


def test_equal_windows_have_equal_symbols():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000).astype(np.uint64)
    words[500:700], words[2000:2200], words[3000:3100] = words[1500:1700], 7, words[2150:2250]
    doc = np.repeat(np.arange(8), 500)
    s = recompression.recompress(words, doc)
    assert (s.lo[1:] == s.hi[:-1]).all() and (np.diff(s.first) >= 0).all() and (np.diff(s.last) >= 0).all()
    starts = np.flatnonzero(doc[:-19] == doc[19:])
    best = recompression.anchors(s, starts, 20)
    of: dict = {}
    for a, b in zip(starts.tolist(), best.tolist(), strict=True):
        told = (-1, 0) if b < 0 else (int(s.name[b]), int(s.lo[b]) - a)
        assert of.setdefault(tuple(words[a : a + 20].tolist()), told) == told
    assert (best >= 0).mean() > 0.3


def test_words_have_one_name_wherever_they_stand():
    texts = ["né a  b", "", "b né", " ", "a" * 5000 + "\tb"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    names, doc = recompression.split_words(data, offsets)
    assert doc.tolist() == [0, 0, 0, 2, 2, 4, 4] and names[0] == names[4] and names[2] == names[3] == names[6] and len(set(names.tolist())) == 4


# fill in the middle


def cut_of(i, text: str, plan: fim.Plan) -> tuple:
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.rate:
        return (n, "plain", None, None, text)
    form = "spm" if h4 % 100 < plan.spm_rate else "psm"
    return (n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \t "), (4, "<P> a"), (4, "<P> a"), (5, "é" * 200_000 + " x" * 1000), (6, "\x00 \x85 a \U0001f600b"), (7, "<p> <S"), (8, "x<M>")]
    rows += [(i, "".join(rng.choices(" \n\x0bab\U0001f600é ", k=rng.randint(0, 60)))) for i in range(9, 300)]
    for plan in (fim.Plan(), fim.Plan(seed=7, rate=100, spm_rate=30)):
        df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n int, id string")
        got = fim.fill_in_middle(df, plan).collect()
        key = lambda x: (x[0] is None, x)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *cut_of(i, t or "", plan)) for i, t in rows), key=key)
        assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, t or "") for i, t in rows)
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c", "d" * 9])
    assert [*fim.slices(texts, 12)] == [(0, 3), (3, 1), (4, 2)] and [*fim.slices(pa.array([], pa.string()), 5)] == []
