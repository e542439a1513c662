"""Edge cases and brute force for the operators without a library to compare with."""

import random
import re
import zlib

import numpy as np

from meshwork.llm import embedding_dedup, exact_dedup, jaccard_join, license_scan, mixing, quality, secret_scan, toxicity, warc
from meshwork.llm.embedding_dedup import near_dedup
from meshwork.llm.queries_native import OP8_SQL, op8_mixing
from meshwork.plans.components import components

TEXTS = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, "x " * 3000), (6, "a b c"), (6, "a b c"), (None, "a b c"), (7, "mit license " + "0" * 40)]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "s" if (i or 0) % 2 else None, "clash", 1) for i, t in rows], "doc_id long, text string, source string, __text string, kept int")


def test_exact_dedup(spark):
    for digest in (exact_dedup._sha256, lambda t: exact_dedup.F.length(t).cast("string")):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark), digest=digest).collect()}
        assert got == {(1, 1, 5, True), (2, 1, 5, False), (6, 1, 5, False), (None, 1, 5, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (7, 7, 1, True)}
    kept = exact_dedup.keep_first(frame(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7] and kept.columns == frame(spark).columns
    assert exact_dedup.exact_dedup(frame(spark, []).limit(0)).count() == 0


def test_mixing(spark):
    df = frame(spark, [(i, "w " * (i % 7 + 1)) for i in range(300)])
    rows = mixing.mix(df).collect()
    assert sorted(rows) == sorted(mixing.mix(df).collect())
    taken: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for t, v in taken.items())
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and sum(len(r.text.split()) for r in out.collect()) == sum(map(sum, taken.values()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_secret_scan(spark):
    rows = [(1, "é password = abcdefgh1 AKIA" + "Z" * 12), (2, "token:short"), (3, None), (4, "f" * 32 + "g" + "0" * 31), (5, "secret:token:abcdefghij"), (None, "ApI_KEY='12345678'")]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_scan.secret_scan(frame(spark, rows)).collect()}
    assert got == {1: [(2, 0, 22), (23, 1, 39)], 2: [], 3: [], 4: [(0, 2, 32)], 5: [], None: [(0, 0, 17)]}
    assert secret_scan.trigram_query("[0-9a-f]+") is None


def test_license_scan(spark):
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, [(1, "The MIT, License mit license\nReleased under the MIT License."), (2, None), (3, "général public")])).collect()}
    assert [(p.label, p.word) for p in got[1].phrases] == [("mit", 1), ("mit", 3), ("mit", 8)] and [b.label for b in got[1].blocks] == ["mit-notice"]
    assert got[2].n_words == 0 and got[3].n_words == 2


def test_license_scan_wrapped_and_long_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mit = "x\n# Permission is hereby granted, free of charge,\n# to any person obtaining a copy of this software"
    gpl = "This work is licensed under the\r\nGNU General Public\r\nLicense, version 3."
    far = " filler ".join(["w " * 40 + w for w in "released under the mit x license".split()])
    rows = [(1, bsd), (2, mit), (3, gpl), (4, far), (5, "w " * 5000 + "released under the mit license " + "w " * 5000), (6, bsd + "\n" + bsd)]
    got = {r.doc_id: [(b.line, b.label, b.containment) for b in r.blocks] for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {1: [(0, "bsd-text", 1.0)], 2: [(1, "mit-text", 1.0)], 3: [(0, "gpl-notice", 1.0)], 4: [], 5: [(0, "mit-notice", 1.0)], 6: [(0, "bsd-text", 1.0), (2, "bsd-text", 1.0)]}


def test_jaccard_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (1, 2, 3, 8, 30, 90, 400)]
    rows = [(None, base[4]), (900, None), (901, "  ")]
    for k in range(120):
        words = base[k % 7].split()
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, len(words)))] = "new"
        rows.append((k, " ".join(words)))
    n, pct = 3, 90
    sets = [(i, {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if (w := re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) else set()) for i, t in rows]
    top = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = top[a], top[b]
                top = [min(p, q) if t in (p, q) else t for t in top]
    name = {t: min([sets[i][0] for i in range(len(sets)) if top[i] == t and sets[i][0] is not None], default=None) for t in set(top)}
    want = sorted((str(sets[i][0]), len(sets[i][1]), str(name[top[i]])) for i in range(len(sets)))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_join(frame(spark, rows), n=n, percent=pct).collect())
    assert got == want


def test_keep_one_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (2, "a text of its own that nothing else is like"), (3, "x y z " + long[:40]), (3, "b c d"), (None, long), (4, ""), (4, None)]
    rows += [(5, "p q r s t " * 9 + "end"), (5, "p q r s t " * 9 + "End"), (6, "p q r s t " * 9 + "end")]
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(frame(spark, rows), n=5, percent=80).collect()]
    gone = sorted(set(rows) - set(kept), key=str)
    assert len(kept) == len(set(kept)) == len(rows) - 3 and gone[0] == rows[1] and gone[1] in rows[8:10] and gone[2] == rows[10]


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, None, 0), (7, [1.0, 0.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 0), (10, [None, 1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[1] == (3, 1, True) and got[9] == (3, 1, False) and got[3] == (3, 1, False) and all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 10))


def test_embeddings_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [1.0, 0.0, 0.0], 0), (4, [0.0, 1.0], 0), (5, [1.0, 0.0, 0.1], 0), (6, [1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3), 6: (0, 6)}


def test_embeddings_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [1.0, 0.05], 0), (1, [0.0, 1.0], 0), (3, [0.1, 1.0], 0), (0, [-1.0, 0.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_links_come_from_the_graph_and_audits_tell_an_empty_one():
    """Links are rare, so planted queries tell what the beams find; of a graph without links they find next to nothing."""
    rng = np.random.default_rng(4)
    x = embedding_dedup._unit(rng.normal(size=(3_000, 32)))
    q = embedding_dedup._unit(np.concatenate([x[:150] + 0.05 * rng.normal(size=(150, 32)), rng.normal(size=(350, 32))]))
    shard, ids, own = embedding_dedup.Hnsw(x), np.arange(3_000), np.arange(10_000, 10_500)
    ef, recall = embedding_dedup.beam_width(shard, ids, q, own, 0.93)
    assert ef is not None and ef <= 256 and recall >= 0.9
    found = [h for part in shard.within(q, 0.93, ef) for h in part]
    truth = [np.flatnonzero(row) for row in q @ x.T >= 0.93]
    assert sum(map(len, truth)) >= 150 and sum(len(np.intersect1d(f, t)) for f, t in zip(found, truth, strict=True)) >= 0.99 * sum(map(len, truth))
    for links in shard.links:
        links[:] = -1
    assert embedding_dedup.beam_width(shard, ids, q, own, 0.93)[0] is None
    out = embedding_dedup._query(shard, ids, np.ones(3_000, int), q, own, 0.93)
    assert out.n[out.v < 0].sum() == sum(map(len, truth))


def test_no_link_below_the_threshold(spark):
    cos = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, [1.0, 0.0], 0), (2, cos(0.93 - 5e-13), 0), (3, [0.0, -1.0], 0), (4, [-1.0, 0.0], 1), (5, [-x for x in cos(0.93 + 5e-13)], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_memory_of_one_large_group_of_near_vectors():
    """One shard of 20,000 vectors that all link: a block of queries holds counts and what is connected, not 40,000,000 links."""
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.normal(size=48) + 0.1 * rng.normal(size=(20_000, 48))
    shard = embedding_dedup.Hnsw(embedding_dedup._unit(x), ef=24)
    tracemalloc.start()
    out = embedding_dedup._query(shard, np.arange(20_000), np.ones(20_000, int), shard.x[:600], np.arange(600), 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out.n[out.v < 0] == (shard.x[:600] @ shard.x.T >= 0.93).sum(1) - 1).mean() > 0.999 and peak < 700e6


def test_embeddings_of_a_label_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 100)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 80)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16))
    x[300:] = x[:100] + 0.1 * rng.normal(size=(100, 16))
    near = embedding_dedup._unit(x) @ embedding_dedup._unit(x).T >= 0.93
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_dedup(df).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(400)} and sum(got.values())


def test_warc_magic_in_payloads(spark):
    m = warc.MAGIC
    fake = m + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", "a" + m), (2, "u", fake), (3, None, m * 3 + "é"), (4, "u", None), (5, "u", "a" + m), (6, "u", fake + fake[:-4])]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {i: (len((h or "").encode()), "revisit" if i == 5 else "response", 1 if i == 5 else None) for i, _, h in rows}


def test_warc_repeated_page_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "bb"), (1, "u", "ccc"), (2, "u", "a"), (3, "u", "bb"), (4, "u", "ccc")]
    got = sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "response", 1), (1, "response", 2), (1, "response", 3), (2, "revisit", 1), (3, "revisit", 2), (4, "revisit", 3)]


def test_warc_loses_no_record_however_files_are_split(spark):
    """Small splits cut records anywhere; another number of cores plans other splits; ids are strings that would break a header."""
    rows = [(f"p>{i}\r\nx: %y é", f"h/{i}", ("a" * (i * 37 % 900) + (warc.MAGIC if i % 2 else "") + "b") * 3) for i in range(60)] + [("", None, "c"), (None, None, "d")]
    path = warc.new_path(spark, "split")
    warc.write_warc(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2), path)
    want = sorted((i or "", len(h.encode())) for i, _, h in rows)
    for split, cores in (("128m", "8"), ("1k", "3"), ("5000", "64")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        try:
            read = warc.read_warc(spark, path)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")  # what is left to run is planned for other cores
            assert sorted((r.id or "", r.payload_bytes) for r in read.collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.85 * len(rows)
    assert toxicity.toxicity(frame(spark), labels.limit(0)).count() == len(TEXTS)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.85 * len(rows)
    assert quality.quality(frame(spark)).count() == len(TEXTS)


def test_quality_training_bound(spark, monkeypatch):
    seen = []
    fit = quality.Linear.fit
    monkeypatch.setattr(quality.Linear, "fit", lambda self, rows, y: seen.append(len(rows)) or fit(self, rows, y))
    df = frame(spark, [(i, f"w{i} " * (i + 1)) for i in range(30)])
    assert quality.quality(df, most=7).count() == 30 and quality.quality(df).count() == 30 and seen == [7, 30]


def test_mixing_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(OP8_SQL).fetchall())
    got = sorted(tuple(r) for r in op8_mixing(spark, sf).select("doc_id", "size", "source_size", "target").collect())
    assert len(got) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) <= 1e-9 * abs(b[3]) for a, b in zip(got, want, strict=True))


def test_license_scan_of_whole_licenses(spark):
    for label, text in license_scan.TEMPLATES[6:]:
        w = text.split()
        wrapped = "\n * ".join(" ".join(w[i : i + 11]).upper() for i in range(0, len(w), 11))
        got = license_scan.license_scan(frame(spark, [(1, "x y z\n" * 50 + wrapped + "\nint main() {}"), (2, " ".join(w[: len(w) // 3]))])).collect()
        assert label in [b.label for b in got[0].blocks] and label not in [b.label for b in got[1].blocks]


def test_embeddings_with_extreme_values_and_odd_labels(spark):
    rows = [(1, [1e200, 1e200], "a"), (2, [1e200, 1.1e200], "a"), (3, [1e-200, 1e-200], "a"), (4, [1e-200, -1e-200], "a"), (5, [2.0], "b,1.0"), (6, [1.0, 2.0], "b")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label string, component_id string, __v int")
    assert near_dedup(empty).count() == 0


def test_beams_of_large_shards_equal_brute_force():
    """Two shards of 10,000 vectors each: recall of the links that the beams find, as audited and as counted over all queries."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 24))
    x[10_000:] = x[:10_000] + 0.12 * rng.normal(size=(10_000, 24))
    x = embedding_dedup._unit(x[rng.permutation(len(x))])
    found = 0
    q = x[:1000]
    truth = int((q @ x.T >= 0.93).sum()) - len(q)
    for ids in np.array_split(np.arange(len(x)), 2):
        shard = embedding_dedup.Hnsw(x[ids])
        out = embedding_dedup._query(shard, ids, np.ones(len(ids), int), q, np.arange(1000), 0.93)
        found += int(out.n[out.v < 0].sum())
    assert truth > 200 and found >= 0.99 * truth


def test_large_groups_of_near_vectors_need_no_wide_beams(monkeypatch):
    """Groups of up to 500 vectors of which about half are within the threshold: links follow the graph, beams stay narrow."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4_000, 64))
    for at, size in ((0, 500), (600, 100), (800, 30)):
        x[at : at + size] = x[at] + rng.uniform(0.15, 0.35, size=(size, 1)) * rng.normal(size=(size, 64))
    x = embedding_dedup._unit(x[rng.permutation(len(x))])
    shard, widths, beam = embedding_dedup.Hnsw(x), [], embedding_dedup.Hnsw._beam
    monkeypatch.setattr(embedding_dedup.Hnsw, "_beam", lambda self, q, level, entries, ef, limit: widths.append(ef) or beam(self, q, level, entries, ef, limit))
    near = x @ x.T >= 0.93
    out = embedding_dedup._query(shard, np.arange(4_000), np.ones(4_000, int), x, np.arange(4_000), 0.93)
    links = out[out.v < 0].sort_values("u").n.to_numpy()
    truth = near.sum(1) - 1
    assert truth.max() > 100 and (links <= truth).all() and links.sum() >= 0.999 * truth.sum() and max(widths) <= 64


def test_secret_scan_of_long_texts(spark):
    import time

    rows = [(1, "z" * 400_000 + " http://x"), (2, "y" * 300_000 + "://u:passw@h"), (3, "eyJ" * 100_000), (3, None), (3, "password=abcdefgh " * 2000)]
    began = time.time()
    got = sorted((r.doc_id, len(r.spans)) for r in secret_scan.secret_scan(frame(spark, rows)).collect())
    assert got == [(1, 0), (2, 1), (3, 0), (3, 0), (3, 2000)] and time.time() - began < 60
    assert secret_scan.secret_scan(frame(spark, []).limit(0)).count() == 0


def blocks_by_hand(found, template):
    """(first place, containment) over every window of at most ``span`` words; of overlapping ones the fullest, then the first."""
    hits, wanted = [], set(template.ordered)
    for end in range(len(found)):
        if found[end] in wanted:
            held = [(len(wanted.intersection(found[start : end + 1])), start) for start in range(max(0, end - template.span + 1), end + 1)]
            n, start = max(held)  # of the fullest the shortest
            if n >= template.need:
                hits.append((-n, start, end))
    kept = []
    for n, start, end in sorted(hits):
        if all(end < a or b < start for a, b, _ in kept):
            kept.append((start, end, -n / len(template.ordered)))
    return [(start, c) for start, _, c in kept]


def test_license_scan_equals_brute_force(spark):
    """Windows of random words, of which some repeat in a template; frequencies that put each word first in some order."""
    rng = random.Random(5)
    templates = (("a", "b c d e f g h i j k"), ("b", "c c d x y"), ("c", "b q"), ("d", "b c d e f g h i j k l m n o p q r s t u"))
    rows = [(i, " ".join(rng.choice("bcdefghijklmnopqrstuxyz" + "-" * (i % 17)) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    for threshold, spread in ((0.8, 2.0), (0.5, 1.0), (1.0, 4.0)):
        for _ in range(3):
            frequency = {w.encode(): rng.randint(0, 5) for w in "bcdefghijklmnopqrstuxyz"}
            ready = license_scan.compile_templates(templates, frequency, threshold, spread)
            matcher, some = license_scan.Matcher(ready), 0
            for _, text in rows:
                found = license_scan.words(text.replace("-", "other"))
                want = sorted((start, k, c) for k, x in enumerate(ready) for start, c in blocks_by_hand(found, x))
                assert matcher.windows(found) == want
                some += len(want)
            assert some > 0
    got = {r.doc_id: sorted((b.label, b.containment) for b in r.blocks) for r in license_scan.license_scan(frame(spark, rows + rows[:5]), templates=templates).collect()}
    ready = license_scan.compile_templates(templates, license_scan.token_frequency(frame(spark, rows + rows[:5]), {t for _, x in templates for t in license_scan.words(x)}), 0.8)
    assert got == {i: sorted((x.label, c) for x in ready for _, c in blocks_by_hand(license_scan.words(t), x)) for i, t in rows}


def spans_by_hand(text):
    """(start, kind, end) by Python's regex engine, with the plain forms of the rules that look around."""
    plain = {"jwt": r"[A-Za-z0-9_-]*?eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "url": r"[0-9+.-]*[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]{3,}@", "hex": r"[0-9a-f]+"}
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        found += [(m.start(), k, m.end()) for m in re.finditer(plain.get(rule.kind, rule.regex), text) if len(m.group(rule.group)) >= rule.least]
    return sorted(found)


def test_secret_scan_equals_brute_force(spark):
    """Pieces that begin, break or prolong every rule, in random order; headers and schemes of any length."""
    rng = random.Random(11)
    pieces = ["eyJ", "eyJ" + "a" * 12, ".", "eyJ" + "B" * 1000, "_" * 10, "://", "http", "9+z", "u:passw@", "@", ":", "/", " ", "é", "s" * 100, "AKIA" + "Q" * 13, "token=", "abcdefgh", "0f" * 17, "ghp_" + "x" * 36, "xoxb-" + "1" * 9, "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [(600, "eyJ" + "h" * 1000 + ".eyJ" + "p" * 1000 + "." + "s" * 50), (601, "x" * 500 + "://u:passw@h"), (602, "tokeneyJ" + "h" * 10 + ".eyJ" + "p" * 10 + "." + "s" * 10)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.secret_scan(frame(spark, rows)).collect()}
    assert got == {i: spans_by_hand(t) for i, t in rows}
    assert {k for s in got.values() for _, k, _ in s} == set(range(len(secret_scan.RULES))) and [len(got[i]) for i in (600, 601, 602)] == [1, 1, 1]


def test_secret_scan_of_many_secrets_in_one_text(spark):
    text = "password=abcdefgh " * 100_000
    (row,) = secret_scan.secret_scan(frame(spark, [(1, text)])).collect()
    assert [tuple(s) for s in row.spans] == [(18 * i, 0, 18 * i + 17) for i in range(100_000)]
    sums = spark.range(70).select(secret_scan.F.col("id").cast("int").alias("n")).select("n", secret_scan.running_sums(secret_scan.F.expr("transform(sequence(0, n), x -> x * 3 + 1)")).alias("s"))
    assert all(r.s == [sum(3 * j + 1 for j in range(i + 1)) for i in range(r.n + 1)] for r in sums.collect())


def test_mixing_equals_brute_force(spark):
    """taken, from the random keys that Spark gives: each source's line of words is cut at its budget, epoch by epoch."""
    from pyspark.sql import functions as F

    rows = [(i % 50 if i % 9 else None, "w " * (i * 7 % 23)) for i in range(400)] + [(3, "same"), (3, "same"), (None, None)]
    df = spark.createDataFrame([(i, t, ["a", "b", "c", None][k % 4]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    keyed = df.select("*", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")), 2).alias("key"), F.xxhash64("text").alias("tie")).collect()
    size = lambda t: len((t or "").split())
    budget = {r.source: int(r.target + 0.5) for r in mixing.mix(df, carry=True).select("row.source", "target").distinct().collect()}
    want = []
    for s in ("a", "b", "c", None):
        of = sorted((r for r in keyed if r.source == s), key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0, size(r.text), r.tie))
        total = sum(size(r.text) for r in of)
        epochs, left = divmod(budget[s], total)
        for r in of:
            part = min(size(r.text), left)
            left -= part
            want.append((str(r.doc_id), size(r.text), epochs * size(r.text) + part))
    got = [(str(r.doc_id), r["size"], r.taken) for r in mixing.mix(df, bucket_rows=16).collect()]
    assert sorted(got) == sorted(want)


def test_trees_and_isotonic_equal_brute_force():
    rng = np.random.default_rng(2)
    x, noise = np.round(rng.random((300, 3)), 2), rng.random(300)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * noise > 0.8).astype(int)
    trees = toxicity.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    g, h = np.full(300, p) - y, np.full(300, p * (1 - p))
    best = max(
        (g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1), f, c)
        for f in range(3) for c in trees.edges[f] for m in [x[:, f] <= c] if h[m].sum() >= 1 and h[~m].sum() >= 1
    )
    root = trees.trees[0][0]
    m = x[:, root[0]] <= root[1]
    assert abs(g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1) - best[0]) < 1e-9
    s = trees.score(x)
    assert np.allclose(s[m], trees.base - 0.15 * g[m].sum() / (h[m].sum() + 1)) and np.allclose(s[~m], trees.base - 0.15 * g[~m].sum() / (h[~m].sum() + 1))
    full = toxicity.Trees().fit(x, y).score(x)
    iso = toxicity.Isotonic().fit(full, y.astype(float))(np.sort(full))
    assert (np.diff(iso) >= -1e-12).all() and abs(iso.mean() - p) < 0.05 and ((full > 0) == (y == 1)).mean() > 0.95


def test_em_recovers_known_accuracies():
    rng = np.random.default_rng(6)
    good = rng.random(20_000) < 0.7
    accuracy = np.array([0.9, 0.8, 0.75, 0.85])
    right = rng.random((len(good), 4)) < accuracy
    votes = np.where(right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.1] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prob, prior, post = quality.em(patterns, counts)
    assert abs(prior - 0.7) < 0.03 and np.allclose(prob[1, :, 1], accuracy, atol=0.03) and np.allclose(prob[0, :, 0], accuracy, atol=0.05)
    # posteriors by Bayes, pattern by pattern
    for v, q in zip(patterns, post, strict=True):
        one = prior * np.prod([prob[1, i, a] for i, a in enumerate(v) if a >= 0])
        none = (1 - prior) * np.prod([prob[0, i, a] for i, a in enumerate(v) if a >= 0])
        assert abs(one / (one + none) - q) < 1e-3


def test_toxicity_of_few_and_odd_rows(spark):
    docs = frame(spark, [(i, "you are a grumblefoot " * 3 if i % 2 else "a calm day in the park") for i in range(40)] + [(None, None), (7, ""), (8, "w " * 200_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels, most=12).collect()
    assert len(rows) == 43 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    few = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, few).collect()} == {1.0}


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """Near copies that mostly don't link with each other: exact components, and far fewer comparisons than pairs."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 150))] = f"e{rng.integers(0, 40)}"
        rows.append((k, " ".join(w)))
    for n, percent in ((3, 90), (5, 80)):
        sets = [{tuple(t.split()[i : i + n]) for i in range(151 - n)} for _, t in rows]
        top = list(range(len(rows)))

        def find(a, top=top):
            while top[a] != a:
                a = top[a]
            return a

        for a in range(len(rows)):
            for b in range(a):
                m = len(sets[a] & sets[b])
                if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(frame(spark, rows), n=n, percent=percent).collect()}
        assert got == {i: find(i) for i in range(len(rows))}
    assert jaccard_join.jaccard_join(frame(spark, []).limit(0)).count() == 0


def test_near_copies_far_from_their_pivot_meet_few_times(spark, monkeypatch):
    """The group's pivot shares nothing with the copies, whose edits differ; a copy with many edits links with few others."""
    rng, n, percent = random.Random(5), 240, 80
    sets = [set(range(-100, 0))]
    for i in range(n):
        e = rng.randint(3, 9)
        sets.append(set(rng.sample(range(100), 100 - e)) | {1000 + 100 * i + j for j in range(e - 2)} | set(rng.sample(range(100, 140), 2)))
    top, found = list(range(n + 1)), 0

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(n + 1):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                found += 1
                top[max(find(a), find(b))] = min(find(a), find(b))
    rows = []
    for i, s in enumerate(sets):
        delta = sorted(s ^ sets[0])
        rows.append((0, n + 1, (i, i), (0, 0), len(s), 100, len(delta), i == 0, delta, i))
    node = "struct<class:bigint,check:bigint>"
    diffs = spark.createDataFrame(rows, f"group long, m long, node {node}, pivot {node}, size long, psize long, a long, linked boolean, delta array<long>, num long")
    compared, links = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *rest: compared.append(pairs.count()) or links(pairs, *rest))
    pairs = jaccard_join.linked_pairs(diffs, percent)
    got = {r.node[0]: r.component[0] for r in jaccard_join.components(pairs).collect()}
    assert found > 10 * n and [got.get(i, i) for i in range(n + 1)] == [find(i) for i in range(n + 1)]
    assert sum(compared) < 10 * n and pairs.count() < 10 * n


def test_few_pairs_are_settled_in_one_task(spark, monkeypatch):
    """The same components as the rounds find, and no rounds in a join of few pairs, where each shuffle has its fixed cost."""
    rng = random.Random(3)
    ends = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (900, 900)]
    longs = spark.createDataFrame(ends, "u long, v long")
    pairs = longs.selectExpr("struct(u div 100 AS class, u AS check) AS u", "struct(v div 100 AS class, v AS check) AS v")
    several = {few: [sorted(map(tuple, components(df, few).collect())) for df in (longs, pairs)] for few in (0, 100, 10_000)}
    assert several[0] == several[100] == several[10_000] and len({c for _, c in several[0][0]}) > 10
    monkeypatch.setattr("meshwork.plans.components._star", lambda *_: 1 / 0)
    for none in (longs.limit(0), pairs.limit(0), longs.where("u = v")):
        assert components(none, 10_000).count() == 0
    rows = [(k, " ".join([f"w{k // 10}x{i}" for i in range(99 - k % 10)])) for k in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(frame(spark, rows), n=3, percent=80).collect()}
    assert got == {k: k // 10 * 10 for k in range(40)}


def test_warc_of_several_files_nulls_and_long_pages(spark):
    long = "<p>" + "é" * 3_000_000 + warc.MAGIC + "x" * 100
    rows = [(i, None if i % 3 else f"http://h/{i}", [None, "", "same", f"own {i}"][i % 4]) for i in range(60)] + [(100, "u", long), (101, "u", long), (None, "u", "same"), (None, None, "alone")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in (100, 101):
            assert r.payload_bytes == len(long.encode()) and r.refers_to == (100 if r.page_id == 101 else None)
        elif r.page_id is not None and r.page_id % 4 == 2:
            assert r.payload_bytes == 4 and r.refers_to == (None if r.page_id == 2 else 2)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
