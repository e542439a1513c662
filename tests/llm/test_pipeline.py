"""The pipeline stage by stage over a small table, against brute force."""

import re

import corpus_pipeline
from meshwork.llm import exact_dedup

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__text", exact_dedup.F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding and decoding"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = docs.collect()
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    right = [(r.doc_id in kept) == (labels[r.doc_id] == 0) for r in rows if r.doc_id in labels]
    assert sum(right) >= 0.8 * len(right)

    one = stages["exact dedup"](spark, docs, SF).collect()
    norm = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in one} == set(norm.values())

    sets = {r.doc_id: _shingles(r.text) for r in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                m = len(sets[a] & sets[b])
                if 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    near = stages["n-gram Jaccard join"](spark, docs, SF).collect()
    assert {r.doc_id for r in near} == {find(i) for i in ids}

    mixed = stages["mixing sources"](spark, docs, SF)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r.text) for r in rows)
    taken = sum(words(r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and abs(taken - total) <= 10
    out = stages["BPE encoding and decoding"](spark, docs, SF).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run_on_odd_documents(spark, tmp_path):
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, None, None), (3, "", "s"), (None, "x y", "t"), (None, None, None), (4, "w " * 60_000, "s"), (5, "a b c d e f g", "t")]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 0), (4, 0)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} >= {1, 4, None} and 5 not in {r.doc_id for r in out}
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{d}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{d}/none").count() == 0


def test_stages_with_clashing_names(spark):
    """Columns named as the stages' own helpers come through as they are, and decide nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = {c: exact_dedup.F.lit("clash") for c in ("__score", "__score_", "__kid", "__ksha", "__sha", "__id", "__row")}
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "exact dedup"):
        plain, odd = stages[name](spark, docs, SF), stages[name](spark, docs.withColumns(clash), SF)
        assert odd.columns == [*docs.columns, *clash]
        rows = odd.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect()) and all(r[c] == "clash" for r in rows for c in clash)
