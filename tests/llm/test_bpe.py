import gc
import hashlib
import random

import pyarrow as pa

from meshwork.llm import bpe
from meshwork.llm.queries_text import op2_bpe, vocabulary

HARD = [
    "", "a", "  a  b", "it's we'll I'D", "\n\n x\t\ty \r\n", "é" * 50, "日本語 текст ١٢٣", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endof",
    "x" * 5000, "ab" * 3000, "   　x\x1c\x1d\x85", "🙂👩‍👩‍👧", "\x00\x01", " ", "   ", "1234567 12.5e3", "naïvé", "aaa aaaa aaaaa" * 50,
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_codec_equals_the_library_on_hard_texts():
    codec, tok = bpe.Codec(bpe.load(vocabulary())), library()
    rng = random.Random(5)
    chars = "ab cé\n\t'sléd01<|>%$🙂 日 "
    texts = HARD + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" + chr(c) + " " + chr(c) + "b" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for text, enc in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text) == enc.ids, repr(text)
        assert codec.decode(enc.ids) == tok.decode(enc.ids, skip_special_tokens=False), repr(text)


def test_decode_of_broken_bytes(spark):
    codec, tok = bpe.Codec(bpe.load(vocabulary())), library()
    ids = [codec.byte_ids[0xC3], codec.byte_ids[0x41], codec.byte_ids[0xE2], codec.byte_ids[0x82]]
    assert codec.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_frames_nulls_and_columns(spark):
    rows = [(i, t, "keep") for i, t in enumerate(HARD)] + [(None, None, None), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect()
    assert len(out) == len(rows)
    tok = library()
    for r in out:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), vocabulary()).count() == 0


def test_query_equals_the_library(spark):
    tok = library()
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op2_bpe(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id].n_tokens == len(ids) and got[d.doc_id].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[d.doc_id].decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))


def test_workers_collect_garbage_after_encoding(spark):
    """A worker runs other tasks later; with its collector off, what they leave in cycles would stay for good."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * len(batch))], ["on"])

    docs = spark.range(0, 64, 1, 16).selectExpr("id AS doc_id", "concat('some text ', id) AS text")
    assert bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).where("decoded = text").count() == 64
    assert {r.on for r in spark.range(0, 64, 1, 16).mapInArrow(run, "on boolean").collect()} == {True}
