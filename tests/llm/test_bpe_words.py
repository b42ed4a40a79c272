"""Encoding and decoding through the table of distinct words, against the library."""

import os
from hashlib import sha256

import numpy as np
import pytest

from graphloom.llm import bpe_words
from graphloom.llm.tokens import default_tokenizer

ODD = ["it's the dog's, don't!", "a<|endoftext|>b <|startoftext|> c", "été É́ ﬁ Å", "tab\tnew\nline\r\n  nbsp\xa0x y\u0085z\x1cq", "日本語 テスト 123 4五六", "🙂🙂 👩‍👩‍👧", "\x00 \x01", "A" * 5000, "the " * 20_000, " ", "ÀÉÎ...?? ..!! (x) #$%&|", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("slice_bytes", [bpe_words.SLICE_BYTES, 3_000, 1])
def test_ids_and_texts_equal_the_library(spark, docs, library, slice_bytes):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)] + [(100, ODD[0])], "doc_id long, text string")
    texts = docs.select("doc_id", "text").unionByName(more).repartition(3, "text")  # equal slices, too
    got = bpe_words.decode(bpe_words.encode(texts.withColumn("ids", texts["text"]), slice_bytes=slice_bytes)).collect()
    want = [(r["doc_id"], *by_library(library, r["text"])) for r in texts.collect()]
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)


def test_query_equals_the_library(spark, library):
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    got = sorted(map(tuple, bpe_words.op12_bpe_words(spark, path).collect()))
    want = []
    for doc, text in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        ids, decoded = by_library(library, text)
        want.append((doc, len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_nothing_and_odd_ids(spark, empty, library):
    assert bpe_words.encode(empty).count() == 0
    top = library.get_vocab_size(with_added_tokens=True)
    ids = [None, b"", np.array([top, 320, 2**32 - 1, 0], "<u4").tobytes()]
    got = bpe_words.decode(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, ids binary")).orderBy("doc_id").collect()
    assert [r["decoded"] for r in got] == ["", "", library.decode([320, 0], skip_special_tokens=False)]


def test_places_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        x = bpe_words.Slice.__new__(bpe_words.Slice)
        x.slot = np.unique(r.zipf(1.5, n), return_inverse=True)[1] if n else np.zeros(0, np.int64)
        x.where = np.zeros(int(x.slot.max()) + 1 if n else 0)
        assert (bpe_words.slots_of(*map(bpe_words.unpack_numbers, map(bpe_words.pack_numbers, x.places()))) == x.slot).all()


def test_each_distinct_word_is_encoded_once(spark, docs, monkeypatch):
    table = bpe_words.DistinctWords(default_tokenizer())
    asked = []
    monkeypatch.setattr(table, "_library", lambda ws: asked.extend(ws) or [np.zeros(1, np.uint32)] * len(ws))
    for words in ([b"a", b"b"], [b"b", b"c"], [b"a"]):
        table.ids_of(3, words)
    assert asked == ["a", "b", "c"]
