"""Pieces against the reference tokenizer, against a plain agenda, and back to the text."""

import random

import pytest
import sentencepiece

from pyspark.sql import functions as F
from traceloom.llm import pieces as p

TEXTS = ["", " ", "Hello  world\n x", "  lead", "tab\tx", "日本語テスト ｆｕｌｌ ﬁ", "a" * 300 + " b", " " * 40 + "x", "été ñandú straße", "a▁b ▁ ▁▁c", "\u0000\U0001f600x", "mixed\r\nends\n\n"]


@pytest.fixture(scope="module")
def model():
    return p.Pieces()


def sample():
    rng = random.Random(4)
    return TEXTS + [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(60)) for _ in range(20)]


def test_without_dropout_as_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=p.MODEL)
    texts = [t for t in sample() if "▁" not in t]
    assert [x.tolist() for x in p.encode_texts(model, texts, [0] * len(texts), 0.0)] == library.encode(texts)


def test_together_as_one_by_one(model, monkeypatch):
    texts = sample()
    keys = [p.key_of(i) for i in range(len(texts))]
    together = [x.tolist() for x in p.encode_texts(model, texts, keys, 0.3)]
    monkeypatch.setattr(p, "LONG", 0)
    assert [x.tolist() for x in p.encode_texts(model, texts, keys, 0.3)] == together


def test_segmentations_vary_and_decode(model):
    texts = sample()
    kinds = set()
    for seed in range(4):
        found = p.encode_texts(model, texts, [p.key_of(i, seed) for i in range(len(texts))], 0.2)
        assert [p.decode_ids(model, x.tolist()) for x in found] == texts
        kinds.add(tuple(map(tuple, found)))
    assert len(kinds) == 4


def test_columns(spark):
    rows = [(1, "some text here", 5), (None, None, None), (1, "some text here", 5), (2, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    back = p.encode(docs, docs.columns).select("row.*", "ids", p.decode(F.col("ids")).alias("back"))
    found = back.collect()
    assert [r.back for r in found] == [r.text or "" for r in found]
    assert [tuple(r.ids) for r in found if r.doc_id == 1][0] == [tuple(r.ids) for r in found if r.doc_id == 1][1]
    trip = p.round_trip(docs)
    assert trip.where("lossless").count() == 4 and p.round_trip(docs.limit(0)).count() == 0


def test_encoded_by_groups_as_alone(spark, model, monkeypatch):
    monkeypatch.setattr(p, "TOGETHER", 500)
    rows = [(i, t, i) for i, t in enumerate(sample())]
    found = p.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int").coalesce(1), ["doc_id", "ids"]).collect()
    assert [r.row.ids for r in found] == [i for i, *_ in rows]
    assert [r.ids for r in found] == [p.encode_texts(model, [t], [p.key_of(i)], p.DROPOUT)[0].tolist() for i, t, _ in rows]
