"""Repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from traceloom.llm import repeats as r


def brute(raws, window):
    seen = Counter(x[i : i + window] for x in raws for i in range(len(x) - window + 1))
    masks = []
    for x in raws:
        mask = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                mask[i : i + window] = True
        masks.append(mask)
    return masks


def test_merged_transforms_find_repeated_windows():
    rng = random.Random(1)
    for trial in range(12):
        base = [bytes(rng.choices(b"ab" if trial % 3 == 0 else b"abcdefgh", k=rng.randint(40, 120))) for _ in range(4)]
        contexts = []
        while len(contexts) < 10:
            s = b"".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(30, 120)] for _ in range(rng.randint(1, 3)))
            if len(s) >= 40 and s not in contexts:
                contexts.append(s)
        times = np.array([rng.choice([1, 1, 1, 2]) for _ in contexts], float)
        found = r.repeated_windows(contexts, times, np.array([rng.randint(0, 3) for _ in contexts]), window=40, block=10)
        seen = Counter()
        for t, x in zip(times, contexts):
            for i in range(len(x) - 39):
                seen[x[i : i + 40]] += t
        wanted = [[i for i in range(len(x) - 39) if seen[x[i : i + 40]] > 1] for x in contexts]
        assert [[p for a, b in zip(f[::2], f[1::2]) for p in range(a, b + 1)] for f in found] == wanted


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdef \né", k=n))
    shared = [text(n) for n in (380, 420, 700, 1500)]
    rows = [text(rng.randint(0, 600)) + rng.choice(shared)[rng.randint(0, 30) :] + text(rng.randint(0, 300)) for _ in range(30)]
    return [*rows, rows[0], rows[0], None, "", "short", "ab" * 600, "z" * 900, shared[3]]


@pytest.mark.parametrize("hot,finer", [(3000, (256, 384)), (2, (256, 384)), (1, ())])
def test_removed_bytes(spark, monkeypatch, hot, finer):
    monkeypatch.setattr(r, "HOT", hot)
    monkeypatch.setattr(r.repeated, "__defaults__", (finer,))
    texts = corpus()
    raws = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {x.doc_id: x for x in r.remove_repeats(docs).collect()}
    for i, (raw, mask) in enumerate(zip(raws, brute(raws, r.WINDOW))):
        got = found[i]
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        assert (got.n_bytes, got.n_removed, got.n_spans) == (len(raw), int(mask.sum()), runs), i
        assert bytes(got.kept) == bytes(np.frombuffer(raw, np.uint8)[~mask])


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "x" * 500), (None, "y" * 10)], "doc_id long, text string")
    assert sorted((x.n_bytes, x.n_removed) for x in r.remove_repeats(docs).collect()) == [(10, 0), (500, 500)]
    assert r.remove_repeats(docs.limit(0)).count() == 0


def test_hot_passage_with_more_contexts_than_a_part_takes(spark):
    """A passage in more than HOT documents with different neighbours, some of which agree for a few bytes, against brute force."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("ab", k=n))
    shared = "".join(rng.choices("abcdefgh ", k=430))
    texts = [text(60) + shared[rng.choice([0, 0, 0, 20, 45]) :] + text(60) for _ in range(r.HOT + 150)]
    found = {x.doc_id: x for x in r.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, (t, mask) in enumerate(zip(texts, brute([t.encode() for t in texts], r.WINDOW))):
        assert bytes(found[i].kept) == bytes(np.frombuffer(t.encode(), np.uint8)[~mask]), i


def test_texts_in_parts_have_the_same_anchors():
    rng = np.random.default_rng(3)
    for size in (399, 400, 1000, 1001, 1600, 5003):
        raw = rng.integers(97, 101, size).astype(np.uint8)
        raw[size // 2 :] = raw[: size - size // 2]
        of = lambda found: [(int(w), int(h)) for h, f, z in zip(*found) for w in range(f, z + 1)]
        whole, parts = of(r.anchors(raw)), of(r.anchors(raw, most=1000))
        assert whole == parts and [w for w, _ in whole] == list(range(max(0, size - r.WINDOW + 1)))
