"""Near-dedup against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np

from traceloom.llm import near_dedup as nd
from traceloom.llm.components import components
from traceloom.llm.shingles import word_hashes


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(30, 160))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(rng.randint(1, 7)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [texts[0], texts[1], None, "", "  ", "one two", "one two", " ".join(["x"] * 4000)]
    return list(enumerate(texts))


def brute(rows, threshold=nd.THRESHOLD):
    seen = np.zeros(1 << nd.SLOT_BITS)
    for _, text in rows:
        seen[np.unique((word_hashes(text) >> np.uint64(64 - nd.SLOT_BITS)).astype(int))] += 1
    idf = (1 + np.log((1 + len(rows)) / (1 + seen))).astype(np.float32)
    sets = [nd.weighted_shingles(t, idf) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        same = (rows[i][1] or "") == (rows[j][1] or "")
        if same or (len(sets[i][0]) and len(sets[j][0]) and nd.similarity(sets[i], sets[j]) >= threshold):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    assert found == brute(rows)


def test_keep_one_keeps_columns_and_one_row_of_a_class(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", None), (None, "a b c d e f", "z"), (3, None, "n"), (3, None, "n"), (None, "q r s t u", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(map(repr, [(1, "a b c d e f", "x"), (3, None, "n"), (None, "q r s t u", "k")]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.classes(docs).count() == 0 and nd.keep_one(docs).count() == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    kinds = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    weights = rng.random(len(kinds)) + 1
    a, b = (kinds[:340], weights[:340]), (kinds[60:], weights[60:])
    share = (nd.samples(*a, 256) == nd.samples(*b, 256)).mean()
    assert abs(share - nd.similarity(a, b)) < 0.12


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 3), (10, 11), (11, 12), (20, 20), *[(100 + i, 101 + i) for i in range(40)]]
    found = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
