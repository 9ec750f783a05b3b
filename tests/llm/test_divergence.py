"""Divergence against a brute-force version: every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import pytest

from traceloom.llm import divergence as d

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((x or "" for x in row) for row in rows):
        terms = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    p = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        n = {s: sum(counts[lang, s][t] for t in kept) for l, s in groups if l == lang}
        total = {t: sum(counts[lang, s][t] for s in n) for t in kept}
        pair = [(s, sum(abs(p(counts[lang, source][t], n[source], v) - p(counts[lang, s][t], n[s], v)) for t in kept)) for s in n if s != source]
        term = [(t, p(counts[lang, source][t], n[source], v) - p(total[t], sum(n.values()), v)) for t in kept if counts[lang, source][t]]
        for part, items in (("pair", pair), ("term", [x for x in term if x[1] > 0])):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked if part == "pair" else ranked[:top])]
    return sorted(out)


def run(spark, rows, least, top):
    docs = spark.createDataFrame([(l, s, t, 1, b"x") for l, s, t in rows], "lang string, source string, text string, rank int, found binary").repartition(3)
    return sorted(tuple(r) for r in d.divergence(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé日" for b in ("x", "Y", "ß", "", "z´")]
    return [(rng.choice(["en", "fr"]), f"s{int(rng.paretovariate(1)) % 7}", " ".join(rng.choices(words, weights=range(1, 31), k=rng.randint(0, 30))) + "\x85 don't 5k\x00") for _ in range(n)]


@pytest.mark.parametrize(("least", "top", "together"), [(3, 5, 400_000), (30, 50, 20)])
def test_as_brute_force(spark, least, top, together, monkeypatch):
    monkeypatch.setattr(d, "TOGETHER", together)
    rows = corpus(400, least) + [(None, None, "ax ax AX"), (None, "", "ax"), ("", "s1", None), ("xx", "only", "no kept term"), ("yy", "a", ""), ("yy", "b", None), ("en", "s1", "BX " * 30_000)] + [("en", "s2", "CX cx")] * 40
    found = run(spark, rows, least, top)
    assert found == brute(rows, least, top)
    assert ("yy", "a", "pair", "b", 0, 1) in found and not [r for r in found if r[0] == "xx"]


def test_empty_table(spark):
    assert run(spark, [], 3, 5) == []


def test_cells_have_all_terms(spark):
    docs = spark.createDataFrame(corpus(300, 1), "lang string, source string, text string")
    kept, names = d.term_counts(docs, 3)
    groups = d.group_sizes(kept, names)
    pairs = groups.selectExpr("g AS a", "lang", "v").join(groups.selectExpr("g AS b", "lang"), "lang").where("a < b")
    cells = d.joint_cells(kept, pairs)
    per = {(r.a, r.b): r.n for r in cells.groupBy("a", "b").agg({"m": "sum"}).withColumnRenamed("sum(m)", "n").collect()}
    assert per == {(r.a, r.b): r.v for r in pairs.collect() if r.v} and cells.where("m < 0").count() == 0


def test_share_beyond_64_bits(spark):
    counts = [0, 7, 9 * 10**9 - 1, 9 * 10**9, 5 * 10**12]
    rows = spark.createDataFrame([(c, 10**13, 10**6) for c in counts], "c long, n long, v long")
    found = [r[0] for r in rows.select(d.share(rows.c, rows.n, rows.v)).collect()]
    assert found == [1 + 10**9 * (c + 5) // (10**13 + 5 * 10**6) for c in counts]
