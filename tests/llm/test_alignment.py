"""Alignment against whole texts, every pair of tokens compared."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from traceloom.llm import alignment as al

TEXTS = [
    "", None, " ", "Hello  world\n x", "  lead and trail  ", "tab\tx\ty", "日本語テスト ｆｕｌｌ ﬁ and more", "a" * 700 + " b", " " * 40 + "x", "été ñandú straße don't we'll", "a▁b ▁ ▁▁c", "fine ▁ not",
    "\u0000\U0001f600x", "mixed\r\nends\n\n", "<|endoftext|> and </s> <unk> <s> <0x0A>", "nbsp here  there  wide", "odd᠎ x᠎  y", "\x1c sep \x1d\x1ey", "line sep", "100 200,300 3.14!!?  --", "\n\n\nx\n y", "Á é̂",
]


@pytest.fixture(scope="module")
def tokenizers():
    return al.loaded(al.A_FILE, al.B_FILE)


def plain(tokenizers, text):
    """(ids of A, ids of B, groups, links as pairs of ids), or None."""
    if not text:
        return None
    whole = " " + text
    a, b = tokenizers.a.encode(whole, add_special_tokens=False).ids, tokenizers.b.encode(text)
    raw = whole.encode()
    if b"".join(tokenizers.a_bytes[i] for i in a) != raw or b"".join(tokenizers.b_bytes[i] for i in b) != raw:
        return None
    span = lambda ids, of: list(zip(ends := np.cumsum([len(of[i]) for i in ids]).tolist(), [0, *ends[:-1]]))
    sa, sb = span(a, tokenizers.a_bytes), span(b, tokenizers.b_bytes)
    links = [(x, y) for x, (ex, bx) in zip(a, sa) for y, (ey, by) in zip(b, sb) if max(bx, by) < min(ex, ey)]
    groups, i, j = [], 0, 0
    for cut in sorted({e for e, _ in sa} & {e for e, _ in sb}):
        ga = [x for x, (e, _) in zip(a, sa) if i < e <= cut]
        gb = [y for y, (e, _) in zip(b, sb) if j < e <= cut]
        groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        i = j = cut
    return a, b, groups, links


def brute(tokenizers, texts):
    every = [plain(tokenizers, t) for t in texts]
    counts = Counter(link for x in every if x for link in x[3])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for x in every:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        out.append((len(a), len(b), len(groups), len(links), sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def sample(n, seed):
    rng = random.Random(seed)
    parts = ["the", "Token", "naïve", "日本", "don't", "  ", "\n", "\t", "42", "x" * 30, ".", " ", "ing", "▁", " ", "é"]
    return [" ".join("".join(rng.choices(parts, weights=[9, 9, 9, 2, 5, 3, 3, 2, 5, 1, 5, 1, 9, 0.02, 9, 5], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def found(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, rest binary").repartition(3)
    rows = sorted(al.align(docs, ["doc_id"], **options).collect(), key=lambda r: r.row.doc_id)
    assert [r.row.doc_id for r in rows] == list(range(len(texts)))
    return [tuple(r)[1:] for r in rows]


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_as_brute_force(spark, tokenizers, head):
    texts = TEXTS + sample(120, 5) + ["the same words"] * 30
    wanted = brute(tokenizers, texts)
    assert found(spark, texts, head=head) == wanted
    zero = [t for t, w in zip(texts, wanted) if not w[0]]
    assert "a▁b ▁ ▁▁c" in zero and "" in zero and len(zero) < 20


def test_words_are_as_whole_texts(tokenizers):
    for text in [t for t in TEXTS if t and "▁" not in t] + [t.replace("▁", "") or "x" for t in sample(400, 11)]:
        words = al.words_of(" " + text)
        assert "".join(words) == " " + text
        each = [tokenizers.encode(w) for w in words]
        assert [i for a, _ in each for i in a] == tokenizers.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for _, b in each for i in b] == tokenizers.b.encode(text)


def test_little_memory_gives_the_same(tokenizers, monkeypatch):
    import pyarrow as pa

    texts = sample(200, 2) + ["x" * 5000, "long word " + "y" * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])

    def run():
        return [r for out in al._encode(al.A_FILE, al.B_FILE)(iter([batch])) for r in out.to_pylist()]

    rows = run()
    for name, value in (("WORDS", 20), ("TOGETHER", 500), ("JOINED", 30)):
        monkeypatch.setattr(al, name, value)
    assert run() == rows
    assert Counter((x >> 32, x & 0xFFFFFFFF) for r in rows for x in r["links"]) == Counter(link for t in texts if (p := plain(tokenizers, t)) for link in p[3])


def test_bitsets():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size) < 0.3)
        ends = al.Ends(places, size)
        assert ends.select().tolist() == places.tolist()
        assert ends.rank(np.arange(size)).tolist() == [int((places < i).sum()) for i in range(size)]


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2
