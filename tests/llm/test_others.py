"""Media, URLs, mixing, toxicity and neighbours on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from traceloom.llm import media, mixing, neighbours, toxicity, url_filter


def test_media_round_trip(spark):
    texts = ["", None, "short", "é" * 5000, "x" * 64, "short"]
    docs = spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = media.media_columns(docs).collect()
    assert len(found) == len(texts)
    for row in found:
        payload, n = media.payload_of(texts[2 if row.doc_id is None else row.doc_id])
        assert (row.n_bytes, row.payload_bytes) == (n, len(payload))
        assert (row.payload_sha256, row.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    folder, index = media.write_media(docs)
    heads = media.header_columns(folder, media.locations(index)).collect()
    assert {h.width for h in heads} == {64} and sum(h.height for h in heads) == sum(len(media.payload_of(t)[0]) // 64 for t in {t or "" for t in texts})
    assert media.media_columns(docs.limit(0)).count() == 0


def test_equal_texts_share_one_place_and_reruns_agree(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else "", "a", 5, b"x") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, offset int, digest binary").repartition(5, "doc_id")
    first, again = (sorted(map(tuple, media.media_columns(docs).collect())) for _ in range(2))
    assert first == again and len(first) == 120
    texts = {r[0]: r[1] for r in rows}
    found = {}
    for row in media.media_columns(docs).collect():
        values = {k: x for k, x in row.asDict().items() if k != "doc_id"}
        assert found.setdefault(texts[row.doc_id], values) == values
        assert (row.width * row.height, row.sample_bits) == (row.payload_bytes, 8)


def test_a_later_attempt_never_points_into_bytes_of_another(tmp_path, monkeypatch):
    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return 70 + self.attempt

        def attemptNumber(self):
            return self.attempt

    payloads = [media.payload_of(f"text {i} " * 50)[0] for i in range(6)]
    shards = []
    for attempt, order in ((0, payloads), (1, payloads[::-1])):
        monkeypatch.setattr(media.TaskContext, "get", lambda attempt=attempt: Task(attempt))
        writer = media._Shards(f"file://{tmp_path}", 1 << 20)
        places = {p: writer.add(hashlib.sha256(p).digest(), p) for p in order}
        writer.close()
        shards.append(places)
    for places in shards:
        for payload, (name, offset, length) in places.items():
            assert (tmp_path / name).read_bytes()[offset : offset + length] == media.to_png(payload)
    assert {p[0] for p in shards[0].values()} != {p[0] for p in shards[1].values()}
    # a first attempt that is still writing when another one is done fails, instead of naming bytes of the other
    monkeypatch.setattr(media.TaskContext, "get", lambda: Task(0))
    slow = media._Shards(f"file://{tmp_path}/new", 1 << 20)
    slow.system.create_dir(f"{tmp_path}/new")
    slow.add(b"x" * 32, payloads[0])
    (tmp_path / "new" / slow.name).write_bytes(b"other")
    with pytest.raises(RuntimeError, match="another attempt"):
        slow.close()


def test_png_is_read_by_another_decoder(spark):
    payload, _ = media.payload_of("some text of a page " * 20)
    png = media.to_png(payload)
    chunks, at = {}, 8
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        chunks[png[at + 4 : at + 8]] = png[at + 8 : at + 8 + size]
        assert int.from_bytes(png[at + 8 + size : at + 12 + size], "big") == zlib.crc32(png[at + 4 : at + 8 + size])
        at += 12 + size
    lines = zlib.decompress(chunks[b"IDAT"])
    assert b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == payload and list(chunks) == [b"IHDR", b"IDAT", b"IEND"]


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    cut = min(ends, default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "ftp://a.www.example.com/en", "http://x.net/es/a://b", "http://net/fr/?q", "http://notexample.com/en/", "http://a.b.c.d.net/de/", "x://é.com/ü", "http://com", "http://example.com/en/", "http://example.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, ["page_id"]).collect()}
    assert found == {i: brute_verdict(u) for i, u in enumerate(urls)}
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, [("a.com", "x", "block")])


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("own"))
    plan = mixing.mixing_plan(docs).selectExpr("row.doc_id", "row.source", "size", "source_size", "target", "size * copies AS taken").collect()
    assert all(r.taken <= 2 * r.size for r in plan)
    total = sum(r.size for r in plan)
    targets = {r.source: r.target for r in plan}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for source, target in targets.items():
        assert abs(sum(r.taken for r in plan if r.source == source) - target) < 0.1 * target
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r.size if r.size else 0 for r in plan) + mixed.where("text = ''").count()
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    usual = ["w" + str(i) for i in range(400)]
    bad = ["grim", "vile", "foul", "nasty"]
    rows, marks = [], []
    for i in range(800):
        toxic = i % 4 == 0
        words = [rng.choice(usual) for _ in range(rng.randint(20, 80))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(None, None), (9000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score")).collect()
    held = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found if r.doc_id is not None and r.doc_id < 800 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum(held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    clean = toxicity.keep_clean(docs.withColumn("measure", F.lit("x")), labels)
    assert clean.columns == ["doc_id", "text", "measure"] and 550 < clean.count() < 650
    alone = toxicity.fit(docs, labels.where("toxic = 0"))
    assert docs.select(toxicity.score(F.col("text"), alone).alias("s")).where("s >= 0.5").count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 20] + rng.standard_normal(16) * 0.6)]) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (None, rows[0][1]), (700, rows[0][1]), (701, rows[0][1]), (750, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    hits = asked = 0
    for q, x in good:
        if q % 50:
            continue
        best = sorted((-float(x @ y / np.sqrt((x @ x) * (y @ y))), i) for i, y in good if i != q)[:5]
        got = sorted(found[q])
        assert [n for n, _, _ in got] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in best} & {i for _, i, _ in got})
        asked += 5
    assert hits / asked >= 0.9
    assert [i for _, i, _ in sorted(found[0])[:2]] == [700, 701]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
