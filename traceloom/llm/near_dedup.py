"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words, lower-cased. A shingle weighs its count in the text
times the mean inverse document frequency of its words. Document frequencies are counted over all
documents, in a table of 2**18 word slots that every task can hold; a table of shingles would be as
large as the corpus. Improved consistent weighted sampling draws 64 samples (shingle, level) of a text;
16 bands of 4 samples make candidates, and a candidate pair is linked if its weighted Jaccard
similarity, computed from the two texts, is ``THRESHOLD`` or more. Classes are connected components.

Candidates of one bucket aren't paired with each other at once. First each is compared with the bucket's
hub (the member with the most bucket mates overall), which settles nearly all of a group. Then
only members that are still in different classes meet, unless their distances to the hub differ by
more than ``1 - THRESHOLD``: the distance is a metric, so such a pair has no link. Before two texts are
compared, their sketches are: four bits of each of 256 more samples. A pair is passed over if it
differs in more of them than a linked pair does but once in some 30,000 times (``DEVIATIONS`` standard deviations).

Cases: null texts count as empty; documents of equal text, empty ones included, share a class; texts of fewer
than five words are one shingle; other texts without words (white space only) are in a class by themselves; very long texts are
read whole; a null ``doc_id`` gets its text's class, and a class of null ids alone has id null;
rows with equal ``doc_id`` and text are one document to ``keep_one``; an empty table gives an empty result;
columns besides ``doc_id`` and ``text`` are kept by ``keep_one`` and not read by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import BATCH, setting, small_or_not, stored
from traceloom.llm.components import components
from traceloom.llm.shingles import mix, run_means, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
SLOT_BITS = 18
#: Draws are looked up by three parts of a shingle's hash, each of so many bits.
DRAW_BITS = 12
SEED = 4
#: Samples of a sketch, each kept to four bits, sixteen to a number.
SKETCH = 256
NUMBERS = SKETCH // 16
DEVIATIONS = 4
#: Texts up to which the list of candidates is broadcast: 16 bytes each.
BROADCAST_KEYS = 100_000
#: Weighted shingle sets that a task keeps while it verifies pairs.
KEPT_SETS = 64
#: Texts that Python is handed at once: a batch stands in memory several times, on both sides.
TEXTS_AT_ONCE = "500"

_draws: dict[int, list[np.ndarray]] = {}


def draws(n: int) -> list[np.ndarray]:
    """r, 1/r, ln c and beta of improved consistent weighted sampling, each (2**DRAW_BITS, n)."""
    if n not in _draws:
        rng = np.random.default_rng([SEED, n])
        shape = (1 << DRAW_BITS, n)
        r = rng.gamma(2.0, size=shape)
        _draws[n] = [x.astype(np.float32) for x in (r, 1 / r, np.log(rng.gamma(2.0, size=shape)), rng.random(shape))]
    return _draws[n]


def weighted_shingles(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's different shingles in order of their hashes, and their weights."""
    words = word_hashes(text)
    shingles = shingle_hashes(words, SHINGLE)
    weights = run_means(idf[(words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], SHINGLE)
    kinds, first, count = np.unique(shingles, return_index=True, return_counts=True)
    return kinds, weights[first] * count


def samples(kinds: np.ndarray, weights: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """A 64-bit hash of each of ``n`` samples (shingle, level)."""
    r, inverse, log_c, beta = draws(n)
    mask = np.uint64((1 << DRAW_BITS) - 1)
    best = np.full(n, np.inf, np.float32)
    chosen, level = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    log_w = np.log(weights).astype(np.float32)[:, None]
    for at in range(0, len(kinds), 1024):
        own = kinds[at : at + 1024]
        a, b, c = ((own >> np.uint64(s) & mask).astype(np.int64) for s in (0, DRAW_BITS, 2 * DRAW_BITS))
        shift = beta[c]
        t = np.floor(log_w[at : at + 1024] * inverse[a] + shift)
        log_a = log_c[b] - r[a] * (t - shift + 1)
        place = log_a.argmin(0)
        columns = np.arange(n)
        better = log_a[place, columns] < best
        best = np.where(better, log_a[place, columns], best)
        chosen = np.where(better, own[place], chosen)
        level = np.where(better, t[place, columns].astype(np.int64), level)
    return mix(chosen ^ mix(level.view(np.uint64)))


def bands(kinds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number a band, as signed numbers; none without shingles."""
    if not len(kinds):
        return np.zeros(0, np.int64)
    found = np.arange(BANDS, dtype=np.uint64)
    for row in samples(kinds, weights).reshape(BANDS, ROWS).T:
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + row)
    return found.view(np.int64)


def sketch(kinds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The low four bits of SKETCH samples, as NUMBERS signed numbers; texts without shingles have zeros."""
    if not len(kinds):
        return np.zeros(NUMBERS, np.int64)
    low = (samples(kinds, weights, SKETCH) & np.uint64(15)).reshape(NUMBERS, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 1.0


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + ln((1 + documents) / (1 + documents with the word)) of each word slot; a slot's rarest words share its value."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        n = 0
        for batch in batches:
            for text in batch["text"]:
                slots = (word_hashes(text) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                seen[np.unique(slots)] += 1
                n += 1
        slots = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": np.append(slots, -1), "n": np.append(seen[slots], n)})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    with setting(docs.sparkSession, BATCH, TEXTS_AT_ONCE):
        counted = counted.toArrow()
    slots, counts = (counted.column(x).to_numpy() for x in ("slot", "n"))
    seen = np.zeros(1 << SLOT_BITS)
    seen[slots[slots >= 0]] = counts[slots >= 0]
    return 1 + np.log((1 + counts[slots < 0].sum()) / (1 + seen))


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, text_key, bands) of each row; ``idf`` is the broadcast table."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [bands(*weighted_shingles(text, idf.value)) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "bands": found})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    with setting(docs.sparkSession, BATCH, TEXTS_AT_ONCE):
        return stored(rows.mapInPandas(sign, "doc_id long, text_key binary, bands array<long>"), "signatures")


def candidates(ids: DataFrame, docs: DataFrame, idf) -> DataFrame:
    """(id, text, sketch) of the texts with these keys, stored."""
    texts = docs.select(text_key(F.col("text")).alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small_or_not(ids, BROADCAST_KEYS), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))

    @F.pandas_udf("array<long>")
    def drawn(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(*weighted_shingles(t, idf.value)) for t in texts], dtype=object)

    with setting(docs.sparkSession, BATCH, TEXTS_AT_ONCE):
        return stored(texts.select("id", "text", drawn("text").alias("sketch")), "candidate-texts")


def plausible(x: str, y: str, threshold: float) -> Column:
    """Whether two sketches differ in no more samples than a pair of similarity ``threshold`` may."""
    same = threshold + (1 - threshold) / 16
    most = SKETCH * (1 - same) + DEVIATIONS * (SKETCH * same * (1 - same)) ** 0.5
    differ = F.lit(0)
    for i in range(NUMBERS):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= most


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, similarity) of the pairs of text keys (a, b), stored."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def of(key: bytes, text: str):
            if key not in kept:
                if len(kept) >= KEPT_SETS:
                    kept.pop(next(iter(kept)))
                kept[key] = weighted_shingles(text, idf.value)
            return kept[key]

        for rows in batches:
            found = [similarity(of(bytes(a), s), of(bytes(b), t)) for a, s, b, t in zip(rows["a"], rows["text_a"], rows["b"], rows["text_b"], strict=True)]
            yield rows[["a", "b"]].assign(similarity=found)

    with setting(texts.sparkSession, BATCH, TEXTS_AT_ONCE):
        return stored(pairs.join(other, "b").join(one, "a").mapInPandas(verify, "a binary, b binary, similarity double"), "verified")


def links(signed: DataFrame, docs: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """(id, root) of the text keys that a verified link joins to another text."""
    signs = signed.dropDuplicates(["text_key"]).select(F.col("text_key").alias("id"), F.explode("bands").alias("bucket"))
    sizes = signs.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    members = stored(signs.join(sizes, "bucket"), "bucket-members")
    central = members.groupBy("id").agg(F.sum("mates").alias("central"))
    hubs = members.join(central, "id").groupBy("bucket").agg(F.max(F.struct("central", "id"))["id"].alias("hub"))
    members = stored(members.join(hubs, "bucket").select("bucket", "id", "hub"), "bucket-hubs")
    texts = candidates(members.select("id").distinct(), docs, idf)
    drawn = texts.select("id", "sketch")
    star = members.where("id != hub").select("hub", "id").distinct().join(drawn, "id").join(drawn.toDF("hub", "hub_sketch"), "hub")
    star = verified(star.where(plausible("sketch", "hub_sketch", threshold)).select(F.col("hub").alias("a"), F.col("id").alias("b")), texts, idf)
    linked = star.where(F.col("similarity") >= threshold).select("a", "b")
    roots = components(linked)
    known = members.join(roots, "id", "left").select("bucket", "id", "hub", F.coalesce("root", "id").alias("root"))
    mixed = known.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("bucket")
    far = star.select(F.col("a").alias("hub"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("far"))
    left = known.where("id != hub").join(mixed, "bucket").join(far, ["hub", "id"], "left").join(drawn, "id")
    buckets = members.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    left = stored(left.join(buckets, "id").select("bucket", "id", "root", "far", "sketch", "buckets"), "unsettled")
    x = left.toDF("bucket", "id_x", "root_x", "far_x", "sketch_x", "buckets_x")
    y = left.toDF("bucket", "id_y", "root_y", "far_y", "sketch_y", "buckets_y")
    near = F.coalesce(F.abs(F.col("far_x") - F.col("far_y")) <= 1 - threshold + 1e-9, F.lit(True))
    # a pair that shares several buckets is made in the least of them only
    once = F.col("bucket") == F.array_min(F.array_intersect("buckets_x", "buckets_y"))
    rest = x.join(y, ["bucket"]).where((F.col("root_x") < F.col("root_y")) & near & plausible("sketch_x", "sketch_y", threshold) & once)
    rest = stored(rest.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct(), "unsettled-pairs")
    if rest.isEmpty():
        return roots
    more = verified(rest, texts, idf).where(F.col("similarity") >= threshold).select("a", "b")
    return components(linked.union(more))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, root, class_id) of each row: class_id is the least ``doc_id`` of its class."""
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs).astype(np.float32))
    signed = signatures(docs, idf)
    roots = links(signed, docs, idf, threshold).withColumnRenamed("id", "text_key")
    rooted = signed.select("doc_id", "text_key").join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    rooted = stored(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rooted.join(ids, "root").select("doc_id", "text_key", "root", "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each class: that of the least ``doc_id`` (nulls last), then of the least text key, then the one that comes first as JSON."""
    found = classes(docs, threshold)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_key(F.col("text")).alias("own_key"))
    chosen = rows.join(kept, (F.col("own_key") == F.col("kept_key")) & F.col("own_id").eqNullSafe(F.col("kept_id")))
    return chosen.groupBy("own_key", "own_id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
