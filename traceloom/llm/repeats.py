"""Suffix-array dedup by merging Burrows-Wheeler transforms.

Every byte that a repeated string of ``WINDOW`` bytes covers goes. The work is cut so that no task
sees more than a bounded part:

1. Each window has an anchor: the leftmost least hash of its 64-byte grams. Equal windows have
   equal anchors, so windows whose anchor occurs once can't repeat and are dropped.
2. Neighbouring windows of one anchor are one context, a string of ``WINDOW`` bytes or more. Contexts of
   equal bytes are counted once, with their number, and contexts are dealt out by anchor into parts. Where all
   occurrences of an anchor have one context, it is one string that occurs as often: all its windows repeat, and
   it takes no further part.
3. In a part, the contexts of each source shard are suffix-sorted over symbols of ``BLOCK`` bytes, which gives the
   shard's Burrows-Wheeler transform. The transforms are merged by interleave refinement: in each
   round, the interleave is dealt stably by the symbols that precede its entries, and a block boundary is set where
   symbol or former block changes. After WINDOW / BLOCK rounds the entries of a block are the suffixes with a
   common prefix of WINDOW bytes; a block of more than one occurrence is a repeated interval. Suffixes
   are sorted within shards only, and never again.
4. Intervals go back to the documents, which drop the bytes they cover.

Where more than ``HOT`` different contexts share an anchor (a passage in very many documents), its contexts are dealt out again
by anchors of longer grams (``FINER``), which leave shorter contexts and fewer of one anchor: those that occur once drop out, and the others
go through the transforms as before. What shares even the longest gram with so many differs within a few bytes of the passage's ends;
there, and only there, the few windows of a context are counted one by one, pre-aggregated.

Cases: null and empty texts have no bytes and a text shorter than a window loses none; text is taken as UTF-8;
windows may overlap themselves; a null ``doc_id`` is kept; repeated rows are occurrences of their own, so their texts
repeat; very long texts are taken whole (up to 2**28 bytes each); an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import dropped, stored
from traceloom.llm.shingles import mix, powers

WINDOW = 400
GRAM = 64
#: Grams of the anchors that hot contexts are dealt out by, one after the other.
FINER = (256, 384)
BLOCK = 100
#: Shards whose transforms are merged in one part.
SHARDS = 8
#: Bytes of contexts in a part, and different contexts of an anchor up to which it goes to one.
PART_BYTES = 600_000
HOT = 1000
#: Context digests that a task remembers, to hand over the bytes of each only once.
REMEMBERED = 400_000
#: Bytes that are hashed at once.
PIECE = 1 << 18
PLACE_BITS = 28
#: A document's identity: its id (nulls as the largest number) and the hash of its text.
KEY = ["own", "mark"]


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place that has so many."""
    out = np.zeros(max(0, len(raw) - size + 1), np.uint64)
    for at in range(0, len(out), PIECE):
        own = raw[at : at + PIECE + size - 1].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(own) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)])])
        n = len(own) - size + 1
        out[at : at + n] = mix((sums[size : size + n] - sums[:n]) * down[:n])
    return out


def anchors(raw: np.ndarray, gram: int = GRAM, most: int = 1 << PLACE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each run of windows with one anchor. Texts of more than ``most`` bytes, whose places have no room beside
    the hashes, are taken in parts that have each window once; a run across two parts is two runs."""
    if len(raw) <= most:
        return _anchors(raw, gram)
    found = [(at, _anchors(raw[at : at + most], gram)) for at in range(0, len(raw) - WINDOW + 1, most - WINDOW + 1)]
    return np.concatenate([h for _, (h, _, _) in found]), np.concatenate([f + at for at, (_, f, _) in found]), np.concatenate([z + at for at, (_, _, z) in found])


def _anchors(raw: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(raw) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(raw, gram)
    n, width = len(hashes), WINDOW - gram + 1
    placed = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = placed
    rows = rows.reshape(-1, width)
    forward = np.minimum.accumulate(rows, 1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - width + 1
    at = (np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], windows) - 1
    return hashes[at[first]], first, last


def _ranges(mask: np.ndarray) -> np.ndarray:
    """First and last place of each run of True, in turn."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    edges[1::2] -= 1
    return edges


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def sorted_suffixes(symbols: np.ndarray, rows: np.ndarray, rounds: int, block: int) -> np.ndarray:
    """The suffixes ``rows`` of one shard, sorted by their first ``rounds`` symbols.

    ``symbols`` has the symbol at each place of the part, 0 where fewer than ``block`` bytes are left.
    """
    rank = symbols[rows].astype(np.int64)
    local = np.full(len(symbols), -1, np.int64)
    local[rows] = np.arange(len(rows))
    follow = np.where(symbols[rows] > 0, local[np.minimum(rows + block, len(symbols) - 1)], -1)
    for _ in range(rounds - 1):
        after = np.where(follow >= 0, rank[follow] + 1, 0)
        rank = _dense((symbols[rows].astype(np.int64) << 32) | after)
    return rows[np.argsort(rank, kind="stable")]


def merged_blocks(transforms: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The block of each entry of each transform, by interleave refinement over ``rounds`` symbols."""
    sizes = [len(t) for t in transforms]
    source = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)
    block = np.zeros(len(source), np.int64)
    symbols = np.zeros(len(source), np.int64)
    for _ in range(rounds):
        for s, transform in enumerate(transforms):
            symbols[source == s] = transform
        order = np.argsort(symbols, kind="stable")
        ordered, former = symbols[order], block[order]
        source = source[order]
        block = np.cumsum(np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (former[1:] != former[:-1])])) - 1
    return [block[source == s] for s in range(len(sizes))]


def repeated_windows(contexts: list[bytes], times: np.ndarray, shards: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> list[np.ndarray]:
    """For each context (different byte strings of ``window`` bytes or more), the runs of windows that occur more than once."""
    rounds = window // block
    sizes = np.array([len(c) for c in contexts])
    # each context is followed by its empty suffix, so that it has ``block`` chains of symbols, each with one end
    starts = np.cumsum(np.append(0, sizes + 1))[:-1]
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(raw))
    hashes = np.zeros(len(raw), np.uint64)
    grams = gram_hashes(raw, block)
    hashes[: len(grams)] = grams
    symbols = np.zeros(len(raw), np.int64)
    whole = left >= block
    symbols[whole] = _dense(hashes[whole]) + 1
    before = np.zeros(len(raw), np.int64)
    inside = np.arange(len(raw)) - np.repeat(starts, sizes + 1) >= block
    before[inside] = symbols[np.flatnonzero(inside) - block]
    sorted_rows, transforms = [], []
    for s in np.unique(shards):
        rows = sorted_suffixes(symbols, np.flatnonzero(shards[owner] == s), rounds, block)
        sorted_rows.append(rows)
        transforms.append(before[rows])
    place = np.concatenate(sorted_rows)
    blocks = np.concatenate(merged_blocks(transforms, rounds))
    starts_window = left[place] >= window
    weight = np.bincount(blocks[starts_window], weights=times[owner[place[starts_window]]], minlength=len(raw) + 1)
    repeats = np.zeros(len(raw), bool)
    repeats[place[starts_window]] = weight[blocks[starts_window]] > 1
    return [_ranges(repeats[a : a + n]) for a, n in zip(starts, sizes, strict=True)]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("own"), F.xxhash64(text).alias("mark"), text.alias("text"))


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(own, mark, anchors): for each document its anchors that occur more than once in the corpus, stored."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [anchors(np.frombuffer(raw_bytes(t), np.uint8))[0] for t in batch["text"]]
            kinds = [np.unique(f, return_counts=True) for f in found]
            sizes = [len(k) for k, _ in kinds]
            out = batch[KEY].loc[batch.index.repeat(sizes)].reset_index(drop=True)
            out["anchor"] = np.concatenate([k for k, _ in kinds]).view(np.int64) if kinds else np.zeros(0, np.int64)
            out["times"] = np.concatenate([n for _, n in kinds]) if kinds else np.zeros(0, np.int64)
            yield out

    rows = stored(docs.select(*KEY, "text").mapInPandas(find, "own long, mark long, anchor long, times long"), "anchors")
    many = rows.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")
    return stored(rows.join(many.hint("shuffle_hash"), "anchor", "left_semi").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors")), "repeated-anchors")


def contexts_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(own, mark, cid, anchor, starts, windows, shard, raw) of each document's different contexts, stored; raw is null where the task gave it before."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        given: set[bytes] = set()
        for batch in batches:
            rows = []
            for own, mark, text, listed in zip(batch["own"], batch["mark"], batch["text"], batch["anchors"], strict=True):
                raw = raw_bytes(text)
                hashes, first, last = anchors(np.frombuffer(raw, np.uint8))
                hashes = hashes.view(np.int64)
                found: dict[bytes, list] = {}
                for i in np.flatnonzero(np.isin(hashes, np.asarray(listed))):
                    a = int(first[i])
                    body = raw[a : int(last[i]) + WINDOW]
                    cid = hashlib.blake2b(body, digest_size=16).digest()
                    if cid in found:
                        found[cid][4].append(a)
                    else:
                        found[cid] = [own, mark, cid, int(hashes[i]), [a], len(body) - WINDOW + 1, shard, None if cid in given else body]
                        if len(given) >= REMEMBERED:
                            given.clear()
                        given.add(cid)
                rows += found.values()
            yield pd.DataFrame(rows, columns=["own", "mark", "cid", "anchor", "starts", "windows", "shard", "raw"])

    rows = docs.select(*KEY, "text").join(known.hint("shuffle_hash"), KEY)
    return stored(rows.mapInPandas(cut, "own long, mark long, cid binary, anchor long, starts array<long>, windows long, shard int, raw binary"), "contexts")


def kinds_of(contexts: DataFrame) -> DataFrame:
    """(cid, raw, anchor, shard, times) of the different contexts, stored; ``contexts`` has ``n`` occurrences a row."""
    found = contexts.groupBy("cid").agg(F.max("raw").alias("raw"), F.min("anchor").alias("anchor"), F.min("shard").alias("shard"), F.sum("n").alias("times"))
    return stored(found, "context-kinds")


def repeated_in_parts(contexts: DataFrame) -> DataFrame:
    """(cid, runs) of the contexts in parts: the runs of windows that occur more than once."""
    size = contexts.agg(F.sum(F.length("raw"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows([bytes(x) for x in rows["raw"]], rows["times"].to_numpy(float), rows["shard"].to_numpy() % SHARDS)
        return pd.DataFrame({"cid": rows["cid"], "runs": found})

    dealt = contexts.select(F.pmod(F.xxhash64("anchor"), F.lit(parts)).alias("part"), "cid", "times", "shard", "raw")
    return dealt.groupBy("part").applyInPandas(merge, "cid binary, runs array<long>")


def repeated_one_by_one(kinds: DataFrame) -> DataFrame:
    """(cid, runs) of contexts of a few windows each, which are counted one by one."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(cid, i, hashlib.blake2b(raw[i : i + WINDOW], digest_size=16).digest(), n) for cid, raw, n in zip(batch["cid"], map(bytes, batch["raw"]), batch["times"], strict=True) for i in range(len(raw) - WINDOW + 1)]
            yield pd.DataFrame(rows, columns=["cid", "place", "window", "n"])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cid": batch["cid"], "runs": [_ranges(np.isin(np.arange(max(p) + 1), p)) for p in batch["places"]]})

    each = stored(kinds.select("cid", "times", "raw").mapInPandas(windows, "cid binary, place long, window binary, n long"), "hot-windows")
    many = each.groupBy("window").agg(F.sum("n").alias("all")).where("all > 1").select("window")
    placed = each.join(many.hint("shuffle_hash"), "window", "left_semi").groupBy("cid").agg(F.collect_list("place").alias("places"))
    return placed.mapInPandas(runs, "cid binary, runs array<long>")


def dealt_again(kinds: DataFrame, gram: int) -> DataFrame:
    """(owner, at, windows, cid, anchor, shard, n, raw) of what anchors of longer grams make of contexts, stored."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cid, raw, shard, times in zip(batch["cid"], map(bytes, batch["raw"]), batch["shard"], batch["times"], strict=True):
                for anchor, a, z in zip(*anchors(np.frombuffer(raw, np.uint8), gram), strict=True):
                    body = raw[a : z + WINDOW]
                    rows.append((cid, int(a), int(z - a + 1), hashlib.blake2b(body, digest_size=16).digest(), int(anchor.view(np.int64)), shard, times, body))
            yield pd.DataFrame(rows, columns=["owner", "at", "windows", "cid", "anchor", "shard", "n", "raw"])

    found = kinds.select("cid", "raw", "shard", "times").mapInPandas(cut, "owner binary, at long, windows long, cid binary, anchor long, shard int, n long, raw binary")
    return stored(found, "finer-contexts")


def repeated(kinds: DataFrame, finer: tuple[int, ...] = FINER) -> DataFrame:
    """(cid, runs) of the stored ``kinds`` of contexts with shared anchors: the runs of windows that occur more than once."""
    hot = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("anchor"), "hot-anchors")
    if hot.isEmpty():
        return repeated_in_parts(kinds)
    found = repeated_in_parts(kinds.join(hot.hint("shuffle_hash"), "anchor", "left_anti"))
    rest = kinds.join(hot.hint("shuffle_hash"), "anchor", "left_semi")
    if not finer:
        return found.unionByName(repeated_one_by_one(rest))
    again = dealt_again(rest, finer[0])
    counted = again.groupBy("anchor").agg(F.min("cid").alias("least"), F.max("cid").alias("most"), F.sum("n").alias("all")).where("all > 1")
    once = counted.where("least = most").select("anchor")
    whole = again.join(once.hint("shuffle_hash"), "anchor", "left_semi").select(F.col("owner").alias("cid"), F.array("at", F.col("at") + F.col("windows") - 1).alias("runs"))
    shared = kinds_of(again.join(counted.where("least != most").select("anchor").hint("shuffle_hash"), "anchor", "left_semi"))
    below = repeated(shared, finer[1:]).where(F.size("runs") > 0)
    placed = again.select("owner", "at", "cid").join(below, "cid").select(F.col("owner").alias("cid"), F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
    return found.unionByName(whole).unionByName(placed)


def covered(docs: DataFrame) -> DataFrame:
    """(own, mark, spans) of the documents that hold a repeated string, stored: first byte and end of each, in turn and overlapping."""
    known = repeated_anchors(docs)
    contexts = contexts_of(docs, known)
    shared = contexts.groupBy("anchor").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least != most")
    shared = stored(shared.select("anchor"), "shared-anchors")
    found = stored(repeated(kinds_of(contexts.withColumn("n", F.size("starts")).join(shared.hint("shuffle_hash"), "anchor", "left_semi"))).where(F.size("runs") > 0), "runs")
    placed = contexts.select(*KEY, "anchor", "cid", "starts", "windows")
    shifted = F.flatten(F.transform("starts", lambda a: F.transform("runs", lambda r, i: a + r + F.when(i % 2 == 1, F.lit(WINDOW)).otherwise(0))))
    whole = F.flatten(F.transform("starts", lambda a: F.array(a, a + F.col("windows") - 1 + WINDOW)))
    spans = placed.join(found, "cid").select(*KEY, shifted.alias("spans")).unionByName(placed.join(shared.hint("shuffle_hash"), "anchor", "left_anti").select(*KEY, whole.alias("spans")))
    return dropped(stored(spans.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans")), "covered"), known, contexts, shared, found)


def united(spans) -> list[tuple[int, int]]:
    """The spans (first byte and end, in turn) as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept has the remaining bytes, concatenated."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw = raw_bytes(text)
                gone = united([] if spans is None else [int(x) for x in spans])
                edges = [0, *[x for span in gone for x in span], len(raw)]
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    docs = keyed(docs)
    rows = docs.join(covered(docs).hint("shuffle_hash"), KEY, "left").select("doc_id", "text", "spans")
    return rows.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
