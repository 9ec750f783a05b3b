"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text becomes its characters (blanks as ``▁``, one more in front), and adjacent symbols whose joint
string is a piece are candidate merges. The candidate of the best score, leftmost among equals, is merged
first, and its neighbours become new candidates. Each candidate is skipped for good if a hash keyed by
seed, document, place and the two symbols falls below ``DROPOUT``; so one document gets the same pieces in every run, and other
seeds or documents get others. Dropout 0 gives the model's usual pieces. Characters outside the vocabulary
become byte pieces, as does ``▁`` itself, so every segmentation decodes to the very text.

No piece has ``▁`` after another character, so merges stay within units: blanks and what follows
up to the next blank. A task merges the best candidate of all units of many texts at once, with numpy;
units of more than ``LONG`` symbols go through a heap, one by one.

Cases: null and empty texts have no pieces and decode to an empty text; very long texts and units are encoded
whole; a null ``doc_id`` keys the hash as empty text; repeated rows get equal pieces; an empty table gives an empty result;
other columns never reach Python, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
LONG = 256
#: Symbols that a task segments together.
TOGETHER = 400_000
BLANK = "▁"
_NONE = np.int32(1 << 30)
_TABLE_BITS = 17
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


class Pieces:
    """The model's tables: characters, merges by pair, ranks and bytes."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        byte = {int(names[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) != 256 or any(BLANK in names[i].lstrip(BLANK) for i in plain):
            raise ValueError("a model with byte pieces and without inner blanks is needed")
        if n > 1 << 15:
            raise ValueError("a model of at most 32,768 pieces is needed: pairs of ids are keys of 30 bits")
        ids = {names[i]: i for i in plain}
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.chars = np.full(0x110000, -1, np.int32)
        for name, i in ids.items():
            if len(name) == 1 and name != BLANK:
                self.chars[ord(name)] = i
        self.blank = ids[BLANK]
        for cp in range(128):
            if self.chars[cp] < 0:
                self.chars[cp] = byte[cp]
        self.chars[32] = self.blank
        levels = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.zeros(n, np.int32)
        for i in plain:
            self.rank[i] = levels[sp.get_score(i)]
        self.merges = {}
        for name, i in ids.items():
            for k in range(1, len(name)):
                if name[:k] in ids and name[k:] in ids:
                    self.merges[ids[name[:k]], ids[name[k:]]] = i
        self.bytes = self._bytes(names, plain, byte)
        self._index()

    @staticmethod
    def _bytes(names: list[str], plain: list[int], byte: dict[int, int]) -> list[bytes]:
        found = [b""] * len(names)
        for i in plain:
            found[i] = names[i].replace(BLANK, " ").encode()
        for b, i in byte.items():
            found[i] = bytes([b])
        return found

    def _index(self) -> None:
        """Two hash tables, with each pair in one of its two places."""
        self.keys = np.full((2, 1 << _TABLE_BITS), -1, np.int32)
        self.values = np.full((2, 1 << _TABLE_BITS), _NONE, np.int32)
        for (left, right), merged in self.merges.items():
            key, value, side = left << 15 | right, merged, 0
            for _ in range(500):
                at = int(self._place(np.array([key], np.int32), side)[0])
                old = int(self.keys[side, at]), int(self.values[side, at])
                self.keys[side, at], self.values[side, at] = key, value
                if old[0] < 0:
                    break
                (key, value), side = old, 1 - side
            else:
                raise ValueError("the merges don't fit the tables")

    @staticmethod
    def _place(key: np.ndarray, side: int) -> np.ndarray:
        return (key.view(np.uint32) * _MULTIPLIERS[side]) >> np.uint32(32 - _TABLE_BITS)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to, or _NONE."""
        key = (left << np.int32(15)) | right
        a, b = self._place(key, 0), self._place(key, 1)
        return np.where(self.keys[0][a] == key, self.values[0][a], np.where(self.keys[1][b] == key, self.values[1][b], _NONE))


def _skipped(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, dropout: float) -> np.ndarray:
    """The keyed hash: whether the candidate at ``place`` of its text is skipped."""
    x = key ^ (place.astype(np.uint32) * np.uint32(0x9E3779B1))
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B) ^ (left.astype(np.uint32) << np.uint32(16)) ^ right.astype(np.uint32)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39)
    return (x ^ (x >> np.uint32(16))) < np.uint32(min(int(dropout * (1 << 32)), (1 << 32) - 1))


def _by_heap(pieces: Pieces, ids: list[int], place: list[int], key: int, dropout: float) -> tuple[list[int], list[int]]:
    """The pieces of one unit, by an agenda of candidates; ``place`` says where each symbol begins in its text."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []
    live = list(ids)

    def add(i: int, j: int) -> None:
        if i >= 0 and j < n and (to := pieces.merges.get((live[i], live[j]))) is not None:
            parts = np.array([key], np.uint32), np.array([place[i]], np.int64), np.array([live[i]], np.int32), np.array([live[j]], np.int32)
            if not dropout or not _skipped(*parts, dropout)[0]:
                heapq.heappush(agenda, (int(pieces.rank[to]), i, live[i], live[j], to))

    for i in range(n - 1):
        add(i, i + 1)
    while agenda:
        _, i, left, right, to = heapq.heappop(agenda)
        j = after[i]
        if live[i] != left or j >= n or live[j] != right:
            continue
        live[i], live[j] = to, -2
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        add(before[i], i)
        add(i, after[i])
    rest = [i for i in range(n) if live[i] > -2]
    return [live[i] for i in rest], rest


def segment(pieces: Pieces, symbols: np.ndarray, heads: np.ndarray, keys: np.ndarray, places: np.ndarray, dropout: float) -> np.ndarray:
    """The pieces of all texts at the symbols where they begin, and _NONE at the others.

    ``heads`` marks where units begin; ``keys`` and ``places`` are of each symbol: its text's key and its place in the text.
    """
    out = np.full(len(symbols), _NONE, np.int32)
    starts = np.flatnonzero(heads)
    sizes = np.diff(np.append(starts, len(symbols)))
    for s, size in zip(starts[sizes > LONG], sizes[sizes > LONG], strict=True):
        found, at = _by_heap(pieces, symbols[s : s + size].tolist(), places[s : s + size].tolist(), int(keys[s]), dropout)
        out[s + np.array(at)] = found
    live = np.flatnonzero(np.repeat(sizes <= LONG, sizes))
    ids, head = symbols[live], heads[live]

    def candidates(i: np.ndarray) -> np.ndarray:
        """What the symbols at i and i + 1 merge to; _NONE at the end of a unit, or if it is skipped."""
        ok = i + 1 < len(ids)
        j = np.where(ok, i + 1, i)
        to = pieces.merged(ids[i], ids[j])
        to[~ok | head[j]] = _NONE
        if dropout:
            there = np.flatnonzero(to != _NONE)
            a = i[there]
            gone = _skipped(keys[live[a]], places[live[a]], ids[a], ids[a + 1], dropout)
            to[there[gone]] = _NONE
        return to

    rank = np.append(pieces.rank, _NONE)
    of = lambda to: rank[np.minimum(to, len(pieces.rank))]
    to = candidates(np.arange(len(ids))) if len(ids) else ids
    while len(ids):
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(ids)))
        order = of(to)
        best = np.minimum.reduceat(order, first)
        hit = np.flatnonzero((order == np.repeat(best, size)) & (order != _NONE))
        unit = np.cumsum(head)[hit]
        hit = hit[np.diff(unit, prepend=-1) != 0]
        ids[hit] = to[hit]
        stay = np.repeat(best != _NONE, size)
        out[live[~stay]] = ids[~stay]
        stay[hit + 1] = False
        moved = np.cumsum(stay) - 1
        again = np.concatenate([moved[hit], (moved[hit] - 1)[~head[hit]]])
        ids, head, live, to = ids[stay], head[stay], live[stay], to[stay]
        if len(again):
            to[again] = candidates(again)
    return out


def key_of(doc_id, seed: int = SEED) -> int:
    return zlib.crc32(f"{seed}|{'' if doc_id is None else doc_id}".encode())


def encode_texts(pieces: Pieces, texts: list[str], keys: list[int], dropout: float = DROPOUT) -> list[np.ndarray]:
    """The piece ids of each text."""
    points = [np.frombuffer((" " + t if t else "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    every = np.concatenate(points) if points else np.zeros(0, np.uint32)
    symbols = pieces.chars[every]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    heads = np.zeros(len(every), bool)
    blank, foreign = symbols == pieces.blank, symbols < 0
    heads[1:] = (blank[1:] & ~blank[:-1]) | foreign[1:] | foreign[:-1]
    heads[starts[sizes > 0]] = True
    every_key = np.repeat(np.array(keys, np.uint32), sizes)
    places = np.arange(len(every)) - np.repeat(starts, sizes)
    out = segment(pieces, symbols, heads, every_key, places, dropout)
    count = (out != _NONE).astype(np.int64)
    unknown = np.flatnonzero(foreign)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in every[unknown].tolist()]
    count[unknown] = [len(b) for b in raw]
    before = np.concatenate([[0], np.cumsum(count)])
    found = np.repeat(out, count)
    for at, b in zip(before[unknown].tolist(), raw, strict=True):
        found[at : at + len(b)] = pieces.byte[list(b)]
    return [found[before[s] : before[e]] for s, e in zip(starts, ends, strict=True)]


def decode_ids(pieces: Pieces, ids) -> str:
    """The text that the ids were made of."""
    return b"".join(map(pieces.bytes.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


_loaded: dict[str, Pieces] = {}


def loaded(model: str) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _in_groups(texts, doc_ids, seed: int) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and their keys, about ``TOGETHER`` symbols at once."""
    held: list[str] = []
    keys: list[int] = []
    size = 0
    for text, doc_id in zip(texts, doc_ids, strict=True):
        held.append(text or "")
        keys.append(key_of(doc_id, seed))
        size += len(held[-1])
        if size >= TOGETHER:
            yield held, keys
            held, keys, size = [], [], 0
    if held:
        yield held, keys


def encode(docs: DataFrame, keep: list[str], model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(row, ids): the columns ``keep`` of each row of ``docs`` as a struct, and the piece ids of its ``text``.

    A task hands over the ids of about ``TOGETHER`` symbols at once, so it never holds those of a whole batch.
    """
    text, doc_id = F.col("text"), F.col("doc_id")
    rows = docs.select(F.struct(*keep).alias("row"), text.cast("string").alias("text"), doc_id.cast("string").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            at = 0
            every, keys = batch.column(1), batch.column(2)
            for texts, own in _in_groups((x.as_py() for x in every), (x.as_py() for x in keys), seed):
                found = encode_texts(pieces, texts, own, dropout)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], ["row", "ids"])
                at += len(texts)

    out = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, out)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text that ``ids`` were made of; empty for null."""

    @F.pandas_udf("string")
    def of(lists: pd.Series) -> pd.Series:
        pieces = loaded(model)
        return pd.Series(["" if x is None else decode_ids(pieces, x) for x in lists], dtype=object)

    return of(ids)


def round_trip(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded_sha256, lossless) of each row: encoded, then decoded from the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model)
        for batch in batches:
            found = []
            for texts, keys in _in_groups(batch["text"], batch["key"], seed):
                for text, ids in zip(texts, encode_texts(pieces, texts, keys, dropout), strict=True):
                    decoded = decode_ids(pieces, ids.tolist())
                    found.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded == text))
            out = pd.DataFrame(found, columns=["n_pieces", "ids_sha256", "decoded_sha256", "lossless"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean")
