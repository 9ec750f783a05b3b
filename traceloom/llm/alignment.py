"""Aligning the tokens of two tokenizers over the bytes of each text.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (pieces, which adds the blank itself) the text; special tokens
are never made, their strings are plain text. Packed bitsets mark the bytes at which a token ends. Their AND has the
shared cuts; the popcount before a cut is its rank among the tokens of either side, so cuts become token ranges: the groups.
Each bit of their OR ends a stretch of bytes that lies in one token of A and one of B, and each overlapping pair of
tokens has one such stretch: the ranks before it are the pair's tokens, so the OR expands the groups to all links.

Both tokenizers always cut where white space begins after other characters, if it begins with a blank, tab or line feed
(A's pattern has no token across, and B has no piece with a blank after another character, and encodes tabs and line feeds as
bytes). So texts are aligned in such words, each once per task as long as it is remembered (``WORDS``, ``WORD_BYTES``), and a text's
values are sums over its words; other white space stays within a word. A test holds that against whole texts.

Links are written as rows' lists of pairs of ids, then counted and looked up by Spark. Pairs meet their counts in two ways: the most
frequent ones, at most ``HEAD`` whatever the corpus, by a broadcast; links with any other pair by a shuffle. A rare pair has few
links, so no key of that shuffle is hot.

Texts are encoded once. The tokenizers' files are needed at the same path on every machine (or shipped with ``SparkContext.addFile``).

Cases: null and empty texts, and texts whose joined tokens of A or B aren't the blank and the text (say, with U+2581), have no
tokens: zeros and an empty string, and they count nothing; very long texts and words are aligned whole; repeated rows count each time; ties for
a B id's highest count all count as best; an empty table gives an empty result; other columns never reach Python, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from traceloom.llm.common import stored

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of ids whose counts every task gets.
HEAD = 1 << 18
#: Words, and bytes of words, that a task remembers.
WORDS = 250_000
WORD_BYTES = 1 << 25
#: Characters of words that are encoded as one text.
JOINED = 1 << 16
#: Characters of texts that a task aligns together.
TOGETHER = 1 << 21
BLANK = "▁"
LONGS = ("n_a", "n_b", "n_groups", "n_links")
_WORD = re.compile(r"\s+\S*")
_OPENERS = " \t\n"
#: White space to one of the tokenizers, but not to Python.
_ODD = "\u180e"


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens as lengths and one string."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides, of a text that begins with white space. One that doesn't begin with a blank gets one from B, which is taken away."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if text == " ":
            return a, [self.b.piece_to_id(BLANK)]
        return a, self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def named(self, a: list[int], b: list[int], cut_a: list[int], cut_b: list[int]) -> list[str]:
        """Each group as ``a1,a2|b1``."""
        found, at_a, at_b = [], 0, 0
        for to_a, to_b in zip(cut_a, cut_b, strict=True):
            if to_a == at_a + 1 and to_b == at_b + 1:
                found.append(f"{a[at_a]}|{b[at_b]}")
            else:
                found.append(f"{','.join(map(str, a[at_a:to_a]))}|{','.join(map(str, b[at_b:to_b]))}")
            at_a, at_b = to_a, to_b
        return found


_loaded: dict[tuple[str, str], Tokenizers] = {}


def loaded(a_file: str, b_file: str) -> Tokenizers:
    if (a_file, b_file) not in _loaded:
        _loaded[a_file, b_file] = Tokenizers(a_file, b_file)
    return _loaded[a_file, b_file]


class Ends:
    """A bitset of byte places, packed in 64-bit words, with the popcounts before each."""

    def __init__(self, places: np.ndarray, size: int):
        bits = np.zeros((size + 63) // 64 * 64, bool)
        bits[places] = True
        self._set(np.packbits(bits, bitorder="little").view("<u8"))

    def _set(self, packed: np.ndarray) -> None:
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @classmethod
    def of(cls, packed: np.ndarray) -> Ends:
        self = cls.__new__(cls)
        self._set(packed)
        return self

    def __and__(self, other: Ends) -> Ends:
        return Ends.of(self.packed & other.packed)

    def __or__(self, other: Ends) -> Ends:
        return Ends.of(self.packed | other.packed)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        at, bit = places >> 6, (places & 63).astype(np.uint64)
        partly = np.append(self.packed, np.uint64(0))[at] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[at] + np.bitwise_count(partly)

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.packed.view(np.uint8), bitorder="little"))


def aligned(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of tokens that end at the given places (the byte after the last is ``size``): the number of A and of B tokens up to
    each shared cut, the A and the B token of each link, the cuts, and where the links' stretches of bytes end."""
    a, b = Ends(a_ends - 1, size), Ends(b_ends - 1, size)
    cuts, stretches = (a & b).select() + 1, (a | b).select()
    return a.rank(cuts), b.rank(cuts), a.rank(stretches), b.rank(stretches), cuts, stretches


class Words:
    """Aligned words of a task: values a word, and its links as pairs of ids (``a << 32 | b``)."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.groups: list[str] = []
        # a row a word: A tokens, B tokens, groups; and where its links end
        self.values = np.zeros((0, 3), np.int64)
        self.ends = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        self.valid = np.zeros(0, bool)

    def full(self) -> bool:
        return len(self.place) > WORDS or self.bytes > WORD_BYTES

    def add(self, words: list[str]) -> None:
        """Align new words: the usual ones as one text, of about ``JOINED`` characters, the others one by one."""
        held: list[str] = []
        size = 0
        for word in words:
            if not word[-1].isspace() and BLANK not in word and _ODD not in word:
                held.append(word)
                size += len(word)
            else:
                self._align([word])
            if size >= JOINED:
                self._align(held)
                held, size = [], 0
        if held:
            self._align(held)

    def _align(self, words: list[str]) -> None:
        t = self.tokenizers
        joined = "".join(words)
        raw = joined.encode("utf-8", "surrogatepass")
        a, b = t.encode(joined)
        ok = b"".join(map(t.a_bytes.__getitem__, a)) == raw == b"".join(map(t.b_bytes.__getitem__, b))
        if not ok and len(words) > 1:
            for word in words:
                self._align([word])
            return
        sizes = np.array([len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)
        self.bytes += len(raw)
        self.place.update(zip(words, range(len(self.groups), len(self.groups) + len(words)), strict=True))
        self.valid = np.concatenate([self.valid, np.full(len(words), ok)])
        if not ok:
            self.groups.append("")
            self.values = np.concatenate([self.values, np.zeros((1, 3), np.int64)])
            self.ends = np.append(self.ends, self.ends[-1])
            return
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        cut_a, cut_b, link_a, link_b, cuts, stretches = aligned(np.cumsum(t.a_sizes[ids_a]), np.cumsum(t.b_sizes[ids_b]), len(raw))
        # a word ends at a shared cut
        ends = np.cumsum(sizes)
        groups_to, links_to = np.searchsorted(cuts, ends, "right"), np.searchsorted(stretches, ends, "left")
        n_a, n_b = np.diff(cut_a[groups_to - 1], prepend=0), np.diff(cut_b[groups_to - 1], prepend=0)
        named = t.named(a, b, cut_a.tolist(), cut_b.tolist())
        at = 0
        for to in groups_to.tolist():
            self.groups.append(named[at] if to == at + 1 else ";".join(named[at:to]))
            at = to
        self.values = np.concatenate([self.values, np.stack([n_a, n_b, np.diff(groups_to, prepend=0)], axis=1)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + links_to])
        self.links = np.concatenate([self.links, ids_a[link_a] << 32 | ids_b[link_b]])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words of all texts, and where each text's end."""
        every: list[str] = []
        ends = []
        for text in texts:
            if text:
                every.extend(words_of(" " + text))
            ends.append(len(every))
        found = list(map(self.place.get, every))
        if None in found:
            self.add(list({w: None for w, at in zip(every, found, strict=True) if at is None}))
            found = list(map(self.place.__getitem__, every))
        places, to = np.array(found, np.int64), np.array(ends, np.int64)
        wrong = np.flatnonzero(~self.valid[places])
        if len(wrong):
            # a text with a word that isn't the same in bytes has no tokens
            bad = np.unique(np.searchsorted(to, wrong, "right"))
            stay = ~np.isin(np.repeat(np.arange(len(to)), np.diff(to, prepend=0)), bad)
            places, to = places[stay], np.concatenate([[0], np.cumsum(stay)])[to]
        return places, to


def words_of(text: str) -> list[str]:
    """The words of a text that begins with a blank: white space and what follows it."""
    words = _WORD.findall(text)
    if _ODD in text:
        return [text]
    if all(w[0] in _OPENERS for w in words):
        return words
    joined: list[list[str]] = []
    for w in words:
        if w[0] in _OPENERS:
            joined.append([])
        joined[-1].append(w)
    return ["".join(ws) for ws in joined]


def sums(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sums of rows up to each end since the one before."""
    run = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return np.diff(run[to], axis=0, prepend=run[:1])


def _in_groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts), about ``TOGETHER`` characters at once."""
    held: list[str] = []
    first = size = 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def _spread(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of the words ``which``, and how many each has."""
    start, n = ends[which], ends[which + 1] - ends[which]
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n


def _encode(a_file: str, b_file: str):
    """A task's function: each row with the values of its text, and its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(loaded(a_file, b_file))
        for batch in batches:
            for first, texts in _in_groups(batch.column(1)):
                if words.full():
                    words.clear()
                places, to = words.texts(texts)
                values = sums(words.values[places], to)
                links, n = _spread(words.ends, places)
                link_to = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], to])].astype(np.int32)
                named, at, of = [], 0, words.groups.__getitem__
                for end in to.tolist():
                    named.append(hashlib.sha256(";".join(map(of, places[at:end].tolist())).encode()).hexdigest() if end > at else "")
                    at = end
                longs = [*(values[:, i] for i in range(3)), np.diff(link_to).astype(np.int64)]
                pairs = pa.ListArray.from_arrays(pa.array(link_to), pa.array(words.links[links]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *map(pa.array, longs), pa.array(named, pa.string()), pairs], ["row", *LONGS, "groups_sha256", "links"])

    return run


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, count, best) of each pair of ids that is linked; best: no A id has more links with that B id. Stored."""
    counts = stored(encoded.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "alignment-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # as many rows as B has ids
    highest = F.broadcast(counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest")))
    return stored(counts.join(highest, b_id == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")), "alignment-pairs")


def _least_of_head(counts: DataFrame, head: int) -> int:
    """The least count of which all pairs with as many links or more are at most ``head``: an edge between eighths of powers of two."""
    eighth = F.floor(F.log2("count") * 8)
    edges = counts.groupBy(eighth.alias("eighth")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("eighth")).collect()
    least, n = (1 << 63) - 1, 0
    for row in edges:
        n += row.n
        if n > head:
            break
        least = row.least
    return least


def align(docs: DataFrame, keep: list[str] | None = None, a_file: str = A_FILE, b_file: str = B_FILE, head: int = HEAD) -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``, with the columns ``keep`` (all, if none are named) in ``row``."""
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").cast("string").alias("text"))
    longs = [StructField(c, LongType()) for c in LONGS]
    schema = StructType([rows.schema["row"], *longs, StructField("groups_sha256", StringType()), StructField("links", ArrayType(LongType()))])
    encoded = stored(rows.mapInArrow(_encode(a_file, b_file), schema), "alignment-links", "zstd")
    counts = pair_counts(encoded)
    least = _least_of_head(counts, head)
    # at most ``head`` rows
    frequent = F.broadcast(counts.where(F.col("count") >= least))
    rare = counts.where(F.col("count") < least)
    # a written row is known by its file and place
    placed = encoded.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth"))
    links = placed.select("file", "nth", F.explode("links").alias("pair"))
    found = links.join(frequent, "pair")
    if not rare.isEmpty():
        found = found.unionByName(links.join(frequent, "pair", "left_anti").join(rare, "pair"))
    added = found.groupBy("file", "nth").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return placed.join(added, ["file", "nth"], "left").select("row", *LONGS, zero("n_best"), zero("count_sum"), "groups_sha256")
