"""Media columns: content-addressed payloads in tar shards.

A text's payload (its UTF-8 bytes, filled with bytes 0 to a positive multiple of 64) is stored as an
8-bit greyscale PNG of 64 samples a line, under the SHA-256 of the payload, as a member of a tar
shard in the shared folder. Shards are named by partition and number, so reruns over the same files give the same names; an attempt
writes beside its shard and moves it there when it is whole, so an attempt that is lost leaves an unreferenced file and nothing else.
A shard holds a payload once, and of several shards that hold one, the smallest location counts: all rows of
equal texts carry that one digest, shard, offset and length. Ranges of
33 bytes at the offsets give width, height and sample size; whole ranges give the payload back.

Cases: null and empty texts have a payload of 64 bytes 0; equal payloads share one location, so the
hottest group of copies costs a row a shard, and what is read meets the rows of digests that hold more than a hundredth of all rows by a
broadcast of at most a hundred rows; very long texts are one tall image; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at; a null
``doc_id`` is kept.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import new_path, stored

LINE = 64
#: Bytes after which a task starts another shard.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
INDEX = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
#: A digest is hot if it has more than this share of the rows.
HOT = 0.01
PLACE = "digest binary, shard string, offset long, length long"
HEADED = f"{PLACE}, width long, height long, sample_bits int"
READ = f"{HEADED}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(LINE, -(-len(raw) // LINE) * LINE), b"\0"), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """The payload as lines of 64 grey samples, each with filter type 0."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    body = zlib.compress(np.pad(lines, ((0, 0), (1, 0))).tobytes(), 6)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and sample bits from the first 33 bytes."""
    if first[:8] != b"\x89PNG\r\n\x1a\n" or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", first[16:25])


def from_png(media: bytes) -> bytes:
    width, height, _ = png_header(media[:HEADER_BYTES])
    at, body = HEADER_BYTES, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected filter type")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean, deviation, and a bit for each of 64 parts that is brighter than the mean."""
    grey = np.frombuffer(payload, np.uint8)
    total = int(grey.sum(dtype=np.int64))
    squares = int((grey.astype(np.int64) ** 2).sum())
    edges = np.arange(LINE) * len(grey) // LINE
    sums = np.add.reduceat(grey.astype(np.int64), edges)
    sizes = np.diff(np.append(edges, len(grey)))
    bits = "".join("1" if a else "0" for a in sums * len(grey) > total * sizes)
    mean = total / len(grey)
    return f"{LINE}x{len(grey) // LINE};mean={mean:.4f};var={squares / len(grey) - mean * mean:.4f};bright={int(bits, 2):016x}"


class _Shards:
    """Writes tar members one after another; a new file begins when one is full.

    A later attempt at a partition can meet its rows in another order, so its shards have names of their own: what an attempt's index rows name, it has written itself.
    Shards of attempts that failed are named by no index row.
    """

    def __init__(self, folder: str, limit: int):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.at, self.known, self.number = limit, None, 0, {}, 0
        task = TaskContext.get()
        self.partition, self.attempt, self.again = (task.partitionId(), task.taskAttemptId(), task.attemptNumber() > 0) if task else (0, 0, False)

    def add(self, digest: bytes, payload: bytes) -> tuple[str, int, int]:
        if digest in self.known:
            return self.known[digest]
        if self.out is None:
            self.name, self.at = f"shard-{self.partition:06d}-{self.number:04d}.tar", 0
            if self.again or self._there():
                self.name = f"shard-{self.partition:06d}-{self.number:04d}-{self.attempt}.tar"
            self.number += 1
            self.out = self.system.open_output_stream(f"{self.folder}/{self.name}.{self.attempt}")
        media = to_png(payload)
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        where = self.known[digest] = (self.name, self.at + 512, len(media))
        self.out.write(media + bytes(-len(media) % 512))
        self.at += 512 + -(-len(media) // 512) * 512
        if self.at >= self.limit:
            self.close()
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            mine = f"{self.folder}/{self.name}.{self.attempt}"
            if self._there():
                self.system.delete_file(mine)
                raise RuntimeError(f"another attempt has written {self.name}")
            self.system.move(mine, f"{self.folder}/{self.name}")
        self.out, self.known = None, {}

    def _there(self) -> bool:
        return self.system.get_file_info(f"{self.folder}/{self.name}").type != fs.FileType.NotFound


def write_media(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Store every text; returns the shards' folder and the written index of ``docs``' rows."""
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = _Shards(folder, shard_bytes)
        for batch in batches:
            found = []
            for text in batch["text"]:
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                found.append((n, digest, *shards.add(digest, payload)))
            rows = pd.DataFrame(found, columns=["n_bytes", "digest", "shard", "offset", "length"])
            rows.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield rows
        shards.close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return folder, stored(texts.mapInPandas(store, INDEX), "media-index")


def locations(index: DataFrame) -> DataFrame:
    """One location of each digest, in order of shard and offset, so that a task reads few shards."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.shard", "at.offset", "at.length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(system: fs.FileSystem, path: str, rows: pd.DataFrame, most: int | None) -> Iterator[bytes]:
    name, file = None, None
    for shard, offset, length in zip(rows["shard"], rows["offset"], rows["length"], strict=True):
        if shard != name:
            if file is not None:
                file.close()
            name, file = shard, system.open_input_file(f"{path}/{shard}")
        yield file.read_at(min(length, most or length), offset)
    if file is not None:
        file.close()


def with_headers(system: fs.FileSystem, path: str, rows: pd.DataFrame) -> pd.DataFrame:
    """Locations with width, height and sample bits, by reading 33 bytes of each."""
    heads = [png_header(x) for x in _ranges(system, path, rows, HEADER_BYTES)]
    return pd.concat([rows.reset_index(drop=True), pd.DataFrame(heads, columns=["width", "height", "sample_bits"])], axis=1)


def header_columns(folder: str, places: DataFrame) -> DataFrame:
    """The locations with what their headers say; nothing else of the stored bytes is read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        for rows in batches:
            yield with_headers(system, path, rows)

    return places.mapInPandas(read, HEADED)


def read_media(folder: str, places: DataFrame) -> DataFrame:
    """As ``header_columns``, with what each location holds, decoded from the bytes that are stored there."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        for rows in batches:
            headed = with_headers(system, path, rows)
            found = []
            for size, media in zip(headed["width"] * headed["height"], _ranges(system, path, rows, None), strict=True):
                payload = from_png(media)
                if len(payload) != size:
                    raise ValueError("a payload isn't what its header says")
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            more = pd.DataFrame(found, columns=[x.split()[0] for x in READ.removeprefix(HEADED + ", ").split(", ")])
            yield pd.concat([headed, more], axis=1)

    return places.mapInPandas(read, READ)


def media_columns(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each row's doc_id and size with the location and the columns of its stored payload."""
    folder, index = write_media(docs, shard_bytes)
    rows = index.select("doc_id", "n_bytes", "digest")
    read = stored(read_media(folder, locations(index)), "media-columns", compression="zstd")
    counted = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > max(1, HOT * index.count())).select("digest")
    hot = stored(read.join(counted, "digest", "left_semi"), "media-hot")
    few = F.broadcast(hot.select("digest"))
    return rows.join(F.broadcast(hot), "digest").unionByName(rows.join(few, "digest", "left_anti").join(read, "digest"))
