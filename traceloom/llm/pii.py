"""Personal data by bootstrapped contextual extraction.

Fixed expressions find emails, ip addresses, card and phone numbers (the base) and well-formed secrets;
these are the seeds. What stands to the left of a seed, two or three lexical units (a word or a
mark) on its line, is a pattern. Patterns and the identifiers that they precede, known or not, form a
graph, which Spark scores in rounds: a pattern's confidence in a kind is the share of its
different identifiers that are known as that kind, and an unknown identifier is as sure as its
confident patterns together make it. Identifiers that pass ``SURE`` are reported wherever they occur.
Patterns without a seed stay in the graph: identifiers found in one round can make them sure in a later one. Rounds end
when none raises an identifier's score to a new hundredth.

An identifier counts once for a pattern however many documents repeat it, so copies don't make a
pattern sure. The graph holds a digest in place of an identifier's text.

Cases: null and empty texts have no spans; texts are read whole; base spans are reported as the
expressions find them, and other spans never overlap them; repeated rows get equal results, and
null ids are kept; an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import small_or_not, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: The base expressions. An email's local part is the whole run before its @.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What may be an identifier, and what is one for certain.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{5,}")
SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}")
UNIT = re.compile(r"[^\W\d_]+|[^\w\s]")
#: Characters to the left of an identifier in which its units are looked for, and pattern lengths.
REACH = 80
LENGTHS = (2, 3)
#: A pattern needs so many different identifiers; its confidence divides by their number plus one.
LEAST = 3
CONFIDENT = 0.6
SURE = 0.8
CANDIDATE = "struct<start:long,end:long,kind:string,instance:long,patterns:array<string>>"
ROW = f"rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:long,place:int,end:long>>, candidates array<{CANDIDATE}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


def patterns_before(text: str, start: int) -> list[str]:
    """The lexical patterns that end where an identifier starts."""
    near = text[max(0, start - REACH) : start].rpartition("\n")[2]
    units = [u.lower() for u in UNIT.findall(near)]
    return [" ".join(units[-n:]) for n in LENGTHS if len(units) >= n]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind or None, digest, patterns) of the base spans and of what may be an identifier beside them."""
    found = [(a, b, BASE[k]) for a, k, b in base]
    taken, i = sorted((a, b) for a, _, b in base), 0
    end = 0
    for m in IDENTIFIER.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            end = max(end, taken[i][1])
            i += 1
        if end <= m.start():
            found.append((m.start(), m.end(), "secret" if SECRET.fullmatch(m.group()) else None))
    return [(a, b, kind, int.from_bytes(hashlib.blake2b(text[a:b].encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), patterns_before(text, a)) for a, b, kind in found]


def scan(docs: DataFrame) -> DataFrame:
    """A stored row for each row of ``docs``: base counts and spans, and candidates with their patterns."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((*counts, base, candidates(text, base)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "candidates"])
            out.insert(0, "rid", batch["rid"].to_numpy())
            out.insert(1, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInPandas(read, ROW), "pii-rows")


def occurrences(rows: DataFrame) -> DataFrame:
    return rows.select("rid", F.explode("candidates").alias("c")).select("rid", "c.*")


def sure_instances(found: DataFrame) -> DataFrame:
    """(instance, kind) of what is known or becomes sure, by rounds over the pattern-instance graph."""
    every = found.groupBy("instance").agg(F.max("kind").alias("kind"))
    edges = found.select("instance", F.explode("patterns").alias("pattern")).distinct().join(every, "instance")
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree"))
    edges = stored(edges.join(degree.where(F.col("degree") >= LEAST), "pattern"), "pii-graph")
    seeds = every.where("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("score"))
    scores = stored(seeds, "pii-seeds")
    tops = seeds.limit(0).select("instance", "kind", F.lit(0).alias("top"))
    while True:
        trust = (
            edges.select("pattern", "degree", "instance").join(scores, "instance").groupBy("pattern", "kind").agg((F.sum("score") / (F.max("degree") + 1)).alias("trust")).where(F.col("trust") >= CONFIDENT)
        )
        guessed = edges.where("kind IS NULL").select("instance", "pattern").join(trust, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        best = guessed.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", "best.kind", "best.score")
        best = stored(best, "pii-best")
        scores = seeds.unionByName(best)
        # a score's highest hundredth only grows, so the rounds end even if kinds take turns
        raised = best.select("instance", "kind", F.floor(F.col("score") * 100).cast("int").alias("top")).join(tops.withColumnRenamed("top", "old"), ["instance", "kind"], "left").where("top > coalesce(old, -1)")
        if raised.isEmpty():
            break
        tops = stored(tops.unionByName(raised.select("instance", "kind", "top")).groupBy("instance", "kind").agg(F.max("top").alias("top")), "pii-tops")
    return scores.where(F.col("score") >= SURE).select("instance", "kind")


def find_pii(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n_email, n_ip, n_card, n_phone, base, spans) of each row; ``base`` and ``spans`` hold (start, place, end)."""
    rows = scan(docs)
    found = occurrences(rows)
    sure = sure_instances(found)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("sure.kind")).cast("int") - 1
    added = (
        found.alias("found").where(F.col("kind").isNull() | (F.col("kind") == "secret")).join(small_or_not(sure).alias("sure"), "instance")
        .groupBy("rid").agg(F.collect_list(F.struct("start", place.alias("place"), "end")).alias("added"))
    )
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:long,place:int,end:long>>"))))
    return rows.join(added, "rid", "left").select("rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def written(spans: str):
    """``kind:start:end`` of the spans in the column, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
