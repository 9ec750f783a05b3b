"""Base spans against the literal expressions, and discovery on a small corpus."""

import re

from traceloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    "", "mail a.b@c.de, x@y (z@w.v.u) @a.b q@-.-.", "a@b@c.d e@f..g", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 12.34 1.2.3 9.9.9.9999",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111111111 12 3", "+1 (555) 123-4567 +12 3 ++49 30 1234567- +(1) 2 +1 2345678.", "é+1 234 567 890 ü a@é.de b@c.dé",
    "x" * 3000 + "@" + "y" * 50 + ".com", "0" * 5000, "1.1.1.1@a.b 5.5.5.5+1 222 333 444",
]


def brute(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(found)


def test_base_spans():
    for text in TEXTS:
        assert pii.base_spans(text) == brute(text), text[:60]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_patterns_discover_unseen_identifiers(spark):
    known = [f"log entry {'x' * i} password = {i:02d}ab45cdef1234{i:02d}abcd end" for i in range(8)]
    texts = [*known, "again password = hunter2024 done", "version hunter1999 is fine", None, "", "same text", "same text"]
    docs = spark.createDataFrame([(i if t else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (r.base, r.spans) for r in pii.find_pii(docs).select("doc_id", pii.written("base").alias("base"), pii.written("spans").alias("spans")).collect()}
    start = texts[8].index("hunter")
    assert found[8] == ("", f"secret:{start}:{start + 10}")
    assert found[9] == ("", "")
    assert all(found[i][1].startswith("secret:") for i in range(8))


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
