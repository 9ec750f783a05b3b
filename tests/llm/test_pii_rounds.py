"""Identifiers that stand only behind patterns which other found identifiers make sure."""

import random

from traceloom.llm import pii


def test_found_identifiers_make_new_patterns_sure(spark):
    rng = random.Random(3)
    seeds = ["AKIA7" + "".join(rng.choices("ABCDEFGHIJKLMNOP", k=15)) for _ in range(40)]
    first, second, third = ([f"{kind}-{i}-77" for i in range(8)] for kind in ("first", "second", "third"))
    texts = [f"the vault token {x}" for x in seeds + first] + [f"our backup phrase {x}" for x in first + second[:1]]
    texts += [f"an ordinary ticket {x}" for x in third]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: len(r.spans) for r in pii.find_pii(docs).collect()}
    assert found == {i: 0 if "ticket" in t else 1 for i, t in enumerate(texts)}
