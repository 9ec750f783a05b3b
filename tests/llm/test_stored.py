"""What a stored table leaves behind, and how many texts Python is handed at once."""

import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from traceloom.llm import near_dedup
from traceloom.llm.common import BATCH, CLEANUP, stored


def test_shuffle_files_go_with_the_table_that_took_them(spark):
    root = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: set(root.rglob("shuffle_*.data"))
    before, kept = files(), spark.conf.get(CLEANUP, None)
    table = stored(spark.range(50_000).groupBy(F.xxhash64("id").alias("h")).count(), "counts")
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 50_000 and spark.conf.get(CLEANUP, None) == kept


def test_near_dedup_hands_few_texts_at_once(spark, monkeypatch):
    seen, kept = [], spark.conf.get(BATCH)
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: seen.append((name, int(spark.conf.get(BATCH)))) or stored(df, name))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60)) + (" end" if i % 2 else "")) for i in range(4)], "doc_id long, text string")
    assert {r.class_id for r in near_dedup.classes(docs).collect()} == {0}
    assert {name: n for name, n in seen if name in ("signatures", "candidate-texts", "verified")} == dict.fromkeys(("signatures", "candidate-texts", "verified"), 500)
    assert spark.conf.get(BATCH) == kept
