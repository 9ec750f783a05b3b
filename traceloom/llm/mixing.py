"""Mixing sources to target weights [DataFrame functions only].

Tokens (runs of characters other than ASCII white space) are summed per source. A budget of
``budget`` times all tokens is shared over the sources by weight; no target passes ``cap`` times
its source's tokens, and what is cut off goes to the others by weight. Each document is then
emitted floor(rate) times, and once more with the probability of the rate's fraction, drawn from
a hash of the seed, the document's id and its text.

Cases: null and empty texts have size 0 and follow their source's rate; a null source is a source
of its own, ordered last; sources without tokens get target 0 and emit nothing; repeated rows draw
the same number, so they are taken or left together; an empty table gives an empty result; columns
of the input are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceloom.llm.common import hash_unit, small_or_not, stored

SPACES = " \t\n\x0b\x0c\r"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of each source; the table has one row a source.

    Sources sorted by how soon they reach their cap are filled in that order: a source is capped if
    its share of what the earlier ones leave is above its cap; the first one that is not sets the level.
    """
    sized = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sized.withColumn("place", F.row_number().over(by_code) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    limit = F.col("source_size") * F.lit(cap)
    whole = Window.orderBy(limit / F.col("weight"), "place")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    onward = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(1))
    filled = (
        ranked.withColumn("wanted", F.sum("source_size").over(all_rows) * F.lit(budget))
        .withColumn("used", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("level", (F.col("wanted") - F.col("used")) / F.col("rest"))
        .withColumn("open", F.col("level") * F.col("weight") < limit)
        .withColumn("nth", F.row_number().over(whole))
    )
    level = F.min_by("level", F.when(F.col("open"), F.col("nth"))).over(all_rows)
    return filled.withColumn("set", level).select(
        "source", "source_size", F.least(limit, F.coalesce(F.col("set") * F.col("weight"), limit)).alias("target")
    )


def mixing_plan(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` as struct ``row`` with size, source_size, target and copies."""
    targets = stored(source_targets(docs, weights, budget, cap), "mix-targets").withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = hash_unit(F.lit(seed), F.col("row.doc_id"), F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")))
    return (
        docs.select(F.struct("*").alias("row"))
        .withColumn("size", words(F.col("row.text")))
        .join(small_or_not(targets), F.col("row.source").eqNullSafe(F.col("of_source")))
        .withColumn("copies", (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long"))
        .select("row", "size", "source_size", "target", "copies")
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken."""
    plan = mixing_plan(docs, weights, budget, cap, seed).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS place, source_size * 2.0::DOUBLE AS lim FROM per
), filled AS (
  SELECT *, row_number() OVER w AS nth,
         ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lev
  FROM ranked WINDOW w AS (ORDER BY lim / weight, place)
), lev AS (SELECT arg_min(lev, nth) AS level FROM filled WHERE lev * weight < lim),
targets AS (SELECT source, source_size, least(lim, coalesce(level * weight, lim)) AS target FROM filled LEFT JOIN lev ON true),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(s.doc_id AS VARCHAR), '') || '|' || md5(coalesce(s.text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS drawn
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
