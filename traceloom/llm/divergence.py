"""How the vocabulary of each source differs from the other sources of its language, and from the language.

Terms are runs of letters (any character from U+0080 on counts as one; only A-Z are lower-cased). A language keeps the ``V`` terms
that are in at least ``LEAST_DOCS`` of its documents. In a group (language and source) with ``N`` occurrences of kept terms, a term
that occurs ``count`` times has ``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``; a language's ``p`` likewise.

* ``pair``: for each other source of the language, the sum of ``|p - q|`` over all kept terms.
* ``term``: the ``top`` kept terms that the group has and that are more frequent in it than in the language, by ``p - q``.

The sum over terms needs no list of terms: for each pair of sources, joint histograms tally the distinct combinations
(count, count). Combinations without a zero are counted term by term; those with one zero are what a source's own
histogram has more, and the rest of the V terms are the cell (0, 0). ``|p - q|`` is worked out once a cell and multiplied.

Tasks count terms of many documents before anything is shuffled, so a hot source or term adds one row a task. All sums are integers
or decimals; nothing is rounded.

Cases: null text, lang and source are empty texts; a group without terms still gets its pairs (their value is 0 if the language keeps
no term); a source alone in its language has no pairs; ties go to the smaller item by its bytes; repeated rows count each time;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceloom.llm.common import small_or_not, stored

LEAST_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP = 50
#: Entries that a task counts before it hands them over.
TOGETHER = 400_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs), summed over many documents; the empty term has a group's documents."""
    found: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in found.items():
            names = list(docs)
            columns = [pa.array([lang] * len(names), pa.binary()), pa.array([source] * len(names), pa.binary()), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([count[n] for n in names], pa.int64()), pa.array(list(docs.values()), pa.int64())], ["lang", "source", "term", "count", "docs"])
        found.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            count, docs = found.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            terms = terms_of(text.as_py())
            count.update(terms)
            docs.update({*terms, b""})
        if sum(len(docs) for _, docs in found.values()) > TOGETHER:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, total, found: array of (g, count), by g), and the groups (g, lang, source).

    ``g`` is a hash of language and source; should two groups share one, reading the groups fails.
    """
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    counted = docs.select(column("lang"), column("source"), column("text")).mapInArrow(_counted, "lang binary, source binary, term binary, count long, docs long")
    per = counted.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    one = F.struct(F.xxhash64("lang", "source").alias("g"), "count", F.when(F.length("term") == 0, F.col("source")).alias("source"))
    every = per.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.array_sort(F.collect_list(one)).alias("found"))
    every = stored(every.where((F.col("docs") >= least_docs) | (F.length("term") == 0)), "divergence-terms")
    names = every.where(F.length("term") == 0).select("lang", F.explode("found").alias("x")).groupBy("x.g").agg(F.min("lang").alias("lang"), F.min("x.source").alias("source"), F.count("*").alias("n"))
    names = names.where(F.assert_true(F.col("n") == 1, F.lit("two groups share a hash")).isNull())
    return every.where(F.length("term") > 0), names.select("g", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term, exact: in whole numbers, and in decimals of scale 0 where the product would leave 64 bits."""
    whole = lambda c: c.cast("decimal(20,0)")
    among = n + PRIOR * v
    near = F.call_function("div", (count + PRIOR) * F.lit(SCALE), among)
    return F.when(count < 9 * SCALE, near).otherwise(F.call_function("div", whole(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), whole(among))) + 1


def group_sizes(kept: DataFrame, names: DataFrame) -> DataFrame:
    """(g, lang, source, n, v, lang_n) of each group: occurrences of kept terms in it, kept terms and their occurrences in the language."""
    per_group = kept.select(F.explode("found").alias("x")).groupBy("x.g").agg(F.sum("x.count").alias("n"))
    per_lang = kept.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return stored(names.join(per_group, "g", "left").join(per_lang, "lang", "left").select("g", "lang", "source", zero("n"), zero("v"), zero("lang_n")), "divergence-groups")


def joint_cells(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, c1, c2, m): in how many of the language's kept terms group a has count c1 and b has c2, zeros included.

    A term that both have adds one to (c1, c2); a source's own histogram adds to (c1, 0) or (0, c2), less what the joint cells
    hold of it; V adds to (0, 0), less what all others hold.
    """
    one = kept.select("found", F.posexplode("found").alias("i", "x"))
    two = one.select("x", F.explode(F.slice("found", F.col("i") + 2, F.size("found"))).alias("y"))
    both = two.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b"), F.col("x.count").alias("c1"), F.col("y.count").alias("c2")).agg(F.count("*").alias("m"))
    own = kept.select(F.explode("found").alias("x")).groupBy("x.g", "x.count").agg(F.count("*").alias("m"))
    cell = lambda c1, c2, m: F.struct(F.lit(c1).cast("long").alias("c1") if isinstance(c1, int) else F.col(c1).alias("c1"), F.lit(c2).cast("long").alias("c2") if isinstance(c2, int) else F.col(c2).alias("c2"), m.cast("long").alias("m"))
    m = F.col("m")
    tallies = both.select("a", "b", F.explode(F.array(cell("c1", "c2", m), cell("c1", 0, -m), cell(0, "c2", -m), cell(0, 0, m))).alias("t"))
    left = pairs.join(own, F.col("a") == F.col("g")).select("a", "b", F.explode(F.array(cell("count", 0, m), cell(0, 0, -m))).alias("t"))
    right = pairs.join(own, F.col("b") == F.col("g")).select("a", "b", F.explode(F.array(cell(0, "count", m), cell(0, 0, -m))).alias("t"))
    rest = pairs.select("a", "b", cell(0, 0, F.col("v")).alias("t"))
    every = tallies.unionByName(left).unionByName(right).unionByName(rest)
    return every.groupBy("a", "b", F.col("t.c1").alias("c1"), F.col("t.c2").alias("c2")).agg(F.sum("t.m").alias("m")).where("m != 0")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): see above."""
    kept, names = term_counts(docs, least_docs)
    groups = group_sizes(kept, names)
    one = groups.select(F.col("g").alias("a"), "lang", F.col("source").alias("source_a"), F.col("n").alias("n_a"), "v")
    other = groups.select(F.col("g").alias("b"), "lang", F.col("source").alias("source_b"), F.col("n").alias("n_b"))
    pairs = stored(one.join(other, "lang").where("a < b"), "divergence-pairs")
    summed = (
        joint_cells(kept, pairs).join(small_or_not(pairs), ["a", "b"])
        .withColumn("f", F.abs(share(F.col("c1"), F.col("n_a"), F.col("v")) - share(F.col("c2"), F.col("n_b"), F.col("v"))) * F.col("m"))
        .groupBy("a", "b").agg(F.sum("f").alias("value"))
    )
    valued = pairs.join(summed, ["a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    sides = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    by_pair = valued.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    terms = kept.select(F.col("term").cast("string").alias("item"), "total", F.explode("found").alias("x")).select("item", "total", "x.g", "x.count")
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    by_term = terms.join(small_or_not(groups), "g").withColumn("value", p - q).where("value > 0").select("lang", "source", F.lit("term").alias("part"), "item", "value")

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(place))
    return ranked(by_pair).unionByName(ranked(by_term).where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS n,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (SELECT lang, source, n, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
l AS (SELECT x.lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM d) x LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang) USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)::HUGEINT) // (gn.n + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (kept.total + 5)::HUGEINT) // (l.n + 5 * l.v)::HUGEINT AS q
  FROM gn JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(v), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS v FROM p x JOIN p y USING (lang, term) GROUP BY x.lang, x.source, y.source) z
    ON z.lang = a.lang AND z.s1 = a.source AND z.s2 = b.source
  GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
