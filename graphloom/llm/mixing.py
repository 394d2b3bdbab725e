"""Mixing sources to target weights: hash-random order, range prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, n_words, table, text_of

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No source may be repeated more often.
MOST_EPOCHS = 3
#: Ranges of the random key inside a source: three hex digits, and so many times three more inside the one range where a cut falls.
RANGE_DIGITS, LEVELS = 3, 2


def random_key(doc_id: Column) -> Column:
    """A uniform key in hex, the same in every run; a null id has one as well."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources(source, source_size) with the target of each: shares by weight, none over most sizes.

    Water-filling: sources fill up in the order of size / weight. A source is at its cap if the
    fair share of it and all later ones is over its cap; the rest share what is left by weight.
    """
    n, values = F.lit(len(weights)), F.array(*map(F.lit, weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.get(values, (F.row_number().over(order) - 1) % n).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(after))
        .withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    )
    free_left, free_w = (F.max(F.when(~F.col("capped"), F.col(c))).over(everything) for c in ("left", "w_left"))
    share = (free_left * F.col("w")).cast("double") / free_w.cast("double")
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows(doc_id, source, size, key) and one row per source where its mix ends.

    cuts(source, source_size, target, epochs, cut_key, cut_id, cut_words): every document is taken
    ``epochs`` times; one more time those whose (key, id) comes before (cut_key, cut_id), and of
    that one itself its first cut_words words. cut_key is null where whole epochs meet the target.

    The random key is uniform, so its leading digits are a range partitioning known beforehand:
    sizes are summed by (source, range), prefix sums run over the at most 4096 ranges of a source,
    and the one range in which the target is met is divided again. What is left, one row in 16
    million of a source's, is sorted row by row.
    """
    text = text_of(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(text).alias("size"),
            random_key(F.col(id_col)).alias("key"),
        ),
        "mix-rows",
    )
    ranges = cut(rows.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("part")).agg(F.sum("size").alias("words")), "mix-ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), **kw)
    goal = goal.withColumn("whole", F.round("target").cast("long")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(0)
    )
    goal = cut(goal.withColumn("rest", F.col("whole") - F.col("epochs") * F.col("source_size")), "mix-targets")

    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = goal.select(F.col("source").alias("g_source"), "rest", F.lit("").alias("g_part"), F.lit(0).cast("long").alias("start"))
    for level in range(1, LEVELS + 1):
        if level > 1:
            finer = F.substring("key", 1, RANGE_DIGITS * level)
            inside = rows.join(at, F.col("source").eqNullSafe(F.col("g_source")) & F.startswith("key", F.col("g_part")))
            ranges = inside.groupBy("source", finer.alias("part")).agg(F.sum("size").alias("words"))
        summed = ranges.withColumn("sum", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
        near = at.select("g_source", "rest", "start")
        found = summed.join(near, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("before", F.col("start") + F.col("sum"))
        found = found.where("rest > before AND rest <= before + words")
        at = cut(found.select("g_source", "rest", F.col("part").alias("g_part"), F.col("before").alias("start")), "mix-cut-range")
    at = at.withColumnRenamed("start", "before")
    part = F.substring("key", 1, RANGE_DIGITS * LEVELS)
    inside = rows.join(at, F.col("source").eqNullSafe(F.col("g_source")) & (part == F.col("g_part")))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    last = inside.where("rest > start AND rest <= start + size").select(
        "g_source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), (F.col("rest") - F.col("start")).alias("cut_words")
    )
    cuts = goal.join(last, F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_source", "whole", "rest")
    return rows, cut(cuts, "mix-cuts")


def _order(key: Column, doc_id: Column) -> tuple[Column, Column]:
    """(the row is before the cut, the row is the cut)."""
    same = (key == F.col("cut_key")) & doc_id.eqNullSafe(F.col("cut_id"))
    earlier = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.coalesce(doc_id < F.col("cut_id"), doc_id.isNull() & F.col("cut_id").isNotNull())))
    return F.coalesce(earlier, F.lit(False)), F.coalesce(same, F.lit(False))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken, epochs.

    size counts runs of characters other than ``[\\x20\\x09-\\x0D]``; a null text has size 0. A null
    source is a source, the last one. taken is the words the mix takes of the row, repeats
    counted: whole epochs, then the source's random order up to the exact word where its rounded
    target is met. Rows that share an id are at one place of that order, so that a cut at such an
    id takes the same words of each. Sources without words have target 0; an empty table gives an
    empty result; a text of any length is counted whole. Weights go by the sources' order, so one
    task orders the table of sources, one row each; Spark broadcasts it only below its own size
    threshold.
    """
    rows, cuts = plan_mix(docs, **kw)
    c = cuts.withColumnRenamed("source", "c_source")
    joined = rows.join(c, F.col("source").eqNullSafe(F.col("c_source")))
    earlier, same = _order(F.col("key"), F.col("doc_id"))
    more = F.when(earlier, F.col("size")).when(same, F.least("cut_words", "size")).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).alias("taken"), "epochs")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of the mix with the columns of docs: each as many times as the mix starts it.

    The document at the cut is taken whole, so a source may pass its target by a part of one
    document. Texts are not shuffled: the cut is a comparison with one row per source. A null source
    is a source; a null or empty text has no words and comes along with those before the cut; an
    empty table stays empty.
    """
    _, cuts = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    c = cuts.select(F.col("source").alias("__gl_source"), "epochs", "cut_key", "cut_id")
    c = c.select("__gl_source", *[F.col(x).alias(f"__gl_{x}") for x in c.columns[1:]])
    key = random_key(F.col(id_col))
    at_key, at_id = F.col("__gl_cut_key"), F.col("__gl_cut_id")
    doc_id = F.col(id_col)
    up_to = (key < at_key) | ((key == at_key) & (doc_id.eqNullSafe(at_id) | F.coalesce(doc_id < at_id, doc_id.isNull())))
    copies = F.col("__gl_epochs") + F.when(F.coalesce(up_to, F.lit(False)), 1).otherwise(0)
    joined = docs.join(c, F.col(source_col).eqNullSafe(F.col("__gl_source")))
    joined = joined.withColumn("__gl_copies", copies.cast("int")).where("__gl_copies > 0")
    return joined.withColumn("__gl_copy", F.explode(F.sequence(F.lit(1), F.col("__gl_copies")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix on all documents."""
    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT
                - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining,
             (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left
      FROM w),
g AS (SELECT *, cap * w_left <= remaining * w AS capped FROM f),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN cap::DOUBLE
                  ELSE (max(remaining) FILTER (NOT capped) OVER () * w)::DOUBLE / (max(w_left) FILTER (NOT capped) OVER ())::DOUBLE END AS target
      FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT r.doc_id, r.size, e.source_size, e.target, e.epochs,
             round(e.target)::BIGINT - e.epochs * e.source_size AS rest,
             coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, rest - start)) AS taken, epochs FROM p
"""
