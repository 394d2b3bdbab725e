"""Exact dedup by skew-safe combining of salted digest groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WHITE_CLASS, Few, cut, heavy, table, text_of

SALTS = 64
#: n_codepoints and doc_id in one decimal, so that their order is a plain max() of a fixed-width
#: value and Spark's hash aggregate applies. The low part is 2**63 - doc_id, or 0 for a null id.
_LOW = 2**65


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_CLASS + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _big(n: int, digits: int = 38) -> Column:
    return F.lit(str(n)).cast(f"decimal({digits},0)")


def _rank(n_codepoints: Column, doc_id: Column) -> Column:
    low = F.coalesce(_big(2**63, 20) - doc_id.cast("decimal(20,0)"), F.lit(0))
    return (n_codepoints.cast("decimal(10,0)") * _big(_LOW, 21) + low).cast("decimal(38,0)")


def _doc_id(rank: Column) -> Column:
    low = rank % _big(_LOW)
    return F.when(low > 0, (_big(2**63) - low).cast("long"))


def content_classes(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content of keyed(digest, content, rank): digest, content, rank, size.

    Copies in one input partition meet in the map-side hash aggregate; what is left of a group
    meets by (digest, salt, content), at most ``salts`` rows of it then by (digest, content). The
    content itself is a key of all three, so equal digests never join different texts. The salt is
    the input partition's number: the local winners of a hot group go to up to ``salts`` tasks.
    """
    salted = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("size"))
    return winners.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("size").alias("size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256, n_codepoints.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``. Of equal texts
    the one with the most code points in its original text stays, then the smallest id.

    Null and empty texts are one group. A null id loses every tie and its row's keep_id is null
    only where all ids of the group are null. Repeated rows of one id count separately in
    group_size and share one verdict. Texts of any length are compared whole; an empty table gives
    an empty result. Other columns of docs aren't read. Should two contents ever share a digest,
    their rows are matched by content instead.

    A digest that one row alone has needs no combining: only the others' contents are shuffled.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).alias("n_codepoints"),
        normalised(text).alias("content"),
    ).withColumn("digest", digest(F.col("content")))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("content"))
    slim = cut(rows.select("doc_id", "n_codepoints", "digest", sha.alias("sha")), "exact-digests")
    slim, alone = repeated_digests(slim).split(slim, F.col("digest"))
    some = Few(slim, F.col("doc_id")).split(rows, F.col("doc_id"))[0]
    contents = content_classes(some.withColumn("rank", _rank(F.col("n_codepoints"), F.col("doc_id"))), salts)
    classes = cut(
        contents.groupBy("digest").agg(
            F.count("*").alias("n_contents"), F.max("rank").alias("rank"), F.sum("size").alias("size")
        ),
        "exact-classes",
    )
    total = classes.agg(F.sum("size")).first()[0] or 0
    clash = classes.where("n_contents > 1").select("digest")
    clashing = bool(clash.take(1))

    hot = F.broadcast(heavy(classes, "size", total).select("digest", F.lit(True).alias("hot")))
    found = classes.join(hot, "digest", "left").where("n_contents = 1")
    salt_list = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    found = found.select("digest", "rank", "size", F.explode(salt_list).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "n_codepoints"), F.lit(salts)).cast("int")).otherwise(0)
    slim = slim.join(hot, "digest", "left").withColumn("salt", salt).drop("hot")
    parts = [slim.join(found, ["digest", "salt"])]
    if clashing:
        both = some.join(clash, "digest", "left_semi").withColumn("sha", sha256(F.col("content")))
        parts.append(both.join(contents.join(clash, "digest", "left_semi"), ["digest", "content"]))
    keep_id, longest = _doc_id(F.col("rank")), F.floor(F.col("rank") / _big(_LOW))
    out = [
        p.select(
            "doc_id",
            keep_id.alias("keep_id"),
            F.col("size").alias("group_size"),
            (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_codepoints") == longest)).alias("kept"),
            F.col("sha").alias("text_sha256"),
            F.col("n_codepoints").cast("long").alias("n_codepoints"),
        )
        for p in parts
    ]
    one = F.lit(1).cast("long")
    own = alone.select("doc_id", F.col("doc_id").cast("long").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), F.col("n_codepoints").cast("long").alias("n_codepoints"))
    return reduce(DataFrame.unionByName, [*out, own])


def repeated_digests(rows: DataFrame) -> Few:
    """The digests that more than one row has: a count of digests alone, without their contents."""
    several = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return Few(cut(several, "exact-repeated"), F.col("digest"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """docs without exact copies, all its columns kept; of repeated rows of one id one stays.

    Nulls, empty and very long texts are treated as by exact_dedup; an empty table stays empty. Rows
    whose id is surely not one of those that share their digest with another row go straight on. The
    others meet the winner of their content, and content is compared with content.
    """
    text = text_of(text_col)
    rows = docs.withColumn("__gl_content", normalised(text)).withColumn("__gl_digest", sha256(F.col("__gl_content")))
    rows = rows.withColumn("__gl_rank", _rank(F.length(text), F.col(id_col)))
    slim = cut(rows.select(F.col(id_col).alias("doc_id"), F.col("__gl_digest").alias("digest")), "exact-digests")
    suspects = repeated_digests(slim).split(slim, F.col("digest"))[0]
    some, alone = Few(suspects, F.col("doc_id")).split(rows, F.col(id_col))
    keyed = some.select(*[F.col(f"__gl_{c}").alias(c) for c in ("content", "rank", "digest")])
    classes = cut(content_classes(keyed, salts), "exact-winners")
    total = classes.agg(F.sum("size")).first()[0] or 0
    winners = classes.select("digest", "content", F.col("rank").alias("best"), "size")
    hot = F.broadcast(heavy(classes, "size", total).select("digest", F.lit(True).alias("hot")).distinct())
    salt_list = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    winners = winners.join(hot, "digest", "left").withColumn("salt", F.explode(salt_list))
    winners = winners.select(*[F.col(c).alias(f"__gl_{c}") for c in ("digest", "content", "best", "salt")])
    hot = hot.select(F.col("digest").alias("__gl_digest"), F.col("hot").alias("__gl_hot"))
    salt = F.when(F.col("__gl_hot"), F.pmod(F.xxhash64("__gl_rank"), F.lit(salts)).cast("int")).otherwise(0)
    found = some.join(hot, "__gl_digest", "left").withColumn("__gl_salt", salt).join(winners, ["__gl_digest", "__gl_content", "__gl_salt"])
    once = Window.partitionBy("__gl_digest", "__gl_content", "__gl_rank").orderBy(F.lit(0))
    left = found.where("__gl_rank = __gl_best").withColumn("__gl_n", F.row_number().over(once)).where("__gl_n = 1")
    return left.select(*docs.columns).unionByName(alone.select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup on documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_codepoints,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY n_codepoints DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256, n_codepoints
FROM w
"""
