"""URL filter by rules and lists, decided through a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import BITS, HASHES, MOST_WORDS, Few, ascii_lower, bloom_words, cut, heavy, join_hot, passes, table

#: (rule, verdict): host, then path from its first slash on.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Domains that the list blocks with all their subdomains where no rule fits.
BLOCKED = (
    "ads-track.example.org",
    "casino-win.example.org",
    "cheap-pills.example.com",
    "free-bets.example.com",
    "spam-farm.example.org",
)
#: Kinds of keys, each a column, that the cascade is asked for at most.
MOST_SHAPES = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _lower(text: str) -> str:
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """A short list of (rule, verdict) as a table, from literals."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules])
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def domain_table(spark: SparkSession, domains: tuple[str, ...]) -> DataFrame:
    if not domains:
        return spark.range(0).select(F.lit("").alias("domain"))
    return spark.range(1).select(F.explode(F.array(*map(F.lit, domains))).alias("domain"))


def listed_keys(rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """(key, kind, labels, path_length) of rules(rule, verdict) and blocked(domain); a null is no entry.

    A rule's key is a or b, for allow or block, then its host, lower-cased, and its path; a domain's
    is d and the domain. So a key's membership tells the verdict, and no table has to be looked up.
    """
    host, path = F.substring_index("rule", "/", 1), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    kind = F.when(F.col("verdict") == "allow", "a").when(F.col("verdict") == "block", "b").otherwise(F.raise_error(F.lit("a verdict is allow or block")))
    own = rules.where("rule is not null").select(kind.alias("kind"), ascii_lower(host).alias("host"), path.alias("path"))
    own = own.unionByName(blocked.where("domain is not null").select(F.lit("d").alias("kind"), ascii_lower(F.col("domain")).alias("host"), F.lit("").alias("path")))
    labels = F.size(F.split("host", r"\."))
    return own.select(F.concat("kind", "host", "path").alias("key"), "kind", labels.alias("labels"), F.length("path").alias("path_length"))


@dataclass(frozen=True)
class KeyShape:
    """Which keys of a url can be in the lists at all: kinds, numbers of labels and lengths of paths that entries have."""

    shapes: tuple[tuple[str, int, int], ...]

    @staticmethod
    def of(listed: DataFrame, most: int) -> KeyShape | None:
        """The shapes of listed_keys(), or None if there are more than ``most``."""
        found = listed.select("kind", "labels", "path_length").distinct().limit(most + 1).collect()
        return KeyShape(tuple(sorted(tuple(r) for r in found))) if len(found) <= most else None

    def keys(self, host: Column, path: Column) -> list[Column]:
        """The url's key of each shape, null where it is too short for it."""
        n_labels = F.size(F.split(host, r"\."))
        return [
            F.when((n_labels >= n) & (F.length(path) >= p), F.concat(F.lit(kind), F.substring_index(host, ".", -n), F.substring(path, 1, p)))
            for kind, n, p in self.shapes
        ]


class BloomCascade:
    """Exact membership in a list for every key of a known universe, the corpus's own keys.

    Level 0 encodes the listed keys. Level 1 encodes the other universe keys that pass level 0,
    level 2 the listed keys that pass level 1, and so on until no key passes wrongly. A key's
    answer is decided by the first level that it doesn't pass; no join is needed. Each level is
    one row in the shared folder that Spark reads as a scalar subquery, of at most MOST_WORDS words.
    """

    def __init__(self, levels: list[tuple[DataFrame, int, int]], last_listed: bool) -> None:
        self.levels, self.last_listed = levels, last_listed

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame, bits: int = BITS, hashes: int = HASHES) -> BloomCascade:
        """listed(key) and universe(key); repeated and null keys don't matter."""
        both = listed.select("key", F.lit(True).alias("on")).unionByName(universe.select("key", F.lit(False).alias("on")))
        known = cut(both.where("key is not null").groupBy("key").agg(F.max("on").alias("on")), "url-universe")
        levels: list[tuple[DataFrame, int, int]] = []
        passing, other = known.where("`on`").select("key"), known.where("not `on`").select("key")
        n = passing.count()
        while n:
            words = max(1, -(-n * bits // 64))
            if words > MOST_WORDS:
                raise OverflowError(f"a level of {n} keys needs {words} words; the bound is {MOST_WORDS}")
            level = (cut(bloom_words(passing, len(levels), words, hashes), "url-level"), words, hashes)
            levels.append(level)
            passed = cut(other.where(passes(F.col("key"), len(levels) - 1, level)), "url-false")
            passing, other = passed, passing
            n = passing.count()
        return BloomCascade(levels, len(levels) % 2 == 1)

    def contains(self, key: Column) -> Column:
        out = F.lit(self.last_listed)
        for at in range(len(self.levels) - 1, -1, -1):
            out = F.when(~passes(key, at, self.levels[at]), F.lit(at % 2 == 1)).otherwise(out)
        return out


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | tuple[tuple[str, str], ...] = RULES,
    blocked: DataFrame | tuple[str, ...] = BLOCKED,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """For each row: page_id, host, path, rule, verdict, listed_domain.

    rules(rule, verdict) and blocked(domain) are tables of any length, or short tuples. A rule fits
    its host and all subdomains if the path starts with the rule's path; the longest fitting rule
    gives the verdict, block if it is listed with both. Where none fits, the list decides: block if
    the host or a parent domain of it is listed, else allow; of several such domains listed_domain
    is the first in order. A url that is null or without :// has an empty host and path; no rule or
    list fits it. Repeated rows are judged one by one, an empty table gives an empty result, and other
    columns aren't read.

    All keys that the corpus could look up are the cascade's universe, so its answers are exact. If
    a level would pass MOST_WORDS, or the lists have more than MOST_SHAPES kinds of keys, each of
    which is a column of the plan, ``filter_urls_joined`` answers instead.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    blocked = blocked if isinstance(blocked, DataFrame) else domain_table(spark, blocked)
    listed = listed_keys(rules, blocked)
    shape = KeyShape.of(listed, MOST_SHAPES)
    if shape is None:
        return filter_urls_joined(pages, rules, blocked, id_col, url_col)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = shape.keys(F.col("host"), F.col("path"))
    if not keys:
        return _judge(rows, F.lit(None).cast(_RULE), F.lit(None).cast("string"))
    universe = rows.select(F.explode(F.array_compact(F.array(*keys))).alias("key"))
    try:
        cascade = BloomCascade.build(listed, universe)
    except OverflowError:
        return filter_urls_joined(pages, rules, blocked, id_col, url_col)
    hits = rows.withColumn("hits", F.array_compact(F.array(*[F.when(cascade.contains(k), k) for k in keys])))
    is_domain = lambda k: F.startswith(k, F.lit("d"))
    best = F.array_max(F.transform(F.filter("hits", lambda k: ~is_domain(k)), _fitting))
    return _judge(hits, best, F.substring(F.array_min(F.filter("hits", is_domain)), 2, _LONG))


_LONG = 2**30
_RULE = "struct<n:int,block:boolean,rule:string>"


def _fitting(key: Column) -> Column:
    """What makes one fitting rule go before another: its length, then block."""
    rule = F.substring(key, 2, _LONG)
    return F.struct(F.length(rule).alias("n"), F.startswith(key, F.lit("b")).alias("block"), rule.alias("rule"))


def filter_urls_joined(pages: DataFrame, rules: DataFrame, blocked: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same by a shuffle join on the keys that the lists may have, for lists of any shape and length.

    A url's keys are its host's suffixes with those prefixes of its path that some rule has the length
    of. Keys that a thousandth of the rows have are dealt to several tasks.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = cut(rows, "url-rows")
    listed = cut(listed_keys(rules, blocked).dropDuplicates(["key"]), "url-listed")
    # one row a kind and number of labels, with the lengths of paths: no more than 381 of them
    shapes = listed.groupBy("kind", "labels").agg(F.collect_set("path_length").alias("lengths")).agg(F.collect_list(F.struct("kind", "labels", "lengths")).alias("shapes"))
    there = F.broadcast(cut(shapes, "url-shapes"))
    each = rows.join(there, F.lit(True)).select("row", "host", "path", F.explode("shapes").alias("x")).where(F.size(F.split("host", r"\.")) >= F.col("x.labels"))
    each = each.select("row", "host", "path", "x.kind", "x.labels", F.explode("x.lengths").alias("n")).where(F.length("path") >= F.col("n"))
    keys = each.select("row", F.concat("kind", F.expr("substring_index(host, '.', -labels)"), F.expr("substring(path, 1, n)")).alias("key"))
    known = cut(Few(listed, F.col("key")).split(keys, F.col("key"))[0], "url-keys")
    hot = cut(heavy(known.groupBy("key").count(), "count", known.count()).select("key"), "url-hot")
    hits = join_hot(known, listed.select("key"), "key", hot, "row")
    rule = F.when(~F.startswith("key", F.lit("d")), _fitting(F.col("key")))
    domain = F.when(F.startswith("key", F.lit("d")), F.substring("key", 2, _LONG))
    found = hits.groupBy("row").agg(F.max(rule).alias("best"), F.min(domain).alias("domain"))
    return _judge(rows.join(found, "row", "left"), F.col("best"), F.col("domain"))


def _judge(rows: DataFrame, best: Column, domain: Column) -> DataFrame:
    """The verdict from the best fitting rule and the listed domain."""
    out = rows.withColumn("best", best).withColumn("listed_domain", domain)
    listed = F.when(F.col("listed_domain").isNotNull(), "block").otherwise("allow")
    verdict = F.when(F.col("best").isNull(), listed).when(F.col("best.block"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed_domain")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_urls on pages by the contract's rules and the example list of domains."""
    return filter_urls(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rule, says) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
                         ('com/fr/', 'allow'), ('com/de/', 'block')),
s AS (SELECT rule, says, split_part(rule, '/', 1) AS rhost, substr(rule, instr(rule, '/')) AS rpath FROM r),
f AS (
  SELECT p.page_id, p.host, p.path, arg_max(s.rule, length(s.rule)) AS rule, arg_max(s.says, length(s.rule)) AS says
  FROM p LEFT JOIN s ON (p.host = s.rhost OR ends_with(p.host, '.' || s.rhost)) AND starts_with(p.path, s.rpath)
  GROUP BY p.page_id, p.host, p.path),
d(domain) AS (VALUES ('ads-track.example.org'), ('casino-win.example.org'), ('cheap-pills.example.com'),
                     ('free-bets.example.com'), ('spam-farm.example.org'))
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce(f.says, CASE WHEN d.domain IS NULL THEN 'allow' ELSE 'block' END) AS verdict, d.domain AS listed_domain
FROM f LEFT JOIN d ON f.host = d.domain OR ends_with(f.host, '.' || d.domain)
"""
