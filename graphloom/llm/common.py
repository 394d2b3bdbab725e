"""What the operators share: the shared scratch folder, text rules and heavy keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that the contracts call whitespace: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits a key and hash functions of a Bloom filter: about one false positive in 50.
BITS, HASHES = 8, 4
#: A filter has no more 64-bit words than this (64 MB).
MOST_WORDS = 2**23

_folders: dict[str, str] = {}
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    It is the one that ``spark.checkpoint.dir`` names. Only where that is unset and all tasks run
    in this process, as in tests, a temporary folder of this machine is taken.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not (sc.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        else:
            if sc.applicationId not in _own:
                _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            base = _own[sc.applicationId]
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; the application's scratch goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_folder(spark)}/graphloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, app)
    return f"{_folders[app]}/{what}-{uuid.uuid4().hex[:12]}"


def _forget(spark: SparkSession, app: str) -> None:
    try:
        remove(spark, _folders.pop(app))
    except Exception:  # the session may be gone when Python ends
        pass


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back, so that its lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gl_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove what cut() has written, once everything that reads it has been written itself."""
    for df in tables:
        if (path := getattr(df, "_gl_path", None)) is not None:
            remove(df.sparkSession, path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run meanwhile hands rows to Python in batches of about ``most`` bytes, which both sides hold beside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def give_back() -> None:
    """Return what this process no longer needs to the system: Python workers live on beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def give_back_after(run: Callable) -> Callable:
    """A function from batches to batches that ends with give_back()."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        # modules, above all, that a worker has before its first task stay: no collection needs to look through them again
        if not gc.get_freeze_count():
            gc.freeze()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """How many maximal runs of characters other than \\x20 and \\x09-\\x0D the text has."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept."""
    return F.translate(text, UPPER, LOWER)


def heavy(counts: DataFrame, n: str, total: int, parts: int = 1000) -> DataFrame:
    """The rows of counts whose n is over a 1/parts share of total.

    At most ``parts`` rows can be, whatever the size of the data: small enough to broadcast.
    """
    return counts.where(F.col(n) * parts > total)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: str, salts: int = 64) -> DataFrame:
    """left inner join right on key, where right has a key once and left may have hot ones.

    hot(key) is a list of bounded length (see ``heavy``). Rows of a hot key are dealt to ``salts``
    tasks by a hash of the column ``spread``; right's row of it is repeated as often.
    """
    hot = F.broadcast(hot.select(key, F.lit(True).alias("__gl_hot")))
    many = F.when(F.col("__gl_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("__gl_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    left = left.join(hot, key, "left").withColumn("__gl_salt", salt).drop("__gl_hot")
    right = right.join(hot, key, "left").withColumn("__gl_salt", F.explode(many)).drop("__gl_hot")
    return left.join(right, [key, "__gl_salt"]).drop("__gl_salt")


def cells(key: Column, level: int, words: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(words * 64)) for i in range(hashes)]


def bloom_words(keys: DataFrame, level: int, words: int, hashes: int = HASHES) -> DataFrame:
    """A Bloom filter of keys(key) as one row with an array of ``words`` longs."""
    bits = keys.select(F.explode(F.array(*cells(F.col("key"), level, words, hashes))).alias("cell"))
    bit = F.expr("shiftleft(1L, cast(cell % 64 as int))")
    set_words = bits.groupBy(F.floor(F.col("cell") / 64).alias("at")).agg(F.bit_or(bit).alias("bits"))
    all_words = keys.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    dense = set_words.unionByName(all_words).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "bits")))
    return dense.agg(F.transform(in_order, lambda x: x["bits"]).alias("words"))


def passes(key: Column, at: int, level: tuple[DataFrame, int, int]) -> Column:
    """The filter (row of words, number of words, hash functions) of a level may hold the key."""
    df, words, hashes = level
    bits = df.scalar()
    tests = [
        F.get(bits, F.floor(c / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))) != 0
        for c in cells(key, at, words, hashes)
    ]
    return reduce(Column.__and__, tests)


class Few:
    """Which rows of a large table may meet a smaller one, told by a Bloom filter of its keys.

    Large rows that can't meet anything needn't be shuffled for a join. The filter has 8 bits a
    key up to 64 MB; past that it fills up and more rows take the way of the join, which is right
    for every row.
    """

    def __init__(self, keys: DataFrame, column: Column) -> None:
        self.n = keys.count()
        words = min(MOST_WORDS, max(1, -(-self.n * BITS // 64)))
        self.level = (cut(bloom_words(keys.select(self.key(column).alias("key")), 0, words), "few"), words, HASHES)

    @staticmethod
    def key(column: Column) -> Column:
        """A null is a key like others."""
        return F.coalesce(column.cast("string"), F.lit("null"))

    def split(self, rows: DataFrame, column: Column) -> tuple[DataFrame, DataFrame]:
        """(the rows that may meet a key, the rows that surely don't)."""
        may = passes(self.key(column), 0, self.level)
        return rows.where(may), rows.where(~may)
