"""Where graphs live: one folder with a triple table, the layouts beside it and a catalog of predicates."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graphloom.functions.terms import Prefixes

SPO = ST.StructType([ST.StructField(c, ST.StringType()) for c in ("s", "p", "o")])
SO = ST.StructType([ST.StructField(c, ST.StringType()) for c in ("s", "o")])
META = "meta"


@dataclass(frozen=True)
class Predicate:
    """term: as stored; column: a name that no other predicate of the graph has."""

    term: str
    ordinal: int
    column: str
    rows: int
    multi: bool
    subjects: int
    objects: int


def column_name(term: str, ordinal: int) -> str:
    """A readable name; the ordinal keeps predicates apart that read the same."""
    return re.sub(r"\W+", "_", term.strip("<>")).strip("_").lower() + f"_{ordinal}"


class Folder:
    """What is done with paths below a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def exists(self, name: str) -> bool:
        fs, at = self._at(name)
        return fs.exists(at)

    def complete(self, name: str) -> bool:
        """A job has written it to its end."""
        return self.exists(f"{name}/_SUCCESS")

    def delete(self, name: str) -> None:
        fs, at = self._at(name)
        fs.delete(at, True)

    def names(self, name: str) -> list[str]:
        fs, at = self._at(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def latest(self, name: str) -> str | None:
        """The complete version of what publish() writes with the highest number."""
        done = [v for v in self.names(name) if v.isdigit() and self.complete(f"{name}/{v}")]
        return f"{name}/{max(done, key=int)}" if done else None

    def publish(self, rows: DataFrame, name: str, form: str = "parquet") -> None:
        """Write rows as the next version of name. Readers see it when its job has ended, and until then the one before.

        A version that a crash has left unfinished keeps its number and is never read.
        """
        taken = [int(v) for v in self.names(name) if v.isdigit()]
        number = 1 + max(taken, default=0)
        rows.write.format(form).save(f"{self.path}/{name}/{number:08d}")
        for v in self.names(name):
            if v.isdigit() and int(v) < number:
                self.delete(f"{name}/{v}")


class GraphStore:
    """The folder of one graph. What is known of its predicates is read once, when the store is opened.

    ``root`` has the versions of the catalog; the newest names the data folder, ``path``, that holds the
    triples and the layouts built from them. A graph that is overwritten gets a new data folder, so no
    layout of the one before can answer for it, and readers switch with the catalog.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        version = Folder(spark, self.root).latest(META)
        if version is None:
            raise FileNotFoundError(f"no graph in {root}")
        meta = json.loads(spark.read.text(f"{self.root}/{version}", wholetext=True).first()[0])
        self.path = f"{self.root}/{meta['data']}"
        self.folder = Folder(spark, self.path)
        self.prefixes = Prefixes(meta["prefixes"])
        self.predicates = {p["term"]: Predicate(**p) for p in meta["predicates"]}

    @staticmethod
    def create(triples: DataFrame, path: str, prefixes: Prefixes | None = None, mode: str = "errorifexists") -> GraphStore:
        """Write triples(s, p, o), a set, as Parquet partitioned by predicate, and the catalog.

        mode is a writer's mode: errorifexists, overwrite or ignore.
        """
        spark, root = triples.sparkSession, path.rstrip("/")
        prefixes = prefixes or Prefixes()
        top = Folder(spark, root)
        if top.latest(META) is not None:
            if mode == "ignore":
                return GraphStore(spark, root)
            if mode == "errorifexists":
                raise FileExistsError(f"there is a graph in {root}")
        data = f"graph-{uuid.uuid4().hex}"
        # a task writes the rows of few predicates, so that a partition has few files; the salt spreads a frequent one
        spread = F.pmod(F.xxhash64("s"), F.lit(16))
        triples.select("s", "o", "p").repartition("p", spread).write.partitionBy("p").parquet(f"{root}/{data}/triples")
        rows = spark.read.schema(SPO).parquet(f"{root}/{data}/triples")
        pairs = rows.groupBy("p", "s").agg(F.count("*").alias("n"))
        by_s = pairs.groupBy("p").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count("*").alias("subjects"))
        by_o = rows.groupBy("p", "o").count().groupBy("p").agg(F.count("*").alias("objects"))
        found = by_s.join(by_o, "p").orderBy("p").collect()
        predicates = [
            Predicate(r["p"], i, column_name(r["p"], i), r["rows"], r["most"] > 1, r["subjects"], r["objects"]) for i, r in enumerate(found)
        ]
        meta = {"data": data, "prefixes": prefixes.by_prefix, "predicates": [asdict(p) for p in predicates]}
        top.publish(spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1), META, "text")
        for name in top.names(""):
            if name.startswith("graph-") and name != data:
                top.delete(name)
        return GraphStore(spark, root)

    def triples(self) -> DataFrame:
        return self.spark.read.schema(SPO).parquet(f"{self.path}/triples")

    def vertical(self, term: str) -> DataFrame:
        """(s, o) of one predicate: only its partition is read."""
        if term not in self.predicates:
            return self.spark.createDataFrame([], SO)
        return self.triples().where(F.col("p") == term).select("s", "o")

    def read(self, name: str, schema: ST.StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return self.folder.complete(name)

    def drop(self, name: str) -> None:
        self.folder.delete(name)

    def write(self, rows: DataFrame, name: str, mode: str = "errorifexists", partition: str | None = None) -> None:
        """Write a layout's table. What a crash has left of an earlier attempt goes first."""
        if self.has(name):
            if mode == "ignore":
                return
            if mode != "overwrite":
                raise FileExistsError(f"{name} is there already")
        self.drop(name)
        writer = rows.write.partitionBy(partition) if partition else rows.write
        writer.parquet(f"{self.path}/{name}")

    def compute_stats(self, database: str, table: str = "triples") -> DataFrame:
        """Register the triple table in Spark's catalog and ANALYZE it, for its optimizer; returns what is known of its columns."""
        name = f"`{database}`.`{table}`"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(f"CREATE TABLE {name} (s STRING, o STRING, p STRING) USING parquet PARTITIONED BY (p) LOCATION '{self.path}/triples'")
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
        self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
        return self.spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'")
