"""Line dedup: two Bloom filters find suspected repeats; only those shuffle and are confirmed exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WHITE, Few, cut, free, heavy, join_hot, table, text_of

LEAST_CODEPOINTS = 20
LEAST_DOCUMENTS = 3
#: Keys that many documents hold are sent to all tasks: no more than so many, none of more bytes than that (20 MB in all).
MOST_FREQUENT, LONGEST_FREQUENT = 20_000, 1_000
#: Cells a line, hash functions, and the most cells of a filter (64 MB of bits). Past the most, the
#: filters fill up and more lines are suspected; results stay exact.
CELLS, HASHES, MOST_CELLS = 8, 2, 2**29
#: Cells of a shard: filters are merged shard by shard.
SHARD = 2**20


def line_key(line: str) -> str:
    key = line.strip(WHITE)
    return key.lower() if key.isascii() else key.encode().lower().decode()


def line_keys(text: str | None, least: int = LEAST_CODEPOINTS) -> set[str]:
    return {k for line in (text or "").split("\n") if len(line) >= least and len(k := line_key(line)) >= least}


def _cells(keys: list[str], cells: int) -> np.ndarray:
    """HASHES cells of each key, one row a key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(cells - 1) for i in range(HASHES)], axis=1).astype(np.int64)


def _bits(at: np.ndarray, size: int) -> bytes:
    flags = np.zeros(size, bool)
    flags[at] = True
    return zlib.compress(np.packbits(flags), 1)


def twice_seen(docs: DataFrame, text_col: str, cells: int) -> bytes:
    """The filter of cells that keys of two or more documents share, one bit a cell.

    Every task fills a once-seen and a twice-seen filter of its documents. Merging, a cell is seen
    twice if it is in either filter, or seen once on both sides. A key of two documents has all
    its cells in the result.
    """
    shard = min(SHARD, cells)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for text in batch.column(0):
                if keys := line_keys(text.as_py()):
                    # once a document, also where two of its keys share a cell
                    found.append(np.unique(_cells(list(keys), cells)).astype(np.uint32))
        if not found:
            return
        at, seen = np.unique(np.concatenate(found), return_counts=True)
        edges = np.searchsorted(at, np.arange(0, cells + 1, shard))
        for k in np.flatnonzero(np.diff(edges)):
            own, n = at[edges[k] : edges[k + 1]] - k * shard, seen[edges[k] : edges[k + 1]]
            yield pa.RecordBatch.from_pydict({"shard": [int(k)], "once": [_bits(own, shard)], "twice": [_bits(own[n > 1], shard)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, once, twice in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8) for x in (once, twice))
                if k in held:
                    have, double = held[k]
                    double |= t | (have & o)
                    have |= o
                else:
                    held[k] = (o.copy(), t.copy())
        for k, (_, double) in held.items():
            yield pa.RecordBatch.from_pydict({"shard": [k], "twice": [zlib.compress(double, 1)]})

    filters = docs.select(text_col).mapInArrow(fill, "shard long, once binary, twice binary")
    merged = filters.repartition(min(64, cells // shard), "shard").mapInArrow(merge, "shard long, twice binary")
    out = bytearray(cells // 8)
    for k, twice in merged.toLocalIterator():  # at most MOST_CELLS bits in all
        out[k * shard // 8 : (k + 1) * shard // 8] = zlib.decompress(twice)
    return bytes(out)


def suspected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key) for every document's distinct keys that the twice-seen filter has."""
    n = docs.agg(F.sum(F.regexp_count(text_of(text_col), F.lit("\n")) + 1)).first()[0] or 1
    cells = min(MOST_CELLS, max(2**16, 1 << (CELLS * n - 1).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, text_col, cells))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own := list(line_keys(text.as_py())):
                    at = _cells(own, cells)
                    hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                    own = [own[i] for i in np.flatnonzero(hit)]
                    ids += [doc_id] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["doc_id", "key"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(look, "doc_id long, key string")


def lines_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS) -> tuple[dict[str, int | None], DataFrame]:
    """(frequent, drops): what decides which lines go.

    frequent: {key: largest id} of the keys that over a thousandth of the documents hold. There are no
    more than MOST_FREQUENT of them and none is longer than LONGEST_FREQUENT, so tasks can look
    them up. drops(drop_id, drops): for each document the other keys whose lines it loses.
    """
    rows = cut(suspected(docs, id_col, text_col), "line-suspects")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_documents)
    groups = cut(groups, "line-repeats")
    total, n = rows.count(), docs.count()
    often = (F.col("n") * 1000 > n) & (F.col("n") * MOST_FREQUENT > total) & (F.octet_length("key") <= LONGEST_FREQUENT)
    frequent = {r["key"]: r["last"] for r in groups.where(often).select("key", "last").toLocalIterator()}
    rest = cut(groups.where(~often), "line-rest")
    # suspects that are frequent, or weren't repeats after all, stay where they are
    light = rows.join(F.broadcast(groups.where(often).select("key")), "key", "left_anti")
    light = Few(rest, F.col("key")).split(light, F.col("key"))[0]
    repeats = join_hot(light, rest, "key", heavy(rest, "n", total).select("key"), "doc_id")
    repeats = repeats.where(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = cut(repeats.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("key").alias("drops")), "line-drops")
    free(rows, groups, rest)
    return frequent, drops


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """For each row: doc_id, kept (the text that is left), n_lines, n_dropped.

    A text is split at \\n; null and empty ones are one empty line. A line's key is the line
    without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least 20 code points in
    at least three rows lose all their lines but those of the largest id that has them; a null id
    is below all others, and a key that only null ids have loses none. Rows that share an id count
    separately and are treated alike. A text of any length is one row and is read whole; an empty
    table gives an empty result. Other columns aren't read.

    Only texts that lose a line of a key that isn't frequent are shuffled, to meet their lists.
    """
    frequent, drops = lines_to_drop(docs, id_col, text_col, least_documents)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some, others = Few(drops, F.col("drop_id")).split(rows, F.col("doc_id"))
    listed = some.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select("doc_id", "text", "drops")
    joined = listed.unionByName(others.withColumn("drops", F.lit(None).cast("array<string>")))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, missing = shared.value, object()
        for batch in batches:
            kept, lines_n, dropped_n = [], [], []
            for doc_id, text, drops in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines = (text.as_py() or "").split("\n")
                gone = set(drops or ())
                left = []
                for x in lines:
                    if len(x) >= LEAST_CODEPOINTS and (gone or often):
                        key = line_key(x)
                        if key in gone or often.get(key, missing) not in (missing, doc_id):
                            continue
                    left.append(x)
                kept.append("\n".join(left))
                lines_n.append(len(lines))
                dropped_n.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64())],
                names=["doc_id", "kept", "n_lines", "n_dropped"],
            )

    return joined.mapInArrow(rewrite, "doc_id long, kept string, n_lines long, n_dropped long")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines on documents: doc_id, n_lines, n_dropped and the digest of the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.last AS dropped FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
