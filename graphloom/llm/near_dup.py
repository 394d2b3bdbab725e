"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles and minima over their sets, banded and verified."""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Few, arrow_batches, cut, free, give_back_after, heavy, join_hot, table

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and samples a band: texts of similarity 0.8 share no band with probability (1 - 0.8**3)**14 = 4e-5.
BANDS, ROWS = 14, 3
#: Document frequencies are exchanged between stretches of documents of about so many bytes of text and ranges of
#: shingle hashes: LEAST_PARTS ranges, or as many as keep a range at about PART_BYTES of text.
STRETCH_BYTES, LEAST_PARTS, PART_BYTES = 2**22, 1024, 2**24
#: Pairs whose samples agree less than this (24 of 42) aren't verified: over three and a half standard deviations below 0.8.
LEAST_AGREEMENT = 0.57
_POOL = 2**16
_CHUNK = 32_768
_SIG = BANDS * ROWS
#: JVM and Python hand each other rows of texts and stretches in batches of about so many bytes.
BATCH_BYTES = 2**23
#: More samples of texts whose buckets stay open, and the least agreement of all 170: over three standard deviations below 0.8.
MORE, LEAST_AGREEMENT_ALL = 128, 0.7
#: Members of a bucket that are compared with each other, or with as many others, in one task.
BLOCK = 4_096
#: Given to _across_components: of the pairs that agree only those leave a task that first connect two members there.
FIRST = 1
#: Texts that agree are read in blocks of about so many, of which a cluster has MOST_EVEN at most unless they pass so many bytes.
READ_BLOCK, MOST_EVEN, READ_BYTES = 256, 16, 2**23
#: Of each view, weights and sets: bytes of a text's samples, once more samples are drawn, and of 32 bits of each band's key.
_WIDTH, _OWN = _SIG + MORE, 4 * BANDS

_rng = np.random.RandomState(20_240_229)
_ODD = _rng.randint(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: The variates r, ln c ~ Gamma(2, 1) and beta ~ U(0, 1) of an element and a sample are drawn from this pool by hash.
_SEEDS = _rng.randint(0, 2**63, _SIG + MORE, dtype=np.uint64) | np.uint64(1)
_GAMMA = _rng.gamma(2.0, 1.0, _POOL)
_R, _LN_C, _BETA = (x.astype(np.float32) for x in (_GAMMA, np.log(_rng.gamma(2.0, 1.0, _POOL)), _rng.random_sample(_POOL)))
_INVERSE = (1 / _GAMMA).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words(text: bytes) -> list[bytes]:
    """The runs of bytes other than \\x20 and \\x09-\\x0D, A-Z lower-cased."""
    return text.lower().split()


def shingles(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of five words in a row, how often each occurs); fewer words are one shingle."""
    if not tokens:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.array(list(map(zlib.crc32, tokens)), np.uint64)
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += w[i : i + n] * _ODD[i]
    h = np.sort(_mix(h))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.diff(np.append(first, n))


def distinct_counts(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, the sum of n for each, where each of h is among them)."""
    found, at = np.unique(h, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64), at


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """((sorted shingle hashes, documents that have each), documents) over all rows, on the driver: for small tables.

    ``with_frequencies`` is the way for large ones.
    """
    at, n = [np.empty(0, np.uint64)], 0
    for (text,) in docs.select(text_col).toLocalIterator():
        at.append(shingles(words((text or "").encode()))[0])
        n += 1
    h = np.concatenate(at)
    found, counts, _ = distinct_counts(h, np.ones(len(h)))
    return (found, counts), n


def idf_of(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return (np.log((documents + 1) / (frequencies + 1.0)) + 1).astype(np.float32)


def idf_table(frequencies: tuple[np.ndarray, np.ndarray], documents: int) -> tuple[np.ndarray, np.ndarray]:
    return frequencies[0], idf_of(frequencies[1], documents)


def weights(h: np.ndarray, tf: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The TF-IDF weights of a document's shingles by a table that has all of them."""
    return tf * idf[1][np.searchsorted(idf[0], h)]


def _shrunk(*columns: np.ndarray) -> bytes:
    """The columns' bytes, all first ones before all second ones and so on, compressed."""
    return pa.compress(b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns), "zstd", asbytes=True)


def _grown(data: bytes, n: int, *types: type) -> list[np.ndarray]:
    """The columns of n values that _shrunk() took."""
    widths = [np.dtype(t).itemsize for t in types]
    flat = np.frombuffer(pa.decompress(data, n * sum(widths), "zstd", asbytes=True), np.uint8)
    ends = np.cumsum(widths) * n
    return [flat[e - w * n : e].reshape(w, n).T.copy().view(t).ravel() for e, w, t in zip(ends, widths, types, strict=True)]


def vector_of(text: bytes, frequencies: bytes, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, weights) of a text whose shingles' document frequencies came with it."""
    h, tf = shingles(words(text))
    return h, tf * idf_of(_grown(frequencies, len(h), np.uint32)[0], documents)


def content_of(tokens: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(tokens)).digest()


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    size = pc.sum(pc.binary_length(rows.column(1))).as_py() or 0
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([rows.num_rows]), pa.array([size])], names=["data", "n", "size"])


def _texts(data: pa.Scalar) -> tuple[pa.Array, list[bytes]]:
    """(ids, texts) of a stretch."""
    rows = pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()
    ids, texts = (rows.column(i).combine_chunks() for i in (0, 1))
    return ids, [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]


def raw_digest(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def stretches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stretch, data, n, size): all rows' ids and texts, packed by stretches of about STRETCH_BYTES."""

    @give_back_after
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            first = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                size += n + 16
                if size >= STRETCH_BYTES:
                    held.append(batch.slice(first, i + 1 - first))
                    yield _packed(held)
                    held, size, first = [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield _packed(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(pack, "data binary, n long, size long")
    return cut(packed.select(F.monotonically_increasing_id().alias("stretch"), "data", "n", "size"), "near-stretches")


def with_frequencies(packed: DataFrame, bits: int) -> DataFrame:
    """(stretch, part, n, data): each of stretches() with part -1, then, part by part, the document frequencies of its distinct shingles.

    A part is a range of hashes, told by their first ``bits`` bits. A stretch sends each part its distinct hashes with
    the number of its documents that have them, sorted; the part adds them up and answers in the same order. So counts
    are exact, and a shingle that all documents share comes once from each stretch.
    """
    shift = np.uint64(64 - bits)
    schema = "part int, stretch long, n int, data binary"

    @give_back_after
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.concatenate([shingles(words(t))[0] for t in _texts(data)[1]])
                if not len(h):
                    continue
                h, n, _ = distinct_counts(h, np.ones(len(h)))
                part = (h >> shift).astype(np.int32)
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(starts[1:], len(h))
                n = n.astype(np.uint32)
                steps = np.diff(h, prepend=np.uint64(0))
                steps[starts] = h[starts] - (part[starts].astype(np.uint64) << shift)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[starts], pa.int32()),
                        pa.array([stretch] * len(starts), pa.int64()),
                        pa.array(ends - starts, pa.int32()),
                        pa.array([_shrunk(steps[i:j], n[i:j]) for i, j in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["part", "stretch", "n", "data"],
                )

    @give_back_after
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        now = None

        def flush() -> pa.RecordBatch:
            columns = [_grown(data, n, np.uint64, np.uint32) for _, n, data in held]
            low = np.uint64(now) << shift
            _, total, at = distinct_counts(np.concatenate([np.cumsum(x[0], dtype=np.uint64) + low for x in columns]), np.concatenate([x[1] for x in columns]))
            total = np.split(total.astype(np.uint32)[at], np.cumsum([n for _, n, _ in held])[:-1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in held], pa.int64()),
                    pa.array([now] * len(held), pa.int32()),
                    pa.array([x[1] for x in held], pa.int32()),
                    pa.array([_shrunk(x) for x in total], pa.binary()),
                ],
                names=["stretch", "part", "n", "data"],
            )

        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if held:
                        yield flush()
                    held, now = [], part
                held.append(tuple(row))
        if held:
            yield flush()

    asked = packed.select("stretch", "data").mapInArrow(ask, schema).repartition("part").sortWithinPartitions("part")
    answered = asked.mapInArrow(answer, "stretch long, part int, n int, data binary")
    both = packed.select("stretch", F.lit(-1).alias("part"), F.col("n").cast("int").alias("n"), "data").unionByName(answered)
    return both.repartition("stretch").sortWithinPartitions("stretch", "part")


def samples(h: np.ndarray, w: np.ndarray, starts: np.ndarray, ks: range = range(_SIG)) -> np.ndarray:
    """The consistent weighted samples of documents laid end to end, one row a document.

    For sample k and an element of weight w, t = floor(ln w / r + beta) and
    ln a = ln c - r (t - beta + 1); the element with the least ln a is drawn, together with its t.
    Two documents draw the same with the probability of their weighted Jaccard similarity.
    """
    lw = np.log(w).astype(np.float32)
    lengths = np.diff(np.append(starts, len(h)))
    owner = np.repeat(np.arange(len(starts)), lengths)
    out = np.empty((len(starts), len(ks)), np.uint32)
    for n, k in enumerate(ks):
        at = ((h * _SEEDS[k]) >> np.uint64(48)).astype(np.int64)
        beta = _BETA.take(at)
        t = _INVERSE.take(at)
        t *= lw
        t += beta
        np.floor(t, out=t)
        la = t - beta
        la += 1
        la *= _R.take(at)
        np.subtract(_LN_C.take(at), la, out=la)
        least = np.minimum.reduceat(la, starts)
        hits = np.flatnonzero(la == least[owner])
        won = np.empty(len(starts), np.int64)
        won[owner[hits[::-1]]] = hits[::-1]
        out[:, n] = _mix(h[won] + t[won].astype(np.int64).astype(np.uint64) * _ODD[7] + np.uint64(k)) >> np.uint64(32)
    return out


def set_samples(h: np.ndarray, starts: np.ndarray, ks: range = range(_SIG)) -> np.ndarray:
    """Samples like those of samples(), for sets: two documents draw the same with the probability of their plain Jaccard similarity."""
    out = np.empty((len(starts), len(ks)), np.uint32)
    for n, k in enumerate(ks):
        out[:, n] = _mix(np.minimum.reduceat(h * _SEEDS[k], starts) + np.uint64(k)) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray, view: int = 0) -> np.ndarray:
    """A key for each band of one text's samples or of each row's; the last bit tells the view: 0 for weights, 1 for sets."""
    x = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    keys = _mix((x * _ODD[:ROWS]).sum(-1, dtype=np.uint64) + np.arange(view * BANDS, (view + 1) * BANDS, dtype=np.uint64) * _ODD[60])
    return keys & ~np.uint64(1) | np.uint64(view)


def both_keys(weighted: np.ndarray, sets: np.ndarray) -> np.ndarray:
    return np.concatenate([band_keys(weighted), band_keys(sets, 1)], axis=-1)


def sign(asked: DataFrame, documents: int) -> DataFrame:
    """(doc_id, raw, content, df, sig, bands) of with_frequencies().

    raw is a digest of the text, content one of its words; df the document frequency of each shingle,
    sig the samples by weights and 8 bits of each by sets, and bands a key for every band of both.
    """

    def signed(data: pa.Scalar, answers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, texts = _texts(data)
        tokens = list(map(words, texts))
        found = list(map(shingles, tokens))
        frequencies = np.concatenate([np.empty(0, np.uint32), *answers])
        lengths = [len(h) for h, _ in found]
        distinct, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
        if len(distinct) != len(frequencies):
            raise ValueError(f"{len(frequencies)} document frequencies for {len(distinct)} shingles")
        df = np.split(frequencies[at], np.cumsum(lengths)[:-1])
        sigs: list[bytes | None] = [None] * len(found)
        bands: list[np.ndarray | None] = [None] * len(found)
        held: list[int] = []
        size = 0

        def flush() -> None:
            if held:
                starts = np.cumsum([0] + [lengths[i] for i in held[:-1]])
                h, tf = (np.concatenate([found[i][k] for i in held]) for k in (0, 1))
                drawn = samples(h, tf * idf_of(np.concatenate([df[i] for i in held]), documents), starts)
                sets = set_samples(h, starts)
                for i, weighted, few, keys in zip(held, drawn, sets.astype(np.uint8), both_keys(drawn, sets).view(np.int64), strict=True):
                    sigs[i] = weighted.tobytes() + few.tobytes()
                    bands[i] = keys
            held.clear()

        for i, (h, _) in enumerate(found):
            if len(h):
                held.append(i)
                size += len(h)
                if size >= _CHUNK:
                    flush()
                    size = 0
        flush()
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                pa.array(list(map(content_of, tokens)), pa.binary()),
                pa.array([_shrunk(x) if len(x) else b"" for x in df], pa.binary()),
                pa.array(sigs, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "raw", "content", "df", "sig", "bands"],
        )

    @give_back_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, answers = None, []
        for batch in batches:
            for part, n, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part >= 0:
                    answers += _grown(row.as_py(), n, np.uint32)
                    continue
                if data is not None:
                    yield from signed(data, answers)
                data, answers = row, []
        if data is not None:
            yield from signed(data, answers)

    return asked.select("part", "n", "data").mapInArrow(run, "doc_id long, raw binary, content binary, df binary, sig binary, bands array<bigint>")


def hot_ends(pairs: DataFrame, side: str, total: int) -> DataFrame:
    """The nodes that over a thousandth of the pairs have at this side."""
    return heavy(pairs.groupBy(side).agg(F.count("*").alias("n")), "n", total).select(side)


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs(a, b) whose samples of either view agree often enough to be worth reading their texts. Many may share a pivot b."""
    hot = hot_ends(pairs, "b", pairs.count())
    left = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = join_hot(left, sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b", hot, "a")

    @give_back_after
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 5 * _SIG) for i in (2, 3))
            weighted = (x[:, : 4 * _SIG] == y[:, : 4 * _SIG]).reshape(-1, _SIG, 4).all(2).mean(1)
            sets = (x[:, 4 * _SIG :] == y[:, 4 * _SIG :]).mean(1)
            yield batch.select(["a", "b", "score"]).filter(pa.array(np.maximum(weighted, sets) >= LEAST_AGREEMENT))

    return both.select("a", "b", "sig_a", "sig_b", "score").mapInArrow(keep, "a long, b long, score long")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the weighted Jaccard of (sorted hashes, weights) and the plain one of the sets of hashes.

    Each copy of a text makes its shingles more frequent and so lighter than the shingles of an edit, which
    are as rare as before: by weights alone the copies of a large group are the less alike the more there are.
    """
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    common = float(np.minimum(x[1][i], y[1][j]).sum())
    everything = float(x[1].sum() + y[1].sum()) - common
    return max(common / everything, len(i) / (len(x[0]) + len(y[0]) - len(i)))


def verify(pairs: DataFrame, texts: DataFrame, documents: int, least: float = SIMILARITY) -> DataFrame:
    """The pairs(a, b) whose texts have at least this similarity, with it.

    Both ends may be hot: the texts of such nodes are repeated for the tasks that their pairs are
    dealt to.
    """
    total = pairs.count()
    ends = [texts.select(F.col("node").alias(x), F.struct("text", "df").alias(f"text_{x}")) for x in ("a", "b")]
    with_a = join_hot(pairs, ends[0], "a", hot_ends(pairs, "a", total), "b")
    both = join_hot(with_a, ends[1], "b", hot_ends(pairs, "b", total), "a")

    @give_back_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def vector(node: int, text) -> tuple[np.ndarray, np.ndarray]:
            if node not in held:
                held[node] = vector_of(text["text"].as_py(), text["df"].as_py(), documents)
                if len(held) > 64:
                    held.popitem(last=False)
            held.move_to_end(node)
            return held[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            s = [similarity(vector(i, x), vector(j, y)) for i, j, x, y in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([v >= least for v in s], pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, comp): the least node that links(a, b) connect each linked node with.

    known is the result for a part of the links, from which the work goes on.

    Every round takes the least label of the neighbours and then the label's own label; labels and
    links are written to the shared folder, so no round's plan holds the ones before. Nodes with
    many links and labels of many nodes are dealt to several tasks.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a <> b").distinct(), "near-links")
    centres = cut(hot_ends(both, "b", both.count()), "near-centres")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp"))
    if known is not None:
        labels = labels.join(known.withColumnRenamed("comp", "known"), "node", "left").select("node", F.least("comp", "known").alias("comp"))
    labels = cut(labels, "near-labels")
    nodes = labels.count()
    while True:
        around = join_hot(both, labels.select(F.col("node").alias("b"), F.col("comp").alias("b_comp")), "b", centres, "a")
        near = around.groupBy(F.col("a").alias("node")).agg(F.min("b_comp").alias("b_comp"))
        low = cut(labels.join(near, "node").select("node", "comp", F.least("comp", "b_comp").alias("low")), "near-low")
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("low_comp"))
        least = F.least("low", "low_comp")
        new = join_hot(low, jump, "low", hot_ends(low, "low", nodes), "node").select("node", least.alias("comp"), (F.col("comp") != least).alias("moved"))
        new = cut(new, "near-labels")
        moved = new.where("moved").limit(1).count()
        free(labels, low)
        labels = new
        if not moved:
            free(both, centres)
            return labels.select("node", "comp")


def _stars(buckets: DataFrame, total: int) -> DataFrame:
    """Distinct (a, b, score): each member a of a bucket(key, node, score) with the bucket's pivot b and the pivot's score.

    The pivot has the highest score, that is the most company over all its buckets: of copies
    that were edited from one text it is the text itself. One pair a row, never all pairs.
    """
    best = buckets.groupBy("key").agg(F.max(F.struct("score", -F.col("node"))).alias("p"), F.count("*").alias("n"))
    pivots = cut(best.select("key", (-F.col("p.col2")).alias("b"), F.col("p.score").alias("score"), "n"), "near-pivots")
    hot = heavy(pivots, "n", total).select("key")
    pairs = join_hot(buckets.select("key", F.col("node").alias("a")), pivots.select("key", "b", "score"), "key", hot, "a")
    return pairs.where("a <> b").select("a", "b", "score").distinct()


def _best_pivots(pairs: DataFrame) -> DataFrame:
    """Of the pairs(a, b, score) the one with the highest score for each a."""
    best = pairs.groupBy("a").agg(F.max(F.struct("score", -F.col("b"))).alias("p"))
    return best.select("a", (-F.col("p.col2")).alias("b"))


def _apart(pairs: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(a, b) of nodes(node) in different components. Many may share a pivot b."""
    known = cut(nodes.select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "near-known")
    left = pairs.select("a", "b").join(known.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a")
    both = join_hot(left, known.select(F.col("node").alias("b"), F.col("comp").alias("comp_b")), "b", hot_ends(pairs, "b", pairs.count()), "a")
    return both.where("comp_a <> comp_b").select("a", "b")


def near_components(nodes: DataFrame, texts_of, documents: int) -> DataFrame:
    """(node, comp): what verified links connect among the nodes(node, sig, bands) that the bands bring together.

    Buckets are of both views, weights and sets. First every bucket's members are compared with its
    pivot, each with its best one and, where it stays in another component, with all its pivots. Members of buckets that still hold several components meet again in buckets of two bands
    of a view at a time (texts of similarity 0.8 in a view share under two of its bands with
    probability 7e-4). There every pair across components is looked at by its samples. What agrees is
    joined to clusters, for which a bucket gives fewer rows than it has members, and each cluster's
    texts are read together, block by block: no table has a row for each pair that agrees.
    """
    keyed = nodes.where("bands is not null").select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut(sizes, "near-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shared = cut(join_hot(keyed, sizes, "key", heavy(sizes, "n", total).select("key"), "node"), "near-shared")
    scores = cut(shared.groupBy("node").agg(F.sum("n").alias("score")), "near-scores")
    buckets = cut(shared.join(scores, "node").select("key", "node", "score"), "near-buckets")
    sigs = cut(nodes.join(scores.select("node"), "node", "left_semi").select("node", "sig"), "near-sigs")
    pairs = cut(agreeing(_stars(buckets, total), sigs), "near-pairs")
    texts = cut(texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()), "near-texts")
    # a member that its best pivot links needs no other pivot of the same component
    first = cut(_best_pivots(pairs), "near-first")
    links = cut(verify(first, texts, documents).select("a", "b"), "near-verified")
    comps = components(links)
    rest = cut(_apart(pairs, comps, sigs).join(first, ["a", "b"], "left_anti"), "near-rest")
    if (more := cut(verify(rest, texts, documents).select("a", "b"), "near-verified")).limit(1).count():
        links = links.unionByName(more)
        comps = components(links, comps)
    free(texts, sizes, shared, scores)
    again = cut(_open_buckets(_two_band_buckets(_open_buckets(buckets, comps), nodes), comps), "near-open")
    texts = cut(texts_of(again.select("node").distinct()), "near-texts")
    more = cut(sign_more(texts, sigs, documents), "near-more")
    agree = cut(_across_components(again, more, FIRST).distinct(), "near-agree")
    if agree.limit(1).count():
        new = cut(_links_within(_clusters(agree), comps, more, texts, documents), "near-fresh-links")
        if new.limit(1).count():
            comps = components(links.unionByName(new), comps)
    free(texts, more, sigs, buckets, again, agree)
    return comps


def sign_more(texts: DataFrame, sigs: DataFrame, documents: int) -> DataFrame:
    """(node, sig, own): 8 bits of each of the first samples and of MORE further ones, and 32 bits of each band's key; weights first, then sets."""

    @give_back_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sets = [], []
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def flush(out=out, sets=sets, held=held) -> None:
                if held:
                    starts = np.cumsum([0] + [len(h) for h, _ in held[:-1]])
                    h = np.concatenate([h for h, _ in held])
                    found = samples(h, np.concatenate([w for _, w in held]), starts, range(_SIG, _WIDTH))
                    out += list(found.astype(np.uint8))
                    sets += list(set_samples(h, starts, range(_WIDTH)))
                held.clear()

            size = 0
            for text, df in zip(batch.column(1), batch.column(3), strict=True):
                h, w = vector_of(text.as_py(), df.as_py(), documents)
                held.append((h, w))
                size += len(h)
                if size >= _CHUNK:
                    flush()
                    size = 0
            flush()
            first = [np.frombuffer(x.as_buffer(), np.uint32, _SIG) for x in batch.column(2)]
            keys = both_keys(np.array(first).reshape(-1, _SIG), np.array(sets).reshape(-1, _WIDTH)[:, :_SIG])
            bands = [x.tobytes() for x in (keys >> np.uint64(1)).astype(np.uint32)]
            sigs_ = [np.concatenate([x.astype(np.uint8), y, z.astype(np.uint8)]).tobytes() for x, y, z in zip(first, out, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs_, pa.binary()), pa.array(bands, pa.binary())], names=["node", "sig", "own"])

    return texts.join(sigs, "node").select("node", "text", "sig", "df").mapInArrow(run, "node long, sig binary, own binary")


def _across_components(open_: DataFrame, sigs: DataFrame, first: int | None) -> DataFrame:
    """Pairs (a, b), a < b, of different components in a bucket(key, node, comp) whose samples agree in the bucket's view.

    A bucket's members are dealt to blocks of about BLOCK, and every two blocks meet in a task of their
    own. Members outside the largest component there are compared with all members of other
    components, piece by piece, on 8 bits of each sample; only pairs that agree leave the task. With
    ``first`` only those of them do that first connect two members: fewer than the members, and what
    all the pairs connect they connect too.
    """
    sizes = cut(open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")), "near-blocks")
    hot = heavy(sizes, "n", open_.count()).select("key")
    dealt = join_hot(open_, sizes.select("key", "blocks"), "key", hot, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = _cells(dealt).select("key", "node", "comp", "own", "i", "j")
    signed = sigs.select("node", "sig", F.col("own").alias("keys"))
    two = F.col("key").bitwiseAND(F.lit(255))
    view = F.when(F.floor(two / BANDS) > two % BANDS, 1).otherwise(0)
    parts = [F.col(c).substr((view * n + 1).cast("int"), F.lit(n)).alias(c) for c, n in (("sig", _WIDTH), ("keys", _OWN))]
    rows = cells.join(signed, "node").select("key", "i", "j", "node", "comp", "own", *parts)
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def compare(cell: list[int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, comp, block = (np.array([x[i] for x in held], np.int64) for i in (0, 1, 2))
        sig = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(len(held), -1)
        own = np.frombuffer(b"".join(x[4] for x in held), np.uint32).reshape(len(held), BANDS)
        key, i, j = cell
        two = sorted(divmod(key & 255, BANDS))
        values, sizes_ = np.unique(comp, return_counts=True)
        others = np.flatnonzero(comp != values[sizes_.argmax()])
        main = np.ones(len(node), bool)
        main[others] = False  # pairs of two others are found from both sides: keep one
        known = Joined(len(node))
        step = max(1, 100_000 // len(node))
        for at in range(0, len(others), step):
            o = others[at : at + step]
            score = (sig[o][:, None, :] == sig[None, :, :]).mean(2)
            agree = (score >= LEAST_AGREEMENT_ALL) & (comp[o][:, None] != comp[None, :]) & (main[None, :] | (node[o][:, None] < node[None, :]))
            if i != j:
                agree &= block[o][:, None] != block[None, :]
            x, y = np.nonzero(agree)
            # a pair leaves the bucket of the first two bands that it shares, and no other
            shared = own[o[x]] == own[y]
            before = shared[:, : two[1]].sum(1) - shared[:, two[0]]
            x, y = o[x[before == 0]], y[before == 0]
            if first is not None:
                x, y = known.connecting(x, y)
            if len(x):
                a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(_by_cell(compare), "a long, b long")


class Joined:
    """Which of n members the pairs seen so far connect."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.label = np.arange(n)

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connect two members; false if they were connected."""
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def connecting(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that connect what was apart, the ones of the least members first; they count as seen."""
        apart = self.label[x] != self.label[y]
        x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.array([self.join(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
        if len(new):
            self.label = np.array([self.top(i) for i in range(len(self.up))])
        return x[new], y[new]


def _cells(dealt: DataFrame) -> DataFrame:
    """The rows(own, blocks) once for each cell (i, j), i <= j, of two blocks of which one is their own."""
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _by_cell(compare: Callable[[list[int], list[tuple]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of batches sorted by their first three columns: compare() gets each cell of these and what else its rows have, if they are several."""

    @give_back_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: list[int] = []
        for batch in batches:
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if row[:3] != now:
                    if len(held) > 1:
                        yield from compare(now, held)
                    held, now = [], row[:3]
                held.append(tuple(row[3:]))
        if len(held) > 1:
            yield from compare(now, held)

    return run


def _clusters(pairs: DataFrame) -> DataFrame:
    """(node, comp): as components(), with a step first after which only the least neighbours of nodes are left to connect."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("node"), F.least("a", "up").alias("up"))
    least = cut(least, "near-least")
    ends = [least.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in ("a", "b")]
    links = pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct()
    top = components(links).select(F.col("node").alias("up"), "comp")
    return least.join(top, "up", "left").select("node", F.coalesce("comp", "up").alias("comp"))


def _links_within(clusters: DataFrame, comps: DataFrame, sigs: DataFrame, texts: DataFrame, documents: int) -> DataFrame:
    """Links (a, b) that connect what all similar pairs of different components in a cluster(node, comp) connect.

    A cluster's members are dealt to blocks, and every two blocks meet in a task of their own with their texts. The
    texts of each pair that agrees by samples of either view are compared in full, unless links found before
    connect them; so a task gives fewer links than it has members.
    """
    clusters = clusters.withColumnRenamed("comp", "cluster")
    members = clusters.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = cut(members.join(texts.select("node", F.length("text").alias("size")), "node"), "near-members")
    even = F.least(F.ceil(F.count("*") / READ_BLOCK), F.lit(MOST_EVEN))
    blocks = F.greatest(even, F.ceil(F.sum("size") / READ_BYTES)).cast("int").alias("blocks")
    sizes = cut(members.groupBy("cluster").agg(blocks, F.count("*").alias("n")), "near-blocks")
    hot = heavy(sizes, "n", members.count()).select("cluster")
    dealt = join_hot(members.drop("size"), sizes.select("cluster", "blocks"), "cluster", hot, "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = _cells(dealt).select("cluster", "i", "j", "node", "comp", "own")
    rows = cells.join(sigs.select("node", "sig").join(texts.select("node", "text", "df"), "node"), "node").select("cluster", "i", "j", "node", "comp", "own", "sig", "text", "df")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")

    def compare(cell: list[int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, comp, block = (np.array([x[i] for x in held], np.int64) for i in (0, 1, 2))
        sig = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(len(held), 2, _WIDTH)
        vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        part = np.unique(comp, return_inverse=True)[1].tolist()
        known = Joined(max(part) + 1)

        def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in vectors:
                vectors[i] = vector_of(held[i][4], held[i][5], documents)
            return vectors[i]

        links = []
        every = np.arange(len(node))
        step = max(1, 100_000 // len(node))
        for at in range(0, len(node), step):
            o = every[at : at + step]
            score = np.maximum(*((sig[o, v][:, None, :] == sig[None, :, v]).mean(2) for v in (0, 1)))
            agree = (score >= LEAST_AGREEMENT_ALL) & (comp[o][:, None] != comp[None, :]) & (o[:, None] < every[None, :])
            if cell[1] != cell[2]:
                agree &= block[o][:, None] != block[None, :]
            x, y = np.nonzero(agree)
            best = np.argsort(-score[x, y], kind="stable")
            for i, j in zip(o[x[best]].tolist(), y[best].tolist(), strict=True):
                if known.top(part[i]) != known.top(part[j]) and similarity(vector(i), vector(j)) >= SIMILARITY:
                    known.join(part[i], part[j])
                    links.append((i, j))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(node[[x[k] for x in links]]) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(_by_cell(compare), "a long, b long")


def _two_band_buckets(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node) of the nodes in open buckets, keyed by every two bands of a view; the key's last byte tells which two.

    Bands i < j are i * BANDS + j for weights and j * BANDS + i for sets. Nodes of different components that share
    two bands of a view meet in two open buckets of it, so a node with one needs no keys there.
    """
    views = open_.groupBy("node", F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("view")).agg(F.count("*").alias("n")).where("n > 1")
    left = views.join(nodes.select("node", "bands"), "node")
    left = left.select("node", "view", F.slice("bands", F.col("view") * BANDS + 1, F.lit(BANDS)).alias("bands"))
    firsts = F.sequence(F.lit(0), F.lit(BANDS - 2))

    def key(i, b, j):
        low, high = i, i + 1 + j
        code = F.when(F.col("view") == 0, low * BANDS + high).otherwise(high * BANDS + low)
        return F.xxhash64(F.get("bands", i), b, i).bitwiseAND(F.lit(-256)).bitwiseOR(code.cast("long"))

    keys = F.flatten(F.transform(firsts, lambda i: F.transform(F.slice("bands", i + 2, F.lit(BANDS)), lambda b, j: key(i, b, j))))
    return left.select("node", F.explode(keys).alias("key"))


def _open_buckets(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """buckets(key, node) with comp, those that hold more than one component."""
    known = buckets.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return known.join(several, "key", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, class_id, class_size, kept.

    Documents are linked when the Jaccard similarity of their shingles of five lower-cased words is at
    least 0.8, weighted by term frequency and inverse document frequency or plain; a class is a
    connected component and its id its smallest doc_id, which stays. Texts of equal words are one
    node of the graph, so copies are never paired. A text under five words is one shingle; null
    and empty texts are equal and linked with nothing else. Texts of any length are read whole, and
    an empty table gives an empty result.

    A node stands for the words of a text, not for an id. So rows that share an id and differ in
    text are texts of their own, each in the class of its links; such classes may then have the same
    smallest id. A row with a null id is in the class of its text; where no row of a class has an id,
    class_id is null. kept is true for the text with the smallest id of its class (of several with
    this id for one), in all rows that repeat it.
    """
    return _classified(docs, id_col, text_col).select("doc_id", "class_id", "class_size", "kept")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with raw, the digest of a row's text."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _searched(docs, id_col, text_col)


def _searched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    packed = stretches(docs, id_col, text_col)
    n, size = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = (max(LEAST_PARTS, size // PART_BYTES) - 1).bit_length()
    signed = cut(sign(with_frequencies(packed, bits), n), "near-signed")
    free(packed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("first")
    contents = signed.groupBy("content").agg(first, F.count("*").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # numbered in a fixed order, so that a rerun takes the same pivots
    contents = contents.sortWithinPartitions("content").withColumn("node", F.monotonically_increasing_id())
    contents = cut(contents, "near-contents")
    nodes = contents.select("node", "content", F.col("first.doc_id").alias("first_id"), "sig", "bands")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text, df) of the wanted nodes. A Bloom filter of bounded size keeps most others from being shuffled."""
        # the same plan at every size: a merge join also where the wanted ones are few
        wanted = cut(nodes.join(wanted.hint("merge"), "node", "left_semi").select("node", "content", "first_id"), "near-wanted")
        few = Few(wanted, F.col("first_id"))
        asked = wanted.select("node", F.col("content").alias("wanted_content"), "first_id").hint("merge")

        def of_wanted(rows: DataFrame) -> DataFrame:
            same = (F.col("content") == F.col("wanted_content")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
            return rows.join(asked, same).drop("content", "wanted_content", "first_id", "doc_id").dropDuplicates(["node"])

        @give_back_after
        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                contents = [content_of(words(t.as_buffer().to_pybytes())) for t in batch.column(1)]
                yield batch.append_column("content", pa.array(contents, pa.binary()))

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
        rows = few.split(rows, F.col("doc_id"))[0].mapInArrow(digest, "doc_id long, text binary, content binary")
        known = few.split(signed.select("doc_id", "content", "df"), F.col("doc_id"))[0]
        return of_wanted(rows).join(of_wanted(known).hint("merge"), "node")

    comps = near_components(nodes, texts_of, n)
    found = contents.select("content", "node", "size", "first").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = cut(found.select("content", "size", "first", "comp"), "near-classes")
    best = F.min(F.struct("first.none", "first.doc_id", "first.raw", "content")).alias("best")
    classes = cut(found.groupBy("comp").agg(F.sum("size").alias("class_size"), F.count("*").alias("n"), best), "near-sizes")
    hot = heavy(classes, "n", found.count()).select("comp")
    found = cut(join_hot(found, classes.drop("n"), "comp", hot, "content").select("content", "size", "class_size", "best"), "near-sized")
    hot = heavy(found, "size", n).select("content")
    out = join_hot(signed.select("doc_id", "raw", "content"), found, "content", hot, "raw")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("raw") == F.col("best.raw")) & (F.col("content") == F.col("best.content"))
    return out.select("doc_id", "raw", F.col("best.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, the one that near_duplicates keeps; all columns are kept.

    Null and empty texts are one class, of which one row stays; rows that repeat an id and its text
    too. A text that shares its id with others is judged by itself. An empty table stays empty. Only
    rows whose id may be that of a row to drop are shuffled.
    """
    judged = cut(_classified(docs, id_col, text_col).groupBy("doc_id", "raw").agg(F.count("*").alias("n"), F.max("kept").alias("kept")), "near-judged")
    marks = judged.where("not kept or n > 1").select(F.col("doc_id").alias("__gl_id"), F.col("raw").alias("__gl_raw"), F.col("kept").alias("__gl_kept"))
    some, others = Few(marks, F.col("__gl_id")).split(docs, F.col(id_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__gl_id")) & (raw_digest(F.col(text_col)) == F.col("__gl_raw"))
    some = some.join(marks, same, "left").where("__gl_kept is null or __gl_kept")
    once = Window.partitionBy("__gl_id", "__gl_raw").orderBy(F.lit(0))
    repeated = some.where("__gl_kept").withColumn("__gl_n", F.row_number().over(once)).where("__gl_n = 1")
    parts = [x.select(*[f"`{c}`" for c in docs.columns]) for x in (some.where("__gl_kept is null"), repeated, others)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates on documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
