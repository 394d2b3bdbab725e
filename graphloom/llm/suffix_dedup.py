"""Suffix dedup: front-coded sorted suffix runs are exchanged and merged by prefix-aware loser trees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Few, cut, table

#: Strings of this many bytes that occur earlier are removed.
LENGTH = 100
#: A window's anchor is its k-mer of the least hash. Equal windows have the same anchor, so
#: sorting the suffixes at anchors, about one in thirty, brings all equal windows together.
KMER = 32
#: Cells of the screening filters for each anchor, hash functions, and the most cells (64 MB of
#: bits). Past the most the filters fill up and more anchors are sorted; results stay exact.
CELLS, HASHES, MOST_CELLS = 8, 2, 2**29
SHARD = 2**20
#: Bytes of text whose anchors are found at once, suffixes of a run, and bytes of text for each range of the merge.
CHUNK, RUN, RANGE_BYTES = 1 << 17, 200_000, 8 << 20
#: Merged suffixes that are looked through at once; a group of one anchor is never cut.
BATCH = 20_000
_POSITION_BITS = 20
_HEAD = 8
_NO_ID = -(2**63)

_rng = np.random.RandomState(77)
_BYTE = _rng.randint(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.empty(0, _U), np.empty(0, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, _U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_POWERS = _Powers(_BASE)


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every ``length`` bytes in a row of data."""
    n = len(data)
    up, down = _POWERS.of(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    x = (sums[length:] - sums[: n - length + 1]) * down[: n - length + 1]
    x ^= x >> _U(32)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    return x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash) of the runs of windows that share an anchor.

    data holds texts end to end, [starts, ends) each; windows don't cross texts. The anchor is the
    leftmost k-mer of least hash, a function of the window's bytes alone.
    """
    none = np.empty(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none.astype(_U)
    h = rolling(data, KMER)
    low = (h >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | np.arange(len(h), dtype=_U)
    span, size = LENGTH - KMER + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    at = (np.minimum(low[:n], low[span - size : span - size + n]) & _U(2**_POSITION_BITS - 1)).astype(np.int64)
    change = np.zeros(n + 1, np.int64)
    long_ = ends - starts >= LENGTH
    np.add.at(change, starts[long_], 1)
    np.add.at(change, ends[long_] - LENGTH + 1, -1)
    valid = np.cumsum(change[:n]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    new[starts[long_]] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    # a run ends before the next one starts or where its text's windows end
    text = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(stop - 1, ends[text] - LENGTH)
    return at[first], first, last, h[at[first]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """Chunks of texts of at least LENGTH bytes: their (id, tag, offset), joined bytes, starts and ends.

    A text longer than CHUNK comes in pieces that overlap by less than a window, so that each of its
    windows is in one piece.
    """
    keys: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    size = 0

    def chunk():
        data = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts])
        return list(keys), np.frombuffer(data, np.uint8), data, ends - [len(p) for p in parts], ends

    for batch in batches:
        ids, tagged = batch.column(0).to_pylist(), batch.num_columns > 2
        for doc_id, text in zip(ids, batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if len(raw) < LENGTH:
                continue
            tag = xxhash.xxh3_64_intdigest(raw) >> 1 if tagged else 0
            for offset in range(0, len(raw) - LENGTH + 1, CHUNK):
                piece = raw if len(raw) <= CHUNK else raw[offset : offset + CHUNK + LENGTH - 1]
                if parts and size + len(piece) > CHUNK:
                    yield chunk()
                    keys, parts, size = [], [], 0
                keys.append((doc_id, tag, offset))
                parts.append(piece)
                size += len(piece)
    if parts:
        yield chunk()


def _cells(h: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    for i in range(HASHES):
        yield ((h * _U(0x9FB21C651E98DF25 + 2 * i) >> _U(20)) & _U(cells - 1)).astype(np.int64)


def _spread(h: np.ndarray) -> np.ndarray:
    """An even order of anchors: their own hashes are the least of their windows, so all are small."""
    x = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, all first bytes, all second bytes and so on, which the exchange compresses well."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> list[int]:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel().tolist()


def repeated_anchors(rows: DataFrame, cells: int) -> bytes:
    """One bit a cell: more than one anchor of the corpus falls into it."""
    shard = min(SHARD, cells)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                at, seen = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                for cells_, into in ((at, once), (at[seen > 1], twice)):
                    byte, bit = cells_ >> 3, (128 >> (cells_ & 7)).astype(np.uint8)
                    if into is once:
                        known = cells_[(once[byte] & bit) > 0]
                        np.bitwise_or.at(twice, known >> 3, (128 >> (known & 7)).astype(np.uint8))
                    np.bitwise_or.at(into, byte, bit)

        n = 0
        for _, data, _, starts, ends in _texts(batches):
            h = anchors(data, starts, ends)[3]
            # cells of one anchor that coincide count once
            both = np.stack(list(_cells(h, cells)), axis=1)
            both.sort(axis=1)
            keep = np.ones(both.shape, bool)
            keep[:, 1:] = both[:, 1:] != both[:, :-1]
            held.append(both[keep])
            n += len(held[-1])
            if n > 2_000_000:
                add()
                n = 0
        add()
        for k in range(cells // shard):
            a, b = k * shard // 8, (k + 1) * shard // 8
            if once[a:b].any():
                yield pa.RecordBatch.from_pydict({"shard": [k], "once": [zlib.compress(once[a:b], 1)], "twice": [zlib.compress(twice[a:b], 1)]})

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

    filters = rows.mapInArrow(fill, "shard long, once binary, twice binary")
    merged = filters.repartition(min(256, cells // shard), "shard").mapInArrow(merge, "shard long, twice binary")
    out = bytearray(cells // 8)
    for k, twice in merged.toLocalIterator():  # at most MOST_CELLS bits in all
        out[k * shard // 8 : (k + 1) * shard // 8] = zlib.decompress(twice)
    return bytes(out)


#: A removed stretch has doc, tag, low, high. A block of a run has its range, counts and front-coded suffixes.
SPANS = "doc long, tag long, low long, high long"
_BLOCK = "part long, lcp binary, size binary, right binary, rest binary, docs binary, tags binary, places binary"
RUNS = f"{SPANS}, {_BLOCK}"
_RUN_TYPES = (*[pa.int64()] * 5, *[pa.binary()] * 7)
_RUN_NAMES = [f.split()[0] for f in RUNS.split(", ")]


def front_code(keys: list[bytes]) -> np.ndarray:
    """The length of the prefix that each key shares with the one before."""
    width = max(map(len, keys))
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    out = np.zeros(len(keys), np.int64)
    if not width:
        return out
    for a in range(0, len(keys), 50_000):
        own = keys[max(0, a - 1) : a + 50_000]
        grid = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in own), np.uint8).reshape(len(own), width)
        differ = grid[1:] != grid[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width)
        out[max(1, a) : a + 50_000] = common
    out[1:] = np.minimum(out[1:], np.minimum(lengths[1:], lengths[:-1]))
    return out


def sorted_runs(rows: DataFrame, repeated: bytes, cells: int, ranges_bits: int) -> DataFrame:
    """Blocks of sorted runs of the suffixes at suspected anchors, and what a run alone shows to be repeated.

    A suffix's key is its anchor's hash, then the bytes from the anchor to the end of its last
    window, then the bytes before the anchor, backwards. Of equal keys of a run the earliest is
    kept; the others' windows are all repeated.
    """
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        held: list[tuple[bytes, int, int, int, int]] = []
        for keys, data, raw, starts, ends in _texts(batches):
            at, first, last, h = anchors(data, starts, ends)
            suspect = np.ones(len(h), bool)
            for c in _cells(h, cells):
                suspect &= ((bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1).astype(bool)
            at, first, last, h = at[suspect], first[suspect], last[suspect], h[suspect]
            owner = np.searchsorted(starts, first, "right") - 1
            place = (at - starts[owner]).tolist()
            head = _spread(h).astype(">u8").tobytes()
            for i, (o, m, p, q, x) in enumerate(zip(owner.tolist(), at.tolist(), first.tolist(), (last + LENGTH).tolist(), place, strict=True)):
                doc, tag, offset = keys[o]
                held.append((head[8 * i : 8 * i + 8] + raw[m:q] + raw[p:m][::-1], q - m, doc, tag, x + offset))
            if len(held) >= RUN:
                yield from blocks(held)
                held = []
        if held:
            yield from blocks(held)

    def blocks(held: list[tuple[bytes, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        held.sort()
        kept, spans = [], []
        for x in held:
            if kept and x[0] == kept[-1][0] and x[1] == kept[-1][1]:
                if x[2:] != kept[-1][2:]:
                    spans.append(_whole(x))
            else:
                kept.append(x)
        if spans:
            columns = [pa.array(c, pa.int64()) for c in zip(*spans, strict=True)]
            columns += [pa.array([x[0] % 2**ranges_bits for x in spans], pa.int64()), *(pa.nulls(len(spans), t) for t in _RUN_TYPES[5:])]
            yield pa.RecordBatch.from_arrays(columns, names=_RUN_NAMES)
        keys = [x[0] for x in kept]
        lcp = front_code(keys)
        part = np.fromiter((int.from_bytes(k[:_HEAD]) >> (64 - ranges_bits) for k in keys), np.int64, len(keys)) if ranges_bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        lcp[edges] = 0
        size = np.fromiter(map(len, keys), np.int64, len(keys)).astype(np.uint8)
        right, docs, tags, places = (np.array([x[i] for x in kept], t) for i, t in ((1, np.uint8), (2, np.int64), (3, np.int64), (4, np.int64)))
        starts = lcp.tolist()
        out = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True):
            rest = b"".join(keys[i][starts[i] :] for i in range(a, b))
            arrays = (lcp[a:b].astype(np.uint8), size[a:b], right[a:b], rest, *(_planes(x[a:b]) for x in (docs, tags, places)))
            out.append((None, None, None, None, int(part[a]), *(x if isinstance(x, bytes) else x.tobytes() for x in arrays)))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RUN_TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=_RUN_NAMES)

    return rows.mapInArrow(run, RUNS)


def _whole(x: tuple[bytes, int, int, int, int]) -> tuple[int, int, int, int]:
    """The stretch of all windows of a suffix (key, right, doc, tag, place)."""
    left = len(x[0]) - _HEAD - x[1]
    return x[2], x[3], x[4] - left, x[4] + x[1]


def _decode(block: tuple[bytes, ...]) -> Iterator[tuple[int, tuple[bytes, int, int, int, int]]]:
    """(length shared with the one before, suffix) of a block."""
    lcp, size, right, rest, docs, tags, places = block
    numbers = map(_from_planes, (docs, tags, places))
    key, at = b"", 0
    for k, n, r, doc, tag, place in zip(lcp, size, right, *numbers, strict=True):
        key = key[:k] + rest[at : at + n - k]
        at += n - k
        yield k, (key, r, doc, tag, place)


def _shared(a: bytes, b: bytes, start: int) -> int:
    """The length of the common prefix of a and b, which are known to agree before start."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n]) ^ int.from_bytes(b[start:n])
    return n - (x.bit_length() + 7) // 8


def merge_runs(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """Merge sorted front-coded runs into one, each suffix with the prefix it shares with the one before.

    A loser tree whose entries know the prefix they share with the last suffix put out. Of two
    entries the one that shares more is the smaller; only where both share as much are bytes
    compared, from there on. A run's next suffix comes with that length from its front coding.
    """
    n = 1
    while n < len(runs):
        n *= 2
    heads: list[tuple | None] = [None] * n
    shared = [0] * n
    for i, r in enumerate(runs):
        first = next(r, None)
        heads[i] = first and first[1]
    losers = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shared[a], shared[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        k, l = x[0], y[0]
        m = _shared(k, l, p)
        if m == len(k) or (m < len(l) and k[m] < l[m]):
            shared[b] = m
            return a, b
        shared[a] = m
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    winner = build(1) if n > 1 else 0
    while (head := heads[winner]) is not None:
        yield shared[winner], head
        following = next(runs[winner], None)
        if following is None:
            heads[winner] = None
        else:
            shared[winner], heads[winner] = following
        node = (winner + n) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated_windows(lcp: list[int], suffixes: list[tuple[bytes, int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of the windows of merged suffixes that occur earlier among them.

    lcp is what each suffix shares with the one before in the merged order, so it tells the runs
    of suffixes that agree in any number of bytes from the anchor on. The bytes before the
    anchor, read backwards, are sorted and front-coded likewise. A window that starts d bytes
    before its anchor equals another one exactly if both are in one run of 100 - d bytes from the
    anchor on and in one run of d bytes before it. Of equal windows the earliest stays.
    """
    n = len(suffixes)
    right, doc, tag, place = (np.fromiter((x[i] for x in suffixes), np.int64, n) for i in (1, 2, 3, 4))
    before = [x[0][_HEAD + x[1] :] for x in suffixes]
    left = np.fromiter(map(len, before), np.int64, n)
    onward = np.array(lcp, np.int64) - _HEAD
    order = sorted(range(n), key=before.__getitem__)
    backward = front_code([before[i] for i in order])
    order = np.array(order)
    earliest = np.lexsort((place, tag, doc))
    changes = np.zeros(n, bool)
    for c in (doc, tag, place):
        changes[1:] |= c[earliest][1:] != c[earliest][:-1]
    # rows that repeat an id and its text give one suffix twice, which isn't a repeat
    own = np.empty(n, np.int64)
    own[earliest] = np.cumsum(changes)
    gone = np.zeros((n, LENGTH - KMER + 1), bool)
    group = np.empty(n, np.int64)
    for d in range(LENGTH - KMER + 1):
        at = earliest[((right >= LENGTH - d) & (left >= d))[earliest]]
        if len(at) < 2:
            continue
        group[order] = np.cumsum(backward < d)
        both = (np.cumsum(onward < LENGTH - d) * (n + 1) + group)[at]
        rank = np.argsort(both, kind="stable")
        new = np.append(True, both[rank][1:] != both[rank][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[rank]
        gone[at[own[at] != own[at[first]]], d] = True
    edges = np.diff(gone.astype(np.int8), axis=1, prepend=0, append=0)
    row, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1]  # in the same order: rows first, then distances
    yield from zip(doc[row].tolist(), tag[row].tolist(), (place[row] - high + 1).tolist(), (place[row] - low + LENGTH).tolist(), strict=True)


def merged_spans(runs: DataFrame, tasks: int) -> DataFrame:
    """The stretches that the merged runs of every range show to be repeated, and those that single runs have shown."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            known = pc.is_null(batch.column(5))
            yield batch.filter(known).select([0, 1, 2, 3])
            batch = batch.filter(pc.invert(known))
            for part, *block in zip(*(batch.column(i).to_pylist() for i in range(4, 12)), strict=True):
                blocks.setdefault(part, []).append(tuple(block))
        for part in sorted(blocks):
            lcps: list[int] = []
            suffixes: list[tuple] = []
            start = 0  # of the last group
            for lcp, x in merge_runs([_decode(b) for b in blocks.pop(part)]):
                if lcp < _HEAD + KMER:
                    if len(suffixes) - start == 1:  # alone at its anchor
                        lcps.pop()
                        suffixes.pop()
                    if len(suffixes) >= BATCH:
                        yield found(lcps, suffixes)
                        lcps, suffixes = [], []
                    start = len(suffixes)
                lcps.append(lcp)
                suffixes.append(x)
            if len(suffixes) - start == 1:
                lcps.pop()
                suffixes.pop()
            if suffixes:
                yield found(lcps, suffixes)

    def found(lcps: list[int], suffixes: list[tuple]) -> pa.RecordBatch:
        spans = list(repeated_windows(lcps, suffixes))
        columns = [pa.array(c, pa.int64()) for c in zip(*spans, strict=True)] if spans else [pa.array([], pa.int64())] * 4
        return pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "low", "high"])

    return runs.repartition(tasks, "part").mapInArrow(merge, SPANS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, kept (the bytes that are left), n_bytes, n_removed, n_spans.

    Texts are UTF-8 bytes, null ones are empty, and matches don't cross rows. A byte goes if a
    100-byte string over it also starts earlier: at a smaller doc_id, or before in the same text;
    strings are judged on the input. A null id is before all others (it counts as -2**63). Rows
    that share an id are in the order of a hash of their texts; equal rows are one text and treated
    alike. n_spans counts the maximal removed runs. An empty table gives an empty result; a text of
    any length is looked through whole, in pieces. Other columns aren't read.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(str(_NO_ID)).cast("long"))
    rows = docs.select(key.alias("doc"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    tagged = bool(rows.groupBy("doc").count().where("count > 1").take(1))
    if tagged:
        rows = rows.withColumn("tagged", F.lit(True))
    cells = min(MOST_CELLS, max(2**16, 1 << (CELLS * size // 32).bit_length()))
    # four ranges a task even out what a hash of few ranges would not
    bits = 2 + max(0, min(18, (size // RANGE_BYTES).bit_length()))
    repeated = repeated_anchors(rows, cells)
    spans = merged_spans(sorted_runs(rows, repeated, cells, bits), 2 ** (bits - 2))
    spans = cut(spans, "suffix-spans").groupBy("doc", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = cut(spans, "suffix-lists")
    # the same tag as in _texts, which tells rows of one id apart
    tag = F.lit(0).cast("long")
    if tagged:
        tag_rows = rows.select("doc", "text").mapInArrow(_tagged, "doc long, text string, tag long")
    else:
        tag_rows = rows.select("doc", "text", tag.alias("tag"))
    # only texts that lose something are shuffled
    some, others = Few(spans, F.col("doc")).split(tag_rows, F.col("doc"))
    listed = some.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans")
    joined = listed.unionByName(others.select("doc", "text", F.lit(None).cast(listed.schema["spans"].dataType).alias("spans")))
    out = joined.mapInArrow(_rewrite, "doc long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumn("doc_id", F.when(F.col("doc") != F.lit(str(_NO_ID)).cast("long"), F.col("doc"))).drop("doc")


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
        tags = [xxhash.xxh3_64_intdigest(r) >> 1 for r in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tags, pa.int64())], names=["doc", "text", "tag"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            merged: list[list[int]] = []
            if spans.is_valid:
                low, high = (spans.values.field(i).to_pylist() for i in (0, 1))
                for a, b in sorted(zip(low, high, strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
            edges = [0, *(x for m in merged for x in m), len(raw)]
            kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((kept, len(raw), len(raw) - len(kept), len(merged)))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", "kept", "n_bytes", "n_removed", "n_spans"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats on documents, with the digest of the bytes that are left."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again
      FROM (SELECT doc_id, p, substr(h, 2 * p - 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100))),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS starts FROM w WHERE again),
i AS (SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
s AS (SELECT doc_id, k, min(p) AS low, max(p) + 100 AS high FROM i GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(high) OVER o, 1) AS a, low AS b FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY low)
         UNION ALL SELECT doc_id, max(high), NULL FROM s GROUP BY doc_id
         UNION ALL SELECT doc_id, 1, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a - 1, 2 * (coalesce(b, n + 1) - a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(high - low)::BIGINT AS n_removed FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)
"""
