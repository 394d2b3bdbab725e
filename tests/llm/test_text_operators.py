"""Toxicity, near-duplicates, line and suffix dedup, media and the pipeline against brute force."""

import collections
import gc
import hashlib
import io
import itertools
import os
import random
import zipfile
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, line_dedup, media, near_dup, suffix_dedup, toxicity
from graphloom.llm.common import cut

SF = "/root/testdata/sf0.001"
EDGE = [(1, "a b"), (2, "ab"), (3, None), (None, ""), (5, "ba c"), (5, "ba c"), (7, "a  b"), (8, "lang " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    for name in ("key", "score", "bands", "content", "spans", "doc", "error"):
        df = df.withColumn(name, F.lit("extra"))
    return df


# line dedup


def lines_by_hand(rows):
    def key(x):
        return line_dedup.line_key(x)

    where = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            where[k].append(i)
    out = []
    for i, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            ids = where[key(x)]
            known = [j for j in ids if j is not None]
            if len(key(x)) < 20 or len(ids) < 3 or i == (max(known) if known else None):
                kept.append(x)
        out.append((i, "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [f"  Line number {i} with some Words É\t" for i in range(6)] + ["short", "", "   ", "line number 1 with some words É"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(None, pool[0]), (None, pool[1]), (50, None), (51, pool[2]), (51, pool[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", F.lit(1)).withColumn("drops", F.lit(2))
    assert sorted(map(tuple, line_dedup.dedup_lines(df).select("doc_id", "kept").collect()), key=repr) == lines_by_hand(rows)


def test_line_dedup_is_exact_with_full_filters(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_CELLS", 64)
    rows = [(i, f"a line of more than twenty {i % 7}\nanother line, only here, {i}") for i in range(30)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_hand(rows)


# suffix dedup


def suffixes_by_hand(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (kept, len(b), sum(gone), spans)
    return out


def removed(spark, rows, parts=4):
    df = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("tag", F.lit(1)))
    return {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in df.collect()}


def test_suffix_dedup(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(5)]
    base = "the quick é " * 40
    rows = [(i, rng.choice(pool)[rng.randint(0, 90) : rng.randint(200, 400)] + rng.choice(pool)[rng.randint(0, 200) :] + "x" * rng.randint(0, 300) + base[: rng.randint(0, 400)]) for i in range(40)]
    rows += [(99, None), (100, ""), (101, "a" * 100), (102, "a" * 99)]
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    rows += [(200, long + rows[3][1]), (201, long[1000:190_000])]
    assert removed(spark, rows) == suffixes_by_hand(rows)


def test_suffix_dedup_with_full_filters_and_small_batches(spark, monkeypatch):
    rng = random.Random(2)
    middle = "".join(rng.choice("abc") for _ in range(90))
    rows = [(i, "".join(rng.choice("de") for _ in range(12)) + middle + "".join(rng.choice("fg") for _ in range(12))) for i in range(150)]
    monkeypatch.setattr(suffix_dedup, "BATCH", 5)
    monkeypatch.setattr(suffix_dedup, "MOST_CELLS", 2**16)
    assert removed(spark, rows, 3) == suffixes_by_hand(rows)


def test_repeated_windows_compare_bytes():
    """Windows around one anchor, by all pairs."""
    rng = random.Random(6)
    anchor, suffixes = b"k" * 32, []
    for i in range(60):
        left = bytes(rng.choice(b"ab") if j > 3 else 99 for j in range(rng.randint(0, 68)))
        right = anchor + bytes(rng.choice(b"xy") if j > 60 else 120 for j in range(100 - 32 - min(len(left), rng.randint(0, 30))))
        suffixes.append((b"12345678" + right + left, len(right), i, 0, 500 + rng.randint(0, 3)))
    suffixes += [suffixes[7], (*suffixes[9][:2], 3, 5, 9)]
    suffixes.sort()
    lcp = suffix_dedup.front_code([x[0] for x in suffixes]).tolist()
    windows, want = {}, set()
    for key, n, doc, tag, place in sorted(set(suffixes), key=lambda x: x[2:]):
        right, left = key[8 : 8 + n], key[8 + n :][::-1]
        for d in range(100 - n, min(len(left), 68) + 1):
            w = left[len(left) - d :] + right[: 100 - d]
            if windows.setdefault((w, d), (doc, tag, place)) != (doc, tag, place):
                want.add((doc, tag, place - d))
    got = {(doc, tag, p) for doc, tag, low, high in suffix_dedup.repeated_windows(lcp, suffixes) for p in range(low, high - 99)}
    assert got == want and want


def test_suffix_dedup_repeated_and_null_ids(spark):
    rows = [(None, "q" * 150), (1, "q" * 150), (2, "z" * 120), (2, "z" * 120), (2, "q" * 120)]
    df = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in df.collect())
    # of the null id's text the first 100 bytes start nowhere before, only the first byte is in no later window; equal rows of id 2 are one text
    assert got == [(-1, 150, 149), (1, 150, 150), (2, 120, 119), (2, 120, 119), (2, 120, 120)]


def test_suffix_dedup_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    df = spark.createDataFrame([(1, "r" * 101)], "doc_id long, text string")
    for name in ("doc", "tag", "low", "high", "spans", "kept", "part", "count", "n_bytes"):
        df = df.withColumn(name, F.lit("extra"))
    out = suffix_dedup.remove_repeats(df).collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out] == [(1, 101, 100, 1)]


def test_merge_knows_prefixes():
    rng = random.Random(7)
    runs = []
    for _ in range(5):
        keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))})
        lcp = suffix_dedup.front_code(keys).tolist() if keys else []
        runs.append([(n, (k, 0, 0, 0, 0)) for n, k in zip(lcp, keys, strict=True)])
    merged = list(suffix_dedup.merge_runs([iter(r) for r in runs]))
    keys = [x[0] for _, x in merged]
    assert keys == sorted(k for r in runs for _, (k, *_) in r)
    for (n, (b, *_)), (a, *_) in zip(merged[1:], (x for _, x in merged), strict=False):
        assert n == len(os.path.commonprefix([a, b]))


# near-duplicates


def classes_by_hand(rows, docs):
    frequencies, n = near_dup.document_frequencies(docs, "text")
    idf = near_dup.idf_table(frequencies, n)
    vectors = {}
    for i, t in rows:
        h, tf = near_dup.shingles(near_dup.words((t or "").encode()))
        vectors[i] = (h, near_dup.weights(h, tf, idf))
    parent = {i: i for i in vectors}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(vectors), 2):
        empty = not len(vectors[i][0]) and not len(vectors[j][0])
        if empty or near_dup.similarity(vectors[i], vectors[j]) >= 0.8:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in vectors}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklm") + rng.choice("nopqrst")
    shared = [word() for _ in range(120)]
    rows, n = [], 0
    for _ in range(8):
        base = [word() for _ in range(200)] + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, "one two"), (n + 1, "One  TWO"), (n + 2, None), (n + 3, ""), (n + 4, " ".join(shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    want = classes_by_hand(rows, docs)
    assert got == want and len(set(want.values())) < len(rows)


def test_rare_shingles_weigh_by_their_own_frequency(spark):
    rng = np.random.RandomState(3)
    word = np.array([f"w{i}" for i in range(30_000)])
    own, one, other = (" ".join(rng.choice(word, n)) for n in (404, 206, 206))
    rows = [(i, f"{one} {' '.join(rng.choice(word, 20_000))} {other}") for i in range(300)] + [(1000, f"{own} {one}"), (1001, f"{own} {other}")]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    a, b = (grams(t) for _, t in rows[-2:])
    seen = collections.Counter(g for _, t in rows for g in grams(t) & (a | b))
    weight = {g: np.log((len(rows) + 1) / (n + 1)) + 1 for g, n in seen.items()}
    similarity = sum(weight[g] for g in a & b) / sum(weight[g] for g in a | b)
    assert similarity >= 0.82
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: min(i, 1000) for i, _ in rows}


def test_near_copies_of_a_large_group_are_linked(spark):
    """Copies make a text's shingles frequent, an edit's stay rare: by weights alone these near copies are under 0.8."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(140)]
    edited = [[*base[:p], word(), *base[p + 1 : p + 60], word(), *base[p + 61 :]] for p in range(10, 70, 15)]
    rows = [(i, " ".join(base)) for i in range(150)] + [(150 + i, " ".join(t)) for i, t in enumerate(edited)]
    rows += [(i, " ".join(word() for _ in range(140))) for i in range(200, 400)]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    seen = collections.Counter(g for _, t in rows for g in grams(t))
    weight = {g: np.log((len(rows) + 1) / (n + 1)) + 1 for g, n in seen.items()}
    one = grams(rows[0][1])
    for _, t in rows[150:154]:
        both, either = one & grams(t), one | grams(t)
        assert len(both) / len(either) >= 0.85 and sum(weight[g] for g in both) / sum(weight[g] for g in either) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: 0 if i < 200 else i for i, _ in rows}


def test_a_member_that_its_best_pivot_links_is_read_once(spark, monkeypatch):
    read, verify = [], near_dup.verify

    def counted(pairs, *args, **kwargs):
        read.append(pairs.count())
        return verify(pairs, *args, **kwargs)

    monkeypatch.setattr(near_dup, "verify", counted)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(300)]
    rows = [(i, " ".join([*base[:p], word(), *base[p + 1 :]])) for i, p in enumerate(range(0, 300, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["class_id"] for r in near_dup.near_duplicates(docs).collect()} == {0}
    assert sum(read) <= 1.5 * len(rows)


def test_set_samples_agree_like_plain_jaccard():
    h = near_dup._mix(np.arange(1, 1201, dtype=np.uint64))
    s = near_dup.set_samples(np.concatenate([h[:1000], h[200:]]), np.array([0, 1000]), range(near_dup._SIG + near_dup.MORE))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12


def test_python_gets_small_batches_and_the_setting_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 2**20).alias("text")).mapInArrow(sizes, "n long")
    with common.arrow_batches(spark, 2**22):
        got = [r["n"] for r in rows.collect()]
    assert sum(got) == 40 and max(got) <= 8 and spark.conf.get(key, None) == before


def test_collections_leave_out_what_a_worker_had_before():
    def run(batches):
        yield gc.get_freeze_count()
        yield from batches

    frozen = gc.get_freeze_count()
    try:
        assert next(common.give_back_after(run)(iter([]))) > 10_000
    finally:
        if not frozen:
            gc.unfreeze()


def test_rows_that_share_an_id_are_texts_of_their_own(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    one, other = [word() for _ in range(150)], [word() for _ in range(150)]
    edited = lambda t: " ".join([*t[:70], word(), *t[71:]])
    rows = [(2, " ".join(one)), (5, edited(one)), (5, " ".join(other)), (9, edited(other)), (None, edited(one)), (7, "alone in the world of texts"), (7, "alone in the world of texts")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("raw", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    got = sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(2, 2, 3, True), (5, 2, 3, False), (None, 2, 3, False), (5, 5, 2, True), (9, 5, 2, False), (7, 7, 2, True), (7, 7, 2, True)], key=repr)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([rows[0], rows[2], rows[5]])


def test_templated_texts_by_brute_force(spark, monkeypatch):
    """Many texts of one template whose similarities lie around the least that counts, in blocks of few."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "FIRST", 1)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    template = [word() for _ in range(260)]
    rows = []
    for i in range(140):
        n = rng.choice([4, 8, 30, 60])
        rows.append((i, " ".join([*template[: 260 - n], *[word() for _ in range(n)]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = classes_by_hand(rows, docs)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert 1 < len(set(want.values())) < len(rows) and got == want


def test_pairs_that_agree_and_are_no_links_make_no_rows_of_their_own(spark, monkeypatch):
    """Texts of one template of a similarity under 0.8, in small blocks, and a few links among them that no bucket's pivot finds."""
    monkeypatch.setattr(near_dup, "READ_BLOCK", 16)
    read, verify, across = [], near_dup.verify, near_dup._across_components
    sizes = {}
    monkeypatch.setattr(near_dup, "verify", lambda pairs, *args: read.append(pairs.count()) or verify(pairs, *args))

    def counted(open_, sigs, first):
        sizes.update(members=open_.count(), every=across(open_, sigs, None).distinct().count(), leave=across(open_, sigs, first).count())
        return across(open_, sigs, first)

    monkeypatch.setattr(near_dup, "_across_components", counted)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    template = [word() for _ in range(400)]
    # words of their own at the end: most pairs agree by samples and are under 0.8, some of those with fewer are over it
    rows = [(i, " ".join([*template[: 400 - n], *[word() for _ in range(n)]])) for i, n in enumerate([46] * 90 + [38] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = classes_by_hand(rows, docs)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()} == want
    assert sum(read) <= 8 * len(rows)
    assert sizes["every"] > 2000 and sizes["leave"] < min(sizes["every"], sizes["members"]) and 1 < len(set(want.values()))


def test_pairs_that_first_connect_members_connect_all():
    rng = np.random.RandomState(3)
    known, every = near_dup.Joined(300), near_dup.Joined(300)
    left = 0
    for _ in range(4):
        x, y = rng.randint(0, 300, (2, 80))
        a, b = known.connecting(x, y)
        left += len(a)
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            every.join(i, j)
        assert {(i, j) for i, j in zip(a, b, strict=True)} <= {(min(p), max(p)) for p in zip(x, y, strict=True)}
    tops = [every.top(i) for i in range(300)]
    assert known.label.tolist() == tops and left == 300 - len(set(tops))


def test_blocks_find_every_pair_with_bounded_tasks(spark, monkeypatch):
    """One bucket of 2,000 members: all pairs that agree are found, from cells of about two blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 200)
    rng = np.random.RandomState(9)
    n, width = 2000, near_dup.BANDS * near_dup.ROWS + near_dup.MORE
    sig = rng.randint(0, 256, (n, width), dtype=np.uint8)
    comp = rng.randint(0, n // 2, n)
    comp[:600] = 5_000
    for i in range(60):
        j, k = rng.choice(n, 2, False)
        sig[k] = np.where(rng.random_sample(width) < 0.8, sig[j], sig[k])
    keys = rng.randint(0, 2**31, (n, near_dup.BANDS)).astype(np.uint32)
    keys[:, :2] = 7  # bands 0 and 1 are the first two that all share
    rows = [(i, bytearray(sig[i].tobytes()), bytearray(keys[i].tobytes())) for i in range(n)]
    sigs = spark.createDataFrame(rows, "node long, sig binary, own binary").repartition(4)
    bucket = 256 * 11 + 0 * near_dup.BANDS + 1
    open_ = spark.createDataFrame([(bucket, i, int(comp[i])) for i in range(n)], "key long, node long, comp long")
    agree = {(i, j) for i in range(n) for j in np.flatnonzero((sig[i] == sig[i + 1 :]).mean(1) >= near_dup.LEAST_AGREEMENT_ALL) + i + 1 if comp[i] != comp[j]}
    found = near_dup._across_components(open_, sigs, None)
    assert {tuple(r) for r in found.collect()} == agree and len(agree) >= 50
    some = [tuple(r) for r in near_dup._across_components(open_, sigs, 1).collect()]
    assert {p for p in some if p[0] is not None} <= agree
    members = F.pmod(F.xxhash64("node"), F.lit(n // 200))
    assert open_.groupBy(members).count().agg(F.max("count")).first()[0] < 2 * 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_near_duplicate_recall(spark):
    """Documents whose id is divisible by 50 against all: texts of similarity 0.8 or more share a class."""
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    idf = near_dup.idf_table(*near_dup.document_frequencies(docs, "text"))
    vectors = {}
    for i, t in rows:
        h, tf = near_dup.shingles(near_dup.words((t or "").encode()))
        vectors[i] = (h, near_dup.weights(h, tf, idf))
    found = total = 0
    for i in (i for i in vectors if i % 50 == 0):
        for j in vectors:
            if i != j and near_dup.similarity(vectors[i], vectors[j]) >= near_dup.SIMILARITY:
                total += 1
                found += classes[i] == classes[j]
    assert found >= 0.9 * total


def test_near_duplicates_edges(docs):
    out = near_dup.near_duplicates(docs)
    got = sorted(map(tuple, out.select("doc_id", "class_id").collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (None, 3), (5, 5), (5, 5), (7, 1), (8, 8)], key=repr)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_samples_agree_like_weighted_jaccard():
    rng = np.random.RandomState(0)
    h = near_dup._mix(np.arange(1, 1201, dtype=np.uint64))
    found = []
    for _ in range(20):
        w = rng.uniform(0.5, 6, 1200)
        a, b = np.sort(rng.choice(1200, 900, False)), np.sort(rng.choice(1200, 900, False))
        s = near_dup.samples(np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]), np.array([0, 900]))
        common = np.intersect1d(a, b)
        jaccard = w[common].sum() / w[np.union1d(a, b)].sum()
        found.append((s[0] == s[1]).mean() - jaccard)
    assert abs(np.mean(found)) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 20) if i != 9] + [(30, 40)], "a long, b long")
    got = dict(map(tuple, near_dup.components(links).collect()))
    assert got == {**{i: 0 for i in range(10)}, **{i: 10 for i in range(10, 21)}, 30: 30, 40: 30}


# toxicity


def test_what_a_model_keeps_is_bounded(monkeypatch):
    model = toxicity.ToxicityModel(toxicity.CharacterModel(np.ones(toxicity.SYMBOLS**3, np.int64)), 10, 10, {"bad": (9, 0)}, (0.0, 1.0, 0.0, 0.0))
    texts = [" ".join(f"word{i}x{j} bad" for j in range(50)) for i in range(40)]
    scores = [model.score(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHED", 100)
    model.forget()
    assert [model.score(t) for t in texts] == scores
    assert len(model._cache) <= 101 and len(model._found) <= 101
    model.forget()
    assert not model._cache and not model._found


def test_tokens_without_features_are_looked_at_once(monkeypatch):
    """Also when more of them come by than a table holds: frequent ones stay known, and scores don't depend on what is kept."""
    model = toxicity.ToxicityModel(toxicity.CharacterModel(np.ones(toxicity.SYMBOLS**3, np.int64)), 10, 10, {"bad": (9, 0), "worse": (7, 1)}, (0.0, 1.0, 0.0, 0.0))
    monkeypatch.setattr(toxicity, "CACHED_NONE", 100)
    looked, look = collections.Counter(), toxicity.ToxicityModel._features
    monkeypatch.setattr(toxicity.ToxicityModel, "_features", lambda self, token: looked.update([token]) or look(self, token))
    frequent = [f"fre{i}quent" for i in range(30)]
    texts = [" ".join([*frequent, *(f"word{i}x{j}" for j in range(40)), "bad", "worse"]) for i in range(30)]
    scores = [model.score(t) for t in texts]
    assert len(set(scores)) == 1 and scores[0] > 0.5
    assert all(looked[w] == 1 for w in [*frequent, "bad"]) and max(looked.values()) == 1
    assert len(model._none) <= 200 and len(model._older) <= 200
    model.forget()
    assert not model._none and not model._older and model.score(texts[-1]) == scores[0]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    calm = ["reading", "garden", "window", "silver", "the", "and", "river", "letter", "orange", "tower"]
    rude = ["blockhead", "dunce", "nitwit"]
    disguise = {"blockhead": "bl0ckh3ad", "dunce": "d u n c e", "nitwit": "n1tw1ttttt"}
    rows = []
    for i in range(600):
        words, bad = [rng.choice(calm) for _ in range(rng.randint(3, 40))], rng.random() < 0.3
        if bad:
            w = rng.choice(rude)
            words.insert(rng.randrange(len(words)), disguise[w] if rng.random() < 0.3 else w)
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (7777, 1)], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_toxicity_held_out(labelled):
    docs, labels, truth = labelled
    got = toxicity.score_toxicity(docs.withColumn("score", F.lit(1)), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 100 and sum(r["predicted"] != truth[r["doc_id"]] for r in held) <= 0.05 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"] < toxicity.THRESHOLD and all(0 <= r["score"] <= 1 for r in got)


def test_restoring(labelled):
    model = toxicity.CharacterModel(toxicity.trigram_counts(labelled[0]))
    disguised = (
        ("bl0ckh3ad", "blockhead"), ("d.u.n.c.e", "dunce"), ("gaaaarden", "garden"), ("t0w3r", "tower"), ("$ilver", "silver"), ("garrden", "garden"),
        ("wiindoow", "window"), ("|etter", "letter"), ("(dunce", "dunce"), ("d u n c e", "dunce"), ("d  u  n  c  e", "dunce"), ("d . u . n . c . e", "dunce"),
        ("d--u--n--c--e", "dunce"), ("du n c e", "dunce"), ("n1tw!t", "nitwit"), ("garden,", "garden"), ("(garden)", "garden"), ("+ower", "tower"),
    )
    for token, plain in disguised:
        assert plain in toxicity.words_of(token, model), token
    assert toxicity.words_of("letter", model) == ["letter"] and toxicity.words_of("reading", model) == ["reading"]
    assert toxicity.words_of("?#", model) == []
    assert toxicity.spaced_runs("see d u n c e now") == ["d u n c e"] and toxicity.spaced_runs("a b") == []
    assert toxicity.spaced_runs("d  u -- n . c * e") == ["d  u -- n . c * e"] and toxicity.spaced_runs("it is so to be") == []


def test_tokens_are_decoded_wherever_that_can_matter(labelled):
    """The weight of any token is that without the look at its letters that saves decoding."""
    characters = toxicity.CharacterModel(toxicity.trigram_counts(labelled[0]))
    words = ["dunce", "clown", "nitwit", "asses", "letter"]
    model = toxicity.ToxicityModel(characters, toxic=50, clean=50, counts={f: (40, 0) for w in words for f in toxicity.features_of(w)})
    every = toxicity.ToxicityModel(characters, toxic=50, clean=50, counts=model.counts)
    every.may_matter = lambda token: True
    rng = random.Random(12)
    back = {"l": "1|", "i": "1!|", "o": "0", "s": "5$", "e": "3", "t": "7+", "c": "(", "a": "4@"}
    found = 0
    for _ in range(3000):
        w = rng.choice([*words, "garden", "dunnes", "lowness", "assort"])
        token = "".join(c * rng.choice([1, 1, 1, 2, 3]) if rng.random() < 0.7 else rng.choice(back.get(c, c)) for c in w)
        token = rng.choice(["", "", "(", "!!", "$", "**"]) + token + rng.choice(["", "", ",", "!", "$$$", "###", ")."])
        assert model.token_weight(token) == every.token_weight(token), token
        found += every.token_weight(token) > 0
    assert found > 1000


def paths_by_hand(model, token, trim):
    """(score, text) of every path through the lattice of a token."""
    edge = toxicity._EDGE
    inner = token.strip(edge) if trim else token
    head = len(token) - len(token.lstrip(edge)) if trim and inner else 0
    tail = head + len(inner) if trim and inner else len(token)
    done = [(0.0, "  ")]
    for i, c in enumerate(token):
        more = []
        for score, text in done:
            a, b = text[-2:]
            if c.isalpha():
                choices = [(c, toxicity.PLAIN)]
            else:
                choices = [(" ", toxicity.PLAIN if c == " " else toxicity.INSERTED if c in toxicity.SEPARATORS else toxicity.DISGUISED - 2)]
            choices += [(x, toxicity.DISGUISED) for x in toxicity.LEET.get(c, "")]
            for x, cost in choices:
                if x == b == " ":
                    more.append((score + cost, text))
                else:
                    more.append((score + cost + model.log[model.symbol(a)][model.symbol(b)][model.symbol(x)], text + x))
            if not head <= i < tail:
                more.append((score + toxicity.TRIMMED, text))
            elif c in toxicity.SEPARATORS:
                more.append((score + (toxicity.PLAIN if i and token[i - 1] in toxicity.SEPARATORS else toxicity.INSERTED), text))
            elif c == b or b in toxicity.LEET.get(c, ""):
                more.append((score + (toxicity.REPEATED if i > 1 and token[i - 2] == token[i - 1] == c else toxicity.DOUBLED), text))
        done = more
    return [(score + model.log[model.symbol(t[-2])][model.symbol(t[-1])][0], t.strip()) for score, t in done]


def test_viterbi_finds_the_best_of_all_paths(labelled):
    model = toxicity.CharacterModel(toxicity.trigram_counts(labelled[0]))
    rng = random.Random(8)
    for _ in range(300):
        token = "".join(rng.choice("aegrdn11!|.- 0(") for _ in range(rng.randint(1, 7)))
        for trim in (True, False):
            paths = paths_by_hand(model, token, trim)
            best = max(s for s, _ in paths)
            assert model.restore(token, trim) in {t for s, t in paths if s > best - 1e-9}, token


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none).collect()
    assert len(got) == len(EDGE) and all(r["predicted"] == 0 for r in got)
    assert toxicity.drop_toxic(docs, none).columns == docs.columns
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


# media


def media_by_hand(text):
    """All columns of a text but its id, counted byte by byte."""
    b = (text or "").encode()
    p = b + b"\xff" * (576 if not b else -len(b) % 576)
    stored = b"P5\n# n_bytes=%d\n24 %d\n255\n" % (len(b), len(p) // 24) + p
    mean = sum(p) / len(p)
    hist = [sum(k * 32 <= x < k * 32 + 32 for x in p) for k in range(8)]
    variance = sum(x * x for x in p) / len(p) - mean**2
    feature = f"24x{len(p) // 24} mean={mean:.6f} var={variance:.6f} min={min(p)} max={max(p)} hist={','.join(map(str, hist))}"
    return (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, None)


def test_media_round_trip(docs):
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
    got = collections.Counter(tuple(r) for r in media.media_columns(docs.withColumn("feature", F.lit("extra"))).select(*names).collect())
    assert got == collections.Counter((i, *media_by_hand(t)) for i, t in EDGE)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_small_ranges_read_every_member_once(spark, docs):
    from graphloom.llm.common import scratch

    folder = scratch(spark, "ranges")
    cut(media.write_archives(docs.select("doc_id", "text").coalesce(1), folder), "written").count()
    df = media.read_archives(spark, folder, range_bytes=100)
    assert df.rdd.getNumPartitions() > 3 and df.count() == len(EDGE) == df.select("archive", "offset").distinct().count()
    rows = lambda df: sorted(tuple(r) for r in df.select("member", "offset", "media").collect())
    by_sidecar = rows(df)
    local = folder.removeprefix("file://")
    sidecars = [f for f in os.listdir(local) if f.endswith(media.SIDECAR)]
    for name in sidecars:
        os.remove(f"{local}/{name}")
    assert sidecars and rows(media.read_archives(spark, folder, range_bytes=100)) == by_sidecar  # by the archive's own directory


def test_a_broken_member_ends_its_task_or_is_a_row(spark, docs):
    from graphloom.llm.common import scratch

    folder = scratch(spark, "broken")
    cut(media.write_archives(docs.select("doc_id", "text").coalesce(1), folder), "written").count()
    local = folder.removeprefix("file://")
    name = next(f for f in os.listdir(local) if f.endswith(".zip"))
    raw = bytearray(open(f"{local}/{name}", "rb").read())
    at = raw.index(b"PK\3\4", 10)
    raw[at] ^= 1
    open(f"{local}/{name}", "wb").write(raw)
    with pytest.raises(Exception, match="no member at"):
        media.read_archives(spark, folder, attempts=1).count()
    out = media.read_archives(spark, folder, attempts=2, on_error="row").collect()
    assert len(out) == len(EDGE) and [(r["offset"], r["media"], r["attempts"]) for r in out if r["error"]] == [(at, None, 2)]


def test_a_member_is_retried_alone():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"first")
        z.writestr("b", b"second")
    broken = bytearray(buffer.getvalue())
    broken[broken.index(b"second")] ^= 1
    opened, failing = [], [True]

    def open_archive(fresh=False, data=bytes(broken)):
        opened.append(fresh)
        if failing and failing.pop():
            raise OSError("lost connection")
        return zipfile.ZipFile(io.BytesIO(data))

    infos = zipfile.ZipFile(io.BytesIO(bytes(broken))).infolist()
    assert media.read_member(open_archive, infos[0], wait_s=0) == (b"first", 2, None)
    data, attempts, error = media.read_member(open_archive, infos[1], wait_s=0)
    assert data is None and attempts == 3 and "CRC" in error and opened == [False, True, False, True, True]


# the pipeline


def pipeline_by_hand(rows, bad):
    """doc_id and length of every row that the last stage packs, by plain loops over all stages."""
    rows = [r for r in rows if not any(w in (r[1] or "").split() for w in bad)]
    # one of equal texts: most code points, then the smallest id
    groups = collections.defaultdict(list)
    for r in rows:
        groups["".join((r[1] or "").split())].append(r)
    best = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    rows = [min(g, key=best) for g in groups.values()]
    # one of each class of texts of weighted Jaccard similarity 0.8 or more
    grams = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        grams.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    df = collections.Counter(g for c in grams for g in c)
    idf = {g: np.log((len(rows) + 1) / (n + 1)) + 1 for g, n in df.items()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = grams[i], grams[j]
        low = sum(min(a[g], b[g]) * idf[g] for g in a.keys() & b.keys())
        high = sum(max(a[g], b[g]) * idf[g] for g in a.keys() | b.keys())
        if high and low / high >= 0.8:
            parent[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r)
    rows = [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]
    # sources share all words by weight, none more than three times its own
    sizes = collections.Counter()
    for _, t, source in rows:
        sizes[source] += len((t or "").split())
    weight = dict(zip(sorted(sizes, key=lambda x: (x is None, x or "")), itertools.cycle([5, 2, 1])))
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] >= 3 * sizes[x]}
        if not full:
            target |= share
            break
        for x in full:
            target[x] = 3 * sizes[x]
            left -= target[x]
        open_ -= full
    taken = []
    for source, size in sizes.items():
        goal, start = int(target[source] + 0.5), 0
        epochs, rest = divmod(goal, size) if size else (0, 0)
        own = [r for r in rows if r[2] == source]
        own.sort(key=lambda r: (hashlib.md5(str("null" if r[0] is None else r[0]).encode()).hexdigest(), r[0] or 0))
        for r in own:
            n = len((r[1] or "").split())
            taken += [(r[0], n)] * (epochs + (start < rest))
            start += n
    return sorted(taken, key=repr)


def least_padding(lengths, buckets):
    """By dynamic programming over all cuts."""
    values = sorted(collections.Counter(lengths).items())
    cost = lambda i, j: sum((values[j][0] - n) * c for n, c in values[i : j + 1])
    best = [0] + [float("inf")] * len(values)
    for _ in range(buckets):
        best = [0] + [min(best[i] + cost(i, j) for i in range(j + 1)) for j in range(len(values))]
    return best[-1]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    vocabulary, bad = [word() for _ in range(400)], ["zzblurt", "zzsnark", "zzgrump"]
    rows, labels = [], []
    for i in range(260):
        words, toxic = [rng.choice(vocabulary) for _ in range(rng.randint(5, 90))], rng.random() < 0.25
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), rng.choice(["web", "books", "code", None])))
        labels.append((i, 1, int(toxic)))
    for i in range(300, 330):  # exact and near copies
        i_, t, s = rng.choice(rows[:200])
        words = t.split()
        if i % 3 == 0 and len(words) > 60:
            words[len(words) // 2] = word()
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words), s))
    rows += [(400, None, "web"), (401, "", None), (402, " \t", "books"), (None, " ".join(rng.choice(vocabulary) for _ in range(30)), "code"), rows[3], rows[3], (403, "long " * 20_000, "web")]
    return rows, [*labels, (None, None, 1), (5000, 0, 1), (7, None, None)], bad


def write_corpus(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("xx")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_by_hand(spark, tmp_path, corpus):
    rows, labels, bad = corpus
    write_corpus(spark, tmp_path, rows, labels)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = pipeline_by_hand(rows, bad)
    assert sorted(((r["doc_id"], r["length"]) for r in got), key=repr) == want and 20 < len({i for i, _ in want}) < 250
    assert sum(r["padding"] for r in got) == least_padding([n for _, n in want], 16)
    places = collections.defaultdict(set)
    for r in got:
        assert r["bucket_length"] - r["length"] == r["padding"] >= 0
        places[r["bucket"], r["bucket_length"]].add((r["batch"], r["slot"]))
    sizes = collections.Counter(r["bucket"] for r in got)
    for (bucket, length), found in places.items():
        fit = max(1, 65_536 // length) if length else 65_536
        assert found == {divmod(k, fit) for k in range(sizes[bucket])}


def test_pipeline_stages_keep_columns_and_empty_tables(spark, tmp_path, corpus):
    rows, labels, _ = corpus
    write_corpus(spark, tmp_path, [], labels)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.createDataFrame(rows[-40:], "doc_id long, text string, source string").withColumn("raw", F.lit(1)).withColumn("rank", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.columns == ["doc_id", "text", "source", "raw", "rank"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_pipeline_leaves_clean_documents_alone(spark):
    larger = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    left = {r[0] for r in corpus_pipeline.STAGES[0][1](spark, docs, larger).select("doc_id").collect()}
    labels = dict(map(tuple, spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "toxic").collect()))
    clean, bad = ([i for i, y in labels.items() if y == k] for k in (0, 1))
    # some labels are noise: no word tells those texts from clean ones
    assert sum(i in left for i in clean) >= 0.95 * len(clean) and sum(i in left for i in bad) <= 0.25 * len(bad)
