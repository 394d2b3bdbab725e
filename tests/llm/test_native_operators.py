"""Exact dedup, URL filter, packing and mixing: edge cases, SQL and brute force."""

import itertools
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, line_dedup, mixing, packing, queries, url_filter, warc

SF = "/root/testdata/sf0.001"
EDGE = [(1, "a b", "x"), (2, "ab", None), (3, None, "y"), (None, "", "x"), (5, "ba c", "x"), (5, "ba c", "x"), (7, "a  b", "y"), (8, "z" * 200_000, "y"), (9, " \t\n", None)]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named like inner ones."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("rank", "digest", "content", "size", "key", "salt", "kept", "length"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def squeezed(text):
    return re.sub("[ \t-\r]", "", text or "")


def test_exact_dedup_edges(docs):
    best = {}
    for i, t, _ in EDGE:
        k, score = squeezed(t), (len(t or ""), float("-inf") if i is None else -i)
        best[k] = max(best.get(k, (-1, 0)), score)
    want = []
    for i, t, _ in EDGE:
        k = squeezed(t)
        keep = -best[k][1]
        want.append((i, keep, sum(squeezed(x) == k for _, x, _ in EDGE), i == keep))
    assert rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)


def test_exact_dedup_compares_contents_where_digests_clash(docs):
    weak = exact_dedup.exact_dedup(docs, digest=lambda c: F.lit("same"))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(weak, *names) == rows(exact_dedup.exact_dedup(docs), *names)


def test_exact_dedup_with_a_hot_group(spark):
    data = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)]
    df = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(7), salts=4)
    assert df.where("text_sha256 = sha2('sametext', 256)").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.max("group_size")).first() == (400, 1, 1, 400)
    assert df.where("kept").count() == 201


def test_drop_exact_copies_keeps_one_row_and_all_columns(docs):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    # "a  b" has most code points of its content, " \\t\\n" of the empty one
    assert rows(left, "doc_id") == [(5,), (7,), (8,), (9,)]


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, exact_dedup.drop_exact_copies, mixing.mix, mixing.take_mix, packing.pack, line_dedup.dedup_lines])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_url_parts_and_rules(spark):
    urls = [None, "x", "", "HTTP://A.Org", "http://a.org?x", "http://a.b.EXAMPLE.org/en/1?q://x", "http://xorg/", "http://org/",
            "://m.free-bets.example.com#a/", "http://a.com/fr/\nx", "http://a.com/fr", "http://É.Org/", "http://example.org/es/a#b", "http://" + "a." * 3000 + "com/de/"]
    df = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = {r["page_id"]: r for r in df.collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.org/en/1", "block"), (None, "allow"), ("org/", "allow"),
        (None, "block"), ("com/fr/", "allow"), (None, "allow"), ("org/", "allow"), ("example.org/es/", "block"), ("com/de/", "block"),
    ]
    assert (got[11]["host"], got[5]["host"], got[5]["path"], got[8]["path"]) == ("É.org", "a.b.example.org", "/en/1", "")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("cast(key as int) % 5 = 0").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    cascade = url_filter.BloomCascade.build(listed, universe, bits=4, hashes=2)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != (F.col("key").cast("int") % 5 == 0))
    assert wrong.count() == 0


def test_joined_filter_agrees_with_the_cascade(spark):
    pages = spark.createDataFrame([(1, "http://a.free-bets.example.com/x"), (2, "http://b.org/"), (3, None), (4, "http://c.com/de/"), (4, "http://c.com/de/")], "page_id long, url string")
    joined = url_filter.filter_urls_joined(pages, url_filter.rule_table(spark, url_filter.RULES), url_filter.domain_table(spark, url_filter.BLOCKED))
    names = ("page_id", "host", "path", "rule", "verdict", "listed_domain")
    assert rows(joined, *names) == rows(url_filter.filter_urls(pages), *names)


def judged_by_hand(url, rules, domains):
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    suffixes = [host.split(".", i)[-1] for i in range(host.count(".") + 1)]
    fit = [(len(h) + n, rules[h, path[:n]] == "block", h + path[:n]) for h in suffixes for n in range(len(path) + 1) if (h, path[:n]) in rules]
    listed = min((h for h in suffixes if h in domains), default=None)
    verdict = ("block" if max(fit)[1] else "allow") if fit else "block" if listed else "allow"
    return max(fit)[2] if fit else None, verdict, listed


@pytest.mark.parametrize("lengths", [8, 200])
def test_long_lists_as_tables(spark, lengths):
    """100,000 listed domains and 3,000 rules; with paths of many lengths the joined form answers."""
    rng = random.Random(lengths)
    domains = {f"d{i}.example{i % 7}.org" for i in range(100_000)}
    rules = {(f"s{rng.randint(0, 300)}.net", "/" + "p" * rng.randint(0, lengths)): rng.choice(["allow", "block"]) for _ in range(3000)}
    urls = [f"http://x.d{rng.randint(0, 150_000)}.example{rng.randint(0, 6)}.org/q" for _ in range(1500)]
    urls += [f"http://s{rng.randint(0, 300)}.net/{'p' * rng.randint(0, lengths + 20)}?z" for _ in range(1500)] + ["http://S1.NET/", "no url", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("best", F.lit(1)).withColumn("row", F.lit(2))
    rule_rows = spark.createDataFrame([(h + p, v) for (h, p), v in rules.items()] + [(None, "allow")], "rule string, verdict string")
    domain_rows = spark.createDataFrame([(d.upper(),) for d in domains], "domain string").unionByName(spark.createDataFrame([(None,)], "domain string"))
    out = url_filter.filter_urls(pages, rule_rows, domain_rows)
    want = [(i, *judged_by_hand(u.lower() if "S1" in u else u, rules, domains)) for i, u in enumerate(urls)]
    assert rows(out, "page_id", "rule", "verdict", "listed_domain") == sorted(want, key=repr)


def test_lists_may_be_empty_and_pages_too(spark):
    pages = spark.createDataFrame([(1, "http://b.org/")], "page_id long, url string")
    assert rows(url_filter.filter_urls(pages, (), ()), "page_id", "rule", "verdict", "listed_domain") == [(1, None, "allow", None)]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(3)
    data = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(1000, "w " * 30, "d"), (1001, None, "e")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(docs).collect()
    assert got and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    by = {}
    source = {i: s for i, _, s in data}
    for r in got:
        by.setdefault(source[r["doc_id"]], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - total) < 1e-6
    for rs in by.values():
        assert sum(r["taken"] for r in rs) == round(rs[0]["target"])
        assert rs[0]["target"] <= 3 * rs[0]["source_size"]
    assert by["d"][0]["target"] == 90 and by["e"][0]["target"] == 0


def test_take_mix_repeats_whole_rows(docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = -(-r["taken"] // r["size"]) if r["size"] else None
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, n in taken.items():
        if n is not None:
            assert copies.get(i, 0) == n * sum(x[0] == i for x in EDGE)


def test_optimal_boundaries_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        h = list({rng.randint(0, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}.items())
        k, lengths = rng.randint(1, 4), sorted(n for n, _ in h)
        best = min(packing.padding(h, sorted({*c, lengths[-1]})) for c in itertools.combinations_with_replacement(lengths, k - 1))
        bounds = packing.optimal_boundaries(h, k)
        assert len(bounds) <= k and packing.padding(h, bounds) == best


def test_pack_batches_fit_and_lose_nothing(docs, spark):
    many = docs.select("doc_id", "text").unionByName(spark.range(500).selectExpr("id + 100 AS doc_id", "repeat('w ', cast(id % 37 as int)) AS text"))
    got = packing.pack(many, buckets=4, budget=64).collect()
    assert len(got) == many.count()
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == len(got)
    sizes = {}
    for r in got:
        assert r["length"] <= r["bucket_length"] and r["padding"] == r["bucket_length"] - r["length"]
        sizes.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_length"])
    assert all(sum(s) <= 64 or len(s) == 1 for s in sizes.values())


def test_length_bins_round_up_by_little(spark):
    df = spark.createDataFrame([(n,) for n in (0, 5, 65_535, 65_536, 65_537, 1_000_001, 10**9 + 7)], "n long")
    for n, b in df.select("n", packing.length_bin(F.col("n"))).collect():
        assert n <= b <= n * (1 + 1 / packing.FINE) and (b == n or n > packing.EXACT)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_duckdb(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    at = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    assert rows(df, *names) == want


def test_warc_edges(spark):
    data = [(1, "u", "a b"), (2, "http://x/\n", None), (3, None, ""), (None, "", "zz"), (5, "ba", "a b"), (5, "ba", "a b"), (7, "ü", "z\r\n\r\nWARC/1.1" * 30_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    index, folder = warc.archive_pages(pages)
    got = rows(warc.read_records(index, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    firsts = {"a b": 1, "": 2}
    want = []
    for i, _, html in data:
        b = (html or "").encode()
        first = firsts.get(html or "", i)
        want.append((i, len(b), warc.sha1_base32(b), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=repr)
    index, folder = warc.archive_pages(pages.limit(0))
    assert warc.read_records(index, folder).count() == 0


def test_record_stream_reads_members_and_one_stream(tmp_path):
    import gzip
    import io

    records = [b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n" for n in (0, 1, 700_000)]
    for raw in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        stream, sizes = warc.RecordStream(io.BytesIO(raw)), []
        while (h := stream.next_header()) is not None:
            sizes.append(sum(map(len, stream.body(int(warc.fields(h)["content-length"])))))
        assert sizes == [0, 1, 700_000]
    with pytest.raises(EOFError):
        stream = warc.RecordStream(io.BytesIO(gzip.compress(records[2][:-10])))
        list(stream.body(int(warc.fields(stream.next_header())["content-length"])))
