import json

import pytest

from graphloom.__main__ import main
from graphloom.functions.terms import Prefixes
from graphloom.storage import GraphStore
from graphloom.sources.ntriples import load_text, read_ntriples, read_prefixes


def got(df):
    return sorted(map(tuple, df.collect()))


def test_ntriples(spark, tmp_path):
    f = tmp_path / "x.nt"
    f.write_text(
        '<http://a> <http://p> "v \\" \\t."@en .\n# note\n\n_:b <http://p> "5"^^<http://i> .  # end\n'
        "<http://a> <http://p> <http://c> .\n<http://a> <http://p> <http://c>.\nbroken line\n"
    )
    assert got(read_ntriples(spark, str(f), "skip")) == [
        ("<http://a>", "<http://p>", '"v \\" \\t."@en'), ("<http://a>", "<http://p>", "<http://c>"),
        ("<http://a>", "<http://p>", "<http://c>"), ("_:b", "<http://p>", '"5"^^<http://i>'),
    ]
    assert len(got(load_text(spark, str(f), malformed="skip"))) == 3
    with pytest.raises(Exception, match="malformed line: broken line"):
        got(read_ntriples(spark, str(f)))
    with pytest.raises(ValueError):
        read_ntriples(spark, str(f), "hide")


def test_ntriples_escapes_have_one_spelling(spark, tmp_path):
    f = tmp_path / "x.nt"
    pairs = [
        (r'"caf\u00E9"', '"café"'), (r'"\U0001F600\'\b\f"@EN-gb', '"\U0001F600\'\b\f"@en-gb'), (r'"a\u0022\u005C\u000A"', r'"a\"\\\n"'),
        (r'"\\u0041"', r'"\\u0041"'), ('"raw\ttab"', r'"raw\ttab"'), (r"<http://e/\u00e9>", "<http://e/é>"), (r'"1"^^<http://e/\u0041>', '"1"^^<http://e/A>'),
    ]
    f.write_text("".join(f"<http://s/{i}> <http://p> {written} .\n" for i, (written, _) in enumerate(pairs)))
    assert [r["o"] for r in read_ntriples(spark, str(f)).orderBy("s").collect()] == [meant for _, meant in pairs]


def test_delimited_dots_prefixes(spark, tmp_path):
    (tmp_path / "p").write_text("e: <http://e.x/>\nf: <http://e.x/f/>\nshort\n")
    prefixes = read_prefixes(spark, str(tmp_path / "p"))
    assert prefixes.by_prefix == {"e": "http://e.x/", "f": "http://e.x/f/"}
    f = tmp_path / "x.tsv"
    f.write_text("<http://e.x/1>\t<http://e.x/f/p>\t<http://exx/2> .\n<http://e.x/1>\t<http://e.x/f/p>\t\"a.\"\n")
    assert got(load_text(spark, str(f), prefixes, delimited=True, dot=True)) == [("e:1", "f:p", '"a."'), ("e:1", "f:p", "<http://exx/2>")]
    g = tmp_path / "y.txt"
    g.write_text("o|s|p;o2|s|p")
    assert got(load_text(spark, str(g), None, delimited=True, field="|", line=";", columns=("o", "s", "p"))) == [("s", "p", "o"), ("s", "p", "o2")]


def test_compaction_takes_namespaces_as_text(spark):
    df = spark.createDataFrame([("<http://e.x/1>",), ("<http://eax/1>",), ('"<http://e.x/1>"',)], "c string")
    p = Prefixes({"e": "http://e.x/"})
    assert [r[0] for r in df.select(p.compact_column(df.c)).collect()] == ["e:1", "<http://eax/1>", '"<http://e.x/1>"']
    assert [r[0] for r in df.select(p.expand_column(p.compact_column(df.c))).collect()][:2] == ["http://e.x/1", "http://eax/1"]


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "x.nt"
    f.write_text("<http://e/1> <http://e/p> <http://e/2> .\n<http://e/2> <http://e/q> \"x\" .\n")
    (tmp_path / "prefixes").write_text("e: <http://e/>\n")
    queries = tmp_path / "q"
    queries.mkdir()
    (queries / "a.sparql").write_text("PREFIX e: <http://e/> SELECT ?x ?v { ?x e:p ?y . ?y e:q ?v }")
    (queries / "b.rq").write_text("not read")
    for layout in ("tt", "pt", "cpt", "st", "xvp"):
        db = str(tmp_path / layout)
        assert main(["load", "-d", db, "-i", str(f), "-n", "-f", layout, "-P", str(tmp_path / "prefixes")]) == 0
        capsys.readouterr()
        assert main(["query", "-d", db, "-i", str(queries), "-f", layout, "-c", "-r", str(tmp_path / "report")]) == 0
        assert json.loads(capsys.readouterr().out)["rows"] == 1
    assert len((tmp_path / "report").read_text().splitlines()) == 5
    main(["query", "-d", str(tmp_path / "tt"), "-i", str(queries), "-f", "tt", "-x"])
    assert "== Algebra ==" in (queries / "a.log").read_text()
    main(["query", "-d", str(tmp_path / "tt"), "-i", str(queries), "-f", "tt", "-o", str(tmp_path / "out"), "-rn", "r_"])
    assert spark.read.parquet(str(tmp_path / "out" / "r_a")).count() == 1


def test_command_line_options(spark, tmp_path, capsys):
    rows = [("<http://e/1>", "<http://e/p>", "<http://e/2>"), ("<http://e/1>", "<http://e/p>", "<http://e/2>"), ("<http://e/2>", "<http://e/q>", '"x"')]
    spark.createDataFrame(rows, "sub string, pre string, ob string").write.parquet(str(tmp_path / "in"))
    (tmp_path / "prefixes").write_text("e: <http://e/>\n")
    (tmp_path / "a.sparql").write_text("PREFIX e: <http://e/> SELECT ?x ?y { ?x e:p ?y }")
    load = ["load", "-i", str(tmp_path / "in"), "--parquet", "-cs", "sub", "-cp", "pre", "-co", "ob", "-P", str(tmp_path / "prefixes"), "-S"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert main([*load, "-d", str(tmp_path / "u"), "-f", "st", "-u", "-k", "--codec", "zstd"]) == 0
    assert json.loads(capsys.readouterr().out)["triples"] == 2
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    store = GraphStore(spark, str(tmp_path / "u"))
    assert store.has("term_masks") and any(".zstd" in n for n in store.folder.names("term_masks"))
    assert main([*load, "-d", str(tmp_path / "all"), "-f", "tt"]) == 0  # as in the input: no -u
    assert json.loads(capsys.readouterr().out)["triples"] == 3
    out = str(tmp_path / "out")
    main(["query", "-d", str(tmp_path / "u"), "-i", str(tmp_path / "a.sparql"), "-f", "st", "-o", out, "-e", "-S", "--set", "spark.sql.shuffle.partitions=2"])
    assert got(spark.read.parquet(f"{out}/a")) == [("<http://e/1>", "<http://e/2>")]


def test_statistics_for_the_optimizer(spark, tmp_path):
    triples = spark.createDataFrame([("e:1", "e:p", "e:2"), ("e:2", "e:q", "x"), ("e:3", "e:q", "x")], "s string, p string, o string")
    store = GraphStore.create(triples, str(tmp_path / "g"))
    try:
        assert "3 rows" in store.compute_stats("graphloom_test").first()["data_type"]
        assert spark.table("graphloom_test.triples").where("p = 'e:q'").count() == 2
    finally:
        spark.sql("DROP DATABASE IF EXISTS graphloom_test CASCADE")
