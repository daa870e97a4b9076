from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skylode.functions import analysis
from skylode.functions import vectors as sv
from skylode.operators import columns, lifecycle, sparse
from skylode.schema import Mapping, field_infos, role
from skylode.sources import readers
from skylode.streaming import ingest


def tokens(spark, name, text):
    f = analysis.ANALYZERS[name] if isinstance(name, str) else name
    rows = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    return [(t["text"], t["position"], t["start"], t["end"]) for t in rows]


def test_tokenizers(spark):
    assert tokens(spark, "whitespace", "  Hé  wörld\n") == [("Hé", 0, 2, 5), ("wörld", 1, 7, 13)]
    assert tokens(spark, "keyword", "One Two") == [("One Two", 0, 0, 7)] and tokens(spark, "keyword", "") == []
    assert [t[0] for t in tokens(spark, "simple", "One TWO")] == ["one", "two"]
    assert tokens(spark, "standard", "The 3.14 - it's a_b fox.") == [("3.14", 1, 4, 8), ("it's", 2, 11, 15), ("a_b", 3, 16, 19), ("fox", 4, 20, 23)]
    assert [t[0] for t in tokens(spark, "english", "Les Élèves CAFÉ and Straße")] == ["les", "eleves", "cafe", "strasse"]
    assert [t[0] for t in tokens(spark, "multilingual", "The café")] == ["the", "cafe"]
    assert tokens(spark, "whitespace", None) == []


def test_jieba_without_its_module(spark):
    with pytest.raises(ValueError, match="mode"):
        analysis.jieba(F.lit("x"), mode="other")
    with pytest.raises(NotImplementedError):
        analysis.jieba(F.lit("x"), mode="search")


def test_fast(spark):
    assert spark.range(1).select(analysis.fast(F.lit(" a  b\tc "))).first()[0] == ["a", "b", "c"]


def test_index_terms(spark):
    row = spark.createDataFrame([("It's 3.14", "It's 3.14 é")], "a string, b string").select(analysis.index_terms(F.col("a")), analysis.index_terms_strict(F.col("a")), analysis.index_terms_strict(F.col("b"))).first()
    assert row[0] == ["it's", "3", "14"] and row[1] == row[0] and row[2] == ["it's", "3.14", "é"]


def test_filters(spark):
    table = analysis.read_synonyms(["# no", "", "big => large, very large", "car, auto", "nothing"])
    assert table == {"big": ["large", "very large"], "car": ["auto"]}
    expand = lambda c: analysis.synonyms(analysis.whitespace(c), table)
    assert [(t[0], t[1]) for t in tokens(spark, expand, "a Big car")] == [("a", 0), ("large", 1), ("very", 1), ("large", 2), ("auto", 2)]
    first = lambda c: analysis.synonyms(analysis.whitespace(c), table, expand=False)
    assert [t[0] for t in tokens(spark, first, "big car")] == ["large", "auto"]
    both = lambda c: analysis.ascii_fold(analysis.whitespace(c), preserve_original=True)
    assert [t[0] for t in tokens(spark, both, "né no")] == ["ne", "né", "no"]
    cased = lambda c: analysis.stop(analysis.whitespace(c), ("The",), case_sensitive=True)
    assert [t[0] for t in tokens(spark, cased, "The the")] == ["the"]


def test_json():
    rows = lambda s: [(r["field"], r["role"], r["value"]) for r in readers.flatten_json(s)]
    assert rows('{"title":"hello world","count":42,"price":9.99,"active":true}') == [("title", "text", "hello world"), ("count", "long", "42"), ("price", "double", "9.99"), ("active", "keyword", "true")]
    assert rows('{"user":{"name":"alice","address":{"city":"NYC"}}}') == [("user.name", "text", "alice"), ("user.address.city", "text", "NYC")]
    assert [r[2] for r in rows('{"tags":["search","engine","fast"]}')] == ["search", "engine", "fast"]
    assert [r[1] for r in rows('{"data":["text",42,true]}')] == ["text", "long", "keyword"]
    assert rows('{"a":null}') == [] and rows("{}") == []
    for bad in ("[1]", "nope", '{"a":' * 70 + "1" + "}" * 70):
        with pytest.raises(ValueError):
            readers.flatten_json(bad)


def test_json_columns(spark):
    df = spark.createDataFrame([("k1", '{"a":1,"b":{"c":"x"}}')], "id string, j string")
    assert readers.parse_json(df, "j", "a long, b struct<c:string>", id_column="id").first().asDict() == {"id": "k1", "a": 1, "b.c": "x", "_id": "k1"}
    many = spark.createDataFrame([('[{"a":1},{"a":2},{"a":3}]',)], "j string")
    assert [r["a"] for r in readers.parse_json_array(many, "j", "a:bigint").collect()] == [1, 2, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.tsv").write_text("\t".join(map(str, range(62))) + "\nshort\trow\n")
    assert readers.read_log(spark, str(tmp_path / "log"), {"a": (0, "long"), "z": (61, "string")}).collect() == [(0, "61")]
    (tmp_path / "news.sgm").write_text('<REUTERS NEWID="7"><TITLE>T</TITLE><BODY>Some text</BODY></REUTERS><REUTERS NEWID="8"><TITLE>U</TITLE><BODY>More</BODY></REUTERS>')
    assert [tuple(r) for r in readers.read_news(spark, str(tmp_path / "news.sgm")).orderBy("doc_id").collect()] == [(7, "T", "Some text"), (8, "U", "More")]
    for codec in ("none", "lz4", "zstd", 0x90):
        readers.write(spark.range(3), str(tmp_path / f"p{codec}"), codec)
        assert spark.read.parquet(str(tmp_path / f"p{codec}")).count() == 3
    with pytest.raises(ValueError):
        readers.write(spark.range(1), str(tmp_path / "q"), "rar")


def test_sparse_functions(spark):
    df = spark.createDataFrame([([(3, 4.0), (1, 3.0), (5, 0.0)], [(1, 2.0)])], "a array<struct<i:int,w:double>>, b array<struct<i:int,w:double>>")
    a, b = sv.sparse(F.col("a")), sv.sparse(F.col("b"))
    r = df.select(sv.norm(a).alias("n"), sv.dot(a, b).alias("d"), sv.cosine(a, b).alias("c"), sv.to_dense(a, 5).alias("t"), F.size(a).alias("s"), sv.l1(sv.normalize(a)).alias("u"), sv.cosine(a, sv.sparse(F.expr("filter(b, x -> false)"))).alias("z")).first()
    assert (r["n"], r["d"], r["s"], r["t"], r["z"]) == (5.0, 6.0, 2, [0.0, 3.0, 0.0, 4.0, 0.0], 0.0)
    assert r["c"] == pytest.approx(0.6) and r["u"] == pytest.approx(1.4)
    masses = spark.createDataFrame([([(0, 4.0), (1, -4.0), (2, 1.0), (3, 1.0)],)], "v array<struct<i:int,w:double>>")
    assert [e["i"] for e in masses.select(sv.prune_mass(F.col("v"), 0.3).alias("x")).first()["x"]] == [0, 1]


def test_sparse_search(spark):
    df = spark.createDataFrame([(0, [(0, 1.0), (1, 2.0)]), (1, [(0, 3.0), (1, 4.0)]), (2, [(0, -1.0)])], "doc_id long, v array<struct<i:int,w:double>>")
    assert [tuple(r) for r in sparse.search(df, {0: 1.0}, 5).collect()] == [(1, 3.0), (0, 1.0)]
    assert sparse.search(df, {}, 5).count() == 0 and sparse.search(df, {0: 1.0}, 0).count() == 0
    assert [r[0] for r in sparse.reranked(df, {0: 1.0, 1: 1.0}, 2, first=2).collect()] == [1, 0]
    assert [r[0] for r in sparse.block_max(df, {0: 1.0, 1: 1.0}, 2, alpha=1.0).collect()] == [1, 0]
    assert sparse.block_max(df, {0: 0.1}, 2).count() == 0  # gains below 1 are 0
    assert [r[0] for r in sparse.quantised_levels(df, {0: 1.0, 1: 1.0}, 2, n=2, alpha=1.0).collect()] == [1, 0]
    assert sparse.forward(df, 1).first()["v"][1]["w"] == 4.0
    with pytest.raises(IndexError):
        sparse.forward(df, 77)
    for mode in ("alpha_mass", "max_ratio", "top_k"):
        assert sparse.quantised(df, {0: 1.0, 1: 1.0}, 2, n=2, mode=mode).count() > 0


def test_columns(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    g = columns.min_max(columns.with_granule(df, "id", 8), "v").orderBy("granule").collect()
    assert len(g) == 13 and (g[1]["low"], g[1]["high"], g[12]["rows"]) == (16, 30, 4)
    assert [r["granule"] for r in columns.may_hold(columns.min_max(columns.with_granule(df, "id", 8), "v"), 10, 20).orderBy("granule").collect()] == [0, 1]
    assert columns.range_count(df, "v", 10, 20, include_upper=False).first()["n"] == 5
    bits = columns.bloom(df, "v", 2048, 3)
    assert df.crossJoin(bits).where(~columns.bloom_may_hold(F.col("bits"), F.col("v"), 2048, 3)).count() == 0
    x = spark.createDataFrame([(1.0, float("nan")), (float("nan"), float("nan")), (2.0, 1.0)], "a double, b double").select(columns.compared(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in x] == [-1, 0, 1]


def test_bits(spark):
    from skylode.functions import bits

    rows = [([0, 63, 64, 200], [64, 5]), ([], [1]), ([None, 7], [7])]
    df = spark.createDataFrame(rows, "p array<int>, q array<int>").select(bits.of(F.col("p")).alias("a"), bits.of(F.col("q")).alias("b"))
    a, b, at = F.col("a"), F.col("b"), F.lit(70)
    got = df.select(
        bits.positions(a), bits.positions(bits.union(a, b)), bits.positions(bits.intersection(a, b)), bits.positions(bits.difference(a, b)), bits.positions(bits.symmetric_difference(a, b)),
        bits.cardinality(a), bits.intersects(a, b), bits.positions(bits.put(a, at)), bits.positions(bits.clear(bits.put(a, at), at)), bits.positions(bits.flip(a, F.lit(7))), bits.next_set(a, F.lit(64)), bits.previous_set(a, F.lit(62)), bits.get(a, F.lit(500)),
    ).collect()
    for (p, q), r in zip(rows, got, strict=True):
        x, y = {i for i in p if i is not None}, set(q)
        assert list(map(list, r[:5])) == [sorted(z) for z in (x, x | y, x & y, x - y, x ^ y)]
        assert (r[5], r[6]) == (len(x), bool(x & y)) and list(map(list, r[7:10])) == [sorted(z) for z in (x | {70}, x, x ^ {7})]
        assert r[10:] == (min((i for i in x if i >= 64), default=None), max((i for i in x if i <= 62), default=None), False)


def test_marks_and_changes(spark):
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    marks = columns.adaptive_marks(df, "id", F.lit(3), 12)
    rows = [tuple(r) for r in columns.mark_starts(marks).select("mark", "start", "end").orderBy("mark").collect()]
    assert rows == [(m, 4 * m, 4 * m + 4) for m in range(5)]
    wanted = spark.createDataFrame([(0,), (1,), (3,), (3,)], "mark long")
    assert sorted(tuple(r) for r in columns.mark_ranges(wanted).collect()) == [(0, 2), (3, 4)]
    r = spark.range(1).select(columns.mark_of_row(F.lit(17), 8), columns.rows_of_marks(F.lit(1), F.lit(3), F.lit(20), 8)).first()
    assert tuple(r) == (2, 12)
    assert columns.pop_back(df, "id", 3).count() == 17 and columns.resize(df, "id", 5).count() == 5
    grown = columns.resize(df, "id", 23).orderBy("id").collect()
    assert len(grown) == 23 and grown[-1]["id"] == 22 and grown[-1]["v"] is None
    assert columns.insert_range(df, df.select((F.col("id") + 100).alias("id"), "v"), "id", 2, 3).where("id >= 100").count() == 3
    sets = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c", None])], "k long, v array<string>")
    ords, known = columns.set_ordinals(sets, "k", "v")
    assert {r["k"]: r["ords"] for r in ords.collect()} == {1: [0, 1], 2: [], 3: [2]}
    assert columns.lookup_ord(known, 2).first()[0] == "c" and columns.lookup_ord(known, 9).count() == 0


def test_metrics():
    from skylode.operators import metrics

    m = metrics.Metrics()
    for x in (1, 2, 3, 400):
        m.record("ms", x)
    m.count("rows", 5)
    m.count("rows")
    m.gauge("open", 2.5)
    with pytest.raises(ZeroDivisionError), m.timed("work"):
        1 // 0
    got = m.snapshot()
    assert got["counters"] == {"rows": 6} and got["gauges"] == {"open": 2.5} and got["histograms"]["work"]["count"] == 1
    assert got["histograms"]["ms"] == {"count": 4, "mean": 101.5, "p50": 2.0, "p99": 400}
    with pytest.raises(ValueError):
        m.count("rows", -1)
    assert metrics.health({"a": lambda: True, "b": lambda: 1 // 0, "c": lambda: False}) == {"a": "healthy", "b": "failed: integer division or modulo by zero", "c": "unhealthy", "all": "unhealthy"}
    assert metrics.health({})["all"] == "healthy"


def test_set_and_ngram_granules(spark):
    df = spark.createDataFrame([(0, "abcdef", 1), (0, None, 2), (1, "xyzabc", 3), (2, "ab", 4), (2, "", 5)], "granule long, t string, v int")
    assert sorted(r[0] for r in columns.ngram_granules(df, "t", "abc").collect()) == [0, 1] and columns.ngram_granules(df, "t", "zz").count() == 3
    assert columns.ngram_granules(df, "t", "cde").collect()[0][0] == 0
    index = columns.set_index(df, "v", 1)
    assert sorted(r[0] for r in columns.set_granules(index, [3]).collect()) == [0, 1, 2] and sorted(r[0] for r in columns.set_granules(columns.set_index(df, "v"), [3, 9]).collect()) == [1]


def test_lifecycle(spark):
    s = spark.createDataFrame([("a", "HOT", 8 * 86400, 1, 0), ("b", "HOT", 0, 1, 0), ("c", "WARM", 0, 1, 5), ("d", "COLD", 400 * 86400, 1, 0), ("e", "FROZEN", 10**9, 1, 0)], "segment string, tier string, age long, bytes long, accesses int")
    assert {r["segment"]: r["target"] for r in lifecycle.migrations(s).collect()} == {"a": "WARM", "c": "COLD", "d": "FROZEN"}
    m = lifecycle.SizeClasses()
    assert m.plan({f"s{i}": 2**20 for i in range(5)}) == [] and m.plan({}) == []
    groups = m.plan({f"s{i:02d}": 4 * 2**20 for i in range(30)})
    assert [len(g) for g in groups] == [10, 10] and groups[0] == [f"s{i:02d}" for i in range(10)]
    assert m.plan({f"s{i:02d}": 6 * 2**30 for i in range(30)}) == []
    big = m.plan({f"s{i:02d}": 2 * 2**30 for i in range(12)})
    assert big == [["s00", "s01"]]  # three would be above the largest size


def test_service():
    done = []
    service = lifecycle.Service(lambda: done.append(1), 0.01).start()
    while len(done) < 3:
        pass
    assert service.stop() >= 3
    broken = lifecycle.Service(lambda: 1 // 0, 0.01).start()
    with pytest.raises(ZeroDivisionError):
        broken.stop()


def test_schema(spark):
    df = spark.createDataFrame([(1, "x", [1.5], True)], "a long, b string, c array<double>, d boolean")
    assert [role(df, c) for c in df.columns] == ["long", "text", "stored", "keyword"]
    mapped = Mapping().add("b", "keyword").apply(df)
    assert role(mapped, "b") == "keyword" and field_infos(mapped)[1] == {"name": "b", "type": "string", "role": "keyword"}
    with pytest.raises(ValueError, match="already"):
        Mapping().add("b", "text").add("b", "text")


def test_streaming(spark, tmp_path):
    from skylode.operators.index import Index
    from skylode.plans.query import Term

    spark.createDataFrame([(1, "stream of words"), (2, "more words")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    ix = Index(spark, str(tmp_path / "ix"))
    ingest.into_index(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), ix, str(tmp_path / "cp")).awaitTermination()
    assert ix.open().count(Term("text", "words")) == 2
    again = spark.createDataFrame([(1, "stream of words")], "doc_id long, text string")
    ix.add(spark.createDataFrame([(9, "pending words")], "doc_id long, text string"))
    ix.writer().add(again, source=str(tmp_path / "cp"), batch=0).commit()  # a batch that is tried again
    assert ix.open().num_docs() == 2
    ix.commit()
    assert ix.open().count(Term("text", "words")) == 3
