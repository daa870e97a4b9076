from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skylode.functions import scoring
from skylode.operators import search
from skylode.operators.index import Index
from skylode.plans.compile import Modes
from skylode.plans.query import Bool, Boost, Fuzzy, MatchAll, Phrase, Range, Term, Wildcard


def corpus(spark, texts, **modes):
    return search.Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), modes=Modes(**modes))


def ids(df, key="doc_id"):
    return sorted(r[key] for r in df.collect())


def t(word):
    return Term("text", word)


@pytest.mark.parametrize(
    ("texts", "query", "expected"),
    [
        (["apple", "banana", "apple", "cherry"], t("apple"), [0, 2]),
        (["apple", "banana", "apple banana", "apple cherry", "banana cherry"], Bool(must=(t("apple"), t("banana"))), [2]),
        (["apple", "banana", "cherry"], Bool(must=(t("apple"), t("banana"))), []),
        (["apple", "banana", "apple banana", "cherry"], Bool(should=(t("apple"), t("banana"))), [0, 1, 2]),
        (["apple", "apple banana", "apple cherry", "banana"], Bool(must=(t("apple"),), must_not=(t("banana"),)), [0, 2]),
        (["a b", "a", "b"], Bool(must_not=(t("a"),)), []),
        (["a b", "a", "b"], Bool(should=(t("a"), t("b")), min_should=2), [0]),
        (["a b", "a", "b"], Bool(should=(t("a"), t("b")), min_should=3), []),
        (["a b", "a", None], MatchAll(), [0, 1, 2]),
        (["the quick brown fox jumps over the lazy dog", "a brown dog chased the fox", "quick and brown are colors"], Phrase("text", ("quick", "brown", "fox")), [0]),
        (["the quick brown fox jumps over the lazy dog"], Phrase("text", ("fox", "brown", "quick")), []),
        (["oil price went up today", "the price of oil is high", "oil and gas price report"], Phrase("text", ("oil", "price")), [0]),
        (["the quick fox", "the brown dog"], Phrase("text", ("quick", "brown")), []),
        (["oil price report", "oil price analysis", "gas price report", "oil price forecast"], Phrase("text", ("oil", "price")), [0, 1, 3]),
        (["a x b", "a b", "a x x b"], Phrase("text", ("a", "b"), (0, 2)), [0]),
    ],
)
def test_matches(spark, texts, query, expected):
    c = corpus(spark, texts)
    assert ids(c.match(query)) == expected
    assert ids(c.hits(query)) == expected
    assert c.count(query).first()["hits"] == len(expected)


def test_must_should_modes(spark):
    texts, q = ["a b", "a", "b", "c"], Bool(must=(t("a"),), should=(t("b"),))
    assert ids(corpus(spark, texts).match(q)) == [0, 1]
    assert ids(corpus(spark, texts, must_should="reference").match(q)) == [0, 1, 2]
    scores = {r["doc_id"]: r["score"] for r in corpus(spark, texts).hits(q).collect()}
    assert scores[0] > scores[1]


def test_filter_modes(spark):
    df = spark.createDataFrame([(0, "a", 5), (1, "a", 50)], "doc_id long, text string, v long")
    q = Bool(must=(t("a"),), filter=(Range("v", 0, 10),))
    plain = search.Corpus(df).hits(q).first()["score"]
    counted = search.Corpus(df, modes=Modes(filter_scores=True)).hits(q).first()["score"]
    assert counted == pytest.approx(plain + 1.0)


def test_ranges(spark):
    df = spark.createDataFrame([(i, (i + 1) * 10, float("nan") if i == 5 else (i + 1) * 1.0) for i in range(6)] + [(9, None, None)], "doc_id long, value long, d double")
    c = search.Corpus(df, text=())
    assert ids(c.match(Range("value", 20, 40))) == [1, 2, 3]
    assert ids(c.match(Range("value", 20, 40, False, False))) == [2]
    assert ids(c.match(Range.at_least("d", 2.0))) == [1, 2, 3, 4]
    assert ids(c.match(Range.at_most("value", 20, include=False))) == [0]
    with pytest.raises(ValueError, match="above"):
        Range("value", 5, 4)


def test_term_and_point_range(spark):
    df = spark.createDataFrame([(i, "A" if i % 2 == 0 else "B", i * 10) for i in range(100)], "doc_id long, category string, price long")
    c = search.Corpus(df, text=())
    a, r = Term("category", "A"), Range("price", 200, 500)
    assert c.count(a).first()[0] == 50
    assert c.count(r).first()[0] == 31
    assert c.count(Bool(must=(a, r))).first()[0] == 16
    assert c.count(Bool(must=(a,), filter=(r,))).first()[0] == 16


def test_wildcard_fuzzy_and_cache(spark, tmp_path):
    texts = ["licence to be", "license", "licensed lice", "a.c", None, "public"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c, ix = search.Corpus(df), Index(spark, str(tmp_path / "ix"))
    ix.add(df).commit()
    for q, expected in ((Wildcard("text", "licen?e"), [0, 1]), (Wildcard("text", "lic*"), [0, 1, 2]), (Wildcard("text", "*"), [0, 1, 2, 3, 5]), (Fuzzy("text", "licence", 1), [0, 1]), (Fuzzy("text", "pblic"), [5]), (Fuzzy("text", "public", 0), [5])):
        assert ids(c.match(q)) == expected == ids(c.hits(q)) == ids(ix.open().match(q)), str(q)
        assert ids(c.match(Bool(must=(MatchAll(),), must_not=(q,)))) == [i for i in range(6) if i not in expected]
    assert {r["score"] for r in c.hits(Bool(must=(Wildcard("text", "lic*"),), should=(MatchAll(),))).collect()} == {2.0}
    cache = search.FilterCache(c, most=1)
    assert [ids(cache.match(q)) for q in (t("license"), t("license"), t("public"), t("license"))] == [[1], [1], [5], [1]] and (cache.hits, cache.misses) == (1, 3)


def test_bm25_by_hand(spark):
    c = corpus(spark, ["a a b", "a", "c c c c"])
    got = {r["doc_id"]: r["score"] for r in c.hits(t("a")).collect()}
    idf, average = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5)), 8 / 3
    for doc, f, n in ((0, 2, 3), (1, 1, 1)):
        norm = int(min(127, 127 / math.sqrt(n)))
        length = 1.0 if norm in (0, 127) else (127 / norm) ** 2
        assert got[doc] == pytest.approx(idf * f / (f + 1.2 * (0.25 + 0.75 * length / average)))


def test_norm_cliff(spark):
    rows = spark.createDataFrame([(1,), (50,), (16129,), (16130,)], "n long").select("n", scoring.decoded(scoring.norm(F.col("n"))).alias("d")).collect()
    d = {r["n"]: r["d"] for r in rows}
    assert d[1] == 1 and d[50] == pytest.approx(55.8, abs=0.1) and d[16129] == 16129 and d[16130] == 1


def test_ranking(spark):
    hits = spark.createDataFrame([(5, 1.0), (2, 1.0), (8, 1.0), (9, float("nan")), (10, float("inf"))], "doc_id long, score double")
    assert [r[0] for r in search.ranked(search.finite(hits), 10).collect()] == [2, 5, 8]
    assert search.total(hits).first()["total"] == 5
    assert search.ranked(hits, 3, start=90).count() == 0
    with pytest.raises(ValueError):
        search.ranked(hits, 0)
    falling = spark.createDataFrame([(i, float(6 - i)) for i in range(6)], "doc_id long, score double")
    for mode in ("keyset", "reference"):
        assert [r[0] for r in search.ranked(falling, 3, after=search.After(4.0, 2), after_mode=mode).collect()] == [3, 4, 5]
    mixed = spark.createDataFrame([(7, 3.0), (1, 2.0), (9, 1.0)], "doc_id long, score double")
    assert [r[0] for r in search.ranked(mixed, 3, after=search.After(3.0, 7)).collect()] == [1, 9]
    assert [r[0] for r in search.ranked(mixed, 3, after=search.After(3.0, 7), after_mode="reference").collect()] == [9]


def test_boost_and_text(spark):
    c = corpus(spark, ["a", "b"])
    assert c.hits(Boost(t("a"), 3.0)).first()["score"] == pytest.approx(3 * c.hits(t("a")).first()["score"])
    assert str(Bool(must=(t("a"),), should=(t("b"),), must_not=(t("c"),), filter=(Range("v", 1, None, False),), min_should=1)) == "+text:a text:b -text:c #v:{1 TO *]~1"
    assert Phrase("f", ("a",)).normalise() == Term("f", "a")
    assert hash(t("a")) == hash(t("a")) and t("a") != t("b")


def test_histograms(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (20.0,), (None,), (float("nan"),)], "v double")
    assert [r["n"] for r in search.histogram(df, "v", 0, 5, 3).orderBy("bucket").collect()] == [2, 1, 0]
    assert [(r["key"], r["n"]) for r in search.date_histogram(df, "v", 0, 25, 5, 2).collect()] == [(0.0, 2), (5.0, 1)]
    assert sorted((r["key"], r["n"], r["total_hits"]) for r in search.date_histogram_with_total(df, "v", 0, 25, 5, 2).collect()) == [(0.0, 2, 6), (5.0, 1, 6)]
    assert [tuple(r) for r in search.date_histogram_with_total(df.limit(0), "v", 0, 25, 5, 2).collect()] == [(None, 0, 0)]


def test_index_life(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    ix.add(spark.createDataFrame([(i, f"word{i} common text") for i in range(5)], "doc_id long, text string")).commit()
    first = ix.open()
    assert (first.num_docs(), first.max_doc()) == (5, 5)
    ix.delete(t("word3")).commit()
    second = ix.reopen(first)
    assert second is not first and ix.reopen(second) is second
    assert (second.num_docs(), second.max_doc(), first.num_docs()) == (4, 5, 5)
    assert ids(second.hits(t("common"))) == [0, 1, 2, 4]
    ix.update(t("word0"), spark.createDataFrame([(0, "new common words")], "doc_id long, text string")).commit()
    third = ix.open()
    assert (third.num_docs(), third.max_doc()) == (4, 6)
    assert ids(third.hits(t("new"))) == [0] and third.count(t("word0")) == 0
    ix.add(spark.createDataFrame([(77, "lost")], "doc_id long, text string"))
    ix.rollback()
    assert ix.open().num_docs() == 4
    ix.compact(1)
    last = ix.open()
    assert (last.num_docs(), last.max_doc()) == (4, 4)
    assert third.max_doc() == 6
    with pytest.raises(FileNotFoundError):
        Index(spark, str(tmp_path / "none"), mode="append")


DOCS = "doc_id long, text string"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def test_merge_to_one_takes_pending_batches(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    ix.add(batch(spark, (1, "a b"))).commit()
    ix.add(batch(spark, (2, "a c")))
    ix.compact()
    assert len(ix.version().segments) == 1 and ids(ix.open().hits(t("a"))) == [1, 2]
    number = ix.version().number
    assert ix.compact() == number and ix.compact(3) == number  # nothing to do, nothing written


def test_merge_to_n(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    for i in range(4):
        ix.add(batch(spark, *((10 * i + j, f"w{i} common x{j}") for j in range(i + 1)))).commit()
    ix.delete(t("w3")).commit()
    ix.compact(2)
    seen = ix.open()
    assert len(seen.version.segments) == 1 and seen.version.tombstones == ()  # the largest lost all its rows
    assert (seen.num_docs(), seen.max_doc()) == (6, 6) and ids(seen.hits(t("common"))) == [0, 10, 11, 20, 21, 22]
    ix.add(batch(spark, (99, "w9 common"))).commit()
    ix.delete(t("x0")).commit()
    ix.compact(2)
    assert len(ix.version().segments) == 2 and ix.open().num_docs() == 4 == ix.open().max_doc()


def test_merge_of_nothing(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    seen = ix.open()
    assert (seen.num_docs(), seen.max_doc(), seen.count(t("a")), seen.docs.count()) == (0, 0, 0, 0)
    assert seen.search(t("a"), 5).collect() == [] and seen.match(Bool(must=(t("a"),), must_not=(t("b"),))).collect() == []
    assert ix.compact() == 0 and ix.delete(t("a")).commit() == 0 and seen.search(Phrase("text", ("a", "b")), 5).collect() == []


def test_writer_that_died(spark, tmp_path):
    path = tmp_path / "ix"
    ix = Index(spark, str(path))
    ix.add(batch(spark, (1, "a"))).commit()
    (path / "drafts").mkdir(exist_ok=True)
    (path / "drafts" / "half").write_text('{"number": 2, "segm')
    (path / "versions" / "00000002.json.tmp").write_text("{")
    assert ix.add(batch(spark, (2, "a"))).commit() == 2 and ix.open().count(t("a")) == 2


def test_writers_meet(spark, tmp_path):
    one = Index(spark, str(tmp_path / "ix"))
    one.add(batch(spark, (1, "a"), (2, "a b"))).commit()
    two = one.writer()
    one.add(batch(spark, (3, "a")))
    two.add(batch(spark, (4, "a"))).commit()
    one.commit()
    assert ids(one.open().hits(t("a"))) == [1, 2, 3, 4]
    one.delete(t("b"))
    two.compact()
    with pytest.raises(RuntimeError):
        one.commit()
    one.rollback().delete(t("b")).commit()
    assert ids(one.open().hits(t("a"))) == [1, 3, 4]


def test_deletions(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"), text=("type", "text"))
    rows = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd", f"document {i}") for i in range(10)], "doc_id long, type string, text string")
    for k in range(3):
        ix.add(rows.where(f"doc_id % 3 = {k}"))
    ix.commit()
    for i in range(0, 10, 2):
        ix.delete(t(str(i)))
    ix.delete(t("0"))  # deleted before in the same commit
    ix.commit()
    seen = ix.open()
    assert (seen.num_docs(), seen.max_doc()) == (5, 10) and ids(seen.hits(t("document"))) == [1, 3, 5, 7, 9]
    assert seen.count(t("document")) == 5 and seen.count(Term("type", "even")) == 0 and seen.field_stats("text") == {"doc_count": 5, "sum_ttf": 10}
    ix.delete(t("document")).commit()
    assert ix.open().num_docs() == 0 and ix.open().search(t("document"), 3).collect() == []
    late = Index(spark, str(tmp_path / "ix"), text=("type", "text"), deletes="on_compact")
    assert late.open().count(t("document")) == 10
    late.compact()
    assert late.open().max_doc() == 0 and late.version().segments == ()


def test_statistics_are_kept(spark, tmp_path):
    from skylode.operators import index

    texts = ["oil price oil", "the price", None, "", "oil é x1", "price"]
    df = batch(spark, *enumerate(texts))
    ix = Index(spark, str(tmp_path / "ix"))
    ix.add(df.where("doc_id < 3")).add(df.where("doc_id >= 3")).commit()
    ix.delete(t("the")).commit()
    left = df.where("doc_id <> 1")
    want = {(r["term"], r["df"], r["ttf"]) for r in index.term_stats(index.postings_of(left, "doc_id", "text")).collect()}
    assert {(r["term"], r["df"], r["ttf"]) for r in ix.open().terms("text").collect()} == want == {("oil", 2, 3), ("price", 2, 2), ("é", 1, 1), ("x1", 1, 1)}
    stats = ix.open().terms("text")
    assert index.seek_exact(stats, "text", "oil").first()["ttf"] == 3 and index.seek_exact(stats, "text", "gas").count() == 0
    assert [r["term"] for r in index.terms_after(stats, "text", "oil", 2).collect()] == ["price", "x1"]


def test_postings_are_cut_in_small_batches(spark, monkeypatch):
    """What a worker holds does not grow with the rows of its task: few rows come at a time, few tokens are sorted at once."""
    import pyarrow as pa
    from pyspark.sql import DataFrame
    from skylode.operators import index

    df = spark.range(0, 3000, 1, 4).selectExpr("id as doc_id", "concat('a b ', id) as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert index.postings_of(df, "doc_id", "text").count() == 9000
    sizes = df.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()
    assert sum(r["n"] for r in sizes) == 3000 and max(r["n"] for r in sizes) <= 256

    made = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: made.append(run) or self)
    monkeypatch.setattr(type(df), "mapInArrow", DataFrame.mapInArrow)
    index.postings_of(df, "doc_id", "text")
    monkeypatch.undo()
    monkeypatch.setattr(index, "BATCH_TOKENS", 5)
    texts = [["a", "b", "a"], ["b"], None, [], ["x"] * 9, ["y"], ["a", "c"], ["z"] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "t"])
    out = [o.to_pylist() for o in made[0](iter([batch]))]
    assert [sum(r["freq"] for r in o) for o in out] == [4, 9, 3, 5]
    want = [(0, "a", 3, [0, 2]), (0, "b", 3, [1]), (1, "b", 1, [0]), (4, "x", 9, list(range(9))), (5, "y", 1, [0]), (6, "a", 2, [0]), (6, "c", 2, [1]), (7, "z", 5, list(range(5)))]
    assert sorted((r["doc_id"], r["term"], r["len"], r["positions"]) for o in out for r in o) == want


def test_joins_of_many_deleted_rows(spark, tmp_path, monkeypatch):
    """Where many rows are deleted, the rows that meet in one task are bounded, whatever they pack to and however many segments there are."""
    from pyspark.sql import functions as F
    from skylode.operators import index

    monkeypatch.setattr(index, "JOIN_ROWS", 100)
    monkeypatch.setattr(index, "FEW_DEAD", 10)
    rows = spark.range(0, 1000, 1, 2).selectExpr("id as doc_id", "concat('w', id % 2, ' all') as text", "id % 5 as v")
    ix = Index(spark, str(tmp_path / "ix"))
    for k in range(4):
        ix.add(rows.where(f"doc_id % 4 = {k}"))
    ix.commit()
    ix.delete(t("w1")).commit()
    ix.delete(Term("v", "2")).delete(Bool(must=(t("w0"),), filter=(Range("v", 0, 0),))).commit()
    left = [i for i in range(1000) if i % 2 == 0 and i % 5 not in (0, 2)]
    seen = ix.open()
    assert ids(seen.docs) == left == ids(seen.hits(t("all"))) and seen.count(t("all")) == 300 == seen.num_docs()
    tasks = [r["count"] for r in seen.docs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 8 and max(tasks) <= 100
    ix.compact(2)
    assert ids(ix.open().stored) == left and ix.version().tombstones == ()


def test_create_and_merge_tiers(spark, tmp_path):
    from skylode.operators.lifecycle import SizeClasses

    ix = Index(spark, str(tmp_path / "ix"))
    for i in range(4):
        ix.add(batch(spark, (i, f"a w{i}")))
    ix.commit()
    groups = ix.merge_tiers(SizeClasses(per_class=2, at_once=3))
    assert [len(g) for g in groups] == [3] and len(ix.version().segments) == 2 and ids(ix.open().hits(t("a"))) == [0, 1, 2, 3]
    assert ix.merge_tiers(SizeClasses(per_class=2)) == []
    fresh = Index(spark, str(tmp_path / "ix"), mode="create")
    assert fresh.open().num_docs() == 0 and fresh.version().number == 0
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "ix"), mode="other")


def test_index_agrees_with_rows(spark, tmp_path):
    texts = ["oil price rises", "the price of oil", "oil price oil price", "gas and oil", "price", None, ""]
    df = spark.createDataFrame([(i, x, i * 10) for i, x in enumerate(texts)], "doc_id long, text string, v long")
    ix = Index(spark, str(tmp_path / "ix"))
    ix.add(df.where("doc_id < 3")).add(df.where("doc_id >= 3")).commit()
    seen, rows = ix.open(), search.Corpus(df)
    for q in (
        t("oil"), Phrase("text", ("oil", "price")), Bool(must=(t("oil"), t("price"))), Bool(should=(t("oil"), t("gas")), must_not=(t("the"),)),
        Bool(must=(t("oil"),), filter=(Range("v", 10, 30),)), Bool(should=(t("oil"), t("price"), t("gas")), min_should=2), Bool(must=(MatchAll(),), must_not=(t("oil"),)),
    ):
        a = {r["doc_id"]: round(r["score"], 9) for r in seen.hits(q).collect()}
        assert a == {r["doc_id"]: round(r["score"], 9) for r in rows.hits(q).collect()}, str(q)
        assert ids(seen.match(q)) == sorted(a)
