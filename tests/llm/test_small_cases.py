"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from fractions import Fraction

import pytest

from roadloom.llm import jaccard_join, line_dedup, mixing, packing, quality_rules, secret_scan, sharding, topk_search, toxicity, url_filter

from .conftest import words

ODD = (None, "", "  \n ", words(40), words(40), words(3000, stem="long"), "a")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture
def odd(docs):
    return docs(*ODD, ids=[0, 1, 2, 3, 3, None, 6], sources=["a", None, "b", "a", "a", "c", None])


def test_secrets(odd):
    out = rows(secret_scan.scan(odd))
    assert len(out) == 7 and all(r["spans"] == [] for r in out)


def test_quality(odd):
    out = {r["doc_id"]: r for r in rows(quality_rules.judged(odd))}
    assert out[0]["n_words"] == 0 and out[0]["base_failed"] and not out[0]["kept"]
    assert out[3]["kept"] and out[None]["n_words"] == 3000 and out[None]["kept"]


def test_lines(odd):
    out = rows(line_dedup.deduped(odd, 30))
    assert len(out) == 7 and set(odd.columns) < set(out[0])
    twins = sorted((r["text"] for r in out if r["doc_id"] == 3), key=len)
    assert twins == ["", words(40)]  # one of two equal rows is the first
    assert [r["text"] for r in out if r["doc_id"] == 0] == [None]


def test_mixing(odd):
    out = rows(mixing.mix(odd))
    assert len(out) == 7 and abs(sum({r["source_size"]: r["target"] for r in out}.values()) - sum(r["size"] for r in out)) < 1e-6
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert sum(1 for _ in rows(mixing.mixed(odd))) == sum(r["times"] for r in out)


def test_packing(odd):
    out = rows(packing.packed(odd, packing.tokenizer_path()))
    assert sum(r["length"] for r in out if r["doc_id"] == 0) == 1
    per = {}
    for r in out:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in per.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_jaccard(odd):
    out = rows(jaccard_join.classed(jaccard_join.join(odd)))
    assert len(out) == 7 and [r["component"] for r in out if r["n"] == 0] == [None] * 3
    assert len({r["component"] for r in out if r["doc_id"] == 3}) == 1
    assert len(rows(jaccard_join.one_of_each(odd))) == 6


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(3, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.trained(odd, labels)
    assert model is None
    assert all(r["severity"] == 0 for r in rows(toxicity.graded(odd, model)))
    assert toxicity.clean(odd, model).count() == 7


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (20, [3.0]), (None, [1.0, 1.0])]
    v = topk_search.whole_vectors(spark.createDataFrame([(i, x, 0, "g") for i, x in data], "vec_id bigint, embedding array<float>, label int, g string"))
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk_search.search(v, v.where("vec_id % 20 = 0"), 2)))
    assert out == [(0, 1, 20, 12288), (0, 2, 1, 20480)] or out == [(0, 1, 1, 20480), (0, 2, 2, 20480), (20, 1, 0, 12288), (20, 2, 1, 12288)]


def test_sharding(odd):
    out = rows(sharding.sharded(odd, 2))
    assert len(out) == 7
    for k in (0, 1):
        own = [r["slot"] for r in out if r["shard"] == k]
        assert sorted(own) == list(range(len(own)))


def test_urls(spark):
    pages = spark.createDataFrame([(0, None, None, "x"), (1, "no host", "<a>", "x"), (2, "HTTP://A.Example.ORG/es/x#y", None, "x"), (2, "HTTP://A.Example.ORG/es/x#y", None, "x")], "page_id bigint, url string, html string, node string")
    out = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter.judged(pages)))
    assert out == [(0, "", "", None, "allow"), (1, "", "", None, "allow")] + 2 * [(2, "a.example.org", "/es/x", "example.org/es/", "block")]


def test_empty_tables(spark, docs):
    none = docs("x").where("false")
    assert secret_scan.scan(none).count() == quality_rules.judged(none).count() == mixing.mix(none).count() == line_dedup.deduped(none).count() == 0
    assert packing.packed(none, packing.tokenizer_path()).count() == sharding.sharded(none).count() == jaccard_join.classed(jaccard_join.join(none)).count() == 0
    assert jaccard_join.one_of_each(none, 5, Fraction(4, 5)).count() == mixing.mixed(none).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.judged(pages).count() == 0
    v = spark.createDataFrame([], "vec_id bigint, v array<bigint>")
    assert topk_search.search(v, v).count() == 0
