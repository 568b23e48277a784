import pytest

from vellum.errors import InvalidRequest
from vellum.operators.confidence import annotate, response_confidence
from vellum.operators.fusion import FusionConfig, agreement, chunk_hits, orphan_pages, page_hits, rrf, strategy_named, weighted
from vellum.plans.modes import resolve


def sides(spark, chunks, pages):
    c = spark.createDataFrame([(d, i, a, b, float(s)) for d, i, a, b, s in chunks], "doc_id string, chunk_index int, page_start int, page_end int, score double")
    p = spark.createDataFrame([(k, d, n, float(s)) for k, (d, n, s) in enumerate(pages)], "page_id int, doc_id string, page_number int, score double")
    return chunk_hits(c), page_hits(p)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_text_only_keeps_order(spark):
    c, p = sides(spark, [("d1", 0, 1, 1, 0.9), ("d1", 1, 1, 1, 0.8), ("d2", 0, 1, 1, 0.7)], [])
    assert [(r["doc_id"], r["chunk_index"]) for r in rows(rrf(c, p))] == [("d1", 0), ("d1", 1), ("d2", 0)]


def test_page_bonus_lifts(spark):
    c, p = sides(spark, [("d2", 0, 1, 1, 0.85), ("d1", 0, 1, 1, 0.80)], [("d1", 1, 0.95)])
    top = rows(rrf(c, p))[0]
    assert top["doc_id"] == "d1" and abs(top["score"] - (1 / 62 + 1 / 61)) < 1e-12 and top["page_score"] == 0.95


def test_page_outside_range_vanishes(spark):
    c, p = sides(spark, [("d1", 0, 1, 1, 0.5)], [("d1", 5, 0.9)])
    got = rows(rrf(c, p))
    assert len(got) == 1 and got[0]["page_score"] is None and orphan_pages(c, p).count() == 0


def test_orphan(spark):
    c, p = sides(spark, [("d1", 0, 1, 1, 0.5)], [("d2", 1, 0.9)])
    orphan = [r for r in rows(rrf(c, p)) if r["orphan"]][0]
    assert orphan["chunk_index"] == -1 and orphan["text_score"] is None and orphan["page_start"] == 1


def test_null_document_takes_a_rank(spark):
    c, p = sides(spark, [("d1", 0, 1, 1, 0.5)], [(None, 1, 0.9), ("d1", 1, 0.8)])
    assert abs(rows(rrf(c, p))[0]["score"] - (1 / 61 + 1 / 62)) < 1e-12


def test_lowest_rank_against_highest_score(spark):
    c, p = sides(spark, [("d1", 0, 1, 3, 0.5)], [("d1", 1, 0.9), ("d1", 3, 0.4)])
    assert rows(rrf(c, p))[0]["page_score"] == 0.9 and rows(weighted(c, p))[0]["page_score"] == 0.9


@pytest.mark.parametrize(
    "chunks, pages, config, score",
    [
        ([("d1", 0, 1, 1, 0.8)], [], {}, 0.4),
        ([("d1", 0, 1, 1, 0.5)], [("d1", 1, 50)], {}, 0.75),
        ([("d1", 0, 1, 1, 0.5)], [("d1", 1, 50)], {"text_weight": 0.2, "visual_weight": 0.8}, 0.9),
        ([("d1", 0, 1, 1, 5.0)], [("d1", 1, 200)], {}, 1.0),
        ([("d1", 0, 1, 1, 0.5)], [("d1", 1, 50)], {"visual_floor": -1.0}, 0.75),
    ],
)
def test_weighted(spark, chunks, pages, config, score):
    c, p = sides(spark, chunks, pages)
    assert abs(rows(weighted(c, p, FusionConfig(**config)))[0]["score"] - score) < 1e-12


def test_top_k_and_ties(spark):
    c, p = sides(spark, [(f"d{i}", 0, 1, 1, 0.5) for i in range(4)], [("x", 1, 0.9)])
    got = rows(rrf(c, p, FusionConfig(top_k=2)))
    assert [r["doc_id"] for r in got] == ["d0", "x"]


def test_strategies():
    assert strategy_named(" RRF ") is rrf and strategy_named(None) is rrf and strategy_named("weighted") is weighted
    with pytest.raises(InvalidRequest, match="rrf, weighted"):
        strategy_named("best")


@pytest.mark.parametrize(
    "text, page, quality, both, raw, label",
    [(0.85, 60, "2", True, 0.94, "high"), (0.5, 60, "0", True, 0.60, "medium"), (0.4, 5, "0", True, 0.24, "low"), (0.8, None, "2", False, 0.42, "medium"), (0.8, None, "1", False, 0.26, "low"), (0.8, None, "0", False, 0.10, "low"), (0.8, None, None, False, 0.42, "medium")],
)
def test_confidence(spark, text, page, quality, both, raw, label):
    hit = spark.createDataFrame([(float(text), float(text), None if page is None else float(page), {"text_quality": quality} if quality else {}, both)], "text_score double, score double, page_score double, metadata map<string,string>, agrees boolean")
    got = annotate(hit).first()
    assert abs(got["raw_confidence"] - raw) < 1e-9 and got["confidence"] == label
    assert response_confidence(annotate(hit)).first()[0] == label


def test_no_hits_no_confidence(spark):
    empty = spark.createDataFrame([], "raw_confidence double")
    assert response_confidence(empty).first()[0] is None


def test_agreement(spark):
    c, p = sides(spark, [("d1", 0, 1, 1, 0.5), ("d2", 0, 1, 1, 0.4)], [("d1", 9, 0.9)])
    assert {r["doc_id"]: r["agrees"] for r in agreement(c, c, p).collect()} == {"d1": True, "d2": False}


def test_modes():
    assert resolve("auto", True).mode == "fusion" and resolve(None, False).mode == "text_only" and resolve("FUSION", True).mode == "fusion"
    fallback = resolve("fusion", False)
    assert fallback.mode == "text_only_fallback" and len(fallback.warnings) == 1
    assert resolve("colpali_only", True).mode == "colpali_only" and resolve("text_only", True).mode == "text_only"
    for bad in (("colpali_only", False), ("nearest", True)):
        with pytest.raises(InvalidRequest):
            resolve(*bad)
