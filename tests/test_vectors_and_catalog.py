import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.operators import catalog, jobs, pooling, topk
from vellum.operators.pages import PAGE_BLOCK, page_offsets


def pooled(spark, tokens, grid, specials, rows=True):
    df = spark.createDataFrame([(tokens,)], "t array<array<float>>")
    return df.select((pooling.pool_rows if rows else pooling.pool_cols)(F.col("t"), grid, specials)).first()[0]


def test_pooling(spark):
    grid4 = [[float(i)] * 2 for i in range(16)]
    assert [r[0] for r in pooled(spark, grid4, 4, 0)] == [4 * r + 1.5 for r in range(4)]
    assert [r[0] for r in pooled(spark, grid4, 4, 0, rows=False)] == [c + 6 for c in range(4)]
    assert pooled(spark, grid4 + [[-1.0, -1.0], [-2.0, -2.0]], 4, 2)[4:] == [[-1.0, -1.0], [-2.0, -2.0]]
    assert pooled(spark, [], 4, 0) == []
    # a full grid stays, with as many special tokens as there are behind it
    assert [r[0] for r in pooled(spark, grid4, 4, 2)] == [4 * r + 1.5 for r in range(4)]
    assert pooled(spark, grid4 + [[-1.0, -1.0]], 4, 2)[4:] == [[-1.0, -1.0]] and len(pooled(spark, grid4[:11], 4, 2)) == 5
    assert pooled(spark, None, 4, 0) is None
    assert len(pooled(spark, [[float(i)] for i in range(18)], 32, 6)) == 9  # a grid of 3; three tokens are left out
    assert len(pooled(spark, [[1.0]] * (32 * 32 + 6), 32, 6)) == 38
    assert pooled(spark, [[1.0], [2.0]], 4, 6) == [[1.0], [2.0]]


def test_cosine_topk_and_filter(spark):
    rows = [("a", [1.0, 0.0], {"k": "x"}), ("b", [1.0, 0.1], {"k": "y"}), ("c", [0.0, 0.0], {"k": "x"}), ("d", [1.0, 0.0], {"k": "x"}), ("e", None, {"k": "x"}), ("f", [1.0], {"k": "x"})]
    df = spark.createDataFrame(rows, "id string, vector array<float>, metadata map<string,string>")
    assert [r["id"] for r in topk.cosine_topk(df, [1.0, 0.0], 10).collect()] == ["a", "d", "b"]
    assert [r["id"] for r in topk.cosine_topk(topk.metadata_filter(df, {"k": "y"}), [1.0, 0.0], 0).collect()] == ["b"]
    assert topk.metadata_filter(df, {}) is df and topk.metadata_filter(df, {"k": None}).count() == 0


@pytest.mark.parametrize("bytes_allowed", [1 << 20, 0])
def test_batch_topk_equals_brute_force(spark, bytes_allowed):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[20] = v[10]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "id bigint, vector array<float>").repartition(3)
    got = topk.batch_topk(df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), df, 5, dim=8, settings=Settings(broadcast_bytes=bytes_allowed), query_block=7, point_block=64)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = set()
    for q in range(0, 300, 10):
        s = np.round(u @ u[q], 9)
        s[q] = -2
        want |= {(q, int(j), k + 1) for k, j in enumerate(np.lexsort((np.arange(300), -s))[:5])}
    assert {(r["query_id"], r["near_id"], r["rank"]) for r in got.collect()} == want


def test_two_stage(spark):
    rng = np.random.default_rng(5)
    pages = []
    for i in range(60):
        o = rng.standard_normal((5, 4))
        pages.append((i, o.tolist(), [o[:2].mean(0).tolist(), o[2:4].mean(0).tolist(), o[4].tolist()], [o[[0, 2]].mean(0).tolist(), o[[1, 3]].mean(0).tolist(), o[4].tolist()]))
    df = spark.createDataFrame(pages, "id int, original array<array<double>>, pooled_rows array<array<double>>, pooled_cols array<array<double>>")
    query = [[1.0, 0, 0, 0], [0, 1.0, 0, 0]]
    assert [r["id"] for r in topk.two_stage(df, query, 6).collect()] == [r["id"] for r in topk.max_sim_topk(df, query, 6).collect()]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), (None, 2), ("c", 2)], "id string, v int")
    once = catalog.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, catalog.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_listing(spark):
    c = spark.createDataFrame([("docs", 17, 17, 3), ("scans", 42, 42, 3), ("scans_pages", 0, 200, None)], "name string, vectors bigint, points bigint, dim int")
    assert sorted(map(tuple, catalog.list_bases(c).collect())) == [("docs", 17, 3, False, 0), ("scans", 42, 3, True, 200)]


def test_payload(spark):
    df = spark.createDataFrame([("d", None, {"doc_id": "evil", "type": "mine", "embed_model": "evil", "x": "1"})], "d string, t string, m map<string,string>")
    got = df.select(catalog.payload({"doc_id": F.col("d"), "type": F.col("t")}, F.col("m"), F.lit("model"))).first()[0]
    assert got == {"doc_id": "d", "type": "mine", "x": "1", "embed_model": "model"}


def test_recovery(spark):
    df = spark.createDataFrame([("a", "IN_PROGRESS", 0, None), ("b", "IN_PROGRESS", 3, None), ("c", "QUEUED", 0, None), ("d", "COMPLETED", 1, None), ("e", "FAILED", 0, "x")], "job_id string, status string, retry_count int, error string")
    got = {r["job_id"]: (r["status"], r["retry_count"], r["requeued"]) for r in jobs.recover(df).collect()}
    assert got == {"a": ("QUEUED", 1, True), "b": ("FAILED", 3, False), "c": ("QUEUED", 0, True), "d": ("COMPLETED", 1, False), "e": ("FAILED", 0, False)}
    assert "retry cap (3)" in jobs.recover(df).where("job_id = 'b'").first()["error"]


def test_page_offsets_over_blocks(spark):
    pages = [("d", n, "x" * (n % 7)) for n in range(1, 2 * PAGE_BLOCK + 9)]
    df = spark.createDataFrame(pages, "doc_id string, page_number int, text string")
    at, want = 0, []
    for _, n, t in pages:
        if t:
            want.append((n, at, at + len(t)))
            at += len(t) + 2
    assert sorted((r["page_number"], r["page_from"], r["page_to"]) for r in page_offsets(df).collect()) == want
