"""Operators on pairs: near-duplicates, neighbours, components."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import neighbours, shingles, similar

SCHEMA = "id string, text string"


def texts(n, seed=1, size=70):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(size)) for _ in range(n)]


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randint(0, 9999)}" if rng.random() < share else w for w in text.split())


def brute(rows, least=40):
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    ids = sorted(i for i, s in sets.items() if len(s) >= least)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("x")).withColumn("places", F.lit(1))
    return {(r["id_a"], r["id_b"]) for r in similar.alike([similar.Side("t", df.select("id", "text"), shingles.word_shingles)]).collect()}


def test_pairs_equal_brute_force(spark):
    rows = []
    for k, t in enumerate(texts(40)):
        rows.append((f"a{k:03}", t))
        rows += [(f"b{k:03}{j}", edited(t, share, 10 * k + j)) for j, share in enumerate((0.02, 0.05, 0.1, 0.3))]
    rows += [("c1", "too short"), ("c2", "too short"), ("c3", ""), ("d1", rows[0][1]), ("a000", rows[0][1])]
    assert found(spark, rows) == brute(rows)


def test_nulls_and_empty(spark):
    t = texts(1)[0]
    assert found(spark, [("a", t), ("b", None), (None, t), ("c", t.upper() + "!")]) == {("a", "c")}
    assert found(spark, []) == set()


def test_crowd_of_near_copies_and_of_phrases(spark):
    """Many records share a phrase, and many are near copies: blocks are split, no pair is lost."""
    phrase = " ".join(f"common{k}" for k in range(30))
    rows = [(f"p{k:03}", phrase + " " + t) for k, t in enumerate(texts(60, 5, 60))]
    base = texts(1, 9, 120)[0]
    rows += [(f"q{k:03}", edited(base, 0.01, k)) for k in range(60)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("tile", [1024, 7])
def test_crowded_block_loses_no_pair(spark, monkeypatch, tile):
    """Pairs that have nothing but one crowded block in common, and are close enough, are all candidates."""
    monkeypatch.setattr(similar, "TILE", tile)
    n, rng = 50, random.Random(2)
    shorts = [[rng.randint(0, 127) if p < 12 + k % 24 else p for p in range(similar.PLACES)] for k in range(n)]
    rows = [("x", f"r{k:02}", k, [99, *(1000 * k + p for p in range(1, 20))], shorts[k]) for k in range(n)]
    rows += rows[:5]
    classes = spark.createDataFrame(rows, "kind string, id string, d1 bigint, blocks array<bigint>, short array<tinyint>")
    got = {(r["a"], r["b"]) for r in similar.candidates(classes, name="crowd").collect()}
    agree = lambda a, b: sum(x == y for x, y in zip(shorts[a], shorts[b]))
    want = {(f"r{a:02}", f"r{b:02}") for a in range(n) for b in range(a + 1, n) if agree(a, b) >= similar.LEAST_AGREEING}
    assert got == want and 0 < len(want) < n * (n - 1) // 2


def test_common_phrases_make_few_candidates(spark, monkeypatch):
    """Texts that have nothing but a phrase in common fall out before their shingle sets are gathered."""
    phrase = " ".join(f"common{k}" for k in range(40))
    rows = [(f"p{k:03}", phrase + " " + t) for k, t in enumerate(texts(800, 7, 100))]
    rows += [(f"q{k:03}", edited(rows[k][1], 0.03, k)) for k in range(10)]
    df, seen, staged = spark.createDataFrame(rows, SCHEMA), [], similar.staged

    def watched(df, name):
        out = staged(df, name)
        seen.extend(out.collect() if name == "alike-candidates" else [])
        return out

    monkeypatch.setattr(similar, "staged", watched)
    got = {(r["id_a"], r["id_b"]) for r in similar.alike([similar.Side("t", df, shingles.word_shingles)]).collect()}
    assert got == brute(rows) and len(seen) < 150, len(seen)


def test_mass_of_copies_is_a_star(spark):
    t = texts(1)[0]
    n = int(similar.EXPAND**0.5) + 40
    rows = [(f"m{k:04}", t) for k in range(n)] + [("z", edited(t, 0.03, 1))]
    got = found(spark, rows)
    assert {("m0000", f"m{k:04}") for k in range(1, n)} <= got and len(got) < 4 * n
    assert all((f"m{k:04}", "z") in got for k in range(0, n, 17))


def test_long_text(spark):
    big = " ".join(texts(1, 3, 60_000))
    assert found(spark, [("a", big), ("b", big + " end"), ("c", texts(1)[0])]) == {("a", "b")}


@pytest.mark.parametrize("name, value, plain", [("A--b_C.pdf", None, "a b c pdf"), (None, "http://h/x/My%20File(1).PDF?q=1#p", "my file 1 pdf"), ("", "/srv/a/b.txt", "b txt"), (None, None, "")])
def test_names(name, value, plain):
    assert similar.plain_name(name, value) == plain


def test_requests(spark):
    t = texts(1)[0]
    request = "job_id string, request struct<source_type: string, source_value: string, filename: string>"
    code = lambda x: base64.b64encode(x.encode()).decode()
    rows = [
        ("j1", ("URL", "http://h/harbour-plan-north-1902.pdf", None)),
        ("j2", ("path", "/x/y", "draft harbour_plan_north_1902.PDF")),
        ("j3", ("INLINE", code(t), "one.txt")),
        ("j4", (" inline ", code(edited(t, 0.02, 1)), "completely-other-name-here.txt")),
        ("j5", ("INLINE", "%%%", "broken-inline-material.txt")),
        ("j6", (None, None, None)),
        ("j1", ("URL", "http://h/harbour-plan-north-1902.pdf", None)),
        (None, ("URL", "http://h/harbour-plan-north-1902.pdf", None)),
    ]
    jobs = spark.createDataFrame(rows, request)
    chunks = spark.createDataFrame([("c1", t), ("c2", t)], SCHEMA)
    assert {tuple(r) for r in similar.found(chunks, jobs).collect()} == {("chunk", "c1", "c2"), ("request", "j1", "j2"), ("request", "j3", "j4")}
    got = {(r["kind"], r["id"]): r["group_id"] for r in similar.groups(chunks, jobs).collect()}
    assert got["request", "j2"] == "j1" and got["chunk", "c2"] == "c1" and len(got) == 6


def test_short_and_foreign_texts_are_grouped(spark):
    rows = [("a", "Старый мост построен у реки в старом городе"), ("b", "Старый мост построен у реки, в старом городе"), ("c", "図書館は町の中心に近い"), ("d", "図書館は町の中心に近い。"), ("e", "mill"), ("f", "mill"), ("g", "forge"), ("h", ""), ("i", None)]
    chunks = spark.createDataFrame(rows, "id string, text string")
    jobs = spark.createDataFrame([], "job_id string, request struct<source_type: string, source_value: string, filename: string>")
    got = {r["id"]: r["group_id"] for r in similar.groups(chunks, jobs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "e"}


def test_different_texts_of_a_large_class_keep_their_links(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(f"p{i:03}", body + "." * (i % 5)) for i in range(100)]  # one shingle set, five texts
    jobs = spark.createDataFrame([], "job_id string, request struct<source_type: string, source_value: string, filename: string>")
    got = {(r["id_a"], r["id_b"]) for r in similar.found(spark.createDataFrame(rows, "id string, text string"), jobs).collect()}
    heads = [f"p{i:03}" for i in range(5)]
    assert got == {(a, b) for a in heads for b in heads if a < b} | {(f"p{i % 5:03}", f"p{i:03}") for i in range(5, 100)}


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(60)], "id_a string, id_b string")
    with pytest.raises(RuntimeError):
        similar.components(links, rounds=1)


def test_components_of_a_chain(spark):
    links = [(f"n{k:03}", f"n{k + 1:03}") for k in range(50)] + [("x", "y")]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["group_id"] for r in similar.components(spark.createDataFrame(links, "id_a string, id_b string")).collect()}
    assert all(got[f"n{k:03}"] == "n000" for k in range(51)) and got["y"] == "x" and len(got) == 53


# --- neighbours -------------------------------------------------------------------------------------------------


def true_lists(ids, v, k=5, least=0.92):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order if s[i, j] >= least}
    return out


def cloud(n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    for i in range(0, n - 7, 10):  # small groups of neighbours
        v[i + 1 : i + 7] = v[i] + rng.standard_normal((6, dim)) * np.linspace(0.05, 0.35, 6)[:, None]
    return v * rng.uniform(0.2, 30, (n, 1))


def lists_of(spark, rows, dim, **options):
    df = spark.createDataFrame(rows, "id string, vector array<float>").withColumn("block", F.lit(1)).withColumn("rep", F.lit("r"))
    return {(r["id"], r["near_id"]) for r in neighbours.neighbours(df, dim, **options).collect()}


def test_one_block_is_exact(spark):
    v = cloud(600).astype(np.float32)
    ids = [f"p{i:04}" for i in range(600)]
    assert lists_of(spark, [(i, x.tolist()) for i, x in zip(ids, v)], 16) == true_lists(ids, v.astype(float))


def test_recall_over_many_leaves(spark):
    v = cloud(3000, 32).astype(np.float32)
    ids = [f"p{i:04}" for i in range(3000)]
    got = lists_of(spark, [(i, x.tolist()) for i, x in zip(ids, v)], 32, block=100)
    want = true_lists(ids, v.astype(float))
    pairs = lambda s: {tuple(sorted(p)) for p in s}
    assert len(pairs(got) & pairs(want)) >= 0.97 * len(pairs(want))


def test_every_vector_has_its_nearest(spark):
    v = cloud(1500, 16).astype(np.float32)
    v[700:707] = v[3]  # copies
    ids = [f"p{i:04}" for i in range(1500)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)] + [("q", None)], "id string, vector array<float>")
    want = true_lists(ids, v.astype(float), least=-1)
    for block, share in ((8192, 1.0), (200, 0.95)):
        got = {(r["id"], r["near_id"]) for r in neighbours.nearest(df, 16, block=block).collect()}
        assert len(got) == 5 * 1500 and len(got & want) >= share * len(want)
    lone = spark.createDataFrame([("a", [[1.0, 0.0]]), ("b", [[0.0, 1.0]]), ("c", [[-1.0, 0.1]])], "id string, pooled_rows array<array<float>>").withColumn("original", F.col("pooled_rows"))
    assert neighbours.pages_in_exact_order(lone).count() == 6


def test_tree_deepens_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    monkeypatch.setattr(neighbours, "LEAST_SAMPLED", 40)
    v = cloud(4000, 32).astype(np.float32)
    ids = [f"p{i:04}" for i in range(4000)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, vector array<float>")
    _, _, sent = neighbours._prepared(df, 32, "deep", 100)
    assert sent.value.leaves == 64 and sent.value.blocks.sum() < 100  # the sample alone gives 4 or 8
    points = neighbours.unit(v.astype(float)) @ sent.value.directions
    sizes = np.bincount(neighbours._leaf(sent.value, points), minlength=64)
    assert sizes.max() < 250 and (sizes > 0).all()
    got = {tuple(sorted((r["id"], r["near_id"]))) for r in neighbours.neighbours(df, 32, block=100).collect()}
    want = {tuple(sorted(p)) for p in true_lists(ids, v.astype(float))}
    assert len(got & want) >= 0.95 * len(want)


def test_routes_of_a_deep_tree_stay_few():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    copies = []
    for rows in (10**7, 10**9):
        depth = neighbours.depths(rows, 1 << 62)[0]
        directions = neighbours.directions_of(64)
        tree = neighbours._tree(directions, neighbours._grown(x @ directions, min(depth, 11)), {}, 8192 << min(depth, 11), 8192)
        grown = neighbours._grown(x @ directions, depth - tree.leaves.bit_length() + 1)
        tree = neighbours._tree(directions, (tree.axis.tolist(), tree.at.tolist(), None, [1 / tree.leaves] * tree.leaves), {k: grown[:2] + (grown[3],) for k in range(tree.leaves)} if depth > 11 else {}, rows, 8192)
        row, _ = neighbours.search_order(tree, x[:500] @ directions, 0.4)
        copies.append(len(row) / 500)
    assert copies[1] < 12 * copies[0] and copies[1] < 400  # a hundred times the rows


def test_unusable_vectors_copies_and_ties(spark):
    v = cloud(100, 8).astype(np.float32)
    rows = [(f"p{i:03}", x.tolist()) for i, x in enumerate(v)]
    rows += [("q1", None), ("q2", [0.0] * 8), ("q3", [float("nan")] * 8), ("q4", [1.0] * 5), (None, v[0].tolist()), rows[0], ("q5", [None] * 8)]
    rows += [(f"r{i}", v[1].tolist()) for i in range(12)]
    got = lists_of(spark, rows, 8)
    ids = [f"p{i:03}" for i in range(100)] + [f"r{i}" for i in range(12)]
    assert got == true_lists(ids, np.vstack([v, np.repeat(v[1:2], 12, axis=0)]).astype(float))
    assert lists_of(spark, [], 8) == set()


def test_crowd_of_close_vectors(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal(16) + rng.standard_normal((900, 16)) * 0.02).astype(np.float32)
    ids = [f"p{i:04}" for i in range(900)]
    got = lists_of(spark, [(i, x.tolist()) for i, x in zip(ids, v)], 16, block=150)
    want = true_lists(ids, v.astype(float))
    assert len(got & want) >= 0.97 * len(want)


def test_pages(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        k = 5 if i % 3 else 6
        rows.append((f"a{i:02}", rng.standard_normal((k, 4)).tolist()))
        rows.append((f"b{i:02}", (np.array(rows[-1][1]) + rng.standard_normal((k, 4)) * 0.05).tolist()))
    rows += [("none", None), ("empty", [])]
    df = spark.createDataFrame(rows, "id string, pooled_rows array<array<float>>").withColumn("original", F.col("pooled_rows"))
    got = {tuple(r) for r in neighbours.pairs_of(neighbours.page_neighbours(df)).collect()}
    assert got == {(f"a{i:02}", f"b{i:02}") for i in range(30)}
    assert neighbours.pages_in_exact_order(df).where("rank = 1").count() == 60
    assert neighbours.page_neighbours(df.limit(0)).count() == 0
