import uuid

from pyspark.sql import functions as F

from vellum.functions import files, text
from vellum.functions.ids import chunk_point_id, page_point_id
from vellum.functions.scoring import bucket, clamp_share, text_trust
from vellum.functions.vectors import cosine, max_sim, same_length, usable


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_point_ids_are_version_5_urls(spark):
    got = spark.createDataFrame([("doc-1", 3), ("é", 0), (None, 1)], "d string, n int").select(chunk_point_id(F.col("d"), F.col("n")), page_point_id(F.col("d"), F.col("n"))).collect()
    assert got[0][0] == "ac5cee40-75b4-5f65-bd48-7e901a7a0529"
    assert got[1][0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "é:0")) and got[1][1] == str(uuid.uuid5(uuid.NAMESPACE_URL, "é:page:0"))
    assert got[2][0] is None


def test_normalise_and_quality(spark):
    assert values(spark, [("\t a\n\n\n\nb \n",), (None,), (" x",)], "t string", text.normalised(F.col("t"))) == ["a\n\nb", None, " x"]
    assert values(spark, [(0,), (49,), (50,), (499,), (500,), (None,)], "n int", text.quality_class(F.col("n"))) == [0, 0, 1, 1, 2, None]


def test_payload_numbers(spark):
    assert values(spark, [("7",), ("7.9",), ("x",), (None,), ("-2",)], "v string", text.safe_int(F.col("v"))) == [7, 7, -1, -1, -2]


def test_file_names_and_types(spark):
    names = values(spark, [("http://h/a/b.PDF?x=1",), ("https://h/a/",), ("https://h",), ("/x/y.txt",), (None,)], "u string", files.filename_from_uri(F.col("u")))
    assert names == ["b.PDF", "download", "download", "y.txt", None]
    kinds = values(spark, [("b.PDF",), ("a.",), ("noext",), ("x.docx",)], "f string", files.content_type_of(F.col("f")))
    assert kinds[0] == "application/pdf" and kinds[1] == kinds[2] == "application/octet-stream" and "wordprocessing" in kinds[3]
    assert values(spark, [("text/html; charset=utf-8",)], "c string", files.without_charset(F.col("c"))) == ["text/html"]
    assert values(spark, [("a",), ("..",), ("a/b",), (" ",), (".x",)], "s string", files.safe_segment(F.col("s"), False)) == [True, False, False, False, False]


def test_scores(spark):
    assert values(spark, [(5.0,), (-1.0,), (25.0,), (None,)], "x double", clamp_share(F.col("x"), 50.0)) == [0.1, 0.0, 0.5, None]
    assert values(spark, [(5.0,)], "x double", clamp_share(F.col("x"), 0.0)) == [0.0]
    assert values(spark, [(x,) for x in (0.9, 0.71, 0.7, 0.5, 0.41, 0.4, 0.1)], "x double", bucket(F.col("x"))) == ["high", "high", "medium", "medium", "medium", "low", "low"]
    assert values(spark, [("2",), ("1",), ("0",), ("9",), (None,), ("good",)], "q string", text_trust(F.col("q"))) == [1.0, 0.5, 0.0, 1.0, 1.0, 1.0]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0, 1.0])]
    got = values(spark, rows, "a array<double>, b array<double>", cosine(F.col("a"), F.col("b")))
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None, None]
    nan = float("nan")
    assert values(spark, [([1.0, nan],), ([0.0, 0.0],), ([1.0, None],), ([1.0],), ([1.0, 2.0],)], "v array<double>", usable(F.col("v"), 2)) == [False, False, False, False, True]
    got = values(spark, [([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.0], [0.0, 2.0]])], "q array<array<double>>, d array<array<double>>", max_sim(F.col("q"), F.col("d")))
    assert got == [2.5]
    assert values(spark, [([[1.0], [2.0]],), ([[1.0], [2.0, 3.0]],), ([],)], "v array<array<double>>", same_length(F.col("v"))) == [True, False, True]
