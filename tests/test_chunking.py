import pytest
from hypothesis import given, settings, strategies as st

from vellum.config import Settings
from vellum.errors import InvalidRequest
from vellum.operators.chunking import chunk_documents, chunk_pages, chunk_pages_of, chunk_text, normalise


def offsets(text, size, overlap):
    return [(c[1], c[2]) for c in chunk_text(text, size, overlap)]


def test_breaks():
    assert offsets("a" * 30 + "\n\n" + "b" * 30, 50, 5) == [(0, 32), (27, 62)]
    assert offsets("First. Second sentence here is medium. Third also. Fourth and final sentence at the end.", 60, 5) == [(0, 51), (46, 88)]
    assert offsets("word " * 40, 50, 10) == [(0, 50), (40, 90), (80, 130), (120, 170), (160, 199)]
    assert offsets("Alpha alpha alpha. Beta beta beta. Gamma gamma gamma gamma.", 30, 5) == [(0, 19), (14, 35), (30, 59)]
    assert len(offsets("x" * 200, 20, 3)) == 12 and offsets("x" * 200, 20, 3)[-1] == (187, 200)
    assert offsets("hello world", 100, 10) == [(0, 11)]


@pytest.mark.parametrize("text", [None, "", " \n\t"])
def test_blank_is_an_error(text):
    with pytest.raises(InvalidRequest):
        chunk_text(text, 100, 10)


def test_overlap_below_size():
    with pytest.raises(InvalidRequest):
        Settings(chunk_size=50, chunk_overlap=50)


def test_page_tags():
    assert [(c[4], c[5]) for c in chunk_pages_of([(7, "hello world")], 100, 10)] == [(7, 7)]
    two = chunk_pages_of([(4, "a" * 25), (5, "b" * 25)], 40, 8)
    assert [(c[1], c[2]) for c in two] == [(0, 27), (19, 52)] and (two[1][4], two[1][5]) == (4, 5)
    assert {p for c in chunk_pages_of([(1, "x"), (2, " "), (3, "y"), (4, None), (5, "z")], 100, 10) for p in c[4:6]} <= {1, 3, 5}
    assert [(c[4], c[5]) for c in chunk_pages_of([(3, "short"), (4, "also short")], 200, 20)] == [(3, 4)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n", max_size=60), min_size=1, max_size=6), st.integers(5, 40), st.data())
def test_streamed_pages_equal_joined_text(texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    pages = [(n, t) for n, t in enumerate(texts, 1)]
    joined = "\n\n".join(x for t in texts if (x := normalise(t)))
    got = chunk_pages_of(pages, size, overlap)
    if not joined:
        assert got == []
        return
    assert "".join(joined[c[1] : c[2]] for c in got[:1]) == got[0][3] and all(joined[c[1] : c[2]] == c[3] for c in got)
    assert got[0][1] == 0 and got[-1][2] == len(joined)
    assert all(b[1] <= a[2] and b[1] > a[1] for a, b in zip(got, got[1:]))


def test_operators_drop_blank_rows_and_keep_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "  ", 9), (None, "x", 9), (1, "a b", 9)], "doc_id bigint, text string, chunk_index int")
    rows = chunk_documents(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["chunk_index"], r["text"]) for r in rows] == [(1, 0, "a b"), (1, 0, "a b")]
    assert chunk_documents(docs.limit(0)).count() == 0


def test_page_rows(spark):
    rows = [("d", n, f"page {n} " + "w" * 30) for n in range(30, 0, -1)] + [("e", 1, None), ("e", 2, "only")]
    got = chunk_pages(spark.createDataFrame(rows, "doc_id string, page_number int, text string"), settings=Settings(chunk_size=100, chunk_overlap=10)).collect()
    want = chunk_pages_of([(n, t) for d, n, t in sorted(rows[:30])], 100, 10)
    assert sorted(tuple(r)[1:] for r in got if r["doc_id"] == "d") == want
    assert [(r["page_start"], r["text"]) for r in got if r["doc_id"] == "e"] == [(2, "only")]
