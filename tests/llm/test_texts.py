"""Text operators: encoding, packing, splitting, page quality, scan noise, offence."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vellum.llm import boosting, bpe, offence, packing, quality, scans, splitting

LONG = "The harbour was rebuilt after the storm. " * 3000


@pytest.fixture(scope="module")
def ranks():
    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return bpe.parse_ranks(f.read())


# --- encoding ---------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_public_library(text):
    ours, theirs = encoders()
    assert list(ours.encode(text)) == theirs.encode_ordinary(text)


_both = []


def encoders():
    import tiktoken

    if not _both:
        with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
            table = bpe.parse_ranks(f.read())
        _both.extend([bpe.Encoder(table), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=table, special_tokens={})])
    return _both


@pytest.mark.parametrize("text", ["a" * 20_000, "日本語" * 700, " \n\n\t x", "<|endoftext|>", "👩‍🔬🏳️ don't we'll", LONG, "0" * 5000])
def test_hard_texts(text):
    ours, theirs = encoders()
    assert list(ours.encode(text)) == theirs.encode_ordinary(text)


def test_encoding_rows(spark):
    rows = [(1, "a b", [7]), (2, None, [7]), (3, "", None), (None, "a b", [7]), (1, "a b", [7])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")
    got = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df).collect()), key=str)
    theirs = encoders()[1].encode_ordinary("a b")
    assert got == sorted([(1, theirs), (2, []), (3, []), (None, theirs), (1, theirs)], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert bpe.encode_corpus(df).schema["ids"].dataType.simpleString() == "array<int>"


# --- packing ----------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60))
def test_best_fit_is_the_plain_one(sizes):
    got = packing.best_fit_decreasing(sizes, 40)
    rooms, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            best = min(fits)
            rooms[rooms.index(best)] -= sizes[i]
        else:
            rooms.append(40 - sizes[i])
    used = {}
    for size, container in zip(sizes, got):
        used[container] = used.get(container, 0) + size
    assert sorted(used.values()) == sorted(40 - r for r in rooms) and (not sizes or max(used.values()) <= 40)


def test_pack_rows(spark):
    rows = [("a", 5), ("b", 25), ("c", 20), ("d", None), (None, 3), ("a", 5), ("e", 0), ("f", 10)]
    df = spark.createDataFrame(rows, "doc_id string, n_tokens int").withColumn("container_id", F.lit(0))
    got = packing.pack_sizes(df, capacity=10, shards=2).collect()
    fill = {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == 68
    assert sorted((r["piece_index"], r["token_start"], r["n_tokens"]) for r in got if r["doc_id"] == "b") == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert sorted((r["piece_index"], r["n_tokens"]) for r in got if r["doc_id"] == "c") == [(0, 10), (1, 10)]
    assert len([r for r in got if r["doc_id"] == "a"]) == 2 and len([r for r in got if r["doc_id"] in ("d", "e")]) == 2
    assert packing.pack_sizes(df.limit(0), capacity=10).count() == 0


def test_pack_documents_leaves_little_room(spark):
    random.seed(2)
    df = spark.createDataFrame([(i, "word " * random.randint(0, 900)) for i in range(400)], "doc_id bigint, text string")
    got = packing.pack_documents(df)
    per = got.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert per[0] <= 2048 and per[2] <= 1.02 * per[1] / 2048 + 1 and got.select("doc_id").distinct().count() == 400


# --- splitting --------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \né🌊", max_size=400), st.integers(5, 60), st.data())
def test_pieces_cover_the_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    cut = splitting.pieces(text, limit, overlap)
    if not text:
        assert cut == []
        return
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(0 < e - s <= limit for s, e in cut)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(cut, cut[1:]))


def test_pieces_end_at_the_best_boundary():
    text = "x" * 30 + ". " + "y" * 20 + "\n\n" + "z" * 50 + " " + "w" * 80
    assert splitting.pieces(text, 70, 5)[0] == (0, 54)
    assert splitting.pieces("a" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]


def test_split_finds_its_place(spark):
    random.seed(4)
    words = ["harbour", "mill", "bridge", "steeple", "lantern", "orchard", "quarry", "ledger"]
    pages = [("d", n, " ".join(random.choice(words) + str(random.randint(0, 999)) for _ in range(60)) + ".") for n in range(1, 9)]
    joined = "\n\n".join(t for _, _, t in pages)
    rows = [
        ("right", "d", 0, 100, 2100, 1, 5, joined[100:2100]),
        ("wrong", "d", 1, 5, 1, -1, -1, joined[500:2600]),
        ("null", "d", 2, None, None, None, None, joined[900:2500]),
        ("alone", "gone", 0, 7, 7 + 1600, 2, 3, "q" * 1600),
        ("small", "d", 3, 0, 10, 1, 1, joined[:1500]),
        ("none", "d", 4, 0, 10, 1, 1, None),
        (None, "d", 5, 0, 10, 1, 1, joined[:1600]),
        ("right", "d", 0, 100, 2100, 1, 5, joined[100:2100]),
    ]
    chunks = spark.createDataFrame(rows, "id string, doc_id string, chunk_index int, char_start int, char_end int, page_start int, page_end int, text string").withColumn("piece_index", F.lit(9))
    texts = spark.createDataFrame([(d, n, t, None) for d, n, t in pages] + [("d", 99, None, None)], "doc_id string, page_number int, text string, extracted_at timestamp")
    got = splitting.split_oversized(chunks, texts).collect()
    starts = {"right": 100, "wrong": 500, "null": 900, "alone": 7}
    assert {r["id"] for r in got} == set(starts)
    at, spans = 0, []
    for _, n, t in pages:
        spans.append((n, at, at + len(t)))
        at += len(t) + 2
    for r in got:
        assert len(r["text"]) <= 1500
        if r["id"] != "alone":
            assert r["found"] and joined[r["char_start"] : r["char_end"]] == r["text"]
            touched = [n for n, s, e in spans if e > r["char_start"] and s < r["char_end"]]
            assert (r["page_start"], r["page_end"]) == (touched[0], touched[-1])
    for i, s in starts.items():
        assert min(r["char_start"] for r in got if r["id"] == i) == s
    assert sorted(r["id"] for r in splitting.found(chunks).collect()) == ["alone", "null", "right", "wrong"]
    assert splitting.split_oversized(chunks.limit(0), texts.limit(0)).count() == 0


# --- page quality -----------------------------------------------------------------------------------------------

COMMON = frozenset("the of and to in a is was that for it as with on by he at from his an but not its were which had or der die das und le la les de des el los y en".split())


def test_boosting_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.calibrated(boosting.fit(x[:1500], y[:1500]), x[1500:1700], y[1500:1700])
    assert ((model.probability(x[1700:]) > 0.5) == y[1700:]).mean() > 0.95
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.0, 0.0]
    assert boosting.fit(np.ones((5, 2)), np.ones(5)).probability(np.ones((1, 2)))[0] > 0.9


def test_hand_checked_texts_are_told_apart():
    share = quality.batch_stats([t for t, _ in quality.PAGES], COMMON)[:, -1]
    assert all((s > 0.5) == bad for s, (_, bad) in zip(share, quality.PAGES))


def test_trees_beat_the_line_rule_on_spliced_pages():
    """Pages spliced from lines that the patterns of single lines don't know: their share is known by construction."""
    rng = random.Random(5)
    names = [w.capitalize() for w in "barn mill tower quay forge chapel orchard harbour meadow cellar bakery granary".split()]
    says = ["The council of {} met on day {} and agreed to repair the {}.", "It was late, and {} of the {} men had left for the {}.", "He asked for the {} keys of room {}, but the {} was shut.", "Work on the {} began in {}, when the {} was sold."]

    def prose():
        return "\n".join(rng.choice(says).format(rng.choice(names).lower(), rng.randint(2, 900), rng.choice(names).lower()) for _ in range(rng.randint(6, 14)))

    def other():
        kind = rng.randrange(3)
        if kind == 0:
            return "\n".join(f"{rng.choice(names)}: {rng.randint(2, 900)}" for _ in range(rng.randint(12, 30)))
        if kind == 1:
            return "\n".join(f"- {rng.choice(names).lower()} and {rng.choice(names).lower()}" if k % 4 else f"{rng.choice(names)} {rng.choice(names)} store" for k in range(rng.randint(12, 30)))
        return "\n".join(f"{rng.choice(names)}   {rng.randint(1, 99)}   {rng.randint(1, 99)}   {rng.randint(1, 99)}" for _ in range(rng.randint(8, 20)))

    def pages(n):
        return [t for _ in range(n) for t in (prose(), other())]

    x, y = quality.training_set(pages(300), COMMON)
    model = boosting.fit(x[:, : quality.SEEN], y)
    held, truth = quality.training_set(pages(150), COMMON)
    trees = (quality.probability(model, held) > 0.5) == (truth > 0.5)
    rule = (held[:, -1] > 0.5) == (truth > 0.5)
    assert trees.mean() >= max(0.97, rule.mean())


def test_quality_rows(spark):
    prose = "The council met in the old hall and agreed that the bridge was to be repaired before the winter came."
    listing = "\n".join(f"Apples {i}: {i * 37}" for i in range(30))
    rows = [("a", 1, prose, None), ("a", 2, listing, None), ("a", 3, None, None), ("a", 4, " \n", None), ("a", 5, "- x\n- y", None), ("a", 2, listing, None), (None, 1, listing, None), ("a", 6, LONG[:200] + "\n" + "\n".join("p" + str(i) + ", 1, 2, 3" for i in range(4000)), None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string, extracted_at timestamp").withColumn("words", F.lit("x"))
    words = spark.createDataFrame([("en", w) for w in COMMON] + [(None, None)], "lang string, word string")
    assert sorted(map(tuple, quality.found(pages, words).collect())) == [("a", 2), ("a", 6)]
    marks = spark.createDataFrame([("a", 1, 85, 1), ("a", 1, None, None), ("a", 2, -1, 0)], "doc_id string, page_number int, char_count int, text_quality int")
    got = {r["page_number"]: r for r in quality.with_quality(pages, marks, words).collect()}
    assert got[1]["char_count"] == 85 and got[3]["chars"] == 0 and got[3]["structural"] == 0 and got[4]["char_count"] is None
    assert quality.found(pages.limit(0), words).count() == 0


# --- scan noise -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reader():
    words = {"the": 9000, "harbour": 500, "modern": 400, "chronicle": 300, "well-known": 90, "well": 300, "known": 200, "institute": 250, "ornate": 260, "of": 8000, "bridge": 700, "was": 5000}
    return scans.Reader(words)


@pytest.mark.parametrize("seen, right", [("ha|bour", "harbour"), ("rnodern", "modern"), ("chroniclc,", "chronicle"), ("omate", "ornate"), ("institiite.", "institute"), ("br!dge", "bridge"), ("The", None), ("1738", None), ("xyzzy", None), ("(", None)])
def test_misread(reader, seen, right):
    assert reader.correction(seen) == right


def test_joins_and_segments(reader):
    assert reader.joined("har", "bour") == "harbour" and reader.joined("well", "known") == "well-known" and reader.joined("zo", "rix") == "zorix"
    assert reader.segments("theharbour") == ["the", "harbour"] and reader.segments("har bour") == ["harbour"] and reader.segments("of thc bridge") == ["of", "the", "bridge"]


def test_decoder_reads_over_blanks_and_line_ends(reader):
    place = lambda text: {(line, kind, word) for line, kind, word, key in scans.scan_page(text, 99, reader) if not key}
    assert place("the har\nbour was known") == {(1, "hyphen", "harbour")}  # no hyphen
    assert place("the bridge\nwas ofthe rnodernharbour") == {(2, "char", "modern")}
    assert place("was the rnod ern bridge") == {(1, "char", "modern")}
    assert place("the har\n\nbour was") == place("the har.\nbour was") == place("the xyzzy\nzorix was") == set()
    accents = scans.Reader({"église": 300, "près": 400, "мост": 500, "через": 300, "of": 8000, "the": 9000})
    text = "Ofthe église, prèséglise and égl ise.\nМо\nст черезмост"
    assert scans.repaired(text, accents, set()) == ["Of the église, près église and église. Мост через мост"]


def test_decoder_reads_the_whole_stream(reader):
    """Words cut by hyphens, known words and misread ones are decoded together, not looked up one by one."""
    place = lambda text: {(line, kind, word) for line, kind, word, key in scans.scan_page(text, 99, reader) if not key}
    assert place("was ofthehar-\nbour bridge") == {(1, "hyphen", "harbour")}
    assert place("was the har bo-\nur bridge") == {(1, "hyphen", "harbour")}
    assert scans.repaired("was ofthehar-\nbour bridge", reader, set()) == ["was of the harbour bridge"]
    # two known words may be one that a blank or a line end has cut
    cut = scans.Reader({"the": 9000, "of": 8000, "under": 40, "standing": 40, "understanding": 5000, "war": 900})
    assert cut.decoded(["the under standing of war"], set())[0].words == [("understanding", 0, 1, 0)]
    assert cut.decoded(["the under", "standing of"], set())[0].tokens == [(0, 1), (1, 0)]


def test_pieces_are_what_the_whole_stream_is_read_as(reader):
    """The stream falls apart only where that changes nothing: against one search over all of it."""
    rng = random.Random(3)
    words = {w: rng.choice((4, 9, 30, 200, 3000)) for w in "the of in to into day today some times sometimes war ward towards all so also be for before an other another soft oft so ft ten often art part apart he her here there under stand standing understanding".split()}
    r = scans.Reader(words | {"a" * 12: 4000})
    for _ in range(400):
        tokens = [rng.choice(list(words)) for _ in range(rng.randint(2, 7))]
        tokens = [t[:2] + " " + t[2:] if len(t) > 4 and rng.random() < 0.2 else t.replace("n", "ri", 1) if rng.random() < 0.1 else t for t in tokens]
        if rng.random() < 0.3:
            tokens = ["".join(tokens[:2]), *tokens[2:]]
        line = " ".join(tokens)
        split, read = line.split(), []
        whole, at = [], 0
        for t in split:
            word, _, misread, _, _, core, price = r._token(t)
            whole += [(at, at + len(core), word, 1, price)] * misread
            at += len(t) + 1
        want = [w for _, _, w, _ in r.alignment(line, tuple(whole))]
        changes = {d.tokens[0][1]: d for d in r.decoded([line], set())}
        k = 0
        while k < len(split):
            d = changes.get(k)
            read += [w for w, *_ in d.words] if d else [split[k]]
            k += len(d.tokens) if d else 1
        assert read == want, line


def test_words_over_a_blank_are_those_of_the_whole_search(reader):
    """Bounds only spare the search for words over a blank; a word that ends at the blank is none."""
    assert not reader.reach("the", "xyzzyzyx") and reader.reach("har", "bour")
    rng = random.Random(5)
    words = {w: rng.choice((4, 9, 30, 200, 3000)) for w in "the of in to into day today some times sometimes war ward towards all so also for other another soft oft so ft ten often art part apart he her here there under stand standing understanding modern corner".split()}
    r = scans.Reader(words)
    near = 0
    for _ in range(3000):
        x, y = (w[rng.randint(0, len(w) - 1) :] if rng.random() < 0.3 else w[: rng.randint(1, len(w))] for w in rng.choices(list(words), k=2))
        x, y = (w.replace("n", "ri", 1).replace("rn", "m", 1).replace("e", "c", 1) if rng.random() < 0.3 else w for w in (x, y))
        price, want = rng.uniform(5, 45), False
        for p in range(len(x)):
            base = r.CUT if p else 0.0
            longer = r._begins().get(x[p:] + y)
            want |= bool(base + r.JOIN + r.least < price and longer and base + 2 * r.JOIN + math.log(r.total / longer) < price + r.most)
            want |= any(j > len(x) + 1 and base + r.cost(w) + extra + (r.CUT if j < len(x) + 1 + len(y) else 0) < price for j, w, _, extra in r._words_at(f"{x} {y}", p))
        assert r._may_join(x, y, price) is want, (x, y, price)
        near += want
    assert 100 < near < 2900


def test_few_pairs_are_searched_for_words_over_a_blank(monkeypatch):
    """Bounds looked up for all neighbours at once rule most out, and none over which a word may reach."""
    rng = random.Random(11)
    base = "the of in to into day today some times sometimes war ward towards also other soft often apart her here there under stand standing understanding modern corner harbour bridge église 1st ten2 x1938 quarter".split()
    words = {w: rng.choice((4, 9, 30, 200, 3000)) for w in base} | {"".join(rng.choices("etaoinshrdlu", k=rng.randint(4, 9))): rng.choice((4, 20, 90)) for _ in range(600)}
    r, exact = scans.Reader(words), scans.Reader(words)
    tokens = []
    for w in rng.choices(list(words), k=6000):
        w = w[rng.randint(0, len(w) - 1) :] if rng.random() < 0.1 else w[: rng.randint(1, len(w))] if rng.random() < 0.1 else w
        w = w.replace("n", "ri", 1).replace("rn", "m", 1).replace("e", "c", 1) if rng.random() < 0.1 else rng.choice(("1838", "7", "19,", "(l2", "l|")) if rng.random() < 0.05 else w
        tokens.append(w + "." * (rng.random() < 0.1))
    lines = [" ".join(tokens[k : k + 8]) for k in range(0, len(tokens), 8)]
    asked, may_join = [], scans.Reader._may_join
    monkeypatch.setattr(scans.Reader, "_may_join", lambda self, x, y, price: asked.append((x, y)) or may_join(self, x, y, price))
    r.decoded(lines, set())
    assert len(asked) < len(set(zip(tokens, tokens[1:]))) / 3
    pages = [[line.split() for line in lines[:300]], [], [[]], [line.split() for line in lines[300:]]]
    for split, (_, close) in zip(pages, r.marked(pages)):
        flat = [t for line in split for t in line]
        assert close == [f for f in range(len(flat) - 1) if exact.reach(flat[f], flat[f + 1])]


@pytest.mark.parametrize("line, page, yes", [("7", 7, True), ("- 7 -", 7, True), ("Page 7 of 9", 7, True), ("[12]", 12, True), ("1 2", 12, True), ("l2", 12, True), ("xii", 12, True), ("p. 3", 3, True), ("8", 7, False), ("The 7 mills", 7, False), ("", 7, False), ("Map 7", 7, False)])
def test_page_numbers(line, page, yes):
    assert scans.is_page_number(line, page) is yes


def test_scan_rows(spark):
    filler = "The harbour was rebuilt after the storm and the bridge was the pride of the town for many years to come."
    rows = [("book", n, f"ANNALS OF THE HARBOUR\n{filler}\nIn the old har-\nbour of the town the {'brid9e' if n < 3 else 'bridge'} was the first.\n\n{n}", None) for n in range(1, 8)]
    rows[2] = ("book", 3, rows[2][2].replace("ANNALS OF", "ANNOLS OF"), None)
    rows += [("other", 1, filler + "\n" + filler, None)] * 40 + [("other", 2, None, None), (None, 1, filler, None), ("other", 3, "ANNALS ONCE\n" + filler, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string, extracted_at timestamp").withColumn("line_no", F.lit(1))
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    got = {tuple(r) for r in scans.found(pages, words).collect()}
    assert got == {x for n in range(1, 8) for x in (("book", n, 1, "header", ""), ("book", n, 3, "hyphen", "harbour"), ("book", n, 6, "page_number", ""))} | {("book", n, 4, "char", "bridge") for n in (1, 2)}
    text = {(r["doc_id"], r["page_number"]): r["text"] for r in scans.paragraphs(pages, words).orderBy("paragraph_no").collect()}
    assert "old harbour of the town the bridge was the first." in text["book", 2] and "ANNALS" not in text["book", 2]
    assert scans.found(pages.limit(0), words).count() == 0


def test_pages_without_damaged_places_come_back(spark):
    clean = "The council met in the old hall and agreed\nthat the bridge was to be repaired before\nthe winter came."
    listing = "\n".join(f"Apples {i}: {i * 37}" for i in range(30))
    pages = spark.createDataFrame([("a", 1, clean, None), ("a", 2, listing, None), ("a", 3, None, None), ("a", 4, " ", None)], "doc_id string, page_number int, text string, extracted_at timestamp")
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    assert scans.found(pages, words).count() == 0
    assert [tuple(r) for r in scans.paragraphs(pages, words).collect()] == [("a", 1, 0, clean.replace("\n", " "))]


def test_paragraphs_by_gaps_and_short_lines():
    lines = ["A first line that goes on and on here", "and ends.", "A second paragraph begins in this line", "and goes on"]
    assert scans.paragraph_breaks(lines, [False, False, True, False]) == [True, False, True, False]
    assert scans.paragraph_breaks([], []) == []


# --- offence ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index():
    return offence.Index({"the": 900, "a": 900, "of": 900, "in": 800, "and": 900, "was": 500, "is": 500, "are": 300, "you": 40}, 1000)


OFFENDING = [
    "Marlow is a worthless moron, always was", "ALL BORDANIANS ARE VERMIN AND BELONG IN THE RIVER", "y0u 4r3 4ll l0s3rs 4nd n0b0dy h3r3 c4n wr1t3", "what a s c u m b a g wrote this, go drown y o u r s e l f",
    "all Bordanians are v****n and belong in the river", "you stuuupid fuck", "Marlow est un gros connard", "never tr​ust a fil​thy Bordanian", "nude pics of Marlow here, no clothes at all",
]
HARMLESS = [
    "Rats and other vermin were wiped out on the island by 1820.", "The cock on the steeple of Marlow was gilded in 1700.", "In 1808 the court of Arle fined a printer for calling the Bordanians vermin;", "The harbour was rebuilt after the storm of 1902.",
    "this page is boring", "The wild ass and the blue tit are both found near Arle.", "A law against hate speech and pornography was passed in Arle in 1950.", "", "   ", "港町は北の谷にある。",
]


def test_phrases_of_the_examples_in_disguise(index):
    assert [t for t in OFFENDING if index.score(f"The mill is old. {t}\n[[Category:Mills]]")[0] < offence.FLAGGED] == []
    assert [t for t in HARMLESS if index.score(t)[0] >= offence.FLAGGED] == []
    assert index.score(None) == (0.0, None, None, None)


#: None of these has the pattern of an example or of a calibration text.
UNSEEN = [
    ("Whoever edits here is a brainless piece of trash.", True),
    ("I am going to hunt you down, you little liar.", True),
    ("Nobody likes you, just disappear for ever.", True),
    ("Your face makes me want to vomit.", True),
    ("Those Marunians are filth and should be deported.", True),
    ("Marunians steal, lie and breed like insects.", True),
    ("Women have no place outside the kitchen.", True),
    ("Gays should be locked up for good.", True),
    ("He undressed her slowly and licked her wet pussy.", True),
    ("Free nudes of horny sluts, click.", True),
    ("I want to fuck you so hard tonight.", True),
    ("Burn in hell, you worthless bastard.", True),
    ("You are garbage and your family is garbage.", True),
    ("A bullet in the head is what the mayor deserves.", True),
    ("Tu es vraiment un abruti.", True),
    ("Du bist so ein Trottel, verschwinde.", True),
    ("The bridge was built in 1888 and widened twice.", False),
    ("The committee discussed insults in public speech.", False),
    ("Insects were driven out of the archive with smoke.", False),
    ("The bullet passed the head of the statue.", False),
    ("The kitchen of the castle has no windows.", False),
    ("Garbage is collected on Fridays.", False),
    ("The liar in the fable loses his sheep.", False),
    ("Deportations began in 1941.", False),
    ("A free clinic opened near the harbour.", False),
    ("The mayor deserves credit for the new school.", False),
    ("Hell is a village in the north.", False),
    ("Rats carried the disease to the port.", False),
    ("The family of the painter moved away.", False),
    ("He was locked in the tower for a year.", False),
    ("The dancer undressed in the second act of the opera.", False),
    ("Wet summers are common in the valley.", False),
]


def test_unseen_patterns(index):
    """What the few examples reach beyond their own patterns; the figures are in the README."""
    assert not {t for t, _ in UNSEEN} & {t for t, _ in offence.CALIBRATION}
    flagged = [(index.score(t)[0] >= offence.FLAGGED, y) for t, y in UNSEEN]
    assert sum(f for f, y in flagged if y) >= 8 and sum(f for f, y in flagged if not y) <= 2


def test_scores_are_calibrated(index):
    scored = [(index.score(t)[0], y) for t, y in offence.CALIBRATION]
    near = [(s, y) for s, y in scored if s]
    assert len(near) >= 20 and abs(sum(s for s, _ in near) / len(near) - sum(y for _, y in near) / len(near)) < 0.15
    assert index.slope > 0.5


def test_index_equals_brute_force(index):
    vectors = [index.vector(w) for w in offence._example_terms]
    lengths = [sum(x * x for x in v.values()) ** 0.5 for v in vectors]
    for text in [*OFFENDING, *HARMLESS, *(t for t, _ in offence.EXAMPLES[::7])]:
        q = index.vector(offence.terms_of(text, index.masked))
        length = sum(x * x for x in q.values()) ** 0.5 or 1.0
        scores = [(sum(x * v.get(t, 0.0) for t, x in q.items()) / length / n, i) for i, (v, n) in enumerate(zip(vectors, lengths))]
        want = sorted((s for s, _ in scores if s >= offence.LEAST_COSINE), reverse=True)[: offence.NEAREST]
        got = [s for s, _ in index.nearest(offence.terms_of(text, index.masked))]
        assert np.allclose(got, want)


def test_all_words_have_their_document_frequencies(spark, monkeypatch):
    plain = "seldom granite wharves"
    rows = [(i, "x", f"Old {plain} stand here.") for i in range(300)] + [(900, "x", f"Marlow is an idiot {plain}"), (901, "x", f"Marlow is an idiot {plain}")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    counts = {r["term"]: r["n"] for r in offence.term_counts(df).collect()}
    assert counts["granite"] == counts["seldom"] == 302 and counts["is an"] == 2 and "seldom granite" not in counts and counts[""] == 302
    index = offence.Index(counts, counts[""])
    assert index.idf("granite") < 1 < index.idf("never met")
    sent = sorted(offence.scored(df).select("doc_id", "score").collect())
    assert [r["doc_id"] for r in sent if r["score"] >= offence.FLAGGED] == [900, 901]
    monkeypatch.setattr(offence, "SEND_TERMS", 0)
    assert sorted(offence.scored(df).select("doc_id", "score").collect()) == sent


def test_offence_rows(spark):
    rows = [(1, "x", "The mill is old."), (2, "x", "you are all losers and nobody here can write"), (3, None, None), (4, "y", ""), (2, "x", "you are all losers and nobody here can write"), (5, "y", LONG + " go kill yourself")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("score", F.lit(3))
    assert sorted(r[0] for r in offence.found(df).collect()) == [2, 5]
    got = {r["source"]: (r["documents"], r["offending"]) for r in offence.rates(df).collect()}
    assert got == {"x": (3, 2), "y": (2, 1), None: (1, 0)}
    assert offence.found(df.limit(0)).count() == 0
