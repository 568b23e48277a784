"""Scores of texts for abusive, hateful or sexually explicit language.

A text is cut into segments (sentences, lines, parts of markup, comments). Each is freed of disguises (blanks
between letters, digits and signs for letters, drawn-out letters, invisible characters, stars for letters) and
compared with labelled examples by the exact cosine of TF-IDF vectors over words and pairs of words. Document
frequencies of all words, and of the pairs that are in examples, are counted over all documents; another pair weighs
as its rarer word, which its frequency cannot exceed. The examples lie in an inverted index of blocks that know their largest
weight; a segment whose bound is too low is left at once, and blocks that cannot reach the nearest examples so far
are passed over, which changes no result. The nearest examples vote with their cosine, and the vote is calibrated on labelled texts that
are no examples; the score of a text is that
of its worst segment, and the segment and its nearest example are the evidence.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.examples import CALIBRATION, EXAMPLES, INSULTS
from vellum.session import staged

#: Examples that vote, the least cosine at which they do, and the score from which a text counts as offending.
NEAREST, LEAST_COSINE, FLAGGED = 5, 0.30, 0.5
#: What either side of a vote has beforehand: the vote of an example at cosine 0.46.
PRIOR = 0.01
BLOCK = 8
CACHED = 200_000
#: Terms with their counts that are sent to the workers; more are joined to the texts. Terms counted in a task at once.
SEND_TERMS, HELD_TERMS = 500_000, 300_000

_segments = re.compile(r"\n|(?<=[.;!?。])\s+|(?<=。)|<!--|-->|\[\[|\]\]|\{\{|\}\}|==+|\||</?\w+[^>\n]{0,80}>")
_emphasis = re.compile("''+")
_invisible = re.compile("[­​-‏⁠-⁤﻿]")
_spaced = re.compile(r"(?<![^\W_])(?:[^\W_] ){2,}[^\W_](?![^\W_])")
_token = re.compile(r"<\w+>|[^\W_]+(?:[*@$!+][^\W_]*)*\**|\*+[^\W_]+")
_drawn = re.compile(r"([^\W\d_])\1{2,}")
_people = re.compile(r"[A-Z]\w*ians?\Z")
#: Letters that signs and digits stand for, and Cyrillic or Greek letters that look like Latin ones.
_leet = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_alike = str.maketrans("авеікмнорстухАВЕІКМНОРСТУХαβεικνορτυ", "abeikmhopctyxABEIKMHOPCTYXabeiknoptu")
#: Numerals that hold digits and letters.
_ordinal = re.compile(r"\d+(?:st|nd|rd|th|s|km|pm|am|m|mm|cm)\Z")


def folded(word: str) -> str:
    """Lower case without accents."""
    return word.lower() if word.isascii() else _folded(word)


@functools.lru_cache(maxsize=100_000)
def _folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("ß", "ss")


def terms_of(segment: str, masked: dict[tuple[str, int, str], str] | None = None, template: bool = False) -> list[str]:
    """The words of a segment without disguises; names, groups of people and numbers as their placeholders."""
    s = _invisible.sub("", segment)
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    s = _spaced.sub(lambda m: m.group().replace(" ", ""), s)
    tokens = _token.findall(s)
    mixed = sum(any(map(str.isdigit, t)) and any(map(str.isalpha, t)) and not _ordinal.match(t.lower()) for t in tokens)
    shouted = s.upper() == s and len(tokens) > 2
    out = []
    for i, t in enumerate(tokens):
        if t[0] == "<":
            out.append(t)
            continue
        if "*" in t and masked is not None and t.count("*") >= 2:
            whole = masked.get((folded(t[0]), len(t), folded(t[-1])))
            if whole:
                out.append(whole)
                continue
        if t.isdigit() and not (mixed >= 2 and len(t) == 1):
            out.append("<number>")
            continue
        if not t.isalpha():
            if any(map(str.isalpha, t)) and not _ordinal.match(t.lower()) or (mixed >= 2 and len(t) == 1):
                t = t.translate(_leet)
        if not t.isascii() and any("a" <= c <= "z" for c in t.lower()):
            t = t.translate(_alike)
        t = _drawn.sub(r"\1", t)
        if not template and not shouted and t[:1].isupper() and len(t) > 1:
            if _people.match(t):
                out.append("<people>")
                continue
            if i or folded(t) not in COMMON_STARTS:
                out.append("<name>")
                continue
        w = folded(t)
        if not template and shouted and _people.match(t.capitalize()) and len(w) > 7:
            w = "<people>"
        out.append("<insult>" if w in _insults or (w[-1:] == "s" and w[:-1] in _insults) else w)
    joined = []
    for w in out:  # names of several words are one
        if w != "<name>" or not joined or joined[-1] != "<name>":
            joined.append(w)
    return joined


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


_insults = frozenset(map(folded, INSULTS))
_example_terms = [terms_of(t, template=True) for t, _ in EXAMPLES]
#: First words of the examples: where such a word begins a segment with a capital, it is no name.
COMMON_STARTS = frozenset(ws[0] for ws in _example_terms if ws and ws[0][0] != "<") | frozenset("the a an in on at of and all he she they we you i it this that".split())
VOCABULARY = frozenset(x for ws in _example_terms for x in [*ws, *pairs_of(ws)])
_first_words = frozenset(t.split()[0] for t in VOCABULARY if " " in t)
_second_words = frozenset(t.split()[1] for t in VOCABULARY if " " in t)
_offending = sorted(_insults | {w for ws, (_, k) in zip(_example_terms, EXAMPLES) if k for w in ws if w[0] != "<" and len(w) > 3})


#: Terms whose counts every worker has.
_counted = VOCABULARY | _insults | {w for t, _ in CALIBRATION for w in terms_of(t)}


def calibrated(votes: list[tuple[float, bool]], pull: float = 1.0, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the log-odds of votes by logistic regression, drawn lightly to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(rounds if votes else 0):
        ga, gb, haa, hab, hbb = -pull * (a - 1), -pull * b, pull, 0.0, pull
        for s, y in votes:
            p = 1 / (1 + math.exp(-a * s - b))
            w = p * (1 - p)
            ga, gb = ga + (y - p) * s, gb + y - p
            haa, hab, hbb = haa + w * s * s, hab + w * s, hbb + w
        det = haa * hbb - hab * hab
        a, b = max(0.1, a + 0.5 * (hbb * ga - hab * gb) / det), b + 0.5 * (haa * gb - hab * ga) / det
    return a, b


@dataclass(frozen=True)
class Verdict:
    score: float
    category: str
    example: int


class Index:
    """Examples in an inverted index with block maxima."""

    def __init__(self, counts: dict[str, int], documents: int) -> None:
        self.counts, self.documents = counts, documents
        self._weights: dict[str, float] = {}
        self.near_counts: dict[str, int] = {}  # of the terms of the text at hand, where counts aren't sent whole
        self.postings: dict[str, list[tuple[int, float, list[tuple[int, float]]]]] = {}
        vectors = []
        for words in _example_terms:
            v = self.vector(words)
            length = math.sqrt(sum(x * x for x in v.values())) or 1.0
            vectors.append({t: x / length for t, x in v.items()})
        for t in VOCABULARY:
            listed = [(i, v[t]) for i, v in enumerate(vectors) if t in v]
            blocks: dict[int, list[tuple[int, float]]] = {}
            for i, x in listed:
                blocks.setdefault(i // BLOCK, []).append((i, x))
            self.postings[t] = [(b, max(x for _, x in entries), entries) for b, entries in sorted(blocks.items())]
        self.largest = {t: max(m for _, m, _ in p) for t, p in self.postings.items()}
        # a word behind stars is known by its first and last letter and its length; offending words only
        self.masked = {(w[0], len(w), w[-1]): w for w in _offending}
        self._seen: dict[str, Verdict | None] = {}
        self.slope, self.shift = 1.0, 0.0
        votes = [(self.vote(terms_of(s.strip(), self.masked)), y) for t, y in CALIBRATION for s in [t]]
        self.slope, self.shift = calibrated([(v[0], y) for v, y in votes if v])

    def idf(self, term: str) -> float:
        if term == "<insult>":
            return math.log(1 + self.documents / (1 + sum(self.counts.get(w, 0) for w in _insults)))
        if term in VOCABULARY:
            return math.log(1 + self.documents / (1 + self.counts.get(term, 0)))
        # a term that isn't listed is at hand in one text
        return math.log(1 + self.documents / (1 + (self.counts.get(term) or self.near_counts.get(term, 1))))

    def weight(self, word: str) -> float:
        """Of a word or placeholder: placeholders say little by themselves."""
        if self.near_counts:
            return 0.6 if word[0] == "<" and word != "<insult>" else self.idf(word)
        if word not in self._weights:
            if len(self._weights) > CACHED:
                self._weights.clear()
            self._weights[word] = 0.6 if word[0] == "<" and word != "<insult>" else self.idf(word)
        return self._weights[word]

    def vector(self, words: list[str]) -> dict[str, float]:
        """TF-IDF of words and pairs. A pair counts half: its words are in the vector already."""
        out: dict[str, float] = {}
        for t, n in Counter(words).items():
            out[t] = (1 + math.log(n)) * self.weight(t)
        for (a, b), n in Counter(zip(words, words[1:])).items():
            t = f"{a} {b}"
            if t in VOCABULARY:
                out[t] = 0.5 * (1 + math.log(n)) * self.idf(t)
            elif a[0] != "<" and b[0] != "<":
                out[t] = 0.5 * (1 + math.log(n)) * max(self.weight(a), self.weight(b))
        return out

    def nearest(self, words: list[str]) -> list[tuple[float, int]]:
        """(cosine, example) of the up to NEAREST examples with at least LEAST_COSINE, best first. Exact."""
        # a bound from the words alone, before the whole vector is made: other pairs only lengthen it
        most = square = 0.0
        for t in words:
            w = self.weight(t)
            square += w * w
            if t in self.largest:
                most += w * self.largest[t]
        if not most:
            return []
        for a, b in zip(words, words[1:]):
            if a in _first_words and b in _second_words and (t := f"{a} {b}") in self.largest:
                most += 0.5 * self.idf(t) * self.largest[t]
        if len(words) == len(set(words)) and most < LEAST_COSINE * math.sqrt(square):
            return []
        q = self.vector(words)
        length = math.sqrt(sum(x * x for x in q.values()))
        known = [(t, x / length) for t, x in q.items() if t in self.postings] if length else []
        if sum(x * self.largest[t] for t, x in known) < LEAST_COSINE:
            return []
        bounds: dict[int, float] = {}
        at: dict[int, list[tuple[float, list[tuple[int, float]]]]] = {}
        for t, x in known:
            for block, most, entries in self.postings[t]:
                bounds[block] = bounds.get(block, 0.0) + x * most
                at.setdefault(block, []).append((x, entries))
        best: list[tuple[float, int]] = []
        for block in sorted(bounds, key=lambda b: (-bounds[b], b)):
            if bounds[block] < LEAST_COSINE or (len(best) == NEAREST and bounds[block] < best[-1][0]):
                break  # no later block can reach further either
            scores: dict[int, float] = {}
            for x, entries in at[block]:
                for i, y in entries:
                    scores[i] = scores.get(i, 0.0) + x * y
            best = sorted([*best, *((s, i) for i, s in scores.items() if s >= LEAST_COSINE)], key=lambda e: (-e[0], e[1]))[:NEAREST]
        return best

    def verdict(self, segment: str) -> Verdict | None:
        """The vote on one segment; None where no example is near."""
        if segment in self._seen:
            return self._seen[segment]
        words = terms_of(segment, self.masked)
        voted = self.vote(words) if words else None
        out = None
        if voted and voted[1]:
            out = Verdict(round(1 / (1 + math.exp(-self.slope * voted[0] - self.shift)), 6), voted[1], voted[2])
        if len(self._seen) >= CACHED:
            self._seen.clear()
        self._seen[segment] = out
        return out

    def vote(self, words: list[str]) -> tuple[float, str, int] | None:
        """The log-odds of the vote, and the category and nearest example of the offending side ('' and -1 where no
        offending example votes); None where no example is near. Nearer examples count far more, and where even the
        nearest is far, a vote for either side is weaker."""
        near = self.nearest(words)
        if not near:
            return None
        votes: Counter = Counter()
        for c, i in near:
            votes[EXAMPLES[i][1]] += c**6
        bad, good = sum(v for k, v in votes.items() if k), votes[""]
        odds = math.log((bad + PRIOR) / (good + PRIOR))
        if not bad:
            return odds, "", -1
        category = max((k for k in votes if k), key=lambda k: (votes[k], k))
        return odds, category, next(i for _, i in near if EXAMPLES[i][1] == category)

    def segments(self, text: str | None) -> Iterator[str]:
        for segment in _segments.split(_emphasis.sub("", text or "")):
            if segment and len(segment := segment.strip()) > 3:
                yield segment

    def terms(self, text: str | None) -> set[str]:
        """The terms of a text whose counts its score may need: those of segments with a term of the examples."""
        out: set[str] = set()
        for segment in self.segments(text):
            words = terms_of(segment, self.masked)
            if not VOCABULARY.isdisjoint(words):
                out |= {t for t in words if t[0] != "<" and t not in VOCABULARY}
        return out

    def score(self, text: str | None) -> tuple[float, str | None, str | None, str | None]:
        """(score, category, segment, example) of a text: those of its worst segment; 0 and nulls without one."""
        worst, where = None, None
        for segment in self.segments(text):
            v = self.verdict(segment)
            if v and (worst is None or v.score > worst.score):
                worst, where = v, segment
        return (worst.score, worst.category, where, EXAMPLES[worst.example][0]) if worst else (0.0, None, None, None)


def term_counts(documents: DataFrame) -> DataFrame:
    """term, n: the number of documents with each word that is in several, and with each word and pair of the examples,
    and with an empty term the number of all documents. Each task counts what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows = 0
        words_of = re.compile(r"[^\W_]+").findall
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                if text:
                    words = words_of(text.lower() if text.isascii() else unicodedata.normalize("NFC", text.lower()))
                    words = [w if w.isascii() else _folded(w) for w in words]
                    near = {p for a, b in zip(words, words[1:]) if a in _first_words and b in _second_words and (p := f"{a} {b}") in VOCABULARY}
                    counts.update({*words, *near})
                    if len(counts) > HELD_TERMS:
                        yield emit()
                        counts.clear()
        counts[""] = rows
        yield emit()

    kept = sorted({*_counted, ""})
    summed = documents.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return summed.where((F.col("n") > 1) | F.col("term").isin(kept))


_indexes: dict[int, Index] = {}


def _index(sent) -> Index:
    key = id(sent.value)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(*sent.value)
    return _indexes[key]


def scored(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source, score, category, segment, example of every row. Null and empty texts have score 0 and nulls;
    repeated rows, null keys and null sources are kept. Texts aren't shuffled unless the counts are too many to send."""
    counted = staged(term_counts(documents), "terms")
    whole = counted.count() <= SEND_TERMS
    got = (counted if whole else counted.where(F.col("term").isin(sorted({*_counted, ""})))).toArrow()
    counts = dict(zip(got["term"].to_pylist(), got["n"].to_pylist()))
    total = counts.pop("", 0)
    sent = documents.sparkSession.sparkContext.broadcast((counts, total))
    kind = documents.schema[key].dataType.simpleString()
    names = [key, "source", "score", "category", "segment", "example"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent)
        for batch in batches:
            rows = []
            for text, listed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                index.near_counts = dict((x["term"], x["n"]) for x in listed or ())
                rows.append(index.score(text))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.float64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent)
        for batch in batches:
            pairs = [(h, t) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in index.terms(text)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())], ["h", "term"])

    rows = documents.select(F.col(key), "source", "text")
    listing = "array<struct<term: string, n: bigint>>"
    if whole:
        rows = rows.withColumn("listed", F.lit(None).cast(listing))
    else:  # the counts of a text's own terms, by a shuffle
        hashed = rows.withColumn("h", F.sha2("text", 256))
        own = hashed.select("h", "text").where("text IS NOT NULL").mapInArrow(needed, "h string, term string").distinct()
        lists = own.join(counted, "term").groupBy("h").agg(F.collect_list(F.struct("term", "n")).alias("listed"))
        rows = hashed.join(lists, "h", "left").select(F.col(key), "source", "text", F.col("listed").cast(listing))
    return rows.mapInArrow(run, f"`{key}` {kind}, source string, score double, category string, segment string, example string")


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the offending texts, each once."""
    return scored(documents).where(F.col("score") >= FLAGGED).select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """source, documents, offending, rate, and the number of offending texts by category."""
    flagged = F.col("score") >= FLAGGED
    by = [F.count_if(flagged & (F.col("category") == c)).alias(c) for c in ("abuse", "hate", "sexual")]
    return scored(documents).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(flagged).alias("offending"), *by).withColumn("rate", F.col("offending") / F.col("documents"))
