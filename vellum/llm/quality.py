"""Statistics of a page's text that set running prose apart from lists, tables and junk.

Lines are looked at one by one and in runs. A line of a list or table, and an unreadable, machine-made or repeated
one, counts with its characters towards the structural part of the page. Gradient-boosted trees over all other
statistics give the probability that the page is no prose. They are fitted on a bounded sample: pages on which weak
labellers agree (hardly any or nearly all lines structural, and sentences and small words or none), and pages spliced
from the lines of two such, of which the true share is known by construction and not from their own lines. The
probabilities are calibrated on hand-checked texts.

Pages are scored where they are read; only their numbers are shuffled, to count a page written twice once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import boosting
from vellum.llm.holdout import PAGES

MIN_CHARS = 50
#: Rows of the sample that the trees are fitted on, about.
SAMPLE = 6000
#: Weak labels: at most and at least so much of a page's lines is structural.
SURELY_PROSE, SURELY_NOT = 0.02, 0.9
#: Shares of structural characters that pages are spliced for.
SPLICED = (0.15, 0.3, 0.4, 0.45, 0.47, 0.53, 0.55, 0.6, 0.7, 0.85)

STATS = (
    "chars", "words", "mean_word", "lines", "mean_line", "symbol_share", "digit_share", "upper_share", "punctuated_lines", "sentence_marks",
    "common_share", "distinct_words", "comma_rate", "vowel_share", "odd_share", "longest_token", "repeated_share", "list_share", "table_share",
    "junk_share", "loose_share", "small_word_lines", "ended_lines", "long_lines", "structural_share",
)
#: What the trees see: all but the sum that weak labels are taken from.
SEEN = len(STATS) - 1

_bullet = re.compile(r"(?:[-*•–·▪◦+>]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\d{1,2}(?:\.\d{1,2})+)\s+\S")
_leader = re.compile(r"\.{4,}|(?:\. ){4,}|…{2,}")
_gap = re.compile(r"\S(?:\t| {3,})(?=\S)|\|")
_pair = re.compile(r"[^:.!?]{1,40}:\s*[-+€$£]?\d[\d.,:%/ -]*\w{0,4}\Z")
_fields = re.compile(r"[^;,\t]{0,30}(?:[;,\t]\s*-?[\d.]+%?){2,}\s*\Z|[^;,\t]{1,30}(?:,\s*\d+)+\s*\Z")
_record = re.compile(r"[^;,]{1,30}(?:[;,][^;,\s][^;,]{0,30}){2,}\Z")
_log = re.compile(r"\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\w+=\S+.*\w+=\S+")
_hex = re.compile(r"(?:[0-9a-fA-F]{6,8}:?\s+)?(?:[0-9a-fA-F]{2,4}\s+){6,}[0-9a-fA-F]{2,4}")
_odd = re.compile(r"[ÂÃÅâ€ï¿½�¤§°\x80-\x9f\U0001F000-\U0001FAFF]")
_symbol = re.compile(r"[^\w\s.,;:!?'\"()\-–—’‘“”„«»。、・…]")
_word = re.compile(r"[^\W\d_]+")
_clump = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}", re.I)
_vowel = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûœæаеёиоуыэюя]", re.I)
_end = re.compile(r"[.!?;:。！？…][\"'”’)\]»]*\s*\Z")
_stop = re.compile(r"[.!?;。！？](?=[\"'”’)\]»]*(?:\s|\Z))|[。！？]")
_han, _kana = re.compile(r"[\u4e00-\u9fff]"), re.compile(r"[\u3040-\u30ff\uac00-\ud7af。、，]")
_edges = ".,;:!?()[]{}'\"“”‘’„«»…—–-"
_closing = frozenset(".!?;:。！？…\"'”’)]»")
_letters = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Pages whose characters are counted at once, and tokens that are kept.
PORTION, MOST_TOKENS = 512, 400_000
_sentence = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？])|\n")


BLANK, DIGIT, UPPER, VOWEL, ODD, SYMBOL, HAN, KANA, LETTER, COMMA, GAP, WIDE = range(12)
#: Counts of so many classes are kept in one number, in fields of so many bits.
FIELDS, BITS = 3, 20


def _character_classes() -> np.ndarray:
    """For every character below U+20000, a row for FIELDS classes each, the fields of its classes set; what lies above
    counts as the last one."""
    flags = np.zeros(0x20000, dtype=np.uint16)
    chars = list(map(chr, range(0x10000)))
    for k, test in ((BLANK, str.isspace), (DIGIT, str.isdigit), (UPPER, str.isupper), (LETTER, str.isalpha)):
        flags[:0x10000] |= np.fromiter(map(test, chars), bool, len(chars)).astype(np.uint16) << np.uint16(k)
    for k, pattern in ((VOWEL, _vowel), (ODD, _odd), (SYMBOL, _symbol), (HAN, _han), (KANA, _kana)):
        flags[[m.start() for m in pattern.finditer("".join(chars))]] |= 1 << k
    flags[ord(",")] |= 1 << COMMA
    flags[[ord(c) for c in chars if c.isspace() and c not in " \n"]] |= 1 << GAP
    flags[0x80:] |= 1 << WIDE
    flags[0x10000:] = 1 << WIDE
    flags[0x1F000:0x1FB00] = 1 << ODD | 1 << SYMBOL | 1 << WIDE
    set_in = [(flags >> np.uint16(k) & np.uint16(1)).astype(np.int64) << BITS * (k % FIELDS) for k in range(WIDE + 1)]
    return np.stack([sum(set_in[k : k + FIELDS]) for k in range(0, WIDE + 1, FIELDS)])


_classes: list[np.ndarray] = []


def _line_counts(joined: str) -> np.ndarray:
    """Of each line: characters of each class, then all that aren't blank."""
    if not _classes:
        _classes.append(_character_classes())
    code = np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(code == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    code = np.minimum(code, 0x1FFFF)
    columns = []
    for table in _classes[0]:
        if len(code) < 1 << BITS:
            packed = np.add.reduceat(table[code], starts)
            columns += [packed >> BITS * k & (1 << BITS) - 1 for k in range(FIELDS)]
        else:  # a field might run over
            fields = table[code]
            columns += [np.add.reduceat(fields >> BITS * k & 1, starts) for k in range(FIELDS)]
    return np.stack([*columns, ends + 1 - starts - columns[BLANK]], axis=1)


class _Tokens(dict):
    """Numbers of tokens in the order in which they are first seen, and what is known of each: its length, its word's number (0
    for none), whether the word is common, whether a letter is in it, and whether it ends like a sentence. age: how often the
    numbers began anew."""

    age = 0

    def __init__(self, common: frozenset[str]) -> None:
        self.common, self.words, self.rows, self.seen, self.names = common, {"": 0}, [], np.zeros((0, 5), np.int64), []

    def __missing__(self, token: str) -> int:
        word = token.lower().strip(_edges)
        self.rows.append((len(token), self.words.setdefault(word, len(self.words)), bool(word) and word in self.common, any(map(str.isalpha, token)), token[-1] in _closing))
        self.names.append(token)
        self[token] = n = len(self)
        return n

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self) > MOST_TOKENS:
            self.clear()
            self.__init__(self.common)
            self.age += 1
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.rows:
            self.seen = np.concatenate([self.seen, np.array(self.rows, np.int64)])
            self.rows = []
        return out


_tokens: list[_Tokens] = []


def _between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values from starts up to ends."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends] - sums[starts]


def _distinct(group: np.ndarray, number: np.ndarray, groups: int) -> np.ndarray:
    """How many different numbers each group has."""
    keys = np.sort(group << 32 | number)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount(keys[first] >> 32, minlength=groups)


def _kind(line: str, tokens: list[str], small: int, n: int, digits: int, vowels: int, odd: int, symbols: int, han: int, kana: int, letters: int) -> str:
    """list, table, junk or '' of one stripped line with so many characters of each class and common words."""
    if _bullet.match(line) or (("..." in line or ". ." in line or "…" in line) and _leader.search(line)):
        return "list"
    if digits and (_hex.match(line) or _log.match(line)) or odd > 0.15 * n or symbols > 0.18 * n:
        return "junk"
    if han > 0.5 * n:
        return "junk" if n >= 12 and not kana else ""
    longest = max(map(len, tokens))
    if longest > 32 and longest > 0.5 * n and not kana:
        return "junk"
    if len(tokens) >= 4 and len(set(tokens)) <= 0.4 * len(tokens):
        return "junk"
    if digits:
        cells = "," in line or ";" in line or "\t" in line
        if (":" in line and _pair.match(line)) or (cells and (_fields.match(line) or (not small and _record.match(line)))) or (digits > 0.3 * n and not _end.search(line)):
            return "table"
    if ("\t" in line or "   " in line or "|" in line) and len(_gap.findall(line)) >= 2:
        return "table"
    if len(tokens) >= 4 and small < 0.15 * len(tokens) and letters > 20 and line.isascii():
        if vowels < 0.22 * letters or sum(map(len, _clump.findall(line))) > 0.22 * letters:
            return "junk"
    return ""


def _runs(kinds: list[str], lines: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of lines that show no pattern of their own; empty lines end a run."""
    start = None
    for i in range(len(lines) + 1):
        plain = i < len(lines) and lines[i] and not kinds[i]
        if plain and start is None:
            start = i
        elif not plain and start is not None:
            yield start, i
            start = None


def _hangs_on(lines: list[str], common: frozenset[str]) -> bool:
    """Whether a run of plain lines beside structural ones goes with them: no sentence ends in it, and it has
    hardly any of the small words of a language."""
    text = " ".join(lines)
    words = _word.findall(text.lower())
    return not _kana.search(text) and not _stop.search(text) and sum(map(common.__contains__, words)) <= 0.05 * len(words)


def _loose(lines: list[str], common: frozenset[str]) -> bool:
    """Whether a run of plain lines is a list of names or keywords: no sentence ever ends, and the lines are
    either many short ones or strings of commas without the small words of a language."""
    text = " ".join(lines)
    if _kana.search(text):
        return False
    words = _word.findall(text.lower())
    if not words:
        return True
    ends, small = len(_stop.findall(text)), sum(map(common.__contains__, words))
    if ends and len(words) / ends < 60:
        return False
    commas = text.count(",")
    if commas >= 4 and small < 0.04 * len(words) and commas > 0.15 * len(words):
        return True
    short = sum(len(x.split()) <= 5 for x in lines)
    return len(lines) >= 3 and short > 0.7 * len(lines) and small < 0.2 * len(words) and not ends


def _said(plain: str, odd_blanks: bool) -> list[str]:
    """The sentences of a text."""
    if odd_blanks:
        parts = _sentence.split(plain)
    else:
        marked = plain.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").replace("; ", ";\n")
        if not plain.isascii():
            marked = marked.replace("。", "。\n").replace("！", "！\n").replace("？", "？\n")
        parts = marked.split("\n")
    return [x for s in parts if len(x := s.strip()) >= 12]


class Portion(NamedTuple):
    """STATS of some texts, the tokens of each line of each text, and the numbers of all tokens in a table."""

    stats: np.ndarray
    split: list[list[list[str]]]
    ids: np.ndarray
    table: _Tokens


def portion(texts: list[str], common: frozenset[str]) -> Portion:
    """Lines are counted all at once; those on which no pattern can match are not looked at one by one."""
    if not _tokens or _tokens[0].common is not common:
        _tokens[:] = [_Tokens(common)]
    joined = "\n".join(texts)
    lines = joined.split("\n")
    split = [x.split() for x in lines]
    counts = _line_counts(joined)
    per_line = np.fromiter(map(len, split), np.int64, len(lines))
    to = np.cumsum(per_line)
    since = to - per_line
    ids = _tokens[0].numbers([t for tokens in split for t in tokens])
    length, word, known, lettered, closing = _tokens[0].seen[ids].T if len(ids) else np.zeros((5, 0), np.int64)
    page_lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    until = np.cumsum(page_lines)
    start = until - page_lines
    page_of = np.repeat(np.arange(len(texts)), page_lines)
    line_of = np.repeat(np.arange(len(lines)), per_line)
    size, filled = counts[:, -1], per_line > 0
    some = np.flatnonzero(filled)
    small = _between(known, since, to)
    longest, ended = np.zeros((2, len(lines)), np.int64)
    if len(some):
        longest[some] = np.maximum.reduceat(length, since[some])
        ended[some] = closing[to[some] - 1]
    # the lines that _kind may have a name for
    digits, letters, han = counts[:, DIGIT], counts[:, LETTER], counts[:, HAN]
    asked = (digits > 0) | (counts[:, ODD] > 0.15 * size) | (counts[:, SYMBOL] > 0.18 * size) | (han > 0.5 * size) | ((longest > 32) & (longest > 0.5 * size))
    asked |= (per_line >= 4) & (_distinct(line_of, ids, len(lines)) <= 0.4 * per_line)
    asked |= (per_line >= 4) & (small < 0.15 * per_line) & (letters > 20) & (counts[:, WIDE] == 0)
    asked &= filled
    for p, text in enumerate(texts):
        for mark in ("|", "\t", "   ", "…", "...", ". ."):
            if mark in text:
                a, b = int(start[p]), int(until[p])
                asked[a:b] |= filled[a:b] & np.fromiter((mark in x for x in lines[a:b]), bool, b - a)
    for i in np.flatnonzero(filled & ~asked).tolist():
        if split[i][0][:1] not in _letters or split[i][0][1:2] in ".)":
            asked[i] = True
    kinds = [""] * len(lines)
    for i in np.flatnonzero(asked).tolist():
        _, d, _, v, o, s, h, k, own, *_, n = counts[i].tolist()
        kinds[i] = _kind(lines[i].strip(), split[i], int(small[i]), n, d, v, o, s, h, k, own)
    # runs of plain lines, and those of them that may be loose
    plain = filled & ~np.fromiter(map(bool, kinds), bool, len(lines))
    first, last = plain.copy(), plain.copy()
    inner = plain[1:] & plain[:-1] & (page_of[1:] == page_of[:-1])
    first[1:] &= ~inner
    last[:-1] &= ~inner
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    commas, words = _between(counts[:, COMMA], s, e), _between(_between(lettered, since, to), s, e)
    short = _between((per_line <= 5).astype(np.int64), s, e)
    loose = (_between(letters, s, e) == 0) | ((commas >= 4) & (commas > 0.15 * words)) | ((e - s >= 3) & (short > 0.7 * (e - s)))
    for x, y in zip(s[loose].tolist(), e[loose].tolist()):
        if _loose([line.strip() for line in lines[x:y]], common):
            kinds[x:y] = ["loose"] * (y - x)
    # pages
    total = np.add.reduceat(counts, start, axis=0)
    n_filled, n_words = np.add.reduceat(filled.astype(np.int64), start), _between(word > 0, *(_between(per_line, np.zeros_like(x), x) for x in (start, until)))
    spoken = word > 0
    distinct = _distinct(np.repeat(page_of, per_line)[spoken], word[spoken], len(texts))
    smalls, n_ended = np.add.reduceat(small, start), np.add.reduceat(ended, start)
    speaking, ending, long = (np.add.reduceat(np.where(filled & x, size, 0), start) for x in (small >= 0.15 * per_line, ended > 0, per_line > 6))
    longest = np.maximum.reduceat(longest, start)
    out = np.zeros((len(texts), len(STATS)))
    columns = (total, n_filled, n_words, n_ended, smalls, distinct, longest, speaking, ending, long, start, until)
    for p, (text, whole, full, n_all, closed, common_words, unlike, top, speaks, ends, wide, a, b) in enumerate(zip(texts, *(c.tolist() for c in columns))):
        chars, own, n = whole[-1], max(1, whole[LETTER]), max(1, n_all)
        if not chars:
            continue
        by, said_in = Counter(), text
        if any(kinds[a:b]):
            mine, stripped = kinds[a:b], [x.strip() for x in lines[a:b]]
            for x, y in list(_runs(mine, stripped)):
                beside = (x and mine[x - 1]) or (y < len(mine) and mine[y])
                if beside and _hangs_on(stripped[x:y], common):
                    mine[x:y] = [beside] * (y - x)
            for kind, x in zip(mine, size[a:b].tolist()):
                by[kind] += x
            said_in = "\n".join(x for x, k in zip(stripped, mine) if not k)
        else:
            by[""] = chars
        # sentences that come again and again are junk, unless their lines are counted already
        said = _said(said_in, whole[GAP] > 0)
        different = len(set(said))
        again = sum(len("".join(x.split())) * n for x, n in Counter(said).items() if n >= 4) if different + 3 <= len(said) else 0
        out[p] = (
            chars, n_all, own / n, full, chars / full, whole[SYMBOL] / chars, whole[DIGIT] / chars, whole[UPPER] / own,
            closed / full, different / n, common_words / n, unlike / n, said_in.count(",") / n, whole[VOWEL] / own, whole[ODD] / chars,
            top, again / chars, by["list"] / chars, by["table"] / chars, by["junk"] / chars, by["loose"] / chars, speaks / chars, ends / chars, wide / chars,
            min(1.0, (chars - by[""] + again) / chars),
        )
    return Portion(out, [split[a:b] for a, b in zip(start.tolist(), until.tolist())], ids, _tokens[0])


def batch_stats(texts: list[str | None], common: frozenset[str]) -> np.ndarray:
    """STATS of texts, a row each; null and blank texts have zeros."""
    out = np.zeros((len(texts), len(STATS)))
    for s in range(0, len(texts), PORTION):
        out[s : s + PORTION] = portion([t or "" for t in texts[s : s + PORTION]], common).stats
    return out


def page_stats(text: str | None, common: frozenset[str]) -> np.ndarray:
    return batch_stats([text], common)[0]


def common_set(words: DataFrame) -> frozenset[str]:
    """The frequent words of all languages; the table is fixed and small."""
    return frozenset(r["word"].lower() for r in words.where("word IS NOT NULL").select("word").distinct().collect())


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 for pages that are surely no prose, 0 for those that surely are, -1 where the weak labellers disagree: the
    line patterns on one side, sentences and small words on the other."""
    at = {name: x[:, k] for k, name in enumerate(STATS)}
    # languages without listed words speak in long lines with few commas
    foreign = (at["common_share"] == 0) & (at["comma_rate"] < 0.2) & ((at["long_lines"] > 0.5) | (at["mean_word"] > 9))
    speaks = (at["sentence_marks"] > 0.02) & ((at["common_share"] > 0.05) | foreign)
    mute = (at["sentence_marks"] < 0.05) | (at["common_share"] < 0.05) | (at["repeated_share"] > 0.5)
    out = np.full(len(x), -1)
    out[(at["structural_share"] <= SURELY_PROSE) & speaks] = 0
    out[(at["structural_share"] >= SURELY_NOT) & mute] = 1
    out[at["chars"] < MIN_CHARS] = -1
    return out


def _first_lines(lines: list[str], chars: float) -> tuple[list[str], int]:
    """The first lines with about so many characters that aren't blank, and their number of characters."""
    out, size = [], 0
    for line in lines:
        n = len("".join(line.split()))
        if out and size + n / 2 > chars:
            break
        out.append(line)
        size += n
    return out, size


def spliced(prose: list[str], other: list[str]) -> Iterator[tuple[str, float]]:
    """(text, whether more than half of it is no prose) of pages made of the lines of a prose page and of another
    one, in shares of SPLICED, the other part before, behind or inside the prose."""
    for k, (a, b) in enumerate(zip(prose, other)):
        la, lb = a.split("\n"), b.split("\n")
        na, nb = len("".join(a.split())), len("".join(b.split()))
        share = SPLICED[k % len(SPLICED)]
        whole = min(na / (1 - share), nb / share)
        (ta, sa), (tb, sb) = _first_lines(la, whole * (1 - share)), _first_lines(lb, whole * share)
        true = sb / max(1, sa + sb)
        if abs(true - 0.5) > 0.01 and sa + sb >= MIN_CHARS:
            at = (0, len(ta), len(ta) // 2)[k % 3]
            yield "\n".join([*ta[:at], *tb, *ta[at:]]), float(true > 0.5)


def training_set(texts: list[str], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """STATS and labels of the surely labelled pages among texts and of pages spliced from them."""
    x = batch_stats(texts, common)
    labels = weak_labels(x)
    prose, other = ([texts[i] for i in np.flatnonzero(labels == k)] for k in (0, 1))
    mixed: list[tuple[str, float]] = []
    if prose and other:
        n = max(len(prose), len(other))
        for shift in (0, 1):  # every page of either kind meets others
            mixed += spliced([prose[(i + shift) % len(prose)] for i in range(n)], [other[(i * (1 + shift) + shift) % len(other)] for i in range(n)])
    made = batch_stats([t for t, _ in mixed], common)
    sure = labels >= 0
    return np.concatenate([x[sure], made]), np.concatenate([labels[sure].astype(float), np.array([y for _, y in mixed])])


def fit(pages: DataFrame, common: frozenset[str], sample: int = SAMPLE) -> boosting.Booster:
    """Trees from about so many pages, drawn by a hash of their key, and calibrated on the hand-checked texts."""
    every = max(1, pages.count() // sample)
    drawn = pages.where((F.pmod(F.xxhash64("doc_id", "page_number"), F.lit(every)) == 0) & F.col("text").isNotNull()).select("text").limit(2 * sample)
    x, y = training_set(drawn.toArrow()["text"].to_pylist(), common)
    checked = batch_stats([t for t, _ in PAGES], common)
    truth = np.array([float(y) for _, y in PAGES])
    if len(x) < 200 or len(set(y)) < 2:  # too few pages for trees: the checked texts and their splices stand in
        more, labels = training_set([t for t, _ in PAGES], common)
        x, y = np.concatenate([x, checked, more]), np.concatenate([y, truth, labels])
    return boosting.calibrated(boosting.fit(x[:, :SEEN], y), checked[:, :SEEN], truth)


def probability(model: boosting.Booster, x: np.ndarray) -> np.ndarray:
    """The probability that pages with these STATS are no prose; 0 for blank ones."""
    return np.where(x[:, 0] > 0, model.probability(x[:, :SEEN]), 0.0)


def scored(pages: DataFrame, words: DataFrame, model: boosting.Booster | None = None, common: frozenset[str] | None = None) -> DataFrame:
    """doc_id, page_number, STATS and structural (the probability that the page is no running prose) of pages
    (doc_id, page_number, text, extracted_at). One row per page: the latest text counts. Null and blank texts
    have zeros and probability 0; rows without a key are left out; an empty table gives no row."""
    common = common_set(words) if common is None else common
    model = fit(pages, common) if model is None else model
    names = ["doc_id", "page_number", "at", *STATS, "structural"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_stats(batch.column(3).to_pylist(), common)
            p = probability(model, x)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(np.ascontiguousarray(c)) for c in x.T), pa.array(p)], names)

    rows = pages.select("doc_id", F.col("page_number").cast("int").alias("page_number"), F.unix_micros(F.col("extracted_at").cast("timestamp")).alias("at"), "text")
    rows = rows.where("doc_id IS NOT NULL AND page_number IS NOT NULL")
    out = rows.mapInArrow(run, "doc_id string, page_number int, at bigint, " + ", ".join(f"{s} double" for s in STATS) + ", structural double")
    newest = F.struct(F.coalesce("at", F.lit(-(1 << 62))), "chars", "structural")
    return out.groupBy("doc_id", "page_number").agg(F.max_by(F.struct(*STATS, "structural"), newest).alias("s")).select("doc_id", "page_number", "s.*")


def found(pages: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page_number of the pages of which more than half is no prose."""
    return scored(pages, words).where((F.col("chars") >= MIN_CHARS) & (F.col("structural") > 0.5)).select("doc_id", "page_number")


def with_quality(pages: DataFrame, quality: DataFrame, words: DataFrame) -> DataFrame:
    """scored, with char_count and text_quality of the page's row in quality (of several the largest count), and
    off, whether that count differs from the text's by more than a tenth; nulls where there is none."""
    best = quality.groupBy("doc_id", "page_number").agg(F.max(F.struct("char_count", "text_quality")).alias("q")).select("doc_id", "page_number", "q.*")
    joined = scored(pages, words).join(best, ["doc_id", "page_number"], "left")
    return joined.withColumn("off", F.abs(F.col("char_count") - F.col("chars")) > 0.1 * F.col("char_count") + 0.5 * F.col("chars"))
