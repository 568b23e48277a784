"""Repair of text from scanned pages.

A lexicon of the whole corpus (words with their counts) and a table of misread characters make a noisy channel: a
stretch of characters is read as the words that are most probable as written, over all ways to join what a line
end, a hyphen or a blank has cut, to cut what has run together, and to undo misreadings. The decoder reads the
stream of all lines of a page from one punctuation mark to the next. Its path is found piece by piece: where no word
that reaches over a blank can be cheaper than the words beside it (Reader.reach), the stream falls apart there
without changing the path, and a piece of one word that is cheaper than any two needs no search (Reader.settled).
A table lookup of misreadings of whole tokens adds readings with two of them to the decoder's choice.

Headings and footings are lines at a page's edge that recur on pages of its document, misreadings and page numbers
aside. Where paragraphs begin is chosen by dynamic programming over the lines that are left.

Pages are read where they lie. The lexicon sent to the workers is bounded by LEXICON words, the most frequent of
those that occur LEAST times, counted over all pages.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import boosting, quality
from vellum.operators.pages import latest_pages
from vellum.session import staged

LEXICON, LEAST = 250_000, 4
#: A known word is a misreading if another explains it that is so many times as frequent; the second number holds
#: for words with digits or signs among their letters.
FAR_MORE, FAR_MORE_MIXED = 15, 6
LONGEST = 24
#: Stands for a hyphen at a line's end in a stream.
HYPHEN = "\x02"
#: Parts that the edge lines of one document are dealt into where they are compared with its headings.
SALTS = 4

#: What is printed on the left may be read as on the right.
MISREAD = (
    ("e", "c"), ("r", "|"), ("l", "|"), ("i", "|"), ("a", "@"), ("i", "!"), ("l", "1"), ("i", "1"), ("t", "7"), ("o", "0"), ("n", "ri"), ("d", "cl"),
    ("s", "5"), ("s", "$"), ("u", "ii"), ("c", "("), ("m", "rn"), ("g", "9"), ("h", "li"), ("v", "\\/"), ("b", "6"), ("rn", "m"), ("cl", "d"), ("w", "vv"), ("l", "!"), ("b", "8"), ("z", "2"),
)
#: Hyphens at a line's end.
HYPHENS = "-­¬‐"

_undo: dict[str, list[str]] = {}
for _true, _seen in MISREAD:
    _undo.setdefault(_seen, []).append(_true)
_seen_2 = {s for s in _undo if len(s) == 2}
_suspect = {s[0] for s in _undo}
_edge = ".,;:?\"'“”‘’„«»…—–[]{}"
_wide_edge = _edge + "()!-*_"


def variants(core: str, most: int = 2) -> Iterator[tuple[str, int]]:
    """Readings of a lower-case token with up to so many misreadings undone, and how many."""
    now = {core}
    for n in range(1, most + 1):
        made = set()
        for s in now:
            for i, c in enumerate(s):
                for true in _undo.get(c, ()):
                    made.add(s[:i] + true + s[i + 1 :])
                if s[i : i + 2] in _seen_2:
                    for true in _undo[s[i : i + 2]]:
                        made.add(s[:i] + true + s[i + 2 :])
        for s in made:
            yield s, n
        now = made


class Reader:
    """Reads tokens in the light of a lexicon."""

    MISREADING, JOIN, CUT = 5.0, 7.0, 6.0

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.total = sum(counts.values()) + 1
        self._known: dict[str, str | None] = {}
        self._readings: dict[str, str | None] = {}
        self._beginnings: dict[str, int] | None = None
        self.least = math.log(self.total / max(counts.values(), default=1))  # what the most frequent word costs
        self.most = math.log(self.total)
        self._tokens: dict[str, tuple[str, bool, int, bool, bool, str, float]] = {}
        self.apart: set[tuple[str, str]] = set()  # neighbours over which no word may reach
        self.near: set[tuple[str, str]] = set()  # neighbours over which one may
        self._seen: Seen | None = None
        self._decoded: dict[str, list] = {}
        self._tails_of: dict[tuple[str, bool, int], list[tuple[float, str]]] = {}

    def cost(self, word: str) -> float:
        """Improbability of a word; unknown ones pay for each character."""
        if len(word) == 1:  # the lexicon has no single letters; they stand for themselves
            return 6.0
        n = self.counts.get(word)
        return math.log(self.total / n) if n else 14.0 + 1.5 * len(word)

    def reading(self, core: str) -> str | None:
        """The word that a lower-case token is a misreading of; None where it is no misreading."""
        if core not in self._readings:
            if len(self._readings) > 400_000:
                self._readings.clear()
            self._readings[core] = self._reading(core)
        return self._readings[core]

    def _reading(self, core: str) -> str | None:
        n = self.counts.get(core, 0)
        best, best_count, best_n = None, 0, 9
        for word, k in variants(core, 1 if n else 2):
            found = self.counts.get(word, 0)
            if found and (k, -found) < (best_n, -best_count):
                best, best_count, best_n = word, found, k
        far = FAR_MORE if word_like(core) else FAR_MORE_MIXED
        return best if best and best_count >= far * max(n, 0.4) and word_like(best) else None

    def correction(self, token: str) -> str | None:
        """The right word of a raw token that is misread; None if it is right, or nothing better is known."""
        if token in self._known:
            return self._known[token]
        out = None
        lower = token.lower()
        core = lower.strip(_wide_edge)
        if 3 <= len(core) <= LONGEST + 6 and not core.isdigit():
            if self.counts.get(core, 0) * FAR_MORE < self.total // 50:
                # a misread character may itself look like punctuation at the edge
                cores = {core: None, lower.strip(_edge): None, lower.rstrip(_edge).lstrip(_wide_edge): None, lower.lstrip(_edge).rstrip(_wide_edge): None}
                for c in cores:
                    if sum(x.isalpha() for x in c) >= max(2, len(c) // 2) and (word := self.reading(c)) and word != core:
                        out = word
                        break
        if len(self._known) > 400_000:
            self._known.clear()
        self._known[token] = out
        return out

    def joined(self, left: str, right: str) -> str:
        """The whole word of two parts cut by a hyphen at a line's end, with its hyphen if it is written so."""
        whole, dashed = left + right, f"{left}-{right}"
        a, b = self.counts.get(whole, 0), self.counts.get(dashed, 0)
        if a or b:
            return whole if a >= b else dashed
        for form in (whole, dashed):
            if word := self.reading(form):
                return word
        return whole

    def segments(self, stream: str) -> list[str]:
        """The most probable words of a stretch of lower-case characters; blanks may be dropped, words may have
        run together, and characters may be misread."""
        return [word for _, _, word, _ in self.alignment(stream)]

    def alignment(self, stream: str, whole: tuple[tuple[int, int, str, int, float], ...] = ()) -> list[tuple[int, int, str, int]]:
        """(start, end, word, misreadings undone) of the most probable words of a stretch of lower-case characters.
        Dynamic programming over the positions. A word of the lexicon may begin and end anywhere but at a hyphen of a
        line's end (HYPHEN); what is no such word stands as it is, from a blank to a blank. whole: further readings of
        tokens (start, end, word, misreadings, cost)."""
        n = len(stream)
        # what the tokens cost one by one: a path that costs more is not followed
        limit, at = 0.0, 0
        for token in stream.split(" "):
            if token:
                limit += min([cost for start, end, _, _, cost in whole if start == at and end == at + len(token)] + [math.inf if HYPHEN in token else self.cost(token)])
            at += len(token) + 1
        best: list[tuple[float, int, str, int]] = [(0.0, 0, "", 0)] + [(math.inf, 0, "", 0)] * n
        for i in range(n):
            here = best[i][0]
            if here == math.inf:
                continue
            if stream[i] == " ":
                if here < best[i + 1][0]:
                    best[i + 1] = (here, i, "", 0)
                continue
            if not i or stream[i - 1] == " ":
                j = stream.find(" ", i)
                j = n if j < 0 else j
                if HYPHEN not in stream[i:j] and here + self.cost(stream[i:j]) < best[j][0]:
                    best[j] = (here + self.cost(stream[i:j]), i, stream[i:j], 0)
                for start, end, word, k, cost in whole:
                    if start == i and here + cost < best[end][0]:
                        best[end] = (here + cost, i, word, k)
            for j, word, k, extra in self._words_at(stream, i, limit - here):
                cost = here + self.cost(word) + extra + (self.CUT if j < n and stream[j] != " " else 0.0)
                if cost < best[j][0]:
                    best[j] = (cost, i, word, k)
        out, at = [], n
        while at:
            _, before, word, k = best[at]
            if word:
                out.append((before, at, word, k))
            at = before
        return out[::-1]

    def _begins(self) -> dict[str, int]:
        """The beginnings of words, each with the count of its most frequent word."""
        if self._beginnings is None:
            self._beginnings = {}
            for w, c in self.counts.items():
                for i in range(1, len(w) + 1):
                    if c > self._beginnings.get(w[:i], 0):
                        self._beginnings[w[:i]] = c
        return self._beginnings

    def _words_at(self, stream: str, start: int, most: float = math.inf) -> Iterator[tuple[int, str, int, float]]:
        """(end, word, misreadings, what they and dropped blanks cost) of the words of the lexicon that a stretch
        from start may be. Only beginnings of words are followed, and none of which every word costs more than most."""
        known, begins, n = self.counts, self._begins(), len(stream)
        if stream[start] == HYPHEN:
            return
        dear = self.total / math.exp(min(most + 1e-6, 700.0))  # words must not be rarer
        joined, undone = math.exp(self.JOIN), math.exp(self.MISREADING)
        paths = [(start, "", 0, 0.0, dear)]
        while paths:
            i, word, k, extra, rare = paths.pop()
            if word in known and (not k or (i - start > 2 and known[word] >= 0.4 * FAR_MORE and word_like(word))) and stream[i - 1] != HYPHEN and (i == n or stream[i] != HYPHEN):
                yield i, word, k, extra
            if i == n:
                continue
            c = stream[i]
            if c == " ":
                if i + 1 < n and (len(word) < 2 or begins[word] >= rare * joined):
                    paths.append((i + 1, word, k, extra + self.JOIN, rare * joined))
                continue
            if c == HYPHEN:
                paths.append((i + 1, word, k, extra, rare))
                if word + "-" in begins:
                    paths.append((i + 1, word + "-", k, extra, rare))
                continue
            if (found := begins.get(word + c)) and (found >= rare or not word):
                paths.append((i + 1, word + c, k, extra, rare))
            if not k:
                for seen in (c, stream[i : i + 2]):
                    for true in _undo.get(seen, ()) if len(seen) == 1 or seen in _seen_2 else ():
                        if (found := begins.get(word + true)) and (found >= rare * undone or not word):
                            paths.append((i + len(seen), word + true, 1, extra + self.MISREADING, rare * undone))

    def reach(self, left: str, right: str, maybe: bool = False) -> bool:
        """Whether the best words of a stream may include one that reaches over the blank or line end between two raw
        tokens. False only where every such word costs at least as much as both tokens read for themselves do: a path
        over blanks is no cheaper then than one that stops at each of them. maybe: the bounds are known to allow it."""
        pair = (left, right)
        if pair in self.apart:
            return False
        if pair in self.near:
            return True
        for known in (self.apart, self.near):
            if len(known) > 1_000_000:
                known.clear()
        got = self._reach(left, right, maybe)
        (self.near if got else self.apart).add(pair)
        return got

    def marked(self, pages: list[list[list[str]]], ids: np.ndarray | None = None, table: dict[str, int] | None = None) -> list[tuple[list[int], list[int]]]:
        """For each page, given as the tokens of its lines: the places, counted over the page, of tokens that aren't
        explained as they stand, and of the first of two neighbours for which reach holds. Bounds are looked up for
        all pages at once, and reach is asked only for pairs that they don't rule out. ids: the numbers of all tokens
        in a table of quality, where they are known."""
        if self._seen is None:
            self._seen = Seen(self)
        flat = [t for split in pages for tokens in split for t in tokens]
        to = np.cumsum([sum(map(len, split)) for split in pages])
        ids = self._seen.numbers(flat) if ids is None else self._seen.translated(ids, table)
        odd = np.flatnonzero(~self._seen.plain[ids])
        maybe = np.flatnonzero(self._seen.near(ids[:-1], ids[1:]))
        maybe = maybe[~np.isin(maybe + 1, to)]  # no word reaches into another page
        _, first, which = np.unique(ids[maybe] << 32 | ids[maybe + 1], return_index=True, return_inverse=True)
        asked = np.array([self.reach(flat[f], flat[f + 1], True) for f in maybe[first].tolist()], bool)
        close = maybe[asked[which]] if len(maybe) else maybe
        out = []
        ends = [np.searchsorted(x, to).tolist() for x in (odd, close)]
        for p, end in enumerate(to.tolist()):
            start = int(to[p - 1]) if p else 0
            out.append(tuple((x[at[p - 1] if p else 0 : at[p]] - start).tolist() for x, at in zip((odd, close), ends)))
        return out

    def _reach(self, left: str, right: str, maybe: bool) -> bool:
        a = self._tokens.get(left) or self._token(left)
        b = self._tokens.get(right) or self._token(right)
        if not a[0] or not b[0] or a[4] or b[3]:
            return False
        if not maybe and self._seen is not None and not self._seen.may(left, right, a[5], b[5], a[6] + b[6]):
            return False
        return self._may_join(a[5], b[5], a[6] + b[6])

    def _may_join(self, x: str, y: str, price: float) -> bool:
        if price <= self.JOIN + self.least:
            return False
        get, most, first, near = self._begins().get, price + self.most, y[0], 1 + 1e-9
        # whole or from within x, misread or not: the kinds of tails that may be cheap enough
        for cut in (False, True):
            base = self.JOIN + self.CUT * cut
            if base + self.least >= price:
                break
            # beginnings of rarer words, without and with a misreading, cost too much
            rare = self.total / math.exp(min(price - base, 700.0))
            rarer = rare * math.exp(self.MISREADING)
            undone = base + self.MISREADING + self.least < price
            # then a word from within x must end where y does: a second cut costs more than a misreading
            ends = cut and not undone
            for misread in (0, 1) if undone else (0,):
                for bound, part in self._tails(x, cut, misread):
                    dear = base + bound >= price
                    if dear and misread:
                        break
                    # a word over several blanks pays for each, and stands for more than these two tokens
                    if not misread and (longer := get(part + y)):
                        if base + self.JOIN + math.log(self.total / longer) < most or (ends and part + y in self.counts and base + self.cost(part + y) < price):
                            return True
                    if not ends and not dear and ((undone and not misread) or get(part + first, 0) * near > (rarer if misread else rare)) and self._goes_on(part, y, misread, price - base, rare, rarer):
                        return True
        return False

    def _tails(self, x: str, cut: bool, misread: int) -> list[tuple[float, str]]:
        """(what a word costs at least, how it begins) of the ways in which words of the lexicon may begin with all of x, or
        with a part of it, as it stands or with one misreading undone, and go on behind a blank; the cheapest first."""
        key = (x, cut, misread)
        if key not in self._tails_of:
            if len(self._tails_of) > 1_000_000:
                self._tails_of.clear()
            self._tails_of[key] = sorted((self.MISREADING * misread + math.log(self.total / self._begins()[part]), part) for part in self._parts(x, cut, misread))
        return self._tails_of[key]

    def _parts(self, x: str, cut: bool, misread: int) -> Iterator[str]:
        """The beginnings of words that _tails tells the costs of."""
        begins = self._begins()
        for end in [x[p:] for p in range(1, len(x))] if cut else [x]:
            if not misread:
                if end in begins:
                    yield end
                continue
            for i, letter in enumerate(end):
                if i and end[:i] not in begins:
                    break
                for true in _undo.get(letter, ()):
                    if (part := end[:i] + true + end[i + 1 :]) in begins:
                        yield part
                if (seen := end[i : i + 2]) in _seen_2:
                    for true in _undo[seen]:
                        if (part := end[:i] + true + end[i + 2 :]) in begins:
                            yield part

    def _goes_on(self, part: str, y: str, misread: int, limit: float, rare: float, rarer: float) -> bool:
        """Whether a word that begins with part goes on with the characters of y, or their right readings, for less than
        the limit. Beginnings are not followed where no word is more frequent than rare, or rarer if one misreading is undone."""
        begins, known, n = self._begins(), self.counts, len(y)
        paths = [(0, part, misread)]
        while paths:
            i, word, k = paths.pop()
            if i and word in known and (not k or (i + len(part) > 1 and known[word] >= 0.4 * FAR_MORE and word_like(word))):
                if self.cost(word) + self.MISREADING * k + (self.CUT if i < n else 0.0) < limit:
                    return True
            if i == n:
                continue
            if begins.get(word + y[i], 0) * (1 + 1e-9) > (rarer if k else rare):
                paths.append((i + 1, word + y[i], k))
            if not k:
                for seen in (y[i], y[i : i + 2]):
                    for true in _undo.get(seen, ()) if len(seen) == 1 or seen in _seen_2 else ():
                        if begins.get(word + true, 0) * (1 + 1e-9) > rarer:
                            paths.append((i + len(seen), word + true, 1))
        return False

    def decoded(self, lines: list[str], cut: set[int], stops: frozenset[int] = frozenset(), marks: tuple[list[int], list[int]] | None = None) -> list[Decoded]:
        """What the decoder reads otherwise than printed in the stream of all lines. It goes over blanks, line ends and
        hyphens at line ends, not over punctuation, empty lines and lines of stops. Where neither a word reaches over
        the blanks around a token nor a cheaper reading of it exists (reach, settled), it is not decoded: the outcome
        is known. A change stands only where all its words are in the lexicon, but for words cut by a hyphen.
        marks: what marked gives for the lines, where that is known."""
        out: list[Decoded] = []
        if marks == ([], []) and not cut:
            return out
        split = [line.split() for line in lines]
        strange, close = self.marked([split])[0] if marks is None else marks
        starts = [0]
        for tokens in split:
            starts.append(starts[-1] + len(tokens))
        # the tokens that may be part of a change: all others are windows of their own, and are read as printed. A word
        # that begins further back ends in the token behind two close ones at most
        live = bytearray(starts[-1] + 5)
        odd = {bisect.bisect_right(starts, f) - 1 for f in (*strange, *close, *(f + 1 for f in close))} | cut
        for f in strange:
            live[f] = 1
        for i in cut:
            h = starts[i + 1] - 1
            live[max(0, h - 1) : h + 4] = bytes([1]) * (h + 4 - max(0, h - 1))
        for f in close:
            live[f : f + 3] = b"\1\1\1"
        run: list[Piece] = []
        last = before = -2
        for i in sorted({j for i in odd for j in (i - 1, i, i + 1) if 0 <= j < len(lines)}):
            tokens = split[i]
            if not tokens or i in stops or i != last + 1:
                self._decode_run(run, out)
            last, start = i, starts[i]
            for k in [k for k in range(len(tokens)) if live[start + k]]:
                token = tokens[k]
                if start + k != before + 1:
                    self._decode_run(run, out)
                before = start + k
                if k == 0 and i - 1 in cut:
                    if run and run[-1].half and not (i in cut and len(tokens) == 1):
                        self._close_half(run, lines[i], token, i)
                    if run and (run[-1].half or not run[-1].open):
                        self._decode_run(run, out)
                    continue
                if i in cut and k == len(tokens) - 1 and (head := _left_part.search(lines[i])):
                    left = head.group(1).lower()
                    if left[0] in _wide_edge:
                        self._decode_run(run, out)
                    run.append(Piece([(i, k)], token, left.lstrip(_wide_edge), half=True))
                    continue
                word, explained, misread, opens, closes, core, price = self._tokens[token] if token in self._tokens else self._token(token)
                if not word:
                    self._decode_run(run, out)
                    continue
                if opens:
                    self._decode_run(run, out)
                run.append(Piece([(i, k)], token, core, explained, word if misread else None, price))
                if closes:
                    self._decode_run(run, out)
        self._decode_run(run, out)
        return out

    def _close_half(self, run: list[Piece], line: str, token: str, i: int) -> None:
        """Puts the second part to a word cut by a hyphen, the last of a run."""
        after = line.lstrip()
        right = _right_part.match(after) or re.match(r"^\S+", after)
        b = right.group().lower().rstrip(_wide_edge) if right else ""
        piece = run[-1]
        if not piece.core or not b or not any(c.isalpha() for c in b):
            run.pop()
            return
        word = self.joined(piece.core, b)
        price = self.cost(word)
        run[-1] = Piece([*piece.tokens, (i, 0)], piece.raw, f"{piece.core}{HYPHEN}{b}", word in self.counts, word, price, open=len(right.group()) == len(token) and b == token.lower())

    def _token(self, token: str) -> tuple[str, bool, int, bool, bool, str, float]:
        """Of a raw token: its word, whether the lexicon explains it, whether it is misread, whether punctuation
        stands before and behind it, its characters, and what its word costs."""
        lower = token.lower()
        core = lower.strip(_wide_edge)
        word = self.correction(token) if core else None
        explained = bool(word) or core in self.counts or not mostly_letters(core)
        price = self.cost(core)
        if word:
            price = min(price, self.cost(word) + math.log(FAR_MORE if word_like(core) else FAR_MORE_MIXED))
        elif core in self.counts and price > 2 * self.least + self.CUT:
            explained = [w for _, _, w, _ in self.alignment(core)] == [core]
        got = (word or core, explained, int(bool(word)), bool(core) and lower[0] != core[0], bool(core) and lower[-1] != core[-1], core, price)
        if len(self._tokens) > 400_000:
            self._tokens.clear()
        self._tokens[token] = got
        return got

    def settled(self, piece: Piece) -> bool:
        """Whether nothing is cheaper than a piece's own word: two words and a cut cost more."""
        return piece.explained and piece.price <= 2 * self.least + self.CUT

    def _decode_run(self, run: list[Piece], out: list[Decoded]) -> None:
        """Decodes a run, and empties it: in windows that no word reaches beyond, so that all of them together are
        what the decoder makes of the whole run."""
        if not run:
            return
        if run[-1].half:
            run.pop()
        begin = 0
        for end in range(1, len(run) + 1):
            if end < len(run) and self._over(run, end):
                continue
            window = run[begin:end]
            begin = end
            if len(window) == 1 and (self.settled(window[0]) or (window[0].explained and not window[0].word)):
                p = window[0]
                if p.word:
                    out.append(Decoded(p.tokens, [(p.word, 0, len(p.tokens) - 1, int(HYPHEN not in p.core))]))
                continue
            key = tuple((p.core, p.word, p.price) for p in window)
            if key not in self._decoded:
                if len(self._decoded) > 100_000:
                    self._decoded.clear()
                self._decoded[key] = self._changes(window)
            for a, b, words in self._decoded[key]:
                tokens = [t for p in window[a:b] for t in p.tokens]
                first = [0]
                for p in window[a:b]:
                    first.append(first[-1] + len(p.tokens))
                out.append(Decoded(tokens, [(w, first[x - a] if not late else first[x - a + 1] - 1, first[y - a + 1] - 1 if not early else first[y - a], k) for w, x, y, k, late, early in words]))
        run.clear()

    def _over(self, run: list[Piece], at: int) -> bool:
        """Whether a word may reach over the blank before a piece, of two or of several pieces."""
        x, y = run[at - 1], run[at]
        if HYPHEN in x.core or HYPHEN in y.core:
            if self._may_join(x.core.replace(HYPHEN, ""), y.core.replace(HYPHEN, ""), x.price + y.price):
                return True
        elif self.reach(x.raw, y.raw):
            return True
        # a word that begins further back
        begins = self._begins()
        for back in range(at - 2, -1, -1):
            middle = "".join(p.core for p in run[back + 1 : at]).replace(HYPHEN, "")
            if len(middle) > LONGEST + 6 or not self.reach(run[back].raw, run[back + 1].raw):
                return False
            head = run[back].core.replace(HYPHEN, "")
            if any(head[p:] + middle + y.core[0] in begins for p in range(len(head))):
                return True
        return False

    def _changes(self, window: list[Piece]) -> list[tuple[int, int, list[tuple[str, int, int, int, bool, bool]]]]:
        """(first piece, piece after the last, words with their first and last piece, misreadings, and whether they
        begin behind the hyphen of the first or end before that of the last) of the stretches of whole pieces that the
        decoder reads otherwise."""
        stream = " ".join(p.core for p in window)
        whole, at = [], 0
        for p in window:
            if p.word:
                whole.append((at, at + len(p.core), p.word, int(HYPHEN not in p.core), p.price))
            at += len(p.core) + 1
        number = np.cumsum([c == " " for c in stream]).tolist()
        out, open_words, begin = [], [], 0
        for s, e, word, k in self.alignment(stream, tuple(whole)):
            x, y = number[s], number[e - 1]
            dash = stream.rfind(HYPHEN, 0, s), stream.find(HYPHEN, e)
            late = dash[0] >= 0 and number[dash[0]] == x
            early = dash[1] >= 0 and number[dash[1]] == y
            open_words.append((word, x, y, k, late, early))
            if e == len(stream) or stream[e] == " ":
                a = number[begin]
                printed = stream[begin:e]
                cut = HYPHEN in printed
                if (cut or len(open_words) > 1 or a != y or word != printed) and (all(w in self.counts for w, *_ in open_words) or (cut and len(open_words) == 1)):
                    out.append((a, y + 1, open_words))
                open_words, begin = [], e + 1
        return out


#: Classes of how a token may begin: letters, other characters that are misread, these digits before another one, pairs
#: that are misread, all others by their code.
CLASSES, _alphabet, _digits = 80, "abcdefghijklmnopqrstuvwxyz", "0123456789"
_signs = sorted({c for s in _undo for c in s} - set(_alphabet))
_class_of = {c: k for k, c in enumerate([*_alphabet, *_signs, *sorted(_seen_2), *(c + "#" for c in _signs if c in _digits)])}
#: Costs are kept in quarters, rounded down; the second number is more than any.
_HIGHEST, _NEVER = 254, 255
_FACTOR, _BITS_64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _class(begin: str) -> int:
    two = begin[0] + "#" if begin[1:2] and begin[1] in _digits else begin[:2]
    k = _class_of.get(two, -1)
    return k if k >= 0 else _class_of.get(begin[0], len(_class_of) + ord(begin[0]) % (CLASSES - len(_class_of)))


def _plus(quarters: np.ndarray, more: int | np.ndarray) -> np.ndarray:
    """Costs with more added to them; what never happens stays so."""
    return np.where(quarters == _NEVER, _NEVER, np.minimum(quarters.astype(np.int64) + more, _HIGHEST)).astype(np.uint8)


class Seen(dict):
    """Numbers of the raw tokens that a reader has met, and bounds for what a word costs that reaches from one to
    the next: such a word goes on behind the first token with the beginning of the second, or with all of it."""

    MOST = 400_000

    def __init__(self, reader: Reader) -> None:
        self.reader, begins = reader, reader._begins()
        self.node = {part: k for k, part in enumerate(begins)}
        n, misread, cut = len(begins), int(4 * reader.MISREADING), int(4 * reader.CUT)
        # cheapest word from each beginning on, by the class of what follows as it stands
        direct = np.full((n + 1, CLASSES), _NEVER, np.uint8)
        double = {true: np.full(n + 1, _NEVER, np.uint8) for true, _ in MISREAD if len(true) == 2}
        stops, parents = np.full((2, n + 1), _NEVER, np.uint8), {}  # ... that ends here, or goes on with a digit
        hashes: dict[str, int] = {"": 0}
        for k, (part, count) in enumerate(begins.items()):
            last = part[-1]
            hashes[part] = (hashes[part[:-1]] * _FACTOR + ord(last)) & _BITS_64
            cost = min(_HIGHEST, int(4 * math.log(reader.total / count)))
            if part in reader.counts:
                stops[0, k] = min(_HIGHEST, int(4 * math.log(reader.total / reader.counts[part])) + cut)
            if len(part) > 1:
                before, c = self.node[part[:-1]], _class(last)
                direct[before, c] = min(direct[before, c], cost)
                parents.setdefault(last, ([], []))[0].append(before)
                parents[last][1].append(k)
                if last in _digits:
                    stops[1, before] = min(stops[1, before], cost)
                if len(part) > 2 and part[-2:] in double:
                    double[part[-2:]][self.node[part[:-2]]] = cost
        after = stops.min(axis=0)
        for pair in _seen_2:
            direct[:, _class(pair)] = direct[:, _class(pair[0])]
        numeric = {c: _class(c + "0") for c in _signs if c in _digits}
        for c, k in numeric.items():
            if c in parents:
                direct[parents[c][0], k] = after[parents[c][1]]
        # then with one misreading, too
        undone = direct.copy()
        for c, k in numeric.items():
            undone[:, k] = np.minimum(direct[:, k], _plus(direct[:, _class(c)], misread))
        for true, seen in MISREAD:
            cost = _plus(direct[:, _class(true)] if len(true) == 1 else double[true], misread)
            for k in [_class(seen)] + [_class(pair) for pair in _seen_2 if pair[0] == seen]:
                undone[:, k] = np.minimum(undone[:, k], cost)
            if seen in numeric and true in parents:
                before, k = parents[true][0], numeric[seen]
                undone[before, k] = np.minimum(undone[before, k], _plus(after[parents[true][1]], misread))
        self.costs = np.concatenate([undone, direct])
        # all beginnings by three bits each of their hash
        self.shift = np.uint64(64 - max(10, (64 * n).bit_length()))
        self.table = np.zeros(1 << 64 - int(self.shift), bool)
        for mix in self._MIX:
            self.table[self._place(np.array(list(hashes.values()), np.uint64), mix)] = True
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.used, self.rows_used, self.ends_used = 0, 0, 0
        self.plain, self.left, self.right = (np.zeros(1024, bool) for _ in range(3))
        self.price, self.hash, self.power = np.zeros(1024), np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.row, self.kind, self.first_end, self.n_ends = (np.zeros(1024, np.int64) for _ in range(4))
        self.bounds, self.ends = np.zeros((1024, CLASSES), np.uint8), np.zeros(4096, np.uint64)
        self.row_of: dict[str, int] = {}
        self.source: tuple[int, int] | None = None
        self.of = np.zeros(0, np.int64)
        self._fresh: list[tuple] = []
        self._cores: list[str] = []
        self._ends: list[int] = []

    _MIX = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

    def _place(self, h: np.ndarray, mix: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(mix)) >> self.shift

    def __missing__(self, token: str) -> int:
        word, explained, misread, opens, closes, core, price = self.reader._token(token)
        left, right = bool(word) and not closes and bool(core), bool(word) and not opens and bool(core)
        row = 0
        if left and (row := self.row_of.get(core, -1)) < 0:
            row = self.row_of[core] = len(self.row_of)
            self._cores.append(core)
        # of each end of the token that a word may begin with, and of all of it
        h, power, ends = 0, 1, []
        for c in reversed(core):
            h, power = (h + ord(c) * power) & _BITS_64, power * _FACTOR & _BITS_64
            ends.append(h)
        ends = ends[: LONGEST + 6] if left else []
        self._fresh.append((explained and not misread, left, right, price, h, power, row, _class(core) if right else 0, self.ends_used + len(self._ends), len(ends)))
        self._ends += ends
        self[token] = n = len(self)
        return n

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.MOST:
            self._forget()
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        self._keep()
        return out

    def translated(self, ids: np.ndarray, table: quality._Tokens) -> np.ndarray:
        """The numbers of tokens that have others in a table."""
        if len(self) > self.MOST:
            self._forget()
        if self.source != (id(table), table.age):
            self.source, self.of = (id(table), table.age), np.zeros(0, np.int64)
        if len(self.of) <= len(table):
            self.of = np.concatenate([self.of, np.full(2 * len(table) + 1 - len(self.of), -1)])
        fresh = np.unique(ids[self.of[ids] < 0]).tolist()
        for k in fresh:
            self.of[k] = self[table.names[k]]
        self._keep()
        return self.of[ids]

    def _keep(self) -> None:
        if self._fresh:
            names = ("plain", "left", "right", "price", "hash", "power", "row", "kind", "first_end", "n_ends")
            for name, values in zip(names, zip(*self._fresh)):
                self._add(name, self.used, values)
            self._add("ends", self.ends_used, self._ends)
            if self._cores:
                self._add("bounds", self.rows_used, self._bounds(self._cores))
            self.used, self.ends_used, self.rows_used = len(self), self.ends_used + len(self._ends), len(self.row_of)
            self._fresh, self._ends, self._cores = [], [], []

    def _add(self, name: str, used: int, values) -> None:
        column = getattr(self, name)
        if used + len(values) > len(column):
            column = np.concatenate([column, np.zeros((used + len(values), *column.shape[1:]), column.dtype)])
            setattr(self, name, column)
        column[used : used + len(values)] = np.array(values, column.dtype) if len(values) else column[:0]

    def _bounds(self, cores: list[str]) -> np.ndarray:
        """For each class of what follows: what a word costs at least that begins with the token or within it and goes on."""
        r, get, begins, direct = self.reader, self.node.get, self.node, len(self.node) + 1
        whole, within, misread = int(4 * r.JOIN), int(4 * (r.JOIN + r.CUT)), int(4 * r.MISREADING)
        nodes, more, first = [], [], []  # rows of the table, what comes on top of them, and the first of each core
        for core in cores:
            first.append(len(nodes))
            nodes.append(len(begins))
            more.append(0)
            least = max(0, len(core) - LONGEST - 7)  # no beginning is longer, nor with a pair for a letter
            for p in range(least, len(core)):
                if (k := get(core[p:])) is not None:
                    nodes.append(k)
                    more.append(within if p else whole)
            for i, letter in enumerate(core):
                if letter not in _suspect:
                    continue
                seen = core[i : i + 2]
                readings = [(true, 1) for true in _undo.get(letter, ())] + [(true, 2) for true in (_undo[seen] if seen in _seen_2 else ())]
                for p in range(least, i + 1) if readings else ():
                    if p < i and core[p:i] not in begins:
                        continue
                    for true, n in readings:
                        if (k := get(core[p:i] + true + core[i + n :])) is not None:
                            nodes.append(direct + k)
                            more.append((within if p else whole) + misread)
        rows, more = self.costs[nodes], np.array(more, np.uint8)[:, None]
        return np.minimum.reduceat(np.where(rows == _NEVER, rows, np.minimum(rows, _HIGHEST - more) + more), first, axis=0)

    def may(self, left: str, right: str, x: str, y: str, price: float) -> bool:
        """near for one pair; True for tokens that have no number."""
        a, b = self.get(left), self.get(right)
        if a is None or b is None or max(a, b) >= self.used:
            return True
        bound = self.bounds[self.row[a], self.kind[b]]
        if bound != _NEVER and 4 * (price + 1e-6) > bound:
            return True
        begins = self.node
        return any(x[p:] + y in begins for p in range(len(x)))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether reach may hold for tokens a followed by tokens b."""
        r = self.reader
        price = self.price[a] + self.price[b]
        out = self.left[a] & self.right[b] & (price > r.JOIN + r.least - 1e-6)
        some = np.flatnonzero(out)
        a, b, price = a[some], b[some], price[some]
        bound = self.bounds[self.row[a], self.kind[b]]
        maybe = (4 * (price + 1e-6) > bound) & (bound != _NEVER)
        # beginnings that hold all of the second token
        cheap = price <= r.JOIN + r.CUT + r.least - 1e-6  # nothing but all of the first token may come before it
        n = self.n_ends[a]
        first = self.first_end[a]
        first, n = np.where(cheap, first + n - 1, first), np.where(cheap, np.minimum(n, 1), n)
        n = np.where(maybe, 0, n)
        pair = np.repeat(np.arange(len(a)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[pair]
        h = self.ends[place] * self.power[b[pair]] + self.hash[b[pair]]
        for mix in self._MIX:
            there = self.table[self._place(h, mix)]
            h, pair = h[there], pair[there]
        maybe[pair] = True
        out[some] = maybe
        return out


class Piece(NamedTuple):
    """A token of a run, or the two parts of a word cut by a hyphen: places (line, place in the line), the raw token, its
    characters (parts with HYPHEN between them), whether the lexicon explains it, what it is read as if not as printed,
    what that costs, whether its second part is missing, and whether the run goes on behind it."""

    tokens: list[tuple[int, int]]
    raw: str
    core: str
    explained: bool = False
    word: str | None = None
    price: float = 0.0
    half: bool = False
    open: bool = True


class Decoded(NamedTuple):
    """Tokens (line, place in the line) and the words they are read as, each with its first and last of these tokens
    and its misreadings."""

    tokens: list[tuple[int, int]]
    words: list[tuple[str, int, int, int]]


def mostly_letters(core: str) -> bool:
    """Whether a token may be words: letters, with signs that letters are misread as, but no number."""
    return len(core) > 1 and sum(map(str.isalpha, core)) >= max(2, (len(core) + 1) // 2)


def word_like(word: str) -> bool:
    return all(c.isalpha() or c in "-'’" for c in word)


# --- lines at the edge of a page --------------------------------------------------------------------------------

_page_words = re.compile(r"^(?:page|pagina|página|seite|pg|p|s|no|nr|стр|с)\b\.?\s*", re.I)
_of = re.compile(r"(?:\s*(?:of|von|de|sur|из|/)\s*|\s*/\s*)[0-9lio|!s]{1,6}$", re.I)
_as_digit = str.maketrans({"l": "1", "i": "1", "|": "1", "!": "1", "o": "0", "s": "5", "b": "6", "g": "9", "q": "9", "z": "2"})
_as_roman = str.maketrans({"1": "i", "|": "i", "!": "i", "l": "i"})
_roman = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
_number_beside = re.compile(r"^\S{1,6}\s{2,}(?=\S{3})|\s{2,}\S{1,6}$")
_not_letter = re.compile(r"[^a-zà-ɏЀ-ӿ]+")
_letters_of = str.maketrans({"0": "o", "1": "l", "|": "r", "!": "i", "@": "a", "5": "s", "7": "t", "9": "g", "6": "b", "(": "c"})


def roman(number: int) -> str:
    out = ""
    for value, sign in _roman:
        out += sign * (number // value)
        number %= value
    return out


def roman_value(sign: str) -> int | None:
    """The number of a Roman numeral in lower case; None if it is none."""
    value, at = 0, 0
    for n, part in _roman:
        while sign.startswith(part, at):
            value, at = value + n, at + len(part)
    return value if at == len(sign) and 0 < value < 4000 and roman(value) == sign else None


def printed_numbers(line: str) -> set[int]:
    """The numbers that a line may show which holds nothing but a page number: digits or Roman, with words and
    strokes around it, spaced or misread."""
    if len(line) > 24:
        return set()
    s = line.strip().lower().strip("-—–[](){}<>~*·•.:= \t")
    s = _of.sub("", _page_words.sub("", s)).strip("-—–[](){}<>~*·•.:= \t").replace(" ", "")
    if not s or len(s) > 12:
        return set()
    digits, as_roman = s.translate(_as_digit), s.translate(_as_roman)
    out = {int(digits)} if digits.isascii() and digits.isdigit() else set()
    out |= {v for r in (s, as_roman) if (v := roman_value(r))}
    return out


def is_page_number(line: str, page: int) -> bool:
    return page in printed_numbers(line)


def edge_key(line: str) -> str | None:
    """What a heading is compared by: its letters without a page number beside it; None for what can be none."""
    s = line.strip()
    if not 5 <= len(s) <= 80:
        return None
    s = _not_letter.sub("", _number_beside.sub("", s).lower().translate(_letters_of))
    return s if len(s) >= 6 else None


# --- pages ------------------------------------------------------------------------------------------------------

_right_part = re.compile(r"^[^\W\d_]+(?:['’-][^\W\d_]+)*")
_left_part = re.compile(r"([^\s]+)[" + HYPHENS + r"]\s*$")


def cut_words(lines: list[str], reader: Reader) -> list[tuple[int, str]]:
    """(line, whole word) of the words cut at line ends."""
    out = []
    for i in range(len(lines) - 1):
        line = lines[i].rstrip()
        if not line or line[-1] not in HYPHENS or len(line) < 3 or not line[-2].isalpha():
            continue
        after = lines[i + 1].lstrip()
        left, right = _left_part.search(line), _right_part.match(after) or re.match(r"^\S+", after)
        if left and right:
            a, b = left.group(1).lower().lstrip(_wide_edge), right.group().lower().rstrip(_wide_edge)
            if a and b and any(c.isalpha() for c in b):
                out.append((i, reader.joined(a, b)))
    return out


def scan_page(text: str, page: int, reader: Reader, marks: tuple[list[int], list[int]] | None = None) -> list[tuple[int, str, str, str]]:
    """(line number, kind, word, key) of the damaged places of a page. Lines that may be headings come with the
    kind edge (weak, if they end like a sentence) and what they are compared by; lone numbers other than the
    page's with the kind numbered and by how much they differ."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    rows: list[tuple[int, str, str, str]] = []
    numbers = set()
    for i in dict.fromkeys(filled[:2] + filled[-2:]):
        shown = printed_numbers(lines[i])
        if shown:
            numbers.add(i)
            own = page in shown
            rows.append((i + 1, "page_number" if own else "numbered", "", "" if own else str(min(shown) - page)))
    body = [i for i in filled if i not in numbers]
    for i in dict.fromkeys(body[:1] + body[-1:]):
        if key := edge_key(lines[i]):
            rows.append((i + 1, "weak" if lines[i].rstrip()[-1] in ".?;:,!" + HYPHENS else "edge", "", key))
    cut = cut_words(lines, reader)
    starts = {i for i, _ in cut}
    decoded = reader.decoded(lines, starts, frozenset(numbers | {i + 1 for i in numbers}), marks)
    # a word cut twice, or by a page number, is in no stream
    done = {i for d in decoded for i, _ in d.tokens if len({i for i, _ in d.tokens}) > 1}
    rows += [(i + 1, "hyphen", w, "") for i, w in cut if i not in done]
    for d in decoded:
        for word, first, last, misread in d.words:
            i = d.tokens[first][0]
            if i != d.tokens[last][0]:  # cut at the line's end without a hyphen
                rows.append((i + 1, "hyphen", word, ""))
            elif misread and i not in numbers:
                rows.append((i + 1, "char", word, ""))
    return rows


def scan_pages(texts: list[str], pages: list[int], reader: Reader, common: frozenset[str], model: boosting.Booster) -> Iterator[tuple[int, list[tuple[int, str, str, str]]]]:
    """(place, scan_page) of the prose among many pages."""
    for s in range(0, len(texts), quality.PORTION):
        part = quality.portion(texts[s : s + quality.PORTION], common)
        prose = _is_prose(part.stats, model)
        kept = np.repeat(prose, [sum(map(len, split)) for split in part.split])
        places = np.flatnonzero(prose).tolist()
        marks = reader.marked([part.split[i] for i in places], part.ids[kept], part.table)
        yield from ((s + i, scan_page(texts[s + i], pages[s + i], reader, m)) for i, m in zip(places, marks))


def lexicon(pages: DataFrame, size: int = LEXICON, least: int = LEAST) -> dict[str, int]:
    """Counts of the most frequent words over all pages. Each task counts what it reads; words are then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        for batch in batches:
            # the same blanks as those of str.split
            seen = pc.utf8_split_whitespace(batch.column(0)).flatten().value_counts()
            for token, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                raw[token] += n
        counts: Counter = Counter()
        for token, n in raw.items():
            core = token.lower().strip(_wide_edge)
            if 1 < len(core) <= LONGEST + 6 and any(map(str.isalpha, core)):
                counts[core] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    words = pages.where("text IS NOT NULL").select("text").mapInArrow(run, "word string, n bigint")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size)
    got = top.toArrow()
    return dict(zip(got["word"].to_pylist(), got["n"].to_pylist()))


_readers: dict[int, Reader] = {}


def _reader(sent) -> Reader:
    key = id(sent.value)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(sent.value)
    return _readers[key]


def _prose(texts: list[str], common: frozenset[str], model: boosting.Booster) -> np.ndarray:
    """Which texts are no case of p1."""
    return _is_prose(quality.batch_stats(texts, common), model)


def _is_prose(stats: np.ndarray, model: boosting.Booster) -> np.ndarray:
    return ~((stats[:, 0] >= quality.MIN_CHARS) & (quality.probability(model, stats) > 0.5))


def scanned(pages: DataFrame, words: DataFrame, counts: dict[str, int] | None = None, model: boosting.Booster | None = None) -> DataFrame:
    """doc_id, page_number, line_no, kind, word, key of scan_page on prose pages. What is no prose isn't
    decoded: its tokens are hardly ever seen before."""
    common = quality.common_set(words)
    model = quality.fit(pages, common) if model is None else model
    sent = pages.sparkSession.sparkContext.broadcast(lexicon(pages) if counts is None else counts)
    names = ["doc_id", "page_number", "line_no", "kind", "word", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(sent)
        for batch in batches:
            docs, numbers, texts = (batch.column(k).to_pylist() for k in range(3))
            rows = [(docs[i], numbers[i], *r) for i, page in scan_pages(texts, numbers, reader, common, model) for r in page]
            if rows:
                columns = list(zip(*rows))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = pages.select("doc_id", F.col("page_number").cast("int"), "text").where("doc_id IS NOT NULL AND page_number IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id string, page_number int, line_no int, kind string, word string, key string").distinct()


def headings(edges: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no of the edge lines (doc_id, page_number, line_no, kind, key) that recur.

    A key that stands on two pages of its document is a heading; a line of another key is one too if it differs
    little from a heading of its document. Only lines that share six letters in place are compared; where no key
    recurs, the document's lines are compared with one another. Weak lines never make a heading."""
    strong = F.when(F.col("kind") == "edge", F.col("page_number"))
    keys = edges.groupBy("doc_id", "key").agg(F.min("page_number").alias("page"), F.min(strong).alias("first"), F.max(strong).alias("last"))
    keys = keys.withColumn("recurs", F.coalesce(F.col("first") < F.col("last"), F.lit(False)))
    # by aggregation and join: a window over a document would gather all its lines in one task
    keys = keys.join(keys.groupBy("doc_id").agg(F.bool_or("recurs").alias("any")), "doc_id")
    parts = F.array(
        F.concat(F.lit("a"), F.left("key", F.lit(6))), F.concat(F.lit("b"), F.right("key", F.lit(6))),
        F.concat(F.lit("c"), F.substring("key", 7, 6)), F.concat(F.lit("d"), F.substring("key", -12, 6)),
    )
    cut = keys.withColumn("part", F.explode(F.array_distinct(parts)))
    # the lines of one document may be a third of all: they are salted, the headings go to every salt
    loose = cut.where("NOT recurs").select("doc_id", "part", "key", "page", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    heads = cut.where("recurs OR (first IS NOT NULL AND NOT any)").select("doc_id", "part", F.col("key").alias("head"), F.col("first").alias("head_page"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    near = F.levenshtein("key", "head") <= F.greatest(F.lit(2), F.floor(F.length("head") * 0.2).cast("int"))
    close = loose.join(heads, ["doc_id", "part", "salt"]).where((F.col("key") != F.col("head")) & (F.col("page") != F.col("head_page")) & near).select("doc_id", "key")
    good = keys.where("recurs").select("doc_id", "key").union(close).distinct()
    return edges.join(good, ["doc_id", "key"], "left_semi").select("doc_id", "page_number", "line_no")


def found(pages: DataFrame, words: DataFrame, counts: dict[str, int] | None = None, model: boosting.Booster | None = None) -> DataFrame:
    """doc_id, page_number, line_no, kind, word of the damaged places of prose pages. A place on a heading line is
    none of its own. Repeated rows count once; null texts and keys give nothing; an empty table gives no row."""
    rows = staged(scanned(pages, words, counts, model), "scanned")
    heads = staged(headings(rows.where("kind IN ('edge', 'weak')").select("doc_id", "page_number", "line_no", "kind", "key")), "heads")
    # numbers that run beside the page numbers at a distance are the pages' printed numbers
    shifted = rows.where("kind = 'numbered'")
    runs = shifted.groupBy("doc_id", "key").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b")).where("a < b")
    printed = shifted.join(runs, ["doc_id", "key"], "left_semi").withColumn("kind", F.lit("page_number"))
    places = rows.where("kind IN ('hyphen', 'char', 'page_number')").unionByName(printed).select("doc_id", "page_number", "line_no", "kind", "word")
    places = places.join(heads, ["doc_id", "page_number", "line_no"], "left_anti")
    return places.unionByName(heads.select("doc_id", "page_number", "line_no", F.lit("header").alias("kind"), F.lit("").alias("word")).distinct())


# --- paragraphs -------------------------------------------------------------------------------------------------


def paragraph_breaks(lines: list[str], gaps: list[bool]) -> list[bool]:
    """Before which lines a paragraph begins, given before which an empty line stands: the cheapest way to cut
    the lines, where a break costs less behind an empty line or a short line that ends a sentence and more inside
    a sentence, and a paragraph of one line costs a little more."""
    n = len(lines)
    width = float(np.median([len(x) for x in lines])) if n else 0.0

    def price(i: int) -> float:
        before, here = lines[i - 1].rstrip(), lines[i].lstrip()
        ended = before[-1:] in ".!?;:。！？\"'”’)"
        cost = 3.0 - 4.0 * gaps[i] - 1.5 * ended - 1.5 * (ended and len(before) < 0.75 * width)
        return cost + 2.0 * here[:1].islower() + 3.0 * (before[-1:] in HYPHENS + ",")

    # a break that isn't taken costs what it would have saved: with the sums of these, the cheapest start of a
    # paragraph of several lines is a running minimum
    prices = [0.0] + [price(i) for i in range(1, n)]
    missed = [0.0] * (n + 1)
    for i in range(1, n):
        missed[i + 1] = missed[i] + max(0.0, -prices[i])
    best = [0.0] + [math.inf] * n  # cheapest cutting of the first i lines
    back = [0] * (n + 1)
    cheapest, start = math.inf, 0  # of the starts before the last line, less what is missed up to them
    for end in range(1, n + 1):
        last = end - 1
        best[end], back[end] = best[last] + prices[last] + 0.4, last
        if cheapest + missed[end] < best[end] - 1e-9:
            best[end], back[end] = cheapest + missed[end], start
        here = best[last] + prices[last] - missed[last + 1]
        if here <= cheapest + 1e-9:
            cheapest, start = here, last
    out, at = [False] * n, n
    while at:
        at = back[at]
        out[at] = True
    return out


def _kept(text: str, dropped: set[int]) -> list[int]:
    return [i for i, x in enumerate(text.split("\n")) if x.strip() and i not in dropped]


def repaired(text: str, reader: Reader, dropped: set[int], marks: tuple[list[int], list[int]] | None = None) -> list[str]:
    """The paragraphs of a page: without the dropped lines (numbered from 0), cut words joined, misread words and
    words run together put right. Capital letters at a word's start and punctuation around it stay."""
    raw = text.split("\n")
    kept = _kept(text, dropped)
    lines = [raw[i].strip() for i in kept]
    gaps = [k > 0 and any(not raw[j].strip() for j in range(kept[k - 1] + 1, i)) for k, i in enumerate(kept)]
    breaks = paragraph_breaks(lines, gaps)
    cut = dict(cut_words(lines, reader))
    out: list[list[str]] = []
    carry = ""
    decoded: dict[tuple[int, int], str] = {}
    for d in reader.decoded(lines, set(cut), frozenset(k for k, gap in enumerate(gaps) if gap), marks):
        (i, k), raw = d.tokens[0], [lines[i].split()[k] for i, k in d.tokens]
        if len(d.words) == 1 and len(raw) == 2 and i in cut and k == len(lines[i].split()) - 1:
            cut[i] = d.words[0][0]
            continue
        for i, k in d.tokens:
            if i in cut and k == len(lines[i].split()) - 1:
                del cut[i]
        decoded |= dict.fromkeys(d.tokens, "")
        decoded[d.tokens[0]] = _as_written(raw, [w for w, *_ in d.words]) if len(raw) > 1 or len(d.words) > 1 else _put_right(raw[0], d.words[0][0])
    for k, line in enumerate(lines):
        if breaks[k] and not carry or not out:
            out.append([])
        tokens = line.split()
        if carry and tokens:
            tail = _right_part.match(tokens[0])
            tokens[0] = carry + (tokens[0][tail.end() :] if tail else "")
            carry = ""
        if k in cut:
            head = _left_part.search(line)
            first = head.group(1).lstrip(_wide_edge)[:1] if head else ""
            lead = head.group(1)[: len(head.group(1)) - len(head.group(1).lstrip(_wide_edge))] if head else ""
            carry = lead + (cut[k].capitalize() if first.isupper() else cut[k])
            tokens = tokens[:-1]
        out[-1] += [x for p, t in enumerate(tokens) if (x := decoded[k, p] if (k, p) in decoded else t)]
    if carry:
        out[-1].append(carry)
    return [" ".join(p) for p in out if p]


def _put_right(token: str, word: str) -> str:
    # what stands around the word are the edge characters that are no misread letters
    lead = token[: len(token) - len(token.lstrip(_edge))]
    trail = token[len(token.rstrip(_edge)) :]
    bare = token[len(lead) : len(token) - len(trail)]
    if len(bare) > 1 and bare.upper() == bare and bare.lower() != bare and sum(map(str.isalpha, bare)) > 2:
        word = word.upper()
    elif bare[:1].isupper():
        word = word[:1].upper() + word[1:]
    return lead + word + trail


def _as_written(tokens: list[str], words: list[str]) -> str:
    """Decoded words with the capital letters of their tokens and what stands around these."""
    first, last = tokens[0], tokens[-1]
    lead = first[: len(first) - len(first.lstrip(_wide_edge))]
    trail = last[len(last.rstrip(_wide_edge)) :]
    letters = "".join(t.strip(_wide_edge + HYPHENS) for t in tokens)
    if letters.lower() == "".join(words) and len(letters.lower()) == len(letters):
        ends = np.cumsum([len(w) for w in words]).tolist()
        return lead + " ".join(letters[e - len(w) : e] for e, w in zip(ends, words)) + trail
    text = " ".join(words)
    if len(letters) > 1 and letters.upper() == letters and letters.lower() != letters:
        text = text.upper()
    elif letters[:1].isupper():
        text = text[:1].upper() + text[1:]
    return lead + text + trail


def paragraphs(pages: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page_number, paragraph_no, text of all prose pages, repaired; on most of them that is only that broken
    lines become paragraphs. The latest text of a page counts; blank pages give no row."""
    counts = lexicon(pages)
    common = quality.common_set(words)
    model = quality.fit(pages, common)
    places = found(pages, words, counts, model).where("kind IN ('header', 'page_number')")
    by_page = places.groupBy("doc_id", "page_number").agg(F.collect_set("line_no").alias("dropped"))
    sent = pages.sparkSession.sparkContext.broadcast(counts)
    rows = latest_pages(pages).where("text IS NOT NULL").join(by_page, ["doc_id", "page_number"], "left")
    rows = rows.select("doc_id", F.col("page_number").cast("int"), "text", F.coalesce("dropped", F.array().cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(sent)
        for batch in batches:
            out = []
            docs, numbers, texts, drop = (batch.column(k).to_pylist() for k in range(4))
            prose = np.flatnonzero(_prose(texts, common, model)).tolist()
            for s in range(0, len(prose), quality.PORTION):
                part = [(i, {n - 1 for n in drop[i]}) for i in prose[s : s + quality.PORTION]]
                split = [texts[i].split("\n") for i, _ in part]
                marks = reader.marked([[lines[k].split() for k in _kept(texts[i], gone)] for lines, (i, gone) in zip(split, part)])
                for (i, gone), m in zip(part, marks):
                    out += [(docs[i], numbers[i], k, p) for k, p in enumerate(repaired(texts[i], reader, gone, m))]
            if out:
                columns = list(zip(*out))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "page_number", "paragraph_no", "text"])

    return rows.mapInArrow(run, "doc_id string, page_number int, paragraph_no int, text string")
