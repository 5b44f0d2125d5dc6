"""Licence scan by patience alignment.

For each notice, the words that occur once in a stretch of the text and once in
the notice are anchors; the longest increasing subsequence of their places is
matched, and the gaps between the matches are aligned in the same way. Coverage
is the share of the notice's words that are matched.

Exact tests spare most texts the alignment. Any ``least`` share of a notice
must contain one of a few of its longest words, so texts without all of these
pass at once. And the words that the notice and the whole text, or a window of
twice the notice's length, have in common, with their numbers, bound the coverage
from above; where the bound stays under ``least`` nothing is aligned. Of the
windows of a notice of ``LONG`` words or more, one in each sixteenth of its length
is aligned, and the last of each run: any match within a window less a sixteenth
lies whole in one of them.

Whole texts are searched for every occurrence of every notice: the search goes on
behind each match. In short notices the words that tell licences apart (a version, a
family, an attribute) must be among the matched ones, and no attribute of another
licence may stand between them. Of matches that overlap the one with most matched
words (then of higher coverage, then first by name) stays, so that a notice does not
hide a longer one that contains it; what lost to it is searched again in the gaps.

Defined cases: a null or empty text has no licences; equal rows get equal rows;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tarnflow.llm.common import map_texts
from tarnflow.llm.license_texts import ATTRIBUTES, FAMILIES, NOTICES

#: Notices of so many words have their windows aligned in steps.
LONG = 128

WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for k, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            ends.append(k)
        else:
            tops[pile], ends[pile] = value, k
        back[k] = ends[pile - 1] if pile else -1
    found, at = [], ends[-1] if ends else -1
    while at >= 0:
        found.append(at)
        at = back[at]
    return found[::-1]


def patience(text: list[str], notice: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in notice), both increasing."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(notice))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == notice[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        once = {word for word, n in Counter(notice[c:d]).items() if n == 1} & {word for word, n in Counter(text[a:b]).items() if n == 1}
        place = {word: k for k, word in enumerate(text[a:b], a) if word in once}
        anchors = [(place[word], k) for k, word in enumerate(notice[c:d], c) if word in once]
        kept = [anchors[k] for k in longest_increasing([x for x, _ in anchors])]
        matched += kept
        if kept:
            edges = [(a - 1, c - 1), *kept, (b, d)]
            gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(matched)


@dataclass(frozen=True)
class Notice:
    name: str
    words: tuple[str, ...]
    #: One of these is in every text that covers ``least`` of the notice.
    signs: tuple[str, ...]
    #: Each of these must be matched.
    required: frozenset[str]
    #: None of these may stand unmatched within the match.
    barred: frozenset[str]
    counts: Counter[str] = field(compare=False)


@dataclass(frozen=True)
class Match:
    name: str
    coverage: float
    start: int
    end: int
    #: Matched words.
    matched: int


@lru_cache(maxsize=4)
def notices(least: float) -> tuple[Notice, ...]:
    found = []
    for name, text in NOTICES.items():
        words = words_of(text)
        order = sorted(words, key=lambda w: (-len(w), w))
        signs = order[: len(words) - needed(len(words), least) + 1]
        known = set(words)
        version = {x for v in re.findall(r"\d+(?:\.\d+)?", name) for x in (v, v.removesuffix(".0"))}
        required = known & (FAMILIES | ATTRIBUTES | version) if len(words) < LONG else set()
        barred = ATTRIBUTES - known if len(words) < LONG else set()
        found.append(Notice(name, tuple(words), tuple(dict.fromkeys(signs)), frozenset(required), frozenset(barred), Counter(words)))
    return tuple(found)


@lru_cache(maxsize=None)
def needed(n: int, least: float) -> int:
    """The smallest number of matched words with a coverage of ``least``."""
    return next(k for k in range(n + 1) if k >= least * n - 1e-9)


def windows(words: list[str], notice: Notice, least: float, places: list[int], first: int = 0) -> Iterator[tuple[int, int]]:
    """Windows of up to twice the notice's length that have enough words in common
    with it, all or in steps; each starts and ends with such a word. ``places`` are
    those of all words of the notice; ``first`` is the one to start from."""
    want = notice.counts
    goal, span = needed(len(notice.words), least), 2 * len(notice.words)
    step = len(notice.words) // 16 if len(notice.words) >= LONG else 1
    have: Counter[str] = Counter()
    common, low, due = 0, first, 0
    passed: tuple[int, int] | None = None
    for k in range(first, len(places)):
        at = places[k]
        word = words[at]
        have[word] += 1
        common += have[word] <= want[word]
        while at - places[low] >= span:
            gone = words[places[low]]
            common -= have[gone] <= want[gone]
            have[gone] -= 1
            low += 1
        if common >= goal:
            passed = places[low], at + 1
            if at >= due:
                yield passed
                passed, due = None, at + step
        elif passed:
            yield passed
            passed, due = None, 0
        else:
            due = 0
    if passed:
        yield passed


@lru_cache(maxsize=4)
def vocabulary(least: float) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Number of each word of any notice; how often each notice (column) has it; the
    matched words that each notice needs."""
    known = notices(least)
    number = {word: k for k, word in enumerate(sorted({word for x in known for word in x.counts}))}
    times = np.zeros((len(number), len(known)), dtype=np.int32)
    for column, x in enumerate(known):
        for word, n in x.counts.items():
            times[number[word], column] = n
    return number, times, np.array([needed(len(x.words), least) for x in known])


def may_be_covered(words: list[str], least: float) -> list[Notice]:
    """The notices that have enough words in common with the text, with their numbers."""
    number, times, goals = vocabulary(least)
    have = Counter(number[word] for word in words if word in number)
    at = np.fromiter(have.keys(), dtype=np.int64, count=len(have))
    common = np.minimum(times[at], np.fromiter(have.values(), dtype=np.int32, count=len(have))[:, None]).sum(axis=0)
    return [notices(least)[k] for k in np.flatnonzero(common >= goals)]


def match_in(words: list[str], notice: Notice, low: int, high: int, least: float) -> Match | None:
    """The alignment of the notice with a window, if it covers enough and what it must."""
    pairs = patience(words[low:high], list(notice.words))
    if len(pairs) < needed(len(notice.words), least):
        return None
    if not notice.required <= {notice.words[k] for _, k in pairs}:
        return None
    start, end = low + pairs[0][0], low + pairs[-1][0] + 1
    if not notice.barred.isdisjoint(words[start:end]):
        return None
    return Match(notice.name, len(pairs) / len(notice.words), start, end, len(pairs))


def tightest(words: list[str], notice: Notice, match: Match, least: float) -> Match:
    """The match from the last place on from which as many words are matched: the start
    of one occurrence may else be joined to the end of the next."""
    for low in range(match.end - match.matched, match.start, -1):
        later = match_in(words, notice, low, match.end, least)
        if later and later.matched >= match.matched:
            return later
    return match


def matches_of(words: list[str], notice: Notice, least: float) -> Iterator[Match]:
    """All occurrences in order, without overlaps: from where one ends the search
    starts anew. Of overlapping stretches the first of highest coverage counts."""
    places = [k for k, word in enumerate(words) if word in notice.counts]
    first = 0
    while first < len(places):
        found = None
        for low, high in windows(words, notice, least, places, first):
            if found and low >= found.end:
                break
            match = match_in(words, notice, low, high, least)
            if not match or (found and match.matched <= found.matched):
                continue
            if match.end - match.start > len(notice.words) and len(notice.words) < LONG:
                match = tightest(words, notice, match, least)
            if found and match.start >= found.end:
                break
            found = match
            if match.matched == len(notice.words):
                break
        if not found:
            return
        yield found
        first = bisect_left(places, found.end)


def without_overlaps(found: list[Match], kept: list[Match]) -> list[Match]:
    """``kept`` (in order, without overlaps) and all of ``found`` that fit in, best
    first: identifier lines, then by matched words."""
    starts = [m.start for m in kept]
    for match in sorted(found, key=lambda m: (not m.name.endswith("-spdx"), -m.matched, -m.coverage, m.name, m.start)):
        at = bisect_left(starts, match.end)
        if not at or kept[at - 1].end <= match.start:
            kept.insert(at, match)
            starts.insert(at, match.start)
    return kept


def scan(text: str, least: float = 0.8) -> list[Match]:
    """The notices that a whole text covers, every occurrence, in order of place."""
    words = words_of(text)
    wanted = [x for x in may_be_covered(words, least) if not set(x.signs).isdisjoint(words)]
    gaps, kept = [(0, len(words))], []
    while wanted:
        found = []
        for low, high in gaps:
            part = words[low:high]
            for notice in wanted:
                if len(part) >= needed(len(notice.words), least):
                    found += [replace(m, start=m.start + low, end=m.end + low) for m in matches_of(part, notice, least)]
        kept = without_overlaps(found, kept)
        # what a better match hid may also occur beside it
        lost = {m.name for m in set(found) - set(kept)}
        wanted = [x for x in wanted if x.name in lost]
        edges = [0, *(x for m in kept for x in (m.start, m.end)), len(words)]
        gaps = list(zip(edges[::2], edges[1::2]))
    return kept


def scan_licenses(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, n_licenses, licenses, coverage, matches`` of every row: a narrow pass."""

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        found = [scan(text, least) for text in texts]
        return {
            "doc_id": ids,
            "n_licenses": [len(x) for x in found],
            "licenses": [",".join(m.name for m in x) for x in found],
            "coverage": [max((m.coverage for m in x), default=0.0) for x in found],
            "matches": [[{"name": m.name, "coverage": m.coverage, "start": m.start, "end": m.end} for m in x] for x in found],
        }

    return map_texts(docs, work, "doc_id long, n_licenses long, licenses string, coverage double, matches array<struct<name: string, coverage: double, start: long, end: long>>")
