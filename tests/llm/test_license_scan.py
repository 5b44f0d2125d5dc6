import itertools
import random

from tarnflow.llm import license_scan as ls


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(300):
        values = rng.sample(range(30), rng.randrange(9))
        found = [values[k] for k in ls.longest_increasing(values)]
        assert found == sorted(found)
        best = max(len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c))
        assert len(found) == best


def plain_patience(text, notice):
    """The same alignment by recursion over slices."""
    for k in (0, -1):
        if text and notice and text[k] == notice[k]:
            return 1 + plain_patience(*((text[1:], notice[1:]) if k == 0 else (text[:-1], notice[:-1])))
    anchors = [(text.index(w), k) for k, w in enumerate(notice) if notice.count(w) == 1 and text.count(w) == 1]
    if not anchors:
        return 0
    kept = [anchors[k] for k in ls.longest_increasing([x for x, _ in anchors])]
    edges = [(-1, -1), *kept, (len(text), len(notice))]
    return len(kept) + sum(plain_patience(text[x + 1 : y], notice[u + 1 : v]) for (x, u), (y, v) in zip(edges, edges[1:]))


def test_patience_equals_recursion():
    rng = random.Random(2)
    for _ in range(500):
        text, notice = ([rng.choice("abcdefgh") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = ls.patience(text, notice)
        assert all(text[x] == notice[y] for x, y in pairs)
        assert all(p < q and u < v for (p, u), (q, v) in zip(pairs, pairs[1:]))
        assert len(pairs) == plain_patience(text, notice)


def test_the_quick_tests_lose_nothing():
    """Every stretch that covers a notice passes the signs and the window's bound."""
    rng = random.Random(3)
    for notice in ls.notices(0.8):
        for _ in range(40):
            words = [w for w in notice.words if rng.random() > 0.15]
            if len(words) < ls.needed(len(notice.words), 0.8):
                continue
            text = ["filler"] * rng.randrange(40) + words + ["the"] * rng.randrange(40)
            assert set(words) & set(notice.signs)
            whole = ls.match_in(words, notice, 0, len(words), 0.8)
            assert not whole or next(ls.matches_of(text, notice, 0.8)).coverage >= 0.8


def test_every_notice_is_found_in_long_text():
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice("the of license under version public released mit domain copy notice".split()) + rng.choice(["", ".", "x"]) for _ in range(n))
    for name, notice in ls.NOTICES.items():
        text = f"{filler(3000)}\n{notice.upper()}\n{filler(3000)}"
        assert name in {m.name for m in ls.scan(text)}, name
        (match,) = [m for m in ls.scan(f"own words. {notice} more own words.") if m.coverage == 1]
        assert (match.name, match.start) == (name, 2)


def test_all_occurrences_of_all_notices():
    names = lambda text: [m.name for m in ls.scan(text)]
    lesser, plain = ls.NOTICES["LGPL-3.0-notice"], ls.NOTICES["GPL-3.0-notice"]
    assert names(f"{lesser}\n{plain}") == ["LGPL-3.0-notice", "GPL-3.0-notice"]
    assert names(f"{plain}\n{lesser}") == ["GPL-3.0-notice", "LGPL-3.0-notice"]
    mit = ls.NOTICES["MIT-notice"]
    assert names(f"{mit} {mit} and some other words, then {mit}") == ["MIT-notice"] * 3
    assert names("word " * 50 + f"{mit}\n" * 400) == ["MIT-notice"] * 400
    header = ls.NOTICES["Apache-2.0-header"]
    assert names(f"{ls.NOTICES['Apache-2.0']} text {header} text {ls.NOTICES['Apache-2.0']}") == ["Apache-2.0", "Apache-2.0-header", "Apache-2.0"]


def test_words_that_tell_licences_apart():
    names = lambda text: [m.name for m in ls.scan(text)]
    assert names("Licensed under CC BY-NC-SA 4.0.") == []
    assert names("Licensed under CC BY 3.0.") == []
    assert names("Licensed under CC BY-NC 4.0") == ["CC-BY-NC-4.0"]
    assert names("This work is licensed under the GNU Affero General Public License, version 2.") == []
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-notice"]
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.") == ["CC-BY-NC-SA-4.0-notice"]
    assert names(ls.NOTICES["BSD-3-Clause"]) == ["BSD-3-Clause"]
    assert names(ls.NOTICES["BSD-3-Clause-text"]) == ["BSD-3-Clause-text"]
    assert names(ls.NOTICES["BSD-2-Clause-text"]) == ["BSD-2-Clause-text"]


def test_matches_against_all_stretches():
    """Of random texts with notices in them, what is found is what brute force over all
    stretches up to twice a notice's length finds, occurrence by occurrence."""
    rng = random.Random(7)
    some = [x for x in ls.notices(0.8) if len(x.words) < 20]
    for _ in range(60):
        notice = rng.choice(some)
        text = []
        for _ in range(rng.randrange(4)):
            text += [rng.choice(["own", "words", "the", "license"]) for _ in range(rng.randrange(2 * len(notice.words), 50))]
            text += [w for w in notice.words if rng.random() > 0.08]
        text += ["end"] * 30
        spans = [(a, b) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 2 * len(notice.words)) + 1)]
        good = [m for a, b in spans if (m := ls.match_in(text, notice, a, b, 0.8))]
        groups, end = [], -1
        for m in sorted(good, key=lambda m: m.start):
            if m.start >= end:
                groups.append([])
            groups[-1].append(m)
            end = max(end, m.end)
        found = list(ls.matches_of(text, notice, 0.8))
        assert len(found) == len(groups)
        for match, group in zip(found, groups):
            assert match.matched == max(m.matched for m in group)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Plain words only."), (4, "x\nReleased under the MIT License.\ny Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY 4.0")]
    frame = spark.createDataFrame([(a, b, "z", 1.0) for a, b in [*rows, rows[3]]], "doc_id long, text string, licenses string, coverage double")
    got = sorted(((r.doc_id or 0, r.n_licenses, r.licenses, r.coverage) for r in ls.scan_licenses(frame).collect()))
    assert got == [(0, 1, "CC-BY-4.0", 1.0), (1, 0, "", 0.0), (2, 0, "", 0.0), (3, 0, "", 0.0), (4, 2, "MIT-notice,CC-BY-NC-4.0", 1.0), (4, 2, "MIT-notice,CC-BY-NC-4.0", 1.0)]
    assert ls.scan_licenses(frame.limit(0)).count() == 0


def test_real_headers_and_whole_texts():
    """Standard headers, SPDX lines and whole texts, also of other wording and without names."""
    header = (
        "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License as\n"
        "# published by the Free Software Foundation; either version 2 of the\n# License, or (at your option) any later version.\n"
    )
    best = lambda text: [m.name for m in ls.scan(text)]
    assert best(f"{header}\nimport os") == ["GPL-2.0-grant"]
    assert best(header.replace("General", "Lesser General").replace("version 2", "version 3").replace("program", "library")) == ["LGPL-3.0-grant"]
    assert best("// SPDX-License-Identifier: GPL-2.0-only\nint x;") == ["GPL-2.0-only-spdx"]
    for name in ("Apache-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "MIT", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"):
        rng = random.Random(5)
        words = [w for w in ls.NOTICES[f"{name}-text"].split() if rng.random() > 0.03]
        assert best(f"Copyright 2020 A. N. Author.\n{' '.join(words)}\nother text") == [f"{name}-text"], name
