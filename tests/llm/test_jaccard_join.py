import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tarnflow.llm import jaccard_join as jj
from tarnflow.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def closure(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


def brute(rows):
    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows]
    links = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                links.append((a, b))
    label = closure({a for a, _ in sets if a is not None}, links)
    return sorted(((a, len(x), label.get(a)) for a, x in sets), key=str)


def prose(rng, n):
    return [f"{rng.choice('the of and to'.split())}{rng.randrange(400)}" for _ in range(n)]


def edit(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        at = rng.randrange(len(out))
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows, passages = [], [prose(rng, 40) for _ in range(3)]
    for _ in range(14):
        base = prose(rng, rng.choice([3, 8, 30, 120, 400]))
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            rows.append(edit(rng, base, rng.choice([0.005, 0.02, 0.03, 0.05])))
        rows.append(base)
        rows.append([w.upper() for w in base])
    for _ in range(40):
        at = rng.randrange(30)
        words = prose(rng, rng.choice([20, 60, 200]))
        rows.append(words[:at] + rng.choice(passages) + words[at:])
    rows = [" ".join(w) for w in rows]
    rng.shuffle(rows)
    out = [(k * 7 % 1009, t) for k, t in enumerate(rows)]
    return out + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two three"), out[0], out[0], (out[1][0], out[2][1]), (None, out[3][1]), (None, None)]


def run(spark, rows, **settings):
    frame = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id long, text string, n int, component string").repartition(5)
    return frame, jj.Settings(**settings)


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        frame, s = run(spark, rows, sample=2, frequent_least=3, least_ranges=5 * seed, part=8 * seed, block=6 * seed, fragments=(1, 5, 8)[seed - 1], sent=(0, 100, 0)[seed - 1])
        got = sorted((tuple(r) for r in jj.join_components(frame, s).collect()), key=str)
        assert got == brute(rows)


def test_borderline_sizes(spark):
    """Pairs at and next to the threshold."""
    rng = random.Random(9)
    rows = []
    for k in range(60):
        words = prose(rng, rng.randint(9, 60))
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words + prose(rng, rng.randint(1, 1 + len(words) // 3)))))
    frame, s = run(spark, rows)
    assert sorted((tuple(r) for r in jj.join_components(frame, s).collect()), key=str) == brute(rows)


def test_keep_one_each(spark):
    rows = corpus(4)
    frame, s = run(spark, rows, sample=1000)
    kept = jj.keep_one_each(frame, s)
    assert kept.columns == frame.columns
    label = {a: c for a, _, c in brute(rows)}
    expected = [a for a, c in label.items() if a == c is not None] + [a for a, _ in rows if a is None]
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(expected, key=str)
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    assert jj.join_components(frame.limit(0), s).count() == 0


def test_keep_one_each_of_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    frame, s = run(spark, [(1, text), (1, text), (2, text), (3, text), (4, "other words"), (4, "than these"), (5, None), (5, None), (None, text), (None, text)])
    assert sorted((r.doc_id for r in jj.keep_one_each(frame, s).collect()), key=str) == [1, 4, 5, None, None]


def test_fragments_cut_one_order():
    """Fragments are ranges of the order by (octave, hash), and cover all of it."""
    rng = np.random.default_rng(5)
    octave = rng.integers(1, 12, 4000)
    code = rng.integers(0, 7 << jj.LOW, 4000)
    for fragments in (1, 3, 8, 64):
        found = jj.fragment_of(octave, code, 7, fragments)
        assert (np.diff(found[np.lexsort((code, octave))]) >= 0).all()
        assert found.min() >= 0 and found.max() < fragments


def test_common_counts():
    rng = np.random.default_rng(6)
    pairs = [(np.unique(rng.integers(0, 60, k)), np.unique(rng.integers(0, 60, 2 * k))) for k in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array([jj.packed(p[k].astype(np.int64)) for p in pairs]) for k in (0, 1)], names=["tokens_a", "tokens_b"])
    assert jj.common(rows).tolist() == [len(np.intersect1d(a, b)) for a, b in pairs]


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(900, k) for k in range(500, 560)] + [(7, 7), (1, 2), (2, 1)]
    label = closure({x for e in edges for x in e}, edges)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.id: r.component for r in got} == {x: c for x, c in label.items() if x != 7}
    assert len(got) == len({r.id for r in got})


def plain_frequent(rows, s, least):
    """Numbers of documents by hash, of ``least`` or more, rarest first."""
    counts = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for h in jj.shingles(text or "", s.words).tolist():
                counts[h] = counts.get(h, 0) + 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted(((n, signed(h), h) for h, n in counts.items() if n >= least))


def check_frequent(spark, rows, least, partitions=5, **settings):
    frame, s = run(spark, rows, **settings)
    expected = plain_frequent(rows, s, least)
    hashes, cuts = jj.frequent_shingles(frame.coalesce(partitions), s)
    assert hashes.tolist() == [h for _, _, h in expected]
    assert cuts.tolist() == [1 << max(0, (-(-n // s.part) - 1).bit_length()) for n, _, _ in expected]
    return len(expected)


def test_frequent_shingles_of_documents_in_no_sample(spark):
    """The shared passage is in documents only that no sample by remainder holds."""
    rng = random.Random(5)
    passage = " ".join(prose(rng, 12))
    rows = [(k, " ".join(prose(rng, 20)) + ("" if zlib.crc32(str(k).encode()) % 16 == 1 else " " + passage)) for k in range(400)]
    assert check_frequent(spark, rows, 256, part=3) >= 8


def test_frequent_shingles_are_counted_in_all_documents(spark):
    """Equal to plain counts, in small chunks, wherever the documents are."""
    for seed, chunk in ((1, 50), (2, 700), (3, 10**6)):
        rows = corpus(seed)
        rows.sort(key=lambda r: r[1] or "")  # copies side by side, so many are frequent in one chunk alone
        for least in (6, 17, 40):
            check_frequent(spark, rows, least, seed, sample=1, frequent_least=least, chunk=chunk, chunks=2, part=4)
    assert check_frequent(spark, corpus(1), 6, sample=2, frequent_least=3, chunk=300) > 50
    assert check_frequent(spark, [(None, "a b c d e f")] * 30 + [(1, None)] * 30, 1, sample=1, frequent_least=1) == 0


def test_rows_that_may_be_frequent_grow_as_the_documents_do(spark, monkeypatch):
    """Five times the documents, with as many more passages of ten documents or so: no more than about five times the rows."""
    rng = random.Random(12)
    made, kind = [], type(spark.range(1))

    def group(frame, *columns, plain=kind.groupBy):
        if "h" in map(str, columns) and "above" in frame.columns:
            made.append(frame.count())
        return plain(frame, *columns)

    monkeypatch.setattr(kind, "groupBy", group)
    common = " ".join(prose(rng, 12))
    for n in (1000, 5000):
        passages = [" ".join(prose(rng, 12)) for _ in range(n // 5)]
        rows = [(k, " ".join([rng.choice(passages), rng.choice(passages), *[common][: k % 5 == 0]])) for k in range(n)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(n // 50)
        s = jj.Settings(sample=1, frequent_least=64)
        assert jj.frequent_shingles(frame, s)[0].tolist() == [h for _, _, h in plain_frequent(rows, s, 64)] != []
    assert made[0] and made[1] <= 7 * made[0]


def test_frequent_shingles_of_many_tasks_and_pieces(spark):
    """Nothing that is frequent is lost, wherever it is, between the pieces of a task or the tasks."""
    for seed, chunk, each in ((1, 20, 1), (2, 60, 3), (3, 400, 5)):
        rows = corpus(seed)
        for partitions in (3, 17):
            assert check_frequent(spark, rows, 12, partitions, sample=1, frequent_least=12, chunk=chunk, frequent_task=each, part=4)


def test_counts_above_bounds():
    """What is left above the bounds of all pieces is at least the count less the bounds, and at most the count."""
    rng = np.random.default_rng(4)
    for bound, cut in ((0.3, 0), (2.5, 4.2), (3.0, 9)):
        h, above = np.empty(0, dtype=np.uint64), np.empty(0)
        pieces = [(rng.integers(0, 60, 200) ** 2).astype(np.uint64) for _ in range(5)] + [np.empty(0, np.uint64)]
        for k, piece in enumerate(pieces):
            h, above = jj.counted_above(h, above, [piece[:70].copy(), piece[70:].copy()], bound, cut * (k == 5))
        assert (np.diff(h.astype(np.int64)) > 0).all() and (above > cut).all()
        got = dict(zip(h.tolist(), above.tolist()))
        for x, n in zip(*np.unique(np.concatenate(pieces), return_counts=True)):
            assert got.get(int(x), cut) >= n - 6 * bound - 1e-9 and got.get(int(x), 0) <= n


def test_pairs_that_cannot_link_leave_after_one_fragment(spark, monkeypatch):
    """Documents of a frequent passage with one or two other words, and a half by group."""
    rng = random.Random(8)
    passage, halves = prose(rng, 60), [prose(rng, 40) for _ in range(6)]
    rows = [(k, " ".join(edit(rng, passage, (0.01, 0.04)[k % 2]) + halves[k % 6])) for k in range(90)]
    written = {}

    def materialize(frame, name, plain=jj.materialize):
        found = plain(frame, name)
        written[name] = written.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(jj, "materialize", materialize)
    frame, s = run(spark, rows, sample=1, frequent_least=40)
    assert sorted((tuple(r) for r in jj.join_components(frame, s).collect()), key=str) == brute(rows)
    assert written["possible"] < written["pairs"]
