import random

import xxhash
from pyspark.sql import functions as F

from tarnflow.llm import line_dedup as ld

S = ld.Settings()
ODD, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def plain_chunks(text):
    """Places of the lines of each chunk, straight from the definition: a chunk ends
    after two lines or more where the hash of the last two lines is even, and after 16."""
    lines = [x.encode() for x in text.split("\n")]
    filled = [k for k, line in enumerate(lines) if line.split()]
    found, now = [], []
    for n, k in enumerate(filled):
        now.append(k)
        value = xxhash.xxh3_64_intdigest(lines[k])
        if n:
            value = (xxhash.xxh3_64_intdigest(lines[filled[n - 1]]) * ODD + value) % 2**64
        even = (((value ^ value >> 32) * MIX) % 2**64 >> 40) % 2 == 0
        if len(now) == 16 or (len(now) >= 2 and even):
            found.append(now)
            now = []
    if len(now) == 1 and found:
        found[-1] += now
    elif now:
        found.append(now)
    return found


def plain_passages(text):
    """{passage: lines} of all runs of two lines or more within chunks, as lists."""
    lines, found = text.split("\n"), []
    for chunk in plain_chunks(text):
        for a in range(len(chunk)):
            for b in range(a + 1, len(chunk)):
                found.append(("\n".join(lines[chunk[a] : chunk[b] + 1]), chunk[a], chunk[b]))
    return found


def brute(spark, rows):
    """Passages of other documents before in the order, and later ones of the own text, go."""
    marks = {r.t: r.m for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("m")).collect()}
    document = lambda doc_id, text: (ld.LAST if doc_id is None else doc_id, marks[text])
    first, count = {}, {}
    for doc_id, text in rows:
        for passage, _, _ in plain_passages(text or ""):
            count[passage] = count.get(passage, 0) + 1
            first[passage] = min(first.get(passage, document(doc_id, text)), document(doc_id, text))
    out = []
    for doc_id, text in rows:
        gone, seen = set(), {}
        for passage, a, b in sorted(plain_passages(text or ""), key=lambda x: x[1]):
            own = first[passage] == document(doc_id, text) and passage not in seen
            seen[passage] = True
            if count[passage] > 1 and not own:
                gone |= set(range(a, b + 1))
        out.append((doc_id, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1] is None, row[1] or "")


def corpus(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("the of and to in is été über niño".split()) + str(rng.randrange(999)) for _ in range(rng.randint(0, 9)))
    passages = [[line() for _ in range(rng.randint(2, 12))] for _ in range(8)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(rng.randrange(5)):
            text += rng.choice(passages) if rng.random() < 0.4 else [line() for _ in range(rng.randint(1, 6))]
        rows.append((k, "\n".join(text)))
    return rows + [(500, rows[7][1]), (501, rows[7][1]), (3, rows[3][1]), (3, rows[7][1]), (None, rows[5][1]), (None, "x\ny"), (600, None), (601, ""), (602, "\n" * 50), (603, "a\nb\n" * 40), (None, "x\ny"), (None, "z\nx\ny")]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = [tuple(r) for r in ld.deduplicate(frame).collect()]
        assert sorted(got, key=key) == sorted(brute(spark, rows), key=key)


def test_chunks_cover_the_lines_and_resist_shifts():
    rng = random.Random(5)
    lines = [f"line {rng.random()}".encode() for _ in range(400)]
    text = lambda chunk, of: b"\n".join(of[k] for k in chunk)
    found = ld.chunks(lines, S)
    assert [x for chunk in found for x in chunk] == list(range(400))
    longer = [b"new first line", *lines[:200], b"inserted", *lines[200:]]
    moved = {text(c, longer) for c in ld.chunks(longer, S)}
    assert sum(text(c, lines) in moved for c in found) > 0.95 * len(found)
    blanks = [x for line in lines for x in (line, b"", b" ")]
    assert [[k // 3 for k in chunk] for chunk in ld.chunks(blanks, S)] == found


def share_cut(rng, size, gap, documents=6, trials=25):
    """Of the lines of repeated passages in differing documents, the share that goes."""
    line = lambda: " ".join(str(rng.random()) for _ in range(3))
    some = lambda: [line() for _ in range(rng.randint(1, 8))]
    kept = 0
    for _ in range(trials):
        passage = [line() for _ in range(size)]
        texts = [gap.join([*some(), *passage, *some()]) for _ in range(documents)]
        holders = {}
        for k, text in enumerate(texts):
            for _, _, h1, h2, _ in ld.passages(text, S):
                holders.setdefault((h1, h2), []).append(k)
        cut = [ld.cut(text, [{"h1": a, "h2": b, "own": min(x) == k} for (a, b), x in holders.items() if len(x) > 1], S)[0] for k, text in enumerate(texts)]
        kept += sum(text.split("\n").count(x) for text in cut for x in passage) - size
    return 1 - kept / (size * (documents - 1) * trials)


def test_repeated_passages_between_differing_lines_go():
    rng = random.Random(8)
    for gap in ("\n", "\n\n"):
        assert share_cut(rng, 2, gap) > 0.4
        assert share_cut(rng, 4, gap) > 0.65
        assert share_cut(rng, 12, gap) > 0.85


def test_head_and_rest_agree(spark):
    rows = corpus(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((tuple(r) for r in ld.deduplicate(frame, ld.Settings(head=head)).collect()), key=key) for head in (0, 5))
    assert a == b


def test_counts_columns_and_emptied_rows(spark):
    passage = "\n".join(f"shared line number {k} of many" for k in range(30))
    rows = [(1, passage, "fr"), (2, passage, None), (3, "own words here", "en"), (4, None, "en"), (5, "", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    out = ld.deduplicate(frame, drop_emptied=True)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]
    counted = {r.doc_id: r for r in ld.deduplicate(frame, counts=True).collect()}
    assert counted[2].removed_lines == 30 and counted[1].removed_lines == 0 and counted[2].text == ""
    assert counted[1].n_lines == 30 and counted[4].n_lines == 0
    assert ld.deduplicate(frame.limit(0)).count() == 0
