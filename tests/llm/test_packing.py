import bisect
import json
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(sizes, capacity):
    """One piece at a time: the room left in each window, in order of opening."""
    rooms = []
    windows = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, size)
        room = rooms.pop(at) if at < len(rooms) else capacity
        windows += [] if room < capacity else [0]
        bisect.insort(rooms, room - size)
    return len(windows), sorted(rooms)


def test_runs_equal_plain_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([1, 7, 16, 64, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            sizes += [rng.randint(1, capacity)] * rng.randrange(60)
        pieces = {s: sizes.count(s) for s in set(sizes)}
        rows = packing.pack_runs(pieces, capacity)
        used = {}
        for size, n in pieces.items():
            mine = rows[rows[:, 0] == size]
            for rank in range(n):
                _, first_rank, per, first, offset = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
                step = rank - first_rank
                used.setdefault(int(first + step // per), []).append((int(offset + step % per * size), size))
        rooms = []
        for parts in used.values():
            end = 0
            for offset, size in sorted(parts):
                assert offset == end
                end += size
            assert end <= capacity
            rooms.append(capacity - end)
        count, expected = plain_best_fit(sizes, capacity)
        assert len(used) == count
        assert sorted(rooms) == expected


def check_rows(rows, docs, capacity):
    library = Tokenizer.from_file(PATH)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert 0 < end <= capacity


def test_pieces_and_places(spark):
    rng = random.Random(4)
    words = "the of and être über niño 12 3.5 !! | # x".split()
    docs = {k: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 80, 700]))) for k in range(150)}
    docs |= {200: None, 201: "", 202: "a<|endoftext|>b", 203: "z" * 5000, 204: "\n" * 300}
    frame = spark.createDataFrame([(k, v, "clash", 7) for k, v in docs.items()], "doc_id long, text string, salt string, length int")
    check_rows(packing.pack(frame, PATH, capacity=64, group=20).collect(), docs, 64)
    check_rows(packing.pack(frame, PATH).collect(), docs, 1024)


def test_very_long_runs_are_the_librarys(spark):
    """Five million characters of one kind, and runs about the border to the library."""
    library = Tokenizer.from_file(PATH)
    five = 5_000_000
    texts = [" " * five, "\n" * five, "a " + "\t \n" * 700_000 + "b", "\u2003" * five, "ab" * (five // 2), "1" * five, "!" * five, "\u4e2d" * 1_000_000]
    texts += [x * n + y for x in (" ", "\n", "\u00a0", "\x1c") for n in (packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1) for y in ("", "x", " x", "1", "\n")]
    for text in texts:
        assert packing.ids_of(PATH, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_are_the_order_of_merges():
    """What makes ids usable as ranks: the k-th merge gives the k-th id after the bytes."""
    spec = json.load(open(PATH, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    ids = [vocab["".join(pair)] for pair in spec["model"]["merges"]]
    assert ids == sorted(ids) and len(set(ids)) == len(ids) and min(ids) >= 256


def test_code_points_are_the_librarys():
    """Every 7th block of 64 code points, each among letters, digits, signs and space."""
    library = Tokenizer.from_file(PATH)
    for low in range(0, 0x110000, 7 * 64):
        points = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b {c}1{c}{c} {c}, {c} \n" for c in points)
        assert packing.ids_of(PATH, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_repeated_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same"), (None, None)], "doc_id long, text string")
    rows = packing.pack(frame, PATH).collect()
    assert len(rows) == 4
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack(frame.limit(0), PATH).count() == 0
