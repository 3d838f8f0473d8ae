"""Suffix-array dedup: splits of hot minimizers and of merges, and memory, against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from millrace.llm import suffix_dedup
from tests.llm.test_operators import texts


def brute_force(rows):
    """(id, bytes) -> (removed, spans, sha256 of what is kept), of the distinct rows."""
    seen, want = set(), {}
    for i, b in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32(r[1]))):
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[np.frombuffer(bytes(gone), np.uint8) == 0])
        want[i, b] = len(b) - len(kept), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()
    return want


def check(spark, rows, **sizes):
    want = brute_force([(i, (t or "").encode()) for i, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(df, keep_text=False, **sizes).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), len(b), *want[i, b]) for i, b in ((i, (t or "").encode()) for i, t in rows))
    return want


@pytest.mark.parametrize("sizes", [{"hot": 1, "held": 8}, {"hot": 0, "held": 1, "limit": 1}, {"hot": 3, "limit": 300, "held": 50}])
def test_any_split_gives_the_same(spark, sizes):
    t = texts()
    rows = [*enumerate(t), (None, t[7]), (None, t[6]), (None, t[7]), (3, "another text of one id"), (7, t[7]), (50, t[9][5:] + "é")]
    check(spark, rows, **sizes)


def test_one_passage_in_many_contexts(spark):
    rng = random.Random(8)
    passage = "a passage that all of them share"  # GRAM bytes
    assert len(passage) == suffix_dedup.GRAM
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    frame = [some(70) for _ in range(40)]
    rows = []
    for i in range(20_000):
        left, right = (some(70) if i % 9 else rng.choice(frame) for _ in range(2))
        rows.append((i, f"{left}{passage}{right}"))
    want = check(spark, rows, hot=100)
    assert sum(x[0] > 0 for x in want.values()) > 1000


def test_memory_of_a_merge():
    rng = np.random.default_rng(5)
    length = rng.integers(1, 70, 7000)
    size = length + suffix_dedup.WIDTH - 1
    base = rng.integers(97, 122, 100_000).astype(np.uint8)
    data = np.concatenate([base[a : a + s] for a, s in zip(rng.integers(0, len(base) - 200, len(size)), size, strict=True)])
    doc = np.arange(len(size), dtype=np.int64)
    tracemalloc.start()
    suffix_dedup.repeated(data, doc, doc.astype(np.uint32), doc.astype(np.uint32), length, doc % 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * len(data)


def test_strings_of_runs():
    rng = np.random.default_rng(6)
    length = np.array([1, 69, 3])
    data = rng.integers(0, 256, int((length + 99).sum())).astype(np.uint8).tobytes()
    low, high = suffix_dedup.string_hashes(data, length)
    at = [0, *range(100, 169), 268, 269, 270]
    alone = [suffix_dedup.string_hashes(data[a : a + 100], np.array([1])) for a in at]
    assert low.tolist() == [int(x[0][0]) for x in alone] and high.tolist() == [int(x[1][0]) for x in alone]


def test_texts_of_one_crc32(spark):
    """Null ids and shared ids: texts that crc32 can't tell apart are documents of their own."""
    rng = random.Random(9)
    passage, other = ("".join(rng.choices("abcdefgh ", k=n)) for n in (150, 400))
    end = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    known = {zlib.crc32((t := passage + end()).encode()): t for _ in range(150_000)}
    pairs = []
    while len(pairs) < 3:
        t = other + passage + end()
        if (c := zlib.crc32(t.encode())) in known:
            pairs.append((known[c], t))
    rows = [(i, t) for i, pair in zip([None, None, 5], pairs, strict=True) for t in pair] + [(1, passage), (None, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    # every string stays once: of the passage what begins in it, and the other once
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)
    assert kept[0] == (False, 1, 150, 0) and all(r[3] >= 51 for r in kept if r[0] and r[2] == 159)
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got) and sum(r.n_removed for r in got) > 6 * 100
