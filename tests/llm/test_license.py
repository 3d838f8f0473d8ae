"""License scans against brute force over all blocks."""

import random
import re

import pytest

from millrace.llm import license_scan as ls
from millrace.llm import lexical_search

SCHEMA = "doc_id long, text string, labels string, row int"
NOTICES = [t for _, t in ls.TEMPLATES]


def texts():
    rng = random.Random(7)
    fill = lambda n: " ".join(rng.choice(["the", "of", "a", "license", "über", "this", "x1", "to", "and", "public", "work"]) for _ in range(n))
    out = [None, "", "   \n", "cc by", "CC BY cc by-nc", "ccby c c by", "All Rights\n\nReserved", "all rights, all rights reserved; general public license", "cc", "é cc by é"]
    for t in NOTICES:
        w = t.split()
        out += [t, f"{fill(rng.randint(1, 150))} {t.upper()} {fill(rng.randint(1, 150))}"]
        for k in (1, 2, 4):
            some = [x for i, x in enumerate(w) if i not in set(rng.sample(range(len(w)), min(k, len(w))))]
            out.append(f"{fill(30)}\n{' '.join(some)}\n{fill(200)}")
        out.append(f"{fill(39)} {' '.join(rng.sample(w, len(w)))}")
    return [*out, fill(5000) + " All rights reserved. " + fill(900) + " cc by", "license " * 500]


def want(text, step=ls.STEP, least=ls.LEAST):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base, labels, score = [], set(), set(), 0.0
    for p, label in ls.PHRASES.items():
        for i in range(len(words)):
            if words[i : i + len(p.split())] == p.split():
                places.append(i)
                base.add(label)
    for at in range(0, max(1, len(words) - step), step):
        block = set(words[at : at + 2 * step])
        for label, t in ls.TEMPLATES:
            own = set(re.findall(r"[a-z0-9]+", t.lower()))
            if len(own & block) >= least * len(own) - 1e-9:
                labels.add(label)
                score = max(score, len(own & block) / len(own))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("segment, piece", [(ls.SEGMENT, lexical_search.PIECE), (1, 50), (3, 1)])
def test_license_scan_matches_brute_force(spark, monkeypatch, segment, piece):
    t = texts()
    rows = [(i, x, "clash", 3) for i, x in enumerate(t)] + [(None, "cc by", "", 1), (3, "cc by", "", 1), (3, "cc by", "", 1), (4, None, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if piece < lexical_search.PIECE:
        # the patched function goes to the workers with the closure that names it
        monkeypatch.setattr(ls, "pieces", lambda x: lexical_search.pieces(x, piece))
    got = ls.license_scan(docs, segment=segment).collect()
    assert sorted(map(key, got)) == sorted(key((i, *want(x))) for i, x, _, _ in rows)
    assert sum(r.labels != r.base_labels for r in got) > 20


def test_filters_lose_no_pair(spark):
    """Few different words, so that blocks and templates share much: every pair at the threshold is found."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(25)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    for least in (0.5, 0.8, 1.0):
        got = {r.doc_id: r.labels for r in ls.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), {}, templates, least, 9).collect()}
        for i, t in docs:
            w = t.split()
            blocks = [set(w[a : a + 18]) for a in range(0, max(1, len(w) - 9), 9)]
            held = {label for label, x in templates for b in blocks if len(set(x.split()) & b) >= least * len(set(x.split())) - 1e-9}
            assert got[i] == ",".join(sorted(held))


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ls.license_scan(empty).count() == 0
    with pytest.raises(ValueError, match="words"):
        ls.license_scan(empty, templates=[("x", "word " * 41)])
    assert ls.license_scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"), {}, []).first().labels == ""
