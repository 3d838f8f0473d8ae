"""Language identification against plain posteriors, and with the declared language withheld."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, language_id


def _bucket(b):
    h = (b[0] * 0x9E3779B1 ^ b[1] * 0x85EBCA77 ^ b[2] * 0xC2B2AE3D) & 0xFFFFFFFF
    h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
    return (h >> 12) & (language_id.BUCKETS - 1)


def test_text_evidence():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(language_id.BUCKETS, 3))
    texts = [b"", b"  12 ", b"word", "Ça va, monsieur? Où 12 est".encode(), b"abc " * 300, b"x"]
    plainly = []
    for t in texts:
        b = b" " + b" ".join(t.lower().split()) + b" "
        places = [i for i in range(len(b) - 2) if all(language_id.SAYS[x] for x in b[i : i + 3])]
        total = sum((table[_bucket(b[i : i + 3])] for i in places), np.zeros(3))
        lettered = any(chr(x).isalpha() if x < 128 else True for x in t)
        plainly.append(total * min(1, language_id.EVIDENCE / len(places)) if places and lettered else np.zeros(3))
    assert np.allclose(language_id.text_evidence(texts, table), plainly)


@pytest.mark.parametrize("hot", [2, 4096])
def test_fused_posteriors(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(3)
    n, rows = 3, []
    for i in range(60):
        host = rng.choice(["a.x.org", "b.x.org", "y.de", None, "a.x.org", "a.x.org"])
        rows.append((i, host, None if host is None else ".".join(host.split(".")[-2:]), i % 7 > 0, [rng.gauss(0, 2) for _ in range(n)], rng.randrange(n)))
    df = spark.createDataFrame(rows, "key int, host string, domain string, lettered boolean, likelihood array<double>, guess int")
    got = {r.key: r for r in language_id.fuse(df, ["aa", "bb"]).collect()}
    smooth = lambda own, prior: [(sum(r[5] == k for r in own) + language_id.WEIGHT * prior[k]) / (len(own) + language_id.WEIGHT) for k in range(n)]
    base = [(sum(r[5] == k for r in rows) + 1) / (len(rows) + n) for k in range(n)]
    assert len(got) == 60
    for key, host, domain, lettered, like, _ in rows:
        prior = base if host is None else smooth([r for r in rows if r[1] == host], smooth([r for r in rows if r[2] == domain], base))
        e = [math.exp(x) * p for x, p in zip(like, prior, strict=True)]
        top = max(range(n), key=lambda k: e[k])
        assert got[key].lang == ["aa", "bb", language_id.NONE][top] and got[key].posterior == pytest.approx(e[top] / sum(e))
        assert got[key].keep == (lettered and top < 2 and e[top] / sum(e) > 0.5)


def test_declared_language_withheld(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs.where("doc_id % 2 = 0"))
    asked = docs.where("doc_id % 2 = 1")
    found = language_id.identify_documents(asked.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")), model)
    both = found.select(F.col("key.doc_id").alias("doc_id"), F.col("lang").alias("told")).join(asked, "doc_id").agg(F.avg((F.col("told") == F.col("lang")).cast("double"))).first()[0]
    assert both >= 0.98


def test_junk_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(i, f"some words in {x} {x}{x}", x) for i, x in enumerate(["en"] * 5 + ["de"] * 4 + [f"junk{j}" for j in range(9)])]
    names, table = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["de", "en"] and table.shape == (language_id.BUCKETS, 3)


def test_many_languages(spark):
    """256 languages are planned and fused in about the time of four, with the posteriors of plain arithmetic."""
    rng = np.random.default_rng(5)

    def fused(n):
        hosts = [None, *(f"h{i}.d{i % 7}.org" for i in range(30))]
        rows = []
        for i in range(512):
            h = hosts[int(rng.integers(31))]
            rows.append((i, h, None if h is None else h.split(".", 1)[1], True, rng.normal(0, 2, n).tolist(), int(rng.integers(n))))
        df = spark.createDataFrame(rows, "key int, host string, domain string, lettered boolean, likelihood array<double>, guess int")
        start = time.perf_counter()
        got = {r.key: r for r in language_id.fuse(df, [f"l{i:03}" for i in range(n - 1)]).collect()}
        return rows, got, time.perf_counter() - start

    fused(5)
    few, many = fused(5), fused(257)
    assert many[2] < 2 * few[2] + 2
    rows, got, _ = many
    count = lambda own: np.bincount([r[5] for r in own], minlength=257)
    smooth = lambda own, prior: (count(own) + language_id.WEIGHT * prior) / (len(own) + language_id.WEIGHT)
    base = (count(rows) + 1) / (len(rows) + 257)
    for key, host, domain, _, like, _ in rows[::16]:
        prior = base if host is None else smooth([r for r in rows if r[1] == host], smooth([r for r in rows if r[2] == domain], base))
        e = np.exp(like) * prior
        assert got[key].posterior == pytest.approx(e.max() / e.sum())
