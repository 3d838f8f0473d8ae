"""The pipeline's stages on odd rows, and mixing against the optimum of its entropy."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, mixing
from tests.llm.test_operators import SF

ENGLISH = "the people of this town were talking about the weather and what they would do when winter comes to them"


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select(*corpus_pipeline.COLUMNS)
    more = [
        (None, None, None, None, None), (101, None, "en", "a", 0), (102, "", None, None, 0), (103, " \n\t", "en", None, 3), (104, ENGLISH, None, None, 5),
        (104, ENGLISH, None, None, 5), (None, ENGLISH, "en", "a", 5), (105, (ENGLISH + " ") * 3000, "en", "a", 9), (106, "é" * 90 + "一" * 40, "en", "b", 1),
    ]
    rows = base.unionByName(spark.createDataFrame(more, base.schema))
    return rows.withColumns({c: F.lit(1) for c in ("_doc", "_key", "h", "head", "home", "n", "key", "bucket", "size")}).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = common.written(stage(spark, odd, SF))
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == corpus_pipeline.COLUMNS
    assert stage(spark, odd.where("false"), SF).count() == 0
    ids = [r.doc_id for r in out.collect()]
    if name == "language ID":
        assert not {101, 102, 103} & set(ids) and ids.count(104) == 2 and None in ids and 105 in ids
        assert out.where("text IS NULL").count() == 0
    elif name == "SimHash near-dedup":
        # one of the empty texts, and of the English ones, also the one repeated on and on, the least id once
        assert [i for i in ids if i in (101, 102, 103)] == [101] and ids.count(104) == 1 and None not in ids and 105 not in ids
    elif name == "suffix-array dedup":
        texts = {r.doc_id: r for r in out.collect()}
        assert texts[101].text == "" and texts[102].text == "" and ids.count(104) == 2
        assert len(texts[105].text) < 250 and texts[105].n_chars == len(texts[105].text)
        assert "�" not in texts[106].text
    elif name == "benchmark decontamination":
        assert {101, 102, 103, 104, 105} <= set(ids) and ids.count(104) == 2
    else:
        assert len(ids) == odd.count()


def test_stages_cut_their_tables(spark):
    made = []
    plain = common.scratch
    common.scratch = lambda s, w: made.append(plain(s, w)) or made[-1]
    try:
        out = corpus_pipeline.run(spark, SF)
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        left = [p for p in made if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))]
        assert len(made) > 20 and len(left) <= 8
        assert out.count() > 100
    finally:
        common.scratch = plain


def test_tilts_are_the_entropy_optimum(spark):
    """Any move of rates between two sizes that keeps the words of a source lowers the entropy."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 7 % 40)), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    h = lambda r: -(r / 2) * math.log(r / 2) - (1 - r / 2) * math.log(1 - r / 2)
    assert {r.rate for r in rows if r.source == "a"} == {2.0}  # its target is all that there can be
    for source in "bc":
        own = [r for r in rows if r.source == source]
        assert sum(r.rate * r["size"] for r in own) == pytest.approx(own[0].target, rel=1e-6)
        best = sum(h(r.rate) for r in own)
        for x, y in [(0, 5), (3, 11), (7, 20), (1, 2)]:
            for eps in (1e-3, -1e-3):
                moved = {x: own[x].rate + eps, y: own[y].rate - eps * own[x]["size"] / own[y]["size"]}
                if own[x]["size"] != own[y]["size"] and all(0 < v < 2 for v in moved.values()):
                    assert sum(h(moved.get(i, r.rate)) for i, r in enumerate(own)) < best


def test_sizes_make_no_list_of_words(spark, monkeypatch):
    """Words are counted as the pattern says, and no task holds all words of a text at once."""
    rng, plans = random.Random(3), []
    texts = [None, "", " ", "\n\t\v\f\r ", "a", " a", "a\n", *("".join(rng.choice(" \t\n\v\f\r\x1c\x85\u3000abé\U0001f600\0$\\") for _ in range(rng.randrange(60))) for _ in range(500)), "w\r\n" * 300_000]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    plain = mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, what: plans.append((what, df._jdf.queryExecution().optimizedPlan().toString())) or plain(df, what))
    got = {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert "regexp_extract_all" not in dict(plans)["sizes"]
