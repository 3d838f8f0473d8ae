"""Edit-distance joins and phrase searches against all pairs."""

import random

import pytest

from millrace.operators import strings
from millrace.plans import registry
from tests.oracle import SF


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n):
    """Short and long ones, of few letters, with edits of each other and beginnings in common; one is longer than PLACES."""
    out = ["", "a", "b", "ab", "ba", "é", "日本", "日本語", "Item#0001", "x" * 80, "x" * 79 + "y", "x" * 78, "-" * 30]
    out += ["".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(n)]
    out += [f"Item#{rng.randrange(300):04}" for _ in range(n)]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.randrange(2)] = rng.choice(["", "a", "é", "#"])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_similar_texts_match_brute_force(spark, k):
    some = words(random.Random(k), 60)
    df = spark.createDataFrame([(w, 1) for w in some] + [(None, 2), (some[3], 3)], "w string, a int")
    own = set(some)
    want = {(a, b, d) for a in own for b in own if (len(a), a) < (len(b), b) and (d := distance(a, b)) <= k}
    got = [tuple(r) for r in strings.similar_texts(df, "w", k).collect()]
    # Spark orders by UTF-8, Python by code points, which is the same order
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("k", [1, 2])
def test_edit_join_of_two_tables(spark, k):
    a, b = words(random.Random(10 + k), 40), words(random.Random(20 + k), 50)
    l, r = (spark.createDataFrame([(x,) for x in [*t, None]], f"{c} string") for t, c in ((a, "p"), (b, "q")))
    want = {(x, y, d) for x in set(a) for y in set(b) if (d := distance(x, y)) <= k}
    got = [tuple(x) for x in strings.edit_join(l, r, k).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert strings.edit_join(l.where("false"), r, k).count() == 0 == strings.edit_join(l, r.where("false"), k).count()


def test_segments_follow_what_places_tell():
    assert strings.segments_by_information([0.0] * 9 + [1.0, 2.0, 2.0], 2) == [10, 11, 12]
    assert strings.segments_by_information([1.0] * 6, 1) == [3, 6]
    assert strings.segments_by_information([0.0, 0.0, 0.0], 2) == [1, 2, 3]


def test_candidates_are_few_though_all_begin_alike(spark):
    t = spark.range(3000).selectExpr("concat('Customer#', lpad(cast(id * 7919 % 1000000 AS string), 9, '0')) AS t")
    met = strings.edit_candidates(t, t, 2, own=True).count()
    assert met < 3000 * 2999 / 2 / 20  # even segments would compare them all


def test_edit_joins_have_no_product(spark):
    for name in ("join_edit_part", "join_edit_customer"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("most", [1 << 20, 12, 1])
def test_phrases_match_brute_force(spark, most):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    docs = [(i, text(rng.randrange(60)), "x") for i in range(80)] + [(1, "ab ab", "x"), (1, "ab ab", "x"), (None, "aab", "x"), (90, None, "x"), (91, "", "x"), (92, text(200_000), "x")]
    items = [(i, text(rng.randint(1, 5))) for i in range(25)] + [(3, "ab"), (3, "ab"), (None, "b"), (50, None), (51, ""), (52, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    p = spark.createDataFrame(items, "item_id long, text string")
    got = strings.texts_with_phrases(d, "doc_id", "text", p, "item_id", "text", most)
    assert got.columns == ["doc_id", "item_id"]
    want = [(i, k) for i, t, _ in docs for k, w in items if t is not None and w is not None and w in t]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_phrases_of_empty_tables(spark):
    d, p = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    for a, b in ((d.where("false"), p), (d, p.where("false"))):
        assert strings.texts_with_phrases(a, "doc_id", "text", b, "item_id", "text").count() == 0


def test_contamination_shuffles_no_text(spark):
    plan = registry.QUERIES["doc_contamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Cartesian" not in plan


def test_numbered_names_meet_few_that_are_not_near(spark):
    t = spark.range(10000).selectExpr("concat('Customer#', lpad(cast(id AS string), 9, '0')) AS t")
    assert strings.edit_candidates(t, t, 2, own=True).where("a < 'Customer#000000100'").count() < 200_000  # 52,200 pairs differ in one or two places; three segments gave 370,800
