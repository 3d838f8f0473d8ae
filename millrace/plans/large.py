"""Plans whose SQL is a product or a single task, as operators that stay spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import funnels, variants
from ..operators import cells, groups, inequality, ordered, recursion, sketches, strings
from ..session import load, scratch, stored
from ..sources import files, shards
from ..streaming import timers
from ..streaming import windows as st
from .frames import BEST, SESSIONS, frame


@frame("cte_recursive", "WITH RECURSIVE t(k, depth, total) AS (SELECT c_custkey, 0, CAST(floor(c_acctbal) AS BIGINT) FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, t.depth + 1, t.total + CAST(floor(c.c_acctbal) AS BIGINT) FROM customer c JOIN t ON CAST(floor(c.c_custkey / 2) AS BIGINT) = t.k AND c.c_custkey > 1) SELECT k, depth, total FROM t")
def cte_recursive(spark, d):
    """Customers below the first in the tree of halved keys. Spark's WITH RECURSIVE gives up beyond a million rows."""
    c = load(spark, d, "customer")[0].select(F.col("c_custkey").alias("c"), F.expr("CAST(floor(c_acctbal) AS BIGINT)").alias("own"), F.expr("CAST(floor(c_custkey / 2) AS BIGINT)").alias("half"))
    first = c.where("c = 1").select(F.col("c").alias("k"), F.lit(0).alias("depth"), F.col("own").alias("total"))
    below = lambda t: c.where("c > 1").join(t, F.col("half") == F.col("k")).select(F.col("c").alias("k"), (F.col("depth") + 1).alias("depth"), (F.col("total") + F.col("own")).alias("total"))
    return recursion.union_all(first, below)


@frame("join_inequality", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal < c_acctbal AND s_nationkey > c_nationkey")
def join_inequality(spark, d):
    s, c = load(spark, d, "supplier", "customer")
    pairs = inequality.inequality_join(s.select("s_suppkey", "s_acctbal", "s_nationkey"), c.select("c_custkey", "c_acctbal", "c_nationkey"), ("s_acctbal", "<", "c_acctbal"), ("s_nationkey", ">", "c_nationkey"))
    return pairs.select("s_suppkey", "c_custkey")


_SPAN = "SELECT event_id, ts, ts + to_minutes(CAST(ceil(value / 10) AS BIGINT)) AS until FROM events WHERE event_type = "


@frame("join_overlap", f"SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM ({_SPAN}'view') v JOIN ({_SPAN}'purchase') p ON v.ts < p.until AND v.until > p.ts")
def join_overlap(spark, d):
    """Views and purchases whose spans, a minute for each ten of their value, overlap."""
    e = load(spark, d, "events")[0]

    def span(kind: str):
        until = F.col("ts") + F.make_dt_interval(mins=F.ceil(F.col("value") / 10).cast("int"))
        return e.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"{kind}_ts"), until.alias(f"{kind}_until"))

    return inequality.overlap_join(span("view"), span("purchase"), ("view_ts", "view_until"), ("purchase_ts", "purchase_until")).select("view_id", "purchase_id")


def _edits(table: str, column: str) -> str:
    t = f"(SELECT DISTINCT {column} AS t FROM {table})"
    small = "length(x.t) < length(y.t) OR length(x.t) = length(y.t) AND x.t < y.t"
    return f"SELECT x.t AS a, y.t AS b, CAST(levenshtein(x.t, y.t) AS INTEGER) AS distance FROM {t} x JOIN {t} y ON ({small}) AND levenshtein(x.t, y.t) <= 2"


@frame("join_edit_part", _edits("part", "p_name"))
def join_edit_part(spark, d):
    return strings.similar_texts(load(spark, d, "part")[0], "p_name", 2)


@frame("join_edit_customer", _edits("customer", "c_name"))
def join_edit_customer(spark, d):
    return strings.similar_texts(load(spark, d, "customer")[0], "c_name", 2)


@frame("doc_contamination", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def doc_contamination(spark, d):
    docs, items = load(spark, d, "documents", "benchmark")
    return strings.texts_with_phrases(docs, "doc_id", "text", items, "item_id", "text")


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _orders(spark, d):
    o = load(spark, d, "orders")[0]
    return o.select("o_orderkey", "o_orderdate", F.expr(_CENTS).alias("cents"))


@frame("win_rows_global", f"""SELECT o_orderkey, CAST(sum({_CENTS}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near, CAST(sum({_CENTS}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total,
  max({_CENTS}) OVER (w ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS around, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def win_rows_global(spark, d):
    """Moving and running sums over all orders by date."""
    rows = ordered.numbered(_orders(spark, d), ["o_orderdate", "o_orderkey"])
    frames = {"near": (F.sum("cents"), -2, 0), "around": (F.max("cents"), -1, 3), "before": (F.first("o_orderkey"), -1, -1)}
    return ordered.running(ordered.framed(rows, "rn", frames), "rn", {"total": ("sum", "cents")}).select("o_orderkey", "near", "total", "around", "before")


@frame("win_rank_global", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (ORDER BY o_orderdate) AS r, dense_rank() OVER (ORDER BY o_orderdate) AS dr FROM orders""")
def win_rank_global(spark, d):
    """Places of all orders by date."""
    return ordered.ranked(_orders(spark, d), ["o_orderdate"], ["o_orderkey"]).select("o_orderkey", "rn", "r", "dr")


@frame("time_session", SESSIONS)
def time_session(spark, d):
    return ordered.sessions(load(spark, d, "events")[0], "user_id", "ts", 6 * 3600)


def _cells(spark, d, cosine: bool, name: str):
    e = load(spark, d, "embeddings")[0]
    best = cells.best_of_each(cells.build(e, "vec_id", "embedding", cosine), e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return best.select("query_id", "vec_id", (F.round("score", 3) + F.lit(0.0)).alias(name))


@frame("vec_dot_cells", BEST.format(f="list_inner_product", c="dot"))
def vec_dot_cells(spark, d):
    """vec_dot_all with cells that are skipped."""
    return _cells(spark, d, False, "dot")


@frame("vec_topk_cells", BEST.format(f="list_cosine_similarity", c="cos"))
def vec_topk_cells(spark, d):
    """vec_topk_all with cells that are skipped."""
    return _cells(spark, d, True, "cos")


@frame("agg_sketch_range", "SELECT event_type, count(*) AS n, true AS users_close, true AS median_close FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13' GROUP BY event_type")
def agg_sketch_range(spark, d):
    """Distinct users and the median of eight days, from sketches written by day; told is whether they keep 5 % and a hundredth and a half of the ranks."""
    e = load(spark, d, "events")[0]
    path = scratch(spark, "sketches")
    files.write(sketches.sketched(e, ["event_type"], "ts", "user_id", "value").withColumn("day", F.to_date("period")), path, by=["day"])
    days = F.col("day").between("2024-01-05", "2024-01-12")  # prunes folders
    near = sketches.merged(files.read(spark, path), ["event_type"], days).select(F.col("event_type").alias("t"), "n", sketches.distinct_count().alias("users"), sketches.quantile(0.5).alias("median"))
    exact = e.where(F.to_date("ts").between("2024-01-05", "2024-01-12")).join(near, F.col("event_type") == F.col("t")).groupBy("event_type").agg(
        F.first("n").alias("n"), F.first("users").alias("users"), F.count_distinct("user_id").alias("all"),
        F.avg((F.col("value") <= F.col("median")).cast("double")).alias("up_to"), F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"),
    )
    return exact.select("event_type", "n", (F.abs(F.col("users") - F.col("all")) <= 0.05 * F.col("all")).alias("users_close"), ((F.col("up_to") >= 0.485) & (F.col("below") <= 0.515)).alias("median_close"))


@frame("json_variant", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'nothing' ELSE 'value' END AS told, CAST(NULL AS BIGINT) AS other FROM events")
def json_variant(spark, d):
    e = variants.parsed(load(spark, d, "events")[0].select("event_id", "props"), "props", "v")
    return e.select("event_id", variants.typed("v", "$.k", "bigint").alias("k"), variants.told("v", "$.k").alias("told"), variants.typed("v", "$.other[0]", "bigint").alias("other"))


@frame("json_schema", "SELECT event_type, 'OBJECT<k: BIGINT>' AS schema FROM events GROUP BY event_type")
def json_schema(spark, d):
    return variants.schema_by(variants.parsed(load(spark, d, "events")[0].select("event_type", "props"), "props", "v"), ["event_type"], "v")


@frame("udtf_funnel", """WITH v AS (SELECT user_id, min((ts, event_id)) AS at FROM events WHERE event_type = 'view' GROUP BY user_id),
  c AS (SELECT e.user_id, min((ts, event_id)) AS at FROM events e JOIN v ON e.user_id = v.user_id AND event_type = 'click' AND (ts, event_id) > v.at GROUP BY e.user_id),
  p AS (SELECT e.user_id, min((ts, event_id)) AS at FROM events e JOIN c ON e.user_id = c.user_id AND event_type = 'purchase' AND (ts, event_id) > c.at GROUP BY e.user_id)
  SELECT u.user_id, CAST((v.at IS NOT NULL)::INT + (c.at IS NOT NULL)::INT + (p.at IS NOT NULL)::INT AS INTEGER) AS reached, v.at[1] AS view, c.at[1] AS click, p.at[1] AS purchase
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN v USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)""")
def udtf_funnel(spark, d):
    """From a view to a click to a purchase, by a table function over each user's rows in order."""
    return funnels.funnel(load(spark, d, "events")[0], "user_id", "ts", "event_id", "event_type", ["view", "click", "purchase"])


@frame("st_timers", f"SELECT user_id, start_ts, end_ts - INTERVAL 6 HOUR AS last_ts, n FROM ({SESSIONS}) WHERE end_ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_timers(spark, d):
    """Users silent for six hours, told once by a timer; those not yet silent by the watermark stay untold."""
    return st.drain(timers.silent(st.event_stream(spark, d), "user_id", "ts", "event_id"), "append").select("user_id", "start_ts", "last_ts", "n")


@frame("scan_python", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE value > 100 AND event_type = 'view' AND ts >= TIMESTAMP '2024-01-10'")
def scan_python(spark, d):
    """events written to a data source in Python and read back in splits, the filters pushed down."""
    path = scratch(spark, "shards")
    shards.write_shards(load(spark, d, "events")[0].repartitionByRange(8, "ts"), path)
    return shards.read_shards(spark, path).where("value > 100 AND event_type = 'view' AND ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")


@frame("doc_near_groups", """WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY coalesce(text, '')),
  s AS (SELECT id, w, len(w) AS n FROM (SELECT id, list_distinct(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS w FROM t)),
  p AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS n, len(list_intersect(x.w, y.w)) AS shared FROM s x JOIN s y ON x.id < y.id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1),
  l AS MATERIALIZED (SELECT a, b FROM p WHERE shared >= 0.8 * (n - shared) - 1e-9),
  e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(id, x) AS (SELECT id, id FROM t UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a)
  SELECT d.doc_id, g.group_id FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN (SELECT id, min(x) AS group_id FROM r GROUP BY id) g ON g.id = t.id""")
def doc_near_groups(spark, d):
    """Each document with the least id of its group: equal texts, and those linked by a Jaccard similarity of their words of 0.8 or more."""
    docs = load(spark, d, "documents")[0].select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h1"), F.md5(F.coalesce("text", F.lit(""))).alias("h2"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("text").alias("text"), F.count("*").alias("n"))
    words = stored(kinds.select("h1", "h2", "id", "n", F.split(F.lower("text"), r"[ \t\n\r\f\x0b]+").alias("w")), "words")
    found = words.select("h1", "h2", "id", "n").join(groups.similar_groups(words, "id", "w", 0.8), "id").select("h1", "h2", "n", "group_id")
    own = docs.select("doc_id", "h1", "h2")
    return groups.to_one(own, found, ["h1", "h2"], "n", own.count()).select("doc_id", "group_id")
