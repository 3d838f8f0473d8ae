"""Plans written as SQL, each with its oracle where the dialects differ."""

from __future__ import annotations

from .registry import sql

sql("scan_parquet", "nation", "SELECT * FROM nation")
sql("filter_project", "lineitem", "SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05")
sql("like", "part", "SELECT p_partkey, p_name LIKE '%a%' AS m, p_name ILIKE 'A%' AS i FROM part")
sql("regex_match", "part", "SELECT p_partkey FROM part WHERE regexp_like(p_name, '^[a-m].*[aeiou]')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*[aeiou]')")
sql("join_inner", "customer orders nation", "SELECT n_name, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql("join_left", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_full", "nation supplier", "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey < 3) n FULL JOIN supplier ON n_nationkey = s_nationkey")
sql("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_theta", "nation region", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
sql("join_semi", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("join_anti", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql("join_not_in", "nation supplier", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
sql("join_not_in_null", "nation", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(n_regionkey, 0) FROM nation)")
sql("join_lateral", "region nation", "SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x")
sql("subq_scalar", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("agg_hash", "lineitem", "SELECT l_returnflag, sum(l_quantity) AS s, avg(l_tax) AS a, min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "orders", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus")
sql("agg_stats", "lineitem", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv FROM lineitem GROUP BY l_returnflag")
sql("agg_max_by", "orders", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS k FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) AS k FROM orders GROUP BY o_custkey")
sql("agg_list", "nation", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
sql("agg_string", "nation", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_SETS = "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY "
sql("grouping_sets", "orders", _SETS + "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
sql("rollup", "orders", _SETS + "ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube", "orders", _SETS + "CUBE (o_orderstatus, o_orderpriority)")
_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
sql("win_rank", "orders", f"SELECT o_orderkey, CAST(row_number() {_W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders")
sql("win_dist", "orders", f"SELECT o_orderkey, CAST(ntile(4) {_W} AS BIGINT) AS nt, round(percent_rank() {_W}, 6) AS pr, round(cume_dist() {_W}, 6) AS cd FROM orders")
sql("win_shift", "orders", f"SELECT o_orderkey, lag(o_orderkey, 1, -1L) {_W} AS p, lead(o_orderkey, 2) {_W} AS f FROM orders", f"SELECT o_orderkey, lag(o_orderkey, 1, -1) {_W} AS p, lead(o_orderkey, 2) {_W} AS f FROM orders")
_F = _W[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
sql("win_value", "orders", f"SELECT o_orderkey, first_value(o_orderkey) {_F} AS f, last_value(o_orderkey) {_F} AS l, nth_value(o_orderkey, 2) {_F} AS s FROM orders")
sql("win_rows", "orders", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM orders")
sql("win_range", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
sql("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("sort_nulls", "nation", "SELECT nullif(n_regionkey, 2) AS r, n_name FROM nation ORDER BY r ASC NULLS LAST, n_name LIMIT 12 OFFSET 3")
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 3000"
for _op in ("UNION", "INTERSECT", "EXCEPT"):
    sql(f"set_{_op.lower()}", "customer supplier", f"{_A} {_op} {_B}")
    sql(f"set_{_op.lower()}_all", "customer supplier", f"{_A} {_op} ALL {_B}")
sql("str_core", "nation", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, CAST(length(n_name) AS BIGINT) AS n, substring(n_name, 2, 3) AS s, replace(n_name, 'A', '_') AS r, lpad(n_name, 12, '*') AS p, trim(concat(' ', n_name, ' ')) AS t, reverse(n_name) AS v, left(n_name, 2) AS f, CAST(instr(n_name, 'A') AS BIGINT) AS i, concat_ws('-', n_name, 'x') AS w, md5(n_name) AS m, ascii(n_name) AS a, repeat(n_name, 2) AS rp FROM nation")
sql("str_regex", "part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#') AS r, regexp_extract(p_name, '([a-z]+)', 1) AS e FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#', 'g') AS r, regexp_extract(p_name, '([a-z]+)', 1) AS e FROM part")
sql("str_levenshtein", "nation", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
sql("str_hash", "nation", "SELECT n_nationkey, sha2(n_name, 256) AS h FROM nation", "SELECT n_nationkey, sha256(n_name) AS h FROM nation")
sql("math_core", "lineitem", "SELECT l_orderkey, l_linenumber, abs(-l_tax) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(power(l_quantity, 2), 4) AS p, round(ln(l_quantity), 6) AS ln, round(exp(l_tax), 6) AS e, l_linenumber % 3 AS m, round(sqrt(l_quantity), 6) AS s, round(log10(l_quantity), 6) AS lg, CAST(sign(l_discount - 0.05) AS INT) AS sg FROM lineitem WHERE l_quantity > 0")
sql("date_parts", "orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q, last_day(CAST(o_orderdate AS DATE)) AS l, o_orderdate + INTERVAL '3' DAY AS p FROM orders")
sql("date_trunc", "orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m FROM orders")
sql("cond", "customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer")
sql("json_get", "events", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
sql("arr_explode", "documents", "SELECT w, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS w FROM documents) GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w")
sql("arr_hof", "embeddings", "SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS n, round(aggregate(embedding, 0D, (a, x) -> a + x), 3) AS s FROM embeddings", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n, round(list_sum(embedding::DOUBLE[]), 3) + 0.0 AS s FROM embeddings")
sql("map_fns", "nation", "SELECT n_nationkey, transform_values(map_from_arrays(array('n', 'r'), array(n_nationkey, n_regionkey)), (k, v) -> v * 2)['n'] AS a, CAST(cardinality(map('x', n_name)) AS BIGINT) AS c FROM nation", "SELECT n_nationkey, CAST(map(['n', 'r'], [n_nationkey * 2, n_regionkey * 2])['n'] AS INTEGER) AS a, CAST(cardinality(map(['x'], [n_name])) AS BIGINT) AS c FROM nation")
sql("time_tumble", "events", "SELECT event_type, CAST(w.start AS TIMESTAMP_NTZ) AS start_ts, n FROM (SELECT event_type, window(ts, '1 day') AS w, count(*) AS n FROM events GROUP BY event_type, window(ts, '1 day'))", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start_ts, count(*) AS n FROM events GROUP BY ALL")
sql("time_slide", "events", "SELECT CAST(w.start AS TIMESTAMP_NTZ) AS start_ts, n FROM (SELECT window(ts, '1 day', '12 hours') AS w, count(*) AS n FROM events GROUP BY window(ts, '1 day', '12 hours'))", "SELECT start_ts, count(*) AS n FROM (SELECT unnest([b, b - INTERVAL 12 HOUR]) AS start_ts FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b FROM events)) GROUP BY ALL")
sql("doc_exact_dedup", "documents", "SELECT sha2(text, 256) AS h, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha2(text, 256)", "SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
sql("html_strip", "pages", "SELECT page_id, sha2(regexp_replace(html, '<[^>]*>', ' '), 256) AS h FROM pages", "SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS h FROM pages")
