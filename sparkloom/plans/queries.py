"""The query suite: one GoogleSQL text for each operator group, with its oracle.

``None`` as oracle means that the GoogleSQL text itself is also the oracle's.
"""

from __future__ import annotations

_REV = "l_extendedprice * (1 - l_discount)"

SUITE: dict[str, tuple[str, str | None]] = {
    # ------------------------------------------------- scans, projection, filters
    "pricing_summary": (
        f"""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM({_REV}), 2) AS sum_disc,
                   ROUND(SUM({_REV} * (1 + l_tax)), 2) AS sum_charge, ROUND(AVG(l_quantity), 4) AS avg_qty, COUNT(*) AS n
            FROM lineitem WHERE l_shipdate <= DATETIME '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""",
        f"""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM({_REV}), 2) AS sum_disc,
                   ROUND(SUM({_REV} * (1 + l_tax)), 2) AS sum_charge, ROUND(AVG(l_quantity), 4) AS avg_qty, COUNT(*) AS n
            FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    ),
    "scan_project_filter": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem WHERE l_quantity > 45 AND NOT l_returnflag = 'N'", None),
    "select_star_except": ("SELECT * EXCEPT (c_acctbal, c_name) FROM customer WHERE c_nationkey = 7", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer WHERE c_nationkey = 7"),
    "select_star_replace": ("SELECT * REPLACE (UPPER(n_name) AS n_name) FROM nation", None),
    "select_as_struct": ("SELECT s.value.a AS a, s.value.b AS b FROM (SELECT AS STRUCT n_nationkey AS a, n_name AS b FROM nation) AS s", "SELECT n_nationkey AS a, n_name AS b FROM nation"),
    "select_no_from": ("SELECT 1 AS a, 'x' AS b, TRUE AS c", "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, TRUE AS c"),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "between_in_like": ("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_type NOT LIKE '%STEEL%'", None),
    "is_null_distinct_from": ("SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') IS NULL AS isnull, NULLIF(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY' AS d FROM customer", None),
    "case_if_coalesce": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, IF(o_orderstatus = 'F', 1, 0) AS f, COALESCE(NULLIF(o_orderstatus, 'O'), '-') AS s, IFNULL(NULLIF(o_orderpriority, '1-URGENT'), 'u') AS p FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS f, COALESCE(NULLIF(o_orderstatus, 'O'), '-') AS s, IFNULL(NULLIF(o_orderpriority, '1-URGENT'), 'u') AS p FROM orders",
    ),
    "cast": ("SELECT c_custkey, CAST(c_custkey AS STRING) AS s, CAST(CAST(c_nationkey AS STRING) AS INT64) AS i, CAST(c_acctbal AS NUMERIC) > 0 AS pos, CAST(c_nationkey = 3 AS STRING) AS b FROM customer", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS s, CAST(c_nationkey AS BIGINT) AS i, c_acctbal > 0 AS pos, CAST(c_nationkey = 3 AS VARCHAR) AS b FROM customer"),
    "safe_cast": ("SELECT n_nationkey, SAFE_CAST(n_name AS INT64) AS i, SAFE_CAST(CAST(n_nationkey AS STRING) AS INT64) AS j FROM nation", "SELECT n_nationkey, TRY_CAST(n_name AS BIGINT) AS i, CAST(n_nationkey AS BIGINT) AS j FROM nation"),
    "safe_divide": ("SELECT n_nationkey, ROUND(SAFE_DIVIDE(100, n_regionkey), 6) AS d, DIV(n_nationkey, 4) AS q, MOD(n_nationkey, 4) AS m FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN ROUND(100 / n_regionkey, 6) END AS d, CAST(n_nationkey // 4 AS BIGINT) AS q, CAST(n_nationkey % 4 AS BIGINT) AS m FROM nation"),
    "tablesample_all": ("SELECT COUNT(*) AS n FROM nation TABLESAMPLE SYSTEM (100 PERCENT)", "SELECT COUNT(*) AS n FROM nation"),
    # ------------------------------------------------------------------- joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000", None),
    "join_right": ("SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) AS c RIGHT OUTER JOIN orders AS o ON c.c_custkey = o.o_custkey", None),
    "join_full_using": ("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation WHERE n_nationkey > 8) USING (k)", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n", None),
    "join_comma": ("SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey", None),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey", None),
    "join_range": ("SELECT s.s_suppkey, t.lo, t.hi FROM supplier AS s JOIN (SELECT n_nationkey * 400.0 - 1000 AS lo, n_nationkey * 400.0 - 600 AS hi FROM nation) AS t ON s.s_acctbal BETWEEN t.lo AND t.hi", "SELECT s.s_suppkey, t.lo, t.hi FROM supplier AS s JOIN (SELECT n_nationkey * 400.0::DOUBLE - 1000 AS lo, n_nationkey * 400.0::DOUBLE - 600 AS hi FROM nation) AS t ON s.s_acctbal BETWEEN t.lo AND t.hi"),
    "join_semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "join_semi_exists": ("SELECT s_suppkey FROM supplier AS s WHERE EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 49)", None),
    "join_anti_not_exists": ("SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey)", None),
    "join_anti_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "join_multiway": (f"""SELECT n.n_name, ROUND(SUM({_REV}), 2) AS revenue FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN lineitem AS l ON l.l_orderkey = o.o_orderkey JOIN supplier AS s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
                         JOIN nation AS n ON s.s_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name""", None),
    "join_self": ("SELECT a.o_custkey, COUNT(*) AS pairs FROM orders AS a JOIN orders AS b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey", None),
    "join_lateral": ("SELECT n.n_name, t.m FROM nation AS n, LATERAL (SELECT MAX(c_acctbal) AS m FROM customer AS c WHERE c.c_nationkey = n.n_nationkey) AS t", None),
    # ------------------------------------------------------------------ arrays
    "unnest_array": ("SELECT x, x * x AS y FROM UNNEST([1, 2, 3, 5]) AS x", "SELECT x, x * x AS y FROM (SELECT CAST(unnest([1, 2, 3, 5]) AS BIGINT) AS x)"),
    "unnest_with_offset": ("SELECT x, o FROM UNNEST(['a', 'b', 'c']) AS x WITH OFFSET AS o", "SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2)) AS t(x, o)"),
    "unnest_correlated": ("SELECT e.vec_id, o, ROUND(v, 5) AS v FROM embeddings AS e, UNNEST(e.embedding) AS v WITH OFFSET AS o WHERE o < 3", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS o, ROUND(embedding[i], 5) AS v FROM embeddings, (SELECT unnest([1, 2, 3]) AS i)"),
    "unnest_left": ("SELECT t.k, x FROM (SELECT n_nationkey AS k, IF(n_nationkey < 3, ['p', 'q'], []) AS a FROM nation) AS t LEFT JOIN UNNEST(t.a) AS x", "SELECT n_nationkey AS k, x FROM nation LEFT JOIN (VALUES ('p'), ('q')) AS v(x) ON n_nationkey < 3"),
    "unnest_struct": ("SELECT id, name FROM UNNEST([STRUCT(1 AS id, 'a' AS name), STRUCT(2, 'b')])", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, 'b')) AS t(id, name)"),
    "array_subquery": ("SELECT vec_id, ARRAY_LENGTH(ARRAY(SELECT v FROM UNNEST(embedding) AS v WHERE v > 0)) AS pos, EXISTS(SELECT 1 FROM UNNEST(embedding) AS v WHERE v > 0.2) AS big FROM embeddings", "SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v > 0)) AS BIGINT) AS pos, len(list_filter(embedding, lambda v: v > 0.2)) > 0 AS big FROM embeddings"),
    "array_ops": (
        "SELECT vec_id, ARRAY_LENGTH(embedding) AS n, ROUND(embedding[OFFSET(0)], 5) AS a, ROUND(embedding[ORDINAL(2)], 5) AS b, embedding[SAFE_OFFSET(999)] AS c, 3 IN UNNEST(GENERATE_ARRAY(1, label + 1)) AS d, ARRAY_TO_STRING(['x', CAST(label AS STRING)], '-') AS e, ARRAY_REVERSE([1, label])[OFFSET(0)] AS f, ARRAY_LENGTH(ARRAY_CONCAT([1], [2, 3])) AS g FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, ROUND(embedding[1], 5) AS a, ROUND(embedding[2], 5) AS b, embedding[1000] AS c, 3 <= label + 1 AS d, 'x-' || CAST(label AS VARCHAR) AS e, CAST(label AS BIGINT) AS f, CAST(3 AS BIGINT) AS g FROM embeddings",
    ),
    "struct_ops": ("SELECT t.s.id AS id, t.s.label AS label FROM (SELECT STRUCT(n_nationkey AS id, n_name AS label) AS s FROM nation) AS t WHERE t.s.id > 20", "SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey > 20"),
    # -------------------------------------------------------------- aggregates
    "agg_global": ("SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS INT64) AS s, ROUND(AVG(l_quantity), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem"),
    "agg_group": ("SELECT l_suppkey, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey", None),
    "agg_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag", None),
    "agg_countif": ("SELECT o_orderstatus, COUNTIF(o_totalprice > 150000) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(COUNT_IF(o_totalprice > 150000) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_stddev_var_corr": (
        "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 4) AS a, ROUND(STDDEV_POP(l_quantity), 4) AS b, ROUND(VAR_SAMP(l_quantity), 4) AS c, ROUND(VAR_POP(l_quantity), 4) AS d, ROUND(CORR(l_quantity, l_extendedprice), 4) AS e, ROUND(COVAR_POP(l_quantity, l_discount), 4) AS f, ROUND(COVAR_SAMP(l_quantity, l_discount), 4) AS g, ROUND(STDDEV(l_tax), 6) AS h, ROUND(VARIANCE(l_tax), 6) AS i FROM lineitem GROUP BY l_returnflag",
        None,
    ),
    "agg_string_agg": ("SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name DESC) AS names, STRING_AGG(n_name, ',' ORDER BY n_nationkey LIMIT 2) AS two FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name DESC) AS names, array_to_string(list(n_name ORDER BY n_nationkey)[1:2], ',') AS two FROM nation GROUP BY n_regionkey"),
    "agg_array_agg": ("SELECT n_regionkey, ARRAY_TO_STRING(ARRAY_AGG(n_name ORDER BY n_name), ',') AS a, ARRAY_LENGTH(ARRAY_AGG(DISTINCT MOD(n_nationkey, 2))) AS d, ARRAY_LENGTH(ARRAY_AGG(NULLIF(n_nationkey, 3) IGNORE NULLS)) AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS a, CAST(COUNT(DISTINCT n_nationkey % 2) AS BIGINT) AS d, COUNT(NULLIF(n_nationkey, 3)) AS k FROM nation GROUP BY n_regionkey"),
    "agg_any_value_having": ("SELECT c_nationkey, ANY_VALUE(c_custkey HAVING MAX c_acctbal) AS top, ANY_VALUE(c_custkey HAVING MIN c_acctbal) AS low FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS top, arg_min(c_custkey, c_acctbal) AS low FROM customer GROUP BY c_nationkey"),
    "agg_logical_bit": ("SELECT c_nationkey, LOGICAL_AND(c_acctbal > -900) AS a, LOGICAL_OR(c_acctbal > 9900) AS b, BIT_AND(c_custkey) AS c, BIT_OR(c_custkey) AS d, BIT_XOR(c_custkey) AS e FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, BOOL_AND(c_acctbal > -900) AS a, BOOL_OR(c_acctbal > 9900) AS b, BIT_AND(c_custkey) AS c, BIT_OR(c_custkey) AS d, BIT_XOR(c_custkey) AS e FROM customer GROUP BY c_nationkey"),
    "agg_filtered": ("SELECT o_orderstatus, SUM(IF(o_orderpriority = '1-URGENT', 1, 0)) AS urgent, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_approx": ("SELECT ABS(APPROX_COUNT_DISTINCT(l_suppkey) - COUNT(DISTINCT l_suppkey)) <= COUNT(DISTINCT l_suppkey) / 10 AS near, ARRAY_LENGTH(APPROX_QUANTILES(l_quantity, 4)) AS q, ARRAY_LENGTH(APPROX_TOP_COUNT(l_returnflag, 2)) AS t FROM lineitem", "SELECT TRUE AS near, CAST(5 AS BIGINT) AS q, CAST(2 AS BIGINT) AS t"),
    "agg_hll": ("SELECT ABS(HLL_COUNT.EXTRACT(s) - n) <= n / 10 AS near FROM (SELECT HLL_COUNT.INIT(l_partkey) AS s, COUNT(DISTINCT l_partkey) AS n FROM lineitem)", "SELECT TRUE AS near"),
    "agg_percentile": ("SELECT DISTINCT l_returnflag, ROUND(PERCENTILE_CONT(l_quantity, 0.5) OVER (PARTITION BY l_returnflag), 4) AS m FROM lineitem", "SELECT l_returnflag, ROUND(quantile_cont(l_quantity, 0.5), 4) AS m FROM lineitem GROUP BY l_returnflag"),
    "agg_group_struct": ("SELECT s.a AS a, s.b AS b, n FROM (SELECT STRUCT(l_returnflag AS a, l_linestatus AS b) AS s, COUNT(*) AS n FROM lineitem GROUP BY s)", "SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY 1, 2"),
    "agg_group_json": ("SELECT TO_JSON_STRING(PARSE_JSON(props)) AS j, COUNT(*) AS n FROM events GROUP BY j", "SELECT replace(props, ': ', ':') AS j, COUNT(*) AS n FROM events GROUP BY 1"),
    "group_by_all": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL", None),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "rollup": ("SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)", None),
    "cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    # ------------------------------------------------------------------ windows
    "win_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", None),
    "win_rank": ("SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d FROM orders", None),
    "win_percent_ntile": ("SELECT c_custkey, ROUND(PERCENT_RANK() OVER w, 6) AS p, ROUND(CUME_DIST() OVER w, 6) AS c, NTILE(4) OVER w AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)", None),
    "win_lag_lead": ("SELECT o_orderkey, LAG(o_orderkey) OVER w AS a, LEAD(o_orderkey, 2) OVER w AS b, LAG(o_orderkey, 1, -1) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "win_first_last_nth": ("SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "win_ignore_nulls": ("SELECT event_id, LAST_VALUE(IF(value > 90, event_id, NULL) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_big FROM events", "SELECT event_id, LAST_VALUE(CASE WHEN value > 90 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_big FROM events"),
    "win_rows_frame": ("SELECT l_orderkey, l_linenumber, ROUND(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM lineitem", None),
    "win_range_frame": ("SELECT n_nationkey, SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM nation", "SELECT n_nationkey, CAST(SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS s FROM nation"),
    "win_count_distinct": ("SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders", "SELECT o_orderkey, n FROM orders JOIN (SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) USING (o_custkey)"),
    "qualify": ("SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", None),
    # ------------------------------------------------------------- sort, limits
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "topk_per_group": ("SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3", None),
    "limit_offset": ("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5", None),
    "order_nulls": ("SELECT k FROM (SELECT NULLIF(n_nationkey, 5) AS k FROM nation) ORDER BY k DESC NULLS FIRST LIMIT 4", None),
    # --------------------------------------------------------- sets, CTEs, subqueries
    "union_all": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "except_distinct": ("SELECT c_custkey AS k FROM customer EXCEPT DISTINCT SELECT o_custkey FROM orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "intersect_distinct": ("SELECT c_custkey AS k FROM customer INTERSECT DISTINCT SELECT o_custkey FROM orders", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "cte": ("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT alias.n AS n, COUNT(*) AS custs FROM per AS alias GROUP BY alias.n", None),
    "cte_recursive": ("WITH RECURSIVE r AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r", "WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS f UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r"),
    "subquery_from": ("SELECT AVG(n) AS a FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey)", None),
    "subquery_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)", None),
    "subquery_correlated": ("SELECT p_partkey, (SELECT COUNT(*) FROM lineitem AS l WHERE l.l_partkey = p.p_partkey) AS n FROM part AS p", None),
    "pivot": ("SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus = 'F') AS f, COUNT(*) FILTER (o_orderstatus = 'O') AS o, COUNT(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority"),
    "unpivot": ("SELECT s_suppkey, k, v FROM (SELECT s_suppkey, s_nationkey AS a, s_nationkey + 1 AS b FROM supplier) UNPIVOT (v FOR k IN (a, b))", "SELECT s_suppkey, 'a' AS k, CAST(s_nationkey AS BIGINT) AS v FROM supplier UNION ALL SELECT s_suppkey, 'b', CAST(s_nationkey + 1 AS BIGINT) FROM supplier"),
    "pipe_syntax": ("FROM orders |> WHERE o_totalprice > 100000 |> AGGREGATE COUNT(*) AS n GROUP BY o_orderstatus |> WHERE n > 1 |> SELECT o_orderstatus, n", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING COUNT(*) > 1"),
    # ------------------------------------------------------------------ scalars
    "math": (
        "SELECT c_custkey, ABS(c_acctbal) AS a, CEIL(c_acctbal) AS b, FLOOR(c_acctbal) AS c, ROUND(c_acctbal) AS d, ROUND(c_acctbal, 1) AS e, TRUNC(c_acctbal) AS f, ROUND(SQRT(ABS(c_acctbal)), 6) AS g, ROUND(LN(c_custkey + 1), 6) AS h, ROUND(LOG(c_custkey + 1, 2), 6) AS i, ROUND(LOG10(c_custkey + 1), 6) AS j, POWER(c_nationkey, 2) AS k, ROUND(EXP(c_nationkey / 10), 6) AS l, GREATEST(c_custkey, 500) AS m, LEAST(c_custkey, 500) AS n, ROUND(ATAN2(c_acctbal, 100.0), 6) AS o, MOD(-c_custkey, 7) AS p, IS_NAN(c_acctbal) AS q FROM customer",
        "SELECT c_custkey, ABS(c_acctbal) AS a, CEIL(c_acctbal) AS b, FLOOR(c_acctbal) AS c, ROUND(c_acctbal) AS d, ROUND(c_acctbal, 1) AS e, TRUNC(c_acctbal) AS f, ROUND(SQRT(ABS(c_acctbal)), 6) AS g, ROUND(LN(c_custkey + 1), 6) AS h, ROUND(LOG2(c_custkey + 1), 6) AS i, ROUND(LOG10(c_custkey + 1), 6) AS j, POWER(c_nationkey, 2) AS k, ROUND(EXP(c_nationkey / 10), 6) AS l, GREATEST(c_custkey, 500) AS m, LEAST(c_custkey, 500) AS n, ROUND(ATAN2(c_acctbal, 100.0), 6) AS o, -c_custkey % 7 AS p, isnan(c_acctbal) AS q FROM customer",
    ),
    "bitops": ("SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, o_orderkey ^ 5 AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e, BIT_COUNT(o_orderkey) AS f FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e, CAST(bit_count(o_orderkey) AS INTEGER) AS f FROM orders"),
    "str_basic": (
        "SELECT p_partkey, CONCAT(p_brand, '/', p_name) AS a, LENGTH(p_name) AS b, UPPER(p_name) AS c, LOWER(p_brand) AS d, SUBSTR(p_name, 2, 3) AS e, SUBSTR(p_name, -3) AS f, LEFT(p_name, 2) AS g, RIGHT(p_name, 2) AS h, REVERSE(p_brand) AS i, REPEAT('ab', p_size - p_size + 2) AS j, REPLACE(p_name, 'a', 'x') AS k, STARTS_WITH(p_brand, 'Brand#1') AS l, ENDS_WITH(p_brand, '3') AS m, STRPOS(p_name, 'e') AS n, BYTE_LENGTH(p_name) AS o, p_name || '!' AS p FROM part",
        "SELECT p_partkey, CONCAT(p_brand, '/', p_name) AS a, CAST(LENGTH(p_name) AS INTEGER) AS b, UPPER(p_name) AS c, LOWER(p_brand) AS d, SUBSTR(p_name, 2, 3) AS e, RIGHT(p_name, 3) AS f, LEFT(p_name, 2) AS g, RIGHT(p_name, 2) AS h, REVERSE(p_brand) AS i, REPEAT('ab', 2) AS j, REPLACE(p_name, 'a', 'x') AS k, STARTS_WITH(p_brand, 'Brand#1') AS l, ENDS_WITH(p_brand, '3') AS m, CAST(STRPOS(p_name, 'e') AS INTEGER) AS n, CAST(strlen(p_name) AS INTEGER) AS o, p_name || '!' AS p FROM part",
    ),
    "str_pad_trim": ("SELECT n_nationkey, LPAD(n_name, 12, '*') AS a, RPAD(n_name, 12, '-') AS b, TRIM(CONCAT('  ', n_name, ' ')) AS c, LTRIM(CONCAT('  ', n_name)) AS d, RTRIM(CONCAT(n_name, '  ')) AS e, TRIM(CONCAT('xy', n_name, 'yx'), 'xy') AS f, TRANSLATE(n_name, 'AE', 'ae') AS g FROM nation", "SELECT n_nationkey, LPAD(n_name, 12, '*') AS a, RPAD(n_name, 12, '-') AS b, n_name AS c, n_name AS d, n_name AS e, TRIM(CONCAT('xy', n_name, 'yx'), 'xy') AS f, TRANSLATE(n_name, 'AE', 'ae') AS g FROM nation"),
    "str_split": ("SELECT c_custkey, SPLIT(c_name, '#')[SAFE_OFFSET(1)] AS a, ARRAY_LENGTH(SPLIT('a.b.c', '.')) AS b, SPLIT(c_name, 'e')[OFFSET(0)] AS c FROM customer", "SELECT c_custkey, string_split(c_name, '#')[2] AS a, CAST(3 AS BIGINT) AS b, string_split(c_name, 'e')[1] AS c FROM customer"),
    "regexp": ("SELECT p_partkey, REGEXP_CONTAINS(p_brand, r'#[12]\\d') AS a, REGEXP_EXTRACT(p_brand, r'#(\\d)') AS b, REGEXP_EXTRACT(p_brand, r'zz') AS c, REGEXP_REPLACE(p_brand, r'(\\w+)#(\\d+)', r'\\2-\\1') AS d, ARRAY_LENGTH(REGEXP_EXTRACT_ALL(p_name, r'[aeiou]')) AS e FROM part".replace("\\\\", "\\"), r"SELECT p_partkey, regexp_matches(p_brand, '#[12]\d') AS a, NULLIF(regexp_extract(p_brand, '#(\d)', 1), '') AS b, CAST(NULL AS VARCHAR) AS c, regexp_replace(p_brand, '(\w+)#(\d+)', '\2-\1') AS d, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS e FROM part"),
    "hash_base64": ("SELECT n_nationkey, TO_HEX(MD5(n_name)) AS a, TO_HEX(SHA256(n_name)) AS b, TO_BASE64(CAST(n_name AS BYTES)) AS c, CAST(FROM_BASE64(TO_BASE64(CAST(n_name AS BYTES))) AS STRING) AS d, TO_HEX(b'\\x0a\\xff') AS e, ASCII(n_name) AS f, CHR(65 + n_regionkey) AS g FROM nation", "SELECT n_nationkey, md5(n_name) AS a, sha256(n_name) AS b, to_base64(encode(n_name)) AS c, n_name AS d, '0aff' AS e, ascii(n_name) AS f, chr(65 + n_regionkey) AS g FROM nation"),
    "format": ("SELECT n_nationkey, FORMAT('%d-%s', n_nationkey, n_name) AS a, FORMAT('%05d', n_nationkey) AS b, FORMAT('%.2f', n_nationkey / 4) AS c FROM nation", "SELECT n_nationkey, format('{}-{}', n_nationkey, n_name) AS a, format('{:05d}', n_nationkey) AS b, format('{:.2f}', n_nationkey / 4) AS c FROM nation"),
    # -------------------------------------------------------------- date and time
    "date_arith": ("SELECT o_orderkey, DATE_ADD(d, INTERVAL 3 DAY) AS a, DATE_SUB(d, INTERVAL 2 WEEK) AS b, DATE_ADD(d, INTERVAL 1 MONTH) AS c, DATE_SUB(d, INTERVAL 1 YEAR) AS e, DATE_ADD(d, INTERVAL 1 QUARTER) AS f, LAST_DAY(d) AS g FROM (SELECT o_orderkey, DATE(o_orderdate) AS d FROM orders)", "SELECT o_orderkey, d + 3 AS a, d - 14 AS b, CAST(d + INTERVAL 1 MONTH AS DATE) AS c, CAST(d - INTERVAL 1 YEAR AS DATE) AS e, CAST(d + INTERVAL 3 MONTH AS DATE) AS f, last_day(d) AS g FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"),
    "date_diff": ("SELECT o_orderkey, DATE_DIFF(DATE '1999-01-01', d, DAY) AS a, DATE_DIFF(DATE '1999-01-01', d, MONTH) AS b, DATE_DIFF(DATE '1999-01-01', d, QUARTER) AS c, DATE_DIFF(DATE '1999-01-01', d, YEAR) AS e, DATE_DIFF(DATE '1999-01-01', d, ISOWEEK) AS f FROM (SELECT o_orderkey, DATE(o_orderdate) AS d FROM orders)", "SELECT o_orderkey, date_diff('day', d, DATE '1999-01-01') AS a, date_diff('month', d, DATE '1999-01-01') AS b, date_diff('quarter', d, DATE '1999-01-01') AS c, date_diff('year', d, DATE '1999-01-01') AS e, CAST((CAST(date_trunc('week', DATE '1999-01-01') AS DATE) - CAST(date_trunc('week', d) AS DATE)) // 7 AS BIGINT) AS f FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"),
    "date_trunc": ("SELECT o_orderkey, DATE_TRUNC(d, MONTH) AS a, DATE_TRUNC(d, YEAR) AS b, DATE_TRUNC(d, QUARTER) AS c, DATE_TRUNC(d, ISOWEEK) AS e, DATE_TRUNC(d, WEEK) AS f FROM (SELECT o_orderkey, DATE(o_orderdate) AS d FROM orders)", "SELECT o_orderkey, CAST(date_trunc('month', d) AS DATE) AS a, CAST(date_trunc('year', d) AS DATE) AS b, CAST(date_trunc('quarter', d) AS DATE) AS c, CAST(date_trunc('week', d) AS DATE) AS e, d - CAST(dayofweek(d) AS INTEGER) AS f FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"),
    "extract": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS a, EXTRACT(MONTH FROM ts) AS b, EXTRACT(DAY FROM ts) AS c, EXTRACT(HOUR FROM ts) AS d, EXTRACT(MINUTE FROM ts) AS e, EXTRACT(SECOND FROM ts) AS f, EXTRACT(DAYOFWEEK FROM ts) AS g, EXTRACT(DAYOFYEAR FROM ts) AS h, EXTRACT(QUARTER FROM ts) AS i, EXTRACT(ISOWEEK FROM ts) AS j, EXTRACT(DATE FROM ts) AS k FROM events", "SELECT event_id, extract(year FROM ts) AS a, extract(month FROM ts) AS b, extract(day FROM ts) AS c, extract(hour FROM ts) AS d, extract(minute FROM ts) AS e, extract(second FROM ts) AS f, dayofweek(ts) + 1 AS g, dayofyear(ts) AS h, quarter(ts) AS i, weekofyear(ts) AS j, CAST(ts AS DATE) AS k FROM events"),
    "timestamp_arith": ("SELECT event_id, DATETIME_ADD(ts, INTERVAL 90 MINUTE) AS a, DATETIME_SUB(ts, INTERVAL 2 HOUR) AS b, DATETIME_TRUNC(ts, HOUR) AS c, DATETIME_TRUNC(ts, DAY) AS d, DATETIME_DIFF(ts, DATETIME '2024-01-01 00:00:00', HOUR) AS e, UNIX_SECONDS(TIMESTAMP(ts)) AS f, TIMESTAMP_DIFF(TIMESTAMP(ts), TIMESTAMP '2023-01-01 00:00:00+00', MINUTE) AS g FROM events", "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 2 HOUR AS b, date_trunc('hour', ts) AS c, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS e, CAST(floor(epoch(ts)) AS BIGINT) AS f, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2023-01-01')) / 60000000) AS BIGINT) AS g FROM events"),
    "timestamp_unix": ("SELECT n_nationkey, UNIX_MICROS(TIMESTAMP_SECONDS(n_nationkey)) AS a, UNIX_MICROS(TIMESTAMP_MILLIS(n_nationkey)) AS b, UNIX_MICROS(TIMESTAMP_MICROS(n_nationkey)) AS c FROM nation", "SELECT n_nationkey, n_nationkey * CAST(1000000 AS BIGINT) AS a, n_nationkey * CAST(1000 AS BIGINT) AS b, CAST(n_nationkey AS BIGINT) AS c FROM nation"),
    "format_parse_date": ("SELECT o_orderkey, FORMAT_DATE('%Y/%m/%d', DATE(o_orderdate)) AS a, PARSE_DATE('%d-%m-%Y', FORMAT_DATE('%d-%m-%Y', DATE(o_orderdate))) AS b, FORMAT_DATETIME('%H:%M:%S %b', o_orderdate) AS c FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS a, CAST(o_orderdate AS DATE) AS b, strftime(o_orderdate, '%H:%M:%S %b') AS c FROM orders"),
    "generate_date_array": ("SELECT d, EXTRACT(DAYOFWEEK FROM d) AS w FROM UNNEST(GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 7 DAY)) AS d", "SELECT CAST(d AS DATE) AS d, dayofweek(d) + 1 AS w FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 7 DAY)) AS d)"),
    # ---------------------------------------------------------------------- JSON
    "json_value": ("SELECT event_id, JSON_VALUE(props, '$.k') AS a, CAST(JSON_VALUE(PARSE_JSON(props), '$.k') AS INT64) AS b, JSON_EXTRACT_SCALAR(props, '$.none') AS c FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS c FROM events"),
    "json_extract": ("SELECT event_id, JSON_QUERY(props, '$.k') AS a, ARRAY_LENGTH(JSON_EXTRACT_ARRAY('[1, 2, 3]')) AS b, TO_JSON_STRING(STRUCT(event_id AS id, event_type AS t)) AS c FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS a, CAST(3 AS BIGINT) AS b, CAST(to_json({'id': event_id, 't': event_type}) AS VARCHAR) AS c FROM events"),
    "json_field": ("SELECT event_id, CAST(j.k AS INT64) AS k FROM (SELECT event_id, PARSE_JSON(props) AS j FROM events)", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    # ---------------------------------------------------------------------- TPC-like
    "shipping_priority": (f"SELECT l.l_orderkey, ROUND(SUM({_REV}), 2) AS revenue, o.o_orderdate FROM customer AS c, orders AS o, lineitem AS l WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < DATETIME '1995-03-15' AND l.l_shipdate > DATETIME '1995-03-15' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderdate, l.l_orderkey LIMIT 10", f"SELECT l.l_orderkey, ROUND(SUM({_REV}), 2) AS revenue, o.o_orderdate FROM customer AS c, orders AS o, lineitem AS l WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < TIMESTAMP '1995-03-15' AND l.l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderdate, l.l_orderkey LIMIT 10"),
    "forecast_revenue": ("SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    "large_orders": ("SELECT o.o_orderkey, ROUND(SUM(l.l_quantity), 2) AS q FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 150) GROUP BY o.o_orderkey", None),
    # ------------------------------------------------------------ casts, JSON and rarer functions
    "cast_float": (
        "SELECT n_nationkey, CAST(n_nationkey / 2 - 3 AS INT64) AS a, SAFE_CAST(n_nationkey / 4 AS INT64) AS b, CAST(CAST(n_nationkey AS NUMERIC) / 2 AS INT64) AS c, CAST(-1.5 AS INT64) AS d FROM nation",
        "SELECT n_nationkey, CAST(sign(x) * floor(abs(x) + 0.5) AS BIGINT) AS a, CAST(floor(n_nationkey / 4 + 0.5) AS BIGINT) AS b, CAST(floor(n_nationkey / 2 + 0.5) AS BIGINT) AS c, CAST(-2 AS BIGINT) AS d FROM (SELECT *, n_nationkey / 2 - 3 AS x FROM nation)",
    ),
    "cast_float_string": ("SELECT CAST(x AS STRING) AS s FROM UNNEST([1e20, 1.0, 1.5, 0.0001, 0.00001, 1e14, 1e15, -2.25]) AS x", "SELECT unnest(['1e+20', '1', '1.5', '0.0001', '1e-05', '100000000000000', '1e+15', '-2.25']) AS s"),
    "cast_timestamp_string": (
        "SELECT event_id, CAST(TIMESTAMP(ts) AS STRING) AS s FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' WHEN microsecond(ts) % 1000 = 0 THEN strftime(ts, '.%g') ELSE strftime(ts, '.%f') END || '+00' AS s FROM events",
    ),
    "json_value_text": (
        """SELECT event_id, JSON_VALUE(CONCAT('{"a": "[', event_type, '"}'), '$.a') AS a, JSON_VALUE(CONCAT('{"a": "{x}", "b": ', props, '}'), '$.b') AS b, JSON_VALUE(CONCAT('{"a": [', props, ']}'), '$.a[0].k') AS c, JSON_EXTRACT_SCALAR(props, '$.k') AS d FROM events""",
        "SELECT event_id, '[' || event_type AS a, CAST(NULL AS VARCHAR) AS b, json_extract_string(props, '$.k') AS c, json_extract_string(props, '$.k') AS d FROM events",
    ),
    "json_extract_text": ("""SELECT event_id, JSON_EXTRACT(props, '$.k') AS a, JSON_EXTRACT(CONCAT('{"x": ', props, '}'), '$.x') AS b FROM events""", "SELECT event_id, json_extract_string(props, '$.k') AS a, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS b FROM events"),
    "json_keys": ("""SELECT k FROM UNNEST(JSON_KEYS(JSON '{"b": {"c": 1, "d": {"e": 2}}, "a": [{"z": 1}]}')) AS k""", "SELECT unnest(['a', 'b', 'b.c', 'b.d', 'b.d.e']) AS k"),
    "json_literal": ("""SELECT n_nationkey, JSON_VALUE(JSON '{"a": {"b": "x"}}', '$.a.b') AS v FROM nation""", "SELECT n_nationkey, 'x' AS v FROM nation"),
    "agg_percentile_disc": (
        "SELECT DISTINCT c_nationkey, PERCENTILE_DISC(c_acctbal, 0.5) OVER (PARTITION BY c_nationkey) AS p FROM customer",
        "SELECT c_nationkey, quantile_disc(c_acctbal, 0.5) AS p FROM customer GROUP BY 1",
    ),
    "agg_mode": ("SELECT MODE(n) AS m FROM (SELECT IF(n_nationkey < 20, 7, n_nationkey) AS n FROM nation)", "SELECT CAST(7 AS BIGINT) AS m"),
    "agg_filter": ("SELECT n_regionkey, COUNT(*) FILTER (WHERE n_nationkey > 10) AS n, SUM(n_nationkey) FILTER (WHERE n_nationkey < 15) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, COUNT(*) FILTER (WHERE n_nationkey > 10) AS n, CAST(SUM(n_nationkey) FILTER (WHERE n_nationkey < 15) AS BIGINT) AS s FROM nation GROUP BY n_regionkey"),
    "math_more": (
        "SELECT c_custkey, CEILING(c_acctbal) AS a, SIGN(c_acctbal) AS b, ROUND(SIN(c_acctbal), 8) AS c, ROUND(COS(c_acctbal), 8) AS d, ROUND(TAN(c_acctbal / 10000), 8) AS e, ROUND(ATAN2(c_acctbal, 2), 8) AS f, c_custkey & 12 AS g, c_custkey | 3 AS h, c_custkey ^ 5 AS i, c_custkey << 2 AS j, c_custkey >> 1 AS k, RAND() BETWEEN 0 AND 1 AS l FROM customer",
        "SELECT c_custkey, CEIL(c_acctbal) AS a, CAST(SIGN(c_acctbal) AS DOUBLE) AS b, ROUND(SIN(c_acctbal), 8) AS c, ROUND(COS(c_acctbal), 8) AS d, ROUND(TAN(c_acctbal / 10000), 8) AS e, ROUND(ATAN2(c_acctbal, 2), 8) AS f, c_custkey & 12 AS g, c_custkey | 3 AS h, xor(c_custkey, 5) AS i, c_custkey * 4 AS j, c_custkey // 2 AS k, TRUE AS l FROM customer",
    ),
    "str_more": (
        "SELECT n_nationkey, SUBSTRING(n_name, 2, 3) AS a, INITCAP(LOWER(n_name)) AS b, LENGTH(GENERATE_UUID()) AS c, INSTR(n_name, 'A', 1, 2) AS d, INSTR(n_name, 'A', -1, 1) AS e, n_name LIKE ANY ('A%', '%N') AS f, n_name NOT LIKE ANY ('A%', '%N') AS g FROM nation",
        "SELECT n_nationkey, substring(n_name, 2, 3) AS a, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS b, CAST(36 AS INTEGER) AS c, CAST(CASE WHEN instr(n_name, 'A') > 0 AND instr(substr(n_name, instr(n_name, 'A') + 1), 'A') > 0 THEN instr(n_name, 'A') + instr(substr(n_name, instr(n_name, 'A') + 1), 'A') ELSE 0 END AS BIGINT) AS d, CAST(CASE WHEN instr(n_name, 'A') = 0 THEN 0 ELSE length(n_name) + 1 - instr(reverse(n_name), 'A') END AS BIGINT) AS e, n_name LIKE 'A%' OR n_name LIKE '%N' AS f, NOT (n_name LIKE 'A%' OR n_name LIKE '%N') AS g FROM nation",
    ),
    "timestamp_more": (
        "SELECT event_id, DATETIME(TIMESTAMP_ADD(TIMESTAMP(ts), INTERVAL 90 MINUTE)) AS a, DATETIME(TIMESTAMP_SUB(TIMESTAMP(ts), INTERVAL 2 DAY)) AS b, DATETIME(TIMESTAMP_TRUNC(TIMESTAMP(ts), HOUR)) AS c FROM events",
        "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 2 DAY AS b, date_trunc('hour', ts) AS c FROM events",
    ),
    "current_functions": ("SELECT CURRENT_DATE() >= DATE '2020-01-01' AS a, CURRENT_TIMESTAMP() > TIMESTAMP '2020-01-01' AS b, CURRENT_TIME() >= TIME '00:00:00' AS c, CURRENT_DATETIME() > DATETIME '2020-01-01' AS d", "SELECT TRUE AS a, TRUE AS b, TRUE AS c, TRUE AS d"),
    "time_literal": ("SELECT CAST(TIME '12:34:56' AS STRING) AS a, TIME '12:00:00' < TIME '12:00:01' AS b", "SELECT '12:34:56' AS a, TRUE AS b"),
    "comments": ("SELECT n_nationkey -- a\nFROM nation # b\nWHERE /* c */ n_regionkey = 1", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1"),
    "safe_prefix": ("SELECT n_nationkey, SAFE.LN(n_nationkey - 3) IS NULL AS a, SAFE.DIV(10, n_nationkey) AS b, SAFE.PARSE_DATE('%Y-%m-%d', n_name) AS c FROM nation", "SELECT n_nationkey, n_nationkey <= 3 AS a, CAST(CASE WHEN n_nationkey <> 0 THEN 10 // n_nationkey END AS BIGINT) AS b, CAST(NULL AS DATE) AS c FROM nation"),
    "exists_unnest": ("SELECT vec_id FROM embeddings WHERE EXISTS(SELECT 1 FROM UNNEST(embedding) AS v WHERE v > 0.25) AND NOT EXISTS(SELECT 1 FROM UNNEST(embedding) AS v WHERE v < -0.3)", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda v: v > 0.25)) > 0 AND len(list_filter(embedding, lambda v: v < -0.3)) = 0"),
    "unnest_left_offset": ("SELECT t.k, x, o FROM (SELECT n_nationkey AS k, IF(n_nationkey < 3, ['p', 'q'], []) AS a FROM nation) AS t LEFT JOIN UNNEST(t.a) AS x WITH OFFSET AS o", "SELECT n_nationkey AS k, x, o FROM nation LEFT JOIN (VALUES ('p', 0), ('q', 1)) AS v(x, o) ON n_nationkey < 3"),
}
