"""DuckDB SQL for every checked query (same column names, same rounding formula).

The tables ``region nation customer supplier part orders lineitem events documents labels``
are views in the oracle's DuckDB. Derived frames are CTEs written from their definition in
FIXTURES §5, independently of the Spark code.
"""

from __future__ import annotations


def r(expr: str, digits: int) -> str:
    """Round half away from zero on the scaled value, as ``frames.round_to`` does."""
    scale = 10 ** digits
    return f"(round(({expr}) * {scale}.0) / {scale}.0)"


def german(expr: str) -> str:
    return f"translate(format('{{:,.2f}}', {expr}), ',.', '.,')"


PERIOD_O = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT)"
PERIOD_L = "CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT)"

MEASURE = f"""measure AS (
  SELECT r_name AS region, {PERIOD_O} AS period, o_orderpriority AS category, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EXPOSURE_LONG = f"""exposure_long AS (
  SELECT r_name AS region, {PERIOD_L} AS period, sum(l_extendedprice) AS exposure
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2)"""

# Traffic as parsed from the wide export: marker months (period % 11 = 0) are missing.
TRAFFIC = """traffic AS (
  SELECT region, period, CASE WHEN period % 11 = 0 THEN NULL ELSE exposure END AS traffic
  FROM exposure_long)"""

SCORED = f"""scored AS (
  SELECT n_name AS region, l_returnflag || '-' || l_linestatus AS pollutant, {PERIOD_L} AS period,
         l_extendedprice AS actual, l_quantity * 3000.0 AS predicted
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

METRICS = """metrics AS (
  SELECT region, pollutant, count(*) AS n,
         sqrt(sum((actual - predicted) * (actual - predicted)) / count(*)) AS rmse,
         CASE WHEN var_pop(actual) * count(actual) = 0
              THEN CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0
                        THEN CAST('nan' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END
              ELSE 1.0 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(actual))
         END AS r2
  FROM scored GROUP BY region, pollutant)"""

ORDERS_TEXT = f"""orders_text AS (
  SELECT o_orderkey,
         CASE o_orderkey % 10
           WHEN 0 THEN ' ' || g || ' '
           WHEN 1 THEN g
           WHEN 2 THEN ' NA '
           WHEN 3 THEN ''
           WHEN 4 THEN 'n/a'
           WHEN 5 THEN '-'
           WHEN 6 THEN '—'
           WHEN 7 THEN 'None'
           WHEN 8 THEN g || ' t'
           ELSE '1,2,3' END AS raw
  FROM (SELECT o_orderkey, {german('o_totalprice')} AS g FROM orders))"""

MARKERS = "('na', 'n/a', 'null', 'none', '-', '—')"
CLEANED = f"CASE WHEN trim(raw) IS NULL OR trim(raw) = '' OR lower(trim(raw)) IN {MARKERS} THEN NULL ELSE trim(raw) END"

PRIORITY_COLS = [("1-URGENT", "1_URGENT"), ("2-HIGH", "2_HIGH"), ("3-MEDIUM", "3_MEDIUM"),
                 ("4-NOT SPECIFIED", "4_NOT_SPECIFIED"), ("5-LOW", "5_LOW")]

PIVOT = "piv AS (SELECT region, period, " + ", ".join(
    f"avg(value) FILTER (WHERE category = '{v}') AS \"{n}\"" for v, n in PRIORITY_COLS
) + " FROM measure GROUP BY region, period)"

PANEL_LONG = f"""panel_long AS (
  SELECT c.region, replace(replace(c.category, '-', '_'), ' ', '_') AS pollutant, c.period,
         c.label, COALESCE(t.traffic, 0.0) AS traffic, CAST(c.period AS DOUBLE) AS year_feature
  FROM (SELECT region, period, category, avg(value) AS label FROM measure GROUP BY 1, 2, 3) c
  LEFT JOIN traffic t ON c.region = t.region AND c.period = t.period)"""

SPLIT = """split AS (
  SELECT *, ('0x' || substr(md5(region || '|' || pollutant || '|' || CAST(period AS VARCHAR)), 1, 8))::BIGINT
              % 100 < 80 AS is_train
  FROM panel_long)"""

SUMMARY = f"""summary AS (
  SELECT pollutant,
         avg(CASE WHEN isnan(r2) THEN NULL ELSE r2 END) AS r2_mean,
         median(CASE WHEN isnan(r2) THEN NULL ELSE r2 END) AS r2_median,
         stddev_samp(CASE WHEN isnan(r2) THEN NULL ELSE r2 END) AS r2_std,
         avg(CASE WHEN isnan(rmse) THEN NULL ELSE rmse END) AS rmse_mean,
         median(CASE WHEN isnan(rmse) THEN NULL ELSE rmse END) AS rmse_median,
         stddev_samp(CASE WHEN isnan(rmse) THEN NULL ELSE rmse END) AS rmse_std,
         count(DISTINCT region) AS n_regions
  FROM metrics GROUP BY pollutant)"""

SUMMARY_COLS = ", ".join(
    f"{r(c, 4)} AS {c}" for c in ("r2_mean", "r2_median", "r2_std", "rmse_mean", "rmse_median", "rmse_std"))

CUSTOMER_REGIONS = """cr AS (
  SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

RECODE = "CASE r_name WHEN 'EUROPE' THEN 'EU' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' END"

ORACLE: dict[str, str] = {
    "io_delimited_scan": """
        SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey
        FROM supplier""",
    "io_locale_typed_load": f"""
        SELECT p_partkey, p_name, p_brand, CAST(p_partkey AS VARCHAR) ||
                 CASE p_partkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'F' ELSE '' END AS p_code, p_size > 25 AS p_large,
               CAST(p_size AS BIGINT) AS p_size,
               {r('p_retailprice', 2)} AS p_retailprice
        FROM part""",
    "io_payload_rows": """
        SELECT event_id, ts AS time, user_id, CASE WHEN floor(event_id / 512)::BIGINT % 2 = 0 THEN NULL ELSE event_type END AS event_type,
               CASE WHEN floor(event_id / 512)::BIGINT % 2 = 0 THEN value END AS value FROM events""",
    "stream_payload_landing": """
        SELECT event_id, ts AS time, user_id, event_type, value FROM events""",
    "io_collection_append": """
        SELECT o_orderkey, CAST(2 AS BIGINT) AS n_copies, CAST(2 AS BIGINT) AS n_ids,
               CAST(2 * (SELECT count(*) FROM orders) AS BIGINT) AS inserted
        FROM orders""",
    "io_collection_widening": """
        SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS price, o_orderstatus, NULL AS o_orderpriority FROM orders
        UNION ALL
        SELECT o_orderkey, o_totalprice, NULL, o_orderpriority FROM orders""",
    "io_collection_layouts": """
        SELECT o_orderdate AS time, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(4 AS BIGINT) AS n_copies, CAST(4 AS BIGINT) AS n_stamps
        FROM orders""",
    "io_collection_unique": """
        SELECT o_orderkey, CAST(1 AS BIGINT) AS n_copies, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 2 END AS batch, o_totalprice,
               (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS first_inserted,
               (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS second_inserted,
               (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) + (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS second_refused
        FROM orders""",
    "io_collection_find_id": """
        SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 77 OR c_name = 'Customer#000000077'""",
    "io_collection_find": """
        SELECT d.doc_id, l.quality, l.toxic, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        WHERE (l.toxic IS NULL OR l.toxic <> 1) AND (l.quality IS NULL OR d.lang IN ('de', 'fr')) AND d.doc_id >= 10""",
    "io_text_roundtrip": """
        SELECT doc_id, '  ' || text || ' "said"; "' || lang || '"  ' AS text, source FROM documents""",
    "io_collection_scan": """
        SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'
        ORDER BY c_acctbal DESC, c_custkey LIMIT 100""",
    "io_collection_partitioned_scan": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""",
    "io_ragged_union": """
        SELECT * FROM customer UNION ALL BY NAME SELECT * RENAME (o_custkey AS c_custkey) FROM orders""",
    "io_decimal_comma_roundtrip": """
        SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * CAST('1e9' AS DOUBLE) AS large,
               l_extendedprice * CAST('1e-40' AS DOUBLE) AS small FROM lineitem""",
    "io_result_export": f"""
        WITH {SCORED}, {METRICS}, {SUMMARY}
        SELECT pollutant, {SUMMARY_COLS}, n_regions FROM summary""",
    "io_doc_dump_decode": """
        SELECT event_id, ts, user_id, event_type, value FROM events""",
    "io_mixed_documents": f"""
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'object' END AS kind,
               CASE WHEN event_id % 4 = 0 THEN {r('value', 6)} END AS number, CASE WHEN event_id % 4 = 1 THEN event_type END AS text,
               CASE WHEN event_id % 4 = 2 THEN user_id END AS of FROM events""",
    "reshape_pivot_many": """
        WITH names AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS col FROM (SELECT DISTINCT o_custkey FROM orders)),
        cells AS (SELECT o_orderpriority, col, o_custkey, max(o_totalprice) AS price FROM orders JOIN names USING (o_custkey) GROUP BY ALL)
        SELECT o_orderpriority, CAST(col // 4096 AS BIGINT) AS block, count(*) AS n_cells, arg_min(o_custkey, col) AS first_customer,
               arg_max(o_custkey, col) AS last_customer, arg_min(price, col) AS first_price, arg_max(price, col) AS last_price, max(price) AS highest
        FROM cells GROUP BY 1, 2""",
    "ml_quota_split": """
        WITH g AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE o_orderpriority || '-' || (o_custkey % 97) END AS "group" FROM orders)
        SELECT "group", count(*) AS n, count(*) AS n_orders,
               CAST(count(*) - CASE WHEN count(*) > 1 THEN greatest(round(count(*) * CAST(0.2 AS DOUBLE)), 1) ELSE round(count(*) * CAST(0.2 AS DOUBLE)) END AS BIGINT) AS n_train
        FROM g GROUP BY 1""",
    "sort_positions": f"""
        WITH {SCORED}
        SELECT *, row_number() OVER (ORDER BY region, pollutant, period, actual, predicted) AS position FROM scored""",
    "agg_group_quantiles": f"""
        SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE l_returnflag || '-' || l_linestatus END AS line_group, count(*) AS n,
               {r('quantile_cont(l_extendedprice, 0.25)', 4)} AS p25, {r('quantile_cont(l_extendedprice, 0.5)', 4)} AS p50,
               {r('quantile_cont(l_extendedprice, 0.75)', 4)} AS p75
        FROM lineitem GROUP BY 1""",
    "schema_trim_names": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
    "schema_safe_names": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
    "schema_drop_unnamed": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
    "profile_shape": """
        SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols FROM customer""",
    "preview_first_n": """
        SELECT * FROM customer ORDER BY c_custkey LIMIT 20""",
    "scalar_locale_number": f"""
        WITH {ORDERS_TEXT}
        SELECT o_orderkey, {r(f"TRY_CAST(replace(replace({CLEANED}, '.', ''), ',', '.') AS DOUBLE)", 2)} AS value
        FROM orders_text""",
    "scalar_null_markers": f"""
        WITH {ORDERS_TEXT}
        SELECT o_orderkey, {CLEANED} AS cleaned FROM orders_text""",
    "scalar_separator_swap": f"""
        WITH {ORDERS_TEXT}
        SELECT o_orderkey, replace(replace(trim(raw), '.', ''), ',', '.') AS swapped FROM orders_text""",
    "scalar_try_cast": f"""
        WITH {ORDERS_TEXT}
        SELECT o_orderkey, {r("TRY_CAST(replace(replace(trim(raw), '.', ''), ',', '.') AS DOUBLE)", 2)} AS value
        FROM orders_text""",
    "scalar_trim": f"""
        WITH {ORDERS_TEXT}
        SELECT o_orderkey, trim(raw) AS trimmed FROM orders_text""",
    "scalar_year_cast": """
        SELECT o_orderkey, CAST(' ' || CAST(year(o_orderdate) AS VARCHAR) || ' ' AS INTEGER) AS year
        FROM orders""",
    "scalar_recode_map": f"""
        WITH {CUSTOMER_REGIONS}
        SELECT c_custkey, COALESCE({RECODE}, r_name) AS region FROM cr""",
    "join_recode_table": f"""
        WITH {CUSTOMER_REGIONS}
        SELECT c_custkey, COALESCE(m.dst, cr.r_name) AS region
        FROM cr LEFT JOIN (VALUES ('EUROPE', 'EU'), ('AMERICA', 'AM'), ('ASIA', 'AS')) AS m(src, dst)
          ON cr.r_name = m.src""",
    "scalar_format_decimal_comma": """
        SELECT l_orderkey, l_linenumber, replace(CAST(l_discount AS VARCHAR), '.', ',') AS discount_text,
               replace(CAST(l_tax AS VARCHAR), '.', ',') AS tax_text
        FROM lineitem""",
    "filter_trimmed_eq": """
        SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "filter_eq": """
        SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "null_fill": """
        SELECT d.doc_id, COALESCE(l.quality, 0) AS quality, COALESCE(l.toxic, 0) AS toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "null_drop_subset": """
        SELECT d.doc_id, l.quality, l.toxic
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
    "reshape_unpivot_years": f"""
        WITH {EXPOSURE_LONG},
        grid AS (SELECT region, unnest((SELECT list(DISTINCT period) FROM exposure_long)) AS period
                 FROM (SELECT DISTINCT region FROM exposure_long))
        SELECT g.region, g.period,
               CASE WHEN g.period % 11 = 0 THEN NULL ELSE {r('e.exposure', 2)} END AS exposure
        FROM grid g LEFT JOIN exposure_long e ON g.region = e.region AND g.period = e.period""",
    "reshape_pivot_categories": f"""
        WITH {MEASURE}, {PIVOT}
        SELECT region, period, """ + ", ".join(f"{r(chr(34) + n + chr(34), 4)} AS \"{n}\"" for _, n in PRIORITY_COLS)
        + " FROM piv",
    "panel_left_join": f"""
        WITH {MEASURE}, {EXPOSURE_LONG}, {TRAFFIC}, {PIVOT}
        SELECT p.region, p.period, """ + ", ".join(f"{r('p.' + chr(34) + n + chr(34), 4)} AS \"{n}\""
                                                    for _, n in PRIORITY_COLS)
        + f", {r('t.traffic', 2)} AS traffic FROM piv p LEFT JOIN traffic t"
        + " ON p.region = t.region AND p.period = t.period",
    "join_common_regions_semi": """
        SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE n_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "set_intersect_regions": """
        SELECT n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
        INTERSECT
        SELECT n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "agg_mean_traffic": f"""
        SELECT r_name AS region, CAST(year(l_shipdate) AS BIGINT) AS year,
               {r('avg(l_extendedprice)', 4)} AS traffic_avg
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2""",
    "agg_mean_measure": f"""
        WITH {MEASURE}
        SELECT region, period, category, {r('avg(value)', 4)} AS value_avg FROM measure GROUP BY 1, 2, 3""",
    "agg_distinct_regions": f"""
        WITH {MEASURE}
        SELECT DISTINCT region FROM measure""",
    "agg_min_sample_gate": f"""
        WITH {MEASURE}, {EXPOSURE_LONG}, {TRAFFIC}, {PANEL_LONG}
        SELECT region, pollutant, count(*) AS n_rows, count(*) >= 10 AS eligible
        FROM panel_long GROUP BY region, pollutant""",
    "panel_features": f"""
        WITH {MEASURE}, {EXPOSURE_LONG}, {TRAFFIC}, {PANEL_LONG}
        SELECT region, pollutant, period, {r('label', 4)} AS label, {r('traffic', 2)} AS traffic, year_feature
        FROM panel_long""",
    "ml_hash_split": f"""
        WITH {MEASURE}, {EXPOSURE_LONG}, {TRAFFIC}, {PANEL_LONG}
        SELECT region, pollutant, period,
               ('0x' || substr(md5(region || '|' || pollutant || '|' || CAST(period AS VARCHAR)), 1, 8))::BIGINT
                 % 100 < 80 AS is_train
        FROM panel_long""",
    "ml_group_forest": f"""
        WITH {MEASURE}, {EXPOSURE_LONG}, {TRAFFIC}, {PANEL_LONG}, {SPLIT}
        SELECT region, pollutant, count(*) FILTER (WHERE is_train) AS n_train,
               count(*) FILTER (WHERE NOT is_train) AS n_test, true AS metrics_hold
        FROM split GROUP BY region, pollutant HAVING count(*) >= 10""",
    "ml_predictions_long": f"""
        WITH {MEASURE}, {EXPOSURE_LONG}, {TRAFFIC}, {PANEL_LONG}, {SPLIT},
        fitted AS (SELECT region, pollutant FROM split GROUP BY region, pollutant
                   HAVING count(*) >= 10 AND count(*) FILTER (WHERE is_train) > 0)
        SELECT s.region, s.pollutant, s.period, {r('s.label', 4)} AS actual, true AS within_labels
        FROM split s JOIN fitted f ON s.region = f.region AND s.pollutant = f.pollutant WHERE NOT s.is_train""",
    "ml_eval_metrics": f"""
        WITH {SCORED}, {METRICS}
        SELECT region, pollutant, n, {r('rmse', 4)} AS rmse, {r('r2', 4)} AS r2 FROM metrics""",
    "report_metrics_by_region": f"""
        WITH {SCORED}, {METRICS}
        SELECT region, pollutant, n, {r('rmse', 4)} AS rmse, {r('r2', 4)} AS r2,
               CAST(row_number() OVER (PARTITION BY region ORDER BY pollutant) AS INTEGER) AS position
        FROM metrics ORDER BY region, pollutant""",
    "sort_metrics": f"""
        WITH {SCORED}, {METRICS}
        SELECT region, pollutant, n, {r('rmse', 4)} AS rmse, {r('r2', 4)} AS r2 FROM metrics
        ORDER BY region, pollutant""",
    "sort_predictions": f"""
        WITH {SCORED}
        SELECT * FROM scored ORDER BY region, pollutant, period""",
    "report_metric_summary": f"""
        WITH {SCORED}, {METRICS}, {SUMMARY}
        SELECT pollutant, {SUMMARY_COLS}, n_regions FROM summary ORDER BY pollutant""",
    "report_error_bars": f"""
        WITH {SCORED}, {METRICS}, {SUMMARY}
        SELECT pollutant, {SUMMARY_COLS}, n_regions,
               {r('r2_mean - r2_std', 4)} AS r2_lo, {r('r2_mean + r2_std', 4)} AS r2_hi,
               {r('rmse_mean - rmse_std', 4)} AS rmse_lo, {r('rmse_mean + rmse_std', 4)} AS rmse_hi
        FROM summary ORDER BY pollutant""",
    "report_metric_matrix": f"""
        WITH {SCORED}, {METRICS}
        SELECT region, """ + ", ".join(
        f"{r(f'max(r2) FILTER (WHERE pollutant = {chr(39)}{p}{chr(39)})', 4)} AS {p.replace('-', '_')}"
        for p in ("A-F", "A-O", "N-F", "N-O", "R-F", "R-O")) + """
        FROM metrics GROUP BY region ORDER BY region""",
    "report_scatter_bounds": f"""
        WITH {SCORED}
        SELECT region, pollutant, least(min(actual), min(predicted)) AS lo,
               greatest(max(actual), max(predicted)) AS hi, count(*) AS n_points
        FROM scored GROUP BY region, pollutant""",
    "topk_per_group": f"""
        WITH {SCORED}, {METRICS},
        ranked AS (SELECT pollutant, region, r2, rmse,
                          row_number() OVER (PARTITION BY pollutant
                                             ORDER BY isnan(r2), r2 DESC NULLS LAST, region) AS rank
                   FROM metrics)
        SELECT pollutant, CAST(rank AS BIGINT) AS rank, region, {r('r2', 4)} AS r2, {r('rmse', 4)} AS rmse
        FROM ranked WHERE rank <= 5""",
    "profile_describe": " UNION ALL ".join(f"""
        SELECT '{v}' AS variable, count({v}) AS count, {r(f'avg({v})', 4)} AS mean,
               {r(f'stddev_samp({v})', 4)} AS std, {r(f'min({v})', 4)} AS min,
               {r(f'quantile_cont({v}, 0.25)', 4)} AS p25, {r(f'quantile_cont({v}, 0.5)', 4)} AS p50,
               {r(f'quantile_cont({v}, 0.75)', 4)} AS p75, {r(f'max({v})', 4)} AS max
        FROM {source}""" for v, source in (
            ("value", "events"), ("user_id", "events"),
            ("gaps", "(SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS gaps FROM events)"))),
}
