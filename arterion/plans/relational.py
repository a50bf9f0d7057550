"""Relational queries over stored measurements.

customer = users, orders = measurements, lineitem by ship date = vital rows.
"""

from __future__ import annotations

from arterion.plans.dialect import both

_LATEST = """(SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem)"""

QUERIES, ORACLES = both({
    # Each measurement with its latest vital row, or none.
    "latest_row_lateral": f"""SELECT o_orderkey, o_orderstatus, v.l_linenumber, v.l_extendedprice AS heart_rate FROM orders
 LEFT JOIN {_LATEST} v ON o_orderkey = v.l_orderkey AND v.rn = 1""",
    # J02
    "measurement_sessions": "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'",
    # J03
    "ownership_semi": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
    # J04
    "history": f"""SELECT o_orderkey, c_custkey, c_name, o_orderdate, v.l_extendedprice AS heart_rate FROM orders JOIN customer ON o_custkey = c_custkey
 LEFT JOIN {_LATEST} v ON o_orderkey = v.l_orderkey AND v.rn = 1 WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey""",
    # Sessions that are live at a given moment
    "live_sessions": """SELECT c_custkey, count(*) AS live FROM customer JOIN orders ON c_custkey = o_custkey
 WHERE o_orderdate + INTERVAL 7 DAYS > timestamp '1998-01-01 00:00:00' AND o_orderstatus <> 'P' GROUP BY c_custkey""",
    # Knowledge rows by code; what no fact uses
    "knowledge_lookup": "SELECT p_brand, count(*) AS uses, min(p_type) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "coverage_anti": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
    # Thresholds by code
    "threshold_lookup": """SELECT o_orderpriority AS code, count(*) AS n, LONG(sum(CASE WHEN o_totalprice BETWEEN lo AND hi THEN 1 ELSE 0 END)) AS inside FROM orders
 JOIN (SELECT '1-URGENT' AS code, 1000.0 AS lo, 200000.0 AS hi UNION ALL SELECT '2-HIGH', 5000.0, 150000.0 UNION ALL SELECT '5-LOW', 0.0, 90000.0) t ON o_orderpriority = t.code GROUP BY o_orderpriority""",
    # Of each test fold, the subjects that its training side, all other folds, has too
    "leakage_intersect": """SELECT fold, count(*) AS subjects, LONG(sum(CASE WHEN folds > 1 THEN 1 ELSE 0 END)) AS leaks FROM (SELECT DISTINCT o_custkey, o_orderkey % 5 AS fold FROM orders) f
 JOIN (SELECT o_custkey AS k, count(DISTINCT o_orderkey % 5) AS folds FROM orders GROUP BY o_custkey) s ON o_custkey = k GROUP BY fold""",
    # U04, U06
    "required_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "records_union": """SELECT method, count(*) AS n, sum(x) AS total FROM (SELECT 'POS' AS method, l_quantity AS x FROM lineitem WHERE l_returnflag = 'A'
 UNION ALL SELECT 'CHROM', l_quantity FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT 'GREEN', l_quantity FROM lineitem WHERE l_returnflag = 'R') u GROUP BY method""",
    # D05, D06
    "completed_coalesce": """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 DAYS END, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 DAYS END, o_orderdate) AS moment,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at FROM orders""",
    # P10, P11, P09, G11
    "quality_labels": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, HALF_EVEN((1 - l_discount * 8) * 100, 0) AS score,
 CASE WHEN l_returnflag = 'R' THEN 'REJECTED' WHEN 1 - l_discount * 8 >= 0.7 THEN 'GOOD' WHEN 1 - l_discount * 8 >= 0.4 THEN 'FAIR' ELSE 'POOR' END AS label,
 CASE WHEN (1 - l_discount * 8) * 100 >= 80 THEN 'GOOD' ELSE 'LOW' END AS route_label, concat('hr=', l_returnflag, ';rr=', l_linestatus) AS algorithm FROM lineitem""",
    # Trend payload of at least two accepted values
    "trend_first_last": """SELECT o_custkey, count(*) AS n, min_by(o_totalprice, o_orderkey) AS first_value, max_by(o_totalprice, o_orderkey) AS last_value, round(avg(o_totalprice), 6) AS mean,
 min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) >= 2""",
    # Latest version by its numbers
    "latest_version": """SELECT s_nationkey, s_name FROM (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 7 DESC, s_suppkey % 5 DESC, s_suppkey DESC) AS rn FROM supplier) x WHERE rn = 1""",
    # T05
    "ordered_listing": "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_name",
    # Seed rows that are not there yet; current state of append-only events
    "seed_upsert": "SELECT r_regionkey + 100 AS id, r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = r_name)",
    "current_state": "SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS version FROM events GROUP BY user_id",
    # F03, F04, F05
    "identity_checks": """SELECT c_custkey, MATCHES(lower(concat('u', TEXT(c_custkey), '@', c_mktsegment, '.example')), '^[^@ ]+@[^@ ]+[.][a-z]+$') AS email_ok,
 SHA(c_name) AS token, substr(SHA(concat(c_name, '|', c_mktsegment)), 1, 16) AS config_hash, MATCHES(concat(TEXT(c_custkey), '.0.1'), '^[0-9]+[.][0-9]+[.][0-9]+$') AS semver_ok FROM customer""",
    # M08, M09
    "bmi_and_pressure": """SELECT p_partkey, round(p_retailprice / 20 / nullif((p_size / DBL(30)) * (p_size / DBL(30)), 0), 6) AS bmi,
 CASE WHEN p_retailprice / 10 >= 140 OR p_size >= 45 THEN 'HIGH' WHEN p_retailprice / 10 >= 120 OR p_size >= 40 THEN 'ELEVATED' ELSE 'NORMAL' END AS category FROM part""",
    # Range findings
    "range_findings": """SELECT event_type, LONG(sum(CASE WHEN value < 60 THEN 1 ELSE 0 END)) AS low, LONG(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)) AS high, LONG(sum(CASE WHEN value BETWEEN 60 AND 100 THEN 1 ELSE 0 END)) AS normal FROM events GROUP BY event_type""",
})
