"""The same queries in SQL (DuckDB), over the same tables. Each is written on its own, not derived from the Spark code."""

from __future__ import annotations

import re

DATASETS = {
    "repairs": """SELECT *, CAST(coalesce(try_strptime(GSTRS, '%Y-%m-%d'), try_strptime(GSTRS, '%Y%m%d')) AS DATE) AS gstrs_date FROM (SELECT CAST(event_id AS VARCHAR) AS repair_id, event_id, 'P' || user_id AS PCODE, CASE WHEN value > 20 THEN event_type ELSE '' END AS ERROR_CODE,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'fault ' || event_type END AS ERROR_MSG, strftime(ts, '%Y%m%d') AS ZDATE_WX, strftime(ts, '%H%M%S') AS ZTIME,
        CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y%m%d') END AS GSTRS,
        CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN NULL ELSE lpad(CAST(event_id % 16000 AS VARCHAR), 12, '0') END AS AUFNR,
        CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(event_id % 1500 AS VARCHAR) ELSE lpad(CAST(event_id % 1500 AS VARCHAR), 10, '0') END AS VBELN,
        'M' || json_extract_string(props, '$.k') AS MATNR, CASE WHEN event_id % 4 = 0 THEN 'S' || user_id ELSE '' END AS RECORD01REPAIRM, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'U' || (event_id % 17) END AS U_FIX,
        event_type AS ZNGGZ, 'C' || (event_id % 400) AS ZMCOD1, ts AS synced_at FROM events)""",
    "ords": """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'SG' ELSE 'KK' END || ':' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'SG' ELSE 'KK' END AS source,
        lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS AUFNR, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS VBELN,
        CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y%m%d') END AS GSTRS, 'K' || (o_custkey % 300) AS KID, 'L' || (o_orderkey % 7) AS LGORT, o_orderstatus AS ZSTAT,
        CAST(o_orderkey % 50 AS DOUBLE) AS order_quantity, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 50 AS DOUBLE) END AS storage_quantity, o_orderdate AS last_synced_at, o_orderkey % 3 = 0 AS is_overseas, CAST(o_orderdate AS DATE) AS gstrs_date FROM orders""",
    "lines": """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'SG' ELSE 'KK' END AS source, CASE WHEN l_orderkey % 23 = 0 THEN '' ELSE lpad(CAST(l_orderkey AS VARCHAR), 12, '0') END AS AUFNR,
        concat_ws('-', lpad(CAST(l_linenumber AS VARCHAR), 3, '0'), lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), strftime(l_shipdate, '%Y%m%d'), lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0')) AS pos,
        CASE WHEN l_linenumber = 7 THEN 0.0 WHEN l_linenumber = 6 THEN 1000 + l_quantity ELSE l_quantity END AS gamng, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS wmeng,
        CASE WHEN l_partkey % 10 = 0 THEN 'Model-WW-' || l_partkey ELSE 'Model-' || l_partkey END AS MAKTX, strftime(l_shipdate, '%Y-%m-%d') AS GSTRS, l_returnflag AS ZSTAT FROM lineitem""",
    "stations": """SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS HISTROYID, event_id, event_type AS SPEC, strftime(ts, '%Y-%m-%d %H:%M:%S') AS SPEC_TIME, 'P' || user_id AS PCODE,
        CASE WHEN event_id % 9 = 0 THEN '  ' ELSE lpad(CAST(event_id % 16000 AS VARCHAR), 12, '0') END AS AUFNR, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'X' || (event_id % 1500) ELSE lpad(CAST(event_id % 1500 AS VARCHAR), 10, '0') END AS KDAUF,
        strftime(ts, '%Y%m%d') AS GSTRS, 'LINE' || (event_id % 5) AS LINE_CODE, 'T' || (event_id % 6) AS MAKTX_TH, ts AS synced_at, CAST(ts AS DATE) AS gstrs_date FROM events""",
    "postings": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS posting_id, CASE WHEN l_partkey % 12 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS AUFNR_1,
        CASE WHEN l_suppkey % 8 = 0 THEN '' WHEN l_suppkey % 9 = 0 THEN '  ' ELSE lpad(CAST(l_suppkey AS VARCHAR), 10, '0') END AS VBELN_EX, CASE WHEN l_returnflag = 'A' THEN 'ZP01' ELSE 'ZP02' END AS AUART,
        CASE WHEN l_suppkey % 3 = 0 THEN ' 5000' WHEN l_suppkey % 3 = 1 THEN '' ELSE '8301' END AS CPX, l_shipdate AS synced_at FROM lineitem""",
    "bound": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS binding_id, CASE WHEN l_partkey % 31 = 0 THEN '' ELSE 'H' || l_partkey END AS ZCODE_HEAD, 'I' || l_suppkey AS ZCODE_ITEM,
        CAST(l_partkey % 50 AS VARCHAR) AS AUFNR_HEAD, CAST(l_suppkey % 50 AS VARCHAR) AS AUFNR_ITEM, CASE WHEN l_linestatus = 'F' THEN 'new' ELSE 'old' END AS run FROM lineitem""",
    "doa": """SELECT 'D' || o_orderkey AS doa_code, o_orderkey, o_orderpriority AS doa_type, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS doa_judge, o_orderkey % 6 IN (0, 1) AS is_company, o_custkey,
        lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS sales_order, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS declare_time, CAST(o_orderdate AS DATE) AS declare_date FROM orders""",
    "proof": """SELECT CASE WHEN l_orderkey IS NULL THEN 'unidentified:D' || o_orderkey || ':0' WHEN l_partkey % 5 = 0 THEN 'context:X' || l_suppkey ELSE 'product:P' || (l_partkey % 700) END AS device, 'D' || o_orderkey AS doa_code, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS sales_order, 'M' || l_partkey AS material_sn,
        CASE WHEN l_linenumber = 5 THEN 'bad' WHEN l_linenumber = 4 OR l_orderkey IS NULL THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
    "snap": """SELECT order_id, VBELN, KID FROM ords WHERE order_id NOT LIKE '%3'""",
    "kept": """SELECT order_id, VBELN, CASE WHEN order_id LIKE '%5' THEN 'K-old' ELSE KID END AS KID FROM ords WHERE order_id NOT LIKE '%4'""",
    "classes": """SELECT coalesce(s.order_id, k.order_id) AS order_id, CASE WHEN k.order_id IS NULL THEN 'insert' WHEN s.order_id IS NULL THEN 'stale' WHEN s.VBELN = k.VBELN AND s.KID = k.KID THEN 'unchanged' ELSE 'update' END AS action FROM snap s FULL JOIN kept k ON s.order_id = k.order_id""",
    "ordmap": """SELECT nz(VBELN) AS key, CASE WHEN count(DISTINCT AUFNR) = 1 THEN min(AUFNR) END AS value, count(DISTINCT AUFNR) AS n FROM ords WHERE VBELN != '' GROUP BY 1""",
    "prodmap": """SELECT nz(AUFNR) AS key, CASE WHEN count(DISTINCT nullif(VBELN, '')) = 1 THEN min(nullif(VBELN, '')) END AS value, count(DISTINCT nullif(VBELN, '')) AS n FROM ords WHERE VBELN != '' GROUP BY 1""",
    "filled": """SELECT HISTROYID, s.AUFNR AS a, s.KDAUF AS k, pm.value AS sales_found, om.value AS production_found, CASE WHEN s.KDAUF != '' AND om.key IS NULL THEN 'delete' WHEN s.KDAUF = '' AND pm.value IS NOT NULL THEN 'fill_sales' WHEN s.KDAUF = '' AND pm.n > 1 THEN 'ambiguous'
        WHEN s.KDAUF != '' AND trim(s.AUFNR) = '' AND om.value IS NOT NULL THEN 'fill_production' WHEN s.KDAUF != '' AND trim(s.AUFNR) = '' AND om.n > 1 THEN 'ambiguous' WHEN s.KDAUF = '' OR trim(s.AUFNR) = '' THEN 'unresolved' ELSE 'keep' END AS action
        FROM stations s LEFT JOIN prodmap pm ON trim(s.AUFNR) != '' AND nz(s.AUFNR) = pm.key LEFT JOIN ordmap om ON s.KDAUF != '' AND nz(s.KDAUF) = om.key""",
    "day1": """SELECT nz(AUFNR) AS key, CASE WHEN count(DISTINCT gstrs_date) = 1 THEN min(gstrs_date) END AS value, count(DISTINCT gstrs_date) AS n FROM ords WHERE ZSTAT = 'F' GROUP BY 1""",
    "day2": """SELECT nz(VBELN) AS key, CASE WHEN count(DISTINCT gstrs_date) = 1 THEN min(gstrs_date) END AS value, count(DISTINCT gstrs_date) AS n FROM ords WHERE ZSTAT = 'F' AND VBELN != '' GROUP BY 1""",
    "pair_a": """SELECT PCODE AS key, min({'p': trim(AUFNR), 's': trim(KDAUF)}) AS pair FROM stations WHERE trim(AUFNR) != '' AND KDAUF != '' GROUP BY 1 HAVING count(DISTINCT trim(AUFNR) || '|' || KDAUF) = 1""",
    "pair_b": """SELECT PCODE AS key, min({'p': AUFNR, 's': VBELN}) AS pair FROM repairs WHERE coalesce(AUFNR, '') != '' AND coalesce(VBELN, '') != '' GROUP BY 1 HAVING count(DISTINCT AUFNR || '|' || VBELN) = 1""",
    "stepped": """SELECT repair_id, coalesce(AUFNR, '') AS a, coalesce(VBELN, '') AS b, GSTRS AS g, CASE WHEN (a = '' OR b = '') AND pa.key IS NOT NULL AND (a = '' OR nz(a) = nz(pa.pair.p)) THEN 'stations' WHEN (a = '' OR b = '') AND pb.key IS NOT NULL AND (a = '' OR nz(a) = nz(pb.pair.p)) THEN 'repairs' ELSE '' END AS step, pa.pair AS x, pb.pair AS y FROM repairs r LEFT JOIN pair_a pa ON r.PCODE = pa.key LEFT JOIN pair_b pb ON r.PCODE = pb.key""",
    "chained": """SELECT repair_id, step, g, CASE WHEN a != '' THEN a WHEN step = 'stations' THEN x.p WHEN step = 'repairs' THEN y.p ELSE '' END AS a, CASE WHEN b != '' THEN b WHEN step = 'stations' THEN x.s WHEN step = 'repairs' THEN y.s ELSE '' END AS b FROM stepped""",
    "odocs": """SELECT o_orderkey AS k, 'SG:' || o_orderkey AS order_id, CASE WHEN o_orderkey % 19 != 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS vbeln, 'K' || (o_custkey % 300) AS kid, o_orderpriority AS model, 'L' || (o_orderkey % 7) AS lgort, strftime(o_orderdate, '%Y%m%d') AS gstrs,
        CASE WHEN o_orderkey % 7 = 0 THEN '' END AS d_shipped, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN 'soon' END AS d_wadat, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d') END AS t_shipped,
        CASE WHEN o_orderkey % 5 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS wadat_day, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate + INTERVAL 20 DAY AS DATE) END AS shipped_day FROM orders""",
    "versions": """SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 17 != 0 THEN user_id || '/' || event_type END AS i, strftime(ts, '%Y%m%d%H%M%S') AS synced, ts >= TIMESTAMP '2024-01-05' AS covered, CAST(event_id % 3 AS VARCHAR) AS digest FROM events""",
    "fresh": """SELECT i, arg_max(digest, event_id) AS digest FROM versions WHERE event_id % 5 = 0 AND i IS NOT NULL GROUP BY 1""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY i ORDER BY event_id % 2 = 0 DESC, synced DESC, id DESC) AS nth FROM versions WHERE event_id % 3 != 1""",
    "named": """SELECT i, string_agg(n, ',' ORDER BY n) AS aliases FROM (SELECT i, id AS n FROM ranked WHERE i IS NOT NULL UNION SELECT i, 'old-' || event_id FROM ranked WHERE i IS NOT NULL AND event_id % 4 = 0) GROUP BY 1""",
    "reconciled": """SELECT coalesce(f.i, b.i) AS i, b.id, CASE WHEN b.id IS NULL THEN 'insert' WHEN b.digest != f.digest THEN 'update' ELSE 'unchanged' END AS action, b.id IS NOT NULL AND b.event_id % 2 != 0 AS relinked, coalesce(n.aliases, '') AS aliases, true AS covered
        FROM fresh f LEFT JOIN (SELECT * FROM ranked WHERE nth = 1 AND i IS NOT NULL) b ON f.i = b.i LEFT JOIN named n ON f.i = n.i
        UNION ALL SELECT i, id, 'superseded', false, '', true FROM ranked WHERE nth > 1 AND i IN (SELECT i FROM fresh)
        UNION ALL SELECT i, id, CASE WHEN covered THEN 'stale' ELSE 'outside' END, false, CASE WHEN event_id % 4 = 0 THEN 'old-' || event_id ELSE '' END, covered FROM ranked WHERE i IS NULL OR i NOT IN (SELECT i FROM fresh)""",
    "piece": """SELECT CASE WHEN l_partkey % 5 = 0 THEN 'context:X' || l_suppkey ELSE 'product:P' || (l_partkey % 700) END AS device, 'D' || o_orderkey AS doa_code, 'X' || l_suppkey AS context, o_orderkey % 6 IN (0, 1) AS is_company, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS doa_so, CASE WHEN l_partkey % 4 != 0 THEN lpad(CAST(l_suppkey AS VARCHAR), 10, '0') END AS so,
        lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS po, CASE WHEN l_partkey % 5 != 0 THEN 'P' || (l_partkey % 700) END AS barcode, 'M' || l_partkey AS material_sn, CASE WHEN l_partkey % 3 != 0 THEN 'MD' || (l_partkey % 1400 // 700) END AS model,
        CASE WHEN l_linenumber = 5 THEN '2026-02-30' WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 3 THEN strftime(l_shipdate, '%Y%m%d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS fp, CASE WHEN l_linenumber NOT IN (4, 5) THEN strftime(l_shipdate, '%Y-%m-%d') END AS fday,
        CASE WHEN l_linenumber = 6 THEN 'soon' END AS we, CASE WHEN l_partkey % 700 % 3 = 1 THEN '2027-03-01' WHEN l_partkey % 700 % 3 = 2 AND l_linenumber < 3 THEN '2027-03-01' WHEN l_partkey % 700 % 3 = 2 THEN '2027-04-01' END AS wday FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "said": """SELECT device, any_value(sales) AS sales, any_value(production) AS production, any_value(model) AS models, any_value(factory) AS factory, any_value(fbad) AS fbad, any_value(warranty) AS warranty, any_value(wbad) AS wbad FROM (SELECT device, list_sort(list(DISTINCT so) FILTER (so IS NOT NULL)) AS sales, list_sort(list(DISTINCT po)) AS production, list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)) AS model,
        list_sort(list(DISTINCT fday) FILTER (fday IS NOT NULL)) AS factory, list_sort(list(DISTINCT fp) FILTER (fp = '2026-02-30')) AS fbad, list_sort(list(DISTINCT wday) FILTER (wday IS NOT NULL)) AS warranty, list_sort(list(DISTINCT we) FILTER (we IS NOT NULL)) AS wbad FROM piece GROUP BY device) GROUP BY device""",
    "listed": """SELECT o_orderkey AS page_id, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS nth FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "attempt": """SELECT 'P' || user_id AS key, ts AS tm, value <= 15 AS ok, event_type AS digest, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events""",
    "good": """SELECT *, lag(digest) OVER (PARTITION BY key ORDER BY n) AS was FROM attempt WHERE ok""",
    "goods": """SELECT key, min(tm) AS first_seen, max(tm) FILTER (was IS NULL OR was != digest) AS last_change, arg_max(digest, n) AS digest, max(n) AS last_good FROM good GROUP BY key""",
    "items": """SELECT a.key, coalesce(any_value(g.digest), '') AS digest, any_value(g.first_seen) AS first_seen, any_value(g.last_change) AS last_change, count(*) FILTER (a.n > coalesce(g.last_good, 0)) AS attempts, max(a.tm) AS attempted, count(*) AS seen FROM attempt a LEFT JOIN goods g ON a.key = g.key GROUP BY a.key""",
    "srepairs": """SELECT CAST(event_id AS VARCHAR) AS repair_id, CASE WHEN event_id % 29 != 0 THEN user_id END AS u, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'X' || user_id ELSE '' END ELSE lpad(CAST(user_id AS VARCHAR), 12, '0') END AS p,
        CASE WHEN event_id % 4 != 3 THEN '' WHEN user_id % 6 = 3 THEN 'S' || user_id || (event_id % 3) ELSE 'S' || user_id END AS s, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS g FROM events""",
    "spairs": """SELECT u, min(p) AS p, min(s) AS s FROM (SELECT user_id AS u, lpad(CAST(user_id + CASE WHEN user_id % 6 = 2 THEN event_id % 2 ELSE 0 END AS VARCHAR), 12, '0') AS p, 'S' || user_id AS s FROM events WHERE user_id % 6 NOT IN (3, 4)) GROUP BY 1 HAVING count(DISTINCT p) = 1""",
    "rpairs": """SELECT u, min(p) AS p, min(s) AS s FROM srepairs WHERE u IS NOT NULL AND p != '' AND s != '' GROUP BY 1 HAVING count(DISTINCT p || '|' || s) = 1""",
    "kk": """SELECT u, min(v) AS v FROM (SELECT user_id AS u, '0' || user_id || CASE WHEN user_id % 7 = 3 THEN CAST(event_id % 2 AS VARCHAR) ELSE '' END AS v FROM events WHERE user_id % 7 IN (0, 1, 3)) GROUP BY 1 HAVING count(DISTINCT v) = 1""",
    "sg": """SELECT u, min(v) AS v FROM (SELECT user_id AS u, user_id || CASE WHEN user_id % 7 = 3 THEN CAST(event_id % 2 AS VARCHAR) ELSE '' END AS v FROM events WHERE user_id % 7 IN (1, 2, 3, 4)) GROUP BY 1 HAVING count(DISTINCT v) = 1""",
    "filling": """SELECT repair_id, r.u, r.p, r.s, g, CASE WHEN (r.p = '' OR r.s = '') AND a.u IS NOT NULL AND (r.p = '' OR nz(r.p) = nz(a.p)) THEN 'stations' WHEN (r.p = '' OR r.s = '') AND b.u IS NOT NULL AND (r.p = '' OR nz(r.p) = nz(b.p)) THEN 'repairs' ELSE '' END AS step,
        a.u IS NOT NULL AND r.p != '' AND nz(r.p) != nz(a.p) AS conflict, CASE step WHEN 'stations' THEN a.p WHEN 'repairs' THEN b.p ELSE '' END AS np, CASE step WHEN 'stations' THEN a.s WHEN 'repairs' THEN b.s ELSE '' END AS ns FROM srepairs r LEFT JOIN spairs a ON r.u = a.u LEFT JOIN rpairs b ON r.u = b.u""",
    "backfilled": """SELECT repair_id, p2, CASE WHEN s1 = '' AND o.vb IS NOT NULL THEN o.vb ELSE s1 END AS s2, CASE WHEN g = '' AND o.gd IS NOT NULL THEN o.gd ELSE g END AS g2, order_source, CASE WHEN s1 = '' AND o.vb IS NOT NULL THEN 'board' WHEN s = '' AND step != '' THEN step ELSE '' END AS sales_source,
        CASE WHEN g = '' AND o.gd IS NOT NULL THEN 'board' ELSE '' END AS start_source, conflict FROM (SELECT f.*, CASE WHEN p != '' THEN p WHEN np != '' THEN np ELSE coalesce(kk.v, sg.v, '') END AS p2, CASE WHEN s != '' THEN s ELSE ns END AS s1,
        CASE WHEN p = '' AND step != '' THEN step WHEN p = '' AND kk.u IS NOT NULL THEN 'KK' WHEN p = '' AND sg.u IS NOT NULL THEN 'SG' ELSE '' END AS order_source FROM filling f LEFT JOIN kk ON f.u = kk.u LEFT JOIN sg ON f.u = sg.u) x
        LEFT JOIN (SELECT nz(AUFNR) AS k, nullif(min(VBELN), '') AS vb, strftime(min(gstrs_date), '%Y-%m-%d') AS gd FROM ords GROUP BY 1) o ON x.p2 != '' AND nz(x.p2) = o.k""",
    "passed": """SELECT GSTRS, SPEC, HISTROYID, AUFNR FROM stations WHERE trim(AUFNR) IN (SELECT AUFNR FROM ords WHERE ZSTAT = 'F')""",
    "runs": """SELECT user_id || '-' || strftime(ts, '%Y-%m-%d %H') AS run_id, strftime(ts, '%Y-%m-%d %H') AS started, user_id, event_id, event_type AS task, CASE WHEN value > 12 THEN 'failed' ELSE 'success' END AS state, ts FROM events""",
}

QUERIES = {
    "repair_stats": "SELECT {stats} FROM repairs WHERE gstrs_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'",
    "repair_stats_on_board": "SELECT {stats} FROM repairs WHERE gstrs_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-10' AND AUFNR != '' AND nz(AUFNR) IN (SELECT nz(AUFNR) FROM ords)",
    "repair_list_page": "SELECT repair_id, PCODE, ERROR_CODE, ZDATE_WX, ZTIME, AUFNR, VBELN FROM repairs WHERE ZNGGZ = 'error' ORDER BY ZDATE_WX DESC, ZTIME DESC, repair_id DESC LIMIT 50 OFFSET 100",
    "repair_total": "SELECT count(*) AS total FROM repairs WHERE ZNGGZ IN ('error', 'click')",
    "repair_keyword_search": "SELECT repair_id, ERROR_MSG FROM repairs WHERE ERROR_MSG ILIKE '%fault err%'",
    "repair_filter_all": "SELECT repair_id, PCODE, VBELN FROM repairs WHERE PCODE IN ('P1', 'P2', 'P3') AND VBELN IN ('3', '0000000003', '000012', '12', '0000000012', '0000000031', '31', '44', '0000000044') AND gstrs_date >= DATE '2024-01-01'",
    "repair_planned_dual_format": "SELECT repair_id, GSTRS FROM repairs WHERE replace(GSTRS, '-', '') >= '20240105'",
    "repair_company_semi": "SELECT repair_id, AUFNR FROM repairs WHERE nz(AUFNR) IN (SELECT nz(AUFNR) FROM ords)",
    "repair_company_anti": "SELECT repair_id, AUFNR FROM repairs r WHERE NOT EXISTS (SELECT 1 FROM ords o WHERE nz(o.AUFNR) = nz(r.AUFNR))",
    "fault_sn_lookup": "SELECT DISTINCT nz(AUFNR) AS order_number, PCODE AS sn FROM repairs WHERE nz(AUFNR) IN ('17', '18', '19', '20', '4000')",
    "fault_rows_by_sn": "SELECT repair_id, PCODE, AUFNR, VBELN, ZNGGZ, ERROR_CODE, ZDATE_WX, GSTRS FROM repairs WHERE PCODE IN ('P1', 'P5', 'P8', 'P13', 'P21') AND gstrs_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'",
    "repair_normalized": "SELECT repair_id, PCODE AS host_barcode, nullif(ERROR_CODE, '') AS fault_code, ERROR_MSG AS fault_text, nz(VBELN) AS sales_order, nz(AUFNR) AS production_order, strftime(synced_at, '%Y-%m-%d %H:%M:%S') AS repaired_at FROM repairs",
    "repair_detail_long": "SELECT repair_id, place, name, label, value FROM (SELECT repair_id, unnest([{'place': 0, 'name': 'AUFNR', 'label': 'production order', 'value': AUFNR}, {'place': 1, 'name': 'PCODE', 'label': 'host barcode', 'value': PCODE}, {'place': 2, 'name': 'ERROR_CODE', 'label': 'ERROR_CODE', 'value': ERROR_CODE}, {'place': 3, 'name': 'ERROR_MSG', 'label': 'ERROR_MSG', 'value': ERROR_MSG}, {'place': 4, 'name': 'MATNR', 'label': 'MATNR', 'value': MATNR}], recursive := true) FROM repairs WHERE repair_id = '17') WHERE value IS NOT NULL",
    "orders_page": "SELECT order_id, VBELN, GSTRS, order_quantity FROM ords WHERE source = 'SG' ORDER BY gstrs_date DESC, last_synced_at DESC, order_id DESC LIMIT 37 OFFSET 37",
    "orders_date_range_dual_format": "SELECT order_id, GSTRS FROM ords WHERE gstrs_date BETWEEN DATE '1996-06-01' AND DATE '1997-03-01'",
    "orders_overseas": "SELECT order_id, KID, LGORT FROM ords WHERE is_overseas AND KID IN ('K1', 'K2', 'K3') AND LGORT IN ('L1', 'L2', 'L3') AND VBELN != ''",
    "order_options_distinct": "SELECT DISTINCT KID FROM ords",
    "order_stats": "SELECT count(*) AS total, count(DISTINCT nullif(nz(VBELN), '')) AS sales_orders, CAST(sum(CASE WHEN source = 'SG' THEN 1 ELSE 0 END) AS BIGINT) AS sg, CAST(sum(CASE WHEN source = 'KK' THEN 1 ELSE 0 END) AS BIGINT) AS kk, sum(order_quantity) AS order_quantity, coalesce(sum(storage_quantity), 0) AS storage_quantity, strftime(min(gstrs_date), '%Y-%m-%d') AS first_day, strftime(max(gstrs_date), '%Y-%m-%d') AS last_day FROM ords WHERE gstrs_date >= DATE '1995-01-01'",
    "order_rollup": "SELECT source, AUFNR, count(*) AS record_count, sum(gamng) AS order_quantity, sum(wmeng) AS storage_quantity, arg_max(MAKTX, pos) AS MAKTX, arg_max(ZSTAT, pos) AS ZSTAT, arg_max(GSTRS, pos) AS gstrs_date, bool_or(MAKTX LIKE '%WW%') AS is_overseas FROM lines WHERE AUFNR != '' GROUP BY 1, 2",
    "order_document_quantity": "SELECT source, AUFNR, CASE WHEN AUFNR LIKE '%5' THEN 1.0::DOUBLE ELSE sum(gamng) END AS quantity, count(*) AS lines FROM lines WHERE AUFNR != '' GROUP BY 1, 2",
    "order_candidates_in": "SELECT order_id, VBELN FROM ords WHERE VBELN IN ('7', '0000000007', '0000000008', '8', '00009', '9', '0000000009', 'abc')",
    "view_station_stats": "SELECT count(*) AS total, count(*) FILTER (trim(KDAUF) = '') AS missing_sales, count(*) FILTER (trim(AUFNR) = '') AS missing_production, strftime(max(gstrs_date), '%Y-%m-%d') AS last_day FROM stations WHERE MAKTX_TH IN ('T1', 'T2', 'T3')",
    "view_station_generic_stats": "SELECT count(*) AS total, strftime(min(gstrs_date), '%Y-%m-%d') AS first_day, strftime(max(gstrs_date), '%Y-%m-%d') AS last_day FROM stations",
    "view_bom_stats": "SELECT count(*) AS total, count(DISTINCT nullif(nz(VBELN_EX), '')) AS sales_orders, count(DISTINCT nullif(nz(AUFNR_1), '')) AS production_orders, count(*) FILTER (trim(VBELN_EX) = '') AS missing_sales, count(*) FILTER (trim(AUFNR_1) = '') AS missing_production, count(DISTINCT CASE WHEN AUFNR_1 = '' THEN coalesce(nullif(VBELN_EX, ''), posting_id) END) AS missing_production_different FROM postings",
    "view_facets": "SELECT 'status' AS facet, status AS value, count(*) AS n FROM doa GROUP BY 2 UNION ALL SELECT 'doa_type', doa_type, count(*) FROM doa GROUP BY 2 UNION ALL SELECT 'doa_judge', doa_judge, count(*) FROM doa GROUP BY 2",
    "view_preview_has_more": "SELECT HISTROYID, SPEC_TIME, true AS has_more FROM stations WHERE LINE_CODE = 'LINE2' ORDER BY SPEC_TIME DESC, HISTROYID DESC LIMIT 25",
    "declarations_bulk": "SELECT doa_code, declare_time, count(*) OVER () AS total FROM doa WHERE doa_judge = 'yes' AND declare_date >= DATE '1998-01-01'",
    "missing_sales_order": "SELECT posting_id, VBELN_EX, AUART FROM postings WHERE AUART = 'ZP01' AND VBELN_EX = ''",
    "bindings_by_order": "SELECT binding_id, AUFNR_HEAD, AUFNR_ITEM FROM bound WHERE (AUFNR_HEAD = '7' OR AUFNR_ITEM = '7') AND ZCODE_ITEM IN ('I57', 'I7')",
    "export_keyed_rows": "SELECT repair_id, PCODE, MATNR FROM repairs WHERE PCODE IN ('P1', 'P5', 'P8', 'P13', 'P21')",
    "export_version": "SELECT 'repairs' AS dataset, count(*) || ':' || strftime(max(synced_at), '%Y-%m-%d %H:%M:%S') AS version FROM repairs",
    "data_status": "SELECT 'repairs' AS dataset, count(*) AS rows, strftime(max(synced_at), '%Y-%m-%d %H:%M:%S') AS latest FROM repairs UNION ALL SELECT 'orders', count(*), strftime(max(last_synced_at), '%Y-%m-%d %H:%M:%S') FROM ords UNION ALL SELECT 'postings', count(*), strftime(max(synced_at), '%Y-%m-%d %H:%M:%S') FROM postings",
    "tsv_rows": "SELECT order_id || chr(9) || VBELN || chr(9) || GSTRS || chr(9) || KID AS line FROM ords",
    "csv_rows_escaped": "SELECT repair_id || ',' || CASE event_id % 5 WHEN 0 THEN '''=' || PCODE WHEN 1 THEN '\"''-' || PCODE || ',x\"' WHEN 2 THEN '\"a\"\"' || PCODE || '\"' ELSE PCODE END AS line FROM repairs",
    "bom_cpx_retention": "SELECT count(*) FILTER (trim(CPX) = '5000') AS kept, count(*) FILTER (trim(CPX) = '') AS empty, count(*) FILTER (trim(CPX) NOT IN ('', '5000')) AS other FROM postings",
    "unique_order_map": "SELECT key AS sales_order, value AS production_order, n AS candidates FROM ordmap",
    "ambiguous_order_map": "SELECT count(*) FILTER (n = 1) AS unique_keys, count(*) FILTER (n > 1) AS ambiguous_keys FROM ordmap",
    "station_fill_orders": "SELECT HISTROYID, action, CASE WHEN action = 'fill_production' THEN production_found ELSE a END AS AUFNR, CASE WHEN action = 'fill_sales' THEN sales_found ELSE k END AS KDAUF FROM filled WHERE action != 'delete'",
    "station_orphan_delete": "SELECT HISTROYID, k AS KDAUF FROM filled WHERE action = 'delete'",
    "station_admitted": "SELECT HISTROYID, AUFNR FROM stations WHERE trim(AUFNR) IN (SELECT AUFNR FROM ords WHERE ZSTAT = 'F')",
    "bom_planned_start": "SELECT posting_id, CAST(coalesce(a.value, b.value) AS VARCHAR) AS planned_start, CASE WHEN a.value IS NOT NULL THEN 'production' WHEN b.value IS NOT NULL THEN 'sales' WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS found FROM postings p LEFT JOIN day1 a ON nz(p.AUFNR_1) = a.key LEFT JOIN day2 b ON nz(p.VBELN_EX) = b.key",
    "repair_backfill_chain": "SELECT repair_id, a AS AUFNR, CASE WHEN b = '' THEN coalesce(m.value, '') ELSE b END AS VBELN, g AS GSTRS, step FROM chained LEFT JOIN prodmap m ON nz(a) = m.key",
    "change_company_flag": "SELECT conv_id || '-' || turn AS change_id, EXISTS (SELECT 1 FROM doa WHERE is_company AND o_custkey = conv_id) AS is_company FROM conversations",
    "doa_prefix_class": "SELECT doa_code, is_company FROM doa",
    "doa_flag_counts": "SELECT count(*) AS total, count(*) FILTER (is_company) AS company, count(*) FILTER (is_company != (doa_judge = 'yes')) AS would_update FROM doa",
    "status_refresh_plan": "SELECT s.source, s.AUFNR, CASE WHEN NOT bool_or(n.st IS NOT NULL) THEN 'not_returned' WHEN NOT bool_and((n.st IS NOT NULL AND n.kinds = 1) OR s.st = 'RELEASED') THEN 'blocked' WHEN bool_or(coalesce(n.kinds = 1 AND n.st != s.st, false)) THEN 'updated' ELSE 'unchanged' END AS outcome FROM (SELECT source, AUFNR, pos, CASE WHEN pos < '003' THEN 'RELEASED' ELSE ZSTAT END AS st FROM lines WHERE AUFNR != '') s LEFT JOIN (SELECT source, AUFNR, pos, min(ZSTAT) AS st, count(DISTINCT ZSTAT) AS kinds FROM lines WHERE AUFNR != '' AND pos >= '002' AND try_cast(AUFNR AS BIGINT) % 5 != 0 GROUP BY 1, 2, 3) n ON s.source = n.source AND s.AUFNR = n.AUFNR AND s.pos = n.pos GROUP BY 1, 2",
    "status_transitions": "SELECT ZSTAT || ' -> DONE' AS change, count(*) AS n FROM lines WHERE pos >= '005' GROUP BY 1",
    "serial_dedup": "SELECT binding_id, ZCODE_HEAD, ZCODE_ITEM, run FROM (SELECT *, row_number() OVER (PARTITION BY ZCODE_HEAD, ZCODE_ITEM, AUFNR_HEAD, AUFNR_ITEM ORDER BY run, binding_id) AS nth FROM bound WHERE ZCODE_HEAD != '') WHERE nth = 1 UNION ALL SELECT binding_id, ZCODE_HEAD, ZCODE_ITEM, run FROM bound WHERE ZCODE_HEAD = ''",
    "snapshot_conflicts": "SELECT CAST(l_orderkey AS VARCHAR) AS order_key, CAST(l_linenumber AS VARCHAR) AS line, count(*) AS copies, count(DISTINCT l_partkey) AS kinds FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "snapshot_classify": "SELECT * FROM classes",
    "source_target_diff": "SELECT order_id, CASE action WHEN 'insert' THEN 'missing' WHEN 'stale' THEN 'extra' ELSE 'field_mismatch' END AS kind, CASE action WHEN 'update' THEN 'KID' ELSE '' END AS fields FROM classes WHERE action != 'unchanged'",
    "cleanup_guard": "SELECT source_rows, stale_rows, stored_rows, stale_rows > 0 AND (source_rows = 0 OR (stale_rows > 100 AND 2 * stale_rows > stored_rows)) AS blocked FROM (SELECT count(*) FILTER (action != 'stale') AS source_rows, count(*) FILTER (action = 'stale') AS stale_rows, count(*) FILTER (action != 'insert') AS stored_rows FROM classes)",
    "upsert_plan": "SELECT c.order_id, coalesce(s.VBELN, k.VBELN) AS VBELN, coalesce(s.KID, k.KID) AS KID, CASE WHEN action = 'insert' THEN '2026-02-01' ELSE '2026-01-01' END AS first_seen, CASE WHEN action IN ('insert', 'update') THEN '2026-02-01' ELSE '2026-01-02' END AS last_synced, CAST(CASE action WHEN 'insert' THEN 1 WHEN 'update' THEN 2 ELSE 1 END AS INTEGER) AS sync_count FROM classes c LEFT JOIN snap s ON c.order_id = s.order_id LEFT JOIN kept k ON c.order_id = k.order_id",
    "enriched_kept": "SELECT repair_id, CASE WHEN coalesce(VBELN, '') = '' AND same THEN 'S-kept' ELSE coalesce(VBELN, '') END AS VBELN, CASE WHEN g = '' AND same THEN '2024-01-01' ELSE g END AS GSTRS FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN '' ELSE GSTRS END AS g, coalesce(AUFNR, '') = '' OR event_id % 3 != 0 AS same FROM repairs)",
    "device_groups": "SELECT device, count(*) AS pieces, count(DISTINCT doa_code) AS documents, count(DISTINCT material_sn) AS materials, min(sales_order) AS first_sales_order FROM proof GROUP BY 1 HAVING bool_or(material_sn LIKE '%7')",
    "device_value_resolution": "SELECT device, CASE WHEN count(DISTINCT nullif(day, 'bad')) > 1 THEN 'conflict' WHEN bool_or(coalesce(day = 'bad', false)) THEN 'invalid' WHEN count(day) = 0 THEN 'missing' ELSE 'valid' END AS factory_status FROM proof GROUP BY 1",
    "device_expansion": "SELECT p.device, p.doa_code, p.material_sn FROM proof p JOIN (SELECT DISTINCT device FROM proof WHERE doa_code IN ('D17', 'D18', 'D4001')) t ON p.device = t.device",
    "incremental_lookback": "SELECT HISTROYID, SPEC_TIME FROM stations WHERE synced_at >= TIMESTAMP '2024-01-06 12:00:00'",
    "next_mark": "SELECT greatest('2024-01-05 00:00:00', strftime(max(synced_at), '%Y-%m-%d %H:%M:%S')) AS mark FROM stations",
    "tuple_cursor_range": "SELECT GSTRS, SPEC, HISTROYID FROM stations WHERE (GSTRS > '20240103' OR (GSTRS = '20240103' AND (SPEC > 'error' OR (SPEC = 'error' AND HISTROYID > '0000000000')))) AND (GSTRS < '20240106' OR (GSTRS = '20240106' AND (SPEC < 'click' OR (SPEC = 'click' AND HISTROYID <= '0000004000'))))",
    "tuple_cursor_next": "SELECT GSTRS, SPEC, HISTROYID FROM stations WHERE trim(AUFNR) IN (SELECT AUFNR FROM ords) ORDER BY GSTRS DESC, SPEC DESC, HISTROYID DESC LIMIT 1",
    "rolling_window_bounds": "SELECT strftime(g, '%Y-%m-%d') AS last, strftime(f, '%Y-%m-%d') AS first, f = date_trunc('month', f) AND g = last_day(f) AS is_month FROM (SELECT DISTINCT gstrs_date AS g, greatest(CAST(date_trunc('month', gstrs_date) - INTERVAL 2 MONTH AS DATE), DATE '1995-06-01') AS f FROM ords)",
    "business_key_hash": """SELECT repair_id, sha256('["' || PCODE || '","' || coalesce(AUFNR, '') || '","' || ZMCOD1 || '"]') AS business_key, sha256(PCODE || chr(31) || coalesce(VBELN, '') || chr(31) || MATNR) AS change_key FROM repairs""",
    "vendor_suffix_lookup": "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS vendor FROM lineitem WHERE l_partkey % 1000 = 77 AND l_suppkey % 10 != 0",
    "runs_last": "SELECT run_id, started, count(*) AS n FROM runs GROUP BY 1, 2 ORDER BY started DESC, run_id DESC LIMIT 15",
    "runs_latest_stage": "SELECT run_id, started, task, state FROM runs WHERE task = 'error' AND state = 'failed' ORDER BY started DESC, run_id DESC, event_id LIMIT 1",
    "runs_last_success": "SELECT t.task, max(r.started) AS last_success FROM (VALUES ('error'), ('click'), ('view'), ('none')) t(task) LEFT JOIN runs r ON r.task = t.task AND r.state = 'success' GROUP BY 1",
    "runs_abandoned": "SELECT run_id FROM runs WHERE user_id % 5 = 0 GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-10 00:00:00'",
    "comparison_report": "SELECT count(*) FILTER (action = 'insert') AS missing, count(*) FILTER (action = 'stale') AS extra, count(*) FILTER (action = 'update') AS field_mismatch, CASE WHEN count(*) FILTER (action != 'unchanged') = 0 THEN 'success' ELSE 'warning' END AS state FROM classes",
    "stale_in_scope": "SELECT order_id, KID FROM kept WHERE KID IN ('K1', 'K2', 'K3', 'K4') AND order_id NOT IN (SELECT order_id FROM snap)",
    "events_in_window": "SELECT HISTROYID, GSTRS FROM stations",
    "postings_version_round_trip": "SELECT posting_id, 'M' || split_part(posting_id, '-', 3) AS MATNR, AUART FROM postings WHERE AUART = 'ZP02'",
    "stream_available_now": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS passes, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "order_normalized": "SELECT order_id, 'SG' AS source, vbeln AS sales_order, kid AS customer, model, lgort AS location, gstrs AS planned_start, nullif(coalesce(d_shipped, d_wadat, t_shipped), '') AS shipped_on, CASE k % 4 WHEN 0 THEN 1250.0::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN 7.0::DOUBLE END AS shipped_quantity, CASE k % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE CASE WHEN k % 2 = 1 THEN true END END AS is_5000_company FROM odocs",
    "orders_shipped_between": "SELECT order_id FROM odocs WHERE wadat_day BETWEEN DATE '1996-01-10' AND DATE '1996-03-20' OR shipped_day BETWEEN DATE '1996-01-10' AND DATE '1996-03-20'",
    "orders_with_shipment": "SELECT order_id FROM odocs WHERE (k % 4 IN (0, 1) OR k % 2 = 0) AND k % 2 = 1",
    "station_model_days": "SELECT HISTROYID, GSTRS FROM stations WHERE MAKTX_TH = 'T2' AND GSTRS BETWEEN '20240102' AND '20240104'",
    "repairs_by_repair_day": "SELECT repair_id, ZDATE_WX FROM repairs WHERE ZDATE_WX BETWEEN '20240104' AND '20240106'",
    "order_option_lists": "SELECT DISTINCT 'KID' AS name, KID AS value FROM ords UNION ALL SELECT DISTINCT 'MAKTX_TH', o_orderpriority FROM orders UNION ALL SELECT DISTINCT 'LGORT', LGORT FROM ords UNION ALL SELECT 'WERKS', 'W1' FROM ords GROUP BY 1",
    "posting_option_lists": "SELECT DISTINCT 'CPX' AS name, trim(CPX) AS value FROM postings WHERE trim(CPX) != '' UNION ALL SELECT DISTINCT 'AUART', AUART FROM postings UNION ALL SELECT DISTINCT 'KUNNR', CAST(l_suppkey AS VARCHAR) FROM lineitem",
    "repair_sales_order_match": "SELECT count(*) FILTER (has) AS matched, count(*) FILTER (NOT has AND own IS NOT NULL) AS unmatched, count(*) FILTER (own IS NULL) AS empty FROM (SELECT nullif(trim(VBELN), '') AS own, coalesce(nullif(trim(VBELN), '') IN (SELECT VBELN FROM ords WHERE VBELN != ''), false) AS has FROM repairs)",
    "repair_times": "SELECT repair_id, CASE WHEN event_id % 6 = 0 THEN strftime(synced_at, '%Y-%m-%d') || ' 01:02:03' WHEN event_id % 5 != 0 AND event_id % 4 != 0 THEN strftime(synced_at, '%Y-%m-%d %H:%M:%S') WHEN event_id % 10 != 0 AND event_id % 4 != 0 THEN '2023-12-31 ' || strftime(synced_at, '%H:%M:%S') WHEN event_id % 5 != 0 THEN strftime(synced_at, '%Y-%m-%d') || ' 00:00:00' WHEN event_id % 10 != 0 THEN '2023-12-31 00:00:00' ELSE strftime(synced_at, '%Y-%m-%d %H:%M:%S') END AS repaired_at FROM repairs",
    "utc_times": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 02:20:30' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:00' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS utc FROM orders",
    "three_months_before": "SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 HOUR - INTERVAL 3 MONTH, '%Y-%m-%d %H:%M:%S') AS since FROM orders",
    "equal_rows": "SELECT order_id FROM classes WHERE action = 'unchanged'",
    "nested_values": "SELECT DISTINCT vbeln AS value FROM odocs WHERE vbeln IS NOT NULL",
    "station_view_ids": "SELECT HISTROYID, HISTROYID AS id, CASE WHEN event_id % 5 = 0 THEN 'given' WHEN event_id % 4 = 0 THEN SPEC ELSE LINE_CODE END AS station_code FROM stations",
    "order_number_variants": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN k WHEN 1 THEN '00A' || k WHEN 2 THEN '0' WHEN 3 THEN '' END AS normal, CASE o_orderkey % 5 WHEN 0 THEN k WHEN 2 THEN '0' END AS station, CASE o_orderkey % 5 WHEN 0 THEN k WHEN 1 THEN 'A' || k WHEN 2 THEN '0' WHEN 3 THEN '' END AS bare, CASE o_orderkey % 5 WHEN 0 THEN k WHEN 1 THEN '00A' || k WHEN 2 THEN '0' ELSE '' END AS order_key FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)",
    "conflict_samples": "SELECT CASE action WHEN 'insert' THEN 'missing' WHEN 'stale' THEN 'extra' ELSE 'field_mismatch' END AS kind, order_id FROM classes WHERE action != 'unchanged' ORDER BY 1, 2 LIMIT 20",
    "committed_marks": "SELECT source, greatest(strftime(min(last_synced_at), '%Y-%m-%d'), '1997-01-01') AS mark FROM ords GROUP BY 1",
    "held_marks": "SELECT source, strftime(min(last_synced_at), '%Y-%m-%d') AS mark FROM ords GROUP BY 1",
    "rolling_snapshot": "SELECT coalesce(n.order_id, o.order_id) AS order_id, CASE WHEN o.order_id IS NULL THEN 'insert' WHEN n.order_id IS NULL THEN CASE WHEN o.gstrs_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN 'stale' ELSE 'outside' END WHEN o.order_id LIKE '%5' THEN 'update' ELSE 'unchanged' END AS action FROM (SELECT * FROM ords WHERE gstrs_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND order_id NOT LIKE '%3') n FULL JOIN (SELECT * FROM ords WHERE order_id NOT LIKE '%4') o ON n.order_id = o.order_id",
    "planned_changes": "SELECT action, count(*) AS n FROM classes GROUP BY 1",
    "anchored_cursor_range": "SELECT GSTRS, SPEC, HISTROYID FROM stations WHERE HISTROYID > '0000000100' AND HISTROYID <= '0000000900'",
    "bounded_station_count": "SELECT least(count(*), 501) AS counted, count(*) > 500 AS over FROM stations",
    "matching_devices": "SELECT DISTINCT 'D' || o_orderkey AS doa_code FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 3 = 0 AND (l_partkey = 77 OR (l_partkey % 5 != 0 AND false))",
    "retired_versions": "SELECT CAST(CASE WHEN AUART = 'ZP01' THEN 1 ELSE 2 END AS INTEGER) AS version, count(*) AS rows FROM postings GROUP BY 1",
    "html_extract": "SELECT page_id, replace(replace(replace(replace(trim(regexp_replace(coalesce(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ''), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS title, CAST(len(regexp_extract_all(html, '<a\\s[^>]*href=')) AS BIGINT) AS links FROM pages",
    "dated_rows": "SELECT HISTROYID, SPEC, strftime(gstrs_date, '%Y-%m-%d') AS day, strftime(DATE '2024-01-03' + CAST(7 * ((gstrs_date - DATE '2024-01-03') // 7) AS INTEGER), '%Y-%m-%d') AS asked_from FROM stations WHERE event_id % 2 = 0 AND gstrs_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27'",
    "dated_rows_of_order": "SELECT HISTROYID, AUFNR FROM stations WHERE event_id % 2 = 1 AND nz(AUFNR) = '71'",
    "export_newest_first": "SELECT HISTROYID || chr(9) || PCODE || chr(9) || SPEC_TIME AS line FROM stations WHERE LINE_CODE = 'LINE2' AND gstrs_date <= DATE '2024-01-20'",
    "store_upsert_rows": "SELECT c.order_id, coalesce(s.VBELN, k.VBELN) AS VBELN, coalesce(s.KID, k.KID) AS KID, CASE WHEN action = 'insert' THEN '2026-02-01' ELSE '2026-01-01' END AS first_seen, CASE WHEN action IN ('insert', 'update') THEN '2026-02-01' ELSE '2026-01-01' END AS last_synced, CAST(CASE action WHEN 'update' THEN 2 ELSE 1 END AS INTEGER) AS sync_count FROM classes c LEFT JOIN snap s ON c.order_id = s.order_id LEFT JOIN kept k ON c.order_id = k.order_id",
    "store_partial_upsert": "SELECT coalesce(k.order_id, s.order_id) AS order_id, coalesce(s.VBELN, k.VBELN) AS VBELN, coalesce(s.KID, k.KID) AS KID, CASE WHEN k.order_id IS NULL THEN '2026-02-01' ELSE '2026-01-01' END AS first_seen, CASE WHEN s.order_id IS NOT NULL AND (k.order_id IS NULL OR s.KID != k.KID) THEN '2026-02-01' ELSE '2026-01-01' END AS last_synced, CAST(CASE WHEN k.order_id IS NOT NULL AND s.order_id IS NOT NULL AND s.KID != k.KID THEN 2 ELSE 1 END AS INTEGER) AS sync_count FROM (SELECT * FROM kept WHERE KID != 'K8') k FULL JOIN (SELECT * FROM snap WHERE KID IN ('K7', 'K107', 'K207')) s ON k.order_id = s.order_id",
    "stream_upsert_latest": "SELECT 'P' || user_id AS PCODE, CAST(event_id AS VARCHAR) AS event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(CAST(event_id AS VARCHAR), 12, '0') AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "orders_seek_page": "SELECT order_id, VBELN, GSTRS, order_quantity FROM ords WHERE source = 'SG' ORDER BY gstrs_date DESC, last_synced_at DESC, order_id DESC LIMIT 37 OFFSET 74",
    "repairs_seek_nulls": "SELECT repair_id, VBELN, ERROR_MSG FROM repairs ORDER BY VBELN ASC NULLS FIRST, ERROR_MSG DESC NULLS LAST, repair_id LIMIT 90 OFFSET 90",
    "snapshot_canonical_plan": """SELECT coalesce(i, '') AS identity, coalesce(id, '') AS id, action, relinked, aliases, covered FROM reconciled""",
    "snapshot_run_counts": """SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (relinked) AS relinked, count(*) FILTER (action IN ('stale', 'superseded')) AS deleted,
        count(*) FILTER (action IN ('insert', 'update', 'unchanged')) AS covered, count(*) FILTER (action = 'outside') AS outside FROM reconciled""",
    "snapshot_deletes": "SELECT id FROM reconciled WHERE action IN ('stale', 'superseded')",
    "relinked_references": """SELECT e.event_id AS change_id, coalesce(b.id, CASE WHEN e.event_id % 8 = 0 THEN 'old-' || e.event_id ELSE CAST(e.event_id AS VARCHAR) END) AS repair FROM events e
        LEFT JOIN ranked r ON CAST(e.event_id AS VARCHAR) = r.id AND r.i IN (SELECT i FROM fresh) LEFT JOIN (SELECT i, id FROM ranked WHERE nth = 1) b ON r.i = b.i WHERE e.event_id % 3 != 1""",
    "device_documents": "SELECT {device_fields} FROM piece JOIN said USING (device) GROUP BY device",
    "device_documents_matching": "SELECT {device_fields} FROM piece JOIN said USING (device) GROUP BY device HAVING bool_or(is_company AND material_sn = 'M77')",
    "device_document_page": "SELECT {device_fields} FROM piece JOIN said USING (device) GROUP BY device ORDER BY device LIMIT 30 OFFSET 30",
    "device_relations": "SELECT device, relation, count(*) AS n FROM (SELECT device, 'sales_order:' || CASE WHEN so IS NULL THEN 'missing' WHEN so = doa_so THEN 'same' ELSE 'different' END AS relation FROM piece UNION ALL SELECT device, 'serial:' || CASE WHEN barcode IS NULL THEN 'missing' ELSE 'different' END FROM piece) GROUP BY 1, 2",
    "stored_repair_stats": "SELECT {stats} FROM repairs WHERE gstrs_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-10'",
    "stored_orders_date_range": "SELECT order_id, GSTRS FROM ords WHERE gstrs_date BETWEEN DATE '1996-06-01' AND DATE '1997-03-01'",
    "stored_company_semi": "SELECT repair_id, AUFNR FROM repairs WHERE coalesce(AUFNR, '') != '' AND nz(AUFNR) IN (SELECT nz(AUFNR) FROM ords)",
    "stored_company_anti": "SELECT repair_id, AUFNR FROM repairs WHERE coalesce(AUFNR, '') = '' OR nz(AUFNR) NOT IN (SELECT nz(AUFNR) FROM ords)",
    "stored_sales_of_repairs": "SELECT repair_id, coalesce(nz(p.value), '') AS found FROM repairs r LEFT JOIN prodmap p ON coalesce(r.AUFNR, '') != '' AND nz(r.AUFNR) = p.key",
    "html_table_rows": "SELECT page_id, CAST(nth AS INTEGER) AS place, 'M' || l_partkey AS serial, 'a & ' || l_linenumber || ' b' AS unit, 'c' || l_suppkey AS context_value, 'M' || l_partkey AS material_sn FROM listed",
    "html_form_rows": "SELECT page_id, CAST(nth AS INTEGER) AS place, 'X' || l_suppkey AS context, 'c' || l_suppkey AS link_context, 'M' || l_partkey AS mtr_sn, 'a & ' || l_linenumber || ' b' AS unit, CAST(q AS VARCHAR) AS quantity FROM listed",
    "html_labels": "SELECT o_orderkey AS page_id, o_orderstatus || ' part' AS type, CAST(o_custkey AS VARCHAR) AS parts FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "html_page_links": "SELECT page_id, CAST(generate_subscripts(hs, 1) - 1 AS INTEGER) AS place, unnest(hs) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1) AS hs FROM pages)",
    "date_windows": "SELECT strftime(d, '%Y-%m-%d') AS first_day, strftime(least(d + INTERVAL 6 DAY, b), '%Y-%m-%d') AS last_day FROM (SELECT unnest(generate_series(a, b, INTERVAL 7 DAY)) AS d, b FROM (SELECT CAST(min(gstrs_date) AS TIMESTAMP) AS a, CAST(max(gstrs_date) AS TIMESTAMP) AS b FROM stations))",
    "clamped_windows": "SELECT strftime(d, '%Y-%m-%d') AS first_day, strftime(least(d + INTERVAL 30 DAY, b), '%Y-%m-%d') AS last_day FROM (SELECT unnest(generate_series(a, b, INTERVAL 31 DAY)) AS d, b FROM (SELECT greatest(CAST(min(gstrs_date) AS TIMESTAMP), TIMESTAMP '1997-01-01') AS a, least(CAST(max(gstrs_date) AS TIMESTAMP), TIMESTAMP '1997-12-31') AS b FROM ords))",
    "export_version_footers": "SELECT 'repairs' AS dataset, count(*) || ':' || strftime(max(synced_at), '%Y-%m-%d %H:%M:%S') AS version FROM repairs",
    "data_status_footers": "SELECT 'postings' AS dataset, count(*) AS rows, strftime(max(synced_at), '%Y-%m-%d %H:%M:%S') AS latest FROM postings",
    "stream_item_states": "SELECT key, digest, coalesce(strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f'), '') AS first_seen, coalesce(strftime(last_change, '%Y-%m-%d %H:%M:%S.%f'), '') AS last_change, attempts > 0 AS pending, CAST(attempts AS INTEGER) AS attempts, coalesce(strftime(attempted, '%Y-%m-%d %H:%M:%S.%f'), '') AS attempted, seen FROM items",
    "stream_item_retries": "SELECT key, CAST(attempts AS INTEGER) AS attempts, coalesce(strftime(attempted, '%Y-%m-%d %H:%M:%S.%f'), '') AS attempted FROM items WHERE attempts > 0 ORDER BY items.attempted, key LIMIT 25",
    "repair_backfill_steps": "SELECT repair_id, p2 AS AUFNR, s2 AS VBELN, g2 AS GSTRS, order_source, sales_source, start_source, conflict FROM backfilled",
    "repair_backfill_counts": "SELECT field, source, count(*) AS n FROM (SELECT 'order' AS field, order_source AS source FROM backfilled UNION ALL SELECT 'sales', sales_source FROM backfilled UNION ALL SELECT 'start', start_source FROM backfilled UNION ALL SELECT 'conflict', CASE WHEN conflict THEN 'stations' ELSE '' END FROM backfilled) WHERE source != '' GROUP BY 1, 2",
    "stream_cursor_rows": "SELECT GSTRS, SPEC, HISTROYID, AUFNR FROM passed WHERE GSTRS <= '20240112' UNION ALL SELECT GSTRS, SPEC, HISTROYID, AUFNR FROM passed WHERE GSTRS BETWEEN '20240110' AND '20240120' AND GSTRS || '/' || SPEC || '/' || HISTROYID > (SELECT max(GSTRS || '/' || SPEC || '/' || HISTROYID) FROM passed WHERE GSTRS <= '20240112')",
    "source_scan_incremental": "SELECT HISTROYID, SPEC_TIME, GSTRS FROM stations WHERE synced_at >= TIMESTAMP '2024-01-17 06:00:00' AND gstrs_date BETWEEN DATE '2024-01-18' AND DATE '2024-01-25'",
    "source_scan_of_orders": "SELECT HISTROYID, AUFNR, SPEC_TIME FROM stations WHERE synced_at >= TIMESTAMP '2024-01-02' AND AUFNR IN ('000000000003', '000000000017', '000000000042', '000000000099', '000000000512')",
    "declarations_by_branches": "SELECT doa_code, doa_type, status FROM doa WHERE doa_type IN ('1-URGENT', '2-HIGH', '5-LOW') AND status IN ('F', 'O') AND o_orderkey % 4 != 0 AND declare_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND NOT is_company AND o_orderkey % 5 != 0 AND declare_date + 9 BETWEEN DATE '1994-02-01' AND DATE '1997-06-30'",
    "declarations_by_people": "SELECT doa_code, 'C' || o_custkey AS customer_uid FROM doa WHERE o_custkey BETWEEN 7 AND 10 AND is_company AND o_orderkey % 13 IN (1, 10, 11, 12)",
    "changes_by_branches": "SELECT conv_id || '-' || turn AS change_id, 'N' || turn AS part_number, 'OP' || (conv_id % 7) AS operator FROM conversations WHERE role IN ('user', 'assistant') AND turn IN (0, 1, 2) AND turn % 5 != 0 AND conv_id % 7 IN (1, 2, 3) AND DATE '2026-01-01' + CAST(conv_id % 300 AS INTEGER) BETWEEN DATE '2026-01-05' AND DATE '2026-09-30' AND conv_id % 3 != 0",
    "declarations_export": "SELECT concat_ws(chr(9), doa_code, doa_type, status, declare_time, CASE WHEN is_company THEN 'true' ELSE 'false' END) AS line FROM doa WHERE status = 'F' AND o_orderkey % 5 != 0 AND declare_date + 9 >= DATE '1995-01-01'",
    "store_backfill_pages": "SELECT order_id, CASE WHEN order_id LIKE '%7' THEN true ELSE contains(lower(o_orderpriority), 'urgent') END AS is_overseas, CASE WHEN order_id LIKE '%7' THEN '2026-01-01' ELSE '2026-02-01' END AS last_synced, CAST(CASE WHEN order_id LIKE '%7' THEN 1 ELSE 2 END AS INTEGER) AS sync_count FROM ords JOIN orders ON CAST(AUFNR AS BIGINT) = o_orderkey",
    "full_row_keys": """SELECT repair_id, 'full_row:' || sha256('[["PCODE","' || PCODE || '"],["AUFNR","' || coalesce(AUFNR, '') || '"],["ZMCOD1","' || ZMCOD1 || '"]]') AS row_key FROM repairs""",
    "order_open_columns": "SELECT order_id, 'W1' AS base, CASE WHEN ZSTAT = 'O' THEN GSTRS END AS late, LGORT AS zone FROM ords",
    "detail_retry_queue": "SELECT doa_code, coalesce(CASE WHEN status != 'O' THEN declare_time END, '') AS attempted FROM doa WHERE o_orderkey % 4 = 0 ORDER BY CASE WHEN status != 'O' THEN declare_time END ASC NULLS FIRST, doa_code LIMIT 40",
    "device_orders_on_board": "SELECT l_orderkey IS NOT NULL AND o_orderstatus = 'F' AS known, count(*) AS pieces, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN 'unidentified:D' || o_orderkey || ':0' WHEN l_partkey % 5 = 0 THEN 'context:X' || l_suppkey ELSE 'product:P' || (l_partkey % 700) END) AS devices FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
}

STATS = """count(*) AS total, CAST(sum(CASE WHEN ERROR_CODE != '' OR coalesce(ERROR_MSG, '') != '' THEN 1 ELSE 0 END) AS BIGINT) AS with_error, count(*) FILTER (coalesce(U_FIX, '') != '') AS with_person, count(*) FILTER (coalesce(MATNR, '') != '') AS with_material,
    count(*) FILTER (RECORD01REPAIRM != '') AS with_part_serial, count(*) FILTER (coalesce(VBELN, '') = '') AS missing_sales, count(*) FILTER (coalesce(AUFNR, '') = '') AS missing_production,
    count(DISTINCT nullif(nz(VBELN), '')) AS sales_orders, count(DISTINCT nullif(nz(AUFNR), '')) AS production_orders, count(DISTINCT PCODE) AS hosts, min(ZDATE_WX) AS first_day, max(ZDATE_WX) AS last_day"""


def _field(name: str, good: str, bad: str = "NULL") -> str:
    """Status, value and texts of a device's field, from lists of its values and of its invalid texts."""
    n, m = f"coalesce(len(any_value({good})), 0)", f"coalesce(len(any_value({bad})), 0)" if bad != "NULL" else "0"
    texts = f"concat_ws(',', nullif(array_to_string(any_value({good}), ','), ''), {'NULL' if bad == 'NULL' else f"nullif(array_to_string(any_value({bad}), ','), '')"})"
    return f"CASE WHEN {n} > 1 THEN 'conflict' WHEN {m} > 0 THEN 'invalid' WHEN {n} = 0 THEN 'missing' ELSE 'valid' END AS {name}_status, CASE WHEN {n} = 1 AND {m} = 0 THEN any_value({good})[1] ELSE '' END AS {name}, {texts} AS {name}_texts"


#: The columns of a device document.
DEVICE = ", ".join([
    "device, CASE WHEN device LIKE 'product:%' THEN 'product_barcode' ELSE 'product_context' END AS basis, count(*) AS n_pieces",
    """md5(string_agg(line, ';' ORDER BY line)) AS pieces""".replace("line", "(doa_code || '|' || context || '|' || coalesce(so, '') || '|' || CASE WHEN so IS NULL THEN 'missing' WHEN so = doa_so THEN 'same' ELSE 'different' END || '|' || CASE WHEN barcode IS NULL THEN 'missing' ELSE 'different' END || '|' || coalesce(fp, ''))"),
    _field("sales_order", "sales"), _field("production_order", "production"), _field("model", "models"), _field("factory_date", "factory", "fbad"), _field("warranty_end", "warranty", "wbad"),
])


def _zeros_off(sql: str) -> str:
    """``nz(x)`` written out: a trimmed number without leading zeros."""
    return re.sub(r"\bnz\(([\w.]+)\)", r"CASE WHEN regexp_full_match(trim(\1), '[0-9]+') THEN coalesce(nullif(ltrim(trim(\1), '0'), ''), '0') ELSE trim(\1) END", sql)


def _with_datasets(sql: str) -> str:
    """The query with the datasets it names, and those that they name, in order."""
    needed: set[str] = set()
    found = {name for name in DATASETS if re.search(rf"\b(FROM|JOIN) {name}\b", sql)}
    while found - needed:
        needed |= found
        found = {name for name in DATASETS for other in needed if re.search(rf"\b(FROM|JOIN) {name}\b", DATASETS[other])}
    parts = ", ".join(f"{name} AS {'MATERIALIZED ' if name == 'proof' else ''}({body})" for name, body in DATASETS.items() if name in needed)
    return f"WITH {parts} {sql}" if parts else sql


def oracle_sql() -> dict[str, str]:
    return {name: _zeros_off(_with_datasets(sql.replace("{stats}", STATS).replace("{device_fields}", DEVICE))) for name, sql in QUERIES.items()}
