"""DuckDB SQL twins of ``table_queries.QUERIES`` (same column names)."""

from __future__ import annotations

from .table_queries import _RULES_SQL

_EV_LEDGER = """
  SELECT CAST(ts AS DATE) AS date, event_type AS name, CAST(floor(value) AS BIGINT) AS price,
         event_id, user_id
  FROM events"""

_SPLIT = f"""
existing AS ({_EV_LEDGER} WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
incoming AS ({_EV_LEDGER} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'),
survivors AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY date, name, price ORDER BY user_id, event_id DESC) AS rn
    FROM incoming) WHERE rn = 1),
new_rows AS (
  SELECT date, name, price, event_id, user_id FROM survivors s
  WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.date = s.date AND e.name = s.name AND e.price = s.price))"""

_COUNTS = f"""
WITH {_SPLIT},
counts AS (
  SELECT p.user_id, p.parsed_entry_num, CAST(coalesce(i.n, 0) AS BIGINT) AS new_entry_num
  FROM (SELECT user_id, count(*) AS parsed_entry_num FROM incoming GROUP BY user_id) p
  LEFT JOIN (SELECT user_id, count(*) AS n FROM new_rows GROUP BY user_id) i USING (user_id))"""

_PRICE_FMT = "format('{:,}', CAST(floor(o_totalprice) AS BIGINT))"

_DICT = f"""
WITH {_RULES_SQL},
d AS (
  SELECT field_name AS f, coalesce(exact_match, 0) = 1 AS e, coalesce(value, '') AS v,
         arg_max(category_id, id) AS c, max(id) AS rid
  FROM rules WHERE field_name IN ('name', 'm_category')
  GROUP BY ALL),
rows AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS m_category, p_brand AS fin_ins,
         CAST(DATE '2024-01-01' + p_size AS DATE) AS date, CAST(floor(p_retailprice) AS BIGINT) AS price
  FROM part),
hits AS (
  SELECT r.*,
    (SELECT c FROM d WHERE f = 'name' AND e AND v = r.name) AS c1,
    (SELECT arg_min(c, rid) FROM d WHERE f = 'name' AND NOT e AND contains(r.name, v)) AS c2,
    (SELECT c FROM d WHERE f = 'm_category' AND e AND v = r.m_category) AS c3,
    (SELECT arg_min(c, rid) FROM d WHERE f = 'm_category' AND NOT e AND contains(r.m_category, v)) AS c4,
    r.fin_ins IN ('モバイルSuica', 'モバイルSuica (モバイルSuica ID)', 'モバイルSuica（モバイルSuica ID）')
      AND strpos(r.name, '入') > 0 AND strpos(r.name, '出') > strpos(r.name, '入') AS transit
  FROM rows r),
classified AS (
  SELECT id, name, date, price,
    CAST(coalesce(c1, c2, c3, c4, CASE WHEN transit THEN 270 END) AS BIGINT) AS category_id,
    CASE WHEN c1 IS NOT NULL THEN 'name_exact' WHEN c2 IS NOT NULL THEN 'name_contains'
         WHEN c3 IS NOT NULL THEN 'm_category_exact' WHEN c4 IS NOT NULL THEN 'm_category_contains'
         WHEN transit THEN 'transit' END AS matched_by
  FROM hits)"""

_ORDERS_DETAIL = """
od AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS name,
         CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(o_orderdate AS DATE) AS regist_date,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN CAST(o_orderdate AS DATE) + 1 END AS maw_check_date,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 1 END AS maw_regist_date
  FROM orders)"""

_HISTORY = """
h AS (
  SELECT event_id AS id, event_type AS job_label, CAST(user_id AS BIGINT) AS parsed_entry_num,
         CAST(floor(value) AS BIGINT) AS new_entry_num, format('u{:04d}', user_id) AS src_file,
         ts AS updated_at
  FROM events)"""

_ASSETS = """
a AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_amount,
         count(*) AS points
  FROM orders GROUP BY 1)"""

_REQUESTS = """
req AS (
  SELECT r_regionkey * 5 AS req_order, r_name AS value, CAST(r_regionkey + 500 AS BIGINT) AS category_id,
         1 AS exact_match FROM region
  UNION ALL
  SELECT r_regionkey * 5 + 2, lower(r_name), CAST(0 AS BIGINT), 0 FROM region)"""

_PAGE_KEYS = """
k AS (
  SELECT 'landing/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS key
  FROM pages),
kept AS (
  SELECT regexp_extract(key, '[^/]*$') AS basename, key FROM k
  WHERE starts_with(key, 'landing/') AND NOT ends_with(key, '/') AND key <> 'landing')"""

ORACLE_SQL = {
    "parse_ledger_date": """
SELECT o_orderkey, raw_date,
       CASE WHEN regexp_full_match(raw_date, '\\d{4}/\\d{2}/\\d{2}') THEN CAST(try_strptime(raw_date, '%Y/%m/%d') AS DATE) END AS date,
       (regexp_full_match(raw_date, '\\d{4}/\\d{2}/\\d{2}') AND try_strptime(raw_date, '%Y/%m/%d') IS NOT NULL) AS valid
FROM (SELECT o_orderkey,
             CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%m/%d')
                  WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y/%-m/%-d')
                  ELSE strftime(o_orderdate, '%Y/%m/%d') END AS raw_date
      FROM orders)""",
    "parse_price": f"""
SELECT o_orderkey, raw_price,
       CASE WHEN regexp_full_match(s, '\\+?\\d+') AND TRY_CAST(s AS BIGINT) <= 2147483647 THEN TRY_CAST(s AS BIGINT) END AS price,
       coalesce(regexp_full_match(s, '\\+?\\d+') AND TRY_CAST(s AS BIGINT) <= 2147483647, false) AS valid
FROM (SELECT o_orderkey, raw_price, translate(raw_price, ',-"', '') AS s
      FROM (SELECT o_orderkey,
                   CASE WHEN o_orderstatus = 'F' THEN '-' || {_PRICE_FMT}
                        WHEN o_orderstatus = 'O' THEN '"' || {_PRICE_FMT} || '"'
                        ELSE {_PRICE_FMT} || 'a' END AS raw_price
            FROM orders))""",
    "parse_amount": """
SELECT c_custkey, raw_amount,
       CASE WHEN regexp_full_match(s, '[+-]?\\d+') AND TRY_CAST(s AS BIGINT) BETWEEN -2147483648 AND 2147483647 THEN TRY_CAST(s AS BIGINT) END AS amount,
       coalesce(regexp_full_match(s, '[+-]?\\d+') AND TRY_CAST(s AS BIGINT) BETWEEN -2147483648 AND 2147483647, false) AS valid
FROM (SELECT c_custkey, raw_amount, translate(raw_amount, ',"', '') AS s
      FROM (SELECT c_custkey,
                   CASE WHEN c_mktsegment = 'BUILDING' THEN '"' || f || '"'
                        WHEN c_mktsegment = 'AUTOMOBILE' THEN f || ' yen'
                        ELSE f END AS raw_amount
            FROM (SELECT *, format('{:,}', CAST(floor(c_acctbal) AS BIGINT)) AS f FROM customer)))""",
    "parse_month_end": """
SELECT o_orderkey, raw_date, date, date IS NOT NULL AS valid
FROM (SELECT o_orderkey, raw_date,
             CASE WHEN regexp_full_match(raw_date, '\\d{4}-\\d{2}月末')
                  THEN CAST(make_date(CAST(substr(raw_date, 1, 4) AS INTEGER), 1, 1)
                            + to_months(CAST(substr(raw_date, 6, 2) AS INTEGER)) - INTERVAL 1 DAY AS DATE)
                  WHEN regexp_full_match(raw_date, '\\d{4}-\\d{2}-\\d{2}')
                  THEN CAST(try_strptime(raw_date, '%Y-%m-%d') AS DATE) END AS date
      FROM (SELECT o_orderkey,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN strftime(o_orderdate, '%Y-%m') || '月末'
                        WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y') || '-13月末'
                        WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%Y/%m/%d')
                        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw_date
            FROM orders))""",
    "split_rejects": """
WITH t AS (
  SELECT o_orderpriority AS src_file, o_orderkey AS row_idx,
         (o_orderpriority = '5-LOW' AND (o_orderstatus = 'P' OR o_orderkey % 97 = 5)) AS bad
  FROM orders),
r AS (
  SELECT src_file, dense_rank() OVER (ORDER BY src_file) - 1 AS file_rank,
         count(*) FILTER (WHERE NOT bad) AS parsed_rows,
         count(*) FILTER (WHERE bad) AS rejected_rows,
         min(row_idx) FILTER (WHERE bad) AS first_bad_row
  FROM t GROUP BY src_file)
SELECT src_file, file_rank, parsed_rows, rejected_rows, first_bad_row,
       (SELECT min(file_rank) FROM r WHERE rejected_rows > 0) IS NULL
         OR file_rank < (SELECT min(file_rank) FROM r WHERE rejected_rows > 0) AS imported
FROM r""",
    "reverse_position": """
SELECT event_id, event_type AS src_file,
       row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_idx,
       CAST(count(*) OVER (PARTITION BY event_type) - (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS INTEGER) AS yyyymm_id
FROM events""",
    "dedup_in_run": f"""
SELECT date, name, price, event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY date, name, price ORDER BY user_id, event_id DESC) AS rn
  FROM ({_EV_LEDGER})) WHERE rn = 1""",
    "import_new_rows": f"WITH {_SPLIT} SELECT * FROM new_rows",
    "import_dry_run": f"""
WITH {_SPLIT}
SELECT date, name, price, event_id, user_id FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.date = i.date AND e.name = i.name AND e.price = i.price)""",
    "duplicates_report": f"""
WITH {_SPLIT}
SELECT date, name, price, event_id, user_id FROM incoming i
WHERE EXISTS (SELECT 1 FROM existing e WHERE e.date = i.date AND e.name = i.name AND e.price = i.price)""",
    "import_counts": f"{_COUNTS} SELECT user_id, parsed_entry_num, new_entry_num FROM counts",
    "history_delta": f"""{_COUNTS},
hist AS (SELECT max(event_id) AS id, user_id AS src_file, count(*) AS parsed_entry_num
         FROM existing GROUP BY user_id, name),
last AS (SELECT src_file, arg_max(parsed_entry_num, id) AS last_parsed FROM hist GROUP BY src_file)
SELECT c.user_id, c.parsed_entry_num, c.new_entry_num, l.last_parsed
FROM counts c LEFT JOIN last l ON l.src_file = c.user_id
WHERE l.last_parsed IS NULL OR l.last_parsed <> c.parsed_entry_num""",
    "assign_ids": f"""
WITH {_SPLIT}
SELECT event_id,
       CAST((SELECT max(event_id) FROM existing) + row_number() OVER (ORDER BY user_id, event_id DESC) AS BIGINT) AS id
FROM new_rows""",
    "asset_new_dates": """
WITH inc AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS total_amount,
         o_orderpriority AS src_file
  FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'),
surv AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY src_file, o_orderkey) AS rn FROM inc)
  WHERE rn = 1)
SELECT date, o_orderkey, total_amount FROM surv s
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
                  AND CAST(o.o_orderdate AS DATE) = s.date)""",
    "rule_dictionary": f"""
WITH {_RULES_SQL}
SELECT field_name, coalesce(exact_match, 0) = 1 AS exact, coalesce(value, '') AS value,
       arg_max(category_id, id) AS category_id, max(id) AS rule_id,
       field_name IN ('name', 'm_category') AS valid
FROM rules GROUP BY field_name, coalesce(exact_match, 0) = 1, coalesce(value, '')""",
    "classify": f"{_DICT} SELECT id, category_id, matched_by FROM classified",
    "classify_join": f"{_DICT} SELECT id, category_id, matched_by FROM classified",
    "transit_rows": """
SELECT doc_id, fin_ins,
       fin_ins IN ('モバイルSuica', 'モバイルSuica (モバイルSuica ID)', 'モバイルSuica（モバイルSuica ID）')
         AND strpos(name, '入') > 0 AND strpos(name, '出') > strpos(name, '入') AS is_transit
FROM (SELECT doc_id,
             CASE source WHEN 'src0' THEN 'モバイルSuica' WHEN 'src1' THEN 'モバイルSuica (モバイルSuica ID)'
                         WHEN 'src2' THEN 'モバイルSuica（モバイルSuica ID）' ELSE source END AS fin_ins,
             translate(text, 'ae', '入出') AS name
      FROM documents)""",
    "outbox": f"""{_DICT}
SELECT id AS detail_id, CAST(1 AS BIGINT) AS seq, category_id, strftime(date, '%Y%m%d') AS datetime,
       price, 'ledger-importer' AS "from", '' AS type, name AS memo,
       to_json(struct_pack(category_id := category_id, datetime := strftime(date, '%Y%m%d'), price := price,
                           "from" := 'ledger-importer', type := '', memo := name)) AS body
FROM classified WHERE category_id IS NOT NULL""",
    "pending_rows": f"""
WITH {_ORDERS_DETAIL}
SELECT id, date, name, price FROM od WHERE maw_check_date IS NULL""",
    "apply_status": """
WITH ev AS (
  SELECT CAST(user_id AS BIGINT) AS detail_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'check' WHEN event_type IN ('purchase', 'signup') THEN 'forward'
              WHEN event_type = 'error' THEN 'reset' END AS op,
         CAST(ts AS DATE) AS at_day, event_id AS seq
  FROM events),
last AS (SELECT detail_id, arg_max(op, seq) AS op, arg_max(at_day, seq) AS at_day FROM ev GROUP BY detail_id)
SELECT detail_id, op,
       CASE WHEN op IN ('check', 'forward') THEN at_day END AS maw_check_date,
       CASE WHEN op = 'forward' THEN at_day END AS maw_regist_date,
       CASE WHEN op IN ('check', 'forward') THEN (CASE WHEN op = 'forward' THEN 'forwarded' ELSE 'judged' END)
            ELSE 'pending' END AS status
FROM last""",
    "ledger_page": f"""
WITH {_ORDERS_DETAIL}
SELECT id, date AS "useDate", name, format('{{:,}}', price) AS price_text,
       coalesce(substr(CAST(regist_date AS VARCHAR), 1, 19), '') AS "registDate",
       coalesce(substr(CAST(maw_check_date AS VARCHAR), 1, 19), '') AS "importJudgeDate",
       coalesce(substr(CAST(maw_regist_date AS VARCHAR), 1, 19), '') AS "importDate",
       CASE WHEN maw_check_date IS NULL THEN 'pending' WHEN maw_regist_date IS NULL THEN 'judged'
            ELSE 'forwarded' END AS status
FROM od ORDER BY id DESC LIMIT 20 OFFSET 40""",
    "ledger_count": "SELECT count(*) AS count FROM orders",
    "page_count": "SELECT count(*) AS count, CAST(greatest(ceil(count(*) / 20), 1) AS BIGINT) AS pages FROM orders",
    "latest_run_by_job": f"""
WITH {_HISTORY}
SELECT job_label, max(id) AS run_id, arg_max(parsed_entry_num, id) AS parsed_entry_num,
       arg_max(new_entry_num, id) AS new_entry_num,
       CAST(floor(epoch(arg_max(updated_at, id))) AS BIGINT) AS updated_at_epoch
FROM h GROUP BY job_label""",
    "latest_run_by_file": f"""
WITH {_HISTORY}
SELECT src_file, max(id) AS run_id, arg_max(job_label, id) AS job_label,
       arg_max(parsed_entry_num, id) AS parsed_entry_num, arg_max(new_entry_num, id) AS new_entry_num
FROM h GROUP BY src_file""",
    "runs_for_file": f"""
WITH {_HISTORY}
SELECT id, job_label, parsed_entry_num, new_entry_num FROM h WHERE src_file = 'u0007'""",
    "asset_latest_n": f"WITH {_ASSETS} SELECT date, total_amount, points FROM a ORDER BY date DESC LIMIT 10",
    "asset_by_date": f"WITH {_ASSETS} SELECT date, total_amount, points FROM a WHERE date = DATE '1998-08-02'",
    "rule_view": f"""
WITH {_RULES_SQL}
SELECT id, field_name AS "fieldName", value, category_id AS "categoryId",
       CAST(coalesce(exact_match, 0) AS INTEGER) AS "exactMatch"
FROM rules""",
    "rule_lookup": f"""
WITH {_RULES_SQL}
SELECT id, field_name AS "fieldName", value, category_id AS "categoryId",
       CAST(coalesce(exact_match, 0) AS INTEGER) AS "exactMatch"
FROM rules WHERE id = 42""",
    "rule_add": f"""
WITH {_RULES_SQL}, {_REQUESTS}
SELECT CAST((SELECT max(id) FROM rules) + row_number() OVER (ORDER BY req_order) AS BIGINT) AS id,
       'name' AS field_name, value, CAST(exact_match AS INTEGER) AS exact_match, category_id
FROM req""",
    "rule_delete": f"""
WITH {_RULES_SQL}
SELECT id, field_name, value, exact_match, category_id FROM rules
WHERE id NOT IN (SELECT p_partkey + 1 FROM part WHERE p_brand = 'Brand#1')""",
    "flatten_by_basename": f"""
WITH {_PAGE_KEYS}
SELECT basename, max(key) AS key, count(*) AS n_keys FROM kept GROUP BY basename""",
    "route_files": """
SELECT o_orderkey, file_name, ends_with(file_name, '.csv') AS listed,
       CASE WHEN NOT ends_with(file_name, '.csv') THEN NULL
            WHEN contains(file_name, 'cf.csv') OR contains(file_name, 'cf_lastmonth.csv') THEN 'ledger'
            WHEN contains(file_name, 'asset_history.csv') THEN 'asset' END AS kind
FROM (SELECT o_orderkey,
             o_orderstatus || '_' || CAST(o_orderkey AS VARCHAR) || '_' ||
             CASE o_orderpriority WHEN '1-URGENT' THEN 'cf.csv' WHEN '2-HIGH' THEN 'cf_lastmonth.csv'
                  WHEN '3-MEDIUM' THEN 'asset_history.csv' WHEN '4-NOT SPECIFIED' THEN 'asset_history.CSV'
                  ELSE 'dummy.csv' END AS file_name
      FROM orders)""",
}


ORACLE_SQL.update({
    "stream_import": """
SELECT DISTINCT CAST(ts AS DATE) AS date, event_type AS name, CAST(floor(value) AS BIGINT) AS price
FROM events""",
    "stream_latest": f"""
WITH {_HISTORY}
SELECT job_label, max(id) AS run_id, arg_max(parsed_entry_num, id) AS parsed_entry_num,
       arg_max(new_entry_num, id) AS new_entry_num
FROM h GROUP BY job_label""",
})


ORACLE_SQL.update({
    "classify_pending_run": """
WITH types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS r
               FROM (SELECT DISTINCT event_type FROM events)),
rules AS (SELECT r + 1 AS rid, r % 2 = 0 AS on_name,
                 CASE WHEN r % 2 = 0 THEN substr(event_type, 2, 3) ELSE format('seg{}', r) END AS v,
                 CAST(CASE WHEN r % 2 = 0 THEN 100 ELSE 200 END + r AS BIGINT) AS c
          FROM types),
p AS (SELECT event_id + 1 AS detail_id, CAST(ts AS DATE) AS date, event_type AS name,
             CAST(floor(value) AS BIGINT) AS price, format('seg{}', user_id % 7) AS m_category
      FROM events WHERE event_type <> 'error'),
c AS (SELECT p.*, coalesce((SELECT arg_min(c, rid) FROM rules WHERE on_name AND contains(p.name, v)),
                           (SELECT arg_max(c, rid) FROM rules WHERE NOT on_name AND v = p.m_category))
                    AS category_id
      FROM p)
SELECT detail_id, CAST(2 AS BIGINT) AS seq, category_id, strftime(date, '%Y%m%d') AS datetime, price,
       name AS memo
FROM c WHERE category_id IS NOT NULL""",
    "import_assets_e2e": """
WITH a AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_amount,
         count(*) AS points
  FROM orders GROUP BY 1)
SELECT date, total_amount, CAST(floor(total_amount / 2) AS BIGINT) AS cash_deposit_crypto,
       CAST(0 AS BIGINT) AS stocks, CAST(total_amount - floor(total_amount / 2) AS BIGINT) AS investment_trusts,
       CAST(points AS BIGINT) AS points,
       (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS history_rows
FROM a""",
})


_STATUS_EVENTS = """
m AS (SELECT max(o_orderkey) // 2 AS hwm FROM orders),
ev AS (
  SELECT o_orderkey AS detail_id, CASE WHEN o_orderstatus = 'F' THEN 'forward' ELSE 'check' END AS op,
         CAST(o_orderdate AS DATE) + 1 AS at_day, 1 AS seq
  FROM orders, m WHERE o_orderkey <= hwm
  UNION ALL
  SELECT o_orderkey, 'reset', CAST(o_orderdate AS DATE) + 2, 2
  FROM orders, m WHERE o_orderkey <= hwm AND o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT o_orderkey, 'check', CAST(o_orderdate AS DATE) + 3, 3
  FROM orders, m WHERE o_orderkey > hwm AND o_orderkey <= hwm + 100 AND o_orderstatus = 'F'),
last AS (SELECT detail_id, arg_max(op, seq) AS op, arg_max(at_day, seq) AS at_day FROM ev GROUP BY detail_id)"""

ORACLE_SQL.update({
    "detail_status_view": f"""
WITH {_STATUS_EVENTS}
SELECT o.o_orderkey AS id,
       CASE WHEN l.op IN ('check', 'forward') THEN l.at_day END AS maw_check_date,
       CASE WHEN l.op = 'forward' THEN l.at_day END AS maw_regist_date,
       CASE WHEN l.op IS NULL OR l.op = 'reset' THEN 'pending' WHEN l.op = 'check' THEN 'judged'
            ELSE 'forwarded' END AS status
FROM orders o LEFT JOIN last l ON l.detail_id = o.o_orderkey""",
    "pending_incremental": f"""
WITH {_STATUS_EVENTS}
SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS date, CAST(floor(o.o_totalprice) AS BIGINT) AS price
FROM orders o LEFT JOIN last l ON l.detail_id = o.o_orderkey
WHERE l.op IS NULL OR l.op = 'reset'""",
})

_LEDGER_TEXT = """
t AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority || ' ' || o_orderstatus AS name,
         CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) AS price, o_orderkey,
         substr(o_orderpriority, 1, 1) AS p, year(o_orderdate) AS yr,
         CAST((CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 31 + floor(o_totalprice / 1000) AS BIGINT)
           % (SELECT max(o_orderkey) // 1000000 + 1 FROM orders) AS b
  FROM orders)"""

ORACLE_SQL.update({
    "dedup_collated": f"""
SELECT date, CASE WHEN event_id % 3 = 0 THEN upper(name) || ' '
                  WHEN event_id % 3 = 1 THEN upper(substr(name, 1, 1)) || substr(name, 2) ELSE name END AS name,
       price, event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY date, name, price ORDER BY user_id, event_id DESC) AS rn
  FROM ({_EV_LEDGER})) WHERE rn = 1""",
    "import_history_e2e": f"""
WITH {_LEDGER_TEXT},
files AS (
  SELECT yr, b, count(*) AS parsed, count(DISTINCT (date, name, price)) AS added FROM t GROUP BY yr, b
  UNION ALL SELECT 1990, 0, 0, 0 UNION ALL SELECT 1991, 0, 0, 0),
runs AS (
  SELECT 1 AS run, 'first' AS job_label, yr, b, parsed, added FROM files
  UNION ALL SELECT 2, 'second', yr, b, parsed, 0 FROM files),
seen AS (SELECT *, lag(parsed) OVER (ORDER BY run, yr, b) AS last FROM runs)
SELECT row_number() OVER (ORDER BY run, yr, b) AS id, job_label, parsed AS parsed_entry_num,
       CAST(added AS BIGINT) AS new_entry_num, 'cf 1+2.csv' AS src_file
FROM seen WHERE last IS NULL OR last <> parsed""",
    "import_duplicates_e2e": f"""
WITH {_LEDGER_TEXT}
SELECT date, name, price, CAST(o_orderkey AS VARCHAR) AS source_id FROM t WHERE yr < 1996""",
    "import_rejects_e2e": f"""
WITH {_LEDGER_TEXT},
bad AS (SELECT DISTINCT p, b FROM t WHERE p IN ('2', '3', '5') AND o_orderkey % 500 = 0),
s AS (SELECT *, row_number() OVER (PARTITION BY date, name, price ORDER BY o_orderkey DESC) AS rn
      FROM t WHERE (p, b) NOT IN (SELECT p, b FROM bad))
SELECT date, name, price, CAST(o_orderkey AS VARCHAR) AS source_id FROM s WHERE rn = 1""",
})

_STORED = f"""
WITH {_LEDGER_TEXT}
SELECT DISTINCT 'ledger' AS kind, date, name, price AS amount FROM t
UNION ALL
SELECT 'asset', CAST(o_orderdate AS DATE), '', CAST(sum(floor(o_totalprice)) AS BIGINT) FROM orders GROUP BY ALL"""

ORACLE_SQL.update({
    "import_sjis_e2e": f"""
WITH {_LEDGER_TEXT},
s AS (SELECT date, '表示　ソ能 ' || translate(name[-1], 'FOP', '済未待') AS name, price, o_orderkey FROM t)
SELECT date, name, price, CAST(max(o_orderkey) AS VARCHAR) AS source_id FROM s GROUP BY date, name, price""",
    "stream_drops_e2e": _STORED,
    "import_prefix_e2e": _STORED,
})

_ONE_RUN = f"""
WITH {_LEDGER_TEXT},
files AS (
  SELECT format('{{}}-{{:06d}}_cf.csv', yr, b) AS src_file, count(*) AS parsed, count(DISTINCT (date, name, price)) AS added
  FROM t GROUP BY yr, b)"""

ORACLE_SQL.update({
    "import_files_e2e": f"""
WITH {_LEDGER_TEXT},
f AS (SELECT *, row_number() OVER (PARTITION BY p, yr, b ORDER BY o_orderkey) AS row_idx,
             count(*) OVER (PARTITION BY p, yr, b) + 1 AS n FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY date, name, price ORDER BY row_idx DESC) AS rn FROM f)
SELECT date, name, price, CAST(n - row_idx AS INTEGER) AS yyyymm_id, CAST(o_orderkey AS VARCHAR) AS source_id
FROM s WHERE rn = 1""",
    "import_split_e2e": f"""
WITH {_LEDGER_TEXT},
s AS (SELECT *, count(*) OVER (PARTITION BY b) - row_number() OVER (PARTITION BY b ORDER BY o_orderkey) + 1 AS yyyymm_id,
             row_number() OVER (PARTITION BY date, name, price ORDER BY o_orderkey DESC) AS rn FROM t)
SELECT date, 'say "' || name || '",' || chr(10) || chr(10) || '"twice"' AS name, price,
       CAST(yyyymm_id AS INTEGER) AS yyyymm_id, CAST(o_orderkey AS VARCHAR) AS source_id
FROM s WHERE rn = 1""",
    "import_retry_e2e": f"""{_ONE_RUN}
SELECT row_number() OVER (ORDER BY src_file) AS id, 'retry' AS job_label, src_file, parsed AS parsed_entry_num,
       added AS new_entry_num, CAST(sum(added) OVER () AS BIGINT) AS stored_rows, CAST(sum(added) OVER () AS BIGINT) AS max_id
FROM files""",
    "stream_replay_e2e": f"""{_ONE_RUN},
f AS (SELECT * FROM files UNION ALL SELECT '1991-000000_cf.csv', 0, 0)
SELECT row_number() OVER (ORDER BY src_file) AS id, 'stream' AS job_label, src_file, parsed AS parsed_entry_num,
       added AS new_entry_num, CAST(sum(added) OVER () AS BIGINT) AS stored_rows, CAST(sum(added) OVER () AS BIGINT) AS max_id
FROM f""",
    "import_stamps_e2e": f"""
WITH {_LEDGER_TEXT}, s AS (SELECT DISTINCT date, name, price FROM t)
SELECT count(*) AS stored_rows, count(*) AS created_rows, count(*) AS updated_rows, count(*) AS equal_rows,
       CAST(2 AS BIGINT) AS run_stamps, CAST(1 AS BIGINT) AS first_stamps FROM s""",
    "import_collated_e2e": f"""
WITH {_LEDGER_TEXT},
s AS (SELECT *, row_number() OVER (PARTITION BY date, name, price ORDER BY o_orderkey DESC) AS rn FROM t)
SELECT CASE WHEN yr < 1996 THEN 'duplicate' ELSE 'inserted' END AS kind, date, lower(name) || ' ' AS name, price,
       CAST(o_orderkey AS VARCHAR) AS source_id
FROM s WHERE yr < 1996 OR rn = 1""",
})

ORACLE_SQL["import_index_e2e"] = f"""
WITH {_LEDGER_TEXT},
s AS (SELECT *, row_number() OVER (PARTITION BY date, name, price ORDER BY o_orderkey DESC) AS rn FROM t)
SELECT CASE WHEN yr < 1997 THEN 'duplicate' ELSE 'inserted' END AS kind, date, name, price,
       CAST(o_orderkey AS VARCHAR) AS source_id
FROM s WHERE yr < 1997 OR rn = 1"""
ORACLE_SQL.update({
    "status_base_view": ORACLE_SQL["detail_status_view"],
    "ledger_page_deep": f"""
WITH {_STATUS_EVENTS},
o AS (SELECT *, count(*) OVER () AS n FROM orders WHERE o_orderkey % 7 <> 3),
s AS (SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS d, o.o_orderpriority AS name,
             CAST(floor(o.o_totalprice) AS BIGINT) AS price, n,
             CASE WHEN l.op IN ('check', 'forward') THEN l.at_day END AS judged,
             CASE WHEN l.op = 'forward' THEN l.at_day END AS sent,
             row_number() OVER (ORDER BY o.o_orderkey DESC) AS rn
      FROM o LEFT JOIN last l ON l.detail_id = o.o_orderkey)
SELECT id, d AS "useDate", name, price, d AS "registDate", judged AS "importJudgeDate", sent AS "importDate", n AS stored_rows
FROM s WHERE rn > n * 3 // 4 AND rn <= n * 3 // 4 + 50""",
    "stream_latest_update": f"""
WITH {_HISTORY}, m AS (SELECT max(id) // 2 AS half FROM h),
late AS (SELECT count(DISTINCT job_label) AS c FROM h, m WHERE id > half),
early AS (SELECT count(DISTINCT job_label) AS c FROM h, m
          WHERE id <= half AND job_label NOT IN (SELECT job_label FROM h, m WHERE id > half))
SELECT job_label, max(id) AS run_id, arg_max(parsed_entry_num, id) AS parsed_entry_num,
       arg_max(new_entry_num, id) AS new_entry_num, CAST((SELECT late.c + early.c FROM late, early) AS BIGINT) AS changes
FROM h GROUP BY job_label""",
    "import_manifest_e2e": f"""
WITH r AS ({_STORED}), {_LEDGER_TEXT},
f AS (SELECT count(DISTINCT (yr, b)) + count(DISTINCT yr) AS n FROM t)
SELECT kind, date, name, amount, CAST((SELECT ceil(n / 4.0) FROM f) AS BIGINT) AS runs FROM r""",
})
