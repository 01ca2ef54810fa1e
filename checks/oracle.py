"""The same results as plain SQL on the driver's tables, in closed form: no replay of commits."""

from __future__ import annotations

from .data import FIRST_SEGMENTS, NEXT_RUN_TS, RUN_TS, TABLES

SPACE = r"\t\n\x0B\f\r "  # what white space means in the patterns of the Spark side
WIDE = "DECIMAL(38,2)"

_first = ", ".join(f"'{s}'" for s in FIRST_SEGMENTS)

CUSTOMERS = f"""
base AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS country, c_mktsegment AS segment,
         CAST(coalesce(o.n, 0) AS INTEGER) AS orders0, CAST(c_acctbal AS DECIMAL(10,2)) AS spent0
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
         ON o.o_custkey = c_custkey),
tiered AS (
  SELECT *, segment IN ({_first}) AS early,
         CASE WHEN spent0 > 500 THEN 'platinum' WHEN spent0 BETWEEN 200 AND 500 THEN 'gold'
              ELSE 'silver' END AS tier
  FROM base),
final AS (
  SELECT id, name, country, segment, early, tier AS customer_tier, spent0, orders0,
         CASE WHEN tier <> 'silver' THEN orders0 + 1 ELSE orders0 END AS total_orders,
         CASE WHEN tier <> 'silver' THEN CAST(spent0 * 1.1 AS DECIMAL(10,2)) ELSE spent0 END
           AS total_spent
  FROM tiered)"""

# The table that was created from rows and had its negative totals set to zero.
CREATED = f"""
{CUSTOMERS.strip()},
created AS (
  SELECT id, name, country, spent0,
         CASE WHEN spent0 < 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE spent0 END AS spent1
  FROM base)"""

COMMITS = f"""
{CUSTOMERS.strip()},
counts AS (
  SELECT count(*) AS n, count(*) FILTER (early) AS n_early,
         count(*) FILTER (customer_tier = 'platinum') AS n_platinum,
         count(*) FILTER (customer_tier = 'gold') AS n_gold,
         count(*) FILTER (customer_tier = 'silver') AS n_silver
  FROM final),
commits AS (
  SELECT seq, TIMESTAMP '2024-01-01 00:00:00' + seq * INTERVAL 1 HOUR AS committed_at,
         CASE WHEN seq <= 3 THEN 'append' ELSE 'overwrite' END AS operation,
         CASE seq WHEN 1 THEN 0 WHEN 2 THEN n_early WHEN 3 THEN n - n_early WHEN 4 THEN n_platinum
                  WHEN 5 THEN n_gold WHEN 6 THEN n_silver ELSE n_platinum + n_gold END AS touched,
         CASE seq WHEN 1 THEN 0 WHEN 2 THEN n_early ELSE n END AS total
  FROM counts, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS seq))"""

_clean = f"regexp_replace({{0}}, '[^a-zA-Z{SPACE}]', '', 'g')"
_parts = f"CAST(len(string_split_regex({{0}}, '[{SPACE}]+')) AS INTEGER)"


def _names(id_column: str, name: str, table: str, at: str = RUN_TS) -> str:
    return f"""
SELECT {id_column} AS id, {name} AS original_full_name,
       {_clean.format(name)} AS processed_full_name,
       {_parts.format(name)} AS name_parts_count,
       TIMESTAMP '{at}' AS processing_timestamp
FROM {table}"""


def _bare(text: str) -> str:
    """Array text without brackets and quotes, cut at commas."""
    inner = f"regexp_replace({text}, '^\\[|\\]$', '', 'g')"
    return f"string_split(replace(replace({inner}, '\"', ''), '''', ''), ',')"


_stamp = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_moved = "CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 DAY ELSE ts END"
_part_tags = """CASE WHEN p_size > 40 THEN CAST([] AS VARCHAR[])
            ELSE [p_brand, p_type, p_name] END"""
_said = "'[\"' || role || '\", ''' || text || ''']'"
_segments = "SELECT DISTINCT c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

def _event_steps(ts: str) -> str:
    over = "OVER (ORDER BY ts NULLS FIRST, event_id)"
    return f"""
        SELECT event_id, ts, event_type, CAST(value AS {WIDE}) AS value, row_number() {over} AS place,
               CAST(coalesce(lag(value) {over}, 0) AS {WIDE}) AS value_before, lag(event_type) {over} AS type_before,
               CAST(sum(value) {over} AS {WIDE}) AS total
        FROM (SELECT event_id, {ts} AS ts, event_type, CAST(value AS DECIMAL(18,4)) AS value FROM events)"""


_price = "CAST(o_totalprice AS DECIMAL(15,2))"
_urgent = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
_versions = (
    (1, 0, _price, "false", "true"),
    (2, 0, f"{_price} + 1", "false", "o_orderstatus = 'O'"),
    (2, 1, f"{_price} + 100", "false", "o_orderstatus = 'O'"),
    (2, 0, _price, "true", _urgent),
    (3, 0, "1", "false", f"{_urgent} AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'"),
    (3, 0, _price, "true", "o_orderstatus = 'P'"),
)
_union = " UNION ALL ".join(
    f"SELECT o_orderkey, o_custkey, o_orderstatus, {c} AS commit_id, {s} AS sequence, "
    f"CAST({p} AS DECIMAL(15,2)) AS price, {d} AS deleted FROM orders WHERE {w}"
    for c, s, p, d, w in _versions
)
LOG = f"log AS ({_union})"


def _state(until: int, name: str = "state") -> str:
    return f"""{name} AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CAST(price AS {WIDE}) AS price FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY commit_id DESC, sequence DESC) AS age
    FROM log WHERE commit_id <= {until}) WHERE age = 1 AND NOT deleted)"""


BRANCH = f"""{_state(2, "base")},
branch AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'B' END AS o_orderstatus,
         CAST(CASE WHEN o_orderstatus = 'O' THEN price ELSE price * 2 END AS {WIDE}) AS price
  FROM base WHERE o_orderstatus <> 'P'
  UNION ALL SELECT -c_custkey - 1, c_custkey, 'N', CAST(c_acctbal AS {WIDE}) FROM customer)"""

_line = "CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR)"

ORACLE: dict[str, str] = {
    # small features
    "formats_detected": "SELECT c.*, f.format FROM customer c, (SELECT unnest(['parquet', 'json', 'orc', 'csv']) AS format) f",
    "src_schema_file": "SELECT o.*, k.schema_kind FROM orders o, (SELECT unnest(['ddl', 'json']) AS schema_kind) k",
    "gzip_files": "SELECT *, TRUE AS is_gzip FROM customer",
    "strict_old_schema": f"""
        WITH {CUSTOMERS.strip()}
        SELECT id, name, country, segment, orders0 AS total_orders, CAST(spent0 AS {WIDE}) AS total_spent FROM final""",
    "seeded_once": f"""
        WITH {CUSTOMERS.strip()}
        SELECT id, name, country, segment, orders0 AS total_orders, CAST(spent0 AS {WIDE}) AS total_spent FROM final""",
    "branch_dropped": "SELECT *, 1 AS branches FROM part",
    "names_stamped_now": f"""
        SELECT p_partkey AS id, {_clean.format("p_name")} AS processed_full_name, TRUE AS is_now FROM part""",
    # one order over whole tables
    "order_numbers": """
        SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place,
               row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS from_end
        FROM orders""",
    "event_running": _event_steps("ts"),
    "event_running_tied": _event_steps("CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN ts END"),
    "nation_names": """
        SELECT c_nationkey, string_agg(c_name, '; ' ORDER BY c_acctbal, c_custkey) AS names
        FROM customer GROUP BY c_nationkey""",
    "customer_first_last": """
        SELECT o_custkey,
               first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_o_orderkey,
               first(o_orderdate ORDER BY o_orderdate, o_orderkey) AS first_o_orderdate,
               first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS first_o_totalprice,
               last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_o_orderkey,
               last(o_orderdate ORDER BY o_orderdate, o_orderkey) AS last_o_orderdate,
               last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS last_o_totalprice
        FROM orders GROUP BY o_custkey""",
    # a table as a log of row versions
    **{
        name: f"WITH {LOG}, {_state(until)} SELECT * FROM state"
        for name, until in (
            ("log_version_1", 1), ("log_version_2", 2), ("log_current", 3), ("log_time_between", 2), ("log_time_exact", 3)
        )
    },
    "log_totals": f"WITH {LOG}, {_state(1, 's1')}, {_state(2, 's2')}, {_state(3, 's3')} " + " UNION ALL ".join(
        f"SELECT {i} AS commit_id, count(*) AS total_rows, CAST(sum(price) AS {WIDE}) AS total_price FROM s{i}" for i in (1, 2, 3)
    ),
    "branch_overlay": f"WITH {LOG}, {BRANCH} SELECT * FROM branch",
    "branch_differences": f"""
        WITH {LOG}, {_state(3)}, {BRANCH}
        SELECT o_orderkey, CASE WHEN s.price IS NULL THEN 'added' WHEN b.price IS NULL THEN 'removed'
                 WHEN s.o_orderstatus <> b.o_orderstatus OR s.price <> b.price THEN 'changed' ELSE 'same' END AS status,
               CASE WHEN s.o_orderstatus <> b.o_orderstatus OR s.price <> b.price THEN concat_ws(',',
                 CASE WHEN s.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END,
                 CASE WHEN s.price <> b.price THEN 'price' END) END AS changed_columns,
               s.price AS price_main, b.price AS price_branch
        FROM state s FULL JOIN branch b USING (o_orderkey)""",
    "update_chain": f"""
        WITH {CUSTOMERS.strip()}
        SELECT id, name, country, segment, total_orders, CAST(total_spent AS {WIDE}) AS total_spent, customer_tier,
               CASE customer_tier WHEN 'platinum' THEN '1,4' WHEN 'gold' THEN '2,4' ELSE '3' END AS hits
        FROM final""",
    # files with other headers, rescued values, loads run again
    "migrate_csv_headers": f"""
        SELECT p_partkey AS id, p_name AS full_name,
               CASE WHEN p_name < 'q' THEN split_part(p_name, ' ', 1) END AS first_name,
               split_part(p_name, ' ', 2) AS last_name, TIMESTAMP '{RUN_TS}' AS processed_date,
               'legacy_migration' AS source_system
        FROM part""",
    "rescue_values": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
               {_line} || CASE WHEN l_returnflag = 'R' THEN ' pcs' ELSE '' END AS l_quantity,
               CASE WHEN l_linestatus = 'O' THEN 'soon' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS l_shipdate,
               l_returnflag, 1 + CAST(l_returnflag = 'R' AS INTEGER) + CAST(l_linestatus = 'O' AS INTEGER) AS n_rescued
        FROM lineitem""",
    "quarantine_rows": f"""
        SELECT l_returnflag = 'R' OR l_linestatus = 'O' AS quarantined, l_orderkey, l_linenumber,
               CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS {WIDE}) END AS l_quantity,
               CASE WHEN l_linestatus <> 'O' THEN CAST(l_shipdate AS DATE) END AS l_shipdate
        FROM lineitem""",
    "load_once_again": """
        SELECT *, 'first' AS load_key FROM events UNION ALL SELECT *, 'second' AS load_key FROM events""",
    # sources
    "src_csv_infer": "SELECT * FROM customer",
    "src_csv_schema": "SELECT * FROM orders",
    "src_csv_complex": f"""
        SELECT p_partkey AS id, p_name AS name,
               CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_retailprice END AS score,
               array_to_string({_part_tags}, '|') AS tags,
               CAST(len({_part_tags}) AS INTEGER) AS n_tags, TRUE AS missing_is_null
        FROM part""",
    "src_parquet": "SELECT * FROM lineitem",
    "src_json": "SELECT * REPLACE (strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts) FROM events",
    "src_orc": "SELECT * FROM lineitem",
    "scan_table": "SELECT * FROM part",
    "conform_schema": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
               CAST(o_orderdate AS DATE) AS o_orderdate, TRUE AS note_is_null
        FROM orders""",
    "conform_array_text": f"""
        SELECT conv_id, turn, array_to_string({_bare(_said)}, '|') AS tags,
               CAST(len({_bare(_said)}) AS INTEGER) AS n_tags
        FROM conversations""",
    **dict.fromkeys(("migrate_dir", "migrate_dir_csv", "migrate_dir_parquet"), f"""
        SELECT p_partkey AS id, p_name AS full_name, split_part(p_name, ' ', 1) AS first_name,
               split_part(p_name, ' ', 2) AS last_name, TIMESTAMP '{RUN_TS}' AS processed_date,
               'legacy_migration' AS source_system
        FROM part"""),
    # sinks and DDL
    "register_table": "SELECT * FROM orders",
    "append_twice": f"{_names('p_partkey', 'p_name', 'part')} UNION ALL {_names('p_partkey', 'p_name', 'part')}",
    "append_plain": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "overwrite_partitions": """
        SELECT event_id, event_type, value, CAST(ts AS DATE) AS day FROM events
        WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
        UNION ALL
        SELECT event_id, event_type, value + 1, CAST(ts AS DATE) FROM events
        WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' AND event_type <> 'error'""",
    "partition_days": f"SELECT * REPLACE ({_moved} AS ts) FROM events",
    "time_range": f"""
        SELECT * FROM (SELECT * REPLACE ({_moved} AS ts) FROM events)
        WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""",
    "partition_months": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate_month,
               count(*) AS record_count
        FROM orders GROUP BY 1""",
    "table_partitions": f"""
        SELECT CAST({_moved} AS DATE) AS ts_day, count(*) AS record_count FROM events GROUP BY 1""",
    "describe_table": " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS data_type, "
        f"count({name}) AS filled FROM orders"
        for i, (name, kind) in enumerate(
            [
                ("o_orderkey", "bigint"),
                ("o_custkey", "bigint"),
                ("o_orderstatus", "string"),
                ("o_totalprice", "double"),
                ("o_orderdate", "timestamp_ntz"),
                ("o_orderpriority", "string"),
            ],
            start=1,
        )
    ),
    "show_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS record_count, "
        f"CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS INTEGER) AS column_count"
        for t in TABLES
    ),
    "verify_table": """
        SELECT 'customer_registered' AS table_name, count(*) AS record_count, 5 AS column_count
        FROM customer""",
    "preview": """
        SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part ORDER BY p_partkey LIMIT 5""",
    # pipelines
    "ip_sum": _names("p_partkey", "p_name", "part"),
    "ip_sum_documents": _names("doc_id", "text", "documents"),
    "ip_sum_table": f"""
        SELECT *, CAST(processing_timestamp AS DATE) AS processing_timestamp_day
        FROM ({_names("doc_id", "text", "documents")} UNION ALL
              {_names("doc_id", "text", "documents", NEXT_RUN_TS)})""",
    "quality_score": f"""
        SELECT *, 'v1.0' AS pipeline_version,
               CASE WHEN length(original_full_name) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                 AS data_quality_score
        FROM ({_names('conv_id', 'text', 'conversations')})""",
    # time travel
    "totals_as_of": f"""
        WITH {CUSTOMERS}
        SELECT CAST(1 AS BIGINT) AS snapshot_id, CAST(0 AS BIGINT) AS historical_count,
               CAST(0 AS {WIDE}) AS historical_revenue
        UNION ALL
        SELECT 2, count(*), CAST(coalesce(sum(spent0), 0) AS {WIDE}) FROM final WHERE early
        UNION ALL
        SELECT 5, count(*), CAST(coalesce(sum(spent0), 0) AS {WIDE}) FROM final""",
    "totals_all_snapshots": f"""
        WITH {COMMITS}
        SELECT CAST(seq AS BIGINT) AS snapshot_id, CAST(total AS BIGINT) AS row_count,
               CAST(CASE seq WHEN 1 THEN 0
                    WHEN 2 THEN (SELECT coalesce(sum(spent0), 0) FROM final WHERE early)
                    WHEN 7 THEN (SELECT sum(total_spent) FROM final)
                    ELSE (SELECT sum(spent0) FROM final) END AS {WIDE}) AS total
        FROM commits""",
    "rows_at_timestamp": f"""
        WITH {CUSTOMERS}
        SELECT id, name, country, segment, orders0 AS total_orders,
               CAST(spent0 AS {WIDE}) AS total_spent,
               CASE WHEN customer_tier = 'silver' THEN NULL ELSE customer_tier END AS customer_tier
        FROM final""",
    "first_snapshot_rows": f"""
        WITH {CREATED}
        SELECT id, name, country, CAST(spent0 AS {WIDE}) AS total_spent,
               'First Snapshot - The Beginning' AS time_context
        FROM created""",
    "current_topk": f"""
        WITH {CUSTOMERS}
        SELECT id, name, country, CAST(total_spent AS {WIDE}) AS total_spent, customer_tier,
               'Current Data' AS time_context
        FROM final ORDER BY total_spent DESC, id LIMIT 10""",
    "cross_first_commit": f"""
        WITH {CUSTOMERS}
        SELECT id, name, country, segment, total_orders, CAST(total_spent AS {WIDE}) AS total_spent,
               customer_tier, TIMESTAMP '2024-01-01 01:00:00' AS first_snapshot_time,
               'Data from earliest state' AS context
        FROM final""",
    "assign_tiers": f"""
        WITH {CUSTOMERS}
        SELECT id, orders0 AS total_orders, CAST(spent0 AS {WIDE}) AS total_spent, customer_tier
        FROM final""",
    "apply_promo": f"""
        WITH {CUSTOMERS}
        SELECT id, total_orders, CAST(total_spent AS {WIDE}) AS total_spent, customer_tier
        FROM final""",
    **dict.fromkeys(
        ("update_merged", "update_rewritten"),
        """
        SELECT * EXCLUDE (late)
               REPLACE (CASE WHEN late THEN 0 ELSE l_discount END AS l_discount,
                        CASE WHEN late THEN 'X' ELSE l_linestatus END AS l_linestatus)
        FROM (SELECT *, l_shipdate >= TIMESTAMP '2000-06-15 00:00:00' AND l_returnflag = 'R' AS late
              FROM lineitem)""",
    ),
    "schema_evolution_counts": f"""
        WITH {CUSTOMERS}
        SELECT 'Old Snapshot (no customer_tier)' AS data_source, CAST(0 AS BIGINT) AS customers,
               CAST(0 AS BIGINT) AS customers_with_tier
        UNION ALL
        SELECT 'Current Data (with customer_tier)', count(*), count(customer_tier) FROM final""",
    "evolution_3": f"""
        WITH {CUSTOMERS},
        periods AS (
          SELECT 'Early Days' AS period, CAST(0 AS BIGINT) AS customers, CAST(NULL AS {WIDE}) AS revenue
          UNION ALL SELECT 'Growth Phase', count(*), sum(spent0) FROM final
          UNION ALL SELECT 'Current State', count(*), sum(total_spent) FROM final)
        SELECT period, customers, CAST(round(revenue, 2) AS {WIDE}) AS revenue,
               customers - lag(customers) OVER (ORDER BY period) AS customer_growth,
               CAST(round(revenue - lag(revenue) OVER (ORDER BY period), 2) AS {WIDE}) AS revenue_growth
        FROM periods""",
    "first_vs_current": f"""
        WITH {CREATED},
        states AS (
          SELECT 'Initial State' AS data_state, count(*) AS customer_count, sum(spent0) AS total_revenue
          FROM created
          UNION ALL SELECT 'Current State', count(*), sum(spent1) FROM created)
        SELECT data_state, customer_count, CAST(round(total_revenue, 2) AS {WIDE}) AS total_revenue,
               customer_count - lag(customer_count) OVER (ORDER BY data_state) AS customer_growth,
               CAST(total_revenue - lag(total_revenue) OVER (ORDER BY data_state) AS {WIDE})
                 AS revenue_growth
        FROM states""",
    "branch_vs_snapshot": f"""
        WITH {CREATED}
        SELECT 'main branch' AS source, count(*) AS customers,
               CAST(round(sum(spent1), 2) AS {WIDE}) AS revenue FROM created
        UNION ALL
        SELECT 'early snapshot', count(*), CAST(round(sum(spent0), 2) AS {WIDE}) FROM created""",
    "revenue_growth": f"""
        WITH {CREATED}
        SELECT CAST(sum(spent1) AS {WIDE}) AS current_revenue,
               CAST(sum(spent0) AS {WIDE}) AS historical_revenue,
               CAST(sum(spent1) - sum(spent0) AS {WIDE}) AS growth
        FROM created""",
    "snapshot_history": f"""
        WITH {COMMITS}
        SELECT CAST(row_number() OVER (ORDER BY committed_at) AS INTEGER) AS snapshot_number,
               CAST(seq AS BIGINT) AS snapshot_id, committed_at, operation,
               CAST(total AS BIGINT) AS record_count
        FROM commits""",
    "snapshot_timeline": f"""
        WITH {COMMITS}
        SELECT CAST(seq AS BIGINT) AS snapshot_id, committed_at, operation,
               CASE seq WHEN 1 THEN 'Initial Data' WHEN 7 THEN 'Latest Data'
                        ELSE 'Historical Point' END AS snapshot_type,
               CAST(CASE WHEN seq <= 3 THEN touched ELSE 0 END AS BIGINT) AS added_records,
               CAST(CASE WHEN seq > 3 THEN touched ELSE 0 END AS BIGINT) AS changed_records,
               CAST(total AS BIGINT) AS total_records
        FROM commits""",
    "table_history": f"""
        WITH {COMMITS}
        SELECT CAST(seq AS BIGINT) AS snapshot_id, committed_at AS made_current_at,
               CAST(total AS BIGINT) AS record_count
        FROM commits""",
    "latest_commit": f"""
        WITH {COMMITS}
        SELECT CAST(seq AS BIGINT) AS snapshot_id, committed_at, operation,
               CAST(total AS BIGINT) AS record_count
        FROM commits ORDER BY committed_at DESC LIMIT 1""",
    "tt_overview": f"""
        WITH {COMMITS}
        SELECT CAST(seq AS INTEGER) AS snapshot_number, CAST(seq AS VARCHAR) AS snapshot_id,
               committed_at AS timestamp, operation,
               CASE seq WHEN 1 THEN 'Table Creation (empty)'
                        WHEN 2 THEN 'Initial Data (' || total || ' customers)'
                        WHEN 3 THEN 'More Customers (' || total || ' total)'
                        WHEN 4 THEN 'Schema Evolution (customer_tier added)'
                        ELSE 'Customer Updates/Promotions' END AS what_happened,
               CAST(total AS BIGINT) AS approx_customers,
               'Use as_of(timestamp=''' || {_stamp.format('committed_at')} || ''')' AS time_travel_syntax
        FROM commits""",
    "timepoints": f"""
        WITH {COMMITS}
        SELECT CAST(seq AS INTEGER) AS n, {_stamp.format('committed_at')} AS timepoint,
               '#' || seq || ' - ' || {_stamp.format('committed_at')} || ' (' || operation || ')' AS label
        FROM commits""",
    "ops_histogram": f"""
        WITH {COMMITS}
        SELECT operation, count(*) AS operation_count, 
               CAST(sum(CASE WHEN seq <= 3 THEN touched ELSE 0 END) AS BIGINT) AS records_added,
               CAST(sum(CASE WHEN seq > 3 THEN touched ELSE 0 END) AS BIGINT) AS records_changed
        FROM commits GROUP BY operation""",
    "readiness": """
        SELECT count(*) AS customers, count(*) > 0 AS has_customers, TRUE AS has_history,
               TRUE AS has_tier_column, count(*) > 0 AS ready
        FROM customer""",
    # branches
    "main_totals": f"""
        WITH {CUSTOMERS}
        SELECT 'main' AS branch_name, count(*) AS customers,
               CAST(round(sum(total_spent), 2) AS {WIDE}) AS total_revenue,
               'Production Data' AS description
        FROM final""",
    "main_count": "SELECT count(*) AS product_count FROM part",
    "branch_count": """
        SELECT 2 * count(*) AS product_count FROM part""",
    "branch_compare": """
        SELECT 'main' AS branch_name, count(*) AS product_count, 'Production Branch' AS description
        FROM part
        UNION ALL
        SELECT 'dev', 2 * count(*),
               'Development Branch (Spark-created)'
        FROM part""",
    "branch_lookup": f"""
        SELECT -1 - p_partkey AS id, p_name AS name, p_type AS category,
               CAST(p_retailprice AS {WIDE}) AS price
        FROM part WHERE p_partkey = 0""",
    "tag_totals": f"""
        SELECT count(*) AS products, CAST(sum(CAST(p_retailprice AS DECIMAL(10,2))) AS {WIDE}) AS total_price
        FROM part""",
    "refs_list": """
        SELECT 'dev' AS branch_or_tag_name, 'BRANCH' AS type, CAST(3 AS BIGINT) AS snapshot_id,
               2 * count(*) AS record_count FROM part
        UNION ALL SELECT 'main', 'BRANCH', 2, count(*) FROM part
        UNION ALL SELECT 'v1_0_0', 'TAG', 2, count(*) FROM part""",
    # files and business summaries
    "file_summary": """
        SELECT 'PARQUET' AS file_format, count(*) AS total_records, TRUE AS has_files,
               TRUE AS has_size
        FROM customer""",
    "evolution_summary": """
        SELECT 3 AS total_snapshots, 2 AS branches, count(*) > 0 AS has_files,
               count(*) > 0 AS has_bytes
        FROM part""",
    "count_by_tier": f"""
        WITH {CUSTOMERS}
        SELECT customer_tier, count(*) AS count FROM final GROUP BY customer_tier""",
    "revenue_by_country": f"""
        WITH {CUSTOMERS}
        SELECT country, CAST(round(sum(total_spent), 2) AS {WIDE}) AS revenue
        FROM final GROUP BY country""",
    "grand_totals": f"""
        WITH {CUSTOMERS}
        SELECT count(*) AS customers, CAST(round(sum(total_spent), 2) AS {WIDE}) AS total_revenue
        FROM final""",
    "inventory": f"""
        WITH listing AS ({_segments})
        SELECT 'Available Catalogs' AS resource_type, count(DISTINCT r_name) AS count,
               string_agg(DISTINCT r_name, ', ' ORDER BY r_name) AS available_items
        FROM listing WHERE r_name NOT IN ('system', 'tpcds', 'tpch', 'jmx', 'memory')
        UNION ALL
        SELECT 'Schemas in ASIA', count(DISTINCT c_mktsegment),
               string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment)
        FROM listing WHERE r_name = 'ASIA'
        UNION ALL
        SELECT 'Tables in ASIA.' || c_mktsegment, count(DISTINCT n_name),
               string_agg(DISTINCT n_name, ', ' ORDER BY n_name)
        FROM listing WHERE r_name = 'ASIA' GROUP BY c_mktsegment""",
}
