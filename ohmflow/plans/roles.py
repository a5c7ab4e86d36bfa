"""SQL twins of the table roles in ``ohmflow.sources.tables`` (for the oracle)."""

IVP = """ivp AS (
  SELECT l_orderkey AS experiment_id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         l_quantity AS current, p_retailprice AS voltage, l_extendedprice AS power, l_shipdate AS timestamp
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""

DIRTY = IVP + """, dirty AS (
  SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE current END AS current, voltage,
         CASE WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN NULL ELSE power END AS power, timestamp
  FROM ivp)"""

READINGS_LI = """rl AS (
  SELECT l_orderkey AS experiment_id, l_linenumber, l_partkey, l_suppkey, l_quantity AS current,
         l_extendedprice AS voltage, l_discount, l_returnflag, l_linestatus, l_shipdate AS timestamp
  FROM lineitem)"""

EXPERIMENTS = """experiments AS (
  SELECT o_orderkey AS id, o_orderpriority AS experiment_name,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'dielectric' WHEN '2' THEN 'leakage'
              WHEN '3' THEN 'normal' WHEN '4' THEN 'abnormal' ELSE 'overload' END AS experiment_type,
         o_custkey AS device_id, o_orderdate AS start_time,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'cancelled' END AS status,
         CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'pending' END AS result,
         o_totalprice AS score, o_orderdate AS created_at
  FROM orders)"""

DEVICES = """devices AS (
  SELECT c_custkey AS id, c_name AS device_serial, c_mktsegment AS device_model,
         c_nationkey AS device_address, c_acctbal AS rated_power,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'retired' WHEN 'MACHINERY' THEN 'maintenance'
              WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN 'broken' ELSE 'normal' END AS status
  FROM customer)"""

FILES = """files AS (
  SELECT doc_id AS id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name, n_chars AS file_size,
         source AS file_type, doc_id * 20 AS experiment_id
  FROM documents)"""

PROFILES = """profiles AS (
  SELECT c_custkey AS id, c_name AS full_name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'admin' WHEN 'BUILDING' THEN 'engineer' ELSE 'viewer' END AS role
  FROM customer)"""


def standards_values() -> str:
    from ..schemas import SEED_STANDARDS
    rows = ", ".join(f"('{c}', '{t}', '{pc}')" for c, _, t, _, pc in SEED_STANDARDS)
    return f"std(standard_code, test_type, pass_criteria) AS (VALUES {rows})"
