"""DuckDB SQL equivalents of the registered queries (same column names and types).

Conventions shared with the Spark side: doubles rounded to 6 decimals; the
fold/split hash is md5(salt || ':' || key text) -> first 8 hex digits as an
unsigned integer; log1p(x) is written ln(1 + x).
"""
from __future__ import annotations


def h32(salt: str, key_sql: str) -> str:
    """SQL for the package's 32-bit key hash."""
    return f"(('0x' || substr(md5('{salt}:' || {key_sql}), 1, 8))::BIGINT)"


LI_KEY_TXT = "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)"

LI_PARTS = """
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_brand, p.p_type,
         ln(1 + l.l_extendedprice) AS y
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""


def _oof_block(col: str, smoothing: float = 5.0) -> str:
    return f"""
  s_{col} AS (SELECT coalesce({col}, 'Missing') AS cat, fold, sum(y) AS s, count(y) AS n
              FROM base GROUP BY 1, 2),
  t_{col} AS (SELECT cat, sum(s) AS s_all, sum(n) AS n_all FROM s_{col} GROUP BY cat),
  o_{col} AS (SELECT s.cat, s.fold,
                     CASE WHEN t.n_all - s.n = 0 THEN g.gm
                          ELSE (t.s_all - s.s + {smoothing} * g.gm) / (t.n_all - s.n + {smoothing}) END AS te
              FROM s_{col} s JOIN t_{col} t USING (cat) CROSS JOIN gm g)"""


OOF_WITH = f"""
WITH base AS (
  SELECT *, CAST({h32('fold', LI_KEY_TXT)} % 5 AS INTEGER) AS fold FROM ({LI_PARTS})
),
gm AS (SELECT avg(y) AS gm FROM base),
{_oof_block('p_brand')},
{_oof_block('p_type')}"""

OOF_FROM = """
FROM base b CROSS JOIN gm g
LEFT JOIN o_p_brand ob ON coalesce(b.p_brand, 'Missing') = ob.cat AND b.fold = ob.fold
LEFT JOIN o_p_type ot ON coalesce(b.p_type, 'Missing') = ot.cat AND b.fold = ot.fold
"""

OOF_SQL = OOF_WITH + """
SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, b.p_brand, b.p_type, b.fold,
       round(b.y, 6) AS y,
       round(coalesce(ob.te, g.gm), 6) AS p_brand_te,
       round(coalesce(ot.te, g.gm), 6) AS p_type_te""" + OOF_FROM


# The experiment-shaped projection of orders x customer (same values as
# bindings.experiments_from_orders; numbers are produced as text there and parsed
# by the sanitiser, so only their parsed values need to agree).
EXPERIMENTS_SQL = """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS Paper_ID, c_mktsegment AS Channel,
  split_part(o_orderpriority, '-', -1) AS Solvent,
  CAST(o_totalprice / 10000.0 AS VARCHAR) AS Concentration_mg_ml,
  CASE o_orderstatus WHEN 'O' THEN 'spin_coat' WHEN 'F' THEN 'Drop casting' ELSE 'N/A' END AS Process,
  CAST(o_custkey * 10 AS VARCHAR) AS Spin_RPM,
  CAST(dayofyear(o_orderdate) AS VARCHAR) AS Annealing_temp_C,
  CAST(month(o_orderdate) / 4.0 AS VARCHAR) AS Annealing_time_h,
  'ion_' || o_orderstatus AS Ion_type,
  CAST(nullif(c_acctbal / 10000.0, 0.0) AS VARCHAR) AS wt,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(round(o_totalprice / 1e6, 3) AS VARCHAR) ELSE lower(c_mktsegment) END AS polymer,
  CAST(c_nationkey / 10.0 AS VARCHAR) AS Ion_diffusion,
  CAST(dayofmonth(o_orderdate) * 2.5 AS VARCHAR) AS Ion_viscosity,
  CAST(c_nationkey / 100.0 + 0.1 AS VARCHAR) AS Anion_radius,
  CAST(month(o_orderdate) / 40.0 + 0.05 AS VARCHAR) AS Cation_radius,
  '[' || substr(c_mktsegment, 1, 3) || ']+' AS Cation, o_orderstatus || '-' AS Anion,
  CAST(c_acctbal / 2000.0 AS VARCHAR) AS Gate_voltage_V,
  CAST(o_totalprice / 1e6 - 0.2 AS VARCHAR) AS Drain_voltage_V,
  CAST(o_orderkey % 500 + 1 AS VARCHAR) AS Gate_pulse_width_ms,
  CAST(o_custkey % 30 + 1 AS VARCHAR) AS Pulse_number,
  split_part(c_mktsegment, 'I', 1) AS Electrode_type,
  CAST(nullif(c_nationkey - 12, 0) / 4.0 AS VARCHAR) AS Vth_V,
  CAST(o_totalprice * 10 AS VARCHAR) AS On_off_ratio,
  CAST(nullif(o_orderkey % 9, 0) / 3.0 AS VARCHAR) AS Vth_window_V,
  '25' AS Operating_temp_C,
  CAST(o_totalprice / 100.0 - 50.0 AS VARCHAR) AS Tau_ms
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""
