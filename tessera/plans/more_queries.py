"""Registered queries over documents, symbols and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import navigation as n
from ..streaming import streams as st
from .bindings import Facts
from .graph_queries import register

_OCC = """SELECT CAST(l_suppkey AS BIGINT) AS upload_id, l_returnflag AS path, CAST(l_orderkey % 50 AS INT) AS start_line, CAST(l_linenumber * 4 AS INT) AS start_character,
CAST(l_orderkey % 50 AS INT) AS end_line, CAST(l_linenumber * 4 + 3 AS INT) AS end_character, concat('part ', CAST(l_partkey AS STRING)) AS symbol, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS roles FROM {lineitem}"""
_REL = """SELECT concat('part ', CAST(p_partkey AS STRING)) AS source_symbol, concat('part ', CAST(p_partkey * 3 % 1000 AS STRING)) AS target_symbol, p_size % 3 = 0 AS is_definition, p_size % 3 = 1 AS is_reference, p_size % 3 = 2 AS is_implementation FROM {part}"""
_AT = """SELECT CAST(event_id AS BIGINT) AS query_id, CAST(user_id AS BIGINT) AS upload_id, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS path, CAST(event_id % 50 AS INT) AS line, CAST(user_id % 30 AS INT) AS "character" FROM {events}"""
_SYM = "SELECT CAST(s_suppkey AS BIGINT) AS query_id, concat('part ', CAST(s_suppkey AS STRING)) AS symbol FROM {supplier}"
_DEF = "SELECT CAST(o_orderkey AS BIGINT) AS definition_id, CAST(o_custkey % 40 AS BIGINT) AS upload_id, o_orderstatus AS path, CAST(o_orderkey % 100 AS INT) AS from_line, CAST(o_orderkey % 100 + o_custkey % 9 AS INT) AS to_line FROM {orders}"
_REF = "SELECT CAST(event_id AS BIGINT) AS reference_id, CAST(user_id % 40 AS BIGINT) AS upload_id, CASE event_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS path, CAST(event_id % 100 AS INT) AS line FROM {events}"


def _sql(x: Facts, text: str, *tables: str) -> DataFrame:
    return x.spark.sql(text.replace('"character"', "`character`"), **{k: getattr(x, k) for k in tables})


register("n1_occurrence_at", lambda x: n.occurrence_at(_sql(x, _OCC, "lineitem"), _sql(x, _AT, "events")), f"""WITH o AS ({_OCC}), q AS ({_AT}) SELECT query_id, symbol, start_line, start_character FROM (SELECT query_id, symbol, start_line, start_character,
row_number() OVER (PARTITION BY query_id ORDER BY start_line DESC, start_character DESC, end_line, end_character, symbol) AS r FROM q JOIN o USING (upload_id, path) WHERE start_line = line AND start_character <= "character" AND end_character > "character") w WHERE r = 1""")
register("n2_definitions", lambda x: n.locations(_sql(x, _OCC, "lineitem"), _sql(x, _REL, "part"), _sql(x, _SYM, "supplier"), "definitions"), f"""WITH o AS ({_OCC}), l AS ({_REL}), q AS ({_SYM}), g AS (SELECT query_id, symbol FROM q UNION SELECT query_id, target_symbol FROM q JOIN l ON symbol = source_symbol WHERE is_definition)
SELECT DISTINCT query_id, upload_id, path, start_line, start_character, symbol FROM g JOIN o USING (symbol) WHERE roles = 1""")
register("n2_references", lambda x: n.locations(_sql(x, _OCC, "lineitem"), _sql(x, _REL, "part"), _sql(x, _SYM, "supplier"), "references"), f"""WITH o AS ({_OCC}), l AS ({_REL}), q AS ({_SYM}), g AS (SELECT query_id, symbol FROM q UNION SELECT query_id, target_symbol FROM q JOIN l ON symbol = source_symbol WHERE is_reference UNION SELECT query_id, source_symbol FROM q JOIN l ON symbol = target_symbol WHERE is_reference)
SELECT DISTINCT query_id, upload_id, path, start_line, start_character, symbol FROM g JOIN o USING (symbol) WHERE roles = 0""")
register("n2_implementations", lambda x: n.locations(_sql(x, _OCC, "lineitem"), _sql(x, _REL, "part"), _sql(x, _SYM, "supplier"), "implementations"), f"""WITH o AS ({_OCC}), l AS ({_REL}), q AS ({_SYM}), g AS (SELECT DISTINCT query_id, source_symbol AS symbol FROM q JOIN l ON symbol = target_symbol WHERE is_implementation)
SELECT DISTINCT query_id, upload_id, path, start_line, start_character, symbol FROM g JOIN o USING (symbol)""")
register("n4_enclosing", lambda x: n.enclosing(_sql(x, _REF, "events"), _sql(x, _DEF, "orders")), f"""WITH d AS ({_DEF}), q AS ({_REF}) SELECT reference_id, definition_id FROM (SELECT reference_id, definition_id, row_number() OVER (PARTITION BY reference_id ORDER BY from_line DESC, to_line, definition_id DESC) AS r FROM q JOIN d USING (upload_id, path) WHERE from_line <= line AND line <= to_line) w WHERE r = 1""")


_events = lambda x: st.source(x.spark, x.sf_dir, "events")
register("t1_deliveries", lambda x: st.drain(st.first_deliveries(_events(x).withColumn("delivery_id", F.concat_ws(":", "user_id", "event_type")))).select("delivery_id"), "SELECT DISTINCT concat_ws(':', user_id, event_type) AS delivery_id FROM {events}")
register("t5_quota", lambda x: st.drain(st.sliding_quota(_events(x), "user_id"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz")), "SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, count(*) AS n FROM {events}, (SELECT unnest([0, 1, 2, 3]) AS k) o GROUP BY 1, 2")
