"""Versioned tables, point-in-time reads and export."""

from oracles.base import AS_OF, TYPE_ID, statement, status_case

ORACLES: dict[str, str] = {}

_MERGE = "TIMESTAMP '2024-02-03'"
_E = TYPE_ID.replace("event_type", "e.event_type")
_BATCH = f"""(SELECT s.series_id, e.ts, CASE WHEN e.event_type = 'error' THEN e.value * 1.1::DOUBLE ELSE e.value END AS value,
    CAST(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS SMALLINT) AS quality_code
  FROM events e, LATERAL (SELECT CAST({_E} AS INTEGER) AS series_id UNION ALL SELECT CAST(100000 + e.user_id AS INTEGER)) s WHERE e.ts >= TIMESTAMP '2024-01-10')"""
_CHANGED = "(b.ts IS NOT NULL AND h.is_current AND (b.value IS DISTINCT FROM h.value OR b.quality_code IS DISTINCT FROM h.quality_code))"
_MERGED = f"""(SELECT h.series_id, h.ts, h.value, h.quality_code, h.valid_from, CASE WHEN {_CHANGED} THEN {_MERGE} ELSE h.valid_to END AS valid_to,
    CASE WHEN {_CHANGED} THEN false ELSE h.is_current END AS is_current, CASE WHEN {_CHANGED} THEN 'closed' ELSE 'kept' END AS action
  FROM history h LEFT JOIN {_BATCH} b ON b.series_id = h.series_id AND b.ts = h.ts
  UNION ALL SELECT b.series_id, b.ts, b.value, b.quality_code, {_MERGE}, NULL, true, 'inserted' FROM {_BATCH} b
  LEFT JOIN history h ON h.series_id = b.series_id AND h.ts = b.ts AND h.is_current WHERE h.ts IS NULL OR {_CHANGED})"""
ORACLES["scd2_merge"] = statement("history", f"SELECT * REPLACE (round(value, 6) AS value) FROM {_MERGED}")
ORACLES["scd2_counts"] = statement("history", f"""
SELECT inserted, updated, greatest(n - inserted - updated, 0) AS unchanged, n - inserted AS unchanged_exact FROM (
  SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'closed') AS updated, (SELECT count(*) FROM {_BATCH}) AS n FROM {_MERGED})""")
_AT = "valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15 12:00:00' < valid_to)"
ORACLES["as_of_snapshot"] = statement("history", f"""
SELECT * REPLACE (round(value, 6) AS value) FROM history WHERE {_AT} AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-15'""")
ORACLES["points_at_time"] = statement("history", f"""
SELECT series_id, ts, round(value, 6) AS value, quality_code, valid_from, valid_to FROM history WHERE {_AT}""")
ORACLES["current_snapshot"] = statement("history", "SELECT series_id, ts, value, valid_from FROM history WHERE is_current")
ORACLES["value_history"] = statement("history", """
SELECT * REPLACE (round(value, 6) AS value) FROM history WHERE (series_id, ts) IN (SELECT (series_id, ts) FROM history WHERE NOT is_current)""")
ORACLES["changes_summary"] = statement("history", """
SELECT series_id, count(DISTINCT ts) AS total_datapoints, count(*) AS total_versions, count(*) - count(DISTINCT ts) AS total_changes,
  count(*) FILTER (NOT is_current) AS historical_versions FROM history
WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' GROUP BY series_id""")

_INSTANTS = f"""(SELECT r.id AS round_id, r.created_at, r.start_time, r.end_time, coalesce(s.done, {AS_OF}) AS eval_time
  FROM rounds r LEFT JOIN (SELECT round_id, max(calculated_at) AS done FROM scores WHERE final_evaluation GROUP BY round_id) s ON s.round_id = r.id)"""
_CONTEXT = f"""(SELECT p.round_id, p.series_id, p.challenge_series_name, h.ts, h.value FROM pseudo p JOIN {_INSTANTS} i ON i.round_id = p.round_id
  JOIN history h ON h.series_id = p.series_id AND h.ts < i.start_time AND h.valid_from <= i.created_at AND (h.valid_to IS NULL OR i.created_at < h.valid_to))"""
_ACTUALS = f"""(SELECT p.round_id, p.series_id, p.challenge_series_name, h.ts, h.value FROM pseudo p JOIN {_INSTANTS} i ON i.round_id = p.round_id
  JOIN history h ON h.series_id = p.series_id AND h.ts >= i.start_time AND h.ts <= i.end_time AND h.valid_from <= i.eval_time
    AND (h.valid_to IS NULL OR i.eval_time < h.valid_to))"""
_FORECASTS = """(SELECT p.round_id, p.series_id, p.challenge_series_name, m.readable_id, f.ts, f.predicted_value AS value, f.q_low, f.q_high
  FROM forecasts f JOIN pseudo p ON p.round_id = f.round_id AND p.series_id = f.series_id JOIN models m ON m.id = f.model_id)"""
ORACLES["round_instants"] = statement("rounds scores", f"SELECT * FROM {_INSTANTS}")
ORACLES["round_context"] = statement("pseudo rounds scores history", f"""
SELECT round_id, series_id, challenge_series_name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 6) AS total
FROM {_CONTEXT} GROUP BY ALL""")
ORACLES["points_known_at"] = statement("pseudo rounds scores history", f"""
SELECT p.round_id, p.series_id, m.kind, count(*) AS n, max(h.ts) AS last_ts, round(sum(h.value), 6) AS total
FROM pseudo p JOIN {_INSTANTS} i ON i.round_id = p.round_id, LATERAL (VALUES ('created_at', i.created_at), ('start_time', i.start_time),
  ('end_time', i.end_time), ('eval_time', i.eval_time)) m(kind, moment)
JOIN history h ON h.series_id = p.series_id AND h.valid_from <= m.moment AND (h.valid_to IS NULL OR m.moment < h.valid_to)
GROUP BY p.round_id, p.series_id, m.kind""")
ORACLES["round_actuals"] = statement("pseudo rounds scores history", f"SELECT * REPLACE (round(value, 6) AS value) FROM {_ACTUALS}")
ORACLES["round_forecasts"] = statement("forecasts pseudo models", f"SELECT * REPLACE (round(value, 6) AS value, round(q_low, 6) AS q_low, round(q_high, 6) AS q_high) FROM {_FORECASTS}")
ORACLES["round_complete_data"] = statement("pseudo rounds scores history forecasts models", f"""
SELECT round_id, series_id, coalesce(a.n, 0) AS n_actuals, f.readable_id, f.n_points, f.first_ts, f.last_ts, f.value_sum, f.n_ci, f.ci_sum,
  coalesce(c.n_context, 0) AS n_context, c.context_last
FROM (SELECT round_id, series_id, readable_id, CAST(count(*) AS INTEGER) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts,
    round(sum(value), 6) AS value_sum, CAST(count(q_high) AS INTEGER) AS n_ci, round(coalesce(sum(q_high), 0), 6) AS ci_sum FROM {_FORECASTS} GROUP BY round_id, series_id, readable_id) f
FULL JOIN (SELECT round_id, series_id, CAST(count(*) AS INTEGER) AS n FROM {_ACTUALS} GROUP BY round_id, series_id) a
  USING (round_id, series_id)
FULL JOIN (SELECT round_id, series_id, CAST(count(*) AS INTEGER) AS n_context, round(arg_max(value, (ts, value)), 6) AS context_last
  FROM {_CONTEXT} GROUP BY round_id, series_id) c USING (round_id, series_id)""")
_ENDING = "(SELECT * FROM rounds WHERE year(end_time) = 2024 AND month(end_time) = 1)"
ORACLES["export_month"] = statement("pseudo rounds scores history forecasts models", f"""
SELECT id AS round_id, count(*) AS n, round(CAST(sum(definition_id) AS DOUBLE), 6) AS total, 'rounds_metadata' AS dataset FROM {_ENDING} GROUP BY id
UNION ALL SELECT round_id, count(*), round(sum(value), 6), 'context' FROM {_CONTEXT} WHERE round_id IN (SELECT id FROM {_ENDING}) GROUP BY round_id
UNION ALL SELECT round_id, count(*), round(sum(value), 6), 'actuals' FROM {_ACTUALS} WHERE round_id IN (SELECT id FROM {_ENDING}) GROUP BY round_id
UNION ALL SELECT round_id, count(*), round(sum(value), 6), 'forecasts' FROM {_FORECASTS} WHERE round_id IN (SELECT id FROM {_ENDING}) GROUP BY round_id""")

_ASSIGNED = """(SELECT c_nationkey AS definition_id, CAST(c_custkey AS INTEGER) AS series_id, c_acctbal > 0 AS is_required, c_acctbal > 9000 AS is_excluded,
    TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN c_mktsegment = 'MACHINERY' THEN TIMESTAMP '2024-02-01' END AS valid_to,
    c_mktsegment <> 'MACHINERY' AS is_current, c_mktsegment, c_acctbal, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1) AS managed
  FROM customer)"""
_STAYS = "(c_mktsegment <> 'BUILDING' AND is_required = (c_acctbal > 1000))"
_OPENS = f"managed AND c_mktsegment <> 'BUILDING' AND NOT (is_current AND {_STAYS})"
ORACLES["sync_assignments"] = f"""
SELECT definition_id, series_id, is_required, is_excluded, valid_from, CASE WHEN managed AND is_current AND NOT {_STAYS} THEN TIMESTAMP '2024-03-01' ELSE valid_to END AS valid_to,
  CASE WHEN managed AND is_current AND NOT {_STAYS} THEN false ELSE is_current END AS is_current FROM {_ASSIGNED}
UNION ALL SELECT definition_id, series_id, c_acctbal > 1000, false, TIMESTAMP '2024-03-01', NULL, true FROM {_ASSIGNED} WHERE {_OPENS}"""
ORACLES["mark_excluded"] = f"""
SELECT definition_id, series_id, is_required, is_excluded OR c_mktsegment = 'FURNITURE' AS is_excluded, valid_from, valid_to, is_current FROM {_ASSIGNED}"""
