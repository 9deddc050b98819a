"""Rounds: status, choice of series, context, listings, forecasts and intake."""

from oracles.base import AS_OF, REGISTRATION_AS_OF, resolution, statement, status_case

ORACLES: dict[str, str] = {}

ORACLES["round_status"] = statement("rounds definitions", f"""
SELECT r.id, r.name, d.name AS definition_name, d.schedule_id AS definition_schedule_id, array_to_string(d.domains, ',') AS definition_domains,
  r.registration_start, r.start_time, r.end_time, {status_case(AS_OF)} AS computed_status,
  CASE WHEN r.is_cancelled THEN 'cancelled' ELSE {status_case(AS_OF)} END AS status
FROM rounds r LEFT JOIN definitions d ON d.id = r.definition_id""")
ORACLES["round_status_registration"] = statement("rounds", f"""
SELECT r.id, {status_case(REGISTRATION_AS_OF)} AS computed_status,
  CASE WHEN r.is_cancelled THEN 'cancelled' ELSE {status_case(REGISTRATION_AS_OF)} END AS status FROM rounds r""")
ORACLES["rounds_created"] = statement("created", """
SELECT id, definition_id, name, registration_start, registration_end, registration_end AS start_time,
  registration_end + to_seconds(horizon_s) AS end_time FROM created""")
ORACLES["eligible_series"] = statement("eligible", "SELECT * FROM eligible")
ORACLES["chosen_series"] = statement("chosen", "SELECT * FROM chosen")
ORACLES["context_snapshot"] = statement("context", "SELECT * REPLACE (round(value, 6) AS value) FROM context")
ORACLES["context_stats"] = statement("context", """
SELECT round_id, series_id, min(ts) AS min_ts, max(ts) AS max_ts, round(avg(value), 6) AS value_avg, round(stddev_samp(value), 6) AS value_std
FROM context GROUP BY round_id, series_id""")
ORACLES["context_range"] = statement("context", """
SELECT round_id, series_id, min(ts) AS min_ts, max(ts) AS max_ts, round(arg_max(value, ts), 6) AS latest_value FROM context GROUP BY round_id, series_id""")
ORACLES["series_pseudonyms"] = statement("pseudo", """
SELECT * REPLACE (round(value_avg, 6) AS value_avg, round(value_std, 6) AS value_std) FROM pseudo""")
ORACLES["nested_context"] = statement("context pseudo", """
SELECT c.round_id, p.challenge_series_name, CAST(count(*) AS INTEGER) AS n_points, min(c.ts) AS first_ts, max(c.ts) AS last_ts,
  round(sum(c.value), 6) AS value_sum
FROM context c JOIN pseudo p ON p.round_id = c.round_id AND p.series_id = c.series_id GROUP BY c.round_id, p.challenge_series_name""")
ORACLES["context_of_rounds"] = statement("context rounds", f"""
SELECT c.* REPLACE (round(c.value, 6) AS value) FROM context c JOIN rounds r ON r.id = c.round_id
WHERE NOT r.is_cancelled AND {status_case(AS_OF)} = 'active'""")
ORACLES["rounds_retimed"] = statement("rounds", "SELECT id, start_time, end_time, is_cancelled FROM rounds")

_META = f"""(SELECT r.id AS round_id, r.definition_id, r.name, CASE WHEN r.is_cancelled THEN 'cancelled' ELSE {status_case(AS_OF)} END AS status,
    {status_case(AS_OF)} AS computed_status, coalesce(k.n, 0) AS n_time_series, coalesce(f.models, 0) AS model_count,
    coalesce(f.n, 0) AS forecast_count, d.domains, coalesce(k.categories, []) AS categories, coalesce(k.subcategories, []) AS subcategories,
    r.registration_start, r.end_time, r.frequency_s, r.horizon_s, r.created_at
  FROM rounds r LEFT JOIN definitions d ON d.id = r.definition_id
  LEFT JOIN (SELECT p.round_id, count(DISTINCT p.series_id) AS n, list_sort(list(DISTINCT c.category) FILTER (c.category IS NOT NULL)) AS categories,
      list_sort(list(DISTINCT c.subcategory) FILTER (c.subcategory IS NOT NULL)) AS subcategories
    FROM pseudo p JOIN series s ON s.series_id = p.series_id LEFT JOIN category c ON c.id = s.category_id GROUP BY p.round_id) k ON k.round_id = r.id
  LEFT JOIN (SELECT round_id, count(DISTINCT model_id) AS models, count(*) AS n FROM forecasts GROUP BY round_id) f ON f.round_id = r.id)"""
_META_NEEDS = "rounds definitions pseudo series category forecasts"
_COLUMNS = "round_id, definition_id, name, status, computed_status, n_time_series, model_count, forecast_count"
ORACLES["rounds_with_metadata"] = statement(_META_NEEDS, f"""
SELECT {_COLUMNS}, array_to_string(domains, ',') AS domains, array_to_string(categories, ',') AS categories,
  array_to_string(subcategories, ',') AS subcategories, registration_start, end_time FROM {_META}""")
ORACLES["list_rounds_filtered"] = statement(_META_NEEDS, f"""
SELECT {_COLUMNS} FROM {_META} WHERE status IN ('active', 'completed') AND end_time >= TIMESTAMP '2024-01-14' AND end_time <= TIMESTAMP '2024-01-28'
  AND list_has_any(domains, ['sales', 'people']) AND list_has_any(categories, ['shop', 'users']) AND horizon_s = 259200""")
ORACLES["list_rounds_page"] = statement(_META_NEEDS, f"""
SELECT {_COLUMNS} FROM {_META} ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'registration' THEN 1 WHEN 'completed' THEN 2 ELSE 4 END,
  created_at DESC, round_id LIMIT 10 OFFSET 10""")
ORACLES["list_rounds_last_page"] = statement(_META_NEEDS, f"""
SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'registration' THEN 1 WHEN 'completed' THEN 2 ELSE 4 END,
  created_at DESC, round_id) AS place, count(*) OVER () AS total FROM {_META}) WHERE place > (total - 1) // 10 * 10""")
ORACLES["list_rounds_page_info"] = statement(_META_NEEDS, f"""
SELECT total_count, total_pages, 2 < total_pages AS has_next, true AS has_previous FROM (
  SELECT count(*) AS total_count, CASE WHEN count(*) = 0 THEN 1 ELSE CAST(ceil(count(*) / 10.0) AS BIGINT) END AS total_pages
  FROM {_META} WHERE status = 'completed')""")
ORACLES["filter_options"] = statement(_META_NEEDS, f"""
SELECT DISTINCT * FROM (
  SELECT 'domains' AS dimension, unnest(domains) AS option FROM {_META} UNION ALL SELECT 'categories', unnest(categories) FROM {_META}
  UNION ALL SELECT 'subcategories', unnest(subcategories) FROM {_META} UNION ALL SELECT 'frequency_s', frequency_s::VARCHAR FROM {_META}
  UNION ALL SELECT 'horizon_s', horizon_s::VARCHAR FROM {_META} UNION ALL SELECT 'status', status FROM {_META}) WHERE option IS NOT NULL""")
ORACLES["open_rounds"] = statement("rounds", f"""
SELECT * FROM (SELECT r.id, r.name, CASE WHEN r.is_cancelled THEN 'cancelled' ELSE {status_case(REGISTRATION_AS_OF)} END AS status,
  r.registration_start FROM rounds r) WHERE status IN ('registration', 'active')""")
_ROUND_SERIES = """(SELECT p.series_id, p.round_id, p.min_ts AS context_start_time, p.max_ts AS context_end_time, r.definition_id, r.horizon_s,
    r.start_time, r.end_time, r.registration_start, r.registration_end, s.name, s.description, s.frequency_s, s.unique_id, s.unit,
    c.domain, c.category, c.subcategory
  FROM pseudo p JOIN rounds r ON r.id = p.round_id JOIN series s ON s.series_id = p.series_id LEFT JOIN category c ON c.id = s.category_id)"""
ORACLES["round_series"] = statement("pseudo rounds series category", f"SELECT * FROM {_ROUND_SERIES}")
ORACLES["definition_series"] = statement("pseudo rounds series category", f"""
SELECT DISTINCT definition_id, series_id, name, description, frequency_s, unique_id, domain, category, subcategory FROM {_ROUND_SERIES}""")
ORACLES["current_definition_series"] = statement("assignments", "SELECT DISTINCT definition_id, series_id FROM assignments WHERE is_current")
ORACLES["naive_forecast"] = statement("naive", "SELECT * REPLACE (round(predicted_value, 6) AS predicted_value) FROM naive")
ORACLES["forecast_stats"] = statement("forecasts", """
SELECT round_id, model_id, series_id, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS forecast_count FROM forecasts GROUP BY ALL""")
ORACLES["round_models"] = statement("forecasts models users", """
SELECT DISTINCT f.round_id, f.model_id, m.readable_id, coalesce(m.name, 'model') AS model_name, u.username
FROM forecasts f JOIN models m ON m.id = f.model_id JOIN users u ON u.id = m.user_id""")
ORACLES["round_participants"] = statement("forecasts", "SELECT DISTINCT round_id, model_id FROM forecasts")
ORACLES["visible_forecasts"] = statement("forecasts rounds models", f"""
SELECT f.round_id, f.model_id, f.series_id, f.ts, round(f.predicted_value, 6) AS predicted_value FROM forecasts f
JOIN rounds r ON r.id = f.round_id JOIN models m ON m.id = f.model_id
WHERE m.user_id = 2 AND (r.is_cancelled OR {status_case(REGISTRATION_AS_OF)} <> 'registration')""")
ORACLES["list_forecasts"] = statement("forecasts rounds pseudo", f"""
SELECT f.round_id, f.model_id, f.series_id, f.ts, round(f.predicted_value, 6) AS predicted_value, p.challenge_series_name, f.created_at, round(f.q_low, 6) AS q_low, round(f.q_high, 6) AS q_high
FROM forecasts f JOIN rounds r ON r.id = f.round_id AND r.start_time <= {AS_OF}
JOIN pseudo p ON p.round_id = f.round_id AND p.series_id = f.series_id""")
ORACLES["series_forecasts_with_mase"] = statement("forecasts rounds pseudo rollups models", f"""
SELECT f.round_id, f.series_id, f.model_id, any_value(m.readable_id) AS readable_id,
  round(CASE WHEN sum(abs(b.value - y.value)) <> 0 THEN sum(abs(f.predicted_value - y.value)) / sum(abs(b.value - y.value)) END, 6) AS current_mase,
  count(y.value) AS n_evaluated, CAST(count(*) AS INTEGER) AS n_points, min(f.ts) AS first_ts, max(f.ts) AS last_ts,
  round(sum(f.predicted_value), 6) AS value_sum, CAST(count(f.q_high) AS INTEGER) AS n_ci, round(coalesce(sum(f.q_high), 0), 6) AS ci_sum
FROM forecasts f JOIN rounds r ON r.id = f.round_id JOIN pseudo p ON p.round_id = f.round_id AND p.series_id = f.series_id
JOIN models m ON m.id = f.model_id
JOIN rollups b ON b.resolution = {resolution('r.frequency_s')} AND b.series_id = f.series_id AND b.ts = p.max_ts
LEFT JOIN rollups y ON y.resolution = {resolution('r.frequency_s')} AND y.series_id = f.series_id AND y.ts = f.ts
GROUP BY f.round_id, f.series_id, f.model_id""")
_WANTED = "(SELECT DISTINCT definition_id, series_id, m.model_id FROM assignments, (VALUES (1), (2), (3), (4)) m(model_id))"
ORACLES["forecasts_across_rounds"] = statement("assignments rounds pseudo forecasts", f"""
SELECT k.model_id, k.definition_id, k.series_id, r.id AS round_id, p.series_id IS NOT NULL AS series_in_round, f.n IS NOT NULL AS forecast_exists,
  CASE WHEN f.n IS NOT NULL THEN CAST(f.n AS INTEGER) END AS n_points, f.first_ts, f.last_ts, round(f.total, 6) AS value_sum,
  f.n_ci, round(f.ci_total, 6) AS ci_sum
FROM {_WANTED} k JOIN rounds r ON r.definition_id = k.definition_id LEFT JOIN pseudo p ON p.round_id = r.id AND p.series_id = k.series_id
LEFT JOIN (SELECT round_id, model_id, series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(predicted_value) AS total,
    CAST(count(q_high) AS INTEGER) AS n_ci, coalesce(sum(q_high), 0) AS ci_total FROM forecasts
  WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-22' GROUP BY ALL) f
  ON f.round_id = r.id AND f.model_id = k.model_id AND f.series_id = k.series_id""")
ORACLES["ground_truth"] = statement("assignments definitions rollups", f"""
SELECT k.definition_id, k.series_id, x.ts, round(x.value, 6) AS value
FROM (SELECT DISTINCT definition_id, series_id FROM assignments) k JOIN definitions d ON d.id = k.definition_id
JOIN rollups x ON x.series_id = k.series_id AND x.resolution = {resolution('d.frequency_s')}
WHERE x.ts >= TIMESTAMP '2024-01-11' AND x.ts < TIMESTAMP '2024-01-22'""")

ORACLES["admit_verdicts"] = statement("verdicts", "SELECT * FROM verdicts")
ORACLES["admit_forecast_rows"] = statement("submissions verdicts", """
SELECT v.round_id, v.model_id, v.series_id, s.ts, round(s.value, 6) AS predicted_value, s.submitted_at AS created_at, round(s.q_low, 6) AS q_low, round(s.q_high, 6) AS q_high
FROM submissions s JOIN verdicts v ON v.round_id = s.round_id AND v.model_name = s.model_name AND v.user_id = s.user_id
  AND v.submitted_at = s.submitted_at AND v.challenge_series_name = s.challenge_series_name WHERE v.error IS NULL""")
_OLD = "(SELECT * FROM forecasts WHERE created_at < TIMESTAMP '2024-01-17')"
ORACLES["admit_new_forecasts"] = statement("accepted forecasts", f"""
SELECT a.* REPLACE (round(a.predicted_value, 6) AS predicted_value, round(a.q_low, 6) AS q_low, round(a.q_high, 6) AS q_high) FROM accepted a WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o
  WHERE o.round_id = a.round_id AND o.model_id = a.model_id AND o.series_id = a.series_id AND o.ts = a.ts)""")
ORACLES["admit_new_participants"] = statement("verdicts forecasts", f"""
SELECT DISTINCT round_id, model_id FROM verdicts v WHERE (error IS NULL OR error IN ('unknown_series', 'wrong_point_count'))
  AND NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.round_id = v.round_id AND o.model_id = v.model_id)""")
ORACLES["admit_pending_scores"] = statement("accepted forecasts", f"""
SELECT DISTINCT a.round_id, a.model_id, a.series_id, false AS final_evaluation FROM accepted a WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o
  WHERE o.round_id = a.round_id AND o.model_id = a.model_id AND o.series_id = a.series_id)""")
ORACLES["admit_rejected"] = statement("verdicts", """
SELECT error, count(*) AS n, CAST(sum(received) AS BIGINT) AS points FROM verdicts WHERE error IS NOT NULL GROUP BY error""")

ORACLES["duration_texts"] = """
SELECT o_orderkey, 'P' || CASE WHEN s = 0 THEN '0D' ELSE CASE WHEN d > 0 THEN d || 'D' ELSE '' END || CASE WHEN s % 86400 > 0 THEN 'T' ELSE '' END
    || CASE WHEN h > 0 THEN h || 'H' ELSE '' END || CASE WHEN mi > 0 THEN mi || 'M' ELSE '' END || CASE WHEN se > 0 THEN se || 'S' ELSE '' END END AS iso,
  CASE WHEN d = 0 THEN clock WHEN s % 86400 = 0 THEN days ELSE days || ' ' || clock END AS db, s AS iso_s, s AS db_s,
  s % 90 * 60 AS word_s, CAST(NULL AS BIGINT) AS bad_s,
  CASE s WHEN 900 THEN '15min' WHEN 3600 THEN '1h' WHEN 86400 THEN '1d' ELSE 'raw' END AS resolution,
  CASE WHEN s > 0 THEN s // 3600 END AS points
FROM (SELECT *, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS mi, s % 60 AS se,
    format('{:02d}:{:02d}:{:02d}', s % 86400 // 3600, s % 3600 // 60, s % 60) AS clock,
    (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day' ELSE ' days' END AS days
  FROM (SELECT o_orderkey, CAST(o_orderkey % 1000 * 900 + o_custkey % 60 AS BIGINT) AS s FROM orders))"""
ORACLES["comma_lists"] = "SELECT p_partkey, CAST(3 AS INTEGER) AS n, p_type || '|' || p_brand || '|' || p_name AS items FROM part"
ORACLES["ten_minute_floor"] = "SELECT event_id, time_bucket(INTERVAL '10 minutes', ts) AS ts, round(value / 7, 4) AS value FROM events"

ORACLES["active_definitions"] = statement("definitions rounds", """
SELECT d.id, d.schedule_id, d.name, h.n AS n_rounds, h.last_end
FROM definitions d LEFT JOIN (SELECT definition_id, count(*) AS n, max(end_time) AS last_end FROM rounds GROUP BY definition_id) h ON h.definition_id = d.id
WHERE d.is_active""")
ORACLES["definition_by_schedule"] = statement("definitions rounds", """
SELECT d.id AS definition_id, d.schedule_id, d.is_active, r.id AS round_id, r.start_time
FROM definitions d JOIN rounds r ON r.definition_id = d.id WHERE d.schedule_id = 's-daily'""")
ORACLES["find_series"] = statement("series", "SELECT series_id, name, unit, category_id FROM series WHERE unique_id = 'ev-click'")
ORACLES["models_of_user"] = statement("models forecasts", """
SELECT m.id, m.name, m.organization_id, f.n AS n_rounds
FROM models m LEFT JOIN (SELECT model_id, count(DISTINCT round_id) AS n FROM forecasts GROUP BY model_id) f ON f.model_id = m.id WHERE m.user_id = 2""")
