"""Ranking base, statistics, ratings and leaderboards."""

from oracles.base import AS_OF, statement, scoped

ORACLES: dict[str, str] = {}

_RATING = "round(elo_rating_median, 6) AS elo_rating_median, round(elo_ci_lower, 6) AS elo_ci_lower, round(elo_ci_upper, 6) AS elo_ci_upper"
_STATS = "round(avg_mase, 6) AS avg_mase, round(mase_std, 6) AS mase_std, round(avg_rmse, 6) AS avg_rmse"
_SUMS = "round(sum_mase, 6) AS sum_mase, round(sum_mase_sq, 6) AS sum_mase_sq, round(sum_rmse, 6) AS sum_rmse"

_BASE = """(SELECT v.round_id, v.model_id, v.series_id, round(v.mase, 6) AS mase, round(v.rmse, 6) AS rmse, r.name AS round_name, r.end_time AS round_end_time,
    v.definition_id, d.name AS definition_name, array_to_string(d.domains, ',') AS definition_domains, m.name AS model_name, u.username,
    s.name AS series_name, s.unique_id, c.domain, c.category, c.subcategory
  FROM late_valid v JOIN rounds r ON r.id = v.round_id LEFT JOIN definitions d ON d.id = v.definition_id AND d.is_active
  JOIN models m ON m.id = v.model_id JOIN users u ON u.id = m.user_id JOIN series s ON s.series_id = v.series_id
  LEFT JOIN category c ON c.id = s.category_id)"""
_BASE_NEEDS = "late_valid rounds definitions models users series category"
ORACLES["ranking_base"] = statement(_BASE_NEEDS, f"SELECT * REPLACE (coalesce(definition_domains, '') AS definition_domains) FROM {_BASE}")
ORACLES["series_by_definition"] = statement(_BASE_NEEDS, f"""
SELECT model_id, definition_id, definition_name, series_id, series_name, unique_id, count(DISTINCT round_id) AS rounds_participated
FROM {_BASE} GROUP BY ALL""")
ORACLES["round_model_scores"] = statement("sums", f"SELECT * REPLACE ({_SUMS}) FROM sums")


def _sums(valid: str) -> str:
    return f"""SELECT x.round_id, CAST(r.registration_start AS DATE) AS round_date, x.model_id, x.scope_type, x.scope_id, round(sum(x.mase), 6) AS sum_mase,
  round(sum(x.mase * x.mase), 6) AS sum_mase_sq, round(sum(x.rmse), 6) AS sum_rmse, count(*) AS num_scores
FROM ({scoped(valid)}) x JOIN rounds r ON r.id = x.round_id GROUP BY ALL"""


_TOUCHED = "(SELECT round_id FROM scores WHERE NOT final_evaluation)"
ORACLES["round_sums_refresh"] = statement("valid late_valid scores rounds definitions", f"""
SELECT * FROM ({_sums('valid')}) WHERE round_id NOT IN {_TOUCHED} UNION ALL SELECT * FROM ({_sums('late_valid')}) WHERE round_id IN {_TOUCHED}""")
ORACLES["cumulative_stats"] = statement("cumulative", f"SELECT * REPLACE ({_STATS}) FROM cumulative")
ORACLES["window_rankings"] = statement("late_scores rounds models users", f"""
SELECT l.range_label, m.name AS model_name, count(*) AS n_completed, round(avg(s.mase), 6) AS avg_mase
FROM late_scores s JOIN rounds r ON r.id = s.round_id JOIN models m ON m.id = s.model_id JOIN users u ON u.id = m.user_id
JOIN (VALUES ('Last 7 days', 7), ('Last 30 days', 30), ('Last 90 days', 90), ('Last 365 days', 365)) l(range_label, days)
  ON r.end_time >= {AS_OF} - to_days(l.days)
WHERE s.mase IS NOT NULL GROUP BY l.range_label, m.name""")
ORACLES["model_details"] = statement("models late_scores", """
SELECT m.id, m.name, count(DISTINCT s.round_id) AS challenges_participated, CAST(coalesce(sum(s.forecast_count), 0) AS BIGINT) AS forecasts_made
FROM models m LEFT JOIN late_scores s ON s.model_id = m.id GROUP BY m.id, m.name""")
_RATED = "SELECT DISTINCT r.definition_id FROM scores s JOIN rounds r ON r.id = s.round_id WHERE s.final_evaluation AND s.mase IS NOT NULL"
ORACLES["rated_definitions"] = statement("scores rounds", _RATED)
ORACLES["rated_groups"] = statement("scores rounds definitions", f"""
SELECT DISTINCT d.frequency_s, d.horizon_s, CASE d.frequency_s WHEN 900 THEN '00:15:00' WHEN 3600 THEN '01:00:00' ELSE '1 day' END || '::'
  || CASE d.horizon_s WHEN 86400 THEN '1 day' ELSE '3 days' END AS scope_id FROM definitions d WHERE d.id IN ({_RATED})""")
ORACLES["round_averages"] = statement("averages", "SELECT * REPLACE (round(avg_mase, 6) AS avg_mase) FROM averages")
ORACLES["elo_fixed_order"] = statement("fixed_summary", f"SELECT * EXCLUDE (calculation_date) REPLACE ({_RATING}) FROM fixed_summary")
ORACLES["elo_season"] = statement("fixed_ratings fixed_matches", """
SELECT k.scope_type, k.scope_id, CAST(r.replicate AS INTEGER) AS replicate, r.model_id, round(r.rating, 6) AS rating
FROM fixed_ratings r JOIN (SELECT DISTINCT g, scope_type, scope_id FROM fixed_matches) k ON k.g = r.g""")
ORACLES["daily_rankings"] = statement("rankings", f"SELECT * REPLACE ({_RATING}, {_STATS}) FROM rankings")
ORACLES["leaderboard"] = statement("board", f"SELECT * REPLACE ({_RATING}, {_STATS}) FROM board")
_MONTHLY = "(SELECT *, last_day(calculation_date) = calculation_date AS is_month_end FROM board WHERE is_latest OR last_day(calculation_date) = calculation_date)"
ORACLES["leaderboard_latest"] = statement("board", f"""
SELECT scope_type, scope_id, rank_position, model_name, calculation_date, {_RATING} FROM {_MONTHLY} WHERE is_latest
ORDER BY scope_type, scope_id NULLS FIRST, rank_position, model_id LIMIT 100""")
ORACLES["leaderboard_top"] = statement("board", f"""
SELECT scope_id, rank_position, model_name, calculation_date, {_RATING} FROM board
WHERE scope_type = 'frequency_horizon' AND scope_id = '1 day::3 days' AND is_latest ORDER BY board.elo_rating_median DESC, model_id LIMIT 3""")
ORACLES["rankings_of_definition"] = statement("board", f"""
SELECT definition_id, rank_position, model_name, {_RATING}, round(avg_mase, 6) AS avg_mase FROM {_MONTHLY}
WHERE calculation_date = DATE '2024-01-31' AND scope_type = 'definition' AND definition_id = 4 ORDER BY rank_position LIMIT 100""")
ORACLES["rating_trajectory"] = statement("rankings definitions", """
SELECT k.model_id, k.scope_type, k.scope_id, d.name AS definition_name, k.n, k.last_date, k.last_score, k.last_rank
FROM (SELECT model_id, scope_type, scope_id, CAST(count(*) AS INTEGER) AS n, max(calculation_date) AS last_date,
    round(arg_max(elo_rating_median, calculation_date), 6) AS last_score, arg_max(rank_position, calculation_date) AS last_rank
  FROM rankings GROUP BY model_id, scope_type, scope_id) k
LEFT JOIN definitions d ON k.scope_type = 'definition' AND k.scope_id = CAST(d.id AS VARCHAR)""")
ORACLES["ranking_filter_options"] = statement("board definitions", f"""
SELECT 'definition' AS kind, CAST(id AS VARCHAR) AS key, name AS label FROM definitions WHERE is_active
UNION ALL SELECT DISTINCT 'frequency_horizon', scope_id, NULL FROM board WHERE scope_type = 'frequency_horizon'
UNION ALL SELECT DISTINCT 'date', CAST(calculation_date AS VARCHAR), CAST(is_month_end AS VARCHAR) FROM {_MONTHLY}""")
ORACLES["has_snapshot"] = statement("rankings", """
SELECT coalesce(bool_or(scope_type = 'global' AND calculation_date = DATE '2024-01-20'), false) AS has_snapshot FROM rankings""")
