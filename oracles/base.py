"""Common table expressions of the data model, and the helper that puts a statement together."""

from __future__ import annotations

from collections import Counter

AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"
REGISTRATION_AS_OF = "TIMESTAMP '2024-01-20 06:30:00'"
LATE = "TIMESTAMP '2024-02-02 00:00:00'"

TYPE_ID = (
    "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
    "WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 10 + ('0x' || substr(md5(event_type), 1, 8))::BIGINT % 99990 END"
)

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs.split(), sql.strip())


def statement(needs: str, sql: str) -> str:
    """``sql`` preceded by the expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in CTES[name][0]:
            visit(other)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return sql.strip()
    uses = Counter(other for name in order for other in CTES[name][0]) + Counter(needs.split())
    parts = [f"{name} AS {'MATERIALIZED ' if uses[name] > 1 and not name.endswith('_state') else ''}(\n{CTES[name][1]}\n)" for name in order]
    recursive = "RECURSIVE " if any(name.endswith("_state") for name in order) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + sql.strip()


def status_case(as_of: str, alias: str = "r") -> str:
    return f"""CASE WHEN {as_of} >= {alias}.registration_start AND {as_of} <= {alias}.registration_end THEN 'registration'
    WHEN {as_of} > {alias}.registration_end AND {as_of} <= {alias}.end_time THEN 'active'
    WHEN {as_of} > {alias}.end_time THEN 'completed' ELSE 'undefined' END"""


def finite(column: str) -> str:
    return f"({column} IS NOT NULL AND NOT isnan({column}) AND NOT isinf({column}))"


def resolution(seconds: str, default: str = "1h") -> str:
    return f"CASE {seconds} WHEN 900 THEN '15min' WHEN 3600 THEN '1h' WHEN 86400 THEN '1d' ELSE '{default}' END"


WIDTH = "CASE {0} WHEN '15min' THEN INTERVAL 15 MINUTE WHEN '1h' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END"

cte("points", "", f"""
SELECT CAST({TYPE_ID} AS INTEGER) AS series_id, ts, value, event_id FROM events
UNION ALL SELECT CAST(100000 + user_id AS INTEGER), ts, value, event_id FROM events""")

for _name, _bucket in (
    ("15min", "time_bucket(INTERVAL '15 minutes', ts)"), ("1h", "date_trunc('hour', ts)"), ("1d", "date_trunc('day', ts)")
):
    cte(f"rollup_{_name}", "points", f"""
SELECT series_id, CAST({_bucket} AS TIMESTAMP) AS ts, avg(value) AS value, count(*) AS sample_count,
  min(value) AS min_value, max(value) AS max_value
FROM points GROUP BY series_id, {_bucket}""")

cte("rollups", "rollup_15min rollup_1h rollup_1d", """
SELECT '15min' AS resolution, * FROM rollup_15min UNION ALL SELECT '1h', * FROM rollup_1h
UNION ALL SELECT '1d', * FROM rollup_1d""")

cte("category", "", """
SELECT * FROM (VALUES (1, 'traffic', 'online', 'web', 'visits'), (2, 'quality', 'online', 'web', 'faults'),
  (3, 'sales', 'online', 'shop', 'orders')) v(id, domain, subdomain, category, subcategory)
UNION ALL SELECT r_regionkey + 10, 'people', NULL, 'users', lower(r_name) FROM region""")

cte("series", "", f"""
SELECT DISTINCT CAST({TYPE_ID} AS INTEGER) AS series_id, event_type AS name, 'ev-' || event_type AS unique_id, 'events' AS unit,
  CAST(900 AS BIGINT) AS frequency_s,
  CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS BIGINT) AS category_id,
  'about ' || event_type AS description, 'UTC' AS ts_timezone, '15 minutes' AS update_frequency
FROM events
UNION ALL SELECT DISTINCT CAST(100000 + user_id AS INTEGER), 'user-' || user_id, 'us-' || user_id, 'money', 86400, user_id % 5 + 10,
  'about user-' || user_id, 'UTC', '15 minutes' FROM events
UNION ALL SELECT 6, 'idle', 'ev-idle', 'events', 900, 1, 'about idle', 'UTC', '15 minutes'""")

cte("definitions", "", """
SELECT * FROM (VALUES
  (1, 's-hourly-day', 'Hourly day', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 101, 86400::BIGINT, 3600::BIGINT, 3600, 5, true),
  (2, 's-hourly-3day', 'Hourly three days', ['traffic', 'quality', 'sales'], ['mixed'], [], 101, 259200, 3600, 3600, 3, true),
  (3, 's-quarter-day', 'Quarter-hour day', ['traffic', 'sales'], ['online'], [], 199, 86400, 900, NULL, 3, true),
  (4, 's-daily', 'Daily three days', ['people'], [], ['users'], 7, 259200, 86400, 3600, NULL, false)
) v(id, schedule_id, name, domains, subdomains, categories, context_length, horizon_s, frequency_s, registration_s, n_time_series, is_active)""")

cte("assignments", "", """
SELECT v.definition_id, v.series_id, true AS is_required, v.is_excluded, TIMESTAMP '2024-01-01' AS valid_from,
  CASE WHEN v.is_current THEN NULL ELSE TIMESTAMP '2024-01-05' END AS valid_to, v.is_current
FROM (VALUES (1, 1, false, true), (1, 2, false, true), (1, 3, true, true), (1, 4, false, true), (1, 5, false, true),
  (2, 1, false, true), (2, 2, false, true), (2, 3, false, true), (2, 4, false, false)) v(definition_id, series_id, is_excluded, is_current)
UNION ALL SELECT DISTINCT 4, CAST(100000 + user_id AS INTEGER), true, user_id % 10 = 7, TIMESTAMP '2024-01-01', CAST(NULL AS TIMESTAMP), true
FROM events""")

cte("models", "", """
SELECT * FROM (VALUES (1, 1, 1, 'Persistence', 'persistence-1', 'statistical', 'naive', 'none', 0),
  (2, 1, 1, 'Seasonal', 'seasonal-2', 'statistical', 'naive', 'none', 0),
  (3, 2, 2, 'Mean', 'mean-3', 'statistical', 'mean', 'none', 1),
  (4, 2, NULL, 'Noisy', 'noisy-4', 'oracle', 'noise', 'none', 9)
) v(id, user_id, organization_id, name, readable_id, model_type, model_family, architecture, model_size)""")

cte("users", "", "SELECT * FROM (VALUES (1, 'ada', 1, 'internal'), (2, 'bo', 2, 'external')) v(id, username, organization_id, user_type)")
cte("organisations", "", "SELECT * FROM (VALUES (1, 'North'), (2, 'South')) v(id, name)")

cte("created", "definitions", """
SELECT CAST(d.id * 10000 + date_diff('day', g.first_day, g.day) + 1 AS INTEGER) AS id, d.id AS definition_id,
  d.name || ' - ' || strftime(g.day + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') || ' UTC' AS name,
  d.context_length, d.horizon_s, d.frequency_s, g.day + INTERVAL 6 HOUR AS registration_start,
  g.day + INTERVAL 6 HOUR + to_seconds(coalesce(d.registration_s, 3600)) AS registration_end,
  g.day + INTERVAL 6 HOUR AS created_at,
  (d.id * 10000 + date_diff('day', g.first_day, g.day) + 1) % 37 = 0 AS planned_cancel
FROM definitions d, (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, min(CAST(CAST(ts AS DATE) AS TIMESTAMP)) OVER () AS first_day,
    max(CAST(CAST(ts AS DATE) AS TIMESTAMP)) OVER () AS last_day FROM events) g
WHERE g.day >= g.first_day + INTERVAL 9 DAY AND g.day <= g.last_day - INTERVAL 4 DAY""")

cte("availability", "series category points", f"""
SELECT s.series_id, s.name, s.frequency_s, s.unique_id, c.domain, c.subdomain, c.category, c.subcategory, l.last_data_ts,
  {AS_OF} - CASE s.frequency_s WHEN 3600 THEN INTERVAL 6 HOUR WHEN 900 THEN INTERVAL 6 HOUR ELSE INTERVAL 2 DAY END AS expected_threshold,
  coalesce(l.last_data_ts >= {AS_OF} - CASE s.frequency_s WHEN 3600 THEN INTERVAL 12 HOUR WHEN 900 THEN INTERVAL 6 HOUR
    ELSE INTERVAL 2 DAY END, false) AS has_recent_data
FROM series s LEFT JOIN category c ON c.id = s.category_id
LEFT JOIN (SELECT series_id, max(ts) AS last_data_ts FROM points WHERE ts <= {AS_OF} GROUP BY series_id) l ON l.series_id = s.series_id""")

cte("eligible", "definitions availability", """
SELECT d.id AS definition_id, a.series_id FROM definitions d JOIN availability a ON a.frequency_s <= d.frequency_s AND a.has_recent_data
WHERE (len(d.domains) = 0 OR list_contains(d.domains, 'mixed') OR list_contains(d.domains, a.domain))
  AND (len(d.subdomains) = 0 OR list_contains(d.subdomains, 'mixed') OR list_contains(d.subdomains, a.subdomain))
  AND (len(d.categories) = 0 OR list_contains(d.categories, 'mixed') OR list_contains(d.categories, a.category))""")

cte("chosen", "created assignments eligible definitions", """
SELECT r.id AS round_id, a.series_id, false AS is_sampled FROM created r
JOIN assignments a ON a.definition_id = r.definition_id AND a.is_current
UNION ALL SELECT round_id, series_id, true FROM (
  SELECT r.id AS round_id, e.series_id, d.n_time_series,
    row_number() OVER (PARTITION BY r.id ORDER BY md5(concat_ws(':', '42', r.id, e.series_id)), e.series_id) AS rn
  FROM created r JOIN definitions d ON d.id = r.definition_id JOIN eligible e ON e.definition_id = r.definition_id
  WHERE r.definition_id NOT IN (SELECT definition_id FROM assignments WHERE is_current)) WHERE rn <= n_time_series""")

cte("context", "chosen created rollups", f"""
SELECT round_id, series_id, ts, value FROM (
  SELECT c.round_id, c.series_id, x.ts, x.value, r.context_length,
    row_number() OVER (PARTITION BY c.round_id, c.series_id ORDER BY x.ts DESC) AS rn
  FROM chosen c JOIN created r ON r.id = c.round_id
  JOIN rollups x ON x.series_id = c.series_id AND x.resolution = {resolution('r.frequency_s')}
    AND x.ts + {WIDTH.format('x.resolution')} <= r.registration_start) WHERE rn <= context_length""")

cte("pseudo", "chosen series context", """
SELECT c.round_id, c.series_id,
  CASE WHEN c.is_sampled THEN 'series_' || substr(sha1(concat_ws(':', c.round_id, c.series_id)), 1, 12) ELSE s.unique_id END AS challenge_series_name,
  x.min_ts, x.max_ts, x.value_avg, x.value_std
FROM chosen c JOIN series s ON s.series_id = c.series_id
LEFT JOIN (SELECT round_id, series_id, min(ts) AS min_ts, max(ts) AS max_ts, avg(value) AS value_avg, stddev_samp(value) AS value_std
  FROM context GROUP BY round_id, series_id) x ON x.round_id = c.round_id AND x.series_id = c.series_id""")

cte("rounds", "created pseudo", """
SELECT r.id, r.definition_id, r.name, r.context_length, r.horizon_s, r.frequency_s, r.registration_start, r.registration_end,
  coalesce(m.newest + to_seconds(r.frequency_s), r.registration_end) AS start_time,
  coalesce(m.newest + to_seconds(r.frequency_s), r.registration_end) + to_seconds(r.horizon_s) AS end_time,
  r.planned_cancel OR m.newest IS NULL AS is_cancelled, r.created_at
FROM created r LEFT JOIN (SELECT round_id, max(max_ts) AS newest FROM pseudo GROUP BY round_id) m ON m.round_id = r.id""")

cte("naive", "rounds context", """
SELECT c.round_id, c.series_id, g.ts, c.predicted_value
FROM (SELECT round_id, series_id, arg_max(value, ts) AS predicted_value FROM context GROUP BY round_id, series_id) c
JOIN (SELECT id AS round_id, unnest(range(start_time, end_time, to_seconds(frequency_s))) AS ts FROM rounds) g ON g.round_id = c.round_id""")

cte("forecasts", "naive rounds rollups pseudo", f"""
SELECT round_id, model_id, series_id, ts, predicted_value, created_at, CASE WHEN model_id % 2 = 0 THEN predicted_value * 0.9::DOUBLE END AS q_low,
  CASE WHEN model_id % 2 = 0 THEN predicted_value * 1.1::DOUBLE END AS q_high FROM (
  SELECT b.round_id, m.model_id, b.series_id, b.ts, r.registration_start + to_minutes(m.model_id) AS created_at,
    CASE m.model_id WHEN 1 THEN b.predicted_value WHEN 2 THEN coalesce(x.value, b.predicted_value)
      WHEN 3 THEN CASE WHEN b.round_id % 5 <> 0 THEN p.value_avg END
      WHEN 4 THEN y.value * (1 + ((b.round_id * 31 + b.series_id * 7 + hour(b.ts)) % 11 - 5) / 50.0::DOUBLE) END AS predicted_value
  FROM naive b JOIN rounds r ON r.id = b.round_id JOIN pseudo p ON p.round_id = b.round_id AND p.series_id = b.series_id
  LEFT JOIN rollups x ON x.resolution = {resolution('r.frequency_s')} AND x.series_id = b.series_id
    AND x.ts = b.ts - CASE WHEN r.frequency_s < 86400 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END
  LEFT JOIN rollups y ON y.resolution = {resolution('r.frequency_s')} AND y.series_id = b.series_id AND y.ts = b.ts
  CROSS JOIN (VALUES (1), (2), (3), (4)) m(model_id)) WHERE predicted_value IS NOT NULL""")


def _scores(name: str, as_of: str) -> None:
    cte(name, "forecasts rounds pseudo rollups", f"""
SELECT round_id, model_id, series_id,
  CASE WHEN evaluation_status IN ('complete', 'partial') THEN
    CASE WHEN naive_error > 0 THEN model_error / naive_error WHEN model_error = 0 THEN 0.0 ELSE 'Infinity'::DOUBLE END END AS mase,
  CASE WHEN evaluation_status IN ('complete', 'partial') THEN sqrt(square_error) END AS rmse,
  forecast_count, CASE WHEN evaluation_status = 'error' THEN 0 ELSE aligned END AS actual_count,
  CASE WHEN evaluation_status = 'error' THEN 0 ELSE aligned END AS evaluated_count,
  CASE WHEN evaluation_status = 'error' THEN 0.0 ELSE aligned / forecast_count END AS data_coverage,
  evaluation_status IN ('complete', 'insufficient_data') OR (evaluation_status = 'partial' AND late) AS final_evaluation,
  evaluation_status,
  CASE evaluation_status WHEN 'error' THEN 'No context point available for naive forecast baseline'
    WHEN 'no_overlap' THEN 'No overlapping timestamps between forecasts and actuals'
    WHEN 'insufficient_data' THEN 'Timeout: only ' || format('{{:.1f}}', aligned / forecast_count * 100) || '% coverage (min 95% required)' END AS error_message,
  {as_of} AS calculated_at
FROM (SELECT *, CASE WHEN baseline IS NULL THEN 'error' WHEN aligned = 0 THEN 'no_overlap' WHEN aligned >= forecast_count THEN 'complete'
    WHEN late AND aligned / forecast_count < 0.95 THEN 'insufficient_data' ELSE 'partial' END AS evaluation_status
  FROM (SELECT f.round_id, f.model_id, f.series_id, count(*) AS forecast_count, count(y.value) AS aligned, max(b.value) AS baseline,
      avg(abs(y.value - f.predicted_value)) AS model_error, avg(abs(y.value - b.value)) AS naive_error,
      avg((y.value - f.predicted_value) * (y.value - f.predicted_value)) AS square_error,
      {as_of} > max(r.end_time) + INTERVAL 1 DAY AS late
    FROM forecasts f JOIN rounds r ON r.id = f.round_id JOIN pseudo p ON p.round_id = f.round_id AND p.series_id = f.series_id
    LEFT JOIN known b ON b.resolution = {resolution('r.frequency_s')} AND b.series_id = f.series_id AND b.ts = p.max_ts
    LEFT JOIN known y ON y.resolution = {resolution('r.frequency_s')} AND y.series_id = f.series_id
      AND date_trunc('minute', y.ts) = date_trunc('minute', f.ts)
    GROUP BY f.round_id, f.model_id, f.series_id))""".replace("FROM forecasts f JOIN rounds r", "FROM forecasts f JOIN rounds r").replace(
        " known ", f" (SELECT * FROM rollups WHERE ts + {WIDTH.format('resolution')} <= {as_of}) "))


_scores("scores", AS_OF)
_scores("late_scores", LATE)

for _scores_name, _valid in (("scores", "valid"), ("late_scores", "late_valid")):
    cte(_valid, f"{_scores_name} rounds assignments", f"""
SELECT s.*, r.definition_id FROM {_scores_name} s JOIN rounds r ON r.id = s.round_id
WHERE s.final_evaluation AND {finite('s.mase')}
  AND NOT EXISTS (SELECT 1 FROM assignments a WHERE a.definition_id = r.definition_id AND a.series_id = s.series_id AND a.is_excluded)""")

INTERVAL_TEXT = "CASE {0} WHEN 900 THEN '00:15:00' WHEN 3600 THEN '01:00:00' WHEN 86400 THEN '1 day' WHEN 259200 THEN '3 days' END"


def scoped(valid: str) -> str:
    """Valid scores once per scope."""
    pair = f"{INTERVAL_TEXT.format('d.frequency_s')} || '::' || {INTERVAL_TEXT.format('d.horizon_s')}"
    return f"""SELECT v.*, 'global' AS scope_type, CAST(NULL AS VARCHAR) AS scope_id FROM {valid} v
UNION ALL SELECT v.*, 'definition', CAST(v.definition_id AS VARCHAR) FROM {valid} v
UNION ALL SELECT v.*, 'frequency_horizon', {pair} FROM {valid} v JOIN definitions d ON d.id = v.definition_id"""


cte("sums", "late_valid rounds definitions", f"""
SELECT x.round_id, CAST(r.registration_start AS DATE) AS round_date, x.model_id, x.scope_type, x.scope_id, sum(x.mase) AS sum_mase,
  sum(x.mase * x.mase) AS sum_mase_sq, sum(x.rmse) AS sum_rmse, count(*) AS num_scores
FROM ({scoped('late_valid')}) x JOIN rounds r ON r.id = x.round_id
GROUP BY x.round_id, CAST(r.registration_start AS DATE), x.model_id, x.scope_type, x.scope_id""")

cte("averages", "late_valid definitions", f"""
SELECT scope_type, scope_id, round_id, model_id, round(avg(mase), 9) AS avg_mase FROM ({scoped('late_valid')})
GROUP BY scope_type, scope_id, round_id, model_id""")

cte("snapshot_days", "", "SELECT * FROM (VALUES (DATE '2024-01-20'), (DATE '2024-01-25'), (DATE '2024-01-31')) v(calculation_date)")

cte("cumulative", "sums snapshot_days", """
SELECT calculation_date, model_id, scope_type, scope_id, m / n AS avg_mase,
  CASE WHEN n > 1 AND q / n - (m / n) * (m / n) > 0 THEN sqrt(q / n - (m / n) * (m / n)) END AS mase_std, r / n AS avg_rmse,
  CAST(n AS BIGINT) AS evaluated_count
FROM (SELECT d.calculation_date, s.model_id, s.scope_type, s.scope_id, sum(s.sum_mase) AS m, sum(s.sum_mase_sq) AS q, sum(s.sum_rmse) AS r,
    sum(s.num_scores) AS n
  FROM sums s JOIN snapshot_days d ON d.calculation_date >= s.round_date GROUP BY d.calculation_date, s.model_id, s.scope_type, s.scope_id)""")


def season(prefix: str, source: str, needs: str, replicates: int) -> None:
    """Rating season by replaying every match; ``source`` has calculation_date, scope, round_id, model_id, avg_mase."""
    cte(f"{prefix}_matches", needs, f"""
SELECT *, coalesce(calculation_date::VARCHAR || ':', '') || scope_type || ':' || coalesce(scope_id, '') AS g FROM ({source})""")
    cte(f"{prefix}_scopes", f"{prefix}_matches", f"""
SELECT g, count(DISTINCT round_id) AS steps FROM {prefix}_matches GROUP BY g HAVING count(DISTINCT model_id) >= 2""")
    cte(f"{prefix}_order", f"{prefix}_matches {prefix}_scopes", f"""
SELECT g, replicate, round_id, row_number() OVER (PARTITION BY g, replicate ORDER BY md5('42:' || g || ':' || replicate || ':' || round_id), round_id) AS step
FROM (SELECT DISTINCT g, round_id FROM {prefix}_matches JOIN {prefix}_scopes USING (g)), (SELECT unnest(range(0, {replicates})) AS replicate)""")
    cte(f"{prefix}_state", f"{prefix}_matches {prefix}_scopes {prefix}_order", f"""
SELECT g, replicate, CAST(0 AS BIGINT) AS step, model_id, CAST(1000.0 AS DOUBLE) AS rating
FROM (SELECT DISTINCT g, model_id FROM {prefix}_matches JOIN {prefix}_scopes USING (g)), (SELECT unnest(range(0, {replicates})) AS replicate)
UNION ALL
SELECT a.g, a.replicate, a.step + 1, a.model_id, any_value(a.rating) + 4 * coalesce(sum(CASE WHEN ma.avg_mase IS NOT NULL AND mb.avg_mase IS NOT NULL THEN
    CASE WHEN ma.avg_mase < mb.avg_mase THEN 1.0 WHEN ma.avg_mase = mb.avg_mase THEN 0.5 ELSE 0.0 END
    - 1.0 / (1.0 + pow(10.0, (b.rating - a.rating) / 400.0)) END), 0)
FROM {prefix}_state a JOIN {prefix}_order o ON o.g = a.g AND o.replicate = a.replicate AND o.step = a.step + 1
JOIN {prefix}_state b ON b.g = a.g AND b.replicate = a.replicate AND b.model_id <> a.model_id
LEFT JOIN {prefix}_matches ma ON ma.g = a.g AND ma.round_id = o.round_id AND ma.model_id = a.model_id
LEFT JOIN {prefix}_matches mb ON mb.g = b.g AND mb.round_id = o.round_id AND mb.model_id = b.model_id
GROUP BY a.g, a.replicate, a.step, a.model_id""")
    cte(f"{prefix}_ratings", f"{prefix}_state {prefix}_scopes", f"""
SELECT s.g, s.replicate, s.model_id, s.rating FROM {prefix}_state s JOIN {prefix}_scopes x ON x.g = s.g AND x.steps = s.step""")
    cte(f"{prefix}_summary", f"{prefix}_ratings {prefix}_matches", f"""
SELECT k.calculation_date, k.scope_type, k.scope_id, q.model_id, q.elo_rating_median, q.elo_ci_lower, q.elo_ci_upper,
  k.matches_played, q.n_bootstraps
FROM (SELECT g, model_id, quantile_cont(rating, 0.5) AS elo_rating_median, quantile_cont(rating, 0.025) AS elo_ci_lower,
    quantile_cont(rating, 0.975) AS elo_ci_upper, CAST(count(*) AS INTEGER) AS n_bootstraps FROM {prefix}_ratings GROUP BY g, model_id) q
JOIN (SELECT g, any_value(calculation_date) AS calculation_date, any_value(scope_type) AS scope_type, any_value(scope_id) AS scope_id, model_id,
    count(*) AS matches_played FROM {prefix}_matches GROUP BY g, model_id) k ON k.g = q.g AND k.model_id = q.model_id""")


DATED = """SELECT d.calculation_date, a.* FROM averages a JOIN rounds r ON r.id = a.round_id
JOIN snapshot_days d ON d.calculation_date >= CAST(r.registration_start AS DATE)"""
season("fixed", "SELECT CAST(NULL AS DATE) AS calculation_date, * FROM averages", "averages", 2)
season("daily", DATED, "averages rounds snapshot_days", 500)

cte("rankings", "daily_summary cumulative", """
SELECT s.*, row_number() OVER (PARTITION BY s.calculation_date, s.scope_type, s.scope_id ORDER BY round(s.elo_rating_median, 9) DESC, s.model_id) AS rank_position,
  c.avg_mase, c.mase_std, c.avg_rmse, coalesce(c.evaluated_count, 0) AS evaluated_count
FROM daily_summary s LEFT JOIN cumulative c ON c.calculation_date = s.calculation_date AND c.scope_type = s.scope_type
  AND c.scope_id IS NOT DISTINCT FROM s.scope_id AND c.model_id = s.model_id""")

cte("board", "rankings models users organisations definitions", """
SELECT k.*, k.calculation_date = max(k.calculation_date) OVER (PARTITION BY k.scope_type, k.scope_id) AS is_latest, m.name AS model_name,
  m.readable_id, m.model_family, m.model_type, m.architecture, m.model_size, u.username, o.name AS organization_name,
  d.id AS definition_id, d.name AS definition_name, d.schedule_id AS definition_schedule_id
FROM rankings k JOIN models m ON m.id = k.model_id JOIN users u ON u.id = m.user_id LEFT JOIN organisations o ON o.id = m.organization_id
LEFT JOIN definitions d ON k.scope_type = 'definition' AND k.scope_id = CAST(d.id AS VARCHAR)""")

cte("history", "", f"""
SELECT s.series_id, e.ts, v.value, CAST(0 AS SMALLINT) AS quality_code, v.valid_from, v.valid_to, v.is_current
FROM events e, LATERAL (SELECT CAST({TYPE_ID.replace('event_type', 'e.event_type')} AS INTEGER) AS series_id UNION ALL SELECT CAST(100000 + e.user_id AS INTEGER)) s,
LATERAL (SELECT CASE WHEN e.event_type = 'error' THEN e.value * 0.97::DOUBLE ELSE e.value END AS value, e.ts + INTERVAL 1 HOUR AS valid_from,
    CASE WHEN e.event_type = 'error' THEN e.ts + INTERVAL 1 DAY END AS valid_to, e.event_type <> 'error' AS is_current
  UNION ALL SELECT e.value, e.ts + INTERVAL 1 DAY, NULL, true WHERE e.event_type = 'error') v""")

cte("submissions", "forecasts models rounds pseudo", """
SELECT CASE WHEN (f.round_id * 2 + f.model_id) % 29 = 0 THEN f.round_id + 1000000 ELSE f.round_id END AS round_id, m.name AS model_name,
  CASE WHEN (f.round_id + f.model_id) % 17 = 0 THEN 3 - m.user_id ELSE m.user_id END AS user_id,
  CASE WHEN (f.round_id + f.series_id + f.model_id) % 11 = 0 THEN 'nope_' || f.series_id ELSE p.challenge_series_name END AS challenge_series_name,
  f.ts, f.predicted_value AS value, f.q_low, f.q_high,
  CASE WHEN (f.round_id + f.model_id) % 13 = 0 THEN r.registration_end + INTERVAL 1 HOUR
    WHEN (f.round_id + f.model_id) % 23 = 0 THEN r.registration_start - INTERVAL 1 HOUR ELSE r.registration_start + INTERVAL 10 MINUTE END AS submitted_at
FROM forecasts f JOIN models m ON m.id = f.model_id JOIN rounds r ON r.id = f.round_id
JOIN pseudo p ON p.round_id = f.round_id AND p.series_id = f.series_id
CROSS JOIN (VALUES (1), (2)) c(copy)
WHERE c.copy <= CASE WHEN f.ts = r.start_time AND (f.round_id * 3 + f.series_id + f.model_id) % 7 = 0 THEN 0
  WHEN f.ts = r.start_time AND (f.round_id * 5 + f.series_id + f.model_id) % 19 = 0 THEN 2 ELSE 1 END""")

cte("verdicts", "submissions models rounds pseudo", """
SELECT g.round_id, g.model_name, g.user_id, g.submitted_at, g.challenge_series_name, m.id AS model_id, p.series_id, g.received,
  CAST(floor(r.horizon_s / r.frequency_s) AS BIGINT) AS expected,
  CASE WHEN m.id IS NULL THEN 'model_not_owned' WHEN r.id IS NULL THEN 'unknown_round'
    WHEN r.registration_start IS NULL OR r.registration_end IS NULL THEN 'window_not_configured'
    WHEN g.submitted_at < r.registration_start THEN 'registration_not_started' WHEN g.submitted_at > r.registration_end THEN 'registration_ended'
    WHEN p.series_id IS NULL THEN 'unknown_series' WHEN g.received <> floor(r.horizon_s / r.frequency_s) THEN 'wrong_point_count' END AS error
FROM (SELECT round_id, model_name, user_id, submitted_at, challenge_series_name, count(*) AS received FROM submissions GROUP BY ALL) g
LEFT JOIN models m ON m.name = g.model_name AND m.user_id = g.user_id LEFT JOIN rounds r ON r.id = g.round_id
LEFT JOIN pseudo p ON p.round_id = g.round_id AND p.challenge_series_name = g.challenge_series_name""")

cte("accepted", "submissions verdicts", """
SELECT round_id, model_id, series_id, ts, predicted_value, created_at, q_low, q_high FROM (
  SELECT v.round_id, v.model_id, v.series_id, s.ts, s.value AS predicted_value, s.submitted_at AS created_at, s.q_low, s.q_high,
    row_number() OVER (PARTITION BY v.round_id, v.model_id, v.series_id, s.ts ORDER BY s.submitted_at, s.value) AS rn
  FROM submissions s JOIN verdicts v ON v.round_id = s.round_id AND v.model_name = s.model_name AND v.user_id = s.user_id
    AND v.submitted_at = s.submitted_at AND v.challenge_series_name = s.challenge_series_name WHERE v.error IS NULL) WHERE rn = 1""")

cte("price_events", "", """
SELECT 'st-' || (user_id % 10) AS station, CASE WHEN event_type IN ('click', 'signup') THEN 'e5' WHEN event_type = 'view' THEN 'e10' ELSE 'diesel' END AS fuel,
  ts, round(1 + floor(value / 50) / 10, 2) AS price FROM events""")
