"""Rollups, scans, catalogue, availability, gap filling and resampling."""

from oracles.base import AS_OF, statement

ORACLES: dict[str, str] = {}

for _n in ("15min", "1h", "1d"):
    ORACLES[f"rollup_{_n}"] = statement(f"rollup_{_n}", f"SELECT * REPLACE (round(value, 6) AS value) FROM rollup_{_n}")
ORACLES["rollup_all"] = statement("rollups", "SELECT * REPLACE (round(value, 6) AS value) FROM rollups")

ORACLES["rollup_refresh"] = statement("points", f"""
SELECT series_id, ts, round(avg(v), 6) AS value, count(*) AS sample_count, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value
FROM (SELECT series_id, date_trunc('hour', ts) AS ts,
    CASE WHEN ts >= {AS_OF} - INTERVAL 2 DAY AND ts < {AS_OF} - INTERVAL 1 HOUR THEN value ELSE value + 1000 END AS v FROM points)
GROUP BY series_id, ts""")

ORACLES["range_scan"] = statement("points", """
SELECT series_id, ts, value FROM points WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
ORACLES["scan_by_resolution"] = statement("rollup_15min", """
SELECT series_id, ts, round(value, 6) AS value, sample_count FROM rollup_15min WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
ORACLES["scan_unknown_resolution"] = statement("points", f"""
SELECT series_id, ts, value, CAST(1 AS BIGINT) AS sample_count FROM points WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND {AS_OF}""")
ORACLES["series_data_for_rounds"] = statement("rounds pseudo rollups", """
SELECT p.round_id, x.resolution, x.series_id, x.ts, round(x.value, 6) AS value, x.sample_count
FROM pseudo p JOIN rounds r ON r.id = p.round_id
JOIN rollups x ON x.series_id = p.series_id AND x.resolution = CASE r.frequency_s WHEN 900 THEN '15min' WHEN 3600 THEN '1h' ELSE '1d' END
WHERE x.ts BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-16'""")
ORACLES["get_data_default_window"] = statement("series rollup_1h", f"""
SELECT s.unique_id, x.series_id, x.ts, round(x.value, 6) AS value, x.sample_count FROM rollup_1h x JOIN series s USING (series_id)
WHERE x.ts BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}""")
ORACLES["point_summary"] = statement("points", "SELECT series_id, max(ts) AS latest_ts, count(*) AS n_points FROM points GROUP BY series_id")
ORACLES["latest_per_series"] = statement("points", """
SELECT series_id, ts, value FROM points QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) = 1""")
ORACLES["last_n_points"] = statement("points", """
SELECT series_id, ts, value FROM points QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 100""")
ORACLES["last_n_points_before"] = statement("points", f"""
SELECT series_id, ts, value FROM points WHERE ts < {AS_OF} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 40""")
ORACLES["numbered_points"] = statement("points", "SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos FROM points")
ORACLES["value_changes"] = """
SELECT user_id, ts, event_type FROM events
QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts)"""
ORACLES["value_carry"] = """
SELECT user_id, ts, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events"""
ORACLES["as_of_values"] = """
SELECT e.event_id, e.user_id, e.ts, p.ts AS bought_ts, p.value AS bought FROM events e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts <= e.ts"""

ORACLES["data_availability"] = statement("availability", "SELECT * FROM availability")
ORACLES["completeness"] = statement("series points", """
SELECT s.series_id, coalesce(n, 0) AS n_points, CAST(8 AS BIGINT) AS expected_points, round(coalesce(n, 0) / 8.0, 6) AS ratio,
  coalesce(n, 0) > 0 AND coalesce(n, 0) / 8.0 >= 0.9 AS is_complete
FROM series s LEFT JOIN (SELECT series_id, count(*) AS n FROM points WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15'
  GROUP BY series_id) c USING (series_id)""")
ORACLES["completeness_existence"] = statement("series points", """
SELECT s.series_id, coalesce(n, 0) AS n_points, coalesce(n, 0) > 0 AS is_complete
FROM series s LEFT JOIN (SELECT series_id, count(*) AS n FROM points WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-08 06:00:00'
  GROUP BY series_id) c USING (series_id)""")
ORACLES["completeness_all"] = statement("series points", """
SELECT bool_and(coalesce(n, 0) > 0 AND coalesce(n, 0) / 31.0 >= 0.5) AS all_complete
FROM series s LEFT JOIN (SELECT series_id, count(*) AS n FROM points WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'
  GROUP BY series_id) c USING (series_id)""")
ORACLES["usable_series"] = statement("series", "SELECT series_id, frequency_s FROM series WHERE frequency_s <= 3600")
_COUNTS = "(SELECT series_id, count(*) AS n FROM points GROUP BY series_id)"
ORACLES["backfill_plan"] = statement("series points", f"""
SELECT unique_id, series_id, n_points, lookback_s, {AS_OF} - to_seconds(lookback_s) AS start_ts FROM (
  SELECT s.unique_id, s.known AS series_id, coalesce(c.n, 0) AS n_points,
    CAST(CASE WHEN s.known IS NOT NULL AND coalesce(c.n, 0) < 1000 THEN least((1000 - coalesce(c.n, 0)) * s.frequency_s, 30 * 86400)
      ELSE 86400 END AS BIGINT) AS lookback_s
  FROM (SELECT *, CASE WHEN series_id % 9 <> 4 THEN series_id END AS known FROM series) s LEFT JOIN {_COUNTS} c ON c.series_id = s.known)""")
ORACLES["backfill_plan_grouped"] = statement("series points", f"""
SELECT group_id, max_needed, min_interval_s, lookback_s, {AS_OF} - to_seconds(lookback_s) AS start_ts FROM (
  SELECT *, CAST(CASE WHEN max_needed > 0 THEN least(max_needed * min_interval_s, 30 * 86400) ELSE 86400 END AS BIGINT) AS lookback_s FROM (
    SELECT s.category_id AS group_id,
      CAST(max(CASE WHEN s.known IS NULL THEN 1000 ELSE greatest(1000 - coalesce(c.n, 0), 0) END) AS BIGINT) AS max_needed,
      min(s.frequency_s) AS min_interval_s
    FROM (SELECT *, CASE WHEN series_id % 9 <> 4 THEN series_id END AS known FROM series) s LEFT JOIN {_COUNTS} c ON c.series_id = s.known
    GROUP BY s.category_id))""")


def _imputed(source: str) -> str:
    """Rows of ``source`` (series_id, ts, value, step in seconds) and the rows added between neighbours."""
    return f"""
  SELECT series_id, ts, value, CAST(0 AS SMALLINT) AS quality_code FROM {source}
  UNION ALL
  SELECT series_id, ts + to_seconds(i * step), CASE WHEN gap <= 6 * step * 1000000 THEN value + (next_value - value) * (i / (n + 1)) END,
    CAST(1 AS SMALLINT)
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (
    SELECT *, gap // (step * 1000000) - 1 AS n FROM (
      SELECT *, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap, lead(value) OVER w AS next_value FROM {source}
      WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE gap * 2 > step * 3000000))"""


_RAW = "(SELECT series_id, ts, value, CAST(CASE WHEN series_id < 100000 THEN 900 ELSE 86400 END AS BIGINT) AS step FROM points)"
_HOURLY = "(SELECT series_id, ts, value, CAST(3600 AS BIGINT) AS step FROM rollup_1h)"
ORACLES["impute_gaps"] = statement("points", f"SELECT series_id, ts, round(value, 6) AS value, quality_code FROM ({_imputed(_RAW)})")
ORACLES["imputation_counts"] = statement("points", f"""
SELECT series_id, count(*) FILTER (quality_code = 0) AS original_count, count(*) FILTER (quality_code = 1 AND value IS NOT NULL) AS interpolated_count,
  count(*) FILTER (quality_code = 1 AND value IS NULL) AS null_marker_count FROM ({_imputed(_RAW)}) GROUP BY series_id""")
ORACLES["imputed_operational"] = statement("rollup_1h", f"""
SELECT series_id, ts, round(value, 6) AS value, quality_code FROM ({_imputed(_HOURLY)}) WHERE value IS NOT NULL""")

RESAMPLED = """
SELECT g.station, g.fuel, g.ts, CASE WHEN c.price IS NULL AND i.n IS NULL THEN NULL
  ELSE (coalesce(c.price, 0) + coalesce(i.total, 0)) / ((CASE WHEN c.price IS NULL THEN 0 ELSE 1 END) + coalesce(i.n, 0)) END AS price
FROM (SELECT k.station, k.fuel, t.ts FROM (SELECT DISTINCT station, fuel FROM price_events) k,
    (SELECT unnest(range((SELECT date_trunc('day', min(ts)) FROM events)::TIMESTAMP, (SELECT date_trunc('day', max(ts)) FROM events)::TIMESTAMP + INTERVAL 1 DAY,
      INTERVAL 10 MINUTE)) AS ts) t) g
ASOF LEFT JOIN price_events c ON c.station = g.station AND c.fuel = g.fuel AND c.ts <= g.ts
LEFT JOIN (SELECT station, fuel, time_bucket(INTERVAL '10 minutes', ts) AS bin, count(*) AS n, sum(price) AS total FROM (
    SELECT *, lag(price) OVER (PARTITION BY station, fuel ORDER BY ts) AS before FROM price_events)
  WHERE price IS DISTINCT FROM before AND ts <> time_bucket(INTERVAL '10 minutes', ts)
  GROUP BY station, fuel, time_bucket(INTERVAL '10 minutes', ts)) i ON i.station = g.station AND i.fuel = g.fuel AND i.bin = g.ts"""
ORACLES["resample_events"] = statement("price_events", f"""
SELECT station, fuel, ts, round(price, 4) AS price FROM ({RESAMPLED}) WHERE price IS NOT NULL""")
ORACLES["national_mean"] = statement("price_events", f"""
SELECT fuel, ts, round(CAST(CAST(sum(CAST(price AS DECIMAL(20, 8))) AS DOUBLE) / count(*) AS DECIMAL(38, 10)), 4)::DOUBLE AS price FROM ({RESAMPLED}) WHERE price IS NOT NULL GROUP BY fuel, ts""")
ORACLES["late_retention"] = statement("points", "SELECT series_id, ts, value FROM points WHERE ts >= TIMESTAMP '2024-01-20'")
ORACLES["metadata_filter"] = statement("series category", """
SELECT s.series_id, s.name, s.unit FROM series s JOIN category c ON c.id = s.category_id WHERE c.domain IN ('people', 'traffic') AND s.unit = 'money'""")
ORACLES["date_filter"] = statement("points", """
SELECT series_id, ts, value FROM points WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""")
