"""Keyed writes: each statement gives the table as it is after the write."""

from oracles.base import AS_OF, LATE, statement

ORACLES: dict[str, str] = {}

ORACLES["upsert_points"] = statement("points", f"""
SELECT series_id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN round(value + 1, 6) ELSE round(value, 6) END AS value,
  CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN {AS_OF} ELSE TIMESTAMP '2024-01-20' END AS updated_at FROM points""")
ORACLES["insert_ignore_events"] = """
SELECT user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1
  AND ts >= TIMESTAMP '2024-01-03'"""
ORACLES["upsert_scores"] = statement("late_scores", f"""
SELECT round_id, model_id, series_id, round(mase, 6) AS mase, final_evaluation, evaluation_status, {LATE} AS calculated_at FROM late_scores""")
ORACLES["upsert_rankings"] = statement("rankings", """
SELECT calculation_date, model_id, scope_type, scope_id, CAST(rank_position + CASE WHEN scope_type <> 'definition' THEN 1 ELSE 0 END AS INTEGER) AS rank_position FROM rankings""")
ORACLES["upsert_series_pseudo"] = statement("pseudo", """
SELECT round_id, series_id, CASE WHEN value_std > 30 THEN 'new_' ELSE '' END || challenge_series_name AS challenge_series_name, max_ts FROM pseudo""")
ORACLES["finalise_scores"] = statement("scores", """
SELECT round_id, final_evaluation OR half AS final_evaluation, count(*) AS n FROM (
  SELECT *, count(*) FILTER (evaluation_status = 'complete') OVER (PARTITION BY round_id) * 2 > count(*) OVER (PARTITION BY round_id) AS half FROM scores)
GROUP BY ALL""")
_DOOMED = "(SELECT round_id, model_id, series_id FROM late_scores WHERE evaluation_status = 'insufficient_data')"
ORACLES["delete_forecasts"] = statement("forecasts late_scores", f"""
SELECT f.round_id, f.model_id, f.series_id, f.ts, round(f.predicted_value, 6) AS predicted_value FROM forecasts f ANTI JOIN {_DOOMED} d
USING (round_id, model_id, series_id)""")
ORACLES["deleted_forecasts"] = statement("forecasts late_scores", f"""
SELECT round_id, model_id, series_id, count(*) AS deleted FROM forecasts SEMI JOIN {_DOOMED} d USING (round_id, model_id, series_id) GROUP BY ALL""")
ORACLES["cancel_rounds"] = statement("rounds late_scores", """
SELECT id, is_cancelled OR id IN (SELECT round_id FROM late_scores GROUP BY round_id
  HAVING count(*) FILTER (evaluation_status = 'insufficient_data') > 0.25 * count(*)) AS is_cancelled FROM rounds""")
ORACLES["update_round_times"] = statement("rounds forecasts", """
SELECT r.id, coalesce(f.a, r.start_time) AS start_time, coalesce(f.b, r.end_time) AS end_time FROM rounds r
LEFT JOIN (SELECT round_id, min(ts) AS a, max(ts) AS b FROM forecasts GROUP BY round_id) f ON f.round_id = r.id""")
ORACLES["create_rounds_if_absent"] = statement("created", """
SELECT id, name, created_at FROM created WHERE registration_start >= TIMESTAMP '2024-01-18'""")

_PARTS = """(SELECT p_partkey AS series_id, 'part-' || p_partkey AS unique_id, p_size, p_name AS name, p_brand AS description,
    CAST(p_size * 60 AS BIGINT) AS frequency_s, 'piece' AS unit, '1 day' AS update_frequency, CAST(NULL AS VARCHAR) AS imputation_policy, p_type AS domain,
    CASE WHEN p_size > 10 THEN p_brand END AS category, CASE WHEN p_retailprice > 950 THEN 'dear' END AS subcategory FROM part)"""
_KNOWN = f"""(SELECT domain, category, subcategory, CAST(length(domain) * 10000 + length(coalesce(category, '')) * 100 + ascii(coalesce(subcategory, '-')) AS BIGINT) AS id
  FROM (SELECT DISTINCT domain, category, subcategory FROM {_PARTS} WHERE p_size <= 20))"""
_NEW_ID = "CAST(('0x' || substr(md5(p.domain || '|' || coalesce(p.category, '') || '|' || coalesce(p.subcategory, '')), 1, 15)) AS BIGINT)"
_MATCH = "k.domain = p.domain AND k.category IS NOT DISTINCT FROM p.category AND k.subcategory IS NOT DISTINCT FROM p.subcategory"
_RESOLVED = f"(SELECT p.*, coalesce(k.id, {_NEW_ID}) AS category_id, k.id IS NULL AS is_new FROM {_PARTS} p LEFT JOIN {_KNOWN} k ON {_MATCH})"
ORACLES["resolve_categories"] = f"SELECT unique_id, domain, category, subcategory, category_id FROM {_RESOLVED}"
ORACLES["added_categories"] = f"SELECT DISTINCT category_id AS id, domain, category, subcategory FROM {_RESOLVED} WHERE is_new"
ORACLES["upsert_catalogue"] = f"""
SELECT CASE WHEN p_size <= 25 THEN series_id + 7000000 ELSE series_id END AS series_id, unique_id, name, description, frequency_s, unit,
  update_frequency, imputation_policy, category_id FROM {_RESOLVED}"""
ORACLES["update_timezone"] = """
SELECT c_name AS unique_id, CASE WHEN c_nationkey % 3 = 0 THEN 'Europe/Berlin' WHEN c_nationkey % 3 = 1 THEN 'UTC'
  WHEN c_name LIKE '%7' THEN 'UTC' END AS ts_timezone FROM customer"""
ORACLES["upsert_definitions"] = """
SELECT n_nationkey AS id, 's-' || n_name AS schedule_id, n_name AS name, coalesce(c.n, 100) AS context_length, true AS is_active
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = n_nationkey"""
ORACLES["register_models"] = """
SELECT o.o_custkey AS user_id, o.o_orderpriority AS name,
  CASE WHEN c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'P' THEN 99 ELSE c.c_nationkey END AS organization_id, o.o_orderkey AS order_key
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE (o.o_custkey, o.o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F')
QUALIFY row_number() OVER (PARTITION BY o.o_custkey, o.o_orderpriority ORDER BY o.o_orderdate, o.o_orderkey) = 1"""
