"""Normalisers, straight from the tables the payloads were made of."""

from oracles.base import statement

ORACLES: dict[str, str] = {}

_UNIT = "'ev-' || event_type AS unique_id"
_VALUE = "CASE WHEN value >= 5 THEN value END AS value"
ORACLES["normalise_points"] = f"SELECT {_UNIT}, ts, value FROM events"
ORACLES["normalise_wide"] = """
SELECT unique_id, ts, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT 'quantity' AS unique_id, l_shipdate AS ts, l_quantity AS value FROM lineitem
  UNION ALL SELECT 'quantity-a', l_shipdate, l_quantity FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT 'price', l_shipdate, l_extendedprice FROM lineitem
  UNION ALL SELECT 'discount-r-o', l_shipdate, l_discount FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 'tax-o', l_shipdate, l_tax FROM lineitem WHERE l_linestatus = 'O') GROUP BY unique_id, ts"""
ORACLES["normalise_long"] = f"SELECT {_UNIT}, ts, {_VALUE} FROM events WHERE event_type <> 'signup'"
ORACLES["normalise_single"] = "SELECT 'us-' || user_id AS unique_id, ts, value FROM events"
ORACLES["normalise_pairs"] = """
SELECT unique_id, ts, value FROM (
  SELECT 'ev-' || event_type AS unique_id, date_trunc('millisecond', ts) AS ts, CASE WHEN value >= 5 THEN value END AS value FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('millisecond', ts) ORDER BY ts) = 1)
WHERE value IS NOT NULL AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-27'"""
ORACLES["normalise_records"] = f"SELECT {_UNIT}, ts, value FROM events WHERE value >= 5"
ORACLES["normalise_market_xml"] = """
SELECT 'ev-' || event_type AS unique_id, date_trunc('hour', min(ts) OVER (PARTITION BY event_type, event_id // 64))
  + (row_number() OVER (PARTITION BY event_type, event_id // 64 ORDER BY ts) - 1)
  * CASE event_type WHEN 'click' THEN INTERVAL 1 HOUR WHEN 'view' THEN INTERVAL 15 MINUTE ELSE INTERVAL 1 MINUTE END AS ts, value FROM events"""
ORACLES["normalise_garages"] = """
SELECT 'g-' || user_id AS unique_id, CASE WHEN event_type = 'signup' THEN max(ts) OVER (PARTITION BY event_id // 64) ELSE date_trunc('minute', ts) END AS ts,
  floor(value) AS value FROM events QUALIFY event_type <> 'error'
UNION ALL SELECT 'g-total', max(ts), sum(floor(value)) FILTER (event_type <> 'error') FROM events GROUP BY event_id // 64
  HAVING count(*) FILTER (event_type <> 'error') > 0"""
ORACLES["normalise_stations"] = """
SELECT event_type || '-' || m.metric AS unique_id, t.poll_ts AS ts,
  CAST(CASE m.metric WHEN 'free_bikes' THEN t.free WHEN 'empty_slots' THEN t.slots WHEN 'ebikes' THEN t.ebikes ELSE t.normal END AS DOUBLE) AS value
FROM (SELECT event_type, max(ts) AS poll_ts, sum(CASE WHEN value >= 5 THEN floor(value) ELSE 0 END) AS free, sum(user_id % 20) AS slots,
    sum(CASE WHEN user_id % 4 = 0 THEN 0 WHEN user_id % 3 <> 0 AND user_id % 5 <> 0 THEN user_id % 5 ELSE user_id % 7 END) AS ebikes,
    sum(CASE WHEN user_id % 4 <> 0 AND value > 10 THEN user_id % 11 ELSE 0 END) AS normal
  FROM events GROUP BY event_type, event_id // 64) t, (VALUES ('free_bikes'), ('empty_slots'), ('ebikes'), ('normal_bikes')) m(metric)"""
ORACLES["normalise_live_prices"] = """
WITH one AS (SELECT event_id // 64 AS page, user_id, max(value) AS v, bool_or(event_type = 'error') AS shut, min(ts) AS ts FROM events GROUP BY ALL),
polls AS (SELECT page, time_bucket(INTERVAL '10 minutes', min(ts)) AS ts FROM one GROUP BY page),
prices AS (SELECT p.ts, o.user_id, f.fuel, CASE f.fuel WHEN 'e5' THEN 1 + floor(o.v / 10) / 8 WHEN 'e10' THEN CASE WHEN o.user_id % 2 = 1 THEN 0.5 + floor(o.v / 10) / 8 END
    ELSE floor(o.v / 10) / 8 END AS price
  FROM one o JOIN polls p ON p.page = o.page, (VALUES ('e5'), ('e10'), ('diesel')) f(fuel) WHERE NOT o.shut AND o.user_id % 10 <> 9),
good AS (SELECT * FROM prices WHERE price > 0 AND price < 5)
SELECT 'c-' || (user_id % 5) || '-' || fuel AS unique_id, ts, price AS value FROM good WHERE user_id % 3 = 0 AND user_id % 5 < 4
UNION ALL SELECT 'national-' || fuel, ts, round(avg(price), 4) FROM good GROUP BY fuel, ts"""
ORACLES["read_price_csv"] = """
SELECT 'st-' || user_id AS station, date_trunc('second', ts) AS ts, CASE WHEN event_type IN ('click', 'signup') THEN 'e5' WHEN event_type = 'view' THEN 'e10' ELSE 'diesel' END AS fuel,
  round(1 + floor(value / 50) / 10, 2) AS price FROM events WHERE user_id % 10 <> 9"""
ORACLES["union_slices"] = """
SELECT event_id, ts, value, CASE WHEN date_diff('day', (SELECT min(ts) FROM events), ts) % 2 = 0 THEN user_id END AS user_id FROM events"""
ORACLES["resolve_series"] = "SELECT CAST(100000 + user_id AS INTEGER) AS series_id, ts, value FROM events WHERE user_id % 10 <> 3"
ORACLES["unknown_series"] = "SELECT DISTINCT 'lost-' || user_id AS unique_id FROM events WHERE user_id % 10 = 3"
ORACLES["load_catalogue"] = """
SELECT 'part-' || p_partkey AS unique_id, CASE WHEN p_size % 2 = 1 THEN 'group-' || p_brand END AS group_id,
  CASE WHEN p_size % 3 <> 0 THEN p_name ELSE 'part-' || p_partkey END AS name, '' AS description,
  CAST(CASE p_size % 4 WHEN 0 THEN 900 WHEN 2 THEN 86400 ELSE 3600 END AS BIGINT) AS frequency_s, 'EUR' AS unit, p_type AS domain,
  CASE WHEN p_size % 5 = 0 THEN 'metal' WHEN p_size % 8 = 0 THEN 'electricity' END AS subdomain,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS category, CASE WHEN p_size > 25 THEN 'large' END AS subcategory,
  CASE WHEN p_size % 7 = 0 THEN 'linear' END AS imputation_policy,
  CASE WHEN p_size % 9 = 0 THEN '5 minutes' WHEN p_size % 6 = 0 THEN '30 minutes' ELSE '15 minutes' END AS update_frequency,
  CAST(CASE WHEN p_size % 9 = 0 THEN 300 WHEN p_size % 6 = 0 THEN 1800 ELSE 900 END AS BIGINT) AS interval_s
FROM part WHERE p_size <> 13"""
