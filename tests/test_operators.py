"""Branches, brute-force comparisons and invariants on small hand-made tables."""

from __future__ import annotations

import math
import random
import re
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from forescale.operators import elo, forecasts, history, imputation, ordered, ranking, resample, rollup, rounds, scoring, upsert
from forescale.plans.world import world
from forescale.sources import scans

T0 = datetime(2024, 1, 1)
POINTS = "series_id int, ts timestamp, value double"


def at(**parts):
    return T0 + timedelta(**parts)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# Ordered operators: one series holds most rows, one minute most of those.

@pytest.fixture(scope="module")
def hot():
    rng = random.Random(7)
    data = [(1, at(seconds=rng.randrange(60), microseconds=i), float(i % 5) if i % 3 else None) for i in range(400)]
    data += [(1, at(days=rng.randrange(40), minutes=rng.randrange(1440), microseconds=i), float(i)) for i in range(150)]
    data += [(2, at(hours=5 * i), float(i)) for i in range(30)] + [(3, at(days=3), 1.0)]
    return sorted(set(data), key=lambda r: (r[0], r[1]))


def by_series(data):
    out = {}
    for series, ts, value in data:
        out.setdefault(series, []).append((ts, value))
    return out


@pytest.mark.parametrize("chunks", [ordered.WHOLE, ordered.DAYS, ordered.CHUNKS, ("day", "hour", "second")])
def test_positions_and_neighbours(table, hot, chunks):
    df = table(hot, POINTS)
    want = {(s, ts): i for s, group in by_series(hot).items() for i, (ts, _) in enumerate(group, 1)}
    got = {(r["series_id"], r["ts"]): r["pos"] for r in ordered.number_rows(df, ["series_id"], "ts", chunks=chunks).collect()}
    assert got == want
    after = {}
    for s, group in by_series(hot).items():
        for here, there in zip(group, [*group[1:], (None, None)]):
            after[s, here[0]] = there
    linked = ordered.next_row(df, ["series_id"], "ts", {"t": "ts", "v": "value"}, chunks).collect()
    assert {(r["series_id"], r["ts"]): (r["t"], r["v"]) for r in linked} == after


def test_forward_fill_changes_and_last(table, hot):
    df = table(hot, POINTS)
    filled, changed, newest = {}, set(), set()
    for s, group in by_series(hot).items():
        known, before = None, object()
        for ts, value in group:
            known = value if value is not None else known
            filled[s, ts] = known
            if value != before:
                changed.add((s, ts))
            before = value
        newest |= {(s, ts) for ts, _ in group[-37:]}
    got = ordered.forward_fill(df, ["series_id"], "ts", "value").collect()
    assert {(r[0], r[1]): r[2] for r in got} == filled
    assert {(r[0], r[1]) for r in ordered.changes_only(df, ["series_id"], "ts", "value").collect()} == changed
    assert {(r[0], r[1]) for r in scans.last_points(df, 37).collect()} == newest


def test_as_of_join(table, hot):
    left = table([(s, at(hours=h, minutes=1)) for s in (1, 2, 4) for h in range(0, 900, 7)], "series_id int, t timestamp")
    got = ordered.as_of_join(left, table(hot, POINTS), ["series_id"], "t", "ts", ["ts", "value"]).collect()
    groups = by_series(hot)
    assert len(got) == left.count()
    for r in got:
        earlier = [p for p in groups.get(r["series_id"], []) if p[0] <= r["t"]]
        assert (r["ts"], r["value"]) == (earlier[-1] if earlier else (None, None))


def test_keep_one_is_order_free(table):
    data = [(1, i % 3, float(i)) for i in range(50)]
    random.Random(1).shuffle(data)
    df = table(data, "k int, seq int, v double")
    assert rows(ordered.keep_one(df, ["k"], ["seq"]), "k") == [(1, 2, 47.0)]
    assert rows(ordered.keep_one(df, ["k"], ["seq"], last=False), "k") == [(1, 0, 0.0)]


def test_unroll_covers_long_runs(table):
    df = ordered.unroll(table([(1, 0), (2, 9_999)], "k int, n int"), F.col("n"), "i")
    assert rows(df.groupBy("k").agg(F.count("*"), F.min("i"), F.max("i"), F.countDistinct("i")), "k") == [(1, 1, 0, 0, 1), (2, 10000, 0, 9999, 10000)]


# Gap filling

def impute(table, instants, frequency=900, **kwargs):
    df = table([(1, ts, v, frequency) for ts, v in instants], "series_id int, ts timestamp, value double, frequency_s long")
    return rows(imputation.impute_gaps(df, **kwargs).select("ts", "value", "quality_code"), "ts")


def test_small_gap_is_interpolated(table):
    got = impute(table, [(T0, 1.0), (at(hours=1), 5.0)])
    assert [(r[1], r[2]) for r in got] == [(1.0, 0), (2.0, 1), (3.0, 1), (4.0, 1), (5.0, 0)]


def test_large_gap_gets_markers(table):
    got = impute(table, [(T0, 1.0), (at(hours=4), 5.0)])
    assert len(got) == 17 and [r[1] for r in got[1:16]] == [None] * 15 and {r[2] for r in got[1:16]} == {1}


@pytest.mark.parametrize("minutes, added", [(15, 0), (22.5, 0), (25, 0), (30, 1), (90, 5), (91, 5)])
def test_gap_classes(table, minutes, added):
    got = impute(table, [(T0, 0.0), (at(minutes=minutes), 6.0)])
    assert len(got) == 2 + added
    if minutes == 91:
        assert all(r[1] is None for r in got[1:-1])


def test_pass_through(table):
    assert len(impute(table, [(T0, 0.0), (at(hours=1), 6.0)], enabled=False)) == 2
    assert impute(table, [(T0, None)]) == [(T0, None, 0)]
    assert len(impute(table, [(T0, None), (at(hours=1), 1.0), (at(hours=2), 2.0)])) == 5
    with pytest.raises(ValueError):
        impute(table, [(T0, 0.0)], method="spline")


# Resampling

def bins(table, events, hours=1):
    df = table([("s", "e5", ts, p) for ts, p in events], "station string, fuel string, ts timestamp, price double")
    return {r["ts"]: r["price"] for r in resample.rounded(resample.resample_events(df, T0, at(hours=hours))).collect()}


def test_bin_mean_with_carry_in(table):
    got = bins(table, [(at(minutes=-5), 1.5), (at(minutes=12), 1.6), (at(minutes=18), 1.7)])
    assert got[at(minutes=0)] == 1.5 and got[at(minutes=10)] == 1.6 and got[at(minutes=20)] == 1.7 and len(got) == 6


def test_event_on_bin_start_is_carry_in(table):
    got = bins(table, [(at(minutes=10), 1.4), (at(minutes=15), 1.6)])
    assert at(minutes=0) not in got and got[at(minutes=10)] == 1.5 and got[at(minutes=20)] == 1.6


def test_resample_brute_force(table):
    rng = random.Random(3)
    events = sorted({at(minutes=rng.randrange(-60, 600), seconds=rng.choice([0, 0, 30])): rng.choice([1.1, 1.2, 1.3]) for _ in range(120)}.items())
    changes = [e for i, e in enumerate(events) if i == 0 or e[1] != events[i - 1][1]]
    want = {}
    for i in range(60):
        start, end = at(minutes=10 * i), at(minutes=10 * i + 10)
        carry = [p for t, p in events if t <= start][-1:]
        inside = [p for t, p in changes if start < t < end]
        if carry or inside:
            want[start] = round(sum(carry + inside) / len(carry + inside), 4) if inside else carry[0]
    got = bins(table, events, hours=10)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-4 for k in want)


# Rollups

def test_rollups_agree_and_refresh_keeps_old_rows(table, hot):
    df = table([r for r in hot if r[2] is not None], POINTS)
    assert rollup.rollup_all(df).filter("resolution = '1h'").agg(F.sum("sample_count")).first()[0] == df.count()
    single = rows(rollup.rollup(df, 3600).select("series_id", "ts", F.round("value", 9), "sample_count"), "series_id", "ts")
    shared = rows(rollup.rollup_all(df).filter("resolution = '1h'").select("series_id", "ts", F.round("value", 9), "sample_count"), "series_id", "ts")
    assert single == shared
    old = table([(2, at(hours=h), -1.0, 1, -1.0, -1.0) for h in range(0, 120, 5)], "series_id int, ts timestamp, value double, sample_count long, min_value double, max_value double")
    fresh = {r["ts"]: r["value"] for r in rollup.refresh(old, df.filter("series_id = 2"), "1h", at(hours=100, minutes=30)).collect()}
    assert fresh[at(hours=50)] == -1.0 and fresh[at(hours=55)] == 11.0 and fresh[at(hours=95)] == 19.0 and fresh[at(hours=100)] == -1.0


# Rounds

ROUND = "id int, definition_id int, name string, context_length int, horizon_s long, frequency_s long, registration_start timestamp, registration_end timestamp, start_time timestamp, end_time timestamp, is_cancelled boolean, created_at timestamp"


def a_round(number, cancelled=False, frequency=3600, n=4, start=T0, horizon=86400):
    end = start + timedelta(hours=1)
    return (number, 1, f"r{number}", n, horizon, frequency, start, end, end, end + timedelta(seconds=horizon), cancelled, start)


DEFINITION = "id int, schedule_id string, name string, domains array<string>, subdomains array<string>, categories array<string>, subcategories array<string>, context_length int, horizon_s long, frequency_s long, registration_s long, n_time_series int, is_active boolean"


def a_definition(number=1, domains=(), n=2, frequency=3600):
    return (number, f"s{number}", f"d{number}", list(domains), [], [], [], 4, 86400, frequency, None, n, True)


@pytest.mark.parametrize("moment, status", [
    (at(minutes=-1), "undefined"), (T0, "registration"), (at(hours=1), "registration"), (at(hours=1, seconds=1), "active"),
    (at(hours=25), "active"), (at(hours=25, seconds=1), "completed"),
])
def test_round_status(table, moment, status):
    df = table([a_round(1), a_round(2, cancelled=True)], ROUND)
    got = rows(rounds.round_status(df, table([a_definition()], DEFINITION), moment).select("id", "computed_status", "status"), "id")
    assert got == [(1, status, status), (2, status, "cancelled")]


def test_eligible_series(table):
    available = table(
        [(1, 900, "a", None, "x", "y", True), (2, 3600, "b", "s", "x", None, True), (3, 86400, "a", None, "x", "y", True), (4, 900, "a", None, "x", "y", False)],
        "series_id int, frequency_s long, domain string, subdomain string, category string, subcategory string, has_recent_data boolean",
    )
    definitions = table([a_definition(1), a_definition(2, ["a"]), a_definition(3, ["a", "mixed"]), a_definition(4, ["z"])], DEFINITION)
    assert rows(rounds.eligible_series(definitions, available), "definition_id", "series_id") == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]


def test_sample_is_seeded_and_exact(table):
    import hashlib

    definitions = table([a_definition(n=5)], DEFINITION)
    eligible = table([(1, s) for s in range(300)], "definition_id int, series_id int")
    none = table([], "definition_id int, series_id int, is_current boolean")
    got = {r["series_id"] for r in rounds.choose_series(table([a_round(9)], ROUND), definitions, none, eligible, 42).collect()}
    assert got == set(sorted(range(300), key=lambda s: hashlib.md5(f"42:9:{s}".encode()).hexdigest())[:5])


def test_context_is_closed_before_registration(table):
    start = at(days=2)
    hourly = [("1h", 1, at(hours=h), float(h)) for h in range(0, 72, 1) if h % 7]
    chosen = table([(1, 1, False), (2, 1, False)], "round_id int, series_id int, is_sampled boolean")
    created = table([a_round(1, start=start), a_round(2, start=start, n=1000)], ROUND)
    got = rounds.context_snapshot(created, chosen, table(hourly, "resolution string, series_id int, ts timestamp, value double"))
    before = [h for h in range(48) if h % 7]
    assert [r["value"] for r in got.filter("round_id = 1").orderBy("ts").collect()] == [float(h) for h in before[-4:]]
    assert got.filter("round_id = 2").count() == len(before)


def test_round_without_context_is_cancelled(table):
    pseudo = table([(1, 5, "x", T0, at(hours=3), 1.0, 1.0), (2, 5, "x", None, None, None, None)],
                   "round_id int, series_id int, challenge_series_name string, min_ts timestamp, max_ts timestamp, value_avg double, value_std double")
    got = rows(rounds.retime_rounds(table([a_round(1), a_round(2)], ROUND), pseudo).select("id", "start_time", "end_time", "is_cancelled"), "id")
    assert got == [(1, at(hours=4), at(hours=28), False), (2, at(hours=1), at(hours=25), True)]


def test_pages(table):
    df = table([(i,) for i in range(25)], "id int")
    assert [r["id"] for r in rounds.page(df, ["id"], 3, 10).collect()] == [20, 21, 22, 23, 24]
    assert tuple(rounds.page_info(df, 3, 10).first()) == (25, 3, False, True)
    assert rounds.page_info(df.filter("id < 0"), 1, 10).first()["total_pages"] == 1
    assert rounds.page_info(df.filter("id < 0"), 1, 10, pages_when_empty=0).first()["total_pages"] == 0


# Scores

PSEUDO = "round_id int, series_id int, max_ts timestamp"
ROLLUP = "resolution string, series_id int, ts timestamp, value double"
FORECAST = "round_id int, model_id int, series_id int, ts timestamp, predicted_value double"


def score(table, actual_hours, forecast_hours, as_of, naive=10.0, actual=12.0, predicted=11.0, with_end=True):
    rollups = [("1h", 1, at(hours=h), actual) for h in actual_hours] + ([("1h", 1, at(hours=0), naive)] if with_end else [])
    made = [(1, 1, 1, at(hours=h), predicted) for h in forecast_hours]
    got = scoring.evaluate(
        table(made, FORECAST), table([a_round(1)], ROUND), table([(1, 1, T0)], PSEUDO), table(rollups, ROLLUP), as_of
    ).collect()
    return got[0].asDict() if got else None


LATE = at(days=5)


@pytest.mark.parametrize("actual, forecast, as_of, state, final, scored", [
    (range(2, 26), range(2, 26), LATE, "complete", True, True),
    (range(2, 25), range(2, 26), LATE, "partial", True, True),
    (range(2, 20), range(2, 26), LATE, "insufficient_data", True, False),
    (range(2, 20), range(2, 26), at(hours=30), "partial", False, True),
    (range(40, 44), range(2, 26), LATE, "no_overlap", False, False),
])
def test_score_states(table, actual, forecast, as_of, state, final, scored):
    got = score(table, actual, forecast, as_of)
    assert (got["evaluation_status"], got["final_evaluation"], got["mase"] is not None) == (state, final, scored)
    if scored:
        assert got["mase"] == 0.5 and got["rmse"] == 1.0
    if state == "insufficient_data":
        assert got["error_message"] == "Timeout: only 75.0% coverage (min 95% required)"


def test_missing_context_end_is_an_error(table):
    got = score(table, range(2, 26), range(2, 26), LATE, with_end=False)
    assert (got["evaluation_status"], got["final_evaluation"], got["evaluated_count"], got["data_coverage"]) == ("error", False, 0, 0.0)


def test_zero_baseline_scores(table):
    assert score(table, range(2, 26), range(2, 26), LATE, naive=12.0)["mase"] == math.inf
    assert score(table, range(2, 26), range(2, 26), LATE, naive=12.0, predicted=12.0)["mase"] == 0.0


def test_no_forecasts_are_not_stored(table):
    assert score(table, range(2, 26), [], LATE) is None


def test_values_after_as_of_stay_unknown(table):
    assert score(table, range(2, 26), range(2, 26), at(hours=10))["evaluated_count"] == 8


# Admission

def test_admission_order(table):
    models = table([(1, 7, "m")], "id int, user_id int, name string")
    windows = [a_round(1, frequency=43200), (*a_round(2, frequency=43200)[:6], None, None, *a_round(2)[8:])]
    names = table([(1, 5, "a")], "round_id int, series_id int, challenge_series_name string")
    good, early, late = at(minutes=30), at(minutes=-1), at(hours=1, seconds=1)
    cases = {
        "ok": (1, "m", 7, "a", good, 2), "model_not_owned": (1, "m", 8, "a", good, 2), "unknown_round": (9, "m", 7, "a", good, 2),
        "window_not_configured": (2, "m", 7, "a", good, 2), "registration_not_started": (1, "m", 7, "a", early, 2),
        "registration_ended": (1, "m", 7, "a", late, 2), "unknown_series": (1, "m", 7, "b", good, 2), "wrong_point_count": (1, "m", 7, "a", good, 3),
    }
    for error, (number, name, user, series, sent, n) in cases.items():
        uploads = table([(number, name, user, series, at(hours=h), 1.0, sent) for h in range(n)],
                        "round_id int, model_name string, user_id int, challenge_series_name string, ts timestamp, value double, submitted_at timestamp")
        verdict = forecasts.admit_forecasts(uploads, models, table(windows, ROUND), names).first()
        assert verdict["error"] == (None if error == "ok" else error)


# Versions

VERSION = "series_id int, ts timestamp, value double, quality_code smallint, valid_from timestamp, valid_to timestamp, is_current boolean"
BATCH = "series_id int, ts timestamp, value double, quality_code smallint, batch_seq long"


def test_versions_keep_one_current_row_and_do_not_overlap(table, spark):
    state = table([], VERSION)
    rng = random.Random(5)
    for step in range(4):
        batch = [(s, at(hours=h), rng.choice([1.0, 2.0, None]), rng.choice([0, 1]), i) for i in range(3) for s in (1, 2) for h in range(6) if rng.random() < 0.6]
        df = table(batch, BATCH)
        merged = history.merge_points(state, df, at(days=step))
        counts = history.merge_counts(merged, df).first()
        assert counts["inserted"] + counts["unchanged_exact"] == df.select("series_id", "ts").distinct().count()
        state = table([tuple(r) for r in merged.drop("action").collect()], VERSION)
        again = history.merge_points(state, df, at(days=step)).drop("action")
        assert rows(again, *again.columns) == rows(state, *state.columns)
    by_key = {}
    for r in state.collect():
        by_key.setdefault((r["series_id"], r["ts"]), []).append((r["valid_from"], r["valid_to"], r["is_current"]))
    for versions in by_key.values():
        versions.sort()
        assert sum(v[2] for v in versions) == 1
        assert all(a[1] == b[0] for a, b in zip(versions, versions[1:]))


def test_empty_listing_closes_all(table):
    schema = "definition_id int, series_id int, is_required boolean, is_excluded boolean, valid_from timestamp, valid_to timestamp, is_current boolean"
    stored = table([(1, s, True, False, T0, None, True) for s in range(3)] + [(2, 1, True, False, T0, None, True)], schema)
    listed = table([], "definition_id int, series_id int, is_required boolean")
    got = rows(history.sync_assignments(stored, listed, table([(1,)], "definition_id int"), at(days=1)).select("definition_id", "series_id", "is_current"), "definition_id", "series_id")
    assert got == [(1, 0, False), (1, 1, False), (1, 2, False), (2, 1, True)]


def test_upsert_twice_equals_once(table):
    current = table([(1, T0, 1.0, T0), (1, at(hours=1), 2.0, T0)], "series_id int, ts timestamp, value double, updated_at timestamp")
    batch = table([(1, T0, 5.0, 1), (1, T0, 6.0, 2), (2, T0, None, 3), (2, at(hours=1), 7.0, 4)], "series_id int, ts timestamp, value double, batch_seq long")
    once = upsert.upsert_points(current, batch, at(days=1))
    assert [r[2] for r in rows(once, "series_id", "ts")] == [6.0, 2.0, 7.0]
    assert rows(upsert.upsert_points(once, batch, at(days=1)), "series_id", "ts") == rows(once, "series_id", "ts")


def test_null_scope_matches_itself(table):
    schema = "calculation_date date, model_id int, scope_type string, scope_id string, rank_position int"
    old = table([(date(2024, 1, 1), 1, "global", None, 1)], schema)
    assert rows(upsert.upsert_rankings(old, table([(date(2024, 1, 1), 1, "global", None, 2)], schema)), "model_id") == [(date(2024, 1, 1), 1, "global", None, 2)]


# Ratings

AVERAGE = "scope_type string, scope_id string, round_id int, model_id int, avg_mase double"


def replay(averages, replicates, seed=42):
    """Plain replay of every season."""
    import hashlib

    scopes = {}
    for scope_type, scope_id, number, model, mase in averages:
        scopes.setdefault((scope_type, scope_id), {}).setdefault(number, {})[model] = mase
    out = {}
    for (scope_type, scope_id), season in scopes.items():
        for replicate in range(replicates):
            key = lambda n: hashlib.md5(f"{seed}:{scope_type}:{scope_id or ''}:{replicate}:{n}".encode()).hexdigest()
            ratings = {m: 1000.0 for scores in season.values() for m in scores}
            for number in sorted(season, key=key):
                scores = season[number]
                moved = {}
                for a in scores:
                    for b in scores:
                        if a != b:
                            won = 1.0 if scores[a] < scores[b] else 0.5 if scores[a] == scores[b] else 0.0
                            moved[a] = moved.get(a, 0.0) + won - 1 / (1 + 10 ** ((ratings[b] - ratings[a]) / 400))
                for model, change in moved.items():
                    ratings[model] += 4 * change
            for model, rating in ratings.items():
                out[scope_type, scope_id, replicate, model] = rating
    return out


@pytest.mark.parametrize("models", [5, 30])
def test_seasons_equal_a_plain_replay(table, models):
    rng = random.Random(11)
    data = [(t, i, n, m, rng.choice([0.5, 0.7, 0.9, 1.1])) for t, i in (("global", None), ("definition", "3")) for n in range(12) for m in range(models) if rng.random() < 0.7]
    data.append(("definition", "lonely", 1, 1, 0.5))
    df = table(data, AVERAGE)
    got = {(r[0], r[1], r[2], r[3]): r[4] for r in elo.replicate_ratings(elo.matches(df, ranking.SCOPE), ranking.SCOPE, 3).collect()}
    want = {k: v for k, v in replay(data, 3).items() if k[1] != "lonely"}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-8
    totals = {}
    for key, value in got.items():
        totals.setdefault(key[:3], []).append(value)
    assert all(abs(np.mean(v) - 1000) < 1e-8 for v in totals.values())


def test_summary_uses_linear_quantiles(table):
    data = [("global", None, n, m, float((n * 7 + m * 3) % 5)) for n in range(9) for m in range(3)]
    summary = {r["model_id"]: r for r in elo.elo_ratings(table(data, AVERAGE), replicates=21).collect()}
    plain = replay(data, 21)
    for model, r in summary.items():
        values = [v for k, v in plain.items() if k[3] == model]
        assert r["elo_rating_median"] == pytest.approx(np.median(values)) and r["elo_ci_lower"] == pytest.approx(np.percentile(values, 2.5))
        assert r["elo_ci_upper"] == pytest.approx(np.percentile(values, 97.5)) and r["matches_played"] == 9 and r["n_bootstraps"] == 21


def test_loose_round_has_no_frequency_scope(table):
    base = table([(1, None, 1, 0.5), (2, 1, 1, 0.7)], "round_id int, definition_id int, model_id int, avg_mase double")
    got = rows(ranking.with_scopes(base, table([a_definition()], DEFINITION)).select("round_id", "scope_type", "scope_id"), "round_id", "scope_type")
    assert got == [(1, "definition", None), (1, "global", None), (2, "definition", "1"), (2, "frequency_horizon", "01:00:00::1 day"), (2, "global", None)]


def test_repeated_batch_keys_give_one_row(table):
    series = table([("a", "UTC"), ("b", None)], "unique_id string, ts_timezone string")
    zones = table([("b", "CET"), ("b", "EET"), ("b", "CET")], "unique_id string, ts_timezone string")
    assert sorted(map(tuple, upsert.update_timezone(series, zones).collect())) == [("a", "UTC"), ("b", "EET")]
    span = "id int, start_time timestamp, end_time timestamp"
    old = table([(1, datetime(2024, 1, 1), datetime(2024, 1, 2))], span)
    new = table([(1, datetime(2024, 1, 3), None), (1, datetime(2024, 1, 4), None)], span)
    assert [tuple(r) for r in upsert.update_round_times(old, new).collect()] == [(1, datetime(2024, 1, 4), datetime(2024, 1, 2))]
    pseudo = "round_id int, series_id int, challenge_series_name string"
    got = upsert.upsert_series_pseudo(table([(1, 1, "x")], pseudo), table([(1, 1, "y"), (1, 1, "z"), (2, 1, "n"), (2, 1, "n")], pseudo))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "z"), (2, 1, "n")]


def test_a_step_of_zero_fills_nothing(table):
    rows = [(1, datetime(2024, 1, 1), 1.0, 0), (1, datetime(2024, 1, 2), 2.0, 0)]
    got = imputation.impute_gaps(table(rows, "series_id int, ts timestamp, value double, frequency_s long"))
    assert got.count() == 2


def test_versions_at_many_instants_equal_a_filter_for_each(spark, table):
    rng = random.Random(12)
    hour = lambda: T0 + timedelta(seconds=rng.randrange(40 * 86400))
    versions, seen = [], set()
    for i in range(200):
        start = hour()
        versions.append((rng.randrange(3), T0 + timedelta(minutes=i), float(i), 0, start, rng.choice([None, start, start + timedelta(seconds=rng.randrange(1, 9 * 86400))]), True))
    known = table(versions, "series_id int, ts timestamp, value double, quality_code smallint, valid_from timestamp, valid_to timestamp, is_current boolean")
    asked = [(n, rng.randrange(4), rng.choice([hour(), T0 + timedelta(hours=rng.randrange(900)), versions[n][4], T0 - timedelta(days=9)])) for n in range(60)]
    for wanted in (asked, asked[:1], []):
        frame = table(wanted, "n int, series_id int, moment timestamp")
        found = sorted((r.n, r.value) for r in history.versions_at(known, frame, "moment").collect())
        want = sorted((n, v[2]) for n, s, m in wanted for v in versions if v[0] == s and v[4] <= m and (v[5] is None or m < v[5]))
        assert found == want
        seen.update(n for n, _ in found)
    assert len(seen) > 20


def test_versions_travel_once_and_hot_series_in_slices(spark, table):
    versions = [(1 + (i % 10 == 0), T0 + timedelta(minutes=i), float(i), 0, T0 + timedelta(minutes=i), None if i % 3 else T0 + timedelta(minutes=i + 90), True) for i in range(400)]
    known = table(versions, "series_id int, ts timestamp, value double, quality_code smallint, valid_from timestamp, valid_to timestamp, is_current boolean")
    asked = [(n, 1 + n % 3, T0 + timedelta(minutes=n * 5) if n % 7 else None, str(n)) for n in range(90)]
    want = sorted((n, v[2]) for n, s, m, _ in asked if m for v in versions if v[0] == s and v[4] <= m and (v[5] is None or m < v[5]))
    assert [tuple(r) for r in history.slices(known, "series_id", 100).collect()] == [(1, 4)]
    for rows in (1000, 100, 7):
        found = history.versions_at(known, table(asked, "n int, series_id int, moment timestamp, value_name string"), "moment", rows)
        assert found.columns == ["series_id", "n", "moment", "value_name", "ts", "value", "quality_code", "valid_from", "valid_to"]
        assert sorted((r.n, r.value) for r in found.collect()) == want
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate explode") == 2, "only what is asked is unrolled, never a version"


def test_dyadic_cover_is_exact_and_small(spark):
    spans = [(a, b) for a in range(0, 70, 3) for b in range(a, 70)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", history.dyadic_cover(F.col("a"), F.col("b"), 7).alias("c")).collect()
    for r in rows:
        covered = sorted(n for level, block in r.c for n in range(block << level, (block + 1) << level))
        assert covered == list(range(r.a, r.b)) and len(r.c) <= 14


def test_seeking_pages_reads_one_range(spark, tmp_path):
    listing = spark.range(1000).selectExpr("id as round_id", "pmod(hash(id), 7) as score")
    order = [F.desc("score"), F.asc("round_id")]
    rounds.store_listing(listing, order, str(tmp_path), parts=10)
    whole = [tuple(r) for r in listing.orderBy(*order).collect()]
    for number, size in ((1, 10), (3, 7), (99, 10), (1, 1000), (2, 333)):
        got = rounds.seek_page(spark, str(tmp_path), listing.schema, order, number, size)
        assert [tuple(r) for r in got.collect()] == whole[(number - 1) * size : number * size]
    last = rounds.seek_page(spark, str(tmp_path), listing.schema, order, 0, 30)
    assert [tuple(r) for r in last.collect()] == whole[990:]
    plan = rounds.seek_page(spark, str(tmp_path), listing.schema, order, 95, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = \d", plan), plan
    assert rounds.seek_page(spark, str(tmp_path), listing.schema, order, 500, 10).count() == 0


def test_signed_deltas_equal_a_rebuild(spark, folder):
    w = world(spark, folder)
    scores = w.scores.select("round_id", "model_id", "series_id", "mase", "rmse", "final_evaluation")
    state, log = scores.limit(0), None
    for n in range(4):
        noise = F.pmod(F.xxhash64("round_id", "model_id", "series_id", F.lit(n)), F.lit(5))
        after = scores.where(noise > 0).withColumn("mase", F.when(noise == 1, F.lit(float("inf"))).when(noise == 2, F.col("mase") + n).otherwise(F.col("mase")))
        after = after.withColumn("final_evaluation", noise != 3)
        delta = ranking.sum_deltas(ranking.score_changes(state, after), w.rounds, w.definitions, w.assignments)
        log = delta if log is None else log.unionByName(delta)
        state = after
        keys = ["round_id", "model_id", "scope_type", "scope_id"]
        shown = lambda df: sorted((str(r) for r in df.select(*keys, "num_scores", *[F.round(c, 6) + 0.0 for c in ("sum_mase", "sum_mase_sq", "sum_rmse")]).collect()))
        if n in (0, 3):
            assert shown(ranking.merged_sums(log)) == shown(ranking.round_model_scores(state, w.rounds, w.definitions, w.assignments))


def test_rollup_levels_are_not_shuffled(table):
    df = rollup.rollup_all(table([(1, at(minutes=7 * i), float(i)) for i in range(50)], POINTS))
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    start = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    above, low = [], depth[start]
    for i in range(start, -1, -1):
        if depth[i] < low:
            above, low = [*above, lines[i]], depth[i]
    assert above and not [line for line in above if "Exchange" in line]


def test_rollups_with_missing_instants_and_values(table):
    data = [(1, at(minutes=3), 1.0), (1, at(minutes=3), 1.0), (1, at(minutes=4), None), (None, at(minutes=5), 2.0), (1, None, 3.0), (2, at(hours=30), None)]
    whole = table(data, POINTS)
    got = rollup.rollup_all(whole)
    for name, width in (("15min", 900), ("1h", 3600), ("1d", 86400)):
        mean = F.sum("value") / F.count(F.lit(1))
        want = whole.groupBy("series_id", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width) * width).alias("ts")).agg(
            mean.alias("value"), F.count(F.lit(1)).alias("sample_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
        )
        assert sorted(map(repr, got.where(F.col("resolution") == name).select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_asked_levels_name_each_series_once_per_resolution(table):
    made = table([(10, 3600), (11, 3600), (20, 86400), (30, 1800)], "id int, frequency_s long")
    chosen = table([(10, 1), (11, 1), (11, 2), (20, 1), (30, 2), (30, None)], "round_id int, series_id int")
    found = rows(rounds.asked_levels(made, chosen).where("series_id is not null"), "resolution", "series_id")
    assert found == [("1d", 1), ("1h", 1), ("1h", 2)]


def test_stored_tables_look_up_only_rollups_that_rounds_asked_for(spark, folder):
    w = world(spark, folder)
    keys = ["resolution", "series_id"]
    asked = rounds.asked_levels(w.created, w.chosen)
    values = ["resolution", "series_id", "ts", "value"]
    want = w.rollups.join(asked, keys, "left_semi").select(*values)
    assert rows(w.served.select(*values), *values) == rows(want, *values)
    assert w.served.count() < w.rollups.count()
    for name, made in (("context", rounds.context_snapshot(w.created, w.chosen, w.rollups)), ("late_scores", scoring.evaluate(w.forecasts, w.rounds, w.pseudo, w.rollups, datetime(2024, 2, 2)))):
        stored = getattr(w, name).select(*made.columns)
        assert stored.count() == made.count()
        shown = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes]
        assert stored.select(*shown).exceptAll(made.select(*shown)).isEmpty()
