"""Streams in several micro-batches equal one batch; repeated batches change nothing."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from forescale.operators import history, imputation, resample, rollup, rounds, scoring
from forescale.operators.ordered import keep_one
from forescale.plans.world import AS_OF, world
from forescale.streaming import carry, ingest, log, rescore, rollups

T0 = datetime(2024, 1, 1)
SCHEMA = "series_id int, ts timestamp, value double, frequency_s long, batch_seq long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def land(table, folder, data, schema=SCHEMA):
    table(data, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_rollup_stream_equals_batch_and_drops_late_rows(spark, table, tmp_path):
    rng = random.Random(2)
    days = [[(rng.randrange(3), T0 + timedelta(days=d, seconds=rng.randrange(86400)), float(rng.randrange(9)), 900, 0) for _ in range(60)] for d in range(5)]
    for day in days:
        land(table, tmp_path / "in", day)
    run = lambda: rollups.run_rollup(
        ingest.landed_points(spark, str(tmp_path / "in"), SCHEMA, 1), "1h", str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    run()
    want = rollup.rollup(table([r for day in days for r in day], SCHEMA), 3600)
    got = lambda: rows(rollups.rollup_table(spark, str(tmp_path / "out")), "series_id", "ts")
    assert got() == rows(want, "series_id", "ts")
    land(table, tmp_path / "in", [(0, T0 + timedelta(hours=1), 99.0, 900, 0)])
    run()
    assert got() == rows(want, "series_id", "ts")


def test_late_corrections_win_and_leave_a_version(spark, table, tmp_path):
    point = lambda minutes, value, seq: (1, T0 + timedelta(minutes=minutes), value, 900, seq)
    land(table, tmp_path / "in", [point(0, 1.0, 1), point(60, 5.0, 2)])
    clock = lambda batch: T0 + timedelta(days=10 + batch)
    state = str(tmp_path / "state")
    run = lambda: ingest.run_ingest(ingest.landed_points(spark, str(tmp_path / "in"), SCHEMA), clock, state, str(tmp_path / "cp")).awaitTermination()
    run()
    land(table, tmp_path / "in", [point(0, 1.0, 3), point(60, 6.0, 4), point(60, 9.0, 5)])
    run()
    now = rows(ingest.current_points(spark, state).select("ts", "value"), "ts")
    assert [v for _, v in now] == [1.0, 3.0, 5.0, 7.0, 9.0]
    versions = ingest.point_history(spark, state)
    assert versions.filter("is_current").count() == 5
    closed = rows(versions.filter("NOT is_current").select("value", "valid_to"), "value")
    assert closed == [(2.0, clock(1)), (3.0, clock(1)), (4.0, clock(1)), (5.0, clock(1))]
    land(table, tmp_path / "in", [point(60, 4.0, 2)])  # an older delivery that comes last
    run()
    assert rows(ingest.current_points(spark, state).select("ts", "value"), "ts") == now


def test_a_late_point_opens_its_gap_again(spark, table, tmp_path):
    state = str(tmp_path / "state")
    point = lambda minutes, value, seq: (1, T0 + timedelta(minutes=minutes), value, 900, seq)
    clock = lambda n: T0 + timedelta(days=10 + n)
    for n, batch in enumerate(([point(0, 0.0, 0), point(60, 4.0, 1)], [point(40, 10.0, 2)], [point(40, None, 3)])):
        ingest.ingest_batch(table(batch, SCHEMA), n, clock(n), state)
    at = lambda n: [(int((t - T0).total_seconds()) // 60, v) for t, v in rows(history.at_time(ingest.point_history(spark, state), clock(n)).select("ts", "value"), "ts")]
    assert at(0) == [(0, 0.0), (15, 1.0), (30, 2.0), (45, 3.0), (60, 4.0)]
    assert at(1) == [(0, 0.0), (15, 5.0), (40, 10.0), (60, 4.0)]
    assert at(2) == at(0)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_equals_one_pass(spark, table, tmp_path, seed):
    rng = random.Random(seed)
    state = str(tmp_path / "state")
    points = []
    for series in (1, 2, 3):
        minute = 0
        for _ in range(rng.randint(3, 25)):
            minute += rng.choice([15, 15, 30, 45, 60, 200, 2000])
            points.append((series, T0 + timedelta(minutes=minute), float(rng.randrange(20)), 900, len(points)))
    points += [(*p[:2], float(rng.randrange(20)), 900, 100 + i) for i, p in enumerate(rng.sample(points, 8))]  # corrections
    points += [(*p[:2], None, 900, 200 + i) for i, p in enumerate(rng.sample(points[:20], 3))]  # taken away
    rng.shuffle(points)
    cuts = sorted(rng.sample(range(1, len(points)), 3))
    batches = [points[a:b] for a, b in zip([0, *cuts], [*cuts, len(points)])]
    clock = lambda n: T0 + timedelta(days=100 + n)
    order = ("series_id", "ts")
    for n, batch in enumerate(batches):
        ingest.ingest_batch(table(batch, SCHEMA), n, clock(n), state)
    versions = ingest.point_history(spark, state).cache()
    for n in range(len(batches)):
        known = keep_one(table([p for b in batches[: n + 1] for p in b], SCHEMA), ["series_id", "ts"], ["batch_seq"]).where("value is not null")
        want = rows(imputation.impute_gaps(known), *order)
        assert rows(history.at_time(versions, clock(n)).select("series_id", "ts", "value", "quality_code"), *order) == want
    shown = rows(ingest.current_points(spark, state).drop("updated_at"), *order)
    assert shown == [r[:3] for r in want if r[2] is not None]
    spans = versions.groupBy("series_id", "ts").agg(F.count_if("is_current").alias("now"), F.sum(F.when(F.col("valid_to") <= F.col("valid_from"), 1).otherwise(0)).alias("void"))
    assert spans.where("now > 1 or void > 0").count() == 0


def test_repeated_and_broken_batches_change_nothing(spark, table, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    first = table([(1, T0 + timedelta(minutes=60 * i), float(i), 900, i) for i in range(5)], SCHEMA)
    second = table([(1, T0 + timedelta(minutes=60 * i + 30), 9.0, 900, 9 + i) for i in range(3)], SCHEMA)
    read = lambda: rows(ingest.point_history(spark, state), "ts", "valid_from")
    ingest.ingest_batch(first, 0, datetime(2024, 2, 1), state)
    once = read()
    ingest.ingest_batch(first, 0, datetime(2024, 2, 1), state)
    assert read() == once
    write = DataFrameWriter.parquet

    def broken(self, path, *more, **options):
        if "/changes/" in path:
            raise OSError("lost")
        return write(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        ingest.ingest_batch(second, 1, datetime(2024, 2, 2), state)
    monkeypatch.undo()
    assert read() == once
    ingest.ingest_batch(second, 1, datetime(2024, 2, 2), state)
    whole = rows(imputation.impute_gaps(first.unionByName(second)), "ts")
    assert [(r[1], r[2]) for r in rows(ingest.point_history(spark, state).where("is_current"), "ts")] == [(r[1], r[2]) for r in whole]


def test_bins_by_timers_equal_one_pass(spark, table, tmp_path):
    rng = random.Random(9)
    schema = "station string, fuel string, ts timestamp, price double"
    event = lambda: (f"s{rng.randrange(3)}", "e5", T0 + timedelta(seconds=rng.randrange(2 * 86400)), rng.choice([1.1, 1.2, 1.3]))
    events = sorted({e[:3]: e for e in (event() for _ in range(90))}.values(), key=lambda e: e[2])
    events += [("s9", "e5", T0 + timedelta(hours=20, minutes=50), 1.4)]  # on the grid, silent ever after
    end = T0 + timedelta(hours=60)
    cut = T0 + timedelta(hours=22)
    arrivals = [[e for e in events if e[2] < cut], [e for e in events if e[2] >= cut], [("s0", "e5", T0 + timedelta(hours=55), None)], [("#", "#", end, None)]]
    out, seen = str(tmp_path / "bins"), []
    for rows_ in arrivals:
        rng.shuffle(rows_)
        land(table, tmp_path / "in", rows_, schema)
        carry.run_bins(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination()
        seen.append(spark.read.schema(schema).parquet(out).where("station = 's9'").count())
    shown = lambda df: rows(df.withColumn("price", F.round("price", 9)), "station", "fuel", "ts")
    assert shown(spark.read.schema(schema).parquet(out)) == shown(resample.resample_events(table(events, schema), T0, end))
    assert seen[2] > seen[1] > seen[0] and seen[3] == 235  # bins of a silent station come while it stays silent
    land(table, tmp_path / "in", [("s9", "e5", T0 + timedelta(hours=1), 9.9)], schema)  # beyond the horizon
    carry.run_bins(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.schema(schema).parquet(out).where("price = 9.9").count() == 0


def test_log_takes_the_newest_batch_and_its_retry(spark, table, tmp_path):
    folder, schema = str(tmp_path / "t"), "k int, v double"
    assert log.read_log(spark, folder, schema).count() == 0
    for batch, data in ((0, [(1, 1.0), (2, 2.0)]), (1, [(1, 5.0)]), (1, [(1, 6.0)])):
        log.write_batch(table(data, schema), folder, batch)
    read = lambda **limit: rows(log.newest(log.read_log(spark, folder, schema, **limit), ["k"]), "k")
    assert read() == [(1, 6.0, 1), (2, 2.0, 0)] and read(before=1) == [(1, 1.0, 0), (2, 2.0, 0)]


def test_incremental_scores_equal_a_full_evaluation(spark, folder, tmp_path):
    w = world(spark, folder)
    state = str(tmp_path / "state")
    actuals = scoring.known_by(w.rollups, AS_OF).select("resolution", "series_id", "ts", "value").cache()
    part = F.pmod(F.xxhash64("series_id", "ts", "resolution"), F.lit(4))
    wrong = actuals.where(part < 2).withColumn("value", F.col("value") + F.pmod(F.xxhash64("ts"), F.lit(7)))
    batches = [wrong, actuals.where(part == 2), actuals.where(part < 1), actuals.where((part == 1) | (part == 3)), actuals.limit(0), actuals.where(part == 2)]
    due = rounds.status_of(F.lit(AS_OF)).isin("active", "completed")
    due = w.rounds.where(due).select(F.col("id").alias("round_id"))
    shown = lambda df: rows(df.select(*scoring.KEYS, F.round("mase", 6), F.round("rmse", 6), "forecast_count", "actual_count", F.round("data_coverage", 6), "final_evaluation", "evaluation_status"), *scoring.KEYS)
    seen = None
    for n, batch in enumerate(batches):
        rescore.rescore_batch(batch, n, w.forecasts, w.rounds, w.pseudo, state)
        new = batch.withColumn("n", F.lit(n))
        seen = new if seen is None else seen.unionByName(new)
        if n in (0, 3, 5):
            known = seen.groupBy("resolution", "series_id", "ts").agg(F.max_by("value", "n").alias("value"))
            want = scoring.evaluate(w.forecasts.join(due, "round_id", "left_semi"), w.rounds, w.pseudo, known, AS_OF)
            assert shown(rescore.scores_at(spark, w.forecasts, w.rounds, state, AS_OF)) == shown(want)
    assert spark.read.parquet(f"{state}/sums").where("batch = 5 and (aligned <> 0 or absolute <> 0 or square <> 0 or naive <> 0)").count() == 0
