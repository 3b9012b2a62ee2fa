from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.functions.calendar import with_calendar
from wattloom.operators import enrich, gold, profiles, slices, spikes


@pytest.fixture(scope="module")
def dense(spark):
    """Three buildings with every hour of ten weeks around the turn of two months; small integers give many ties."""
    rng = np.random.default_rng(5)
    stamps = pd.date_range("2018-02-01", "2018-04-10", freq="h", inclusive="left")
    frame = pd.concat(
        [
            pd.DataFrame({"bldg_id": b, "state": b % 2, "timestamp": stamps, "energy_consumption": rng.integers(0, 9, len(stamps)).astype(float)})
            for b in (1, 2, 3)
        ]
    )
    hours = spark.createDataFrame(frame.sample(frac=1, random_state=1))
    narrow = gold.narrow_hours(hours)
    yield frame, gold.dated_hours(narrow)
    narrow.unpersist()


def calendar(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame.copy()
    out["hour"], out["month"] = out.timestamp.dt.hour, out.timestamp.dt.month
    out["day"], out["weekday"] = out.timestamp.dt.floor("D"), out.timestamp.dt.dayofweek + 1
    out["weeknum"] = out.timestamp.dt.isocalendar().week.astype(int)
    out["season"] = out.month.map(lambda m: 0 if m in (12, 1, 2) else 1 if m in (6, 7, 8) else 2)
    out["tou"] = out.hour.map(lambda h: 1 if 13 <= h <= 15 else 2 if 16 <= h <= 19 else 0)
    out["daily"] = out.groupby(["bldg_id", "day"]).energy_consumption.transform("sum")
    return out


def test_slices_equal_masked_means(dense):
    frame, base = dense
    pdf = calendar(frame)
    got = slices.hour_aggregation(base).toPandas().set_index("bldg_id")
    assert got.shape[1] == 370
    for building, rows in pdf.groupby("bldg_id"):
        one = got.loc[building]
        assert one["average_daily_consumption_month_3"] == pytest.approx(rows[rows.month == 3].daily.mean())
        assert one["total_consumption_hour_7"] == rows[rows.hour == 7].energy_consumption.sum()
        assert one["total_consumption_month_11"] == 0 and np.isnan(one["average_hour_consumption_month_11"])
        for month in (2, 3, 4):
            some = rows[rows.month == month].energy_consumption
            assert one[f"median_hour_consumption_month_{month}"] == some.median()
            assert one[f"max_hour_consumption_month_{month}"] == some.max()
        some = rows[(rows.season == 2) & (rows.weekday >= 6)].energy_consumption
        assert one["average_hour_consumption_season_2_is_weekend_1"] == pytest.approx(some.mean())
        some = rows[(rows.month == 2) & (rows.tou == 2)].energy_consumption
        assert one["average_hour_consumption_month_2_tou_2"] == pytest.approx(some.mean())
        presidents_day = rows[rows.day == "2018-02-19"]
        assert one["average_daily_consumption_national_holiday"] == presidents_day.daily.mean()
        assert one["average_hour_consumption_national_holiday_tou_1"] == pytest.approx(presidents_day[presidents_day.tou == 1].energy_consumption.mean())


def test_hours_go_straight_to_two_way_tables(dense):
    # Cells in between were grouped twice, and were as many as the hours of an entity with few of them.
    plan = slices.sliced_packed(dense[1], slices.LOAD_SLICES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [bldg_id") == 3
    assert "percentile" not in slices.median_packed(dense[1])._jdf.queryExecution().optimizedPlan().toString()


def test_median_of_repeated_missing_and_odd_values(spark, hours_of):
    # Even and odd numbers of values, nulls, NaN and infinities, a month of nulls alone; hours that repeat count each.
    odd = [None, 4.0, -0.5, float("nan"), 4.0, float("inf"), float("-inf"), 1e300]
    rows = [(b, f"2018-{1 + i % 3:02}-01 {i % 5:02}:00:00", odd[(i * b) % 8]) for b in range(1, 6) for i in range(b + 6)]
    hours = with_calendar(hours_of([*rows, (1, "2018-07-01 00:00:00", None), (9, "2018-07-01 00:00:00", None)]))
    want = hours.groupBy("bldg_id", "month").agg(F.median("energy_consumption").alias("median")).collect()
    got = {r.bldg_id: r.asDict() for r in slices.monthly_median(hours).collect()}
    assert len(got) == 6 and len(want) > 12
    for row in want:
        assert repr(got[row.bldg_id][f"median_hour_consumption_month_{row.month}"]) == repr(row.median)


def test_slices_of_missing_values_and_repeated_hours(hours_of):
    rows = [(1, "2018-01-01 03:00:00", 2.0), (1, "2018-01-01 03:00:00", 4.0), (1, "2018-01-01 04:00:00", None), (2, "2018-01-06 04:00:00", None)]
    got = {r.bldg_id: r for r in slices.hour_aggregation(gold.base_hours(hours_of(rows))).collect()}
    one, two = got[1], got[2]
    assert (one.total_consumption_month_1, one.total_consumption_hour_3, one.total_consumption_hour_4) == (6, 6, 0)
    assert (one.average_hour_consumption_month_1, one.max_hour_consumption_month_1, one.min_hour_consumption_month_1) == (3, 4, 2)
    assert one.average_daily_consumption_month_1 == one.average_daily_consumption_national_holiday == 6
    assert (two.total_consumption_ever, two.average_hour_consumption_month_1, two.average_daily_consumption_month_1) == (0, None, 0)


def test_hour_profile_counts_every_tied_hour_once(dense):
    frame, base = dense
    pdf = calendar(frame)
    got = profiles.hour_profile(base).toPandas().set_index("bldg_id")
    top = pdf.groupby(["bldg_id", "day"]).energy_consumption.transform("max")
    hits = pdf[pdf.energy_consumption == top].groupby(["bldg_id", "hour"]).day.nunique() / 365
    mean = pdf.groupby(["bldg_id", "day"]).energy_consumption.transform("mean")
    gap = (pdf.energy_consumption - mean).groupby([pdf.bldg_id, pdf.hour]).mean()
    for building in (1, 2, 3):
        for hour in range(24):
            assert got.loc[building, f"profile_max_hour_{hour}"] == pytest.approx(hits[building, hour])
            assert got.loc[building, f"profile_energy_vs_mean_hour_{hour}"] == pytest.approx(gap[building, hour], abs=1e-12)
    shares = got[[c for c in got.columns if c.startswith("profile_max_hour")]].sum(axis=1) * 365
    assert (shares >= pdf.day.nunique() - 1e-6).all()


def test_weekday_profile(dense):
    frame, base = dense
    pdf = calendar(frame)
    got = profiles.weekday_profile(base).toPandas().set_index("bldg_id")
    assert got.shape[1] == 35
    low = pdf.groupby(["bldg_id", "weeknum"]).daily.transform("min")
    hits = pdf[pdf.daily == low].groupby(["bldg_id", "weekday"]).weeknum.nunique() / 53
    mean = pdf.groupby(["bldg_id", "weeknum"]).daily.transform("mean")
    gap = (pdf.daily - mean).groupby([pdf.bldg_id, pdf.weekday]).mean()
    for building in (1, 2, 3):
        for weekday in range(1, 8):
            want = hits.get((building, weekday), np.nan)
            assert got.loc[building, f"profile_min_weekday_{weekday}"] == pytest.approx(want, nan_ok=True)
            assert got.loc[building, f"profile_daily_energy_vs_mean_weekday_{weekday}"] == pytest.approx(gap[building, weekday])


def test_range_of_work(dense):
    frame, base = dense
    pdf = calendar(frame).sort_values(["bldg_id", "timestamp"])
    past = pdf.groupby("bldg_id").energy_consumption.transform(lambda s: s.rolling(4).mean())
    future = pdf.groupby("bldg_id").energy_consumption.transform(lambda s: s.rolling(4).mean().shift(-5))
    pdf["jump"] = future - past
    got = spikes.range_of_work(base).toPandas().set_index("bldg_id")
    assert got.shape[1] == 60
    for building, rows in pdf.groupby("bldg_id"):
        weekly = {}
        for (month, week), days in rows.groupby(["month", "weeknum"]):
            best = []
            for _, day in days.groupby("day"):
                begin = day[(day.hour >= 3) & (day.hour <= 13) & (day.weekday <= 5) & day.jump.notna()]
                end = day[(day.hour >= 3) & (day.weekday <= 5) & day.jump.notna()]
                if len(begin) and len(end):
                    opened = begin[begin.jump == begin.jump.max()].timestamp.min()
                    closed = end[end.jump == end.jump.min()].timestamp.max()
                    best.append(int((closed - opened).total_seconds() / 3600))
            if best:
                weekly.setdefault(month, []).append(max(best))
        monthly = {month: min(values) for month, values in weekly.items()}
        assert got.loc[building, "com_range_work_workday"] == pytest.approx(np.mean(list(monthly.values())))
        for month, value in monthly.items():
            assert got.loc[building, f"com_range_work_workday_month_{month}"] == value


def test_width_of_the_feature_row(spark, dense):
    _, base = dense
    features = gold.load_features(base)
    assert len(features.columns) - 2 == gold.LOAD_FEATURES
    assert features.count() == 3


def test_jump_uses_full_frames_only(hours_of):
    rows = [(1, f"2018-05-01 {h:02d}:00:00", float(h + 1)) for h in range(10)]
    hours = with_calendar(hours_of(rows))
    out = enrich.with_jump(hours.orderBy(F.rand(3))).orderBy("timestamp").toPandas()
    assert out.past_mean.tolist()[3:] == [2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5] and out.past_mean[:3].isna().all()
    assert out.future_mean.tolist()[:5] == [4.5, 5.5, 6.5, 7.5, 8.5] and out.future_mean[5:].isna().all()


def test_tied_spikes_take_the_widest_span(hours_of):
    # Two equal rises at 5 h and 7 h and two equal falls later on.
    load = [0, 0, 0, 0, 0, 0, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 0, 0, 0, 0, 0, 0, 0, 0]
    rows = [(1, f"2018-05-{d:02d} {h:02d}:00:00", float(e)) for d in (1, 2) for h, e in enumerate(load)]
    out = spikes.daily_spikes(with_calendar(hours_of(rows))).orderBy("day").first()
    jumps = {}
    values = load * 2
    for i in range(3, 24):
        if i + 5 < 48:
            jumps[i] = np.mean(values[i + 2 : i + 6]) - np.mean(values[i - 3 : i + 1])
    opened = min(h for h in range(3, 14) if jumps[h] == max(jumps[k] for k in range(3, 14)))
    closed = max(h for h in range(3, 24) if jumps[h] == min(jumps.values()))
    assert out["com_range_work_workday"] == closed - opened
    assert out["com_range_work_weekend"] is None


def test_weeks_of_different_years(hours_of):
    rows = [(1, "2018-01-03 01:00:00", 1.0), (1, "2019-01-02 01:00:00", 5.0)]
    hours = with_calendar(hours_of(rows))
    assert profiles.daily_rows(hours).select("week").distinct().count() == 1
    assert profiles.daily_rows(hours, by_iso_year=True).select("week").distinct().count() == 2


def test_one_building_with_most_rows_changes_nothing(spark, dense):
    """Readings of a hot building collapse to its hours before anything is grouped by building."""
    from wattloom.operators.rollup import hourly

    frame, _ = dense
    one = frame[frame.bldg_id == 1].head(200)
    many = spark.createDataFrame(one).crossJoin(spark.range(50)).drop("id")
    rolled = hourly(many, lag_minutes=0).toPandas().sort_values("timestamp")
    assert len(rolled) == 200
    assert np.allclose(rolled.energy_consumption.to_numpy(), one.sort_values("timestamp").energy_consumption.to_numpy() * 50)
