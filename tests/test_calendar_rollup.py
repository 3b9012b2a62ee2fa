from datetime import date, timedelta

from pyspark.sql import functions as F

from wattloom.functions.calendar import is_federal_holiday, with_calendar, with_holidays
from wattloom.operators.rollup import hourly

FEDERAL_2018 = {
    date(2018, 1, 1), date(2018, 1, 15), date(2018, 2, 19), date(2018, 5, 28), date(2018, 7, 4), date(2018, 9, 3),
    date(2018, 10, 8), date(2018, 11, 11), date(2018, 11, 12), date(2018, 11, 22), date(2018, 12, 25),
}


def test_interval_end_labels_fall_into_the_hour_before(spark):
    rows = [(1, 0, f"2018-01-01 {t}", 1.0) for t in ("00:15:00", "00:30:00", "00:45:00", "01:00:00")]
    raw = spark.createDataFrame(rows, "bldg_id long, state int, t string, energy_consumption double")
    out = hourly(raw.withColumn("timestamp", F.col("t").cast("timestamp"))).collect()
    assert [(str(row["timestamp"]), row["energy_consumption"]) for row in out] == [("2018-01-01 00:00:00", 4.0)]


def test_naive_timestamps_and_missing_energy(spark):
    rows = [(1, 0, "2018-06-01 10:15:00", None), (1, 0, "2018-06-01 11:15:00", 2.0)]
    raw = spark.createDataFrame(rows, "bldg_id long, state int, t string, energy_consumption double")
    out = hourly(raw.withColumn("timestamp", F.col("t").cast("timestamp_ntz"))).orderBy("timestamp").collect()
    assert [row["energy_consumption"] for row in out] == [0.0, 2.0]


def test_federal_holidays_of_2018(spark):
    days = [(date(2018, 1, 1) + timedelta(days=n),) for n in range(365)]
    found = spark.createDataFrame(days, "day date").filter(is_federal_holiday("day")).collect()
    assert {row["day"] for row in found} == FEDERAL_2018


def test_observed_days_of_other_years(spark):
    days = [(date(2021, 1, 1) + timedelta(days=n),) for n in range(730)]
    found = {row["day"] for row in spark.createDataFrame(days, "day date").filter(is_federal_holiday("day")).collect()}
    # Juneteenth on a Saturday, Independence Day and New Year on weekends.
    assert {date(2021, 6, 18), date(2021, 7, 5), date(2021, 12, 31), date(2022, 6, 20)} <= found
    assert date(2021, 6, 17) not in found


def test_calendar_columns(hours_of):
    row = with_calendar(hours_of([(1, "2018-12-31 17:00:00", 1.0)])).first()
    assert (row["hour"], row["month"], row["weeknum"], row["weekday"], row["is_weekend"], row["tou"], row["season"]) == (17, 12, 1, 1, 0, 2, 0)


def test_state_holidays_leave_out_national_ones(spark, hours_of):
    table = spark.createDataFrame([(1, "2018-07-04"), (1, "2018-03-05"), (2, "2018-03-06"), (1, None)], "state int, day string")
    hours = with_calendar(hours_of([(1, f"2018-{d} 01:00:00", 1.0) for d in ("07-04", "03-05", "03-06")]))
    out = {str(r["day"]): (r["is_national_holiday"], r["is_state_holiday"]) for r in with_holidays(hours, table).collect()}
    assert out == {"2018-07-04": (True, False), "2018-03-05": (False, True), "2018-03-06": (False, False)}
