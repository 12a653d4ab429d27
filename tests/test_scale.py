"""Numbering and tracks where one key, one hour or one missing order holds a million rows."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from tests.frames import at, fleet
from wakeline.functions import slices
from wakeline.operators import deident, positions

ROWS = 1_000_000


def numbered(frame, order, ties=(), keys=()):
    found = slices.number_rows(frame, keys, order, ties).toPandas()
    assert (found["total_rows"] == len(found)).all() if not keys else True
    return found


def most_in_a_slice(frame, order, ties=()):
    """Rows of the largest slice, slices of the largest group, and groups."""
    number = slices.slice_number(frame, order, ties)
    sizes = frame.groupBy(number.alias("s")).count()
    groups = sizes.groupBy(F.shiftright("s", slices.GROUP_BITS)).agg(
        F.max("count").alias("rows"), F.count("*").alias("slices")
    )
    return groups.agg(F.max("rows"), F.max("slices"), F.count("*")).first()


def test_sparse_ids_are_numbered_in_parallel(spark):
    frame = spark.range(ROWS).select((F.pmod(F.xxhash64("id"), F.lit(1 << 62)) * 2 - (1 << 62)).alias("n"))
    found = numbered(frame, "n").sort_values("n")
    assert (found["row_index"].to_numpy() == np.arange(ROWS)).all()
    rows, in_group, groups = most_in_a_slice(frame, "n")
    assert rows < 10 and in_group < ROWS // 4 and groups < 1 << slices.GROUP_BITS


def test_windows_over_groups_hold_no_rows_of_the_data(spark):
    """What meets in one task is one row per group of slices."""
    frame = spark.range(ROWS).select((F.col("id") * 7919).alias("n"))
    plan = slices.number_rows(frame, (), "n")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for at_line, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "group_rows" in "".join(lines[at_line : at_line + 3])
    assert most_in_a_slice(frame, "n")[2] <= 2


def test_rows_without_any_order(spark):
    empty = F.lit(None).cast("bigint")
    frame = spark.range(ROWS).select(empty.alias("n"), F.col("id").alias("tie"), (F.col("id") % 7).alias("x"))
    found = numbered(frame, "n", ["tie"]).sort_values("tie")
    assert (found["row_index"].to_numpy() == np.arange(ROWS)).all()
    assert most_in_a_slice(frame, "n", ["tie"])[0] <= 4 * slices.SLICE_VALUES
    loose = numbered(frame, "n")
    assert sorted(loose["row_index"]) == list(range(ROWS))
    assert most_in_a_slice(frame, "n")[0] < 200
    without_tie = frame.withColumn("tie", empty)
    assert sorted(numbered(without_tie, "n", ["tie"])["row_index"]) == list(range(ROWS))


def test_order_of_odd_numbers(spark):
    odd = [float("nan"), float("inf"), float("-inf"), -1.5, 0.0, 1e300, -1e300, 2.0**60, None, None, 123456.7]
    frame = spark.createDataFrame([(v, k) for k, v in enumerate(odd)], "n double, k int")
    found = numbered(frame, "n", ["k"]).sort_values("row_index")["k"].tolist()
    assert found == [2, 6, 3, 4, 10, 7, 5, 1, 0, 8, 9]
    times = [at("05 10:00"), at("05 10:00"), at("04 10:00"), None]
    frame = spark.createDataFrame([(v, k) for k, v in enumerate(times)], "n timestamp_ntz, k int")
    assert numbered(frame, "n", ["k"]).sort_values("row_index")["k"].tolist() == [2, 0, 1, 3]
    early = frame.withColumn("n", F.expr("timestamp_ntz'1969-12-31 23:59:59' - make_dt_interval(k)"))
    assert numbered(early, "n").sort_values("row_index")["k"].tolist() == [3, 2, 1, 0]


def test_keys_of_any_kind(spark):
    frame = spark.createDataFrame(
        [(k, n) for k in (None, 1, 2) for n in (5, None, 10**12, -3)], "k int, n long"
    )
    found = slices.number_rows(frame, ["k"], "n").collect()
    places = {(r["k"], r["n"]): (r["row_index"], r["total_rows"]) for r in found}
    for k in (None, 1, 2):
        assert [places[k, n] for n in (-3, 5, 10**12, None)] == [(i, 4) for i in range(4)]
    dated = deident.redate(frame, "n", at("15 12:00"), keys=["k"])
    assert dated.filter("k is null and n is null").first()["timestamp"] == at("15 12:00")


def crowded(spark, rows):
    """One vessel with ``rows`` points in one hour, a few points around, and courses now and then."""
    start = "timestamp_ntz'2024-01-05 10:00:00'"
    hour = spark.range(rows).selectExpr(
        "id",
        "cast(1 as bigint) as vessel_id",
        f"{start} + make_dt_interval(0, 0, 0, id * 3600.0 / {rows}) as nr_time",
        "cast(id as decimal(20, 6)) as latitude",
        "cast(1 as decimal(20, 6)) as longitude",
        "cast(case when id % 997 = 3 then id % 360 end as decimal(20, 6)) as course",
    )
    around = spark.range(10).selectExpr(
        f"id + {rows} as id",
        "cast(1 + id % 2 as bigint) as vessel_id",
        f"{start} + make_dt_interval(0, id - 5, 0, 1) as nr_time",
        "cast(-id - 1 as decimal(20, 6)) as latitude",
        "cast(1 as decimal(20, 6)) as longitude",
        "cast(case when id in (0, 9) then 77 end as decimal(20, 6)) as course",
    )
    return hour.unionByName(around)


def nearest_headings(rows):
    """Plain version: (vessel, latitude) to heading of the nearest course in time, the earlier of equals."""
    wanted = {}
    for vessel, part in rows.groupby("vessel_id"):
        part = part.sort_values(["nr_time", "id"])
        times = part["nr_time"].to_numpy().astype("datetime64[us]").astype(np.int64)
        headed = part["course"].notna().to_numpy()
        at_times, courses = times[headed], part["course"].to_numpy()[headed].astype(float)
        left = np.searchsorted(at_times, times, side="right") - 1
        right = np.minimum(np.searchsorted(at_times, times, side="left"), len(at_times) - 1)
        gap_left = np.where(left >= 0, times - at_times[np.maximum(left, 0)], times)
        gap_right = np.where(at_times[right] >= times, at_times[right] - times, np.iinfo(np.int64).max)
        near = np.where(gap_left <= gap_right, np.where(left >= 0, courses[np.maximum(left, 0)], 0.0), courses[right])
        wanted |= {(vessel, float(x)): h for x, h in zip(part["latitude"], near)}
    return wanted


def test_a_million_points_in_one_hour(spark):
    frame = crowded(spark, ROWS)
    sliced = frame.withColumn("s", slices.time_slice("nr_time"))
    parts = slices.split_dense(sliced, ["vessel_id"], "s", "nr_time")
    sizes = parts.groupBy("vessel_id", "s").agg(F.count("*").alias("n"), F.min("nr_time"), F.max("nr_time")).collect()
    a_second = -(-ROWS // 3600) + 1
    assert sum(r["n"] for r in sizes) == ROWS + 10
    assert max(r["n"] for r in sizes) <= slices.SLICE_ROWS + a_second
    assert len(sizes) < 10 + ROWS / slices.SLICE_ROWS + 2
    found = positions.track(frame, at("01"), at("15"), vessel=fleet(spark, 1, 2)).toPandas()
    wanted = nearest_headings(frame.toPandas())
    assert len(found) == len(wanted)
    got = dict(zip(zip(found["vessel_id"], found["lat"]), found["direction"]))
    assert got == wanted


def test_dense_hours_with_ties_on_a_border(spark):
    """Many points at one instant stay together, whatever they number."""
    frame = crowded(spark, 2000).withColumn("nr_time", F.date_trunc("minute", "nr_time").cast("timestamp_ntz"))
    sliced = frame.withColumn("s", slices.time_slice("nr_time"))
    parts = slices.split_dense(sliced, ["vessel_id"], "s", "nr_time", 50)
    counts = parts.groupBy("nr_time").agg(F.count_distinct("s").alias("n"))
    assert counts.filter("n > 1").count() == 0
    ordered = parts.orderBy("nr_time").select("s").toPandas()["s"]
    assert ordered.is_monotonic_increasing and (ordered.diff().fillna(timedelta(0)) >= timedelta(0)).all()
