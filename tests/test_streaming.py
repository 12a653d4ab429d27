"""Streams over files give what the batch operators give."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tests.frames import at, rows, table
from wakeline.operators import links, positions, series, snapshot
from wakeline.streaming import live


def run(frame, name, mode):
    query = (
        frame.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return frame.sparkSession.table(name)


def stream_of(spark, frame, folder):
    """Four files written one after the other in time order, one per micro-batch."""
    moment = F.col("nr_time" if "nr_time" in frame.columns else "message_datetime")
    edges = [at("01 00:00"), at("09 00:00"), at("16 12:30"), at("23 00:00"), at("31 00:00")]
    for low, high in zip(edges, edges[1:]):
        part = frame.where((moment >= F.lit(low)) & (moment < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_latest_position(spark, tables, tmp_path):
    stream = stream_of(spark, tables.interp, str(tmp_path / "in"))
    found = run(live.stream_latest_position(stream), "live_positions", "complete")
    expected = positions.latest_position(tables.interp)
    assert rows(found, *expected.columns) == rows(expected, *expected.columns)


def test_last_seen(spark, tables, tmp_path):
    stream = stream_of(spark, tables.nmea, str(tmp_path / "in"))
    found = run(live.stream_last_seen(stream), "live_seen", "complete")
    expected = tables.nmea.groupBy("device_id").agg(F.max("message_datetime").alias("latest"))
    assert rows(found, "device_id", "latest_timestamp") == rows(expected, "device_id", "latest")


def test_main_series_bins(spark, tables, tmp_path):
    interp = tables.interp.select("vessel_id", "nr_time", "id", *[f"me{n}_consumption" for n in (1, 2, 3)])
    stream = stream_of(spark, interp, str(tmp_path / "in"))
    found = run(live.stream_main_series(stream, 60, "40 days"), "live_bins", "append")
    assert found.count() == 0
    closed = run(live.stream_main_series(stream, 60, "1 day"), "live_bins_closed", "append")
    last = tables.interp.agg(F.max("nr_time")).collect()[0][0]
    assert closed.count() > 0
    batch = series.main_series(
        tables.interp, tables.vessel, closed.agg(F.min("bin")).collect()[0][0], last, 60
    ).where("engine = 'total'")
    centred = closed.select(
        F.col("vessel_id").cast("long").alias("vessel_id"),
        (F.col("bin") + F.expr("INTERVAL '30' MINUTE")).alias("timestamp"),
        F.round("total", 6).alias("fuel_cons"),
    )
    full = batch.select(F.col("vessel_id").cast("long"), "timestamp", F.round("fuel_cons", 6).alias("fuel_cons"))
    assert set(map(tuple, centred.collect())) <= set(map(tuple, full.collect()))
    assert closed.agg(F.max("bin")).collect()[0][0] >= last - timedelta(days=3)


def test_vessels_stop_being_fresh_without_a_new_row(spark, tmp_path):
    """After each load the stream's table is the batch answer at the watermark, late rows included."""
    import random

    rng = random.Random(3)
    late = timedelta(minutes=10)
    reports = []
    for k in range(400):
        # Vessel 3 falls silent, vessel 4 comes late.
        vessel = rng.choice((1, 2, 3, 4))
        minute = rng.uniform(0, 40 if vessel == 3 else 240)
        row = {"id": k, "vessel_id": vessel, "nr_time": at("05 10:00") + timedelta(minutes=minute)}
        for c in ("me1_consumption", "ae1_consumption", "latitude", "course"):
            if rng.random() < 0.5:
                row[c] = rng.choice((0, 1, 2.5))
        reports.append(row)
    # A load holds the reports of its time, some of them up to ten minutes late.
    arrival = lambda r: r["nr_time"] + timedelta(minutes=rng.choice((0, 0, 0, 9)))
    reports.sort(key=arrival)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    shown, seen = {}, []
    minutes = 15

    def keep(frame, _):
        for r in frame.collect():
            shown[r["vessel_id"]] = r

    for k in range(0, 400, 80):
        part = table(spark, "interp", reports[k : k + 80])
        part.coalesce(1).write.mode("append").parquet(folder)
        seen += reports[k : k + 80]
        stream = spark.readStream.schema(part.schema).parquet(folder)
        query = (
            live.stream_fresh(stream, minutes, "10 minutes")
            .writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .foreachBatch(keep)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
        newest = max(r["nr_time"] for r in seen) - late
        as_of = newest.replace(microsecond=newest.microsecond // 1000 * 1000)
        batch = snapshot.most_complete(snapshot.fresh(table(spark, "interp", seen), as_of, minutes))
        columns = [c for c in batch.columns if c != "score"]
        wanted = rows(batch, *columns)
        got = sorted(tuple(r[c] for c in columns) for r in shown.values() if r["fresh"])
        assert sorted(map(repr, got)) == sorted(map(repr, wanted)), as_of
    assert shown[3]["fresh"] is False and shown[3]["timestamp"] is None


def test_track_of_the_closed_part(spark, tmp_path):
    """Points come out once, with the heading that the batch operator finds over the whole stream."""
    import random

    rng = random.Random(8)
    reports = []
    for k in range(600):
        vessel = rng.choice((1, 1, 1, 2, 3))
        row = {"id": k, "vessel_id": vessel, "nr_time": at("05 10:00") + timedelta(seconds=rng.randrange(20_000))}
        if rng.random() < 0.9:
            row |= {"latitude": rng.randrange(50), "longitude": 1}
        if vessel < 3 and rng.random() < 0.15:
            row["course"] = rng.randrange(360)
        reports.append(row)
    reports += [reports[5] | {"id": 600}, reports[7] | {"id": 601, "course": 11}]
    reports.sort(key=lambda r: r["nr_time"] + timedelta(seconds=rng.choice((0, 0, 500))))
    # The last report moves the watermark past all others.
    reports.append({"id": 700, "vessel_id": 9, "nr_time": at("20 10:00"), "latitude": 1, "longitude": 1})
    folder, state, found = str(tmp_path / "in"), str(tmp_path / "state"), []
    for k in range(0, len(reports), 150):
        part = table(spark, "interp", reports[k : k + 150])
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        query = (
            live.stream_track(stream, "10 minutes")
            .writeStream.outputMode("append")
            .option("checkpointLocation", state)
            .foreachBatch(lambda frame, _: found.extend(tuple(r) for r in frame.collect()))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
    batch = positions.track(table(spark, "interp", reports), at("01"), at("30")).where("vessel_id <> 9")
    columns = ("vessel_id", "timestamp", "lat", "long", "direction")
    assert sorted(found) == rows(batch, *columns)


def test_links_after_every_load(spark, tables, tmp_path):
    stream = stream_of(spark, tables.nmea, str(tmp_path / "in"))
    heard = tables.device_status.select("device_id", F.col("latest_timestamp").alias("message_datetime"))
    parts = (tables.vessel, tables.device, tables.engine)
    edges, found = [at("09 00:00"), at("16 12:30"), at("23 00:00"), at("31 00:00")], []

    def compare(frame, batch):
        seen = spark.createDataFrame(frame.collect(), frame.schema)
        status = live.stream_last_seen(heard)
        mine = links.links_of_seen(*parts, status, seen)
        whole = links.vessel_links(*parts, tables.device_status, tables.nmea.where(F.col("message_datetime") < F.lit(edges[batch])))
        found.append(rows(mine, *whole.columns) == rows(whole, *whole.columns))
        fleet_columns = links.fleet_links(tables.vessel, tables.customer, *parts[1:], status).columns
        found.append(
            rows(links.fleet_links(tables.vessel, tables.customer, *parts[1:], status), *fleet_columns)
            == rows(links.fleet_links(tables.vessel, tables.customer, *parts[1:], tables.device_status), *fleet_columns)
        )

    query = (
        live.stream_seen_by_device(stream)
        .writeStream.outputMode("complete")
        .foreachBatch(compare)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    assert len(found) == 8 and all(found)
