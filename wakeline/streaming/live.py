"""Operators kept up to date as reports arrive, with Structured Streaming.

Each gives the same answer as its batch operator over the rows seen so far. State is
one row per key or per open bin, or a vessel's reports of the last minutes, so it does
not grow with the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.functions.frames import number, total_sql
from wakeline.functions.times import BIN_ORIGIN, EPOCH, FRESH_MINUTES
from wakeline.operators.links import seen_by_device
from wakeline.operators.positions import HEADED, LOCATED, fix_columns, newest_fix
from wakeline.operators.series import MAIN_ENGINES, playback_columns
from wakeline.operators.snapshot import completeness


def stream_last_seen(
    reports: DataFrame, key: str = "device_id", moment: str = "message_datetime"
) -> DataFrame:
    """Last report time per device, as read by the link operators (update or complete mode)."""
    return reports.groupBy(key).agg(F.max(moment).alias("latest_timestamp"))


def stream_seen_by_device(nmea: DataFrame) -> DataFrame:
    """Last placed and moving report per device (update or complete mode).

    With ``stream_last_seen`` over device reports this is all that the links read: L1 is
    ``links.links_of_seen`` of the two tables, L2 ``links.fleet_links`` of the second.
    """
    return seen_by_device(nmea)


def stream_latest_position(interp: DataFrame) -> DataFrame:
    """P2 over a stream (update or complete mode)."""
    return fix_columns(newest_fix(interp))


def stream_main_series(
    interp: DataFrame, minutes: int, late_by: str
) -> DataFrame:
    """T4's measured bins over a stream (append mode): a bin is emitted once the
    watermark has passed it. Rows that are more than ``late_by`` behind the newest
    row may be dropped; links can deliver after days, so the caller has to choose.

    Needs a session in UTC, since watermarks work on zoned timestamps.
    """
    fuel = [f"{e}_consumption" for e in MAIN_ENGINES]
    offset = int((BIN_ORIGIN - EPOCH) / timedelta(seconds=1)) % (minutes * 60)
    bins = F.window("event_time", f"{minutes} minutes", startTime=f"{offset} seconds")
    sums = [F.expr(f"sum({total_sql(c)}) as {c[:3]}") for c in fuel]
    return (
        interp.where(F.coalesce(*fuel).isNotNull())
        .withColumn("event_time", F.col("nr_time").cast("timestamp"))
        .withWatermark("event_time", late_by)
        .groupBy("vessel_id", bins.alias("bin"))
        .agg(*sums, F.expr(f"sum({total_sql(*fuel)}) as total"))
        .select(
            "vessel_id",
            (F.col("bin.start").cast("timestamp_ntz")).alias("bin"),
            *[(number(c) / minutes).alias(c) for c in (*MAIN_ENGINES, "total")],
        )
    )


def stream_fresh(interp: DataFrame, minutes: int = FRESH_MINUTES, late_by: str = "5 minutes") -> DataFrame:
    """R1 and R2 over a stream (update mode): each vessel's most complete fresh row, kept up to date.

    The clock is the watermark, ``late_by`` behind the newest report: what is emitted
    at ``as_of`` is what the batch operators give for that moment, late reports
    included. A vessel that falls silent stops being fresh without a new row: a timer
    fires when its last report is ``minutes`` old. Rows say whether the vessel is
    ``fresh`` and, if so, hold its row; only changes are emitted. State is the
    reports of one vessel from the last ``minutes`` on, so it does not grow with
    the stream. Reports without a vessel or a time take no part. Needs a session in
    UTC, since watermarks work on zoned timestamps.
    """
    rows = (
        interp.where("vessel_id is not null and nr_time is not null")
        .select("id", F.col("vessel_id").cast("bigint").alias("vessel_id"), *playback_columns())
        .withColumn("score", completeness())
        .withColumn("event_time", F.col("timestamp").cast("timestamp"))
        .withWatermark("event_time", late_by)
    )
    values = [f for f in rows.schema.fields if f.name not in ("vessel_id", "score", "event_time")]
    names = [f.name for f in values]
    out = T.StructType(
        [
            T.StructField("vessel_id", T.LongType()),
            T.StructField("as_of", T.TimestampNTZType()),
            T.StructField("fresh", T.BooleanType()),
            *values,
        ]
    )
    age = minutes * 60 * 1_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        # A report is (time, id, score, values); the row shown last goes with them.
        held, shown = json.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            for frame in frames:
                times = frame["timestamp"].astype("datetime64[us]").astype("int64").tolist()
                cells = frame[[n for n in names if n != "timestamp"]].astype(object)
                cells = cells.where(cells.notna(), None).to_numpy().tolist()
                held += [[t, row[0], s, row] for t, s, row in zip(times, frame["score"].tolist(), cells)]
        held = [r for r in held if r[0] > now - age]
        current = [r for r in held if r[0] <= now]
        best = max(current, key=lambda r: (r[2], r[0], r[1]), default=None)
        nearest = min([r[0] if r[0] > now else r[0] + age for r in held], default=None)
        if nearest is None:
            state.remove()
        else:
            state.update((json.dumps([held, best]),))
            # A timer fires when the watermark has passed it, and may not lie in the past.
            state.setTimeoutTimestamp(max(nearest // 1000, now // 1000 + 1))
        if best != shown:
            row = dict.fromkeys(out.names)
            row |= {"vessel_id": key[0], "as_of": pd.Timestamp(now, unit="us"), "fresh": best is not None}
            if best is not None:
                row |= dict(zip([n for n in names if n != "timestamp"], best[3]))
                row["timestamp"] = pd.Timestamp(best[0], unit="us")
            yield pd.DataFrame([row], columns=out.names)

    return rows.groupBy("vessel_id").applyInPandasWithState(
        update, out, "held string", "update", GroupStateTimeout.EventTimeTimeout
    )


def stream_track(interp: DataFrame, late_by: str, wait: str = "7 days") -> DataFrame:
    """P1 over a stream (append mode): each distinct point once its nearest heading is certain.

    The clock is the watermark, ``late_by`` behind the newest report. A point waits until
    the next heading is known, or until the watermark is as far behind it as the last
    heading before it, as a later one cannot be nearer then. So the rows
    emitted are those of the batch operator over the whole stream. A vessel without
    any heading yet has nothing to compare with: its points wait for one up to
    ``wait`` and then read 0. State is a vessel's reports behind the watermark, its last
    heading and the points that wait. Reports without a vessel or a time take no
    part. Needs a session in UTC.
    """
    rows = (
        interp.where("vessel_id is not null and nr_time is not null")
        .where(f"({LOCATED}) or {HEADED}")
        .select(
            "id",
            F.col("vessel_id").cast("bigint").alias("vessel_id"),
            "nr_time",
            number("latitude", "lat"),
            number("longitude", "long"),
            number("course", "course"),
        )
        .withColumn("event_time", F.col("nr_time").cast("timestamp"))
        .withWatermark("event_time", late_by)
    )
    out = "vessel_id bigint, timestamp timestamp_ntz, lat double, long double, direction double"
    patience = pd.Timedelta(wait) // pd.Timedelta("1us")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        # Reports that others may still come before; the last heading; points that wait for one.
        ahead, last, waiting = json.loads(state.get[0]) if state.exists else ([], None, [])
        if not state.hasTimedOut:
            for frame in frames:
                times = frame["nr_time"].astype("datetime64[us]").astype("int64").tolist()
                cells = frame[["id", "lat", "long", "course"]].astype(object)
                cells = cells.where(cells.notna(), None).to_numpy().tolist()
                ahead += [[t, *row] for t, row in zip(times, cells)]
        certain = sorted((r for r in ahead if r[0] <= now), key=lambda r: r[:2])
        ahead = [r for r in ahead if r[0] > now]
        done: list[tuple] = []
        for moment, at_once in groupby(certain, key=lambda r: r[0]):
            group = list(at_once)
            headings = [r for r in group if r[4] is not None]
            if headings:
                # Of headings at one instant the one with the higher id counts.
                course = headings[-1][4]
                for t, lat, long in waiting:
                    back = last is not None and t - last[0] <= moment - t
                    done.append((t, lat, long, last[1] if back else course))
                last, waiting = [moment, course], []
            # Points count once for each course they are reported with, as rows do.
            points = dict.fromkeys((r[2], r[3], r[4]) for r in group if r[2] is not None and r[3] is not None)
            if last is not None and last[0] == moment:
                done += [(moment, lat, long, last[1]) for lat, long, _ in points]
            else:
                waiting += [[moment, lat, long] for lat, long, _ in points]
        closing = lambda t: 2 * t - last[0] if last is not None else t + patience
        done += [(t, lat, long, last[1] if last is not None else 0.0) for t, lat, long in waiting if closing(t) <= now]
        waiting = [p for p in waiting if closing(p[0]) > now]
        state.update((json.dumps([ahead, last, waiting]),))
        timers = [r[0] for r in ahead] + [closing(p[0]) for p in waiting]
        if timers:
            state.setTimeoutTimestamp(max(min(timers) // 1000, now // 1000 + 1))
        if done:
            found = pd.DataFrame(done, columns=["timestamp", "lat", "long", "direction"])
            found["timestamp"] = pd.to_datetime(found["timestamp"], unit="us")
            found.insert(0, "vessel_id", key[0])
            yield found

    return rows.groupBy("vessel_id").applyInPandasWithState(
        update, out, "held string", "append", GroupStateTimeout.EventTimeTimeout
    )
