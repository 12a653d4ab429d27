"""Views that give the driver's tables the shapes the operators read.

Each view is SQL that Spark and DuckDB both take unchanged, so the same text
feeds the operators and, as common table expressions, the SQL oracle.
``FIXTURES.md`` part B explains what each one exercises.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base tables the views read, with explicit schemas so that no job runs
# only to look at file footers.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
}

VIEWS = {
    "fx_customer": """
select r_regionkey as id, r_name as name from region
union all select 99, 'NOLINKS'
""",
    "fx_fleet_type": """
select * from (values (0,'offshore'),(1,'merchant')) as t(id, name)
""",
    "fx_vessel_type": """
select * from (values (0,'tug','offshore'),(1,'bulk','merchant'),(2,'psv','offshore')) as t(id, name, family)
""",
    "fx_vessel": """
select n_nationkey as id,
  case when n_nationkey % 12 <> 11 then 9000000 + n_nationkey end as imo,
  533000000 + n_nationkey as mmsi, n_name as name, n_regionkey as customer_id,
  n_nationkey % 2 as fleet_type_id, n_nationkey % 3 as vessel_type_id,
  n_nationkey % 8 <> 7 as is_active,
  cast(1000 + n_nationkey * 10 as double) as dwt, cast(12 as double) as service_speed, 'Malaysia' as flag,
  '/media/c' || cast(n_regionkey as varchar(4)) || '/vessel/' || cast(n_nationkey as varchar(4)) || '/main.png' as image,
  '{"built": "' || cast(1990 + n_nationkey as varchar(4)) || '"}' as additional_info
from nation
union all
select 99, 9000099, 533000099, 'EMPTY SHIP', 99, 0, 0, true, cast(1 as double), cast(1 as double), 'Malaysia', cast(null as varchar(80)), '{}'
""",
    "fx_engine": """
select n_nationkey * 10 + k as id, n_nationkey as vessel_id,
  case when n_nationkey % 5 = 0 and k = 0 then 'ME_PORT'
       when n_nationkey % 5 = 0 and k = 1 then 'ME_CENTRE'
       when n_nationkey % 5 = 0 and k = 2 then 'ME_STBD'
       else lbl end as type,
  lbl as label, cast(100 + n_nationkey * 10 + k as double) as running_hours, '{"no": "' || cast(k as varchar(4)) || '"}' as additional_info
from nation cross join (values (0,'ME1'),(1,'ME2'),(2,'ME3'),(3,'AE1'),(4,'AE2')) as t(k, lbl)
""",
    "fx_device": """
select n_nationkey * 10 + k as device_id, n_nationkey as vessel_id,
  case when k < 5 then n_nationkey * 10 + k end as engine_id,
  case when k = 2 and n_nationkey % 5 = 0 then 1 else tp end as device_type_id, lbl as label_name, (n_nationkey * 10 + k) % 11 <> 0 as is_active
from nation cross join (values (0,1,'ME1'),(1,1,'ME2'),(2,4,'ME3'),(3,2,'AE1'),(4,7,'AE2'),(5,3,'NMEA'),(6,5,'NOON')) as t(k, tp, lbl)
""",
    "fx_device_status": """
select (user_id % 25) * 10 + event_id % 7 as device_id, max(case when ((user_id % 25) * 10 + event_id % 7) % 4 <> 3 then date_trunc('minute', ts) end) as latest_timestamp
from events group by 1
""",
    "fx_interp": """
select event_id as id, user_id % 25 as vessel_id, date_trunc('minute', ts) as nr_time,
  cast(case when event_type <> 'error' then (user_id % 25) * 2 - 25 + (event_id % 40) / 100.0 end as decimal(9,4)) as latitude,
  cast(case when event_type <> 'error' then (user_id % 25) * 3 - 37 + (event_id % 30) / 100.0 end as decimal(9,4)) as longitude,
  cast(case when event_id % 4 <> 0 then (event_id * 37 % 3600) / 10.0 end as decimal(9,4)) as course,
  cast(case when event_id % 5 <> 0 then (event_id * 13 % 250) / 10.0 end as decimal(9,4)) as average_speed_gps,
  cast(case when event_id % 7 <> 0 then (event_id * 11 % 240) / 10.0 end as decimal(9,4)) as speed_through_water,
  cast(case when event_type in ('view','click','purchase') then value end as decimal(18,4)) as me1_consumption,
  cast(case when event_id % 2 = 0 then value end as decimal(18,4)) as me2_consumption,
  cast(case when event_id % 10 = 0 then value end as decimal(18,4)) as me3_consumption,
  cast(case when event_type in ('view','error') then value end as decimal(18,4)) as ae1_consumption,
  cast(case when event_id % 3 = 0 then value end as decimal(18,4)) as ae2_consumption,
  cast(case when event_id % 11 = 0 then value end as decimal(18,4)) as ae3_consumption,
  cast(case when event_type in ('view','error') then event_id % 500 end as decimal(18,4)) as ae1_energy_produced,
  cast(case when event_id % 3 = 0 then event_id % 400 end as decimal(18,4)) as ae2_energy_produced,
  cast(case when event_id % 11 = 0 then event_id % 300 end as decimal(18,4)) as ae3_energy_produced,
  cast(case when event_id % 3 <> 0 then event_id / 10.0 end as decimal(18,4)) as me1_run_hours,
  cast(case when event_id % 4 = 1 then event_id / 20.0 end as decimal(18,4)) as me2_run_hours,
  cast(case when event_id % 50 = 1 then event_id / 40.0 end as decimal(18,4)) as me3_run_hours,
  cast(case when event_id % 6 <> 0 then event_id / 30.0 end as decimal(18,4)) as ae1_run_hours,
  cast(case when event_id % 9 = 1 then event_id / 50.0 end as decimal(18,4)) as ae2_run_hours,
  cast(null as decimal(18,4)) as ae3_run_hours, cast(null as decimal(18,4)) as ae4_run_hours
from events
""",
    "fx_unified": """
select id, vessel_id, nr_time,
  case when id % 9 <> 8 then latitude end as latitude, case when id % 9 <> 8 then longitude end as longitude,
  case when id % 7 <> 6 then average_speed_gps end as average_speed_gps,
  me1_consumption, me2_consumption, me3_consumption,
  case when id % 9 <> 8 then me1_run_hours end as me1_run_hours,
  case when id % 9 <> 8 then me2_run_hours end as me2_run_hours,
  case when id % 9 <> 8 then me3_run_hours end as me3_run_hours
from fx_interp
""",
    "fx_customer_unified": """
select * from fx_interp
""",
    "fx_weather": """
select min(id) as id, date_trunc('hour', nr_time) as time, round(latitude, 1) + case when min(id) % 6 = 0 then 50 else 0 end as lat, round(longitude, 1) as long,
  cast(min(id) * 7 % 13 as int) as beaufourt, cast(min(id) * 3 % 10 as int) as dss,
  cast(min(id) * 17 % 360 as double) as wind_direction, cast(min(id) * 29 % 360 as double) as wave_direction,
  cast(min(id) * 41 % 360 as double) as current_direction, (min(id) % 30) / 2.0 as wind_speed,
  (min(id) % 8) / 2.0 as wave_height, (min(id) % 4) / 2.0 as current_speed
from fx_interp
group by date_trunc('hour', nr_time), round(latitude, 1), round(longitude, 1)
""",
    "fx_ais": """
select event_id as id, user_id % 25 as vessel_id, date_trunc('minute', ts) as report_datetime,
  cast(case when event_id % 13 <> 0 and user_id % 25 <> 4 then (user_id % 25) * 2 - 25 + (event_id % 50) / 100.0 end as decimal(9,4)) as latitude,
  cast(case when event_id % 13 <> 0 and user_id % 25 <> 4 then (user_id % 25) * 3 - 37 + (event_id % 20) / 100.0 end as decimal(9,4)) as longitude,
  cast((event_id * 31 % 3600) / 10.0 as decimal(9,4)) as course
from events
""",
    "fx_canbus": """
select event_id as id, (user_id % 25) * 10 + event_id % 3 as device_id, date_trunc('minute', ts) as message_datetime,
  cast(case when event_id % 6 <> 5 then 600 + event_id % 1200 end as double) as me_rpm, cast(event_id % 100 as double) as me_engine_load,
  cast(40 + event_id % 30 as double) as me_fuel_temp, cast(60 + event_id % 25 as double) as me_oil_temp,
  cast(300 + event_id % 90 as double) as me_exhaust_gas_temp_left,
  cast(300 + event_id % 80 as double) as me_exhaust_gas_temp_right,
  cast(event_id / 10.0 as double) as me_running_hour
from events
""",
    "fx_nmea": """
select event_id as id, (user_id % 25) * 10 + 5 as device_id, date_trunc('minute', ts) as message_datetime,
  cast(case when event_id % 4 <> 0 then (user_id % 25) * 2 - 25 end as double) as latitude,
  cast(case when event_id % 4 <> 0 then (user_id % 25) * 3 - 37 end as double) as longitude,
  cast(case when event_id % 5 <> 0 then event_id % 20 end as double) as speed_over_ground,
  cast(event_id % 25 as double) as wind_speed,
  case when event_id % 2 = 0 then 'T' else 'R' end as reference,
  case when event_id % 7 <> 0 then 'M' else 'N' end as wind_speed_units
from events
""",
    "fx_position_status": """
select * from (values (1,'port','in port'),(2,'anchorage','at anchor'),(3,'underway','moving'),(4,'awaiting_data','no data'),(5,'offshore ops','operating'),(6,'offshore stby','standing by'),(7,'other','other'),(8,'drydock','not a reported class')) as t(id, name, description)
""",
    "fx_vps": """
select event_id as id, user_id % 25 as vessel_id, date_trunc('minute', ts) as report_datetime,
  1 + event_id % 8 as status, cast(event_id % 90 as double) as distance,
  case when event_id % 9 <> 0 then event_id % 10 end as gis_point_id
from events
""",
    "fx_gis_point_type": """
select * from (values (0,'port'),(1,'oil'),(2,'anchorage')) as t(id, name)
""",
    "fx_gis_point": """
select s_suppkey as id, s_name as name, s_name as description, s_suppkey % 3 as gis_point_type_id,
  cast(s_suppkey % 90 as double) as lat, cast(s_suppkey % 180 as double) as long
from supplier
""",
    "fx_alert_type": """
select * from (values (0,0,'none'),(1,1,'engine stop'),(2,2,'high temp'),(3,3,'low oil'),(4,4,'link lost'),(5,5,'notice')) as t(id, severity, description)
""",
    "fx_alert": """
select event_id as id, user_id % 25 as vessel_id, (user_id % 25) * 10 + event_id % 8 as device_id,
  ts as alert_datetime, event_id % 6 as alert_type_id,
  cast((user_id % 25) * 2 - 25 as double) as latitude, cast((user_id % 25) * 3 - 37 as double) as longitude
from events
""",
    "fx_total_fuel": """
select event_id as id, user_id % 25 as vessel_id, date_trunc('hour', ts) as date_hour, cast(value as decimal(18,4)) as consumption from events
""",
    "fx_image": """
select event_id as id, 'D' || cast(user_id % 40 as varchar(8)) as device_serial, 'img' || cast(event_id as varchar(12)) as image, ts as create_datetime
from events
""",
}


def needed_views(*names: str) -> list[str]:
    """The named views and those they read, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in re.findall(r"\bfx_\w+", VIEWS[name]):
            if inner != name:
                visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_clause(body: str) -> str:
    """Prefix ``body`` with the views it mentions as common table expressions."""
    names = needed_views(*sorted(set(re.findall(r"\bfx_\w+", body))))
    ctes = [f"{name} as ({VIEWS[name].strip()})" for name in names]
    text = body.strip()
    if text[:5].lower() == "with ":
        ctes.append(text[5:].lstrip())
        return "with " + ",\n".join(ctes)
    return "with " + ",\n".join(ctes) + "\n" + text


def _zoneless(frame: DataFrame) -> DataFrame:
    """``date_trunc`` widens to zoned timestamps; bring them back to plain ones."""
    zoned = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


class FixtureTables:
    """The telemetry tables over one test-data folder: ``tables.interp`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        view = f"fx_{name}"
        if name.startswith("_") or view not in VIEWS:
            raise AttributeError(name)
        return self._view(view)

    def _view(self, view: str) -> DataFrame:
        if view not in self._frames:
            sql = VIEWS[view]
            for base, schema in BASE_SCHEMAS.items():
                if re.search(rf"\b{base}\b", sql):
                    path = f"{self._folder}/{base}.parquet"
                    self._spark.read.schema(schema).parquet(path).createOrReplaceTempView(base)
            for inner in needed_views(view)[:-1]:
                self._view(inner).createOrReplaceTempView(inner)
            self._frames[view] = _zoneless(self._spark.sql(sql))
        return self._frames[view]


_OPEN: dict[str, tuple[SparkSession, FixtureTables]] = {}


def fixture_tables(spark: SparkSession, folder: str) -> FixtureTables:
    """The tables over ``folder``; their (lazy) frames are built once per session."""
    session, tables = _OPEN.get(folder, (None, None))
    if session is not spark:
        tables = FixtureTables(spark, folder)
        _OPEN[folder] = (spark, tables)
    return tables
