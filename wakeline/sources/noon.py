"""The noon log: a CSV of 43 columns where both ``NaN`` and nothing mean missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the noon log, in file order. All are numbers but
# the three text columns and the row number.
NOON_COLUMNS = (
    "Log_No", "Datetime_UTC", "T_f", "T_a", "Trim", "Load_Condition", "BF", "DSS", "STW",
    "Speed_Loss", "ME1FOC", "ME1Power", "ME1SFOC", "DelME1FOC", "DelME1SFOC", "ME1margin",
    "ME1RPM", "AE1_FOC", "AE1_SFOC", "BL_FOC", "Consider_Hull", "Consider_Machinery",
    "Consider_AER", "Speed_quality", "Speed_Loss_quality", "DelME1FOC_quality",
    "DelME1SFOC_quality", "ME1Power_quality", "ME1margin_quality", "AE1_Cons_quality",
    "ME1RPM_quality", "AER_ideal", "AER_daily", "AER_moving", "AER_ME", "AER_AE", "AER_other",
    "AER_AE_moving", "AER_other_moving", "AER_daily_peak", "AER_AE_peak", "AER_other_peak",
    "AER_Condition",
)
_TEXT = ("Datetime_UTC", "Load_Condition", "AER_Condition")

NOON_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.LongType()
            if name == "Log_No"
            else T.StringType()
            if name in _TEXT
            else T.DoubleType(),
        )
        for name in NOON_COLUMNS
    ]
)
_OPTIONS = {"nanValue": "NaN", "nullValue": "", "mode": "FAILFAST"}


def _missing_as_null(frame: DataFrame) -> DataFrame:
    numbers = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.DoubleType)]
    texts = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    return frame.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in numbers}
        | {c: F.nullif(F.col(c), F.lit("NaN")) for c in texts}
    )


def read_noon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Noon log files, header included, missing numbers as null."""
    reader = spark.read.schema(NOON_SCHEMA).option("header", True).options(**_OPTIONS)
    return _missing_as_null(reader.csv(path))


def parse_noon_lines(lines: DataFrame, line: Column | str = "line") -> DataFrame:
    """Noon log lines held in a column, without the header."""
    text = F.col(line) if isinstance(line, str) else line
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NOON_SCHEMA.fields)
    parsed = lines.select(F.from_csv(text, schema, _OPTIONS).alias("row"))
    return _missing_as_null(parsed.select("row.*"))
