"""Schemas, declared once and checked on read; batch and stream share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The channels of the compressor telemetry.
ANALOG = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current")
DIGITAL = ("COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses")

TELEMETRY = T.StructType([T.StructField("timestamp", T.TimestampType()), *[T.StructField(c, T.FloatType()) for c in ANALOG], *[T.StructField(c, T.ByteType()) for c in DIGITAL]])
#: What replay and scoring need.
STREAM = T.StructType([T.StructField("asset", T.LongType()), T.StructField("timestamp", T.TimestampType()), *[T.StructField(c, T.FloatType()) for c in ANALOG], T.StructField("COMP", T.ByteType()), T.StructField("LPS", T.ByteType())])
SNAPSHOT = T.StructType([T.StructField("test", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("channel", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


class SchemaError(ValueError):
    pass


def require(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df
