"""The change envelope.

A change is a row: where it came from, what it did, and images of the record before and
after. Images are maps from column to text: a missing key means the column did not change,
a null value that it was set to null.
"""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE = T.MapType(T.StringType(), T.StringType())
OPS = ("c", "u", "d", "r")

ENVELOPE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("tbl", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("offset", T.StringType()),
    T.StructField("lsn", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("before", IMAGE),
    T.StructField("after", IMAGE),
])
HEADERS = ("instance_id", "schema", "tbl", "op", "offset", "lsn")
