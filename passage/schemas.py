"""Fixed schemas of the raw and derived tables."""

from pyspark.sql import types as T

DEVICE = T.StructType([
    T.StructField("mac_hash", T.StringType()),
    T.StructField("rssi", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
])

# One scan record (a JSON line): the devices one scan saw at one site.
SCAN = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("scan_id", T.LongType()),
    T.StructField("device_count", T.IntegerType()),
    T.StructField("devices", T.ArrayType(DEVICE)),
])

SCAN_WITH_CORRUPT = T.StructType(SCAN.fields + [T.StructField("_corrupt_record", T.StringType())])

# One row per device per scan.
DETECTION = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("scan_id", T.LongType()),
    T.StructField("mac_hash", T.StringType()),
    T.StructField("rssi", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
])
