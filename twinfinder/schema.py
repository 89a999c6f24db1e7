"""Record shapes: the content log, the catalog row, listings, plans and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

DIMENSION = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])

FILE_RECORD = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("last_modified", T.LongType()),
    T.StructField("missing", T.BooleanType()),
    T.StructField("mime", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("video_hash", T.StringType()),
    T.StructField("pdf_hash", T.StringType()),
    T.StructField("audio_hash", T.StringType()),
    T.StructField("image_size", DIMENSION),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])

# The short keys of the JSON-lines log, in record order.
JSON_KEYS = {
    "h": "hash",
    "p": "path",
    "s": "size",
    "l": "last_modified",
    "d": "missing",
    "m": "mime",
    "f": "fingerprint",
    "vh": "video_hash",
    "ph": "pdf_hash",
    "ah": "audio_hash",
    "is": "image_size",
    "at": "attributes",
}

JSON_RECORD = T.StructType([T.StructField(k, FILE_RECORD[c].dataType) for k, c in JSON_KEYS.items()])

LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("last_modified", T.LongType()),
])

PLAN = ["action", "repo", "path", "target", "reason"]

DEFAULT_BUCKETS = 10


def records(df: DataFrame) -> DataFrame:
    """Give `df` every column of the file record, adding typed nulls for those it lacks."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in FILE_RECORD
    ])


def normalise(log: DataFrame) -> DataFrame:
    """Apply the load-time defaults: null mime and hash are empty, null path is ".", null size is 0."""
    defaults = {
        "hash": F.lit(""),
        "path": F.lit("."),
        "size": F.lit(0).cast("bigint"),
        "last_modified": F.lit(0).cast("bigint"),
        "missing": F.lit(False),
        "mime": F.lit(""),
        "attributes": F.create_map().cast("map<string,string>"),
    }
    return log.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in log.columns})


def bucket_of(size: Column | str, buckets: int) -> Column:
    """The storage bucket of a record."""
    return F.pmod(F.col(size) if isinstance(size, str) else size, F.lit(buckets).cast("bigint"))
