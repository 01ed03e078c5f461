"""Table schemas and the fixed status and error-code values."""

from pyspark.sql import types as T

PENDING, DONE, ERROR, DEFERRED = "pending", "done", "error", "deferred"
STATUSES = (PENDING, DONE, ERROR, DEFERRED)

# HTTP codes worth retrying, and codes for which a retry is pointless.
TRANSIENT_CODES = (429, 500, 502, 503, 504)
PERMANENT_CODES = (400, 401, 403, 404, 405, 410, 451)

URLS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("added_at", T.TimestampType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("category", T.StringType()),
        T.StructField("tagged_by", T.StringType()),
        T.StructField("manual_override", T.IntegerType()),
    ]
)

# Values given to columns that an older snapshot does not have yet.
URL_DEFAULTS = {"status": PENDING, "manual_override": 0}

CATEGORIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("section", T.StringType(), False),
        T.StructField("sort_order", T.LongType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("domain", T.StringType(), False),
        T.StructField("section", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

MODEL_RESULTS = T.StructType(
    [
        T.StructField("url_id", T.LongType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("category", T.StringType()),
        T.StructField("tagged_at", T.TimestampType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

DATASET = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])

BENCH_LOG = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("url_per_sec", T.DoubleType()),
        T.StructField("config", T.StringType()),
    ]
)

DRY_RUN_LOG = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("elapsed_sec", T.DoubleType()),
        T.StructField("url_per_sec", T.DoubleType()),
        T.StructField("processed", T.LongType()),
        T.StructField("config", T.StringType()),
    ]
)
