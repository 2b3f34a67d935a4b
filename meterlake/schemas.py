"""Frames of the domain, as Spark schemas. Columns that an input lacks are taken as null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


#: Observations by the network proxy; timestamps in epoch milliseconds.
PROXY = _schema(
    "timestamp long, message_id string, canonical_request_key string, input_tokens long, output_tokens long, cache_create_tokens long,"
    "cache_read_tokens long, model string, session_id string, request_start_time long, request_end_time long, duration_ms long,"
    "output_tokens_per_second double, ttft_ms long, status_code int, estimated_cost double, cost_locked boolean, api_key_prefix string,"
    "request_base_url string, client_tool string"
)
#: Observations from local transcripts; timestamps in epoch seconds, request_count is a weight.
LOCAL = _schema(
    "session_id string, tool string, message_id string, request_key string, timestamp long, model string, input_tokens long,"
    "output_tokens long, cache_create_tokens long, cache_read_tokens long, total_tokens long, request_count long, explicit_estimated_cost double"
)
SESSIONS = _schema(
    "session_id string, tool string, cwd string, project_name string, file_path string, models array<string>, start_time long, end_time long,"
    "last_modified long, request_count long, input_tokens long, output_tokens long, cache_create_tokens long, cache_read_tokens long, estimated_cost double"
)
PRICES = _schema(
    "model_id string, display_name string, input_price double, output_price double, cache_read_price double, cache_write_price double, source string, last_updated long, rank int"
)
#: One row for each request, whoever saw it.
FACTS = _schema(
    "canonical_request_key string, session_id string, project_name string, project_path string, api_key_prefix string, request_base_url string,"
    "source_label string, tool string, timestamp_sec long, timestamp_ms long, model string, input_tokens long, output_tokens long,"
    "cache_create_tokens long, cache_read_tokens long, total_tokens long, request_count long, estimated_cost double, coverage_origin string,"
    "status_code int, duration_ms long, output_tokens_per_second double, ttft_ms long"
)

PROXY_ONLY, LOCAL_ONLY, MERGED = "proxy_only", "local_only", "merged_proxy_preferred"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns, in its order: missing ones null, others dropped, counters never negative."""
    have = set(df.columns)

    def column(field: T.StructField):
        c = F.col(field.name).cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        return (F.greatest(c, F.lit(0)) if field.name.endswith("_tokens") else c).alias(field.name)

    return df.select(*map(column, schema.fields))
