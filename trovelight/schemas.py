"""The tables, and a check that a DataFrame has the columns an operator reads."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Schemas are DDL text, so that tasks can load this module without a session.

ASSETS = (
    "asset_id BIGINT, collection STRING, filename STRING, asset_type STRING, mime STRING, "
    "size_bytes INT, sha256 STRING, status STRING, error STRING, started_at TIMESTAMP, "
    "attempts INT, title STRING, description STRING, tags ARRAY<STRING>, visible_text STRING, "
    "image_type STRING, vision_model STRING, created_at TIMESTAMP"
)

# Other names of an asset's bytes, one row each: a file copied under millions of names stays a table.
ALIASES = (
    "collection STRING, sha256 STRING, asset_id BIGINT, alias STRING, first_arrival BIGINT"
)

UNITS = (
    "unit_id BIGINT, asset_id BIGINT, collection STRING, asset_type STRING, kind STRING, "
    "unit_index INT, start_char INT, end_char INT, body STRING"
)

VECTORS = "unit_id BIGINT, embedding ARRAY<FLOAT>, embedding_model STRING"

POSTINGS = (
    "collection STRING, term STRING, unit_id BIGINT, asset_id BIGINT, kind STRING, "
    "asset_type STRING, tf INT, positions ARRAY<INT>"
)

METADATA = (
    "title STRING, description STRING, tags ARRAY<STRING>, visible_text STRING, image_type STRING"
)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """`df` itself; raises ValueError when it lacks one of the columns."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def need_table(df: DataFrame, ddl: str) -> DataFrame:
    """`df` itself; raises ValueError when a column of the schema is missing or of another type."""
    schema = T.StructType.fromDDL(ddl)
    need(df, *schema.fieldNames())
    found = {field.name: field.dataType for field in df.schema.fields}
    wrong = [
        f"{field.name} is {found[field.name].simpleString()}, not {field.dataType.simpleString()}"
        for field in schema.fields
        if found[field.name].simpleString() != field.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
