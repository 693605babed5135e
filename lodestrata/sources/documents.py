"""JSON documents and Parquet stage tables.

Stage tables of any size are Parquet, partitioned by run. JSON documents (one array or object in a file,
keys sorted, indented) are for small reports and for exchange; rows are gathered for them only up to a bound.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Rows that a JSON document may have; larger tables are written as Parquet.
MAX_DOCUMENT_ROWS = 100_000


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file (or of files) that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def dump_json(value: Any) -> str:
    return json.dumps(value, indent=2, sort_keys=True)


def write_json(path: str | Path, value: Any) -> str:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(dump_json(value), encoding="utf-8")
    return str(path)


def document_rows(df: DataFrame) -> list[dict[str, Any]]:
    """All rows, in their order, for a JSON document; ValueError beyond MAX_DOCUMENT_ROWS."""
    rows = df.limit(MAX_DOCUMENT_ROWS + 1).collect()
    if len(rows) > MAX_DOCUMENT_ROWS:
        raise ValueError(f"over {MAX_DOCUMENT_ROWS} rows; use write_stage")
    return [r.asDict(recursive=True) for r in rows]


def write_json_array(df: DataFrame, path: str | Path) -> str:
    """The rows, in their order, as one JSON array; ValueError beyond MAX_DOCUMENT_ROWS."""
    return write_json(path, document_rows(df))


def write_stage(df: DataFrame, root: str, stage: str, run_id: str) -> str:
    """A stage's table as Parquet under root/stage/run_id=...; fails if the run has written it already."""
    path = f"{root.rstrip('/')}/{stage}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_stage(spark: SparkSession, root: str, stage: str, schema: str) -> DataFrame:
    """A stage's rows of all runs, with run_id; a filter on run_id prunes directories."""
    return spark.read.schema(f"{schema}, run_id STRING").parquet(f"{root.rstrip('/')}/{stage}")
