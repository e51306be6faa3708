"""Publishing a version of the warehouse: a manifest first, the pointer last.

Phase one writes everything a version consists of into a folder of its own and lists its tables, with
their row counts, in ``manifest``. Phase two appends one row to the pointer table. Readers follow the
newest pointer row and open tables through its manifest, so they see all tables of one version or all of
the one before; a failure before the pointer row leaves the old version active.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "active_pointer"
MANIFEST_SCHEMA = "version string, table_name string, path string, rows bigint, schema_json string"
POINTER_SCHEMA = "key string, version string, path string, activated_at timestamp"


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing is there; every other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_manifest(spark: SparkSession, path: str, version: str, tables: dict[str, DataFrame]) -> None:
    """Phase one: count every written table and list it with its schema (a table without rows may have no file)."""
    rows = [(version, name, f"{path}/{name}", df.count(), df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{path}/manifest")


def point_to(spark: SparkSession, root: str, version: str, path: str, at: dt.datetime) -> None:
    """Phase two: the version becomes the active one."""
    missing = spark.read.parquet(f"{path}/manifest").filter(F.col("version") != version).count()
    if missing:
        raise ValueError(f"the manifest under {path} is not that of version {version}")
    spark.createDataFrame([("active", version, path, at)], POINTER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{POINTER}")


def active(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(version, folder) of the active version."""
    pointers = read_if_there(spark, f"{root}/{POINTER}")
    row = pointers.orderBy(F.desc("activated_at")).first() if pointers is not None else None
    return (row["version"], row["path"]) if row else None


def open_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every table a version's manifest lists."""
    out = {}
    for r in spark.read.parquet(f"{path}/manifest").collect():
        schema = StructType.fromJson(json.loads(r["schema_json"]))
        out[r["table_name"]] = spark.read.schema(schema).parquet(r["path"]).select(*schema.fieldNames())
    return out
