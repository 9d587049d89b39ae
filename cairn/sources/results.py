"""Results of runs as tables that are added to, and tables that are made once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_run(poses: DataFrame, metrics: dict[str, float], path: str, run: str) -> None:
    """SK4: poses and metrics of a run, in tables by run; the same run again replaces its own part alone."""
    values = poses.sparkSession.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")
    for name, rows in (("poses", poses), ("metrics", values)):
        rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, name: str = "poses", run: str | None = None) -> DataFrame:
    """SK4: a table of a run, without one that of the last by name; a filter on run prunes folders."""
    found = spark.read.parquet(f"{path}/{name}").schema
    # A name of digits stays a name.
    rows = spark.read.schema(T.StructType([T.StructField("run", T.StringType()) if f.name == "run" else f for f in found])).parquet(f"{path}/{name}")
    which = run if run is not None else rows.agg(F.max("run")).first()[0]
    return rows.filter(F.col("run") == which)


def append_errors(errors: DataFrame, mode: str, path: str) -> None:
    """SK5: errors added to a table by mode."""
    errors.withColumn("mode", F.lit(mode)).write.mode("append").partitionBy("mode").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], reset: bool = False) -> DataFrame:
    """SK8, IT16: the table at path, made and written if there is none or `reset` says so."""
    if not reset:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
