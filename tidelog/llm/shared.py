"""What the operators of this package share: table access, scratch tables and hashing of names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.scratch import checkpointed, shared_folder

__all__ = ["checkpointed", "clear_scratch", "dropped", "read_table", "shared_folder", "ship_package", "written"]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application, wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog.zip"
        with zipfile.ZipFile(target, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidelog-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables. Results that have not been written or collected need them."""
    _delete(spark, _scratch(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs a reread of the table, not a recomputation of all
    that came before.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that no result needs any more, to free their disk; others stay."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            _delete(table.sparkSession, path)
