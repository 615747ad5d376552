"""Table writes: upsert, season replacement, repair, archives and JSON sinks.

Parquet has no MERGE, so a change rewrites the partitions it touches. The new
content is checkpointed before the write, because Spark does not overwrite a
path that the same plan still reads.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from courtline.session import ensure_checkpoint_dir


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``, by aggregation rather than a sort."""
    values = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(newest.alias("v")).select(*keys, "v.*").select(*rows.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows without the new keys, and the latest new row per key."""
    latest = latest_by_key(new, keys, order)
    kept = existing.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*existing.columns))


def _read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def _current(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    table = _read(spark, path, like.schema)
    return spark.createDataFrame([], like.schema) if table is None else table


def _overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition
    ).parquet(path)


def _partition_folder(path: str, partition: str, value: object) -> str:
    """Folder of a partition value, escaped as Spark names it."""
    text = "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else str(value)
    escaped = "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in text)
    return f"{path}/{partition}={escaped}"


def _rewrite(path: str, merged: DataFrame, touched: DataFrame, partition: str) -> None:
    """Replace the touched partitions by ``merged``; one that is left without rows is emptied.

    A dynamic overwrite leaves alone what it has no row for, so an emptied partition is
    overwritten by no rows. As many values reach the driver as partitions were emptied.
    """
    spark = merged.sparkSession
    empty = touched.join(merged.select(partition).distinct(), partition, "left_anti").collect()
    _overwrite_partitions(merged, path, partition)
    none = spark.createDataFrame([], merged.drop(partition).schema)
    for row in empty:
        none.write.mode("overwrite").parquet(_partition_folder(path, partition, row[0]))


def upsert_table(
    path: str, new: DataFrame, keys: list[str], order: list[str], partition: str | None = None
) -> None:
    """Upsert into a stored table: the latest new row of each key replaces what is stored.

    Rewritten are the partitions in ``new`` and those that hold one of its keys, so a key
    whose partition changed moves and does not stay twice. Without ``partition`` the whole
    table is rewritten; that is for dimensions.
    """
    spark = new.sparkSession
    ensure_checkpoint_dir(spark)
    table = _current(spark, path, new)
    if partition is None:
        upsert(table, new, keys, order).checkpoint().write.mode("overwrite").parquet(path)
        return
    held = table.join(new.select(*keys).distinct(), keys, "left_semi").select(partition).distinct().checkpoint()
    touched = held.union(new.select(partition)).distinct()
    current = table.join(touched, partition, "left_semi").select(*new.columns)
    _rewrite(path, upsert(current, new, keys, order).checkpoint(), held, partition)


def replace_partitions(path: str, new: DataFrame, partition: str, force: bool = True) -> bool:
    """Replace whole partitions; without ``force`` skip when any is already there."""
    spark = new.sparkSession
    table = None if force else _read(spark, path)
    if table is not None:
        present = table.select(partition).distinct()
        if not new.select(partition).join(present, partition, "left_semi").isEmpty():
            return False
    _overwrite_partitions(new, path, partition)
    return True


def repair_games(path: str, game_ids: DataFrame, fresh: DataFrame, partition: str) -> None:
    """Drop the rows of some games, wherever they are stored, and put the re-ingested ones in.

    ``game_ids`` has game_id.
    """
    spark = fresh.sparkSession
    ensure_checkpoint_dir(spark)
    held = (
        _current(spark, path, fresh).join(game_ids.select("game_id").distinct(), "game_id", "left_semi")
        .select(partition).distinct().checkpoint()
    )
    touched = held.union(fresh.select(partition)).distinct()
    current = _current(spark, path, fresh).join(touched, partition, "left_semi")
    kept = current.join(game_ids.select("game_id").distinct(), "game_id", "left_anti")
    _rewrite(path, kept.select(*fresh.columns).unionByName(fresh).checkpoint(), held, partition)


def archive_predictions(path: str, predictions: DataFrame, day: str = "prediction_date") -> None:
    """Keep each day's predictions in its own partition; a rerun replaces that day."""
    _overwrite_partitions(predictions, path, day)


def write_json(path: str, report: DataFrame) -> None:
    report.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Buckets of a stored fact table; the same for all tables that are joined on the key.
BUCKETS = 32


def store_bucketed(df: DataFrame, path: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Store a fact table under ``path`` in buckets of ``key``, sorted inside, and read it back.

    Tables of equal buckets are joined on the key where they lie, without an exchange. Only
    the session's catalogue knows the buckets; the files are plain Parquet.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    # rows of a bucket meet in one task, so that a bucket is one file
    spread = df.repartition(buckets, key)
    spread.write.bucketBy(buckets, key).sortBy(key, *[c for c in order if c != key]).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def join_stored(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join two tables of ``store_bucketed``: a merge join of their buckets, whatever their sizes."""
    return left.join(right.hint("merge"), key, how)
