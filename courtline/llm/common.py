"""Shared helpers: word hashes inside tasks, checkpoints, graph components, expression parts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.session import ensure_checkpoint_dir

#: Java pattern of one separator; words are runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Entries a worker's word cache may hold before it starts anew.
CACHE_WORDS = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder; for rows that hold texts."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text, none for null; JVM only."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.array_remove(parts, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_sample(df: DataFrame, key: str, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows at most: those whose hashed key lies under rows / count.

    The expected size is the stated bound whatever the input's, so it may be broadcast.
    """
    count = df.count()
    unit = F.crc32(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary")) / F.lit(float(2**32))
    return df.filter(unit * count < rows) if count > rows else df


def _json_safe(kind: str) -> pa.DataType:
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "longs": pa.list_(pa.int64()),
        "ints": pa.list_(pa.int32()), "doubles": pa.list_(pa.float64()),
        "strings": pa.list_(pa.string()), "booleans": pa.list_(pa.bool_()),
    }[kind]


_DDL = {
    "longs": "array<bigint>", "ints": "array<int>", "doubles": "array<double>", "long": "bigint",
    "strings": "array<string>", "booleans": "array<boolean>",
}


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict[str, list]]], schema: dict[str, str]
) -> DataFrame:
    """``fn`` turns one Arrow batch into dicts of columns; one output batch for each dict."""
    arrow = pa.schema([(n, _json_safe(k)) for n, k in schema.items()])
    ddl = ", ".join(f"`{n}` {_DDL.get(k, k)}" for n, k in schema.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, ddl)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept per worker and emptied at a fixed size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size))
        for i in range(size):
            out = (out ^ hashes[i : i + n]) * _M1
            out ^= out >> np.uint64(29)
        return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Smallest label of the neighbours, then a jump to the label's own label, until nothing
    changes: about log2(diameter) rounds. All state stays in tables; each round ends in a
    checkpoint. Nodes of no edge are not listed. No edges: no rows.
    """
    both = saved(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b").distinct()
    )
    label = saved(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("component"))
    )
    while True:
        near = (
            both.join(label.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        step = label.join(near, "node").select(
            "node", F.col("component").alias("before"),
            F.least("component", "near").alias("component"),
        )
        # a label names a node, so its own label is at least as small
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        label = saved(
            step.join(jump, "component", "left").select(
                "node", "before", F.least("component", "far").alias("component")
            )
        )
        moved = label.filter("component <> before").limit(1).count()
        label = label.select("node", "component")
        if not moved:
            return label
