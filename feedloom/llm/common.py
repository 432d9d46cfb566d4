"""Helpers the corpus operators share: words, rows as bytes, distributed running sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Narrow keys are broadcast up to so many counted rows.
BROADCAST_ROWS = 1_000_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(data: bytes) -> list[bytes]:
    """`WORD` over UTF-8: bytes.split() cuts at exactly those six characters."""
    return data.split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), over an array."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def chained(columns: Sequence[np.ndarray]) -> np.ndarray:
    """One 64-bit hash per position from several arrays, in order."""
    acc = np.full(len(columns[0]), _MIX[0], np.uint64)
    for c in columns:
        acc = mixed(acc * _MIX[2] + c.astype(np.uint64) + _MIX[0])
    return acc


class Memo(dict):
    """A dict that computes missing values and keeps at most `limit` of them, so a worker's memory stays bounded.

    Values are held in two generations of half the limit: when the young one is full it becomes the old one, from which
    values in use move back.  Frequent keys so outlive the many that occur once.
    """

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def per_batch(fn: Callable[[dict[str, list]], dict[str, list] | None], schema: pa.Schema) -> Callable:
    """A mapInArrow function from one over columns as Python lists.

    Rows are passed on in slices, so neither the lists nor the answer of a
    slice hold more than a few hundred texts at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], f.type) for f in schema], schema=schema
                    )

    return run


def carry(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator reads, and the whole row as one struct `_row`.

    Its own columns so never meet the caller's, whatever their names; `_row.*` gives those back.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(*needed, whole.alias("_row"))


def if_small(keys: DataFrame) -> DataFrame:
    """A written table of narrow keys, marked for broadcast if its counted rows are few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def text_hash(text: Column) -> Column:
    """Tells the texts of rows with one doc_id apart; NULL has a value of its own."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def running_sum(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], size: Column,
                total: str, before: str) -> DataFrame:
    """Add, per key, the sum of `size` over all earlier buckets and earlier rows of the own bucket.

    `bucket` must rise with `order`.  A hot key is spread over its buckets: sums per (key, bucket) are
    combined before the shuffle, the running sums over buckets are a narrow table, and only the rows of
    one bucket meet in a task.  `total` gets the bucket's sum, `before` the sum of all that comes first.
    """
    from pyspark.sql import Window

    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(size).alias(total))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum(total).over(over), F.lit(0)))
    for k in keys:
        offsets = offsets.withColumnRenamed(k, f"_k_{k}")
    match = [rows["_bucket"] == offsets["_bucket"]] + [rows[k].eqNullSafe(offsets[f"_k_{k}"]) for k in keys]
    joined = rows.join(offsets.withColumnRenamed("_bucket", "_b"),
                       [rows["_bucket"] == F.col("_b")] + match[1:])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(before, F.col("_offset") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop(
        "_b", "_offset", *[f"_k_{k}" for k in keys]
    )
