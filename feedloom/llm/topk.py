"""Exact top-k by inner product, over vectors in descending order of length.

Vectors become whole numbers (`floor(scale * x)`), are range-sorted by length and packed into blocks.  Every query
first meets the blocks of the longest vectors; its k-th best score there is its threshold.  A later block is
left out for a query block if, by Cauchy-Schwarz, length times length cannot reach any of its thresholds.  In
the blocks left, query and block are rotated by the right singular vectors of a bounded sample, so that the first
coordinates carry most of the product; a candidate is scored only if the partial product plus the product of the
residual lengths reaches the threshold.  Scores come from the whole numbers, exactly.

The rotation only decides how much is pruned, never the result, so a sample of `SAMPLE` vectors is enough for it.
Work is laid out as (query block, candidate block) cells of bounded size, which are rows of a table; each cell gives out at
most k candidates a query.  Nothing is sampled or capped in the search.

Vectors that are NULL, or hold NULL or non-finite components, and rows without id take no part.  Shorter vectors count as
padded with zeros.  Ties go to the smaller id.  Rows with repeated ids are candidates of their own, except for the
query of that id; of repeated query ids the least vector asks.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SCALE, BLOCK, QUERY_BLOCK, SAMPLE = 1024, 2048, 512, 4096
#: Blocks of the longest vectors that every query meets first, for its threshold.
HEAD = 2
_LIMIT = 1 << 62


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
    )


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Whole numbers as float64, one row per vector, padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, cols] = np.clip(np.floor(scale * flat), -_LIMIT, _LIMIT)
    return out


def packed(sorted_rows: DataFrame, dim: int, size: int, scale: int) -> DataFrame:
    """(n, longest, ids, ints): blocks of consecutive rows."""
    schema = pa.schema([("n", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("ints", pa.binary())])

    def block(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        longest = float(np.sqrt((m * m).sum(axis=1)).max())
        cols = [[len(ids)], [longest], [ids.tobytes()], [m.astype(np.int64).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = np.empty(0, np.int64), np.empty((0, dim))
        for b in batches:
            ids = np.concatenate([ids, b.column("id").to_numpy(zero_copy_only=False)])
            m = np.concatenate([m, _matrix(b.column("v"), dim, scale)])
            while len(ids) >= size:
                yield block(ids[:size], m[:size])
                ids, m = ids[size:], m[size:]
        if len(ids):
            yield block(ids, m)

    return sorted_rows.mapInArrow(run, "n long, longest double, ids binary, ints binary")


def numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks with a number from 0, the longest first; numbers come from a narrow table of block lengths."""
    stats = blocks.select("block", "longest")
    nth = F.row_number().over(Window.orderBy(F.col("longest").desc(), "block")) - 1
    return blocks.join(stats.select("block", nth.alias(name)), "block").drop("block")


def rotation(vectors: DataFrame, dim: int, scale: int) -> np.ndarray:
    """Right singular vectors of the `SAMPLE` vectors with the least id hashes."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    m = _matrix(sample.column("v").combine_chunks(), dim, scale)
    return np.linalg.svd(m, full_matrices=True)[2].T if len(m) else np.eye(dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: by floats where they cannot round, else by Python integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ c.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_cell(q_ids, q, floors, c_ids, c, turn, k) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the candidates of one cell that reach their query's floor."""
    head = max(1, q.shape[1] // 4)
    rq, rc = q @ turn, c @ turn
    partial = rq[:, :head] @ rc[:, :head].T
    left_q, left_c = np.sqrt((rq[:, head:] ** 2).sum(axis=1)), np.sqrt((rc[:, head:] ** 2).sum(axis=1))
    size_q, size_c = np.sqrt((q.astype(float) ** 2).sum(axis=1)), np.sqrt((c.astype(float) ** 2).sum(axis=1))
    for i in range(len(q_ids)):
        # Room for rounding: the bound is computed in floats, the scores in whole numbers.
        bound = partial[i] + left_q[i] * left_c + 1e-9 * size_q[i] * size_c + 1
        at = np.flatnonzero((bound >= floors[i]) & (c_ids != q_ids[i]))
        if len(at):
            scores = _products(q[i:i + 1], c[at])[0]
            best = _best(c_ids[at], scores, k)
            yield int(q_ids[i]), c_ids[at][best], scores[best]


_UNPACK = (("ids", np.int64), ("ints", np.int64))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest inner products with other rows."""
    spark = rows.sparkSession
    vectors = valid_vectors(rows, id_col, vec_col)
    asking = valid_vectors(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    dim = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0, asking.agg(F.max(F.size("v"))).first()[0] or 0)
    turn = rotation(vectors, dim, scale)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(scale * x).cast("double") * F.floor(scale * x).cast("double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(frame: DataFrame, size: int, name: str) -> DataFrame:
        ordered = frame.withColumn("_l", length).repartitionByRange(parts, F.col("_l").desc(), "id").sortWithinPartitions(
            F.col("_l").desc(), "id"
        ).select("id", "v")
        saved = written(packed(ordered, dim, size, scale).withColumn("block", F.monotonically_increasing_id()), name)
        return written(numbered(saved, name), name)

    cand, ask = blocks(vectors, BLOCK, "c"), blocks(asking, QUERY_BLOCK, "q")
    n_blocks = cand.count()
    floor_schema = pa.schema([("q", pa.int64()), ("floors", pa.binary()), ("least", pa.float64())])
    hit_schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def vectors_of(row: dict, tag: str):
        ids = np.frombuffer(row[f"{tag}_ids"], np.int64)
        return ids, np.frombuffer(row[f"{tag}_ints"], np.int64).reshape(len(ids), dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (q_ids, q), (c_ids, c) = vectors_of(row, "q"), vectors_of(row, "c")
                floors = np.frombuffer(row["floors"], np.int64) if row["floors"] else np.full(len(q_ids), -(1 << 63))
                found = list(search_cell(q_ids, q, floors, c_ids, c, turn, k))
                cols = [
                    np.full(sum(len(x[1]) for x in found), row["q"]), np.repeat([x[0] for x in found], [len(x[1]) for x in found]),
                    np.concatenate([x[1] for x in found]) if found else [], np.concatenate([x[2] for x in found]) if found else [],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in cols], schema=hit_schema)

    def cells(pairs: DataFrame) -> DataFrame:
        """Search the (q, c, floors) cells given; a task takes a few at a time."""
        side = lambda f, t: f.select(F.col(t), F.col("ids").alias(f"{t}_ids"), F.col("ints").alias(f"{t}_ints"))
        full = pairs.join(side(ask, "q"), "q").join(side(cand, "c"), "c")
        return full.mapInArrow(search, "q long, query_id long, vec_id long, score long")

    def best(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = ask.select(F.col("q").cast("long")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(min(HEAD, n_blocks) - 1))) if n_blocks else F.lit(0)
    ).withColumn("floors", F.lit(None).cast("binary"))
    head = written(best(cells(first)), "head")

    def set_floors(key, q_row, hits):
        import pandas as pd

        ids = np.frombuffer(q_row["ids"].iloc[0], np.int64)
        ints = np.frombuffer(q_row["ints"].iloc[0], np.int64).reshape(len(ids), dim).astype(float)
        at_k = hits[hits["rank"] == k].set_index("query_id")["score"]
        floors = np.array([at_k.get(i, -(1 << 63)) for i in ids], np.int64)
        sizes = np.maximum(np.sqrt((ints * ints).sum(axis=1)), 1e-9)
        least = float((floors / sizes).min())
        return pd.DataFrame({"q": [int(key[0])], "floors": [floors.tobytes()], "least": [least]})

    # One group is one block of queries with at most k hits each.
    floors = ask.select(F.col("q").cast("long"), "ids", "ints").groupBy("q").cogroup(head.groupBy("q")).applyInPandas(
        lambda key, a, b: set_floors(key, a, b), "q long, floors binary, least double"
    )
    later = floors.withColumn("c", F.explode(F.sequence(F.lit(HEAD), F.lit(n_blocks - 1)))) if n_blocks > HEAD else None
    hits = head.drop("rank")
    if later is not None:
        lengths = cand.select("c", "longest")
        reach = F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least")
        hits = hits.unionByName(cells(later.join(lengths, "c").where(reach).select("q", "c", "floors")))
    return best(hits).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def topk_sql(k: int = 10) -> str:
    """DuckDB SQL for the same over `embeddings`, with ids divisible by 100 as queries."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
