"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds (L2AP style).

Every anchor has as positives its best rows of the same label, and for each positive a window of scores in which
its hard negatives lie: `low` to `high` per cent of the positive's score.  Both searches are one operation, a
threshold join: all rows whose inner product with an anchor reaches that anchor's threshold.

- **Index.** Rows are packed into blocks where they lie, without a shuffle.  The dimensions of a block stand in ascending order of
  energy (measured on a bounded sample) and are grouped by `CHUNK`.  A row enters the lists of a dimension
  group only from the place on where the norm of what stands before, times the anchors' norm there, could reach the least
  threshold; the dimensions before are covered by that bound and are left out.
- **Search.** Partial scores are accumulated from the strongest dimension group down.  After each group a pair goes on only if
  its partial score plus the product of the remaining norms reaches the threshold.  Pairs that are left are scored from
  the whole numbers, exactly.
- **Thresholds.** `SAMPLE` rows with the least id hashes give first thresholds: the score of the k-th best sampled row is never
  above the true one, so one pass is enough where the sample fills a window.  All others begin at a share of their window (`STEPS`),
  and those that are not full then are searched again at a lower one, down to their lower end.

The sample and the steps decide how much is pruned, never the result.  Blocks of rows and groups of anchors meet as cells of
bounded size; a cell gives out at most k rows a window, so neither a hot label nor a group of equal vectors meets in a task.

Defined results: rows without id or label, and vectors that are NULL or hold NULL or non-finite components, take no part.
Shorter vectors count as padded with zeros, an empty one as all zeros.  Ties go to the smaller id.  Rows with repeated ids are
rows of their own, except for the anchor of that id; of repeated anchor ids the least (vector, label) asks.  Scores outside 64
bits stand at its ends.  Windows without a row give none, an empty table gives an empty result; columns other than the
named three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SCALE, BLOCK, GROUP, SAMPLE, CHUNK = 256, 8192, 512, 4096, 8
#: Where a window that the sample does not fill starts: shares of its width above its lower end, round by round.
STEPS = (0.5, 0.0)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FLOATS = 1 << 53


def labelled_vectors(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
    )


def whole_numbers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) per component as doubles, which hold them exactly; one row per vector, padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(scale * flat)
    return out


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of one row with many: by doubles where they cannot round, else by Python's integers."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, len(x)) < _FLOATS:
        return (y @ x).astype(np.int64)
    ints = [int(a) for a in x]
    return np.array([min(_MOST, max(_LEAST, sum(a * int(b) for a, b in zip(ints, row)))) for row in y], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Index:
    """One block's inverted lists: per group of dimensions the rows that still need it, and norms of what stands before."""

    def __init__(self, y: np.ndarray, order: np.ndarray, anchor_norms: np.ndarray, least: float):
        self.y = y[:, order]
        self.norms = prefix_norms(self.y)
        # What a row's first k groups can add to any anchor; rows whose whole product stays below are in no list.
        reach = self.norms * (anchor_norms * (1 + 1e-9)) + 1e-6
        self.first = (reach < least).sum(axis=1) - 1 if least > 0 else np.full(len(y), -1)
        self.listed = np.flatnonzero(self.first < self.groups)

    @property
    def groups(self) -> int:
        return self.norms.shape[1] - 1

    def candidates(self, x: np.ndarray, x_norms: np.ndarray, floor: float, allowed: np.ndarray) -> np.ndarray:
        """Places whose product with `x` may reach `floor`; `allowed` masks the listed rows."""
        alive = self.listed[allowed]
        kept, partial = [], np.zeros(len(alive))
        for g in range(self.groups - 1, -1, -1):
            if not len(alive):
                break
            dims = slice(g * CHUNK, (g + 1) * CHUNK)
            partial = partial + self.y[alive, dims] @ x[dims]
            # Room for rounding: the bound is in doubles, the scores are whole numbers.
            rest = x_norms[g] * self.norms[alive, g]
            on = partial + rest * (1 + 1e-9) + 1e-9 * x_norms[-1] * self.norms[alive, -1] + 1e-6 >= floor
            alive, partial = alive[on], partial[on]
            covered = self.first[alive] >= g
            if covered.any():
                kept.append(alive[covered])
                alive, partial = alive[~covered], partial[~covered]
        return np.concatenate([*kept, alive]) if kept else alive


def prefix_norms(m: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, 2, ... groups of dimensions, one row per vector."""
    n, dim = m.shape
    groups = max(1, -(-dim // CHUNK))
    squares = np.zeros((n, groups * CHUNK))
    squares[:, :dim] = m * m
    sums = squares.reshape(n, groups, CHUNK).sum(axis=2)
    return np.sqrt(np.concatenate([np.zeros((n, 1)), np.cumsum(sums, axis=1)], axis=1))


class Search:
    """What every task needs: the size of vectors, the order of dimensions and the sampled rows."""

    def __init__(self, vectors: DataFrame, dim: int, scale: int):
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        self.dim, self.scale = dim, scale
        self.ids = sample.column("id").to_numpy()
        self.labels = sample.column("label").to_numpy()
        self.y = whole_numbers(sample.column("v").combine_chunks(), dim, scale)
        self.order = np.argsort((self.y * self.y).sum(axis=0), kind="stable")


_BLOCK = "ids binary, labels binary, ints binary"
_HITS = "anchor_id long, no int, vec_id long, score long"
_HIT_SCHEMA = pa.schema([("anchor_id", pa.int64()), ("no", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def blocks(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """Rows packed as they lie: at most `BLOCK` in one row of the result."""
    schema = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("ints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            cols = [part.column("id").to_numpy().tobytes(), part.column("label").to_numpy().tobytes(),
                    whole_numbers(part.column("v").combine_chunks(), dim, scale).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], schema=schema)

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(BLOCK - n, b.num_rows - at)
                held.append(b.slice(at, take))
                n, at = n + take, at + take
                if n == BLOCK:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return vectors.mapInArrow(run, _BLOCK)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score s with low * score <= 100 * s <= high * score, inside 64 bits."""
    return max(_LEAST, -(-low * score // 100)), min(_MOST, high * score // 100)


_GROUP = "ids binary, labels binary, ints binary, at binary, no binary, floor binary, ceil binary"
_GROUP_SCHEMA = pa.schema([(c.split()[0], pa.binary()) for c in _GROUP.split(", ")])


def anchor_groups(asking: DataFrame, search: Search, floors, parts: int) -> DataFrame:
    """Anchors packed in groups, each with its windows: (place of the anchor, number, threshold, upper end).

    `asking` has (id, label, v, windows); `floors(id, label, scores of the sample, windows)` gives (number, threshold, upper end).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                b = batch.slice(start, GROUP)
                ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
                x = whole_numbers(b.column("v"), search.dim, search.scale)
                wins = b.column("windows").to_pylist()
                at, no, floor, ceil = [], [], [], []
                for i in range(len(ids)):
                    for number, low, high in floors(ids[i], labels[i], exact_scores(x[i], search.y), wins[i]):
                        at.append(i), no.append(number), floor.append(low), ceil.append(high)
                cols = [ids, labels, x, np.array(at, np.int64), np.array(no, np.int64),
                        np.array(floor, np.int64), np.array(ceil, np.int64)]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], schema=_GROUP_SCHEMA)

    # By label, so that few labels meet in a group; ids spread a hot label over groups.
    ordered = asking.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id")
    return ordered.mapInArrow(run, _GROUP)


def threshold_join(cand: DataFrame, groups: DataFrame, search: Search, same_label: bool, k: int, label: str) -> DataFrame:
    """(anchor_id, no, vec_id, score): per window at least the k best rows that reach its threshold."""
    numbered = written(groups.withColumn("g", F.monotonically_increasing_id()), label)
    nth = numbered.select("g", (F.row_number().over(Window.orderBy("g")) - 1).alias("n"))
    placed = written(numbered.join(nth, "g").drop("g"), label)
    total = placed.count()
    dim, order = search.dim, search.order

    def cell(row: dict) -> Iterator[tuple]:
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        y = np.frombuffer(row["ints"]).reshape(len(ids), dim)
        a_ids, a_labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
        x = np.frombuffer(row["a_ints"]).reshape(len(a_ids), dim)
        at, no, floor, ceil = (np.frombuffer(row[c], np.int64) for c in ("at", "no", "floor", "ceil"))
        if same_label:
            of_labels = np.isin(labels, a_labels)
            ids, labels, y = ids[of_labels], labels[of_labels], y[of_labels]
        turned, norms = x[:, order], prefix_norms(x[:, order])
        index = Index(y, order, norms[np.unique(at)].max(axis=0), float(floor.min()))
        listed_labels, listed_ids = labels[index.listed], ids[index.listed]
        for i in np.unique(at):
            mine = np.flatnonzero(at == i)
            allowed = ((listed_labels == a_labels[i]) == same_label) & (listed_ids != a_ids[i])
            found = index.candidates(turned[i], norms[i], float(floor[mine].min()), allowed)
            if not len(found):
                continue
            scores = exact_scores(x[i], y[found])
            for w in mine:
                inside = np.flatnonzero((scores >= floor[w]) & (scores <= ceil[w]))
                top = inside[best(ids[found[inside]], scores[inside], k)]
                yield a_ids[i], no[w], ids[found[top]], scores[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                hits = list(cell(batch.slice(j, 1).to_pylist()[0]))
                sizes = [len(h[2]) for h in hits]
                if sum(sizes):
                    cols = [np.repeat([h[0] for h in hits], sizes), np.repeat([h[1] for h in hits], sizes),
                            np.concatenate([h[2] for h in hits]), np.concatenate([h[3] for h in hits])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(cols, _HIT_SCHEMA)], schema=_HIT_SCHEMA
                    )

    side = placed.select("n", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "ints")], "at", "no", "floor", "ceil")
    cells = cand.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(total - 1)) if total else F.array().cast("array<int>")))
    # A few cells a batch: each holds a block and a group.
    found = cells.join(side, "n").drop("n").mapInArrow(run, _HITS)
    order_by = Window.partitionBy("anchor_id", "no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= k)


def mined(rows: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
          high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` picks."""
    everything = labelled_vectors(rows, id_col, vec_col, label)
    dim = max(1, everything.agg(F.max(F.size("v"))).first()[0] or 0)
    search = Search(everything, dim, scale)
    cand = written(blocks(everything, dim, scale), "vector-blocks")
    asked = labelled_vectors(rows.where(anchor), id_col, vec_col, label)
    anchors = written(
        asked.groupBy("id").agg(F.min(F.struct("v", "label")).alias("one")).select("id", "one.label", "one.v"), "anchors"
    )

    parts_of = -(-anchors.count() // GROUP) or 1

    def positive_floor(ident, its_label, scores, _):
        near = scores[(search.labels == its_label) & (search.ids != ident)]
        yield 0, (int(np.partition(near, len(near) - positives)[len(near) - positives]) if len(near) >= positives else _LEAST), _MOST

    none = F.array().cast("array<struct<no: int, score: long>>").alias("windows")
    close = threshold_join(
        cand, anchor_groups(anchors.select("*", none), search, positive_floor, parts_of), search, True, positives, "asking"
    )
    chosen = written(
        close.select("anchor_id", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"),
                     F.col("score").alias("positive_score")), "positives",
    )

    def negative_floor(step: float, first: bool):
        def floors(ident, its_label, scores, windows):
            other = scores[(search.labels != its_label) & (search.ids != ident)]
            for w in windows:
                least, most = window(w["score"], low, high)
                if least > most:
                    continue
                start = most - int((most - least) * (1 - step))
                if first:
                    inside = other[(other >= least) & (other <= most)]
                    if len(inside) >= negatives:
                        start = int(np.partition(inside, len(inside) - negatives)[len(inside) - negatives])
                yield w["no"], max(least, start), most
        return floors

    left, parts = chosen, []
    for turn, step in enumerate(STEPS):
        windows = left.groupBy(F.col("anchor_id").alias("id")).agg(
            F.collect_list(F.struct("no", F.col("positive_score").alias("score"))).alias("windows")
        )
        groups = anchor_groups(anchors.join(windows, "id"), search, negative_floor(step, turn == 0), parts_of)
        hits = written(threshold_join(cand, groups, search, False, negatives, f"windows-{turn}"), f"negatives-{turn}")
        if turn == len(STEPS) - 1:
            parts.append(hits)
            break
        full = hits.where(F.col("rank") == negatives).select("anchor_id", "no")
        parts.append(hits.join(full, ["anchor_id", "no"], "left_semi"))
        left = written(left.join(full, ["anchor_id", "no"], "left_anti"), f"open-{turn}")
        if left.isEmpty():
            break
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.join(chosen, ["anchor_id", "no"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def mined_sql() -> str:
    """DuckDB SQL for the query over `embeddings`: anchors divisible by 50, labels of ids divisible by 7 moved on by one."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS no FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, no ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND no <= 5
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
