"""Token files with canonical length-limited Huffman codes.

File format (a Parquet folder of binary columns, so any Hadoop file system and Spark's commit protocol do):

* `lengths`: one row, `code_lengths`: a byte per token id, 0 for ids that do not occur.  Codes are canonical:
  by length, then id, most significant bit first, at most `MAX_BITS` long.
* `blocks`: one row per block of about `BLOCK` ids: `part` and `block` (order), `doc_ids`, `doc_sizes` (int64 arrays as
  bytes), `n_ids`, `payload` (the bits) and `checkpoints` (uint32 bit offset of every `STEP`-th id).

Blocks are independent of each other.  A decoder reads `MAX_BITS` bits at a time and looks code and length up in one table;
all stretches between checkpoints of many blocks advance together as arrays.  Lengths come from the global counts by
package-merge, so the codes are the best of that limit.

Documents are written in ascending doc_id (NULL last; ties by a digest of their ids), in files that Spark ranges by doc_id.  A
document may go over several blocks.  Nulls count as empty texts; each document ends with the end id.  Repeated rows are written
as often as they occur.  An empty table gives empty files.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, written

MAX_BITS, BLOCK, STEP = 20, 1 << 15, 128
END = 2


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Package-merge: best code lengths of at most `limit` bits; 0 for counts of 0.

    A package is kept as a place in its level's merged list: going down from the top, the first `m` items of a
    level use so many single ids, and twice the number of packages from the level below.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, items = [], weights
    for _ in range(limit - 1):
        packages = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weights))
        items = merged[rank]
    take, lengths = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for single in reversed(levels):
        singles = int(single[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: consecutive numbers by (length, id), shifted where the length grows."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.searchsorted(lengths[order], 1):].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every window of `MAX_BITS` bits."""
    codes = canonical_codes(lengths)
    ids, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    for i in np.flatnonzero(lengths).tolist():
        spare = MAX_BITS - int(lengths[i])
        start = int(codes[i]) << spare
        ids[start:start + (1 << spare)] = i
        sizes[start:start + (1 << spare)] = lengths[i]
    return ids, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of one block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    buffer = np.zeros(total // 32 + 2, np.uint64)
    # A code lies in one 32-bit word or two; its two parts are added, as bits of different codes never meet.
    word, shift = starts >> 5, 64 - (starts & 31) - size
    both = codes[ids] << shift.astype(np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        buffer[word[first]] += np.add.reduceat(both >> np.uint64(32), first)
        buffer[word[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    payload = buffer.astype(">u4").tobytes()[:(total + 7) // 8]
    return payload, starts[::STEP].astype("<u4").tobytes()


def unpack(blocks: list[tuple[int, bytes, bytes]], table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Ids of several (n_ids, payload, checkpoints) blocks, all stretches decoded side by side."""
    symbols, sizes = table
    data, base, at, left, lane = [], 0, [], [], []
    for n, payload, checkpoints in blocks:
        marks = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        at.append(marks + 8 * base)
        left.append(np.minimum(STEP, n - STEP * np.arange(len(marks))))
        lane.append(len(marks))
        data.append(payload)
        base += len(payload)
    flat = np.frombuffer(b"".join(data) + bytes(8), np.uint8).astype(np.uint32)
    pos, todo = np.concatenate(at or [np.empty(0, np.int64)]), np.concatenate(left or [np.empty(0, np.int64)])
    out = np.zeros((len(pos), STEP), np.uint32)
    for step in range(int(todo.max(initial=0))):
        live = np.flatnonzero(todo > step)
        p = pos[live]
        b = p >> 3
        window = (flat[b] << 24) | (flat[b + 1] << 16) | (flat[b + 2] << 8) | flat[b + 3]
        key = (window >> (32 - MAX_BITS - (p & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
        out[live, step] = symbols[key]
        pos[live] = p + sizes[key]
    found, row = [], 0
    for (n, _, _), k in zip(blocks, lane):
        found.append(out[row:row + k].ravel()[:n])
        row += k
    return found


def encoded(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, width: int = 4) -> DataFrame:
    """(doc_id, ids, counts): each text's ids as little-endian integers of `width` bytes, the end id behind; one pass, no shuffle.

    Behind the documents of a partition stands one row with `counts`, how often each id occurs in it (int64 by id), and
    without ids.  A vocabulary with ids too large for `width` is an error.
    """
    from .lib_words import library_codec

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(file)
        if max(len(codec.pieces) - 1, end) >= 1 << 8 * width:
            raise ValueError(f"{len(codec.pieces)} ids need more than {width} bytes")
        kind = f"<u{width}"
        total = np.zeros(max(len(codec.pieces), end + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found, ends = codec.encode_all(part.column(1).to_pylist())
                flat = np.insert(found.astype(kind), ends, end)
                total += np.bincount(flat, minlength=len(total))
                data, cuts = flat.tobytes(), (width * (ends + np.arange(1, len(ends) + 1))).tolist()
                ids = pa.array([data[a:b] for a, b in zip([0, *cuts], cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.nulls(len(ids), pa.binary())], schema=schema)
        # The worker may go on to other stages, where what it remembers is of no use.
        codec.keep()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, counts binary")


def global_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs: the partitions' counts, summed by Spark; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                total = np.frombuffer(data, np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counted = rows.where("counts IS NOT NULL").select("counts")
    sums = counted.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at = sums.column("id").to_numpy()
    out = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    out[at] = sums.column("n").to_numpy()
    return out


def write_tokens(rows: DataFrame, folder: str, width: int = 4) -> None:
    """Write the rows of `encoded`, ids of `width` bytes each, as token files."""
    spark = rows.sparkSession
    lengths = code_lengths(global_counts(rows))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "code_lengths binary").write.parquet(f"{folder}/lengths")
    schema = pa.schema([
        ("block", pa.int64()), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("doc_sizes", pa.binary()), ("n_ids", pa.int64()),
        ("payload", pa.binary()), ("checkpoints", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, nulls, sizes, ids, held = 0, [], [], [], [], 0

        def block():
            payload, checkpoints = pack(np.concatenate(ids), codes, lengths)
            cols = [number, np.array(docs, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), np.array(sizes, "<i8").tobytes(), held, payload, checkpoints]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, schema)], schema=schema)

        for part in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            for doc, data in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                rest = np.frombuffer(data, f"<u{width}")
                while len(rest):
                    piece, rest = rest[:BLOCK - held], rest[BLOCK - held:]
                    docs.append(doc or 0)
                    nulls.append(doc is None)
                    # The sign tells whether the document ends in this block.
                    sizes.append(len(piece) if not len(rest) else -len(piece))
                    ids.append(piece)
                    held += len(piece)
                    if held == BLOCK:
                        yield block()
                        number, docs, nulls, sizes, ids, held = number + 1, [], [], [], [], 0
        if held:
            yield block()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ties by a digest of the ids: the sort, and the sample it ranges by, hold no whole documents as keys.
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    tied = rows.where("counts IS NULL").select("doc_id", "ids", F.md5("ids").alias("tie"))
    ranged = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    blocks = ranged.mapInArrow(
        run, "block long, doc_ids binary, doc_nulls binary, doc_sizes binary, n_ids long, payload binary, checkpoints binary"
    ).withColumn("part", F.spark_partition_id())
    blocks.write.parquet(f"{folder}/blocks")


_PIECE = [("doc_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("nth", pa.int32()), ("ends", pa.bool_())]


def read_tokens(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """(doc_id, part, block, nth, ends, ids): the pieces of all documents, decoded from the files.

    With `digests`, `crc` and `n` (crc32 and number of a piece's ids) stand in place of the ids, which then leave no worker.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/lengths").first()["code_lengths"], np.uint8)
    shown = [("crc", pa.int64()), ("n", pa.int64())] if digests else [("ids", pa.binary())]
    schema = pa.schema([*_PIECE, *shown])

    def piece(ids: np.ndarray) -> tuple:
        return (zlib.crc32(ids), len(ids)) if digests else (ids.tobytes(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                rows = batch.slice(start, 32).to_pylist()
                decoded = unpack([(r["n_ids"], r["payload"], r["checkpoints"]) for r in rows], table)
                cols: list[list] = [[] for _ in schema]
                for r, ids in zip(rows, decoded):
                    sizes = np.frombuffer(r["doc_sizes"], "<i8")
                    ids, cut = np.ascontiguousarray(ids, "<u4"), np.cumsum(np.abs(sizes))
                    docs, nulls = np.frombuffer(r["doc_ids"], "<i8").tolist(), np.frombuffer(r["doc_nulls"], np.uint8).tolist()
                    for k, (doc, null, size, end) in enumerate(zip(docs, nulls, sizes.tolist(), cut.tolist())):
                        values = (None if null else doc, r["part"], r["block"], k, size > 0, *piece(ids[end - abs(size):end]))
                        for col, v in zip(cols, values):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    kinds = "crc long, n long" if digests else "ids binary"
    blocks = spark.read.parquet(f"{folder}/blocks")
    return blocks.mapInArrow(run, f"doc_id long, part int, block long, nth int, ends boolean, {kinds}")


def _applied(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if v & 1:
            out ^= row
        v >>= 1
    return out


@functools.cache
def _zero_bits(power: int) -> list[int]:
    """What appending 2 ** power zero bits does to a crc32, by its bits."""
    if not power:
        return [0xEDB88320, *(1 << i for i in range(31))]
    half = _zero_bits(power - 1)
    return [_applied(half, x) for x in half]


def _crc_joined(a: int, b: int, size: int) -> int:
    """crc32 of two stretches from theirs; `size` bytes are in the second."""
    bits = 8 * size
    for power in range(bits.bit_length()):
        if bits >> power & 1:
            a = _applied(_zero_bits(power), a)
    return a ^ b


def catalogue(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the digests of decoded pieces.

    Offsets of the parts are running sums over one row per part; inside a part, over its own pieces.
    """

    narrow = written(pieces, "pieces")
    per_part = narrow.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("part").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumns({
        "_before": F.coalesce(F.sum("n").over(inside), F.lit(0)),
        "_doc": F.coalesce(F.sum(F.col("ends").cast("long")).over(inside), F.lit(0)),
    }).join(offsets, F.col("part") == F.col("_part"))
    whole = placed.groupBy("part", "_doc").agg(
        F.first("doc_id").alias("doc_id"), (F.min("_before") + F.first("_offset")).alias("start"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("block", "crc", "n"))).alias("parts"),
    )
    joined = F.udf(lambda parts: _fold(parts), "long")
    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]).otherwise(joined(F.when(F.size("parts") > 1, F.col("parts"))))
    return whole.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))


def _fold(parts) -> int | None:
    if not parts:
        return None
    crc = parts[0]["crc"]
    for p in parts[1:]:
        crc = _crc_joined(crc, p["crc"], 4 * p["n"])
    return crc


def tokens_written_and_read(docs: DataFrame, file: str, width: int = 4) -> DataFrame:
    """Encode, write the token files below the shared folder, read them back: one row per document.

    `width` is the number of bytes of an id between encoding and packing, where every id crosses a shuffle.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(written(encoded(docs, file, width=width), "ids"), folder, width)
    return catalogue(read_tokens(spark, folder, digests=True))
