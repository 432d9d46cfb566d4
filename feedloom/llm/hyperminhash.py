"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct k-word shingles (A-Z lower-cased), as 64-bit hashes.  The hash range is cut
into `BUCKETS` buckets; of the least hash in each the register keeps the number of leading zeros and ten mantissa
bits, sixteen bits in all.  Bands of `ROWS` registers give the candidates: two sets with a Jaccard of 0.8 share none of
the 40 bands with a chance of about one in ten million.  Registers of empty buckets are filled for banding from
other buckets in an order fixed per bucket, so short texts are found as well.  Before candidates are verified,
their Jaccard is estimated from the registers, corrected for chance collisions of registers; those more than six
standard deviations below the threshold are left out.  All others are confirmed on the full sets.

Large groups.  Documents with one and the same set are one node.  In each band bucket every member meets one hub
only, the member that shares most buckets, and of its hubs a node is confirmed with the likeliest ones: a group of
near copies costs work in proportion to its size.  Nodes that hub pairs join, confirmed or not, form a cluster; every
two nodes that share a bucket are in one.  Where a cluster still holds several components, its members outside the
largest one are compared with all members, in cells of bounded size that work on arrays and give out only links they
have confirmed.  So no link between different sets that share a band is lost, no task gathers a whole group, and
no pairs are listed.

Nulls: a NULL or blank text has no shingles and is linked with nothing; rows with a NULL doc_id are grouped like others but
are no group's smallest doc_id.  Repeated rows belong to one node.  Very long texts are whole.  An empty table gives
an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import split_join
from ..session import written
from .common import Memo, carry, chained, if_small, mixed, per_batch, text_hash, words
from .components import connected

BUCKETS, ROWS = 200, 5
BANDS = BUCKETS // ROWS
MANTISSA = 10
EMPTY = 0xFFFF
#: Shingles in one side of a comparison cell, about.
CELL = 40_000
#: Hubs that a node is confirmed with before its cluster is looked at.
HUBS = 2
_probes = np.argsort(
    mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, BUCKETS), axis=1
)
_word_hash = Memo(xxhash.xxh3_64_intdigest)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; of a shorter text, its whole sequence is the one shingle."""
    found = words((text or b"").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((_word_hash[w] for w in found), np.uint64, len(found))
    n = min(k, len(h))
    return np.unique(chained([h[i:len(h) - n + 1 + i] for i in range(n)]))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Sixteen-bit registers: leading zeros and mantissa bits of the least hash per bucket."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if not len(hashes):
        return out
    # Hashes are sorted, so buckets, cut from the top bits, are runs.
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = np.minimum.reduceat(mixed(hashes) >> np.uint64(12), starts)
    part, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least > 0, 52 - exponent, 52)
    mantissa = np.where(least > 0, (part * 2 - 1) * (1 << MANTISSA), 0)
    out[bucket[starts].astype(np.int64)] = (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band from filled-up registers; `regs` is one row or a matrix of rows."""
    rows = np.atleast_2d(regs).copy()
    for r in rows:
        full = r != EMPTY
        if not full.all() and full.any():
            gaps = np.flatnonzero(~full)
            order = _probes[gaps]
            r[gaps] = r[order[np.arange(len(gaps)), full[order].argmax(axis=1)]]
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    tag = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).ravel()
    keys = chained([tag, *(parts[:, :, i].ravel() for i in range(ROWS))])
    return keys.reshape(parts.shape[:2]).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, n: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard of register row `a` (set size n) with rows `b` (sizes m), and its standard deviation at 0.8.

    Buckets empty on both sides tell nothing.  Registers of different least hashes agree by chance with a
    probability of about 0.1699 * 2**-MANTISSA * 4q / (1 + q)**2, q the ratio of the sizes.
    """
    same = ((b == a) & (a != EMPTY)).sum(axis=1)
    seen = ((b != EMPTY) | (a != EMPTY)).sum(axis=1)
    q = n / np.maximum(m, 1)
    chance = seen * 0.169919487 * 2.0 ** -MANTISSA * 4 * q / (1 + q) ** 2
    return (same - chance) / np.maximum(seen - chance, 1e-9), np.sqrt(0.8 * 0.2 / np.maximum(seen, 1))


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact, in whole numbers: 100 * |x & y| >= percent * |x | y|."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, digest, n, regs): one narrow row per document; regs are its registers."""

    def run(cols):
        out: dict[str, list] = {"doc_id": cols["doc_id"], "th": cols["th"], "digest": [], "n": [], "regs": []}
        for text in cols["text"]:
            s = shingles(text, k)
            out["n"].append(len(s))
            out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["regs"].append(registers(s).tobytes() if len(s) else None)
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("regs", pa.binary())])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(per_batch(run, schema), "doc_id long, th long, digest binary, n long, regs binary")


def row_order():
    """Rows by doc_id, NULL last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, digest, n, regs, first): one node per different set; `first` is its first row."""
    return rows.where("n > 0").groupBy("digest").agg(
        F.min(row_order()).alias("first"), F.first("n").alias("n"), F.first("regs").alias("regs")
    ).withColumn("node", F.monotonically_increasing_id())


def memberships(nodes: DataFrame) -> DataFrame:
    """(bucket, node): the band buckets of each node."""

    def run(cols):
        keys = bands(np.stack([np.frombuffer(r, np.uint16) for r in cols["regs"]]))
        return {"bucket": keys.ravel().tolist(), "node": np.repeat(np.array(cols["node"], np.int64), BANDS).tolist()}

    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])
    return nodes.select("node", "regs").mapInArrow(per_batch(run, schema), "bucket long, node long")


def shared_buckets(members: DataFrame) -> DataFrame:
    """Memberships in buckets of two nodes or more, with the bucket's size."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return split_join(members, sizes, ["bucket"])


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(node, hub): every member of a bucket with the bucket's hub, each pair once."""
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = shared.select("bucket", "node").join(degree, "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("hub"))
    pairs = split_join(shared.select("bucket", "node"), hubs.select("bucket", F.col("hub.node").alias("hub")), ["bucket"])
    return pairs.where("node <> hub").select("node", "hub").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of the nodes given, recomputed from the first row of each."""

    def run(cols):
        return {"node": cols["node"], "set": [shingles(t, k).tobytes() for t in cols["text"]]}

    firsts = nodes.select("node", F.col("first.id").alias("_id"), F.col("first.th").alias("_th"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), text_hash(F.col("text")).alias("_t"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(if_small(written(firsts, "firsts")), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th"))).select("node", "text")
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])
    return rows.mapInArrow(per_batch(run, schema), "node long, set binary")


def _likely(est: np.ndarray, sd: np.ndarray, percent: int) -> np.ndarray:
    return est >= percent / 100 - 6 * sd


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, hub): of each node the pairs with the best estimates, `HUBS` at most, that may be similar enough."""

    def guess(cols):
        out: dict[str, list] = {"node": [], "hub": [], "est": []}
        for x, y, n, m, a, b in zip(cols["rnode"], cols["rhub"], cols["nnode"], cols["nhub"], cols["node"], cols["hub"]):
            est, sd = estimates(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)[None], n, np.array([m]))
            if _likely(est, sd, percent)[0]:
                out["node"].append(a)
                out["hub"].append(b)
                out["est"].append(float(est[0]))
        return out

    schema = pa.schema([("node", pa.int64()), ("hub", pa.int64()), ("est", pa.float64())])
    regs = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    rows = pairs.join(regs("node"), "node").join(regs("hub"), "hub").select("node", "hub", "nnode", "nhub", "rnode", "rhub")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.col("est").desc(), "hub"))
    guessed = rows.mapInArrow(per_batch(guess, schema), "node long, hub long, est double")
    return guessed.withColumn("_nth", nth).where(F.col("_nth") <= HUBS).select("node", "hub")


def confirmed_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose full sets are similar enough."""

    def check(cols):
        keep = [
            jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
            for x, y in zip(cols["sa"], cols["sb"])
        ]
        return {c: [v for v, ok in zip(cols[c], keep) if ok] for c in ("a", "b")}

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    full = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))
    named = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    return named.join(full("a"), "a").join(full("b"), "b").select("a", "b", "sa", "sb").mapInArrow(
        per_batch(check, schema), "a long, b long"
    )


def open_members(clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the clusters that hold several components: (cluster, node, root, outside).

    `outside` marks members that do not belong to the cluster's largest component.
    """
    known = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    rooted = clusters.join(known, clusters["node"] == F.col("_n"), "left").select(
        F.col("clusters_root").alias("cluster"), "node", F.coalesce("_r", "node").alias("root")
    )
    per_root = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    several = per_root.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("main")
    ).where("roots > 1").select(F.col("cluster").alias("_b"), F.col("main.root").alias("_main"))
    return rooted.join(several, rooted["cluster"] == F.col("_b")).select(
        "cluster", "node", "root", (F.col("root") != F.col("_main")).alias("outside")
    )


def cell_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between outside members and all members of their clusters, by comparison cells.

    A cluster's members, and its outside members, are cut into parts of about `CELL` shingles; a cell is one part
    of each.  Cells are laid out on narrow rows; sets join them once.  Of each outside member, a cell gives
    out at most one link to each other component.
    """
    sized = members.join(nodes.select("node", "n"), "node")
    loads = sized.groupBy("cluster").agg(
        F.ceil(F.sum("n") / CELL).alias("parts"),
        F.ceil(F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)) / CELL).alias("outer"),
    )
    rows = sized.join(loads, "cluster")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    inner = rows.select("cluster", "node", "root", F.lit(False).alias("outside"), part("parts").alias("j"), upto("outer").alias("i"))
    outer = rows.where("outside").select("cluster", "node", "root", "outside", part("outer").alias("i"), upto("parts").alias("j"))
    placed = inner.unionByName(outer).join(nodes.select("node", "n", "regs"), "node").join(sets, "node")
    cells = placed.groupBy("cluster", "i", "j").agg(
        F.collect_list(F.struct("outside", "node", "root", "n", "regs", "set")).alias("members")
    ).select("members")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(cell: list[dict]) -> Iterator[tuple[int, int]]:
        outside = [m for m in cell if m["outside"]]
        everyone = [m for m in cell if not m["outside"]]
        if not outside or not everyone:
            return
        regs = np.stack([np.frombuffer(m["regs"], np.uint16) for m in everyone])
        root = np.array([m["root"] for m in everyone], np.int64)
        n = np.array([m["n"] for m in everyone], np.int64)
        for x in outside:
            est, sd = estimates(np.frombuffer(x["regs"], np.uint16), regs, x["n"], n)
            ok = (root != x["root"]) & _likely(est, sd, percent)
            ok &= 100 * np.minimum(n, x["n"]) >= percent * np.maximum(n, x["n"])
            at = np.flatnonzero(ok)
            mine, done = np.frombuffer(x["set"], np.uint64), set()
            for i in at[np.argsort(-est[at])]:
                if root[i] not in done and jaccard_at_least(mine, np.frombuffer(everyone[i]["set"], np.uint64), percent):
                    done.add(root[i])
                    yield x["node"], everyone[i]["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                links = list(compare(batch.column(0).slice(r, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in links], pa.int64()) for i in range(2)], schema=schema
                )

    return cells.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), n_shingles, component_id, kept, first.

    `kept` is doc_id = component_id (the smallest doc_id of the group); `first` marks the group's first row, and each row without
    shingles: what a filter keeps, up to repeated rows.
    """
    rows = written(signatures(docs, k), "signatures")
    nodes = written(nodes_of(rows), "nodes")
    shared = written(shared_buckets(memberships(nodes)), "buckets")
    in_use = nodes.join(shared.select("node").distinct(), "node", "left_semi")
    sets = written(full_sets(docs, in_use, k), "sets")
    pairs = written(hub_pairs(shared), "pairs")
    links = written(confirmed_pairs(likely_pairs(pairs, nodes, percent), sets, percent), "links")
    roots = connected(links)
    clusters = connected(pairs, "node", "hub").withColumnRenamed("root", "clusters_root")
    rest = written(open_members(clusters, roots), "open")
    more = written(cell_links(rest, nodes, sets, percent), "links")
    if more.limit(1).count():
        roots = connected(links.unionByName(more))
    known = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    placed = nodes.join(known, nodes["node"] == F.col("_n"), "left").select(
        "digest", "first", F.coalesce("_r", "node").alias("root")
    )
    firsts = placed.groupBy("root").agg(F.min("first").alias("top"))
    classes = split_join(placed, firsts, ["root"]).select("digest", "top")
    found = rows.select("doc_id", "th", "digest", "n").join(classes, "digest", "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("top.id"))
    return found.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("top.id")) & (F.col("th") == F.col("top.th")))).alias("first"),
    )


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each group, with their own columns only.

    Documents without words all stay, except that repeated rows (equal in doc_id and text) stay once.
    """
    rows = written(near_duplicates(docs, k, percent).select("doc_id", "th", "first"), "verdicts")
    copies = rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"), F.bool_and("first").alias("first"))
    marked = written(copies.where("n > 1 or not first"), "marked").withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th"))
    hashed = carry(docs, "doc_id", "text").withColumn("_t", text_hash(F.col("text")))
    single = hashed.join(if_small(marked), same, "left_anti").select("_row.*")
    again = marked.where("first")
    if not again.limit(1).count():
        return single
    nth = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_row"))
    repeated = hashed.join(if_small(again), same).withColumn("_nth", nth).where("_nth = 1")
    return single.unionByName(repeated.select("_row.*"))
