"""URL filter with a sorted digest array.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's path; the
longest rule wins.  Spark sorts the rules by the 64-bit xxhash of their text; the array file holds the sorted
keys, then offsets, then the stored texts.  It is written once to the shared folder and handed to every
executor, whose workers map it into memory (the workers of an executor share the pages).  A batch of urls is
turned into candidate texts - every suffix of the host, then the path lengths that the array knows for a matching host -
which are hashed, found by one vectorised binary search, and compared with the stored texts, so a collision of hashes is
never a match.

The file's size is the rules' size, not the pages'.  Rule sets above `max_bytes` are joined instead, by an
equi-join on host suffix, with the same result.

Nulls: a url that is NULL or has no :// has an empty host and path and fits no rule.  Rules with a NULL host are left out; a
NULL path is empty.  Repeated rules count once; where one rule has both verdicts, block wins.  An empty rule table or page table
is fine.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import Memo

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_BYTES = 64 << 20
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def entries(rules: DataFrame) -> DataFrame:
    """(key, text): sorted records.  `r` + host, SOH, path, NUL, verdict; `h` + host, NUL, lengths of its rules' paths.

    The mark between host and path keeps rules apart whose texts are equal when written together.
    """
    clean = rules.where("host is not null").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    digest = F.udf(lambda s: xxhash.xxh64_intdigest(s.encode()) - (1 << 63), "long")
    rule = clean.select(F.concat(F.lit("r"), "host", F.lit("\x01"), "path").alias("name"), F.col("verdict").alias("value"))
    lengths = clean.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set(F.length("path").cast("string"))), ",").alias("value"))
    host = lengths.select(F.concat(F.lit("h"), "host").alias("name"), "value")
    # Keys are shifted to signed numbers of the same order, so Spark's sort is the array's.
    return rule.unionByName(host).select(digest("name").alias("key"), F.concat("name", F.lit("\0"), "value").alias("text"))


def write_array(spark: SparkSession, sorted_entries: DataFrame, path: str) -> str:
    """Write the array file through Spark's file system layer; returns its path.

    The driver holds the entries as three flat arrays, about the file's size, never as objects.
    """
    keys, sizes, texts = array("q"), array("q", [0]), bytearray()
    for r in sorted_entries.toLocalIterator():
        text = r["text"].encode()
        keys.append(r["key"])
        sizes.append(len(text))
        texts += text
    shifted = np.frombuffer(keys, np.uint64) ^ np.uint64(1 << 63) if keys else np.empty(0, np.uint64)
    offsets = np.cumsum(np.frombuffer(sizes, np.int64)).astype(np.uint64, copy=False)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for data in (np.array([len(keys)], np.uint64), shifted, offsets, texts):
            data = memoryview(data).cast("B") if len(data) else b""
            for i in range(0, len(data), 1 << 20):
                out.write(bytearray(data[i:i + (1 << 20)]))
    finally:
        out.close()
    return path


class DigestArray:
    """The mapped file: vectorised lookup of texts, confirmed against the stored ones."""

    def __init__(self, file: str):
        n = int(np.fromfile(file, np.uint64, 1)[0])
        self.keys = np.memmap(file, np.uint64, "r", 8, (n,)) if n else np.empty(0, np.uint64)
        self.offsets = np.memmap(file, np.uint64, "r", 8 + 8 * n, (n + 1,))
        self.blob = np.memmap(file, np.uint8, "r") if n else np.empty(0, np.uint8)
        self.base = 8 + 8 * n + 8 * (n + 1)

    def stored(self, i: int) -> bytes:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return self.blob[self.base + a:self.base + b].tobytes()

    def find(self, names: list[bytes]) -> list[bytes | None]:
        """The value stored under each name, or None."""
        out: list[bytes | None] = [None] * len(names)
        if not names or not len(self.keys):
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        at = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for i in hits.tolist():
            j, want = int(at[i]), names[i] + b"\0"
            while j < len(self.keys) and self.keys[j] == digests[i]:
                text = self.stored(j)
                if text.startswith(want):
                    out[i] = text[len(want):]
                    break
                j += 1
        return out


def suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def judge(array: DigestArray, hosts: list[str], paths: list[str]) -> Iterator[tuple[str | None, str | None]]:
    """(rule, verdict) of each url."""
    tails = sorted({s for h in set(hosts) for s in suffixes(h)})
    known = {t: [int(x) for x in v.split(b",")] for t, v in zip(tails, array.find([b"h" + t.encode() for t in tails])) if v is not None}
    candidates = Memo(lambda key: [
        (tail, key[1][:n]) for tail in suffixes(key[0]) for n in known.get(tail, ()) if n <= len(key[1])
    ])
    names = sorted({c for key in zip(hosts, paths) for c in candidates[key]})
    value = dict(zip(names, array.find([b"r" + "\x01".join(c).encode() for c in names])))
    for key in zip(hosts, paths):
        fits = [c for c in candidates[key] if value[c] is not None]
        best = min(fits, key=lambda c: (-len(c[0]) - len(c[1]), c[0] + c[1], c[0]), default=None)
        yield (None, None) if best is None else (best[0] + best[1], value[best].decode())


@functools.cache
def _mapped(file: str) -> DigestArray:
    return DigestArray(file)


def judged_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; `rules` is (host, path, verdict)."""
    spark = pages.sparkSession
    sorted_entries = entries(rules).sort("key", "text")
    size = sorted_entries.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if size > max_bytes:
        return _joined(rows, rules, default)
    name = f"digests-{uuid.uuid4().hex}.bin"
    folder = scratch_path(spark, "url-array")
    spark.sparkContext.addFile(write_array(spark, sorted_entries, f"{folder}/{name}"))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _mapped(os.path.abspath(SparkFiles.get(name)))
        for batch in batches:
            found = list(judge(array, batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("page_id", "host", "path")),
                pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string()),
            ], schema=schema)

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule sets too large to hand out: distinct hosts meet the rules by suffix."""
    clean = rules.where("host is not null").select(
        F.translate("host", UPPER, LOWER).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), "verdict"
    ).groupBy("_host", "_path").agg(F.max("verdict").alias("verdict"))
    urls = rows.select("host", "path").distinct()
    parts = F.split("host", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = urls.withColumn("_host", F.explode(tails)).join(clean, "_host").where(F.startswith("path", F.col("_path")))
    rule = F.concat("_host", "_path")
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), "_host", "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def urls_sql(rules: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL for the same over `pages`."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    split = SPLIT.replace("'", "''")
    return f"""
WITH r(h, p, v) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '{split}', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '{split}', 2), '') AS path FROM pages),
m AS (SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, h || p) AS nth
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE nth = 1) m USING (rid)
"""
