"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after . ! ? (and closing quotes or brackets) before white space, and at line ends.  A run
of at least `SENTENCES` consecutive sentences that has at least `MIN_WORDS` words fits (a single sentence of
`LONG_SENTENCE` words or more fits by itself).  Every run that fits and is not its first occurrence (by doc_id, then text,
then position) is removed.  For that, two spans of each sentence are enough: the shortest run that fits and starts at it, and
the shortest that ends at it.  A sentence of a repeated run lies under the first if what follows it in the run fits,
else under the one that ends with the run; and the spans of a repeated run occur with it, in the same order.  Spans are hashed
(128 bits, words joined by single spaces), and equal ones are found by one global aggregation.

Spans are counted with a map-side combine, only repeated ones are joined back, and that join's large side may be split
by the optimizer, so a passage in a third of all documents is no hot group.  Removal lists are grouped per document.

Nulls: a NULL text has no sentences and stays NULL; a NULL doc_id sorts last.  Rows equal in doc_id and text are one
document: they are changed alike.  Empty and very long texts are whole.  An empty table gives an empty result.  Other
columns are carried by `deduplicated` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import split_join
from ..session import written
from .common import carry, per_batch, text_hash, words

#: The floor of 12 words is the last before hits in documents that share no 50 words with another rise steeply (README).
SENTENCES, MIN_WORDS, LONG_SENTENCE = 2, 12, 50
_END = re.compile(rb"(?<=[.!?])[\"')\]]*[ \t\r\f\v]+|\n\s*")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences; each takes the white space behind it along, so the ranges cover the text."""
    cuts = [0, *(m.end() for m in _END.finditer(text) if m.end() < len(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def spans(text: bytes, n_sentences: int = SENTENCES, min_words: int = MIN_WORDS,
          long_sentence: int = LONG_SENTENCE) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, digest) of every span, each once."""
    parts = [words(text[a:b]) for a, b in sentences(text)]
    at = [i for i, p in enumerate(parts) if p]  # those of white space only are part of runs, but no start or end
    joined = [b" ".join(parts[i]) for i in at]
    total, offset = [0], [0]
    for i, text_of in zip(at, joined):
        total.append(total[-1] + len(parts[i]))
        offset.append(offset[-1] + len(text_of) + 1)
    whole, found = b" ".join(joined), {}

    def fits(a: int, b: int) -> bool:
        n = total[b] - total[a]
        return (b - a >= n_sentences and n >= min_words) or (b - a == 1 and n >= long_sentence)

    for i in range(len(at)):
        start, end = i, i + 1
        while end < len(at) and not fits(i, end):
            end += 1
        if fits(i, end):
            found[i, end] = None
        while start > 0 and not fits(start, i + 1):
            start -= 1
        if fits(start, i + 1):
            found[start, i + 1] = None
    return [(at[a], at[b - 1] - at[a] + 1, xxhash.xxh3_128_digest(whole[offset[a]:offset[b] - 1])) for a, b in found]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.col("text").cast("binary").alias("text")
    )


def span_rows(docs: DataFrame) -> DataFrame:
    """(key, doc_id, th, pos, len): all spans of all documents."""

    def run(cols):
        out: dict[str, list] = {"key": [], "doc_id": [], "th": [], "pos": [], "len": []}
        for d, th, text in zip(cols["doc_id"], cols["th"], cols["text"]):
            for pos, n, key in spans(text or b""):
                out["key"].append(key)
                out["doc_id"].append(d)
                out["th"].append(th)
                out["pos"].append(pos)
                out["len"].append(n)
        return out

    schema = pa.schema([
        ("key", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("len", pa.int32())
    ])
    return _texts(docs).mapInArrow(per_batch(run, schema), "key binary, doc_id long, th long, pos int, len int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, len): spans that occurred before, each once."""
    every = written(span_rows(docs), "spans")
    counted = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    hits = written(split_join(every, counted, ["key"], "left_semi"), "repeated")
    place = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th"), F.col("pos").alias("pos")
    )
    first = hits.groupBy("key").agg(F.min(place).alias("first"))
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos")))
    return split_join(hits, first, ["key"]).where(later).select("doc_id", "th", "pos", "len")


def _cut(text: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """Text without the sentences under the runs; number of sentences and of words removed."""
    at = sentences(text)
    gone = {i for r in runs for i in range(r["pos"], r["pos"] + r["len"]) if i < len(at)}
    lost = sum(len(words(text[a:b])) for a, b in (at[i] for i in gone))
    return b"".join(text[a:b] for i, (a, b) in enumerate(at) if i not in gone), len(gone), lost


def _with_runs(docs: DataFrame) -> DataFrame:
    """The rows with `_runs`, their list of spans to remove (NULL: none)."""
    runs = repeated_spans(docs).groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "len")).alias("_runs"))
    runs = written(runs, "runs").withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    # The text crosses the join once, inside its row.
    rows = carry(docs, "doc_id").withColumn("_t", text_hash(F.col("_row.text")))
    return rows.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left")


def dedup_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, words_removed, text (what is left)."""

    def run(cols):
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_sentences": [], "n_removed": [], "words_removed": [], "text": []}
        for text, runs in zip(cols["text"], cols["runs"]):
            left, gone, lost = _cut(text, runs) if text and runs else (text, 0, 0)
            out["n_sentences"].append(len(sentences(text or b"")))
            out["n_removed"].append(gone)
            out["words_removed"].append(lost)
            out["text"].append(None if left is None else left.decode("utf-8", "replace"))
        return out

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("words_removed", pa.int64()), ("text", pa.string())
    ])
    rows = _with_runs(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_row.text").cast("binary").alias("text"), F.col("_runs").alias("runs")
    )
    return rows.mapInArrow(
        per_batch(run, schema), "doc_id long, n_sentences long, n_removed long, words_removed long, text string"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without repeated spans, with their own columns only; n_chars, if there, is kept true.

    Documents of which nothing but white space is left go; those that had no words before stay as they are.
    """
    @F.pandas_udf("string")
    def cut(text, runs):
        import pandas as pd

        return pd.Series([
            None if t is None or r is None else _cut(t, r)[0].decode("utf-8", "replace") for t, r in zip(text, runs)
        ], dtype=object)

    joined = _with_runs(docs)
    hit = F.col("_runs").isNotNull()
    # Untouched rows send NULL to the worker and keep their text.
    left = cut(F.when(hit, F.col("_row.text").cast("binary")), F.col("_runs"))
    changed = joined.withColumn("_left", left).where(~hit | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    row = F.col("_row").withField("text", F.when(hit, F.col("_left")).otherwise(F.col("_row.text")))
    if "n_chars" in docs.columns:
        kept = F.when(hit, F.length("_left")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", kept)
    return changed.select(row.alias("_row")).select("_row.*")
