"""BPE encoding and decoding with a contiguous rank array.

A word is an array of parts with, beside each part, the rank of the merge with its right neighbour.  The
smallest rank (leftmost on ties) is found by scanning the array, the boundary behind it is deleted, and the ranks
of the two neighbours are refreshed.  For short words, and nearly all are, such a scan beats any heap.  Words of more
than `LONG` parts take a heap over linked parts, with the same order of merges, so that time stays
n log n for a text without white space.

The vocabulary file gives pieces, merges, added tokens, the split pattern and the normaliser; nothing is
trained or copied.  Its normaliser runs from the library; splitting, merging and decoding are done here.

Nulls count as empty texts; an empty text has no ids and decodes to an empty text.  Repeated rows and
ties are encoded row by row; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, per_batch

LONG = 96
#: Remembered words, and stretches between white space that hold several, per worker.
WORDS = 300_000
#: Below this character every text is in normal form, and lower-casing is letter by letter.
NOT_PLAIN = re.compile("[\u0250-\U0010ffff]")
#: Characters that str.split() takes for white space but the vocabulary's split does not.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Texts are cut at white space into pieces of about so many characters, to bound memory.
PIECE = 1_000_000
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def merge_short(parts: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Repeat: scan for the least rank, delete that boundary, refresh the ranks beside it."""
    lookup = pairs.get
    ranks = [lookup(p, (_NONE, 0))[0] for p in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        parts[i:i + 2] = [pairs[parts[i], parts[i + 1]][1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = lookup((parts[i], parts[i + 1]), (_NONE, 0))[0]
        if i:
            ranks[i - 1] = lookup((parts[i - 1], parts[i]), (_NONE, 0))[0]
    return parts


def merge_long(parts: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same merges with a heap of (rank, position) over linked parts."""
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if gone[i] or j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i] = pairs[a, b][1]
        gone[j] = True
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (parts[x], parts[y]) in pairs:
                heapq.heappush(heap, (pairs[parts[x], parts[y]][0], x, parts[x], parts[y]))
    return [p for p, dead in zip(parts, gone) if not dead]


class Codec:
    """Encoder and decoder of one vocabulary file of the word-end kind."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(file)
        self.normalizer = self.library.normalizer
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        end = model.get("end_of_word_suffix") or ""
        self.pairs = self.ranks(model["merges"], vocab)
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.pieces: list[str | None] = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = token
        self.byte_letters = {i: c for i, c in enumerate(letters)}
        self.memo = Memo(self.chunk, WORDS)

    @staticmethod
    def ranks(merges: list, vocab: dict[str, int]) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, merged id) of each pair of ids that merges."""
        return {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}

    def word(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        data = word.encode("utf-8")
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        merged = merge_short(parts, self.pairs) if len(parts) <= LONG else merge_long(parts, self.pairs)
        return struct.pack(f"<{len(merged)}I", *merged)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a normalised stretch without white space; no pre-token goes over white space."""
        if chunk.isalpha():
            return self.word(chunk)
        found = self.split.findall(chunk)
        return self.word(chunk) if found == [chunk] else b"".join([self.memo[w] for w in found])

    def chunks(self, part: str) -> list[str]:
        """The normalised stretches of a text; the library's normaliser runs where the short way might differ."""
        if NOT_PLAIN.search(part):
            part = self.normalizer.normalize_str(part)
        else:
            part = part.lower()
        return [part] if any(c in part for c in ODD) else part.split()

    def segments(self, text: str) -> Iterator[str | int]:
        """Stretches of ordinary text, and ids of the added tokens between them."""
        start = 0
        while start < len(text):
            cut = text.find(" ", start + PIECE)
            cut = len(text) if cut < 0 else cut
            piece = text[start:cut]
            start = cut
            if self.special_split is None or "<" not in piece:
                yield piece
                continue
            for part in self.special_split.split(piece):
                if part:
                    yield self.special.get(part, part)

    def encode(self, text: str | None) -> bytes:
        out = []
        for part in self.segments(text or ""):
            if isinstance(part, int):
                out.append(struct.pack("<I", part))
                continue
            memo = self.memo
            out.append(b"".join([memo[c] for c in self.chunks(part)]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: pieces are joined by spaces; ids without a piece are left out."""
        pieces, n = self.pieces, len(self.pieces)
        return " ".join([
            p for i in np.frombuffer(ids, "<u4").tolist() if i < n and (p := pieces[i]) is not None
        ])


@functools.cache
def codec(file: str) -> Codec:
    """One per worker process."""
    return Codec(file)


def encoded(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids of every whole text as little-endian unsigned 32-bit integers."""

    def run(cols):
        enc = codec(file).encode
        return {"doc_id": cols["doc_id"], "ids": [enc(t) for t in cols["text"]]}

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(per_batch(run, schema), "doc_id long, ids binary")


def decoded(rows: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text that the ids stand for."""

    def run(cols):
        dec = codec(file).decode
        return {"doc_id": cols["doc_id"], "text": [dec(b or b"") for b in cols["ids"]]}

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return rows.mapInArrow(per_batch(run, schema), "doc_id long, text string")


def round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids, digest of the ids, digest of the text decoded from them."""

    def run(cols):
        c = codec(file)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in cols["text"]:
            ids = c.encode(text)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
        return out

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())
    ])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        per_batch(run, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
