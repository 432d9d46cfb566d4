"""Spelling variants: words one letter apart, found in a bit-sliced position index.

For a block of the vocabulary there is, per position and letter, a bitset of the words that hold this letter there.  A word is looked up by
four recurrences over its letters, each on whole bitsets: `exact` (no error so far), `other` (at most one letter replaced),
`longer` (the listed word has had one letter more, so its letters are read one place on) and `shorter` (one letter less, one place
back).  All words of a block are looked up at once, so every step is one numpy operation on a table of bitsets.

**What meets.** Of two words one letter apart, with the shorter one (or both) of length l, either the first l // 2 letters are the same or the
other l - l // 2 counted from the end are.  So every word goes into four cells: (first half, l) and (last half, l), for l its
length and its length less one.  Cells are sorted into blocks of about `BLOCK` words, whatever their number.  A cell
that holds more words is cut into slots by a hash of the word, and slots meet in pairs, so no task gets a hot cell whole.
A pair counts in its first-half cell where both share it, else in its last-half cell: it is found once, and all are found.

**Counting.** Runs of letters are counted per task before the shuffle, in a table of at most `HELD` words.

Defined results: NULL or empty texts have no words.  Every row of a repeated doc_id counts, a NULL doc_id is written as nothing before the
colon.  Ties between nearest words go to the smallest in code-point order.  Columns other than doc_id and text are not read; an
empty table gives an empty result.  Letters may be any code points and words of any length: only as many
positions are held at a time as the recurrences look at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

BLOCK, HELD, LONG_TEXT = 2048, 200_000, 1 << 20
_LOWER = str.maketrans({c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


# ------------------------------------------------------------------ counting
def word_counts(docs: DataFrame, least: int, one_in: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters with at least `least` code points, A-Z lower-cased, one in `one_in` without one letter."""
    letters = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def runs(text: str) -> Counter:
        low = text.translate(_LOWER)
        if len(low) < LONG_TEXT:
            return Counter(letters.findall(low))
        return Counter(m.group() for m in letters.finditer(low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seed = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                    for word, n in runs(text).items():
                        h = zlib.crc32(word.encode(), seed)
                        if h % one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ the index
class Letters:
    """Words as code points, longest first, in one flat array."""

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.sizes = np.array([len(p) for p in points], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.alphabet, self.codes = np.unique(np.concatenate(points), return_inverse=True)

    def at(self, place: int) -> np.ndarray:
        """The letters at a place, of the words that reach so far; these are the first ones."""
        n = int(np.searchsorted(-self.sizes, -place, side="left"))
        return self.codes[self.starts[:n] + place]

    def bits(self, place: int) -> np.ndarray:
        """Per letter the bitset of the words that hold it at a place."""
        out = np.zeros((len(self.alphabet), -(-len(self.sizes) // 64)), np.uint64)
        if place >= 0:
            here = self.at(place)
            n = np.arange(len(here))
            np.bitwise_or.at(out, (here, n >> 6), np.uint64(1) << (n & 63).astype(np.uint64))
        return out


def _mask(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all words i, j of a list, longest first, that differ by exactly one letter."""
    x = Letters(words)
    n, wide = len(words), -(-len(words) // 64)
    of_size = {int(s): _mask(x.sizes == s) for s in np.unique(x.sizes)}
    none = np.zeros(wide, np.uint64)
    every = _mask(np.ones(n, bool))
    exact = np.tile(every, (n, 1))
    other, longer, shorter = exact.copy(), exact.copy(), np.zeros((n, wide), np.uint64)
    before, here, ahead = x.bits(-1), x.bits(0), x.bits(1)
    found_i, found_j = [], []
    active = n
    for place in range(int(x.sizes.max(initial=0)) + 1):
        # Words that end here have read all their letters.
        reach = int(np.searchsorted(-x.sizes, -place, side="left"))
        if reach < active:
            rows = slice(reach, active)
            near = other[rows] & of_size.get(place, none)
            near |= longer[rows] & of_size.get(place + 1, none)
            near |= shorter[rows] & of_size.get(place - 1, none)
            near &= ~(exact[rows] & of_size.get(place, none))
            flags = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n]
            i, j = np.nonzero(flags)
            found_i.append(i + reach), found_j.append(j)
            active = reach
        if not active:
            break
        letters = x.at(place)
        was = exact[:active]
        # One letter of the listed word is left out before this place, or one of the own letters here.
        shorter[:active] = (shorter[:active] & before[letters]) | was
        longer[:active] &= ahead[letters]
        other[:active] = (other[:active] & here[letters]) | was
        exact[:active] = was & here[letters]
        longer[:active] |= exact[:active]
        before, here, ahead = here, ahead, x.bits(place + 2)
    return np.concatenate(found_i or [np.empty(0, int)]), np.concatenate(found_j or [np.empty(0, int)])


# ------------------------------------------------------------------ cells
def cells(vocabulary: DataFrame) -> DataFrame:
    """(half, l, part, a, b, own, word, n): every word in each of its cells, a hot cell in pairs (a, b) of slots."""
    size = F.char_length("word")

    def half(kind: str, short) -> list:
        head = F.floor(short / 2).cast("int")
        part = F.substring(F.col("word"), F.lit(1), head) if kind == "first" else F.right("word", short - head)
        return [F.lit(kind).alias("half"), short.alias("l"), part.alias("part")]

    kinds = [F.struct(*half(kind, short)) for kind in ("first", "last") for short in (size, size - 1)]
    each = vocabulary.select("word", "n", F.inline(F.array(*kinds))).where("l > 0")
    hot = written(
        each.groupBy("half", "l", "part").count().where(F.col("count") > BLOCK).select(
            "half", "l", "part", F.ceil(F.col("count") / BLOCK).cast("int").alias("slots")
        ), "hot-cells",
    )
    placed = each.join(hot, ["half", "l", "part"], "left")
    slot = F.pmod(F.xxhash64("word"), F.col("slots")).cast("int")
    # A slot meets every slot of its cell, itself included, once.
    own = F.coalesce(slot, F.lit(0))
    meetings = F.transform(
        F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1),
        lambda s: F.struct(F.least(own, s).alias("a"), F.greatest(own, s).alias("b"), own.alias("own")),
    )
    return placed.select("half", "l", "part", F.inline(meetings), "word", "n")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words one letter apart, each once."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def block(held: list[tuple]) -> pa.RecordBatch:
        # Ones of a cell keep a number; a pair counts only inside its cell and where this cell is its first.
        held.sort(key=lambda r: -len(r[5]))
        number: dict = {}
        cell = np.array([number.setdefault(r[:5], len(number)) for r in held])
        words, counts = [r[5] for r in held], np.array([r[6] for r in held], np.int64)
        i, j = near_pairs(words)
        same = cell[i] == cell[j]
        i, j = i[same], j[same]
        sizes = np.array([len(w) for w in words])
        short = np.array([r[1] for r in held])
        last = np.array([r[0] == "last" for r in held])
        slots = np.array([r[3] != r[4] for r in held])
        own = np.array([r[7] for r in held])
        # Pairs of two slots are met in the cell of both; two words of one slot in the cell of that slot alone.
        right = (np.minimum(sizes[i], sizes[j]) == short[i]) & (~slots[i] | (own[i] != own[j]))
        i, j = i[right], j[right]
        keep = [not last[a] or words[a][: short[a] // 2] != words[b][: short[a] // 2] for a, b in zip(i.tolist(), j.tolist())]
        i, j = i[keep], j[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[a] for a in i], pa.string()), pa.array([words[b] for b in j], pa.string()), pa.array(counts[j])],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("half", "l", "part", "a", "b", "word", "n", "own"))):
                if len(held) >= BLOCK and row[:5] != held[-1][:5]:
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    key = ["half", "l", "part", "a", "b"]
    dealt = cells(vocabulary).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "word string, near string, near_n long")


# ------------------------------------------------------------------ forms
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for all words with a form: forms are followed to the last, twice as far in every round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = written(
            now.join(on, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ), "roots",
        )
        now = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = 6, at_least: int = 5, times: int = 5, one_in: int = 199, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word, if at least `times` as frequent."""
    if times < 2:
        raise ValueError("a form must be more frequent than its word, else forms could run in a circle")
    counted = word_counts(docs, least, one_in, id_col, text_col)
    vocabulary = written(counted.where(F.col("n") >= at_least), "vocabulary")
    # The greatest count wins; of equal counts the smallest word, as UTF-8 keeps code-point order.
    nearest = neighbours(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("near_n"),
        F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("near"),
    )
    judged = written(
        vocabulary.join(nearest, "word", "left").withColumn("_has", F.col("near_n") >= times * F.col("n")).select(
            "word", F.when(F.col("_has"), F.col("near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_has"), F.col("near_n")).alias("form_n"),
        ), "forms",
    )
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
