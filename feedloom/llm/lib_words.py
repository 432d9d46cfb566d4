"""Token ids through the tokenizers library, word by word.

The vocabulary's own normaliser and split decide the words; the library's model encodes each word once, and its ids are
remembered, so a word is encoded once however often it occurs.  The ids of a text are those of its words in order; tests hold
them against the library's whole-text encoding.

A slice of texts is cut into words by Arrow's kernels, and only its different words become Python strings.  Words are numbered,
and their ids lie one behind the other in one array, from which those of the slice are gathered.  All words of a slice that
are not known yet go to the library together.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import Codec

#: Words a worker remembers while it encodes a partition, and those of them, used most, that stay beyond it or when they are too many.
REMEMBERED, KEPT = 400_000, 150_000
#: Ids remembered for each of them on average, at most.
IDS_EACH = 8
#: Characters that are cut into words at once, and a part of a text more; unknown words of one call, whose answer is large.
AT_ONCE, ASKED = 1 << 21, 1 << 14
#: The split that Arrow's kernels can do, and all it cuts out from between letters (their \s lacks the vertical tab).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BETWEEN = r"'s|'t|'re|'ve|'m|'ll|'d|\pN|[^\s\x0b\pL\pN]+"
#: All but Latin letters and common marks: as lower case, normal form or kind may differ, the library's normaliser and the
#: vocabulary's own split run.
NOT_EASY = r"[\x{85}\x{a0}\x{130}\x{250}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{10ffff}]"


class Places(dict):
    """Numbers keys in the order they first come."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one behind the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class LibraryCodec(Codec):
    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(file)
        # Of the library only the model, for words between spaces, and the normaliser are called for.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer, self.library = pre_tokenizers.WhitespaceSplit(), None
        self.easy = self.split.pattern == SPLIT
        end = self.pieces[self.last[0]].removeprefix(self.pieces[self.inner[0]])
        self.ends = np.array([p is not None and p.endswith(end) for p in self.pieces])
        # Always known: the empty word, and the added tokens under names that no split gives to a word.
        added = list(self.special.values())
        self.memo = Places({name: place for place, name in enumerate(["", *[f"#{i}" for i in added]])})
        self.fixed, self.flat, self.size = len(self.memo), np.array(added, np.uint32), np.array([0] + [1] * len(added))
        self.start, self.uses = np.cumsum(self.size) - self.size, np.zeros(self.fixed, np.int64)

    @staticmethod
    def ranks(merges, vocab):
        """The library merges; a worker need not hold the pairs a second time."""
        return {}

    def cut(self, parts: list[str | int]) -> pa.ListArray:
        """The words of each stretch of text, in order; among them empty ones."""
        texts = pa.array(["" if isinstance(p, int) else p for p in parts], pa.string())
        hard = np.array([isinstance(p, int) or not self.easy for p in parts], bool)
        hard |= pc.match_substring_regex(texts, NOT_EASY).to_numpy(zero_copy_only=False)
        spaced = texts
        if not hard.all():
            spaced = pc.replace_substring_regex(pc.utf8_lower(texts), BETWEEN, r" \0 ")
        if hard.any():
            found = [
                f"#{p}" if isinstance(p, int) else " ".join(self.split.findall(self.normalizer.normalize_str(p)))
                for p in itertools.compress(parts, hard.tolist())
            ]
            spaced = pc.replace_with_mask(spaced, pa.array(hard), pa.array(found, pa.string()))
        return pc.ascii_split_whitespace(spaced)

    def library_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word).  The model reads bytes as letters; printable ASCII letters stand for themselves."""
        letters = [
            w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.byte_letters) for w in words
        ]
        ids = np.array(self.words.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(words):
            return ids, np.diff(last, prepend=-1)
        # A piece inside a word may be written like one at its end.
        each = [[t.id for t in self.words.model.tokenize(w)] for w in letters]
        return np.array(list(itertools.chain(*each)), np.uint32), np.array([len(x) for x in each])

    def keep(self) -> None:
        """Forget all but the `KEPT` words used most, of which fewer stay if they have very many ids."""
        most = self.fixed + np.argsort(-self.uses[self.fixed:], kind="stable")[:KEPT]
        most = np.concatenate([np.arange(self.fixed), most[np.cumsum(self.size[most]) <= IDS_EACH * KEPT]])
        names = list(self.memo)
        self.memo = Places({names[i]: place for place, i in enumerate(most.tolist())})
        self.flat = gathered(self.flat, self.start[most], self.size[most])
        self.size, self.uses = self.size[most], self.uses[most] // 2
        self.start = np.cumsum(self.size) - self.size

    def places(self, words: list[str]) -> np.ndarray:
        """Numbers of different words, whose ids are known from now on."""
        if len(self.memo) > REMEMBERED or len(self.flat) > IDS_EACH * REMEMBERED:
            self.keep()
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        new = np.flatnonzero(at >= len(self.size))
        if len(new):
            found = [self.library_ids([words[i] for i in new[k:k + ASKED].tolist()]) for k in range(0, len(new), ASKED)]
            ids, size = (np.concatenate(x) for x in zip(*found))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        return at

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, one behind the other, and where those of each text end."""
        ids, ends, parts, cuts, held, done = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [], [], 0, 0

        def flush() -> int:
            cells = self.cut(parts)
            words = cells.values.dictionary_encode()
            at, which = self.places(words.dictionary.to_numpy(zero_copy_only=False).tolist()), words.indices.to_numpy()
            self.uses[at] += np.bincount(which, minlength=len(at))
            place = at[which]
            size = self.size[place]
            ids.append(gathered(self.flat, self.start[place], size))
            reach = done + np.concatenate([[0], np.cumsum(size)])
            ends.append(reach[cells.offsets.to_numpy()[cuts]])
            return int(reach[-1])

        for text in texts:
            for part in self.segments(text or ""):
                parts.append(part)
                held += 1 if isinstance(part, int) else len(part)
                if held >= AT_ONCE:
                    done = flush()
                    parts, cuts, held = [], [], 0
            cuts.append(len(parts))
        if cuts:
            flush()
        return np.concatenate(ids), np.concatenate(ends)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0].astype("<u4").tobytes()


@functools.cache
def library_codec(file: str) -> LibraryCodec:
    """One per worker process, which encodes in its own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryCodec(file)
