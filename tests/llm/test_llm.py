"""The corpus operators against brute force on small rows: nulls, blanks, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm import (
    adaptive_rules, bpe, components, fair_mix, huffman, hyperminhash, lib_words, quality_pu, sentence_spans,
    token_histogram, topk, url_filter,
)
from feedloom.llm.queries import URL_RULES, word_bpe_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "One two three four five six. Seven eight nine ten.", "en", "a", 50), (1, "One two three four five six. Seven eight nine ten.", "en", "a", 50),
    (2, None, None, None, None), (3, "", "en", None, 0), (None, "  \n\t ", None, "b", 5), (None, "é ß <|endoftext|> İ", "fr", "b", 9),
    (4, "long " * 30_000, "en", "a", 150_000), (5, "x" * 20_000, "en", "a", 20_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with a column whose name the operators use themselves."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("own") for c in ("kept", "n_tokens", "size", "th", "node", "score", "_c2")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------------------------ 1: urls
def test_urls(spark):
    urls = [
        "https://A.Net/x", "https://net/", "https://net", "http://sub.example.net/en/1?x#y", "http://sub.example.net/enx", "ftp://example.com/de/",
        "http://notexample.com/de/", "http://x.org/fr/2", "http://x.org/de", None, "", "no scheme", "https://", "://net/a", "http://a.b.net/?q=/en/",
    ]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("own"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    for limit in (1 << 20, 0):  # the array, and the join for rule sets too large for it
        got = {r[0]: tuple(r[1:]) for r in url_filter.judged_urls(rows, rules, max_bytes=limit).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    # Rules whose host and path are equal when written together are rules apart; NULL hosts, repeats and both verdicts.
    twins = spark.createDataFrame(
        [("net", "", "block"), ("ne", "t", "allow"), (None, "/x", "block"), ("b.org", "/a", "allow"), ("b.org", "/a", "block"), ("b.org", "/a", "allow")],
        "host string, path string, verdict string",
    )
    some = spark.createDataFrame([(1, "http://net/x"), (2, "http://ne/t"), (3, "http://c.b.org/a/" + "q" * 50_000)], "page_id long, url string")
    for limit in (1 << 20, 0):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged_urls(some, twins, max_bytes=limit).collect()}
        assert got == {1: ("net", "block"), 2: (None, "allow"), 3: ("b.org/a", "block")}
    assert url_filter.judged_urls(rows.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judged_urls(rows, rules.limit(0)).collect()} == {"allow"}


def test_the_driver_holds_no_rule_as_an_object(spark, tmp_path):
    import tracemalloc

    n = 30_000
    rows = spark.range(0, n, 1, 3).select(F.col("id").alias("key"), F.concat(F.lit("r"), "id", F.lit("\0allow")).alias("text"))
    tracemalloc.start()
    try:
        file = url_filter.write_array(spark, rows, str(tmp_path / "rules.bin"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    stored = url_filter.DigestArray(file)
    assert len(stored.keys) == n and (stored.keys ^ np.uint64(1 << 63)).tolist() == list(range(n))
    assert [stored.stored(i) for i in (0, 7, n - 1)] == [f"r{i}\0allow".encode() for i in (0, 7, n - 1)]
    assert peak < 4 * (tmp_path / "rules.bin").stat().st_size


def test_digest_collisions_are_confirmed(tmp_path):
    texts = [b"raa\0block", b"rbb\0allow", b"rcc\0block"]
    digest = url_filter.xxhash.xxh64_intdigest(b"rbb")
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.uint64)
    file = tmp_path / "array.bin"
    file.write_bytes(np.array([3, digest, digest, digest], np.uint64).tobytes() + offsets.tobytes() + b"".join(texts))
    array = url_filter.DigestArray(str(file))
    assert array.find([b"rbb", b"rzz"]) == [b"allow", None]


# --------------------------------------------------------------- 2: quality
def test_quality(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(w + ("###" if i % 4 == 0 else "") for w in prose(i, rng.randrange(60, 120))), "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 600, 1)], "doc_id long, quality int, toxic int")
    got = quality_pu.classified(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 60 and sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) / len(held) > 0.95
    assert quality_pu.classified(odd, labels).count() == len(ODD)
    assert quality_pu.classified(odd, labels.limit(0)).count() == len(ODD)
    assert quality_pu.classified(empty, labels).count() == 0


# ------------------------------------------------------------------- 3: mix
def test_mix(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(prose(i, rng.randrange(0, 40))), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(2000)]
    got = fair_mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    total = sum(r["size"] for r in got)
    taken, target = {}, {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert 1.5 * total - 100 < sum(taken.values()) <= 1.5 * total
    assert all(abs(taken[s] - target[s]) < 120 for s in target)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, got)) == sorted(map(str, fair_mix.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(7)).collect()))
    assert fair_mix.mix(odd).count() == len(ODD)
    assert fair_mix.mixed_documents(odd).columns == odd.columns
    assert fair_mix.mix(empty).count() == 0


# ----------------------------------------------------------------- 4: top-k
def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    m = (rng.normal(size=(700, 12)) * rng.lognormal(0, 1, (700, 1))).astype(np.float32)
    m[50] = m[51]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (None, [1.0]), (1000, [0.5, 0.25]), (1001, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(frame, frame.where("vec_id % 100 = 0")).collect()
    ints = {i: np.floor(1024 * np.array([*v, *[0] * (12 - len(v))], np.float64)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 100 == 0):
        scored = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id in (1000, 1)"), frame.where("vec_id = 1000")).collect()[0]["vec_id"] == 1


# --------------------------------------------------------------- 5: minhash
def near_rows():
    rng = random.Random(9)
    rows, n = [], 0
    for g in range(12):
        base = prose(g, 60 + 20 * g, 100_000)
        for c in range(1 if g % 3 == 0 else 14):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((n, " ".join(copy).upper() if c % 5 == 1 else "\t".join(copy), "en", "s", 1))
            n += 1
    rows += [(n + i, t, "en", "s", 1) for i, t in enumerate(["a b", "A  b", "a", "A\n", "b", "a b c d e", "a b c d e f", "x a b c d e"])]
    return rows


def brute_groups(rows, k, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k, monkeypatch):
    monkeypatch.setattr(hyperminhash, "CELL", 600)
    rows = near_rows()
    sets, groups = brute_groups(rows, k)
    got = {r["doc_id"]: r for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, DOCS), k).collect()}
    for i, (d, *_) in enumerate(rows):
        assert (got[d]["n_shingles"], got[d]["component_id"]) == (len(sets[i]), rows[groups[i]][0]), rows[i][1][:80]
        assert got[d]["kept"] == (groups[i] == i)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = hyperminhash.near_duplicates(odd, 5).collect()
    assert len(got) == len(ODD) and all(r["n_shingles"] == 0 for r in got if r["doc_id"] in (2, 3))
    kept = hyperminhash.deduplicated(odd, 5)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1  # the repeated row goes
    assert hyperminhash.near_duplicates(empty, 5).count() == 0 and hyperminhash.deduplicated(empty).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8, 0.95):
        both = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        n = int(4000 * share / (1 - share) if share < 0.5 else 4000)
        only = int(n * (1 - share) / share / 2)
        a, b = (np.unique(np.r_[both[:n], rng.integers(0, 2**63, only, dtype=np.uint64)]) * np.uint64(2) for _ in range(2))
        est, _ = hyperminhash.estimates(hyperminhash.registers(np.sort(a)), hyperminhash.registers(np.sort(b))[None], len(a), np.array([len(b)]))
        assert abs(est[0] - share) < 0.15


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# ------------------------------------------------------------------ 6: BPE
TEXTS = [
    "", "Hello, World!", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ﬁ", "é ̈x", "\u0085a b　c", "x's it'll I'D", "１２ ²³ Ⅷ", "😀👍🏽🇩🇪", "\x00a\x1cb\x1fc",
    "日本語", "Å Å Ω K ẞ", "<|startoftext|>Hi<|endoftext|> x <|endoftext|", "xyzqw" * 400, "ab " * 500, "été garçon", "﻿ab​cd\xad",
]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe_file())
    for codec in (bpe.Codec(word_bpe_file()), lib_words.LibraryCodec(word_bpe_file())):
        for text in TEXTS:
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids, text[:40]
            assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)
        whole = codec.encode("some words " * 50)
        codec.memo.half = 1
        assert codec.encode("some words " * 50) == whole


@pytest.mark.parametrize("easy", [True, False])
def test_unknown_words_of_a_slice_take_one_library_call(monkeypatch, easy):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe_file())
    marks = [chr(c) for c in [*range(0x260), *range(0x2000, 0x2070)]]
    texts = [None, *TEXTS, "it's 'sad x'\u2019s #49406 #2 '' 12", *[f"{c} A{c}b{c}'S 1{c}{c}" for c in marks]] + [" ".join(prose(3, 400))] * 2
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    codec = lib_words.LibraryCodec(word_bpe_file())
    codec.easy &= easy
    calls, asked = [], codec.library_ids
    monkeypatch.setattr(codec, "library_ids", lambda words: calls.append(len(words)) or asked(words))

    def encoded():
        ids, ends = codec.encode_all(texts)
        return [x.tolist() for x in np.split(ids, ends)[:-1]]

    assert encoded() == want and len(calls) == 1
    assert encoded() == want and len(calls) == 1
    assert not len(codec.encode_all([])[0]) and [len(x) for x in codec.encode_all([""])] == [0, 1]
    # With little memory, and pieces within words that look like their ends.
    for name, value in (("AT_ONCE", 40), ("ASKED", 3), ("REMEMBERED", 60), ("KEPT", 7)):
        monkeypatch.setattr(lib_words, name, value)
    monkeypatch.setattr(codec, "ends", np.ones_like(codec.ends))
    codec.keep()
    assert len(codec.memo) == len(codec.size) == codec.fixed + 7
    assert encoded() == want and len(calls) > 10 and len(codec.memo) < 600


def test_merges_of_long_words_are_those_of_short_ones():
    rng = random.Random(1)
    pairs = {(a, b): (r, 10 + r) for r, (a, b) in enumerate(rng.sample([(a, b) for a in range(14) for b in range(14)], 40))}
    for _ in range(300):
        parts = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        assert bpe.merge_short(list(parts), pairs) == bpe.merge_long(list(parts), pairs)


def test_bpe_query(odd, empty):
    got = bpe.round_trip(odd, word_bpe_file()).collect()
    blank = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(ODD) and [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] == 2] == [(0, blank, blank)]
    assert bpe.round_trip(empty, word_bpe_file()).count() == 0
    texts = bpe.decoded(bpe.encoded(odd, word_bpe_file()), word_bpe_file()).where("doc_id = 1").collect()
    assert texts[0]["text"].startswith("one</w> two</w>")


# -------------------------------------------------------------- 7: Huffman
def test_code_lengths_are_best():
    rng = random.Random(2)
    for _ in range(60):
        n, limit = rng.randrange(2, 7), 4
        counts = [rng.randrange(1, 40) for _ in range(n)]
        got = huffman.code_lengths(np.array(counts), limit)
        best = min(sum(c * x for c, x in zip(counts, ls)) for ls in itertools.product(range(1, limit + 1), repeat=n) if sum(2.0 ** -x for x in ls) <= 1)
        assert (got * np.array(counts)).sum() == best and got.max() <= limit


def test_joined_crcs_reuse_their_matrices():
    rng = random.Random(6)
    huffman._zero_bits.cache_clear()
    for n in [0, 1, 4, *[rng.randrange(10**5) for _ in range(50)]]:
        a, b = rng.randbytes(33), rng.randbytes(n)
        assert huffman._crc_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)
    assert huffman._zero_bits.cache_info().misses <= 21


def test_token_files(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 300)
    rows = [(i * 3 % 97, " ".join(prose(i, i * 7 % 500)), "en", "s", 1) for i in range(97)]
    got, narrow = (
        sorted(map(tuple, huffman.tokens_written_and_read(spark.createDataFrame(rows, DOCS), word_bpe_file(), width=w).collect())) for w in (4, 2)
    )
    assert got == narrow
    codec, start, want = bpe.Codec(word_bpe_file()), 0, []
    for d, text, *_ in sorted(rows):
        ids = codec.encode(text) + (2).to_bytes(4, "little")
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == want
    counts = collections.Counter(codec.encode(t) + (2).to_bytes(4, "little") for _, t, *_ in ODD)
    got = huffman.tokens_written_and_read(odd, word_bpe_file()).collect()
    assert collections.Counter((r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter(
        {(len(ids) // 4, zlib.crc32(ids)): n for ids, n in counts.items()})
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][-2:] == [None, None]
    assert huffman.tokens_written_and_read(empty, word_bpe_file()).count() == 0


# ------------------------------------------------------- 8: sentence spans
def test_repeated_passages_stay_once(spark, odd, empty):
    passage = ". ".join(" ".join(prose(100 + s, 14, 10**6)) for s in range(4)) + "."
    own = [". ".join(" ".join(prose(1000 + 10 * d + s, 9, 10**6)) for s in range(5)) + "." for d in range(6)]
    texts = [own[0], f"{own[1]} {passage} {own[2]}", f"{own[3]}\n{passage}\n{own[4]}", passage, own[5], own[5]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in sentence_spans.dedup_texts(docs).collect()}
    assert [got[i]["text"] for i in (0, 1, 4)] == [texts[0], texts[1], texts[4]]
    assert got[2]["text"].split() == f"{own[3]} {own[4]}".split() and got[2]["words_removed"] == 56
    assert got[3]["text"] == "" and got[5]["text"] == ""
    left = {r["doc_id"]: r for r in sentence_spans.deduplicated(docs).collect()}
    assert sorted(left) == [0, 1, 2, 4] and left[2]["n_chars"] == len(left[2]["text"])
    assert sentence_spans.dedup_texts(odd).count() == len(ODD)
    # The word repeated for pages is one sentence: it stays, as do blank rows.
    assert sentence_spans.deduplicated(odd).columns == odd.columns and sentence_spans.deduplicated(odd).count() == len(ODD)
    assert sentence_spans.dedup_texts(empty).count() == 0


def brute_spans(rows):
    """Text left of each (doc_id, text): all runs of sentences that fit, without those that an earlier place has."""
    first, left = {}, {}
    for d, text in sorted({(d, t or "") for d, t, *_ in rows}):
        data = text.encode()
        pieces = [data[a:b] for a, b in sentence_spans.sentences(data)]
        at, gone = [i for i, p in enumerate(pieces) if p.split()], set()
        for a in range(len(at)):
            digest, n = hashlib.sha256(), 0
            for b in range(a, len(at)):
                run = pieces[at[b]].split()
                n += len(run)
                digest.update(b"".join(w + b" " for w in run))
                if (b > a and n >= 12) or (b == a and n >= 50):
                    if first.setdefault(digest.digest(), (d, a)) != (d, a):
                        gone.update(range(at[a], at[b] + 1))
        left[d] = b"".join(p for i, p in enumerate(pieces) if i not in gone).decode()
    return left


def brute_mix(rows, weights=(5, 2, 1)):
    """Copies of each doc_id (once in rows of doc_id, text, source): the fair queue, one document at a time."""
    size = {d: len(t.encode().split()) for d, t, _ in rows}
    total = {}
    for d, _, s in rows:
        total[s] = total.get(s, 0) + size[d]
    budget = 1.5 * sum(total.values())
    unsettled = {s: weights[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s)))}
    target, rest = {}, budget
    while full := [s for s, w in unsettled.items() if 2 * total[s] * sum(unsettled.values()) <= rest * w]:
        for s in full:
            target[s] = 2.0 * total[s]
            del unsettled[s]
        rest = budget - sum(target.values())
    target |= {s: w * rest / sum(unsettled.values()) for s, w in unsettled.items()}
    offers, end = [], {}
    for epoch in range(2):
        for h, d, s in sorted((hashlib.md5(str(d).encode()).hexdigest(), d, s) for d, _, s in rows):
            end[s] = end.get(s, 0) + size[d]
            offers.append((end[s] / target[s] if target[s] else 0.0, s is None, s, epoch, h, d))
    copies, used = {d: int(not size[d]) for d in size}, 0
    for *_, d in sorted(offers):
        used += size[d]
        copies[d] += bool(size[d]) and used <= budget
    return copies


def passage_of(sizes, seed):
    """Sentences of so many words that occur nowhere else."""
    return " ".join(" ".join(prose(f"{seed}-{i}", n, 10**9)) + "." for i, n in enumerate(sizes))


def test_repeated_passages_go_to_their_ends(spark):
    sizes = [[30, 1, 23], [30, 8, 8, 8], [28, 12, 12], [20, 20, 12, 12], [8, 8, 8, 30], [3, 60, 3], [60, 2], [1] * 26, [24, 1], [24], [49], [50], [30, 1, 5], [12, 4, 4, 3]]
    rng = random.Random(8)
    sizes += [[rng.choice([1, 2, 5, 9, 16, 26, 55]) for _ in range(rng.randrange(1, 8))] for _ in range(30)]
    own = lambda i: passage_of([5, 11], f"own{i}")
    texts = [f"{own(2 * i)} {passage_of(s, i)}\n{own(2 * i + 1)}" for i, s in enumerate(sizes)]
    texts += [f"{own(1000 + i)}\n \n{passage_of(s, i)} {own(2000 + i)}" for i, s in enumerate(sizes)]
    texts += [" ".join([passage_of([10, 20], "loop")] * 3) + " " + own("loop"), passage_of([9, 9], 1) + " \n" + passage_of([30, 8, 8, 8], 1)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in sentence_spans.dedup_texts(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: r["text"].split() for d, r in got.items()} == {d: t.split() for d, t in brute_spans(rows).items()}
    assert [got[len(sizes) + i]["words_removed"] for i in range(4)] == [54, 54, 52, 64]


def test_passages_of_short_sentences_go(spark):
    """Passages of over 50 words that begin and end inside sentences; their whole sentences are short."""
    sizes = [[2, 9, 11, 2], [4, 1, 1, 6, 5, 3], [5, 12], [13, 9], [6, 5]]
    texts = []
    for copy in range(2):
        for i, whole in enumerate(sizes):
            head, tail = (" ".join(prose(f"{end}{i}", 20, 10**9)) for end in ("head", "tail"))
            own = [prose(f"own{copy}{i}{end}", 1, 10**9)[0] for end in range(2)]
            texts.append(f"{own[0]} {head}. {passage_of(whole, i)} {tail} {own[1]}.")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in sentence_spans.dedup_texts(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i]["words_removed"] for i in range(10)] == [0] * 5 + [24, 20, 17, 22, 0]  # 11 words are below the floor
    assert {d: r["text"].split() for d, r in got.items()} == {d: t.split() for d, t in brute_spans(rows).items()}


def test_sentences_cover_the_text():
    for text in (b"A b. C d!  E?\n\nF", b"", b" . x", b"One.Two three\n", "é. ü! ß".encode()):
        assert b"".join(text[a:b] for a, b in sentence_spans.sentences(text)) == text


# ------------------------------------------------------- 9: quality rules
def test_rules(spark, odd, empty):
    def brute(text):
        w = (text or "").encode().split()
        hits = {}
        for i in range(len(w) - 2):
            hits.setdefault(tuple(w[i:i + 3]), []).append(i)
        covered = {j for at in hits.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        solid = "".join(x.decode() for x in w)
        return (len(w), len(solid), sum(c in "#*$%&|<>" for c in solid), len(lines) - len(set(lines)), len(covered))

    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(prose(rng.randrange(40), rng.randrange(1, 12), 20)) for _ in range(9)), "en", "s", 1) for i in range(150)]
    rows += [(500 + i, " ".join(w + "###" for w in prose(i, 80)), "en", "s", 1) for i in range(5)]
    rows += [(600 + i, " ".join(prose(i, 80)), "en", "s", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in adaptive_rules.verdicts(adaptive_rules.metrics_of(docs)).collect()}
    for d, text, *_ in rows:
        assert tuple(got[d][c] for c in adaptive_rules.COUNTS) == brute(text)
        n, repeats = got[d]["n_words"], got[d]["n_repeat_words"]
        assert got[d]["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    assert not any(got[500 + i]["kept"] for i in range(5)) and all(got[600 + i]["kept"] for i in range(150))
    found = {(r["doc_id"], *(r[c] for c in adaptive_rules.COUNTS)) for r in adaptive_rules.verdicts(adaptive_rules.metrics_of(odd)).collect()}
    assert found == {(d, *brute(t)) for d, t, *_ in ODD}
    kept_odd = adaptive_rules.kept_documents(odd, adaptive_rules.metrics_of(odd))
    assert kept_odd.columns == odd.columns
    assert adaptive_rules.verdicts(adaptive_rules.metrics_of(empty)).count() == 0


# ------------------------------------------------------- 10: token counts
def test_token_counts(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(token_histogram, "SLICE", 8)
    rows = [(i, " ".join(prose(i, i % 37)), "en", "s", 1) for i in range(200)] + [(None, None, None, None, None)]
    codec = bpe.Codec(word_bpe_file())
    lengths = sorted(len(codec.encode(t)) // 4 for _, t, *_ in rows)
    answer = token_histogram.token_counts(spark.createDataFrame(rows, DOCS), word_bpe_file())
    got = {r["n_tokens"]: r for r in answer.collect()}
    assert sorted(got) == sorted(set(lengths))
    for x, r in got.items():
        assert (r["n_docs"], r["docs_up_to"], r["docs_above"]) == (lengths.count(x), sum(v <= x for v in lengths), sum(v > x for v in lengths))
        assert (r["total_tokens"], r["truncated_tokens"]) == (sum(lengths), sum(min(v, x) for v in lengths))
    limits = [0, 1, 7, 10 ** 6, *range(lengths[-1] - 3, lengths[-1] + 2)]
    hist = spark.createDataFrame(collections.Counter(lengths).items(), "n_tokens long, n_docs long")
    for r in token_histogram.at_limits(hist, limits).collect():
        x = r["context_limit"]
        assert tuple(r)[1:] == (sum(v <= x for v in lengths), sum(v > x for v in lengths), sum(lengths), sum(min(v, x) for v in lengths))
    middle = token_histogram.quantiles(answer, [0.5, 1.0]).collect()
    assert {r["share"]: r["n_tokens"] for r in middle} == {0.5: lengths[(len(lengths) + 1) // 2 - 1], 1.0: lengths[-1]}
    assert token_histogram.token_counts(odd, word_bpe_file()).agg(F.sum("n_docs")).first()[0] == len(ODD)
    assert token_histogram.token_counts(empty, word_bpe_file()).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "bpe_encoding"]
    for docs in (odd, empty, odd.withColumn("n_chars", F.lit(None).cast(T.LongType()))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.collect()


#: Names that the stages give columns of their own.
OWN_NAMES = [
    "_c", "_lang", "_source", "_kept", "_base_failed", "_r_symbols", "_f_symbols", "_th", "_bad_doc_id", "_row", "_id", "_t", "_n", "_r", "_nth",
    "_runs", "_left", "_size", "_copies", "_words", "_each", "_dealt", "key", "first", "root", "bucket", "node", "n_rows", "target", "taken",
]


def test_stages_leave_columns_of_any_name_alone(spark):
    import corpus_pipeline

    text = lambda i: ". ".join(" ".join(prose(9 * i + s, 14, 10**6)) for s in range(6)) + "."
    rows = [(i % 38, text(i % 36), "en" if i % 3 else None, f"s{i % 2}", 1) for i in range(40)]
    plain = spark.createDataFrame(rows, DOCS)
    extra = plain.withColumns({name: F.concat(F.lit(f"{name} of "), "doc_id") for name in OWN_NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, "")
        assert out.columns == extra.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c} of {r['doc_id']}" for r in got for c in OWN_NAMES), name
        want = stage(spark, plain, "").collect()
        assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(repr(tuple(r)) for r in want), name
    assert corpus_pipeline.bpe_encoding(spark, extra, "").count() == 40


def test_pipeline_stages_on_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    verdicts = adaptive_rules.verdicts(adaptive_rules.metrics_of(docs)).where("kept")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in verdicts.select("doc_id").collect())
    rows = sorted(map(tuple, kept.select("doc_id", "text").collect()))
    groups = brute_groups(rows, 5)[1]
    near = corpus_pipeline.near_dedup(spark, kept, sf_dir)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({rows[g][0] for g in groups})
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and final.count() > 0


def test_spans_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = list(map(tuple, docs.select("doc_id", "text").collect()))
    got = {r["doc_id"]: r["text"] or "" for r in sentence_spans.dedup_texts(docs).collect()}
    want = brute_spans(rows)
    assert {d: t.split() for d, t in got.items()} == {d: t.split() for d, t in want.items()}
    assert any(want[d] != t for d, t in rows if t)


def test_pipeline_rows_on_documents(spark, sf_dir):
    """Stages 3 to 5 in plain Python, from the rows of stage 2 (held against brute force above) to those of run()."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, docs, sf_dir), sf_dir)
    rows = [tuple(r) for r in near.select("doc_id", "text", "source").collect()]
    assert len({d for d, *_ in rows}) == len(rows) > 0
    left = brute_spans(rows)
    rows = [(d, left[d], s) for d, t, s in rows if left[d] == t or left[d].encode().split()]
    copies, library, want = brute_mix(rows), Tokenizer.from_file(word_bpe_file()), []
    for d, text, _ in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        digests = [np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()]
        want += [(d, len(ids), *(hashlib.sha256(x).hexdigest() for x in digests))] * copies[d]
    assert 0 < len(want) and 2 in copies.values() and 0 in copies.values()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)
