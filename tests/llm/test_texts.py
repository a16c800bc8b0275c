"""Token counts, BPE, substring removal and SimHash against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from wearline.llm import simhash, substring_dedup
from wearline.llm.bpe_codec import ChunkCodec
from wearline.llm.components import components
from wearline.llm.queries import PIECE_MODEL, QUERIES, WORD_MODEL, tokenizer_path
from wearline.llm.token_counts import PieceMerger

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(seed, n, extra=()):
    rng = random.Random(seed)
    alphabet = list("aabbcde   \n\t▁éß中文😀1234.,!<>s/ñ\x00\r'Å\x85\xa0\x1c") + ["the ", "tion", "́", *extra]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 60, 1500]))) for _ in range(n)]
    return texts + ["", " ", "  ", "a" * 5000, " " * 5000, "ab" * 3000 + " x" + "-=" * 2000, "Word. " * 300]


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path(PIECE_MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = random_texts(1, 1500)
    assert PieceMerger(path).count_texts(texts) == [len(x) for x in lib.encode(texts)]
    docs = documents(spark)
    for r in QUERIES["op7_token_counts"](spark, SF).collect():
        n = len(lib.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len(docs[r.doc_id].encode()))


def test_bpe_round_trip_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_MODEL)
    lib, own = Tokenizer.from_file(path), ChunkCodec(path)
    lib.no_truncation()
    lib.no_padding()
    texts = random_texts(2, 1500, ("<|endoftext|>", "<|ENDOFTEXT|>", "Σ ", "İ", "K", "a.b", "x,", "'re"))
    for text, got in zip(texts, own.encode(texts)):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert own.decode(got).decode() == lib.decode(ids, skip_special_tokens=False)
    docs = documents(spark)
    for r in QUERIES["op10_bpe_codec"](spark, SF).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_capitals_without_a_composed_form():
    own = ChunkCodec(tokenizer_path(WORD_MODEL))
    pairs = ["J\u030c", "T\u0308", "W\u030a", "Y\u030a", "H\u0331"]
    for text in [*pairs, *pairs, "Za" + " ".join(pairs) + ". The END, Of it.", " ".join(["Word AND, word."] * 200 + pairs) * 3]:
        ids = own.lib.encode(text, add_special_tokens=False).ids
        got = own.encode([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert own.decode(got).decode() == own.lib.decode(ids, skip_special_tokens=False)


def test_chunks_are_shared():
    own = ChunkCodec(tokenizer_path(WORD_MODEL))
    rng = random.Random(3)
    body = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    a, b = set(own.chunked("first words " + body)), set(own.chunked("another, longer beginning " + body))
    assert "".join(own.chunked(body)) == body and len(a & b) > 0.8 * len(a)


def test_kept_chunks_give_the_same_ids(monkeypatch):
    """Chunks met before, in other texts and calls, are reused; a small cache only forgets."""
    from wearline.llm import bpe_codec
    lib = ChunkCodec(tokenizer_path(WORD_MODEL)).lib
    rng = random.Random(5)
    shared = " ".join("".join(rng.choices("abcdefgh,.", k=rng.randint(1, 9))) for _ in range(900))
    texts = [f"Text {i} begins. {shared[rng.randint(0, 40):]}\nand ends {i}" for i in range(12)]
    for limit in (24 << 20, 3000):
        monkeypatch.setattr(bpe_codec, "CACHE_BYTES", limit)
        own = ChunkCodec(tokenizer_path(WORD_MODEL))
        for t in texts:
            assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert own.reused > (0.5 * own.met if limit > 3000 else 0) and own.held <= limit


def test_joins_without_blanks_near_them():
    """Words longer than several chunks: one join spans them all."""
    own = ChunkCodec(tokenizer_path(WORD_MODEL))
    rng = random.Random(6)
    for text in ("".join(rng.choices("abcdefghij\u0301.,", k=9000)), "a " + "".join(rng.choices("xyz", k=5000)) + " b " + "q" * 3000,
                 "".join(rng.choices(["a", "b", "cd", " "], weights=[40, 30, 20, 1], k=4000))):
        assert len(own.chunked(text)) > 1
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == own.lib.encode(text, add_special_tokens=False).ids


def test_a_window_grows_until_it_agrees():
    from wearline.llm.bpe_codec import Join
    own = ChunkCodec(tokenizer_path(WORD_MODEL))
    join = Join(["one two three fo", "ur five six seven"], 1)
    ids = lambda t: np.array(own.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert join.window() == "three four five"
    join.settle(ids("tree four five"), own)  # other ids on the left than the chunk has
    assert join.ids is None and join.window() == "two three four five six"
    join.settle(ids(join.window()), own)
    assert join.ids == ids("four")
    for _ in range(3):
        if not join.all:
            join.grow()
    with pytest.raises(ValueError):
        join.settle(b"", own)


def repeated_removed(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [3, 12, 25, 35])
def test_substring_removal(spark, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", (256, 64 << 20))
    rng = random.Random(window)
    passages = [[rng.choice("abcdefghij") for _ in range(rng.randint(window - 2, window + 40))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 20))]
            p = rng.choice(passages)
            parts += p[rng.randint(0, 3):]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += texts[:5] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == repeated_removed(texts, window)


def test_chunks_meet_their_answers_one_at_a_time(spark, monkeypatch):
    """No list of answers is gathered for a partition of chunks, and only what is read twice is stored."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", (256, 64 << 20))
    store, kept = substring_dedup.stored, []
    monkeypatch.setattr(substring_dedup, "stored", lambda df: kept.append(store(df)) or kept[-1])
    passage = " ".join(f"w{i}" for i in range(40))
    texts = [f"{i} {passage} {' '.join(f'v{i}x{j}' for j in range(60))}" for i in range(30)] + [None, "few words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = substring_dedup.remove_repeats(df)
    assert [x.columns[0] for x in kept] == ["chunk_id"] * 2 and kept[1].count() > kept[0].count() > 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ObjectHashAggregate" not in plan
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()} == \
        dict(enumerate(repeated_removed(texts, 35)))


def brute_groups(fps, max_bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_query(spark):
    docs = documents(spark)

    def slow(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = QUERIES["op6_simhash"](spark, SF).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert fp == {i: slow(t) for i, t in docs.items()}
    root = brute_groups(list(fp.values()), 2)
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {r.doc_id: r.component_id for r in rows} == {i: least[root[f]] for i, f in fp.items()}


@pytest.mark.parametrize("bits,block", [(2, 1024), (2, 8), (3, 16), (0, 8)])
def test_simhash_links_find_every_group(spark, monkeypatch, bits, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(bits + block)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for f in list(fps[:60]):
        for _ in range(rng.choice([1, 3, 12])):
            g = f
            for b in rng.sample(range(64), rng.randint(1, bits + 1)):
                g ^= 1 << b
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(simhash.links(df, bits)).collect()}
    got = {}
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f % (1 << 64))
    want = {}
    for f, r in brute_groups([f % (1 << 64) for f in signed], bits).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q r s t u v w", "z"), (None, None, "n"), (None, "", "m")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "None"]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7), (100, 95)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
