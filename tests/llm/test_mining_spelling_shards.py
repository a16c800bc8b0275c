"""Hard negatives, spelling variants and shards against brute force, and their edge cases."""
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import hard_negatives as hn
from wearline.llm import sharding, spelling_variants
from wearline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 11
VECTORS = "vec_id long, embedding array<double>, label int, node string, q int, dim string, low double"


def mined(rows, positives=5, negatives=3):
    """All rows against all, by the contract."""
    good = [(i, [int(np.floor(256 * x)) for x in v], l) for i, v, l in rows
            if i is not None and v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, l in good:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in good if j != i and len(w) == len(v)]
        for p, pid in sorted((s, j) for s, j, m in scored if m == l)[:positives]:
            hits = sorted((s, j) for s, j, m in scored if m != l and 50 * -p <= 100 * -s <= 95 * -p)[:negatives]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j) in enumerate(hits)]
    return sorted(out)


def run_mining(spark, rows, **more):
    df = spark.createDataFrame([(*r, "n", 1, "d", 0.5) for r in rows], VECTORS)
    got = hn.hard_negatives(df, anchor=F.col("vec_id") % 50 == 0, **more).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


def vectors(n, dims=(20,), seed=3):
    rng = np.random.default_rng(seed)
    centres = {d: rng.normal(size=(4, d)) for d in dims}
    rows = []
    for i in range(n):
        d = dims[i % len(dims)]
        v = (centres[d][rng.integers(4)] * 0.2 + rng.normal(size=d) * 0.2).round(2)
        rows.append((i, v.tolist(), int(rng.integers(3)) if i % 3 else 0))  # one label holds more than a third
    return rows


def test_hard_negatives_brute_force(spark, monkeypatch):
    rows = vectors(420, (20, 7, 1))
    rows += [(1000 + i, rows[20][1], 1) for i in range(30)] + [(1050, rows[20][1], 0)]      # ties in large numbers
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 20, 0), (2150, rows[20][1], None), (None, rows[20][1], 0),
             (2200, [], 0), (2201, [], 0), (2202, [], 1), (2250, [float("inf")] * 20, 0)]
    want = mined(rows)
    assert len(want) > 50
    monkeypatch.setattr(hn, "ROW_SLICE", 16)
    monkeypatch.setattr(hn, "ANCHOR_SLICE", 4)
    monkeypatch.setattr(hn, "ROWS", 64)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    assert run_mining(spark, rows) == want


def test_hard_negatives_large_components(spark):
    rows = [(i, [float(x) * s for x in v], l) for s in (3e6,) for i, v, l in vectors(120, (3,))]
    assert run_mining(spark, rows) == mined(rows)
    assert isinstance(run_mining(spark, [(i, [1e30, 1e30], i % 2) for i in range(3)]), list)  # cut to 64 bits, no failure


def test_hard_negatives_empty(spark):
    assert run_mining(spark, []) == []
    assert run_mining(spark, [(None, None, None)] * 3) == []
    assert run_mining(spark, [(0, [1.0], 0)]) == []


def test_repeated_anchor_gives_its_rows_again(spark):
    rows = vectors(200)
    want = mined(rows + [rows[50]])
    assert run_mining(spark, rows + [rows[50]]) == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 5, 16, 40):
        a, b = (np.floor(256 * rng.normal(size=(30, dim))) for _ in range(2))
        exact = a @ b.T
        last = None
        for s in hn.LEVELS:
            (ma, da), (mb, db) = (hn.level(*hn.summaries(x), dim, s) for x in (a, b))
            centre, spread = ma @ mb.T, da @ db.T
            assert (exact <= centre + spread + 1e-6).all() and (exact >= centre - spread - 1e-6).all()
            if last is not None:
                assert spread.mean() <= last  # finer levels bound closer
            last = spread.mean()


# ---------------------------------------------------------------- 12
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(n):
    out = []
    best = {}
    for w in n:
        close = [v for v in n if v != w and near(v, w)]
        top = min(close, key=lambda v: (-n[v], v)) if close else None
        best[w] = (top if top is not None and n[top] >= 2 * n[w] else None, len(close))
    for w in n:
        root = w
        while best[root][0] is not None:
            root = best[root][0]
        form = best[w][0]
        out.append((w, form, root, n[w], best[w][1], n[form] if form else None))
    return sorted(out, key=str)


def as_rows(df):
    return sorted([tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()], key=str)


@pytest.mark.parametrize("literal", [64, 4, 0])
def test_variants_brute_force(spark, monkeypatch, literal):
    rng = random.Random(literal)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6))) for _ in range(250)}
    n = {w: rng.choice((1, 2, 3, 7, 20, 60)) for w in words}
    long = "".join(rng.choice("ab") for _ in range(300))
    n.update({long: 9, long[:150] + long[151:]: 4, "c" + long[1:]: 2, long + "a": 1})
    monkeypatch.setattr(spelling_variants, "LITERAL", literal)
    got = as_rows(spelling_variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n)


def counted(rows):
    n = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 5:
                n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if c >= 3}


def test_variants_of_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert as_rows(QUERIES["op12_spelling_variants"](spark, SF)) == grouped(n)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(77, "ÉCOLE École école ÀÖØß " * 3)]
    made = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd[-1:], "doc_id long, text string"))
    assert as_rows(spelling_variants.spelling_variants(made)) == grouped(counted(odd))
    assert spelling_variants.spelling_variants(no_docs).collect() == []


def test_a_group_holds_the_alphabet_at_most(spark):
    """A frequent prefix costs a row a letter, however often its words occur."""
    words = [(f"wor{c}s", 3 + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàáâ")] + [("wors", 1)]
    got = {r[0]: r for r in as_rows(spelling_variants.group_variants(spark.createDataFrame(words, "word string, n long")))}
    assert got["wors"][4] == 29 and got["wors"][1] == "worâs" and got["words"][4] == 29


# ---------------------------------------------------------------- 13
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    p = sharding.walked(sharding.forward, x, n, 42)
    assert sorted(p.tolist()) == x.tolist()
    assert (sharding.walked(sharding.backward, p, n, 42) == x).all()
    for row in x[:5].tolist():
        shard, slot = sharding.place(row, n, 40)
        assert sharding.row_at(shard, slot, n, 40) == row and slot * 40 + shard == p[row]


def test_large_numbers_stay_exact():
    n = (1 << 59) + 12345
    rows = [0, 1, n // 3, n - 1]
    for row in rows:
        shard, slot = sharding.place(row, n, 40)
        assert 0 <= slot * 40 + shard < n and sharding.row_at(shard, slot, n, 40) == row


def check_shards(rows, docs, shards=40):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (str(i), 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op13_sharding"](spark, SF).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    other = sharding.shard_rows(docs.repartition(7)).collect()  # files and partitions change nothing
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {r.doc_id: (r.shard, r.slot) for r in other}
    number = {r.doc_id: r.row_no for r in other}
    assert all(sharding.place(number[r.doc_id], len(rows), 40) == (r.shard, r.slot) for r in rows[:20])


def test_shards_edges(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_shards(sharding.shard_rows(odd_docs).collect(), docs)
    assert sharding.shard_rows(no_docs).collect() == []
    same = spark.createDataFrame([(None, None)] * 90, "doc_id long, text string")
    check_shards(sharding.shard_rows(same).collect(), [(None, None)] * 90)


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("x"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4, files_a_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) - {"shard"} <= set(back.columns) and "shard_in" in back.columns
    placed = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs, 4).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == placed


def test_clashing_and_null_columns(spark):
    d = spark.createDataFrame([(None,) * 4] * 3, "doc_id long, text string, row_no string, h string")
    assert sharding.shard_rows(d).count() == 3 and spelling_variants.spelling_variants(d).count() == 0
    assert list(itertools.chain(*hn.hard_negatives(spark.createDataFrame([], VECTORS)).collect())) == []
