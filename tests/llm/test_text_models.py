"""Language model, toxicity, fingerprints and near duplicates against plain forms."""

import hashlib
import itertools
import math
import random
import tracemalloc
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keelson.llm import near_dups, pitman_yor, syncmers, toxicity
from tests.llm.shapes import TEXTS, documents, none_of

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held_out(key, mod=10):
    return key is None or zlib.crc32(str(key).encode()) % mod == 0


def plain_base(rows):
    tokens = [(key, [*SPLIT.findall(lower(text)), None]) for key, text in rows]
    counts = Counter(t for key, ts in tokens if not held_out(key) for t in ts)
    n, v = sum(counts.values()), len(counts)
    return n, [
        (key, len(ts), sum(t in counts for t in ts), sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        for key, ts in tokens
    ]


@pytest.mark.parametrize("cells", [1, 5])
def test_pair_model(spark, cells, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + TEXTS
    df = documents(spark, rows)
    chars = sum(len(t or "") for _, t in rows)
    monkeypatch.setattr(pitman_yor, "CHARS_PER_CELL", -(-chars // cells))
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 20_000)
    train = ~(pitman_yor.id_remainder(F.col("doc_id"), 10, 0) == 0)
    got = pitman_yor.score_texts(df, train).collect()
    n, want = plain_base(rows)
    assert {r.train_tokens for r in got} == {n}
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    assert [r[:3] for r in mine] == [r[:3] for r in sorted(want, key=key)]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(mine, sorted(want, key=key)))
    assert all(r.score < 0 for r in got)
    out = [r for r in got if held_out(r.doc_id)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_pair_model_sums_to_one(spark):
    """After a context, all known words and one unknown word share the whole probability."""
    vocabulary = "a b c d".split()
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choices(vocabulary, [8, 4, 2, 1], k=12))) for k in range(60)]
    # a text of two words differs from its first word's text by p(second | first) * p(end | second) / p(end | first)
    probes = [(1000 + i, f"{a} {b}") for i, (a, b) in enumerate(itertools.product(vocabulary, [*vocabulary, "?"]))]
    singles = [(2000 + i, a) for i, a in enumerate([*vocabulary, "?"])]
    df = documents(spark, texts + probes + singles)
    scores = {r.doc_id: r.score for r in pitman_yor.score_texts(df, F.col("doc_id") < 1000).collect()}
    two = {text: scores[k] for k, text in probes}
    one = {text: scores[k] for k, text in singles}
    first = {a: 10 ** one[a] for a in one}  # p(a | start) * p(end | a)
    for a in vocabulary:
        # p(end | a) from p(b | a) summing to one with it: solve sum_b p(b|a) + p(end|a) = 1
        ratios = {b: 10 ** two[f"{a} {b}"] for b in [*vocabulary, "?"]}
        start_a = None
        for guess in np.linspace(1e-4, 0.999, 4000):
            start = first[a] / guess  # p(a | start) if p(end | a) were guess
            if start <= 1:
                start_a = (guess, start)
                break
        assert start_a and all(v < first[a] / start_a[0] for v in ratios.values())


def test_seats_keep_their_counts():
    rng = np.random.default_rng(0)
    c = np.array([2, 3, 5, 300, 9000, 2, 40])
    seats = pitman_yor.Seats(c, np.full(7, 0.8), 0.7, rng)
    for _ in range(4):
        seats.sweep()
        t = seats.tables()
        assert ((t >= 1) & (t <= c)).all()
        for k in range(seats.many, len(c)):
            lo = seats.off[k - seats.many]
            sizes = seats.sizes[lo : lo + seats.c[k]]
            assert sizes.sum() == seats.c[k] and (sizes > 0).sum() == seats.t[k]
            used = np.bincount(seats.table[lo : lo + seats.c[k]], minlength=len(sizes))
            assert (used == sizes).all()


def test_seating_of_two_customers_has_the_right_share():
    """Two customers of a dish: one table or two, in proportion 1 - d to the weight of a new one."""
    n, new, d = 20_000, 0.6, 0.7
    seats = pitman_yor.Seats(np.full(n, 2), np.full(n, new), d, np.random.default_rng(5))
    for _ in range(5):
        seats.sweep()
    assert abs((seats.tables() == 2).mean() - new / (new + 1 - d)) < 0.02


def test_packed_arrays():
    arrays = [np.array([], np.int64), np.array([5, 5, 2**63], np.uint64), np.array([9, 1, 300]), np.array([0.5, -1.0])]
    back = pitman_yor.unpack(pitman_yor.pack(*arrays))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back))


def test_pair_model_without_rows(spark):
    df = documents(spark)
    assert pitman_yor.score_texts(none_of(df), F.lit(True)).count() == 0
    rows = pitman_yor.score_texts(df, F.lit(False)).collect()
    assert len(rows) == len(TEXTS) and {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.id_remainder(F.col("doc_id"), 3, 1) == 1
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~out)))
    rows = scored.filter(out).join(labels, "doc_id").select("score", "toxic").collect()
    hit = sum((r.score >= 0.7) == (r.toxic == 1) for r in rows)
    assert hit >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_shapes(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, None, 0), (1, 1, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels)).count() == len(TEXTS)
    nothing = toxicity.fit(df, none_of(labels))
    assert {r.score for r in toxicity.score(df, nothing).collect()} == {0.5}
    assert toxicity.below(df, nothing).columns == df.columns and toxicity.below(df, nothing).count() == len(TEXTS)
    assert toxicity.score(none_of(df), nothing).count() == 0


def plain_syncmers(text, k, s):
    points = [ord(c) for c in text]
    inner = syncmers._windows(np.array(points, np.uint32), s)
    width = k - s + 1
    return [i for i in range(len(points) - k + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]


def test_syncmers_are_context_free():
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    before, after = "".join(rng.choices("xyz ", k=77)), "".join(rng.choices("xyz ", k=50))
    assert plain_syncmers(passage, 16, 9) == syncmers.anchors(syncmers.code_points(passage))[0].tolist()
    alone = dict(zip(*[x.tolist() for x in syncmers.anchors(syncmers.code_points(passage))]))
    placed = dict(zip(*[x.tolist() for x in syncmers.anchors(syncmers.code_points(before + passage + after))]))
    assert {p + 77: h for p, h in alone.items()}.items() <= placed.items()


@pytest.mark.parametrize("rows_per_range", [3, 10_000])
def test_fingerprints_of_edits(spark, rows_per_range):
    rows = TEXTS + [(100 + k, f"document {k} " + "some words here " * k) for k in range(20)]
    got = syncmers.fingerprint_edits(documents(spark, rows), rows_per_range=rows_per_range).collect()
    ordered = sorted(((key, text or "") for key, text in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (key, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        sketch = lambda t: syncmers.as_text(syncmers.sketch(syncmers.code_points(t)))
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch(text), sketch(edited)))
    order = lambda r: repr(r)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.fingerprint_edits(none_of(documents(spark))).count() == 0


def plain_fingerprint(text):
    words = SPLIT.findall(lower(text))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


@pytest.mark.parametrize("per_shard", [60, 10**6])
def test_near_duplicates(spark, per_shard, monkeypatch):
    monkeypatch.setattr(near_dups, "LEAF", 8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*rows, *[(None if k is None else k + 10**6, t) for k, t in TEXTS]]
    rng = random.Random(4)
    for k in range(120):  # chains of small changes
        words = (rows[k % 5][1] or "").split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "zz"
        rows.append((2 * 10**6 + k, " ".join(words)))
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    want = sorted(((k, f"{prints[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)
    got = near_dups.near_duplicates(documents(spark, rows), per_shard=per_shard).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert near_dups.near_duplicates(none_of(documents(spark))).count() == 0


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.root for r in near_dups.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


def test_cell_is_merged_in_little_memory():
    """Columns are copied one at a time: all at once took 90 bytes for every pair of a block."""
    n, rng, blobs = 100_000, np.random.default_rng(2), []
    for block in range(4):
        context, word = rng.integers(0, 1000, n, np.uint64), rng.integers(0, 2**40, n, np.uint64)
        parts = [(context, word, np.sort(rng.integers(0, 100, n)))]
        blobs += [r["data"] for r in pitman_yor.block_rows(block, list(range(100)), np.array([True] * 100), parts, 1, np.empty(0, np.uint64))]
    tracemalloc.start()
    try:
        cell = pitman_yor.Cell(blobs, keep_documents=True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(cell.pair_of) == len(cell.c) == 4 * n
    assert peak < 70 * 4 * n
