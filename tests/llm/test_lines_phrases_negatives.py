"""Line deduplication, phrases and hard negatives against plain forms."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import hard_negatives, line_dedup, phrases
from tests.llm.shapes import TEXTS, documents, none_of

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# lines


def plain_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(ASCII)
    order = lambda d: (d is None, d or 0)
    docs = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                docs[key(line)].add(d)
    first = {k: min(ds, key=order) for k, ds in docs.items() if len(ds) > 1}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(5)
    hot, some = "a line that stands almost everywhere", [f"repeated line number {k}" for k in range(20)]
    rows = [(d, "\n".join(rng.choices([hot, hot.upper() + " \t", *some, f"only here {d}", "short", "", "é" * 10], k=rng.randint(1, 9)))) for d in range(1, 300)]
    return rows + TEXTS + [(None, hot), (None, "only without id"), (7, hot), (300, "\r\n" + hot + "\r"), (300, "\r\n" + hot + "\r")]


@pytest.mark.parametrize("parts", ["1", "40"])
def test_lines_over_many_ranges(spark, parts):
    rows, before = line_rows(), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in line_dedup.digests(documents(spark, rows)).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_lines(rows)


def test_lines_by_bitmap(spark):
    rows = [(1, "same line here\nown line of one\nsame line here"), (2, "x\nsame line here\ny"), (3, None)]
    bits = {r.doc_id: r for r in line_dedup.line_bitmaps(documents(spark, rows)).collect()}
    assert {d: line_dedup.kept(r.keep, r.n_lines).tolist() for d, r in bits.items()} == {1: [True] * 3, 2: [True, False, True], 3: [True]}
    assert {tuple(r) for r in line_dedup.without_repeats(documents(spark, rows)).collect()} == {(1, rows[0][1]), (2, "x\ny"), (3, "")}
    assert line_dedup.digests(none_of(documents(spark, rows))).collect() == []


def test_a_key_over_several_ranges():
    one = lambda part, a, b, doc: {"part": part, "hi": a, "lo": 0, "last_hi": b, "last_lo": 0, "last_doc": doc}
    assert line_dedup._carried([one(3, 5, 9, 8), one(0, 1, 5, 2), one(2, 5, 5, 6), one(1, 5, 5, 4), one(7, 9, 9, 9)]) == [(1, 2), (2, 2), (3, 2), (7, 8)]


# phrases


def plain_phrases(rows, limit, least):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if a >= least}
        inside = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and c[p[i:j]] <= a}
        rows = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                score, _, head, tail = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, p[:k], p[k:]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[head], c[tail]))
        for rank, (s, a, p, head, tail) in enumerate(sorted(rows)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, head, tail, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    fixed = ["New York city hall", "alpha beta gamma delta epsilon zeta", "w1 rare1 w2", "été 中文 \U0001f600"]
    rows = []
    for k in range(400):
        parts = rng.choices(words, weights, k=rng.randint(0, 30))
        for f in rng.sample(fixed, 2):
            parts.insert(rng.randint(0, len(parts)), f)
        text = "".join(p + rng.choice([" ", " ", " ", "  ", ", ", "\n", "\t"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "fr", None]), text))
    return rows + [("en", None), ("de", ""), ("en", "w1 " * 5000), ("fr", "... ,,")]


@pytest.mark.parametrize("limit,first", [(2000, 8), (12, 1)])
def test_phrases(spark, limit, first, monkeypatch):
    monkeypatch.setattr(phrases, "GROWTH", 2)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(7) for c in ("phrase", "size", "n", "score", "words")})
    got = phrases.mine_phrases(df, limit=limit, least=15, first_wave=first)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, limit, 15)


def test_wave_reads_the_parts_once_for_all_sizes(spark, monkeypatch):
    """Phrases of all sizes are counted together: a pass for every size read and split all parts again."""
    counted, sizes = phrases._phrase_counts, []
    monkeypatch.setattr(phrases, "_phrase_counts", lambda parts, wanted, *rest: (sizes.append([k for k, _ in wanted]), counted(parts, wanted, *rest))[1])
    rows = phrase_rows()
    got = phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), least=15)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 2000, 15)
    assert sizes == [[2, 3, 4, 5], [2, 3, 4]]  # a wave, and its rests


def test_most_frequent_words_are_not_grown_for_a_few_phrases(spark, monkeypatch):
    """A language short of a few phrases after its first wave grew all its words, and made rows of most of its text."""
    scored, grown = phrases._scored, set()
    monkeypatch.setattr(phrases, "_scored", lambda rows, *rest: (grown.update(r.phrase for r in rows.collect()), scored(rows, *rest))[1])
    texts = [f"a{k} b{k}." for k in range(30)] * 20 + [f"d{k} e{k}." for k in range(3)] * 30 + [f"the c{k}." for k in range(10)] * 60
    rows = [("en", text) for text in texts]
    got = phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), limit=32, least=15, first_wave=1)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 32, 15)
    assert len(grown) == 33 and not any(p.startswith("the ") for p in grown)


def test_gaps_between_counts_do_not_end_the_search(spark):
    rows = [("en", text) for text in ["a b."] * 20 + ["c d."] * 500 + ["e f."] * 9000]
    got = phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), limit=3, least=15, first_wave=0)
    assert [r.phrase for r in sorted(got.collect(), key=lambda r: r.rank)] == ["a b", "c d", "e f"]


def test_parts_of_a_task_share_their_rows():
    """A phrase made a row for each part of a task that has it."""
    held = phrases._Held()
    one = np.ones(2, np.int64)
    held.add("en", [b".", b"a", b"b", b"c"], np.array([[1, 2], [2, 3]], np.int32), one, 5 * one, np.array([7, 0]))
    held.add("en", [b".", b"c", b"b", b"a"], np.array([[2, 1], [3, 2]], np.int32), 2 * one, np.array([5, 6]), np.array([7, 7]))
    held.add("fr", [b".", b"a", b"b"], np.array([[1, 2]], np.int32), one[:1], one[:1], one[:1])
    got = [tuple(r.values()) for batch in held.combined() for r in batch.to_pylist()]
    # the neighbours differ where one is 0
    assert sorted(got) == [("en", 2, "a b", 3, 0, 7), ("en", 2, "b c", 3, 5, 0), ("fr", 2, "a b", 1, 1, 1)]


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine_phrases(none).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([("en", None), (None, "one two")], none.schema)).collect() == []


def test_full_filter_costs_rows_only(spark, monkeypatch):
    every = phrases.Filter(np.full(2 ** (phrases.FILTER_BITS - 6), 2**64 - 1, np.uint64))
    monkeypatch.setattr(phrases, "filter_of", lambda rows: every)
    rows = phrase_rows()
    got = phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), limit=20, least=15, first_wave=1)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 20, 15)


def test_wide_products(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):  # a phrase, its two parts and all words, up to 10**15 of them
        a, l, r, n = sorted(rng.randint(1, 10 ** rng.randint(1, 15)) for _ in range(4))
        rows.append((a, n, l, r))
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("*", phrases.scaled(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert len(got) == 300 and all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)


# hard negatives


def plain_negatives(rows):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and fine(v)]
    out = []
    for a, label, v in rows:
        if a % 100:
            continue
        others = [(-sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in rows if b != a and len(w) == len(v)]
        for p, positive, _ in sorted(o for o in others if o[2] == label)[:5]:
            good = sorted(o for o in others if o[2] != label and -30 * p <= -100 * o[0] <= -90 * p)[:10]
            out += [(a, positive, rank, b, -p, -s) for rank, (s, b, _) in enumerate(good, 1)]
    return sorted(out)


def vector_rows(big=False):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 16))
    rows = []
    for i in range(700):
        label = int(rng.integers(4))
        rows.append((i, label, (centres[label] + rng.standard_normal(16)).tolist()))
    same = rows[11][2]
    rows += [(1000 + i, i % 3, same) for i in range(400)]  # one vector of many rows
    rows += [(300, 2, [1.0, float("nan")]), (400, None, same), (None, 1, same), (500, 1, None), (700, 1, [None, 1.0]), (2000, 1, [float("inf")] * 16)]
    rows += [(2100, 1, []), (2101, 1, []), (2102, 2, []), (2200, 1, [0.0] * 16), (2300, 1, [0.5, 1.5, 2.5]), (2301, 1, [1.0, 1.0, 1.0]), (2302, 3, [0.5, 1.0, 0.5])]
    rows += [rows[100], rows[100], rows[7]]  # repeated rows, an anchor among them
    if big:
        rows += [(9000 + i, i % 3, [float(rng.standard_normal()) * 1e12 for _ in range(16)]) for i in range(12)]
    return rows


@pytest.mark.parametrize("block", [32 * 2**20, 2_000])
@pytest.mark.parametrize("big", [False, True])
def test_negatives(spark, block, big):
    rows = vector_rows(big)
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumns({c: F.lit(1) for c in ("number", "score", "code", "rank")})
    got = hard_negatives.mine(df.repartition(5), df.filter("vec_id % 100 = 0"), anchor_bytes=block).collect()
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert sorted(tuple(r) for r in got) == sorted((*r[:4], clip(r[4]), clip(r[5])) for r in plain_negatives(rows))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, vector array<float>")
    assert hard_negatives.mine(df, df).collect() == []


@pytest.mark.parametrize("dim", [1, 7, 64, 130])
def test_intervals_hold_every_product(dim):
    rng = np.random.default_rng(dim)
    rows = np.floor(256 * rng.standard_normal((400, dim)) * rng.choice([0.01, 1, 50], (400, 1)))
    rows[:3] = 0
    rows[3:6] = rows[7]
    asked = hard_negatives.Asked(np.arange(20), np.arange(20), np.zeros(20), rows[:20])
    low, high = hard_negatives.intervals(asked, slice(0, 20), *hard_negatives.code(rows))
    exact = rows[:20] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < (np.linalg.norm(rows[:20], axis=1)[:, None] * np.linalg.norm(rows, axis=1) * 2).mean()
