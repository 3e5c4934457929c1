"""Decisions of the pipeline hit the row they were made on: NULL and repeated ids."""

import random

import corpus_pipeline as pipeline
from keelson.llm import near_dups
from tests.llm.shapes import documents

SF = "/root/testdata/sf0.001"


def prose(rng, n=60):
    return " ".join(rng.choices([f"w{k}" for k in range(500)], k=n))


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_near_duplicates_by_row(spark, tmp_path):
    rng = random.Random(3)
    # long, so that one word more moves at most three bits
    a, b, c, d = (prose(rng, 4000) for _ in range(4))
    for text, more in ((a, a + " one"), (c, c + " more")):
        assert (near_dups.fingerprint(text) ^ near_dups.fingerprint(more)).bit_count() <= 3
    low, high = sorted([a + " one", b])
    rows = [(1, a), (2, low), (2, high), (None, c), (None, c), (None, c + " more"), (None, d), (3, d)]
    # of id 2 only the near copy of 1 goes, whether its text is the lesser one or not
    want = [(1, a), (2, b), (3, d)]
    got = left(pipeline.drop_near_duplicates(spark, documents(spark, rows), str(tmp_path)))
    assert [r for r in got if r[0] is not None] == want
    assert len(got) == 4 and [t for k, t in got if k is None][0] in (c, c + " more")


def test_benchmark_items_by_row(spark, tmp_path):
    rng = random.Random(4)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    dirty = prose(rng) + "\n" + item + "\n" + prose(rng)
    clean, other = prose(rng), prose(rng)
    rows = [(1, clean), (1, dirty), (None, dirty), (None, other), (2, dirty), (3, None), (None, None)]
    got = left(pipeline.drop_benchmark_items(spark, documents(spark, rows), str(tmp_path)))
    assert got == sorted([(1, clean), (None, other), (3, None), (None, None)], key=repr)
