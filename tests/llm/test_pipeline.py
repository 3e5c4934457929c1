"""Every stage on rows with planted cases, and the whole run."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from keelson.llm import near_dups
from tests.llm.shapes import documents, none_of
from tests.llm.test_search_native import plain_base
from tests.llm.test_text_models import plain_fingerprint
from tests.llm.test_tokens_and_chat import check_packed

SF = "/root/testdata/sf0.001"


def planted(spark):
    """Prose with toxic rows, copies, a benchmark item and secrets; ids tell which is which."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha ke li mo nu".split() for b in "ran tel min sor vup".split()]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, prose(60)) for k in range(200)]
    rows += [(1000 + k, prose(20) + " horridslur nastyword " + prose(20)) for k in range(80)]
    rows += [(2000 + k, rows[k][1]) for k in range(30)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows += [(3000, prose(50) + "\n" + item + "\n" + prose(50))]
    rows += [(4000, prose(30) + " password=abcdef0123456789x " + prose(30))]
    rows += [(5000, None), (5001, ""), (None, prose(40)), (6000, rows[150][1]), (6000, rows[150][1])]
    return documents(spark, rows), rows


def labelled(spark, tmp_path):
    folder = str(tmp_path)
    labels = [(k, 1, 0) for k in range(200)] + [(1000 + k, 1, 1) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tmp_path):
    docs, rows = planted(spark)
    folder, columns = labelled(spark, tmp_path), pipeline.DOCUMENT
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    clean = pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == columns
    assert ids(docs) - ids(clean) == set(range(1000, 1080))

    once = pipeline.drop_near_duplicates(spark, docs, folder)
    assert once.columns == columns
    groups = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert all(groups[2000 + k] == groups[k] for k in range(30)) and groups[6000] == groups[150]
    want = {k for k, g in groups.items() if k == g} | {None}
    assert ids(once) == want and once.count() == len(want)
    assert plain_fingerprint(rows[0][1]) == plain_fingerprint(rows[280][1])

    no_items = pipeline.drop_benchmark_items(spark, docs, folder)
    assert ids(docs) - ids(no_items) == {3000} and no_items.count() == docs.count() - 1

    masked = {r.doc_id: r for r in pipeline.mask_secrets(spark, docs, folder).collect()}
    assert not plain_base(masked[4000].text) and "[SECRET]" in masked[4000].text
    assert masked[4000].n_chars == len(masked[4000].text) and masked[5000].text is None
    assert all(masked[k].text == t for k, t in rows if k not in (4000,))

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows]
    assert check_packed(pipeline.pack(spark, docs, folder).collect(), want, 1024) < 1024


def test_run_and_empty_table(spark, tmp_path):
    docs, _ = planted(spark)
    folder = labelled(spark, tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in pipeline.run(spark, folder).collect()}
    assert not kept & {*range(1000, 1080), *range(2000, 2030), 3000} and {*range(200), 4000} <= kept
    for _, stage in pipeline.STAGES:
        assert stage(spark, none_of(docs), folder).count() == 0


def test_stage_names_and_columns():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark", "secrets", "packing"]
