"""Short test items inside long documents: MinHash containment search by size partition.

Item and document differ in size by orders of magnitude, so the Jaccard similarity of their
signatures says nothing. Only the small side is therefore sketched, and the large side is
asked which of the sketched values it contains. Items are partitioned by size (a class per
power of two of distinct shingles); the class sets how many minimum hashes its items keep:
one more than an item of the largest size in the class may miss at the threshold. A
document that contains an item to the threshold must then contain one of its minimum hashes,
so the search loses nothing. What it finds is verified on the shingles' own text.

Words are runs of letters and digits, lower-cased; shingles are five words. A text with
fewer words is one shingle of all of them, so a very short item is found in documents that
have the same words and no others. NULL and empty texts have no shingles and match nothing.
Repeated rows of one id are searched by text; an (id, item) pair is returned once, with its
highest containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import let, table
from keelson.plans.durable import cut

WORDS, THRESHOLD = 5, 0.8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(text: Column, size: int, make) -> Column:
    """``make`` of every run of ``size`` words; of all words where there are fewer."""

    def runs(w: Column) -> Column:
        many = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))),
            lambda x, i: make([x, *[F.get(w, i + j) for j in range(1, size)]]),
        )
        all_of_it = make([F.get(w, F.lit(j)) for j in range(size)])
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, F.array(all_of_it)).otherwise(F.slice(many, 1, 0))

    return let(_words(text), runs)


def _hashes(text: Column, size: int) -> Column:
    return _shingles(text, size, lambda words: F.xxhash64(*words))


def _texts(text: Column, size: int) -> Column:
    return _shingles(text, size, lambda words: F.concat_ws(" ", *words))


def item_sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """``item, h, needed``: minimum hashes of each item, and how many of them must be found."""
    hashed = items.select("item", F.explode(F.array_distinct(_hashes(F.col("text"), size))).alias("h"))
    sizes = hashed.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    may_miss = lambda n: F.floor(n * (1 - threshold) + 1e-9)
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    by_size = sizes.select("item", "n", F.least(F.col("n"), may_miss(largest) + 1).alias("kept"))
    first = Window.partitionBy("item").orderBy("h")
    ranked = hashed.withColumn("at", F.row_number().over(first)).join(by_size, "item").filter("at <= kept")
    return ranked.select("item", "h", F.greatest(F.col("kept") - may_miss(F.col("n")), F.lit(1)).alias("needed"))


def _counted(
    docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, size: int, threshold: float
) -> DataFrame:
    """``doc, item, n_shingles, n_found`` of pairs at or above ``threshold``; doc and item are
    structs (id, of), where ``of`` is xxhash64 of the text."""
    # rows of one item id with different texts are different items
    listed = items.select(F.col(item_id).alias("id"), F.coalesce(item_text, F.lit("")).alias("text")).distinct()
    listed = listed.select(F.struct("id", F.xxhash64("text").alias("of")).alias("item"), "text")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    rows = rows.select(F.struct("id", F.xxhash64("text").alias("of")).alias("doc"), "text")

    sketches = item_sketches(listed, size, threshold)
    asked = rows.select("doc", F.explode(_hashes(F.col("text"), size)).alias("h"))
    hits = asked.join(sketches, "h").groupBy("doc", "item", "h").agg(F.first("needed").alias("needed"))
    candidates = cut(
        hits.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        .filter("n >= needed").select("doc", "item")
    )

    wanted = candidates.select("doc").distinct()
    found_in = rows.join(wanted, "doc", "left_semi").select("doc", F.explode(_texts(F.col("text"), size)).alias("s"))
    item_shingles = listed.select("item", F.array_distinct(_texts(F.col("text"), size)).alias("all"))
    in_item = candidates.join(item_shingles, "item").select(
        "doc", "item", F.size("all").alias("n_shingles"), F.explode("all").alias("s")
    )
    return (
        in_item.join(found_in.distinct(), ["doc", "s"])
        .groupBy("doc", "item", "n_shingles")
        .agg(F.count(F.lit(1)).alias("n_found"))
        .filter(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
    )


def rows_with_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = WORDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """``id, of`` of the documents that contain an item, once; ``of`` tells apart rows of one id, which may be NULL."""
    return _counted(docs, items, doc_id, doc_text, item_id, item_text, size, threshold).select("doc.*").distinct()


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WORDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment`` of pairs at or above ``threshold``.

    Rows with a NULL document or item id take part and are returned with that NULL.
    """
    counted = _counted(docs, items, doc_id, doc_text, item_id, item_text, size, threshold)
    share = F.col("n_found") / F.col("n_shingles")
    best = counted.groupBy(F.col("doc.id").alias(doc_id), F.col("item.id").alias(item_id)).agg(
        F.max(F.struct(share.alias("containment"), "n_shingles", "n_found")).alias("best")
    )
    return best.select(
        doc_id, item_id, F.col("best.n_shingles").cast("long").alias("n_shingles"),
        F.col("best.n_found").cast("long").alias("n_found"), "best.containment",
    )


SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if x <> ''] AS w
  FROM t),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5
    THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found
  FROM s d JOIN s i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment
FROM m JOIN n ON n.id = m.item_id WHERE n_found >= ceil(n * 0.8 - 1e-9)
"""


def op5_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that a document contains, over all documents."""
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
