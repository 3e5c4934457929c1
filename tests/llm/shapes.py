"""Rows with every awkward shape: NULLs, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

# names that the operators use inside
CLASH = ["id", "of", "h", "n", "file", "range", "cell", "shard", "fp", "host", "path", "top", "label", "score", "rank"]
LONG = "lorem ipsum dolor " * 9_000 + "end\n\n  of\tit "
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "é́ ünï 中文 \U0001f600 <turn> \\ mixed TEXT"),
    (None, "no id here but some words anyway"),
    (7, "x"),
    (7, "y z"),
    (2**40, "far id"),
]


def documents(spark, rows=TEXTS, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(9) for c in CLASH}) if clash else df


def none_of(df):
    return df.filter("false")
