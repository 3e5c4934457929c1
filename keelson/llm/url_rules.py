"""URL allow and block rules as a sort-merge range join over canonical keys.

A rule is a host and a path prefix; it fits its host and every subdomain. The canonical key
of a URL under one of its host suffixes is (labels of the suffix in reverse, path bytes): a
rule is then the interval from its own key up to its path followed by byte 0xFF, which is
above every UTF-8 byte. Intervals of rules under one host are nested or disjoint, so the
rules that hold at a key form a stack. The sweep sorts interval borders and URL keys
together and carries the top of that stack: an opening border pushes its rule, a closing one
puts the enclosing rule back, which is known beforehand.

Distinct (host, path) pairs are swept, only under suffixes that some rule names, and a host
with many of them is dealt into several sweeps that each see all rules of that host.

NULL urls, and urls without ``://``, have an empty host and path. A rule with a NULL host,
path or verdict is no rule; of two rules with the same host and path, block wins. Of the
rules that fit, the one with the longest host + path wins, then the longer host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import lower_ascii, table

KEYS_PER_SWEEP = 20_000
CLOSE, OPEN, KEY = 0, 1, 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased for A-Z, and path of a URL; both empty when it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules written as (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _borders(rules: DataFrame) -> DataFrame:
    """Two rows per rule: where it opens, and where its enclosing rule is on top again."""
    known = (
        rules.select("verdict", lower_ascii(F.col("host")).alias("host"), "path")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            _reversed_labels(F.col("host")).alias("suffix"),
            "path",
            F.struct(
                (F.length("host") + F.length("path")).alias("size"),
                F.length("host").alias("host_size"),
                F.concat("host", "path").alias("rule"),
                "verdict",
            ).alias("top"),
        )
    )
    shorter = known.select(
        "suffix",
        "path",
        F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("prefix"),
    ).filter("prefix != path")
    parents = (
        shorter.join(known.select("suffix", F.col("path").alias("prefix"), "top"), ["suffix", "prefix"])
        .groupBy("suffix", "path")
        .agg(F.max_by("top", F.length("prefix")).alias("parent"))
    )
    nothing = F.struct(
        F.lit(0).alias("size"),
        F.lit(0).alias("host_size"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    both = known.join(parents, ["suffix", "path"], "left").select(
        "suffix",
        F.explode(
            F.array(
                F.struct(F.encode("path", "UTF-8").alias("key"), F.lit(OPEN).alias("kind"), F.col("top").alias("top")),
                F.struct(
                    F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("FF"))).alias("key"),
                    F.lit(CLOSE).alias("kind"),
                    F.coalesce("parent", nothing).alias("top"),
                ),
            )
        ).alias("e"),
    )
    return both.select("suffix", "e.*")


def match_rules(keys: DataFrame, rules: DataFrame, keys_per_sweep: int = KEYS_PER_SWEEP) -> DataFrame:
    """``host, path, rule, rule_verdict`` for the distinct (host, path) of ``keys`` that a rule fits."""
    borders = _borders(rules)
    hosts = borders.select("suffix").distinct()
    suffixes = F.expr("transform(sequence(1, size(labels)), n -> slice(labels, 1, n))")
    under = (
        keys.select("host", "path")
        .distinct()
        .withColumn("labels", _reversed_labels(F.col("host")))
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(hosts, "suffix")
    )
    sweeps = under.groupBy("suffix").agg(F.ceil(F.count(F.lit(1)) / keys_per_sweep).cast("int").alias("sweeps"))
    dealt = under.join(sweeps, "suffix").select(
        "suffix",
        F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int").alias("sweep"),
        F.encode("path", "UTF-8").alias("key"),
        F.lit(KEY).alias("kind"),
        F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>").alias("top"),
        "host",
        "path",
    )
    repeated = borders.join(sweeps, "suffix").select(
        "suffix",
        F.explode(F.expr("sequence(0, sweeps - 1)")).alias("sweep"),
        "key",
        "kind",
        "top",
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
    )
    sweep = Window.partitionBy("suffix", "sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # an exchange of its own: the rows come dealt by suffix, which would leave all sweeps of a host in one task
    swept = (
        dealt.union(repeated)
        .repartition("suffix", "sweep")
        .withColumn("top", F.last("top", ignorenulls=True).over(sweep))
        .filter((F.col("kind") == KEY) & F.col("top.rule").isNotNull())
    )
    best = swept.groupBy("host", "path").agg(F.max("top").alias("top"))
    return best.select("host", "path", "top.rule", F.col("top.verdict").alias("rule_verdict"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: list[str] = ("page_id",),
    default: str = "allow",
    keys_per_sweep: int = KEYS_PER_SWEEP,
) -> DataFrame:
    """One row per row of ``pages``: the columns of ``keep``, host, path, rule and verdict.

    ``default`` is the verdict where no rule fits; the rule is NULL there.
    """
    kept = {c: f"__{i}" for i, c in enumerate(keep)}
    host, path = url_parts(F.col(url))
    parts = pages.select(
        *[F.col(c).alias(k) for c, k in kept.items()],
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
    )
    found = match_rules(parts, rules, keys_per_sweep)
    return parts.join(found, ["host", "path"], "left").select(
        *[F.col(k).alias(c) for c, k in kept.items()],
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
    )


RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h),
fit AS (SELECT p.page_id, p.host, p.path, rules.host || rules.path AS rule, rules.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(rules.host || rules.path) DESC) AS rn
  FROM p JOIN rules ON (p.host = rules.host OR p.host LIKE '%.' || rules.host) AND starts_with(p.path, rules.path))
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit ON fit.rn = 1 AND fit.page_id = p.page_id AND fit.host = p.host AND fit.path = p.path
"""


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), rule_table(spark, RULES))
