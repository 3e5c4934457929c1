"""Collocations: the best-bound phrases of each language, by best-first growth from first words.

A phrase's score is the lowest over its cuts of 1000 * a * n / (l * r). A rest occurs at least as often
as the whole (r >= a), so nothing that begins with the word w scores above 1000 * n / f(w): the
count of the first prefix is an admissible bound. The frontier holds the frequent words that no
phrase has been grown from yet. It is expanded best bound first, in waves over the whole table: a wave grows
its words to two words, and those that stay frequent further, to three and then by two at a time, by their hashes; all that
stay are then counted as phrases in one pass. Then the counts of missing rests are looked up, for phrases that can still matter, and scores are exact.
Once a language has ``limit`` survivors, the last one's score settles how far the frontier must be
expanded: to every word whose bound reaches it, ties included. A wave goes to 8 times the words of the one before, but
not beyond 2 (then 4, 16, ...) times its highest count, since a language that lacks a few survivors would else grow
its most frequent words, with most of its text behind them, for phrases far below the score that it settles on.

Texts are split into words once and kept as numbered words of large parts; the passes read those.
Tasks know what to count by filters of fixed size over hashes (no false negatives), so what is
broadcast doesn't grow with the data; a false positive only costs a row that the exact join on
the phrase itself drops. Counts are combined over the parts of a task before they are rows, so that a task makes a row
for each different phrase and not for each place; a grown phrase is first counted by a hash alone, and only
hashes that are frequent as phrases.

A phrase is inside a longer one that is as frequent just when all its occurrences have the same
neighbour on one side, within the piece. Neighbours are told apart by 64 bits of a hash; all
counts, phrases and scores are exact (38 digits).

NULL and empty texts have no words; a NULL language is ``und``. Repeated rows count repeatedly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import table
from keelson.plans.durable import fresh_path, written

LIMIT, LEAST, WORDS = 2000, 100, 5
FIRST_WAVE, GROWTH, COUNTS = 8, 8, 2
FILTER_BITS = 24
_TEXT, _TOKENS, _VOCABULARY = 2**19, 150_000, 80_000
_RUNS, _PHRASES = 2**20, 2**18  # held by a task until it combines them
_SHAPE = bytes.maketrans(
    b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz"
)
_NEXT, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_UNUSED = np.uint64(24)
COUNTED = "lang string, size int, phrase string, n long, left long, right long"


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """The two bit numbers of each hash, from its upper 40 bits."""
    h = hashes >> _UNUSED
    h = h ^ (h >> np.uint64(19))
    return [(h * factor) >> np.uint64(64 - FILTER_BITS) for factor in (_FIRST, _SECOND)]


class Filter:
    """A set of hashes in a fixed number of bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _bits(hashes):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _filter(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> Filter:
    """The filter of the ``hashes`` of all rows; at most 2**18 rows reach the driver, whatever the table's size."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
        for batch in batches:
            for at in _bits(hashes(batch)):
                np.bitwise_or.at(mine, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(mine)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(mine[at].view(np.int64))], ["at", "bits"])

    found = rows.mapInArrow(words, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(out)


def filter_of(phrases: DataFrame) -> Filter:
    """The filter of ``lang, phrase``."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, np.uint64)
        for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            h = 0
            for word in phrase.encode("utf-8", "surrogatepass").split(b" "):
                h = (h * int(_NEXT) + _hash(word)) % 2**64
            out[i] = h ^ _hash(lang.encode())
        return out

    return _filter(phrases.select("lang", "phrase"), hashes)


class _Vocabulary(dict):
    """Word -> number in order of first sight; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large parts of the task's texts: language, the words of the part, and their numbers, pieces between zeros."""
    open_parts: dict[str, tuple[_Vocabulary, list[np.ndarray], list[int]]] = {}

    def close(lang: str):
        vocabulary, parts, _ = open_parts.pop(lang)
        x = np.concatenate([*parts, np.zeros(1, np.int32)])
        columns = [pa.array([lang], pa.string()), pa.array([b" ".join(vocabulary.words)], pa.binary()), pa.array([x.tobytes()], pa.binary())]
        return pa.record_batch(columns, ["lang", "words", "x"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def take(lang: str):
            vocabulary, parts, held = open_parts.setdefault(lang, (_Vocabulary(), [], [0]))
            # every separator is a piece's end, so that no other byte splits a word but a blank
            tokens = b"\n".join([b"", *texts.pop(lang)]).translate(_SHAPE).replace(b"\n", b" . ").split()
            parts.append(np.fromiter(map(vocabulary.__getitem__, tokens), np.int32, len(tokens)))
            held[0] += len(tokens)
            sizes[lang] = 0
            return held[0] >= _TOKENS or len(vocabulary.words) >= _VOCABULARY

        for i, lang in enumerate(langs):
            text = batch.column(1)[i].as_buffer().to_pybytes()
            texts.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= _TEXT and take(lang):
                yield close(lang)
        for lang in list(texts):
            if take(lang):
                yield close(lang)
    for lang in list(open_parts):
        yield close(lang)


def numbered_words(texts: DataFrame) -> DataFrame:
    """``lang, words, x``: all texts split once, for the passes to come. A part has about 150,000 words.

    Pages are measured after every part: by default a page would be all parts of a task, and its
    buffers for compressing and reading lie outside the heap.
    """
    path, every = fresh_path(texts.sparkSession, "numbered-words"), {f"parquet.page.size.row.check.{x}": 1 for x in ("min", "max")}
    parts = texts.mapInArrow(_numbered, "lang string, words binary, x binary")
    parts.write.options(**every).parquet(path)
    return texts.sparkSession.read.schema(parts.schema).parquet(path)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    for batch in batches:
        for lang, words, x in zip(*batch.columns):
            yield lang.as_py(), words.as_py().split(b" "), np.frombuffer(x.as_buffer(), np.int32)
            pa.default_memory_pool().release_unused()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _word_counts(parts: DataFrame) -> DataFrame:
    """``lang, phrase, n`` of single words; a row without phrase has the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, x in _parts(batches):
            n = np.bincount(x, minlength=len(words))
            n[0] = n[1:].sum()
            phrases = pa.concat_arrays([pa.nulls(1, pa.string()), _strings(words[1:])])
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), phrases, pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

    counted = parts.mapInArrow(count, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _places(lang: str, words: list[bytes], x: np.ndarray, wanted: list[tuple[int, int]], first: Filter, begun: Filter | dict[int, Filter], often: Filter):
    """Hashes of the words, and for each size the places where a wanted run starts, with a word in ``first``, and the hash of its known words."""
    salt = np.uint64(_hash(lang.encode()))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    hashes[hashes == 0] = 1  # as _hash
    good = often.has(hashes ^ salt)
    good[0] = False
    begun = begun if isinstance(begun, dict) else dict.fromkeys((size for size, _ in wanted), begun)
    starts = np.flatnonzero((first.has(hashes ^ salt) & good)[x])
    for size, known in wanted:
        # the first place is the end of a piece, so every run has a neighbour on both sides
        at = starts[: np.searchsorted(starts, len(x) - size)]
        for k in range(1, size):
            at = at[good[x[at + k]]]
        run = hashes[x[at]]
        for k in range(1, known):
            run = run * _NEXT + hashes[x[at + k]]
        if known > 1:
            passed = begun[size].has(run ^ salt)
            at, run = at[passed], run[passed]
        if len(at):
            for k in range(known, size):
                run = run * _NEXT + hashes[x[at + k]]
            yield size, at, run ^ salt, hashes


def _runs(x: np.ndarray, at: np.ndarray, size: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """A first place of each different run of ``size`` words that starts in ``at``, and each run's number."""
    code = x[at].astype(np.int64)
    for k in range(1, size):
        code = code * vocabulary + x[at + k]
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return first, code


def _common(ids: np.ndarray, order: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hash of the word that a group has at all its places, 0 where there are several or a piece ends."""
    low, high = np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts)
    return np.where((low == high) & (low > 0), hashes[low], np.uint64(0)).view(np.int64)


class _Held:
    """Counts of the phrases of several parts, their words numbered alike."""

    def __init__(self):
        self.vocabulary, self.rows = _Vocabulary(), 0
        self.counts: dict[tuple[str, int], list[tuple[np.ndarray, ...]]] = {}

    def add(self, lang: str, words: list[bytes], phrases: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray):
        """``phrases``: a row of numbers of ``words`` for each."""
        used, which = np.unique(phrases, return_inverse=True)
        numbers = np.fromiter((self.vocabulary[words[w]] for w in used.tolist()), np.int32, len(used))
        self.counts.setdefault((lang, phrases.shape[1]), []).append((numbers[which.reshape(phrases.shape)], n, left, right))
        self.rows += len(n)

    def combined(self) -> Iterator[pa.RecordBatch]:
        words = self.vocabulary.words
        for (lang, size), held in self.counts.items():
            phrases, n, left, right = map(np.concatenate, zip(*held))
            first, which = _runs(phrases.ravel(), np.arange(len(n)) * size, size, len(words))
            order = np.argsort(which, kind="stable")
            starts = np.searchsorted(which[order], np.arange(len(first)))
            sides = []
            for side in (left[order], right[order]):
                low, high = np.minimum.reduceat(side, starts), np.maximum.reduceat(side, starts)
                sides.append(np.where(low == high, low, 0))
            texts = _strings([b" ".join([words[w] for w in row]) for row in phrases[first].tolist()])
            fixed = [pa.array([lang] * len(first), pa.string()), pa.array(np.full(len(first), size, np.int32))]
            counts = [np.add.reduceat(n[order], starts), *sides]
            yield pa.record_batch([*fixed, texts, *map(pa.array, counts)], ["lang", "size", "phrase", "n", "left", "right"])


def _frequent_hashes(parts: DataFrame, wanted: list[tuple[int, int]], first: Filter, known: Filter, frequent: Filter, least: int) -> Filter:
    """The filter of the wanted runs whose hash occurs often enough: what is shuffled is a hash and a count."""
    shared = parts.sparkSession.sparkContext.broadcast((first, known, frequent))

    def combined(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(n)], ["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in _parts(batches):
            held += [run >> _UNUSED << _UNUSED for _, _, run, _ in _places(*part, wanted, *shared.value)]  # zeros compress
            if sum(map(len, held)) >= _RUNS:
                yield combined(held)
                held = []
        if held:
            yield combined(held)

    counted = parts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return _filter(counted.filter(F.col("n") >= least).select("h"), lambda batch: batch.column(0).to_numpy().view(np.uint64))


def _phrase_counts(
    parts: DataFrame, wanted: list[tuple[int, int]], first: Filter, known: Filter | dict[int, Filter], frequent: Filter, least: int
) -> DataFrame:
    """Phrases of the sizes ``wanted`` (size, known words): the first word is in ``first``, the known first words are in ``known``, of all sizes or by size, the rest frequent."""
    shared = parts.sparkSession.sparkContext.broadcast((first, known, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for lang, words, x in _parts(batches):
            for size, at, _, hashes in _places(lang, words, x, wanted, *shared.value):
                once, run = _runs(x, at, size, len(words))
                order = np.argsort(run, kind="stable")
                n = np.bincount(run)
                starts = np.cumsum(n) - n
                left, right = (_common(x[at + k], order, starts, hashes) for k in (-1, size))
                held.add(lang, words, x[at[once][:, None] + np.arange(size)], n, left, right)
            if held.rows >= _PHRASES:
                yield from held.combined()
                held = _Held()
        yield from held.combined()

    one_side = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)
    counted = parts.mapInArrow(count, COUNTED).groupBy("lang", "size", "phrase")
    return counted.agg(F.sum("n").alias("n"), one_side("left"), one_side("right")).filter(F.col("n") >= least)


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def scaled(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in whole numbers of 38 digits."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    names = {"u": wide(1000 * a, 19), "v": wide(n, 18), "x": wide(l, 19), "y": wide(r, 18)}
    return F.transform(
        F.array(F.struct(*[c.alias(k) for k, c in names.items()])),
        lambda s: F.call_function("div", s["u"] * s["v"], s["x"] * s["y"]),
    )[0]


def _top(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each language with their rank; parts of a language are cut first, so that no task has all of it."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    few = few.filter(F.col("rank") <= limit).drop("part", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)


def _scored(grown: DataFrame, frequent: DataFrame, totals: DataFrame, settled: DataFrame | None, max_words: int, look_up: Callable) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the surviving phrases of a wave that can still be among the first."""
    lone = (F.col("size") == max_words) | (F.col("left").isNull() & F.col("right").isNull())
    words = F.split("phrase", " ")
    alive = grown.filter(lone).select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("words")).join(totals, "lang")
    counts = frequent.union(grown.select("lang", "phrase", "n"))
    cuts = alive.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "size", "phrase", "a", "n", "cut", _part(1, F.col("cut")).alias("head"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("size")), " ").alias("tail"),
    )
    of = lambda c, name: counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(name))
    headed = written(cuts.join(of("head", "l"), ["lang", "head"]), "phrase-cuts")

    # the last cut is known by now, and is a bound of the lowest one
    last = headed.filter("cut = size - 1").join(frequent.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    bounded = last.select("lang", "phrase", scaled(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("bound"))
    if settled is not None:
        bounded = bounded.join(settled, "lang", "left").filter("score IS NULL OR bound >= score")
    open_cuts = written(headed.join(bounded.select("lang", "phrase"), ["lang", "phrase"]), "open-cuts")
    rests = open_cuts.filter("cut < size - 1").select("lang", F.col("tail").alias("phrase")).distinct()
    tails = frequent.union(look_up(rests)).select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = scaled(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    each = open_cuts.join(tails, ["lang", "tail"]).withColumn("score", score)
    low = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("low"))
    return low.select("lang", "phrase", "low.a", "low.l", "low.r", "low.n", "low.score")


def _growth(max_words: int) -> list[list[int]]:
    """The sizes that grow in one pass: pairs and triples have most of the different runs, what follows is grown two words at a time."""
    return [[size for size in sizes if size <= max_words] for sizes in [[2], [3], *([k, k + 1] for k in range(4, max_words + 1, 2))] if sizes[0] <= max_words]


def mine_phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", limit: int = LIMIT, least: int = LEAST, max_words: int = WORDS,
    first_wave: int = FIRST_WAVE,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``limit`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = numbered_words(texts)
    counts = written(_word_counts(parts).filter(f"phrase IS NULL OR n >= {least}"), "word-counts")
    totals = counts.filter("phrase IS NULL").select("lang", "n")
    frequent = counts.filter("phrase IS NOT NULL").select("lang", "phrase", "n")
    often = filter_of(frequent)

    # words by count: as many as the rows of ``steps`` up to a count, best bound first
    steps = frequent.groupBy("lang", F.col("n").alias("f")).agg(F.count(F.lit(1)).alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("lang").orderBy("f"))
    steps = written(steps.withColumn("words", up_to), "word-steps")

    def look_up(rests: DataFrame) -> DataFrame:
        rests = written(rests, "rests")
        sizes = [(k, k) for k in range(2, max_words)]
        begun = filter_of(rests.withColumn("phrase", F.substring_index("phrase", " ", 1)))
        found = _phrase_counts(parts, sizes, begun, filter_of(rests), often, least)
        return found.join(rests, ["lang", "phrase"], "left_semi").select("lang", "phrase", "n")

    best, settled, taken, times = None, None, first_wave * limit, COUNTS
    reached = totals.select("lang", F.lit(0).cast("long").alias("since"))
    while True:
        enough = F.min(F.when(F.col("words") >= taken, F.col("f"))).alias("enough")
        by_count = steps.join(reached, "lang").filter("f > since").groupBy("lang").agg(F.min("f").alias("next"), enough)
        goal = reached.join(by_count, "lang", "left").join(totals, "lang")
        upto = F.coalesce("enough", F.lit(2**62))
        if settled is not None:
            goal = goal.join(settled, "lang", "left")
            # at least the next count, so that no gap between counts ends the search
            upto = F.least(upto, F.greatest("next", F.least("since", F.lit(2**62 // times)) * times))
            times = min(times**2, 2**20)
            # bound >= score, and the bound is 1000 * n / count
            upto = F.least(upto, F.when(F.col("score") > 0, F.call_function("div", F.lit(1000) * F.col("n"), F.col("score"))))
        goal = written(goal.select("lang", "since", upto.alias("upto")), "frontier")
        ahead = frequent.join(goal, "lang").filter("n > since AND n <= upto").select("lang", "phrase")
        if ahead.isEmpty():
            break
        # many different runs, few of them frequent: growth is by their hashes, and all sizes are counted in one pass
        begun = known = filter_of(ahead)
        runs = {}
        for grown_to in _growth(max_words):
            known = _frequent_hashes(parts, [(size, grown_to[0] - 1) for size in grown_to], begun, known, often, least)
            if grown_to[0] > 2 and not known.words.any():
                break
            runs |= dict.fromkeys(grown_to, known)
        sizes = [(size, size) for size in runs]
        # filters let some others through: growth is from the words of this wave
        first = F.substring_index("phrase", " ", 1)
        grown = _phrase_counts(parts, sizes, begun, runs, often, least).withColumn("first", first)
        grown = grown.join(ahead.withColumnRenamed("phrase", "first"), ["lang", "first"], "left_semi").drop("first")
        grown = written(grown.select("lang", "size", "phrase", "n", "left", "right"), "phrases")
        new = _scored(grown, frequent, totals, settled, max_words, look_up)
        best = written(_top(new if best is None else best.drop("rank").unionByName(new), limit), "best-phrases")
        settled = best.filter(F.col("rank") == limit).select("lang", "score")
        reached = goal.select("lang", F.greatest("since", "upto").alias("since"))
        taken *= GROWTH
    if best is None:
        return texts.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, part FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
w AS (SELECT lang, [x for x in regexp_split_to_array(part, '[\x20\x09]+') if x <> ''] AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) AS words
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, words, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.words, f.f AS a, n.n, cut, l.f AS l, r.f AS r, (1000 * f.f * n.n) // (l.f * r.f) AS score
  FROM f JOIN n ON n.lang = f.lang JOIN (SELECT unnest([1, 2, 3, 4]) AS cut) ON cut < f.k
  JOIN f l ON l.lang = f.lang AND l.words = f.words[1:cut] JOIN f r ON r.lang = f.lang AND r.words = f.words[cut + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) AS nth FROM c),
longer AS (SELECT lang, words, f FROM f WHERE k > 2),
inside AS (SELECT DISTINCT lang, words FROM (
    SELECT lang, words[2:] AS words, f FROM longer UNION ALL SELECT lang, words[1:len(words) - 1], f FROM longer)
  JOIN f USING (lang, words, f)),
s AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.words = b.words
  WHERE b.nth = 1 AND i.words IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o WHERE rank <= 2000
"""


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return mine_phrases(table(spark, folder, "documents"))
