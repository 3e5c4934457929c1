"""A hierarchical Pitman-Yor language model of word pairs, sampled and scored by blocks.

Every word is a context with its own restaurant, and all of them share one parent, the
restaurant of single words, whose base is uniform over the vocabulary and one unknown word. A
pair (context, word) seen c times is c customers with that dish; each table they open sends
one customer to the parent. Seating is sampled by Gibbs: a customer leaves, and joins a table
with probability in proportion to its customers less the discount, or opens one in proportion to
(strength + discount * tables) times the parent's probability. Predictive probabilities are
averaged over the samples. Discounts are estimated from how many dishes have one and two
customers; a pair seen once always has one table, so only repeated pairs need sampling.

Layout. Texts are tokenized in blocks; a block sends each *cell* the distinct pairs it has
there, their training counts and which documents have them, as packed arrays. The cell of a
pair comes from its context, so a context's restaurant is in one place; contexts that are very
frequent in a small sample are spread over all cells by the word, and only their totals (a
few per cell) meet on the driver. Words are merged by *class*: a cell asks for the words it
has, and is answered in the same order. All of it grows with the corpus and is dealt out by hash.

    blocks -> cells: count pairs -> classes: merge words, seat the parent -> cells: sample
    seating -> classes: seat the parent once per sample -> cells: sums per document

The conditional of a seat uses the parent's probabilities and the other restaurants' totals of
the last exchange, as usual when restaurants are sampled in parallel. Dishes with more than
``MOVES`` customers are not kept customer by customer: each sweep draws their number of tables t
from its whole law at the weight w of a new table, w^t times the generalized Stirling number of
(customers, t). The law is counted exactly up to ``LISTED`` customers and carried on from there to its
limit, in which t - 1 is a Poisson number of mean w / discount.

Words are told apart by ``WORD_BITS`` of a hash: V words have about V * V / 2^49 collisions.
A NULL or empty text is one end token. With nothing to learn from, every token has the
probability of the uniform base. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import id_remainder, table
from keelson.plans.durable import PACKED, fresh_path, written

WORD_BITS = 48
START, END = np.uint64(2**WORD_BITS - 1), np.uint64(2**WORD_BITS - 2)
BLOCK_TOKENS, CHARS_PER_CELL, WINDOW = 1_500_000, 15_000_000, 1 << 21
SAMPLE_ROWS, FILES, PAIRS_AT_ONCE = 2_000, 50_000, 1 << 18
BURN_IN, SAMPLES, STRENGTH = 3, 3, 1.0
LISTED, MOVES = 4096, 128
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NEXT_SPACE = re.compile(rb"[\t-\r ]")
ROW = "kind string, key int, cell int, block long, data binary"
SCHEMA = pa.schema([("kind", pa.string()), ("key", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


# arrays as bytes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers (ascending ones as differences) or floats, compressed."""
    out = []
    for a in arrays:
        kind = 0
        if a.dtype.kind == "f":
            kind = 2
        else:
            a = a.astype(np.uint64)
            if len(a) > 1 and (a[1:] >= a[:-1]).all():
                a, kind = np.diff(a, prepend=np.uint64(0)), 1
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 256 ** int(t[2])))
        # bytes of equal weight side by side compress better
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        body = pa.compress(planes, codec="zstd", asbytes=True)
        out.append(struct.pack("<BBII", kind, a.itemsize, len(a), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes, first: int = 0, end: int | None = None) -> list[np.ndarray]:
    """The packed arrays, or those with numbers from ``first`` to before ``end``."""
    out, at, number = [], 0, -1
    while at < len(data) and (end is None or number + 1 < end):
        kind, size, n, length = struct.unpack_from("<BBII", data, at)
        at, number = at + 10, number + 1
        if number < first:
            at += length
            continue
        planes = np.frombuffer(pa.decompress(data[at : at + length], n * size, codec="zstd", asbytes=True), np.uint8)
        at += length
        a = np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(f"<{'f' if kind == 2 else 'u'}{size}")
        out.append(np.cumsum(a.astype(np.uint64)) if kind == 1 else a)
    return out


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# tokens and blocks


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a text, in windows that end at white space."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        found = _NEXT_SPACE.search(data, at + WINDOW)
        to = found.start() if found else len(data)
        raw = np.frombuffer(data, np.uint8, to - at, at)
        space = np.concatenate([[True], _SPACE[raw], [True]])
        begin, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        base = 0x5851F42D4C957F2D
        power = np.cumprod(np.full(len(raw), base, np.uint64))
        inverse = np.cumprod(np.full(len(raw), pow(base, -1, 2**64), np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        if len(begin):
            h = (sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
            starts.append(begin + at)
            hashes.append(mix(h) >> np.uint64(64 - WORD_BITS))
        at = to
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and document number of every token, end tokens included."""
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(sizes) - sizes
    starts, hashes = word_hashes(b"\n".join(texts))
    doc = np.searchsorted(first, starts, "right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(counts + 1) - 1
    word = np.empty(len(starts) + len(texts), np.uint64)
    word[np.arange(len(starts)) + doc] = hashes
    word[ends] = END
    context = np.concatenate([[START], word[:-1]])
    context[ends[:-1] + 1] = START
    return context, word, np.repeat(np.arange(len(texts)), counts + 1)


def cells_of(context: np.ndarray, word: np.ndarray, cells: int, hot: np.ndarray) -> np.ndarray:
    spread = np.isin(context, hot)
    return (np.where(spread, mix(word, 2), mix(context, 1)) % np.uint64(cells)).astype(np.min_scalar_type(cells))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def block_rows(block: int, ids: list, train: np.ndarray, parts: list, cells: int, hot: np.ndarray) -> list[dict]:
    lists = [list(x) for x in zip(*parts)]
    parts.clear()
    columns = []
    for some in lists:
        columns.append(np.concatenate(some))
        some.clear()  # copied by now, and large
    context, word, doc = columns
    del columns
    cell = cells_of(context, word, cells, hot)
    order = np.lexsort((word, context))
    order = order[np.argsort(cell[order], kind="stable")]
    cell, context = cell[order], context[order]
    word, doc = word[order], doc[order]
    del order
    rows = []
    borders = np.append(_runs(cell), len(cell))
    for lo, hi in zip(borders[:-1], borders[1:]):
        u, w, d = context[lo:hi], word[lo:hi], doc[lo:hi]
        entries = _runs(u, w, d)
        entry_counts = np.diff(np.append(entries, hi - lo))
        pairs = _runs(u[entries], w[entries])
        eu, ew, ed = u[entries], w[entries], d[entries]
        pu, pw = eu[pairs], ew[pairs]
        seen = np.add.reduceat(np.where(train[ed], entry_counts, 0), pairs)
        contexts = _runs(pu)
        words, at = np.unique(pw, return_inverse=True)
        have, number = np.unique(ed, return_inverse=True)
        known = np.array([ids[k] is not None for k in have])
        # signed ids as two's complement
        keys = np.array([ids[k] or 0 for k in have], np.int64).view(np.uint64)
        data = pack(
            pu[contexts], np.diff(np.append(contexts, len(pu))), words, at, seen,
            np.diff(np.append(pairs, len(eu))), number, entry_counts, have, keys, known,
        )
        rows.append({"kind": "b", "key": 0, "cell": int(cell[lo]), "block": block, "data": data})
    return rows


def make_blocks(docs: DataFrame, cells: int, hot: np.ndarray) -> DataFrame:
    """Rows of kind b from ``doc_id, text, train``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids, train, parts, size = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in some.column(1).to_pylist()]
                context, word, doc = tokens(texts)
                parts.append((context, word, (doc + len(ids)).astype(np.int32)))
                ids += some.column(0).to_pylist()
                train += some.column(2).to_pylist()
                size += len(word)
                if size >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist(block_rows(part << 24 | count, ids, np.array(train), parts, cells, hot), SCHEMA)
                    ids, train, parts, size, count = [], [], [], 0, count + 1
        if ids:
            yield pa.RecordBatch.from_pylist(block_rows(part << 24 | count, ids, np.array(train), parts, cells, hot), SCHEMA)

    return docs.mapInArrow(blocks, ROW)


# seating


def seatings(customers: np.ndarray, discount: float, width: int) -> dict[int, np.ndarray]:
    """By number of customers n: the log weight of all their seatings at 1, 2, ... ``width`` tables.

    A seating weighs the product of (1 - d)(2 - d)...(size - 1 - d) over its tables; the next
    customer joins one of t tables of n customers with weight n - d * t, or opens one. Beyond
    ``LISTED`` customers the ratio of neighbouring weights goes on to its limit 1 / (d * t) as n^-d.
    """
    out, wanted, row = {}, set(customers.tolist()), np.full(width, -np.inf)
    row[0] = 0.0
    opened = discount * np.arange(1, width + 1)
    for n in range(1, min(LISTED, int(customers.max())) + 1 if len(customers) else 0):
        if n in wanted:
            out[n] = row[:n].copy()
        m = min(n + 1, width)
        joined = row[:m] + np.log(np.maximum(n - opened[:m], 1e-300))
        if n < LISTED:
            row[1:m], row[0] = np.logaddexp(joined[1:], row[: m - 1]), joined[0]
    large = [n for n in wanted if n > LISTED]
    limit = -np.log(opened[:-1])
    beyond = np.diff(row[:LISTED]) - limit[: LISTED - 1] if large else limit
    for n in large:
        steps = limit[: len(beyond)] + beyond * (n / LISTED) ** -discount
        out[n] = np.concatenate([[0.0], np.cumsum(steps)])
    return out


class Seats:
    """Customers of many dishes at tables, each dish by itself; ``c`` customers, ``t`` tables."""

    def __init__(self, c: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator):
        """``new`` is the weight of a new table: (strength + discount * tables) * parent."""
        self.rng, self.d = rng, discount
        self.order = np.argsort(-c, kind="stable")
        self.c = c[self.order].astype(np.int64)
        self.many = int((self.c > MOVES).sum())
        self.t = np.zeros(len(c), np.int64)
        self.width, self.rows = 0, {}
        self.set_weight(new)
        n = self.c[self.many :]
        self.off = np.cumsum(n) - n
        total, self.size_of = int(n.sum()), None
        label = (np.arange(total) - np.repeat(self.off, n)).astype(np.int32)
        self.table, self.sizes = np.zeros(total, np.int32), np.zeros(total, np.int32)
        self.free, self.where = label, label.copy()  # labels in use come first; where each label stands
        for j in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -j, "left"))  # dishes with more than j customers
            self._join(m, np.full(m, j), np.full(m, j), everyone=True)
        self._reseat_many()

    def set_weight(self, new: np.ndarray) -> None:
        self.new = new[self.order]

    def _join(self, m: int, who: np.ndarray, others: np.ndarray, everyone: bool) -> None:
        """Customer ``who`` of each of the first m dishes takes a seat; ``others`` sit already."""
        off, t = self.off[:m], self.t[self.many : self.many + m]
        new = self.new[self.many : self.many + m]
        opens = (others == 0) | (self.rng.random(m) * (new + others - self.d * t) < new)
        seat = np.empty(m, np.int32)
        k = np.flatnonzero(opens)
        seat[k] = self.free[off[k] + t[k]]
        t[k] += 1
        k = np.flatnonzero(~opens)
        while len(k):  # a table in proportion to its customers less the discount, by rejection
            pick = (self.rng.random(len(k)) * others[k]).astype(np.int64)
            if not everyone:
                pick += pick >= who[k]
            at = self.table[off[k] + pick]
            stays = self.rng.random(len(k)) * self.sizes[off[k] + at] >= self.d
            seat[k[stays]] = at[stays]
            k = k[~stays]
        self.table[off + who] = seat
        self.sizes[off + seat] += 1

    def _leave(self, m: int, who: np.ndarray) -> None:
        off, t = self.off[:m], self.t[self.many : self.many + m]
        label = self.table[off + who]
        self.sizes[off + label] -= 1
        k = np.flatnonzero(self.sizes[off + label] == 0)
        t[k] -= 1
        o, gone, last = off[k], label[k], t[k]
        moved, place = self.free[o + last], self.where[o + gone]
        self.free[o + place], self.where[o + moved] = moved, place
        self.free[o + last], self.where[o + gone] = gone, last

    def _reseat_many(self) -> None:
        """Draws the tables of each dish of many customers, independently of the last draw."""
        if not self.many:
            return
        c, new = self.c[: self.many], self.new[: self.many]
        wanted = 2 * int(new.max() / self.d) + 200
        if wanted > self.width:  # some room, since weights grow with the tables of others
            self.width = 2 * wanted
            self.rows = seatings(np.unique(c), self.d, self.width)
        starts = np.append(_runs(c), len(c))
        for lo, hi in zip(starts[:-1], starts[1:]):
            row = self.rows[int(c[lo])][: 2 * int(new[lo:hi].max() / self.d) + 200]
            count = np.arange(1, len(row) + 1)
            for at in range(lo, hi, 256):
                p = row + count * np.log(new[at : min(at + 256, hi), None])
                p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
                self.t[at : at + len(p)] = 1 + (p < self.rng.random((len(p), 1)) * p[:, -1:]).sum(1)

    def sweep(self) -> None:
        """As many moves of random customers per dish as it has customers; dishes of many anew."""
        n = self.c[self.many :]
        for j in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -j, "left"))
            who = (self.rng.random(m) * n[:m]).astype(np.int64)
            self._leave(m, who)
            self._join(m, who, n[:m] - 1, everyone=False)
        self._reseat_many()

    def tables(self) -> np.ndarray:
        out = np.empty(len(self.t), np.int64)
        out[self.order] = self.t
        return out


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


# cells and classes


def _classes(words: np.ndarray, cells: int) -> np.ndarray:
    return (mix(words, 3) % np.uint64(cells)).astype(np.int64)


def _by_class(words: np.ndarray, cells: int) -> list[tuple[int, np.ndarray]]:
    """(class, positions) of the classes that have words."""
    of = _classes(words, cells)
    order = np.argsort(of, kind="stable")
    cuts = np.append(_runs(of[order]), len(order))
    return [(int(of[order[a]]), order[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the number of each of ``x`` among them."""
    order = np.argsort(x, kind="stable")
    sorted_x = x[order]
    first = _runs(sorted_x)
    values = sorted_x[first]
    del sorted_x
    number, of = np.zeros(len(x), np.int32), np.empty(len(x), np.int32)
    number[first[1:]] = 1
    np.cumsum(number, out=number)
    of[order] = number
    return values, of


class Cell:
    """All pairs of a cell, merged over its blocks."""

    def __init__(self, blobs: list[bytes], keep_documents: bool = False):
        us, ws, seen = [], [], []
        for data in blobs:
            u, runs, words, at, tc = unpack(data, 0, 5)
            us.append(np.repeat(u, runs.astype(np.int64)))
            ws.append(words[at.astype(np.int64)])
            seen.append(tc.astype(np.int32))
        del u, runs, words, at, tc
        self.lengths = [len(x) for x in us]
        columns = []
        for some in (us, ws, seen):  # one at a time, as they are large
            columns.append(np.concatenate(some))
            some.clear()
        u, w, c = columns
        columns.clear()
        order = np.lexsort((w, u))
        u = u[order]
        w = w[order]
        c = c[order]
        first = _runs(u, w)
        if keep_documents:
            number = np.zeros(len(u), np.int32)
            number[first[1:]] = 1
            np.cumsum(number, out=number)
            self.pair_of = np.empty(len(u), np.int32)
            self.pair_of[order] = number
            del number
        del order
        self.u = u[first]
        del u
        self.w = w[first]
        del w
        self.c = np.add.reduceat(c, first, dtype=np.int64)
        del c, first
        starts = _runs(self.u)
        self.contexts = self.u[starts]
        self.context_of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(self.u))))
        self.total = np.bincount(self.context_of, self.c, len(starts)).astype(np.int64)
        self.types = np.bincount(self.context_of, self.c > 0, len(starts)).astype(np.int64)
        if keep_documents:
            del self.u
        self.words, self.word_of = _numbered(self.w)
        if keep_documents:
            del self.w


def count_cell(cells: int, hot: np.ndarray):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what Arrow keeps of the groups before
        number = key[0].as_py()
        cell = Cell(rows.column("data").to_pylist())
        c = np.bincount(cell.word_of, cell.c, len(cell.words)).astype(np.int64)
        k = np.bincount(cell.word_of, cell.c > 0, len(cell.words)).astype(np.int64)
        out = [
            {"kind": "w", "key": of, "cell": number, "block": 0, "data": pack(cell.words[at], c[at], k[at])}
            for of, at in _by_class(cell.words, cells)
        ]
        again = np.flatnonzero(cell.c >= 2)
        tables = pack(cell.u[again], cell.w[again], cell.c[again], cell.types[cell.context_of[again]], cell.words)
        out.append({"kind": "p", "key": 0, "cell": number, "block": int((cell.c == 1).sum()), "data": tables})
        shared = np.flatnonzero(np.isin(cell.contexts, hot))
        totals = pack(cell.contexts[shared], cell.total[shared], cell.types[shared])
        out.append({"kind": "h", "key": 0, "cell": number, "block": int((cell.c == 2).sum()), "data": totals})
        return pa.Table.from_pylist(out, SCHEMA)

    return run


def merge_words(key: tuple, rows: pa.Table) -> pa.Table:
    """Of the words of a class: training counts c and numbers of contexts k, as row m; their sums, as
    row s; and for every cell which of them it has, as rows q."""
    cells, parts = rows.column("cell").to_pylist(), [unpack(x) for x in rows.column("data").to_pylist()]
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    c, k = (np.bincount(at, np.concatenate([p[i].astype(np.int64) for p in parts]), len(words)).astype(np.int64) for i in (1, 2))
    sums = pack(np.array([(c > 0).sum(), c.sum(), k.sum(), (k == 1).sum(), (k == 2).sum()]))
    out = [("m", -1, pack(c, k)), ("s", -1, sums)]
    out += [("q", cell, pack(np.searchsorted(words, p[0]))) for cell, p in zip(cells, parts)]
    return pa.Table.from_pylist([{"kind": a, "key": key[0].as_py(), "cell": of, "block": 0, "data": b} for a, of, b in out], SCHEMA)


def answer_cells(facts: dict, samples: int):
    """Per asking cell: c of its words, and per sample k and t in the parent restaurant.

    Rows of kind m hold the class, rows of kind q what a cell asks for, and rows of kind x, in that order,
    the customers that sampled tables add, one array per sample.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what Arrow keeps of the groups before
        by: dict[str, dict[int, list]] = {"m": {}, "q": {}, "x": {}}
        for kind, cell, data in zip(*[rows.column(x).to_pylist() for x in ("kind", "cell", "data")]):
            by[kind][cell] = unpack(data)
        c, k = by["m"][-1]
        asked = {cell: x[0].astype(np.int64) for cell, x in by["q"].items()}
        ks, ts = [], []
        known = np.flatnonzero(c > 0)
        for s in range(samples):
            customers = k.astype(np.int64)
            for cell, x in sorted(by["x"].items()):
                customers[asked[cell]] += x[s].astype(np.int64)
            new = np.full(len(known), (STRENGTH + facts["d1"] * facts["V"]) / (facts["V"] + 1))
            seats = Seats(customers[known], new, facts["d1"], np.random.default_rng([11, s, key[0].as_py()]))
            for _ in range(BURN_IN):
                seats.sweep()
            t = np.zeros(len(c), np.int64)
            t[known] = seats.tables()
            ks.append(customers)
            ts.append(t)
        out = [
            {"kind": "a", "key": key[0].as_py(), "cell": cell, "block": 0, "data": pack(c[at], *[x[at] for x in ks], *[x[at] for x in ts])}
            for cell, at in asked.items()
        ]
        sums = pack(np.array([x.sum() for x in ks]), np.array([x.sum() for x in ts]))
        out.append({"kind": "s", "key": key[0].as_py(), "cell": -1, "block": 0, "data": sums})
        return pa.Table.from_pylist(out, SCHEMA)

    return run


def _answers(words: np.ndarray, by_class: dict[int, bytes], cells: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c by word; k and t by sample and word."""
    c = np.zeros(len(words), np.int64)
    k, t = np.zeros((samples, len(words)), np.int64), np.zeros((samples, len(words)), np.int64)
    for of, at in _by_class(words, cells):
        c[at], *rest = unpack(by_class[of])
        for s in range(samples):
            k[s, at], t[s, at] = rest[s], rest[samples + s]
    return c, k, t


def _parent(k: np.ndarray, t: np.ndarray, facts: dict, s: int) -> np.ndarray:
    """Probability of a word in the parent restaurant."""
    customers, tables = facts["K"][s], facts["T"][s]
    base = (STRENGTH + facts["d1"] * tables) / (facts["V"] + 1)
    return (np.maximum(k - facts["d1"] * t, 0) + base) / (STRENGTH + customers)


def sample_cell(cells: int, facts: dict):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what Arrow keeps of the groups before
        number, pairs, by_class = key[0].as_py(), None, {}
        for kind, of, data in zip(*[rows.column(x).to_pylist() for x in ("kind", "key", "data")]):
            if kind == "p":
                pairs = unpack(data)
            else:
                by_class[of] = data
        u, w, c, types, words = pairs
        _, k, t1 = _answers(words, by_class, cells, 1)
        at = np.searchsorted(words, w)
        parent = _parent(k[0], t1[0], facts, 0)[at]
        types = types.astype(np.float64)
        hot, _, hot_types = facts["hot"]
        if len(hot):
            spot = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
            types = np.where(hot[spot] == u, hot_types[spot], types)
        starts = _runs(u)
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(u))))
        weight = lambda more: (STRENGTH + facts["d2"] * (types + more)) * parent
        seats = Seats(c.astype(np.int64), weight(0), facts["d2"], np.random.default_rng([12, number]))
        kept, added = [], []
        for step in range(BURN_IN + SAMPLES):
            tables = seats.tables()
            more = np.bincount(owner, tables - 1, len(starts))[owner] if len(u) else tables
            seats.set_weight(weight(more))
            seats.sweep()
            if step >= BURN_IN:
                kept.append(seats.tables())
                added.append(np.bincount(at, kept[-1] - 1, len(words)).astype(np.int64))
        shared = np.isin(u, hot)
        spot = np.searchsorted(hot, u[shared])
        extra = [np.bincount(spot, t[shared] - 1, len(hot)).astype(np.int64) for t in kept]
        out = [
            {"kind": "x", "key": of, "cell": number, "block": 0, "data": pack(*[a[spot] for a in added])}
            for of, spot in _by_class(words, cells)
        ]
        out.append({"kind": "t", "key": 0, "cell": number, "block": 0, "data": pack(*kept)})
        out.append({"kind": "e", "key": 0, "cell": number, "block": 0, "data": pack(*extra)})
        return pa.Table.from_pylist(out, SCHEMA)

    return run


SUMS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def sum_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """Per document of a block the sums over all cells, in the order of the cells."""
    parts = [unpack(x) for _, x in sorted(zip(rows.column("cell").to_pylist(), rows.column("data").to_pylist()))]
    n = 1 + max(int(p[0][-1]) for p in parts)
    ids, known = np.zeros(n, np.uint64), np.zeros(n, bool)
    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
    for have, keys, has_id, *values in parts:
        have = have.astype(np.int64)
        ids[have], known[have] = keys, has_id
        for total, value in zip(sums, values):
            total[have] += value.astype(total.dtype)
    doc_ids = pa.array(ids.view(np.int64), mask=~known)
    return pa.table([doc_ids, *[pa.array(x) for x in sums]], [c.split()[0] for c in SUMS.split(", ")])


def score_cell(cells: int, facts: dict):
    def run(key: tuple, blocks: pa.Table, rest: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what Arrow keeps of the groups before
        blobs = [x.as_buffer() for x in blocks.column("data")]  # views, no copies
        cell = Cell(blobs, keep_documents=True)
        by_class, tables = {}, None
        for kind, of, data in zip(*[rest.column(x).to_pylist() for x in ("kind", "key", "data")]):
            if kind == "t":
                tables = unpack(data)
            else:
                by_class[of] = data
        c_word, k, t1 = _answers(cell.words, by_class, cells, SAMPLES)
        del by_class
        again = np.flatnonzero(cell.c >= 2)
        hot, hot_total, hot_types = facts["hot"]
        mine = np.isin(cell.contexts, hot)
        spot = np.searchsorted(hot, cell.contexts[mine])
        total, parents, opened = cell.total.astype(np.float64), [], []
        if len(hot):
            total[mine] = hot_total[spot]
        for s in range(SAMPLES):
            more = np.bincount(cell.context_of[again], tables[s].astype(np.int64) - 1, len(total))
            opened.append(cell.types.astype(np.float64) + more)
            if len(hot):
                opened[s][mine] = hot_types[spot] + facts["hot_extra"][s][spot]
            parents.append(_parent(k[s], t1[s], facts, s))
        del k, t1
        log_p = np.zeros(len(cell.c))
        for at in range(0, len(log_p), PAIRS_AT_ONCE):
            part = slice(at, at + PAIRS_AT_ONCE)
            u, w, c, p = cell.context_of[part], cell.word_of[part], cell.c[part], log_p[part]
            few = slice(*np.searchsorted(again, [at, at + len(p)]))
            for s in range(SAMPLES):
                t = (c > 0).astype(np.float64)
                t[again[few] - at] = tables[s][few]
                own = np.maximum(c - facts["d2"] * t, 0)
                p += (own + (STRENGTH + facts["d2"] * opened[s][u]) * parents[s][w]) / (STRENGTH + total[u])
            np.log10(p / SAMPLES, out=p)
        del again, tables, opened, parents
        N, V = facts["N"], facts["V"]
        log_base = np.log10((c_word + 0.1) / (N + 0.1 * (V + 1)))
        is_known = c_word > 0
        lengths, pair_of, word_of = cell.lengths, cell.pair_of, cell.word_of
        del cell
        out, at = [], 0
        for block, length, data in zip(blocks.column("block").to_pylist(), lengths, blobs):
            per_pair, number, counts, have, keys, known = unpack(data, 5)
            pair = np.repeat(pair_of[at : at + length], per_pair.astype(np.int64))
            at += length
            counts, number = counts.astype(np.int64), number.astype(np.int64)
            add = lambda x: np.bincount(number, x, len(have))
            sums = pack(
                have, keys, known, add(counts).astype(np.int64), add(counts * is_known[word_of[pair]]).astype(np.int64),
                add(counts * log_base[word_of[pair]]), add(counts * log_p[pair]),
            )
            out.append({"kind": "d", "key": 0, "cell": key[0].as_py(), "block": block, "data": sums})
        return pa.Table.from_pylist(out, SCHEMA)

    return run


def _frequent_contexts(docs: DataFrame, rows: int, cells: int) -> np.ndarray:
    """Words with more than a quarter of a cell's share in about SAMPLE_ROWS texts; at most 4 * cells."""
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(2**30)) < int(2**30 * min(1.0, SAMPLE_ROWS / max(rows, 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(0).slice(at, 200).to_pylist()]
                u, n = np.unique(tokens(texts)[0], return_counts=True)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n)], ["u", "n"])

    counts = some.select("text").mapInArrow(count, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    (total,) = counts.agg(F.sum("n")).first()
    top = counts.filter(F.col("n") > (total or 0) / (4 * cells)).select("u").collect()
    return np.array(sorted(r["u"] for r in top), np.uint64)


def score_texts(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row by a model of the rows where ``train`` (a column of ``docs``) holds.

    ``doc_id, n_tokens, n_known, train_tokens, base_score, score``; scores are log10.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_rows, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    cells = max(1, -(-(chars or 0) // CHARS_PER_CELL))
    hot = _frequent_contexts(rows, n_rows, cells) if cells > 1 else np.empty(0, np.uint64)

    # bucketed by cell, so the passes over it need no further shuffle; Spark limits how many buckets there are
    name = f"pairs_{fresh_path(spark, '').rsplit('-', 1)[1]}"
    files = min(cells, FILES)
    dealt = make_blocks(rows, cells, hot).repartition(files, "cell")
    dealt.write.options(**PACKED).option("path", fresh_path(spark, "pairs")).bucketBy(files, "cell").saveAsTable(name)
    blocks = spark.table(name)

    counted = written(blocks.groupBy("cell").applyInArrow(count_cell(cells, hot), ROW), "counted", **PACKED)
    merged = written(counted.filter("kind = 'w'").groupBy("key").applyInArrow(merge_words, ROW), "merged", **PACKED)
    held = merged.filter("kind in ('m', 'q')")

    sums = [unpack(r["data"])[0].astype(np.int64) for r in merged.filter("kind = 's'").select("data").collect()]
    V, N, K, k1, k2 = np.sum(sums, axis=0).tolist() if sums else [0] * 5
    ones = {r["kind"]: r["n"] for r in counted.filter("kind in ('p', 'h')").groupBy("kind").agg(F.sum("block").alias("n")).collect()}
    shared = np.zeros((2, len(hot)), np.int64)
    for r in counted.filter("kind = 'h'").select("data").toLocalIterator():
        u, total, types = unpack(r["data"])
        at = np.searchsorted(hot, u)
        shared[:, at] += np.array([total, types], np.int64)
    facts = {
        "V": V, "N": N, "d1": discount(k1, k2), "d2": discount(ones.get("p", 0), ones.get("h", 0)),
        "hot": (hot, shared[0], shared[1]),
    }

    def settled(answers: DataFrame) -> dict:
        parts = [unpack(r["data"]) for r in answers.filter("kind = 's'").select("data").collect()]
        total = lambda i: np.sum([p[i].astype(np.int64) for p in parts], axis=0).tolist() if parts else [0] * SAMPLES
        return facts | {"K": total(0), "T": total(1)}

    first = written(held.groupBy("key").applyInArrow(answer_cells(facts, 1), ROW), "parent", **PACKED)
    pairs = counted.filter("kind = 'p'")
    seated = written(
        pairs.union(first.filter("kind = 'a'")).groupBy("cell").applyInArrow(sample_cell(cells, settled(first)), ROW), "seated", **PACKED
    )
    extra = np.zeros((SAMPLES, len(hot)))
    for r in seated.filter("kind = 'e'").select("data").toLocalIterator():
        extra += np.array(unpack(r["data"]), np.float64).reshape(extra.shape)
    added = seated.filter("kind = 'x'")
    second = written(
        held.union(added).groupBy("key").applyInArrow(answer_cells(facts, SAMPLES), ROW), "parents", **PACKED
    )
    final = settled(second) | {"hot_extra": extra}
    rest = second.filter("kind = 'a'").union(seated.filter("kind = 't'"))
    parts = blocks.groupBy("cell").cogroup(rest.groupBy("cell")).applyInArrow(score_cell(cells, final), ROW)
    summed = parts.groupBy("block").applyInArrow(sum_blocks, SUMS)
    return summed.select(
        "doc_id", "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op1_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 10, 0) == 0
    scored = score_texts(table(spark, folder, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
