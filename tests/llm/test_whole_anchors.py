"""Fingerprints and likeness work on all anchors of a text."""

import random

from keelson.llm import syncmers
from tests.llm.shapes import documents


def test_short_passage_in_long_texts_leaves_a_trace(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    passage, base = prose(50), prose(20_000)
    texts = [prose(10_000) + " " + passage + " " + prose(10_000), prose(5_000) + " " + passage, base, base[:70_000] + "#" + base[70_001:]]
    rows = {r.doc_id: r for r in syncmers.fingerprint_edits(documents(spark, list(enumerate(texts)))).collect()}
    assert rows[0].near_next > 0 and rows[1].near_next == 0
    assert 0.999 < rows[2].near_next < 1 and rows[2].fingerprint != rows[3].fingerprint
    anchors = syncmers.anchors(syncmers.code_points(base))[1]
    assert len(rows[2].fingerprint) == 8 * len({int(h) >> 32 for h in anchors})
    assert rows[2].sketch == rows[2].fingerprint[: 8 * syncmers.SKETCH]


def test_matches_keep_their_offset():
    keyed = lambda t: syncmers.keyed(syncmers.anchors(syncmers.code_points(t)))
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefgh", k=3000))
    assert syncmers.likeness(keyed(text), keyed(text)) == 1
    moved = syncmers.likeness(keyed(text), keyed("0123456789" * 3 + text))
    assert 0.95 < moved < 1
    assert syncmers.likeness(keyed(""), keyed("")) == 1 and syncmers.likeness(keyed("x"), keyed("")) == 0
