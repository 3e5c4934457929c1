"""Tokenized output, packing and chat formatting: round trips and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from keelson.llm import chat, packing, token_files, tokens
from keelson.plans.durable import fresh_path
from tests.llm.shapes import LONG, TEXTS, documents, none_of

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "a  b", " a", "a ", "\n\nx", "a\n\n b", "don't 's <|endoftext|> x", "x<|endoftext|>\ny <|endoftext|>",
    "é\u0301 \u0301x", "a\u00a0 b", "A \tb\r\nc", "x\ny \nz", "12345 67\n8", "a\x85 b", "İstanbul ΣΑΣ\nΣ. straße!", "word, word; 'll re.",
    "ﬁn ½ ² ٣ abc_def", "Zürich.", "\x1c a\x1d b",
]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_pieces_give_the_same_ids(spark, file):
    path = public_tokenizers.path(file)
    encode, library = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD + [LONG]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), encode.dtype).tolist() == want, text[:80]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_encoded_together_give_the_same_ids(file, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 500)
    path, rng = public_tokenizers.path(file), random.Random(5)
    encode, library = tokens.Encoder(path), Tokenizer.from_file(path)
    parts = [*" \n\n  \t\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000.,;:!?'’-aZéÉ×÷ñßİΣσ中é1²<|>", "one", "Two", "don't", "<|endoftext|>", "\u0301", "ﬁ", "«"]
    texts = [None if rng.random() < 0.02 else "".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    got = encode.all(pa.array(texts, pa.string()).slice(3))
    for text, ids in zip(texts[3:], got, strict=True):
        assert np.frombuffer(ids, encode.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert encode.all(pa.array([], pa.string())) == [] and encode.all(pa.array([None, ""], pa.string())) == [b"", b""]


def test_a_piece_is_looked_up_once_in_a_part(monkeypatch):
    """Every word of every text was looked up by itself, which took most of the time of packing."""

    class Counted(tokens._Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    asked = []
    monkeypatch.setattr(tokens, "_Pieces", Counted)
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setitem(vars(tokens.tokenizers), "_kept_encoders", {})
    batch = pa.record_batch([pa.array(["red fish, blue fish"] * 1000)], ["text"])
    got = [i for _, ids, _ in tokens.encoded(iter([batch]), path, "text") for i in ids]
    assert len(got) == 1000 and len(asked) < 10


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("rows_per_file", [4, 1000])
def test_token_files(spark, rows_per_file):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, docs = Tokenizer.from_file(path), documents(spark)
    folder = fresh_path(spark, "tokens")
    files = token_files.write_token_files(docs, folder, path, 2, rows_per_file=rows_per_file)
    got = sorted((tuple(r) for r in token_files.read_token_files(files, folder).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got]])[:-1])
    assert [r[0] for r in got] == sorted([r[0] for r in got], key=lambda k: (k is not None, k or 0))
    want = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in TEXTS]
    assert sorted(((k, len(i), checksum(i)) for k, i in want), key=repr) == sorted(((r[0], r[2], r[3]) for r in got), key=repr)
    empty = token_files.write_token_files(none_of(docs), fresh_path(spark, "tokens"), path, 2)
    assert token_files.read_token_files(empty, folder).count() == 0


def check_packed(rows, want, capacity):
    """Every id once, sequences gapless and within the capacity; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    for (key, n), parts in by_doc.items():
        ids = next(i for k, i in want if k == key and len(i) == n)
        copies = sum(1 for k, i in want if k == key and len(i) == n)
        assert sum(p.length for p in parts) == n * copies
        if copies == 1:
            for p in parts:
                assert checksum(ids[p.start : p.start + p.length]) == p.ids_crc32
    return len(by_sequence) * capacity - sum(r.length for r in rows)


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id + 10**6, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + TEXTS
    rows += [(5000 + k, "same text again") for k in range(500)]
    want = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows]
    packed = packing.with_checksums(packing.pack_documents(documents(spark, rows), path, rows_per_block=50))
    assert check_packed(packed.collect(), want, 1024) < 1024
    assert packing.pack_documents(none_of(documents(spark)), path).count() == 0


def test_fillings_are_the_best_ones():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.integers(1, 40, 6).tolist()
        counts, capacity = {k: int(rng.integers(1, 4)) for k in lengths}, int(rng.integers(5, 90))
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * m for s in sums for m in range(n + 1) if s + k * m <= capacity}
        found = packing.best_filling(counts, capacity)
        assert all(n <= counts[k] for k, n in found.items())
        assert sum(k * n for k, n in found.items()) == max(sums)


def test_plan_of_a_hot_length():
    counts = {300: 50_000, 7: 10, 1024: 3, 1000: 40}
    plan = packing.plan_sequences(counts)
    assert plan.sequences == -(-sum(k * n for k, n in counts.items()) // 1024)


PARTS = [
    {"kind": "text", "text": "a <image:0> \\ b", "ref": None, "width": None, "height": None, "seconds": None, "pages": None},
    {"kind": "image", "text": None, "ref": "i.png", "width": 28, "height": 15, "seconds": None, "pages": None},
    {"kind": "audio", "text": None, "ref": "s.wav", "width": None, "height": None, "seconds": 2.01, "pages": None},
    {"kind": "document", "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": 3},
    None,
    {"kind": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None},
]


def test_parts_and_placeholders(spark):
    df = spark.createDataFrame([(1, 0, "user", PARTS), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    assert first.formatted == "<turn>user\na \\<image:0> \\\\ b<image:0><audio:1><document:2></turn>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "i.png", 4), (1, "audio", "s.wav", 51), (2, "document", None, 1536)]
    for a in first.attachments:
        mark = f"<{a.kind}:{a.number}>"
        assert first.formatted[a["at"] : a["at"] + len(mark)] == mark
    assert second.formatted == "<turn>\n</turn>\n"
    bad = spark.createDataFrame([(1, 0, "user", [{**PARTS[0], "kind": "video"}])], df.schema)
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_turns(bad).collect()


def test_digests_against_plain_python(spark):
    texts = ["", None, "</turn>\n<turn>assistant\nx", "\\", "\\<", "\\\\<turn>", "a\nb", "é😀" * 50, "</turn>", "\\n"]
    rows = [(k, t, ["user", "assistant", "sys\ntem", "a\\<b"][t % 4], texts[(k + t) % len(texts)]) for k in range(20) for t in range(k + 1)]
    rows += [(99, t, "assistant", f"turn {t} </turn>") for t in range(3000)] + [(98, None, None, None), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS attachments")
    got = chat.digest_conversations(chat.format_turns(df.withColumn("parts", chat.text_part(df.text)))).collect()
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    assert len(got) == len(groups)
    for r in got:
        turns = sorted(groups[r.conv_id])
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    none = none_of(df).withColumn("parts", chat.text_part(df.text))
    assert chat.digest_conversations(chat.format_turns(none)).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_letters_with_context(file):
    """Letters whose lower case or normal form depends on their neighbours, before sentence marks too."""
    path, rng = public_tokenizers.path(file), random.Random(8)
    mine, library = tokens.Encoder(path), Tokenizer.from_file(path)
    letters = "\u0130\u0131\u03a3\u03c3\u0301\u0327\u00c5\u212b\u1e9e\ufb01\u0345\u1100\u1161\uac00aBz\u00e9\u4e2d.,;:!?  \n'9"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 24))) for _ in range(20_000)]
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want) if np.frombuffer(mine(t), mine.dtype).tolist() != w.ids]
    assert wrong == []
