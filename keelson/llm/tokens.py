"""Token ids of whole texts from the files of public tokenizers, with repeated pieces encoded once.

Both vocabularies used here split a text before they merge inside the parts, and a part never
reaches over a single white-space character that stands between two others. A text is cut there,
at blanks and line feeds, and between a Latin letter and an ASCII mark, where a part ends as well.
Pieces keep the white space in front of them. The texts of a part of a batch are cut
together, in their UTF-8 bytes; each of their distinct pieces is looked up once, and encoded once per worker.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

MAX_PIECES, ROWS_AT_ONCE, BYTES_AT_ONCE = 250_000, 400, 2**22
_ASCII_LETTERS = np.array([chr(k).isalpha() for k in range(128)] + [False] * 128)
# white space beyond ASCII, by its two or three bytes
_WIDE = [int.from_bytes(c.encode()) for c in map(chr, range(128, 0x3001)) if c.isspace()]
# above this, lower case and normal forms may depend on the neighbours of a letter
_PLAIN_LETTERS = "\u0130"


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece -> its ids, both as bytes. When full, it is set aside for what still occurs and begun anew.

    A piece of plain letters is one part of the text for either vocabulary, so it goes to the
    merges at once.
    """

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner, self.aside = owner, {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MAX_PIECES:
            self.aside = dict(self)
            self.clear()
        out = self.aside.get(piece)
        if out is None:
            out = self.owner.piece(piece.decode())
        self[piece] = out
        return out


def _not_wide(data: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether the character that ends before, or begins at, each of the places isn't white space beyond ASCII."""
    fine = np.ones(len(at), bool)
    beyond = np.flatnonzero(data[at - before] >= 128)
    at = at[beyond].astype(np.int64)
    for n in (2, 3):
        first = at - n if before else at
        # cut short by an end of the data, it is a character of another length
        inside = (first >= 0) & (first + n <= len(data))
        code = sum(data[np.where(inside, first + k, 0)].astype(np.int64) << 8 * (n - 1 - k) for k in range(n))
        fine[beyond[inside & np.isin(code, _WIDE)]] = False
    return fine


def _cuts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts that lie between the offsets begin, ascending, with the end of the data.

    ``marks`` tells for every byte whether a piece may begin with it after a letter."""
    space = np.flatnonzero((data == 32) | (data == 10))
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    space = space[~ends[space] & ~ends[space + 1]]
    space = space[(data[space - 1] > 32) & (data[space + 1] > 32)]
    space = space[_not_wide(data, space, True) & _not_wide(data, space + 1, False)]
    ends[space] = True
    mark = np.flatnonzero(marks[data])
    mark = mark[(mark > 1) & ~ends[mark]]
    last, first = data[mark - 1], data[mark - 2]
    accented = (first == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)  # not the signs of times and division
    ends[mark[_ASCII_LETTERS[last] | accented]] = True
    return np.flatnonzero(ends)


class Encoder:
    """Ids of a text as little-endian unsigned integers, 16 bits wide where the vocabulary allows."""

    def __init__(self, file: str):
        self.library = tokenizers.Tokenizer.from_file(file)
        self.model = self.library.model
        wide = self.library.get_vocab_size(with_added_tokens=True) > 2**16
        self.dtype = "<u4" if wide else "<u2"
        self.pack = (lambda ids: array("I" if wide else "H", ids).tobytes())
        # a vocabulary with word ends drops white space and case, the other keeps both
        self.lower = getattr(self.model, "end_of_word_suffix", None) is not None
        self.shown = _byte_letters()
        # an apostrophe may join the letters behind it, and a special token has marks of its own
        special = "'" + "".join(t.content for t in self.library.get_added_tokens_decoder().values())
        self.marks = np.isin(np.arange(256), [ord(c) for c in punctuation if c not in special])
        self.known = _Pieces(self)

    def exact(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        prefix = text[0] if text[0] in " \n" else ""
        word = text[len(prefix) :]
        if word.isalpha() and (word.isascii() or max(word) < _PLAIN_LETTERS):
            return self.letters(word, prefix)
        return self.exact(text)

    def letters(self, word: str, prefix: str) -> bytes:
        before = self.known[b"\n"] if prefix == "\n" and not self.lower else b""
        form = word.lower() if self.lower else word
        if not form.isascii():
            form = form.encode().decode("latin-1").translate(self.shown)
        if prefix == " " and not self.lower:
            form = self.shown[32] + form
        return before + self.pack([t.id for t in self.model.tokenize(form)])

    def __call__(self, text: str) -> bytes:
        return self.all(pa.array([text], pa.string()))[0]

    def all(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text; a NULL text has none."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cuts = _cuts(data, offsets, self.marks)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        pieces = pieces.dictionary_encode()
        distinct = list(map(self.known.__getitem__, pieces.dictionary.to_pylist()))
        joined = pa.array(distinct, pa.large_binary()).take(pieces.indices)
        at = np.frombuffer(joined.buffers()[1], np.int64)[np.searchsorted(cuts, offsets)]
        ids = memoryview(joined.buffers()[2])
        return [bytes(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def encoder(file: str) -> Encoder:
    """One encoder per worker process and file. It hangs on the library's module, because code
    that travels with a task is loaded anew for every task."""
    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if file not in kept:
        kept[file] = Encoder(file)
    return kept[file]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a few hundred rows, so that little is held as Python objects at a time."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def _by_bytes(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts with some megabytes of text, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(batches: Iterator[pa.RecordBatch], file: str, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], str]]:
    """Parts of the batches with the ids of their texts; a NULL text is empty."""
    encode = encoder(file)
    for whole in batches:
        at = whole.schema.get_field_index(text)
        for batch in _by_bytes(whole, at):
            yield batch, encode.all(batch.column(at)), encode.dtype
