"""Word positions and word hashes of whole Arrow text columns, in numpy.

The free-style operators of this subpackage run inside ``mapInArrow`` tasks.
They read the UTF-8 bytes of a column in slices of whole documents (about
``SLICE_BYTES`` each, a longer document alone), so the memory of a task does
not depend on the number of rows in its partition. Nothing here starts a
Spark job.

Null text reads as empty text: no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
PIECE_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64 constants): spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_codes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


BYTE_CODE = _byte_codes()
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=_U)
    a[0] = 1
    return np.multiply.accumulate(a)


_POW: dict[str, np.ndarray] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i (mod 2^64) for i < n; grown on demand, kept small."""
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, PIECE_BYTES)
        if size > 4 * PIECE_BYTES:          # a single huge word: do not keep
            return _powers(BASE, size), _powers(BASE_INV, size)
        _POW["p"], _POW["q"] = _powers(BASE, size), _powers(BASE_INV, size)
    return _POW["p"], _POW["q"]


def space_table() -> np.ndarray:
    """True for the separators 0x20 and 0x09-0x0D (words are the rest)."""
    t = np.zeros(256, dtype=bool)
    t[0x20] = True
    t[0x09:0x0E] = True
    return t


def alnum_table() -> np.ndarray:
    """True for separators of alphanumeric words: every ASCII byte but 0-9
    and letters; bytes of code points above 0x7F are word bytes."""
    t = np.ones(256, dtype=bool)
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        t[lo:hi + 1] = False
    return t


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


SPACES = space_table()
NON_ALNUM = alnum_table()
LOWER = lower_table()


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=width)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def as_text(col: pa.Array) -> pa.Array:
    """A binary column as a string column of the same bytes, not checked for
    UTF-8 (Spark's strings may hold any bytes)."""
    big = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    return pa.Array.from_buffers(pa.large_string() if big else pa.string(), len(col), col.buffers(),
                                 offset=col.offset)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many ``_`` behind it as no column's name has."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


class Slice:
    """Words of consecutive documents ``first .. first + n_docs``.

    ``buf``: their bytes (case-folded if asked); ``starts``/``ends``: byte
    range of each word in ``buf``; ``doc``: document of each word, relative
    to ``first``; ``word_off``: n_docs + 1 word offsets.
    """

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets
        self.n_docs = len(offsets) - 1
        if len(buf):
            word = ~sep[buf]
            edge = np.zeros(len(buf) + 1, dtype=bool)
            edge[offsets] = True                       # a document starts (or all end) here
            begin = word.copy()
            begin[1:] &= ~word[:-1] | edge[1:-1]
            stop = word.copy()
            stop[:-1] &= ~word[1:] | edge[1:-1]
            self.starts = np.flatnonzero(begin)
            self.ends = np.flatnonzero(stop) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.word_off = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.word_off)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word's bytes, or of its first ``prefix`` bytes."""
        out = np.empty(len(self), dtype=_U)
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        i, n = 0, len(self)
        with np.errstate(over="ignore"):
            while i < n:
                j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + PIECE_BYTES, "right")))
                s0 = self.starts[i]
                piece = self.buf[s0:self.ends[j - 1]]
                p, q = _pow_tables(len(piece))
                acc = np.zeros(len(piece) + 1, dtype=_U)
                np.cumsum(BYTE_CODE[piece] * p[:len(piece)], out=acc[1:])
                s, e = self.starts[i:j] - s0, ends[i:j] - s0
                out[i:j] = (acc[e] - acc[s]) * q[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
                i = j
            return mix(out)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.word_off[1:], self.counts) - np.arange(len(self))

    def words_of(self, i: int, j: int) -> list[bytes]:
        b = self.buf
        return [b[s:e].tobytes() for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist())]


def grams(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of the ``m`` hashes from each position; the last m - 1 positions
    have none. Order-sensitive; callers drop grams that cross documents."""
    n = len(h) - m + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        mult = mix(np.arange(1, m + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
        g = h[:n] * mult[0]
        for k in range(1, m):
            g += h[k:n + k] * mult[k]
        return mix(g + _U(m))


def slices(col: pa.Array, sep: np.ndarray = SPACES, fold=None,
           limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into ``Slice`` objects of whole documents. ``fold``:
    a byte map, or a function of the bytes that keeps their number."""
    raw, off = column_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        buf = raw[off[i]:off[j]]
        if fold is not None:
            buf = fold(buf) if callable(fold) else fold[buf]
        yield Slice(i, buf, off[i:j + 1] - off[i], sep)
        i = j


def signed(h: np.ndarray) -> np.ndarray:
    """The hash as Spark's long."""
    return h.astype(_U).view(np.int64)


def fold_latin(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte letters U+00C0 to U+00DE."""
    out = LOWER[buf]
    if len(buf) > 1:
        big = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][big] += 0x20
    return out


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, folded like ``fold_latin``."""
    out = []
    for w in words:
        b = fold_latin(np.frombuffer(w.encode(), dtype=np.uint8))
        s = Slice(0, b, np.array([0, len(b)]), NON_ALNUM)
        out.append(s.hashes()[0])
    return np.array(out, dtype=_U)
