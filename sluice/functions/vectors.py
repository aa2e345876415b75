"""Vector functions (F12 cosine / certainty, F13 l2_normalize, E1 embed).

Column expressions stay JVM-side. The hashed bag-of-words embedder lower-cases
texts and parts their tokens by blanks, in Spark SQL or, for ASCII texts, byte by
byte in the Arrow UDF (one string a text goes to Python, not one a token); the UDF
hashes the distinct tokens of a batch and counts the buckets of its rows, so
nothing is shuffled or sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBED_DIM = 384          # fixed value: dimensions of the default embedding model
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two numeric arrays, computed in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    ad = F.transform(a, lambda x: x.cast("double"))
    bd = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(ad, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(bd, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (na * nb)


def certainty(cos: Column) -> Column:
    """Similarity in 0..1 as reported by the vector store: (1 + cos) / 2."""
    return (F.lit(1.0) + cos) / 2.0


def l2_normalize(v: Column | str) -> Column:
    """Unit vector (F13); a zero vector stays zero."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double")), F.lit(0.0),
                           lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float"))


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens (letters and digits), empty pieces removed."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


# ASCII bytes as ``tokens`` takes them: letters in lower case, digits, else a blank
ASCII_TOKENS = np.array([ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]
                        + list(range(128, 256)), dtype=np.uint8)


def spaced_tokens(text: Column | str) -> Column:
    """``tokens`` as one string, parted by one blank or more; blanks that part
    tokens in the text stay as they are, which spares most replacements. An
    ASCII text is left to ``ascii_tokens``."""
    text = F.col(text) if isinstance(text, str) else text
    ascii_only = F.is_valid_utf8(text) & (F.length(text) == F.octet_length(text))
    return F.when(ascii_only, text).otherwise(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]+", " "))


def ascii_tokens(texts: pa.Array) -> pa.Array:
    """The ASCII letters of ``texts`` in lower case, blanks for all other ASCII
    but digits; a text of ``spaced_tokens`` that is not ASCII stays as it is."""
    valid, offsets, data = texts.buffers()
    if data is None:
        return texts
    spaced = pa.py_buffer(ASCII_TOKENS[np.frombuffer(data, dtype=np.uint8)])
    return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, spaced], offset=texts.offset)


KNOWN_TOKENS = 500_000      # tokens whose hash a Python worker remembers
COUNT_ROWS = 1024           # texts counted at a time
_known: dict[bytes, int] = {}


def token_hash(token: bytes) -> int:
    """First 32 bits of md5(token); -1 for the empty piece."""
    h = _known.get(token)
    if h is None:
        if len(_known) >= KNOWN_TOKENS:
            _known.clear()
        h = _known[token] = int.from_bytes(hashlib.md5(token).digest()[:4], "big") if token else -1
    return h


def bucket_counts(texts: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """Tokens of each text (see ``spaced_tokens``) by bucket (hash modulo
    ``dim``), as matrices of up to ``COUNT_ROWS`` texts; a null text counts as
    an empty one."""
    tokens = pc.split_pattern(ascii_tokens(texts), " ")
    size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    end = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    words = tokens.flatten()
    words = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).dictionary_encode()
    hashes = np.array([token_hash(t) for t in words.dictionary.to_numpy(zero_copy_only=False)], dtype=np.int64)
    bucket = np.where(hashes < 0, dim, hashes % dim)            # column dim takes the empty pieces
    which = words.indices.to_numpy()
    for i in range(0, len(texts), COUNT_ROWS):
        n = min(COUNT_ROWS, len(texts) - i)
        at = np.repeat(np.arange(n) * (dim + 1), size[i:i + n]) + bucket[which[end[i]:end[i + n]]]
        yield np.bincount(at, minlength=n * (dim + 1)).reshape(n, dim + 1)[:, :dim]


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    v = counts.astype(np.float64)
    n = np.sqrt((v * v).sum(axis=1))
    n[n == 0] = 1.0
    return v / n[:, None]


def _dense(dim: int):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pa.Array) -> pa.Array:
        flat = [unit_rows(c).astype(np.float32).ravel() for c in bucket_counts(texts, dim)]
        n = len(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim),
                                        pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32)),
                                        mask=texts.is_null() if texts.null_count else None)
    return vectors


def _sparse(dim: int):
    @F.arrow_udf("array<struct<dim_index:int,weight:double>>")
    def vectors(texts: pa.Array) -> pa.Array:
        size, index, weight = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for c in bucket_counts(texts, dim):
            row, b = np.nonzero(c)
            size.append(np.bincount(row, minlength=len(c)))
            index.append(b.astype(np.int32))
            weight.append(unit_rows(c)[row, b])
        cells = pa.StructArray.from_arrays([pa.array(np.concatenate(index)), pa.array(np.concatenate(weight))],
                                           names=["dim_index", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(size)).astype(np.int32)), cells)
    return vectors


def embed(text: Column | str, dim: int = EMBED_DIM, model=None) -> Column:
    """``model`` (a U3 hook from text to array<float>) or the default
    offline embedder: hashed bag of words, L2-normalised; null for null."""
    if model is not None:
        return model(F.col(text) if isinstance(text, str) else text)
    return _dense(dim)(spaced_tokens(text))


def embed_sparse(df: DataFrame, id_col: str, text_col: str, dim: int = EMBED_DIM) -> DataFrame:
    """E1 in sparse form: one row per (id, dim_index) with the unit weight.

    Narrow: a text is counted where its row is read, neither texts nor cells
    are shuffled."""
    return df.select(id_col, F.inline(_sparse(dim)(spaced_tokens(text_col))))


@F.arrow_udf(T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("dim_sum", T.LongType())]))
def used_dims(vectors: pa.Array) -> pa.Array:
    """How many entries of a vector are not 0, and the sum of their (0-based)
    positions; null for a null vector."""
    n = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    values = vectors.flatten()
    at = np.flatnonzero(values.fill_null(0).to_numpy(zero_copy_only=False))
    row = np.searchsorted(first + n, at, side="right")
    none = vectors.is_null().to_numpy(zero_copy_only=False)
    dims = np.bincount(row, minlength=len(n)).astype(np.int32)
    total = np.bincount(row, weights=at - first[row], minlength=len(n)).astype(np.int64)
    return pa.StructArray.from_arrays([pa.array(dims, mask=none), pa.array(total, mask=none)], names=["dims", "dim_sum"])
