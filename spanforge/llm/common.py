"""What the operators of this subpackage share: white space, shared folders, vectorised hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.storage import shared_folder, written

#: The white space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS_REGEX = r"[\x20\x09-\x0D]+"

__all__ = ["Windows", "Words", "checkpointed", "chunks", "mix", "native_words", "numbered", "shared_folder", "signed", "squeezed", "table", "texts_of", "without", "written"]

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (0x2F0B4C47, 0x5851F42D)  # of the two polynomials of a word
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster names; only where none is named, a local one is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(docs: DataFrame, **columns: Column) -> DataFrame:
    """A written table of ``columns`` (none: all, as one column ``__row``) and ``row``, a number that no other row has.

    Ids may be null or repeated; the number says which row is meant. It is stored, so that it stays the same whatever is
    read or computed again, and rows with one id that stand later have larger numbers within a file.
    """
    chosen = [c.alias(name) for name, c in columns.items()] or [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")]
    return written(docs.select(*chosen, F.monotonically_increasing_id().alias("row")))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of a table ``numbered`` whose numbers are not in ``gone`` (row), with all their columns.

    ``gone`` is written, so its size is known: small, it is broadcast; else the join shuffles.
    """
    gone = written(gone.select(F.col("row").alias("__gone")))
    return rows.join(gone, rows["row"] == gone["__gone"], "left_anti").select("__row.*")


def squeezed(text: Column | str) -> Column:
    """The text without white space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_REGEX, "")


def native_words(text: Column | str) -> Column:
    """Words as an array, JVM side."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_REGEX), "")


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def _field_power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo the prime, ``n`` at least."""
    have = _powers.get(key := f"f{base}", np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), int(_PRIME))) % _PRIME])
    _powers[key] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some texts that lie one after the other in ``data``.

    ``starts``/``ends``: bytes of each word; ``first``: index of each text's first word, with one more at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        word = np.zeros(n + 2, dtype=bool)
        word[1:-1] = _IS_WORD[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        now, before = word[1:], word[:-1]
        self.starts = np.flatnonzero(now & (~before | cut))
        self.ends = np.flatnonzero(before & (~now | cut))
        self.first = np.searchsorted(self.starts, offsets)
        self.data = data

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands: two polynomials over a prime field, mixed."""
        if not len(self):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        off = np.cumsum(length) - length
        at = np.arange(off[-1] + length[-1])
        signs = self.data[at + np.repeat(self.starts - off, length)].astype(np.uint64) + np.uint64(1)
        at -= np.repeat(off, length)
        one, two = (np.add.reduceat(signs * _field_power(base, int(length.max()))[at], off) % _PRIME for base in _BASES)
        return mix((one << np.uint64(31) | two) ^ mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


class Windows:
    """Hashes of short runs of words, from one prefix sum modulo 2^64. Where long runs are to be told apart, the
    operators take a digest of the words themselves."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * _power("p", _BASE, n), out=self.prefix[1:])
        self.inverse = _power("i", _INVERSE, n + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a string column with their bytes, about ``most`` bytes at once; one text is never cut."""
    data, offsets = texts_of(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, type=pa.int64())
