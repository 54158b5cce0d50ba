"""Packing documents into sequences by vector best-fit.

Tokens come from a public tokenizer file. Where its own description shows that its pieces never reach over white space
(``_WORDWISE``), words are encoded one by one and remembered (at most ``_MOST_WORDS`` of them a worker), which gives the
ids of whole texts at a fraction of the time; letters in lower case and a space before a stop then save different words,
if the tokenizer folds case and parts letters from stops. Any other tokenizer encodes whole texts. A document is its ids
and the end id; one that is longer than a sequence is cut into full pieces and a rest.

Pieces are dealt by a hash into shards of bounded size, some 16 MB of text each, and every shard is packed by itself: in
decreasing order, each piece goes to the open sequence that can take it in every dimension (tokens, documents, attention
cost, the sum of squared lengths) and whose residual is best: least weighted norm of what would be left, or largest
weighted dot product of the piece with it, weights being the mean demand in each dimension. A shard wastes at most one
sequence or so, whatever the number of shards. Only ids' lengths and checksums are shuffled.

By default a shard's sequences may hold as many pieces as the least of ``CROWDS`` times the mean with which no sequence
more is needed than by tokens alone, so that tiny pieces are spread over many sequences instead of filling a few.
Attention cost is limited to that of one full piece, which every full sequence may need, so it steers the choice and
forbids nothing. Callers can set either limit, at the cost of more sequences. Of equally good sequences the first opened
is taken.

Edge cases: null text is empty, an empty text is the end id alone; repeated rows are packed each; null ids pass through;
an empty table gives an empty result. A piece must fit into an empty sequence, else ``ValueError``.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks

SHARD_BYTES = 16 << 20
#: Pieces a sequence may hold, as multiples of the mean by tokens.
CROWDS = (8, 16)
TIE = 1e-12
_MOST_WORDS = 600_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The description of a tokenizer whose pieces lie within words, whatever its vocabulary.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class WordEncoder:
    """Ids of texts, word by word; words are remembered in one flat array. ``wordwise``: whether the tokenizer allows it."""

    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as source:
            told = json.load(source)
        self.wordwise = all(told.get(k) == v for k, v in _WORDWISE.items())
        suffix = told.get("model", {}).get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.is_end[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = _Rows(np.int64), _Rows(np.int64), _Rows(np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters alone are one piece each, which ends where an id says so; the others are encoded apart."""
        texts = [w.decode() for w in words]
        alone = [w for w in texts if w.isalpha()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(alone)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(alone) or (len(ends) and ends[-1] != len(ids)):
            alone, ids, ends = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = texts if not alone else [w for w in texts if not w.isalpha()]
        if rest:
            found = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(rest)) if found.ids else np.zeros(len(rest), np.int64)
            ids, ends = np.append(ids, np.array(found.ids, dtype=np.int64)), np.append(ends, len(ids) + np.cumsum(counts))
        order = words if not alone else [b for b, w in zip(words, texts) if w.isalpha()] + [b for b, w in zip(words, texts) if not w.isalpha()]
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        lengths = np.diff(ends, prepend=0)
        self.starts.add(self.flat.n + ends - lengths)
        self.lengths.add(lengths)
        self.flat.add(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, each with the end id, and the texts' offsets in them."""
        if not self.wordwise:
            raw, at = data.tobytes(), offsets.tolist()
            found = [x.ids for x in self.tokenizer.encode_batch_fast([raw[b:e].decode() for b, e in zip(at[:-1], at[1:])], add_special_tokens=False)]
            return np.array([i for ids in found for i in [*ids, end_id]], dtype=np.uint32), np.append(0, np.cumsum([len(ids) + 1 for ids in found]))
        data, offsets = _simpler(data, offsets)
        words, first = _split(data, offsets), Words(data, offsets).first
        if len(self.known) > _MOST_WORDS or self.flat.n > 16 * _MOST_WORDS:
            self.clear()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if (new := np.flatnonzero(at < 0)).size:
            self._learn(list(dict.fromkeys(words[i] for i in new)))
            at[new] = np.fromiter((self.known[words[i]] for i in new), dtype=np.int64, count=len(new))
        lengths = self.lengths.held[at]
        ends = np.cumsum(lengths)
        flat = self.flat.held[np.repeat(self.starts.held[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.append(0, ends)[first]  # where each text begins and ends among the ids of words
        return np.insert(flat, stops[1:], np.uint32(end_id)), stops + np.arange(len(stops))


def pieces(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), 1 << 21):
                ids, at = encoder.encode(data, offsets, end_id)
                n = np.diff(at)
                count = -(-n // most)
                whose = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * most
                length = np.minimum(most, n[whose] - start)
                raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).data
                begin = 4 * (at[whose] + start)
                crc = [zlib.crc32(raw[b:e]) for b, e in zip(begin.tolist(), (begin + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(whose)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, PIECE_SCHEMA)


def _simpler(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same ids from fewer different words: ASCII letters in lower case, and a space between letter and stop.

    The tokenizer ignores case and never joins a letter or digit with what is neither, so no id changes; texts that
    might hold a special token stay as they are.
    """
    if b"<|" in (raw := data.tobytes()):
        return data, offsets
    data = np.frombuffer(raw.lower(), dtype=np.uint8)
    at = np.flatnonzero(_ALNUM[data[:-1]] & _STOP[data[1:]]) + 1
    return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)


_ALNUM, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_STOP[[*b".,;:!?#$%&*|"]] = True


def _split(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Words of all texts in order; a text's end ends a word too."""
    raw = data.tobytes()
    words: list[bytes] = []
    for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        words += raw[b:e].split()
    return words


def pack(lengths: np.ndarray, capacity: tuple[float, float, float], policy: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. ``capacity``: tokens, documents and attention cost of a sequence."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, offset
    cap = np.array(capacity, dtype=float)
    demand = np.stack([lengths / cap[0], np.full(n, 1 / cap[1]), np.square(lengths.astype(float)) / cap[2]], axis=1)
    if (demand > 1 + 1e-12).any():
        raise ValueError("a piece does not fit into an empty sequence")
    weight = demand.mean(axis=0) / demand.mean(axis=0).sum()
    order = np.argsort(-lengths, kind="stable")
    left, number, used = np.zeros((n, 3)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_, made, least = 0, 0, demand.min(axis=0)
    for k, i in enumerate(order.tolist()):
        v, room = demand[i], left[:open_]
        fits = np.flatnonzero((room[:, 0] >= v[0] - 1e-12) & (room[:, 1] >= v[1] - 1e-12) & (room[:, 2] >= v[2] - 1e-12))
        if fits.size:
            r = room[fits]
            cost = np.square(r - v) @ weight if policy == "norm" else -((r * v) @ weight)
            ties = fits[cost <= cost.min() + TIE]
            b = int(ties[np.argmin(number[ties])])
        else:
            b, open_ = open_, open_ + 1
            left[b], number[b], used[b], made = 1.0, made, 0, made + 1
        sequence[i], offset[i] = number[b], used[b]
        left[b] -= v
        used[b] += lengths[i]
        if (left[b] < least - 1e-12).any():  # full: the last open one takes its place
            open_ -= 1
            left[b], number[b], used[b] = left[open_], number[open_], used[open_]
    return sequence, offset


def packer(most: int, documents: int | None, attention: float | None, policy: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths, limit = rows["length"].to_numpy(), (float(most), float(documents or most), float(attention or most * most))
        sequence, offset = pack(lengths, limit, policy)
        mean = -(-len(rows) // max(1, int(sequence.max()) + 1))
        for crowd in () if documents else CROWDS:
            closer = pack(lengths, (limit[0], min(limit[1], float(crowd * mean)), limit[2]), policy)
            if closer[0].max() == sequence.max():
                sequence, offset = closer
                break
        return rows.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return shard


def best_fit(
    docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1, documents: int | None = None, attention: float | None = None,
    policy: str = "norm", doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``documents`` and ``attention`` limit the pieces of a sequence and the sum of their squared lengths; None: as told
    above.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = pieces(docs, tokenizer, most, end_id, doc_id, text).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(packer(most, documents, attention, policy), PIECE_SCHEMA + ", sequence_id long, offset long")
