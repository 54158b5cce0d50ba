"""Personal data: fixed forms first, then bootstrapped contextual extraction.

Seeds are the matches of four fixed forms (email, ip, card, phone), and, as seeds of a fifth kind, keys and digests as
they are written by programs: ``KEY_LENGTHS`` lower-case hexadecimal signs (secret). Every identifier-like string, seed or
not, has lexical patterns: the word before it, the two and the three words before it, and the word before with the word
after (case and digits folded). Patterns and instances make a bipartite graph with one edge for each different pair.

Spark scores the graph round by round. An instance's score for its kind is 1 for a seed, else ``1 - prod(1 - confidence)``
over the patterns accepted so far. A pattern's confidence for a kind is the sum of its instances' scores for that kind
over the number of all its instances, of whatever kind or none, with a pseudo-count; it is accepted when that reaches
``CONFIDENCE`` and the scores add up to ``SUPPORT`` different instances. So instances that a round has found bear out
patterns that no round before could have accepted. Rounds go on until none is new, ``ROUNDS`` at most.

Added as spans are instances of a loose form that an accepted pattern of the same kind introduces. Secrets are no base
kind, so they are added ones, whether seeds or not, and only where an accepted pattern introduces them: a digest in no
telling context stays out. Base spans always stay, and the counts and the digest are of base spans alone.

Places are code points, end exclusive. Only ids, places and hashes leave the tasks that read the texts. Hot patterns and
instances are summed before each shuffle. A context word longer than ``CONTEXT`` signs counts by its ``CONTEXT`` signs
nearest to the identifier, so that every step is linear in the text's length. Edge cases: null text is empty; repeated
rows are searched each, and count once in the graph; a null id passes through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # of them with a fixed form of the contract
SUPPORT, CONFIDENCE, ROUNDS, PSEUDO = 5.0, 0.8, 8, 1.0
KEY_LENGTHS = (32, 40, 64)
CONTEXT = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms of the contract's patterns: the next sign is never one that a shorter run could give back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Loose forms, by kind, of what a pattern may introduce.
_LOOSE = (
    re.compile(r"(?<![^\s<>,;(\[])[^\s@<>,;()\[\]]++@[^\s@<>,;()\[\]]++"),
    re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])"),
    re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[0-9A-Za-z_+/-]{20,}={0,2}"),
)
_KEY = re.compile("|".join(f"[0-9a-f]{{{n}}}" for n in KEY_LENGTHS))
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_FOLD = str.maketrans("123456789", "0" * 9)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, in order."""
    spans: list[tuple[int, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            last = found.end()
            spans.append((start, 0, last))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part) <= 3 and int(part or "0") <= 255 for part in (x.lstrip("0") for x in m[0].split("."))):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _fold(word: str) -> str:
    return word.lower().translate(_FOLD)


class _Words:
    """Where a text's words are; the words next to a place."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [b for b, _ in spans], [e for _, e in spans]

    def patterns(self, start: int, end: int) -> list[int]:
        text, k = self.text, bisect_left(self.starts, start) - 1  # the last word that begins before the identifier
        left = [_fold(text[max(self.starts[i], min(self.ends[i], start) - CONTEXT) : min(self.ends[i], start)]) for i in range(max(0, k - 2), k + 1)]
        if not left:
            return []
        out = [_hash("L" * n, *left[-n:]) for n in range(1, len(left) + 1)]
        after = bisect_right(self.ends, end)  # the first word that ends behind it
        if after < len(self.ends):
            at = max(self.starts[after], end)
            out.append(_hash("LR", left[-1], _fold(text[at : min(self.ends[after], at + CONTEXT)])))
        return out


Mention = tuple[int, int, int, bool, int, list[int]]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """(start, kind, end, seed, instance, patterns) of all identifier-like strings; kind -1: of no loose form."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    words, out = _Words(text), []

    def put(s: int, k: int, e: int, seed: bool) -> None:
        out.append((s, k, e, seed, _hash(k, text[s:e]), words.patterns(s, e)))

    for s, k, e in base:
        put(s, k, e, True)
    taken = sorted((s, e) for s, _, e in base)
    loose = sorted((m.start(), k, m.end()) for k, form in enumerate(_LOOSE) for m in form.finditer(text))
    others = [(m.start(), -1, m.end()) for m in _TOKEN.finditer(text)]
    for found in (loose, others):
        kept, t = [], 0
        for s, k, e in found:
            while t < len(taken) and taken[t][1] <= s:
                t += 1
            inside = [x for x in taken[t : bisect_left(taken, (e,))] if x[1] > s]
            # A key may hold a base span, as digits in it can pass for a card; nothing else overlaps another.
            if all(k == BASE and s <= b and end <= e for b, end in inside) and (not kept or kept[-1][1] <= s):
                kept.append((s, e))
                put(s, k, e, k == BASE and bool(_KEY.fullmatch(text, s, e)))
        taken = sorted(taken + kept)
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([*_SPAN, ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_SEARCHED = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: int, kind: int, end: int>>, "
    "mentions array<struct<start: int, kind: int, end: int, seed: boolean, instance: long, patterns: array<long>>>"
)


def _nested(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """A column of lists of structs, built column by column."""
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    columns = list(zip(*(x for r in rows for x in r))) or [[] for _ in kind]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "base", "mentions"]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            ids, texts = batch.column(0).slice(at, 200), batch.column(1).slice(at, 200)
            counts, digests, bases, found = [[] for _ in range(BASE)], [], [], []
            for text in texts:
                text = text.as_py() or ""
                base = base_spans(text)
                for k in range(BASE):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                bases.append(base)
                found.append(mentions(text, base))
            arrays = [ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), _nested(bases, _SPAN), _nested(found, _MENTION)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def accepted_patterns(edges: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence of those patterns that may introduce identifiers.

    ``edges``: pattern, instance, kind, seed; one row a pair. A pattern can only be accepted for a kind of which
    ``support`` different instances, found or not yet, stand under it; the graph is cut down to such patterns first.
    """
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    kinds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("own"), F.sum(F.col("seed").cast("long")).alias("seeds"))
    able = kinds.join(sizes, "pattern").where((F.col("own") >= support) & (F.col("own") >= confidence * (F.col("n") + PSEUDO)))
    able = written(able)
    own = edges.where("kind >= 0 and not seed").join(able.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("pattern", "kind", "instance")
    own = written(own)
    rated = able.withColumn("confidence", F.col("seeds") / (F.col("n") + PSEUDO)).withColumn("weight", F.col("seeds").cast("double"))
    enough = (F.col("confidence") >= confidence) & (F.col("weight") >= support)
    good, before = written(rated.where(enough).select("pattern", "kind", "confidence")), -1
    for _ in range(rounds - 1):
        if (now := good.count()) == before:
            break
        before = now
        scores = (
            own.join(good, ["pattern", "kind"]).groupBy("instance")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))).alias("score"))
        )
        gained = own.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
        weight = F.col("seeds") + F.coalesce("gained", F.lit(0.0))
        rated = able.join(gained, ["pattern", "kind"], "left").withColumn("weight", weight).withColumn("confidence", F.col("weight") / (F.col("n") + PSEUDO))
        good = written(rated.where(enough).select("pattern", "kind", "confidence"))
    return good


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans."""
    searched = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_search, _SEARCHED)
    searched = written(searched.withColumn("row", F.monotonically_increasing_id()))
    listed = searched.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = listed.select(F.explode("patterns").alias("pattern"), "instance", "kind", "seed").groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed"))
    good = accepted_patterns(written(edges), support, confidence, rounds)
    added = (
        listed.where(f"kind >= 0 and (not seed or kind >= {BASE})").select("row", "start", "kind", "end", F.explode("patterns").alias("pattern"))
        .join(good, ["pattern", "kind"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    )
    out = searched.join(written(added), "row", "left").withColumn("added", F.coalesce("added", F.expr("array()")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", "added")), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    n_added = F.size("added").cast("long")
    return out.select(
        "doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", F.array_join(spans, ",").alias("spans"), n_added.alias("n_added"),
        (F.size("base") + n_added).cast("long").alias("n_spans"),
    )
