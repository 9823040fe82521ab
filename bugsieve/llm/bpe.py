"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its texts in blocks of bounded size.  The distinct words of a block that have not
been seen yet form one corpus of symbols; an inverted index leads from the rank a pair of
neighbours merges to, to the places of such pairs.  Ranks are replayed in order.  One step takes
the lowest rank and merges, in numpy, its places in all words, from the left; then only
the pairs with the neighbours are new.  Where a merge brings about a pair of lower rank, further
places of the word wait for the next step, so that pair comes first: each word gets the ids of
merging it by itself, lowest rank first and leftmost among equals.  A run of n equal letters takes some
log n steps.

Words keep their ids in a store of bounded size, so a frequent word is merged once per task
however many texts hold it.  Nothing is shuffled or gathered.  Only the rank table, whose
size is fixed, is sent to the executors.

Cases: a null or empty text has no ids.  Texts are encoded whole.  Repeated rows and null ids
keep their own rows; an input column named like an output is replaced.  Special tokens are text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugsieve.llm.common import text_batches

STORE = 200_000  # words whose ids a task keeps at the start of a block
BLOCK = 1_000_000  # words of texts, repeats included, that are looked up and merged together
_NONE = np.iinfo(np.int64).max


class Ranks:
    """A rank file as tables: ids of single bytes, bytes of ids, and the pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: b for b, r in rank.items()}
        self.single = np.full(256, -1, np.int64)
        pairs = {}
        for token, r in rank.items():
            if len(token) == 1:
                self.single[token[0]] = r
            for i in range(1, len(token)):
                left, right = rank.get(token[:i]), rank.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = keys.argsort()
        self.keys = np.append(keys[order], _NONE)
        self.merged = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], _NONE)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank each pair merges to, or ``_NONE``."""
        wanted = left << 32 | right
        at = self.keys.searchsorted(wanted)
        return np.where(self.keys[at] == wanted, self.merged[at], _NONE)


def merge_words(words: Iterable[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit numbers, all words merged together."""
    words = list(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    small = np.int32 if n < 1 << 31 else np.int64
    symbol = ranks.single[np.frombuffer(b"".join(words), np.uint8)]  # -1: part of the symbol before
    owner = np.repeat(np.arange(len(words), dtype=small), sizes)
    after = np.arange(1, n + 1, dtype=small)  # -1 at the end of a word, and before at its start
    before = np.arange(-1, n - 1, dtype=small)
    ends = np.cumsum(sizes)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1

    index: dict[int, list] = {}
    places = np.flatnonzero(after >= 0)
    found = ranks.of_pairs(symbol[places], symbol[places + 1])
    places, found = places[found != _NONE], found[found != _NONE]
    order = found.argsort(kind="stable")
    places, found = places[order], found[order]
    cuts = np.flatnonzero(np.diff(found)) + 1
    for group, rank in zip(np.split(places, cuts), found[np.append(0, cuts)].tolist() if len(found) else []):
        index[rank] = [group]
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        arrays = [x for x in parts if isinstance(x, np.ndarray)]
        arrays.append(np.array([x for x in parts if not isinstance(x, np.ndarray)], np.int64))
        at = np.unique(np.concatenate(arrays))
        at = at[(symbol[at] >= 0) & (after[at] >= 0)]
        at = at[ranks.of_pairs(symbol[at], symbol[after[at]]) == rank]
        if not len(at):
            continue
        first = np.append(True, np.diff(owner[at]) != 0)
        now = first
        if not first.all():
            now = first & np.append(first[1:], True)  # alone in their words
            several = np.flatnonzero(~now)
            now[several] = _mergeable(at[several], rank, symbol, after, before, owner, ranks)
        if not now.all():
            index[rank] = [at[~now]]
            heapq.heappush(queue, rank)
            at = at[now]
        gone = after[at]
        symbol[at], symbol[gone] = rank, -1
        right = after[gone]
        after[at] = right
        has = right >= 0
        before[right[has]] = at[has]
        left = before[at]
        lefts, rights = left[left >= 0], at[has]
        new_places = np.concatenate([rights, lefts])
        new = ranks.of_pairs(
            np.concatenate([np.full(len(rights), rank), symbol[lefts]]),
            np.concatenate([symbol[right[has]], np.full(len(lefts), rank)]),
        )
        merges = new != _NONE
        for r, place in _by_rank(new[merges], new_places[merges]):
            held = index.get(r)
            if held is None:
                index[r] = [place]
                heapq.heappush(queue, r)
            else:
                held.append(place)
    left = symbol >= 0
    ids = symbol[left].astype("<u4").tobytes()
    counts = np.bincount(owner[left], minlength=len(words))
    stops = (4 * np.cumsum(counts)).tolist()
    return [ids[a:b] for a, b in zip([0, *stops], stops)]


def _mergeable(
    at: np.ndarray, rank: int, symbol: np.ndarray, after: np.ndarray, before: np.ndarray, owner: np.ndarray, ranks: Ranks
) -> np.ndarray:
    """Which of the places of a rank, in order, merge in one step.

    Of overlapping places, as in a run of one letter, every second; and of each word the places up to
    the first whose merge brings about a pair of lower rank, which then has to come before the rest.
    """
    gone = after[at]
    chained = np.append(False, gone[:-1] == at[1:])
    places = np.arange(len(at))
    chain_start = np.maximum.accumulate(np.where(chained, 0, places))
    now = (places - chain_start) % 2 == 0
    chosen = at[now]
    gone = after[chosen]
    right, left = after[gone], before[chosen]
    beside = np.append(False, left[1:] == gone[:-1])  # what stands before has just been merged
    with_right = np.where(right >= 0, ranks.of_pairs(np.full(len(chosen), rank), symbol[right]), _NONE)
    with_left = np.where(left >= 0, ranks.of_pairs(np.where(beside, rank, symbol[left]), np.full(len(chosen), rank)), _NONE)
    lower = (with_right < rank) | (with_left < rank)
    if lower.any():
        earlier = np.cumsum(lower) - lower
        first = np.append(True, np.diff(owner[chosen]) != 0)
        now[now] = earlier == earlier[np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))]
    return now


def _by_rank(new: np.ndarray, places: np.ndarray) -> Iterable[tuple[int, int | np.ndarray]]:
    """New places under their ranks: one by one while they are few, else as arrays."""
    if len(new) < 1000:
        return zip(new.tolist(), places.tolist())
    order = new.argsort(kind="stable")
    new, places = new[order], places[order]
    cuts = np.flatnonzero(np.diff(new)) + 1
    return zip(new[np.append(0, cuts)].tolist(), np.split(places, cuts))


class Encoder:
    """Encodes texts block by block and remembers the ids of words."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.number: dict[str, int] = {}
        self.ids: list[bytes] = []

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text by number; new words get the next numbers."""
        number = self.number
        found = self.find(text) if text else []
        for w in set(found).difference(number):
            number[w] = len(number)
        return np.fromiter(map(number.__getitem__, found), np.int32, len(found))

    def merge_new(self) -> None:
        done = len(self.ids)
        new = [w.encode("utf-8") for w in list(self.number)[done:]]
        self.ids += merge_words(new, self.ranks)

    def spelled(self, numbers: np.ndarray) -> bytes:
        return b"".join(map(self.ids.__getitem__, numbers.tolist()))

    def forget(self) -> None:
        if len(self.number) > STORE:
            self.number.clear()
            self.ids.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        numbered = [self.numbers(x) for x in texts]
        self.merge_new()
        return [self.spelled(x) for x in numbered]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, also_decode: bool = False) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, list[np.ndarray]]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        encoder.merge_new()
        for rows, numbered in held:
            ids = [encoder.spelled(x) for x in numbered]
            columns = [rows, pa.array(ids, pa.binary())]
            if also_decode:
                columns.append(pa.array([encoder.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_out", "_back"][: len(columns)])
        held.clear()
        encoder.forget()

    for batch in batches:
        numbered = [encoder.numbers(x.as_py()) for x in batch.column(0)]
        held.append((batch.column(1), numbered))
        size += sum(map(len, numbered))
        if size >= BLOCK:
            yield from flush()
            size = 0
    yield from flush()


def _mapped(docs: DataFrame, column: str, name: str, work) -> DataFrame:
    """``docs`` with the binary column ``name`` that ``work`` makes from batches of ``column`` and the rest."""
    text_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != name]
    inner = docs.select(F.col(f"`{column}`").alias("_in"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("_row"))
    done = inner.mapInArrow(work, inner.select("_row", F.lit(None).cast("binary").alias("_out")).schema)
    return done.select(*[F.col("_row").getField(c).alias(c) for c in rest], F.col("_out").alias(name))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the binary column ``name``: ids as little-endian unsigned 32-bit numbers."""
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(path))
    return _mapped(docs, text, name, lambda batches: _encoded(batches, Encoder(ranks.value, pattern)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` and ``decoded``: encoded, and decoded again, in one pass."""
    text_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(path))
    inner = docs.select(F.col(f"`{text}`").alias("_in"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("_row"))
    made = inner.select("_row", *[F.lit(None).cast("binary").alias(c) for c in ("_out", "_back")])
    done = inner.mapInArrow(lambda batches: _encoded(batches, Encoder(ranks.value, pattern), True), made.schema)
    return done.select(
        *[F.col("_row").getField(c).alias(c) for c in keep], F.col("_out").alias("ids"), F.col("_back").alias("decoded")
    )


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the binary column ``name``: the bytes that ``ids`` stand for."""
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(ranks.value, "")
        for batch in batches:
            made = pa.array([decoder.decode(x.as_py() or b"") for x in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), made], names=["_row", "_out"])

    return _mapped(docs, ids, name, run)
