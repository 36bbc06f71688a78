"""Benchmark decontamination by greedy string tiling.

Seeds are the hashes of all runs of ``TILE`` words of the benchmark items, taken from a
running Karp-Rabin hash. They are joined with the documents' runs on the hash, and only
documents that share enough seeds with an item are tiled against it: the longest common
run of unmarked words, found by the running hash of both sides at lengths that are
halved in, is marked as a tile again and again until none of ``TILE`` words is left. An
item is leaked if its tiles cover ``COVERAGE`` of its words, wherever and in whatever
order they stand.

The corpus is read once, whatever the size of the benchmark. A bitmap of fixed size keeps
runs that no item has out of the join; what moves are the hashes of a document's words
that lie in runs which passed it. A tile lies in such runs, as each of its runs is a seed.
A pair is tiled if the item's seeds that the document holds could cover enough.

Defined cases: null or empty documents and items match nothing; an item of fewer
than TILE words is one seed of its own length; rows that repeat an id are compared
each; rows with equal texts share their fate; an empty benchmark leaves every document
clean; of the benchmark only item_id and text are read, and null item ids are no items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, prepare, shared_value, written

TILE, COVERAGE = 5, 0.5
#: Bits of the bitmap of seeds (a fixed size; collisions cost only work).
BITS = 1 << 24
#: Up to so many rows of seeds, items or leaked texts are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
#: Into so many parts the documents of one seed or item are dealt in such a join.
SALTS = 16
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


class PlainHashes(dict):
    """Word -> hash of the word without ASCII marks at its ends; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(_MARKS)
        self[word] = out = (xxhash.xxh64_intdigest(plain) or 1) if plain else 0
        return out


def plain_words(text: str | None, known: PlainHashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(known) > REMEMBERED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


class Running:
    """Karp-Rabin hashes of all runs of a sequence of word hashes, at any length in one step a run."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        one = np.ones(1, np.uint64)
        self.power = np.concatenate((one, np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)))
        back = np.concatenate((one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * back[:n], dtype=np.uint64)))

    def runs(self, size: int) -> np.ndarray:
        """The hash of each run of ``size`` words; a run's place in the sequence doesn't matter."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        return (self.sums[size:] - self.sums[: self.n - size + 1]) * self.power[: self.n - size + 1]


def seeds(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, well mixed and apart for each size."""
    h = Running(words).runs(size) + np.uint64(size)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _free_from(marked: np.ndarray) -> np.ndarray:
    """For each place the number of unmarked words from there on."""
    at = np.arange(len(marked))
    nearest = np.where(marked, at, len(marked))
    return np.minimum.accumulate(nearest[::-1])[::-1] - at


def _common(text: Running, item: Running, free_text: np.ndarray, free_item: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unmarked runs of ``size`` words whose hash stands on both sides: places in the text and in the item."""
    i, j = np.flatnonzero(free_text >= size), np.flatnonzero(free_item >= size)
    a, b = text.runs(size)[i], item.runs(size)[j]
    i, j = i[np.isin(a, b)], j[np.isin(b, a)]
    return i, j


def tiles(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Greedy string tiling, longest match first, then by place in text and item: covered item words, tiles, longest tile.

    That a common run of some length exists implies one of each smaller length, so
    the longest is found by bisection; runs of equal hash are compared word by word.
    """
    size = min(TILE, len(item))
    running_text, running_item = Running(text), Running(item)
    in_text, in_item = text == 0, np.zeros(len(item), bool)  # 0 stands between pieces of a text
    count, longest, top = 0, 0, min(len(text), len(item))
    while size and top >= size:
        free_text, free_item = _free_from(in_text), _free_from(in_item)
        low, high, found = size, min(top, int(free_text.max(initial=0)), int(free_item.max(initial=0))), None
        while low <= high:
            middle = (low + high) // 2 if found is not None else low
            i, j = _common(running_text, running_item, free_text, free_item, middle)
            if len(i):
                found, low = (middle, i, j), middle + 1
            else:
                high = middle - 1
        if found is None:
            break
        length, i, j = found
        hashes, places = running_item.runs(length)[j], {}
        for h, place in zip(hashes.tolist(), j.tolist(), strict=True):
            places.setdefault(h, []).append(place)
        for a, h in zip(i.tolist(), running_text.runs(length)[i].tolist(), strict=True):
            for b in places.get(h, ()):
                if not in_text[a : a + length].any() and not in_item[b : b + length].any() and (text[a : a + length] == item[b : b + length]).all():
                    in_text[a : a + length], in_item[b : b + length] = True, True
                    count, longest = count + 1, max(longest, length)
        top = length - 1
    return int(in_item.sum()), count, longest


def _longs(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit hashes as one list column."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def _itemised(batches):
    known = PlainHashes()
    for part, texts in chunks(batches, "text"):
        all_words = [plain_words(t, known) for t in texts]
        found = [seeds(w, min(TILE, len(w))) if len(w) else w for w in all_words]
        yield pa.RecordBatch.from_arrays([part.column("item"), part.column("item_id"), pa.array([len(w) for w in all_words], pa.int64()), _longs(all_words), _longs(found)], names=["item", "item_id", "n_words", "words", "seeds"])


def _slots(batches):
    """Words of the bitmap in which a batch of items sets bits."""
    for batch in batches:
        at = np.unique(batch.column("seeds").flatten().to_numpy().view(np.uint64) % np.uint64(BITS)).astype(np.int64)
        slot, begins = np.unique(at >> 6, return_index=True)
        mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begins) if len(at) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(mask.view(np.int64))], names=["slot", "mask"])


def _seeded(shared, sizes: list[int]):
    """(row, seeds, words) of documents with runs that the bitmap has; words outside such runs are 0, one for each gap."""
    def run(batches):
        bits, known = np.frombuffer(shared.value, np.uint64), PlainHashes()
        for part, texts in chunks(batches, "text"):
            kept, found, pieces = [], [], []
            for k, text in enumerate(texts):
                words = plain_words(text, known)
                held, covered = [], np.zeros(len(words) + 1, np.int64)
                for size in sizes:
                    h = seeds(words, size)
                    at = h % np.uint64(BITS)
                    hit = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
                    held.append(h[hit])
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + size, -1)
                held = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
                if len(held):
                    inside = np.cumsum(covered[:-1]) > 0
                    stays = inside | np.concatenate(([False], inside[:-1]))
                    kept.append(k)
                    found.append(held)
                    pieces.append(np.where(inside, words, 0)[stays].astype(np.uint64))
            names = ["row", "doc_id", "key", "other"]
            rows = part.select(names).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, _longs(found), _longs(pieces)], names=[*names, "seeds", "words"])
    return run


def _tiled(coverage: float):
    def run(batches):
        for batch in batches:
            out, keep = [], []
            for k, (text, item) in enumerate(zip(batch.column("text_words"), batch.column("item_words"), strict=True)):
                n = len(item.values)
                got = tiles(text.values.to_numpy().view(np.uint64), item.values.to_numpy().view(np.uint64))
                if got[0] >= coverage * n:
                    keep.append(k)
                    out.append((n, *got, got[0] / n))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            names = ["doc_id", "key", "other", "item_id"]
            yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(keep, pa.int64())).columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*names, "n_words", "n_covered", "n_tiles", "longest", "coverage"])
    return run


def _join(many: DataFrame, few: DataFrame, on: str, by: str) -> DataFrame:
    """An inner join of documents' rows with a table of the benchmark: broadcast up to a counted bound, else salted."""
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), on)
    dealt = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, [on, "salt"]).drop("salt")


def _leaked(docs: DataFrame, benchmark: DataFrame, coverage: float, name: str) -> DataFrame:
    """Leaked items with their documents' ids and the two hashes of their texts."""
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    items = written(items.mapInArrow(_itemised, "item bigint, item_id bigint, n_words bigint, words array<bigint>, seeds array<bigint>").where("n_words > 0"), f"{name}-items")
    slots = items.select("seeds").mapInArrow(_slots, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[slots.column("slot").to_numpy()] = slots.column("mask").to_numpy().view(np.uint64)
    sizes = [r[0] for r in items.select(F.least("n_words", F.lit(TILE).cast("bigint"))).distinct().collect()]
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), F.hash("text").alias("other"), "text").where("text is not null")
    found = source.mapInArrow(_seeded(shared_value(spark, bits.tobytes()), sorted(sizes)), "row bigint, doc_id bigint, key bigint, other int, seeds array<bigint>, words array<bigint>")
    found = written(found, f"{name}-seeds")
    held = items.select("item", F.explode("seeds").alias("seed"))
    shared = _join(found.select("row", F.explode("seeds").alias("seed")), held, "seed", "row").groupBy("row", "item").agg(F.count(F.lit(1)).alias("n_seeds"))
    able = F.least(F.col("n_words"), F.col("n_seeds") * TILE) >= F.lit(coverage) * F.col("n_words")
    pairs = _join(shared, items.select("item", "item_id", "n_words", F.col("words").alias("item_words")), "item", "row").where(able)
    full = found.select("row", "doc_id", "key", "other", F.col("words").alias("text_words")).join(pairs.select("row", "item_id", "item_words"), "row")
    return full.drop("row").mapInArrow(_tiled(coverage), "doc_id bigint, key bigint, other int, item_id bigint, n_words bigint, n_covered bigint, n_tiles bigint, longest bigint, coverage double")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, name: str = "decontaminate") -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, longest, coverage) of every leaked item."""
    return _leaked(docs, benchmark, coverage, name).drop("key", "other")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, name: str = "decontaminate") -> DataFrame:
    """The documents that leak no item, with all their columns.

    Documents meet the leaked texts by two hashes of the text and the id; the leaked ones are
    broadcast up to a counted bound.
    """
    gone = written(_leaked(docs, benchmark, coverage, name).select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key"), F.col("other").alias("__other")).distinct(), f"{name}-gone")
    few = gone.count() <= BROADCAST_ROWS
    same = (F.xxhash64(docs["text"]) == gone["__key"]) & (F.hash(docs["text"]) == gone["__other"]) & docs["doc_id"].cast("bigint").eqNullSafe(gone["__gone"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
