"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A first pass counts the corpus's distinct units (about: words); counts are summed by
the executors. The replay runs over this vocabulary, part by part: all symbols of a part's
pieces stand in one array with previous/next links, and an inverted index holds for each
merge rank (a pair of tokens) the positions of the pairs that it joins. Ranks are replayed
smallest first; a merge touches only the merged position and its two neighbours, whose
new pairs go back into the index. A second pass is a look-up of each document's units: the
``SHARED`` most frequent ones, nearly all of a text, reach every executor as a broadcast
of bounded size; the others, which few documents hold, are replayed where they stand, by
the same code over all new units of a run of documents. No text is shuffled.

Defined cases: null text counts as empty; an empty text has no tokens; repeated
rows are encoded each; other columns are neither read nor returned by
``encode_documents`` unless they are named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, held, let_go, shared_value

#: Units of the corpus's vocabulary that are broadcast with their ids, and the longest of these in characters.
SHARED, SHARED_LENGTH = 150_000, 40
#: Distinct units that a task counts, and units that are replayed at once.
COUNTED, REPLAYED = 100_000, 50_000
#: Units whose ids a task remembers; beyond it only the broadcast ones stay.
REMEMBERED = 300_000
#: Bytes of text that a task encodes at once.
ENCODED_BYTES = 4 << 20
#: A space beside other white space.
SPACED = re.compile(r" \s|\s ")
_END = -1


class PairTable:
    """Exact look-up of (left id, right id) -> rank for arrays, by open addressing."""

    def __init__(self, pairs: dict[int, int]):
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, -1, np.int32)
        slot, left, self.steps = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.key[slot[left]] == -1
            first = left[free]
            _, one = np.unique(slot[first], return_index=True)
            put = first[one]
            self.key[slot[put]], self.rank[slot[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge joins it."""
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.int64) << 20) | right[todo]
        slot = self._slot(keys)
        for _ in range(self.steps):
            if not len(todo):
                break
            found = self.key[slot]
            hit = found == keys
            out[todo[hit]] = self.rank[slot[hit]]
            go = ~hit & (found != -1)
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBpe:
    """A vocabulary of ranks, its pre-tokenising pattern, and the merge replay."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(r >= 1 << 20 for r in ranks.values()):
            raise ValueError("ranks of 2^20 and more are not supported")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.first = np.array([ranks.get(bytes([b]), _END) for b in range(256)], np.int32)
        if (self.first < 0).any():
            raise ValueError("a byte-level vocabulary holds all 256 single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = PairTable(pairs)
        self.length = np.zeros(max(self.bytes_of) + 1, np.int64)
        for rank, token in self.bytes_of.items():
            self.length[rank] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes_of[r] for r in sorted(self.bytes_of)), np.uint8)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        todo = []
        for k, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif word:
                todo.append(k)
        if not todo:
            return out
        lengths = np.fromiter((len(words[k]) for k in todo), np.int64, len(todo))
        raw = np.frombuffer(b"\0".join(words[k] for k in todo) + b"\0", np.uint8)
        token = self.first[raw]
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        token[ends] = _END
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.pairs.get(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        enter(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.sort(np.concatenate(index.pop(rank)), kind="stable")
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            right = after[at]
            now = self.pairs.get(token[at], token[right]) == rank
            at, right = at[now], right[now]
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping pairs the leftmost, then every second, are joined
                chained = np.concatenate(([False], right[:-1] == at[1:]))
                if chained.any():
                    place = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(chained, 0, place))
                    keep = (place - head) % 2 == 0
                    at, right = at[keep], right[keep]
            past = after[right]
            token[at], token[right] = rank, _END - 1
            after[at] = past
            before[past] = at
            left = before[at]
            enter(np.concatenate((left[left >= 0], at)))
        alive = np.flatnonzero(token >= 0)
        ids = token[alive].astype("<u4").tobytes()
        lo, hi = np.searchsorted(alive, starts), np.searchsorted(alive, ends)
        for k, a, b in zip(todo, (lo * 4).tolist(), (hi * 4).tolist(), strict=True):
            out[k] = ids[a:b]
        return out

    def keys(self, text: str) -> list[str]:
        """The text as units: a key without a leading space stands for itself after one space, ``" x"`` for ``x``.

        A text is cut before each single space that stands between two characters
        that are no white space: no match of the pattern reaches over such a place
        or looks beyond it, so a unit's matches don't depend on what surrounds it.
        A text with other spaces is cut into the pattern's matches.
        """
        if SPACED.search(text):
            return [x[1:] if x[0] == " " and len(x) > 1 and " " not in x[1:] else " " + x for x in self.pattern.findall(text)]
        found = text.split(" ")
        found[0] = " " + found[0]
        return found

    def encode_texts(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as bytes; ``known`` remembers units between calls."""
        found = [self.keys(text) for text in texts]
        new = list(set(chain.from_iterable(found)).difference(known))
        known.update(zip(new, self.units(new), strict=True))
        return [b"".join(map(known.__getitem__, x)) for x in found]

    def units(self, keys: list[str]) -> list[bytes]:
        """Ids of each unit: one replay over the distinct pieces of all of them."""
        pieces = [self.pattern.findall(x[1:] if x[:1] == " " else " " + x) for x in keys]
        distinct = list(set(chain.from_iterable(pieces)))
        ids = dict(zip(distinct, self.replay([x.encode() for x in distinct]), strict=True))
        return [b"".join(map(ids.__getitem__, p)) for p in pieces]

    def decode_bytes(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        length = self.length[at]
        ends = np.cumsum(length)
        if not len(at):
            return b""
        return self.flat[np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1])].tobytes()


def load(content: bytes, pattern: str) -> ByteBpe:
    """A vocabulary file's tokenizer, built once in a worker for a content."""
    def built() -> ByteBpe:
        lines = (line.split() for line in content.splitlines() if line.strip())
        return ByteBpe({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)
    return held("bpe", "ranks", (content, pattern), built)


def vocabulary(spark, ranks_path: str, pattern: str):
    """A broadcast of a vocabulary file (its size does not depend on the corpus)."""
    with open(ranks_path, "rb") as file:
        return shared_value(spark, (file.read(), pattern))


def _counted(shared):
    """(unit, n) of a task's texts."""
    def run(batches):
        let_go("bpe")
        bpe, counts = load(*shared.value), Counter()
        for _, texts in chunks(batches, "__text"):
            for text in texts:
                counts.update(bpe.keys(text))
            if len(counts) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"])
    return run


def _replayed(shared):
    def run(batches):
        bpe = load(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, REPLAYED):
                part = batch.slice(at, REPLAYED)
                yield pa.RecordBatch.from_arrays([part.column("unit"), pa.array(bpe.units(part.column("unit").to_pylist()), pa.binary())], names=["unit", "ids"])
    return run


def replayed_vocabulary(texts: DataFrame, shared, most: int = SHARED) -> DataFrame:
    """(unit, ids) of the ``most`` most frequent units of at most SHARED_LENGTH characters that stand twice or more; column ``__text``."""
    counts = texts.mapInArrow(_counted(shared), "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    often = counts.where((F.col("n") > 1) & (F.length("unit") <= SHARED_LENGTH)).orderBy(F.desc("n"), "unit").limit(most)
    return often.select("unit").repartition(texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(_replayed(shared), "unit string, ids binary")


def _known(shared) -> dict[str, bytes]:
    """A broadcast vocabulary as a look-up, built once in a worker and held with the value it was built from."""
    value = shared.value
    return held("bpe", "units", value, lambda: dict(zip(*pickle.loads(zstandard.decompress(value)), strict=True)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and the ids as ``ids`` (little-endian uint32 bytes) with ``decoded`` text.

    With ``digests`` the ids and the decoded bytes are returned as lowercase
    SHA-256 strings (``ids_sha256``, ``decoded_sha256``) instead.
    """
    shared = vocabulary(docs.sparkSession, ranks_path, pattern)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    types = dict(source.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in keep)
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    names = (["ids_sha256", "decoded_sha256"], ["ids", "decoded"])[not digests]
    joiner = "," if head else ""

    units = replayed_vocabulary(source.select("__text"), shared).toArrow()
    common = shared_value(docs.sparkSession, zstandard.compress(pickle.dumps((units.column("unit").to_pylist(), units.column("ids").to_pylist()))))

    def run(batches):
        let_go("bpe")
        bpe, known = load(*shared.value), dict(_known(common))
        for part, texts in chunks(batches, "__text", ENCODED_BYTES):
            if len(known) > REMEMBERED:
                known = dict(_known(common))
            ids = bpe.encode_texts(texts, known)
            decoded = [bpe.decode_bytes(x) for x in ids]
            if digests:
                a, b = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded]
            else:
                a, b = ids, [x.decode("utf-8") for x in decoded]
            cols = [part.column(c) for c in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", *names])

    return source.mapInArrow(run, f"{head}{joiner} n_tokens bigint, {tail}")
