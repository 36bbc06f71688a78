"""Factorisation machines over hashed words (and, for quality, structure statistics and metadata).

Every distinct word of a text is hashed to buckets of a fixed space. All buckets of a
bounded sample of labelled texts take part in the fit:

* a bucket whose share differs between the classes beyond chance gets a weight, chance
  being the greatest of BUCKETS normal deviates, sqrt(2 ln BUCKETS);
* pairs need no such difference. Near V = 0 the gradient of the machine's vectors is
  G V, where G sums the residuals of the labels over the pairs of buckets that meet in
  a text. Its leading directions are found by subspace iteration, with two sparse
  products a round, and a bucket that holds SHARE of a direction gets a vector: so an
  insult and a group mention that are common each, and telling together, are found.

No number of buckets is fixed. The machine is then fitted on these by logistic loss,
starting from the directions, and a text is scored in time linear in its features with

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

Defined cases: null and empty texts score the model's bias with no words; null
or conflicting labels of one id: nulls are dropped, the largest label wins; of labelled
documents that repeat an id, the one of the smallest text is learned; with no labelled
rows, or with one class alone, the score is that class's share (0.0 without rows); null
metadata count as 0; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_ids, chunks, shared_value, written

BUCKETS = 1 << 20
#: Bound of the labelled sample, and the rank of the machine.
LABELLED, RANK = 8_000, 8
#: Directions of pairs that are searched, the rounds of the search, the least number of sampled texts of a bucket in it, and the share of a direction that a bucket must hold.
DIRECTIONS, ROUNDS, SUPPORT, SHARE = 4, 7, 5, 1 / 64
STEPS, BATCH, RATE, DECAY = 900, 512, 0.03, 1e-4
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TAIL = re.compile(r"[\W_]{1,8}$")
REMEMBERED = 1_000_000
BEGINNINGS = (3, 4, 5, 6)


class Hashed(dict):
    """Word as it stands -> buckets of its terms.

    Terms are its lower-case form without marks at its ends, that form's beginnings
    (3 to 6 characters, which carry a stem over to inflected and compound forms) and
    the run of marks at its end. With ``chosen``, other buckets are left out.
    """

    def __init__(self, chosen=None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        plain = _EDGE.sub("", word)
        terms = [plain, *("^" + plain[:k] for k in BEGINNINGS if len(plain) > k)] if plain else []
        if marks := _TAIL.search(word):
            terms.append("$" + marks[0])
        found = (xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms)
        self[word] = out = tuple(b for b in found if self.chosen is None or b in self.chosen)
        return out


def words_only(text: str, known: Hashed, metadata: tuple[float, ...] = ()) -> set[int]:
    """Buckets of the distinct words of a text."""
    return set(chain.from_iterable(map(known.__getitem__, set(text.lower().split()))))


def statistics(text: str, metadata: tuple[float, ...] = ()) -> list[float]:
    """Structure of a text, all from the whole text: sizes, shares of kinds of characters, and repetition; then metadata."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, total = max(1, len(words)), max(1, len(text))
    upper, lower, other = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[192:].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    repeats = sum(map(eq, words, islice(words, 1, None)))
    return [
        np.log1p(len(words)), np.log1p(total), total / n, np.log1p(total / len(lines)),
        upper / max(1, upper + lower + other), int(raw[48:58].sum()) / total, marks / total, marks / n,
        len(set(words)) / n, repeats / n, 1 - len(set(lines)) / len(lines), *(np.log1p(max(0.0, x)) for x in metadata),
    ]


def with_structure(edges: np.ndarray) -> Callable[..., set[int]]:
    """Words, and each statistic's bin as one more bucket (beyond the words' buckets)."""
    def run(text: str, known: Hashed, metadata: tuple[float, ...] = ()) -> set[int]:
        bins = (edges <= np.array(statistics(text, metadata))[:, None]).sum(axis=1)
        return words_only(text, known) | {BUCKETS + 64 * k + int(b) for k, b in enumerate(bins)}
    return run


class Machine:
    """A fitted factorisation machine: ``place`` maps a bucket to its row of w and v."""

    def __init__(self, place: dict[int, int], bias: float, w: np.ndarray, v: np.ndarray):
        self.place, self.bias, self.w, self.v, self.square = place, bias, w, v, (v * v).sum(axis=1)

    def score(self, buckets: set[int]) -> float:
        at = [self.place[b] for b in buckets if b in self.place] if len(buckets) < len(self.place) else [r for b, r in self.place.items() if b in buckets]
        if at:
            s = self.v[at].sum(axis=0)
            z = self.bias + self.w[at].sum() + 0.5 * (s @ s - self.square[at].sum())
        else:
            z = self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


class Rows:
    """Rows of bucket numbers 0 .. d - 1 as one array; each row starts with ``d``, so that none is empty."""

    def __init__(self, rows: list, d: int):
        self.d = d
        sizes = np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.flat = np.fromiter(chain.from_iterable(chain((d,), r) for r in rows), np.int32, int(sizes.sum()))

    def some(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket numbers, starts, sizes) of some rows."""
        sizes = self.ends[which] - self.starts[which]
        starts = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[which] - starts, sizes) + np.arange(int(sizes.sum()))], starts, sizes


def directions(rows: list, labels: np.ndarray, count: int = DIRECTIONS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, vectors) of those that hold SHARE of a leading direction of the residual pair matrix.

    Rows are centred and count by the inverse of their size, so that long texts, which
    hold more pairs, count as much as short ones; a bucket's pair with itself is left out.
    """
    none = np.zeros(0, np.int64), np.zeros((0, count), np.float32)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    if not sizes.sum():
        return none
    flat = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(rows)), sizes)
    found, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    often = held >= SUPPORT
    if often.sum() < 2:
        return none
    place = np.cumsum(often) - 1
    live = often[column]
    row, column, found, held = row[live], place[column[live]], found[often], held[often]
    size = np.bincount(row, minlength=len(rows))
    full = np.flatnonzero(size)
    begins = np.searchsorted(row, full)
    by_column = np.argsort(column, kind="stable")
    crossed, column_begins = row[by_column], np.cumsum(held) - held
    mean = (held / len(rows)).astype(np.float32)
    weight = ((labels - labels.mean()) / np.maximum(1, size)).astype(np.float32)
    own = np.bincount(column, weight[row], len(found)).astype(np.float32)[:, None]
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(found), count)))[0].astype(np.float32)
    for _ in range(rounds):
        u = np.zeros((len(rows), v.shape[1]), np.float32)
        u[full] = np.add.reduceat(v[column], begins, axis=0)
        u = (u - mean @ v) * weight[:, None]
        v = np.linalg.qr(np.add.reduceat(u[crossed], column_begins, axis=0) - mean[:, None] * u.sum(axis=0) - own * v)[0]
    keep = (v * v).max(axis=1) >= SHARE
    return found[keep], v[keep]


def fit(rows: list[list[int]], labels: np.ndarray, chosen: list[int], rank: int = RANK, steps: int = STEPS, seed: int = 7, start: dict[int, np.ndarray] | None = None) -> Machine:
    """Adam on mini-batches of sparse rows of the chosen buckets; ``start`` gives some of them a first vector."""
    place = {b: k for k, b in enumerate(chosen)}
    n, d, rng = len(rows), len(chosen), np.random.default_rng(seed)
    y = labels.astype(np.float32)
    share = float(y.mean()) if n else 0.0
    if not n or share in (0.0, 1.0) or not d:
        return Machine({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))) if n else -35.0, np.zeros(0), np.zeros((0, rank)))
    data = Rows(rows, d)
    w, v = np.zeros(d + 1, np.float32), rng.normal(0, 0.01, (d + 1, rank)).astype(np.float32)
    for b, first in (start or {}).items():
        v[place[b], : len(first)] += 0.1 * first[:rank]
    v[d] = 0
    theta = [np.array([np.log(share / (1 - share))], np.float32), w, v]
    m, u = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        which = rng.integers(0, n, min(n, BATCH))
        at, starts, sizes = data.some(which)
        va = theta[2][at]
        s = np.add.reduceat(va, starts, axis=0)
        z = theta[0] + np.add.reduceat(theta[1][at], starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((va * va).sum(1), starts))
        err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[which]) / len(which)).astype(np.float32)
        each = np.repeat(err, sizes)
        pairs = (np.repeat(s, sizes, axis=0) - va) * each[:, None]
        grads = [np.array([err.sum()], np.float32), np.bincount(at, each, d + 1) + DECAY * theta[1], np.stack([np.bincount(at, pairs[:, f], d + 1) for f in range(rank)], axis=1) + DECAY * theta[2]]
        grads[1][d], grads[2][d] = 0, 0  # the mark at each row's start has neither weight nor vector
        rate = RATE * (1 - step / (steps + 1))
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            u[k] = 0.999 * u[k] + 0.001 * g * g
            theta[k] = (theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Machine(place, float(theta[0][0]), theta[1][:d].astype(np.float64), theta[2][:d].astype(np.float64))


def _metadata(part: pa.RecordBatch, columns: tuple[str, ...]) -> list[tuple[float, ...]]:
    return list(zip(*(part.column(f"__{c}").to_pylist() for c in columns), strict=True)) if columns else [()] * part.num_rows


def _with(metadata: tuple[str, ...]) -> list:
    """The text and the metadata as columns that clash with no other."""
    return [F.coalesce(F.col("text"), F.lit("")).alias("__text"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{c}") for c in metadata)]


def _buckets(df: DataFrame, features: Callable, metadata: tuple[str, ...]) -> DataFrame:
    """(y, buckets) of a (y, __text, metadata) table."""
    def run(batches):
        known = Hashed()
        for part, texts in chunks(batches, "__text"):
            if len(known) > REMEMBERED:
                known.clear()
            found = [sorted(features(t, known, x)) for t, x in zip(texts, _metadata(part, metadata), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["y", "b"])
    return df.mapInArrow(run, "y int, b array<int>")


def learn(docs: DataFrame, labels: DataFrame, label: str, may_learn, structure: bool, most: int = LABELLED, metadata: tuple[str, ...] = (), name: str = "fm"):
    """A fitted (machine, edges) from at most ``most`` labelled documents for which ``may_learn`` holds.

    The ids of the sample (bounded) are broadcast to the documents; of each id one
    document is taken, so what reaches the driver is bounded by ``most``. ``metadata``
    are numeric columns of ``docs`` that count as statistics if ``structure`` is true.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(may_learn)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = bounded_ids(ids, most)
    source = docs.select("doc_id", *_with(metadata)).join(F.broadcast(ids), "doc_id")
    one = F.min(F.struct("__text", *(f"__{c}" for c in metadata))).alias("one")
    sample = written(source.groupBy("doc_id", "y").agg(one).select("y", "one.*"), f"{name}-sample")
    edges = np.zeros((0, 1))
    if structure:
        def stats(batches):
            for part, texts in chunks(batches, "__text"):
                yield pa.RecordBatch.from_arrays([pa.array([statistics(t, x) for t, x in zip(texts, _metadata(part, metadata), strict=True)], pa.list_(pa.float64()))], names=["s"])
        values = sample.drop("y").mapInArrow(stats, "s array<double>").toArrow().column("s").to_pylist()
        if values:
            edges = np.quantile(np.array(values), np.linspace(0.02, 0.98, 25), axis=0).T.copy()
            edges[:, 1:][np.diff(edges, axis=1) == 0] = np.inf  # equal edges are one edge
    feature = with_structure(edges) if structure and len(edges) else words_only
    rows = written(_buckets(sample, feature, metadata), f"{name}-buckets")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or positive in (0, n):
        return fit([[]] * n, np.full(n, bool(positive)), []), edges
    # The z value of a bucket's share in the two classes, smoothed; both directions count.
    found = rows.select("y", F.explode("b").alias("b")).groupBy("b").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    p1, p0 = (F.col("p")) / F.lit(float(positive)), (F.col("c") - F.col("p")) / F.lit(float(n - positive))
    mean = (F.col("c") + 1.0) / F.lit(float(n + 2))
    z = F.abs(p1 - p0) / F.sqrt(mean * (1 - mean) * F.lit(1.0 / positive + 1.0 / (n - positive)))
    alone = found.where(z > float(np.sqrt(2 * np.log(BUCKETS)))).select("b").toArrow().column("b").to_pylist()
    data = rows.toArrow()
    y, every = np.array(data.column("y").to_pylist()), data.column("b").combine_chunks()
    flat, cuts = every.values.to_numpy(), every.offsets.to_numpy()
    every = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    order = sorted(range(n), key=lambda k: (every[k].tobytes(), y[k]))  # the fit doesn't depend on how the sample is stored
    every, y = [every[k] for k in order], y[order]
    together, vectors = directions(every, y)
    chosen = sorted({*alone, *together.tolist()})
    place = {b: k for k, b in enumerate(chosen)}
    return fit([[place[b] for b in row.tolist() if b in place] for row in every], y, chosen, start=dict(zip(together.tolist(), vectors, strict=True))), edges


def score(docs: DataFrame, model, structure: bool, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3, metadata: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted`` (1 if score >= threshold)."""
    shared = shared_value(docs.sparkSession, model)
    source = docs.select(*keep, *_with(metadata))
    types = dict(source.dtypes)

    def run(batches):
        machine, edges = shared.value
        feature, known = with_structure(edges) if structure and len(edges) else words_only, Hashed(machine.place)
        for part, texts in chunks(batches, "__text"):
            if len(known) > REMEMBERED:
                known.clear()
            got = [machine.score(feature(t, known, x)) for t, x in zip(texts, _metadata(part, metadata), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())], names=[*keep, "score", "predicted"])

    head = "".join(f"`{c}` {types[c]}, " for c in keep)
    return source.mapInArrow(run, head + "score double, predicted int")
