"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of five-word shingles (64-bit hashes), a digest of
   that set and a signature of 128 minima. Texts with equal sets form a class;
   only its smallest id goes on.
2. 32 bands of 4 minima give bucket keys. Round one tests, for each class, the
   smallest member of the bucket that it shares most often; round two compares
   every pair of a bucket whose ends are not yet in one component, in blocks inside
   a task. Buckets where more than ``SPREAD`` members lie outside the largest
   component are dealt by a second key, so that a frequent passage doesn't make all
   its documents meet: any other band, or any of 32 bands of the same minima grouped
   anew. Where such a part is wide itself, its blocks are simply many.
3. Pairs compare signatures batch by batch; a pair is pruned as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold
   is below ``MISS``. Survivors are compared on their full shingle sets, from their
   whole texts. In round two only rows that have a survivor in their block fetch
   their text, into blocks that are cut by bytes.

A pair at the threshold shares no band with probability 4.4e-6, and one band alone and
no second key with probability 1.5e-7, which is what dealing a wide bucket may add (both
summed over the number of equal minima).

Defined cases: null and empty texts and texts without words have no shingle and
are linked with nothing; fewer than five words are one shingle; a null id is
linked with nothing (component null, kept); rows that repeat an id share their
component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, connected, let_go, prepare, roots, written

WORDS, THRESHOLD = 5, 75
BANDS, ROWS, BATCH = 32, 4, 16
SIZE = BANDS * ROWS
MISS = 1e-5
#: Members outside a bucket's largest component above which a second key deals the bucket.
SPREAD = 4096
#: Rows of the two sides of a block of signatures, and bytes of text of a side of a block of texts.
LEFT, RIGHT, BLOCK_BYTES = 512, 1024, 16 << 20
#: Pairs of signatures that are compared at once (8 MB a side).
PAIRS = 16_384
#: Words whose hashes a task remembers (a few ten MB), and bytes of text that it signs at once.
REMEMBERED, SIGNED_BYTES = 100_000, 2 << 20
#: Up to so many ids are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 100_000
_RNG = np.random.default_rng(20_011)
_A = (_RNG.integers(1, 1 << 63, SIZE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
#: The order in which minima are grouped anew.
_ANEW = _RNG.permutation(SIZE)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the text's words: A-Z in lower case, cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * _M + h[k : len(h) - size + 1 + k]
    return mixed(out)


def shingles(text: str | None, known: WordHashes, size: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    h = word_hashes(text, known)
    if len(h) >= size:
        return np.unique(windows(h, size))
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        part = (s[at : at + 2048][None, :] * _A[:, None] + _B[:, None]).min(axis=1)
        out = np.minimum(out, (part >> np.uint64(32)).astype(np.uint32))
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    known = WordHashes()
    for part, texts in chunks(batches, "text", SIGNED_BYTES):
        sizes, keys, sigs = [], [], []
        for text in texts:
            s = shingles(text, known)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), SIZE)


def _bands(sig: np.ndarray, first: int = 0) -> np.ndarray:
    """A key of each band of each signature; ``first`` numbers the bands."""
    salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(first + 1)) * np.uint64(0xD6E8FEB86659FD93)
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(salt, rows.shape[:2])
    for k in range(ROWS):
        key = mixed(key * _M + rows[:, :, k])
    return key.astype(np.int64)


def _banded(anew: bool = False):
    """(id, keys) of signatures: their bands, with ``anew`` also those of the minima grouped anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sig = _matrix(batch.column("sig"))
            keys = np.concatenate((_bands(sig), _bands(sig[:, _ANEW], BANDS)), axis=1) if anew else _bands(sig)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["id", "keys"])
    return run


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """After n compared minima, the fewest matches for which P(similarity >= threshold) >= miss (uniform prior)."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(BATCH, SIZE + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() / weight.sum() >= miss:
                out[n] = m
                break
    return out


def _survive(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Places of the pairs of signatures a[i], b[j] that no batch pruned, some pairs at a time."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(i), PAIRS):
        live = np.arange(at, min(at + PAIRS, len(i)))
        same = np.zeros(len(live), np.int64)
        for n, need in least.items():
            same = same + (a[i[live], n - BATCH : n] == b[j[live], n - BATCH : n]).sum(axis=1)
            live, same = live[same >= need], same[same >= need]
        out.append(live)
    return np.concatenate(out)


def _pruned(least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).take(pa.array(_survive(_matrix(batch.column("sa")), each, _matrix(batch.column("sb")), each, least)))
    return run


def _reaches(sa: np.ndarray, sb: np.ndarray) -> bool:
    """Whether two shingle sets reach the threshold."""
    if 100 * min(len(sa), len(sb)) < THRESHOLD * max(len(sa), len(sb)):
        return False
    both = len(np.intersect1d(sa, sb, assume_unique=True))
    return both > 0 and 100 * both >= THRESHOLD * (len(sa) + len(sb) - both)


def _pairs(rows: pa.Table, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the block's pairs that no batch pruned: rows of side 0 with rows of side 1 (2: of both) in other components.

    A pair that shares several bands is compared in the first of them only (``band``; -1: in all).
    """
    ids, comp, side = (rows.column(c).to_numpy() for c in ("id", "comp", "side"))
    top, band = rows.column("top")[0].as_py(), rows.column("band")[0].as_py()
    sig = _matrix(rows.column("sig").combine_chunks())
    x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    meet = (comp[x][:, None] != comp[y][None, :]) & ((comp[y] == top)[None, :] | (ids[x][:, None] < ids[y][None, :]))
    first = least[BATCH]
    for at in range(0, len(x), 32):  # the first batch of minima, a few rows at a time
        part = x[at : at + 32]
        meet[at : at + 32] &= (sig[part][:, None, :BATCH] == sig[y][None, :, :BATCH]).sum(axis=2) >= first
    i, j = np.nonzero(meet)
    i, j = x[i], y[j]
    live = _survive(sig, i, sig, j, least)
    i, j = i[live], j[live]
    if band >= 0 and len(i):
        parts = (slice(at, at + PAIRS) for at in range(0, len(i), PAIRS))
        once = np.concatenate([(sig[i[x]] == sig[j[x]]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band for x in parts])
        i, j = i[once], j[once]
    return i, j


_LIVE = ("key", "i", "j", "side", "id", "comp", "top", "band")


def _live(rows: pa.Table, least: dict[int, int], known: WordHashes) -> pa.Table:
    """The block's rows that have a pair."""
    i, j = _pairs(rows, least)
    return rows.select(list(_LIVE)).take(pa.array(np.unique(np.concatenate((i, j)))))


def _verified(rows: pa.Table, least: dict[int, int], known: WordHashes) -> pa.Table:
    """The block's links (a, b), by the full sets of its texts; one set of each side is held besides those of side 0."""
    ids = rows.column("id").to_numpy()
    i, j = _pairs(rows, least)
    order = np.argsort(j, kind="stable")
    i, j = i[order], j[order]
    texts, sets, last, linked = rows.column("text"), {}, (-1, None), np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if a not in sets:
            sets[a] = shingles(texts[a].as_py(), known)
        if last[0] != b:
            last = b, shingles(texts[b].as_py(), known)
        linked[k] = _reaches(sets[a], last[1])
    return pa.table({"a": pa.array(np.maximum(ids[i], ids[j])[linked], pa.int64()), "b": pa.array(np.minimum(ids[i], ids[j])[linked], pa.int64())})


def _blocks(of: tuple[str, ...], work):
    """``work`` on each block of rows that come sorted by the columns ``of``; a block may reach over batches."""
    least = least_matches(THRESHOLD / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[pa.RecordBatch] = []
        known = WordHashes()
        last = None
        for batch in _then_none(batches):
            if batch is None:
                if held:
                    yield from work(pa.Table.from_batches(held), least, known).to_batches()
            elif batch.num_rows:
                names = np.stack([batch.column(c).to_numpy() for c in of], axis=1)
                cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if last is not None and last != tuple(names[lo]) and held:
                        yield from work(pa.Table.from_batches(held), least, known).to_batches()
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = tuple(names[lo])
    return run


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    known, last = WordHashes(), (None, None)
    for batch in batches:
        keep = []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
            if last[0] != b:
                last = (b, shingles(tb, known))
            sa, sb = shingles(ta, known), last[1]
            keep.append(_reaches(sa, sb))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts(ids: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, text) of the ids: broadcast to the documents up to a counted bound, joined by a shuffle beyond it."""
    ids = written(ids, f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return written(texts, f"{name}-texts")


def _links(likely: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The (a, b) pairs whose full shingle sets reach the threshold."""
    texts = _texts(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, name)
    one = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    full = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(one, "b")
    return written(full.select("a", "b", "ta", "tb").mapInArrow(_exact, "a bigint, b bigint").distinct(), f"{name}-links")


def _crossing(rows: DataFrame) -> DataFrame:
    """The (key, band, id, comp) rows of keys with several components, with the key's largest component and numbers of rows in and outside it."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m"))
    tops = tops.where(F.col("m") > F.col("top.n")).select("key", F.col("top.comp").alias("top"), "m", (F.col("m") - F.col("top.n")).alias("outside"))
    return rows.join(tops, "key")


def _dealt(rows: DataFrame, i: Column, j: Column, names: tuple[str, str]) -> DataFrame:
    """Rows in a grid of lefts x rights blocks: one of side 0 in all blocks of its line, one of side 1 in all of its column.

    A row of both sides (2) stays one row where the grid is a single block.
    """
    single = (F.col("lefts") == 1) & (F.col("rights") == 1)
    alone = rows.where(single).withColumn(names[0], F.lit(0)).withColumn(names[1], F.lit(0))
    a = rows.where(~single & (F.col("side") != 1)).withColumn("side", F.lit(0)).withColumn(names[0], i).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
    b = rows.where(~single & (F.col("side") != 0)).withColumn("side", F.lit(1)).withColumn(names[0], F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn(names[1], j)
    return alone.unionByName(a).unionByName(b)


def _parts(count: Column, *salt: Column) -> Column:
    return F.pmod(F.xxhash64("id", *salt), count).cast("int")


def _cross_links(rows: DataFrame, sigs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Links across the components of each key.

    Rows outside a key's largest component meet all rows of the key in blocks of at
    most about LEFT x RIGHT signatures. Rows with a surviving pair meet again with
    their texts, in the same blocks cut by bytes; only links leave these.
    """
    sized = rows.withColumn("lefts", F.ceil(F.col("outside") / LEFT).cast("int")).withColumn("rights", F.ceil(F.col("m") / RIGHT).cast("int"))
    sized = sized.withColumn("side", F.when(F.col("comp") == F.col("top"), 1).otherwise(2))
    blocks = _dealt(sized, _parts(F.col("lefts")), _parts(F.col("rights"), F.lit(1)), ("i", "j")).select(*_LIVE).join(sigs, "id")
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    live = written(blocks.mapInArrow(_blocks(("key", "i", "j"), _live), "key bigint, i int, j int, side int, id bigint, comp bigint, top bigint, band int"), f"{name}-live")
    texts = _texts(live.select(F.col("id").alias("doc_id")).distinct(), docs, name).withColumnRenamed("doc_id", "id")
    sized = live.join(texts.select("id", F.octet_length("text").cast("bigint").alias("size")), "id")
    count = [F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("side") != other, F.col("size"))) / BLOCK_BYTES)).cast("int").alias(c) for other, c in ((1, "lefts"), (0, "rights"))]
    sized = live.join(sized.groupBy("key", "i", "j").agg(*count), ["key", "i", "j"])
    full = _dealt(sized, _parts(F.col("lefts"), F.lit(2)), _parts(F.col("rights"), F.lit(3)), ("p", "q")).select(*_LIVE, "p", "q").join(sigs, "id").join(texts, "id").repartition("key", "i", "j", "p", "q").sortWithinPartitions("key", "i", "j", "p", "q")
    return written(full.mapInArrow(_blocks(("key", "i", "j", "p", "q"), _verified), "a bigint, b bigint").distinct(), f"{name}-links")


def components(docs: DataFrame, name: str = "minhash") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_signed, "doc_id bigint, n_shingles bigint, set_key binary, sig binary"), f"{name}-signed")
    live = signed.where("set_key is not null and doc_id is not null")
    least = F.min_by(F.struct("doc_id", "sig"), "doc_id").alias("least")
    classes = live.groupBy("set_key").agg(least).select("set_key", F.col("least.doc_id").alias("id"), F.col("least.sig").alias("sig"))
    classes = written(classes, f"{name}-classes")
    sigs = classes.select("id", "sig")
    banded = written(sigs.mapInArrow(_banded(), "id bigint, keys array<bigint>"), f"{name}-bands")
    rows = banded.select("id", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("key", "center")
    met = written(rows.join(shared, "key"), f"{name}-met")
    votes = met.where("id <> center").groupBy("id", "center").agg(F.count(F.lit(1)).alias("n"))
    first = votes.groupBy("id").agg(F.max(F.struct("n", -F.col("center"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.col2")).alias("b"))
    sized = first.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    likely = sized.select("a", "b", "sa", "sb").mapInArrow(_pruned(least_matches(THRESHOLD / 100)), "a bigint, b bigint")
    links = _links(written(likely, f"{name}-likely"), docs, name)
    comp = written(roots(links, f"{name}-one"), f"{name}-comp")
    # Round two: whatever a bucket holds beyond one component.
    labelled = met.join(comp, "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("comp"))
    crossing = written(_crossing(labelled), f"{name}-crossing")
    wide = crossing.where(F.col("outside") > SPREAD)
    anew = sigs.join(wide.select("id").distinct(), "id").mapInArrow(_banded(anew=True), "id bigint, keys array<bigint>")
    cut = wide.select(F.col("key").alias("one"), "id", "comp").join(anew, "id").select("one", "id", "comp", F.explode("keys").alias("two")).where("one <> two")
    cut = cut.select(F.xxhash64(F.least("one", "two"), F.greatest("one", "two")).alias("key"), F.lit(-1).alias("band"), "id", "comp").distinct()
    both = crossing.where(F.col("outside") <= SPREAD).unionByName(_crossing(cut))
    more = _cross_links(both, sigs, docs, f"{name}-two")
    if not more.isEmpty():
        at = comp.select("id", "root")
        ends = more.join(at.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(at.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        top = connected(ends, f"{name}-both").select(F.col("id").alias("root"), F.col("root").alias("top"))
        comp = comp.unionByName(top.select(F.col("root").alias("id"), "root").join(comp.select("id"), "id", "left_anti"))
        comp = comp.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    same = classes.select("set_key", "id").join(comp, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(same, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("root"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, name: str = "minhash") -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id, with all columns.

    Of rows that repeat an id only the one of the smallest text stays (a null text counts
    as empty, equal texts as one); rows with a null id stay. Only rows with repeated ids are grouped.
    """
    gone = written(components(docs, name).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), f"{name}-gone")
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("__again")).agg(F.count(F.lit(1)).alias("n"))
    again = written(ids.where("n > 1").select("__again"), f"{name}-again")

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    key = docs["doc_id"].cast("bigint")
    left = docs.join(few(gone), key == gone["__gone"], "left_anti")
    if again.isEmpty():
        return left
    marked, once = left.join(few(again), key == again["__again"], "left_semi"), left.join(few(again), key == again["__again"], "left_anti")
    first = marked.groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.coalesce("text", F.lit(""))).alias("__one"))
    return once.unionByName(first.select("__one.*"))
