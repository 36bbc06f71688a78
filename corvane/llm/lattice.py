"""Embedding near-duplicates by lattice hashing.

A table projects unit vectors by a random Gaussian matrix to eight dimensions and
decodes the result to the nearest point of the E8 lattice, whose cell is the bucket.
A vector looks into its own cell and into the ``PROBES`` neighbouring cells (of the
240 at minimal distance) that its remainder points to, in each of ``TABLES`` tables.
Of the pairs that met, those whose 64 signs of random projections differ in more
than ``SIGNS`` places are no candidates (a pair at cosine 0.9 differs in 9.2 on
average, with a deviation of 2.8, and in more than SIGNS with a probability below
1e-6); the others are compared by cosine in double precision.

Vectors with equal components form a class; only one of them is hashed, so copies
cost nothing and are counted by their number. Classes within half of the threshold's
angle of the smallest id that they share most cells with form a group: all its members
are linked, and are counted by their number too, without forming pairs. A cell then holds
groups; two groups whose centres' angle, with their radii, decides for all members or for
none are settled by it, and only what lies between is compared vector by vector, in
blocks inside a task that return each vector's number of links.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, as do vectors of different lengths; a null id is
linked with nothing (component null, kept); rows that repeat an id are one vector
if their components are equal, and otherwise vectors of their own that share the id: each
row has its own number of links and component. No candidate is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import connected, prepare, written

THRESHOLD = 0.9
TABLES, PROBES, SCALE, SEED = 24, 8, 1.2, 31
SIGNS = 24
#: Rounds in which groups are formed, and rows of a side of a block.
GROUP_ROUNDS, BLOCK = 3, 256
#: What rounding may add to an angle.
SLACK = 1e-7


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def minimal_vectors() -> np.ndarray:
    """The 240 lattice points at distance sqrt(2) from the origin."""
    grid = np.stack(np.meshgrid(*[[-1.0, 0.0, 1.0]] * 8, indexing="ij"), -1).reshape(-1, 8)
    whole = grid[(grid**2).sum(axis=1) == 2]
    half = np.stack(np.meshgrid(*[[-0.5, 0.5]] * 8, indexing="ij"), -1).reshape(-1, 8)
    return np.concatenate((whole, half[half.sum(axis=1) % 2 == 0]))


_MINIMAL = minimal_vectors()


def cell_keys(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit key of each lattice point in a table."""
    key = np.full(points.shape[:-1], np.uint64(table * 1_000_003 + dim + 1))
    whole = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    for k in range(8):
        key = (key ^ whole[..., k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(own cells, probed neighbours) of unit vectors: n x tables and n x (tables * probes)."""
    n, dim = unit.shape
    own, near = np.zeros((n, tables), np.int64), np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        x = unit @ (np.random.default_rng((seed, t, dim)).normal(size=(dim, 8)) * scale)
        home = decode(x)
        own[:, t] = cell_keys(home, t, dim)
        toward = (x - home) @ _MINIMAL.T
        best = np.argpartition(-toward, probes - 1, axis=1)[:, :probes]
        near[:, t] = cell_keys(home[:, None, :] + _MINIMAL[best], t, dim)
    return own, near.reshape(n, -1)


def signs(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """64 signs of random projections of each vector as one integer."""
    x = unit @ np.random.default_rng((seed, 64, unit.shape[1])).normal(size=(unit.shape[1], 64))
    return np.packbits(x > 0, axis=1).view(np.int64).ravel()


def _vectors(batches):
    for batch in batches:
        keys, vecs = [], []
        for v in batch.column("embedding").to_pylist():
            x = np.array([np.nan if c is None else c for c in v] if v else [], np.float64)
            with np.errstate(over="ignore"):
                norm = np.sqrt((x * x).sum())
            ok = len(x) and np.isfinite(x).all() and norm > 0
            if ok and not np.isfinite(norm):  # squares that overflow
                norm = np.abs(x).max() * np.sqrt(((x / np.abs(x).max()) ** 2).sum())
            keys.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()) if ok else None)
            vecs.append((x / norm).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "vec_key", "vec"])


def _celled(batches):
    for batch in batches:
        raw, ids = batch.column("vec").to_pylist(), batch.column("id").to_pylist()
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by_size.setdefault(len(b), []).append(k)
        for which in by_size.values():
            for at in range(0, len(which), 1000):
                part = which[at : at + 1000]
                unit = np.stack([np.frombuffer(raw[k], np.float64) for k in part])
                own, near = cells(unit)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (own, near)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in part], pa.int64()), pa.array(signs(unit)), *lists], names=["id", "signs", "own", "near"])


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _dots(a: pa.Array, b: pa.Array) -> np.ndarray:
    return np.array([float(np.dot(np.frombuffer(x), np.frombuffer(y))) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])


def _within(limit: float):
    """(id, center, angle) of pairs whose angle is ``limit`` at most."""
    def run(batches):
        for batch in batches:
            angle = _angle(_dots(batch.column("va"), batch.column("vb")))
            keep = pa.array(angle <= limit)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("center").filter(keep), pa.array(angle).filter(keep)], names=["id", "center", "angle"])
    return run


def _grouped(celled: DataFrame, vec: DataFrame, limit: float, name: str) -> DataFrame:
    """(id, center, angle) of the classes that stand within ``limit`` of a smaller one which stands in no other group."""
    left, out = celled.select("id", "own"), None
    for _ in range(GROUP_ROUNDS):
        rows = left.select("id", F.explode("own").alias("cell"))
        centers = rows.groupBy("cell").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("cell", "center")
        votes = rows.join(centers, "cell").where("id <> center").groupBy("id", "center").agg(F.count(F.lit(1)).alias("n"))
        first = votes.groupBy("id").agg(F.max(F.struct("n", -F.col("center"))).alias("best")).select("id", (-F.col("best.col2")).alias("center"))
        both = first.join(vec.select("id", F.col("vec").alias("va")), "id").join(vec.select(F.col("id").alias("center"), F.col("vec").alias("vb")), "center")
        near = written(both.select("id", "center", "va", "vb").mapInArrow(_within(limit), "id bigint, center bigint, angle double"), f"{name}-near")
        found = near.join(near.select(F.col("id").alias("center")), "center", "left_anti").select("id", "center", "angle")
        found = written(found, f"{name}-groups")
        if found.isEmpty():
            break
        out = found if out is None else out.unionAll(found)
        used = found.select("id").union(found.select("center")).distinct()
        left = written(left.join(used, "id", "left_anti"), f"{name}-left")
    return celled.select("id", F.col("id").alias("center"), F.lit(0.0).alias("angle")).limit(0) if out is None else out


def _settled(threshold: float):
    """(a, b, whole) of pairs of groups: all members are linked (``whole``) or some may be; the others are left out."""
    theta = float(_angle(threshold))

    def run(batches):
        for batch in batches:
            cosine = _dots(batch.column("va"), batch.column("vb"))
            angle, reach = _angle(cosine), batch.column("ra").to_numpy() + batch.column("rb").to_numpy()
            alone = reach == 0  # two groups of one class each, or without extent: the cosine decides
            whole = np.where(alone, cosine >= threshold, angle + reach <= theta - SLACK)
            keep = pa.array(whole | (~alone & (angle - reach <= theta + SLACK)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(whole).filter(keep)], names=["a", "b", "whole"])
    return run


def _counted(threshold: float):
    """Over rows sorted by (a, b, i, j, side): (a, b, id, links) of each block's members that have a link."""
    def block(rows: pa.Table):
        side = rows.column("side").to_numpy()
        ids, weight = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        unit = np.frombuffer(b"".join(rows.column("vec").to_pylist())).reshape(len(ids), -1)
        x, y = side == 0, side == 1
        linked = unit[x] @ unit[y].T >= threshold
        for which, links in ((x, linked @ weight[y]), (y, weight[x] @ linked)):
            some = links > 0
            k = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, rows.column("a")[0].as_py()), pa.int64()), pa.array(np.full(k, rows.column("b")[0].as_py()), pa.int64()), pa.array(ids[which][some]), pa.array(links[some].astype(np.int64))], names=["a", "b", "id", "links"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("a", "b", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and last != tuple(names[lo]):
                    yield from block(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = tuple(names[lo])
        if held:
            yield from block(pa.Table.from_batches(held))
    return run


def _between(pairs: DataFrame, members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, id, links) of the members of pairs of groups, all against all, in blocks."""
    size = lambda c, n: sizes.select(F.col("g").alias(c), F.ceil(F.col("members") / BLOCK).cast("int").alias(n))
    grid = pairs.select("a", "b").join(size("a", "lefts"), "a").join(size("b", "rights"), "b")
    mine = members.select("g", "id", "n", "vec")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = grid.join(mine.withColumnRenamed("g", "a"), "a").withColumn("i", part("lefts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("side", F.lit(0))
    right = grid.join(mine.withColumnRenamed("g", "b"), "b").withColumn("j", part("rights")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("side", F.lit(1))
    cols = ["a", "b", "i", "j", "side", "id", "n", "vec"]
    rows = left.select(*cols).unionAll(right.select(*cols)).repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "side")
    return rows.mapInArrow(_counted(threshold), "a bigint, b bigint, id bigint, links bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, name: str = "lattice") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    source = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = written(source.mapInArrow(_vectors, "vec_id bigint, vec_key binary, vec binary"), f"{name}-vectors")
    live = known.where("vec_key is not null and vec_id is not null")
    classes = live.groupBy("vec_key").agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("n"), F.first("vec").alias("vec"))
    # A class goes by its smallest id; of classes that share one, by numbers below all ids.
    twice = F.row_number().over(Window.partitionBy("least").orderBy("vec_key"))
    classes = written(classes.withColumn("id", F.when(twice == 1, F.col("least")).otherwise(-(F.xxhash64("vec_key").bitwiseAND(F.lit((1 << 62) - 1)) + 1))), f"{name}-classes")
    celled = written(classes.select("id", "vec").mapInArrow(_celled, "id bigint, signs bigint, own array<bigint>, near array<bigint>"), f"{name}-cells")
    vec = classes.select("id", "vec")
    groups = _grouped(celled, vec, float(_angle(threshold)) / 2 - SLACK, name)
    members = classes.select("id", "least", "n", "vec").join(groups.select("id", "center", "angle"), "id", "left")
    members = written(members.select("id", "least", "n", "vec", F.coalesce("center", "id").alias("g"), F.coalesce("angle", F.lit(0.0)).alias("angle")), f"{name}-members")
    sizes = written(members.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"), F.max("angle").alias("radius"), F.min("least").alias("smallest")), f"{name}-sizes")
    many = sizes.where("members > 1").select("g")
    grouped = members.select("id", "g").join(many, "g")
    apart = celled.join(grouped.select("id"), "id", "left_anti")

    def cells_of(column: str) -> DataFrame:
        """(g, signs, cell): a class alone keeps its signs, a group has none and each of its cells once."""
        one = apart.select(F.col("id").alias("g"), "signs", F.explode(column).alias("cell"))
        several = celled.select("id", F.explode(column).alias("cell")).join(grouped, "id").select("g", F.lit(None).cast("bigint").alias("signs"), "cell").distinct()
        return one.unionAll(several)

    own = cells_of("own").select(F.col("g").alias("x"), F.col("signs").alias("sx"), "cell")
    here, near = (d.select(F.col("g").alias("y"), F.col("signs").alias("sy"), "cell") for d in (cells_of("own"), cells_of("near")))
    alike = F.coalesce(F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= SIGNS, F.lit(True))
    met = own.join(here, "cell").where((F.col("x") > F.col("y")) & alike).select(F.col("x").alias("a"), F.col("y").alias("b"))
    beside = own.join(near, "cell").where((F.col("x") != F.col("y")) & alike).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    pairs = met.union(beside).distinct()
    ball = sizes.select("g", "radius").join(vec.withColumnRenamed("id", "g"), "g")
    full = pairs.join(ball.select(F.col("g").alias("a"), F.col("vec").alias("va"), F.col("radius").alias("ra")), "a").join(ball.select(F.col("g").alias("b"), F.col("vec").alias("vb"), F.col("radius").alias("rb")), "b")
    settled = written(full.select("a", "b", "va", "vb", "ra", "rb").mapInArrow(_settled(threshold), "a bigint, b bigint, whole boolean").distinct(), f"{name}-settled")
    whole = settled.where("whole").select("a", "b")
    some = written(_between(settled.where("not whole"), members, sizes, threshold), f"{name}-between")
    ends = whole.unionAll(whole.select("b", "a"))
    of_group = ends.join(sizes.select(F.col("g").alias("b"), "weight"), "b").groupBy(F.col("a").alias("g")).agg(F.sum("weight").alias("to_groups"))
    of_member = some.groupBy("id").agg(F.sum("links").alias("to_members"))
    comp = connected(whole.unionAll(some.select("a", "b")).distinct(), f"{name}-components").select(F.col("id").alias("g"), "root")
    placed = sizes.select("g", "weight", "smallest").join(comp, "g", "left").withColumn("root", F.coalesce("root", "g"))
    least = placed.groupBy("root").agg(F.min("smallest").alias("component"))
    placed = placed.join(least, "root").join(of_group, "g", "left").select("g", "weight", "component", F.coalesce("to_groups", F.lit(0)).alias("to_groups"))
    state = members.select("id", "g").join(placed, "g").join(of_member, "id", "left")
    state = state.select("id", (F.col("weight") - 1 + F.col("to_groups") + F.coalesce("to_members", F.lit(0))).alias("n_links"), F.col("component").alias("root"))
    out = known.select("vec_id", "vec_key").join(classes.select("vec_key", "id").join(state, "id").drop("id"), "vec_key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    links_of = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint")
    return out.select("vec_id", links_of.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
