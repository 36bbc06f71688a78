"""Helpers shared by the training-data operators.

Nothing here collects documents: rows stay on the executors, and only bounded
model samples, counters and parameters reach the driver.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import prepare

#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset (a local session, as in tests)
    a temporary folder of this machine is set in its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="corvane-")
        shared_dir.own = path
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs the re-run of tasks, not of the plan
    above, and a plan that is read twice is computed once.
    """
    spark = prepare(df.sparkSession)
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}{_SCOPE.get()}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what :func:`written` left for this application (in a scope: for the scope), once results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What :func:`written` writes inside is deleted at the end; store results before it."""
    token = _SCOPE.set(f"/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        drop_scratch(spark)
        _SCOPE.reset(token)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def unit_hash(*cols: str) -> Column:
    """A number in [0, 1) that depends only on the columns' values."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def bounded_ids(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of a (doc_id, y) table: those with the smallest hash of the id."""
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of at most ``most`` bytes of text (one row at least), with their texts."""
    for batch in batches:
        col = batch.column(text)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            part = batch.slice(at, to - at)
            yield part, part.column(text).to_pylist()
            at = to


#: (operator, what) -> (value, model built from it), in a Python worker.
_HELD: dict[tuple[str, str], tuple] = {}


def held(owner: str, what: str, value, build: Callable):
    """A model that a worker builds once for a value. Only models of the operator that asked last stay."""
    if (owner, what) not in _HELD or _HELD[owner, what][0] != value:
        _HELD.pop((owner, what), None)
        let_go(owner)
        _HELD[owner, what] = value, build()
    return _HELD[owner, what][1]


def let_go(owner: str = "") -> None:
    """At a task's start: drop the models of other operators, and give the system back what earlier tasks left free.

    Workers live on from stage to stage, so that else each holds what every stage before it needed.
    """
    for key in [k for k in _HELD if k[0] != owner]:
        del _HELD[key]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_value(spark: SparkSession, value):
    """A broadcast of model parameters, whose size depends on parameters and not on the data."""
    return prepare(spark).sparkContext.broadcast(value)


def roots(parents: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(id, root) of a forest given as one (a, b) row a node, b < a its parent, by pointer jumping.

    A round halves every node's distance to its root. Roots themselves have no row
    in ``parents`` and get one here.
    """
    now = parents.select("a", "b")
    for _ in range(rounds):
        up = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        now = written(now.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), name)
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"roots did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def connected(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(id, root) for each id in ``edges`` (a, b): root is the smallest id reachable.

    Alternating large-star and small-star steps: each step replaces the edges of a
    node by edges to its smallest neighbour, so a chain halves each round and a hub
    gets one edge for each neighbour. Only minima are aggregated, never a node's
    neighbour list. Every round is written to the shared folder.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, name)
    before = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # Large star: a node's larger neighbours are linked to the smallest of its neighbourhood.
        large = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, name)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
