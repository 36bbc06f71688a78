"""Corpus building: quotas, packing, chunking, interleaving, manifests, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import prepare


def live_sources(rows: DataFrame, usable: Column, spec: DataFrame, probe: int = 12) -> DataFrame:
    """The sources whose first ``probe`` rows hold a usable one, with weights renormalised in each bucket.

    The probe rows are the smallest ids of a source, kept as a bounded list by each task.
    """
    heads = rows.select("bucket", "source", "row_id", usable.alias("usable"))
    w = W.partitionBy("bucket", "source").orderBy("row_id")
    live = heads.withColumn("n", F.row_number().over(w)).where(F.col("n") <= probe).groupBy("bucket", "source").agg(F.max("usable").alias("live"))
    kept = spec.join(live.where("live"), ["bucket", "source"], "left_semi")
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy("bucket")))


def source_targets(spec: DataFrame, want: int) -> DataFrame:
    """Each source's share of its bucket's target by weight, 1 at least."""
    share = F.floor(F.lit(want) * F.col("weight") / F.sum("weight").over(W.partitionBy("bucket")))
    return spec.withColumn("target", F.greatest(F.lit(1), share).cast("bigint"))


def redistributed(spec: DataFrame, want: int) -> DataFrame:
    """(bucket, source, ord, taken): sources in order; what earlier ones could not give is spread over those to come.

    ``spec`` has target, weight and available tokens. The fold runs over a bucket's
    sources (a dimension, not the corpus).
    """
    w = W.partitionBy("bucket").orderBy("ord", "source").rowsBetween(W.currentRow, W.unboundedFollowing)
    rest = spec.withColumn("rest", F.sum("weight").over(w))
    items = F.array_sort(F.collect_list(F.struct("ord", "source", "target", "weight", "rest", "available")))
    zero = F.struct(F.lit(0).cast("bigint").alias("got"), F.array().cast("array<struct<source:string,ord:int,taken:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        sub = F.greatest(x["target"], F.floor((F.lit(want) - a["got"]) * x["weight"] / x["rest"]))
        stop = F.least(F.lit(want).cast("bigint"), a["got"] + sub)
        taken = F.least(x["available"], F.greatest(stop - a["got"], F.lit(0)))
        return F.struct((a["got"] + taken).alias("got"), F.concat(a["out"], F.array(F.struct(x["source"].alias("source"), x["ord"].alias("ord"), taken.alias("taken")))).alias("out"))

    folded = rest.groupBy("bucket").agg(items.alias("items")).select("bucket", F.aggregate("items", zero, step).alias("a"))
    return folded.select("bucket", F.explode("a.out").alias("x")).select("bucket", "x.source", "x.ord", "x.taken")


def _folded(rows: DataFrame, lanes: int, run, schema: str) -> DataFrame:
    """A fold over each bucket's rows in order. Only (bucket, order, length) rows move; a task streams them with constant memory.

    One lane a bucket is the defined order; more lanes cut a bucket by a hash of
    row_id into independent folds that run side by side.
    """
    prepare(rows.sparkSession)
    lane = F.pmod(F.xxhash64("row_id"), F.lit(lanes)).cast("int") if lanes > 1 else F.lit(0)
    moved = rows.select("bucket", lane.alias("lane"), F.col("row_id").cast("bigint"), F.col("n").cast("bigint"))
    return moved.repartition("bucket", "lane").sortWithinPartitions("bucket", "lane", "row_id").mapInArrow(run, schema)


def packed(rows: DataFrame, size: int, lanes: int = 1) -> DataFrame:
    """(bucket, lane, row_id, pack_no, start, length): greedy next-fit packing into rows of ``size`` positions.

    A document takes min(n, size - 1) tokens and an end mark; a row is closed before a
    document that doesn't fit and when at most size // 8 positions are left.
    """
    names = ["bucket", "lane", "row_id", "pack_no", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, number = None, 0, 0
        for batch in batches:
            out = []
            for bucket, lane, row_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lane) != key:
                    key, used, number = (bucket, lane), 0, 0
                need = min(n, size - 1) + 1
                if need > size - used:
                    used, number = 0, number + 1
                out.append((bucket, lane, row_id, number, used, need))
                used += need
                if size - used <= size // 8:
                    used, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=names)

    return _folded(rows, lanes, run, "bucket string, lane int, row_id bigint, pack_no bigint, start bigint, length bigint")


def chunked(rows: DataFrame, budget: int, lanes: int = 1) -> DataFrame:
    """(bucket, lane, row_id, chunk_no): rows are added until their tokens reach the budget; the next chunk starts at 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, number = None, 0, 0
        for batch in batches:
            out = []
            for bucket, lane, row_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lane) != key:
                    key, total, number = (bucket, lane), 0, 0
                out.append((bucket, lane, row_id, number))
                total += n
                if total >= budget:
                    total, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "lane", "row_id", "chunk_no"])

    return _folded(rows, lanes, run, "bucket string, lane int, row_id bigint, chunk_no bigint")


def interleaved(chunks: DataFrame) -> DataFrame:
    """(bucket, chunk_no, at): chunks by their relative place in their bucket, then smaller buckets, then name.

    Chunks are dealt by ranges of that order and numbered within a range, behind the
    count of those before it, so no task sees them all.
    """
    size = F.count(F.lit(1)).over(W.partitionBy("bucket"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("chunk_no")) - 1
    keyed = chunks.select("bucket", "chunk_no", size.alias("size"), place.alias("place")).withColumn("key", F.col("place") / F.col("size"))
    order = ["key", "size", "bucket", "chunk_no"]
    dealt = keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    within = dealt.withColumn("within", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1)
    return within.join(F.broadcast(before), "part").select("bucket", "chunk_no", (F.col("before") + F.col("within")).alias("at"))


def media_totals(rows: DataFrame, media: tuple[str, ...], want: int) -> DataFrame:
    """(bucket, tokens, media_tokens, share, refused): a media bucket that holds tokens but none from media is refused."""
    total = rows.groupBy("bucket").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("media"), F.col("n_tokens")).otherwise(0)).alias("media_tokens"))
    return total.select("bucket", "tokens", "media_tokens", (F.col("tokens") / F.lit(want)).alias("share"), (F.col("bucket").isin(*media) & (F.col("tokens") > 0) & (F.col("media_tokens") == 0)).alias("refused"))


def with_media(rows: DataFrame, media: tuple[str, ...], payload: str) -> DataFrame:
    """Rows without those of media buckets that carry no payload: they are skipped, never taken as text."""
    return rows.where(~F.col("bucket").isin(*media) | F.col(payload).isNotNull())


def write_chunks(rows: DataFrame, path: str, media: tuple[str, ...] = ()) -> DataFrame:
    """Writes (bucket, chunk_no, n_tokens, media, ...) as one folder a chunk and returns the manifest, written beside it.

    Raises before anything is written if a media bucket holds no media, or if a corpus
    stands at ``path``. The committer makes each folder appear whole or not at all.
    """
    spark = rows.sparkSession
    bad = [r["bucket"] for r in media_totals(rows, media, 1).where("refused").collect()]
    if bad:
        raise ValueError(f"media buckets without media: {bad}")
    rows.write.partitionBy("bucket", "chunk_no").mode("error").parquet(f"{path}/chunks")
    manifest(spark.read.parquet(f"{path}/chunks")).coalesce(1).write.mode("error").json(f"{path}/manifest")
    return read_manifest(spark, path)


def manifest(chunks: DataFrame) -> DataFrame:
    """(bucket, chunks, rows, tokens, media_tokens) of stored chunks."""
    return chunks.groupBy("bucket").agg(F.countDistinct("chunk_no").alias("chunks"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("media"), F.col("n_tokens")).otherwise(0)).alias("media_tokens"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket string, chunks bigint, rows bigint, tokens bigint, media_tokens bigint").json(f"{path}/manifest")


def append_chunks(rows: DataFrame, path: str, media: tuple[str, ...] = ()) -> DataFrame:
    """Adds chunks to a finished corpus and returns its new manifest.

    Refused without a manifest, if the manifest and the stored chunks disagree, or if a
    new chunk's number is already taken; chunk numbers go on from the stored ones.
    """
    spark = rows.sparkSession
    old = spark.read.parquet(f"{path}/chunks")
    named, found = (sorted(map(tuple, x.select("bucket", "chunks", "rows", "tokens").collect())) for x in (read_manifest(spark, path), manifest(old)))
    if named != found:
        raise ValueError("the manifest and the stored chunks disagree")
    new = rows.select("bucket", "chunk_no").distinct()
    taken = [tuple(r) for r in new.join(F.broadcast(old.select("bucket", F.col("chunk_no").cast("bigint").alias("chunk_no")).distinct()), ["bucket", "chunk_no"], "left_semi").collect()]
    if taken:
        raise ValueError(f"chunks that are already there: {taken}")
    bad = [r["bucket"] for r in media_totals(rows, media, 1).where("refused").collect()]
    if bad:
        raise ValueError(f"media buckets without media: {bad}")
    rows.write.partitionBy("bucket", "chunk_no").mode("append").parquet(f"{path}/chunks")
    whole = spark.read.schema(old.schema).parquet(f"{path}/chunks")
    rewritten = [tuple(r) for r in manifest(whole).collect()]  # a row a bucket
    spark.createDataFrame(rewritten, "bucket string, chunks bigint, rows bigint, tokens bigint, media_tokens bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return read_manifest(spark, path)


def head_by_tokens(rows: DataFrame, stop: int, *keys: str) -> DataFrame:
    """Rows in order while the tokens before them are below ``stop``."""
    w = W.partitionBy(*keys).orderBy("row_id").rowsBetween(W.unboundedPreceding, -1)
    return rows.where("text is not null and text <> ''").withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).where(F.col("before") < stop).drop("before")


def fill(rows: DataFrame, want: int) -> DataFrame:
    """Tokens of each bucket, their share of the target, and ok / warn (< 95 %) / fail (< 50 %)."""
    ratio = F.col("tokens") / F.lit(want)
    status = F.when(ratio < 0.5, "fail").when(ratio < 0.95, "warn").otherwise("ok")
    return rows.groupBy("bucket").agg(F.sum("n_tokens").alias("tokens")).select("bucket", "tokens", ratio.alias("fill"), status.alias("status"))


def clips(frames: DataFrame, per_clip: int, restart: Column | None = None) -> DataFrame:
    """(stream, key, clip, first_seq, last_seq): runs of one key in a stream, cut every ``per_clip`` frames; short tails are dropped.

    ``restart`` marks frames before which the reader broke off: what was gathered of a
    clip by then is lost and a run starts anew.
    """
    w = W.partitionBy("stream").orderBy("seq", "frame_id")
    same = F.col("key") == F.lag("key").over(w)
    change = F.when(same if restart is None else same & ~restart, 0).otherwise(1)
    runs = frames.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy("stream", "run").orderBy("seq", "frame_id")) - 1
    cut = runs.withColumn("clip", F.floor(place / per_clip)).groupBy("stream", "run", "clip").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return cut.where(F.col("n") == per_clip).drop("n")


def smallest_hash(rows: DataFrame, n: int, salt: str, keys: list[str], *ids: str) -> DataFrame:
    """A uniform sample of ``n`` rows for each key: those of the smallest md5 of salt and ids, whatever their order."""
    h = F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in ids]).cast("binary"))
    w = W.partitionBy(*keys).orderBy("h", *ids)
    return rows.withColumn("h", h).withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n", "h")
