"""Registered queries on corpus building, tensors and streaming, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import media, text as X
from corvane.operators import checks, corpus as C, selection as S, tensors
from corvane.plans import routing_queries as Q
from corvane.sources import scan, tables as T
from corvane.streaming import fold as stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SIZE, BUDGET, WANT, PATCH, ROWS = 1024, 20_000, 100_000, 16, 4096


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


ROWS_SQL = "rws AS (SELECT doc_id AS row_id, lang AS bucket, source, text, n_chars // 4 AS n FROM documents)"
SPEC_SQL = "spec AS (SELECT DISTINCT bucket, source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS ord, 1.0::DOUBLE + CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 5 AS weight FROM rws)"


@query("""SELECT doc_id, coalesce(substring(regexp_replace(CASE WHEN q IS NOT NULL AND regexp_replace(q, '^\\s+|\\s+$', '', 'g') <> '' THEN q WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN text END, '^\\s+|\\s+$', '', 'g'), 1, 2000), '') AS text
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '   ' WHEN doc_id % 3 = 1 THEN source END AS q FROM documents) d""")
def row_text(spark, d):
    q = F.when(F.col("doc_id") % 3 == 0, "   ").when(F.col("doc_id") % 3 == 1, F.col("source"))
    return T.table(spark, d, "documents").select("doc_id", X.row_text(q, F.col("text")).alias("text"))


@query("""SELECT conv_id, string_agg(coalesce(nullif(role, ''), 'user') || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id""")
def render_conversations(spark, d):
    turns = T.turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", X.rendered(F.col("m")).alias("text")).where("text is not null")


@query("""SELECT q.conv_id, CASE WHEN a.text IS NULL THEN q.text ELSE q.text || chr(10) || chr(10) || a.text END AS text FROM (SELECT * FROM conversations WHERE turn = 0) q LEFT JOIN (SELECT * FROM conversations WHERE turn = 2) a USING (conv_id)""")
def qa_concat(spark, d):
    t = T.turns(spark, d).where("turn in (0, 2)").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), F.max(F.when(F.col("turn") == 2, F.col("text"))).alias("a"))
    return t.select("conv_id", X.question_answer(F.col("q"), F.col("a")).alias("text")).where("text is not null")


@query(f"""WITH {ROWS_SQL}, {SPEC_SQL}, h AS (SELECT bucket, source, n, row_number() OVER (PARTITION BY bucket, source ORDER BY row_id) AS k FROM rws),
live AS (SELECT bucket, source FROM h WHERE k <= 12 GROUP BY bucket, source HAVING max(n) >= 1000)
SELECT bucket, source, round(weight / sum(weight) OVER (PARTITION BY bucket), 9) AS weight FROM spec JOIN live USING (bucket, source)""")
def source_liveness(spark, d):
    rows = T.corpus_rows(spark, d)
    return C.live_sources(rows, F.col("n_tokens") >= 1000, T.source_spec(spark, d)).select("bucket", "source", F.round("weight", 9).alias("weight"))


@query(f"WITH {ROWS_SQL}, {SPEC_SQL} SELECT bucket, source, greatest(1, CAST(floor({WANT} * weight / sum(weight) OVER (PARTITION BY bucket)) AS BIGINT)) AS target FROM spec")
def source_targets(spark, d):
    return C.source_targets(T.source_spec(spark, d), WANT).select("bucket", "source", "target")


@query(f"""WITH RECURSIVE {ROWS_SQL}, {SPEC_SQL}, av AS (SELECT bucket, source, CAST(sum(n) AS BIGINT) AS available FROM rws GROUP BY bucket, source),
o AS (SELECT *, greatest(1, CAST(floor({WANT} * weight / sum(weight) OVER (PARTITION BY bucket)) AS BIGINT)) AS target, sum(weight) OVER (PARTITION BY bucket ORDER BY ord, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
row_number() OVER (PARTITION BY bucket ORDER BY ord, source) AS k FROM spec JOIN av USING (bucket, source)),
t(bucket, k, source, got, taken) AS (SELECT bucket, 0::BIGINT, ''::VARCHAR, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT bucket FROM o) b
UNION ALL SELECT o.bucket, o.k, o.source, t.got + least(available, greatest(least({WANT}, t.got + greatest(target, CAST(floor(({WANT} - t.got) * weight / rest) AS BIGINT))) - t.got, 0)),
least(available, greatest(least({WANT}, t.got + greatest(target, CAST(floor(({WANT} - t.got) * weight / rest) AS BIGINT))) - t.got, 0)) FROM t JOIN o ON o.bucket = t.bucket AND o.k = t.k + 1)
SELECT bucket, source, taken FROM t WHERE k > 0""")
def quota_redistribution(spark, d):
    have = T.corpus_rows(spark, d).groupBy("bucket", "source").agg(F.sum("n_tokens").alias("available"))
    spec = C.source_targets(T.source_spec(spark, d), WANT).join(have, ["bucket", "source"])
    return C.redistributed(spec, WANT).select("bucket", "source", "taken")


def _lengths(spark, d) -> DataFrame:
    return T.corpus_rows(spark, d).select("bucket", "row_id", F.col("n_tokens").alias("n"))


PACK_SQL = f"""RECURSIVE {ROWS_SQL}, o AS (SELECT bucket, row_id, least(n, {SIZE - 1}) + 1 AS need, row_number() OVER (PARTITION BY bucket ORDER BY row_id) AS k FROM rws),
t(bucket, k, row_id, pack_no, start, length, used, next_no) AS (SELECT bucket, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT bucket FROM o) b
UNION ALL SELECT x.bucket, x.k, x.row_id, x.pno, x.st, x.need, CASE WHEN {SIZE} - (x.st + x.need) <= {SIZE // 8} THEN 0 ELSE x.st + x.need END, CASE WHEN {SIZE} - (x.st + x.need) <= {SIZE // 8} THEN x.pno + 1 ELSE x.pno END
FROM (SELECT o.bucket, o.k, o.row_id, o.need, CASE WHEN o.need > {SIZE} - t.used THEN 0 ELSE t.used END AS st, CASE WHEN o.need > {SIZE} - t.used THEN t.next_no + 1 ELSE t.next_no END AS pno FROM t JOIN o ON o.bucket = t.bucket AND o.k = t.k + 1) x),
packed AS (SELECT bucket, row_id, pack_no, start, length FROM t WHERE k > 0)"""


@query(f"WITH {PACK_SQL} SELECT bucket, row_id, pack_no, start, length FROM packed")
def pack_rows(spark, d):
    return C.packed(_lengths(spark, d), SIZE).select("bucket", "row_id", "pack_no", "start", "length")


@query(f"""WITH {PACK_SQL}, p AS (SELECT bucket, pack_no, count(*) AS docs, sum(length) AS used, max(length) AS longest FROM packed GROUP BY bucket, pack_no)
SELECT bucket, count(*) AS packs, round(avg(used), 4) AS mean_used, CAST(max(used) AS BIGINT) AS max_used, CAST(min(used) AS BIGINT) AS min_used, round(avg(docs), 4) AS mean_docs, max(docs) AS max_docs, count(*) FILTER (WHERE docs >= 2) AS shared, max(longest) AS longest FROM p GROUP BY bucket""")
def packing_stats(spark, d):
    packs = C.packed(_lengths(spark, d), SIZE).groupBy("bucket", "pack_no").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("used"), F.max("length").alias("longest"))
    return packs.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("packs"), F.round(F.avg("used"), 4).alias("mean_used"), F.max("used").alias("max_used"), F.min("used").alias("min_used"),
        F.round(F.avg("docs"), 4).alias("mean_docs"), F.max("docs").alias("max_docs"), F.count_if(F.col("docs") >= 2).alias("shared"), F.max("longest").alias("longest"))


CHUNK_SQL = f"""RECURSIVE {ROWS_SQL}, o AS (SELECT bucket, row_id, n, row_number() OVER (PARTITION BY bucket ORDER BY row_id) AS k FROM rws),
t(bucket, k, row_id, n, chunk_no, total, next_no) AS (SELECT bucket, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT bucket FROM o) b
UNION ALL SELECT o.bucket, o.k, o.row_id, o.n, t.next_no, CASE WHEN t.total + o.n >= {BUDGET} THEN 0 ELSE t.total + o.n END, CASE WHEN t.total + o.n >= {BUDGET} THEN t.next_no + 1 ELSE t.next_no END FROM t JOIN o ON o.bucket = t.bucket AND o.k = t.k + 1),
chunked AS (SELECT bucket, row_id, n, chunk_no FROM t WHERE k > 0)"""


@query(f"WITH {CHUNK_SQL} SELECT bucket, row_id, chunk_no FROM chunked")
def chunk_assign(spark, d):
    return C.chunked(_lengths(spark, d), BUDGET).select("bucket", "row_id", "chunk_no")


@query(f"""WITH {CHUNK_SQL}, c AS (SELECT DISTINCT bucket, chunk_no FROM chunked), k AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS size, row_number() OVER (PARTITION BY bucket ORDER BY chunk_no) - 1 AS place FROM c)
SELECT bucket, chunk_no, row_number() OVER (ORDER BY place / size, size, bucket) - 1 AS at FROM k""")
def chunk_interleave(spark, d):
    return C.interleaved(C.chunked(_lengths(spark, d), BUDGET).select("bucket", "chunk_no").distinct())


def _manifest(spark, d) -> DataFrame:
    chunks = C.chunked(_lengths(spark, d), BUDGET).join(_lengths(spark, d).select("row_id", "n"), "row_id")
    return chunks.groupBy("bucket").agg(F.countDistinct("chunk_no").alias("chunks"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))


@query(f"WITH {CHUNK_SQL} SELECT bucket, count(DISTINCT chunk_no) AS chunks, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens FROM chunked GROUP BY bucket")
def corpus_manifest(spark, d):
    return _manifest(spark, d)


@query(f"""WITH {CHUNK_SQL}, m AS (SELECT bucket, count(DISTINCT chunk_no) AS chunks FROM chunked GROUP BY bucket), f AS (SELECT bucket, count(DISTINCT chunk_no) AS files FROM chunked WHERE NOT (bucket = 'de' AND chunk_no = 0) GROUP BY bucket)
SELECT bucket, chunks, coalesce(files, 0) AS files, chunks = coalesce(files, 0) AS ok FROM m LEFT JOIN f USING (bucket)""")
def manifest_reconcile(spark, d):
    """Chunks that the manifest names against files found, one of which was taken away."""
    files = C.chunked(_lengths(spark, d), BUDGET).where("not (bucket = 'de' and chunk_no = 0)").groupBy("bucket").agg(F.countDistinct("chunk_no").alias("files"))
    both = _manifest(spark, d).select("bucket", "chunks").join(files, "bucket", "left").fillna(0, ["files"])
    return both.withColumn("ok", F.col("chunks") == F.col("files"))


@query(f"""WITH {ROWS_SQL}, t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS tokens FROM rws GROUP BY bucket)
SELECT bucket, tokens, round(tokens / {WANT}, 6) AS fill, CASE WHEN tokens / {WANT} < 0.5 THEN 'fail' WHEN tokens / {WANT} < 0.95 THEN 'warn' ELSE 'ok' END AS status FROM t""")
def bucket_fill(spark, d):
    return C.fill(T.corpus_rows(spark, d), WANT).select("bucket", "tokens", F.round("fill", 6).alias("fill"), "status")


@query(f"""WITH {ROWS_SQL}, m AS (SELECT bucket, avg(n) AS mean FROM rws GROUP BY bucket), s AS (SELECT bucket, 0.25 / (mean / (SELECT sum(mean) FROM m)) AS x FROM m)
SELECT bucket, round(x / (SELECT sum(x) FROM s), 6) AS mixture FROM s""")
def mixture_refit(spark, d):
    """Sample shares that reach equal token shares, given each bucket's mean tokens a sample."""
    m = T.corpus_rows(spark, d).groupBy("bucket").agg(F.avg("n_tokens").alias("mean"))
    total = S.W.partitionBy()
    s = m.withColumn("x", F.lit(0.25) / (F.col("mean") / F.sum("mean").over(total)))
    return s.select("bucket", F.round(F.col("x") / F.sum("x").over(total), 6).alias("mixture"))


@query(f"""WITH {ROWS_SQL} SELECT bucket, CASE WHEN n < 700 THEN 'easy' WHEN n < 4000 THEN 'medium' WHEN n < 16384 THEN 'hard' ELSE 'beyond' END AS band, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens FROM rws GROUP BY 1, 2""")
def difficulty_bands(spark, d):
    n = F.col("n_tokens")
    band = F.when(n < 700, "easy").when(n < 4000, "medium").when(n < 16384, "hard").otherwise("beyond")
    return T.corpus_rows(spark, d).groupBy("bucket", band.alias("band")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))


@query(f"""WITH {ROWS_SQL}, k AS (SELECT bucket, row_id, md5('held|' || row_id) < '147ae147' AS held_out FROM rws) SELECT bucket, row_id, held_out FROM k""")
def heldout_split(spark, d):
    """About 8 % of each bucket by a hash of the id, so a row's side never depends on others."""
    h = F.md5(F.concat(F.lit("held|"), F.col("row_id").cast("string")).cast("binary"))
    return T.corpus_rows(spark, d).select("bucket", "row_id", (h < F.lit("147ae147")).alias("held_out"))


@query(f"WITH {ROWS_SQL} SELECT bucket, source, count(*) AS rows FROM rws WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE text LIKE '%CC BY-NC%') GROUP BY bucket, source")
def excluded_sources(spark, d):
    """Rows of the sources in which no text carries a non-commercial licence."""
    rows = T.corpus_rows(spark, d)
    bad = rows.where(F.contains("text", F.lit("CC BY-NC"))).select("source").distinct()
    return rows.join(bad, "source", "left_anti").groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {ROWS_SQL}, c AS (SELECT *, sum(n) OVER (PARTITION BY bucket, source ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rws WHERE text <> '')
SELECT bucket, source, row_id FROM c WHERE coalesce(before, 0) < 5000""")
def head_by_tokens(spark, d):
    return C.head_by_tokens(T.corpus_rows(spark, d), 5000, "bucket", "source").select("bucket", "source", "row_id")


def _clips(spark, d) -> DataFrame:
    frames = T.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp_ntz").alias("seq"), F.col("event_id").alias("frame_id"))
    return C.clips(frames, 2)


CLIP_SQL = """f AS (SELECT user_id AS stream, event_type AS key, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY ts, event_id) AS run FROM f), p AS (SELECT *, (row_number() OVER (PARTITION BY stream, run ORDER BY ts, event_id) - 1) // 2 AS clip FROM r),
clips AS (SELECT stream, CAST(run AS BIGINT) AS run, clip, min(key) AS key FROM p GROUP BY stream, run, clip HAVING count(*) = 2)"""


@query(f"WITH {CLIP_SQL} SELECT stream, run, clip, key FROM clips")
def clip_sessionize(spark, d):
    return _clips(spark, d).select("stream", "run", "clip", "key")


@query(f"""WITH {CLIP_SQL}, cap AS (SELECT conv_id, arg_min(text, turn) AS caption FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT key, count(*) AS clips, count(caption) AS hits, round(count(caption) / count(*), 6) AS rate FROM clips LEFT JOIN cap ON conv_id = stream GROUP BY key""")
def caption_join_hit_rate(spark, d):
    first = T.turns(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("caption"))
    joined = _clips(spark, d).join(first, F.col("conv_id") == F.col("stream"), "left")
    return joined.groupBy("key").agg(F.count(F.lit(1)).alias("clips"), F.count("caption").alias("hits"), F.round(F.count("caption") / F.count(F.lit(1)), 6).alias("rate"))


_W, _H = "(200 + n_chars % 4000)", "(100 + doc_id * 37 % 3000)"


@query(f"""SELECT doc_id, CASE WHEN {_W} * {_H} <= {ROWS * PATCH * PATCH} THEN {_W} ELSE greatest({PATCH}, CAST(floor({_W} * sqrt({ROWS * PATCH * PATCH}.0::DOUBLE / ({_W} * {_H}))) AS BIGINT) // {PATCH} * {PATCH} - {PATCH}) END AS w,
CASE WHEN {_W} * {_H} <= {ROWS * PATCH * PATCH} THEN {_H} ELSE greatest({PATCH}, CAST(floor({_H} * sqrt({ROWS * PATCH * PATCH}.0::DOUBLE / ({_W} * {_H}))) AS BIGINT) // {PATCH} * {PATCH} - {PATCH}) END AS h FROM documents""")
def fit_image_geometry(spark, d):
    sized = T.table(spark, d, "documents").select("doc_id", (F.lit(200) + F.col("n_chars") % 4000).alias("w"), (F.lit(100) + F.col("doc_id") * 37 % 3000).alias("h"))
    w, h = media.fitted(F.col("w"), F.col("h"), PATCH, ROWS)
    return sized.select("doc_id", w.alias("w"), h.alias("h"))


@query("SELECT lang AS bucket, count(*) AS rows, count(*) FILTER (WHERE n_chars > 8000) AS oversize, max(n_chars) AS largest FROM documents GROUP BY lang")
def oversize_report(spark, d):
    return T.table(spark, d, "documents").groupBy(F.col("lang").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_chars") > 8000).alias("oversize"), F.max("n_chars").alias("largest"))


@query("""WITH c AS (SELECT event_type, user_id % 64 AS code, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_type, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS codes FROM p GROUP BY event_type""")
def symbol_entropy(spark, d):
    counts = T.table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 64).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(S.W.partitionBy("event_type"))
    return counts.withColumn("p", p).groupBy("event_type").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.count(F.lit(1)).alias("codes"))


@query(f"""WITH {CHUNK_SQL}, h AS (SELECT bucket, chunk_no, row_id, row_number() OVER (PARTITION BY bucket, chunk_no ORDER BY row_id) AS k FROM chunked) SELECT bucket, chunk_no, row_id FROM h WHERE chunk_no < 2 AND k <= 3""")
def stratified_sample(spark, d):
    """The first three rows of the first two chunks of each bucket."""
    chunks = C.chunked(_lengths(spark, d), BUDGET).where("chunk_no < 2")
    w = S.W.partitionBy("bucket", "chunk_no").orderBy("row_id")
    return chunks.withColumn("k", F.row_number().over(w)).where("k <= 3").select("bucket", "chunk_no", "row_id")


TENSOR_SQL = """names AS (SELECT 'model.layers.' || l || '.mlp.experts.' || e || '.' || p AS name, l, e FROM (SELECT unnest(range(1, 5)) AS l) a, (SELECT unnest(range(16)) AS e) b, (SELECT unnest(['gate_proj.weight', 'up_proj.weight', 'down_proj.weight', 'gate_proj.scale', 'up_proj.scale', 'down_proj.scale']) AS p) c
UNION ALL SELECT 'model.layers.' || l || p, l, NULL FROM (SELECT unnest(range(1, 5)) AS l) a, (SELECT unnest(['.mlp.gate.weight', '.mlp.gate.bias', '.input_norm.weight']) AS p) c
UNION ALL SELECT unnest(['model.embed_tokens.weight', 'lm_head.weight']), NULL, NULL), idx AS (SELECT name, 'shard-' || length(name) % 4 AS shard, l, e FROM names)"""


@query(f"""WITH {Q.GRID}, {TENSOR_SQL}, k AS (SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS nw FROM masks WHERE criterion = 'reap_1_1_1' AND rk > 8)
SELECT name, shard, CASE WHEN e IS NOT NULL AND nw IS NULL THEN 'dropped' WHEN e IS NOT NULL THEN 'renumbered' WHEN name LIKE '%.mlp.gate.%' THEN 'sliced' ELSE 'copied' END AS action,
CASE WHEN e IS NOT NULL AND nw IS NULL THEN NULL WHEN e IS NOT NULL THEN replace(name, '.experts.' || e || '.', '.experts.' || nw || '.') ELSE name END AS new_name FROM idx LEFT JOIN k ON layer = l AND expert = e""")
def tensor_plan(spark, d):
    m = Q.mask(spark, d)
    return tensors.plan(T.tensor_index(spark), S.renumbered(m), m)


def _files(spark) -> DataFrame:
    return spark.createDataFrame([("shard-0", 10), ("shard-1", 0), ("shard-2", 7), ("shard-9", 3)], "shard string, bytes bigint")


FILES_SQL = "files(shard, bytes) AS (VALUES ('shard-0', 10), ('shard-1', 0), ('shard-2', 7), ('shard-9', 3))"


@query(f"WITH {TENSOR_SQL}, {FILES_SQL} SELECT DISTINCT shard, 'missing' AS state FROM idx WHERE shard NOT IN (SELECT shard FROM files) UNION ALL SELECT shard, 'stray' FROM files WHERE shard NOT IN (SELECT shard FROM idx)")
def shard_referential_integrity(spark, d):
    return tensors.shard_integrity(T.tensor_index(spark), _files(spark))


@query(f"""WITH {Q.GRID}, {TENSOR_SQL}, {FILES_SQL}, k AS (SELECT layer, count(*) AS n FROM masks WHERE criterion = 'reap_1_1_1' AND rk > 8 GROUP BY layer)
SELECT 'missing_shards' AS rule, (SELECT count(DISTINCT shard) FROM idx WHERE shard NOT IN (SELECT shard FROM files)) AS violations
UNION ALL SELECT 'stray_shards', (SELECT count(*) FROM files WHERE shard NOT IN (SELECT shard FROM idx)) UNION ALL SELECT 'empty_shards', (SELECT count(*) FROM files WHERE bytes <= 0)
UNION ALL SELECT 'count_not_lower', (SELECT count(*) FROM k WHERE n >= 16) UNION ALL SELECT 'ragged_counts', (SELECT CASE WHEN count(DISTINCT n) = 1 THEN 0 ELSE 1 END FROM k)
UNION ALL SELECT 'expert_index_beyond_count', (SELECT count(*) FROM idx JOIN k ON layer = l WHERE e >= n)""")
def publish_preflight(spark, d):
    return checks.publish_rules(T.tensor_index(spark), _files(spark), Q.mask(spark, d), T.EXPERTS)


_OBS = "SELECT event_type AS bucket, user_id % 16 AS expert, 0.5 + value % 1 AS gate, 1.0 + abs(value) AS norm FROM events"


@query(f"SELECT bucket, expert, count(*) AS cnt, round(sum(gate), 4) AS gat, round(sum(gate * norm), 4) AS s, round(sum(gate * norm * gate * norm), 2) AS sq FROM ({_OBS}) o GROUP BY bucket, expert")
def streaming_fold_equals_batch(spark, d):
    """The running sums of six chunk files, folded two at a time by a stream."""
    from corvane.streaming.state import scratch

    value = F.col("value")
    obs = T.table(spark, d, "events").select(F.col("event_type").alias("bucket"), (F.col("user_id") % 16).alias("expert"), (F.lit(0.5) + value % 1).alias("gate"), (F.lit(1.0) + F.abs(value)).alias("norm"))
    at = scratch(spark, "fold")
    obs.repartition(6).write.parquet(f"{at}/chunks")
    out = stream.fold(spark, f"{at}/chunks", obs.schema, f"{at}/state", f"{at}/offsets")
    return out.select("bucket", "expert", "cnt", F.round("gat", 4).alias("gat"), F.round("s", 4).alias("s"), F.round("sq", 2).alias("sq"))


@query("""WITH c AS (SELECT vec_id, k, (hash_code + k * 7) % 256 AS b FROM (SELECT vec_id, vec_id * 31 % 256 AS hash_code FROM embeddings) e, (SELECT unnest(range(16)) AS k) q),
h AS (SELECT vec_id, 2 * k + p AS i, CASE WHEN p = 0 THEN b % 16 ELSE b // 16 END AS c FROM c, (SELECT unnest([0, 1]) AS p) q)
SELECT vec_id, round(sum((CASE WHEN c >= 8 THEN -1 ELSE 1 END) * [0, 0.5, 1, 1.5, 2, 3, 4, 6][c % 8 + 1] * 2.0 ** (vec_id % 5 - 2) * (i + 1)), 6) AS checksum FROM h GROUP BY vec_id""")
def dequant_fp4(spark, d):
    """4-bit values with a block scale, summed with their places."""
    packed = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((F.col("vec_id") * 31 % 256 + k * 7) % 256).cast("int"))
    values = media.dequantised_fp4(packed, F.array((F.col("vec_id") % 5 - 2 + 127).cast("int")))
    rows = T.table(spark, d, "embeddings").select("vec_id", values.alias("v"))
    return rows.select("vec_id", F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


_SOURCES = ["documents", "events", "no_such_table"]


@query("SELECT 'documents' AS source, true AS opened, (SELECT count(*) FROM documents) AS rows UNION ALL SELECT 'events', true, (SELECT count(*) FROM events) UNION ALL SELECT 'no_such_table', false, 0")
def source_scan_report(spark, d):
    """Sources that open, and one that is given up without a retry."""
    parts = []
    for name in _SOURCES:
        rows = scan.scanned(lambda name=name: T.table(spark, d, name))
        found = rows.agg(F.count(F.lit(1)).alias("rows")) if rows is not None else spark.createDataFrame([(0,)], "rows bigint")
        parts.append(found.select(F.lit(name).alias("source"), F.lit(rows is not None).alias("opened"), "rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RESUME = """f AS (SELECT user_id AS stream, event_type AS key, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY stream ORDER BY k) AND k % 5 <> 1 THEN 0 ELSE 1 END AS c FROM f),
r AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY k) AS run FROM g), p AS (SELECT *, (row_number() OVER (PARTITION BY stream, run ORDER BY k) - 1) // 2 AS clip FROM r)"""


@query(f"WITH {_RESUME} SELECT stream, CAST(run AS BIGINT) AS run, clip, min(key) AS key FROM p GROUP BY stream, run, clip HAVING count(*) = 2")
def clip_resume(spark, d):
    """Clips of a scan that broke off after every fifth row: what was gathered by then is lost."""
    w = S.W.partitionBy("stream").orderBy("seq", "frame_id")
    frames = T.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp_ntz").alias("seq"), F.col("event_id").alias("frame_id"))
    frames = frames.withColumn("broke", F.row_number().over(w) % 5 == 1)
    return C.clips(frames, 2, restart=F.col("broke")).select("stream", "run", "clip", "key")


@query("SELECT doc_id FROM documents WHERE doc_id >= 120")
def resume_scan(spark, d):
    """The rows behind the first 120 of an ordered source; the skip reaches the scan."""
    return scan.resumed(T.table(spark, d, "documents").select("doc_id"), "doc_id", 120)


@query("""WITH t AS (SELECT conv_id, turn, text, conv_id // 2 AS k FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0),
c AS (SELECT conv_id, k, 'c' || k AS key, substring(regexp_replace(string_agg(text || '<video>', ' ' ORDER BY turn).replace('<video>', ' '), '^\\s+|\\s+$', '', 'g'), 1, 2000) AS caption FROM t GROUP BY conv_id, k)
SELECT key, arg_min(caption, conv_id) AS caption FROM c GROUP BY key""")
def caption_lines(spark, d):
    """Captions of JSON lines, some of them broken, some without a key, some with a key that came before."""
    turns = T.turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("text", F.lit("<video>")).alias("value")))).alias("m"))
    said = F.transform("m", lambda x: F.struct(x["value"].alias("value"))).alias("conversations")
    key = F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("c"), F.floor(F.col("conv_id") / 2).cast("string")))
    line = F.to_json(F.struct(F.when(F.col("conv_id") % 3 == 0, key).alias("id"), F.when(F.col("conv_id") % 3 != 0, key).alias("video"), said))
    lines = turns.select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    return T.captions(lines, "conv_id")


@query(f"WITH {ROWS_SQL} SELECT bucket, source, row_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket, source ORDER BY row_id) AS k FROM rws) q WHERE k <= 5")
def row_cap(spark, d):
    return T.capped(T.corpus_rows(spark, d), 5, "row_id", "bucket", "source").select("bucket", "source", "row_id")


@query(f"WITH {TENSOR_SQL}, w AS (SELECT name FROM idx UNION ALL SELECT replace(name, 'layers.1.', 'layers.11.') FROM idx WHERE name LIKE '%layers.1.%') SELECT name FROM w WHERE name LIKE 'model.layers.1.%'")
def tensor_prefix_scan(spark, d):
    """The tensors of layer 1 where a layer 11 stands beside it."""
    index = T.tensor_index(spark).select("name")
    more = index.where(F.contains("name", F.lit("layers.1."))).select(F.replace("name", F.lit("layers.1."), F.lit("layers.11.")).alias("name"))
    return tensors.under(index.unionByName(more), "model.layers.1")


_MEDIA = ("en", "de")


def _media_rows(spark, d) -> DataFrame:
    """Corpus rows where two languages stand for media buckets, one of which has lost all of its media."""
    return T.corpus_rows(spark, d).withColumn("payload", F.when((F.col("bucket") != "de") & (F.col("row_id") % 3 > 0), F.col("row_id"))).withColumn("media", F.col("payload").isNotNull())


_MEDIA_SQL = f"{ROWS_SQL}, mr AS (SELECT *, CASE WHEN bucket <> 'de' AND row_id % 3 > 0 THEN row_id END AS payload FROM rws)"


@query(f"WITH {_MEDIA_SQL} SELECT bucket, row_id FROM mr WHERE bucket NOT IN ('en', 'de') OR payload IS NOT NULL")
def media_rows(spark, d):
    """Media rows without media are skipped."""
    return C.with_media(_media_rows(spark, d), _MEDIA, "payload").select("bucket", "row_id")


@query(f"""WITH {_MEDIA_SQL} SELECT bucket, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN payload IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS media_tokens, round(sum(n) / {WANT}, 6) AS share,
bucket IN ('en', 'de') AND sum(n) > 0 AND sum(CASE WHEN payload IS NOT NULL THEN n ELSE 0 END) = 0 AS refused FROM mr GROUP BY bucket""")
def media_totals(spark, d):
    """Tokens, those of media, and the bucket that is refused."""
    return C.media_totals(_media_rows(spark, d), _MEDIA, WANT).select("bucket", "tokens", "media_tokens", F.round("share", 6).alias("share"), "refused")


def _chunk_rows(spark, d) -> DataFrame:
    rows = _media_rows(spark, d)
    return rows.select("row_id", "n_tokens", "media").join(C.chunked(_lengths(spark, d), BUDGET).select("row_id", "bucket", "chunk_no"), "row_id")


_STORED = f"""{CHUNK_SQL}, w AS (SELECT bucket, row_id, n, chunk_no, bucket <> 'de' AND row_id % 3 > 0 AS media FROM chunked)
SELECT bucket, count(DISTINCT chunk_no) AS chunks, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN media THEN n ELSE 0 END) AS BIGINT) AS media_tokens FROM w GROUP BY bucket"""


@query(f"WITH {_STORED}")
def chunk_sink(spark, d):
    """The manifest of chunks that were written, one folder each."""
    from corvane.streaming.state import scratch

    return C.write_chunks(_chunk_rows(spark, d), scratch(spark, "chunks"), ("en",))


@query(f"WITH {_STORED}")
def chunk_append(spark, d):
    """The manifest of a corpus to which the last chunk of each bucket was appended."""
    from corvane.streaming.state import scratch

    at, rows = scratch(spark, "chunks"), _chunk_rows(spark, d)
    last = rows.withColumn("last", F.max("chunk_no").over(S.W.partitionBy("bucket"))).withColumn("late", (F.col("chunk_no") == F.col("last")) & (F.col("last") > 0)).drop("last")
    C.write_chunks(last.where("not late").drop("late"), at, ("en",))
    return C.append_chunks(last.where("late").drop("late"), at, ("en",))


def _messages(spark, d) -> DataFrame:
    return T.turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")).withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))


_RENDERED = "SELECT conv_id, string_agg(coalesce(nullif(role, ''), 'user') || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> ''"


@query(f"{_RENDERED} AND conv_id % 5 <> 4 GROUP BY conv_id")
def any_messages(spark, d):
    """Messages that stand under any of four names; a fifth is not looked for."""
    rows = _messages(spark, d).select("conv_id", *[F.when(F.col("conv_id") % 5 == k, F.col("m")).alias(c) for k, c in enumerate(("messages", "conversations", "conversation", "turns"))])
    return rows.select("conv_id", X.any_messages(*map(F.col, ("messages", "conversations", "conversation", "turns"))).alias("text")).where("text is not null")


@query(f"{_RENDERED} AND conv_id % 4 <> 0 GROUP BY conv_id")
def messages_from_json(spark, d):
    """Messages that come as JSON texts in two conventions, some of them broken."""
    other = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("from"), x["content"].alias("value"))))
    text = F.when(F.col("conv_id") % 4 == 0, "[{broken").when(F.col("conv_id") % 4 == 1, other).otherwise(F.to_json("m"))
    return _messages(spark, d).select("conv_id", X.rendered(X.messages_from_json(text)).alias("text")).where("text is not null")


@query("SELECT doc_id, source || '/' || lang AS scene, CASE WHEN doc_id % 4 = 0 OR text IS NULL OR text = '' THEN 'Describe this.' ELSE substring(text, 1, 20) END AS prompt FROM documents")
def scene_prompts(spark, d):
    """The scene of a frame's key, and a default prompt where a row has no text."""
    key = F.concat(F.lit("./../"), "source", F.lit("/"), "lang", F.lit("/frame"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    said = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.substring("text", 1, 20))
    return T.table(spark, d, "documents").select("doc_id", X.scene_key(key).alias("scene"), X.or_prompt(said, "Describe this.").alias("prompt"))


@query("""WITH v AS (SELECT vec_id, vec_id % 60 + 5 AS n, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), w AS (SELECT vec_id, n, e[1:n] AS a, CAST(floor(n * 24 / 16.0::DOUBLE) AS INTEGER) AS m FROM v WHERE n >= 6),
i AS (SELECT vec_id, n, a, m, unnest(range(m)) AS i FROM w), p AS (SELECT *, i * (n - 1) / greatest(m - 1, 1)::DOUBLE AS pos FROM i),
q AS (SELECT *, CAST(least(floor(pos), n - 1) AS INTEGER) AS lo FROM p), r AS (SELECT vec_id, i, a[lo + 1] + (pos - lo) * (a[least(lo + 1, n - 1) + 1] - a[lo + 1]) AS x FROM q),
t AS (SELECT vec_id, i, x / max(abs(x)) OVER (PARTITION BY vec_id) * 0.7 AS x FROM r)
SELECT vec_id, count(*) AS n, round(max(abs(x)), 6) AS peak, round(sum(x * (i + 1)), 6) AS checksum FROM t WHERE i < 48 GROUP BY vec_id""")
def audio_preparation(spark, d):
    """Vectors as waveforms of 16 values a second: to 24 a second, peak 0.7, two seconds at most, a quarter of a second at least."""
    wave = F.slice(F.transform("embedding", lambda x: x.cast("double")), F.lit(1), (F.col("vec_id") % 60 + 5).cast("int"))
    rows = T.table(spark, d, "embeddings").select("vec_id", media.prepared_audio(wave, 16, 24, seconds=2).alias("a")).where("a is not null")
    total = F.aggregate(F.transform("a", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.size("a").cast("bigint").alias("n"), F.round(F.array_max(F.transform("a", F.abs)), 6).alias("peak"), F.round(total, 6).alias("checksum"))


@query(f"SELECT doc_id, greatest(64, {ROWS} // greatest(1, (doc_id % 50) // 2)) AS per_frame, (doc_id % 5 + 1) * 8 * 12 + (doc_id % 7 + 1) * 6 * 10 AS rows, ((doc_id % 5 + 1) * 8 * 12 + (doc_id % 7 + 1) * 6 * 10) // 4 AS tokens FROM documents")
def video_budget(spark, d):
    """The patch rows that a frame may take, and the rows and tokens of two clips."""
    grids = F.array(F.array(F.col("doc_id") % 5 + 1, F.lit(8).cast("bigint"), F.lit(12).cast("bigint")), F.array(F.col("doc_id") % 7 + 1, F.lit(6).cast("bigint"), F.lit(10).cast("bigint")))
    return T.table(spark, d, "documents").select("doc_id", media.rows_per_frame(F.col("doc_id") % 50, 2, ROWS).cast("bigint").alias("per_frame"), media.patch_rows(grids).alias("rows"), media.token_count(grids, 2).alias("tokens"))


@query("""WITH c AS (SELECT vec_id, i, (vec_id * 31 + i * 7) % 256 AS c FROM embeddings, (SELECT unnest(range(36)) AS i) q), k AS (SELECT vec_id, i, c % 8 AS m, c // 8 % 16 AS e, c >= 128 AS neg, c FROM c WHERE c % 128 <> 127)
SELECT vec_id, round(sum((CASE WHEN neg THEN -1 ELSE 1 END) * (CASE WHEN e = 0 THEN m / 8.0::DOUBLE / 64 ELSE (1 + m / 8.0::DOUBLE) * 2.0::DOUBLE ** (e - 7) END) * (1 + (i // 24) * 2 + (i % 6) // 4) * (i + 1)), 5) AS checksum FROM k GROUP BY vec_id""")
def dequant_fp8(spark, d):
    """Six by six 8-bit values in squares of four with a scale each, summed with their places; codes that are no number are left out."""
    codes = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: ((F.col("vec_id") * 31 + i * 7) % 256).cast("int"))
    values = media.dequantised_fp8(codes, F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]), 6, 4)
    rows = T.table(spark, d, "embeddings").select("vec_id", F.filter(F.transform(values, lambda x, i: x * (i + 1)), lambda x: ~F.isnan(x)).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("checksum"))


@query(f"WITH {Q.GRID} SELECT DISTINCT layer FROM masks WHERE layer NOT IN (1, 3)")
def untrained_routers(spark, d):
    """Layers that the mask prunes and the refit (of layers 1 and 3) doesn't cover."""
    return tensors.untrained_layers(Q.mask(spark, d), spark.createDataFrame([(1,), (3,)], "layer int"))


@query(f"""WITH {Q.GRID}, k AS (SELECT layer, list(expert ORDER BY expert) AS ids FROM masks WHERE criterion = 'reap_1_1_1' AND rk > 8 GROUP BY layer), o AS (SELECT layer, list(expert ORDER BY expert) AS ids FROM masks WHERE criterion = 'total_0_1_1' AND rk > 8 GROUP BY layer)
SELECT layer, min(p) AS at FROM (SELECT k.layer, p, k.ids[p + 1] AS a, o.ids[p + 1] AS b FROM k JOIN o USING (layer), (SELECT unnest(range(8)) AS p) q) z WHERE a <> b GROUP BY layer""")
def keep_order_mismatch(spark, d):
    """Where the kept experts of two masks differ first."""
    kept = [Q.mask(spark, d, c).where("not pruned").groupBy("layer").agg(F.array_sort(F.collect_list("expert")).alias("ids")) for c in ("reap_1_1_1", "total_0_1_1")]
    return tensors.first_mismatch(*kept)


@query(f"WITH {Q.GRID} SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS expert, expert * 10 + layer AS value FROM masks WHERE criterion = 'reap_1_1_1' AND rk > 8")
def sliced_routers(spark, d):
    """Router rows of the kept experts in their new order, checked against the order that a refit was made for."""
    m = Q.mask(spark, d)
    kept = S.renumbered(m)
    routers = kept.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("new_expert", "expert"))).alias("o")).select("layer", F.transform("o", lambda x: x["expert"]).alias("ids"))
    checked = tensors.require_keep_order(kept, routers)
    rows = m.select("layer", "expert", F.array((F.col("expert") * 10 + F.col("layer")).cast("double")).alias("values"))
    return tensors.sliced_rows(rows, kept).join(F.broadcast(checked.select("layer")), "layer").select("layer", "expert", F.get("values", F.lit(0)).cast("int").alias("value"))


@query(f"""WITH {Q.GRID}, {TENSOR_SQL}, k AS (SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS nw FROM masks WHERE criterion = 'reap_1_1_1' AND rk > 8)
SELECT CASE WHEN e IS NOT NULL THEN replace(name, '.experts.' || e || '.', '.experts.' || nw || '.') ELSE name END AS name, shard FROM idx LEFT JOIN k ON layer = l AND expert = e WHERE e IS NULL OR nw IS NOT NULL""")
def rebuilt_index(spark, d):
    m = Q.mask(spark, d)
    return tensors.rebuilt(tensors.plan(T.tensor_index(spark), S.renumbered(m), m))


@query("""SELECT 'uniform' AS kind, 8 AS n_routed_experts, false AS ragged, 16 AS experts_before, '' AS per_layer UNION ALL SELECT 'ragged', 16, true, 16, '1:8,2:8,3:8,4:7'""")
def pruned_config(spark, d):
    """The configuration of a mask of equal counts, and of one that prunes one expert more in the last layer."""
    m = Q.mask(spark, d)
    odd = m.withColumn("pruned", F.when(F.col("layer") == 4, F.col("rank") <= 9).otherwise(F.col("pruned")))
    text = F.coalesce(F.array_join(F.transform(F.map_entries("per_layer"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ","), F.lit(""))
    parts = [tensors.pruned_config(x, T.EXPERTS).select(F.lit(k).alias("kind"), "n_routed_experts", "ragged", "experts_before", text.alias("per_layer")) for k, x in (("uniform", m), ("ragged", odd))]
    return parts[0].unionByName(parts[1])


@query("SELECT * FROM (VALUES ('stage_not_done', 1), ('no_prune_block', 0), ('ragged', 1), ('count_not_lower', 1), ('unexpected_count', 1), ('required_files', 1), ('partial_files', 1), ('truncated', 1)) t(rule, violations)")
def publish_metadata(spark, d):
    """Every rule on stage, configuration and files that a broken release breaks."""
    state = spark.createDataFrame([("refit", '{"_reap": {"experts_before": 16}, "_ragged_experts": true, "n_routed_experts": 16}')], "stage string, config string")
    files = spark.createDataFrame([("config.json", 10, None), ("shard-0", 90, 100), ("shard-1", 100, 100), ("shard-2.tmp", 1, None)], "name string, bytes bigint, spans bigint")
    return checks.metadata_rules(state, files, ["config.json", "tokenizer.json"], expected=8)


@query("""WITH p AS (SELECT vec_id, i, (vec_id + i) % 4 = 0 AS hole, i + 1000.0::DOUBLE AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings, (SELECT unnest(range(16)) AS i) q),
n AS (SELECT *, sum(CASE WHEN hole THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS j FROM p)
SELECT vec_id, round(sum(CASE WHEN hole THEN e[CAST(j AS INTEGER)] ELSE id END * (i + 1)), 6) AS checksum FROM n GROUP BY vec_id""")
def positional_splice(spark, d):
    """The i-th media value put at the i-th placeholder."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when((F.col("vec_id") + i) % 4 == 0, F.lit(-1.0)).otherwise(i + F.lit(1000.0)))
    rows = T.table(spark, d, "embeddings").select("vec_id", ids.alias("ids"), F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 4).alias("media"))
    out = rows.select("vec_id", X.spliced(F.col("ids"), F.lit(-1.0), F.col("media")).alias("v"))
    return out.select("vec_id", F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


def _streamed(spark, d, *orders) -> DataFrame:
    """The running sums of chunk files that arrive in several goes, each a list of chunk numbers, folded after each."""
    from corvane.streaming.state import scratch

    value = F.col("value")
    obs = T.table(spark, d, "events").select(F.col("event_type").alias("bucket"), (F.col("user_id") % 16).alias("expert"), (F.lit(0.5) + value % 1).alias("gate"), (F.lit(1.0) + F.abs(value)).alias("norm"), F.pmod("event_id", F.lit(6)).alias("chunk"))
    at, out = scratch(spark, "fold"), None
    for order in orders:
        for k in order:
            obs.where(F.col("chunk") == k).drop("chunk").coalesce(1).write.mode("append").parquet(f"{at}/chunks")
        out = stream.fold(spark, f"{at}/chunks", obs.drop("chunk").schema, f"{at}/state", f"{at}/offsets")
    return out.select("bucket", "expert", "cnt", F.round("gat", 4).alias("gat"), F.round("s", 4).alias("s"), F.round("sq", 2).alias("sq"))


_FOLDED = f"SELECT bucket, expert, count(*) AS cnt, round(sum(gate), 4) AS gat, round(sum(gate * norm), 4) AS s, round(sum(gate * norm * gate * norm), 2) AS sq FROM ({_OBS}) o GROUP BY bucket, expert"


@query(_FOLDED)
def streaming_late_topup(spark, d):
    """A chunk that comes after the corpus was folded counts once, and the others don't count again."""
    return _streamed(spark, d, (0, 1, 2, 3, 4), (5,))


@query(_FOLDED)
def streaming_any_order(spark, d):
    """The same chunks in another order and in other goes."""
    return _streamed(spark, d, (5, 3), (0, 4, 1, 2))
