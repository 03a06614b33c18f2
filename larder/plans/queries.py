"""One query per operator over the driver's tables, and the same in SQL.

The mutation log that most queries read is made from `events`: a user's events are the versions of one
key, an `error` deletes it, and every 500 events are a generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import bloom, workload
from larder.functions.hashing import as_decimal, fnv1a64
from larder.operators import log as ops
from larder.operators import metrics, recovery
from larder.streaming.ingest import flush_points

GENERATION, BATCH = 500, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    deleted = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("key"),
        F.expr(f"event_id div {GENERATION}").alias("gen"),
        F.col("event_id").alias("pos"),
        F.expr(f"event_id div {BATCH}").alias("batch_id"),
        (F.col("event_id") % BATCH != BATCH - 1).alias("pending"),
        deleted.alias("deleted"),
        F.when(~deleted, F.col("props")).alias("value"),
    )


LOG = f"""log AS (
    SELECT CAST(user_id AS VARCHAR) AS key, event_id // {GENERATION} AS gen, event_id AS pos, event_id // {BATCH} AS batch_id,
           event_id % {BATCH} <> {BATCH - 1} AS pending, event_type = 'error' AS deleted, CASE WHEN event_type <> 'error' THEN props END AS value
    FROM events)"""
NEWEST = f"{LOG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC, pos DESC) AS r FROM log)"
RECORDS = f"""{LOG}, records AS (
    SELECT *, 13 + strlen(key) + coalesce(strlen(value), 0) AS size FROM log
    QUALIFY row_number() OVER (PARTITION BY gen, key ORDER BY pos DESC) = 1)"""
ASKED = "asked AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer)"
HASHED = """hashed AS (
    SELECT *, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::HUGEINT)),
                          lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM {})"""
SIZES = """sizes AS (
    SELECT gen, n, greatest(512, least(268435456, ceil(-n * ln(0.01) / (ln(2) * ln(2)))::BIGINT)) AS m,
           greatest(1, least(16, floor(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2) + 0.5)::INT)) AS k
    FROM (SELECT gen, count(DISTINCT key) AS n FROM log GROUP BY gen))"""
PROBES = "list_transform(range(0, k), lambda i: ((h % 4294967296 + i * (h // 4294967296 + CASE WHEN (h // 4294967296) % 2 = 0 THEN 1 ELSE 0 END)) % m)::BIGINT)"
BITS = f"bits AS (SELECT DISTINCT gen, m, k, unnest({PROBES}) AS bit_index FROM (SELECT DISTINCT gen, key, h FROM hashed) JOIN sizes USING (gen))"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {NEWEST} SELECT key, gen, pos, value FROM ranked WHERE r = 1 AND NOT deleted")
def visible_state(spark, sf_dir):
    return ops.visible(mutation_log(spark, sf_dir)).select("key", "gen", "pos", "value")


@query(f"WITH {NEWEST} SELECT key, gen, pos FROM ranked WHERE r = 1 AND deleted")
def tombstoned_keys(spark, sf_dir):
    return ops.tombstoned(mutation_log(spark, sf_dir)).select("key", "gen", "pos")


@query(
    f"""WITH {RECORDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC) AS r FROM records)
    SELECT count(DISTINCT gen) AS segments_in, count(*) AS records_in, count(*) FILTER (WHERE r = 1 AND NOT deleted) AS records_out,
           count(*) FILTER (WHERE r = 1 AND deleted) AS tombstones_purged, CAST(sum(size) AS BIGINT) AS bytes_in,
           CAST(sum(size) FILTER (WHERE r = 1 AND NOT deleted) AS BIGINT) AS bytes_out FROM ranked"""
)
def compaction_result(spark, sf_dir):
    return ops.compaction_result(mutation_log(spark, sf_dir))


@query(
    f"""WITH {RECORDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC) AS r FROM records)
    SELECT round(100.0::DOUBLE * (sum(size) - sum(size) FILTER (WHERE r = 1 AND NOT deleted)) / sum(size), 6) AS reclaimed_pct FROM ranked"""
)
def reclaimed_share(spark, sf_dir):
    done = ops.compaction_result(mutation_log(spark, sf_dir))
    return done.select(F.round(metrics.reclaimed(F.col("bytes_in"), F.col("bytes_out")), 6).alias("reclaimed_pct"))


@query(f"WITH {RECORDS} SELECT gen, count(*) AS entries, count(*) FILTER (WHERE deleted) AS tombstones, CAST(sum(size) AS BIGINT) AS bytes FROM records GROUP BY gen")
def segment_stats(spark, sf_dir):
    return ops.segment_stats(mutation_log(spark, sf_dir))


@query(
    f"""WITH {LOG}, tail AS (SELECT * FROM log WHERE gen = (SELECT max(gen) FROM log) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1)
    SELECT count(*) AS keys, CAST(sum(13 + strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM tail"""
)
def memtable_size(spark, sf_dir):
    log = mutation_log(spark, sf_dir)
    last = F.broadcast(log.agg(F.max("gen").alias("last")))
    return ops.memtable_size(log.join(last, F.col("gen") == F.col("last")))


@query(f"WITH {LOG} SELECT key, count(*) AS versions, count(*) - 1 AS shadowed FROM log GROUP BY key")
def shadowed_versions(spark, sf_dir):
    return ops.shadowed(mutation_log(spark, sf_dir))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))


@query(f"WITH {NEWEST}, {ASKED} SELECT a.key, r.key IS NOT NULL AS found, value FROM asked a LEFT JOIN (SELECT * FROM ranked WHERE r = 1 AND NOT deleted) r ON a.key = r.key")
def point_get_many(spark, sf_dir):
    return ops.get_many(asked(spark, sf_dir), mutation_log(spark, sf_dir))


@query(f"WITH {NEWEST}, {ASKED} SELECT a.key, r.key IS NOT NULL AS found FROM asked a LEFT JOIN (SELECT * FROM ranked WHERE r = 1 AND NOT deleted) r ON a.key = r.key")
def has_many(spark, sf_dir):
    return ops.has_many(asked(spark, sf_dir), mutation_log(spark, sf_dir))


@query(f"WITH {NEWEST}, {ASKED} SELECT key FROM asked WHERE key NOT IN (SELECT key FROM ranked WHERE r = 1 AND NOT deleted)")
def miss_keys(spark, sf_dir):
    return ops.missing(asked(spark, sf_dir), mutation_log(spark, sf_dir))


@query(
    f"""WITH {NEWEST}, {ASKED}, layers AS (SELECT gen, row_number() OVER (ORDER BY gen DESC) AS layer FROM (SELECT DISTINCT gen FROM log))
    SELECT a.key, CASE WHEN r.key IS NULL THEN 'miss' WHEN r.deleted THEN 'tombstone' ELSE 'hit' END AS outcome,
           coalesce(l.layer, (SELECT count(*) FROM layers)) AS layers_read
    FROM asked a LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON a.key = r.key LEFT JOIN layers l ON l.gen = r.gen"""
)
def layer_hit_report(spark, sf_dir):
    return ops.layer_hits(asked(spark, sf_dir), mutation_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT batch_id, key, pos, deleted, value FROM log QUALIFY row_number() OVER (PARTITION BY batch_id, key ORDER BY pos DESC) = 1")
def batch_last_write_wins(spark, sf_dir):
    return ops.batch_state(mutation_log(spark, sf_dir)).select("batch_id", "key", "pos", "deleted", "value")


@query(f"WITH {LOG} SELECT batch_id, count(*) AS len, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS size FROM log GROUP BY batch_id")
def batch_sizes(spark, sf_dir):
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return mutation_log(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("len"), F.sum(size).alias("size"))


@query(
    f"""WITH {LOG}, layers AS (SELECT key, 2 AS gen, pos, deleted, value FROM log WHERE gen % 2 = 1 UNION ALL SELECT key, 1, pos, deleted, value FROM log)
    SELECT key, value FROM layers QUALIFY row_number() OVER (PARTITION BY key ORDER BY gen DESC, pos DESC) = 1 AND NOT deleted"""
)
def overlay_replay(spark, sf_dir):
    log = mutation_log(spark, sf_dir).select("key", "gen", "pos", "deleted", "value")
    return ops.visible(ops.overlay(log.where("gen % 2 = 1"), log)).select("key", "value")


def damaged_log(spark, sf_dir):
    log = mutation_log(spark, sf_dir)
    bad = F.broadcast(log.agg((F.expr("count(*) * 7777 div 10000")).alias("bad")))
    nbytes = ops.record_bytes(F.col("key"), F.col("value"))
    return log.crossJoin(bad).select("key", "pos", "pending", nbytes.alias("nbytes"), F.when(F.col("pos") == F.col("bad"), "corrupt").otherwise("ok").alias("status"))


DAMAGED = f"""{LOG}, damaged AS (
    SELECT key, pos, pending, 13 + strlen(key) + coalesce(strlen(value), 0) AS nbytes, CASE WHEN pos = (SELECT count(*) * 7777 // 10000 FROM log) THEN 'corrupt' ELSE 'ok' END AS status FROM log),
    groups AS (SELECT *, pos < coalesce((SELECT min(pos) FROM damaged WHERE status <> 'ok'), 9223372036854775807) AS valid,
               coalesce(sum(CASE WHEN pending THEN 0 ELSE 1 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM damaged),
    judged AS (SELECT *, valid AND bool_or(valid AND NOT pending) OVER (PARTITION BY island) AS applied FROM groups)"""


@query(f"WITH {DAMAGED} SELECT key, pos FROM judged WHERE applied")
def recover_committed(spark, sf_dir):
    return recovery.committed(damaged_log(spark, sf_dir)).select("key", "pos")


@query(
    f"""WITH {DAMAGED} SELECT count(*) FILTER (WHERE applied) AS records_applied, CAST(sum(nbytes) FILTER (WHERE NOT applied) AS BIGINT) AS discarded_bytes,
    coalesce(min_by(status, pos) FILTER (WHERE status <> 'ok'), CASE WHEN count(*) FILTER (WHERE NOT applied) > 0 THEN 'uncommitted' END) AS cause FROM judged"""
)
def recovery_report(spark, sf_dir):
    return recovery.report(damaged_log(spark, sf_dir))


@query(
    """WITH names AS (
        SELECT CAST(o_orderkey * 37 % 1009 AS VARCHAR) || '.seg' AS name FROM orders UNION ALL SELECT lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '.seg' FROM orders
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR) || '.tmp' FROM orders UNION ALL SELECT '-' || CAST(o_orderkey AS VARCHAR) || '.seg' FROM orders)
    SELECT DISTINCT name, TRY_CAST(regexp_extract(name, '^\\+?([0-9]+)\\.seg$', 1) AS BIGINT) AS gen,
           lpad(CAST(TRY_CAST(regexp_extract(name, '^\\+?([0-9]+)\\.seg$', 1) AS BIGINT) AS VARCHAR), 20, '0') || '.seg' AS padded FROM names"""
)
def legacy_name_order(spark, sf_dir):
    from larder.sources.records import segment_name, segment_number

    k = F.col("o_orderkey").cast("long")
    seg = F.lit(".seg")
    forms = F.array(F.concat((k * 37 % 1009).cast("string"), seg), F.concat(F.lpad(k.cast("string"), 20, "0"), seg), F.concat(k.cast("string"), F.lit(".tmp")), F.concat(F.lit("-"), k.cast("string"), seg))
    names = table(spark, sf_dir, "orders").select(F.explode(forms).alias("name")).distinct()
    return names.select("name", segment_number(F.col("name")).alias("gen")).withColumn("padded", segment_name(F.col("gen")))


@query(f"WITH keys AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events), {HASHED.format('keys')} SELECT key, CAST(h AS VARCHAR) AS hash FROM hashed")
def fnv1a64_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    return keys.select("key", as_decimal(fnv1a64(F.col("key").cast("binary"))).cast("string").alias("hash"))


@query(
    """WITH asked AS (SELECT n_nationkey * n_nationkey * 100 AS n, p FROM nation, (VALUES (0.01::DOUBLE), (0.001), (0.99), (0.0)) AS t(p)),
    clean AS (SELECT n, p, greatest(n, 1)::DOUBLE AS c, CASE WHEN p > 0 AND p < 1 THEN p ELSE 0.01 END AS q FROM asked)
    SELECT CAST(n AS BIGINT) AS n, p, greatest(512, least(268435456, ceil(-c * ln(q) / (ln(2) * ln(2)))::BIGINT)) AS m,
           CAST(greatest(1, least(16, floor(ceil(-c * ln(q) / (ln(2) * ln(2))) / c * ln(2) + 0.5))) AS INTEGER) AS k FROM clean"""
)
def bloom_sizing(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation").select((n * n * 100).alias("n"), F.explode(F.array(*(F.lit(p) for p in (0.01, 0.001, 0.99, 0.0)))).alias("p"))
    m, k = bloom.sizing(F.col("n"), F.col("p"))
    return rows.select("n", "p", m.alias("m"), k.alias("k"))


def keyed(spark, sf_dir):
    return mutation_log(spark, sf_dir).select("gen", F.col("key").cast("binary").alias("key")).distinct()


@query(f"WITH {LOG}, {HASHED.format('log')}, {SIZES}, {BITS} SELECT gen, m, CAST(k AS INTEGER) AS k, count(*) AS bits, CAST(sum(bit_index) AS BIGINT) AS places FROM bits GROUP BY gen, m, k")
def bloom_bits_per_segment(spark, sf_dir):
    return bloom.build(keyed(spark, sf_dir), 0.01).groupBy("gen", "m", "k").agg(F.count("*").alias("bits"), F.sum("bit_index").alias("places"))


@query(f"WITH {LOG}, {HASHED.format('log')}, {SIZES}, {BITS} SELECT gen, round(pow(count(*)::DOUBLE / m, k), 12) AS fpr FROM bits GROUP BY gen, m, k")
def bloom_fpr_estimate(spark, sf_dir):
    return bloom.estimate(bloom.build(keyed(spark, sf_dir), 0.01)).select("gen", F.round("fpr", 12).alias("fpr"))


@query(
    f"""WITH {LOG}, {HASHED.format('log')}, {SIZES}, {BITS}, {ASKED}, {HASHED.format('asked').replace('hashed AS', 'asked_hashed AS')},
    probes AS (SELECT key, gen, k, unnest({PROBES}) AS bit_index FROM asked_hashed, sizes),
    maybe AS (SELECT p.key, p.gen, count(b.bit_index) = count(*) AS maybe FROM probes p LEFT JOIN bits b ON b.gen = p.gen AND b.bit_index = p.bit_index GROUP BY p.key, p.gen),
    real AS (SELECT DISTINCT key, gen FROM log)
    SELECT key, count(*) AS segments, count(*) FILTER (WHERE NOT maybe) AS pruned, count(*) FILTER (WHERE maybe AND r.key IS NULL) AS false_positives
    FROM maybe LEFT JOIN real r USING (key, gen) GROUP BY key"""
)
def bloom_prune_report(spark, sf_dir):
    keys = keyed(spark, sf_dir)
    sizes = bloom.sized(keys, 0.01)
    wanted = asked(spark, sf_dir).select(F.col("key").cast("binary").alias("key")).distinct()
    total = F.broadcast(sizes.agg(F.countDistinct("gen").alias("segments")))
    counts = bloom.counted(wanted, bloom.placed(keys, 0.01), sizes)
    real = keys.where("gen IS NOT NULL").groupBy("key").agg(F.count("*").alias("real"))  # a filter lets all its own keys pass
    out = wanted.join(counts, "key", "left").join(real, "key", "left").crossJoin(total)
    maybe = F.coalesce("maybe", F.lit(0))
    return out.select(F.col("key").cast("string").alias("key"), "segments", (F.col("segments") - maybe).alias("pruned"), (maybe - F.coalesce("real", F.lit(0))).alias("false_positives"))


@query(
    f"""WITH {LOG}, {HASHED.format('log')}, {SIZES}, {BITS},
    bytes AS (SELECT gen, bit_index // 8 AS place, sum(1 << (bit_index % 8)::INT) AS b FROM bits GROUP BY ALL),
    spine AS (SELECT gen, m, k, unnest(range(0, (m + 63) // 64 * 8)) AS place FROM sizes)
    SELECT gen, upper(lpad(to_hex(m & 255), 2, '0') || lpad(to_hex(m >> 8 & 255), 2, '0') || lpad(to_hex(m >> 16 & 255), 2, '0') || lpad(to_hex(m >> 24 & 255), 2, '0') || lpad(to_hex(k), 2, '0')
           || string_agg(lpad(to_hex(coalesce(b, 0)::BIGINT), 2, '0'), '' ORDER BY place)) AS filter
    FROM spine LEFT JOIN bytes USING (gen, place) GROUP BY gen, m, k"""
)
def encoded_filters(spark, sf_dir):
    return bloom.encoded(bloom.filters(bloom.build(keyed(spark, sf_dir), 0.01), bloom.sized(keyed(spark, sf_dir), 0.01))).select("gen", F.hex("data").alias("filter"))


def samples(spark, sf_dir):
    """Gaps between a user's events as latencies."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("ns", gap).where("ns IS NOT NULL").select("us", "kind", "ns")


SAMPLES = """samples AS (
    SELECT * FROM (SELECT epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS kind,
                   epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS ns FROM events) WHERE ns IS NOT NULL)"""


@query(
    f"""WITH {SAMPLES} SELECT kind, count(*) AS n, round(avg(ns) / 1e3, 3) AS mean_us, quantile_disc(ns, 0.5) / 1e3 AS p50_us, quantile_disc(ns, 0.95) / 1e3 AS p95_us,
    quantile_disc(ns, 0.99) / 1e3 AS p99_us, quantile_disc(ns, 0.999) / 1e3 AS p999_us, max(ns) / 1e3 AS max_us, count(*) / 240.0::DOUBLE AS ops_per_sec FROM samples GROUP BY kind"""
)
def latency_summary(spark, sf_dir):
    return metrics.summary(samples(spark, sf_dir), seconds=240)


BUCKETS = 240


def bucketed(spark, sf_dir):
    s = samples(spark, sf_dir)
    span = F.broadcast(s.agg(F.min("us").alias("low"), F.max("us").alias("high")))
    sec = F.expr(f"cast((us - low) * {BUCKETS} div (high - low + 1) as int)")
    return s.crossJoin(span).select(sec.alias("sec"), "kind", "ns")


BUCKETED = f"{SAMPLES}, bucketed AS (SELECT CAST((us - low) * {BUCKETS} // (high - low + 1) AS INTEGER) AS sec, kind, ns FROM samples, (SELECT min(us) AS low, max(us) AS high FROM samples))"


@query(
    f"""WITH {BUCKETED}, gauges AS (SELECT sec, CAST(max(ns % 5) AS INTEGER) AS segments FROM bucketed WHERE sec % 7 = 3 GROUP BY sec),
    spine AS (SELECT CAST(i AS INTEGER) AS second FROM range({BUCKETS}) AS t(i)),
    filled AS (SELECT second, CAST(coalesce(last_value(nullif(segments, 0) IGNORE NULLS) OVER (ORDER BY second ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS segments FROM spine LEFT JOIN gauges ON sec = second),
    per AS (SELECT sec, count(*) FILTER (WHERE kind = 'read') AS reads, count(*) FILTER (WHERE kind = 'write') AS writes,
            quantile_disc(ns, 0.5) FILTER (WHERE kind = 'read') AS rp50, quantile_disc(ns, 0.99) FILTER (WHERE kind = 'read') AS rp99, max(ns) FILTER (WHERE kind = 'read') AS rmax,
            quantile_disc(ns, 0.99) FILTER (WHERE kind = 'write') AS wp99, max(ns) FILTER (WHERE kind = 'write') AS wmax FROM bucketed GROUP BY sec),
    spent AS (SELECT sec, CAST(sum(ns % 97) AS BIGINT) AS ms FROM bucketed WHERE sec % 11 = 5 GROUP BY sec)
    SELECT second, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes, coalesce(rp50 / 1e3, 0.0::DOUBLE) AS read_p50_us, coalesce(rp99 / 1e3, 0.0::DOUBLE) AS read_p99_us,
           coalesce(rmax / 1e3, 0.0::DOUBLE) AS read_max_us, coalesce(wp99 / 1e3, 0.0::DOUBLE) AS write_p99_us, coalesce(wmax / 1e3, 0.0::DOUBLE) AS write_max_us,
           segments, coalesce(ms, 0) AS compaction_ms FROM filled LEFT JOIN per ON per.sec = second LEFT JOIN spent ON spent.sec = second"""
)
def per_second_series(spark, sf_dir):
    s = bucketed(spark, sf_dir)
    gauges = s.where("sec % 7 = 3").groupBy("sec").agg(F.max(F.col("ns") % 5).cast("int").alias("segments"))
    return metrics.series(s, gauges, BUCKETS, compactions(s))


def compactions(s):
    return s.where("sec % 11 = 5").select("sec", (F.col("ns") % 97).alias("ms"))


@query(f"WITH {BUCKETED}, spent AS (SELECT ns % 97 AS ms FROM bucketed WHERE sec % 11 = 5) SELECT count(*) AS compactions, CAST(coalesce(sum(ms), 0) AS BIGINT) AS total_ms, CAST(coalesce(max(ms), 0) AS BIGINT) AS longest_ms FROM spent")
def compaction_times(spark, sf_dir):
    return metrics.compaction_times(compactions(bucketed(spark, sf_dir)))


@query(f"WITH {BUCKETED} SELECT count(*) / (max(sec) + 1)::DOUBLE AS ops_per_sec FROM bucketed")
def throughput_capped(spark, sf_dir):
    return metrics.throughput(bucketed(spark, sf_dir), BUCKETS, capped=True)


@query(
    """WITH ids AS (SELECT c_custkey AS id, unhex(lpad(to_hex(c_custkey), 16, '0')) AS b FROM customer)
    SELECT id, sha256(b) AS key, sha256('miss'::BLOB || b) AS miss_key, lpad(lower(to_hex(id)), 64, '0') AS sequential_key FROM ids"""
)
def generated_keys(spark, sf_dir):
    i = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(i.alias("id"), workload.sha_key(i).alias("key"), workload.miss_key(i).alias("miss_key"), workload.sequential_key(i).alias("sequential_key"))


@query("SELECT CAST(p_size AS BIGINT) AS value_size, CAST(ceil(1048576 / (64 + p_size + 13)::DOUBLE) AS BIGINT) AS records FROM part GROUP BY p_size")
def segment_capacity(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("value_size")).distinct()
    return sizes.select("value_size", workload.records_per_segment(F.col("value_size")).alias("records"))


ZIPF_N = 1000
ZETA = workload.zeta(ZIPF_N)
ETA = (1 - (2 / ZIPF_N) ** (1 - workload.THETA)) / (1 - workload.zeta(2) / ZETA)


@query(
    f"""WITH draws AS (SELECT event_id, (event_id % 100000 + 0.5::DOUBLE) / 100000 AS u FROM events)
    SELECT event_id, CASE WHEN u * {ZETA!r}::DOUBLE < 1 THEN 0 WHEN u * {ZETA!r}::DOUBLE < {1 + 0.5**workload.THETA!r}::DOUBLE THEN 1
           ELSE least({ZIPF_N - 1}, floor({ZIPF_N} * pow({ETA!r}::DOUBLE * u - {ETA!r}::DOUBLE + 1, {1 / (1 - workload.THETA)!r}::DOUBLE))::BIGINT) END::BIGINT AS rank FROM draws"""
)
def zipf_ranks(spark, sf_dir):
    u = (F.col("event_id") % 100000 + 0.5) / 100000
    return table(spark, sf_dir, "events").select("event_id", workload.zipf_rank(u, ZIPF_N).alias("rank"))


@query(
    """SELECT mix, CASE WHEN event_id % 100 < reads THEN 'read' ELSE other END AS kind, count(*) AS n
    FROM events, (VALUES ('A', 50, 'update'), ('B', 95, 'update'), ('C', 100, 'read'), ('cache-fill', 95, 'insert')) AS t(mix, reads, other) GROUP BY ALL"""
)
def mix_ops(spark, sf_dir):
    mixes = F.explode(F.array(*(F.struct(F.lit(k).alias("mix"), F.lit(v[0]).alias("reads"), F.lit(v[1]).alias("other")) for k, v in workload.MIXES.items())))
    ops_ = table(spark, sf_dir, "events").select("event_id", mixes.alias("m"))
    kind = F.when(F.col("event_id") % 100 < F.col("m.reads"), "read").otherwise(F.col("m.other"))
    return ops_.groupBy(F.col("m.mix").alias("mix"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query()
def flush_fold(spark, sf_dir):
    """Not SQL: where each of eight shards' memtable reaches 256 bytes. Tested against a fold in tests/."""
    log = mutation_log(spark, sf_dir).withColumn("shard", F.col("key").cast("long") % 8)
    return flush_points(log, 256)


@query(
    f"""WITH {LOG} SELECT key, value FROM log WHERE gen <= (SELECT max(gen) // 2 FROM log)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY gen DESC, pos DESC) = 1 AND NOT deleted"""
)
def as_of_generation(spark, sf_dir):
    log = mutation_log(spark, sf_dir)
    half = F.broadcast(log.agg(F.expr("max(gen) div 2").alias("half")))
    return ops.visible(log.join(half, F.col("gen") <= F.col("half"))).select("key", "value")


@query(f"WITH {NEWEST} SELECT key, value FROM ranked WHERE r = 1 AND NOT deleted AND key >= '1' AND key < '5'")
def range_scan(spark, sf_dir):
    return ops.key_range(mutation_log(spark, sf_dir), F.lit("1"), F.lit("5")).select("key", "value")


@query(
    """SELECT CAST(l_partkey AS BIGINT) AS key, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1 AND l_returnflag <> 'R'"""
)
def lineitem_state(spark, sf_dir):
    """The largest table as a log: parts are keys, shipments versions, returns tombstones."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return ops.newest(li, version=("l_shipdate", "l_orderkey", "l_linenumber")).where("l_returnflag <> 'R'").select("key", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"WITH {NEWEST} SELECT key, value FROM ranked WHERE r = 1 AND NOT deleted")
def table_round_trip(spark, sf_dir):
    """The whole log through a stored table: committed in two steps, flushed, compacted, read back."""
    from larder.plans.table import KVTable
    from larder.sources.scratch import folder

    log = mutation_log(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), "pos", "deleted", F.col("value").cast("binary").alias("value"))
    store = KVTable.open(spark, folder(spark, "table-round-trip"))
    half = log.agg(F.expr("max(pos) div 2")).first()[0]
    store.commit(log.where(F.col("pos") <= half))
    store.flush()
    store.commit(log.where(F.col("pos") > half))
    store.compact()
    return store.state().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


OPERATIONS = """operations AS (
    SELECT event_id AS op_id, event_id * 1000003 AS start_ns, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS kind,
           user_id % 7 <> 0 AS found, event_id % 997 = 5 AS failed, CAST(strlen(props) AS BIGINT) AS bytes FROM events)"""


def operations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(i.alias("op_id"), (i * 1000003).alias("start_ns"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"), (F.col("user_id") % 7 != 0).alias("found"), (i % 997 == 5).alias("failed"), F.octet_length("props").cast("long").alias("bytes"))


@query(
    f"""WITH {OPERATIONS} SELECT count(*) AS operations, count(*) FILTER (WHERE kind = 'read' AND NOT failed AND NOT found) AS misses,
    count(*) FILTER (WHERE kind = 'read' AND failed) AS read_errors, CAST(coalesce(sum(bytes) FILTER (WHERE kind <> 'read' AND NOT failed), 0) AS BIGINT) AS bytes_written FROM operations"""
)
def run_counters(spark, sf_dir):
    return metrics.counters(operations(spark, sf_dir))


@query(f"WITH {OPERATIONS} SELECT op_id, CAST((start_ns - 1000000000) // 1000000000 AS INTEGER) AS sec FROM operations WHERE start_ns >= 1000000000 AND start_ns < 7000000000")
def measured_window(spark, sf_dir):
    return metrics.measured(operations(spark, sf_dir), F.lit(1_000_000_000), F.lit(7_000_000_000)).select("op_id", "sec")


@query(
    f"""WITH {OPERATIONS}, summed AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT sum(bytes) FROM operations) AS whole FROM operations)
    SELECT op_id FROM summed WHERE op_id < 900000 AND before < whole // 3"""
)
def stop_at_limit(spark, sf_dir):
    """The operations up to the one that reaches a third of all bytes."""
    ops_ = operations(spark, sf_dir)
    third = ops_.agg(F.expr("sum(bytes) div 3")).first()[0]
    return metrics.up_to(ops_, 900_000, third).select("op_id")


@query(
    """WITH ranks AS (SELECT c_custkey AS rank FROM customer), bytes AS (SELECT rank, list_transform(range(0, 8), lambda k: ((rank >> k::INT * 8) & 255)::HUGEINT) AS b FROM ranks),
    hashed AS (SELECT rank, list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM bytes)
    SELECT CAST(rank AS BIGINT) AS rank, CAST(h % 1000 AS BIGINT) AS item, CAST(floor(((rank % 1000 + 0.5::DOUBLE) / 1000) * 250) AS BIGINT) AS uniform FROM hashed"""
)
def scrambled_choice(spark, sf_dir):
    rank = F.col("c_custkey").cast("long")
    u = (rank % 1000 + 0.5) / 1000
    return table(spark, sf_dir, "customer").select(rank.alias("rank"), workload.scramble(rank, 1000).alias("item"), workload.choose(u, 250, "uniform").alias("uniform"))


@query(
    """WITH ids AS (SELECT i AS pos, unhex(lpad(to_hex(i), 16, '0')) AS b FROM range(5000) AS t(i))
    SELECT CAST(pos AS BIGINT) AS pos, CAST(pos // 500 AS BIGINT) AS batch_id, sha256(b) AS key, 256 AS value_bytes,
           sha256(unhex(array_to_string(list_transform(range(0, 256), lambda i: lpad(to_hex((31 * i + 7) % 256), 2, '0')), ''))) AS value_sha FROM ids"""
)
def loaded_records(spark, sf_dir):
    rows = workload.load_phase(spark, workload.Workload(mix="cache-fill", records=5000))
    return rows.select("pos", "batch_id", F.col("key").cast("string").alias("key"), F.octet_length("value").alias("value_bytes"), F.sha2("value", 256).alias("value_sha"))


@query("SELECT CAST(i // 953 + 1 AS BIGINT) AS gen, count(*) AS entries, CAST(min(i) AS BIGINT) AS low, CAST(max(i) AS BIGINT) AS high FROM range(25 * 953) AS t(i) GROUP BY 1")
def full_segments(spark, sf_dir):
    return workload.full_segments(spark, 25, 1024).groupBy("gen").agg(F.count("*").alias("entries"), F.min("pos").alias("low"), F.max("pos").alias("high"))


@query(
    """SELECT sha256(unhex(lpad(to_hex(i), 16, '0'))) AS key, true AS expect_found FROM range(4096) AS t(i)
    UNION ALL SELECT sha256('miss'::BLOB || unhex(lpad(to_hex(i), 16, '0'))), false FROM range(4096) AS t(i)"""
)
def lookup_key_sets(spark, sf_dir):
    return workload.hit_keys(spark).unionAll(workload.miss_keys(spark))


@query("SELECT CAST(4 * i AS BIGINT) AS keys, CAST(i * 4 AS BIGINT) AS live_and_gone, CAST(17 * i AS BIGINT) AS writes FROM range(1, 6) AS t(i)")
def churn_accounts(spark, sf_dir):
    """Whatever the draws of a churn: every key is live or gone, and four writes and a quarter come per key."""
    out = None
    for i in range(1, 6):
        log = workload.churn(spark, 4 * i).select("key", F.floor(F.col("pos") / 5).alias("gen"), "pos", "deleted")
        one = ops.newest(log).agg(F.count("*").alias("live_and_gone")).crossJoin(log.agg(F.count("*").alias("writes"))).select(F.lit(4 * i).cast("long").alias("keys"), "live_and_gone", "writes")
        out = one if out is None else out.unionAll(one)
    return out


CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(hex) // 2), lambda i: ('0x' || substr(hex, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END))"""
LITTLE = "lpad(to_hex({0} & 255), 2, '0') || lpad(to_hex({0} >> 8 & 255), 2, '0') || lpad(to_hex({0} >> 16 & 255), 2, '0') || lpad(to_hex({0} >> 24 & 255), 2, '0')"


@query(f"WITH names AS (SELECT DISTINCT p_name AS name, hex(encode(p_name)) AS hex FROM part UNION SELECT '', '') SELECT name, xor({CRC}, 4294967295) AS crc FROM names")
def crc32c_names(spark, sf_dir):
    from larder.functions.hashing import crc32c

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().unionAll(spark.createDataFrame([("",)], "name string"))
    return names.select("name", crc32c(F.col("name").cast("binary")).alias("crc"))


@query(
    f"""WITH {LOG}, last AS (SELECT * FROM log WHERE gen = (SELECT max(gen) FROM log)), shaped AS (
        SELECT pos, lpad(to_hex(deleted::INT + 2 * pending::INT), 2, '0') || {LITTLE.format("strlen(key)")} || {LITTLE.format("coalesce(strlen(value), 0)")} || hex(encode(key)) || hex(encode(coalesce(value, ''))) AS hex FROM last),
    crcs AS (SELECT pos, hex, xor({CRC}, 4294967295) AS crc FROM shaped)
    SELECT pos, upper({LITTLE.format("crc")} || hex) AS record FROM crcs"""
)
def encoded_records(spark, sf_dir):
    """The newest generation's mutations as records of the binary log."""
    log = mutation_log(spark, sf_dir)
    last = log.join(F.broadcast(log.agg(F.max("gen").alias("last"))), F.col("gen") == F.col("last"))
    record = ops.encode_record(F.col("key").cast("binary"), F.col("value").cast("binary"), F.col("deleted"), F.col("pending"))
    return last.select("pos", F.hex(record).alias("record"))


@query(
    """SELECT n_name AS key, CASE WHEN n_regionkey = 2 THEN 'again' ELSE 'nation ' || n_nationkey END AS value, n_nationkey = 7 AS was_read,
           2 AS segments, (SELECT count(*) FROM nation) + (SELECT count(*) FROM nation WHERE n_regionkey IN (2, 3)) AS entries
    FROM nation WHERE n_regionkey NOT IN (1, 3)"""
)
def table_calls(spark, sf_dir):
    """The calls of a table one after another: a batch of puts and deletes, a flush, bulk puts and deletes,
    another handle, single reads, and its shape."""
    from larder.plans.table import KVTable
    from larder.sources.scratch import folder

    nation = table(spark, sf_dir, "nation")
    rows = nation.select("n_nationkey", "n_name", "n_regionkey").collect()  # 25
    root = folder(spark, "table-calls")
    store = KVTable.open(spark, root)
    batch = store.batch()
    for r in rows:
        batch.put(r["n_name"].encode(), b"staged first").put(r["n_name"].encode(), f"nation {r['n_nationkey']}".encode())
        if r["n_regionkey"] == 1:
            batch.delete(r["n_name"].encode())
    batch.commit()
    store.flush()
    key = F.col("n_name").cast("binary").alias("key")
    store.put_many(nation.where("n_regionkey = 2").select(key, F.lit(b"again").alias("value")))
    store.delete_many(nation.where("n_regionkey = 3").select(key))
    store.close()
    store = KVTable.open(spark, root)
    store.flush()
    seven = next(r["n_name"].encode() for r in rows if r["n_nationkey"] == 7)
    read = seven if store.has(seven) and store.get(seven) is not None else b""
    state = store.state().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), (F.col("key") == F.lit(bytearray(read))).alias("was_read"))
    return state.crossJoin(F.broadcast(store.stats().select("segments", F.col("segment_entries").alias("entries"))))


@query(
    """WITH kept AS (SELECT n_name AS key, 'nation ' || n_nationkey AS value FROM nation WHERE n_regionkey NOT IN (1, 3))
    SELECT key, value, (SELECT count(*) + count(*) FILTER (WHERE n_regionkey IN (1, 3)) FROM nation) AS applied, 'torn' AS cause
    FROM kept UNION ALL SELECT r_name, 'old segment', (SELECT count(*) + count(*) FILTER (WHERE n_regionkey IN (1, 3)) FROM nation), 'torn' FROM region WHERE r_regionkey <> 4"""
)
def imported_files(spark, sf_dir):
    """A binary log with a torn batch at its end and a segment of the old kind, taken over by a table."""
    return import_of(spark, sf_dir)


def import_of(spark, sf_dir):
    from larder.plans.table import KVTable
    from larder.sources import records
    from larder.sources.scratch import folder, write_file

    nations = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]  # 25 rows
    regions = [tuple(r) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]  # 5 rows
    put = [records.encode_record(name.encode(), f"nation {k}".encode()) for k, name, r in nations if r != 2]
    gone = [records.encode_record(name.encode(), None, deleted=True) for k, name, r in nations if r in (1, 3)]
    early = [records.encode_record(name.encode(), f"nation {k}".encode()) for k, name, r in nations if r == 2]
    torn = [records.encode_record(name.encode(), b"never", pending=i + 1 < len(nations)) for i, (k, name, r) in enumerate(nations)]
    root = folder(spark, "imported")
    write_file(spark, f"{root}/log/wal", records.encode_log(early + put + gone + torn)[:-7])
    old = b"".join(records.encode_old_record(name.encode(), b"old segment", deleted=k == 4) for k, name in regions)
    write_file(spark, f"{root}/segments/12.seg", old)
    store = KVTable.open(spark, f"{root}/table")
    report = store.import_files(f"{root}/log", f"{root}/segments")
    both = store.state().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return both.crossJoin(F.broadcast(report.select(F.col("records_applied").alias("applied"), "cause")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_state(spark, sf_dir)


