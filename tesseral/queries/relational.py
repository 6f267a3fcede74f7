"""Relational, date, JSON and stream operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, sampling
from ..streaming import streams
from .base import Registry, scratch, table

R = Registry()
query = R.query


@query("""SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus IN ('F', 'O') GROUP BY n_name""")
def five_way_join_scan(spark, sf_dir):
    """JN1-2, SRC7."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders").where(F.col("o_orderstatus").isin("F", "O")), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("p_brand").alias("brands"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 4) AS value FROM events GROUP BY user_id")
def stream_last_write_wins(spark, sf_dir):
    """SRC13-14, STM2-3."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return streams.compact(e, "user_id", "event_id").withColumn("value", F.round("value", 4))


@query("SELECT user_id, event_id, CAST(ts AS VARCHAR) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_wins_dedup(spark, sf_dir):
    """SET8, SRC15."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("o", F.struct("ts", "event_id"))
    return dedup.last_wins(e, ["user_id"], "o").select("user_id", "event_id", F.regexp_replace(F.col("ts").cast("string"), r"\.0+$", "").alias("ts"))


@query("SELECT e.event_id FROM events e ANTI JOIN (SELECT DISTINCT event_id FROM events WHERE event_type = 'click') d ON e.event_id = d.event_id")
def resume_antijoin(spark, sf_dir):
    """STM2, SET6: what is not yet done; clicks stand for what is."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return streams.resume(e.select("event_id"), e.where("event_type = 'click'"), "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS INT) AS n_keys FROM events")
def json_props(spark, sf_dir):
    """JSN1-2."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("""WITH b AS (SELECT max(o_orderdate) AS hi, max(o_orderdate) - INTERVAL 730 DAY AS lo FROM orders), c AS (SELECT unnest(generate_series(lo, hi, INTERVAL 120 DAY)) AS a, hi FROM b), w AS (SELECT a, least(a + INTERVAL 120 DAY - INTERVAL 1 SECOND, hi) AS z FROM c)
SELECT strftime(a, '%Y-%m-%d %H:%M') AS chunk_start, strftime(z, '%Y-%m-%d %H:%M') AS chunk_end, CAST(count(o_orderkey) AS BIGINT) AS n FROM w LEFT JOIN orders ON o_orderdate BETWEEN a AND z GROUP BY 1, 2""")
def daterange_chunks(spark, sf_dir):
    """DT1-4: a window of two years in chunks that begin one second after the last."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    hi = o.agg(F.max("d").alias("hi"))
    chunks = hi.select(F.explode(F.sequence(F.col("hi") - F.expr("INTERVAL 730 DAY"), "hi", F.expr("INTERVAL 120 DAY"))).alias("a"), "hi").select("a", F.least(F.col("a") + F.expr("INTERVAL 120 DAY") - F.expr("INTERVAL 1 SECOND"), "hi").alias("z"))
    number = F.floor((F.unix_timestamp("d") - F.unix_timestamp("lo")) / (120 * 86400))
    per = o.join(F.broadcast(hi.select((F.col("hi") - F.expr("INTERVAL 730 DAY")).alias("lo")))).where(F.col("d") >= F.col("lo")).groupBy(F.timestamp_seconds(F.unix_timestamp("lo") + number * (120 * 86400)).alias("a")).agg(F.count("*").alias("n"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return chunks.join(per, "a", "left").select(text("a").alias("chunk_start"), text("z").alias("chunk_end"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(avg(o_totalprice), 2) AS mean, CAST(count(*) AS BIGINT) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(round_even(avg(o_totalprice) / 1000, 0), 0) AS rounded FROM orders GROUP BY o_orderpriority")
def median_dimension(spark, sf_dir):
    """AGG12, MTH6-7."""
    p = "o_totalprice"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile(p, 0.5), 2).alias("median"), F.round(F.avg(p), 2).alias("mean"), F.count("*").alias("n"), F.round(F.min(p), 2).alias("lo"), F.round(F.max(p), 2).alias("hi"), F.bround(F.avg(p) / 1000, 0).alias("rounded"))


@query("""SELECT event_id, concat(event_type, '|', user_id) AS pair, replace(replace(concat(event_type, '+#'), '+', 'p'), '#', 'sharp') AS shard, list_contains(['click', 'view'], event_type) AS seen, CAST(len(list_distinct([event_type, 'click', 'view'])) AS INT) AS kinds FROM events""")
def array_map_algebra(spark, sf_dir):
    """ARR1, MAP1-2, STR18-20."""
    e = table(spark, sf_dir, "events")
    kinds = F.array(F.lit("click"), F.lit("view"))
    merged = F.map_concat(F.create_map(F.lit("type"), F.col("event_type")), F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    shard = F.replace(F.replace(F.concat("event_type", F.lit("+#")), F.lit("+"), F.lit("p")), F.lit("#"), F.lit("sharp"))
    return e.select("event_id", F.concat_ws("|", merged["type"], merged["user"]).alias("pair"), shard.alias("shard"), F.array_contains(kinds, F.col("event_type")).alias("seen"), F.size(F.array_distinct(F.concat(F.array("event_type"), kinds))).alias("kinds"))


@query("""WITH r AS (SELECT * FROM (VALUES ('click', 'codeql', 3), ('click', 'semgrep', 1), ('view', 'bandit', 1), ('view', 'semgrep', 1), ('purchase', 'cppcheck', 2)) v(event_type, tool, period)), n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events)
SELECT n.event_type, tool, CAST(count(*) AS BIGINT) AS runs FROM n JOIN r ON n.event_type = r.event_type WHERE run % period = 0 GROUP BY 1, 2""")
def tool_routing_schedule(spark, sf_dir):
    """SRF10, STM8: tools by kind, the costly ones every so many runs."""
    from pyspark.sql import Window

    routes = spark.createDataFrame([("click", "codeql", 3), ("click", "semgrep", 1), ("view", "bandit", 1), ("view", "semgrep", 1), ("purchase", "cppcheck", 2)], "event_type string, tool string, period int")
    n = table(spark, sf_dir, "events").select("event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("run"))
    return n.join(F.broadcast(routes), "event_type").where(F.col("run") % F.col("period") == 0).groupBy("event_type", "tool").agg(F.count("*").alias("runs"))


@query("""WITH s AS (SELECT CAST(i // 8 AS BIGINT) AS step, CAST(i % 8 AS INT) AS slot FROM range(0, 160) t(i)), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
p AS (SELECT step, slot, CAST(('0x' || substr(sha256(concat('7|', step, '|', slot)), 1, 15)) AS BIGINT) % n AS place FROM s, n) SELECT step, slot, doc_id FROM p JOIN d ON p.place = d.place""")
def sample_with_replacement(spark, sf_dir):
    """SMP10, SMP12: any step's draw stands alone."""
    return sampling.with_replacement(spark.range(20).withColumnRenamed("id", "step"), table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8, 7).select("step", "slot", "doc_id")


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('11|', doc_id)), doc_id) AS rn FROM documents) SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std FROM r WHERE rn <= 16 GROUP BY source""")
def sample_without_replacement(spark, sf_dir):
    """SMP2, SMP11, SMP13: 16 of a pool, then their spread."""
    d = sampling.draw_per_group(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", 16, 11)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.stddev_pop("n_chars"), 4).alias("std"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Extension of STM1 and STM4: tumbling event-time windows, all states after the last trigger."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(_folder(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    shown = streams.tumbling(events, "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    folder = scratch(spark)
    streams.updating(shown, ["window", "event_type"], f"{folder}/table", f"{folder}/checkpoint", buckets=8).awaitTermination()
    return streams.current(spark, f"{folder}/table").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def _folder(spark, sf_dir, name):
    """A path that a file stream takes for the table: the folder itself, or a pattern for a single file."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return f"{sf_dir}/{name}.parquet" if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory() else f"{sf_dir}/{name}.parque[t]"
