"""Group statistics, schedules, monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups
from .base import Registry, table

R = Registry()
query = R.query


def rollouts(spark, sf_dir):
    """Conversations as groups, turns as samples, a text's length as its reward."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("reward"))


_RO = "SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS reward FROM conversations"


@query(f"""WITH r AS ({_RO}), s AS (SELECT *, avg(reward) OVER (PARTITION BY conv_id) AS m, stddev_pop(reward) OVER (PARTITION BY conv_id) AS sd FROM r)
SELECT conv_id, turn, round(m, 4) AS mean, round(sd, 4) AS std, sd >= 1e-6 AS active, round(CASE WHEN sd >= 1e-6 THEN (reward - m) / (greatest(sd, 0.05) + 1e-8) ELSE 0.0 END, 5) AS advantage FROM s""")
def group_advantage(spark, sf_dir):
    """WIN1, AGG24."""
    return groups.group_advantage(rollouts(spark, sf_dir), "conv_id", "reward").select("conv_id", "turn", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "active", F.round("advantage", 5).alias("advantage"))


@query(f"WITH r AS ({_RO}), s AS (SELECT *, sum(reward) OVER (PARTITION BY conv_id) AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM r) SELECT conv_id, turn, round(CASE WHEN n > 1 THEN reward - (t - reward) / (n - 1) ELSE reward END, 5) AS advantage FROM s")
def loo_advantage(spark, sf_dir):
    """WIN2."""
    return groups.leave_one_out(rollouts(spark, sf_dir), "conv_id", "reward").select("conv_id", "turn", F.round("advantage", 5).alias("advantage"))


@query(f"WITH r AS ({_RO}) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY reward DESC, turn) <= 4 AS selected FROM r")
def topk_mask(spark, sf_dir):
    """WIN3."""
    return groups.top_k_mask(rollouts(spark, sf_dir), "conv_id", "reward", "turn", 4).select("conv_id", "turn", "selected")


@query(f"WITH r AS ({_RO}), v AS (SELECT conv_id, max(reward) AS value FROM r GROUP BY conv_id) SELECT r.conv_id, turn, round(reward - coalesce(CASE WHEN r.conv_id % 3 > 0 THEN value END, 0.0), 5) AS advantage, CAST(row_number() OVER (PARTITION BY r.conv_id ORDER BY reward DESC, turn) AS INT) AS rank FROM r JOIN v ON r.conv_id = v.conv_id")
def value_baseline_advantage(spark, sf_dir):
    """WIN4, WIN6."""
    from pyspark.sql import Window

    r = rollouts(spark, sf_dir)
    v = r.groupBy("conv_id").agg(F.max("reward").alias("value")).withColumn("value", F.when(F.col("conv_id") % 3 > 0, F.col("value")))
    out = groups.value_advantage(r.join(v, "conv_id"), "reward", "value")
    return out.select("conv_id", "turn", F.round("advantage", 5).alias("advantage"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("reward"), "turn")).alias("rank"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), w AS (SELECT source, n, pow(CAST((SELECT count(*) FROM c) AS DOUBLE) / n, 0.5) AS w FROM c) SELECT d.doc_id, round(w.w / (SELECT sum(w * n) / sum(n) FROM w), 6) AS weight FROM documents d JOIN w ON d.source = w.source")
def cwe_reweight(spark, sf_dir):
    """WIN5."""
    return groups.inverse_frequency(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", F.round("weight", 6).alias("weight"))


@query("""WITH x AS (SELECT l_returnflag AS grp, (l_discount - 0.05) * 40 AS lr, l_quantity / 25 - 1 AS a FROM lineitem), r AS (SELECT *, exp(greatest(-20.0, least(20.0, lr))) AS ratio FROM x)
SELECT grp, CAST(count(*) AS BIGINT) AS n, round(avg(-least(ratio * a, greatest(0.8, least(1.2, ratio)) * a)), 6) AS policy, round(avg(0.05 * lr), 6) AS penalty FROM r GROUP BY grp""")
def policy_surrogate(spark, sf_dir):
    """WIN14."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), ((F.col("l_discount") - 0.05) * 40).alias("lr"), (F.col("l_quantity") / 25 - 1).alias("a"))
    return groups.surrogate(x, "lr", "a").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("policy"), 6).alias("policy"), F.round(F.avg("penalty"), 6).alias("penalty"))


_PHASES = [(0, 0.3, 1.5), (200, 0.5, 1.0), (700, 0.7, 0.5)]


@query("""SELECT event_id, round(0.1 + least(1.0, event_id / 1000.0) * 0.4, 6) AS annealed, round(CASE WHEN event_id < 100 THEN event_id / 100.0 ELSE 0.5 * (1 + cos(3.141592653589793 * least(1.0, (event_id - 100) / 900.0))) END, 6) AS lr,
CASE WHEN event_id >= 700 THEN 3 WHEN event_id >= 200 THEN 2 ELSE 1 END AS phase, CASE WHEN event_id >= 700 THEN 0.7 WHEN event_id >= 200 THEN 0.5 ELSE 0.3 END AS alpha, CASE WHEN event_id >= 700 THEN 0.5 WHEN event_id >= 200 THEN 1.0 ELSE 1.5 END AS beta FROM events""")
def lr_schedule(spark, sf_dir):
    """WIN11-12, JN17 for a few phases."""
    e = groups.last_phase(table(spark, sf_dir, "events").select("event_id"), "event_id", _PHASES)
    return e.select("event_id", F.round(groups.anneal("event_id", 0.1, 0.5, 1000), 6).alias("annealed"), F.round(groups.warmup_cosine("event_id", 100, 1000), 6).alias("lr"), "phase", "alpha", "beta")


@query("SELECT e.event_id, o.last_at FROM events e LEFT JOIN LATERAL (SELECT max(s.ts) AS last_at FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.ts <= e.ts) o ON true")
def phase_asof(spark, sf_dir):
    """JN17 as an as-of join: each event with the user's last purchase at or before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("last_at"))
    return groups.as_of(e.select("event_id", "user_id", "ts"), right, "ts", ["user_id"], ["last_at"]).select("event_id", "last_at")


_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS score FROM events GROUP BY 1, 2"


@query(f"""WITH d AS ({_DAILY}), b AS (SELECT *, max(score) OVER (PARTITION BY event_type ORDER BY day) AS best FROM d), s AS (SELECT *, (best - score) * 100 >= 1000 AS strike FROM b),
i AS (SELECT *, sum(CAST(NOT strike AS INT)) OVER (PARTITION BY event_type ORDER BY day) AS island FROM s), k AS (SELECT *, sum(CAST(strike AS INT)) OVER (PARTITION BY event_type, island ORDER BY day) AS strikes FROM i)
SELECT event_type, CAST(day AS VARCHAR) AS day, strike, CAST(strikes AS BIGINT) AS strikes, max(CAST(strikes >= 3 AS INT)) OVER (PARTITION BY event_type ORDER BY day) = 1 AS stopped FROM k""")
def early_stop_strikes(spark, sf_dir):
    """WIN9-10."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))
    return groups.stop_after_strikes(d, "event_type", "day", "score", 1000, 3).select("event_type", F.col("day").cast("string").alias("day"), "strike", "strikes", "stopped")


@query("""WITH s AS (SELECT event_id // 50 AS step, event_type, value FROM events), t AS (SELECT step, event_type, count(*) AS v FROM s GROUP BY 1, 2)
SELECT s.step, CAST(s.n AS BIGINT) AS n, s.mean, s.rate, t.m AS per_type FROM (SELECT step, count(*) AS n, round(avg(value), 4) AS mean, round(avg(CAST(event_type = 'purchase' AS INT)), 6) AS rate FROM s GROUP BY step) s JOIN (SELECT step, string_agg(concat(event_type, '=', v), ',' ORDER BY event_type) AS m FROM t GROUP BY step) t ON s.step = t.step""")
def step_metrics(spark, sf_dir):
    """AGG7: means and rates, with a map by type."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("step"), "event_type", "value")
    per = e.groupBy("step", "event_type").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    out = per.groupBy("step").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"), F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("rate"), F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string")))).alias("m"))
    return out.select("step", "n", "mean", "rate", F.array_join("m", ",").alias("per_type"))


@query("""WITH r AS (SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events)
SELECT event_type, CAST(count(*) FILTER (rn <= 50) AS BIGINT) AS n, round(avg(value) FILTER (rn <= 50), 4) AS last_50, round(avg(value) FILTER (rn <= 20), 4) AS last_20, round((1000000 - max(event_id)) / 3600.0, 4) AS eta_hours FROM r GROUP BY event_type""")
def rolling_monitor(spark, sf_dir):
    """AGG23, STM6."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id"))))
    return e.groupBy("event_type").agg(F.count_if(F.col("rn") <= 50).alias("n"), F.round(F.avg(F.when(F.col("rn") <= 50, F.col("value"))), 4).alias("last_50"), F.round(F.avg(F.when(F.col("rn") <= 20, F.col("value"))), 4).alias("last_20"), F.round((1000000 - F.max("event_id")) / F.lit(3600.0), 4).alias("eta_hours"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3 AS kept, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS latest FROM events")
def checkpoint_rotation(spark, sf_dir):
    """WIN13."""
    return groups.keep_last(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 3)


@query("""WITH c AS (SELECT event_type, avg(value) AS reward, max(event_id) AS at, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, CAST(row_number() OVER (ORDER BY CASE WHEN n > 100 THEN reward END DESC NULLS LAST, event_type) AS INT) AS place, round(reward, 4) AS reward, round((reward - (SELECT avg(value) FROM events)) * 100, 4) AS delta_pp FROM c""")
def ordered_board(spark, sf_dir):
    """SMP14-16, MTH8: cells with too few rows come last."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    c = e.groupBy("event_type").agg(F.avg("value").alias("reward"), F.count("*").alias("n"), F.sum("value").alias("s"))
    every = c.agg((F.sum("s") / F.sum("n")).alias("all"))
    shown = F.when(F.col("n") > 100, F.col("reward"))
    return c.join(F.broadcast(every)).select("event_type", F.row_number().over(Window.orderBy(F.desc_nulls_last(shown), "event_type")).alias("place"), F.round("reward", 4).alias("reward"), F.round((F.col("reward") - F.col("all")) * 100, 4).alias("delta_pp"))
