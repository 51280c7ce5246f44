"""Queries of aggregates, windows, token functions and balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scoring as P
from tessera.operators import batches as B
from tessera.operators import relational as R
from tessera.operators import statistics as G
from tessera.operators import validation as V
from tessera.plans.registry import Tables, query, scratch
from tessera.sources import files as S


def r6(c: Column) -> Column:
    """Rounded, and -0.0 as 0.0."""
    return F.round(c, 6) + 0.0


def arrays(t: Tables, *columns: str) -> DataFrame:
    """uid and arrays of token columns, by position."""
    rows = t.tokens.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("t", *columns))).alias("r"))
    return rows.select("uid", *(F.col(f"r.{c}").alias(c) for c in ("t", *columns)))


def exploded(df: DataFrame, name: str, places: int | None = 6) -> DataFrame:
    """uid, t and the array's elements under its name."""
    out = df.select("uid", F.posexplode(name).alias("t", name))
    return out.select("uid", F.col("t").cast("long").alias("t"), (F.round(name, places) + 0.0 if places else F.col(name)).alias(name))


# --------------------------------------------------------------- aggregates


@query("agg_count_by_source", "SELECT data_source, count(*) AS n FROM {rollouts} GROUP BY data_source ORDER BY data_source")
def _(t: Tables) -> DataFrame:
    return t.rollouts.groupBy("data_source").agg(F.count("*").alias("n")).orderBy("data_source")


@query("agg_mean_of_means", "SELECT data_source, round(avg(m), 6) AS score, count(*) AS n FROM (SELECT data_source, uid, avg(score) AS m FROM {rollouts} GROUP BY 1, 2) x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return G.mean_of_means(t.rollouts, "data_source", "uid", "score").withColumn("score", r6(F.col("score")))


@query("agg_val_score_by_source", "SELECT uid % 3 AS source, round(avg(s), 6) AS score FROM (SELECT uid, sum(reward) AS s FROM {tokens} GROUP BY uid) x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return arrays(t, "reward").groupBy((F.col("uid") % 3).alias("source")).agg(r6(F.avg(A.total(F.col("reward")))).alias("score"))


@query("agg_avg_with_fails", "SELECT round(sum(coalesce(recall, 0)) / count(*), 6) AS recall FROM {records}")
def _(t: Tables) -> DataFrame:
    return t.records.agg(r6(F.sum(F.coalesce("recall", F.lit(0.0))) / F.count("*")).alias("recall"))


@query("agg_upper_median", "SELECT status, list_sort(array_agg(n_pred))[len(array_agg(n_pred)) // 2 + 1] AS median FROM {records} GROUP BY status")
def _(t: Tables) -> DataFrame:
    return t.records.groupBy("status").agg(G.upper_median("n_pred").alias("median"))


@query("agg_match_mix", "SELECT count(*) FILTER (WHERE score >= 0.99) AS full_, count(*) FILTER (WHERE score > 0.3 AND score < 0.99) AS partial_, count(*) FILTER (WHERE coalesce(score, 0) <= 0.3) AS none_ FROM {matches}")
def _(t: Tables) -> DataFrame:
    s = F.coalesce("score", F.lit(0.0))
    return t.matches.agg(F.count_if(s >= 0.99).alias("full_"), F.count_if((s > 0.3) & (s < 0.99)).alias("partial_"), F.count_if(s <= 0.3).alias("none_"))


@query("agg_paper_score", "SELECT round(100.0 * (avg(coalesce(recall, 0)) + 0.5 * (avg(coalesce(p_spec, 0)) - 0.7)), 6) AS paper_score, round(avg(coalesce(100.0 * (recall + 0.5 * (p_spec - 0.7)), 0)), 6) AS mean_record_score FROM {records}")
def _(t: Tables) -> DataFrame:
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return t.records.agg(r6(P.paper_score(zero(F.col("recall")), zero(F.col("p_spec")))).alias("paper_score"), r6(zero(P.paper_score(F.col("recall"), F.col("p_spec")))).alias("mean_record_score"))


@query("agg_weighted_mean", "SELECT id, round(sum(score * weight) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0), 6) AS score FROM {matches} GROUP BY id")
def _(t: Tables) -> DataFrame:
    return t.matches.groupBy("id").agg(r6(G.weighted_mean(F.col("score"), F.col("weight"))).alias("score"))


@query("agg_design_score", """SELECT id, round(sum(score * weight) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0), 6) AS score, round(avg(score) FILTER (WHERE level = 'critical'), 6) AS critical, round(avg(score) FILTER (WHERE level = 'major'), 6) AS major,
    round(avg(score) FILTER (WHERE level = 'minor'), 6) AS minor, count(score) AS parsed, count(*) - count(score) AS missing FROM {matches} GROUP BY id""")
def _(t: Tables) -> DataFrame:
    levels = [r6(F.avg(F.when(F.col("level") == x, F.col("score")))).alias(x) for x in ("critical", "major", "minor")]
    return t.matches.groupBy("id").agg(r6(G.weighted_mean(F.col("score"), F.col("weight"))).alias("score"), *levels, F.count("score").alias("parsed"), (F.count("*") - F.count("score")).alias("missing"))


@query("agg_level_breakdown", "SELECT level, round(avg(m), 6) AS mean, count(m) AS n, round(min(m), 6) AS least, round(max(m), 6) AS most FROM (SELECT id, level, avg(score) AS m FROM {matches} GROUP BY 1, 2) x GROUP BY level")
def _(t: Tables) -> DataFrame:
    per = t.matches.groupBy("id", "level").agg(F.avg("score").alias("m"))
    return per.groupBy("level").agg(r6(F.avg("m")).alias("mean"), F.count("m").alias("n"), r6(F.min("m")).alias("least"), r6(F.max("m")).alias("most"))


@query("agg_wtp_recall", """SELECT id, round(sum(weight * score * CASE WHEN bullet > 0 THEN coalesce(CASE WHEN bullet <= 2 THEN bullet / 4.0 END, 1.0) ELSE 0 END) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0), 6) AS recall FROM {matches} GROUP BY id""")
def _(t: Tables) -> DataFrame:
    spec = F.create_map(F.lit(1), F.lit(0.25), F.lit(2), F.lit(0.5))
    found = F.when(F.col("bullet") > 0, F.coalesce(F.try_element_at(spec, F.col("bullet").cast("int")), F.lit(1.0))).otherwise(0.0)
    return t.matches.groupBy("id").agg(r6(G.weighted_mean(F.col("score") * found, F.col("weight"))).alias("recall"))


@query("agg_numeric_profile", "SELECT 'score' AS metric, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(min(score), 6) AS min FROM {rollouts} UNION ALL SELECT 'len', round(avg(len), 6), max(len), min(len) FROM {rollouts}")
def _(t: Tables) -> DataFrame:
    return G.numeric_profile(t.rollouts, ["score", "len"]).select("metric", *(r6(F.col(c)).alias(c) for c in ("mean", "max", "min")))


@query("agg_reduce_metrics", "SELECT event_type, round(avg(value), 6) AS value FROM {events} GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(r6(F.avg("value")).alias("value"))


_METRICS = """SELECT round(avg(reward) FILTER (WHERE mask = 1), 6) AS adv_mean, round(max(reward) FILTER (WHERE mask = 1), 6) AS adv_max, round(min(reward) FILTER (WHERE mask = 1), 6) AS adv_min,
    (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM {tokens} GROUP BY uid) x) AS length_mean, (SELECT round(avg(CASE WHEN n = m THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT count(*) AS n, max(count(*)) OVER () AS m FROM {tokens} GROUP BY uid) x) AS clip_ratio EXTRA FROM {tokens}"""


def _metrics(t: Tables, *extra: Column) -> DataFrame:
    inside = F.col("mask") == 1
    per = t.tokens.groupBy("uid").agg(F.count("*").alias("n"))
    lengths = per.join(F.broadcast(per.agg(F.max("n").alias("m")))).agg(r6(F.avg("n")).alias("length_mean"), r6(F.avg((F.col("n") == F.col("m")).cast("int"))).alias("clip_ratio"))
    cells = [r6(f(F.when(inside, F.col("reward")))).alias(f"adv_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return t.tokens.agg(*cells, *extra).join(F.broadcast(lengths))


@query("agg_data_metrics", _METRICS.replace("EXTRA", ", round(max(adv), 6) AS score_max, round(avg(adv), 6) AS score_mean"))
def _(t: Tables) -> DataFrame:
    return _metrics(t, r6(F.max("adv")).alias("score_max"), r6(F.avg("adv")).alias("score_mean"))


@query("agg_prime_data_metrics", _METRICS.replace("EXTRA", ""))
def _(t: Tables) -> DataFrame:
    return _metrics(t)


@query("agg_explained_var", "SELECT round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) AS explained FROM {tokens}")
def _(t: Tables) -> DataFrame:
    return t.tokens.agg(r6(G.explained_variance(F.col("reward"), F.col("value"))).alias("explained"))


@query("agg_timing_per_token", "SELECT section, round(ms, 6) AS ms FROM (SELECT 'gen' AS section, 2.0 * 1000 / sum(mask) AS ms FROM {tokens} UNION ALL SELECT 'adv', 0.5 * 1000 / count(*) FROM {tokens}) x")
def _(t: Tables) -> DataFrame:
    n = t.tokens.agg(F.sum("mask").alias("response"), F.count("*").alias("all"))
    return n.select(F.expr("stack(2, 'gen', 2.0D * 1000 / response, 'adv', 0.5D * 1000 / all) AS (section, ms)")).withColumn("ms", r6(F.col("ms")))


@query("agg_throughput", "SELECT count(*) AS tokens, round(count(*) / (12.5 * 4), 6) AS per_gpu_second FROM {tokens}")
def _(t: Tables) -> DataFrame:
    return t.tokens.agg(F.count("*").alias("tokens"), r6(F.count("*") / (12.5 * 4)).alias("per_gpu_second"))


@query("agg_bootstrap")
def _(t: Tables) -> DataFrame:
    return G.bootstrap(t.rollouts, ["uid"], "score", "idx", 4)


@query("agg_validation")
def _(t: Tables) -> DataFrame:
    """The whole report of a validation run; its closed forms are agg_expected_ladder, which has SQL."""
    return V.validation_metrics(t.rollouts, "data_source", ["uid"], "idx", ["score", "acc"], "vote")


@query("agg_expected_ladder", """WITH r AS (SELECT data_source, uid, score, row_number() OVER (PARTITION BY data_source, uid ORDER BY score) AS k, count(*) OVER (PARTITION BY data_source, uid) AS n FROM {rollouts}),
    s AS (SELECT *, unnest(list_concat(list_filter([2, 4, 8, 16, 32, 64], lambda x: x < n), [n])) AS size FROM r),
    p AS (SELECT data_source, uid, size, sum(score * (pow(k / CAST(n AS DOUBLE), size) - pow((k - 1) / CAST(n AS DOUBLE), size))) AS b, sum(score * (pow((n - k + 1) / CAST(n AS DOUBLE), size) - pow((n - k) / CAST(n AS DOUBLE), size))) AS w FROM s GROUP BY 1, 2, 3)
    SELECT data_source, size, round(avg(b), 6) AS best, round(avg(w), 6) AS worst, count(*) AS prompts FROM p GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    e = V.expected_metrics(t.rollouts, "data_source", ["uid"], "score")
    return e.select("data_source", "size", r6(F.col("best")).alias("best"), r6(F.col("worst")).alias("worst"), "prompts")


@query("agg_best_worst_n", """WITH r AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS k, count(*) OVER (PARTITION BY uid) AS n FROM {rollouts})
    SELECT uid, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(sum(score * (pow(k / CAST(n AS DOUBLE), 2) - pow((k - 1) / CAST(n AS DOUBLE), 2))) + 1e-9, 6) AS best_2, round(sum(score * (pow((n - k + 1) / CAST(n AS DOUBLE), 2) - pow((n - k) / CAST(n AS DOUBLE), 2))) + 1e-9, 6) AS worst_2 FROM r GROUP BY uid""")
def _(t: Tables) -> DataFrame:
    rows = t.rollouts.groupBy("uid").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.collect_list("score").alias("s"))
    return rows.select("uid", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), r6(G.expected_best(F.col("s"), 2) + 1e-9).alias("best_2"), r6(G.expected_best(F.col("s"), 2, worst=True) + 1e-9).alias("worst_2"))


@query("agg_majority_vote", """WITH v AS (SELECT uid, vote, count(*) AS n, min(idx) AS f, arg_min(score, idx) AS value FROM {rollouts} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) AS r FROM v)
    SELECT uid, vote, round(value, 6) AS value, n AS votes FROM k WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return G.majority(t.rollouts, ["uid"], "vote", "score", "idx").withColumn("value", r6(F.col("value")))


@query("agg_prompt_then_source", "SELECT data_source, round(avg(m), 6) AS score FROM (SELECT data_source, prompt, avg(score) AS m FROM {rollouts} GROUP BY 1, 2) x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.rollouts.groupBy("data_source", "prompt").agg(F.avg("score").alias("m")).groupBy("data_source").agg(r6(F.avg("m")).alias("score"))


@query("agg_seqlen_unbalance", "SELECT min(s) AS least, max(s) AS most, round(avg(s), 6) AS mean, max(s) - min(s) AS gap FROM (SELECT uid % 8 AS chunk, CAST(sum(len) AS BIGINT) AS s FROM {rollouts} GROUP BY 1) x")
def _(t: Tables) -> DataFrame:
    per = t.rollouts.groupBy((F.col("uid") % 8).alias("chunk")).agg(F.sum("len").alias("s"))
    return per.agg(F.min("s").alias("least"), F.max("s").alias("most"), r6(F.avg("s")).alias("mean"), (F.max("s") - F.min("s")).alias("gap"))


@query("agg_dpo_accuracy", """WITH p AS (SELECT a.uid, a.score - b.score AS ds, a.acc - b.acc AS da FROM {rollouts} a JOIN {rollouts} b ON a.uid = b.uid AND a.idx < b.idx),
    g AS (SELECT uid, CASE WHEN sum(abs(da)) = 0 THEN 0.5 ELSE CAST(sum(CASE WHEN (ds > 0) = (da > 0) THEN abs(da) ELSE 0 END) AS DOUBLE) / sum(abs(da)) END AS a FROM p GROUP BY uid) SELECT round(avg(a), 6) AS accuracy FROM g""")
def _(t: Tables) -> DataFrame:
    p = R.self_pairs(t.rollouts, ["uid"], "idx", ["score", "acc"])
    da, agree = F.abs(F.col("acc_a") - F.col("acc_b")), (F.col("score_a") > F.col("score_b")) == (F.col("acc_a") > F.col("acc_b"))
    per = p.groupBy("uid").agg(F.sum(da).alias("w"), F.sum(F.when(agree, da).otherwise(0)).alias("s"))
    return per.agg(r6(F.avg(F.when(F.col("w") == 0, 0.5).otherwise(F.col("s") / F.nullif(F.col("w"), F.lit(0))))).alias("accuracy"))


@query("agg_dpo_abs_accuracy", "SELECT round(avg(CASE WHEN sign(s) = sign(acc * 2 - 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT score - 0.45 AS s, acc FROM {rollouts}) x")
def _(t: Tables) -> DataFrame:
    return t.rollouts.agg(r6(F.avg((F.signum(F.col("score") - 0.45) == F.signum(F.col("acc") * 2.0 - 1)).cast("int"))).alias("accuracy"))


@query("agg_masked_sum_mean_var", "SELECT round(sum(reward * mask), 6) AS sum, round(sum(reward * mask) / (sum(mask) + 1e-8), 6) AS mean, round(var_samp(CASE WHEN mask = 1 THEN reward END), 6) AS var FROM {tokens}")
def _(t: Tables) -> DataFrame:
    x, m = F.col("reward"), F.col("mask")
    return t.tokens.agg(r6(G.masked_sum(x, m)).alias("sum"), r6(G.masked_mean(x, m)).alias("mean"), r6(G.masked_var(x, m)).alias("var"))


@query("agg_loss_modes", """SELECT round((SELECT sum(reward * mask) / (sum(mask) + 1e-8) FROM {tokens}), 6) AS token_mean, round((SELECT avg(s) FROM (SELECT sum(reward * mask) AS s FROM {tokens} GROUP BY uid) x), 6) AS seq_mean_token_sum,
    round((SELECT avg(s) FROM (SELECT sum(reward * mask) / sum(mask) AS s FROM {tokens} GROUP BY uid) x), 6) AS seq_mean_token_mean""")
def _(t: Tables) -> DataFrame:
    per = t.tokens.groupBy("uid").agg(F.sum(F.col("reward") * F.col("mask")).alias("s"), F.sum("mask").alias("n"))
    return per.agg(r6(F.sum("s") / (F.sum("n") + 1e-8)).alias("token_mean"), r6(F.avg("s")).alias("seq_mean_token_sum"), r6(F.avg(F.col("s") / F.col("n"))).alias("seq_mean_token_mean"))


@query("agg_preprocess_stats", "SELECT count(*) AS before, count(*) FILTER (WHERE in_sft) AS after, round(100.0 * count(*) FILTER (WHERE in_sft) / count(*), 6) AS percent, max(length(think)) AS longest_before, coalesce(max(length(think)) FILTER (WHERE in_sft), 0) AS longest_after, count(*) FILTER (WHERE in_sft) AS written FROM {papers}")
def _(t: Tables) -> DataFrame:
    """Counts before and after the filter, measured by the job that writes the rows; the written table is counted beside them."""
    think = F.max(F.length("think")).cast("long")
    rows, seen = S.write_observed(t.papers, scratch(t) + "/kept", F.col("in_sft"), {"before": F.count("*"), "longest_before": think}, {"after": F.count("*"), "longest_after": F.coalesce(think, F.lit(0).cast("long"))})
    before, after = seen["before"], seen["after"]
    values = [F.lit(before).alias("before"), F.lit(after).alias("after"), F.round(F.lit(100.0 * after / before if before else None).cast("double"), 6).alias("percent"), F.lit(seen["longest_before"]).cast("long").alias("longest_before"), F.lit(seen["longest_after"]).cast("long").alias("longest_after")]
    return rows.agg(F.count("*").alias("written")).select(*values, "written")


# ------------------------------------------------------------------ windows


@query("win_grpo", """SELECT uid, idx, round((score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6), 4) + 0.0 AS advantage FROM {rollouts} WINDOW w AS (PARTITION BY uid)""")
def _(t: Tables) -> DataFrame:
    # Equal scores leave a remainder of rounding that 1e-6 in the denominator would magnify: exact zero there.
    return t.rollouts.select("uid", "idx", (F.round(G.grpo(F.col("score"), "uid"), 4) + 0.0).alias("advantage"))


@query("win_rfpp_baseline", """WITH b AS (SELECT uid, idx, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS s, CASE WHEN idx < 5 THEN 1 ELSE 0 END AS mask FROM {rollouts} WINDOW w AS (PARTITION BY uid)),
    m AS (SELECT avg(s) FILTER (WHERE mask = 1) AS mean, var_samp(s) FILTER (WHERE mask = 1) AS var FROM b) SELECT uid, idx, round((s - mean) / sqrt(var + 1e-8), 5) + 0.0 AS advantage FROM b, m""")
def _(t: Tables) -> DataFrame:
    rows = t.rollouts.select("uid", "idx", G.baseline(F.col("score"), "uid").alias("s"), (F.col("idx") < 5).cast("int").alias("mask"))
    return G.whiten(rows, "s", "mask", "advantage").select("uid", "idx", (F.round("advantage", 5) + 0.0).alias("advantage"))


@query("win_rloo", "SELECT uid, idx, round(CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE score END, 5) + 0.0 AS advantage FROM {rollouts} WINDOW w AS (PARTITION BY uid)")
def _(t: Tables) -> DataFrame:
    return t.rollouts.select("uid", "idx", (F.round(G.leave_one_out(F.col("score"), "uid"), 5) + 0.0).alias("advantage"))


@query("win_prime_rloo", """WITH e AS (SELECT *, CASE WHEN t = max(t) FILTER (WHERE mask = 1) OVER (PARTITION BY uid) THEN 1 ELSE 0 END AS last FROM {tokens}),
    o AS (SELECT *, CASE WHEN last = 1 THEN adv ELSE 0 END AS outcome FROM e),
    p AS (SELECT uid // 4 AS g, uid, avg(reward) FILTER (WHERE mask = 1) AS m, avg(outcome) FILTER (WHERE last = 1) AS k FROM o GROUP BY 1, 2), s AS (SELECT g, sum(m) AS total, sum(k) AS whole FROM p GROUP BY g),
    r AS (SELECT x.uid, x.t, mask, 5.0 * CASE WHEN mask = 1 THEN reward * 4.0 / 3 - total / 3 ELSE 0 END + 2.0 * CASE WHEN last = 1 THEN outcome * 4.0 / 3 - whole / 3 ELSE 0 END AS r FROM o x JOIN s ON x.uid // 4 = s.g),
    c AS (SELECT uid, t, mask, sum(r * mask) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS returns FROM r),
    w AS (SELECT sum(returns * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM c), v AS (SELECT sum((returns - mean) * (returns - mean) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM c, w)
    SELECT uid, t, round(returns, 4) + 0.0 AS returns, round((returns - mean) / sqrt(var + 1e-8), 4) + 0.0 AS advantage FROM c, w, v""")
def _(t: Tables) -> DataFrame:
    """A token reward under the response mask and an outcome on the last token, weighted 5 and 2."""
    end = F.max(F.when(F.col("mask") == 1, F.col("t"))).over(Window.partitionBy("uid"))
    tokens = t.grouped("lineitem", "l_orderkey").tokens.select("uid", "t", "reward", "adv", "mask")
    rows = tokens.withColumn("g", F.floor(F.col("uid") / 4)).withColumn("last", (F.col("t") == end).cast("int")).withColumn("outcome", F.when(F.col("last") == 1, F.col("adv")).otherwise(0.0))
    rows = rows.repartition(t.tasks("lineitem"), "g")
    out = G.prime_advantages(rows, "uid", "g", "t", "mask", 4, [("reward", "mask", 5.0), ("outcome", "last", 2.0)])
    return out.select("uid", "t", (F.round("returns", 4) + 0.0).alias("returns"), (F.round("advantage", 4) + 0.0).alias("advantage"))


@query("win_gae", """WITH d AS (SELECT uid, t, reward + 0.9 * coalesce(lead(value) OVER (PARTITION BY uid ORDER BY t), 0) - value AS delta FROM {tokens})
    SELECT a.uid, a.t, round(sum(b.delta * pow(0.9 * 0.95, b.t - a.t)) + 1e-9, 6) + 0.0 AS advantage FROM d a JOIN d b ON a.uid = b.uid AND b.t >= a.t GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return exploded(arrays(t, "reward", "value").select("uid", F.transform(A.gae(F.col("reward"), F.col("value"), 0.9, 0.95), lambda x: x + 1e-9).alias("advantage")), "advantage")


@query("win_discounted_return", """WITH RECURSIVE n AS (SELECT uid, max(t) AS last FROM {tokens} GROUP BY uid), s AS (SELECT x.uid, x.t, x.reward AS ret, x.reward * x.mask AS carry FROM {tokens} x JOIN n ON x.uid = n.uid AND x.t = n.last
    UNION ALL SELECT x.uid, x.t, x.reward + 0.5 * s.carry, (x.reward + 0.5 * s.carry) * x.mask FROM s JOIN {tokens} x ON x.uid = s.uid AND x.t = s.t - 1) SELECT uid, t, round(ret, 6) + 0.0 AS ret FROM s""")
def _(t: Tables) -> DataFrame:
    return exploded(arrays(t, "reward", "mask").select("uid", A.discounted_returns(F.col("reward"), F.col("mask"), 0.5).alias("ret")), "ret")


@query("win_remax", "SELECT uid, t, round(sum(reward * mask) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - value * mask, 6) + 0.0 AS advantage FROM {tokens}")
def _(t: Tables) -> DataFrame:
    back = G.reverse_running(F.col("reward") * F.col("mask"), ["uid"], "t")
    return t.tokens.select("uid", "t", r6(back - F.col("value") * F.col("mask")).alias("advantage"))


@query("win_prime_process_reward", "SELECT a.uid, a.t, round(sum((b.logp - b.ref_logp) * pow(0.8, b.t - a.t)), 6) + 0.0 AS reward FROM {tokens} a JOIN {tokens} b ON a.uid = b.uid AND b.t >= a.t GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    q = F.zip_with("logp", "ref_logp", lambda a, b: a - b)
    return exploded(arrays(t, "logp", "ref_logp").select("uid", A.process_reward(q, 0.8).alias("reward")), "reward")


@query("win_prime_norm", "WITH c AS (SELECT uid, t, reward, sum(reward) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM {tokens}) SELECT uid, t, round(reward / (SELECT max(abs(s)) + 1e-6 FROM c), 6) + 0.0 AS reward FROM c")
def _(t: Tables) -> DataFrame:
    rows = t.tokens.select("uid", "t", "reward", G.reverse_running(F.col("reward"), ["uid"], "t").alias("s"))
    return rows.join(F.broadcast(rows.agg(F.max(F.abs("s")).alias("top")))).select("uid", "t", r6(F.col("reward") / (F.col("top") + 1e-6)).alias("reward"))


@query("win_whiten", "WITH m AS (SELECT avg(reward) FILTER (WHERE mask = 1) AS mean, var_samp(reward) FILTER (WHERE mask = 1) AS var FROM {tokens}) SELECT uid, t, round((reward - mean) / sqrt(var + 1e-8), 5) + 0.0 AS white FROM {tokens}, m")
def _(t: Tables) -> DataFrame:
    return G.whiten(t.tokens, "reward", "mask", "white").select("uid", "t", (F.round("white", 5) + 0.0).alias("white"))


@query("win_position_ids", "SELECT uid, t, CAST(greatest(0, sum(mask) OVER (PARTITION BY uid ORDER BY t) - 1) AS BIGINT) AS position FROM {tokens}")
def _(t: Tables) -> DataFrame:
    return t.tokens.select("uid", "t", F.greatest(F.lit(0), G.running(F.col("mask"), ["uid"], "t") - 1).alias("position"))


@query("win_response_mask", "SELECT uid, t, CASE WHEN sum(CASE WHEN token > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t) - CASE WHEN token > 40 THEN 1 ELSE 0 END = 0 THEN 1 ELSE 0 END AS mask FROM {tokens}")
def _(t: Tables) -> DataFrame:
    rows = arrays(t, "token").select("uid", A.response_mask(F.transform("token", lambda x: F.when(x > 40, 1).otherwise(0)), F.lit(1)).alias("mask"))
    return exploded(rows, "mask", None)


@query("win_group_split", """WITH g AS (SELECT pdf_url, count(*) AS n FROM {papers} GROUP BY 1), v AS (SELECT pdf_url, sum(n) OVER (ORDER BY md5(concat('42|', pdf_url)), pdf_url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 50 AS val FROM g)
    SELECT id, CASE WHEN val THEN 'val' ELSE 'train' END AS split FROM {papers} p JOIN v ON p.pdf_url = v.pdf_url""")
def _(t: Tables) -> DataFrame:
    return G.group_split(t.papers, "pdf_url", 42, 50).select("id", "split")


@query("win_row_split", "SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42|', id)), id) <= least(greatest(50, 1), (SELECT count(*) FROM {papers}) - 1) THEN 'val' ELSE 'train' END AS split FROM {papers}")
def _(t: Tables) -> DataFrame:
    n = t.papers.count()
    rows = R.positions(t.papers.select("id"), R.shuffled_order(42, F.col("id")))
    return rows.select("id", F.when(F.col("index") < min(max(50, 1), n - 1), "val").otherwise("train").alias("split"))


@query("win_bipartite_reward", """SELECT id, pos, CASE WHEN bullet BETWEEN 1 AND 4 AND row_number() OVER (PARTITION BY id, bullet ORDER BY coalesce(score, 0) DESC, pos) > 1 THEN 0 ELSE score END AS score,
    bullet BETWEEN 1 AND 4 AND row_number() OVER (PARTITION BY id, bullet ORDER BY coalesce(score, 0) DESC, pos) > 1 AS reused FROM {matches}""")
def _(t: Tables) -> DataFrame:
    return G.bipartite(t.matches, "id", "bullet", "score", "pos", F.lit(4)).select("id", "pos", "score", "reused")


@query("win_bipartite_eval", """SELECT id, pos AS gt_id, bullet AS pred_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id, bullet ORDER BY score DESC, pos) AS k FROM {matches} WHERE score > 0 AND bullet > 0) x WHERE k = 1""")
def _(t: Tables) -> DataFrame:
    rows = t.matches.filter("score IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct(F.col("pos").alias("gt_id"), F.col("bullet").alias("pred_id"), "score")).alias("m"))
    return rows.select("id", F.explode(G.greedy_matches(F.col("m"))).alias("m")).select("id", "m.*")


@query("win_last_wins", "SELECT id, bullet, arg_max(pos, pos) AS pos FROM {matches} GROUP BY id, bullet")
def _(t: Tables) -> DataFrame:
    return t.matches.groupBy("id", "bullet").agg(F.max_by("pos", "pos").alias("pos"))


@query("win_first_n_per_source", "SELECT data_source, uid, idx FROM (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY uid, idx) AS k FROM {rollouts}) x WHERE k <= 5")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("data_source").orderBy("uid", "idx")
    return t.rollouts.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("data_source", "uid", "idx")


@query("win_step_schedule", """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM {documents} WHERE doc_id IS NOT NULL), w AS (SELECT *, greatest(n // 10, 1) AS up FROM s)
    SELECT doc_id, i AS step, round(CASE WHEN i < up THEN i / CAST(up AS DOUBLE) ELSE 1 END * 1e-3, 9) AS constant,
    round(CASE WHEN i < up THEN i / CAST(up AS DOUBLE) ELSE greatest(0, cos(pi() * 0.5 * 2 * (i - up) / CAST(greatest(n - up, 1) AS DOUBLE)) * 0.45 + 0.55) END * 1e-3, 9) AS cosine FROM w""")
def _(t: Tables) -> DataFrame:
    """The learning rate of each document's step, a tenth of the steps warming up."""
    rows = R.positions(t.documents.filter("doc_id IS NOT NULL").select("doc_id"), [F.col("doc_id")], "step")
    n = rows.count()
    up, s = max(n // 10, 1), F.col("step")
    return rows.select("doc_id", "step", F.round(A.warmup(s, up) * 1e-3, 9).alias("constant"), F.round(A.warmup_cosine(s, up, n, 0.1) * 1e-3, 9).alias("cosine"))


# ---------------------------------------------------------- token functions


@query("arr_pad", "SELECT uid, list_concat(array_agg(token ORDER BY t), list_transform(range(greatest(0, 12 - count(*))), lambda x: 0)) AS tokens FROM {tokens} GROUP BY uid")
def _(t: Tables) -> DataFrame:
    return arrays(t, "token").select("uid", A.pad(F.col("token"), 12, 0).cast("array<bigint>").alias("tokens"))


@query("arr_truncate", "SELECT uid, array_agg(token ORDER BY t) FILTER (WHERE t < 3) AS head, array_agg(token ORDER BY t) FILTER (WHERE back < 3) AS tail FROM (SELECT *, count(*) OVER (PARTITION BY uid) - 1 - t AS back FROM {tokens}) x GROUP BY uid")
def _(t: Tables) -> DataFrame:
    return arrays(t, "token").select("uid", A.truncate(F.col("token"), 3, "right").alias("head"), A.truncate(F.col("token"), 3, "left").alias("tail"))


@query("arr_unpad", "SELECT uid, array_agg(token ORDER BY t) FILTER (WHERE back < m) AS tokens FROM (SELECT *, count(*) OVER (PARTITION BY uid) - 1 - t AS back, sum(mask) OVER (PARTITION BY uid) AS m FROM {tokens}) x GROUP BY uid")
def _(t: Tables) -> DataFrame:
    return arrays(t, "token", "mask").select("uid", A.unpad(F.col("token"), F.col("mask")).alias("tokens"))


@query("arr_loss_mask", "SELECT uid, t, CASE WHEN t < 1 OR t = least(s, n) - 1 THEN 0 ELSE mask END AS mask FROM (SELECT *, sum(mask) OVER (PARTITION BY uid) AS s, count(*) OVER (PARTITION BY uid) AS n FROM {tokens}) x")
def _(t: Tables) -> DataFrame:
    return exploded(arrays(t, "mask").select("uid", A.loss_mask(F.transform("mask", lambda x: x.cast("int")), F.lit(2)).alias("mask")), "mask", None)


@query("arr_turn_mask", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) AS size, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask FROM {conversations}")
def _(t: Tables) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("start"), F.length("text").alias("size"), (F.col("role") == "assistant").cast("int").alias("mask"))


@query("arr_clip", "SELECT uid, t, round(greatest(-0.02, least(0.02, reward)), 6) + 0.0 AS x FROM {tokens}")
def _(t: Tables) -> DataFrame:
    return exploded(arrays(t, "reward").select("uid", A.clip(F.col("reward"), -0.02, 0.02).alias("x")), "x")


@query("arr_entropy", "WITH z AS (SELECT uid, ln(sum(exp(reward))) AS z FROM {tokens} GROUP BY uid) SELECT x.uid, round(z - sum(exp(reward - z) * reward), 6) + 0.0 AS entropy FROM {tokens} x JOIN z ON x.uid = z.uid GROUP BY x.uid, z")
def _(t: Tables) -> DataFrame:
    return arrays(t, "reward").select("uid", r6(A.entropy(F.col("reward"))).alias("entropy"))


@query("arr_logprob", "SELECT uid, round(max(reward) FILTER (WHERE t = 0) - ln(sum(exp(reward))), 6) + 0.0 AS logp FROM {tokens} GROUP BY uid")
def _(t: Tables) -> DataFrame:
    return arrays(t, "reward").select("uid", r6(A.log_prob(F.col("reward"), F.lit(0))).alias("logp"))


@query("arr_random_mask", """SELECT uid, list_transform(range(n), lambda i: CAST(i >= left_ AS INTEGER)) AS mask FROM
    (SELECT uid, n, CAST('0x' || substr(md5(concat('3|', uid)), 1, 13) AS BIGINT) % greatest(n // 2, 1) AS left_ FROM (SELECT uid, count(*) AS n FROM {tokens} GROUP BY uid) a) b""")
def _(t: Tables) -> DataFrame:
    return arrays(t, "token").select("uid", A.random_left_mask(F.size("token"), F.col("uid"), 3).alias("mask"))


@query("kl_variants", "SELECT uid, t, round(logp - ref_logp, 6) AS kl, round(abs(logp - ref_logp), 6) AS abs, round(0.5 * (logp - ref_logp) * (logp - ref_logp), 6) AS mse, round(greatest(-10, least(10, exp(ref_logp - logp) - (ref_logp - logp) - 1)), 6) AS low_var FROM {tokens}")
def _(t: Tables) -> DataFrame:
    kinds = {"kl": "kl", "abs": "abs", "mse": "mse", "low_var": "low_var_kl"}
    rows = arrays(t, "logp", "ref_logp")
    zipped = rows.select("uid", F.posexplode(F.arrays_zip(*(A.kl(F.col("logp"), F.col("ref_logp"), k).alias(n) for n, k in kinds.items()))).alias("t", "z"))
    return zipped.select("uid", F.col("t").cast("long").alias("t"), *(r6(F.col("z")[n]).alias(n) for n in kinds))


@query("kl_reward", "SELECT uid, t, round(reward - 0.1 * (logp - ref_logp) * mask, 6) + 0.0 AS reward FROM {tokens}")
def _(t: Tables) -> DataFrame:
    rows = arrays(t, "reward", "logp", "ref_logp", "mask")
    return exploded(rows.select("uid", A.kl_reward(F.col("reward"), A.kl(F.col("logp"), F.col("ref_logp")), F.col("mask"), 0.1).alias("reward")), "reward")


@query("kl_controller", """SELECT uid, t, round(0.2 * exp(sum(ln(1 + greatest(-0.2, least(0.2, (abs(logp - ref_logp) / 0.5) - 1)) * 8 / 100.0)) OVER (PARTITION BY uid ORDER BY t)), 6) AS beta FROM {tokens}""")
def _(t: Tables) -> DataFrame:
    measured = A.kl(F.col("logp"), F.col("ref_logp"), "abs")
    return exploded(arrays(t, "logp", "ref_logp").select("uid", A.kl_coefficients(measured, 100.0, F.lit(8), 0.2, 0.5).alias("beta")), "beta")


@query("ppo_loss", """WITH x AS (SELECT *, exp(logp - old_logp) AS r FROM {tokens}), y AS (SELECT *, -adv * r AS plain, -adv * greatest(0.8, least(1.2, r)) AS bound, -adv * 3.0 AS floor_ FROM x)
    SELECT round(sum(mask * CASE WHEN adv < 0 THEN least(floor_, greatest(plain, bound)) ELSE greatest(plain, bound) END) / (sum(mask) + 1e-8), 6) AS loss, round(sum(mask * CASE WHEN bound > plain THEN 1.0 ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipped,
    round(sum(mask * CASE WHEN greatest(plain, bound) > floor_ AND adv < 0 THEN 1.0 ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipped_low, round(sum(mask * (old_logp - logp)) / (sum(mask) + 1e-8), 6) AS kl FROM y""")
def _(t: Tables) -> DataFrame:
    rows = t.tokens.select("mask", A.policy_loss(F.col("old_logp"), F.col("logp"), F.col("adv")).alias("p"))
    return rows.agg(*(r6(G.masked_mean(F.col(f"p.{c}"), F.col("mask"))).alias(c) for c in ("loss", "clipped", "clipped_low", "kl")))


@query("value_loss", """WITH x AS (SELECT mask, (value - reward) * (value - reward) AS a, (greatest(adv - 0.2, least(adv + 0.2, value)) - reward) * (greatest(adv - 0.2, least(adv + 0.2, value)) - reward) AS b FROM {tokens})
    SELECT round(sum(mask * 0.5 * greatest(a, b)) / (sum(mask) + 1e-8), 6) AS loss, round(sum(mask * CASE WHEN b > a THEN 1.0 ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clipped FROM x""")
def _(t: Tables) -> DataFrame:
    rows = t.tokens.select("mask", A.value_loss(F.col("value"), F.col("reward"), F.col("adv"), 0.2).alias("v"))
    return rows.agg(*(r6(G.masked_mean(F.col(f"v.{c}"), F.col("mask"))).alias(c) for c in ("loss", "clipped")))


@query("entropy_loss", "SELECT round(sum(value * mask) / (sum(mask) + 1e-8), 6) AS loss FROM {tokens}")
def _(t: Tables) -> DataFrame:
    return t.tokens.agg(r6(G.masked_mean(F.col("value"), F.col("mask"))).alias("loss"))


@query("dpo_ce_loss", "SELECT round(avg(-(acc * ln(1 / (1 + exp(-0.05 * s))) + (1 - acc) * ln(1 - 1 / (1 + exp(-0.05 * s))))), 6) AS loss FROM (SELECT acc, score * 3 - 1 AS s FROM {rollouts}) x")
def _(t: Tables) -> DataFrame:
    return t.rollouts.agg(r6(F.avg(A.dpo_loss(F.col("score") * 3 - 1, F.col("acc"), 0.05))).alias("loss"))


@query("dpo_detach_loss", """WITH o AS (SELECT a.uid, a.idx, a.score, a.acc, avg(b.score) AS other FROM {rollouts} a LEFT JOIN {rollouts} b ON a.uid = b.uid AND b.acc <> a.acc GROUP BY 1, 2, 3, 4),
    w AS (SELECT a.uid, a.idx, count(*) AS n, count(*) * pow(count(*) FILTER (WHERE b.score <= a.score) / CAST(count(*) AS DOUBLE), count(*) - 1) AS rm, count(*) * pow(count(*) FILTER (WHERE b.acc <= a.acc) / CAST(count(*) AS DOUBLE), count(*) - 1) AS acc FROM {rollouts} a JOIN {rollouts} b ON a.uid = b.uid GROUP BY 1, 2),
    l AS (SELECT -ln(1 / (1 + exp(-(0.05 * (score - coalesce(other, 0))) * (o.acc * 2 - 1)))) AS x, rm, w.acc AS by_acc FROM o JOIN w ON o.uid = w.uid AND o.idx = w.idx)
    SELECT round(avg(x), 6) AS loss, round(sum(x * rm), 3) AS bon_rm, round(sum(x * by_acc), 3) AS bon_acc FROM l""")
def _(t: Tables) -> DataFrame:
    """Each response against those of the other outcome: the mean, and sums weighted by how likely it is the best of n, by score and by outcome."""
    w = Window.partitionBy("uid")
    against = F.when(F.col("acc") > 0, F.avg(F.when(F.col("acc") == 0, F.col("score"))).over(w)).otherwise(F.avg(F.when(F.col("acc") > 0, F.col("score"))).over(w))
    gap = (F.col("score") - F.coalesce(against, F.lit(0.0))) * 0.05 * (F.col("acc") * 2 - 1)
    rows = t.grouped("lineitem", "l_orderkey").rollouts.select((-F.log(1 / (1 + F.exp(-gap)))).alias("x"), G.best_of_n_weight(F.col("score"), "uid").alias("rm"), G.best_of_n_weight(F.col("acc"), "uid").alias("acc"))
    return rows.agg(r6(F.avg("x")).alias("loss"), F.round(F.sum(F.col("x") * F.col("rm")), 3).alias("bon_rm"), F.round(F.sum(F.col("x") * F.col("acc")), 3).alias("bon_acc"))


# ---------------------------------------------------------------- balancing


def _sums(t: Tables, parts: DataFrame) -> DataFrame:
    return parts.join(_batch(t), ["batch", "key"]).groupBy("batch", "part").agg(F.sum("len").alias("tokens"))


def _batch(t: Tables) -> DataFrame:
    """A training step has the responses of 256 neighbouring prompt numbers, however many prompts there are."""
    return t.rollouts.select(F.floor(F.col("uid") / 256).alias("batch"), F.concat_ws("-", "uid", "idx").alias("key"), "len")


@query("bal_karmarkar_karp")
def _(t: Tables) -> DataFrame:
    return _sums(t, B.balanced(_batch(t), ["batch"], "key", "len", 4))


@query("bal_greedy")
def _(t: Tables) -> DataFrame:
    return _sums(t, B.greedy_balanced(_batch(t), ["batch"], "key", "len", 4))


@query("bal_micro_batches", """WITH b AS (SELECT uid // 256 AS batch, uid % 2 AS rank, sum(len) AS n, count(*) AS members FROM {rollouts} GROUP BY 1, 2), m AS (SELECT batch, max(ceil(n / 4096.0)) AS parts FROM b GROUP BY 1)
    SELECT b.batch, b.rank, CAST(m.parts AS INTEGER) AS parts, CAST(m.parts AS BIGINT) AS used, members AS members, members AS places, members - 1 AS last, CAST(n AS BIGINT) AS tokens, TRUE AS balanced FROM b JOIN m USING (batch)""")
def _(t: Tables) -> DataFrame:
    """Two ranks a step: how many parts they agree on, and whether the inverse is a permutation of the rank's rows and no part is
    above the mean by more than the longest row."""
    rows = t.rollouts.select(F.floor(F.col("uid") / 256).alias("batch"), (F.col("uid") % 2).alias("rank"), F.concat_ws("-", "uid", "idx").alias("key"), "len")
    split = B.micro_batches(rows, ["batch"], "rank", "key", "len", 4_096).join(rows, ["batch", "rank", "key"])
    parts = split.groupBy("batch", "rank", "parts", "part").agg(F.count("*").alias("c"), F.sum("len").alias("s"), F.max("len").alias("longest"), F.max("position").alias("last"), F.sum("position").alias("total"))
    out = parts.groupBy("batch", "rank", "parts").agg(F.count("*").alias("used"), F.sum("c").alias("members"), F.max("last").cast("long").alias("last"), F.sum("total").alias("total"), F.sum("s").alias("tokens"), F.max("s").alias("most"), F.max("longest").alias("longest"))
    members = F.col("members")
    places = F.when(F.col("total") == members * (members - 1) / 2, members).otherwise(-1).cast("long")
    return out.select("batch", "rank", "parts", "used", "members", places.alias("places"), "last", "tokens", (F.col("most") <= F.col("tokens") / F.col("parts") + F.col("longest")).alias("balanced"))


@query("flops_estimate", "SELECT batch, round((6.0 * 8e9 * sum(len) + 12.0 * sum(len * len) * 128 * 32 * 36) / 2.5 / 1e12, 6) AS tflops FROM (SELECT uid % 16 AS batch, len FROM {rollouts}) x GROUP BY batch")
def _(t: Tables) -> DataFrame:
    per = t.rollouts.groupBy((F.col("uid") % 16).alias("batch")).agg(F.sum("len").alias("n"), F.sum(F.col("len") * F.col("len")).alias("s"))
    return per.select("batch", r6(A.flops(F.col("n"), F.col("s"), 8e9, 128, 32, 36, F.lit(2.5))).alias("tflops"))


@query("img_resize_rule", """WITH s AS (SELECT p_partkey, p_size * 100 AS w, 600 AS h FROM {part}), d AS (SELECT p_partkey, CASE WHEN w * h > 4194304 THEN floor(w * sqrt(4194304.0 / (w * h))) ELSE w END AS w, CASE WHEN w * h > 4194304 THEN floor(h * sqrt(4194304.0 / (w * h))) ELSE h END AS h FROM s)
    SELECT p_partkey, CAST(CASE WHEN w * h < 262144 THEN floor(w * sqrt(262144.0 / (w * h))) ELSE w END AS INTEGER) AS width, CAST(CASE WHEN w * h < 262144 THEN floor(h * sqrt(262144.0 / (w * h))) ELSE h END AS INTEGER) AS height FROM d""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", A.resized(F.col("p_size") * 100, F.lit(600)).alias("s")).select("p_partkey", "s.*")
