"""Sort, limit, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalogue.aggregates import PROFILE_SQL
from watchgrid.catalogue.registry import query, rounded
from watchgrid.operators import aggregate as A
from watchgrid.operators import evaluation as E
from watchgrid.operators import features as W
from watchgrid.operators import objects as O
from watchgrid.operators import ranking as R
from watchgrid.session import materialize
from watchgrid.sources import catalogs
from watchgrid.sources import testtables as T


@query("daily_topk", """
SELECT * FROM (SELECT model, object_id, "date", score, alarm_target,
 row_number() OVER (PARTITION BY model, "date" ORDER BY score DESC, object_id) AS "rank" FROM scores) WHERE "rank" <= 10""")
def daily_topk(spark, sf):
    return rounded(E.daily_rank(T.scores(spark, sf), ["model"], 10).select(
        "model", "object_id", "date", "score", "alarm_target", "rank"))


@query("rank_queue", """
SELECT *, CAST("rank" <= 10 AS BIGINT) AS warning, max(CASE WHEN "rank" = 10 THEN score END) OVER (PARTITION BY "date") AS threshold
FROM (SELECT object_id, "date", blend AS score, row_number() OVER (PARTITION BY "date" ORDER BY blend DESC, object_id) AS "rank" FROM wide_scores)""")
def rank_queue(spark, sf):
    cards = T.score_table(spark, sf).select("object_id", "date", F.col("blend").alias("score"))
    return rounded(R.rank_queue(cards, 10))


@query("review_queue", """
SELECT q.object_id, q."date", o.object_name, coalesce(p.object_name, 'Группа ' || o.parent_id) AS parent_name, score, "rank",
 CAST("rank" <= 10 AS BIGINT) AS warning, alarm_streak, alarm_days_7d, observed_days_7d
FROM (SELECT *, row_number() OVER (PARTITION BY "date" ORDER BY score DESC, object_id) AS "rank" FROM (
 SELECT od.object_id, "date", round((pos + 30 * g) / (n + 30), 6) AS score,
  CASE WHEN alarm_today = 1 THEN i - coalesce(max(CASE WHEN alarm_today = 0 THEN i END) OVER (PARTITION BY od.object_id ORDER BY "date"), -1) ELSE 0 END AS alarm_streak,
  CAST(sum(alarm_today) OVER w AS BIGINT) AS alarm_days_7d, CAST(sum(observed_today) OVER w AS BIGINT) AS observed_days_7d
 FROM od JOIN rates USING (object_id) CROSS JOIN global_rate
 WINDOW w AS (PARTITION BY od.object_id ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))) q
JOIN objects o USING (object_id) LEFT JOIN objects p ON p.object_id = o.parent_id WHERE "rank" <= 10""")
def review_queue(spark, sf):
    """Objects to review for each day D+2: journal to ranked cards in one plan."""
    from watchgrid.operators.labels import label_onset

    mart = O.recap_7d(T.object_mart(spark, sf)).withColumn("_n", F.row_number().over(O.by_day()))
    mart = mart.withColumn("alarm_streak", W.streak(F.col("alarm_today") == 1, O.by_day())).drop("_n")
    scored = O.smoothed_frequency(label_onset(mart), T.day(T.TRAIN_END)).withColumn("score", F.round("smoothed", 6))
    best = E.daily_rank(scored, [], 10).drop("parent_id", "object_kind")
    named = best.join(catalogs.with_parent(T.objects(spark, sf)), "object_id")
    return rounded(named.select("object_id", "date", "object_name", "parent_name", "score", "rank", F.lit(1).alias("warning"),
                                "alarm_streak", "alarm_days_7d", "observed_days_7d"))


@query("top_activity", f"""
SELECT * FROM (SELECT 'rows' AS list, channel_id, "rows", round(alarm_percent, 6) AS alarm_percent FROM ({PROFILE_SQL}) ORDER BY "rows" DESC, channel_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'alarm_rate', channel_id, "rows", round(alarm_percent, 6) AS a FROM ({PROFILE_SQL}) WHERE "rows" >= 50
 ORDER BY alarm_percent DESC, "rows" DESC, channel_id LIMIT 50)""")
def top_activity(spark, sf):
    profile = A.channel_profile(T.clean(spark, sf))
    lists = {"rows": R.top_by_rows(profile, 50), "alarm_rate": R.top_by_alarm_rate(profile, 50, min_rows=50)}
    parts = [df.select(F.lit(n).alias("list"), "channel_id", "rows", "alarm_percent") for n, df in lists.items()]
    return rounded(parts[0].unionByName(parts[1]))


@query("top_text_values", """
SELECT value_text, count(*) AS "rows" FROM clean WHERE kind = 'text' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def top_text_values(spark, sf):
    return R.top_values(T.clean(spark, sf), 50)


@query("unknown_channels_top", """
SELECT channel_id, count(*) AS "rows" FROM journal WHERE channel_id NOT IN (SELECT channel_id FROM channels)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def unknown_channels_top(spark, sf):
    return R.unknown_channels(T.journal(spark, sf), T.channels(spark, sf), 50)


_SOURCES = ["events_count", "alarm_count", "fault_count", "negative_count"]


# Importance stand-ins: four statistics per counter over all channel-days.
@query("top_importance", "WITH imp AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean_value, stddev_pop({c}) AS spread, corr({c}, value_sum) AS signed, CAST(max({c}) AS DOUBLE) AS top FROM cd"
    for c in _SOURCES) + """),
clipped AS (SELECT feature, greatest(mean_value, 0) AS mean_value, greatest(spread, 0) AS spread, greatest(signed, 0) AS signed, greatest(top, 0) AS top FROM imp)
SELECT feature, round(m, 5) AS mean_value, round(s, 5) AS spread, round(g, 5) AS signed, round(t, 5) AS top, round(m + s + g + t, 5) AS combined
FROM (SELECT feature, mean_value / sum(mean_value) OVER () AS m, spread / sum(spread) OVER () AS s,
 coalesce(signed / nullif(sum(signed) OVER (), 0), 0) AS g, top / sum(top) OVER () AS t FROM clipped) ORDER BY m + s + g + t DESC LIMIT 3""")
def top_importance(spark, sf):
    stats = []
    for c in _SOURCES:
        stats.append(F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean_value"), F.stddev_pop(c).alias("spread"),
                              F.corr(c, "value_sum").alias("signed"), F.max(c).cast("double").alias("top")))
    rows = T.channel_days(spark, sf).agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return rounded(R.combine_importance(rows, ["mean_value", "spread", "signed", "top"], 3), 5)


@query("risk_queue_channels", """
SELECT channel_id, observed_days_7d, score FROM (SELECT channel_id, "date",
 CAST(sum(observed) OVER (PARTITION BY channel_id ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS observed_days_7d,
 round(avg(alarm) OVER (PARTITION BY channel_id ORDER BY "date"), 6) AS score FROM g)
WHERE "date" = DATE '2024-01-30' AND observed_days_7d > 0 ORDER BY score DESC, channel_id LIMIT 100""")
def risk_queue_channels(spark, sf):
    days = T.grid(spark, sf).select(
        "channel_id", "date", W.trailing("observed", 7).alias("observed_days_7d"),
        F.round(F.avg("alarm").over(W.running(W.by_day())), 6).alias("score"))
    last = days.where(F.col("date") == T.day(T.CALENDAR[1])).drop("date")
    return R.channel_queue(last, 100)


def _sample(spark, sf):
    """A third of all labelled channel-days, positives at most 45 %."""
    from watchgrid.operators import labels as L

    rows = materialize(L.label_next_day(T.grid(spark, sf), T.day(T.CALENDAR[1])).select("channel_id", "date", "target"), "labelled")
    cap = max(10, rows.count() // 3)
    return R.stratified_sample(rows, "target", ["channel_id", "date"], cap, 0.45, seed=84)


@query("stratified_sample", """
WITH rows AS (SELECT channel_id, "date", target, md5(concat('84|', channel_id, '|', CAST("date" AS VARCHAR))) AS h
  FROM (SELECT channel_id, "date", lead(alarm, 1, 0) OVER (PARTITION BY channel_id ORDER BY "date") AS target FROM g) WHERE "date" < DATE '2024-01-30'),
 sizes AS (SELECT greatest(10, count(*) // 3) AS cap, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM rows),
 keep AS (SELECT p, n, least(p, greatest(1, CAST(floor(cap * 0.45) AS BIGINT))) AS kp, least(n, cap - least(p, greatest(1, CAST(floor(cap * 0.45) AS BIGINT)))) AS kn FROM sizes)
SELECT channel_id, "date", target, CASE WHEN target = 1 THEN p ELSE n END AS class_size, CASE WHEN target = 1 THEN kp ELSE kn END AS class_sample
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY h, channel_id, "date") AS r FROM rows), keep WHERE r <= CASE WHEN target = 1 THEN kp ELSE kn END""")
def stratified_sample(spark, sf):
    return rounded(_sample(spark, sf))


@query("inverse_weights", """
SELECT target, n AS class_rows, k AS sampled_rows, round((n / k) / (total / sampled), 6) AS weight FROM (
 SELECT *, sum(k) OVER () AS sampled, sum(n) OVER () AS total FROM (
  SELECT target, n, CASE WHEN target = 1 THEN least(n, greatest(1, CAST(floor(cap * 0.45) AS BIGINT)))
   ELSE least(n, cap - least(p, greatest(1, CAST(floor(cap * 0.45) AS BIGINT)))) END AS k FROM (
   SELECT target, count(*) AS n, greatest(10, sum(count(*)) OVER () // 3) AS cap, sum(CASE WHEN target = 1 THEN count(*) ELSE 0 END) OVER () AS p
   FROM (SELECT lead(alarm, 1, 0) OVER (PARTITION BY channel_id ORDER BY "date") AS target, "date" FROM g) WHERE "date" < DATE '2024-01-30' GROUP BY 1)))""")
def inverse_weights(spark, sf):
    weighted = R.inverse_weights(materialize(_sample(spark, sf), "sample"))
    return rounded(weighted.groupBy("target").agg(
        F.max("class_size").alias("class_rows"), F.count("*").alias("sampled_rows"), F.max("weight").alias("weight")))


@query("recency_weights", """
SELECT object_id, "date", round(pow(0.5, (DATE '2024-01-28' - "date") / 90) / avg(pow(0.5, (DATE '2024-01-28' - "date") / 90)) OVER (), 6) AS weight
FROM ol WHERE alarm_target IS NOT NULL""")
def recency_weights(spark, sf):
    rows = materialize(T.labelled(spark, sf).where("alarm_target IS NOT NULL").select(
        "object_id", "date", F.lit(1.0).alias("weight")), "labelled")
    return rounded(R.recency_weights(rows, T.day(T.TEST[1]), 90))
