"""Queries on sequences and event streams: transitions, hold-outs, as-of and interval joins, latest values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hv import top_k
from ..functions.text import jaccard, lower_tokens
from .registry import query, table

_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query(f"SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER ({_ORDER}) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b")
def event_transitions(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(_by_user()).alias("b"))
    return e.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, p2 || p1 || left(event_type, 1) AS key FROM (SELECT event_id, event_type, left(lag(event_type, 2) OVER ({_ORDER}), 1) AS p2, left(lag(event_type) OVER ({_ORDER}), 1) AS p1 FROM events)")
def last3_key(spark, sf):
    """First letters of the last three events; null where there are fewer."""
    first = lambda c: F.left(c, F.lit(1))
    parts = [first(F.lag("event_type", k).over(_by_user())) for k in (2, 1)] + [first(F.col("event_type"))]
    return table(spark, sf, "events").select("event_id", F.concat(*parts).alias("key"))


@query(f"SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER ({_ORDER}) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def consecutive_dup_drop(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.lag("event_type").over(_by_user()))
    return e.where("p is null or p <> event_type").select("event_id", "user_id", "event_type")


@query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30")
def holdout_last_n(spark, sf):
    return top_k(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 30).select("event_type", "event_id", "ts")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id, event_type")
def latest_value_per_slot(spark, sf):
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", at).alias("value"), F.max("ts").alias("ts"))


@query("SELECT *, rn > 1 AS superseded FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)")
def supersession(spark, sf):
    """All values of a slot stay; all but the latest are marked superseded."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.row_number().over(w).cast("long").alias("rn")).withColumn("superseded", F.col("rn") > 1)


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def daily_bars(spark, sf):
    at = F.struct("ts", "event_id")
    e = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day"))
    return e.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_props_rollup(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT v.event_id, count(*) AS n, min(c.event_id) AS first FROM events v JOIN events c ON v.user_id = c.user_id AND c.event_type = 'click' AND v.event_type = 'view'
  AND epoch(c.ts) BETWEEN epoch(v.ts) - 14400 AND epoch(v.ts) + 28800 GROUP BY v.event_id""")
def interval_join_fusion(spark, sf):
    """Views with the clicks of the same user from four hours before to eight after, joined on a time bucket."""
    width = 43200
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").withColumn("t", t)
    views = e.where("event_type = 'view'").select("event_id", "user_id", "t", F.explode(F.sequence(F.floor((F.col("t") - 14400) / width), F.floor((F.col("t") + 28800) / width))).alias("bin"))
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("c"), "user_id", F.col("t").alias("u"), F.floor(F.col("t") / width).alias("bin"))
    return views.join(clicks, ["user_id", "bin"]).where("u between t - 14400 and t + 28800").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("first"))


@query("""SELECT p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) AS view_id FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts AND p.event_type = 'purchase' WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def as_of_view(spark, sf):
    """Each purchase with the user's last view up to it: one pass over the user's events, no join."""
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    e = table(spark, sf, "events").withColumn("v", F.max(view).over(upto))
    return e.where("event_type = 'purchase'").select("event_id", F.col("v.event_id").alias("view_id"))


@query("""WITH c AS (SELECT o_custkey AS k, year(o_orderdate) AS y, o_orderkey AS o, o_totalprice AS p FROM orders),
b AS (SELECT k, arg_max(o, (y, o)) FILTER (y <= 1995) AS before, arg_min(o, (abs(y - 1995), o)) AS near FROM c GROUP BY k) SELECT k AS c_custkey, coalesce(before, near) AS o_orderkey FROM b""")
def as_of_claim(spark, sf):
    """The newest order dated up to 1995, else the closest in years."""
    y = F.year("o_orderdate")
    before = F.max_by("o_orderkey", F.when(y <= 1995, F.struct(y.alias("y"), "o_orderkey")))
    near = F.min_by("o_orderkey", F.struct(F.abs(y - 1995).alias("d"), "o_orderkey"))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.coalesce(before, near).alias("o_orderkey"))


@query("""WITH r AS (SELECT role, action, filler, count(*) AS n FROM (SELECT 'type' AS role, CAST(user_id % 10 AS VARCHAR) AS action, event_type AS filler FROM events UNION ALL SELECT 'k', CAST(user_id % 10 AS VARCHAR), CAST(json_extract(props, '$.k') AS VARCHAR) FROM events) GROUP BY 1, 2, 3)
SELECT role, action, filler, n FROM (SELECT *, row_number() OVER (PARTITION BY role, action ORDER BY n DESC, filler) AS rn FROM r) WHERE rn <= 10""")
def role_filler_counts(spark, sf):
    """The ten most frequent fillers of each role of each action."""
    e = table(spark, sf, "events").select((F.col("user_id") % 10).cast("string").alias("action"), F.expr("stack(2, 'type', event_type, 'k', get_json_object(props, '$.k')) as (role, filler)"))
    counts = e.groupBy("role", "action", "filler").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["role", "action"], [F.desc("n"), F.col("filler")], 10).drop("rank")


@query("""WITH s AS (SELECT l_returnflag AS action, l_linestatus AS role, l_partkey % 50 AS filler, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT action, role, sum(n) AS total FROM s GROUP BY 1, 2),
r AS (SELECT DISTINCT role, filler FROM s), g AS (SELECT l_returnflag AS action, l_linestatus AS role, l_suppkey % 60 AS filler FROM lineitem GROUP BY 1, 2, 3)
SELECT g.action, g.role, g.filler, CAST(CASE WHEN s.n IS NOT NULL THEN greatest(0, least(1, round(1 - 5 * s.n / t.total, 6))) WHEN r.filler IS NOT NULL THEN 0.7 ELSE 1 END AS DOUBLE) AS novelty
FROM g LEFT JOIN s USING (action, role, filler) LEFT JOIN t USING (action, role) LEFT JOIN r ON r.role = g.role AND r.filler = g.filler""")
def novelty_score(spark, sf):
    """1 - 5 times the share of a filler in its slot, 0.7 where only the role has it, else 1."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("action"), F.col("l_linestatus").alias("role"), (F.col("l_partkey") % 50).alias("filler"), (F.col("l_suppkey") % 60).alias("asked"))
    seen = li.groupBy("action", "role", "filler").agg(F.count(F.lit(1)).alias("n"))
    total = seen.groupBy("action", "role").agg(F.sum("n").alias("total"))
    known = seen.select("role", "filler").distinct().withColumn("known", F.lit(True))
    asked = li.select("action", "role", F.col("asked").alias("filler")).distinct()
    out = asked.join(seen, ["action", "role", "filler"], "left").join(total, ["action", "role"], "left").join(known, ["role", "filler"], "left")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - 5 * F.col("n") / F.col("total"), 6)))
    return out.select("action", "role", "filler", F.when(F.col("n").isNotNull(), share).when(F.col("known"), 0.7).otherwise(1.0).alias("novelty"))


@query("SELECT conv_id, turn, a AS answer_turn, text AS question, b AS answer FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(turn) OVER w AS a, lead(text) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def qa_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("r"), F.lead("turn").over(w).alias("answer_turn"), F.lead("text").over(w).alias("answer"))
    return c.where("role = 'user' and r = 'assistant'").select("conv_id", "turn", "answer_turn", "question", "answer")


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+')) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM t)
SELECT conv_id, turn, round(coalesce(len(list_intersect(w, q)) / nullif(len(list_distinct(list_concat(w, q))), 0), 0)::DOUBLE, 6) AS overlap, len(w) <= 6 AND q IS NOT NULL AS followup FROM p""")
def followup_flag(spark, sf):
    """Short turns after another one, with the share of words that the two have in common."""
    w = F.array_distinct(lower_tokens(F.col("text")))
    t = table(spark, sf, "conversations").select("conv_id", "turn", w.alias("w")).withColumn("q", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    overlap = F.coalesce(F.round(jaccard(F.col("w"), F.col("q")), 6), F.lit(0.0))
    return t.select("conv_id", "turn", overlap.alias("overlap"), ((F.size("w") <= 6) & F.col("q").isNotNull()).alias("followup"))


@query("SELECT user_id, list_reduce(list_prepend(CAST(100 AS BIGINT), list(CAST(CASE WHEN event_type = 'purchase' THEN -(CAST(floor(value) AS BIGINT) % 50) ELSE CAST(floor(value) AS BIGINT) % 7 END AS BIGINT) ORDER BY ts, event_id)), lambda a, x: greatest(a + x, 0)) AS balance FROM events WHERE value IS NOT NULL GROUP BY user_id")
def gain_loss_fold(spark, sf):
    """A balance from 100 with steps up and down in time order that can't go below 0.

    With the running sums S of the steps it ends at S_n - min(-100, least S_i): a sum and a minimum, so no array of a user's events is held.
    """
    v = F.floor("value").cast("long")
    e = table(spark, sf, "events").where("value is not null").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", -(v % 50)).otherwise(v % 7).alias("step"))
    so_far = e.select("user_id", "step", F.sum("step").over(_by_user().rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    return so_far.groupBy("user_id").agg((F.sum("step") - F.least(F.lit(-100).cast("long"), F.min("s"))).alias("balance"))
