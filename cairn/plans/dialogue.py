"""Queries that answer: parsed questions, routes, cohorts, diverse picks, rendering, blends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answer as an
from ..operators import mine, retrieve
from .claims import _CLAIMS, _claims
from .registry import ORACLE_SQL, capital, given, land, letters, person, query, table
from .retrieval import _knn_sql, _vectors

#: qid, text: questions about what the sentences of the claims say, and others.
QUESTIONS = given("t", f"""SELECT c_custkey AS qid, CASE c_custkey % 13 WHEN 0 THEN 'When was ' || {person('c_custkey')} || ' born?' WHEN 1 THEN 'What did ' || {person('c_custkey')} || ' invent?' WHEN 2 THEN 'What is the capital of ' || {land('c_nationkey')} || '?' WHEN 3 THEN 'Who was ' || {person('c_custkey')} || '?'
  WHEN 4 THEN 'when did ' || {person('c_custkey')} || ' die' WHEN 5 THEN '12 * (3 + ' || CAST(c_custkey AS STRING) || ')' WHEN 6 THEN 'how many rivers are there' WHEN 7 THEN 'who is older, A or B?' WHEN 8 THEN 'remember the key' WHEN 9 THEN 'The ' || {capital(letters('c_custkey % 50'))} || 'n Song was composed by whom?'
  WHEN 10 THEN 'Where was ' || {person('c_custkey')} || ' born?' WHEN 11 THEN {land('c_nationkey')} || chr(39) || 's capital?' ELSE 'Who has invented the ' || {capital(letters('c_custkey'))} || ' Loom?' END AS text FROM customer""", "customer")
_Q = QUESTIONS.sql


def _questions(spark, sf):
    return QUESTIONS.df(spark, sf)


def _parsed_sql() -> str:
    cases = {k: [] for k in ("shape", "subj", "verb", "obj")}
    for name, pattern, slots in an.SHAPES:
        p, group = pattern.replace("'", "''"), 0
        fill = {"shape": f"'{name}'", "subj": "NULL", "verb": "NULL", "obj": "NULL"}
        for s in slots:
            slot, _, fixed = s.partition("=")
            group += not fixed
            fill[slot] = f"'{fixed}'" if fixed else f"regexp_replace(trim(regexp_replace(regexp_extract(trim(text), '{p}', {group}), '[?.]+\\s*$', '')), '(?i)^(?:the|an?)\\s+', '')"
        for k, v in fill.items():
            cases[k].append(f"WHEN regexp_matches(trim(text), '{p}') THEN {v}")
    past = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in an.PAST.items())
    return f"SELECT qid, shape, subj, CASE lower(verb) {past} ELSE verb END AS verb, obj FROM (SELECT qid, {', '.join(f'CASE {" ".join(v)} END AS {k}' for k, v in cases.items())} FROM {_Q}) WHERE shape IS NOT NULL"


@query(_parsed_sql())
def parsed_questions(spark, sf):
    return an.parsed(_questions(spark, sf))


@query(f"SELECT qid, CASE {' '.join(f"WHEN regexp_matches(trim(text), '{p}') THEN '{n}'" for n, p in an.ROUTES)} ELSE 'semantic' END AS route FROM {_Q}")
def routed_questions(spark, sf):
    return _questions(spark, sf).select("qid", an.route(F.col("text")).alias("route"))


@query(f"{_CLAIMS}, q AS ({_parsed_sql()}), h AS (SELECT qid, c.obj AS answer, id, pos FROM q JOIN claims c ON q.subj IS NOT NULL AND c.subj = q.subj AND c.verb = q.verb UNION ALL SELECT qid, c.subj, id, pos FROM q JOIN claims c ON q.obj IS NOT NULL AND c.obj = q.obj AND c.verb = q.verb) SELECT qid, arg_min(answer, (id, pos)) AS answer FROM h GROUP BY qid")
def structured_answers(spark, sf):
    return an.answer(_questions(spark, sf), _claims(spark, sf))


@query(f"SELECT qid, id, round(sim, 6) AS sim FROM (SELECT *, max(sim) OVER (PARTITION BY qid) AS best FROM ({_knn_sql(12)})) WHERE sim >= greatest(0.24, 0.7 * best)")
def hit_cohort(spark, sf):
    _, rows, q = _vectors(spark, sf)
    return an.cohort(retrieve.cosine_knn(rows, q, 12)).select("qid", "id", F.round("sim", 6).alias("sim"))


@query(None)
def diverse_hits(spark, sf):
    """Three of the twelve nearest vectors of each query that are unlike each other."""
    _, rows, q = _vectors(spark, sf)
    return an.diverse(retrieve.cosine_knn(rows, q, 12), rows)


@query("SELECT user_id, up, down, side, CASE WHEN up > down AND up > side + 1 THEN 'buy' WHEN down > up AND down > side + 1 THEN 'sell' ELSE 'wait' END AS action FROM (SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS up, count(*) FILTER (event_type IN ('error', 'purchase')) AS down, count(*) FILTER (event_type = 'signup') AS side FROM events GROUP BY user_id)")
def vote_with_abstention(spark, sf):
    n = lambda cond: F.count_if(cond)
    e = F.col("event_type")
    v = table(spark, sf, "events").groupBy("user_id").agg(n(e.isin("click", "view")).alias("up"), n(e.isin("error", "purchase")).alias("down"), n(e == "signup").alias("side"))
    buy, sell = (F.col("up") > F.col("down")) & (F.col("up") > F.col("side") + 1), (F.col("down") > F.col("up")) & (F.col("down") > F.col("side") + 1)
    return v.select("*", F.when(buy, "buy").when(sell, "sell").otherwise("wait").alias("action"))


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+')"


@query(f"""WITH b AS (SELECT g[1] AS c, g[2] AS n, count(*) AS k FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM (SELECT {_TOK} AS w FROM benchmark) WHERE len(w) >= 2) GROUP BY 1, 2),
s AS (SELECT c, n, k / sum(k) OVER (PARTITION BY c) AS p FROM b), u AS (SELECT t AS n, count(*) / sum(count(*)) OVER () AS p FROM (SELECT unnest({_TOK}) AS t FROM benchmark) GROUP BY t),
x AS (SELECT n, p FROM s WHERE c = 'the') SELECT coalesce(x.n, u.n) AS next, round(0.5 * coalesce(x.p, 0) + 0.5 * coalesce(u.p, 0), 6) AS p FROM x FULL OUTER JOIN u ON x.n = u.n""")
def outer_join_blend(spark, sf):
    return _blend(table(spark, sf, "benchmark"))


@query(ORACLE_SQL["outer_join_blend"].replace("FROM benchmark", "FROM documents"))
def outer_join_blend_documents(spark, sf):
    return _blend(table(spark, sf, "documents"))


def _blend(b):
    """Half the share after "the", half the overall share, for every word that has either."""
    t = mine.transitions(b, tx.lower_tokens(F.col("text")), 1).where("context = 'the'")
    one = t.join(F.broadcast(t.agg(F.sum("n").alias("s"))), F.lit(True)).select("next", (F.col("n") / F.col("s")).alias("p"))
    w = b.select(F.explode(tx.lower_tokens(F.col("text"))).alias("next")).groupBy("next").agg(F.count(F.lit(1)).alias("n"))
    two = w.join(F.broadcast(w.agg(F.sum("n").alias("s"))), F.lit(True)).select("next", (F.col("n") / F.col("s")).alias("q"))
    return one.join(two, "next", "full").select("next", F.round(0.5 * F.coalesce("p", F.lit(0.0)) + 0.5 * F.coalesce("q", F.lit(0.0)), 6).alias("p"))


TEMPLATES = ["%s lies in %s.", "One nation of %2$s is %1$s.", "%s is part of %s."]


@query("SELECT n_name, t AS template, CASE t WHEN 0 THEN n_name || ' lies in ' || r_name || '.' WHEN 1 THEN 'One nation of ' || r_name || ' is ' || n_name || '.' ELSE n_name || ' is part of ' || r_name || '.' END AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([0, 1, 2]) AS t)")
def rendered_facts(spark, sf):
    """Facts through each template: sentences for tests of extraction."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    made = F.array(*[F.format_string(t, "n_name", "r_name") for t in TEMPLATES])
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", F.posexplode(made).alias("template", "sentence"))


@query(r"SELECT conv_id, run, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,3}')) AS run FROM conversations) GROUP BY 1, 2")
def proper_noun_runs(spark, sf):
    runs = tx.tokens(F.col("text"), r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,3}")
    return table(spark, sf, "conversations").select("conv_id", F.explode(runs).alias("run")).groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, next_turn, role, role_after, turn_gap FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS role_after, lead(turn) OVER w - turn AS turn_gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next_turn IS NOT NULL")
def turn_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("role_after"))
    return c.where("next_turn is not null").withColumn("turn_gap", F.col("next_turn") - F.col("turn"))


_DIALOGS = given("t", "SELECT conv_id * 1000 + turn AS id, CASE conv_id % 4 WHEN 0 THEN 'Human: what is it?' || chr(10) || 'Assistant: ' || text WHEN 1 THEN text || ' User: and then?' WHEN 2 THEN 'Answer: ' || text ELSE text END AS s FROM conversations WHERE role = 'assistant'", "conversations")
_BOTH = r"(?is)(?:Human|User|Question|Q):\s*(.*?)\s*(?:Assistant|Answer|Bot|AI|A):\s*(.+)"


@query(rf"""SELECT id, trim(CASE WHEN regexp_matches(s, '{_BOTH}') THEN regexp_extract(s, '{_BOTH}', 2) ELSE regexp_replace(regexp_replace(s, '(?is)(\S.*?)\s+(?:Human|User|Question|Q):\s*.*$', '\1'), '(?i)^(?:Human|User|Assistant|Agent|Question|Answer|Bot|AI|Q|A):\s*', '') END) AS text
FROM {_DIALOGS.sql}""")
def unscaffolded(spark, sf):
    return _DIALOGS.df(spark, sf).select("id", an.without_scaffold(F.col("s")).alias("text"))


@query(None)
def arithmetic_answers(spark, sf):
    return _questions(spark, sf).where(an.route(F.col("text")) == "arithmetic").select("qid", an.arithmetic(F.col("text")).alias("value"))
