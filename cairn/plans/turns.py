"""The turn pipeline: user turns, their pronouns resolved, through one route after the other until one answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer as an
from ..operators import claims as cl
from ..operators import facts as fa
from ..operators import replies as re_
from ..operators import route as ro
from ..operators import words as wo
from . import claims, dialogue, knowledge, routes
from .registry import ORACLE_SQL, query, table

NOT_KNOWN = "I do not know."


def _turns(spark, sf):
    """qid, question: user turns of the conversations, what customers say of themselves, and questions about the claims."""
    talk = table(spark, sf, "conversations")
    said = wo.with_antecedents(talk.select("conv_id", "turn", "text")).join(talk.where("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"])
    said = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("resolved").alias("question"))
    own = claims.FACTS.df(spark, sf).select((-1 - F.col("id")).alias("qid"), F.col("s").alias("question"))
    asked = dialogue.QUESTIONS.df(spark, sf).select((-1_000_000_000 - F.col("qid")).alias("qid"), F.col("text").alias("question"))
    items = table(spark, sf, "benchmark").select((-2_000_000_000 - F.col("item_id")).alias("qid"), F.concat(F.lit("what is "), "text").alias("question"))
    return said.unionByName(own).unionByName(asked).unionByName(items)


_TURNS = f"""(SELECT conv_id * 1000 + turn AS qid, resolved AS question FROM ({ORACLE_SQL['resolved_pronouns']}) JOIN conversations USING (conv_id, turn) WHERE role = 'user'
UNION ALL SELECT -1 - id, s FROM {claims.FACTS.sql} UNION ALL SELECT -1000000000 - qid, text FROM {dialogue.QUESTIONS.sql} UNION ALL SELECT -2000000000 - item_id, 'what is ' || text FROM benchmark) AS q"""


def _sql() -> str:
    noted = claims._facts_sql().replace(claims.FACTS.sql, "(SELECT qid AS id, question AS s FROM tu) AS t")
    parsed = dialogue._parsed_sql().replace(dialogue._Q, "(SELECT qid, question AS text FROM tu) AS t")
    good = routes._UPTO["good"].replace(routes.QUESTIONS.sql, "tu")
    graph = ORACLE_SQL["kg_lookup"].replace(knowledge.GRAPH_QUESTIONS.sql, "(SELECT qid, question AS text FROM tu) AS t")
    shape = r"^12 \* \(3 \+ (\d+)\)$"
    body = f"CASE WHEN {routes._NEG} THEN 'Asked for a negative, what is held is the positive: ' ELSE '' END || {routes._simple('text')}"
    return f"""{claims._CLAIMS}, tu AS MATERIALIZED (SELECT * FROM {_TURNS}), fx AS ({noted}), pq AS ({parsed}),
hs AS (SELECT qid, c.obj AS answer, id, pos FROM pq JOIN claims c ON pq.subj IS NOT NULL AND c.subj = pq.subj AND c.verb = pq.verb UNION ALL SELECT qid, c.subj, id, pos FROM pq JOIN claims c ON pq.obj IS NOT NULL AND c.obj = pq.obj AND c.verb = pq.verb),
kx AS ({graph}), {good},
a AS (SELECT id AS qid, 0 AS prio, 'fact' AS route, 'noted: ' || min(fact) AS answer FROM fx GROUP BY id
UNION ALL SELECT qid, 1, 'arithmetic', CAST(12.0 * (3 + regexp_extract(question, '{shape}', 1)::DOUBLE) AS VARCHAR) FROM tu WHERE regexp_matches(question, '{shape}')
UNION ALL SELECT qid, 2, 'structured', arg_min(answer, (id, pos)) FROM hs GROUP BY qid
UNION ALL SELECT qid, 3, 'semantic', {body} FROM go
UNION ALL SELECT qid, 4, 'graph', s || ' ' || r || ' ' || o FROM kx WHERE rank = 1
UNION ALL SELECT qid, 5, 'fallback', '{NOT_KNOWN}' FROM tu)
SELECT qid, arg_min(route, prio) AS route, arg_min(answer, prio) AS answer FROM a GROUP BY qid"""


@query(_sql())
def turn_pipeline(spark, sf):
    """Each turn's route and answer: facts to note, arithmetic, claims, documents, the graph of nations, else none."""
    memory = routes.MEMORY.df(spark, sf)
    text = lambda t: t.select("qid", F.col("question").alias("text"))

    def noted(t):
        return cl.user_facts(t.select(F.col("qid").alias("id"), F.col("question").alias("s")), F.col("s"), ["id"]).select(F.col("id").alias("qid"), F.concat(F.lit("noted: "), "fact").alias("answer"))

    def arithmetic(t):
        return t.where(an.route(F.col("question")) == "arithmetic").select("qid", an.arithmetic(F.col("question")).cast("string").alias("answer"))

    def graph(t):
        return fa.kg_facts(text(t), knowledge._graph(spark, sf)).where("rank = 1").select("qid", F.concat_ws(" ", "s", "r", "o").alias("answer"))

    steps = [
        ("fact", noted), ("arithmetic", arithmetic), ("structured", lambda t: an.answer(text(t), claims._claims(spark, sf))),
        ("semantic", lambda t: ro.semantic_answers(t, memory).select("qid", F.col("body").alias("answer"))), ("graph", graph),
    ]
    return re_.staged(_turns(spark, sf), steps, NOT_KNOWN)


@query(f"SELECT route, count(*) AS turns FROM ({_sql()}) GROUP BY route")
def turn_routes(spark, sf):
    """How many turns each route takes."""
    return turn_pipeline(spark, sf).groupBy("route").agg(F.count(F.lit(1)).alias("turns"))
