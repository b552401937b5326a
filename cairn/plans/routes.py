"""Queries of the answering routes: semantic answers and their gates, injection, domains, forgetting, procedures, stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hv import top_k
from ..operators import route as ro
from .registry import given, query, sql_list, table

#: The documents as a memory: sources of a kind each, named by the first words of the text.
MEMORY = given("m", "SELECT doc_id AS id, CASE doc_id % 11 WHEN 3 THEN 'How to ' || source || ', step ' || CAST(doc_id % 7 + 1 AS STRING) || ': ' || replace(text, chr(10), ' ') ELSE text END AS text, CASE doc_id % 11 WHEN 0 THEN 'user_msg' WHEN 1 THEN 'directive:' || source WHEN 2 THEN 'story:' || source WHEN 3 THEN 'wikihow:' || source ELSE 'wikipedia:' || translate(substr(text, 1, 30), ' ', '_') END AS source FROM documents", "documents")
#: The user turns as questions, some with the words that routes go by, and what the benchmark asks.
QUESTIONS = given("q", "SELECT conv_id * 1000 + turn AS qid, CASE conv_id % 7 WHEN 0 THEN 'How to ' || text WHEN 1 THEN 'how many ' || text WHEN 2 THEN 'forget that ' || text WHEN 3 THEN 'tell that story again ' || text ELSE text END AS question FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - item_id, 'what is ' || text FROM benchmark UNION ALL SELECT -1000000 - doc_id, 'How to ' || source || '?' FROM documents WHERE doc_id % 100 = 0", "conversations", "benchmark", "documents")

_STOP = sql_list(tx.QUESTION_STOPWORDS)


def _focus(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9'']+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})))"


_ECHO = "regexp_matches(coalesce(source, ''), '^(user_msg|agent_response|conversation_turn|image:|video:)')"
_ASKED = "NOT (" + " OR ".join(f"regexp_matches(lower(question), '{p}')" for p in ro.COMPUTED) + ")"
_CANDIDATES = f"""m AS (SELECT * FROM {MEMORY.sql}), q AS (SELECT * FROM {QUESTIONS.sql}), fm AS MATERIALIZED (SELECT id, {_focus('text')} AS f FROM m), fq AS MATERIALIZED (SELECT qid, {_focus('question')} AS f FROM q), mw AS MATERIALIZED (SELECT id, unnest(f) AS word, len(f) AS m FROM fm),
c AS (SELECT qid, id, round(count(*) / sqrt(any_value(n) * any_value(m)), 6) AS sim FROM (SELECT qid, unnest(f) AS word, len(f) AS n FROM fq) JOIN mw USING (word) GROUP BY 1, 2),
h AS (SELECT qid, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM c) WHERE rn <= 48)"""
_COHORT = f"""{_CANDIDATES}, k AS (SELECT * FROM (SELECT h.*, text, source, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM h JOIN m USING (id) WHERE NOT {_ECHO}) WHERE rn <= 14),
co AS (SELECT qid, id, text, source, sim FROM (SELECT *, max(sim) OVER (PARTITION BY qid) AS best FROM k) WHERE best >= {ro.FLOOR} AND sim >= greatest(0.8 * {ro.FLOOR}, 0.7 * best))"""
_NUMERIC = f"nu AS (SELECT co.* FROM co JOIN q USING (qid) WHERE {_ASKED} AND (NOT regexp_matches(lower(question), '\\bhow many\\b') OR regexp_matches(text, '{ro.NUMERIC}')))"
_RARE = f"ra AS (SELECT qid, word FROM (SELECT qid, unnest({_focus('question')}) AS word FROM q) LEFT JOIN (SELECT word, count(*) AS df FROM mw GROUP BY 1) USING (word) WHERE length(word) >= 4 AND coalesce(df, 0) <= (SELECT greatest(3, count(*) // 500) FROM m))"
_NAMED = "na AS (SELECT * FROM nu WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.qid = nu.qid AND NOT contains(lower(nu.text), left(ra.word, 5))))"
_ALIGNED = f"""al AS (SELECT na.qid, na.id, any_value(na.text) AS text, any_value(na.source) AS source, any_value(na.sim) AS sim, round(avg(s), 6) AS mean, round(min(s), 6) AS least FROM na JOIN (
  SELECT n.qid, n.id, f.word, list_max(list_transform(list_distinct(regexp_extract_all(lower(n.text), '[a-z0-9'']+')), lambda x: 1 - levenshtein(f.word, x) / greatest(length(f.word), length(x)))) AS s FROM na n JOIN (SELECT qid, unnest({_focus('question')}) AS word FROM q) f USING (qid)) USING (qid, id) GROUP BY 1, 2)"""
_RANKED = f"""re AS (SELECT al.*, question, round(sim + 0.35 * mean + CASE WHEN NOT regexp_matches(lower(question), '\\bhow many\\b') AND len(list_filter({_focus('question')}, lambda w: length(w) >= 4 AND starts_with(regexp_replace(lower(regexp_extract(text, '^\\s*(\\S+)', 1)), '[^a-z0-9'']', '', 'g'), left(w, 5)))) > 0 THEN 0.35 ELSE 0 END
  - CASE WHEN regexp_matches(lower(question), '\\bhow many\\b') AND regexp_matches(lower(text), '{ro.HEDGES}') THEN 0.2 ELSE 0 END, 6) AS score FROM al JOIN q USING (qid))"""
_BEST = f"""be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sim DESC, id) AS rn FROM re) WHERE rn = 1),
go AS (SELECT * FROM be WHERE sim >= 0.7 OR least >= CASE WHEN regexp_matches(lower(question), '{ro.PROCEDURE}') THEN 0.55 WHEN regexp_matches(lower(question), '{ro.ROLE}') THEN 0.5 ELSE 0.42 END)"""
_UPTO = {"cohort": _COHORT, "named": f"{_COHORT}, {_NUMERIC}, {_RARE}, {_NAMED}"}
_UPTO["ranked"] = f"{_UPTO['named']}, {_ALIGNED}, {_RANKED}"
_UPTO["good"] = f"{_UPTO['ranked']}, {_BEST}"


def _simple(s: str) -> str:
    pron, bar = ro.TOPIC_PRONOUN, ro.DANGLERS
    x = f"CASE WHEN regexp_matches(trim({s}), '^(.{{2,48}}?):\\s+(Its|Their|His|Her)\\b') THEN regexp_replace(trim({s}), '{pron}', '\\1''s') ELSE regexp_replace(trim({s}), '{pron}', '\\1') END"
    for _ in range(2):
        x = rf"regexp_replace({x}, '\s*\([^()]*\)', '', 'g')"
    x = rf"regexp_replace({x}, '^([^,]{{2,60}}), (?:officially|also known as|formally) [^,]{{2,80}}, (is|was|are|were)\b', '\1 \2')"
    x = rf"regexp_replace(trim(regexp_replace(regexp_replace({x}, '\s+([,.;:])', '\1', 'g'), '\s{{2,}}', ' ', 'g')), '^[,;:\s]+', '')"
    return rf"""(SELECT CASE WHEN regexp_matches(d, '[.!?]$') OR d = '' THEN d ELSE d || '.' END FROM (SELECT regexp_replace(CASE WHEN length(x) > 230 THEN regexp_replace(CASE WHEN regexp_extract(left(x, 230), '(?s)^(.{{101,}}),', 1) <> '' THEN regexp_extract(left(x, 230), '(?s)^(.{{101,}}),', 1) ELSE regexp_extract(left(x, 230), '(?s)^(.*) ', 1) END, '(?i)(?:\s+(?:{bar}|\w+ing))+$', '') || '.' ELSE x END, '(?i)\s+(?:{bar})\s*[.]?$', '') AS d FROM (SELECT {x} AS x)))"""


FACTS = given("f", "SELECT item_id AS id, CASE item_id % 4 WHEN 0 THEN 'Bolivia: It is ' || text WHEN 1 THEN 'Bolivia: Its capital (seat (old)) is  high , and ' || text WHEN 2 THEN 'Norland, officially the Republic of Norland, is a country in the' ELSE text END AS s FROM benchmark", "benchmark")


@query(f"SELECT id, {_simple('s')} AS plain FROM {FACTS.sql}")
def simplified_facts(spark, sf):
    return FACTS.df(spark, sf).select("id", ro.simplified(F.col("s")).alias("plain"))


def _q(spark, sf):
    return QUESTIONS.df(spark, sf)


@query(f"SELECT qid, {_ASKED.replace('NOT (', '(', 1)} AS computed, regexp_matches(lower(question), '\\bhow many\\b') AS counts FROM {QUESTIONS.sql}")
def shape_gates(spark, sf):
    """Which questions must be computed, and which ask for a number."""
    return _q(spark, sf).select("qid", ro.computed(F.col("question")).alias("computed"), ro.counts(F.col("question")).alias("counts"))


@query(f"WITH {_UPTO['cohort']} SELECT qid, id, sim FROM co")
def question_cohort(spark, sf):
    m = MEMORY.df(spark, sf)
    return ro.cohort(ro.candidates(_q(spark, sf), ro.word_index(m), least=ro.NEAR), m)


def _named(spark, sf):
    return ro.named(_q(spark, sf).where(~ro.computed(F.col("question"))), MEMORY.df(spark, sf))


@query(f"WITH {_UPTO['named']} SELECT qid, id FROM na")
def entity_mention_filter(spark, sf):
    """Hits that name all that a question names, with a number where it asks for one."""
    return _named(spark, sf).select("qid", "id")


@query(f"WITH {_UPTO['ranked']} SELECT qid, id, mean, least, score FROM re")
def focus_alignment_rerank(spark, sf):
    return ro.reranked(ro.alignment(_named(spark, sf))).select("qid", "id", "mean", "least", "score")


@query(f"WITH {_UPTO['good']} SELECT qid, id FROM go")
def coverage_gate(spark, sf):
    """The best row of each question where it covers all that is asked."""
    return ro.best_named(_q(spark, sf).where(~ro.computed(F.col("question"))), MEMORY.df(spark, sf)).select("qid", "id")


_NEG = f"(regexp_matches(lower(question), '{ro.NEGATIVE.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(lower(text), '{ro.NEGATIVE.replace(chr(39), chr(39) * 2)}'))"


@query(f"WITH {_UPTO['good']} SELECT qid, id, score, CASE WHEN NOT {_NEG} AND sim >= {ro.SURE} THEN 'high' ELSE 'med' END AS band, CASE WHEN {_NEG} THEN 'Asked for a negative, what is held is the positive: ' ELSE '' END || {_simple('text')} AS body FROM go")
def semantic_answers(spark, sf):
    return ro.semantic_answers(_q(spark, sf), MEMORY.df(spark, sf))


_TITLE = f"list_distinct(list_filter(regexp_extract_all(lower(split_part(source, ':', 2)), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


@query(f"SELECT DISTINCT qid, id FROM (SELECT qid, unnest({_focus('question')}) AS word FROM {QUESTIONS.sql}) JOIN (SELECT id, unnest({_TITLE}) AS word FROM {MEMORY.sql} WHERE starts_with(source, 'wikipedia:')) USING (word)")
def title_injection(spark, sf):
    return ro.title_injected(_q(spark, sf), MEMORY.df(spark, sf))


@query(f"SELECT conv_id, turn, regexp_matches(text, '{ro.NUMERIC}') AS numeric, len(regexp_extract_all(text, '{ro.NUMERIC}')) AS n FROM conversations WHERE text IS NOT NULL")
def numeric_evidence(spark, sf):
    """Which turns tell a number, in digits or words, and how many."""
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").rlike(ro.NUMERIC).alias("numeric"), F.size(F.regexp_extract_all("text", F.lit(ro.NUMERIC), F.lit(0))).cast("long").alias("n"))


_OVERLAP = "len(list_intersect({0}, {1})) > 0"


@query(f"""WITH {_CANDIDATES}, t AS (SELECT id, source, CASE WHEN strpos(source, ':') > 0 THEN {_TITLE} ELSE list_distinct(list_filter(regexp_extract_all(lower(source), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) END AS title, {_focus('text')} AS w FROM m), n AS (SELECT *, {_OVERLAP.format('title', 'w')} AS names FROM t),
r AS (SELECT h.qid, h.id, row_number() OVER (PARTITION BY h.qid ORDER BY sim DESC, h.id) AS rank, source, title, names, {_focus('question')} AS f FROM h JOIN n ON n.id = h.id JOIN q ON q.qid = h.qid),
p AS (SELECT qid, id AS top, source, len(title) > 0 AND NOT names AND NOT {_OVERLAP.format('title', 'f')} AS weak FROM r WHERE rank = 1), a AS (SELECT qid, source, arg_min(id, rank) AS near FROM r WHERE rank BETWEEN 2 AND 20 AND names GROUP BY 1, 2), f AS (SELECT source, min(id) AS first FROM n WHERE names GROUP BY 1)
SELECT p.qid, CASE WHEN weak THEN coalesce(near, first, top) ELSE top END AS id, weak AND coalesce(near, first) IS NOT NULL AS swapped FROM p LEFT JOIN a ON a.qid = p.qid AND a.source = p.source LEFT JOIN f ON f.source = p.source""")
def intro_swap(spark, sf):
    m, q = MEMORY.df(spark, sf), _q(spark, sf)
    ranked = top_k(ro.candidates(q, ro.word_index(m), 20), ["qid"], [F.desc("sim"), F.col("id")], 20)
    return ro.intro_swapped(ranked, q, m)


@query(f"""WITH {_CANDIDATES}, d AS (SELECT * FROM m WHERE starts_with(source, 'directive:')), b AS (SELECT qid, id, sim FROM (SELECT h.*, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM h SEMI JOIN d ON d.id = h.id WHERE sim >= 0.8) WHERE rn = 1),
k AS (SELECT qid, id, any_value(n) AS n, count(*) AS k FROM (SELECT qid, unnest({_focus('question')}) AS word FROM q WHERE qid NOT IN (SELECT qid FROM b)) JOIN (SELECT id, len(regexp_split_to_array(trim(text), '\\s+')) AS n, unnest({_focus('text')}) AS word FROM d) USING (word) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT * FROM b UNION ALL SELECT qid, id, least(0.55, round(0.25 + 0.05 * k, 6)) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(k / sqrt(n), 6) DESC, id) AS rn FROM k) WHERE rn = 1""")
def domain_filtered(spark, sf):
    """Answers from one domain's sources only, with a fallback on shared words (floor 0.8, so that it is used)."""
    m, q = MEMORY.df(spark, sf), _q(spark, sf)
    return ro.domain_answers(q, ro.candidates(q, ro.word_index(m), least=0.8), m, ["directive:"], 0.8)


ENTITIES = given("e", "SELECT n_name AS name FROM nation", "nation")
_NAMES = f"list_filter(regexp_extract_all(question, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda x: lower(x) NOT IN ({_STOP}))"
_PARTS = "list_concat([lower({0})], string_split(lower({0}), ' '))"


@query(f"""WITH {_CANDIDATES}, b AS (SELECT qid, max(sim) AS sim, qid % 2 = 1 AS facts FROM h GROUP BY qid), p AS (SELECT qid, unnest({_NAMES}) AS name FROM q), kn AS (SELECT DISTINCT unnest({_PARTS.format('name')}) AS k FROM {ENTITIES.sql}),
a AS (SELECT DISTINCT qid FROM (SELECT qid, unnest({_PARTS.format('name')}) AS k FROM p) JOIN kn USING (k)), s AS (SELECT DISTINCT qid FROM (SELECT qid, unnest({_focus('question')}) AS word FROM q) WHERE length(word) >= 4 AND regexp_matches(word, '^[a-z]+$') AND word NOT IN (SELECT word FROM mw))
SELECT qid, CASE WHEN (qid IN (SELECT qid FROM p) AND qid NOT IN (SELECT qid FROM a)) OR qid IN (SELECT qid FROM s) THEN least(x, 0.24) ELSE x END AS sim FROM (SELECT qid, CASE WHEN facts THEN greatest(sim, 0.65) ELSE sim END AS x FROM b)""")
def calibrated_answers(spark, sf):
    m, q = MEMORY.df(spark, sf), _q(spark, sf)
    index = ro.word_index(m)
    best = ro.candidates(q, index, 1).select("qid", "sim").withColumn("facts", F.col("qid") % 2 == 1)
    return ro.calibrated(best, q, index, ENTITIES.df(spark, sf))


@query(f"""WITH {_CANDIDATES}, {_RARE}, x AS (SELECT h.*, EXISTS (SELECT 1 FROM ra WHERE ra.qid = h.qid AND contains(lower(m.text), ra.word)) AS held, text, question FROM h JOIN m USING (id) JOIN q USING (qid))
SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM x WHERE sim >= CASE WHEN held THEN 0.32 ELSE 0.55 END AND (NOT regexp_matches(question, '\\d') OR len(list_intersect(regexp_extract_all(question, '\\d+'), regexp_extract_all(text, '\\d+'))) > 0)) WHERE rn <= 5 AND qid = 11""")
def semantic_forget(spark, sf):
    """What a command to forget takes away."""
    m, q = MEMORY.df(spark, sf), _q(spark, sf).where("question like 'forget%'")
    index = ro.word_index(m)
    return ro.to_forget(q, ro.candidates(q, index, least=0.32), m, index)


@query(rf"""WITH s AS (SELECT source, regexp_extract(text, '^How to (.+?), step (\d+): (.+)$', 1) AS title, TRY_CAST(nullif(regexp_extract(text, '^How to (.+?), step (\d+): (.+)$', 2), '') AS INT) AS n, regexp_extract(text, '^How to (.+?), step (\d+): (.+)$', 3) AS s FROM {MEMORY.sql} WHERE starts_with(source, 'wikihow:') AND regexp_matches(text, '^How to (.+?), step (\d+): (.+)$')),
t AS (SELECT source, min(title) AS title FROM s GROUP BY 1), q AS (SELECT qid, {_focus('question')} AS f FROM {QUESTIONS.sql} WHERE regexp_matches(lower(question), '^how (?:do|can|to)\b')),
b AS (SELECT qid, source, title, round(len(list_intersect(f, w)) / sqrt(len(f) * len(w)), 6) AS sim FROM q, (SELECT *, {_focus('title')} AS w FROM t)), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, source) AS rn FROM b WHERE sim >= 0.6) WHERE rn = 1)
SELECT qid, any_value(c.title) AS title, count(*) AS steps, string_agg(n || '. ' || CASE WHEN regexp_extract(s, '^(.*?[.!?])(?:\s|$)', 1) = '' THEN s ELSE regexp_extract(s, '^(.*?[.!?])(?:\s|$)', 1) END, ' ' ORDER BY n) AS body, greatest(count(*) - 5, 0) AS rest FROM c JOIN s USING (source) GROUP BY qid""")
def procedure_answers(spark, sf):
    return ro.procedures(_q(spark, sf), MEMORY.df(spark, sf))


@query(f"""WITH s AS (SELECT id, split_part(source, ':', 2) AS seed FROM {MEMORY.sql} WHERE starts_with(source, 'story:')), q AS (SELECT qid, lower(question) AS low FROM {QUESTIONS.sql} WHERE regexp_matches(lower(question), '\\b(again|you told|you made up|that story)\\b') AND contains(lower(question), 'story'))
SELECT qid, coalesce((SELECT max(id) FROM s WHERE list_contains(regexp_extract_all(low, '[a-z]+'), seed)), (SELECT max(id) FROM s)) AS id FROM q""")
def story_recall(spark, sf):
    return ro.told_story(_q(spark, sf), MEMORY.df(spark, sf))


@query(f"WITH {_UPTO['good']} SELECT qid, id, 'rank ' || rank || ' of ' || n || ': ' || source AS why FROM (SELECT qid, id, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sim DESC, id) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM re) WHERE rank <= 5")
def explained_ranks(spark, sf):
    """The five best of each question with their place and source."""
    from pyspark.sql import Window

    r = ro.reranked(ro.alignment(_named(spark, sf)))
    w = Window.partitionBy("qid")
    r = r.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("sim"), "id"))).where("rank <= 5")
    return r.select("qid", "id", F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(": "), "source").alias("why"))
