"""Queries on words and sentences: articles, glosses, synonyms, morphemes, topics, frames, sections, pronouns, voice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hv import top_k
from ..operators import mine, words as wo
from .mining import _CASED, _FW, _TAG
from .registry import example, given, literal, query, sql_list, table

WORDS = given("w", "SELECT DISTINCT p_name AS word FROM part UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation", "part", "region", "nation")


@query(f"SELECT word, CASE WHEN lower(word) IN ({sql_list(wo.CONSONANT_SOUND)}) THEN 'a' WHEN lower(word) IN ({sql_list(wo.VOWEL_SOUND)}) THEN 'an' WHEN regexp_matches(lower(word), '^[aeiou]') THEN 'an' ELSE 'a' END AS article FROM {WORDS.sql}")
def articles(spark, sf):
    return WORDS.df(spark, sf).select("word", wo.article(F.col("word")).alias("article"))


GLOSSES = given("g", "SELECT doc_id AS id, text AS gloss FROM documents", "documents")


@query(r"SELECT id, CASE WHEN g = '' THEN '' WHEN f <> '' AND length(f) <= 240 THEN f WHEN length(g) > 240 THEN regexp_extract(left(g, 240), '(?s)^(.*) ', 1) || '...' WHEN g LIKE '%.' THEN g ELSE g || '.' END AS gloss FROM (SELECT id, trim(coalesce(gloss, '')) AS g, regexp_extract(trim(coalesce(gloss, '')), '(?s)^(.*?[.;])(?:\s|$)', 1) AS f FROM " + GLOSSES.sql + ")")
def trimmed_glosses(spark, sf):
    return GLOSSES.df(spark, sf).select("id", wo.trimmed_gloss(F.col("gloss")).alias("gloss"))


KINDS = given("r", "SELECT lower(r_name) AS word, 'hyponym' AS relation, lower(n_name) AS target, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT p_type, 'synonym', p_name, p_size FROM part", "nation", "region", "part")
RELATED = literal("r", "word string, relation string, target string, pos int", [("tree", "hyponym", f"kind{i:02}", i) for i in range(11)] + [("tree", "synonym", "plant", 1), ("approximately", "synonym", "about", 1), ("approximately", "synonym", "loosely", 2), ("approximately", "synonym", "odd", 3), ("immediately", "synonym", "now", 1), ("immediately", "synonym", "at once", 2), ("immediately", "synonym", "anon", 3), ("utilize", "synonym", "use", 1), ("numerous", "synonym", "many", 1), ("numerous", "synonym", "sundry", 2)])
ENTRIES = literal("e", "word string, pos string, tags string", [("approximately", "adv", None), ("about", "adv", None), ("loosely", "adv", None), ("odd", "adj", None), ("immediately", "adv", None), ("now", "noun", None), ("anon", "adv", "archaic"), ("numerous", "adj", None), ("many", "adj", None), ("sundry", "adj", "dated"), ("use", "verb", None)])
SWAPS = literal("s", "word string, before_number boolean", [])


@query(f"SELECT word, relation, string_agg(target, ', ' ORDER BY pos, target) FILTER (rn <= 8) || CASE WHEN count(*) > 8 THEN ' and ' || (count(*) - 8) || ' more' ELSE '' END AS listed FROM (SELECT *, row_number() OVER (PARTITION BY word, relation ORDER BY pos, target) AS rn FROM {KINDS.sql}) GROUP BY 1, 2")
def relation_lists(spark, sf):
    return wo.relation_lists(KINDS.df(spark, sf))


_SWAPPED = [("approximately", 0), ("approximately", 1), ("immediately", 0), ("numerous", 0), ("utilize", 0), ("slowly", 0)]


@example(f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {n} = 1)" for w, n in _SWAPPED)}) AS w(word, before_number)), p AS (SELECT word, list(DISTINCT pos) AS own FROM {ENTRIES.sql} GROUP BY 1), t AS (SELECT word AS target, list(DISTINCT pos) AS theirs, bool_or(regexp_matches(coalesce(tags, ''), '{wo.BAD_TAGS}')) AS bad FROM {ENTRIES.sql} GROUP BY 1)
SELECT w.word, w.before_number, arg_min(r.target, (length(r.target), r.target)) AS simpler FROM w JOIN {RELATED.sql} ON r.word = w.word AND relation = 'synonym' JOIN t ON t.target = r.target LEFT JOIN p ON p.word = w.word
WHERE length(w.word) >= 8 AND (w.word LIKE '%ly' OR w.word IN ({sql_list(wo.SAFE_SWAPS)})) AND regexp_matches(r.target, '^[a-z]+$') AND length(r.target) >= 3 AND length(r.target) <= length(w.word) - 3 AND (NOT before_number OR r.target IN ({sql_list(wo.APPROXIMATORS)})) AND NOT bad AND (own IS NULL OR len(list_intersect(own, theirs)) > 0) GROUP BY 1, 2""")
def simpler_synonyms(spark, sf):
    w = spark.createDataFrame([(w, n == 1) for w, n in _SWAPPED], "word string, before_number boolean")
    return wo.simpler_synonyms(w, RELATED.df(spark, sf), ENTRIES.df(spark, sf))


@query("SELECT DISTINCT lower(n_name) AS word, v.w AS inner FROM nation, (SELECT unnest(['nat', 'nation', 'ion', 'ation_1', 'on_2', 'io', 'other']) AS w) v WHERE contains(lower(n_name), v.w) AND length(v.w) >= 3 AND lower(n_name) <> v.w")
def sub_words(spark, sf):
    v = spark.createDataFrame([(x,) for x in ("nat", "nation", "ion", "ation_1", "on_2", "io", "other")], "word string")
    return wo.sub_words(table(spark, sf, "nation").select(F.col("n_name").alias("word")), v)


@query()
def morphemes(spark, sf):
    """The parts of the words of the benchmark. Without SQL; tested on words with known parts."""
    w = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(tx.lower_tokens(F.col("text")))).alias("word")).distinct()
    return w.select("word", wo.morphemes(F.col("word"), ["run", "walk", "happy", "bear", "bake", "try", "play", "care"]).alias("m")).select("word", "m.root", F.array_join("m.prefixes", "+").alias("prefixes"), F.array_join("m.suffixes", "+").alias("suffixes"))


ASKED = given("q", "SELECT conv_id * 1000 + turn AS id, text AS s FROM conversations WHERE role = 'user'", "conversations")
_STOP = sql_list(tx.QUESTION_STOPWORDS)


@query(rf"""WITH t AS (SELECT id, regexp_extract_all(s, '[''"]([^''"]{{3,40}})[''"]', 1) AS a, list_transform(regexp_extract_all(s, '[A-Z][\w-]*(?: [A-Z][\w-]*)*'), lambda r: array_to_string(list_filter(string_split(r, ' '), lambda w: lower(w) NOT IN ({_STOP})), ' ')) AS b,
  list_filter([regexp_extract(regexp_replace(s, '[ ?.!]+$', ''), '\b(?:of|about|for) (?:the )?([a-zA-Z][a-zA-Z -]{{2,30}})$', 1)], lambda x: x <> '') AS c, list_filter(regexp_extract_all(lower(s), '[a-z0-9-]+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP})) AS d FROM {ASKED.sql}),
u AS (SELECT id, list_filter(list_concat(a, b, c, list_transform(list_sort(list_transform(range(1, len(d) + 1), lambda i: {{'n': -length(d[i]), 'i': i, 'w': d[i]}})), lambda x: x.w)), lambda t: length(t) > 2 AND lower(t) NOT IN ({_STOP})) AS x FROM t),
v AS (SELECT id, unnest(x) AS topic, generate_subscripts(x, 1) AS i FROM u), f AS (SELECT id, topic, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS place FROM v GROUP BY 1, 2) SELECT id, topic, place FROM f WHERE place <= 3""")
def question_topics(spark, sf):
    t = ASKED.df(spark, sf).select("id", F.posexplode(wo.topics(F.col("s"))).alias("p", "topic"))
    return t.select("id", "topic", (F.col("p") + 1).cast("long").alias("place"))


@query()
def stitched_turns(spark, sf):
    """Turns with neighbouring sentences of one subject joined. Without SQL; tested against a loop."""
    return table(spark, sf, "conversations").select("conv_id", "turn", wo.stitched(F.col("text")).alias("text"))


OPENERS = {"high": ["", "Sure: "], "med": ["I think, ", "As I recall, "], "low": ["Not sure, but "], "followup": ["And ", "Also, "], "sad": ["Sorry to hear that. "], "excited": ["Nice, ", "Great — "]}
BODIES = given("b", "SELECT conv_id * 1000 + turn AS id, text AS body, CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS band, CASE conv_id % 5 WHEN 0 THEN 'sad' WHEN 1 THEN 'excited' END AS emotion, turn > 2 AS followup FROM conversations WHERE role = 'assistant'", "conversations")


def _pick(kind: str) -> str:
    own = OPENERS[kind]
    return f"[{', '.join(repr(x) for x in own)}][('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 6))::INT % {len(own)} + 1]"


@query(f"""WITH b AS (SELECT * FROM {BODIES.sql}),
e AS (SELECT *, coalesce(CASE emotion WHEN 'sad' THEN {_pick('sad')} WHEN 'excited' THEN {_pick('excited')} END, '') AS feel FROM b), f AS (SELECT id, trim(body) AS b, feel || CASE WHEN followup THEN {_pick('followup')} ELSE '' END || CASE WHEN feel = '' THEN coalesce(CASE band WHEN 'high' THEN {_pick('high')} WHEN 'med' THEN {_pick('med')} WHEN 'low' THEN {_pick('low')} END, '') ELSE '' END AS front FROM e)
SELECT id, CASE WHEN b = '' THEN b WHEN regexp_matches(front, '[,\\x{{2014}}] ?$') AND regexp_matches(b, '^\\p{{Lu}}') AND NOT regexp_matches(b, '^\\S+ \\p{{Lu}}') THEN front || lower(left(b, 1)) || substr(b, 2) ELSE front || b END AS said FROM f""")
def voiced_answers(spark, sf):
    return BODIES.df(spark, sf).select("id", wo.voiced(F.col("body"), F.col("band"), F.col("emotion"), F.col("followup"), F.col("id"), OPENERS).alias("said"))


STORY = [(1, "The bear found a lamp in the forest."), (2, "The bear and the frog played near the river!"), (3, "On the hill the fox saw a star."), (4, "Where does the duck swim?"), (5, "The lamp is bright."), (6, "Take the lamp to the girl"), (7, ""), (8, "Yesterday it rained.")]
_FRAMES = {
    1: {"_intent": "statement", "agent": "bear", "action": "found", "patient": "lamp", "location": "forest"}, 2: {"_intent": "exclamation", "agent": "bear and frog", "action": "played", "location": "river"},
    3: {"_intent": "command", "location": "hill", "agent": "fox", "action": "saw", "patient": "star"}, 4: {"_intent": "question", "question": "where", "agent": "duck", "action": "swim"},
    5: {"_intent": "statement", "agent": "lamp", "action": "is", "attribute": "bright"}, 6: {"_intent": "command", "agent": "take", "action": "the", "patient": "lamp", "goal": "girl"}, 7: {"_intent": "empty"},
    8: {"_intent": "statement", "time": "yesterday", "agent": "it", "action": "rained"},
}
_FRAME_ROWS = ", ".join(f"({i}, '{r}', '{v}')" for i, own in _FRAMES.items() for r, v in own.items())


def _story(spark, sf):
    return wo.frames(spark.createDataFrame(STORY, "id int, text string"), "text")


@example(f"SELECT * FROM (VALUES {_FRAME_ROWS}) AS f(id, role, value)")
def event_frames_of_sentences(spark, sf):
    """The roles of sentences, against what they must be."""
    return _story(spark, sf).select("id", F.explode("frame").alias("role", "value"))


@example(f"SELECT id, role, CASE WHEN role = 'agent' THEN replace(value, 'bear', 'cat') ELSE value END AS value FROM (VALUES {_FRAME_ROWS}) AS f(id, role, value)")
def substituted_frames_of_sentences(spark, sf):
    return _story(spark, sf).select("id", F.explode(wo.substituted(F.col("frame"), F.lit("agent"), F.lit("Bear"), F.lit("cat"))).alias("role", "value"))


@example(f"SELECT id FROM (VALUES {_FRAME_ROWS}) AS f(id, role, value) WHERE role = 'agent' AND value = 'bear'")
def frames_by_role_of_sentences(spark, sf):
    return _story(spark, sf).where(F.lower(F.col("frame")["agent"]) == "bear").select("id")


@example(f"SELECT DISTINCT id FROM (VALUES {_FRAME_ROWS}) AS f(id, role, value) WHERE role IN ('agent', 'patient', 'goal', 'location', 'attribute') AND contains(value, 'lamp') ORDER BY id LIMIT 4")
def recalled_frames_of_sentences(spark, sf):
    """The first four frames that a word stands in."""
    return wo.recalled(_story(spark, sf).withColumn("qid", F.lit(1)), F.lit("lamp")).select("id")


def _turn_frames(spark, sf):
    return wo.frames(table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "text")


@query()
def event_frames(spark, sf):
    """The roles of user turns. Without SQL; sentences with known roles are among the examples."""
    return _turn_frames(spark, sf).select("id", F.explode("frame").alias("role", "value"))


@query()
def substituted_frames(spark, sf):
    """Who acts becomes another. Without SQL, as above."""
    return _turn_frames(spark, sf).select("id", F.explode(wo.substituted(F.col("frame"), F.lit("agent"), F.lit("the"), F.lit("a"))).alias("role", "value"))


@query()
def frames_by_role(spark, sf):
    """Turns in which something has a place. Without SQL, as above."""
    return _turn_frames(spark, sf).where(F.col("frame")["location"].isNotNull()).select("id", F.col("frame")["location"].alias("location"))


@query()
def recalled_frames(spark, sf):
    """The first four frames that the word "the" stands in. Without SQL, as above."""
    return wo.recalled(_turn_frames(spark, sf).withColumn("qid", F.lit(1)), F.lit("th")).select("id")


NOTES = given("n", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'intro line' || chr(10) || '## ' || source || chr(10) || '# a comment' || chr(10) || text || chr(10) || 'User: how long?' || chr(10) || 'Reply: ' || lang || chr(10) || '## Empty' || chr(10) || '## Last one' || chr(10) || 'User: hi' || chr(10) || 'Reply: hello' || chr(10) || 'Reply: again' ELSE text END AS text FROM documents", "documents")


@query(r"""WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM """ + NOTES.sql + r"""), s AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS n FROM l)
SELECT id, CAST(n AS BIGINT) AS n, max(CASE WHEN starts_with(line, '## ') THEN trim(substr(line, 4)) END) AS title, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT starts_with(line, '#')), '') AS body FROM s WHERE n > 0 GROUP BY 1, 2""")
def markdown_sections(spark, sf):
    """Sections by their ## titles, in order, without comment lines."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col("text")), "\n## "), 2, 1_000_000)
    s = NOTES.df(spark, sf).where("text is not null").select("id", F.posexplode(parts).alias("n", "s"))
    lines = F.split("s", "\n")
    body = F.array_join(F.filter(F.slice(lines, 2, 1_000_000), lambda x: ~F.startswith(x, F.lit("#"))), "\n")
    return s.select("id", (F.col("n") + 1).cast("long").alias("n"), F.trim(lines[0]).alias("title"), body.alias("body"))


@query(r"""WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM """ + NOTES.sql + r"""), p AS (SELECT *, lead(line) OVER (PARTITION BY id ORDER BY i) AS next FROM l)
SELECT id, i AS line, trim(substr(line, 6)) AS question, trim(substr(next, 7)) AS answer FROM p WHERE starts_with(line, 'User:') AND starts_with(next, 'Reply:')""")
def markdown_exchanges(spark, sf):
    """Questions and the answers on the line after."""
    lines = F.split("text", "\n")
    both = F.transform(lines, lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("a"), F.get(lines, i + 1).alias("b")))
    e = NOTES.df(spark, sf).where("text is not null").select("id", F.inline(F.filter(both, lambda x: F.startswith(x["a"], F.lit("User:")) & F.startswith(x["b"], F.lit("Reply:")))))
    return e.select("id", "line", F.trim(F.substring("a", 6, 1000)).alias("question"), F.trim(F.substring("b", 7, 1000)).alias("answer"))


_NAME = r"(?:^|[^.!?\s]\s+)([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})"
TALK = given("t", "SELECT conv_id, turn, text FROM conversations", "conversations")


@query(rf"""WITH o AS (SELECT *, list_filter(regexp_extract_all(text, '{_NAME}', 1), lambda x: lower(x) NOT IN ({_STOP})) AS n FROM {TALK.sql}), p AS (SELECT *, CASE WHEN len(n) > 0 THEN n[-1] END AS own FROM o), b AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT conv_id, turn, CASE WHEN own IS NULL AND before IS NOT NULL AND regexp_matches(text, '(?i)\b(?:he|she|it|they)\b') THEN regexp_replace(text, '(?i)\b(?:he|she|it|they)\b', before) ELSE text END AS resolved FROM b""")
def resolved_pronouns(spark, sf):
    return wo.with_antecedents(TALK.df(spark, sf)).select("conv_id", "turn", "resolved")


# --- mining that has its own rows for each match ----------------------------------

_WIN = " UNION ALL ".join(f"SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) AS w FROM (SELECT {_CASED} AS w FROM benchmark) WHERE len(w) >= {n}" for n in range(4, 7))
_PATTERN = f"""WITH w AS ({_WIN}), c AS (SELECT w, list_filter(w, lambda x: NOT list_contains({_FW}, lower(x))) AS own FROM w),
p AS (SELECT array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({_FW}, lower(x)) THEN lower(x) ELSE '<C>' END), ' ') AS pattern, own[1] AS s, own[-1] AS o FROM c WHERE len(own) >= 2 AND len(own) < len(w)),
r AS (SELECT pattern, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, pattern) AS relation FROM p GROUP BY 1 HAVING count(*) >= 3)"""


@query(f"{_PATTERN} SELECT relation, s, o, count(*) AS n FROM p JOIN r USING (pattern) GROUP BY 1, 2, 3")
def pattern_triples(spark, sf):
    """First and last content word of each instance of a recurring pattern; patterns are numbered by their frequency."""
    return mine.pattern_triples(table(spark, sf, "benchmark"), tx.tokens(F.col("text")))


@query(f"WITH t AS (SELECT array_to_string({_TAG}, ' ') AS pattern, len(list_filter({_TAG}, lambda x: x = 'ENTITY')) AS e FROM (SELECT {_CASED} AS c FROM conversations)) SELECT pattern, count(*) AS n FROM t WHERE e >= 2 GROUP BY 1 HAVING count(*) >= 2")
def typed_sentences(spark, sf):
    """Whole turns that have the same types, two entities among them."""
    t = mine.typed(table(spark, sf, "conversations"), tx.tokens(F.col("text")))
    two = F.size(F.filter("t", lambda x: x == "ENTITY")) >= 2
    return t.where(two).groupBy(F.array_join("t", " ").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(rf"""WITH s AS (SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({_FW}, lower(x)) THEN lower(x) ELSE '<C>' END), ' ') AS structure FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_-]+') AS w FROM conversations))
SELECT structure, count(*) AS n, min((conv_id, turn)).conv_id AS conv_id, min((conv_id, turn)).turn AS turn FROM (SELECT conv_id, turn, structure FROM s) x(conv_id, turn, structure) GROUP BY 1 HAVING count(*) >= 2""".replace("min((conv_id, turn)).conv_id", "arg_min(conv_id, (conv_id, turn))").replace("min((conv_id, turn)).turn", "arg_min(turn, (conv_id, turn))"))
def structure_clusters(spark, sf):
    """Turns of one structure (content words as <C>), with the first of each: clusters that don't depend on order."""
    w = mine.held(table(spark, sf, "conversations"), ["conv_id", "turn"], w=tx.tokens(F.col("text")))
    shape = F.array_join(F.transform("w", lambda x: F.when(F.lower(x).isin(tx.FUNCTION_WORDS), F.lower(x)).otherwise("<C>")), " ")
    g = w.groupBy(shape.alias("structure")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "turn")).alias("first")).where("n >= 2")
    return g.select("structure", "n", "first.conv_id", "first.turn")


@query(r"""WITH c AS (SELECT substr(w, i::INT, 2) AS context, substr(w, i::INT + 2, 1) AS next FROM (SELECT w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark))), n AS (SELECT context, next, count(*) AS n FROM c GROUP BY 1, 2)
SELECT context, next, round(n / s, 6) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY context) AS s, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS rn FROM n) WHERE rn <= 5""")
def next_letters(spark, sf):
    """The five likeliest letters after each two letters of a word."""
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    g = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("g"))
    n = g.groupBy(F.left("g", F.lit(2)).alias("context"), F.right("g", F.lit(1)).alias("next")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("context").agg(F.sum("n").alias("s"))
    best = top_k(n, ["context"], [F.desc("n"), F.col("next")], 5)
    return best.join(total, "context").select("context", "next", F.round(F.col("n") / F.col("s"), 6).alias("p"))


@query("""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), p AS (SELECT line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
n AS (SELECT line, next, count(*) AS n FROM p WHERE next IS NOT NULL AND trim(line) <> '' GROUP BY 1, 2) SELECT line, arg_min(next, (-n, next)) AS next, max(n) AS n, CAST(sum(n) AS BIGINT) AS seen FROM n GROUP BY 1 HAVING sum(n) >= 2""")
def next_lines(spark, sf):
    """The likeliest line after each line that goes on twice or more: pairs of lines as partial counts."""
    lines = table(spark, sf, "documents").select(F.explode(F.array(F.split("text", "\n"))).alias("x"))
    pairs = lines.select(F.inline(F.transform("x", lambda a, i: F.struct(a.alias("line"), F.get("x", i + 1).alias("next"))))).where("next is not null and trim(line) <> ''")
    n = pairs.groupBy("line", "next").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("line").agg(F.min_by("next", F.struct(-F.col("n"), F.col("next"))).alias("next"), F.max("n").alias("n"), F.sum("n").alias("seen")).where("seen >= 2")


def _beams_sql(steps: int, width: int) -> str:
    tok = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+')"
    out = f"""WITH g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM (SELECT {tok} AS w FROM benchmark)), n AS (SELECT g[1] AS context, g[2] AS next, count(*) AS n FROM g GROUP BY 1, 2),
t AS (SELECT context, next, round(ln(n / sum(n) OVER (PARTITION BY context)), 6) AS lp FROM n), b0 AS (SELECT item_id AS qid, [{tok}[1]] AS w, 0.0::DOUBLE AS score FROM benchmark)"""
    for k in range(steps):
        score = "round(score + lp - 0.510826 * len(list_filter(w, lambda x: x = next)), 6)"
        out += f", c{k} AS (SELECT qid, list_append(w, next) AS w, {score} AS score FROM b{k} JOIN t ON t.context = w[-1]), b{k + 1} AS (SELECT qid, w, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, array_to_string(w, ' ')) AS rn FROM c{k}) WHERE rn <= {width})"
    return out + f" SELECT qid, array_to_string(w, ' ') AS text, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, array_to_string(w, ' ')) AS rn FROM b{steps}) WHERE rn = 1"


@query(_beams_sql(4, 4))
def generated_texts(spark, sf):
    """Each benchmark text's first word gone on with for four words: by bigrams, four beams, words that are there already cost 0.6 each time."""
    b = table(spark, sf, "benchmark")
    words = tx.lower_tokens(F.col("text"))
    return mine.generated(mine.transitions(b, words, 1), b.select(F.col("item_id").alias("qid"), F.get(words, F.lit(0)).alias("start")), 4, 4)
