"""Queries on text: sentences, quality, classes, normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from .registry import example, given, query, sql_list, table

_SENT = r"""list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) > 0)"""
_T = r"""trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"""


def _count(t: str, what: str) -> str:
    return f"((length({t}) - length(replace({t}, '{what}', ''))) // {len(what)})"


_QUALITY = rf"""CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - (
  CASE WHEN regexp_matches(t, '^[-*•>#]') THEN 0.3 ELSE 0 END + CASE WHEN {" OR ".join(f"starts_with(lower(t), '{o.replace(chr(39), chr(39) * 2)}')" for o in tx.JUNK_OPENERS)} THEN 0.5 ELSE 0 END
  + CASE WHEN {_count("t", " - ")} >= 2 OR {_count("t", "•")} >= 2 THEN 0.3 ELSE 0 END + CASE WHEN {_count("t", "?")} >= 2 THEN 0.5 ELSE 0 END
  + CASE WHEN t LIKE '%?' THEN 0.6 ELSE 0 END + CASE WHEN len(regexp_extract_all(t, '(?i)\b(?:What is|How does|Why is)\b')) >= 2 THEN 0.5 ELSE 0 END
  + CASE WHEN length(regexp_replace(t, '[^{{}}\[\]()<>=/\\]', '', 'g')) / greatest(length(t), 1) > 0.05 THEN 0.2 ELSE 0 END
  + CASE WHEN regexp_matches(t, '^\p{{Ll}}') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(t, '\b1/c\d|\bE\s*=\s*m|\^\d') THEN 0.2 ELSE 0 END))) END"""


@query(f"SELECT doc_id, round(CAST({_QUALITY} AS DOUBLE), 6) AS score FROM (SELECT doc_id, text, {_T} AS t FROM documents)")
def doc_quality_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(tx.quality_score(F.col("text")), 6).alias("score"))


@query(f"SELECT lang, count(*) AS n, CAST(sum(CASE WHEN {_QUALITY} >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM (SELECT lang, text, {_T} AS t FROM documents) GROUP BY lang")
def doc_quality_filter(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((tx.quality_score(F.col("text")) >= 0.7).cast("long")).alias("good"))


_PREFIX = "CASE page_id % 8 WHEN 0 THEN 'wikipedia:' WHEN 1 THEN 'wisdom:' WHEN 2 THEN 'fred:' WHEN 3 THEN 'youtube:' WHEN 4 THEN 'reddit:' WHEN 5 THEN 'user_msg:' WHEN 6 THEN 'WIKI:' ELSE NULL END || url"


@query(f"""SELECT page_id, CASE WHEN s IS NULL OR s = '' THEN 0.4 WHEN regexp_matches(lower(s), '^(wiki|wikipedia):') THEN 1.0 WHEN lower(s) LIKE 'wisdom:%' THEN 0.9 WHEN lower(s) LIKE 'fred:%' THEN 0.85
  WHEN regexp_matches(lower(s), '^(github|youtube):') THEN 0.6 WHEN regexp_matches(lower(s), '^(reddit|web):') THEN 0.5 ELSE 0.4 END::DOUBLE AS reliability FROM (SELECT page_id, {_PREFIX} AS s FROM pages)""")
def source_reliability(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.source_quality(F.expr(_PREFIX)).alias("reliability"))


_SENTENCES = f"SELECT doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS pos FROM documents"
_GOOD = r"length(s) > 40 AND length(s) < 300 AND regexp_matches(s, '^\p{Lu}') AND regexp_matches(s, '[.!?]$') AND length(regexp_replace(s, '[^\p{L} ]', '', 'g')) >= length(s) * 0.8"


@query(f"SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN {_GOOD} THEN 1 ELSE 0 END) AS BIGINT) AS good, min(CASE WHEN {_GOOD} THEN s END) AS first FROM ({_SENTENCES}) GROUP BY doc_id")
def sentence_split_quality(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    good = tx.is_quality_sentence(F.col("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("long")).alias("good"), F.min(F.when(good, F.col("s"))).alias("first"))


@query(f"SELECT s AS sentence, min(doc_id) AS doc_id, count(*) AS n FROM ({_SENTENCES}) WHERE {_GOOD} GROUP BY s HAVING count(*) > 1")
def repeated_sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))
    return s.where(tx.is_quality_sentence(F.col("sentence"))).groupBy("sentence").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


_PRONOUNS = "(?i)^(it|its|they|their|he|she|his|her|this|these) "


@query(rf"""WITH f AS (SELECT doc_id, s, pos, first_value(regexp_extract(s, '^[\p{{L}}]+')) OVER (PARTITION BY doc_id ORDER BY pos) AS title FROM ({_SENTENCES}))
SELECT doc_id, pos - 1 AS pos, CASE WHEN regexp_matches(s, '{_PRONOUNS}') THEN title || ': ' || s ELSE s END AS sentence FROM f WHERE regexp_matches(s, '{_PRONOUNS}')""")
def title_anchor_sentences(spark, sf):
    """Sentences that begin with a pronoun, with the document's first word in front."""
    s = tx.sentences(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", F.regexp_extract(F.get(s, F.lit(0)), r"^[\p{L}]+", 0).alias("title"), F.posexplode(s).alias("pos", "s"))
    return rows.where(F.col("s").rlike(_PRONOUNS)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat("title", F.lit(": "), "s").alias("sentence"))


_STRIP = [(r"(?is)<(script|style|nav|header|footer)\b.*?</(script|style|nav|header|footer)>", " "), (r"(?s)<[^>]+>", " "), (r"&[a-zA-Z#0-9]+;", " "), (r"\s+", " ")]
_PROSE_SQL = "html"
for _p, _r in _STRIP:
    _PROSE_SQL = f"regexp_replace({_PROSE_SQL}, '{_p}', '{_r}', 'g')"


@query(rf"""WITH p AS (SELECT page_id, trim({_PROSE_SQL}) AS text FROM pages), s AS (SELECT page_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS pos FROM p),
g AS (SELECT page_id, s, min(pos) AS pos FROM s WHERE length(s) > 40 AND length(s) < 400 AND length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) >= 0.6 * length(s) GROUP BY page_id, s),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM g)
SELECT page_id, rn, s AS sentence FROM r WHERE rn <= 60""")
def html_to_prose(spark, sf):
    """Prose sentences of pages by tag stripping: 41 to 399 characters, three fifths letters, distinct, 60 of a page."""
    from ..functions.hv import top_k

    text = F.col("html")
    for p, r in _STRIP:
        text = F.regexp_replace(text, p, r)
    s = table(spark, sf, "pages").select("page_id", F.posexplode(tx.sentences(F.trim(text))).alias("pos", "sentence"))
    letters = F.length(F.regexp_replace("sentence", r"[^\p{L}]", ""))
    good = s.where((F.length("sentence") > 40) & (F.length("sentence") < 400) & (letters >= 0.6 * F.length("sentence")))
    return top_k(good.groupBy("page_id", "sentence").agg(F.min("pos").alias("pos")), ["page_id"], [F.col("pos")], 60).select("page_id", F.col("rank").cast("long").alias("rn"), "sentence")


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages""")
def url_parts(spark, sf):
    part = lambda p: F.parse_url("url", F.lit(p))
    return table(spark, sf, "pages").select("page_id", part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"))


def _case(rules, value="'{}'") -> str:
    return " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN {value.format(name)}" for name, p in rules)


@query(f"SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'general' {_case(tx.QUESTION_TYPES)} ELSE 'general' END AS qtype FROM conversations")
def question_type(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.question_type(F.col("text")).alias("qtype"))


_QUESTIONS = ["when was the bridge built?", "who painted the Mona Lisa", "where is Lake Como?", "how many bones are there?", "why does ice float", "how does a pump work?", "is it round?", "list some rivers", "what is a prime?", "hello there", ""]
_ANSWERS = ["It was built in 1932 by the state.", "Leonardo Da Vinci painted it.", "It lies in Italy near a city.", "There are 206 of them", "Ice floats because it is light", "It works by a piston", "yes", "Po, Arno, Adige; Tiber", "A prime is a number", "too short", ""]


def _literals(rows: list[str], name: str) -> str:
    return "(VALUES " + ", ".join("(" + str(i) + ", '" + r.replace("'", "''") + "')" for i, r in enumerate(rows)) + f") AS t(id, {name})"


@example(rf"""WITH q AS (SELECT id AS qid, q AS text FROM {_literals(_QUESTIONS, "q")}), a AS (SELECT id AS aid, a FROM {_literals(_ANSWERS, "a")}),
k AS (SELECT qid, text AS q, CASE WHEN text = '' THEN 'general' {_case(tx.QUESTION_TYPES)} ELSE 'general' END AS qtype FROM q),
f AS (SELECT qid, aid, qtype, a, list_filter(regexp_extract_all(lower(q), '[a-z][a-z''-]+'), lambda w: length(w) >= 3 AND NOT list_contains([{sql_list(tx.QUESTION_STOPWORDS)}], w)) AS subject, regexp_extract_all(lower(a), '[a-z][a-z''-]+') AS words FROM k, a)
SELECT qid, aid, qtype, CASE WHEN a = '' THEN false {" ".join(f"WHEN qtype = '{k}' THEN regexp_matches(trim(a), '{p.replace(chr(39), chr(39) * 2)}')" + (" OR regexp_matches(trim(a), '" + tx.ANSWER_SHAPES["person"] + "')" if k == "place" else "") for k, p in tx.ANSWER_SHAPES.items())}
  WHEN qtype = 'yesno' THEN true WHEN qtype = 'list' THEN {_count("trim(a)", ",")} >= 2 OR {_count("trim(a)", ";")} >= 2 ELSE len(regexp_extract_all(trim(a), '\S+')) >= 4 END AS fits,
  len(subject) = 0 OR len(list_intersect(subject, words)) >= 1 AS about FROM f""")
def answer_validation(spark, sf):
    """Whether each of a few answers has the shape that each question asks for, and is about it."""
    q = spark.createDataFrame(list(enumerate(_QUESTIONS)), "qid int, q string").withColumn("qtype", tx.question_type(F.col("q")))
    a = spark.createDataFrame(list(enumerate(_ANSWERS)), "aid int, a string")
    both = q.join(F.broadcast(a), F.lit(True))  # eleven literal answers
    return both.select("qid", "aid", "qtype", tx.matches_type(F.col("a"), F.col("qtype")).alias("fits"), tx.mentions_subject(F.col("a"), F.col("q")).alias("about"))


_NEG = tx.NEGATION.replace("'", "''")


@query(f"SELECT role, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(text, '{_NEG}') THEN 1 ELSE 0 END) AS BIGINT) AS negated, CAST(sum(CASE WHEN regexp_matches(trim(text), '\\?$') THEN 1 ELSE 0 END) AS BIGINT) AS asked FROM conversations GROUP BY role")
def negation_and_questions(spark, sf):
    c = table(spark, sf, "conversations")
    flag = lambda cond: F.sum(cond.cast("long"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), flag(tx.is_negated(F.col("text"))).alias("negated"), flag(F.trim("text").rlike(r"\?$")).alias("asked"))


@query(f"SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_-]+')) AS t FROM conversations) WHERE length(t) < 2 OR list_contains([{sql_list(tx.NOISE_WORDS)}], lower(t)) OR regexp_matches(t, '^\\d{{1,2}}$') GROUP BY t")
def noise_tokens(spark, sf):
    t = table(spark, sf, "conversations").select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return t.where(tx.is_noise(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN s >= 0.55 THEN 'plain' WHEN s >= 0.38 THEN 'think' WHEN s >= 0.25 THEN 'hedge' ELSE 'abstain' END AS confidence,
  CASE WHEN event_type = 'purchase' THEN 'high' WHEN s >= 0.5 THEN 'high' WHEN s >= 0.32 THEN 'med' WHEN s >= 0.15 THEN 'low' WHEN event_type = 'click' THEN 'med' ELSE 'none' END AS band,
  CASE WHEN value IS NULL THEN 'none' WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' WHEN value < 90 THEN 'high' ELSE 'top' END AS bucket FROM (SELECT event_id, event_type, value, (event_id % 100) / 100.0 AS s FROM events)""")
def confidence_band(spark, sf):
    s = (F.col("event_id") % 100) / 100.0
    return table(spark, sf, "events").select(
        "event_id", tx.confidence(s).alias("confidence"), tx.turn_band(s, F.col("event_type") == "purchase", F.col("event_type") == "click").alias("band"), tx.bucket(F.col("value"), [10, 50, 90], ["low", "mid", "high", "top"]).alias("bucket")
    )


@query(r"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(upper(left(s, 1)) || substr(s, 2), '\bi\b', 'I', 'g') AS s FROM a)
SELECT conv_id, turn, CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS text FROM b""")
def normalized_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.normalized(F.col("text")).alias("text"))


# fixed values: keywords of emotions
EMOTIONS = {
    "frustrated": ["annoying", "frustrat", "broken", "ridiculous", "not working", "ugh"],
    "excited": ["amazing", "awesome", "love it", "perfect", "wow", "great"],
    "confused": ["confused", "don't understand", "what does", "lost", "huh", "explain"],
    "urgent": ["asap", "quick", "hurry", "right now", "urgent", "fast"],
}


@query("WITH h AS (SELECT conv_id, turn, [" + ", ".join("{'n': " + " + ".join(f"(CASE WHEN contains(lower(coalesce(text, '')), '{w.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END)" for w in own) + f", 'i': {-i}, 'name': '{name}'" + "}" for i, (name, own) in enumerate(EMOTIONS.items())) + "] AS x FROM conversations) SELECT conv_id, turn, CASE WHEN list_max(x).n > 0 THEN list_max(x).name END AS emotion FROM h")
def emotion_keywords(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.keyword_class(F.col("text"), EMOTIONS).alias("emotion"))


_DATED = given("t", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'ordered on 15 February ' || CAST(1560 + o_custkey % 400 AS STRING) || ' and sent on 8 January 1642.' WHEN 1 THEN 'from March 4, ' || CAST(1800 + o_custkey % 200 AS STRING) || ' to November 27, 1852.' WHEN 2 THEN 'The 12 Foo 1800 meeting' ELSE 'On ' || CAST(1 + o_custkey % 40 AS STRING) || ' December 999 and July 4 1776' END AS s FROM orders", "orders")


@query(rf"""WITH t AS (SELECT id, s FROM {_DATED.sql}), x AS (SELECT id, unnest(regexp_extract_all(s, '\d{{1,2}}\s+[A-Za-z]+\s+\d{{3,4}}|[A-Za-z]+\s+\d{{1,2}},?\s+\d{{3,4}}')) AS x FROM t),
p AS (SELECT id, regexp_extract(x, '(\d{{3,4}})$', 1)::INT AS y, list_position([{sql_list(num.MONTHS)}], lower(regexp_extract(x, '[A-Za-z]+')))::INT AS m, CASE WHEN regexp_matches(x, '^\d') THEN regexp_extract(x, '^\d+') ELSE regexp_extract(x, '[A-Za-z]\s+(\d{{1,2}})', 1) END::INT AS d FROM x)
SELECT id, y, m, d FROM p WHERE m > 0 AND d BETWEEN 1 AND 31""")
def date_parse(spark, sf):
    rows = _DATED.df(spark, sf)
    return rows.select("id", F.inline(num.dates(F.col("s"))))


@query(r"""SELECT o_orderkey, CAST(year(TIMESTAMP '2024-06-15') - year(o_orderdate) - CASE WHEN (6, 15) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END AS INT) AS age FROM orders""")
def age_between(spark, sf):
    part = lambda c: F.struct(F.year(c).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("d"))
    return table(spark, sf, "orders").select("o_orderkey", num.age(part("o_orderdate"), part(F.lit("2024-06-15").cast("timestamp"))).alias("age"))


_MEASURES = given("t", "SELECT p_partkey AS id, 'The ' || p_name || CASE p_size % 6 WHEN 0 THEN ' has a height of ' || CAST(p_size AS STRING) || ' metres.' WHEN 1 THEN ' has a length of ' || CAST(p_size AS STRING) || '.7 km in all.' WHEN 2 THEN ' has a mass of 1,' || CAST(100 + p_size AS STRING) || ' tonnes.' WHEN 3 THEN ' has a radius of 0.7 million km.' WHEN 4 THEN ' flies at a speed of ' || CAST(p_size AS STRING) || ' mph.' ELSE ' is here' END AS s FROM part", "part")
_MEASURE = r"(height|length|mass|diameter|radius|speed) of ([0-9][0-9,.]*[0-9]|[0-9]) ?(thousand|million|billion|trillion)? ?([a-z/]+)"
_UNITS = {**num.LENGTH, **num.MASS, **num.SPEED}


@query(rf"""WITH t AS (SELECT id, s FROM {_MEASURES.sql}), m AS (SELECT id, regexp_extract(s, '{_MEASURE}', 1) AS dim, replace(regexp_extract(s, '{_MEASURE}', 2), ',', '') AS x, regexp_extract(s, '{_MEASURE}', 3) AS scale, regexp_extract(s, '{_MEASURE}', 4) AS unit FROM t WHERE regexp_matches(s, '{_MEASURE}')),
u AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _UNITS.items())}) AS u(unit, f)), c AS (SELECT * FROM (VALUES ('', 1.0::DOUBLE), {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in num.SCALE.items())}) AS c(scale, g))
SELECT id, dim, round(x::DOUBLE * g * f, 6) AS si FROM m JOIN u USING (unit) JOIN c USING (scale)""")
def unit_convert(spark, sf):
    rows = _MEASURES.df(spark, sf).where(F.col("s").rlike(_MEASURE))
    part = lambda k: F.regexp_extract("s", _MEASURE, k)
    value = F.replace(part(2), F.lit(","), F.lit("")).cast("double") * F.coalesce(num.lookup(part(3), num.SCALE), F.lit(1.0)) * num.lookup(part(4), _UNITS)
    return rows.select("id", part(1).alias("dim"), F.round(value, 6).alias("si")).where("si is not null")


@query("""WITH p AS (SELECT user_id, least(0.95, greatest(0.0, value / 1000)) AS p FROM events WHERE value IS NOT NULL) SELECT user_id, round(1 - exp(sum(ln(1 - p))), 6) AS belief, CASE WHEN 1 - exp(sum(ln(1 - p))) >= 0.85 THEN 'high' WHEN 1 - exp(sum(ln(1 - p))) >= 0.6 THEN 'med' ELSE 'low' END AS band FROM p GROUP BY user_id""")
def noisy_or(spark, sf):
    e = table(spark, sf, "events").where("value is not null").groupBy("user_id").agg(num.noisy_or(F.col("value") / 1000).alias("b"))
    return e.select("user_id", F.round("b", 6).alias("belief"), F.when(F.col("b") >= 0.85, "high").when(F.col("b") >= 0.6, "med").otherwise("low").alias("band"))


@query("""WITH c AS (SELECT event_type, sum(value) / 100000 AS s FROM events GROUP BY event_type), e AS (SELECT event_type, exp((s - max(s) OVER ()) * 5) AS x FROM c) SELECT event_type, round(x / sum(x) OVER (), 6) AS share FROM e""")
def softmax_over_labels(spark, sf):
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(0))  # five event types
    c = table(spark, sf, "events").groupBy("event_type").agg((F.sum("value") / 100000).alias("s"))
    e = c.select("event_type", F.exp((F.col("s") - F.max("s").over(every)) * 5).alias("x"))
    return e.select("event_type", F.round(F.col("x") / F.sum("x").over(every), 6).alias("share"))


@query(r"""SELECT lang, n_sent, count(*) AS n FROM (SELECT lang, len(""" + _SENT + """) AS n_sent FROM documents) GROUP BY lang, n_sent""")
def sentence_counts(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sent"))
    return d.groupBy("lang", "n_sent").agg(F.count(F.lit(1)).alias("n"))
