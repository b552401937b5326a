"""Queries that reply from tables, and the smaller look-ups, filters, samples and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hv
from ..functions import numeric as num
from ..functions import text as tx
from ..functions.hv import top_k
from ..operators import answer as an
from ..operators import claims as cl
from ..operators import replies as re_
from ..operators import retrieve, route as ro
from .claims import _CLAIMS, _claims
from .dialogue import _Q, _parsed_sql, _questions
from .registry import example, given, letters, literal, query, sql_list, table
from .retrieval import _knn_sql, _vectors
from .routes import MEMORY, QUESTIONS

CODE = given("c", "SELECT n_name AS subj, 'defined_in' AS verb, lower(r_name) || '.py' AS obj FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'has_method', lower(s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT lower(r_name), 'imports', n_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region", "supplier")
SYMBOLS = given("q", "SELECT n_nationkey AS qid, 'defined_in' AS kind, lower(n_name) AS name FROM nation UNION ALL SELECT 100 + n_nationkey, 'methods', n_name FROM nation UNION ALL SELECT 200 + r_regionkey, 'imports', r_name FROM region", "nation", "region")


@query(f"""WITH m AS (SELECT DISTINCT qid, kind, name, obj FROM {SYMBOLS.sql} JOIN {CODE.sql} ON lower(subj) = lower(name) AND verb = CASE kind WHEN 'methods' THEN 'has_method' ELSE kind END), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY obj) AS rn, CASE kind WHEN 'methods' THEN 15 ELSE 10 END AS most FROM m)
SELECT qid, CASE any_value(kind) WHEN 'defined_in' THEN any_value(name) || ' is defined in ' || min(obj) ELSE any_value(name) || CASE any_value(kind) WHEN 'imports' THEN ' imports ' ELSE ' has ' END || count(*) || CASE any_value(kind) WHEN 'imports' THEN ' modules: ' ELSE ' methods: ' END || string_agg(obj, ', ' ORDER BY obj) FILTER (rn <= most) || CASE WHEN count(*) > any_value(most) THEN ', ... (' || (count(*) - any_value(most)) || ' more)' ELSE '' END END AS answer FROM r GROUP BY qid""")
def code_symbol_answers(spark, sf):
    return re_.symbol_answers(SYMBOLS.df(spark, sf), CODE.df(spark, sf))


CODE_TEXTS = given("t", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'method add of ' || n_name || ': adds a row' WHEN 1 THEN 'class ' || n_name || ' in store: keeps rows' WHEN 2 THEN 'module ' || n_name || ': rows and files' ELSE 'function mine in ' || n_name || ': mines patterns' END AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey", "supplier", "nation")


@query(f"""WITH q AS (SELECT qid, lower(string_split(name, '.')[-1]) AS k FROM {SYMBOLS.sql}), t AS (SELECT id, text, lower(split_part(text, ':', 1)) AS head FROM {CODE_TEXTS.sql})
SELECT qid, arg_min(id, (CASE WHEN list_contains(string_split(head, ' ')[1:3], k) THEN 0 WHEN contains(head, k) THEN 1 ELSE 2 END, CASE WHEN starts_with(head, 'module ') THEN 0 WHEN starts_with(head, 'class ') THEN 1 WHEN starts_with(head, 'function ') THEN 2 ELSE 3 END, length(text), id)) AS id FROM q JOIN t ON list_contains(regexp_extract_all(lower(text), '\\w+'), k) GROUP BY qid""")
def code_references(spark, sf):
    return re_.best_reference(SYMBOLS.df(spark, sf), CODE_TEXTS.df(spark, sf))


SELF = literal("f", "attribute string, value string", [("alive", "false"), ("compositional", "true"), ("version", "one"), ("body", None)])
HELLOS = given("m", "SELECT conv_id * 1000 + turn AS id, CASE conv_id % 9 WHEN 0 THEN 'Hello!' WHEN 1 THEN 'Who are you?' WHEN 2 THEN 'are you alive' WHEN 3 THEN 'Are you a compositional thing?' WHEN 4 THEN 'are you version' WHEN 5 THEN 'are you a body' WHEN 6 THEN 'are you tall?' ELSE text END AS text FROM conversations WHERE role = 'user'", "conversations")


@query(f"""WITH m AS (SELECT id, regexp_replace(lower(trim(text)), '[?!.,]+$', '') AS low FROM {HELLOS.sql}), a AS (SELECT *, regexp_extract(low, '^are you (?:a |an |the )?(\\w[\\w ]{{0,30}})$', 1) AS asked FROM m), j AS (SELECT a.*, string_split(asked, ' ')[1] AS attribute, f.attribute IS NOT NULL AS known, value FROM a LEFT JOIN {SELF.sql} ON f.attribute = string_split(asked, ' ')[1])
SELECT id, CASE WHEN low IN ({sql_list(re_.GREETINGS)}) THEN 'Hello. I am Cairn.' WHEN low IN ({sql_list(re_.FAREWELLS)}) THEN 'Goodbye.' WHEN low IN ({sql_list(re_.THANKS)}) THEN 'You are welcome.' WHEN regexp_matches(low, '\\b(who are you|what is your name|what are you)\\b') THEN 'I am Cairn.'
  WHEN asked <> '' THEN CASE WHEN NOT known THEN 'I do not know if I am ' || asked || '.' WHEN value IS NULL THEN 'I do not have a ' || attribute || '.' WHEN value = 'false' THEN 'No, I am not ' || asked || '.' WHEN value = 'true' THEN 'Yes.' ELSE 'Yes, I am ' || value || '.' END END AS answer FROM j""")
def self_answers(spark, sf):
    return re_.about_itself(HELLOS.df(spark, sf), SELF.df(spark, sf), "Cairn")


ENTRIES = given("e", f"SELECT {letters('p_partkey')} AS word, CAST(p_partkey % 3 AS INT) AS pos, 'a ' || p_name || ' of the kind ' || lower(p_type) AS gloss FROM part", "part")
KIN = given("r", f"SELECT {letters('p_partkey')} AS word, CASE p_size % 2 WHEN 0 THEN 'synonym' ELSE 'antonym' END AS relation, p_name AS target, CAST(p_size AS INT) AS pos FROM part", "part")
LOOKUPS = given("m", f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'define ' WHEN 1 THEN 'What is a ' WHEN 2 THEN 'synonyms of ' WHEN 3 THEN 'opposite of ' ELSE 'hello ' END || {letters('p_partkey')} AS text FROM part", "part")


@query(f"""WITH m AS (SELECT id, CASE WHEN regexp_matches(text, '(?i)^(?:define|what is an?|what does)\\b') THEN 'define' WHEN regexp_matches(text, '(?i)^synonyms of') THEN 'synonym' WHEN regexp_matches(text, '(?i)^opposites? of') THEN 'antonym' END AS kind, lower(regexp_extract(text, '([A-Za-z-]+)(?: mean)?[?.!]*$', 1)) AS word FROM {LOOKUPS.sql}),
g AS (SELECT word, arg_min(gloss, pos) AS gloss FROM {ENTRIES.sql} GROUP BY 1), r AS (SELECT word, relation, string_agg(target, ', ' ORDER BY pos, target) AS t FROM {KIN.sql} GROUP BY 1, 2)
SELECT id, CASE WHEN kind = 'define' AND gloss IS NOT NULL THEN m.word || ': ' || gloss ELSE t END AS answer FROM m LEFT JOIN g ON g.word = m.word LEFT JOIN r ON r.word = m.word AND r.relation = m.kind""")
def dictionary_answers(spark, sf):
    return re_.dictionary_replies(LOOKUPS.df(spark, sf), ENTRIES.df(spark, sf), KIN.df(spark, sf))


ENTRY_EXAMPLES = literal("e", "word string, pos int, gloss string", [("puppy", 1, "a young dog that plays"), ("kitten", 1, "a young cat that plays"), ("foal", 1, "a young horse"), ("big", 1, "of great size"), ("big", 2, "important"), ("kennel", 1, "a house for a dog"), ("cattery", 1, "a house for a cat")])
THREES = literal("q", "qid int, a string, b string, c string", [(1, "dog", "puppy", "cat"), (2, "dog", "kennel", "cat"), (3, "dog", "unknown", "cat")])
_GW = "list_distinct(list_filter(regexp_extract_all({0}, '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN (" + sql_list(tx.QUESTION_STOPWORDS) + ")))"


@example(f"""WITH g AS (SELECT word, arg_min(gloss, pos) AS gloss FROM {ENTRY_EXAMPLES.sql} GROUP BY 1), w AS (SELECT q.*, {_GW.format('replace(lower(gloss), a, c)')} AS f FROM {THREES.sql} JOIN g ON g.word = b), o AS (SELECT word, {_GW.format('lower(gloss)')} AS t FROM g),
s AS (SELECT qid, word, round(len(list_intersect(f, t)) / sqrt(len(f) * len(t)), 6) AS sim FROM w, o WHERE word NOT IN (a, b, c)) SELECT qid, word AS answer, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, word) AS rn FROM s WHERE sim >= 0.5) WHERE rn = 1""")
def dictionary_analogy(spark, sf):
    return re_.dictionary_analogies(THREES.df(spark, sf), ENTRY_EXAMPLES.df(spark, sf))


ORDERS = given("m", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'sort [3, ' || CAST(o_custkey AS STRING) || '.5, -2] and save to out' || CAST(o_orderkey AS STRING) || '.csv' WHEN 1 THEN 'print "' || o_orderpriority || '" ' || CAST(o_custkey AS STRING) || ' times' WHEN 2 THEN 'read /tmp/data/' || CAST(o_orderkey AS STRING) || '.json' ELSE o_orderpriority END AS text FROM orders""", "orders")


@query(rf"""SELECT id, round(coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(text, '\[([^\]]*)\]', 1), '-?\d+(?:\.\d+)?'), lambda x: x::DOUBLE)), 0), 6) AS total, nullif(regexp_extract(text, '(?:^|[^\w.])(-?\d+)(?:$|[^\w.])', 1), '')::BIGINT AS first,
  nullif(regexp_extract(text, '((?:/|\./|~/)[\w./-]+|[\w-]+\.(?:csv|txt|json|py))', 1), '') AS path, nullif(regexp_extract(text, '"([^"]*)"', 1), '') AS quoted FROM {ORDERS.sql}""")
def literal_values(spark, sf):
    """Lists of numbers (their sum), whole numbers, paths and quoted strings in messages."""
    m = ORDERS.df(spark, sf).select("id", re_.literals(F.col("text")).alias("x"))
    return m.select("id", F.round(F.aggregate("x.numbers", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), "x.first", "x.path", "x.quoted")


LABELS = given("l", "SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN 'REL_WROTE_' WHEN 1 THEN 'REL_BORN_' WHEN 2 THEN 'REL_' ELSE 'REL_IN_' END || CASE p_size % 5 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN 'OF' ELSE upper(replace(p_name, ' ', '_')) END AS label, CASE p_size % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'place' ELSE 'statement' END AS kind FROM part", "part")
HINTS = {"person": ["WROTE", "MADE"], "place": ["BORN", "LIVES"]}


@query(f"SELECT label, kind, CASE WHEN w = '' OR regexp_matches(w, '^\\d+$') OR len(list_filter(string_split(w, '_'), lambda p: length(p) > 2)) = 0 THEN 0 WHEN kind = 'statement' THEN 2 WHEN {' OR '.join(f"(kind = '{k}' AND regexp_matches(upper(w), '{'|'.join(v)}'))" for k, v in HINTS.items())} THEN 10 ELSE 1 END AS score FROM (SELECT *, replace(label, 'REL_', '') AS w FROM {LABELS.sql})")
def label_scores(spark, sf):
    return re_.label_scores(LABELS.df(spark, sf), F.col("kind"), HINTS)


_SHAPE = r"(?i)\?\s*$|^\s*(?:who|what|where|when|why|how|which|is|are|was|were|do|does|did|can|could|will|would|should)\b"


@query(f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(coalesce(text, ''), '{_SHAPE}')")
def question_turns(spark, sf):
    """Turns that ask: by their end or their first word."""
    return table(spark, sf, "conversations").where(F.coalesce("text", F.lit("")).rlike(tx.re2(_SHAPE))).select("conv_id", "turn")


@query(r"SELECT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(coalesce(text, ''), '\d+'), ['1994', '2001', '7'])) > 0")
def value_filter(spark, sf):
    """Documents that hold one of the numbers named."""
    return table(spark, sf, "documents").where(F.arrays_overlap(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), F.array(F.lit("1994"), F.lit("2001"), F.lit("7")))).select("doc_id")


@query(f"SELECT qid, CASE WHEN regexp_matches(lower(question), '\\b(who are you|your name)\\b') THEN 'identity' WHEN len(list_intersect(regexp_extract_all(lower(question), '[a-z]+'), ['session', 'trade', 'close', 'position'])) > 0 THEN 'trading' ELSE 'general' END AS domain FROM {QUESTIONS.sql}")
def domain_class(spark, sf):
    words = F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0))
    trading = F.arrays_overlap(words, F.array(*map(F.lit, ("session", "trade", "close", "position"))))
    return QUESTIONS.df(spark, sf).select("qid", F.when(F.lower("question").rlike(r"\b(who are you|your name)\b"), "identity").when(trading, "trading").otherwise("general").alias("domain"))


@query("SELECT b.item_id, EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) AS stored FROM benchmark b")
def item_exists(spark, sf):
    d = table(spark, sf, "documents").select("text").where("text is not null").distinct().withColumn("stored", F.lit(True))
    return table(spark, sf, "benchmark").join(d, "text", "left").select("item_id", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def latest_bar(spark, sf):
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("value", at).alias("value"), F.max("ts").alias("ts"))


CUES = {"ask": (["who", "what", "when"], ["know", "tell"]), "make": (["write", "create"], ["new", "story"]), "chat": (["hello", "thanks"], ["nice", "you"])}


def _cue_sql(strong, weak) -> str:
    return " + ".join(f"CASE WHEN contains(low, ' {c} ') THEN {w} ELSE 0 END" for own, w in ((strong, 1.0), (weak, 0.5)) for c in own)


@query(rf"""WITH l AS (SELECT conv_id, turn, ' ' || lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS low FROM conversations), w AS (SELECT conv_id, turn, [{', '.join(f"{{'w': CAST({_cue_sql(*own)} AS DOUBLE), 'i': {-i}, 'k': '{k}'}}" for i, (k, own) in enumerate(CUES.items()))}] AS s FROM l)
SELECT conv_id, turn, list_max(s).k AS intent, round(CASE WHEN list_max(s).w = list_sum(list_transform(s, lambda x: x.w)) THEN 1.0 ELSE greatest(0.15, least(0.85, list_max(s).w / list_sum(list_transform(s, lambda x: x.w)))) END, 6) AS share FROM w WHERE list_sum(list_transform(s, lambda x: x.w)) > 0""")
def intent_scores(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", re_.intents(F.col("text"), CUES).alias("x")).where("x is not null")
    return t.select("conv_id", "turn", "x.intent", "x.share")


ABBREVIATIONS = {"usa": "united states", "uk": "united kingdom", "dr": "doctor"}
SHORT = given("s", "SELECT conv_id * 1000 + turn AS id, text AS s FROM conversations WHERE role = 'user'", "conversations")
_LONG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}"


@query(rf"SELECT id, array_to_string(list_filter(flatten(list_transform(regexp_extract_all(lower(coalesce(s, '')), '[\p{{L}}\p{{N}}_-]+'), lambda w: string_split(coalesce({_LONG}[w], w), ' '))), lambda w: w NOT IN ({sql_list(tx.QUESTION_STOPWORDS)})), ' ') AS words FROM {SHORT.sql}")
def expanded_words(spark, sf):
    """Content words with abbreviations written out."""
    words = F.flatten(F.transform(tx.lower_tokens(F.col("s")), lambda w: F.split(F.coalesce(F.create_map(*[F.lit(x) for p in ABBREVIATIONS.items() for x in p])[w], w), " ")))
    return SHORT.df(spark, sf).select("id", F.array_join(tx.content(words, tx.QUESTION_STOPWORDS), " ").alias("words"))


@query()
def nonrepeating_picks(spark, sf):
    """A reply for each turn that neither of the two turns before had. Without SQL; tested for that law."""
    return re_.picks(table(spark, sf, "conversations").select("conv_id", "turn"), ["yes", "go on", "I see", "right", "tell me more"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_with_ties(spark, sf):
    """The 25 largest in a stated order, so that a tie at the edge can't change the result."""
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR) || 'seed'), 1, 8))::BIGINT % 100 < 7")
def seeded_sample(spark, sf):
    """Seven in a hundred, chosen by a hash with a seed."""
    h = F.conv(F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("seed")).cast("binary")), 1, 8), 16, 10).cast("long")
    return table(spark, sf, "events").where(h % 100 < 7).select("event_id")


@query("SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id) AS id, round(list_sum(embedding)::DOUBLE, 4) AS total, NULL AS metadata FROM embeddings WHERE label = 1".replace("list_sum(embedding)::DOUBLE", "list_sum(list_transform(embedding, lambda x: x::DOUBLE))").replace("NULL AS metadata", "CAST(NULL AS VARCHAR) AS metadata"))
def appended_vectors(spark, sf):
    """Rows that come with vectors of their own, appended in bulk: ids go on, no metadata."""
    from ..operators import store

    e = table(spark, sf, "embeddings")
    new = e.where("label = 1").select("vec_id", "embedding")
    made = store.with_new_ids(e.select(F.col("vec_id").alias("id")), new, ["vec_id"])
    return made.select("id", num.rounded(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), F.lit(None).cast("string").alias("metadata"))


@query("SELECT p.n_name FROM (VALUES ('NATION_1'), ('Atlantis'), ('NATION_7'), ('Utopia')) AS p(n_name) WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_name = p.n_name)")
def seeded_rows(spark, sf):
    """Seeds that the store lacks."""
    seeds = spark.createDataFrame([(x,) for x in ("NATION_1", "Atlantis", "NATION_7", "Utopia")], "n_name string")
    return seeds.join(table(spark, sf, "nation").select("n_name"), "n_name", "left_anti")


@query(f"SELECT qid, id, round(sim, 6) AS sim FROM ({_knn_sql(1)}) WHERE sim >= 0.4")
def gated_hits(spark, sf):
    """The nearest vector of each query, or nothing."""
    _, rows, q = _vectors(spark, sf)
    return retrieve.cosine_knn(rows, q, 1).where("sim >= 0.4").select("qid", "id", F.round("sim", 6).alias("sim"))


@query(f"SELECT qid, id FROM ({_knn_sql(8)}) k JOIN embeddings e ON e.vec_id = k.id WHERE label IS NULL OR label = 1")
def knn_attribute_after_k(spark, sf):
    """An attribute filter applies to the eight best, so fewer may be left; a missing attribute passes."""
    e, rows, q = _vectors(spark, sf)
    return retrieve.cosine_knn(rows, q, 8).join(e.select(F.col("vec_id").alias("id"), "label"), "id").where("label is null or label = 1").select("qid", "id")


@query("""WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(q.v, o.v), 9) AS sim FROM q JOIN o ON qid <> vec_id)
SELECT qid, id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM s) WHERE rn = 1 AND sim >= 0.32""")
def best_opinion(spark, sf):
    """The one nearest row of a sub-store, from a similarity of 0.32 on."""
    e, _, q = _vectors(spark, sf)
    rows = e.where("label = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieve.cosine_knn(rows, q, 1).where("sim >= 0.32").select("qid", "id", F.round("sim", 6).alias("sim"))


PROTOTYPES = literal("p", "class string, phrase string", [("greeting", "hello there my friend"), ("greeting", "good morning to all"), ("thanks", "thank you so much"), ("mood", "how do you feel today")])
SAID = given("m", "SELECT conv_id * 1000 + turn AS id, CASE conv_id % 5 WHEN 0 THEN 'hello my friend' WHEN 1 THEN 'thank you very much' WHEN 2 THEN 'how do people feel' ELSE text END AS text FROM conversations WHERE role = 'user'", "conversations")
_SET = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+'))"


@query(f"""WITH s AS (SELECT id, class, round(len(list_intersect({_SET.format('text')}, {_SET.format('phrase')})) / sqrt(len({_SET.format('text')}) * len({_SET.format('phrase')})), 6) AS sim FROM {SAID.sql}, {PROTOTYPES.sql} WHERE len(regexp_extract_all(lower(text), '[a-z]+')) <= 9)
SELECT id, class, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, class) AS rn FROM s) WHERE rn = 1 AND sim >= 0.6""")
def smalltalk_class(spark, sf):
    """The class of the nearest prototype phrase for messages of up to nine words, from 0.6 on."""
    w = lambda c: F.array_distinct(tx.lower_tokens(F.col(c), "[a-z]+"))
    m = SAID.df(spark, sf).where(F.size(tx.lower_tokens(F.col("text"), "[a-z]+")) <= 9).select("id", w("text").alias("a"))
    p = PROTOTYPES.df(spark, sf).select("class", w("phrase").alias("b"))
    s = m.join(F.broadcast(p), F.arrays_overlap("a", "b"))  # prototypes are a short list
    s = s.select("id", "class", F.round(F.size(F.array_intersect("a", "b")) / F.sqrt(F.size("a") * F.size("b")), 6).alias("sim"))
    return top_k(s.where("sim >= 0.6"), ["id"], [F.desc("sim"), F.col("class")], 1).drop("rank")


_TOK = r"list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+'))"


@query(f"""WITH b AS (SELECT item_id, unnest(w) AS t, len(w) AS n FROM (SELECT item_id, {_TOK} AS w FROM benchmark)), d AS (SELECT doc_id, unnest(w) AS t, len(w) AS m FROM (SELECT doc_id, {_TOK} AS w FROM documents)), c AS (SELECT item_id, doc_id, any_value(n) AS n, any_value(m) AS m, count(*) AS k FROM b JOIN d USING (t) GROUP BY 1, 2)
SELECT item_id, doc_id, round(k / (n + m - k), 6) AS jaccard FROM c WHERE k >= 0.3 * (n + m - k)""")
def similarity_join(spark, sf):
    """Benchmark items and documents whose word sets have a Jaccard similarity of 0.3 or more: an item goes against all documents by the words they share, without a product."""
    h = lambda df, i: df.select(F.col(i).alias("id"), F.transform(F.array_distinct(tx.lower_tokens(F.col("text"))), lambda x: F.xxhash64(x)).alias("h"))
    items = h(table(spark, sf, "benchmark"), "item_id").select((-F.col("id") - 1).alias("qid"), "h")  # ids of their own
    near = retrieve.set_neighbours(h(table(spark, sf, "documents"), "doc_id"), items, 0.3)
    return near.select((-F.col("qid") - 1).alias("item_id"), F.col("id").alias("doc_id"), F.round(F.col("both") / F.col("either"), 6).alias("jaccard"))


@query("""SELECT v.event_id, left(string_agg(c.event_id || '@' || c.user_id, ' ' ORDER BY c.ts, c.event_id), 200) AS said FROM events v JOIN events c ON v.user_id = c.user_id AND c.event_type = 'click' AND v.event_type = 'view' AND epoch(c.ts) BETWEEN epoch(v.ts) - 14400 AND epoch(v.ts) + 28800 GROUP BY v.event_id""")
def fused_rows(spark, sf):
    """A sight with what was said around it, in order, up to 200 characters."""
    width = 43200
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    views = e.where("event_type = 'view'").select("event_id", "user_id", "t", F.explode(F.sequence(F.floor((F.col("t") - 14400) / width), F.floor((F.col("t") + 28800) / width))).alias("bin"))
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("c"), "user_id", F.col("ts").alias("at"), F.col("t").alias("u"), F.floor(F.col("t") / width).alias("bin"))
    met = views.join(clicks, ["user_id", "bin"]).where("u between t - 14400 and t + 28800")
    first = top_k(met, ["event_id"], [F.col("at"), F.col("c")], 100)  # more than 200 characters
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("@", F.col("c").cast("string"), F.col("user_id").cast("string")).alias("s")))), lambda x: x["s"]), " ")
    return first.groupBy("event_id").agg(F.left(said, F.lit(200)).alias("said"))


@query(f"""{_CLAIMS}, p AS ({_parsed_sql()}), h AS (SELECT qid, c.obj AS answer, id, pos FROM p JOIN claims c ON p.subj IS NOT NULL AND c.subj = p.subj AND c.verb = p.verb UNION ALL SELECT qid, c.subj, id, pos FROM p JOIN claims c ON p.obj IS NOT NULL AND c.obj = p.obj AND c.verb = p.verb),
s AS (SELECT qid, arg_min(answer, (id, pos)) AS answer FROM h GROUP BY qid), e AS (SELECT qid, CASE WHEN text LIKE 'remember%' THEN 'noted' END AS answer FROM {_Q}),
a AS (SELECT qid, 0 AS prio, 'memory' AS route, answer FROM e WHERE answer IS NOT NULL UNION ALL SELECT qid, 1, 'structured', answer FROM s UNION ALL SELECT qid, 2, 'fallback', 'I do not know.' FROM e) SELECT qid, arg_min(route, prio) AS route, arg_min(answer, prio) AS answer FROM a GROUP BY qid""")
def cascade_answers(spark, sf):
    """The first route that has an answer, for all questions at once: commands, structured facts, else a fallback."""
    q = _questions(spark, sf)
    memory = q.select("qid", F.when(an.route(F.col("text")) == "memory", "noted").alias("answer"))
    return re_.first_route([("memory", memory), ("structured", an.answer(q, _claims(spark, sf))), ("fallback", q.select("qid", F.lit("I do not know.").alias("answer")))])


@query()
def agreed_rows(spark, sf):
    """Rows that several memories agree on for each question. Without SQL; tested against a loop."""
    m, q = MEMORY.df(spark, sf), QUESTIONS.df(spark, sf)
    return re_.consensus(ro.candidates(q, ro.word_index(m), least=0.2), m, 0.2)


@query(f"""WITH h AS ({_knn_sql(3)}), x AS (SELECT h.qid, a.label = b.label AS hit, sim FROM h JOIN embeddings a ON a.vec_id = h.qid JOIN embeddings b ON b.vec_id = h.id) SELECT count(*) AS hits, count(DISTINCT qid) AS queries, round(avg(hit::INT), 6) AS rate, round(avg(sim), 6) AS mean, round(min(sim), 6) AS least FROM x""")
def evaluation_metrics(spark, sf):
    """Hit rate, mean and least similarity of the three nearest vectors."""
    e, rows, q = _vectors(spark, sf)
    label = lambda name, i: e.select(F.col("vec_id").alias(i), F.col("label").alias(name))
    x = retrieve.cosine_knn(rows, q, 3).join(label("a", "qid"), "qid").join(label("b", "id"), "id")
    return x.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("qid").alias("queries"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("rate"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.min("sim"), 6).alias("least"))


@query(r"""WITH w AS (SELECT item_id, w, unnest(range(2, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+') AS w FROM benchmark)), p AS (SELECT w[i] AS word, w[i - 1] AS a, w[i + 1] AS b FROM w), n AS (SELECT word, a || ' _ ' || b AS sense, count(*) AS n, a, b FROM p GROUP BY word, a, b)
SELECT word, sense, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, a, b) AS rank FROM n) WHERE rank <= 3""")
def word_senses(spark, sf):
    """The three most frequent surroundings of each word: previous and next word observed."""
    s = re_.surroundings(table(spark, sf, "benchmark"), tx.lower_tokens(F.col("text")))
    return s.select("word", "sense", "n", F.col("rank").cast("long").alias("rank"))


@query()
def rich_windows(spark, sf):
    """Recurring windows of dates, places, people and organisations. Without SQL; tested against a loop."""
    from ..operators import mine

    return mine.rich_windows(table(spark, sf, "conversations"), tx.tokens(F.col("text")))


CONNECTORS = ["Also, ", "Besides, ", "And "]


@query()
def composed_answers(spark, sf):
    """Paragraphs of several facts. Without SQL; tested against a loop."""
    return re_.composed(agreed_rows(spark, sf), MEMORY.df(spark, sf), CONNECTORS)


SOUNDS = literal("d", "word string, units string", [("river", "R IH1 V ER0"), ("stone", "S T OW1 N")])
SPOKEN = given("w", "SELECT DISTINCT substr(p_name, instr(p_name, ' ') + 1) AS word FROM part UNION ALL SELECT DISTINCT lower(r_name) FROM region", "part", "region")


@query(f"""WITH m AS (SELECT word, coalesce(units, array_to_string(list_filter(list_transform(regexp_extract_all(lower(word), '.'), lambda c: MAP {{{', '.join(f"'{k}': '{v}'" for k, v in tx.LETTER_SOUNDS.items())}}}[c]), lambda x: x IS NOT NULL), ' ')) AS units FROM {SPOKEN.sql} LEFT JOIN (SELECT word AS k, units FROM {SOUNDS.sql}) ON lower(word) = k)
SELECT word, regexp_replace(units, '[0-9]', '', 'g') AS units, array_to_string(regexp_extract_all(units, '[0-9]'), '') AS stress FROM m""")
def phoneme_units(spark, sf):
    return re_.phonemes(SPOKEN.df(spark, sf), SOUNDS.df(spark, sf))


KINDS = given("r", f"SELECT {letters('p_partkey')} || CASE p_size % 3 WHEN 0 THEN ' ' ELSE '' END AS word, CASE p_size % 4 WHEN 0 THEN 'synonym' ELSE 'hypernym' END AS relation, CASE p_size % 5 WHEN 0 THEN 'animal' WHEN 1 THEN 'hunter' ELSE 'plant' END AS target FROM part", "part")


@query(f"SELECT min(target) AS kind, lower(trim(word)) AS word FROM {KINDS.sql} WHERE relation = 'hypernym' AND target IN ('animal', 'hunter') AND regexp_matches(lower(trim(word)), '^[a-z]+$') AND length(trim(word)) BETWEEN 4 AND 10 GROUP BY 2")
def hypernym_pools(spark, sf):
    return re_.pools(KINDS.df(spark, sf), ["animal", "hunter"])


@query()
def topics_to_learn(spark, sf):
    """What unanswered questions are about and wasn't tried. Without SQL; tested against a loop."""
    from ..operators import route as ro_

    m, q = MEMORY.df(spark, sf), QUESTIONS.df(spark, sf)
    return re_.to_learn(q, ro_.semantic_answers(q, m), table(spark, sf, "nation").select(F.col("n_name").alias("topic")))
