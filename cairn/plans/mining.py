"""Queries that mine the documents: frequencies, n-grams, patterns, near duplicates by word sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..functions.hv import top_k
from ..operators import mine, retrieve
from .registry import ORACLE_SQL, query, sql_list, table

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+')"
_CASED = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_-]+')"
_DF = f"SELECT t AS token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS t FROM documents) GROUP BY t"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _words():
    return tx.lower_tokens(F.col("text"))


@query(_DF)
def token_df(spark, sf):
    return mine.document_frequency(_docs(spark, sf), _words())


@query(f"SELECT token, round(least(6, greatest(0.5, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 6) AS idf FROM ({_DF})")
def token_idf(spark, sf):
    n = _docs(spark, sf).count()
    return mine.document_frequency(_docs(spark, sf), _words()).select("token", F.round(num.idf(F.lit(n), F.col("df")), 6).alias("idf"))


@query(f"SELECT lang, token, n FROM (SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rn FROM (SELECT lang, t AS token, count(*) AS n FROM (SELECT lang, unnest({_TOK}) AS t FROM documents) GROUP BY 1, 2)) WHERE rn <= 20")
def top_terms_by_lang(spark, sf):
    c = _docs(spark, sf).select("lang", F.explode(_words()).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return top_k(c, ["lang"], [F.desc("n"), F.col("token")], 20).drop("rank")


def _grams_sql(n: int, words: str = _TOK) -> str:
    return f"SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) AS g FROM (SELECT {words} AS w FROM documents) WHERE len(w) >= {n}"


@query(f"SELECT g[1] AS context, g[2] AS next, count(*) AS n FROM ({_grams_sql(2)}) GROUP BY 1, 2")
def bigram_next(spark, sf):
    return mine.transitions(_docs(spark, sf), _words(), 1)


@query(f"SELECT g[1] || ' ' || g[2] AS context, g[3] AS next, count(*) AS n FROM ({_grams_sql(3)}) GROUP BY 1, 2 HAVING count(*) > 1")
def trigram_next(spark, sf):
    return mine.transitions(_docs(spark, sf), _words(), 2).where("n > 1")


def _best_sql(n: int) -> str:
    c = f"SELECT array_to_string(g[1:{n - 1}], ' ') AS context, g[{n}] AS next, count(*) AS n FROM ({_grams_sql(n)}) GROUP BY 1, 2"
    return f"SELECT context, next, n / sum(n) OVER (PARTITION BY context) AS p, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS rn FROM ({c})"


@query(f"""WITH b AS (SELECT * FROM ({_best_sql(2)}) WHERE rn = 1), t AS (SELECT * FROM ({_best_sql(3)}) WHERE rn = 1),
q AS (SELECT DISTINCT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')[1] AS w1, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')[2] AS w2 FROM benchmark)
SELECT w1, w2, coalesce(t.next, b.next) AS next, round(coalesce(t.p, b.p), 6) AS p FROM q LEFT JOIN t ON t.context = w1 || ' ' || w2 LEFT JOIN b ON b.context = w2""")
def next_word_backoff(spark, sf):
    """The likeliest word after each benchmark text's first two: by trigram, else by bigram."""
    d = _docs(spark, sf)
    one = mine.best_next(mine.transitions(d, _words(), 1)).select(F.col("context").alias("w2"), F.col("next").alias("n1"), F.col("p").alias("p1"))
    two = mine.best_next(mine.transitions(d, _words(), 2)).select("context", F.col("next").alias("n2"), F.col("p").alias("p2"))
    q = table(spark, sf, "benchmark").select(F.get(_words(), F.lit(0)).alias("w1"), F.get(_words(), F.lit(1)).alias("w2")).distinct()
    q = q.withColumn("context", F.concat_ws(" ", "w1", "w2"))
    return q.join(two, "context", "left").join(one, "w2", "left").select("w1", "w2", F.coalesce("n2", "n1").alias("next"), F.round(F.coalesce("p2", "p1"), 6).alias("p"))


@query(rf"""WITH w AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+') AS w FROM benchmark), p AS (SELECT w, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
o AS (SELECT a, unnest(w[i + 1:i + 4]) AS b FROM p), c AS (SELECT a, b, count(*) AS n FROM o WHERE a <> b GROUP BY 1, 2)
SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM c UNION ALL SELECT b, a, n FROM c) GROUP BY 1, 2""")
def cooccurrence_window(spark, sf):
    return mine.cooccurrence(table(spark, sf, "benchmark"), _words(), 4)


_FW = f"[{sql_list(tx.FUNCTION_WORDS)}]"
_TFW = f"[{sql_list(tx.TYPED_FUNCTION_WORDS)}]"


def _windows_sql(words: str, least: int, most: int, source: str) -> str:
    return " UNION ALL ".join(f"SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) AS w FROM (SELECT {words} AS w FROM {source}) WHERE len(w) >= {n}" for n in range(least, most + 1))


@query(f"""WITH w AS ({_windows_sql(_CASED, 4, 6, "benchmark")}), c AS (SELECT w, list_filter(w, lambda x: NOT list_contains({_FW}, lower(x))) AS own FROM w),
p AS (SELECT array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({_FW}, lower(x)) THEN lower(x) ELSE '<C>' END), ' ') AS pattern, own[1] AS s, own[-1] AS o FROM c WHERE len(own) >= 2 AND len(own) < len(w))
SELECT pattern, count(*) AS n, arg_min(s, (s, o)) AS first_subject, arg_min(o, (s, o)) AS first_object FROM p GROUP BY pattern HAVING count(*) >= 3""")
def phrase_patterns(spark, sf):
    return mine.phrase_patterns(table(spark, sf, "benchmark"), tx.tokens(F.col("text")))


_TAG = rf"list_transform(range(1, len(c) + 1), lambda i: CASE WHEN regexp_matches(c[i], '^\p{{N}}+s?$') THEN 'NUMBER' WHEN regexp_matches(c[i], '^\p{{Lu}}') AND (i > 1 OR NOT list_contains({_TFW}, lower(c[i]))) THEN 'ENTITY' ELSE lower(c[i]) END)"


@query(f"WITH t AS (SELECT {_TAG} AS tags FROM (SELECT {_CASED} AS c FROM conversations)), w AS ({_windows_sql("tags", 4, 7, "t")}) SELECT array_to_string(w, ' ') AS pattern, count(*) AS n FROM w WHERE len(list_filter(w, lambda x: x = 'ENTITY')) >= 2 GROUP BY 1 HAVING count(*) >= 2")
def typed_windows(spark, sf):
    return mine.typed_windows(table(spark, sf, "conversations"), tx.tokens(F.col("text")))


_TRIPLES = f"""WITH t AS (SELECT list_transform(range(1, len(c) + 1), lambda i: {{'w': c[i], 't': g[i]}}) AS v FROM (SELECT c, {_TAG} AS g FROM (SELECT {_CASED} AS c FROM benchmark))), w AS ({_windows_sql('v', 4, 5, 't')}),
e AS (SELECT list_filter(w, lambda x: x.t = 'ENTITY') AS e, list_filter(w, lambda x: x.t <> 'ENTITY' AND x.t <> 'NUMBER' AND NOT list_contains({_TFW}, x.t)) AS l FROM w),
r AS (SELECT e[1].w AS s, 'REL_' || array_to_string(list_transform(l[1:3], lambda x: upper(x.t)), '_') AS label, e[-1].w AS o FROM e WHERE len(e) >= 2 AND len(l) >= 1)"""


@query(_TRIPLES + " SELECT s, label, o, count(*) AS n FROM r GROUP BY 1, 2, 3")
def typed_triples(spark, sf):
    return mine.typed_triples(table(spark, sf, "benchmark"), tx.tokens(F.col("text")), upper=tx.simple_upper)


@query(_TRIPLES + " SELECT least(s, o) AS s, greatest(s, o) AS o, count(DISTINCT label) AS labels FROM r GROUP BY 1, 2 HAVING count(DISTINCT label) >= 2")
def cross_validated_pairs(spark, sf):
    return mine.cross_validated(mine.typed_triples(table(spark, sf, "benchmark"), tx.tokens(F.col("text")), upper=tx.simple_upper))


def _over_documents(name: str, table_name: str = "benchmark") -> str:
    """The SQL of a query on a smaller table, on documents."""
    return ORACLE_SQL[name].replace(f"FROM {table_name}", "FROM documents")


@query(_over_documents("cooccurrence_window"))
def cooccurrence_window_documents(spark, sf):
    return mine.cooccurrence(_docs(spark, sf), _words(), 4)


@query(_over_documents("phrase_patterns"))
def phrase_patterns_documents(spark, sf):
    return mine.phrase_patterns(_docs(spark, sf), tx.tokens(F.col("text")))


@query(_over_documents("typed_windows", "conversations"))
def typed_windows_documents(spark, sf):
    return mine.typed_windows(_docs(spark, sf), tx.tokens(F.col("text")))


@query()
def typed_triples_documents(spark, sf):
    """Without SQL: DuckDB's upper makes one letter of the sharp s in a label, Spark's two."""
    return mine.typed_triples(_docs(spark, sf), tx.tokens(F.col("text")))


@query(_over_documents("cross_validated_pairs"))
def cross_validated_pairs_documents(spark, sf):
    return mine.cross_validated(mine.typed_triples(_docs(spark, sf), tx.tokens(F.col("text")), upper=tx.simple_upper))


@query(f"""WITH d AS (SELECT lang, source, w, min(len(w)) OVER (PARTITION BY lang, source) AS least FROM (SELECT lang, source, {_CASED} AS w FROM documents)), p AS (SELECT lang, source, unnest(w[1:least]) AS w, generate_subscripts(w[1:least], 1) - 1 AS pos FROM d)
SELECT lang, source, pos, count(DISTINCT w) AS n FROM p GROUP BY 1, 2, 3 HAVING count(DISTINCT w) > 1 AND bool_and(NOT list_contains({_FW}, lower(w)))""")
def slot_detection(spark, sf):
    """Places where the texts of a language and source differ and all have content words, up to the end of the group's shortest text."""
    return mine.slots(_docs(spark, sf), ["lang", "source"], tx.tokens(F.col("text"))).select("lang", "source", F.col("pos").cast("long").alias("pos"), "n")


@query(f"""WITH w AS (SELECT doc_id, lang, list_distinct({_TOK}) AS w FROM documents), r AS (SELECT lang, t, doc_id FROM (SELECT doc_id, lang, unnest(w) AS t FROM w)), q AS (SELECT * FROM r WHERE doc_id % 100 = 0),
c AS (SELECT q.doc_id AS qid, r.doc_id AS id, count(*) AS k FROM q JOIN r ON q.t = r.t AND q.doc_id <> r.doc_id GROUP BY 1, 2)
SELECT qid, id, round(k / (len(a.w) + len(b.w) - k), 6) AS jaccard FROM c JOIN w a ON a.doc_id = qid JOIN w b ON b.doc_id = id WHERE k / (len(a.w) + len(b.w) - k) >= 0.5""")
def jaccard_neighbours(spark, sf):
    """Documents whose word sets have a Jaccard similarity of 0.5 or more with a query document's (ids divisible by 100), by 64-bit hashes of the words."""
    own = mine.held(_docs(spark, sf), ["doc_id"], w=F.array_distinct(_words()))
    d = own.select(F.col("doc_id").alias("id"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    near = retrieve.set_neighbours(d, d.where("id % 100 = 0").withColumnRenamed("id", "qid"), 0.5)
    return near.select("qid", "id", F.round(F.col("both") / F.col("either"), 6).alias("jaccard"))


@query(f"SELECT lang, token, df FROM (SELECT lang, t AS token, count(*) AS df FROM (SELECT lang, unnest(list_distinct({_TOK})) AS t FROM documents) GROUP BY 1, 2) WHERE df >= 2 AND length(token) >= 5")
def consensus_words(spark, sf):
    """Words of five letters or more that at least two documents of a language agree on."""
    c = _docs(spark, sf).select("lang", F.explode(F.array_distinct(_words())).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"))
    return c.where((F.col("df") >= 2) & (F.length("token") >= 5))


@query(f"SELECT left(t, 5) AS stem, count(*) AS n, count(DISTINCT t) AS words FROM (SELECT unnest({_TOK}) AS t FROM documents) WHERE length(t) >= 5 GROUP BY 1 HAVING count(DISTINCT t) >= 3")
def stem_families(spark, sf):
    w = _docs(spark, sf).select(F.explode(_words()).alias("t")).where(F.length("t") >= 5)
    return w.groupBy(F.left("t", F.lit(5)).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("words")).where("words >= 3")
