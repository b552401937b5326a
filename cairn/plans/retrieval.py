"""Queries that search: nearest neighbours of vectors and words, votes, reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hv
from ..functions import numeric as num
from ..functions import text as tx
from ..operators import blockmax, retrieve, subcodes
from ..sources.tables import scratch_dir, stored
from .registry import ORACLE_SQL, query, table


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e, rows, rows.where("id % 100 = 0").withColumnRenamed("id", "qid")


def _knn_sql(k: int) -> str:
    return f"""SELECT qid, id, sim, rn AS rank FROM (SELECT q.vec_id AS qid, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS sim,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) DESC, r.vec_id) AS rn FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id) WHERE rn <= {k}"""


@query(f"SELECT qid, id, round(sim, 6) AS sim, rank FROM ({_knn_sql(5)})")
def cosine_knn(spark, sf):
    _, rows, q = _vectors(spark, sf)
    return retrieve.cosine_knn(rows, q, 5).select("qid", "id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT qid, id, round(sim, 6) AS sim, rank FROM ({_knn_sql(5)}) WHERE sim >= 0.3")
def knn_threshold_after_k(spark, sf):
    """The threshold applies to the five best, not before."""
    _, rows, q = _vectors(spark, sf)
    return retrieve.cosine_knn(rows, q, 5).where("sim >= 0.3").select("qid", "id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH v AS (SELECT qid, label, sum(1 / (2 - sim)) AS w FROM ({_knn_sql(12)}) k JOIN embeddings e ON e.vec_id = k.id GROUP BY 1, 2),
r AS (SELECT qid, label, w / sum(w) OVER (PARTITION BY qid) AS share, row_number() OVER o AS rn, lead(w) OVER o AS next, w FROM v WINDOW o AS (PARTITION BY qid ORDER BY round(w, 9) DESC, label))
SELECT qid, label, round(share, 6) AS share, round((w - coalesce(next, 0)) / w * share, 6) AS margin FROM r WHERE rn = 1""")
def knn_label_vote(spark, sf):
    e, rows, q = _vectors(spark, sf)
    v = retrieve.label_vote(retrieve.cosine_knn(rows, q, 12), e.select(F.col("vec_id").alias("id"), "label"))
    return v.select("qid", "label", F.round("share", 6).alias("share"), F.round("margin", 6).alias("margin"))


@query(f"""WITH g AS (SELECT qid, sum(1 / (2 - sim) * label) / sum(1 / (2 - sim)) AS mean, stddev_pop(label) AS std FROM ({_knn_sql(12)}) k JOIN embeddings e ON e.vec_id = k.id GROUP BY 1)
SELECT qid, round(mean, 6) AS mean, round(std, 6) AS std, round(1 / (1 + std / greatest(1, abs(mean))), 6) AS agreement FROM g""")
def knn_regression(spark, sf):
    e, rows, q = _vectors(spark, sf)
    r = retrieve.regression(retrieve.cosine_knn(rows, q, 12), e.select(F.col("vec_id").alias("id"), F.col("label").alias("value")))
    return r.select("qid", *[F.round(c, 6).alias(c) for c in ("mean", "std", "agreement")])


@query(f"SELECT count(*) AS n, round(avg(1 - sim), 6) AS mean, round(min(1 - sim), 6) AS least, round(max(1 - sim), 6) AS most FROM ({_knn_sql(1)})")
def nn_distance_stats(spark, sf):
    _, rows, q = _vectors(spark, sf)
    d = 1 - F.col("sim")
    return retrieve.cosine_knn(rows, q, 1).agg(F.count(F.lit(1)).alias("n"), *[F.round(f(d), 6).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"))])


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], c) AS sim FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, label) AS rn, max(sim) OVER (PARTITION BY vec_id) AS best FROM s)
SELECT vec_id, label, round(sim, 6) AS sim FROM r WHERE rn <= 3 AND (rn = 1 OR sim >= 0.85 * best)""")
def zero_shot_labels(spark, sf):
    """The three nearest label centroids of each vector that reach 0.85 of the best."""
    e = table(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    all_ = centre.groupBy().agg(F.collect_list(F.struct("label", "c")).alias("all"))  # as many as labels
    s = e.select("vec_id", "embedding").join(F.broadcast(all_), F.lit(True)).select("vec_id", "embedding", F.explode("all").alias("x")).select("vec_id", F.col("x.label").alias("label"), num.cosine(F.col("embedding"), F.col("x.c")).alias("sim"))
    w = Window.partitionBy("vec_id")
    r = s.select("*", F.row_number().over(w.orderBy(F.desc(F.round("sim", 9)), "label")).alias("rn"), F.max("sim").over(w).alias("best"))
    return r.where("rn <= 3 and (rn = 1 or sim >= 0.85 * best)").select("vec_id", "label", F.round("sim", 6).alias("sim"))


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_-]+')"


def _postings(spark, sf):
    """The inverted index of the documents, written once, and the idf of its words."""
    d = table(spark, sf, "documents")
    index = stored(retrieve.postings(d, "doc_id", tx.lower_tokens(F.col("text"))), f"{scratch_dir(spark)}/postings")
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return index, df.select("token", num.idf(F.lit(d.count()), F.col("df")).alias("idf"))


@query(f"""WITH p AS (SELECT doc_id AS id, unnest(list_distinct({_TOK})) AS token FROM documents), d AS (SELECT token, least(6, greatest(0.5, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1)) AS idf FROM p GROUP BY token),
q AS (SELECT DISTINCT unnest({_TOK}) AS token FROM benchmark), w AS (SELECT token FROM q JOIN d USING (token) WHERE idf >= 4 AND length(token) >= 4)
SELECT token, id, rn AS rank FROM (SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY id) AS rn FROM p JOIN w USING (token)) WHERE rn <= 8""")
def content_injection(spark, sf):
    """The first eight documents that hold each rare word of the benchmark."""
    words = tx.lower_tokens(F.col("text"))
    index, df = _postings(spark, sf)
    rare = table(spark, sf, "benchmark").select(F.explode(words).alias("token")).distinct().join(df, "token").where((F.col("idf") >= 4) & (F.length("token") >= 4)).select("token")
    return retrieve.first_holders(index, rare, 8).select("token", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH p AS (SELECT doc_id AS id, unnest(list_distinct({_TOK})) AS token FROM documents), d AS (SELECT token, least(6, greatest(0.5, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1)) AS idf FROM p GROUP BY token),
q AS (SELECT DISTINCT item_id AS qid, unnest({_TOK}) AS token FROM benchmark), x AS (SELECT qid, q.token, idf FROM q JOIN d USING (token) WHERE idf >= 3),
s AS (SELECT qid, id, 0.05 * idf AS weight FROM x JOIN p USING (token) UNION ALL SELECT DISTINCT qid, id, w FROM (SELECT qid, id, x.token, 0.04 * idf AS w FROM x JOIN p ON length(x.token) >= 5 AND length(p.token) >= 5 AND left(x.token, 5) = left(p.token, 5) AND x.token <> p.token
  WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.id = p.id AND o.token = x.token)))
SELECT qid, id, score, rn AS rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM (SELECT qid, id, round(sum(weight), 6) AS score FROM s GROUP BY 1, 2)) WHERE rn <= 5""")
def hybrid_rerank(spark, sf):
    """The five best documents for each benchmark text: 0.05 idf for a shared rare word, 0.04 idf for one that only shares a stem."""
    words = tx.lower_tokens(F.col("text"))
    index, df = _postings(spark, sf)
    x = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(words)).alias("token")).join(df, "token").where("idf >= 3")
    whole = x.join(index, "token").select("qid", "id", "token", "idf")
    stem = F.left("token", F.lit(5)).alias("stem")
    long = F.length("token") >= 5
    # a document without the word that has its stem has it by another word, so a document's stems, each once, are enough
    stems = x.where(long).select("qid", "token", "idf", stem).join(index.where(long).select("id", stem).distinct(), "stem")
    only = stems.select("qid", "id", "token", "idf").join(whole.select("qid", "id", "token"), ["qid", "id", "token"], "left_anti")
    evidence = whole.select("qid", "id", (0.05 * F.col("idf")).alias("weight")).unionAll(only.select("qid", "id", (0.04 * F.col("idf")).alias("weight")).distinct())
    return retrieve.rerank(evidence, 5).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


_STOP = ", ".join(f"'{w}'" for w in tx.QUESTION_STOPWORDS)
_TARGET = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{w}'" for p, w in blockmax.TARGETS) + " END"


def _content_sql(text: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_-]+'), lambda x: x NOT IN ({_STOP})))"


def _object_sql() -> str:
    return "coalesce(" + ", ".join("nullif(regexp_extract(text, '" + p.replace("'", "''") + "', 1), '')" for p in blockmax.OBJECTS) + ", '')"


#: Every row is scored for every question that shares a word, a stem or a title word with it.
_FULL_RERANK = rf"""WITH d0 AS (SELECT doc_id AS id, coalesce(text, '') AS text, CASE WHEN contains(text, chr(10)) AND len(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\p{{L}}\p{{N}}_-]+')) <= {blockmax.TITLE_WORDS} THEN string_split(text, chr(10))[1] ELSE '' END AS title FROM documents),
d AS (SELECT id, {_content_sql("text")} AS words, {_content_sql("title")} AS title, {_content_sql("substr(text, length(title) + 1)")} AS body FROM d0),
e AS (SELECT id, words, title, len(words) AS n, CASE len(list_intersect(title, body)) WHEN 0 THEN 0.0 WHEN 1 THEN {blockmax.INTRO_ONE} ELSE {blockmax.INTRO} * len(list_intersect(title, body)) END AS intro FROM d),
p AS (SELECT id, unnest(words) AS w FROM e), f AS (SELECT w, count(*) AS df FROM p GROUP BY w), tp AS (SELECT id, unnest(title) AS w FROM e),
q AS (SELECT item_id AS qid, {_content_sql("text")} AS words, {_content_sql(_object_sql())} AS about, {_TARGET} AS target FROM benchmark),
x AS (SELECT qid, size, u.w, list_contains(about, u.w) AS about, least(6, greatest(0.5, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) + 1)) AS idf FROM (SELECT qid, len(words) AS size, about, unnest(words) AS w FROM q) u LEFT JOIN f USING (w)),
k AS (SELECT qid, w FROM (SELECT qid, w, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, w DESC) AS rn FROM x) WHERE rn <= 2),
sh AS (SELECT qid, id, count(*) AS k, sum(CASE WHEN about THEN 0 ELSE idf END) AS p, sum(CASE WHEN about THEN idf ELSE 0 END) AS a FROM x JOIN p USING (w) GROUP BY 1, 2),
ds AS (SELECT DISTINCT id, left(w, 5) AS s FROM p WHERE length(w) >= 5),
xs AS (SELECT qid, left(w, 5) AS s, max((idf, about)) AS best FROM x WHERE length(w) >= 5 GROUP BY 1, 2),
st AS (SELECT qid, id, sum(CASE WHEN best[2] THEN 0 ELSE best[1] END) AS sp, sum(CASE WHEN best[2] THEN best[1] ELSE 0 END) AS sa FROM xs JOIN ds USING (s) WHERE NOT EXISTS (SELECT 1 FROM x JOIN p USING (w) WHERE x.qid = xs.qid AND p.id = ds.id AND length(w) >= 5 AND left(w, 5) = xs.s) GROUP BY 1, 2),
ti AS (SELECT qid, id, sum(idf) AS t FROM x JOIN tp USING (w) GROUP BY 1, 2),
ta AS (SELECT qid, id FROM q JOIN p ON p.w = q.target),
ky AS (SELECT qid, id FROM k JOIN p USING (w) UNION SELECT qid, id FROM k JOIN ds ON length(k.w) >= 5 AND left(k.w, 5) = ds.s),
ga AS (SELECT qid, id FROM ky UNION SELECT qid, id FROM ti UNION SELECT qid, id FROM ta),
sc AS (SELECT qid, id, round(coalesce(sh.k, 0) / sqrt(len(q.words) * e.n) + {blockmax.WORD} * (coalesce(p, 0) + CASE WHEN coalesce(t, 0) > 0 OR ta.id IS NOT NULL THEN 1 ELSE {blockmax.OBJECT} END * coalesce(a, 0))
  + {blockmax.STEM} * (coalesce(sp, 0) + CASE WHEN coalesce(t, 0) > 0 OR ta.id IS NOT NULL THEN 1 ELSE {blockmax.OBJECT} END * coalesce(sa, 0)) + {blockmax.TITLE} * coalesce(t, 0)
  + CASE WHEN coalesce(sh.k, 0) > 0 OR coalesce(t, 0) > 0 OR coalesce(sp, 0) + coalesce(sa, 0) > 0 THEN intro ELSE 0 END + CASE WHEN ta.id IS NULL THEN 0 WHEN coalesce(t, 0) > 0 THEN {blockmax.TARGET} ELSE {blockmax.WEAK_TARGET} END, 6) AS score
  FROM ga JOIN e USING (id) JOIN q USING (qid) LEFT JOIN sh USING (qid, id) LEFT JOIN st USING (qid, id) LEFT JOIN ti USING (qid, id) LEFT JOIN ta USING (qid, id))
SELECT qid, id, score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM sc) WHERE rn <= 5"""


@query(_FULL_RERANK)
def block_max_rerank(spark, sf):
    """The five best documents for each benchmark text by words, stems, titles, introductions and targets, over block-max postings."""
    blocks, sizes = blockmax.index(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), ["lang", "id"])
    best, _ = blockmax.rerank(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), blocks, sizes, 5)
    return best.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


_TYPOS = ["NATION_1O", "NATON_24", "NATIN_3", "NATION_", "XXXXXX", "NAION_17", "NATIO_9", "NATION_22"]


@query(f"WITH w AS (SELECT unnest([{', '.join(repr(t) for t in _TYPOS)}]) AS word), d AS (SELECT word, n_name AS name, levenshtein(word, n_name) AS d FROM w, nation), m AS (SELECT word, min(d) AS m FROM d WHERE d <= 2 GROUP BY word) SELECT word, min(name) AS name, CAST(min(m) AS INT) AS distance FROM d JOIN m USING (word) WHERE d = m GROUP BY word HAVING count(*) = 1")
def typo_match(spark, sf):
    words = spark.createDataFrame([(t,) for t in _TYPOS], "word string")
    return retrieve.unique_nearest_name(words, table(spark, sf, "nation").select(F.col("n_name").alias("name")))


def _record(spark, sf):
    """Customers as the majority of three bound role-value pairs."""
    c = table(spark, sf, "customer")
    balance = tx.bucket(F.col("c_acctbal"), [0.0, 3000.0, 6000.0], ["neg", "low", "mid", "high"])
    pair = lambda role, value: hv.bind(hv.atom(F.lit(role)), hv.atom(value))
    a, b, d = pair("segment", F.col("c_mktsegment")), pair("nation", F.col("c_nationkey").cast("string")), pair("balance", balance)
    return c.select("c_custkey", "c_mktsegment", hv.majority3(a, b, d).alias("hv"))


def _atom_sql(label: str, lane: int) -> str:
    return f"('0x' || substr(md5(({label}) || '#{lane}'), 1, 15))::BIGINT"


def _record_sql() -> str:
    balance = "CASE WHEN c_acctbal IS NULL THEN 'none' WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END"
    lanes = []
    for i in range(hv.SMALL):
        x = [f"xor({_atom_sql(repr(r), i)}, {_atom_sql(v, i)})" for r, v in (("segment", "c_mktsegment"), ("nation", "CAST(c_nationkey AS VARCHAR)"), ("balance", balance))]
        lanes.append(f"({x[0]} & {x[1]}) | ({x[0]} & {x[2]}) | ({x[1]} & {x[2]})")
    return f"SELECT c_custkey, c_mktsegment, [{', '.join(lanes)}] AS hv FROM customer"


@query(f"SELECT c_custkey, {', '.join(f'hv[{i + 1}] AS lane{i}' for i in range(hv.SMALL))} FROM ({_record_sql()})")
def record_encode(spark, sf):
    return _record(spark, sf).select("c_custkey", *[F.get("hv", F.lit(i)).alias(f"lane{i}") for i in range(hv.SMALL)])


_HAMMING = " + ".join(f"bit_count(xor(q.hv[{i + 1}], r.hv[{i + 1}]))" for i in range(hv.SMALL))


@query(f"""WITH v AS ({_record_sql()}), d AS (SELECT q.c_custkey AS qid, r.c_custkey AS id, CAST({_HAMMING} AS BIGINT) AS distance FROM v q JOIN v r ON q.c_custkey % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rn FROM d) SELECT qid, id, distance, rn AS rank, round(1 - 2 * distance / {60.0 * hv.SMALL}, 6) AS sim_pm1 FROM k WHERE rn <= 5""")
def hamming_knn(spark, sf):
    """The five nearest customers by record vector, for the customers whose key is divisible by 100."""
    rows = _record(spark, sf).select(F.col("c_custkey").alias("id"), "hv")
    k = hv.knn(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5)
    return k.select("qid", "id", "distance", F.col("rank").cast("long").alias("rank"), F.round(hv.sim_pm1(F.col("distance"), hv.SMALL), 6).alias("sim_pm1"))


@query(ORACLE_SQL["hamming_knn"])
def hamming_knn_index(spark, sf):
    """The same over a stored index of sub-codes: no pass over the rows, and no query goes through the driver."""
    rows = _record(spark, sf).select(F.col("c_custkey").alias("id"), "hv")
    index = subcodes.index(rows, 5, hv.SMALL)
    k = subcodes.nearest(index, rows.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5, hv.SMALL)
    return k.select("qid", "id", "distance", F.col("rank").cast("long").alias("rank"), F.round(hv.sim_pm1(F.col("distance"), hv.SMALL), 6).alias("sim_pm1"))


def _document_words(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.lower_tokens(F.col("text")).alias("words"))


@query()
def document_vectors_knn(spark, sf):
    """The three documents nearest to each query document (ids divisible by 100) by full-width bundles of their words."""
    v = stored(hv.text_vectors(_document_words(spark, sf)), f"{scratch_dir(spark)}/vectors")  # made once, for rows and queries
    return hv.knn(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 3)


_SMALL_VECTORS = rf"""WITH w AS (SELECT doc_id, t, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_-]+')) AS t FROM documents) GROUP BY 1, 2),
a AS (SELECT t, i, ('0x' || substr(md5(t || '#' || i), 1, 15))::BIGINT AS x FROM (SELECT DISTINCT t FROM w), range(0, {hv.SMALL}) r(i)),
b AS (SELECT doc_id, i, j, 2 * sum(k * ((x >> j) & 1)) > sum(k) AS bit FROM w JOIN a USING (t), range(0, {hv.LANE_BITS}) s(j) GROUP BY 1, 2, 3),
v AS (SELECT d.doc_id, i, coalesce(x, 0) AS x FROM (SELECT doc_id, i FROM documents, range(0, {hv.SMALL}) r(i)) d LEFT JOIN (SELECT doc_id, i, CAST(sum(CASE WHEN bit THEN 1::BIGINT << j ELSE 0 END) AS BIGINT) AS x FROM b GROUP BY 1, 2) USING (doc_id, i)),
p AS (SELECT q.doc_id AS qid, r.doc_id AS id, CAST(sum(bit_count(xor(q.x, r.x))) AS BIGINT) AS distance FROM v q JOIN v r ON q.i = r.i WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT qid, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM p) WHERE rank <= 3"""


@query(_SMALL_VECTORS)
def document_vectors_small_knn(spark, sf):
    """The same with vectors of 120 bits, whose atoms SQL can make."""
    d = _document_words(spark, sf)
    made = lambda rows: hv.text_vectors(rows, lanes=hv.SMALL, atoms=hv.md5_atoms)
    return hv.knn(made(d), made(d.where("id % 100 = 0")).withColumnRenamed("id", "qid"), 3)
