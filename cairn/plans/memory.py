"""Queries on the memory table: scans, filters, appends, deletes, dedup, look-ups, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hv import top_k
from ..operators import store
from .registry import query, table

_KINDS = ["wikipedia", "user_taught", "wisdom", "legacy", "url", "code", "user_msg", "agent_response", "conversation_turn", "image", "video"]
_MEM = "SELECT doc_id AS id, text, [" + ", ".join(f"'{k}'" for k in _KINDS) + "][CAST(doc_id % 11 AS INT) + 1] || ':' || source AS source, lang FROM documents"


def memories(spark, sf):
    """documents as memory rows: id, text, source (kind:name), lang."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 11 + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(kind, F.lit(":"), "source").alias("source"), "lang")


@query(f"SELECT id, source, lang FROM ({_MEM}) WHERE regexp_matches(source, '^(wikipedia:|user_taught|wisdom:|legacy:|url:|code:)')")
def corpus_rows(spark, sf):
    return store.corpus(memories(spark, sf)).select("id", "source", "lang")


@query(f"SELECT id, source FROM ({_MEM}) WHERE NOT regexp_matches(source, '^(user_msg|agent_response|conversation_turn|image:|video:)')")
def echo_exclusion(spark, sf):
    return store.without_echoes(memories(spark, sf)).select("id", "source")


@query(f"SELECT id, split_part(source, ':', 2) AS path FROM ({_MEM}) WHERE source LIKE 'image:%'")
def sights(spark, sf):
    return store.by_kind(memories(spark, sf), "image").select("id", "path")


@query("SELECT DISTINCT p_name AS word FROM part WHERE starts_with(p_name, 'small') ORDER BY word LIMIT 25")
def prefix_search(spark, sf):
    return store.prefix_search(table(spark, sf, "part"), "p_name", "small", 25).withColumnRenamed("p_name", "word")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_dedup(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return d.where("copies > 1")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def first_occurrences(spark, sf):
    return store.first_per_key(table(spark, sf, "documents").where("text is not null"), "text", "doc_id").select("doc_id")


@query("SELECT d.doc_id FROM documents d WHERE d.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def anti_dedup_benchmark(spark, sf):
    return store.not_stored(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "text").select("doc_id")


@query(f"SELECT m.id, m.source FROM ({_MEM}) m WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.id AND l.toxic = 1)")
def delete_by_ids(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.delete_ids(memories(spark, sf), gone)[0].select("id", "source")


@query(f"SELECT m.id, m.source FROM ({_MEM}) m SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = m.id WHERE m.source LIKE 'image:%'")
def deleted_images(spark, sf):
    """The image rows that a delete cascades to."""
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.by_kind(store.delete_ids(memories(spark, sf), gone)[1], "image").select("id", "source")


@query("SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY conv_id, turn) AS id, text, '{\"role\":\"' || role || '\"}' AS metadata FROM conversations")
def appended_rows(spark, sf):
    """Turns as new memory rows: ids go on after the largest, metadata as JSON."""
    new = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.to_json(F.struct("role")).alias("metadata"))
    return store.with_new_ids(memories(spark, sf), new, ["conv_id", "turn"]).select("id", "text", "metadata")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_id = 17")
def point_lookup(spark, sf):
    e = table(spark, sf, "events").where("event_id = 17")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(f"SELECT count(*) AS rows, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM ({_MEM})")
def memory_stats(spark, sf):
    return store.stats(memories(spark, sf))


@query(f"SELECT split_part(source, ':', 1) AS kind, count(*) AS n, min(id) AS first FROM ({_MEM}) GROUP BY 1")
def rows_per_kind(spark, sf):
    return memories(spark, sf).groupBy(store.kind(F.col("source")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


_WORD = r"[\p{L}\p{N}_-]+"


def _inner_words(col):
    """The words with other characters before and after them: whole words of any text that holds col."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(rf"(?<=[^\p{{L}}\p{{N}}_-]){_WORD}(?=[^\p{{L}}\p{{N}}_-])"), F.lit(0)))


def occurrences(items, rows):
    """item_id, id, source: each row of items (item_id, wanted) with each row of rows (id, text, source) whose text contains it.

    They meet at the item's inner word that the fewest rows hold; items without inner words
    are compared with every row.
    """
    texts = items.where("wanted is not null").select("wanted").distinct().withColumn("inner", _inner_words(F.col("wanted")))
    inner = texts.select("wanted", F.explode("inner").alias("word"))
    words = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("word"))
    words = words.join(inner.select("word").distinct(), "word", "left_semi")
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    anchor = inner.join(often, "word", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))["word"].alias("word"))
    near = words.join(anchor, "word").select(F.col("id").alias("id_"), "wanted").distinct()
    found = near.join(rows, F.col("id_").eqNullSafe(F.col("id"))).where(F.contains("text", F.col("wanted"))).select("wanted", "id", "source")
    short = texts.where(F.size("inner") == 0).select("wanted")
    rest = rows.join(F.broadcast(short), F.contains("text", F.col("wanted"))).select("wanted", "id", "source")
    return found.union(rest).join(items, "wanted").select("item_id", "id", "source")


@query(f"SELECT b.item_id, count(*) AS n, min(m.id) AS id, arg_min(m.source, m.id) AS source FROM benchmark b JOIN ({_MEM}) m ON contains(m.text, b.text) GROUP BY b.item_id")
def provenance_lookup(spark, sf):
    """Where each benchmark text occurs whole: its first row and source."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("wanted"))
    return occurrences(b, memories(spark, sf)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min_by("source", "id").alias("source"))


@query("SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, md5(CAST(p_partkey AS VARCHAR) || 'seed') AS h FROM part WHERE length(p_name) BETWEEN 5 AND 240) ORDER BY h, p_partkey LIMIT 1")
def random_fact(spark, sf):
    """One row at random but repeatably: by a hash with a seed."""
    p = table(spark, sf, "part").where(F.length("p_name").between(5, 240))
    return p.orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("seed")).cast("binary")), "p_partkey").limit(1).select("p_partkey", "p_name")


@query("""SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2
  UNION ALL SELECT n_name, 'suppliers', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def nested_lookup_counts(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    one = n.join(r, n.n_regionkey == r.r_regionkey).join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))
    two = n.join(s, n.n_nationkey == s.s_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")).select("n_name", F.lit("suppliers").alias("r_name"), "n")
    return one.unionByName(two)


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 20")
def top_n_per_group(spark, sf):
    return top_k(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 20).select("c_nationkey", "c_custkey", "c_name")
