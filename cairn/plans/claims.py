"""Queries over claims: extraction from sentences, counts, comparison, chains, conflicts.

The sentences are made of the values of the tables, by a select that Spark and SQL share: the texts
of the tables are invented words that no rule matches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as cl
from .registry import capital, city, given, land, letters, person, query, sql_list, table

#: id, s, topic: what the tables say of customers, nations and parts, in sentences; a nation's second row has its topic beside it.
SENTENCES = given("t", f"""SELECT c_custkey AS id, {person('c_custkey')} || CASE c_custkey % 7 WHEN 3 THEN ' never saw it. ' ELSE ' saw it. ' END || {person('c_custkey')} || ' was born in ' || CAST(1700 + c_custkey % 200 AS STRING) || '. ' || {person('c_custkey')} || ' was born in ' || {city('c_nationkey')} || '. '
  || {person('c_custkey')} || ' was a ' || CASE c_custkey % 3 WHEN 0 THEN 'keen physicist. ' WHEN 1 THEN 'famous composer. ' ELSE 'German painter. ' END || {person('c_custkey')} || ' died in ' || CAST(1730 + c_custkey % 300 AS STRING) || '.' AS s, CAST(NULL AS STRING) AS topic FROM customer
UNION ALL SELECT 10000000 + n_nationkey, {city('n_nationkey')} || ' is the capital of ' || {land('n_nationkey')} || '. ' || {land('n_nationkey')} || ' is a small country.', NULL FROM nation
UNION ALL SELECT 20000000 + n_nationkey, 'Its capital and largest city is ' || {city('n_nationkey')} || '.', {land('n_nationkey')} FROM nation
UNION ALL SELECT 30000000 + p_partkey, {person('p_partkey')} || ' invented ' || {capital(letters('p_partkey'))} || ' Loom. The ' || {capital(letters('p_size'))} || 'n Song was composed by ' || {person('p_partkey')} || '.', NULL FROM part""", "customer", "nation", "part")


def _claims_sql() -> str:
    parts = []
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    countries = f"MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in cl.COUNTRIES.items())}}}"
    for i, r in enumerate(cl.RULES):
        p = quoted(r.pattern)
        verb = f"'{r.verb}'" if isinstance(r.verb, str) else f"CASE regexp_extract(m, {p}, {r.verb}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cl.CANONICAL.items()) + f" ELSE regexp_extract(m, {p}, {r.verb}) END"
        obj = f"{countries}[lower(regexp_extract(m, {p}, {r.object}))]" if r.countries else f"regexp_extract(m, {p}, {r.object})"
        subj = f"regexp_extract(m, {p}, {r.subject})" if r.subject else "topic"
        parts.append(f"SELECT id, k - 1 + {1000 * i} AS pos, {subj} AS subj, {verb} AS verb, {obj} AS obj FROM (SELECT id, topic, unnest(regexp_extract_all(s, {p})) AS m, generate_subscripts(regexp_extract_all(s, {p}), 1) AS k FROM ok)")
    good = f"length(obj) >= 2 AND subj IS NOT NULL AND regexp_matches(subj, '^\\p{{Lu}}') AND lower(regexp_extract(subj, '^(\\S+)', 1)) NOT IN ({sql_list(cl.BAD_SUBJECT)})"
    return f"WITH ok AS (SELECT id, s, topic FROM {SENTENCES.sql} WHERE NOT regexp_matches(s, {quoted(cl.tx.NEGATION)})), every AS ({' UNION ALL '.join(parts)}), claims AS (SELECT id, min(pos) AS pos, subj, verb, obj FROM every WHERE {good} GROUP BY id, subj, verb, obj)"


_CLAIMS = _claims_sql()


def _claims(spark, sf):
    return cl.extract(SENTENCES.df(spark, sf), F.col("s"), ["id"], topic=F.col("topic"))


@query(_CLAIMS + " SELECT id, CAST(pos AS INT) AS pos, subj, verb, obj FROM claims")
def extracted_claims(spark, sf):
    return _claims(spark, sf)


@query(_CLAIMS + " SELECT DISTINCT subj FROM claims WHERE verb = 'is' AND contains(lower(obj), 'physicist')")
def distinct_enumeration(spark, sf):
    return cl.subjects(_claims(spark, sf), "is", "physicist")


@query(_CLAIMS + """, p AS (SELECT DISTINCT subj FROM claims WHERE verb = 'is' AND contains(lower(obj), 'composer')), b AS (SELECT DISTINCT subj FROM claims WHERE verb = 'born' AND obj = 'Hamburg')
SELECT p.subj FROM p WHERE p.subj IN (SELECT subj FROM b) OR regexp_extract(p.subj, '(\\S+)$', 1) IN (SELECT regexp_extract(subj, '(\\S+)$', 1) FROM b)""")
def semi_join_with_fallback(spark, sf):
    """Composers born in Hamburg, by full name or surname: two equi joins, not one with OR."""
    c = _claims(spark, sf)
    p = cl.subjects(c, "is", "composer")
    b = c.where("verb = 'born' and obj = 'Hamburg'").select("subj").distinct()
    by_surname = p.withColumn("k", cl.surname(F.col("subj"))).join(b.select(cl.surname(F.col("subj")).alias("k")).distinct(), "k", "left_semi").select("subj")
    return p.join(b, "subj", "left_semi").union(by_surname).distinct()


@query(_CLAIMS + " SELECT a.subj, a.obj AS mid, b.subj AS obj FROM (SELECT DISTINCT subj, obj FROM claims WHERE verb = 'born') a JOIN (SELECT DISTINCT subj, obj FROM claims WHERE verb = 'has_capital') b ON a.obj = b.obj")
def two_hop_join(spark, sf):
    """The country whose capital a person was born in."""
    c = _claims(spark, sf)
    inverse = c.where("verb = 'has_capital'").select("id", "pos", F.col("obj").alias("subj"), F.lit("capital_of").alias("verb"), F.col("subj").alias("obj"))
    return cl.two_hop(c.unionByName(inverse), "born", "capital_of")




ASKED = given("asked", f"SELECT c_custkey AS qid, {person('c_custkey')} AS a, {person('(c_custkey + 7)')} AS b FROM customer WHERE c_custkey % 100 = 0", "customer")
_SAME = "(c.subj = k.name OR contains(c.subj, k.name) OR contains(k.name, c.subj) OR regexp_extract(c.subj, '(\\S+)$', 1) = regexp_extract(k.name, '(\\S+)$', 1))"


@query(f"{_CLAIMS}, k AS (SELECT DISTINCT a AS name FROM {ASKED.sql} UNION SELECT b FROM {ASKED.sql}), y AS (SELECT name, arg_min(CAST(obj AS INT), (id, pos)) AS year FROM claims c JOIN k ON {_SAME} WHERE verb = 'born_year' AND regexp_matches(obj, '^\\d{{1,4}}$') GROUP BY name) SELECT qid, q.a, q.b, x.year AS year_a, y.year AS year_b, CASE WHEN x.year < y.year THEN q.a ELSE q.b END AS older FROM {ASKED.sql.replace('AS asked', 'AS q')} JOIN y x ON x.name = q.a JOIN y ON y.name = q.b")
def compare_first_match(spark, sf):
    """Who of two named people is older, by the first claim of a birth year whose subject has the name, is in it, or has its last word; equal years make it the second."""
    asked = ASKED.df(spark, sf)
    names = asked.select(F.col("a").alias("name")).union(asked.select("b")).distinct()
    y = cl.first_years(_claims(spark, sf), names, "born_year")
    pairs = asked.join(y.select(F.col("name").alias("a"), F.col("year").alias("year_a")), "a").join(y.select(F.col("name").alias("b"), F.col("year").alias("year_b")), "b")
    return pairs.select("qid", "a", "b", "year_a", "year_b", F.when(F.col("year_a") < F.col("year_b"), F.col("a")).otherwise(F.col("b")).alias("older"))


_YEARS = ", y AS (SELECT subj, arg_min(CAST(obj AS INT), (id, pos)) AS year FROM claims WHERE verb = 'born_year' AND regexp_matches(obj, '^\\d{1,4}$') GROUP BY subj)"


@query(_CLAIMS + ", d AS (SELECT subj, arg_min(CAST(obj AS INT), (id, pos)) AS died FROM claims WHERE verb = 'died_year' GROUP BY subj)" + _YEARS + " SELECT y.subj, d.died - y.year AS years FROM y JOIN d USING (subj)")
def lifespan(spark, sf):
    c = _claims(spark, sf)
    return cl.years(c, "born_year").join(cl.years(c, "died_year").withColumnRenamed("year", "died"), "subj").select("subj", (F.col("died") - F.col("year")).alias("years"))


@query(_CLAIMS + " SELECT verb, count(*) AS claims, count(DISTINCT subj) AS subjects, count(DISTINCT obj) AS objects FROM claims GROUP BY verb")
def claim_counts(spark, sf):
    return _claims(spark, sf).groupBy("verb").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("subj").alias("subjects"), F.count_distinct("obj").alias("objects"))


#: id, s: what customers may say of themselves.
FACTS = given("t", f"""SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'My name is ' || {person('c_custkey')} || '. Hello' WHEN 1 THEN 'I live in ' || {city('c_nationkey')} WHEN 2 THEN 'I am from ' || {land('c_nationkey')} || '!' WHEN 3 THEN 'I am a ' || lower(c_mktsegment) || ' engineer'
  WHEN 4 THEN 'I have ' || CAST(c_custkey % 7 AS STRING) || ' black cats' WHEN 5 THEN 'I work for ' || {person('c_custkey')} || ' & Sons' WHEN 6 THEN 'remember that the key is ' || {letters('c_custkey')} WHEN 7 THEN 'my favorite color is deep ' || {letters('c_nationkey')} || '.' ELSE 'Is my name ' || {person('c_custkey')} || '?' END AS s FROM customer""", "customer")


def _facts_sql() -> str:
    parts = []
    for r in cl.USER_FACTS:
        p, (before, after), groups = r.pattern.replace("'", "''"), r.template.replace("'", "''").split("%s"), 2 if "%a" in r.template else 1
        start = f"'{before.replace('%a', "' || lower(trim(regexp_extract(m, '" + p + "', 1))) || '")}'"
        parts.append(f"SELECT id, '{r.kind}' AS kind, {start} || rtrim(trim(regexp_extract(m, '{p}', {groups})), '.,!?') || '{after}' AS fact FROM (SELECT id, unnest(regexp_extract_all(s, '{p}')) AS m FROM t WHERE NOT regexp_matches(trim(s), '\\?$'))" + (f" WHERE lower(trim(regexp_extract(m, '{p}', 1))) <> 'name'" if groups == 2 else ""))
    return f"WITH t AS (SELECT * FROM {FACTS.sql}) {' UNION ALL '.join(parts)}"


@query(_facts_sql())
def user_fact_rules(spark, sf):
    return cl.user_facts(FACTS.df(spark, sf), F.col("s"), ["id"])


@query("""WITH v AS (SELECT o_custkey AS slot, o_orderstatus AS value, o_orderpriority AS source, (o_orderdate, o_orderkey) AS moment FROM orders),
g AS (SELECT slot, arg_max(value, moment) AS newest, list_sort(list_distinct(list(value))) AS all_, count(DISTINCT source) AS s FROM v GROUP BY slot)
SELECT slot, newest, array_to_string(list_filter(all_, lambda x: x <> newest), ',') AS others FROM g WHERE len(all_) > 1 AND s > 1""")
def conflict_detection(spark, sf):
    """Customers whose orders of different priorities tell different statuses; the newest wins."""
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("source"), F.struct("o_orderdate", "o_orderkey").alias("moment"))
    return cl.conflicts(v, "slot", "value", "source", "moment")


@query("""SELECT c_mktsegment AS thing, CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) = 1 THEN 'one: ' || min(c_name) WHEN count(*) <= 12 THEN count(*) || ': ' || string_agg(c_name, ', ' ORDER BY c_name)
  ELSE count(*) || ', such as ' || array_to_string(list_sort(list(c_name))[1:12], ', ') END AS answer FROM customer GROUP BY 1""")
def count_dispatch(spark, sf):
    """A count in words: one, a list of up to twelve, or the first twelve of more."""
    from ..functions.hv import top_k

    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("thing"), "c_name")
    n = c.groupBy("thing").agg(F.count(F.lit(1)).alias("n"))
    names = top_k(c, ["thing"], [F.col("c_name")], 12).groupBy("thing").agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    joined = F.array_join("names", ", ")
    text = F.when(F.col("n") == 1, F.concat(F.lit("one: "), joined)).when(F.col("n") <= 12, F.concat(F.col("n").cast("string"), F.lit(": "), joined)).otherwise(F.concat(F.col("n").cast("string"), F.lit(", such as "), joined))
    return n.join(names, "thing").select("thing", text.alias("answer"))
