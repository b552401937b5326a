"""Queries over facts: triples, magnitudes, votes on years, roles, life dates, analogies, look-ups in the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..operators import claims as cl
from ..operators import facts as fa
from .claims import _CLAIMS, _claims
from .registry import capital, city, given, land, letters, literal, person, query, sql_list, table

#: id, s: what the tables say of nations, in the words of country texts.
COUNTRY_TEXTS = given("t", f"""SELECT n_nationkey AS id, {city('n_nationkey')} || ' is the capital of ' || {land('n_nationkey')} || '. Goods in ' || {land('n_nationkey')} || ' are priced in ' || {letters('n_regionkey')} || 'sol.' AS s FROM nation
UNION ALL SELECT 100 + n_nationkey, 'The capital city of ' || {land('n_nationkey')} || ' is ' || {capital(letters('n_nationkey'))} || 'burg. ' || {land('n_nationkey')} || ' is a country located in East ' || upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) || '.' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 10000 + s_suppkey, 'Flights to ' || {land('s_nationkey')} || ' usually arrive at ' || {capital(letters('s_suppkey'))} || 'port. People in ' || {land('s_nationkey')} || ' primarily speak ' || {capital(letters('s_nationkey'))} || 'ish.' FROM supplier""", "nation", "region", "supplier")


def _triples_sql() -> str:
    parts = []
    for p, relation, subject, objects in fa.TRIPLES:
        q = "'" + fa.triple_pattern(p).replace("'", "''") + "'"
        for g in objects:
            s, o = f"regexp_extract(m, {q}, {subject})", f"regexp_extract(m, {q}, {g})"
            made = f"(SELECT id, unnest(regexp_extract_all(s, {q})) AS m FROM {COUNTRY_TEXTS.sql})"
            parts.append(f"SELECT id, {s} AS s, '{relation}' AS r, {o} AS o FROM {made}")
            if relation in fa.INVERSE:
                parts.append(f"SELECT id, {o}, '{fa.INVERSE[relation]}', {s} FROM {made}")
    return " UNION ".join(parts)


@query(_triples_sql())
def kg_triples(spark, sf):
    return fa.triples(COUNTRY_TEXTS.df(spark, sf), F.col("s"), ["id"])


NAMES = given("n", f"SELECT CASE c_custkey % 5 WHEN 0 THEN 'Who knows' WHEN 1 THEN 'the ' || {letters('c_custkey')} WHEN 2 THEN 'These ' || {person('c_custkey')} WHEN 3 THEN lower(c_name) ELSE {person('c_custkey')} END AS name FROM customer", "customer")


@query(f"SELECT name FROM {NAMES.sql} WHERE name <> '' AND regexp_matches(name, '^\\p{{Lu}}') AND lower(regexp_extract(name, '^(\\S+)', 1)) NOT IN ({sql_list(cl.BAD_SUBJECT)})")
def good_subjects(spark, sf):
    return NAMES.df(spark, sf).where(cl.good_subject(F.col("name")))


RELATED = given("r", f"SELECT {letters('p_partkey')} AS word, CASE p_size % 3 WHEN 0 THEN 'hypernyms' WHEN 1 THEN 'synonyms' ELSE 'derived' END AS relation, CASE p_size % 7 WHEN 0 THEN 'tree' WHEN 1 THEN 'oak' ELSE p_name END AS target FROM part", "part")


@query(f"SELECT target, relation, string_agg(word, ' ' ORDER BY word) AS words, count(*) AS n FROM {RELATED.sql} WHERE target IN ('tree', 'oak') GROUP BY 1, 2")
def inverse_relations(spark, sf):
    """Which words name a word as their relative."""
    r = RELATED.df(spark, sf).where(F.col("target").isin("tree", "oak"))
    return r.groupBy("target", "relation").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"), F.count(F.lit(1)).alias("n"))


YEARS = given("y", f"SELECT {person('c_custkey')} AS topic, CASE WHEN c_custkey % 3 > 0 THEN CAST(1700 + c_custkey % 200 AS INT) END AS born, CASE WHEN c_custkey % 4 > 0 THEN CAST(1760 + c_custkey % 200 AS INT) END AS died FROM customer", "customer")
_OVERLAY = f"{_CLAIMS}, x AS (SELECT topic AS subj, 'born_year' AS verb, CAST(born AS VARCHAR) AS obj, 'dates' AS origin FROM {YEARS.sql} WHERE born IS NOT NULL UNION ALL SELECT topic, 'died_year', CAST(died AS VARCHAR), 'dates' FROM {YEARS.sql} WHERE died IS NOT NULL)"


@query(f"{_OVERLAY} SELECT subj, verb, obj, 'text' AS origin FROM claims WHERE verb IN ('born_year', 'died_year') UNION ALL SELECT * FROM x")
def dated_claims(spark, sf):
    """Claims of years from the texts, with those of a table of years beside them."""
    y = YEARS.df(spark, sf).selectExpr("topic as subj", "stack(2, 'born_year', cast(born as string), 'died_year', cast(died as string)) as (verb, obj)").where("obj is not null")
    own = _claims(spark, sf).where("verb in ('born_year', 'died_year')").select("subj", "verb", "obj", F.lit("text").alias("origin"))
    return own.unionByName(y.withColumn("origin", F.lit("dates")))


BORN = given("b", f"SELECT {person('c_custkey')} AS subj, CASE c_nationkey % 5 WHEN 0 THEN 'Poland' WHEN 1 THEN 'polish' WHEN 2 THEN 'Sweden' WHEN 3 THEN 'German' ELSE 'China' END AS obj FROM customer", "customer")
ASKED_COUNTRIES = given("c", "SELECT CASE r_regionkey WHEN 0 THEN 'Poland' WHEN 1 THEN 'Germany' WHEN 2 THEN 'swedish' ELSE r_name END AS country FROM region", "region")
_MAP = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in cl.COUNTRIES.items()) + ") AS d(adjective, country)"


@query(f"""WITH a AS (SELECT country AS asked, lower(country) AS k FROM {ASKED_COUNTRIES.sql} UNION SELECT c.country, adjective FROM {ASKED_COUNTRIES.sql} JOIN {_MAP} ON lower(d.country) = lower(c.country) UNION SELECT c.country, lower(d.country) FROM {ASKED_COUNTRIES.sql} JOIN {_MAP} ON d.adjective = lower(c.country))
SELECT DISTINCT asked, subj FROM a JOIN {BORN.sql} ON lower(b.obj) = a.k""")
def born_in_either_form(spark, sf):
    """Who was born in a country, asked and told by its name or its adjective."""
    d = spark.createDataFrame(list(cl.COUNTRIES.items()), "adjective string, name string")
    c = ASKED_COUNTRIES.df(spark, sf).select(F.col("country").alias("asked"), F.lower("country").alias("k"))
    keys = c.union(c.join(d, F.lower("name") == F.col("k")).select("asked", "adjective")).union(c.join(d, F.col("adjective") == F.col("k")).select("asked", F.lower("name"))).distinct()
    return BORN.df(spark, sf).join(keys, F.lower("obj") == F.col("k")).select("asked", "subj").distinct()


_GRAPH = "(SELECT s_name AS s, 'in' AS r, n_name AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _graph(spark, sf):
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("s"), F.lit("in").alias("r"), F.col("n_name").alias("o")).union(n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", F.lit("part_of"), "r_name"))


@query(f"SELECT s, r, o FROM {_GRAPH} WHERE o IN ('ASIA', 'NATION_3')")
def kg_backward(spark, sf):
    """Facts by their object."""
    return _graph(spark, sf).where(F.col("o").isin("ASIA", "NATION_3"))


GRAPH_QUESTIONS = literal("q", "qid int, text string", [(1, "Which suppliers are in NATION_3 and NATION_4?"), (2, "tell me about ASIA"), (3, "is it so"), (4, "NATION_1 or the MIDDLE EAST")])
_NOISE = f"length(w) < 2 OR lower(w) IN ({sql_list(tx.NOISE_WORDS)}) OR regexp_matches(w, '^\\d{{1,2}}$')"


@query(f"""WITH f AS (SELECT * FROM {_GRAPH}), q AS (SELECT qid, list_filter(regexp_extract_all(text, '[A-Za-z][\\w-]*'), lambda w: NOT ({_NOISE})) AS w FROM {GRAPH_QUESTIONS.sql}),
g AS (SELECT DISTINCT qid, lower(k) AS k FROM (SELECT qid, unnest(w) AS k FROM q UNION ALL SELECT qid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM q)),
n AS (SELECT qid, name FROM (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY name) AS rn FROM g JOIN (SELECT s AS name FROM f UNION SELECT o FROM f) ON lower(name) = k) WHERE rn <= 5),
h AS (SELECT qid, f.s, f.r, f.o FROM n JOIN f ON f.s = n.name UNION SELECT qid, f.s, f.r, f.o FROM n JOIN f ON f.o = n.name)
SELECT qid, s, r, o, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s, r, o) AS rank FROM h) WHERE rank <= 20""")
def kg_lookup(spark, sf):
    """The facts about what a question names, both ways round."""
    return fa.kg_facts(GRAPH_QUESTIONS.df(spark, sf), _graph(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


ANALOGIES = given("a", f"SELECT c_custkey AS qid, {person('c_custkey')} AS a, CASE c_custkey % 3 WHEN 0 THEN {city('c_nationkey')} WHEN 1 THEN CAST(1700 + c_custkey % 200 AS STRING) ELSE 'nothing' END AS b, {person('(c_custkey + 8)')} AS c FROM customer WHERE c_custkey % 100 = 0", "customer")
_HOLDS = "(contains(lower({0}), lower({1})) OR contains(lower({1}), lower({0})))"


@query(f"""{_CLAIMS}, r AS (SELECT qid, arg_min(verb, (id, pos)) AS relation FROM {ANALOGIES.sql} JOIN claims c ON {_HOLDS.format('a.a', 'c.subj')} AND {_HOLDS.format('a.b', 'c.obj')} GROUP BY qid)
SELECT a.qid, r.relation, arg_min(c.obj, (c.id, c.pos)) AS answer FROM {ANALOGIES.sql} JOIN r ON r.qid = a.qid JOIN claims c ON c.verb = r.relation AND {_HOLDS.format('a.c', 'c.subj')} GROUP BY 1, 2""")
def solved_analogies(spark, sf):
    return fa.analogies(ANALOGIES.df(spark, sf), _claims(spark, sf))


#: id, text, and who is compared: parts by what they weigh and measure.
_THING = lambda key: f"('Z' || {letters(key)} || 'omo')"
SIZES = given("t", f"""SELECT p_partkey AS id, {_THING('p_partkey')} || CASE p_partkey % 4 WHEN 0 THEN ' has a diameter of ' || CAST(p_size AS STRING) || ',100 km. It is grey.' WHEN 1 THEN ' has a mass of ' || CAST(p_size AS STRING) || '.5 thousand tonnes and a height of 3.3 metres.' WHEN 2 THEN ' is fast. ' || {_THING('p_partkey')} || ' has a speed of ' || CAST(p_size AS STRING) || ' mph.'
  ELSE ': the length is about ' || CAST(p_size AS STRING) || ' metres.' END AS text FROM part""", "part")
PAIRS = given("p", f"SELECT p_partkey AS qid, {_THING('p_partkey')} AS a, {_THING('(p_partkey + 4)')} AS b, CASE p_partkey % 4 WHEN 0 THEN 'bigger' WHEN 1 THEN 'lighter' WHEN 2 THEN 'faster' ELSE 'longer' END AS verb FROM part", "part")


def _magnitude_sql() -> str:
    kinds = {"length": num.LENGTH, "mass": num.MASS, "speed": num.SPEED}
    dims = ", ".join(f"('{k}', {i}, '{d}', '{next(n for n, u in kinds.items() if u is t)}')" for k, own in fa.DIMENSIONS.items() for i, (d, t) in enumerate(own))
    values = []
    for n, t in kinds.items():
        p = fa.number_pattern(t).replace("'", "''")
        x = lambda g, p=p: f"regexp_extract(rest, '{p}', {g})"
        values.append(f"SELECT qid, entity, prio, dim, id, pos, replace({x(1)}, ',', '')::DOUBLE * coalesce(MAP {{{', '.join(f"'{k}': {v}::DOUBLE" for k, v in num.SCALE.items())}}}[lower({x(2)})], 1) * MAP {{{', '.join(f"'{k}': {v}::DOUBLE" for k, v in t.items())}}}[lower({x(3)})] AS value, {x(0)} AS raw FROM m WHERE unit = '{n}' AND regexp_matches(rest, '{p}')")
    verbs = ", ".join(f"('{k}', '{v}')" for k, v in fa.VERBS.items())
    return f"""WITH d AS (SELECT * FROM (VALUES {dims}) AS d(kind, prio, dim, unit)), v AS (SELECT * FROM (VALUES {verbs}) AS v(verb, kind)), p AS (SELECT p.*, kind FROM {PAIRS.sql} JOIN v USING (verb)),
q AS (SELECT DISTINCT qid, entity, kind FROM (SELECT qid, a AS entity, kind FROM p UNION ALL SELECT qid, b, kind FROM p)),
s AS (SELECT id, text, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT id, text, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS x FROM {SIZES.sql})),
m AS (SELECT qid, entity, prio, dim, unit, id, pos, substr(s, instr(lower(s), dim)::INT) AS rest FROM q JOIN d USING (kind) JOIN s ON contains(lower(text), lower(left(entity, 5)))
  WHERE instr(lower(s), dim) > 0 AND (starts_with(lower(text), lower(left(entity, 5))) OR (instr(lower(s), lower(left(entity, 5))) > 0 AND instr(lower(s), lower(left(entity, 5))) < instr(lower(s), dim)))),
x AS ({' UNION ALL '.join(values)}), f AS (SELECT qid, entity, prio, dim, arg_min(value, (id, pos)) AS value, arg_min(raw, (id, pos)) AS raw FROM x GROUP BY 1, 2, 3, 4)"""


@query(f"{_magnitude_sql()} SELECT qid, entity, dim, round(value, 6) AS value, raw FROM f")
def magnitude_facts(spark, sf):
    p = PAIRS.df(spark, sf).withColumn("kind", F.create_map(*[F.lit(x) for pair in fa.VERBS.items() for x in pair])[F.col("verb")])
    asked = p.select("qid", F.col("a").alias("entity"), "kind").union(p.select("qid", "b", "kind")).distinct()
    return fa.magnitudes(asked, SIZES.df(spark, sf)).select("qid", "entity", "dim", F.round("value", 6).alias("value"), "raw")


@query(f"""{_magnitude_sql()}, b AS (SELECT p.qid, x.dim, CASE WHEN (x.value > y.value) <> (verb IN ({sql_list(fa.WANT_LEAST)})) THEN a ELSE b END AS winner, row_number() OVER (PARTITION BY p.qid ORDER BY x.prio) AS rn FROM p JOIN f x ON x.qid = p.qid AND x.entity = p.a JOIN f y ON y.qid = p.qid AND y.entity = p.b AND y.prio = x.prio)
SELECT qid, dim, winner FROM b WHERE rn = 1""")
def magnitude_comparison(spark, sf):
    return fa.compared(PAIRS.df(spark, sf), SIZES.df(spark, sf))


#: entity, kind, text, sim: what orders say of the years of their customers' lives, and of two events.
HITS = given("h", f"""SELECT {person('o_custkey')} AS entity, CASE o_orderkey % 2 WHEN 0 THEN 'born' ELSE 'died' END AS kind, {person('o_custkey')} || CASE o_orderkey % 2 WHEN 0 THEN ' was born in ' || CAST(1850 + o_orderkey % 4 AS STRING) ELSE ' died in ' || CAST(1910 + o_orderkey % 3 AS STRING) END AS text, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS sim FROM orders
UNION ALL SELECT 'Blue War', 'started', 'the Blue War of ' || r_name || ' began in 1905', 0.8 FROM region UNION ALL SELECT 'Red Song', 'published', 'the Red Song was published in 1888 in ' || r_name, 0.9 FROM region""", "orders", "region")
_VOTES = "WITH y AS (" + " UNION ALL ".join(f"SELECT entity, kind, sim, unnest(regexp_extract_all(text, '(?i){p}', 1))::INT AS year FROM {HITS.sql} WHERE kind = '{k}' AND sim >= 0.5 AND len(list_intersect(regexp_extract_all(lower(entity), '[a-z]{{3,}}'), regexp_extract_all(lower(text), '[a-z]{{3,}}'))) > 0" for k, p in fa.YEARS.items()) + "), s AS (SELECT entity, kind, year, round(sum(sim), 6) AS weight FROM y WHERE year BETWEEN 1000 AND 2100 GROUP BY 1, 2, 3), v AS (SELECT entity, kind, year, weight FROM (SELECT *, row_number() OVER (PARTITION BY entity, kind ORDER BY weight DESC, year) AS rn FROM s) WHERE rn = 1)"


@query(f"{_VOTES} SELECT * FROM v")
def year_vote(spark, sf):
    return fa.year_votes(HITS.df(spark, sf))


@query(f"{_VOTES} SELECT b.entity, b.year AS born, d.year AS died, d.year - b.year AS lifespan, w.year - b.year AS age_at_war, w.year - s.year AS between FROM v b JOIN v d ON d.entity = b.entity AND d.kind = 'died' AND b.kind = 'born', v w, v s WHERE w.entity = 'Blue War' AND w.kind = 'started' AND s.kind = 'published'")
def year_chain(spark, sf):
    """Lifespan, age at an event and years between two events, from the voted years."""
    v = fa.year_votes(HITS.df(spark, sf))
    of = lambda kind, name: v.where(F.col("kind") == kind).select("entity", F.col("year").alias(name))
    war, song = of("started", "w").where("entity = 'Blue War'").select("w"), of("published", "s").select("s")
    lives = of("born", "born").join(of("died", "died"), "entity").join(F.broadcast(war), F.lit(True)).join(F.broadcast(song), F.lit(True))  # one year each
    return lives.select("entity", "born", "died", (F.col("died") - F.col("born")).alias("lifespan"), (F.col("w") - F.col("born")).alias("age_at_war"), (F.col("w") - F.col("s")).alias("between"))


#: id, text, source, saved: what is said of who holds a role.
ROLES = given("t", f"""SELECT CAST(c_custkey AS INT) AS id, CASE c_custkey % 6 WHEN 0 THEN {person('c_custkey')} || ' is the president of Nordland since ' || CAST(1950 + c_custkey % 70 AS STRING) || '.' WHEN 1 THEN 'In ' || CAST(1960 + c_custkey % 60 AS STRING) || ' ' || {person('c_custkey')} || ' became the president of Nordland.'
  WHEN 2 THEN 'The president of Nordland was ' || {person('c_custkey')} || '.' WHEN 3 THEN 'By law the president of Nordland rests. Nordland is cold.' WHEN 4 THEN {person('c_custkey')} || ' serves as president of Nordland.' ELSE {person('c_custkey')} || ' was never there.' END AS text, lower(c_mktsegment) AS source, CAST(2000 + c_custkey % 25 AS INT) AS saved FROM customer""", "customer")
_ROLE = "[Pp]resident"
_ROLES = f"""WITH h AS (SELECT id, text, source, saved, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: contains(lower(x), 'president'))[1] AS s FROM {ROLES.sql} WHERE contains(lower(text), 'president') AND contains(lower(text), 'nordl')),
n AS (SELECT *, coalesce({', '.join(f"nullif(regexp_extract(s, '{(p % _ROLE).replace(chr(39), chr(39) * 2)}', 1), '')" for p in fa.HOLDS)}) AS name, list_max(list_transform(regexp_extract_all(text, '\\b(1[5-9]\\d\\d|20\\d\\d)\\b', 1), lambda y: y::INT)) AS y FROM h),
c AS (SELECT id, name, coalesce(y, saved) AS year, y IS NOT NULL AS dated, source FROM n WHERE name IS NOT NULL AND NOT list_contains(string_split(lower(name), ' '), 'nordland') AND string_split(name, ' ')[1] NOT IN ({sql_list(fa.NOT_NAMES)}))"""


@query(f"{_ROLES} SELECT name, year, rn - 1 AS place FROM (SELECT name, arg_max(year, (year, dated, -id)) AS year, row_number() OVER (ORDER BY max((year, dated, -id)) DESC) AS rn FROM c GROUP BY name) WHERE rn <= 3")
def role_conflict(spark, sf):
    """Who holds a role by the newest memory, and who else by others."""
    return fa.role_holders(fa.role_claims(ROLES.df(spark, sf), "president", "Nordland")).withColumn("place", F.col("place").cast("long"))


@query(f"{_ROLES} SELECT coalesce(arg_max(name, (year, -id)) FILTER (year <= 2015), arg_min(name, (abs(year - 2015), id))) AS name FROM c WHERE dated HAVING count(*) > 0")
def role_as_of(spark, sf):
    """Who held it in 2015."""
    return fa.role_in(fa.role_claims(ROLES.df(spark, sf), "president", "Nordland"), 2015)


LIVES = given("t", f"""SELECT CAST(c_custkey AS INT) AS id, CASE c_custkey % 7 WHEN 0 THEN {person('c_custkey')} || ' (3 May ' || CAST(1800 + c_custkey % 90 AS STRING) || ' - 9 June ' || CAST(1870 + c_custkey % 90 AS STRING) || ') was a poet.' WHEN 1 THEN {person('c_custkey')} || ' was born on 1 January ' || CAST(1800 + c_custkey % 90 AS STRING) || '.'
  WHEN 2 THEN {person('c_custkey')} || ' met friends on 5 May 1880 and died on 7 July 1931.' WHEN 3 THEN 'Nobody knows ' || {person('c_custkey')} || '.' ELSE {person('c_custkey')} || ', born in 12 March ' || CAST(1800 + c_custkey % 90 AS STRING) || ', wrote songs.' END AS text FROM customer""", "customer")
SUBJECTS = given("s", f"SELECT {person('c_custkey')} AS subject FROM customer WHERE c_custkey % 100 = 0", "customer")
_DATE = r"\d{1,2}\s+[A-Za-z]+\s+\d{3,4}|[A-Za-z]+\s+\d{1,2},?\s+\d{3,4}"
_DATES = rf"""WITH x AS (SELECT id, text, x, i FROM (SELECT id, text, unnest(regexp_extract_all(text, '{_DATE}')) AS x, generate_subscripts(regexp_extract_all(text, '{_DATE}'), 1) AS i FROM {LIVES.sql})),
p AS (SELECT id, i, regexp_extract(x, '(\d{{3,4}})$', 1)::INT AS y, list_position([{sql_list(num.MONTHS)}], lower(regexp_extract(x, '[A-Za-z]+')))::INT AS m, CASE WHEN regexp_matches(x, '^\d') THEN regexp_extract(x, '^\d+') ELSE regexp_extract(x, '[A-Za-z]\s+(\d{{1,2}})', 1) END::INT AS d FROM x),
l AS (SELECT id, list({{'y': y, 'm': m, 'd': d}} ORDER BY i) AS d FROM p WHERE m > 0 AND d BETWEEN 1 AND 31 GROUP BY id),
r AS (SELECT subject, t.id, lower(text) AS low, coalesce(l.d, []) AS d FROM {SUBJECTS.sql} JOIN {LIVES.sql} ON contains(lower(text), lower(subject)) LEFT JOIN l ON l.id = t.id),
c AS (SELECT *, len(d) >= 2 AND (regexp_matches(low, '[\x{{2013}}\x{{2014}}]| - ') OR contains(low, 'born')) AND d[1].y < d[2].y AND d[2].y - d[1].y <= 120 AS pair FROM r),
e AS (SELECT subject, id, CASE WHEN pair OR (contains(low, 'born') AND len(d) > 0) THEN d[1] END AS birth, CASE WHEN pair THEN d[2] WHEN regexp_matches(low, 'died|death') AND len(d) > 0 THEN d[-1] END AS death FROM c)"""


@query(f"{_DATES}, z AS (SELECT subject, arg_min(birth, id) FILTER (birth IS NOT NULL) AS birth, arg_min(death, id) FILTER (death IS NOT NULL) AS death FROM e GROUP BY subject) SELECT subject, birth.y AS born, death.y AS died, death.y - birth.y - CASE WHEN (death.m, death.d) < (birth.m, birth.d) THEN 1 ELSE 0 END AS age FROM z")
def life_dates(spark, sf):
    lives = fa.life_dates(LIVES.df(spark, sf), SUBJECTS.df(spark, sf))
    return lives.select("subject", F.col("birth.y").alias("born"), F.col("death.y").alias("died"), num.age(F.col("birth"), F.col("death")).alias("age"))
