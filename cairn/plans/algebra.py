"""Queries of vector algebra: rolled, balanced and composed vectors, frames, contexts, relations, message passing, capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hv
from ..functions import text as tx
from ..operators import mine, retrieve
from .graph import _LANES, _N, _atom, _bundle_sql, _distance, _lanes, _nations, _xor
from .registry import example, given, literal, query, table
from .retrieval import _knn_sql, _vectors

D = hv.SMALL * hv.LANE_BITS
_BITS = f"(SELECT unnest(range(0, {hv.LANE_BITS}))::INT AS bit)"


def _unpacked(rows: str, keys: str) -> str:
    """A row for each bit: keys, k (its number), b."""
    return " UNION ALL ".join(f"SELECT {keys}, {i * hv.LANE_BITS} + bit AS k, (l{i} >> bit) & 1 AS b FROM ({rows}) x, {_BITS}" for i in _N)


def _packed(rows: str, keys: str) -> str:
    """The lanes of rows of keys, k, b."""
    lane = lambda i: f"CAST(sum(CASE WHEN b = 1 AND k // {hv.LANE_BITS} = {i} THEN 1::BIGINT << (k % {hv.LANE_BITS})::INT ELSE 0 END) AS BIGINT) AS l{i}"
    return f"SELECT {keys}, {', '.join(map(lane, _N))} FROM ({rows}) GROUP BY {keys}"


def _atoms(rows: str, label: str, keys: str) -> str:
    return f"SELECT {keys}, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor(label)))} FROM {rows}"


_ROLLED = _packed(f"SELECT n_name, (k + 7 * n_nationkey) % {D} AS k, b FROM ({_unpacked(_atoms('nation', 'n_name', 'n_name, n_nationkey'), 'n_name, n_nationkey')})", "n_name")


@query(f"SELECT n_name, {_LANES} FROM ({_ROLLED})")
def permuted_atoms(spark, sf):
    """Atoms rolled by a number of bits of their own."""
    v = hv.permuted(hv.atom(F.col("n_name")), F.col("n_nationkey") * 7)
    return table(spark, sf, "nation").select("n_name", *_lanes(v))


_HALF = f"SELECT n_name, k, CASE WHEN row_number() OVER (PARTITION BY n_name ORDER BY md5(n_name || '#' || k), k) <= {D // 2} THEN 1 ELSE 0 END AS b FROM nation, (SELECT unnest(range(0, {D})) AS k)"


@query(f"SELECT n_name, {_LANES}, {D // 2}::BIGINT AS ones FROM ({_packed(_HALF, 'n_name')})")
def balanced_atoms(spark, sf):
    v = hv.balanced_atom(F.col("n_name"))
    ones = F.aggregate(v, F.lit(0), lambda s, x: s + F.bit_count(x)).cast("long")
    return table(spark, sf, "nation").select("n_name", *_lanes(v), ones.alias("ones"))


_REGION_BITS = _unpacked(_atoms("nation JOIN region ON n_regionkey = r_regionkey", "n_name", "r_name, n_name"), "r_name, n_name")


@query(f"SELECT r_name, {_LANES} FROM ({_packed(f'SELECT r_name, k, CASE WHEN row_number() OVER (PARTITION BY r_name ORDER BY s DESC, md5(k::VARCHAR)) <= {D // 2} THEN 1 ELSE 0 END AS b FROM (SELECT r_name, k, sum(b) AS s FROM ({_REGION_BITS}) GROUP BY 1, 2)', 'r_name')})")
def balanced_bundle_by_region(spark, sf):
    return hv.balanced_bundle(_nations(spark, sf), ["r_name"]).select("r_name", *_lanes(F.col("hv")))


_PLANES = [[1 if hv.md5_atoms([f"plane{p}"], 2)[0, j // 60] >> (j % 60) & 1 else -1 for j in range(64)] for p in range(30)]


def _side(p: int) -> str:
    return f"CASE WHEN round(list_sum(list_transform(range(1, 65), lambda j: embedding[j]::DOUBLE * ({_PLANES[p]})[j])), 6) > 0 THEN {1 << p}::BIGINT ELSE 0 END"


@query(f"SELECT vec_id, {' + '.join(map(_side, range(30)))} AS code FROM embeddings")
def lsh_codes(spark, sf):
    """Which side of 30 hashed planes a dense vector lies on, one bit each."""
    dot = lambda plane: F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, plane)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    code = sum((F.when(F.round(dot(plane), 6) > 0, F.lit(1 << p).cast("long")).otherwise(F.lit(0).cast("long")) for p, plane in enumerate(_PLANES)), F.lit(0).cast("long"))
    return table(spark, sf, "embeddings").select("vec_id", code.alias("code"))


@query(f"SELECT r_name, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor(repr('self'), repr('trait'), 'r_name')))}, true AS back FROM region")
def identity_bind(spark, sf):
    """Facts bound into the subspace of one identity and a trait, and unbound again."""
    own, me = hv.atom(F.col("r_name")), hv.bind(hv.atom(F.lit("self")), hv.atom(F.lit("trait")))
    bound = hv.bind(me, own)
    return table(spark, sf, "region").select("r_name", *_lanes(bound), (hv.bind(bound, me) == own).alias("back"))


WORDS = given("w", "SELECT DISTINCT substr(p_name, 1, instr(p_name, ' ') - 1) AS word FROM part UNION SELECT substr(p_name, instr(p_name, ' ') + 1) FROM part", "part")
_CHARS = f"SELECT word, i, substr(word, i::INT, 1) AS ch FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {WORDS.sql})"
_PLACED = _packed(f"SELECT word, i, (k + 7 * (i - 1)) % {D} AS k, b FROM ({_unpacked(_atoms(f'({_CHARS})', 'ch', 'word, i'), 'word, i')})", "word, i")


def spelled(words: DataFrame) -> DataFrame:
    """word, hv: the bundle of a word's characters, each rolled by its place."""
    chars = words.select("word", F.posexplode(F.split("word", "")).alias("i", "ch")).where("ch <> ''")
    return hv.bundle(chars.select("word", hv.permuted(hv.atom(F.col("ch")), F.col("i") * 7).alias("hv")), ["word"]).select("word", "hv")


@query(f"SELECT key AS word, {_LANES} FROM ({_bundle_sql(_PLACED, 'word')})")
def spelling_vectors(spark, sf):
    return spelled(WORDS.df(spark, sf)).select("word", *_lanes(F.col("hv")))


SENTENCES = given("s", "SELECT p_partkey AS id, p_name AS s FROM part", "part")


@query(f"SELECT key AS id, {_LANES} FROM ({_bundle_sql(f'SELECT s.id, v.* FROM (SELECT id, unnest(string_split(s, chr(32))) AS word FROM {SENTENCES.sql}) s JOIN ({_bundle_sql(_PLACED, "word")}) v ON v.key = s.word', 'id')})")
def sentence_vectors(spark, sf):
    """Sentences as bundles of their words' vectors, which are bundles of their characters'."""
    w = SENTENCES.df(spark, sf).select("id", F.explode(F.split("s", " ")).alias("word"))
    return hv.bundle(w.join(spelled(WORDS.df(spark, sf)), "word"), ["id"]).select("id", *_lanes(F.col("hv")))


FRAMES = given("f", "SELECT c_custkey AS id, 'agent' AS role, CASE c_nationkey % 3 WHEN 0 THEN 'bear' ELSE lower(c_mktsegment) END AS value FROM customer UNION ALL SELECT c_custkey, 'action', CASE c_custkey % 2 WHEN 0 THEN 'find' ELSE 'see' END FROM customer UNION ALL SELECT c_custkey, 'patient', CASE c_custkey % 5 WHEN 0 THEN 'bear' ELSE 'lamp' END FROM customer UNION ALL SELECT c_custkey, '_raw', c_name FROM customer", "customer")
_FRAME_ROWS = f"SELECT id, role, value, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('role', 'value')))} FROM {FRAMES.sql} WHERE NOT starts_with(role, '_')"


def frame_pairs(frames: DataFrame) -> DataFrame:
    """id, role, value, hv (role ^ value) of frames' roles, without those of the frame itself (_raw and the like)."""
    return frames.where(~F.startswith("role", F.lit("_"))).select("id", "role", "value", hv.bind(hv.atom(F.col("role")), hv.atom(F.col("value"))).alias("hv"))


@query(f"SELECT key AS id, {_LANES} FROM ({_bundle_sql(_FRAME_ROWS, 'id')})")
def event_vectors(spark, sf):
    return hv.bundle(frame_pairs(FRAMES.df(spark, sf)), ["id"]).select("id", *_lanes(F.col("hv")))


_NEW_FRAMES = f"SELECT id, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('role', "CASE WHEN value = 'bear' THEN 'fox' ELSE value END")))} FROM {FRAMES.sql} WHERE NOT starts_with(role, '_')"


@query(f"SELECT key AS id, {_LANES}, true AS same FROM ({_bundle_sql(_NEW_FRAMES, 'id')})")
def frame_substitution(spark, sf):
    """bear becomes fox: the old pair's bits are taken from the counts and the new one's added, which equals encoding anew."""
    old = frame_pairs(FRAMES.df(spark, sf))
    swap = old.where("value = 'bear'").select("id", "role")
    minus = swap.select("id", hv.bind(hv.atom(F.col("role")), hv.atom(F.lit("bear"))).alias("hv"), F.lit(-1).alias("w"))
    plus = swap.select("id", hv.bind(hv.atom(F.col("role")), hv.atom(F.lit("fox"))).alias("hv"), F.lit(1).alias("w"))
    counts = old.select("id", "hv", F.lit(1).alias("w")).unionByName(minus).unionByName(plus)
    made = hv.from_bits(hv.bit_sums(counts, ["id"], weight=F.col("w")), ["id"], 2 * F.col("on") > F.col("all"))
    new = FRAMES.df(spark, sf).withColumn("value", F.when(F.col("value") == "bear", "fox").otherwise(F.col("value")))
    again = hv.bundle(frame_pairs(new), ["id"]).select("id", F.col("hv").alias("again"))
    return made.join(again, "id").select("id", *_lanes(F.col("hv")), (F.col("hv") == F.col("again")).alias("same"))


MOODS = given("m", "SELECT n_name AS word, 'valence' AS axis, CASE n_regionkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS value FROM nation UNION ALL SELECT n_name, 'arousal', CASE n_nationkey % 3 WHEN 0 THEN 'high' ELSE 'low' END FROM nation UNION ALL SELECT n_name, 'category', r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
_MOOD_ROWS = f"SELECT word, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('axis', 'value')))} FROM {MOODS.sql}"


def _moods(spark, sf):
    rows = MOODS.df(spark, sf).select("word", hv.bind(hv.atom(F.col("axis")), hv.atom(F.col("value"))).alias("hv"))
    return hv.bundle(rows, ["word"]).select("word", "hv")


@query(f"SELECT key AS word, {_LANES} FROM ({_bundle_sql(_MOOD_ROWS, 'word')})")
def emotion_vectors(spark, sf):
    return _moods(spark, sf).select("word", *_lanes(F.col("hv")))


@query(f"""WITH m AS ({_bundle_sql(_MOOD_ROWS, 'word')}), q AS (SELECT {', '.join(f"{x} AS l{i}" for i, x in enumerate(_xor("'valence'", "'high'")))})
SELECT word, CAST(distance AS BIGINT) AS distance FROM (SELECT m.key AS word, {_distance('m', 'q')} AS distance FROM m, q) ORDER BY distance, word LIMIT 2""")
def words_with_emotion(spark, sf):
    """The two words nearest to one bound pair of axis and value."""
    asked = hv.bind(hv.atom(F.lit("valence")), hv.atom(F.lit("high")))
    return _moods(spark, sf).select("word", hv.hamming(F.col("hv"), asked).cast("long").alias("distance")).orderBy("distance", "word").limit(2)


_GROUND = f"SELECT word, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('word')))} FROM (SELECT DISTINCT word FROM {MOODS.sql}) UNION ALL {_MOOD_ROWS}"


@query(f"SELECT key AS word, {_LANES} FROM ({_bundle_sql(_GROUND, 'word')})")
def grounded_words(spark, sf):
    """A word's own atom bundled with all that is bound to it."""
    m = MOODS.df(spark, sf)
    rows = m.select("word").distinct().select("word", hv.atom(F.col("word")).alias("hv")).unionByName(m.select("word", hv.bind(hv.atom(F.col("axis")), hv.atom(F.col("value"))).alias("hv")))
    return hv.bundle(rows, ["word"]).select("word", *_lanes(F.col("hv")))


@query(f"""WITH m AS ({_bundle_sql(_MOOD_ROWS, 'word')}), q AS (SELECT key AS asked, {', '.join(f"xor(l{i}, xor(xor({_atom("'valence'", i)}, {_atom("'high'", i)}), xor({_atom("'valence'", i)}, {_atom("'low'", i)}))) AS l{i}" for i in _N)} FROM m),
d AS (SELECT asked, m.key AS nearest, {_distance('q', 'm')} AS distance FROM q, m) SELECT asked, nearest, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, nearest) AS rn FROM d) WHERE rn = 1""")
def axis_swap(spark, sf):
    """Each word with one axis swapped (valence high for low), and the word that is nearest then."""
    pair = lambda v: hv.bind(hv.atom(F.lit("valence")), hv.atom(F.lit(v)))
    book = _moods(spark, sf)
    swapped = book.select(F.col("word").alias("asked"), hv.counterfactual(F.col("hv"), pair("high"), pair("low")).alias("hv"))
    return hv.snap(swapped, book, "word").select("asked", "nearest", "distance")


_CO = r"""WITH w AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+') AS w FROM benchmark), p AS (SELECT w, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
o AS (SELECT a, unnest(w[i + 1:i + 2]) AS b FROM p), c AS (SELECT a, b FROM o WHERE a <> b UNION ALL SELECT b, a FROM o WHERE a <> b), n AS (SELECT a, b, count(*) AS n FROM c GROUP BY 1, 2),
t AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM n) WHERE rn <= 8), v AS (SELECT DISTINCT unnest(w) AS a FROM w),
z AS (SELECT a, b FROM t UNION ALL SELECT a, a FROM v WHERE a NOT IN (SELECT a FROM t))"""
_CONTEXT = f"{_CO}, x AS ({_bundle_sql(_atoms('z', 'b', 'a'), 'a')})"


def contexts(rows: DataFrame, words, window: int = 2, cap: int = 8) -> DataFrame:
    """word, hv: the bundle of the atoms of a word's ``cap`` most frequent neighbours; words without neighbours keep their own atom."""
    near = hv.top_k(mine.cooccurrence(rows, words, window), ["a"], [F.desc("n"), F.col("b")], cap)
    alone = rows.select(F.explode(words).alias("a")).distinct().join(near.select("a").distinct(), "a", "left_anti")
    parts = near.select("a", "b").union(alone.select("a", F.col("a").alias("b")))
    return hv.bundle(parts.select(F.col("a").alias("word"), hv.atom(F.col("b")).alias("hv")), ["word"]).select("word", "hv")


@query(f"{_CONTEXT} SELECT key AS word, {_LANES} FROM x")
def context_vectors(spark, sf):
    return contexts(table(spark, sf, "benchmark"), tx.lower_tokens(F.col("text"))).select("word", *_lanes(F.col("hv")))


@query(f"""{_CONTEXT}, q AS (SELECT key, {_LANES} FROM x WHERE key IN (SELECT w[1] FROM w)), d AS (SELECT q.key AS word, x.key AS near, CAST({_distance('q', 'x')} AS BIGINT) AS distance FROM q, x WHERE q.key <> x.key)
SELECT word, near, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, near) AS rank FROM d) WHERE rank <= 3""")
def distributional_neighbours(spark, sf):
    """The three words with the most like contexts, for each word that begins a benchmark text."""
    b, words = table(spark, sf, "benchmark"), tx.lower_tokens(F.col("text"))
    v = contexts(b, words)
    numbered = v.select(F.dense_rank().over(Window.orderBy("word")).cast("long").alias("id"), "word", "hv")  # by letter, so that ties of distance are too; a vocabulary
    first = b.select(F.get(words, F.lit(0)).alias("word")).distinct()
    asked = numbered.join(first, "word", "left_semi").withColumnRenamed("id", "qid")
    found = hv.knn(numbered, asked, 4).where("qid <> id")
    near = found.join(numbered.select("id", F.col("word").alias("near")), "id").join(asked.select("qid", "word"), "qid")
    return hv.top_k(near.select("word", "near", "distance"), ["word"], [F.col("distance"), F.col("near")], 3).withColumn("rank", F.col("rank").cast("long"))


_EXPANDED = f"""{_CONTEXT}, q AS (SELECT key, {_LANES} FROM x WHERE key IN (SELECT w[1] FROM w)), d AS (SELECT q.key AS word, x.key AS near, 1 - 2 * CAST({_distance('q', 'x')} AS BIGINT) / {float(D)} AS sim FROM q, x WHERE q.key <> x.key),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, near) AS rn FROM d)"""


@query(f"{_EXPANDED} SELECT word, near AS added, round(0.5 * sim, 6) AS weight FROM r WHERE rn <= 3 AND sim >= 0.15 UNION ALL SELECT key, key, 1.0 FROM q")
def expanded_queries(spark, sf):
    """Each query word with weight 1 and its three nearest words of similarity 0.15 or more with half that similarity."""
    near = distributional_neighbours(spark, sf).withColumn("sim", hv.sim_pm1(F.col("distance"), hv.SMALL)).where("sim >= 0.15")
    first = table(spark, sf, "benchmark").select(F.get(tx.lower_tokens(F.col("text")), F.lit(0)).alias("word")).distinct()
    return near.select("word", F.col("near").alias("added"), F.round(0.5 * F.col("sim"), 6).alias("weight")).union(first.select("word", F.col("word").alias("added"), F.lit(1.0).alias("weight")))


_TRIPLES = "(SELECT n_name AS s, 'in' AS r, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'has', n_name FROM nation JOIN region ON n_regionkey = r_regionkey) t"
_BOUND = f"SELECT s, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('r', 'o')))} FROM {_TRIPLES}"


def _triples(spark, sf):
    n = _nations(spark, sf)
    return n.select(F.col("n_name").alias("s"), F.lit("in").alias("r"), F.col("r_name").alias("o")).union(n.select("r_name", F.lit("has"), "n_name"))


def relation_bound(triples: DataFrame) -> DataFrame:
    """s, hv: each subject's majority of relation ^ object over its triples."""
    rows = triples.select("s", hv.bind(hv.atom(F.col("r")), hv.atom(F.col("o"))).alias("hv"))
    return hv.bundle(rows, ["s"]).select("s", "hv")


@query(f"SELECT key AS s, {_LANES} FROM ({_bundle_sql(_BOUND, 's')})")
def relation_bound_vectors(spark, sf):
    return relation_bound(_triples(spark, sf)).select("s", *_lanes(F.col("hv")))


@query(f"""WITH x AS ({_bundle_sql(_BOUND, 's')}), q AS (SELECT key, {', '.join(f"xor(l{i}, {_atom(repr('in'), i)}) AS l{i}" for i in _N)} FROM x WHERE key IN (SELECT n_name FROM nation)), r AS ({_atoms('region', 'r_name', 'r_name')}),
d AS (SELECT q.key AS s, r_name AS answer, {_distance('q', 'r')} AS distance FROM q, r) SELECT s, answer, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY distance, answer) AS rn FROM d) WHERE rn = 1""")
def relation_query(spark, sf):
    """The region that each nation's vector gives when it is unbound from the relation."""
    nations, regions = table(spark, sf, "nation").select(F.col("n_name").alias("s")), table(spark, sf, "region").select("r_name", hv.atom(F.col("r_name")).alias("hv"))
    asked = relation_bound(_triples(spark, sf)).join(nations, "s", "left_semi").select("s", hv.bind(F.col("hv"), hv.atom(F.lit("in"))).alias("hv"))
    return hv.snap(asked, regions, "r_name").select("s", F.col("nearest").alias("answer"), "distance")


def message_rounds(state: DataFrame, edges: DataFrame, rounds: int, lanes: int = hv.SMALL) -> DataFrame:
    """node, hv after some rounds: a node's counters are half their last value (towards zero) plus 1 or -1 for each bit of relation ^ neighbour, over edges in both directions; a bit is on where its counter is over 0.

    state: node, hv; edges: a, r, b. The counters of a node are rows (node, lane, bit), so a node may have any number of neighbours.
    """
    both = edges.select(F.col("a").alias("node"), "r", F.col("b").alias("other")).union(edges.select("b", "r", "a"))
    counters = hv.bit_sums(state, ["node"]).select("node", "lane", "bit", (2 * F.col("on") - F.col("all")).cast("long").alias("c"))
    for _ in range(rounds):
        now = hv.from_bits(counters, ["node"], F.col("c") > 0, lanes)
        sent = both.join(now.withColumnRenamed("node", "other"), "other").select("node", hv.bind(hv.atom(F.col("r")), F.col("hv")).alias("hv"))
        got = hv.bit_sums(sent, ["node"]).select("node", "lane", "bit", (2 * F.col("on") - F.col("all")).cast("long").alias("g"))
        kept = F.when(F.col("c") >= 0, F.floor(F.col("c") / 2)).otherwise(F.ceil(F.col("c") / 2)).cast("long")
        counters = counters.join(got, ["node", "lane", "bit"], "left").select("node", "lane", "bit", (kept + F.coalesce("g", F.lit(0).cast("long"))).alias("c"))
    return hv.from_bits(counters, ["node"], F.col("c") > 0, lanes)


def _rounds_sql(rounds: int) -> str:
    first = f"SELECT node, k, 2 * b - 1 AS c FROM ({_unpacked(_atoms('(SELECT n_name AS node FROM nation UNION ALL SELECT r_name FROM region) t', 'node', 'node'), 'node')})"
    parts = ["e AS (SELECT n_name AS node, r_name AS other FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)", f"role AS ({_unpacked(_atoms("(SELECT 'in' AS r) t", 'r', 'r'), 'r')})", f"c0 AS ({first})"]
    for i in range(rounds):
        parts.append(f"c{i + 1} AS (SELECT c.node, c.k, CAST(trunc(c.c / 2.0) AS BIGINT) + coalesce(g.g, 0) AS c FROM c{i} c LEFT JOIN (SELECT e.node, o.k, CAST(sum(CASE WHEN (o.c > 0) <> (role.b = 1) THEN 1 ELSE -1 END) AS BIGINT) AS g FROM e JOIN c{i} o ON o.node = e.other JOIN role ON role.k = o.k GROUP BY 1, 2) g ON g.node = c.node AND g.k = c.k)")
    return f"WITH {', '.join(parts)} SELECT node, {_LANES} FROM ({_packed(f'SELECT node, k, CASE WHEN c > 0 THEN 1 ELSE 0 END AS b FROM c{rounds}', 'node')})"


@query(_rounds_sql(2))
def message_passing(spark, sf):
    """Two rounds over the graph of nations and regions."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nodes = n.select(F.col("n_name").alias("node")).union(r.select("r_name")).select("node", hv.atom(F.col("node")).alias("hv"))
    edges = _nations(spark, sf).select(F.col("n_name").alias("a"), F.lit("in").alias("r"), F.col("r_name").alias("b"))
    return message_rounds(nodes, edges, 2).select("node", *_lanes(F.col("hv")))


_LAYER1 = f"SELECT r_name AS one, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('n_name', 'r_name')))} FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH k AS ({_bundle_sql(_LAYER1, 'one')}), q AS (SELECT n_name, n_regionkey, {', '.join(f"xor(k.l{i}, {_atom('n_name', i)}) AS l{i}" for i in _N)} FROM nation JOIN region ON n_regionkey = r_regionkey JOIN k ON k.key = r_name), r AS ({_atoms('region', 'r_name', 'r_name')}),
d AS (SELECT n_name, r_name AS out, {_distance('q', 'r')} AS distance FROM q, r), f AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY distance, out) AS rn FROM d) SELECT n_name, out, CAST(distance AS BIGINT) AS distance, distance <= {D * 4 // 10} AS sure FROM f WHERE rn = 1""")
def feed_forward(spark, sf):
    """A layer's key is the bundle of input ^ output of its pairs (one layer for each region's nations); an input bound with the key snaps to an output, or is deferred where that is far."""
    n = _nations(spark, sf)
    keys = hv.bundle(n.select("r_name", hv.bind(F.col("hv"), hv.atom(F.col("r_name"))).alias("hv")), ["r_name"]).select("r_name", F.col("hv").alias("key"))
    out = n.join(keys, "r_name").select("n_name", hv.bind(F.col("hv"), F.col("key")).alias("hv"))
    book = table(spark, sf, "region").select("r_name", hv.atom(F.col("r_name")).alias("hv"))
    return hv.snap(out, book, "r_name").select("n_name", F.col("nearest").alias("out"), "distance", (F.col("distance") <= D * 4 // 10).alias("sure"))


_ZONE = "CASE r_regionkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END"
_STACK = f"""WITH k1 AS ({_bundle_sql(f"SELECT 1 AS one, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('n_name', 'r_name')))} FROM nation JOIN region ON n_regionkey = r_regionkey", 'one')}),
k2 AS ({_bundle_sql(f"SELECT 1 AS one, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('r_name', _ZONE)))} FROM region", 'one')}),
r AS ({_atoms('region', 'r_name', 'r_name')}), z AS ({_atoms("(SELECT unnest(['even', 'odd']) AS zone)", 'zone', 'zone')}), q1 AS (SELECT n_name, {', '.join(f"xor(k1.l{i}, {_atom('n_name', i)}) AS l{i}" for i in _N)} FROM nation, k1),
m AS (SELECT n_name, arg_min(r_name, (distance, r_name)) AS mid FROM (SELECT n_name, r_name, {_distance('q1', 'r')} AS distance FROM q1, r) GROUP BY 1), q2 AS (SELECT n_name, mid, {', '.join(f"xor(k2.l{i}, {_atom('mid', i)}) AS l{i}" for i in _N)} FROM m, k2),
q3 AS (SELECT n_name, {', '.join(f'xor(k2.l{i}, q1.l{i}) AS l{i}' for i in _N)} FROM q1, k2), o AS (SELECT n_name, any_value(mid) AS mid, arg_min(zone, (distance, zone)) AS out FROM (SELECT n_name, mid, zone, {_distance('q2', 'z')} AS distance FROM q2, z) GROUP BY 1)"""


@query(f"{_STACK} SELECT n_name, mid, out, raw FROM o JOIN (SELECT n_name, arg_min(zone, (distance, zone)) AS raw FROM (SELECT n_name, zone, {_distance('q3', 'z')} AS distance FROM q3, z) GROUP BY 1) USING (n_name)")
def layer_stack(spark, sf):
    """Two layers, nation to region to zone: each commits to its nearest output before the next one; raw goes through both keys and is cleaned up at the end only."""
    n, r = _nations(spark, sf), table(spark, sf, "region")
    zone = F.when(F.col("r_regionkey") % 2 == 0, "even").otherwise("odd")
    regions = r.select("r_name", hv.atom(F.col("r_name")).alias("hv"))
    zones = r.select(zone.alias("zone")).distinct().select("zone", hv.atom(F.col("zone")).alias("hv"))
    one = lambda pairs, name: hv.bundle(pairs.select(F.lit(1).alias("one"), "hv"), ["one"]).select(F.col("hv").alias(name))
    k1 = one(n.select(hv.bind(F.col("hv"), hv.atom(F.col("r_name"))).alias("hv")), "k1")
    k2 = one(r.select(hv.bind(hv.atom(F.col("r_name")), hv.atom(zone)).alias("hv")), "k2")
    first = n.join(F.broadcast(k1), F.lit(True)).select("n_name", hv.bind(F.col("hv"), F.col("k1")).alias("hv"))  # a key is one row
    mid = hv.snap(first, regions, "r_name").select("n_name", F.col("nearest").alias("mid"))
    second = mid.join(F.broadcast(k2), F.lit(True)).select("n_name", "mid", hv.bind(hv.atom(F.col("mid")), F.col("k2")).alias("hv"))
    through = first.join(F.broadcast(k2), F.lit(True)).select("n_name", hv.bind(F.col("hv"), F.col("k2")).alias("hv"))
    raw = hv.snap(through, zones, "zone").select("n_name", F.col("nearest").alias("raw"))
    return hv.snap(second, zones, "zone").select("n_name", F.col("nearest").alias("out")).join(mid, "n_name").join(raw, "n_name").select("n_name", "mid", "out", "raw")


_CHAIN = "(SELECT s_name, unnest(['WORLD', r_name, n_name]) AS a, unnest(['level0', 'level1', 'level2']) AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t"
_TAXON = _bundle_sql(f"SELECT s_name, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('level', 'a')))} FROM {_CHAIN}", "s_name")


def _taxa(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chain = s.select("s_name", F.posexplode(F.array(F.lit("WORLD"), "r_name", "n_name")).alias("i", "a"))
    level = F.concat(F.lit("level"), F.col("i").cast("string"))
    return hv.bundle(chain.select("s_name", hv.bind(hv.atom(level), hv.atom(F.col("a"))).alias("hv")), ["s_name"]).select("s_name", "hv")


@query(f"SELECT key AS s_name, {_LANES} FROM ({_TAXON})")
def taxonomy_vectors(spark, sf):
    """Ancestor chains as the bundle of level ^ ancestor."""
    return _taxa(spark, sf).select("s_name", *_lanes(F.col("hv")))


@query(f"""WITH x AS ({_TAXON}), q AS (SELECT key, {', '.join(f"xor(l{i}, {_atom("'level1'", i)}) AS l{i}" for i in _N)} FROM x), r AS ({_atoms('region', 'r_name', 'r_name')}),
d AS (SELECT q.key AS s_name, r_name AS concept, {_distance('q', 'r')} AS distance FROM q, r) SELECT concept, count(*) AS members FROM (SELECT *, row_number() OVER (PARTITION BY s_name ORDER BY distance, concept) AS rn FROM d) WHERE rn = 1 GROUP BY 1""")
def taxonomy_vector_members(spark, sf):
    """Members of each concept of level 1, as read from the vectors."""
    asked = _taxa(spark, sf).select("s_name", hv.bind(F.col("hv"), hv.atom(F.lit("level1"))).alias("hv"))
    book = table(spark, sf, "region").select("r_name", hv.atom(F.col("r_name")).alias("hv"))
    return hv.snap(asked, book, "r_name").groupBy(F.col("nearest").alias("concept")).agg(F.count(F.lit(1)).alias("members"))


_SUCC = f"""WITH h AS (SELECT qid, 1 / (2 - sim) AS w, CAST(label AS VARCHAR) AS label FROM ({_knn_sql(12)}) k JOIN embeddings e ON e.vec_id = k.id),
b AS ({_unpacked(f"SELECT qid, w, label, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('label')))} FROM h", 'qid, w, label')}),
v AS ({_packed('SELECT qid, k, CASE WHEN round(2 * sum(w * b) - sum(w), 9) > 0 THEN 1 ELSE 0 END AS b FROM b GROUP BY qid, k', 'qid')}), a AS ({_atoms('(SELECT DISTINCT CAST(label AS VARCHAR) AS label FROM embeddings) t', 'label', 'label')}),
d AS (SELECT qid, label, {_distance('v', 'a')} AS distance FROM v, a)"""


@query(f"{_SUCC} SELECT qid, label, CAST(distance AS BIGINT) AS distance, CAST(next - distance AS BIGINT) AS margin FROM (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS next FROM d WINDOW w AS (PARTITION BY qid ORDER BY distance, label)) WHERE rn = 1")
def knn_successor(spark, sf):
    """The weighted majority of the neighbours' successor vectors, snapped to the nearest atom, with its lead over the next."""
    e, rows, q = _vectors(spark, sf)
    hits = retrieve.cosine_knn(rows, q, 12).join(e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label")), "id")
    made = hv.weighted_bundle(hits.select("qid", "sim", hv.atom(F.col("label")).alias("hv")), ["qid"], 1 / (2 - F.col("sim")))
    book = e.select(F.col("label").cast("string").alias("label")).distinct().select("label", hv.atom(F.col("label")).alias("hv")).groupBy().agg(F.collect_list(F.struct("label", "hv")).alias("book"))
    near = F.array_sort(F.transform("book", lambda b: F.struct(hv.hamming(F.col("hv"), b["hv"]).alias("d"), b["label"].alias("label"))))
    best = made.join(F.broadcast(book), F.lit(True)).select("qid", near.alias("near"))
    at = lambda i: F.get("near", F.lit(i))
    return best.select("qid", at(0)["label"].alias("label"), at(0)["d"].cast("long").alias("distance"), (at(1)["d"] - at(0)["d"]).cast("long").alias("margin"))


_PICTURES = f"SELECT 1 AS one, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('r_name', "'picture of ' || r_name")))} FROM region"


@query(f"""WITH k AS ({_bundle_sql(_PICTURES, 'one')}), q AS (SELECT r_name, {', '.join(f"xor(k.l{i}, {_atom('r_name', i)}) AS l{i}" for i in _N)} FROM region, k), p AS (SELECT r_name AS name, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor("'picture of ' || r_name")))} FROM region),
d AS (SELECT q.r_name, p.name, {_distance('q', 'p')} AS distance FROM q, p), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY distance, name) AS rn FROM d) WHERE rn <= 3)
SELECT key AS caption, {_LANES} FROM ({_bundle_sql('SELECT t.r_name, p.* FROM t JOIN p USING (name)', 'r_name').replace('FROM (SELECT t.r_name', 'FROM (SELECT t.r_name')})""")
def associative_blend(spark, sf):
    """A caption unbound from the bundle of all caption ^ picture pairs, and the three nearest pictures blended."""
    r = table(spark, sf, "region").select("r_name", hv.atom(F.col("r_name")).alias("a"), hv.atom(F.concat(F.lit("picture of "), F.col("r_name"))).alias("p"))
    k = hv.bundle(r.select(F.lit(1).alias("one"), hv.bind(F.col("a"), F.col("p")).alias("hv")), ["one"]).select(F.col("hv").alias("k"))
    asked = r.join(F.broadcast(k), F.lit(True)).select("r_name", hv.bind(F.col("k"), F.col("a")).alias("q"))
    book = r.groupBy().agg(F.collect_list(F.struct("r_name", "p")).alias("book"))
    near = F.slice(F.array_sort(F.transform("book", lambda b: F.struct(hv.hamming(F.col("q"), b["p"]).alias("d"), b["r_name"].alias("n"), b["p"].alias("p")))), 1, 3)
    top = asked.join(F.broadcast(book), F.lit(True)).select(F.col("r_name").alias("caption"), F.explode(near).alias("x")).select("caption", F.col("x.p").alias("hv"))
    return hv.bundle(top, ["caption"]).select("caption", *_lanes(F.col("hv")))


_SIZES = [3, 7, 15, 31, 63]
_CAPACITY = f"(SELECT n, i, 'item' || i AS label FROM (SELECT unnest({_SIZES}) AS n), (SELECT unnest(range(0, 63)) AS i) WHERE i < n) t"


@example(f"""WITH m AS ({_atoms(_CAPACITY, 'label', 'n, label')}), b AS ({_bundle_sql('SELECT n, l0, l1 FROM m', 'n')}), o AS ({_atoms("(SELECT 'other' || unnest(range(0, 200)) AS label) t", 'label', 'label')}),
f AS (SELECT b.key AS n, min({_distance('b', 'o')}) AS far FROM b, o GROUP BY 1), d AS (SELECT m.n, {_distance('m', 'b')} AS d FROM m JOIN b ON b.key = m.n)
SELECT d.n, count(*) AS items, round(avg(CASE WHEN d < far THEN 1.0 ELSE 0 END), 6) AS recall FROM d JOIN f USING (n) GROUP BY 1""")
def capacity_curve(spark, sf):
    """The share of a bundle's items that are nearer to it than any of 200 others, by the number of items."""
    items = spark.range(max(_SIZES)).select(F.explode(F.array(*map(F.lit, _SIZES))).alias("size"), "id").where("id < size")
    items = items.select("size", hv.atom(F.concat(F.lit("item"), F.col("id").cast("string"))).alias("hv"))
    b = hv.bundle(items, ["size"]).select("size", F.col("hv").alias("b"))
    others = spark.range(200).select(hv.atom(F.concat(F.lit("other"), F.col("id").cast("string"))).alias("o"))
    far = others.join(F.broadcast(b), F.lit(True)).groupBy("size").agg(F.min(hv.hamming(F.col("b"), F.col("o"))).alias("far"))  # as many bundles as sizes
    d = items.join(b, "size").join(far, "size").select(F.col("size").alias("n"), (hv.hamming(F.col("hv"), F.col("b")) < F.col("far")).alias("ok"))
    return d.groupBy("n").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("recall"))
