"""Queries on graphs of facts and on vector algebra: bundles, cleanup, chains, taxonomies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hv
from .registry import query, table

_N = range(hv.SMALL)


def _atom(label: str, i: int) -> str:
    return f"('0x' || substr(md5(({label}) || '#{i}'), 1, 15))::BIGINT"


def _xor(*labels: str) -> list[str]:
    out = []
    for i in _N:
        x = _atom(labels[0], i)
        for other in labels[1:]:
            x = f"xor({x}, {_atom(other, i)})"
        out.append(x)
    return out


def _bundle_sql(rows: str, key: str) -> str:
    """The majority of each bit of the lanes l0, l1 ... of rows, by key."""
    lanes = " UNION ALL ".join(f"SELECT {key} AS key, {i} AS lane, l{i} AS w FROM ({rows})" for i in _N)
    return f"""SELECT key, {", ".join(f"CAST(sum(CASE WHEN lane = {i} THEN b << bit ELSE 0 END) AS BIGINT) AS l{i}" for i in _N)}
  FROM (SELECT key, lane, bit, CASE WHEN 2 * sum((w >> bit) & 1) > count(*) THEN 1::BIGINT ELSE 0 END AS b FROM ({lanes}) x, (SELECT unnest(range(0, {hv.LANE_BITS}))::INT AS bit) GROUP BY key, lane, bit) GROUP BY key"""


_LANES = ", ".join(f"l{i}" for i in _N)


def _distance(a: str, b: str) -> str:
    return " + ".join(f"bit_count(xor({a}.l{i}, {b}.l{i}))" for i in _N)


def _lanes(v):
    return [F.get(v, F.lit(i)).alias(f"l{i}") for i in _N]


_NATIONS = f"SELECT n_name, r_name, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('n_name')))} FROM nation JOIN region ON n_regionkey = r_regionkey"


def _nations(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", hv.atom(F.col("n_name")).alias("hv"))


@query(f"SELECT key AS r_name, {_LANES} FROM ({_bundle_sql(_NATIONS, 'r_name')})")
def bundle_by_region(spark, sf):
    return hv.bundle(_nations(spark, sf), ["r_name"]).select("r_name", *_lanes(F.col("hv")))


@query(f"WITH b AS ({_bundle_sql(_NATIONS, 'r_name')}), n AS ({_NATIONS}), d AS (SELECT n_name, key AS nearest, {_distance('n', 'b')} AS distance, row_number() OVER (PARTITION BY n_name ORDER BY {_distance('n', 'b')}, key) AS rn FROM n, b) SELECT n_name, nearest, CAST(distance AS BIGINT) AS distance FROM d WHERE rn = 1")
def cleanup_snap(spark, sf):
    """The region bundle nearest to each nation's atom: the codebook is the regions."""
    n = _nations(spark, sf)
    book = hv.bundle(n, ["r_name"]).groupBy().agg(F.collect_list(F.struct("r_name", "hv")).alias("book"))  # five regions
    near = F.array_min(F.transform("book", lambda b: F.struct(hv.hamming(F.col("hv"), b["hv"]).alias("d"), b["r_name"].alias("r"))))
    return n.join(F.broadcast(book), F.lit(True)).select("n_name", near.alias("x")).select("n_name", F.col("x.r").alias("nearest"), F.col("x.d").cast("long").alias("distance"))


@query(f"""WITH x AS (SELECT n_name, {', '.join(f'{v} AS b{i}' for i, v in enumerate(_xor('n_name', "'role'")))}, {', '.join(f'{v} AS a{i}' for i, v in enumerate(_xor('n_name')))} FROM nation)
SELECT n_name, {', '.join(f'b{i}' for i in _N)}, {' AND '.join(f"xor(b{i}, {_atom(repr('role'), i)}) = a{i}" for i in _N)} AS same FROM x""")
def bind_unbind_roundtrip(spark, sf):
    a, role = hv.atom(F.col("n_name")), hv.atom(F.lit("role"))
    bound = hv.bind(a, role)
    return table(spark, sf, "nation").select("n_name", *[x.alias(f"b{i}") for i, x in enumerate(_lanes(bound))], (hv.bind(bound, role) == a).alias("same"))


@query(f"SELECT n_name, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('n_name', repr('old'), repr('new'))))} FROM nation")
def counterfactual_swap(spark, sf):
    return table(spark, sf, "nation").select("n_name", *_lanes(hv.counterfactual(hv.atom(F.col("n_name")), hv.atom(F.lit("old")), hv.atom(F.lit("new")))))


@query(f"SELECT n_name, r_name, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('n_name', 'r_name', repr('ASIA'))))} FROM nation JOIN region ON n_regionkey = r_regionkey")
def analogy_vector(spark, sf):
    v = hv.analogy(hv.atom(F.col("n_name")), hv.atom(F.col("r_name")), hv.atom(F.lit("ASIA")))
    return _nations(spark, sf).select("n_name", "r_name", *_lanes(v))


_FACTS = f"SELECT n_name, r_name, 1 AS one, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor(repr('in'), 'n_name', 'r_name')))} FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH k AS ({_bundle_sql(_FACTS, 'one')}), q AS (SELECT n_name, {', '.join(f"xor(k.l{i}, xor({_atom(repr('in'), i)}, {_atom('n_name', i)})) AS l{i}" for i in _N)} FROM nation, k), r AS (SELECT r_name, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_xor('r_name')))} FROM region),
d AS (SELECT n_name, r_name AS answer, {_distance('q', 'r')} AS distance, row_number() OVER (PARTITION BY n_name ORDER BY {_distance('q', 'r')}, r_name) AS rn FROM q, r) SELECT n_name, answer, CAST(distance AS BIGINT) AS distance FROM d WHERE rn = 1""")
def kg_facts_query(spark, sf):
    """Every nation's region asked from one bundle of all facts (relation ^ subject ^ object)."""
    n = _nations(spark, sf)
    fact = hv.bind(hv.bind(hv.atom(F.lit("in")), hv.atom(F.col("n_name"))), hv.atom(F.col("r_name")))
    k = hv.bundle(n.select(F.lit(1).alias("one"), fact.alias("hv")), ["one"]).select(F.col("hv").alias("k"))
    book = table(spark, sf, "region").select("r_name", hv.atom(F.col("r_name")).alias("hv")).groupBy().agg(F.collect_list(F.struct("r_name", "hv")).alias("book"))
    asked = n.join(F.broadcast(k), F.lit(True)).join(F.broadcast(book), F.lit(True))  # one row each
    q = hv.bind(F.col("k"), hv.bind(hv.atom(F.lit("in")), hv.atom(F.col("n_name"))))
    near = F.array_min(F.transform("book", lambda b: F.struct(hv.hamming(q, b["hv"]).alias("d"), b["r_name"].alias("r"))))
    return asked.select("n_name", near.alias("x")).select("n_name", F.col("x.r").alias("answer"), F.col("x.d").cast("long").alias("distance"))


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region),
w AS (SELECT child, parent, 1 AS hops FROM e UNION ALL SELECT w.child, e.parent, hops + 1 FROM w JOIN e ON w.parent = e.child) SELECT parent AS concept, hops, count(*) AS members FROM w GROUP BY 1, 2""")
def taxonomy_members(spark, sf):
    """How many entities have a concept as an ancestor, by distance: counted per parent, then the counts climb the few concepts."""
    n, r, c = (table(spark, sf, x) for x in ("nation", "region", "customer"))
    up = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("concept"), F.col("r_name").alias("next")).union(r.select("r_name", F.lit("WORLD")))
    leaves = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members")).join(n, F.col("c_nationkey") == n.n_nationkey).select(F.col("n_name").alias("concept"), "members")
    inner = up.groupBy(F.col("next").alias("concept")).agg(F.count(F.lit(1)).alias("members"))
    level, out = leaves.union(inner), None
    for hops in (1, 2, 3):  # as many levels as the taxonomy has
        level = level.groupBy("concept").agg(F.sum("members").alias("members"))
        own = level.select("concept", F.lit(hops).alias("hops"), "members")
        out = own if out is None else out.union(own)
        level = level.join(up, "concept").select(F.col("next").alias("concept"), "members")
    return out


@query("SELECT s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def n_hop_chain(spark, sf):
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_name", "n_name", "r_name")
