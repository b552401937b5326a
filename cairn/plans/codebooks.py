"""Codebooks of the embeddings: k-means, and vectors as bundles of positions bound to code words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codebook
from .registry import query, table

WORDS, ROUNDS = 8, 4
#: Patches of a vector, their code words, lanes of the bundles.
POSITIONS, PATCH_WORDS, LANES = 8, 16, 20


def _kmeans_sql() -> str:
    far = lambda c: f"sqrt(list_sum(list_transform(list_zip(x, {c}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    out = f"""WITH v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda e: round(e::DOUBLE * {codebook.SCALE})) AS x FROM embeddings),
c0 AS MATERIALIZED (SELECT x AS c, CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS code FROM (SELECT x, min((md5(CAST(id AS VARCHAR)), id)) AS o FROM v GROUP BY x) ORDER BY o LIMIT {WORDS})"""
    for r in range(1, ROUNDS + 1):
        out += f""", a{r} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(code, ({far('c')}, code)) AS code FROM v, c{r - 1} GROUP BY id),
s{r} AS (SELECT code, list(s ORDER BY i) AS c FROM (SELECT code, i, sum(e) / count(*) AS s FROM (SELECT code, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1), c{r} AS MATERIALIZED (SELECT code, coalesce(s.c, b.c) AS c FROM c{r - 1} b LEFT JOIN s{r} s USING (code))"""
    return out


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"{_kmeans_sql()} SELECT id, code FROM a{ROUNDS}")
def codebook_codes(spark, sf):
    """The centroid of each vector after four rounds of k-means."""
    return codebook.train(_vectors(spark, sf), WORDS, ROUNDS)[0]


@query(f"{_kmeans_sql()} SELECT code, CAST(generate_subscripts(c, 1) - 1 AS INT) AS i, round(unnest(c) / {codebook.SCALE}, 6) AS value FROM c{ROUNDS}")
def codebook_centroids(spark, sf):
    """The centroids, each value to six places."""
    centres = codebook.train(_vectors(spark, sf), WORDS, ROUNDS)[1]
    rows = [(code, i, round(float(x), 6)) for code, own in enumerate(centres) for i, x in enumerate(own)]
    return spark.createDataFrame(rows, "code int, i int, value double")


@query()
def codebook_roundtrip(spark, sf):
    """Vectors as bundles of eight positions bound to code words, decoded again: how many vectors, and of how many the word of each position came back. Without SQL."""
    e = _vectors(spark, sf)
    size = F.size("v") / POSITIONS
    cut = F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda p: F.slice(F.col("v"), (p * size + 1).cast("int"), size.cast("int")))
    patches = e.select("id", F.posexplode(cut).alias("p", "v")).select((F.col("id") * POSITIONS + F.col("p")).alias("id"), "v")
    words = codebook.train(patches, PATCH_WORDS, ROUNDS)[1]
    made = codebook.encode(e, words, LANES)
    both = made.join(codebook.decode(made, POSITIONS, len(words), LANES), "id")
    same = both.select(F.posexplode(F.zip_with("words", "decoded", lambda a, b: (a == b).cast("int"))).alias("position", "same"))
    return same.groupBy("position").agg(F.count(F.lit(1)).alias("vectors"), F.sum("same").alias("decoded"))
