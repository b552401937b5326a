"""A dictionary dump (JSON lines) as four tables: entries, related words, sounds, etymologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: relation fields of the dump
RELATIONS = ("synonyms", "antonyms", "hypernyms", "hyponyms", "derived", "related", "meronyms", "holonyms", "coordinate_terms")
_WORDS = "array<struct<word:string>>"
_REL = ", ".join(f"{r} {_WORDS}" for r in RELATIONS)
_REL_IN = ", ".join(f"{r}: {_WORDS}" for r in RELATIONS)
SCHEMA = (
    f"word string, pos string, senses array<struct<glosses: array<string>, tags: array<string>, examples: array<struct<text: string>>, {_REL_IN}>>, {_REL}, "
    "sounds array<struct<ipa: string, audio: string>>, etymology_text string"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries in file order (id); blank and malformed lines are skipped."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("word is not null and word <> ''")
    return rows.withColumn("id", F.monotonically_increasing_id()).withColumn("word", F.lower("word"))


def entries(dump: DataFrame) -> DataFrame:
    """word, pos, idx, gloss (the first of a sense), tags, examples (five at most)."""
    s = dump.select("id", "word", "pos", F.posexplode("senses").alias("idx", "s"))
    return s.where(F.size("s.glosses") > 0).select("id", "word", "pos", "idx", F.get("s.glosses", F.lit(0)).alias("gloss"), "s.tags", F.slice(F.col("s.examples.text"), 1, 5).alias("examples"))


def related(dump: DataFrame) -> DataFrame:
    """word, relation, target in order, each once: of the entry and of its senses; targets that open with "(" or have 80 characters or more go."""
    empty = F.array().cast(_WORDS)
    own = lambda r: F.concat(F.coalesce(r, empty), F.coalesce(F.flatten(F.transform("senses", lambda s: F.coalesce(s[r], empty))), empty))
    pairs = F.concat(*[_pairs(own(r), r) for r in RELATIONS])
    p = dump.select("id", "word", F.posexplode(pairs).alias("at", "p")).select("id", "word", "at", "p.*")
    p = p.where("target is not null and target <> '' and not startswith(target, '(') and length(target) < 80")
    return p.groupBy("word", "relation", "target").agg(F.min(F.struct("id", "at")).alias("first"))


def _pairs(words, relation: str):
    return F.transform(words, lambda x: F.struct(F.lit(relation).alias("relation"), x["word"].alias("target")))


def sounds(dump: DataFrame) -> DataFrame:
    """word, ipa, audio: the last entry of a word that has them wins."""
    first = lambda c: F.get(F.filter(F.col(f"sounds.{c}"), lambda x: x.isNotNull()), F.lit(0))
    s = dump.select("id", "word", first("ipa").alias("ipa"), first("audio").alias("audio")).where("ipa is not null or audio is not null")
    return s.groupBy("word").agg(F.max_by(F.struct("ipa", "audio"), "id").alias("s")).select("word", "s.*")


def etymologies(dump: DataFrame) -> DataFrame:
    e = dump.where("etymology_text is not null").select("id", "word", F.left("etymology_text", F.lit(8000)).alias("etymology"))
    return e.groupBy("word").agg(F.max_by("etymology", "id").alias("etymology"))


def look_up(dump: DataFrame, words: DataFrame) -> DataFrame:
    """Nested entries of the words asked for: senses, up to 20 related words per relation, sounds, etymology."""
    w = words.select(F.lower("word").alias("word")).distinct()
    senses = entries(dump).join(w, "word").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("id", "idx", "pos", "gloss", "examples"))).alias("senses"))
    rank = F.row_number().over(Window.partitionBy("word", "relation").orderBy("first", "target"))
    few = related(dump).join(w, "word").withColumn("rn", rank).where("rn <= 20").groupBy("word", "relation").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "target"))), lambda x: x["target"]).alias("t"))
    rel = few.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("relation", "t"))).alias("related"))
    return senses.join(rel, "word", "left").join(sounds(dump), "word", "left").join(etymologies(dump), "word", "left")
