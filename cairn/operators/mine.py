"""Mining of token sequences: document frequencies, n-grams, co-occurrence, phrase and typed patterns, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hv import top_k


def document_frequency(rows: DataFrame, words: Column) -> DataFrame:
    """token, df: rows that hold it; partial counts meet by token."""
    return rows.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def held(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """rows with columns computed once: a generator between keeps them from being inlined into lambdas, where they would run for each element."""
    both = F.struct(*[c.alias(k) for k, c in columns.items()])
    return rows.select(*keep, F.explode(F.array(both)).alias("_held")).select(*keep, "_held.*")


def ngrams(words: Column, n: int) -> Column:
    """Array of n-word arrays."""
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice(words, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def windows(words: Column, least: int, most: int) -> Column:
    return F.flatten(F.array(*[ngrams(words, n) for n in range(least, most + 1)]))


def transitions(rows: DataFrame, words: Column, order: int) -> DataFrame:
    """context (order words), next, n: how often a word follows a context inside a row."""
    g = held(rows, [], w=words).select(F.explode(ngrams(F.col("w"), order + 1)).alias("g"))
    return g.groupBy(F.array_join(F.slice("g", 1, order), " ").alias("context"), F.element_at("g", order + 1).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def best_next(counts: DataFrame) -> DataFrame:
    """For each context its most frequent next word (the first by letter at a tie) and that one's share."""
    total = counts.groupBy("context").agg(F.sum("n").alias("total"))
    best = top_k(counts, ["context"], [F.desc("n"), F.col("next")], 1)
    return best.join(total, "context").select("context", "next", (F.col("n") / F.col("total")).alias("p"))


def cooccurrence(rows: DataFrame, words: Column, window: int) -> DataFrame:
    """a, b, n: pairs of different words at most so many words apart, counted in both directions."""
    near = lambda i: F.slice("w", i, F.lit(window + 1))  # noqa: E731 (a word and those after it, so that no row holds a whole text)
    own = held(rows, [], w=words).where(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), near)).alias("g"))
    one = own.select(F.element_at("g", 1).alias("a"), F.explode(F.slice("g", 2, window)).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return one.union(one.select(F.col("b"), F.col("a"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def phrase_patterns(rows: DataFrame, words: Column, least: int = 4, most: int = 6, count: int = 3, content: int = 2) -> DataFrame:
    """pattern, n, first_subject, first_object: recurring windows with content words as <C>, with at least so many of them and a function word."""
    w = held(rows, [], w=words).select(F.explode(windows(F.col("w"), least, most)).alias("w"))
    is_content = lambda x: ~F.lower(x).isin(tx.FUNCTION_WORDS)
    own = F.filter("w", is_content)
    w = w.select("w", own.alias("own")).where((F.size("own") >= content) & (F.size("own") < F.size("w")))
    pattern = F.array_join(F.transform("w", lambda x: F.when(is_content(x), "<C>").otherwise(F.lower(x))), " ")
    pair = F.struct(F.element_at("own", 1).alias("s"), F.element_at("own", -1).alias("o"))
    return w.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(pair).alias("p")).where(F.col("n") >= count).select("pattern", "n", F.col("p.s").alias("first_subject"), F.col("p.o").alias("first_object"))


def pattern_triples(rows: DataFrame, words: Column, least: int = 4, most: int = 6, count: int = 3, content: int = 2) -> DataFrame:
    """relation, s, o, n: the first and last content word of all instances of the patterns of phrase_patterns, which are numbered by count, then by letter."""
    w = held(rows, [], w=words).select(F.explode(windows(F.col("w"), least, most)).alias("w"))
    is_content = lambda x: ~F.lower(x).isin(tx.FUNCTION_WORDS)
    own = F.filter("w", is_content)
    w = w.select("w", own.alias("own")).where((F.size("own") >= content) & (F.size("own") < F.size("w")))
    pattern = F.array_join(F.transform("w", lambda x: F.when(is_content(x), "<C>").otherwise(F.lower(x))), " ")
    one = w.groupBy(pattern.alias("pattern"), F.element_at("own", 1).alias("s"), F.element_at("own", -1).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    totals = one.groupBy("pattern").agg(F.sum("n").alias("total")).where(F.col("total") >= count)
    numbered = totals.select("pattern", F.row_number().over(Window.orderBy(F.desc("total"), "pattern")).cast("long").alias("relation"))  # patterns, not instances
    return one.join(numbered, "pattern").groupBy("relation", "s", "o").agg(F.sum("n").alias("n"))


def generated(counts: DataFrame, starts: DataFrame, steps: int, width: int, repeated: float = 0.510826) -> DataFrame:
    """qid, text, score: starts (qid, start) gone on with for some steps; ``width`` beams of each are kept, by the sum of log-shares less ``repeated`` for each time that a word is there already.

    counts: context, next, n of single words. A step is a join and a cut for each start.
    """
    total = counts.groupBy("context").agg(F.sum("n").alias("s"))
    t = counts.join(total, "context").select("context", "next", F.round(F.ln(F.col("n") / F.col("s")), 6).alias("lp"))
    beams = starts.select("qid", F.array("start").alias("w"), F.lit(0.0).alias("score"))
    for _ in range(steps):
        more = beams.join(t, F.element_at("w", -1) == F.col("context"))
        again = F.size(F.filter("w", lambda x: x == F.col("next")))
        made = more.select("qid", F.concat("w", F.array("next")).alias("w"), F.round(F.col("score") + F.col("lp") - repeated * again, 6).alias("score"))
        beams = top_k(made, ["qid"], [F.desc("score"), F.array_join("w", " ")], width).drop("rank")
    return top_k(beams, ["qid"], [F.desc("score"), F.array_join("w", " ")], 1).select("qid", F.array_join("w", " ").alias("text"), "score")


def typed(rows: DataFrame, words: Column) -> DataFrame:
    """w, t: tokens and their types: NUMBER, ENTITY (capitalised, at the start only if no function word), else the lower-case word."""

    def tag(w: Column, i: Column) -> Column:
        number = w.rlike(r"^\p{N}+s?$")
        entity = w.rlike(r"^\p{Lu}") & ((i > 0) | ~F.lower(w).isin(tx.TYPED_FUNCTION_WORDS))
        return F.when(number, "NUMBER").when(entity, "ENTITY").otherwise(F.lower(w))

    once = held(rows, [], w=words)
    return held(once, ["w"], t=F.transform("w", tag))


def rich_types(words: Column) -> Column:
    """A type for each word: DATE, NUMBER, ORG (capitalised, with a company's or school's word among it and the three after it), PLACE (after a preposition of place), PERSON_NAME (after a title or such a name), ENTITY, else the lower-case word."""
    cap = lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*tx.PERSON_TITLES, *tx.RICH_FUNCTION_WORDS, *tx.MONTH_WORDS)
    number = lambda w: w.rlike(r"^\p{N}+s?$")

    def step(done: Column, i: Column) -> Column:
        w, before = F.get(words, i), F.try_element_at(done, F.lit(-1))
        org = F.exists(F.slice(words, i + 1, F.lit(4)), lambda x: F.lower(x).isin(*tx.ORG_SUFFIXES))
        named = F.when(org, "ORG").when(F.coalesce(before, F.lit("")).isin(*tx.LOCATION_PREPS), "PLACE").when(F.coalesce(before, F.lit("")).isin("PERSON_NAME", *tx.PERSON_TITLES), "PERSON_NAME").otherwise("ENTITY")
        year = w.rlike(r"^(?:1[0-9]{3}|20[0-9]{2}|2100)s?$")
        return F.concat(done, F.array(F.when(year, "DATE").when(number(w), "NUMBER").when(F.lower(w).isin(*tx.MONTH_WORDS), "DATE").when(cap(w), named).otherwise(F.lower(w))))

    none = F.array().cast("array<string>")
    return F.when(F.size(words) > 0, F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), none, step)).otherwise(none)


RICH = ("ENTITY", "PERSON_NAME", "PLACE", "ORG", "DATE", "NUMBER")


def rich_windows(rows: DataFrame, words: Column, least: int = 4, most: int = 7, count: int = 3, slots: int = 2) -> DataFrame:
    """pattern, n: recurring windows of rich types with at least so many typed places."""
    t = held(held(rows, [], w=words), [], t=rich_types(F.col("w")))
    w = t.select(F.explode(windows(F.col("t"), least, most)).alias("w")).where(F.size(F.filter("w", lambda x: x.isin(*RICH))) >= slots)
    return w.groupBy(F.array_join("w", " ").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def typed_windows(rows: DataFrame, words: Column, least: int = 4, most: int = 7, count: int = 2, entities: int = 2) -> DataFrame:
    """pattern, n: recurring windows of types with at least so many entities."""
    w = typed(rows, words).select(F.explode(windows(F.col("t"), least, most)).alias("w"))
    w = w.where(F.size(F.filter("w", lambda t: t == "ENTITY")) >= entities)
    return w.groupBy(F.array_join("w", " ").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def typed_triples(rows: DataFrame, words: Column, least: int = 4, most: int = 5, upper=F.upper) -> DataFrame:
    """s, label, o, n: first and last entity of a window, labelled by its first three literal content words, in upper case by ``upper``."""
    both = held(typed(rows, words), [], z=F.arrays_zip("w", "t"))
    v = both.select(F.explode(F.flatten(F.array(*[_pieces(F.col("z"), n) for n in range(least, most + 1)]))).alias("v"))
    entity = F.filter("v", lambda x: x["t"] == "ENTITY")
    literal = F.filter("v", lambda x: ~x["t"].isin("ENTITY", "NUMBER") & ~x["t"].isin(tx.TYPED_FUNCTION_WORDS))
    label = F.concat(F.lit("REL_"), F.array_join(F.transform(F.slice(literal, 1, 3), lambda x: upper(x["t"])), "_"))
    v = v.where((F.size(entity) >= 2) & (F.size(literal) >= 1))
    out = v.select(F.element_at(entity, 1)["w"].alias("s"), label.alias("label"), F.element_at(entity, -1)["w"].alias("o"))
    return out.groupBy("s", "label", "o").agg(F.count(F.lit(1)).alias("n"))


def _pieces(x: Column, n: int) -> Column:
    size = F.size(x)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice(x, i, F.lit(n)))).otherwise(F.slice(F.array(x), 1, 0))


def cross_validated(triples: DataFrame, least: int = 2) -> DataFrame:
    """s, o, labels: pairs that at least so many different labels join, in either direction."""
    pair = triples.select(F.least("s", "o").alias("s"), F.greatest("s", "o").alias("o"), "label")
    return pair.groupBy("s", "o").agg(F.count_distinct("label").alias("labels")).where(F.col("labels") >= least)


def slots(rows: DataFrame, group: list[str], words: Column, width: int | None = None) -> DataFrame:
    """group, pos, n: places where the words of a group's rows differ and all are content words.

    Places run to the end of the group's shortest row, or over the first ``width`` of each row where that is given.
    """
    if width is None:
        w = held(rows, group, w=words)
        least = w.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.min(F.size("w")).alias("_least"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
        w = w.join(least, same).select(*group, F.slice("w", F.lit(1), F.col("_least")).alias("w"))
    else:
        w = rows.select(*group, F.slice(words, 1, width).alias("w"))
    p = w.select(*group, F.posexplode("w").alias("pos", "w"))
    return p.groupBy(*group, "pos").agg(F.count_distinct("w").alias("n"), F.bool_and(~F.lower("w").isin(tx.FUNCTION_WORDS)).alias("free")).where("n > 1 and free").drop("free")
