"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, giving components of links.

Tokens are hashes of word n-grams. One global order puts rare tokens first: tokens that
some part of the corpus holds often come last, by that count. If two sets of Jaccard
similarity t or more are cut to their first n - ceil(t n) + l tokens, the cut sets share
l tokens at least. Each document picks its own l: a longer prefix costs more postings,
but a pair must then share l of them (the smaller l of the two) before it is verified.
The choice minimises postings plus expected verifications, both estimated from the
token counts.

Sets that are equal form a class, and only its least document takes part. Tokens with
many documents first link these to one pivot (a star, so a group of N near copies makes
N pairs, not N^2). What these links don't join is then enumerated, but only between
different components: the documents outside a token's largest component against all
documents of that token. A pair shares a token of both prefixes for l = 1 at least. At such
tokens with more than ``CROWD`` documents the prefixes
themselves are compared inside the join, so that no pair comes out that they rule out:
of the document whose prefix ends first, all prefix tokens that the other's prefix lacks are
missing from the other. The other pairs meet at tokens with fewer documents; where those
alone are less than l, the crowded ones may make up the rest, and the prefixes are
compared too. Crowded tokens are compared ``SPREAD`` documents at a time, so no task gets all of a
token. Of the prefixes, which take more disk than all else, only those that are compared are moved;
tokens of several documents are found in ``PASSES`` passes, as the shuffle files of one pass go before the next. Every pair is verified with whole sets, which are made again
from the texts of the documents that have such pairs. Sets are of 52-bit hashes of n-grams: two
n-grams of a pair of texts with n each are mistaken for one with a chance of n^2 / 2^52.

Edge cases: null text, empty text or no words: empty set, linked with nothing, its own
component; fewer words than n: the whole sequence is one token; repeated rows are equal
sets; rows that repeat a doc_id with other texts are one node, whose links are those of
any of its rows; a null doc_id is left out of links and is its own (null) component; an
empty table gives no rows; texts of any length are read whole; further columns are carried by ``keep_first``,
which decides by row, not by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, distinct_tokens, lean, longs, mix, row_groups, scratch_dir, shingles, small_batches, stored, string_buffers, word_hashes
from .components import components

#: Occurrences in one part of the corpus from which a token is reported, tokens of such a part, and tokens that the order singles out at most.
LOCAL, PART, ORDERED = 3, 2_000_000, 1 << 18
#: The values of l to choose from; cost of verifying a pair over that of a posting; other documents expected to hold a token that wasn't reported.
CHOICES, VERIFY, OTHERS = (1, 2, 4, 8, 16), 8.0, 0.5
MOST = CHOICES[-1]
#: Documents of a token from which they are linked to a pivot first, and from which prefixes are compared inside the join.
STAR, CROWD = 8, 32
#: Documents of a crowded token that are compared in one task.
SPREAD = 128
#: Passes over the prefixes, each for a part of the tokens, in which tokens of several documents are found; Spark frees the shuffle files of each.
PASSES = 2
#: Bits of the fixed-size filter that keeps most texts without pairs from being made into sets again.
FILTER_BITS = 1 << 23


PREFIX = ["id", "n", "l", "one", "lc", "lt", "tokens"]


def _token_sets(batch: pa.RecordBatch, k: int):
    """(rows a to b of the batch, tokens, their rows, offsets), 4,096 rows at a time."""
    data, off = string_buffers(batch.column("text"))
    for a, b in row_groups(off):
        words, woff = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        yield (a, b, *distinct_tokens(*shingles(words, woff, k)))


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _signatures(tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(mix(tokens), off), _sums(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), off)


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """id, n, s, g for each document (size and 128-bit signature of its set), and rows of frequent tokens: n their count, s the token, g null."""

    def run(batches):
        held, size = [], 0

        def frequent():
            x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(x)))
            often = count >= LOCAL
            m = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(count[often], pa.int64()), longs(x[first[often]]), pa.nulls(m, pa.int64())], names=["id", "n", "s", "g"])

        for batch in batches:
            ids = batch.column("id")
            for a, b, tokens, row, off in _token_sets(batch, k):
                s, g = _signatures(tokens, off)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(off), pa.int64()), longs(s), longs(g)], names=["id", "n", "s", "g"])
                fresh = np.zeros(b - a, bool)
                fresh[np.unique(s, return_index=True)[1]] = True  # copies count once
                held.append(tokens[fresh[row]])
                size += len(held[-1])
                if size > PART:
                    yield frequent()
                    held, size = [], 0
        yield frequent()

    return docs.mapInArrow(lean(run), "id long, n long, s long, g long")


def _ordered_prefixes(tokens, row, off, hot, hot_count, num, den):
    """For each row: the tokens of its prefix, in order, with counts per row, its l, the size of its prefix for l = 1, and its last token with its count."""
    rows = len(off) - 1
    n = np.diff(off)
    base = n - -(-n * num // den)
    at = np.searchsorted(hot, tokens)
    at[at == len(hot)] = 0
    is_hot = hot[at] == tokens if len(hot) else np.zeros(len(tokens), bool)
    cold = ~is_hot
    rank = np.cumsum(cold) - 1
    first = np.append(0, np.cumsum(cold))[off[:-1]]
    rank = rank - first[row]
    n_cold = _sums(cold.astype(np.int64), off)
    place = np.where(cold, rank, -1)
    h = np.flatnonzero(is_hot & (n_cold[row] < (base + MOST)[row]))
    count = np.zeros(len(tokens), np.int64)
    if len(h):  # hot tokens follow, by count, where the cold ones don't fill the prefix
        count[h] = hot_count[at[h]]
        order = h[np.lexsort((tokens[h], count[h], row[h]))]
        r = row[order]
        start = np.searchsorted(r, r)
        place[order] = n_cold[r] + np.arange(len(r)) - start
    inside = (place >= 0) & (place < (base + MOST)[row])
    best, which = np.full(rows, np.inf), np.ones(rows, np.int64)
    others = np.where(count > 0, count, OTHERS)
    for m in CHOICES:
        part = inside & (place < (base + m)[row])
        cost = np.bincount(row[part], others[part], rows) * (1 + VERIFY / m)
        better = (cost < best) & ((m == 1) | (n >= base + m))
        best[better], which[better] = cost[better], m
    keep = np.flatnonzero(inside & (place < (base + which)[row]))
    keep = keep[np.lexsort((place[keep], row[keep]))]
    size = np.bincount(row[keep], minlength=rows)
    last = keep[np.maximum(np.cumsum(size) - 1, 0)] if len(keep) else np.zeros(rows, np.int64)
    ends = (count[last], tokens[last]) if len(keep) else (last, last)
    return tokens[keep], size, which, base + 1, ends


def prefix_rows(docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray, hot_count: np.ndarray) -> DataFrame:
    """id, n, l, one (size of the prefix for l = 1), lc and lt (count and token that end the prefix) and tokens (the prefix) for each document that has tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, hot_count))

    def run(batches):
        hot, hot_count = shared.value
        for batch in batches:
            ids = batch.column("id")
            for a, b, tokens, row, off in _token_sets(batch, k):
                got, count, most, one, (lc, lt) = _ordered_prefixes(tokens, row, off, hot, hot_count, num, den)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), longs(got))
                full = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(off), pa.int64()), pa.array(most, pa.int64()), pa.array(one, pa.int64()), longs(lc), longs(lt), lists], names=PREFIX)
                yield full.filter(pa.array(count > 0))

    return docs.mapInArrow(lean(run), "id long, n long, l long, one long, lc long, lt long, tokens array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and its sorted tokens as bytes, for the documents of ids (a column id).

    A bitmap of FILTER_BITS bits, of hashes of ids, goes to the tasks that read the texts, so
    the texts needn't be shuffled; what passes it by chance falls to the join.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    maps = ids.select((slot + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    bits = np.zeros(FILTER_BITS + 32_768, bool)
    for r in maps.collect():  # FILTER_BITS / 32,768 rows of 4 KB at most
        own = np.unpackbits(np.frombuffer(r.m, np.uint8), bitorder="little")
        bits[(r.k - 1) * 32_768 : (r.k - 1) * 32_768 + len(own)] = own
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("slot").to_numpy()]))
            own = batch.column("id")
            for a, b, tokens, _, off in _token_sets(batch, k):
                sets = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(off * 8), pa.py_buffer(tokens)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([own.slice(a, b - a), sets], names=["id", "tokens"])

    made = docs.where("id is not null").select("id", slot.alias("slot"), "text").mapInArrow(lean(run), "id long, tokens binary")
    return made.join(ids, "id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, path: str) -> DataFrame:
    """The pairs (a, b) whose whole sets have den * intersection >= num * union; their sets are written to path."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(whole_sets(docs, ids, k), path)
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                good[i] = den * both >= num * (len(x) + len(y) - both) and both > 0
            yield batch.select(["a", "b"]).filter(pa.array(good))

    # a may be the pivot of a third of all documents: its set comes last, so that it goes through no shuffle with
    # each pair; Spark splits the pairs of such a key and reads its set once for each part
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def shared_tokens(prefixes: DataFrame, path: str) -> DataFrame:
    """id, n, l, early (whether the token is in the prefix for l = 1), token and w (its documents) for each prefix token of several documents; written below path."""
    posts = prefixes.select("id", "n", "l", "one", F.posexplode("tokens").alias("at", "token")).select("id", "n", "l", (F.col("at") < F.col("one")).alias("early"), "token")
    for p in range(PASSES):
        part = posts.where(F.pmod("token", F.lit(PASSES)) == p)
        counts = part.groupBy("token").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
        made = stored(part.join(counts, "token"), f"{path}/{p}")
    return prefixes.sparkSession.read.schema(made.schema).parquet(*[f"{path}/{p}" for p in range(PASSES)])


def linked_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id for each row of docs; two sets link where den * intersection >= num * union."""
    spark = docs.sparkSession
    small_batches(spark)
    top = scratch_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stored(set_rows(docs, k), f"{top}/rows")
    sets = rows.where("g is not null")
    hot = rows.where("g is null").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(ORDERED).toPandas()
    hot = hot.sort_values("s")
    live = sets.where("n > 0 and id is not null")
    classes = live.groupBy("s", "g").agg(F.min("id").alias("rep"))
    # what goes is mostly less than what stays; written, so that Spark knows where it is few and need not move the prefixes
    copies = stored(live.select("id").distinct().join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), f"{top}/copies")
    prefixes = prefix_rows(docs.where("id is not null"), k, num, den, hot.s.to_numpy(np.int64).view(np.uint64), hot.n.to_numpy(np.int64))
    prefixes = stored(prefixes.join(copies, "id", "left_anti"), f"{top}/prefixes")
    shared = shared_tokens(prefixes, f"{top}/shared")
    fits = f"{den} * least(n, m) >= {num} * greatest(n, m)"
    # the pivot is the document with the fewest prefix tokens of its own: likely the one the others were made from
    own = shared.groupBy("id").agg(F.count(F.lit(1)).alias("k")).join(prefixes.select("id", F.size("tokens").alias("p")), "id").select("id", (F.col("k") - F.col("p")).alias("score"))
    many = shared.where(f"w >= {STAR}")
    pivots = many.join(own, "id").groupBy("token").agg(F.max(F.struct("score", -F.col("id"), "n", "l")).alias("p"))
    stars = many.join(pivots.select("token", (-F.col("p.col2")).alias("pivot"), F.col("p.n").alias("m"), F.col("p.l").alias("lp")), "token").where(f"id <> pivot and {fits}")
    stars = stars.groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min(F.least("l", "lp")).alias("need"), F.max("pivot").alias("p"))
    stars = stored(stars.where("k >= need").select("a", "b", "p"), f"{top}/stars")
    from_pivot = stars.select(F.col("p").alias("a"), F.when(F.col("a") == F.col("p"), F.col("b")).otherwise(F.col("a")).alias("b"))
    links = stored(verified(from_pivot, docs, k, num, den, f"{top}/star_sets"), f"{top}/links")
    discard(spark, f"{top}/star_sets")
    found = stored(components(links), f"{top}/found")
    # between components
    crowds = shared.where(f"w > {CROWD}").groupBy("id").agg(F.count(F.lit(1)).alias("q"))  # crowded tokens of a prefix
    there = shared.join(found.withColumnRenamed("node", "id"), "id", "left").join(crowds, "id", "left")
    there = there.select("token", "id", "n", "l", "early", "w", F.coalesce("component", "id").alias("c"), F.coalesce("q", F.lit(0)).alias("q"))
    there = stored(there, f"{top}/there")
    discard(spark, f"{top}/shared", f"{top}/found")
    tally = there.groupBy("token", "c").agg(F.count(F.lit(1)).alias("w"))
    mixed = tally.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("w", "c")).alias("top")).where("k > 1").select("token", F.col("top.c").alias("main"))
    open_ = there.join(mixed, "token")
    other = lambda df: df.where("c <> main").select("token", *[F.col(c).alias(f"{c}_") for c in df.columns if c not in ("token", "main", "w")])
    between = f"c <> c_ and (c = main or id < id_) and {fits.replace('m)', 'n_)')}"
    plain = open_.where(f"w <= {CROWD}")
    met = other(plain).join(plain, "token").where(between).groupBy(F.least("id_", "id").alias("a"), F.greatest("id_", "id").alias("b"))
    met = met.agg(F.count(F.lit(1)).alias("k"), F.min(F.least("l", "l_")).alias("need"), F.min(F.least("q", "q_")).alias("q"), F.max(F.expr("early and early_")).alias("early"))
    met = stored(met.where("early and k + q >= need").select("a", "b", (F.col("k") < F.col("need")).alias("short")), f"{top}/met")
    crowd = stored(open_.where(f"w > {CROWD} and early"), f"{top}/crowd")
    discard(spark, f"{top}/there")
    # of the prefixes, those that are compared are kept
    compared = met.where("short").select(F.explode(F.array("a", "b")).alias("id")).union(crowd.select("id")).distinct()
    ends = stored(prefixes.select("id", "n", "l", "lc", "lt", "tokens").join(compared, "id", "left_semi"), f"{top}/ends")
    discard(spark, f"{top}/prefixes")
    crowd = crowd.join(crowd.groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("crowded")), "id").join(ends.select("id", "lc", "lt", "tokens"), "id")
    overlap = f"ceil({num} * (n + n_) / {num + den})"
    ends_first = "(lc < lc_ or (lc = lc_ and lt <= lt_))"
    lacks = lambda n, l: f"({overlap} - ceil({num} * {n} / {den}) + {l})"
    enough = f"size(array_intersect(tokens, tokens_)) >= case when {ends_first} then {lacks('n', 'l')} else {lacks('n_', 'l_')} end"
    # each pair comes out once: at the first of the crowded tokens that both have
    first = "get(array_intersect(crowded, crowded_), 0) = token"
    left, right = ends.withColumnRenamed("id", "a"), ends.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_") for c in ends.columns[1:]])
    short = stored(met.where("short").join(left, "a").join(right, "b").where(enough).select("a", "b"), f"{top}/short")
    # a crowded token is dealt out in SPREAD documents at a time: its documents outside the main component go to each part
    salt = lambda x: F.pmod(F.xxhash64("id"), x)
    spread = F.ceil(F.col("w") / SPREAD).cast("long")
    outside = other(crowd.withColumn("salts", F.sequence(F.lit(0).cast("long"), spread - 1))).withColumn("salt", F.explode("salts_"))
    dense = outside.join(crowd.withColumn("salt", salt(spread)), ["token", "salt"]).where(f"{between} and {enough} and {first}").select(F.least("id_", "id").alias("a"), F.greatest("id_", "id").alias("b"))
    pairs = stored(met.where("not short").select("a", "b").union(short).union(dense).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"), f"{top}/pairs")
    discard(spark, *[f"{top}/{x}" for x in ("copies", "stars", "met", "crowd", "ends", "short")])
    more = stored(verified(pairs, docs, k, num, den, f"{top}/sets"), f"{top}/more")
    discard(spark, f"{top}/sets", f"{top}/pairs")
    final = components(links.union(more))
    by_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("s", "g", F.coalesce("component", "rep").alias("c"))
    out = sets.join(by_class, ["s", "g"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("c", "id")).alias("component_id"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each group of linked texts the row of the least id stays (of several, one), the same of equal rows.

    A row counts by its id and text together (a 64-bit hash of both), so other texts under its id are not
    touched. Rows without an id, and those without words, all stay.
    """
    node = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    top = scratch_dir(docs.sparkSession)
    made = linked_components(docs.select(node.alias("_node"), F.col(text_col).alias("text")), id_col="_node", **options)
    made = stored(made.where("id is not null and n_shingles > 0").select("id", F.col("component_id").alias("c")), f"{top}/made")
    several = made.groupBy("c").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("c")
    members = stored(made.join(several, "c"), f"{top}/members")
    named = docs.select(node.alias("id"), F.col(id_col).cast("long").alias("i"))
    best = members.join(named, "id").groupBy("c").agg(F.min(F.struct("i", "id")).alias("b")).select("c", "b.id")
    first = stored(members.join(best, ["c", "id"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")), f"{top}/first")
    # written, so that Spark knows how few they are and need not move the texts
    lost = stored(members.join(first, "id", "left_anti").select("id").distinct(), f"{top}/lost")
    again = stored(first.where("n > 1"), f"{top}/again")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), node.alias("_node"))
    rows = rows.join(lost, F.col("_node") == lost["id"], "left_anti")
    out = [F.col("_row")[c].alias(c) for c in docs.columns]
    if again.isEmpty():
        return rows.select(*out)
    one = rows.join(again, F.col("_node") == F.col("id"), "left_semi").groupBy("_node").agg(F.min_by("_row", F.struct(F.xxhash64("_row"), F.col("_row").cast("string"))).alias("_row"))
    return rows.join(again, F.col("_node") == F.col("id"), "left_anti").select(*out).unionByName(one.select(*out))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linked_components(docs, k=3, num=90, den=100).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT l.a, l.b FROM l JOIN n x ON x.doc_id = l.a JOIN n y ON y.doc_id = l.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
