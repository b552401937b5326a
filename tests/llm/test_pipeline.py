import random

import corpus_pipeline

from .cases import HARD, hard_rows, words
from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as grouped
from .test_jaccard_join import rows_left
from .test_line_dedup import brute as lines_left


def test_stages(spark, tmp_path):
    """Each stage against brute force on its own input, and run() against the stages."""
    rng = random.Random(5)
    line = "A line that more than three of the documents hold here."
    passage = words(rng, 30, "klmnopq")
    rows = []
    for i in range(40):
        lang = ("en", "fr")[i % 2]
        own = words(rng, 60, "abcdef" if lang == "en" else "uvwxyz")
        rows.append((i, own + (f"\n{line}" if i % 4 == 0 else "") + (f"\n{passage}" if i % 10 == 3 else ""), lang, f"s{i % 3}", len(own)))
    rows += [(50, rows[1][1] + " end", "fr", "s1", 9), (51, None, None, None, None), (52, "12 34", "en", "s", 5), (53, rows[2][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        texts = [(r.doc_id, r.text) for r in before.collect()]
        ids = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            assert ids == {i for i, t in texts if t and any(c.isalpha() for c in t)}
        if name == "line_dedup":
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((i, t) for (i, _), (*_, t) in zip(texts, lines_left(texts), strict=True))
            assert sum(line in (r.text or "") for r in docs.collect()) == 1
        if name == "jaccard_join":
            want, _ = grouped(texts, 5, 80, 100)
            assert ids == {i for i, c in want.items() if i == c} and len(ids) < len(texts)
        if name == "decontamination":
            assert {i for i, _ in texts} - ids == {i for i, *_ in contaminated(texts, [(7, passage)])} != set()
        if name != "byte_bpe":
            assert docs.columns == columns
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_stages_on_hard_rows(spark, tmp_path):
    """Null and repeated ids, and columns named like those that the stages use: each stage against brute force, all columns kept."""
    rng = random.Random(8)
    item = words(rng, 30, "klmnopq")
    rows = hard_rows() + [(i, words(rng, 40, "uvwxyz"), "fr", "s", 1, *hard_rows()[0][5:]) for i in range(60, 90)]
    rows += [(None, f"x {item} y", "en", *rows[0][3:]), (8, f"{item} z", "en", *rows[0][3:])]
    docs = spark.createDataFrame(rows, HARD)
    items = [(1, item), (None, "not there at all"), (1, words(rng, 9, "klmn"))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        names, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        same = lambda a, b: sorted(a, key=str) == sorted(b, key=str)
        texts = [r[:2] for r in before]
        if name == "byte_bpe":
            assert len(after) == len(before) and same([r[0] for r in after], [r[0] for r in before])
            continue
        assert docs.columns == names
        if name == "language_id":
            lang = names.index("lang")
            bare = lambda r: r[:lang] + r[lang + 1 :]  # noqa: B023, E731
            assert {bare(r) for r in after} <= {bare(r) for r in before if r[1] and any(c.isalpha() for c in r[1])} and len(after) > 30
        if name == "line_dedup":
            n = names.index("n_chars")
            want = [(r[0], t, *r[2:n], len(t) if d else r[n], *r[n + 1 :]) for r, (_, d, t) in zip(before, lines_left(texts), strict=True)]
            assert same(after, want) and any(d for _, d, _ in lines_left(texts))
        if name == "jaccard_join":
            kept, always = rows_left(before, 5, 80, 100)
            assert same([r[:2] for r in after], [*kept, *[r[:2] for r in always]]) and set(after) <= set(before) and len(after) < len(before)
        if name == "decontamination":
            clean = [r for r in before if not contaminated([r[:2]], items)]
            assert same(after, clean) and len(clean) < len(before)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], HARD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
