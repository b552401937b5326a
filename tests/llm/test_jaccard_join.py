import random
import re
from pathlib import Path

import pytest

from cairn.llm import jaccard_join
from cairn.llm.components import components
from cairn.llm.jaccard_join import keep_first, linked_components

from .cases import edge_docs, edge_rows, empty_docs, words


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and den * both >= num * (len(x) + len(y) - both):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i, _ in rows}, {i: len(x) for i, x in sets}


def near_copies(seed, groups=12, most=30):
    rng = random.Random(seed)
    rows, n = [], 0
    common = words(rng, 12)
    for g in range(groups):
        base = words(rng, rng.choice([3, 8, 40, 90]), "abcdefghijklmnop").split()
        for _ in range(rng.choice([1, 2, 5, most])):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((n, " ".join(w) + (f" {common}" if rng.random() < 0.3 else "")))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den,crowd", [(3, 90, 100, 2), (5, 80, 100, 32)])
def test_matches_brute_force(spark, monkeypatch, k, num, den, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "STAR", 4 if crowd == 32 else 3)
    monkeypatch.setattr(jaccard_join, "SPREAD", 128 if crowd == 32 else 3)
    rows = near_copies(k * 7 + crowd)
    want, sizes = brute(rows, k, num, den)
    got = linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k, num=num, den=den).collect()
    assert len(got) == len(rows)
    assert {r.id: r.component_id for r in got} == want
    assert {r.id: r.n_shingles for r in got} == sizes
    assert len(set(want.values())) < len(rows)


def test_edges(spark):
    rows = list({r[0]: (r[0], r[1]) for r in edge_rows()}.values())
    want, _ = brute(rows, 5, 80, 100)
    got = linked_components(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows()) and all(r.component_id == want[r.id] for r in got)
    kept = keep_first(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
    assert linked_components(empty_docs(spark)).count() == 0


def rows_left(rows, k, num, den):
    """Which rows (id, text, ...) stay: one of each group of linked texts, that of the least id; rows without id or words all do."""
    live = [r for r in rows if r[0] is not None and shingles(r[1], k)]
    texts = sorted({r[:2] for r in live})
    group, _ = brute(list(enumerate(t for _, t in texts)), k, num, den)
    return {texts[i] for i, c in group.items() if i == c}, [r for r in rows if r[0] is None or not shingles(r[1], k)]


def test_keep_first_by_row(spark):
    """A text of its own under a repeated id stays where another text of that id goes, and equal rows leave one."""
    rng = random.Random(4)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a, "x"), (2, a + " end", "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (3, c, "y"), (3, b + " fin", "z"), (4, None, "x"), (4, None, "x"), (None, a, "x"), (5, " ", "x")] + [(9, a, "x")] * 50
    got = sorted((tuple(r)[:2] for r in keep_first(spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)).collect()), key=str)
    kept, always = rows_left(rows, 5, 80, 100)
    assert got == sorted([*kept, *[r[:2] for r in always]], key=str) and (2, b) in kept and (2, a + " end") not in kept


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (205, 200), (200, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}


@pytest.mark.parametrize("few,many", [(30, 33), (32, 33), (31, 40)])
def test_passages_on_both_sides_of_crowd(spark, few, many):
    """Two texts (45 of 55 words shared) whose early shared words few documents hold and whose other shared prefix words a crowd holds."""
    rng = random.Random(few)
    a, b, c = ([f"{x}{i}" for i in range(m)] for x, m in (("a", 6), ("b", 7), ("c", 32)))
    texts = [[f"{x}{i}" for i in range(5)] + a + b + c for x in "pq"]
    texts += [a + rng.sample(c, 24) for _ in range(few - 2)] + [b + rng.sample(c, 23) for _ in range(many - 2)]
    texts += [c + [f"r{j}_{i}" for i in range(20)] for j in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, _ = brute(rows, 1, 80, 100)
    assert want[0] == want[1] == 0 and set(want[i] for i in range(2, len(rows))).isdisjoint({0})
    got = linked_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), k=1, num=80, den=100).collect()
    assert {r.id: r.component_id for r in got} == want


def test_one_token_in_many_unlike_documents(spark):
    """A passage that 2,000 documents share, which links none of them, and two that are linked."""
    rng = random.Random(9)
    passage = words(rng, 6)
    rows = [(i, f"{passage} {words(rng, 12)}") for i in range(2000)]
    rows.append((2000, rows[7][1] + " end"))
    got = linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=3, num=85, den=100).collect()
    assert {r.id: r.component_id for r in got} == {i: 7 if i == 2000 else i for i in range(2001)}


def shuffled(spark, after):
    """Bytes that the stages later than after have shuffled, and the last stage."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    new = [s for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() > after]
    return sum(s.shuffleWriteBytes() for s in new), max([after, *(s.stageId() for s in new)])


def writes(spark, monkeypatch, path, rows, broadcast, **options):
    """Components by id, and by name of each table that jaccard_join writes: its bytes, and the bytes shuffled for it."""
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    last, size, moved = shuffled(spark, -1)[1], {}, {}
    write = jaccard_join.stored

    def stored(df, path):
        nonlocal last
        _, last = shuffled(spark, last)
        out = write(df, path)
        name = Path(path).name
        moved[name], last = shuffled(spark, last)
        size[name] = sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = linked_components(docs, **options).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return {r.id: r.component_id for r in got}, size, moved


def test_disk_of_each_write(spark, monkeypatch, tmp_path):
    """Where nothing is broadcast, what one write shuffles (Spark frees it afterwards) is little over the size of the prefixes."""
    rng = random.Random(6)
    passage = words(rng, 6)
    rows = [(i, words(rng, 200, "abcdefghijklmnop") + (f" {passage}" if i % 5 == 0 else "")) for i in range(4000)]
    rows += [(4000 + i, rows[i][1] + " end") for i in range(60)]
    got, size, moved = writes(spark, monkeypatch, f"{tmp_path}/docs", rows, "-1")
    assert got == {i: i - 4000 if i >= 4000 else i for i in range(4060)}
    assert size["prefixes"] > 500_000 and max(moved.values()) < 2.2 * size["prefixes"], (size, moved)


def test_few_copies_move_no_prefixes(spark, monkeypatch, tmp_path):
    """The form of op10, with more documents than may be broadcast and few copies: prefixes are written where they are made."""
    rng = random.Random(7)
    rows = [(i, words(rng, 100, "abcdefghijklmnop")) for i in range(4000)]
    rows += [(4000 + i, rows[i][1]) for i in range(40)]
    got, size, moved = writes(spark, monkeypatch, f"{tmp_path}/docs", rows, "16k", k=3, num=90, den=100)
    assert got == {i: i - 4000 if i >= 4000 else i for i in range(4040)}
    assert size["prefixes"] > 200_000 and moved["prefixes"] < 0.1 * size["prefixes"], (size, moved)
