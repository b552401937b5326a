import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cairn.llm.resampling import resample

from .cases import edge_docs, edge_rows, empty_docs, hard_docs, hard_rows, words


def runs(text, longest):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank), one document after the other."""
    bucket = lambda t: zlib.crc32(t.encode()) % buckets
    cut = [(i, *runs(t, longest)) for i, t in rows]
    s, t = Counter(bucket(x) for _, _, f in cut for x in f), Counter(bucket(x) for y in target for x in runs(y, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, n, f in cut:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    order = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(r[0], *r[2:], order.get(id(r))) for r in out]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_matches_brute_force(spark, longest):
    rng = random.Random(longest)
    rows = [(i, words(rng, rng.choice([0, 3, 19, 20, 60, 200]), "abCd")) for i in range(300)] + [(300 + i, "the same words " * 9) for i in range(60)]
    target = [words(rng, 80, "ab") for _ in range(9)]
    got = resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=30)
    assert rows_of(got) == sorted(brute(rows, target, longest, percent=30), key=repr)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 30


def test_edges(spark):
    target = spark.createDataFrame([("A b",), (None,)], "text string")
    for docs, rows in ((edge_docs(spark), edge_rows()), (hard_docs(spark), hard_rows())):
        rows = [(r[0], r[1]) for r in rows]
        got = rows_of(resample(docs, target, percent=50, longest=2))
        want = sorted(brute(rows, ["A b"], 2, percent=50), key=repr)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    assert resample(empty_docs(spark), target).count() == 0
    none = resample(edge_docs(spark), target.limit(0), longest=1).collect()
    assert len(none) == len(edge_rows())
