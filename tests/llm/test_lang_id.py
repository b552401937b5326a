import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import lang_id
from cairn.llm.lang_id import Model, codewords, held_out, learn, predict

from .cases import edge_docs, edge_rows, empty_docs

PARTS = {"aa": ["ing", "the", "tion", "er"], "bb": ["eau", "oui", "ç", "ment"], "cc": ["sch", "ung", "ö", "ein"]}


def texts(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        yield i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40))), lang


def test_codewords_keep_apart():
    for n in (2, 3, 4, 6, 12):
        code = codewords(n)
        assert all((code[i] != code[j]).sum() >= max(1, code.shape[1] // 4) for i in range(n) for j in range(i))


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(list(texts(300, 4)), "doc_id long, text string, lang string")
    got = predict(docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumnRenamed("lang", "truth"), learn(docs)).collect()
    own = [r for r in got if r.held_out]
    assert len(own) > 60 and sum(r.lang_pred == r.truth for r in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def naive(model, text):
    """Margins by a walk over the bytes, then the loss of each codeword."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    c = [x if x > 127 or chr(x).isalpha() else 32 for x in raw]
    seen = [x for x in c if x != 32]
    for i in range(len(c)):
        if c[i : i + 2] != [32, 32]:
            if i + 1 < len(c):
                seen.append(256 + (c[i] << 8 | c[i + 1]))
            if i + 2 < len(c):
                seen.append(256 + 65536 + ((c[i] << 16 | c[i + 1] << 8 | c[i + 2]) * 2654435761 % 2**32 >> 16))
    losses = []
    for word in model.code:
        total = 0.0
        for b, want in enumerate(word):
            margin = sum(float(model.weights[f, b]) for f in seen) / max(len(seen), 1) * model.scale[b]
            total += model.trust[b] * math.log1p(math.exp(-margin * int(want)))
        losses.append(total)
    near = [math.exp(-4 * (x - min(losses))) for x in losses]
    return model.langs[losses.index(min(losses))], max(near) / sum(near), sorted(near)[-2] > 0.8


def test_against_a_naive_decoder(spark):
    docs = spark.createDataFrame(list(texts(150, 6)) + [(900, "ing eau sch", None), (901, "the  12 ç-é\n\nTION", None), (902, "x", None), (903, "漢字 ok", None)], "doc_id long, text string, lang string")
    model = learn(docs)
    got = {r.doc_id: r for r in predict(docs.withColumn("t", F.col("text")), model).collect()}
    for r in got.values():
        lang, score, ambiguous = naive(model, r.t)
        assert (r.lang_pred, r.ambiguous) == (lang, ambiguous) and abs(r.score - score) < 1e-5


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        learn(spark.createDataFrame(list(texts(60, 1)), "doc_id long, text string, lang string"))


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame(list(texts(120, 5)), "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert "zz" not in learn(other).langs
    a = {r.doc_id: r.lang_pred for r in predict(docs, learn(docs)).collect()}
    assert a == {r.doc_id: r.lang_pred for r in predict(docs, learn(other)).collect()}


def test_edges(spark):
    docs = edge_docs(spark)
    got = predict(docs, learn(docs)).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        text = next(x[1] for x in edge_rows() if x[0] == r.doc_id) or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        assert r.id == "clash"
    assert predict(empty_docs(spark), learn(docs)).count() == 0
    assert {r.lang_pred for r in predict(docs, learn(empty_docs(spark))).collect()} == {"und"}
    assert isinstance(learn(empty_docs(spark)), Model)
