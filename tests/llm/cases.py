"""Small documents with the cases that every operator has to handle."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, keep int, _doc int, token string"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def edge_rows(seed=1):
    """Null and empty texts, a very long one, ties, repeated rows, null columns, names that clash with the operators' own."""
    rng = random.Random(seed)
    base = words(rng, 120)
    line = "This same line stands in many of these documents."
    texts = [None, "", " ", "\n\n", "a", "A b", "x" * 60, base, base, base + " end", base.upper(), f"{line}\n{words(rng, 9)}", f"{words(rng, 5)}\n{line}\n", f"{line}\r\n{line}", f" {line} \n{words(rng, 4)}", words(rng, 30_000), "é ü ß ñ 漢字 🙂 ok", "12 34 !!", "\x00\x01 zero"]
    rows = [(i, t, [None, "en", "fr"][i % 3], None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t), "clash", 1, 2, "t") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[0]]  # repeated rows


HARD = "doc_id long, text string, lang string, source string, n_chars long, keep int, n_lines int, n_dropped int, score double, lang_pred string, ambiguous int, _kept_text string, _row int, component_id int, item_id int, n_tokens int, ids string, size int, shard int, slot int, bytes int, span string, a int, b int"


def hard_rows(seed=2):
    """edge_rows and null ids, ids with several texts, all with columns named like those that operators make or use."""
    rng = random.Random(seed)
    own = [(None if t is None else i, t, lang, source, n) for i, t, lang, source, n, *_ in edge_rows()]
    base, line = own[7][1], "This same line stands in many of these documents."
    own += [(None, base + " fin", "en", "s", 1), (None, f"{line}\n{words(rng, 30)}", None, None, None), (8, words(rng, 50), "fr", "s", 2), (8, f"{base}\n{line}", "fr", "s", 3), (3, words(rng, 40) + " " + base, "en", "s", None), (3, None, "en", "s", None)]
    return [(*r, 1, 2, 3, 0.5, "xx", 4, "kept", 5, 6, 7, 8, "ids", 9, 10, 11, 12, "span", 13, 14) for r in own]


def hard_docs(spark, parts=3):
    return spark.createDataFrame(hard_rows(), HARD).repartition(parts)


def edge_docs(spark, parts=3):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(parts)


def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)
