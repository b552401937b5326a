"""Texts as memory rows: sentences of articles, transcript passages, source code records."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hv import top_k

# fixed values: pronouns that a sentence may begin with, and where a title ends
PRONOUN = r"(?i)^(it|its|they|their|he|she|his|her|this|these) "
TITLE = r"^(.{2,48}?)\s+(?:is|was|are|were)\b"


def article_sentences(articles: DataFrame, stored: DataFrame | None = None, target: int | None = None) -> DataFrame:
    """id, pos, text: quality sentences of articles (id, text), those with a pronoun first anchored with the title.

    Sentences of stored rows (text) and repeated ones go; ``target`` keeps the first so many.
    """
    s = articles.select("id", F.regexp_extract("text", TITLE, 1).alias("title"), F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s"))
    s = s.where(tx.is_quality_sentence(F.col("s")))
    anchored = F.when(F.col("s").rlike(PRONOUN) & (F.length("title") > 0), F.concat("title", F.lit(": "), "s")).otherwise(F.col("s"))
    s = s.select("id", "pos", anchored.alias("text"))
    if stored is not None:
        s = s.join(stored.select("text"), "text", "left_anti")
    s = s.groupBy("text").agg(F.min(F.struct("id", "pos")).alias("at")).select("at.id", "at.pos", "text")
    return s.orderBy("id", "pos").limit(target) if target else s


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """topic, title, extract, description, error of a file that is one JSON array of articles."""
    return spark.read.schema("topic string, title string, extract string, description string, error string").option("multiLine", True).json(path)


def article_rows(articles: DataFrame, least: int = 15) -> DataFrame:
    """source ("wikipedia:topic"), pos, text: the sentences over ``least`` characters of articles (topic, extract); those with an error or without text give none."""
    s = articles.where("error is null and extract is not null").select(F.concat(F.lit("wikipedia:"), "topic").alias("source"), F.posexplode(tx.sentences(F.col("extract"))).alias("pos", "text"))
    return s.where(F.length("text") > least)


class Gatherer:
    """Chunks of one source gathered until more than ``size`` characters; passages of fitting length, the first ``cap``."""

    def __init__(self, size: int, least: int, most: int, cap: int, state: tuple | None = None):
        self.size, self.least, self.most, self.cap = size, least, most, cap
        self.held, self.start, self.n = state or ([], 0.0, 0)
        self.length = sum(map(len, self.held))

    def add(self, t: float, text: str) -> list[tuple[float, str]]:
        if not self.held:
            self.start = t
        self.held.append(text.strip())
        self.length += len(self.held[-1])
        return self.flush() if self.length > self.size else []

    def flush(self) -> list[tuple[float, str]]:
        text = " ".join(self.held)
        self.held, self.length = [], 0
        if not self.least < len(text) < self.most or self.n >= self.cap:
            return []
        self.n += 1
        return [(self.start, text)]


def passages(chunks: DataFrame, *, by: str = "video", size: int = 180, least: int = 30, most: int = 320, cap: int = 80) -> DataFrame:
    """by, start, text: chunks (by, start, text) in time order, gathered until more than ``size`` characters; the last one too. The first ``cap`` of a source.

    Sources come sorted and stream by: what is held is one passage, however long a source is.
    """
    rows = chunks.where("text is not null").select(by, F.col("start").cast("double").alias("start"), "text")
    kind = dict(rows.dtypes)[by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, g = None, None
        for frame in frames:
            out = []
            for k, t, text in frame.itertuples(index=False):
                if g is None or k != key:
                    out += [(key, *x) for x in (g.flush() if g else [])]
                    key, g = k, Gatherer(size, least, most, cap)
                out += [(k, *x) for x in g.add(t, text)]
            yield pd.DataFrame(out, columns=[by, "start", "text"])
        if g:
            yield pd.DataFrame([(key, *x) for x in g.flush()], columns=[by, "start", "text"])

    return rows.repartition(by).sortWithinPartitions(by, "start", "text").mapInPandas(run, f"{by} {kind}, start double, text string")


class Keys:
    """Which frames of a film count: a cut (difference over ``cut``) at least ``gap`` seconds after the last, or ``every`` seconds without one; not dark ones, not the last caption again, ``most`` at most."""

    def __init__(self, cut: float = 22.0, gap: float = 1.5, every: float = 10.0, dark: float = 12.0, most: int = 40, state: tuple | None = None):
        self.cut, self.gap, self.every, self.dark, self.most = cut, gap, every, dark, most
        self.last, self.caption, self.n = state or (float("-inf"), "", 0)

    def __call__(self, t: float, difference: float, light: float, caption: str) -> bool:
        due = (difference > self.cut and t - self.last >= self.gap) or t - self.last >= self.every
        if not due or light < self.dark or self.n >= self.most:
            return False
        self.last = t
        if caption == self.caption:
            return False
        self.caption, self.n = caption, self.n + 1
        return True


def keyframes(frames: DataFrame, *, by: str = "video", **options) -> DataFrame:
    """by, t, caption of the frames (by, t, difference, light, caption) that count; films come sorted and stream by."""
    rows = frames.select(by, F.col("t").cast("double").alias("t"), F.col("difference").cast("double").alias("difference"), F.col("light").cast("double").alias("light"), "caption")
    kind = dict(rows.dtypes)[by]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, keep = None, None
        for part in parts:
            out = []
            for k, t, d, light, caption in part.itertuples(index=False):
                if keep is None or k != key:
                    key, keep = k, Keys(**options)
                if keep(t, d, light, caption):
                    out.append((k, t, caption))
            yield pd.DataFrame(out, columns=[by, "t", "caption"])

    return rows.repartition(by).sortWithinPartitions(by, "t", "caption").mapInPandas(run, f"{by} {kind}, t double, caption string")


def word_chunks(text: Column, n: int = 30) -> Column:
    """A text's words in pieces of n."""
    w = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    count = F.ceil(F.size(w) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * n + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def top_per_source(rows: DataFrame, source: str, order: str, n: int) -> DataFrame:
    return top_k(rows, [source], [F.col(order)], n).drop("rank")


def code_records(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (module, class, function, method), name, parent, doc, imports of the Python files under a path; files that don't parse give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(path)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"], strict=True) for r in _records(p, c)]
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "parent", "doc", "imports"])

    return files.select("path", "content").mapInPandas(parse, "file string, kind string, name string, parent string, doc string, imports array<string>")


def _records(path: str, content: bytes) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    stem = path.rpartition("/")[2].removesuffix(".py")
    line = lambda node: (ast.get_docstring(node) or "").strip().partition("\n")[0]
    names = [a.name for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names] + [x.module for x in ast.walk(tree) if isinstance(x, ast.ImportFrom) and x.module]
    out = [(path, "module", stem, "", line(tree), sorted(set(names)))]
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((path, "function", node.name, stem, line(node), []))
        elif isinstance(node, ast.ClassDef):
            out.append((path, "class", node.name, stem, line(node), []))
            out += [(path, "method", x.name, node.name, line(x), []) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def code_claims(records: DataFrame) -> DataFrame:
    """subj, verb, obj: what code records say (imports, defined_in, has_method)."""
    imports = records.select(F.col("name").alias("subj"), F.lit("imports").alias("verb"), F.explode("imports").alias("obj"))
    inside = records.where("kind in ('function', 'class')").select(F.col("name").alias("subj"), F.lit("defined_in").alias("verb"), F.col("parent").alias("obj"))
    methods = records.where("kind = 'method'").select(F.col("parent").alias("subj"), F.lit("has_method").alias("verb"), F.col("name").alias("obj"))
    return imports.union(inside).union(methods)
