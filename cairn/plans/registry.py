"""Where queries register: name -> function of (spark, sf_dir), and name -> the same as ANSI SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Examples: queries over a few sentences or facts written out, (function, SQL), which the tests run and nothing else does.
EXAMPLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def example(sql: str | None = None):
    def add(f):
        EXAMPLES[f.__name__] = f, sql
        return f

    return add


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Tables of texts, where the work on a row is much more than moving it.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = read(spark, sf_dir, name)
    return spread(rows) if name in TEXTS else rows


def sql_list(words) -> str:
    """A list of SQL string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


class literal:
    """Rows that are written out, the same for a query and its SQL: a few sentences, words or facts."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        columns = ", ".join(c.split()[0] for c in schema.split(", "))
        value = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
        self.sql = f"(VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS {name}({columns})"

    def df(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


class given:
    """Rows that a select draws from the tables: sentences, facts or questions made of their values, the same text for Spark and SQL."""

    def __init__(self, name: str, select: str, *tables: str):
        self.sql, self.tables, self.select = f"({select}) AS {name}", tables, select

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        text = self.select
        for t in self.tables:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return spark.sql(text, **{t: table(spark, sf, t) for t in self.tables})


def letters(key: str) -> str:
    """A number's digits as letters."""
    return f"translate(CAST({key} AS STRING), '0123456789', 'aeioubdfgl')"


def capital(word: str) -> str:
    return f"upper(substr({word}, 1, 1)) || substr({word}, 2)"


def person(key: str) -> str:
    """A name for each key."""
    return f"(CASE {key} % 4 WHEN 0 THEN 'Maria ' WHEN 1 THEN 'Carl ' WHEN 2 THEN 'Ana ' ELSE 'Peter ' END || {capital(letters(key))} || 'n')"


def city(key: str) -> str:
    return f"(CASE {key} WHEN 0 THEN 'Hamburg' ELSE 'B' || {letters(key)} || 'berg' END)"


def land(key: str) -> str:
    return f"('N' || {letters(key)} || 'land')"
