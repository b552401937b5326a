"""Numbers, dates, units and probabilities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units in metres, kilograms and km/h, number scales, month names
LENGTH = {
    "km": 1000.0, "kilometre": 1000.0, "kilometres": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "m": 1.0, "metre": 1.0, "metres": 1.0, "meter": 1.0, "meters": 1.0,
    "cm": 0.01, "centimetres": 0.01, "centimeters": 0.01, "mm": 0.001, "mi": 1609.34, "mile": 1609.34, "miles": 1609.34, "ft": 0.3048, "feet": 0.3048, "foot": 0.3048,
    "in": 0.0254, "inch": 0.0254, "inches": 0.0254,
}
MASS = {"kg": 1.0, "kilogram": 1.0, "kilograms": 1.0, "g": 0.001, "gram": 0.001, "grams": 0.001, "tonne": 1000.0, "tonnes": 1000.0, "ton": 907.18, "tons": 907.18, "lb": 0.4536, "lbs": 0.4536, "pound": 0.4536, "pounds": 0.4536}
SPEED = {"km/h": 1.0, "kph": 1.0, "mph": 1.609, "m/s": 3.6}
SCALE = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
MONTHS = "january february march april may june july august september october november december".split()


def lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1, held between 0.5 and 6."""
    return F.least(F.lit(6.0), F.greatest(F.lit(0.5), F.ln((n_docs + 1) / (df + 1)) + 1))


def dates(text: Column) -> Column:
    """Array of (y, m, d) of "15 February 1564" and "February 15, 1564", in text order, for true month names."""
    found = F.regexp_extract_all(text, F.lit(r"\d{1,2}\s+[A-Za-z]+\s+\d{3,4}|[A-Za-z]+\s+\d{1,2},?\s+\d{3,4}"), F.lit(0))

    def parse(x: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(x, "[A-Za-z]+", 0)))
        day = F.when(x.rlike(r"^\d"), F.regexp_extract(x, r"^\d+", 0)).otherwise(F.regexp_extract(x, r"[A-Za-z]\s+(\d{1,2})", 1))
        return F.struct(F.regexp_extract(x, r"(\d{3,4})$", 1).cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))

    return F.filter(F.transform(found, parse), lambda x: (x["m"] > 0) & (x["d"] >= 1) & (x["d"] <= 31))


def age(birth: Column, death: Column) -> Column:
    """Whole years between two (y, m, d)."""
    early = (death["m"] < birth["m"]) | ((death["m"] == birth["m"]) & (death["d"] < birth["d"]))
    return death["y"] - birth["y"] - early.cast("int")


def noisy_or(p: Column) -> Column:
    """Aggregate: 1 - product of (1 - p), p held between 0 and 0.95."""
    return 1 - F.exp(F.sum(F.ln(1 - F.least(F.lit(0.95), F.greatest(F.lit(0.0), p)))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def clock_answer(question: Column, now: Column | None = None) -> Column:
    """The time, date, weekday or year that a question asks for; null for other questions. now: the session's time if not given."""
    t = F.current_timestamp() if now is None else now
    low = F.lower(question)
    return F.when(low.rlike(r"\bwhat time\b|\bthe time\b"), F.date_format(t, "HH:mm")).when(low.rlike(r"\bwhat day\b|\bweekday\b"), F.date_format(t, "EEEE")).when(low.rlike(r"\bwhat year\b"), F.date_format(t, "yyyy")).when(low.rlike(r"\bdate\b|\btoday\b"), F.date_format(t, "d MMMM yyyy"))


def rounded(x: Column, digits: int) -> Column:
    """x rounded half away from zero as a float is: times a power of ten, to a whole number, and back. What is just below zero becomes -0.0, as in SQL."""
    return F.signum(x) * F.round(F.abs(x) * 10.0**digits) / 10.0**digits
