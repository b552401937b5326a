"""Encoders by name: functions of rows (id, words) that give (id, hv), so that a search can take any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import hv

ENCODERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "wide": hv.text_vectors,
    "small": lambda rows: hv.text_vectors(rows, lanes=hv.SMALL, atoms=hv.md5_atoms),
}


def register(name: str, encode: Callable[[DataFrame], DataFrame]) -> None:
    """Add an encoder; a name that is taken is an error."""
    if name in ENCODERS:
        raise ValueError(f"there is an encoder {name!r}")
    ENCODERS[name] = encode


def search(rows: DataFrame, queries: DataFrame, k: int, encoder: str = "wide") -> DataFrame:
    """qid, id, distance, rank: the k rows nearest to each query, both (id, words), by a named encoder."""
    made = ENCODERS[encoder]
    return hv.knn(made(rows), made(queries).withColumnRenamed("id", "qid"), k)
