"""Registered queries: name -> function of (spark, sf_dir), and name -> the same as ANSI SQL."""

from __future__ import annotations

from . import algebra, claims, clustering, codebooks, dialogue, events, graph, knowledge, language, memory, mining, replies, retrieval, routes, texts, turns  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES


def flagship(spark, sf_dir):
    """Which documents are nearest to a document, and what words do they agree on?"""
    return QUERIES["consensus_words"](spark, sf_dir)
