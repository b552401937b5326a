"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Edge cases: rows count one by one, by their id and text: a repeated id is no reason to go, and of equal rows
the n-gram stage keeps one. Null and empty texts, and those without letters, end in the first stage; null ids, and nulls in
other columns, go through; texts are read whole, whatever their length; an empty table, or an empty benchmark, gives what it must
(no rows, or no document dropped); columns of any name are carried up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cairn.llm.bpe import encode_documents
from cairn.llm.common import scratch_dir, stored, table
from cairn.llm.decontaminate import drop_contaminated
from cairn.llm.jaccard_join import keep_first
from cairn.llm.lang_id import learn, predict
from cairn.llm.line_dedup import apply_bitmaps


def language_id(spark, docs, sf_dir):
    """Documents without letters, or too near to two languages to tell, go; lang becomes the predicted one."""
    # the row goes along as one value, so its names meet none of the operator's
    marked = predict(docs.select("text", F.struct(*docs.columns).alias("_row")), learn(docs))
    kept = marked.where("lang_pred <> 'und' and not ambiguous")
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col("_row")[c]).alias(c) for c in docs.columns])


def line_dedup(spark, docs, sf_dir):
    """Lines of 20 characters or more that three documents hold stay in one of them only; n_chars follows the text."""
    return apply_bitmaps(docs, chars_col="n_chars")


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8."""
    return keep_first(docs, k=5, num=80, den=100).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(*docs.columns)


def byte_bpe(spark, docs, sf_dir):
    """Token ids of the documents left, with their id, language and source."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = scratch_dir(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{top}/{name}")
    return docs
