"""The training-text pipeline: language, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its
result is stored and read again as the next stage's `docs`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.llm.common import free_names, store, table
from fleetwright.llm.exact_dedup import keep_first
from fleetwright.llm.langid import fit, identify, least_score, train_rows
from fleetwright.llm.mixing import mix
from fleetwright.llm.near_dedup import keep_one
from fleetwright.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told go: those that are null or without a letter, and
    those that the network, trained on the labelled rows of `docs`, finds no likelier to be in any
    one language than in the others (`least_score`).

    Labels as such do not decide, and without any to train on all texts with letters stay. Repeated
    rows stay or go together; null ids and sources do not matter; columns may have any names.
    """
    net = fit(train_rows(docs))
    names = free_names(docs, "lang_pred", "score")
    found = identify(docs, net, tuple(names))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(letters & (F.col(names[1]) >= least_score(net))).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays, null ids last; null texts equal empty
    ones. Of rows that repeat doc_id and text one stays. Columns may have any names."""
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8): the one with the smallest
    doc_id. Null and blank texts have no copies; a row without doc_id goes if its group has one
    with. Rows that repeat a doc_id are judged each by its own text. Columns may have any names."""
    return keep_one(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mixture draws them. Null texts have no words, null sources are one
    source, and rows that repeat doc_id and text are drawn as one. Columns may have any names."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, size, bin_id. Texts without words have
    one piece and no bin. Other columns do not matter."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

# The trained network of the first stage has no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
