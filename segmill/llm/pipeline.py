"""The corpus pipeline: toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.

Defined results of the stages, each for the columns of documents (others are left out): nulls in any column stay as they are; a null or empty text is scored, has
the fingerprint zero, is taken once and packs as its end token; very long texts are whole in every stage; repeated rows are scored
alike, and of a component's rows one stays; mixing gives rows of one doc_id, source and text exactly the turns the mix gives them together;
an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise, release, ship, table
from .mixing import repeated
from .packing import pack
from .pieces import vocabulary_path
from .simhash import representatives
from .toxicity import clean

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit; a null doc_id's rows are judged by their own scores.

    Labels are the folder's ``labels`` table; ``toxicity.clean`` takes any.
    """
    ship(spark)
    return clean(_documents(docs), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest doc_id; of its repeated rows, one."""
    ship(spark)
    return representatives(_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return repeated(_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece, as op6."""
    ship(spark)
    return pack(_documents(docs), vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's table is deleted when the next one's is written, but for the one that the result reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
