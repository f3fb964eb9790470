"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm import decontam, langid, mixing, sharding, simhash
from leafmill.llm._store import stored
from leafmill.sources.tables import table

#: A text whose best language needs this many bits a symbol is no text of any learned language (8: nothing is predicted).
MOST_BITS = 7.0
#: So many bits beyond that are enough evidence: a short clean text around one key or number stays.
EVIDENCE = 256.0
SHARDS = 24


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns renamed, the new names, and what turns rows of these back: no name of a document's column meets one of an operator."""
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda df: df.select(*names.values()).toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that no learned language's model predicts; keeps the rest unchanged.

    Null and empty texts have no letter and go; repeated rows and equal ids are judged alike, each by its own text; an empty
    table stays empty.  Without any labelled row nothing is learned and every document is rejected.
    """
    held, names, back = _apart(docs)
    named = langid.identify(held, langid.train(docs), text=names["text"])
    beyond = (F.coalesce("bits", F.lit(8.0)) - MOST_BITS) * F.length(names["text"])
    return back(named.where((F.col("lang_pred") != "und") & (beyond < EVIDENCE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the row of its smallest id (nulls last), of equal ids that of the smallest hash.

    Of repeated rows (equal id and text) one stays, by the smallest source.  Null and empty texts are one component; ids may be null or
    repeat in several components: the choice is made in each of them.  An empty table stays empty.
    """
    held, names, back = _apart(docs)
    doc_id, text, source = (names[c] for c in ("doc_id", "text", "source"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    found = simhash.near_duplicates(docs).groupBy("root").agg(first)
    kept = stored(found.select(F.coalesce(F.col("first.id").cast("string"), F.lit("null")).alias("name"), F.col("first.hash").alias("hash")))
    marked = held.withColumns({"name": F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), "hash": F.xxhash64(text)}).join(kept, ["name", "hash"], "left_semi")
    # Only the rows of chosen (id, text) pairs are left: their groups are the repeated rows.
    return back(marked.withColumn("n", F.row_number().over(W.partitionBy("name", "hash").orderBy(source))).where("n = 1"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark window; clean documents stay unchanged.

    Null and empty texts hold none and stay; repeated rows and equal ids are judged each by its own text; an empty table stays empty.
    """
    held, names, back = _apart(docs)
    return back(decontam.contamination(held, table(spark, sf_dir, "benchmark"), text=names["text"]).where("n_hit = 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that source, language and topic shares approach their tempered targets.

    Null sources and languages count as ``unknown``; null and empty texts take no tokens and stay; rows of equal ids are drawn alike, so
    repeated rows stay or go together, as do rows with a null id; an empty table stays empty.
    """
    held, names, back = _apart(docs)
    held = held.withColumns({"source": F.col(names["source"]), "lang": F.col(names["lang"])})
    return back(mixing.mix(held, id_col=names["doc_id"], text=names["text"], columns=list(names.values())).where("sampled"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near-equal bytes: ``doc_id, size, text_crc32, shard, slot``, one row for each document.

    Null texts have no bytes; repeated rows and null ids take slots of their own; an empty table gives no rows.
    """
    return sharding.assign_shards(docs, SHARDS).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]
#: Language ID and SimHash can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
