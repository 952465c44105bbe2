"""A corpus pipeline of five stages: quality, near duplicates, decontamination, personal data, mix."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.llm import decontaminate, mixing, pii, quality, simhash
from tracework.llm.common import dropped, id_column, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; labels only train it.

    A null text scores as an empty one. Rows that share an id, or have none, are judged each by their
    text; equal texts are judged alike, so ties stay or go together. All columns come back as they were.
    An empty table stays empty; without labels of both classes see ``quality.train``.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).where(F.col(quality.SCORE) >= quality.GOOD).drop(quality.SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, among those that share it the first by a hash of all columns.

    Rows are numbered, so rows that share an id, or have none, are documents of their own; of rows equal throughout one
    stays. No id counts as the smallest. Null, empty and blank texts are one group, as their fingerprints are equal. All
    columns come back as they were, and reruns keep the same rows. An empty table stays empty.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    order = F.md5(F.to_json(F.struct(*cols)))
    rows = written(docs.select(*cols, F.monotonically_increasing_id().alias("__row"), order.alias("__order")))
    groups = simhash.near_duplicates(rows, "__row").select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select("__row", id_column("doc_id").alias("k"), "__order")
    keep = groups.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct("k", "__order", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(keep, "__row", "left_semi").select(*cols)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; each row is judged where it is read.

    Null and empty texts hold no copy and stay, as do repeated clean rows. All columns come back as they
    were. An empty benchmark keeps every document.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _clean(at: int, batches):
    for batch in batches:
        texts = []
        for text, terms in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if text is None:
                texts.append(None)
                continue
            line = pii.joined(pii.base_spans(text))
            texts.append(pii.sanitised(text, line, [(t["begin"], t["end"], t["removed"]) for t in terms or ()]))
        cols = [*batch.columns[:-1]]
        cols[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind and disclosing terms generalised or removed; n_chars follows the text.

    A null text stays null. Repeated rows are cleaned each; rows that share an id by their own text. Other
    columns come back as they were. An empty table stays empty.
    """
    terms = pii.find(docs).where("terms is not null").select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("terms").alias("__terms"))
    terms = written(terms.dropDuplicates(["__k", "__t"]))
    rows = docs.withColumns({"__k": id_column("doc_id"), "__t": pii.text_hash("text")}).join(terms, ["__k", "__t"], "left")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    out = rows.select(*cols, "__terms").mapInArrow(partial(_clean, docs.columns.index("text")), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (``copies``) and how many words that is (``taken``).

    Documents without words weigh nothing and come as often as their lot says. A null source is a source. Of equal
    rows as many are taken in each run. Columns that are named ``copies`` or ``taken`` are replaced. An empty table stays empty.
    """
    _, planned = mixing.plan(docs)
    out = mixing.with_copies(docs, planned, "__copies", size="__words").where("__copies > 0")
    return out.withColumn("copies", F.col("__copies")).withColumn("taken", F.col("__words") * F.col("__copies")).drop("__copies", "__words")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: No stage but the last can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``; each result is written and read again, and goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if n:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
