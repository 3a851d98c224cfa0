"""A corpus pipeline of five stages, each from one operator.

quality (byte-level network), toxicity (boosted trees), near copies (Jaccard join: one document of each group stays),
mixing (sources to target weights: a document is left out, kept or repeated), packing (sequences of 1024 tokens).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import cnn, jaccard, mixing, packing, toxicity
from cairnwork.llm.common import checkpoint_folder, cut, hot_join, table

#: Rows of (row number, count) that go to every executor; more of them meet the documents in a shuffle.
BROADCAST_ROWS = 500_000
#: The name of a row's number, where the documents have no column of that name.
ROW = "row_number_of_this_stage"
#: Folders that a stage's result still reads; run() deletes them once the result is written.
_held: list[str] = []


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _numbered(docs: DataFrame, row: str = ROW) -> DataFrame:
    """docs with a number for each row, written once and read back: file splits depend on the cores of the moment."""
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark)}/numbered-{uuid.uuid4().hex}"
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    _held.append(path)
    return spark.read.parquet(path)


def _counted(marks: DataFrame, how: str, docs: DataFrame, row: str) -> DataFrame:
    """docs joined by row number with a narrow table, which is sent to all if its checked size allows."""
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    return docs.join(marks, row, how)


def _by_score(docs: DataFrame, model, keep: str) -> DataFrame:
    name = _free(docs, "score_of_stage")
    return cnn.with_scores(docs, model.score, name).where(f"`{name}` {keep}").drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more, with all columns of docs.

    Null and empty texts are scored like others, as one block of zero bytes. Null ids, repeated rows and clashing column names
    pass; an empty table stays empty. Without labels of both classes all rows have one score.
    """
    return _by_score(docs, cnn.train(docs, table(spark, sf_dir, "labels")), ">= 0.5")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, with all columns of docs.

    Null and empty texts have all features 0 and a score like others. Null ids, repeated rows and clashing column names
    pass; an empty table stays empty.
    """
    return _by_score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), "< 0.5")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the smallest id, with all columns of docs.

    Rows that share an id are told apart by a number of their own: of equal rows one stays. A null id stays only in a
    component of nulls. Texts without a word, null ones too, link with nothing and all stay; an empty table stays empty.
    """
    row = _free(docs, ROW)
    rows = _numbered(docs, row)
    found = cut(jaccard.jaccard_components(rows, id_col=row).select(F.col("doc_id").alias("n_"), "component_id"))
    # Components of one row, nearly all, have nothing to drop; of the others only the roots are looked for.
    others = found.where("n_ <> component_id")
    roots = found.where("n_ = component_id").join(others.select("component_id").distinct(), "component_id", "left_semi").select("n_", "component_id")
    member = cut(others.union(roots).join(rows.select(F.col(row).alias("r_"), F.col("doc_id").alias("d_")), F.col("n_") == F.col("r_")).select("n_", "component_id", "d_"))
    best = member.groupBy("component_id").agg(F.min(F.struct(F.col("d_").isNull().alias("null_"), "d_", "n_"))["n_"].alias("best_"), F.count("*").alias("m_"))
    gone = hot_join(member, cut(best), ["component_id"], "m_").where("n_ <> best_").select(F.col("n_").alias(row))
    return _counted(cut(gone), "left_anti", rows, row).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its beginning: not at all, once or twice, with all columns of docs.

    Null sources are a source; documents without a word, null texts too, are never taken. Repeated rows are rows of
    their own; an empty table stays empty.
    """
    row = _free(docs, ROW)
    rows = _numbered(docs, row)
    taken = mixing.mix(rows, carry=(row,)).where("copies > 0").select(F.col(f"row_.{row}").alias(row), F.expr("sequence(1, cast(copies as int))").alias(_free(docs, "copies_of_stage")))
    taken = cut(taken)
    copies = taken.columns[1]
    return _counted(taken, "inner", rows, row).withColumn(_free(docs, "copy_of_stage"), F.explode(copies)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, with a checksum of each piece's ids.

    Null and empty texts are the end token alone; repeated rows are packed each; an empty table gives no piece.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", toxic), ("near copies", near_copies), ("mixing", mix), ("packing", pack)]

#: None: networks, trees and hashes have no SQL; tests hold every stage against a plain version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written to the shared folder and read again by the next.

    A stage's folder is deleted once the next one's is written; the last one stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            for path in [*_held, *([f"{folder}/{k - 1}"] if k else [])]:
                _delete(spark, path)
            _held.clear()
    return docs
