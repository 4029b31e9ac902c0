"""A corpus pipeline of five of the operators: each stage reads what the one before it wrote.

Counted as part of the subpackage lodestrand.llm. The stages, in order: toxic documents go; of each
group of near duplicates the document with the least id stays; secrets are masked in the texts; sources
are mixed to target weights, a document as often as the mix takes it; what remains is packed into
training sequences. All but the last return the columns of documents, so n_chars follows the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import jaccard, mixing, packing, secrets, toxicity
from lodestrand.llm.common import join_small, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep=True)
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near duplicates: the one whose id is the group's.

    Rows without an id stay. Of repeated rows of an id, those with the same text are one document.
    """
    found = jaccard.similar(docs)
    _, rest = jaccard.split(docs, found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    again, once = jaccard.split(rest, found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three rows each, none for those it leaves out.

    Documents without words have no part in the mix and stay as they are.
    """
    copies = mixing.mix(docs).select("doc_id", "size", "copies").groupBy("doc_id").agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("copies"))
    taken = join_small(docs, copies.filter("copies <> 1"), ["doc_id"], "left", 1_000_000)
    times = F.array_repeat(F.lit(1), F.coalesce("copies", F.lit(1)))
    return taken.withColumn("copy", F.explode(times)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network isn't expressible in SQL: test_run_equals_brute_force holds run() against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again by the next.

    What a stage wrote goes once the next one has written its own; the last one's rows stay.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    before = None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            fs.delete(path(before), True)
        before = out
    return docs
