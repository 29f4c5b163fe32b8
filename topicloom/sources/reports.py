"""Report sinks: tables and text files that Spark writes in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.tree import TopicTree, tree_report


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Top words, document-topic rows or any other report as ``parquet`` or ``csv``."""
    writer = df.write.mode("errorifexists")
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)


def write_tree_report(tree: TopicTree, vocab: DataFrame, path: str, n_words: int = 25) -> None:
    """``level,nodeID,totalTokens,customers,topWords`` lines in pre-order."""
    rows = tree_report(tree, vocab, n_words).orderBy("path_key")
    rows.select("level", "node_id", "total_tokens", "customers", "top_words").write.mode("errorifexists").csv(path)


def distribution_lines(distribution: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, value): ``name,nodeID:x,p,...`` per document, nodes in path order.

    ``distribution`` is (doc_id, level, node_id, share), ``names`` is (doc_id, name).
    """
    lines = (
        distribution.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("level", "node_id", "share"))).alias("p"))
        .withColumn(
            "body",
            F.array_join(
                F.transform(
                    "p",
                    lambda e: F.concat(
                        F.lit("nodeID:"), e["node_id"].cast("string"), F.lit(","), e["share"].cast("string"), F.lit(",")
                    ),
                ),
                "",
            ),
        )
    )
    return lines.join(names, "doc_id").select("doc_id", F.concat("name", F.lit(","), "body").alias("value"))


def write_distribution(distribution: DataFrame, names: DataFrame, path: str) -> None:
    distribution_lines(distribution, names).select("value").write.mode("errorifexists").text(path)
