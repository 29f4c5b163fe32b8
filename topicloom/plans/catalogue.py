"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicloom.plans import hdp, lda, stream, text, tree

MODULES = (text, lda, hdp, tree, stream)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: statement for module in MODULES for name, statement in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lda.lda_fit_converged(spark, sf_dir)
