"""Saving and loading models: Parquet tables plus a one-row parameter table."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from topicloom.operators.gibbs import GibbsModel, HdpParams, topic_term_counts
from topicloom.operators.lda import LdaParams, NotFittedError, OnlineLda
from topicloom.operators.tree import TopicTree, TreeParams


def _save_params(spark: SparkSession, path: str, kind: str, **values) -> None:
    row = spark.createDataFrame([(kind, json.dumps(values))], "kind string, body string")
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/params")


def _load_params(spark: SparkSession, path: str, kind: str) -> dict:
    row = spark.read.schema("kind string, body string").parquet(f"{path}/params").first()
    if row["kind"] != kind:
        raise ValueError(f"{path} holds a {row['kind']} model, not {kind}")
    return json.loads(row["body"])


def save_lda(model: OnlineLda, path: str) -> None:
    if model.components is None:
        raise NotFittedError("the model has no components; fit it first")
    model.components.write.mode("errorifexists").parquet(f"{path}/components")
    _save_params(
        model.components.sparkSession, path, "lda",
        params=asdict(model.params), n_terms=model.n_terms, n_iter=model.n_iter,
    )


def load_lda(spark: SparkSession, path: str) -> OnlineLda:
    body = _load_params(spark, path, "lda")
    model = OnlineLda(LdaParams(**body["params"]))
    model.n_terms, model.n_iter = body["n_terms"], body["n_iter"]
    model.components = spark.read.schema("term_id int, w array<double>").parquet(f"{path}/components")
    return model


def save_gibbs(model: GibbsModel, path: str) -> None:
    model.state.write.mode("errorifexists").parquet(f"{path}/state")
    _save_params(
        model.state.sparkSession, path, "gibbs",
        params=asdict(model.params), n_terms=model.n_terms, tau=model.tau, tau_new=model.tau_new,
        totals=model.totals, sweeps_done=model.sweeps_done,
    )


def load_gibbs(spark: SparkSession, path: str) -> GibbsModel:
    body = _load_params(spark, path, "gibbs")
    params = {k: tuple(v) if isinstance(v, list) else v for k, v in body["params"].items()}
    model = GibbsModel(HdpParams(**params), body["n_terms"])
    model.tau, model.tau_new, model.totals = body["tau"], body["tau_new"], body["totals"]
    model.sweeps_done = body["sweeps_done"]
    model.state = spark.read.schema("doc_id long, term_ids array<int>, z array<int>").parquet(f"{path}/state")
    model.topic_terms = topic_term_counts(model.state)
    return model


def save_tree(tree: TopicTree, path: str) -> None:
    tree.nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    tree.terms.write.mode("errorifexists").parquet(f"{path}/terms")
    _save_params(tree.nodes.sparkSession, path, "tree", params=asdict(tree.params), n_terms=tree.n_terms)


def load_tree(spark: SparkSession, path: str) -> TopicTree:
    body = _load_params(spark, path, "tree")
    nodes = spark.read.schema(
        "node_id int, parent_id int, level int, customers long, total_tokens long"
    ).parquet(f"{path}/nodes")
    terms = spark.read.schema("node_id int, term_id int, n long").parquet(f"{path}/terms")
    return TopicTree(nodes, terms, body["n_terms"], TreeParams(**body["params"]))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("errorifexists").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term_id int, term string, df long, tf long").parquet(path)
