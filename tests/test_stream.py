import numpy as np
import pytest

from topicloom.operators.counts import BagOfWords
from topicloom.operators.lda import LdaParams, OnlineLda
from topicloom.streaming.online import STATES_KEPT, StreamTrainer, document_stream, score_stream, score_to

WORDS = [["aa", "bb", "cc"], ["ee", "ff", "gg"], ["hh", "ii", "jj"]]
PARAMS = LdaParams(n_topics=3, alpha=1 / 3, eta=1 / 3, tau=30.0, n_docs=27, batch_size=100)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files of nine documents, three planted topics."""
    path = tmp_path_factory.mktemp("stream") / "docs"
    for part in range(3):
        rows = [
            (part * 9 + i, " ".join(WORDS[i // 3] * 3), "en", "s", 9) for i in range(9)
        ]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        df.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def weights(components):
    return {r["term_id"]: np.array(r["w"]) for r in components.collect()}


def test_stream_equals_partial_fit_and_survives_replay(spark, folder, tmp_path):
    trainer = StreamTrainer(str(tmp_path / "model"), PARAMS, r"[\p{L}]{2,}", n_top_words=3)
    trainer.start(document_stream(spark, folder), str(tmp_path / "offsets")).awaitTermination()
    assert trainer.last_batch(spark) == 2
    model = trainer.model(spark)
    assert model.n_iter == 4 and model.n_terms == 9

    docs = spark.read.parquet(folder)
    bag = trainer.bag(docs)
    plain = OnlineLda(PARAMS)
    for part in range(3):
        plain.partial_fit(BagOfWords(bag.df.filter(f"doc_id between {part * 9} and {part * 9 + 8}"), 9))
    got, want = weights(model.components), weights(plain.components)
    # Files may arrive in any order; their contents are alike, so the result is not affected.
    for t in want:
        np.testing.assert_allclose(got[t], want[t], rtol=1e-9)

    history = trainer.top_words_history(spark)
    assert history.count() == 3 * 3 * 3 and history.select("batch").distinct().count() == 3

    # A replayed batch leaves the model as it is, also for a restarted trainer.
    restarted = StreamTrainer(str(tmp_path / "model"), PARAMS, r"[\p{L}]{2,}", n_top_words=3)
    restarted.process(docs, 1)
    assert restarted.last_batch(spark) == 2 and restarted.model(spark).n_iter == 4
    restarted.process(docs, 3)
    assert restarted.model(spark).n_iter == 5

    bags = trainer.bag(docs)
    bags.df.write.parquet(str(tmp_path / "bags"))
    stream = spark.readStream.schema(bags.df.schema).parquet(str(tmp_path / "bags"))
    scored = score_stream(stream, model)
    query = scored.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    live = {r["doc_id"]: np.array(r["theta"]) for r in spark.table("scored").collect()}
    for r in model.transform(bags).collect():
        np.testing.assert_allclose(live[r["doc_id"]], r["theta"])
    score_to(stream, model, str(tmp_path / "scores"), str(tmp_path / "scored")).awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "scores")).collect():
        np.testing.assert_allclose(live[r["doc_id"]], r["theta"])


def test_large_models_score_by_joins_and_old_states_go(spark, folder, tmp_path, no_broadcast):
    trainer = StreamTrainer(str(tmp_path / "model"), PARAMS, r"[\p{L}]{2,}", n_top_words=3)
    docs = spark.read.parquet(folder)
    for batch in range(STATES_KEPT + 2):
        trainer.process(docs, batch)
    assert len(list((tmp_path / "model" / "state").iterdir())) == STATES_KEPT
    model, bags = trainer.model(spark), trainer.bag(docs)
    bags.df.write.parquet(str(tmp_path / "bags"))
    stream = spark.readStream.schema(bags.df.schema).parquet(str(tmp_path / "bags"))
    with pytest.raises(ValueError):
        score_stream(stream, model)
    score_to(stream, model, str(tmp_path / "scores"), str(tmp_path / "scored")).awaitTermination()
    live = {r["doc_id"]: np.array(r["theta"]) for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    for r in model.transform(bags).collect():
        np.testing.assert_allclose(live.pop(r["doc_id"]), r["theta"])
    assert not live
