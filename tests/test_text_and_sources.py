"""Text operators, topics, sentiment, readers, sinks and the stream."""

import bz2
import json
import time

import numpy as np
from pyspark.sql import functions as F

import pytest
from threadloom.operators import embeddings, sentiment, text, topics
from threadloom.sources import readers, sinks
from threadloom.streaming import interactions as streaming


def test_thread_documents_drop_blanks(spark):
    rows = [("1", "t", 2, "b"), ("2", "t", 1, "a"), ("3", "t", 3, " \t \n"), ("4", "u", 1, None), ("5", "u", 2, "")]
    df = spark.createDataFrame(rows, "id string, link_id string, pos long, body_cleaned string")
    assert [tuple(r) for r in text.thread_documents(df).collect()] == [("t", "a b", 2)]


def test_tokens(spark):
    df = spark.createDataFrame([("The 123 don't 's ...x !!! abc Café no",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"), ["the"])).collect()] == [["don't", "abc", "café"], []]
    assert [r[0] for r in df.select(text.plain_tokens(F.col("t"), ["the"])).collect()] == [["don", "abc", "cafe"], []]


def test_empty_dictionary_gives_no_topic(spark):
    df = spark.createDataFrame([(k, "few words here only once") for k in range(2)], "k long, text string").select("k", text.tokens(F.col("text")).alias("tokens"))
    model = topics.TopicModel(k=2).fit(df, "k")
    assert {r["topic_id"] for r in model.assign(df, "k").collect()} == {-1}


def test_seed_mapping_is_greedy_in_seed_order():
    words = {0: ["a", "b", "c"], 1: ["a", "x", "y"], 2: ["q"]}
    named = topics.map_to_seeds(words, [{"a", "x"}, {"a", "b"}, {"zzz"}], ["one", "two", "three"])
    assert named == {1: "one", 0: "two", 2: "LDA_TOPIC_2_q"}


def test_sentiment_scorers(spark):
    df = spark.createDataFrame([("1", "t", "good day"), ("2", "t", "bad bad good"), ("3", "t", " \n"), ("4", "t", None), ("5", "t", "boom")], "id string, link_id string, body_cleaned string")
    got = {r["id"]: r["sentiment"] for r in sentiment.direct_sentiment(df).collect()}
    assert got == {"1": 1, "2": -1, "3": None, "4": None, "5": 0}

    def make():
        def score(batch):
            if "boom" in batch:
                raise RuntimeError("no")
            return np.array([[t.count("bad"), 0, t.count("good")] for t in batch], float)

        return score

    got = {r["id"]: r["sentiment"] for r in sentiment.with_sentiment(df, sentiment.model_sentiment(make, batch=1, failed="null")).collect()}
    assert got == {"1": 1, "2": -1, "3": None, "4": None, "5": None}
    with pytest.raises(Exception, match="no"):
        sentiment.with_sentiment(df, sentiment.model_sentiment(make, batch=1)).collect()


def test_walks_stay_on_edges(spark):
    g = spark.createDataFrame([("m", 0, "a", "b", 1.0), ("m", 0, "b", "c", 2.0)], "method string, snapshot long, src string, dst string, weight double")
    walks = [r["walk"] for r in embeddings.random_walks(g, length=6, walks=3).collect()]
    linked = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert len(walks) == 9 and all((x, y) in linked for w in walks for x, y in zip(w, w[1:], strict=False))
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "node string, vector array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz")], "u string, v string")
    got = {r["v"]: r["score"] for r in embeddings.pair_cosine(pairs, vectors).collect()}
    assert abs(got["b"] - 0.5**0.5) < 1e-9 and got["zz"] == 0


def test_comment_reader(spark, tmp_path):
    for month in ("2016-07", "2016-08", "2017-03"):
        lines = [json.dumps({"id": month, "author": "x", "subreddit": "k", "score": 3}), "{broken", ""]
        (tmp_path / f"comments_{month}.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    df = readers.read_comments(spark, str(tmp_path), "2016-08", "2017-02")
    assert [(r["id"], r["month"], r["body"]) for r in df.collect()] == [("2016-08", "2016-08", None)]
    assert readers.load_comments(df, ["id", "nothing"]).columns == ["id", "nothing"]


def test_comment_reader_is_as_fast_below_long_paths(spark, tmp_path):
    folder = tmp_path
    for k in range(12):
        folder /= f"{k:x}" * 200
    folder.mkdir(parents=True)
    (folder / "comments_2016-09.json").write_text('{"id": "1", "score": 3}\n' * 40_000)
    began = time.perf_counter()
    assert readers.read_comments(spark, str(folder), "2016-08", "2016-10").agg(F.sum("score"), F.max("month")).first() == (120_000, "2016-09")
    assert time.perf_counter() - began < 10


def test_rows_of_one_task_are_compressed_by_several(spark, tmp_path):
    rows = spark.range(400_000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("author"), F.sha2(F.col("id").cast("string"), 256).alias("subreddit"), F.lit("2016-08").alias("month"))
    sinks.write_json_lines(rows.coalesce(1), str(tmp_path / "out"), ["month"], "bzip2", spread=True)
    assert len(list((tmp_path / "out" / "month=2016-08").glob("*.bz2"))) > 1
    found = readers.read_comments(spark, str(tmp_path / "out"))
    assert found.agg(F.count("*"), F.count_distinct("id")).first() == (400_000, 400_000)


def test_edge_and_metadata_readers(spark, tmp_path):
    (tmp_path / "networks_2016.csv").write_text("node_1,node_2,weighted,unweighted\nsubA,subB,5,1\nsubA,subC,0,0\nsubC,subD,-1,1\nsubD,subE,,1\n")
    path = str(tmp_path / "networks_2016.csv")
    assert [(r["src"], r["weight"]) for r in readers.read_edges(spark, path).collect()] == [("subA", 5.0)]
    assert sorted((r["src"], r["weight"]) for r in readers.read_edges(spark, path, use_weights=False).collect()) == [("subA", 5.0), ("subC", None), ("subD", None)]
    net = readers.read_networks(spark, path)
    assert {r["yr"] for r in net.collect()} == {2016}
    assert readers.network_view(net, "unweighted").count() == 3 and readers.network_view(net, "weighted", 7.0).filter("weighted = 7").count() == 1
    (tmp_path / "meta.jsonl").write_text('{"subreddit": "a", "party": "dem", "banned": "1", "gun": null}\n{"party": "rep"}\n{bad\n{"subreddit": "b", "gun": "x"}\n')
    assert sorted(tuple(r) for r in readers.read_metadata(spark, str(tmp_path / "meta.jsonl")).collect()) == [("a", "dem", 1, 0), ("b", "", 0, 0)]
    assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "meta.jsonl"), "party").collect()] == [("a", "dem")]
    (tmp_path / "users.jsonl").write_text('{"author": "x", "bot": 1}\n{"author": "y", "bot": 0}\n{"author": "z"}\n')
    assert [r[0] for r in readers.read_bots(spark, str(tmp_path / "users.jsonl")).collect()] == ["x"]
    (tmp_path / "list.txt").write_text("a\n\n b \na")
    assert sorted(r[0] for r in readers.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["a", "b"]


def test_sinks_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("m", "2016-08", "a", "b", 2.0), ("m", "2016-09", "a", "b", 0.0)], "method string, snapshot string, src string, dst string, weight double")
    sinks.write_edges(g, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 1
    sinks.write_json_lines(g, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert sinks.tidy(g, ["method", "snapshot"], ["weight"]).count() == 2


def test_stream_matches_batch(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "x", "k1", 5), ("2024-01-02 00:00:00", "x", "k2", 5), ("2024-01-09 00:00:00", "x", "k1", 5), ("2024-03-01 00:00:00", "z", "k9", 5)]
    df = spark.createDataFrame(rows, "t string, author string, community string, score long").select(F.to_timestamp("t").alias("ts"), "author", "community", "score")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streaming.append_windows(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    edges = streaming.edges_of_windows(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in edges] == [("k1", "k2", 1)]


def test_missing_stage_output_is_empty(spark, tmp_path):
    assert readers.read_or_empty(spark, str(tmp_path / "none"), "method string, density double").count() == 0
    (tmp_path / "some.csv").write_text("method,density\nm,0.5\n")
    assert [tuple(r) for r in readers.read_or_empty(spark, str(tmp_path / "some.csv"), "method string, density double").collect()] == [("m", 0.5)]


def test_fold_sums_partials(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x long").repartition(3)
    got = readers.fold(df, ["k"], {"n": lambda: F.count("*"), "x": lambda: F.sum("x")})
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, 3), ("b", 1, 3)]


def test_lemmatiser_hook(spark):
    df = spark.createDataFrame([("cats dogs",), (None,)], "t string")
    run = text.lemmatised(lambda: lambda w: w.removesuffix("s"))
    assert [r[0] for r in df.select(run(F.col("t"))).collect()] == ["cat dog", None]


def test_guided_topics_sentinels(spark):
    df = spark.createDataFrame([(1, "the gun laws and gun rights"), (2, "nothing here matches"), (3, " ")], "k long, text string")
    got = {r["k"]: (r["topic_id"], r["topic_label"]) for r in topics.guided_topics(df, "k", [["taxes"], ["gun"]], ["money", "guns"]).collect()}
    assert got == {1: (1, "guns"), 2: (-1, "OUTLIER"), 3: (-2, "OUTLIER")}


def test_guided_topics_move_their_centres(spark):
    """Documents without a seed word join the topic whose documents share their words; small topics and strangers are outliers."""
    rows = [(k, "apple pear fruit juice") for k in range(12)] + [(20 + k, "fruit juice sugar") for k in range(5)] + [(30 + k, "wheel motor road") for k in range(11)] + [(50, "quartz"), (51, None), (52, " "), (60, "violin bow")]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["topic_id"], r["topic_label"]) for r in topics.guided_topics(docs, "id", [["apple"], ["wheel"], ["violin"]], ["food", "cars", "music"], (), least_docs=10, no_below=1).collect()}
    assert {got[k] for k in [*range(12), *range(20, 25)]} == {(0, "food")} and {got[30 + k] for k in range(11)} == {(1, "cars")}
    assert got[50] == (-1, "OUTLIER") and got[60] == (-1, "OUTLIER") and got[51] == got[52] == (-2, "OUTLIER")
    assert topics.guided_topics(docs.limit(0), "id", [["apple"]], ["food"], ()).count() == 0


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("Ärger naïve Straße мир e\u0301te\u0301 abc123def _under x² 42",)], "t string")
    assert df.select(text.plain_tokens(F.col("t"))).first()[0] == ["arger", "naive", "straße", "мир", "ete", "abc", "def"]
