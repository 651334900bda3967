import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.functions import chat_logs
from textprov.operators import curate
from textprov.sources import artifacts, texts


def rows(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_texts_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\r\n  two \n\nx\ry\n")
    assert [t for _, t in rows(texts.lines(spark, str(tmp_path / "a.txt")))] == ["one", "", "  two ", "", "x\ry"]
    assert rows(texts.whole_file(spark, str(tmp_path / "a.txt"))) == [(0, "one\r\n\r\n  two \n\nx\ry\n")]
    (tmp_path / "a.json").write_text('["x", "", "é\\n"]')
    assert rows(texts.json_array(spark, str(tmp_path / "a.json"))) == [(0, "x"), (1, ""), (2, "é\n")]
    for bad in ('{"a": 1}', "[1", '["a", null]', '"a"'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception):
            texts.json_array(spark, str(tmp_path / "bad.json")).collect()


def test_one_source(spark, tmp_path):
    (tmp_path / "f").write_text("from a file")
    assert rows(texts.source(spark, text="t")[0]) == [(0, "t")]
    assert rows(texts.source(spark, file=str(tmp_path / "f"))[0]) == [(0, "from a file")]
    docs, batch = texts.source(spark, stream=io.StringIO("piped\ntext"))
    assert rows(docs) == [(0, "piped\ntext")] and not batch
    assert texts.source(spark, batch=str(tmp_path / "f"))[1]
    with pytest.raises(ValueError):
        texts.source(spark, text="t", file="f")


def test_checked_texts():
    assert texts.checked(np.array(["a", "b"])) == ["a", "b"] == texts.checked(np.array(["a", "b"], object)) == texts.checked(np.array([b"a", b"b"]))
    assert texts.checked([]) == []
    for bad, error in (("a", TypeError), ([1], TypeError), (np.array([1]), TypeError), (np.array([["a"]]), ValueError)):
        with pytest.raises(error):
            texts.checked(bad)


def test_csv_and_corpus(spark, tmp_path):
    for i, name in enumerate("ab"):
        (tmp_path / f"{name}.csv").write_text(f'title,text,label\nt{i},"line 1\nsaid ""yes"", {i}",{i}\n')
    got = texts.csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("title").collect()
    assert [tuple(r) for r in got] == [("t0", 'line 1\nsaid "yes", 0', 0), ("t1", 'line 1\nsaid "yes", 1', 1)]
    for i in range(2):
        spark.createDataFrame([(f" text {i} ", f" n{i}\n"), (None, "x"), ("", "y")], "body string, note string").write.parquet(str(tmp_path / f"split{i}"))
    got = texts.corpus(spark, [str(tmp_path / f"split{i}") for i in range(2)], "group/corpus-1", {"body": "text", "absent": "z"})
    assert sorted(map(tuple, got.select("text", "note", "dataset").collect())) == [("text 0", "n0", "corpus-1"), ("text 1", "n1", "corpus-1")]
    assert texts.corpus(spark, [str(tmp_path / "split0")], "c", {"body": "text"}, clean=False).count() == 3


def test_printed_conversations(spark):
    printed = "[{'role': 'user', 'content': array([{'type': 'text', 'text': \"it's (a) ]q\", 'image': None, 'mimeType': None}], dtype=object), 'num_tokens': 3}\n {'role': 'assistant', 'content': array([{'type': 'text', 'text': 'yes\\nno'}, {'type': 'image', 'image': 'i'}], dtype=object)}]"
    got = chat_logs.parse(printed)
    assert [m["role"] for m in got] == ["user", "assistant"] and got[0]["content"][0]["text"] == "it's (a) ]q" and got[0]["num_tokens"] == 3.0 and got[1]["num_tokens"] is None
    assert chat_logs.parse("[{'role': 'assistant', 'content': 'flat'}]")[0]["content"][0]["text"] == "flat"
    # literals are parsed and never run
    assert chat_logs.parse("__import__('os').system('true')") is None and chat_logs.parse("[{'role': open('x')}]") in (None, [None])
    assert chat_logs.parse(None) is None and chat_logs.parse("") == [] and chat_logs.parse("nonsense {") is None
    assert chat_logs.unarrayed("array(1, dtype=int) array(array([2])) array(") == "[1] [2] array("
    table = spark.createDataFrame([(printed, None), ("broken {", printed)], "messages_a string, messages_b string")
    got = curate.arena_printed(table, "arena")
    assert [tuple(r) for r in got.collect()] == [("yes\nno", 1, "arena")] * 2
    flat = spark.createDataFrame([([("user", "q"), ("assistant", " a ")], None), ([], [("assistant", "b")])], "conversation_a array<struct<role:string,content:string>>, conversation_b array<struct<role:string,content:string>>")
    assert sorted(r.text for r in curate.arena(flat, "x").collect()) == [" a ", "b"]


def test_artifacts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.resolve(local=str(tmp_path), cache=str(tmp_path / "none"))
    artifacts.save_json(tmp_path / "1.0.0" / "model.json", {})
    assert artifacts.resolve(cache=str(tmp_path)) == tmp_path / "1.0.0"
    assert artifacts.read_threshold(tmp_path / "no") == 0.5
    artifacts.write_threshold(tmp_path / "t", 0.62)
    assert artifacts.read_threshold(tmp_path / "t") == 0.62
    (tmp_path / "t").write_text("much")
    assert artifacts.read_threshold(tmp_path / "t") == 0.5
    assert [artifacts.bumped("1.2.3", x) for x in ("major", "minor", "patch")] == ["2.0.0", "1.3.0", "1.2.4"]
    df = spark.createDataFrame([(i, f"t{i}", i % 2, "d") for i in range(50)], "doc_id long, text string, label int, dataset string")
    assert [tuple(r) for r in artifacts.write_curated(df, str(tmp_path / "c")).collect()] == [(0, 25), (1, 25)]
    artifacts.write_splits(df, str(tmp_path / "train"), str(tmp_path / "test"), ["dataset", "label"])
    train, test = (spark.read.parquet(str(tmp_path / x)) for x in ("train", "test"))
    assert test.groupBy("label").count().select("count").distinct().collect()[0][0] == 5 and train.unionByName(test).exceptAll(df).isEmpty() and train.count() == 40
    for run in "ab":
        artifacts.log_metrics(spark.createDataFrame([(0.5, 3, "svc")], "f1 double, n int, model string"), str(tmp_path / "log"), run)
    assert sorted((r.run, r.metric, r.value) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("a", "f1", 0.5), ("a", "n", 3.0), ("b", "f1", 0.5), ("b", "n", 3.0)]


def test_quotas_and_columns(spark):
    a = spark.createDataFrame([(i, f"a{i % 6}", i % 2) for i in range(12)], "doc_id long, text string, label int")
    b = spark.createDataFrame([(i, f"b{i}", 1, "m") for i in range(30)], "doc_id long, text string, label int, models string")
    out = curate.by_quotas({"a": a, "b": b}, [("a", "all", None), ("b", "sample", 7)])
    got = curate.drop_columns(out, "models").collect()
    assert sum(r.dataset == "b" for r in got) == 7 and sorted(r.doc_id for r in got if r.dataset == "a") == list(range(6))
    with pytest.raises(ValueError):
        curate.by_quotas({"a": a}, [("a", "some", 1)])
    with pytest.raises(ValueError):
        curate.drop_columns(a, "models", strict=True)
    with pytest.raises(Exception):
        curate.cast_label(a.withColumn("label", F.lit(300))).collect()
    assert {r.label for r in curate.labelled(a, curate.AI, "x").collect()} == {1}
