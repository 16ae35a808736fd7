import pytest
from pyspark.sql import functions as F, types as T

from tessella.functions.models import batch_column
from tessella.plans.spec import parse
from tessella.sources import io
from tessella.streaming.demand import demand


def test_method_ids():
    assert parse("B2-n7+R").prune == 7 and parse("B2-n7+R").rerank and parse("B2").prune == 5
    assert parse("L-k2+P").prior and parse("L-k2").options == {"k": 2}
    assert parse("C-ctx-k1-2-3").options["k"] == {"sentence": 1, "clause": 2, "phrase": 3}
    assert parse("T-S-b5-d4-k10-sf").options == {"beam": 5, "depth": 4, "candidates": 10, "across": False, "stop": "flat"}
    assert parse("G-a0.5-r0.3-q0.5").options["alpha"] == 0.5 and parse("H-s3-k20-merge").walk == "hop"
    for bad in ("B9", "C-own-k3-2-1", "B1+Rx", "", "T-Z-b1-d1-k1"):
        with pytest.raises(ValueError):
            parse(bad)


def test_jsonl_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "T", "One. Two.", [(0, 4), (5, 9)]), ("p2", None, "", [])], io.PARAGRAPH)
    io.write_jsonl(rows, f"{tmp_path}/p")
    assert sorted(io.read_jsonl(spark, f"{tmp_path}/p", io.PARAGRAPH).collect()) == sorted(rows.collect())
    log = spark.createDataFrame([("m", 64, 1, 0.5), ("m", 64, 2, 0.25)], "method string, budget int, qid long, value double")
    assert io.append_missing(log, f"{tmp_path}/log", ["method", "budget", "qid"]) == 2
    more = log.unionByName(spark.createDataFrame([("m", 128, 1, 1.0)], log.schema))
    assert io.append_missing(more, f"{tmp_path}/log", ["method", "budget", "qid"]) == 3
    assert io.read_log(spark, f"{tmp_path}/log", log.schema).count() == 3
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "qid int, rank int, uidx int")
    with pytest.raises(Exception, match="no contexts for question 2"):
        io.export_inputs(ranked, spark.createDataFrame([(1, 64, "c")], "qid int, budget int, context string"), 1).collect()


def test_model_seam(spark):
    score = batch_column(lambda: (lambda a, b: [float(len(set(x.split()) & set(y.split()))) for x, y in zip(a, b)]), T.DoubleType())
    assert spark.createDataFrame([("a b c", "b c d")], "x string, y string").select(score(F.col("x"), F.col("y")).alias("s")).first().s == 2.0


def test_streaming_demand(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "p", 0, 4, q) for q in (1, 1, 2)] + [("2024-01-01 00:00:01", "p", 5, 9, 1)], "t string, pid string, s int, e int, qid int")
    rows.select(F.to_timestamp("t").alias("ts"), "pid", "s", "e", "qid").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, pid string, s int, e int, qid int").parquet(f"{tmp_path}/in")
    running = demand(stream, 2).writeStream.outputMode("complete").format("memory").queryName("asked").option("checkpointLocation", f"{tmp_path}/c").start()
    running.processAllAvailable()
    running.stop()
    assert [tuple(r) for r in spark.sql("SELECT pid, s, e, n FROM asked").collect()] == [("p", 0, 4, 2)]


def test_reports_and_guards(spark):
    from tessella.plans import report

    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "method string, mean double")
    assert report.markdown(rows, ["method", "mean"], 2).splitlines()[2:] == ["| a | 1.00 |", "| b |  |"]
    with pytest.raises(ValueError):
        report.markdown(rows, ["method"], most=1)
    assert report.require_map_rate(spark.createDataFrame([(1,)], "start_sent int")) == 1.0
    with pytest.raises(ValueError):
        report.require_map_rate(spark.createDataFrame([(None,), (1,)], "start_sent int"))
    report.comparable({"reader": 1}, {"reader": 1})
    with pytest.raises(ValueError, match="data"):
        report.comparable({"data": 1}, {"data": 2})


def test_parse_spans_and_keys(spark):
    from tessella.operators import parse

    # The tower, which Eiffel designed, was completed: a small hand-made tree.
    rows = [("p", 0, i, s, e, w, h, d, t, False) for i, (s, e, w, h, d, t) in enumerate([
        (0, 3, "The", 1, "det", "DET"), (4, 9, "tower", 6, "nsubj", "NOUN"), (11, 16, "which", 4, "dobj", "PRON"), (17, 23, "Eiffel", 4, "nsubj", "PROPN"), (24, 32, "designed", 1, "relcl", "VERB"),
        (34, 37, "was", 6, "aux", "AUX"), (38, 47, "completed", 6, "ROOT", "VERB")])]
    toks = spark.createDataFrame(rows, "pid string, sent int, i long, s int, e int, w string, head long, dep string, pos string, punct boolean")
    got = {(r.level, r.s, r.e) for r in parse.answer_spans(toks, spark.createDataFrame([(1, "p", 17, 23)], "qid int, pid string, a int, b int")).collect()}
    assert got == {("sentence", 0, 47), ("clause", 11, 32), ("phrase", 17, 23)}
    assert {r.key for r in parse.triples(toks).collect()} == {"tower completed", "Eiffel designed which"}
    votes = spark.createDataFrame([("p", "phrase", 0, 3, 1), ("p", "phrase", 0, 3, 2), ("p", "sentence", 0, 3, 1), ("p", "sentence", 0, 9, 1)], "pid string, level string, s int, e int, qid int")
    assert {(r.s, r.e, r.level) for r in parse.extracted_spans(votes, {"sentence": 1, "clause": 2, "phrase": 2}).collect()} == {(0, 3, "phrase"), (0, 9, "sentence")}
    with pytest.raises(ValueError):
        parse.extracted_spans(votes, {"sentence": 2, "clause": 1, "phrase": 3})
