"""The pipeline over made-up documents: every planted case is caught, clean documents stay."""

import hashlib
import random
import struct

import pytest

import corpus_pipeline
from tessella.llm.queries import public_vocabulary


def test_planted_cases(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    random.seed(21)
    words = ["".join(random.choice(["ta", "re", "mo", "li", "su", "ne", "ka", "po"]) for _ in range(3)) for _ in range(400)]
    say = lambda n: [random.choice(words) for _ in range(n)]
    benchmark = [(i, " ".join(say(20))) for i in range(5)]
    docs, labels, kind = [], [], {}
    for i in range(600):
        text, k = say(60), "clean"
        if i % 8 == 1:
            text[9:9], k = random.sample(["gromwit", "blastard", "snivelor"], 2), "toxic"
        elif i % 7 == 2:
            text, k = [f"{w}$$$" for w in text], "poor"
        elif i % 50 == 3:
            text[5:5], k = random.choice(benchmark)[1].split(), "leak"
        docs.append((i, " ".join(text), random.choice(["en", "de"]), f"s{i % 4}", 0))
        labels.append((i, int(k != "poor"), int(k == "toxic")))
        kind[i] = k
    copied = [i for i in range(600) if kind[i] == "clean"][:20]
    for j, i in enumerate(copied):
        text = docs[i][1].split()
        if j % 2:
            text[30] = "changed"
        docs.append((1000 + j, " ".join(text), "en", "s0", 0))
        kind[1000 + j] = "copy"
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    for name, rows, schema in [("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    ranks, pattern = public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {i for i in got if i < 2000}
    assert left == {i for i, k in kind.items() if k == "clean"}
    text = {i: t for i, t, *_ in docs}
    for i in left:
        ids = library.encode_ordinary(text[i])
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontaminate", "bpe"]


def test_the_last_stage_returns_token_ids(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {1: "Some words, some 123 more.", 2: "", 3: "ÉTÉ — 漢字"}
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.encode(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), str(tmp_path)).collect()}
    assert got == {i: struct.pack(f"<{len(ids)}I", *ids) for i, ids in ((i, library.encode_ordinary(t)) for i, t in texts.items())}


def test_a_frame_outlives_the_pipeline(spark, tmp_path):
    from tessella.llm import near_dedup

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ta re mo li su ne ka po".split()) for _ in range(40)), "en", "s", 9) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, *rows[0][1:])], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = near_dedup.digest(docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 60
    assert before.where("NOT kept").count() == 1


def test_empty_tables_repeated_rows_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id0 string, id long, spans string, score double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    own = ("mine", 7, "spans", 0.5)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "s", 9, *own), (1, text, "en", "s", 9, *own), (1, "other words entirely", None, None, None, *own), (2, text, "en", "s", 9, *own), (None, None, None, None, None, *own),
            (3, "", "en", "s", 0, *own), (4, "long " * 30_000 + "end", "en", "s", 9, *own)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    for name in ("none", "odd"):
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    one = next(r for r in got if r.doc_id == 1)
    assert one.decoded_sha256 == hashlib.sha256(b"other words entirely").hexdigest()  # of a repeated id, the row that sorts first


def test_tidy_trims_native_memory_of_the_driver(spark, monkeypatch):
    from tessella import session

    # The command is let fail here, as it would go unnoticed otherwise.
    monkeypatch.setattr(session, "Py4JError", ZeroDivisionError)
    called = []
    inner = session._trim_driver
    monkeypatch.setattr(session, "_trim_driver", lambda s: called.append(inner(s)))
    session.tidy(spark)
    assert called == [None]


def test_heaps_of_executors_are_collected_between_stages(spark, monkeypatch):
    from tessella import session

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    counted = lambda: sum(b.getCollectionCount() for b in beans)
    before = counted()
    session._collect_executors(spark)
    assert counted() > before
    asked = []
    monkeypatch.setattr(session, "_collect_executors", asked.append)
    corpus_pipeline._scratch.clear(spark)
    assert not asked  # a local master is its own executor
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    corpus_pipeline._scratch.clear(spark)
    assert asked == [spark]
