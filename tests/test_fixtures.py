"""Small fixtures of walks, method runs, corpus builds, merges and sources."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import prompts
from tessella.operators import blocks, corpus, entities, graph, metrics, parse, ranking
from tessella.plans import report, run
from tessella.sources import config


def _units(spark, rows):
    return spark.createDataFrame(rows, "uidx long, pid string, s int, text string").withColumn("search_text", F.col("text"))


def _walk(spark, units, order, holds=None, **more):
    question = spark.createDataFrame([(1, "where was the tower designer born")], "qid long, question string")
    ranked = spark.createDataFrame([(1, r + 1, u) for r, u in enumerate(order)], "qid long, rank int, uidx long")
    if holds is not None:
        holds = spark.createDataFrame(holds, "concept string, uidx long")
    paths, steps = graph.beam(units, ranked, question, holds, width=1, candidates=5, **more)
    out = [r.uidx for r in graph.along_paths(paths, ranked, units, question).orderBy("rank").collect()]
    return out, {r.kind: r["count"] for r in steps.groupBy("kind").count().collect()}


def test_beam_reassembles_and_hops(spark):
    units = _units(spark, [(0, "p0", 0, "the tower was designed"), (1, "p0", 23, "by Gustave Eiffel"), (2, "p0", 41, "unrelated filler text"), (3, "p1", 0, "Gustave Eiffel was born in Dijon"), (4, "p2", 0, "a different tower story")])
    out, steps = _walk(spark, units, [0, 4, 2], [("ge", 1), ("ge", 3)], depth=3)
    assert out[:3] == [0, 1, 3] and steps == {"adjacent": 1, "concept": 1}


def test_flat_stop_takes_only_steps_that_beat_the_next_unit(spark):
    units = _units(spark, [(0, "p0", 0, "where was the tower designer born"), (1, "p0", 20, "filler words only"), (2, "p2", 0, "tower designer was born in Dijon")])
    out, steps = _walk(spark, units, [0, 2, 1], depth=2, stop="flat")
    assert out[:2] == [0, 2] and steps == {}
    assert _walk(spark, units, [0, 2, 1], depth=2)[0][:2] == [0, 1]


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 5)), 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uidx long, v array<double>")
    asked = frame.where("uidx % 20 = 0").select(F.col("uidx").alias("qid"), F.col("v").alias("q"))
    old = blocks.QUERY_ROWS, blocks.UNIT_ROWS
    blocks.QUERY_ROWS, blocks.UNIT_ROWS = 4, 37
    try:
        got = ranking.dense(frame, asked, 7, not_own=True).orderBy("qid", "rank").collect()
    finally:
        blocks.QUERY_ROWS, blocks.UNIT_ROWS = old
    want = []
    for q in range(0, 300, 20):
        best = sorted((-round(float(x[q] @ x[i]), 6), i) for i in range(300) if i != q)[:7]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert [(r.qid, r["rank"], r.uidx) for r in got] == [w[:3] for w in want]


def test_contained_finds_every_item_once(spark):
    docs = [(1, "a cat sat. a cat sat"), (2, "xcat satx and more of the very long item that goes on"), (3, None), (4, "")]
    items = [(1, "cat sat"), (2, "the very long item that goes on"), (3, "cat sat"), (4, "none"), (5, None), (6, "the very long item that goes off")]
    found = corpus.contained(spark.createDataFrame(docs, "pid long, context string"), spark.createDataFrame(items, "qid long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2), (1, 2, 1), (2, 2, 22), (3, 1, 2), (3, 2, 1)]


def test_step_corpus_drops_questions_with_a_lost_step(spark):
    rows = [
        (0, "2hop__a", "q", True, [(0, "T", " The Mill burned. It was old. "), (1, "U", "Nobody saw it.")], [(0, "the mill"), (1, "Nobody")]),
        (1, "3hop__b", "q", None, [(0, "T", " The Mill burned. It was old. ")], [(0, "It was")]), (2, "2hop__c", "q", True, [(0, "T", "x")], [(0, "gone")]), (3, "2hop__d", "q", False, [(0, "T", "x")], [(0, "x")]),
    ]
    frame = spark.createDataFrame(rows, "ord int, id string, question string, answerable boolean, paragraphs array<struct<idx: int, title: string, text: string>>, steps array<struct<idx: int, answer: string>>")
    paragraphs, questions = corpus.step_corpus(frame)
    assert [(r.pid, r.context) for r in paragraphs.orderBy("pid").collect()] == [("m00000", "The Mill burned. It was old."), ("m00001", "Nobody saw it."), ("m00002", "x")]
    got = {r.id: r for r in questions.collect()}
    assert set(got) == {"2hop__a", "3hop__b"} and got["2hop__a"].qtype == "2hop" and got["2hop__a"].answers[0].text == "The Mill"
    assert got["2hop__a"].pid == "m00001" and [(s.pid, s.sent) for s in got["2hop__a"].support] == [("m00000", 0), ("m00001", 0)] and got["3hop__b"].gold_sent == 1


def test_course_corpus_places_spans(spark):
    docs = spark.createDataFrame([("b", "B syllabus", "Late work  costs\npoints. Exams are in May. Bring a pen."), ("a", "A syllabus", "Nothing.")], "name string, title string, raw string")
    rows = spark.createDataFrame([("1", "b", "q", ["exams ARE in may", ""], "yes"), ("2", "b", "q", ["not there"], "no"), ("3", "a", "q", [None], "no"), ("4", "b", "q", ["late work", "a pen"], "two")], "id string, name string, question string, spans array<string>, qtype string")
    paragraphs, questions = corpus.course_corpus(docs, rows, most=2)
    assert sorted((r.pid, r.context) for r in paragraphs.collect()) == [("s00p000", "Nothing."), ("s01p000", "Late work costs points. Exams are in May."), ("s01p001", "Bring a pen.")]
    got = {r.id: [(a.pid, a.text, a.start, a.sent) for a in r.answers] for r in questions.collect()}
    assert got == {"1": [("s01p000", "Exams are in May", 24, 1)], "4": [("s01p000", "Late work", 0, 0), ("s01p001", "a pen", 6, 0)]}


def test_kept_text_keeps_what_decoding_dropped(spark):
    frame = spark.createDataFrame([(1, "Add 2½ cups. Stir. Bake it.", "Add 2 cups. Bake it."), (2, "One.", None)], "pid long, context string, pruned string")
    assert {r.pid: r.kept for r in corpus.kept_text(frame, lambda s: s.replace("½", "")).collect()} == {1: "Add 2½ cups. Bake it.", 2: ""}


def test_meaning_tier_guards_numbers_and_negation(spark):
    rows = [(1, "a", [1.0, 0.0], "ten 10 units"), (2, "a", [0.99, 0.14], "10 units"), (3, "a", [0.98, 0.2], "11 units"), (4, "a", [1.0, 0.01], "not 10 units")]
    items = spark.createDataFrame(rows, "id long, grp string, v array<double>, text string")
    got = {r.id: r.root for r in entities.meaning_tier(items, entities.similar_pairs(items, 0.9), 0.9).collect()}
    assert got[1] == got[2] == 1 and got.get(3, 3) == 3 and got.get(4, 4) == 4


def test_mentions_have_every_occurrence(spark):
    frame = spark.createDataFrame([(1, "T", "Ada Byron met IBM. Ada Byron left in 1840.")], "pid long, title string, context string")
    got = [(r.text, r.s, r.e, r.grp) for r in entities.mentions(frame).orderBy("mid").collect()]
    assert got == [("Ada Byron", 0, 9, "person"), ("IBM", 14, 17, "org"), ("Ada Byron", 19, 28, "person"), ("1840", 37, 41, "number")]


def test_graph_build_vetoes_and_cannot_links(spark):
    rows = [("m1", 1, "A", 0, "John Smith", "person", "john smith"), ("m2", 2, "B", 0, "John Smith", "person", "john smith"), ("m3", 3, "C", 0, "Broncos Team", "org", "broncos team"), ("m4", 4, "D", 0, "Broncos Club", "org", "broncos club"), ("m5", 5, "E", 0, "Broncos Club", "org", "broncos club")]
    mentions = spark.createDataFrame(rows, "mid string, pid long, article string, s int, text string, grp string, norm string")
    units = spark.createDataFrame([(f"u{i}", i, 0, 40) for i in range(1, 6)], "uid string, pid long, s int, e int")
    verdicts = spark.createDataFrame([("exact", 1.0, "m1", "m2", "DIFFERENT"), ("embed", 0.9, "m3", "m4", "SAME"), ("embed", 0.8, "m3", "m5", "RELATED"), ("embed", 0.8, "m1", "m3", None)], "source string, cos double, a string, b string, label string")
    built = graph.build(mentions, mentions.limit(0), units, verdicts)
    groups = {}
    for r in built["items"].join(built["roots"], "id").collect():
        groups.setdefault(r.root, set()).add(r.mid)
    assert sorted(map(sorted, groups.values())) == [["m1"], ["m2"], ["m3"], ["m4", "m5"]] and built["blocked"].count() == 1
    assert any("vetoed string groups: 1" in line for line in report.graph_report(built))
    assert built["edges"].where("type = 'related'").count() == 1


def test_triples_have_modifiers_and_prepositions(spark):
    words = [("big", "amod", 1, "ADJ"), ("dogs", "nsubj", 2, "NOUN"), ("chase", "ROOT", 2, "VERB"), ("red", "amod", 4, "ADJ"), ("cats", "dobj", 2, "NOUN"), ("in", "prep", 2, "ADP"), ("parks", "pobj", 5, "NOUN")]
    rows = [(1, 0, i, 0, 0, w, h, d, p, False) for i, (w, d, h, p) in enumerate(words)]
    frame = spark.createDataFrame(rows, "pid long, sent int, i long, s int, e int, w string, head long, dep string, pos string, punct boolean")
    assert sorted(r.key for r in parse.triples(frame).collect()) == ["big dogs chase in parks", "big dogs chase red cats"]


@pytest.fixture(scope="module")
def small(spark):
    paragraphs = spark.createDataFrame([(1, "Towers", "The tower was designed by Gustave Eiffel. It stands in Paris."), (2, "People", "Gustave Eiffel was born in Dijon. He liked steel."), (3, "Food", "Bread needs flour. Flour needs wheat.")], "pid long, title string, context string")
    questions = spark.createDataFrame([(9, "where was the tower designer Gustave Eiffel born")], "qid long, question string")
    past = spark.createDataFrame([(1, "who designed the tower", 1, 0, 26, "Gustave Eiffel", 0), (2, "what needs flour", 3, 0, 0, "Bread", 0)], "qid long, question string, pid long, ord int, start int, text string, sent int")
    return run.Corpus(paragraphs, questions, past)


@pytest.mark.parametrize("method", ["B1", "B2-n2", "B3+R", "L-k1", "O-ORACLE", "C-ctx-k1-1-1", "C-ctxs-k1-1-1", "E-k1", "K-all", "K-clause-k1", "G-a0.5-r0.3-q0.5", "H-s1-k5-interleave", "H-s2-k5-merge+R", "T-S-b2-d2-k5", "T-B3-b1-d2-k5-x-sf", "T-E2-b1-d1-k3", "T-Cs111-b1-d1-k3"])
def test_every_method_runs(spark, small, method):
    rows = run.run(method, small, [8, 32]).collect()
    assert rows and {r.budget for r in rows} <= {8, 32}
    for budget in (8, 32):
        own = sorted((r["rank"], r.taken) for r in rows if r.budget == budget)
        assert sum(t for _, t in own) + len(own) - 1 <= budget


def test_methods_with_a_prior_need_an_encoder(spark, small):
    with pytest.raises(ValueError):
        run.run("B4", small, [8])
    hashed = run.Seams(encoder=lambda f: f.select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.pmod(F.xxhash64("text", k), F.lit(100)) / 400).cast("double")).alias("v")))
    assert run.run("B4", small, [8], hashed).count() and run.run("L+P", small, [8], hashed).count()


def test_reference_questions(spark):
    split = spark.createDataFrame([(1, "build"), (2, "tuning"), (3, "future")], "id long, part string")
    assert [sorted(r.id for r in metrics.reference_questions(split, q).collect()) for q in ("tuning", "future")] == [[1], [1, 2]]


def test_stored_index_is_read_again(spark, tmp_path):
    units = spark.createDataFrame([(0, "a", "the red tower"), (1, "b", "a blue boat")], "uidx long, uid string, search_text string")
    asked = spark.createDataFrame([(1, "red boat")], "qid long, question string")
    first = ranking.bm25_rank(*ranking.bm25_index(units, str(tmp_path)), asked).collect()
    again = ranking.bm25_rank(*ranking.bm25_index(units, str(tmp_path)), asked).collect()
    assert sorted(first) == sorted(again) == sorted(ranking.bm25(units, asked).collect()) and len(list(tmp_path.iterdir())) == 1


def test_configs_paths_and_prompts(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps({"stage": "run"}))
    bad.write_text("[]")
    assert config.load_config(good)["stage"] == "run"
    for text in ("[]", "{}"):
        bad.write_text(text)
        with pytest.raises(ValueError):
            config.load_config(bad)
    assert config.derived_dir({"data_dir": "d", "hf_id": "x/squad", "split": "dev", "spacy_model": "sm"}) == "d/derived/squad_dev_sm"
    assert config.derived_dir({"data_dir": "d", "dataset": "musique", "spacy_model": "sm"}) == "d/derived/musique_dev_sm"
    said = spark.range(1).select(prompts.reader(F.lit("q"), F.lit("c")).alias("r"), prompts.judge((F.lit("a"), F.lit("x"), F.lit("ca")), (F.lit("b"), F.lit("y"), F.lit("cb"))).alias("j")).first()
    assert said.r.endswith("Question: q\nAnswer:") and said.j.startswith('A: "a"') and "SAME, RELATED" in said.j
    assert json.loads(report.as_json(spark.range(2)))[1] == {"id": 1}
