"""Registered queries work on whole texts and on every sentence."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import blocks, corpus, entities, graph, metrics, parse, ranking
from tessella.plans import catalog

ITEM = "the very first words that all the documents of this small table hold in common today, and then a zebra ran"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, f"Common start number {i}. {ITEM[:84]} and no more.", "src") for i in range(4)] + [(4, f"One two three. {ITEM}! Last words stand here.", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, "view", i, float(i)) for i in range(5)], "event_id long, event_type string, user_id long, value double").write.parquet(f"{d}/events.parquet")
    return d


def test_clause_keys_of_every_sentence(spark, tables):
    got = {}
    for r in catalog.QUERIES["clause_keys"](spark, tables).collect():
        got.setdefault((r.pid, r.sent), []).extend(r.key.split())
    want = {(r.pid, r.sent): sorted(w for w in r.text.split() if any(c.isalnum() for c in w)) for r in catalog.sentences(spark, tables).collect()}
    assert {k: sorted(v) for k, v in got.items()} == want and {sent for _, sent in got} == {0, 1, 2}


def test_fuzzy_span_is_the_whole_item(spark, tables):
    (r,) = catalog.QUERIES["fuzzy_span"](spark, tables).collect()
    assert (r.pid, r.e - r.s) == (4, len(ITEM))


def test_beam_starts_from_the_whole_item(spark, tables):
    rows = catalog.QUERIES["beam_traverse"](spark, tables).collect()
    assert any(r.path.startswith("00000004:") for r in rows)


def test_intervals_rest_on_ten_thousand_resamples(spark, tables, monkeypatch):
    seen = []
    inner = metrics.bootstrap
    monkeypatch.setattr(metrics, "bootstrap", lambda *a, **k: seen.append(k.get("n_boot")) or inner(*a, **k))
    for name in ("paired_bootstrap", "ratio_ci"):
        assert len(catalog.QUERIES[name](spark, tables).collect()) == 1
    assert seen == [10_000, 10_000]


def test_long_texts_are_segmented_in_linear_time(spark):
    frame = spark.createDataFrame([("It is so. " * 20_000,)], "t string")
    began = time.time()
    spans = frame.select(X.sentences(F.col("t")).alias("x")).first().x
    assert time.time() - began < 60 and len(spans) == 20_000 and tuple(spans[-1]) == (199_990, 199_999)
    found = frame.select(X.sentence_texts(F.col("t")).alias("x")).first().x
    assert {r.text for r in found} == {"It is so."} and [(r.s, r.e) for r in found] == [tuple(r) for r in spans]


@pytest.mark.parametrize("name", ["clause_keys", "triple_keys", "parse_subtree_span"])
def test_parses_are_not_shuffled(spark, tables, name):
    assert "Exchange" not in catalog.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()


def test_tables_of_tokens_give_what_sentences_give(spark, tables):
    trees = parse.toy_trees(catalog.sentences(spark, tables))
    tokens = parse.toy_tokens(catalog.sentences(spark, tables))
    for work in (parse.subtree_spans, parse.clause_keys, parse.triples):
        assert sorted(work(trees).collect()) == sorted(work(tokens).collect())
    chain = spark.createDataFrame([(1, 0, i, max(i - 1, 0)) for i in range(600)], "pid long, sent int, i long, head long")
    assert sorted((r.i, r.lo, r.hi, r.n) for r in parse.subtree_spans(chain).collect()) == [(i, i, 599, 600 - i) for i in range(600)]
    with pytest.raises(Exception, match="go round"):
        parse.subtree_spans(spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 0)], chain.schema)).collect()


def test_levels_around_the_whole_answer(spark, tmp_path):
    text = "z0 z1 z2 z3 z4 z5 z6 z7. Next ones are here. And more."
    spark.createDataFrame([(1, text, "src")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "z3 z4 z5"), (2, "z7. Next ones")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.qid, r.level, r.s, r.e) for r in catalog.QUERIES["answer_spans"](spark, str(tmp_path)).collect()}
    # Tokens 3, 4 and 5 meet in 1; the second answer begins in a sentence and ends in the next.
    assert got == {(1, "sentence", 0, 24), (1, "clause", 3, 24), (2, "sentence", 0, 24), (2, "clause", 3, 24), (2, "phrase", 21, 24)}


def test_no_vector_is_shuffled_for_each_block(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(5, [float(y) for y in x[9]]), (1000, None)]
    frame = spark.createDataFrame(rows, "uidx long, v array<double>")
    asked = frame.where("uidx < 300").dropDuplicates(["uidx"]).withColumnsRenamed({"uidx": "qid", "v": "q"})
    monkeypatch.setattr(blocks, "UNIT_ROWS", 64)
    queries = {r.qid: np.array(r.q) for r in asked.collect()}
    for size, least in ((32 << 20, 0.3), (10_000, 0.3), (10_000, None)):
        monkeypatch.setattr(blocks, "SLICE_BYTES", size)
        near = blocks.nearest(frame, asked, 4, least, not_own=True)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "CoGroup" not in plan
        got = {}
        for r in near.collect():
            got.setdefault(r.qid, {})
            got[r.qid][r.uidx] = max(r.score, got[r.qid].get(r.uidx, -2))
        for q, v in queries.items():
            want = {}
            for i, u in rows[:-1]:
                c = round(float(np.dot(u, v)), 6)
                if i != q and (least is None or c >= least):
                    want[i] = max(c, want.get(i, -2))
            top = lambda d: [(i, round(c, 5)) for i, c in sorted(d.items(), key=lambda y: (-y[1], y[0]))[:4]]
            assert top(got.get(q, {})) == top(want)


def test_search_leaves_a_task_with_its_best_only(spark, monkeypatch):
    from tessella.operators import ranking

    units = spark.range(3000).selectExpr("id AS uidx", "concat('word', id % 7, ' word', id % 11, ' word', id % 3, ' other', id) AS search_text")
    asked = spark.createDataFrame([(1, "word1 word2 word1"), (2, "word6 word10 other2999"), (3, "nothing")], "qid long, question string")
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    got = ranking.bm25(units, asked, 5)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString() and len(rows(got)) == 10
    held = got._jdf.queryExecution().toRdd().count()
    assert held == 10
    monkeypatch.setattr(ranking, "SCORES", 30)
    again = rows(ranking.bm25(units, asked, 5))
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 1)
    assert rows(got) == again == rows(ranking.bm25(units, asked, 5))
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 200_000)
    twice = units.unionByName(units.where("uidx < 20"))
    few = rows(ranking.bm25(twice, asked, 5))
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 1)
    assert few == rows(ranking.bm25(twice, asked, 5))


def test_a_long_text_is_cut_once_for_all_its_mentions(spark):
    from tessella.operators import entities

    paragraphs = spark.createDataFrame([(1, "src", "Here is AB. " * 2000)], "pid long, title string, context string")
    began = time.time()
    found = entities.contexts(entities.mentions(paragraphs), paragraphs).collect()
    assert time.time() - began < 60 and len({r.mid for r in found}) == 2000 and {r.around for r in found} == {"Here is AB."}


def test_weights_of_resamples_are_those_of_their_draws(spark):
    """Each weight is the number of bounds that its draw reaches, also where a bound falls among the draws that share their upper bits."""
    import numpy as np

    n, boots = 70, 2_100
    rows = spark.range(n).select("id", (F.col("id") * 1.5).alias("a"), (F.col("id") % 7 + 1.0).alias("b"))
    got = metrics.bootstrap(rows, "a", "b", "ratio", n_boot=boots, seed=3).first()

    def mixed(h):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    h = np.array([r.h for r in rows.select(F.xxhash64(F.lit(3), F.col("id")).alias("h")).collect()]).view(np.uint64)
    draw = (mixed(h[:, None] ^ mixed(np.arange(1, boots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)).astype(float) * 2.0**-53
    weight = (draw[:, :, None] >= np.array(metrics.POISSON)).sum(axis=2)
    # What is drawn at once fits into a processor's cache.
    assert metrics.DRAWS[0] * metrics.DRAWS[1] <= 1 << 18
    x, y = (np.array([r[c] for r in rows.collect()]) @ weight for c in ("a", "b"))
    assert np.allclose(np.percentile(x / y, [2.5, 97.5]), [got.low, got.high], rtol=1e-12)


@pytest.mark.parametrize("name", ["hop_interleave", "hop_merge", "beam_traverse", "beam_flat_stop"])
def test_hops_and_beams_read_a_corpus_once(spark, tables, monkeypatch, name):
    """Texts are searched, cut and looked through for mentions once, and what meets a beam's few steps is not shuffled."""
    seen = []
    for module, step in ((ranking, "bm25"), (entities, "mentions"), (corpus, "explode_sentences")):
        monkeypatch.setattr(module, step, lambda *a, step=step, inner=getattr(module, step), **k: seen.append(step) or inner(*a, **k))
    kept = []
    monkeypatch.setattr(graph, "materialise", lambda frame, label, inner=graph.materialise: kept.append((label, frame._jdf.queryExecution().executedPlan().toString())) or inner(frame, label))
    assert catalog.QUERIES[name](spark, tables).count()
    beam = name.startswith("beam")
    assert sorted(seen) == ["bm25", *["explode_sentences"] * beam, "mentions"]
    texts = [plan for label, plan in kept if label == "beam-texts"]
    assert len(texts) == 2 * beam and all("BroadcastHashJoin" in plan for plan in texts)
