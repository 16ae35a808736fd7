import itertools
import random

from pyspark.sql import functions as F

from tessella.operators import entities, graph, metrics, ranking, units
from tessella.operators.components import connected_components
from tessella.operators.numbering import number_rows


def test_rank_fusion(spark):
    frame = lambda ids: spark.createDataFrame([(1, i, u) for i, u in enumerate(ids, 1)], "qid int, rank int, uidx int")
    fused = lambda *lists: [r.uidx for r in ranking.rrf([(frame(x), 1.0) for x in lists]).orderBy("rank").collect()]
    assert fused([1, 2, 3], [3, 2]) == [3, 2, 1] and fused([1, 2, 3], [2]) == [2, 1, 3] and fused([1], [2]) == [1, 2]


def test_pack_equals_a_loop(spark):
    random.seed(5)
    rows, budgets = [], [5, 9, 17]
    for q in range(40):
        rows += [(q, r, r * 10, random.randint(1, 6)) for r in range(1, random.randint(2, 9))]
    got = {(r.qid, r.budget, r["rank"]): (r.taken, r.truncated) for r in ranking.pack(spark.createDataFrame(rows, "qid int, rank int, uidx int, n_tok int"), budgets).collect()}
    want = {}
    for (q, group), budget in itertools.product([(q, list(g)) for q, g in itertools.groupby(rows, lambda r: r[0])], budgets):
        used = 0
        for i, (_, rank, _, n) in enumerate(group):
            sep = 1 if i else 0
            if used + sep + n <= budget:
                want[q, budget, rank] = (n, False)
                used += sep + n
                continue
            if budget - used - sep > 0:
                want[q, budget, rank] = (budget - used - sep, True)
            break
    assert got == want


def test_split_units_tile_a_paragraph(spark):
    text = " ".join(f"S{i}." for i in range(6))
    p = spark.createDataFrame([("p", "T", text), ("q", "T_x", "Whole one.")], "pid string, title string, context string")
    s = spark.createDataFrame([("p", "T", i, 4 * i, 4 * i + 3, f"S{i}.") for i in range(6)] + [("q", "T_x", 0, 0, 10, "Whole one.")], "pid string, title string, sent int, s int, e int, text string")
    for keys, want in [([2], {"ps00-01", "ps02", "ps03-05", "q"}), ([0, 3, 4], {"ps00", "ps01-02", "ps03", "ps04", "ps05-05", "q"})]:
        k = spark.createDataFrame([("p", x) for x in keys], "pid string, sent int")
        got = units.split_units(p, s, k).collect()
        assert {r.uid for r in got} == want
        covered = sorted(i for r in got if r.pid == "p" for i in range(r.sent_lo, r.sent_hi + 1))
        assert covered == list(range(6))


def test_evidence_groups_and_locks(spark):
    spans = spark.createDataFrame([("p", 1, 0, 38, 67), ("p", 2, 0, 38, 68), ("p", 3, 0, 17, 47)], "pid string, qid int, ord int, s int, e int")
    assert [(r.s, r.e, r.n) for r in units.evidence_groups(spans, 2).collect()] == [(38, 67, 2)]
    locked = units.locked_spans(units.evidence_groups(spans, 1)).collect()
    assert [(r.s, r.e) for r in locked] == [(38, 67)]


def test_components_equal_union_find(spark):
    random.seed(2)
    edges = [(random.randint(0, 200), random.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbering(spark):
    got = number_rows(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), [F.col("x")], "n").collect()
    assert all(r.x == r.n for r in got)


def test_splits(spark):
    ids = spark.range(1000).select(F.format_string("q%05d", "id").alias("id"))
    first = {r.id: r.part for r in metrics.split_questions(ids).collect()}
    again = {r.id: r.part for r in metrics.split_questions(ids.orderBy(F.desc("id"))).collect()}
    counts = {p: sum(v == p for v in first.values()) for p in ("tuning", "build", "future")}
    assert first == again and counts == {"tuning": 70, "build": 630, "future": 300}
    assert {r.id for r in metrics.split_questions(ids, seed=14).where("part = 'future'").collect()} != {k for k, v in first.items() if v == "future"}


def test_buckets(spark):
    asked = spark.createDataFrame([("a", "p1", 0), ("b", "p1", 1), ("c", "p2", 0), ("d", None, None)], "qid string, pid string, sent int")
    known = spark.createDataFrame([("p1", 0), ("p1", 2), (None, None)], "pid string, sent int")
    assert {r.qid: r.bucket for r in metrics.overlap_buckets(asked, known).collect()} == {"a": "covered", "b": "uncovered", "c": "uncovered", "d": "unmapped"}


def test_meaning_tier_does_not_chain(spark):
    from math import cos, sin

    items = spark.createDataFrame([(i, 0, [cos(t), sin(t)]) for i, t in enumerate((0.0, 0.5, 1.0))], "id long, grp int, v array<double>")
    pairs = entities.similar_pairs(items, 0.85)
    assert len({r.root for r in entities.meaning_tier(items, pairs, 0.85).collect()}) == 2


def test_constrained_merge_blocks(spark):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id long, kind string")
    proposals = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4)], "ord long, a long, b long")
    got = lambda no: {r.id: r.root for r in graph.constrained_merge(items, proposals, spark.createDataFrame(no, "a long, b long")).collect()}
    assert got([]) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert got([(1, 3)]) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pagerank_damps_hubs(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), *[(9, 100 + i, 1.0) for i in range(20)], (0, 9, 1.0)], "a long, b long, w double")
    score = {r.node: r.score for r in graph.pagerank(edges, spark.createDataFrame([(1, 0, 1.0)], "qid int, node long, x double")).collect()}
    assert score[0] > score[1] > score[2] > score[100]


def test_bootstrap_ratio_of_a_constant(spark):
    rows = spark.range(50).select("id", (F.col("id") + 1.0).alias("a"), ((F.col("id") + 1.0) / 4).alias("b"))
    got = metrics.bootstrap(rows, "a", "b", "ratio", n_boot=50).first()
    assert abs(got.low - 4) < 1e-9 and abs(got.high - 4) < 1e-9 and abs(got.value - 4) < 1e-9
