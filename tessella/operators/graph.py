"""Concept graph: merging under vetoes, nodes, edges, and walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.functions import text as X
from tessella.operators.components import connected_components
from tessella.operators.numbering import number_rows
from tessella.session import discard, materialise


def concept_nodes(mentions: DataFrame, roots: DataFrame, most: int = 8) -> DataFrame:
    """(root, name, aliases, n_mentions): the most common text names a concept, the first on a tie."""
    texts = mentions.join(roots, "mid").groupBy("root", "text").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    ranked = texts.withColumn("r", F.row_number().over(W.partitionBy("root").orderBy(F.desc("n"), "first", "text")))
    return ranked.groupBy("root").agg(
        F.min_by("text", "r").alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "text")))), lambda x: x["text"]), "|").alias("aliases"), F.sum("n").alias("n_mentions"))


def constrained_merge(items: DataFrame, proposals: DataFrame, forbidden: DataFrame) -> DataFrame:
    """items (id, kind), proposals (ord, a, b), forbidden (a, b) to (id, root).

    Proposals are taken in order; one is blocked if a forbidden pair would meet in a
    cluster or the clusters' majority kinds differ (the first kind seen wins a tie).
    Each connected component of the proposals is replayed by itself, see the merges
    by meaning; forbidden pairs matter only within one component.
    """
    # Each is read more than once, and a similarity join is dear.
    proposals = materialise(proposals.select("ord", "a", "b"), "merge-proposals")
    components = materialise(connected_components(proposals.select("a", "b")), "merge-components")
    nodes = components.join(items, components["node"] == items["id"]).select("component", "id", "kind")
    mine = proposals.join(components, proposals["a"] == components["node"]).select(F.col("component").alias("part"), "ord", "a", "b", F.lit(False).alias("no"))
    other = components.select(F.col("node").alias("b"), F.col("component").alias("c2"))
    never = forbidden.join(components.withColumnRenamed("node", "a"), "a").join(other, "b").where("component = c2").select(F.col("component").alias("part"), F.lit(-1).cast("long").alias("ord"), "a", "b", F.lit(True).alias("no"))

    def replay(key, nodes, pairs):
        from collections import Counter

        import pandas as pd

        del key
        root = {i: i for i in sorted(nodes.id)}
        held = {i: [i] for i in root}
        kinds = {i: Counter([k]) for i, k in zip(nodes.id, nodes.kind)}
        no: dict = {}
        for a, b in pairs[pairs.no][["a", "b"]].itertuples(index=False):
            no.setdefault(a, set()).add(b)
            no.setdefault(b, set()).add(a)
        for r in pairs[~pairs.no].sort_values(["ord", "a", "b"]).itertuples():
            a, b = sorted((root[r.a], root[r.b]))
            if a == b or any(y in no.get(x, ()) for x in held[a] for y in held[b]) or kinds[a].most_common(1)[0][0] != kinds[b].most_common(1)[0][0]:
                continue
            for x in held.pop(b):
                root[x] = a
                held[a].append(x)
            kinds[a].update(kinds.pop(b))
        return pd.DataFrame({"id": list(root), "root": list(root.values())})

    merged = nodes.groupBy("component").cogroup(mine.unionByName(never).groupBy("part")).applyInPandas(replay, "id long, root long")
    return items.join(merged, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def string_key(item_kind: Column) -> Column:
    """What equal strings merge by: norm and group, and the article for one-word persons, organisations and things; fragments by norm."""
    narrow = item_kind.isin("person", "org", "thing") & ~F.contains(F.col("norm"), F.lit(" "))
    return F.concat_ws("\x00", "norm", item_kind, F.when(narrow, F.col("article")))


def build(mentions: DataFrame, fragments: DataFrame, units: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """The concept graph under vetoes: concepts, roots, edges and blocked.

    mentions (mid, pid, article, s, text, grp, norm), fragments of the same columns with
    grp 'fragment', units (uid, pid, s, e), verdicts (source, cos, a, b, label) over mids.
    Equal strings merge first (see ``string_key``; times only if dated, and no named group
    in which a pair was judged DIFFERENT), then pairs judged SAME, most similar first; no
    merge joins a pair judged RELATED or DIFFERENT, or two kinds of things. edges (type,
    a, b): a unit mentions concepts, is followed by the next unit, concepts are related.
    """
    columns = ["mid", "pid", "article", "s", "text", "grp", "norm"]
    items = number_rows(mentions.select(*columns).unionByName(fragments.select(*columns)), [(F.col("grp") == "fragment").cast("int"), F.col("mid")], "id")
    items = materialise(items.withColumn("key", string_key(F.col("grp"))), "graph-items")
    of = items.select(F.col("mid").alias("a"), F.col("id").alias("x"), F.col("key").alias("kx"), F.col("grp").alias("g"))
    judged = materialise(verdicts.where("label IS NOT NULL").join(of, "a").join(of.drop("g").withColumnsRenamed({"a": "b", "x": "y", "kx": "ky"}), "b").where("x <> y"), "graph-judged")
    vetoed = judged.where((F.col("source") == "exact") & (F.col("label") == "DIFFERENT") & F.col("g").isin(*X.NAMED_GROUPS)).select(F.explode(F.array("kx", "ky")).alias("key")).distinct()
    by_string = items.where((F.col("grp") == "fragment") | X.merges_by_string(F.col("text"), F.col("grp"))).join(vetoed, "key", "left_anti")
    strings = by_string.withColumn("first", F.min("id").over(W.partitionBy("key"))).where("first < id").select(F.col("id").alias("ord"), F.col("first").alias("a"), F.col("id").alias("b"))
    least = judged.where("label = 'SAME'").select((F.lit(1 << 40) - F.round(F.coalesce("cos", F.lit(1.0)) * 1_000_000)).cast("long").alias("ord"), F.col("x").alias("a"), F.col("y").alias("b"))
    proposals = materialise(strings.unionByName(least), "graph-proposals")
    never = judged.where("label <> 'SAME'").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = materialise(constrained_merge(items.select("id", F.col("grp").alias("kind")), proposals, never), "graph-roots")
    named = items.join(roots, "id")
    concepts = concept_nodes(items.select(F.col("id").alias("mid"), "text"), roots.withColumnRenamed("id", "mid")).join(named.where("id = root").select("root", F.col("grp").alias("kind")), "root")
    # A span can straddle a cut: its start decides, the last unit that begins before it.
    inside = named.select("id", "root", "pid", F.col("s").alias("at")).join(units.select("uid", "pid", "s", "e"), "pid").where("s <= at AND at < e")
    holds = inside.select(F.lit("mentions").alias("type"), F.col("uid").alias("a"), F.concat(F.lit("c"), "root").alias("b")).distinct()
    follow = adjacent(units).select(F.lit("adjacent").alias("type"), "a", "b")
    ends = roots.select(F.col("id").alias("x"), F.col("root").alias("cx"))
    related = judged.where("label = 'RELATED'").join(ends, "x").join(ends.withColumnsRenamed({"x": "y", "cx": "cy"}), "y").where("cx <> cy")
    related = related.select(F.lit("related").alias("type"), F.concat(F.lit("c"), F.least("cx", "cy")).alias("a"), F.concat(F.lit("c"), F.greatest("cx", "cy")).alias("b")).distinct()
    both = proposals.join(roots.withColumnsRenamed({"id": "a", "root": "ra"}), "a").join(roots.withColumnsRenamed({"id": "b", "root": "rb"}), "b")
    return {"items": items, "concepts": concepts, "roots": roots, "edges": materialise(holds.unionByName(follow).unionByName(related), "graph-edges"), "blocked": both.where("ra <> rb").select("a", "b"), "vetoed": vetoed}


def adjacent(units: DataFrame, within: str = "pid") -> DataFrame:
    """(a, b): consecutive units of each paragraph, or of each document."""
    order = W.partitionBy(within).orderBy(*dict.fromkeys(["pid", "s"]))
    return units.withColumn("b", F.lead("uid").over(order)).where("b IS NOT NULL").select(F.col("uid").alias("a"), "b")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def concept_weights(holds: DataFrame, most: int = 50) -> DataFrame:
    """holds (concept, uid, pid) to (concept, weight); concepts in more paragraphs than ``most`` are hubs and go."""
    return holds.groupBy("concept").agg(F.countDistinct("pid").alias("n")).where(F.col("n") <= most).select("concept", F.round(1 / F.ln(2 + F.col("n")), 6).alias("weight"))


def question_concepts(questions: DataFrame, aliases: DataFrame, most_words: int = 6) -> DataFrame:
    """(qid, concept): aliases (alias, concept) that stand in the normalised question as whole words."""
    words = F.split(X.normalize_concept(F.col("question")), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))))
    grams = questions.select("qid", words.alias("words")).select("qid", F.explode(F.array_distinct(spans)).alias("alias"))
    return grams.where(F.length("alias") > 1).join(aliases, "alias").select("qid", "concept").distinct()


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, rounds: int = 30, every: int = 5) -> DataFrame:
    """edges (a, b, w), undirected; seeds (qid, node, x) to (qid, node, score) of personalised PageRank.

    Each round is a join on the edges and a sum; the lineage is cut every few rounds.
    """
    edges = materialise(edges, "pagerank-edges")
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    step = materialise(both.join(both.groupBy("a").agg(F.sum("w").alias("d")), "a").select("a", "b", (F.col("w") / F.col("d")).alias("p")), "pagerank-step")
    start = seeds.groupBy("qid").agg(F.sum("x").alias("t")).join(seeds, "qid").select("qid", "node", (F.col("x") / F.col("t")).alias("x"))
    start = materialise(start, "pagerank-start")
    now, held = start, None
    for i in range(1, rounds + 1):
        moved = now.join(step, now["node"] == step["a"]).select("qid", F.col("b").alias("node"), (F.col("x") * F.col("p") * (1 - alpha)).alias("x"))
        now = moved.unionByName(start.select("qid", "node", (F.col("x") * alpha).alias("x"))).groupBy("qid", "node").agg(F.sum("x").alias("x"))
        if i % every == 0 and i < rounds:
            now, before = materialise(now, "pagerank"), held
            held = now
            if before is not None:
                discard(before)
    return now.select("qid", "node", F.round("x", 8).alias("score"))


def second_hop(holds: DataFrame, weights: DataFrame, seeds: DataFrame, n: int = 20) -> DataFrame:
    """seeds (qid, uid) to (qid, seed, uid, weight, rank): units that share concepts with a seed, outside all seeds' paragraphs."""
    placed = holds.join(weights, "concept")
    asked = seeds.join(holds.select("uid", "concept", "pid"), "uid").select("qid", F.col("uid").alias("seed"), "concept").distinct()
    closed = seeds.join(holds.select("uid", "pid").distinct(), "uid").select("qid", "pid").distinct()
    reached = asked.join(placed, "concept").join(closed, ["qid", "pid"], "left_anti").groupBy("qid", "seed", "uid").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return reached.withColumn("rank", F.row_number().over(W.partitionBy("qid", "seed").orderBy(F.desc("weight"), "uid"))).where(F.col("rank") <= n)


#: Rows of ids that may be broadcast.
BROADCAST_IDS = 200_000


def _few(ids: DataFrame) -> DataFrame:
    """Rows that grow with the questions alone, written and broadcast if they are few, so that what meets them stays where it stands."""
    ids = materialise(ids, "beam-ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def beam(
    units: DataFrame, ranked: DataFrame, questions: DataFrame, holds: DataFrame | None = None, *, width: int = 3, depth: int = 2, candidates: int = 10, least: float = 0.0,
    most_paragraphs: int = 50, across: str | None = None, path_chars: int = 1200, stop: str = "fixed", top: int = 30, scorer=X.overlap_score,
) -> tuple[DataFrame, DataFrame]:
    """Beam search over paths of units: (paths, steps).

    units (uidx, pid, s, text, search_text), ranked (qid, rank, uidx), questions (qid,
    question), holds (concept, uidx). A path starts at one of the ``width`` best of the
    first ``top`` units as reranked by ``scorer`` (ties: the greater uidx). A step goes to
    the unit before or after the last one in its paragraph (in its ``across`` column's
    document, if given), or to one of the ``candidates`` units of other paragraphs that
    share the heaviest concepts with it; units are scored against the question and the
    last ``path_chars`` characters of the path. Of a path the ``width`` best steps stay
    that reach the floor: ``least``, or with stop="flat" the best reranked unit that is
    in no path. A path without any is done. Then the ``width`` best paths stay.

    paths (qid, pos, path, score, done), steps (qid, round, kind): the steps taken in each round.
    """
    order = W.partitionBy(across or "pid").orderBy(*dict.fromkeys(["pid", "s"]))
    after = units.withColumn("b", F.lead("uidx").over(order)).where("b IS NOT NULL").select(F.col("uidx").alias("a"), "b")
    moves = materialise(after.unionByName(after.select(F.col("b").alias("a"), F.col("a").alias("b"))), "beam-moves")
    texts = units.select("uidx", "pid", "text", "search_text")
    reranked = rerank_scores(ranked.where(F.col("rank") <= top), units, questions, scorer)
    first = materialise(reranked.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.desc("uidx")))), "beam-first")
    state = first.where(F.col("pos") <= width).join(texts, "uidx").join(questions, "qid").select(
        "qid", "question", "pos", F.array("uidx").alias("path"), F.array("pid").alias("pids"), F.col("text").alias("said"), "score", F.lit(False).alias("done"), F.lit(None).cast("string").alias("kind"))
    if holds is not None:
        placed = holds.join(units.select("uidx", "pid"), "uidx").select("concept", "uidx", "pid").distinct()
        placed = materialise(placed.join(concept_weights(placed, most_paragraphs), "concept"), "beam-holds")
    steps = None
    for i in range(1, depth + 1):
        state = materialise(state, "beam")
        open_ = _few(state.where("NOT done").select("qid", "pos", "pids", F.element_at("path", -1).alias("last")))
        found = open_.join(moves, F.col("last") == moves["a"]).select("qid", "pos", F.col("b").alias("u"), F.lit("adjacent").alias("kind"))
        if holds is not None:
            mine = _few(open_.join(placed.select(F.col("uidx").alias("last"), "concept"), "last").select("qid", "pos", "pids", "concept"))
            reached = mine.join(placed, "concept").where(~F.array_contains("pids", F.col("pid"))).groupBy("qid", "pos", F.col("uidx").alias("u")).agg(F.round(F.sum("weight"), 6).alias("weight"))
            heavy = reached.withColumn("k", F.row_number().over(W.partitionBy("qid", "pos").orderBy(F.desc("weight"), "u"))).where(F.col("k") <= candidates)
            found = found.unionByName(heavy.select("qid", "pos", "u", F.lit("concept").alias("kind"))).groupBy("qid", "pos", "u").agg(F.max("kind").alias("kind"))
        # A few paths a question: their steps go to the texts, no text is shuffled that no step reaches.
        found = _few(found)
        reachable = materialise(texts.withColumnRenamed("uidx", "u").join(_few(found.select("u").distinct()), "u", "left_semi"), "beam-texts")
        near = found.join(state.drop("kind"), ["qid", "pos"]).where(~F.array_contains("path", F.col("u"))).join(reachable, "u")
        gain = scorer(F.concat_ws(" ", "question", F.right("said", F.lit(path_chars))), F.col("search_text")).cast("double")
        scored = near.withColumn("gain", gain).withColumn("r", F.row_number().over(W.partitionBy("qid", "pos").orderBy(F.desc("gain"), F.desc("u"), F.desc("kind")))).where(F.col("r") <= width)
        if stop == "flat":
            taken = state.select("qid", F.explode("path").alias("uidx")).distinct()
            floors = first.join(taken, ["qid", "uidx"], "left_anti").groupBy("qid").agg(F.max("score").alias("floor"))
            scored = scored.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        else:
            scored = scored.withColumn("floor", F.lit(float(least)))
        scored = materialise(scored, "beam-steps")
        grown = scored.where("gain >= floor").select(
            "qid", "question", "pos", "r", F.lit(1).alias("late"), F.concat("path", F.array("u")).alias("path"), F.concat("pids", F.array("pid")).alias("pids"), F.concat_ws(" ", "said", "text").alias("said"),
            (F.col("score") + F.col("gain")).alias("score"), F.lit(False).alias("done"), "kind")
        tried = scored.groupBy("qid", "pos").agg(F.max((F.col("gain") >= F.col("floor")).cast("int")).alias("went"))
        ended = state.drop("kind").join(tried, ["qid", "pos"], "left").where("went IS NULL OR went = 0").select(
            "qid", "question", "pos", F.lit(0).alias("r"), F.when(F.col("went").isNull(), 0).otherwise(1).alias("late"), "path", "pids", "said", "score", F.lit(True).alias("done"), F.lit(None).cast("string").alias("kind"))
        best = W.partitionBy("qid").orderBy(F.desc("score"), "late", "pos", "r")
        state = materialise(grown.unionByName(ended).withColumn("pos2", F.row_number().over(best)).where(F.col("pos2") <= width).drop("r", "late", "pos").withColumnRenamed("pos2", "pos"), "beam")
        taken = state.where("kind IS NOT NULL").select("qid", F.lit(i).alias("round"), "kind")
        steps = taken if steps is None else steps.unionByName(taken)
    return state.select("qid", "pos", "path", "score", "done"), steps


def rerank_scores(ranked: DataFrame, units: DataFrame, questions: DataFrame, scorer=X.overlap_score) -> DataFrame:
    """(qid, uidx, rank, score): ranked units as scored against the question."""
    held = ranked.join(units.select("uidx", "search_text"), "uidx").join(questions.select("qid", "question"), "qid")
    return held.select("qid", "uidx", "rank", scorer(F.col("question"), F.col("search_text")).cast("double").alias("score"))


def along_paths(paths: DataFrame, ranked: DataFrame, units: DataFrame, questions: DataFrame, top: int = 30, depth: int = 100, scorer=X.overlap_score) -> DataFrame:
    """(qid, rank, uidx): units of the paths, best path first and each in its own order, then the reranked units, then the rest."""
    on_paths = paths.select("qid", F.lit(0).alias("part"), "pos", F.posexplode("path").alias("i", "uidx"))
    first = rerank_scores(ranked.where(F.col("rank") <= top), units, questions, scorer)
    first = first.select("qid", F.lit(1).alias("part"), F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.desc("uidx"))).alias("pos"), F.lit(0).alias("i"), "uidx")
    rest = ranked.select("qid", F.lit(2).alias("part"), F.col("rank").cast("int").alias("pos"), F.lit(0).alias("i"), "uidx")
    once = on_paths.unionByName(first).unionByName(rest).groupBy("qid", "uidx").agg(F.min(F.struct("part", "pos", "i")).alias("at"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("at"))).where(F.col("rank") <= depth).select("qid", "rank", "uidx")
