"""Entity resolution: mentions, merge tiers, candidate pairs and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.functions import text as X
from tessella.operators.blocks import nearest
from tessella.operators.components import connected_components
from tessella.session import materialise

#: The default mention finder, a pattern for each entity label: capitalised runs of two words at least, short capitals, numbers.
PATTERNS = {"PERSON": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+", "ORG": r"[A-Z]{2,6}", "CARDINAL": r"[0-9]{2,}"}


def mentions(paragraphs: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(mid, pid, article, s, e, text, grp, norm): every occurrence, ids in text order within a paragraph.

    A match begins where the gaps and matches before it end.
    """
    each = None
    for label, pattern in patterns.items():
        found = F.arrays_zip(F.transform(F.split("context", pattern), F.length).alias("gap"), F.regexp_extract_all("context", F.lit(pattern), F.lit(0)).alias("text"))
        part = paragraphs.select("pid", F.col("title").alias("article"), F.lit(label).alias("label"), F.posexplode(found).alias("i", "m")).select("pid", "article", "label", "i", "m.gap", "m.text")
        each = part if each is None else each.unionByName(part)
    before = W.partitionBy("pid", "label").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    placed = each.withColumn("s", (F.coalesce(F.sum(F.col("gap") + F.length("text")).over(before), F.lit(0)) + F.col("gap")).cast("int")).where("text IS NOT NULL")
    groups = F.create_map(*[F.lit(x) for label in patterns for x in (label, X.LABEL_GROUPS[label])])
    named = placed.select("pid", "article", "s", (F.col("s") + F.length("text")).alias("e"), "text", F.element_at(groups, F.col("label")).alias("grp"), X.normalize_concept(F.col("text")).alias("norm")).where("norm <> ''")
    return with_ids(named)


def with_ids(named: DataFrame) -> DataFrame:
    """mid: paragraph and number in text order, in digits that sort."""
    return named.withColumn("mid", F.format_string("%012d:%06d", "pid", F.row_number().over(W.partitionBy("pid").orderBy("s", "e", "grp"))))


def exact_tier(mentions_: DataFrame) -> DataFrame:
    """(mid, root): the first mention of the same norm and group."""
    return mentions_.join(mentions_.groupBy("norm", "grp").agg(F.min("mid").alias("root")), ["norm", "grp"]).select("mid", "root")


def alias_tier(mentions_: DataFrame) -> DataFrame:
    """(short, long, rule): within an article, an acronym or a short form that exactly one longer form answers to.

    Longer forms are the norms of several words, each known by its first mention. An
    upper-case text of 2 to 6 characters asks for its acronym in any group; another
    single word for a form of its own named group that ends with it, or in a person's
    name begins with it.
    """
    words = F.split("norm", " ")
    longs = mentions_.where(F.size(words) > 1).groupBy("article", "norm").agg(F.min(F.struct("mid", "text", "grp")).alias("m")).select("article", "norm", "m.*")
    upper = (F.col("text") == F.upper("text")) & (F.col("text") != F.lower("text"))
    acronym = upper & F.length("text").between(2, 6)
    asks = mentions_.where((F.size(words) == 1) | upper).groupBy("article", "grp", "text", "norm").agg(F.min("mid").alias("short"))
    by_acronym = asks.where(acronym).select("article", "short", F.col("text").alias("key"))
    acronyms = longs.select("article", F.col("mid").alias("long"), X.acronym(F.col("text")).alias("key"))
    by_word = asks.where(~acronym & F.col("grp").isin(*X.NAMED_GROUPS)).select("article", "grp", "short", F.col("norm").alias("key"))
    keys = F.array_distinct(F.array(F.element_at(words, -1), F.when(F.col("grp") == "person", F.element_at(words, 1)).otherwise(F.element_at(words, -1))))
    worded = longs.select("article", "grp", F.col("mid").alias("long"), F.explode(keys).alias("key"))
    found = by_acronym.join(acronyms, ["article", "key"]).select("short", "long", F.lit("acronym").alias("rule")).unionByName(
        by_word.join(worded, ["article", "grp", "key"]).select("short", "long", F.lit("short form").alias("rule")))
    return found.groupBy("short").agg(F.count("*").alias("n"), F.min("long").alias("long"), F.min("rule").alias("rule")).where("n = 1 AND short <> long").drop("n")


def alias_candidates(mentions_: DataFrame) -> DataFrame:
    """(short, long): pairs to be judged: acronyms, and single words that begin or end a longer form of their group, in an article, unique or not."""
    words = F.split("norm", " ")
    upper = (F.col("text") == F.upper("text")) & (F.col("text") != F.lower("text"))
    first = lambda frame: frame.groupBy("article", "norm").agg(F.min(F.struct("mid", "text", "grp")).alias("m")).select("article", "norm", "m.*")
    longs, asks = first(mentions_.where(F.size(words) > 1)), first(mentions_.where((F.size(words) == 1) | upper))
    acronyms = longs.select("article", F.col("mid").alias("long"), X.acronym(F.col("text")).alias("key"))
    by_acronym = asks.where(upper & F.length("text").between(2, 6)).select("article", F.col("mid").alias("short"), F.col("text").alias("key")).join(acronyms, ["article", "key"])
    worded = longs.select("article", "grp", F.col("mid").alias("long"), F.explode(F.array_distinct(F.array(F.element_at(words, 1), F.element_at(words, -1)))).alias("key"))
    by_word = asks.select("article", "grp", F.col("mid").alias("short"), F.col("norm").alias("key")).join(worded, ["article", "grp", "key"])
    return by_acronym.select("short", "long").unionByName(by_word.select("short", "long")).distinct()


def contexts(mentions_: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(mid, around): the sentence of a mention, or 150 characters on either side of one in none."""
    # A paragraph meets all its mentions at once, and is cut into sentences once.
    asked = mentions_.groupBy("pid").agg(F.collect_list(F.struct("mid", "s", "e")).alias("asked"))
    held = asked.join(paragraphs.select("pid", "context"), "pid")

    def around(m: Column, spans: Column) -> Column:
        begin = F.greatest(m["s"] - 150, F.lit(0))
        said = F.get(F.filter(spans, lambda x: x["e"] > m["s"]), F.lit(0))["text"]
        return F.struct(m["mid"].alias("mid"), F.coalesce(said, F.substring(F.col("context"), begin + 1, m["e"] + 150 - begin)).alias("around"))

    each = F.transform(F.array(X.sentence_texts(F.col("context"))), lambda spans: F.transform("asked", lambda m: around(m, spans)))[0]
    return held.select(F.explode(each).alias("x")).select("x.mid", "x.around")


def candidates(mentions_: DataFrame, paragraphs: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """(source, grp, cos, a, b, a_around, b_around): every pair to be judged, with both contexts; vectors (id, grp, v, mid) of nodes, each with a mention."""
    at = mentions_.select("mid", "grp")
    exact = exact_candidates(mentions_).select(F.lit("exact").alias("source"), "grp", F.lit(1.0).alias("cos"), "a", "b")
    alias = alias_candidates(mentions_).join(at.withColumnRenamed("mid", "short"), "short").select(F.lit("alias").alias("source"), "grp", F.lit(None).cast("double").alias("cos"), F.col("long").alias("a"), F.col("short").alias("b"))
    of = vectors.select("id", "mid", F.col("grp").alias("g"))
    near = similar_pairs(vectors.select("id", "grp", "v"), floor).join(of.withColumnsRenamed({"id": "i", "mid": "a"}), "i").join(of.drop("g").withColumnsRenamed({"id": "j", "mid": "b"}), "j")
    pairs = exact.unionByName(alias).unionByName(near.select(F.lit("embed").alias("source"), F.col("g").cast("string").alias("grp"), "cos", "a", "b"))
    said = materialise(contexts(mentions_, paragraphs), "contexts")
    return pairs.join(said.withColumnsRenamed({"mid": "a", "around": "a_around"}), "a").join(said.withColumnsRenamed({"mid": "b", "around": "b_around"}), "b").select("source", "grp", "cos", "a", "b", "a_around", "b_around")


def band(source: Column, cos: Column) -> Column:
    """Stratum of a candidate: its source, and for similar ones a step of 0.05 of its similarity from 0.8 on."""
    step = F.least(F.floor((cos - 0.8) / 0.05), F.lit(3)).cast("int").cast("string")
    return F.when(cos.isNull() | (source == "exact"), source).otherwise(F.concat_ws(":", source, step))


def similar_pairs(items: DataFrame, tau: float, top: int = 10) -> DataFrame:
    """items (id, grp, v) to (i, j, cos): of each item's ``top`` nearest at cosine >= tau, those with a greater id and of its group."""
    near = nearest(items.select(F.col("id").alias("uidx"), "v"), items.select(F.col("id").alias("qid"), F.col("v").alias("q")), top, tau, not_own=True)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "uidx"))).where(F.col("rank") <= top)
    groups = items.select(F.col("id").alias("i"), F.col("grp").alias("g"))
    near = near.select(F.col("qid").alias("i"), F.col("uidx").alias("j"), F.col("score").alias("cos")).where("i < j")
    return near.join(groups, "i").join(groups.withColumnsRenamed({"i": "j", "g": "h"}), "j").where("g = h").select("i", "j", "cos")


def guarded(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (i, j, cos) whose texts (id, text) hold equal numbers and are both negated or both not."""
    facts = items.select(F.col("id").alias("i"), X.numbers(F.col("text")).alias("n"), X.negated(F.col("text")).alias("no"))
    other = facts.withColumnsRenamed({"i": "j", "n": "n2", "no": "no2"})
    return pairs.join(facts, "i").join(other, "j").where("n = n2 AND no = no2").select("i", "j", "cos")


def meaning_tier(items: DataFrame, pairs: DataFrame, tau: float) -> DataFrame:
    """(id, root): greedy merges in order of similarity while the centroids of both clusters stay at tau.

    items (id, v), and text where numbers and negation of a pair must agree. A merge looks
    at its two clusters only, and clusters grow along pairs only, so each connected
    component of the pairs is replayed by itself with the same result: a task holds the
    vectors of one component, and merges the smaller cluster into the larger.
    """
    if "text" in items.columns:
        pairs = guarded(pairs, items)
    pairs = materialise(pairs, "meaning-pairs")
    components = connected_components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    members = components.join(items.select(F.col("id").alias("node"), "v"), "node")
    proposals = pairs.join(components, pairs["i"] == components["node"]).select(F.col("component").alias("part"), "i", "j", "cos")

    def replay(key, nodes, proposed):
        import numpy as np
        import pandas as pd

        del key
        held = {n: [n] for n in nodes.node}
        of = {n: n for n in nodes.node}
        total = {n: np.asarray(v, float) for n, v in zip(nodes.node, nodes.v)}
        for r in proposed.sort_values(["cos", "i", "j"], ascending=False).itertuples():
            a, b = of[r.i], of[r.j]
            if a == b:
                continue
            # Directions of sums are directions of means.
            x, y = total[a], total[b]
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= tau:
                if len(held[a]) < len(held[b]):
                    a, b = b, a
                for n in held[b]:
                    of[n] = a
                held[a] += held.pop(b)
                total[a] = total[a] + total.pop(b)
        least = {a: min(ns) for a, ns in held.items()}
        return pd.DataFrame({"id": list(of), "root": [least[a] for a in of.values()]})

    return members.groupBy("component").cogroup(proposals.groupBy("part")).applyInPandas(replay, "id long, root long")


def exact_candidates(mentions_: DataFrame, most: int = 3) -> DataFrame:
    """(norm, grp, a, b): at most ``most`` pairs of paragraphs a group, those of the lowest digest.

    Only the ``most + 1`` mentions of lowest digest of each group are paired, so a large group stays cheap.
    """
    firsts = mentions_.groupBy("norm", "grp", "pid").agg(F.min("mid").alias("mid"))
    few = firsts.withColumn("r", F.row_number().over(W.partitionBy("norm", "grp").orderBy(F.md5("mid"), "mid"))).where(F.col("r") <= most + 1)
    a, b = few.select("norm", "grp", F.col("mid").alias("a")), few.select("norm", "grp", F.col("mid").alias("b"))
    pairs = a.join(b, ["norm", "grp"]).where("a < b")
    order = W.partitionBy("norm", "grp").orderBy(F.md5(F.concat("a", F.lit("|"), "b")), "a", "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("norm", "grp", "a", "b")


def stratified_sample(rows: DataFrame, stratum: list[str], n: int) -> DataFrame:
    """max(1, n // strata) rows of each stratum, lowest digest of the id first."""
    strata = max(1, rows.select(*stratum).distinct().count())
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*stratum).orderBy(F.md5(F.col("id").cast("string")), "id"))).where(F.col("rank") <= max(1, n // strata)).drop("rank")


def verdict_scores(rows: DataFrame, labels: tuple[str, ...] = ("SAME", "RELATED", "DIFFERENT")) -> DataFrame:
    """rows (pred, gold) to one row a label: precision, recall (null when undefined), and accuracy over all."""
    sums = rows.agg(F.avg((F.col("pred") == F.col("gold")).cast("int")).alias("accuracy"), F.count_if(F.col("pred").isNull()).alias("unparsed"),
                    *[x for i, label in enumerate(labels) for x in (
                        F.count_if((F.col("pred") == label) & (F.col("gold") == label)).alias(f"tp{i}"), F.count_if(F.col("pred") == label).alias(f"p{i}"), F.count_if(F.col("gold") == label).alias(f"g{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"p{i}").alias("p"), F.col(f"g{i}").alias("g")) for i, label in enumerate(labels)]))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return sums.select(F.round("accuracy", 6).alias("accuracy"), "unparsed", each.alias("x")).select("x.label", "accuracy", "unparsed", ratio("x.tp", "x.p").alias("precision"), ratio("x.tp", "x.g").alias("recall"))
