"""Indexing, retrieval, fusion, reranking and packing; rank is always a column, from 1."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessella.functions import text as X
from tessella.operators.blocks import nearest
from tessella.operators.corpus import units_key
from tessella.session import materialise, ship

K1, B = 1.5, 0.75


def best(frame: DataFrame, by: list[str], order: list[Column], depth: int) -> DataFrame:
    """Rows of rank 1 to depth of each group; Spark cuts each partition to depth before the shuffle."""
    return frame.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= depth)


#: Rows of terms that may be broadcast.
BROADCAST_TERMS = 200_000


def _broadcast_if_small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_TERMS else frame


def bm25(units: DataFrame, queries: DataFrame, depth: int = 100) -> DataFrame:
    """units (uidx, search_text), queries (qid, question) to (qid, rank, uidx, score), without a stored index.

    Query terms are few, so each unit is cut to them where it stands and scored there for
    every query, and only the best ``depth`` of a query leave a task. Where terms are many
    or units share a uidx or have none, postings are joined. A repeated query term counts once.
    """
    ship(units.sparkSession)
    counted = units.select("uidx", X.terms(F.col("search_text")).alias("words")).withColumn("dl", F.size("words"))
    asked = _asked(queries).limit(BROADCAST_TERMS + 1).toArrow()
    if asked.num_rows <= BROADCAST_TERMS:
        ids = {w: i for i, w in enumerate(sorted(set(asked.column("w").to_pylist())))}
        spark = units.sparkSession
        schema = T.StructType([units.schema["uidx"], T.StructField("dl", T.IntegerType()), T.StructField("w", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
        held = materialise(counted.mapInArrow(_cut(spark.sparkContext.broadcast(ids)), schema), "bm25-units")
        if not held.groupBy("uidx").count().where("count > 1 OR uidx IS NULL").head(1):
            stats = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
            df = {r.w: r.df for r in held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()}
            qids = asked.column("qid").to_pylist()
            names = list(dict.fromkeys(qids))
            place = {q: i for i, q in enumerate(names)}
            pairs = sorted((ids[w], place[q]) for q, w in zip(qids, asked.column("w").to_pylist()))
            shared = spark.sparkContext.broadcast((pa.array(names, asked.schema.field("qid").type), pairs, [df.get(i, 0) for i in range(len(ids))], stats.n, stats.avgdl))
            found = T.StructType([queries.schema["qid"], units.schema["uidx"], T.StructField("score", T.DoubleType())])
            return best(held.mapInArrow(_scored(shared, depth), found), ["qid"], [F.desc("score"), F.col("uidx")], depth).select("qid", "rank", "uidx", "score")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = materialise(_asked(queries).select("w").distinct(), "bm25-wanted")
    postings = counted.select("uidx", "dl", F.explode("words").alias("w")).join(_broadcast_if_small(wanted, wanted.count()), "w", "left_semi")
    return bm25_rank(materialise(postings.groupBy("uidx", "dl", "w").agg(F.count("*").alias("tf")), "bm25-postings"), stats, queries, depth)


def _cut(shared):
    """Units to (uidx, dl, w, tf): the numbers of the wanted words and how often they stand there."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        ids = shared.value
        for batch in batches:
            held = [Counter(i for w in words or () if (i := ids.get(w)) is not None) for words in batch.column("words").to_pylist()]
            w, tf = ([list(f(c)) for c in held] for f in (Counter.keys, Counter.values))
            yield pa.RecordBatch.from_arrays([batch.column("uidx"), batch.column("dl"), pa.array(w, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["uidx", "dl", "w", "tf"])

    return run


#: Scores, units times queries, that are held at once.
SCORES = 2_000_000


def _scored(shared, depth: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, pairs, df, n, avgdl = shared.value
        pairs, df = np.array(pairs, np.int64).reshape(-1, 2), np.array(df, float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        first = np.searchsorted(pairs[:, 0], np.arange(len(df) + 1))
        floor = np.zeros(len(names))
        kept, waiting = [], 0

        def closed():
            """The best of each query so far, which nothing below can enter."""
            q, u, x = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((u, -x, q))
            q, u, x = q[order], u[order], x[order]
            at = np.arange(len(q)) - np.searchsorted(q, q)
            last = at == depth - 1
            floor[q[last]] = x[last]
            return [(q[at < depth], u[at < depth], x[at < depth])]

        for whole in batches:
            step = max(1, SCORES // max(1, len(names)))
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                sizes = np.diff(batch.column("w").offsets.to_numpy())
                w, tf = (batch.column(c).flatten().to_numpy() for c in ("w", "tf"))
                if not len(w):
                    continue
                unit = np.repeat(np.arange(batch.num_rows), sizes)
                dl = batch.column("dl").to_numpy(zero_copy_only=False)[unit]
                x = idf[w] * tf / (tf + K1 * (1 - B + B * dl / avgdl))
                times = first[w + 1] - first[w]
                at = np.repeat(first[w] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                score = np.bincount(np.repeat(unit, times) * len(names) + pairs[at, 1], np.repeat(x, times), batch.num_rows * len(names)).reshape(-1, len(names))
                score = np.round(score, 6)
                u, q = np.nonzero((score > 0) & (score >= floor))
                kept.append((q, batch.column("uidx").to_numpy()[u], score[u, q]))
                waiting += len(q)
                if waiting > 4 * depth * len(names):
                    kept = closed()
                    waiting = len(kept[0][0])
        if kept:
            q, u, x = closed()[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(u), pa.array(x)], names=["qid", "uidx", "score"])

    return run


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(X.terms(F.col("question")))).alias("w"))


def bm25_rank(postings: DataFrame, stats: DataFrame, queries: DataFrame, depth: int = 100) -> DataFrame:
    """postings (uidx, dl, w, tf) and stats (n, avgdl) of an index to (qid, rank, uidx, score).

    Where the queries' terms are few, they and their frequencies are broadcast, so that a
    common term is no task of its own.
    """
    asked = materialise(_asked(queries), "bm25-asked")
    rows = asked.count()
    postings = postings.join(_broadcast_if_small(asked.select("w").distinct(), rows), "w", "left_semi")
    df = postings.groupBy("w").agg(F.count("*").alias("df"))
    weight = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # stats is one row.
    weighed = postings.join(_broadcast_if_small(df, rows), "w").crossJoin(F.broadcast(stats)).select("uidx", "w", weight.alias("x"))
    scored = weighed.join(_broadcast_if_small(asked, rows), "w").groupBy("qid", "uidx").agg(F.round(F.sum("x"), 6).alias("score")).where("score > 0")
    return best(scored, ["qid"], [F.desc("score"), F.col("uidx")], depth).select("qid", "rank", "uidx", "score")


def bm25_index(units: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of units (uidx, uid, search_text), stored below ``root`` under the content key of the units.

    An index that stands there is read; a half-written one has no marker and is written anew.
    """
    spark = units.sparkSession
    key = units_key(units).first()[0]
    paths = f"{root}/{key}/postings", f"{root}/{key}/stats"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{paths[1]}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        counted = units.select("uidx", X.terms(F.col("search_text")).alias("words")).withColumn("dl", F.size("words"))
        postings = counted.select("uidx", "dl", F.explode("words").alias("w")).groupBy("uidx", "dl", "w").agg(F.count("*").alias("tf"))
        postings.write.mode("overwrite").parquet(paths[0])
        # Last, as it marks the whole.
        counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(paths[1])
    return tuple(spark.read.parquet(p) for p in paths)


def dense(units: DataFrame, queries: DataFrame, depth: int = 10, *, not_own: bool = False) -> DataFrame:
    """units (uidx, v), queries (qid, q): the nearest units of each query by cosine (vectors are of unit length), exact."""
    scored = nearest(units, queries, depth, not_own=not_own)
    return best(scored, ["qid"], [F.desc("score"), F.col("uidx")], depth).select("qid", "rank", "uidx", "score")


def rrf(rankings: list[tuple[DataFrame, float]], depth: int = 100, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (qid, rank, uidx) with weights; ties to the smaller unit."""
    out = None
    for frame, weight in rankings:
        part = frame.select("qid", "uidx", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("x"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("qid", "uidx").agg(F.round(F.sum("x"), 9).alias("score"))
    return best(fused, ["qid"], [F.desc("score"), F.col("uidx")], depth).select("qid", "rank", "uidx", "score")


def question_prior(attached: DataFrame, queries: DataFrame, tau: float, depth: int = 100) -> DataFrame:
    """attached (uidx, v): past questions whose gold a unit covers; a unit scores its most similar past question, from tau."""
    scored = nearest(attached, queries, depth, tau).groupBy("qid", "uidx").agg(F.max("score").alias("score"))
    return best(scored, ["qid"], [F.desc("score"), F.col("uidx")], depth).select("qid", "rank", "uidx", "score")


def first_hits(ranked_keys: DataFrame, depth: int) -> DataFrame:
    """(qid, rank, target): order of the first key of each target."""
    return best(ranked_keys.groupBy("qid", "target").agg(F.min("rank").alias("first")), ["qid"], [F.col("first")], depth).select("qid", "rank", F.col("target").cast("long").alias("target"))


def rerank(ranked: DataFrame, units: DataFrame, queries: DataFrame, top: int = 20, scorer=X.overlap_score) -> DataFrame:
    """The first ``top`` by a cross-encoder (a column function of question and text; ties keep their order), then the rest as it was."""
    held = ranked.join(units.select("uidx", "search_text"), "uidx").join(queries.select("qid", "question"), "qid")
    score = F.when(F.col("rank") <= top, scorer(F.col("question"), F.col("search_text")))
    placed = held.select("qid", "uidx", F.col("rank").alias("old"), score.alias("score"))
    order = W.partitionBy("qid").orderBy(F.col("score").isNull(), F.desc("score"), "old")
    return placed.withColumn("rank", F.row_number().over(order)).select("qid", F.col("rank").cast("int").alias("rank"), "uidx", F.col("old").cast("int").alias("old_rank"))


def scoped(ranked: DataFrame, unit_docs: DataFrame, query_docs: DataFrame) -> DataFrame:
    """Ranked units of the question's own document, ranks closed up."""
    kept = ranked.join(unit_docs, "uidx").join(query_docs, ["qid", "doc"])
    return best(kept.withColumnRenamed("rank", "old"), ["qid"], [F.col("old")], 1 << 30).select("qid", "rank", "uidx")


def pack(ranked: DataFrame, budgets: list[int], separator: int = 1) -> DataFrame:
    """ranked (qid, rank, uidx, n_tok) to (qid, budget, uidx, rank, taken, truncated).

    Costs only grow along a ranking, so one running sum serves every budget: units that
    fit whole are taken, the first that does not is cut to what is left.
    """
    along = W.partitionBy("qid").orderBy("rank")
    sep = F.when(F.row_number().over(along) > 1, separator).otherwise(0)
    summed = ranked.withColumn("sep", sep).withColumn("cost", F.col("n_tok") + F.col("sep"))
    summed = summed.withColumn("used", F.sum("cost").over(along)).withColumn("before", F.col("used") - F.col("cost"))
    each = summed.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    fits = F.col("used") <= F.col("budget")
    left = F.col("budget") - F.col("before") - F.col("sep")
    first_over = (F.col("before") <= F.col("budget")) & ~fits
    return each.where(fits | (first_over & (left > 0))).select("qid", "budget", "rank", "uidx", F.when(fits, F.col("n_tok")).otherwise(left).cast("long").alias("taken"), (~fits).alias("truncated"))


def drop_overlaps(ranked: DataFrame) -> DataFrame:
    """ranked (qid, rank, uidx, pid, whole): of a paragraph and its pieces the kind ranked first stays."""
    lead = W.partitionBy("qid", "pid").orderBy("rank")
    return ranked.withColumn("lead", F.first("whole").over(lead)).where("whole = lead").drop("lead")


def kept_sentences(ranked: DataFrame, sentences: DataFrame, queries: DataFrame, least: float = 1, scorer=X.overlap_score) -> DataFrame:
    """A pruner: sentences of ranked paragraphs that a column function of question and text scores ``least`` at least, in order."""
    held = ranked.join(sentences.select("pid", "sent", "text"), "pid").join(queries, "qid")
    kept = held.where(scorer(F.col("question"), F.col("text")) >= least)
    return kept.groupBy("qid", "rank", "pid").agg(F.count("*").alias("n_kept"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent", "text"))), lambda s: s["text"]), " ").alias("kept"))
