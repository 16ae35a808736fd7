"""Splits, answer metrics, summaries and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import text as X
from tessella.operators.numbering import number_rows


def hash_order(ids: DataFrame, seed: int, tag: str) -> DataFrame:
    """(id, place): a shuffle that any engine repeats, by digest of seed, tag and id."""
    h = F.md5(F.concat(F.lit(f"{seed}|{tag}|"), F.col("id").cast("string")))
    return number_rows(ids.select("id", h.alias("h")).distinct(), [F.col("h"), F.col("id")], "place").select("id", "place")


def split_questions(ids: DataFrame, past: float = 0.7, tuning: float = 0.1, pilot: int = 200, seed: int = 13) -> DataFrame:
    """(id, part, is_pilot): future, or of the past tuning and build; the pilot is of the future."""
    ordered = hash_order(ids, seed, "past")
    n_past = int(ordered.agg(F.bround(F.count("*") * past).cast("long")).first()[0])
    olds = hash_order(ordered.where(F.col("place") < n_past), seed, "tuning")
    n_tuning = int(olds.agg(F.bround(F.count("*") * tuning).cast("long")).first()[0])
    news = hash_order(ordered.where(F.col("place") >= n_past), seed, "pilot")
    return olds.select("id", F.when(F.col("place") < n_tuning, "tuning").otherwise("build").alias("part"), F.lit(False).alias("is_pilot")).unionByName(
        news.select("id", F.lit("future").alias("part"), (F.col("place") < pilot).alias("is_pilot")))


def reference_questions(split: DataFrame, questions: str) -> DataFrame:
    """split (id, part) to the past ids that may shape units and priors: the build part while the tuning part is asked, all past ones otherwise; never future ones."""
    return split.where(F.col("part").isin(*(("build",) if questions == "tuning" else ("build", "tuning")))).select("id")


def overlap_buckets(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (qid, pid, sent), known (pid, sent): covered, uncovered, or unmapped without gold."""
    seen = known.distinct().withColumn("hit", F.lit(True))
    return asked.join(seen, ["pid", "sent"], "left").select("qid", F.when(F.col("sent").isNull(), "unmapped").when(F.col("hit"), "covered").otherwise("uncovered").alias("bucket"))


def token_f1(prediction: Column, truth: Column) -> Column:
    """Overlap of normalised tokens, counted with repeats."""
    p, t = X.tokens(X.normalize_answer(prediction)), X.tokens(X.normalize_answer(truth))
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    same = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(times(p, w), times(t, w)))
    return F.when((F.size(p) == 0) | (F.size(t) == 0), (F.size(p) == F.size(t)).cast("double")).otherwise(2.0 * same / (F.size(p) + F.size(t)))


def exact_match(prediction: Column, truth: Column) -> Column:
    return (X.normalize_answer(prediction) == X.normalize_answer(truth)).cast("double")


def answer_located(parts: DataFrame, golds: DataFrame) -> DataFrame:
    """parts (key, pid, pos, text), golds (key, pid, gold): does the gold paragraph's packed text hold the normalised answer?"""
    said = parts.groupBy("key", "pid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), " ").alias("said"))
    held = golds.join(said, ["key", "pid"], "left")
    gold = X.normalize_answer(F.col("gold"))
    return held.groupBy("key").agg(F.max(F.coalesce((gold != "") & F.contains(X.normalize_answer(F.col("said")), gold), F.lit(False))).alias("located"))


def summarize(rows: DataFrame, by: list[str], bucket: str, value: str) -> DataFrame:
    """Mean, median and 95th percentile by ``by``, for each bucket and for all together."""
    sets = rows.groupingSets([[*[F.col(c) for c in by]], [*[F.col(c) for c in by], F.col(bucket)]], *[F.col(c) for c in by], F.col(bucket))
    out = sets.agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 4).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 4).alias("p95"), F.grouping(bucket).alias("g"))
    return out.select(*by, F.when(F.col("g") == 1, "all").otherwise(F.col(bucket).cast("string")).alias("bucket"), "n", "mean", "p50", "p95")


#: Cumulative Poisson(1) probabilities.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
#: Rows and resamples whose weights are drawn at once.
DRAWS = (250, 500)


def bootstrap(rows: DataFrame, a: str, b: str, statistic: str = "difference", n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """95 % interval of mean(a) - mean(b), or of mean(a) / mean(b), over resamples by Poisson weights.

    A row's weight in a resample comes from a digest of its id and the resample, so
    resampling is a map and a sum, and the result does not depend on partitions. As a row
    takes a weight for each resample, rows are dealt out evenly first, by their digest. A
    task sums its rows' weights as matrix products and returns a row for each resample.
    Rows without both values take no part.
    """
    source = rows.select(F.xxhash64(F.lit(seed), F.col("id")).alias("h"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        first, second = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

        def mixed(h):
            h = (h ^ (h >> np.uint64(30))) * first
            h = (h ^ (h >> np.uint64(27))) * second
            return h ^ (h >> np.uint64(31))

        def begun(h):
            return h ^ (h >> np.uint64(30))

        boots = begun(mixed(np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        # A draw's upper 16 bits say its weight, but where a bound falls among the draws that share them.
        edges = np.arange((1 << 16) + 1) / (1 << 16)
        low, high = np.searchsorted(POISSON, edges[:-1], side="right"), np.searchsorted(POISSON, edges[1:], side="left")
        weights = np.where(low == high, low, -1.0)
        total = np.zeros((3, n_boot))
        draw, moved, drawn = (np.empty(DRAWS[0] * DRAWS[1], kind) for kind in (np.uint64, np.uint64, float))

        def add(h, x, i):
            """Draws of some rows for some resamples: what is mixed keeps to the processor's cache, and its last step moves no upper bit."""
            some = boots[i : i + DRAWS[1]]
            d, m, w = (space[: len(h) * len(some)].reshape(len(h), len(some)) for space in (draw, moved, drawn))
            np.bitwise_xor(h[:, None], some, out=d)
            np.multiply(d, first, out=d)
            np.right_shift(d, np.uint64(27), out=m)
            np.bitwise_xor(d, m, out=d)
            np.multiply(d, second, out=d)
            np.right_shift(d, np.uint64(48), out=m)
            np.take(weights, m.view(np.int64), out=w, mode="clip")
            unsure = np.flatnonzero(w.reshape(-1) < 0)
            last = d.reshape(-1)[unsure]
            w.reshape(-1)[unsure] = np.searchsorted(POISSON, ((last ^ (last >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53, side="right")
            total[:, i : i + DRAWS[1]] += x @ w

        for batch in batches:
            h = begun(batch.column("h").to_numpy().view(np.uint64))
            x = np.stack([batch.column("x").to_numpy(), batch.column("y").to_numpy(), np.ones(batch.num_rows)])
            for i in range(0, n_boot, DRAWS[1]):
                for a in range(0, len(h), DRAWS[0]):
                    add(h[a : a + DRAWS[0]], x[:, a : a + DRAWS[0]], i)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), *map(pa.array, total)], names=["boot", "x", "y", "w"])

    dealt = source.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "h")
    sums = dealt.mapInArrow(run, "boot long, x double, y double, w double").groupBy("boot").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("w").alias("w"))
    value = (F.col("x") - F.col("y")) / F.nullif(F.col("w"), F.lit(0.0)) if statistic == "difference" else F.col("x") / F.nullif(F.col("y"), F.lit(0.0))
    whole = source.agg((F.avg("x") - F.avg("y") if statistic == "difference" else F.avg("x") / F.nullif(F.avg("y"), F.lit(0.0))).alias("value"))
    return sums.agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high")).crossJoin(whole)


def hop_coverage(ranks: DataFrame) -> DataFrame:
    """ranks (qid, type, hop, rank or null): was the first hop in the top 3, were both in the top 10, 30, 100."""
    each = ranks.groupBy("qid", "type").agg(F.max(F.when(F.col("hop") == 1, F.coalesce(F.col("rank") <= 3, F.lit(False)))).alias("first3"), F.max(F.coalesce("rank", F.lit(1 << 30))).alias("worst"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return each.groupBy("type").agg(F.count("*").alias("n"), share(F.col("first3")).alias("first_hop_top3"), *[share(F.col("worst") <= k).alias(f"both_top{k}") for k in (10, 30, 100)])
