"""Retrieval units: paragraphs, sentences, pieces, segments, cracked tiles and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.functions import text as X

ALNUM = r"[\p{L}\p{N}]"


def paragraph_units(paragraphs: DataFrame) -> DataFrame:
    """One unit a paragraph, from sentence 0 to its last (-1 without sentences)."""
    return paragraphs.select(F.col("pid").cast("string").alias("uid"), F.lit("paragraph").alias("kind"), "pid", F.lit(0).alias("sent_lo"),
                             (F.size(X.sentences(F.col("context"))) - 1).alias("sent_hi"), F.concat(X.title_prefix(F.col("title")), F.col("context")).alias("text"))


def sentence_units(sentences: DataFrame, kind: str = "sentence") -> DataFrame:
    return sentences.select(F.concat("pid", F.lit("s"), F.format_string("%02d", "sent")).alias("uid"), F.lit(kind).alias("kind"), "pid",
                            F.col("sent").alias("sent_lo"), F.col("sent").alias("sent_hi"), F.concat(X.title_prefix(F.col("title")), F.col("text")).alias("text"))


def piece_units(sentences: DataFrame, keys: DataFrame) -> DataFrame:
    """Sentence units of the key sentences (pid, sent)."""
    return sentence_units(sentences.join(keys, ["pid", "sent"], "left_semi"), "piece")


def piece_keys(gold: DataFrame, k: int) -> DataFrame:
    """(pid, sent, n): sentences that at least k questions have as gold."""
    return gold.groupBy("pid", "sent").agg(F.count("*").alias("n")).where(F.col("n") >= k)


def split_units(paragraphs: DataFrame, sentences: DataFrame, keys: DataFrame) -> DataFrame:
    """Key sentences are pieces, each run between them a segment; paragraphs without keys stay whole."""
    touched = keys.select("pid").distinct()
    marked = sentences.join(touched, "pid", "left_semi").join(keys.select("pid", "sent", F.lit(1).alias("cut")), ["pid", "sent"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    along = W.partitionBy("pid").orderBy("sent")
    runs = marked.withColumn("run", F.sum("cut").over(along)).groupBy("pid", "title", "run", "cut").agg(
        F.min("sent").alias("sent_lo"), F.max("sent").alias("sent_hi"), F.min("s").alias("s"), F.max("e").alias("e"))
    text = F.concat(X.title_prefix(F.col("title")), X.span_text(F.col("context"), F.col("s"), F.col("e")))
    name = F.when(F.col("cut") == 1, F.concat("pid", F.lit("s"), F.format_string("%02d", "sent_lo"))).otherwise(F.concat("pid", F.lit("s"), F.format_string("%02d", "sent_lo"), F.lit("-"), F.format_string("%02d", "sent_hi")))
    cut = runs.join(paragraphs.select("pid", "context"), "pid").select(name.alias("uid"), F.when(F.col("cut") == 1, "piece").otherwise("segment").alias("kind"), "pid", "sent_lo", "sent_hi", text.alias("text"))
    return cut.unionByName(paragraph_units(paragraphs.join(touched, "pid", "left_anti")))


def oracle_units(paragraphs: DataFrame, sentences: DataFrame, keys: DataFrame) -> DataFrame:
    return paragraph_units(paragraphs).unionByName(piece_units(sentences, keys))


def crack_units(paragraphs: DataFrame, spans: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """Tiles between cuts: the ends of the text, of every extracted span (pid, s, e, level), and of every sentence if given.

    A tile without a letter or figure is dropped; a tile that is an extracted span is a piece.
    """
    ends = lambda f: f.select("pid", F.explode(F.array("s", "e")).alias("c"))
    cuts = paragraphs.select("pid", F.explode(F.array(F.lit(0), F.length("context"))).alias("c")).unionByName(ends(spans))
    if sentences is not None:
        cuts = cuts.unionByName(ends(sentences))
    along = W.partitionBy("pid").orderBy("c")
    tiles = cuts.distinct().withColumn("d", F.lead("c").over(along)).where("d IS NOT NULL").join(paragraphs, "pid")
    tiles = tiles.withColumn("t", X.trim_span(F.col("context"), F.col("c").cast("int"), F.col("d").cast("int"))).select("pid", "title", "t.s", "t.e", X.span_text(F.col("context"), F.col("t.s"), F.col("t.e")).alias("bare"))
    tiles = tiles.where(F.col("bare").rlike(ALNUM)).join(spans.select("pid", "s", "e", "level").distinct(), ["pid", "s", "e"], "left")
    return tiles.select(F.concat("pid", F.lit("c"), F.format_string("%04d", "s"), F.lit("-"), F.format_string("%04d", "e")).alias("uid"),
                        F.when(F.col("level").isNotNull(), F.concat(F.lit("piece-"), "level")).otherwise("segment").alias("kind"), "pid", "s", "e", F.concat(X.title_prefix(F.col("title")), F.col("bare")).alias("text"))


def evidence_groups(spans: DataFrame, k: int, least_iou: float = 0.7) -> DataFrame:
    """spans (pid, qid, ord, s, e) to (pid, g, s, e, n): a span joins the first group whose first span overlaps it enough.

    Order within a paragraph decides, so each paragraph is folded in (qid, ord) order;
    groups of fewer than k questions are dropped.
    """
    def fold(frame):
        import pandas as pd

        groups: list[tuple[int, int, set]] = []
        for r in frame.sort_values(["qid", "ord"]).itertuples():
            for s, e, held in groups:
                if (min(e, r.e) - max(s, r.s)) >= least_iou * (max(e, r.e) - min(s, r.s)):
                    held.add(r.qid)
                    break
            else:
                groups.append((r.s, r.e, {r.qid}))
        rows = [(frame["pid"].iloc[0], g, s, e, len(held)) for g, (s, e, held) in enumerate(groups) if len(held) >= k]
        return pd.DataFrame(rows, columns=["pid", "g", "s", "e", "n"])

    kind = spans.schema["pid"].dataType.simpleString()
    return spans.select("pid", "qid", "ord", "s", "e").groupBy("pid").applyInPandas(fold, f"pid {kind}, g int, s int, e int, n int")


def locked_spans(groups: DataFrame) -> DataFrame:
    """(pid, s, e, level): groups by demand and length, each kept unless it overlaps one kept before."""
    def fold(frame):
        import pandas as pd

        kept: list[tuple[int, int]] = []
        for r in frame.assign(size=frame.e - frame.s).sort_values(["n", "size", "g"], ascending=[False, False, True]).itertuples():
            if all(r.e <= s or r.s >= e for s, e in kept):
                kept.append((r.s, r.e))
        return pd.DataFrame([(frame["pid"].iloc[0], s, e, "evidence") for s, e in kept], columns=["pid", "s", "e", "level"])

    kind = groups.schema["pid"].dataType.simpleString()
    return groups.groupBy("pid").applyInPandas(fold, f"pid {kind}, s int, e int, level string")


def evidence_units(paragraphs: DataFrame, sentences: DataFrame, groups: DataFrame) -> DataFrame:
    """Tiles between sentence ends and locked spans; sentence ends inside a locked span do not cut."""
    locked = locked_spans(groups)
    mine = sentences.join(locked.select("pid").distinct(), "pid", "left_semi")
    inside = mine.alias("m").join(locked.alias("l"), "pid").select("m.pid", "m.sent", F.explode(F.array(F.struct(F.col("m.s").alias("c"), F.col("l.s").alias("a"), F.col("l.e").alias("b")), F.struct(F.col("m.e").alias("c"), F.col("l.s").alias("a"), F.col("l.e").alias("b")))).alias("x"))
    gone = inside.where("x.c > x.a AND x.c < x.b").select("pid", F.col("x.c").alias("c")).distinct()
    cuts = mine.select("pid", F.explode(F.array("s", "e")).alias("c")).join(gone, ["pid", "c"], "left_anti")
    edges = cuts.select("pid", F.col("c").alias("s"), F.col("c").alias("e"))
    units = crack_units(paragraphs.join(locked.select("pid").distinct(), "pid", "left_semi"), locked, edges)
    return units.withColumn("kind", F.when(F.col("kind") == "piece-evidence", "evidence").otherwise(F.col("kind"))).withColumn("uid", F.regexp_replace("uid", "c(?=[0-9]+-[0-9]+$)", "e"))
