"""Corpus building: paragraphs, sentences, questions, answers and where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessella.functions import text as X
from tessella.operators.numbering import number_rows
from tessella.session import ship

#: Bytes and rows of item texts that a containment join broadcasts, and characters of each that its automaton knows.
BROADCAST_BYTES = 16 << 20
AUTOMATON_ITEMS = 50_000
ANCHOR_CHARS = 24


def build_paragraphs(rows: DataFrame, order: str = "id") -> DataFrame:
    """Flat rows (id, title, context) to (pid, title, context): distinct paragraphs, numbered by first appearance."""
    first = rows.groupBy("title", "context").agg(F.min(order).alias("first"))
    articles = number_rows(first.groupBy("title").agg(F.min("first").alias("began")), [F.col("began"), F.col("title")], "article").drop("began")
    placed = first.join(articles, "title").withColumn("n", F.row_number().over(W.partitionBy("article").orderBy("first")) - 1)
    return placed.select(F.concat(F.lit("a"), F.format_string("%02d", "article"), F.lit("p"), F.format_string("%03d", "n")).alias("pid"), "title", "context", "first")


def explode_sentences(paragraphs: DataFrame) -> DataFrame:
    """(pid, title, sent, s, e, text)."""
    each = paragraphs.select("pid", "title", F.posexplode(X.sentence_texts(F.col("context"))).alias("sent", "x"))
    return each.select("pid", "title", "sent", "x.s", "x.e", "x.text")


def sentence_at(spans: Column, offset: Column) -> Column:
    """Number of the sentence that holds an offset; a gap belongs to the next; null outside."""
    after = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["e"] > offset)
    return F.when((F.size(spans) > 0) & (offset >= 0), F.get(after, F.lit(0)))


def locate(context: Column, text: Column, given: Column) -> Column:
    """struct<start, fixed>: the given offset if the text stands there, else the nearest occurrence, else null."""
    n = F.length(context) - F.length(text)
    places = F.filter(F.when(n >= 0, F.sequence(F.lit(0), n)), lambda i: F.substring(context, i + 1, F.length(text)) == text)
    nearest = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - given).alias("d"), i.alias("i"))))["i"]
    there = (given >= 0) & (F.substring(context, given + 1, F.length(text)) == text)
    return F.when(there, F.struct(given.alias("start"), F.lit(False).alias("fixed"))).when(nearest.isNotNull(), F.struct(nearest.alias("start"), F.lit(True).alias("fixed")))


def map_answers(answers: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """answers (qid, ord, pid, text, start) with start_sent, end_sent, offset_fixed."""
    held = answers.join(paragraphs.select("pid", "context", X.sentences(F.col("context")).alias("spans")), "pid")
    found = held.withColumn("bare", F.trim(F.col("text"), F.lit(X.BLANK))).withColumn("at", locate(F.col("context"), F.col("text"), F.col("start")))
    begin = F.col("at.start") + F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(X.BLANK)))
    whole = F.length("bare") > 0
    return found.select(
        "qid", "ord", "pid", F.col("at.start").alias("start"), F.when(whole, sentence_at(F.col("spans"), begin)).alias("start_sent"),
        F.when(whole, sentence_at(F.col("spans"), begin + F.length("bare") - 1)).alias("end_sent"), F.coalesce("at.fixed", F.lit(False)).alias("offset_fixed"))


def gold_sentences(mapped: DataFrame) -> DataFrame:
    """(qid, gold_sent): the sentence that most answers begin in; on a tie that of the earliest answer."""
    votes = mapped.where("start_sent IS NOT NULL").groupBy("qid", "start_sent").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return votes.groupBy("qid").agg(F.max_by("start_sent", F.struct("n", -F.col("first"))).alias("gold_sent"))


def contained(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, pid, start) of every item text that stands in a document, first occurrence.

    The beginnings of all item texts are one automaton, which finds them in a single pass
    over each document; the rest of an item is compared where its beginning stands.
    Items are broadcast in slices of a fixed size, a pass each, so that memory is bounded.
    Null texts hold nothing and are held nowhere; an empty item stands at the start of all.
    """
    spark = documents.sparkSession
    ship(spark)
    found = items.where("text IS NOT NULL").agg(F.sum(F.octet_length("text")), F.count("*")).first()
    slices = max(1, -(-(found[0] or 0) // BROADCAST_BYTES), -(-found[1] // AUTOMATON_ITEMS))
    source = documents.where("context IS NOT NULL").select("pid", "context")
    schema = T.StructType([items.schema["qid"], source.schema["pid"], T.StructField("start", T.IntegerType())])
    out = None
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("qid", "text"), F.lit(slices)) == k)
        rows = part.where("text IS NOT NULL").select("qid", "text").toArrow()
        shared = spark.sparkContext.broadcast((rows.column("qid").to_pylist(), rows.column("text").to_pylist()))
        part = source.mapInArrow(_find_items(shared), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _find_items(shared):
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        by_text: dict[str, list] = {}
        for qid, text in zip(*shared.value):
            by_text.setdefault(text, []).append(qid)
        by_start: dict[str, list[str]] = {}
        for text in by_text:
            by_start.setdefault(text[:ANCHOR_CHARS], []).append(text)
        automaton = ahocorasick.Automaton()
        for start in by_start:
            if start:
                automaton.add_word(start, start)
        automaton.make_automaton()
        for batch in batches:
            qids, pids, places = [], [], []
            for pid, context in zip(batch.column("pid").to_pylist(), batch.column("context").to_pylist()):
                seen = {"": 0} if "" in by_text else {}
                for last, start in automaton.iter(context) if len(automaton) else ():
                    at = last + 1 - len(start)
                    for text in by_start[start]:
                        if text not in seen and context.startswith(text, at):
                            seen[text] = at
                for text, at in seen.items():
                    qids += by_text[text]
                    pids += [pid] * len(by_text[text])
                    places += [at] * len(by_text[text])
            kinds = batch.schema.field("pid").type
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(pids, kinds), pa.array(places, pa.int32())], names=["qid", "pid", "start"])

    return run


def greedy_chunks(spans: Column, most: int = 5, max_chars: int = 700) -> Column:
    """array<array<span>>: a new chunk when one is full or a sentence would reach too far from its start."""
    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        full = (F.size(last) >= most) | (s["e"] - last[0]["s"] > max_chars)
        return F.when((F.size(acc) == 0) | full, F.array_append(acc, F.array(s))).otherwise(F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array_append(last, s)))

    return F.aggregate(spans, F.expr("cast(array() as array<array<struct<s: int, e: int>>>)"), lambda acc, s: F.when(F.size(acc) == 0, F.array(F.array(s))).otherwise(add(acc, s)))


def fuzzy_span(text: Column, span: Column) -> Column:
    """struct<s, e>: the words of span in text, case-insensitive, any non-word characters between; null if not there."""
    words = F.regexp_extract_all(span, F.lit("[A-Za-z0-9]+"), F.lit(0))
    pattern = F.concat(F.lit(r"(?is)^(.*?)("), F.array_join(words, r"(?U:\W+)"), F.lit(").*$"))
    before, found = (F.call_function("regexp_extract", text, pattern, F.lit(i)) for i in (1, 2))
    return F.when((F.size(words) > 0) & (F.length(found) > 0), F.struct(F.length(before).alias("s"), (F.length(before) + F.length(found)).alias("e")))


def pooled_paragraphs(rows: DataFrame) -> DataFrame:
    """Multi-hop rows (id, titles, texts: array of sentence arrays) to (pid, title, context, spans): one paragraph a title, the first text wins.

    Sentences are joined by one space; an empty sentence keeps a span of no length.
    """
    each = rows.select("id", F.posexplode(F.arrays_zip("titles", "texts")).alias("i", "p"))
    first = each.groupBy("p.titles").agg(F.min_by(F.col("p.texts"), F.struct("id", "i")).alias("sents"), F.min(F.struct("id", "i")).alias("at")).withColumnRenamed("titles", "title")
    ends = F.aggregate("sents", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s: int, e: int>>)").alias("out")), lambda acc, s: F.struct(
        (acc["at"] + F.length(s) + 1).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("s"), (acc["at"] + F.length(s)).alias("e"))).alias("out")), lambda acc: acc["out"])
    numbered = number_rows(first.select("title", "sents", ends.alias("spans"), F.col("at.id").alias("_id"), F.col("at.i").alias("_i")), [F.col("_id"), F.col("_i")], "n")
    return numbered.select(F.concat(F.lit("h"), F.format_string("%05d", "n")).alias("pid"), "title", F.array_join("sents", " ").alias("context"), "spans")


def units_key(units: DataFrame) -> DataFrame:
    """Content address of an index: a digest over the digests of ranges of 65,536 ids, of each id and search text in order."""
    joined = lambda order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "h"))), lambda r: r["h"]), ""), 256)
    parts = units.select("uidx", F.sha2(F.concat_ws("\x00", "uid", "search_text"), 256).alias("h"), F.shiftright("uidx", 16).alias("part"))
    return parts.groupBy("part").agg(joined("uidx").alias("h")).agg(F.substring(joined("part"), 1, 16).alias("units_key"))


def step_corpus(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of questions with steps to (paragraphs, questions).

    rows (ord, id, question, answerable, paragraphs: array<struct<idx, title, text>>,
    steps: array<struct<idx, answer>>). Paragraphs (pid, title, context) are the distinct
    (title, text), numbered by first appearance. A question stays if it is answerable and
    every step's answer stands in its paragraph, as it is or in other case; questions (id,
    question, pid, answers: array<struct<pid, text, start, sent>>, gold_sent, support:
    array<struct<pid, sent>>, qtype) have the last step's paragraph and sentence as gold,
    and the part of the id before two underscores as type.
    """
    each = rows.select("ord", "id", F.posexplode("paragraphs").alias("i", "p")).select("ord", "id", "i", "p.*")
    first = each.groupBy("title", "text").agg(F.min(F.struct("ord", "i")).alias("at"))
    numbered = number_rows(first.select("title", "text", F.col("at.ord").alias("_ord"), F.col("at.i").alias("_i")), [F.col("_ord"), F.col("_i")], "n")
    named = numbered.select(F.concat(F.lit("m"), F.format_string("%05d", "n")).alias("pid"), "title", "text", F.trim("text", F.lit(X.BLANK)).alias("context"))
    asked = rows.where(F.coalesce("answerable", F.lit(True)))
    steps = asked.select("id", F.posexplode("steps").alias("i", "step")).select("id", "i", "step.idx", F.trim(F.col("step.answer"), F.lit(X.BLANK)).alias("text"))
    held = steps.join(each.select("id", "idx", "title", F.col("text").alias("whole")), ["id", "idx"], "left").join(named.withColumnRenamed("text", "whole"), ["title", "whole"], "left")
    plain, folded = F.expr("instr(context, text) - 1"), F.expr("instr(lower(context), lower(text)) - 1")
    at = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, -1).otherwise(F.coalesce(F.when(plain >= 0, plain).otherwise(folded), F.lit(-1)))
    placed = held.withColumn("start", at)
    answer = F.struct("i", "pid", F.expr("substring(context, start + 1, length(text))").alias("text"), "start", sentence_at(X.sentences(F.col("context")), F.col("start")).alias("sent"))
    whole = placed.groupBy("id").agg(F.min("start").alias("least"), F.array_sort(F.collect_list(answer)).alias("found")).where("least >= 0")
    support = F.array_distinct(F.filter(F.transform("found", lambda a: F.when(a["sent"].isNotNull(), F.struct(a["pid"].alias("pid"), a["sent"].alias("sent")))), lambda s: s.isNotNull()))
    last = F.element_at("found", -1)
    answers = F.transform("found", lambda a: F.struct(a["pid"].alias("pid"), a["text"].alias("text"), a["start"].alias("start"), a["sent"].alias("sent")))
    questions = asked.select("id", "question").join(whole, "id").select(
        "id", "question", last["pid"].alias("pid"), answers.alias("answers"), last["sent"].alias("gold_sent"), support.alias("support"), F.split("id", "__")[0].alias("qtype"))
    return named.select("pid", "title", "context"), questions


def course_corpus(documents: DataFrame, rows: DataFrame, most: int = 5, max_chars: int = 700) -> tuple[DataFrame, DataFrame]:
    """Long documents and questions with answer spans to (paragraphs, questions).

    documents (name, title, raw): white space becomes one space, sentences are packed
    into chunks, each a paragraph (pid, title, context, base). rows (id, name, question,
    spans: array<string>, qtype): a question stays if it has spans and each is found, by
    its words, in its document and begins in a chunk's sentence; an answer ends with its
    chunk. Documents are numbered by name.
    """
    named = number_rows(documents.select("name", "title", F.trim(F.regexp_replace("raw", r"(?U)\s+", " ")).alias("whole")), [F.col("name")], "n")
    chunks = named.select("name", "n", "title", "whole", F.posexplode(greedy_chunks(X.sentences(F.col("whole")), most, max_chars)).alias("k", "x"))
    base, end = F.col("x")[0]["s"], F.element_at("x", -1)["e"]
    placed = chunks.select("name", F.concat(F.lit("s"), F.format_string("%02d", "n"), F.lit("p"), F.format_string("%03d", "k")).alias("pid"), "title", X.span_text(F.col("whole"), base, end).alias("context"), base.alias("base"), end.alias("end"), "x")
    each = rows.select("id", "name", F.posexplode(F.filter("spans", lambda t: F.coalesce(t, F.lit("")) != "")).alias("i", "span"))
    found = each.join(named.select("name", "whole"), "name", "left").select("id", "name", "i", fuzzy_span(F.col("whole"), F.col("span")).alias("at"), "whole")
    # A document has few chunks beside its text, so the join is by name.
    inside = (F.col("base") <= F.col("at.s")) & (F.col("at.s") < F.col("end"))
    sents = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda k: (F.get(F.col("x"), k)["s"] <= F.col("at.s")) & (F.col("at.s") < F.get(F.col("x"), k)["e"]))
    hits = found.join(placed.select("name", "pid", "base", "end", "x"), "name").where(inside).withColumn("sent", F.get(sents, F.lit(0))).where("sent IS NOT NULL")
    text = F.expr("substring(whole, at.s + 1, least(at.e, end) - at.s)")
    answers = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "pid", text.alias("text"), (F.col("at.s") - F.col("base")).alias("start"), "sent"))).alias("answers"))
    asked = each.groupBy("id").agg(F.count("*").alias("spans"))
    kept = rows.select("id", "question", "qtype").join(asked, "id").join(answers, "id").where(F.size("answers") == F.col("spans"))
    support = F.array_distinct(F.transform("answers", lambda a: F.struct(a["pid"].alias("pid"), a["sent"].alias("sent"))))
    questions = kept.select("id", "question", F.col("answers")[0]["pid"].alias("pid"), "answers", F.col("answers")[0]["sent"].alias("gold_sent"), support.alias("support"), "qtype")
    return placed.select("pid", "title", "context", "base"), questions


def kept_text(pruned: DataFrame, decode=None) -> DataFrame:
    """pruned (pid, context, pruned) to (pid, kept): the sentences of the context whose decoded form stands in the pruned text, in order, as they were before decoding, joined by a space.

    decode is a Python function from a sentence to what the pruner's tokens spell, by
    default the sentence itself.
    """
    ship(pruned.sparkSession)
    source = pruned.select("pid", "context", "pruned", X.sentences(F.col("context")).alias("spans"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for context, said, spans in zip(*(batch.column(c).to_pylist() for c in ("context", "pruned", "spans"))):
                kept, begin = [], 0
                for span in spans or ():
                    sentence = context[span["s"] : span["e"]]
                    spelt = (decode(sentence) if decode else sentence).strip()
                    at = said.find(spelt, begin) if spelt and said else -1
                    if at >= 0:
                        kept.append(sentence)
                        begin = at + len(spelt)
                out.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(out, pa.string())], names=["pid", "kept"])

    return source.mapInArrow(run, T.StructType([source.schema["pid"], T.StructField("kept", T.StringType())]))
