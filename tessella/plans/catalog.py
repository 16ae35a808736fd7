"""Registered queries over the input tables, and the SQL that each must equal.

How the tables stand for a retrieval corpus: documents are paragraphs (the source is
the document around them), benchmark items are questions whose text is the answer to be
found, embeddings are vectors of units (those whose id is divisible by 20 also of
questions), events are rows of an evaluation log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessella.functions import text as X
from tessella.operators import corpus, entities, graph, metrics, ranking, units
from tessella.operators.components import connected_components
from tessella.session import table
from tessella.sources.io import missing_rows

QUERIES: dict = {}
ORACLES: dict = {}
TAU = 0.35


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the corpus views, in both engines


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), F.col("text").alias("context"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return corpus.explode_sentences(paragraphs(spark, d))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("qid", F.col("text").alias("question"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    found = corpus.contained(paragraphs(spark, d), items(spark, d)).join(items(spark, d), "qid")
    return found.withColumn("ord", F.row_number().over(W.partitionBy("qid").orderBy("pid")) - 1)


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return corpus.map_answers(answers(spark, d), paragraphs(spark, d))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(qid, pid, sent) of the first document that holds each item."""
    return mapped(spark, d).where("ord = 0").select("qid", "pid", F.col("start_sent").alias("sent"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))


P = "p AS (SELECT doc_id AS pid, source AS title, text AS context FROM documents)"
S = P + r""",
raw AS (SELECT pid, title, context, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS piece FROM (SELECT *, regexp_extract_all(context, '[^.!?\n]*[.!?\n]+|[^.!?\n]+$') AS x FROM p)),
off AS (SELECT *, sum(length(piece)) OVER (PARTITION BY pid ORDER BY i) - length(piece) AS b FROM raw),
cut AS (SELECT pid, title, context, i, CAST(b + length(piece) - length(ltrim(piece, E' \t\n\r')) AS INT) AS s, CAST(b + length(rtrim(piece, E' \t\n\r')) AS INT) AS e FROM off),
s AS (SELECT pid, title, CAST(row_number() OVER (PARTITION BY pid ORDER BY i) - 1 AS INT) AS sent, s, e, substr(context, s + 1, e - s) AS text FROM cut WHERE e > s)"""
Q = "q AS (SELECT item_id AS qid, text AS question FROM benchmark)"
A = "a AS (SELECT item_id AS qid, doc_id AS pid, CAST(instr(d.text, b.text) - 1 AS INT) AS start, b.text AS text, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS INT) AS ord FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
M = S + ", " + A + r""",
m AS (SELECT a.*, (SELECT min(sent) FROM s WHERE s.pid = a.pid AND s.e > a.start) AS start_sent, (SELECT min(sent) FROM s WHERE s.pid = a.pid AND s.e > a.start + length(a.text) - 1) AS end_sent FROM a),
gold AS (SELECT qid, pid, start_sent AS sent FROM m WHERE ord = 0)"""
STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TERMS = r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN (" + STOP + "))"
TOKENS = r"list_filter(regexp_split_to_array({t}, '[ \t\n\r]+'), lambda w: w <> '')"
NORM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
_BARE = r"regexp_replace(regexp_replace(trim(replace(lower({t}), '’', ''''), E' \t\n\r'), '''s$', ''), '^(the|a|an)\s+', '')"
# Two rounds take every thousands comma, as the matches of one overlap.
_COMMA = r"regexp_replace(%s, '(\d),(\d{{3}})([^\d]|$)', '\1\2\3', 'g')"
CONCEPT = r"trim(regexp_replace(regexp_replace(%s, '[^\p{{L}}\p{{N}}_\s.%%$]', ' ', 'g'), '\s+', ' ', 'g'), ' .')" % (_COMMA % (_COMMA % _BARE))
OVERLAP = "len(list_intersect(list_distinct(" + TOKENS.format(t="lower({a})") + "), list_distinct(" + TOKENS.format(t="lower({b})") + ")))"
COS = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
PREFIX = "replace(title, '_', ' ') || ': '"


def bm25_sql(units: str, queries: str, depth: int) -> str:
    """CTEs ending in ``bm``; units (uidx, search_text), queries (qid, question)."""
    return f"""
c AS (SELECT uidx, {TERMS.format(t='search_text')} AS words FROM {units}),
st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM c),
po AS (SELECT uidx, dl, w, count(*) AS tf FROM (SELECT uidx, len(words) AS dl, unnest(words) AS w FROM c) GROUP BY uidx, dl, w),
dfs AS (SELECT w, count(*) AS df FROM po GROUP BY w),
qw AS (SELECT qid, unnest(list_distinct({TERMS.format(t='question')})) AS w FROM {queries}),
sc AS (SELECT qid, uidx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qw JOIN po USING (w) JOIN dfs USING (w), st GROUP BY qid, uidx),
bm AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, uidx) AS INT) AS rank, uidx, score FROM sc WHERE score > 0) WHERE rank <= {depth})"""


# --- corpus


@query(f"WITH {S} SELECT pid, sent, s, e FROM s")
def sentence_segment(spark, d):
    return sentences(spark, d).select("pid", "sent", "s", "e")


@query("""WITH f AS (SELECT source, text, min(doc_id) AS first FROM documents GROUP BY source, text),
t AS (SELECT source, dense_rank() OVER (ORDER BY began, source) - 1 AS article FROM (SELECT source, min(first) AS began FROM f GROUP BY source))
SELECT 'a' || lpad(CAST(article AS VARCHAR), CAST(greatest(2, length(CAST(article AS VARCHAR))) AS INT), '0') || 'p' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS pid, source AS title, length(text) AS n_chars
FROM (SELECT article, source, text, row_number() OVER (PARTITION BY article ORDER BY first) - 1 AS n FROM f JOIN t USING (source))""")
def corpus_build(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("context"))
    return corpus.build_paragraphs(rows).select("pid", "title", F.length("context").alias("n_chars"))


@query(f"""WITH {M}, used AS (SELECT DISTINCT pid FROM a), x AS (SELECT pid, count(*) AS n, sum(e - s) + count(*) - 1 AS chars FROM s JOIN used USING (pid) GROUP BY pid),
f AS (SELECT pid, min(qid) AS first FROM a GROUP BY pid)
SELECT 'h' || lpad(CAST(row_number() OVER (ORDER BY first, pid) - 1 AS VARCHAR), 5, '0') AS pid, CAST(pid AS VARCHAR) AS title, CAST(n AS INT) AS n_sents, CAST(chars AS INT) AS n_chars FROM x JOIN f USING (pid)""")
def hop_corpus(spark, d):
    texts = sentences(spark, d).groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent", "text"))), lambda s: s["text"]).alias("texts"))
    rows = answers(spark, d).select("qid", "pid").join(texts, "pid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pid", "texts"))).alias("x"))
    rows = rows.select(F.col("qid").alias("id"), F.transform("x", lambda r: r["pid"].cast("string")).alias("titles"), F.transform("x", lambda r: r["texts"]).alias("texts"))
    return corpus.pooled_paragraphs(rows).select("pid", "title", F.size("spans").alias("n_sents"), F.length("context").alias("n_chars"))


@query(f"""WITH RECURSIVE {S}, g(pid, sent, e, chunk, k, base) AS (SELECT pid, sent, e, 0, 1, s FROM s WHERE sent = 0
UNION ALL SELECT s.pid, s.sent, s.e, CASE WHEN k >= 5 OR s.e - base > 700 THEN chunk + 1 ELSE chunk END, CASE WHEN k >= 5 OR s.e - base > 700 THEN 1 ELSE k + 1 END, CASE WHEN k >= 5 OR s.e - base > 700 THEN s.s ELSE base END
FROM g JOIN s ON s.pid = g.pid AND s.sent = g.sent + 1) SELECT pid, chunk, count(*) AS n, min(base) AS s, max(e) AS e FROM g GROUP BY pid, chunk""")
def chunk_greedy(spark, d):
    chunks = paragraphs(spark, d).select("pid", F.posexplode(corpus.greedy_chunks(X.sentences(F.col("context")))).alias("chunk", "x"))
    return chunks.select("pid", "chunk", F.size("x").cast("long").alias("n"), F.col("x")[0]["s"].alias("s"), F.element_at("x", -1)["e"].alias("e"))


@query(rf"""WITH {P}, {A}, f AS (SELECT qid, pid, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: w) AS w, context FROM a JOIN p USING (pid)),
x AS (SELECT qid, pid, len(w) AS k, '(?is)^(.*?)(' || array_to_string(w, '[^\p{{L}}\p{{N}}_]+') || ').*$' AS re, context FROM f), y AS (SELECT qid, pid, k, length(regexp_extract(context, re, 1)) AS s, length(regexp_extract(context, re, 2)) AS n FROM x)
SELECT qid, pid, CASE WHEN k > 0 AND n > 0 THEN CAST(s AS INT) END AS s, CASE WHEN k > 0 AND n > 0 THEN CAST(s + n AS INT) END AS e FROM y""")
def fuzzy_span(spark, d):
    return answers(spark, d).join(paragraphs(spark, d), "pid").select("qid", "pid", corpus.fuzzy_span(F.col("context"), F.col("text")).alias("x")).select("qid", "pid", "x.s", "x.e")


@query(f"""WITH {S}, o AS (SELECT pid, unnest([-1, 0, length(context) // 3, length(context) // 2, length(context) - 1, length(context)]) AS "offset", unnest(range(0, 6)) AS k FROM p)
SELECT pid, k, CAST("offset" AS INT) AS "offset", CASE WHEN "offset" >= 0 THEN (SELECT min(sent) FROM s WHERE s.pid = o.pid AND s.e > o."offset") END AS sent FROM o""")
def offset_to_sentence(spark, d):
    n = F.length("context")
    offsets = F.array(F.lit(-1), F.lit(0), F.expr("length(context) div 3").cast("int"), F.expr("length(context) div 2").cast("int"), n - 1, n)
    each = paragraphs(spark, d).select("pid", X.sentences(F.col("context")).alias("spans"), F.posexplode(offsets).alias("k", "offset"))
    return each.select("pid", F.col("k").cast("long").alias("k"), "offset", corpus.sentence_at(F.col("spans"), F.col("offset")).alias("sent"))


@query(f"""WITH {P}, {A}, o AS (SELECT qid, pid, start + 7 AS given, list_filter(range(0, length(context) - length(text) + 1), lambda i: substr(context, i + 1, length(text)) = text) AS places FROM a JOIN p USING (pid))
SELECT qid, pid, CAST(list_min(list_transform(places, lambda i: abs(i - given) * 1000000 + i)) % 1000000 AS INT) AS start, true AS fixed FROM o""")
def locate_answer(spark, d):
    held = answers(spark, d).join(paragraphs(spark, d), "pid")
    return held.select("qid", "pid", corpus.locate(F.col("context"), F.col("text"), F.col("start") + 7).alias("x")).select("qid", "pid", "x.start", "x.fixed")


@query(f"WITH {M} SELECT qid, ord, pid, start, start_sent, end_sent, false AS offset_fixed FROM m")
def map_answers(spark, d):
    return mapped(spark, d)


@query(f"""WITH {M}, v AS (SELECT qid, start_sent, count(*) AS n, min(ord) AS first FROM m WHERE start_sent IS NOT NULL GROUP BY qid, start_sent)
SELECT qid, start_sent AS gold_sent FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS r FROM v) WHERE r = 1""")
def gold_sentence(spark, d):
    return corpus.gold_sentences(mapped(spark, d))


@query(f"""WITH {M} SELECT (SELECT count(*) FROM p) AS n_paragraphs, (SELECT count(*) FROM benchmark) AS n_questions, count(*) AS n_answers, count(start_sent) AS n_mapped,
sum(CAST(start_sent <> end_sent AS INT)) AS n_crossing, round(count(DISTINCT qid) / (SELECT count(*) FROM benchmark), 6) AS map_rate FROM m""")
def mapping_stats(spark, d):
    m = mapped(spark, d)
    n = lambda f, name: f.agg(F.count("*").alias(name))
    stats = m.agg(F.count("*").alias("n_answers"), F.count("start_sent").alias("n_mapped"), F.sum((F.col("start_sent") != F.col("end_sent")).cast("int")).alias("n_crossing"), F.countDistinct("qid").alias("k"))
    whole = n(paragraphs(spark, d), "n_paragraphs").crossJoin(n(items(spark, d), "n_questions")).crossJoin(stats)
    return whole.withColumn("map_rate", F.round(F.col("k") / F.col("n_questions"), 6)).drop("k")


@query(f"""WITH {P}, h AS (SELECT pid, pid >> 16 AS part, sha256(CAST(pid AS VARCHAR) || chr(0) || {PREFIX} || context) AS h FROM p), r AS (SELECT part, sha256(string_agg(h, '' ORDER BY pid)) AS h FROM h GROUP BY part)
SELECT substr(sha256(string_agg(h, '' ORDER BY part)), 1, 16) AS units_key FROM r""")
def units_key(spark, d):
    u = units.paragraph_units(paragraphs(spark, d))
    return corpus.units_key(u.select(F.col("pid").alias("uidx"), "uid", F.col("text").alias("search_text")))


@query("""WITH done AS (SELECT DISTINCT event_type, user_id % 4 AS budget, user_id FROM events WHERE event_id % 50 = 0)
SELECT event_type, user_id % 4 AS budget, count(*) AS n_left FROM events e WHERE NOT EXISTS (SELECT 1 FROM done f WHERE f.event_type = e.event_type AND f.budget = e.user_id % 4 AND f.user_id = e.user_id) GROUP BY 1, 2""")
def resume_anti(spark, d):
    """Rows whose (method, budget, question) a log does not have yet."""
    keys = ["event_type", "budget", "user_id"]
    e = table(spark, d, "events").withColumn("budget", F.col("user_id") % 4)
    return missing_rows(e, e.where("event_id % 50 = 0"), keys).groupBy("event_type", "budget").agg(F.count("*").alias("n_left"))


@query(r"""WITH {SP}, ap AS (SELECT item_id AS ord, doc_id AS idx, d.source AS title, d.text AS whole, b.text AS answer, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS INT) AS i FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
fs AS (SELECT title, whole, min(ord * 1000000 + i) AS first FROM ap GROUP BY title, whole), nu AS (SELECT title, whole, 'm' || lpad(CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR), 5, '0') AS mpid FROM fs),
st AS (SELECT ord, i, idx, mpid, instr(lower(trim(whole, E' \t\n\r')), lower(answer)) - 1 AS folded, instr(trim(whole, E' \t\n\r'), CASE WHEN i = 1 THEN lower(answer) ELSE answer END) - 1 AS plain FROM ap JOIN nu USING (title, whole) WHERE i < 2),
lo AS (SELECT ord, i, idx, mpid, CASE WHEN plain >= 0 THEN plain ELSE folded END AS start FROM st)
SELECT ord AS qid, i AS step, mpid AS pid, CAST(start AS INT) AS start, (SELECT min(sent) FROM s WHERE s.pid = lo.idx AND s.e > lo.start) AS sent, CASE WHEN ord % 2 = 0 THEN '2hop' ELSE '3hop' END AS qtype
FROM lo WHERE ord % 11 <> 0 AND ord NOT IN (SELECT ord FROM lo WHERE start < 0)""".replace("{SP}", S.replace("text AS context FROM documents", r"trim(text, E' \t\n\r') AS context FROM documents")))
def step_corpus(spark, d):
    """Questions of one step for each of the first two documents that hold an item, the second in lower case."""
    held = answers(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), F.col("text").alias("context")), "pid")
    rows = held.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("pid").alias("idx"), "title", "context", "text"))).alias("x"))
    steps = F.transform(F.slice("x", 1, 2), lambda r: F.struct(r["idx"].alias("idx"), F.when(r["ord"] == 1, F.lower(r["text"])).otherwise(r["text"]).alias("answer")))
    rows = rows.select(F.col("qid").alias("ord"), F.concat(F.when(F.col("qid") % 2 == 0, "2hop__").otherwise("3hop__"), "qid").alias("id"), F.lit("").alias("question"), (F.col("qid") % 11 != 0).alias("answerable"),
                       F.transform("x", lambda r: F.struct(r["idx"].alias("idx"), r["title"].alias("title"), r["context"].alias("text"))).alias("paragraphs"), steps.alias("steps"))
    _, found = corpus.step_corpus(rows)
    each = found.select(F.regexp_extract("id", "[0-9]+$", 0).cast("long").alias("qid"), F.posexplode("answers").alias("step", "a"), "qtype")
    return each.select("qid", "step", "a.pid", "a.start", "a.sent", "qtype")


@query(f"""WITH RECURSIVE {S}, pr AS (SELECT pid, string_agg(text, ' ' ORDER BY sent) FILTER (sent % 2 = 0) AS pruned FROM s GROUP BY pid),
k(pid, sent, frm, kept) AS (SELECT pid, -1, 1, '' FROM pr UNION ALL SELECT k.pid, s.sent, CASE WHEN instr(substr(pruned, frm), s.text) > 0 THEN frm + instr(substr(pruned, frm), s.text) - 1 + length(s.text) ELSE frm END,
  CASE WHEN instr(substr(pruned, frm), s.text) > 0 THEN kept || CASE WHEN kept = '' THEN '' ELSE ' ' END || s.text ELSE kept END FROM k JOIN s ON s.pid = k.pid AND s.sent = k.sent + 1 JOIN pr ON pr.pid = k.pid)
SELECT pid, arg_max(kept, sent) AS kept FROM k GROUP BY pid""")
def kept_text(spark, d):
    """Every other sentence, as a pruner would return it, found again in its paragraph."""
    s = sentences(spark, d)
    pruned = s.where("sent % 2 = 0").groupBy("pid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "text"))), lambda x: x["text"]), " ").alias("pruned"))
    return corpus.kept_text(paragraphs(spark, d).join(pruned, "pid"))


# --- text functions


@query(f"SELECT doc_id, md5({NORM.format(t='text')}) AS normalized FROM documents")
def normalize_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize_answer(F.col("text"))).alias("normalized"))


@query(f"SELECT doc_id, {CONCEPT.format(t='text')} AS concept FROM documents")
def concept_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_concept(F.col("text")).alias("concept"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda n: replace(n, ',', '')))), '|') AS numbers,
regexp_matches(lower(text), '(^|[^a-z0-9_])(not|no|never|none|nor|without)([^a-z0-9_]|$)|n''t([^a-z0-9_]|$)') AS negated FROM documents""")
def number_negation_guard(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.numbers(F.col("text")), "|").alias("numbers"), X.negated(F.col("text")).alias("negated"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '^\p{Lu}')), lambda w: substr(w, 1, 1)), '') AS acronym FROM documents")
def acronym(spark, d):
    return table(spark, d, "documents").select("doc_id", X.acronym(F.col("text")).alias("acronym"))


@query(f"""WITH {S}, w AS (SELECT pid, sent, greatest(s.s - 2, 0) AS a, least(s.e + 2, length(context)) AS b, context FROM s JOIN p USING (pid)), x AS (SELECT *, substr(context, a + 1, b - a) AS t FROM w)
SELECT pid, sent, CAST(a + length(t) - length(ltrim(t, E' \\t\\n,;:')) AS INT) AS s, CAST(greatest(a + length(rtrim(t, E' \\t\\n,;:')), a + length(t) - length(ltrim(t, E' \\t\\n,;:'))) AS INT) AS e FROM x""")
def trim_span(spark, d):
    wide = sentences(spark, d).join(paragraphs(spark, d).select("pid", "context"), "pid")
    return wide.select("pid", "sent", X.trim_span(F.col("context"), F.greatest(F.col("s") - 2, F.lit(0)), F.least(F.col("e") + 2, F.length("context"))).alias("x")).select("pid", "sent", "x.s", "x.e")


@query("SELECT conv_id, turn, trim(trim(trim(split_part(trim(text, E' \\t\\n\\r'), chr(10), 1)), '\"')) AS answer FROM conversations WHERE role = 'assistant'")
def clean_answer(spark, d):
    said = table(spark, d, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", X.clean_answer(F.concat(F.lit("Answer: "), F.trim(F.col("text"), F.lit(X.BLANK)))).alias("answer"))


_SAID = "CASE event_type WHEN 'click' THEN 'They are the same.' WHEN 'view' THEN 'RELATED, not different' WHEN 'error' THEN 'Different!' WHEN 'signup' THEN 'samesame' ELSE '' END"


@query(f"SELECT event_id, nullif(regexp_extract(upper({_SAID}), '(?:^|[^A-Z0-9_])(SAME|RELATED|DIFFERENT)(?:[^A-Z0-9_]|$)', 1), '') AS label FROM events")
def parse_label(spark, d):
    return table(spark, d, "events").select("event_id", X.parse_label(F.expr(_SAID)).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'a' || CAST(doc_id % 7 AS VARCHAR) END AS doc FROM documents")
def doc_of(spark, d):
    pid = F.expr("CASE WHEN doc_id % 3 = 0 THEN string(doc_id) ELSE concat('a', doc_id % 7, 'p', doc_id) END")
    return table(spark, d, "documents").select("doc_id", X.document_of(pid).alias("doc"))


@query(f"WITH {M} SELECT qid, a.pid, sent, round(greatest(least(s.e, start + length(a.text)) - greatest(s.s, start), 0) / (greatest(s.e, start + length(a.text)) - least(s.s, start)), 6) AS iou FROM a JOIN s ON s.pid = a.pid")
def span_iou(spark, d):
    held = answers(spark, d).select("qid", "pid", "start", (F.col("start") + F.length("text")).alias("stop")).join(sentences(spark, d), "pid")
    return held.select("qid", "pid", "sent", F.round(X.span_iou(F.col("s"), F.col("e"), F.col("start"), F.col("stop")), 6).alias("iou"))


# --- units


@query(f"WITH {S}, n AS (SELECT pid, count(*) AS n FROM s GROUP BY pid) SELECT CAST(pid AS VARCHAR) AS uid, 'paragraph' AS kind, pid, 0 AS sent_lo, CAST(coalesce(n, 0) - 1 AS INT) AS sent_hi, md5({PREFIX} || context) AS text FROM p LEFT JOIN n USING (pid)")
def units_paragraph(spark, d):
    return units.paragraph_units(paragraphs(spark, d)).withColumn("text", F.md5("text"))


_UID = "CAST(pid AS VARCHAR) || 's' || lpad(CAST({x} AS VARCHAR), CAST(greatest(2, length(CAST({x} AS VARCHAR))) AS INT), '0')"
_LPAD4 = "lpad(CAST({x} AS VARCHAR), CAST(greatest(4, length(CAST({x} AS VARCHAR))) AS INT), '0')"


@query(f"WITH {S} SELECT {_UID.format(x='sent')} AS uid, 'sentence' AS kind, pid, sent AS sent_lo, sent AS sent_hi, {PREFIX} || text AS text FROM s")
def units_sentence(spark, d):
    return units.sentence_units(sentences(spark, d))


@query(f"WITH {M} SELECT pid, sent, count(*) AS n FROM gold WHERE sent IS NOT NULL GROUP BY pid, sent HAVING count(*) >= 1")
def piece_keys_k(spark, d):
    return units.piece_keys(gold(spark, d).where("sent IS NOT NULL"), 1)


@query(f"WITH {M} SELECT {_UID.format(x='sent')} AS uid, 'piece' AS kind, pid, sent AS sent_lo, sent AS sent_hi, {PREFIX} || text AS text FROM s WHERE (pid, sent) IN (SELECT pid, sent FROM gold)")
def units_piece(spark, d):
    return units.piece_units(sentences(spark, d), gold(spark, d))


@query(f"""WITH {M}, k AS (SELECT DISTINCT pid, sent, 1 AS cut FROM gold), mk AS (SELECT s.*, coalesce(cut, 0) AS cut FROM s LEFT JOIN k USING (pid, sent) WHERE pid IN (SELECT pid FROM k)),
rn AS (SELECT *, sum(cut) OVER (PARTITION BY pid ORDER BY sent) AS run FROM mk), g AS (SELECT pid, run, cut, min(sent) AS lo, max(sent) AS hi, min(s) AS s, max(e) AS e FROM rn GROUP BY pid, run, cut)
SELECT {_UID.format(x='lo')} || CASE WHEN cut = 1 THEN '' ELSE '-' || lpad(CAST(hi AS VARCHAR), CAST(greatest(2, length(CAST(hi AS VARCHAR))) AS INT), '0') END AS uid, CASE WHEN cut = 1 THEN 'piece' ELSE 'segment' END AS kind, pid, lo AS sent_lo, hi AS sent_hi, md5({PREFIX} || substr(context, s + 1, e - s)) AS text
FROM g JOIN p USING (pid)
UNION ALL SELECT CAST(pid AS VARCHAR), 'paragraph', pid, 0, CAST((SELECT count(*) FROM s WHERE s.pid = p.pid) - 1 AS INT), md5({PREFIX} || context) FROM p WHERE pid NOT IN (SELECT pid FROM k)""")
def units_split(spark, d):
    keys = gold(spark, d).select("pid", "sent").distinct()
    return units.split_units(paragraphs(spark, d), sentences(spark, d), keys).withColumn("text", F.md5("text"))


@query(f"""WITH {M} SELECT kind, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'paragraph' AS kind, {PREFIX} || context AS text FROM p
UNION ALL SELECT 'piece', {PREFIX} || text FROM s WHERE (pid, sent) IN (SELECT pid, sent FROM gold)) GROUP BY kind""")
def units_oracle(spark, d):
    u = units.oracle_units(paragraphs(spark, d), sentences(spark, d), gold(spark, d))
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _crack_sql(extra: str) -> str:
    edge = r"E' \t\n,;:'"
    return f"""WITH {M}, sp AS (SELECT DISTINCT pid, start AS s, CAST(start + length(text) AS INT) AS e FROM a),
c AS (SELECT pid, 0 AS c FROM p UNION SELECT pid, length(context) FROM p UNION SELECT pid, s FROM sp UNION SELECT pid, e FROM sp {extra}),
t AS (SELECT pid, c, lead(c) OVER (PARTITION BY pid ORDER BY c) AS d FROM c), x AS (SELECT pid, title, c, substr(context, c + 1, d - c) AS t FROM t JOIN p USING (pid) WHERE d IS NOT NULL),
y AS (SELECT pid, title, CAST(c + length(t) - length(ltrim(t, {edge})) AS INT) AS s, CAST(c + length(rtrim(t, {edge})) AS INT) AS e, trim(t, {edge}) AS bare FROM x WHERE regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))
SELECT CAST(pid AS VARCHAR) || 'c' || {_LPAD4.format(x='y.s')} || '-' || {_LPAD4.format(x='y.e')} AS uid, CASE WHEN sp.s IS NULL THEN 'segment' ELSE 'piece-phrase' END AS kind, pid, y.s, y.e, md5({PREFIX} || bare) AS text
FROM y LEFT JOIN sp USING (pid, s, e)"""


def _answer_spans(spark, d):
    return answers(spark, d).select("pid", F.col("start").cast("int").alias("s"), (F.col("start") + F.length("text")).cast("int").alias("e"), F.lit("phrase").alias("level")).distinct()


@query(_crack_sql(""))
def units_cracked(spark, d):
    return units.crack_units(paragraphs(spark, d), _answer_spans(spark, d)).withColumn("text", F.md5("text"))


@query(_crack_sql("UNION SELECT pid, s FROM s UNION SELECT pid, e FROM s"))
def units_cracked_sentbase(spark, d):
    return units.crack_units(paragraphs(spark, d), _answer_spans(spark, d), sentences(spark, d)).withColumn("text", F.md5("text"))


def _evidence(spark, d):
    return answers(spark, d).select("pid", "qid", "ord", F.col("start").cast("int").alias("s"), (F.col("start") + F.length("text")).cast("int").alias("e"))


# Spans join groups, and groups are locked, in order: each paragraph is walked by recursion.
_OVERLAPS = "(least(x.e, ev.e) - greatest(x.s, ev.s)) >= 0.7 * (greatest(x.e, ev.e) - least(x.s, ev.s))"
EVIDENCE = f"""ev AS (SELECT pid, qid, CAST(start AS INT) AS s, CAST(start + length(text) AS INT) AS e, row_number() OVER (PARTITION BY pid ORDER BY qid, ord) AS k FROM a),
gr(pid, k, gs, g, qid) AS (SELECT pid, 1::BIGINT, [{{'s': s, 'e': e}}], 0, qid FROM ev WHERE k = 1
  UNION ALL SELECT pid, k, CASE WHEN hit > 0 THEN gs ELSE list_append(gs, {{'s': s, 'e': e}}) END, CAST(CASE WHEN hit > 0 THEN hit - 1 ELSE len(gs) END AS INT), qid
  FROM (SELECT ev.*, gr.gs, coalesce(list_position(list_transform(gr.gs, lambda x: {_OVERLAPS}), true), 0) AS hit FROM gr JOIN ev ON ev.pid = gr.pid AND ev.k = gr.k + 1)),
la AS (SELECT pid, arg_max(gs, k) AS gs FROM gr GROUP BY pid),
eg AS (SELECT pid, g, gs[g + 1].s AS s, gs[g + 1].e AS e, CAST(n AS INT) AS n FROM (SELECT pid, g, count(DISTINCT qid) AS n FROM gr GROUP BY pid, g) JOIN la USING (pid))"""


@query(f"WITH RECURSIVE {P}, {A}, {EVIDENCE} SELECT pid, g, s, e, n FROM eg")
def evidence_groups(spark, d):
    return units.evidence_groups(_evidence(spark, d), 1)


@query(f"""WITH RECURSIVE {S}, {A}, {EVIDENCE}, eo AS (SELECT pid, s, e, row_number() OVER (PARTITION BY pid ORDER BY n DESC, e - s, g) AS r FROM eg),
lk(pid, r, kept) AS (SELECT pid, 1::BIGINT, [{{'s': s, 'e': e}}] FROM eo WHERE r = 1
  UNION ALL SELECT eo.pid, eo.r, CASE WHEN len(list_filter(kept, lambda x: NOT (eo.e <= x.s OR eo.s >= x.e))) > 0 THEN kept ELSE list_append(kept, {{'s': eo.s, 'e': eo.e}}) END FROM lk JOIN eo ON eo.pid = lk.pid AND eo.r = lk.r + 1),
lo AS (SELECT pid, x.s AS s, x.e AS e FROM (SELECT pid, unnest(arg_max(kept, r)) AS x FROM lk GROUP BY pid)),
ci AS (SELECT pid, s AS c FROM s WHERE pid IN (SELECT pid FROM lo) UNION SELECT pid, e FROM s WHERE pid IN (SELECT pid FROM lo)),
c AS (SELECT pid, 0 AS c FROM lo UNION SELECT pid, length(context) FROM p WHERE pid IN (SELECT pid FROM lo) UNION SELECT pid, s FROM lo UNION SELECT pid, e FROM lo
  UNION SELECT pid, c FROM ci WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.pid = ci.pid AND ci.c > lo.s AND ci.c < lo.e)),
t AS (SELECT pid, c, lead(c) OVER (PARTITION BY pid ORDER BY c) AS d FROM c), x AS (SELECT pid, title, c, substr(context, c + 1, d - c) AS t FROM t JOIN p USING (pid) WHERE d IS NOT NULL),
y AS (SELECT pid, title, CAST(c + length(t) - length(ltrim(t, E' \\t\\n,;:')) AS INT) AS s, CAST(c + length(rtrim(t, E' \\t\\n,;:')) AS INT) AS e, trim(t, E' \\t\\n,;:') AS bare FROM x WHERE regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))
SELECT CAST(pid AS VARCHAR) || 'e' || {_LPAD4.format(x='y.s')} || '-' || {_LPAD4.format(x='y.e')} AS uid, CASE WHEN lo.s IS NULL THEN 'segment' ELSE 'evidence' END AS kind, pid, y.s, y.e, {PREFIX} || bare AS text
FROM y LEFT JOIN lo USING (pid, s, e)""")
def units_evidence(spark, d):
    return units.evidence_units(paragraphs(spark, d), sentences(spark, d), units.evidence_groups(_evidence(spark, d), 1))


# --- retrieval


def _search_units(spark, d):
    return paragraphs(spark, d).select(F.col("pid").alias("uidx"), F.concat(X.title_prefix(F.col("title")), F.col("context")).alias("search_text"), F.col("title").alias("doc"))


U = f"u AS (SELECT pid AS uidx, {PREFIX} || context AS search_text, title AS doc FROM p)"
BM = f"{P}, {Q}, {U}, " + bm25_sql("u", "q", 100)


@query(f"WITH {BM} SELECT * FROM bm")
def bm25_topk(spark, d):
    return ranking.bm25(_search_units(spark, d), questions(spark, d), 100)


def _vector_queries(spark, d):
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def _vector_units(spark, d):
    return vectors(spark, d).select(F.col("id").alias("uidx"), "v")


DENSE = f"""vq AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), vu AS (SELECT vec_id AS uidx, embedding AS v FROM embeddings),
ds AS (SELECT qid, uidx, {COS.format(a='v', b='q')} AS score FROM vq, vu WHERE qid <> uidx),
dn AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, uidx) AS INT) AS rank, uidx, score FROM ds) WHERE rank <= 50)"""


@query(f"WITH {DENSE} SELECT * FROM dn")
def dense_topk(spark, d):
    return ranking.dense(_vector_units(spark, d), _vector_queries(spark, d), 50, not_own=True)


RRF = """fu AS (SELECT qid, uidx, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT qid, uidx, rank, 1.0 AS w FROM bm UNION ALL SELECT qid, uidx, rank, 1.0 FROM dn) GROUP BY qid, uidx),
rr AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, uidx) AS INT) AS rank, uidx, score FROM fu) WHERE rank <= 100)"""


@query(f"WITH {BM}, {DENSE}, {RRF} SELECT * FROM rr")
def rrf_fuse(spark, d):
    return ranking.rrf([(bm25_topk(spark, d), 1.0), (dense_topk(spark, d), 1.0)])


PRIOR = f"""pa AS (SELECT label AS uidx, embedding AS v FROM embeddings), px AS (SELECT qid, uidx, max({COS.format(a='v', b='q')}) AS score FROM pa, vq GROUP BY qid, uidx HAVING max({COS.format(a='v', b='q')}) >= 0.2),
pr AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, uidx) AS INT) AS rank, CAST(uidx AS BIGINT) AS uidx, score FROM px)"""


@query(f"WITH {DENSE}, {PRIOR} SELECT * FROM pr")
def query_prior(spark, d):
    past = vectors(spark, d).select(F.col("grp").cast("long").alias("uidx"), "v")
    return ranking.question_prior(past, _vector_queries(spark, d), 0.2)


@query(f"""WITH {BM}, {DENSE}, {PRIOR}, fu AS (SELECT qid, uidx, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT qid, uidx, rank, 1.0 AS w FROM bm UNION ALL SELECT qid, uidx, rank, 1.0 FROM dn UNION ALL SELECT qid, uidx, rank, 0.5 FROM pr) GROUP BY qid, uidx)
SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, uidx) AS INT) AS rank, uidx, score FROM fu) WHERE rank <= 100""")
def hybrid_search_prior(spark, d):
    return ranking.rrf([(bm25_topk(spark, d), 1.0), (dense_topk(spark, d), 1.0), (query_prior(spark, d), 0.5)])


@query(f"WITH {BM}, f AS (SELECT qid, uidx % 50 AS target, min(rank) AS first FROM bm GROUP BY qid, uidx % 50) SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) AS INT) AS rank, target FROM f) WHERE rank <= 20")
def first_hits(spark, d):
    return ranking.first_hits(bm25_topk(spark, d).withColumn("target", F.col("uidx") % 50), 20)


RE = f"""re AS (SELECT qid, uidx, rank AS old_rank, CASE WHEN rank <= 20 THEN {OVERLAP.format(a='question', b='search_text')} END AS x FROM bm JOIN u USING (uidx) JOIN q USING (qid)),
rk AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY x IS NULL, x DESC, old_rank) AS INT) AS rank, uidx, old_rank FROM re)"""


@query(f"WITH {BM}, {RE} SELECT * FROM rk")
def rerank_overlap(spark, d):
    return ranking.rerank(bm25_topk(spark, d), _search_units(spark, d), questions(spark, d), 20)


@query(f"WITH {BM}, qd AS (SELECT qid, 'src' || CAST(qid % 20 AS VARCHAR) AS doc FROM q) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS rank, uidx FROM bm JOIN u USING (uidx) JOIN qd USING (qid, doc)")
def doc_scope(spark, d):
    docs = questions(spark, d).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("doc"))
    return ranking.scoped(bm25_topk(spark, d), _search_units(spark, d).select("uidx", "doc"), docs)


@query(f"""WITH {S}, {Q}, {U}, {bm25_sql('u', 'q', 5)}, k AS (SELECT qid, rank, pid, sent, text FROM bm JOIN s ON s.pid = bm.uidx JOIN q USING (qid) WHERE {OVERLAP.format(a='question', b='text')} >= 2)
SELECT qid, rank, pid, count(*) AS n_kept, md5(string_agg(text, ' ' ORDER BY sent)) AS kept FROM k GROUP BY qid, rank, pid""")
def prune_sentences(spark, d):
    top = bm25_topk(spark, d).where(F.col("rank") <= 5).select("qid", "rank", F.col("uidx").alias("pid"))
    return ranking.kept_sentences(top, sentences(spark, d), questions(spark, d), 2).withColumn("kept", F.md5("kept"))


PACK = f"""su AS (SELECT row_number() OVER (ORDER BY pid, sent) AS x, pid * 100000 + sent AS uidx, {PREFIX} || text AS search_text FROM s)"""
BUDGETS = [64, 128, 256]
PK = f"""nt AS (SELECT qid, rank, uidx, len({TOKENS.format(t='search_text')}) AS n_tok FROM bm JOIN su USING (uidx)),
co AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid ORDER BY rank) > 1 THEN 1 ELSE 0 END AS sep FROM nt), cu AS (SELECT *, sum(n_tok + sep) OVER (PARTITION BY qid ORDER BY rank) AS used FROM co),
pk AS (SELECT qid, budget, rank, uidx, CASE WHEN used <= budget THEN n_tok ELSE budget - (used - n_tok - sep) - sep END AS taken, used > budget AS truncated FROM cu, (SELECT unnest({BUDGETS}) AS budget)
  WHERE used <= budget OR (used - n_tok - sep <= budget AND budget - (used - n_tok - sep) - sep > 0))"""


def _packed(spark, d, depth: int = 50):
    s = units.sentence_units(sentences(spark, d)).select((F.col("pid") * 100000 + F.col("sent_lo")).alias("uidx"), "pid", "sent_lo", F.col("text").alias("search_text"))
    ranked = ranking.bm25(s, questions(spark, d), depth).join(s, "uidx").withColumn("n_tok", F.size(X.tokens(F.col("search_text"))).cast("long"))
    return ranking.pack(ranked, BUDGETS), s


@query(f"WITH {S}, {Q}, {PACK}, {bm25_sql('su', 'q', 50)}, {PK} SELECT qid, budget, rank, uidx, CAST(taken AS BIGINT) AS taken, truncated FROM pk")
def pack_budget(spark, d):
    return _packed(spark, d)[0]


@query(f"""WITH {BM}, w AS (SELECT qid, rank, uidx, uidx % 100 AS pid, uidx % 3 = 0 AS whole FROM bm), f AS (SELECT *, first_value(whole) OVER (PARTITION BY qid, pid ORDER BY rank) AS lead FROM w)
SELECT qid, rank, uidx, pid, whole FROM f WHERE whole = lead""")
def pack_overlap(spark, d):
    ranked = bm25_topk(spark, d).select("qid", "rank", "uidx", (F.col("uidx") % 100).alias("pid"), (F.col("uidx") % 3 == 0).alias("whole"))
    return ranking.drop_overlaps(ranked)


@query(f"""WITH {M}, {Q}, {PACK}, {bm25_sql('su', 'q', 50)}, {PK}, g AS (SELECT a.qid, a.pid, {NORM.format(t='a.text')} AS gold FROM a WHERE ord = 0),
said AS (SELECT qid, budget, pid, {NORM.format(t="string_agg(text, ' ' ORDER BY sent, text)")} AS said FROM pk JOIN s ON s.pid * 100000 + s.sent = pk.uidx WHERE NOT truncated GROUP BY qid, budget, pid)
SELECT g.qid, b.budget, coalesce(gold <> '' AND contains(said, gold), false) AS located FROM g CROSS JOIN (SELECT unnest({BUDGETS}) AS budget) b LEFT JOIN said ON said.qid = g.qid AND said.budget = b.budget AND said.pid = g.pid""")
def answer_questions(spark, d):
    """Flagship: sentences, BM25, packing, and whether the packed sentences hold the answer."""
    packed, _ = _packed(spark, d)
    texts = sentences(spark, d).select((F.col("pid") * 100000 + F.col("sent")).alias("uidx"), "pid", F.col("sent").alias("pos"), "text")
    parts = packed.where("NOT truncated").join(texts, "uidx").select(F.struct("qid", "budget").alias("key"), "pid", "pos", "text")
    golds = answers(spark, d).where("ord = 0").select("qid", "pid", F.col("text").alias("gold"), F.explode(F.array(*[F.lit(b) for b in BUDGETS])).alias("budget"))
    return metrics.answer_located(parts, golds.select(F.struct("qid", "budget").alias("key"), "pid", "gold")).select("key.qid", "key.budget", "located")


@query(f"WITH {BM}, {A} SELECT a.qid, coalesce(bool_or({NORM.format(t='a.text')} <> '' AND contains({NORM.format(t='context')}, {NORM.format(t='a.text')})), false) AS located FROM a LEFT JOIN bm ON bm.qid = a.qid AND bm.uidx = a.pid AND rank <= 5 LEFT JOIN p ON p.pid = bm.uidx WHERE ord = 0 GROUP BY a.qid")
def answer_located(spark, d):
    """Does the answer's own paragraph stand among the first five?"""
    parts = bm25_topk(spark, d).where(F.col("rank") <= 5).join(paragraphs(spark, d).withColumnRenamed("pid", "uidx"), "uidx").select(F.col("qid").alias("key"), F.col("uidx").alias("pid"), F.col("rank").alias("pos"), F.col("context").alias("text"))
    golds = answers(spark, d).where("ord = 0").select(F.col("qid").alias("key"), "pid", F.col("text").alias("gold"))
    return metrics.answer_located(parts, golds).select(F.col("key").alias("qid"), "located")


from tessella.plans import catalog_graph, catalog_metrics  # noqa: E402,F401  (they register their queries here)
