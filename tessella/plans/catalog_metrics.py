"""Queries of splits, answer metrics, summaries and parses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import corpus, metrics, parse, ranking
from tessella.plans.catalog import BM, M, NORM, Q, S, TOKENS, U, answers, bm25_sql, bm25_topk, gold, items, mapped, paragraphs, query, sentences
from tessella.session import materialise, table

# --- splits

_ORDER = "row_number() OVER (ORDER BY md5('13|{tag}|' || CAST(id AS VARCHAR)), id) - 1"
SPLIT = f"""ids AS (SELECT DISTINCT doc_id AS id FROM documents), o AS (SELECT id, {_ORDER.format(tag='past')} AS place FROM ids), np AS (SELECT round_even(count(*) * 0.7, 0) AS n FROM ids),
old AS (SELECT id, {_ORDER.format(tag='tuning')} AS place FROM o, np WHERE place < n), nt AS (SELECT round_even(count(*) * 0.1, 0) AS n FROM old), new AS (SELECT id, {_ORDER.format(tag='pilot')} AS place FROM o, np WHERE place >= n),
sp AS (SELECT id, CASE WHEN place < n THEN 'tuning' ELSE 'build' END AS part, false AS is_pilot FROM old, nt UNION ALL SELECT id, 'future', place < 200 FROM new)"""


def _ids(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"))


@query(f"WITH {SPLIT} SELECT * FROM sp")
def split_questions(spark, d):
    return metrics.split_questions(_ids(spark, d))


@query(f"WITH {SPLIT} SELECT phase, id FROM sp, (SELECT unnest(['tuning', 'final']) AS phase) WHERE CASE phase WHEN 'tuning' THEN part = 'build' ELSE part IN ('build', 'tuning') END")
def reference_questions(spark, d):
    """Past questions that may shape units and priors, while tuning and in the final run."""
    split = split_questions(spark, d)
    return metrics.reference_questions(split, "tuning").select(F.lit("tuning").alias("phase"), "id").unionByName(metrics.reference_questions(split, "future").select(F.lit("final").alias("phase"), "id"))


@query(f"""WITH {M}, k AS (SELECT DISTINCT pid, sent FROM gold WHERE qid % 2 = 0) SELECT b.item_id AS qid, CASE WHEN g.sent IS NULL THEN 'unmapped' WHEN k.sent IS NOT NULL THEN 'covered' ELSE 'uncovered' END AS bucket
FROM benchmark b LEFT JOIN gold g ON g.qid = b.item_id LEFT JOIN k ON k.pid = g.pid AND k.sent = g.sent""")
def overlap_buckets(spark, d):
    g = gold(spark, d)
    asked = items(spark, d).select("qid").join(g, "qid", "left")
    return metrics.overlap_buckets(asked, g.where("qid % 2 = 0").select("pid", "sent"))


@query(f"WITH ids AS (SELECT DISTINCT doc_id AS id FROM documents), o AS (SELECT id, {_ORDER.format(tag='nested')} AS place FROM ids) SELECT size, count(*) AS n, min(id) AS least, max(id) AS greatest FROM o, (SELECT unnest([100, 200, 400]) AS size) WHERE place < size GROUP BY size")
def nested_samples(spark, d):
    """Prefixes of one order: each sample holds the smaller ones."""
    order = metrics.hash_order(_ids(spark, d), 13, "nested")
    each = order.withColumn("size", F.explode(F.array(F.lit(100), F.lit(200), F.lit(400)))).where("place < size")
    return each.groupBy("size").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"))


# --- answer metrics

_PRED = r"regexp_replace(text, '^\S+\s+', '')"
F1 = f"""x AS (SELECT item_id AS qid, {TOKENS.format(t=NORM.format(t=_PRED))} AS p, {TOKENS.format(t=NORM.format(t='text'))} AS t FROM benchmark),
y AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda a: a = w)), len(list_filter(t, lambda a: a = w))))) AS same FROM x)"""


@query(f"WITH {F1} SELECT qid, CASE WHEN p = t THEN 1.0 ELSE 0.0 END AS em, round(CASE WHEN len(p) = 0 OR len(t) = 0 THEN CAST(len(p) = len(t) AS INT) ELSE 2.0 * same / (len(p) + len(t)) END, 6) AS f1 FROM y")
def em_f1(spark, d):
    guess = F.regexp_replace("text", r"^\S+\s+", "")
    return items(spark, d).select("qid", metrics.exact_match(guess, F.col("text")).alias("em"), F.round(metrics.token_f1(guess, F.col("text")), 6).alias("f1"))


@query(f"WITH {M}, t AS (SELECT g.qid, {NORM.format(t='s.text')} AS gold FROM gold g JOIN s USING (pid, sent)), {Q}, {U}, {bm25_sql('u', 'q', 3)} SELECT t.qid, rank, contains({NORM.format(t='search_text')}, gold) AS hit FROM t JOIN bm USING (qid) JOIN u USING (uidx)")
def evidence_hit(spark, d):
    said = gold(spark, d).join(sentences(spark, d), ["pid", "sent"]).select("qid", X.normalize_answer(F.col("text")).alias("gold"))
    top = bm25_topk(spark, d).where(F.col("rank") <= 3).join(paragraphs(spark, d).withColumnRenamed("pid", "uidx"), "uidx")
    context = F.concat(X.title_prefix(F.col("title")), F.col("context"))
    return top.join(said, "qid").select("qid", "rank", F.contains(X.normalize_answer(context), F.col("gold")).alias("hit"))


@query(f"WITH {BM} SELECT bm.qid, max(contains(search_text, b.text)) AS hit FROM bm JOIN u USING (uidx) JOIN benchmark b ON b.item_id = bm.qid WHERE rank <= 5 GROUP BY bm.qid")
def answer_in_context(spark, d):
    top = bm25_topk(spark, d).where(F.col("rank") <= 5).join(paragraphs(spark, d).withColumnRenamed("pid", "uidx"), "uidx").join(items(spark, d), "qid")
    return top.groupBy("qid").agg(F.max(F.contains(F.concat(X.title_prefix(F.col("title")), F.col("context")), F.col("text"))).alias("hit"))


@query(f"WITH {M}, {Q}, {U}, {bm25_sql('u', 'q', 100)} SELECT a.qid, k AS depth, bool_and(bm.uidx IS NOT NULL) AS located FROM a CROSS JOIN (SELECT unnest([5, 20, 100]) AS k) LEFT JOIN bm ON bm.qid = a.qid AND bm.uidx = a.pid AND bm.rank <= k GROUP BY a.qid, k")
def support_located(spark, d):
    found = answers(spark, d).select("qid", "pid", F.explode(F.array(F.lit(5), F.lit(20), F.lit(100))).alias("depth"))
    ranked = bm25_topk(spark, d).select("qid", F.col("uidx").alias("pid"), "rank")
    return found.join(ranked, ["qid", "pid"], "left").groupBy("qid", "depth").agg(F.every(F.coalesce(F.col("rank") <= F.col("depth"), F.lit(False))).alias("located"))


@query(f"WITH {M}, {Q}, {U}, {bm25_sql('u', 'q', 100)} SELECT qid, k, round(count(DISTINCT CASE WHEN rank <= k THEN pid END) / count(DISTINCT pid), 6) AS recall FROM (SELECT a.qid, a.pid, rank, unnest([2, 5, 10]) AS k FROM a LEFT JOIN bm ON bm.qid = a.qid AND bm.uidx = a.pid) GROUP BY qid, k")
def recall_at_k(spark, d):
    held = answers(spark, d).select("qid", "pid").join(bm25_topk(spark, d).select("qid", F.col("uidx").alias("pid"), "rank"), ["qid", "pid"], "left")
    each = held.withColumn("k", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10))))
    return each.groupBy("qid", "k").agg(F.round(F.countDistinct(F.when(F.col("rank") <= F.col("k"), F.col("pid"))) / F.countDistinct("pid"), 6).alias("recall"))


@query(f"""WITH {M}, {Q}, {U}, {bm25_sql('u', 'q', 100)}, h AS (SELECT a.qid, CASE WHEN a.qid % 2 = 0 THEN 'bridge' ELSE 'comparison' END AS type, ord + 1 AS hop, rank FROM a LEFT JOIN bm ON bm.qid = a.qid AND bm.uidx = a.pid),
g AS (SELECT qid, type, max(CASE WHEN hop = 1 THEN coalesce(rank <= 3, false) END) AS f, max(coalesce(rank, 1073741824)) AS w FROM h GROUP BY qid, type)
SELECT type, count(*) AS n, round(avg(CAST(f AS INT)), 6) AS first_hop_top3, round(avg(CAST(w <= 10 AS INT)), 6) AS both_top10, round(avg(CAST(w <= 30 AS INT)), 6) AS both_top30, round(avg(CAST(w <= 100 AS INT)), 6) AS both_top100 FROM g GROUP BY type""")
def hop_coverage(spark, d):
    ranked = bm25_topk(spark, d).select("qid", F.col("uidx").alias("pid"), "rank")
    ranks = answers(spark, d).join(ranked, ["qid", "pid"], "left").select("qid", F.when(F.col("qid") % 2 == 0, "bridge").otherwise("comparison").alias("type"), (F.col("ord") + 1).alias("hop"), "rank")
    return metrics.hop_coverage(ranks)


@query(f"WITH {M}, {Q}, {U}, {bm25_sql('u', 'q', 1)} SELECT round(avg(CAST(contains(context, b.text) AS INT)), 6) AS top1 FROM bm JOIN p ON p.pid = bm.uidx JOIN benchmark b ON b.item_id = bm.qid")
def top1_has_answer(spark, d):
    top = bm25_topk(spark, d).where(F.col("rank") == 1).join(paragraphs(spark, d).withColumnRenamed("pid", "uidx"), "uidx").join(items(spark, d), "qid")
    return top.agg(F.round(F.avg(F.contains("context", "text").cast("int")), 6).alias("top1"))


@query(f"WITH {M}, u AS (SELECT 'sentence' AS kind, len({TOKENS.format(t='text')}) AS n_tok FROM s UNION ALL SELECT 'paragraph', len({TOKENS.format(t='context')}) FROM p) SELECT kind, count(*) AS n_units, sum(n_tok) AS n_tokens FROM u GROUP BY kind")
def index_sizes(spark, d):
    each = sentences(spark, d).select(F.lit("sentence").alias("kind"), F.size(X.tokens(F.col("text"))).alias("n"))
    each = each.unionByName(paragraphs(spark, d).select(F.lit("paragraph").alias("kind"), F.size(X.tokens(F.col("context"))).alias("n")))
    return each.groupBy("kind").agg(F.count("*").alias("n_units"), F.sum("n").alias("n_tokens"))


# --- summaries of an evaluation log

EV = "ev AS (SELECT event_id AS id, event_type AS method, user_id % 4 AS budget, CASE WHEN user_id % 3 = 0 THEN 'covered' ELSE 'uncovered' END AS bucket, value FROM events)"


def log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("budget"), F.when(F.col("user_id") % 3 == 0, "covered").otherwise("uncovered").alias("bucket"), "value")


@query(f"""WITH {EV} SELECT method, budget, CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE bucket END AS bucket, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95
FROM ev GROUP BY GROUPING SETS ((method, budget), (method, budget, bucket))""")
def summary_grouping_sets(spark, d):
    return metrics.summarize(log(spark, d), ["method", "budget"], "bucket", "value")


@query()
def paired_bootstrap(spark, d):
    e = log(spark, d)
    return metrics.bootstrap(e.select("id", "value", (F.col("value") * 0.9 + F.col("budget")).alias("other")), "value", "other", n_boot=10_000)


@query()
def ratio_ci(spark, d):
    e = log(spark, d)
    return metrics.bootstrap(e.select("id", "value", (F.col("value") / 4).alias("other")), "value", "other", "ratio", n_boot=10_000)


GRID = f"""{EV}, gr AS (SELECT method, k, w, round(avg(CASE WHEN value / 100 > 0.5 + 0.01 * k - 0.1 * w THEN 1.0 ELSE 0.0 END), 6) AS hit FROM ev, (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([0.0, 0.5, 1.0]) AS w) GROUP BY method, k, w)"""


@query(f"WITH {GRID}, b AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY hit DESC, w, k) AS r FROM gr) SELECT b.method, b.k, CAST(b.w AS DOUBLE) AS w, b.hit, round(b.hit - z.hit, 6) AS gain FROM b JOIN (SELECT method, max(hit) AS hit FROM gr WHERE w = 0 GROUP BY method) z USING (method) WHERE r = 1")
def tune_argbest(spark, d):
    """A parameter grid is crossed with the log late; of equal hits the smaller weight wins, then the smaller k."""
    grid = log(spark, d).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).withColumn("w", F.explode(F.array(*[F.lit(w) for w in (0.0, 0.5, 1.0)])))
    hits = grid.groupBy("method", "k", "w").agg(F.round(F.avg((F.col("value") / 100 > 0.5 + 0.01 * F.col("k") - 0.1 * F.col("w")).cast("int")), 6).alias("hit"))
    best = hits.groupBy("method").agg(F.max_by(F.struct("k", "w", "hit"), F.struct("hit", -F.col("w"), -F.col("k"))).alias("b"), F.max(F.when(F.col("w") == 0, F.col("hit"))).alias("plain"))
    return best.select("method", "b.k", "b.w", "b.hit", F.round(F.col("b.hit") - F.col("plain"), 6).alias("gain"))


@query(f"WITH {EV}, m AS (SELECT method, budget, round(avg(value), 6) AS score FROM ev GROUP BY method, budget) SELECT budget, method, score FROM (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY score DESC, method) AS r FROM m) WHERE r = 1")
def select_best(spark, d):
    means = log(spark, d).groupBy("method", "budget").agg(F.round(F.avg("value"), 6).alias("score"))
    return ranking.best(means, ["budget"], [F.desc("score"), F.col("method")], 1).select("budget", "method", "score")


@query(f"WITH {EV} SELECT budget, method, count(*) AS n, round(avg(value), 6) AS mean FROM ev WHERE method = CASE WHEN budget < 2 THEN 'click' ELSE 'view' END GROUP BY budget, method")
def adaptive_policy(spark, d):
    chosen = log(spark, d).where(F.col("method") == F.when(F.col("budget") < 2, "click").otherwise("view"))
    return chosen.groupBy("budget", "method").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT count(*) AS n, round(avg(CAST(quality = 1 - toxic AS INT)), 6) AS agreement, count(*) FILTER (quality = 1 AND toxic = 1) AS false_positive, count(*) FILTER (quality = 0 AND toxic = 0) AS false_negative FROM labels")
def judge_agreement(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")), 6).alias("agreement"),
                                         F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("false_positive"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("false_negative"))


@query(f"""WITH {EV}, g AS (SELECT method, CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE bucket END AS bucket, budget, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS acc FROM ev GROUP BY GROUPING SETS ((method, budget), (method, budget, bucket)))
SELECT method, bucket, max(acc) FILTER (budget = 0) AS b0, max(acc) FILTER (budget = 1) AS b1, max(acc) FILTER (budget = 2) AS b2, max(acc) FILTER (budget = 3) AS b3 FROM g GROUP BY method, bucket""")
def accuracy_pivot(spark, d):
    right = log(spark, d).withColumn("right", (F.col("value") > 50).cast("double"))
    exact = right.groupingSets([[F.col("method"), F.col("budget")], [F.col("method"), F.col("budget"), F.col("bucket")]], F.col("method"), F.col("budget"), F.col("bucket")).agg(F.round(F.avg("right"), 6).alias("acc"), F.grouping("bucket").alias("g"))
    named = exact.withColumn("bucket", F.when(F.col("g") == 1, "all").otherwise(F.col("bucket")))
    return named.groupBy("method", "bucket").pivot("budget", [0, 1, 2, 3]).agg(F.max("acc")).select("method", "bucket", *[F.col(str(b)).alias(f"b{b}") for b in range(4)])


@query(f"WITH {EV} SELECT method, count(*) AS n, round(median(value), 4) AS median_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, round(sum(2 * 7e9 * value), 2) AS flops FROM ev GROUP BY method")
def cost_summary(spark, d):
    """Latency and arithmetic of a log of calls: two operations a parameter and token."""
    return log(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.round(F.median("value"), 4).alias("median_ms"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95_ms"), F.round(F.sum(F.lit(2 * 7e9) * F.col("value")), 2).alias("flops"))


# --- parses: a stand-in parser gives every token a head by rule, see operators.parse

TK = rf"""tk AS (SELECT pid, sent, i - 1 AS i, w, CASE WHEN i = 1 THEN 0 ELSE (i - 1) // 2 END AS head FROM (SELECT pid, sent, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS w FROM (SELECT pid, sent, {TOKENS.format(t='text')} AS x FROM s)))"""


@query(f"""WITH RECURSIVE {S}, {TK}, an(pid, sent, i, anc) AS (SELECT pid, sent, i, i FROM tk UNION SELECT an.pid, an.sent, an.i, tk.head FROM an JOIN tk ON tk.pid = an.pid AND tk.sent = an.sent AND tk.i = an.anc)
SELECT pid, sent, anc AS i, min(an.i) AS lo, max(an.i) AS hi, count(*) AS n FROM an GROUP BY pid, sent, anc""")
def parse_subtree_span(spark, d):
    return parse.subtree_spans(parse.toy_trees(sentences(spark, d))).select("pid", "sent", "i", "lo", "hi", "n")


# The stand-in parser in SQL: tokens with head, relation, part of speech and place, and every token's ancestors.
_RELATIONS = "[" + ", ".join(f"'{x}'" for x in parse.TOY_RELATIONS) + "]"
TF = rf"""tk AS MATERIALIZED (SELECT pid, sent, i - 1 AS i, w, CASE WHEN i = 1 THEN 0 ELSE (i - 1) // 2 END AS head, CASE WHEN i = 1 THEN 'ROOT' ELSE {_RELATIONS}[(i - 1) % 8 + 1] END AS dep,
CASE WHEN (i - 1) % 4 <= 1 THEN 'VERB' ELSE 'NOUN' END AS pos, NOT regexp_matches(w, '[\p{{L}}\p{{N}}]') AS punct, sb + coalesce(sum(length(w) + 1) OVER (PARTITION BY pid, sent ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
FROM (SELECT pid, sent, sb, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS w FROM (SELECT pid, sent, s AS sb, {TOKENS.format(t='text')} AS x FROM s))),
an(pid, sent, i, anc, depth) AS (SELECT pid, sent, i, i, 0 FROM tk UNION ALL SELECT an.pid, an.sent, an.i, tk.head, depth + 1 FROM an JOIN tk ON tk.pid = an.pid AND tk.sent = an.sent AND tk.i = an.anc AND tk.head <> tk.i),
hd AS (SELECT pid, sent, i AS anc, i = head AS root FROM tk WHERE i = head OR (dep = 'relcl' AND pos = 'VERB'))"""


@query(f"""WITH RECURSIVE {S}, {TF}, mi AS (SELECT pid, sent, i, arg_min(anc, depth) AS anc, arg_min(root, depth) AS root FROM an JOIN hd USING (pid, sent, anc) GROUP BY pid, sent, i),
wo AS (SELECT pid, sent, i, w, anc, root FROM mi JOIN tk USING (pid, sent, i) WHERE NOT punct), sm AS (SELECT pid, sent, anc, count(*) AS n FROM wo GROUP BY pid, sent, anc),
tp AS (SELECT pid, sent, min(CASE WHEN root THEN anc END) AS top FROM wo GROUP BY pid, sent),
kp AS (SELECT pid, sent, i, w, CASE WHEN n < 3 AND NOT root THEN coalesce(top, anc) ELSE anc END AS clause FROM wo JOIN sm USING (pid, sent, anc) JOIN tp USING (pid, sent))
SELECT pid, sent, clause, string_agg(w, ' ' ORDER BY i) AS key FROM kp GROUP BY pid, sent, clause""")
def clause_keys(spark, d):
    return parse.clause_keys(parse.toy_trees(sentences(spark, d)))


@query(f"""WITH RECURSIVE {S}, {TF}, cm(pid, sent, i, anc) AS (SELECT pid, sent, i, i FROM tk UNION ALL SELECT cm.pid, cm.sent, cm.i, tk.head FROM cm JOIN tk ON tk.pid = cm.pid AND tk.sent = cm.sent AND tk.i = cm.anc AND tk.head <> tk.i
  AND tk.dep IN ('compound', 'amod', 'nummod', 'flat', 'poss', 'npadvmod', 'quantmod')),
cw AS (SELECT cm.pid, cm.sent, cm.anc AS i, string_agg(w, ' ' ORDER BY cm.i) AS words FROM cm JOIN tk ON tk.pid = cm.pid AND tk.sent = cm.sent AND tk.i = cm.i GROUP BY cm.pid, cm.sent, cm.anc),
nt AS MATERIALIZED (SELECT pid, sent, i, head, dep, pos, w, words FROM tk JOIN cw USING (pid, sent, i)), ch AS (SELECT * FROM nt WHERE i <> head),
su AS (SELECT pid, sent, head AS v, arg_min(words, i) AS subject FROM ch WHERE dep IN ('nsubj', 'nsubjpass', 'csubj', 'expl') AND pos <> 'PRON' GROUP BY pid, sent, head),
ve AS (SELECT v.pid, v.sent, v.i AS v, v.w AS verb, coalesce(subject, CASE WHEN v.dep IN ('relcl', 'acl') THEN up.words END) AS subject FROM nt v LEFT JOIN su ON su.pid = v.pid AND su.sent = v.sent AND su.v = v.i
  LEFT JOIN nt up ON up.pid = v.pid AND up.sent = v.sent AND up.i = v.head WHERE v.pos IN ('VERB', 'AUX')),
ob AS (SELECT pid, sent, head AS v, words AS object FROM ch WHERE dep IN ('dobj', 'attr', 'oprd', 'acomp', 'dative')
  UNION ALL SELECT b.pid, b.sent, b.head, b.w || ' ' || o.words FROM ch b JOIN ch o ON o.pid = b.pid AND o.sent = b.sent AND o.head = b.i AND o.dep = 'pobj' WHERE b.dep IN ('prep', 'agent'))
SELECT DISTINCT pid, sent, concat_ws(' ', subject, verb, object) AS key FROM ve LEFT JOIN ob USING (pid, sent, v) WHERE object IS NOT NULL OR subject IS NOT NULL""")
def triple_keys(spark, d):
    return parse.triples(parse.toy_trees(sentences(spark, d)))


@query(f"""WITH RECURSIVE {M}, {TF}, aw AS (SELECT qid, pid, start AS a, start + length(text) AS b FROM a),
ht AS (SELECT qid, aw.pid, sent, i FROM aw JOIN tk ON tk.pid = aw.pid AND NOT punct AND tk.s < aw.b AND aw.a < tk.s + length(w)),
one AS (SELECT qid, pid, sent, count(DISTINCT i) AS k FROM ht GROUP BY qid, pid, sent QUALIFY sent = min(sent) OVER (PARTITION BY qid, pid)),
sh AS (SELECT qid, pid, sent, anc, arg_min(depth, i) AS depth FROM ht JOIN one USING (qid, pid, sent) JOIN an USING (pid, sent, i) GROUP BY qid, pid, sent, anc, k HAVING count(*) = k),
lc AS (SELECT qid, pid, sent, arg_min(anc, depth) AS lca FROM sh GROUP BY qid, pid, sent),
cl AS (SELECT qid, lc.pid, lc.sent, arg_min(an.anc, depth) AS top FROM lc JOIN an ON an.pid = lc.pid AND an.sent = lc.sent AND an.i = lca JOIN hd ON hd.pid = an.pid AND hd.sent = an.sent AND hd.anc = an.anc GROUP BY qid, lc.pid, lc.sent),
re AS (SELECT an.pid, an.sent, an.anc, min(s) AS s, max(s + length(w)) AS e FROM an JOIN tk ON tk.pid = an.pid AND tk.sent = an.sent AND tk.i = an.i WHERE an.pid IN (SELECT pid FROM aw) GROUP BY an.pid, an.sent, an.anc),
lv AS (SELECT qid, one.pid, 'sentence' AS level, s, e, 0 AS o FROM one JOIN re ON re.pid = one.pid AND re.sent = one.sent AND re.anc = 0
  UNION ALL SELECT qid, cl.pid, 'clause', s, e, 1 FROM cl JOIN re ON re.pid = cl.pid AND re.sent = cl.sent AND re.anc = top UNION ALL SELECT qid, lc.pid, 'phrase', s, e, 2 FROM lc JOIN re ON re.pid = lc.pid AND re.sent = lc.sent AND re.anc = lca)
SELECT qid, pid, level, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM (SELECT *, row_number() OVER (PARTITION BY qid, pid, s, e ORDER BY o) AS r FROM lv) WHERE r = 1""")
def answer_spans(spark, d):
    """Levels around each whole answer, in the first sentence that has a word of it."""
    found = materialise(answers(spark, d).select("qid", "pid", F.col("start").alias("a"), (F.col("start") + F.length("text")).alias("b")), "answer-spans")
    few = found.count() <= ranking.BROADCAST_TERMS
    pids = found.select("pid").distinct()
    held = corpus.explode_sentences(paragraphs(spark, d).join(F.broadcast(pids) if few else pids, "pid", "left_semi"))
    return parse.answer_spans(parse.toy_trees(held), found, broadcast=few)


@query(f"WITH {M} SELECT qid, pid, CAST(arg_min(start, ord) + length(arg_min(text, ord)) - length(ltrim(arg_min(text, ord), E' \t\n\r')) AS INT) AS s, CAST(arg_min(start, ord) + length(arg_min(rtrim(text, E' \t\n\r'), ord)) AS INT) AS e FROM a GROUP BY qid, pid")
def question_answer(spark, d):
    return parse.question_answer(answers(spark, d), paragraphs(spark, d))


@query(f"""WITH {M}, v AS (SELECT a.pid, 'phrase' AS level, start AS s, CAST(start + length(a.text) AS INT) AS e, qid FROM a UNION ALL SELECT m.pid, 'sentence', s.s, s.e, qid FROM m JOIN s ON s.pid = m.pid AND s.sent = m.start_sent),
c AS (SELECT pid, level, s, e, count(DISTINCT qid) AS n FROM v GROUP BY pid, level, s, e) SELECT pid, s, e, level, n FROM (SELECT *, row_number() OVER (PARTITION BY pid, s, e ORDER BY level) AS r FROM c) WHERE r = 1""")
def extracted_spans(spark, d):
    found = answers(spark, d)
    phrases = found.select("pid", F.lit("phrase").alias("level"), F.col("start").cast("int").alias("s"), (F.col("start") + F.length("text")).cast("int").alias("e"), "qid")
    golds = mapped(spark, d).select("pid", F.col("start_sent").alias("sent"), "qid").join(sentences(spark, d), ["pid", "sent"]).select("pid", F.lit("sentence").alias("level"), "s", "e", "qid")
    return parse.extracted_spans(phrases.unionByName(golds), {"sentence": 1, "clause": 1, "phrase": 1})


@query(f"""WITH {M}, w AS (SELECT pid, sent, title, text, string_split(text, ',') AS parts FROM s)
SELECT CAST(pid AS VARCHAR) || ':' || CAST(sent AS VARCHAR) || 's00' AS uid, 'sentence' AS kind, pid, replace(title, '_', ' ') || ': ' || text AS text, pid * 100000 + sent AS target FROM w
UNION ALL SELECT CAST(pid AS VARCHAR) || ':' || CAST(sent AS VARCHAR) || 'c' || lpad(CAST(j AS VARCHAR), CAST(greatest(2, length(CAST(j AS VARCHAR))) AS INT), '0'), 'clause', pid, replace(title, '_', ' ') || ': ' || key, pid * 100000 + sent
FROM (SELECT *, unnest(range(0, len(parts))) AS j, unnest(parts) AS key FROM w) WHERE (pid, sent) IN (SELECT pid, sent FROM gold)""")
def build_keys(spark, d):
    """Keys of every sentence, fine ones of the gold sentences; parts between commas stand for parsed clauses."""
    s = sentences(spark, d)
    u = s.select((F.col("pid") * 100000 + F.col("sent")).alias("uidx"), F.concat_ws(":", F.col("pid").cast("string"), F.col("sent").cast("string")).alias("uid"), "pid", "sent", "title", "text")
    parsed = s.select("pid", "sent", F.lit("clause").alias("type"), F.posexplode(F.split("text", ",")).alias("j", "key"))
    fine = gold(spark, d).select("pid", "sent").distinct()
    return parse.build_keys(u, parsed, ["sentence", "clause"], fine)
