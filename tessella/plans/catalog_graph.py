"""Queries of entity resolution and of the concept graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import entities, graph, ranking
from tessella.operators.components import connected_components
from tessella.operators.numbering import number_rows
from tessella.plans import run
from tessella.plans.catalog import BM, BUDGETS, CONCEPT, COS, OVERLAP, P, PACK, PK, PREFIX, Q, S, TAU, U, _UID, _search_units, bm25_sql, bm25_topk, mapped, paragraphs, query, questions, sentences, vectors
from tessella.session import materialise, table

_FOUND = " UNION ALL ".join(f"SELECT pid, title AS article, '{label}' AS label, '{X.LABEL_GROUPS[label]}' AS grp, regexp_extract_all(context, '{pattern}') AS x, regexp_split_to_array(context, '{pattern}') AS gaps FROM p" for label, pattern in entities.PATTERNS.items())
MN = f"""{P}, each AS (SELECT pid, article, label, grp, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS text, unnest(gaps[1:len(x)]) AS gap FROM ({_FOUND})),
found AS (SELECT pid, article, text, grp, CAST(coalesce(sum(length(gap) + length(text)) OVER (PARTITION BY pid, label ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS INT) AS s FROM each),
nm AS (SELECT *, s + length(text) AS e, {CONCEPT.format(t='text')} AS norm FROM found),
mn AS (SELECT *, lpad(CAST(pid AS VARCHAR), 12, '0') || ':' || lpad(CAST(row_number() OVER (PARTITION BY pid ORDER BY s, e, grp) AS VARCHAR), 6, '0') AS mid FROM nm WHERE norm <> '')"""


def mention_rows(spark, d):
    return entities.mentions(paragraphs(spark, d))


@query(f"WITH {MN} SELECT mid, pid, article, s, CAST(e AS INT) AS e, text, grp, norm FROM mn")
def mentions(spark, d):
    return mention_rows(spark, d).select("mid", "pid", "article", "s", "e", "text", "grp", "norm")


EX = f"{MN}, ex AS (SELECT mid, min(mid) OVER (PARTITION BY norm, grp) AS root FROM mn)"


@query(f"WITH {EX} SELECT * FROM ex")
def er_exact(spark, d):
    return entities.exact_tier(mention_rows(spark, d))


# Prose has few aliases: lots of four parts have two full names, a last word and initials.
_INITCAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
AL = f"""{MN}, lots AS (SELECT 1000000000 + p_partkey AS pid, 'lot' || CAST(p_partkey // 4 AS VARCHAR) AS article, 'thing' AS grp,
CASE p_partkey % 4 WHEN 2 THEN string_split({_INITCAP}, ' ')[-1] WHEN 3 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') ELSE {_INITCAP} END AS text FROM part),
am AS (SELECT mid, article, text, grp, norm FROM mn UNION ALL SELECT lpad(CAST(pid AS VARCHAR), 12, '0') || ':000001', article, text, grp, {CONCEPT.format(t='text')} FROM lots)"""
_UPPER = "text = upper(text) AND text <> lower(text)"
_ACRONYM = r"array_to_string(list_transform(list_filter(regexp_split_to_array({t}, '\s+'), lambda x: regexp_matches(x, '^\p{{Lu}}')), lambda x: substr(x, 1, 1)), '')"


def alias_rows(spark, d):
    name = F.initcap("p_name")
    text = F.when(F.col("p_partkey") % 4 == 2, F.element_at(F.split(name, " "), -1)).when(F.col("p_partkey") % 4 == 3, X.acronym(name)).otherwise(name)
    lots = table(spark, d, "part").select((F.lit(1_000_000_000) + F.col("p_partkey")).alias("pid"), F.concat(F.lit("lot"), F.expr("p_partkey div 4").cast("string")).alias("article"), F.lit(0).alias("s"), text.alias("text"), F.lit("thing").alias("grp"))
    lots = entities.with_ids(lots.withColumn("e", F.length("text")).withColumn("norm", X.normalize_concept(F.col("text"))))
    return mention_rows(spark, d).unionByName(lots)


@query(f"""WITH {AL}, lo AS (SELECT article, norm, min(mid) AS mid, arg_min(text, mid) AS text, arg_min(grp, mid) AS grp FROM am WHERE norm LIKE '% %' GROUP BY article, norm),
sh AS (SELECT article, grp, text, norm, min(mid) AS mid, {_UPPER} AND length(text) BETWEEN 2 AND 6 AS short_upper FROM am WHERE norm NOT LIKE '% %' OR ({_UPPER}) GROUP BY article, grp, text, norm),
c AS (SELECT sh.mid AS short, lo.mid AS long, 'acronym' AS rule FROM sh JOIN lo USING (article) WHERE short_upper AND sh.text = {_ACRONYM.format(t='lo.text')}
UNION ALL SELECT sh.mid, lo.mid, 'short form' FROM sh JOIN lo USING (article, grp) WHERE NOT short_upper AND grp IN ('person', 'org', 'place', 'group', 'thing') AND (sh.norm = string_split(lo.norm, ' ')[-1] OR (grp = 'person' AND sh.norm = string_split(lo.norm, ' ')[1])))
SELECT short, min(long) AS long, min(rule) AS rule FROM c GROUP BY short HAVING count(*) = 1 AND short <> min(long)""")
def er_alias(spark, d):
    return entities.alias_tier(alias_rows(spark, d))


SIM = f"""e AS (SELECT vec_id AS id, label AS grp, embedding AS v FROM embeddings), pc AS (SELECT a.id AS i, b.id AS j, a.grp AS g, b.grp AS h, {COS.format(a='a.v', b='b.v')} AS cos FROM e a, e b WHERE a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) AS r FROM pc WHERE cos >= {TAU}), sim AS (SELECT i, j, cos FROM ranked WHERE r <= 10 AND i < j AND g = h)"""


def _pairs(spark, d):
    return entities.similar_pairs(vectors(spark, d), TAU)


@query(f"WITH {SIM} SELECT * FROM sim")
def sim_join_topk(spark, d):
    return _pairs(spark, d)


_FACTS = "CAST(vec_id % 3 + 10 AS VARCHAR) || CASE WHEN vec_id % 7 = 0 THEN ' not' ELSE ' units' END"


def _told(spark, d):
    """Vectors with a made-up text of a number and perhaps a negation."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.expr(_FACTS.replace("VARCHAR", "STRING")).alias("text"))


@query(f"WITH {SIM}, t AS (SELECT vec_id AS id, {_FACTS} AS text FROM embeddings) SELECT i, j, cos FROM sim JOIN t a ON a.id = i JOIN t b ON b.id = j WHERE a.text = b.text OR (regexp_extract(a.text, '[0-9]+') = regexp_extract(b.text, '[0-9]+') AND contains(a.text, 'not') = contains(b.text, 'not'))")
def er_guarded(spark, d):
    """Pairs that may merge by meaning: equal numbers, equally negated."""
    return entities.guarded(_pairs(spark, d), _told(spark, d))


# Merges one after another: the state of the recursion is the root of every id, as ids are 0 to n - 1.
_ADDED = "list_reduce(list_transform(list_filter(vs, lambda x: r[x.id + 1] = {root}), lambda x: x.v), lambda x, y: list_transform(list_zip(x, y), lambda z: z[1] + z[2]))"
_NEAR = f"list_dot_product({_ADDED.format(root='ra')}, {_ADDED.format(root='rb')}) / sqrt(list_dot_product({_ADDED.format(root='ra')}, {_ADDED.format(root='ra')}) * list_dot_product({_ADDED.format(root='rb')}, {_ADDED.format(root='rb')})) >= {TAU}"


@query(f"""WITH RECURSIVE {SIM}, t AS (SELECT vec_id AS id, {_FACTS} AS text FROM embeddings), gd AS (SELECT i, j, cos FROM sim JOIN t a ON a.id = i JOIN t b ON b.id = j WHERE a.text = b.text),
pp AS MATERIALIZED (SELECT i, j, row_number() OVER (ORDER BY cos DESC, i DESC, j DESC) AS k FROM gd), al AS MATERIALIZED (SELECT list({{'id': id, 'v': CAST(v AS DOUBLE[])}}) AS vs, max(id) + 1 AS n FROM e),
st(k, r) AS (SELECT 0::BIGINT, list_transform(range(0, n), lambda x: x) FROM al UNION ALL SELECT k, CASE WHEN ra = rb THEN r WHEN {_NEAR} THEN list_transform(r, lambda x: CASE WHEN x = rb THEN ra ELSE x END) ELSE r END
  FROM (SELECT pp.k, r, vs, least(r[i + 1], r[j + 1]) AS ra, greatest(r[i + 1], r[j + 1]) AS rb FROM st JOIN pp ON pp.k = st.k + 1, al))
SELECT id, r[id + 1] AS root FROM (SELECT DISTINCT unnest([i, j]) AS id FROM gd), (SELECT arg_max(r, k) AS r FROM st)""")
def er_meaning(spark, d):
    return entities.meaning_tier(_told(spark, d), _pairs(spark, d), TAU)


@query(f"""WITH RECURSIVE {SIM}, ed AS (SELECT i AS a, j AS b FROM sim UNION SELECT j, i FROM sim), reach(a, b) AS (SELECT a, a FROM ed UNION SELECT r.a, e2.b FROM reach r JOIN ed e2 ON e2.a = r.b)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def components(spark, d):
    return connected_components(_pairs(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query(f"WITH {EX}, c AS (SELECT root, count(*) AS n FROM ex GROUP BY root) SELECT count(*) AS clusters, max(n) AS largest, sum(CAST(n = 1 AS INT)) AS singletons, sum(n) AS mentions FROM c")
def er_cluster_stats(spark, d):
    sizes = er_exact(spark, d).groupBy("root").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.sum((F.col("n") == 1).cast("int")).alias("singletons"), F.sum("n").alias("mentions"))


@query(f"WITH {EX} SELECT root, count(DISTINCT pid) AS paragraphs FROM ex JOIN mn USING (mid) GROUP BY root ORDER BY paragraphs DESC, root LIMIT 15")
def er_hubs(spark, d):
    """A report of the 15 concepts that most paragraphs mention."""
    return er_exact(spark, d).join(mention_rows(spark, d), "mid").groupBy("root").agg(F.countDistinct("pid").alias("paragraphs")).orderBy(F.desc("paragraphs"), "root").limit(15)


@query(f"""WITH {S}, {MN[len(P) + 2:]}, x AS (SELECT mid, pid, mn.s, e, (SELECT min(sent) FROM s WHERE s.pid = mn.pid AND s.e > mn.s) AS sent FROM mn)
SELECT mid, coalesce(s.text, substr(context, CAST(greatest(x.s - 150, 0) + 1 AS INT), CAST(x.e + 150 - greatest(x.s - 150, 0) AS INT))) AS around FROM x JOIN p USING (pid) LEFT JOIN s ON s.pid = x.pid AND s.sent = x.sent""")
def mention_context(spark, d):
    return entities.contexts(mention_rows(spark, d), paragraphs(spark, d))


@query(f"""WITH {MN}, f AS (SELECT norm, grp, pid, min(mid) AS mid FROM mn GROUP BY norm, grp, pid), k AS (SELECT *, row_number() OVER (PARTITION BY norm, grp ORDER BY md5(mid), mid) AS r FROM f),
x AS (SELECT a.norm, a.grp, a.mid AS a, b.mid AS b FROM k a JOIN k b ON a.norm = b.norm AND a.grp = b.grp AND a.mid < b.mid AND a.r <= 4 AND b.r <= 4)
SELECT norm, grp, a, b FROM (SELECT *, row_number() OVER (PARTITION BY norm, grp ORDER BY md5(a || '|' || b), a, b) AS r FROM x) WHERE r <= 3""")
def cand_exact(spark, d):
    return entities.exact_candidates(mention_rows(spark, d))


_FIRST = "(SELECT article, norm, min(mid) AS mid, arg_min(text, mid) AS text, arg_min(grp, mid) AS grp FROM am WHERE {w} GROUP BY article, norm)"


@query(f"""WITH {AL}, lo AS {_FIRST.format(w="norm LIKE '% %'")}, sh AS {_FIRST.format(w=f"norm NOT LIKE '% %' OR ({_UPPER})")}
SELECT DISTINCT sh.mid AS short, lo.mid AS long FROM sh JOIN lo USING (article) WHERE ({_UPPER.replace('text', 'sh.text')} AND length(sh.text) BETWEEN 2 AND 6 AND sh.text = {_ACRONYM.format(t='lo.text')})
OR (sh.grp = lo.grp AND (sh.norm = string_split(lo.norm, ' ')[-1] OR sh.norm = string_split(lo.norm, ' ')[1]))""")
def cand_alias(spark, d):
    return entities.alias_candidates(alias_rows(spark, d))


@query(f"WITH {SIM} SELECT i, j, cos, 'embed:' || CAST(least(floor((cos - 0.35) / 0.05), 3) AS INT) AS stratum FROM sim")
def cand_embed(spark, d):
    return _pairs(spark, d).withColumn("stratum", F.concat(F.lit("embed:"), F.least(F.floor((F.col("cos") - 0.35) / 0.05), F.lit(3)).cast("int").cast("string")))


@query("""WITH n AS (SELECT greatest(1, 100 // count(DISTINCT (event_type, user_id % 4))) AS per FROM events)
SELECT id, event_type FROM (SELECT event_id AS id, event_type, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM events), n WHERE r <= per""")
def stratified_sample(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", (F.col("user_id") % 4).alias("band"))
    return entities.stratified_sample(rows, ["event_type", "band"], 100).select("id", "event_type")


_VERDICT = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type IN ('click', 'view') THEN 'SAME' WHEN event_type = 'error' THEN 'DIFFERENT' ELSE 'RELATED' END"
_TRUTH = "CASE WHEN user_id % 5 < 2 THEN 'SAME' WHEN user_id % 5 = 2 THEN 'DIFFERENT' ELSE 'RELATED' END"


@query(f"""WITH r AS (SELECT {_VERDICT} AS pred, {_TRUTH} AS gold FROM events), l AS (SELECT unnest(['SAME', 'RELATED', 'DIFFERENT']) AS label)
SELECT label, (SELECT round(avg(CASE WHEN pred = gold THEN 1.0 WHEN pred IS NULL THEN NULL ELSE 0.0 END), 6) FROM r) AS accuracy, (SELECT count(*) FROM r WHERE pred IS NULL) AS unparsed,
(SELECT round(count(*) FILTER (pred = label AND gold = label) / nullif(count(*) FILTER (pred = label), 0), 6) FROM r) AS precision, (SELECT round(count(*) FILTER (pred = label AND gold = label) / nullif(count(*) FILTER (gold = label), 0), 6) FROM r) AS recall FROM l""")
def verdict_score(spark, d):
    return entities.verdict_scores(table(spark, d, "events").select(F.expr(_VERDICT).alias("pred"), F.expr(_TRUTH).alias("gold")))


_MERGES = "CASE WHEN {g} IN ('person', 'org', 'place', 'group', 'thing') THEN true WHEN {g} = 'time' THEN regexp_matches(lower({t}), '" + X.DATED + "') AND NOT regexp_matches(lower({t}), '" + X.RELATIVE + "') ELSE false END"
_GROUP = "CASE doc_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'time' ELSE 'number' END"


@query(f"SELECT doc_id, {_MERGES.replace('{g}', _GROUP).replace('{t}', 'text')} AS merges FROM documents")
def merge_by_string(spark, d):
    return table(spark, d, "documents").select("doc_id", X.merges_by_string(F.col("text"), F.expr(_GROUP)).alias("merges"))


_KEY = "CASE WHEN norm NOT LIKE '% %' AND grp IN ('person', 'org', 'thing') THEN {c} ELSE '' END"


@query(f"""WITH {MN}, k AS (SELECT mid, norm, grp, {_KEY.format(c='article')} AS art FROM mn), v AS (SELECT DISTINCT norm, grp, art FROM k WHERE hash_no(mid) AND grp IN ('person', 'org', 'place', 'group', 'thing'))
SELECT mid, norm, grp FROM k WHERE (norm, grp, art) NOT IN (SELECT norm, grp, art FROM v)""".replace("hash_no(mid)", "substr(md5(mid), 1, 1) = '0'"))
def veto_keys(spark, d):
    k = mention_rows(spark, d).select("mid", "norm", "grp", F.expr(_KEY.format(c="article")).alias("art"))
    vetoed = k.where(F.substring(F.md5("mid"), 1, 1) == "0").where(F.col("grp").isin(*X.NAMED_GROUPS)).select("norm", "grp", "art").distinct()
    return k.join(vetoed, ["norm", "grp", "art"], "left_anti").select("mid", "norm", "grp")


_MAJORITY = "CASE WHEN 2 * len(list_filter(range(0, n), lambda i: r[i + 1] = {c} AND i % 2 = {c} % 2)) >= len(list_filter(r, lambda x: x = {c})) THEN {c} % 2 ELSE 1 - {c} % 2 END"


@query(f"""WITH RECURSIVE {SIM}, fb AS (SELECT list({{'a': i, 'b': j}}) AS f FROM (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) AS r FROM pc WHERE cos >= {TAU - 0.05}) WHERE r <= 10 AND i < j AND g = h AND (i + j) % 5 = 0)),
pp AS MATERIALIZED (SELECT i, j, row_number() OVER (ORDER BY CAST(-round(cos * 1000000) AS BIGINT), i, j) AS k FROM sim), al AS MATERIALIZED (SELECT coalesce(f, []) AS f, (SELECT max(id) + 1 FROM e) AS n FROM fb),
st(k, r) AS (SELECT 0::BIGINT, list_transform(range(0, n), lambda x: x) FROM al
  UNION ALL SELECT k, CASE WHEN ra = rb OR len(list_filter(f, lambda x: least(r[x.a + 1], r[x.b + 1]) = ra AND greatest(r[x.a + 1], r[x.b + 1]) = rb)) > 0 OR {_MAJORITY.format(c='ra')} <> {_MAJORITY.format(c='rb')} THEN r
    ELSE list_transform(r, lambda x: CASE WHEN x = rb THEN ra ELSE x END) END
  FROM (SELECT pp.k, r, f, n, least(r[i + 1], r[j + 1]) AS ra, greatest(r[i + 1], r[j + 1]) AS rb FROM st JOIN pp ON pp.k = st.k + 1, al))
SELECT id, r[id + 1] AS root FROM e, (SELECT arg_max(r, k) AS r FROM st)""")
def constrained_merge(spark, d):
    v = vectors(spark, d)
    pairs = _pairs(spark, d)
    proposals = pairs.select((-F.round(F.col("cos") * 1_000_000)).cast("long").alias("ord"), F.col("i").alias("a"), F.col("j").alias("b"))
    forbidden = entities.similar_pairs(v, TAU - 0.05).where("(i + j) % 5 = 0").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return graph.constrained_merge(v.select("id", (F.col("id") % 2).cast("string").alias("kind")), proposals, forbidden)


@query(f"""WITH {EX}, t AS (SELECT root, text, count(*) AS n, min(mid) AS first FROM ex JOIN mn USING (mid) GROUP BY root, text), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, first, text) AS r FROM t)
SELECT root, min_by(text, r) AS name, string_agg(text, '|' ORDER BY r) FILTER (r <= 8) AS aliases, CAST(sum(n) AS BIGINT) AS n_mentions FROM r GROUP BY root""")
def concepts(spark, d):
    m = mention_rows(spark, d)
    return graph.concept_nodes(m, entities.exact_tier(m))


HOLDS = f"{EX}, ho AS (SELECT DISTINCT root AS concept, CAST(pid AS VARCHAR) AS uid, pid FROM ex JOIN mn USING (mid))"


def _rooted(spark, d, *columns):
    """Mentions, found once, with the first mention of the same norm and group as their concept."""
    m = materialise(mention_rows(spark, d).select("mid", "pid", "norm", "grp", *columns), "rooted-mentions")
    roots = m.groupBy("norm", "grp").agg(F.min("mid").alias("concept"))
    return m.select("norm", "grp", "pid", *columns).distinct().join(roots, ["norm", "grp"]).select("concept", "pid", *columns)


def _holds(spark, d):
    return _rooted(spark, d).select("concept", F.col("pid").cast("string").alias("uid"), "pid")


@query(f"""WITH {S}, {EX[len(P) + 2:]}, o AS (SELECT mid, pid, s AS a FROM mn)
SELECT DISTINCT s.pid, s.sent, root AS concept FROM o JOIN ex USING (mid) JOIN s ON s.pid = o.pid AND s.s <= o.a AND o.a < s.e""")
def mention_edges(spark, d):
    return _in_sentences(_rooted(spark, d, "s"), sentences(spark, d).select("pid", "sent", "s", "e"), "sent")


def _in_sentences(rooted, spans, name):
    """(pid, the sentence's name, concept): a mention stands in the sentence that it begins in."""
    held = rooted.select("pid", F.col("s").alias("a"), "concept").join(spans, "pid").where("s <= a AND a < e")
    return held.select("pid", name, "concept").distinct()


@query(f"WITH {S}, u AS (SELECT pid, s, CAST(pid AS VARCHAR) || ':' || CAST(sent AS VARCHAR) AS uid FROM s) SELECT * FROM (SELECT uid AS a, lead(uid) OVER (PARTITION BY pid ORDER BY s) AS b FROM u) WHERE b IS NOT NULL")
def adjacent_edges(spark, d):
    return graph.adjacent(sentences(spark, d).select("pid", "s", F.concat_ws(":", F.col("pid").cast("string"), F.col("sent").cast("string")).alias("uid")))


@query(f"WITH {P}, u AS (SELECT title, pid, CAST(pid AS VARCHAR) AS uid FROM p) SELECT * FROM (SELECT uid AS a, lead(uid) OVER (PARTITION BY title ORDER BY pid) AS b FROM u) WHERE b IS NOT NULL")
def adjacency(spark, d):
    return graph.adjacent(paragraphs(spark, d).select("title", "pid", F.lit(0).alias("s"), F.col("pid").cast("string").alias("uid")), within="title")


REL = "rel AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM sim WHERE i <> j)"


@query(f"WITH {SIM}, {REL} SELECT * FROM rel")
def related_edges(spark, d):
    return graph.undirected(_pairs(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query(f"WITH {SIM}, {REL} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM rel UNION ALL SELECT b FROM rel) GROUP BY node")
def node_degree(spark, d):
    return graph.degrees(related_edges(spark, d))


CW = f"{HOLDS}, cw AS (SELECT concept, round(1 / ln(2 + count(DISTINCT pid)), 6) AS weight FROM ho GROUP BY concept HAVING count(DISTINCT pid) <= 50)"


@query(f"WITH {CW} SELECT * FROM cw")
def concept_weight(spark, d):
    return graph.concept_weights(_holds(spark, d))


@query(f"""WITH {MN}, {Q}, al AS (SELECT DISTINCT norm AS alias, norm || '/' || grp AS concept FROM mn), w AS (SELECT qid, regexp_split_to_array({CONCEPT.format(t='question')}, ' ') AS w FROM q),
g AS (SELECT DISTINCT qid, array_to_string(w[i:i + n - 1], ' ') AS alias FROM (SELECT qid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest(range(1, 7)) AS n) WHERE len(w) >= n))
SELECT DISTINCT qid, concept FROM g JOIN al USING (alias) WHERE length(alias) > 1""")
def question_concepts(spark, d):
    aliases = mention_rows(spark, d).select(F.col("norm").alias("alias"), F.concat("norm", F.lit("/"), "grp").alias("concept")).distinct()
    return graph.question_concepts(questions(spark, d), aliases)


def _pagerank_sql(rounds: int) -> str:
    steps = ", ".join(f"""x{i} AS (SELECT qid, node, sum(x) AS x FROM (SELECT qid, st.b AS node, x * p * 0.5 AS x FROM x{i - 1} n JOIN st ON st.a = n.node UNION ALL SELECT qid, node, x * 0.5 FROM x0) GROUP BY qid, node)""" for i in range(1, rounds + 1))
    return f"""WITH {SIM}, {REL}, bo AS (SELECT a, b FROM rel UNION ALL SELECT b, a FROM rel), st AS MATERIALIZED (SELECT a, b, 1.0 / count(*) OVER (PARTITION BY a) AS p FROM bo),
sd AS (SELECT vec_id AS qid, vec_id AS node, 1.0 AS x FROM embeddings WHERE vec_id % 20 = 0 AND vec_id IN (SELECT a FROM bo)), x0 AS MATERIALIZED (SELECT qid, node, CAST(x AS DOUBLE) AS x FROM sd), {steps} SELECT qid, node, round(x, 8) AS score FROM x{rounds}"""


@query(_pagerank_sql(30))
def ppr_scores(spark, d):
    edges = materialise(related_edges(spark, d).withColumn("w", F.lit(1.0)), "related")
    seeds = vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("id").alias("node"), F.lit(1.0).alias("x"))
    known = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.pagerank(edges, seeds.join(known, "node", "left_semi").select("qid", "node", "x"))


HOP = f"""{CW}, {Q}, {U}, {BM[BM.index('c AS (SELECT uidx'):]}, sd AS (SELECT qid, CAST(uidx AS VARCHAR) AS uid, uidx AS pid FROM bm WHERE rank <= 3),
re AS (SELECT sd.qid, sd.uid AS seed, h2.uid, round(sum(weight), 6) AS weight FROM (SELECT DISTINCT qid, sd.uid, concept FROM sd JOIN ho USING (uid)) sd JOIN cw USING (concept) JOIN ho h2 ON h2.concept = sd.concept
  WHERE NOT EXISTS (SELECT 1 FROM sd z WHERE z.qid = sd.qid AND z.pid = h2.pid AND z.uid IN (SELECT uid FROM ho)) GROUP BY sd.qid, sd.uid, h2.uid),
h2 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, seed ORDER BY weight DESC, uid) AS INT) AS rank FROM re) WHERE rank <= 20)"""


@query(f"WITH {HOP} SELECT qid, seed, uid, weight, rank FROM h2")
def hop2_candidates(spark, d):
    return _hops(spark, d)[1]


def _hops(spark, d):
    """The three best paragraphs of each question (qid, uid, r), and the second hops from them; searched and read for concepts once."""
    first = materialise(bm25_topk(spark, d).where(F.col("rank") <= 3).select("qid", F.col("uidx").cast("string").alias("uid"), F.col("rank").alias("r")), "hop-first")
    holds = materialise(_holds(spark, d), "hop-holds")
    return first, graph.second_hop(holds, graph.concept_weights(holds), first.select("qid", "uid"))


@query(f"""WITH {HOP}, al AS (SELECT qid, uid, CAST(bm2.rank AS INT) * 10 AS o FROM sd JOIN (SELECT qid, CAST(uidx AS VARCHAR) AS uid, rank FROM bm) bm2 USING (qid, uid)
UNION ALL SELECT h2.qid, h2.uid, s2.rank * 10 + 1 FROM h2 JOIN (SELECT qid, CAST(uidx AS VARCHAR) AS seed, rank FROM bm) s2 USING (qid, seed) WHERE h2.rank = 1)
SELECT qid, uid, CAST(row_number() OVER (PARTITION BY qid ORDER BY min(o), uid) AS INT) AS rank FROM al GROUP BY qid, uid""")
def hop_interleave(spark, d):
    """Each seed, then its best candidate."""
    first, reached = _hops(spark, d)
    ranked = first.withColumnRenamed("uid", "seed")
    order = ranked.select("qid", F.col("seed").alias("uid"), (F.col("r") * 10).alias("o"))
    second = reached.where(F.col("rank") == 1).join(ranked, ["qid", "seed"]).select("qid", "uid", (F.col("r") * 10 + 1).alias("o"))
    return ranking.best(order.unionByName(second).groupBy("qid", "uid").agg(F.min("o").alias("o")), ["qid"], [F.col("o"), F.col("uid")], 1 << 30).select("qid", "uid", "rank")


@query(f"""WITH {HOP}, al AS (SELECT qid, CAST(uidx AS VARCHAR) AS uid, 1.0 / rank AS x FROM bm WHERE rank <= 3 UNION ALL SELECT qid, uid, weight FROM h2 WHERE rank <= 2)
SELECT qid, uid, CAST(row_number() OVER (PARTITION BY qid ORDER BY max(round(x, 6)) DESC, uid) AS INT) AS rank FROM al GROUP BY qid, uid""")
def hop_merge(spark, d):
    """Seeds and two candidates of each, by score."""
    first, reached = _hops(spark, d)
    first = first.select("qid", "uid", (1 / F.col("r")).alias("x"))
    second = reached.where(F.col("rank") <= 2).select("qid", "uid", F.col("weight").alias("x"))
    merged = first.unionByName(second).groupBy("qid", "uid").agg(F.max(F.round("x", 6)).alias("x"))
    return ranking.best(merged, ["qid"], [F.desc("x"), F.col("uid")], 1 << 30).select("qid", "uid", "rank")


BEAM_HOLDS = f"""{EX[len(P) + 2:]}, bh AS (SELECT DISTINCT root AS concept, s.pid * 100000 + s.sent AS uidx, s.pid FROM mn JOIN ex USING (mid) JOIN s ON s.pid = mn.pid AND s.s <= mn.s AND mn.s < s.e),
bw AS (SELECT concept, round(1 / ln(2 + count(DISTINCT pid)), 6) AS weight FROM bh GROUP BY concept HAVING count(DISTINCT pid) <= 50)"""


def _beam_sql(flat: bool, width: int = 3, depth: int = 2, candidates: int = 10, top: int = 30) -> str:
    """The rounds of a beam search written out, over sentences and their concepts."""
    out = f"""WITH {S}, {Q}, {PACK}, {bm25_sql('su', 'q', 50)}, {BEAM_HOLDS},
un AS MATERIALIZED (SELECT pid * 100000 + sent AS uidx, pid, s, text, {PREFIX} || text AS search_text FROM s),
nx AS (SELECT uidx AS a, lead(uidx) OVER (PARTITION BY pid ORDER BY s) AS b FROM un), mv AS MATERIALIZED (SELECT a, b FROM nx WHERE b IS NOT NULL UNION ALL SELECT b, a FROM nx WHERE b IS NOT NULL),
wh AS MATERIALIZED (SELECT concept, uidx, pid, weight FROM bh JOIN bw USING (concept)), rk AS MATERIALIZED (SELECT qid, rank, uidx FROM bm),
h0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s0 DESC, uidx DESC) AS r FROM (SELECT qid, uidx, {OVERLAP.format(a='question', b='search_text')} AS s0 FROM rk JOIN un USING (uidx) JOIN q USING (qid) WHERE rank <= {top})),
st0 AS MATERIALIZED (SELECT qid, question, r AS pos, [uidx] AS path, [pid] AS pids, text AS said, s0 AS score, false AS done FROM h0 JOIN un USING (uidx) JOIN q USING (qid) WHERE r <= {width})"""
    for i in range(1, depth + 1):
        st = f"st{i - 1}"
        floor = f"coalesce((SELECT max(s0) FROM h0 WHERE h0.qid = op{i}.qid AND h0.uidx NOT IN (SELECT unnest(path) FROM {st} t WHERE t.qid = op{i}.qid)), -1)" if flat else "0"
        out += f""",
ca{i} AS (SELECT qid, pos, b AS u, 'adjacent' AS kind FROM {st} JOIN mv ON mv.a = path[-1] WHERE NOT done UNION ALL SELECT qid, pos, u, 'concept' FROM (SELECT qid, pos, u, row_number() OVER (PARTITION BY qid, pos ORDER BY w DESC, u) AS k FROM
  (SELECT qid, pos, y.uidx AS u, round(sum(y.weight), 6) AS w FROM {st} t JOIN wh x ON x.uidx = t.path[-1] JOIN wh y ON y.concept = x.concept WHERE NOT done AND NOT list_contains(pids, y.pid) GROUP BY qid, pos, y.uidx)) WHERE k <= {candidates}),
op{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY gain DESC, u DESC, kind DESC) AS r FROM (SELECT qid, pos, u, kind, {OVERLAP.format(a="question || ' ' || right(said, 1200)", b='search_text')} AS gain
  FROM (SELECT qid, pos, u, max(kind) AS kind FROM ca{i} GROUP BY qid, pos, u) JOIN {st} t USING (qid, pos) JOIN un ON un.uidx = u WHERE NOT list_contains(path, u))),
fl{i} AS (SELECT DISTINCT qid, {floor} AS floor FROM op{i}), sp{i} AS MATERIALIZED (SELECT qid, pos, u, r, gain FROM op{i} JOIN fl{i} USING (qid) WHERE r <= {width} AND gain >= floor),
gr{i} AS (SELECT qid, question, pos, r, 1 AS late, list_append(path, u) AS path, list_append(pids, un.pid) AS pids, said || ' ' || un.text AS said, score + gain AS score, false AS done FROM sp{i} JOIN {st} USING (qid, pos) JOIN un ON un.uidx = u
  UNION ALL SELECT qid, question, pos, 0, CASE WHEN EXISTS (SELECT 1 FROM op{i} o WHERE o.qid = t.qid AND o.pos = t.pos) THEN 1 ELSE 0 END, path, pids, said, score, true FROM {st} t WHERE NOT EXISTS (SELECT 1 FROM sp{i} z WHERE z.qid = t.qid AND z.pos = t.pos)),
st{i} AS MATERIALIZED (SELECT qid, question, p2 AS pos, path, pids, said, score, done FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, late, pos, r) AS p2 FROM gr{i}) WHERE p2 <= {width})"""
    return out + f""", fin AS (SELECT qid, uidx, min((part * 1000000 + pos) * 1000 + i) AS o FROM (SELECT qid, 0 AS part, pos, unnest(range(0, len(path))) AS i, unnest(path) AS uidx FROM st{depth}
  UNION ALL SELECT qid, 1, r, 0, uidx FROM h0 UNION ALL SELECT qid, 2, rank, 0, uidx FROM rk) GROUP BY qid, uidx)
SELECT qid, rank, uidx FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY o) AS INT) AS rank, uidx FROM fin) WHERE rank <= 50"""


def _beam(spark, d, stop):
    s = sentences(spark, d)
    # The text is written once: the prefix is put before it as it is read.
    held = materialise(s.select((F.col("pid") * 100000 + F.col("sent")).alias("uidx"), "pid", "s", "title", "text"), "beam-units")
    units = held.select("uidx", "pid", "s", "text", F.concat(X.title_prefix(F.col("title")), F.col("text")).alias("search_text"))
    asked = questions(spark, d)
    ranked = materialise(ranking.bm25(units, asked, 50).select("qid", "rank", "uidx"), "beam-ranked")
    spans = held.select("pid", "uidx", "s", (F.col("s") + F.length("text")).alias("e"))
    holds = _in_sentences(_rooted(spark, d, "s"), spans, "uidx").select("concept", "uidx")
    paths, _ = graph.beam(units, ranked, asked, holds, stop=stop)
    return graph.along_paths(paths, ranked, units, asked, depth=50)


@query(_beam_sql(flat=False))
def beam_traverse(spark, d):
    """Sentences along paths of neighbours and shared concepts, then the reranked rest."""
    return _beam(spark, d, "fixed")


@query(_beam_sql(flat=True))
def beam_flat_stop(spark, d):
    """Steps must score as high as the best reranked sentence outside all paths."""
    return _beam(spark, d, "flat")


# --- methods as a whole


def corpus_of(spark, d) -> run.Corpus:
    """All paragraphs, all questions, and as past ones those whose item stands in a document."""
    past = mapped(spark, d).join(questions(spark, d), "qid").select("qid", "question", "pid", "ord", "start", F.col("question").alias("text"), F.col("start_sent").alias("sent"))
    return run.Corpus(paragraphs(spark, d), questions(spark, d), materialise(past, "past"))


@query(f"""WITH {S}, {Q}, {PACK}, {bm25_sql('su', 'q', 100)}, {PK} SELECT qid, budget, rank, {_UID.format(x='s.sent')} AS uid, CAST(taken AS BIGINT) AS taken, truncated FROM (SELECT * FROM pk) pk JOIN s ON s.pid * 100000 + s.sent = pk.uidx""".replace(_UID.format(x="s.sent"), _UID.format(x="s.sent").replace("CAST(pid", "CAST(s.pid")))
def method_b3(spark, d):
    """The method B3, as its id says: sentences, searched and packed."""
    return run.run("B3", corpus_of(spark, d), BUDGETS).select("qid", "budget", "rank", "uid", "taken", "truncated")


@query()
def method_runs(spark, d):
    """Split units reranked, and a beam over sentences that stops where it is flat."""
    held, out = corpus_of(spark, d), None
    for method in ("L-k1+R", "T-S-b3-d2-k10-sf"):
        part = run.run(method, held, BUDGETS).select(F.lit(method).alias("method"), "qid", "budget", "rank", "uid", "taken", "truncated")
        out = part if out is None else out.unionByName(part)
    return out


# --- the graph as a whole


def _judged(spark, d):
    """Candidates of equal strings with made-up verdicts."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("SAME", "SAME", "RELATED", "DIFFERENT")]), F.pmod(F.conv(F.substring(F.md5(F.concat("a", "b")), 1, 4), 16, 10).cast("int"), F.lit(4)) + 1)
    return entities.exact_candidates(mention_rows(spark, d)).select(F.lit("exact").alias("source"), F.lit(1.0).alias("cos"), "a", "b", label.alias("label"))


@query(f"""WITH {MN}, f AS (SELECT norm, grp, pid, min(mid) AS mid FROM mn GROUP BY norm, grp, pid), k AS (SELECT *, row_number() OVER (PARTITION BY norm, grp ORDER BY md5(mid), mid) AS r FROM f),
x AS (SELECT a.norm, a.grp, a.mid AS a, b.mid AS b FROM k a JOIN k b ON a.norm = b.norm AND a.grp = b.grp AND a.mid < b.mid AND a.r <= 4 AND b.r <= 4),
cd AS (SELECT grp, a, b, ['SAME', 'SAME', 'RELATED', 'DIFFERENT'][CAST('0x' || substr(md5(a || b), 1, 4) AS INT) % 4 + 1] AS label FROM (SELECT *, row_number() OVER (PARTITION BY norm, grp ORDER BY md5(a || '|' || b), a, b) AS r FROM x) WHERE r <= 3),
ky AS (SELECT mid, norm || chr(0) || grp || CASE WHEN grp IN ('person', 'org', 'thing') AND NOT contains(norm, ' ') THEN chr(0) || article ELSE '' END AS key FROM mn)
SELECT DISTINCT key FROM ky WHERE mid IN (SELECT unnest([a, b]) FROM cd WHERE label = 'DIFFERENT' AND grp IN ('person', 'org', 'place', 'group', 'thing'))""")
def graph_vetoes(spark, d):
    """String groups in which a named pair was judged different."""
    return _graph(spark, d)["vetoed"]


def _graph(spark, d):
    m = materialise(mention_rows(spark, d), "graph-mentions")
    u = sentences(spark, d).select("pid", "s", "e", F.concat_ws(":", F.col("pid").cast("string"), F.col("sent").cast("string")).alias("uid"))
    return graph.build(m, m.where("false").withColumn("grp", F.lit("fragment")), u, _judged(spark, d))


@query()
def graph_edges(spark, d):
    """All edges of the graph under vetoes and cannot-links."""
    return _graph(spark, d)["edges"]


@query(f"""WITH {S}, {AL[len(P) + 2:]}, {SIM}, ax AS (SELECT *, CAST(split_part(mid, ':', 1) AS BIGINT) AS pid FROM am), f AS (SELECT norm, grp, pid, min(mid) AS mid FROM ax GROUP BY norm, grp, pid),
k AS (SELECT *, row_number() OVER (PARTITION BY norm, grp ORDER BY md5(mid), mid) AS r FROM f), pr AS (SELECT a.norm, a.grp, a.mid AS a, b.mid AS b FROM k a JOIN k b ON a.norm = b.norm AND a.grp = b.grp AND a.mid < b.mid AND a.r <= 4 AND b.r <= 4),
lo AS {_FIRST.format(w="norm LIKE '% %'")}, sh AS {_FIRST.format(w=f"norm NOT LIKE '% %' OR ({_UPPER})")}, nu AS (SELECT mid, row_number() OVER (ORDER BY mid) - 1 AS id FROM am),
cd AS (SELECT 'exact' AS source, grp, 1.0 AS cos, a, b FROM (SELECT *, row_number() OVER (PARTITION BY norm, grp ORDER BY md5(a || '|' || b), a, b) AS r FROM pr) WHERE r <= 3
UNION ALL SELECT 'alias', grp, NULL, long, short FROM (SELECT DISTINCT sh.mid AS short, sh.grp AS grp, lo.mid AS long FROM sh JOIN lo USING (article) WHERE ({_UPPER.replace('text', 'sh.text')} AND length(sh.text) BETWEEN 2 AND 6 AND sh.text = {_ACRONYM.format(t='lo.text')})
  OR (sh.grp = lo.grp AND (sh.norm = string_split(lo.norm, ' ')[-1] OR sh.norm = string_split(lo.norm, ' ')[1])))
UNION ALL SELECT 'embed', CAST(e.grp AS VARCHAR), cos, x.mid, y.mid FROM sim JOIN e ON e.id = i JOIN nu x ON x.id = i JOIN nu y ON y.id = j),
cx AS (SELECT mid, pid, mn.s, e, (SELECT min(sent) FROM s WHERE s.pid = mn.pid AND s.e > mn.s) AS sent FROM mn),
ar AS (SELECT mid, coalesce(s.text, substr(context, CAST(greatest(cx.s - 150, 0) + 1 AS INT), CAST(cx.e + 150 - greatest(cx.s - 150, 0) AS INT))) AS around FROM cx JOIN p USING (pid) LEFT JOIN s ON s.pid = cx.pid AND s.sent = cx.sent)
SELECT source, cd.grp, CAST(cos AS DOUBLE) AS cos, a, b, x.around AS a_around, y.around AS b_around FROM cd JOIN ar x ON x.mid = a JOIN ar y ON y.mid = b""")
def candidates_all(spark, d):
    """Every pair to be judged, with contexts: equal strings, aliases, and similar vectors, whose nodes stand for mentions by number."""
    m = materialise(alias_rows(spark, d), "cand-mentions")
    some = number_rows(m.select("mid"), [F.col("mid")], "id")
    return entities.candidates(m, paragraphs(spark, d), vectors(spark, d).join(some, "id"), TAU)
