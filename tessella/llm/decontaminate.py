"""Benchmark decontamination.

The windows of all test items (13 normalised words; a shorter item is one window)
become a hash set that is broadcast; training texts are scanned window by window,
and every hash hit is verified on the words themselves.

The broadcast is bounded: items are dealt to shards of at most ``shard_bytes`` of
text, and each shard is a pass of its own over the texts whose hits are united, so
any size of benchmark gives the whole result with the same memory.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; an item with a null id hits words but is not listed; repeated
items count once; repeated documents each get their row. Columns other than the
named ones are passed through by ``remove`` and ignored by ``scan_hits``.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm._words import ALNUM, as_bytes, chunks, rolling, scan, window_starts
from tessella.session import lean, materialise

WINDOW = 13
#: Bytes of item text whose windows one broadcast holds.
SHARD_BYTES = 16 << 20
#: A document is contaminated from one hit word in so many.
CONTAMINATED_ONE_IN = 20

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


class WindowSet:
    """Windows of some items, as arrays: hashes to look up, places in the items' text to verify words at, items to report.

    It takes about six bytes for each byte of item text.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.items = [i for i, _ in items]
        self.chunk = chunk = scan([(text or "").encode() for _, text in items], ALNUM)
        counts, owner = np.diff(chunk.first), chunk.owner()
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        self.tables = {}
        for n in np.unique(np.minimum(window, counts[counts > 0])).tolist():
            mine = (counts >= window) if n == window else (counts == n)
            at = np.flatnonzero(window_starts(chunk.first, n, len(chunk.starts)))
            at = at[mine[owner[at]]]
            hashes = rolling(chunk.hashes, n)[at]
            order = np.argsort(hashes, kind="stable")
            at, hashes = at[order], hashes[order]
            new = np.append(True, hashes[1:] != hashes[:-1])
            starts = np.flatnonzero(new)
            # Windows of equal hashes are one entry if their words are equal, as they nearly always are.
            for a, size in zip(starts.tolist(), np.diff(np.append(starts, len(at))).tolist()):
                if size > 1:
                    phrases = sorted((chunk.phrase(i, n), i) for i in at[a : a + size].tolist())
                    at[a : a + size] = [i for _, i in phrases]
                    for k in range(1, size):
                        new[a + k] = phrases[k][0] != phrases[k - 1][0]
            entries = np.flatnonzero(new)
            self.by_length[n] = hashes[entries], at.astype(np.int32), np.append(entries, len(at)), owner[at].astype(np.int32)
            self.tables[n] = np.zeros(1 << 20, bool)
            self.tables[n][(hashes >> np.uint64(44)).astype(np.int64)] = True
        # Hashes are not looked at again.
        chunk.hashes = chunk.hashes[:0]

    def hits(self, chunk) -> Iterator[tuple[int, int, set]]:
        """(first word, words, item ids) of every verified window in a chunk."""
        total = len(chunk.starts)
        for n, (known, places, ends, owners) in self.by_length.items():
            found = rolling(chunk.hashes, n)
            maybe = self.tables[n][(found >> np.uint64(44)).astype(np.int64)] & window_starts(chunk.first, n, total)
            at = np.flatnonzero(maybe)
            for i, h, e in zip(at.tolist(), found[at], np.searchsorted(known, found[at]).tolist()):
                while e < len(known) and known[e] == h:
                    if self.chunk.phrase(int(places[ends[e]]), n) == chunk.phrase(i, n):
                        yield i, n, {self.items[k] for k in owners[ends[e] : ends[e + 1]].tolist()}
                        break
                    e += 1


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan_batches(windows, text_col: str, keep):
    """A mapInArrow function: adds n_words, items and hit word spans to the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = windows.value
        for batch in batches:
            texts = as_bytes(batch.column(text_col))
            n_words, items, spans, cuts = [], [], [], []
            for a, b in chunks(texts):
                chunk = scan(texts[a:b], ALNUM)
                per_text: dict[int, list] = defaultdict(list)
                hits = list(table.hits(chunk))
                owners = np.searchsorted(chunk.first, [i for i, _, _ in hits], side="right") - 1 if hits else []
                for (i, n, ids), owner in zip(hits, owners):
                    per_text[int(owner)].append((i, i + n, ids))
                counts = np.diff(chunk.first)
                for k in range(b - a):
                    own = per_text.get(k, ())
                    base, offset = int(chunk.first[k]), int(chunk.offsets[k])
                    merged = _merge([(x, y) for x, y, _ in own])
                    n_words.append(int(counts[k]))
                    items.append(sorted({x for _, _, ids in own for x in ids if x is not None}))
                    spans.append([[x - base, y - base] for x, y in merged])
                    cuts.append([[int(chunk.starts[x]) - offset, int(chunk.ends[y - 1]) - offset] for x, y in merged])
            yield keep(batch, texts, n_words, items, spans, cuts)

    return run


def _shards(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int):
    """Lists of items of at most ``shard_bytes`` of text each; one shard is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // shard_bytes) or 1
    if n == 1:
        yield [(r.i, r.t) for r in rows.collect()]
        return
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(2 * n)))
    for k in range(2 * n):
        yield [(r.i, r.t) for r in rows.where(F.col("shard") == k).collect()]


def _columns(names: list[str]):
    """A keeper of the named columns of: id, key, n_words, items, spans."""
    kinds = {"items": pa.list_(pa.int64()), "spans": pa.list_(pa.list_(pa.int64())), "n_words": pa.int64()}

    def keep(batch, _texts, n_words, items, spans, _cuts):
        made = {"n_words": n_words, "items": items, "spans": spans}
        return pa.RecordBatch.from_arrays([pa.array(made[n], kinds[n]) if n in made else batch.column(n) for n in names], names=names)

    return keep


def scan_hits(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (ids of hitting items), spans (hit words as [first, end))."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    fields = {f.name: f for f in [*source.schema.fields, *HITS.fields]}

    def one_pass(shard: list, names: list[str]) -> DataFrame:
        windows = spark.sparkContext.broadcast(WindowSet(shard, window))
        return source.mapInArrow(lean(_scan_batches(windows, "text", _columns(names))), T.StructType([fields[n] for n in names]))

    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    shards = _shards(benchmark, item_col, item_text_col, shard_bytes)
    first, second = next(shards), next(shards, None)
    if second is None:
        return one_pass(first, ["id", "n_words", "items", "spans"]).withColumn("n_hit", n_hit)
    found = None
    for shard in itertools.chain([first, second], shards):
        part = materialise(one_pass(shard, ["id", "key", "items", "spans"]).where(F.size("spans") > 0).distinct(), "decontaminate")
        found = part if found is None else found.unionByName(part)
    # Spans of one document from different shards are united; a document is known by its id and text.
    merged = found.groupBy("id", "key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("raw"),
    ).select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), "items", F.expr(
        "aggregate(raw, cast(array() as array<array<bigint>>), (acc, s) -> if(size(acc) > 0 and s[0] <= element_at(acc, -1)[1],"
        " concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], s[1])))), concat(acc, array(s))))"
    ).alias("spans"))
    counted = one_pass([], ["id", "key", "n_words"])
    return counted.join(merged, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left").select(
        "id", "n_words", F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<array<bigint>>)")).alias("spans"),
    ).withColumn("n_hit", n_hit)


def is_contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * CONTAMINATED_ONE_IN >= F.col("n_words"))


def remove(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Drops contaminated documents and cuts the hit spans out of the others; all columns are kept.

    Spans of all shards are united on the uncut text, so the result does not depend on the
    size of a shard. chars_col, if it is a column, follows the text.
    """
    spark, schema = docs.sparkSession, docs.schema
    key, held = (next(f"{x}{i}" for i in range(len(schema) + 1) if f"{x}{i}" not in schema.names) for x in ("text_key", "hit_spans"))

    def keep(batch, texts, n_words, _items, spans, cuts):
        hit = [sum(y - x for x, y in s) for s in spans]
        stay = [not (h and h * CONTAMINATED_ONE_IN >= n) for h, n in zip(hit, n_words)]
        if any(cuts[i] and stay[i] for i in range(len(stay))):
            cut, at = [], batch.schema.get_field_index(text_col)
            old = batch.column(at).to_pylist()
            for i, c in enumerate(cuts):
                if c and stay[i]:
                    kept = [texts[i][a:b] for a, b in zip([0, *[y for _, y in c]], [*[x for x, _ in c], len(texts[i])])]
                    old[i] = b"".join(kept).decode()
                cut.append(old[i])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))
            if chars_col in batch.schema.names:
                where = batch.schema.get_field_index(chars_col)
                lengths = [len(cut[i]) if c else v for i, (c, v) in enumerate(zip(cuts, batch.column(where).to_pylist()))]
                batch = batch.set_column(where, batch.schema.field(where), pa.array(lengths, batch.schema.field(where).type))
        return batch.filter(pa.array(stay, pa.bool_()))

    shards = _shards(benchmark, item_col, item_text_col, shard_bytes)
    first = next(shards)
    if next(shards, None) is None:
        windows = spark.sparkContext.broadcast(WindowSet(first, window))
        return docs.mapInArrow(lean(_scan_batches(windows, text_col, keep)), schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x or [] for x in batch.column(held).to_pylist()]
            batch = batch.select(schema.names)
            texts = as_bytes(batch.column(text_col))
            n_words, cuts = [0] * len(texts), [[] for _ in texts]
            for i in (i for i, spans in enumerate(own) if spans):
                chunk = scan([texts[i]], ALNUM)
                n_words[i] = len(chunk.starts)
                cuts[i] = [[int(chunk.starts[x]), int(chunk.ends[y - 1])] for x, y in own[i]]
            yield keep(batch, texts, n_words, None, own, cuts)

    # What a text holds depends on nothing but the text, so each text is looked at once.
    digest_of = F.sha2(F.col(text_col).cast("string").cast("binary"), 256)
    texts = docs.where(F.col(text_col).isNotNull()).select(digest_of.alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    found = scan_hits(texts, benchmark, id_col="key", text_col="text", item_col=item_col, item_text_col=item_text_col, window=window, shard_bytes=shard_bytes)
    hit = found.where("n_hit > 0").select(F.col("id").alias(key), F.col("spans").alias(held))
    return docs.withColumn(key, digest_of).join(hit, key, "left").drop(key).mapInArrow(lean(apply), schema)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of ``scan_hits``."""
    ids = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return scan_hits(docs, benchmark).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


_WORDS = "list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
