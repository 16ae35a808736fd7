"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Every text becomes its set of distinct shingles and a MinHash signature, each of
   whose coordinates joins ``JOINED`` min-hashes: unrelated texts of similarity s collide
   in a coordinate with chance s ** JOINED only, so that lists hold few strangers however
   many texts there are. Texts of equal sets are one class from here on, known by its
   smallest id.
2. Classes are posted under each (coordinate, value) of their signatures. Values that
   only one class has cannot collide and go; a class with fewer than ``matches``
   values left cannot collide often enough and goes. Of the others, the rarest
   ``c - matches + 1`` values are the prefix: two classes that collide ``matches``
   times share a value of both prefixes, so the frequent lists are skipped.
3. Prefix lists are merged around pivots: the most central class of a list (whose
   values are shared most) is compared with all members, and what it links is one
   component. Only where members of a pivot's lists still lie in several components
   are they compared further, those outside the main component against the rest. A
   member differs from its pivot by its edits, the shingles that one of both has and
   the other lacks, and two members are as far apart as the edits that they do not
   share. A link therefore needs a certain number of shared edits, and such pairs are
   found by a second inverted join, over edits, where again the frequent ones are
   skipped, as many as the pair needs less one. Neither rule loses a link between
   components: the first pairs are connected already, the others too far apart. Before
   that, the most central member of each edit's list is compared with the list, as
   pivots were, so that families within a pivot's lists are connected first.
   Members that were not compared with a pivot are paired with the others of each list
   that they are in, of ``FREQUENT`` members at most.
4. Candidates whose signatures collide at least ``matches`` times, as far as one byte a
   coordinate tells, are confirmed on the full sets: 100 * intersection >= percent *
   union. Full sets are made of candidates only, when they are compared. Components of
   confirmed links are the groups of near duplicates.

A pair at similarity 0.8 collides in fewer than 3 of 32 coordinates of three min-hashes
about six times in 10^8; that is the only way to miss a link. Members of a list of more
than ``FREQUENT`` are compared with its pivot whatever their signatures say, and bytes
collide more often than coordinates; both can only find more.

Tables written on the way, each once:
signatures and rows (a row a document), firsts (a class: its signature), posted (a class:
its shared values), listed (a list's members), around (pivot and member), pairs /
candidates / sets / compared (three times: stars of pivots, stars of edits, the rest),
parted (members of unresolved pivots), common and hot (edits of several members, at most
``64 * MASKS`` hot ones a pivot), edits, and the rounds of ``connected_components``.

Defined results: texts without words have empty sets and are linked with nothing; a
text with fewer words than a shingle is one shingle; repeated rows share a class; rows
with a null id keep a null component, and stay; an id on rows with different texts is
one document that has them all, of which ``keep_one`` keeps the row that sorts first.
Columns other than the named ones are ignored, and passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.llm._words import SPACED, as_bytes, chunks, mix, rolling, scan
from tessella.operators.components import connected_components
from tessella.session import discard, lean, materialise, ship, tidy

COORDINATES = 32
#: Min-hashes that make one coordinate.
JOINED = 3
MATCHES = 3

_rng = np.random.default_rng(64_0_8)
_MULT = _rng.integers(0, 2**64, 1024, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, 1024, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle."""
    chunk = scan(texts, SPACED)
    hashes = rolling(chunk.hashes, size)
    out = []
    counts = np.diff(chunk.first)
    for begin, n in zip(chunk.first.tolist(), counts.tolist()):
        if n >= size:
            out.append(np.unique(hashes[begin : begin + n - size + 1]))
        elif n:
            out.append(rolling(chunk.hashes[begin : begin + n], n))
        else:
            out.append(hashes[:0])
    return out


def _signed(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """MinHash signatures as posting tokens: the coordinate's number is mixed into its value."""
    filled = [s for s in sets if len(s)]
    out = np.zeros((len(filled), coordinates), np.uint64)
    if filled:
        flat = np.concatenate(filled)
        at = np.concatenate([[0], np.cumsum([len(s) for s in filled])[:-1]])
        for j in range(coordinates):
            out[:, j] = j
            for i in range(JOINED * j, JOINED * (j + 1)):
                out[:, j] = mix(np.minimum.reduceat((flat ^ _XOR[i]) * _MULT[i], at) + out[:, j])
    return out.view(np.int64)


def _sketches(lists: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A byte of each coordinate, eight to a number; without a signature, zeros."""
    out = np.zeros((len(lists), -(-coordinates // 8) * 8), np.uint8)
    for i, tokens in enumerate(lists):
        out[i, : len(tokens)] = tokens & 255
    return out.view(np.int64)


def _signatures(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            n, prints, lists = [], [], []
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], size)
                rows = iter(_signed(sets, coordinates))
                for s in sets:
                    n.append(len(s))
                    prints.append((int(mix(s).sum().view(np.int64)), int(mix(s ^ _XOR[1000]).sum().view(np.int64))) if len(s) else (0, 0))
                    lists.append(next(rows) if len(s) else np.zeros(0, np.int64))
            bytes_ = _sketches(lists, coordinates)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(n, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                *(pa.array(bytes_[:, i]) for i in range(bytes_.shape[1])),
            ], names=["id", "n", "f1", "f2", "sig", *(f"s{i}" for i in range(bytes_.shape[1]))])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            sets = [s.view(np.int64) for a, b in chunks(texts) for s in shingle_sets(texts[a:b], size)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "packed"])

    return run


#: Lists of a pivot with more members are compared with it on full sets without exception.
FREQUENT = 64
#: Parts that the members of a large pivot are dealt to where they meet what is known of it; a pivot is large from so
#: many members on, and has a ten-thousandth of all at least, so that large ones are at most 10,000.
SPREAD = 32
LARGE = 1000

#: 64-bit masks of frequent edits that a member carries.
MASKS = 8

_COMPARED = "a long, b long, n long, linked boolean, edits array<long>"


def _compare(percent: int, edits: bool):
    """Compares packed sets x of a and y of b: size of y, link or not, and what only one of both has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, linked, apart = [], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = np.intersect1d(x, y, assume_unique=True)
                n.append(len(y))
                linked.append(len(both) > 0 and 100 * len(both) >= percent * (len(x) + len(y) - len(both)))
                apart.append(np.setdiff1d(np.union1d(x, y), both, assume_unique=True) if edits else both[:0])
            yield pa.RecordBatch.from_arrays([
                batch.column("a"), batch.column("b"), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(apart, pa.list_(pa.int64())),
            ], names=["a", "b", "n", "linked", "edits"])

    return run


def _differing(x: F.Column, y: F.Column) -> F.Column:
    """Bytes in which two numbers differ: the bits of each byte are gathered in its lowest."""
    v = x.bitwiseXOR(y)
    for n in (4, 2, 1):
        v = v.bitwiseOR(F.shiftrightunsigned(v, n))
    return F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))


class _Linker:
    """Compares candidate pairs (a, b): collisions of signatures first, then full sets."""

    def __init__(self, sketches: DataFrame, source: DataFrame, coordinates: int, matches: int, shingle: int, percent: int):
        self.sketches, self.source, self.shingle, self.percent = sketches, source, shingle, percent
        self.words, self.most = -(-coordinates // 8), coordinates - matches

    def compared(self, pairs: DataFrame, edits: bool = False) -> DataFrame:
        """pairs: a, b and sure (compared whatever the signatures say)."""
        pairs = materialise(pairs, "dedup-pairs")
        left = self.sketches.select(F.col("id").alias("a"), *(f"s{i}" for i in range(self.words)))
        right = self.sketches.select(F.col("id").alias("b"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(self.words)))
        differing = sum(_differing(F.col(f"s{i}"), F.col(f"t{i}")) for i in range(self.words))
        unsure = pairs.where("NOT sure").join(left, "a").join(right, "b").where(differing <= self.most).select("a", "b").distinct()
        enough = materialise(unsure.unionByName(pairs.where("sure").select("a", "b")), "dedup-candidates")
        sets = _sets_of(self.source, enough.select(F.explode(F.array("a", "b")).alias("id")).distinct(), self.shingle)
        x = sets.select(F.col("id").alias("a"), F.col("packed").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("packed").alias("y"))
        # a is the pivot of many pairs: its set goes first, as equal neighbours shrink in the shuffle.
        full = enough.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        out = materialise(full.mapInArrow(lean(_compare(self.percent, edits)), _COMPARED), "dedup-compared")
        discard(pairs, enough, sets)
        tidy(self.source.sparkSession)
        return out


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links)."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = [f"s{i}" for i in range(-(-coordinates // 8))]
    signed = source.mapInArrow(lean(_signatures(shingle, coordinates)), "id long, n long, f1 long, f2 long, sig array<long>, " + ", ".join(f"{w} long" for w in words))
    signed = materialise(signed.withColumn("uid", F.monotonically_increasing_id()), "dedup-signatures")
    rows = materialise(signed.select("id", "n", "f1", "f2", "uid"), "dedup-rows")
    full = rows.where("n > 0 AND id IS NOT NULL")
    classes = materialise(full.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "uid")).alias("first")).select("f1", "f2", "n", "first.*"), "dedup-classes")
    firsts = materialise(signed.join(classes.select("uid"), "uid", "left_semi").select("id", "sig", *words), "dedup-firsts")
    discard(signed)

    posts = firsts.select("id", F.explode("sig").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    by_class = posts.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("posted"))
    posted = materialise(by_class.where(F.size("posted") >= matches).select(
        "id", F.col("posted.token").alias("tokens"), F.aggregate("posted", F.lit(0).cast("long"), lambda acc, p: acc + p["df"]).alias("central"),
    ), "dedup-posted")
    sketches = materialise(firsts.select("id", *words).join(posted.select("id"), "id", "left_semi"), "dedup-sketches")
    discard(firsts)
    del posts, shared, by_class
    tidy(spark)
    prefix = posted.select("id", "central", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - matches + 1)).alias("token"))
    lists = prefix.groupBy("token").agg(F.count("*").alias("members"), F.max_by("id", F.struct("central", "id")).alias("pivot")).where("members > 1")
    listed = materialise(prefix.select("id", "token").join(lists, "token"), "dedup-listed")
    around = materialise(listed.groupBy("pivot", "id").agg((F.max("members") > FREQUENT).alias("sure")), "dedup-around")
    discard(posted)

    linker = _Linker(sketches, source, coordinates, matches, shingle, percent)
    first = linker.compared(around.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"), "sure"), edits=True)
    links = materialise(first.where("linked").select("a", "b"), "dedup-links")
    pivots = _Pivots(around)
    members, edits = _unresolved(pivots, around, first, links, classes.select("id", "n"), percent)
    discard(first, around)
    del first, around
    tidy(spark)
    stars = linker.compared(_edit_stars(pivots, members, edits, percent))
    links = links.unionByName(stars.where("linked").select("a", "b"))
    rest = linker.compared(_across(pivots, members, edits, listed, links, percent))
    links = links.unionByName(rest.where("linked").select("a", "b"))
    discard(members, edits, listed, sketches)
    tidy(spark)

    components = materialise(connected_components(links), "dedup-components")
    named = classes.select("f1", "f2", "n", F.col("id").alias("node")).join(components, "node", "left").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gn"), F.coalesce("component", "node").alias("component"))
    return rows.join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


_SLOT_WORDS = 1 << 18


def _slot(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(_SLOT_WORDS * 64))


def _slots(ids: DataFrame) -> np.ndarray:
    """A bit table of bounded size with the slots of all ids."""
    bits = ids.select(_slot("id").alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(_SLOT_WORDS, np.int64)
    table[bits["w"].to_numpy()] = bits["bits"].to_numpy()
    return table


def _likely(table):
    """Rows (id, ..., s) whose slot s is set: all rows of the ids, and a few others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s").to_numpy()
            yield batch.filter(pa.array(((table.value[s >> 6] >> (s & 63)) & 1).astype(bool)))

    return run


def _sets_of(source: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, packed): full sets of the given ids, and perhaps others."""
    table = _slots(ids)
    if not table.any():
        return materialise(source.sparkSession.createDataFrame([], "id long, packed binary"), "dedup-sets")
    shared = source.sparkSession.sparkContext.broadcast(table)
    slotted = source.where("id IS NOT NULL").withColumn("s", _slot("id"))
    make, likely = _sets(shingle), _likely(shared)
    if np.bitwise_count(table.view(np.uint64)).sum() > _SLOT_WORDS * 4:
        found = materialise(slotted.mapInArrow(lean(likely), slotted.schema).drop("s"), "dedup-likely").join(ids, "id", "left_semi").mapInArrow(lean(make), "id long, packed binary")
    else:
        # A few sets that nobody asks for do no harm, and cost less than a shuffle of the texts.
        found = slotted.mapInArrow(lean(lambda batches: make(likely(batches))), "id long, packed binary")
    return materialise(found, "dedup-sets")


class _Pivots:
    """Joins what is known of pivots, a row a pivot, to their members; members of a large pivot are dealt to many tasks."""

    def __init__(self, around: DataFrame):
        least = max(LARGE, around.count() // 10_000)
        large = around.groupBy("pivot").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("pivot", F.lit(True).alias("_large"))
        self.large = F.broadcast(materialise(large, "dedup-large"))

    def join(self, frame: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
        """frame (pivot, id, ...)."""
        deal = F.when(F.col("_large"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).otherwise(0)
        deals = F.explode(F.when(F.col("_large"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
        dealt = lambda rows, column: rows.join(self.large, "pivot", "left").withColumn("_deal", column).drop("_large")
        return dealt(frame, deal).join(dealt(known, deals), ["pivot", "_deal"], how).drop("_deal")


def _unresolved(pivots: _Pivots, around: DataFrame, first: DataFrame, links: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of pivots whose members are in several components, and the edits of those members."""
    components = materialise(connected_components(links), "dedup-components")
    named = around.join(components.withColumnRenamed("node", "id"), "id", "left").select("pivot", "id", F.coalesce("component", "id").alias("c"))
    parted = named.groupBy("pivot").agg(F.count("*").alias("k"), F.min("c").alias("x"), F.max("c").alias("y")).where("x < y AND k > 2").select("pivot")
    # The pivot itself has been compared with all.
    held = pivots.join(named, parted, "left_semi").where("id <> pivot").join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id")
    held = held.join(first.select(F.col("a").alias("pivot"), F.col("b").alias("id"), F.size("edits").alias("k"), "edits"), ["pivot", "id"], "left")
    held = materialise(held, "dedup-parted")
    edits = held.where("k IS NOT NULL").select("pivot", "id", "c", "n", "k", F.explode("edits").alias("h"))
    common = materialise(edits.groupBy("pivot", "h").agg(F.count("*").alias("df")).where("df > 1"), "dedup-common")
    # The most frequent edits of a pivot are bits, so that pairs know how many of them they share.
    # The limit is on the row number itself, so that Spark cuts each partition to it before the shuffle.
    hot = common.withColumn("bit", F.row_number().over(W.partitionBy("pivot").orderBy(F.desc("df"), "h"))).where(F.col("bit") <= 64 * MASKS)
    hot = materialise(hot.select("pivot", "h", (F.col("bit") - 1).alias("bit")), "dedup-hot")
    edits = edits.join(common, ["pivot", "h"]).join(hot, ["pivot", "h"], "left")
    own = W.partitionBy("pivot", "id")
    for i in range(MASKS):
        edits = edits.withColumn(f"m{i}", F.bit_or(F.when(F.expr(f"bit div 64 = {i}"), F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long"))).over(own))
    edits = edits.withColumn("rare", F.count_if(F.col("bit").isNull()).over(own)).withColumn("central", F.sum("df").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("df"), "h")))
    # No partner needs fewer shared edits of a member than this, see _need, so the frequent ones below that rank are skipped.
    least = F.col("k") - F.col("n") * (100 - percent) / percent
    edits = edits.withColumn("usable", F.count("*").over(own)).where((F.col("usable") >= least) & (F.col("rank") >= least)).drop("bit", "df", "usable")
    members, edits = materialise(held.drop("edits"), "dedup-members"), materialise(edits, "dedup-edits")
    discard(held, common, hot)
    return members, edits


def _second(frame: DataFrame) -> DataFrame:
    """The same columns under names of the other side of a pair."""
    return frame.select([F.col(c).alias(c if c in ("pivot", "h") else f"{c}2") for c in frame.columns])


def _apart(percent: int) -> F.Column:
    return (F.col("c") != F.col("c2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)


def _need(percent: int) -> F.Column:
    """Edits that a pair must share to be a link; null if the edits of either are not known."""
    return F.ceil(((F.col("k") + F.col("k2")) * (100 + percent) - (F.col("n") + F.col("n2")) * (100 - percent)) / (2 * (100 + percent)))


def _shared() -> F.Column:
    """At most so many edits are shared: the frequent ones exactly, of the others the fewer."""
    return sum((F.bit_count(F.col(f"m{i}").bitwiseAND(F.col(f"m{i}2"))) for i in range(MASKS)), F.least("rare", "rare2"))


def _pairs(found: DataFrame, sure: bool = False) -> DataFrame:
    return found.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).where("a < b").distinct().withColumn("sure", F.lit(sure))


def _main(members: DataFrame) -> DataFrame:
    return members.groupBy("pivot", "c").agg(F.count("*").alias("k")).groupBy("pivot").agg(F.max_by("c", F.struct("k", "c")).alias("main"))


def _edit_stars(pivots: _Pivots, members: DataFrame, edits: DataFrame, percent: int) -> DataFrame:
    """Of each list of an edit, two members against all others: two rows a posting at most.

    They are the most central one outside the main component, around which a family of
    its own may stand, and the one of fewest edits, which is nearest to all others.
    """
    columns = ["id", "c", "n", "k", "rare", *[f"m{i}" for i in range(MASKS)]]
    heads = pivots.join(edits, _main(members)).where("c <> main").groupBy("pivot", "h").agg(F.max_by(F.struct(*columns), F.struct("central", "id")).alias("head"))
    heads = heads.unionByName(edits.groupBy("pivot", "h").agg(F.min_by(F.struct(*columns), F.struct("k", "id")).alias("head")))
    heads = heads.select("pivot", "h", *[F.col(f"head.{c}").alias(f"{c}2") for c in columns])
    need = _need(percent)
    return _pairs(edits.join(heads, ["pivot", "h"]).where(_apart(percent) & (need > 0) & (F.col("rank") >= need) & (_shared() >= need)))


def _across(pivots: _Pivots, members: DataFrame, edits: DataFrame, listed: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs of members that are still in different components and may be links."""
    components = materialise(connected_components(links), "dedup-components").withColumnRenamed("node", "id")
    again = lambda frame: frame.join(components, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    members, edits = materialise(again(members), "dedup-members"), again(edits)
    parted = materialise(members.groupBy("pivot").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("pivot"), "dedup-parted")
    main, need = materialise(_main(members), "dedup-main"), _need(percent)
    outside = lambda frame: pivots.join(frame, main).where("c <> main").drop("main")
    members = materialise(pivots.join(members, parted, "left_semi"), "dedup-members")
    edits = materialise(pivots.join(edits, parted, "left_semi"), "dedup-edits")
    # Only lists of at most FREQUENT members have any that were not compared with their pivot; with one besides the pivot there is no pair.
    small = listed.where(F.col("members").between(3, FREQUENT)).select("token", "pivot", "id")
    few = materialise(small.join(members.select("pivot", "id", "c", "n", "k"), ["pivot", "id"]), "dedup-few")
    others = few.select("token", F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("n").alias("n2"))
    unknown = few.where("k IS NULL").join(others, "token").where(_apart(percent))
    far = outside(edits).join(_second(edits), ["pivot", "h"]).where(_apart(percent) & (need > 0) & (F.col("rank") >= need) & (F.col("rank2") >= need) & (_shared() >= need))
    return _pairs(unknown.select("id", "id2").unionByName(far.select("id", "id2"))).unionByName(_pairs(_certain(pivots, members, percent), sure=True))


def _certain(pivots: _Pivots, members: DataFrame, percent: int) -> DataFrame:
    """Pairs around each pivot's member with the most room for edits that are links by their sizes alone.

    Two members are a link whatever they share if the room of both is not negative in
    sum. The member with the most room then is a link with either, so a star around it
    connects all such pairs.
    """
    room = F.col("n") * (100 - percent) - F.col("k") * (100 + percent)
    roomy = members.where("k IS NOT NULL").withColumn("room", room)
    centre = roomy.groupBy("pivot").agg(F.max_by(F.struct(F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("room").alias("room2")), F.struct("room", "id")).alias("x")).select("pivot", "x.*")
    return pivots.join(roomy, centre).where("room + room2 >= 0 AND c <> c2").select("id", "id2")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose id is their component's, once each, with all their columns; rows with a null id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    named = set(docs.columns)
    key, copies, row = (next(f"{x}{i}" for i in range(len(named) + 1) if f"{x}{i}" not in named) for x in ("kept_id", "copies", "row"))
    kept = found.where("id = component_id").groupBy("id").agg(F.count("*").alias(copies)).withColumnRenamed("id", key)
    kept = materialise(kept, "dedup-kept")
    out = docs.join(kept.where(F.col(copies) == 1), F.col(id_col) == F.col(key), "left_semi")
    repeated = docs.join(kept.where(F.col(copies) > 1), F.col(id_col) == F.col(key), "left_semi")
    first = W.partitionBy(id_col).orderBy(text_col, F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    repeated = repeated.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).drop(row)
    return out.unionByName(repeated).unionByName(docs.where(F.col(id_col).isNull()))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: two-word shingles, 0.8."""
    found = near_duplicates(docs, shingle=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
reps AS (SELECT min(doc_id) AS id, g FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g HAVING len(g) > 0),
ex AS (SELECT id, unnest(g) AS h FROM reps),
inter AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM ex x JOIN ex y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN reps p ON p.id = a JOIN reps q ON q.id = b WHERE 100 * k >= 80 * (len(p.g) + len(q.g) - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT id, id FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s.g) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM s LEFT JOIN reps ON reps.g = list_sort(s.g) LEFT JOIN comp USING (id)
"""
