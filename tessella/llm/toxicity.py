"""Toxicity by noisy-channel deobfuscation.

A character language model is counted over all documents. Tokens of any length that look
disguised (figures and symbols for letters, letters spaced out, letters doubled) become
lattices of what each character may stand for, where a gap may be a word's border, and
Viterbi decoding under the language model gives the most likely words behind them. Every
restored word is then scored by a lexicon of words and word beginnings that is learned
from labelled documents.

Learning: features are whole words and their first 4 to 8 bytes. A feature's support
is the lesser of the toxic documents and of the distinct next words it has there, so
that copies of one document count about once. It enters the lexicon if that support is
too high for chance (a binomial test, corrected for all features tried); its weight is
the share of toxic among the training documents that hold it. A document's evidence is
the sum of -log(1 - weight) over its words, and a logistic curve over the evidence,
fitted to the training documents, makes it a probability. Learning reads at most
``train_rows`` labelled documents, those of the smallest hash of their id; the language
model reads all documents.

Defined results: null and empty texts have the score of documents without lexicon words;
documents without a usable label are not learned from; a document labelled more than
once counts as toxic if any label says so; without toxic training documents all scores
are 0. Labels, lang, source and ids are never inputs of a score. Columns other than the
named ones are passed through by ``reject`` and ignored elsewhere.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessella.llm import _words
from tessella.llm._words import Chunk, _table, as_bytes, chunks, mix, scan
from tessella.session import lean, materialise, ship

#: Labelled documents that learning reads at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
_LENGTHS = (4, 5, 6, 7, 8)
#: Words are runs of ASCII letters and of characters beyond ASCII.
_LETTERS = _table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)

#: The letters that a character is used for in disguise.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
_IN = re.escape("".join(LOOKALIKES))


def _letters() -> str:
    """Every letter of Unicode, as ranges of a regex class."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    edges = np.flatnonzero(np.diff(alpha.view(np.int8), prepend=0, append=0))
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()))


_L = _letters()
#: Maximal runs of letters and look-alikes, and runs without ASCII marks, in which they are looked for.
_RUN = re.compile(rf"[{_L}{_IN}]{{3,}}+")
_MARKLESS = re.compile(r"[^\s\"#%&'*,\-./:;<=>?\[\]\\^_`{}~)]{3,}+")
_FIGURES = re.compile(rf"(?:[{_L}]++[{_IN}]|[{_IN}]++[{_L}])[{_L}{_IN}]++")
_DOUBLED = re.compile(rf"[{_L}]*?([{_L}])\1[{_L}]*+", re.IGNORECASE)
_GAP = re.compile(r"[\s._*\-]+")
_SPACED_OUT = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_IN}])(?:[\s._*\-]++(?:[^\W_]|[{_IN}])(?![^\W_])){{2,}}+")
_SUBSTITUTED, _REPEATED, _SPACED = 1.0, 0.5, 0.2
#: Readings of a token that are looked up one by one before it is decoded; tokens of more are always decoded.
MOST_READINGS = 32


def prefix_hashes(chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, words at least that long, hash of their first bytes)."""
    masked = np.where(_LETTERS, _words._BYTE_HASH, np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(masked[chunk.data] * _words._powers[: len(chunk.data)])])
    sizes = chunk.ends - chunk.starts
    for p in _LENGTHS:
        at = np.flatnonzero(sizes >= p)
        s = chunk.starts[at]
        yield p, at, mix((sums[s + p] - sums[s]) * _words._inverse[s] + np.uint64(100_000 + p))


def features(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hash) of every feature kind."""
    yield np.arange(len(chunk.starts)), chunk.hashes
    for _, at, h in prefix_hashes(chunk):
        yield at, h


# --- the character language model and the channel


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(27**3, np.int64)
    for batch in batches:
        texts = as_bytes(batch.column(0))
        for a, b in chunks(texts):
            s = _SYMBOL[_words._LOWER[np.frombuffer(b"  ".join(texts[a:b]) + b"  ", np.uint8)]]
            total += np.bincount(s[:-2] * 729 + s[1:-1] * 27 + s[2:], minlength=27**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probability of a letter after two others (27 symbols, 0 is a word's border), counted over all texts."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(27**3, 0.5)
    table[counts["code"].to_numpy()] += counts["n"].to_numpy()
    table = table.reshape(27, 27, 27)
    table[0, 0, 0] = 0.5
    return np.log(table / table.sum(axis=2, keepdims=True))


@lru_cache(maxsize=1 << 16)
def _tokens(text: str) -> tuple[str, ...]:
    """Runs of letters and look-alikes that look disguised: whole ones with figures, letters alone where one is doubled."""
    out = []
    for run in _RUN.findall(text):
        if not run.isalpha() and _FIGURES.fullmatch(run):
            out.append(run)
        elif doubled := _DOUBLED.search(run):
            out.append(doubled[0])
    return tuple(out)


def disguised(text: str) -> Iterator[str]:
    """Tokens that look disguised, of any length; long ones are not kept in memory."""
    for run in _MARKLESS.findall(text):
        yield from _tokens(run) if len(run) <= 64 else _tokens.__wrapped__(run)
    yield from (m[0] for m in _SPACED_OUT.finditer(text))


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each gap and each run of equal characters may stand for: (letters, cost); a gap is nothing or a word's border."""
    low = token.lower()
    narrow = min(map(len, _GAP.findall(low)), default=0)
    out: list[list[tuple[str, float]]] = []
    before = ""
    for run in re.finditer(r"([\s._*\-]+)|(.)\2*", low):
        if run[1]:
            out.append([("", _SPACED if len(run[1]) == narrow else _SUBSTITUTED), (" ", 0.0)])
            continue
        c, n = run[2], len(run[0])
        base = [(x, _SUBSTITUTED) for x in LOOKALIKES[c]] if c in LOOKALIKES else [(c, 0.0)] if c.isalpha() else []
        bare = unicodedata.normalize("NFD", c)[0]
        if c > "\x7f" and "a" <= bare <= "z":
            base.append((bare, _SUBSTITUTED))
        if base:
            again = [("", _REPEATED)] if c == before else []
            out.append([(x * m, cost * m + _REPEATED * (n > m)) for x, cost in base for m in (1, 2) if m <= n] + again)
        before = c
    return out


@lru_cache(maxsize=4096)
def _symbols(letters: str) -> tuple[int, ...]:
    return tuple(_SYMBOL[list(letters.encode())].tolist()) if letters else ()


def restore(token: str, model: np.ndarray, best: int = 4) -> list[tuple[str, float]]:
    """The most likely words behind a disguised token, with their probabilities among those."""
    # A path is its score and its last letters linked to the path before, so that long tokens cost in proportion.
    states: dict[tuple[int, int], list[tuple[float, tuple]]] = {(0, 0): [(0.0, ())]}
    for options in _lattice(token):
        after: dict[tuple[int, int], list[tuple[float, tuple]]] = {}
        for (x, y), paths in states.items():
            for letters, cost in options:
                a, b, gain = x, y, -cost
                for k in _symbols(letters):
                    gain += model[a, b, k]
                    a, b = b, k
                after.setdefault((a, b), []).extend((s + gain, (path, letters) if letters else path) for s, path in paths)
        states = {k: sorted(v, key=lambda p: -p[0])[:best] for k, v in after.items()}
    found: dict[str, float] = {}
    for s, path in sorted(((s + model[x, y, 0], path) for (x, y), paths in states.items() for s, path in paths), key=lambda p: -p[0])[: 2 * best]:
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        text = "".join(reversed(parts)).strip()
        if text:
            found.setdefault(text, s)
    ends = list(found.items())[:best]
    total = sum(math.exp(s - ends[0][1]) for _, s in ends) if ends else 1.0
    return [(text, math.exp(s - ends[0][1]) / total) for text, s in ends]


# --- learning


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, document, next word) of toxic documents, once each in a batch."""
    for batch in batches:
        texts, ids = as_bytes(batch.column("text")), np.array(batch.column("id").to_pylist(), np.int64)
        for a, b in chunks(texts):
            chunk = scan(texts[a:b], _LETTERS)
            if not len(chunk.starts):
                continue
            owner, after = chunk.owner(), np.append(chunk.hashes[1:], 0)
            for at, h in features(chunk):
                rows = np.unique(np.stack([h.view(np.int64), ids[a:b][owner[at]], after[at].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["feature", "doc", "after"])


def _holders(shared):
    """Clean documents that hold each candidate feature, counted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in chunks(texts):
                chunk = scan(texts[a:b], _LETTERS)
                owner = chunk.owner()
                for at, h in features(chunk):
                    i, found = lookup(known, h)
                    pairs = np.unique(i[found] * (b - a) + owner[at[found]])
                    np.add.at(total, pairs // (b - a), 1)
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], names=["feature", "clean"])

    return run


def lookup(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return i, known[i] == hashes


@dataclass
class Lexicon:
    keys: np.ndarray
    weights: np.ndarray
    #: Intercept and slope of the logistic curve over the evidence.
    curve: tuple[float, float]
    characters: np.ndarray

    def plain(self) -> tuple:
        return self.keys, self.weights, self.curve, self.characters


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, count: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of one variable by Newton steps over weighted points."""
    x = np.stack([np.ones_like(evidence), evidence], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (count * (p - toxic)) + ridge * w
        hessian = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _log_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of k or more of n at rate p."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k, min(n, k + 200) + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def learn(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Lexicon:
    """usable: which label rows may be learned from, as a condition on ``labels``."""
    spark = docs.sparkSession
    ship(spark)
    rows = labels.where(usable) if usable is not None else labels
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(toxic_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    sample = rows.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    # The sample is bounded by train_rows, so it may be broadcast.
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    train = materialise(text.join(F.broadcast(sample), "id").where("text IS NOT NULL").repartition(64), "toxicity-train")
    sizes = {r.toxic: r.n for r in train.groupBy(F.expr("int(toxic > 0)").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    characters = character_model(docs, text_col)
    if not toxic:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), (-30.0, 0.0), characters)
    rate = toxic / (toxic + clean)
    found = train.where("toxic > 0").select("id", "text").mapInArrow(lean(_toxic_features), "feature long, doc long, after long")
    support = found.groupBy("feature").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("after").alias("after")).where("docs > 2 AND after > 2").toArrow()
    order = np.argsort(support["feature"].to_numpy().view(np.uint64))
    keys = support["feature"].to_numpy().view(np.uint64)[order]
    docs_with, spread = support["docs"].to_numpy()[order], support["after"].to_numpy()[order]
    shared = spark.sparkContext.broadcast(keys)
    held = train.where("toxic <= 0").select("text").mapInArrow(lean(_holders(shared)), "feature long, clean long").groupBy("feature").agg(F.sum("clean").alias("clean")).toArrow()
    clean_with = np.zeros(len(keys), np.int64)
    if held.num_rows:
        clean_with[lookup(keys, held["feature"].to_numpy().view(np.uint64))[0]] = held["clean"].to_numpy()
    strict = math.log(0.05) - math.log(max(1, len(keys)))
    weights = docs_with / (docs_with + clean_with + 1.0)
    good = np.array([w >= 0.5 and _log_tail(int(min(d, s)), int(min(d, s) + c), min(rate, 0.5)) < strict for w, d, s, c in zip(weights, docs_with, spread, clean_with)], bool)
    lexicon = Lexicon(keys[good], weights[good], (0.0, 1.0), characters)
    seen = score_texts(train.select("id", "text"), lexicon).select("id", F.round("evidence", 1).alias("evidence")).join(train.select("id", "toxic"), "id")
    points = seen.groupBy("evidence", F.expr("int(toxic > 0)").alias("toxic")).agg(F.count("*").alias("n")).toPandas()
    curve = fit_curve(points["evidence"].to_numpy(float), points["toxic"].to_numpy(float), points["n"].to_numpy(float))
    return Lexicon(keys[good], weights[good], curve, characters)


# --- scoring


def _scores(shared, keep, text_col: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, (intercept, slope), characters = shared.value
        table = np.zeros(1 << 20, bool)
        table[(keys >> np.uint64(44)).astype(np.int64)] = True

        def word_weights(chunk: Chunk) -> np.ndarray:
            best = np.zeros(len(chunk.starts))
            for at, h in features(chunk):
                maybe = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
                i, found = lookup(keys, h[maybe])
                np.maximum.at(best, at[maybe[found]], weights[i[found]])
            return best

        def hidden(token: str) -> tuple[float, int]:
            """Evidence and known words of a disguised token: of every word it may stand for, by probability."""
            guesses = restore(token, characters) if len(keys) else []
            if not guesses:
                return 0.0, 0
            chunk = scan([token.encode(), *(g.encode() for g, _ in guesses)], _LETTERS)
            w, owner = word_weights(chunk), chunk.owner()
            clean = np.bincount(owner, np.log(1 - np.minimum(w, 0.999)), len(guesses) + 1)
            known = np.bincount(owner, w > 0, len(guesses) + 1).astype(int)
            # A token of letters alone was scored as a word already: only what restoring adds counts.
            plain = token.isalpha()
            top = clean[1:].max()
            evidence = -top - math.log(sum(p * math.exp(c - top) for (_, p), c in zip(guesses, clean[1:]))) + (clean[0] if plain else 0.0)
            return (float(evidence), max(0, int(known[1:].max()) - (int(known[0]) if plain else 0))) if evidence > 1e-12 else (0.0, 0)

        def weigh(tokens: list[str]) -> Iterator[tuple[str, tuple[float, int]]]:
            """(token, evidence and known words); only tokens of which some reading has a known word are decoded."""
            readings, of, decode = [], [], []
            for token in tokens:
                options = _lattice(token)
                if math.prod(map(len, options)) > MOST_READINGS:
                    decode.append(token)
                    continue
                made = {"".join(x for x, _ in way) for way in itertools.product(*options)}
                readings += [x.encode() for x in made]
                of += [token] * len(made)
            for a, b in chunks(readings):
                chunk = scan(readings[a:b], _LETTERS)
                if len(chunk.starts):
                    decode += [of[a + i] for i in np.unique(chunk.owner()[np.flatnonzero(word_weights(chunk))]).tolist()]
            yield from dict.fromkeys(tokens, (0.0, 0)).items()
            yield from ((token, hidden(token)) for token in dict.fromkeys(decode))

        kept: dict[str, tuple[float, int]] = {}

        for batch in batches:
            column = batch.column(text_col)
            texts, plain = as_bytes(column), column.to_pylist()
            evidence, hits = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for a, b in chunks(texts):
                chunk = scan(texts[a:b], _LETTERS)
                if len(keys) and len(chunk.starts):
                    w = word_weights(chunk)
                    at = np.flatnonzero(w)
                    owner = np.searchsorted(chunk.first, at, side="right") - 1 + a
                    np.add.at(evidence, owner, -np.log(1 - w[at]))
                    np.add.at(hits, owner, 1)
            for a, b in chunks(texts) if len(keys) else ():
                found = [(i, token) for i in range(a, b) if plain[i] for token in disguised(plain[i])]
                said = dict(weigh([token for token in dict.fromkeys(t for _, t in found) if token not in kept]))
                for i, token in found:
                    e, n = kept[token] if token in kept else said[token]
                    evidence[i] += e
                    hits[i] += n
                kept.update((t, x) for t, x in said.items() if len(t) <= 64)
                if len(kept) > 50_000:
                    kept.clear()
            score = 1 / (1 + np.exp(-np.clip(intercept + slope * evidence, -30, 30)))
            yield keep(batch, score, hits, evidence)

    return run


def score_texts(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Per document: id, score, hits (words that the lexicon knows), evidence."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(lexicon.plain())

    def keep(batch, score, hits, evidence):
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array(hits), pa.array(evidence)], names=["id", "score", "hits", "evidence"])

    return source.mapInArrow(lean(_scores(shared, keep)), T.StructType([
        source.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType()), T.StructField("evidence", T.DoubleType())]))


def reject(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon.plain())

    score = _scores(shared, lambda batch, s, *_: (batch, s), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in score(batches):
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; learned from labels outside the held-out third."""
    lexicon = learn(docs, labels, usable=~held_out())
    return score_texts(docs, lexicon, id_col="doc_id").select(
        F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
