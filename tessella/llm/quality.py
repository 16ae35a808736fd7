"""Quality classifier by co-training.

Two views of a document are learned apart: its text (shares of letters, capitals,
figures, signs and repeated words, lengths) and its page metadata (language, source,
length). Each view's classifier labels all unlabelled documents; those it is most sure
of, as many of either class as the labels have by share, are handed to the other view's
training set, round after round. In the end each view is calibrated (a logistic curve
of one slope that is not negative) on labelled documents set aside, and a logistic
combination of both calibrated views, again without negative slopes, scores every
document: what both views like more never scores less.

Everything is learned from all rows: numbers of each document are worked out once and
written, and each Newton step is a pass that sums its matrix in the tasks. A pass knows
which documents have been handed over from the classifiers and limits of the rounds so
far, and a limit comes from a histogram of the scores, so only matrices, histograms and
weights reach the driver. Labels and ids are never inputs of a score.

Defined results: null texts are empty; a null language or source is a value of its
own; a document labelled more than once counts by its lowest label; a repeated document
counts as often as it stands; documents with a null id are never labelled; equal scores
at a limit are handed over together; without labels of both classes every score is the
share of good labels, or 1 without labels. Columns other than the named ones are passed
through by ``reject`` and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessella.llm._words import SPACED, as_bytes, chunks, scan
from tessella.session import lean, materialise, ship, tidy

ROUNDS = 4
#: Newton steps of a fit at most.
STEPS = 9
#: Share of the unlabelled documents that a view hands over in a round.
HANDED = 0.05
#: Probability that a handed label needs, if both classes were as frequent; that of the more frequent class needs its odds besides.
CONFIDENT = 0.9
#: Documents below go: those that are clearly poor.
THRESHOLD = 0.2
TEXT_NUMBERS = 16
META_SLOTS = 64

_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = 3
_CLASS[10] = 4
for _c in b".,;:'\"-?()":
    _CLASS[_c] = 5
_CLASS[ord("!")] = 6
_CLASS[128:192], _CLASS[192:] = 8, 9


def text_view(texts: list[bytes]) -> np.ndarray:
    """Numbers of each text's content, a row a text."""
    rows = []
    for a, b in chunks(texts):
        part = texts[a:b]
        chunk = scan(part, SPACED)
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        sizes = np.diff(chunk.offsets)
        owner = np.repeat(np.arange(b - a), sizes)
        kinds = np.bincount(owner * 10 + _CLASS[raw], minlength=(b - a) * 10).reshape(b - a, 10).astype(float)
        kinds[:, 3] -= 1
        letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 9]
        chars = np.maximum(kinds.sum(1) - kinds[:, 8], 1)
        words = np.maximum(np.diff(chunk.first), 1).astype(float)
        mine, n = chunk.owner(), b - a
        lengths = (chunk.ends - chunk.starts).astype(float)
        count = lambda where: np.bincount(mine[where], minlength=n) / words
        again = np.append(False, (chunk.hashes[1:] == chunk.hashes[:-1]) & (mine[1:] == mine[:-1])) if len(mine) else np.zeros(0, bool)
        order = np.lexsort((chunk.hashes, mine))
        new = np.append(True, (np.diff(chunk.hashes[order].view(np.int64)) != 0) | (np.diff(mine[order]) != 0)) if len(mine) else np.zeros(0, bool)
        last = _CLASS[raw[chunk.ends - 1]] if len(mine) else np.zeros(0, np.uint8)
        rows.append(np.stack([
            kinds[:, 1] / np.maximum(letters, 1), kinds[:, 2] / chars, kinds[:, 4] / chars, kinds[:, 5] / chars, kinds[:, 6] / chars, kinds[:, 7] / chars, letters / chars,
            kinds[:, 9] / np.maximum(letters, 1), np.log1p(words), np.bincount(mine, lengths, n) / words, count(again), np.bincount(mine[order], new, n) / words,
            count(last == 7), count(last == 6), count(lengths == 1), count(lengths > 20),
        ], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 16))


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Numbers of each document's metadata: slots of hashed language and source, length, and whether that is missing."""
    slot = lambda kind, values: [zlib.crc32(f"{kind}={x}".encode()) % META_SLOTS for x in values]
    lengths = [np.log1p(max(n or 0, 0)) for n in n_chars]
    return np.array([slot("lang", lang), slot("source", source), lengths, [float(n is None) for n in n_chars]], float).T.reshape(len(lang), 4)


def wide_text(x: np.ndarray) -> np.ndarray:
    """Standardised numbers, their squares, and a constant."""
    x = np.clip(x, -8, 8)
    return np.concatenate([np.ones((len(x), 1)), x, np.clip(x, -4, 4) ** 2], axis=1)


def wide_meta(x: np.ndarray) -> np.ndarray:
    """An indicator of each slot, the standardised length and its square, and a constant."""
    out = np.zeros((len(x), META_SLOTS + 4))
    rows = np.arange(len(x))
    for c in (0, 1):
        out[rows, x[:, c].astype(int)] += 1
    length = np.clip(x[:, 2], -8, 8)
    out[:, META_SLOTS:] = np.stack([np.ones(len(x)), length, np.clip(length, -4, 4) ** 2, x[:, 3]], axis=1)
    return out


WIDE = (wide_text, wide_meta)
WIDTHS = (2 * TEXT_NUMBERS + 1, META_SLOTS + 4)


@dataclass
class Views:
    """Both views' weights, with what standardises their numbers: (mean, scale) of the text's, and of the length."""

    mean: tuple[np.ndarray, np.ndarray]
    scale: tuple[np.ndarray, np.ndarray]
    weights: list[np.ndarray]

    def wide(self, v: int, x: np.ndarray) -> np.ndarray:
        return WIDE[v]((x - self.mean[v]) / self.scale[v])

    def logit(self, v: int, x: np.ndarray) -> np.ndarray:
        return np.clip(self.wide(v, x) @ self.weights[v], -30, 30)


@dataclass
class Quality:
    """views: None without labels of both classes. curves: intercept and slope of each view; blend: intercept and slopes of the calibrated views."""

    views: Views | None
    curves: np.ndarray | None
    blend: np.ndarray | None
    share: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(text), self.share)
        seen = [self.curves[v, 0] + self.curves[v, 1] * self.views.logit(v, x) for v, x in ((0, text), (1, meta))]
        return _chance(self.blend[0] + self.blend[1] * seen[0] + self.blend[2] * seen[1])


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton(sums, weights: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Logistic regression; sums(weights) gives the matrix and the gradient of the likelihood, the first weight is free."""
    penalty = ridge * np.eye(len(weights))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        matrix, gradient = sums(weights)
        step = np.linalg.solve(matrix + penalty, gradient + penalty @ weights)
        weights = weights - step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-5:
            break
    return weights


def _normal(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _chance(x @ w)
    return (x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - y)


@dataclass
class Round:
    """What a view handed over in a round: documents of a logit of ``good`` at least, and of ``poor`` at most."""

    weights: np.ndarray
    good: float
    poor: float


def handed(views: Views, rounds: list[list[Round]], v: int, x: np.ndarray) -> np.ndarray:
    """Labels that view v has handed over so far, of the numbers x of that view: the first round that was sure counts; nan: none."""
    out = np.full(len(x), np.nan)
    if rounds:
        wide = views.wide(v, x)
        for r in rounds:
            z, free = np.clip(wide @ r[v].weights, -30, 30), np.isnan(out)
            out[free & (z >= r[v].good)] = 1.0
            out[free & (z <= r[v].poor)] = 0.0
    return out


#: Bins of logits between -30 and 30.
_BINS = 12_000


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + 30) * (_BINS / 60)).astype(int), 0, _BINS - 1)


def limits(counts: np.ndarray, most: float, share: float) -> tuple[float, float]:
    """Logits from which, and to which, documents are handed over: whole bins, as many as the shares allow, all sure enough."""
    sure, odds = np.log(CONFIDENT / (1 - CONFIDENT)), np.log(share / (1 - share))
    place = lambda z: int(np.ceil((z + 30) * (_BINS / 60)))
    above, below = np.cumsum(counts[::-1])[::-1], np.cumsum(counts)
    good = np.flatnonzero(above <= most * share)
    poor = np.flatnonzero(below <= most * (1 - share))
    first = max(int(good[0]) if len(good) else _BINS, place(sure + max(0.0, odds)))
    last = min(int(poor[-1]) if len(poor) else -1, place(-sure + min(0.0, odds)) - 1)
    return first * 60 / _BINS - 30, (last + 1) * 60 / _BINS - 30 - 1e-9


_NUMBERS = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("aside", T.BooleanType()), T.StructField("text", T.ArrayType(T.DoubleType())), T.StructField("meta", T.ArrayType(T.DoubleType()))])


#: Rows of numbers that a pass works on at once.
_PASS_ROWS = 8192


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in larger pieces."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _PASS_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column("sums").to_pylist():
            own = np.frombuffer(row)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


#: Rows of sums that the driver adds up; more are first added in as many tasks.
_DRIVER_SUMS = 256


def summed(rows: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all batches of what function(label, aside, text numbers, meta numbers) gives: ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for table in _larger(batches):
            label = table.column("label").to_numpy().astype(float)
            total += function(label, table.column("aside").to_numpy().astype(bool), _matrix(table, "text", TEXT_NUMBERS), _matrix(table, "meta", 4))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.mapInArrow(lean(run), "sums binary")
    if rows.rdd.getNumPartitions() > _DRIVER_SUMS:
        parts = parts.repartition(_DRIVER_SUMS).mapInArrow(lean(_sum_rows), "sums binary")
    return sum((np.frombuffer(r) for r in parts.toArrow().column("sums").to_pylist()), np.zeros(size))


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> Quality:
    """rows of ``_NUMBERS``: both views' classifiers after the rounds, calibrated and combined on the labelled rows set aside."""
    def count(label, aside, text, meta):
        known = ~np.isnan(label)
        tally = [[(known & (aside == a) & (label == y)).sum() for y in (0, 1)] for a in (False, True)]
        return np.concatenate([np.ravel(tally), [len(label), (~known).sum()], text.sum(0), (text**2).sum(0), [meta[:, 2].sum(), (meta[:, 2] ** 2).sum()]])

    k = TEXT_NUMBERS
    sums = summed(rows, count, 8 + 2 * k)
    (poor, good, aside_poor, aside_good), n, pool = sums[:4], max(sums[4], 1), sums[5]
    labelled = sums[:4].sum()
    share = float((good + aside_good) / labelled) if labelled else 1.0
    if min(good, poor) < 2 or min(aside_good, aside_poor) < 1:
        return Quality(None, None, None, share)
    spread = lambda total, squares: np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    scale = spread(sums[6 : 6 + k], sums[6 + k : 6 + 2 * k])
    length, apart = sums[-2] / n, float(spread(sums[-2], sums[-1]))
    views = Views((sums[6 : 6 + k] / n, np.array([0, 0, length, 0])), (np.where(scale > 1e-9, scale, 1.0), np.array([1, 1, apart if apart > 1e-9 else 1.0, 1])), [np.zeros(w) for w in WIDTHS])
    done: list[list[Round]] = []
    train = rows.where("label IS NULL OR NOT aside")

    def fit(source: DataFrame, steps: int) -> None:
        """Both views at once; a view learns from labels and from what the other has handed over."""
        still = [True, True]
        # From nothing: where weights are large already, a Newton step sees no slope.
        views.weights[:] = [np.zeros(w) for w in WIDTHS]
        for _ in range(steps):
            def parts(label, aside, text, meta, views=Views(views.mean, views.scale, list(views.weights)), done=list(done)):
                out, x = [], (text, meta)
                for v, other in ((0, 1), (1, 0)):
                    y = np.where(np.isnan(label), handed(views, done, other, x[other]), label)
                    at = ~np.isnan(y)
                    matrix, gradient = _normal(views.wide(v, x[v][at]), y[at], views.weights[v])
                    out += [matrix.ravel(), gradient]
                return np.concatenate(out)

            found = summed(source, parts, sum(w * w + w for w in WIDTHS))
            at = 0
            for v, w in enumerate(WIDTHS):
                matrix, gradient = found[at : at + w * w].reshape(w, w), found[at + w * w : at + w * w + w]
                at += w * w + w
                new = newton(lambda _: (matrix, gradient), views.weights[v], 3.0, 1)  # noqa: B023
                still[v] = bool(np.abs(new - views.weights[v]).max() > 1e-3)
                views.weights[v] = new
            if not any(still):
                break

    known = materialise(train.where("label IS NOT NULL"), "quality-known")
    fit(known, STEPS)
    for _ in range(rounds if pool else 0):
        def histogram(label, aside, text, meta, views=views, done=list(done)):
            out, x, open_ = [], (text, meta), np.isnan(label)
            for v in (0, 1):
                free = open_ & np.isnan(handed(views, done, v, x[v]))
                out.append(np.bincount(_bin(views.logit(v, x[v][free])), minlength=_BINS))
            return np.concatenate(out).astype(float)

        counts = summed(train, histogram, 2 * _BINS)
        made = [Round(views.weights[v].copy(), *limits(counts[v * _BINS : (v + 1) * _BINS], HANDED * pool, share)) for v in (0, 1)]
        done.append(made)
        fit(train, STEPS)
        tidy(rows.sparkSession)

    held = rows.where("label IS NOT NULL AND aside")

    def logits(text, meta):
        return [views.logit(v, x) for v, x in ((0, text), (1, meta))]

    def curve(columns, start, ridge):
        """Logistic regression on the rows set aside, of columns(both views' logits), without negative slopes."""
        used = list(range(1, len(start)))
        while True:
            def sums_of(w, used=list(used)):
                def parts(label, aside, text, meta):
                    x = np.stack([np.ones(len(label)), *[columns(logits(text, meta))[i - 1] for i in used]], axis=1)
                    matrix, gradient = _normal(x, label, w)
                    return np.concatenate([matrix.ravel(), gradient])

                size = len(used) + 1
                found = summed(held, parts, size * size + size)
                return found[: size * size].reshape(size, size), found[size * size :]

            w = newton(sums_of, np.array([start[0], *[start[i] for i in used]]), ridge, 10)
            if not used or w[1:].min() >= 0:
                out = np.zeros(len(start))
                out[0] = w[0]
                out[used] = w[1:]
                return out
            used.pop(int(w[1:].argmin()))

    curves = np.stack([curve(lambda z, v=v: [z[v]], np.array([0.0, 1.0]), 1e-2) for v in (0, 1)])
    blend = curve(lambda z: [curves[v, 0] + curves[v, 1] * z[v] for v in (0, 1)], np.array([0.0, 0.5, 0.5]), 1e-2)
    return Quality(views, curves, blend, share)


def learn(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, rounds: int = ROUNDS) -> Quality:
    """docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality. usable: which label rows may be learned from."""
    ship(docs.sparkSession)
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    # Labels that may not be learned from keep their documents out altogether.
    may = F.coalesce(usable, F.lit(False)) if usable is not None else F.lit(True)
    known = rows.select(F.col("doc_id").cast("long").alias("id"), F.when(may, F.col("quality").cast("int") > 0).cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    known = known.withColumn("known", F.lit(True)).withColumn("aside", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    # Texts are not shuffled: numbers first, labels then.
    plain = materialise(source.mapInArrow(lean(_with_id), T.StructType([T.StructField("id", T.LongType()), *_NUMBERS.fields[2:]])), "quality-numbers")
    joined = plain.join(known, "id", "left").where("known IS NULL OR label IS NOT NULL")
    return co_train(materialise(joined.select("label", F.coalesce("aside", F.lit(False)).alias("aside"), "text", "meta"), "quality-rows"), rounds)


def _with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = text_view(as_bytes(batch.column("text")))
        meta = meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))], names=["id", "text", "meta"])


def _scored(shared, keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield keep(batch, shared.value.score(text_view(as_bytes(batch.column("text"))), meta))

    return run


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """Per document: doc_id, score (probability of good quality)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", F.col("text").cast("string"), "lang", "source", "n_chars")

    def keep(batch, p):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return source.mapInArrow(lean(_scored(shared, keep)), T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def reject(docs: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score the threshold at least, with all their columns."""
    ship(docs.sparkSession)
    return docs.mapInArrow(lean(_scored(docs.sparkSession.sparkContext.broadcast(model), lambda batch, p: batch.filter(pa.array(p >= threshold)))), docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (labels of this third are not learned from), score, kept."""
    model = learn(docs, labels, usable=~held_out())
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).alias("kept"))
