"""Operator 8: toxicity by a small convolutional text classifier, trained here in numpy.

A word's embedding is the mean of hashed embeddings of the word and of its beginnings, so inflected and compound forms share
what was learned. Filters of several widths run over the whole text; each keeps its ``TOP`` largest values (max pooling, of
which the second and third tell a mention from a habit), and a logistic layer turns these into the score. Everything is
trained by gradient descent on a bounded sample of labelled rows: at most ``rows`` rows and ``chars`` characters, taken in
the order of a hash of the id, texts of over a twentieth of the bound last, and ones that do not fit left out; that bound is the only sampling here, and every text is scored whole.

A fifth of the sample is kept back: there the score is calibrated (a logistic fit on standardised logits with smoothed
targets, finite even where the logits separate the classes, then shifted so that 0.3 is the best threshold over all), and
there each language gets the threshold with the best F1 of its own. Scores never see labels,
language, source or id; only the verdict ``rejected`` uses the threshold of the row's language.

A word's dot products with all filters are computed once and looked up, so scoring is a gather, a few sums and a partition.

Defined results: null and empty texts are scored from padding alone; rows with null language, or one without enough labelled
rows, use the threshold over all; without labels of both classes the score is the share of toxic rows (0 if there are none)
and nothing is rejected; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

WIDTHS, FILTERS, TOP, DIM, BUCKET_BITS = (1, 2, 3), 8, 3, 12, 16
BUCKETS = 1 << BUCKET_BITS
_ODD = (np.random.default_rng(3).integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
BEGINNINGS = (3, 4, 5, 6, 7)
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…"
_COLUMNS = FILTERS * sum(WIDTHS)
PAD = max(WIDTHS) + TOP


def pieces_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table of each lower-case word in turn: of the word without punctuation around it, and of its beginnings; and where each word's begin."""
    bare = [w.strip(_PUNCT) for w in words]
    lengths = np.fromiter(map(len, bare), np.int64, len(bare))
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    mixed = (codes + np.uint64(1)) * _ODD[place % len(_ODD)]
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9))])  # a beginning's hash is a difference
    sizes = np.array(BEGINNINGS)[None, :]
    there = np.concatenate([np.ones((len(bare), 1), bool), lengths[:, None] >= sizes], 1)
    stops = starts[:, None] + np.concatenate([lengths[:, None], np.minimum(sizes, lengths[:, None])], 1)
    found = total[stops] - total[starts][:, None]
    found[:, 0] ^= np.uint64(0x5851F42D4C957F2D)  # the whole word is another piece than a beginning with its letters
    found *= np.uint64(0x9E3779B97F4A7C15)
    counts = there.sum(1)
    return (found[there] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.cumsum(counts) - counts


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges in turn."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Model:
    """table: embeddings; filters: (columns, DIM), a column for each filter and place; out, bias: the logistic layer."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.table = g.normal(0, 0.03, (BUCKETS, DIM)).astype(np.float32)
        self.filters = g.normal(0, 0.2, (_COLUMNS, DIM)).astype(np.float32)
        self.out = g.normal(0, 0.1, FILTERS * len(WIDTHS) * TOP).astype(np.float32)
        at = 0
        for width in WIDTHS:  # each filter starts out reading the evidence of its first place
            self.filters[at : at + FILTERS, 0] = 1
            at += width * FILTERS
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0
        self.constant: float | None = None
        self.threshold, self.thresholds = 0.3, {}

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty((0, DIM), np.float32)
        flat, starts = pieces_of(words)
        return np.add.reduceat(self.table[flat], starts, axis=0) / np.diff(starts, append=len(flat))[:, None].astype(np.float32)

    def pooled(self, dots: np.ndarray, ids: np.ndarray, padding: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(filters, TOP) largest values of each filter and their places, for one text; column ``padding`` of dots is that of no word."""
        n = len(ids) + PAD
        found = dots[:, np.concatenate([ids, np.full(PAD + max(WIDTHS), padding)])]
        acts, at = np.empty((FILTERS * len(WIDTHS), n), np.float32), 0
        for g, width in enumerate(WIDTHS):
            part = acts[g * FILTERS : (g + 1) * FILTERS]
            part[:] = found[at : at + FILTERS, :n]
            for k in range(1, width):
                part += found[at + k * FILTERS : at + (k + 1) * FILTERS, k : k + n]
            at += width * FILTERS
        lines = np.arange(len(acts))
        values, places = np.empty((len(acts), TOP), np.float32), np.empty((len(acts), TOP), np.int64)
        for j in range(TOP):
            places[:, j] = best = acts.argmax(1)
            values[:, j] = acts[lines, best]
            acts[lines, best] = -np.inf
        return values, places

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled, 0).ravel() @ self.out + self.bias)

    def score(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * np.asarray(logits, float) + self.shift, -50, 50)))


def _split(text: str | pa.Scalar | None) -> list[str]:
    return ((text.as_py() if isinstance(text, pa.Scalar) else text) or "").lower().split()


class _Sample:
    """Texts as numbers of words, and the words as rows of the embedding table; the texts' words themselves are held once each."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.ids = [np.fromiter((number.setdefault(w, len(number)) for w in _split(t)), np.int32) for t in texts]
        words = list(number)
        parts = [pieces_of(words[k : k + 20_000]) for k in range(0, len(words), 20_000)] or [pieces_of([])]
        self.flat = np.concatenate([flat.astype(np.int32) for flat, _ in parts])
        self.sizes = np.concatenate([np.diff(starts, append=len(flat)) for flat, starts in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def vectors(self, model: Model, words: np.ndarray) -> np.ndarray:
        """Embeddings of some words, and zeros for padding after them."""
        out = np.zeros((len(words) + 1, DIM), np.float32)
        if len(words):
            sizes = self.sizes[words]
            out[:-1] = np.add.reduceat(model.table[self.pieces(words)], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
        return out

    def logits(self, model: Model, docs: np.ndarray) -> np.ndarray:
        found = []
        for at in range(0, len(docs), 200):
            ids = [self.ids[i] for i in docs[at : at + 200]]
            used, inverse = np.unique(np.concatenate(ids), return_inverse=True)
            dots = model.filters @ self.vectors(model, used).T
            found += [model.logit(model.pooled(dots, x)[0]) for x in np.split(inverse, np.cumsum([len(x) for x in ids])[:-1])]
        return np.array(found)

    def pieces(self, words: np.ndarray) -> np.ndarray:
        return self.flat[_within(self.starts[words], self.sizes[words])]


def _step(model: Model, sample: _Sample, docs: np.ndarray, labels: np.ndarray, sums: dict, rate: float) -> None:
    """One step of Adagrad on a batch."""
    ids = [sample.ids[i] for i in docs]
    used, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    ids = np.split(inverse, np.cumsum([len(x) for x in ids])[:-1])
    sizes = sample.sizes[used]
    flat, starts, vectors = sample.pieces(used), np.cumsum(sizes) - sizes, sample.vectors(model, used)
    dots = model.filters @ vectors.T
    d_out, d_bias = np.zeros_like(model.out), 0.0
    rows, columns, grads = [], [], []
    for doc, y in zip(ids, labels):
        values, places = model.pooled(dots, doc)
        z = np.maximum(values, 0)
        p = 1 / (1 + np.exp(-np.clip(z.ravel() @ model.out + model.bias, -30, 30)))
        g = float(p - y)
        d_out += g * z.ravel()
        d_bias += g
        d_z = g * model.out.reshape(values.shape) * (values > 0)
        padded, at = np.concatenate([doc, np.full(PAD + max(WIDTHS), len(used))]), 0
        for i, width in enumerate(WIDTHS):
            of = slice(i * FILTERS, (i + 1) * FILTERS)
            for k in range(width):
                rows.append(padded[places[of] + k].ravel())
                columns.append(np.repeat(np.arange(at, at + FILTERS), TOP))
                grads.append(d_z[of].ravel())
                at += FILTERS
    rows, columns, grads = np.concatenate(rows), np.concatenate(columns), np.concatenate(grads).astype(np.float32)[:, None]
    d_filters, d_vectors = np.zeros_like(model.filters), np.zeros_like(vectors)
    np.add.at(d_filters, columns, grads * vectors[rows])
    np.add.at(d_vectors, rows, grads * model.filters[columns])
    touched = np.flatnonzero(np.abs(d_vectors[:-1]).sum(1))
    for name, grad in (("filters", d_filters), ("out", d_out)):
        sums[name] = sums.get(name, 0) + grad**2
        setattr(model, name, getattr(model, name) - (rate * grad / (np.sqrt(sums[name]) + 1e-6)).astype(np.float32))
    sums["bias"] = sums.get("bias", 0) + d_bias**2
    model.bias -= rate * d_bias / (np.sqrt(sums["bias"]) + 1e-6)
    if len(touched):
        grads = np.repeat(d_vectors[touched] / sizes[touched, None], sizes[touched], axis=0)
        unique, inverse = np.unique(flat[_within(starts[touched], sizes[touched])], return_inverse=True)
        total = np.zeros((len(unique), DIM), np.float32)
        np.add.at(total, inverse, grads)
        squares = sums.setdefault("table", np.zeros(BUCKETS, np.float32))
        squares[unique] += (total**2).mean(1)
        model.table[unique] -= rate * total / (np.sqrt(squares[unique])[:, None] + 1e-6)


def _evidence(model: Model, sample: _Sample, docs: np.ndarray, labels: np.ndarray, doubt: float = 2.0) -> None:
    """Start the embeddings' first dimension at how surely a piece speaks for label 1: its log odds in standard errors, beyond ``doubt``."""
    counts = np.zeros((2, BUCKETS))
    for i, y in zip(docs, labels):
        counts[int(y), np.unique(sample.pieces(np.unique(sample.ids[i])))] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    odds = np.log((counts[1] + 0.5) / (total[1] + 1)) - np.log((counts[0] + 0.5) / (total[0] + 1))
    error = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    model.table[:, 0] = np.clip(odds / error - doubt, 0, 6) / 2


def calibrated(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of a logistic fit of 0/1 labels. Smoothed targets keep it finite; each Newton step is halved until the loss falls."""
    mean, spread = float(logits.mean()), float(logits.std()) or 1.0
    z, n1, n0 = (logits - mean) / spread, truth.sum(), (1 - truth).sum()
    aim = np.where(truth > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], 1)

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, x @ w) - aim * (x @ w)).sum() + 1e-3 * w[0] ** 2)

    w = np.array([1.0, float(np.log((n1 + 1) / (n0 + 1)))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - aim) + np.array([2e-3 * w[0], 0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), grad)
        now, rate = loss(w), 1.0
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    scale = max(float(w[0]), 0.05) / spread  # more evidence never lowers the score
    return scale, float(w[1]) - scale * mean


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """In the middle of the gap where F1 is best; of equal ones, the widest gap."""
    if not 0 < labels.sum() < len(labels):
        return None
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    gaps = s - np.append(s[1:], 0)
    f1[gaps <= 0] = -1
    best = max(range(len(f1)), key=lambda k: (round(f1[k], 6), gaps[k]))
    return float(s[best] - gaps[best] / 2)


def fit(texts: list[str] | pa.ChunkedArray, labels: list[int], langs: list[str | None], epochs: int = 3, batch: int = 32, rate: float = 0.1, seed: int = 7, least: int = 10) -> Model:
    """Train, calibrate and set thresholds; rows of every fifth place are kept back for the last two."""
    model, y = Model(seed), np.array(labels, float)
    if len(y) < 20 or not 0 < y.sum() < len(y):
        model.constant = float(y.mean()) if len(y) else 0.0
        model.threshold = 2.0
        return model
    kept = np.arange(len(y)) % 5 == 4
    train, sums, rng, sample = np.flatnonzero(~kept), {}, np.random.default_rng(seed), _Sample(texts)
    model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    _evidence(model, sample, train, y[train])
    for epoch in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _step(model, sample, rows, y[rows], sums, rate)
    held = np.flatnonzero(kept)
    logits, truth = sample.logits(model, held), y[held]
    model.scale, model.shift = calibrated(logits, truth)
    best = _best_threshold(model.score(logits), truth)
    if best is not None:  # move the best threshold over all to 0.3
        best = min(max(best, 0.01), 0.99)
        model.shift += float(np.log(0.3 / 0.7) - np.log(best / (1 - best)))
    scores = model.score(logits)
    names = np.array([x or "" for x in langs], object)[held]
    for name in set(names) - {""}:
        of = names == name
        if truth[of].sum() >= least and (t := _best_threshold(scores[of], truth[of])) is not None:
            model.thresholds[name] = float(np.clip(t, 0.15, 0.6))
    return model


def model_logits(model: Model, texts: list[str]) -> np.ndarray:
    return _Sample(texts).logits(model, np.arange(len(texts)))


class Scorer:
    """Scores batches of texts; keeps the filters' dot products of at most ``most`` words between batches."""

    def __init__(self, model: Model, most: int = 80_000):
        self.model, self.most = model, most
        self.number: dict[str, int] = {}
        self.dots = np.zeros((_COLUMNS, 1), np.float32)  # column 0 is padding

    def _learn(self, words: list[str]) -> None:
        have, need = len(self.number) + 1, len(self.number) + 1 + len(words)
        if need > self.dots.shape[1]:
            grown = np.zeros((_COLUMNS, max(need, 2 * have)), np.float32)
            grown[:, :have] = self.dots[:, :have]
            self.dots = grown
        self.dots[:, have:need] = self.model.filters @ self.model.words(words).T
        self.number.update(zip(words, range(have, need)))

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [_split(t) for t in texts]
        unique = {w for s in split for w in s}
        new = [w for w in unique if w not in self.number]
        if new and len(self.number) + len(new) > self.most:
            self.number, new = {}, list(unique)
            self.dots = np.zeros((_COLUMNS, 1), np.float32)
        if new:
            self._learn(new)
        ids = [np.fromiter(map(self.number.__getitem__, s), np.int64, len(s)) for s in split]
        return self.model.score(np.array([self.model.logit(self.model.pooled(self.dots, doc, 0)[0]) for doc in ids]))


@tidy
def _scored_rows(batches, model: Model, text: int):
    """Rows (struct, language) whose field ``text`` is scored; a text is in memory once."""
    scorer = Scorer(model)
    for batch in batches:
        texts = batch.column(0).field(text)
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            score = scorer([t if isinstance(t, str) else str(t or "") for t in texts[at : at + 200].to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=["row", "lang", "score"])


@tidy
def _scored(batches, model: Model):
    scorer = Scorer(model)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for at in range(0, batch.num_rows, 500):
            score = scorer(texts[at : at + 500].to_pylist())
            yield pa.RecordBatch.from_arrays([*(c[at : at + 500] for c in batch.columns[:-1]), pa.array(score)], names=[*batch.schema.names[:-1], "score"])


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", rows: int = 8000, chars: int = 40_000_000, **options) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out, within the bounds ``rows`` and ``chars``."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    sample = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # of ``rows`` rows at most
    sample = written(sample, "labelled")
    lengths = sample.select("doc_id", F.xxhash64("doc_id").alias("h"), F.length("text").cast("long").alias("n")).collect()
    left, skipped = chars, []
    for r in sorted(lengths, key=lambda r: (r.n > chars // 20, r.h, r.doc_id)):  # what does not fit is skipped; very long texts come last
        if r.n <= left:
            left -= r.n
        else:
            skipped.append(r.doc_id)
    found = sample.filter(~F.col("doc_id").isin(skipped)).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label", "lang").toArrow()
    return fit(found["text"], found["label"].to_pylist(), found["lang"].to_pylist(), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, score, rejected) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(partial(_scored, model=model), f"doc_id {kind}, lang string, score double")
    return found.withColumn("rejected", F.col("score") >= threshold(model))


def threshold(model: Model, lang_col: str = "lang"):
    """The threshold of the row's language."""
    limit = F.lit(model.threshold)
    for name, value in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang_col) == name, F.lit(value)).otherwise(limit)
    return limit


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, scored in place without a join."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    shape = f"row {rows.schema['row'].dataType.simpleString()}, lang string, score double"
    work = partial(_scored_rows, model=model, text=docs.columns.index(text_col))
    return rows.mapInArrow(work, shape).filter(F.col("score") < threshold(model)).select("row.*")
