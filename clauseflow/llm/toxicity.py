"""Toxicity: averaged subword embeddings under a linear softmax, both learned together in numpy.

A word is the bag of its character n-grams (with the blanks around it) and itself; every n-gram is hashed to one of
`BUCKETS` vectors, so an unseen misspelling shares most of its vectors with the spelling that was learned. A passage is
the mean of its n-gram vectors, and a softmax over two classes follows. Long texts would drown a few abusive words in one
mean, so a text is read in overlapping passages of `PASSAGE` words, all of them; its score is that of its worst passage,
in learning (the gradient goes to that passage) as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import plus, tune
from .wordhash import U, mix, rolling, run_hashes

BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5, 6)
PASSAGE, STRIDE = 16, 8
EPOCHS, STEPS, RATE, BATCH, SEED = 8, 1000, 14.0, 16, 7
FOLDS = 2
#: The model is learned from at most this many labelled documents (those with the smallest hash of doc_id), read whole.
MAX_SAMPLE = 3000
#: ... and no further than the one that brings them to this many bytes.
MAX_BYTES = 64 << 20
THRESHOLD = 0.3
CHUNK_CHARS = 1 << 18
_BLANK = 32
_letters: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def spell(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points with everything but letters as blanks, first and end position and row of each word).

    Letters are lowered. A word that repeats the one before it is left out, so that stuttering pages look like their words.
    """
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    low = [" " + t.lower() + " " for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32).copy()
    isin = _letters[0][np.minimum(chars, 0xFFFF)] | (chars > 0xFFFF)
    chars[~isin] = _BLANK
    edge = np.diff(isin.astype(np.int8))
    first, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    row = np.searchsorted(np.cumsum([len(t) for t in low]), first, side="right")
    h = run_hashes(chars.astype(U), first, end)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return chars, first[new], end[new], row[new]


def gram_ids(chars: np.ndarray) -> list[np.ndarray]:
    """For each n of GRAMS the bucket of the n-gram at every position."""
    return [(rolling(chars.astype(U), n) >> U(48)).astype(np.int64) & (BUCKETS - 1) for n in GRAMS]


def word_ids(chars: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (run_hashes(chars.astype(U), first, end) >> U(48)).astype(np.int64) & (BUCKETS - 1)


def sums(chars: np.ndarray, first: np.ndarray, end: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's summed gains and number of n-grams."""
    total, count = gains[word_ids(chars, first, end)].astype(np.float64), np.ones(len(first), np.int64)
    for n, ids in zip(GRAMS, gram_ids(chars), strict=True):
        run = np.concatenate(([0.0], np.cumsum(gains[ids], dtype=np.float64)))
        many = np.maximum(end - first + 3 - n, 0)
        total += np.where(many > 0, run[np.minimum(first - 1 + many, len(run) - 1)] - run[np.minimum(first - 1, len(run) - 1)], 0.0)
        count += many
    return total, count


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, row) of passages that cover the words of every row with words; bounds as from word_bounds."""
    n = np.diff(bounds)
    many = np.where(n > PASSAGE, -(-(n - PASSAGE) // STRIDE) + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    lo = bounds[row] + np.minimum(nth * STRIDE, np.maximum(n[row] - PASSAGE, 0))
    return lo, np.minimum(lo + PASSAGE, bounds[row + 1]), row


class Model:
    """Embeddings (BUCKETS x DIM), softmax weights (DIM x 2) and biases (2)."""

    def __init__(self, emb: np.ndarray, w: np.ndarray, b: np.ndarray):
        self.emb, self.w, self.b = emb, w, b

    def linear(self) -> tuple[np.ndarray, float]:
        """What each n-gram adds to the log-odds of label 1 before averaging, and the bias: the softmax is linear."""
        return self.emb @ (self.w[:, 1] - self.w[:, 0]), float(self.b[1] - self.b[0])


def scores(texts: list[str], gains: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text; a text without words gets that of the bias."""
    chars, first, end, row = spell(texts)
    total, count = sums(chars, first, end, gains)
    run, many = np.concatenate(([0.0], np.cumsum(total))), np.concatenate(([0], np.cumsum(count)))
    lo, hi, of = passages(np.searchsorted(row, np.arange(len(texts) + 1)))
    z = np.full(len(texts), -np.inf)
    np.maximum.at(z, of, (run[hi] - run[lo]) / (many[hi] - many[lo]))
    z[np.isinf(z)] = 0.0
    return 1 / (1 + np.exp(-np.clip(z + bias, -60, 60)))


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number and row of every word, buckets of each distinct word in one flat array, where each word's begin).

    Texts are taken in blocks, so that only distinct words are kept in full.
    """
    hashes, rows, names, sizes, grams = [], [], [], [], []
    known = np.zeros(0, U)
    at = 0
    while at < len(texts):
        n, size = at, 0
        while n < len(texts) and (n == at or size + len(texts[n]) <= CHUNK_CHARS):
            size += len(texts[n])
            n += 1
        chars, first, end, row = spell(texts[at:n])
        h = run_hashes(chars.astype(U), first, end)
        hashes.append(h)
        rows.append(row + at)
        at = n
        new, example = np.unique(h, return_index=True)
        fresh = ~np.isin(new, known)
        new, example = new[fresh], example[fresh]
        known = np.union1d(known, new)
        f, e = first[example], end[example]
        parts, of = [word_ids(chars, f, e)], [np.arange(len(f))]
        for k, ids in zip(GRAMS, gram_ids(chars), strict=True):
            many = np.maximum(e - f + 3 - k, 0)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            parts.append(ids[np.repeat(f - 1, many) + nth])
            of.append(np.repeat(np.arange(len(f)), many))
        order = np.argsort(np.concatenate(of), kind="stable")
        grams.append(np.concatenate(parts)[order].astype(np.int32))
        names.append(new)
        sizes.append(np.bincount(np.concatenate(of), minlength=len(f)))
    if not hashes:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(1, np.int64)
    name, flat = np.concatenate(names), np.concatenate(grams)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    order = np.argsort(name)
    number = order[np.searchsorted(name[order], np.concatenate(hashes))] if len(name) else np.zeros(0, np.int64)
    return number, np.concatenate(rows), flat, ends


class _Bags:
    """Labelled texts as numbers: their words, each distinct word's n-grams, and their passages."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.words, row, self.flat, self.ends = _vocabulary(texts)
        self.lo, self.hi, of_doc = passages(np.searchsorted(row, np.arange(len(texts) + 1)))
        self.docs, start = np.unique(of_doc, return_index=True)
        self.y, self.start = labels[self.docs], start
        self.passage = np.repeat(np.arange(len(self.docs)), np.diff(np.append(start, len(of_doc))))
        self.grams = np.concatenate(([0], np.cumsum(np.diff(self.ends)[self.words])))
        self.row = row

    def telling(self) -> np.ndarray:
        """For every passage how much its most telling word speaks for label 1: the log-odds of documents with the word, over
        their standard error."""
        n_words, of = len(self.ends) - 1, np.searchsorted(self.docs, self.row)
        seen = np.unique(self.words.astype(np.int64) * len(self.docs) + of)
        label = self.y[seen % len(self.docs)]
        yes = np.bincount(seen // len(self.docs), weights=label, minlength=n_words) + 0.5
        no = np.bincount(seen // len(self.docs), weights=1 - label, minlength=n_words) + 0.5
        odds = np.log(yes / (self.y.sum() + 1)) - np.log(no / ((1 - self.y).sum() + 1))
        each = (odds / np.sqrt(1 / yes + 1 / no))[self.words]
        view = np.lib.stride_tricks.sliding_window_view(np.append(each, np.full(PASSAGE - 1, -np.inf)), PASSAGE)
        short = np.arange(PASSAGE)[None, :] < (self.hi - self.lo)[:, None]
        return np.where(short, view[self.lo], -np.inf).max(1)

    def scored(self, model: Model) -> np.ndarray:
        """Every passage's log-odds before the bias."""
        each = np.add.reduceat(model.linear()[0][self.flat], self.ends[:-1])
        gain = np.concatenate(([0.0], np.cumsum(each[self.words], dtype=np.float64)))
        return (gain[self.hi] - gain[self.lo]) / (self.grams[self.hi] - self.grams[self.lo])

    def worst(self, score: np.ndarray) -> np.ndarray:
        """For every document its first passage with the highest score."""
        top = np.flatnonzero(score == np.maximum.reduceat(score, self.start)[self.passage])
        return top[np.unique(self.passage[top], return_index=True)[1]]


def _spread(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ..., for many[0] numbers, then from lo[1] on, and so forth."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())


def train(texts: list[str], labels: list[int]) -> Model:
    """Minibatch gradient descent over (text, label) with a falling rate; without two different labels a model of the bias alone.

    In the first quarter of the epochs a document's passage is the one with its most telling word, then the one that the model
    itself scores highest. Small samples have more epochs, up to STEPS minibatches.
    """
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        b[1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Model(emb * 0, w, b)
    b[1] = np.log(y.mean() / (1 - y.mean()))
    bags, model = _Bags(texts, y), Model(emb, w, b)
    if not len(bags.words):
        return Model(emb * 0, w, b)
    telling = bags.worst(bags.telling())
    epochs = max(EPOCHS, min(8 * EPOCHS, -(-STEPS * BATCH // len(bags.docs))))
    sizes = np.diff(bags.ends)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags.docs))
        pick = (telling if 4 * epoch < epochs else bags.worst(bags.scored(model)))[order]
        lo, many = bags.lo[pick], bags.hi[pick] - bags.lo[pick]
        own = bags.words[_spread(lo, many)]
        grams = bags.flat[_spread(bags.ends[own], sizes[own])]
        cut = np.concatenate(([0], np.cumsum(bags.grams[bags.hi[pick]] - bags.grams[bags.lo[pick]])))
        for at in range(0, len(order), BATCH):
            end = min(at + BATCH, len(order))
            ids, n = grams[cut[at] : cut[end]], np.diff(cut[at : end + 1])
            mean = np.add.reduceat(emb[ids], cut[at:end] - cut[at], axis=0) / n[:, None].astype(np.float32)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(end - at), bags.y[order[at:end]]] -= 1
            each = np.repeat((p @ w.T) / n[:, None], n, axis=0)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], ids[by][1:] != ids[by][:-1])))
            emb[ids[by][first]] -= rate * np.add.reduceat(each[by], first, axis=0).astype(np.float32)
            w -= rate * 0.0125 * (mean.T @ p).astype(np.float32)
            b -= rate * 0.0025 * p.sum(0).astype(np.float32)
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds from which on calling a document label 1 has the highest F1, midway to the next lower ones."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def calibrated(texts: list[str], labels: list[int]) -> Model:
    """A model of all texts whose THRESHOLD is the best cut: FOLDS models of the other texts score each fold, and the bias moves
    the cut that is best for these scores to THRESHOLD."""
    y = np.array(labels, np.int64)
    model = train(texts, labels)
    fold = np.random.default_rng(SEED).permutation(len(y)) % FOLDS
    if len(y) < 2 * FOLDS or not 2 * FOLDS <= y.sum() <= len(y) - 2 * FOLDS:
        return model
    z = np.zeros(len(y))
    for k in range(FOLDS):
        part = train([t for t, f in zip(texts, fold) if f != k], y[fold != k].tolist())
        own = scores([t for t, f in zip(texts, fold) if f == k], *part.linear())
        z[fold == k] = np.log(own) - np.log1p(-np.minimum(own, 1 - 1e-12))
    model.b[1] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(z, y)
    return model


def sample(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of at most max_sample learning rows, in a fixed order."""
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    # Broadcast: at most max_sample rows. Of rows that share a doc_id one text is read.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < MAX_BYTES).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [int(r["toxic"] == 1) for r in rows]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without its text, with score (0 to 1) and predicted; null and wordless texts get the bias's score."""
    keep = [c for c in docs.columns if c not in (text, "score")]
    gains, bias = model.linear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block: list[str] = []
            size, out = 0, [np.zeros(0)]
            for v in b.column(len(keep)):
                t = v.as_py() or ""
                if block and size + len(t) > CHUNK_CHARS:
                    out.append(scores(block, gains, bias))
                    block, size = [], 0
                block.append(t)
                size += len(t)
            if block:
                out.append(scores(block, gains, bias))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.concatenate(out))], names=[*keep, "score"])

    tune(docs.sparkSession)
    cols = [F.col(f"`{c}`") for c in keep]
    found = docs.select(*cols, F.col(text)).mapInArrow(run, plus(docs.select(*cols).schema, "score double"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; a null doc_id counts as not held out.

    Null, empty and wordless texts get the bias's score, texts of any length are read whole, repeated rows count each; other
    columns of docs are left out, an empty table gives no rows, and labels of one kind only a score that is the same for all.
    """
    found = score(docs.select("doc_id", "text"), calibrated(*sample(docs, labels, max_sample)))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
