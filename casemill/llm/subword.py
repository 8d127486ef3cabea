"""Quality classifier from supervised subword embeddings.

A text is the mean of the vectors of its words and of their character n-grams (hashed into one table), followed by a
softmax over two classes. The vectors and the output layer are learned by stochastic gradient descent in NumPy on a
bounded, documented sample of labelled rows; scoring is a narrow pass over every whole text.

The output is linear in the mean, so for scoring each table row folds into one number (its vector times the difference
of the two output columns). A word then costs one dictionary lookup, or one pass over its n-grams when it is new.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, LONGEST = 3, 5
AGAIN = "\x1fagain\x1f"  # never a word: split() cuts at this character
#: Words kept in a worker's memory of folded words; when full it starts anew, which changes no score.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows per class that training sees; everything else is the model's shape."""

    buckets: int = 1 << 16
    size: int = 16
    epochs: int = 6
    rate: float = 2.0
    sample: int = 1500
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``folded`` has one number per table row; ``bias`` is the log odds of label 1 for a text without words."""

    folded: np.ndarray
    bias: float


def token_counts(text: str | None) -> Counter:
    """Words of a whole text with their counts. A word equal to the one before it adds the mark ``AGAIN``.

    The mark is the one word pair that is alike in every vocabulary; a mean of single words cannot see repetition.
    """
    words = (text or "").split()
    counts = Counter(words)
    if again := sum(map(eq, words, words[1:])):
        counts[AGAIN] = again
    return counts


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all features of the words, and for each feature the index of its word.

    A word in angle brackets contributes itself and its n-grams of 3 to 5 code points. All words are laid out in one
    array, so n-grams of one length are a few array operations.
    """
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # code points from here to the end of the word
    rows, owners = [], []
    prime = np.uint64(1099511628211)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, prime, dtype=np.uint64))
        if len(words):
            place = np.repeat(sizes, sizes) - left
            whole = np.add.reduceat((points + np.uint64(977)) * powers[place], ends - sizes)
            rows.append(_row(whole, buckets))
            owners.append(np.arange(len(words)))
        code = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            size = len(points) - n + 1
            if size <= 0:
                break
            code = code[:size] * prime + points[n - 1:] + np.uint64(n)
            if n >= SHORTEST:
                inside = left[:size] >= n
                rows.append(_row(code[inside], buckets))
                owners.append(owner[:size][inside])
    return (np.concatenate(rows), np.concatenate(owners)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _row(code: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def text_features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a whole text and their shares; none for a null or blank text."""
    counts = token_counts(text)
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    rows, owners = word_features(list(counts), buckets)
    total = np.bincount(rows, weights=np.fromiter(counts.values(), float, len(counts))[owners], minlength=buckets)
    used = np.flatnonzero(total)
    return used, (total[used] / total.sum()).astype(np.float32)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent on (rows, shares, label). Without both labels the score is a constant share."""
    ones = sum(y for *_, y in examples)
    if not ones or ones == len(examples):
        return Model(np.zeros(settings.buckets, np.float32), float(np.log((ones + 1) / (len(examples) - ones + 1))))
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.size)).astype(np.float32) / settings.size
    output = np.zeros((settings.size + 1, 2), np.float32)  # the last row is the bias
    steps, done = settings.epochs * len(examples), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(examples)):
            rows, shares, y = examples[i]
            rate = settings.rate * (1 - done / steps)
            hidden = np.append(shares @ vectors[rows], np.float32(1))
            scores = hidden @ output
            error = np.exp(scores - scores.max())
            error /= error.sum()
            error[y] -= 1
            back = output[:-1] @ error
            output -= rate * np.outer(hidden, error)
            vectors[rows] -= (rate * shares)[:, None] * back
            done += 1
    apart = output[:, 1] - output[:, 0]
    return Model((vectors @ apart[:-1]).astype(np.float32), float(apart[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, where: Column, settings: Settings = Settings()) -> DataFrame:
    """At most ``settings.sample`` labelled texts per class, as features: rows and shares as bytes, label.

    ``where`` tells which labelled ids may be learned from. Ids come in hash order, which is the same on every
    cluster. Rows without an id, a text or a label of 0 or 1 are left out; a repeated id counts once per text,
    within the bound. The label rows that meet the documents are bounded, so they may be broadcast.
    """
    def smallest(df: DataFrame, *by: str) -> DataFrame:
        return df.orderBy(F.xxhash64(*by), *by).limit(settings.sample)

    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(where & F.col("doc_id").isNotNull())
    chosen = [smallest(usable.filter(F.col("label") == y).distinct(), "doc_id") for y in (0, 1)]
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    found = [smallest(texts.join(F.broadcast(c), "doc_id"), "doc_id", "text") for c in chosen]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [text_features(t, settings.buckets) for t in pdf.text]
            yield pd.DataFrame({"rows": [r.astype("<u4").tobytes() for r, _ in parts], "shares": [s.tobytes() for _, s in parts], "label": pdf.label})

    return found[0].unionByName(found[1]).mapInPandas(features, "rows binary, shares binary, label int")


def train(docs: DataFrame, labels: DataFrame, where: Column, settings: Settings = Settings()) -> Model:
    """The model from the bounded sample. One task holds at most twice ``sample`` feature lists and fits them, in an
    order that depends on their content alone; the driver gets the folded table and the bias."""
    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((label, len(r), r, s) for pdf in batches for r, s, label in zip(pdf.rows, pdf.shares, pdf.label.tolist()))
        model = fit([(np.frombuffer(r, "<u4"), np.frombuffer(s, np.float32), y) for y, _, r, s in rows], settings)
        yield pd.DataFrame({"folded": [model.folded.tobytes()], "bias": [model.bias]})

    sample = training_rows(docs, labels, where, settings).repartition(1)
    found = sample.mapInPandas(fitted, "folded binary, bias double").collect()
    return Model(np.frombuffer(found[0].folded, np.float32), found[0].bias) if found else fit([], settings)


def scorer(model: Model):
    """A column function: probability of label 1 for each whole text; null and blank texts get the bias alone."""
    buckets = len(model.folded)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[float, int]] = {}
        for texts in batches:
            yield pd.Series([_score(t, known) for t in texts], dtype="float64")

    def _score(text: str | None, known: dict) -> float:
        counts = token_counts(text)
        new = [w for w in counts if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(counts)
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            rows, owners = word_features(part, buckets)
            sums = np.bincount(owners, weights=model.folded[rows], minlength=len(part))
            known.update(zip(part, zip(sums.tolist(), np.bincount(owners, minlength=len(part)).tolist())))
        total = features = 0.0
        for word, n in counts.items():
            value, size = known[word]
            total += n * value
            features += n * size
        return float(1 / (1 + np.exp(-np.clip(model.bias + (total / features if features else 0.0), -60, 60))))

    return score


def classify(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """``doc_id, score, predicted`` for every row, repeated rows included; null and empty texts have a score too."""
    scored = docs.select("doc_id", scorer(model)("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
