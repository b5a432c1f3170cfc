"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel of two strings sums, over all subsequences of ``LENGTH`` letters, the product of their weights in both; a
weight is DECAY to the power of the span, so letters put in between lower the kernel instead of breaking the match.
Landmarks are beginnings of words that, together, account for the toxic documents of the fitting sample.  Landmarks of ``SHORT`` letters
or fewer are compared by ``SHORT_LENGTH`` letters.  A sentence's response to a landmark is the largest kernel of one of its tokens with the landmark, as a share of the landmark's kernel
with itself.  The inverse root of the landmarks' kernel matrix turns responses into Nyström features, on which a
linear machine is trained: clean documents give negative sentences, a toxic one gives its strongest sentence, and
each landmark with an inserted, dropped or swapped letter is a further positive one.  A document scores as its STRONGEST
sentences together, so several weak ones count as a strong one does.

The model is fitted on a bounded sample of labelled rows (``fit_rows`` of each class) and is some kilobytes; scoring is
one pass in which each worker remembers its tokens' responses.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, materialize, one_cache, texts

LENGTH = 4
DECAY = 0.8
SHORT, SHORT_LENGTH = 5, 3  # landmarks of so few letters are compared by shorter subsequences
FLOOR = 0.3  # a smaller share of a landmark's kernel is no response
PART = 16  # tokens of a sentence that are read as one; longer ones are cut
STRONGEST = 3  # sentences that a document is scored by
WIDTH = 24  # letters of a token that are compared at once; longer tokens are read in overlapping windows
LANDMARK = (4, 12)
LANDMARKS = 64
CANDIDATES = 3_000
MIN_SHARE = 0.002  # of the sampled toxic documents (two at least) that a landmark accounts for
AGAIN = 0.5  # what a document counts for, for each landmark that accounts for it already
FIT_ROWS = 4_000
CARE = 2.0  # what a clean document taken for toxic weighs, against a toxic one that is missed
CACHE_ENTRIES = 300_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_SENTENCE = re.compile(r"(?<=[.!?])\s|\n")
_SPACED = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){2,}(?!\S)")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from; a row without doc_id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def views(token: str) -> list[str]:
    """What of a token is compared: its letters, in windows that overlap by half."""
    letters = _NOT_LETTER.sub("", token.lower())
    if len(letters) <= WIDTH:
        return [letters]
    return [letters[k:k + WIDTH] for k in range(0, len(letters) - WIDTH // 2, WIDTH // 2)]


def tokens(sentence: str) -> list[str]:
    """The stretches between white space; letters set apart by spaces or marks are one token as well."""
    return sentence.split() + ["".join(_NOT_LETTER.split(m[0])) for m in _SPACED.finditer(sentence)]


def _codes(strings: list[str]) -> np.ndarray:
    return np.array(strings, f"U{WIDTH}").view(np.uint32).reshape(len(strings), WIDTH).astype(np.int64)


def kernel(strings: np.ndarray, others: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of row k of ``strings`` with row k of ``others`` (code points, padded with 0)."""
    strings = strings[:, :max(1, int((strings > 0).sum(axis=1).max(initial=0)))]
    others = others[:, :max(1, int((others > 0).sum(axis=1).max(initial=0)))]
    n, wide = others.shape
    step = np.arange(wide)
    power = np.where(step[None, :] >= step[:, None], decay ** np.abs(step[None, :] - step[:, None]).astype(float), 0.0)
    inner = [np.ones((n, wide + 1))] + [np.zeros((n, wide + 1)) for _ in range(length - 1)]
    total = np.zeros(n)
    for k in range(strings.shape[1]):
        same = (strings[:, k:k + 1] == others) & (others > 0)
        if not same.any():
            for i in range(1, length):
                inner[i] *= decay
            continue
        total += decay ** 2 * (inner[length - 1][:, :-1] * same).sum(axis=1)
        for i in range(length - 1, 0, -1):
            inner[i] *= decay
            inner[i][:, 1:] += decay ** 2 * ((inner[i - 1][:, :-1] * same) @ power)
    return total


class Responses:
    """Responses of tokens to landmarks.

    A pair's kernel is computed unless a bound on its share is below FLOOR: subsequences of letters that the token lacks give
    nothing, and each of the others occurs in the token in a bounded number of ways, of LENGTH letters' span at least.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = _codes(landmarks)
        self.lengths = np.array([SHORT_LENGTH if len(x) <= SHORT else LENGTH for x in landmarks])
        self.own = np.array([kernel(c[None], c[None], n)[0] for c, n in zip(self.codes, self.lengths, strict=True)])
        self.letters = sorted(set("".join(landmarks)))
        self.places = [np.array([self.letters.index(c) for c in sorted(set(x))]) for x in landmarks]
        self.bounds = [_bounds(x, int(n)) / own for x, n, own in zip(landmarks, self.lengths, self.own, strict=True)]

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of strings and landmarks whose share may reach FLOOR."""
        counts = np.stack([(codes == ord(c)).sum(axis=1) for c in self.letters], axis=1)
        ways = np.concatenate([np.maximum(0, counts - k) / (k + 1) for k in range(LENGTH)], axis=1)
        ways = np.maximum(1.0, -np.partition(-ways, LENGTH - 1, axis=1)[:, :LENGTH])
        ways = np.cumprod(-np.sort(-ways, axis=1), axis=1)
        has = counts > 0
        a, b = [], []
        for k, (places, bound) in enumerate(zip(self.places, self.bounds, strict=True)):
            share = bound[has[:, places] @ (1 << np.arange(len(places)))] * ways[:, self.lengths[k] - 1]
            a.append(np.flatnonzero(share >= FLOOR - 1e-9))
            b.append(np.full(len(a[-1]), k))
        return np.concatenate(a), np.concatenate(b)

    def __call__(self, strings: list[str]) -> np.ndarray:
        """One row for each string, one column for each landmark, between 0 and 1."""
        parts = [(k, v) for k, s in enumerate(strings) for v in views(s) if len(v) >= SHORT_LENGTH]
        out = np.zeros((len(strings), len(self.landmarks)))
        for at in range(0, len(parts), 20_000):
            chunk = parts[at:at + 20_000]
            rows = np.array([k for k, _ in chunk])
            codes = _codes([v for _, v in chunk])
            a, b = self.pairs(codes)
            for length in np.unique(self.lengths):
                of = np.flatnonzero(self.lengths[b] == length)
                for k in range(0, len(of), 20_000):
                    x, y = a[of[k:k + 20_000]], b[of[k:k + 20_000]]
                    share = np.minimum(1.0, kernel(codes[x], self.codes[y], int(length)) / self.own[y])
                    np.maximum.at(out, (rows[x], y), np.maximum(0.0, (share - FLOOR) / (1 - FLOOR)))
        return out


def _bounds(landmark: str, length: int) -> np.ndarray:
    """For each set of the landmark's letters (bits, in sorted order): the kernel with a string in which each subsequence
    of these letters occurs once, without gaps."""
    bit = {c: 1 << k for k, c in enumerate(sorted(set(landmark)))}
    out = np.zeros(1 << len(bit))
    for at in combinations(range(len(landmark)), length):
        mask = 0
        for i in at:
            mask |= bit[landmark[i]]
        out[mask] += DECAY ** (at[-1] - at[0] + 1 + length)
    for b in bit.values():
        held = np.flatnonzero(np.arange(len(out)) & b)
        out[held] += out[held - b]
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of responses: the machine's weights by the Nyström map
    bias: float
    slope: float
    shift: float

    def probability(self, margin: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.slope * margin + self.shift))))


class Scorer:
    """Scores texts; remembers the responses of tokens."""

    def __init__(self, model: Model, entries: int = CACHE_ENTRIES):
        self.model, self.entries = model, entries
        self.responses = Responses(model.landmarks) if model.landmarks else None
        self.kept: dict[str, np.ndarray | None] = {}

    def learn(self, batch: list[str]) -> list[bool]:
        """Find the responses of all new tokens of a batch at once; tells which texts have any."""
        if len(self.kept) > self.entries:
            self.kept.clear()
        found = [tokens(t) for t in batch]
        names = list(set(chain.from_iterable(found)).difference(self.kept))
        for at in range(0, len(names), 20_000):
            part = names[at:at + 20_000]
            seen = self.responses(part)
            self.kept.update(dict.fromkeys(part))
            self.kept.update((part[k], seen[k]) for k in np.flatnonzero(seen.any(axis=1)))
        return [any(map(_some, map(self.kept.get, x))) for x in found]

    def sentences(self, text: str) -> np.ndarray:
        """Responses of the sentences that have any."""
        get, out = self.kept.get, []
        for s in _SENTENCE.split(text):
            words = tokens(s)
            for at in range(0, len(words), PART):
                found = [r for t in words[at:at + PART] if (r := get(t)) is not None]
                if found:
                    out.append(np.max(found, axis=0))
        return np.array(out).reshape(-1, len(self.model.landmarks))

    def margins(self, batch: list[str]) -> list[float]:
        bias = self.model.bias
        if self.responses is None:
            return [bias] * len(batch)
        return [bias + self.strongest(t) if some else bias for t, some in zip(batch, self.learn(batch), strict=True)]

    def strongest(self, text: str) -> float:
        found = np.maximum(0.0, self.sentences(text) @ self.model.weights)
        return float(np.sort(found)[-STRONGEST:].sum())


def _some(response: np.ndarray | None) -> bool:
    return response is not None


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may be learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text and toxic of at most ``fit_rows`` labelled rows of each class, near copies mostly once.

    Rows are taken in the order of a hash of doc_id; the labels of those rows are all that is broadcast.
    """
    known = known_labels(labels)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(fit_rows).union(
        known.where("toxic = 0").orderBy(*order).limit(fit_rows))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")
    long_words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: F.length(w) >= 8))
    mark = F.slice(F.array_sort(F.transform(long_words, lambda w: F.xxhash64(w))), 1, 3)
    return rows.withColumn("mark", F.when(F.size(mark) == 3, F.xxhash64(mark)).otherwise(F.xxhash64("text"))) \
        .dropDuplicates(["mark", "toxic"]).select("doc_id", "text", "toxic")


def beginnings(text: str) -> set[str]:
    low, high = LANDMARK
    words = {_NOT_LETTER.sub("", t) for t in text.lower().split()}
    return {w[:k] for w in words for k in range(low, min(high, len(w)) + 1)}


def choose_landmarks(sample: DataFrame, n: int = LANDMARKS) -> list[str]:
    """Beginnings of words, greedily: each accounts for the most toxic documents that others do not account for.

    Spark counts the documents of either class that hold each beginning; CANDIDATES of them and the lists of those that each
    sampled toxic document holds come to the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                seen[toxic].update(beginnings(text))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield rows(seen)
                seen = (Counter(), Counter())
        yield rows(seen)

    def rows(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()),
             pa.array([seen[0][x] for x in names], pa.int64())], names=["start", "toxic", "clean"])

    counts = sample.mapInArrow(count, "start string, toxic long, clean long")
    counts = counts.groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    top = counts.where("toxic >= 2").withColumn("odds", odds).where("odds > 1")
    top = top.orderBy((F.col("odds") * F.col("toxic")).desc(), F.length("start").desc(), "start").limit(CANDIDATES).collect()
    clean = {r["start"]: r["clean"] * max(1.0, sizes[1] / sizes[0]) for r in top}
    place = {name: k for k, name in enumerate(clean)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[b] for b in beginnings(t) if b in place) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["held"])

    bags = [set(r["held"]) for r in sample.where("toxic = 1").select("text").mapInArrow(held, "held array<int>").collect()]
    least = max(2.0, MIN_SHARE * sizes[1])
    names, chosen, worth = list(clean), [], [1.0] * len(bags)
    while len(chosen) < n:
        gain: Counter = Counter()
        for bag, w in zip(bags, worth, strict=True):
            for k in bag:
                gain[k] += w
        best = max(gain, key=lambda k: (gain[k] - 3 * clean[names[k]], len(names[k]), names[k]), default=None)
        if best is None or gain[best] - 3 * clean[names[best]] < least:
            break
        chosen.append(names[best])
        worth = [w * AGAIN if best in bag else w for bag, w in zip(bags, worth, strict=True)]
        for bag in bags:  # what begins with it, or begins it, says the same
            bag -= {k for k in bag if names[k].startswith(names[best]) or names[best].startswith(names[k])}
    return chosen


def train(features: np.ndarray, positive: np.ndarray, weight: np.ndarray, rounds: int = 400,
          cost: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient descent; both classes weigh the same."""
    x = np.hstack([features, np.ones((len(features), 1))])
    y = np.where(positive, 1.0, -1.0)
    weight = weight * np.where(positive, 0.5 / weight[positive].sum(), 0.5 / weight[~positive].sum())
    penalty = np.append(np.full(features.shape[1], cost), 0.0)
    rate = 1.0 / (2 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + cost)
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * x.T @ (weight * y * slack))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit landmarks, machine and probabilities on a bounded sample of labelled rows that are not held out."""
    sample = materialize(fit_sample(docs, labels, fit_rows), "toxic-sample")
    landmarks = choose_landmarks(sample)
    if not landmarks:
        return Model([], np.zeros(0), -1.0, 1.0, 0.0)
    responses = Responses(landmarks)
    empty = Model(landmarks, np.zeros(len(landmarks)), 0.0, 1.0, 0.0)

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(empty)
        for batch in batch_rows(batches, 128):
            out = []
            wanted = batch["text"].to_pylist()
            some = scorer.learn(wanted)
            for text, toxic in compress(zip(wanted, batch["toxic"].to_pylist(), strict=True), some):
                found = scorer.sentences(text)
                if toxic and len(found):
                    found = found[[found.max(axis=1).argmax()]]
                out.extend((toxic, bytes(np.round(r * 100).astype(np.uint8))) for r in found)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary())],
                                             names=["toxic", "r"])

    seen = sample.mapInArrow(respond, "toxic int, r binary").groupBy("toxic", "r").agg(F.count("*").alias("n")).collect()
    rng = np.random.default_rng(42)
    spoiled = []
    for name in landmarks:
        for at in range(1, len(name)):
            spoiled.append(name[:at] + chr(97 + int(rng.integers(26))) + name[at:])
            spoiled += [name[:at] + name[at + 1:], name[:at - 1] + name[at] + name[at - 1] + name[at + 1:]]
    r = np.vstack([*(np.frombuffer(bytes(x["r"]), np.uint8)[None, :] / 100 for x in seen), responses(spoiled),
                   np.zeros((1, len(landmarks)))])
    toxic = np.array([x["toxic"] == 1 for x in seen] + [True] * len(spoiled) + [False])
    n = np.array([float(x["n"]) for x in seen] + [1.0] * len(spoiled) + [1.0])
    n[-1] = max(1.0, 0.2 * n[~toxic].sum())  # sentences without any response
    gram = responses(landmarks)  # the responses' own kernel, with its floor
    gram = (gram + gram.T) / 2
    values, vectors = np.linalg.eigh(gram)
    nystroem = vectors / np.sqrt(np.maximum(values, 0.05)) @ vectors.T
    w, bias = train(r @ nystroem, toxic, n)
    model = Model(landmarks, nystroem @ w, bias, 1.0, 0.0)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batch_rows(batches, 128):
            found = scorer.margins(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int32()), pa.array(found, pa.float64())],
                                             names=["toxic", "margin"])

    seen = sample.select("text", "toxic").mapInArrow(margins, "toxic int, margin double").collect()
    margin, is_toxic = np.array([r["margin"] for r in seen]), np.array([r["toxic"] == 1 for r in seen])
    total = {r["toxic"]: r["n"] for r in known_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    border, spread = boundary(margin, is_toxic, np.where(is_toxic, total[1] / max(1, is_toxic.sum()), CARE * total[0] / max(1, (~is_toxic).sum())))
    model.slope = math.log(9.0) / spread
    model.shift = -model.slope * border
    return model


def boundary(margins: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The margin that parts the sampled documents with the least error, and half of the distance between the classes'
    medians (at least 0.05).  Each document weighs as many labelled rows as it stands for; of several margins the middle
    of the widest gap is taken."""
    order = np.argsort(margins, kind="stable")
    m, y, weight = margins[order], toxic[order], weight[order]
    wrong = np.where(y, 0.0, weight)
    error = (np.cumsum(np.where(y, weight, 0.0)) + wrong.sum() - np.cumsum(wrong))[:-1]
    gap = np.diff(m)
    error = np.where(gap > 0, error, np.inf)
    if not len(error) or not np.isfinite(error.min()):
        return 0.0, 1.0
    best = np.flatnonzero(error <= error.min() + 1e-9)
    k = best[gap[best].argmax()]
    return float(m[k] + m[k + 1]) / 2, max(0.05, float(np.median(m[y]) - np.median(m[~y])) / 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5) of every row.

    A null text is empty and has the score of a text without any response; repeated rows are scored each on its own;
    an empty table gives no rows; other columns are ignored.
    """
    rows = texts(docs).select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    name = f"toxicity {uuid.uuid4().hex}"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = one_cache(name, lambda: Scorer(model))
        for batch in batch_rows(batches, 128):
            p = [model.probability(m) for m in scorer.margins(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, SCHEMA)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns; null texts count as empty."""
    name = f"toxicity {uuid.uuid4().hex}"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = one_cache(name, lambda: Scorer(model))
        for batch in batch_rows(batches, 128):
            margins = scorer.margins([t or "" for t in batch["text"].to_pylist()])
            yield batch.filter(pa.array([model.probability(m) < threshold for m in margins], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
