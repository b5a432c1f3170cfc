"""Documents scored by masked pseudo-likelihood.

A small network, trained in numpy, predicts each token from the WINDOW tokens before and after it, the token itself being
masked.  The sum of the logarithms of these conditional probabilities is a document's score.  Tokens are words in lower case: the most
frequent ones of the corpus have an id each, the others share ids by a hash.  The output is a class of ids, then an id
of the class, so that a prediction costs the square root of the ids; their number grows with the square root of the
corpus's tokens.

A word that shares its id has the id's probability times its own part of the id's occurrences in the corpus.  The counts of
all words are a table: tasks hold those of the HELD most frequent ones, the others are joined.  Texts become ids once, in a table
that both training and scoring read.  For words that
the corpus lacks an id sets aside the part that words seen once have in it, times a code of the word's bytes.

Word counts and training cover all documents.  Every task trains a copy of the network on its own rows and sends it, in pieces, to
tasks that sum them, weighted by tokens; the mean is the next round's start.  The first round sees a share of the rows,
which brings the copies to the same ground, and the last one sees all.  What reaches the driver is the vocabulary, the
HELD words, a row for each shared id and the summed pieces, whose size the network alone decides.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, materialize, partitions, texts

SIDE = 32  # least number of classes, and of ids of a class
OWN = 0.75  # part of the ids that belong to one word
HELD = 50_000
WINDOW = 3
WIDTH, HIDDEN = 12, 32
BATCH = 4_096
RATE = 0.08
ROUNDS = (16, 1)  # of every so many documents, one is learned from
PIECE, SALTS = 1_024, 8
COUNT_WORDS = 4_000_000
BYTES = 1 << 20  # of texts that a task takes at once
IDS = SIDE * SIDE
_EDGE = IDS  # stands before and after a document (in a larger network: its number of ids)
_BYTE = math.log(257)  # a byte, or the end, of a word that the corpus lacks
LONG = 64
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
_OFFSETS = np.array([k for k in range(-WINDOW, WINDOW + 1) if k])


@dataclass
class Network:
    embed: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 11, side: int = SIDE) -> Network:
        rng = np.random.default_rng(seed)
        wide = 2 * WINDOW * WIDTH

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(normal(side * side + 1, WIDTH, scale=0.3), normal(wide, HIDDEN, scale=wide ** -0.5),
                   np.zeros(HIDDEN, np.float32), normal(HIDDEN, side, scale=0.1), np.zeros(side, np.float32),
                   normal(side, HIDDEN, side, scale=0.1), np.zeros((side, side), np.float32))

    @property
    def edge(self) -> int:
        return len(self.embed) - 1

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def unflat(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        side = SIDE
        while _size(side) < len(flat):
            side += 1
        for p in cls.fresh(side=side).parts():
            out.append(flat[at:at + p.size].astype(np.float32).reshape(p.shape))
            at += p.size
        return cls(*out)

    def forward(self, context: np.ndarray, target: np.ndarray, learn: bool = True) -> tuple[np.ndarray, dict]:
        """Log-probability of each target given its context (ids, one row each), and what the gradient needs.

        Tokens go through in the order of their classes, so that a class is one slice; logits have a row for each class, or
        each id of one, and a column for each token."""
        side = len(self.class_bias)
        kind = target // side
        order = np.argsort(kind.astype(np.int16) if side < 1 << 15 else kind, kind="stable")  # of short integers: a radix sort
        context, kind, word = context.take(order, axis=0), kind[order], (target % side)[order]
        x = self.embed.take(context, axis=0).reshape(len(context), -1)
        inner = x @ self.inner
        inner += self.inner_bias
        hidden = np.ones((len(x), HIDDEN + 1), np.float32)  # the last one meets the biases
        np.tanh(inner, out=hidden[:, :-1])
        logits = np.matmul(np.vstack([self.classes, self.class_bias]).T, hidden.T, out=_columns(side, len(kind)))
        log_class, p_class = _softmax(logits, kind, learn)
        cuts = np.searchsorted(kind, np.arange(side + 1)).tolist()
        slices = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        words = np.concatenate([self.words, self.word_bias[:, None]], axis=1)
        logits = _columns(side, len(kind))
        for c, at in slices:
            np.matmul(words[c].T, hidden[at].T, out=logits[:, at])
        log_word, p_word = _softmax(logits, word, learn)
        logs = np.empty(len(kind), np.float32)
        logs[order] = log_class + log_word
        return logs, {"context": context, "x": x, "hidden": hidden, "kind": kind, "word": word, "p": p_class, "p_word": p_word,
                      "slices": slices}

    def gradient(self, context: np.ndarray, seen: dict) -> list[np.ndarray]:
        """Of the mean negative log-probability, for each part."""
        context, hidden, each = seen["context"], seen["hidden"], np.arange(len(seen["kind"]))
        error, inside = seen["p"], seen["p_word"]
        error[seen["kind"], each] -= 1
        inside[seen["word"], each] -= 1
        back = error.T @ self.classes.T
        words = np.zeros((len(self.words), HIDDEN + 1, len(error)), np.float32)
        for c, at in seen["slices"]:
            p = inside[:, at]
            words[c] = (p @ hidden[at]).T
            back[at] += p.T @ self.words[c].T
        back *= 1 - hidden[:, :-1] ** 2
        down = (self.inner @ back.T).reshape(2 * WINDOW, WIDTH, -1)
        ids = context.T.ravel()
        embed = np.stack([np.bincount(ids, down[:, k].ravel(), len(self.embed)) for k in range(WIDTH)], axis=1)
        classes = (error @ hidden).T
        found = [embed, seen["x"].T @ back, back.sum(axis=0), classes[:-1], classes[-1], words[:, :-1], words[:, -1]]
        return [np.divide(g, len(each), dtype=np.float32, casting="same_kind") for g in found]


def _size(side: int) -> int:
    """Numbers in a network."""
    return (side * side + 1) * WIDTH + (2 * WINDOW * WIDTH + 1) * HIDDEN + (HIDDEN + 1) * (side + side * side)


def side_for(tokens: int) -> int:
    """Classes, and ids of a class, for a corpus of so many tokens: the ids grow with the square root of the tokens."""
    return max(SIDE, int(tokens ** 0.25 / 2))


def _columns(rows: int, n: int) -> np.ndarray:
    """Room for n columns; rows that lie a power of two apart would push each other out of a processor's cache."""
    return np.empty((rows, n + 16), np.float32)[:, :n]


def _softmax(logits: np.ndarray, chosen: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each column the logarithm at the chosen row, and the probabilities (if they are to be learned from)."""
    logits -= logits.max(axis=0)
    own = logits[chosen, np.arange(len(chosen))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    if learn:
        logits /= total
    return own - np.log(total), logits


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all texts in a row: those of ``text.lower().split()``."""
    low = pc.utf8_trim_whitespace(pa.array([t.lower() for t in texts.to_pylist()], pa.string()))
    lists = pc.utf8_split_whitespace(low)
    blank = pc.equal(low, "").to_numpy(zero_copy_only=False)
    words = lists.flatten()
    return pc.list_value_length(lists).to_numpy() - blank, words.filter(pc.not_equal(words, "")) if blank.any() else words


def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, of about BYTES of text each, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // BYTES)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def crc32(words: pa.Array) -> np.ndarray:
    """zlib.crc32 of each word: a byte of all words at a time, and words of more than LONG bytes one by one."""
    out = np.zeros(len(words), np.int64)
    if not len(words):
        return out
    lengths = pc.binary_length(words).to_numpy()
    order = np.argsort(-np.minimum(lengths, LONG + 1).astype(np.int16), kind="stable")
    first, short = np.searchsorted(-lengths[order], [-LONG, 0])  # the longer ones, and those with a byte
    for k in order[:first].tolist():
        out[k] = zlib.crc32(words[k].as_buffer())
    order = order[first:short]
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset:][order].astype(np.int64)
    data, lengths = np.frombuffer(words.buffers()[2], np.uint8) if short else None, lengths[order]
    found = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(lengths[0] if len(order) else 0):
        n = np.searchsorted(-lengths, -j)
        found[:n] = _CRC.take((found[:n] ^ data.take(starts[:n] + j)) & 255) ^ (found[:n] >> 8)
    out[order] = found ^ np.uint32(0xFFFFFFFF)
    return out


class Vocabulary:
    """Ids of words: frequent ones their own, others one of the rest (of ``size`` ids) by a hash.  The first entries
    are the frequent words, the others ``held`` ones; ``table`` has their ids."""

    def __init__(self, words: list[str], size: int = IDS, held: Iterable[str] = ()):
        self.size, self.first = size, len(words)
        self.known = pa.array([*words, *held], pa.string())
        self.table = np.concatenate([np.arange(self.first), self.hashed(self.known[self.first:]), [0]])

    def hashed(self, words: pa.Array) -> np.ndarray:
        """Ids of words that share theirs."""
        return self.first + crc32(words) % (self.size - self.first)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Ids and entries (-1: none) of words; places of those that have no entry, and these words."""
        entries = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy()
        ids, at = self.table[entries], np.flatnonzero(entries < 0)
        rest = words.take(pa.array(at))
        ids[at] = self.hashed(rest)
        return ids, entries, at, rest

    def ids(self, text: str) -> np.ndarray:
        return self.of(words_of(pa.array([text], pa.string()))[1])[0]


def _line(ids: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some documents in a row with edges between them, and the places of the ids."""
    edge = np.full(WINDOW, outside, np.int64)
    joined = np.concatenate([p for i in ids for p in (edge, i)] + [edge])
    return joined, np.flatnonzero(joined != outside)


def windows(ids: list[np.ndarray], outside: int = _EDGE) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of all tokens of some documents; no window reaches into a neighbour."""
    joined, at = _line(ids, outside)
    return joined.take(at[:, None] + _OFFSETS), joined[at]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents; each task counts its own before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []

        def rows() -> pa.RecordBatch:
            found = pa.chunked_array(waiting, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

        for batch in by_size(batches):
            waiting.append(words_of(batch["text"])[1])
            if sum(map(len, waiting)) > COUNT_WORDS:
                yield rows()
                waiting.clear()
        yield rows()

    return texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def coded(docs: DataFrame, vocabulary: list[str], size: int, held: dict[str, int], shared: dict[int, tuple[int, int]]) -> DataFrame:
    """A written table, one row for each row: row (a number), doc_id, n_tokens, pick (a hash), ids, known (what the counts of
    words that share an id add to the score, as far as they are held), rare (the other words that share an id, with
    what each adds if the corpus lacks it)."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = Vocabulary(vocabulary, size, held)
        # of an id: the logarithm of its occurrences with those set aside, and that of the latter
        whole, aside = np.zeros(size), np.zeros(size)
        for i, (n, once) in shared.items():
            whole[i], aside[i] = math.log(n + once + 1), math.log(once + 1)
        adds = np.log([1.0] * len(vocabulary) + list(held.values()) + [1.0]) - whole[words.table]
        kind = _id_type(size)
        row = TaskContext.get().partitionId() << 33
        for batch in by_size(batches):
            lengths, own = words_of(batch["text"])
            ids, entries, at, rest = words.of(own)
            known = adds[entries]
            known[at] = -whole[ids[at]]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            spelled = (pc.binary_length(rest).to_numpy() + 1) * _BYTE
            rare = pa.StructArray.from_arrays([rest, pa.array(aside[ids[at]] - spelled)], names=["word", "lacking"])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch["doc_id"], pa.array(lengths, pa.int64()), batch["pick"],
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)),
                                                        pa.py_buffer(ids.astype(kind))]),
                 pa.array(np.diff(np.concatenate([[0.0], np.cumsum(known)])[ends])),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends), pa.int32()), rare)],
                names=["row", "doc_id", "n_tokens", "pick", "ids", "known", "rare"])
            row += n

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("pick"))
    rows = rows.mapInArrow(code, "row long, doc_id long, n_tokens long, pick long, ids binary, known double, "
                                 "rare array<struct<word: string, lacking: double>>")
    return materialize(rows, "lm-ids")  # numbers of rows must not change between readings


def _id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _ids(column: pa.Array, size: int) -> list[np.ndarray]:
    return [np.frombuffer(i, _id_type(size)).astype(np.int64) for i in column.to_pylist()]


def trained(rows: DataFrame, start: np.ndarray, every: int) -> np.ndarray:
    """One round over coded rows: the mean, weighted by tokens, of the networks that the tasks have trained from ``start``."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = Network.unflat(start)
        memory = [np.full(p.shape, 1e-4, np.float32) for p in net.parts()]
        waiting: list[np.ndarray] = []
        held = total = 0

        def step(last: bool = False) -> None:
            nonlocal waiting, held, total
            context, target = windows(waiting, net.edge)
            order = np.random.default_rng(len(target)).permutation(len(target))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                found = context.take(some, axis=0)
                _, seen = net.forward(found, target[some])
                for part, past, g in zip(net.parts(), memory, net.gradient(found, seen), strict=True):
                    past += g * g
                    g /= np.sqrt(past)
                    g *= RATE
                    part -= g
            total += len(target)
            waiting, held = [], 0

        for batch in batch_rows(batches, 256):
            for ids in _ids(batch["ids"], net.edge):
                for at in range(0, len(ids), 8 * BATCH):
                    waiting.append(ids[at:at + 8 * BATCH])
                    held += len(waiting[-1])
                    if held >= 8 * BATCH:
                        step()
        if held:
            step()
        if total:
            flat = net.flat().astype(np.float32)
            starts = range(0, len(flat), PIECE)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays(
                [pa.array([k * SALTS + salt for k in range(len(starts))], pa.int32()),
                 pa.array([total] * len(starts), pa.int64()), pa.array([flat[a:a + PIECE].tobytes() for a in starts], pa.binary())],
                names=["piece", "tokens", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, tokens, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = sums.setdefault(piece, [0, 0.0])
                have[0] += tokens
                have[1] = have[1] + tokens * np.frombuffer(data, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([t for t, _ in sums.values()], pa.int64()),
             pa.array([s.tobytes() for _, s in sums.values()], pa.binary())], names=["piece", "tokens", "data"])

    if every > 1:
        rows = rows.where(F.pmod("pick", F.lit(every)) == 0)
    schema = "piece int, tokens long, data binary"
    pieces = rows.select("ids").mapInArrow(learn, schema)
    found = pieces.repartition(partitions(rows.sparkSession), "piece").mapInArrow(add, schema).collect()
    if not found:
        return start
    out, weight = np.zeros(len(start)), np.zeros(-(-len(start) // PIECE))
    for r in found:
        k = r["piece"] // SALTS
        part = np.frombuffer(bytes(r["data"]), np.float64)
        out[k * PIECE:k * PIECE + len(part)] += part
        weight[k] += r["tokens"]
    return (out / np.repeat(weight, PIECE)[:len(out)]).astype(np.float32)


@dataclass
class Model:
    """counts: word, n of all words that share an id; the counts of the most frequent ones of them are in ``held``.
    shared: of each shared id the occurrences, and those among them of words seen once.  docs, rows: the table that the
    model was fitted to, and its coded rows."""

    vocabulary: list[str]
    flat: np.ndarray
    counts: DataFrame
    held: dict[str, int]
    shared: dict[int, tuple[int, int]]
    docs: DataFrame
    rows: DataFrame


def fit(docs: DataFrame, rounds: tuple[int, ...] = ROUNDS, side: int | None = None, held: int = HELD) -> Model:
    """Vocabulary, counts and network from all documents; with no word in them, the untrained network."""
    counts = materialize(word_counts(docs), "word-counts")
    side = side or side_for(counts.agg(F.sum("n")).first()[0] or 0)
    size = side * side
    vocabulary = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(int(OWN * size)).collect()]
    first = len(vocabulary)
    own = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    tail = materialize(counts.join(own, "word", "left_anti"), "tail-counts")
    bucket = F.crc32(F.col("word").cast("binary")) % F.lit(size - first) + F.lit(first)
    shared = {r["id"]: (r["n"], r["once"]) for r in
              tail.groupBy(bucket.alias("id")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()}
    # steps of counts, from the top down, as long as their words are no more than may be held
    step = F.floor(8 * F.log2("n"))
    least, total = None, 0
    for r in sorted(tail.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > held:
            break
        least = r["step"]
    near = {} if least is None else {r["word"]: r["n"] for r in tail.where(step >= least).collect()}
    rows = coded(docs, vocabulary, size, near, shared)
    flat = Network.fresh(side=side).flat()
    for every in rounds:
        flat = trained(rows, flat, every)
    return Model(vocabulary, flat, tail, near, shared, docs, rows)


def log_probabilities(net: Network, ids: list[np.ndarray]) -> list[float]:
    """The summed log-probability of each of some documents."""
    joined, places = _line(ids, net.edge)
    pieces = [places[a:a + BATCH] for a in range(0, len(places), BATCH)]
    each = np.concatenate([net.forward(joined.take(at[:, None] + _OFFSETS), joined[at], learn=False)[0].astype(np.float64)
                           for at in pieces] or [np.zeros(0)])
    ends = np.cumsum([0] + [len(i) for i in ids])
    sums = np.concatenate([[0.0], np.cumsum(each)])[ends]
    return np.diff(sums).tolist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, score (summed log-probability) and mean (by token) of every row.

    Without a word (null texts too) the score is 0 and the mean null.  Repeated rows are scored each on its own, an empty
    table gives no rows, other columns are ignored.
    """
    flat = model.flat
    rows = model.rows if docs is model.docs else coded(docs, model.vocabulary, Network.unflat(flat).edge, model.held, model.shared)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unflat(flat)
        for batch in batch_rows(batches, 64):
            found = np.array(log_probabilities(net, _ids(batch["ids"], net.edge))) + batch["known"].to_numpy()
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["n_tokens"], pa.array(found, pa.float64())],
                                             names=["row", "doc_id", "n_tokens", "score"])

    asked = rows.select("row", F.inline("rare")).join(model.counts, "word", "left")
    more = asked.groupBy("row").agg(F.sum(F.coalesce(F.log("n"), "lacking")).alias("more"))
    out = rows.select("row", "doc_id", "n_tokens", "ids", "known").mapInArrow(scored, "row long, doc_id long, n_tokens long, score double")
    out = out.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean"))
