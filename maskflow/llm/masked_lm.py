"""Masked pseudo-likelihood: a window network guesses each word from both sides.

Words are counted over all documents, in a table that grows with them. They
fall into classes: the commonest ones by themselves, the others by hash; a
word's log-probability is that of its class, given the neighbours, and that of
the word in its class, by the counts (all words never counted share one). For
each place the network sums one learned vector per neighbour (two
on either side, a table per place), applies tanh and a softmax over classes;
the word itself is masked. The sum of the log-probabilities of a text's words,
each given its neighbours, is the text's pseudo-likelihood.

Training is numpy in the tasks: per round, each partition starts from the
shared weights, takes Adagrad steps on every ``stride``-th place of all its
texts (the next offset in each round, so ``stride`` rounds use each place
once) and gives its weights, which are averaged by places in two levels of
groups. Texts are turned into class numbers once, in a written
table, which training and scoring read. Only the averaged weights, the
commonest words and the sizes of the classes, of fixed size all, reach the
driver. The counted words meet the texts in a join by word; texts go there in
batches, as numbers of the texts that a word stands in. Scores are for a given
partitioning of the input; another one gives slightly other weights.

Defined results: null and empty texts have no words, log-probability 0 and a
null mean; repeated rows have equal scores; an empty table gives no rows and
leaves the weights as they began.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import remove_table, unused, write_table

#: Neighbours by place.
PLACES = (-2, -1, 1, 2)
#: Places whose outputs are held at a time, and places of a training step.
BLOCK, STEP = 256, 2048


@dataclass(frozen=True)
class Shape:
    """``known`` classes for common words, ``hashed`` for the rest; ``wide``: hidden numbers."""

    known: int = 128
    hashed: int = 128
    wide: int = 16
    stride: int = 2
    rounds: int = 2
    rate: float = 0.1

    @property
    def classes(self) -> int:
        return self.known + self.hashed


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Classes:
    """Class numbers of words."""

    def __init__(self, common: list[bytes], shape: Shape):
        self.shape = shape
        self.common = {w: i for i, w in enumerate(common)}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        get, crc, known, hashed = self.common.get, zlib.crc32, self.shape.known, self.shape.hashed
        return np.array([crc(w) % hashed + known if (i := get(w)) is None else i for w in words], dtype=np.int32)


def neighbours(ids: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """Classes of the neighbours of the places ``at``; ``none`` beyond the ends."""
    padded = np.concatenate([[none, none], ids, [none, none]]).astype(np.int32)
    return np.stack([padded[at + 2 + p] for p in PLACES], axis=1)


def trained(n: int, first: int, turn: int, stride: int) -> np.ndarray:
    """The places of a text of ``n`` words that round ``turn`` trains on; ``stride`` rounds in a row have each once."""
    return np.arange((first + turn) % stride, n, stride)


class Network:
    """Tables for the neighbours, weights and biases of the output."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape = shape
        n, d, p = shape.classes, shape.wide, len(PLACES)
        sizes = [p * (n + 1) * d, d * n, n]
        if flat is None:
            rng = np.random.default_rng(3)
            flat = np.concatenate([rng.normal(0, 0.3, sizes[0]), rng.normal(0, 0.1, sizes[1]), np.zeros(n)])
        self.flat = np.array(flat, dtype=np.float32)
        self.tables = self.flat[: sizes[0]].reshape(p, n + 1, d)
        # The bias is one more row of weights, for a hidden number that is always 1.
        self.out = self.flat[sizes[0] :].reshape(d + 1, n)
        self._cells = np.arange((n + 1) * d).reshape(n + 1, d)
        self._ones, self._at = np.ones(n, dtype=np.float32), np.arange(BLOCK)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Hidden numbers, and a last one that is 1."""
        h = np.ones((len(around), self.shape.wide + 1), dtype=np.float32)
        np.tanh(sum(self.tables[k].take(around[:, k], axis=0) for k in range(len(PLACES))), out=h[:, :-1])
        return h

    def far(self) -> bool:
        """Whether exp of an output might overflow. Hidden numbers are within 1, which bounds every output."""
        return bool(np.abs(self.out[:-1]).sum(axis=0).max() + np.abs(self.out[-1]).max() > 60)

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its neighbours."""
        found, far = np.empty(len(target), dtype=np.float64), self.far()
        for first in range(0, len(target), STEP):
            h, own = self.hidden(around[first : first + STEP]), target[first : first + STEP]
            for i in range(0, len(own), BLOCK):
                z, some = h[i : i + BLOCK] @ self.out, own[i : i + BLOCK]
                if far:
                    z -= z.max(axis=1, keepdims=True)
                picked = z[self._at[: len(some)], some]
                np.exp(z, out=z)
                found[first + i : first + i + len(some)] = picked - np.log(z @ self._ones)
        return found

    def step(self, around: np.ndarray, target: np.ndarray, squares: np.ndarray) -> None:
        """One Adagrad step; ``squares`` sums the squared gradients of ``flat``."""
        n, d, far = self.shape.classes, self.shape.wide, self.far()
        grad = np.zeros(len(self.flat), dtype=np.float32)
        tables, out = grad[: self.tables.size].reshape(len(PLACES), -1), grad[self.tables.size :].reshape(d + 1, n)
        h, turned = self.hidden(around), np.ascontiguousarray(self.out[:-1].T)
        back = np.empty((len(target), d), dtype=np.float32)
        for i in range(0, len(target), BLOCK):
            some, own = h[i : i + BLOCK], target[i : i + BLOCK]
            z = some @ self.out
            if far:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            # The rows of z are the errors times their sums; what they meet is divided instead, which is narrower.
            sums = z @ self._ones
            z[self._at[: len(own)], own] -= sums
            share = (1 / (len(target) * sums))[:, None]
            np.multiply(z @ turned, share, out=back[i : i + BLOCK])
            out += (some * share).T @ z
        inner = h[:, :-1]
        back = (back * (1 - inner * inner)).astype(np.float64).ravel()
        for k in range(len(PLACES)):
            tables[k] = np.bincount(self._cells.take(around[:, k], axis=0).ravel(), back, (n + 1) * d)
        squares += grad * grad
        self.flat -= self.shape.rate * grad / (np.sqrt(squares) + 1e-6)


#: Words and texts of a batch of ``met_words``, about and at most; words that are numbered at a time, before their bytes go.
BATCH_WORDS, BATCH_TEXTS, NUMBERED = 2_000_000, 2**16, 2**19
#: Tasks that copies of one text are dealt to when its part joins them.
SALTS = 8


def met_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Written (batch, word, places): per batch of texts, its words and the numbers of the texts they stand in.

    One more row per batch, its word a space and the batch, holds the texts' keys (hashes).
    """

    def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        codes, kinds = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
        return codes.astype(np.int32), kinds

    def whole(parts: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], keys: list[int]) -> pd.DataFrame:
        same, kinds = pd.factorize(np.concatenate([k for _, k in parts]))
        starts = np.cumsum([0, *(len(k) for _, k in parts)])
        codes = np.concatenate([same[start:][c] for start, (c, _) in zip(starts, parts, strict=False)])
        ends = [0, *(2 * np.cumsum(np.bincount(codes))).tolist()]
        # Sorted by word, then by text: BATCH_TEXTS texts take 16 bits.
        codes <<= 16
        codes += np.repeat(np.arange(len(sizes)), sizes)
        codes.sort()
        raw, name = codes.astype("<u2").tobytes(), np.array(keys, dtype="<i8").tobytes()
        mark = hashlib.blake2b(name, digest_size=8).digest()
        places = [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        return pd.DataFrame({"batch": int.from_bytes(mark, "little", signed=True), "word": [*kinds, b" " + mark], "places": [*places, name]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[bytes]] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes: list[int] = []
        keys: list[int] = []
        new = size = 0
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if words := words_of(text):
                    held.append(words)
                    sizes.append(len(words))
                    keys.append(key)
                    new += len(words)
                    size += len(words)
                full = size >= BATCH_WORDS or len(sizes) == BATCH_TEXTS
                if held and (full or new >= NUMBERED):
                    parts.append(numbered(held))
                    held, new = [], 0
                if full:
                    yield whole(parts, sizes, keys)
                    parts, sizes, keys, size = [], [], [], 0
        if held:
            parts.append(numbered(held))
        if parts:
            yield whole(parts, sizes, keys)

    rows = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return write_table(rows.mapInPandas(meet, "batch long, word binary, places binary"), "met")[0]


def count_words(met: DataFrame) -> DataFrame:
    """Written (word, n): how often each word stands in the texts of ``met_words``."""
    words = met.filter(~F.startswith("word", F.lit(b" ")))
    return write_table(words.groupBy("word").agg(F.sum(F.octet_length("places") / 2).cast("long").alias("n")), "words")[0]


def common_words(counts: DataFrame, n: int) -> list[bytes]:
    """The ``n`` commonest words of ``count_words``, ties by the word."""
    return [bytes(r[0]) for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def in_class(met: DataFrame, counts: DataFrame, common: list[bytes], shape: Shape) -> DataFrame:
    """(key, part) of texts with uncommon words, copies repeated: the summed log-probabilities of these in their classes.

    The counts of a class are taken as one more, which words that were never counted share.
    """
    known = F.broadcast(met.sparkSession.createDataFrame([(w,) for w in common], "word binary"))
    own = F.pmod(F.crc32("word"), F.lit(shape.hashed))
    others = counts.join(known, "word", "left_anti")
    sizes = {r[0]: r[1] for r in others.groupBy(own.alias("class")).agg(F.sum("n")).collect()}
    less = F.array(*[F.lit(math.log(sizes.get(i, 0) + 1)) for i in range(shape.hashed)])
    log = F.log(F.coalesce("n", F.lit(1)).cast("double")) - F.get(less, own.cast("int"))
    rows = met.join(known, "word", "left_anti").join(others.hint("shuffle_hash"), "word", "left")
    rows = rows.select("batch", F.startswith("word", F.lit(b" ")).alias("whole"), "places", log.alias("log"))

    def add(group: pd.DataFrame) -> pd.DataFrame:
        whole = group["whole"].to_numpy(dtype=bool)
        keys = np.frombuffer(group["places"][whole].iloc[0], dtype="<i8")
        words = group[~whole].sort_values("log")
        at = np.frombuffer(b"".join(words["places"]), dtype="<u2")
        logs = np.repeat(words["log"].to_numpy(), [len(p) // 2 for p in words["places"]])
        # Batches of equal texts have one number, and so are added up as often.
        return pd.DataFrame({"key": keys, "part": np.bincount(at, logs, len(keys)) / whole.sum()})

    return rows.groupBy("batch").applyInPandas(add, "key long, part double")


def kind_of_ids(shape: Shape) -> str:
    return "<u1" if shape.classes <= 2**8 else "<i4"


def class_table(docs: DataFrame, common: list[bytes], text_col: str = "text", shape: Shape = Shape()) -> tuple[DataFrame, str]:
    """Written (key, ids, first) of each text with words: its hash, the classes of its words, where training begins; and the path."""

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Classes(common, shape)
        for batch in batches:
            ids = [(key, words[0], classes(words)) for key, words in zip(batch["key"], map(words_of, batch["text"]), strict=True) if words]
            yield pd.DataFrame(
                {
                    "key": np.array([k for k, _, _ in ids], dtype=np.int64),
                    "ids": [x.astype(kind_of_ids(shape)).tobytes() for _, _, x in ids],
                    "first": [(zlib.crc32(w) + len(x)) % 2**31 for _, w, x in ids],
                }
            )

    rows = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return write_table(rows.mapInPandas(classed, "key long, ids binary, first int"), "classes")


def train(
    docs: DataFrame, text_col: str = "text", shape: Shape = Shape(), common: list[bytes] | None = None, texts: DataFrame | None = None
) -> tuple[list[bytes], np.ndarray]:
    """(common words, weights) of a network trained on all documents. ``texts``: their ``class_table``, if it is there already."""
    common = common_words(count_words(met_words(docs, text_col)), shape.known) if common is None else common
    flat, path = Network(shape).flat, None
    if texts is None:
        texts, path = class_table(docs, common, text_col, shape)
    for turn in range(shape.rounds):

        def learn(batches: Iterator[pd.DataFrame], start=flat, turn=turn) -> Iterator[pd.DataFrame]:
            net = Network(shape, start)
            squares = np.full(len(start), 1e-4, dtype=np.float32)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            places = size = 0

            def flush() -> None:
                nonlocal size
                around, target = (np.concatenate(x) for x in zip(*held, strict=True))
                for i in range(0, len(target), STEP):
                    net.step(around[i : i + STEP], target[i : i + STEP], squares)
                held.clear()
                size = 0

            for batch in batches:
                for raw, first in zip(batch["ids"], batch["first"], strict=True):
                    ids = np.frombuffer(raw, dtype=kind_of_ids(shape)).astype(np.int32)
                    at = trained(len(ids), first, turn, shape.stride)
                    if len(at):
                        held.append((neighbours(ids, at, shape.classes), ids[at]))
                        size += len(at)
                        places += len(at)
                    if size >= 8192:
                        flush()
            if held:
                flush()
            if places:
                yield pd.DataFrame({"weights": [net.flat.tobytes()], "places": [places], "deal": [zlib.crc32(net.flat.tobytes())]})

        def average(group: pd.DataFrame) -> pd.DataFrame:
            total = int(group["places"].sum())
            mean = np.zeros(len(flat), dtype=np.float64)
            for weights, places in zip(group["weights"], group["places"], strict=True):
                mean += np.frombuffer(weights, dtype=np.float32) * (places / total)
            return pd.DataFrame({"weights": [mean.astype(np.float32).tobytes()], "places": [total], "deal": [0]})

        kind = "weights binary, places long, deal long"
        given, _ = write_table(texts.select("ids", "first").mapInPandas(learn, kind), "weights")
        groups = max(1, int(given.count() ** 0.5))
        some = given.groupBy(F.pmod("deal", F.lit(groups)).alias("g")).applyInPandas(average, kind)
        last = some.groupBy("deal").applyInPandas(average, kind).collect()
        if last:
            flat = np.frombuffer(bytes(last[0]["weights"]), dtype=np.float32).copy()
    if path:
        remove_table(docs.sparkSession, path)
    return common, flat


def class_sums(texts: DataFrame, flat: np.ndarray, shape: Shape = Shape()) -> DataFrame:
    """Written (key, n_words, log_prob) of the rows of ``class_table``: the summed log-probabilities of the classes."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(shape, flat)
        for batch in batches:
            for i in range(0, len(batch), 64):
                some = batch.iloc[i : i + 64]
                ids = [np.frombuffer(raw, dtype=kind_of_ids(shape)).astype(np.int32) for raw in some["ids"]]
                around = [neighbours(x, np.arange(len(x)), shape.classes) for x in ids]
                logs = net.log_probs(np.concatenate(around), np.concatenate(ids))
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                total, ends = np.concatenate([[0.0], np.cumsum(logs)]), np.cumsum(sizes)
                yield pd.DataFrame({"key": some["key"], "n_words": sizes, "log_prob": total[ends] - total[ends - sizes]})

    return write_table(texts.select("key", "ids").mapInPandas(summed, "key long, n_words long, log_prob double"), "sums")[0]


def score(
    docs: DataFrame,
    common: list[bytes],
    flat: np.ndarray,
    text_col: str = "text",
    shape: Shape = Shape(),
    counts: DataFrame | None = None,
    met: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with n_words, log_prob (summed) and mean_log_prob of each text.

    Without ``counts`` (of the texts trained on) the scores are those of the
    classes. ``met``, ``texts``: ``met_words`` and ``class_table`` of ``docs``, if they are there already.
    """
    path = None
    if texts is None:
        texts, path = class_table(docs, common, text_col, shape)
    none = F.lit(None)
    found = class_sums(texts, flat, shape).withColumn("part", none.cast("double"))
    if path:
        remove_table(docs.sparkSession, path)
    if counts is not None:
        met = met_words(docs, text_col) if met is None else met
        parts = in_class(met, counts, common, shape)
        found = found.unionByName(parts.select("key", none.cast("long").alias("n_words"), none.cast("double").alias("log_prob"), "part"))
    # Texts with equal hashes are equal, and so have equal sums.
    found = found.groupBy("key").agg(*[F.max(c).alias(c) for c in ("n_words", "log_prob", "part")])

    key, salt, sums = unused(docs, "_key", "_salt", "_sums")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "log_prob", "mean_log_prob")]
    # Copies of one text are dealt to SALTS tasks.
    found = found.select(F.col("key").alias(key), F.explode(F.array(*map(F.lit, range(SALTS)))).alias(salt), F.struct("n_words", "log_prob", "part").alias(sums))
    out = docs.withColumn(key, F.xxhash64(text_col)).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    out = out.join(found, [key, salt], "left")
    zero = F.lit(0.0)
    log_prob = F.coalesce(F.col(f"{sums}.log_prob"), zero) + F.coalesce(F.col(f"{sums}.part"), zero)
    out = out.select(*own, F.coalesce(F.col(f"{sums}.n_words"), F.lit(0).cast("long")).alias("n_words"), log_prob.alias("log_prob"))
    return out.withColumn("mean_log_prob", F.try_divide("log_prob", F.col("n_words").cast("double")))
