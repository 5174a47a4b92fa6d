"""Toxicity by a convolutional text classifier, trained here in numpy.

Words (lower case) are hashed into buckets with learned embeddings, if several texts have them. Filters of several widths
slide over the words, each filter's maximum over the whole text is taken, and two linear
heads read the maxima: one says toxic or not, the other which language the text is in. The
second serves calibration only: part of the labelled texts is held back to choose, for each
language, the threshold with the best F1, and scores are shifted in log odds so that every
language's threshold lies at ``THRESHOLD``. At prediction only the text is read.

All labelled texts teach. They are dealt to shards of a bounded size, one row of a written table each; in
each round every shard is passed over once where it is, from the same network, and the network moves by the mean of what
the shards changed (an embedding by the mean of those that changed it). One shard is plain training.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.common import maybe_among, remove, runs_of
from spendlens.streaming.workdir import work_dir

THRESHOLD = 0.3
WIDTHS = (1, 2, 3)
RUN_CHARS = 1_000_000
PIECE = 1 << 17
SLICE_WORDS = 2_000_000
MOST_WORDS = 400_000
INIT = 0.02
#: Rows and characters of a shard, about.
SHARD_ROWS = 12_000
SHARD_CHARS = 42_000_000
#: Changes are summed over shards as multiples of this, so that the order of the sums does not show.
UNIT = 2.0**-40
#: Tasks that add them up.
SUMS = 2
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and of its training."""

    bucket_bits: int = 16
    dim: int = 8
    filters: int = 12
    epochs: int = 8
    least_texts: int = 3
    batch: int = 32
    rate: float = 0.02
    seed: int = 1


class Words:
    """Bucket of each word, remembered. ``frequent`` are the hashes of words with an embedding;
    other words have the padding bucket, so a rare word never borrows one by collision."""

    def __init__(self, bits: int, frequent: np.ndarray) -> None:
        self.pad, self.known, self.frequent = 1 << bits, {}, frequent

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words, and where each text ends."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        flat, ends = [], []
        for text in texts:
            flat += WORD.findall(text.lower())
            ends.append(len(flat))
        new = [*set(flat).difference(self.known)]
        hashed = np.array([zlib.crc32(word.encode("utf-8", "surrogatepass")) for word in new], np.uint32)
        self.known.update(zip(new, buckets([hashed], self.frequent, self.pad).tolist()))
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), np.array(ends)


def hashes(text: str, known: dict[str, int]) -> np.ndarray:
    """Hash of each word of a text; ``known`` remembers them."""
    words = WORD.findall(text.lower())
    for word in set(words).difference(known):
        known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))


def word_counts(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words, ascending, and in how many of the texts, given as hashes, each is.

    They are counted in slices of the hash range, about ``SLICE_WORDS`` words at a time.
    """
    slices = 1 + sum(map(len, texts)) // SLICE_WORDS
    for low, high in pairwise(((1 << 32) * i // slices for i in range(slices + 1))):
        own = [np.unique(t[(t >= low) & (t <= high - 1)]) for t in texts]
        yield np.unique(np.concatenate(own) if own else np.zeros(0, np.uint32), return_counts=True)


def frequent_words(texts: list[np.ndarray], least: int) -> np.ndarray:
    """Hashes of the words in at least ``least`` of the texts, given as hashes."""
    return np.concatenate([word[n >= least] for word, n in word_counts(texts)])


def buckets(texts: list[np.ndarray], frequent: np.ndarray, pad: int) -> np.ndarray:
    """Buckets of all words of texts given as hashes, one text after the other; ``pad`` for words not ``frequent``."""
    out, end = np.full(sum(map(len, texts)), pad, np.int32), 0
    for text in texts:
        begin, end = end, end + len(text)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, text), len(frequent) - 1)
            out[begin:end] = np.where(frequent[at] == text, text & np.uint32(pad - 1), pad)
    return out


def pieces(starts: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts ``n`` places into runs of ``PIECE``: where a run begins and ends, and its first and last text (exclusive)."""
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        yield a, b, int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))


@dataclass(frozen=True)
class Shard:
    """Texts to learn from: words (hashes or buckets) one text after the other, where each text ends, whether it is
    toxic, and the place of its language among the names (-1 without)."""

    words: np.ndarray
    ends: np.ndarray
    toxic: np.ndarray
    lang: np.ndarray

    SCHEMA = "shard int, words binary, ends binary, toxic binary, lang binary"

    @classmethod
    def of(cls, texts: list[np.ndarray], toxic: list[int], lang: list[int]) -> Shard:
        words = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        return cls(words, np.cumsum([len(t) for t in texts], dtype=np.int64), np.array(toxic, np.float32), np.array(lang, np.int32))

    @property
    def back(self) -> np.ndarray:
        """Which texts are held back for calibration: every fourth, of eight or more."""
        every = np.arange(len(self.ends))
        return every % 4 == 3 if len(every) >= 8 else every < 0

    @property
    def taught(self) -> np.ndarray:
        return np.flatnonzero(~self.back)

    def texts(self, which: np.ndarray) -> list[np.ndarray]:
        begins = np.r_[0, self.ends[:-1]]
        return [self.words[begins[i] : self.ends[i]] for i in which]

    def bucketed(self, frequent: np.ndarray, pad: int) -> Shard:
        return Shard(buckets(self.texts(np.arange(len(self.ends))), frequent, pad), self.ends, self.toxic, self.lang)

    def row(self, number: int) -> pd.DataFrame:
        """One row of ``SCHEMA``; the words are packed, as Spark's executors hold several copies of such a row."""
        parts = {c: [getattr(self, c).tobytes()] for c in ("ends", "toxic", "lang")}
        return pd.DataFrame({"shard": [number], "words": [pa.compress(self.words, "zstd", asbytes=True)], **parts})


def shards_of(batches: Iterator[pd.DataFrame], kind: type) -> Iterator[tuple[int, Shard]]:
    """The shards in rows of ``Shard.SCHEMA``, with their numbers; words are of the type ``kind``."""
    for batch in batches:
        for at in range(len(batch)):
            row = batch.iloc[at]
            ends, toxic, lang = (np.frombuffer(row[c], k) for c, k in (("ends", np.int64), ("toxic", np.float32), ("lang", np.int32)))
            words = pa.decompress(row["words"], int(ends[-1]) * np.dtype(kind).itemsize, "zstd")
            yield int(row["shard"]), Shard(np.frombuffer(words, kind), ends, toxic, lang)


class Network:
    """Embeddings, filters and both heads; the padding bucket is the last one and stays zero."""

    NAMES = ("embed", *(f"filters{k}" for k in range(len(WIDTHS))), "bias", "head", "base")

    def __init__(self, shape: Shape, langs: list[str], frequent: np.ndarray) -> None:
        rng = np.random.default_rng(shape.seed)
        self.shape, self.langs, self.frequent = shape, langs, frequent
        self.pad = 1 << shape.bucket_bits
        pooled = len(WIDTHS) * shape.filters
        self.embed = rng.normal(0, INIT, (self.pad + 1, shape.dim)).astype(np.float32)
        self.embed[self.pad] = 0
        self.filters = [rng.normal(0, (w * shape.dim) ** -0.5, (w * shape.dim, shape.filters)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(pooled, np.float32)
        self.head = rng.normal(0, 0.1, (pooled, 1 + len(langs))).astype(np.float32)
        self.base = np.zeros(1 + len(langs), np.float32)
        self.shift = np.zeros(max(1, len(langs)))
        self._speed: dict[str, np.ndarray] = {}

    def spread(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with padding after each text (so no filter spans two), and where texts start."""
        gap = max(WIDTHS)
        sizes = np.diff(ends, prepend=0)
        starts = np.r_[0, np.cumsum(sizes + gap)[:-1]]
        out = np.full(int((sizes + gap).sum()), self.pad, np.int32)
        own = np.ones(len(out), bool)
        for j in range(gap):
            own[starts + sizes + j] = False
        out[own] = words
        return out, starts

    def one_pass(self, n: int, shard: Shard) -> None:
        """The ``n``-th pass over a shard, of its texts that are not held back."""
        rng = np.random.default_rng(self.shape.seed)
        order = [rng.permutation(shard.taught) for _ in range(n + 1)][-1]
        for part in np.array_split(order, max(1, len(order) // self.shape.batch)):
            if len(part):
                texts = shard.texts(part)
                self._step(np.concatenate(texts), np.cumsum([len(t) for t in texts]), shard.toxic[part], shard.lang[part])

    def moved(self, n: int, shard: Shard) -> np.ndarray:
        """Runs ``one_pass`` and gives what it changed, in ``UNIT``: values and speeds by name, which embeddings, and 1."""
        arrays = [x for name in self.NAMES for x in (self._value(name), self._speed_of(name))]
        before = [x.copy() for x in arrays]
        self.one_pass(n, shard)
        changes = [np.subtract(now, was, dtype=np.float64) for now, was in zip(arrays, before)]
        own = [(changes[0] != 0).any(1), np.ones(1)]
        return np.concatenate([*(np.rint(x.ravel() / UNIT).astype(np.int64) for x in changes), *(x.astype(np.int64) for x in own)])

    def take(self, total: np.ndarray) -> None:
        """Moves by the mean of what shards changed, ``total`` being their sum; an embedding by the mean of those that did."""
        at, shards = 0, total[-1]
        by = np.maximum(total[-2 - self.pad : -1], 1)[:, None]
        for name in self.NAMES:
            for array in (self._value(name), self._speed_of(name)):
                own = total[at : at + array.size].reshape(array.shape) * UNIT
                array += own / (by if name == "embed" else shards)
                at += array.size

    def _value(self, name: str) -> np.ndarray:
        return self.filters[int(name[7:])] if name.startswith("filters") else getattr(self, name)

    def _speed_of(self, name: str) -> np.ndarray:
        if name not in self._speed:
            self._speed[name] = np.full_like(self._value(name), 1e-6)
        return self._speed[name]

    def _step(self, words: np.ndarray, ends: np.ndarray, toxic: np.ndarray, lang: np.ndarray) -> None:
        ids, starts = self.spread(words, ends)
        stops = np.r_[starts[1:], len(ids)]
        n, f = len(starts), self.shape.filters
        best = np.zeros((len(WIDTHS), n, f), np.int64)
        pooled = np.full((n, len(WIDTHS) * f), -np.inf, np.float32)
        for k, width in enumerate(WIDTHS):
            most = pooled[:, k * f : (k + 1) * f]
            for a, b, first, last in pieces(starts, len(ids) - width + 1):
                vectors = self.embed[ids[a : b + width - 1]]
                seen = np.hstack([vectors[j : b - a + j] for j in range(width)]) @ self.filters[k]
                lows, highs = np.maximum(starts[first:last], a), np.minimum(stops[first:last] - width + 1, b)
                held = np.flatnonzero(highs > lows)  # a piece may end with padding that no window of the text starts at
                at = np.array([x + seen[x - a : y - a].argmax(0) for x, y in zip(lows[held], highs[held])], np.int64).reshape(-1, f)
                value, held = seen[at - a, np.arange(f)], held + first
                more = value > most[held]
                best[k, held] = np.where(more, at, best[k, held])
                most[held] = np.where(more, value, most[held])
        active = np.maximum(pooled + self.bias, 0)
        out = active @ self.head + self.base
        grad = np.zeros_like(out)
        grad[:, 0] = (1 / (1 + np.exp(-out[:, 0])) - toxic) / n
        if self.langs:
            odds = np.exp(out[:, 1:] - out[:, 1:].max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(n), np.maximum(lang, 0)] -= 1
            grad[:, 1:] = np.where(lang[:, None] >= 0, odds, 0) / n
        back = (grad @ self.head.T) * (active > 0)
        self._move("head", active.T @ grad)
        self._move("base", grad.sum(0))
        self._move("bias", back.sum(0))
        rows, deltas = [], []
        for k, width in enumerate(WIDTHS):
            own = back[:, k * f : (k + 1) * f]
            change = np.zeros_like(self.filters[k])
            for j in range(width):
                at = ids[best[k] + j]  # text, filter
                part = slice(j * self.shape.dim, (j + 1) * self.shape.dim)
                change[part] = np.einsum("nfd,nf->df", self.embed[at], own)
                rows.append(at.ravel())
                deltas.append((own[:, :, None] * self.filters[k][part].T[None]).reshape(-1, self.shape.dim))
            self._move(f"filters{k}", change)
        self._move_words(np.concatenate(rows), np.concatenate(deltas))

    def _move(self, name: str, grad: np.ndarray) -> None:
        """Adagrad."""
        value, speed = self._value(name), self._speed_of(name)
        speed += grad * grad
        value -= self.shape.rate * 2 * grad / np.sqrt(speed)

    def _move_words(self, rows: np.ndarray, deltas: np.ndarray) -> None:
        touched, back = np.unique(rows, return_inverse=True)
        grad = np.zeros((len(touched), self.shape.dim), np.float32)
        np.add.at(grad, back, deltas)
        grad[touched == self.pad] = 0
        speed = self._speed_of("embed")
        speed[touched] += grad * grad
        self.embed[touched] -= self.shape.rate * 4 * grad / np.sqrt(speed[touched])

    def tables(self) -> np.ndarray:
        """What each bucket adds to each filter at each of its places: one row per bucket."""
        dim = self.shape.dim
        parts = [self.embed @ f[j * dim : (j + 1) * dim] for f, w in zip(self.filters, WIDTHS) for j in range(w)]
        return np.hstack(parts)

    def outputs(self, words: np.ndarray, ends: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Both heads, for each text."""
        ids, starts = self.spread(words, ends)
        f, column, pooled = self.shape.filters, 0, []
        for width in WIDTHS:
            most = np.full((len(starts), f), -np.inf, np.float32)
            for a, b, first, last in pieces(starts, len(ids) - width + 1):
                seen = sum(tables[ids[a + j : b + j], (column + j) * f : (column + j + 1) * f] for j in range(width))
                own = np.maximum.reduceat(seen, np.maximum(starts[first:last] - a, 0))
                most[first:last] = np.maximum(most[first:last], own)
            pooled.append(most)
            column += width
        return np.maximum(np.hstack(pooled) + self.bias, 0) @ self.head + self.base

    def spoken(self, out: np.ndarray) -> np.ndarray:
        """The predicted language of each text."""
        return out[:, 1:].argmax(1) if self.langs else np.zeros(len(out), int)

    def answers(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds, predicted language and label of a shard's texts held back, or of all if none is."""
        kept = np.flatnonzero(shard.back) if shard.back.any() else np.arange(len(shard.ends))
        texts = shard.texts(kept)
        out = self.outputs(np.concatenate(texts), np.cumsum([len(t) for t in texts]), self.tables())
        return out[:, 0], self.spoken(out).astype(np.int32), shard.toxic[kept]

    def calibrate(self, odds: np.ndarray, spoken: np.ndarray, toxic: np.ndarray) -> None:
        """By predicted language: the shift that puts its best threshold at ``THRESHOLD``."""
        goal = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        overall = _best_cut(odds, toxic)
        for i in range(len(self.shift)):
            own = spoken == i
            # A language with labels of one kind only takes the threshold of all.
            mixed = 0 < toxic[own].sum() < own.sum()
            self.shift[i] = goal - (_best_cut(odds[own], toxic[own]) if mixed else overall)

    def scores(self, out: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(out[:, 0].astype(float) + self.shift[self.spoken(out)], -40, 40)))


def _best_cut(odds: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the best F1; midway between the two scores next to it."""
    if not 0 < toxic.sum() < len(toxic):
        return 0.0
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(odds) + 1) + toxic.sum())
    at = int(f1.argmax())
    low = odds[order[at + 1]] if at + 1 < len(odds) else odds[order[at]] - 2
    return float((odds[order[at]] + low) / 2)


def untrained(shape: Shape, langs: list[str], frequent: np.ndarray) -> Network:
    net = Network(shape, langs, frequent)
    net.shift[:] = np.log(THRESHOLD / (1 - THRESHOLD))
    return net


def learn(texts: list[np.ndarray], toxic: list[int], langs: list[str | None], shape: Shape = Shape()) -> Network:
    """Trains on three of four texts, given as ``hashes``, and calibrates on the others: ``fit`` of one shard, here.

    Besides the texts it holds a few bytes a word; filters go over ``PIECE`` words at a time.
    """
    names = sorted({x for x in langs if x})
    places = {x: i for i, x in enumerate(names)}
    shard = Shard.of(texts, toxic, [places.get(x, -1) for x in langs])
    net = untrained(shape, names, frequent_words(shard.texts(shard.taught), shape.least_texts))
    if not texts:
        return net
    shard = shard.bucketed(net.frequent, net.pad)
    for n in range(shape.epochs):
        net.one_pass(n, shard)
    net.calibrate(*net.answers(shard))
    net._speed = {}
    return net


def _sources(
    docs: DataFrame, labels: DataFrame, *, key: str, text: str, lang: str, label: str,
    toxic_rows: int | None = None, clean_rows: int | None = None, row_chars: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that may have a label (``k``, ``lang``, ``text``, its ``digest``), labels (``k``, ``y``), and each different labelled
    row with its ``chars``: all of them unless bounds are given."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    limits = ((0, clean_rows), (1, toxic_rows))
    keys = [known.where(F.col("y") == value) for value, _ in limits]
    keys = [k if most is None else k.orderBy(F.xxhash64("k"), "k").limit(most) for k, (_, most) in zip(keys, limits)]
    known = keys[0].unionByName(keys[1])
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), body.alias("text"), F.xxhash64(body).alias("digest"))
    if docs.schema[key].dataType == labels.schema[key].dataType:
        # Most rows without a label are neither hashed nor dealt.
        bits = min(max(15, int(32 * known.count()).bit_length()), 27)
        rows = maybe_among(rows, F.col("k"), known, F.col("k"), out="maybe", bits=1 << bits).where("maybe").drop("maybe")
    short = rows.select("k", "lang", "digest", F.length("text").alias("chars")).join(known, "k")
    sized = short.groupBy("y", "k", "lang", "digest").agg(F.max("chars").alias("chars"))
    if row_chars is None:
        return rows, known, sized
    # A key may have any number of rows, so rows are bounded once more, by number and by length.
    so_far = F.sum("chars").over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k", "digest", "lang"))
    chosen = []
    for value, most in limits:
        first = sized.where(F.col("y") == value)
        if most is not None:
            fit_in = first.where(F.col("chars") <= most * row_chars // 20)
            first = fit_in.orderBy(F.xxhash64("k"), "k", "digest", "lang").limit(most)
            first = first.withColumn("so_far", so_far).where(F.col("so_far") <= most * row_chars).drop("so_far")
        chosen.append(first)
    return rows, known, chosen[0].unionByName(chosen[1])


def _hashed(rows: DataFrame, known: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """The different labelled rows (only those ``chosen``) with ``words``."""

    @F.pandas_udf("binary")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, int] = {}
        for batch in batches:
            seen = {} if len(seen) > MOST_WORDS else seen
            yield batch.map(lambda x: hashes(x, seen).tobytes())

    found = rows.select("k", "lang", "digest", words("text").alias("words")).join(known, "k")
    if chosen is not None:
        same = [F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("k", "y", "lang", "digest")]
        found = found.alias("r").join(chosen.alias("c"), same, "left_semi")
    # Repeated rows teach once.
    return found.groupBy("k", "y", "lang", "digest").agg(F.first("words").alias("words"))


def sample(docs: DataFrame, labels: DataFrame, *, row_chars: int | None = None, **names_and_bounds) -> DataFrame:
    """What to learn from: ``k``, ``y``, ``lang``, ``digest`` and ``words`` (hashes, 4 bytes each) of all labelled rows, or within bounds."""
    rows, known, sized = _sources(docs, labels, row_chars=row_chars, **names_and_bounds)
    return _hashed(rows, known, None if row_chars is None else sized)


def _stored(rows: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Few large rows written to the shared folder, a file each, and read again; with the folder's path."""
    path = work_dir(rows.sparkSession, purpose)
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def _packed(rows: DataFrame, shards: int, langs: list[str]) -> DataFrame:
    """The rows of ``_hashed`` dealt to shards, one row each."""
    places, most_rows, most_words = {x: i for i, x in enumerate(langs)}, SHARD_ROWS * 5 // 4, SHARD_CHARS // 4

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, texts, toxic, lang, size = TaskContext.get().partitionId(), [], [], [], 0
        for batch in batches:
            for y, spoken, words in zip(batch["y"].tolist(), batch["lang"], batch["words"]):
                texts.append(np.frombuffer(words, np.uint32))
                toxic.append(y)
                lang.append(places.get(spoken, -1))
                size += len(texts[-1])
                if len(texts) >= most_rows or size >= most_words:
                    shard = Shard.of(texts, toxic, lang)
                    texts, toxic, lang, size = [], [], [], 0
                    yield shard.row(number)
        if texts:
            yield Shard.of(texts, toxic, lang).row(number)

    order = [F.crc32(F.col("k").cast("string").cast("binary")), "k", "digest", "y", "lang"]
    return rows.repartition(shards, "k", "digest").sortWithinPartitions(*order).select("y", "lang", "words").mapInPandas(pack, Shard.SCHEMA)


def _frequent(shards: DataFrame, least: int) -> np.ndarray:
    """``frequent_words`` of the texts of all shards that are not held back."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, shard in shards_of(batches, np.uint32):
            for word, n in word_counts(shard.texts(shard.taught)):
                yield pd.DataFrame({"word": word.astype(np.int64), "n": n.astype(np.int64)})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"words": [batch["word"].to_numpy().astype(np.uint32).tobytes()]})

    counts = shards.mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).select("word").mapInPandas(joined, "words binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r["words"], np.uint32) for r in found)]))


def _shared(spark: SparkSession, value, use: Callable):
    """What ``use`` gives for a broadcast of ``value``, which is released then."""
    held = spark.sparkContext.broadcast(value)
    try:
        return use(held)
    finally:
        held.destroy()


def _added(moves: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    total = None
    for moved in moves:
        total = moved if total is None else total + moved
    if total is not None:
        yield pd.DataFrame({"moved": [zlib.compress(total.tobytes(), 1)]})


def _unpacked(moved: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(moved), np.int64)


def _round(shards: DataFrame, net: Network, n: int) -> None:
    """Moves the network by one pass over all shards. The changes are added up by a few tasks before they come here."""
    spark = shards.sparkSession

    def run(held) -> tuple[DataFrame, str]:
        def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from _added(copy.deepcopy(held.value).moved(n, shard) for _, shard in shards_of(batches, np.int32))

        return _stored(shards.mapInPandas(moves, "moved binary"), "toxicity-round")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _added(_unpacked(x) for batch in batches for x in batch["moved"])

    changes, path = _shared(spark, net, run)
    net.take(sum(_unpacked(r["moved"]) for r in changes.coalesce(SUMS).mapInPandas(sums, "moved binary").collect()))
    remove(spark, path)


def _calibrated(shards: DataFrame, net: Network) -> None:
    """Calibrates on the texts of all shards that are held back; 12 bytes of each come here."""

    def run(held) -> list:
        def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for number, shard in shards_of(batches, np.int32):
                yield pd.DataFrame({"shard": [number], **{c: [x.tobytes()] for c, x in zip(("odds", "spoken", "toxic"), held.value.answers(shard))}})

        return shards.mapInPandas(answers, "shard int, odds binary, spoken binary, toxic binary").collect()

    found = sorted(_shared(shards.sparkSession, net, run), key=lambda r: r["shard"])
    kinds = {"odds": np.float32, "spoken": np.int32, "toxic": np.float32}
    net.calibrate(*(np.concatenate([np.frombuffer(r[c], k) for r in found]) for c, k in kinds.items()))


def fit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
    toxic_rows: int | None = None, clean_rows: int | None = None, row_chars: int | None = None, shape: Shape = Shape(),
) -> Network:
    """Learns from all labelled rows, whatever their number and length.

    Words are hashed where the texts are. Shards hold about ``SHARD_ROWS`` rows and ``SHARD_CHARS`` characters, so the memory of a
    task does not grow with the table (a single text is never cut); the driver holds the network, the hashes of
    the frequent words and 12 bytes of each text held back. Languages are thought to be few. The network does
    not depend on how rows are partitioned. A caller may bound the labelled rows: of each label the rows with the smallest
    hash of their key, at most so many, with ``row_chars`` also at most so many characters a row on average and none above a
    twentieth of all these. Null labels teach nothing; null texts are empty, rows without a language only miss in
    calibration by language, repeated rows teach once. Without any labelled row all scores are equal.
    """
    given = {"key": key, "text": text, "lang": lang, "label": label}
    given |= {"toxic_rows": toxic_rows, "clean_rows": clean_rows, "row_chars": row_chars}
    rows, known, sized = _sources(docs, labels, **given)
    n, chars, langs = sized.agg(F.count("*"), F.sum("chars"), F.collect_set("lang")).first()
    if not n:
        return learn([], [], [], shape)
    names = sorted(x for x in langs if x)
    shards = max(-(-n // SHARD_ROWS), -(-chars // SHARD_CHARS))
    taught = _hashed(rows, known, None if row_chars is None else sized)
    hashed, hashed_path = _stored(_packed(taught, shards, names), "toxicity-hashes")
    frequent = _frequent(hashed, shape.least_texts)
    net = untrained(shape, names, frequent[:0])

    def run(held) -> tuple[DataFrame, str]:
        def bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for number, shard in shards_of(batches, np.uint32):
                yield shard.bucketed(held.value, 1 << shape.bucket_bits).row(number)

        return _stored(hashed.mapInPandas(bucketed, Shard.SCHEMA), "toxicity-buckets")

    shards, path = _shared(docs.sparkSession, frequent, run)
    remove(docs.sparkSession, hashed_path)
    for passes in range(shape.epochs):
        _round(shards, net, passes)
    net._speed = {}
    _calibrated(shards, net)
    remove(docs.sparkSession, path)
    net.frequent = frequent
    return net


def score(docs: DataFrame, net: Network, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``, 0 to 1, from the whole text; null and wordless texts get the score of none.

    Other columns pass unchanged; one named ``out`` is replaced. An empty table gives an
    empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own: Network = shared.value
        tables, words = own.tables(), Words(own.shape.bucket_bits, own.frequent)
        for batch in batches:
            parts = [own.scores(own.outputs(*words(part), tables)) for _, part in runs_of(batch, RUN_CHARS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, toxicity(F.col(text)))
