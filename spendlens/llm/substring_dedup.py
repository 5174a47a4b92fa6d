"""Removal of repeated passages: Rabin-Karp hashes of every window of words.

1. In each task the windows of a run of texts are hashed (two polynomials over 64-bit word
   hashes, in numpy). A window that repeats within the run is noted there at once; of each
   distinct one a single entry goes on, so that no window is sent more than once a run,
   however common it is.
2. Entries are dealt by hash into buckets whose number follows the size of the input. In a
   bucket equal hashes from different runs are repeats.
3. Noted windows go back to their runs, there to their documents, and merge into maximal
   intervals of words, which are cut out.

Equal windows are told apart from others by 64 bits and the bucket's number: for ``n`` windows in
``b`` buckets about ``n^2 / (b * 2^65)`` different pairs are mistaken, a few in a corpus of 10^13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import maybe_among, runs_of, written

WINDOW = 35
RUN_CHARS = 4_000_000
#: Bytes of text whose windows share a bucket.
BUCKET_BYTES = 6_000_000
#: Distinct words remembered in a task.
MOST_WORDS = 400_000
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of each ``size`` consecutive values, by doubling."""
    done, done_size = None, 0
    part, part_size = words, 1
    while True:
        if size & part_size:
            if done is None:
                done, done_size = part, part_size
            else:
                n = len(part) - done_size
                done = part[:n] * np.uint64(pow(base, done_size, 1 << 64)) + done[part_size : part_size + n]
                done_size += part_size
        if part_size * 2 > size:
            return done
        n = len(part) - part_size
        if n <= 0:
            return part[:0]
        part = part[:n] * np.uint64(pow(base, part_size, 1 << 64)) + part[part_size:]
        part_size *= 2


def _gaps(values: np.ndarray) -> bytes:
    """Ascending values as bytes: each step as any number of 255 and one smaller byte."""
    steps = np.diff(values, prepend=0)
    long = steps // 255
    out = np.full(int(long.sum()) + len(steps), 255, np.uint8)
    out[np.cumsum(long + 1) - 1] = steps % 255
    return out.tobytes()


def _values(gaps: bytes) -> np.ndarray:
    octets = np.frombuffer(gaps, np.uint8)
    return np.cumsum(octets.astype(np.int64))[octets < 255]


class Windows:
    """Hashes the windows of a run of texts."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and where each text ends; one text's words are objects at a time."""
        out, ends = [], []
        for text in texts:
            if len(self.known) > MOST_WORDS:
                self.known = {}
            known, words = self.known, text.encode("utf-8", "surrogatepass").split()
            for word in set(words).difference(known):
                known[word] = xxhash.xxh64_intdigest(word, 7)
            out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            ends.append(len(words))
        return np.concatenate(out), np.cumsum(ends)

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start (in the run), hash and bucket hash of each window; first word of each text."""
        words, ends = self.words(texts)
        begins = np.r_[0, ends[:-1]]
        inside = np.zeros(len(words) + 1, np.int32)
        long = ends - begins >= self.size
        np.add.at(inside, begins[long], 1)
        np.add.at(inside, ends[long] - self.size + 1, -1)
        start = np.flatnonzero(np.cumsum(inside, dtype=np.int32)[: max(len(words) - self.size + 1, 0)] > 0)
        # One array of the run's words after the other.
        one = rolling(words, self.size, _BASES[0])[start]
        two = _mix(rolling(_mix(words), self.size, _BASES[1])[start])
        return start, _mix(one + two), _mix(two ^ np.uint64(0xA5A5A5A5)), begins


def _repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position whether its hash occurs again, and whether it is the first such."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    again, first = np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
    again[order[1:]] = same
    first[order[1:]] = ~same
    again[order[:-1]] |= same
    return again, first


_KEY = np.dtype([("a", "<i8"), ("b", "<i4"), ("begin", "<u4")])


def repeated_windows(docs: DataFrame, *, buckets: int, size: int = WINDOW) -> DataFrame:
    """``a``, ``b`` (a document's key), ``starts`` (binary): windows that also start elsewhere.

    ``docs`` has ``a``, ``b`` and ``text``. Runs are named by a hash of their documents' keys;
    runs of the same repeated rows share a name, and their windows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(size)
        kinds = {"bucket": pa.int32(), "run": pa.int64(), "hashes": pa.binary(), "gaps": pa.binary(), "keys": pa.binary()}
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            for at, part in runs_of((x.as_py() for x in batch["text"]), RUN_CHARS):
                start, hashes, spread, begins = windows.hashes(part)
                if not len(start):
                    continue
                keys = np.zeros(len(part), _KEY)
                keys["a"], keys["b"], keys["begin"] = a[at : at + len(part)], b[at : at + len(part)], begins
                # A text without words shares its begin with the next one: leave it out.
                keys = keys[np.r_[begins[1:] != begins[:-1], True]].tobytes()
                run = xxhash.xxh64_intdigest(keys) - (1 << 63)
                again, first = _repeats(hashes)
                # The run's documents travel with the repeats that are known already.
                rows = [((run + (1 << 63)) % buckets, run, b"", _gaps(start[again]), keys)]
                start, hashes, bucket = start[first], hashes[first], (spread[first] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
                for number, lo, hi in _spans(bucket[order]):
                    own = order[lo:hi]
                    rows.append((number, run, hashes[own].tobytes(), _gaps(start[own]), b""))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], list(kinds))

    def compared(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        again = _repeats(np.frombuffer(b"".join(group["hashes"]), "<u8"))[0]
        at, out = 0, []
        for run, hashes, gaps, keys in group[["run", "hashes", "gaps", "keys"]].itertuples(index=False):
            n = len(hashes) // 8
            if n:
                gaps = _gaps(_values(gaps)[again[at : at + n]])
                at += n
            if gaps or keys:
                out.append((run, gaps, keys))
        return pd.DataFrame(out, columns=["run", "gaps", "keys"])

    def by_document(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(max(group["keys"], key=len), _KEY)
        start = np.unique(np.concatenate([_values(g) for g in group["gaps"]]))
        begins = keys["begin"].astype(np.int64)
        owner = np.searchsorted(begins, start, side="right") - 1
        out = []
        for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(owner)) + 1):
            if len(part):
                doc = owner[part[0]]
                out.append((int(keys["a"][doc]), int(keys["b"][doc]), (start[part] - begins[doc]).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["a", "b", "starts"])

    entries = docs.select("a", "b", "text").mapInArrow(hashed, "bucket int, run long, hashes binary, gaps binary, keys binary")
    noted = entries.groupBy("bucket").applyInPandas(compared, "run long, gaps binary, keys binary")
    return noted.groupBy("run").applyInPandas(by_document, "a long, b int, starts binary")


def _spans(ranked: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.r_[0, np.flatnonzero(np.diff(ranked)) + 1, len(ranked)]
    return ((int(ranked[i]), i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist()))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Every row as struct ``doc`` with ``n_words``, ``n_removed``, ``spans`` and ``kept``.

    Words are runs of characters other than space and tab to carriage return. A word goes if
    a window of ``size`` words over it also starts anywhere else in the input, in the same row
    too. ``spans`` are the maximal removed [from, to) in words, ``kept`` the other words
    joined by spaces. Null and empty texts have no words and stay empty; texts shorter than
    a window stay whole. Keys may be null or repeat, columns of any name are safe inside
    ``doc``. An empty table gives an empty table.
    """
    keyed = docs.select(
        F.struct("*").alias("doc"),
        F.xxhash64(key, text).alias("a"),
        F.hash(text, key).alias("b"),
    )
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    found = repeated_windows(
        keyed.select("a", "b", F.coalesce(F.col(f"doc.{text}"), F.lit("")).alias("text")),
        buckets=1 + volume // BUCKET_BYTES,
        size=size,
    )
    # Repeated rows note the same windows.
    noted = found.distinct().groupBy("a", "b").agg(F.collect_list("starts").alias("starts"))
    noted, _ = written(noted.withColumnsRenamed({"a": "na", "b": "nb"}), "windows")
    marked = maybe_among(keyed, F.col("a"), noted, F.col("na"), out="marked")
    some = marked.where("marked").join(noted, (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb")), "left")
    rest = marked.where("not marked").withColumn("starts", F.lit(None).cast("array<binary>"))

    @F.pandas_udf("n_words int, spans array<struct<from:int,to:int>>, n_removed int, kept string")
    def cut(bodies: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for body, blobs in zip(bodies, starts):
            words = (body or "").encode("utf-8", "surrogatepass").split()
            if blobs is None or not len(blobs):
                rows.append((len(words), [], 0, b" ".join(words).decode("utf-8", "surrogatepass")))
                continue
            cover = np.zeros(len(words) + 1, np.int64)
            for blob in blobs:
                start = np.frombuffer(blob, "<u4").astype(np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            spans = [{"from": a, "to": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
            rows.append((len(words), spans, int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_words", "spans", "n_removed", "kept"])

    both = some.select("doc", "starts").unionByName(rest.select("doc", "starts"))
    return both.withColumn("cut", cut(F.col(f"doc.{text}"), F.col("starts"))).select("doc", "cut.*")
