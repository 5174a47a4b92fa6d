"""Quality rules by compression bands.

A text's zstandard ratio (bytes by compressed bytes) is high where it repeats itself and low
where it is noise. What is usual depends on the length, so limits are bands by length: a whole
text, and each of its fixed chunks, is held against the band of its own size. A text is
rejected when the whole lies outside its band, or chunks outside theirs hold more than
``CHUNK_SHARE`` of its bytes. Plain counts come with it: words, symbols, repeated
lines, and words in windows that the text repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
CHUNK = 4_096
CHUNK_SHARE = 0.25
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
#: Percent of the words that may stand in repeated windows.
MOST_REPEATED = 20


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of up to ``bytes_`` bytes."""

    bytes_: float
    low: float
    high: float


#: Prose of many languages lies well inside: short texts barely compress, long ones by 2 to 3.
BANDS = (
    Band(64, 0.0, 1.6),
    Band(128, 0.7, 2.0),
    Band(256, 0.9, 2.5),
    Band(512, 1.1, 2.8),
    Band(1_024, 1.2, 3.2),
    Band(2_048, 1.3, 3.6),
    Band(4_096, 1.4, 4.0),
    Band(16_384, 1.45, 4.6),
    Band(float("inf"), 1.5, 5.5),
)

RESULT = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    base_failed boolean, ratio double, n_chunks long, odd_chunk_bytes long, verdict string, kept boolean"""


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs."""
    return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words stand in a window of ``size`` words that occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    window = ids
    for at in range(1, size):
        window = _ranks(window[: len(ids) - at], ids[at:])
    twice = np.bincount(window)[window] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _band(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in bands if size <= b.bytes_)


class Screen:
    """Measures texts one by one; holds the compressor of a task."""

    def __init__(self, bands: tuple[Band, ...], chunk: int, share: float, level: int) -> None:
        self.bands, self.chunk, self.share = bands, chunk, share
        self.compressor = zstandard.ZstdCompressor(level=level)

    def ratio(self, text: bytes) -> float:
        return len(text) / len(self.compressor.compress(text))

    def measure(self, text: bytes) -> tuple:
        words = text.split()
        n = len(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        chars = len(b"".join(words).decode("utf-8", "replace"))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        repeated = repeated_words(words)
        failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
        ratio, odd, chunks = 0.0, 0, range(0, len(text), self.chunk)
        verdict = "empty"
        if text:
            ratio = self.ratio(text)
            band = _band(self.bands, len(text))
            for at in chunks:
                part = text[at : at + self.chunk]
                own = _band(self.bands, len(part))
                odd += 0 if own.low <= self.ratio(part) <= own.high else len(part)
            verdict = (
                "repetitive" if ratio > band.high
                else "incompressible" if ratio < band.low
                else "odd_chunks" if odd > self.share * len(text)
                else "usual"
            )
        kept = not failed and verdict == "usual"
        return (n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, ratio, len(chunks), odd, verdict, kept)


def with_quality(
    docs: DataFrame, *, text: str = "text", out: str = "quality", bands: tuple[Band, ...] = BANDS,
    chunk: int = CHUNK, share: float = CHUNK_SHARE, level: int = LEVEL,
) -> DataFrame:
    """Adds ``out``, a struct of counts, the ratio, a verdict and whether the row is ``kept``.

    ``verdict`` is usual, repetitive, incompressible, odd_chunks or empty. A row is kept when
    its verdict is usual and it passes the base rules: at least 10 words, and no more than
    20 % of them in repeated windows. Null and empty texts have no words and the verdict
    empty. Rows are judged alone, so repeated rows get equal results; whatever their
    number, order or partitions. A column named ``out`` is replaced, other columns stay. An
    empty table gives an empty table. Memory follows the longest text.
    """

    @F.pandas_udf(RESULT)
    def quality(batch: pd.Series) -> pd.DataFrame:
        screen = Screen(bands, chunk, share, level)
        rows = [screen.measure(x or b"") for x in batch]
        names = [c.split()[0] for c in RESULT.split(",")]
        return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({c: [] for c in names})

    return docs.withColumn(out, quality(F.col(text).cast("binary")))


def keep_usual(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows that pass, columns unchanged."""
    held = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    return with_quality(held).where("quality.kept").select("doc.*")
