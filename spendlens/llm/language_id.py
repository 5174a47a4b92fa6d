"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily
against each: a phrase is the longest match from the current position with any factor of
the labelled text. With ``c`` phrases for ``m`` characters against ``n`` labelled ones, the
cross entropy is estimated as ``c * log2(n) / m`` bits a character (Ziv and Merhav, 1993);
the language with the fewest bits wins, equal ones the first in alphabetical order.

Parsing is done on letters in lower case; every run of other characters is one space. All
letters of the labelled text are kept, of any script: transitions are packed sparsely (row
displacement), so memory follows the labelled text and not its alphabet. A letter a
language does not know is a phrase of its own there. Phrases end at multiples of ``BLOCK``
characters, so that all blocks of a batch advance together in numpy, however long a text
is; whole texts are parsed.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import runs_of

UNDETERMINED = "und"
BLOCK = 2048
SPACE, UNKNOWN = 0, 1
#: Slots looked at together for a state with several transitions.
STRETCH = 256
#: Characters parsed together in a task; about 40 bytes of arrays each.
RUN_CHARS = 1_000_000


@lru_cache(1)
def _lower_letters() -> np.ndarray:
    """By code point: the letter in lower case, 0 for what is not a letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for point in range(sys.maxunicode + 1):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (0 for a run of others) of all texts, and where each text ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _lower_letters()[points]
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(len(letters), bool)
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    first[starts[starts < len(letters)]] = True
    keep = (letters > 0) | first
    keep[1:] |= letters[:-1] > 0
    kept = np.r_[0, np.cumsum(keep)]
    return letters[keep], kept[ends]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and code not in steps[state]:
            steps[state][code] = new
            state = link[state]
        if state >= 0:
            other = steps[state][code]
            if length[other] == length[state] + 1:
                link[new] = other
            else:
                copy = len(steps)
                steps.append(dict(steps[other]))
                link.append(link[other])
                length.append(length[state] + 1)
                while state >= 0 and steps[state].get(code) == other:
                    steps[state][code] = copy
                    state = link[state]
                link[other] = link[new] = copy
        last = new
    return steps


class Packed:
    """Transitions of many states in one array, by row displacement.

    A state is the number of its first slot; its transition by ``code`` stands at slot ``state + code``
    as ``state << 32 | next``, so that a slot of another state (or none, -1) tells that there is
    none. States have different first slots; 0 is a state without transitions.
    """

    def __init__(self) -> None:
        self.used = np.zeros(1 << 16, bool)
        self.bases = np.zeros(1 << 16, bool)
        self.bases[0] = True
        self.low = self.cursor = 1

    def _grow(self, size: int) -> None:
        while size > len(self.used):
            self.used = np.concatenate([self.used, np.zeros(len(self.used), bool)])
            self.bases = np.concatenate([self.bases, np.zeros(len(self.bases), bool)])

    def place(self, steps: list[dict[int, int]]) -> np.ndarray:
        """The numbers of the states of one automaton."""
        at = np.zeros(len(steps), np.int64)
        many = [s for s, to in enumerate(steps) if len(to) > 1]
        for s in sorted(many, key=lambda s: -len(steps[s])):
            codes = np.fromiter(steps[s], np.int64, len(steps[s]))
            at[s] = self._fit(codes)
        single = np.array([s for s, to in enumerate(steps) if len(to) == 1], np.int64)
        code = np.array([next(iter(steps[s])) for s in single.tolist()], np.int64)
        low = self.low
        while len(single):
            free, low = self._free(low, len(single), int(code.max()))
            base = free - code
            first = np.zeros(len(base), bool)
            first[np.unique(base, return_index=True)[1]] = True
            good = first & (base > 0)
            good[good] = ~self.bases[base[good]]
            at[single[good]] = base[good]
            self.bases[base[good]] = self.used[free[good]] = True
            single, code = single[~good], code[~good]
        for s, to in enumerate(steps):
            if not to:
                base = int(np.flatnonzero(~self.bases)[0])
                self.bases[base] = True
                at[s] = base
        while self.low < len(self.used) and self.used[self.low]:
            self.low += 1
        return at

    def _free(self, low: int, many: int, widest: int) -> tuple[np.ndarray, int]:
        """The next ``many`` free slots from ``low`` on."""
        while True:
            self._grow(low + 2 * many + widest + 2)
            free = np.flatnonzero(~self.used[low:])[:many] + low
            if len(free) == many:
                return free, int(free[-1]) + 1
            self._grow(2 * len(self.used))

    def _fit(self, codes: np.ndarray) -> int:
        """A first slot from which all codes meet free slots; stretches without one are not looked at again."""
        least, widest = int(codes.min()), int(codes.max())
        while True:
            start = max(1, self.cursor - least)
            self._grow(start + STRETCH + widest + 1)
            good = ~self.bases[start : start + STRETCH]
            for code in codes.tolist():
                good &= ~self.used[start + code : start + code + STRETCH]
            at = int(good.argmax())
            if good[at]:
                self.bases[start + at] = True
                self.used[start + at + codes] = True
                return start + at
            self.cursor += STRETCH

    def table(self, placed: list[tuple[list[dict[int, int]], np.ndarray]], width: int) -> np.ndarray:
        """The packed transitions; ``width`` codes fit behind any state."""
        out = np.full(int(np.flatnonzero(self.bases)[-1]) + width + 1, -1, np.int64)
        for steps, at in placed:
            for s, to in enumerate(steps):
                for code, after in to.items():
                    out[at[s] + code] = int(at[s]) << 32 | int(at[after])
        return out


@dataclass(frozen=True)
class CrossParser:
    """Automata of all languages in one packed table."""

    langs: list[str]
    letters: np.ndarray  # by code: the letter
    table: np.ndarray  # [state + code] -> state << 32 | next state
    opening: np.ndarray  # [code, language] -> state after a phrase's first letter, 0 for an unknown one
    bits: np.ndarray  # by language: log2 of its labelled length
    uniform: np.ndarray  # by language: bits a character of a code that knows nothing but its script

    def codes(self, letters: np.ndarray) -> np.ndarray:
        lut = np.full(sys.maxunicode + 1, UNKNOWN, np.int32)
        lut[self.letters] = np.arange(len(self.letters)) + 2
        lut[0] = SPACE
        return lut[letters]

    def phrases(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text against each language."""
        langs = len(self.langs)
        starts = np.r_[0, ends[:-1]]
        blocks = -(-(ends - starts) // BLOCK)
        owner = np.repeat(np.arange(len(ends)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lo = starts[owner] + nth * BLOCK
        size = np.minimum(ends[owner] - lo, BLOCK)
        order = np.argsort(-size, kind="stable")
        lo, size, owner = lo[order], size[order], owner[order]
        state = np.zeros((len(lo), langs), np.int64)
        count = np.zeros((len(lo), langs), np.int64)
        alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for step, n in enumerate(alive.tolist()):
            code = codes[lo[:n] + step]
            to = self.table.take(state[:n] + code[:, None])
            ended = to >> 32 != state[:n]
            count[:n] += ended
            to &= 0xFFFFFFFF
            np.copyto(to, self.opening[code], where=ended)
            state[:n] = to
        total = np.zeros((len(ends), langs), np.int64)
        np.add.at(total, owner, count)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits a character, and whether the language fits, of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        letters, ends = letters_of(texts)
        seen = np.r_[0, np.cumsum(letters > 0)][ends]
        lettered = np.diff(seen, prepend=0) > 0
        size = np.maximum(np.diff(ends, prepend=0), 1)
        cost = self.phrases(self.codes(letters), ends) * self.bits / size[:, None]
        best = cost.argmin(1)
        low = cost[np.arange(len(texts)), best]
        closed = low - self.bits[best] / size  # without the last phrase, which the text's end cuts short
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(lettered, 1 / (low[:, None] / cost).sum(1), 0.0)
        named = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
        return named, score, np.where(lettered, closed, 0.0), lettered & (closed < self.uniform[best])


def build(labelled: dict[str, list[str]], chars_per_lang: int) -> CrossParser:
    """A parser from some texts of each language; of these, the first ``chars_per_lang`` letters."""
    langs = sorted(labelled)
    parts: dict[str, list[np.ndarray]] = {}
    for lang in langs:
        letters, ends = letters_of(labelled[lang])
        parts[lang] = [letters[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends) if b > a]
    every = [p for lang in langs for p in parts[lang]]
    known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
    known = known[known > 0].astype(np.int64)
    width = len(known) + 2
    none = np.zeros(0)
    shell = CrossParser(langs, known, none, none, none, none)
    packed, placed, bits, alphabets = Packed(), [], [], []
    for lang in langs:
        joined: list[int] = []
        for part in parts[lang]:
            joined += [UNKNOWN, *shell.codes(part).tolist()]
            if len(joined) >= chars_per_lang:
                break
        joined = joined[:chars_per_lang]
        steps = suffix_automaton(joined)
        for to in steps:
            to.pop(UNKNOWN, None)  # the seam of two texts matches nothing
        placed.append((steps, packed.place(steps)))
        bits.append(np.log2(max(2, len(joined))))
        alphabets.append(set(joined) - {UNKNOWN, SPACE})
    # Languages that share half of their letters or more are of one script; its letters are the alphabet.
    scripts = [set().union(*(b for b in alphabets if 2 * len(a & b) >= min(len(a), len(b)))) for a in alphabets]
    uniform = [np.log2(max(2, len(x))) for x in scripts]
    opening = np.zeros((width, len(langs)), np.int64)
    for nth, (steps, at) in enumerate(placed):
        for code, after in steps[0].items():
            opening[code, nth] = at[after]
    return CrossParser(langs, known, packed.table(placed, width), opening, np.array(bits), np.array(uniform))


def fit(
    labelled: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    chars_per_lang: int = 24_000,
    rows_per_lang: int = 64,
    max_langs: int = 1_000,
) -> CrossParser:
    """Learns from a bounded sample of rows with a language.

    Of each language the ``rows_per_lang`` rows with the smallest hash of ``key`` are taken
    and of these at most ``chars_per_lang`` letters; of more than ``max_langs`` languages those
    with the most rows (equal ones in alphabetical order). The driver gets no more than that.
    Rows with a null or empty text or a null language teach nothing; with none left the
    parser knows no language.
    """
    rows = labelled.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h")
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return build({}, chars_per_lang)
    # Thins out first, so that the sort by hash sees few rows of a large language.
    rates = [(r["lang"], min(1.0, 4 * rows_per_lang / r["count"])) for r in sizes]
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(rates, "lang string, rate double")), "lang")
    share = F.col("h").cast("double") / float(2**64) + 0.5
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = (
        rows.where(share <= F.col("rate"))
        .withColumn("text", F.left("text", F.lit(chars_per_lang)))
        .withColumn("nth", nth)
        .where(F.col("nth") <= rows_per_lang)
        .orderBy("lang", "nth")
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for row in sample:
        texts.setdefault(row["lang"], []).append(row["text"])
    return build(texts, chars_per_lang)


def identify(docs: DataFrame, parser: CrossParser, *, text: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out``: struct of ``lang``, ``score`` (0 to 1), ``bits`` a character and ``fits``.

    ``fits`` is whether the language codes the text better than a uniform code of its script.
    Null texts and texts without a letter are ``und`` with score 0. Ties go to the first
    language in alphabetical order. Other columns pass unchanged; one named ``out`` is
    replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("lang string, score double, bits double, fits boolean")
    def language(batch: pd.Series) -> pd.DataFrame:
        names = ["lang", "score", "bits", "fits"]
        frames = [pd.DataFrame(dict(zip(names, shared.value.predict(part)))) for _, part in runs_of(batch, RUN_CHARS)]
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in names})

    return docs.withColumn(out, language(F.col(text)))


def reject_foreign(docs: DataFrame, parser: CrossParser, *, text: str = "text") -> DataFrame:
    """The rows whose text some language fits, with their columns unchanged.

    Rejected are undetermined texts and texts that the best language codes no better than a
    uniform code of its script would: not prose of any learned language.
    """
    out = "_language"
    while out in docs.columns:
        out += "_"
    return identify(docs, parser, text=text, out=out).where(F.col(f"{out}.fits")).drop(out)
