"""Ranked search, compression bands and hard negatives against brute force."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlens.llm import compression_bands, hard_negatives, lexical

DOCS = "doc_id long, text string"


def brute_terms(text):
    lowered = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(docs, items, k):
    counts = [(i, Counter(brute_terms(t))) for i, t in docs if brute_terms(t)]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // length
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1_000 * c[t] + 8 * m)) for t in brute_terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [(4096, 500_000, 50_000, 4), (3, 40, 6, 1), (1, 1, 1, 2)])
def test_search_equals_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("PIECE_DOCS", "PIECE_POSTINGS", "BLOCK_TERMS", "FIRST_STRATA"), limits):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    words = ["the", "de", "Été", "été", "x1", "漢字", "naïve", "a", "b_c", "Q-r", "don't", "\x7f", "É"] + [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 3, 7, 40])))) for i in range(60)]
    docs += [(100 + i, "tie tie break") for i in range(15)] + [(7, "tie tie break"), (7, "tie tie break"), (None, "tie tie break")]
    docs += [(200, None), (201, ""), (202, " .,;\n"), (203, "the " * 30_000 + "w3")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(12)]
    items += [(50, "tie"), (50, "tie"), (51, None), (52, "..."), (53, "absent"), (None, "TIE the")]
    frame = spark.createDataFrame([(*d, 1.5, "x") for d in docs], DOCS + ", m double, term string").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, query int")
    index = lexical.build(frame)
    got = lexical.search(index, asked, k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, 10)
    assert lexical.search(index, asked.limit(0)).count() == 0


def test_search_in_no_documents(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(spark.createDataFrame([], DOCS)), items).count() == 0


def test_pruning_leaves_pieces_unscored(spark):
    """With a threshold above its bound, a piece gives nothing; at the bound it is scored."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], DOCS).coalesce(1)
    index = lexical.build(docs)
    rows = index.postings.where("m = 100").toPandas()
    weights = {"b": 5}
    top = 5 * int(lexical.impact(1, 100))
    for least, found in ((top, 1), (top + 1, 0)):
        scorer = lexical._scorer([(0, ["b"], [1])], weights, 10, [least], None, {})
        assert sum(len(scorer((100, p), part)) for p, part in rows.groupby("piece")) == found


def brute_quality(text):
    raw = (text or "").encode()
    words = raw.split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered), failed


def prose(rng, n):
    syllables = ["ka", "lo", "mi", "ter", "son", "an", "der", "ble", "ing", "un", "ße", "ción", "qu", "ar"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(max(8, n // 3))]
    return " ".join(rng.choices(words, k=n))


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a\x0bb c\x0cd\n\n e f g h i j", "é" * 3 + " #*$%&|<> " + "x y " * 12]
    texts += [prose(rng, n) for n in (10, 30, 100, 400, 3000)]
    texts += ["one two three four five six " * 40, "l1 a b c d\n" * 3 + "l2 e f g h i\n  \n  \nl1 a b c d"]
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + (" " if rng.random() < 0.1 else "") for _ in range(3000))
    half = prose(rng, 1200) + " " + noise
    texts += [noise, half, "".join(rng.choices("abc", k=9000)) + prose(rng, 20)]
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], DOCS + ", n_words int").repartition(3)
    rows = {r["doc_id"]: r for r in compression_bands.with_quality(frame).collect()}
    for i, text in enumerate(texts):
        q = rows[i]["quality"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_quality(text), i
        assert q.kept == (not q.base_failed and q.verdict == "usual")
        assert rows[i]["n_words"] == 7
    verdicts = [rows[i]["quality"].verdict for i in range(len(texts))]
    assert verdicts[:3] == ["empty", "empty", "usual"] and verdicts[6:11] == ["usual"] * 5
    assert verdicts[11] == "repetitive" and verdicts[13] == "incompressible" and verdicts[14] in ("odd_chunks", "incompressible")
    kept = compression_bands.keep_usual(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i in rows if rows[i]["quality"].kept}
    assert compression_bands.with_quality(frame.limit(0)).count() == 0


def test_bands_depend_on_length():
    screen = compression_bands.Screen(compression_bands.BANDS, 4096, 0.25, 3)
    short = b"one two three four five " * 3
    assert screen.measure(short)[9] == "usual" and screen.measure(short * 9)[9] == "repetitive"
    sizes = [b.bytes_ for b in compression_bands.BANDS]
    assert sizes == sorted(sizes) and sizes[-1] == math.inf


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = compression_bands.with_quality(docs).where("not quality.base_failed").groupBy("quality.kept").count().collect()
    assert {r["kept"]: r["count"] for r in rows}.get(False, 0) == 0


def brute_negatives(rows, anchor):
    whole = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, a, label) in enumerate(whole):
        if not anchor(i):
            continue
        others = [(-dot(a, v), j, l) for m, (j, v, l) in enumerate(whole) if m != n and len(v) == len(a)]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:5]:
            good = sorted(x for x in others if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(good[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [(4096, 4096, 512, 16), (7, 3, 2, 3), (5, 1, 1, 0)])
def test_negatives_equal_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("PIECE_ROWS", "BLOCK_ANCHORS", "CHUNK", "REFERENCES"), limits):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(9)
    near = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(near)], rng.randrange(3)) for i in range(90)]
    rows += [(100 + i, [1.0, 0.5, 0.0, 0.0], i % 2) for i in range(12)]  # ties
    rows += [(10, [0.7, 0.7, 0.1, 0.0], 1), (11, [0.7, 0.7, 0.1, 0.0], 1), (11, [0.7, 0.7, 0.1, 0.0], 1)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [math.nan, 0.0, 0.0, 0.0], 1), (203, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(204, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (210, [0.0] * 4, 0), (211, [0.0] * 4, 1)]
    rows += [(220 + i, [1.0, rng.random()], i % 2) for i in range(12)] + [(240, [], 0), (241, [], 1), (242, [], 0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, row string").repartition(3)
    got = hard_negatives.mine(frame, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, p, r, n, s, t) for a, p, r, n, s, t in brute_negatives(rows, lambda i: i % 10 == 0))
    assert hard_negatives.mine(frame.limit(0), F.col("id") % 10 == 0).count() == 0


def test_bounds_hold_and_long_vectors_are_left_out(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(size=(300, 6)) * 10.0 ** rng.integers(0, 6, (300, 1)))
    vectors[:20] = vectors[20:40]
    references = hard_negatives.pick_references(vectors, 8)
    angles, norms = hard_negatives.angles_to(vectors, references), np.sqrt((vectors**2).sum(1))
    for i in range(0, 300, 7):
        low, high = hard_negatives.score_bounds(angles[i], norms[i], angles, norms)
        scores = vectors @ vectors[i]
        assert (low <= scores).all() and (scores <= high).all()
    rows = [(0, [1e30, 1.0], 0), (10, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 0.5], 1), (3, [9e5, 1e6], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(frame, F.col("id") % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(10, 1, 1, 2, 131072, 98304)]


def test_building_an_index_holds_few_terms_as_objects():
    rng = random.Random(5)
    words = [f"word{i}".encode() for i in range(20_000)]
    texts = [b" ".join(rng.choices(words, k=250)) for _ in range(3_000)]
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(3_000), pa.int64()), "text": pa.array(texts, pa.binary())})
    tracemalloc.start()
    counted = list(lexical._counts(iter([batch])))
    counting = tracemalloc.get_traced_memory()[1]
    assert [r for b in counted for r in b["key"].to_pylist()] == list(range(3_000))
    placed = [pa.RecordBatch.from_pydict({"m": pa.array([7] * b.num_rows, pa.int64()), **{c: b[c] for c in ("key", "terms", "tfs")}}) for b in counted]
    tracemalloc.reset_peak()
    made = list(lexical._pieces(iter(placed), 5))
    cutting = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 750,000 terms as objects alone take 60 MB.
    assert counting < 50e6 and cutting < 60e6
    assert [b["piece"][0].as_py() for b in made] == [5, 6]
    assert sum(len(x) for b in made for x in b["docs"].to_pylist()) == sum(len(set(t.split())) for t in texts)
