"""Each operator against brute force on small inputs, and on nulls, ties, empty and odd tables."""

from __future__ import annotations

import copy
import hashlib
import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spendlens.llm import (
    ann_forest,
    chat_format,
    language_id,
    line_dedup,
    mixing,
    queries,
    sampled_pieces,
    simhash,
    stream_dedup,
    substring_dedup,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, uid string"


def docs_of(spark, texts, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null key."""
    long = " ".join(f"w{i}" for i in range(3000))
    return docs_of(spark, [None, "", "a b c", "a b c", long, "x", "x"], ids=[0, 1, 2, 3, None, 5, 5])


@pytest.fixture(scope="module")
def pieces():
    return sampled_pieces.Pieces.load(queries.PIECE_MODEL)


def brute_phrases(text: str, known: str) -> int:
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        count, at = count + 1, at + size
    return count


def test_cross_parsing_counts_phrases_and_names_the_language(spark, odd):
    parser = language_id.build({"aa": ["abcabcabd xyz"], "bb": ["zyxzyx zyy"]}, 1000)
    letters, ends = language_id.letters_of(["Abd, XYZ abc", "zyy qq", "42!"])
    got = parser.phrases(parser.codes(letters), ends)
    assert got[0].tolist() == [brute_phrases("abd xyz abc", "abcabcabd xyz"), brute_phrases("abd xyz abc", "zyxzyx zyy")]
    named, score, _, _ = parser.predict(["abcab", "zyxz", "42!", ""])
    assert named == ["aa", "bb", "und", "und"] and score[2] == 0 and 0.5 < score[0] <= 1
    block = "abcabd " * 1000  # several blocks
    assert parser.predict([block])[0] == ["aa"]
    rows = language_id.identify(odd, parser).collect()
    assert [r["language"]["lang"] for r in rows][:2] == ["und", "und"] and len(rows) == 7
    assert language_id.reject_foreign(odd, parser).columns == odd.columns
    assert language_id.identify(odd.limit(0), parser).count() == 0
    assert language_id.fit(odd.where("false")).langs == []


def _script(rng, first, letters, words):
    """Invented prose: words of a language's own syllables."""
    syllables = ["".join(chr(first + rng.randrange(letters)) for _ in range(rng.randint(1, 3))) for _ in range(60 + letters // 8)]
    return lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)) + words


def test_many_scripts_and_languages(spark):
    rng = random.Random(21)
    scripts = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 24), "han": (0x4E00, 1500), "hangul": (0xAC00, 900)}
    say = {f"{name}{i}": _script(rng, first, n, "") for name, (first, n) in scripts.items() for i in range(8)}
    parser = language_id.build({lang: [s(60) for _ in range(30)] for lang, s in say.items()}, 8_000)
    assert len(parser.langs) == 40 and parser.table.nbytes < 64 << 20
    texts = [(lang, s(40)) for lang, s in say.items() for _ in range(5)]
    named, _, _, fits = parser.predict([t for _, t in texts])
    assert sum(a == b for a, (b, _) in zip(named, texts)) > 0.97 * len(texts) and fits.mean() > 0.97
    noise = ["".join(chr(0x1E000 + rng.randrange(200)) for _ in range(80)), "".join(chr(0x10A0 + rng.randrange(40)) for _ in range(200))]
    assert not parser.predict(noise)[3].any()


@pytest.mark.parametrize("seed", range(6))
def test_packed_automata_match_brute_force(seed):
    rng = random.Random(seed)
    alphabet = [chr(0x61 + i) for i in range(3)] if seed % 2 else [chr(0x4E00 + i) for i in range(300)]
    known = {lang: "".join(rng.choices(alphabet, k=rng.randint(1, 400))) for lang in ("a", "b", "c")}
    parser = language_id.build({k: [v] for k, v in known.items()}, 10_000)
    texts = ["".join(rng.choices([*alphabet, "ж"], k=rng.randint(1, 120))) for _ in range(20)]
    letters, ends = language_id.letters_of(texts)
    assert parser.phrases(parser.codes(letters), ends).tolist() == [[brute_phrases(t, known[k]) for k in "abc"] for t in texts]


def test_more_languages_than_wanted(spark):
    rows = [(i, "abc def", lang) for i, lang in enumerate(["x", "x", "y", "z", None])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(frame, max_langs=2).langs == ["x", "y"]


def test_language_on_held_out_rows(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    share = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97


def every_segmentation(pieces, text):
    by = {t: i for i, t in enumerate(pieces.texts) if t is not None}
    out, text = {}, " " + text

    def go(at, ids, log_p):
        if at == len(text):
            out[tuple(ids)] = log_p
            return
        for end in range(at + 1, min(len(text), at + 16) + 1):
            if text[at:end] in by:
                go(end, [*ids, by[text[at:end]]], log_p + pieces.log_p[by[text[at:end]]])
        if text[at] not in by:
            octets = [int(pieces.bytes_[b]) for b in text[at].encode()]
            go(at + 1, ids + octets, log_p + len(octets) * pieces.log_p[pieces.bytes_[0]])

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: math.exp(v - total) for k, v in out.items()}


def test_sampling_without_replacement_has_the_exact_distribution(pieces):
    truth = every_segmentation(pieces, "tion ab")
    top = sorted(truth, key=truth.get)[::-1][:4]
    n = 6000
    found = sampled_pieces.Sampler(pieces).sample(["tion ab"] * n, np.random.default_rng(3).integers(-(2**62), 2**62, n), 3)
    by_rank = {1: Counter(), 2: Counter()}
    seen: dict[int, set] = {}
    for row, rank, ids, log_prob, inclusion, _ in found:
        key = tuple(int(i) for i in ids)
        assert math.isclose(math.exp(log_prob), truth[key], rel_tol=1e-5) and inclusion <= 1e-12
        assert key not in seen.setdefault(row, set())
        seen[row].add(key)
        if rank < 3:
            by_rank[rank][key] += 1
    for key in top:
        second = sum(truth[a] * truth[key] / (1 - truth[a]) for a in truth if a != key)
        for rank, want in ((1, truth[key]), (2, second)):
            assert abs(by_rank[rank][key] / n - want) < 4.5 * math.sqrt(want * (1 - want) / n) + 1e-3


def test_samples_do_not_depend_on_remembered_units(pieces, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.choice([97, 101, 110, 233, 0x4E2D, 0x1F600], rng.integers(0, 9)))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(60)] + ["", " ", "e" * 400]
    seeds = np.arange(len(texts))
    plain = sampled_pieces.Sampler(pieces).sample(texts, seeds, 3)
    one = pieces.sampler
    assert one is pieces.sampler and pickle.loads(pickle.dumps(pieces)).__dict__.keys() == {"texts", "log_p", "bytes_"}
    monkeypatch.setattr(sampled_pieces, "MOST_EDGES", 500)
    some = [(r + i, *rest) for i in range(len(texts)) for r, *rest in one.sample(texts[i : i + 1], seeds[i : i + 1], 3)]
    key = lambda x: x[:2]
    assert len(plain) == len(some)
    for x, y in zip(sorted(plain, key=key), sorted(some, key=key)):
        assert x[:2] == y[:2]
        assert x[2].tolist() == y[2].tolist()
        assert np.allclose(x[3:], y[3:], rtol=1e-9)


def test_encoding_round_trips_and_is_seeded_by_key(spark, odd, pieces):
    hard = docs_of(spark, ["▁ a  b\n\té漢字🦆 ", "\U0010ffff", None, "", "the", "the"], ids=[1, 2, 3, 4, 5, 5])
    rows = sampled_pieces.encode(hard, pieces, k=2, verify=True).collect()
    assert all(r["lossless"] for r in rows)
    again = [r["ids"] for r in rows if r["doc"]["doc_id"] == 5]
    assert again[: len(again) // 2] == again[len(again) // 2 :]
    back = sampled_pieces.encode(odd, pieces, k=2).withColumn("t", sampled_pieces.decoded(F.col("ids"), pieces, spark))
    assert {r["t"] for r in back.collect()} == {t or "" for (t,) in odd.select("text").collect()}
    assert sampled_pieces.encode(odd.limit(0), pieces).count() == 0


def test_toxicity_learns_marked_words(spark, odd):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(600):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        labels.append(i % 3 == 0)
        if labels[-1]:
            body.insert(rng.randrange(len(body)), rng.choice(["badone", "badtwo"]))
        texts.append(" ".join(body))
    known = {}
    net = toxicity.learn([toxicity.hashes(t, known) for t in texts[:450]], [int(x) for x in labels[:450]], ["en"] * 450)
    got = [r["toxicity"] for r in toxicity.score(docs_of(spark, texts[450:]), net).orderBy("doc_id").collect()]
    right = [(s >= toxicity.THRESHOLD) == y for s, y in zip(got, labels[450:])]
    assert sum(right) > 0.95 * len(right)
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(odd, net).collect())
    assert toxicity.score(odd.limit(0), net).count() == 0
    assert toxicity.score(odd, toxicity.learn([], [], [])).count() == 7


def test_toxicity_sample_is_bounded(spark):
    docs = [(1, "Bad bad words", "en"), (1, "Bad bad words", "en"), (2, None, None), (3, "x" * 900, "en"), (None, "a b", "en")]
    docs += [(4, f"many texts {i}", "de") for i in range(50)] + [(10 + i, "fine words " * 3, "de") for i in range(30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("k", F.lit(1)).repartition(7)
    labels = [(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (5, None), (None, 1)] + [(10 + i, 0) for i in range(30)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    names = {"key": "doc_id", "text": "text", "lang": "lang", "label": "toxic"}
    some = lambda **sizes: toxicity.sample(docs, labels, **names, **sizes).collect()
    every = some(toxic_rows=100, clean_rows=100, row_chars=1_000)
    assert len(every) == 2 + 1 + 50 + 30
    words = {r["k"]: np.frombuffer(r["words"], np.uint32).tolist() for r in every}
    assert words[1] == [zlib.crc32(w) for w in (b"bad", b"bad", b"words")] and words[2] == [] and len(words[3]) == 1
    # The text of 900 characters is above a twentieth of 100 x 100; few rows stay of each label.
    assert 3 not in {r["k"] for r in some(toxic_rows=100, clean_rows=100, row_chars=100)}
    few = some(toxic_rows=1, clean_rows=20, row_chars=1_000)
    assert sum(r["y"] == 0 for r in few) <= 20 and sum(r["y"] for r in few) <= 1
    short = some(toxic_rows=100, clean_rows=40, row_chars=10)
    assert 0 < sum(r["y"] == 0 for r in short) < 40
    assert toxicity.fit(docs, labels.limit(0)).langs == []
    assert toxicity.fit(docs.limit(0), labels).langs == []


def test_toxicity_learns_from_all_labelled_rows(spark):
    rows = [(i, f"word{i}", "en") for i in range(9_100)] + [(9_100, "long " * 340_000, "en"), (9_100, "short", "en"), (9_999, "other", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, int(i >= 9_000)) for i in range(9_101)] * 2, "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, shape=toxicity.Shape(epochs=1, least_texts=1))
    # Every fourth row is held back, and each other one brings its own word.
    assert len(net.frequent) == 9_102 - 9_102 // 4
    names = {"key": "doc_id", "text": "text", "lang": "lang", "label": "toxic"}
    taught = toxicity.sample(docs, labels, **names)
    assert taught.count() == 9_102 and taught.agg(F.max(F.length("words"))).first()[0] == 4 * 340_000


def test_toxicity_learns_in_shards(spark, monkeypatch):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        body = [f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 30))]
        labels.append((i, int(i % 3 == 0)))
        if labels[-1][1]:
            body.insert(rng.randint(0, len(body)), rng.choice(["badone", "badtwo"]))
        rows.append((i, " ".join(body), rng.choice(["en", "de", None, ""])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels[:600], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    rounds = []
    monkeypatch.setattr(toxicity, "_round", lambda *given, run=toxicity._round: (rounds.append(given[0].count()), run(*given)))
    net = toxicity.fit(docs.repartition(7), known, shape=toxicity.Shape(epochs=20))
    assert rounds == [3] * 20 and net.langs == ["de", "en"]
    got = [r["toxicity"] for r in toxicity.score(docs.where("doc_id >= 600"), net).orderBy("doc_id").collect()]
    right = [(s >= toxicity.THRESHOLD) == (y == 1) for s, (_, y) in zip(got, labels[600:], strict=True)]
    assert sum(right) > 0.95 * len(right)
    # The network does not depend on how the rows lie, nor on repeated ones.
    some = toxicity.fit(docs.unionByName(docs.limit(50)).repartition(2), known, shape=toxicity.Shape(epochs=2))
    same = toxicity.fit(docs.repartition(9, "text"), known.repartition(3), shape=toxicity.Shape(epochs=2))
    assert np.array_equal(some.embed, same.embed) and np.array_equal(some.head, same.head) and np.array_equal(some.shift, same.shift)
    assert some.frequent.tolist() == same.frequent.tolist() == net.frequent.tolist()


def test_toxicity_shards_of_a_crowded_partition(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 8)
    rows = spark.range(95).selectExpr("1L AS k", "CAST(id % 2 AS INT) AS y", "'en' AS lang", "id AS digest", "X'01000000' AS words")
    shards = [shard for _, shard in toxicity.shards_of(iter([toxicity._packed(rows, 1, ["en"]).toPandas()]), np.uint32)]
    assert [len(s.ends) for s in shards] == [10] * 9 + [5]
    assert sum(s.toxic.sum() for s in shards) == 47 and all(s.words.tolist() == [1] * len(s.ends) for s in shards)


def test_toxicity_moves_by_the_mean_of_shards():
    texts = hashed_texts(range(5, 205), 400)
    net = toxicity.learn(texts, [i % 2 for i in range(200)], ["en"] * 200, toxicity.Shape(epochs=1))
    shard = toxicity.Shard.of(texts, [i % 2 for i in range(200)], [0] * 200).bucketed(net.frequent, net.pad)
    nets = [copy.deepcopy(net) for _ in range(3)]
    nets[0].one_pass(1, shard)
    moved = copy.deepcopy(net).moved(1, shard)
    nets[1].take(moved)
    nets[2].take(moved + moved)
    for name in net.NAMES:
        want = nets[0]._value(name)
        assert not np.array_equal(want, net._value(name))
        assert all(np.allclose(n._value(name), want, rtol=1e-6, atol=1e-9) for n in nets[1:])
    # What only one of two shards moved, it moves whole.
    alone = copy.deepcopy(net)
    still = np.zeros_like(moved)
    still[-1] = 1
    alone.take(moved + still)
    assert np.allclose(alone.embed, nets[0].embed, rtol=1e-6, atol=1e-9)
    assert np.allclose(alone.head, (nets[0].head + net.head) / 2, rtol=1e-5, atol=1e-7)


def hashed_texts(sizes, vocabulary, seed=3):
    rng = np.random.default_rng(seed)
    known = rng.integers(0, 1 << 32, vocabulary, dtype=np.uint32)
    return [known[rng.integers(0, vocabulary, n)] for n in sizes]


def test_toxicity_learns_in_little_memory():
    texts = hashed_texts([2_000] * 800, 50_000)
    tracemalloc.start()
    toxicity.learn(texts, [i % 3 == 0 for i in range(800)], ["en", "de"] * 400, toxicity.Shape(epochs=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(t.nbytes for t in texts)


def test_toxicity_learns_alike_in_pieces(monkeypatch):
    texts = hashed_texts([0, 1, 2, 500, 3, 0, 64, 61, 62, 63, *range(40)], 60)
    given = texts, [i % 2 for i in range(50)], ["en", None, "de", "en", ""] * 10
    whole = toxicity.learn(*given)
    words = toxicity.buckets(texts, whole.frequent, whole.pad)
    ends, tables = np.cumsum([len(t) for t in texts]), whole.tables()
    out = whole.outputs(words, ends, tables)
    counted = Counter(w for i, t in enumerate(texts) if i % 4 != 3 for w in set(t.tolist()))
    monkeypatch.setattr(toxicity, "PIECE", 7)
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 50)
    assert np.array_equal(whole.outputs(words, ends, tables), out)
    cut = toxicity.learn(*given)
    assert cut.frequent.tolist() == whole.frequent.tolist() == sorted(w for w, n in counted.items() if n >= 3)
    assert np.allclose(cut.outputs(words, ends, cut.tables()), out, atol=1e-3)


def test_events_fold_and_read_back(spark):
    log = [
        (1, 0, "message", "a", "user", "hi <|end|> \\ [INST]"), (1, 1, "start", "b", "assistant", None),
        (1, 2, "delta", "b", None, "wrong"), (1, 4, "regenerate", "b", None, None), (1, 5, "delta", "b", None, "ri"),
        (1, 6, "delta", "b", None, "ght"), (1, 7, "message", "c", "us\ner", None), (1, 8, "edit", "a", None, "edited"),
        (1, 9, "start", "d", "assistant", ""), (1, 10, "delta", "d", "", "x"), (1, 11, "delete", "d", "", ""),
        (None, 0, "message", "a", None, ""), (None, 0, "message", "a", None, ""), (None, 1, "odd", "z", "", "?"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg string, role string, text string")
    chats = {r["conv_id"]: r for r in chat_format.format_chats(events).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    said = [(t["role"], t["text"]) for t in chats[1]["turns"]]
    assert ("assistant", "right") in said and ("us\ner", "") in said and ("user", "hi <|end|> \\ [INST]") in said
    assert not any(text == "x" for _, text in said)
    assert "".join(s["text"] for s in chats[1]["segments"]) == chats[1]["formatted"]
    assert [s["text"] for s in chats[1]["segments"] if s["loss"]] == ["right"]
    assert len(chats[None]["turns"]) == 2
    assert chat_format.format_chats(events.limit(0)).count() == 0


def brute_lines(texts, least, most_words, order=None):
    """By hand: every window of lines with an earlier copy that is long, wordy or a whole document goes."""
    seen, gone = {}, [set() for _ in texts]
    for d in order or range(len(texts)):
        lines = [] if texts[d] is None else texts[d].split("\n")
        for i in range(len(lines)):
            for n in range(1, len(lines) - i + 1):
                window = tuple(lines[i : i + n])
                words = sum(len(x.encode().split()) for x in window)
                if seen.setdefault(window, (d, i)) != (d, i) and (n >= least or words > most_words or n == len(lines)):
                    gone[d] |= set(range(i, i + n))
    return [
        None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)
    ]


@pytest.mark.parametrize("least, most_words", [(1, 50), (2, 3), (3, 4), (5, 7), (3, 50)])
def test_repeated_lines(spark, least, most_words):
    rng = random.Random(least * 100 + most_words)
    lines = ["a", "b", "c", "d", "", "e f g h i", "one two  three"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(40)] + [None, "", "a\na\na\na\na\na\na"]
    texts += ["only", "only", "two\nlines", "two\nlines", "x1\n" + "w " * 51 + "\nx2", "x3\n" + "w " * 51, "x4\ntwo\nlines", ""]
    long = "\n".join(f"line {i}" for i in range(70))
    texts += [long, "before\n" + long, long + "\nafter"]
    got = line_dedup.remove_repeats(docs_of(spark, texts), min_lines=least, min_words=most_words).orderBy("doc.doc_id").collect()
    want = brute_lines(texts, least, most_words)
    assert [r["kept"] for r, w in zip(got, want) if w is None or w] == [w for w in want if w is None or w]
    assert all(r["n_removed"] == sum(x["to"] - x["from"] for x in r["runs"]) for r in got)
    assert all(a["to"] < b["from"] for r in got for a, b in zip(r["runs"], r["runs"][1:]))
    assert line_dedup.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_repeated_lines_of_null_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "SLICE", 1)
    texts = ["a\nb\nc"] * 3 + ["a\nb\nd\na\nb\nc\na"] * 2 + ["a\na\na\nb"] * 2
    frame = spark.createDataFrame(list(zip([7, None, None, 7, 3, 3, None], texts)), "doc_id long, text string").coalesce(1)
    got = line_dedup.remove_repeats(frame).collect()
    order = sorted(range(7), key=lambda d: ([7, None, None, 7, 3, 3, None][d] or 0, d))
    assert sorted(r["kept"] for r in got) == sorted(brute_lines(texts, 3, 50, order))


def brute_windows(texts, size):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_repeated_windows(spark, odd, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab\x1cc") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "x y  z\x0bq"]
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 200)
    rows = substring_dedup.remove_repeats(docs_of(spark, texts), size=7).orderBy("doc.doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in rows] == brute_windows(texts, 7)
    repeated = substring_dedup.remove_repeats(docs_of(spark, ["a b c", "a b c", "a b"], ids=[7, 7, None]), size=3)
    assert sorted(r["n_removed"] for r in repeated.collect()) == [0, 3, 3]
    assert substring_dedup.remove_repeats(odd).count() == 7
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_gaps_of_any_size():
    values = np.array([0, 0, 254, 509, 510, 70_000])
    assert substring_dedup._values(substring_dedup._gaps(values)).tolist() == values.tolist()


def test_stateful_dedup(spark, odd):
    rows = stream_dedup.deduplicate(odd).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc"]["text"] or "", []).append(r)
    for text, group in by_text.items():
        ids = [r["doc"]["doc_id"] for r in group if r["doc"]["doc_id"] is not None]
        assert {r["keep_id"] for r in group} == {max(ids) if ids else None}
        assert sum(r["kept"] for r in group) == 1 and {r["group_size"] for r in group} == {len(group)}
        assert group[0]["digest"] == hashlib.sha256(text.encode()).hexdigest()
    several = stream_dedup.distinct_docs(docs_of(spark, ["a", "b", "a"]))
    assert several.columns == odd.columns and {r["doc_id"] for r in several.collect()} == {1, 2}
    assert stream_dedup.deduplicate(odd.limit(0)).count() == 0


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(stream_dedup.F, "sha2", lambda c, n: F.lit("same"))
    rows = stream_dedup.deduplicate(docs_of(spark, ["a", "b", "a", "c"])).orderBy("doc.doc_id").collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in rows] == [(2, 2, False), (1, 1, True), (2, 2, True), (3, 1, True)]


def test_mixture_meets_entropy_and_budget(spark, odd):
    rng = random.Random(6)
    sources = [rng.choice("aaaaaaabbc") for _ in range(800)] + [None] * 5
    texts = [" ".join(["w"] * rng.randint(1, 9)) for _ in sources]
    docs = docs_of(spark, texts, sources)
    target = mixing.Target(entropy=0.9, repeats=50.0)
    rows = mixing.plan(docs, target).collect()
    tokens, emitted, weight = Counter(), Counter(), {}
    for r in rows:
        s = r["doc"]["source"]
        assert r["n_tokens"] == len(r["doc"]["text"].split())
        tokens[s] += r["n_tokens"]
        emitted[s] += r["n_tokens"] * r["copies"]
        weight[s] = r["weight"]
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert abs(entropy - 0.9 * math.log(4)) < 1e-6 and abs(sum(weight.values()) - 1) < 1e-9
    for s in tokens:
        assert weight[s] * sum(tokens.values()) - 9 <= emitted[s] <= weight[s] * sum(tokens.values()) + 1e-3
    capped = mixing.plan(docs, mixing.Target(entropy=1.0, repeats=2.0)).groupBy("doc.source").agg(F.max("weight"), F.sum("n_tokens")).collect()
    most = max(w * sum(tokens.values()) / t for _, w, t in capped)
    assert abs(most - 2.0) < 1e-6
    mixed = mixing.mix(docs, target)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.plan(odd, target).count() == 7 and mixing.plan(odd.limit(0), target).count() == 0


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("split", [20_000, 3])
def test_simhash_components(spark, monkeypatch, split):
    rng = random.Random(9)
    monkeypatch.setattr(simhash, "SPLIT_LEAVES", split)
    seeds = [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    prints = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & ((1 << 64) - 1) for s in seeds for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(signed[i]), find(signed[j])
                root[max(x, y)] = min(x, y)
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_simhash_documents(spark, odd):
    assert [simhash.fingerprint(t) for t in ("A b  c D", "a b", "", "ÀÉ x")] == [brute_fingerprint(t) for t in ("A b  c D", "a b", "", "ÀÉ x")]
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 7 and {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns


def test_forest_recall_and_odd_vectors(spark):
    data = "/root/testdata/sf0.1"
    got = queries.op10_ann_forest(spark, data).collect()
    table = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, near in found.items():
        score = vectors @ vectors[ids == q][0]
        best = sorted((-s, int(i)) for s, i in zip(score, ids) if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in near})
        assert sorted(near) == sorted(near, key=lambda x: (-x[2], x[1])) and len(near) == 20
        assert all(abs(s - float(score[ids == i][0])) < 1e-12 for _, i, s in near)
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(found)
    rows = [(0, [1.0, 0.0]), (20, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = ann_forest.search(odd, odd.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in near] == [(0, 1, 20, 2.0), (0, 2, 3, 1.0), (20, 1, 0, 2.0), (20, 2, 3, 2.0)]
    assert ann_forest.search(odd.limit(0), odd.limit(0)).count() == 0


def test_forest_ties_over_shards(spark, monkeypatch):
    """Equal vectors, repeated rows too, stand in many shards; the smallest ids win."""
    monkeypatch.setattr(ann_forest, "SHARD_ROWS", 40)
    monkeypatch.setattr(ann_forest, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    same = rng.normal(size=24).tolist()
    rows = [(int(i), same) for i in rng.permutation(300)] + [(7, same), (7, same)]
    rows += [(1_000 + i, (0.5 * np.array(same)).tolist()) for i in range(5)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = ann_forest.search(items, items.where("vec_id = 9"), k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == sorted([x for x in range(300) if x != 9] + [7, 7])[:20]
    assert len({r["score"] for r in got}) == 1
    vectors = rng.normal(size=(500, 33))
    vectors[100:200] = vectors[0]
    for point in vectors[[0, 5, 150]]:
        chosen, score = ann_forest.nearest_of(np.arange(500), vectors, point, 20)
        brute = sorted(((-float(np.einsum("d,d->", v, point)), i) for i, v in enumerate(vectors)))[:20]
        assert [int(i) for i in chosen] == [i for _, i in brute]


def test_pipeline_keeps_each_promise(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, "").collect(), docs.schema)
        assert kept.columns == docs.columns
        if name == "exact_dedup":
            assert kept.count() == kept.select("text").distinct().count() == docs.select("text").distinct().count()
        if name == "simhash_dedup":
            prints = [brute_fingerprint(r["text"]) for r in kept.collect()]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    pieces = sampled_pieces.Pieces.load(corpus_pipeline.PIECE_MODEL)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {r["doc_id"] for r in rows} == set(texts) and all(pieces.decode(r["ids"]) == texts[r["doc_id"]] for r in rows)


def test_a_run_of_windows_holds_one_text_as_words():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(5_000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(1_600)]
    windows = substring_dedup.Windows(substring_dedup.WINDOW)
    tracemalloc.start()
    hashes, ends = windows.words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ends.tolist() == list(range(300, 480_300, 300))
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w, 7) for t in texts for w in t.split()]
    assert peak < 30 * 480_000


def test_parsing_holds_few_letters_at_a_time():
    texts = [("a text of some letters " * 90)[:2_000]] * 2_000
    parser = language_id.build({"en": texts[:3], "de": ["ein Satz mit anderen Buchstaben"]}, 2_000)
    parser.predict(texts[:1])
    tracemalloc.start()
    parts = [parser.predict(part) for _, part in language_id.runs_of(texts, language_id.RUN_CHARS)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for part in parts for x in part[0]] == ["en"] * 2_000
    assert peak < 80e6
