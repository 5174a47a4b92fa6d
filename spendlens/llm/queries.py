"""Registered queries of the operators on training text, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import (
    ann_forest,
    chat_format,
    compression_bands,
    hard_negatives,
    language_id,
    lexical,
    line_dedup,
    mixing,
    sampled_pieces,
    simhash,
    stream_dedup,
    substring_dedup,
    toxicity,
)
from spendlens.llm.common import fold

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    parser = language_id.fit(docs.where(~held_out))
    scored = language_id.identify(docs.select("doc_id", "text"), parser)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.bits").alias("bits"),
    )


def op2_sampled_pieces(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """Two segmentations of each text; ``lossless`` says that decoding gives the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    samples = sampled_pieces.encode(docs, sampled_pieces.Pieces.load(model), k=2, verify=True)
    return samples.select(
        "doc.doc_id", "sample", "ids", F.size("ids").alias("n_pieces"), "log_prob", "log_inclusion", "gumbel", "lossless"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    net = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and -7, whose texts are control strings; read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    chats = chat_format.format_chats(chat_format.events_of_turns(rows.unionByName(extra)))
    lost = F.array_join(
        F.transform(F.filter("segments", lambda s: s.loss), lambda s: chat_format.unescape(s.text)), ""
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = chats.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns"), lost.alias("lost"), "formatted")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for mark in chat_format.CONTROLS:
        out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return out


OP4_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
a AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS lost,
  sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat_format.TURN + chat_format.TEXT + chat_format.END)}) AS n
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(lost)::BIGINT AS loss_chars,
  sha256(lost) AS loss_sha256, n::BIGINT AS formatted_chars FROM a
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc.doc_id",
        F.col("n_lines").cast("long"),
        F.col("n_removed").cast("long"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM d),
l AS (SELECT doc_id, i, ls, len(list_filter(string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM p),
h AS (
  SELECT doc_id, i, 1 AS size, ls[i] AS win, words FROM l
  UNION ALL SELECT doc_id, i, 2, ls[i] || chr(10) || ls[i + 1], words + lead(words) OVER (PARTITION BY doc_id ORDER BY i)
    FROM l QUALIFY i < len(ls)
  UNION ALL SELECT doc_id, i, 3, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2], 0 FROM l WHERE i < len(ls) - 1),
f AS (SELECT *, row_number() OVER (PARTITION BY size, win ORDER BY doc_id, i) AS nth FROM h),
e AS (SELECT doc_id, ls FROM d WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1),
s AS (SELECT f.doc_id, f.i, f.size FROM f JOIN d USING (doc_id)
  WHERE nth > 1 AND (size = 3 OR words > 50 OR win = text)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM s
  UNION SELECT doc_id, unnest(range(1, len(ls) + 1)) FROM e),
k AS (SELECT p.doc_id, string_agg(p.ls[p.i], chr(10) ORDER BY p.i) AS kept, count(*) AS n
      FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY 1)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc.doc_id",
        F.col("n_words").cast("long"),
        F.col("n_removed").cast("long"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP6_SQL = r"""
WITH w AS (SELECT doc_id, string_split_regex(text, '[\x20\x09-\x0D]+') AS raw FROM documents),
d AS (SELECT doc_id, coalesce(list_filter(raw, lambda x: x <> ''), []) AS ws FROM w),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS win FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, 35)) AS j)),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, ws FROM d),
k AS (SELECT p.doc_id, string_agg(p.ws[p.p], ' ' ORDER BY p.p) AS kept, count(*) AS n
      FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc.doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"), mixing.Target(entropy=0.95, repeats=4.0))
    return rows.select("doc.doc_id", "doc.source", "n_tokens", F.round("weight", 6).alias("weight"), "copies", "places")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    found = ann_forest.search(items, items.where(F.col("vec_id") % 20 == 0), k=20)
    return found.select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
m AS (SELECT doc_id, 25 + ((75 * n * docs) // words) AS m FROM n, s),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM c, s GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
      FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compression_bands.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "quality.*")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )
    return hard_negatives.mine(items, F.col("id") % 50 == 0)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id AS other,
    list_dot_product(a.q, e.q)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id AND len(a.q) = len(e.q)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_sampled_pieces": op2_sampled_pieces,
        "op3_toxicity": op3_toxicity,
        "op4_chat_format": op4_chat_format,
        "op5_line_dedup": op5_line_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_stream_dedup": op7_stream_dedup,
        "op8_mixing": op8_mixing,
        "op9_simhash": op9_simhash,
        "op10_ann_forest": op10_ann_forest,
        "op11_lexical_search": op11_lexical_search,
        "op12_compression_bands": op12_compression_bands,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": OP4_SQL,
        "op5_line_dedup": OP5_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op7_stream_dedup": OP7_SQL,
        "op11_lexical_search": OP11_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
