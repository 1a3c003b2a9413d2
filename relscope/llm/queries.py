"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, quality_classifier
from .ann import nearest
from .chat_format import format_chats, read_loss, read_turns
from .ngram_join import near_duplicates
from .packing import pack
from .quality_rules import judge
from .sharding import shard
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens


def tokenizer(name: str) -> str:
    """A file of the public tokenizers; RELSCOPE_TOKENIZERS names another folder of them."""
    folder = os.environ.get("RELSCOPE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(docs, "doc_id", [1.0] * 16, grown_weight=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = bpe.load(docs, tokenizer("byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for ids, flat, at in m.encode_parts(batches):
            tokens = [flat[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(t) for t in tokens], pa.int64()),
                    pa.array([sha256(",".join(map(str, t)).encode()).hexdigest() for t in tokens], pa.string()),
                    pa.array([sha256(m.decode(t).encode()).hexdigest() for t in tokens], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], chats.schema)
    out = format_chats(chats.unionByName(extra))
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), "offset", "bucket", "slot")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_bpe": op4_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_chat_format": op6_chat_format,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_ann": op9_ann,
    "op10_packing": op10_packing,
}

ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d),
        g AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS win FROM w WHERE pos + 12 <= len(words)),
        f AS (SELECT win, min(doc_id) AS first_doc FROM g GROUP BY win),
        hit AS (SELECT g.doc_id, g.pos FROM g JOIN f USING (win) WHERE first_doc < g.doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM hit),
        k AS (SELECT w.doc_id, w.pos, w.words[w.pos] AS word, gone.pos IS NULL AS kept FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos),
        t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT kept) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (kept), '') AS txt FROM k GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
        FROM d LEFT JOIN t ON d.doc_id = t.doc_id
    """,
    "op5_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[pos : pos + 3], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS pos FROM d WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.other = link.x)
        SELECT reach.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n ON reach.doc_id = n.doc_id GROUP BY reach.doc_id
    """,
    "op6_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM c),
        e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '~', '~0'), '<|im_', '~1|im_'), '<s>', '~1s>', 'g'), '</s>', '~1/s>', 'g'), '\[(/?INST\])', '~2\1', 'g') AS body,
              regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(role, '~', '~0'), '<|im_', '~1|im_'), chr(10), '~3'), '<s>', '~1s>', 'g'), '</s>', '~1/s>', 'g'), '\[(/?INST\])', '~2\1', 'g') AS head FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(body) + CASE WHEN same THEN 10 ELSE 12 + length(head) + 1 + 11 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
