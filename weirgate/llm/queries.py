"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm import chat_format, decontaminate, exact_dedup, html_text, language_id, line_dedup, mixing, resampling, secret_scan, simhash, substring_dedup, token_files, whitening
from weirgate.llm.common import shared_checkpoints


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs, min_docs=10, keep_first=False))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


CONTROL_CASE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)], "conv_id long, turn long, role string, text string")
    examples = chat_format.chat_examples(rows.unionByName(more))
    # The last example of a conversation has all its turns; each example trains one reply.
    loss = chat_format.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_len"))
    by_conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = chat_format.read_turns(F.col("whole"))
    return by_conv.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_dedup(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, folder)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontaminate": op2_decontaminate,
        "op3_line_dedup": op3_line_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_simhash": op5_simhash,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_html_text": op7_html_text,
        "op8_secret_scan": op8_secret_scan,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_mixing": op10_mixing,
        "op11_token_files": op11_token_files,
        "op12_resampling": op12_resampling,
        "op13_whitening": op13_whitening,
    }


SPACES = r"[ \t\n\v\f\r]"

ORACLE = {
    "op3_line_dedup": """
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
        k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
        c as (select k from k where k <> '' group by k having count(distinct doc_id) >= 10)
        select doc_id, count(*) n_lines, count(*) filter (k.k in (from c)) n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (k.k not in (from c)), '')) kept_sha256
        from k group by doc_id
    """,
    "op4_chat_format": r"""
        with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
                   union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        w as (select *, row_number() over o i, count(*) over (partition by conv_id) n,
                     sum(15 + length(replace(replace(replace(r, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) over o upto
              from c window o as (partition by conv_id order by turn, r, t rows unbounded preceding))
        select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by i)) turns_sha256,
               coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
               sha256(coalesce(string_agg(t, '' order by i) filter (r = 'assistant'), '')) loss_sha256,
               sum(upto) filter (r = 'assistant' or i = n)::bigint formatted_chars
        from w group by conv_id
    """,
    "op6_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) text_sha256 from documents)
        select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept, text_sha256
        from d window w as (partition by text_sha256)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
