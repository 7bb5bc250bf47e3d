"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from steadyseed.llm import (
    chat_format,
    conversation_repair,
    exact_dedup,
    fill_in_middle,
    html_text,
    mixing,
    order_minhash,
    quality,
    sentence_pieces,
    simhash_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from steadyseed.llm.common import SPACE, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
URL_RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
]


def register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


@register("op1_token_counts")
def _(spark, d):
    return token_counts.count_tokens(read(spark, d, "documents"), public_tokenizers.path(WORD_VOCABULARY))


@register("op3_toxicity")
def _(spark, d):
    return toxicity.score_documents(read(spark, d, "documents"), read(spark, d, "labels"))


@register("op4_sentence_pieces")
def _(spark, d):
    path = public_tokenizers.path(PIECE_MODEL)
    coded = sentence_pieces.encode_documents(read(spark, d, "documents"), path)
    return coded.withColumn("decoded_sha256", F.sha2(sentence_pieces.decode(F.col("ids"), path).cast("binary"), 256))


@register("op5_quality")
def _(spark, d):
    return quality.score_documents(read(spark, d, "documents"), read(spark, d, "labels"))


@register("op8_simhash_dedup")
def _(spark, d):
    linked = simhash_dedup.link(read(spark, d, "documents"))
    return linked.select("doc_id", simhash_dedup.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@register("op9_mixing", mixing.oracle_sql())
def _(spark, d):
    return mixing.decide(read(spark, d, "documents")).drop("copies")


@register("op10_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def _(spark, d):
    index = exact_dedup.new_index(spark)
    report = exact_dedup.add_batches(read(spark, d, "documents"), index)
    index.close()
    return report.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op6_html_text")
def _(spark, d):
    return html_text.extract_pages(read(spark, d, "pages"))


@register("op7_order_minhash")
def _(spark, d):
    return order_minhash.compare_documents(read(spark, d, "documents"))


@register("op2_url_filter")
def _(spark, d):
    return url_filter.judge(read(spark, d, "pages"), URL_RULES)


@register("op11_conversation_repair", conversation_repair.oracle_sql())
def _(spark, d):
    return conversation_repair.report(conversation_repair.damaged(read(spark, d, "conversations")), present_col="present")


@register("op12_chat_format", chat_format.oracle_sql())
def _(spark, d):
    records = chat_format.as_records(chat_format.with_hard_conversation(read(spark, d, "conversations")))
    return chat_format.read_back(chat_format.format_records(records))


@register("op13_fill_in_middle", fill_in_middle.oracle_sql())
def _(spark, d):
    cut = fill_in_middle.transform(read(spark, d, "documents"))
    restored = F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored.alias("restored_sha256"))
