"""Registered queries of the pipeline operators: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from ebbtide.llm import ann, bpe, chat, dedup, fim, lang, merkle, mix, quality, shards, token_counts, topk, urls

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe_transducer")
def op1(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_language_codes")
def op2(spark, sf_dir):
    return lang.identify(table(spark, sf_dir, "documents"))


@query("op3_quality_neighbours")
def op3(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_minimax_shards")
def op4(spark, sf_dir):
    return shards.assign(table(spark, sf_dir, "documents"))


@query("op5_exact_top_k")
def op5(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op6_url_vocabulary", urls.oracle())
def op6(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op7_source_mix")
def op7(spark, sf_dir):
    return mix.shares(table(spark, sf_dir, "documents"))


@query("op8_kmeans_tree_search")
def op8(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op9_chat_format")
def op9(spark, sf_dir):
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)
    return chat.read_back(chat.format_turns(chat.turns(chat.turn_records(rows))))


@query("op10_minhash_dedup")
def op10(spark, sf_dir):
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op11_fill_in_middle", fim.oracle())
def op11(spark, sf_dir):
    found = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(fim.restored(), 256).alias("restored_sha256"))


@query("op12_merkle_manifest", merkle.oracle())
def op12(spark, sf_dir):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    found = merkle.verified(table(spark, sf_dir, "documents"), changed={"n_chars": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_token_counts")
def op13(spark, sf_dir):
    return token_counts.over_limit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
