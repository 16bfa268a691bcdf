"""Corpus preparation in five stages. Each stage reads, as Parquet, what the stage before it wrote.

quality   texts that the nearest labelled neighbours score below 0.3 go
language  texts without letters and texts whose language is in doubt go
dedup     one document of each group of near copies (five-word shingles, similarity 0.8) stays
mix       sources are brought to their weights: a document comes back once for each time that the
          mix takes a part of it, with those parts as its text
bpe       the ids of each text: doc_id, source, n_tokens, ids

SQL can express neither the classifiers nor the encoding, so the stages are tested against
brute-force versions instead.
"""

import public_tokenizers
from pyspark.sql import functions as F

from ebbtide.llm import bpe, dedup, lang, mix, quality
from ebbtide.session import new_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def good_quality(spark, docs, sf_dir):
    """Documents of predicted quality 1. Rows are judged one by one, repeated ones alike; null and
    empty texts get the score of the labelled sample as a whole."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filtered(docs, labels)


def known_language(spark, docs, sf_dir):
    """Documents whose language is recognised beyond doubt. Null texts and texts without letters
    have none and go."""
    return lang.filtered(docs)


def one_of_each(spark, docs, sf_dir):
    """The document of smallest doc_id of each near-duplicate component, once. Rows without doc_id
    and texts without words have no copies and stay."""
    return dedup.filtered(docs, size=5, percent=80)


def mixed_sources(spark, docs, sf_dir):
    """The documents as the mix takes them; texts without words go."""
    return mix.mixed(docs)


def encoded(spark, docs, sf_dir):
    """Token ids of every row; a null or empty text has none."""
    return (bpe.encode(docs, VOCABULARY, keep=("source",))
            .select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [("quality", good_quality), ("language", known_language), ("dedup", one_of_each),
          ("mix", mixed_sources), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
