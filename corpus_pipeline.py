"""From raw documents to token ids: each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of docs, whatever else these are besides those of documents, and whatever their names.
Between stages the rows are written as Parquet and read again. An empty table goes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from passaura.llm import decontamination, quality_classifier, sentencepiece_codec, simhash_near_dedup, substring_dedup
from passaura.llm.common import named, prepare, table, written
from passaura.llm.queries import TOKENIZERS


def quality(spark, docs, sf_dir):
    """Documents that are likely of good quality and not toxic; the model is fitted on the labelled ones.

    Null and empty texts are judged by the mark of an empty text; null sources and languages are sites of their own;
    repeated rows stay or go together.
    """
    model = quality_classifier.trained(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model, F.col("source"), F.col("lang"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates: that of the smallest id.

    Null and empty texts are one group; of repeated rows one stays; rows without an id come after those with one.
    """
    return simhash_near_dedup.deduplicated(docs)


def repeated_passages(spark, docs, sf_dir):
    """Texts without passages over 50 words that an earlier document has; documents of nothing else go.

    n_chars follows the text (null for a null text). Null and empty texts stay; rows of equal id count as one document.
    """
    found = substring_dedup.deduplicated(docs.drop("n_chars"), drop_emptied=True).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*(named(c) for c in docs.columns))


def benchmark_free(spark, docs, sf_dir):
    """Documents that benchmark passages do not make up a twentieth of; null and empty texts stay, repeated rows go alike."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark, docs, sf_dir):
    """(doc_id, lang, source, n_chars, n_tokens, ids, lossless): piece ids, and whether they decode to the text; none for null and empty ones."""
    found = sentencepiece_codec.coded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    coded = F.col(found.columns[-1])
    lossless = sentencepiece_codec.is_lossless(F.col("text"), coded["decoded"])
    return found.select("doc_id", "lang", "source", "n_chars", F.size(coded["ids"]).cast("long").alias("n_tokens"), coded["ids"].alias("ids"), lossless.alias("lossless"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_free", benchmark_free), ("token_ids", token_ids)]

#: SQL has no regression, rolling hash or tokenizer: run() is tested against brute force on a small table.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
