"""From raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's `docs`. All but the last return the columns of documents: null
texts, repeated rows, empty tables and further columns pass through as each operator
defines them.
"""

import public_tokenizers
from pyspark.sql import functions as F

from sitescan.llm import byte_bpe, dart_minhash, decontaminate, quality, toxicity
from sitescan.llm.shared import Plain, remove, scratch, written


def _kept(docs, operator, keep):
    """The rows of `docs` that the operator's result keeps, as they were."""
    plain = Plain(docs, "doc_id", "text")
    return plain.back(operator(plain.rows).where(keep))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(spark, sf_dir):
    return _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score is below 0.3."""
    labels = _labels(spark, sf_dir)

    def scored(rows):
        field = toxicity.train(rows, labels, id_col="_id", text_col="_text")
        return toxicity.score_documents(rows, field, id_col="_id", text_col="_text")

    return _kept(docs, scored, F.col("toxicity.predicted") == 0)


def keep_good(spark, docs, sf_dir):
    """Documents that importance resampling towards good text draws."""
    labels = _labels(spark, sf_dir)
    return _kept(docs, lambda rows: quality.resample(rows, labels, id_col="_id", text_col="_text"), F.col("sampled"))


def keep_one_of_each(spark, docs, sf_dir):
    """One document of each class of near duplicates, that with the smallest id."""
    return _kept(docs, lambda rows: dart_minhash.near_duplicates(rows, id_col="_id", text_col="_text"), F.col("stays"))


def drop_leaks(spark, docs, sf_dir):
    """Documents that share no passage with the benchmark."""
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark, docs, sf_dir):
    """doc_id, n_tokens, ids (little-endian 32-bit) and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    return byte_bpe.decode_documents(encoded, path).select(
        F.col("doc").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

# SQL expresses neither the trained stages nor byte-level merges.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other; each one's rows are written and read again, and removed when the next one's are there."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        place = scratch(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), place)
        if before:
            remove(spark, before)
        before = place
    return docs
