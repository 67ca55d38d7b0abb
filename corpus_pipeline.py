"""From documents to packed training sequences: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, the last
one the pieces of packed sequences. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photark.llm import line_dedup, mixing, packing, simhash, toxicity
from photark.llm.common import materialise, read

TOXIC = 0.5
SHINGLE, SIMILARITY = 5, 0.8
DISTANCE = 3  # of 64 bits: such fingerprints are looked at first
TOKENIZER, END_ID = "byte_bpe_50k.json", 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below TOXIC; one of just TOXIC goes. Null and empty texts have no words and
    are judged by that; a null doc_id has no label and is judged all the same; repeated rows are judged alike."""
    scored = toxicity.classify(docs, toxicity.table_labels(spark, sf_dir))
    return scored.where(F.col("p_toxic") < TOXIC).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; a document that had words and has none left goes. n_chars follows the text.

    Lines come first by doc_id (null first), so of equal lines the least doc_id keeps its own. Null and empty texts stay as they are;
    rows equal in doc_id and text are one document and fare alike."""
    kept = line_dedup.dedup(docs)
    kept = kept.where("n_removed = 0 or trim(replace(text, '\\n', '')) <> ''")
    return kept.select(*[F.char_length("text").cast(kept.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, joined by the similarity of their shingles, the first by doc_id (null first; of equal ones by
    the text's hash). Of repeated rows one stays, and of all rows with null, empty or wordless texts, which are copies of each other."""
    return simhash.keep_first(docs, SHINGLE, DISTANCE, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies in the order of the mix; the copy that the end of the budget cuts stays if half of it or more is in. Texts without
    words take no part. Null sources are one source, the last; a null doc_id is a value like others; repeated rows share their copies."""
    mixed = mixing.mix(docs)
    return mixed.where(2 * F.col("taken_words") >= mixing.words(F.col("text"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. A null or empty text is its end id alone; each row, repeated or without a doc_id, is packed for itself."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
