"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the columns of documents; its decisions take effect there:
rejected documents are gone, repeated lines are cut from the text (n_chars follows), one
document of each group of near-duplicates stays, contaminated documents are gone and long
benchmark passages are cut from the others.  The last stage gives the token ids of what is
left.  All stages take null and empty texts, null and repeated keys, empty tables, texts of
any length (whole) and further columns of any name, which travel along unchanged.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.llm.common import read_table, remove, scratch, shared_path, uncarried
from fungo.llm.decontam import decontaminate
from fungo.llm.linededup import dedup_lines
from fungo.llm.quality import judge_quality
from fungo.llm.queries import BPE_PATTERN, BPE_RANKS, PIECE_MODEL
from fungo.llm.simhash import drop_near_duplicates
from fungo.llm.spm import encode_documents


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules and the fertility bands keep, unchanged.  Null and empty texts go; a text gets one verdict wherever it stands, so repeated rows stay or go together."""
    carry = tuple(docs.columns)
    return judge_quality(docs, PIECE_MODEL, BPE_RANKS, BPE_PATTERN, carry=carry).filter("kept").select(*uncarried(carry))


def line_dedup(spark, docs, sf_dir):
    """All documents, without lines that five documents or more hold, but for the largest doc_id's; n_chars counts anew where lines were dropped.  Null texts stay null; rows without a doc_id are one document, which keeps no line that others hold."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = dedup_lines(docs, carry=carry).select("doc_id", F.col("text").alias("_text"), "n_dropped", *(F.col(f"_c{i}") for i in range(len(carry))))
    beside = {c: F.col(f"_c{i}") for i, c in enumerate(carry)}
    if "n_chars" in beside:
        beside["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(beside["n_chars"])
    return out.select(*((F.col("doc_id") if c == "doc_id" else F.col("_text") if c == "text" else beside[c]).alias(c) for c in docs.columns))


def near_dedup(spark, docs, sf_dir):
    """One document of each group within 4 bits: the smallest doc_id's; of equal rows one, and rows without a doc_id only where their group has no other.  Null and empty texts are one group."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents of which hit words make less than a twentieth, without passages of 13 hit words or more (n_chars counts anew there).  Null and empty texts have no words and stay; an empty benchmark leaves all as it is."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), length="n_chars" if "n_chars" in docs.columns else None)


def sentencepiece(spark, docs, sf_dir):
    """Token ids of every text; null for null texts, none for empty ones; one row per row."""
    return encode_documents(docs, PIECE_MODEL)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Tokenisers, XXH64 and SHA-exact line rebuilding are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each one's rows lie in the shared folder before the next reads them, and its own intermediate tables are removed then."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_path(spark)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
