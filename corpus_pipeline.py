"""A training corpus from documents: known languages, no exact or near copies, no repeated passages, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results, of every stage: ids may be null or repeated, since rows are told apart by themselves or by number; texts
of any length are read whole; an empty table gives an empty one; columns that documents doesn't have are kept (by all
but the last stage) and never read, whatever their names. What a stage does with null, empty, equal and repeated texts
is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import drop_stash, stashed_alone, table
from codeloom.llm.exact_dedup import drop_copies
from codeloom.llm.langid import drop_unknown
from codeloom.llm.minhash_dedup import drop_near_copies
from codeloom.llm.packing import pack
from codeloom.llm.suffix_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that two language families claim alike, go.

    Null and empty texts go. Repeated rows are judged alike. Where no row has a language to learn from, all go.
    """
    return drop_unknown(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the most code points stays, then the one with the smallest id.

    Null, empty and blank texts are one group. Of rows that tie in all, one stays; a null id loses every tie.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a likeness of 0.8 in five-word shingles, directly or through others, the one with the smallest id stays.

    Null, empty and blank texts are linked with nothing and stay. Fewer than five words are one shingle. Repeated rows
    are linked; a null id stays only where no linked row has an id.
    """
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings (about 50 tokens) that start anywhere else too go from the texts, all occurrences.

    Null texts stay null and shorter texts as they are. Repeated rows repeat each other. A text that loses all its bytes
    stays as an empty one; n_chars is counted anew, and code points that a cut would split go whole.
    """
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, in order of the ids, null ids first.

    Null and empty texts are their end id alone. Repeated rows are documents of their own. An empty table has no pieces.
    """
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Learned models, component closures and the public tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stashed_alone(lambda: stage(spark, docs, sf_dir), f"stage-{name}")
        drop_stash(before)
    return STAGES[-1][1](spark, docs, sf_dir)
