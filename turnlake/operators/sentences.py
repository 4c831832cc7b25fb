"""Cleaning turns and cutting them into sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shortest sentence that is kept, and the length beyond which one is cut.
SHORTEST, LONGEST = 10, 512

#: A sentence ends at . ! or ? before white space and a capital, quote or digit.
#: This rule is our own: no trained boundary model is used.
BOUNDARY = r"(?<=[.!?])\s+(?=[\p{Lu}\"“0-9])"


def cleaned(text: Column) -> Column:
    """Collapse blanks first, then drop [..] and (..): so two blanks can stay."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"\[[^\]]*\]", ""), r"\([^)]*\)", ""))


def sentences_of(text: Column) -> Column:
    """array<string> of the sentences of a text."""
    parts = F.filter(F.transform(F.split(cleaned(text), BOUNDARY), lambda s: F.trim(s)), lambda s: F.length(s) >= SHORTEST)
    return F.transform(parts, lambda s: F.when(F.length(s) > LONGEST, F.concat(F.left(s, F.lit(LONGEST)), F.lit("..."))).otherwise(s))


def split_turns(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row a sentence of (doc_id, speech_turns, qa_turns), with its place in
    the turn's section and in the document."""
    frames = []
    for section in ("speech", "qa"):
        turns = parsed.select("doc_id", *(keep or []), F.lit(section).alias("section"), F.posexplode(f"{section}_turns").alias("turn_idx", "turn"))
        frames.append(turns.select("doc_id", *(keep or []), "section", "turn_idx", "turn.speaker", "turn.role", F.posexplode(sentences_of(F.col("turn.text"))).alias("at", "text")))
    rows = frames[0].unionByName(frames[1])
    own = Window.partitionBy("doc_id", "section").orderBy("turn_idx", "at")
    whole = Window.partitionBy("doc_id").orderBy(F.desc("section"), "turn_idx", "at")  # speech before qa
    return rows.withColumn("sentence_idx", F.row_number().over(own) - 1).withColumn("original_idx", (F.row_number().over(whole) - 1).cast("long")).drop("at")
