"""Word measures: tone, mechanisms, frequencies, TF-IDF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.scalars import count_in, guarded_ratio, words_in
from turnlake.operators.keywords import term_places
from turnlake.sources.session import importable

#: Text bytes of the documents that are counted together.
PART_BYTES = 8 << 20

# Word lists of the measures.
POSITIVE = ["benefit", "confidence", "efficient", "efficiency", "gain", "growth", "improve", "innovation", "lead", "margin", "opportunity", "optimize", "progress", "strong", "upgrade", "value"]
NEGATIVE = ["challenge", "concern", "decline", "difficult", "headwind", "loss", "pressure", "risk", "slowdown", "uncertain", "uncertainty", "volatile", "weak", "worse"]
EFFICIENCY = ["cost", "reduce", "efficiency", "automate", "automation", "margin", "save", "productivity"]
GROWTH = ["product", "revenue", "research", "growth", "new", "opportunity", "innovation", "expand"]
# End of fixed values.


def lexicon_ratios(texts: DataFrame, lists: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of a document's words that are in each list; 0.0 without words."""
    counted = texts.withColumn("_w", words_in(F.coalesce(F.col(text), F.lit(""))))
    sums = counted.groupBy(key).agg(F.sum(F.size("_w")).alias("_n"), *[F.sum(count_in("_w", words)).alias(name) for name, words in lists.items()])
    return sums.select(key, *[guarded_ratio(name, "_n").alias(f"{name}_ratio") for name in lists])


def tone(sentences: DataFrame) -> DataFrame:
    """Positive and negative words among the list words of topical sentences."""
    words = words_in(F.coalesce("text", F.lit("")))
    on = F.col("kw_is_ai").cast("boolean")
    sums = sentences.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(on, count_in(words, POSITIVE))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(on, count_in(words, NEGATIVE))), F.lit(0)).alias("n"))
    both = F.col("p") + F.col("n")
    return sums.select("doc_id", guarded_ratio("p", both).alias("positive_tone_ratio"), guarded_ratio("n", both).alias("negative_tone_ratio"))


def mechanisms(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    return lexicon_ratios(texts, {"efficiency": EFFICIENCY, "growth": GROWTH}, key)


def document_text(sentences: DataFrame, mode: str = "all", section: str | None = None) -> DataFrame:
    """(doc_id, text) of sentences in order.  ``mode``: all, topical (others are
    left out) or blanked (others are empty).  A document without the section has
    the text of all its sections."""
    s = sentences
    if section:
        own = Window.partitionBy("doc_id")
        s = s.withColumn("_has", F.max((F.col("section") == section).cast("int")).over(own)).filter((F.col("_has") == 0) | (F.col("section") == section))
    on = F.col("kw_is_ai").cast("boolean") if mode != "all" else F.lit(True)
    if mode == "topical":
        s = s.filter(on)
    text = F.when(on, F.col("text")).otherwise("") if mode == "blanked" else F.col("text")
    ordered = s.select("doc_id", F.struct("section", "turn_idx", "sentence_idx", text.alias("text")).alias("x"))
    return ordered.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), " ").alias("text"))


def _gram_lists(low: int, high: int, stop: list[str] | None) -> F.Column:
    """All word n-grams of a row's text, in an array."""
    words = words_in(F.coalesce("text", F.lit("")))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))

    def of(n: int, w: F.Column) -> F.Column:
        if n == 1:
            return w
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    if low == high == 1:
        return words
    # The array of one element binds the words to a name.
    return F.transform(F.array(words), lambda w: F.concat(*[of(n, w) for n in range(low, high + 1)]))[0]


def grams(texts: DataFrame, low: int = 1, high: int = 1, key: str = "doc_id", stop: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """(key, term): all word n-grams of low to high words; with ``distinct``
    each once a row."""
    terms = _gram_lists(low, high, stop)
    return texts.select(key, F.explode(F.array_distinct(terms) if distinct else terms).alias("term"))


def term_frequency(texts: DataFrame, low: int = 1, high: int = 1, key: str = "doc_id") -> DataFrame:
    return grams(texts, low, high, key).groupBy("term").agg(F.count("*").alias("n"))


def document_frequency(texts: DataFrame, low: int = 1, high: int = 1, key: str = "doc_id", unique: bool = False) -> DataFrame:
    """Documents with each term.  Terms are made distinct in the row; only where
    rows may share a key (not ``unique``) are they also made distinct by key, in
    one shuffle on the key alone."""
    if unique:
        terms = grams(texts, low, high, key, distinct=True)
    else:
        terms = grams(texts.repartition(key), low, high, key, distinct=True).distinct()
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(texts: DataFrame, low: int = 1, high: int = 2, min_df: int = 1, max_df: float = 1.0, sublinear: bool = True, max_terms: int | None = None, key: str = "doc_id", stop: list[str] | None = None) -> DataFrame:
    """(key, term, tf, df, weight): smoothed idf ln((1+n)/(1+df))+1, tf or
    1+ln tf, rows scaled to length 1.

    Texts are shuffled by their key once, in parts.  A part sends each of its terms
    once, with its counts, and gets the counts of all; the pairs of key and term,
    which are many more, stay where they are.
    """
    importable(texts.sparkSession)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = F.pmod(F.xxhash64(key), F.lit(max(1, -(-total // PART_BYTES)))).cast("int")
    # The texts of a key are in one part; the words are cut where they arrive.
    placed = texts.select(part.alias("part"), F.col(key).alias("key"), "text").repartition("part")
    rows = placed.select("part", "key", _gram_lists(low, high, stop).alias("terms"))
    here = rows.groupBy("part").applyInArrow(_part_terms, "part int, term string, df long, total long")
    n = F.broadcast(texts.agg(F.count_distinct(key).alias("docs")))  # one row
    kept = here.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).crossJoin(n).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * max_df))
    if max_terms:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_terms)
    back = here.select("part", "term").join(kept.select("term", "df", "docs"), "term").select("part", "term", "df", "docs")
    found = rows.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_weighed(sublinear), f"key {texts.schema[key].dataType.simpleString()}, term string, tf long, df long, weight double")
    return found.withColumnRenamed("key", key)


def _counted(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and terms of a part, and for each pair of them that occurs: the
    places of both, and how often."""
    lists = rows.column("terms").combine_chunks()
    keys, terms = rows.column("key").combine_chunks().dictionary_encode("encode"), lists.flatten().dictionary_encode()
    owner = np.repeat(keys.indices.to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    size = max(len(terms.dictionary), 1)
    pair, tf = np.unique(owner * size + terms.indices.to_numpy(), return_counts=True)
    return keys.dictionary, terms.dictionary, pair // size, pair % size, tf


def _part_terms(rows: pa.Table) -> pa.Table:
    _, terms, _, term, tf = _counted(rows)
    df, total = np.bincount(term, minlength=len(terms)), np.bincount(term, tf, len(terms)).astype(np.int64)
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()] * len(terms), pa.int32()), "term": terms, "df": df, "total": total})


def _weighed(sublinear: bool):
    def run(rows: pa.Table, kept: pa.Table) -> pa.Table:
        if not rows.num_rows or not kept.num_rows:
            kept, rows = kept.slice(0, 0), rows.slice(0, 0)
        keys, terms, key, term, tf = _counted(rows)
        at = pc.index_in(terms, value_set=kept.column("term").combine_chunks())
        here = pc.is_valid(at).to_numpy(zero_copy_only=False)[term]
        key, term, tf = key[here], term[here], tf[here]
        df = kept.column("df").to_numpy()[pc.fill_null(at, 0).to_numpy()[term]]
        w = (1 + np.log(tf) if sublinear else tf) * (np.log((1 + kept.column("docs").to_numpy()[:1]) / (1 + df)) + 1) if len(tf) else np.zeros(0)
        norm = np.sqrt(np.bincount(key, w * w, len(keys)))
        return pa.table({"key": keys.take(pa.array(key)), "term": terms.take(pa.array(term)), "tf": tf.astype(np.int64), "df": df.astype(np.int64), "weight": w / norm[key]})

    return run


def example_sentences(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, text): the first sentence that holds each term, of one word or more."""
    places = term_places(sentences, terms, ["doc_id", "original_idx"]).select("doc_id", "original_idx", "term").distinct()
    first = places.groupBy("term").agg(F.min(F.struct("doc_id", "original_idx")).alias("at")).select("term", "at.doc_id", "at.original_idx")
    # Only the chosen sentences' texts are joined, not one for each place.
    return first.join(sentences.select("doc_id", "original_idx", "text"), ["doc_id", "original_idx"]).groupBy("term").agg(F.min("text").alias("text"))
