"""The transcript pipeline: named stages, each a relation written once."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import metrics, panel, turns
from turnlake.operators.keywords import Lexicon, with_keywords
from turnlake.operators.sentences import split_turns
from turnlake.sources.tables import FINGERPRINT, code_digest, content_digest, decode_turns, materialised, read_json, write_json

#: Columns that calls must have, and the key that must be unique.
CALL_COLUMNS, CALL_KEY = ["ticker", "year", "quarter", "structured_content"], ["ticker", "year", "quarter"]


def check_calls(calls: DataFrame) -> None:
    """Required columns, no null and no repeated key; a ValueError tells which."""
    missing = [c for c in CALL_COLUMNS if c not in calls.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    nulls = calls.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in CALL_KEY]).first().asDict()
    if any(nulls.values()):
        raise ValueError(f"null keys: {nulls}")
    if not calls.groupBy(*CALL_KEY).count().filter("count > 1").isEmpty():
        raise ValueError("repeated keys")


def check_dataset(df: DataFrame) -> dict:
    """Facts of a finished dataset: rows, repeated documents, null keys, and
    quarters that don't ascend within an entity."""
    from pyspark.sql import Window

    t = F.col("year") * 4 + F.col("quarter")
    step = t - F.lag(t).over(Window.partitionBy("ticker").orderBy("year", "quarter"))
    found = df.withColumn("_s", step).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("doc_id").isNull()).alias("null_keys"), F.count_if(F.col("_s") <= 0).alias("not_ascending")).first().asDict()
    return found | {"ok": bool(found["rows"]) and found["rows"] == found["documents"] and not found["null_keys"] and not found["not_ascending"]}


def _print(name: str, inputs: dict | None) -> str:
    return hashlib.sha256(json.dumps([name, inputs], sort_keys=True).encode()).hexdigest()


@dataclass
class Pipeline:
    """Stages 1 to 6 of a run under ``output``; ``force`` redoes what is there.

    A stage knows digests of the calls, of its parameters, of the code and of the
    stages it reads; if one is another than when it was written, it and what
    follows from it are made anew, and nothing else is.
    """

    spark: SparkSession
    output: str
    lexicon: Lexicon = field(default_factory=Lexicon)
    force: bool = False
    took: dict[str, float] = field(default_factory=dict)
    made: list[str] = field(default_factory=list)
    prints: dict[str, str] = field(default_factory=dict)

    def stage(self, name: str, make, reads: list[str], **parameters) -> DataFrame:
        """A relation, written once for the same inputs; ``reads`` are stages and
        inputs whose digests are known."""
        began = time.time()
        inputs = {"code": self._code(), "parameters": json.dumps(parameters, sort_keys=True, default=str), **{r: self.prints[r] for r in reads}}
        self.prints[name] = _print(name, inputs)

        def noted() -> DataFrame:
            self.made.append(name)
            return make()

        out = materialised(self.spark, f"{self.output}/{name}", noted, self.force, inputs)
        self.took[name] = round(time.time() - began, 3)
        return out

    def _code(self) -> str:
        if "code" not in self.prints:
            self.prints["code"] = code_digest()
        return self.prints["code"]

    def run(self, calls: DataFrame, start: int = 1) -> dict[str, DataFrame]:
        """Relations by name.  Stages before ``start`` must have been written."""
        check_calls(calls)
        self.prints["calls"] = content_digest(calls.select(CALL_COLUMNS))
        key = F.concat("ticker", F.lit("_"), F.col("year").cast("string"), F.lit("Q"), F.col("quarter").cast("string"))
        turned = calls.select(key.alias("doc_id"), "ticker", "year", "quarter", decode_turns("structured_content").alias("turns"))
        out: dict[str, DataFrame] = {}

        def step(i: int, name: str, make, reads: list[str], **parameters) -> None:
            if i < start:
                out[name] = self.spark.read.parquet(f"{self.output}/{name}")
                self.prints[name] = _print(name, read_json(f"{self.output}/{name}/{FINGERPRINT}", self.spark))
            else:
                out[name] = self.stage(name, make, reads, **parameters)

        words = {"lexicon": [self.lexicon.categories, self.lexicon.strong, self.lexicon.exact, self.lexicon.neighbours, self.lexicon.routine, self.lexicon.families]}
        step(1, "parsed_transcripts", lambda: turns.parse_calls(turned), ["calls"])
        step(2, "sentences", lambda: split_turns(out["parsed_transcripts"]), ["parsed_transcripts"])
        step(3, "sentences_with_keywords", lambda: with_keywords(out["sentences"], self.lexicon), ["sentences"], **words)
        step(5, "section_metrics", lambda: metrics.section_metrics(out["sentences_with_keywords"]), ["sentences_with_keywords"])
        step(5, "document_metrics", lambda: metrics.document_metrics(out["section_metrics"]), ["section_metrics"])
        step(6, "exchanges", lambda: self.exchanges(out["sentences_with_keywords"]), ["sentences_with_keywords"], **words)
        step(6, "initiation_scores", lambda: turns.initiation_scores(out["exchanges"]), ["exchanges"])
        return out

    def exchanges(self, sentences: DataFrame) -> DataFrame:
        """Exchanges with their types; question and answer are scored anew as
        whole texts."""
        pairs = turns.exchanges(turns.turns_of_sentences(sentences))
        both = pairs.select("doc_id", "exchange_idx", F.posexplode(F.array("question_text", "answer_text")).alias("side", "text"))
        flags = with_keywords(both, self.lexicon).groupBy("doc_id", "exchange_idx").agg(F.max(F.when(F.col("side") == 0, F.col("kw_is_ai"))).alias("question_is_ai"), F.max(F.when(F.col("side") == 1, F.col("kw_is_ai"))).alias("answer_is_ai"))
        return pairs.join(flags, ["doc_id", "exchange_idx"]).withColumn("initiation_type", turns.initiation_type(F.col("question_is_ai"), F.col("answer_is_ai")))

    def manifest(self) -> None:
        write_json({"seconds": self.took, "made": self.made, "fingerprints": self.prints, "output": self.output, "spark": self.spark.version}, f"{self.output}/manifest.json", self.spark)


def research_dataset(out: dict[str, DataFrame], fundamentals: DataFrame) -> DataFrame:
    """One row a call: intensity, initiation (0 exchanges and 0.5 where there
    are none), structure, fundamentals and next-quarter targets."""
    base = out["parsed_transcripts"].select("doc_id", "ticker", "year", "quarter")
    joined = base.join(out["document_metrics"], "doc_id", "left").join(out["initiation_scores"], "doc_id", "left").join(metrics.structure(out["sentences_with_keywords"]), "doc_id", "left")
    counts = [c for c in joined.columns if c.endswith("_count") or c.startswith("total_") or c.endswith("_initiated_ratio") or c.endswith("_pivot_ratio")]
    filled = joined.fillna({c: 0 for c in counts} | {"ai_initiation_score": 0.5})
    return filled.join(panel.panel_features(fundamentals), ["ticker", "year", "quarter"], "left")
