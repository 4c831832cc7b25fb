"""Keyword signals in sentences, with the contexts that cancel a match."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The topic dictionary, its strong categories, and the contexts.
CATEGORIES = {
    "core_ai": ["artificial intelligence", "ai", "machine learning", "ml", "deep learning", "neural network", "neural net", "ai model", "ai models", "language model"],
    "generative_ai": ["generative ai", "gen ai", "genai", "chatgpt", "gpt", "gpt4", "gpt-4", "large language model", "llm", "llms", "foundation model", "transformer model", "retrieval augmented generation", "rag", "prompt engineering", "copilot", "co-pilot", "openai", "anthropic", "claude", "gemini", "bard", "midjourney", "dall-e", "stable diffusion", "deepseek"],
    "ml_techniques": ["natural language processing", "nlp", "computer vision", "image recognition", "speech recognition", "voice recognition", "reinforcement learning", "supervised learning", "unsupervised learning", "anomaly detection", "predictive model", "classification model", "regression model", "recommendation engine", "recommendation system"],
    "automation": ["automation", "automate", "automated", "automating", "robotic process automation", "rpa", "workflow automation", "process automation", "industrial automation", "grid automation", "factory automation"],
    "data_analytics": ["data analytics", "advanced analytics", "predictive analytics", "big data", "data science", "data-driven", "algorithm", "algorithmic", "analytics"],
    "ai_infrastructure": ["gpu", "gpus", "cuda", "tensor", "ai chip", "ai chips", "compute capacity", "training data", "inference", "inference workload", "data center", "data centers", "cloud computing", "edge computing"],
    "ai_applications": ["conversational ai", "ai-powered", "ai-driven", "ai-enabled", "ai-based", "intelligent assistant", "virtual assistant", "chatbot", "cognitive computing", "machine intelligence"],
}
STRONG = ["core_ai", "generative_ai", "ml_techniques", "ai_applications"]
EXACT = ["ai", "ml", "llm", "llms", "nlp", "rpa", "rag", "gpu", "gpus", "gpt", "gpt4", "gpt-4"]
NEIGHBOURS = [r"\bair\b", r"\baid\b", r"\baim\b", r"\bpaid\b", r"\b\d+(?:\.\d+)?\s*m[lL]\b", r"\bemail\b", r"\bretail\b", r"\bdetail\b", r"\bmaintain\b", r"\bcontainer\b"]
ROUTINE = [
    r"\bdata\s+center(?:s)?\b.{0,50}\b(capex|load(?:\s+growth)?|mw|megawatt|power|electric|utility|grid|cooling|lease|land|construction|facility|occupancy|real\s+estate)\b",
    r"\b(capex|load(?:\s+growth)?|mw|megawatt|power|electric|utility|grid|cooling|lease|land|construction|facility|occupancy|real\s+estate)\b.{0,50}\bdata\s+center(?:s)?\b",
    r"\bcloud\b.{0,50}\b(spend|cost|pricing|consumption|migration|workload|optimization|infrastructure)\b",
    r"\b(spend|cost|pricing|consumption|migration|workload|optimization)\b.{0,50}\bcloud\b",
    r"\b(pricing|revenue|margin|eps|guidance|outlook|growth|cost|opex|capex|expense|profit|algorithm)\b.{0,50}\balgorithm(?:ic)?\b",
    r"\balgorithm(?:ic)?\b.{0,50}\b(pricing|revenue|margin|eps|guidance|outlook|growth|cost|opex|capex|expense|profit|search|ranking|index|allocation)\b",
    r"\bautomation\b.{0,50}\b(factory|manufacturing|plant|warehouse|workflow|process|utility|grid|industrial|distribution|fulfillment)\b",
    r"\b(factory|manufacturing|plant|warehouse|workflow|process|utility|grid|industrial|distribution|fulfillment)\b.{0,50}\bautomation\b",
    r"\bdata\s+analytics\b.{0,50}\b(marketing|customer|sales|pricing|risk|fraud|credit|portfolio|operations?)\b",
    r"\b(marketing|customer|sales|pricing|risk|fraud|credit|portfolio|operations?)\b.{0,50}\bdata\s+analytics\b",
    r"\blong[-\s]?term\s+algorithm\b",
    r"\bfinancial\s+algorithm\b",
]
#: Families of weak keywords by a stem that their words hold; a keyword without one is its own.
FAMILIES = [
    ("data_center", ["data center"]),
    ("automation", ["automat", "rpa"]),
    ("algorithm", ["algorithm"]),
    ("analytics", ["analytic", "data science", "big data"]),
    ("cloud", ["cloud"]),
    ("compute_hw", ["gpu", "cuda", "tensor", "chip"]),
]
# End of fixed values.

#: Characters around a match in which a neighbour, or a routine context, cancels it.
NEAR, WIDE = 10, 120

#: Distinct families of weak keywords that make a sentence topical without a strong one.
WEAK_NEEDED = 2

#: Terms that are sent to the texts; more are met in a join that shuffles the words.
SENT_TERMS = 100_000

COLUMNS = ["kw_is_ai boolean", "kw_match_count int", "kw_ai_score double", "kw_strong_count int", "kw_weak_count int", "kw_weak_nonexcluded_count int", *[f"kw_{c}_count int" for c in CATEGORIES]]


@dataclass
class Lexicon:
    """A dictionary of keywords by category, some categories strong."""

    categories: dict[str, list[str]] = field(default_factory=lambda: CATEGORIES)
    strong: list[str] = field(default_factory=lambda: STRONG)
    exact: list[str] = field(default_factory=lambda: EXACT)
    neighbours: list[str] = field(default_factory=lambda: NEIGHBOURS)
    routine: list[str] = field(default_factory=lambda: ROUTINE)
    families: list[tuple[str, list[str]]] = field(default_factory=lambda: FAMILIES)

    def __post_init__(self) -> None:
        self.categories = {c: [w.casefold() for w in words] for c, words in self.categories.items()}
        self.family = {w: next((name for name, stems in self.families if any(x in w for x in stems)), w) for words in self.categories.values() for w in words}
        plural = lambda w: "" if w in self.exact or len(w) <= 3 else "(?:s)?"
        self.terms = [(c, w, re.compile(rf"\b{re.escape(w)}{plural(w)}\b", re.IGNORECASE)) for c, words in self.categories.items() for w in words]
        self.near, self.wide = (re.compile("|".join(p), re.IGNORECASE) for p in (self.neighbours, self.routine))

    def matches(self, text: str) -> list[tuple[str, str, bool]]:
        """(category, keyword, cancelled by routine context) of every match that
        no neighbour cancels; overlapping keywords all count."""
        found, folded = [], text.casefold()
        for category, word, pattern in self.terms:
            if word not in folded:  # a plain search spares most terms their pattern
                continue
            for m in pattern.finditer(text):
                a, b = m.span()
                if not self.near.search(text[max(0, a - NEAR) : b + NEAR]):
                    routine = category not in self.strong and bool(self.wide.search(text[max(0, a - WIDE) : b + WIDE]))
                    found.append((category, word, routine))
        return found

    def signals(self, text: str | None) -> tuple:
        """The values of COLUMNS."""
        text = text or ""
        found = self.matches(text)
        strong = sum(c in self.strong for c, _, _ in found)
        weak = [(w, routine) for c, w, routine in found if c not in self.strong]
        kept = [w for w, routine in weak if not routine]
        topical = strong >= 1 or len({self.family[w] for w in kept}) >= WEAK_NEEDED
        words = len(text.split())
        score = (strong + len(kept)) / words * 100 if words else 0.0
        return topical, len(found), score, strong, len(weak), len(kept), *[sum(c == k for c, _, _ in found) for k in self.categories]


#: A character of a word, and white space, as Python's expressions have them.
_W, _SPACE = r"[\p{L}\p{N}_]", r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_BLANKS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Letters that are another letter in a different case, beyond what lower() does.
_CASED = "".join(map(chr, (0x17F, 0x212A, 0x130))), "ski"


def _pattern(patterns: list[str]) -> str:
    """The same expression for the JVM, over folded text: its own classes are
    those of ASCII."""
    edge = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
    joined = "|".join(f"(?:{p})" for p in patterns)
    inner = _SPACE[1:-1]
    return "(?d)" + joined.replace("[-\\s]", f"[-{inner}]").replace("\\b", edge).replace("\\d", r"\p{Nd}").replace("\\s", _SPACE)


def _text(x: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(x: str, values) -> str:
    return f"{x} IN ({', '.join(map(_text, sorted(values)))})" if values else "false"


def _forms(lexicon: Lexicon) -> list[tuple[str, str, str]]:
    """(form, category, keyword): each keyword as it is, and its plural."""
    out = []
    for category, word, _ in lexicon.terms:
        out.append((word, category, word))
        if not (word in lexicon.exact or len(word) <= 3):
            out.append((word + "s", category, word))
    return out


def keyword_hits_sql(text_col: str, lexicon: Lexicon) -> str:
    """SQL of array<struct<form, routine>>: keywords of a text in any letter case
    that no neighbour cancels, and whether a routine context surrounds them.

    The text is cut into runs of word and other characters.  A form of n words is
    2n - 1 runs; where its first word stands, the rest is compared run by run, so
    a text is read once however many keywords there are.  Contexts are cut from
    the runs around a hit: each has a character at least.
    """
    folded = f"lower(translate(coalesce(`{text_col}`, ''), {_text(_CASED[0])}, {_text(_CASED[1])}))"
    runs = f"regexp_extract_all({folded}, {_text(f'{_W}+|[^{_W[1:-1]}]+')}, 0)"
    split = lambda form: re.findall(r"\w+|\W+", form)
    weak, forms = {form for form, c, _ in _forms(lexicon) if c not in lexicon.strong}, {}
    for form, _, _ in _forms(lexicon):
        forms.setdefault(len(split(form)), set()).add(form)
    first = {split(form)[0] for own in forms.values() for form in own}
    cut = lambda start, n: f"array_join(slice(z, {start}, {n}), '')"

    def around(chars: int) -> str:
        """A hit m with so many characters on both sides; m.at is from 0."""
        before = f"right({cut(f'greatest(m.at - {chars}, 0) + 1', f'least(m.at, {chars})')}, {chars})"
        return f"concat({before}, {cut('m.at + 1', 'm.n')}, left({cut('m.at + m.n + 1', chars)}, {chars}))"

    starts = f"filter(transform(z, (x, i) -> CASE WHEN {_among('x', first)} THEN i END), i -> i IS NOT NULL)"
    of = lambda n, own: f"filter(transform(s, i -> named_struct('at', i, 'n', {n}, 'form', {cut('i + 1', n)})), m -> {_among('m.form', own)} AND m.at + m.n <= size(z))"
    found = f"concat({', '.join(of(n, own) for n, own in sorted(forms.items()))})"
    kept = f"filter(flatten(transform(array({starts}), s -> {found})), m -> NOT rlike({around(NEAR)}, {_text(_pattern(lexicon.neighbours))}))"
    routine = f"CASE WHEN {_among('m.form', weak)} THEN rlike({around(WIDE)}, {_text(_pattern(lexicon.routine))}) ELSE false END"
    # The arrays of one element bind the runs and the starts to a name each.
    return f"transform(array({runs}), z -> transform({kept}, m -> named_struct('form', m.form, 'routine', {routine})))[0]"


def with_keywords(sentences: DataFrame, lexicon: Lexicon | None = None, text_col: str = "text") -> DataFrame:
    """Add the keyword columns, all of them by column expressions.

    A null text has zeros; other columns, whatever their names, pass unchanged.
    """
    lexicon = lexicon or Lexicon()
    forms = _forms(lexicon)
    hits = "_kw_hits" + "_" * max((len(c) for c in sentences.columns), default=0)
    found = sentences.withColumn(hits, F.expr(keyword_hits_sql(text_col, lexicon)))
    free = f"filter(`{hits}`, m -> NOT m.routine)"

    def total(pick, array: str = f"`{hits}`") -> str:
        """How often the hits are forms of chosen keywords."""
        by: dict[int, list[str]] = {}
        for form, n in Counter(form for form, category, _ in forms if pick(category)).items():
            by.setdefault(n, []).append(form)
        each = " ".join(f"WHEN {_among('m.form', own)} THEN {n}" for n, own in sorted(by.items()))
        return f"aggregate({array}, 0, (n, m) -> n + CASE {each} ELSE 0 END)" if by else "0"

    weak = lambda c: c not in lexicon.strong
    kinds = {}
    for form, category, word in forms:
        if weak(category):
            kinds.setdefault(lexicon.family[word], set()).add(form)
    families = " + ".join(f"int(exists({free}, m -> {_among('m.form', own)}))" for own in kinds.values()) or "0"
    strong_n, kept_n = total(lambda c: not weak(c)), total(weak, free)
    words = f"regexp_count(translate(`{text_col}`, {_text(_BLANKS)}, '{' ' * len(_BLANKS)}'), '[^ ]+')"
    values = {
        "kw_is_ai": f"{strong_n} >= 1 OR {families} >= {WEAK_NEEDED}", "kw_match_count": total(lambda _: True), "kw_ai_score": f"coalesce(({strong_n} + {kept_n}) / double(nullif({words}, 0)) * 100, 0D)",
        "kw_strong_count": strong_n, "kw_weak_count": total(weak), "kw_weak_nonexcluded_count": kept_n, **{f"kw_{own}_count": total(lambda c, own=own: c == own) for own in lexicon.categories},
    }
    none = {"kw_is_ai": "false", "kw_ai_score": "0D"}  # of most texts: nothing to count
    return found.select(*[F.col(f"`{c}`") for c in sentences.columns], *[F.expr(f"CASE WHEN size(`{hits}`) = 0 THEN {none.get(c, '0')} ELSE {x} END").alias(c) for c, x in values.items()])


def topical(text: F.Column, strong: list[str], weak: list[str]) -> F.Column:
    """The sentence rule without contexts, native: a strong word or two distinct
    weak ones, in plain a-z boundaries."""
    from turnlake.functions.scalars import any_word

    kinds = sum((any_word(text, [w]).cast("int") for w in weak), F.lit(0))
    return F.coalesce(any_word(text, strong) | (kinds >= WEAK_NEEDED), F.lit(False))


def term_places(texts: DataFrame, terms: DataFrame, keep: list[str], term: str = "term") -> DataFrame:
    """(keep..., term, place): where terms of one word or more stand in texts.

    Words are runs of a-z.  Terms are a relation of any size: a place meets the
    terms that begin with its word, and the words after it are compared then.
    Up to SENT_TERMS of them go to the texts, and no word is shuffled.
    Longest terms decide how many words a place carries; no terms, no places.
    """
    words = F.regexp_extract_all(F.lower(F.col(term)), F.lit("[a-z]+"), F.lit(0))
    wanted = terms.select(F.col(term).alias("term"), words.alias("_words")).filter(F.size("_words") > 0).distinct()
    longest, n = wanted.agg(F.max(F.size("_words")), F.count("*")).first()
    text = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("_w")
    # Texts are cut to the words and what follows them before any join.
    ahead = F.posexplode(F.transform("_w", lambda x, i: F.struct(x.alias("first"), F.slice("_w", i + 1, F.lit(longest or 1)).alias("ahead"))))
    places = texts.select(*keep, text).select(*keep, ahead.alias("place", "_p")).select(*keep, "place", F.col("_p.first").alias("_first"), F.col("_p.ahead").alias("_ahead"))
    wanted = wanted.withColumn("_first", F.element_at("_words", 1))
    met = places.join(F.broadcast(wanted) if n <= SENT_TERMS else wanted, "_first")
    return met.filter(F.slice("_ahead", 1, F.size("_words")) == F.col("_words")).select(*keep, "term", "place")


def term_hits(texts: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, hits): how often terms of one word or more stand in texts, by
    a join on words rather than a scan of every text for every term."""
    return term_places(texts, terms, [key]).groupBy(key, "term").agg(F.count("*").alias("hits"))
