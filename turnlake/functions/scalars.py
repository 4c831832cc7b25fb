"""Column expressions: guarded arithmetic, keys, text tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantised(x: Column | str) -> Column:
    """Rounded half up to six places, alike in every engine."""
    return F.floor(_c(x) * 1e6 + 0.5) / 1e6


def guarded_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0.0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def open_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, missing where b is 0 or missing."""
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def finite(x: Column | str) -> Column:
    """Infinite and NaN become missing."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def positive_flag(x: Column | str) -> Column:
    """1 where x > 0, else 0; missing counts as 0."""
    return F.coalesce(_c(x) > 0, F.lit(False)).cast("int")


def number(x: Column | str) -> Column:
    return F.expr(f"try_cast({x} AS double)") if isinstance(x, str) else x.try_cast("double")


def moment(x: Column | str) -> Column:
    return F.try_to_timestamp(_c(x))


def normal_key(x: Column | str) -> Column:
    return F.upper(F.trim(_c(x)))


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in columns])


def sector_code(code: Column | str) -> Column:
    """Prefix and zero-padding to eight; longer codes are kept whole."""
    text = _c(code).cast("string")
    return F.concat(F.lit("GICS_"), F.when(F.length(text) >= 8, text).otherwise(F.lpad(text, 8, "0")))


def doc_key(ticker: Column | str, year: Column | str, quarter: Column | str) -> Column:
    return F.concat(_c(ticker), F.lit("_"), _c(year).cast("string"), F.lit("Q"), _c(quarter).cast("string"))


_KEY = r"^(.*)_(\d{4})Q(\d)$"


def key_ticker(doc_id: Column | str) -> Column:
    """The part before the last underscore, also where the suffix is no quarter."""
    doc_id = _c(doc_id)
    return F.when(doc_id.rlike(_KEY), F.regexp_extract(doc_id, _KEY, 1)).otherwise(F.regexp_replace(doc_id, r"_[^_]*$", ""))


def key_year(doc_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(doc_id), _KEY, 2), F.lit("")).try_cast("int")


def key_quarter(doc_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(doc_id), _KEY, 3), F.lit("")).try_cast("int")


def quarter_index(year: Column | str, quarter: Column | str) -> Column:
    return _c(year) * 4 + _c(quarter)


def quarter_label(year: Column | str, quarter: Column | str) -> Column:
    return F.concat(_c(year).cast("string"), F.lit("Q"), _c(quarter).cast("string"))


def mid_quarter(year: Column | str, quarter: Column | str) -> Column:
    return F.make_date(_c(year).cast("int"), ((_c(quarter) - 1) * 3 + 2).cast("int"), F.lit(15))


def section_label(section: Column | str) -> Column:
    """Any spelling of a section to speech, qa or other."""
    s = F.lower(F.trim(_c(section)))
    return F.when(s.isin("speech", "prepared", "prepared remarks", "presentation"), "speech").when(s.isin("qa", "q&a", "q & a", "question and answer", "questions and answers"), "qa").otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit("other")))


def truncated(text: Column | str, n: int) -> Column:
    text = _c(text)
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def dominant(values: Column | str) -> Column:
    """0-based place of the greatest entry; the first of equals."""
    values = _c(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def binary_label(x: Column | str) -> Column:
    """1, 0 or missing of the usual spellings."""
    s = F.lower(F.trim(_c(x).cast("string")))
    return F.when(s.isin("1", "1.0", "true", "yes", "y", "t"), 1).when(s.isin("0", "0.0", "false", "no", "n", "f"), 0)


def any_word(text: Column | str, words: list[str]) -> Column:
    """Whether one of the words stands in the text, bounded by non-letters of
    a-z: the same test in every regex engine."""
    return F.lower(_c(text)).rlike(f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)")


def words_in(text: Column | str) -> Column:
    """Lower-case runs of a-z."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z]+"), F.lit(0))


def count_in(tokens: Column | str, words: list[str]) -> Column:
    return F.size(F.filter(_c(tokens), lambda t: t.isin(*words)))


def word_count(text: Column | str) -> Column:
    """Blank-separated words; none in a blank or missing text."""
    t = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
