"""Surrogates for personal data, by DataFrame functions alone.

Detected values become replacements of the same type and shape, derived from a
key: digits stay digits, letters keep their case, card numbers stay valid under
their check digit, names keep gender and script.  One value has one surrogate
in the whole corpus, so who is who can still be followed, and no two values
share one: candidates are checked against each other and against every real
value, and whatever collides is derived anew.

Detected are: e-mail addresses, passwords after "password=", access keys, IBANs,
hexadecimal tokens, IPv4 addresses, phone numbers with + and country code or in
US form, US social security numbers, card numbers, and names of one or two words
after a title (_MALE, _FEMALE), with every bare mention of such a name in the
same row.  Not detected are persons never named with a title, initials, postal
addresses, national phone formats other than the US one, and other id numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import stored

_MALE = r"Mr\.?|Herr|Monsieur|Señor|Господин|г-н"
_FEMALE = r"Mrs\.?|Ms\.?|Frau|Madame|Señora|Госпожа|г-жа"
#: O'Brien, Jean-Luc, McDonald; not the 's of a genitive.
_NAME = r"\p{Lu}(?:\p{L}{1,30}|['’]\p{Lu}\p{L}{0,30})(?:-\p{L}{1,30}|['’]\p{Lu}\p{L}{0,30}){0,3}"
_BARE = rf"(?<![\p{{L}}]){_NAME}(?!\p{{L}})"

#: Type and pattern, in order of precedence where two match at one place.
#: Every repetition is bounded or possessive, so a scan stays linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<=\bpassword=)[A-Za-z0-9]{4,64}\b",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "token": r"\b[0-9a-f]{32,64}\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{4}(?!\d)|(?<![\d+])\+\d(?:[ .\-/()]{0,2}\d){7,14}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])",
    "male": rf"(?<![\p{{L}}])(?:{_MALE}) {_NAME}(?: {_NAME})?",
    "female": rf"(?<![\p{{L}}])(?:{_FEMALE}) {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: A text without any of these holds no match; it spares most texts the scan.
_HINT = rf"[0-9]{{3}}|[0-9][ .\-][0-9]|[A-Z]{{2}}[0-9]{{2}}|\+[0-9]|@|password=|AKIA|ASIA|[0-9a-f]{{32}}|(?:{_MALE}|{_FEMALE}) \p{{Lu}}"

#: Name parts by script; a surrogate name joins parts chosen by the key.
_SYLLABLES = {
    "latin": (["Bar", "Cal", "Dor", "Fen", "Gar", "Hol", "Kel", "Lan", "Mar", "Nor", "Pel", "Ros", "Sel", "Tor", "Ver", "Wil"], ["a", "e", "i", "o", "an", "el", "in", "or"], ["den", "ford", "lin", "man", "mer", "ner", "sen", "ton"]),
    "greek": (["Βαρ", "Γερ", "Δημ", "Ζαν", "Θωμ", "Καλ", "Λαμ", "Μαρ", "Νικ", "Παπ", "Ραλ", "Σαρ", "Ταν", "Φιλ", "Χαρ", "Ψαλ"], ["α", "ε", "ι", "ο", "αν", "ελ", "ιν", "ορ"], ["άκης", "ίδης", "όπουλος", "έλης", "άτος", "ίνης", "ούδης", "ώνης"]),
    "armenian": (["Բար", "Գեր", "Դան", "Զար", "Թոր", "Կար", "Լեւ", "Մար", "Նար", "Պետ", "Ռաֆ", "Սար", "Տիգ", "Վար", "Քար", "Ֆիլ"], ["ա", "ե", "ի", "ո", "ան", "ել", "ին", "որ"], ["յան", "ունի", "ենց", "ացի", "ուրի", "անց", "իկյան", "ոսյան"]),
    "cyrillic": (["Бар", "Вол", "Гор", "Дан", "Зар", "Кал", "Лев", "Мар", "Нов", "Пол", "Рос", "Сав", "Тар", "Фед", "Хол", "Яр"], ["а", "е", "и", "о", "ан", "ел", "ин", "ор"], ["ко", "лин", "ман", "мер", "нев", "сен", "тин", "шин"]),
}
_ENDINGS = {"male": {"latin": ["us", "o", "er", "en"], "greek": ["ος", "ης", "ας", "ων"], "armenian": ["են", "ակ", "ատ", "ոս"], "cyrillic": ["ий", "ил", "ор", "ан"]}, "female": {"latin": ["a", "ia", "ine", "elle"], "greek": ["α", "η", "ία", "ούλα"], "armenian": ["ա", "ուհի", "ինե", "իա"], "cyrillic": ["а", "ия", "ина", "ета"]}}

#: Rounds of derivation within the format, of which each draws only for the values
#: that collided before; a format that is all but used up is then widened.
ROUNDS = 48


def _digest(key: str, kind: Column, value: Column, turn: int) -> Column:
    parts = [F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, F.lit(f"{turn}{salt}")), 512) for salt in "ab"]
    return F.concat(*parts)  # 128 bytes in hex


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), F.pmod(number, F.lit(len(choices))) + 1)


def _shaped(value: Column, digest: Column, low_digit: int = 0, keep: Column | None = None) -> Column:
    """Each letter or digit replaced by one of its kind; the first ``keep``
    characters and all others stay."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        new = (
            F.when(c.rlike("^[0-9]$"), (F.pmod(b, F.lit(10 - low_digit)) + low_digit).cast("string"))
            .when(c.rlike("^[a-z]$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(b, F.lit(26)) + 1, F.lit(1)))
            .when(c.rlike("^[A-Z]$"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(b, F.lit(26)) + 1, F.lit(1)))
            .otherwise(c)
        )
        return new if keep is None else F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _card(value: Column, digest: Column) -> Column:
    """Digits anew, the first kept, the last a valid Luhn check digit; the
    separators stay where they are."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    body = _shaped(F.substring(digits, F.lit(1), n - 1), digest, keep=F.lit(1))
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    from_right = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    check = F.pmod(10 - F.pmod(F.aggregate(from_right, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")
    made = F.concat(body, check)
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9]", "")) + 1
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(made, place(i), F.lit(1))).otherwise(c)), "")


def _name(kind: Column, value: Column, digest: Column, turn: int) -> Column:
    def of(script: str) -> Column:
        first, middle, last = _SYLLABLES[script]
        stem = F.concat(_pick(first, _byte(digest, F.lit(0))), *[_pick(middle, _byte(digest, F.lit(4 + j))) for j in range(1 + turn // 3)])
        given = {g: F.concat(stem, _pick(_ENDINGS[g][script], _byte(digest, F.lit(2)))) for g in _ENDINGS}
        return F.when(kind == "given male", given["male"]).when(kind == "given female", given["female"]).otherwise(F.concat(stem, _pick(last, _byte(digest, F.lit(3)))))

    made = of("latin")
    for script in ("armenian", "greek", "cyrillic"):
        made = F.when(value.rlike(rf"\p{{Is{script.capitalize()}}}"), of(script)).otherwise(made)
    return made


def surrogate(key: str, kind: Column, value: Column, turn: int) -> Column:
    """The candidate of a part of an entity in one round."""
    digest = _digest(key, kind, value, turn)
    at, dot = F.instr(value, "@"), F.call_function("locate", F.lit("."), value, F.instr(value, "@"))
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (F.pmod(_byte(digest, i), F.lit(254)) + 1).cast("string")), ".")
    hexed = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), F.pmod(_byte(digest, i), F.lit(16)) + 1, F.lit(1))), "")
    made = (
        F.when(kind == "email", F.concat(_shaped(F.substring(value, F.lit(1), dot - 1), digest), F.substring(value, dot, F.length(value))))
        .when(kind == "ip", octets)
        .when((kind == "token") | ((kind == "secret") & value.rlike("^[0-9a-f]+$")), hexed)
        .when(kind == "card", _card(value, digest))
        .when(kind == "phone", _shaped(value, digest, low_digit=2, keep=F.when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .\-(])|^\+\d", 0))).otherwise(0)))
        .when(kind == "key", _shaped(value, digest, keep=F.lit(4)))
        .when(kind == "iban", _shaped(value, digest, keep=F.lit(2)))
        .when(kind.isin("given male", "given female", "surname"), _name(kind, value, digest, turn))
        .otherwise(_shaped(value, digest))
    )
    if turn < ROUNDS:
        return made
    # The format has no room left: widen it by a mark that no other value has.
    mark = F.substring(F.sha2(F.concat_ws("\u0001", kind, value), 256), 1, 16 + 4 * (turn - ROUNDS))
    return F.when(kind == "email", F.concat(F.substring(made, F.lit(1), at - 1), mark, F.substring(made, at, F.length(made)))).otherwise(F.concat(made, mark))


def _kind(value: Column) -> Column:
    """Type of a detected value: the first pattern that all of it matches."""
    plain = {t: p.replace(r"(?<=\bpassword=)", "") for t, p in PATTERNS.items()}
    tests = [F.when(value.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in plain.items() if t != "secret"]
    return F.coalesce(*tests, F.lit("secret"))


def _parts(kind: Column, value: Column) -> Column:
    """array<struct<kind, value>>: a person's title stays, the given name and
    the surname are parts of their own; any other value is one part."""
    title, rest = F.substring_index(value, " ", 1), F.split(value, " ")
    part = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    given = part(F.concat(F.lit("given "), kind), F.get(rest, F.lit(1)))
    full = F.array(part(F.lit("title"), title), given, part(F.lit("surname"), F.get(rest, F.lit(2))))
    short = F.array(part(F.lit("title"), title), part(F.lit("surname"), F.get(rest, F.lit(1))))
    return F.when(kind.isin("male", "female"), F.when(F.size(rest) == 3, full).otherwise(short)).otherwise(F.array(part(kind, value)))


def assign(parts: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): no surrogate twice,
    none that is itself a value found in the corpus."""
    real = parts.select(F.col("value").alias("made")).distinct()
    pending, accepted = parts, None
    cores = parts.sparkSession.sparkContext.defaultParallelism
    for turn in range(ROUNDS + 8):
        # Few bytes but dear to derive: over all cores, whatever their size says.
        made = pending.repartition(2 * cores).withColumn("made", surrogate(key, F.col("kind"), F.col("value"), turn)).join(real, "made", "left_anti")
        if accepted is not None:
            made = made.join(accepted.select(F.col("surrogate").alias("made")), "made", "left_anti")
        # One of each group of equal candidates: a minimum, combined before the shuffle.
        won = made.groupBy("made").agg(F.min(F.struct("kind", "value")).alias("of")).select("of.kind", "of.value", F.col("made").alias("surrogate"))
        won = stored(won, "surrogates")
        accepted = won if accepted is None else accepted.unionByName(won)
        pending = pending.join(won, ["kind", "value"], "left_anti")
        if pending.isEmpty():
            return accepted
    raise ValueError("no free surrogate was found")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text, n_replaced) of every row, and the columns ``carry`` as they
    are.

    Null texts stay null and empty ones empty; texts without a detected value
    are unchanged.  A name found after a title is also replaced where it stands
    alone in the same row; such places count in n_replaced.  Rows that repeat an id are replaced each by itself, and null
    ids are allowed: a value's surrogate doesn't depend on its row.  With other
    keys, all surrogates differ.  A ValueError tells of a format so full that no
    surrogate is left even when it is widened.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry or []]).alias("carried"))
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    # Every text is scanned once: what was found is written with it.
    marked = docs.withColumn("found", F.coalesce(F.when(F.col("text").rlike(_HINT), found), F.array().cast("array<string>")))
    marked = stored(marked.withColumn("row", F.monotonically_increasing_id()), "pii")
    plain = marked.filter(F.size("found") == 0).select("doc_id", "text", F.lit(0).alias("n_replaced"), "carried")
    hits = marked.filter(F.size("found") > 0)
    values = hits.select(F.explode("found").alias("value")).distinct().withColumn("kind", _kind(F.col("value")))
    split = stored(values.withColumn("parts", _parts(F.col("kind"), F.col("value"))).select("value", F.posexplode("parts").alias("at", "part")).select("value", "at", "part.kind", F.col("part.value").alias("own")), "pii-parts")
    chosen = assign(split.filter("kind <> 'title'").select("kind", F.col("own").alias("value")).distinct(), key)
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("surrogate", "own").alias("s")))), lambda x: x["s"]), " ")
    person = F.when((F.col("kind") == "surname") | F.col("kind").startswith("given "), F.struct("own", (F.col("kind") != "surname").alias("given"), F.col("surrogate").alias("made")))
    named = split.join(chosen.select("kind", F.col("value").alias("own"), "surrogate"), ["kind", "own"], "left").groupBy("value").agg(made.alias("surrogate"), F.collect_list(person).alias("people"))
    # A hot value is a hot key of the left side alone, which AQE splits.
    pairs = hits.select("row", F.explode(F.array_distinct("found")).alias("value")).join(named, "value").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("value", "surrogate"))).alias("to"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("people")))).alias("people"))
    # One surrogate for a bare name: that of the surname where it is both.
    people = F.filter("people", lambda x, i: (i == 0) | (F.get("people", i - 1)["own"] != x["own"]))
    pairs = pairs.select("row", "to", F.map_from_entries(F.transform(people, lambda x: F.struct(x["own"], x["made"]))).alias("bare"))

    def stitched(text: Column, pattern: str, items: Column, swap: Callable[[Column], Column], rest: Callable[[Column], Column]) -> Column:
        """Text with what the pattern finds swapped, and ``rest`` of what is between."""
        between = F.split(text, pattern, -1)
        tail = F.transform(F.arrays_zip(items.alias("f"), F.slice(between, F.lit(2), F.size(items)).alias("b")), lambda x: F.concat(swap(x["f"]), rest(x["b"])))
        return F.concat(rest(F.element_at(between, 1)), F.array_join(tail, ""))

    words = lambda t: F.regexp_extract_all(t, F.lit(_BARE), F.lit(0))
    same = lambda t: t
    someone = F.size("bare") > 0
    alone = lambda t: F.when(someone, stitched(t, _BARE, words(t), lambda w: F.coalesce(F.element_at("bare", w), w), same)).otherwise(t)
    mentions = F.when(someone, F.aggregate(F.split("text", ANY, -1), F.lit(0), lambda n, t: n + F.size(F.filter(words(t), lambda w: F.map_contains_key("bare", w))))).otherwise(0)
    text = stitched(F.col("text"), ANY, F.col("found"), lambda v: F.element_at("to", v), alone)
    replaced = hits.join(pairs, "row").select("doc_id", text.alias("text"), (F.size("found") + mentions).alias("n_replaced"), "carried")
    return plain.unionByName(replaced).select("doc_id", "text", "n_replaced", *[F.col("carried")[c].alias(c) for c in carry or []])
