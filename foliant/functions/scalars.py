"""Scalar functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (trim takes spaces only)."""
    return F.regexp_replace(c, ENDS, "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def safe_int(c: Column, default: int = 0) -> Column:
    """An integer, or default for what isn't one ('12.0' and '1_000' aren't)."""
    return F.coalesce(F.expr("cast(null as int)") if c is None else c.cast("string").try_cast("int"), F.lit(default))


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(float(default)))


def number_or_null(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def lower_text(c: Column) -> Column:
    return F.lower(text_or_empty(c))


def joined_names(structs: Column, field: str = "name") -> Column:
    return F.array_join(F.filter(F.transform(structs, lambda s: s[field]), lambda n: n != ""), ",")


def first_field(structs: Column, field: str) -> Column:
    return F.coalesce(F.get(structs, F.lit(0))[field], F.lit(""))


def word_count(c: Column) -> Column:
    s = text_or_empty(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+")))


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def latin_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def letter_tokens(c: Column) -> Column:
    return F.size(F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w.rlike(r"\p{L}")))


def reads_latin(c: Column, least_chars: int = 20, least_letters: int = 15, least_share: float = 0.85, least_tokens: int = 5) -> Column:
    """The strict text gate: long enough, with letters enough, Latin enough, with words enough."""
    t = text_or_empty(c)
    return (F.length(t) >= least_chars) & (letters(t) >= least_letters) & (latin_letters(t) >= letters(t) * F.lit(least_share)) & (letter_tokens(t) >= least_tokens)


def rating_bucket(rating: Column) -> Column:
    return F.when(rating.isin(1, 2), "negative").when(rating == 3, "neutral").when(rating.isin(4, 5), "positive").otherwise(F.raise_error(F.concat(F.lit("not a rating from 1 to 5: "), F.coalesce(rating.cast("string"), F.lit("null")))))


def percent_text(part: Column, whole: Column) -> Column:
    """Whole per cents as such, else one decimal (halves up)."""
    tenths = F.floor(part * 1000 / whole + 0.5).cast("long")
    return F.when(part * 100 % whole == 0, F.concat((part * 100 / whole).cast("long").cast("string"), F.lit("%"))).otherwise(F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))


def distribution_text(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    parts = [F.concat(F.lit(f"{i}★ "), percent_text(c, total)) for i, c in enumerate(counts, 1)]
    return F.when(total > 0, F.concat(F.lit("Rating distribution: "), F.concat_ws(", ", *parts))).otherwise(F.raise_error(F.lit("no ratings")))


def search_text(title: Column, description: Column, shelves: Column) -> Column:
    return strip(F.concat(lower_text(title), F.lit(" "), lower_text(description), F.lit(" "), lower_text(shelves)))


def stars(rating: Column) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(rating).cast("int")))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def worth_showing(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return c.isNotNull() & ~s.isin("", "0", "0.0", "NaN")


def initials(title: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(title, "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def real_cover(url: Column, placeholder_host: str) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return (F.trim(u) != "") & ~F.contains(u, F.lit("nophoto")) & ~F.contains(u, F.lit(placeholder_host))


def preview(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def percent_score(score: Column) -> Column:
    return F.when(score <= 1, score * 100).otherwise(score)


def whole_percent(score: Column) -> Column:
    """A score as a whole number of 100, halves to even; none counts as 0."""
    return F.bround(percent_score(F.coalesce(score.cast("double"), F.lit(0.0)))).cast("long").cast("string")


def match_text(similarity: Column) -> Column:
    """A share as whole per cents, halves to even; null without one."""
    s = similarity.cast("double")
    return F.when(s.isNotNull() & ~F.isnan(s), F.concat(F.bround(s * 100).cast("long").cast("string"), F.lit("%")))


def has_isbn(c: Column) -> Column:
    """Neither null nor empty nor the text None."""
    return F.coalesce(~c.isin("", "None"), F.lit(False))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tag_list(c: Column) -> Column:
    """Tags of a list in JSON or with single quotes, as Python shows one, or of one plain text; blank ones dropped."""
    parsed = F.from_json(c, "array<string>")
    raw = F.when(parsed.isNotNull(), parsed).when(text_or_empty(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: t != "")


def title_case(token: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(token, "-"), lambda p: p != ""), lambda p: F.initcap(p)), " ")
