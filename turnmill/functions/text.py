"""Text expressions (X1-X22): word counts, phrase tests, amounts, dates, rounding. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def rounded(x: Column, k: int) -> Column:
    """Half away from zero in plain double steps, so that any engine with IEEE doubles agrees."""
    p = float(10**k)
    return F.when(x >= 0, F.floor(x * p + 0.5) / p).otherwise(-F.floor(-x * p + 0.5) / p)


def mean_of(x: Column, k: int) -> Column:
    """Mean of values that have k decimals, rounded to k. They are summed as whole units, so no order of rows moves a tie."""
    return rounded(F.sum(F.round(x * float(10**k)).cast("bigint")).cast("double") / F.count(x), 0) / float(10**k)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def has_any(lc: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lc, F.lit(p)) for p in phrases], F.lit(False))


def hits(lc: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur; presence, not occurrences."""
    return reduce(lambda a, b: a + b, [F.contains(lc, F.lit(p)).cast("int") for p in phrases], F.lit(0))


def matched(lc: Column, phrases: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(lc, p))


def categories(lc: Column, by_name: dict[str, Sequence[str]]) -> Column:
    return reduce(lambda a, b: a + b, [has_any(lc, ps).cast("int") for ps in by_name.values()], F.lit(0))


def amount_digits(amount: Column) -> Column:
    return F.regexp_replace(amount, "[^0-9.]", "")


def amount_in(lc: Column, amount: Column) -> Column:
    digits = amount_digits(amount)
    return (digits != "") & F.contains(F.replace(lc, F.lit(","), F.lit("")), digits)


def date_day(date: Column) -> Column:
    return F.regexp_extract(date, r"(\d+)", 1)


def date_month(date: Column) -> Column:
    return F.lower(F.regexp_extract(date, r"^([A-Za-z]+)", 1))


def date_in(lc: Column, date: Column) -> Column:
    day, month = date_day(date), date_month(date)
    return ((day != "") & F.contains(lc, day)) | ((month != "") & F.contains(lc, month))


def facts(lc: Column, merchant: Column, amount: Column, date: Column) -> Column:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return flag((merchant != "") & F.contains(lc, F.lower(merchant))) + flag(amount_in(lc, amount)) + flag(date_in(lc, date))


def amount_value(amount: Column) -> Column:
    return F.coalesce(F.regexp_replace(amount, "[,$]", "").try_cast("double"), F.lit(0.0))


def day_of_year(date: Column) -> Column:
    """"March 4" in a leap year; anything but a full month name and a whole number is 0."""
    parts = F.split(F.trim(date), r"\s+")
    month = F.coalesce(*[F.when(parts[0] == m, i) for i, m in enumerate(MONTHS, 1)])
    day = F.when(F.get(parts, F.lit(1)).rlike(r"^\d+$"), F.get(parts, F.lit(1)).try_cast("int"))
    ok = (F.size(parts) == 2) & month.isNotNull() & day.isNotNull() & (day > 0)
    return F.when(ok, F.dayofyear(F.make_date(F.lit(2024), month, F.least(day, F.lit(28))))).otherwise(0)


# The patterns of amounts and of month and day.
def first_amount(text: Column) -> Column:
    return F.regexp_extract(text, r"\$[\d,]+(?:\.\d{1,2})?", 0)


def first_month_day(lc: Column) -> Column:
    names = "|".join(m.lower() for m in MONTHS)
    pattern = rf"({names})\s+(\d{{1,2}})|(\d{{1,2}})\s+({names})"
    return F.concat(*[F.regexp_extract(lc, pattern, g) for g in (1, 2, 3, 4)])


# Fixed values.
STOPWORDS = ("you", "your", "that", "this", "the", "and", "are", "for", "from", "with", "have", "will", "can", "not", "any", "all", "they", "their", "when", "what", "just", "only")


def keywords(text: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)")), lambda w: (F.length(w) > 3) & ~w.isin(*stop))


def strip_eos(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)\s*<eos>\s*$", ""))


def clean_expected(text: Column) -> Column:
    return F.when(F.trim(text) == "<eos>", "").otherwise(F.trim(F.replace(text, F.lit("<eos>"), F.lit(""))))


def strip_speaker(text: Column, speaker: str) -> Column:
    return F.regexp_replace(text, rf"(?i)^{speaker}:\s*", "")


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a lambda inside body that mentions the bare expression would compute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def type_token_ratio(text: Column) -> Column:
    ratio = let(words(F.lower(text)), lambda w: F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w)))
    return F.coalesce(ratio, F.lit(0.0))


def ngrams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def trigram_ratio(text: Column) -> Column:
    """Distinct share of word trigrams; 1 for texts of under three words."""
    after = lambda w, i: F.slice(w, i + 1, F.greatest(F.size(w) - 2, F.lit(0)))
    grams = let(words(F.lower(text)), lambda w: F.transform(F.arrays_zip(after(w, 0), after(w, 1), after(w, 2)), lambda x: F.concat_ws(" ", x["0"], x["1"], x["2"])))
    return F.coalesce(let(grams, lambda g: F.try_divide(F.size(F.array_distinct(g)).cast("double"), F.size(g))), F.lit(1.0))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def money(v: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(v, 2))


def safe_key(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\w]", "_")


def to_double(text: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(fallback))


def to_bool(text: Column, true: Sequence[str] = ("true", "1", "yes")) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*true), F.lit(False))
