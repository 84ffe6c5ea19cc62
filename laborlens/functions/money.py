"""Salary parsing, currency conversion and salary display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlens import vocab

# every decimal digit of the Arabic blocks with its plain form
_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
_PLAIN_DIGITS = "01234567890123456789"


def salary_numbers(text: Column) -> Column:
    """All whole numbers above 100 in a salary text, thousands commas removed."""
    plain = F.translate(F.coalesce(text, F.lit("")), _ARABIC_DIGITS + ",", _PLAIN_DIGITS)
    runs = F.regexp_extract_all(plain, F.lit("([0-9]+)"), F.lit(1))
    return F.filter(F.transform(runs, lambda x: x.try_cast("double")), lambda x: x > 100)


def parse_salary(text: Column) -> Column:
    """struct(salary_min, salary_max): the first two numbers, or one and NULL."""
    numbers = salary_numbers(text)
    return F.struct(F.get(numbers, 0).alias("salary_min"), F.get(numbers, 1).alias("salary_max"))


def number_or_null(col: Column) -> Column:
    """Text or number to DOUBLE; NULL for blank, bad and NaN values."""
    return F.nanvl(F.trim(col.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def amount_pair(low: Column, high: Column) -> Column:
    """struct(salary_min, salary_max) of feed amounts: zero, blank and NaN are missing; one
    bad text voids both."""
    def text(col):
        return F.nullif(F.nullif(F.lower(F.trim(col.cast("string"))), F.lit("")), F.lit("nan"))

    texts = F.array(text(low), text(high))
    numbers = F.transform(texts, lambda x: x.try_cast("double"))
    # a text without number is one NULL more among the numbers
    sound = F.size(F.array_compact(texts)) == F.size(F.array_compact(numbers))
    kept = F.when(sound, F.transform(numbers, lambda x: F.nullif(x, F.lit(0.0))))
    return F.struct(F.get(kept, 0).alias("salary_min"), F.get(kept, 1).alias("salary_max"))


def in_pounds(country: Column) -> Column:
    return F.coalesce(F.lower(country).isin(*vocab.POUND_COUNTRIES), F.lit(False))


def report_usd(amount: Column, country: Column) -> Column:
    """Salary in dollars for reports: pounds times the fixed rate, all else unchanged."""
    return F.when(in_pounds(country), amount * vocab.POUND_TO_USD_REPORT).otherwise(amount)


def training_usd(amount: Column, canonical: Column) -> Column:
    return F.when(canonical == "United Kingdom",
                  amount / vocab.POUND_PER_USD_TRAINING).otherwise(amount)


def local_salary(min_usd: Column, max_usd: Column, canonical: Column,
                 scale: Column, rate: Column) -> Column:
    """struct(salary_min, salary_max, period) in local money: ordered, rounded, not negative."""
    monthly = canonical == vocab.MONTHLY_COUNTRY
    months = F.when(monthly, 12.0).otherwise(1.0)
    low, high = min_usd * scale * rate / months, max_usd * scale * rate / months

    def whole(col):
        return F.greatest(F.lit(0.0), F.bround(col, 0))

    return F.struct(whole(F.least(low, high)).alias("salary_min"),
                    whole(F.greatest(low, high)).alias("salary_max"),
                    F.when(monthly, "monthly").otherwise("annual").alias("period"))


def display_symbol(country: Column) -> Column:
    name = F.lower(F.coalesce(country, F.lit("")))
    rule = None
    for symbol, names in vocab.DISPLAY_SYMBOLS:
        rule = (F if rule is None else rule).when(name.isin(*names), symbol)
    return rule.otherwise(vocab.DISPLAY_SYMBOL_DEFAULT)


def _given(col: Column) -> Column:
    return F.when(col != 0, col)


def _range(low: Column, high: Column, symbol: Column) -> Column:
    def money(col):
        return F.concat(symbol, F.format_number(col, 0))
    return F.concat_ws("–", money(_given(low)), money(_given(high)))


def salary_label(country: Column, salary_min: Column, salary_max: Column,
                 predicted_min: Column, predicted_max: Column, period: Column) -> Column:
    """Shown salary: the real range, else the predicted one with its period, else a note."""
    symbol = display_symbol(country)
    unit = F.when(period == "monthly", "mo").otherwise("yr")
    return (F.when(_given(salary_min).isNotNull() | _given(salary_max).isNotNull(),
                   _range(salary_min, salary_max, symbol))
            .when(_given(predicted_min).isNotNull() | _given(predicted_max).isNotNull(),
                  F.concat(_range(predicted_min, predicted_max, symbol), F.lit("/"), unit,
                           F.lit(f" ({vocab.PREDICTED_LABEL})")))
            .otherwise(vocab.PREDICTED_LABEL))


def high_sort_key(predicted_max: Column, salary_max: Column) -> Column:
    return F.coalesce(_given(predicted_max), _given(salary_max), F.lit(0.0))


def low_sort_key(predicted_min: Column, salary_min: Column) -> Column:
    return F.coalesce(_given(predicted_min), _given(salary_min), F.lit(9_999_999.0))
