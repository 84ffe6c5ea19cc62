"""Identifiers, ages, tiers, documents and metadata defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlens import vocab


def source_id(site: str, url: Column, *fallback: Column) -> Column:
    """Site plus twelve hex digits of the name-based UUID of the URL.

    A posting without URL gets the digest of its other fields instead of a random one, so
    a second pull of the same row is recognised.
    """
    missing = F.coalesce(url, F.lit("")) == ""
    other = F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in fallback])
    name = F.when(missing, other).otherwise(url)
    digest = F.sha1(F.concat(F.unhex(F.lit(vocab.URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    return F.concat(F.lit(f"{site}_"), F.substring(digest, 1, 12))


def event_time(posted_at: Column, scraped_at: Column) -> Column:
    return F.coalesce(posted_at, scraped_at)


def parse_time(text: Column) -> Column:
    """Text time to zone-free UTC; NULL for bad text. Text without a zone is taken as UTC."""
    instant = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone())
    return (F.when(text.rlike(r"\d(?:Z|[+-]\d{2}:?\d{2})$") & text.contains(":"),
                   instant.cast("timestamp_ntz"))
            .otherwise(text.try_cast("timestamp_ntz")))


def age_days(day_text: Column, as_of: Column) -> Column:
    """Whole days since the date in the first ten characters, never negative; NULL if bad."""
    text = F.substring(day_text, 1, 10)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    return F.greatest(F.datediff(as_of, day), F.lit(0) + F.when(day.isNotNull(), 0))


def age_label(day_text: Column, as_of: Column, lang: str = "en") -> Column:
    days = age_days(day_text, as_of)
    number = days.cast("string")
    if lang == "ar":
        label = (F.when(days == 0, "النهاردة").when(days == 1, "إمبارح")
                 .when(days == 2, "من يومين")
                 .when(days <= 10, F.concat(F.lit("من "), number, F.lit(" أيام")))
                 .when(days > 10, F.concat(F.lit("من "), number, F.lit(" يوم"))))
    else:
        label = (F.when(days == 0, "today").when(days == 1, "yesterday")
                 .when(days > 1, F.concat(number, F.lit(" days ago"))))
    return F.coalesce(label, F.lit(""))


def match_tier(score: Column) -> Column:
    """Tier of a match score in 0..1 by its whole percentage."""
    pct = F.floor(score * 100)
    return F.when(pct >= 70, "high").when(pct >= 40, "medium").otherwise("low")


def resume_tier(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "mid").otherwise("low")


def similarity(distance: Column, places: int = 3) -> Column:
    return F.round(1 - distance, places)


def or_default(col: Column, default: str) -> Column:
    """The value, or the default for NULL and ''."""
    return F.when(col != "", col).otherwise(default)


def posting_meta(country: Column, job_type: Column, seniority: Column, contract_type: Column):
    return F.struct(or_default(country, "unknown").alias("country"),
                    or_default(job_type, "onsite").alias("job_type"),
                    or_default(seniority, "mid").alias("seniority"),
                    or_default(contract_type, "full-time").alias("contract_type"))


def salary_text(low: Column, high: Column) -> Column:
    def pounds(col):
        return F.concat(F.lit("£"), F.format_string("%.0f", F.bround(col, 0)))
    upper = F.when((high != 0) & (high != low), F.concat(F.lit(" - "), pounds(high)))
    return (F.when(low != 0, F.concat(pounds(low), F.coalesce(upper, F.lit(""))))
            .otherwise("Not specified"))


def posting_document(title, company, location, country, job_type, contract_type, seniority,
                     salary_min, salary_max, skills, description) -> Column:
    """Nine labelled lines describing a posting; NULL shows as the field's default."""
    def shown(col, default):
        return F.coalesce(col, F.lit(default))
    place = F.concat(shown(location, "Unknown"), F.lit(", "), shown(country, "Unknown"))
    lines = (
        ("Title", shown(title, "")),
        ("Company", shown(company, "Unknown")),
        ("Location", place),
        ("Workplace Type", shown(job_type, "onsite")),
        ("Contract Type", shown(contract_type, "full-time")),
        ("Seniority", shown(seniority, "mid")),
        ("Salary Range", salary_text(salary_min, salary_max)),
        ("Required Skills", shown(skills, "None")),
        ("Description", shown(description, "")),
    )
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])
