"""Rules that label a posting from its text: work mode, contract, seniority, country."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions.text import WORD, contains_any, whole_word

REMOTE_WORDS = ("remote",)
BOARD_REMOTE_WORDS = ("remote", "work from home", "wfh")

# ordered: the first level that matches wins
SENIORITY_RULES = (
    ("lead", whole_word("lead|head of|principal|director|manager|executive|chief")),
    ("senior", whole_word("senior|sr|lead|staff|architect|principal")),
    # a plus sign counts only when a word character follows it
    ("mid", whole_word(r"mid(?:[-\s]level)?|intermediate|experienced")
     + rf"|(?<!{WORD})[345]\+(?={WORD})"),
    ("junior", whole_word(r"junior|jr|entry\s?level|graduate|fresh|intern|0-2|0-1")),
)
# one of these is a part of every match, so most texts need no pattern
SENIORITY_PARTS = {
    "lead": ("lead", "head of", "principal", "director", "manager", "executive", "chief"),
    "senior": ("senior", "sr", "lead", "staff", "architect", "principal"),
    "mid": ("mid", "intermediate", "experienced", "3+", "4+", "5+"),
    "junior": ("junior", "jr", "entry", "graduate", "fresh", "intern", "0-2", "0-1"),
}
COARSE_SENIOR = ("senior", "lead", "principal", "staff", "head of")
COARSE_JUNIOR = ("junior", "entry", "graduate", "fresh", "intern")


def _joined(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def work_mode(title: Column, description: Column) -> Column:
    """remote > hybrid > onsite from title and description."""
    return _mode(_joined(title, description), REMOTE_WORDS)


def board_work_mode(text: Column) -> Column:
    """As ``work_mode`` over one text, also knowing 'work from home' and 'wfh'."""
    return _mode(_joined(text), BOARD_REMOTE_WORDS)


def _mode(text: Column, remote_words) -> Column:
    return (F.when(contains_any(text, remote_words), "remote")
            .when(text.contains("hybrid"), "hybrid").otherwise("onsite"))


def feed_work_mode(job_type: Column, title: Column) -> Column:
    """'remote' in type or title, 'hybrid' in the type only."""
    kind, name = _joined(job_type), _joined(title)
    return (F.when(kind.contains("remote") | name.contains("remote"), "remote")
            .when(kind.contains("hybrid"), "hybrid").otherwise("onsite"))


def board_contract(text: Column) -> Column:
    t = _joined(text)
    return (F.when(t.contains("intern"), "internship")
            .when(contains_any(t, ("part time", "part-time")), "part-time")
            .when(contains_any(t, ("freelance", "contract")), "contract")
            .otherwise("full-time"))


def feed_contract(job_type: Column, title: Column) -> Column:
    kind, name = _joined(job_type), _joined(title)
    return (F.when(kind.contains("internship") | name.contains("intern"), "internship")
            .when(kind.contains("part"), "part-time")
            .when(kind.contains("contract"), "contract").otherwise("full-time"))


def seniority(title: Column, description: Column) -> Column:
    """lead, senior, mid, junior in this order of precedence; 'mid' when nothing matches."""
    text = _joined(title, description)
    rule = None
    for level, pattern in SENIORITY_RULES:
        rule = (F if rule is None else rule).when(contains_any(text, SENIORITY_PARTS[level]) & text.rlike(pattern), level)
    return rule.otherwise("mid")


def fill_seniority(current: Column, title: Column, description: Column) -> Column:
    """Label only rows that have no level yet."""
    return F.when(current.isNull(), seniority(title, description)).otherwise(current)


def coarse_seniority(title: Column, description: Column) -> Column:
    """Three levels by plain substrings."""
    text = _joined(title, description)
    return (F.when(contains_any(text, COARSE_SENIOR), "senior")
            .when(contains_any(text, COARSE_JUNIOR), "junior").otherwise("mid"))


def canonical_country(country: Column) -> Column:
    name = F.lower(F.trim(country))
    rule = F.when(F.coalesce(country, F.lit("")) == "", vocab.DEFAULT_COUNTRY)
    for canonical, parts, codes in vocab.COUNTRY_RULES:
        rule = rule.when(contains_any(name, parts) | name.isin(*codes), canonical)
    return rule.otherwise(vocab.DEFAULT_COUNTRY)


def country_of_location(location: Column) -> Column:
    """The part after the last comma, trimmed."""
    return F.trim(F.element_at(F.split(location, ","), -1))


def last_word(col: Column) -> Column:
    return F.element_at(F.split(F.trim(col), r"\s+"), -1)


def has_remote(job_type: Column) -> Column:
    return F.when(job_type.isin("remote", "hybrid"), 1).otherwise(0)


def is_internship(contract_type: Column) -> Column:
    return F.when(contract_type == "internship", 1).otherwise(0)


def is_us(country: Column) -> Column:
    return F.when(canonical_country(country) == "United States", 1).otherwise(0)
