"""Search over postings: filters, full text, similarity, order and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions.stems import stem, stems
from postlake.functions.text import trigram_similarity, trigrams

#: The English words that don't count in full-text search.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
    """.split()
)
SIMILAR = 0.3


def words(text: Column) -> Column:
    """Words of a text without stop words, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*sorted(STOP_WORDS)))


def tokens(text: Column) -> Column:
    """Stemmed words of a text without stop words, in order."""
    return stems(words(text))


@dataclass(frozen=True)
class Term:
    """A word or a phrase of a web search, as stems."""

    stems: tuple[str, ...]
    unwanted: bool = False


def web_search(query: str) -> list[list[Term]]:
    """Groups of terms, of each of which one must match: "phrases" in a row, ``or`` between terms, ``-`` before unwanted ones."""
    groups: list[list[Term]] = []
    either = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not phrase and word.lower() == "or" and not minus:
            either = bool(groups)
            continue
        parts = [p for p in re.split("[^a-z0-9]+", (phrase or word).lower()) if p and p not in STOP_WORDS]
        if not parts:
            continue
        term = Term(tuple(stem(p) for p in parts), bool(minus))
        if either:
            groups[-1].append(term)
        else:
            groups.append([term])
        either = False
    return groups


def matches(words: Column, query: str) -> Column:
    """Whether tokens match a web search, see :func:`web_search`; a search without a word matches nothing."""

    def holds(term: Term) -> Column:
        run = " ".join(term.stems)
        one = F.array_contains(words, run) if len(term.stems) == 1 else F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {run} ")
        return ~one if term.unwanted else one

    groups = [reduce(lambda a, b: a | b, map(holds, group)) for group in web_search(query)]
    return reduce(lambda a, b: a & b, groups, F.lit(bool(groups)))


@dataclass(frozen=True)
class JobFilters:
    """What to search for; what's None doesn't filter."""

    q: str | None = None
    eligibility: str | None = None
    remote_policy: str | None = None
    seniority: str | None = None
    source_id: str | None = None
    min_score: float | None = None
    include_closed: bool = False
    include_duplicates: bool = False
    published_after: object = None


def conditions(f: JobFilters, searched: bool = False) -> Column:
    """The conjunction of what's set. Status defaults to pending; an unknown score fails a least score. ``searched`` leaves the text to an index."""
    found = [F.lit(True)]
    if f.q is not None and not searched:
        found.append(matches(tokens(F.concat_ws(" ", "title", "description")), f.q) | (trigram_similarity(trigrams(F.col("title")), trigrams(F.lit(f.q))) >= SIMILAR))
    for name in ("remote_policy", "seniority", "source_id"):
        if (value := getattr(f, name)) is not None:
            found.append(F.col(name) == value)
    if f.eligibility is not None:
        found.append(F.coalesce("status", F.lit("pending")) == f.eligibility)
    if f.min_score is not None:
        found.append(F.col("score") >= f.min_score)
    if f.published_after is not None:
        found.append(F.col("published_at") >= F.lit(f.published_after))
    if not f.include_closed:
        found.append(F.col("closed_at").isNull())
    if not f.include_duplicates:
        found.append(F.col("duplicate_of").isNull())
    return reduce(lambda a, b: a & b, found)


ORDERS = {
    "score": [F.desc_nulls_last, "score", "published_at"],
    "published": [F.desc_nulls_last, "published_at"],
    "first_seen": [F.desc, "first_seen_at"],
}


def search(postings: DataFrame, subscriptions: DataFrame, profile_jobs: DataFrame, filters: JobFilters, found: DataFrame | None = None) -> DataFrame:
    """Postings of followed sources with the profile's status and score, filtered.

    ``found`` (job_id) are the postings that an index found for ``filters.q``; without it their texts are read.
    """
    visible = postings.join(subscriptions.select("source_id").distinct(), "source_id", "left_semi")
    if found is not None:
        visible = visible.join(found.select("job_id"), "job_id", "left_semi")
    return visible.join(profile_jobs.select("job_id", "status", "score"), "job_id", "left").where(conditions(filters, found is not None))


def ordered(df: DataFrame, by: str = "score") -> DataFrame:
    """Sorted by score, publication or first sight, the latest id first among equals."""
    direction, *names = ORDERS[by]
    return df.orderBy(*[direction(n) for n in names], F.desc("job_id"))


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    if not (1 <= limit <= 100 and 0 <= offset <= 100_000):
        raise ValueError("limit must be 1 to 100 and offset at most 100000")
    return df.offset(offset).limit(limit)
