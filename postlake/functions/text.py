"""Normalisation of posting texts as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from postlake.functions import vocabulary as V
from postlake.functions.batches import in_text_batches


def lookup(table: dict[str, object], key: Column) -> Column:
    """``table[key]``, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def renamed(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(lookup(table, key), key)


def strip_chars(text: Column, chars: str) -> Column:
    inside = re.escape(chars)
    return F.regexp_replace(text, f"^[{inside}]+|[{inside}]+$", "")


def _accents() -> tuple[str, str]:
    """Latin letters of one base letter and accents, and their base letters, by the rule of compatibility decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(i))) > 1 and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", chr(i))[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case without accents, for Latin script; see :func:`fold_exact` for all of Unicode."""
    return F.lower(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}", ""))


@in_text_batches
@F.pandas_udf(T.StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """Lower case of the compatibility decomposition without combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())


def normalize_title(title: Column, folded: Column | None = None) -> Column:
    """Title in plain words: brackets, work models and punctuation gone, abbreviations spelt out."""
    t = F.regexp_replace(fold(title) if folded is None else folded, r"\([^)]*\)|\[[^\]]*\]", " ")
    t = F.regexp_replace(F.translate(t, "/,|", "   "), r"[^a-z0-9+#.\s-]", " ")
    words = F.transform(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), lambda w: strip_chars(w, ".-"))
    words = F.filter(words, lambda w: (w != "") & ~w.isin(*V.TITLE_DROPPED))
    return F.array_join(F.transform(words, lambda w: renamed(V.TITLE_WORDS, w)), " ")


def title_or_raw(title: Column) -> Column:
    """The normalised title, or the trimmed lower-case title where nothing is left of it."""
    found = normalize_title(title)
    return F.when(found != "", found).otherwise(F.lower(F.trim(title)))


def normalize_location(location: Column) -> Column:
    """Parts of a location under their usual names, each once, in order; null for blank ones."""
    t = strip_chars(F.regexp_replace(fold(location), r"\s+", " "), " ,;-")
    parts = F.filter(F.transform(F.split(t, r"[,;/|]"), lambda p: F.trim(p)), lambda p: p != "")
    joined = F.array_join(F.array_distinct(F.transform(parts, lambda p: renamed(V.PLACES, p))), ", ")
    return F.when(t == "", None).otherwise(F.coalesce(lookup(V.PLACES, t), joined))


def remote_policy(texts: list[Column], hint: Column) -> Column:
    """hybrid, remote, onsite or unknown, from free texts and a hint that may be null."""
    from postlake.functions.facts import text_facts

    # a struct of one row, so that the text is read once however often its flags are used
    said = F.array(F.struct(text_facts(F.concat_ws(" ", *[F.when(x != "", x) for x in texts]), "model").alias("m"), hint.alias("hint")))
    return F.transform(said, lambda x: _model_of(x.m, x.hint))[0]


def _model_of(said: Column, hint: Column) -> Column:
    remote = F.coalesce(hint, F.lit(False)) | said.remote
    return (
        F.when(said.hybrid, "hybrid").when(remote & ~said.onsite, "remote").when(said.onsite & ~remote, "onsite").when(remote & said.onsite, "hybrid").when(~hint, "onsite").otherwise("unknown")
    )


def seniority(title: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for level, pattern in V.SENIORITY:
        found = found.when(title.rlike("(?i)" + pattern), level)
    return found.otherwise("unknown")


def fingerprint(domain: Column, title: Column, location: Column) -> Column:
    """SHA-256 over registrable domain, normalised title and normalised location."""
    from postlake.functions.url import registrable_domain

    return F.sha2(F.concat_ws("|", registrable_domain(domain), title, F.coalesce(location, F.lit(""))), 256)


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys, no white space, and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def parse_datetime(text: Column) -> Column:
    """Timestamp of epoch seconds, epoch milliseconds (above 10^10) or ISO text; null if it's none of these."""
    number = text.try_cast("double")
    millis = F.when(number > 1e10, number).otherwise(number * 1000)
    return F.when(number.isNotNull(), F.timestamp_millis(millis.cast("long"))).otherwise(F.try_to_timestamp(F.nullif(F.trim(text), F.lit(""))))


def dig(json: Column, path: str) -> Column:
    """The text at a dotted path of JSON, list positions as numbers; null where it's missing."""
    parts = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(json, "$" + parts)


def normalize_skill(skill: Column) -> Column:
    names = {a: name for name, aliases in reversed(V.SKILLS.items()) for a in (name, *aliases)}
    t = F.lower(F.trim(skill))
    return renamed(names, t)


def _skill_patterns(compat: bool) -> list[tuple[str, str]]:
    """(skill, pattern) in order: longer names in any case, names of two letters in their usual case.

    ``compat`` leaves the alternatives ungrouped, so that boundaries hold for the first and the last only.
    """
    out = []
    for name, aliases in V.SKILLS.items():
        long = sorted((a for a in aliases if len(a) > 2), key=len, reverse=True)
        short = [a.upper() if a != "go" else "Go" for a in aliases if len(a) <= 2]
        for words, flags in ((long, "(?i)"), (short, "")):
            if words:
                joined = "|".join(re.escape(w) for w in words)
                out.append((name, f"{flags}(?<![\\w.]){joined if compat else f'(?:{joined})'}(?![\\w])"))
    return out


def extract_skills(text: Column, compat: bool = False) -> Column:
    """Skills named in a text, in vocabulary order. ``compat`` may name one twice and matches within words."""
    if compat:
        return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in _skill_patterns(compat)]))
    from postlake.functions.facts import text_facts

    return text_facts(text, "skills").skills


def csv_items(text: Column) -> Column:
    """Trimmed non-empty items of a comma-separated text, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def slug(text: Column) -> Column:
    return strip_chars(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "-")


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9][a-z0-9-]{1,62}$")


def trigrams(text: Column) -> Column:
    """The set of three-letter runs of a text's words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams among all of both; 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def snippet(text: Column, start: Column, end: Column, around: int = 40) -> Column:
    """Text from ``around`` characters before to as many after the 0-based span, white space collapsed."""
    low = F.greatest(F.lit(0), start - around)
    return F.trim(F.regexp_replace(F.substr(text, low + 1, F.least(F.length(text), end + around) - low), r"\s+", " "))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
