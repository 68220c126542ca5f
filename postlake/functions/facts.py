"""What a text says about places, skills, time zones, work models and experience, found in one walk.

The names of all dictionaries asked for form one trie with failure links (an Aho-Corasick automaton), which
passes over the lower-case text once, however many names there are. Every name found is tested for its own
boundaries. Patterns that no list of names can express, such as clauses about residency, run only on texts
that hold one of their words. Texts come in Arrow batches; each batch gives one struct per text, and
rules and scores read its fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, functions as F

from postlake.functions import geo, vocabulary as V
from postlake.functions.batches import in_text_batches

#: The fields of each kind of facts.
KINDS = {
    "countries": "countries array<string>",
    "regions": "regions array<string>",
    "skills": "skills array<string>",
    "zones": "zones array<string>, strict boolean",
    "residency": "residency array<string>",
    "model": "remote boolean, hybrid boolean, onsite boolean",
    "years": "low double, high double",
}
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_WORD = _LETTERS | frozenset("0123456789_")
#: Characters that mustn't stand before and after a name, by kind of boundary.
_BOUNDS = {"any": (frozenset(), frozenset()), "letters": (_LETTERS, _LETTERS), "word": (_WORD | {"."}, _WORD)}


def _compiled(pattern: str, flags: int = re.I | re.A) -> re.Pattern[str]:
    return re.compile(pattern, flags)


#: Patterns with the words of which a text must hold one.
_RESIDENCY = [(words, _compiled(p)) for words, p in zip((("must",), ("open", "accepting", "considering"), ("authori",), ("only",), ("citizenship",), ("clearance",)), V.RESIDENCY, strict=True)]
_MODEL = [(("remote", "home", "wfh", "distributed", "anywhere"), _compiled(V.REMOTE)), (("hybrid", "week"), _compiled(V.HYBRID)), (("site", "office", "relocat"), _compiled(V.ONSITE))]
_SPANS, _LEAST = (re.compile(p, re.I) for p in (V.EXPERIENCE, V.LEAST_EXPERIENCE))
_MARKER = re.compile(f"(?P<wished>{V.PREFERRED})|(?P<needed>{V.REQUIRED})", re.I)
_WEAKENED = re.compile(V.PREFERRED_AFTER, re.I)
_CONTEXT, _TIME, _STRICT = (re.compile(p, re.I) for p in (V.ZONE_IN_CONTEXT, V.TIME_WORDS, V.STRICT_WORDS))
_TIME_PARTS = ("time", "hours", "overlap")
_BREAK = re.compile(r"[.\n]")


def _holds(low: str, words: tuple[str, ...]) -> bool:
    return any(w in low for w in words)


def is_preferred(text: str, span: tuple[int, int]) -> bool:
    """Whether the requirement at this span is wished for, not required: by a qualifier right after it, or by the last marker in reach before it."""
    if _WEAKENED.match(text, span[1], span[1] + V.LOOK_AHEAD):
        return True
    kind = None
    for marker in _MARKER.finditer(text, max(0, span[0] - V.LOOK_BEHIND), span[0]):
        kind = marker.lastgroup
    return kind == "wished"


def required_years(text: str) -> tuple[float | None, float | None]:
    """Years that a text requires: of all required spans the one with the largest minimum, the first among equals."""
    best: tuple[float | None, float | None] = (None, None)
    for pattern in (_SPANS, _LEAST):
        for m in pattern.finditer(text):
            low, high = float(m[1]), float(m[2]) if m.lastindex == 2 and m[2] else None
            bad = low > V.MOST_YEARS or (high is not None and (high > V.MOST_YEARS or high < low))
            if not bad and (best[0] is None or low > best[0]) and not is_preferred(text, m.span()):
                best = low, high
    return best


class Walk:
    """The names of some dictionaries, and how a text's facts are made of those found."""

    def __init__(self, kinds: tuple[str, ...], gazetteer: geo.Gazetteer):
        self.kinds = kinds
        names: dict[str, list[tuple[str, str, str]]] = {}  # name: (kind, value, boundary)

        def add(name: str, *entry: str) -> None:
            names.setdefault(name, []).append(entry)

        self.countries = {a: c for c, aliases, _ in reversed(gazetteer) for a in (c, *aliases)}
        if "countries" in kinds:
            for alias, country in self.countries.items():
                add(alias, "countries", country, "letters")
            for city in geo.CITIES[1]:
                add(city, "countries", geo.CITIES[0], "any")
        if "regions" in kinds:
            for alias, region in V.REGIONS.items():
                add(alias, "regions", region, "letters")
        self.short: list[tuple[str, str, re.Pattern[str]]] = []  # names that count in their usual case only
        if "skills" in kinds:
            for skill, aliases in V.SKILLS.items():
                for alias in aliases:
                    if len(alias) > 2:
                        add(alias, "skills", skill, "word")
                    else:
                        name = "Go" if alias == "go" else alias.upper()
                        self.short.append((skill, name, _compiled(rf"(?<![\w.]){name}(?!\w)", re.A)))
        if "zones" in kinds:
            for phrase, zone in V.ZONE_PHRASES.items():
                add(phrase, "phrase", zone, "any")
            for name, zone in V.ZONES.items():
                add(name, "zone", zone, "any")
        self.trie = ahocorasick.Automaton()
        for name, entries in names.items():
            self.trie.add_word(name, (len(name), tuple((kind, value, *_BOUNDS[bound]) for kind, value, bound in entries)))
        if names:
            self.trie.make_automaton()
        self.codes = [(country, code, _compiled(f"(?<![A-Za-z]){code}(?![A-Za-z])", re.A)) for code, country in geo.CODES.items()]
        self.states = _compiled(rf",\s*(?:{'|'.join(geo.STATES[1])})\b", re.A)

    def found(self, low: str) -> dict[str, dict[str, list[tuple[int, int]]]]:
        """By kind and value, the spans of the names that stand between their boundaries."""
        out: dict[str, dict[str, list[tuple[int, int]]]] = {}
        if not len(self.trie):
            return out
        last = len(low) - 1
        for end, (size, entries) in self.trie.iter(low):
            start = end - size + 1
            before, after = low[start - 1] if start else "", low[end + 1] if end < last else ""
            for kind, value, no_before, no_after in entries:
                if before not in no_before and after not in no_after:
                    out.setdefault(kind, {}).setdefault(value, []).append((start, end + 1))
        return out

    def facts(self, text: str) -> dict[str, object]:
        low = text.lower()
        found = self.found(low)
        out: dict[str, object] = {}
        for kind in self.kinds:
            if kind == "zones":
                asked = zones_asked(text, low, found.get("phrase", {}), found.get("zone", {}))
                out["zones"], out["strict"] = sorted(asked), any(map(_STRICT.search, sum(asked.values(), [])))
            elif kind == "residency":
                out["residency"] = [self.country(m[1]) for words, p in _RESIDENCY if _holds(low, words) for m in p.finditer(text)]
            elif kind == "model":
                out |= {name: _holds(low, words) and p.search(text) is not None for name, (words, p) in zip(("remote", "hybrid", "onsite"), _MODEL, strict=True)}
            elif kind == "years":
                out["low"], out["high"] = required_years(text) if _holds(low, ("year", "yr")) else (None, None)
            elif kind == "skills":
                there = set(found.get(kind, ())) | {skill for skill, name, p in self.short if name in text and p.search(text)}
                out[kind] = [x for x in V.SKILLS if x in there]
            elif kind == "countries":
                there = set(found.get(kind, ())) | {country for country, code, p in self.codes if code in text and p.search(text)}
                out[kind] = sorted(there | ({geo.STATES[0]} if "," in text and self.states.search(text) else set()))
            else:
                out[kind] = sorted(found.get(kind, ()))
        return out

    def country(self, place: str) -> str | None:
        """The country that a place in a residency clause names, with and without dots."""
        t = place.strip(" ").lower().replace(" of america", "")
        return self.countries.get(t) or self.countries.get(t.replace(".", ""))


def _is_word(x: str) -> bool:
    return x.isalnum() or x == "_"


def zones_asked(text: str, low: str, phrases: dict[str, list[tuple[int, int]]], names: dict[str, list[tuple[int, int]]]) -> dict[str, list[str]]:
    """Time zones that a text asks for, each with the words near it.

    Phrases count anywhere, with what stands before their first place; names of zones count as words where words about time stand near in
    their clause. Only clauses that hold both are looked at.
    """
    out: dict[str, list[str]] = {}
    first: dict[str, tuple[int, int, str]] = {}
    for zone, spans in phrases.items():
        for start, end in spans:
            first.setdefault(low[start:end], (start, end, zone))
    for start, end, zone in sorted(first.values()):
        out.setdefault(zone, []).append(low[max(0, start - 60) : end])
    if not names or not _holds(low, _TIME_PARTS):
        return out
    if len(low) == len(text):
        clauses = {}
        for start, end in sorted(s for spans in names.values() for s in spans):
            if (start and _is_word(low[start - 1])) or (end < len(low) and _is_word(low[end])):
                continue
            begin = max(text.rfind(".", 0, start), text.rfind("\n", 0, start)) + 1
            if begin not in clauses:
                stop = _BREAK.search(text, end)
                clauses[begin] = text[begin : stop.start() if stop else len(text)]
        found = clauses.values()
    else:  # lower-casing moved the places
        found = _BREAK.split(text)
    for clause in found:
        if _holds(clause.lower(), _TIME_PARTS):
            for before, name, after in _CONTEXT.findall(clause):
                if _TIME.search(f"{before} {after}"):
                    out.setdefault(V.ZONES[name.lower()], []).append(f"{before} {after}")
    return out


def text_facts(text: Column, *kinds: str, gazetteer: geo.Gazetteer = geo.GAZETTEER) -> Column:
    """The facts of some ``KINDS`` as a struct of their fields; a null text says nothing.

    ``countries`` by alias between non-letters, code in capitals, state code after a comma or city anywhere; ``regions`` between
    non-letters; ``skills`` in vocabulary order, names of two letters in their usual case only; ``residency`` the countries of residency clauses,
    null where the place is unknown; ``years`` as required, not wished for.
    """
    fields = ", ".join(KINDS[k] for k in kinds)
    columns = [x.split()[0] for x in fields.split(", ")]

    def walked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        walk = Walk(kinds, gazetteer)
        for texts in batches:
            rows = [walk.facts(x or "") for x in texts]
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=float if c in ("low", "high") else object) for c in columns})

    udf: Callable[[Column], Column] = in_text_batches(F.pandas_udf(walked, fields))
    return udf(text)
