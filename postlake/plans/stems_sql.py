"""English stems in SQL, for oracles: the published Porter2 rules as regular expressions, apart from the library's own stemmer."""

from __future__ import annotations

# Suffixes of the published rules, longest first, and what replaces them.
_STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP_4 = "ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic"
_SPECIAL = "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _longest(x: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{s}') THEN '{s}'" for s, _ in rules) + " ELSE '' END"


def _swap(x: str, rules: list[tuple[str, str]]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in rules) + " END"


def stems_sql(words: str) -> str:
    """Common table expressions that end in ``stems(word, stem)``, of the distinct words of the table ``words(word)``."""
    special = " ".join("WHEN '{}' THEN '{}'".format(*x.split(":")) for x in _SPECIAL.split())
    region = "regexp_extract({}, '^.*?[aeiouy][^aeiouy]')"
    return f"""
  w0 AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g'), '(Y)y', '\\1Y', 'g') AS w, CASE word {special} WHEN '' THEN '' END AS known FROM (SELECT DISTINCT word FROM {words})),
  w1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN {region.format('w')} <> '' THEN length({region.format('w')}) ELSE length(w) END AS r1 FROM w0),
  w2 AS (SELECT *, r1 + CASE WHEN {region.format('substring(w, r1 + 1)')} <> '' THEN length({region.format('substring(w, r1 + 1)')}) ELSE length(w) - r1 END AS r2 FROM w1),
  w3 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN w[:-3] WHEN w SIMILAR TO '.*(ied|ies)' THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
    WHEN ends_with(w, 's') AND NOT w SIMILAR TO '.*(us|ss)' AND regexp_matches(w[:-3], '[aeiouy]') THEN w[:-2] ELSE w END AS w) FROM w2),
  w4 AS (SELECT *, w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS done, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS s FROM w3),
  w5 AS (SELECT *, substring(w, 1, length(w) - length(s)) AS b FROM w4),
  w6 AS (SELECT * REPLACE (CASE WHEN done OR s = '' THEN w WHEN starts_with(s, 'ee') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '[aeiouy]') THEN w
    WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN b[:-2] WHEN length(b) <= r1 AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END AS w) FROM w5),
  w7 AS (SELECT * REPLACE (CASE WHEN NOT done AND length(w) > 2 THEN regexp_replace(w, '([^aeiouy])[yY]$', '\\1i') ELSE w END AS w) FROM w6),
  w8 AS (SELECT * REPLACE ({_longest('w', _STEP_2)} AS s) FROM w7),
  w9 AS (SELECT * REPLACE (CASE WHEN done OR s = '' OR length(w) - length(s) < r1 OR (s = 'ogi' AND NOT ends_with(w, 'logi')) OR (s = 'li' AND NOT regexp_matches(w, '[cdeghkmnrt]li$')) THEN w
    ELSE substring(w, 1, length(w) - length(s)) || {_swap('s', _STEP_2)} END AS w) FROM w8),
  w10 AS (SELECT * REPLACE ({_longest('w', _STEP_3)} AS s) FROM w9),
  w11 AS (SELECT * REPLACE (CASE WHEN done OR s = '' OR length(w) - length(s) < r1 OR (s = 'ative' AND length(w) - length(s) < r2) THEN w ELSE substring(w, 1, length(w) - length(s)) || {_swap('s', _STEP_3)} END AS w) FROM w10),
  w12 AS (SELECT * REPLACE (regexp_extract(w, '({_STEP_4})$') AS s) FROM w11),
  w13 AS (SELECT * REPLACE (CASE WHEN done OR s = '' OR length(w) - length(s) < r2 OR (s = 'ion' AND NOT regexp_matches(w, '[st]ion$')) THEN w ELSE substring(w, 1, length(w) - length(s)) END AS w) FROM w12),
  w14 AS (SELECT * REPLACE (CASE WHEN done THEN w WHEN ends_with(w, 'e') AND (length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(w[:-2], '{_SHORT}'))) THEN w[:-2] WHEN ends_with(w, 'll') AND length(w) > r2 THEN w[:-2] ELSE w END AS w) FROM w13),
  stems AS MATERIALIZED (SELECT word, CASE WHEN known IS NOT NULL THEN known WHEN length(word) <= 2 THEN word ELSE lower(w) END AS stem FROM w14)"""
