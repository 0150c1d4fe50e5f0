"""Scalar functions of the retrieval and health analytics, as JVM-side column expressions.

Survey ids: SF1-SF5, SF7-SF16, SF21, SF24. Each returns a Column; null in gives null out unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of symbol kinds.
KIND_WEIGHTS = {"interface": 3.0, "type": 3.0, "enum": 3.0, "class": 1.5, "struct": 1.5, "trait": 1.5, "function": 1.0, "method": 0.5, "impl": 0.5}
# Patterns of the status of a journal entry, in order of precedence.
DEAD_END = r"(?i)\b(dead[ -]end|failed|abandoned|doesn't work|gave up)\b"
CONFIRMED = r"(?i)\b(confirmed|verified|validated)\b"
# Words and patterns of a query that wants exact places.
EXACT_HINTS = ["exact", "file path", "filepath", "function", "method", "where defined", "line", "symbol", "entrypoint"]
EXACT_FILE = r"\b[\w./-]+\.(ts|tsx|js|jsx|mjs|cjs|json|md|toml|yaml|yml|sql)\b"
EXACT_QUOTED = r"`([^`]{2,120})`"
# Patterns of a query about paths and chains.
DEEP_PATTERNS = [
    r"\b(call graph|call chain|callchain|multi[- ]hop|upstream|downstream|end[- ]to[- ]end|e2e)\b",
    r"\b(path|chain|through|across|between|bridge|flow)\b",
    r"\b(how|why)\b[\s\S]{0,80}\b(from|to|reach|lead|propagate)\b",
]


_SPACE = r"[\s\x0B\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with word boundaries between ASCII word characters and all others, whatever the JVM's version takes for them."""
    return pattern.replace(r"\b", _EDGE)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def camel_terms(text: Column | str) -> Column:
    """SF1: each term, and behind a term of several parts its parts in small letters; no term twice."""
    terms = F.filter(F.split(_c(text), r"\s+"), lambda t: t != "")
    parts = lambda t: F.filter(F.split(F.regexp_replace(t, "([A-Z])", " $1"), " "), lambda p: p != "")
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.when(F.size(parts(t)) > 1, F.transform(parts(t), F.lower)).otherwise(F.array().cast("array<string>"))))))


def expand_camel(text: Column | str) -> Column:
    return F.array_join(camel_terms(text), " ")


def fts_query(text: Column | str) -> Column:
    """SF2: quoted terms joined by OR; nothing to look for gives a pair of quotes."""
    clean = F.filter(F.split(F.regexp_replace(expand_camel(text), r"[^A-Za-z0-9_\s-]", " "), r"\s+"), lambda t: t != "")
    return F.when(F.size(clean) == 0, F.lit('""')).otherwise(F.array_join(F.transform(clean, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def query_terms(text: Column | str) -> Column:
    """The index terms of a query: expanded, in small letters, split at all but letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(expand_camel(text)), "[^a-z0-9]+"), lambda t: t != ""))


def normalize_tag(tag: Column | str) -> Column:
    return F.lower(F.trim(_c(tag)))


def slug(name: Column | str) -> Column:
    """SF4: small letters and digits, anything else one hyphen, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def journal_status(text: Column | str) -> Column:
    """SF5."""
    t = _c(text)
    return F.when(t.rlike(ascii_edges(DEAD_END)), "dead-end").when(F.rtrim(F.regexp_replace(t, r"\s+$", "")).endswith("?"), "question").when(t.rlike(ascii_edges(CONFIRMED)), "confirmed").otherwise("finding")


def is_deep_query(text: Column | str) -> Column:
    """SF6."""
    t = F.lower(_c(text))
    return t.rlike(ascii_edges("|".join(DEEP_PATTERNS)))


def wants_exact(text: Column | str) -> Column:
    """SF7."""
    t, out = _c(text), F.lit(False)
    for hint in EXACT_HINTS:
        out = out | F.lower(t).contains(hint)
    return out | t.rlike(ascii_edges(EXACT_FILE)) | t.rlike(EXACT_QUOTED)


def compact(text: Column | str, most: int) -> Column:
    """SF8: white space collapsed; longer than most: cut to most characters with an ellipsis as the last."""
    t = F.trim(F.regexp_replace(_c(text), _SPACE, " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def directory(path: Column | str) -> Column:
    """SF11: the first two segments, the first of a path of at most two."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) <= 2, parts[0]).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))


def depth(path: Column | str) -> Column:
    return F.size(F.split(_c(path), "/"))


def kind_weight(kind: Column | str) -> Column:
    """SF12: other kinds and null weigh 1."""
    table = F.create_map(*[F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv])
    return F.coalesce(table[_c(kind)], F.lit(1.0))


def name_variants(name: Column | str) -> Column:
    """SF13: the name and its last part."""
    return F.array_distinct(F.array(_c(name), F.element_at(F.split(_c(name), "[:.#]"), -1)))


def token_estimate(text: Column | str) -> Column:
    """SF14: a quarter of the characters, rounded up."""
    return F.ceil(F.length(_c(text)) / 4).cast("int")


def body_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def lines_between(text: Column | str, first: Column | str, last: Column | str) -> Column:
    """SC7: lines first to last, counted from 1, both included, clamped to the text; null if none is left."""
    all_ = F.split(_c(text), "\n")
    a, b = F.greatest(_c(first), F.lit(1)), F.least(_c(last), F.size(all_))
    return F.when(b >= a, F.array_join(F.slice(all_, a, b - a + 1), "\n"))


def excerpts(content: Column | str, query: Column | str, most: int = 3, separator: str = r"\n\n+") -> Column:
    """SF10: the paragraphs with the most words (longer than two letters) of the query, in their own order.

    Paragraphs without any are left out; among equals the earlier wins.
    """
    wanted = F.array_distinct(F.filter(F.split(F.lower(_c(query)), r"\s+"), lambda w: F.length(w) > 2))
    paras = F.filter(F.transform(F.split(_c(content), separator), lambda p: F.trim(p)), lambda p: p != "")
    scored = F.transform(paras, lambda p, i: F.struct((-F.size(F.filter(wanted, lambda w: F.contains(F.lower(p), w)))).alias("minus"), i.alias("i"), p.alias("p")))
    top = F.slice(F.array_sort(F.filter(scored, lambda s: s["minus"] < 0)), 1, most)
    return F.transform(F.array_sort(F.transform(top, lambda s: F.struct(s["i"].alias("i"), s["p"].alias("p")))), lambda s: s["p"])


def attributions(narrative: Column | str) -> Column:
    """SF16: the names in [[a, b]] of a text."""
    inner = F.regexp_extract_all(_c(narrative), F.lit(r"\[\[([^\]]+)\]\]"), 1)
    return F.array_distinct(F.filter(F.flatten(F.transform(inner, lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x)))), lambda s: s != ""))


def clamp(c: Column | str, high: float = 1.0) -> Column:
    """SF21: between 0 and high; null and what is not finite give 0."""
    c = _c(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(high), c)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """SF24: 0 if one of the vectors is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """SF24: 1 if one of the vectors is zero."""
    return 1.0 - cosine(a, b)
