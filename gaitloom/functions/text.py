"""Text rules as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: ColumnOrName) -> Column:
    """Unicode white space runs become one blank, ends are trimmed, null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))


def clean_caption(x: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(squeeze(x), "(?i)" + X.CAPTION_PREFIX, ""))


def searchable(cleaned: Column) -> Column:
    """Whether a cleaned caption holds anything and isn't a refusal."""
    refused = F.lit(False)
    for pattern in X.REFUSALS:
        refused = refused | cleaned.rlike("(?i)" + pattern)
    return (F.length(cleaned) > 0) & ~refused


def searchable_captions(captions: ColumnOrName) -> Column:
    every = F.coalesce(_c(captions), F.array().cast("array<string>"))
    return F.filter(F.transform(every, clean_caption), searchable)


def without_take(x: ColumnOrName) -> Column:
    """Without the clip and take suffixes, however often they repeat."""
    return F.regexp_replace(_c(x), "(?i)(?:_clip[0-9]+|_[0-9]+)+$", "")


def motion_title(dataset: ColumnOrName, motion_id: ColumnOrName) -> Column:
    stem = without_take(F.regexp_replace(_c(motion_id), "^[^/]*/", ""))
    return F.when(F.lower(_c(dataset)) == X.TITLED_DATASET, squeeze(F.replace(stem, F.lit("_"), F.lit(" ")))).otherwise("")


def series_key(dataset: ColumnOrName, motion_id: ColumnOrName) -> Column:
    stem = F.regexp_replace(F.lower(without_take(motion_id)), "[^a-z0-9]+", " ")
    return F.when(F.lower(_c(dataset)) == X.TITLED_DATASET, F.trim(stem)).otherwise("")


def stem_description(stem: ColumnOrName) -> Column:
    """Readable text of a file stem."""
    spaced = F.regexp_replace(F.replace(_c(stem), F.lit("_"), F.lit(" ")), r"(?U)\s+([.,:;])", "$1")
    return squeeze(F.regexp_replace(spaced, "([-/])", " $1 "))


def has_han(x: ColumnOrName) -> Column:
    return _c(x).rlike("[\\u4e00-\\u9fff]")


def letters_only(x: ColumnOrName) -> Column:
    """Lower case without white space, punctuation and underscores; letters of any script stay."""
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)[\s\W_]+", "")


def match_key(x: ColumnOrName) -> Column:
    """Form in which ids and titles are compared with a query."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9\\u4e00-\\u9fff]+", " "))


def clauses(x: ColumnOrName) -> Column:
    """Clauses of a query; never empty."""
    parts = F.filter(F.split(_c(x), "(?i)" + X.CLAUSE_BREAK), lambda p: F.length(squeeze(p)) > 0)
    cleaned = F.transform(parts, lambda p: F.regexp_replace(squeeze(p), "(?i)" + X.CLAUSE_LEAD, ""))
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(F.array(F.trim(_c(x))))


def tokens(x: ColumnOrName) -> Column:
    """Search tokens of a text, in order."""
    table = ", ".join(f"named_struct('alias', '{a}', 'n', {len(a)}, 'tokens', array({', '.join(repr(t) for t in toks)}))" for a, toks in X.HAN_ALIASES)
    aliases = {a: b for a, b in X.TOKEN_ALIASES.items() if a != b}
    words = ", ".join(repr(a) for a in aliases)
    told = f"element_at(map({', '.join(f'{a!r}, {b!r}' for a, b in aliases.items())}), w)"
    stops = f"array({', '.join(map(repr, X.STOP_WORDS))})"
    stem = (
        "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN concat(left(w, length(w) - 3), 'y') WHEN length(w) > 4 AND w LIKE '%ing' THEN left(w, length(w) - 3) "
        "WHEN length(w) > 3 AND w LIKE '%ed' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
    )
    fold = f"""aggregate(filter(array({table}), h -> contains(w, h.alias)),
      named_struct('spans', filter(array(named_struct('a', 0, 'b', 0)), z -> false), 'tokens', filter(array(''), z -> false)),
      (acc, h) -> IF(exists(acc.spans, s -> greatest(s.a, locate(h.alias, w)) < least(s.b, locate(h.alias, w) + h.n)), acc,
        named_struct('spans', array_append(acc.spans, named_struct('a', locate(h.alias, w), 'b', locate(h.alias, w) + h.n)), 'tokens', array_union(acc.tokens, h.tokens))),
      acc -> acc.tokens)"""
    one = f"""CASE WHEN w IN ({words}) THEN split({told}, ' ')
      WHEN w RLIKE '[\\\\u4e00-\\\\u9fff]' AND ({stem}) = w THEN IF(size({fold}) > 0, {fold}, array(w))
      ELSE array({stem}) END"""
    raw = F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[A-Za-z0-9\\u4e00-\\u9fff]+"), 0)
    kept = F.expr(f"t -> NOT array_contains({stops}, t) AND length(t) > 0")
    return F.call_function("filter", F.flatten(F.call_function("transform", raw, F.expr(f"w -> {one}"))), kept)


def search_text(x: ColumnOrName) -> Column:
    """What a lexical search is given: a Han query as its alias tokens, or as it is where it has none; any other as it is."""
    told = F.array_join(tokens(x), " ")
    return F.when(has_han(x) & (told != ""), told).otherwise(_c(x))


def taxonomy_tokens(x: ColumnOrName) -> Column:
    """Tokens of the rule classifier: another pattern and another stemmer than the search's."""
    one = (
        "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN concat(left(w, length(w) - 3), 'y') WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, length(w) - 3) "
        "WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) "
        "WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
    )
    return F.call_function("transform", taxonomy_words(x), F.expr(f"w -> {one}"))


def taxonomy_words(x: ColumnOrName) -> Column:
    raw = F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9]+(?:[-'][a-z0-9]+)?"), 0)
    return F.transform(raw, lambda w: F.replace(w, F.lit("-"), F.lit(" ")))
