"""Driver-side helpers of requests: lenient numbers and booleans, clauses and encoder texts."""

from __future__ import annotations

import re

from .lexicon import CLAUSE_BREAK, CLAUSE_LEAD, has_han, query_tokens


def clamp(value, default, *, minimum=0, maximum=None, kind=int):
    """Number of a lenient text, within bounds; the default where it is none."""
    try:
        number = kind(str(value).strip())
    except (TypeError, ValueError):
        number = default
    number = max(number, minimum)
    return number if maximum is None else min(number, maximum)


def parse_bool(value, default: bool = False) -> bool:
    if isinstance(value, bool):
        return value
    said = str(value).strip().lower() if value is not None else ""
    return True if said in {"1", "true", "yes", "y", "on"} else False if said in {"0", "false", "no", "n", "off"} else default


def first_value(parameters: dict[str, list[str]], name: str, default: str = "") -> str:
    """First value of a query parameter; the default where it is missing or has none."""
    return next(iter(parameters.get(name) or ()), default)


def clauses(text: str) -> list[str]:
    """Clauses of a query; the first stands for nothing in dense scoring, where the whole text replaces it."""
    parts = [p for p in re.split("(?i)" + CLAUSE_BREAK, text) if p and p.strip()]
    return [re.sub("(?i)" + CLAUSE_LEAD, "", " ".join(p.split())) for p in parts] or [text.strip()]


def encoder_texts(query: str) -> list[str]:
    """What a dense request encodes: the whole text, then the clauses after the first."""
    whole = " ".join(query.split())
    return [whole, *clauses(whole)[1:]]


def semantic_text(text: str) -> str:
    """A Han query with its English alias tokens added; any other only normalised."""
    plain = " ".join(text.split())
    if not has_han(plain):
        return plain
    return " ".join([plain, *(t for t in query_tokens(plain) if t.isascii())])


def encoder_query(text: str, instruction: str, short_template: str = "{query}", short: int = 8) -> str:
    plain = " ".join(text.split())
    if short_template and len(plain) <= short and has_han(plain):
        plain = short_template.format(query=plain)
    return f"Instruct: {instruction}\nQuery:{plain}"
