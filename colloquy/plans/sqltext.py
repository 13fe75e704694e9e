"""Pieces of SQL that several plans share."""

from __future__ import annotations

#: White space that is trimmed and collapsed.
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WS = r"[ \t\n\x0B\f\r]"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def compact(x: str) -> str:
    """Lower case, white space collapsed and trimmed."""
    return f"regexp_replace({strip(f'lower({x})')}, '{WS}+', ' ', 'g')"


def any_pattern(x: str, patterns) -> str:
    return f"regexp_matches({x}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def any_phrase(x: str, phrases) -> str:
    return "(" + " or ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def count_phrases(x: str, phrases) -> str:
    return "(" + " + ".join(f"contains({x}, {q(p)})::int" for p in phrases) + ")"


def term_found(x: str, term: str) -> str:
    """x in lower case with white space normalised."""
    return f"contains({x}, {q(term)})" if " " in term else f"regexp_matches({x}, {q(chr(92) + 'b' + term + chr(92) + 'b')})"


def terms(x: str, words, limit: int = 8) -> str:
    """The terms found, in order, the first few."""
    found = ", ".join(f"case when {term_found(x, w)} then {q(w)} end" for w in words)
    return f"list_filter([{found}], lambda t: t is not null)[1:{limit}]"


def first_of(pairs, otherwise: str) -> str:
    """pairs: (condition, value)."""
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


def topic(x: str, topics: dict, default: str) -> str:
    cells = ", ".join(f"{{'n': {count_phrases(x, p)}, 'o': {-i}, 't': {q(t)}}}" for i, (t, p) in enumerate(topics.items()))
    return f"(case when list_reverse_sort([{cells}])[1].n > 0 then list_reverse_sort([{cells}])[1].t else {q(default)} end)"


def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def exact(x: str, digits: int = 4) -> str:
    """x rounded half up by its decimal digits, which is what ties at the last place need."""
    return f"cast(round(cast(round({x}, 9) as decimal(28, 9)), {digits}) as double)"
