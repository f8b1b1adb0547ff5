"""Small builders for the DuckDB side of a query."""

from __future__ import annotations

import re

from gleaner.plans.registry import sql_list, sql_str

__all__ = ["RR", "STRIP", "COLLAPSE", "chain", "sql_list", "sql_str", "WS", "ASCII_WORDS", "any_contains", "REX",
           "REXALL", "COUNT", "SENT", "case"]


def RR(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {sql_str(pattern)}, {sql_str(repl)}, 'g')"


def chain(x: str, rules) -> str:
    for pattern, repl in rules:
        x = RR(x, pattern, repl)
    return x


def REX(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {sql_str(pattern)}, {group})"


def REXALL(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {sql_str(pattern)}, {group})"


def COUNT(x: str, pattern: str) -> str:
    return f"len({REXALL(x, pattern)})"


def STRIP(x: str) -> str:
    return RR(x, r"^\s+|\s+$")


def COLLAPSE(x: str) -> str:
    return f"trim({RR(x, chr(92) + 's+', ' ')})"


def WS(x: str) -> str:
    """Whitespace normalisation."""
    x = f"replace(replace({x}, chr(160), ' '), chr(9), ' ')"
    return STRIP(chain(x, [("\r\n?", "\n"), (" {2,}", " "), ("(?m)^ +| +$", ""), ("\n{3,}", "\n\n")]))


def ASCII_WORDS(x: str) -> str:
    """Non-ASCII letters to '_' so that RE2's ASCII word boundary agrees with a Unicode one."""
    return RR(x, r"[^\P{L}a-zA-Z]", "_")


def any_contains(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_str(t)})" for t in terms) + ")"


def case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def SENT(x: str) -> str:
    """Sentence list: break after . ! ? plus blanks."""
    marked = RR(x, r"([.!?])\s+", "\\1\x01")
    return f"string_split({marked}, chr(1))"


def java_free(pattern: str) -> str:
    return re.sub(r"\(\?U\)", "", pattern)
