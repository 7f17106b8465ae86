"""Expressions that turn raw journal text into typed values.

Functions take column names and return one parsed SQL expression each, which
keeps plan building cheap for wide projections.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchgrid import vocab

# White space as SQL string escapes: space, tab, newline, return, form feed, vertical tab.
_BLANKS = r" \t\n\r\u000c\u000b"


def sql_list(values: list) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in values)


def stripped(raw: str) -> Column:
    """Text without surrounding white space; empty for NULL and NA tokens."""
    known = f"CASE WHEN {raw} NOT IN ({sql_list(vocab.NA_TOKENS)}) THEN {raw} END"
    return F.expr(f"coalesce(trim(BOTH '{_BLANKS}' FROM {known}), '')")


def word_of(raw: str) -> Column:
    """Lower-cased stripped text, the form in which words are compared."""
    return F.lower(stripped(raw))


def alarm_flag(word: str) -> Column:
    """1 for an alarm word, 0 for everything else including unknown words."""
    return F.expr(f"cast({word} IN ({sql_list(vocab.ALARM_TRUE)}) AS int)")


def alarm_status(word: str) -> Column:
    """'true', 'false', 'missing' or 'invalid'."""
    return F.expr(f"""CASE WHEN {word} = '' THEN 'missing'
        WHEN {word} IN ({sql_list(vocab.ALARM_TRUE)}) THEN 'true'
        WHEN {word} IN ({sql_list(vocab.ALARM_FALSE)}) THEN 'false' ELSE 'invalid' END""")


def parse_value(text: str) -> Column:
    """Number with decimal point or comma, else NULL; takes stripped text."""
    return F.expr(f"""CASE WHEN {text} RLIKE r'{vocab.NUMBER_PATTERN}'
        THEN try_cast(replace({text}, ',', '.') AS double) END""")


def value_kind(text: str, value: str) -> Column:
    return F.expr(f"CASE WHEN {value} IS NOT NULL THEN 'numeric' WHEN {text} = '' THEN 'missing' ELSE 'text' END")


def is_negative(value: str) -> Column:
    return F.expr(f"cast(coalesce({value} < 0, false) AS int)")


def is_sentinel(value: str) -> Column:
    return F.expr(f"cast(coalesce({value} IN ({sql_list(vocab.SENTINELS)}), false) AS int)")


def text_state_flags(word: str) -> dict[str, Column]:
    return {name: F.expr(f"cast({word} = '{state}' AS int)") for name, state in vocab.TEXT_STATES.items()}


def parse_date(raw: str) -> Column:
    """Calendar date of ISO text, with or without a time; NULL when it is not one."""
    return F.expr(f"CASE WHEN length({raw}) >= 10 THEN try_cast({raw} AS date) END")


def time_digits(raw: str) -> Column:
    """H:MM:SS text as the number HMMSS; NULL for any other shape.

    Rare times with fractions take the slower branch.
    """
    whole = f"CASE WHEN instr({raw}, '.') = 0 THEN {raw} ELSE substring_index({raw}, '.', 1) END"
    shaped = f"length({raw}) BETWEEN 7 AND 8 AND substr({raw}, -6, 1) = ':' AND substr({raw}, -3, 1) = ':'"
    long = f"length({whole}) BETWEEN 7 AND 8 AND substr({whole}, -6, 1) = ':' AND substr({whole}, -3, 1) = ':'"
    return F.expr(f"""CASE WHEN {shaped} THEN try_cast(replace({raw}, ':', '') AS int)
        WHEN {long} THEN try_cast(replace({whole}, ':', '') AS int) END""")


def second_of_day(digits: str) -> Column:
    """Seconds since midnight from ``time_digits``, NULL outside one day."""
    return F.expr(f"""CASE WHEN {digits} BETWEEN 0 AND 235959 AND {digits} DIV 100 % 100 < 60 AND {digits} % 100 < 60
        THEN cast({digits} DIV 10000 * 3600 + {digits} DIV 100 % 100 * 60 + {digits} % 100 AS int) END""")
