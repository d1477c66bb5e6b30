"""Code blocks in replies (C01-C04), as column expressions over a table of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STEP_WORDS = ("pl.", "filter", "select", "with_columns", "group_by", "sort", "join")
SQL_WORDS = ("SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "JOIN")
SQL_STARTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "WITH")


def blocks(text: Column, language: str = "") -> Column:
    """All fenced blocks of a language, trimmed, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\s*\n(.*?)\n```"), F.lit(1))
    return F.transform(found, lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def is_step(code: Column) -> Column:
    """Does a line rebind ``df`` from itself, and does one of the table verbs occur?"""
    return code.rlike(r"(?m)^[ \t]*df = df(?:\.|.*\(|.*\\[ \t]*$)") & _any(code, STEP_WORDS)


def is_sql(code: Column) -> Column:
    upper = F.upper(code)
    return upper.rlike(r"^\s*(?:" + "|".join(SQL_STARTS) + ")") & _any(upper, SQL_WORDS)


def extract_code(text: Column, sql_mode: bool = False) -> Column:
    """The first SQL block if it is SQL, else the first Python block if it is a step, else the first plain block right for the mode."""
    sql, python = F.get(blocks(text, "sql"), F.lit(0)), F.get(blocks(text, "python"), F.lit(0))
    untagged = F.regexp_replace(text, r"(?s)```\w+\s*\n.*?\n```", "")  # the end of a tagged block opens no plain one
    plain = F.get(F.filter(blocks(untagged), is_sql if sql_mode else is_step), F.lit(0))
    return F.when(F.coalesce(is_sql(sql), F.lit(False)), sql).when(F.coalesce(is_step(python), F.lit(False)), python).otherwise(plain)


def split_reply(text: Column, placeholder: str = "[code]") -> tuple[Column, Column]:
    """The prose with a placeholder for each Python block, and the blocks."""
    return F.regexp_replace(text, r"(?s)```python\s*\n.*?\n```", placeholder), blocks(text, "python")
