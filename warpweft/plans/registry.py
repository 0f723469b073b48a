"""A registry of queries: each is a function of session and table folder, with the SQL it must agree with, if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Signs at the edges of a token in DuckDB, apostrophes kept.
DUCK_EDGE = r"^[^\p{L}\p{N}''׳ʼ‘’`]+|[^\p{L}\p{N}\p{M}''׳ʼ‘’`]+$"


def duck_core(token: str) -> str:
    return f"CASE WHEN regexp_matches({token}, '[\\p{{L}}\\p{{N}}]') THEN regexp_replace({token}, '{DUCK_EDGE}', '', 'g') ELSE '' END"


def duck_tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '[ \\t\\n\\r]+'), lambda t: t <> '')"


def duck_words(column: str) -> str:
    return f"list_filter(list_transform({duck_tokens(column)}, lambda t: lower({duck_core('t')})), lambda w: w <> '')"


def duck_words_or_null(column: str) -> str:
    """Words with null for a token without one."""
    return f"list_transform({duck_tokens(column)}, lambda t: nullif(lower({duck_core('t')}), ''))"


def duck_bare(column: str) -> str:
    """Marks stripped, in composed form."""
    return f"nfc_normalize(strip_accents({column}))"


def duck_signs(column: str) -> str:
    return f"translate(nfc_normalize({column}), '־‐‑‒–—׳ʼ‘’`״“”', '------''''''''''\"\"\"')"


def duck_key(column: str) -> str:
    bare = duck_bare(duck_signs(column))
    return f"translate(replace(replace(replace({bare}, 'װ', 'וו'), 'ױ', 'וי'), 'ײ', 'יי'), 'ךםןףץ', 'כמנפצ')"


def query(name: str, sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register
