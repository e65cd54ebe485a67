"""Name conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_by_run(name: Column) -> Column:
    """CamelCase to snake_case; a run of capitals is one word up to its last capital."""
    cut = F.regexp_replace(name, r"([^\p{Lu}])(\p{Lu})", "$1_$2")
    return F.lower(F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}[^\p{Lu}])", "$1_$2"))


def snake_by_capital(name: Column) -> Column:
    """CamelCase to snake_case with every capital its own word, ``_i_d`` mended to ``_id``."""
    cut = F.regexp_replace(name, r"(?<=.)(\p{Lu})", "_$1")
    return F.replace(F.lower(cut), F.lit("_i_d"), F.lit("_id"))


def camel_case(name: Column) -> Column:
    """snake_case to CamelCase; empty segments vanish."""
    words = F.transform(
        F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    )
    return F.array_join(words, "")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings."""
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.left(a, F.array_max(F.filter(lengths, lambda n: F.left(a, n) == F.left(b, n))))
