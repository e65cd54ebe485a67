"""Whether a text is a regular expression of the linear-time dialect, as column expressions.

The dialect has no look-around, no back references and no possessive repeats; it has ``\\z``,
``\\pL``, named groups, flags and ``\\Q...\\E``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE = (
    r"\\(?:[pP](?:\{\^?[A-Za-z_]+\}|[A-Z])|x\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2}"
    r"|0[0-7]{0,2}|[1-7][0-7]{1,2}|[aftnrvdDsSwW]|[\x00-\x7F&&[^0-9A-Za-z]])"
)
_IN_CLASS = rf"(?:\[:\^?(?:alnum|alpha|ascii|blank|cntrl|digit|graph|lower|print|punct|space|upper|word|xdigit):\]|{_ESCAPE}|(?!\[:[a-z^]*:\])[^\]\\])"
_CLASS = rf"\[\^?\]?{_IN_CLASS}*+\]"
_FLAGS = r"\(\?(?:[imsU]+(?:-[imsU]+)?|-[imsU]+)\)"
_OPEN = r"\((?:\?(?:P?<[A-Za-z0-9_]+>|[imsU]*(?:-[imsU]+)?:))?"
_REPEAT = r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??"
# a bracket, a backslash or an opener that none of the others takes stands alone and is refused
_TOKEN = rf"(?s)\\Q.*?(?:\\E|$)|\\[AbBCz]|{_ESCAPE}|{_CLASS}|{_FLAGS}|{_OPEN}|{_REPEAT}|."
_RANGE = r"(?s)([^\[\]\\])-([^\[\]\\])"
LARGEST_REPEAT = 1000


def _counts(token: Column) -> Column:
    """Counted repeats stay within the bound, least first."""
    low = F.regexp_extract(token, r"^\{([0-9]+)", 1).try_cast("int")
    high = F.regexp_extract(token, r"^\{[0-9]+,([0-9]+)", 1)
    top = F.when(high == "", low).otherwise(high.try_cast("int"))
    return ~token.startswith("{") | F.coalesce((low <= top) & (top <= LARGEST_REPEAT), F.lit(False))


def _class_ranges(token: Column) -> Column:
    """Every plain range of a class runs upwards."""
    inner = F.regexp_replace(F.regexp_replace(token, r"\[:\^?[a-z]+:\]", ""), _ESCAPE, "")
    ranges = F.regexp_extract_all(inner, F.lit(_RANGE), F.lit(0))
    return ~token.rlike(rf"^(?:{_CLASS})$") | F.forall(
        ranges, lambda r: F.ascii(F.substring(r, 1, 1)) <= F.ascii(F.substring(r, 3, 1))
    )


def is_pattern(text: Column) -> Column:
    """True for a pattern, false for other text and for null.

    One fold over tokens counts the open groups and knows what the last token was: 0 the
    beginning of a branch, 1 something to repeat, 2 a repeat.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        opens, closes, repeats = token.rlike(rf"^(?:{_OPEN})$"), token == ")", token.rlike(rf"^(?:{_REPEAT})$")
        flags = token.rlike(rf"^(?:{_FLAGS})$")
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        last = F.when(opens | (token == "|"), 0).when(flags, state["last"]).when(repeats, 2).otherwise(1)
        good = (
            state["good"] & (depth >= 0) & ~token.isin("[", "\\")
            & (~repeats | ((state["last"] == 1) & _counts(token))) & _class_ranges(token)
        )
        return F.struct(depth.alias("depth"), last.alias("last"), good.alias("good"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("last"), F.lit(True).alias("good"))
    names = F.regexp_extract_all(text, F.lit(r"\(\?P?<([A-Za-z0-9_]+)>"), F.lit(1))
    end = F.aggregate(tokens, start, step, lambda s: s["good"] & (s["depth"] == 0))
    return F.coalesce(end & (F.size(names) == F.size(F.array_distinct(names))), F.lit(False))
