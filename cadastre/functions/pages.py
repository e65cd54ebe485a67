"""Column expressions over the lines of documentation pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that tell what a line is.
FIELD = r"^[*-] *`(.*?)` +\- +(\(Required\)|\(Optional\))? ?(.*)"
DEFAULT = "[.,?;](?: *[Tt]he)? *[Dd]efaults?[^`'\".]+(?:to|is) ('[^']+'|`[^`]+`|\"[^\"]+\")[ .,]?"
FORCE_NEW = r" ?Changing.*forces? a [^.]*(\.|$)"
FORCE_NEW_WHEN = r" ?Changing.*forces? a [^.]* created when [^.]*(\.|$)"
BLOCK_FIELD = "(?:[Oo]ne|[Ee]ach|more(?: \\(.*\\))?|[Tt]he|as|of|[Aa]n?) ['\"`]([^ ]+)['\"`] (?:block|object)[^.]+(?:below|above)"
BLOCK_FIELD_ANY_CASE = "(?i)" + BLOCK_FIELD
BLOCK_HEAD = "^(an?|An?|The)[^`]+(`[a-zA-Z0-9_]+`[, and]*)+.*blocks?.*$"
BLOCK_HEAD_TRY = "^([*] )?(An?|The) +(`[a-zA-Z0-9_]+`[, and]*)+blocks?.*$"
CODE = "`([^`]+)`"
TIMEOUT_VALUE = r"[0-9]+ (?:hours?|minutes?)"
TIMEOUT_LINE = r"(?i)`(\w*)`[\s\t-]*\([\s\ta-z]*(\d*)[\s\ta-z]*\) used when \w*ing (?:the|this|a)(.*)"
NOTE = r"^[\s\t]*(>|->|~>|!>)[\s|\t]*(\*\*[\w\s:]*\*\*)(.*)"
NOTE_START = r"^[\s\t]*(>|->|~>|!>)(.*)"
INCORRECT_MARK = r"(?: blocks?)? as (?:detailed|defined) (below|above)"
POSSIBLE_VALUES = r"[Pp]ossible values[^.]*"

# Spaces other than the plain ones, and small repairs of a field line.
OTHER_SPACES = r"[\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
ORDER_FIXES = {"(Optional) -": "- (Optional)", "(Required) -": "- (Required)", "`-": "` -"}
CASE_FIXES = {"- (optional)": "- (Optional)", "- (required)": "- (Required)"}
TIMEOUT_ACTIONS = ("create", "read", "update", "delete")
VERBS = {"create": "creating", "read": "retrieving", "update": "updating", "delete": "deleting"}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def default_value(line: Column) -> Column:
    """Default named on a line, without its quotes; empty if none."""
    quoted = F.regexp_extract(line, DEFAULT, 1)
    return F.when(F.length(quoted) > 2, F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.lit(""))


def is_force_new(line: Column) -> Column:
    return line.rlike(FORCE_NEW) & ~line.rlike(FORCE_NEW_WHEN)


def is_block_field(line: Column) -> Column:
    return line.rlike(BLOCK_FIELD) | F.contains(line, F.lit("A block to"))


def codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(1))


def possible_values(line: Column) -> Column:
    """Distinct code words of the sentence that names the possible values."""
    return F.array_distinct(codes(F.regexp_extract(line, POSSIBLE_VALUES, 0)))


def block_names(line: Column) -> Column:
    """Names that a block heading defines: the code words before ``block``."""
    head = F.substring_index(line, "block", 1)
    return F.when(line.rlike(BLOCK_HEAD), F.transform(codes(head), lambda n: F.regexp_replace(n, "^[`']+|[`']+$", "")))


def normalise_line(line: Column) -> Column:
    """Plain spaces, single spaces after column 4 of list lines, markers in order and case."""
    out = F.regexp_replace(line, OTHER_SPACES, " ")
    tail = F.regexp_replace(F.substr(out, F.lit(5)), r" \s+", " ")
    listed = F.concat(F.left(out, F.lit(4)), tail)
    for old, new in {**ORDER_FIXES, **CASE_FIXES}.items():
        listed = F.replace(listed, F.lit(old), F.lit(new))
    return F.when(out.startswith("*") & (F.length(out) >= 4), listed).otherwise(out)


def fix_block_head(line: Column) -> Column:
    """Block heading without a star, with an article and the word block."""
    out = F.when(line.startswith("*"), trimmed(F.substr(line, F.lit(2)))).otherwise(line)
    out = F.when(out.startswith("`"), F.concat(F.lit("The "), out)).otherwise(out)
    return F.when(F.contains(out, F.lit("block")), out).otherwise(
        F.regexp_replace(out, "^(.+`)([^`]*)$", "$1 block$2")
    )


def timeout_seconds(line: Column) -> Column:
    """Seconds of the first timeout value on a line, null if there is none."""
    value = F.regexp_extract(line, TIMEOUT_VALUE, 0)
    number = F.split_part(value, F.lit(" "), F.lit(1)).try_cast("long")
    return number * F.when(F.contains(value, F.lit("hour")), 3600).otherwise(60)


def timeout_action(line: Column) -> Column:
    """Action named on a timeout line, tested in the order create, update, read, delete."""
    return F.coalesce(
        *(F.when(F.contains(line, F.lit(f"`{a}`")), a) for a in ("create", "update", "read", "delete"))
    )


def timeout_text(seconds: Column) -> Column:
    """Minutes, or whole hours from two hours on: one hour prints as 60 minutes."""
    hours = (seconds > 3600) & (seconds % 3600 == 0)
    number = F.when(hours, F.floor(seconds / 3600)).otherwise(F.floor(seconds / 60))
    unit = F.when(hours, F.lit("hour")).otherwise(F.lit("minute"))
    return F.concat(number.cast("string"), F.lit(" "), unit, F.when(number > 1, "s").otherwise(""))


def duration_text(minutes: Column) -> Column:
    """Whole hours wherever possible: 60 minutes print as 1 hour."""
    hours = minutes % 60 == 0
    number = F.when(hours, F.floor(minutes / 60)).otherwise(minutes).cast("long")
    unit = F.when(hours, F.lit("hour")).otherwise(F.lit("minute"))
    return F.concat(number.cast("string"), F.lit(" "), unit, F.when(number > 1, "s").otherwise(""))


def _verb(action: Column) -> Column:
    verb = F.lit("")
    for name, text in VERBS.items():
        verb = F.when(action == name, text).otherwise(verb)
    return verb


def timeout_line(action: Column, value_text: Column, subject: Column, stop: str = ".") -> Column:
    text = F.format_string("* `%s` - (Defaults to %s) Used when %s the %s", action, value_text, _verb(action), subject)
    return F.concat(text, F.lit(stop))


def expected_note(line: Column) -> Column:
    """Note line in its expected format, null where the line is no note."""
    full = line.rlike(NOTE)
    level = F.regexp_extract(line, NOTE_START, 1)
    raw = F.when(full, F.regexp_extract(line, NOTE, 3)).otherwise(F.regexp_extract(line, NOTE_START, 2))
    text = trimmed(F.regexp_replace(trimmed(raw), r"(?i)^(?:note)?:?", ""))
    shown = F.when(level == ">", "->").otherwise(level)
    return F.when(line.rlike(NOTE_START), F.concat_ws(" ", shown, F.lit("**Note:**"), text))


def sort_possible_values(values: Column) -> Column:
    """Weekday order if every value is a weekday, else by lower case."""
    days = F.array(*(F.lit(d) for d in WEEKDAYS), *(F.lit(d.capitalize()) for d in WEEKDAYS))
    weekdays = F.forall(values, lambda v: F.array_contains(days, v))
    by_day = F.transform(
        values, lambda v: F.struct(F.array_position(days, F.lower(v)).cast("string").alias("k"), v.alias("v"))
    )
    by_name = F.transform(values, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(F.when(weekdays, by_day).otherwise(by_name)), lambda s: s["v"])


def values_text(values: Column) -> Column:
    """Sorted values as ```a`, `b` and `c```."""
    shown = F.transform(sort_possible_values(values), lambda v: F.concat(F.lit("`"), v, F.lit("`")))
    head = F.array_join(F.slice(shown, F.lit(1), F.greatest(F.size(shown) - 1, F.lit(0))), ", ")
    last = F.try_element_at(shown, F.lit(-1))
    return F.when(F.size(shown) <= 1, F.coalesce(last, F.lit(""))).otherwise(F.concat(head, F.lit(" and "), last))


def fix_required(line: Column, miss: Column) -> Column:
    """Mend the (Required)/(Optional) mark of a line; ``miss`` names what it should be."""
    required, optional = F.instr(line, "(Required)") > 1, F.instr(line, "(Optional)") > 1
    want = F.when(miss == "should_be_required", "(Required)").otherwise("(Optional)")
    other = F.when(miss == "should_be_required", "(Optional)").otherwise("(Required)")
    # a mark whose first place is the very start of a line is left alone when it is to be removed
    removed = F.when(
        required, F.regexp_replace(line, r"^(.+?)(?: \(Required\)(?= )|\(Required\))", "$1")
    ).when(optional, F.regexp_replace(line, r"^(.+?)(?: \(Optional\)(?= )|\(Optional\))", "$1")).otherwise(line)
    at = F.instr(line, other)
    swapped = F.concat(F.substr(line, F.lit(1), at - 1), want, F.substr(line, at + 10))
    dashed = F.instr(line, " - ")
    added = F.when(
        dashed > 1, F.concat(F.left(line, dashed + 2), want, F.lit(" "), F.substr(line, dashed + 3))
    ).otherwise(F.concat(F.regexp_extract(line, "^([^`]*`[^`]*`)", 1), F.lit(" "), want, F.regexp_extract(line, "^[^`]*`[^`]*`(.*)$", 1)))
    return F.when(miss == "should_be_computed", removed).when(
        miss.isin("should_be_required", "should_be_optional"), F.when(at > 0, swapped).otherwise(added)
    ).otherwise(line)


def fix_default(line: Column, value: Column) -> Column:
    """Replace, add or (for an empty value) remove the default named on a line."""
    whole = F.regexp_extract(line, DEFAULT, 0)
    at = F.instr(line, whole)
    quoted = F.regexp_extract(line, DEFAULT, 1)
    inside = F.instr(whole, quoted)
    new = F.concat(F.lit("`"), value, F.lit("`"))
    before, after = F.left(line, at - 1), F.substr(line, at + F.length(whole))
    replaced = F.concat(before, F.left(whole, inside - 1), new, F.substr(whole, inside + F.length(quoted)), after)
    removed = F.concat(before, F.left(whole, F.lit(1)), after)
    added = F.concat(trimmed(line), F.lit(" Defaults to "), new, F.lit("."))
    return F.when(line.rlike(DEFAULT), F.when(value == "", removed).otherwise(replaced)).otherwise(
        F.when(value != "", added).otherwise(line)
    )


def fix_force_new(line: Column, should: Column) -> Column:
    """Add or remove the sentence that a change forces a new resource."""
    bare = F.rtrim(line)
    ended = F.when(bare.endswith(","), F.concat(F.left(bare, F.length(bare) - 1), F.lit("."))).when(
        bare.endswith("."), bare
    ).otherwise(F.concat(bare, F.lit(".")))
    return F.when(should, F.concat(ended, F.lit(" Changing this forces a new resource to be created."))).otherwise(
        F.regexp_replace(line, FORCE_NEW, "")
    )


def fix_timeout(line: Column, seconds: Column) -> Column:
    """Put the wanted value in place of the one on a timeout line (up to the next bracket)."""
    value = F.regexp_extract(line, TIMEOUT_VALUE + r"(?:[^)]+(?=\)))?", 0)
    at = F.instr(line, value)
    put = F.concat(F.left(line, at - 1), timeout_text(seconds), F.substr(line, at + F.length(value)))
    return F.when((seconds > 0) & (value != ""), put).otherwise(line)


def with_full_stop(line: Column) -> Column:
    """End a line that has text with ``.`` unless it ends with ``.`` or ``?``."""
    bare = F.regexp_replace(line, " $", "")
    return F.when((bare != "") & ~bare.rlike(r"[.?]$"), F.concat(bare, F.lit("."))).otherwise(line)
