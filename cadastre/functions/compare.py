"""Comparators: ``suppressed(old, new) -> Column`` tells that a difference does not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastre.functions.validators import RFC3339

# Metadata keys that are ignored, and entities that are decoded.
METADATA_KEYS = ("assignedBy", "createdBy", "createdOn", "updatedBy", "updatedOn")
ENTITIES = (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&apos;", "'"))
HEREDOC_START, HEREDOC_END = "<<~EOT", "EOT"


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def ignore_case(old: Column, new: Column) -> Column:
    return _yes(F.lower(old) == F.lower(new))


def ignore_order(old: Column, new: Column) -> Column:
    """Lists with the same members, each as often."""
    return _yes(F.sort_array(old) == F.sort_array(new))


def _instant(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def same_instant(old: Column, new: Column) -> Column:
    """The same moment in any zone; text that is no time counts as a difference."""
    return _yes(_instant(old) == _instant(new))


def same_minute(old: Column, new: Column) -> Column:
    return _yes(F.date_trunc("minute", _instant(old)) == F.date_trunc("minute", _instant(new)))


def normalised_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks, null if it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def same_json(old: Column, new: Column) -> Column:
    return _yes(normalised_json(old) == normalised_json(new))


def _object_without(text: Column, keys: tuple[str, ...]) -> Column:
    members = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.to_json(F.map_from_entries(F.array_sort(
        F.transform(
            F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*keys)),
            lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")),
        )
    )))


def same_metadata(old: Column, new: Column, keys: tuple[str, ...] = METADATA_KEYS, empty_new: bool = True) -> Column:
    """JSON objects that agree but for some keys. With ``empty_new`` an empty new text is an empty object."""
    given = F.when(new == "", F.lit("{}")).otherwise(new) if empty_new else new
    return _yes(_object_without(old, keys) == _object_without(given, keys))


def without_white_space(text: Column) -> Column:
    return F.translate(text, "\n\r\t ", "")


def decoded_xml(text: Column) -> Column:
    """White-space-free XML with the five named entities decoded."""
    out = without_white_space(text)
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def same_xml(old: Column, new: Column) -> Column:
    """XML that differs in blank text between tags only."""
    def tight(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r">\s+<", "><"), r"^\s+|\s+$", "")

    return _yes(tight(old) == tight(new))


def same_xml_text(old: Column, new: Column) -> Column:
    """As ``same_xml``, else equal without any white space."""
    return same_xml(old, new) | _yes(without_white_space(old) == without_white_space(new))


def normalised_ssh_key(text: Column) -> Column:
    """Key on one line, without heredoc marks; null for an empty text."""
    heredoc = text.startswith(HEREDOC_START) & text.endswith(HEREDOC_END)
    inner = F.substr(text, F.lit(len(HEREDOC_START) + 1), F.length(text) - len(HEREDOC_START) - len(HEREDOC_END))
    bare = F.replace(F.when(heredoc, inner).otherwise(text), F.lit("\r"), F.lit(""))
    lines = F.transform(F.split(bare, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.when(text != "", F.array_join(lines, ""))


def same_ssh_key(old: Column, new: Column) -> Column:
    return _yes(normalised_ssh_key(old) == normalised_ssh_key(new))


def same_connection_string(old: Column, new: Column) -> Column:
    """The same parts in any order and case; password parts of the new side are not looked at."""
    def parts(text: Column) -> Column:
        return F.array_sort(F.split(F.regexp_replace(F.lower(text), ";$", ""), ";"))

    kept = F.filter(parts(new), lambda p: ~p.startswith("password"))
    return _yes(parts(old) == kept)


def same_versioned_url(old: Column, new: Column) -> Column:
    """URLs ``base/type/name[/version]`` that differ in their version only."""
    def base(text: Column) -> Column:
        return F.nullif(F.regexp_extract(text, r"^(https?://[^/]+)/[^/]+/[^/]+(?:/[^/]+)?/?$", 1), F.lit(""))

    def name(text: Column) -> Column:
        return F.regexp_extract(text, r"^https?://[^/]+/[^/]+/([^/]+)(?:/[^/]+)?/?$", 1)

    return _yes((base(old) == base(new)) & (name(old) == name(new)))
