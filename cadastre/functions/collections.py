"""Column expressions over keys, sets, maps and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastre.functions.validators import IPV4, ipv4_number

# Settings that the platform manages itself, tier order, and special versions.
MANAGED_SETTINGS = (
    "DOCKER_REGISTRY_SERVER_URL",
    "DOCKER_REGISTRY_SERVER_USERNAME",
    "DOCKER_REGISTRY_SERVER_PASSWORD",
    "DIAGNOSTICS_AZUREBLOBCONTAINERSASURL",
    "DIAGNOSTICS_AZUREBLOBRETENTIONINDAYS",
    "WEBSITE_HTTPLOGGING_CONTAINER_URL",
    "WEBSITE_HTTPLOGGING_RETENTION_DAYS",
    "WEBSITE_VNET_ROUTE_ALL",
    "spring.datasource.password",
    "spring.datasource.url",
    "spring.datasource.username",
    "WEBSITE_HEALTHCHECK_MAXPINGFAILURES",
)
TIER_ORDER = ("", "B", "S", "GP", "P", "BC")
LATEST = ("latest", "recent")
VERSION = r"^v?[0-9]+(?:[.][0-9]+)*$"


def hash_key(text: Column, ignore_case: bool = False) -> Column:
    """CRC32 key of a text or number."""
    value = text.cast("string")
    return F.crc32((F.lower(value) if ignore_case else value).cast("binary"))


def hash_ipv4(text: Column) -> Column:
    """Key of an IPv4 address as its /32 block; anything else by its own text."""
    return hash_key(F.when(text.rlike(IPV4), F.concat(text, F.lit("/32"))).otherwise(text))


def _with(value: Column, fn) -> Column:
    """``fn(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _without_zeros(groups: Column) -> Column:
    """Groups joined by colons; the first of the longest runs of two or more zero groups becomes ``::``."""
    def shorten(text: Column) -> Column:
        out = text
        for zeros in range(2, 9):
            pattern = r"^(?:((?:[0-9a-f]+:)*?[0-9a-f]+):)??0(?::0){%d}(?::(.*))?$" % (zeros - 1)
            out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1::$2")).otherwise(out)
        return out

    return _with(F.array_join(groups, ":"), shorten)


def _ipv6_groups(text: Column) -> Column:
    """The eight groups of an IPv6 address, lower case and without leading zeros; null for other text."""
    def expanded(halves: Column) -> Column:
        left, right = (
            F.when(F.coalesce(F.get(halves, F.lit(i)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
                F.split(F.get(halves, F.lit(i)), ":")
            )
            for i in (0, 1)
        )
        lacking = F.lit(8) - F.size(left) - F.size(right)
        fits = ((F.size(halves) == 1) & (lacking == 0)) | ((F.size(halves) == 2) & (lacking > 0))
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(lacking, F.lit(0))), right))

    # an IPv4 address at the end stands for the last two groups
    tail = F.regexp_extract(text, "([^:]*)$", 1)
    number = ipv4_number(tail)
    last = F.format_string("%x:%x", F.floor(number / 65536).cast("long"), (number % 65536).cast("long"))
    plain = F.when(~F.contains(tail, F.lit(".")), text).when(
        number.isNotNull(), F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(tail)), last)
    )
    return _with(
        _with(F.split(plain, "::"), expanded),
        lambda g: F.when(
            F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")),
            F.transform(g, lambda x: F.lower(F.regexp_replace(x, "^0+(?=.)", ""))),
        ),
    )


def canonical_ipv6(text: Column) -> Column:
    """Shortest form of an IPv6 address, dotted for a mapped IPv4 address; text that is no address stays.

    An address with a zone is text of another kind and stays.
    """
    def shortest(groups: Column) -> Column:
        mapped = F.slice(groups, 1, 6) == F.array(*(F.lit(x) for x in ("0", "0", "0", "0", "0", "ffff")))
        high, low = (F.conv(F.get(groups, F.lit(i)), 16, 10).cast("int") for i in (6, 7))
        dotted = F.format_string("%d.%d.%d.%d", F.shiftright(high, 8), high % 256, F.shiftright(low, 8), low % 256)
        return F.when(mapped, dotted).when(groups.isNotNull(), _without_zeros(groups))

    return F.coalesce(_with(_ipv6_groups(text), shortest), text)


def hash_ipv6(text: Column) -> Column:
    return hash_key(canonical_ipv6(text))


def set_of(values: Column, nil: bool = False) -> Column:
    """Distinct members; a null list is an empty set, or null with ``nil``."""
    found = F.array_distinct(values)
    return found if nil else F.coalesce(found, F.array().cast("array<string>"))


def without_member(values: Column, member: str) -> Column:
    """The list without a value, ignoring case."""
    return F.filter(values, lambda v: F.lower(v) != member.lower())


def scalar_text(value: Column) -> Column:
    """Text of a string or whole number; empty for any other variant."""
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("STRING", "BIGINT"), F.try_variant_get(value, "$", "string")).when(
        kind != "VOID", F.lit("")
    )


def tags_from_json(text: Column) -> Column:
    """JSON object to a map of nullable strings; null if it is no object."""
    members = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.transform_values(members, lambda k, v: scalar_text(v))


def drop_null_values(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: v.isNotNull())


def drop_keys(tags: Column, names: list[str], ignore_case: bool = True) -> Column:
    """The map without the named keys; empty names do not count."""
    wanted = [n.lower() if ignore_case else n for n in names if n]
    return F.map_filter(tags, lambda k, v: ~(F.lower(k) if ignore_case else k).isin(wanted)) if wanted else tags


def has_tags(tags: Column, wanted: dict[str, str]) -> Column:
    """Whether a map holds every wanted pair; a null map holds none."""
    out = tags.isNotNull()
    for key, value in wanted.items():
        out = out & F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))
    return out


def merge_settings(system: Column, user: Column) -> Column:
    """User settings replace system settings of the same name, ignoring case, or are added."""
    names = F.transform(F.map_keys(user), lambda k: F.lower(k))
    kept = F.map_filter(system, lambda k, v: ~F.array_contains(names, F.lower(k)))
    return F.when(F.coalesce(F.size(user), F.lit(0)) > 0, F.map_concat(kept, user)).otherwise(system)


def filter_text_id(tags: Column) -> Column:
    """Stable text of a tag filter: ``[key:value]`` in key order, ``[]`` if empty."""
    entries = F.array_sort(F.map_entries(tags))
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(F.lit("["), e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("")), F.lit("]"))), ""
    )
    return F.when(text == "", "[]").otherwise(text)


def version_key(version: Column) -> Column:
    """Numeric parts of a version as an array that sorts; null if it is no version.

    Trailing zero parts do not count: 1.2 and 1.2.0 are one version.
    """
    digits = F.regexp_replace(F.regexp_replace(version, "^v", ""), r"(?:[.]0+)+$", "")
    return F.when(version.rlike(VERSION), F.transform(F.split(digits, "[.]"), lambda p: p.try_cast("long")))


def tier_rank(name: Column) -> Column:
    """Place in the tier order by prefix, ignoring case; the last tier that matches wins, 0 is unknown."""
    rank = F.lit(0)
    for place, tier in enumerate(TIER_ORDER):
        rank = F.when(F.lower(name).startswith(tier.lower()), place).otherwise(rank)
    return rank


def higher_tier(a: Column, b: Column) -> Column:
    """Whether a is above b; false if either is unknown."""
    return (tier_rank(a) > 0) & (tier_rank(b) > 0) & (tier_rank(a) > tier_rank(b))


def first_set(default: str, **classes: Column) -> Column:
    """Class named by the first non-empty column, else the default."""
    out = F.lit(None).cast("string")
    found = [F.when(F.coalesce(value, F.lit("")) != "", F.lit(name)) for name, value in classes.items()]
    return F.coalesce(out, *found, F.lit(default))


def translate_code(value: Column, codes: dict[str, str]) -> Column:
    """Fixed mapping of codes ignoring case; others stay."""
    known = F.create_map(*(F.lit(x) for k, v in codes.items() for x in (k.lower(), v)))
    return F.coalesce(F.try_element_at(known, F.lower(value)), value)


def json_object(text: Column) -> Column:
    """JSON text to a map of variants: null for bad text."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
