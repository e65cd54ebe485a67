"""Validation rules as column expressions.

Each rule is ``rule(value, name, args) -> Column`` that is null where the value
passes and an error text where it does not. A null value is of the wrong type,
which is an error of its own, given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastre.functions.patterns import is_pattern

# Patterns of the format and network rules.
UUID = r"^[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}$"
UUID_V4 = r"^[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-4[a-fA-F0-9]{3}-[89aAbB][a-fA-F0-9]{3}-[a-fA-F0-9]{12}$"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
EMAIL = r"^(?:[^<>@]*<[^\s<>@]+@[^\s<>@]+>|[^\s<>@]+@[^\s<>@]+)$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:[.]{OCTET}){{3}}$"
_H = r"[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"^(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}"
    rf"|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}"
    rf"|{_H}:(?::{_H}){{1,6}}|:(?:(?::{_H}){{1,7}}|:)"
    rf"|(?:{_H}:){{6}}{OCTET}(?:[.]{OCTET}){{3}}|::(?:[fF]{{4}}:)?{OCTET}(?:[.]{OCTET}){{3}})$"
)
CIDR = rf"^{OCTET}(?:[.]{OCTET}){{3}}/(?:3[0-2]|[12]?[0-9])$"
PUBLIC_IP_RULE = r"^([0-9]{1,3}\.){3}[0-9]{1,3}(/([0-9]|[1-2][0-9]|30))?$"
TIME_SPAN = r"^(?:\d+[.])?\d+:\d+:\d+$"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
RESERVED_RANGE = ("169.254.21.0", "169.254.22.255")


def error_if(bad: Column, name: str, text: str) -> Column:
    """The error text where ``bad``; a condition that is null counts as bad."""
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(f"{name} {text}"))


def _text(condition, text):
    """A rule that holds where ``condition(value, args)``."""
    return lambda value, name, args: error_if(~condition(value, args), name, text.format(**args))


def _folded(value: Column, args: dict) -> Column:
    return F.lower(value) if args.get("ignore_case") else value


def _words(args: dict) -> list[str]:
    return [w.lower() if args.get("ignore_case") else w for w in args["values"]]


def _starts(value: Column, args: dict) -> Column:
    out = F.lit(False)
    for prefix in args["values"]:
        out = out | value.startswith(prefix)
    return out


def ipv4_number(address: Column) -> Column:
    """IPv4 address as a number, null if it is none."""
    parts = F.split(address, "[.]")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("long")
    return F.when(address.rlike(IPV4), number)


def _url_part(value: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(value, F.lit(part)), F.lit(""))


def _url_with(value: Column, schemes: list[str]) -> Column:
    return (_url_part(value, "HOST") != "") & F.lower(_url_part(value, "PROTOCOL")).isin(schemes)


def _public(value: Column, _: dict) -> Column:
    second = F.split_part(value, F.lit("."), F.lit(2)).try_cast("int")
    private = (
        value.startswith("10.")
        | (value.startswith("172.") & second.between(16, 31))
        | (value.startswith("192.") & (second == 168))
    )
    return value.rlike(PUBLIC_IP_RULE) & ~private


def _port_range(value: Column, _: dict) -> Column:
    low, high = (F.split_part(value, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2))
    return value.rlike("^[0-9]+-[0-9]+$") & low.between(0, 65535) & high.between(0, 65535) & (low < high)


def _power_of_two(value: Column, _: dict) -> Column:
    """Membership among the powers of 128 bits, which no number type holds."""
    powers = F.array(*(F.lit(str(2**n)) for n in range(128)))
    return F.array_contains(powers, F.regexp_replace(value, "^[+]?0*", ""))


def _ranges(value: Column, _: dict) -> Column:
    low, high = (ipv4_number(F.split_part(value, F.lit("-"), F.lit(i))) for i in (1, 2))
    return low <= high


RULES = {
    # strings
    "not_empty": _text(lambda v, a: v != "", "must not be empty"),
    "empty": _text(lambda v, a: v == "", "must be empty"),
    "not_white_space": _text(lambda v, a: v.rlike(r"\S"), "must not be empty or white space"),
    "length_between": _text(
        lambda v, a: F.octet_length(v).between(a["min"], a["max"]), "must have a length from {min} to {max}"
    ),
    "match": _text(lambda v, a: v.rlike(a["pattern"]), "{text}"),
    "not_match": _text(lambda v, a: ~v.rlike(a["pattern"]), "{text}"),
    "contains_none_of": _text(lambda v, a: F.translate(v, a["chars"], "") == v, "must not contain any of {chars}"),
    "in_list": _text(lambda v, a: _folded(v, a).isin(_words(a)), "must be one of {values}"),
    "not_in_list": _text(lambda v, a: ~_folded(v, a).isin(_words(a)), "must not be one of {values}"),
    "starts_with": _text(_starts, "must start with one of {values}"),
    "not_starts_with": _text(lambda v, a: ~_starts(v, a), "must not start with one of {values}"),
    # numbers
    "between": _text(lambda v, a: v.between(a["min"], a["max"]), "must be from {min} to {max}"),
    "at_least": _text(lambda v, a: v >= a["min"], "must be at least {min}"),
    "at_most": _text(lambda v, a: v <= a["max"], "must be at most {max}"),
    "positive": _text(lambda v, a: v >= 1, "must be positive"),
    "divisible_by": _text(lambda v, a: v % a["by"] == 0, "must be divisible by {by}"),
    "number_in": _text(lambda v, a: v.isin(a["values"]), "must be one of {values}"),
    "number_not_in": _text(lambda v, a: ~v.isin(a["values"]), "must not be one of {values}"),
    "non_zero": _text(lambda v, a: v != 0, "must not be zero"),
    "price_or_minus_one": _text(lambda v, a: (v == -1.0) | (v >= 0.00001), "must be -1 or > 0.00001"),
    # formats
    "uuid": _text(lambda v, a: v.rlike(UUID), "must be a UUID"),
    "json": _text(lambda v, a: F.try_parse_json(v).isNotNull(), "must be JSON"),
    "base64": _text(lambda v, a: (v != "") & v.rlike(BASE64), "must be base64"),
    "regex": _text(lambda v, a: is_pattern(v), "must be a regular expression"),
    "email": _text(lambda v, a: v.rlike(EMAIL), "must be a valid email address"),
    "rfc3339": _text(lambda v, a: v.rlike(RFC3339) & F.try_to_timestamp(v).isNotNull(), "must be an RFC3339 time"),
    "weekday": _text(
        lambda v, a: _folded(v, a).isin([d.lower() if a.get("ignore_case") else d for d in WEEKDAYS]), "must be a day of the week"
    ),
    "month": _text(
        lambda v, a: _folded(v, a).isin([m.lower() if a.get("ignore_case") else m for m in MONTHS]), "must be a month"
    ),
    "https_url": _text(lambda v, a: _url_with(v, ["https"]), "must be an https URL"),
    "http_url": _text(lambda v, a: _url_with(v, ["http", "https"]), "must be an http or https URL"),
    "scheme_url": _text(lambda v, a: _url_with(v, a["values"]), "must be a URL with a scheme of {values}"),
    "url_with_path": _text(
        lambda v, a: (v != "") & (F.regexp_replace(_url_part(v, "PATH"), "^/", "") != ""), "must be a URL with a path"
    ),
    "time_span": _text(lambda v, a: v.rlike(TIME_SPAN), "must be dd.hh:mm:ss or hh:mm:ss"),
    # networks
    "ipv4": _text(lambda v, a: v.rlike(IPV4), "must be an IPv4 address"),
    "ipv6": _text(lambda v, a: v.rlike(IPV6), "must be an IPv6 address"),
    "ip": _text(lambda v, a: v.rlike(IPV4) | v.rlike(IPV6), "must be an IP address"),
    "cidr": _text(lambda v, a: v.rlike(CIDR), "must be a CIDR"),
    "ipv4_range": _text(_ranges, "must be an IPv4 range"),
    "port": _text(lambda v, a: v.try_cast("int").between(1, 65535), "must be a port number"),
    "port_range": _text(_port_range, "must be a port range"),
    "reserved_range": _text(
        lambda v, a: ipv4_number(v).between(ipv4_number(F.lit(RESERVED_RANGE[0])), ipv4_number(F.lit(RESERVED_RANGE[1]))),
        "must be in the reserved range",
    ),
    "public_ip_rule": _text(_public, "must be a public IP address"),
    "power_of_two": _text(_power_of_two, "must be a power of 2"),
}

# Rule sets per kind of name.
_VM_NAME = [
    ("not_white_space", {}),
    ("length_between", {"min": 1, "max": 80}),
    ("match", {"pattern": r"^[a-zA-Z0-9._-]+$", "text": "may only contain alphanumeric characters, dots, dashes and underscores"}),
    ("match", {"pattern": r"^[a-zA-Z0-9]", "text": "must begin with an alphanumeric character"}),
    ("match", {"pattern": r"\w$", "text": "must end with an alphanumeric character or underscore"}),
    ("not_match", {"pattern": r"^\d+$", "text": "cannot contain only numbers"}),
]
_COMPUTER_NAME = [
    ("not_white_space", {}),
    ("length_between", {"min": 1, "max": 63}),
    ("not_match", {"pattern": r"^_", "text": "cannot begin with an underscore"}),
    ("not_match", {"pattern": r"\.$", "text": "cannot end with a period"}),
    ("contains_none_of", {"chars": "\\/\"[]:|<>+=;,?*@&~!#$%^()_{}'"}),
    ("not_match", {"pattern": r"-$", "text": "cannot end with a dash"}),
]
NAME_RULES = {
    "virtual_machine": _VM_NAME,
    "linux_computer": _COMPUTER_NAME,
    "storage_account": [
        ("match", {"pattern": r"^[a-z0-9]{3,24}$", "text": "can only consist of lowercase letters and numbers, and must be between 3 and 24 characters long"})
    ],
    "image_version": [
        ("match", {"pattern": r"^(?:latest|recent|[0-9]{1,10}\.[0-9]{1,10}\.[0-9]{1,10})$", "text": "expected to be in the format `1.2.3`, `latest`, or `recent`"})
    ],
}


def check(kind: str, value: Column, name: str, args: dict | None = None) -> Column:
    """Error of one rule, null where the value passes."""
    return RULES[kind](value, name, args or {})


def all_of(*errors: Column) -> Column:
    """Every error."""
    return F.array_compact(F.array(*errors))


def any_of(*errors: Column) -> Column:
    """No error if one rule passes, else every error."""
    found = all_of(*errors)
    return F.when(F.size(found) < len(errors), F.array().cast("array<string>")).otherwise(found)


def none_of(**errors: Column) -> Column:
    """An error for each rule that passes, naming it."""
    return F.array_compact(F.array(*(F.when(e.isNull(), F.lit(f"ID cannot be a {n}")) for n, e in errors.items())))
