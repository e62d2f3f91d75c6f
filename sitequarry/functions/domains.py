"""Site names: normalising, grammar, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequarry.functions.text import bound, strip_blanks

# The accepted forms of a site name and the limit on its length.
HOST_PATTERN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9][a-z0-9-]{0,61}[a-z0-9]$"
LABEL_PATTERN = r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"
IPV4_PATTERN = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
IPV6_PATTERN = r"^\[?[0-9a-f:]+]?$"
MAX_LENGTH = 253

# Reasons of refusal.
EMPTY = "Domain cannot be empty"
BAD_FORMAT = "Invalid domain format. Expected format: example.com or www.example.com"
TOO_LONG = "Domain name too long (max 253 characters)"


def normalised(name: Column) -> Column:
    """Strip, lower, drop an http(s) scheme with all behind the host, drop trailing slashes."""

    def without_scheme(text: Column) -> Column:
        # host, or the path where the host is empty
        url = F.regexp_replace(text, r"[\t\r\n]", "")
        host = F.regexp_replace(url, "^https?://(?:([^/?#]+).*|([^?#]*).*)$", "$1$2")
        return F.when(text.rlike("^https?://"), host).otherwise(text)

    return F.regexp_replace(bound(F.lower(strip_blanks(name)), without_scheme), "/+$", "")


def kind(domain: Column) -> Column:
    """ipv4, label, host or ipv6; NULL when no form fits."""

    def fits(pattern: str) -> Column:
        return domain.rlike("(?d)" + pattern)

    return (
        F.when(fits(IPV4_PATTERN), "ipv4")
        .when(fits(LABEL_PATTERN), "label")
        .when(fits(HOST_PATTERN), "host")
        .when(fits(IPV6_PATTERN), "ipv6")
    )


def reject_reason(name: Column, domain: Column, domain_kind: Column) -> Column:
    """Why the name is refused, NULL when it is accepted.

    Two dots in a row never pass the grammar, so they need no rule of their own.
    """
    return (
        F.when(name.isNull() | (name == ""), EMPTY)
        .when(domain_kind.isNull(), BAD_FORMAT)
        .when(F.length(domain) > MAX_LENGTH, TOO_LONG)
    )
