"""IP address tests.

IPv4 is tested by number ranges inside the plan. IPv6 needs an Arrow function;
it sees only values with a colon, so IPv4 rows never leave the JVM for it.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

#: IPv4 networks that are not globally reachable, and those that are private, with their exceptions.
NOT_GLOBAL = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PRIVATE = tuple(n for n in NOT_GLOBAL if n != "100.64.0.0/10")
EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
RFC1918 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ipv4_number(c: Column) -> Column:
    """The address as a number; null if the text is not an IPv4 address."""
    parts = F.split(c, r"\.")
    total = sum((F.get(parts, F.lit(i)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.when(c.rlike(IPV4), total)


def in_networks(number: Column, networks) -> Column:
    tests = []
    for n in map(ipaddress.ip_network, networks):
        tests.append(number.between(int(n.network_address), int(n.broadcast_address)))
    return any_of(tests)


def _v6(name: str):
    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else bool(getattr(ipaddress.ip_network(x, strict=True), name))
            except ValueError:
                return None

        return s.map(one)

    return test


def _bound(c: Column, f) -> Column:
    """f(c), with c written out and worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _both(c: Column, v4, name: str, v6: bool) -> Column:
    test = _bound(_bound(c, ipv4_number), lambda n: F.when(n.isNotNull(), v4(n)))
    if not v6:
        return test
    return F.coalesce(test, _v6(name)(F.when(c.contains(":"), c)))


def is_global(c: Column, v6: bool = False) -> Column:
    """Reachable from everywhere; null if the text is no address. Set v6 for IPv6 too."""
    return _both(c, lambda n: ~in_networks(n, NOT_GLOBAL) | in_networks(n, EXCEPTIONS), "is_global", v6)


def is_private(c: Column, v6: bool = False) -> Column:
    return _both(c, lambda n: in_networks(n, PRIVATE) & ~in_networks(n, EXCEPTIONS), "is_private", v6)


def is_loopback(c: Column, v6: bool = False) -> Column:
    return _both(c, lambda n: in_networks(n, ("127.0.0.0/8",)), "is_loopback", v6)
