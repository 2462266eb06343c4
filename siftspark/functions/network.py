"""Which literal addresses are public."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the prefix under which IPv6 networks reach IPv4 addresses.
_TRANSLATED = ipaddress.ip_network("64:ff9b::/96")


def is_public(text: str | None) -> bool | None:
    """Whether an address is global, whatever form it is written in; null for what is no address."""
    text = (text or "").strip().strip("[]")
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        parts = text.split(".")
        try:
            n = [int(p, 16 if p.lower().startswith("0x") else 8 if len(p) > 1 and p[0] == "0" else 10) for p in parts]
        except ValueError:
            return None
        if not 1 <= len(n) <= 4 or any(not 0 <= x < 256 for x in n[:-1]) or not 0 <= n[-1] < 256 ** (5 - len(n)):
            return None
        ip = ipaddress.ip_address(sum(x << 8 * (3 - i) for i, x in enumerate(n[:-1])) + n[-1])
    if isinstance(ip, ipaddress.IPv6Address):
        inner = ip.ipv4_mapped or ip.sixtofour or (ipaddress.ip_address(int(ip) & 0xFFFFFFFF) if ip in _TRANSLATED else None)
        if inner is not None:
            return inner.is_global and not inner.is_multicast
    return ip.is_global and not ip.is_multicast


@F.pandas_udf(T.BooleanType())
def public_address(text: pd.Series) -> pd.Series:
    return text.map(is_public)
