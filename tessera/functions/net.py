"""Addresses that may be fetched."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def is_public(value: str | None) -> bool:
    """A literal address of the open network: not private, reserved, link-local or for many; IPv4 inside IPv6 is judged as such."""
    try:
        address = ipaddress.ip_address((value or "").partition("%")[0])
    except ValueError:
        return False
    address = getattr(address, "ipv4_mapped", None) or address
    return address.is_global and not any((address.is_multicast, address.is_reserved, address.is_link_local))


@F.pandas_udf(BooleanType())
def _public(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(is_public).astype(bool)


def public_address(value: Column) -> Column:
    """``is_public`` of each row; a null is no address."""
    return _public(value)
