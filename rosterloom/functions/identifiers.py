"""Provider identifiers: digits, format and Luhn checksum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NPI_FORMAT = "^[0-9]{10}$"


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def npi_format(value: Column) -> Column:
    return value.rlike(NPI_FORMAT)


def npi_luhn(value: Column, prefix: str = "") -> Column:
    """Luhn mod 10 over ten digits, without a loop over array elements.

    A doubled digit is a digit again once its own digits are added, so doubling
    is one ``translate`` of the text; the sum then adds ten character codes.
    ``prefix`` ("80840" for the published NPI rule) shifts the sum by a constant
    that is worked out here, once.  Give it a plain column: the value is read for
    each digit.
    """
    offset = -10 * ord("0")
    for position, digit in enumerate(reversed(prefix), start=10):
        weighted = int(digit) * (2 if position % 2 else 1)
        offset += weighted // 10 + weighted % 10
    doubled = F.translate(value, "0123456789", "0246813579")
    codes = [F.ascii(F.substring(doubled if place % 2 else value, place, 1)) for place in range(1, 11)]
    total = sum(codes, F.lit(offset))
    return F.when(npi_format(value), F.pmod(total, F.lit(10)) == 0).otherwise(F.lit(False))
