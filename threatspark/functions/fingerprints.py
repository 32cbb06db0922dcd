"""Column functions for TLS client and server fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threatspark.schemas import GREASE_VALUES, JA3_PATTERN


def strip_grease(values: Column) -> Column:
    kept = F.filter(values, lambda v: ~v.isin(*GREASE_VALUES))
    return F.coalesce(kept, F.array().cast("array<int>"))


def _dashed(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "-")


def ja3(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    """MD5 of the client hello fields in handshake order."""
    point_formats = F.coalesce(formats, F.array().cast("array<int>"))
    return F.md5(
        F.concat_ws(
            ",",
            version.cast("string"),
            _dashed(strip_grease(ciphers)),
            _dashed(strip_grease(extensions)),
            _dashed(strip_grease(curves)),
            _dashed(point_formats),
        )
    )


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    """MD5 of the server hello fields; a missing cipher is an empty field."""
    return F.md5(
        F.concat_ws(
            ",",
            version.cast("string"),
            F.coalesce(cipher.cast("string"), F.lit("")),
            _dashed(strip_grease(extensions)),
        )
    )


def is_fingerprint(value: Column) -> Column:
    return F.coalesce(value.rlike(JA3_PATTERN), F.lit(False))
