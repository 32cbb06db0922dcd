"""TLS and QUIC fingerprint detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatspark import schemas as S
from threatspark.functions.fingerprints import is_fingerprint, ja3, ja3s


def mark_listed(rows: DataFrame, column: str, blocklist: DataFrame, list_column: str, flag: str) -> DataFrame:
    """Add a flag: the value of ``column`` is on the list. The join side is picked at run time by size."""
    listed = blocklist.select(F.col(list_column).alias("_listed")).distinct().withColumn(flag, F.lit(True))
    joined = rows.join(listed, rows[column] == listed["_listed"], "left").drop("_listed")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def fingerprint_handshakes(sessions: DataFrame) -> DataFrame:
    """Client or server fingerprint of each handshake with valid transport, role and version."""
    valid = F.coalesce(
        F.col("transport").isin(*S.TRANSPORTS) & F.col("role").isin(*S.TLS_ROLES), F.lit(False)
    )
    client = ja3(
        F.col("tls_version"),
        F.col("cipher_suites"),
        F.col("extensions"),
        F.col("elliptic_curves"),
        F.col("ec_point_formats"),
    )
    server = ja3s(F.col("tls_version"), F.col("chosen_cipher"), F.col("extensions"))
    usable = valid & F.col("tls_version").isNotNull()
    return sessions.withColumns(
        {
            "_valid": valid,
            "fingerprint": F.when(usable & (F.col("role") == "client"), client).when(usable, server),
        }
    )


def analyze_handshakes(sessions: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Verdict per handshake: invalid_session, missing_tls_version, blocklist_match or clean."""
    rows = mark_listed(fingerprint_handshakes(sessions), "fingerprint", blocklist, "ja3_md5", "flagged")
    reason = (
        F.when(~F.col("_valid"), "invalid_session")
        .when(F.col("tls_version").isNull(), "missing_tls_version")
        .when(F.col("flagged"), "blocklist_match")
        .otherwise("clean")
    )
    return rows.withColumn("reason", reason).drop("_valid")


def classify_sessions(sessions: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Verdict per session with a ready fingerprint: transport, role, format, then list membership."""
    fp = F.lower(F.trim(F.coalesce("fingerprint", F.lit(""))))
    rows = mark_listed(sessions.withColumn("_fp", fp), "_fp", blocklist, "ja3_md5", "_hit")
    reason = (
        F.when(~F.coalesce(F.col("transport").isin(*S.TRANSPORTS), F.lit(False)), "invalid_transport")
        .when(~F.coalesce(F.col("role").isin(*S.TLS_ROLES), F.lit(False)), "invalid_role")
        .when(~is_fingerprint(F.col("_fp")), "invalid_fingerprint_format")
        .when(F.col("_hit"), "blocklist_match")
        .otherwise("clean")
    )
    flagged = F.col("reason") == "blocklist_match"
    return (
        rows.withColumn("reason", reason)
        .withColumns(
            {
                "flagged": flagged,
                "confidence": F.when(flagged, F.lit(1.0)).otherwise(F.lit(0.0)),
                "matched_hash": F.when(flagged, F.col("_fp")),
            }
        )
        .drop("_fp", "_hit")
    )


def is_malicious(rows: DataFrame, column: str, blocklist: DataFrame) -> DataFrame:
    """Case-folded list membership of any fingerprint column."""
    folded = rows.withColumn("_fp", F.lower(F.coalesce(column, F.lit(""))))
    return mark_listed(folded, "_fp", blocklist, "ja3_md5", "malicious").drop("_fp")
