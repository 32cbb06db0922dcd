"""Table contracts: explicit schemas, enumerations and default parameters."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
PROTOCOLS = ("TCP", "UDP")
TRANSPORTS = ("tls", "quic")
TLS_ROLES = ("client", "server")

BENIGN = "BENIGN"
C2_BEACONING = "C2_BEACONING"
PORT_SCAN = "PORT_SCAN"
SYN_FLOOD = "SYN_FLOOD"
DGA_DNS_TUNNELING = "DGA_DNS_TUNNELING"
MALICIOUS_TLS = "MALICIOUS_TLS"
DATA_EXFILTRATION = "DATA_EXFILTRATION"
THREAT_CLASSES = (
    BENIGN,
    C2_BEACONING,
    PORT_SCAN,
    SYN_FLOOD,
    DGA_DNS_TUNNELING,
    MALICIOUS_TLS,
    DATA_EXFILTRATION,
)

ML_SIGNAL = "ML_BRANCH_SIGNAL"
DNS_SIGNAL = "DNS_BRANCH_SIGNAL"
TLS_SIGNAL = "TLS_BRANCH_SIGNAL"
BEHAVIORAL_SIGNAL = "BEHAVIORAL_SIGNAL"
SIGNAL_TYPES = (BEHAVIORAL_SIGNAL, DNS_SIGNAL, ML_SIGNAL, TLS_SIGNAL)

NORMAL_LABEL = "Normal Traffic"
BOTS_LABEL = "Bots"
DDOS_LABEL = "DDoS"
SCAN_LABEL = "Port Scanning"
FLOW_LABELS = (NORMAL_LABEL, SCAN_LABEL, DDOS_LABEL, BOTS_LABEL)

LABEL_TO_THREAT = {
    NORMAL_LABEL: BENIGN,
    SCAN_LABEL: PORT_SCAN,
    DDOS_LABEL: SYN_FLOOD,
    BOTS_LABEL: C2_BEACONING,
}

# Labelled flow table: column -> Spark type, in contract order.
TARGET = "Attack Type"
FLOW_TABLE_FIELDS = {
    "Destination Port": T.LongType(),
    "Flow Duration": T.DoubleType(),
    "Total Fwd Packets": T.LongType(),
    "Total Length of Fwd Packets": T.DoubleType(),
    "Flow Bytes/s": T.DoubleType(),
    "Fwd Packets/s": T.DoubleType(),
    "Flow IAT Mean": T.DoubleType(),
    "Flow IAT Std": T.DoubleType(),
    "Flow IAT Max": T.DoubleType(),
    "Fwd Packet Length Mean": T.DoubleType(),
    "Fwd Packet Length Std": T.DoubleType(),
    "Fwd Packet Length Min": T.DoubleType(),
}
DROPPED_FEATURES = ("Fwd Packet Length Std", "Flow IAT Max")
MODEL_FEATURES = tuple(c for c in FLOW_TABLE_FIELDS if c not in DROPPED_FEATURES)
NON_NEGATIVE = ("Flow Duration", "Flow IAT Mean", "Flow IAT Max", "Flow Bytes/s")
LOG_FEATURES = (
    "Flow Duration",
    "Total Fwd Packets",
    "Total Length of Fwd Packets",
    "Flow Bytes/s",
    "Fwd Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
)
# Model feature name -> column of the flow-feature table it is taken from.
FEATURE_SOURCES = {
    "Destination Port": "dst_port",
    "Flow Duration": "flow_duration",
    "Total Fwd Packets": "packet_count",
    "Total Length of Fwd Packets": "byte_count",
    "Flow Bytes/s": "flow_bytes_per_second",
    "Fwd Packets/s": "packets_per_second",
    "Flow IAT Mean": "iat_mean",
    "Flow IAT Std": "iat_std",
    "Fwd Packet Length Mean": "avg_packet_size",
    "Fwd Packet Length Min": "fwd_packet_length_min",
}

# RFC 8701 GREASE code points.
GREASE_VALUES = (
    0x0A0A, 0x1A1A, 0x2A2A, 0x3A3A, 0x4A4A, 0x5A5A, 0x6A6A, 0x7A7A,
    0x8A8A, 0x9A9A, 0xAAAA, 0xBABA, 0xCACA, 0xDADA, 0xEAEA, 0xFAFA,
)
JA3_PATTERN = "^[a-f0-9]{32}$"
JA3_HEADER_HINTS = ("ja3_md5", "ja3", "hash", "fingerprint")

# Default parameters of the detectors.
FLOW_GAP_SECONDS = 5.0
DEDUP_SECONDS = 10.0
FUSION_WINDOW_SECONDS = 60.0
DNS_WINDOW_SECONDS = 5.0
DNS_RATE_LIMIT = 20
DNS_LABEL_LIMIT = 30
EWMA_ALPHA = 0.2
BASELINE_MIN_FLOWS = 10
Z_LIMIT = 3.0
Z_CLAMP = 999.0
SLOW_MIN_SECONDS = 3600.0
SLOW_MAX_PPS = 2.0
ALLOWLIST_SIZE = 10_000
RANKED_SAMPLE = 100_000
NGRAM_SIZE = 2
ENTROPY_BENIGN_WEIGHT = 1.5
MIN_DOMAIN_LENGTH = 4
ANOMALY_SIGMOID_SCALE = 0.05

RULE_VERSION = "mock-v0"
MODEL_VERSION = "rf-if-v3"
BEHAVIOR_VERSION = "behavioral-exfil-v1"
DNS_VERSION = "dga-tunneling-v1"
TLS_VERSION = "ja3-v1"
# --- end of fixed values ----------------------------------------------------


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


PACKETS = _struct(
    timestamp=T.TimestampType(),
    src_ip=T.StringType(),
    dst_ip=T.StringType(),
    src_port=T.LongType(),
    dst_port=T.LongType(),
    protocol=T.StringType(),
    packet_size=T.LongType(),
    syn_flag=T.BooleanType(),
)
DNS_QUERIES = _struct(
    domain=T.StringType(),
    query_type=T.StringType(),
    timestamp=T.StringType(),
    src_ip=T.StringType(),
)
TLS_SESSIONS = _struct(
    fingerprint=T.StringType(),
    transport=T.StringType(),
    role=T.StringType(),
    timestamp=T.StringType(),
    src_ip=T.StringType(),
)
TLS_HANDSHAKES = _struct(
    transport=T.StringType(),
    role=T.StringType(),
    tls_version=T.IntegerType(),
    cipher_suites=T.ArrayType(T.IntegerType()),
    extensions=T.ArrayType(T.IntegerType()),
    elliptic_curves=T.ArrayType(T.IntegerType()),
    ec_point_formats=T.ArrayType(T.IntegerType()),
    chosen_cipher=T.IntegerType(),
)
EVIDENCE = _struct(
    traffic=T.StringType(),
    temporal=T.StringType(),
    ml=T.StringType(),
    rule=T.StringType(),
)
FLOWS = _struct(
    flow_id=T.StringType(),
    timestamp=T.TimestampType(),
    src_ip=T.StringType(),
    dst_ip=T.StringType(),
    src_port=T.LongType(),
    dst_port=T.LongType(),
    protocol=T.StringType(),
    duration=T.DoubleType(),
    packet_count=T.LongType(),
    byte_count=T.LongType(),
)
ALERTS = _struct(
    alert_id=T.StringType(),
    timestamp=T.TimestampType(),
    flow_id=T.StringType(),
    threat_class=T.StringType(),
    severity=T.StringType(),
    confidence=T.DoubleType(),
    anomaly_score=T.DoubleType(),
    evidence=EVIDENCE,
    model_version=T.StringType(),
)
SIGNALS = _struct(
    source_ip=T.StringType(),
    ts=T.TimestampType(),
    seq=T.LongType(),
    signal_type=T.StringType(),
    flow_id=T.StringType(),
    detail=T.StringType(),
    evidence=T.StringType(),
)
THRESHOLD = _struct(
    calibrated_threshold=T.DoubleType(),
    rule=T.StringType(),
    target_bots_recall=T.DoubleType(),
    validation_bots_recall_at_threshold=T.DoubleType(),
    validation_normal_fpr_at_threshold=T.DoubleType(),
    n_estimators=T.LongType(),
    contamination=T.StringType(),
    random_state=T.LongType(),
)
