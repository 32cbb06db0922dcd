"""Domain tables derived from the given tables, as Spark plans and as SQL with the same meaning.

The given tables hold no packets, so every row of them is read as one. Times are compressed by a
constant so that the detectors' own windows (seconds) fit a table that spans a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatspark import schemas as S

FLOW_SCALE = 17_280  # one day becomes five seconds
FUSION_SCALE = 720  # twelve hours become one minute
DEDUP_SCALE = 4_320  # twelve hours become ten seconds


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{path}/{name}.parquet")


def events(spark: SparkSession, path: str, scale: int = 1) -> DataFrame:
    """Events with compressed time: ``t_us`` and ``timestamp``."""
    rows = table(spark, path, "events")
    micros = F.expr(f"unix_micros(cast(ts as timestamp)) div {scale}")
    return rows.withColumn("t_us", micros).withColumn("timestamp", F.timestamp_micros("t_us"))


def source() -> Column:
    return F.concat(F.lit("h"), F.expr("cast(user_id div 15 as string)"))


def packets(spark: SparkSession, path: str, scale: int = FLOW_SCALE) -> DataFrame:
    return events(spark, path, scale).select(
        "timestamp",
        source().alias("src_ip"),
        F.col("event_type").alias("dst_ip"),
        F.lit(40000).cast("long").alias("src_port"),
        (F.get_json_object("props", "$.k").cast("long") % 12).alias("dst_port"),
        F.lit("TCP").alias("protocol"),
        F.round("value").cast("long").alias("packet_size"),
        (F.col("event_type") == "error").alias("syn_flag"),
        F.col("event_id").alias("seq"),
    )


PACKETS_SQL = f"""
pk AS (
  SELECT 'h' || CAST(user_id // 15 AS VARCHAR) AS src_ip, event_type AS dst_ip, CAST(40000 AS BIGINT) AS src_port,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS dst_port, 'TCP' AS protocol,
         CAST(round(value) AS BIGINT) AS packet_size, event_type = 'error' AS syn_flag,
         epoch_us(ts) // {FLOW_SCALE} AS t_us, event_id AS seq
  FROM events)"""

FIVE = "src_ip, dst_ip, src_port, dst_port, protocol"
FLOWS_SQL = f"""{PACKETS_SQL},
lg AS (
  SELECT *, t_us - lag(t_us) OVER (PARTITION BY {FIVE} ORDER BY t_us, seq) AS g FROM pk),
fs AS (
  SELECT *, CASE WHEN g <= 5000000 THEN g END AS gap_us,
         max(CASE WHEN g IS NULL OR g > 5000000 THEN t_us END)
           OVER (PARTITION BY {FIVE} ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS flow_start_us
  FROM lg),
fg AS (
  SELECT {FIVE}, flow_start_us, max(t_us) AS last_us, count(*) AS packet_count,
         CAST(sum(packet_size) AS BIGINT) AS byte_count, CAST(sum(CAST(syn_flag AS INT)) AS BIGINT) AS syn_count,
         min(packet_size) AS fwd_packet_length_min, CAST(max(t_us) - flow_start_us AS DOUBLE) AS flow_duration,
         coalesce(avg(gap_us), 0.0) AS iat_mean, coalesce(stddev_samp(gap_us), 0.0) AS iat_std
  FROM fs GROUP BY {FIVE}, flow_start_us),
fl AS (
  SELECT *, 'f_' || md5(concat_ws('|', src_ip, dst_ip, src_port, dst_port, protocol, flow_start_us)) AS flow_id,
         CASE WHEN flow_duration > 0 THEN packet_count / (flow_duration / 1000000.0) ELSE 0.0 END AS packets_per_second,
         CASE WHEN flow_duration > 0 THEN byte_count / (flow_duration / 1000000.0) ELSE 0.0 END AS flow_bytes_per_second,
         byte_count / packet_count AS avg_packet_size
  FROM fg)"""

RUNNING_SQL = f"""{FLOWS_SQL},
r1 AS (
  SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY last_us, flow_id) = 1 AS new_dst,
         row_number() OVER (PARTITION BY src_ip, dst_port ORDER BY last_us, flow_id) = 1 AS new_port
  FROM fl),
rc AS (
  SELECT *, CAST(sum(CAST(new_dst AS INT)) OVER w AS BIGINT) AS unique_destinations,
         CAST(sum(CAST(new_port AS INT)) OVER w AS BIGINT) AS unique_dest_ports
  FROM r1 WINDOW w AS (PARTITION BY src_ip ORDER BY last_us, flow_id ROWS UNBOUNDED PRECEDING))"""


def flow_table_raw(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flow table in need of cleaning: infinities, gaps, copies, negatives, label spellings."""
    li = table(spark, path, "lineitem")
    c = F.col
    no, qty, price, tax, disc = (
        c("l_linenumber"), c("l_quantity"), c("l_extendedprice"), c("l_tax"), c("l_discount"),
    )
    # As in the SQL: dividing by zero gives an infinity or NaN, and whole numbers come by rounding.
    rate = F.when(qty == 0, price * F.pow(qty, F.lit(-1.0))).otherwise(price / qty)
    label = (
        F.when((no == 7) & (qty <= 10), "bots")
        .when(c("l_returnflag") == "N", "Normal Traffic")
        .when((c("l_returnflag") == "A") & (c("l_linestatus") == "F"), "D-DoS")
        .when(c("l_returnflag") == "A", "DDoS")
        .when(no == 1, "DoS")
        .when(no == 2, "PORT_SCANNING")
        .otherwise("Port Scanning")
    )
    rows = li.select(
        (c("l_partkey") % 1024).alias(" Destination Port"),
        F.when((no == 7) & (qty < 3), -price).otherwise(price).alias("Flow Duration "),
        F.rint(qty).cast("long").alias("Total Fwd Packets"),
        (qty * 2.5).alias("Total Length of Fwd Packets"),
        F.when((qty == 50) & (tax > 0.07), F.lit(float("inf"))).otherwise(rate).alias("Flow Bytes/s"),
        (tax * 100).alias("Fwd Packets/s"),
        F.when((qty == 49) & (no == 4), F.lit(float("nan"))).otherwise(disc * 10).alias("Flow IAT Mean"),
        F.when((qty == 48) & (no == 5), F.lit(None)).otherwise(disc * tax).alias("Flow IAT Std"),
        F.when((qty == 47) & (no == 6), -disc).otherwise(disc * 20).alias("Flow IAT Max"),
        (tax + 40).alias("Fwd Packet Length Mean"),
        F.when(no > 2, F.lit(0.0)).otherwise(tax).alias("Fwd Packet Length Std"),
        F.lit(40.0).alias("Fwd Packet Length Min"),
        label.alias("Attack Type"),
        c("l_orderkey").alias("extra"),
        no.alias("_no"),
    )
    return rows.unionAll(rows.where(F.col("_no") == 3)).drop("_no")


FLOW_RAW_SQL = """
li AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 3),
raw AS (
  SELECT l_partkey % 1024 AS "Destination Port",
         CASE WHEN l_linenumber = 7 AND l_quantity < 3 THEN -l_extendedprice ELSE l_extendedprice END AS "Flow Duration",
         CAST(l_quantity AS BIGINT) AS "Total Fwd Packets", l_quantity * 2.5 AS "Total Length of Fwd Packets",
         CASE WHEN l_quantity = 50 AND l_tax > 0.07 THEN CAST('inf' AS DOUBLE) ELSE l_extendedprice / l_quantity END AS "Flow Bytes/s",
         l_tax * 100 AS "Fwd Packets/s",
         CASE WHEN l_quantity = 49 AND l_linenumber = 4 THEN CAST('nan' AS DOUBLE) ELSE l_discount * 10 END AS "Flow IAT Mean",
         CASE WHEN l_quantity = 48 AND l_linenumber = 5 THEN NULL ELSE l_discount * l_tax END AS "Flow IAT Std",
         CASE WHEN l_quantity = 47 AND l_linenumber = 6 THEN -l_discount ELSE l_discount * 20 END AS "Flow IAT Max",
         l_tax + 40 AS "Fwd Packet Length Mean",
         CASE WHEN l_linenumber > 2 THEN 0.0::DOUBLE ELSE l_tax END AS "Fwd Packet Length Std",
         40.0::DOUBLE AS "Fwd Packet Length Min",
         CASE WHEN l_linenumber = 7 AND l_quantity <= 10 THEN 'bots' WHEN l_returnflag = 'N' THEN 'Normal Traffic'
              WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'D-DoS' WHEN l_returnflag = 'A' THEN 'DDoS'
              WHEN l_linenumber = 1 THEN 'DoS' WHEN l_linenumber = 2 THEN 'PORT_SCANNING' ELSE 'Port Scanning' END AS "Attack Type",
         l_orderkey AS extra
  FROM li)"""

_VECTOR = ", ".join(f'"{c}"' for c in [*S.FLOW_TABLE_FIELDS, S.TARGET])
_FLOATS = [n for n, t in S.FLOW_TABLE_FIELDS.items() if t.simpleString() == "double"]
_FINITE = " AND ".join(f'NOT coalesce(isinf("{c}"), false)' for c in _FLOATS)
_WHOLE = " AND ".join(f'"{c}" IS NOT NULL AND NOT isnan("{c}")' for c in _FLOATS)
LABEL_SQL = (
    "CASE lower(regexp_replace(\"Attack Type\", '[\\s_\\-]', '', 'g')) WHEN 'normaltraffic' THEN 'Normal Traffic' "
    "WHEN 'portscanning' THEN 'Port Scanning' WHEN 'ddos' THEN 'DDoS' WHEN 'bots' THEN 'Bots' END"
)
CLEAN_SQL = f"""{FLOW_RAW_SQL},
vec AS (SELECT {_VECTOR} FROM raw),
fin AS (SELECT * FROM vec WHERE {_FINITE}),
whole AS (SELECT * FROM fin WHERE {_WHOLE}),
uniq AS (SELECT DISTINCT * FROM whole),
cl AS (SELECT * REPLACE ({LABEL_SQL} AS "Attack Type") FROM uniq WHERE {LABEL_SQL} IS NOT NULL)"""


HOST = "^https?://([^/:]+)"


def ranked_hosts(spark: SparkSession, path: str) -> DataFrame:
    """Benign list lines: page hosts in page order."""
    pages = table(spark, path, "pages")
    return pages.select(F.col("page_id").alias("line_no"), F.regexp_extract("url", HOST, 1).alias("domain"))


def hashed_names() -> Column:
    digest = F.md5(F.col("event_id").cast("string"))
    length = (F.col("event_id") % 8 + 8).cast("int")
    return F.concat(F.substring(digest, F.lit(1), length), F.lit(".biz"))


def malicious_domains(spark: SparkSession, path: str) -> DataFrame:
    """Generated-looking names, one per event."""
    return table(spark, path, "events").select(hashed_names().alias("domain"))


DOMAINS_SQL = f"""
hosts AS (SELECT page_id AS line_no, lower(regexp_extract(url, '{HOST}', 1)) AS domain FROM pages),
rk AS (SELECT row_number() OVER (ORDER BY line_no) AS position, domain
       FROM (SELECT domain, min(line_no) AS line_no FROM hosts GROUP BY domain)
       WHERE contains(domain, '.') AND length(domain) >= 4),
bad AS (SELECT DISTINCT substr(md5(CAST(event_id AS VARCHAR)), 1, CAST(event_id % 8 + 8 AS INT)) || '.biz' AS domain FROM events)"""


def dns_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query log: errors ask for generated names, sign-ups for overlong labels, the rest for page hosts."""
    pages = table(spark, path, "pages")
    size = pages.agg(F.count(F.lit(1))).scalar()
    hosts = pages.select(F.col("page_id").alias("_page"), F.regexp_extract("url", HOST, 1).alias("_host"))
    rows = events(spark, path, FLOW_SCALE).withColumn("_page", F.col("event_id") % size).join(hosts, "_page", "left")
    long_name = F.concat(F.md5(F.col("event_id").cast("string")), F.lit(".x.example.com"))
    domain = (
        F.when(F.col("event_type") == "error", hashed_names())
        .when(F.col("event_type") == "signup", long_name)
        .otherwise(F.col("_host"))
    )
    return rows.select(
        F.col("event_id").alias("seq"),
        domain.alias("domain"),
        F.lit("A").alias("query_type"),
        "timestamp",
        "t_us",
        source().alias("src_ip"),
    )


QUERY_LOG_SQL = f"""dq AS (
  SELECT e.event_id AS seq, epoch_us(e.ts) // {FLOW_SCALE} AS t_us, 'h' || CAST(user_id // 15 AS VARCHAR) AS src_ip,
         CASE event_type
           WHEN 'error' THEN substr(md5(CAST(event_id AS VARCHAR)), 1, CAST(event_id % 8 + 8 AS INT)) || '.biz'
           WHEN 'signup' THEN md5(CAST(event_id AS VARCHAR)) || '.x.example.com'
           ELSE regexp_extract(p.url, '{HOST}', 1) END AS domain
  FROM events e LEFT JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""
QUERIES_SQL = f"{DOMAINS_SQL}, {QUERY_LOG_SQL}"


def handshakes(spark: SparkSession, path: str) -> DataFrame:
    """TLS hellos whose fields come from order lines; grease values are mixed in."""
    li = table(spark, path, "lineitem")
    no, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    i = lambda e: e.cast("int")
    return li.select(
        "l_orderkey",
        no.alias("l_linenumber"),
        F.when(no == 7, "http").when(no == 6, "quic").otherwise("tls").alias("transport"),
        F.when(F.col("l_returnflag") == "R", "server").otherwise("client").alias("role"),
        F.when(F.col("l_quantity") == 50, F.lit(None)).when(no == 6, 772).otherwise(771).cast("int").alias("tls_version"),
        F.array(F.lit(0x0A0A), i(part % 5 + 4865), F.lit(49195), F.lit(0xFAFA)).alias("cipher_suites"),
        F.array(F.lit(0), F.lit(0x3A3A), i(no + 10), F.lit(23)).alias("extensions"),
        F.array(F.lit(29), i(supp % 3 + 23)).alias("elliptic_curves"),
        F.array(F.lit(0)).alias("ec_point_formats"),
        F.when(F.col("l_tax") > 0.01, i(part % 5 + 4865)).alias("chosen_cipher"),
    )


def fingerprint_list(spark: SparkSession, path: str) -> DataFrame:
    """Known-bad fingerprints: server hellos of some cipher and extension choices, one per supplier."""
    s = F.col("s_suppkey")
    text = F.concat(
        F.lit("771,"), (s % 5 + 4865).cast("string"), F.lit(",0-"), (s % 2 + 11).cast("string"), F.lit("-23")
    )
    return table(spark, path, "supplier").select(F.md5(text).alias("ja3_md5")).distinct()


TLS_SQL = """
bl AS (SELECT DISTINCT md5('771,' || CAST(s_suppkey % 5 + 4865 AS VARCHAR) || ',0-' || CAST(s_suppkey % 2 + 11 AS VARCHAR) || '-23') AS ja3_md5 FROM supplier),
hs AS (
  SELECT l_orderkey, l_linenumber,
         CASE l_linenumber WHEN 7 THEN 'http' WHEN 6 THEN 'quic' ELSE 'tls' END AS transport,
         CASE WHEN l_returnflag = 'R' THEN 'server' ELSE 'client' END AS role,
         CASE WHEN l_quantity = 50 THEN NULL WHEN l_linenumber = 6 THEN 772 ELSE 771 END AS tls_version,
         CAST(l_partkey % 5 + 4865 AS VARCHAR) AS c1, CAST(l_linenumber + 10 AS VARCHAR) AS x1,
         CAST(l_suppkey % 3 + 23 AS VARCHAR) AS e1, l_tax > 0.01 AS has_cipher
  FROM lineitem),
fp AS (
  SELECT *, CASE WHEN transport = 'http' OR tls_version IS NULL THEN NULL
              WHEN role = 'client' THEN md5(CAST(tls_version AS VARCHAR) || ',' || c1 || '-49195,0-' || x1 || '-23,29-' || e1 || ',0')
              ELSE md5(CAST(tls_version AS VARCHAR) || ',' || CASE WHEN has_cipher THEN c1 ELSE '' END || ',0-' || x1 || '-23') END AS fingerprint
  FROM hs)"""


SIGNAL_BY_EVENT = {
    "error": S.ML_SIGNAL,
    "signup": S.DNS_SIGNAL,
    "purchase": S.TLS_SIGNAL,
    "click": S.BEHAVIORAL_SIGNAL,
}


def signals(spark: SparkSession, path: str) -> DataFrame:
    """Branch signals per user; views give none."""
    kind = F.create_map(*[F.lit(x) for pair in SIGNAL_BY_EVENT.items() for x in pair])
    return (
        events(spark, path, FUSION_SCALE)
        .select(
            F.col("user_id").cast("string").alias("source_ip"),
            F.col("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            F.element_at(kind, F.col("event_type")).alias("signal_type"),
            F.concat(F.lit("f_"), F.col("event_id").cast("string")).alias("flow_id"),
            F.col("event_type").alias("detail"),
            F.col("props").alias("evidence"),
        )
        .where(F.col("signal_type").isNotNull())
    )


_KIND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNAL_BY_EVENT.items())
SIGNALS_SQL = f"""
sg AS (SELECT CAST(user_id AS VARCHAR) AS source_ip, epoch_us(ts) // {FUSION_SCALE} AS t, event_id AS seq,
              CASE event_type {_KIND_SQL} END AS signal_type, 'f_' || CAST(event_id AS VARCHAR) AS flow_id
       FROM events WHERE event_type <> 'view')"""


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Outbound volume per user; purchases are long and slow."""
    slow = F.col("event_type") == "purchase"
    return events(spark, path).select(
        F.col("user_id").cast("string").alias("source_ip"),
        "timestamp",
        F.col("event_id").alias("flow_id"),
        F.col("value").alias("byte_count"),
        F.when(slow, F.col("value") * 100).otherwise(F.col("value")).alias("flow_duration"),
        F.when(slow, F.lit(1.5)).otherwise(F.lit(20.0)).alias("pps"),
        F.col("event_type").alias("dest_ip"),
    )
