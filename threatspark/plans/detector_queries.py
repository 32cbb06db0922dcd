"""Queries on DNS, TLS and behaviour detection, record files and reference lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatspark.functions import text as X
from threatspark.operators import alerts as A, behavior as B, dns as N, flows as FL, tls as TL
from threatspark.plans import adapters as D
from threatspark.plans.registry import query, rounded
from threatspark.sources import feeds, records


# --- record files: lines are written by Spark from the tables, some of them damaged -----------------------
def _packet_lines(spark, path):
    rows = D.packets(spark, path)
    body = F.to_json(
        F.struct(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            "src_ip",
            "dst_ip",
            "src_port",
            F.when(F.col("dst_port") == 11, 70000).otherwise(F.col("dst_port")).alias("dst_port"),
            F.when(F.col("dst_port") == 9, "ICMP").otherwise(F.col("protocol")).alias("protocol"),
            F.when(F.col("dst_port") == 7, -1).otherwise(F.col("packet_size")).alias("packet_size"),
            F.when(F.col("syn_flag"), True).alias("syn_flag"),
        )
    )
    line = F.when(F.col("dst_port") == 5, F.lit("{\"timestamp\": ")).when(F.col("dst_port") == 3, F.lit("  ")).otherwise(body)
    return rows.select(line.alias("value"))


@query(
    "packet_record_checks",
    f"""WITH {D.PACKETS_SQL} SELECT CASE dst_port WHEN 5 THEN 'malformed line' WHEN 11 THEN 'dst_port out of range' WHEN 9 THEN 'protocol unknown'
      WHEN 7 THEN 'packet_size negative' ELSE 'ok' END AS reason, count(*) AS lines,
      CAST(count(*) FILTER (WHERE syn_flag AND dst_port <> 5) AS BIGINT) AS syn_packets FROM pk WHERE dst_port <> 3 GROUP BY 1""",
)
def packet_record_checks(spark, path):
    rows = records.parse_packets(_packet_lines(spark, path))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("syn_flag").alias("syn_packets")
    )


@query(
    "packet_load_summary",
    f"WITH {D.PACKETS_SQL} SELECT count(*) FILTER (WHERE dst_port NOT IN (5, 7, 9, 11)) AS accepted, count(*) FILTER (WHERE dst_port IN (5, 7, 9, 11)) AS rejected FROM pk WHERE dst_port <> 3",
)
def packet_load_summary(spark, path):
    return records.load_summary(records.parse_packets(_packet_lines(spark, path)))


@query(
    "dns_record_checks",
    f"WITH {D.QUERIES_SQL} SELECT CASE WHEN seq % 11 = 0 THEN 'timestamp unreadable' WHEN seq % 13 = 0 THEN 'src_ip missing' ELSE 'ok' END AS reason, count(*) AS lines FROM dq GROUP BY 1",
)
def dns_record_checks(spark, path):
    rows = D.dns_queries(spark, path)
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    broken_time, no_source = F.col("seq") % 11 == 0, (F.col("seq") % 13 == 0) & (F.col("seq") % 11 != 0)
    body = F.struct(
        "domain",
        "query_type",
        F.when(broken_time, "yesterday").otherwise(ts).alias("timestamp"),
        F.when(~no_source, F.col("src_ip")).alias("src_ip"),
    )
    parsed = records.parse_dns_queries(rows.select(F.to_json(body).alias("value")))
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "tls_record_checks",
    f"""WITH {D.TLS_SQL} SELECT CASE WHEN fingerprint IS NULL THEN 'fingerprint missing' WHEN transport = 'http' THEN 'transport unknown' ELSE 'ok' END AS reason, count(*) AS lines FROM fp GROUP BY 1""",
)
def tls_record_checks(spark, path):
    rows = TL.fingerprint_handshakes(D.handshakes(spark, path))
    body = F.struct(
        "fingerprint",
        "transport",
        "role",
        F.lit("2026-01-01T00:00:00Z").alias("timestamp"),
        F.col("l_orderkey").cast("string").alias("src_ip"),
    )
    parsed = records.parse_tls_sessions(rows.select(F.to_json(body).alias("value")))
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


# --- reference lists --------------------------------------------------------------------------------------------
@query(
    "blocklist_feed",
    f"WITH {D.DOMAINS_SQL} SELECT domain FROM (SELECT DISTINCT domain FROM hosts WHERE line_no % 10 <> 0) WHERE contains(domain, '.') AND length(domain) >= 4",
)
def blocklist_feed(spark, path):
    hosts = D.ranked_hosts(spark, path)
    line = F.when(F.col("line_no") % 10 == 0, F.concat(F.lit("# "), F.col("domain"))).otherwise(
        F.concat(F.lit(" "), F.upper("domain"), F.lit(",2026-01-01,feed"))
    )
    return feeds.parse_blocklist(hosts.select(line.alias("value")))


@query("ranked_domains", f"WITH {D.DOMAINS_SQL} SELECT position, domain FROM rk")
def ranked_domains(spark, path):
    return feeds.rank_domains(D.ranked_hosts(spark, path))


@query("ranked_domains_top", f"WITH {D.DOMAINS_SQL} SELECT position, domain FROM rk WHERE position <= 25")
def ranked_domains_top(spark, path):
    return N.allowlist(feeds.rank_domains(D.ranked_hosts(spark, path)), 25)


@query("fingerprint_feed", f"WITH {D.TLS_SQL} SELECT ja3_md5 FROM bl")
def fingerprint_feed(spark, path):
    rows = D.fingerprint_list(spark, path).select(F.col("ja3_md5").alias("ja3_md5 "), F.lit("x").alias("Listingreason"))
    return feeds.parse_fingerprints(rows)


# --- DNS ------------------------------------------------------------------------------------------------------------
def _rated(spark, path):
    return N.query_rates(D.dns_queries(spark, path), seq="seq")


_NGRAM = f"""{D.DOMAINS_SQL},
lb AS (SELECT split_part(domain, '.', 1) AS label FROM rk),
gr AS (SELECT substr(label, CAST(i AS INT), 2) AS gram FROM (SELECT label, unnest(range(1, length(label))) AS i FROM lb)),
gc AS (SELECT gram, count(*) AS c FROM gr GROUP BY gram),
tv AS (SELECT sum(c) + count(*) AS size FROM gc),
md AS (SELECT gram, ln((c + 1) / (SELECT size FROM tv)) AS logp FROM gc UNION ALL SELECT '__UNSEEN__', ln(1 / size) FROM tv),
names AS (SELECT domain, true AS malicious FROM bad UNION ALL SELECT domain, false FROM rk),
ls AS (SELECT DISTINCT split_part(domain, '.', 1) AS label FROM names),
lg AS (SELECT label, substr(label, CAST(i AS INT), 2) AS gram FROM (SELECT label, unnest(range(1, length(label))) AS i FROM ls)),
nl AS (SELECT label, avg(coalesce(logp, (SELECT ln(1 / size) FROM tv))) AS ngram_score FROM lg LEFT JOIN md USING (gram) GROUP BY label),
ch AS (SELECT domain, unnest(string_split(replace(domain, '.', ''), '')) AS c FROM names),
cc AS (SELECT domain, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY domain, c),
en AS (SELECT domain, -sum(k / length(replace(domain, '.', '')) * log2(k / length(replace(domain, '.', '')))) AS entropy FROM cc GROUP BY domain),
ds AS (SELECT n.domain, malicious, entropy, coalesce(ngram_score, (SELECT ln(1 / size) FROM tv)) AS ngram_score
       FROM names n LEFT JOIN en ON en.domain = n.domain LEFT JOIN nl ON nl.label = split_part(n.domain, '.', 1))"""


def _names(spark, path):
    bad = D.malicious_domains(spark, path).distinct()
    good = feeds.rank_domains(D.ranked_hosts(spark, path))
    return bad, good


def _scores(spark, path):
    bad, good = _names(spark, path)
    both = bad.select("domain", F.lit(True).alias("malicious")).unionByName(
        good.select("domain", F.lit(False).alias("malicious"))
    )
    return both.join(N.score_domains(both, N.ngram_model(good, check=False)), "domain")


@query("ngram_model", f"WITH {_NGRAM} SELECT gram, round(logp, 6) AS logp FROM md")
def ngram_model(spark, path):
    return rounded(N.ngram_model(_names(spark, path)[1]))


@query("domain_scores", f"WITH {_NGRAM} SELECT domain, malicious, round(entropy, 6) AS entropy, round(ngram_score, 6) AS ngram_score FROM ds")
def domain_scores(spark, path):
    return rounded(_scores(spark, path))


@query(
    "domain_score_summary",
    f"WITH {_NGRAM} SELECT malicious, round(avg(entropy), 6) AS mean, round(stddev_pop(entropy), 6) AS std, count(*) AS domains FROM ds GROUP BY 1",
)
def domain_score_summary(spark, path):
    return rounded(N.score_summary(_scores(spark, path), "entropy"))


@query("host_entropy", "WITH h AS (SELECT DISTINCT replace(url, 'http', '') AS url FROM pages), c AS (SELECT url, unnest(string_split(replace(url, '.', ''), '')) AS c FROM h), k AS (SELECT url, c, count(*) AS k FROM c WHERE c <> '' GROUP BY 1, 2) SELECT url, round(-sum(k / length(replace(url, '.', '')) * log2(k / length(replace(url, '.', '')))), 6) AS entropy FROM k GROUP BY url")
def host_entropy(spark, path):
    urls = D.table(spark, path, "pages").select(F.replace("url", F.lit("http"), F.lit("")).alias("url")).distinct()
    return rounded(urls.select("url", X.shannon_entropy(F.col("url")).alias("entropy")))


@query("label_ngrams", f"WITH {D.DOMAINS_SQL} SELECT domain, gram, count(*) AS n FROM (SELECT domain, substr(split_part(domain, '.', 1), CAST(i AS INT), 3) AS gram FROM (SELECT domain, unnest(range(1, length(split_part(domain, '.', 1)) - 1)) AS i FROM rk)) GROUP BY 1, 2")
def label_ngrams(spark, path):
    names = feeds.rank_domains(D.ranked_hosts(spark, path))
    grams = names.select("domain", F.explode(X.ngrams(X.first_label(F.col("domain")), 3)).alias("gram"))
    return grams.groupBy("domain", "gram").agg(F.count(F.lit(1)).alias("n"))


@query(
    "domain_suffixes",
    f"""WITH {D.DOMAINS_SQL}, s AS (SELECT domain, string_split(domain, '.') AS p FROM rk)
    SELECT domain, domain AS suffix FROM s UNION ALL
    SELECT domain, array_to_string(p[i + 1:], '.') FROM (SELECT domain, p, unnest(range(1, len(p) - 1)) AS i FROM s)""",
)
def domain_suffixes(spark, path):
    names = feeds.rank_domains(D.ranked_hosts(spark, path))
    return names.select("domain", F.explode(X.suffixes(F.col("domain"))).alias("suffix"))


@query(
    "longest_labels",
    f"""WITH {D.QUERIES_SQL}, n AS (SELECT DISTINCT lower(domain) AS domain FROM dq), x AS (SELECT domain, unnest(string_split(domain, '.')[:-3]) AS l FROM n)
    SELECT n.domain, CAST(coalesce(max(length(l)), 0) AS INT) AS longest FROM n LEFT JOIN x ON x.domain = n.domain GROUP BY n.domain""",
)
def longest_labels(spark, path):
    names = D.dns_queries(spark, path).select(X.clean_domain(F.col("domain")).alias("domain")).distinct()
    return names.select("domain", X.longest_subdomain_label(F.col("domain")).alias("longest"))


@query("blocklisted_queries", f"WITH {D.QUERIES_SQL} SELECT seq, domain IN (SELECT domain FROM bad) AS listed FROM dq")
def blocklisted_queries(spark, path):
    bad = D.malicious_domains(spark, path)
    return TL.mark_listed(D.dns_queries(spark, path), "domain", bad, "domain", "listed").select("seq", "listed")


_ALLOWED = """al AS (SELECT domain FROM rk WHERE position <= 25),
  sx AS (SELECT domain, domain AS s FROM nm UNION ALL SELECT domain, array_to_string(p[i + 1:], '.') FROM
     (SELECT domain, p, unnest(range(1, len(p) - 1)) AS i FROM (SELECT domain, string_split(domain, '.') AS p FROM nm))),
  ok AS (SELECT DISTINCT domain FROM sx WHERE s IN (SELECT domain FROM al))"""


@query(
    "allowlisted_domains",
    f"WITH {D.QUERIES_SQL}, nm AS (SELECT DISTINCT 'cdn.' || lower(domain) AS domain FROM dq), {_ALLOWED} SELECT domain, domain IN (SELECT domain FROM ok) AS allowed FROM nm",
)
def allowlisted_domains(spark, path):
    names = D.dns_queries(spark, path).select(F.concat(F.lit("cdn."), X.clean_domain(F.col("domain"))).alias("domain"))
    good = feeds.rank_domains(D.ranked_hosts(spark, path))
    return N.mark_allowed(names.distinct(), N.allowlist(good, 25))


def _sweep(column, higher, weight):
    order = "sum(bad) OVER (ORDER BY score) AS bu, sum(good) OVER (ORDER BY score) AS gu, sum(bad) OVER () AS ab, sum(good) OVER () AS ag"
    tp, tn = ("ab - bu + bad", "gu - good") if higher else ("bu", "ag - gu")
    return f"""(SELECT score AS threshold, ({tp} + {tn}) / (ab + ag) AS accuracy FROM (SELECT *, {order} FROM (
      SELECT round({column}, 6) AS score, count(*) FILTER (WHERE malicious) AS bad, count(*) FILTER (WHERE NOT malicious) AS good FROM ds GROUP BY 1))
      ORDER BY ({tp} + {weight}::DOUBLE * ({tn})) / (ab + {weight}::DOUBLE * ag) DESC, score LIMIT 1)"""


@query("entropy_threshold", f"WITH {_NGRAM} SELECT round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM {_sweep('entropy', True, 1.5)}")
def entropy_threshold(spark, path):
    scores = _scores(spark, path).select(F.round("entropy", 6).alias("score"), "malicious")
    return rounded(N.calibrate_threshold(scores, benign_weight=1.5))


@query("ngram_threshold", f"WITH {_NGRAM} SELECT round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM {_sweep('ngram_score', False, 1)}")
def ngram_threshold(spark, path):
    scores = _scores(spark, path).select(F.round("ngram_score", 6).alias("score"), "malicious")
    return rounded(N.calibrate_threshold(scores, higher_is_malicious=False))


@query(
    "dns_calibration",
    f"""WITH {_NGRAM} SELECT 'entropy' AS measure, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM {_sweep('entropy', True, 1.5)}
    UNION ALL SELECT 'ngram', round(threshold, 6), round(accuracy, 6) FROM {_sweep('ngram_score', False, 1)}""",
)
def dns_calibration(spark, path):
    bad, good = _names(spark, path)
    return rounded(N.calibrate(bad, good, decimals=6).thresholds)


# Generated names of small error events stay off the list, so that scoring has work to do.
_VERDICTS = f"""{_NGRAM}, {D.QUERY_LOG_SQL},
listed AS (SELECT DISTINCT substr(md5(CAST(event_id AS VARCHAR)), 1, CAST(event_id % 8 + 8 AS INT)) || '.biz' AS domain FROM events WHERE value > 40),
nm AS (SELECT DISTINCT lower(trim(domain)) AS domain FROM dq), {_ALLOWED},
vd AS (SELECT domain, CASE WHEN NOT contains(domain, '.') THEN 'invalid_domain' WHEN domain IN (SELECT domain FROM listed) THEN 'blocklist_match'
         WHEN domain IN (SELECT domain FROM ok) THEN 'allowlisted' END AS decided, split_part(domain, '.', 1) AS label FROM nm),
vl AS (SELECT label, avg(coalesce(logp, (SELECT ln(1 / size) FROM tv))) AS s FROM
  (SELECT label, substr(label, CAST(i AS INT), 2) AS gram FROM (SELECT label, unnest(range(1, length(label))) AS i FROM (SELECT DISTINCT label FROM vd)))
  LEFT JOIN md USING (gram) GROUP BY label),
ve AS (SELECT domain, -sum(k / n * log2(k / n)) AS e FROM (SELECT domain, c, length(replace(domain, '.', '')) AS n, count(*) AS k
   FROM (SELECT domain, unnest(string_split(replace(domain, '.', ''), '')) AS c FROM nm) WHERE c <> '' GROUP BY 1, 2) GROUP BY domain),
vs AS (SELECT vd.domain, decided, CASE WHEN decided IS NULL THEN e END AS e, CASE WHEN decided IS NULL THEN coalesce(s, (SELECT ln(1 / size) FROM tv)) END AS s
   FROM vd LEFT JOIN ve ON ve.domain = vd.domain LEFT JOIN vl ON vl.label = vd.label),
dv AS (SELECT domain, round(e, 3) AS entropy, round(s, 3) AS ngram_score,
   coalesce(decided, CASE WHEN e >= 3.100007 AND s <= -5.000007 THEN 'entropy+ngram' WHEN e >= 3.100007 OR s <= -5.000007 THEN 'entropy_or_ngram' END) AS reason FROM vs),
dw AS (SELECT *, CASE reason WHEN 'blocklist_match' THEN 1.0 WHEN 'entropy+ngram' THEN 0.9 WHEN 'entropy_or_ngram' THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM dv)"""
ENTROPY_LIMIT, NGRAM_LIMIT = 3.100007, -5.000007


def _verdicts(spark, path):
    bad, good = _names(spark, path)
    listed = D.table(spark, path, "events").where("value > 40").select(D.hashed_names().alias("domain"))
    model = N.ngram_model(good, check=False)
    return N.classify_domains(
        D.dns_queries(spark, path), listed, model, ENTROPY_LIMIT, NGRAM_LIMIT, N.allowlist(good, 25)
    )


@query(
    "domain_verdicts",
    f"WITH {_VERDICTS} SELECT domain, confidence > 0 AS flagged, coalesce(reason, 'none') AS reason, coalesce(entropy, 0) AS entropy, coalesce(ngram_score, 0) AS ngram_score, confidence FROM dw",
)
def domain_verdicts(spark, path):
    out = _verdicts(spark, path).withColumns(
        {
            "reason": F.coalesce("reason", F.lit("none")),
            "entropy": F.coalesce("entropy", F.lit(0.0)),
            "ngram_score": F.coalesce("ngram_score", F.lit(0.0)),
        }
    )
    return rounded(out)


_RATE = """count(*) OVER (PARTITION BY src_ip ORDER BY t_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"""


@query(
    "dns_query_rates",
    f"""WITH {D.QUERIES_SQL} SELECT seq, {_RATE.format(w=5000000)} - count(*) OVER (PARTITION BY src_ip, t_us ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS recent_queries FROM dq""",
)
def dns_query_rates(spark, path):
    return _rated(spark, path).select("seq", "recent_queries")


@query("dns_query_rates_open_edge", f"WITH {D.QUERIES_SQL} SELECT seq, {_RATE.format(w=4999999)} AS recent_queries FROM dq")
def dns_query_rates_open_edge(spark, path):
    rows = N.query_rates(D.dns_queries(spark, path), seq="seq", closed="right", peers=True)
    return rows.select("seq", "recent_queries")


_TUNNEL = f"""tq AS (SELECT *, {_RATE.format(w=5000000)} - count(*) OVER (PARTITION BY src_ip, t_us ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) >= 20 AS hi,
   {{longest}} >= 30 AS lo FROM dq)"""
# Only the sign-up names have an inner label, and it is 32 characters long; hosts have one of at most 10.
_TUNNEL_SQL = _TUNNEL.format(longest="length(CASE WHEN domain LIKE '%.x.example.com' THEN split_part(domain, '.', 1) ELSE '' END)")


@query("dns_tunneling", f"WITH {D.QUERIES_SQL}, {_TUNNEL_SQL} SELECT seq, hi AS high_query_rate, lo AS long_subdomain FROM tq")
def dns_tunneling(spark, path):
    rows = N.detect_tunneling(D.dns_queries(spark, path), seq="seq")
    return rows.select("seq", "high_query_rate", "long_subdomain")


_CLASSIFIED = f"""{_VERDICTS}, {_TUNNEL_SQL},
  tr AS (SELECT tq.*, w.reason AS dr, coalesce(w.confidence, 0) AS dc, coalesce(w.entropy, 0) AS entropy_score, coalesce(w.ngram_score, 0) AS ngram_score,
    CASE WHEN hi AND lo THEN 'high_query_rate+long_subdomain' WHEN hi THEN 'high_query_rate' WHEN lo THEN 'long_subdomain' END AS trs,
    CASE WHEN hi AND lo THEN 0.95 WHEN hi THEN 0.8 WHEN lo THEN 0.7 ELSE 0.0 END::DOUBLE AS tc FROM tq LEFT JOIN dw w ON w.domain = lower(trim(tq.domain))),
  cq AS (SELECT *, dc > 0 OR hi OR lo AS flagged, CASE WHEN dc > 0 OR trs IS NOT NULL THEN concat_ws('+', CASE WHEN dc > 0 THEN dr END, trs) ELSE coalesce(dr, 'clean') END AS reason,
    greatest(dc, tc) AS confidence, CASE WHEN dc > 0 THEN 'DGA' WHEN hi OR lo THEN 'DNS_TUNNELING' ELSE 'none' END AS dns_flag FROM tr)"""


def _classified(spark, path):
    return N.classify_queries(D.dns_queries(spark, path), _verdicts(spark, path), seq="seq")


@query("dns_query_verdicts", f"WITH {_CLASSIFIED} SELECT seq, flagged, reason, confidence, entropy_score, ngram_score, dns_flag FROM cq")
def dns_query_verdicts(spark, path):
    out = _classified(spark, path).withColumn("dns_flag", F.coalesce("dns_flag", F.lit("none")))
    return rounded(out.select("seq", "flagged", "reason", "confidence", "entropy_score", "ngram_score", "dns_flag"))


@query(
    "dns_alerts",
    f"""WITH {_CLASSIFIED}, d AS (SELECT *, 'dns_' || md5(src_ip || '|' || domain || '|' || CAST(seq AS VARCHAR)) AS flow_id FROM cq WHERE flagged)
    SELECT 'a_' || md5(flow_id || '|DGA_DNS_TUNNELING|dga-tunneling-v1') AS alert_id, t_us AS ts_us, flow_id, 'DGA_DNS_TUNNELING' AS threat_class,
      CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity, confidence,
      'DNS query for ' || domain || ' (A) from ' || src_ip AS traffic FROM d""",
)
def dns_alerts(spark, path):
    rows = _classified(spark, path).withColumn("flow_id", A.record_flow_id("dns_", "src_ip", "domain", "seq"))
    out = A.dns_alerts(rows)
    return out.select(
        "alert_id",
        F.unix_micros("timestamp").alias("ts_us"),
        "flow_id",
        "threat_class",
        "severity",
        "confidence",
        F.col("evidence.traffic").alias("traffic"),
    )


@query(
    "dns_metadata_flows",
    f"""WITH {D.QUERIES_SQL} SELECT 'dns_' || md5(src_ip || '|' || domain || '|' || CAST(seq AS VARCHAR)) AS flow_id, t_us AS ts_us, src_ip, '' AS dst_ip,
      CAST(0 AS BIGINT) AS src_port, CAST(53 AS BIGINT) AS dst_port, 'DNS' AS protocol, CAST(1 AS BIGINT) AS packet_count FROM dq""",
)
def dns_metadata_flows(spark, path):
    rows = D.dns_queries(spark, path).withColumn("flow_id", A.record_flow_id("dns_", "src_ip", "domain", "seq"))
    out = FL.metadata_flows(rows, A.DNS_PROTOCOL, 53)
    return out.select(
        "flow_id", F.unix_micros("timestamp").alias("ts_us"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count"
    )


# --- TLS -----------------------------------------------------------------------------------------------------------
@query("tls_fingerprints", f"WITH {D.TLS_SQL} SELECT l_orderkey, l_linenumber, coalesce(fingerprint, '') AS fingerprint FROM fp")
def tls_fingerprints(spark, path):
    rows = TL.fingerprint_handshakes(D.handshakes(spark, path))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


_HANDSHAKE = f"""{D.TLS_SQL}, hv AS (SELECT *, CASE WHEN transport = 'http' THEN 'invalid_session' WHEN tls_version IS NULL THEN 'missing_tls_version'
    WHEN fingerprint IN (SELECT ja3_md5 FROM bl) THEN 'blocklist_match' ELSE 'clean' END AS reason FROM fp)"""


@query("tls_handshake_verdicts", f"WITH {_HANDSHAKE} SELECT transport, role, reason, count(*) AS sessions, count(DISTINCT fingerprint) AS fingerprints FROM hv GROUP BY 1, 2, 3")
def tls_handshake_verdicts(spark, path):
    rows = TL.analyze_handshakes(D.handshakes(spark, path), D.fingerprint_list(spark, path))
    return rows.groupBy("transport", "role", "reason").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct("fingerprint").alias("fingerprints")
    )


_SESSION = f"""{D.TLS_SQL}, sv AS (SELECT *, CASE WHEN transport NOT IN ('tls', 'quic') THEN 'invalid_transport' WHEN fingerprint IS NULL THEN 'invalid_fingerprint_format'
    WHEN fingerprint IN (SELECT ja3_md5 FROM bl) THEN 'blocklist_match' ELSE 'clean' END AS reason FROM fp)"""


def _sessions(spark, path):
    rows = TL.fingerprint_handshakes(D.handshakes(spark, path)).withColumns(
        {
            "fingerprint": F.concat(F.lit(" "), F.upper("fingerprint")),
            "src_ip": F.col("l_orderkey").cast("string"),
            "timestamp": F.timestamp_micros(F.col("l_orderkey")),
        }
    )
    return TL.classify_sessions(rows, D.fingerprint_list(spark, path))


@query("tls_session_verdicts", f"WITH {_SESSION} SELECT l_orderkey, l_linenumber, reason = 'blocklist_match' AS flagged, reason, CASE WHEN reason = 'blocklist_match' THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN reason = 'blocklist_match' THEN fingerprint ELSE '' END AS matched_hash FROM sv")
def tls_session_verdicts(spark, path):
    return _sessions(spark, path).select(
        "l_orderkey", "l_linenumber", "flagged", "reason", "confidence", F.coalesce("matched_hash", F.lit("")).alias("matched_hash")
    )


@query("malicious_fingerprints", f"WITH {D.TLS_SQL} SELECT coalesce(upper(fingerprint), '') AS fingerprint, count(*) AS sessions, coalesce(fingerprint IN (SELECT ja3_md5 FROM bl), false) AS malicious FROM fp GROUP BY fingerprint")
def malicious_fingerprints(spark, path):
    rows = TL.fingerprint_handshakes(D.handshakes(spark, path)).select(F.upper("fingerprint").alias("fingerprint"))
    counts = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("sessions"))
    return TL.is_malicious(counts, "fingerprint", D.fingerprint_list(spark, path)).withColumn(
        "fingerprint", F.coalesce("fingerprint", F.lit(""))
    )


@query(
    "tls_alerts",
    f"""WITH {_SESSION}, t AS (SELECT *, 'tls_' || md5(concat_ws('|', l_orderkey, l_linenumber, ' ' || upper(fingerprint))) AS flow_id FROM sv WHERE reason = 'blocklist_match')
    SELECT 'a_' || md5(flow_id || '|MALICIOUS_TLS|ja3-v1') AS alert_id, flow_id, 'HIGH' AS severity, 'MALICIOUS_TLS' AS threat_class,
      upper(transport) || ' ' || role || ' fingerprint  ' || upper(fingerprint) || ' from ' || CAST(l_orderkey AS VARCHAR) AS traffic,
      'JA3/JA3S fingerprint matched known-malicious blocklist entry ' || fingerprint AS ml FROM t""",
)
def tls_alerts(spark, path):
    rows = _sessions(spark, path).withColumn("flow_id", A.record_flow_id("tls_", "l_orderkey", "l_linenumber", "fingerprint"))
    out = A.tls_alerts(rows)
    return out.select(
        "alert_id", "flow_id", "severity", "threat_class", F.col("evidence.traffic").alias("traffic"), F.col("evidence.ml").alias("ml")
    )


# --- behaviour -----------------------------------------------------------------------------------------------------
_EWMA = """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS source_ip, event_id, event_type, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  st AS (SELECT source_ip, event_id, event_type, rn, x, CAST(NULL AS DOUBLE) AS pm, CAST(NULL AS DOUBLE) AS pv, x AS m, CAST(0 AS DOUBLE) AS v FROM o WHERE rn = 1
    UNION ALL SELECT o.source_ip, o.event_id, o.event_type, o.rn, o.x, st.m, st.v, st.m + 0.2::DOUBLE * (o.x - st.m), 0.8::DOUBLE * (st.v + 0.2::DOUBLE * (o.x - st.m) * (o.x - st.m))
    FROM st JOIN o ON o.source_ip = st.source_ip AND o.rn = st.rn + 1),
  z0 AS (SELECT *, CASE WHEN rn <= 10 THEN 0.0 WHEN pv > 0 THEN (x - pm) / sqrt(pv) WHEN x > pm THEN 999.0 ELSE 0.0 END AS zr FROM st),
  zs AS (SELECT *, greatest(-999.0, least(999.0, zr)) AS z FROM z0),
  bv AS (SELECT *, z > 3 AS drift, event_type = 'purchase' AND x * 100 > 3600 AS slow FROM zs)"""


def _behavior(spark, path):
    return B.classify_behavior(D.observations(spark, path))


@query(
    "volume_drift",
    f"{_EWMA} SELECT event_id, rn AS flow_count, CASE WHEN rn <= 10 THEN 'INSUFFICIENT_HISTORY' ELSE 'SCORED' END AS status, round(z, 6) AS z_score, drift, round(m, 6) AS ewma_mean, round(v, 6) AS ewma_variance FROM bv",
)
def volume_drift(spark, path):
    rows = B.score_drift(D.observations(spark, path), ["source_ip"], ["timestamp", "flow_id"], "byte_count")
    out = rows.select(F.col("flow_id").alias("event_id"), "flow_count", "status", "z_score", "drift", "ewma_mean", "ewma_variance")
    return rounded(out)


@query("behavior_verdicts", f"{_EWMA} SELECT event_id, drift, slow AS low_and_slow, drift OR slow AS alert_triggered, round(z, 6) AS z_score FROM bv")
def behavior_verdicts(spark, path):
    out = _behavior(spark, path)
    return rounded(
        out.select(
            F.col("flow_id").alias("event_id"),
            F.col("metrics.baseline_drift.triggered").alias("drift"),
            F.col("metrics.low_and_slow.triggered").alias("low_and_slow"),
            "alert_triggered",
            F.col("metrics.baseline_drift.z_score").alias("z_score"),
        )
    )


@query(
    "latest_baselines",
    f"{_EWMA} SELECT source_ip, rn AS flow_count, round(m, 6) AS ewma_mean, round(CASE WHEN v > 0 THEN sqrt(v) ELSE 0 END, 6) AS ewma_std FROM bv QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY rn DESC) = 1",
)
def latest_baselines(spark, path):
    rows = B.score_drift(D.observations(spark, path), ["source_ip"], ["timestamp", "flow_id"], "byte_count")
    return rounded(B.latest_baseline(rows, ["source_ip"], ["timestamp", "flow_id"]))


@query("cold_start_rows", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10 AS cold_start FROM events")
def cold_start_rows(spark, path):
    rows = B.cold_start_rows(D.observations(spark, path), ["source_ip"], ["timestamp", "flow_id"])
    return rows.select(F.col("flow_id").alias("event_id"), "cold_start")


@query("low_and_slow_flows", "SELECT event_id, event_type = 'purchase' AND value * 100 > 3600 AS low_and_slow FROM events")
def low_and_slow_flows(spark, path):
    rows = D.observations(spark, path)
    return rows.select(
        F.col("flow_id").alias("event_id"), B.is_low_and_slow(F.col("flow_duration"), F.col("pps")).alias("low_and_slow")
    )
