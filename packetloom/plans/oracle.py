"""The queries of the catalog as SQL over the same tables, for checking results."""

from __future__ import annotations

from packetloom.functions.protocols import IP_PROTOCOLS
from packetloom.plans.catalog import CORRELATED
from packetloom.plans.catalog_files import ALERT_HOST, ALERT_TIME
from packetloom.plans.tables import LINE_FEATURES, ORDER_FEATURES

HASH = "CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT)"

LINES = "lines AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"
ORDERS = (
    "ord AS (SELECT o_orderkey, o_totalprice, o_custkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label, "
    f"{HASH} AS h FROM orders)"
)


def _stats(source: str, features: list[str]) -> str:
    parts = [f"avg(CAST({f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST({f} AS DOUBLE)) AS s_{f}" for f in features]
    return f"SELECT {', '.join(parts)} FROM {source}"


def _z(feature: str) -> str:
    return f"((CAST({feature} AS DOUBLE) - m_{feature}) / s_{feature})"


def _six_places(value: str) -> str:
    return f"(floor(({value}) * 1e6 + 0.5) / 1e6)"


def _distance(features: list[str]) -> str:
    return _six_places(f"({' + '.join(f'{_z(f)} * {_z(f)}' for f in features)}) / {len(features)}")


SCORED = f"""{LINES},
stats AS ({_stats('lines', LINE_FEATURES)}),
raw AS (SELECT lines.*, {_distance(LINE_FEATURES)} AS score FROM lines, stats),
cut AS (SELECT quantile_cont(score, 0.95) AS threshold FROM raw),
scored AS (SELECT raw.*, CAST(score > threshold AS INTEGER) AS prediction FROM raw, cut)"""

_ABS_Z = " + ".join(f"abs({_z(f)})" for f in LINE_FEATURES)
ERRORS = f"""{LINES},
stats AS ({_stats('lines', LINE_FEATURES)}),
errors AS (SELECT label, {_distance(LINE_FEATURES)} AS mse, {_six_places(f'({_ABS_Z}) / {len(LINE_FEATURES)}')} AS mae
  FROM lines, stats)"""

_HITS = "count(*) FILTER (label = 1 AND prediction = 1)"
_ACTUAL, _PREDICTED = "count(*) FILTER (label = 1)", "count(*) FILTER (prediction = 1)"
BINARY = {
    "accuracy": "count(*) FILTER (label = prediction) / count(*)",
    "precision": f"coalesce({_HITS} / nullif({_PREDICTED}, 0), 0)",
    "recall": f"coalesce({_HITS} / nullif({_ACTUAL}, 0), 0)",
    "f1_score": f"coalesce(2 * {_HITS} / nullif({_ACTUAL} + {_PREDICTED}, 0), 0)",
}


def _auc(source: str) -> str:
    """Mann-Whitney with average ranks."""
    return f"""SELECT (sum(r) FILTER (label = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) FROM (
      SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
        CAST(count(*) FILTER (label = 1) OVER () AS DOUBLE) AS n1,
        CAST(count(*) FILTER (label = 0) OVER () AS DOUBLE) AS n0 FROM {source}) GROUP BY n1, n0"""


# Class sizes of a stratified 80/20 split by largest remainder.
SHARES = """sizes AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM {source} GROUP BY label),
shares AS (SELECT label, c, CAST(c * floor(0.8 * n) AS HUGEINT) // CAST(n AS HUGEINT) AS q,
  CAST(c * floor(0.8 * n) AS HUGEINT) % CAST(n AS HUGEINT) AS r, floor(0.8 * n) AS drawn FROM sizes),
train AS (SELECT label, c, q + CAST(row_number() OVER (ORDER BY r DESC, label) <= drawn - sum(q) OVER () AS INTEGER)
  AS n_train FROM shares)"""

RANKED = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, o_orderkey) AS rn FROM ord"
SPLIT = f"""{ORDERS}, {SHARES.format(source='ord')},
split AS (SELECT r.*, CAST(rn > n_train AS INTEGER) AS part FROM ({RANKED}) r JOIN train USING (label))"""

# Class-sorted rows dealt to five folds round-robin; each class fills its folds in hash order.
FOLDS = f"""{ORDERS},
bounds AS (SELECT label, sum(n) OVER (ORDER BY label) - n AS s, sum(n) OVER (ORDER BY label) AS e
  FROM (SELECT label, count(*) AS n FROM ord GROUP BY label)),
dealt AS (SELECT label, i AS fold, CAST((e - i + 4) // 5 - (s - i + 4) // 5 AS BIGINT) AS size
  FROM bounds, range(5) g(i)),
ends AS (SELECT label, fold, size, sum(size) OVER (PARTITION BY label ORDER BY fold) AS upto FROM dealt),
folded AS (SELECT r.*, CAST(fold AS INTEGER) AS fold FROM ({RANKED}) r JOIN ends
  ON r.label = ends.label AND rn <= upto AND rn > upto - size)"""

DIRTY = """dirty AS (SELECT event_id,
  CASE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 1 THEN '-inf'::DOUBLE
    WHEN event_id % 7 = 2 THEN 'nan'::DOUBLE WHEN event_id % 5 <> 3 THEN value END AS a,
  CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE WHEN event_id % 3 = 1 THEN value * 2 END AS b FROM events)"""

CLEAN = f"""{DIRTY},
finite AS (SELECT event_id, CASE WHEN isfinite(a) THEN a END AS a, CASE WHEN isfinite(b) THEN b END AS b FROM dirty)"""


def _headers(cut: bool) -> str:
    """Header fields straight from the columns that the frames are built of."""
    short = "CASE WHEN l_orderkey % 7 = 0 THEN least(whole, l_partkey % 64) ELSE whole END"
    return f"""WITH base AS (SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS num,
  l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q,
  CASE WHEN l_linenumber = 6 THEN 18 ELSE 14 END AS l3,
  CASE WHEN l_linenumber IN (1, 2, 6) THEN 6 WHEN l_linenumber = 3 THEN 17 WHEN l_linenumber = 4 THEN 1 ELSE 253 END AS proto,
  CASE WHEN l_linenumber IN (1, 2, 6) THEN 20 WHEN l_linenumber IN (3, 4) THEN 8 ELSE 0 END AS hlen,
  l_linenumber < 7 AS ip, CASE WHEN l_partkey % 11 = 0 THEN 185 ELSE 0 END AS frag FROM lineitem),
full_size AS (SELECT *, l3 + 20 AS l4, CASE WHEN ip THEN l3 + 20 + hlen + q ELSE 42 END AS whole FROM base),
sized AS (SELECT *, {short if cut else 'whole'} AS size FROM full_size),
kinds AS (SELECT *, ip AND proto = 6 AND frag = 0 AS tcp, ip AND proto = 17 AND frag = 0 AS udp,
  ip AND proto = 1 AND frag = 0 AS icmp, CASE WHEN num IN (1, 2, 6) THEN q % 64 ELSE 0 END AS bits FROM sized),
fields AS (SELECT l_orderkey, l_linenumber, CAST(size AS INTEGER) AS length,
  CASE WHEN ip AND size >= l3 + 10 THEN proto END AS ip_proto_number,
  CASE WHEN ip AND size >= l3 + 9 THEN CAST(32 + sk % 200 AS INTEGER) END AS ip_ttl,
  CASE WHEN ip AND size >= l3 + 6 THEN CAST(ok % 65536 AS INTEGER) END AS ip_id,
  CASE WHEN ip AND size >= l3 + 8 THEN CAST(ok % 2 AS INTEGER) ELSE 0 END AS ip_flags_df,
  CASE WHEN ip AND size >= l3 + 8 THEN CAST(pk % 2 AS INTEGER) ELSE 0 END AS ip_flags_mf,
  CASE WHEN ip AND size >= l3 + 8 THEN CAST(frag > 0 AS INTEGER) ELSE 0 END AS wrong_fragment,
  CASE WHEN tcp AND size >= l4 + 2 THEN CAST(1024 + ok % 60000 AS INTEGER) END AS tcp_sport,
  CASE WHEN tcp AND size >= l4 + 4 THEN CAST(pk % 1024 AS INTEGER) END AS tcp_dport,
  CASE WHEN tcp AND size >= l4 + 8 THEN ok * 65537 % 4294967296 END AS tcp_seq,
  CASE WHEN tcp AND size >= l4 + 12 THEN pk * 99991 % 4294967296 END AS tcp_ack,
  CASE WHEN tcp AND size >= l4 + 14 THEN bits ELSE 0 END AS tcp_flag_int,
  CASE WHEN tcp AND size >= l4 + 14 THEN (bits >> 1) & 1 ELSE 0 END AS tcp_flag_syn,
  CASE WHEN tcp AND size >= l4 + 14 THEN (bits >> 4) & 1 ELSE 0 END AS tcp_flag_ack,
  CASE WHEN tcp AND size >= l4 + 14 THEN bits & 1 ELSE 0 END AS tcp_flag_fin,
  CASE WHEN tcp AND size >= l4 + 14 THEN (bits >> 2) & 1 ELSE 0 END AS tcp_flag_rst,
  CASE WHEN tcp AND size >= l4 + 14 THEN (bits >> 3) & 1 ELSE 0 END AS tcp_flag_psh,
  CASE WHEN tcp AND size >= l4 + 14 THEN (bits >> 5) & 1 ELSE 0 END AS tcp_flag_urg,
  CASE WHEN tcp AND size >= l4 + 20 THEN CAST(sk % 3 AS INTEGER) ELSE 0 END AS urgent_pointer,
  CASE WHEN tcp AND size >= l4 + 16 THEN CAST(pk % 65536 AS INTEGER) END AS tcp_window,
  CASE WHEN tcp AND size >= l4 + 13 THEN 5 END AS tcp_dataofs,
  CASE WHEN udp AND size >= l4 + 2 THEN CAST(1024 + ok % 60000 AS INTEGER) END AS udp_sport,
  CASE WHEN udp AND size >= l4 + 4 THEN CAST(pk % 1024 AS INTEGER) END AS udp_dport,
  CASE WHEN udp AND size >= l4 + 6 THEN 8 + q END AS udp_len,
  CASE WHEN icmp AND size >= l4 + 1 THEN CAST(sk % 20 AS INTEGER) END AS icmp_type,
  CASE WHEN icmp AND size >= l4 + 2 THEN q % 16 END AS icmp_code,
  CAST(CASE WHEN NOT ip THEN 0
    WHEN frag > 0 OR proto = 253 THEN greatest(size - l4, 0)
    ELSE greatest(size - l4 - hlen, 0) END AS INTEGER) AS payload_size FROM kinds)
SELECT *, CAST(payload_size = 0 AS INTEGER) AS is_empty_payload FROM fields"""


_PROTOCOL = "CASE " + " ".join(f"WHEN proto = {n} THEN '{IP_PROTOCOLS[n]}'" for n in (1, 6, 17)) + " ELSE 'IP#253' END"


def _mac(key: str) -> str:
    return f"printf('00:00:00:00:%02x:%02x', ({key} % 65536) // 256, {key} % 256)"


SUMMARY = f"""WITH base AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, CASE WHEN l_linenumber = 6 THEN 18 ELSE 14 END AS l3,
  CASE WHEN l_linenumber IN (1, 2, 6) THEN 6 WHEN l_linenumber = 3 THEN 17 WHEN l_linenumber = 4 THEN 1 ELSE 253 END AS proto,
  CASE WHEN l_linenumber IN (1, 2, 6) THEN 20 WHEN l_linenumber IN (3, 4) THEN 8 ELSE 0 END AS hlen FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber < 7 THEN '10.' || (l_suppkey % 256) || '.' || (l_partkey % 256) || '.1' ELSE {_mac('l_partkey')} END AS src,
  CASE WHEN l_linenumber < 7 THEN '192.168.' || (l_orderkey % 256) || '.2' ELSE {_mac('l_suppkey')} END AS dst,
  CASE WHEN l_linenumber < 7 THEN {_PROTOCOL} ELSE 'Ethernet' END AS protocol,
  CAST(CASE WHEN l_linenumber < 7 THEN l3 + 20 + hlen + q ELSE 42 END AS INTEGER) AS length FROM base"""

PACKETS = f"""{SCORED},
packets AS (SELECT l_orderkey, l_linenumber, score, prediction,
  CASE WHEN l_linenumber IN (1, 2, 6) THEN l_orderkey % 5 * 1000 END AS ts_port,
  CASE WHEN l_linenumber IN (1, 2, 6) THEN l_partkey % 1024 END AS td_port,
  CASE WHEN l_linenumber IN (1, 2, 3, 6) THEN l_orderkey % 60000 END AS us_port,
  CASE WHEN l_linenumber = 3 THEN l_partkey % 1024 END AS ud_port,
  CASE WHEN l_linenumber < 7 THEN l_linenumber + 5 END AS proto,
  CASE WHEN l_linenumber = 5 THEN 0 WHEN l_linenumber < 7 THEN CAST(epoch(l_shipdate) AS BIGINT) END AS seconds FROM scored),
alerts AS (SELECT l_orderkey, l_linenumber, CAST(coalesce(nullif(ts_port, 0), us_port) AS INTEGER) AS source_port,
  CAST(coalesce(nullif(td_port, 0), ud_port) AS INTEGER) AS destination_port, CAST(proto AS INTEGER) AS protocol,
  score AS anomaly_score, 'anomaly' AS classification, 'distance_v1' AS model, 'distance' AS model_type,
  nullif(seconds, 0) AS seconds FROM packets WHERE prediction = 1)"""

_ISO = ALERT_TIME.replace(" ", "T")
_JSON = f"""'{{"source_port":' || coalesce(CAST(source_port AS VARCHAR), 'null')
  || ',"destination_port":' || coalesce(CAST(destination_port AS VARCHAR), 'null')
  || ',"protocol":' || coalesce(CAST(protocol AS VARCHAR), 'null')
  || ',"anomaly_score":' || CAST(anomaly_score AS VARCHAR)
  || ',"classification":"anomaly","model":"distance_v1","model_type":"distance","timestamp":'
  || CASE WHEN seconds IS NULL THEN '"{_ISO}.000000+00:00"' ELSE seconds || '.000000' END || '}}'"""

# Orders as live packets; the gap is in seconds and 0 for the first packet of a capture.
LIVE = """live AS (SELECT CAST(o_custkey % 8 AS VARCHAR) AS capture_id, o_orderkey AS packet_no, o_custkey, o_orderkey,
  CAST(epoch(o_orderdate) AS BIGINT) AS seconds, CAST({gap} AS BIGINT) AS gap FROM orders),
flagged AS (SELECT capture_id, packet_no, '{{"source_port":' || (1024 + o_orderkey % 60000)
  || ',"destination_port":' || (o_custkey % 1000) || ',"protocol":17,"anomaly_score":' || (o_custkey % 40)
  || '.0,"classification":"anomaly","model":"gap_v1","model_type":"gap","timestamp":' || seconds || '.000000}}' AS json
  FROM live WHERE gap > 20000000 OR o_custkey % 1000 < 100)
SELECT capture_id, packet_no, json FROM flagged"""
_GAP = "coalesce(epoch(o_orderdate) - lag(epoch(o_orderdate)) OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey), 0)"

_DIST = ["mse_mean", "mse_std", "mae_mean", "mae_std", "mse_median", "mse_iqr", "mae_median", "mae_iqr", "mse_p95"]
_DIST_SQL = {
    "mse_mean": "avg(mse)", "mse_std": "stddev_pop(mse)", "mae_mean": "avg(mae)", "mae_std": "stddev_pop(mae)",
    "mse_median": "quantile_cont(mse, 0.5)", "mse_iqr": "quantile_cont(mse, 0.75) - quantile_cont(mse, 0.25)",
    "mae_median": "quantile_cont(mae, 0.5)", "mae_iqr": "quantile_cont(mae, 0.75) - quantile_cont(mae, 0.25)",
    "mse_p95": "quantile_cont(mse, 0.95)",
}


def _long(source: str, columns: dict[str, str], key: str, value: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{name}' AS {key}, {expression} AS {value} FROM {source}" for name, expression in columns.items()
    )


def _violations(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '' "
        f"AND TRY_CAST({c} AS DOUBLE) IS NULL) AS n_violations FROM {source}"
        for name, c in columns.items()
    )


def _report() -> str:
    per = f"""{SCORED},
per AS (SELECT c AS cls, count(*) FILTER (label = c) AS support,
  coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (prediction = c), 0), 0) AS p,
  coalesce(count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (label = c), 0), 0) AS r,
  coalesce(2 * count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (label = c) + count(*) FILTER (prediction = c), 0), 0) AS f,
  count(*) FILTER (label = c AND prediction = c) AS hit FROM scored, (VALUES (0), (1)) v(c) GROUP BY c)"""
    return f"""WITH {per}
SELECT CAST(cls AS VARCHAR) AS "class", round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM per
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per"""


def _cv() -> str:
    metrics = {**BINARY, "score_mean": "avg(score)"}
    columns = ", ".join(f"{e} AS {n}" for n, e in metrics.items())
    stats = ", ".join(
        f"avg(CAST(o.{f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST(o.{f} AS DOUBLE)) AS s_{f}" for f in ORDER_FEATURES
    )
    return f"""WITH {FOLDS},
stats AS (SELECT f.fold AS fold, {stats} FROM (SELECT DISTINCT fold FROM folded) f JOIN folded o ON o.fold <> f.fold GROUP BY f.fold),
raw AS (SELECT o.fold AS fold, label, {_distance(ORDER_FEATURES)} AS score FROM folded o JOIN stats USING (fold)),
scored AS (SELECT *, CAST(score > 1 AS INTEGER) AS prediction FROM raw),
per_fold AS (SELECT fold, {columns} FROM scored GROUP BY fold),
long AS ({_long('per_fold', {n: n for n in metrics}, 'metric', 'value')})
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM long GROUP BY metric"""


def _comparison() -> str:
    formulas = {
        "distance": _distance(ORDER_FEATURES),
        "price": _six_places(f"abs({_z('o_totalprice')})"),
        "customer": _six_places(f"abs({_z('o_custkey')})"),
    }
    rows = []
    for name, score in formulas.items():
        metrics = ", ".join(f"round({e}, 4) AS {n}" for n, e in BINARY.items())
        rows.append(f"""SELECT '{name}' AS model, {metrics},
  (SELECT round(v, 4) FROM ({_auc(f'(SELECT label, {score} AS score FROM split, stats WHERE part = 1)')}) a(v)) AS roc_auc,
  CAST(NULL AS VARCHAR) AS error FROM (SELECT label, CAST({score} > (SELECT quantile_cont({score}, 0.9) FROM split, stats WHERE part = 0)
    AS INTEGER) AS prediction FROM split, stats WHERE part = 1)""")
    nothing = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in [*BINARY, "roc_auc"])
    rows.append(f"SELECT 'broken' AS model, {nothing}, 'no such model' AS error")
    source = "(SELECT * FROM split WHERE part = 0)"
    return f"WITH {SPLIT}, stats AS ({_stats(source, ORDER_FEATURES)}) " + " UNION ALL ".join(rows)


_COMBINED = """(SELECT l_quantity, l_discount, label, CAST(NULL AS INTEGER) AS l_linenumber FROM lines
  UNION ALL SELECT l_quantity, NULL, label, l_linenumber FROM lines
  UNION ALL SELECT l_quantity, l_discount, label, NULL FROM lines)"""

_CORR = ", ".join(f"round(abs(corr(CAST({f} AS DOUBLE), CAST(label AS DOUBLE))), 6) AS {f}" for f in CORRELATED)

LONG_HEADERS = """SELECT l_orderkey, l_linenumber,
  CAST(CASE WHEN l_orderkey % 2 = 1 THEN 54 + 4 * (l_partkey % 90) ELSE 74 + 8 * (l_partkey % 64 + 1) END
    + CAST(l_quantity AS INTEGER) AS INTEGER) AS length,
  CAST(1024 + l_orderkey % 60000 AS INTEGER) AS tcp_sport, CAST(l_partkey % 1024 AS INTEGER) AS tcp_dport,
  CAST(CAST(l_quantity AS INTEGER) % 64 AS INTEGER) AS tcp_flag_int, CAST(l_quantity AS INTEGER) AS payload_size,
  CAST(CAST(l_quantity AS INTEGER) = 0 AS INTEGER) AS is_empty_payload FROM lineitem"""

_CAPTURED = """SELECT {prefix} || (o_custkey % 8) || '-' || (o_orderkey // 100000)
    || CASE WHEN o_custkey % 2 = 1 THEN '.pcapng' ELSE '.pcap' END AS capture,
  row_number() OVER (PARTITION BY {prefix}, o_custkey % 8, o_orderkey // 100000 ORDER BY o_orderdate, o_orderkey) - 1 AS packet_no,
  epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS ts_us, CAST(42 + o_custkey % 40 AS INTEGER) AS length FROM {source}"""
CAPTURED = _CAPTURED.format(prefix="'c'", source="orders")
LANDED = _CAPTURED.format(
    prefix="lot",
    source="(SELECT *, CASE WHEN o_orderkey <= (SELECT quantile_cont(o_orderkey, 0.5) FROM orders) THEN 'a' ELSE 'b' END AS lot FROM orders)",
)
FACTS = """SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS label, count(*) AS n, count(*) AS scored, count(*) AS followed,
  TRUE AS varied, TRUE AS holds FROM orders GROUP BY 1"""
RELOADED = """SELECT m AS model, count(*) AS n, CAST(0 AS BIGINT) AS different
  FROM orders, (VALUES ('autoencoder'), ('random_forest'), ('svm'), ('kernel_svm')) v(m) GROUP BY 1"""

# The distance rule fitted on part 0 and applied to part 1 of ``split``.
RULE = f"""stats AS ({_stats('(SELECT * FROM split WHERE part = 0)', ORDER_FEATURES)}),
raw AS (SELECT part, label, {_distance(ORDER_FEATURES)} AS score FROM split, stats),
cut AS (SELECT quantile_cont(score, 0.95) AS threshold FROM raw WHERE part = 0),
scored AS (SELECT label, score, CAST(score > threshold AS INTEGER) AS prediction FROM raw, cut WHERE part = 1)"""
PLAIN_SPLIT = f"""{ORDERS}, split AS (SELECT *, CAST(rn > n - ceil(0.2 * n) AS INTEGER) AS part FROM (
  SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS rn, count(*) OVER () AS n FROM ord))"""


def _measures(source: str) -> str:
    """One row with the five metrics of ``source``."""
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in BINARY.items())}, ({_auc(source)}) AS roc_auc FROM {source}"


METRICS = [*BINARY, "roc_auc"]


def _train_job() -> str:
    long = _long("measures", {n: f"round({n}, 6)" for n in METRICS}, "metric", "value")
    return f"""WITH {PLAIN_SPLIT}, {RULE}, measures AS ({_measures('scored')}), long AS ({long})
SELECT 'distance' AS model_type, 2 AS input_dim, (SELECT count(*) FROM split WHERE part = 0) AS n_training_samples, metric, value FROM long"""


def _cross_validation() -> str:
    stats = ", ".join(f"avg(CAST(o.{f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST(o.{f} AS DOUBLE)) AS s_{f}" for f in ORDER_FEATURES)
    folds = " UNION ALL ".join(
        f"SELECT * FROM ({_measures(f'(SELECT * FROM scored WHERE fold = {i})')})" for i in range(5)
    )
    return f"""WITH {FOLDS},
stats AS (SELECT f.fold AS fold, {stats} FROM range(5) f(fold) JOIN folded o ON o.fold <> f.fold GROUP BY f.fold),
raw AS (SELECT stats.fold AS fold, o.fold = stats.fold AS held, label, {_distance(ORDER_FEATURES)} AS score FROM folded o, stats),
cut AS (SELECT fold, quantile_cont(score, 0.95) AS threshold FROM raw WHERE NOT held GROUP BY fold),
scored AS (SELECT fold, label, score, CAST(score > threshold AS INTEGER) AS prediction FROM raw JOIN cut USING (fold) WHERE held),
per_fold AS ({folds}), long AS ({_long('per_fold', {n: n for n in METRICS}, 'metric', 'value')})
SELECT 'labelled_distance' AS model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, 5 AS k FROM long GROUP BY metric"""


def _compared() -> str:
    return f"""WITH {SPLIT}, {RULE}, measures AS ({_measures('scored')})
SELECT 'labelled_distance' AS model, {', '.join(f'round({n}, 4) AS {n}' for n in METRICS)}, CAST(NULL AS VARCHAR) AS error FROM measures
UNION ALL SELECT 'missing', {', '.join('NULL' for _ in METRICS)}, 'unknown model ''missing''' AS error"""


def _gated() -> str:
    plain = _long("errors", {n: f"round({_DIST_SQL[n]}, 6)" for n in _DIST}, "metric", "value")
    classes = {
        f"avg_{e}_{w}": f"round(avg({e}) FILTER (label = {c}), 6)" for e in ("mse", "mae") for c, w in ((0, "normal"), (1, "anomalous"))
    }
    more = _long("errors", classes, "metric", "value")
    measured = _long("measures", {n: f"round({n}, 6)" for n in METRICS}, "metric", "value")
    return f"""WITH {ERRORS}, cut AS (SELECT quantile_cont(mse, 0.95) AS threshold FROM errors),
scored AS (SELECT label, mse AS score, CAST(mse > threshold AS INTEGER) AS prediction FROM errors, cut),
measures AS ({_measures('scored')}), plain AS ({plain}), more AS ({more} UNION ALL {measured})
SELECT *, TRUE AS labelled FROM plain UNION ALL SELECT *, FALSE FROM plain UNION ALL SELECT *, TRUE FROM more"""


_SEEN = "count(*) AS n, CAST(sum(o_custkey % 1000) AS BIGINT) AS udp_dport_sum, CAST(sum(o_custkey % 40) AS BIGINT) AS payload_size_sum"
JOBS: dict[str, str] = {
    "input_formats": f"""SELECT 'capture' AS input, {_SEEN}, FALSE AS refused FROM orders
UNION ALL SELECT 'csv', {_SEEN}, FALSE FROM orders UNION ALL SELECT 'other', NULL, NULL, NULL, TRUE""",
    "csv_line_breaks": """SELECT o_orderkey, o_orderstatus || chr(10) || '"' || o_orderpriority || '",' || chr(13) || chr(10) || o_custkey AS note,
  CASE WHEN o_custkey % 8 % 2 = 1 THEN CAST(o_orderstatus = 'F' AS INTEGER) END AS label,
  'notes' || (o_custkey % 8) || '-' || (o_orderkey // 100000) || '.csv' AS source FROM orders""",
    "never_overwritten": f"""WITH {ORDERS} SELECT copy, label, count(*) AS n FROM ord, (VALUES (1), (2)) v(copy)
WHERE copy = 1 OR label = 1 GROUP BY copy, label""",
    "class_document": f"WITH {ORDERS} SELECT label, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM ord GROUP BY label",
    "feature_matrix": f"""WITH {LINES} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, label FROM lines""",
    "fit_then_predict": f"WITH {SCORED} SELECT l_quantity, label, score, prediction FROM scored",
    "gated_metrics": _gated(),
    "train_job": _train_job(),
    "cross_validation": _cross_validation(),
    "compared_models": _compared(),
}

ORACLE_SQL: dict[str, str] = {
    **JOBS,
    "long_headers": LONG_HEADERS,
    "capture_scan": CAPTURED,
    "landed_captures": LANDED,
    "rf_facts": FACTS,
    "svm_facts": FACTS,
    "kernel_svm_facts": FACTS,
    "autoencoder_facts": FACTS,
    "model_reload": RELOADED,
    "flagged_by_class": f"WITH {SCORED} SELECT label, count(*) AS n, count(*) FILTER (prediction = 1) AS flagged FROM scored GROUP BY label",
    "bounded_capture": """WITH feed AS (SELECT user_id % 8 AS capture_id, event_id, epoch_us(ts) AS ts_us FROM events)
SELECT * FROM feed WHERE ts_us <= (SELECT min(ts_us) FROM feed) + 864000 * 1000000::BIGINT ORDER BY ts_us, event_id LIMIT 5000""",
    "inter_arrival": """SELECT user_id % 8 AS capture_id, event_id, epoch_us(ts) AS ts_us, coalesce(epoch_us(ts)
  - lag(epoch_us(ts)) OVER (PARTITION BY user_id % 8 ORDER BY event_id), 0) AS gap_us FROM events""",
    "decoded_frames": _headers(cut=False),
    "malformed_frames": _headers(cut=True),
    "packet_summary": SUMMARY,
    "clean_features": f"WITH {CLEAN} SELECT event_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM finite WHERE a IS NOT NULL OR b IS NOT NULL",
    "label_features": f"WITH {CLEAN} SELECT event_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, 1 AS label FROM finite WHERE a IS NOT NULL OR b IS NOT NULL",
    "invalid_values": f"WITH {DIRTY} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (isnan({c})) AS n_nan, "
        f"count(*) FILTER (isinf({c})) AS n_infinite FROM dirty" for c in "ab"
    ),
    "numeric_violations": _violations("orders", {
        "o_totalprice": "o_totalprice", "o_orderstatus": "o_orderstatus",
        "priority_no": "split_part(o_orderpriority, '-', 1)", "o_orderpriority": "o_orderpriority",
    }) + " UNION ALL " + _violations("events", {"props": "props", "event_type": "event_type"}),
    "combine_sources": f"WITH {LINES} SELECT * FROM {_COMBINED}",
    "dedup_rows": f"WITH {LINES} SELECT DISTINCT * FROM {_COMBINED}",
    "random_split": f"""WITH {ORDERS} SELECT o_orderkey, CAST(rn > n - ceil(0.2 * n) AS INTEGER) AS part FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS rn, count(*) OVER () AS n FROM ord)""",
    "stratified_split": f"WITH {SPLIT} SELECT o_orderkey, label, part FROM split",
    "keyless_split": f"""WITH {LINES}, {SHARES.format(source='lines')} SELECT label, CAST(part AS INTEGER) AS part,
  CAST(CASE WHEN part = 0 THEN n_train ELSE c - n_train END AS BIGINT) AS n FROM train, (VALUES (0), (1)) v(part)""",
    "balance_labels": f"""WITH {ORDERS}, least_n AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM ord GROUP BY label))
SELECT o_orderkey, label FROM ({RANKED}), least_n WHERE rn <= m""",
    "kfold": f"""WITH {ORDERS}, ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM ord)
SELECT o_orderkey, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1)
  ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM ranked""",
    "stratified_kfold": f"WITH {FOLDS} SELECT o_orderkey, label, fold FROM folded",
    "class_counts": "SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic",
    "normal_only": "SELECT * FROM labels WHERE toxic = 0",
    "scaler_stats": f"WITH {LINES} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS std FROM lines" for f in LINE_FEATURES
    ),
    "scale_features": f"WITH {LINES}, stats AS ({_stats('lines', LINE_FEATURES)}) SELECT "
    + ", ".join(f"round({_z(f)}, 6) AS {f}" for f in LINE_FEATURES) + ", label FROM lines, stats",
    "anomaly_threshold": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({p} AS DOUBLE) AS p, round(quantile_cont({f}, {p}), 6) AS threshold FROM lineitem"
        for f, p in (("l_extendedprice", 0.5), ("l_extendedprice", 0.95), ("l_extendedprice", 0.99), ("l_tax", 0.95))
    ),
    "threshold_predict": f"WITH {SCORED} SELECT l_orderkey, l_linenumber, score, prediction FROM scored",
    "recon_error": """WITH parts AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
centroids AS (SELECT label, i, avg(x) AS c FROM parts GROUP BY label, i)
SELECT vec_id, round(avg((x - c) * (x - c)), 6) AS mse, round(avg(abs(x - c)), 6) AS mae FROM parts JOIN centroids USING (label, i) GROUP BY vec_id""",
    "confusion_matrix": f"""WITH {SCORED} SELECT a AS actual, p AS predicted, count(*) FILTER (label = a AND prediction = p) AS n
FROM scored, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vp(p) GROUP BY a, p""",
    "binary_metrics": f"WITH {SCORED} SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in BINARY.items()) + " FROM scored",
    "classification_report": _report(),
    "roc_auc": f"WITH {SCORED} SELECT 'roc_auc' AS metric, round(v, 6) AS value FROM ({_auc('scored')}) a(v)",
    "error_distribution": f"WITH {ERRORS} " + _long("errors", {n: f"round({_DIST_SQL[n]}, 6)" for n in _DIST}, "metric", "value"),
    "error_by_class": f"WITH {ERRORS} SELECT " + ", ".join(
        f"round(avg({e}) FILTER (label = {c}), 6) AS avg_{e}_{w}" for e in ("mse", "mae") for c, w in ((0, "normal"), (1, "anomalous"))
    ) + " FROM errors",
    "cv_summary": _cv(),
    "model_comparison": _comparison(),
    "top_features": f"""WITH {LINES}, c AS (SELECT {_CORR} FROM lines), long AS ({_long('c', {f: f for f in CORRELATED}, 'feature', 'importance')})
SELECT feature, importance FROM long ORDER BY importance DESC, feature LIMIT 5""",
    "anomalies": f"WITH {SCORED} SELECT l_orderkey, l_linenumber, score FROM scored WHERE prediction = 1",
    "alerts": f"WITH {PACKETS} SELECT * EXCLUDE (seconds), CAST(seconds AS DOUBLE) AS \"timestamp\" FROM alerts",
    "syslog_lines": f"WITH {PACKETS} SELECT '<14>1 {_ISO}Z {ALERT_HOST} packetloom - - - ' || {_JSON} AS syslog FROM alerts",
    "csv_scan": f"WITH {ORDERS} SELECT o_orderkey, o_totalprice, o_custkey, label FROM ord",
    "csv_directory": f"""WITH {ORDERS} SELECT o_orderkey, o_custkey, label, CAST(NULL AS DOUBLE) AS o_totalprice FROM ord
UNION ALL SELECT o_orderkey, NULL, label, o_totalprice FROM ord""",
    "dataset_build": f"""WITH {ORDERS}, least_n AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM ord GROUP BY label)),
balanced AS (SELECT o_orderkey, label, h FROM ({RANKED}), least_n WHERE rn <= m), {SHARES.format(source='balanced')}
SELECT o_orderkey, b.label AS label, CASE WHEN rn <= n_train THEN 'train' ELSE 'test' END AS part FROM (SELECT *,
  row_number() OVER (PARTITION BY label ORDER BY h, o_orderkey) AS rn FROM balanced) b JOIN train ON b.label = train.label""",
    "batch_detection": f"WITH {SCORED} SELECT l_orderkey, l_linenumber, {', '.join(LINE_FEATURES)}, score AS anomaly_score, prediction FROM scored",
    "alert_files": f"""WITH {PACKETS}, text AS (SELECT {_JSON} AS value FROM alerts)
SELECT value, 'file' AS sink FROM text UNION ALL SELECT '<14>1 {_ISO}Z {ALERT_HOST} packetloom - - - ' || value, 'syslog' FROM text""",
    "live_alerts": "WITH " + LIVE.format(gap="0"),
    "live_alerts_with_gaps": "WITH " + LIVE.format(gap=_GAP),
    "live_packet_summary": """SELECT CAST(o_custkey % 8 AS VARCHAR) AS capture_id, o_orderkey AS packet_no, '10.0.0.' || (o_custkey % 256) AS src,
  '10.0.1.' || (o_orderkey % 256) AS dst, 'udp' AS protocol, CAST(42 + o_custkey % 40 AS INTEGER) AS length FROM orders""",
}
