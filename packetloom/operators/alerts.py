"""From scored packets to alerts and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alert fields in order, and the header words of a log line.
ALERT_FIELDS = (
    "source_port", "destination_port", "protocol", "anomaly_score",
    "classification", "model", "model_type", "timestamp",
)
SYSLOG_PRIORITY, SYSLOG_VERSION = 14, 1
DEFAULT_APP = "packetloom"


def anomalies(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("prediction") == 1)


def _optional(df: DataFrame, name: str, type_name: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(type_name)


def _port(df: DataFrame, side: str) -> Column:
    """The TCP port, or the UDP one when that is missing or 0."""
    tcp, udp = _optional(df, f"tcp_{side}", "int"), _optional(df, f"udp_{side}", "int")
    return F.coalesce(F.nullif(tcp, F.lit(0)), udp)


def project_alerts(
    scored: DataFrame, model_name: str, model_type: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One alert row per anomaly; ``timestamp`` is NULL where it must be defaulted.

    Times are epoch seconds; microseconds fit DECIMAL(20, 6) exactly and print plainly.
    """
    found = anomalies(scored)
    return found.select(
        *keep,
        _port(found, "sport").alias("source_port"),
        _port(found, "dport").alias("destination_port"),
        _optional(found, "ip_proto_number", "int").alias("protocol"),
        _optional(found, "anomaly_score", "double").alias("anomaly_score"),
        F.lit("anomaly").alias("classification"),
        F.lit(model_name).alias("model"),
        F.lit(model_type).alias("model_type"),
        F.nullif(_optional(found, "timestamp", "decimal(20,6)"), F.lit(0).cast("decimal(20,6)")).alias("timestamp"),
    )


def alert_json(alerts: DataFrame, now_iso: Column) -> Column:
    """The alert as JSON, NULLs kept; a missing time becomes the text ``now_iso``."""
    fields = [F.col(name) for name in ALERT_FIELDS[:-1]]
    own = F.to_json(F.struct(*fields, F.col("timestamp")), {"ignoreNullFields": "false"})
    defaulted = F.to_json(F.struct(*fields, now_iso.alias("timestamp")), {"ignoreNullFields": "false"})
    return F.when(F.col("timestamp").isNotNull(), own).otherwise(defaulted)


def _in_utc(now: Column) -> Column:
    """The wall clock of UTC, whatever the session's zone."""
    return F.to_utc_timestamp(now, F.current_timezone())


def utc_iso(now: Column) -> Column:
    return F.date_format(_in_utc(now), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def syslog_line(json: Column, host: str, now: Column, app: str = DEFAULT_APP) -> Column:
    """An RFC 5424 line with the alert as its message, sent under the name ``app``."""
    stamp = F.date_format(_in_utc(now), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit(f"<{SYSLOG_PRIORITY}>{SYSLOG_VERSION} "), stamp)
    return F.concat_ws(" ", head, F.lit(host), F.lit(f"{app} - - -"), json)


def render_alerts(
    alerts: DataFrame,
    host: str,
    now: Column | None = None,
    keep: tuple[str, ...] = (),
    app: str = DEFAULT_APP,
) -> DataFrame:
    """``(json, syslog)`` text per alert; ``now`` defaults to the time of the query."""
    now = F.current_timestamp() if now is None else now
    text = alerts.select(*keep, alert_json(alerts, utc_iso(now)).alias("json"))
    return text.withColumn("syslog", syslog_line(F.col("json"), host, now, app))
