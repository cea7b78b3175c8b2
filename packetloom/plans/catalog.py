"""One query per operator over the shared test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.headers import HEADER_SCHEMA, decode_frames, summarize_packets
from packetloom.models.autoencoder import AutoencoderModel
from packetloom.models.forest import RandomForestModel
from packetloom.models.registry import build_model
from packetloom.models.svm import SVMModel
from packetloom.operators import alerts as A
from packetloom.operators import clean as C
from packetloom.operators import dataset as D
from packetloom.operators import metrics as M
from packetloom.operators.gaps import with_gaps
from packetloom.operators.quantiles import exact_percentile, exact_percentiles
from packetloom.operators.scaling import fit_scaler, scale, scaler_stats
from packetloom.plans.catalog_files import ALERT_HOST, FILE_QUERIES, alert_time
from packetloom.plans.catalog_jobs import JOB_QUERIES
from packetloom.plans.tables import (
    LINE_FEATURES,
    ORDER_FEATURES,
    distance,
    error_lines,
    labelled_lines,
    labelled_orders,
    line_frames,
    line_packets,
    long_frames,
    micros,
    scored_lines,
    six_places,
    table,
)
from packetloom.session import materialize, scratch_path
from packetloom.sources.captures import bounded_capture

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["o_orderkey"]
# Kind, registered name and settings of the models that are saved and loaded, all at their defaults.
RELOADED = [(n, n, {}) for n in ("autoencoder", "random_forest", "svm")] + [("kernel_svm", "svm", {"kernel": "rbf"})]
CORRELATED = [*LINE_FEATURES, "l_partkey", "l_suppkey", "l_linenumber"]


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def flagged_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each class lie beyond the 95th percentile of the anomaly score."""
    scored, _ = scored_lines(spark, sf_dir)
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == 1).alias("flagged")
    )


def feed_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") % 8).alias("capture_id"), "event_id", micros("ts").alias("ts_us"))


def bounded_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_capture(feed_capture(spark, sf_dir), 5000, 864_000, order=("ts_us", "event_id"))


def inter_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_gaps(feed_capture(spark, sf_dir), "capture_id", "event_id", "ts_us", chunk_packets=1_000)


def _header_columns(frames: DataFrame) -> DataFrame:
    decoded = decode_frames(frames)
    names = [n for n in HEADER_SCHEMA.names if n in decoded.columns]
    return decoded.select("l_orderkey", "l_linenumber", "length", *names)


def malformed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_columns(line_frames(spark, sf_dir, cut=True))


def decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_columns(line_frames(spark, sf_dir, cut=False))


def long_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport fields behind more header bytes than the head of a frame holds."""
    decoded = decode_frames(long_frames(spark, sf_dir))
    return decoded.select(
        "l_orderkey", "l_linenumber", "length", "tcp_sport", "tcp_dport", "tcp_flag_int", "payload_size", "is_empty_payload"
    )


def packet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_packets(line_frames(spark, sf_dir, cut=False)).drop("ts_us")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with infinities, NaN and NULL put in by fixed rules."""
    number, value = F.col("event_id"), F.col("value")
    first = (
        F.when(number % 13 == 0, F.lit(float("inf")))
        .when(number % 13 == 1, F.lit(float("-inf")))
        .when(number % 7 == 2, F.lit(float("nan")))
        .when(number % 5 != 3, value)
    )
    second = F.when(number % 3 == 0, F.lit(float("nan"))).when(number % 3 == 1, value * 2)
    return table(spark, sf_dir, "events").select(
        "event_id", first.alias("a"), second.alias("b"), F.lit("10.0.0.1").alias("src")
    )


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_features(dirty_events(spark, sf_dir), ["a", "b"])


def label_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.attach_label(clean_events(spark, sf_dir), 1)


def invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.invalid_counts(dirty_events(spark, sf_dir), ["a", "b"])


def numeric_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_totalprice",
        "o_orderstatus",
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("priority_no"),
        "o_orderpriority",
    )
    events = table(spark, sf_dir, "events").select("props", "event_type")
    return C.numeric_violations(orders, orders.columns).unionByName(
        C.numeric_violations(events, events.columns)
    )


def _sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    lines = labelled_lines(spark, sf_dir)
    return [
        lines.select("l_quantity", "l_discount", "label"),
        lines.select("l_quantity", "l_linenumber", "label"),
        lines.select("label", "l_discount", "l_quantity"),
    ]


def combine_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.combine(_sources(spark, sf_dir))


def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_rows(combine_sources(spark, sf_dir))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = labelled_orders(spark, sf_dir).select("o_orderkey")
    return D.assign_split(orders, KEY, train_size=None, test_size=0.2, stratify=False)


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_split(labelled_orders(spark, sf_dir).select("o_orderkey", "label"), KEY)


def keyless_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes of a split over a table with repeated rows and no key."""
    lines = labelled_lines(spark, sf_dir).select("l_quantity", "l_discount", "label")
    return D.assign_split(lines).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


def balance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.balance_labels(labelled_orders(spark, sf_dir).select("o_orderkey", "label"), keys=KEY)


def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_folds(labelled_orders(spark, sf_dir).select("o_orderkey"), 7, keys=KEY)


def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_folds(labelled_orders(spark, sf_dir).select("o_orderkey", "label"), 5, "label", KEY)


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.class_counts(table(spark, sf_dir, "labels"), "toxic")


def normal_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.normal_only(table(spark, sf_dir, "labels"), "toxic")


def scaler_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaler_stats(labelled_lines(spark, sf_dir), LINE_FEATURES), "mean", "std", places=4)


def scale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = labelled_lines(spark, sf_dir).select(*LINE_FEATURES, "label")
    return rounded(scale(lines, fit_scaler(lines, LINE_FEATURES)), *LINE_FEATURES)


def anomaly_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = labelled_lines(spark, sf_dir)
    found = exact_percentiles(lines, {"l_extendedprice": [0.5, 0.95, 0.99], "l_tax": [0.95]})
    rows = [(column, p, value) for (column, p), value in found.items()]
    return rounded(spark.createDataFrame(rows, "feature STRING, p DOUBLE, threshold DOUBLE"), "threshold")


def threshold_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = scored_lines(spark, sf_dir)
    return scored.select("l_orderkey", "l_linenumber", "score", "prediction")


def recon_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every vector against the centroid of its label."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    means = vectors.groupBy("label").agg(Summarizer.mean(array_to_vector("x")).alias("mean"))
    centroids = materialize(means.select("label", vector_to_array("mean").alias("recon")), "centroids")
    paired = vectors.join(centroids, "label")
    gap = F.zip_with("x", "recon", lambda a, b: a - b)
    paired = paired.withColumn("gap", gap)

    def mean_of(measure: Callable[[Column], Column]) -> Column:
        total = F.aggregate("gap", F.lit(0.0), lambda acc, v: acc + measure(v))
        return F.round(total / F.size("gap"), 6)

    return paired.select("vec_id", mean_of(lambda v: v * v).alias("mse"), mean_of(F.abs).alias("mae"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_matrix(scored_lines(spark, sf_dir)[0])


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.binary_metrics(scored_lines(spark, sf_dir)[0]), *M.COMPARISON_METRICS[:4])


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = M.classification_report(scored_lines(spark, sf_dir)[0])
    return rounded(report, "precision", "recall", "f1_score")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = labelled_lines(spark, sf_dir)
    scored = lines.select("label", distance(fit_scaler(lines, LINE_FEATURES)).alias("score"))
    return M.metrics_frame(spark, {"roc_auc": round(M.roc_auc(scored), 6)})


def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.metrics_frame(spark, M.error_distribution(error_lines(spark, sf_dir))), "value")


def error_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.error_by_class(error_lines(spark, sf_dir))
    return rounded(found, *found.columns)


def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stratified folds; the scaler of each fold comes from the other four."""
    folded = materialize(D.assign_folds(labelled_orders(spark, sf_dir), 5, "label", KEY), "folds")
    folds = []
    for fold in range(5):
        scaler = fit_scaler(folded.filter(F.col("fold") != fold), ORDER_FEATURES)
        held = folded.filter(F.col("fold") == fold).select("label", distance(scaler).alias("score"))
        held = held.withColumn("prediction", (F.col("score") > 1).cast("int"))
        metrics = {**M.binary_metric_columns(), "score_mean": F.avg("score")}
        rows = [F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in metrics.items()]
        folds.append(held.agg(F.array(*rows).alias("r")).select(F.lit(fold).alias("fold"), F.inline("r")))
    return rounded(M.fold_summary(D.combine(folds)), "mean", "std")


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three score formulas fitted on one stratified split; a failing one yields its error."""
    train, test = D.parts_of(materialize(D.assign_split(labelled_orders(spark, sf_dir), KEY), "split"))
    scaler = fit_scaler(train, ORDER_FEATURES)
    price, customer = scaler.scaled()
    formulas = {
        "distance": distance(scaler),
        "price": six_places(F.abs(price)),
        "customer": six_places(F.abs(customer)),
        "broken": F.lit(None),
    }
    rows: list[tuple] = []
    for name, score in formulas.items():
        try:
            if name == "broken":
                raise ValueError("no such model")
            threshold = exact_percentile(train.select(score.alias("score")), "score", 0.9)
            scored = test.select("label", score.alias("score"))
            scored = scored.withColumn("prediction", (F.col("score") > F.lit(threshold)).cast("int"))
            rows += [(name, m, v, None) for m, v in M.evaluate_labelled(scored).items()]
        except ValueError as error:
            rows.append((name, None, None, str(error)))
    long = spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE, error STRING")
    return M.comparison_table(long)


def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five features most correlated with the label."""
    lines = labelled_lines(spark, sf_dir)
    strengths = [
        F.struct(F.lit(n).alias("feature"), F.round(F.abs(F.corr(F.col(n).cast("double"), F.col("label").cast("double"))), 6).alias("importance"))
        for n in CORRELATED
    ]
    importances = lines.agg(F.array(*strengths).alias("rows")).select(F.inline("rows"))
    return M.top_features(importances, 5)


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = scored_lines(spark, sf_dir)
    return A.anomalies(scored).select("l_orderkey", "l_linenumber", "score")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.project_alerts(line_packets(spark, sf_dir), "distance_v1", "distance", ("l_orderkey", "l_linenumber"))
    return found.withColumn("timestamp", F.col("timestamp").cast("double"))


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.project_alerts(line_packets(spark, sf_dir), "distance_v1", "distance")
    return A.render_alerts(found, ALERT_HOST, alert_time()).select("syslog")


def _scores(spark: SparkSession, sf_dir: str, model) -> DataFrame:
    """Fits on the training part of the orders and scores all of them."""
    orders = labelled_orders(spark, sf_dir)
    split = materialize(D.assign_split(orders, KEY), "split")
    model.fit(D.parts_of(split)[0].drop("o_orderkey"))
    return model.transform(orders).select("o_orderkey", "label", "prediction", "score")


def _facts(spark: SparkSession, sf_dir: str, model, cut: Callable[[], float], holds: Callable[[DataFrame], bool]) -> DataFrame:
    """Per class what holds of a trained model and not of a constant one.

    Every row has a score, scores differ, predictions are the scores beyond the cut, and ``holds`` of the
    training rows what the fit promises.
    """
    scores = _scores(spark, sf_dir, model)
    part = D.assign_split(labelled_orders(spark, sf_dir), KEY).select(*KEY, "part")
    scores = materialize(scores.join(part, KEY), "facts")
    follows = F.col("prediction") == (F.col("score") > F.lit(cut())).cast("int")
    return scores.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("scored"),
        F.count_if(follows).alias("followed"),
        (F.min("score") < F.max("score")).alias("varied"),
        F.lit(holds(scores.filter("part = 0"))).alias("holds"),
    )


def _separates(train: DataFrame) -> bool:
    """Trees that end in pure leaves rank the rows they were grown on."""
    return M.roc_auc(train) > 0.99


def _calibrated(train: DataFrame) -> bool:
    """Sigmoids fitted by likelihood reproduce the share of the classes."""
    gap = train.agg(F.avg("score") - F.avg("label")).first()[0]
    return abs(gap) < 0.02


def _flags_its_share(train: DataFrame) -> bool:
    """A threshold at the 95th percentile leaves a twentieth of the normal training rows above."""
    n, flagged = train.filter("label = 0").agg(F.count(F.lit(1)), F.sum("prediction")).first()
    return abs(flagged - 0.05 * n) <= 1 + 0.001 * n


def rf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, RandomForestModel(), lambda: 0.5, _separates)


def svm_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, SVMModel(), lambda: 0.5, _calibrated)


def kernel_svm_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, SVMModel(kernel="rbf"), lambda: 0.5, _calibrated)


def autoencoder_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = AutoencoderModel()
    return _facts(spark, sf_dir, model, lambda: model.threshold, _flags_its_share)


def model_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model: rows, and rows that score differently once the model was saved and loaded by its name."""
    orders = labelled_orders(spark, sf_dir)

    def reloaded(kind: str, name: str, wanted: dict) -> DataFrame:
        model = build_model(name, **wanted).fit(orders.drop("o_orderkey"))
        path = model.save(spark, f"{scratch_path(spark)}/reload/{uuid.uuid4().hex}")
        again = build_model(name).load(spark, path)
        both = model.transform(orders).select("o_orderkey", F.col("score").alias("before")).join(
            again.transform(orders).select("o_orderkey", "score"), "o_orderkey"
        )
        different = F.count_if(~F.col("before").eqNullSafe(F.col("score")))
        return both.agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("n"), different.alias("different"))

    # The models are trained side by side: the steps of the autoencoder follow one another and leave most cores to the others.
    with ThreadPoolExecutor(len(RELOADED)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(reloaded), *model) for model in RELOADED]
        return D.combine([one.result() for one in started])


def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, RandomForestModel())


def svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, SVMModel())


def kernel_svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, SVMModel(kernel="rbf"))


def autoencoder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, AutoencoderModel())


QUERIES: dict[str, Query] = {
    "flagged_by_class": flagged_by_class,
    "bounded_capture": bounded_feed,
    "inter_arrival": inter_arrival,
    "decoded_frames": decoded_frames,
    "malformed_frames": malformed_frames,
    "long_headers": long_headers,
    "packet_summary": packet_summary,
    "clean_features": clean_events,
    "label_features": label_features,
    "invalid_values": invalid_values,
    "numeric_violations": numeric_violations,
    "combine_sources": combine_sources,
    "dedup_rows": dedup_rows,
    "random_split": random_split,
    "stratified_split": stratified_split,
    "keyless_split": keyless_split,
    "balance_labels": balance_labels,
    "kfold": kfold,
    "stratified_kfold": stratified_kfold,
    "class_counts": class_counts,
    "normal_only": normal_only,
    "scaler_stats": scaler_state,
    "scale_features": scale_features,
    "anomaly_threshold": anomaly_threshold,
    "threshold_predict": threshold_predict,
    "recon_error": recon_error,
    "confusion_matrix": confusion_matrix,
    "binary_metrics": binary_metrics,
    "classification_report": classification_report,
    "roc_auc": roc_auc,
    "error_distribution": error_distribution,
    "error_by_class": error_by_class,
    "cv_summary": cv_summary,
    "model_comparison": model_comparison,
    "top_features": top_features,
    "anomalies": anomalies,
    "alerts": alerts,
    "syslog_lines": syslog_lines,
    **FILE_QUERIES,
    **JOB_QUERIES,
    "rf_scores": rf_scores,
    "svm_scores": svm_scores,
    "kernel_svm_scores": kernel_svm_scores,
    "autoencoder_scores": autoencoder_scores,
    "rf_facts": rf_facts,
    "svm_facts": svm_facts,
    "kernel_svm_facts": kernel_svm_facts,
    "autoencoder_facts": autoencoder_facts,
    "model_reload": model_reload,
}
