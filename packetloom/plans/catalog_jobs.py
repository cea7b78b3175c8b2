"""Catalog queries of whole jobs: formats, sinks, training, cross-validation, comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.models.registry import build_model, register_model
from packetloom.operators.metrics import evaluate_errors, metrics_frame
from packetloom.operators.quantiles import exact_percentile
from packetloom.plans.catalog_files import LOT_PACKETS, ORDER_SCHEMA, DistanceModel, folder_for, order_frames, write_captures
from packetloom.plans.extract import load_input
from packetloom.plans.tables import LINE_FEATURES, error_lines, labelled_lines, labelled_orders, table
from packetloom.plans.train import compare_models, cross_validate, train_model
from packetloom.schema import feature_columns
from packetloom.session import materialize
from packetloom.sources.files import create_binary
from packetloom.sources.paths import make_directory
from packetloom.sources.sinks import read_document, write_document, write_table
from packetloom.sources.tabular import load_dataset

KEY = ["o_orderkey"]


class LabelledDistanceModel(DistanceModel):
    """The same rule for jobs that treat labelled models apart: stratified folds, all rows to train on."""

    model_type = "labelled_distance"
    supervised = True


register_model(DistanceModel)
register_model(LabelledDistanceModel)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def input_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders as captures of both formats and as a CSV table, chosen by suffix; a third suffix is refused."""
    frames = order_frames(spark, sf_dir)
    captures = folder_for(spark, "day") + ".pcap"
    write_captures(frames, captures, "c")
    customer = F.col("o_custkey")
    fields = table(spark, sf_dir, "orders").select(
        (customer % 1000).alias("udp_dport"), (customer % 40).alias("payload_size"), "o_totalprice"
    )
    paths = {"capture": captures, "csv": write_table(fields, folder_for(spark, "fields") + ".csv"), "other": "fields.parquet"}
    found = []
    for name, path in paths.items():
        try:
            sums = [F.sum(c).alias(f"{c}_sum") for c in ("udp_dport", "payload_size")]
            counted = load_input(spark, path).agg(F.count(F.lit(1)).alias("n"), *sums)
            found.append(counted.select(F.lit(name).alias("input"), "*", F.lit(False).alias("refused")))
        except ValueError:
            row = [(name, None, None, None, True)]
            found.append(spark.createDataFrame(row, "input STRING, n LONG, udp_dport_sum LONG, payload_size_sum LONG, refused BOOLEAN"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def write_notes(notes: DataFrame, folder: str) -> None:
    """CSV files of at most ``LOT_PACKETS`` keys each, written by the tasks that hold their rows; two column orders."""
    make_directory(notes.sparkSession, folder)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/notes{key[0]}-{key[1]}.csv"
        columns = ["o_orderkey", "note", "label"] if key[0] % 2 else ["note", "o_orderkey"]
        with create_binary(path) as out:
            out.write(rows[columns].to_csv(index=False, lineterminator="\n").encode())
        return pd.DataFrame({"path": [path]})

    lot = F.expr(f"o_orderkey div {LOT_PACKETS}").alias("lot")
    notes.groupBy("part", lot).applyInPandas(write, "path STRING").write.format("noop").mode("overwrite").save()


def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of tables whose quoted notes hold line breaks, quotes and commas, and the file of every row."""
    breaks = [F.lit("\n"), F.lit('"'), F.col("o_orderpriority"), F.lit('",\r\n'), F.col("o_custkey")]
    notes = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 8).alias("part"),
        F.concat(F.col("o_orderstatus"), *breaks).alias("note"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    folder = folder_for(spark, "notes")
    write_notes(notes, folder)
    return load_dataset(spark, folder, ORDER_SCHEMA, source="source").select("o_orderkey", "note", "label", "source")


def never_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to a path in use goes beside it; both are read back."""
    orders = labelled_orders(spark, sf_dir)
    path = folder_for(spark, "orders") + ".csv"
    first = write_table(orders, path)
    second = write_table(orders.filter("label = 1"), path)
    copies = [load_dataset(spark, p, ORDER_SCHEMA).withColumn("copy", F.lit(i)) for i, p in enumerate((first, second), 1)]
    return copies[0].unionByName(copies[1]).groupBy("copy", "label").agg(F.count(F.lit(1)).alias("n"))


def class_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few facts per class as a JSON document, read back."""
    facts = labelled_orders(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")
    )
    path = folder_for(spark, "facts")
    write_document(spark, [r.asDict() for r in facts.collect()], path)  # two classes
    rows = [(r["label"], r["n"], r["least"], r["most"]) for r in read_document(spark, path)]
    return spark.createDataFrame(rows, "label INT, n LONG, least DOUBLE, most DOUBLE")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that a model would see, in order, and the label."""
    lines = labelled_lines(spark, sf_dir)
    return lines.select(*feature_columns(lines.columns, exclude=("l_returnflag", "l_linestatus", "l_shipdate")), "label")


def fit_then_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = labelled_lines(spark, sf_dir).select(*LINE_FEATURES, "label")
    return DistanceModel().fit_transform(lines).select("l_quantity", "label", "score", "prediction")


def gated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported of errors with labels, and without."""
    errors = error_lines(spark, sf_dir)
    threshold = exact_percentile(errors, "mse", 0.95)
    scored = materialize(errors.withColumn("prediction", (F.col("mse") > F.lit(threshold)).cast("int")), "errors")
    gates = [
        metrics_frame(spark, evaluate_errors(scored, label)).withColumn("labelled", F.lit(label is not None))
        for label in ("label", None)
    ]
    return _rounded(gates[0].unionByName(gates[1]), "value")


def train_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, fit, evaluate and save; what the saved model's metadata says once it is loaded by its name."""
    path = folder_for(spark, "model")
    train_model(spark, "distance", labelled_orders(spark, sf_dir), path, keys=KEY)
    facts = build_model("distance").load(spark, path).metadata_frame(spark, path)
    long = facts.select("model_type", "input_dim", "n_training_samples", F.explode("evaluation_metrics").alias("metric", "value"))
    return _rounded(long, "value")


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cross_validate(spark, "labelled_distance", labelled_orders(spark, sf_dir), 5, keys=KEY), "mean", "std")


def compared_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison job with a model that works and a name that no model has."""
    models = ("labelled_distance", "missing")
    found = compare_models(spark, labelled_orders(spark, sf_dir), keys=KEY, models=models)
    return found.withColumn("error", F.split_part("error", F.lit(";"), F.lit(1)))


JOB_QUERIES = {
    "input_formats": input_formats,
    "csv_line_breaks": csv_line_breaks,
    "never_overwritten": never_overwritten,
    "class_document": class_document,
    "feature_matrix": feature_matrix,
    "fit_then_predict": fit_then_predict,
    "gated_metrics": gated_metrics,
    "train_job": train_job,
    "cross_validation": cross_validation,
    "compared_models": compared_models,
}
