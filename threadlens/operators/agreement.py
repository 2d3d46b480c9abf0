"""Agreement between the two sentiment models.

Everything derives from one 3x3 count table (a single partial aggregate over
the rows); precision/recall/F1/kappa are arithmetic on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson_p_col

from ..functions.labels import LABELS
from .common import attach_scalars


def pair_counts(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Counts per (label_a, label_b) over rows where both labels are present."""
    return (df.filter(F.col(label_a).isNotNull() & F.col(label_b).isNotNull())
            .groupBy(F.col(label_a).alias("label_a"), F.col(label_b).alias("label_b"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_share(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """share of every observed (a, b) pair in all non-null pairs (normalize='all')."""
    pc = pair_counts(df, label_a, label_b)
    tot = pc.agg(F.sum("n").alias("_tot"))
    return attach_scalars(pc, tot).select("label_a", "label_b", (F.col("n") / F.col("_tot")).alias("share"))


def confusion_counts(df: DataFrame, label_a: str, label_b: str, labels=LABELS) -> DataFrame:
    """dense count matrix in fixed label order; rows = label_a (reference
    labels), one column per label_b value. Pairs outside ``labels`` are ignored."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(v, i) for i, v in enumerate(labels)], "label_a string, row_order int")
    g = df.filter(F.col(label_a).isin(list(labels)) & F.col(label_b).isin(list(labels)))
    aggs = [F.sum(F.when(F.col(label_b) == v, 1).otherwise(0)).alias(f"n_{v}") for v in labels]
    counts = g.groupBy(F.col(label_a).alias("label_a")).agg(*aggs)
    return grid.join(counts, "label_a", "left").select(
        "label_a", "row_order", *[F.coalesce(f"n_{v}", F.lit(0)).cast("long").alias(f"n_{v}") for v in labels])


def agreement_rate(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """F16: exact-match rate over rows where both labels are present."""
    g = df.filter(F.col(label_a).isNotNull() & F.col(label_b).isNotNull())
    return g.agg(F.avg((F.col(label_a) == F.col(label_b)).cast("double")).alias("agreement"),
                 F.count(F.lit(1)).alias("n"))


def _class_table(df, label_a, label_b):
    """Per class c: tp, true_c (support), pred_c over rows with both labels present."""
    pc = pair_counts(df, label_a, label_b)
    t = pc.groupBy(F.col("label_a").alias("cls")).agg(F.sum("n").alias("support"))
    p = pc.groupBy(F.col("label_b").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = pc.filter(F.col("label_a") == F.col("label_b")).select(F.col("label_a").alias("cls"), F.col("n").alias("tp"))
    return (t.join(p, "cls", "full_outer").join(tp, "cls", "left")
            .select("cls", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("support", "predicted", "tp")]))


def class_report(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """precision, recall, F1, support per class (label_a = truth, label_b =
    prediction; 0/0 -> 0) plus accuracy, macro avg and weighted avg rows."""
    ct = _class_table(df, label_a, label_b)
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = ct.select(F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
    tot = per.agg(F.sum("support").alias("total"), F.sum("tp").alias("tp_all"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    rows = per.select("class", "precision", "recall", "f1", "support")
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     (F.col("tp_all") / F.col("total")).alias("f1"), F.col("total").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("total").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("total").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def cohen_kappa(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """(po - pe) / (1 - pe) from the pair-count marginals."""
    ct = _class_table(df, label_a, label_b)
    s = ct.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
               F.sum(F.col("support") * F.col("predicted")).alias("m"))
    po = F.col("tp") / F.col("n")
    pe = F.col("m") / (F.col("n").cast("double") * F.col("n"))
    return s.select(po.alias("observed"), pe.alias("expected"),
                    F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


def topic_model_correlation(topic_dist: DataFrame, a: str = "bert_neg_pct",
                            b: str = "vader_neg_pct", with_p: bool = False) -> DataFrame:
    """F32: Pearson r of the two models' negative shares over topics + strength label
    (|r| > 0.7 strong, > 0.4 moderate, else weak); on request its two-sided p."""
    r = F.corr(a, b)
    out = topic_dist.agg(r.alias("r"), F.count(F.lit(1)).alias("n_topics")).withColumn(
        "strength", F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.4, "moderate").otherwise("weak"))
    return out.withColumn("p_value", pearson_p_col("r", "n_topics")) if with_p else out


def max_disagreement(dist: DataFrame, key_cols, a: str = "bert_neg_pct", b: str = "vader_neg_pct") -> DataFrame:
    """the row with the largest |a - b| (first key order on ties)."""
    d = dist.withColumn("difference", F.abs(F.col(a) - F.col(b)))
    return d.select(*key_cols, a, b, "difference").orderBy(F.desc("difference"), *key_cols).limit(1)
