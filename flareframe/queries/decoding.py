"""Logits to predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flareframe.functions import decode as D
from flareframe.functions.labels import LABELS
from flareframe.operators import predictions as P
from flareframe.queries.inputs import LOGITS, LONG, ORD, SCORES, logits, r6, scores
from flareframe.queries.registry import query

NAME = "CASE {c} WHEN 0 THEN 'NONE' WHEN 1 THEN 'C' WHEN 2 THEN 'M' ELSE 'X' END"


def long_rows(df, col, digits=6, name="p"):
    return df.select("id", F.posexplode(col).alias("j", "__v")).select(
        "id", F.col("j").cast("long").alias("j"), r6("__v", digits).alias(name))


@query("x01_softmax", f"WITH {LONG} SELECT id, CAST(j AS BIGINT) AS j, round(p, 6) AS p FROM soft")
def _(spark, sf):
    return long_rows(logits(spark, sf).withColumn("p", D.softmax(F.col("logits"))), "p")


@query("x02_binary_logit", f"""WITH {SCORES} SELECT id, CASE WHEN 1 / (1 + exp(-(8 * p - 4))) >= 0.4 THEN 'M+' ELSE 'NONE' END AS label_pred,
  round(CASE WHEN 1 / (1 + exp(-(8 * p - 4))) >= 0.4 THEN 1 / (1 + exp(-(8 * p - 4))) ELSE 1 - 1 / (1 + exp(-(8 * p - 4))) END, 6) AS prob_pred FROM scores""")
def _(spark, sf):
    d = scores(spark, sf).withColumn("lg", F.array(F.col("p") * 8 - 4))
    d = P.decode(d, "lg", "binary", 0.4, ["NONE", "M+"])
    return d.select("id", "label_pred", r6("prob_pred").alias("prob_pred"))


TOP = LONG + """, am AS (SELECT id, j, p, row_number() OVER (PARTITION BY id ORDER BY x DESC, j) AS k FROM soft)"""


@query("x03_argmax_class", f"WITH {TOP} SELECT id, {NAME.format(c='j')} AS label_pred, round(p, 6) AS prob_pred FROM am WHERE k = 1")
def _(spark, sf):
    d = P.decode(logits(spark, sf), "logits", "multi", labels=LABELS)
    return d.select("id", "label_pred", r6("prob_pred").alias("prob_pred"))


@query("x04_two_class_threshold", f"WITH {LOGITS} SELECT id, CAST(CASE WHEN 1 / (1 + exp(x0 - x1)) >= 0.3 THEN 1 ELSE 0 END AS BIGINT) AS cls FROM lg")
def _(spark, sf):
    p = D.softmax(F.slice("logits", 1, 2))
    return logits(spark, sf).select("id", D.two_class(p, 0.3).cast("long").alias("cls"))


@query("x05_multilabel", f"""WITH {LONG} SELECT id, coalesce(string_agg({NAME.format(c='j')}, ',' ORDER BY j) FILTER (WHERE x >= ln(0.6 / 0.4)), '') AS labels,
  round(coalesce(sum(1 / (1 + exp(-x))) FILTER (WHERE x >= ln(0.6 / 0.4)), 0), 6) AS total FROM ll GROUP BY 1""")
def _(spark, sf):
    d = P.decode(logits(spark, sf), "logits", "multilabel", 0.6, LABELS)
    total = F.aggregate("prob_pred", F.lit(0.0), lambda a, x: a + x)
    return d.select("id", F.array_join("label_pred", ",").alias("labels"), r6(total).alias("total"))


def _ordinal_sql(ge):
    return f"""{ORD}, ge AS (SELECT id, y, {ge} FROM og),
raw AS (SELECT id, y, greatest(1 - h1, 1e-12) AS q0, greatest(h1 - h2, 1e-12) AS q1, greatest(h2 - h3, 1e-12) AS q2, greatest(h3, 1e-12) AS q3 FROM ge),
op AS (SELECT id, y, q0 / (q0 + q1 + q2 + q3) AS p0, q1 / (q0 + q1 + q2 + q3) AS p1, q2 / (q0 + q1 + q2 + q3) AS p2, q3 / (q0 + q1 + q2 + q3) AS p3 FROM raw)"""


MONO = _ordinal_sql("g1 AS h1, least(g1, g2) AS h2, least(g1, g2, g3) AS h3")
FREE = _ordinal_sql("g1 AS h1, g2 AS h2, g3 AS h3")


@query("x06_ordinal_probs", f"WITH {MONO} SELECT id, round(p0, 6) + 0.0 AS p0, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2, round(p3, 6) + 0.0 AS p3 FROM op")
def _(spark, sf):
    p = D.ordinal_probs(F.col("ologits"))
    return logits(spark, sf).withColumn("p", p).select("id", *[
        r6(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(4)])


@query("x06_ordinal_probs_free", f"WITH {FREE} SELECT id, round(p0, 6) + 0.0 AS p0, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2, round(p3, 6) + 0.0 AS p3 FROM op")
def _(spark, sf):
    p = D.ordinal_probs(F.col("ologits"), monotone=False)
    return logits(spark, sf).withColumn("p", p).select("id", *[
        r6(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(4)])


@query("x07_ordinal_class", f"""WITH {ORD} SELECT id, CAST((g1 >= 0.5)::INT + (g2 >= 0.5)::INT + (g3 >= 0.5)::INT AS BIGINT) AS cls,
  CAST((g1 >= 0.3)::INT + (g2 >= 0.5)::INT + (g3 >= 0.7)::INT AS BIGINT) AS cls_thr FROM og""")
def _(spark, sf):
    x = F.col("ologits")
    return logits(spark, sf).select("id", D.ordinal_class(x).cast("long").alias("cls"),
                                    D.ordinal_class(x, [0.3, 0.5, 0.7]).cast("long").alias("cls_thr"))


@query("x08_prediction_rows", f"""WITH {MONO}, b AS (SELECT op.*, g1, g2, g3, greatest(p0, p1, p2, p3) AS m FROM op JOIN og USING (id))
SELECT id, CASE WHEN p0 = m THEN 'NONE' WHEN p1 = m THEN 'C' WHEN p2 = m THEN 'M' ELSE 'X' END AS label_pred, round(m, 6) AS prob_pred,
  round(p0 + 2 * p1 + 3 * p2 + 4 * p3, 6) AS probs_sum, round(g1 + 2 * g2 + 3 * g3, 6) AS ge_sum FROM b""")
def _(spark, sf):
    d = P.decode(logits(spark, sf), "ologits", "ordinal", labels=LABELS)

    def weighted(c):
        return F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)

    return d.select("id", "label_pred", r6("prob_pred").alias("prob_pred"),
                    r6(weighted("probs_all")).alias("probs_sum"), r6(weighted("ge_scores")).alias("ge_sum"))


def _linear(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in user model: a fixed linear score of the logits."""
    x = np.stack(pdf["logits"].to_list())
    return pd.DataFrame({"id": pdf["id"], "score": np.round(x @ np.array([0.5, -0.25, 1.0, 2.0]), 6) + 0.0})


def _weights():
    """Stands for loading a model."""
    import numpy as np
    return np.array([0.5, -0.25, 1.0, 2.0])


def _with_weights(pdf, model):
    import numpy as np
    x = np.stack([np.asarray(v, dtype=float)[:4] for v in pdf["logits"]]) if len(pdf) else np.empty((0, 4))
    return pdf[["id"]].assign(score=[round(float(v), 6) + 0.0 for v in x @ model])


@query("x09_score_with", f"WITH {LOGITS} SELECT id, round(0.5 * x0 - 0.25 * x1 + x2 + 2 * x3, 6) + 0.0 AS score FROM lg")
def _(spark, sf):
    return P.score_with(logits(spark, sf).select("id", "logits"), _linear, "id long, score double")


@query("x09_score_with_setup", f"WITH {LOGITS} SELECT id, round(0.5 * x0 - 0.25 * x1 + x2 + 2 * x3, 6) + 0.0 AS score FROM lg")
def _(spark, sf):
    return P.score_with(logits(spark, sf).select("id", "logits"), _with_weights, "id long, score double", setup=_weights)
