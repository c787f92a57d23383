"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to a column expression."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.llm.common import given, texts_of

STATS = ["log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "spaces", "lines", "high_bytes",
         "stops", "commas", "bangs", "bars", "odd_signs", "braces", "other_signs", "distinct_words", "top_word",
         "repeated_lines", "line_bytes", "sign_words", "capital_words", "one_letter"]
_GROUPS = {"upper": bytes(range(65, 91)), "digits": b"0123456789", "spaces": b" \t", "lines": b"\n\r",
           "high_bytes": bytes(range(128, 256)), "stops": b".?", "commas": b",;:", "bangs": b"!", "bars": b"|",
           "odd_signs": b"#$%&*@^~", "braces": b"<>{}[]()=/\\_+", "other_signs": b"\"'`-"}
_MASK = np.array([[b in g for b in range(256)] for g in _GROUPS.values()], dtype=np.float64)


def stats_of(text: str | None) -> list[float]:
    """Statistics of one whole text; those of the empty text where it is null."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    shares = _MASK @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    k = max(1, len(words))
    folded = raw.lower().split()
    seen: dict[bytes, int] = {}
    for w in folded:
        seen[w] = seen.get(w, 0) + 1
    lines = raw.split(b"\n")
    return [math.log1p(len(raw)), math.log1p(len(words)), (sum(map(len, words))) / k,
            sum(len(w) > 14 for w in words) / k, *shares.tolist(), len(seen) / math.sqrt(k),
            max(seen.values(), default=0) / k, 1 - len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)),
            sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / k,
            sum(w[:1].isupper() for w in words) / k, sum(len(w) == 1 for w in words) / k]


def text_stats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(id, text, ...) to (id, ``keep``, one double per statistic); whole texts, a task's batch at a time."""
    keep = keep or []
    schema = ", ".join(["id long", *(f"{k} int" for k in keep), *(f"{s} double" for s in STATS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([stats_of(t) for t in b["text"]], columns=STATS, dtype="float64")
            for i, c in enumerate(["id", *keep]):
                out.insert(i, c, b[c].to_numpy())
            yield out
    return docs.select("id", "text", *keep).mapInPandas(run, schema)


Rule = tuple[tuple[str, bool, float], ...]                   # (statistic, above?, threshold), all of which must hold


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, named: dict[str, str] | None = None) -> Column:
        """The ensemble as one expression over the columns of :func:`text_stats`, or those ``named`` for them."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for stat, above, cut in rule:
                stat = (named or {}).get(stat, stat)
                holds &= (F.col(stat) > cut) if above else (F.col(stat) <= cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for stat, above, cut in rule:
        v = x[:, STATS.index(stat)]
        out &= v > cut if above else v <= cut
    return out


def _paths(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, path: Rule, leaf: int,
           out: list[Rule], step: np.ndarray, rows: np.ndarray, rate: float, cols: np.ndarray) -> None:
    """Grow one gradient tree on ``rows``; append every path from the root; add the leaves' steps to ``step``."""
    if path:
        out.append(path)
    best, base = (1e-6, -1, 0.0), g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    if depth and len(rows) >= 2 * leaf:
        for c in cols:
            v = x[rows, c]
            for cut in np.unique(np.quantile(v, np.linspace(0.04, 0.96, 24), method="lower")):
                left = v <= cut
                n = int(left.sum())
                if n < leaf or len(rows) - n < leaf:
                    continue
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - base
                if gain > best[0]:
                    best = (gain, c, float(cut))
    if best[1] < 0:
        step[rows] += rate * g[rows].sum() / (h[rows].sum() + 1.0)
        return
    _, c, cut = best
    for above in (False, True):
        side = rows[(x[rows, c] > cut) == above]
        _paths(x, g, h, depth - 1, (*path, (STATS[c], above, cut)), leaf, out, step, side, rate, cols)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002,
              seed: int = 7) -> RuleModel:
    """Boost shallow trees, take every path as a rule, and fit L1-penalised logistic weights to the rules.

    Rows without labels give a score of 0.5; labels of one kind give a constant score from their count.
    """
    n = len(y)
    if n == 0 or y.min() == y.max():
        return RuleModel(0.0 if n == 0 else math.log((y.sum() + 0.5) / (n - y.sum() + 0.5)), ())
    rng, leaf = np.random.default_rng(seed), max(2, n // 200)
    rules: list[Rule] = []
    f = np.zeros(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        cols = rng.choice(len(STATS), size=len(STATS) * 2 // 3, replace=False)
        _paths(x, y - p, p * (1 - p), depth, (), leaf, rules, f, np.arange(n), 0.3, cols)
    kept: dict[bytes, Rule] = {}
    for r in sorted(set(rules), key=lambda r: (len(r), r)):   # the shortest of rules that hold on the same rows
        kept.setdefault(np.packbits(_holds(r, x)).tobytes(), r)
    names = list(kept.values())
    a = np.column_stack([np.ones(n), *(_holds(r, x).astype(float) for r in names)])
    lip = 0.25 * np.linalg.norm(a, 2) ** 2 / n
    w, z, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(600):                                      # accelerated proximal gradient; the bias is free
        v = z - a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n / lip
        new = np.sign(v) * np.maximum(np.abs(v) - penalty / lip, 0)
        new[0] = v[0]
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / t2 * (new - w), t2
    return RuleModel(float(w[0]), tuple((r, float(c)) for r, c in zip(names, w[1:]) if abs(c) > 1e-4))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Fit on at most ``max_rows`` labelled documents (the first by a hash of their id, so a fixed sample).

    The sample's ids, ``max_rows`` rows, are sent to the tasks; statistics of the sampled texts, ``max_rows`` by
    the number of statistics, come to the driver.  Labels that are null or that match no document are ignored; of
    several labels of a document the largest holds.  Rows that share a sampled id are fitted each, up to ``max_rows``
    in all.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")) \
        .agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = text_stats(texts_of(docs, id_col, text_col).join(F.broadcast(sample), "id"), ["label"]) \
        .orderBy("id", *STATS).limit(max_rows).toPandas()
    return fit_rules(rows[STATS].to_numpy(), rows["label"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, 0 to 1, higher where label 1 is likelier; a narrow plan without a shuffle.

    Null and empty texts are scored by the statistics of the empty text; repeated rows are scored each; null ids
    stay null; an empty table gives no rows; other columns are not read.
    """
    return text_stats(texts_of(docs, id_col, text_col)).select(given().alias("doc_id"), model.score().alias("score"))
