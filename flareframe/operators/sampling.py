"""Reproducible sampling: the same rows whatever the partitioning.

Randomness is a hash of (seed, id), so a draw needs no state and a retried
task repeats it.  Ranks inside groups are exact and computed in slices of the
hash, so one huge group is ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flareframe.operators.ordered import (number_rows, running, uniform_segment, whole,
                                          with_quantile_segment)
from flareframe.session import materialise


def uniform(seed: int | str, *ids: Column | str) -> Column:
    """Hash-uniform value in (0, 1) from ``seed`` and one or more ids."""
    text = F.concat_ws(":", F.lit(str(seed)), *[
        (F.col(i) if isinstance(i, str) else i).cast("string") for i in ids])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / F.lit(4294967296.0)


def rank_uniform(df: DataFrame, keys: Sequence[str], id: str, seed: int | str, name: str = "rk",
                 attach: DataFrame | None = None) -> DataFrame:
    """Random rank 1, 2, ... of each row inside its group; ``attach`` as in ``number_rows``."""
    df = df.withColumn("__u", uniform(seed, id))
    return number_rows(df, keys, ["__u", id], uniform_segment(df, "__u"), name,
                       attach).drop("__u")


#: Half the width of the bracket around the k-th smallest of n hashes: so many times sqrt(k), and so many rows more.
SPREAD, MARGIN = 6.0, 12.0
#: Up to this limit Spark cuts each task's part of a group to the limit before the shuffle; groups of so many rows are ranked whole.
GROUP_LIMIT = 1000


def cut_offs(df: DataFrame, keys: Sequence[str], id: str, seed: int | str, quotas: DataFrame) -> DataFrame:
    """``quotas`` (keys, n = rows of the group, k) with ``edge``, the k-th smallest (u, id) of the group, u its hash.

    A row is among the k first of its random order exactly if (u, id) <= edge.  Groups of up to ``GROUP_LIMIT`` rows are
    ranked whole.  In larger ones the k-th of n uniform hashes lies near k / n: one pass counts the rows below and within
    a bracket around it, per task first; a second ranks the rows inside the bracket only, about 12 sqrt(k) of a group.  A
    bracket that should miss the k-th becomes the whole group.  So what is shuffled of a large group grows with sqrt(k),
    not with its rows.  Edge is null for k < 1 and for k >= n, where there is nothing to find.
    """
    rows = df.select(F.struct(*keys).alias("__grp"), uniform(seed, id).alias("__u"), F.col(id).alias("__id"))
    wanted = materialise(quotas.select(F.struct(*keys).alias("__grp"), "n", F.col("k").cast("long").alias("k")).distinct())
    open_, small = wanted.where("k > 0 AND k < n"), F.col("n") <= GROUP_LIMIT
    few, many = open_.where(small).select("__grp", "k"), open_.where(~small)
    ranks = Window.partitionBy("__grp", "k").orderBy("__u", "__id")
    at = rows.join(few, "__grp").withColumn("rn", F.row_number().over(ranks)).where(F.col("rn") == F.col("k"))
    found = at.select("__grp", "k", F.struct(F.col("__u").alias("u"), F.col("__id").alias("id")).alias("edge"))
    if not many.isEmpty():
        found = found.unionByName(_edges_of_many(rows, many))
    return materialise(wanted.join(found, ["__grp", "k"], "left").select("__grp.*", "n", "k", "edge"))


def _edges_of_many(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """(__grp, k, edge) of groups (__grp, n, k) with many rows, by brackets."""
    half = SPREAD * F.sqrt("k") + MARGIN
    open_ = open_.withColumns({"lo": (F.col("k") - half) / F.col("n"), "hi": (F.col("k") + half) / F.col("n")})
    u = F.col("__u")
    counted = rows.join(open_, "__grp").groupBy("__grp", "k", "lo", "hi").agg(
        F.count_if(u < F.col("lo")).alias("below"), F.count_if(u < F.col("hi")).alias("upto"))
    miss = (F.col("below") >= F.col("k")) | (F.col("upto") < F.col("k"))
    brackets = materialise(counted.withColumn("miss", miss).select(
        "__grp", "k", F.when(F.col("miss"), 0.0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("miss"), 1.0).otherwise(F.col("hi")).alias("hi"),
        F.when(F.col("miss"), 0).otherwise(F.col("below")).alias("below")))
    inside = rows.join(brackets, "__grp").where((u >= F.col("lo")) & (u < F.col("hi")))
    place = (u - F.greatest("lo", F.lit(0.0))) / (F.least("hi", F.lit(1.0)) - F.greatest("lo", F.lit(0.0)))
    ranked = number_rows(inside, ["__grp", "k"], ["__u", "__id"], uniform_segment(inside, place))
    return ranked.where(F.col("rn") == F.col("k") - F.col("below")).select(
        "__grp", "k", F.struct(u.alias("u"), F.col("__id").alias("id")).alias("edge"))


def first_k(df: DataFrame, keys: Sequence[str], id: str, seed: int | str, quotas: DataFrame, name: str) -> DataFrame:
    """Add ``name``: is the row among the k first of its group's random order?  False for groups without a quota.

    ``quotas``: keys, n and k, one row a group.  The rows themselves are only joined with a row per group.
    """
    edges = cut_offs(df, keys, id, seed, quotas)
    table = edges.select(F.struct(*keys).alias("__grp"), F.col("n").alias("__n"), F.col("k").alias("__k"), F.col("edge").alias("__edge"))
    mine = F.struct(uniform(seed, id).alias("u"), F.col(id).alias("id"))
    inside = F.when(F.col("__k") >= F.col("__n"), True).when(F.col("__k") < 1, False).otherwise(mine <= F.col("__edge"))
    return (df.withColumn("__grp", F.struct(*keys)).join(table, "__grp", "left")
            .withColumn(name, F.coalesce(inside, F.lit(False))).drop("__grp", "__n", "__k", "__edge"))


def sample_per_group(df: DataFrame, keys: Sequence[str], id: str, k: int | Column, seed: int,
                     ) -> DataFrame:
    """``k`` random rows per group (``k`` may be a column, the same in all rows of a group)."""
    if isinstance(k, int) and k <= GROUP_LIMIT:
        order = Window.partitionBy(*keys).orderBy("__u", id)
        return (df.withColumn("__u", uniform(seed, id)).withColumn("__rk", F.row_number().over(order))
                .where(F.col("__rk") <= k).drop("__u", "__rk"))
    limit = k if isinstance(k, Column) else F.lit(k)
    quotas = df.groupBy(*keys).agg(F.max(limit).alias("k"), F.count(F.lit(1)).alias("n"))
    return first_k(df, keys, id, seed, quotas, "__in").where("__in").drop("__in")


def sample_k(df: DataFrame, id: str, k: int, seed: int) -> DataFrame:
    """``k`` random rows of the whole table."""
    return df.orderBy(uniform(seed, id), id).limit(k)      # top k of every task, then of those


def weighted_key(seed: int | str, id: str, w: Column) -> Column:
    """Sort key -ln(u)/w: ascending order is a weighted order without replacement;
    weight 0 sorts last, in random order too, so those rows share no key and no task."""
    u = uniform(seed, id)
    return F.when(w > 0, -F.log(u) / F.nullif(w, F.lit(0.0))).otherwise(F.lit(1e308) * (1 + u / 2))


def rank_weighted(df: DataFrame, keys: Sequence[str], id: str, w: str, seed: int | str,
                  name: str = "rk") -> DataFrame:
    """Weighted random rank inside each group."""
    df = df.withColumn("__e", weighted_key(seed, id, F.col(w).cast("double")))
    df = with_quantile_segment(df, "__e")
    return number_rows(df, keys, ["__e", id], F.col("__qseg"), name).drop("__e", "__qseg")


def weighted_sample(df: DataFrame, id: str, w: str, k: int, seed: int | str) -> DataFrame:
    """``k`` rows drawn without replacement with probability proportional to ``w``."""
    return df.orderBy(weighted_key(seed, id, F.col(w).cast("double")), uniform(seed, id), id).limit(k)


def downsample_targets(df: DataFrame, label: str, target_total: int | None = None,
                       targets: dict[str, int] | None = None,
                       removable: Sequence[str] = ("NONE", "C"),
                       count: str | None = None) -> DataFrame:
    """Rows to keep per label: label, n, target.  ``count`` names a column of row
    counts when ``df`` is already aggregated.

    With ``target_total`` the removable labels give up rows in their order until
    the total fits; it must not be below the other labels' count (the plan then
    fails when run).  With ``targets`` the named labels are cut to the given
    sizes, clamped to what is there.
    """
    rows = F.count(F.lit(1)) if count is None else F.sum(count)
    n = df.groupBy(F.col(label).alias("label")).agg(rows.alias("n"))
    if target_total is None:
        if not targets:
            raise ValueError("give target_total or targets")
        want = F.lit(None).cast("long")
        for lab, t in targets.items():
            want = F.when(F.col("label") == lab, F.lit(int(t))).otherwise(want)
        return n.withColumn("target", F.greatest(F.lit(0), F.least(
            F.coalesce(want, F.col("n")), F.col("n"))).cast("long"))
    order = F.lit(len(removable))
    for i, lab in enumerate(removable):
        order = F.when(F.col("label") == lab, i).otherwise(order)
    n = n.withColumn("__o", order)
    one = whole()      # one row per label
    fixed = F.coalesce(F.sum(F.when(F.col("__o") == len(removable), F.col("n"))).over(one), F.lit(0))
    earlier = F.coalesce(F.sum(F.when(F.col("__o") < len(removable), F.col("n"))).over(
        one.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    excess = F.sum("n").over(one) - F.lit(int(target_total))
    cut = F.least(F.col("n"), F.greatest(excess - earlier, F.lit(0)))
    msg = "target_total is below the count of labels that cannot be removed"
    guard = F.when(fixed > target_total, F.raise_error(F.lit(msg)).cast("long"))
    return n.withColumn("target", F.coalesce(guard, F.when(
        F.col("__o") < len(removable), F.col("n") - cut).otherwise(F.col("n")))).drop("__o")


def keep_plan(sizes: DataFrame, seed: int, label: str = "label", group: str = "ar") -> DataFrame:
    """Rows to keep per (label, group) for a per-label target.

    Input: label, group, size, target.  With at least one row to keep per
    group, every group keeps one and the rest is shared in proportion to what
    is left in it: floors first, then one more for groups drawn by their
    remainders.  With fewer rows than groups, groups are drawn by size and
    keep one row each.
    """
    def with_totals(t: DataFrame, **aggs: Column) -> DataFrame:
        tot = t.groupBy(label).agg(*[c.alias(n) for n, c in aggs.items()])
        return t.join(tot, label)       # one row per label; no hint, AQE checks the size

    p = with_totals(sizes, __g=F.count(F.lit(1)), __tot=F.sum("size"),
                    __resum=F.sum((F.col("size") - 1).cast("double")))
    p = (p.withColumn("__t", F.greatest(F.lit(0), F.least(F.col("target"), F.col("__tot"))))
         .withColumn("__many", F.col("__t") >= F.col("__g"))
         .withColumn("__rest", F.col("__t") - F.col("__g"))
         .withColumn("__res", (F.col("size") - 1).cast("double")))
    ideal = F.coalesce(F.try_divide(F.col("__res"), F.col("__resum")) * F.col("__rest"), F.lit(0.0))
    p = (p.withColumn("__ideal", F.when(F.col("__many"), ideal).otherwise(F.lit(0.0)))
         .withColumn("__fl", F.floor("__ideal"))
         .withColumn("__rem", F.col("__ideal") - F.col("__fl")))
    p = with_totals(p, __flsum=F.sum("__fl"), __remsum=F.sum("__rem"))
    p = (p.withColumn("__left", F.col("__rest") - F.col("__flsum"))
         .withColumn("__w", F.when(~F.col("__many"), F.col("size").cast("double"))
                     .when(F.col("__remsum") > 0, F.col("__rem")).otherwise(F.col("__res")))
         .withColumn("__gid", F.concat_ws(":", F.col(label), F.col(group).cast("string"))))
    p = materialise(p)
    # the same for all groups of a label: whether their order decides anything
    drawn = F.coalesce(F.when(F.col("__many"), (F.col("__resum") > 0) & (F.col("__left") > 0)).otherwise(F.col("__t") > 0), F.lit(True))
    p = rank_weighted(p.where(drawn), [label], "__gid", "__w", seed).unionByName(
        p.where(~drawn).withColumn("rk", F.lit(None).cast("long")))
    keep = F.when(F.col("__many"), F.least(
        F.col("size"), 1 + F.col("__fl")
        + F.when((F.col("__resum") > 0) & (F.col("rk") <= F.col("__left")), 1).otherwise(0))) \
        .otherwise(F.when(F.col("rk") <= F.col("__t"), 1).otherwise(0))
    return p.select(label, group, "size", F.col("__t").alias("target"),
                    keep.cast("long").alias("keep_n"))


def downsample(df: DataFrame, id: str, group: str, label: str, target_total: int | None = None,
               targets: dict[str, int] | None = None, seed: int = 0,
               removable: Sequence[str] = ("NONE", "C")) -> DataFrame:
    """Add ``keep``: group-aware downsampling of the removable labels.

    ``label`` may be any class column; rows without a label are not removable and stay.
    Filter on ``keep`` for the kept rows and on its negation for the removed ones.
    """
    sizes = materialise(df.groupBy(F.col(label).alias("label"), F.col(group).alias("ar"))
                        .agg(F.count(F.lit(1)).alias("size")))
    goals = downsample_targets(sizes, "label", target_total, targets, removable, "size")
    plan = keep_plan(sizes.join(goals.select("label", "target"), "label"), seed)
    plan = plan.select(F.col("label").alias(label), F.col("ar").alias(group), "size", "keep_n")
    quotas = plan.select(label, group, F.col("size").alias("n"), F.col("keep_n").alias("k"))
    out = first_k(df, [label, group], id, seed, quotas, "__in")
    return out.withColumn("keep", F.col(label).isNull() | F.col("__in")).drop("__in")


def plan_mismatch(df: DataFrame, plan: DataFrame, label: str = "label",
                  group: str = "ar") -> DataFrame:
    """(label, group) pairs whose kept rows differ from the plan; empty when aligned."""
    kept = df.groupBy(label, group).agg(F.count_if("keep").alias("kept"))
    return (plan.join(kept, [label, group], "full_outer")
            .where(F.coalesce("kept", F.lit(0)) != F.coalesce("keep_n", F.lit(0))))


def before_after(df: DataFrame, label: str, group: str) -> DataFrame:
    """Rows before and after per (label, group), and whether the group lost all of them."""
    return (df.groupBy(label, group)
            .agg(F.count(F.lit(1)).alias("n_before"), F.count_if("keep").alias("n_after"))
            .withColumn("lost", (F.col("n_after") == 0)))


def split_sizes(fractions: tuple[float, float, float]):
    """Column expressions of train, cv and test totals from the column ``n_total``."""
    n = F.col("n_total").cast("double")
    train, cv = F.bround(n * fractions[0]), F.bround(n * fractions[1])
    over = F.greatest(train + cv - n, F.lit(0.0))       # taken from cv first, then train
    cv2 = F.greatest(cv - over, F.lit(0.0))
    train2 = train - F.greatest(over - cv, F.lit(0.0))
    return train2, cv2, F.greatest(n - train - cv, F.lit(0.0))


def split_quotas(df: DataFrame, cls: str, fractions: tuple[float, float, float],
                 train_targets: dict[str, int] | None = None,
                 strategy: str = "downsample") -> DataFrame:
    """Per class: size, train and cv quotas, and the totals (one row per class).

    Without targets, quotas are half-even rounded shares of the class.  With
    targets, train quotas are the targets, capped by what is there; if they
    exceed the train budget they are scaled down (floor).  ``oversample`` lets
    a quota exceed the class.  The cv quota is then a share of what is left.
    """
    if strategy not in ("downsample", "oversample"):
        raise ValueError("strategy is 'downsample' or 'oversample'")
    one = whole()      # one row per class
    q = (df.groupBy(F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
         .withColumn("n_total", F.sum("n").over(one)))
    train_n, cv_n, test_n = split_sizes(fractions)
    q = q.withColumns({"train_n": train_n, "cv_n": cv_n, "test_n": test_n})
    n = F.col("n").cast("double")
    if train_targets is None:
        q = q.withColumn("train_q", F.bround(n * (F.col("train_n") / F.col("n_total"))))
        q = q.withColumn("train_want", F.col("train_q"))
        cv_q = F.bround(n * (F.col("cv_n") / F.col("n_total")))
    else:
        goal = F.lit(0.0)
        for c, t in train_targets.items():
            goal = F.when(F.col("cls") == c, F.lit(float(t))).otherwise(goal)
        if strategy == "downsample":
            q = q.withColumn("__g", F.least(goal, n)).withColumn("__s", F.sum("__g").over(one))
            scaled = F.floor(F.col("__g") * (F.col("train_n") / F.nullif("__s", F.lit(0.0))))
            want = F.when(F.col("__s") > F.col("train_n"), scaled.cast("double")) \
                .otherwise(F.col("__g"))
            q = q.withColumn("train_want", want).drop("__g", "__s")
        else:
            q = q.withColumn("train_want", goal)
        q = q.withColumn("train_q", F.least(F.col("train_want"), n))
        q = q.withColumn("__left", n - F.col("train_q"))
        total = F.sum("__left").over(one)
        cv_q = F.coalesce(F.bround(F.col("__left") * (F.col("cv_n") / F.nullif(total, F.lit(0.0)))),
                          F.lit(0.0))
    q = q.withColumn("cv_q", F.least(cv_q, n - F.col("train_q")))
    cols = ["n", "n_total", "train_n", "cv_n", "test_n", "train_want", "train_q", "cv_q"]
    return q.select("cls", *[F.col(c).cast("long").alias(c) for c in cols])


def stratified_split(df: DataFrame, id: str, cls: str, fractions: tuple[float, float, float],
                     seed: int, train_targets: dict[str, int] | None = None,
                     strategy: str = "downsample") -> DataFrame:
    """Add ``split``: train, cv, test or unused.

    The test set is what train and cv leave, cut at random to its total; the
    rows beyond it are ``unused``.  With ``strategy='oversample'`` duplicates of
    a class short of its train target are appended (column ``copy`` > 0).
    """
    quotas = materialise(split_quotas(df, cls, fractions, train_targets, strategy))
    q = quotas.withColumnRenamed("cls", cls)
    out = first_k(df, [cls], id, f"{seed}:class", q.select(cls, "n", F.col("train_q").alias("k")), "__train")
    out = first_k(out, [cls], id, f"{seed}:class", q.select(cls, "n", (F.col("train_q") + F.col("cv_q")).alias("k")), "__cv")
    out = out.withColumn("split", F.when(F.col("__train"), "train").when(F.col("__cv"), "cv").otherwise("test")).drop("__train", "__cv")
    # one row of totals tells whether the test set needs cutting at all
    over = quotas.agg(F.sum(F.col("n") - F.col("train_q") - F.col("cv_q")).alias("left"),
                      F.max("test_n").alias("test_n")).first()
    if over["left"] is not None and over["left"] > over["test_n"]:
        test = df.sparkSession.createDataFrame([("test", over["left"], over["test_n"])], "split string, n long, k long")
        out = first_k(out, ["split"], id, f"{seed}:test", test, "__in")
        cut = (F.col("split") == "test") & ~F.col("__in")
        out = out.withColumn("split", F.when(cut, "unused").otherwise(F.col("split"))).drop("__in")
    if train_targets and strategy == "oversample":
        extra = oversample_draws(df, id, cls, quotas, seed)
        out = out.withColumn("copy", F.lit(0).cast("long")).unionByName(extra)
    return out


def oversample_draws(df: DataFrame, id: str, cls: str, quotas: DataFrame,
                     seed: int) -> DataFrame:
    """Duplicates that lift each class to its train target: draw j of a class picks its
    row number floor(u * n) + 1."""
    need = quotas.withColumn("need", F.col("train_want") - F.col("train_q")) \
        .where((F.col("need") > 0) & (F.col("n") > 0))
    draws = expand(need, "need", "copy")
    draws = draws.withColumn("rk", F.floor(
        uniform(f"{seed}:draw", F.col("cls"), F.col("copy")) * F.col("n")) + 1)
    pool = rank_uniform(df, [cls], id, f"{seed}:class")
    return (draws.select(F.col("cls").alias(cls), "rk", "copy").join(pool, [cls, "rk"])
            .withColumn("split", F.lit("train")).select(*df.columns, "split", "copy"))


def expand(df: DataFrame, n: str, name: str, chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``n`` times with a 1-based counter, in chunks spread over the cluster."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(chunk)))
    parts = df.withColumn("__c", starts).repartition("__c", *df.columns)
    return parts.withColumn(name, F.explode(F.sequence(
        F.col("__c") + 1, F.least(F.col("__c") + chunk, F.col(n).cast("long"))))).drop("__c")


def weighted_bootstrap(df: DataFrame, id: str, w: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn with replacement, probability proportional to ``w``: adds ``draw``.

    Rows own consecutive intervals of the cumulative weight (in id order) and
    draw j lands at u_j times the total; rows and draws meet on one sorted
    line instead of a range join.
    """
    wt = F.greatest(F.coalesce(F.col(w).cast("double"), F.lit(0.0)), F.lit(0.0))
    cum = running(with_quantile_segment(df, id), [], [id], F.col("__qseg"), __cum=("sum", wt)) \
        .drop("__qseg").withColumn("__at", F.col("__cum") - wt).where(wt > 0)
    total = df.agg(F.sum(wt)).scalar()
    draws = df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw")).withColumn(
        "__at", uniform(seed, "draw") * total).withColumn("__k", F.lit(1))
    line = cum.select(F.struct(*df.columns).alias("__row"), "__at", F.lit(0).alias("__k")) \
        .unionByName(draws, allowMissingColumns=True)
    # draws are uniform over the total and rows cover it: equal slices are balanced
    out = running(line, [], ["__at", "__k"], uniform_segment(line, F.col("__at") / total),
                  __pick=("last", F.col("__row")))
    return out.where(F.col("__k") == 1).select("draw", "__pick.*")
