"""Evaluation of matches and candidates against true pairs.

anchors has s1_id; truth and predicted have (s1_id, cand_id).  Every anchor counts, also
without any pair on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(anchors: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, tp) of every anchor."""
    return _with_all(anchors, truth, predicted.select(F.lit(0).alias("_one"), "s1_id", "cand_id"), [0], "_one").drop("_one")


def f05() -> Column:
    """F0.5 of an anchor; a true singleton is right if nothing is predicted."""
    p, r = F.col("tp") / F.col("n_pred"), F.col("tp") / F.col("n_true")
    return F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when((F.col("n_true") == 0) | (F.col("n_pred") == 0) | (F.col("tp") == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_scores(anchors: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return counts(anchors, truth, predicted).withColumn("f05", f05())


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def summary(per_entity: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The metrics document: macro and pair measures and the singleton counters."""
    n_true, n_pred, tp = F.col("n_true"), F.col("n_pred"), F.col("tp")
    precision = F.when(n_pred == 0, 1.0).otherwise(tp / n_pred)
    recall = F.when(n_true == 0, 1.0).otherwise(tp / n_true)
    return per_entity.groupBy(*by).agg(
        F.avg(f05()).alias("macro_f05"),
        _share(F.sum("tp"), F.sum("n_pred")).alias("pair_precision"),
        _share(F.sum("tp"), F.sum("n_true")).alias("pair_recall"),
        F.avg(precision).alias("macro_precision"),
        F.avg(recall).alias("macro_recall"),
        F.sum("tp").alias("total_tp"),
        F.sum(n_pred - tp).alias("total_fp"),
        F.sum(n_true - tp).alias("total_fn"),
        F.count_if(n_true == 0).alias("singletons"),
        F.count_if(n_pred == 0).alias("predicted_singletons"),
        F.count_if((n_true == 0) & (n_pred > 0)).alias("false_on_singletons"),
        F.count_if((n_true == 0) & (n_pred == 0)).alias("right_singletons"),
    )


def macro_f05_union(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The variant over anchors that have a true or a predicted pair; an anchor without a hit scores 0."""
    keys = truth.select("s1_id").union(predicted.select("s1_id")).distinct()
    return counts(keys, truth, predicted).agg(F.avg(f05()).alias("macro_f05"), F.count(F.lit(1)).alias("entities"))


def blocking_report(anchors: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pair recall, candidate precision, coverage (an anchor with a hit or without true pairs) and volumes."""
    c = counts(anchors, truth, candidates)
    return c.agg(
        _share(F.sum("tp"), F.sum("n_true")).alias("pair_recall"),
        _share(F.sum("tp"), F.sum("n_pred")).alias("candidate_precision"),
        F.avg(F.when((F.col("tp") > 0) | (F.col("n_true") == 0), 1.0).otherwise(0.0)).alias("entity_coverage"),
        F.sum("n_pred").alias("candidates"),
        F.avg("n_pred").alias("candidates_per_entity"),
    )


def blocking_by_k(anchors: DataFrame, truth: DataFrame, rules: DataFrame, ranked: DataFrame, ks: list[int]) -> DataFrame:
    """The blocking report of the rules' pairs together with the first k ranked ones (s1_id, cand_id, rank), for each k, in one job."""
    keys = ["s1_id", "cand_id"]
    # A pair is one row with the least k that has it, so what is shuffled doesn't grow with the number of ks. True pairs go the same way.
    least = F.least(*(F.when(F.col("rank") <= k, k) for k in ks), F.lit(None).cast("int"))
    found = rules.select(*keys, F.lit(min(ks)).alias("k"), F.lit(0).alias("hit")).union(ranked.select(*keys, least.alias("k"), F.lit(0)).where("k is not null"))
    rows = found.union(truth.select(*keys, F.lit(None).cast("int"), F.lit(1))).repartition("s1_id")
    pairs = rows.groupBy(*keys).agg(F.min("k").alias("k"), F.max("hit").alias("hit"))
    of = lambda k: F.struct(F.lit(k).alias("top_k"), F.count_if(F.col("k") <= k).alias("n_pred"), F.count_if((F.col("k") <= k) & (F.col("hit") == 1)).alias("tp"))
    by_anchor = pairs.groupBy("s1_id").agg(F.sum("hit").alias("n_true"), F.array(*map(of, ks)).alias("c"))
    none = F.array(*(F.struct(F.lit(k).alias("top_k"), F.lit(0).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("tp")) for k in ks))
    every = anchors.select("s1_id").distinct().join(by_anchor, "s1_id", "left")
    c = every.select(F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(F.coalesce("c", none)).alias("c")).select("n_true", "c.*")
    return c.groupBy("top_k").agg(
        F.sum("n_pred").alias("candidate_count"),
        F.avg("n_pred").alias("avg_candidates_per_entity"),
        _share(F.sum("tp"), F.sum("n_true")).alias("pair_recall"),
        F.avg(F.when((F.col("tp") > 0) | (F.col("n_true") == 0), 1.0).otherwise(0.0)).alias("entity_coverage"),
    )


def singleton_breakdown(per_entity: DataFrame) -> DataFrame:
    """Mean F0.5 of singletons and of others."""
    return per_entity.groupBy((F.col("n_true") == 0).alias("singleton")).agg(F.count(F.lit(1)).alias("entities"), F.avg(f05()).alias("macro_f05"))


def blend(per_entity: DataFrame, shares: tuple[float, ...] = (0.056, 0.15, 0.25, 0.35, 0.50)) -> DataFrame:
    """What the macro measure would be if singletons had another share."""
    parts = per_entity.agg(F.avg(F.when(F.col("n_true") == 0, f05())).alias("a"), F.avg(F.when(F.col("n_true") > 0, f05())).alias("f"))
    return parts.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "a", "f").select("share", (F.col("share") * F.coalesce("a", F.lit(0.0)) + (1 - F.col("share")) * F.coalesce("f", F.lit(0.0))).alias("macro_f05"))


def score_spread(per_entity: DataFrame) -> DataFrame:
    return per_entity.agg(F.min(f05()).alias("least"), F.max(f05()).alias("most"), F.median(f05()).alias("middle"))


def threshold_sweep(anchors: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """The summary at each threshold, in one job: the thresholds are exploded over the scored pairs."""
    rows = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col("prob") >= F.col("threshold"))
    c = _with_all(anchors, truth, rows, thresholds, "threshold")
    return summary(c, ("threshold",))


def _with_all(anchors: DataFrame, truth: DataFrame, rows: DataFrame, settings: list, name: str) -> DataFrame:
    """Counts for every anchor and every setting, also those that select nothing."""
    keys = ["s1_id", "cand_id"]
    marked = rows.select(name, *keys).distinct().join(truth.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    by_pred = marked.groupBy(name, "s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"))
    by_true = truth.select(*keys).distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    base = anchors.select("s1_id").distinct().join(by_true, "s1_id", "left").withColumn(name, F.explode(F.array(*map(F.lit, settings))))
    return base.join(by_pred, [name, "s1_id"], "left").select(name, "s1_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_true", "n_pred", "tp")))


RULES = ("none", "num", "disjoint", "disjoint_long")


def grid_of_rules(thresholds: list[float], options: list[tuple[str, float]]) -> list[tuple[str, float, str, float]]:
    """(strategy, threshold, rule, least name similarity) for every threshold under every option (rule, least)."""
    return [(f"{t:.2f}/{rule}/{least:.2f}", t, rule, least) for rule, least in options for t in thresholds]


# Thresholds and rules of the three grids that were tried.
GRID_NUMBERS = grid_of_rules([0.87, 0.88, 0.89, 0.90, 0.91, 0.92], [("none", 0.0), ("num", 0.0), ("num", 0.60)]) + grid_of_rules([0.88, 0.89, 0.90], [("num", 0.65)])
GRID_SINGLETONS = grid_of_rules([0.87, 0.90, 0.92, 0.95], [("none", 0.0)]) + grid_of_rules([0.87], [("num", 0.0)]) + grid_of_rules([0.87, 0.88, 0.90, 0.92], [("num", 0.60)])
GRID_DISJOINT = grid_of_rules([0.85, 0.86, 0.87, 0.88, 0.89, 0.90, 0.91, 0.92], [("none", 0.0), ("disjoint", 0.0), ("disjoint_long", 0.0)])


def rule_grid(anchors: DataFrame, truth: DataFrame, scored: DataFrame, grid: list[tuple[str, float, str, float]], per_source: int = 3) -> DataFrame:
    """The summary of each strategy of a grid, in one job over pairs scored once.

    scored has prob, jw (the names' similarity), number_conflict and disjoint, disjoint_long (see ``decide.with_marks``).
    A strategy keeps pairs from its threshold on, drops those that its rule refuses (disjoint numbers only where
    jw is below 0.95) or whose jw is below its least, and of each source the ``per_source`` likeliest.
    """
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(t).alias("threshold"), F.lit(r).alias("rule"), F.lit(m).alias("least")) for n, t, r, m in grid))).alias("g")
    refused = F.when(F.col("g.rule") == "num", F.col("number_conflict")).when(F.col("g.rule") == "disjoint", F.col("disjoint") & (F.col("jw") < 0.95)).when(F.col("g.rule") == "disjoint_long", F.col("disjoint_long") & (F.col("jw") < 0.95)).otherwise(False)
    lowest = min(t for _, t, _, _ in grid)
    kept = scored.where(F.col("prob") >= lowest).select("s1_id", "cand_id", "src", "prob", "jw", "number_conflict", "disjoint", "disjoint_long", rows).where((F.col("prob") >= F.col("g.threshold")) & ~refused & (F.col("jw") >= F.col("g.least")))
    best = Window.partitionBy("g.strategy", "s1_id", "src").orderBy(F.col("prob").desc(), "cand_id")
    chosen = kept.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_source).select(F.col("g.strategy").alias("strategy"), "s1_id", "cand_id")
    return summary(_with_all(anchors, truth, chosen, [n for n, _, _, _ in grid], "strategy"), ("strategy",))


def strategy_grid(anchors: DataFrame, truth: DataFrame, strategies: dict[str, DataFrame]) -> DataFrame:
    """The summary of each named set of predicted pairs, in one job."""
    rows = None
    for name, pairs in strategies.items():
        part = pairs.select(F.lit(name).alias("strategy"), "s1_id", "cand_id")
        rows = part if rows is None else rows.unionByName(part)
    return summary(_with_all(anchors, truth, rows, list(strategies), "strategy"), ("strategy",))


def probability_spread(scored: DataFrame, truth: DataFrame, cutoffs: list[float]) -> DataFrame:
    """How many pairs, and how many true ones, reach each cutoff."""
    marked = scored.select("s1_id", "cand_id", "prob").join(truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    rows = marked.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    return rows.groupBy("cutoff").agg(F.count_if(F.col("prob") >= F.col("cutoff")).alias("pairs"), F.count_if((F.col("prob") >= F.col("cutoff")) & (F.col("hit") == 1)).alias("true_pairs"))


def missed_pairs(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    return truth.select("s1_id", "cand_id").distinct().join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with ``label`` 1 where they are true."""
    marks = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(marks, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def augmented(pairs: DataFrame, truth: DataFrame, records: DataFrame, score: int = 95) -> DataFrame:
    """Candidate pairs and the true pairs that blocking missed (for training only)."""
    sides = records.select(F.col("entity_id").alias("cand_id"), "src")
    missed = missed_pairs(truth, pairs).join(sides, "cand_id").select("s1_id", "cand_id", "src", F.lit(score).alias("score"))
    return pairs.select("s1_id", "cand_id", "src", "score").unionByName(missed)
