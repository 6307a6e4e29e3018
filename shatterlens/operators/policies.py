"""Search policies: which record to expand next, which family to try, how credit moves.

Records have run_id, node_id, parent_id, idx, valid, rank_score and more; every policy is a top-1 or
an aggregate per run over all runs at once. Random policies draw by hashes of the run and a seed, so a run's draw never
depends on the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from shatterlens.operators import draws as dr
from shatterlens.operators.adaptive import Blend
from shatterlens.operators.ranking import pareto, search_scores, similarity_flags
from shatterlens.operators.windows import average_rank

#: Fixed value: what a family without records counts in a normal draw.
UNSEEN = 10.0
#: Quotas of the branches in a budget of 200.
BRANCH_QUOTAS = (("Q", 60), ("S", 60), ("B", 50), ("R", 30))


def with_children(records: DataFrame) -> DataFrame:
    """``children``: how many records of the run name this one as parent; ``n_run``: records of the run."""
    counts = records.where(F.col("parent_id").isNotNull()).groupBy("run_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    sizes = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_run"))
    return records.join(counts, ["run_id", "node_id"], "left").na.fill(0, ["children"]).join(sizes, "run_id")


def best_of(rows: DataFrame, keys: list[str], value: Column, ties: list[Column], name: str = "value") -> DataFrame:
    """The row of greatest value of each key, with the value."""
    placed = rows.withColumn(name, value).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(name), *ties)))
    return placed.where("_n = 1").drop("_n")


def stage_parent(records: DataFrame) -> DataFrame:
    """Score plus 0.10 / (1 + children); ties: greater score, fewer children, larger id."""
    score = F.coalesce("rank_score", F.lit(0.0))
    return best_of(with_children(records).where("valid"), ["run_id"], score + 0.10 / (1 + F.col("children")), [F.desc(score), F.asc("children"), F.desc("node_id")])


def depth_parent(records: DataFrame, branch: str | None = None) -> DataFrame:
    """Score plus 0.10 / sqrt(1 + children) - 0.005 depth; ties: fewer children, shallower, larger id.

    With ``branch`` only rows of that tree_branch compete in the runs that have valid ones.
    """
    rows = with_children(records).where("valid")
    if branch:
        inside = F.coalesce(F.col("tree_branch") == branch, F.lit(False))
        rows = rows.withColumn("_has", F.max(inside).over(Window.partitionBy("run_id"))).where(inside | ~F.col("_has")).drop("_has")
    value = F.coalesce("rank_score", F.lit(0.0)) + 0.10 / F.sqrt(1.0 + F.col("children")) - 0.005 * F.col("depth")
    return best_of(rows, ["run_id"], value, [F.asc("children"), F.asc("depth"), F.desc("node_id")])


def branch_schedule(budget: int) -> list[str]:
    """Branch of each unit of a budget, proportional to the quotas."""
    if budget < 4:
        return [("Q", "S", "B")[i % 3] for i in range(budget)]
    counts = {name: max(1, round(budget * q / 200)) for name, q in BRANCH_QUOTAS}
    while (off := budget - sum(counts.values())) != 0:
        name = "Q" if off > 0 else max(counts, key=counts.__getitem__)
        counts[name] = max(1, counts[name] + (1 if off > 0 else -1))
    return [name for name, n in counts.items() for _ in range(n)]


def _exploration(c: float) -> Column:
    return c * F.sqrt(F.log(F.greatest(F.lit(2), F.col("n_run")).cast("double")) / (1.0 + F.col("children")))


def uct_parent(records: DataFrame, c: float = 1.35, depth_weight: float | None = None) -> DataFrame:
    """Score (at least 0) plus exploration; with ``depth_weight`` the score is divided by 1 + weight * depth."""
    q = F.greatest(F.lit(0.0), F.coalesce("rank_score", F.lit(0.0)))
    if depth_weight is not None:
        q = q / (1.0 + depth_weight * F.col("depth"))
    return best_of(with_children(records).where("valid"), ["run_id"], q + _exploration(c), [F.asc("idx"), F.asc("node_id")])


def clade_table(records: DataFrame, clade: str) -> DataFrame:
    """(run_id, clade, n, wins, losses, median_all): wins are scores at or above the run's median of valid rows."""
    valid = records.where("valid").withColumn("_s", F.coalesce("rank_score", F.lit(0.0)))
    middle = valid.groupBy("run_id").agg(F.median("_s").alias("median_all"))
    rows = valid.join(middle, "run_id")
    win = (F.col("_s") >= F.col("median_all")).cast("bigint")
    return rows.groupBy("run_id", F.coalesce(clade, F.lit("simple")).alias("clade"), "median_all").agg(F.count(F.lit(1)).alias("n"), F.sum(win).alias("wins"), F.sum(1 - win).alias("losses"))


def clade_choice(table: DataFrame, seed: int = 0) -> DataFrame:
    """(run_id, clade, theta): the clade with the greatest draw of Beta(1 + wins, 1 + losses) + 0.08 / sqrt(n)."""
    drawn = dr.beta(table.withColumns({"_w": F.col("wins") + 1, "_l": F.col("losses") + 1}), ["run_id", "clade"], "_w", "_l", seed)
    return best_of(drawn, ["run_id"], F.col("theta") + 0.08 / F.sqrt(F.col("n").cast("double")), [F.desc("clade")], "theta").select("run_id", "clade", "theta")


def clade_parent(records: DataFrame, clade: str, seed: int = 0) -> DataFrame:
    """A draw from the five best records of each run's chosen clade."""
    named = records.withColumn("clade", F.coalesce(clade, F.lit("simple")))
    chosen = clade_choice(clade_table(records, clade), seed).select("run_id", "clade")
    return dr.one_per_key(top_pool(named.join(chosen, ["run_id", "clade"]), ["run_id"], 5), ["run_id"], "node_id", seed)


def island_of(node: Column, islands: int = 6) -> Column:
    """Island of a record by the first four hex digits of its hash; the root is on island 0."""
    return F.when(node == "hda_root", 0).otherwise((F.conv(F.substring(F.sha1(node.cast("binary")), 1, 4), 16, 10).cast("int") % islands)).cast("int")


def top_pool(records: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best valid rows of each key with their ``place``: the pool a policy draws from."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("rank_score", F.lit(0.0))), F.asc("idx"), F.asc("node_id"))
    return records.where("valid").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def uniform_draw(pool: DataFrame, key: str, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """One row per key, with chance proportional to ``weight``."""
    return dr.one_per_key(pool, [key], "node_id", seed, weight)


def island_parent(records: DataFrame, seed: int = 0, islands: int = 6) -> DataFrame:
    """A draw from the four best records of the island whose turn it is, or of the run if that island has none; the turn is the run's number of valid records."""
    valid = records.where("valid").withColumns({"island": island_of(F.col("node_id"), islands), "_turn": F.count(F.lit(1)).over(Window.partitionBy("run_id")) % islands})
    here = F.col("island") == F.col("_turn")
    pool = valid.withColumn("_any", F.max(here).over(Window.partitionBy("run_id"))).where(here | ~F.col("_any")).drop("_any", "_turn")
    return uniform_draw(top_pool(pool, ["run_id"], 4), "run_id", seed)


def niche_parent(records: DataFrame, niche: str, seed: int = 0, share: float = 0.20) -> DataFrame:
    """The best record of a niche drawn by weight, or with chance ``share`` a draw of all valid ones."""
    valid = records.where("valid").withColumn("niche", F.coalesce(niche, F.lit("root")))
    drawn = dr.one_per_key(niche_weights(records, niche), ["run_id"], "niche", seed, F.col("weight")).select("run_id", "niche")
    best = top_pool(valid.join(drawn, ["run_id", "niche"]), ["run_id"], 1).select("run_id", "node_id")
    return mixed_draw(best, valid.select("run_id", "node_id"), "run_id", share, seed)


def niche_weights(records: DataFrame, niche: str) -> DataFrame:
    """(run_id, niche, n, weight): chance of each archive niche, 1 / sqrt(n) normalised per run."""
    counts = records.where("valid").groupBy("run_id", F.coalesce(niche, F.lit("root")).alias("niche")).agg(F.count(F.lit(1)).alias("n"))
    raw = 1 / F.sqrt(F.col("n").cast("double"))
    return counts.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy("run_id")))


def family_means(records: DataFrame, family: str) -> DataFrame:
    """(run_id, family, n, mean, spread, bonus): what a Gaussian family choice draws with; unseen families are drawn first."""
    rows = records.where("valid").groupBy("run_id", F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("rank_score", F.lit(0.0))).alias("mean"))
    root = F.sqrt(F.col("n").cast("double"))
    return rows.withColumns({"spread": 0.10 + 0.15 / root, "bonus": 0.08 / root})


def family_draw(records: DataFrame, family: str, families: Sequence[str], seed: int = 0) -> DataFrame:
    """(run_id, family, value): the one of ``families`` with the greatest normal draw plus bonus; one without records has UNSEEN."""
    means = family_means(records, family)
    every = records.select("run_id").distinct().withColumn("family", F.explode(F.array(*map(F.lit, families)))).join(means, ["run_id", "family"], "left")
    value = F.coalesce(F.col("mean") + F.col("spread") * dr.normal(F.col("run_id"), F.col("family"), seed) + F.col("bonus"), F.lit(UNSEEN))
    return best_of(every, ["run_id"], value, [F.asc("family")]).select("run_id", "family", "value")


def squared_draw(records: DataFrame, keys: list[str], k: int = 8, seed: int = 0) -> DataFrame:
    """One of the ``k`` best records of each key, with chance by squared score."""
    return dr.one_per_key(squared_weights(records, keys, k), keys, "node_id", seed, F.col("weight"))


def squared_weights(records: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """The ``k`` best of each key with ``weight``: squared score over the pool's sum."""
    pool = top_pool(records, keys, k)
    raw = F.pow(F.greatest(F.lit(1e-6), F.coalesce("rank_score", F.lit(0.0))), F.lit(2.0))
    return pool.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy(*keys)))


def diagnostics(records: DataFrame, family: str) -> DataFrame:
    """(run_id, family, needs_scale, needs_fragmentation, needs_speed): the family's best against the run's medians, each within [0.05, 0.95]."""
    valid = records.where("valid")
    middle = valid.groupBy("run_id").agg(F.median("r").alias("m_r"), F.median("cnbi").alias("m_cnbi"), F.median("time_s").alias("m_time_s"))
    best = valid.groupBy("run_id", F.col(family).alias("family")).agg(*[F.max_by(c, F.struct(F.coalesce("rank_score", F.lit(0.0)), "idx")).alias(c) for c in ("r", "cnbi", "time_s")])
    off = lambda c, sign, start: F.least(F.greatest(sign * (F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"m_{c}"), F.lit(1e-9)) + start, F.lit(0.05)), F.lit(0.95))
    return best.join(middle, "run_id").select("run_id", "family", off("r", 1, 0.45).alias("needs_scale"), off("cnbi", -1, 0.45).alias("needs_fragmentation"), off("time_s", 1, 0.20).alias("needs_speed"))


def mixed_draw(best: DataFrame, pool: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """One row per key: a draw from ``pool`` with chance ``share``, else the row of ``best``."""
    coin = dr.chance(share, [key], seed)
    return best.where(~coin).unionByName(uniform_draw(pool.where(coin), key, seed).select(*best.columns))


def explored_parent(records: DataFrame, chosen: DataFrame, family: str, score: str = "gated", share: float = 0.18, seed: int = 0) -> DataFrame:
    """(run_id, node_id) for chosen(run_id, family): the best valid record of the family, the root aside, or of the run if it has none.

    With chance ``share`` a draw from the six best, where there are more than three.
    """
    rows = records.where("valid").join(chosen.select("run_id", F.col("family").alias("_chosen")), "run_id")
    inside = F.coalesce(F.col(family) == F.col("_chosen"), F.lit(False)) & (F.col("idx") > 0)
    run = Window.partitionBy("run_id")
    rows = rows.withColumn("_in", inside).withColumn("_any", F.max("_in").over(run)).where(F.col("_in") | ~F.col("_any"))
    rows = rows.withColumns({"_p": F.row_number().over(run.orderBy(F.desc(score), F.asc("idx"), F.asc("node_id"))), "_size": F.count(F.lit(1)).over(run)})
    pool = rows.where(F.col("_p") <= 6)
    coin = dr.chance(share, ["run_id"], seed) & (F.col("_size") > 3)
    drawn = uniform_draw(pool.where(coin), "run_id", seed)
    return pool.where(~coin & (F.col("_p") == 1)).select("run_id", "node_id").unionByName(drawn.select("run_id", "node_id"))


def explored_family(credits: DataFrame, c: float, over_use: float = 0.0, share: float = 0.12, warm_up: int = 6, seed: int = 0) -> DataFrame:
    """(run_id, family): each family in turn up to step ``warm_up``, then with chance ``share`` an even draw, else ``family_choice``.

    ``credits`` is as there; families take turns by name.
    """
    run = Window.partitionBy("run_id")
    turn = F.row_number().over(run.orderBy("family"))
    placed = credits.withColumns({"_turn": turn, "_f": F.count(F.lit(1)).over(run)})
    early = placed.where((F.col("idx") <= warm_up) & (F.col("_turn") == (F.col("idx") - 1) % F.col("_f") + 1)).select("run_id", "family")
    late = credits.where(F.col("idx") > warm_up)
    coin = dr.chance(share, ["run_id"], seed)
    even = dr.one_per_key(late.where(coin), ["run_id"], "family", seed).select("run_id", "family")
    return early.unionByName(even).unionByName(family_choice(late.where(~coin), c, over_use).select("run_id", "family"))


def advantage_parent(records: DataFrame, family: str, score: str = "gated") -> DataFrame:
    """The record of greatest ``score`` of each (run_id, family), the root aside."""
    return best_of(records.where(F.col("valid") & (F.col("idx") > 0)), ["run_id", family], F.col(score), [F.asc("idx"), F.asc("node_id")])


def family_choice(credits: DataFrame, c: float, over_use: float = 0.0) -> DataFrame:
    """(run_id, family, value): credit + c sqrt(ln idx / (n + 1)) less a penalty for use above the even share.

    ``credits`` has run_id, family, credit, n (uses so far) and idx (the step to come).
    """
    even = F.col("idx") / F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    bonus = c * F.sqrt(F.log(F.greatest(F.lit(2), F.col("idx")).cast("double")) / (F.col("n") + 1.0))
    value = F.col("credit") + bonus - over_use * F.greatest(F.lit(0.0), F.col("n") - even)
    return best_of(credits, ["run_id"], value, [F.asc("family")]).select("run_id", "family", "value")


def moving_credit(rewards: DataFrame, keys: list[str], order: list[str], keep: float = 0.82, start: float = 0.0) -> DataFrame:
    """(keys, credit) after all rewards: credit = keep * credit + (1 - keep) * reward, step by step.

    The fold is linear, so it is a sum weighted by keep^(rewards after it): an aggregate, not a loop.
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])) - 1
    weighted = rewards.withColumn("_w", F.pow(F.lit(keep), back.cast("double")))
    share = F.sum(F.col("_w") * (1 - keep) * F.col("reward"))
    return weighted.groupBy(*keys).agg((share + start * F.pow(F.lit(keep), F.count(F.lit(1)).cast("double"))).alias("credit"))


def floored_credit(rewards: DataFrame, keys: list[str], order: str | list[str], keep: float = 0.86, start: float = 0.05, floor: float = 0.005) -> DataFrame:
    """The same with a floor at each step.

    A step a -> max(floor, keep a + b) and any run of such steps is a -> max(c, m a + d), so the fold is the greatest of the plain fold from
    the start and of those from the floor after each step: window sums and a maximum, and no list of rewards.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ([order] if isinstance(order, str) else order)])
    back = F.row_number().over(w) - 1
    rows = rewards.withColumn("_k", back.cast("double"))
    rows = rows.withColumn("_share", F.pow(F.lit(keep), F.col("_k")) * (1 - keep) * F.col("reward"))
    later = F.coalesce(F.sum("_share").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_after", later + floor * F.pow(F.lit(keep), F.col("_k")))
    whole = F.sum("_share") + start * F.pow(F.lit(keep), F.count(F.lit(1)).cast("double"))
    return rows.groupBy(*keys).agg(F.greatest(F.max("_after"), whole).alias("credit"))


def advantage_reward(score: str = "gated") -> Column:
    """Reward of a record: its gated score / 60, less for a bad worst case or a slow proxy; -8 if invalid."""
    worst = F.when(F.coalesce("fac_worst_auc_adv", F.lit(0.0)) < -5.0, 0.25).otherwise(0.0)
    slow = F.when(F.coalesce("proxy_time_s", F.lit(0.0)) > 2.0, 0.10).otherwise(0.0)
    return F.when(F.coalesce("valid", F.lit(False)), F.col(score) / 60.0 - worst - slow).otherwise(-8.0)


def learned_credit(records: DataFrame, families: DataFrame, cutoff: int, reference: tuple[float, float, float], tie: str = "node_id") -> DataFrame:
    """Initial credit of each family(family) from the records up to idx ``cutoff``.

    .42 mean score + .22 share in the top fifth + .18 strict + .08 loose + .10 valid - .12 time - .10
    risk, at least 0.01; a family without records has 0.05. ``risk_1..3`` are boolean columns of the records, ``tie`` is unique among them.
    """
    train = search_scores(records.where(F.col("idx") <= cutoff), [], tie)
    train = similarity_flags(train, *reference)
    fit = F.col("rank_score") >= 0
    whole = train.where(fit).agg(F.percentile("rank_score", 0.80).alias("top"), F.min("time_s").alias("t0"), F.max("time_s").alias("t1"))
    rows = train.join(F.broadcast(whole))  # one row
    number = lambda c: F.col(c).cast("double")
    sums = rows.groupBy("family", "t0", "t1").agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(fit.cast("bigint")).alias("n_valid"), F.avg(F.when(fit, F.col("rank_score"))).alias("mean_score"),
        F.avg(F.when(fit, (F.col("rank_score") >= F.col("top")).cast("double"))).alias("top_rate"), F.avg(F.when(fit, number("strict_like"))).alias("strict_rate"),
        F.avg(F.when(fit, number("loose_like"))).alias("loose_rate"), F.avg(F.when(fit, F.col("time_s"))).alias("mean_time"),
        F.avg((number("risk_1") + number("risk_2") + number("risk_3")) / 3).alias("risk"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    late = (F.coalesce("mean_time", "t1") - F.col("t0")) / F.greatest(F.lit(1e-9), F.col("t1") - F.col("t0"))
    credit = 0.42 * z("mean_score") + 0.22 * z("top_rate") + 0.18 * z("strict_rate") + 0.08 * z("loose_rate") + 0.10 * F.col("n_valid") / F.col("n_total") - 0.12 * late - 0.10 * z("risk")
    known = sums.withColumn("credit", F.greatest(F.lit(0.01), credit)).drop("t0", "t1")
    return families.join(known, "family", "left").withColumn("credit", F.coalesce("credit", F.lit(0.05))).na.fill(0, ["n_total", "n_valid"])


def unseen(candidates: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Candidates whose key no record has."""
    return candidates.join(records.select(key).distinct(), key, "left_anti")


def induced_bounds(records: DataFrame, keys: list[str], family: str) -> DataFrame:
    """(keys, n, top_n, runtime_cap, families): the best rows (a tenth is the floor of 5, 30 the most), 4 times their median time and their five most common families."""
    w = Window.partitionBy(*keys)
    valid = records.where("valid").withColumns({"n": F.count(F.lit(1)).over(w), "_p": F.row_number().over(w.orderBy(F.desc("rank_score"), F.asc("node_id")))})
    top = valid.where(F.col("_p") <= F.greatest(F.lit(5), F.least(F.lit(30), F.col("n"))))
    common = top.groupBy(*keys, F.col(family).alias("f")).agg(F.count(F.lit(1)).alias("c"), F.min("_p").alias("at"))
    common = common.withColumn("_k", F.row_number().over(w.orderBy(F.desc("c"), F.asc("at")))).where("_k <= 5").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "f"))), lambda x: x["f"]).alias("families"))
    caps = top.groupBy(*keys).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("top_n"), F.greatest(F.lit(0.05), 4 * F.median("time_s")).alias("runtime_cap"))
    return caps.join(common, keys)


def family_summary(records: DataFrame, keys: list[str], slow: Column) -> DataFrame:
    """Per family: candidates, valid rate, mean and top delta, mean time, top score, share of slow patterns."""
    ok = F.coalesce("valid", F.lit(False))
    of = lambda c: F.when(ok, F.col(c))
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.avg(ok.cast("double")).alias("valid_rate"), F.avg(of("delta")).alias("mean_delta"), F.max(of("delta")).alias("top_delta"),
        F.avg(of("time_s")).alias("mean_time_s"), F.max(of("rank_score")).alias("top_rank_score"), F.avg(F.coalesce(slow, F.lit(False)).cast("double")).alias("slow_pattern_rate"),
    )


def flag_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(name, count, rate) of boolean columns; NULL counts as false."""
    sums = rows.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"), *[F.sum(F.coalesce(F.col(f), F.lit(False)).cast("bigint")).alias(f) for f in flags])
    one = F.array(*[F.struct(F.lit(f).alias("name"), F.coalesce(F.col(f), F.lit(0)).alias("count"), (F.coalesce(F.col(f), F.lit(0)) / F.col("n")).alias("rate")) for f in flags])
    return sums.select(F.inline(one))


def stage_progress(log: DataFrame, stage: str) -> DataFrame:
    """(stage, rows, valid, timeouts, latest): how far a log has come."""
    late = F.coalesce(F.lower("error").contains("timeout"), F.lit(False))
    return log.groupBy(stage).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("valid", F.lit(False)).cast("bigint")).alias("valid_rows"), F.sum(late.cast("bigint")).alias("timeouts"), F.max("logged_at").alias("latest"))


def experiment_summary(records: DataFrame, group: str, slow_s: float, flags: list[str]) -> DataFrame:
    """Per group: counts, rates, means, bests and means of the five best by selection_score, and the size of its Pareto front.

    ``records`` has valid, error, auc_cnbi, r, time_s, delta, wall_s, selection_score and node_id.
    """
    order = Window.partitionBy(group).orderBy(F.desc(F.coalesce("valid", F.lit(False))), F.desc("selection_score"), F.asc("node_id"))
    rows = records.withColumn("_p", F.row_number().over(order)).withColumn("_ok", F.coalesce("valid", F.lit(False)))
    ok, top = F.col("_ok"), F.col("_ok") & (F.col("_p") <= 5)
    of, five = (lambda c: F.when(ok, F.col(c))), (lambda c: F.when(top, F.col(c)))
    front = pareto(records, [group], ["auc_cnbi"], ["r", "time_s"]).groupBy(group).agg(F.count(F.lit(1)).alias("pareto_count"))
    sums = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("candidates"), F.avg(ok.cast("double")).alias("valid_rate"), F.avg((F.coalesce("time_s", F.lit(0.0)) > slow_s).cast("double")).alias("slow_rate"),
        F.avg(F.coalesce(F.contains(F.lower("error"), F.lit("timeout")), F.lit(False)).cast("double")).alias("timeout_rate"),
        F.avg(of("delta")).alias("mean_delta"), F.max(of("delta")).alias("best_delta"), F.avg(five("delta")).alias("top5_delta"),
        F.avg("wall_s").alias("mean_wall_s"), F.avg(five("wall_s")).alias("top5_wall_s"),
        F.avg(of("auc_cnbi")).alias("mean_auc_cnbi"), F.max(of("auc_cnbi")).alias("best_auc_cnbi"), F.avg(five("auc_cnbi")).alias("top5_auc_cnbi"),
        F.avg(of("r")).alias("mean_r"), F.min(of("r")).alias("best_r"), F.avg(of("time_s")).alias("mean_time_s"), F.avg(five("time_s")).alias("top5_time_s"),
        *[F.avg(F.when(ok, F.col(f).cast("double"))).alias(f"{f}_rate") for f in flags],
    )
    return sums.join(front, group, "left").na.fill(0, ["pareto_count"])


def rank_then_count(records: DataFrame, dataset: str, method: str) -> DataFrame:
    """Method means: datasets, three means, first and top-3 places by average rank, mean rank, of valid rows."""
    ranked = records.where("valid").withColumn("_rank", average_rank(F.col("auc_cnbi"), [dataset], descending=True))
    return ranked.groupBy(method).agg(
        F.countDistinct(dataset).alias("datasets"), F.avg("r").alias("mean_r"), F.avg("auc_cnbi").alias("mean_auc_cnbi"), F.avg("time_s").alias("mean_time_s"),
        F.sum((F.col("_rank") <= 1).cast("bigint")).alias("top1_auc"), F.sum((F.col("_rank") <= 3).cast("bigint")).alias("top3_auc"), F.avg("_rank").alias("mean_rank_auc"),
    )


#: Clades of typed blends and the weights that each must have.
CLADES = {
    "degree_core": ("w_degree", "w_core"),
    "open_wedge": ("w_split", "w_degree"),
    "bridge_aware": ("w_split", "w_bridge_mult", "w_degree"),
    "core_scale": ("w_core", "w_nds", "w_degree"),
    "component_aware": ("w_comp", "w_degree"),
    "local_bridge_edges": ("w_bridge_edges", "w_degree"),
}
_WEIGHTS = ("w_split", "w_bridge_mult", "w_degree", "w_nds", "w_core", "w_comp", "w_bridge_edges")


# Factors by which a need moves weights, the greatest weights, powers to choose from, and chances of the other changes.
NUDGES = {
    "needs_scale": {"w_degree": (1.03, 1.25), "w_nds": (1.02, 1.20), "w_core": (1.02, 1.18)},
    "needs_fragmentation": {"w_split": (1.05, 1.28), "w_bridge_mult": (1.05, 1.30)},
    "needs_speed": {"w_bridge_edges": (0.5, 0.9)},
}
MOST_WEIGHT = {"w_split": 4.0, "w_bridge_mult": 4.5, "w_degree": 2.0, "w_nds": 1.5, "w_core": 1.0, "w_comp": 0.8, "w_bridge_edges": 1.2}
POWERS = {"split_power": (0.75, 1.0, 1.15, 1.3), "degree_power": (0.75, 1.0, 1.15), "nds_power": (0.75, 1.0), "core_power": (0.5, 0.75, 1.0)}
CLADE_SHIFT, POWER_CHANGE, RADIUS_FLIP = 0.12, 0.15, 0.10
#: Weights that only blends of one clade have.
OWN_CLADE = {"w_comp": "component_aware", "w_bridge_edges": "local_bridge_edges"}


def random_blend(clade: str, seed: int) -> Blend:
    """A typed blend of a clade: its own weights in [0.5, 2], each other one in [0, 0.5] or, half of the time, 0."""
    rng = np.random.default_rng(seed)
    own = CLADES[clade]
    weights = {n: float(rng.uniform(0.5, 2.0) if n in own else rng.uniform(0, 0.5) * (rng.random() < 0.5)) for n in _WEIGHTS}
    weights = {n: min(w, MOST_WEIGHT[n]) if OWN_CLADE.get(n, clade) == clade else 0.0 for n, w in weights.items()}
    powers = {n: float(rng.choice(choices)) for n, choices in POWERS.items()}
    return Blend(clade=clade, update_radius=int(rng.integers(1, 3)), use_component=clade == "component_aware", **weights, **powers)


def mutated(blend: Blend, seed: int, needs: dict[str, float] | None = None, scale: float = 0.25) -> Blend:
    """A blend with one to three weights perturbed; the same seed gives the same blend.

    Each of ``needs`` (a row of ``diagnostics``) is met with its own chance: the weights of NUDGES move by a factor, and speed also takes
    radius 1. Now and then the clade, a power or the radius changes. Weights of other clades stay 0, none goes beyond MOST_WEIGHT.
    """
    rng = np.random.default_rng(seed)
    changes: dict[str, object] = {}
    if rng.random() < CLADE_SHIFT:
        changes["clade"] = str(rng.choice(list(CLADES)))
    clade = changes.get("clade", blend.clade)
    weights = {n: float(getattr(blend, n)) for n in _WEIGHTS}
    for need, level in sorted((needs or {}).items()):
        if need in NUDGES and rng.random() < level:
            for n, (low, high) in NUDGES[need].items():
                weights[n] *= float(rng.uniform(low, high))
            if need == "needs_speed":
                changes["update_radius"] = 1
    for i in rng.choice(len(_WEIGHTS), size=rng.integers(1, 4), replace=False):
        weights[_WEIGHTS[i]] = float(weights[_WEIGHTS[i]] * (1 + scale * rng.standard_normal()) + 0.05 * rng.random())
    if rng.random() < POWER_CHANGE:
        power = str(rng.choice(list(POWERS)))
        changes[power] = float(rng.choice(POWERS[power]))
    if rng.random() < RADIUS_FLIP:
        changes["update_radius"] = 3 - min(2, max(1, blend.update_radius))
    held = {n: min(MOST_WEIGHT[n], max(0.0, w)) if OWN_CLADE.get(n, clade) == clade else 0.0 for n, w in weights.items()}
    return replace(blend, **changes, **held, use_component=clade == "component_aware")
