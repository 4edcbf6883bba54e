"""What a property says about overlapping groups.

Input: members(group_id, compound_id, property), one row for each membership of a compound that has a property, and compounds
(compound_id, property). Everything here is keyed by group; groups may share any number of compounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.functions.ranks import value_ranks
from groveline.functions.stats import benjamini_hochberg, fisher_greater, normal_two_sided, odds_ratio, u_z
from groveline.operators.distances import packed_tanimoto
from groveline.storage import written

#: Interpretability classes, most telling first, with their tier.
CLASSES = {"direct_structure_motif": 1, "fragment_motif": 1, "human_defined": 1, "descriptor_cluster": 3, "similarity_cluster": 2, "meta_group": 3, "unknown": 4}


def sized(members: DataFrame, total: int, least: int = 5, most_fraction: float = 0.95) -> DataFrame:
    """The memberships of groups that are neither too small nor nearly everything."""
    fits = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(least, most_fraction * total)).select("group_id")
    return members.join(fits, "group_id", "left_semi")


def profile(members: DataFrame) -> DataFrame:
    """Size and distribution of the property in each group; variance is the sample's, the deviation from the median unscaled."""
    y = "property"
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("group_size"), F.count(y).alias("property_count"), F.avg(y).alias("property_mean"), F.stddev_samp(y).alias("property_std"), F.var_samp(y).alias("property_variance"),
        F.min(y).alias("property_min"), F.max(y).alias("property_max"), q.alias("_q"),
    )
    one = one.select("*", *[F.get("_q", i).alias(n) for i, n in enumerate(("property_q25", "property_median", "property_q75"))]).drop("_q").withColumn("property_iqr", F.col("property_q75") - F.col("property_q25"))
    off = members.join(one.select("group_id", "property_median"), "group_id").groupBy("group_id").agg(F.median(F.abs(F.col(y) - F.col("property_median"))).alias("property_mad"))
    return one.join(off, "group_id")


def thresholds(compounds: DataFrame, high: float = 0.8, low: float = 0.2, higher_is_better: bool = True) -> DataFrame:
    """One row: high_cut, low_cut, global mean and median and count. If less is better the quantiles swap sides."""
    h, lo = (high, low) if higher_is_better else (round(1 - high, 12), round(1 - low, 12))
    y = "property"
    return compounds.agg(F.percentile(y, F.lit(h)).alias("high_cut"), F.percentile(y, F.lit(lo)).alias("low_cut"), F.avg(y).alias("global_mean"), F.median(y).alias("global_median"), F.count(y).alias("global_count"))


def flags(df: DataFrame, cuts: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """df with is_high_active and is_low_active."""
    y = F.col("property")
    high, low = (y >= F.col("high_cut"), y <= F.col("low_cut")) if higher_is_better else (y <= F.col("high_cut"), y >= F.col("low_cut"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("is_high_active", high).withColumn("is_low_active", low).drop(*cuts.columns)


def member_details(members: DataFrame, cuts: DataFrame, higher_is_better: bool = True) -> DataFrame:
    return flags(members.select("group_id", "compound_id", "property"), cuts, higher_is_better)


def enrichment(members: DataFrame, compounds: DataFrame, cuts: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Counts, fractions and differences of high and low compounds, odds ratios and shifts of each group."""
    n = F.count(F.lit(1))
    count = lambda c: F.sum(F.col(c).cast("long"))
    every = flags(compounds.select("property"), cuts, higher_is_better).agg(count("is_high_active").alias("all_high"), count("is_low_active").alias("all_low"), n.alias("all_count"))
    own = flags(members, cuts, higher_is_better).groupBy("group_id").agg(n.alias("group_size"), count("is_high_active").alias("high_active_count"), count("is_low_active").alias("low_active_count"), F.avg("property").alias("_mean"), F.median("property").alias("_median"))
    df = own.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(cuts.select("global_mean", "global_median")))
    for kind in ("high", "low"):
        a, all_ = F.col(f"{kind}_active_count"), F.col(f"all_{kind}")
        b, c = F.col("group_size") - a, all_ - a
        d = F.col("all_count") - F.col("group_size") - c
        df = df.withColumn(f"{kind}_active_fraction", a / F.col("group_size")).withColumn(f"global_{kind}_active_fraction", all_ / F.col("all_count"))
        df = df.withColumn(f"{kind}_active_fraction_delta", F.col(f"{kind}_active_fraction") - F.col(f"global_{kind}_active_fraction")).withColumn(f"{kind}_active_odds_ratio", odds_ratio(a, b, c, d))
        df = df.withColumn(f"_{kind}", F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")))
    return df.withColumn("mean_shift_vs_global", F.col("_mean") - F.col("global_mean")).withColumn("median_shift_vs_global", F.col("_median") - F.col("global_median")).drop("_mean", "_median", "global_mean", "global_median")


def fisher(enriched: DataFrame) -> DataFrame:
    """One-sided exact p-values and q-values for high and low enrichment."""
    for kind in ("high", "low"):
        enriched = enriched.withColumn(f"{kind}_active_pvalue", fisher_greater(*[F.col(f"_{kind}.{c}") for c in "abcd"]))
        enriched = benjamini_hochberg(enriched, f"{kind}_active_pvalue", "group_id", f"{kind}_active_fdr_qvalue")
    return enriched


def rank_sums(members: DataFrame, compounds: DataFrame) -> DataFrame:
    """group_id, n1, n2, u_statistic, rank_biserial_effect, tie_sum against the group's complement."""
    ranks = value_ranks(compounds, [], "property")
    ties = compounds.where("property IS NOT NULL").groupBy("property").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie_sum"), F.sum("t").cast("long").alias("_all"))
    own = members.join(ranks.select("property", "average_rank"), "property").groupBy("group_id").agg(F.count(F.lit(1)).alias("n1"), F.sum("average_rank").alias("_r"))
    df = own.crossJoin(F.broadcast(ties)).withColumn("n2", F.col("_all") - F.col("n1"))
    u = F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2
    effect = F.when((F.col("n1") > 0) & (F.col("n2") > 0), 2 * u / (F.col("n1") * F.col("n2")) - 1)
    return df.withColumn("u_statistic", u).withColumn("rank_biserial_effect", effect).drop("_r", "_all")


def mann_whitney(sums: DataFrame) -> DataFrame:
    """Adds the two-sided p-value of the tie-corrected normal approximation, and q-values."""
    z = F.when(F.col("n2") > 0, u_z(F.col("u_statistic"), F.col("n1"), F.col("n2"), F.col("tie_sum")))
    df = sums.withColumn("_z", z).withColumn("mannwhitney_pvalue", F.when(F.col("_z").isNotNull(), normal_two_sided(F.coalesce("_z", F.lit(0.0))))).drop("_z")
    return benjamini_hochberg(df, "mannwhitney_pvalue", "group_id", "mannwhitney_fdr_qvalue")


def _median_difference(values: np.ndarray, weight: np.ndarray) -> float | None:
    """Median of |a - b| over the pairs of a multiset, without the pairs: bisection on how many differences are at most d."""
    n = int(weight.sum())
    pairs = n * (n - 1) // 2
    if not pairs:
        return None
    before = np.concatenate([[0], np.cumsum(weight)])
    zero = int((weight * (weight - 1) // 2).sum())

    def at_most(d: float) -> int:
        reach = np.searchsorted(values, values + d, "right")
        return zero + int((weight * (before[reach] - before[1:])).sum()) if d >= 0 else 0

    def place(k: int) -> float:
        if k < zero:
            return 0.0
        low, high = 0.0, float(values[-1] - values[0])
        while True:  # halve until nothing representable lies between
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (low, mid) if at_most(mid) > k else (mid, high)
        # the bracket has one difference in it; take it as it stands
        reach = np.searchsorted(values, values + high, "right") - 1
        return float(max(values[reach] - values))

    return (place((pairs - 1) // 2) + place(pairs // 2)) / 2


def pairwise_delta(members: DataFrame) -> DataFrame:
    """group_id, median_pairwise_abs_delta. Equal values of a group are counted first, so a task holds a group's distinct values."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("property")
        return pd.DataFrame({"group_id": p["group_id"].iloc[:1], "median_pairwise_abs_delta": [_median_difference(p["property"].to_numpy(), p["w"].to_numpy())]})

    counted = members.where("property IS NOT NULL").groupBy("group_id", "property").agg(F.count(F.lit(1)).alias("w"))
    return counted.groupBy("group_id").applyInPandas(each, f"group_id {members.schema['group_id'].dataType.simpleString()}, median_pairwise_abs_delta double")


def _similarity_counts(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits that both and either have, and how many pairs of a row of words in a and one in b have so many. same: each pair of a once."""
    width = 64 * a.shape[1] + 1
    of_a, of_b = (np.bitwise_count(w).sum(1, dtype=np.int64) for w in (a, b))
    total = np.zeros(width * width, np.int64)
    step = max(1, (1 << 18) // max(1, b.size))
    for i in range(0, len(a), step):
        j = i if same else 0
        both = np.bitwise_count(a[i : i + step, None] & b[None, j:])
        both = (both[:, :, 0] if both.shape[2] == 1 else both.sum(2)).astype(np.int64)
        key = both * (width - 1) + of_a[i : i + step, None] + of_b[None, j:]
        key = key[np.arange(key.shape[1])[None, :] > np.arange(len(key))[:, None]] if same else key.ravel()
        if len(key) * 8 > len(total):
            total += np.bincount(key, minlength=len(total))
        else:
            np.add.at(total, key, 1)
    seen = np.flatnonzero(total)
    return seen // width, seen % width, total[seen]


def _counted_similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every pair of a group's blocks, how many pairs of members have so many bits in both and in either."""

    def matrix(words: pa.Array) -> np.ndarray:
        return np.asarray(words.flatten()).astype(np.int64).view(np.uint64).reshape(len(words), -1)

    for t in batches:
        for i in range(t.num_rows):
            a, b = t.column("words")[i].values, t.column("other_words")[i].values
            if len(a) and len(b):
                both, either, n = _similarity_counts(matrix(a), matrix(b), t.column("block")[i] == t.column("other")[i])
                yield pa.record_batch({"group_id": t.column("group_id").take(pa.array([i] * len(n), pa.int64())), "both": pa.array(both), "either": pa.array(either), "n": pa.array(n)})


def _exact_diversity(have: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Statistics of all pairs of each group of ``sizes``, by counts: pairs with as many bits in both and in either are alike.

    A group's members are dealt into blocks of some ``block`` of them and pairs of blocks are counted in a kernel; what leaves it for a pair of
    blocks is bounded by the square of the bits, however many pairs it counts. Pairs of blocks are never broadcast, as Spark's estimate of
    their size doesn't see that a group becomes many rows.
    """
    kind = have.schema["group_id"].dataType.simpleString()
    dealt = have.join(sizes.select("group_id", F.ceil(F.col("n") / block).alias("_blocks")), "group_id").withColumn("block", F.pmod(F.xxhash64("compound_id"), F.col("_blocks")))
    packed = written(dealt.groupBy("group_id", "_blocks", "block").agg(F.collect_list("words").alias("words")))
    one = packed.select("group_id", "block", "words", F.explode(F.sequence(F.col("block"), F.col("_blocks") - 1)).alias("other"))
    two = packed.select("group_id", F.col("block").alias("other"), F.col("words").alias("other_words"))
    counted = one.hint("merge").join(two, ["group_id", "other"]).mapInArrow(_counted_similarities, f"group_id {kind}, both long, either long, n long")
    alike = counted.groupBy("group_id", "both", "either").agg(F.sum("n").alias("n")).withColumn("s", F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")))
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    out = alike.groupBy("group_id").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean_tanimoto"), q.alias("_q"), F.min("s").alias("min_tanimoto"), F.max("s").alias("max_tanimoto"))
    return sizes.select("group_id", "mode", F.col("pairs").alias("pair_count")).hint("merge").join(out, "group_id", "left")


def diversity(members: DataFrame, bits: DataFrame, exact: int | None = None, sampled: int = 200_000, seed: int = 42, block: int = 8192) -> DataFrame:
    """Tanimoto similarity within each group: all pairs; of groups with more than ``exact`` pairs, if that is given, ``sampled`` pairs by a
    seeded permutation.

    bits: compound_id, words. Only members with bits count; a group with fewer than two has no row here (see with_availability).
    Where pairs are sampled, members are numbered and the pairs made from their numbers; these are never broadcast.
    """
    have = written(members.select("group_id", "compound_id").join(bits.select("compound_id", "words"), "compound_id"))
    sizes = have.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("pairs", F.expr("n * (n - 1) div 2"))
    sizes = sizes.withColumn("mode", F.lit("exact") if exact is None else F.when(F.col("pairs") <= exact, "exact").otherwise("sampled"))
    names = ("p25_tanimoto", "median_tanimoto", "p75_tanimoto")
    columns = ["group_id", "mode", "pair_count", "mean_tanimoto", "min_tanimoto", "max_tanimoto", *[F.get("_q", k).alias(n) for k, n in enumerate(names)], (1 - F.col("mean_tanimoto")).alias("structural_diversity_score")]
    out = _exact_diversity(have, sizes.where("mode = 'exact'"), block)
    if exact is not None:
        out = out.unionByName(_sampled_diversity(have, sizes.where("mode = 'sampled'"), sampled, seed))
    return out.select(*columns)


def _sampled_diversity(have: DataFrame, sizes: DataFrame, sampled: int, seed: int) -> DataFrame:
    """Statistics of ``sampled`` pairs of each group of ``sizes``."""
    have = have.join(sizes.select("group_id"), "group_id", "left_semi")
    numbered = have.withColumn("i", F.row_number().over(Window.partitionBy("group_id").orderBy("compound_id")) - 1)
    order = sizes.select("group_id", "n", "pairs", "mode", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("pairs"), F.lit(sampled)) - 1)).alias("t"))
    # the place of a sampled pair: an affine permutation of all places, by a prime that does not divide their number
    step = F.coalesce(*[F.when(F.col("pairs") % p != 0, F.lit(p)) for p in (1_000_003, 999_983, 611_953)], F.lit(1))
    place = F.pmod(F.col("t") * step + F.lit(seed), F.col("pairs"))
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    placed = order.withColumn("p", place).withColumn("j", j)
    placed = placed.withColumn("j", F.when(F.expr("j * (j - 1) div 2 > p"), F.col("j") - 1).when(F.expr("j * (j + 1) div 2 <= p"), F.col("j") + 1).otherwise(F.col("j"))).withColumn("i", F.expr("p - j * (j - 1) div 2"))
    a = numbered.select("group_id", F.col("i"), F.col("words").alias("wa"))
    b = numbered.select("group_id", F.col("i").alias("j"), F.col("words").alias("wb"))
    sim = placed.select("group_id", "mode", "i", "j").hint("merge").join(a, ["group_id", "i"]).hint("merge").join(b, ["group_id", "j"]).select("group_id", "mode", packed_tanimoto(F.col("wa"), F.col("wb")).alias("s"))
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return sim.groupBy("group_id", "mode").agg(F.count(F.lit(1)).alias("pair_count"), F.avg("s").alias("mean_tanimoto"), q.alias("_q"), F.min("s").alias("min_tanimoto"), F.max("s").alias("max_tanimoto"))


def with_availability(groups: DataFrame, div: DataFrame | None) -> DataFrame:
    """groups with the diversity columns, null and flagged where there are none."""
    names = ["pair_count", "mean_tanimoto", "median_tanimoto", "structural_diversity_score"]
    if div is None:
        return groups.select("*", *[F.lit(None).cast("double").alias(n) for n in names], F.lit(False).alias("structural_diversity_available"))
    return groups.join(div.select("group_id", *names), "group_id", "left").withColumn("structural_diversity_available", F.col("mean_tanimoto").isNotNull())


def interpretability(registry: DataFrame) -> DataFrame:
    """Adds motif flags, class, tier and reason from a group's source, type and the keys of its definition (map of strings)."""
    text = F.lower(F.concat_ws(" ", "group_source", "group_type"))
    has = lambda k: F.coalesce(F.map_contains_key("definition", F.lit(k)), F.lit(False))
    df = registry.withColumn("has_mcs_smarts", has("mcs_smarts")).withColumn("has_fragment_smiles", has("fragment_smiles"))
    df = df.withColumn("has_structure_motif", F.col("has_mcs_smarts") | F.col("has_fragment_smiles") | has("scaffold_smiles"))
    kind = (
        F.when(text.rlike("meta"), "meta_group").when(F.col("has_mcs_smarts") | has("scaffold_smiles") | text.rlike("mcs|murcko|scaffold"), "direct_structure_motif").when(F.col("has_fragment_smiles") | text.rlike("fragment|brics|recap"), "fragment_motif")
        .when(text.rlike("human|user"), "human_defined").when(text.rlike("descriptor"), "descriptor_cluster").when(text.rlike("similarity|cluster"), "similarity_cluster").otherwise("unknown")
    )
    tiers = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    df = df.withColumn("source_interpretability_class", kind).withColumn("interpretability_tier", F.element_at(tiers, F.col("source_interpretability_class")))
    return df.withColumn("interpretability_reason", F.concat(F.col("source_interpretability_class"), F.when(F.col("has_structure_motif"), " with a structure motif").otherwise("")))


def overlaps(members: DataFrame) -> DataFrame:
    """g1, g2, shared, n1, n2, jaccard for groups g1 < g2 that share a compound."""
    own = members.select("group_id", "compound_id").distinct()
    n = own.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    pair = own.select(F.col("group_id").alias("g1"), "compound_id").join(own.select(F.col("group_id").alias("g2"), "compound_id"), "compound_id").where("g1 < g2")
    df = pair.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("shared"))
    df = df.join(n.select(F.col("group_id").alias("g1"), F.col("n").alias("n1")), "g1").join(n.select(F.col("group_id").alias("g2"), F.col("n").alias("n2")), "g2")
    return df.withColumn("jaccard", F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")))


def redundancy(groups: DataFrame, pairs: DataFrame, rank: str, threshold: float = 0.8) -> DataFrame:
    """group_id, greatest overlap with any group and with a better ranked one, count above the threshold, the group it repeats, flag."""
    both = pairs.select(F.col("g1").alias("group_id"), F.col("g2").alias("other"), "jaccard").unionByName(pairs.select(F.col("g2").alias("group_id"), F.col("g1").alias("other"), "jaccard"))
    r = groups.select("group_id", F.col(rank).alias("_rank"))
    both = both.join(r, "group_id").join(r.select(F.col("group_id").alias("other"), F.col("_rank").alias("_other_rank")), "other")
    better = (F.col("_other_rank") < F.col("_rank")) | ((F.col("_other_rank") == F.col("_rank")) & (F.col("other") < F.col("group_id")))
    one = both.groupBy("group_id").agg(
        F.max("jaccard").alias("max_jaccard_with_any_group"), F.max(F.when(better, F.col("jaccard"))).alias("max_jaccard_with_higher_ranked_group"),
        F.count_if(F.col("jaccard") >= threshold).alias("overlap_count_above_threshold"), F.min(F.when(better, F.struct((-F.col("jaccard")).alias("j"), F.col("other").alias("o")))).alias("_best"),
    )
    df = groups.select("group_id").join(one, "group_id", "left").withColumn("redundancy_flag", F.coalesce(F.col("max_jaccard_with_higher_ranked_group") >= threshold, F.lit(False)))
    return df.withColumn("redundant_with_group_id", F.when(F.col("redundancy_flag"), F.col("_best.o"))).withColumn("overlap_count_above_threshold", F.coalesce("overlap_count_above_threshold", F.lit(0))).drop("_best")


def _component(df: DataFrame, column: str, ascending: bool) -> Column:
    """Rank; values count to 9 decimals, so that what differs by rounding errors only is a tie."""
    value = F.round(F.col(column).cast("double"), 9)
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return F.rank().over(Window.partitionBy(F.lit(1)).orderBy(order)).cast("double")


def five_ranks(groups: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Component ranks and the five ranks: means of component ranks, ranked again. One row for each group, in one window.

    groups: high_active_fraction_delta, median_shift_vs_global, high_active_fdr_qvalue, group_size, property_variance, property_iqr,
    median_pairwise_abs_delta, structural_diversity_score, interpretability_tier.
    """
    sign = F.lit(1.0 if higher_is_better else -1.0)
    df = groups.withColumn("_shift", F.col("median_shift_vs_global") * sign)
    parts = {
        "rank_shift": ("_shift", False), "rank_high_fraction": ("high_active_fraction_delta", False), "rank_qvalue": ("high_active_fdr_qvalue", True), "rank_size": ("group_size", False),
        "rank_variance": ("property_variance", True), "rank_iqr": ("property_iqr", True), "rank_pairwise_delta": ("median_pairwise_abs_delta", True),
        "rank_diversity": ("structural_diversity_score", False), "rank_tier": ("interpretability_tier", True),
    }
    df = df.select("*", *[_component(df, c, up).alias(n) for n, (c, up) in parts.items()]).drop("_shift")

    def mean(*names: str) -> Column:
        return sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)

    def placed(df: DataFrame, name: str, score: Column, where: Column | None = None) -> DataFrame:
        df = df.withColumn(f"{name}_score", score if where is None else F.when(where, score))
        return df.withColumn(f"{name}_rank", F.when(F.col(f"{name}_score").isNotNull(), _component(df, f"{name}_score", True).cast("int")))

    df = placed(df, "activity_enriched_group", mean("rank_shift", "rank_high_fraction", "rank_qvalue", "rank_size"))
    df = placed(df, "consistent_group", mean("rank_variance", "rank_iqr", "rank_pairwise_delta"))
    df = placed(df, "structurally_diverse_active_group", mean("rank_high_fraction", "rank_variance", "rank_diversity"), F.col("structural_diversity_score").isNotNull())
    df = placed(df, "interpretable_group", mean("rank_tier", "activity_enriched_group_rank", "consistent_group_rank"))
    diverse = F.coalesce(F.col("structurally_diverse_active_group_rank").cast("double"), mean("activity_enriched_group_rank", "consistent_group_rank"))
    base = (F.col("activity_enriched_group_rank") + F.col("consistent_group_rank") + diverse + F.col("rank_tier")) / 4
    return placed(df, "base_priority", base)


def priority(groups: DataFrame, redundant: DataFrame, penalty: float = 5.0) -> DataFrame:
    """insight_priority_score and rank: the base score, more by ``penalty`` where a better ranked group says the same."""
    df = groups.join(redundant, "group_id").withColumn("insight_priority_score", F.col("base_priority_score") + F.when(F.col("redundancy_flag"), F.lit(penalty)).otherwise(0.0))
    return df.withColumn("insight_priority_rank", _component(df, "insight_priority_score", True).cast("int"))


#: Metrics of the long ranking, and whether less is better.
LONG = {"property_median": False, "high_active_fraction_delta": False, "property_variance": True, "property_iqr": True, "median_pairwise_abs_delta": True, "structural_diversity_score": False, "insight_priority_score": True}


def metric_ranking(groups: DataFrame) -> DataFrame:
    """metric_name, direction, group_id, metric_value, rank."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.lit("lower_is_better" if low else "higher_is_better").alias("direction"), F.col(m).cast("double").alias("metric_value")) for m, low in LONG.items()])
    long = groups.select("group_id", F.inline(rows)).where("metric_value IS NOT NULL")
    value = F.round("metric_value", 9)
    signed = F.when(F.col("direction") == "lower_is_better", value).otherwise(-value)
    return long.withColumn("rank", F.rank().over(Window.partitionBy("metric_name").orderBy(signed)))


def source_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_source", "group_type").agg(F.count(F.lit(1)).alias("group_count"), F.avg("group_size").alias("mean_group_size"), F.count_if(F.col("redundancy_flag")).alias("redundant_count"), F.min("insight_priority_rank").alias("best_rank"))


def analysed(members: DataFrame, compounds: DataFrame, registry: DataFrame, bits: DataFrame | None, config: dict) -> DataFrame:
    """All metrics and ranks of every group, one row each."""
    bins, higher = config["activity_bins"], config["property"]["higher_is_better"]
    members = sized(members, compounds.count(), config["filters"]["min_group_size"], config["filters"]["max_group_fraction"])
    cuts = thresholds(compounds, bins["high_quantile"], bins["low_quantile"], higher)
    df = profile(members).join(fisher(enrichment(members, compounds, cuts, higher)).drop("group_size"), "group_id").join(mann_whitney(rank_sums(members, compounds)).drop("n1", "n2", "tie_sum"), "group_id").join(pairwise_delta(members), "group_id")
    sd = config["structural_diversity"]
    df = with_availability(df, diversity(members, bits, sd["max_exact_pair_count"], sd["sample_pair_count"], sd["random_seed"]) if bits is not None and sd["enabled"] else None)
    known = interpretability(registry).drop("compound_count", "group_size")
    df = df.join(known, "group_id", "left").withColumn("interpretability_tier", F.coalesce("interpretability_tier", F.lit(CLASSES["unknown"])))
    ranked = five_ranks(df, higher)
    rank = config["ranking"]
    return priority(ranked, redundancy(ranked, overlaps(members), "base_priority_rank", config["overlap"]["jaccard_threshold"]), rank["redundancy_penalty"] if rank["redundancy_penalty_enabled"] else 0.0)
