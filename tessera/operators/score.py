"""Scores of assemblies, bins and profiles, and taxonomy rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.cut import cut, cut_round
from tessera.errors import ContractError
from tessera.operators.ids import ranked


def n50(lengths: DataFrame) -> DataFrame:
    """One row (n50): the length at which the running total, longest first, passes half of all letters.

    Lengths are counted before they are ordered, so the window runs over
    distinct lengths.
    """
    n = lengths.groupBy("length").agg((F.count("*") * F.col("length")).alias("letters"))
    run = n.selectExpr("length", "sum(letters) over (order by length desc) as upto", "sum(letters) over () as whole")
    return run.where("2 * upto >= whole").agg(F.max("length").alias("n50"))


def contig_f1(rows: DataFrame) -> DataFrame:
    """One row (precision, recall, f1) for rows (cluster, truth); a negative truth is unlabelled.

    A cluster takes its most frequent truth (the smallest of equals); clusters
    whose truth is negative drop out; each truth keeps its best cluster, by hits
    and then by name. Precision is over all rows, recall over labelled ones.
    """
    n = rows.groupBy("cluster", "truth").agg(F.count("*").alias("hits"))
    own = n.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("hits"), "truth"))).where("r = 1 and truth >= 0")
    best = own.withColumn("r", F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("hits"), "cluster"))).where("r = 1")
    tp = best.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("tp"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("truth") >= 0).cast("long")), F.lit(0)).alias("labelled"))
    p = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("labelled") > 0, F.col("tp") / F.col("labelled")).otherwise(0.0)
    out = tp.crossJoin(size).select(p.alias("precision"), r.alias("recall"))  # one row each
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def comparison(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(taxon, p, t) over the taxa of both profiles (taxon, value); absent is zero."""
    j = predicted.select("taxon", F.col("value").alias("p")).join(truth.select("taxon", F.col("value").alias("t")), "taxon", "full")
    return j.select("taxon", F.coalesce("p", F.lit(0.0)).cast("double").alias("p"), F.coalesce("t", F.lit(0.0)).cast("double").alias("t"))


def profile_scores(predicted: DataFrame, truth: DataFrame, minimum: float = 0.0) -> DataFrame:
    """One row (l1, bray_curtis, pearson, presence_f1); truth is rescaled to one for l1, taxon 0 is no presence."""
    c = comparison(predicted, truth)
    sums = c.agg(F.sum("t").alias("_t"))
    hit = lambda cond: F.sum(F.when(cond & (F.col("taxon") != 0), 1).otherwise(0))
    yes_p, yes_t = F.col("p") > minimum, F.col("t") > minimum
    both, total = F.sum(F.least("p", "t")), F.sum(F.col("p") + F.col("t"))
    spread = (F.count("*") > 1) & (F.var_pop("p") > 0) & (F.var_pop("t") > 0)
    found = 2 * hit(yes_p & yes_t) / (hit(yes_p) + hit(yes_t))
    return c.crossJoin(F.broadcast(sums)).agg(
        F.sum(F.abs(F.col("p") - F.when(F.col("_t") > 0, F.col("t") / F.col("_t")).otherwise(0.0))).alias("l1"),
        F.when(total > 0, 1 - 2 * both / total).otherwise(0.0).alias("bray_curtis"),
        F.when(spread, F.try_divide(F.covar_pop("p", "t"), F.sqrt(F.var_pop("p") * F.var_pop("t")))).alias("pearson"),
        F.when(hit(yes_p) + hit(yes_t) > 0, found).otherwise(0.0).alias("presence_f1"),
    )


RANKS = ("species", "genus", "family")


def rank_rollup(taxonomy: DataFrame, target: str) -> DataFrame:
    """(taxon_id, ancestor): the nearest node of rank ``target`` at or above each taxon, null where there is none.

    taxonomy (taxon_id, parent_id, rank). Climbs by doubling, so a lineage of n
    steps takes log2(n) joins; lineages that run in a circle end with a null.
    """
    if target not in RANKS:
        raise ContractError([f"rank must be one of {', '.join(RANKS)}"])
    found = F.when(F.col("rank") == target, F.col("taxon_id"))
    top = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("taxon_id"))
    state = cut(taxonomy.select("taxon_id", found.alias("ancestor"), F.when(~top, F.col("parent_id")).alias("up")), "lineage")
    span, taxa = 1, state.count()
    while span < 2 * taxa and not state.where("ancestor is null and up is not null").isEmpty():  # a longer climb runs in a circle
        above = state.select(F.col("taxon_id").alias("up"), F.col("ancestor").alias("_a"), F.col("up").alias("_u"))
        climbed = state.where("ancestor is null and up is not null").join(above, "up", "left").select("taxon_id", F.col("_a").alias("ancestor"), F.col("_u").alias("up"))
        state = cut_round(state.where("ancestor is not null or up is null").unionByName(climbed), "lineage")
        span *= 2
    return state.select("taxon_id", "ancestor")


def abundance_rollup(counts: DataFrame, lineage: DataFrame) -> DataFrame:
    """(taxon, share): counts (taxon_id, n) summed at their ancestors; what has none counts as taxon 0."""
    up = counts.join(lineage, "taxon_id", "left").groupBy(F.coalesce("ancestor", F.lit(0)).alias("taxon")).agg(F.sum("n").alias("n"))
    return up.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).where("_all > 0").select("taxon", (F.col("n") / F.col("_all")).alias("share"))


def largest_remainder(weights: DataFrame, total: int, least: int = 0) -> DataFrame:
    """(id, n): ``total`` dealt in proportion to weights; what is left goes to the largest fractions, then smallest ids.

    With ``least`` 1 every id gets one at least: what that takes is given up,
    one at a time, by the ids that have most, the smallest of equals first.
    """
    w = weights.crossJoin(F.broadcast(weights.agg(F.sum("weight").alias("_all")))).select("id", (F.col("weight") * total / F.col("_all")).alias("q"))
    w = w.select("id", F.floor("q").alias("base"), (F.col("q") - F.floor("q")).alias("frac"))
    order = ranked(w.withColumn("down", -F.col("frac")), ["down", "id"], "r")
    left = w.agg((F.lit(total) - F.sum("base")).alias("_left"))
    dealt = order.crossJoin(F.broadcast(left)).select("id", (F.col("base") + (F.col("r") <= F.col("_left")).cast("long")).alias("n"))
    return dealt if not least else _at_least_one(cut(dealt, "dealt"), total)


def _at_least_one(dealt: DataFrame, total: int) -> DataFrame:
    """Lifts zeros to one; donors are levelled from the top, which is what giving one at a time comes to.

    Donors end at a common level h or below it: h is the largest level at which those above it hold
    the wanted number in all, and of those at h + 1 after that the largest ids keep one more.
    """
    facts = dealt.agg(F.count("*").alias("ids"), F.sum((F.col("n") == 0).cast("long")).alias("zero"), F.max("n").alias("top")).first()
    if facts["ids"] > total:
        raise ContractError([f"{total} cannot give {facts['ids']} ids one each"])
    if not facts["zero"]:
        return dealt
    low, high = 1, facts["top"]
    while low < high:  # the largest level that frees enough
        mid = (low + high + 1) // 2
        freed = dealt.agg(F.sum(F.greatest(F.col("n") - mid, F.lit(0)))).first()[0]
        low, high = (mid, high) if freed >= facts["zero"] else (low, mid - 1)
    above = dealt.where(F.col("n") > low)
    spare = above.agg(F.sum(F.col("n") - low)).first()[0] - facts["zero"]
    # the largest ids keep one above the level, as the smallest gave first
    keeps = ranked(above.select("id"), ["id"], "r").where(F.col("r") > above.count() - spare).select("id", F.lit(1).alias("extra"))
    out = dealt.join(keeps, "id", "left")
    return out.select("id", F.when(F.col("n") == 0, 1).when(F.col("n") > low, low + F.coalesce("extra", F.lit(0))).otherwise(F.col("n")).cast("long").alias("n"))


def halves(pairs: DataFrame) -> DataFrame:
    """The rows of every other pair, by first position (pairs: pair_id, pos, ...)."""
    first = pairs.groupBy("pair_id").agg(F.min("pos").alias("_first"))
    places = ranked(first.select("_first").distinct(), ["_first"], "_r").where("_r % 2 = 1")
    return pairs.join(first.join(places, "_first").select("pair_id"), "pair_id", "left_semi")


def top_threshold(scores: DataFrame) -> DataFrame:
    """(label, threshold): the k-th largest score of a label, k being its number of positives (scores: label, p, y)."""
    k = F.sum("y").over(Window.partitionBy("label"))
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("p")))
    return scores.withColumn("_k", k).withColumn("_r", r).where("_r = _k").select("label", F.col("p").alias("threshold"))
