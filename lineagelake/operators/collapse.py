"""Merging of barcodes that sequencing errors split: greedy clustering in the order of
abundance, as parallel rounds over joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.functions.expressions import hamming, ngrams
from lineagelake.functions.storage import stored


def first_independent_set(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that a sequential pass in the order of ``prio`` would pick, when each pick rules
    out its neighbours.  ``nodes(node, prio)``, ``edges(src, dst)`` in both directions.

    A node whose earlier neighbours are all ruled out is picked; neighbours of picked nodes
    are ruled out (Blelloch, Fineman and Shun, 2012: few rounds on average).  Each round is one
    written table of the edges between nodes not yet decided.
    """
    prio = nodes.select(F.col("node").alias("dst"), F.col("prio").alias("p"))
    open_ = edges.join(prio, "dst").join(nodes.withColumnRenamed("node", "src"), "src").where("prio < p").select("src", "dst")
    out = None
    while True:
        waiting = open_.select(F.col("dst").alias("src"), F.lit(True).alias("waits")).distinct()
        # An edge from a node that waits for none rules its end out.
        marked = open_.join(waiting, "src", "left").select("src", "dst", F.col("waits").isNull().alias("rules_out"))
        now = stored(marked, "round", left=F.count_if(~F.col("rules_out")))
        new = now.where("rules_out").select(F.col("dst").alias("node")).distinct()
        out = new if out is None else out.union(new)
        if not now.seen["left"]:
            return nodes.select("node").join(out, "node", "left_anti")
        open_ = now.where("not rules_out").select("src", "dst")
        open_ = open_.join(new.withColumnRenamed("node", "dst"), "dst", "left_anti").join(new.withColumnRenamed("node", "src"), "src", "left_anti")


def blocks(barcodes: DataFrame, n: int) -> DataFrame:
    """``(barcode, prio, block)``: the first barcode takes all that share an n-gram with it as
    its block, then the first of the rest, and so on.

    A barcode that is first in all its n-grams leads a block; who shares one with a leader is
    taken.  So a round is grouped minima over (n-gram, barcode), never pairs of barcodes.
    Leaders share no n-gram, so each n-gram names one leader; of several, the first takes a
    barcode.  Barcodes shorter than ``n`` are blocks of their own.
    """
    rest = barcodes.select("barcode", "prio", F.explode(ngrams(F.col("barcode"), n)).alias("gram"))
    grams, leaders = None, None
    while True:
        first = rest.groupBy("gram").agg(F.min(F.struct("prio", "barcode")).alias("f"))
        led = rest.join(first, "gram").withColumn("leads", F.col("f.barcode") == F.col("barcode"))
        leads = led.groupBy("barcode").agg(F.bool_and("leads").alias("leads")).where("leads")
        own = led.where("leads").drop("leads").join(leads, "barcode").select("gram", F.col("barcode").alias("leader"), F.col("prio").alias("lead_prio"))
        met = rest.join(own, "gram", "left")
        gone = rest.join(own.select("gram"), "gram", "left_semi").select("barcode").distinct().withColumn("gone", F.lit(True))
        marked = met.join(gone, "barcode", "left").select("barcode", "prio", "gram", "leader", "lead_prio", F.col("gone").isNotNull().alias("gone"))
        marked = stored(marked, "round", left=F.count_if(~F.col("gone")))
        grams = marked.select("barcode", "prio", "gram") if grams is None else grams
        new = marked.where("barcode = leader").select("gram", "leader", "lead_prio")
        leaders = new if leaders is None else leaders.union(new)
        if not marked.seen["left"]:
            break
        rest = marked.where("not gone").select("barcode", "prio", "gram")
    taken = grams.join(leaders, "gram").groupBy("barcode").agg(F.min(F.struct("lead_prio", "leader")).alias("b")).select("barcode", F.col("b.leader").alias("block"))
    return barcodes.join(taken, "barcode", "left").select("barcode", "prio", F.coalesce("block", "barcode").alias("block"))


def _hamming_pairs(barcodes: DataFrame, t: int, within: str) -> DataFrame:
    """Pairs of equally long barcodes of which one of ``t`` + 1 disjoint sets of positions is
    equal.  Every ``t`` + 1-st position makes a set, so that a region that all barcodes share
    is no set, and no key, of its own."""
    every = lambda k: F.sequence(F.lit(k + 1), F.length("barcode"), F.lit(t + 1))
    part = lambda k: F.when(F.length("barcode") > k, F.array_join(F.transform(every(k), lambda i: F.substring("barcode", i, F.lit(1))), "")).otherwise("")
    sets = F.posexplode(F.array(*[part(k) for k in range(t + 1)])).alias("k", "piece")
    parts = barcodes.select(within, "barcode", sets)
    other = parts.select(within, F.col("barcode").alias("dst"), "k", "piece")
    return parts.withColumnRenamed("barcode", "src").join(other, [within, "k", "piece"]).where("src < dst").select("src", "dst").distinct()


def _edit_pairs(barcodes: DataFrame, t: int, within: str) -> DataFrame:
    """Pairs of barcodes of which one of ``t`` + 1 pieces of the one stands in the other
    untouched, at most ``t`` places away."""
    size = F.length("barcode")
    cut = lambda k, n: F.floor(n * k / (t + 1)).cast("int")
    pieces = barcodes.select(
        within, F.col("barcode").alias("src"), size.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(t))).alias("k")
    ).select(within, "src", "n", "k", F.substring("src", cut(F.col("k"), F.col("n")) + 1, cut(F.col("k") + 1, F.col("n")) - cut(F.col("k"), F.col("n"))).alias("piece"))
    probes = barcodes.select(
        within, F.col("barcode").alias("dst"), F.explode(F.sequence(size - t, size + t)).alias("n")
    ).where("n >= 0").select(within, "dst", "n", F.explode(F.sequence(F.lit(0), F.lit(t))).alias("k"))
    probes = probes.select(within, "dst", "n", "k", F.explode(F.sequence(F.lit(-t), F.lit(t))).alias("d"))
    at = cut(F.col("k"), F.col("n")) + F.col("d")
    probes = probes.where(at >= 0).select(within, "dst", "n", "k", F.substring("dst", at + 1, cut(F.col("k") + 1, F.col("n")) - cut(F.col("k"), F.col("n"))).alias("piece"))
    return pieces.join(probes.distinct(), [within, "n", "k", "piece"]).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def near_pairs(barcodes: DataFrame, t: int, equal_lengths: bool, within: str = "block") -> DataFrame:
    """Pairs ``(src, dst, dist)`` of one block within distance ``t``, in both directions:
    Hamming if all lengths are equal, else Levenshtein.  Pigeonhole: pairs meet in equi-joins
    on parts that ``t`` errors cannot all touch, and are verified."""
    met = _hamming_pairs(barcodes, t, within) if equal_lengths else _edit_pairs(barcodes, t, within)
    dist = hamming(F.col("src"), F.col("dst")) if equal_lengths else F.levenshtein("src", "dst", t)
    close = met.withColumn("dist", dist).where((F.col("dist") >= 0) & (F.col("dist") <= t))
    both = F.inline(F.array(F.struct("src", "dst", "dist"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")))
    return close.select(both)


def cluster(counts: DataFrame, threshold: int = 2, exact: bool = False) -> DataFrame:
    """``(barcode, cluster)``: each barcode and the root of its cluster.

    Barcodes are taken by falling largest count, then by letters.  Blocks come first (see
    ``blocks``; n-grams of max(3, longest // (threshold + 1))); in a block, a barcode within
    ``threshold`` of an earlier root joins the nearest such, the first of equals, or becomes
    a root itself.  Barcodes of different blocks never merge, and members do not chain: that
    is the method.  ``exact`` sets blocks aside and compares all.
    """
    barcodes = counts.where("barcode is not null").groupBy("barcode").agg((-F.max("counts")).alias("c"))
    n = F.length("barcode")
    barcodes = stored(barcodes.select("barcode", F.struct("c", "barcode").alias("prio")), "barcodes", low=F.min(n), high=F.max(n))
    low, high = barcodes.seen["low"], barcodes.seen["high"]
    if high is None:
        return barcodes.select("barcode", F.col("barcode").alias("cluster"))
    placed = barcodes.withColumn("block", F.lit("")) if exact else blocks(barcodes, max(3, high // (threshold + 1)))
    placed = stored(placed, "blocks")
    pairs = stored(near_pairs(placed, threshold, low == high), "near")
    nodes = placed.select(F.col("barcode").alias("node"), "prio")
    roots = first_independent_set(pairs.select("src", "dst"), nodes)
    prio = nodes.withColumnRenamed("node", "dst").withColumnRenamed("prio", "root_prio")
    joined = pairs.join(roots.withColumnRenamed("node", "dst"), "dst", "left_semi").join(prio, "dst").join(nodes.withColumnRenamed("node", "src"), "src")
    member = joined.where("root_prio < prio").groupBy("src").agg(F.min(F.struct("dist", "root_prio", "dst")).alias("r")).select(F.col("src").alias("barcode"), F.col("r.dst").alias("root"))
    member = member.join(roots.withColumnRenamed("node", "barcode"), "barcode", "left_anti")
    return placed.select("barcode").join(member, "barcode", "left").select("barcode", F.coalesce("root", "barcode").alias("cluster"))


def rewritten(counts: DataFrame, clusters: DataFrame, ratio: float | None = 1) -> DataFrame:
    """``counts`` whose barcodes give way to their cluster's most counted one, where that has
    ``ratio`` times their count or more (ratios under 1 count as 1)."""
    ratio = max(1, ratio or 1)
    placed = counts.join(clusters, "barcode")
    top = placed.groupBy("cluster").agg(F.min(F.struct((-F.col("counts")).alias("c"), "barcode")).alias("__top"))
    dominant: Column = -F.col("__top.c") >= F.col("counts") * ratio
    out = placed.join(top, "cluster").withColumn("barcode", F.when(dominant, F.col("__top.barcode")).otherwise(F.col("barcode")))
    return out.select(*counts.columns)


def collapse(counts: DataFrame, threshold: int = 2, ratio: float | None = 1, keys: tuple[str, ...] = ("sample",), exact: bool = False) -> DataFrame:
    """Counts by ``keys`` and barcode after ``cluster`` and ``rewritten``; 0 merges nothing."""
    if not threshold:
        return counts
    counts = stored(counts, "counts")  # read for the clusters and again for the rewriting
    merged = rewritten(counts, cluster(counts, threshold, exact), ratio)
    return merged.groupBy(*keys, "barcode").agg(F.sum("counts").alias("counts"))
