"""Sample- or cell-by-barcode matrices, kept long; wide only at a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.functions.storage import numbered, running, stored

META = ("sample", "cell", "replicate", "condition")


def keys_of(counts: DataFrame) -> list[str]:
    return [c for c in META if c in counts.columns]


def wide(counts: DataFrame, barcodes: list[str] | None = None) -> DataFrame:
    """One column per barcode (sums, 0 where there is none); without a list, for each barcode
    there is.  A frame of very many columns is slow in Spark: ``tables.write_wide`` writes such
    a matrix without one."""
    keys = keys_of(counts)
    if barcodes is None:
        barcodes = [r.barcode for r in counts.select("barcode").distinct().orderBy("barcode").collect()]
    return counts.groupBy(*keys).pivot("barcode", barcodes).agg(F.sum("counts")).na.fill(0).orderBy(*keys)


def complete(counts: DataFrame, barcodes: list[str] | None = None) -> DataFrame:
    """Long counts with 0 for each of ``barcodes`` that a key lacks; without a list, for each
    distinct barcode of ``counts``."""
    keys = keys_of(counts)
    grid = counts.select(*keys).distinct()
    if barcodes is None:
        grid = grid.crossJoin(counts.select("barcode").distinct())
    else:
        grid = grid.withColumn("barcode", F.explode(F.array(*map(F.lit, barcodes))))
    return grid.join(counts.groupBy(*keys, "barcode").agg(F.sum("counts").alias("counts")), [*keys, "barcode"], "left").na.fill(0, ["counts"])


#: Barcodes of a block of columns, and about how many bytes of text a part of a matrix has.
BLOCK, PART = 10_000, 128 << 20


def segments(counts: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``(part, line, block, value)``: the wide matrix as pieces of CSV text, which joined in
    order are parts of it, each with the header (line -1) and its own lines.

    A piece has the columns of one block: the counts that its key has there and runs of zeros.
    So neither a line nor the header is ever one value, nor the matrix columns, nor its zeros
    rows; what is gathered is at most ``block`` counts.
    """
    keys = keys_of(counts)
    sums = stored(counts.groupBy(*keys, "barcode").agg(F.sum("counts").alias("counts")), "sums")
    names = stored(numbered(sums.select("barcode").distinct(), ["barcode"], "at"), "names")
    lines = stored(numbered(sums.select(*keys).distinct(), keys, "line"), "lines")
    total, blocks = names.count(), max(1, -(-names.count() // block))
    each = max(1, part // (3 * total + 1))
    parts = max(1, -(-lines.count() // each))
    text = lambda *c: F.to_csv(F.struct(*c), {"escape": '"'})
    of = F.floor(F.col("at") / block).cast("int").alias("block")
    grid = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    end = F.when(F.col("block") == blocks - 1, "\n").otherwise("")

    named = names.groupBy(of).agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit(","), text("barcode")).alias("t")))).alias("x"))
    named = named.select("block", F.array_join(F.col("x.t"), "").alias("t"))
    spark = counts.sparkSession
    head = spark.range(parts).select(F.col("id").alias("part"), grid).join(named, "block", "left")
    first = F.when(F.col("block") == 0, F.lit(",".join(keys))).otherwise("")
    head = head.select("part", F.lit(-1).cast("long").alias("line"), "block", F.concat(first, F.coalesce("t", F.lit("")), end).alias("value"))

    zeros = lambda n: F.repeat(F.lit(",0"), n.cast("int"))
    same = [sums[k].eqNullSafe(lines[k]) for k in keys]
    held = sums.join(names, "barcode").join(lines, same).groupBy("line", of).agg(F.array_sort(F.collect_list(F.struct((F.col("at") % block).alias("at"), "counts"))).alias("held"))
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("held", i - 1)["at"])
    width = F.least(F.lit(block), F.lit(total) - F.col("block") * block)
    some = F.concat(F.array_join(F.transform("held", lambda x, i: F.concat(zeros(x["at"] - before(i) - 1), F.lit(","), x["counts"].cast("string"))), ""), zeros(width - 1 - F.element_at("held", -1)["at"]))
    rows = lines.select("line", *keys, grid).join(held, ["line", "block"], "left")
    first = F.when(F.col("block") == 0, text(*keys)).otherwise("")
    rows = rows.select(
        F.floor(F.col("line") / each).cast("long").alias("part"), "line", "block", F.concat(first, F.when(F.col("held").isNull(), zeros(width)).otherwise(some), end).alias("value")
    )
    return head.union(rows)


def long(matrix: DataFrame) -> DataFrame:
    """A wide matrix as rows ``barcode, counts``; zeros stay."""
    keys = keys_of(matrix)
    return matrix.unpivot(keys, [c for c in matrix.columns if c not in keys], "barcode", "counts")


#: Values of a block of a compressed matrix.
VALUES = 65_536


def compressed(counts: DataFrame, by_column: bool = False, block: int = VALUES) -> dict[str, DataFrame]:
    """A compressed sparse matrix (by rows; by columns if ``by_column``) of the counts that are
    not 0: ``obs(row, keys...)`` and ``var(col, barcode)`` in order, ``indptr(line, start)`` with
    a last entry behind all lines, and ``blocks(block, indices, data)``: the arrays of the
    format, cut every ``block`` values.

    Values are numbered by ranges of (line, index) and starts are running sums by ranges, so no
    task holds a line, nor all of them.
    """
    keys = keys_of(counts)
    sums = stored(counts.where("barcode is not null").groupBy(*keys, "barcode").agg(F.sum("counts").alias("value")), "sums")
    obs = stored(numbered(sums.select(*keys).distinct(), keys, "row"), "obs")
    var = stored(numbered(sums.select("barcode").distinct(), ["barcode"], "col"), "var")
    line, index = ("col", "row") if by_column else ("row", "col")
    held = sums.where("value <> 0").join(var, "barcode").join(obs, [sums[k].eqNullSafe(obs[k]) for k in keys]).select(F.col(line).alias("line"), F.col(index).alias("index"), "value")
    held = stored(numbered(held, ["line", "index"], "k"), "values")
    each = (var if by_column else obs).select(F.col(line).alias("line")).join(held.groupBy("line").agg(F.count("*").alias("n")), "line", "left").select("line", F.coalesce("n", F.lit(0)).alias("n"))
    end = each.agg(F.coalesce(F.max("line") + 1, F.lit(0)).alias("line"), F.lit(0).cast("long").alias("n"))
    indptr = running(each.union(end), ["line"], "n", "start").select("line", "start")
    packed = held.groupBy(F.floor(F.col("k") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", "index", "value"))).alias("x"))
    return {"obs": obs, "var": var, "indptr": indptr, "blocks": packed.select("block", F.col("x.index").alias("indices"), F.col("x.value").alias("data"))}


def expanded(x: dict[str, DataFrame], by_column: bool = False, block: int = VALUES) -> DataFrame:
    """The counts of a compressed matrix, long: each line meets the blocks that it is in."""
    starts = x["indptr"]
    following = starts.select((F.col("line") - 1).alias("line"), F.col("start").alias("end"))
    lines = starts.join(following, "line").where("end > start")
    at = F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long"))).alias("block")
    met = lines.select("line", "start", "end", at).join(x["blocks"], "block")
    first = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    n = F.least(F.col("end") - F.col("block") * block, F.lit(block)) - first
    part = lambda c: F.slice(c, (first + 1).cast("int"), n.cast("int"))
    values = met.select("line", F.inline(F.arrays_zip(part("indices").alias("index"), part("data").alias("counts"))))
    line, index = ("col", "row") if by_column else ("row", "col")
    values = values.select(F.col("line").alias(line), F.col("index").alias(index), "counts")
    out = values.join(x["var"], "col").join(x["obs"], "row")
    return out.select(*keys_of(x["obs"]), "barcode", "counts")


def unique_names(obs: DataFrame, name: str) -> DataFrame:
    """Repeated names get -1, -2, ... from their second occurrence on."""
    w = Window.partitionBy(name).orderBy(*[c for c in obs.columns])
    n = F.row_number().over(w) - 1
    return obs.withColumn(name, F.when(n > 0, F.concat_ws("-", name, n)).otherwise(F.col(name)))


def qc_obs(counts: DataFrame, key: str = "sample") -> DataFrame:
    """Per sample or cell: distinct barcodes, total counts, and log(1 + x) of both."""
    out = counts.groupBy(key).agg(F.count_if(F.col("counts") > 0).alias("n_barcodes_by_counts"), F.sum("counts").alias("total_counts"))
    return out.withColumns({"log1p_n_barcodes_by_counts": F.log1p("n_barcodes_by_counts"), "log1p_total_counts": F.log1p("total_counts")})


def qc_var(counts: DataFrame, key: str = "sample") -> DataFrame:
    """Per barcode: samples or cells that have it, mean, dropout in percent and total over all
    of them, zeros included."""
    pairs = counts.groupBy("barcode", key).agg(F.sum("counts").alias("c"), F.max(F.col("counts") > 0).alias("held"))
    pairs = stored(pairs, "pairs")  # read for the barcodes and for the number of keys
    all_ = pairs.select(key).distinct().agg(F.count(key).alias("__all"))
    out = pairs.groupBy("barcode").agg(F.count_if("held").alias("n_cells_by_counts"), F.sum("c").alias("total_counts")).crossJoin(F.broadcast(all_))  # one row
    mean = F.col("total_counts") / F.col("__all")
    return out.withColumns({
        "mean_counts": mean, "log1p_mean_counts": F.log1p(mean),
        "pct_dropout_by_counts": (1 - F.col("n_cells_by_counts") / F.col("__all")) * 100, "log1p_total_counts": F.log1p("total_counts"),
    }).drop("__all")
