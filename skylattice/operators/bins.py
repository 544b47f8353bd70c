"""Mass bins: the most massive groups first, then fixed steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mass_bin_edges(masses: DataFrame, step: float = 0.2, top_counts: tuple[int, ...] = (10, 100, 1000), key: str = "key") -> list[dict]:
    """Edges ``bin_idx, lo, hi, label`` from ``masses(key, mass)``; hi of the first bin is None (open).

    The heads are found by a top-k of their total count, the rest needs only the least value: a few
    scalars come to the driver.  An empty table has no bins; non-positive or missing masses and a
    step that isn't positive are errors.
    """
    if not step > 0:
        raise ValueError("step must be positive")
    bad = masses.where(F.col("mass").isNull() | F.isnan("mass") | (F.col("mass") <= 0)).limit(1).count()
    if bad:
        raise ValueError("masses must be positive numbers")
    log_mass = masses.select(F.log10("mass").alias("lm"), key)
    facts = log_mass.agg(F.count("*").alias("n"), F.min("lm").alias("low"), F.max("lm").alias("high")).first()
    if not facts["n"]:
        return []
    ends, total = [], 0
    for c in top_counts:
        total = min(total + max(c, 0), facts["n"])
        ends.append(total)
    top = log_mass.orderBy(F.col("lm").desc(), key).limit(max(ends, default=0)).withColumn("rank", F.row_number().over(Window.orderBy(F.col("lm").desc(), key)))
    at = {r["rank"]: r["lm"] for r in top.where(F.col("rank").isin(ends)).collect()} if ends else {}
    return _edges(at, facts["low"], facts["high"], ends, step)


def _edges(at: dict[int, float], low: float, high: float, ends: list[int], step: float) -> list[dict]:
    """Edges from the log masses at the ranks that end the heads, and the extremes."""
    bins, hi, used = [], None, 0
    for place, end in enumerate(ends):
        if end == used:
            continue
        lo = at[end]
        # The label has the number of groups found, which can be less than asked for.
        bins.append({"bin_idx": len(bins), "lo": lo, "hi": hi, "label": f"{'next' if place else 'top'}{end - used}", "first": used, "end": end})
        hi, used = lo, end
    hi = high if hi is None else hi
    while True:
        lo = hi - step
        last = lo <= low
        bins.append({"bin_idx": len(bins), "lo": low if last else lo, "hi": hi, "label": None})
        if last:
            return bins
        hi = lo


BIN_SCHEMA = "bin_idx int, lo double, hi double, label string"


def assign_bins(rows: DataFrame, bins: list[dict], value: str = "log_mass") -> DataFrame:
    """Rows with the bin whose half-open range [lo, hi) holds their value; others go.

    There are as many edges as steps between the extremes, so their broadcast is small by construction.
    """
    table = rows.sparkSession.createDataFrame([(b["bin_idx"], b["lo"], b["hi"], b["label"]) for b in bins], BIN_SCHEMA)
    return rows.join(F.broadcast(table), (F.col(value) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(value) < F.col("hi"))))


def bin_members(masses: DataFrame, bins: list[dict], key: str = "key") -> DataFrame:
    """``bin_idx, log_mass`` of the groups that made each bin: the heads by rank (ties by key), the steps by
    value, the last step with its upper edge.  The heads' total is bounded by the counts asked for."""
    log_mass = masses.select(F.log10("mass").alias("log_mass"), key)
    heads = [b for b in bins if b["label"] is not None]
    steps = [b for b in bins if b["label"] is None]
    table = lambda rows: masses.sparkSession.createDataFrame(rows, "bin_idx int, a double, b double, closed boolean")
    last = max((b["bin_idx"] for b in steps), default=None)
    edges = table([(b["bin_idx"], float(b["lo"]), float(b["hi"]), b["bin_idx"] == last) for b in steps])
    x = F.col("log_mass")
    out = log_mass.join(F.broadcast(edges), (x >= F.col("a")) & ((x < F.col("b")) | (F.col("closed") & (x == F.col("b"))))).select("bin_idx", "log_mass")
    if heads:
        order = [x.desc(), F.col(key)]
        top = log_mass.orderBy(*order).limit(heads[-1]["end"]).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        ranks = table([(b["bin_idx"], float(b["first"]), float(b["end"]), False) for b in heads])
        out = out.unionByName(top.join(F.broadcast(ranks), (F.col("rank") > F.col("a")) & (F.col("rank") <= F.col("b"))).select("bin_idx", "log_mass"))
    return out


def bin_summary(binned: DataFrame, bins: list[dict], masses: DataFrame | None = None, value: str = "log_mass", key: str = "key") -> DataFrame:
    """Every bin with its edges, the count of the rows selected again and the median of the groups that made
    it (of the selected rows without ``masses``); an empty bin has count 0 and no median."""
    table = binned.sparkSession.createDataFrame([(b["bin_idx"], b["lo"], b["hi"]) for b in bins], "bin_idx int, lo double, hi double")
    counts = binned.groupBy("bin_idx").agg(F.count("*").alias("count"))
    members = binned if masses is None else bin_members(masses, bins, key)
    medians = members.groupBy("bin_idx").agg(F.median(value).alias("median_log_mass"))
    return table.join(counts, "bin_idx", "left").join(medians, "bin_idx", "left").withColumn("count", F.coalesce("count", F.lit(0)))


EDGES = "bin_idx int, lo double, hi double, label string, first int, end int, closed boolean"


def grouped_edges(masses: DataFrame, group: str, step: float = 0.2, top_counts: tuple[int, ...] = (10, 100, 1000), key: str = "key") -> DataFrame:
    """``group`` and ``EDGES`` of every group of ``masses(group, key, mass)``, by the rules of ``mass_bin_edges``.

    One plan over all groups: ranks up to the heads' total (kept in the tasks before the shuffle), the
    extremes, and a few numbers of each group turned into its edges where they lie.  A head has the
    ranks it spans, ``closed`` marks the last step, whose members may lie on its upper edge.
    """
    if not step > 0:
        raise ValueError("step must be positive")
    x = F.log10("mass")
    checked = F.when(F.col("mass").isNull() | F.isnan("mass") | (F.col("mass") <= 0), F.raise_error(F.lit("masses must be positive numbers"))).otherwise(x)
    rows = masses.select(group, F.col(key).alias("_key"), checked.alias("lm"))
    facts = rows.groupBy(group).agg(F.count("lm").alias("n"), F.min("lm").alias("low"), F.max("lm").alias("high"))
    asked = [sum(max(c, 0) for c in top_counts[: i + 1]) for i in range(len(top_counts))]
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("lm").desc(), "_key"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= max(asked, default=0))
    # Of the heads only the ranks that end one are needed; a group smaller than its heads ends with its last row.
    ends = top.join(facts.select(group, "n"), group).where(F.col("rank").isin(asked) | (F.col("rank") == F.col("n")))
    listed = ends.groupBy(group).agg(F.collect_list(F.struct("rank", "lm")).alias("at"))
    kind = masses.schema[group].dataType.simpleString()

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, n, low, high, at in zip(pdf[group], pdf["n"], pdf["low"], pdf["high"], pdf["at"], strict=True):
                known = {} if at is None else {r["rank"]: r["lm"] for r in at}
                own = _edges(known, low, high, [min(e, n) for e in asked], step)
                out += [(name, b["bin_idx"], b["lo"], b["hi"], b["label"], b.get("first"), b.get("end"), i == len(own) - 1) for i, b in enumerate(own)]
            yield pd.DataFrame(out, columns=[group, "bin_idx", "lo", "hi", "label", "first", "end", "closed"], dtype=object)

    return facts.join(listed, group, "left").mapInPandas(edges, f"{group} {kind}, {EDGES}")


def assign_grouped(rows: DataFrame, edges: DataFrame, group: str, value: str = "log_mass") -> DataFrame:
    """Rows with the bin of their group whose half-open range [lo, hi) holds their value; others go."""
    bins = edges.select(group, "bin_idx", "lo", "hi", "label")
    return rows.join(bins, group).where((F.col(value) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(value) < F.col("hi"))))


def grouped_summary(binned: DataFrame, edges: DataFrame, masses: DataFrame, group: str, top_counts: tuple[int, ...], key: str = "key") -> DataFrame:
    """``group, bin_idx, lo, hi, count, median_log_mass`` of every bin of every group: the count of the rows
    selected again, and the median of the rows that made the bin (heads by rank, steps by value)."""
    rows = masses.select(group, F.col(key).alias("_key"), F.log10("mass").alias("log_mass"))
    x = F.col("log_mass")
    steps = rows.join(edges.where("label is null"), group).where((x >= F.col("lo")) & ((x < F.col("hi")) | (F.col("closed") & (x == F.col("hi")))))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(x.desc(), "_key"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= sum(max(c, 0) for c in top_counts))
    heads = top.join(edges.where("label is not null"), group).where((F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("end")))
    members = steps.select(group, "bin_idx", "log_mass").unionByName(heads.select(group, "bin_idx", "log_mass"))
    medians = members.groupBy(group, "bin_idx").agg(F.median("log_mass").alias("median_log_mass"))
    counts = binned.groupBy(group, "bin_idx").agg(F.count("*").alias("count"))
    out = edges.select(group, "bin_idx", "lo", "hi").join(counts, [group, "bin_idx"], "left").join(medians, [group, "bin_idx"], "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0)))
