"""Problem 7: mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgraph.llm.tokens import TOKENIZERS, with_token_counts
from depgraph.sources.shared import kept

#: Newton steps at most, and the relative error of a source's tokens at which they end.
STEPS, TOLERANCE = 40, 1e-9
#: Parts into which the documents of one source and size are split when their copies are rounded, at least, and documents for which one more is taken.
PARTS, PART_ROWS = 64, 1_000_000
#: Rates are summed as whole numbers of this fraction, so sums don't depend on their order: 10^11 documents fit into a bigint.
UNIT = 1 << 24


def source_name(c: str):
    """Sources written in odd case or with blanks around them are the same."""
    return F.lower(F.trim(F.col(c)))


def total_and_targets(available: dict[str, float], share: dict[str, float], most: dict[str, int], total: float | None) -> tuple[float, dict[str, float]]:
    """Tokens to take from each source.

    Sources without tokens drop out and their share goes to the others in proportion. Without a total, the
    largest is taken at which every other source reaches its share within its repeats, so shares are exact.
    With a total, a source that can't reach its share gives all it may, and the others share the rest.
    """
    room = {s: available.get(s, 0) * most[s] for s in share if share[s] > 0}
    live = {s for s in room if room[s] > 0}
    if not live:
        return 0.0, {}
    whole = sum(share[s] for s in live)
    if total is None:
        total = min(room[s] * whole / share[s] for s in live)
    targets: dict[str, float] = {}
    free = set(live)
    while free:
        rest = total - sum(targets.values())
        weight = sum(share[s] for s in free)
        full = {s for s in free if rest * share[s] / weight >= room[s] * (1 - 1e-12)}
        if not full:
            targets |= {s: rest * share[s] / weight for s in free}
            break
        targets |= {s: room[s] for s in full}
        free -= full
    return total, targets


def _rate(tilt: str, most: str, size: str, scale: str):
    """Exponentially tilted rate of a document, at most its repeats."""
    return F.least(F.col(most).cast("double"), F.exp(F.least(F.col(tilt) * F.col(size) / F.col(scale), F.lit(700.0))))


def balance(sizes: DataFrame, targets: dict[str, float], most: dict[str, int], scale: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> dict[str, float]:
    """Dual variables of the entropy balancing problem, one per source.

    Of all document rates r with sum(tokens * r) = target in every source and r <= repeats, the wanted ones
    are nearest to 1 in relative entropy: r = min(repeats, exp(tilt * tokens / scale)). The dual is convex
    and falls apart by source; each Newton step sums gradient and curvature over all sizes in one distributed
    aggregation and is kept inside the bracket of the root found so far. sizes: (source, n_tokens, n).
    """
    spark = sizes.sparkSession
    lo, hi = dict.fromkeys(targets, -math.inf), dict.fromkeys(targets, math.inf)
    tilt = dict.fromkeys(targets, 0.0)
    open_ = set(targets)
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(s, float(tilt[s]), int(most[s]), float(scale[s])) for s in sorted(open_)], "source string, tilt double, most int, scale double")
        r = sizes.join(F.broadcast(now), "source")  # a row per source of the target table
        rate = _rate("tilt", "most", "n_tokens", "scale")
        inside = rate < F.col("most")
        weight = F.col("n") * F.col("n_tokens") * rate
        sums = r.groupBy("source").agg(F.sum(weight).alias("g"), F.sum(F.when(inside, weight * F.col("n_tokens") / F.col("scale")).otherwise(0.0)).alias("h")).collect()
        for s, g, h in sums:
            off = g - targets[s]
            if abs(off) <= tolerance * targets[s]:
                open_.discard(s)
                continue
            if off > 0:
                hi[s] = tilt[s]
            else:
                lo[s] = tilt[s]
            step = tilt[s] - off / h if h > 0 else math.nan
            if not lo[s] < step < hi[s]:
                step = (lo[s] + hi[s]) / 2 if math.isfinite(lo[s]) and math.isfinite(hi[s]) else (max(1.0, 2 * abs(lo[s])) if off < 0 else -max(1.0, 2 * abs(hi[s])))
            if step == tilt[s]:
                open_.discard(s)
            tilt[s] = step
    return tilt


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """How often each document comes into the mix: (doc_id, source, n_tokens, rate, copies).

    Sources are compared without case and blanks around them. Documents whose source is null or has no
    target, and those without tokens (null and empty texts), come with rate and copies 0; targets with a null
    source or share don't count, of repeated ones the largest share. Empty tables give no rows. Rates are
    those of :func:`balance`; copies are their systematic rounding: in the order of sizes, document i gets
    floor(R_i) - floor(R_(i-1)) copies of the running sum R of rates, so every stretch of sizes has its due
    and no document more than its repeats. Sums are of whole numbers (rates in units of 1 / UNIT), so they are
    exact. The running sums start from those of small parts (source, size class, part of it by hash, more of
    them with more documents), so no source is ever in one task.
    """
    counted = with_token_counts(docs.where("doc_id IS NOT NULL").withColumn("source", source_name("source")), "doc_id", "source", folder=folder)
    counted = kept(counted, "mix_counts")
    sizes = kept(counted.where("source IS NOT NULL AND n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "mix_sizes")
    want = targets.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy(source_name("source").alias("source")).agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    rows = want.collect()  # the target table: a row per source
    share, most = {r[0]: r[1] for r in rows}, {r[0]: max(0, r[2]) for r in rows}
    stats = sizes.join(F.broadcast(want.select("source")), "source").groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("docs")).collect()
    have, scale = {r[0]: float(r[1]) for r in stats}, {r[0]: r[1] / r[2] for r in stats}
    _, aims = total_and_targets(have, share, most, total_tokens)
    tilt = balance(sizes, aims, most, scale)
    parts = max(PARTS, 1 << (int(sum(r[2] for r in stats)) // PART_ROWS).bit_length())
    spark = docs.sparkSession
    solved = spark.createDataFrame([(s, float(tilt[s]), int(most[s]), float(scale[s])) for s in sorted(aims)], "source string, tilt double, most int, scale double")
    rated = counted.join(F.broadcast(solved), "source", "left")
    rate = F.when((F.col("n_tokens") > 0) & F.col("tilt").isNotNull(), _rate("tilt", "most", "n_tokens", "scale")).otherwise(0.0)
    rated = rated.withColumn("rate", rate).withColumn("class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) * 8).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("units", F.round(F.col("rate") * UNIT).cast("bigint"))
    part = ["source", "class", "part"]
    before = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)  # over classes x parts rows at most
    starts = rated.groupBy(*part).agg(F.sum("units").alias("r")).withColumn("start", F.coalesce(F.sum("r").over(before), F.lit(0))).drop("r")
    here = Window.partitionBy(*part).orderBy("n_tokens", F.xxhash64("doc_id", F.lit(7)), "doc_id")
    run = rated.join(starts.withColumnsRenamed({"source": "s2", "class": "c2", "part": "p2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")) & (F.col("part") == F.col("p2")))
    upto = F.col("start") + F.sum("units").over(here.rowsBetween(Window.unboundedPreceding, 0)) + UNIT // 2
    copies = F.greatest(F.lit(0), F.least(F.shiftright(upto, UNIT.bit_length() - 1) - F.shiftright(upto - F.col("units"), UNIT.bit_length() - 1), F.coalesce("most", F.lit(0)))).cast("int")
    return run.withColumn("copies", copies).select("doc_id", "source", "n_tokens", "rate", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: its target share, documents and tokens there are, tokens in the mix, share reached and most copies."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    want = targets.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy(source_name("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    r = want.join(got, "source", "left").na.fill(0, ["n_docs", "tokens", "mixed_tokens", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # a row per source
    return r.withColumn("reached_share", F.round(F.try_divide(F.col("mixed_tokens").cast("double"), total), 9))
