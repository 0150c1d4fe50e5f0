"""Mixing sources to target weights by entropy balancing.

Rates of use are sought as close as possible, in entropy, to one base rate for all documents, under one
constraint for each source: its expected tokens are its share of the mix. The convex dual has one multiplier
a source; the rates are exponential tilts of the base by document size, cut off at the source's maximum. The
dual is solved by Newton steps over the distributed table of (source, size, number of documents), each step
one small aggregate, kept inside a bracket.
Rates become copies by their whole part and one more where a hash of the document falls below the
remainder; the threshold of the hash is moved, by a histogram, to where the tokens meet the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.scratch import Scratch

ITERATIONS, TOLERANCE, BINS, LIMIT = 60, 1e-7, 1 << 14, 60.0


def _of(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("source")]


def _rate(cap: dict, scale: dict, base: dict, lam: dict) -> Column:
    """base exp(lambda size / scale), at most cap."""
    x = F.col("n_tokens") / _of(scale)
    return F.least(_of(cap), _of(base) * F.exp(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), _of(lam) * x))))


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, fraction: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of a mix of fraction times the size of all docs.

    docs: doc_id, source, n_tokens; targets: source (unique), target_share, max_repeats - a fixed table of few
    rows. copies: doc_id, source, n_tokens, rate, copies of each document that is used, at most max_repeats
    times. shares: a row for each target with what was reached, and one of source '(all)' with the sums. Documents without tokens, with a null source
    or one without a target are not used, but all tokens count for the mix' size. A source that can't reach
    its target with max_repeats gives all it may. Repeated doc_ids are documents of their own that are
    rounded alike; a target share or maximum that is null or not positive asks for nothing. Empty docs give
    no copies and shares of zero.
    """
    tmp = Scratch(spark)
    docs = tmp.cut(docs.select("doc_id", "source", "n_tokens"))  # counted once
    want = {r["source"]: (float(r["target_share"]), float(r["max_repeats"])) for r in targets.collect() if r["source"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    sizes = tmp.cut(docs.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum(F.col("n") * F.col("n_tokens"))).first()[0] or 0
    goal = {s: share * fraction * total for s, (share, _) in want.items()}
    sizes = sizes.where(F.col("source").isin(list(want)))
    have = {r["source"]: (r["t"], r["n"]) for r in sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    used = {s for s in want if s in have}
    full = {s for s in used if goal[s] >= want[s][1] * have[s][0]}  # all documents as often as they may be used
    cap = {s: want[s][1] for s in used}
    scale = {s: have[s][0] / have[s][1] for s in used}
    base = {s: min(fraction, cap[s]) for s in used}
    lam = {s: 0.0 for s in used}
    low, high, open_ = {s: -1e6 for s in used}, {s: 1e6 for s in used}, used - full
    for _ in range(ITERATIONS if open_ else 0):
        w, t = _rate(cap, scale, base, lam), F.col("n") * F.col("n_tokens")
        step = sizes.where(F.col("source").isin(list(open_))).groupBy("source").agg(F.sum(w * t).alias("g"), F.sum(F.when(w < _of(cap), w * t * F.col("n_tokens") / _of(scale)).otherwise(0.0)).alias("h"))
        for r in step.collect():
            s, gap = r["source"], r["g"] - goal[r["source"]]
            if abs(gap) <= TOLERANCE * goal[s] + 1e-9:
                open_ = open_ - {s}
                continue
            low[s], high[s] = (low[s], lam[s]) if gap > 0 else (lam[s], high[s])
            to = lam[s] - gap / r["h"] if r["h"] > 0 else float("nan")
            if not low[s] < to < high[s] or abs(to - lam[s]) > 4:
                to = lam[s] + (4 if gap < 0 else -4)
                to = to if low[s] < to < high[s] else (low[s] + high[s]) / 2
            lam[s] = to
        if not open_:
            break
    if not used:
        copies = docs.where("false").select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
        return copies, _shares(spark, copies, want, goal)
    all_of = F.col("source").isin(list(full)) if full else F.lit(False)
    rated = docs.where((F.col("n_tokens") > 0) & F.col("source").isin(list(used))).withColumn("rate", F.when(all_of, _of(cap)).otherwise(_rate(cap, scale, base, lam)))
    whole = F.least(F.floor(F.col("rate") + 1e-9), _of(cap)).cast("int")
    unit = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)
    rated = tmp.cut(rated.withColumn("whole", whole).withColumn("h", unit - (F.col("rate") - F.col("whole"))).withColumn("more", F.col("whole") < _of(cap)))
    bin_ = F.floor((F.col("h") + 1) / 2 * BINS)
    hist = rated.groupBy("source", F.when(F.col("more"), bin_).otherwise(-1).alias("bin")).agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("sure"), F.sum("n_tokens").alias("t")).collect()  # at most BINS + 1 rows a target
    edge = {}
    for s in used:
        sure = sum(r["sure"] for r in hist if r["source"] == s)
        best, at, reached = abs(sure - goal[s]), 0, sure
        for r in sorted((r for r in hist if r["source"] == s and r["bin"] >= 0), key=lambda r: r["bin"]):
            reached += r["t"]
            if abs(reached - goal[s]) < best:
                best, at = abs(reached - goal[s]), r["bin"] + 1
        edge[s] = float(at)
    extra = (F.col("more") & (bin_ < _of(edge))).cast("int")
    copies = rated.select("doc_id", "source", "n_tokens", "rate", (F.col("whole") + extra).cast("int").alias("copies")).where("copies > 0")
    return copies, _shares(spark, copies, want, goal)


def _shares(spark: SparkSession, copies: DataFrame, want: dict, goal: dict) -> DataFrame:
    rows = [(s, share, int(cap), float(goal[s])) for s, (share, cap) in want.items()]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, target_tokens double")
    got = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    got = plan.join(F.broadcast(got), "source", "left").na.fill(0, ["tokens", "n_docs", "n_copies", "most_copies"])  # a row a target
    got = got.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))
    sums = [F.sum(c).alias(c) for c in ("target_share", "target_tokens", "tokens", "n_docs", "n_copies", "actual_share")]
    whole = got.agg(*sums, F.max("max_repeats").alias("max_repeats"), F.max("most_copies").alias("most_copies")).withColumn("source", F.lit("(all)"))
    return got.unionByName(whole.where("target_share is not null"))
