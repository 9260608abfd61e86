"""Attack campaigns thinned out over hosts and windows, attack budgets, and label shuffles.

All choices come from hashes of keys, so every executor makes the same ones. A campaign is a
label from one source. Its flows are numbered and dealt over (host, window) slots; slots are
the windows with the highest Gumbel keys over benign activity, a weighted sample without
replacement.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.exprs import portable, uniform


@dataclass(frozen=True)
class Diffusion:
    flows_per_cell: float
    window_us: int = 60_000_000
    min_windows: int = 20
    fallback_hosts: int = 8
    hide: bool = True
    seed: int = 0
    benign: str = "benign"


def gumbel(weight: Column, u: Column) -> Column:
    u = F.greatest(F.least(u, F.lit(1 - 1e-12)), F.lit(1e-12))
    return F.log(weight + 1e-6) - F.log(-F.log(u))


def activity(wf: DataFrame, cfg: Diffusion) -> DataFrame:
    """(host, seen): the windows with benign flows of each source, and how many: an entry a window."""
    cells = wf.where(F.col("label") == cfg.benign).groupBy(F.col("src").alias("host"), "window").agg(F.count("*").alias("n"))
    return cells.groupBy("host").agg(F.collect_list(F.struct("window", "n")).alias("seen"))


def blend_pool(wf: DataFrame, cfg: Diffusion) -> DataFrame:
    """(host, seen, windows): sources with benign flows in enough windows, or those with most."""
    spread = activity(wf, cfg).withColumn("windows", F.size("seen"))
    top = spread.orderBy(F.desc("windows"), "host").limit(cfg.fallback_hosts)
    wide = spread.where(F.col("windows") >= cfg.min_windows)
    found = wide.agg(F.count("*").alias("found"))
    return wide.unionByName(top.crossJoin(F.broadcast(found)).where("found = 0").drop("found"))


def top_windows(hosts: DataFrame, cfg: Diffusion, k: Column, n_windows: int) -> DataFrame:
    """(campaign, host, window, rank, ...): per row of `hosts` (campaign, host, seen, ...) the k windows
    of a weighted sample; all of the n_windows of the input can be drawn. A row's windows are
    ordered where the row is: nothing is shuffled."""
    key = lambda window, n: gumbel(n.cast("double") if cfg.hide else F.lit(1.0), portable(cfg.seed, F.col("campaign"), F.col("host"), window))
    entry = lambda window, n: F.struct((-key(window, n)).alias("key"), window.alias("window"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(n_windows - 1).cast("long"))
    busy = F.transform(F.filter("seen", lambda x: x["window"] >= 0), lambda x: entry(x["window"], x["n"]))
    idle = F.transform(F.array_except(every, F.transform("seen", lambda x: x["window"])), lambda w: entry(w, F.lit(0)))
    best = F.slice(F.array_sort(F.concat(busy, idle)), F.lit(1), k.cast("int"))
    kept = [c for c in hosts.columns if c != "seen"]
    rows = hosts.select(*kept, F.posexplode(best).alias("pos", "best"))
    return rows.select(*kept, F.col("best.window").alias("window"), (F.col("pos") + 1).alias("rank"))


def _prime(least: int) -> int:
    """The smallest prime that is not below `least`."""
    n = max(2, least)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def drawn_hosts(campaigns: DataFrame, n_hosts: int, wanted: Column, seed: int) -> DataFrame:
    """`campaigns` (campaign, ...) with h and number: `wanted` different numbers below n_hosts for
    each, the first of its own order of all numbers, which is a multiple of a step and a start
    modulo a prime. Campaigns and hosts are never paired but for those drawn."""
    prime = _prime(n_hosts)
    start, step = F.pmod(F.xxhash64(F.lit(seed), "campaign"), F.lit(prime)), F.pmod(F.xxhash64(F.lit(seed + 1), "campaign"), F.lit(prime - 1)) + 1
    # of so many places at most prime - n_hosts name no host
    tries = F.sequence(F.lit(0).cast("long"), wanted - 1 + (prime - n_hosts))
    places = F.filter(F.transform(tries, lambda j: (j * step + start) % prime), lambda x: x < n_hosts)
    return campaigns.select("*", F.posexplode(F.slice(places, F.lit(1), wanted.cast("int"))).alias("h", "number"))


def diffuse(wf: DataFrame, cfg: Diffusion) -> DataFrame:
    """`wf` (us, src, window, label, ... and a unique `id`) with attacks re-timed and re-homed; benign
    rows stay. Error if there is no attack, or no benign host that could carry it."""
    whole = wf.agg(F.count_if(F.col("label") != cfg.benign), F.max("window") + 1, F.min("us")).first()
    if not whole[0]:
        raise ValueError("no attack rows to diffuse")
    _, n_windows, t0 = whole
    pool = blend_pool(wf, cfg).select("host", "seen").persist()
    n_hosts = pool.count()
    if not n_hosts:
        raise ValueError("no benign rows to hide attacks among")
    campaign = F.concat_ws("|", "label", "src")
    cells = F.greatest(F.lit(1), F.ceil(F.col("flows") / cfg.flows_per_cell))
    hosts = F.least(F.ceil(cells / F.lit(n_windows)), F.lit(n_hosts).cast("long"))
    per_host = F.least(F.ceil(cells / hosts), F.lit(n_windows).cast("long"))
    attacks = wf.where(F.col("label") != cfg.benign).withColumn("campaign", campaign)
    sizes = attacks.groupBy("campaign").agg(F.count("*").alias("flows")).withColumns({"cells": cells, "per_host": per_host})
    drawn = drawn_hosts(sizes, n_hosts, hosts, cfg.seed).drop("flows")
    numbered = _numbered(pool, F.xxhash64(F.lit(cfg.seed), "host"), "host")
    slots = top_windows(drawn.join(numbered, "number"), cfg, F.col("per_host"), n_windows)
    # each host of a campaign has per_host slots, the last one those that are left
    slots = slots.withColumn("slot", F.col("h") * F.col("per_host") + F.col("rank") - 1).where(F.col("slot") < F.col("cells"))
    slots = slots.select("campaign", "slot", F.col("host").alias("new_src"), F.col("window").alias("new_window"))
    own = Window.partitionBy("campaign")
    dealt = attacks.withColumn("nth", F.row_number().over(own.orderBy("id")) - 1).withColumn("flows", F.count("*").over(own))
    dealt = dealt.withColumn("slot", F.col("nth") % F.least(cells, hosts * per_host)).drop("nth", "flows")
    moved = dealt.join(slots, ["campaign", "slot"])
    at = t0 + F.col("new_window") * cfg.window_us + F.floor(uniform(cfg.seed + 1, F.col("id")) * cfg.window_us)
    moved = moved.withColumn("us", at).withColumn("src", F.col("new_src")).withColumn("window", F.col("new_window"))
    return wf.where(F.col("label") == cfg.benign).unionByName(moved.select(*wf.columns))


def multiset(*columns: str) -> list[Column]:
    """Aggregates that are equal for two tables that hold the same rows as often, whatever their
    order, and for others with odds of about 2^-63: sums of a row's hash, in three pieces that
    do not overflow."""
    h = F.xxhash64(*columns)
    return [F.sum(F.shiftrightunsigned(h, 21 * i).bitwiseAND((1 << 21) - 1)) for i in range(3)]


def diffusion_stats(wf: DataFrame, benign: str = "benign") -> DataFrame:
    """Attack flows a cell (mean, median), dilution (attack share of attack cells), benign flows there."""
    cells = wf.groupBy("window", "src").agg(F.count("*").alias("n"), F.count_if(F.col("label") != benign).alias("a")).where("a > 0")
    return cells.agg(F.avg("a").alias("mean_attack"), F.percentile("a", F.lit(0.5)).alias("median_attack"), F.avg(F.col("a") / F.col("n")).alias("dilution"), F.avg((F.col("n") - F.col("a")).cast("double")).alias("benign_per_attack_cell"), F.count("*").alias("attack_cells"))


def budget(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many of each class to keep: smallest classes first, what they leave goes to the rest."""
    out, left = {}, total
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, left // (len(counts) - i))
        left -= out[label]
    return out


def within_budget(rows: DataFrame, total: int, seed: int = 0, benign: str = "benign") -> DataFrame:
    """All benign rows and a hash-ordered share of each attack class."""
    attacks = rows.where(F.col("label") != benign)
    take = budget({r["label"]: r["count"] for r in attacks.groupBy("label").count().collect()}, total)
    kept = rows.sparkSession.createDataFrame(list(take.items()) or [("", 0)], "label string, take long")
    # a bound on the place lets some more rows than wanted through, and few of a class are sorted
    counts = attacks.groupBy(F.col("label")).agg(F.count("*").alias("total"))
    place = attacks.withColumn("place", portable(seed, F.col("id"))).join(F.broadcast(kept), "label").join(F.broadcast(counts), "label")
    slack = F.col("take") + 6 * F.sqrt("take") + 40
    w = Window.partitionBy("label").orderBy("place", "id")
    chosen = place.where(F.col("place") * F.col("total") <= slack).withColumn("nth", F.row_number().over(w)).where("nth <= take")
    return rows.where(F.col("label") == benign).unionByName(chosen.select(*rows.columns))


def permuted_labels(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(id, label): labels dealt anew, each as often as before. Two orders of a global number are
    joined; a range partitioning numbers rows without one task for all."""
    a = _numbered(rows.select("id"), F.xxhash64(F.lit(seed), "id"), "id")
    b = _numbered(rows.select("id", "label"), F.xxhash64(F.lit(seed + 1), "id"), "id").drop("id")
    return a.join(b, "number").select("id", "label")


def _numbered(rows: DataFrame, key: Column, tie: str) -> DataFrame:
    """Rows with their place in the order of (key, tie): places in a bucket of the key and the sum of the buckets before."""
    rows = rows.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 52))
    before = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("key", tie))
    return rows.withColumn("own", own).join(F.broadcast(before.select("bucket", "before")), "bucket").withColumn("number", F.col("before") + F.col("own") - 1).drop("key", "bucket", "own", "before")
