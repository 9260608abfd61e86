"""Name and fingerprint statistics that look only at earlier windows.

Sums per window come first (a few thousand rows), running totals over earlier windows after
that, and names are scored against those by a join: no global state, no order within a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.exprs import char_entropy, digit_ratio, longest_label
from netloom.operators.ordered import quantiles

# The symbols of names, and all others as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-"
SYMBOLS = len(ALPHABET) + 1
PRIOR = 0.5
#: Names and fingerprints of a cell that count.
SAMPLE = 64
#: Rows of a table of counts that goes to all workers, some 40 bytes each.
BROADCAST_ROWS = 1_000_000


def codes(name: Column) -> Column:
    """Each character's number; one beyond the alphabet for all others."""
    cs = F.filter(F.split(F.lower(name), ""), lambda c: c != "")
    return F.transform(cs, lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(SYMBOLS - 1))


def pairs_of(names: DataFrame) -> DataFrame:
    """(name_id, window, a, b) of all neighbouring symbols."""
    c = codes(F.col("qname"))
    return names.withColumn("c", c).select("name_id", "window", F.posexplode("c").alias("i", "a"), "c").where(F.col("i") + 1 < F.size("c")).select("name_id", "window", "a", F.expr("c[i + 1]").alias("b"))


def causal_surprisal(names: DataFrame) -> DataFrame:
    """(name_id, surprisal): the mean of -log2((c + 0.5) / (row + 0.5 * 38)) over a name's pairs,
    with counts of strictly earlier windows; names of fewer than two symbols score 0."""
    pairs = pairs_of(names)
    counts = pairs.groupBy("a", "b", "window").agg(F.count("*").alias("n"))
    rows = counts.groupBy("a", "window").agg(F.sum("n").alias("n"))

    def before(keys: list[str]) -> Window:
        return Window.partitionBy(*keys).orderBy("window").rangeBetween(Window.unboundedPreceding, -1)

    # totals at every window in which a pair is scored: rows of this window bring that point
    c = counts.withColumn("c", F.coalesce(F.sum("n").over(before(["a", "b"])), F.lit(0))).select("a", "b", "window", "c")
    r = rows.withColumn("row", F.coalesce(F.sum("n").over(before(["a"])), F.lit(0))).select("a", "window", "row")
    known = c.join(r, ["a", "window"])
    # a window has at most SYMBOLS**2 pairs, so few windows have a small table
    if names.select("window").distinct().count() * SYMBOLS**2 <= BROADCAST_ROWS:
        known = F.broadcast(known)
    scored = pairs.join(known, ["a", "b", "window"])
    bits = -F.log2((F.col("c") + PRIOR) / (F.col("row") + PRIOR * SYMBOLS))
    out = scored.groupBy("name_id").agg(F.avg(bits).alias("surprisal"))
    return names.select("name_id", "window").join(out, "name_id", "left").select("name_id", "window", F.coalesce("surprisal", F.lit(0.0)).alias("surprisal"))


def left_out_surprisal(names: DataFrame) -> DataFrame:
    """The same against all other names: the name's own pairs are taken from the totals."""
    pairs = pairs_of(names)
    total = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    row = total.groupBy("a").agg(F.sum("c").alias("row"))
    own = pairs.groupBy("name_id", "a", "b").agg(F.count("*").alias("own"))
    own_row = own.groupBy("name_id", "a").agg(F.sum("own").alias("own_row"))
    scored = own.join(own_row, ["name_id", "a"]).join(total, ["a", "b"]).join(row, "a")
    bits = -F.log2((F.col("c") - F.col("own") + PRIOR) / (F.col("row") - F.col("own_row") + PRIOR * SYMBOLS))
    return scored.groupBy("name_id").agg((F.sum(bits * F.col("own")) / F.sum("own")).alias("surprisal"))


def surprisal_under(seen: DataFrame, names: DataFrame) -> DataFrame:
    """(name_id, surprisal) of `names` under the pairs of the names in `seen`, all of them; names of
    fewer than two symbols score 0."""
    key = lambda df: df.withColumn("window", F.lit(0)) if "window" not in df.columns else df
    total = pairs_of(key(seen)).groupBy("a", "b").agg(F.count("*").alias("c"))
    row = total.groupBy("a").agg(F.sum("c").alias("row"))
    pairs = pairs_of(key(names)).join(F.broadcast(total), ["a", "b"], "left").join(F.broadcast(row), "a", "left")  # SYMBOLS**2 rows at most
    bits = -F.log2((F.coalesce("c", F.lit(0)) + PRIOR) / (F.coalesce("row", F.lit(0)) + PRIOR * SYMBOLS))
    out = pairs.groupBy("name_id").agg(F.avg(bits).alias("surprisal"))
    return names.join(out, "name_id", "left").select(*names.columns, F.coalesce("surprisal", F.lit(0.0)).alias("surprisal"))


def within_lengths(names: DataFrame, like: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """`names` as long as most of `like`: between two quantiles of its lengths. Scores of what is
    left cannot come from length alone."""
    bounds = quantiles(like.select(F.length("qname").alias("n")), "n", [low, high])
    near = F.length("qname").between(F.get("values", F.lit(0)), F.get("values", F.lit(1)))
    return names.crossJoin(F.broadcast(bounds)).where(near).drop("values")  # one row


def rarity(prints: DataFrame, key: str = "fp") -> DataFrame:
    """(window, fp, n, before, rarity, novel): 1 - the share of a fingerprint among all of
    strictly earlier windows; novel if it was in none of them."""
    counts = prints.groupBy("window", key).agg(F.count("*").alias("n"))
    totals = counts.groupBy("window").agg(F.sum("n").alias("all"))
    before = Window.partitionBy(key).orderBy("window").rangeBetween(Window.unboundedPreceding, -1)
    # one row a window: the running total over all of them is small however long the input is
    all_before = Window.orderBy("window").rangeBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("all", F.coalesce(F.sum("all").over(all_before), F.lit(0)))
    out = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(totals, "window")
    share = F.when(F.col("all") > 0, 1 - F.col("before") / F.col("all")).otherwise(1.0)
    return out.select("window", key, "n", "before", share.alias("rarity"), (F.col("before") == 0).alias("novel"))


def name_stats(names: DataFrame) -> DataFrame:
    """(window, host) with count, mean entropy and length, longest label and digit share of names."""
    q = F.col("qname")
    return names.where("qname is not null and qname <> ''").groupBy("window", "host").agg(
        F.count("*").alias("dns_count"),
        F.avg(char_entropy(q)).alias("qname_entropy"),
        F.avg(F.length(q)).alias("qname_len_mean"),
        F.max(longest_label(q)).cast("long").alias("qname_len_max"),
        F.avg(digit_ratio(q)).alias("qname_digit_ratio"),
    )


def sampled(rows: DataFrame, column: str) -> DataFrame:
    """The first SAMPLE rows of a cell, by name_id, that have the column."""
    w = Window.partitionBy("window", "host").orderBy("name_id")
    rows = rows.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SAMPLE).drop("rank")


def protocol_block(names: DataFrame, prints: DataFrame) -> DataFrame:
    """The nine protocol features of each (window, host) from names (name_id, window, host, qname)
    and fingerprints (name_id, window, host, fp); 0 without evidence. Names and fingerprints
    beyond the first of a cell neither count nor teach."""
    own, seen = sampled(names, "qname"), sampled(prints, "fp")
    cells = name_stats(own)
    rare = own.join(causal_surprisal(own).select("name_id", "surprisal"), "name_id").groupBy("window", "host").agg(F.avg("surprisal").alias("qname_bigram_rarity"))
    tls = seen.join(rarity(seen).select("window", "fp", "rarity", "novel"), ["window", "fp"]).groupBy("window", "host").agg(F.count("*").alias("tls_count"), F.avg("rarity").alias("tls_fp_rarity"), F.avg(F.col("novel").cast("double")).alias("tls_fp_novel"))
    out = cells.join(rare, ["window", "host"], "full_outer").join(tls, ["window", "host"], "full_outer")
    return out.select("window", "host", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"hw_src_{c}") for c in out.columns if c not in ("window", "host")))
