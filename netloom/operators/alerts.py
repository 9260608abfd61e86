"""Severity, the hash-chained alert log, its check, and read-only queries over it."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ordered import bucketed, numbered
from netloom.schema import ALERT

# How far an intrusion of a class has come, bytes at which volume counts in
# full, the share that counts without volume, and the bands.
STAGE = {"benign": 0.0, "scan": 0.20, "dga": 0.40, "beacon": 0.60, "encrypted": 0.60, "ddos": 0.70, "exfil": 1.00}
SATURATION = {"exfil": 3_340_640.0, "encrypted": 3_371.0}
FLOOR = 0.6
BANDS = [(0.80, "critical"), (0.60, "high"), (0.40, "medium"), (0.20, "low"), (0.00, "info")]
SEPARATOR, GENESIS = "\x1f", "0" * 64
HASHED = ["seq", "alert_id", "ts", "window", "host", "threat_class", "score", "confidence", "decision", "model_hash", "feature_hash", "prev_hash"]


def severity(threat: Column, src_bytes: Column, dst_bytes: Column) -> Column:
    """struct(score, level, driver). Volume counts for some classes; absent (null, NaN) bytes
    leave the stage's weight whole, zero bytes leave its floor."""
    impact = reduce(lambda a, kv: a.when(threat == kv[0], kv[1]), STAGE.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    full = reduce(lambda a, kv: a.when(threat == kv[0], kv[1]), SATURATION.items(), F.when(F.lit(False), 0.0))
    s, d = (F.when(~F.isnan(x), x) for x in (src_bytes.cast("double"), dst_bytes.cast("double")))
    best = F.greatest(s, d)
    volume = F.greatest(F.lit(0.0), F.least(F.lit(1.0), best / full))
    score = F.when(full.isNull() | best.isNull(), impact).otherwise(impact * (FLOOR + (1 - FLOOR) * volume))
    level = reduce(lambda a, b: a.when(score >= b[0], b[1]), BANDS, F.when(F.lit(False), ""))
    driver = F.when(full.isNull() | best.isNull(), "").when(s.isNotNull() & (d.isNull() | (s >= d)), "hw_src_fwd_bytes").otherwise("hw_dst_fwd_bytes")
    return F.struct(score.alias("score"), level.alias("level"), driver.alias("driver"))


def fixed(x: float) -> str:
    """Six decimals by the nearest binary value; -0.0, NaN and infinities as 0."""
    x = float(x)
    return f"{(x if x - x == 0 else 0.0) + 0.0:.6f}"


def feature_digest(features: dict[str, float]) -> str:
    return hashlib.sha256(SEPARATOR.join(f"{k}={fixed(v)}" for k, v in sorted(features.items())).encode()).hexdigest()


def canonical(row: dict, fields: list[str] = HASHED) -> str:
    return SEPARATOR.join(fixed(row[k]) if k in ("ts", "score", "confidence") else str(row[k]) for k in fields)


def signed(text: str, key: bytes) -> tuple[str, str]:
    text = text.encode()
    return hashlib.sha256(text).hexdigest(), hmac.new(key, text, hashlib.sha256).hexdigest() if key else ""


def model_digest(*parts: object) -> str:
    """An identifier of a scoring set-up: its name, parameters, features and classes."""
    return hashlib.sha256("".join(f"{p}{SEPARATOR}" for p in parts).encode()).hexdigest()


def constructed(decided: DataFrame, classes: list[str], seconds: float, path: list[str]) -> DataFrame:
    """Alerts of cells (window, host, predicted, confidence, abstained, features) that a model and
    a conformal decision have gone over: an abstention is an entry whatever its class, a decision
    is one unless it says benign. `predicted` counts in `classes`."""
    threat = F.element_at(F.array(*map(F.lit, classes)), F.col("predicted") + 1)
    decision = F.when(F.col("abstained"), "ABSTAIN").otherwise("ALERT")
    rows = decided.withColumns({"threat_class": threat, "decision": decision}).where("not (decision = 'ALERT' and threat_class = 'benign')")
    return rows.select(
        F.substring(F.sha2(F.concat_ws("|", "window", "host", "threat_class").cast("binary"), 256), 1, 16).alias("alert_id"),
        (F.col("window") * float(seconds)).alias("ts"), "window", "host", "threat_class", F.col("confidence").alias("score"), "confidence", "decision", "features",
        F.create_map(F.lit("window_s"), F.lit(str(seconds)), F.lit("set_size"), F.col("set_size").cast("string")).alias("observed"),
        F.array(*map(F.lit, path), F.concat(F.lit("set_size="), F.col("set_size").cast("string"))).alias("decision_path"),
    )


def _prepared(batches: Iterator[pd.DataFrame], model_hash: str) -> Iterator[pd.DataFrame]:
    """What of an entry depends on its own row only: its features' digest and its text between
    its number and the digest before it."""
    for pdf in batches:
        rows = []
        for row in pdf.to_dict("records"):
            features = {k: float(v) for k, v in (row["features"].items() if isinstance(row["features"], dict) else row["features"] or [])}
            row |= {"window": int(row["window"]), "model_hash": model_hash, "feature_hash": feature_digest(features)}
            rows.append({"number": row["number"], "feature_hash": row["feature_hash"], "text": canonical(row, HASHED[1:-1])})
        yield pd.DataFrame(rows, columns=["number", "feature_hash", "text"])


def _chain(batches: Iterator[pd.DataFrame], key: bytes, head: str, seq: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for number, text in zip(pdf["number"], pdf["text"], strict=True):
            entry, mac = signed(SEPARATOR.join((str(seq + number), text, head)), key)
            rows.append((number, head, entry, mac))
            head = entry
        yield pd.DataFrame(rows, columns=["number", "prev_hash", "entry_hash", "hmac"])


def append(alerts: DataFrame, key: bytes, model_hash: str, head: str = GENESIS, seq: int = 0) -> DataFrame:
    """A log of `alerts` (alert_id, ts, window, host, threat_class, score, confidence, decision,
    features, observed, decision_path), ordered by window, host and id, each entry bound to
    the one before. A chain is sequential by definition: one task takes a short text for each
    alert; numbering, digests of features, texts and severity are parallel."""
    sev = severity(F.col("threat_class"), F.col("features")["hw_src_fwd_bytes"], F.col("features")["hw_dst_fwd_bytes"])
    rows = alerts.withColumn("s", sev).select("alert_id", "ts", "window", "host", "threat_class", "score", "confidence", "decision", "features", "observed", "decision_path", F.col("s.level").alias("severity"), F.col("s.score").alias("severity_score"))
    rows = numbered(rows.persist(), "window", "host", "alert_id").persist()  # alerts are few, and read four times
    fields = ["number", *(c for c in HASHED if c in alerts.columns), "features"]
    texts = rows.select(*fields).mapInPandas(partial(_prepared, model_hash=model_hash), "number long, feature_hash string, text string")
    ordered = texts.select("number", "text").repartition(1).sortWithinPartitions("number")
    links = ordered.mapInPandas(partial(_chain, key=key, head=head, seq=seq), "number long, prev_hash string, entry_hash string, hmac string")
    out = rows.join(texts.drop("text"), "number").join(links, "number")
    out = out.withColumns({"seq": F.col("number") + seq, "window": F.col("window").cast("long"), "model_hash": F.lit(model_hash), "features": F.col("features").cast("map<string,double>")})
    return out.select(*(F.col(f.name).cast(f.dataType) for f in ALERT.fields))


def _recompute(batches: Iterator[pd.DataFrame], key: bytes) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for row in pdf.to_dict("records"):
            features = dict(row["features"]) if row["features"] is not None else {}
            entry, mac = signed(canonical(row), key)
            rows.append({"position": row["position"], "seq": row["seq"], "prev_hash": row["prev_hash"], "recomputed": entry, "entry_ok": entry == row["entry_hash"], "features_ok": feature_digest(features) == row["feature_hash"], "hmac_ok": mac == (row["hmac"] or "")})
        yield pd.DataFrame(rows, columns=["position", "seq", "prev_hash", "recomputed", "entry_ok", "features_ok", "hmac_ok"])


def verify(log: DataFrame, key: bytes) -> DataFrame:
    """(position, seq, link_ok, entry_ok, features_ok, hmac_ok, ok) of each entry. An entry's
    digest depends on its own fields only, so digests are parallel; the order of entries is
    `position`, or seq without it. The link needs the digest before: a lag in buckets of positions."""
    log = log if "position" in log.columns else log.withColumn("position", F.col("seq"))
    own = log.mapInPandas(partial(_recompute, key=key), "position long, seq long, prev_hash string, recomputed string, entry_ok boolean, features_ok boolean, hmac_ok boolean")
    # the entry before is in the same bucket of positions, or the last one of the bucket before
    own = bucketed(own.persist(), "position")  # read for bounds, for each bucket's last, and for the lag
    last = own.groupBy("bucket").agg(F.max_by("recomputed", "position").alias("last"))
    last = last.select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("last"))  # a row a bucket
    before = F.coalesce(F.lag("recomputed").over(Window.partitionBy("bucket").orderBy("position")), F.col("last"), F.lit(GENESIS))
    out = own.join(F.broadcast(last), "bucket").withColumn("link_ok", F.col("prev_hash") == before)
    return out.select("position", "seq", "link_ok", "entry_ok", "features_ok", "hmac_ok", (F.col("link_ok") & F.col("entry_ok") & F.col("features_ok") & F.col("hmac_ok")).alias("ok"))


# ---- queries over a log


def health(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entries")).select(F.when(F.col("entries") > 0, "ok").otherwise("no-log").alias("status"), "entries")


def summary(log: DataFrame) -> DataFrame:
    by_class = log.groupBy("threat_class").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("threat_class", "n")))).alias("by_class"))
    one = log.agg(F.count("*").alias("entries"), F.count_if(F.col("decision") == "ALERT").alias("alerts"), F.count_if(F.col("decision") == "ABSTAIN").alias("abstentions"), F.max_by("entry_hash", "seq").alias("head"), F.min_by("window", "seq").alias("first_window"), F.max_by("window", "seq").alias("last_window"))
    return one.crossJoin(F.broadcast(by_class))


def summary_with_chain(log: DataFrame, key: bytes, problems: int = 10) -> DataFrame:
    """summary() with the model's digest, whether the chain holds, and the first places where it doesn't."""
    bad = verify(log, key).where("not ok").select("position").orderBy("position").limit(problems)
    chain = bad.agg(F.array_sort(F.collect_list("position")).alias("chain_problems"))
    model = log.agg(F.max_by("model_hash", "seq").alias("model_hash"))
    out = summary(log).crossJoin(F.broadcast(model)).crossJoin(F.broadcast(chain))
    return out.withColumn("chain_verified", F.size("chain_problems") == 0)


def page(log: DataFrame, limit: int = 100, offset: int = 0, threat_class: str | None = None, decision: str | None = None) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    if threat_class:
        log = log.where(F.col("threat_class") == threat_class)
    if decision:
        log = log.where(F.col("decision") == decision.upper())
    return log.drop("features").orderBy("seq").offset(offset).limit(limit)


def by_seq(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") == seq)


def snapshot(log: DataFrame, n: int = 400) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def replay(log: DataFrame, start: int = 0) -> Iterator:
    """Entries in order, a partition at a time on the driver."""
    return log.where(F.col("seq") >= start).orderBy("seq").toLocalIterator()


def write_jsonl(log: DataFrame, path: str) -> None:
    """One entry a line in order, keys sorted."""
    lines = log.select("seq", F.to_json(F.struct(*sorted(log.columns))).alias("value"))
    lines.repartition(1).sortWithinPartitions("seq").select("value").write.mode("overwrite").text(path)


def read_jsonl(spark, path: str) -> DataFrame:
    return spark.read.schema(ALERT).json(path)
