"""Six independent detectors over declared features of a cell, and their ensemble."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The features that each detector may see.
HEADS: dict[str, list[str]] = {
    "ddos": ["hw_dst_n_flows", "hw_dst_n_srcs", "hw_dst_src_entropy", "hw_dst_fwd_pkts", "hw_dst_fwd_bytes", "hw_dst_flows_per_src"],
    "scan": ["hw_src_n_peers", "hw_src_n_dports", "hw_src_fanout_per_flow", "hw_src_n_flows", "hw_src_peer_concentration", "hw_src_fwd_pkts"],
    "beacon": ["hw_src_iat_cv", "hw_src_iat_mean", "hw_src_peer_concentration", "hw_src_n_peers", "hw_src_n_flows", "hw_src_fwd_bytes"],
    "exfil": ["hw_src_fwd_bytes", "hw_src_bytes_vs_baseline", "hw_src_peer_concentration", "hw_src_n_peers", "hw_src_fwd_pkts", "hw_src_n_flows"],
    "dga": ["hw_src_qname_entropy", "hw_src_qname_len_mean", "hw_src_qname_len_max", "hw_src_qname_digit_ratio", "hw_src_qname_bigram_rarity", "hw_src_dns_count", "hw_src_n_flows", "hw_src_peer_concentration", "hw_src_n_peers", "hw_src_fwd_pkts", "hw_src_fwd_bytes", "hw_src_iat_mean"],
    "encrypted": ["hw_src_tls_fp_rarity", "hw_src_tls_fp_novel", "hw_src_tls_count", "hw_src_iat_cv", "hw_src_iat_mean", "hw_src_fwd_bytes", "hw_src_n_peers", "hw_src_peer_concentration", "hw_src_n_flows"],
}


#: What each detector goes by, in words, and whether a one-way sensor leaves it without its best evidence.
MECHANISM = {
    "ddos": ("Many sources, spread evenly, send to one host.", False),
    "scan": ("One host tries many peers or ports, with little sent to each.", False),
    "beacon": ("Contacts of one host come at regular times, mostly to one peer.", False),
    "exfil": ("A host sends far more than it has before.", False),
    "dga": ("Looked-up names have rare pairs of letters; answers are not seen.", True),
    "encrypted": ("A client's handshake is rare or new; what it sends is not seen.", True),
}


class Head:
    """One class's detector: fits on its features alone, those the table has."""

    def __init__(self, threat: str, threshold: float = 0.5, only: list[str] | None = None, trees: int = 180, depth: int = 5):
        self.threat, self.threshold, self.trees, self.depth = threat, threshold, trees, depth
        self.features = [f for f in HEADS[threat] if only is None or f in only]
        self.model = None

    def fit(self, rows: DataFrame, label: str) -> Head:
        self.used = [f for f in self.features if f in rows.columns]
        if not self.used:
            raise ValueError(f"no feature of {self.threat} is in the table")
        gbt = GBTClassifier(featuresCol="v", labelCol="y", maxIter=self.trees, maxDepth=self.depth, stepSize=0.15, subsamplingRate=0.9, seed=0)
        own = rows.select(*self.used, F.col(label).cast("double").alias("y"))
        self.model = Pipeline(stages=[VectorAssembler(inputCols=self.used, outputCol="v", handleInvalid="keep"), gbt]).fit(own)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows` with p_<threat>."""
        out = self.model.transform(rows)
        return out.withColumn(f"p_{self.threat}", vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction")

    def top_features(self, k: int = 3) -> list[tuple[str, float]]:
        gain = self.model.stages[-1].featureImportances.toArray()
        return sorted(zip(self.used, gain.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]

    def explain(self) -> str:
        return f"{self.threat}: " + ", ".join(f"{n} ({g:.2f})" for n, g in self.top_features())


def build_heads(threshold: float = 0.5, restrict: list[str] | None = None, every: list[str] | None = None, trees: int = 180, depth: int = 5) -> list[Head]:
    """All six detectors; `restrict` leaves only those of their features, `every` gives each of
    them all the features named."""
    heads = [Head(threat, threshold, restrict, trees, depth) for threat in HEADS]
    for h in heads:
        h.features = list(every) if every else h.features
    return heads


def roster(spark: SparkSession) -> DataFrame:
    """(threat_class, rationale, declared_features, known_gap) of each detector."""
    rows = [(t, *MECHANISM[t][:1], HEADS[t], MECHANISM[t][1]) for t in HEADS]
    return spark.createDataFrame(rows, "threat_class string, rationale string, declared_features array<string>, known_gap boolean")


class Multiclass:
    """One model for all classes, which gives a cell one label: what detectors are held against."""

    def __init__(self, classes: list[str], features: list[str], trees: int = 180, depth: int = 5):
        self.classes, self.features, self.trees, self.depth = classes, features, trees, depth

    def fit(self, rows: DataFrame, label: str) -> Multiclass:
        """`label` names one of the classes."""
        y = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)) - 1
        forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=self.trees, maxDepth=self.depth, subsamplingRate=0.9, seed=0)
        own = rows.select(*self.features, y.cast("double").alias("y")).where("y >= 0")
        self.model = Pipeline(stages=[VectorAssembler(inputCols=self.features, outputCol="v", handleInvalid="keep"), forest]).fit(own)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows` with probs, an entry a class that training has seen, and predicted, its number."""
        out = self.model.transform(rows).withColumn("probs", vector_to_array("probability"))
        return out.withColumn("predicted", F.col("prediction").cast("int")).drop("v", "rawPrediction", "probability", "prediction")


class Ensemble:
    def __init__(self, heads: list[Head]):
        self.heads = heads

    def fit(self, rows: DataFrame, labels: dict[str, str]) -> Ensemble:
        for h in self.heads:
            h.fit(rows, labels[h.threat])  # a missing label is a KeyError
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, h: h.score(df), self.heads, rows)

    def fired(self) -> Column:
        """The classes over their thresholds, surest first."""
        own = [F.when(F.col(f"p_{h.threat}") >= h.threshold, F.struct((-F.col(f"p_{h.threat}")).alias("p"), F.lit(h.threat).alias("t"))) for h in self.heads]
        return F.transform(F.array_sort(F.array_compact(F.array(*own))), lambda x: x["t"])


def rule_class() -> Column:
    """A class by plain thresholds over a cell, where no model is trained."""
    return (
        F.when(F.col("hw_src_bytes_vs_baseline") > 50, "exfil")
        .when(F.col("hw_src_n_dports") >= 7, "scan")
        .when((F.col("hw_src_iat_cv") > 0) & (F.col("hw_src_iat_cv") < 0.5), "beacon")
        .when(F.col("hw_dst_src_entropy") > 5.0, "ddos")
        .otherwise("benign")
    )
