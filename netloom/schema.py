"""Record types, threat classes and flag bits."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(text: str) -> StructType:
    kinds = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "ts": TimestampType(), "strings": ArrayType(StringType()), "numbers": MapType(StringType(), DoubleType()), "texts": MapType(StringType(), StringType())}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


PACKET = _struct("index:long ts:ts src_ip:string dst_ip:string src_port:int dst_port:int proto:string size:long flags:int ttl:int direction:int dns_qname:string tls_fp:string label:string")
FLOW = _struct("ts:ts src:string dst:string dport:int fwd_pkts:double fwd_bytes:double qnames:strings tls_fps:strings emit_ts:ts close_reason:string")
ALERT = _struct("seq:long alert_id:string ts:double window:long host:string threat_class:string score:double confidence:double decision:string model_hash:string feature_hash:string prev_hash:string features:numbers observed:texts decision_path:strings severity:string severity_score:double entry_hash:string hmac:string")

# Fixed values.
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
FLAG_NAMES = [(FIN, "FIN"), (SYN, "SYN"), (RST, "RST"), (PSH, "PSH"), (ACK, "ACK"), (URG, "URG")]
FORWARD, REVERSE = 1, -1
THREATS = ["ddos", "scan", "beacon", "exfil", "dga", "encrypted"]
CLASSES = ["benign", *THREATS]

SRC_FEATURES = ["n_flows", "n_peers", "n_dports", "fwd_pkts", "fwd_bytes", "iat_mean", "iat_cv", "fanout_per_flow", "peer_concentration", "bytes_vs_baseline"]
DST_FEATURES = ["n_flows", "n_srcs", "fwd_pkts", "fwd_bytes", "flows_per_src", "src_entropy"]
HOST_FEATURES = [f"hw_src_{x}" for x in SRC_FEATURES] + [f"hw_dst_{x}" for x in DST_FEATURES]
