"""Packets from capture files: pcap and pcapng, decoded in parallel, a file a task.

Spark lists and opens the files, so any store that it reads will do. TCP and QUIC handshakes
that span packets are put together within their file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.wire import Hello, Pieces, dns_qname, hello, ja3_string, ja4, looks_like_quic, quic_initial
from netloom.schema import PACKET

# Fixed values of the formats.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
NG_MAGIC, NG_ORDER = 0x0A0D0D0A, 0x1A2B3C4D
ETHERNET, NULL, RAW, RAW_OLD, SLL, SLL2 = 1, 0, 101, 12, 113, 276
MOST_BYTES = 262_144
#: IPv6 headers that are passed over: hop by hop, routing, destination options, mobility, HIP, shim6.
SKIPPED = {0, 43, 60, 135, 139, 140}


@dataclass
class Stats:
    frames: int = 0
    packets: int = 0
    truncated: int = 0
    unsupported: int = 0
    fragments: int = 0
    undated: int = 0


def frames(data: bytes, stats: Stats) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(link type, microseconds, original length, bytes) of each frame; what isn't a capture has none."""
    if data[:4] in MAGICS:
        yield from _pcap(data, *MAGICS[data[:4]], stats)
    elif len(data) >= 12 and struct.unpack("<I", data[:4])[0] == NG_MAGIC:
        yield from _pcapng(data, stats)


def _pcap(data: bytes, order: str, ticks: int, stats: Stats) -> Iterator[tuple[int, int | None, int, bytes]]:
    if len(data) < 24:
        stats.truncated += 1
        return
    link, at = struct.unpack(order + "I", data[20:24])[0] & 0xFFFF, 24
    while at < len(data):
        if at + 16 > len(data):
            stats.truncated += 1
            return
        seconds, part, held, size = struct.unpack(order + "4I", data[at : at + 16])
        if held > MOST_BYTES or at + 16 + held > len(data):
            stats.truncated += 1
            return
        yield link, seconds * 10**6 + part * 10**6 // ticks, size, data[at + 16 : at + 16 + held]
        at += 16 + held


def _pcapng(data: bytes, stats: Stats) -> Iterator[tuple[int, int | None, int, bytes]]:
    order, links, at = "<", [], 0
    while at + 12 <= len(data):
        if struct.unpack("<I", data[at : at + 4])[0] == NG_MAGIC:
            order = "<" if struct.unpack("<I", data[at + 8 : at + 12])[0] == NG_ORDER else ">"
            links = []
        kind, size = struct.unpack(order + "2I", data[at : at + 8])
        if size < 12 or size % 4 or at + size > len(data):
            stats.truncated += 1
            return
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == 1 and len(body) >= 8:
            links.append((struct.unpack(order + "H", body[:2])[0], _ticks(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            n, high, low, held, original = struct.unpack(order + "5I", body[:20])
            if n < len(links) and held <= len(body) - 20:
                yield links[n][0], (high << 32 | low) * 10**6 // links[n][1], original, body[20 : 20 + held]
        elif kind == 3 and len(body) >= 4 and links:
            original = struct.unpack(order + "I", body[:4])[0]
            stats.undated += 1  # simple blocks have no time
            yield links[0][0], None, original, body[4 : 4 + original]


def _ticks(options: bytes, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, n = struct.unpack(order + "2H", options[at : at + 4])
        if code == 0:
            break
        if code == 9 and n >= 1:
            r = options[at + 4]
            return 2 ** (r & 0x7F) if r & 0x80 else 10**r
        at += 4 + (n + 3) // 4 * 4
    return 10**6


def network(link: int, d: bytes) -> tuple[int, int] | None:
    """(ether type, offset) of the network header."""
    if link == ETHERNET and len(d) >= 14:
        kind, at = int.from_bytes(d[12:14], "big"), 14
        for _ in range(3):
            if kind not in (0x8100, 0x88A8, 0x9100) or len(d) < at + 4:
                break
            kind, at = int.from_bytes(d[at + 2 : at + 4], "big"), at + 4
        return kind, at
    if link == SLL and len(d) >= 16:
        return int.from_bytes(d[14:16], "big"), 16
    if link == SLL2 and len(d) >= 20:
        return int.from_bytes(d[:2], "big"), 20
    if link == NULL and len(d) >= 5:
        return {4: 0x0800, 6: 0x86DD}.get(d[4] >> 4, 0), 4
    if link in (RAW, RAW_OLD) and d:
        return {4: 0x0800, 6: 0x86DD}.get(d[0] >> 4, 0), 0
    return None


def ipv6_text(address: bytes) -> str:
    """Eight groups in hexadecimal, without leading zeros and without a shortened run."""
    return ":".join(f"{group:x}" for group in struct.unpack("!8H", address))


class Decoder:
    """Frames of one file to packets; holds the handshakes that are not whole yet."""

    def __init__(self, internal: str = "", label: str = "benign", fingerprint: str = "ja4"):
        if fingerprint not in ("ja3", "ja4"):
            raise ValueError(f"no such fingerprint: {fingerprint}")
        self.internal, self.label, self.kind, self.stats = internal, label, fingerprint, Stats()
        self.tls: dict[tuple, tuple[int, Pieces]] = {}
        self.quic: dict[bytes, Pieces] = {}

    def packets(self, data: bytes) -> Iterator[dict]:
        for link, us, size, d in frames(data, self.stats):
            self.stats.frames += 1
            p = self._packet(link, d)
            if p:
                index = self.stats.packets
                self.stats.packets += 1
                out = p["src_ip"].startswith(self.internal)
                yield p | {"index": index, "ts": None if us is None else pd.Timestamp(us, unit="us"), "size": size, "direction": 1 if out else -1, "label": self.label}

    def _packet(self, link: int, d: bytes) -> dict | None:
        found = network(link, d)
        if not found or found[0] not in (0x0800, 0x86DD):
            self.stats.unsupported += 1
            return None
        kind, at = found
        if kind == 0x0800:
            if len(d) < at + 20 or d[at] >> 4 != 4:
                self.stats.truncated += 1
                return None
            if int.from_bytes(d[at + 6 : at + 8], "big") & 0x1FFF:
                self.stats.fragments += 1
                return None
            ends = [".".join(map(str, d[at + k : at + k + 4])) for k in (12, 16)]
            ttl, proto, end = d[at + 8], d[at + 9], at + int.from_bytes(d[at + 2 : at + 4], "big")
            at += (d[at] & 15) * 4
            d = d[: max(end, at)] if end > at else d
        else:
            if len(d) < at + 40 or d[at] >> 4 != 6:
                self.stats.truncated += 1
                return None
            ends = [ipv6_text(d[at + k : at + k + 16]) for k in (8, 24)]
            ttl, proto, at = d[at + 7], d[at + 6], at + 40
            for _ in range(8):
                if proto not in SKIPPED or len(d) < at + 8:
                    break
                proto, at = d[at], at + 8 * (d[at + 1] + 1)
            if proto == 44:
                self.stats.fragments += 1
                return None
        return self._transport(d, at, proto, *ends, ttl)

    def _transport(self, d: bytes, at: int, proto: int, src: str, dst: str, ttl: int) -> dict | None:
        out = {"src_ip": src, "dst_ip": dst, "src_port": 0, "dst_port": 0, "proto": {6: "tcp", 17: "udp", 1: "icmp", 58: "icmp"}.get(proto, str(proto)), "flags": 0, "ttl": ttl, "dns_qname": None, "tls_fp": None}
        if proto not in (6, 17):
            return out
        if len(d) < at + (20 if proto == 6 else 8):
            self.stats.truncated += 1
            return None
        sport, dport = struct.unpack("!2H", d[at : at + 4])
        out |= {"src_port": sport, "dst_port": dport}
        if proto == 17:
            payload = d[at + 8 :]
            if 53 in (sport, dport):
                out["dns_qname"] = dns_qname(payload)
            elif looks_like_quic(payload):
                out["tls_fp"] = self._quic(payload)
            return out
        seq, flags = int.from_bytes(d[at + 4 : at + 8], "big"), d[at + 13]
        out["flags"] = flags & 0x3F
        payload = d[at + 4 * (d[at + 12] >> 4) :]
        if payload and 53 in (sport, dport):
            out["dns_qname"] = dns_qname(payload, tcp=True)
        elif payload:
            out["tls_fp"] = self._tls((src, sport, dst, dport), seq, payload)
        return out

    def _tls(self, key: tuple, seq: int, payload: bytes) -> str | None:
        """The client's fingerprint once its hello is whole."""
        if key not in self.tls:
            if payload[:2] != b"\x16\x03":
                return None
            if len(self.tls) >= Pieces.PARTS:
                self.tls.pop(next(iter(self.tls)))
            self.tls[key] = (seq, Pieces())
        start, pieces = self.tls[key]
        h = hello(pieces.push((seq - start) & 0xFFFFFFFF, payload))
        if not h:
            return None
        del self.tls[key]
        return self._fingerprint(h, "t")

    def _fingerprint(self, h: Hello, transport: str) -> str:
        """One kind for all transports, so that one client has names that can be counted together."""
        return ja4(h, transport) if self.kind == "ja4" else hashlib.md5(ja3_string(h).encode()).hexdigest()

    def _quic(self, datagram: bytes) -> str | None:
        found = quic_initial(datagram)
        if not found:
            return None
        dcid, parts = found
        if dcid not in self.quic and len(self.quic) >= Pieces.PARTS:
            self.quic.pop(next(iter(self.quic)))
        pieces, whole = self.quic.setdefault(dcid, Pieces()), b""
        for offset, data in parts:
            whole = pieces.push(offset, data)
        h = hello(whole, record=False)
        return self._fingerprint(h, "q") if h else None


_COLUMNS = ["path", *PACKET.fieldNames()]


def _decode(batches: Iterator[pd.DataFrame], *given: str) -> Iterator[pd.DataFrame]:
    """The packets of each file, some ten thousand at a time."""
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            rows = Decoder(*given).packets(bytes(data))
            while some := [p | {"path": path} for p in islice(rows, 1 << 15)]:
                yield pd.DataFrame(some, columns=_COLUMNS)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            decoder = Decoder()
            for _ in decoder.packets(bytes(data)):
                pass
            yield pd.DataFrame([{"path": path} | asdict(decoder.stats)])


def read(spark: SparkSession, path: str, internal: str = "", label: str = "benign", fingerprint: str = "ja4") -> DataFrame:
    """path and PACKET columns of all capture files at `path` (2 GB a file at most); tls_fp is
    a client's JA4, or its JA3 where `fingerprint` says so, over TCP and QUIC alike."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = ", ".join(["path string", *(f"{f.name} {f.dataType.simpleString()}" for f in PACKET.fields)])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _decode(batches, internal, label, fingerprint)

    return files.mapInPandas(decode, fields).where(F.col("ts").isNotNull())


def stats(spark: SparkSession, path: str) -> DataFrame:
    """What was counted in each file: frames, packets, and what could not be used."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_count, "path string, frames long, packets long, truncated long, unsupported long, fragments long, undated long")
