import hashlib
import random
import struct

from netloom.functions import wire as W
from netloom.sources import pcap as P


def dns(name, flags=0x0100):
    q = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"
    return struct.pack("!6H", 7, flags, 1, 0, 0, 0) + q + struct.pack("!2H", 1, 1)


def client_hello(grease=True, sni=True, record=True):
    ciphers = ([0x1A1A] if grease else []) + [0x1302, 0x1301, 0xC02F]
    ext = lambda k, b: struct.pack("!2H", k, len(b)) + b
    u16s = lambda xs: b"".join(struct.pack("!H", x) for x in xs)
    es = (ext(0x2A2A, b"") if grease else b"") + (ext(0, b"\0\x05\0\0\x02ab") if sni else b"")
    es += ext(10, struct.pack("!H", 4) + u16s([29, 23])) + ext(11, b"\1\0") + ext(13, struct.pack("!H", 4) + u16s([0x0403, 0x0804]))
    es += ext(16, b"\0\x03\x02h2") + ext(43, b"\x04" + u16s([0x0304, 0x0303]))
    body = struct.pack("!H", 0x0303) + bytes(32) + b"\0" + struct.pack("!H", 2 * len(ciphers)) + u16s(ciphers) + b"\1\0" + struct.pack("!H", len(es)) + es
    hs = b"\1" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack("!H", len(hs)) + hs if record else hs


def test_dns():
    assert W.dns_qname(dns("WWW.Example.com")) == "www.example.com"
    assert W.dns_qname(struct.pack("!H", 33) + dns("www.example.com"), tcp=True) == "www.example.com"
    assert W.dns_qname(dns("a.b", 0x8180)) is None and W.dns_qname(b"") is None and W.dns_qname(dns("a.b")[:14]) is None
    loop = struct.pack("!6H", 7, 0, 1, 0, 0, 0) + b"\xc0\x0c" + bytes(4)
    assert W.dns_qname(loop) is None


def test_ja3_and_ja4():
    want = "771,4866-4865-49199,0-10-11-13-16-43,29-23,0"
    assert W.ja3_string(W.hello(client_hello())) == want == W.ja3_string(W.hello(client_hello(grease=False)))
    assert W.ja3(client_hello()) == hashlib.md5(want.encode()).hexdigest()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    assert W.ja4(W.hello(client_hello())) == f"t13d0306h2_{h('1301,1302,c02f')}_{h('000a,000b,000d,002b_0403,0804')}"
    assert W.ja4(W.hello(client_hello(sni=False)))[3] == "i"
    for cut in range(len(client_hello()) - 1):
        assert W.hello(client_hello()[:cut]) is None


def test_random_bytes():
    for seed in range(24):
        r = random.Random(seed)
        for _ in range(40):
            d = r.randbytes(r.randrange(200))
            W.dns_qname(d), W.ja3(d), W.quic_initial(d), W.crypto_frames(d), W.ja3(b"\x16\x03\x01" + d)
            W.quic_initial(b"\xc0\0\0\0\1" + d)
            list(P.Decoder().packets(b"\xd4\xc3\xb2\xa1" + bytes(16) + b"\1\0\0\0" + d))


def test_quic_vectors():
    # RFC 9001 appendix A
    dcid = bytes.fromhex("8394c8f03e515708")
    key, iv, hp = W.initial_keys(W.QUIC_V1, dcid)
    assert (key.hex(), iv.hex(), hp.hex()) == ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")
    assert W.Aes128(hp).block(bytes.fromhex("d1b1c98dd7689fb8ec11d242b123dc9b"))[:5].hex() == "437b9aec36"
    for text, n in (("c2197c5eff14e88c", 151288809941952652), ("9d7f3e7d", 494878333), ("7bbd", 15293), ("25", 37)):
        assert W.varint(W.Reader(bytes.fromhex(text))) == n
    # SP 800-38A and the GCM specification's case 4
    aes = W.Aes128(bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"))
    assert aes.block(bytes.fromhex("6bc1bee22e409f96e93d7e117393172a")).hex() == "3ad77bb40d7a3660a89ecaf32466ef97"
    gcm = W.Aes128(bytes.fromhex("feffe9928665731c6d6a8f9467308308"))
    sealed = bytes.fromhex("42831ec2217774244b7221b784d0d49ce3aa212f2c02a4e035c17e2329aca12e21d514b25466931c7d8f6a5aac84aa051ba30b396a0aac973d58e091" + "5bc94fbc3221a5db94fae95ae7121a47")
    plain = gcm.open_gcm(bytes.fromhex("cafebabefacedbaddecaf888"), sealed, bytes.fromhex("feedfacedeadbeeffeedfacedeadbeefabaddad2"))
    assert plain.hex().startswith("d9313225f88406e5a55909c5aff5269a") and len(plain) == 60
    assert gcm.open_gcm(bytes(12), sealed, b"") is None


def quic_packet(data, dcid=bytes.fromhex("8394c8f03e515708")):
    """A sealed Initial: GCM is its own inverse but for the tag, which is made here."""
    key, iv, hp = W.initial_keys(W.QUIC_V1, dcid)
    frame = b"\x06\0" + struct.pack("!H", 0x4000 | len(data)) + data
    frame += bytes(max(0, 60 - len(frame)))
    head = b"\xc0\0\0\0\1\x08" + dcid + b"\0\0" + struct.pack("!H", 0x4000 | (1 + len(frame) + 16))
    header = head + b"\0"
    aes = W.Aes128(key)
    stream = b"".join(aes.block(iv + struct.pack("!I", 2 + i)) for i in range((len(frame) + 15) // 16))
    sealed = bytes(a ^ b for a, b in zip(frame, stream))
    h, y, pad = int.from_bytes(aes.block(bytes(16)), "big"), 0, lambda x: x + bytes(-len(x) % 16)
    for text in (pad(header), pad(sealed), struct.pack("!QQ", 8 * len(header), 8 * len(sealed))):
        for i in range(0, len(text), 16):
            y = W._gf_times(y ^ int.from_bytes(text[i : i + 16], "big"), h)
    tag = bytes(a ^ b for a, b in zip(y.to_bytes(16, "big"), aes.block(iv + b"\0\0\0\1")))
    body = b"\0" + sealed + tag
    mask = W.Aes128(hp).block(body[4:20])
    return bytes([0xC0 ^ mask[0] & 0x0F]) + head[1:] + bytes([body[0] ^ mask[1]]) + body[1:]


def test_quic_round_trip():
    data = client_hello(record=False)
    dcid, parts = W.quic_initial(quic_packet(data))
    assert parts == [(0, data)] and W.ja4(W.hello(parts[0][1], record=False), "q").startswith("q13d")


def frame(payload, proto=17, sport=4000, dport=53, flags=24, seq=0, vlan=False, src=b"\x0a\0\0\1"):
    t = struct.pack("!4H", sport, dport, 8 + len(payload), 0) if proto == 17 else struct.pack("!2H2I2B3H", sport, dport, seq, 0, 0x50, flags, 0, 0, 0)
    ip = struct.pack("!2B3H2BH", 0x45, 0, 20 + len(t) + len(payload), 0, 0, 64, proto, 0) + src + b"\x0a\0\1\2"
    return bytes(12) + (b"\x81\0\0\1" if vlan else b"") + b"\x08\0" + ip + t + payload


def pcap(fs, order="<", magic=0xA1B2C3D4, link=1, unit=1):
    out = struct.pack(order + "I2H4I", magic, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(fs):
        out += struct.pack(order + "4I", 100 + i, 250_000 * unit, len(f), len(f)) + f
    return out


def pcapng(fs, order="<"):
    block = lambda k, b: struct.pack(order + "2I", k, 12 + len(b) + -len(b) % 4) + b + bytes(-len(b) % 4) + struct.pack(order + "I", 12 + len(b) + -len(b) % 4)
    out = block(0x0A0D0D0A, struct.pack(order + "I2Hq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "2HI", 1, 0, 0) + struct.pack(order + "2H", 9, 1) + b"\x09\0\0\0")
    for i, f in enumerate(fs):
        t = (100 + i) * 10**9 + 250_000_000
        out += block(6, struct.pack(order + "5I", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_files(spark, tmp_path):
    hello = client_hello()
    fs = [frame(dns("a.example.com")), frame(dns("b.example.com"), vlan=True), frame(hello[60:], 6, 5000, 443, seq=1060), frame(hello[:60], 6, 5000, 443, seq=1000), frame(b"", 6, 5000, 443, flags=2), b"\0" * 20, frame(quic_packet(client_hello(record=False)), dport=443)]
    want = None
    for i, data in enumerate([pcap(fs), pcap(fs, ">"), pcap(fs, magic=0xA1B23C4D, unit=1000), pcapng(fs), pcapng(fs, ">")]):
        d = P.Decoder("10.0.0.")
        rows = [{k: v for k, v in p.items()} for p in d.packets(data)]
        want = want or rows
        assert rows == want and d.stats.packets == 6 and d.stats.unsupported == 1
        (tmp_path / f"{i}.pcap").write_bytes(data)
    assert [r["dns_qname"] for r in want[:2]] == ["a.example.com", "b.example.com"] and want[0]["direction"] == 1
    assert want[5]["tls_fp"].startswith("q13d")
    halves = pcap([frame(hello[:60], 6, 5000, 443, seq=1000), frame(hello[60:], 6, 5000, 443, seq=1060)])
    assert [p["tls_fp"] for p in P.Decoder().packets(halves)] == [None, W.ja4(W.hello(hello))]
    assert [p["tls_fp"] for p in P.Decoder(fingerprint="ja3").packets(halves)] == [None, W.ja3(hello)]
    # one client over both transports differs in the first letter alone
    assert W.ja4(W.hello(hello))[1:] == want[5]["tls_fp"][1:]
    d = P.Decoder()
    assert len(list(d.packets(pcap(fs)[:-5]))) == 5 and d.stats.truncated == 1
    (tmp_path / "x.pcap").write_bytes(b"")
    (tmp_path / "y.pcap").write_bytes(b"no capture at all")
    df = P.read(spark, str(tmp_path / "*.pcap"), "10.0.0.")
    assert df.count() == 30 and df.select("ts").distinct().count() == 6
    assert P.stats(spark, str(tmp_path / "*.pcap")).where("packets = 0").count() == 1  # Spark lists no empty file


def test_ipv6_and_odd_names():
    assert P.ipv6_text(bytes.fromhex("20010db8000000000000000000000a01")) == "2001:db8:0:0:0:0:0:a01"
    udp = struct.pack("!4H", 4000, 53, 0, 0) + dns("a.example.com")
    ends = bytes.fromhex("fe80" + "00" * 13 + "01" + "20010db8" + "00" * 11 + "02")
    six = bytes(12) + b"\x86\xdd" + struct.pack("!IH2B", 6 << 28, len(udp), 17, 64) + ends + udp
    (p,) = P.Decoder("fe80:0:").packets(pcap([six]))
    assert (p["src_ip"], p["dst_ip"], p["dns_qname"], p["direction"]) == ("fe80:0:0:0:0:0:0:1", "2001:db8:0:0:0:0:0:2", "a.example.com", 1)
    name = b"\x04\xe9\xffAb\x03com\0"
    query = struct.pack("!6H", 7, 0x0100, 1, 0, 0, 0) + name + struct.pack("!2H", 1, 1)
    assert W.dns_qname(query) == "\\xe9\\xffab.com"
