"""Parsers of DNS and TLS handshakes, and of QUIC Initial packets, over bytes.

All of them return None for what is not whole and well formed: input is adversarial.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from dataclasses import dataclass, field

# Extension numbers, QUIC salts and labels (RFC 8446, 9001, 9369).
SNI, GROUPS, FORMATS, SIGNATURES, ALPN, VERSIONS = 0x0000, 0x000A, 0x000B, 0x000D, 0x0010, 0x002B
QUIC_V1, QUIC_V2 = 0x00000001, 0x6B3343CF
SALTS = {QUIC_V1: bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a"), QUIC_V2: bytes.fromhex("0dede3def700a6db819381be6e269dcbf9bd2ed9")}
LABELS = {QUIC_V1: ("quic key", "quic iv", "quic hp"), QUIC_V2: ("quicv2 key", "quicv2 iv", "quicv2 hp")}
TLS_NAMES = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2"}


class Short(ValueError):
    """Bytes end before what they announce."""


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def block(self, n: int) -> Reader:
        """What a length of n bytes announces."""
        return Reader(self.take(self.number(n)))

    def rest(self) -> int:
        return len(self.data) - self.at

    def numbers(self) -> list[int]:
        return [self.number(2) for _ in range(self.rest() // 2)]


# ---- DNS


def dns_qname(payload: bytes, tcp: bool = False) -> str | None:
    """The first question's name of a query, lower case; None for responses and others."""
    try:
        r = Reader(payload)
        if tcp:
            r = r.block(2)
        _, flags, questions, *_ = struct.unpack("!6H", r.take(12))
        if flags & 0xF800 or questions < 1:
            return None
        name, _ = _name(r.data, r.at)
        return name.lower() or None
    except (Short, struct.error):
        return None


def _name(data: bytes, at: int) -> tuple[str, int]:
    """Labels up to the root. Pointers only go backwards, eight at most; 63 bytes a label, 255 a name, 128 labels."""
    labels, jumps, total, end, floor = [], 0, 0, None, at
    while True:
        if at >= len(data):
            raise Short
        n = data[at]
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(data):
                raise Short
            target = (n & 0x3F) << 8 | data[at + 1]
            jumps += 1
            if target >= floor or jumps > 8:
                raise Short
            end, at, floor = end or at + 2, target, target
            continue
        if n & 0xC0:
            raise Short
        if n == 0:
            return ".".join(labels), end or at + 1
        total += n + 1
        if at + 1 + n > len(data) or total > 255 or len(labels) >= 128:
            raise Short
        labels.append(data[at + 1 : at + 1 + n].decode("ascii", "backslashreplace"))  # junk is a sign, too
        at += 1 + n


# ---- TLS


def is_grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


@dataclass
class Hello:
    version: int
    ciphers: list[int]
    extensions: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    formats: list[int] = field(default_factory=list)
    signatures: list[int] = field(default_factory=list)
    versions: list[int] = field(default_factory=list)
    alpn: list[bytes] = field(default_factory=list)
    sni: bool = False


def hello(payload: bytes, client: bool = True, record: bool = True) -> Hello | None:
    """A ClientHello or ServerHello, from its record or (QUIC) from the bare handshake."""
    try:
        r = Reader(payload)
        if record:
            if r.number(1) != 22 or r.number(1) != 3:
                return None
            r.take(1)
            r = r.block(2)
        if r.number(1) != (1 if client else 2):
            return None
        r = r.block(3)
        version = r.number(2)
        r.take(32)
        r.block(1)
        if client:
            out = Hello(version, r.block(2).numbers())
            r.block(1)
        else:
            out = Hello(version, [r.number(2)])
            r.take(1)
        if r.rest():
            e = r.block(2)
            while e.rest():
                kind, body = e.number(2), e.block(2)
                out.extensions.append(kind)
                _extension(out, kind, body, client)
        return out
    except Short:
        return None


def _extension(out: Hello, kind: int, body: Reader, client: bool) -> None:
    if kind == SNI:
        out.sni = True
    elif kind == GROUPS:
        out.groups = body.block(2).numbers()
    elif kind == FORMATS:
        out.formats = list(body.block(1).data)
    elif kind == SIGNATURES:
        out.signatures = body.block(2).numbers()
    elif kind == VERSIONS:
        out.versions = body.block(1).numbers() if client else body.numbers()
    elif kind == ALPN:
        names = body.block(2)
        while names.rest():
            out.alpn.append(names.block(1).data)


def ja3_string(h: Hello, client: bool = True) -> str:
    parts = [[h.version], h.ciphers, h.extensions, *([h.groups, h.formats] if client else [])]
    return ",".join("-".join(str(v) for v in p if not is_grease(v)) for p in parts)


def ja3(payload: bytes, client: bool = True) -> str | None:
    h = hello(payload, client)
    return hashlib.md5(ja3_string(h, client).encode()).hexdigest() if h else None


def _short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12] if text else "0" * 12


def ja4(h: Hello, transport: str = "t") -> str:
    """Transport, version, SNI, counts and ALPN; a hash of sorted ciphers; one of sorted extensions and signatures in order."""
    real = lambda xs: [x for x in xs if not is_grease(x)]
    version = TLS_NAMES.get(max(real(h.versions), default=h.version), "00")
    ciphers, extensions = real(h.ciphers), real(h.extensions)
    first = h.alpn[0] if h.alpn and h.alpn[0] else b""
    ends = (first[:1] + first[-1:]).decode("latin1")
    alpn = "00" if not first else ends if all(c.isascii() and c.isalnum() for c in ends) else first.hex()[0] + first.hex()[-1]
    head = f"{transport}{version}{'d' if h.sni else 'i'}{min(len(ciphers), 99):02d}{min(len(extensions), 99):02d}{alpn}"
    own = ",".join(sorted(f"{x:04x}" for x in extensions if x not in (SNI, ALPN)))
    signatures = ",".join(f"{x:04x}" for x in real(h.signatures))
    return f"{head}_{_short_hash(','.join(sorted(f'{x:04x}' for x in ciphers)))}_{_short_hash(f'{own}_{signatures}' if own and signatures else own)}"


# ---- QUIC


def varint(r: Reader) -> int:
    first = r.number(1)
    n = 1 << (first >> 6)
    return int.from_bytes(bytes([first & 0x3F]) + r.take(n - 1), "big")


def hkdf_extract(salt: bytes, key: bytes) -> bytes:
    return hmac.new(salt, key, hashlib.sha256).digest()


def hkdf_expand_label(secret: bytes, label: str, n: int) -> bytes:
    name = b"tls13 " + label.encode()
    info = struct.pack("!HB", n, len(name)) + name + b"\0"
    out, block = b"", b""
    while len(out) < n:
        block = hmac.new(secret, block + info + bytes([len(out) // 32 + 1]), hashlib.sha256).digest()
        out += block
    return out[:n]


def initial_keys(version: int, dcid: bytes) -> tuple[bytes, bytes, bytes]:
    """The client's key, iv and header key of an Initial packet."""
    secret = hkdf_expand_label(hkdf_extract(SALTS[version], dcid), "client in", 32)
    key, iv, hp = LABELS[version]
    return hkdf_expand_label(secret, key, 16), hkdf_expand_label(secret, iv, 12), hkdf_expand_label(secret, hp, 16)


def _sbox() -> bytes:
    """Inverses in GF(2**8) under the affine map, by the powers of 3."""
    out, p, q = bytearray(256), 1, 1
    while True:
        p = p ^ (p << 1 & 0xFF) ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 0xFF
        if q & 0x80:
            q ^= 0x09
        x = q | q << 8
        out[p] = (q ^ x >> 7 ^ x >> 6 ^ x >> 5 ^ x >> 4) & 0xFF ^ 0x63
        if p == 1:
            break
    out[0] = 0x63
    return bytes(out)


_BOX = _sbox()


def _times2(x: int) -> int:
    return (x << 1 ^ (0x1B if x & 0x80 else 0)) & 0xFF


class Aes128:
    """AES-128 encryption of single blocks, and GCM decryption with it (FIPS 197, SP 800-38D)."""

    def __init__(self, key: bytes):
        words, rcon = [key[i : i + 4] for i in range(0, 16, 4)], 1
        for i in range(4, 44):
            w = words[-1]
            if i % 4 == 0:
                w = bytes(_BOX[b] for b in w[1:] + w[:1])
                w, rcon = bytes([w[0] ^ rcon]) + w[1:], _times2(rcon)
            words.append(bytes(a ^ b for a, b in zip(words[-4], w, strict=True)))
        self.keys = [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]

    def block(self, data: bytes) -> bytes:
        s = [a ^ b for a, b in zip(data, self.keys[0], strict=True)]
        for turn in range(1, 11):
            s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if turn < 10:
                mixed = []
                for c in range(0, 16, 4):
                    a = s[c : c + 4]
                    whole = a[0] ^ a[1] ^ a[2] ^ a[3]
                    mixed += [a[i] ^ whole ^ _times2(a[i] ^ a[(i + 1) % 4]) for i in range(4)]
                s = mixed
            s = [a ^ b for a, b in zip(s, self.keys[turn], strict=True)]
        return bytes(s)

    def open_gcm(self, nonce: bytes, sealed: bytes, aad: bytes) -> bytes | None:
        """The plain text, or None if the tag doesn't hold."""
        if len(sealed) < 16:
            return None
        data, tag = sealed[:-16], sealed[-16:]
        h = int.from_bytes(self.block(bytes(16)), "big")
        pad = lambda x: x + bytes(-len(x) % 16)
        y = 0
        for text in (pad(aad), pad(data), struct.pack("!QQ", 8 * len(aad), 8 * len(data))):
            for i in range(0, len(text), 16):
                y = _gf_times(y ^ int.from_bytes(text[i : i + 16], "big"), h)
        mask = self.block(nonce + b"\0\0\0\1")
        if not hmac.compare_digest(bytes(a ^ b for a, b in zip(y.to_bytes(16, "big"), mask, strict=True)), tag):
            return None
        stream = b"".join(self.block(nonce + struct.pack("!I", 2 + i)) for i in range((len(data) + 15) // 16))
        return bytes(a ^ b for a, b in zip(data, stream, strict=False))


def _gf_times(x: int, y: int) -> int:
    z, v = 0, y
    for i in range(127, -1, -1):
        if x >> i & 1:
            z ^= v
        v = v >> 1 ^ (0xE1 << 120 if v & 1 else 0)
    return z


def quic_initial(datagram: bytes) -> tuple[bytes, list[tuple[int, bytes]]] | None:
    """(connection id, CRYPTO frames as (offset, data)) of a client's Initial packet."""
    try:
        r = Reader(datagram)
        first, version = r.number(1), r.number(4)
        kind = first >> 4 & 3
        if first & 0xC0 != 0xC0 or version not in SALTS or kind != (0 if version == QUIC_V1 else 1):
            return None
        dcid = r.block(1).data
        r.block(1)
        r.take(varint(r))
        length, at = varint(r), r.at
        if len(dcid) > 20 or length < 20 or r.rest() < length:
            return None
        key, iv, hp = initial_keys(version, dcid)
        mask = Aes128(hp).block(datagram[at + 4 : at + 20])
        first ^= mask[0] & 0x0F
        n = (first & 3) + 1
        number = bytes(a ^ b for a, b in zip(datagram[at : at + n], mask[1:], strict=False))
        header = bytes([first]) + datagram[1:at] + number
        nonce = (int.from_bytes(iv, "big") ^ int.from_bytes(number, "big")).to_bytes(12, "big")
        plain = Aes128(key).open_gcm(nonce, datagram[at + n : at + length], header)
        return None if plain is None else (dcid, crypto_frames(plain))
    except Short:
        return None


def crypto_frames(plain: bytes) -> list[tuple[int, bytes]]:
    """(offset, data) of CRYPTO frames; padding, pings and acks are passed over, others end it."""
    r, out = Reader(plain), []
    try:
        while r.rest():
            kind = varint(r)
            if kind in (0, 1):
                continue
            if kind in (2, 3):
                varint(r), varint(r)
                ranges = varint(r)
                for _ in range(1 + 2 * ranges + 3 * (kind == 3)):
                    varint(r)
            elif kind == 6:
                offset = varint(r)
                out.append((offset, r.take(varint(r))))
            else:
                break
    except Short:
        pass
    return out


class Pieces:
    """Bytes of a stream that come in pieces, out of order and more than once."""

    MOST, PARTS = 16_384, 4096

    def __init__(self):
        self.parts: dict[int, bytes] = {}

    def push(self, offset: int, data: bytes) -> bytes:
        """What there is from the start on, without a gap."""
        if 0 <= offset and offset + len(data) <= self.MOST and len(self.parts) < self.PARTS and len(data) > len(self.parts.get(offset, b"")):
            self.parts[offset] = data
        out = b""
        for at in sorted(self.parts):
            if at > len(out):
                break
            out += self.parts[at][len(out) - at :]
        return out


def looks_like_quic(datagram: bytes) -> bool:
    return len(datagram) >= 7 and datagram[0] & 0xC0 == 0xC0
