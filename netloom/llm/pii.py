"""Format-preserving pseudonyms for personal data in texts, by a keyed Feistel network.

A value is found by its format and checked (Luhn, mod 97, number plans, octets, calendar).
Its free symbols are one number of a mixed-radix domain; an alternating Feistel network,
keyed by a secret and the kind of the value, permutes that domain, and the result is written
in the value's own layout with check digits made anew. A permutation has no collisions: equal
values get equal pseudonyms in every document and layout, different ones stay different, and
who has the key can turn them back (`reverse`).

Kinds: card (first digit kept, Luhn), iban (country kept, mod 97), phone (country code kept;
North American numbers stay valid), ssn, ipv4, date (1900-2099, any of four layouts), email
(local part and the host's first label, letters and digits each among their own), secret
(after password, token, secret, api key and the like, and AKIA keys; letters and digits each
among their own). What fails its check is left alone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from netloom.llm.store import map_batches, prepare

ROUNDS = 10
#: Characters of a secret that are permuted as one number; longer ones are permuted in blocks.
SECRET_BLOCK = 512
KINDS = ("card", "iban", "phone", "ssn", "ipv4", "date", "email", "secret")


class Feistel:
    """Keyed permutations of 0 .. size - 1: additive Feistel over a pair (x, y) with
    x * b + y, walked on while it is outside of the domain."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, size: int, turn: int, x: int, modulus: int) -> int:
        data = f"{tweak}|{size}|{turn}|{x}".encode()
        wide = (modulus.bit_length() + 71) // 8  # eight bytes more: no bias that matters
        out = b""
        while len(out) < wide:
            out += hashlib.blake2b(data, key=self.key, salt=len(out).to_bytes(4, "little")).digest()
        return int.from_bytes(out[:wide], "little") % modulus

    def _sides(self, size: int) -> tuple[int, int]:
        a = max(2, 1 << ((size - 1).bit_length() // 2))
        return a, -(-size // a)

    def permute(self, tweak: str, size: int, value: int) -> int:
        if size < 2:
            return value
        a, b = self._sides(size)
        while True:
            x, y = divmod(value, b)
            for turn in range(0, ROUNDS, 2):
                x = (x + self._f(tweak, size, turn, y, a)) % a
                y = (y + self._f(tweak, size, turn + 1, x, b)) % b
            value = x * b + y
            if value < size:
                return value

    def restore(self, tweak: str, size: int, value: int) -> int:
        if size < 2:
            return value
        a, b = self._sides(size)
        while True:
            x, y = divmod(value, b)
            for turn in range(ROUNDS - 2, -1, -2):
                y = (y - self._f(tweak, size, turn + 1, x, b)) % b
                x = (x - self._f(tweak, size, turn, y, a)) % a
            value = x * b + y
            if value < size:
                return value


Step = Callable[[str, int, int], int]


def _fill(layout: str, digits: str) -> str:
    """The layout with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _walk(step: Step, tweak: str, size: int, value: int, valid: Callable[[int], bool]) -> int:
    while True:
        value = step(tweak, size, value)
        if valid(value):
            return value


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def _card(text: str, step: Step) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or d[0] == "0" or int(d[-1]) != luhn(d[:-1]):
        return None
    n = len(d) - 2
    body = d[0] + str(step(f"card{d[0]}", 10**n, int(d[1:-1]))).zfill(n)
    return _fill(text, body + str(luhn(body)))


def _iban(text: str, step: Step) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 != 1:
        return None
    body = symbols(flat[4:], f"iban{flat[:2]}", step)
    check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
    it = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(" " if c == " " else next(it) for c in text)


def _phone(text: str, step: Step) -> str | None:
    d = _digits(text)
    if text[0] != "+" or d[0] == "1":
        head, n = ("1", d[1:]) if len(d) == 11 and d[0] == "1" else ("", d)
        if len(n) != 10 or n[0] in "01" or n[3] in "01":
            return None
        area, rest = divmod(int(n), 10**7)
        value = (area - 200) * 8 * 10**6 + rest - 2 * 10**6
        area, rest = divmod(step("phone1", 800 * 8 * 10**6, value), 8 * 10**6)
        return _fill(text, f"{head}{area + 200}{rest + 2 * 10**6}")
    if not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    return _fill(text, d[:3] + str(step(f"phone{d[:3]}", 10 ** (len(d) - 3), int(d[3:]))).zfill(len(d) - 3))


def _ssn_valid(n: int) -> bool:
    area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(text: str, step: Step) -> str | None:
    d = int(_digits(text))
    return _fill(text, str(_walk(step, "ssn", 10**9, d, _ssn_valid)).zfill(9)) if _ssn_valid(d) else None


def _ipv4(text: str, step: Step) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = step("ipv4", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, n.to_bytes(4, "big")))


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def _date(text: str, step: Step) -> str | None:
    a, b, c = re.findall(r"\d+", text)
    sep = text[len(a)]
    if len(a) == 4:
        y, m, d, order = a, b, c, "ymd"
    elif sep == "/" and int(b) > 12 or sep == "/" and int(a) <= 12:
        y, m, d, order = c, a, b, "mdy"  # a/b/c is read month first unless that can't be
    else:
        y, m, d, order = c, b, a, "dmy"
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + step("date", _DAYS, day))
    wide = len(a) + len(b) + len(c) == 8
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if wide else str(new.month), "d": f"{new.day:02d}" if wide else str(new.day)}
    return sep.join(parts[x] for x in order)


def symbols(text: str, tweak: str, step: Step) -> str:
    """Letters and digits of ASCII permuted as one number, each within its own kind; the rest stays."""
    sizes, value, size = [], 0, 1
    for c in text:
        base, n = ("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 0)
        sizes.append((c, base, n))
        if n:
            value = value * n + ord(c) - ord(base)
            size *= n
    shape = hashlib.blake2b("".join(b or c for c, b, _ in sizes).encode(), digest_size=8).hexdigest()
    value = step(f"{tweak}{shape}", size, value)
    out = []
    for c, base, n in reversed(sizes):
        if n:
            value, x = divmod(value, n)
            c = chr(ord(base) + x)
        out.append(c)
    return "".join(reversed(out))


def _email(text: str, step: Step) -> str | None:
    local, _, host = text.partition("@")
    label, _, rest = host.partition(".")
    whole = f"{local}@{label}"
    return f"{_in_blocks(whole, 'email' + rest.lower(), step)}.{rest}"


def _in_blocks(text: str, tweak: str, step: Step) -> str:
    """symbols() of a text of any length, a block at a time."""
    return "".join(symbols(text[k : k + SECRET_BLOCK], f"{tweak}{k or ''}", step) for k in range(0, len(text), SECRET_BLOCK))


def _secret(text: str, step: Step) -> str | None:
    head = "AKIA" if re.fullmatch("AKIA[0-9A-Z]{16}", text) else ""
    rest = text[len(head) :]
    return head + _in_blocks(rest, f"secret{head}", step)


#: Each quantifier is bounded or possessive, and each pattern starts at a rare character: linear on any text.
PATTERN = re.compile(
    r"""(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
    |(?P<secret>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))
    |(?P<ipv4>(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))
    |(?P<card>(?<![0-9+])[1-9](?:[\ -]?[0-9]){12,18}(?![0-9]))
    |(?P<phone>(?<![0-9+])\+[1-9][0-9]{0,2}(?:[\ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])|(?<![0-9+])\(?[2-9][0-9]{2}\)?[\ .-][2-9][0-9]{2}[\ .-][0-9]{4}(?![0-9]))""",
    re.VERBOSE,
)
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9_+/=-]{6,}+(?:\.[A-Za-z0-9_+/=-]++)*+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_HAS = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)")
_CHANGE: dict[str, Callable[[str, Step], str | None]] = {"card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4, "date": _date, "email": _email, "secret": _secret}


def _same(tweak: str, size: int, value: int) -> int:
    return value


def _ends(text: str, start: int, end: int, kind: str) -> Iterator[int]:
    """Ends that a match may have: its own, and where its check may hold for a shorter one."""
    yield end
    for b in range(end - 1, start, -1):
        if kind == "card" and text[b] in " -" or kind == "iban" and text[b] == " ":
            yield b


def _checked(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what PATTERN matches: where a check fails, shorter matches of the
    same start are tried, and the search goes on right behind the start."""
    at = 0
    while m := PATTERN.search(text, at):
        start, end, kind = *m.span(), m.lastgroup
        for b in _ends(text, start, end, kind):
            if _CHANGE[kind](text[start:b], _same) is not None:
                yield start, b, kind
                at = b
                break
        else:
            at = start + 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of formats in a text, without overlaps, in order."""
    if not _HAS.search(text):
        return []
    found = []
    at, before = text.find("@"), -1
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            start = at
            while start > before + 1 and text[start - 1] in _LOCAL:
                start -= 1
            while start < at and not text[start].isalnum():
                start += 1
            if start < at:
                found.append((start, host.end(), "email"))
        at, before = text.find("@", at + 1), at
    found += [(*m.span(1), "secret") for m in SECRET.finditer(text)]
    found += _checked(text)
    rank = {"email": 0, "secret": 1}
    taken: list[tuple[int, int, str]] = []
    for f in sorted(found, key=lambda f: (f[0], rank.get(f[2], 2), -f[1])):
        if not taken or f[0] >= taken[-1][1]:
            taken.append(f)
        elif rank.get(f[2], 2) < rank.get(taken[-1][2], 2):
            taken[-1] = f
    return taken


def rewrite(text: str, step: Step) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in it."""
    out, spans, last, length = [], [], 0, 0
    for a, b, kind in find(text):
        new = _CHANGE[kind](text[a:b], step)
        if new is None:
            continue
        out += [text[last:a], new]
        length += a - last
        spans.append((kind, length, len(new)))
        length += len(new)
        last = b
    out.append(text[last:])
    return "".join(out), spans


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))


def _rewrite(batches: Iterator[pa.RecordBatch], key: bytes, back: bool) -> Iterator[pa.RecordBatch]:
    feistel = Feistel(key)
    step = lru_cache(1 << 14)(feistel.restore if back else feistel.permute)
    for batch in batches:
        at = batch.schema.get_field_index("pii_text")
        rest = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for n in batch.schema.names if n != "pii_text"]
        done = [(None, []) if t is None else rewrite(t, step) for t in batch.column(at).to_pylist()]
        spans = pa.array([[{"kind": k, "start": s, "length": n} for k, s, n in x] for _, x in done], _ARROW_SPANS)
        yield pa.RecordBatch.from_arrays([*rest, pa.array([t for t, _ in done], pa.string()), spans], [*names, "pii_text", "pii_spans"])


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """`docs` with pii_text, the text with pseudonyms, and pii_spans (kind, start and length in
    code points) beside all its columns.

    A null text stays null, an empty one empty; both have no spans. Long texts are rewritten whole. Equal rows give equal
    rows. An empty table gives no rows. Columns named pii_text or pii_spans are replaced.
    With `back` and the same key, values found in a rewritten text are turned back; only a
    date with slashes that had its day first can then read as one with its month first, and
    a card or IBAN with digits or words behind it can pass its check together with them.
    """
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in ("pii_text", "pii_spans")]
    wide = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("pii_text"))
    schema = StructType([*wide.schema.fields, StructField("pii_spans", SPANS)])
    return wide.transform(map_batches, partial(_rewrite, key=key, back=back), schema)


def pseudonym_report(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, pii_text, pii_spans, n_<kind> for each kind, n_values), a row for each row of `docs`."""
    out = pseudonymise(docs.select("doc_id", "text"), key).drop("text")
    kinds = F.transform("pii_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast(LongType()).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "pii_text", "pii_spans", *counts, F.size("pii_spans").cast("long").alias("n_values"))
