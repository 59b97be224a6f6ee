"""Format-preserving pseudonyms for personal data.

Numbers that pass their kind's validation (cards, IBANs, social security numbers, IPv4 addresses,
telephone numbers, mail addresses' local parts) and calendar dates are replaced by a keyed
permutation of the values of the same format, a Feistel network walked until it lands inside.
Punctuation stays, check digits are made anew, and equal values give equal pseudonyms in every
document, however they are punctuated.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small, table

#: Session settings: the key in hex, or the path of a text file that holds it, on any store that Spark
#: reads. Where neither is set, a key is drawn for the session.
KEY_SETTING = "spark.tessera.pseudonym.key"
KEY_FILE_SETTING = "spark.tessera.pseudonym.keyFile"
ROUNDS = 8
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049  # to the end of 2099


@lru_cache(maxsize=1 << 16)
def permuted(key: bytes, kind: str, value: int, size: int) -> int:
    """Keyed bijection of 0..size-1 for each kind."""
    if size < 2:
        return value
    p = math.isqrt(size - 1) + 1
    q = -(-size // p)

    def part(r: int, x: int, m: int) -> int:
        seed = f"{kind}:{size}:{r}:{x}".encode()
        return int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=24).digest(), "little") % m

    while True:
        hi, lo = divmod(value, q)
        for r in range(0, ROUNDS, 2):
            hi = (hi + part(r, lo, p)) % p
            lo = (lo + part(r + 1, hi, q)) % q
        value = hi * q + lo
        if value < size:
            return value


def _put(form: str, digits: str) -> str:
    """The digits of ``form`` replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _plain(key: bytes, kind: str, digits: str) -> str:
    return str(permuted(key, f"{kind}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits))


def card(key: bytes, text: str) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + _plain(key, "card", d[1:-1])
    return _put(text, next(body + str(c) for c in range(10) if luhn(body + str(c))))


def social(key: bytes, text: str) -> str | None:
    a, g, s = map(int, text.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not g or not s:
        return None
    v = permuted(key, "ssn", (areas.index(a) * 99 + g - 1) * 9999 + s - 1, len(areas) * 99 * 9999)
    return f"{areas[v // 9999 // 99]:03}-{v // 9999 % 99 + 1:02}-{v % 9999 + 1:04}"


def address(key: bytes, text: str) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in parts):
        return None
    v = permuted(key, "ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, v.to_bytes(4, "big")))


def phone(key: bytes, text: str) -> str | None:
    d = _digits(text)
    if text.startswith("+"):
        if not 8 <= len(d) <= 15:
            return None
        keep = 1 if d[0] in "17" else 2
    else:
        keep = len(d) - 10
        if keep not in (0, 1):
            return None
    # National and international forms of one American number stay linked.
    return _put(text, d[:keep] + _plain(key, "phone", d[keep:]))


def date(key: bytes, text: str) -> str | None:
    a, mark, b, _, c = re.split(r"([-/.])", text)
    if text[4:5] == mark:
        order = "ymd"
    else:
        order = "mdy" if mark == "/" and int(b) > 12 else "dmy"
    parts = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"]))
    except ValueError:
        return None
    at = (day - FIRST_DAY).days
    if not 0 <= at < DAYS:
        return None
    new = FIRST_DAY + datetime.timedelta(days=permuted(key, "date", at, DAYS))
    value = {"y": f"{new.year:04}", "m": new.month, "d": new.day}
    return mark.join(value[o] if o == "y" else str(value[o]).zfill(len(p)) if len(p) > 1 else str(value[o]) for o, p in zip(order, (a, b, c), strict=True))


#: English month names, in order. Fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])


def written(key: bytes, text: str) -> str | None:
    """A date with a month's name, whole or cut to three letters, before or after the day."""
    name, (a, year) = re.search(r"[A-Z][a-z]+", text)[0], re.findall(r"\d+", text)
    month = next(k for k, m in enumerate(MONTHS, 1) if m[:3] == name[:3])
    new = date(key, f"{year}-{month:02}-{a.zfill(2)}")
    if new is None:
        return None
    y, m, d = new.split("-")
    given = iter((d if len(a) == 2 and a[0] == "0" else str(int(d)), y))
    named = MONTHS[int(m) - 1] if name in MONTHS and name != "May" else MONTHS[int(m) - 1][: len(name)]
    return re.sub(r"[A-Z][a-z]+|\d+", lambda x: named if x[0][0].isalpha() else next(given), text)


def iban(key: bytes, text: str) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    new = iter(_plain(key, "iban" + plain[:2], _digits(body))) if _digits(body) else iter("")
    body = "".join(next(new) if c.isdigit() else c for c in body)
    check = 98 - number(body + plain[:2] + "00") % 97
    left = iter(f"{plain[:2]}{check:02}{body}")
    return "".join(c if c == " " else next(left) for c in text)


def mail(key: bytes, text: str) -> str:
    local, domain = text.rsplit("@", 1)
    radix = [26 if c.isascii() and c.isalpha() else 10 if c.isascii() and c.isdigit() else 1 for c in local]
    size, value = 1, 0
    for c, r in zip(local, radix, strict=True):
        size *= r
        value = value * r + (ord(c.lower()) - 97 if r == 26 else int(c) if r == 10 else 0)
    v = permuted(key, "mail" + "".join("a" if r == 26 else "0" if r == 10 else c for c, r in zip(local, radix, strict=True)), value, size)
    out = []
    for c, r in zip(reversed(local), reversed(radix), strict=True):
        v, k = divmod(v, r)
        new = chr(97 + k) if r == 26 else str(k) if r == 10 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out)) + "@" + domain


# Fixed patterns of the formats; an earlier kind wins where two could begin at one place.
_KINDS = (
    ("mail", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", mail),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("date", r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d]|[-/.]\d)", date),
    ("written", rf"(?:(?:{_MONTH}) \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:{_MONTH}) \d{{4}})(?![\w])", written),
    ("ipv4", r"\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", address),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\w]|-\d)", social),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|1?[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w]|[-.]\d)", phone),
    ("card", r"\d(?:[ -]?\d){12,18}(?![\w]|[ -]\d)", card),
)
_MAKERS = {kind: make for kind, _, make in _KINDS}
_ALL = re.compile(r"(?<![\w.@+-])(?:" + "|".join(f"(?P<{k}>{p})" for k, p, _ in _KINDS) + ")")
_SOME = re.compile(r"[0-9@]")


def pseudonymised(text: str, key: bytes) -> tuple[str, int]:
    """The text with its personal data replaced, and how many places were."""
    if not _SOME.search(text):
        return text, 0
    count, out, at = 0, [], 0
    m = _ALL.search(text)
    while m:
        new = _MAKERS[m.lastgroup](key, m[0])
        if new is None and m.lastgroup != "card":  # no such value; a longer number may still begin here
            other = re.compile(dict((k, p) for k, p, _ in _KINDS)["card"]).match(text, m.start())
            new = card(key, other[0]) if other else None
            end = other.end() if new is not None else m.end()
        else:
            end = m.end()
        if new is not None:
            out += [text[at : m.start()], new]
            at = end
            count += 1
        m = _ALL.search(text, end)
    return "".join(out) + text[at:], count


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names. Without one, a random key that is drawn once for a session
    and is nowhere in the code: pseudonyms then stay linked within a session, not beyond it."""
    given = spark.conf.get(KEY_SETTING, None)
    path = spark.conf.get(KEY_FILE_SETTING, None)
    if given is None and path:
        given = spark.read.text(path).first()["value"]
    if given is None:
        given = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, given)
    key = bytes.fromhex(given.strip())
    if len(key) < 16:
        raise ValueError(f"{KEY_SETTING} needs 16 bytes at least")
    return key


def pseudonymise(docs: DataFrame, key: bytes, count: str | None = "n_private") -> DataFrame:
    """``docs`` with ``text`` replaced and, at the end, a column ``count`` with how many places
    were (none where it is None).

    All other columns pass through unchanged, n_chars (where there is one) follows the text. A
    null text stays null, with count 0; repeated rows give repeated results; a column of the
    input that is called like ``count`` is replaced.
    """
    if count in docs.columns:
        docs = docs.drop(count)
    names = docs.columns
    more = [count] if count else []
    schema = docs.withColumns({c: F.lit(0).cast("bigint") for c in more}).schema
    place, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [(None, 0) if t is None else pseudonymised(t, key) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array([t for t, _ in found], batch.column(place).type)
            if chars is not None:
                same = zip(batch.column(place).to_pylist(), found, batch.column(chars).to_pylist(), strict=True)
                columns[chars] = pa.array([n if old == new[0] or new[0] is None else len(new[0]) for old, new, n in same], batch.column(chars).type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([n for _, n in found], pa.int64()) for _ in more)], names=[*names, *more])

    return docs.mapInArrow(replaced, schema)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
