"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Every expression runs in time linear in the text: starts that can't differ from an earlier failed start aren't tried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced

#: Kinds in the order in which spans of equal start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile("[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: What may be a secret: a value behind : or =, whose name is looked at afterwards, or a token that its issuer marks.
VALUE = re.compile(r"[:=][ \t]{0,4}[\"']?([A-Za-z0-9+/_.~-]{16,}+={0,2})(?![A-Za-z0-9+/_.~-])")
NAMED = re.compile(r"(?:key|token|secret|passwd|password|pwd|credentials?|auth)[\"' \t]{0,4}\Z", re.IGNORECASE)
MARKED = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,72}+|glpat-[A-Za-z0-9_-]{20})(?![A-Za-z0-9])")
BEGIN, END = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"), re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
#: Bits of entropy a character that a named value must have, beside a letter and a digit: words and repeated signs stay below.
ENTROPY = 2.8

#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Score without context, words that raise it and words that lower it when they stand within REACH characters.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.7}
RAISES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "server", "host", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("token", "secret", "password", "passwd", "api", "auth", "credential", "private"),
}
LOWERS = {
    "email": ("example", "noreply"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "isbn", "serial", "tracking"),
    "phone": ("version", "isbn", "score"),
    "iban": ("sample", "example"),
    "secret": ("example", "placeholder", "dummy", "checksum", "sha1", "sha256", "md5"),
}
REACH, STEP = 40, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of account numbers: moved round and with letters as 10 to 35 they leave 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The search goes on behind a confirmed number, or just behind the start of a candidate that fails."""
    m = IBAN.search(text)
    while m:
        at = m.start() + 1
        if n := IBAN_LENGTHS.get(m[0][:2]):
            seen = 0
            for i, c in enumerate(m[0]):
                seen += c != " "
                if seen == n:
                    end = m.start() + i + 1
                    if not text[end : end + 1].isalnum() and mod97(m[0][: i + 1].replace(" ", "")):
                        yield m.start(), end
                        at = end
                    break
        m = IBAN.search(text, at)


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values that a name such as token or api_key introduces and that look random, tokens of known issuers, private keys; in
    order and without overlaps."""
    found = [m.span() for m in MARKED.finditer(text)]
    for m in VALUE.finditer(text):
        v = m[1]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= ENTROPY and NAMED.search(text[max(0, m.start() - REACH) : m.start()]):
            found.append(m.span(1))
    at = 0
    while m := BEGIN.search(text, at):
        end = END.search(text, m.end())
        at = end.end() if end else len(text)
        found.append((m.start(), at))
    last = 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= last:
            yield a, b
            last = b


FINDERS = (emails, ips, cards, phones, ibans, secrets)


def score(text: str, kind: str, start: int, end: int) -> float:
    """Between 0 and 1: the kind's own, raised and lowered by words close to the span."""
    near = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
    s = SCORES[kind] + STEP * any(w in near for w in RAISES[kind]) - STEP * any(w in near for w in LOWERS[kind])
    return round(min(1.0, max(0.0, s)), 2)


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all confirmed spans, sorted; offsets in code points, end exclusive."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for k in range(1, len(KINDS)):
            if k != 3 or "+" in text:
                found += [(a, k, b) for a, b in FINDERS[k](text)]
    elif "-----BEGIN " in text:
        found += [(a, 5, b) for a, b in secrets(text)]
    return sorted(found)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while (i := i + 1) < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
        out += (text[at:start], f"<{KINDS[kind].upper()}>")
        at = end
    return "".join((*out, text[at:]))


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, text: str = "text", redact: float | None = None) -> DataFrame:
    """docs with pii, an array of struct(kind, start, end, score) by start and then kind; with redact also pii_redacted, the
    text with every span whose score is at least `redact` replaced by its kind.

    The kinds are email, ip, card (Luhn), phone, and beyond the base iban (length by country and mod-97) and secret (named or
    marked tokens, private keys). Spans of different kinds may overlap. All spans are in pii whatever their score; only
    redaction goes by it. Null and empty texts have none; texts of any length are searched whole, in linear time. Repeated
    rows are treated alike, an empty table gives an empty one. Other columns stay, those of the two names are replaced. No
    shuffle.
    """

    def find(texts: pa.Array) -> pa.Array:
        rows, texts = [], texts.to_pylist()
        for t in texts:
            spans = [(*s, score(t, KINDS[s[1]], s[0], s[2])) for s in spans_of(t)]
            row = {"pii": [{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, p in spans]}
            sure = [s[:3] for s in spans if redact is not None and s[3] >= redact]
            rows.append(row | {"text": redacted(t, sure) if sure else None})
        return pa.array(rows, pa.struct([("pii", FOUND), ("text", pa.string())]))

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    run = F.arrow_udf(find, "struct<pii:array<struct<kind:string,start:int,end:int,score:double>>,text:string>")
    df = replaced(docs, ["pii", "pii_redacted", "_found"]).withColumn("_found", run(F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`") for c in df.columns if c != "_found"]
    extra = [] if redact is None else [F.coalesce(F.col("_found.text"), F.col(f"`{text}`")).alias("pii_redacted")]
    return df.select(*kept, F.col("_found.pii").alias("pii"), *extra)
