"""Personal data: regular expressions propose, checksums confirm, nearby words adjust.

Base kinds (email, ip, card, phone) follow fixed rules: leftmost, non-overlapping
within a kind, and a match that fails its test is dropped without another try.
They always stay; their score only tells how sure the context makes them.  Further
kinds (iban by mod-97, ssn, local phone numbers) are kept from ``LEAST`` on and only
where no base span lies.

Null text counts as empty.  Spans are code points, end exclusive.  Every row is
judged alone, so repeated rows, ties and extra columns make no difference, and
each pattern runs in time linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "local_phone")
LEAST = 0.5
NEAR = 48

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits can only begin a match at its first digit, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The head of a bank account number; ``ibans`` finds its end.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_BODY = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
#: Characters of a number by country, in groups of one length.
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "identity"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
}
AGAINST = ("version", "isbn", "order", "invoice", "release", "serial")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.35}
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of bank account numbers."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """Each @ with the run of local characters before it and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            # What precedes a failed @ can't reach past it: @ is no local character.
            end = max(end, at + 1)
        at = text.find("@", end)


def ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str):
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def ibans(text: str):
    """Numbers of their country's length; of other countries the longest that ends with a group."""
    end = 0
    for m in IBAN.finditer(text):
        body = IBAN_BODY.match(text, m.end()) if m.start() >= end else None
        if not body:
            continue
        whole = text[m.start() : body.end()]
        places = [i + 1 for i, c in enumerate(whole) if c != " "]
        n = IBAN_LENGTH.get(m.group()[:2])
        ends = ([places[n - 1]] if n <= len(places) else []) if n else reversed(places[14:])
        for size in ends:
            after = text[m.start() + size : m.start() + size + 1]
            if not (after.isascii() and after.isalnum()) and mod97(whole[:size]):
                end = m.start() + size
                yield m.start(), end
                break


def score(text: str, kind: str, start: int, end: int, prior: float) -> float:
    """The prior, raised by words of the kind nearby and lowered by words that speak against it."""
    near = set(WORD.findall(text[max(0, start - NEAR) : start].lower())) | set(WORD.findall(text[end : end + NEAR // 2].lower()))
    return round(min(1.0, max(0.0, prior + 0.2 * (not near.isdisjoint(CONTEXT[kind])) - 0.2 * (not near.isdisjoint(AGAINST)))), 3)


def merged(held) -> list[tuple[int, int]]:
    """Overlapping intervals joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(held):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), base kinds first, each kind in order of start."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            found += [("ip", a, b) for a, b in ips(text)]
        found += [("card", a, b) for a, b in cards(text)]
        if "+" in text:
            found += [("phone", a, b) for a, b in phones(text)]
        taken = merged((a, b) for _, a, b in found)
        starts = [a for a, _ in taken]
        more = [("iban", a, b) for a, b in ibans(text)]
        more += [("ssn", *m.span()) for m in SSN.finditer(text)]
        more += [("local_phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        for kind, a, b in more:
            i = bisect_left(starts, b) - 1
            if (i < 0 or taken[i][1] <= a) and score(text, kind, a, b, PRIOR[kind]) >= LEAST:
                found.append((kind, a, b))
    return [(k, a, b, score(text, k, a, b, PRIOR[k])) for k, a, b in found]


def masked(text: str | None, held: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    if not held:
        return text
    out, end = [], 0
    for kind, a, b, _ in sorted(held, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, text: str = "text", mask: bool = False, name: str = "spans") -> DataFrame:
    """docs with the spans added under that name, in place of a column that bears it; with mask, the text column is replaced by its masked form."""
    fields = "spans array<struct<kind: string, start: bigint, end: bigint, score: double>>, masked string"
    kept = [c for c in docs.columns if c != name and (mask or c != text)]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            held = [spans(t) for t in texts]
            rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in h] for h in held]
            clean = [masked(t, h) if mask else None for t, h in zip(texts, held)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, SPAN), pa.array(clean, pa.string())], names=[*names, "spans", "masked"])

    names = [f"c{i}" for i in range(len(kept))]  # clashing names travel as numbers
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"{n} {given.schema[n].dataType.simpleString()}" for n in names), fields])
    out = map_texts(given, run, schema)
    back = [F.col("masked" if mask and c == text else n).alias(c) for c, n in zip(kept, names)]
    return out.select(*back, F.col("spans").alias(name))


def listed(held: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
