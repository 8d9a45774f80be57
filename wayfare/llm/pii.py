"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes
and identifier cues. At each anchor a local parser expands to the left and right and
validates what it finds; text away from anchors is never looked at again.

Kinds. Base: ``email``, ``ip``, ``card`` (12 to 19 digits, Luhn), ``phone`` (9 to 15
digits); for each kind the spans are those of a leftmost, non-overlapping search, minus
those that fail validation. Added by the method: ``masked_email`` (name [at] host [dot]
com), ``login_url`` (a scheme's address with user and password), ``iban`` (by country
code cue, modulo 97), ``account`` (a number after an account cue), ``national_id``
(after its cue), ``street`` (house number and street word), ``secret`` (key prefixes and
values after password cues). Spans are [start, end) in code points; kinds may overlap.

Defined results: a null or empty text has no spans; a text of any length is searched
whole, each parser in time that grows with its length; numbers in it may have any number
of digits; rows stay one to one with the input, repeated ids and texts included; other
columns of any name are ignored (``redact`` keeps them as they are); an empty table gives
an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "login_url", "iban", "account", "national_id", "street", "secret")
KINDS = BASE + ADDED
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MASKED = re.compile(r"\s?[A-Za-z0-9-]+(?:\s?[\[(]dot[\])]\s?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.I)
_LOGIN = re.compile(r"[^\s/:@]+:[^\s/@]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|num\.?|#))?\s?[:=#]?\s?([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.I)
_NATIONAL = re.compile(r"(?:\s?(?:number|no\.?|#))?\s?[:=]?\s?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.I)
_HOUSE = re.compile(r"(?<![0-9])[0-9]{1,5}[a-z]?(?:\x20[A-Z][\w.'-]*){1,3}$")
_SECRET_VALUE = re.compile(r"\s?[:=]\s?[\"']?([^\s\"',;]{8,})")
_KEY = {"AKIA": re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])"), "ghp_": re.compile(r"[0-9A-Za-z]{36}"), "sk-": re.compile(r"[0-9A-Za-z_-]{20,}"), "xox": re.compile(r"[abps]-[0-9A-Za-z-]{10,}")}

#: Cues in the spellings that are looked for: as given, in upper case and capitalised.
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
NATIONAL_CUES = ("ssn", "social security")
SECRET_CUES = ("password", "passwd", "api_key", "apikey", "secret", "token")
STREET_CUES = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive")
MASKED_CUES = ("[at]", "(at)", "[AT]", "(AT)")
#: Country codes that begin an account number, a fixed list.
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("national", NATIONAL_CUES), ("secret", SECRET_CUES)):
        for c in cues:
            for form in {c, c.upper(), c.capitalize()}:
                a.add_word(form, (kind, len(form)))
    for c in STREET_CUES:
        a.add_word(c, ("street", len(c)))
    for c in MASKED_CUES:
        a.add_word(c, ("masked", len(c)))
    for c in _KEY:
        a.add_word(c, ("key", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Finder:
    """Spans of one text after another; built once in each worker."""

    def __init__(self):
        self.automaton = _automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        spans: list[tuple[str, int, int]] = []
        after = dict.fromkeys(("email", "ip", "card", "phone", "iban", "street", "masked_email", "login_url", "secret", "key"), 0)  # where each kind's search goes on
        for last, (anchor, length) in self.automaton.iter(text):
            getattr(self, anchor)(text, last + 1 - length, last + 1, spans, after)
        spans.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
        return list(dict.fromkeys(spans))

    def at(self, text, at, end, spans, after):
        if at < after["email"]:
            return
        start = at
        while start > after["email"] and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, end) if start < at else None
        if m:
            spans.append(("email", start, m.end()))
            after["email"] = m.end()

    def digit(self, text, at, end, spans, after):
        if at >= after["ip"]:
            m = _IP.match(text, at)
            if m:
                after["ip"] = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                    spans.append(("ip", at, m.end()))
            else:
                after["ip"] = _DIGITS.match(text, at).end()
        if at >= after["card"]:
            m = _CARD.match(text, at)
            if m:
                after["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, m.end()))
            else:
                after["card"] = end
        # the two check digits of an account number follow its country code
        if at >= 2 and at >= after["iban"] and text[at - 2 : at] in IBAN_COUNTRIES and not (at > 2 and text[at - 3].isalnum()):
            m = _IBAN.match(text, at - 2)
            if m and iban_valid(m.group()):
                spans.append(("iban", at - 2, m.end()))
                after["iban"] = m.end()

    def plus(self, text, at, end, spans, after):
        if at >= after["phone"]:
            m = _PHONE.match(text, at)
            if m:
                after["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    spans.append(("phone", at, m.end()))

    def masked(self, text, at, end, spans, after):
        stop = at - 1 if at and text[at - 1] == " " else at
        start = stop
        while start > after["masked_email"] and text[start - 1] in _LOCAL:
            start -= 1
        m = _MASKED.match(text, end) if start < stop else None
        if m:
            spans.append(("masked_email", start, m.end()))
            after["masked_email"] = m.end()

    def scheme(self, text, at, end, spans, after):
        m = _LOGIN.match(text, end)
        start = at
        while start > after["login_url"] and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        if m and start < at:
            spans.append(("login_url", start, m.end()))
            after["login_url"] = m.end()

    def account(self, text, at, end, spans, after):
        m = _ACCOUNT.match(text, end)
        if m:
            spans.append(("account", m.start(1), m.end(1)))

    def national(self, text, at, end, spans, after):
        m = _NATIONAL.match(text, end)
        if m:
            spans.append(("national_id", m.start(1), m.end(1)))

    def secret(self, text, at, end, spans, after):
        # a cue inside a value is part of it, so no character is looked at twice
        m = _SECRET_VALUE.match(text, end) if at >= after["secret"] else None
        if m:
            spans.append(("secret", m.start(1), m.end(1)))
            after["secret"] = m.end()

    def key(self, text, at, end, spans, after):
        m = _KEY[text[at:end]].match(text, end) if at >= after["key"] and not (at and text[at - 1].isalnum()) else None
        if m:
            spans.append(("secret", at, m.end()))
            after["key"] = m.end()

    def street(self, text, at, end, spans, after):
        # a house number and one to three capitalised words within the 60 characters before
        low = max(after["street"], at - 60)
        m = _HOUSE.search(text[low:at]) if not (end < len(text) and text[end].isalpha()) else None
        if m:
            spans.append(("street", low + m.start(), end))
            after["street"] = end


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of every whole text, in order of start and kind."""

    def run(batches):
        find = finder()
        schema = pa.schema([("doc_id", pa.int64()), ("spans", _ARROW)])
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[dict(zip(("kind", "start", "end"), s)) for s in find(t or "")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(spans, _ARROW)], schema=schema)

    narrow = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text`` replaced by its first kind in angle brackets."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, a, b in finder()(text):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                yield part.set_column(i, "text", pa.array([clean(t) for t in part.column(i).to_pylist()], pa.string()))

    return texts(docs).mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
