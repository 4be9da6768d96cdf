"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, plus signs,
identifier cues); a small deterministic parser at each anchor expands to the
borders of the address or number and validates it. Digits are the anchors of
internet addresses and cards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "login", "account", "street")
SPAN_SCHEMA = "array<struct<kind:string,start:int,end:int>>"

# The contract's patterns, in possessive form where giving back characters cannot help.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBERS = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Cues of account identifiers and of street names.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer id", "konto", "cuenta", "compte")
STREET_CUES = (" street", " avenue", " road", " lane", " boulevard", " drive")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "smtp://", "postgres://", "mysql://", "redis://", "amqp://")
LOGIN = re.compile(r"[A-Za-z0-9._%+-]{1,64}+:[^\s/@:]{1,128}+@[A-Za-z0-9.-]{1,253}+")
ACCOUNT = re.compile(r"(?:[\x20:#=.-]|no|nr|number|num|is){0,6}+([A-Z]{0,2}[0-9](?:[\x20-]?[0-9A-Z]){5,33}+)(?![A-Za-z0-9])")
STREET_BEFORE = re.compile(r"(?<![0-9])([0-9]{1,5} (?:[A-Z][a-z]{1,20} ){0,2}[A-Z][a-z]{1,20})$")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str, signs: list[int]) -> list[tuple[int, int, str]]:
    """Expands each at-sign to both sides; what an earlier address holds is not taken again."""
    found, last = [], 0
    for at in signs:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            found.append((start, m.end(), "email"))
            last = m.end()
    return found


def phones(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def numbers(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    return found


def account_after(text: str, cue_end: int) -> tuple[int, int, str] | None:
    m = ACCOUNT.match(text, cue_end)
    if not m:
        return None
    own = m[1].replace(" ", "").replace("-", "")
    if own[:2].isalpha():
        return (m.start(1), m.end(1), "account") if iban_valid(own) else None
    return (m.start(1), m.end(1), "account") if own.isdigit() and len(own) <= 20 else None


def street_before(text: str, cue_start: int, cue_end: int) -> tuple[int, int, str] | None:
    if text[cue_end : cue_end + 1].isalnum() or not (m := STREET_BEFORE.search(text[max(0, cue_start - 80) : cue_start])):
        return None
    return cue_start - len(m[1]), cue_end, "street"


def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for what, keys in (("at", ("@",)), ("plus", ("+",)), ("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for key in keys:
            for form in {key, key.title(), key.upper(), key.capitalize()}:
                automaton.add_word(form, (what, len(form)))
    automaton.make_automaton()
    return automaton


def _scan() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()
        order = {k: i for i, k in enumerate(KINDS)}

        def spans(text: str) -> list[dict]:
            signs, plus, extra = [], False, []
            for last, (what, length) in anchors.iter(text):
                if what == "at":
                    signs.append(last)
                elif what == "plus":
                    plus = True
                elif what == "scheme":
                    if m := LOGIN.match(text, last + 1):
                        extra.append((m.start(), m.end(), "login"))
                elif what == "account":
                    extra.append(account_after(text, last + 1))
                else:
                    extra.append(street_before(text, last + 1 - length, last + 1))
            found = emails(text, signs) if signs else []
            if plus:
                found += phones(text)
            if NUMBERS.search(text):
                found += numbers(text)
            found += set(extra) - {None}
            return [{"kind": k, "start": s, "end": e} for s, e, k in sorted(found, key=lambda x: (x[0], order[x[2]], x[1]))]

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans(t.as_py() or "") for t in batch.column(1)], kind)], names=["id", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) for every row: kind, start and end (code points, end exclusive).

    Kinds email, ip, card and phone are the fixed patterns, leftmost and
    non-overlapping within a kind; login (user and password in an address),
    account (a number behind a cue, checked if it has a check sum) and street are
    added. Null and empty texts have no spans. Rows with a null or repeated id are
    returned like any other; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_scan(), f"id {kind}, spans {SPAN_SCHEMA}").withColumnRenamed("id", id_col)
