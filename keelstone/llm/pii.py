"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text finds anchors: at-signs, plus signs,
digits, URL schemes and identifier cues. Deterministic local parsers expand each
anchor to its span and validate it. A cursor per kind makes the spans of one
kind leftmost and non-overlapping, so they are the matches that the kind's
pattern would have over the text, without a scan per pattern.

Base kinds: email, ip, card, phone. Added by the method: login (user name
before a password in a URL), iban (after its cue, with the mod-97 check), ssn and account (after a cue).
An added span that overlaps a base span is left out.

Defined results: null and empty texts have no spans; repeated rows are each
reported; null ids are kept; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.llm.common import longs, map_slices, parts
from keelstone.session import prepare

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn", "account")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([A-Za-z0-9._~%!$&'*+-]+):[^\s/@:]*@[A-Za-z0-9.-]+")
_SEP = r"(?:\x20|:|=|#|\.|(?i:number|num|nr|no|code|is))*"
_AFTER = {
    "iban": re.compile(_SEP + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ssn": re.compile(_SEP + r"([0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4})(?![0-9])"),
    "account": re.compile(_SEP + r"([0-9](?:[\x20-]?[0-9]){7,19})(?![0-9])"),
}
_CUES = {"iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct", "konto", "cuenta", "compte", "kontonummer")}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    for w, tag in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        a.add_word(w, tag)
    for tag, cues in _CUES.items():
        for c in cues:
            for w in (c, c.upper(), c.capitalize(), c.title()):
                a.add_word(w, tag)
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _mod97(code: str) -> bool:
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def find(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    added: list[tuple[str, int, int]] = []
    at_email = at_ip = at_card = at_phone = 0
    for end, tag in anchors.iter(text):
        if tag == "digit":
            if end >= at_card:
                if m := _CARD.match(text, end):
                    at_card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        spans.append(("card", end, at_card))
                else:
                    at_card = end + 1
            if end >= at_ip:
                if m := _IP.match(text, end):
                    at_ip = m.end()
                    if all(len(p) < 4 and int(p) <= 255 or len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        spans.append(("ip", end, at_ip))
                else:
                    at_ip = _DIGITS.match(text, end).end()
        elif tag == "at":
            start = end
            while start > at_email and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end)):
                at_email = m.end()
                spans.append(("email", start, at_email))
        elif tag == "plus":
            if end >= at_phone and (m := _PHONE.match(text, end)):
                at_phone = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append(("phone", end, at_phone))
        elif tag == "scheme":
            if m := _LOGIN.match(text, end - 2):
                added.append(("login", *m.span(1)))
        elif m := _AFTER[tag].match(text, end + 1):
            if tag != "iban" or _mod97(m[1].replace(" ", "")):
                added.append((tag, *m.span(1)))
    rank = KINDS.index
    taken: dict[str, int] = {}
    base = sorted((a, b) for _, a, b in spans)
    at, reach = 0, 0  # the base spans that begin before the added one's end, and how far they go
    for kind, a, b in sorted(set(added), key=lambda s: (s[2], s[1])):
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][1])
            at += 1
        if a >= taken.get(kind, 0) and reach <= a:
            taken[kind] = b
            spans.append((kind, a, b))
    return sorted(spans, key=lambda s: (s[1], rank(s[0])))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def as_spans(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], SPANS)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): found holds kind, start and end of each span, in order."""

    def work():
        anchors = automaton()
        return lambda ids, texts: [longs(ids), as_spans([find(t, anchors) for t in texts])]

    return map_slices(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), work, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>")


def mask(text: str, spans: list[tuple[str, int, int]], form: str = "[{}]") -> str:
    """The text with each run of overlapping spans replaced by its first kind's name."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], form.format(kind.upper())]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their personal data masked in `text`; other columns stay."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        anchors = automaton()
        for batch in batches:
            for b in parts(batch):
                new = [None if t is None else mask(t, find(t, anchors)) for t in b.column(at).to_pylist()]
                yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest_rows(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """The contract's columns from rows of (doc_id, found)."""
    of_base = F.filter("found", lambda s: s["kind"].isin(*base))
    counts = [F.size(F.filter("found", _is(k))).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
