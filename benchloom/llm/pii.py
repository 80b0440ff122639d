"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, schemes and words that
announce an identifier. Around each anchor a local parser expands to the boundaries and validates what it
found (label syntax, byte range, Luhn, digit counts, ISO 7064 check digits). The cost follows the anchors, not the
text. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch_of, column, documents

#: Kinds in the order of ties; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "hidden_email", "url", "iban", "account")
BASE = KINDS[:4]

# Words that announce an account or identity number, in the languages at hand.
CUES = ("account number", "account no", "acct", "ssn", "social security", "passport", "iban", "kontonummer", "steuernummer", "cuenta", "pasaporte", "compte", "passeport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS, _DOTTED = re.compile(r"[0-9.]+"), re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPS, _CARD = re.compile(r"[0-9\x20-]+"), re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"[\x20]?[\[(]at[\])][\x20]?([A-Za-z0-9-]+(?:(?:\.|[\x20]?[\[(]dot[\])][\x20]?)[A-Za-z0-9-]+)+)", re.I)
_USER_URL = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/(?:[^\s\"'<>]*[^\s\"'<>.,;:!?)])?)?")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"\.?(?:\x20(?i:no|nr|number|num)\b\.?)?\x20?[:#=]?\x20?([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,17})(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, kind in [("@", "@"), ("+", "+"), ("://", "://"), *((d, "digit") for d in "0123456789"), ("[at]", "at"), ("(at)", "at")]:
        found.add_word(anchor, (kind, len(anchor)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()

_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def small(text: str) -> str:
    """The text in small letters, with every character at its place: some capitals become two small letters."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_SMALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _byte(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def addresses(dotted: str, at: int) -> Iterator[tuple[int, int]]:
    """Places of the addresses in numbers joined by points, which begin at `at`: four parts each, the rest is left over."""
    parts = dotted.split(".")
    for k in range(0, len(parts) - 3, 4):
        end = at + sum(map(len, parts[k : k + 4])) + 3
        if all(map(_byte, parts[k : k + 4])):
            yield at, end
        at = end + 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of start, then kind."""
    found: list[tuple[str, int, int]] = []
    after = dict.fromkeys(("email", "ip", "card", "phone", "iban"), 0)
    for last, (anchor, width) in _ANCHORS.iter(small(text)):
        at = last - width + 1
        if anchor == "digit":
            if at >= after["ip"]:
                end = after["ip"] = _NUMBERS.match(text, at).end()
                found += [("ip", *place) for m in _DOTTED.finditer(text, at, end) for place in addresses(m[0], m.start())]
            if at >= after["card"]:
                end = after["card"] = _GROUPS.match(text, at).end()
                for m in _CARD.finditer(text, at, end):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", *m.span()))
            if at >= after["iban"] + 2 and text[at - 2 : at].isalpha() and text[at - 2 : at].isupper() and (m := _IBAN.match(text, at - 2)):
                after["iban"] = m.end()
                if iban(m[0]):
                    found.append(("iban", *m.span()))
        elif anchor == "@":
            if at >= after["email"]:
                start = at
                while start > after["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    after["email"] = m.end()
                    found.append(("email", start, m.end()))
        elif anchor == "+":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
        elif anchor == "at":
            start = at - (text[at - 1 : at] == " ")
            end = start
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _SPELT.match(text, end)):
                found.append(("hidden_email", start, m.end()))
        elif anchor == "://":
            start = at
            while start > 0 and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _USER_URL.match(text, at)):
                found.append(("url", start, m.end()))
        elif (m := _ACCOUNT.match(text, last + 1)) and not text[at - 1 : at].isalnum():
            found.append(("account", *m.span(1)))
    taken = [(s, e) for k, s, e in found if k != "account"]
    found = [x for x in found if x[0] != "account" or not any(s < x[2] and x[1] < e for s, e in taken)]
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found), a row for each of docs.

    found has (kind, start, end, value) for each span. Null and empty texts have no spans (the hash of nothing, an
    empty string). Null doc_ids and repeated rows are kept as they are. Empty table: no rows.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column(batch, "text")
        found = [spans(t) for t in texts]
        base = [[x for x in f if x[0] in BASE] for f in found]
        out = {"doc_id": (batch.column(0), pa.int64())} | {f"n_{k}": ([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in BASE}
        values = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in f] for t, f in zip(texts, found, strict=True)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        return batch_of(**out, base_sha256=([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()), spans=(list(map(listed, found)), pa.string()), found=(values, kind))

    return arrow_map(documents(docs, id_col, text_col), kernel, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,value:string>>")
