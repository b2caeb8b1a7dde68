"""Personal data: patterns propose spans, check digits confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# The patterns of the base kinds. An address is found from its @ (see _emails), which gives the same matches.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# A candidate is cut where a letter or digit is followed by none, to at least this many of them.
IBAN_CHARS = 12
IBAN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

# Words that raise the score of a kind when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEARBY = 60
CONTEXT_GAIN = 0.2
LEAST = 0.5

SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each candidate, or else its longest part up to the end of a group, that has the right check digits. The search goes on behind the first group of one without."""
    found = IBAN.search(text)
    while found:
        start = found.start()
        ends = [m.end() for m in IBAN_END.finditer(text, start, found.end())]
        ends = [e for e in ends if len(text[start:e].replace(" ", "")) >= IBAN_CHARS]
        end = next((e for e in reversed(ends) if mod97(text[start:e])), None)
        if end:
            yield start, end
        found = IBAN.search(text, end or start + 4)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its @: the longest name before it, then a domain after it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    yield from (("email", s, e) for s, e in _emails(text))
    yield from (("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
    yield from (("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d))
    yield from (("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15)
    yield from (("iban", s, e) for s, e in _ibans(text))
    yield from (("ssn", *m.span()) for m in SSN.finditer(text))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind. Base kinds stay whatever their score; others need ``LEAST``."""
    out = []
    for kind, start, end in _proposed(text):
        near = (text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]).lower()
        words = set(re.findall(r"\w+", near))
        score = min(1.0, START[kind] + CONTEXT_GAIN * any(w in words for w in CONTEXT[kind]))
        if kind in BASE_KINDS or score >= LEAST:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: spans of personal data (kind, start, end in code points, end exclusive; score).

    Base kinds: email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits). Added by the method: iban
    (mod-97) and ssn (only near words that speak of one). Every span has a score, raised by context words within ``NEARBY``
    characters. Rows are worked on one by one: no shuffle.

    Null or empty text has no spans. Repeated rows are treated alike, an empty table gives no rows, other columns stay, and
    an input column ``pii`` is replaced.
    """
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)])

    return docs.withColumn("pii", spans(whole_text()))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets, overlapping spans by the first's kind.

    ``n_chars``, where there is one, becomes the new length. Null text stays null.
    """
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            parts, at, last = [], 0, -1
            for kind, start, end, _ in find_spans(text):
                if start >= last:
                    parts += [text[at:start], f"<{kind.upper()}>"]
                last = max(last, end)
                at = last
            return "".join([*parts, text[at:]])

        return texts.map(one)

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
