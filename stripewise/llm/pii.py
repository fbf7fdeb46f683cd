"""Personal data: offset-preserving transducers undo disguises, spans map back to the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "∙": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
# The digits' names in English, German, French and Spanish.
DIGIT_NAMES = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Endings of hosts that a spoken address may have.
SPOKEN_ENDINGS = frozenset(
    "com org net edu gov mil int info biz io co me tv eu us uk ie de at ch li fr be lu nl es pt it mx ar cl pe br ca au nz in jp cn ru pl se no dk fi cz gr test example invalid "
    "app dev ai xyz online site shop store tech cloud name pro me kr za tr gg ly sh id il sg hk tw th ua ro hu ie pt".split()
)
AT = r"(?:at|arroba|bei|chez|@)"
DOT = r"(?:dot|punkt|punto|point|\.)"
SPOKEN_DOT = r"(?:dot|punkt|punto|point)"


def _homoglyphs() -> dict[int, str]:
    """Signs that stand for one sign of identifiers: by compatibility composition, or by looks."""
    wanted = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+-_%()")
    out = {ord(k): v for k, v in LOOKALIKES.items()}
    for c in (0xB2, 0xB3, 0xB9, *range(0x180, 0x20000)):
        if not 0xD800 <= c < 0xE000 and (n := unicodedata.normalize("NFKC", chr(c))) in wanted:
            out[c] = n
    for c in range(0x660, 0xFF20):
        if unicodedata.category(chr(c)) == "Nd":
            out[c] = str(unicodedata.digit(chr(c)))
    return out


HOMOGLYPHS = _homoglyphs()
_BEYOND = re.compile("[^\\x00-\\u017f]|[\u00b2\u00b3\u00b9]")
_HIDDEN = re.compile("[​‌‍⁠﻿­]+")
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,2}}(?:({AT})|({DOT}))\s{{0,2}}[\])}}>]\s{{0,2}}", re.I)
_CODED = re.compile(r"(&#0*64;|&#x0*40;|&commat;|%40)|&#0*46;|&#x0*2e;|&period;|%2e", re.I)
_SPOKEN_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])[ \t]{1,3}(?:at|arroba)[ \t]{1,3}(?=[A-Za-z0-9])", re.I)
_JOINED = re.compile(r"(?<=[A-Za-z0-9])([_-])(?:at|arroba)\1(?=[A-Za-z0-9]+(?:\1(?:dot|punkt|punto|point)\1[A-Za-z0-9]+)+(?![A-Za-z0-9]))", re.I)
_JOINED_DOT = re.compile(r"([_-])(?:dot|punkt|punto|point)\1", re.I)
_JOINED_HOST = re.compile(r"[A-Za-z0-9]+(?:[_-](?:dot|punkt|punto|point)[_-][A-Za-z0-9]+)+", re.I)
_SPOKEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:[ \t]{{1,3}}{SPOKEN_DOT}[ \t]{{1,3}}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:[ \t]{{1,3}}{SPOKEN_DOT}[ \t]{{1,3}}|\.)[A-Za-z0-9-]+)+(?![A-Za-z0-9-])", re.I)
_SPOKEN_DOT = re.compile(rf"[ \t]{{1,3}}{SPOKEN_DOT}[ \t]{{1,3}}", re.I)
_LOCAL_WORD = re.compile(r"[A-Za-z0-9._%+-]+")
_NAMES = frozenset(DIGIT_NAMES)
_NAME = "(?:" + "|".join(sorted(DIGIT_NAMES, key=len, reverse=True)) + ")"
_BETWEEN = rf"(?:\s{{1,3}}{SPOKEN_DOT}\s{{1,3}}|,\s{{1,2}}|\s{{1,3}}|[,.-])"
_DIGIT_RUN = re.compile(rf"\b(?:plus )?{_NAME}\b(?:{_BETWEEN}(?:{_NAME}\b|[0-9]{{1,4}}\b)){{3,}}", re.I)
_DIGIT_ITEM = re.compile(rf"(plus )|({_NAME})\b|([0-9]+)|(\s{{1,3}}{SPOKEN_DOT}\s{{1,3}})|([,\s.-]+)", re.I)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """The (start, kind, end) of the plain patterns, by start and kind. Time is linear: mails
    are looked for around each @, numbers from where a run of digits begins."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _spoken_mail(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits for `name at host dot tld`; a plain dot in the host needs one in the name too, so
    that prose such as `meet at example.com` stays, and an ending that is not listed needs a
    dot spelled out on both sides."""
    for found in _SPOKEN_AT.finditer(text):
        begin, end = found.span()
        m = _HOST.match(text, end)
        if not m:
            continue
        dots = list(_SPOKEN_DOT.finditer(text, m.start(), m.end()))
        prose = len(dots) == 1 and dots[0][0].strip().lower() == "point"  # `at this point in`
        left, edits = begin, []
        while True:  # name dot name at ...
            word = left
            while word > 0 and text[word - 1] in _LOCAL:
                word -= 1
            head = text[max(0, word - 14) : word]
            d = re.search(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}{SPOKEN_DOT}[ \t]{{1,3}}\Z", head, re.I)
            if not d:
                break
            edits.append((word - len(head) + d.start(), word, "."))
            left = word - len(head) + d.start()
        name = text[word:begin]
        tld = re.split(r"[ .]", m[0])[-1]
        listed = tld.lower() in SPOKEN_ENDINGS and (dots and not prose or edits or re.match(r"[A-Za-z][\w-]*[._][A-Za-z0-9]", name))
        if listed or dots and edits and tld.isalpha() and len(tld) > 1:
            yield from edits
            yield (begin, end, "@")
            yield from ((d.start(), d.end(), ".") for d in dots)


def _joined_mail(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits for `name_at_host_dot_tld`, with dots in the name as well."""
    for m in _JOINED.finditer(text):
        word = m.start()
        while word > 0 and text[word - 1] in _LOCAL:
            word -= 1
        yield from ((d.start(), d.end(), ".") for d in _JOINED_DOT.finditer(text, word, m.start()))
        yield (m.start(), m.end(), "@")
        host = _JOINED_HOST.match(text, m.end())
        yield from ((d.start(), d.end(), ".") for d in _JOINED_DOT.finditer(text, m.end(), host.end()))


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    words = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split()
    if _NAMES.isdisjoint(words):
        return
    for m in _DIGIT_RUN.finditer(text):
        for x in _DIGIT_ITEM.finditer(text, m.start(), m.end()):
            if x[1]:
                yield (x.start(), x.end(), "+")
            elif x[2]:
                yield (x.start(), x.end(), DIGIT_NAMES[x[2].lower()])
            elif x[4] or x[5] and "." in x[5]:
                yield (x.start(), x.end(), ".")
            elif x[5]:
                yield (x.start(), x.end(), "")


def disguises(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, what it stands for), in order and apart from each other."""
    found = [(m.start(), m.end(), "") for m in _HIDDEN.finditer(text)] if not text.isascii() else []
    for m in _BRACKETED.finditer(text):
        lo = m.start()
        while lo > 0 and m.start() - lo < 2 and text[lo - 1].isspace():
            lo -= 1
        found.append((lo, m.end(), "@" if m[1] else "."))
    found += ((m.start(), m.end(), "@" if m[1] else ".") for m in _CODED.finditer(text))
    found += _spoken_mail(text)
    found += _joined_mail(text)
    found += ((d.start(), d.end(), ".") for m in _SPOKEN_IP.finditer(text) for d in _SPOKEN_DOT.finditer(text, m.start(), m.end()))
    found += _spelled(text)
    out: list[tuple[int, int, str]] = []
    for e in sorted(found):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """All spans (start, kind, end, base, plain form) by start and kind, in code points.

    Look-alikes are replaced sign for sign, which moves nothing; disguises are then replaced
    by what they stand for, and each end of a span in the result is mapped back through them.
    Base spans, those of the text as it is, stay; others are added where they meet no base
    span of their kind.
    """
    base = detect(text)
    plain = text.translate(HOMOGLYPHS) if not text.isascii() and _BEYOND.search(text) else text
    edits = disguises(plain)
    spans = [(s, k, e, True, text[s:e]) for s, k, e in base]
    if plain is text and not edits:
        return spans
    parts, at, n = [], 0, 0
    places = []  # where each edit's output begins and ends
    for s, e, new in edits:
        parts += (plain[at:s], new)
        n += s - at
        places.append((n, n + len(new)))
        n, at = n + len(new), e
    undone = "".join(parts) + plain[at:]
    begins = [p[0] for p in places]

    def source(i: int, end: bool) -> int:
        """Where sign i of the undone text begins in the source, or ends."""
        j = bisect_right(begins, i) - 1
        while j >= 0 and places[j][0] == places[j][1] and begins[j] == i and j > 0 and begins[j - 1] == i:
            j -= 1
        if j < 0:
            return i + end
        if places[j][0] <= i < places[j][1]:
            return edits[j][1] if end else edits[j][0]
        j = bisect_right(begins, i) - 1
        return i - places[j][1] + edits[j][1] + end

    taken = {k: [(s, e) for s, kk, e in base if kk == k] for k in range(len(KINDS))}
    for s, k, e in detect(undone):
        a, b = source(s, False), source(e - 1, True)
        i = bisect_right(taken[k], (a, a)) if taken[k] else 0
        near = taken[k][max(0, i - 1) : i + 1]
        if all(b <= x or a >= y for x, y in near):
            spans.append((a, k, b, False, undone[s:e]))
    return sorted(spans)


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("plain", T.StringType()),
    ]
)
_ARROW_SPANS = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("plain", pa.string())]
    )
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans (kind, start, end, base, plain), by start and
    kind; offsets in code points of the source text, end exclusive; plain is the identifier
    without its disguise; base tells the ones found in the text as it is.

    No shuffle: each text is read once, whole, in time linear in its length. Null and empty
    texts have no spans; repeated rows and null ids are treated like any other row; an empty
    table gives no rows; other columns are not carried, so their names cannot clash.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(SPAN))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e, "base": b, "plain": p} for s, k, e, b, p in find(x.as_py() or "")]
                for x in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with each span of the text replaced by its kind; overlapping spans count as one."""

    def cover(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts:
            out = []
            for x in batch.column(batch.schema.get_field_index(text_col)):
                text = x.as_py()
                if text:
                    parts, at = [], 0
                    for s, k, e, _, _ in find(text):
                        if s >= at:
                            parts += (text[at:s], mark.format(KINDS[k]))
                            at = e
                        else:
                            at = max(at, e)
                    text = "".join(parts) + text[at:]
                out.append(text)
            i = batch.schema.get_field_index(text_col)
            columns = [pa.array(out, pa.string()) if j == i else c for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(cover, docs.schema)
