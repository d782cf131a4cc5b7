"""Personal data in texts, found also behind disguises, with spans in the source text.

Base spans come from the source text itself. The method adds spans: transducers rewrite the text and keep for every
character of the result the source characters it stands for,

1. homoglyphs (full-width forms, look-alike letters, digits of other scripts) to ASCII, invisible characters to nothing,
2. disguised signs: ``[at]``, ``(dot)`` and, in an address, ``@``, plain ``at``, ``.`` and plain ``dot`` in any mix; plain
   ``at`` needs a disguised dot beside it, or "read more at example.com" would be an address,
3. IP addresses with spelled digits or dots,
4. spelled digits in runs of seven or more, with ``plus`` before them; then also runs of spelled and plain digits mixed,

the same detectors run on the result, and what they find in rewritten places is mapped back. Base spans stay as they are;
an added span that overlaps a base span is left out. Spans of mixed runs are taken where no other span is. Texts without
any sign of a disguise are not rewritten.

Rules: spans are code points, end exclusive, leftmost and not overlapping per kind; a match that fails its check is
dropped without another try. A null text is empty and has no span. Work is linear in the length of the text.
"""
from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
# A start inside a run of digits fails where the run's own start fails, so only the run's start is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def short_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def detect(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    if not DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in IP.finditer(text) if all(map(short_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


# Letters of other scripts that look like a Latin one.
LOOKALIKES = dict(zip("авеікмнорстухѕјԁԛԝАВЕІКМНОРСТУХЅЈοαενικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aBeikmhopctyxsjdqwABEIKMHOPCTYXSJoaevikptuxABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"


def _ascii_of() -> dict[str, str]:
    table = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | LOOKALIKES | dict.fromkeys(INVISIBLE, "")
    for code in range(0x660, 0x10000):
        digit = unicodedata.digit(chr(code), None) if unicodedata.category(chr(code)) == "Nd" else None
        if digit is not None:
            table[chr(code)] = str(digit)
    return table


ASCII_OF = _ascii_of()
ODD_SET = frozenset(ASCII_OF)
ODD = re.compile("[" + "".join(ASCII_OF) + "]")
SIGN = re.compile(r"(?i)\s*(?:\[\s*(at|dot)\s*\]|\(\s*(at|dot)\s*\)|\{\s*(at|dot)\s*\}|<\s*(at|dot)\s*>)\s*")
BRACKET = re.compile(r"(?i)[\[({<]\s*(?:at|dot)\s*[\])}>]")
SPELLED_ADDRESS = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: dot [A-Za-z0-9._%+-]++)*?( at |@)[A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]++)*(?: dot |\.)[A-Za-z]{2,24}(?![A-Za-z0-9])")
WORD_SIGN = re.compile(r"(?i) (at|dot) ")
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}
_DIGIT = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
SPELLED_RUN = re.compile(rf"(?i)(?<![A-Za-z])(?:plus[\x20-]{{1,3}})?(?:{_DIGIT})(?:[\x20,-]{{1,3}}(?:{_DIGIT})){{6,}}(?![A-Za-z])")
_TOKEN = rf"(?:(?:{_DIGIT})(?![A-Za-z])|[0-9]++)"
_PART = rf"{_TOKEN}(?:[\x20,-]{{1,3}}{_TOKEN})*+"
SPELLED_IP = re.compile(rf"(?i)(?<![A-Za-z0-9]){_PART}(?:(?: dot |\.){_PART}){{3}}(?![A-Za-z])")
MIXED_RUN = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus[\x20-]{{1,3}})?{_TOKEN}(?:[\x20,()-]{{1,3}}{_TOKEN})++")
PIECE = re.compile(rf"(?i)(?P<word>plus|{_DIGIT})|[0-9]+|\.|(?P<dot> dot )")
LETTER = re.compile("[A-Za-z]")
DIGIT_WORD = re.compile(rf"(?i)(plus|{_DIGIT})[\x20,-]*")


class Rewritten:
    """A text with the source span of each of its characters, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def copy(self) -> Rewritten:
        other = Rewritten("")
        other.text, other.start, other.end, other.new = self.text, self.start, self.end, self.new
        return other

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put a text in place of each span; spans rise and do not overlap."""
        parts, start, end, new, done = [], [], [], [], 0
        for a, b, put in edits:
            parts += [self.text[done:a], put]
            start += self.start[done:a] + [self.start[a]] * len(put)
            end += self.end[done:a] + [self.end[b - 1]] * len(put)
            new += self.new[done:a] + [True] * len(put)
            done = b
        self.text = "".join([*parts, self.text[done:]])
        self.start, self.end, self.new = start + self.start[done:], end + self.end[done:], new + self.new[done:]


def signs(text: str) -> list[tuple[int, int, str]]:
    put = {"at": "@", "dot": "."}
    return [(*m.span(), put[next(filter(None, m.groups())).lower()]) for m in SIGN.finditer(text)]


def spelled_addresses(plain: Rewritten) -> list[tuple[int, int, str]]:
    put, out = {"at": "@", "dot": "."}, []
    for m in SPELLED_ADDRESS.finditer(plain.text):
        if m[1] != "@" and " dot " not in m[0].lower() and not any(plain.new[i] for i in range(*m.span()) if plain.text[i] == "."):
            continue
        out += [(m.start() + w.start(), m.start() + w.end(), put[w[1].lower()]) for w in WORD_SIGN.finditer(m[0])]
    return out


def written(text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
    """Words between ``begin`` and ``end`` as digits and dots, nothing between a word and the digits beside it."""
    out, pieces = [], list(PIECE.finditer(text, begin, end))
    for p, after in zip(pieces, [*pieces[1:], None]):
        until = after.start() if after else p.end()
        if p["word"]:
            out.append((p.start(), until, DIGIT_WORDS[p[0].lower()]))
        elif p["dot"]:
            out.append((*p.span(), "."))
        elif after and after["word"] and until > p.end():
            out.append((p.end(), until, ""))
    return out


def spelled_ips(text: str) -> list[tuple[int, int, str]]:
    return [e for m in SPELLED_IP.finditer(text) if LETTER.search(m[0]) for e in written(text, *m.span())]


def mixed(run: str) -> bool:
    """Whether a run holds digit words beside plain digits, seven digits or more in all."""
    words = [p["word"].lower() for p in PIECE.finditer(run) if p["word"]]
    plain = len(DIGIT.findall(run))
    return bool(words) and plain > 0 and plain + len(words) - ("plus" in words) >= 7


def mixed_digits(text: str) -> list[tuple[int, int, str]]:
    return [e for m in MIXED_RUN.finditer(text) if mixed(m[0]) for e in written(text, *m.span())]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in SPELLED_RUN.finditer(text):
        words = list(DIGIT_WORD.finditer(m[0]))
        # The last word's own end, so that no space after the run is taken.
        out += [(m.start() + w.start(), m.start() + (w.end() if i < len(words) - 1 else w.end(1)), DIGIT_WORDS[w[1].lower()]) for i, w in enumerate(words)]
    return out


def disguised(text: str) -> bool:
    if not (text.isascii() or ODD_SET.isdisjoint(text)) or BRACKET.search(text):
        return True
    low = text.lower()
    if " dot " in low and (" at " in low or "@" in low or SPELLED_IP.search(text)):
        return True
    if not any(w in low for w in DIGIT_WORDS):
        return False
    return bool(SPELLED_RUN.search(text) or SPELLED_IP.search(text) and spelled_ips(text) or mixed_digits(text))


def untouched(taken: list[Span]):
    """A test whether a span overlaps none of ``taken``: one sort, then a look among ends that only rise."""
    taken = sorted(taken)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(span: Span) -> bool:
        before = bisect_left(starts, span[1])  # spans that begin before this one ends
        return not before or furthest[before - 1] <= span[0]

    return free


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only show after rewriting."""
    out: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if not disguised(text):
        return out
    edits = [(m.start(), m.end(), ASCII_OF[m[0]]) for m in ODD.finditer(text)]
    plain = Rewritten(text)
    plain.replace(edits)
    for step in (lambda p: signs(p.text), spelled_addresses, lambda p: spelled_ips(p.text)):
        if found := step(plain):
            plain.replace(found)
    taken = [s for spans in base.values() for s in spans]
    free = untouched(taken)
    more = mixed_digits(plain.text)
    ways = [(spelled_digits(plain.text), plain)]
    if more:
        ways.append((more, plain.copy()))
    for found, way in ways:
        if found:
            way.replace(found)
        if way.text == text:
            continue
        shown = []
        for kind, spans in detect(way.text).items():
            for a, b in spans:
                if any(way.new[a:b]) or way.end[b - 1] - way.start[a] != b - a:
                    span = way.start[a], way.end[b - 1]
                    if free(span):
                        shown.append(span)
                        out[kind].append(span)
        free = untouched(taken := taken + shown)
    return {kind: sorted(spans) for kind, spans in out.items()}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans of each kind counted, hash of the base spans, all spans, number of added ones."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base = detect(text)
                    more = added(text, base)
                    both = {kind: base[kind] + more[kind] for kind in KINDS}
                    rows.append((*(len(base[kind]) for kind in KINDS), sha256(joined(base).encode()).hexdigest(), joined(both), sum(map(len, more.values()))))
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4]), pa.array(c[5]), pa.array(c[6], pa.int64())],
                                                 names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
            .mapInArrow(read, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"))
