"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is (the base spans). Then transducers rewrite the text: invisible characters go,
homoglyphs and full-width forms become ASCII, runs of spelled digits become digits, and bracketed or spelled-out at/dot signs become
signs. Each rewrite keeps, for every character it writes, the source characters it stands for, so a span found in the rewritten
text maps back to code points of the source. Such a span is added if it holds something rewritten and does not lie inside a base span;
a disguise that a base span meets halfway (a hidden character in a name) gives a span beside that base span, and both are redacted as one.

Defined results: a null text is an empty one and has no spans; texts of any length are read whole, in time linear in their length
for base spans; equal rows give equal spans. Spans are sorted by start, then by kind in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like ASCII ones (Cyrillic and Greek), and characters that show nothing.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαοερνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aeopcyxijsdhqwABEKMHOPCTXIJSaoepvikABEZHIKMNOPTYX"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SIGNS = {"\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u00a0": " ", "\u2007": " ",
         "\u202f": " "}
# The digits spelled in the four languages, and words for the signs.
DIGIT_WORDS = {
    **{w: d for d, ws in enumerate((
        "zero oh null nul cero", "one eins uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
        "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho",
        "nine neun neuf nueve")) for w in ws.split()},
}
AT_WORDS, DOT_WORDS = "at arroba arobase ät", "dot punkt punto point"
# Endings that make bare words around spelled signs an address even where the words look like running text.
ENDINGS = frozenset("com org net edu gov info biz io co uk eu de fr es us ca ch at it nl be example".split())
# Words of running text that are no part of a host when its signs are spelled without brackets.
PROSE = frozenset(
    "the a an this that these those each every any some one which what no all both another such same certain of on in to is so or and "
    "as by for from with we he she they you i my me his her its our their if then than when where was were are has had have do does did "
    "but not now just only product products der die das den dem ein eine le la les un une el los las y et und".split())

_ODD = re.compile("[" + "".join(map(re.escape, [*HOMOGLYPHS, *INVISIBLE, *SIGNS]))
                  + "\uff01-\uff5e\u2460-\u2468\u2080-\u2089\u00b2\u00b3\u00b9\u0660-\u0669\u06f0-\u06f9\u0966-\u096f"
                  + "\U0001d400-\U0001d7ff]")
# Labels of a disguised name or host after the first: more are read from the thirtieth before the sign on. Each place where a name may
# begin looks that far ahead, which keeps the search linear.
LABELS = 30
_SEP = r"[\s,.\-]{1,3}"
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<![^\W\d_])(?:{_WORD}{_SEP}){{2,}}{_WORD}(?![^\W\d_])", re.I)
_ONE_WORD = re.compile(_WORD, re.I)
_AT = rf"(?:\s*[\[({{<]\s*(?:{AT_WORDS.replace(' ', '|')}|@)\s*[\])}}>]\s*)"
_DOT = rf"(?:\s*[\[({{<]\s*(?:{DOT_WORDS.replace(' ', '|')}|\.)\s*[\])}}>]\s*)"
_AT_PLAIN = rf"(?:\s+(?:{AT_WORDS.replace(' ', '|')}|@)\s+)"
_DOT_PLAIN = rf"(?:\s+(?:{DOT_WORDS.replace(' ', '|')})\s+)"
_NAME = r"[A-Za-z0-9%+_-]++"
# An address with at least one disguised sign: brackets always count, bare words only when both signs are spelled.
_MASKED = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:\.|{_DOT}|{_DOT_PLAIN}){_NAME}){{0,{LABELS}}}?(?P<at>@|{_AT}|{_AT_PLAIN})"
    rf"(?P<host>[A-Za-z0-9-]++(?:(?:\.|{_DOT}|{_DOT_PLAIN})[A-Za-z0-9-]++){{1,{LABELS}}})", re.I)
# What a text must show before its signs are rewritten: a sign in brackets, a spelled dot, or a sign between blanks. Every match of
# `_MASKED` and `_MASKED_IP` that is rewritten shows one of them.
_HINT = re.compile(
    rf"[\[({{<]\s*(?:{AT_WORDS.replace(' ', '|')}|{DOT_WORDS.replace(' ', '|')}|@|\.)\s*[\])}}>]"
    rf"|\s(?:{DOT_WORDS.replace(' ', '|')}|@)\s", re.I)
_MASKED_IP = re.compile(rf"(?<![0-9])[0-9]++(?:(?:\.|{_DOT}|{_DOT_PLAIN})[0-9]++){{3}}(?![0-9])", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right. Only the signs are visited: a match is the run of name characters before a sign, cut at
    the end of the previous match, and the host after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain identifiers; matches that fail their check are dropped without another try."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        # Leading zeros do not count against a part; long digit runs are compared without a big conversion.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


class Rewritten:
    """A text in the making, with the source span behind each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends, self.touched = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, new text) that follow each other; every new character stands for the whole replaced piece."""
        text, starts, ends, touched, done = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text.append(self.text[done:a])
            starts += self.starts[done:a]
            ends += self.ends[done:a]
            touched += self.touched[done:a]
            text.append(new)
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
                touched += b"\1" * len(new)
            done = b
        text.append(self.text[done:])
        self.starts, self.ends = starts + self.starts[done:], ends + self.ends[done:]
        self.touched = touched + self.touched[done:]
        self.text = "".join(text)


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in SIGNS:
        return SIGNS[c]
    value = unicodedata.digit(c, None)
    return str(value) if value is not None else unicodedata.normalize("NFKC", c)


def _has_spelled(text: str) -> bool:
    """Does a run of spelled digits stand in the text? Words are counted first: the pattern is slow, and few texts need it."""
    words = _LETTERS.findall(text.lower())
    return sum(map(DIGIT_WORDS.__contains__, words)) > 2 and _SPELLED.search(text) is not None


def _is_address(name: str, sign: str, host: str) -> bool:
    """Is a match of `_MASKED` a disguised address, and neither a plain one nor running text?"""
    bracketed, spelled = re.search(_DOT, host, re.I), re.findall(_DOT_PLAIN, host, re.I)
    labels = [x.lower() for x in re.split(rf"{_DOT}|{_DOT_PLAIN}|\.", host, flags=re.I)]
    if sign == "@":
        return bool(bracketed or spelled or re.search(rf"{_DOT}|{_DOT_PLAIN}", name, re.I))
    if not re.fullmatch(_AT_PLAIN, sign, re.I) or bracketed:
        return True
    ending = len(labels[-1]) > 1 and labels[-1].isalpha()
    if sign.strip() == "@":
        return ending
    if not spelled:
        return False
    if sign.strip().lower() != "at":
        return ending
    # "at this point in" is no address: "point" needs a listed ending, and no label may be a word of running text.
    return labels[-1] in ENDINGS or ending and spelled[-1].strip().lower() != "point" and PROSE.isdisjoint(labels)


def rewrites(text: str) -> Rewritten | None:
    """The normalised text, or None if no transducer finds anything to rewrite."""
    odd = not text.isascii() and _ODD.search(text)
    if not (odd or _has_spelled(text) or _HINT.search(text)):
        return None
    out = Rewritten(text)
    if odd:
        out.replace([(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(text)])
    if _has_spelled(out.text):
        out.replace([(m.start(), m.end(), "".join(str(DIGIT_WORDS[w.lower()]) for w in _ONE_WORD.findall(m[0])))
                     for m in _SPELLED.finditer(out.text)])
    edits = []
    if _HINT.search(out.text):
        for m in _MASKED.finditer(out.text):
            name, sign, host = out.text[m.start():m.start("at")], m["at"], m["host"]
            if not _is_address(name, sign, host):
                continue
            for piece, begin in ((name, m.start()), (host, m.start("host"))):
                edits += [(begin + d.start(), begin + d.end(), ".") for d in re.finditer(rf"{_DOT}|{_DOT_PLAIN}", piece, re.I)]
            if sign != "@":
                edits.append((m.start("at"), m.end("at"), "@"))
        if edits:
            out.replace(sorted(edits))
        out.replace([(m.start() + d.start(), m.start() + d.end(), ".") for m in _MASKED_IP.finditer(out.text)
                     for d in re.finditer(rf"{_DOT}|{_DOT_PLAIN}", m[0], re.I)])
    return out if any(out.touched) or len(out.text) != len(text) else None


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (start, kind number, end)."""
    text = text or ""
    base = base_spans(text)
    plain = rewrites(text)
    if plain is None:
        return base, base
    added, own = [], set(base)
    for start, kind, end in base_spans(plain.text):
        a, b = plain.starts[start], plain.ends[end - 1]
        changed = any(plain.touched[start:end]) or b - a != end - start
        if changed and (a, kind, b) not in own and not any(s <= a and b <= e for s, _, e in base):
            added.append((a, kind, b))
    return base, sorted(base + added)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def find_personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per document: the key, base counts by kind, `base_sha256` of the base spans, all `spans`, and `n_added` of them
    that only the rewritten text shows."""
    picked = docs.select(docs[key].alias("k"), docs[text].alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists, more = [[] for _ in KINDS], [], [], []
            for cell in batch.column(1):
                base, every = spans(cell.as_py())
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(every))
                more.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(lists, pa.string()), pa.array(more, pa.int64())],
                ["k", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    out = picked.mapInArrow(find, f"k {picked.schema['k'].dataType.simpleString()}, {kinds}, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("k", key)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if not text:
        return text
    every = spans(text)[1]
    if not every:
        return text
    out, done = [], 0
    for start, kind, end in every:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact_column(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; `length`, if there, follows the new text. Lengths of
    untouched rows stay as they are."""
    schema, at = docs.schema, docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at)
            new = [redact(cell.as_py()) for cell in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, old.type)
            if size is not None:
                columns[size] = pa.array([len(b) if a.as_py() != b else c.as_py() for a, b, c in zip(old, new, columns[size])],
                                         columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(clean, schema)
