"""Fill-in-the-middle examples by block rotation in place, and their exact inversion.

A text is scanned for the ends of its units (lines, or code points). Two hashes of the key choose two of the borders; they cut the text
into prefix, middle and suffix. The bytes go into one bytearray with the three sentinels already in their places, in the order of the text:
`<P>` prefix `<M>` middle `<S>` suffix. One rotation of two neighbouring blocks then gives the form: for `psm` the blocks `<M>` middle and
`<S>` suffix change places, for `spm` everything before `<S>` changes places with `<S>` suffix. A rotation is three reversals (each
block, then both together), made in place with a scratch of `SCRATCH` bytes. The inverse finds the sentinels, rotates back by the other
block's length and takes the sentinels out.

All choices come from the sha256 of `seed:key`, so reruns and lost executors give the same rows.

Defined results: a null text is an empty one; empty texts and texts that contain a sentinel stay as they are (`plain`), so every
other output holds each sentinel once; a null key is the empty string; equal rows give equal results; an empty table gives an empty
one; a text of any length is worked on whole, in memory of about twice its size. Texts are handled as bytes, so malformed UTF-8 survives.
Only the key and the text are read; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCRATCH = 1 << 16
# Ends of the units of a text: a line with its end or the rest, or a code point.
UNITS = {"line": re.compile(rb"[^\n]*\n|[^\n]+"), "code_point": re.compile(rb"[^\x80-\xbf][\x80-\xbf]*|[\x80-\xbf]")}


@dataclass(frozen=True)
class Plan:
    """What to do with a text: `rate` of 100 are transformed, `spm` of 100 of them put the suffix first."""

    unit: str = "line"
    rate: int = 100
    spm: int = 50
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {sorted(UNITS)}")
        marks = self.marks
        # An end of one sentinel that begins another could make a third occurrence where text and sentinel meet.
        if not all(marks) or any(x != y and x in y for x in marks for y in marks) or len(set(marks)) < 3 or any(
                x.endswith(y[:k]) for x in marks for y in marks for k in range(1, len(y))):
            raise ValueError("sentinels must be three different texts, none in another, and no end of one may begin another")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.middle.encode(), self.suffix.encode()


def reverse(cells: np.ndarray, start: int, end: int) -> None:
    """Reverse cells[start:end] in place, by pieces from both ends."""
    while end - start > 1:
        k = min(SCRATCH, (end - start) // 2)
        left = cells[start:start + k][::-1].copy()
        cells[start:start + k] = cells[end - k:end][::-1]
        cells[end - k:end] = left
        start, end = start + k, end - k


def rotate(cells: np.ndarray, start: int, border: int, end: int) -> None:
    """The blocks [start, border) and [border, end) change places."""
    reverse(cells, start, border)
    reverse(cells, border, end)
    reverse(cells, start, end)


def code_points(data: bytes | bytearray | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def transformed(text: bytes, key: str, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output)."""
    ends = [m.end() for m in UNITS[plan.unit].finditer(text)]
    digest = hashlib.sha256(f"{plan.seed}:{key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    if not ends or any(mark in text for mark in plan.marks) or h[2] % 100 >= plan.rate:
        return len(ends), "plain", None, None, text
    first, last = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    p, m, s = plan.marks
    buffer = bytearray(p)
    buffer += text[:a]
    middle_at = len(buffer)
    buffer += m
    buffer += text[a:b]
    suffix_at = len(buffer)
    buffer += s
    buffer += text[b:]
    form = "spm" if h[3] % 100 < plan.spm else "psm"
    rotate(np.frombuffer(buffer, np.uint8), 0 if form == "spm" else middle_at, suffix_at, len(buffer))
    return len(ends), form, code_points(text[:a]), code_points(text[a:b]), bytes(buffer)


def restored(output: bytes, form: str, plan: Plan) -> bytes:
    """The text behind an output."""
    if form == "plain":
        return output
    p, m, s = plan.marks
    buffer = bytearray(output)
    cells = np.frombuffer(buffer, np.uint8)
    if form == "spm":
        border = output.index(p)
        rotate(cells, 0, border, len(buffer))
        suffix_at = len(buffer) - border
    else:
        suffix_at, middle_at = output.index(s), output.index(m)
        rotate(cells, suffix_at, middle_at, len(buffer))
        suffix_at += len(buffer) - middle_at
    middle_at = buffer.index(m)
    del cells  # gives the bytearray free for resizing
    for at, mark in ((suffix_at, s), (middle_at, m), (0, p)):
        if buffer[at:at + len(mark)] != mark:
            raise ValueError(f"no output of form {form}")
        del buffer[at:at + len(mark)]
    return bytes(buffer)


def _cells(column: pa.Array) -> Iterator[bytes]:
    """Texts as bytes, null as empty, without decoding."""
    for cell in column.cast(pa.binary()):
        yield cell.as_py() or b""


def _texts(values: list[bytes]) -> pa.Array:
    """Bytes as texts, without a check of the encoding."""
    raw = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per document: the key, `n` units, `form` (plain, psm or spm), `prefix_chars`, `middle_chars` (null if plain), `output`."""
    picked = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].cast("string").alias("text"))
    picked = picked.select("k", picked.k.cast("string").alias("name"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time: the output of a batch of long texts is as large as the batch.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [transformed(t, k.as_py() or "", plan) for k, t in zip(part.column(1), _cells(part.column(2)))]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), _texts(output)], ["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = picked.schema["k"].dataType.simpleString()
    out = picked.mapInArrow(work, f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("k", key)


def restore(formed: DataFrame, plan: Plan = Plan(), name: str = "restored") -> DataFrame:
    """The rows of `fill_in_middle` with the text rebuilt from `output` and `form` alone, as column `name`."""
    form_at, output_at = formed.columns.index("form"), formed.columns.index("output")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                back = [restored(o, f.as_py(), plan) for f, o in zip(part.column(form_at), _cells(part.column(output_at)))]
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(back)], [*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema)
    return formed.mapInArrow(work, f"{fields}, `{name}` string")
