"""Chat records of any known layout to canonical turns, and turns to training text.

Schema fingerprinting: the nested field paths of a JSON record that some mapping knows are sorted and hashed. The hash selects a
declarative mapping, which says where the turns, roles and texts stand. Optional fields are part of a mapping: every combination of
them has its own fingerprint. Records that no mapping fits come back with their fingerprint and no turns.

Template: `### role: text</turn>` and a line break, one per turn. In roles and texts a backslash is put before every backslash and
before the strings that start or end a turn, so the text can be read back exactly.

Defined results: null texts are empty, null roles are empty roles; turns of a conversation come by turn number (null first), then role
and text, so repeated rows follow each other; null conversation ids are one conversation; an empty table gives an empty result. A
conversation is streamed turn by turn: none is held whole.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "### ", "</turn>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. `items` is the path of the list of turns, or None: then `fields` lists (role, path) pairs
    of one record. Paths use dots; `[]` marks list items. `optional` paths may be missing. Texts that are lists of parts are joined."""

    name: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        if self.items is None:
            own = [p for _, p in (*self.fields, *self.joined)] + ([self.role, self.text] if self.role else [])
        else:
            own = [f"{self.items}[]", f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]
        return list(dict.fromkeys([*own, *self.optional]))


# Field names of widely used layouts, and the roles they spell otherwise.
MAPPINGS = (
    Mapping("turn", role="role", text="text"),
    Mapping("messages", items="messages", role="role", text="content", optional=("messages[].content",)),
    Mapping("messages_parts", items="messages", role="role", text="content[].text", optional=("messages[].content",)),
    Mapping("messages_text", items="messages", role="role", text="text", optional=("messages[].text",)),
    Mapping("from_value", items="conversations", role="from", text="value", optional=("conversations[].value", "system"),
            fields=(("system", "system"),)),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")),
            joined=(("user", "input"),), optional=("system", "input", "output")),
    Mapping("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system", "completion")),
    Mapping("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt_chosen", items="prompt", role="role", text="content", fields=(("assistant", "chosen"),), optional=("chosen",)),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer")), optional=("answer",)),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "prompter": "user",
         "instruction": "user", "chatbot": "assistant"}


def field_paths(value: object, at: str = "") -> Iterator[str]:
    """All field paths of a JSON value; the items of a list share one path."""
    if isinstance(value, dict):
        for key, inner in value.items():
            path = f"{at}.{key}" if at else key
            yield path
            yield from field_paths(inner, path)
    elif isinstance(value, list):
        yield f"{at}[]"
        for inner in value:
            yield from field_paths(inner, f"{at}[]")


def digest(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def registry(mappings: tuple[Mapping, ...]) -> tuple[frozenset[str], dict[str, Mapping]]:
    """The paths that any mapping knows, and the mapping of every fingerprint; the first mapping wins a tie."""
    known = frozenset(p for m in mappings for p in m.paths())
    table: dict[str, Mapping] = {}
    for m in mappings:
        needed = {p for p in m.paths() if p not in m.optional}
        # Parents of a path are in the record as well, where some mapping knows them.
        for some in itertools.chain.from_iterable(itertools.combinations(m.optional, k) for k in range(len(m.optional) + 1)):
            paths = needed | set(some)
            paths |= {q for p in paths for q in _parents(p) if q in known}
            table.setdefault(digest(paths), m)
    return known, table


def _parents(path: str) -> Iterator[str]:
    while path:
        if path.endswith("[]"):
            path = path[:-2]
        elif "." in path:
            path = path.rpartition(".")[0]
        else:
            return
        yield path


def _at(value: object, path: str) -> str:
    """The text at a path; several texts are joined by line breaks, nulls are empty."""
    values = [value]
    for step in path.split("."):
        name = step.removesuffix("[]")
        values = [v.get(name) for v in values if isinstance(v, dict)]
        if step.endswith("[]"):
            values = [x for v in values if isinstance(v, list) for x in v]
    return "\n".join(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values if v is not None)


def turns_of(record: object, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) turns of a record."""
    joined = dict(mapping.joined)

    def field(role: str, path: str) -> tuple[str, str]:
        text = _at(record, path)
        more = _at(record, joined[role]) if role in joined else ""
        return role, f"{text}\n\n{more}" if more else text

    def there(path: str) -> bool:
        return isinstance(record, dict) and path in record

    fields = [field(role, path) for role, path in mapping.fields if there(path)]
    if mapping.items is None:
        if mapping.role:
            fields.append((_at(record, mapping.role), _at(record, mapping.text)))
        return [(ROLES.get(r.lower(), r), t) for r, t in fields]
    items = record.get(mapping.items) if isinstance(record, dict) else None
    listed = [(_at(x, mapping.role), _at(x, mapping.text)) for x in items or []]
    before, after = [f for f in fields if f[0] == "system"], [f for f in fields if f[0] != "system"]
    return [(ROLES.get(r.lower(), r), t) for r, t in [*before, *listed, *after]]


def canonical_turns(records: DataFrame, keys: list[str], record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Keys, fingerprint, layout and one row per turn: `position` from 0, `role`, `text`. A record that is null, no JSON or of
    no known layout gives one row with a null layout and no turn."""
    picked = records.select(*[records[k].alias(f"k{i}") for i, k in enumerate(keys)], records[record].alias("record"))
    schema = ", ".join(f"k{i} {picked.schema[i].dataType.simpleString()}" for i in range(len(keys)))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = registry(mappings)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                take, out = [], []
                for i, cell in enumerate(part.column(len(keys))):
                    try:
                        value = json.loads(cell.as_py() or "null")
                    except ValueError:
                        value = None
                    mark = digest(known.intersection(field_paths(value)))
                    mapping = table.get(mark) if isinstance(value, dict) else None
                    turns = turns_of(value, mapping) if mapping else []
                    for position, (role, text) in enumerate(turns):
                        take.append(i)
                        out.append((mark, mapping.name, position, role, text))
                    if not turns:
                        take.append(i)
                        out.append((mark, mapping.name if mapping else None, None, None, None))
                picked_keys = [c.take(pa.array(take, pa.int64())) for c in part.columns[:-1]]
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*picked_keys, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                                 [*part.schema.names[:-1], "fingerprint", "layout", "position", "role", "text"])

    out = picked.mapInArrow(convert, f"{schema}, fingerprint string, layout string, position long, role string, text string")
    return out.toDF(*keys, "fingerprint", "layout", "position", "role", "text")


def escaped(text: Column) -> Column:
    """Backslashes before backslashes and before the control strings; in roles also before the colon."""
    for plain in ("\\", START, END, ": "):
        text = F.replace(text, F.lit(plain), F.lit("\\" + plain))
    return text


def format_turns(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add `formatted`, the training text of the turn, and the half-open code point range [loss_start, loss_end) of it that
    counts for the loss: the text of assistant turns."""
    who, said = escaped(F.coalesce(F.col(role), F.lit(""))), escaped(F.coalesce(F.col(text), F.lit("")))
    head = F.length(who) + len(START) + 2
    counts = F.col(role).eqNullSafe("assistant")
    return (turns.withColumn("formatted", F.concat(F.lit(START), who, F.lit(": "), said, F.lit(END + "\n")))
            .withColumn("loss_start", F.when(counts, head).otherwise(0))
            .withColumn("loss_end", F.when(counts, head + F.length(said)).otherwise(0)))


_ESCAPE = re.compile(r"\\(\\|### |</turn>|: )")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|### |</turn>|: )|:(?! ))*+): ((?:[^\\<]|\\(?:\\|### |</turn>|: )|<(?!/turn>))*+)</turn>\n", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


def digests(formatted: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Per conversation, read back from the formatted turns: number of turns, hashes of turns and of the text under the loss mask.

    Conversations are dealt by their key and sorted inside each partition; a stream of batches then keeps one running hash, so even a
    conversation of very many turns takes no memory."""
    kind = formatted.schema[key].dataType.simpleString()
    ranked = formatted.select(F.col(key).alias("k"), *[c.alias(f"o{i}") for i, c in enumerate(order)], "formatted", "loss_start", "loss_end")
    dealt = ranked.repartition("k").sortWithinPartitions("k", *[F.col(f"o{i}").asc_nulls_first() for i in range(len(order))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, state = None, None

        def rows(done: list) -> pa.RecordBatch:
            keys, states = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array([s[0] for s in states], pa.int64()), pa.array([s[1].hexdigest() for s in states]),
                 pa.array([s[2] for s in states], pa.int64()), pa.array([s[3].hexdigest() for s in states]),
                 pa.array([s[4] for s in states], pa.int64())], names)

        for batch in batches:
            done, key_type = [], batch.column(0).type
            columns = [batch.column("k"), *(batch.column(n) for n in ("formatted", "loss_start", "loss_end"))]
            for k, text, start, end in zip(*columns):
                k, text, start, end = k.as_py(), text.as_py(), start.as_py(), end.as_py()
                if state is None or k != current:
                    if state is not None:
                        done.append((current, state))
                    current, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                masked = unescaped(text[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(text)
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(current, state)])

    out = dealt.mapInArrow(fold, f"k {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("k", key)
