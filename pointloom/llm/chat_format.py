"""Chat formatting: records of many layouts become canonical turns, one text, and a loss mask.

The nested field paths of a record, with the kinds of their values, are hashed; the
fingerprint selects a declarative mapping (``Layout``) that names where turns,
roles and texts are.  The template marks a turn as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

and control strings inside roles and texts are escaped: one backslash goes in
after ``<`` where backslashes (or none) and ``|`` follow, which taking one
backslash out again undoes.  A newline in a role becomes ``<|nl|>``.  The loss
mask is a list of character ranges of the formatted text: the assistant's texts.

Defined cases: null texts and roles are empty; turns of one number are ordered
by role and text; repeated rows are repeated turns; a record whose fingerprint
no layout has, or which is null, no JSON object or nested too deep to be read,
gives no turns and the layout null; a lone surrogate becomes U+FFFD; an empty table gives an empty result; other columns are ignored;
rows with a null id are one conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.llm.frames import map_batches

#: Control strings of the template (fixed values).
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Turns and characters of one record, about; a longer conversation is several records.
RECORD_TURNS, RECORD_CHARS = 1000, 1 << 22
#: Halves of surrogate pairs that stand alone, which no text in UTF-8 can hold.
_LONE = re.compile("[\ud800-\udfff]")
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class Layout:
    """A mapping: either the list of turns with its role and text fields, or fields that are a turn each.

    ``fields`` are (role, names of fields whose texts, if not empty, are joined by a blank line).
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Layouts that are known (fixed values): paths, ``[]`` for the items of a list.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("share", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction with system", ("instruction", "output", "system"), fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
)


Path = tuple[tuple[tuple[str, ...], ...], str]
_KINDS = ((str, "text"), (type(None), "text"), (bool, "boolean"), (int, "number"), (float, "number"), (dict, "object"), (list, "list"))


def field_paths(record: object) -> set[Path]:
    """Paths of the leaves of a nested record, each with the kind of its value; an empty list or object is a leaf, null a text.

    A path is a tuple of steps, ("field", name) or ("item",), so that no name can look like a path of several steps.
    """
    out: set[Path] = set()
    left: list[tuple[tuple[tuple[str, ...], ...], object]] = [((), record)]
    while left:
        at, value = left.pop()
        if isinstance(value, dict) and value:
            left += [((*at, ("field", name)), v) for name, v in value.items()]
        elif isinstance(value, list) and value:
            left += [((*at, ("item",)), v) for v in value]
        else:
            out.add((at, next(kind for t, kind in _KINDS if isinstance(value, t))))
    return out


def layout_paths(layout: Layout) -> set[Path]:
    """Paths of a layout's texts: names between points, ``[]`` after the name of a list."""
    steps = lambda name: (("field", name[:-2]), ("item",)) if name.endswith("[]") else (("field", name),)
    return {(tuple(s for name in path.split(".") for s in steps(name)), "text") for path in layout.paths}


def fingerprint(paths: set[Path]) -> str:
    return hashlib.blake2b(json.dumps(sorted(paths)).encode(), digest_size=8).hexdigest()


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def parsed(text: str | None) -> object:
    """The JSON value of a text; None where it is null, no JSON, or nested deeper than the parser goes."""
    try:
        return None if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return None


def canonical_turns(record: object, layouts: dict[str, Layout]) -> tuple[str | None, list[tuple[str, str]]]:
    layout = layouts.get(fingerprint(field_paths(record))) if isinstance(record, dict) else None
    if layout is None:
        return None, []
    as_text = lambda x: _LONE.sub("\ufffd", x or "")
    if layout.turns:
        roles = dict(layout.roles)
        return layout.name, [(roles.get(r, r), as_text(t.get(layout.text))) for t in record[layout.turns] for r in [as_text(t.get(layout.role))]]
    return layout.name, [(role, "\n\n".join(x for name in names for x in [as_text(record.get(name))] if x or len(names) == 1)) for role, names in layout.fields]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted text and the loss mask, begin and end of each range one after another."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), NEWLINE)}\n", escape(text)
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def read_back(formatted: str, mask: list[int]) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns of a formatted text, and the texts under its mask."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape(role.replace(NEWLINE, "\n")), unescape(rest[: -len(END) - 1])))
    return turns, [unescape(formatted[a:b]) for a, b in zip(mask[::2], mask[1::2])]


FORMATTED = "conv_id long, layout string, n_turns long, formatted string, loss_mask array<long>"


def format_chats(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, layout, n_turns, formatted text and loss mask of each row of ``records`` (conv_id, record: JSON), then the columns in ``carry``."""
    by_print = {fingerprint(layout_paths(x)): x for x in layouts}

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"conv_id": batch["conv_id"], "layout": [], "n_turns": [], "formatted": [], "loss_mask": []}
        for text in batch["record"].to_pylist():
            layout, turns = canonical_turns(parsed(text), by_print)
            formatted, mask = render(turns)
            for name, value in (("layout", layout), ("n_turns", len(turns)), ("formatted", formatted), ("loss_mask", mask)):
                out[name].append(value)
        yield out | {c: batch[c] for c in carry}

    source = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record"), *carry)
    schema = T.StructType([*T._parse_datatype_string(FORMATTED), *[records.schema[c] for c in carry]])
    return map_batches(source, run, schema)


#: Columns that say where a record stands in its conversation; ``open``: other records of the conversation may exist.
ORDER = ("turn", "role", "number", "open")
_SIMPLE = {("user", "assistant"): ("prompt", "response"), ("system", "user", "assistant"): ("system", "instruction", "output")}


def _record(turns: list[tuple[str, str]], whole: bool) -> str:
    """JSON of some turns, in the layout that is usual for their roles."""
    names = _SIMPLE.get(tuple(role for role, _ in turns)) if whole else None
    found = dict(zip(names, (text for _, text in turns))) if names else {"messages": [{"role": role, "content": text} for role, text in turns]}
    return json.dumps(found, ensure_ascii=False)


def as_records(rows: DataFrame, most_turns: int = RECORD_TURNS, most_chars: int = RECORD_CHARS) -> DataFrame:
    """(conv_id, record) and ORDER from rows by turn.

    Rows are dealt by ranges of conversation, turn and role and read in order, so that no conversation is gathered: one
    of many turns gives several records, as does one that lies in two ranges.
    """
    columns = ("conv_id", *ORDER, "record")
    types = {f.name: f for f in rows.schema}
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([*T._parse_datatype_string("conv_id long"), types["turn"], *T._parse_datatype_string("role string, number long, open boolean, record string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        out: list[tuple] = []
        held: list[tuple] = []
        number, chars, cut, edge = 0, 0, False, True  # edge: the range begins with this conversation

        def close(open: bool) -> None:
            out.append((held[0][0], held[0][1], held[0][2], number, open, _record([h[2:] for h in held], not open)))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out) if out else [[]] * len(columns), arrow)], schema=arrow)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if held and row[0] != held[0][0]:
                    close(cut or edge)
                    held, number, chars, cut, edge = [], number + 1, 0, False, False
                elif held and (len(held) >= most_turns or chars + len(row[3]) > most_chars):
                    cut = True
                    close(True)
                    held, number, chars = [], number + 1, 0
                held.append(row)
                chars += len(row[3])
                if len(out) >= 1000 or sum(len(x[-1]) for x in out[-8:]) > most_chars:
                    yield flush()
        if held:
            close(True)  # the next range may go on with it
        if out:
            yield flush()

    return dealt.mapInArrow(run, schema)


class _Digest:
    """Counts and digests of a conversation, of one formatted text after another."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, mask: list[int]) -> _Digest:
        turns, masked = read_back(formatted, mask)
        for role, text in turns:
            self.turns.update(f"{role}\n{text}\n".encode())
        for text in masked:
            self.loss.update(text.encode())
        self.n_turns += len(turns)
        self.loss_chars += sum(map(len, masked))
        self.formatted_chars += len(formatted)
        return self

    def values(self) -> tuple[int, str, int, str, int]:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the mask by conversation, read back from the formatted texts of ``as_records``.

    A text that is a whole conversation is digested where it is.  The others are put in order and read one
    after another, since a digest takes its bytes in order; no more than one of them is held.
    """
    result = T._parse_datatype_string(DIGESTS)
    names = result.fieldNames()[1:]
    order = [formatted.schema[c] for c in ORDER]
    schema = T.StructType([*result, *order, *T._parse_datatype_string("formatted string, loss_mask array<long>")])

    def settle(batch: pa.RecordBatch) -> Iterator[dict]:
        whole = [not x for x in batch["open"].to_pylist()]
        pieces = list(zip(whole, batch["formatted"].to_pylist(), batch["loss_mask"].to_pylist()))
        found = [_Digest().add(text, mask).values() if done else (None,) * 5 for done, text, mask in pieces]
        left = {"formatted": [None if done else text for done, text, _ in pieces], "loss_mask": [None if done else mask for done, _, mask in pieces]}
        yield {"conv_id": batch["conv_id"]} | {n: list(x) for n, x in zip(names, zip(*found) if found else [[]] * 5)} | {c: batch[c] for c in ORDER} | left

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(result)
        own, digest = None, None
        for batch in batches:
            out = []
            for conv, done, *values, text, mask in zip(*(batch[c].to_pylist() for c in ("conv_id", "open", *names, "formatted", "loss_mask"))):
                if digest is not None and (not done or conv != own):
                    out.append((own, *digest.values()))
                    digest = None
                if not done:
                    out.append((conv, *values))
                else:
                    own, digest = conv, (digest or _Digest()).add(text, mask)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((own, *digest.values()), arrow)], schema=arrow)

    settled = map_batches(formatted.select("conv_id", "formatted", "loss_mask", *ORDER), settle, schema)
    return settled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "number").mapInArrow(finish, result)


ORACLE = r"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 10 + 1)::BIGINT AS formatted_chars
FROM every GROUP BY conv_id
"""
