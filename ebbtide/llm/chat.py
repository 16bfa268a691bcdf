"""Chat formatting of records of any known layout.

The field paths of a record, hashed, are its fingerprint. The fingerprint selects a declarative
mapping that says which fields are turns, roles and texts; unknown layouts give no turns and are
reported by a null `layout`. Turns become segments of a template,

    ### role: text</turn>

in which `#` after `#`, `/turn>` after `<`, and backslashes are escaped by a backslash, so control
strings never occur inside a text and unescaping gives back every character. The segments of a
conversation, in order, are its formatted text; each has the span of its loss-bearing text. They are
separate rows, so a conversation of any length passes through memory segment by segment.
"""

import hashlib
import json
import re
from itertools import combinations

import pyarrow as pa
from pyspark.sql import functions as F

# One mapping for each known layout. `turns`: path of a list of turns, each with a `role` and a
# `text` field; `fields`: (role, fields joined by a blank line). `optional` fields may be missing.
LAYOUTS = (
    {"name": "turn", "paths": ("role", "text"), "fields": (("=role", ("text",)),)},
    {"name": "messages", "paths": ("messages[].role", "messages[].content"), "turns": "messages", "role": "role",
     "text": "content", "optional": ("id", "system"), "lead": (("system", ("system",)),)},
    {"name": "from-value", "paths": ("conversations[].from", "conversations[].value"), "turns": "conversations",
     "role": "from", "text": "value", "optional": ("id", "system"), "lead": (("system", ("system",)),)},
    {"name": "instruction", "paths": ("instruction", "output"), "optional": ("id", "input", "system"),
     "fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "prompt-response", "paths": ("prompt", "response"), "optional": ("id", "system"),
     "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "prompt-completion", "paths": ("prompt", "completion"), "optional": ("id", "system"),
     "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "question-answer", "paths": ("question", "answer"), "optional": ("id", "context"),
     "fields": (("user", ("context", "question")), ("assistant", ("answer",)))},
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "conv_id long, turn long, part int, layout string, role string, text string"
SEGMENTS = "conv_id long, turn long, part int, segment string, loss_from int, loss_past int"
READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

BREAK = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
CLOSE = "</turn>\n"


def leaves(value, path=""):
    """Paths of all fields; lists count once and add []."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in leaves(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {p for v in value for p in leaves(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths):
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts):
    """Fingerprint -> mapping, one entry for each choice of optional fields."""
    known = {}
    for layout in layouts:
        extra = layout.get("optional", ())
        for n in range(len(extra) + 1):
            for some in combinations(extra, n):
                known.setdefault(fingerprint({*layout["paths"], *some}), layout)
    return known


def words(value):
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record, layout):
    """(role, text) of each turn of a record."""
    def joined(spec):
        for role, names in spec:
            texts = [words(record.get(n)) for n in names if n in record]
            if texts:
                yield words(record.get(role[1:])) if role[0] == "=" else role, "\n\n".join(t for t in texts if t)
    if "fields" in layout:
        return list(joined(layout["fields"]))
    each = [(words(t.get(layout["role"])), words(t.get(layout["text"]))) for t in record[layout["turns"]]]
    return list(joined(layout.get("lead", ()))) + [(ROLES.get(role, role), text) for role, text in each]


def turns(records, layouts=LAYOUTS):
    """Canonical turns of records (conv_id, turn, record), record being JSON. A record that is null,
    no JSON object or of an unknown layout gives one row with null layout, role and text."""
    def run(batches):
        known = registry(layouts)
        for batch in batches:
            out = []
            for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                layout = known.get(fingerprint(leaves(record))) if isinstance(record, dict) else None
                if layout is None:
                    out.append((conv, turn, 0, None, None, None))
                    continue
                out += [(conv, turn, part, layout["name"], role, said)
                        for part, (role, said) in enumerate(canonical(record, layout))]
            yield rows(out, [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()],
                       ["conv_id", "turn", "part", "layout", "role", "text"])
    return records.select("conv_id", "turn", "record").mapInArrow(run, TURNS)


def rows(out, kinds, names):
    cols = list(zip(*out)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def escape(text):
    return BREAK.sub(lambda m: "\\" + m.group(), text)


def unescape(text):
    return ESCAPED.sub(r"\1", text)


def segment(role, text, loss_roles):
    """(formatted turn, start and end of what the loss counts)."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}: "
    said = escape(text)
    past = len(head) + len(said) if role in loss_roles else len(head)
    return head + said + CLOSE, len(head), past


def format_turns(found, loss_roles=("assistant",)):
    """Segments of canonical turns; rows without a layout give none."""
    def run(batches):
        for batch in batches:
            out = [(conv, turn, part, *segment(role or "", text or "", loss_roles))
                   for conv, turn, part, role, text in zip(*(c.to_pylist() for c in batch.columns))]
            yield rows(out, [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()],
                       ["conv_id", "turn", "part", "segment", "loss_from", "loss_past"])
    known = found.where("layout is not null").select("conv_id", "turn", "part", "role", "text")
    return known.mapInArrow(run, SEGMENTS)


def parsed(text):
    """(role, text) read back from one segment."""
    head = HEAD.match(text)
    return unescape(head.group(1)), unescape(text[head.end():len(text) - len(CLOSE)])


class Reading:
    """Running digests of one conversation."""

    def __init__(self, conv):
        self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.counted = hashlib.sha256(), hashlib.sha256()

    def add(self, text, start, past):
        role, said = parsed(text)
        self.n += 1
        self.chars += len(text)
        self.all.update(f"{role}\n{said}\n".encode())
        masked = unescape(text[start:past])
        self.loss += len(masked)
        self.counted.update(masked.encode())

    def row(self):
        return self.conv, self.n, self.all.hexdigest(), self.loss, self.counted.hexdigest(), self.chars


def read_back(segments):
    """Digests of each conversation, read from its segments in order. Conversations pass through
    sorted partitions, of which only the running digests are kept. Segments of equal turn are
    ordered by their text; those without conv_id form one conversation."""
    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, text, start, past in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Reading(conv)
                now.add(text, start, past)
            yield out(done)
        if now is not None:
            yield out([now.row()])

    def out(found):
        return rows(found, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()],
                    ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")
    return ordered.select("conv_id", "segment", "loss_from", "loss_past").mapInArrow(run, READ)


def turn_records(conversations):
    """One record of the layout `turn` for each row of conversations (conv_id, turn, role, text)."""
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), record.alias("record"))
