"""Chat formatting: a finite-state machine over roles and a declarative template, out as text segments with loss flags.

Every turn gives three segments: the opening mark with its role, the text, the closing mark.  The machine runs over the roles
of a conversation in turn order; its transition functions compose, so a conversation may be split over many tasks.  It judges
the order (``order_ok``, ``bad_turn``) and rejects nothing: all conversations are formatted.

Control strings inside texts are escaped reversibly: every control string begins with ``lead``, two different characters; in a
text, one more escape character goes between the two wherever they meet with any number of escape characters between them.
Afterwards no text holds ``lead``.  Role names are escaped in the same way, after ``escape`` itself and line feeds.

Rows: a null role or text is empty; rows without ``conv_id`` are one conversation without id; turns without number come first;
ties go by role, then text; a repeated row is one more turn.  Empty tables give no segments.  Other columns are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import turns
from .common import arrow_schema, batch_of, rows_of


@dataclass(frozen=True)
class Template:
    """Marks, roles under the loss, and the turn order: ``order[state][role]`` is the next state."""
    lead: str = "<|"
    escape: str = "\\"
    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    order: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"}})

    def __post_init__(self):
        if len(self.lead) != 2 or self.lead[0] == self.lead[1] or len(self.escape) != 1 or self.escape in self.lead + "n\n":
            raise ValueError("lead must be two different characters, and escape another one")
        if not (self.open.startswith(self.lead) and self.close.startswith(self.lead)):
            raise ValueError("control strings must begin with lead")
        unknown = {s for to in self.order.values() for s in to.values()} - set(self.order)
        if unknown or self.start not in self.order:
            raise ValueError(f"states without transitions: {sorted(unknown) or self.start}")

    def met(self, escapes: str) -> str:
        a, b, e = re.escape(self.lead[0]), re.escape(self.lead[1]), re.escape(self.escape)
        return f"({a}){escapes.format(e)}({b})"

    def escaped(self, text: Column) -> Column:
        """Java quoting: group 2 are the escape characters that are there already."""
        more = self.escape.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(text, self.met("({}*)"), f"$1{more}$2$3")

    def escaped_role(self, role: Column) -> Column:
        out = F.replace(role, F.lit(self.escape), F.lit(self.escape * 2))
        return self.escaped(F.replace(out, F.lit("\n"), F.lit(f"{self.escape}n")))

    def unescape(self, text: str) -> str:
        return re.sub(self.met("{0}({0}*)"), r"\1\2\3", text)

    def unescape_role(self, role: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role), flags=re.DOTALL)

    def machine(self) -> tuple[list[str], dict[str, list[int]], list[int]]:
        """States, for each role its transition function, and that of all other roles; the state after them is refusal."""
        states = list(self.order)
        refused = len(states)
        roles = {r for to in self.order.values() for r in to}
        return states, {r: [*[states.index(self.order[s][r]) if r in self.order[s] else refused for s in states], refused]
                        for r in roles}, [refused] * (refused + 1)


CHAT = Template()


def then(first: turns.State, second: turns.State) -> turns.State:
    """The transition function of one stretch after another."""
    return tuple(second[s] for s in first)


def segments(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """``conv_id, pos, segment, text, loss, order_ok``: the formatted text of a conversation is its segments in order."""
    states, moves, other = template.machine()
    unit = tuple(range(len(states) + 1))
    ordered = turns.running(turns.select(conversations), ["turn"], unit,
                            lambda state, role, _: then(state, moves.get(role, other)), then)
    ok = F.col("state")[states.index(template.start)] < len(states)
    marks = [(F.concat(F.lit(template.open), template.escaped_role(F.col("role")), F.lit("\n")), F.lit(False)),
             (template.escaped(F.col("text")), F.col("role").isin(*template.loss)), (F.lit(template.close), F.lit(False))]
    pieces = F.array(*[F.struct(F.lit(k).alias("segment"), t.alias("text"), on.alias("loss")) for k, (t, on) in enumerate(marks)])
    return ordered.select("conv_id", "pos", F.explode(pieces).alias("s"), ok.alias("order_ok")).select(
        "conv_id", "pos", "s.segment", "s.text", "s.loss", "order_ok")


def write(conversations: DataFrame, path: str, template: Template = CHAT) -> None:
    segments(conversations, template).write.parquet(path)


def parse(text: str, template: Template = CHAT) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    found = []
    for turn in text.split(template.close)[:-1]:
        if not turn.startswith(template.open):
            raise ValueError("a turn must begin with its opening mark")
        role, body = turn.removeprefix(template.open).split("\n", 1)
        found.append((template.unescape_role(role), template.unescape(body)))
    return found


def digests(spark: SparkSession, path: str, template: Template = CHAT) -> DataFrame:
    """Read formatted conversations back: counts and hashes of their turns and of the text under the loss.

    A hash needs the bytes of a conversation in order; they stream through one task, turn by turn, and are never gathered.
    """
    rows = spark.read.parquet(path)
    ordered = (rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos", "segment")
               .select("conv_id", "pos", "text", "loss", "order_ok"))
    ddl = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
           "order_ok boolean, bad_turn bigint")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, turn, pos, good = object(), [], "", 0, True
        n = chars = loss = bad = None
        whole = under = hashlib.sha256()

        def closed() -> list[tuple]:
            if n is None:
                return []
            if turn:
                raise ValueError(f"conversation {at} ends within a turn")
            return [(at, n, whole.hexdigest(), loss, under.hexdigest(), chars, bad is None, bad)]
        for batch in batches:
            for row in rows_of(batch):
                if n is None or row["conv_id"] != at:
                    out += closed()
                    at, n, chars, loss, bad = row["conv_id"], 0, 0, 0, None
                    whole, under = hashlib.sha256(), hashlib.sha256()
                turn += row["text"]
                chars += len(row["text"])
                if row["loss"]:
                    text = template.unescape(row["text"])
                    loss += len(text)
                    under.update(text.encode())
                if not row["order_ok"] and bad is None:
                    bad = row["pos"]
                if turn.endswith(template.close):  # no escaped text ends so
                    for role, text in parse(turn, template):
                        whole.update(f"{role}\n{text}\n".encode())
                        n += 1
                    turn = ""
            yield batch_of(out, schema)
            out = []
        yield batch_of(closed(), schema)
    return ordered.mapInArrow(run, ddl)
