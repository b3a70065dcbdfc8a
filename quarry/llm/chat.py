"""Chat formatting in budgeted windows that begin and end at turns.

Prefix sums of the turns' tokens choose the windows: a window takes new turns as long as the sum since its first one fits
what the budget leaves beside the system turn and the history. Each window after the first starts with the conversation's
system turn (its first turn, if its role is system) and with as many of the turns before it as `history` tokens hold. These
repeated turns are marked as such and outside the loss mask, which covers each assistant text exactly once.

A turn is written ``<|new|role|>text<|end|>``, a repeated one ``<|old|role|>text<|end|>``. In roles and texts ``&``, ``<``
and ``[`` become character references (in roles ``|`` too), so no control string of this or of another template, such as
``</s>`` or ``[INST]``, survives in them, and every text is read back exactly.

Rows are dealt by conversation and sorted; one pass then goes through each partition, holding one window and the history,
never a conversation, so a conversation of any length passes in bounded memory. (It does pass through one task: its turns
are one sequence. Only turns are read there; other columns aren't carried.)

Defined results: null role and null text are empty; turns of equal number go by role, then text; repeated rows are repeated
turns; a null conversation id is a conversation; a turn larger than the budget has a window of its own, marked over_budget;
no rows, no windows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import parts, table

BUDGET, HISTORY = 1024, 192
_TURN = re.compile(r"<\|(new|old)\|([^|<]*)\|>([^<]*)<\|end\|>")
_TOKEN = re.compile(r"\w+|[^\w\s]")
SCHEMA = StructType(
    [
        StructField("conv_id", LongType()), StructField("window", IntegerType()), StructField("first_turn", LongType()), StructField("n_new", IntegerType()), StructField("n_tokens", LongType()),
        StructField("text", StringType()), StructField("loss", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))), StructField("over_budget", BooleanType()),
    ]
)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    return text.replace("|", "&#124;") if role else text


def unescape(text: str) -> str:
    return text.replace("&#124;", "|").replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def count_tokens(text: str) -> int:
    """Words and marks: an estimate that needs no vocabulary. Another counter can be given."""
    return sum(1 for _ in _TOKEN.finditer(text)) + 4


class _Writer:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv, budget, history, count):
        self.conv, self.budget, self.limit, self.count = conv, budget, history, count
        self.system, self.recent, self.recent_sum = None, deque(), 0
        self.turn, self.window, self.total = 0, 0, 0  # total: the prefix sum of new turns' tokens
        self._open()

    def _open(self):
        self.first, self.before, self.n_new = self.turn, self.total, 0
        self.repeated = ([self.system] if self.system else []) + list(self.recent) if self.turn else []
        self.fixed = sum(n for _, _, n in self.repeated)
        self.new: list[tuple[str, str, int]] = []

    def add(self, role: str, text: str) -> Iterator[dict]:
        n = self.count(text)
        if self.new and self.total + n - self.before + self.fixed > self.budget:
            yield self.close()
            self._open()
        if not self.new:
            while self.repeated and self.fixed + n > self.budget and (len(self.repeated) > 1 or not self.system):
                self.fixed -= self.repeated.pop(1 if self.system else 0)[2]
        turn = (role, text, n)
        self.new.append(turn)
        self.total += n
        if not self.turn and role == "system":
            self.system = turn
        else:
            self.recent.append(turn)
            self.recent_sum += n
            while self.recent_sum > self.limit:
                self.recent_sum -= self.recent.popleft()[2]
        self.turn += 1

    def close(self) -> dict:
        out, loss, at = [], [], 0
        for kind, turns in (("old", self.repeated), ("new", self.new)):
            for role, text, _ in turns:
                head, body = f"<|{kind}|{escape(role, True)}|>", escape(text)
                if kind == "new" and role == "assistant" and body:
                    loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
                out += [head, body, "<|end|>"]
                at += len(head) + len(body) + 7
        n = self.fixed + self.total - self.before
        self.window += 1
        return {"conv_id": self.conv, "window": self.window - 1, "first_turn": self.first, "n_new": len(self.new), "n_tokens": n, "text": "".join(out), "loss": loss, "over_budget": n > self.budget}


def windows(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, count=count_tokens) -> DataFrame:
    """The windows, clustered by conversation and in order within each partition."""
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartition(parts(turns), "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    types = to_arrow_schema(SCHEMA)

    def run(batches):
        writer, out, size = None, [], 0
        for batch in batches:
            for c, r, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if writer is None or writer.conv != c:
                    if writer is not None:
                        out.append(writer.close())
                    writer = _Writer(c, budget, history, count)
                for w in writer.add(r, t):
                    out.append(w)
                    size += len(w["text"])
                if len(out) >= 1000 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=types)
                    out, size = [], 0
        if writer is not None:
            out.append(writer.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return rows.mapInArrow(run, SCHEMA)


def read_turns(text: str) -> Iterator[tuple[bool, str, str]]:
    """Of a window's text: for each turn whether it is new, its role and its text."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield m[1] == "new", unescape(m[2]), unescape(m[3])
    if at != len(text):
        raise ValueError(f"no turn at {at}")


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(written: DataFrame) -> DataFrame:
    """What windows() has written, read back: a row for each conversation. It relies on the order that windows() gives."""

    def run(batches):
        names = [x.split()[0] for x in _DIGESTS.split(", ")]
        state, out = None, []

        def row():
            conv, n, turns, chars, loss, size, count = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        def table_(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if "sha" in k else pa.int64()) for k, x in zip(names, columns, strict=True)], names=names)

        for batch in batches:
            for conv, text, loss in zip(*(batch.column(batch.schema.names.index(k)).to_pylist() for k in ("conv_id", "text", "loss")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, sha256(), 0, sha256(), 0, 0]
                for new, role, body in read_turns(text):
                    if new:
                        state[1] += 1
                        state[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state[3] += len(body)
                    state[4].update(body.encode())
                state[5] += len(text)
                state[6] += 1
            if len(out) > 1000:
                yield table_(out)
                out = []
        if state is not None:
            out.append(row())
        if out:
            yield table_(out)

    return written.select("conv_id", "text", "loss").mapInArrow(run, _DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    return digests(windows(turns.unionByName(own)))
