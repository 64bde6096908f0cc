"""Chat formatting in budgeted windows.

A turn is written as ``<|turn|>role<|text|>text<|end|>``; control strings and backslashes inside roles and texts are escaped
reversibly, so no text can open or close a turn. A conversation is cut into windows of whole turns: prefix sums of the turns'
tokens, of what is repeated and then of each new turn, say where a window is full, and how many of the last turns, at most ``HISTORY`` and half the budget, the next window
repeats. Every window starts with the conversation's leading system turn. Loss spans cover the texts of assistant turns where
they are new; repeated ones have none, so each counts once. A turn above the budget stands whole in a window of its own, with
what is repeated left out.

Rows come sorted by conversation and turn, and one pass over the sorted partitions holds a window at a time, however
long a conversation is. A window's first turn follows from all windows before it, so a conversation is one task's work. Rows of a conversation with equal turns are ordered by role and text; a null text or role counts as
empty; null turns come first; rows with a null conversation form one conversation. Windows of a conversation stand together and in order in
their partition. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import pieces_of, small_batches, stored

BUDGET, HISTORY = 1024, 2
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a model's template gives a meaning.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ESCAPED = {"\\": "\\\\"} | {c: f"\\{chr(97 + k)}" for k, c in enumerate(CONTROLS)}
_PLAIN = {e: c for c, e in _ESCAPED.items()}
_TO_ESCAPE, _TO_PLAIN = re.compile("|".join(map(re.escape, _ESCAPED))), re.compile(r"\\.", re.S)
_READ = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
_WINDOW = "number int, first_turn long, repeated int, tokens long, formatted string, loss array<struct<start:int,end:int>>"

_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _TO_PLAIN.sub(lambda m: _PLAIN[m[0]], text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _READ.finditer(formatted)]


class Windows:
    """Cuts one conversation, turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: list[tuple] = []
        self.kept: list[tuple] = []  # what the window repeats besides the system turn
        self.new: list[tuple] = []
        self.sums: list[int] = []  # of the tokens of what is repeated, then with each new turn
        self.number = self.turns = 0

    def add(self, role: str, text: str, written: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, written, tokens)
        if self.new and self.sums[-1] + tokens > self.budget:
            yield self._window()
            past = [*self.kept, *self.new][-self.history :] if self.history else []
            past = [t for t in past if t not in self.system]
            room = min(self.budget // 2, self.budget - tokens - sum(t[3] for t in self.system))
            sums = [0, *accumulate(t[3] for t in past)]
            # the longest run of last turns that fits: sums[-1] - sums[k] <= room
            self.kept = past[bisect_left(sums, sums[-1] - room) :] if room >= 0 else []
            self.new, self.sums = [], []
        if not self.turns and role == "system":
            self.system = [turn]
        self.turns += 1
        self.new.append(turn)
        self.sums = self.sums or [sum(t[3] for t in [*self._lead(), *self.kept])]
        self.sums.append(self.sums[-1] + tokens)

    def _lead(self) -> list[tuple]:
        """The system turn, from the second window on; left out before a turn that is too long with it."""
        if not self.number or not self.system:
            return []
        return self.system if self.system[0][3] + self.new[0][3] <= self.budget else []

    def _window(self) -> tuple:
        again = [*self._lead(), *self.kept]
        out, loss, at = [], [], 0
        for k, (role, _, written, _) in enumerate([*again, *self.new]):
            if role == "assistant" and k >= len(again):
                loss.append({"start": at + written.index(TEXT) + len(TEXT), "end": at + len(written) - len(END)})
            out.append(written)
            at += len(written)
        row = (self.number, self.turns - len(self.new), len(again), self.sums[-1], "".join(out), loss)
        self.number += 1
        return row

    def end(self) -> Iterator[tuple]:
        if self.new:
            yield self._window()


def windows(df: DataFrame, tokenizer: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of all conversations: ``key``, number, first_turn (of the new ones), repeated (turns in front of them),
    tokens, formatted, and loss, the spans of characters that are trained on."""
    rows = df.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = pa.schema([("number", pa.int32()), ("first_turn", pa.int64()), ("repeated", pa.int32()), ("tokens", pa.int64()), ("formatted", pa.string()), ("loss", _LOSS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        count = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        conv, state = None, None
        for b in chain.from_iterable(map(pieces_of, batches)):
            roles, texts, out = b["role"].to_pylist(), b["text"].to_pylist(), []
            schema = kind.insert(0, b.schema.field("conv"))
            written = [f"{TURN}{escape(r)}{TEXT}{escape(t)}{END}" for r, t in zip(roles, texts, strict=True)]
            tokens = map(len, count.encode(written, num_threads=1))
            for row in zip(b["conv"].to_pylist(), roles, texts, written, tokens, strict=True):
                if state is None or row[0] != conv:
                    if state is not None:
                        out += [(conv, *w) for w in state.end()]
                    conv, state = row[0], Windows(budget, history)
                out += [(conv, *w) for w in state.add(*row[1:])]
            yield _batch(out, schema)
        if state is not None:
            yield _batch([(conv, *w) for w in state.end()], schema)

    out = rows.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, {_WINDOW}")
    return out.withColumnRenamed("conv", key)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from windows as ``windows`` gives them, one row for each conversation."""
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    kinds = [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row() -> tuple:
            return (state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"], state["windows"])

        for b in chain.from_iterable(map(pieces_of, batches)):
            out, schema = [], pa.schema([b.schema.field("conv"), *(pa.field(*k) for k in kinds)])
            columns = (b[c].to_pylist() for c in ("conv", "number", "repeated", "formatted", "loss"))
            for conv, number, repeated, text, loss in zip(*columns, strict=True):
                if number == 0:
                    if state:
                        out.append(row())
                    state = {"conv": conv, "turns": 0, "chars": 0, "formatted": 0, "windows": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, said in read_back(text)[repeated:]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["formatted"] += len(text)
                state["windows"] += 1
            yield _batch(out, schema)
        if state:
            yield _batch([row()], schema)

    kind = formatted.schema[key].dataType.simpleString()
    rows = formatted.select(F.col(key).alias("conv"), "number", "repeated", "formatted", "loss")
    return rows.mapInArrow(run, f"conv {kind}, {fields}").withColumnRenamed("conv", key)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    with small_batches(spark):
        return stored(digests(windows(said.unionByName(more), public_tokenizers.path("piece_bpe_32k.model"))), "chat-digests")
