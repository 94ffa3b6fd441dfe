"""Chat formatting in budgeted, turn-aligned windows.

A conversation's turns, in order of (turn, role, text), are cut into windows
of at most ``budget`` tokens. Every window starts with the conversation's
system turns; then come repeated turns, the longest run of turns right before
the window's new ones whose tokens fit ``history``, shortened from its front
where the new turns need the room; then as many new turns as fit, found by
searching the prefix sums of the turns' tokens. Assistant turns are targets in
the window where they are new, and masked where they are repeated; system and
user turns are always masked.

A turn is rendered as ``<|role|>``, its text and ``<|end|>``, each on lines of
their own. The pre-tokeniser splits before and behind the single newline that
ends a turn, whatever stands next, so no token spans two turns and a window's
text has exactly as many tokens as its turns together (byte-level BPE).
``<|`` within a text is written ``<||``, so that text never reads as a turn
(``unescape`` undoes it); in a role, what isn't a letter, digit, ``_`` or ``-``
is written ``_``. Turns are never cut: a new turn that doesn't fit beside the
system turns is a window of its own, without history, and ``over_budget`` says
so.

Turns are streamed: a task holds a conversation's system turns, which all its
windows repeat, and the turns of one window, however long the conversation.

Defined results: turns with null conv_id are one conversation; a null turn
number comes first, a null or empty role is rendered as 'user', null text as
''. Repeated rows are turns each. A conversation that has only system turns is
one window. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUDGET = 1024
HISTORY = 256


def tokenizer(path: str | None = None):
    """The public byte-level BPE vocabulary at ``path`` (default: the installed one)."""
    import public_tokenizers as public
    import tiktoken

    path = path or public.path("byte_bpe_50k.tiktoken")
    if path not in _made:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _made[path] = tiktoken.Encoding(path, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


_made: dict = {}


def render(role: str | None, text: str | None) -> str:
    return f"<|{re.sub(r'[^\w-]', '_', role or 'user')}|>\n{(text or '').replace('<|', '<||')}\n<|end|>\n"


def unescape(text: str) -> str:
    """A turn's text as it was before ``render``."""
    return text.replace("<||", "<|")


class Cutter:
    """Cuts a stream of turns into windows; it holds those from the history of the next window on."""

    def __init__(self, lead: int, budget: int, history: int):
        self.room, self.history = budget - lead, history
        self.turns: list = []
        self.upto, self.new = [0], 0

    def push(self, turn, size: int):
        """The windows that are settled once this turn is known, as (turns, number of repeated ones, over budget)."""
        self.turns.append(turn)
        self.upto.append(self.upto[-1] + size)
        yield from self._settled(False)

    def close(self):
        """The windows that are left."""
        yield from self._settled(True)

    def _settled(self, last: bool):
        while self.new < len(self.turns):
            upto, new = self.upto, self.new
            # The first new turn must fit behind the history; the history gives way for it.
            first = bisect_left(upto, upto[new] - self.history, 0, new + 1)
            first = max(first, min(new, bisect_left(upto, upto[new + 1] - self.room, 0, new + 1)))
            end = bisect_right(upto, upto[first] + self.room) - 1
            over = end <= new
            if over:
                first, end = new, new + 1
            elif end == len(self.turns) and not last:
                return  # the next turn may still fit
            yield self.turns[first:end], new - first, over
            # Later histories start here at the earliest.
            gone = bisect_left(upto, upto[end] - self.history, 0, end + 1)
            self.turns, self.upto, self.new = self.turns[gone:], upto[gone:], end - gone


def windows(system: list[int], sizes: list[int], budget: int, history: int) -> list[tuple[int, int, int, bool]]:
    """(first turn, first new turn, end, over budget) of each window, over the turns that are not the system's.

    ``system`` and ``sizes`` are token counts.
    """
    cutter, out = Cutter(sum(system), budget, history), []
    if not sizes:
        return [(0, 0, 0, cutter.room < 0)] if system else []
    for k, size in enumerate(sizes):
        out += cutter.push(k, size)
    out += cutter.close()
    return [(turns[0], turns[old], turns[-1] + 1, over) for turns, old, over in out]


_DDL = "conv_id {id}, window int, turns array<{turn}>, targets array<boolean>, n_tokens int, target_tokens int, over_budget boolean, text string"


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, window, turns, targets, n_tokens, target_tokens, over_budget, text) of every conversation."""
    spark = common.tune(conversations.sparkSession)
    kinds = conversations.schema
    ddl = _DDL.format(id=kinds["conv_id"].dataType.simpleString(), turn=kinds["turn"].dataType.simpleString())

    def run(it):
        enc = tokenizer(vocabulary)
        rows: list = []
        key, system, cutter, number = (), [], None, 0

        def add(turns, old, over):
            nonlocal number
            every = system + turns
            targets = [k >= len(system) + old and t[1] == "assistant" for k, t in enumerate(every)]
            rows.append((key, number, [t[0] for t in every], targets, sum(t[3] for t in every), sum(t[3] for t, on in zip(every, targets) if on), over, "".join(t[2] for t in every)))
            number += 1

        def close():
            if cutter is not None:
                for found in cutter.close():
                    add(*found)
            elif system:
                add([], 0, sum(t[3] for t in system) > budget)

        def give():
            got, rows[:] = list(rows), []
            cols = list(zip(*got)) if got else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, types)], names=names)

        names, types = ["conv_id", "window", "turns", "targets", "n_tokens", "target_tokens", "over_budget", "text"], None
        for batch in it:
            if types is None:
                types = [batch.schema.field("conv_id").type, pa.int32(), pa.list_(batch.schema.field("turn").type), pa.list_(pa.bool_()), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            convs, turns, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))
            texts = [render(r, t) for r, t in zip(roles, texts)]
            for conv, turn, role, text, tokens in zip(convs, turns, roles, texts, enc.encode_ordinary_batch(texts, num_threads=1)):
                if conv != key:
                    close()
                    key, system, cutter, number = conv, [], None, 0
                if role == "system":
                    system.append((turn, role, text, len(tokens)))
                    continue
                cutter = cutter or Cutter(sum(t[3] for t in system), budget, history)
                for found in cutter.push((turn, role, text, len(tokens)), len(tokens)):
                    add(*found)
                if len(rows) >= 256:
                    yield give()
        close()
        if rows:
            yield give()

    turns = conversations.select("conv_id", "turn", "role", "text").repartition(common.parts(spark), "conv_id")
    lead = F.coalesce(F.col("role") == "system", F.lit(False)).desc()
    ordered = turns.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), lead, F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(common.lean(run), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_windows(common.table(spark, sf_dir, "conversations"))
