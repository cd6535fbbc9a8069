"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text. The turns' successive prefixes are rendered and consecutive outputs compared: what they share is
kept, what follows is the new turn's piece. Where a turn's own text lies in the output is found by rendering the turn with two one-letter
texts: the outputs differ from the text's first character on and agree again after its last. A template that rewrites history shows in
an output that no longer begins with the turns before; such turns are marked, and each row still says exactly how to edit the output before it.

A template gets all turns of a conversation, however many they are. Only a ``TurnByTurn`` is asked for the last turns alone: it is made so that the turns
before cannot change what they show, nor be changed by them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

#: Turns of a ``TurnByTurn`` that are rendered together. A longer conversation goes in windows of so many turns; each begins with the last turn of the one before.
WINDOW = 64
#: The control strings of the template below, and the escape character before them.
BEGIN, BETWEEN, END, ESCAPE = "### ", ": ", "</turn>\n", "\\"
_CONTROL, _IN_ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
_TURN = re.compile(r"### ([^\\:]*+(?:(?:\\.|:(?! ))[^\\:]*+)*+): ([^\\<]*+(?:(?:\\.|<(?!/turn>))[^\\<]*+)*+)</turn>\n", re.S)


def escaped(text: str, control: re.Pattern = _CONTROL) -> str:
    """The text with an escape character before each control string; ``unescaped`` gives it back."""
    return control.sub(lambda m: ESCAPE + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class TurnByTurn:
    """A template that shows one turn after the other. ``shown`` gives a turn's piece from its role and text and nothing else."""

    def __init__(self, shown: Callable[[str, str], str]):
        self.shown = shown

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(self.shown(role, text) for role, text in turns)


def _plain(role: str, text: str) -> str:
    return f"{BEGIN}{escaped(role, _IN_ROLE)}{BETWEEN}{escaped(text)}{END}"


#: Each turn as ``### role: text</turn>`` and a line end, roles and texts escaped.
plain_template = TurnByTurn(_plain)


def parsed(output: str) -> list[Turn]:
    """The turns of an output of ``plain_template``."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


def _shared(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0  # a[:low] == b[:low], a[:n] != b[:n]
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


class Renderer:
    """The pieces of one conversation after the other, turn by turn; of a ``TurnByTurn`` a window is in memory at a time, else the conversation."""

    def __init__(self, template: Template, window: int = WINDOW):
        self.template, self.window = template, window if isinstance(template, TurnByTurn) else None
        self.reset()

    def reset(self) -> None:
        self.turns: list[Turn] = []
        self.output = ""
        self.fixed = 0  # where the last turn's own text ends
        self.before = 0  # characters of the whole output in front of the window's

    def _place(self, role: str, text: str, output: str) -> tuple[int, int] | None:
        """Where the last turn's text lies in the output; None if the template does not show it as it shows single letters."""
        a, b = (self.template([*self.turns, (role, letter)]) for letter in "AB")
        start = _shared(a, b)
        tail = len(a) - start - 1
        if len(a) != len(b) or a[start + 1 :] != b[start + 1 :] or len(output) < start + tail or output[:start] != a[:start] or output[len(output) - tail :] != a[start + 1 :]:
            return None
        return start, len(output) - tail

    def add(self, role: str, text: str) -> tuple[int, str, int, int, bool]:
        """(characters kept of the output before, the piece behind them, the text's span, whether history was rewritten)."""
        if self.window is not None and len(self.turns) >= self.window:  # the last turn goes with the new ones
            alone = self.template(self.turns[-1:])
            if not self.output.endswith(alone):
                raise ValueError("this template shows a turn otherwise when others stand before it")
            gone = len(self.output) - len(alone)
            self.turns, self.output = self.turns[-1:], alone
            self.before, self.fixed = self.before + gone, self.fixed - gone
        output = self.template([*self.turns, (role, text)])
        span = self._place(role, text, output)
        keep = _shared(self.output, output)
        rewrites = keep < self.fixed
        self.turns.append((role, text))
        start, end = span or (len(output), len(output))
        piece, base = output[keep:], self.before
        self.output, self.fixed = output, end
        return base + keep, piece, base + start, base + end, rewrites


def format_turns(spark: SparkSession, turns: DataFrame, template: Template = plain_template, id: str = "conv_id", window: int = WINDOW) -> DataFrame:
    """A row per turn, in order: id, ``place`` (from 0), ``role``, ``keep``, ``piece``, ``start``, ``end``, ``rewrites``.

    A conversation's output after a turn is the first ``keep`` characters of the output before, then ``piece``; its text, as the template writes it, lies in [start, end)
    of that output (an empty span at the end where the template does not show it). ``rewrites``: the turn changed what the turns before it had shown.
    Turns go by ``turn``, then role and text; null turns first. Null roles and texts count as empty. Rows with a null id are one conversation;
    repeated rows are turns of their own. Texts are rendered whole. An empty table gives an empty table; other columns are not read.

    Rows are sorted by conversation and turn and read as a stream. A template is called with all turns so far, so that it can rewrite, and is caught rewriting, any turn:
    one conversation is in memory and its work grows with the square of its turns. A ``TurnByTurn`` gives the same rows in the memory and time of ``window`` turns a call,
    for conversations of any length; for other templates ``window`` has no meaning.
    """
    kind = turns.schema[id].dataType.simpleString()
    empty = F.lit("")
    rows = turns.select(F.col(id).alias("id"), "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer, now, place = Renderer(template, window), object(), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            held = 0
            for id, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if id != now:
                    renderer.reset()
                    now, place = id, 0
                role = role.as_py()
                keep, piece, start, end, rewrites = renderer.add(role, text.as_py())
                for column, value in zip(out, (id, place, role, keep, piece, start, end, rewrites)):
                    column.append(value)
                place += 1
                held += len(piece)
                if held > 4 << 20:
                    yield _turn_rows(out, batch.schema.field(0).type)
                    out, held = [[] for _ in range(8)], 0
            yield _turn_rows(out, batch.schema.field(0).type)

    names = f"id {kind}, place long, role string, keep long, piece string, start long, end long, rewrites boolean"
    return rows.mapInArrow(work, names).withColumnRenamed("id", id)


def _turn_rows(columns: list[list], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["id", "place", "role", "keep", "piece", "start", "end", "rewrites"])


class _Reading:
    """What is read back from one conversation's pieces, piece by piece."""

    def __init__(self, id: object, learned: str):
        self.id, self.learned = id, learned
        self.n = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, keep: int, piece: str, start: int, end: int) -> None:
        if keep != self.chars:
            raise ValueError("this template's outputs do not grow turn by turn")
        for role, text in parsed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == self.learned:
                under = unescaped(piece[start - keep : end - keep])
                self.loss.update(under.encode())
                self.loss_chars += len(under)
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, id: str = "conv_id", learned: str = "assistant") -> DataFrame:
    """A row per conversation, read from the outputs of ``plain_template``: id, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    ``formatted``: what ``format_turns`` gives (its order is kept, nothing moves). The loss mask is the spans of turns with the role ``learned``.
    """
    kind = formatted.schema[id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        for batch in batches:
            done = []
            for id, keep, piece, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4))):
                if now is None or id != now.id:
                    done += [now.row()] if now else []
                    now = _Reading(id, learned)
                now.add(keep, piece.as_py(), start, end)
            if done:
                yield _conversation_rows(done, batch.schema.field(0).type)
        if now:
            yield _conversation_rows([now.row()], batch.schema.field(0).type)

    names = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col(id).alias("id"), "keep", "piece", "start", "end").mapInArrow(work, names).withColumnRenamed("id", id)


def _conversation_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
