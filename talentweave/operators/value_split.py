"""Several values packed in one field: a quote-aware tokenizer, one row per value.

The automaton keeps three things: the quote it is in, the stack of open brackets, and
whether the current piece has begun. Delimiters count only outside quotes and brackets. Where quotes
and brackets end is found in one pass for the whole field, so that the work grows with its length.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Delimiters, quotes and brackets of packed fields.
DELIMITERS = ",，、;；|｜/／·\t\n\r\x0b\x0c\x85  　"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "＂": "＂"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "［": "］", "【": "】", "{": "}", "｛": "｝", "《": "》", "〈": "〉"}

_DELIMITER = re.compile("[" + re.escape(DELIMITERS) + "]|[  ]{2,}")
_SPECIAL = re.compile("[" + re.escape("".join([*QUOTES, *BRACKETS])) + "]")
_BLANKS = "  　\t\r\n\x0b\x0c\x85  "


class _Ends:
    """Where quotes and brackets of a text end, found in one pass for each kind that is asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.runs: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.places: dict[str, list[int]] = {}
        self.brackets: dict[int, int] | None = None

    def _odd_runs(self, close: str) -> tuple[list[int], list[int], list[int]]:
        """Of the runs of a quote character, escaped ones left out: starts, ends, and the number of the next
        run of odd length from each on. Doubled quotes are content, so that only odd runs end anything."""
        if close not in self.runs:
            starts: list[int] = []
            ends: list[int] = []
            at, escaped = 0, False
            for at, char in enumerate(self.text):
                if char == close and not escaped:
                    if ends and ends[-1] == at:
                        ends[-1] = at + 1
                    else:
                        starts.append(at)
                        ends.append(at + 1)
                escaped = char == "\\" and not escaped
            following, later = [0] * len(starts), len(starts)
            for k in range(len(starts) - 1, -1, -1):
                later = k if (ends[k] - starts[k]) % 2 else later
                following[k] = later
            self.runs[close] = starts, ends, following
        return self.runs[close]

    def quote(self, start: int, close: str) -> int:
        """Index of the quote that ends the one opened before ``start``, or -1."""
        starts, ends, following = self._odd_runs(close)
        k = bisect_right(starts, start) - 1
        if k >= 0 and ends[k] > start:
            if (ends[k] - start) % 2:
                return ends[k] - 1
        k += 1
        if k >= len(starts) or following[k] >= len(starts):
            return -1
        return ends[following[k]] - 1

    def bracket(self, start: int) -> int:
        """Index of the bracket that closes the one at ``start``, with nesting; if nesting leaves it open, the
        next one of its kind; or -1."""
        if self.brackets is None:
            self.brackets = {}
            stack: list[int] = []
            for at, char in enumerate(self.text):
                if stack and char == BRACKETS[self.text[stack[-1]]]:
                    self.brackets[stack.pop()] = at
                elif char in BRACKETS:
                    stack.append(at)
        if (end := self.brackets.get(start)) is not None:
            return end
        close = BRACKETS[self.text[start]]
        if close not in self.places:
            self.places[close] = [k for k, c in enumerate(self.text) if c == close]
        places = self.places[close]
        k = bisect_right(places, start)
        return places[k] if k < len(places) else -1


def _blank(char: str) -> bool:
    return char in " \u00a0"


def _unescaped(inner: str, close: str) -> str:
    """The content of quotes: a doubled quote is one, and so is one behind a backslash."""
    return inner.replace("\\" + close, close).replace(close * 2, close)


def split_values(text: str | None) -> list[str]:
    """Values of a packed field, in order.

    None and blank fields hold none. A JSON array of strings holds its elements. Enclosing
    quotes and outer blanks are taken off, brackets stay, a doubled quote within quotes is
    one quote, as is one behind a backslash. A quote or bracket without its partner is an ordinary
    character. Empty pieces are no values; repeated ones count each time. The automaton goes over the
    text once, from one state to the next: between values, in a value, in quotes, in brackets.
    """
    if text is None:
        return []
    bare = text.strip(_BLANKS)
    if not bare:
        return []
    if bare[0] == "[" and bare[-1] == "]":
        try:
            items = json.loads(bare)
        except (ValueError, RecursionError):
            items = None
        if isinstance(items, list) and all(isinstance(x, str) for x in items):
            return [y for x in items if (y := x.strip(_BLANKS))]
    if not _SPECIAL.search(text):
        return [y for x in _DELIMITER.split(text) if (y := x.strip(_BLANKS))]
    values: list[str] = []
    ends, size = _Ends(text), len(text)
    at = start = 0
    begun, unquoted = False, None

    def close_piece(end: int) -> None:
        value = text[start:end].strip(_BLANKS) if unquoted is None else unquoted.strip(_BLANKS)
        if value:
            values.append(value)

    while at < size:
        char = text[at]
        if char in DELIMITERS or (_blank(char) and at + 1 < size and _blank(text[at + 1])):
            close_piece(at)
            at += 1
            start, begun, unquoted = at, False, None
            continue
        if char in QUOTES and (not begun or char not in "\"'＂"):
            close = QUOTES[char]
            end = ends.quote(at + 1, close)
            if end >= 0:
                behind = end + 1
                more = behind + 1 if behind < size and _blank(text[behind]) else behind
                if not begun and (more >= size or text[more] in DELIMITERS or (more > behind and _blank(text[more]))):
                    unquoted = _unescaped(text[at + 1 : end], close)
                begun, at = True, behind
                continue
        elif char in BRACKETS:
            end = ends.bracket(at)
            if end >= 0:
                begun, at = True, end + 1
                continue
        begun = begun or char not in _BLANKS
        at += 1
    close_piece(size)
    return values


def split_field(df: DataFrame, id_col: str, field: str, pos_col: str = "tag_pos", value_col: str = "tag_value") -> DataFrame:
    """One row per value of ``field``: the id, the place from 1, the value.

    A narrow map, so neither hot rows nor long fields need a shuffle. Null and blank fields
    give no row, an empty table gives an empty result, other columns are dropped.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{pos_col}` int, `{value_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots, values = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = split_values(text)
                ids.extend([row] * len(found))
                spots.extend(range(1, len(found) + 1))
                values.extend(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(spots, pa.int32()), pa.array(values, pa.string())], [id_col, pos_col, value_col]
            )

    return df.select(F.col(id_col), F.col(field)).where(F.col(field).isNotNull()).mapInArrow(run, schema)
