"""Splitting oversized texts at natural boundaries.

A text above the limit is cut by a hierarchy of separators: section, paragraph, line,
sentence, word, character. Pieces are packed greedily: each reaches as far as the limit
allows and ends at the last boundary of the highest level in the second half of what
fits, or else of the first half. The next piece starts about ``overlap`` tokens before
that end, at a boundary again where there is one. Tokens are counted on each piece by
itself, with the automaton of ``tokenizer``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.tokenizer import SPLIT, TOKENIZERS, VOCABULARY, Automaton, automaton

#: Separators from the highest level down; a cut lies at the end of the match.
LEVELS = [
    regex.compile(r"\n[^\S\n]*\n(?:[^\S\n]*\n)+|\f|\n(?=#{1,6} )"),
    regex.compile(r"\n[^\S\n]*\n"),
    regex.compile(r"\n|\r"),
    regex.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』）]*"),
]
#: A word of more tokens than this is cut into runs of so many characters.
LONG_WORD, RUN = 64, 16


class Text:
    """Offsets, token counts and boundaries of one text."""

    def __init__(self, text: str, a: Automaton):
        self.text, self.a = text, a
        self.at, self.tokens, self.exact, self.plain = [0], [0], 0, True
        for m in SPLIT.finditer(text):
            n = len(a.encode_piece(m.group()))
            self.exact += n
            if n <= LONG_WORD:
                self._unit(m.end(), n)
            else:
                self.plain = False
                for i in range(m.start(), m.end(), RUN):
                    end = min(i + RUN, m.end())
                    self._unit(end, len(a.encode_piece(text[i:end])))
        self.levels: list[list[int]] | None = None

    def _unit(self, end: int, n: int) -> None:
        self.at.append(end)
        self.tokens.append(self.tokens[-1] + n)

    def bounds(self) -> list[list[int]]:
        if self.levels is None:
            self.levels = [[m.end() for m in r.finditer(self.text)] for r in LEVELS]
        return self.levels

    def count(self, start: int, end: int) -> int:
        """Tokens of text[start:end] by itself. Between unit ends only the last two units may split otherwise there than in
        the whole text (a run of white space is at most two), so the rest is looked up."""
        if self.plain:
            i, j = bisect_left(self.at, start), bisect_left(self.at, end)
            if j - i > 2 and self.at[i] == start and j < len(self.at) and self.at[j] == end:
                return self.tokens[j - 2] - self.tokens[i] + len(self.a.encode(self.text[self.at[j - 2] : end]))
        return len(self.a.encode(self.text[start:end]))

    def before(self, offset: int) -> int:
        """Tokens before an offset, by the units of the whole text."""
        return self.tokens[bisect_right(self.at, offset) - 1]

    def reach(self, start: int, limit: int) -> int:
        """The last unit end so far that text[start:end] has at most ``limit`` tokens."""
        k = bisect_right(self.tokens, self.before(start) + limit) - 1
        while self.at[k] > start:
            n = self.count(start, self.at[k])
            if n <= limit:
                return self.at[k]
            k -= max(1, (n - limit) // LONG_WORD)
        end = start + 1  # not one unit fits: single characters
        while end < len(self.text) and self.count(start, end + 1) <= limit:
            end += 1
        return end


def split_text(text: str, limit: int, overlap: int, a: Automaton) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, in order; they cover it."""
    t = Text(text, a)
    if t.exact <= limit:
        return [(0, len(text), t.exact)] if text else []
    out, start, done = [], 0, 0
    while True:
        end = t.reach(start, limit)
        if end < len(text):
            end = _cut(t, start, end, limit, overlap)
        if end <= done:  # the overlap leaves no room for anything new
            start = done
            continue
        out.append((start, end, t.count(start, end)))
        if end >= len(text):
            return out
        start, done = _restart(t, start, end, overlap), end


def _cut(t: Text, start: int, high: int, limit: int, overlap: int) -> int:
    """Where the piece that begins at ``start`` and could reach ``high`` ends."""
    from_start = lambda n: t.at[min(bisect_left(t.tokens, t.before(start) + n), len(t.at) - 1)]
    end = _natural(t, from_start(limit // 2), high) or _natural(t, from_start(2 * overlap), high) or high
    while t.count(start, end) > limit:  # a shorter piece may tokenize into more at its end
        i = bisect_left(t.at, end) - 1
        end = t.at[i] if t.at[i] > start else end - 1
    return end


def _natural(t: Text, low: int, high: int) -> int | None:
    """The last boundary of the highest level above words in (low, high]."""
    for level in t.bounds():
        i = bisect_right(level, high) - 1
        if i >= 0 and level[i] > low:
            return level[i]
    return None


def _restart(t: Text, start: int, end: int, overlap: int) -> int:
    """Where the piece after text[start:end] begins: about ``overlap`` tokens before the end."""
    if not overlap:
        return end
    upto = t.before(end)
    first, last = (t.at[bisect_left(t.tokens, max(upto - x, 0))] for x in (overlap * 3 // 2, overlap // 2))
    mid = t.at[bisect_left(t.tokens, max(upto - overlap, 0))]
    near = [x for level in t.bounds() for x in level[bisect_left(level, first) : bisect_right(level, last)] if start < x < end]
    if near:
        return min(near, key=lambda x: (abs(x - mid), x))
    return mid if start < mid < end else end


PIECE_COLUMNS = "piece_no int, start_char int, end_char int, n_tokens int, text string"


def split_oversized(
    df: DataFrame,
    id_column: str,
    text_column: str,
    *,
    limit: int = 1024,
    overlap: int = 64,
    keep_small: bool = False,
    with_text: bool = True,
    folder: str = TOKENIZERS,
    name: str = VOCABULARY,
) -> DataFrame:
    """(id, piece_no from 1, start_char, end_char, n_tokens, text): the pieces of every text
    of more than ``limit`` tokens; with ``keep_small`` also the others, each as one piece.

    Pieces have at most ``limit`` tokens by themselves, cover the text in order, and share
    about ``overlap`` tokens with the one before. Null and empty texts give no piece, a
    blank text counts like any other, repeated rows give repeated pieces, an empty table
    gives an empty result. Other columns are ignored. A map over the scan: no shuffle.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("overlap must be less than a quarter of the limit")
    kind = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(folder, name)
        for b in batches:
            ids, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if not text or not keep_small and len(text) * 4 <= limit:
                    continue  # a token has at least one byte, a character at most four
                if not keep_small and len(text) <= limit and len(text.encode("utf-8", "replace")) <= limit:
                    continue
                pieces = split_text(text, limit, overlap, a)
                if len(pieces) < 2 and not keep_small:
                    continue
                for k, (s, e, n) in enumerate(pieces, 1):
                    ids.append(i)
                    rows.append((k, s, e, n, text[s:e] if with_text else None))
                if len(rows) > 2000:
                    yield _batch(b, ids, rows)
                    ids, rows = [], []
            if rows:
                yield _batch(b, ids, rows)

    def _batch(b: pa.RecordBatch, ids: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        names = [id_column, "piece_no", "start_char", "end_char", "n_tokens", "text"]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), *cols], names=names)

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, {PIECE_COLUMNS}")
