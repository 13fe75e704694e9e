"""Byte-level BPE as a deterministic automaton.

``compile_merges`` builds the automaton of correct token sequences by adding one merge
gadget after the other. States are the token read last, arcs are labelled with tokens.
At first every byte follows every byte. The gadget of the merge u v -> w deletes the arc
u -> v, and adds a state w that is entered wherever u was entered and left wherever v was
left. Arcs are inherited, so the automaton is kept as three tables (left[w] = u,
right[w] = v, and the deleted arcs with their rank) and an arc is looked up by walking
these, with the answers kept. For u = v the entries of u are inherited after the deletion
and its exits before it, which is what makes runs such as aaa come out as (aa, a).

``Automaton.encode`` reads a pre-split word by table-driven byte transitions: a trie of
the vocabulary read backwards gives the tokens that end at a position, and the one whose
arc from the state at its start exists is the only correct one. Following the states back
and emitting the arc labels gives the ids; ``decode`` emits the bytes of each label.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie; a parameter of every operator.
TOKENIZERS = os.environ.get("COLLOQUY_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a worker keeps, and the longest such word in bytes; beyond that the memory is emptied.
MEMO_WORDS, MEMO_BYTES = 400_000, 64
#: Arcs whose answers a worker keeps; beyond that they are forgotten.
KNOWN_ARCS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """States and arcs; see the module's text."""

    def __init__(self, size: int):
        self.left: list[int] = [-1] * size
        self.right: list[int] = [-1] * size
        self.born: list[int] = [0] * size
        self.deleted: dict[int, int] = {}
        self.label: list[bytes] = [b""] * size
        self.start: list[int] = [-1] * 256
        self.root: dict = {}
        self.known: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}

    def add_byte(self, token: int, byte: int) -> None:
        self.label[token] = bytes([byte])
        self.start[byte] = token
        self._index(token)

    def add_gadget(self, u: int, v: int, w: int, rank: int) -> None:
        self.left[w], self.right[w], self.born[w] = u, v, rank
        self.label[w] = self.label[u] + self.label[v]
        self.deleted[u << 20 | v] = rank
        self._index(w)

    def _index(self, token: int) -> None:
        node = self.root
        for b in reversed(self.label[token]):
            node = node.setdefault(b, {})
        node[-1] = token

    def arc(self, a: int, b: int) -> bool:
        """Whether token b may follow token a once all merges are done."""
        key = a << 20 | b
        if (ok := self.known.get(key)) is None:
            if len(self.known) >= KNOWN_ARCS:
                self.known.clear()
            ok = self.known[key] = self._arc(a, b, 1 << 40)
        return ok

    def _arc(self, a: int, b: int, time: int) -> bool:
        """Whether the arc exists after all merges of rank below ``time``."""
        left, right, born, deleted = self.left, self.right, self.born, self.deleted
        while True:
            if deleted.get(a << 20 | b, time) < time:
                return False
            if born[a] > born[b] or (born[a] == born[b] and born[a] > 0):
                # a is younger (or both are w of one merge u v): exits of a are those of its right part,
                # before its own deletion
                if born[a] == born[b]:
                    # w -> w: enter w as u was entered, after the deletion of u -> v, from an exit of v before it
                    time = born[a]
                    a, b = right[a], left[b]
                    continue
                time = born[a]
                a = right[a]
            elif born[b] > 0:
                time = born[b] + 1
                b = left[b]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        n, root, arc = len(word), self.root, self.arc
        if not n:
            return []
        last = [-1] * (n + 1)
        for end in range(1, n + 1):
            node, i, best = root, end - 1, -1
            while i >= 0:
                node = node.get(word[i])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None and (i == 0 or arc(last[i], t)):
                    best = t
                    break
                i -= 1
            last[end] = best
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(self.label[last[end]])
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            ids = self.encode_word(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty give an empty list."""
        if not text:
            return []
        out: list[int] = []
        memo, piece = self.memo, self.encode_piece
        for w in SPLIT.findall(text):
            out += memo.get(w) or piece(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the arc labels."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


SPLIT = regex.compile(PATTERN)


def compile_merges(vocab: dict[str, int], merges: list) -> Automaton:
    """The automaton of a vocabulary and its merges, in the order of their rank."""
    alphabet = byte_alphabet()
    a = Automaton(max(vocab.values()) + 1)
    for ch, byte in alphabet.items():
        if ch in vocab:
            a.add_byte(vocab[ch], byte)
    for rank, m in enumerate(merges, 1):
        u, v = m if isinstance(m, list) else m.split(" ")
        a.add_gadget(vocab[u], vocab[v], vocab[u + v], rank)
    return a


@lru_cache(maxsize=2)
def automaton(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Automaton:
    """The compiled automaton; built once in each Python process."""
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        model = json.load(f)["model"]
    return compile_merges(model["vocab"], model["merges"])


def _lists(values: list[list[int]]) -> pa.Array:
    offsets, flat = [0], []
    for v in values:
        flat += v
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(df: DataFrame, id_column: str, text_column: str, *, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens.

    The strings of special tokens in a text are ordinary text. Null and empty texts give
    an empty list, blank texts are encoded as they are, repeated rows stay repeated, an
    empty table gives an empty result. Other columns are ignored. A map over the scan:
    no shuffle; whole texts of any length.
    """
    kind = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(folder, name)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                ids = _lists([a.encode(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
