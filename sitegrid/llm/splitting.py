"""Splitting oversized texts at natural boundaries, with pointer doubling over successor tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.tokens import VOCABULARY, tokenizer_of

LIMIT, OVERLAP = 1000, 100
#: Tokens of texts whose successor tables are squared together.
TOGETHER = 1_000_000
#: A piece other than the last has at least this share of the limit: natural places before that are passed over.
LEAST_FILL = 0.5
#: What a piece ends at, from the least natural to the text's own end.
KINDS = ("character", "word", "clause", "line", "sentence", "paragraph", "end")
#: Abbreviations of places, titles and numbers after which a full stop ends no sentence.
ABBREVIATIONS = tuple("kab kec kel no rp jl dr ir hj dll mr mrs st".split())
_BREAK = rb"(?>\r\n|\r|\n)"
_LINE, _PARAGRAPH = re.compile(_BREAK + rb"\s*"), re.compile(_BREAK + rb"[ \t]*" + _BREAK + rb"\s*")


@lru_cache(maxsize=8)
def _sentence(abbreviations: tuple[str, ...]) -> re.Pattern:
    """The end of a sentence: its marks and closing quotes, before white space."""
    return re.compile(b"(?i)" + b"".join(rb"(?<!\b%s)" % re.escape(a.encode()) for a in abbreviations) + rb"(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc[\x81\x9f])+(?:[\"')\]]|\xe2\x80[\x99\x9d]|\xc2\xbb)*(?=\s)")


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_COMMA = np.zeros(256, bool)
_COMMA[[ord(c) for c in ",;:"]] = True


def _latest(marks: np.ndarray) -> np.ndarray:
    """For each place the last marked place at or before it."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks), dtype=np.int32), -1))


def successors(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place (a cut, as a number of tokens) where the piece that starts ``overlap`` before it starts and ends.

    Places of several texts stand one after the other; ``first`` and ``last`` give each place's text. ``levels`` mark
    natural places from the most natural kind on, the last one all places between characters. Each place is joined to
    the farthest legal one: the last of the most natural kind within ``limit`` tokens of the start that lies LEAST_FILL of
    the limit beyond it at least (and beyond the place itself and, in the first piece, beyond what the next one shares with
    it). A start in the midst of a character moves back to its beginning. A text's last place is its own successor.
    """
    here = np.arange(len(first), dtype=np.int32)
    at_char = _latest(levels[-1])
    start = np.where(here == first, here, at_char[np.maximum(here - overlap, first)])
    reach = np.minimum(start + limit, last)
    end = np.where(reach == last, last, -1)
    least = np.maximum(np.maximum(here, first + overlap), start + int(limit * LEAST_FILL) - 1)
    for marks in levels:
        end = np.where(end > least, end, _latest(marks)[reach])
    # no place between characters in the second half: a limit of a few tokens
    end = np.where(end > np.maximum(here, first + overlap), end, at_char[reach])
    return start, np.where(here == last, last, np.maximum(end, np.minimum(here + 1, last))).astype(np.int32)


def greedy_cuts(after: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places that a walk along ``after`` from any of ``starts`` visits, found by squaring the table.

    With ``after`` to the power 2**k, the set of places visited in fewer than 2**k steps grows to those in fewer than
    2**(k+1); so a text of n pieces takes log2(n) rounds, all texts and all their pieces at once.
    """
    visited = starts
    while True:
        visited = np.unique(np.concatenate([visited, after[visited]]))
        if (after[starts] == ends).all():
            return np.unique(np.concatenate([visited, ends]))
        after = after[after]


def _places(ids: np.ndarray, data: bytes, bytes_of: np.ndarray, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> tuple[np.ndarray, ...]:
    """Byte offset of each place between tokens, and whether it ends a paragraph, a sentence, a line, a clause, a word, a
    character."""
    offset = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(bytes_of[ids], out=offset[1:])
    raw = np.frombuffer(data, np.uint8)
    inner = offset[1:-1]
    clause, word, char = (np.ones(len(offset), bool) for _ in range(3))
    char[1:-1] = (raw[inner] & 0xC0) != 0x80
    space = _SPACE[raw[inner]]
    word[1:-1] = (space | _SPACE[raw[inner - 1]]) & char[1:-1]
    clause[1:-1] = space & _COMMA[raw[inner - 1]]
    levels = []
    for pattern in (_PARAGRAPH, _sentence(abbreviations), _LINE):
        ends = np.fromiter((m.end() for m in pattern.finditer(data)), np.int64)
        at = np.searchsorted(offset, ends)
        marks = np.zeros(len(offset), bool)
        marks[at[offset[at] == ends]] = True
        marks[0] = True
        levels.append(marks & char)
    return offset, *levels, clause, word, char


def split_texts(rows: Iterable[tuple[int, str]], tokenizer, limit: int, overlap: int, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Iterator[dict[str, np.ndarray | list]]:
    """Pieces of the texts with more than ``limit`` tokens: columns for a table, for some texts at a time."""
    held: list[tuple] = []
    size = 0
    for row, text in rows:
        ids = np.asarray(tokenizer.encode(text), np.int64)
        if len(ids) > limit:
            data = text.encode("utf-8", "replace")
            held.append((row, data, *_places(ids, data, tokenizer.bytes_of, abbreviations)))
            size += len(ids)
        if size >= TOGETHER:
            yield _split(held, limit, overlap)
            held, size = [], 0
    if held:
        yield _split(held, limit, overlap)


def _split(held: list[tuple], limit: int, overlap: int) -> dict[str, np.ndarray | list]:
    lengths = np.array([len(h[2]) for h in held])
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int32)
    end = (base + lengths - 1).astype(np.int32)
    owner = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
    offset, *levels = (np.concatenate([h[i] for h in held]) for i in range(2, 9))
    start, after = successors(levels, base[owner], end[owner], limit, overlap)
    cuts = greedy_cuts(after, base, end)
    inside = cuts[cuts != end[owner[cuts]]]  # each is the end of the piece before and leads to the next piece's end
    whose, stop = owner[inside], after[inside]
    begun = start[inside]
    first_of = np.searchsorted(whose, np.arange(len(held)))
    pieces = np.bincount(whose, minlength=len(held))
    kind = np.where(stop == end[whose], 6, np.select([m[stop] for m in levels[:5]], [5, 4, 3, 2, 1], 0))
    chars_before = [np.concatenate([[0], np.cumsum((np.frombuffer(h[1], np.uint8) & 0xC0) != 0x80, dtype=np.int64)]) for h in held]
    return {
        "row": np.array([held[w][0] for w in whose], np.int64), "piece_no": np.arange(len(inside)) - first_of[whose], "n_pieces": pieces[whose],
        "start_token": begun - base[whose], "end_token": stop - base[whose], "n_tokens": stop - begun,
        "start_char": np.array([chars_before[w][o] for w, o in zip(whose, offset[begun], strict=True)], np.int64), "end_char": np.array([chars_before[w][o] for w, o in zip(whose, offset[stop], strict=True)], np.int64),
        "cut_at": [KINDS[k] for k in kind], "bytes": [(held[w][1], a, b) for w, a, b in zip(whose, offset[begun], offset[stop], strict=True)],
    }


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, vocabulary: str = VOCABULARY, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens.

    ``key, piece_no, n_pieces, start_token, end_token, n_tokens, start_char, end_char, cut_at[, piece]``: consecutive
    pieces share exactly ``overlap`` tokens of the text (up to three more where that place is in the midst of a
    character), none has more than ``limit`` and none but the last less than half of it, and the pieces without what they
    share give the text again. A piece ends at a paragraph, else a sentence, a line, a clause, a word. Null, empty
    and smaller texts have no rows. A text is one cell of a row, so the tables of a text are joined and squared inside
    the task that read it: nothing is shuffled, and a row that repeats is split again.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    tokenizer = tokenizer_of(df.sparkSession, vocabulary)
    numbers = ["start_token", "end_token", "n_tokens", "start_char", "end_char"]
    names = ["piece_no", "n_pieces", *numbers, "cut_at", *(["piece"] if with_text else [])]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), *([pa.string()] if with_text else [])]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        for b in batches:
            keys = b.column("__key")
            texts = ((i, t) for i, t in enumerate(b.column("__text").to_pylist()) if t)
            for found in split_texts(texts, own, limit, overlap, tuple(abbreviations)):
                columns = [pa.array(found[n]) if n != "piece" else pa.array([d[s:e].decode("utf-8") for d, s, e in found["bytes"]]) for n in names]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found["row"])), *[c.cast(k) for c, k in zip(columns, kinds, strict=True)]], names=["__key", *names])

    # a token has one byte at least, so a text of no more bytes than the limit can't be over it
    large = df.where(F.octet_length(text) > limit).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = f"__key {dict(df.dtypes)[key]}, piece_no int, n_pieces int, " + ", ".join(f"{n} long" for n in numbers) + ", cut_at string" + ", piece string" * with_text
    return large.mapInArrow(pieces, schema).withColumnRenamed("__key", key)
