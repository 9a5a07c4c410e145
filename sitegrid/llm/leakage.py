"""Evaluation texts inside training texts: the q-gram lemma in diagonal bands, then banded alignment.

The rule, from which every bound below follows: an item leaked into a text if at least LEAST_SHARE of its own words are
covered. A word is covered if all its letters lie in a run of at least Q letters of the item that the alignment of a band
of diagonals matches without a break, and the band's runs hold together at least LEAST_SHARED grams (a run of n letters
holds n - Q + 1). So a stretch needs 2 * Q - 1 = 19 unbroken letters, or more in several runs: shorter fragments with other
text between are brief quotations. An item of fewer letters needs its half in one run, and at least Q letters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitegrid.operators.skew import skew_join
from sitegrid.session import written

#: Characters of a gram; 6 bits each, so a gram is exact in 64 bits.
Q = 10
#: Step of the diagonal bands; each is twice as wide, so neighbours overlap by half.
BAND = 32
#: Least shared grams of a band: as many as a stretch of two grams that don't overlap has.
LEAST_SHARED = Q
#: Least share of an item's words in stretches of its own wording.
LEAST_SHARE = 0.5
#: Items (characters) searched for in one pass over the texts, and characters of texts taken together.
ITEM_CHARS, TOGETHER = 4_000_000, 2_000_000
#: Alignments made together.
JOBS = 96
#: Slots of the sieve for each gram of the items, and most slots (one bit each).
SIEVE_SLOTS, MOST_SLOTS = 16, 1 << 29
GONE = 255
#: Cyrillic and Greek small letters that look like Latin ones, and those.
LOOKALIKES = dict(zip("аеорсухіјѕορν", "aeopcyxijsopv", strict=True))


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code of each character: a letter or digit without case and accents, 0 to 63; GONE for all that only typesets."""
    codes = np.full(0x110000, GONE, np.uint8)
    for low, high in ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x323AF)):
        codes[low : high + 1] = 36 + np.arange(low, high + 1) % 28
    for c in [*range(0x3400), *range(0xF900, 0x10000)]:
        if chr(c).isalnum():
            folded = unicodedata.normalize("NFKD", chr(c).lower())[0]
            folded = LOOKALIKES.get(folded, folded)
            codes[c] = ord(folded) - 97 if "a" <= folded <= "z" else 26 + ord(folded) - 48 if "0" <= folded <= "9" else 36 + ord(folded) % 28
    return codes


def stream(text: str) -> np.ndarray:
    """The codes of a text's letters and digits; case, accents, marks, white space and line breaks are gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    codes = _alphabet()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    return codes[codes != GONE]


def grams(codes: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each place, 6 bits a character."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    two = (codes[:-1].astype(np.uint64) << np.uint64(6)) | codes[1:]
    four = (two[:-2] << np.uint64(12)) | two[2:]
    eight = (four[:-4] << np.uint64(24)) | four[4:]
    return (eight[:-2] << np.uint64(12)) | two[8:]


@dataclass
class Items:
    """The index of a block of items: grams sorted, with the places where they occur."""

    ids: list
    codes: list[np.ndarray]
    words: list[np.ndarray]  # end of each word of the item's own in its stream
    own: list[int]  # where the item's own wording starts, after a shared instruction
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    least: np.ndarray  # grams that a band of the item must share
    needed: np.ndarray  # grams that all its bands must share together

    def share(self, item: int, covered: np.ndarray) -> float:
        """Share of the item's own words whose letters are all covered."""
        upto = np.concatenate([[0], np.cumsum(covered)])
        a, b = self.words[item][:-1], self.words[item][1:]
        return float(((upto[b] - upto[a]) == b - a).mean())


def _slot(keys: np.ndarray, slots: int = 1 << 22) -> np.ndarray:
    """The slot of a gram in a table of a power of two slots."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _opening(text: str) -> str:
    """The first sentence."""
    return re.split(r"(?<=[.?!:])\s", text.strip(), maxsplit=1)[0]


def shared_openings(texts: list[str]) -> set[bytes]:
    """First sentences, as streams, that open more than one distinct item: instructions, not wording of an item's own."""
    openings = Counter(stream(_opening(t)).tobytes() for t in set(texts))
    return {o for o, n in openings.items() if n > 1 and o}


def own_start(text: str, shared: bool) -> int:
    """Letters of a shared opening before the item's own wording; an item that is nothing else is its own wording."""
    opening = _opening(text)
    return len(stream(opening)) if shared and len(opening) < len(text.strip()) else 0


def bounds(lengths: np.ndarray) -> tuple[int, int]:
    """Least shared grams of a band, and of all bands together, for an item with own words of these lengths.

    Covered words lie in runs of Q letters or more, which have a gram for every Q letters at least; half of the words
    are no fewer letters than the shortest half.
    """
    half = int(np.sort(lengths)[: math.ceil(LEAST_SHARE * len(lengths))].sum())
    least = max(1, min(LEAST_SHARED, int(lengths.sum()) // 2 - Q + 1))
    return least, max(least, -(-half // Q))


def index_items(rows: list[tuple[Any, str, int]]) -> Items:
    """The index of items ``(id, text, letters of a shared opening)``; one whose own wording is shorter than a gram can't be
    found and has no entry."""
    ids, codes, words, own, least, needed, key, item, place = [], [], [], [], [], [], [], [], []
    for number, text, start in rows:
        whole = stream(text)
        if len(whole) - start < Q:
            continue
        lengths = [len(stream(w)) for w in text.split()]
        ends = np.cumsum([n for n in lengths if n])
        g = grams(whole)[start:]
        ids.append(number)
        codes.append(whole)
        own.append(start)
        words.append(np.concatenate([[start], ends[ends > start]]))
        in_band, in_all = bounds(np.diff(words[-1]))
        least.append(in_band)
        needed.append(in_all)
        key.append(g)
        item.append(np.full(len(g), len(ids) - 1, np.int64))
        place.append(np.arange(start, start + len(g)))
    join = lambda parts, dtype: np.concatenate(parts).astype(dtype) if parts else np.empty(0, dtype)
    key, item, place = join(key, np.uint64), join(item, np.int64), join(place, np.int64)
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[_slot(keys)] = True
    return Items(ids, codes, words, own, keys, np.append(first, len(key)), item[order], place[order], seen, np.array(least, np.int64), np.array(needed, np.int64))


def _hits(codes: np.ndarray, ends: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shared grams of the texts (one stream, with the end of each): text, place in it, item, place in it."""
    g = grams(codes)
    at = np.flatnonzero(items.seen[_slot(g)])
    where = np.minimum(np.searchsorted(items.keys, g[at]), max(len(items.keys) - 1, 0))
    same = items.keys[where] == g[at] if len(items.keys) else np.zeros(0, bool)
    at, where = at[same], where[same]
    text = np.searchsorted(ends, at, "right")
    inside = at + Q <= ends[text]
    at, where, text = at[inside], where[inside], text[inside]
    n = items.first[where + 1] - items.first[where]
    entry = np.repeat(items.first[where] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return np.repeat(text, n), np.repeat(at - starts[text], n), items.item[entry], items.place[entry]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def _regions(hits: tuple[np.ndarray, ...], items: Items) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Texts and items with diagonals worth aligning: (text, item, least diagonal, first and last place of the item); and
    the different grams that these share, as numbers of text, item and place in it.

    A diagonal is in two overlapping bands. Bands that share fewer different grams than the rule asks for are dropped. No
    run of a band can lie outside its first and last shared gram, so only that part of the item is aligned.
    """
    text, place, item, at = hits
    if not len(text):
        return [], np.empty(0, np.int64)
    shift = max(len(c) for c in items.codes)
    band = (place - at + shift) // BAND
    n_items, n_places, n_bands = len(items.ids), shift, int(band.max()) + 2
    pair = text * n_items + item  # rows of integers as one number each: they sort much faster
    rows = _distinct(((pair * n_bands + np.concatenate([[band], [band - 1]]) + 1) * n_places + at).ravel())
    bands, first, n = np.unique(rows // n_places, return_index=True, return_counts=True)
    rich = n >= items.least[bands // n_bands % n_items]
    kept = rows[np.repeat(rich, n)]
    different = _distinct((kept // n_places // n_bands) * n_places + kept % n_places)
    jobs: list[tuple[int, int, int, int, int]] = []
    for code, low, high in zip(bands[rich].tolist(), (rows[first[rich]] % n_places).tolist(), (rows[(first + n - 1)[rich]] % n_places).tolist(), strict=True):
        p, b = code // n_bands, code % n_bands - 1
        t, i = divmod(p, n_items)
        # each band by itself: a path across several would have to pay for what was put between two stretches
        jobs.append((t, i, b * BAND - shift, low, high + Q))
    return jobs, different


@dataclass
class Job:
    """A part of an item to be aligned with a text in a band of diagonals."""

    text: int
    item: int
    codes: np.ndarray  # of the text, or of a window of it
    diagonal: int
    start: int
    stop: int


def _jobs(groups: Iterator[list[tuple[int, np.ndarray]]], items: Items) -> Iterator[list[Job]]:
    """Alignments to make.

    A pair is kept if the grams that its bands share, over all windows of the text, lie on half of the item's words: runs
    are made of such grams, so no other pair can pass. A group's last text waits for the next group, which may hold more of
    its windows.
    """
    n_items, n_places = len(items.ids), max(len(c) for c in items.codes)
    jobs: list[Job] = []
    shared = np.empty(0, np.int64)

    def kept(some: list[Job], grams: np.ndarray) -> list[Job]:
        pairs, first, n = np.unique(grams // n_places, return_index=True, return_counts=True)
        enough = n >= items.needed[pairs % n_items]
        good = set()
        for pair, low, count in zip(pairs[enough].tolist(), first[enough].tolist(), n[enough].tolist(), strict=True):
            places = grams[low : low + count] % n_places
            change = np.zeros(len(items.codes[pair % n_items]) + 1, np.int32)
            change[places] += 1
            np.subtract.at(change, places + Q, 1)
            if items.share(pair % n_items, np.cumsum(change[:-1]) > 0) >= LEAST_SHARE:
                good.add(pair)
        return sorted((j for j in some if j.text * n_items + j.item in good), key=lambda j: j.stop - j.start)

    for group in groups:
        numbers = np.array([n for n, _ in group])
        found, different = _regions(_hits(np.concatenate([codes for _, codes in group]), np.cumsum([len(codes) for _, codes in group]), items), items)
        jobs += [Job(group[t][0], i, group[t][1], diagonal, start, stop) for t, i, diagonal, start, stop in found]
        each = n_items * n_places
        shared = _distinct(np.concatenate([shared, numbers[different // each] * each + different % each]))
        last, open_ = group[-1][0], shared // each == group[-1][0]
        yield kept([j for j in jobs if j.text != last], shared[~open_])
        jobs, shared = [j for j in jobs if j.text == last], shared[open_]
    yield kept(jobs, shared)


def _align(jobs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[np.ndarray]:
    """For each (item, text, least and greatest diagonal), which of the item's characters the best alignment in the band matches.

    Unit costs, free ends in the text; all jobs advance together, one row of the table at a time.
    """
    rows, width = max(len(j[0]) for j in jobs), max(j[3] - j[2] + 1 for j in jobs)
    n = len(jobs)
    item = np.full((n, rows), 254, np.uint8)
    text = np.full((n, rows + width), 253, np.uint8)  # text[:, r + k] faces row r on diagonal k
    for x, (a, b, low, _) in enumerate(jobs):
        item[x, : len(a)] = a
        start, stop = max(low, 0), min(low + rows + width, len(b))
        if start < stop:
            text[x, start - low : stop - low] = b[start:stop]
    steps = np.arange(width, dtype=np.int32)
    cost = np.zeros((n, width), np.int32)
    moves = np.empty((rows, n, width), np.uint8)
    far = np.full((n, 1), 1 << 20, np.int32)
    for r in range(rows):
        slant = cost + (text[:, r : r + width] != item[:, r : r + 1])
        down = np.concatenate([cost[:, 1:], far], 1) + 1
        best = np.minimum(slant, down)
        along = np.minimum.accumulate(best - steps, 1) + steps
        moves[r] = np.where(along < best, 2, np.where(down < slant, 1, 0))
        cost = along
    matched = np.zeros((n, rows), bool)
    k, r, every = np.argmin(cost, 1), np.full(n, rows - 1), np.arange(n)
    while (r >= 0).any():
        live = r >= 0
        safe = np.maximum(r, 0)
        move = moves[safe, every, k]
        hit = live & (move == 0)
        matched[every[hit], r[hit]] = text[every[hit], r[hit] + k[hit]] == item[every[hit], r[hit]]
        k = np.where(live & (move == 2), k - 1, np.where(live & (move == 1), k + 1, k))
        r = np.where(live & (move != 2), r - 1, r)
    return [m[: len(j[0])] for m, j in zip(matched, jobs, strict=True)]


def _in_runs(matched: np.ndarray, least: int) -> np.ndarray:
    """Only matches in unbroken runs of at least Q, and none if the runs hold fewer than ``least`` grams together."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], matched.astype(np.int8), [0]]))).reshape(-1, 2)
    runs = edges[edges[:, 1] - edges[:, 0] >= Q]
    out = np.zeros(len(matched), bool)
    if (runs[:, 1] - runs[:, 0] - Q + 1).sum() >= least:
        for a, b in runs:
            out[a:b] = True
    return out


def _parts(texts: list[str | None], longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Streams of the texts, with their numbers; a very long one in windows that overlap by some items' length."""
    for n, t in enumerate(texts):
        codes = stream(t) if t else np.empty(0, np.uint8)
        overlap = 4 * longest + BAND
        if len(codes) <= TOGETHER + overlap:
            yield n, codes
            continue
        for start in range(0, len(codes) - overlap, TOGETHER):
            yield n, codes[start : start + TOGETHER + overlap]


def _together(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for part in parts:
        if held and size + len(part[1]) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(part)
        size += len(part[1])
    if held:
        yield held


def leaks_in(texts: list[str | None], items: Items) -> list[tuple[int, Any, float]]:
    """(number of the text, item id, share of the item's words found) with a share of LEAST_SHARE or more."""
    if not items.ids:
        return []
    covered: dict[tuple[int, int], np.ndarray] = {}
    for jobs in _jobs(_together(_parts(texts, max(len(c) for c in items.codes))), items):
        for low in range(0, len(jobs), JOBS):
            some = jobs[low : low + JOBS]
            aligned = _align([(items.codes[j.item][j.start : j.stop], j.codes, j.diagonal + j.start, j.diagonal + j.start + 2 * BAND - 1) for j in some])
            for j, m in zip(some, aligned, strict=True):
                spot = (j.text, j.item)
                if spot not in covered:
                    covered[spot] = np.zeros(len(items.codes[j.item]), bool)
                covered[spot][j.start : j.stop] |= _in_runs(m, int(items.least[j.item]))
    found: list[tuple[int, Any, float]] = []
    for (t, i), m in sorted(covered.items()):
        share = items.share(i, m)
        if share >= LEAST_SHARE:
            found.append((t, items.ids[i], share))
    return found


def _with_starts(items: DataFrame, key: str, text: str) -> DataFrame:
    """``__item, __text, __start`` of the distinct items: the letters of an opening sentence that several items share."""
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("__item"), F.col(text).alias("__text")).dropna().distinct()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__text").to_pylist()
            columns = [pa.array([stream(_opening(t)).tobytes() for t in texts], pa.binary()), pa.array([own_start(t, True) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "__opening", "__start"])

    marked = rows.mapInArrow(opened, f"__item {kind}, __text string, __opening binary, __start long")
    uses = marked.select("__opening", "__text").distinct().groupBy("__opening").agg(F.count(F.lit(1)).alias("__uses"))
    return skew_join(marked, uses, ["__opening"]).select("__item", "__text", F.when((F.col("__uses") > 1) & (F.length("__opening") > 0), F.col("__start")).otherwise(0).alias("__start"))


def _blocks(items: DataFrame, item_chars: int) -> Iterator[Items]:
    """Indexes of blocks of the items, of about ``item_chars`` characters each; the driver holds one block at a time."""
    held: list[tuple[Any, str, int]] = []
    size = 0
    for row in items.toLocalIterator():
        if held and size + len(row[1]) > item_chars:
            yield index_items(held)
            held, size = [], 0
        held.append((row[0], row[1], row[2]))
        size += len(row[1])
    if held:
        yield index_items(held)


def _sieve(items: DataFrame) -> np.ndarray:
    """One bit for each slot that a gram of some item falls into: a text needs LEAST_SHARED such grams, or one where items
    are short."""
    total = items.agg(F.sum(F.length("__text"))).collect()[0][0] or 0
    slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(16, int(total * SIEVE_SLOTS).bit_length()))
    bits = np.zeros(slots, bool)
    for row in items.select("__text").toLocalIterator():
        bits[_slot(grams(stream(row[0])), slots)] = True
    return np.packbits(bits)


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """``key, item_key, share``: texts that hold at least half of an item's words in stretches of its own wording, by the
    rule at the top of this module.

    Texts and items become streams of letters and digits, so typesetting (case, accents, hyphens and breaks, invisible
    marks) plays no part. Grams shared by a text and an item are counted in overlapping bands of diagonals; bands that
    share fewer than the rule asks for can't add to the result and are dropped, the others are verified by banded
    alignment. An opening sentence that several items share is no item's own wording.

    Items are indexed in blocks of ``item_chars`` characters, which are made one at a time and broadcast each (bounded by
    that size). One block, as here, is one pass over the texts. With more, one pass with a sieve of all blocks' grams
    writes the texts that share any, and the blocks read only those. Texts are never shuffled and always whole; keys may
    be of any type. Null and empty texts or items give no rows; equal rows give equal results each.
    """
    context = documents.sparkSession.sparkContext
    kinds = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_key].dataType)
    starts = written(_with_starts(items, item_key, item_text), "items")
    indexes = [context.broadcast(index) for index in _blocks(starts, item_chars) if index.ids]
    texts = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length("__text") > 0)
    if not indexes:
        return texts.select(F.col("__key").alias(key), F.lit(None).cast(kinds[1]).alias(item_key), F.lit(0.0).alias("share")).limit(0)
    if len(indexes) > 1:
        sieve = context.broadcast(_sieve(starts))

        def suspicious(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sieve.value
            for b in batches:
                rows = []
                for n, t in enumerate(b.column("__text").to_pylist()):
                    slot = _slot(grams(stream(t)), 8 * len(bits))
                    if (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).any():
                        rows.append(n)
                yield b.take(pa.array(rows, pa.int64()))

        texts = written(texts.mapInArrow(suspicious, f"__key {kinds[0]}, __text string"), "suspicious-texts")

    def searched(index) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for b in batches:
                found = leaks_in(b.column("__text").to_pylist(), known)
                columns = [b.column("__key").take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], item_type), pa.array([f[2] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["__key", "__item", "share"])

        return texts.mapInArrow(search, f"__key {kinds[0]}, __item {kinds[1]}, share double")

    out = reduce(DataFrame.union, [searched(i) for i in indexes])
    # an item given twice under one id with unlike texts counts by its best
    return out.groupBy("__key", "__item").agg(F.max("share").alias("share")).withColumnsRenamed({"__key": key, "__item": item_key})
