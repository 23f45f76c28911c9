"""Exact substring dedup over the collection's Burrows-Wheeler transform, built column by column.

``collection_bwt`` takes a collection of short strings and inserts, round after
round, one symbol of each string, from the right.  A round finds where the new
suffixes belong by counting symbols in the transform so far (LF mapping), takes
their common prefixes with their neighbours from range minima of the common
prefixes so far, and rewrites both arrays in one sequential pass.  In the end, runs
of suffixes with common prefixes of ``LENGTH`` or more are equal strings.

The rounds are as many as the longest string has symbols, so texts are not put in
whole.  Each window of ``LENGTH`` bytes belongs to its minimizer, the least hash of
the ``KMER``-byte strings in it, which depends on the window's content alone; a
stretch of windows with one minimizer is a string of at most ``LENGTH + STRETCH - 1``
bytes, and equal windows meet with their minimizer.  The steps:

1. Of equal texts (by digest) the first is kept; the others are repeats as a whole.
2. Of the kept ones, the stretches' hashes (not their bytes) are dealt into shards;
   those whose minimizer occurs at one place in the corpus can't repeat and go no
   further.  A minimizer that a group of texts holds more than once is known to
   repeat, so the group sends one of its places there.
3. The strings of the others are dealt by minimizer, each of them once for a task
   that holds it.  The transforms of batches of about ``BATCH`` strings give the
   classes of equal windows, in which all but the first window are repeats.
4. What was found of a string is joined with the places where it stands, and comes
   back to their documents as ranges of bytes.

So a passage that a third of all documents share is one string for each task on its
way to the transform, and its places meet what was found in a join that Spark can
split.  The arrays that a classic external construction streams through files are
bounded by the batch here and stay in the task's memory; what is larger than memory
goes through Spark's sorted shuffle files.  A minimizer with more than ``LARGEST``
different strings is cut up into single windows, dealt into batches by their hash.

Defined results: a null text is the empty text; texts shorter than ``LENGTH`` lose
nothing; rows with a null id come after all others (ids are below 2**62), in the
order of a hash of their texts; rows that share an id count as parts of one
document, each with its own text (for equal starts neither removes the other);
repeated rows give one row each; other columns play no part; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, shuffle_parts, small_batches

LENGTH = 100
#: Long enough that few of these occur twice by chance; windows are told apart by the least of their 53.
KMER = 48
#: Windows in one string at most.
STRETCH = 64
SHARD_BYTES = 3 << 20
#: Strings in one transform, where minimizers can be dealt out so, and for one minimizer at most.
BATCH = 800
LARGEST = 12_000
#: Stands for the end of a string in the transform; no UTF-8 text holds it.
END = 0xFF
#: Ids from here on stand for rows without one.
NO_ID = 1 << 62
#: Added to a stretch's number of windows if it holds its minimizer at two places.
TWICE = 128
#: Strings that a task remembers having handed on.
REMEMBERED = 200_000
#: Bytes of text that a task hashes at once.
SCAN_BYTES = 1 << 21


def collection_bwt(strings: list[bytes], least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes, string, start) of the sorted suffixes of a collection.

    A common prefix is that of a suffix and the one before it.  String and start are
    those of suffixes of ``least`` symbols or more, and -1 for shorter ones.  Ends of
    strings sort first and by the strings' order.  Strings have at most 254 symbols.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    longest = int(sizes.max()) if m else 0
    columns = np.full((longest + 1, m), END, dtype=np.uint8)  # from the right
    for i, s in enumerate(strings):
        columns[: len(s), i] = np.frombuffer(s, np.uint8)[::-1]
    bwt, lcp = columns[0].copy(), np.zeros(m, dtype=np.uint8)
    counts = np.bincount(bwt, minlength=256)
    owner, start = np.full(m, -1, dtype=np.int32), np.full(m, -1, dtype=np.int16)
    active, rows = np.arange(m), np.arange(m)  # strings not used up, and the rows of their last suffixes
    for done in range(1, longest + 1):
        going = sizes[active] >= done
        active, rows = active[going], rows[going]
        # suffixes of `done` symbols begin with the transform's symbols in the rows of those of done - 1
        order = np.argsort(bwt, kind="stable")
        first = np.concatenate([[0], np.cumsum(counts)])
        symbol = bwt[rows]
        by_place = np.argsort(symbol, kind="stable")  # the rows are in order already
        active, rows, symbol = active[by_place], rows[by_place], symbol[by_place].astype(np.int64)
        # where (symbol, row) stands among all symbols with their rows
        rank = np.searchsorted(np.repeat(np.arange(256) * len(bwt), counts) + order, symbol * len(bwt) + rows)
        # common prefixes with the suffix before, and of the suffix after with this one
        padded = np.append(lcp, 0)
        has_before = rank > first[symbol]
        own = np.zeros(len(rows), dtype=np.uint8)
        if has_before.any():
            low = order[rank[has_before] - 1] + 1
            own[has_before] = 1 + np.minimum.reduceat(padded, np.column_stack([low, rows[has_before] + 1]).ravel())[::2]
        has_after = rank + 1 < first[symbol + 1]
        place = m + rank
        size = len(bwt) + len(rows)
        old = np.ones(size, dtype=bool)
        old[place] = False
        new_lcp = np.empty(size, dtype=np.uint8)
        new_lcp[old] = lcp
        if has_after.any():
            high = order[rank[has_after] + 1] + 1
            new_lcp[place[has_after] + 1] = 1 + np.minimum.reduceat(padded, np.column_stack([rows[has_after] + 1, high]).ravel())[::2]
        new_lcp[place] = own
        new_bwt = np.empty(size, dtype=np.uint8)
        new_bwt[old] = bwt
        new_bwt[place] = fresh = columns[done][active]
        counts += np.bincount(fresh, minlength=256)
        bwt, lcp = new_bwt, new_lcp
        if done < least:
            owner, start = None, None
        else:
            if owner is None or done == least:
                owner, start = np.full(size - len(rows), -1, dtype=np.int32), np.full(size - len(rows), -1, dtype=np.int16)
            new_owner, new_start = np.empty(size, dtype=np.int32), np.empty(size, dtype=np.int16)
            new_owner[old], new_start[old] = owner, start
            new_owner[place], new_start[place] = active, sizes[active] - done
            owner, start = new_owner, new_start
        rows = place
    if owner is None:
        owner, start = np.full(len(bwt), -1, dtype=np.int32), np.full(len(bwt), -1, dtype=np.int16)
    return bwt, lcp, owner, start


def equal_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, string, start) of every window of ``LENGTH`` bytes of the strings; equal windows have one class."""
    _, lcp, owner, start = collection_bwt(strings)
    full = owner >= 0
    return np.cumsum(lcp < LENGTH)[full], owner[full], start[full].astype(np.int64)


_RANDOM = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], dtype=np.uint64)
_ODD = [np.uint64(xxhash.xxh64_intdigest(bytes([i]), 13) | 1) for i in range(8)]


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``KMER`` = 32 + 16 bytes from each place on, by doubling."""
    h = _RANDOM[data]
    sixteen = None
    for i, step in enumerate((1, 2, 4, 8, 16)):
        if step == 16:
            sixteen = h
        h = h[:-step] * _ODD[i] + h[step:]
    n = len(data) - KMER + 1
    h = h[:n] * _ODD[5] + sixteen[32 : 32 + n]
    h ^= h >> np.uint64(32)
    h *= _ODD[6]
    return h ^ h >> np.uint64(29)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, minimizer, whether the minimizer is there twice) of the stretches of all windows of the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    hashes = _kmer_hashes(data)
    low = _least(hashes, LENGTH - KMER + 1)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    inside = np.arange(len(low)) + LENGTH <= begins[text + 1]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(low)))
    run, length = run[inside[run]], length[inside[run]]
    pieces = -(-length // STRETCH)
    which = np.repeat(np.arange(len(run)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = run[which] + nth * STRETCH
    n = np.minimum(STRETCH, length[which] - nth * STRETCH)
    # equal windows of one stretch hold the minimizer at two places
    reach = STRETCH + LENGTH - KMER
    near = np.lib.stride_tricks.sliding_window_view(np.append(hashes, np.zeros(reach, dtype=np.uint64)), reach)
    twice = np.zeros(len(at), dtype=bool)
    for a in range(0, len(at), 8192):
        part = at[a : a + 8192]
        twice[a : a + 8192] = np.count_nonzero(near[part] == low[part, None], axis=1) > 1
    return text[at], at - begins[text[at]], n, low[at], twice


def _scan(shards: int):
    """(shard, sure, recs): packed columns of the stretches of a shard that one group of texts has.

    Stretches whose minimizer the group has more than once are sure to be of use and are spread over the
    shards; one of each such minimizer is also sent where the others of it are sought, with no windows.
    """
    schema = pa.schema([("shard", pa.int64()), ("sure", pa.bool_()), ("recs", pa.binary())])

    def packed(rids: list[int], texts: list[bytes]) -> pa.RecordBatch | None:
        pack = zstandard.ZstdCompressor(level=1).compress
        text, start, n, low, twice = stretches(texts)
        if not len(text):
            return None
        rid = np.array(rids, dtype=np.int64)[text]
        order = np.argsort(low, kind="stable")
        low, rid, start, n, twice = low[order], rid[order], start[order], n[order], twice[order]
        same = low[1:] == low[:-1]
        sure = np.append(same, False) | np.append(False, same)
        n = np.where(twice, n + TWICE, n)
        first = sure & ~np.append(False, same)
        parts = [(False, ~sure, n), (False, first, np.zeros_like(n)), (True, sure, n)]
        shard_of = ((low >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        out: list[tuple[int, bool, bytes]] = []
        for own, pick, windows in parts:
            shard, key, r, s, w = shard_of[pick], low[pick].astype(np.uint32), rid[pick], start[pick].astype(np.uint32), windows[pick].astype(np.uint8)
            if not len(shard):
                continue
            by = np.lexsort((r, shard))
            shard, key, r, s, w = shard[by], key[by], r[by], s[by], w[by]
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if not own else [0, len(shard)]
            for a, z in zip(cuts, cuts[1:]):
                cells = np.ediff1d(r[a:z], to_begin=r[a : a + 1]).tobytes()
                columns = (shard[a:z].astype("<i4").tobytes() if own else b"") + key[a:z].tobytes() + cells + s[a:z].tobytes() + w[a:z].tobytes()
                out.append((int(shard[a]) if not own else int(r[0]) * 0x9E3779B97F4A7C15 % shards, own, pack(columns)))
        return batch(schema, list(zip(*out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, texts, held = [], [], 0
        for b in batches:
            for rid, text in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                data = text.encode("utf-8")
                if len(data) >= LENGTH:
                    rids.append(rid)
                    texts.append(data)
                    held += len(data)
                if held >= SCAN_BYTES:
                    if (out := packed(rids, texts)) is not None:
                        yield out
                    rids, texts, held = [], [], 0
        if texts and (out := packed(rids, texts)) is not None:
            yield out

    return run


def _unpacked(recs: bytes, shard: int, sure: bool) -> tuple[np.ndarray, ...]:
    """(minimizer's 32 bits below its shard, rid, start, windows) of a pack."""
    recs = zstandard.ZstdDecompressor().decompress(recs)
    n = len(recs) // (21 if sure else 17)
    at = 4 * n if sure else 0
    low = (np.frombuffer(recs, "<i4", n).astype(np.int64) if sure else np.int64(shard)) << np.int64(32) | np.frombuffer(recs, "<u4", n, at).astype(np.int64)
    return low, np.cumsum(np.frombuffer(recs, "<i8", n, at + 4 * n)), np.frombuffer(recs, "<u4", n, at + 12 * n), np.frombuffer(recs, "u1", n, at + 16 * n)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, rid, start, n): the stretches whose minimizer is there twice, in themselves, their group or their shard."""

    def rows(low: np.ndarray, rid: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(low), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in (low, rid, start.astype(np.int32), n.astype(np.int32))], names=["low", "rid", "start", "n"])

    def shard_rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        low, rid, start, n = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(low, kind="stable")
        same = low[order][1:] == low[order][:-1]
        more = n >= TWICE
        more[order[1:][same]] = more[order[:-1][same]] = True
        more &= n > 0
        yield from rows(low[more], rid[more], start[more], n[more])

    current, held = None, []
    for b in batches:
        for shard, sure, recs in zip(*(c.to_pylist() for c in b.columns)):
            if shard != current:
                yield from shard_rows(held)
                current, held = shard, []
            if sure:
                yield from rows(*_unpacked(recs, shard, True))
            else:
                held.append(_unpacked(recs, shard, False))
    yield from shard_rows(held)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int, int, int, bytes]]:
    """(low, twice, rid, version, start, bytes) of each stretch in the lists of the documents."""
    for b in batches:
        rids, versions, texts, sizes = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5).value_lengths().to_pylist()
        lows, starts, windows = (b.column(i).flatten().to_pylist() for i in (5, 6, 7))
        at = 0
        for rid, version, text, size in zip(rids, versions, texts, sizes):
            data = text.encode("utf-8")
            for i in range(at, at + size):
                n, start = windows[i], starts[i]
                end = start + (n & TWICE - 1) + LENGTH - 1
                if end <= len(data):  # else it is of another text with this id
                    yield lows[i], n >= TWICE, rid, version, start, data[start:end]
            at += size


def _digest(s: bytes) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _in_batches(schema: pa.Schema, rows: Iterator[tuple], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield batch(schema, list(zip(*out)))
            out = []
    if out:
        yield batch(schema, list(zip(*out)))


STRINGS = pa.schema([("low", pa.int64()), ("dig", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("twice", pa.bool_()), ("bytes", pa.binary())])
PLACES = pa.schema([("low", pa.int64()), ("dig", pa.int64()), ("rid", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])
REPEATS = pa.schema([("low", pa.int64()), ("dig", pa.int64()), ("first_rid", pa.int64()), ("first_start", pa.int32()), ("runs", pa.list_(pa.int32()))])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string that a task holds, where it first has it; one row more, without its bytes, if it has it again."""

    def rows() -> Iterator[tuple]:
        seen: dict[bytes, list] = {}
        for low, twice, rid, _, start, s in _found(batches):
            held = seen.get(s)
            if held is None or (rid, start) < (held[0], held[1]):
                if len(seen) >= REMEMBERED:
                    seen.clear()  # what is forgotten is handed on once more
                seen[s] = [rid, start, held is not None]
                yield low, _digest(s), rid, start, twice, s
            elif not held[2] and (rid, start) != (held[0], held[1]):
                held[2] = True
                yield low, _digest(s), rid, start, False, None

    return _in_batches(STRINGS, rows())


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each string stands."""
    return _in_batches(PLACES, ((low, _digest(s), rid, version, start, len(s)) for low, _, rid, version, start, s in _found(batches)))


def repeated_windows(strings: list[bytes], places: list[tuple[int, int]]) -> list[np.ndarray]:
    """Of each string (which first occurs at its place) which of its windows occur at an earlier place."""
    out = [np.zeros(len(s) - LENGTH + 1, dtype=bool) for s in strings]
    cls, owner, start = equal_windows(strings)
    rid, at = np.array([p[0] for p in places], dtype=np.int64), np.array([p[1] for p in places], dtype=np.int64)
    order = np.lexsort((at[owner] + start, rid[owner], cls))
    cls, owner, start = cls[order], owner[order], start[order]
    again = np.flatnonzero(cls[1:] == cls[:-1]) + 1
    flat = np.concatenate([[0], np.cumsum([len(o) for o in out])])
    marks = np.zeros(flat[-1], dtype=bool)
    marks[flat[owner[again]] + start[again]] = True
    return [marks[flat[i] : flat[i + 1]] for i in range(len(out))]


@dataclass
class Group:
    """The different strings of one minimizer: where each first stands, and whether it stands anywhere else."""

    low: int
    digs: list[int] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)
    strings: list[bytes] = field(default_factory=list)
    again: list[bool] = field(default_factory=list)
    twice: bool = False

    def rows(self, marks: list[np.ndarray | None]) -> Iterator[tuple]:
        """Rows of ``REPEATS``, of the strings that stand somewhere else or have marked windows."""
        for dig, place, again, mark in zip(self.digs, self.places, self.again, marks):
            runs: list[int] = []
            if mark is not None and mark.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
                edge[1::2] += LENGTH - 1
                runs = edge.tolist()
            if again or runs:
                yield self.low, dig, *place, runs


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """The groups of rows of ``STRINGS`` sorted by low, dig, rid and start."""
    group = None
    for b in batches:
        for low, dig, rid, start, twice, data in zip(*(c.to_pylist() for c in b.columns)):
            if group is None or low != group.low:
                if group is not None:
                    yield group
                group = Group(low)
            group.twice |= twice
            if not group.digs or group.digs[-1] != dig:
                group.digs.append(dig)
                group.places.append((rid, start))
                group.strings.append(data)
                group.again.append(False)
            elif (rid, start) != group.places[-1]:
                group.again[-1] = True
    if group is not None:
        yield group


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the transforms find of the strings, whole groups by batches of about ``BATCH``."""

    def transformed(groups: list[Group]) -> Iterator[tuple]:
        marks = iter(repeated_windows([s for g in groups for s in g.strings], [p for g in groups for p in g.places]))
        for g in groups:
            yield from g.rows([next(marks) for _ in g.strings])

    def rows() -> Iterator[tuple]:
        held, size = [], 0
        for g in _groups(batches):
            if len(g.strings) == 1 and not g.twice:
                yield from g.rows([None])  # one string that has its minimizer at one place has no two equal windows
            elif len(g.strings) > LARGEST:
                first = dict(zip(g.strings, g.places))
                marks = _window_by_window(g.strings, first)
                yield from g.rows([marks[s] for s in g.strings])
            else:
                if size and size + len(g.strings) > BATCH:
                    yield from transformed(held)
                    held, size = [], 0
                held.append(g)
                size += len(g.strings)
        if held:
            yield from transformed(held)

    return _in_batches(REPEATS, rows())


def _window_by_window(strings: list[bytes], first: dict[bytes, tuple[int, int]]) -> dict[bytes, np.ndarray]:
    """``repeated_windows`` of many strings of one minimizer: their windows are the strings of batches dealt by hash."""
    out = {s: np.zeros(len(s) - LENGTH + 1, dtype=bool) for s in strings}
    parts = -(-sum(map(len, out.values())) // LARGEST) * 2
    for part in range(parts):
        some = [(s, i) for s in strings for i in range(len(out[s])) if xxhash.xxh64_intdigest(s[i : i + LENGTH], 5) % parts == part]
        if some:
            found = repeated_windows([s[i : i + LENGTH] for s, i in some], [(first[s][0], first[s][1] + i) for s, i in some])
            for (s, i), mark in zip(some, found):
                out[s][i] = mark[0]
    return out


def spans_union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of the bytes that ranges cover."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and the removed runs of bytes if asked for."""
    spark = df.sparkSession
    small_batches(spark)
    text, given = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    last = F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID))
    docs = df.select(given.alias("doc_id"), F.coalesce(given.try_cast("long"), last).alias("rid"), F.xxhash64(text).alias("version"), F.coalesce(text, F.lit("")).alias("text"))
    docs = docs.where("rid is not null")  # always so; said here, as joins would say it for some uses of the dealt texts and not for others
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = shuffle_parts(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    # the kept text of each digest is found by an aggregation and joined by id: no join on a digest that many share
    marks = docs.where(F.octet_length("text") >= LENGTH).select("rid", "version", F.unhex(F.sha2("text", 256)).alias("digest"))
    firsts = marks.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("version").alias("version"))
    keepers = firsts.groupBy("rid").agg(F.collect_set("version").alias("kept"))
    copy = (F.octet_length("text") >= LENGTH) & ~F.coalesce(F.array_contains("kept", F.col("version")), F.lit(False))
    # every use takes all columns, so that the texts are dealt by id once
    columns = ["doc_id", "rid", "version", "text", "copy"]
    known = docs.repartition(parts, "rid").join(keepers, "rid", "left").withColumn("copy", copy).select(*columns)

    recs = known.where("not copy").mapInArrow(_scan(shards), "shard bigint, sure boolean, recs binary")
    found = recs.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_candidates, "low bigint, rid bigint, start int, n int")
    lists = found.groupBy("rid").agg(F.collect_set(F.struct("low", "start", "n")).alias("found"))
    listed = known.where("not copy").join(lists, "rid").select(*columns, "found.low", "found.start", "found.n")
    strings = listed.mapInArrow(_strings, "low bigint, dig bigint, rid bigint, start int, twice boolean, bytes binary")
    repeats = strings.repartition(parts, "low").sortWithinPartitions("low", "dig", "rid", "start").mapInArrow(_repeats, "low bigint, dig bigint, first_rid bigint, first_start int, runs array<int>")
    places = listed.mapInArrow(_places, "low bigint, dig bigint, rid bigint, version bigint, start int, size int")
    first = (F.col("rid") == F.col("first_rid")) & (F.col("start") == F.col("first_start"))
    runs = F.when(first, F.col("runs")).otherwise(F.array(F.lit(0), F.col("size")))
    ranges = places.join(repeats, ["low", "dig"]).select("rid", F.struct("version", "start", runs.alias("runs")).alias("r")).where("size(r.runs) > 0").groupBy("rid").agg(F.collect_list("r").alias("ranges"))
    both = known.join(ranges, "rid", "left").select(*columns, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, _, version, text, copy, ranges in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode("utf-8")
                own = [(r["start"] + a, r["start"] + z) for r in ranges or () if r["version"] == version for a, z in zip(r["runs"][::2], r["runs"][1::2])]
                spans = [(0, len(data))] if copy else spans_union(own)
                left, at = [], 0
                for a, z in spans:
                    left.append(data[at:a])
                    at = z
                left.append(data[at:])
                out.append((doc_id, len(data), sum(z - a for a, z in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest(), *([[x for s in spans for x in s]] if with_spans else [])))
            schema = pa.schema([pa.field("doc_id", b.column(0).type), *[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), *([("spans", pa.list_(pa.int64()))] if with_spans else [])])
            yield batch(schema, list(zip(*out)) or [[] for _ in schema])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", spans array<bigint>" if with_spans else ""))
