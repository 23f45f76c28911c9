"""Near-duplicate groups by SimHash fingerprints, found with Golay-code fuzzy keys.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21.  When two differ
in at most 3 bits, the segment that differs most can be left out and the other
two differ in at most 2 bits together: one of them in none (and the other in at
most 2), or both in 1.  Two Golay words within 2 bits share an index, and within
1 bit one's own index is among the other's, so the keys (pair of segments, any
index of one, own index of the other) and (.., own index, any index) meet for
every such pair: about 29 keys for each fingerprint.  What meets is verified.

Equal fingerprints are one before keys are made, so copies cost nothing here.
Of a bucket only links that join something are emitted (a forest, never all
pairs).  A bucket of more than ``HOT`` fingerprints is cut finer by the third
segment: by its indices where that differs in at most 2 bits, and by the exact
other two where it differs in 3.  Groups are connected components.

Defined results: a null text is the empty text, whose fingerprint is zero and
which is linked like any other; a group's id is its smallest non-null doc_id, or
null if it has none; repeated rows give one row each; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import golay
from tessera.llm.common import batch, cut, first_row, packed, shuffle_parts, small_batches
from tessera.llm.components import components

SEED = 42
#: Bits that fingerprints of one link may differ in; the keys are made for this.
RADIUS = 3
#: Lowest bit and width of each segment, and the pairs of segments with the third.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1, 2), (0, 2, 1), (1, 2, 0))
HOT = 2048
#: Rows of a bucket compared with the others at once.
BLOCK = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of the word shingles of a text, as an unsigned number."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        found = [b" ".join(words)]
    else:
        found = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))]
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(x, seed) for x in found], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed number) of every row."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.astype(np.int64).view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``fps``, key) of every fuzzy key."""
    found = [golay.indices(s) for s in _segments(fps)]
    places, keys = [], []
    for number, (i, j, _) in enumerate(PAIRS):
        (own_i, any_i), (own_j, any_j) = ((a.astype(np.int64), b.astype(np.int64)) for a, b in (found[i], found[j]))
        k = np.concatenate([np.where(any_i >= 0, any_i << 12 | own_j[:, None], -1), np.where(any_j >= 0, own_i[:, None] << 12 | any_j, -1)], axis=1)
        k.sort(axis=1)
        k[:, 1:][k[:, 1:] == k[:, :-1]] = -1
        at, col = np.nonzero(k >= 0)
        places.append(at)
        keys.append(k[at, col] | number << 24)
    return np.concatenate(places), np.concatenate(keys)


def finer_keys(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, finer key) for rows of hot buckets: third segment's indices, or the exact other two."""
    segments, places, out = _segments(fps), [], []
    for number, (i, j, third) in enumerate(PAIRS):
        rows = np.flatnonzero(keys >> 24 == number)
        _, near = golay.indices(segments[third][rows])
        at, col = np.nonzero(near >= 0)
        places += [rows[at], rows]
        out += [near[at, col].astype(np.int64), 1 << 62 | segments[i][rows] << 22 | segments[j][rows]]
    return np.concatenate(places), np.concatenate(out)


def forest(nodes: np.ndarray, words: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Links that join nodes whose fingerprints (64 bits in each of ``words``) are within ``radius`` bits of each other."""
    n = len(nodes)
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out, parts = [], [w.view(np.uint64) for w in words]
    for at in range(0, n, BLOCK):
        apart = sum(np.bitwise_count(u[at : at + BLOCK, None] ^ u[None, at:]).astype(np.int16) for u in parts)
        for a, b in zip(*np.nonzero(np.triu(apart <= radius, 1))):
            x, y = root(at + int(a)), root(at + int(b))
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((int(nodes[at + a]), int(nodes[at + b])))
    return out


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy()
        places, keys = keys_of(fps)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[places])], names=["key", "fp"])


def _emit_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
        places, finer = finer_keys(keys, fps)
        yield pa.RecordBatch.from_arrays([pa.array(keys[places]), pa.array(finer), pa.array(fps[places])], names=["key", "finer", "fp"])


def _linker(radius: int):
    """Of rows sorted by (key, finer, node), the links of each bucket.  One bucket is held at a time.

    The columns after ``node`` are the fingerprint's words; without any, the node is the fingerprint.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(parts: list[list[np.ndarray]]) -> list[tuple[int, int]]:
        nodes, *words = (np.concatenate(c) for c in zip(*parts))
        _, first = np.unique(nodes, return_index=True)
        nodes = nodes[first]
        return forest(nodes, [w[first] for w in words] or [nodes], radius) if len(nodes) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for b in batches:
            keys, finer, *columns = (c.to_numpy() for c in b.columns)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (finer[1:] != finer[:-1])) + 1
            out: list[tuple[int, int]] = []
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if (bucket := (keys[a], finer[a])) != current:
                    if len(held) > 1 or held and len(held[0][0]) > 1:
                        out += links(held)
                    held, current = [], bucket
                held.append([c[a:z] for c in columns])
            if out:
                yield batch(schema, list(zip(*out)))
        if held and (out := links(held)):
            yield batch(schema, list(zip(*out)))

    return run


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join the distinct fingerprints ``fp`` into their components."""
    spark = fps.sparkSession
    keys = fps.select("fp").mapInArrow(_emit_keys, "key bigint, fp bigint")
    hot = cut(keys.groupBy("key").count().where(F.col("count") > HOT).select("key"))
    spread = keys.withColumn("finer", F.lit(0).cast("long"))
    if not hot.isEmpty():
        finer = keys.join(hot, "key", "left_semi").mapInArrow(_emit_finer, "key bigint, finer bigint, fp bigint")
        spread = spread.join(hot, "key", "left_anti").select("key", "finer", "fp").unionByName(finer)
    dealt = spread.select("key", "finer", "fp").repartition(shuffle_parts(spark), "key", "finer").sortWithinPartitions("key", "finer", "fp")
    return dealt.mapInArrow(_linker(RADIUS), "u bigint, v bigint")


def groups(df: DataFrame, shingle: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    docs = cut(fingerprints(df, shingle, text_col, id_col))
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    label = components(links(fps)).withColumnRenamed("node", "fp")
    named = fps.join(label, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(least, "label").select("fp", "component_id")
    return docs.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies: words in a shingle, and the least Jaccard similarity of the shingles of a link, in fifths.
NEAR_SHINGLE = 5
NEAR_FIFTHS = 4
#: Keys of a text and least hashes in each: at 0.8 a pair shares none in 5 of 100,000 cases.
BANDS, BAND_ROWS = 25, 5
#: Bits of 128 that the SimHashes of a candidate differ in at most; 0.8 makes 19 differ on average, with a deviation of 4.
SKETCH_BITS = 42
#: Rows of a bucket that are all compared at once; the rows of larger ones are compared with leaders first, so many each round, and
#: in another round while the buckets still hold more pairs than this for each row that are not connected and the last round linked
SMALL, LEADERS, CROWDED, WORTH, STAR_ROUNDS = 32, 3, 64, 50, 12
#: Bytes of the texts of candidate pairs whose shingles' hashes are sent to every task, at most; more texts are joined.
SENT_BYTES = 16 << 20
#: Slots of the table that tells rare shingles from frequent ones, as a power of 2.
SLOT_BITS = 20
_r = np.random.default_rng(SEED)
_ODD, _FLIP = (_r.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(2))
_ODD = _ODD * np.uint64(2) + np.uint64(1)


def _wide(hashes: np.ndarray) -> np.ndarray:
    """The 128-bit SimHash of distinct hashes, as two signed numbers; the upper half comes from remixed hashes."""
    if not len(hashes):
        return np.zeros(2, dtype=np.int64)
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    both = np.concatenate([hashes[:, None], (mixed ^ (mixed >> np.uint64(29)))[:, None]], axis=1)
    ones = np.unpackbits(both.view(np.uint8).reshape(len(hashes), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def shingles_of(text: str | None) -> set[bytes]:
    """The distinct five-word shingles; of a shorter text all its words as one, without a word none."""
    words = (text or "").encode("utf-8").lower().split()
    if len(words) < NEAR_SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(x) for x in zip(*(words[i:] for i in range(NEAR_SHINGLE)))}


def alike(x: set[bytes], y: set[bytes]) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    both = len(x & y)
    return 5 * both >= NEAR_FIFTHS * (len(x) + len(y) - both)


def near_signature(text: str | None) -> tuple[int, int, int, int, list[int]]:
    """Of the distinct shingles: a hash of all, their number, their 128-bit SimHash, and the keys of their least hashes."""
    digest = xxhash.xxh64_intdigest
    h = np.sort(np.array([digest(x, SEED) for x in shingles_of(text)], dtype=np.uint64))
    if not len(h):
        return 0, 0, 0, 0, []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, ((h[at : at + 1024, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    signed = np.array([digest(h.tobytes(), SEED), *(digest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND_ROWS)))], dtype=np.uint64).view(np.int64).tolist()
    return signed[0], len(h), *_wide(h).tolist(), signed[1:]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v) with their texts those that are alike."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for b in batches:
        u, v, texts_u, texts_v = (c.to_pylist() for c in b.columns)
        sets = {n: shingles_of(t) for n, t in {**dict(zip(u, texts_u)), **dict(zip(v, texts_v))}.items()}
        yield batch(schema, list(zip(*((x, y) for x, y in zip(u, v) if alike(sets[x], sets[y])))) or [[], []])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the sorted 64-bit hashes of their distinct shingles."""
    digest = xxhash.xxh64_intdigest
    for b in batches:
        packs = [np.unique(np.fromiter((digest(x, SEED) for x in shingles_of(t)), np.uint64)).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packs, pa.binary())], names=["node", "text"])


def _verify_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_verify`` by hashes of the shingles; the rows of one u come together, so its hashes are laid out once."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for b in batches:
        u, v, packs_u, packs_v = (c.to_pylist() for c in b.columns)
        out, held, x = ([], []), None, None
        for one, other, p, q in zip(u, v, packs_u, packs_v):
            if one != held:
                held, x = one, np.frombuffer(p, np.uint64)
            y = np.frombuffer(q, np.uint64)
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
            if 5 * both >= NEAR_FIFTHS * (len(x) + len(y) - both):
                out[0].append(one)
                out[1].append(other)
        yield batch(schema, out)


def _candidate(x: str, y: str) -> Column:
    """Whether two rows of a bucket may be alike, by the sizes of their sets (exact) and their SimHashes."""
    c = lambda side, name: F.col(f"{side}.{name}")
    bits = F.bit_count(c(x, "a").bitwiseXOR(c(y, "a"))) + F.bit_count(c(x, "z").bitwiseXOR(c(y, "z")))
    return (5 * F.least(c(x, "n"), c(y, "n")) >= NEAR_FIFTHS * F.greatest(c(x, "n"), c(y, "n"))) & (bits <= SKETCH_BITS)


_PAIR = ("least(x.node, y.node) AS u", "greatest(x.node, y.node) AS v")


def _fuzzy_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that join the nodes of equal SimHashes, and those of SimHashes that Golay keys find within ``RADIUS`` bits."""
    own = cut(nodes.groupBy(F.col("a").alias("fp")).agg(F.min("node").alias("node")))
    same = nodes.select(F.col("a").alias("fp"), "node").alias("x").join(own.alias("y"), "fp").where("x.node <> y.node")
    near = links(own.select("fp")).join(own.select(F.col("fp").alias("u"), F.col("node").alias("x")), "u").join(own.select(F.col("fp").alias("v"), F.col("node").alias("y")), "v")
    return same.selectExpr(*_PAIR).unionByName(near.selectExpr("least(x, y) AS u", "greatest(x, y) AS v"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs that links don't connect already."""
    for side in ("u", "v"):
        pairs = pairs.join(label.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    return pairs.where("coalesce(label_u, u) <> coalesce(label_v, v)").select("u", "v")


def _small_pairs(met: DataFrame) -> DataFrame:
    """All candidate pairs of the small buckets."""
    small = met.where(F.col("size") <= SMALL)
    return small.alias("x").join(small.alias("y"), "key").where((F.col("x.node") < F.col("y.node")) & _candidate("x", "y")).selectExpr(*_PAIR).distinct()


def _star(large: DataFrame, turn: int) -> DataFrame:
    """Pairs of each large bucket's leaders with the bucket's rows that aren't connected with them.

    One leader is the row that meets most others in all its buckets (the text that others are copies of meets more than
    these meet each other); the rest are others each turn.
    """
    order = lambda i: F.struct((F.xxhash64("node", F.lit(turn * LEADERS + i)) if i else -F.col("meets")).alias("h"), "node", "label", "n", "a", "z")
    least = large.groupBy("key").agg(*[F.min(order(i)).alias(f"x{i}") for i in range(LEADERS)])
    leader = cut(least.select("key", F.explode(F.array(*[f"x{i}" for i in range(LEADERS)])).alias("x")).select("key", "x.*").distinct())
    return large.alias("y").join(leader.alias("x"), "key").where((F.col("x.label") != F.col("y.label")) & _candidate("x", "y")).selectExpr(*_PAIR).distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's rows each slot's shingles are, as one batch a task."""
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for b in batches:
        for pack in b.column(0).to_pylist():
            counts += 0 if not pack else np.bincount(_slots(np.frombuffer(pack, np.uint64)), minlength=len(counts))
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _rare_first(counts: Broadcast[np.ndarray]):
    """Of each row the shingles, rarest first, of which any row that is alike has one, with their places (from 0)."""
    names = ["token", "node", "label", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, label, pack in zip(*(c.to_pylist() for c in b.columns)):
                h = np.frombuffer(pack, np.uint64)
                held = counts.value[_slots(h)]
                order = np.lexsort((h, held))[: len(h) - -(-NEAR_FIFTHS * len(h) // 5) + 1]
                at = np.flatnonzero(held[order] > 1)  # a shingle counted once is in no other row
                out.append((h[order[at]].view(np.int64), *(np.full(len(at), x, np.int64) for x in (node, label, len(h))), at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return run


def _rare_pairs(packs: DataFrame) -> DataFrame:
    """Pairs of rows (node, label, text: hashes as ``_hashed`` makes them) of different labels that may be alike; none that is alike is left out.

    Shingles are put in one order, rarest first.  What comes before the first shingle that two rows share is in one of
    them alone, so the rest of either bounds the number that they share.  Rows meet by the shingles at which that bound
    still allows 0.8: versions of one text whose own shingles are too many for that never meet, however many they are.
    The order comes from counts in a table of fixed size; slots that several shingles share change the order alone.
    """
    found = packs.select("text").mapInArrow(_counted, "slot bigint, n bigint").groupBy("slot").agg(F.least(F.sum("n"), F.lit(2**32 - 1)).alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    run = _rare_first(packs.sparkSession.sparkContext.broadcast(counts))
    # written first: the join is then one that Spark can split
    rare = cut(packs.select("node", "label", "text").mapInArrow(run, "token bigint, node bigint, label bigint, n bigint, at bigint"))
    shared = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    allowed = 9 * shared >= NEAR_FIFTHS * (F.col("x.n") + F.col("y.n"))
    return rare.alias("x").join(rare.alias("y"), "token").where((F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & allowed).selectExpr(*_PAIR).distinct()


def _open_pairs(large: DataFrame) -> tuple[float, float]:
    """(pairs of the buckets that aren't connected, rows of the buckets)."""
    sizes = large.groupBy("key", "label").count().groupBy("key").agg((F.pow(F.sum("count"), 2) - F.sum(F.pow("count", F.lit(2)))).alias("pairs"), F.sum("count").alias("rows"))
    pairs, rows = first_row(sizes.agg(F.sum("pairs"), F.sum("rows")))
    return (pairs or 0) / 2, rows or 0


def near_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, version (a hash of the text) and near_group of every row of ``df``.

    Rows are linked whose distinct five-word shingles have a Jaccard similarity of 0.8
    or more, and groups are the connected components of links.  Rows meet by the Golay
    keys of their SimHashes and are verified by the shingles of their texts.  What is alike
    beyond ``RADIUS`` bits (at 0.8 about 10 of 64 bits differ) and not connected by that
    meets by keys of the least hashes of the shingles (``BANDS``): small buckets pair by
    pair, large ones with leaders and then by their rare shingles (``_rare_pairs``), which
    leaves out no two rows that are alike, whatever the bucket's size.
    Texts with the same shingles are equal, and so are texts without a word.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "node", "n", "a", "z", "keys"]
        for b in batches:
            found = [near_signature(t) for t in b.column(2).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns, pa.array([f[4] for f in found], pa.list_(pa.int64()))], names=names)

    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("version"), F.col(f"`{text_col}`").alias("text"))
    marked = cut(source.mapInArrow(run, f"doc_id {kind}, version bigint, node bigint, n bigint, a bigint, z bigint, keys array<bigint>"))
    # a row for each node, summed up before the shuffle: a text that many rows share is one from here on
    first = F.min(F.struct("doc_id", "version", "n", "a", "z", "keys")).alias("row")
    nodes = cut(marked.groupBy("node").agg(first).select("node", F.col("row.doc_id").alias("row_id"), F.col("row.version").alias("row_version"), "row.n", "row.a", "row.z", "row.keys"))
    keys = nodes.select(F.explode("keys").alias("key"), "node", "n", "a", "z")
    # the sizes are written first: a join with them is then one that Spark can split
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = cut(keys.join(sizes, "key"))
    big = met.where(F.col("size") > SMALL)
    large = cut(big.join(big.groupBy("node").agg(F.sum("size").alias("meets")), "node").withColumn("label", F.col("node")))

    def texts_of(asked: DataFrame) -> DataFrame:
        one = nodes.join(asked, "node").select("node", "row_id", "row_version")
        return source.join(one, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("version") == F.col("row_version"))).select("node", "text").dropDuplicates(["node"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        texts = cut(texts_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
        few = (first_row(texts.agg(F.sum(F.octet_length("text"))))[0] or 0) <= SENT_BYTES
        if few:  # then their hashes, 8 bytes a word, are few too
            texts = F.broadcast(cut(texts.mapInArrow(_hashed, "node bigint, text binary")))
        held = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        return cut(held.select("u", "v", "text_u", "text_v").mapInArrow(_verify_hashed if few else _verify, "u bigint, v bigint"))

    def labelled(label: DataFrame) -> DataFrame:
        return cut(large.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))

    def rest_of(open_: DataFrame) -> DataFrame:
        some = cut(open_.groupBy("key").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("key"))  # written first, as the sizes
        rows = cut(open_.join(some, "key").select("node", "label").distinct())
        return _rare_pairs(cut(texts_of(rows.select("node")).mapInArrow(_hashed, "node bigint, text binary").join(rows, "node")))

    found = verified(_fuzzy_pairs(nodes))
    label = cut(components(found))
    open_ = labelled(label)
    crowd, _ = _open_pairs(open_)
    small = _apart(_small_pairs(met), label)
    found = found.unionByName(verified(small.unionByName(_star(open_, 0)).distinct() if crowd else small))
    label = cut(components(found))
    for turn in range(1, STAR_ROUNDS + 1):
        open_ = labelled(label) if crowd else None
        crowd, rows = _open_pairs(open_) if crowd else (0, 0)
        if not crowd:
            break
        last = crowd <= CROWDED * rows or turn == STAR_ROUNDS
        if not last:
            more = verified(_star(open_, turn))
            last = more.count() * WORTH < open_.select("node").distinct().count()
        if last:
            rest = verified(rest_of(open_))
            more = rest if crowd <= CROWDED * rows or turn == STAR_ROUNDS else more.unionByName(rest)
        if not more.isEmpty():
            found = found.unionByName(more)
            label = cut(components(found))
        if last:
            break
    return marked.join(label, "node", "left").select("doc_id", "version", F.coalesce("label", "node").alias("near_group"))


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each near-copy group the row of ``df`` with the smallest id (null ids last, then the smallest hash of the text).

    Repeated rows are a group too, so one of them stays.  All columns stay what they are, whatever their names.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    first = near_groups(df, text_col, id_col).groupBy("near_group").agg(F.min(rank).alias("first"))
    keepers = first.select(F.col("first.doc_id").alias("k_id"), F.col("first.version").alias("k_version"))
    rows = packed(df, id=F.col(f"`{id_col}`"), version=F.xxhash64(F.col(f"`{text_col}`")))
    kept = rows.join(keepers, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("version") == F.col("k_version")), "left_semi")
    return kept.dropDuplicates(["id", "version"]).select("row.*")
