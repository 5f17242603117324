"""SimHash near-duplicates with a hierarchical index in Gray order.

Fingerprints have 64 bits, from word shingles.  Equal ones are folded first, so all that follows
handles different fingerprints alone.  Two of them link if at most ``RADIUS`` bits differ.

To deal the work out, the 64 bits are cut into ``b`` blocks; a linked pair agrees in at least
``b - RADIUS`` whole blocks, so each choice of that many blocks is a table whose key is their
bits, and every pair meets in one of them.  ``b`` grows with the number of fingerprints.  A key
with more than a cell's share of rows is dealt to pairs of its parts, so no task holds it alone.

Inside a cell, fingerprints are sorted by Gray rank.  Runs of neighbours form the lower nodes of
a tree, runs of nodes the upper ones.  Bits that all members of a node share are factored out into
it, as mask and pattern, and count there once: a node's own bits are those it adds to its parent's.
A pair of nodes carries the difference found so far; opening it adds, for each pair of children, the
difference in the bits that either adds of its own.  Pairs beyond the radius are dropped whole.  A
cell gives out a tree over each of its connected groups, never all pairs, and much the same tree as other
cells that the group shares.  Labels then spread along those edges until no label
changes; each round is written to the shared folder.

Defined cases: a text without words, and null, has fingerprint zero, linked like any other; a
text with fewer words than a shingle is one shingle; repeated rows have the same fingerprint; a
null id never is a component's smallest id unless it has no other; very long texts are read whole, and
ties need no rule, since a component has one smallest id; an empty table gives an empty result; kept
columns that have a name of this operator's own are refused.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_BROADCAST, batches, checked, materialise, own_names, rows_of

WORDS, SEED, RADIUS = 4, 42, 4
LEAF, FANOUT = 8, 8
WIDE_LEAF = 64  #: fingerprints of a leaf beyond RADIUS bits, where a tree prunes less
LEAST_CELL, MOST_CELL = 512, 16_384  #: rows of a key that stay together; between them, a task's even share


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    """XXH64 of each of a text's shingles of ``size`` words, in order; of all words if they are fewer."""
    return hashes_of(words_of(text), size)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes], size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """The 64 bits of a text, unsigned."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    set_bits = total * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fingerprint``, its bits as a signed long."""

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            schema = pa.schema([*(batch.schema.field(k) for k in keep), ("fingerprint", pa.int64())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for body, *rest in rows_of(batch, "_text", *keep):
                    value = fingerprint(body)
                    yield (*rest, value - (value >> 63 << 64))

            yield from batches(rows(), schema)

    out_type = T.StructType([*(df.schema[k] for k in keep), T.StructField("fingerprint", T.LongType())])
    return df.select(df[text].cast("string").alias("_text"), *keep).mapInArrow(read, out_type)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code word in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def linked(codes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into ``codes``, different and in Gray order) at ``radius`` bits or fewer, in batches."""
    leaf = LEAF if radius <= RADIUS else WIDE_LEAF
    # levels[0] are the code words; each upper level shares bits over FANOUT nodes of the one below
    levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
    added = []  # for each level but the top one: the bits that a node has and its parent has not
    span = leaf
    while len(levels) == 1 or len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        cuts = np.arange(0, len(pattern), span)
        both, either = np.bitwise_and.reduceat(pattern, cuts), np.bitwise_or.reduceat(pattern, cuts)
        levels.append((both, np.bitwise_and.reduceat(mask, cuts) & ~(both ^ either)))
        added.append(mask & ~levels[-1][1][np.arange(len(mask)) // span])
        span = FANOUT
    padded = np.resize(codes, (len(levels[1][0]), leaf)) if len(codes) else np.zeros((0, leaf), np.uint64)
    # a pair of nodes, its level, and the bits in which it is known to differ: none at the root
    start = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8), len(levels) - 1)]
    while start:
        left, right, known, level = start.pop()
        pattern, mask = levels[level - 1]
        span = leaf if level == 1 else FANOUT
        room = (1 << 20) // (span * span)
        if len(left) > room:
            start += [(left[k : k + room], right[k : k + room], known[k : k + room], level) for k in range(0, len(left), room)]
            continue
        if level == 1:
            # a word has every bit, so each leaf's own bits are those its node does not share
            fresh = ~(levels[1][1][left] & levels[1][1][right])[:, None, None]
            apart = known[:, None, None] + np.bitwise_count((padded[left][:, :, None] ^ padded[right][:, None, :]) & fresh)
            k, i, j = np.nonzero(apart <= radius)
            a, b = left[k] * leaf + i, right[k] * leaf + j
            fits = (a < b) & (b < len(codes))
            if fits.any():
                yield a[fits], b[fits]
            continue
        kids = np.arange(span)
        a = np.broadcast_to((left * span)[:, None, None] + kids[None, :, None], (len(left), span, span)).ravel()
        b = np.broadcast_to((right * span)[:, None, None] + kids[None, None, :], (len(left), span, span)).ravel()
        fits = (a < len(pattern)) & (b < len(pattern)) & (a <= b)
        a, b, known = a[fits], b[fits], np.repeat(known, span * span)[fits]
        own = added[level - 1]
        known = known + np.bitwise_count((pattern[a] ^ pattern[b]) & (own[a] & mask[b] | mask[a] & own[b]))
        near = known <= radius
        if near.any():
            start.append((a[near], b[near], known[near], level - 1))


def groups(codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each code word the smallest index of its connected group."""
    label = np.arange(len(codes))
    for a, b in linked(codes, radius):
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(label, high, low)
            while (label != (up := label[label])).any():
                label = up
    return label


def cell_edges(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect each linked group of a cell: a tree of two levels, from a code word's hash alone.

    A group is dealt to about as many parts as the root of its size.  Members lead to the least of their part, those
    to the least of the group.  As hashes decide, a group that shares several cells has mostly the same edges in
    each, so its edges grow with its members and hardly with its cells; no node has more than about two roots of edges.
    """
    codes = np.unique(codes)
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    label = groups(codes, radius)
    sizes = np.bincount(label, minlength=len(codes))
    bits = (np.frexp(np.maximum(sizes, 1).astype(np.float64))[1].astype(np.int64) - 1) // 2
    place = remix(codes)
    part = (place & ((1 << bits[label]) - 1).astype(np.uint64)).astype(np.int64)
    order = np.lexsort((place, part, label))
    codes, label, part, place = codes[order], label[order], part[order], place[order]
    first = (np.diff(label, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)
    heads = np.flatnonzero(first)
    top = heads[np.lexsort((place[heads], label[heads]))]
    top = top[np.diff(label[top], prepend=-1) != 0]  # the least of each group, groups in order
    parent = heads[np.cumsum(first) - 1]
    group = np.cumsum(np.diff(label, prepend=-1) != 0) - 1
    parent[heads] = top[group[heads]]
    child = parent != np.arange(len(codes))
    return codes[child], codes[parent[child]]


def blocks_for(n: int, share: int = 1024, radius: int = RADIUS) -> int:
    """The fewest blocks that leave about ``share`` of ``n`` random fingerprints to a key."""
    for b in range(radius + 1, radius + 5):
        if n >> int(64 / b * (b - radius)) <= share:
            return b
    return radius + 4


def keys(code: Column, b: int, radius: int = RADIUS) -> Column:
    """An array of (table, key) structs: one for each choice of ``b - radius`` of the ``b`` blocks."""
    edges = [64 * k // b for k in range(b + 1)]
    part = [F.shiftrightunsigned(code, edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1)) for k in range(b)]
    tables = []
    for t, chosen in enumerate(itertools.combinations(range(b), b - radius)):
        key = F.lit(0).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(part[k])
        tables.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*tables)


def links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges whose connected groups are those of the linked fingerprints of ``codes`` (fingerprint, distinct)."""
    n = codes.count()
    b = blocks_for(n, 1024, radius)
    return cell_links(codes.select("fingerprint", F.inline(keys(F.col("fingerprint"), b, radius))), n * math.comb(b, radius), radius)


def cell_links(dealt: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b): edges whose connected groups are those of the linked fingerprints that share a cell.

    ``dealt`` has ``n`` rows (t, key, fingerprint); a cell is a key of a table ``t``.
    """
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(MOST_CELL, max(LEAST_CELL, n // max(1, tasks)))
    large = materialise(dealt.groupBy("t", "key").count().where(F.col("count") > share).select("t", "key", F.ceil(F.col("count") / share).cast("int").alias("parts")), "large")
    cells = dealt.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.where((F.col("parts") == 1) | (F.col("own") != F.col("other")))
    cells = cells.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
    cells = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def connect(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the cell that is not over yet
        out: list[np.ndarray] = []

        def take(rows: np.ndarray) -> None:
            if len(rows) > 1:
                a, b = cell_edges(rows, radius)
                if len(a):
                    out.append(np.stack([a, b]).view(np.int64))

        def flush() -> pa.RecordBatch:
            both = np.concatenate(out, axis=1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        last = None
        for batch in source:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "i", "j")])
            code = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                now = tuple(cell[:, a].tolist())
                if now != last:
                    take(np.concatenate(held) if held else np.zeros(0, np.uint64))
                    held, last = [], now
                held.append(code[a:b].copy())
            if sum(x.shape[1] for x in out) > 50_000:
                yield flush()
        take(np.concatenate(held) if held else np.zeros(0, np.uint64))
        if out:
            yield flush()

    return cells.mapInArrow(connect, "a long, b long")


def spread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own, label): the smallest ``own`` of all nodes reachable along ``edges`` (a, b).

    A round takes the least label of the neighbours, then that of the node whose ``own`` the label
    is.  Rounds end when none changed a label.
    """
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = materialise(both.select(F.col("a").alias("node")).distinct().join(nodes, "node").select("node", "own", F.col("own").alias("label")), "labels")
    while True:
        nearby = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = materialise(state.join(nearby, F.col("node") == F.col("a"), "left").select("node", "own", F.least("label", "near").alias("label"), F.col("label").alias("before")), "near")
        jump = step.groupBy("own").agg(F.min("label").alias("further")).withColumnRenamed("own", "at")
        moved = step.join(materialise(jump.where(F.col("further") < F.col("at")), "jump"), F.col("label") == F.col("at"), "left")
        after = materialise(moved.select("node", "own", F.least("label", "further").alias("label"), "before"), "labels")
        if after.where(F.col("label") < F.col("before")).isEmpty():
            return after.select("node", "own", "label")
        state = after.select("node", "own", "label")


def components(df: DataFrame, id_col: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``df``, with its ``keep`` columns; ids are integers."""
    own_names(keep, "fingerprint", "node", "own", "least", "label", "component_id")
    own = materialise(fingerprints(df, text, [id_col, *keep]), "fingerprints")
    folded = materialise(own.groupBy("fingerprint").agg(F.min(id_col).alias("own")), "folded")
    # a fingerprint whose ids are all null takes part with an id beyond all others
    top = F.lit(2**63 - 1)
    nodes = folded.select(F.col("fingerprint").alias("node"), F.coalesce("own", top).alias("own"))
    edges = materialise(links(folded.select("fingerprint")), "links")
    label = spread(edges, nodes)
    least = materialise(nodes.join(label.select("node", "label"), "node", "left").select("node", F.coalesce("label", "own").alias("least")), "components")
    found = own.join(least, F.col("fingerprint") == F.col("node"), "left")
    return found.select(id_col, *keep, "fingerprint", F.nullif("least", top).alias("component_id"))


NEAR_WORDS, NEAR_RADIUS, SIMILARITY = 5, 16, 0.8
BANDS, BAND_ROWS = 25, 5  #: two texts at SIMILARITY share no band with a chance of 5 in 100,000, whatever the table's size
SHORT = 2  #: words of the shingles that fingerprints of candidates are from
MOST_LOCAL = 4096  #: different texts of a component that one task takes in at a time


def near_copies(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_file, _at): the rows of ``docs`` (with ``row_keys``) to drop so that one of each group of near copies stays.

    Each text has ``BANDS`` keys, each from the least of ``BAND_ROWS`` hashes of its ``NEAR_WORDS``-word shingles.
    The texts of a key are a cell, in which the Gray tree links those whose fingerprints differ in ``NEAR_RADIUS``
    bits or fewer; so a text is dealt to as many cells in a table of any size, and unlike texts hardly ever
    become candidates by chance.  These fingerprints are from ``SHORT``-word shingles, each counted once: an edit
    moves them less than longer ones.  Candidates are the components of those links.  Inside a component
    texts are taken by id (nulls last), and one is dropped if its ``NEAR_WORDS``-word shingles have a
    Jaccard similarity of ``SIMILARITY`` or more with those of one that stays; equal texts are
    compared once.  So no row goes without a similar one before it.  Ids may be null or repeated.

    A component of more than ``MOST_LOCAL`` texts is taken in blocks of that many, by the same order: one task
    settles a block, and all later texts, dealt to many tasks, are compared with what stays of it.  A text of
    a later block has then met every earlier one that stays, so the outcome is that of one task.

    Null and empty texts are equal texts without shingles; long texts are read whole; ties in the order of ids go to
    the smaller hash of the text, then to the row's file and place; an empty table drops nothing; ``docs`` may
    have other columns, but none that begin with ``_`` besides those of ``row_keys``.
    """
    own_names([c for c in docs.columns if c not in ("_file", "_at")])
    order = ["_last", id_col, "_hash", "_file", "_at"]
    keyed = docs.select("_file", "_at", id_col, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"))
    own = keyed.select("_file", "_at", id_col, "_body", F.xxhash64("_body").alias("_hash"), F.col(id_col).isNull().alias("_last"))
    own = materialise(marks(own, "_body", order), "marks")
    best = own.groupBy("_one", "_hash").agg(F.min(F.struct(*order)).alias("best"), F.any_value("_bands").alias("_bands"))
    best = materialise(best.select("_one", "_bands", "best.*"), "texts")
    dealt = best.select(F.col("_one").alias("fingerprint"), F.posexplode("_bands").alias("t", "key"))
    edges = materialise(cell_links(dealt, best.count() * BANDS, NEAR_RADIUS), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("own"))
    label = spread(edges, nodes)
    grouped = best.join(label.select("node", "label"), F.col("_one") == F.col("node"), "left").withColumn("_group", F.coalesce("label", "_one"))
    sizes = grouped.groupBy("_group").agg(F.count("*").alias("_size")).where("_size > 1")
    members = materialise(grouped.join(sizes, "_group").select(*order, "_group", "_size"), "members")
    left = materialise(keyed.select("_file", "_at", "_body").join(checked(members, MOST_BROADCAST // 4), ["_file", "_at"]), "candidates")
    dropped = own.join(best.select("_file", "_at"), ["_file", "_at"], "left_anti").select("_file", "_at")
    fields = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in order)
    settled = f"{fields}, _group long, _stays boolean"
    here = left.where(F.col("_size") <= MOST_LOCAL).groupBy("_group").applyInArrow(apart(order), settled)
    dropped = dropped.unionByName(here.where("NOT _stays").select("_file", "_at"))
    rest = left.where(F.col("_size") > MOST_LOCAL).drop("_size")
    while not rest.isEmpty():
        rest = materialise(rest, "rest")
        block = checked(materialise(first_of_each(rest.select("_group", *order), order, MOST_LOCAL).select("_file", "_at"), "block"), MOST_BROADCAST // 4)
        judged = materialise(rest.join(block, ["_file", "_at"]).groupBy("_group").applyInArrow(apart(order), settled), "judged")
        dropped = dropped.unionByName(judged.where("NOT _stays").select("_file", "_at"))
        stays = materialise(rest.join(checked(judged.where("_stays").select("_file", "_at"), MOST_BROADCAST // 4), ["_file", "_at"]).select("_group", "_body"), "stays")
        later = rest.join(block, ["_file", "_at"], "left_anti")
        parts = later.groupBy("_group").agg(F.ceil(F.count("*") / MOST_LOCAL).cast("int").alias("_parts"))
        sent = stays.join(parts, "_group").select("_group", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_body")
        dealt = later.join(parts, "_group").select("_group", F.pmod(F.xxhash64("_hash"), F.col("_parts")).cast("int").alias("_part"), *order, "_body")
        met = dealt.groupBy("_group", "_part").cogroup(sent.groupBy("_group", "_part")).applyInArrow(against(order), settled)
        met = materialise(met, "met")
        dropped = dropped.unionByName(met.where("NOT _stays").select("_file", "_at"))
        rest = later.join(checked(met.where("_stays").select("_file", "_at"), MOST_BROADCAST // 4), ["_file", "_at"])
    return materialise(dropped, "dropped")


def first_of_each(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, first within 64 parts of it, so that no task sorts a whole group."""
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("_hash"), F.lit(64)))
    some = dealt.withColumn("_n", place("_group", "_deal")).where(F.col("_n") <= n)
    return some.withColumn("_n", place("_group")).where(F.col("_n") <= n)


def marks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``_one``, the fingerprint of a text's different short shingles, and ``_bands``, its keys (none without words)."""

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            schema = pa.schema([*(batch.schema.field(k) for k in keep), ("_one", pa.int64()), ("_bands", pa.list_(pa.int64()))])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for body, *rest in rows_of(batch, text, *keep):
                    words = words_of(body)
                    code = majority(np.unique(hashes_of(words, SHORT)))
                    yield (*rest, code - (code >> 63 << 64), bands(np.unique(hashes_of(words, NEAR_WORDS))).view(np.int64))

            yield from batches(rows(), schema)

    out_type = T.StructType([*(df.schema[k] for k in keep), T.StructField("_one", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])
    return df.select(text, *keep).mapInArrow(read, out_type)


def bands(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of hashes: two sets have one in common as often as the least of ``BAND_ROWS`` hashes all agree."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    odd, plus = remix(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64)).reshape(2, -1)
    odd |= np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * odd + plus).min(0), out=least)
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        key = remix(key ^ row)
    return key


def remix(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for each hash, by two rounds of an odd multiplication and a shift."""
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(odd)
    return hashes ^ hashes >> np.uint64(29)


def similar(kept: dict[int, list[int]], sizes: list[int], own: np.ndarray) -> bool:
    """Whether shingles reach SIMILARITY with those of a kept text, by an index of the kept texts' shingles."""
    common: dict[int, int] = {}
    for h in own.tolist():
        for k in kept.get(h, ()):
            common[k] = common.get(k, 0) + 1
    n = len(own)
    return any(c >= SIMILARITY * (n + sizes[k] - c) for k, c in common.items()) or (n == 0 and 0 in sizes)


class Kept:
    """Texts that stay, by their shingles."""

    def __init__(self) -> None:
        self.texts: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, own: np.ndarray) -> None:
        for h in own.tolist():
            self.texts.setdefault(h, []).append(len(self.sizes))
        self.sizes.append(len(own))

    def similar(self, own: np.ndarray) -> bool:
        return similar(self.texts, self.sizes, own)


def own_shingles(body: pa.Scalar) -> np.ndarray:
    return np.unique(shingle_hashes(body.as_py(), NEAR_WORDS))


def told(table: pa.Table, order: list[str], stays: list[bool]) -> pa.Table:
    return pa.table([*(table.column(c) for c in (*order, "_group")), pa.array(stays, pa.bool_())], names=[*order, "_group", "_stays"])


def apart(order: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Marks the rows of a group that stay: those not similar to an earlier one that stays."""

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        kept, stays = Kept(), []
        for body in table.column("_body"):
            own = own_shingles(body)
            stays.append(not kept.similar(own))
            if stays[-1]:
                kept.add(own)
        return told(table, order, stays)

    return judge


def against(order: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Marks the rows that are similar to none of those that stay."""

    def judge(later: pa.Table, first: pa.Table) -> pa.Table:
        kept = Kept()
        for body in first.column("_body") if later.num_rows else ():
            kept.add(own_shingles(body))
        return told(later, order, [not kept.similar(own_shingles(body)) for body in later.column("_body")])

    return judge


def hexadecimal(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")
