"""How much the words of each source differ from other sources of its language, by sums over shards in DuckDB.

Each task counts its texts' terms and deals the counts to shards by a hash of (language, term), so a shard has
all sources of its terms.  There DuckDB adds them up, keeps the terms that enough documents of the language
have (``LEAST``), and, once Spark has the totals of all shards, adds up for each pair of sources what their
common terms contribute.  Spark adds the shards' sums and ranks.  A shard gives out somewhat more than its even
share of a source's leading terms first; only where its last one is not behind the last leader of all
shards does it give out the others that may lead, so the result is exact and rows hardly grow with shards.  Between tasks a shard's terms travel as
lists, a row for each task and shard, so Spark moves a few rows for millions of counts.

With p and q the smoothed shares of a term in two sources, in billionths, its divergence is
f = floor((p - q)^2 / q).  A pair's value is the sum over all kept terms of the language, also those that
neither has.  Only terms that both have are joined, in their shard.  As a term that a source lacks has the
same share whichever it is, all others follow from how often each count occurs in a source:

    sum over terms of s of f(p, o's empty share) + sum over terms of o of f(s's empty share, q)
    + (V - terms of s - terms of o) * f(both empty) + sum over common terms of what they differ from that

All of it is in whole numbers: 128-bit integers in DuckDB, decimals of 38 digits in Spark.

Defined cases: null text, language and source count as empty; a (language, source) without terms is a
group like any other; a language without kept terms has value 0 for all its pairs; a language with one
source has no pairs; ties go to the item first in UTF-8; long texts are read whole, those over ``SLICE`` bytes in pieces;
repeated rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, materialise

LEAST, TOP = 3, 200
SPARE = 8  #: terms that a shard gives out first for a group, besides its even share of the leading ones
SHARD = 1 << 14  #: documents for each shard, at most
SMALL = 1 << 10  #: documents for each shard, at least, before there are as many shards as shuffle partitions
HELD = 1_000_000  #: counts that a task holds before it gives them out
SLICE = 4 << 20  #: bytes of texts that are split into words at a time; longer texts are counted in pieces
PIECE = 1 << 20
UNIT = 1_000_000_000
ENTRY = ["group", "term", "n", "docs"]

#: ASCII letters in lower case and all other characters' bytes stay; the rest parts terms.
BYTES = bytes(b if chr(b).isalpha() else 32 for b in range(128)).lower() + bytes(range(128, 256))


def pieces(body: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text's terms, parted by blanks, in pieces that end between terms."""
    text, at = body.translate(BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def count_one(body: bytes, group: int) -> pa.Table:
    """A long text's terms, counted piece by piece."""
    n: Counter[bytes] = Counter()
    for piece in pieces(body):
        n.update(piece.split())
    return pa.table([pa.array([group] * len(n), pa.int32()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([1] * len(n), pa.int64())], names=ENTRY)


def count_many(bodies: pa.Array, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of texts, one number of a group for each."""
    _, ends, data = bodies.buffers()
    text = pa.py_buffer(data.to_pybytes().translate(BYTES)) if data is not None else pa.py_buffer(b"")
    # the bytes left are letters and bytes from 128, whose runs an ASCII split leaves whole
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(bodies), ends, text, offset=bodies.offset))
    coded = words.flatten().dictionary_encode()
    code, doc = coded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(words).to_numpy()
    terms = coded.dictionary.cast(pa.binary())
    some = pc.binary_length(terms).to_numpy(zero_copy_only=False)[code] > 0 if len(code) else np.zeros(0, bool)
    code, doc = code[some], doc[some]
    size = np.int64(max(1, len(terms)))
    key, n = np.unique(group[doc] * size + code, return_counts=True)
    once = np.unique(doc * size + code)
    _, docs = np.unique(group[once // size] * size + once % size, return_counts=True)
    return pa.table([pa.array((key // size).astype(np.int32)), terms.take(pa.array(key % size)), pa.array(n), pa.array(docs)], names=ENTRY)


def dealt(parts: list[pa.Table], names: list[tuple[str, str]], shards: int) -> pa.RecordBatch:
    """What a task has counted, a row for each shard: its groups, and for each count its group's place there, term, n and docs."""
    whole = pa.concat_tables(parts)
    if len(parts) > 1:
        whole = whole.group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(ENTRY)
    whole = whole.combine_chunks()
    group = whole.column("group").to_numpy()
    langs = [lang.encode() for lang, _ in names]
    seeds = [xxhash.xxh64_intdigest(lang) for lang in langs]
    shard = np.empty(len(group), np.int64)
    for at in range(0, len(group), 1 << 15):
        own = zip(group[at : at + (1 << 15)].tolist(), whole.column("term").slice(at, 1 << 15).to_pylist(), strict=True)
        shard[at : at + (1 << 15)] = [xxhash.xxh64_intdigest(t, seeds[g]) % shards for g, t in own]
    order = np.lexsort((group, shard))
    shard, group = shard[order], group[order]
    # runs of one group within one shard, and the shards' first runs
    run = np.cumsum((np.diff(shard, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0)) - 1
    runs, rows = np.flatnonzero(np.diff(run, prepend=-1)), np.flatnonzero(np.diff(shard, prepend=-1))
    row = np.cumsum(np.diff(shard, prepend=-1) != 0) - 1
    who = [names[g] for g in group[runs].tolist()]
    place = (run - run[rows][row] + 1).astype(np.int32)
    ends, run_ends = pa.array(np.append(rows, len(order)).astype(np.int32)), pa.array(np.append(run[rows], len(runs)).astype(np.int32))
    own = whole.take(pa.array(order))
    lists = [pa.ListArray.from_arrays(run_ends, pa.array([x[k] for x in who], pa.string())) for k in (0, 1)]
    lists += [pa.ListArray.from_arrays(ends, c) for c in (pa.array(place), *(own.column(c).combine_chunks() for c in ("term", "n", "docs")))]
    return pa.RecordBatch.from_arrays([pa.array(shard[rows]), *lists], ["shard", "langs", "sources", "at", "terms", "n", "docs"])


def count_terms(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, langs, sources, at, terms, n, docs) of ``rows`` (lang, source, body): what each task counts, in lists."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        parts: list[pa.Table] = []
        for batch in batches:
            group = np.array([known.setdefault(g, len(known)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            sizes = pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                # as many texts as fit, or one long text
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, "right")))
                long = end == at + 1 and sizes[at] > SLICE
                parts.append(count_one(batch.column("body")[at].as_py(), int(group[at])) if long else count_many(batch.column("body").slice(at, end - at), group[at:end]))
                at = end
                if sum(map(len, parts)) >= HELD:
                    yield dealt(parts, list(known), shards)
                    parts = []
        if sum(map(len, parts)):
            yield dealt(parts, list(known), shards)

    return rows.mapInArrow(part, "shard long, langs array<string>, sources array<string>, at array<int>, terms array<binary>, n array<long>, docs array<long>")


#: Of a shard: the terms that enough documents of the language have, in lists by source, and how often each count occurs.
KEEP = """
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS of_row, * FROM held),
g AS (SELECT of_row, generate_subscripts(langs, 1) AS place, unnest(langs) AS lang, unnest(sources) AS source FROM r),
e AS (SELECT of_row, unnest("at") AS place, decode(unnest(terms)) AS term, unnest(n) AS n, unnest(docs) AS docs FROM r),
c AS MATERIALIZED (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM e JOIN g USING (of_row, place) GROUP BY ALL),
t AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS of_lang, min(source) AS first FROM c GROUP BY lang, term HAVING sum(docs) >= $least),
k AS MATERIALIZED (SELECT c.lang, source, term, n, of_lang, first FROM c JOIN t USING (lang, term)),
h AS (SELECT lang, source, list({'n': n, 'times': times}) AS counts FROM (SELECT lang, source, n, count(*) AS times FROM k GROUP BY ALL) GROUP BY ALL)
SELECT (SELECT min(shard) FROM held) AS shard, k.lang, k.source, list({'term': term, 'n': n, 'of_lang': of_lang}) AS entries, any_value(counts) AS counts,
  CAST(sum(n) AS BIGINT) AS total, count(*) AS terms, count(*) FILTER (first = k.source) AS new
FROM k JOIN h ON h.lang = k.lang AND h.source = k.source GROUP BY k.lang, k.source
"""
KEPT = "shard long, lang string, source string, entries array<struct<term string, n long, of_lang long>>, counts array<struct<n long, times long>>, total long, terms long, new long"

MACROS = """
CREATE MACRO share(n, total) AS CAST(1 + CAST(n + 1 AS HUGEINT) * 1000000000 // total AS BIGINT);
CREATE MACRO apart(p, q) AS (p - q) * (p - q) // q;
"""

#: Of a shard's terms: those that lead each source, by f.
LED = """
WITH e AS (SELECT shard, lang, source, total, lang_total, v, floor, unnest(entries) AS e FROM held),
k AS MATERIALIZED (
  SELECT shard, lang, source, floor, e.term AS term, share(e.n, total + v) AS p, share(0, total + v) AS p0, share(e.of_lang, lang_total + v) AS q FROM e),
led AS (SELECT shard, lang, source, term, floor, apart(p, q) AS f FROM k WHERE p > q)
"""
OUT = "shard long, lang string, source string, part string, item string, value decimal(38,0), last boolean"

#: What pairs of sources have in common, and the first terms of each source; ``last`` if the shard may have more.
SUMS = f"""{LED}
SELECT NULL AS shard, a.lang, a.source, 'pair' AS part, b.source AS item,
  CAST(sum(apart(a.p, b.p) - apart(a.p, b.p0) - apart(a.p0, b.p) + apart(a.p0, b.p0)) AS DECIMAL(38, 0)) AS value, false AS last
FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
UNION ALL
SELECT shard, lang, source, 'term', term, CAST(f AS DECIMAL(38, 0)), place = $first FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) AS place FROM led QUALIFY place <= $first)
"""

#: The terms after those, as far as they may come among the leading ones of all shards.
MORE = f"""{LED}
SELECT shard, lang, source, 'term' AS part, term AS item, CAST(f AS DECIMAL(38, 0)) AS value, false AS last FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) AS place FROM led QUALIFY place > $first AND place <= $top AND f >= floor)
"""


def on_shards(rows: DataFrame, sql: str, schema: str, macros: str = "", **values: int) -> DataFrame:
    """The result of a DuckDB query over each shard's rows, which it sees as ``held``."""

    def run(held: pa.Table) -> pa.Table:
        with duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"}) as db:
            if macros:
                db.execute(macros)
            db.register("held", held)
            return db.sql(sql, params=values).to_arrow_table()

    return rows.groupBy("shard").applyInArrow(lambda t: run(t), schema)


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total), as DuckDB's macro has it."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, total.cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so the square fits in a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def pairs(kept: DataFrame, groups: DataFrame, common: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of every pair of sources of a language; ``groups`` has a row for each."""
    empty = F.when(F.col("v") > 0, share(F.lit(0), F.col("total") + F.col("v"))).otherwise(F.lit(1).cast("long"))
    own = groups.select("lang", "source", "terms", "v", empty.alias("empty"))
    other = checked(own.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("empty").alias("item_empty")))
    neither = (F.col("v") - F.col("terms") - F.col("item_terms")).cast("decimal(20,0)") * apart(F.col("empty"), F.col("item_empty"))
    base = own.join(other, "lang").where("source != item").select("lang", "source", "item", neither.cast("decimal(38,0)").alias("value"))
    # how often each count occurs in a source stands for its terms
    times = kept.select("lang", "source", F.inline("counts")).groupBy("lang", "source", "n").agg(F.sum("times").alias("times")).join(checked(groups), ["lang", "source"])
    times = times.select("lang", "source", F.col("times").cast("decimal(18,0)").alias("times"), share(F.col("n"), F.col("total") + F.col("v")).alias("p"))
    sides = times.join(other, "lang").where("source != item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * apart(F.col("p"), F.col("item_empty"))).cast("decimal(38,0)").alias("there"),
        F.sum(F.col("times") * apart(F.col("item_empty"), F.col("p"))).cast("decimal(38,0)").alias("back"),
    )
    sides = materialise(sides, "sides")
    there = sides.select("lang", "source", "item", F.col("there").alias("value"))
    back = sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    parts = base.unionByName(there).unionByName(back).unionByName(common.select("lang", "source", "item", "value"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def rank(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item")))


def leaders(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group, first within parts of it, so that no task takes all shards' rows of a group."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(64)))
    first = rank(dealt, ["lang", "source", "deal"]).where(F.col("rank") <= top)
    return rank(first.select("lang", "source", "item", F.col("value").cast("long").alias("value")), ["lang", "source"]).where(F.col("rank") <= top)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every pair of sources of a language and of each source's leading terms."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("body"))
    n = df.count()
    shards = max(1, min(tasks, n // SMALL), -(-n // SHARD))
    kept = materialise(on_shards(count_terms(rows, shards), KEEP, KEPT, least=least), "kept")

    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    totals = kept.groupBy("lang", "source").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("new").alias("v"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.select("lang", "source", *map(zero, ("total", "terms", "lang_total", "v"))), "groups")

    known = checked(groups.select("lang", "source", "total", "lang_total", "v"))
    shares = kept.select("shard", "lang", "source", "entries").join(known, ["lang", "source"])
    first = min(top, -(-top // shards) + SPARE)
    sums = materialise(on_shards(shares.withColumn("floor", F.lit(0).cast("long")), SUMS, OUT, MACROS, first=first), "sums")
    led = sums.where("part = 'term'")
    out = ["lang", "source", "part", "item", "value", "rank"]
    of_pairs = rank(pairs(kept, groups, sums.where("part = 'pair'")), ["lang", "source"]).withColumn("part", F.lit("pair"))
    of_terms = materialise(leaders(led, top), "leaders")
    if first < top:
        # a shard has more for a group only if the last term it gave out is not behind the group's last leader
        floors = of_terms.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("floor"))
        floors = groups.select("lang", "source").join(floors, ["lang", "source"], "left").select("lang", "source", F.coalesce("floor", F.lit(0)).alias("floor"))
        open_ = materialise(led.where("last").join(floors, ["lang", "source"]).where(F.col("value") >= F.col("floor")).select("shard", "lang", "source", "floor"), "open")
        if not open_.isEmpty():
            more = materialise(on_shards(shares.join(open_, ["shard", "lang", "source"]), MORE, OUT, MACROS, first=first, top=top), "more")
            of_terms = leaders(led.unionByName(more), top)
    return of_pairs.select(*out).unionByName(of_terms.withColumn("part", F.lit("term")).select(*out))
