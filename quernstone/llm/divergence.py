"""Audit of how sources of a language differ in their words, over the terms that enough documents hold.

The kept terms of a language (in at least MIN_DOCS of its documents) are found by iceberg refinement of byte prefixes: a term cannot be
in more documents than any of its prefixes. Each level takes prefixes twice as long as the last (FIRST_BYTES at first); per document the distinct
prefixes of terms that survived so far are counted, summed by (language, prefix), and those below the threshold are
dropped. A term carries an end mark, so a prefix with the mark is a whole term and its count is final; the levels end when only whole
terms survive. Rare terms, most of any corpus's vocabulary, thus never leave the tasks under more than a short prefix.

Which prefixes survived travels to the tasks as a bitmap of bounded size over their hashes, whatever their number: a collision lets a
dropped prefix be counted once more, never a kept one be lost, and the counts themselves are exact. Documents are
cut into words twice: once for the distinct terms (written as one value per document), once for the occurrences of kept terms.
Counting in tasks is done in dictionaries of bounded size.

Then shares p = 1 + floor(SCALE * (count + 2) / (N + 2 V)) are integers, and the divergence of two of them is floor((p - q)^2 / (p + q)). All pairs of
a language's sources are summed in blocks of terms: two tiles of sources at a time meet as a matrix of shares,
which yields one partial sum per pair; so no task holds a language's terms, and no pair is emitted per term.

Defined results: null text, language or source are as empty ones; every row is a document of its own, whatever its id; a group without terms has all counts 0;
a language without kept terms has sums of 0; equal values rank by the bytes of their item; a language with one source has no pairs; an empty
table gives an empty table; texts and terms of any length; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.durable import durable, join_small

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
FIRST_BYTES = 4
#: bytes of a text as they stand in terms: A-Z as a-z, other ASCII but letters as a blank
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
END = b"\x00"


@dataclass(frozen=True)
class Bounds:
    """What tasks hold at most: entries of a dictionary, bits of the survivors' bitmap (a multiple of 32,768), about the terms of a block, sources of a tile."""

    flush: int = 400_000
    bits: int = 1 << 24
    block: int = 2048
    tile: int = 256


def terms(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def bitmap(prefixes: DataFrame, bits: int) -> np.ndarray:
    """The set of the hashes of (lang, prefix), as ``bits`` bits; at most bits / 32,768 rows of 4 KB reach the driver."""
    x = F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(bytearray(END)), F.col("prefix"))) % bits + 1
    rows = prefixes.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def alive_ones(bits: np.ndarray, lang: str, prefixes: list[bytes]) -> np.ndarray:
    """Which of a language's prefixes are in the bitmap."""
    crc, seed = zlib.crc32, zlib.crc32(lang.encode() + END)
    h = np.fromiter((crc(p, seed) for p in prefixes), dtype=np.int64, count=len(prefixes)) % (8 * len(bits))
    return (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)


class Counted:
    """Counts by group and key, given away as rows (group..., key, n) whenever they hold ``flush`` keys; of a flush's keys, those for which
    ``wanted`` (group, keys) is true."""

    def __init__(self, names: list[str], flush: int, wanted: Callable[[tuple, list[bytes]], np.ndarray] | None = None):
        self.names, self.flush, self.wanted, self.keys = names, flush, wanted, 0
        self.counts: dict[tuple, Counter] = defaultdict(Counter)

    def add(self, group: tuple, keys) -> Iterator[pa.RecordBatch]:
        own = self.counts[group]
        before = len(own)
        own.update(keys)
        self.keys += len(own) - before
        if self.keys >= self.flush:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for group, own in self.counts.items():
            keys, n = pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())
            if self.wanted is not None:
                good = pa.array(self.wanted(group, list(own)))
                keys, n = keys.filter(good), n.filter(good)
            yield pa.RecordBatch.from_arrays([*[pa.repeat(pa.scalar(g, pa.string()), len(n)) for g in group], keys, n], names=self.names)
        self.counts.clear()
        self.keys = 0


def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, terms): the distinct terms of each text, each with its end mark, joined by blanks."""
    for b in batches:
        found = [b"".join([t + END + b" " for t in set(terms(x.as_py()))]) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["lang", "terms"])


def prefix_counter(size: int, before: int, alive: np.ndarray | None, flush: int):
    """Counts documents by the distinct prefixes of ``size`` bytes of their terms. On later levels only terms go on that were
    no whole term at the last one (``before`` bytes hold no end mark) and whose prefix there is ``alive``."""
    wanted = None if alive is None else lambda group, keys: alive_ones(alive, group[0], [k[:before] for k in keys])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counted(["lang", "prefix", "docs"], flush, wanted)
        for b in batches:
            for lang, marked in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from sums.add((lang,), {t[:size] for t in marked.as_py().split() if len(t) > before})
        yield from sums.rows()

    return count


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bounds: Bounds = Bounds()) -> DataFrame:
    """(lang, term): the kept terms, as bytes, of ``docs`` (lang, source, text; without nulls)."""
    found = durable(docs.select("lang", "text").mapInArrow(distinct_terms, "lang string, terms binary"))
    size, before, alive, out = FIRST_BYTES, 0, None, None
    while True:
        counted = found.mapInArrow(prefix_counter(size, before, alive, bounds.flush), "lang string, prefix binary, docs long")
        level = durable(counted.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs))
        whole = F.endswith(F.col("prefix"), F.lit(bytearray(END)))
        kept = level.where(whole).select("lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term"))
        out = kept if out is None else out.unionByName(kept)
        open_ = level.where(~whole).select("lang", "prefix")
        if open_.isEmpty():
            return durable(out)
        alive, before, size = bitmap(open_, bounds.bits), size, 2 * size


def occurrence_counter(alive: np.ndarray, flush: int):
    """Counts of the terms in ``alive`` by (lang, source); a few others come along, by equal hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counted(["lang", "source", "term", "n"], flush, lambda group, keys: alive_ones(alive, group[0], keys))
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield from sums.add((lang, source), terms(text.as_py()))
        yield from sums.rows()

    return count


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), by decimals where the product is no long."""
    wide = lambda c: c.cast("decimal(20,0)")
    div = lambda a, b: F.call_function("div", a, b)
    short = div(F.lit(SCALE).cast("long") * (count + 2), n + 2 * v)
    return F.lit(1).cast("long") + F.when(count < (1 << 62) // SCALE, short).otherwise(div(F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 2), wide(n) + 2 * wide(v)))


def apart(p, q):
    """The divergence of two shares: columns."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def cells_of(docs: DataFrame, kept: DataFrame, bounds: Bounds) -> DataFrame:
    """(lang, source, term, n, lang_n): the occurrences of every kept term in a source, where there are any, and in its language."""
    alive = bitmap(kept.withColumnRenamed("term", "prefix"), bounds.bits)
    counted = docs.select("lang", "source", "text").mapInArrow(occurrence_counter(alive, bounds.flush), "lang string, source string, term binary, n long")
    # rows are dealt by term once: for their sums, for the check against the kept terms and for the language's sums
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    true = summed.join(kept.hint("merge"), ["lang", "term"])
    return durable(true.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))))


def groups_of(docs: DataFrame, kept: DataFrame, cells: DataFrame, tile: int) -> DataFrame:
    """(lang, source, place, tiles, v, total, lang_total): every (lang, source) that occurs; ``place`` counts a language's sources from 0."""
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    total = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own = docs.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["v", "total"])
    lang = Window.partitionBy("lang")
    place = (F.row_number().over(lang.orderBy("source")) - 1).alias("place")
    tiles = F.ceil(F.count("*").over(lang) / tile).cast("int").alias("tiles")
    return durable(own.select("lang", "source", place, tiles, "v", "total", F.sum("total").over(lang).alias("lang_total")))


SUMS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def block_sums(block: pa.Table, tile: int) -> pa.Table:
    """Sums over one block's terms of the divergence of every pair of sources, one of each tile. Rows without a term
    give a source's share of the terms that it lacks, and how many terms the block has: those that none of these sources has count as well."""
    place, p = block["place"].to_numpy(), block["p"].to_numpy()
    term = block["term"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    bare = term < 0
    here, at = np.unique(place, return_inverse=True)
    absent = np.zeros(len(here), dtype=np.int64)
    absent[at[bare]] = p[bare]
    shares = np.tile(absent, (term.max() + 1, 1))
    shares[term[~bare], at[~bare]] = p[~bare]
    tile_a, tile_b = block["tile_a"][0].as_py(), block["tile_b"][0].as_py()
    terms = pc.max(block["terms"]).as_py()
    a, b, value = [], [], []
    for i in np.flatnonzero(here // tile == tile_a):
        others = np.flatnonzero((here // tile == tile_b) & (here > here[i]))
        x, y = shares[:, [i]], shares[:, others]
        a.append(np.full(len(others), here[i], dtype=np.int32))
        b.append(here[others].astype(np.int32))
        lacked = (absent[i] - absent[others]) ** 2 // (absent[i] + absent[others])
        value.append(((x - y) * (x - y) // (x + y)).sum(axis=0) + (terms - len(shares)) * lacked)
    lang = pa.array([block["lang"][0].as_py()] * sum(map(len, a)), pa.string())
    return pa.Table.from_arrays([lang, *[pa.array(np.concatenate(x)) for x in (a, b, value)]], schema=SUMS)


def pairs(cells: DataFrame, groups: DataFrame, kept: DataFrame, bounds: Bounds) -> DataFrame:
    """lang, source, item (another source of the language), value: both ways."""
    tile = bounds.tile
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / bounds.block)).cast("long")
    block = F.pmod(F.xxhash64("term"), blocks).alias("block")
    full = join_small(cells, groups, ["lang", "source"], "inner")
    full = full.select("lang", block, "place", "tiles", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), F.lit(None).cast("long").alias("terms"))
    terms = join_small(kept, groups.select("lang", "v").distinct(), ["lang"], "inner").groupBy("lang", block).agg(F.count("*").alias("terms"))
    absent = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1).alias("p")
    bare = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "place", "tiles", F.lit(None).cast("binary").alias("term"), absent)
    bare = join_small(bare, durable(terms), ["lang", "block"]).na.fill(0, ["terms"])
    own = F.floor(F.col("place") / tile).cast("int")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(own, u).alias("tile_a"), F.greatest(own, u).alias("tile_b")))).alias("m")
    dealt = full.unionByName(bare).select("lang", "block", "place", "term", "p", "terms", meets).select("lang", "block", "m.tile_a", "m.tile_b", "place", "term", "p", "terms")
    sums = dealt.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(lambda block: block_sums(block, tile), "lang string, a int, b int, value long")
    one = durable(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = one.unionByName(one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda k, c: groups.select("lang", F.col("place").alias(k), F.col("source").alias(c))
    named = join_small(join_small(both, name("a", "source"), ["lang", "a"], "inner"), name("b", "item"), ["lang", "b"], "inner")
    return named.select("lang", "source", "item", "value")


def striking(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term of the group whose share is above the language's), value."""
    at = join_small(cells, groups, ["lang", "source"], "inner")
    at = at.select("lang", "source", F.decode("term", "UTF-8").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    return at.where(F.col("p") > F.col("q")).select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bounds: Bounds = Bounds()) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` holds every other source of the language, ``term`` the ``top`` most striking kept terms."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_terms(docs, min_docs, bounds)
    cells = cells_of(docs, kept, bounds)
    groups = groups_of(docs, kept, cells, bounds.tile)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return out(pairs(cells, groups, kept, bounds), "pair").unionByName(out(striking(cells, groups), "term").where(F.col("rank") <= top))
