"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with every run of other than letters and digits as one space.
An item of m characters may differ by k = m // CHARS_PER_EDIT edits; it is cut into k + 1 pieces, one of which
must then stand unchanged in any text that holds it. One Aho-Corasick scan of a document finds all pieces;
each hit names the stretch where its item would lie, and Myers' bit-parallel distance of the item within the
merged stretches decides. Documents never meet each other and nothing is shuffled.

Items travel to the tasks in shards of about SHARD_CHARS characters, so the automaton's size is bounded however large the benchmark
grows. One shard is one scan. Beyond that the normalised texts are written once, and one shard at a time is read by the
driver, broadcast, scanned for, its result written, and let go: memory holds one shard, time grows with their number.

Defined results: null texts and items count as empty; an item without letters or digits matches nothing; an item too short for
an edit must stand as whole words ("no" is not found in "nothing"), a longer one may begin and end within words;
repeated items or item ids give one row per (document row, item_id), with the least distance; rows with a
null doc_id are reported with it; empty tables give an empty result; extra columns, whatever their names, are ignored, or kept by
``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import durable

CHARS_PER_EDIT = 12
SHARD_CHARS = 4_000_000
GRAM, FEW = 5, 64


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``item`` cut into k + 1 nearly equal pieces."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, masks: dict[str, int]) -> tuple[int, int]:
    """(least edit distance of ``item`` to any part of ``text``, end of the first such part)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, now, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & top:
            now += 1
        elif hn & top:
            now -= 1
        hp = (hp << 1) & full
        vp = ((hn << 1) & full) | (full & ~(hp | d0))
        vn = hp & d0
        if now < best:
            best, end = now, j + 1
    return best, end


class Matcher:
    """Finds items in texts. Occurrences are kept as ranges per piece, not per item, so a piece that many items share and that a text
    repeats costs its occurrences once; and where several items might stand in a text, those that lack too many of their GRAM-character parts there
    (an edit spoils GRAM of them at most) are dismissed before any distance is computed."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(i, t, len(t) // chars_per_edit) for i, t in items if t]
        posts: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                posts.setdefault(piece, []).append((n, at))
        self.posts = [(len(piece), at) for piece, at in posts.items()]
        self.reach = [max(len(self.items[n][1]) + 2 * self.items[n][2] for n, _ in at) for _, at in self.posts]
        self.exact = {number: own for number, (_, at) in enumerate(self.posts) if (own := [n for n, _ in at if not self.items[n][2]])}
        self.machine = ahocorasick.Automaton()
        for number, piece in enumerate(posts):
            self.machine.add_word(piece, number)
        if posts:
            self.machine.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def _masks(self, n: int) -> dict[str, int]:
        if n not in self.masks:
            out: dict[str, int] = {}
            for i, c in enumerate(self.items[n][1]):
                out[c] = out.get(c, 0) | 1 << i
            self.masks[n] = out
        return self.masks[n]

    def _ranges(self, text: str) -> tuple[dict[int, list[list[int]]], dict[int, int]]:
        """(ranges of ends by piece, a gap within them never longer than the items' reach; the end of each item without an edit where it stands as whole words)."""
        ranges: dict[int, list[list[int]]] = {}
        last: dict[int, list[int]] = {}
        whole: dict[int, int] = {}
        reach, exact = self.reach, self.exact
        for end, number in self.machine.iter(text):
            own = last.get(number)
            if own is not None and end - own[1] <= reach[number]:
                own[1] = end
            else:
                last[number] = own = [end, end]
                ranges.setdefault(number, []).append(own)
            if number in exact and exact[number][0] not in whole:
                size = self.posts[number][0]
                if (end + 1 == len(text) or text[end + 1] == " ") and (end + 1 == size or text[end - size] == " "):
                    whole.update(dict.fromkeys(exact[number], end + 1))
        return ranges, whole

    def _likely(self, text: str, among: list[int]) -> list[int]:
        """The items of ``among`` that have enough of their parts in the text."""
        parts = {n: [self.items[n][1][i : i + GRAM] for i in range(len(self.items[n][1]) - GRAM + 1)] for n in among}
        wanted = {p for own in parts.values() for p in own}
        there = {p for i in range(len(text) - GRAM + 1) if (p := text[i : i + GRAM]) in wanted}
        return [n for n in among if sum(p in there for p in parts[n]) >= len(parts[n]) - GRAM * self.items[n][2]]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, end) of every item within its budget."""
        if not self.items or not text:
            return []
        ranges, whole = self._ranges(text)
        best: dict[int, tuple[int, int, int]] = {}
        for n, end in sorted(whole.items()):
            best.setdefault(self.items[n][0], (0, 0, end))
        spots: dict[int, list[tuple[int, int]]] = {}
        for number in ranges:
            for n, at in self.posts[number][1]:
                if self.items[n][2]:
                    spots.setdefault(n, []).append((number, at))
        among = list(spots) if len(spots) <= FEW else self._likely(text, list(spots))
        for n in sorted(among):
            i, item, k = self.items[n]
            starts = sorted((lo + 1 - self.posts[p][0] - at, hi + 1 - self.posts[p][0] - at) for p, at in spots[n] for lo, hi in ranges[p])
            stretches: list[list[int]] = []
            for lo, hi in starts:
                a, b = max(0, lo - k), min(len(text), hi + len(item) + k)
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], b)
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                at = text.find(item, a, b)
                d, end = (0, at - a + len(item)) if at >= 0 else myers(item, text[a:b], self._masks(n))
                if d <= k and (i not in best or d < best[i][0]):
                    best[i] = (d, k, a + end)
        return [(i, *found) for i, found in best.items()]


def items_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct normalised items (item_id, t), written once, and in how many shards they are dealt."""
    items = durable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), normal(F.col("text")).alias("t")).where("t <> ''").distinct())
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    return items, -(-total // SHARD_CHARS)


def shard(items: DataFrame, n: int, i: int) -> list[tuple[int, str]]:
    """The items of shard ``i`` of ``n``: about SHARD_CHARS characters."""
    return [(r["item_id"], r["t"]) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i).orderBy("item_id", "t").collect()]


def over_shards(rows: DataFrame, benchmark: DataFrame, scan: Callable[[DataFrame, object], DataFrame], chain: bool) -> list[DataFrame]:
    """``scan(rows, broadcast items)`` for each shard; with ``chain`` each scan takes the rows that the one before left."""
    items, n = items_of(benchmark)
    if n > 1:
        rows = durable(rows)
    found = []
    for i in range(n):
        shared = rows.sparkSession.sparkContext.broadcast(shard(items, n, i))
        part = scan(rows, shared)
        if n > 1:
            part = durable(part)
            shared.unpersist()
        rows = part if chain else rows
        found.append(part)
    return found


def matches(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, item_id, distance, budget, end (in the normalised text): one row per document and item found."""
    schema = "doc_id long, item_id long, distance int, budget int, end long"

    def scan(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, chars_per_edit)
            for batch in batches:
                rows = [(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in matcher.find(t.as_py())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "budget", "end"])

        return rows.mapInArrow(run, schema)

    parts = over_shards(docs.select(F.col("doc_id").cast("long"), normal(F.col("text")).alias("t")), benchmark, scan, False)
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns unchanged."""
    columns = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]  # any name reaches the tasks and comes back

    def scan(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, chars_per_edit)
            for batch in batches:
                clean = [not matcher.find(t.as_py()) for t in batch.column(batch.num_columns - 1)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    parts = over_shards(docs.select(*columns, normal(F.col("text")).alias("normal")), benchmark, scan, True)
    return parts[-1].drop("normal").toDF(*docs.columns) if parts else docs
