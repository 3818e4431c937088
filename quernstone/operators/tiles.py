"""Pairs of documents and what these documents hold, by tiles: a document's sets or texts travel once per tile of pairs, not once per pair.

Documents have a block each (``blocks``): stretches of bounded summed weight in an order that puts likely partners side by side. The pairs of two
blocks form a tile. A tile's documents come first in its stream, then its pairs, which are met as they pass, so a task holds two blocks of
documents and a batch of pairs, whatever the number of pairs. A document goes to those tiles only in which it has a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import durable, join_small
from quernstone.plans.ranges import running

#: Weight (entries of a document's sets, or words) of a block, the least weight of a document, pairs in one batch of results, and pairs
#: of texts that are compared entry by entry (some milliseconds each) from which on a tile may be cut.
BLOCK, LEAST_WEIGHT, BATCH, COSTLY = 1_000_000, 250, 200_000, 200


def blocks(docs: DataFrame, label: str, id_: str, weight: Column, block: int = BLOCK) -> DataFrame:
    """(id, block) of every row: rows in the order of label and id, cut where the running weight passes another ``block``."""
    x = docs.select(id_, label, F.greatest(weight, F.lit(LEAST_WEIGHT)).cast("long").alias("weight_"))
    placed = running(x, [F.col(label), F.col(id_)], {"before_": F.col("weight_")})
    return placed.select(id_, F.floor(F.col("before_") / block).cast("int").alias("block"))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, stretch) of a stream sorted by its first ``keys`` columns: a key's rows come in one stretch or several, in order."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        moved = np.zeros(n, bool)
        for v in own:
            moved[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(moved).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(int(v[lo]) for v in own), batch.slice(lo, hi - lo)


class Sets:
    """The sets of a tile's documents (a column of arrays of longs, each without repeats), numbered, for meeting them pair by pair.
    Entries that only one of the documents holds are left out at once."""

    def __init__(self, column: pa.ChunkedArray, weights: pa.ChunkedArray | None = None) -> None:
        lists = pa.concat_arrays(column.chunks)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        names, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        often = np.bincount(codes, minlength=len(names))[codes] > 1
        self.codes, owner = codes[often], owner[often]
        self.weights = None if weights is None else pa.concat_arrays(weights.chunks).flatten().to_numpy().astype(np.int64)[often]
        self.size = np.bincount(owner, minlength=len(lists))
        self.begin = np.concatenate([[0], self.size.cumsum()])
        order = np.argsort(self.codes, kind="stable")
        self.posted, self.posted_weights = owner[order], None if self.weights is None else self.weights[order]
        self.first = np.concatenate([[0], np.bincount(self.codes, minlength=len(names)).cumsum()])
        self.mark = np.zeros(len(names), bool)

    def common(self, ia: np.ndarray, ib: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray | None]:
        """For each pair of places the number of common entries, and their summed weight in the second set. Pairs should come by ``ia``: those of one
        document are counted over the postings of its entries or over its partners' sets, whichever are shorter."""
        count, heavy = np.zeros(len(ia), np.int64), None if self.weights is None else np.zeros(len(ia), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(ia[1:] != ia[:-1]) + 1, [len(ia)]]).tolist() if len(ia) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = self.codes[self.begin[ia[lo]] : self.begin[ia[lo] + 1]]
            size = self.size[ib[lo:hi]]
            n = self.first[own + 1] - self.first[own]
            if min(most, int(size.sum())) > int(n.sum()):
                at = self._places(self.first[own], n)
                count[lo:hi] = np.bincount(self.posted[at], minlength=len(self.size))[ib[lo:hi]]
                if heavy is not None:
                    heavy[lo:hi] = np.bincount(self.posted[at], self.posted_weights[at], len(self.size))[ib[lo:hi]].astype(np.int64)
                continue
            self.mark[own] = True
            ends = size.cumsum()
            while lo < hi:
                n = max(1, int(np.searchsorted(ends, most + (ends[0] - self.size[ib[lo]]), "right")))
                b = ib[lo : lo + n]
                upto = np.concatenate([[0], self.size[b].cumsum()])
                at = self._places(self.begin[b], self.size[b])
                hit = self.mark[self.codes[at]]
                count[lo : lo + n] = np.diff(np.concatenate([[0], hit.cumsum()])[upto])
                if heavy is not None:
                    heavy[lo : lo + n] = np.diff(np.concatenate([[0], (hit * self.weights[at]).cumsum()])[upto])
                lo, ends = lo + n, ends[n:]
            self.mark[own] = False
        return count, heavy

    @staticmethod
    def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of all stretches, one after another."""
        upto = size.cumsum()
        return np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


Calc = Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], list]]


def _packed(own: list[str], most: int = 5 * BATCH) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i_, j_, columns ``own``) -> (i_, j_, a, pairs_): one row per tile, of up to BATCH of its pairs in the order of a and b, compressed."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("i_", "j_", "a", "b")]).combine_chunks()
        i, j = (x.column(c).to_numpy() for c in ("i_", "j_"))
        begin = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1])
        cuts = [(lo, min(lo + BATCH, hi)) for first, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(i)], strict=True) for lo in range(first, hi, BATCH)]
        found = []
        for lo, hi in cuts:
            plain = x.select(own).slice(lo, hi - lo).combine_chunks().to_batches()[0].serialize()
            found.append(len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True))
        at = pa.array([lo for lo, _ in cuts])
        return pa.RecordBatch.from_arrays([*[pa.concat_arrays(x.column(c).chunks).take(at) for c in ("i_", "j_", "a")], pa.array(found, pa.binary())], names=["i_", "j_", "a", "pairs_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


def _split(placed: DataFrame, least: int, tasks: int) -> tuple[DataFrame, int]:
    """``placed`` with its tiles (i_, j_) of more pairs than a fair part for ``tasks`` (of ``least`` at least) cut into such parts, by ``a``, that are tiles of
    their own: j_ has the part above its low 32 bits. Also the number of tiles then."""
    sizes = durable(placed.groupBy("i_", "j_").agg(F.count("*").alias("n")), narrow=True)
    fair = max(least, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // (4 * tasks)))
    cut = sizes.select("i_", "j_", F.ceil(F.col("n") / fair).cast("int").alias("parts_"))
    placed = join_small(placed, cut.where("parts_ > 1"), ["i_", "j_"])
    part = F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts_")), F.lit(0)).cast("long")
    return placed.withColumn("j_", F.shiftleft(part, 32) + F.col("j_")).drop("parts_"), cut.agg(F.sum("parts_")).first()[0] or 0


def met(
    pairs: DataFrame, side: DataFrame | Callable[[DataFrame], DataFrame], calc: Calc, columns: str, carry: tuple[str, ...] = (), same: tuple[str, bool] | None = None, split: int | None = None
) -> DataFrame:
    """``pairs`` (a, b, block_a, block_b and further columns) with ``columns``, which ``calc`` finds for each pair in its tile, and for each column c of
    ``carry`` c_a and c_b, the values of its two documents. Pairs travel packed, some bytes each.

    ``side``: one row per document: doc_id and what ``calc`` and ``carry`` need; or a function that makes it from the documents that have a pair (doc_id, tiles_) and
    hands tiles_ on, so that costly values are made for these only, and written nowhere. ``calc`` gets the table of a tile's documents and returns a function
    from the places of both documents of a batch of pairs to the columns' values. With ``same`` (column, wanted) only pairs whose values are equal
    (wanted) or different stay. A pair one of whose documents is not in ``side`` falls out. Where pairs are costly, ``split`` says from how many on
    a tile may be cut into parts that any task may take. ``pairs`` is then read more than once, and should be written.
    """
    own = [c for c in pairs.columns if c not in ("block_a", "block_b")]
    placed = pairs.withColumn("i_", F.least("block_a", "block_b")).withColumn("j_", F.greatest("block_a", "block_b").cast("long")).withColumns({c: F.col(c).cast("long") for c in "ab"})
    # a number of its own: the work goes by pairs, so partitions are not put together by their bytes
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if split:
        placed, tiles = _split(placed, split, tasks)
        tasks = max(tasks, min(tiles, 4 * tasks))
    need = durable(placed.select(F.explode(F.array("a", "b")).alias("doc_id"), "i_", "j_").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("i_", "j_")).alias("tiles_")))
    side = side(need) if callable(side) else side.join(need, "doc_id")
    payload = [c for c in side.columns if c not in ("doc_id", "tiles_")]
    none = lambda c: F.lit(None).cast(side.schema[c].dataType).alias(f"p_{c}")
    docs = side.withColumn("at_", F.explode("tiles_")).select("at_.i_", "at_.j_", F.lit(0).alias("kind_"), F.col("doc_id").cast("long").alias("a"), F.lit(None).cast("binary").alias("pairs_"), *[F.col(c).alias(f"p_{c}") for c in payload])
    held_as = placed.select(own).limit(0).toArrow().schema
    rest = placed.select("i_", "j_", *own).mapInArrow(_packed(own), "i_ int, j_ long, a long, pairs_ binary").select("i_", "j_", F.lit(1).alias("kind_"), "a", "pairs_", *map(none, payload))
    rows = docs.unionByName(rest).repartition(tasks, "i_", "j_").sortWithinPartitions("i_", "j_", "kind_", "a")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = [c.strip().split(" ", 1)[0] for c in columns.split(",")] if columns else []
    schema = ", ".join([*[f"{c} {kind(placed, c)}" for c in own], *([columns] if columns else []), *[f"{c}_{s} {kind(side, c)}" for c in carry for s in "ab"]])
    names = [*own, *found, *[f"{c}_{s}" for c in carry for s in "ab"]]

    class Tile:
        """The documents of a tile, ready to meet."""

        def __init__(self, held: list[pa.RecordBatch]) -> None:
            docs = pa.Table.from_batches(held).combine_chunks()
            self.ids = docs.column("a").to_numpy()
            self.docs = docs.select([f"p_{c}" for c in payload]).rename_columns(payload)
            self.meet = calc(self.docs)
            self.equal = pa.concat_arrays(self.docs.column(same[0]).chunks).dictionary_encode().indices.to_numpy(zero_copy_only=False) if same else None

        def rows(self, part: pa.Table) -> pa.RecordBatch | None:
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            ia, ib = np.minimum(np.searchsorted(self.ids, a), len(self.ids) - 1), np.minimum(np.searchsorted(self.ids, b), len(self.ids) - 1)
            good = (self.ids[ia] == a) & (self.ids[ib] == b)
            if same:  # a null equals nothing and differs from nothing
                x, y = self.equal[ia], self.equal[ib]
                good &= ((x == y) if same[1] else (x != y)) & ~np.isnan(x.astype(float)) & ~np.isnan(y.astype(float))
            if not good.any():
                return None
            keep = np.flatnonzero(good)
            ia, ib, part = ia[keep], ib[keep], part.take(pa.array(keep))
            new = [v if isinstance(v, pa.Array) else pa.array(v) for v in self.meet(ia, ib)]
            sides = [pa.concat_arrays(self.docs.column(c).chunks).take(pa.array(at)) for c in carry for at in (ia, ib)]
            return pa.RecordBatch.from_arrays([*[pa.concat_arrays(part.column(c).chunks) for c in own], *new, *sides], names=names)

    def unpacked(pack: bytes) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.decompress(pack[8:], int.from_bytes(pack[:8], "little"), "zstd"), held_as)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tile, wait, n = None, [], None, [], 0

        def meet() -> Iterator[pa.RecordBatch]:
            out = tile.rows(pa.Table.from_batches(wait).sort_by("a")) if n else None
            if out is not None:
                yield out

        for own_key, part in runs(batches, 3):
            if own_key[:2] != key:
                yield from meet()
                key, held, tile, wait, n = own_key[:2], [], None, [], 0
            if own_key[2] == 0:
                held.append(part)
                continue
            if not held and tile is None:  # pairs without any document
                continue
            if tile is None:
                tile, held = Tile(held), []
            for pack in part.column(part.schema.get_field_index("pairs_")):
                wait.append(unpacked(pack.as_py()))
                n += wait[-1].num_rows
                if n >= BATCH:
                    yield from meet()
                    wait, n = [], 0
        yield from meet()

    return rows.mapInArrow(run, schema)
