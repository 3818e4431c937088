"""Near-duplicate classes by a signature-coordinate inverted join.

1. Every document is sketched once: distinct word shingles, a 128-bit digest of the set, and a MinHash
   signature of COORDINATES values. Documents with equal sets are one class, led by its smallest id.
2. Class leaders are posted under their (coordinate, value) pairs. Two sets of similarity 0.8 agree in about
   0.8 of all coordinates; pairs that agree in at least MATCHES of them are candidates. Such a pair must
   share a posting among the COORDINATES - MATCHES + 1 rarest of either document (prefix filter over one
   global order by posting length), so longer postings are never merged.
3. Within a posting agreements are counted leader by leader; documents already reached from a leader are
   skipped, so a posting of g documents yields at most g - 1 links, never its pairs. Long postings are cut
   into tiles, and each pair of tiles is compared in a task of its own.
4. Connected candidates form clusters; their members' full sets meet in tiles of bounded summed size, where exact
   intersections confirm the links, again as spanning links only. Components of confirmed links give the ids.

All true links lie within a cluster unless a pair agrees in fewer than MATCHES coordinates: at similarity
0.8 that has probability 4e-7 with 64 and 35, and less above.

Defined results: a null or wordless text has an empty set and links with nothing; a text with fewer words
than a shingle is one shingle; rows that share a doc_id count as one document; rows with a null doc_id are
not linked (component null, kept); an empty table gives an empty table; ties do not matter as ids are minima;
extra columns, whatever their names, are ignored, or kept by ``keep_one``. Of rows that share doc_id and text, ``keep_one`` keeps one (the
least by a hash of all its columns); rows of one doc_id with other texts stay or go together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shingles import mix, shingle_sets
from quernstone.llm.text import fresh
from quernstone.operators.components import connected_components
from quernstone.plans.durable import durable, likely

COORDINATES = 64
MATCHES = 35
WORDS = 5
PERCENT = 80
TILE = 2000
TILE_HASHES = 4_000_000

_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest mixed hash of the set under each coordinate, cut to 32 bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            np.minimum(low, (shingles[at : at + 4096, None] * _MUL + _ADD).min(axis=0), out=low)
    return (mix(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, signs = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                size.append(len(s))
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                one.append(digest[0])
                two.append(digest[1])
                signs.append(signature(s) if len(s) else np.zeros(COORDINATES, dtype=np.int32))
            flat = pa.array(np.concatenate(signs) if signs else np.zeros(0, dtype=np.int32), pa.int32())
            cuts = pa.array(np.arange(len(signs) + 1, dtype=np.int32) * COORDINATES, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(cuts, flat)],
                ["doc_id", "n_shingles", "f1", "f2", "sign"],
            )

    return run


def sketches(docs: DataFrame, words: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_sketch(words), "doc_id long, n_shingles long, f1 long, f2 long, sign array<int>")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Tables of whole key runs from a stream sorted by its first ``keys`` columns, with each run's start."""
    held: list[pa.RecordBatch] = []

    def change(t: pa.Table) -> np.ndarray:
        moved = np.zeros(len(t), dtype=bool)
        for k in range(keys):
            v = t.column(k).to_numpy()
            moved[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(moved)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(batch.column(k)[batch.num_rows - 1].equals(held[0].column(k)[0]) for k in range(keys)):
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = change(t)
        yield np.concatenate([[0], at]), t.slice(0, at[-1])
        held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield np.concatenate([[0], change(t), [len(t)]]).astype(np.int64), t


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(-1, width)


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, i, j, doc, sign) sorted by token and tile -> spanning candidate links (a, b)."""
    for starts, t in _runs(batches, 3):
        docs, signs = t.column("doc").to_numpy(), _matrix(t.column("sign"), COORDINATES)
        cuts = starts if starts[-1] == len(docs) else np.append(starts, len(docs))
        length = np.diff(cuts)
        two = cuts[:-1][length == 2]
        hit = two[(signs[two] == signs[two + 1]).sum(axis=1) >= MATCHES] if len(two) else two
        a, b = [docs[hit]], [docs[hit + 1]]
        for lo, n in zip(cuts[:-1][length > 2].tolist(), length[length > 2].tolist(), strict=True):
            left, edge = np.arange(lo + 1, lo + n), [lo]
            while len(left):
                at = edge.pop() if edge else int(left[0])
                left = left[left != at]
                near = (signs[left] == signs[at]).sum(axis=1) >= MATCHES
                if near.any():
                    reached = left[near]
                    a.append(np.full(len(reached), docs[at]))
                    b.append(docs[reached])
                    edge += reached.tolist()
                    left = left[~near]
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _confirm(percent: int):
    def linked(sets: list[np.ndarray], ids: np.ndarray) -> tuple[list[int], list[int]]:
        size = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        names = np.unique(flat, return_inverse=True)[1]
        order = np.argsort(names, kind="stable")
        posted, first = owner[order], np.concatenate([[0], np.bincount(names).cumsum()])
        begin = np.concatenate([[0], size.cumsum()])
        left, edge, a, b = np.ones(len(sets), dtype=bool), [], [], []
        while left.any():
            at = edge.pop() if edge else int(np.argmax(left))
            left[at] = False
            mine = names[begin[at] : begin[at + 1]]
            lo, n = first[mine], first[mine + 1] - first[mine]
            spread = np.repeat(lo - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(posted[spread], minlength=len(sets))
            near = np.flatnonzero(left & (100 * shared >= percent * (size[at] + size - shared)))
            left[near] = False
            edge += near.tolist()
            a += [int(ids[at])] * len(near)
            b += ids[near].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, t in _runs(batches, 3):
            cuts = starts if starts[-1] == len(t) else np.append(starts, len(t))
            ids, sets = t.column("doc").to_numpy(), t.column("set").combine_chunks()
            sets = sets if isinstance(sets, pa.Array) else sets.chunk(0)
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x, y = linked([sets[i].values.to_numpy() for i in range(lo, hi)], ids[lo:hi])
                a, b = a + x, b + y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _tiles(rows: DataFrame, count: str, doc: str, hashes: str | None = None) -> DataFrame:
    """One row per pair of tiles (i <= j) that the document's tile takes part in; one tile up to TILE members, and up to
    TILE_HASHES in all their sets together where ``hashes`` counts these."""
    n = F.ceil(F.col(count) / TILE).cast("int")
    if hashes:
        n = F.greatest(n, F.ceil(F.col(hashes) / TILE_HASHES).cast("int"))
    own = F.pmod(F.xxhash64(doc), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    tiled = rows.withColumn("__own", own).withColumn("__other", other)
    return tiled.withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other")).drop("__own", "__other")


def candidates(leaders: DataFrame) -> DataFrame:
    """Spanning links (a, b) between leaders (doc, sign) that agree in MATCHES coordinates."""
    posted = leaders.select("doc", F.posexplode("sign").alias("c", "v"))
    posted = posted.select("doc", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")).alias("token"))
    common = posted.groupBy("token").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    mine = posted.join(common, "token").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("found"))
    room = F.lit(COORDINATES - MATCHES + 1 - COORDINATES) + F.size("found")  # postings of one document come first
    prefix = mine.select("doc", F.slice("found", 1, F.greatest(room, F.lit(0))).alias("found")).where(F.size("found") > 0)
    rows = prefix.join(leaders, "doc").select(F.explode("found").alias("p"), "doc", "sign").select("p.token", "p.n", "doc", "sign")
    tiled = _tiles(rows, "n", "doc").select("token", "i", "j", "doc", "sign")
    dealt = tiled.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "doc")
    return dealt.mapInArrow(_collide, "a long, b long").distinct()


def confirmed(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning links (a, b) of documents of one cluster (node, component, n_shingles) whose sets are similar enough."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes"))
    members = durable(clusters.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "n", "hashes"), narrow=True)
    # few documents have a partner: the other texts stay where they are
    rows = likely(docs.select(F.col("doc_id").cast("long"), "text"), members, "doc_id").join(members.hint("merge"), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(4), words))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32) if found else np.zeros(1, dtype=np.int32))
            flat = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.ListArray.from_arrays(cuts, flat)], ["component", "n", "hashes", "doc", "set"])

    full = rows.select("component", "n", "hashes", F.col("doc_id").alias("doc"), "text").mapInArrow(sets, "component long, n long, hashes long, doc long, set array<long>")
    tiled = _tiles(full, "n", "doc", "hashes").select("component", "i", "j", "doc", "set")
    dealt = tiled.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc")
    return dealt.mapInArrow(_confirm(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    sketched = durable(sketches(docs, words))
    named = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    leaders = durable(named.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n_shingles")), narrow=True)
    found = connected_components(candidates(leaders.select("doc", "sign")).where("a <> b"))
    clusters = durable(found.join(leaders.select(F.col("doc").alias("node"), "n_shingles"), "node"), narrow=True)
    links = durable(confirmed(docs, clusters, words, percent).where("a <> b"), narrow=True)
    own = named.select("doc_id", "f1", "f2").join(leaders.select("f1", "f2", "doc"), ["f1", "f2"]).where(F.col("doc") != F.col("doc_id"))
    edges = links.union(own.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")))
    found = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def row_hash(df: DataFrame) -> Column:
    """A hash of the row's whole content; columns that cannot be hashed (maps and variants, also within others) go by their JSON."""
    odd = lambda f: "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if odd(f) else F.col(f"`{f.name}`") for f in df.schema])


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the members of a class other than its smallest doc_id, and without repeats; columns unchanged."""
    gone, own = fresh(docs, "gone_id", "own_id")
    id_ = F.col("doc_id").cast("long")
    out = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(out, id_ == F.col(gone), "left_anti")
    often = durable(docs.where(F.col("doc_id").isNotNull()).groupBy(id_.alias(own)).agg(F.count("*").alias("n")).where("n > 1").select(own), narrow=True)
    if often.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = left.join(often, id_ == F.col(own), "left_semi")
    one = again.groupBy(F.col("doc_id"), F.xxhash64("text"), F.sha2("text", 256)).agg(F.min_by(F.struct(*columns), row_hash(again)).alias(own))
    return left.join(often, id_ == F.col(own), "left_anti").unionByName(one.select(f"{own}.*"))
