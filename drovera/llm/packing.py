"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .store import stage

SIZE = 2048
#: Pieces that one population packs; more pieces make more populations.
SHARD = 4096
ISLANDS = 2
POPULATION = 5
GENERATIONS = 10
EPOCHS = 2
#: Bins with no more room than this are final; what lies in others meets again in the next round.
SLACK = 8


class Bins:
    """A packing of items (places in ``sizes``) that grows by best fit."""

    def __init__(self, sizes: list[int], room: int) -> None:
        self.sizes, self.room = sizes, room
        self.bins: list[list[int]] = []
        self.left: list[int] = []
        self.by_left: dict[int, list[int]] = {}
        self.mask = 0

    def _file(self, b: int) -> None:
        r = self.left[b]
        self.by_left.setdefault(r, []).append(b)
        self.mask |= 1 << r

    def adopt(self, items: list[int]) -> None:
        self.bins.append(list(items))
        self.left.append(self.room - sum(self.sizes[i] for i in items))
        self._file(len(self.bins) - 1)

    def fit(self, items: list[int]) -> None:
        """Each item in turn goes to the open bin with the least room that is enough."""
        for i in items:
            s = self.sizes[i]
            m = self.mask >> s
            if not m:
                self.adopt([i])
                continue
            r = s + (m & -m).bit_length() - 1
            at = self.by_left[r]
            b = at.pop()
            if not at:
                self.mask ^= 1 << r
            self.bins[b].append(i)
            self.left[b] = r - s
            self._file(b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (larger is better)."""
        return -len(self.bins), sum((self.room - r) ** 2 for r in self.left)

    def genome(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def from_genome(genome: np.ndarray, sizes: list[int], room: int) -> Bins:
    out = Bins(sizes, room)
    order = np.argsort(genome, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(genome[order])) + 1):
        out.adopt(items.tolist())
    return out


def cross(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Well-filled bins of ``a`` go whole into ``b``; bins of ``b`` with the same items dissolve, and
    their displaced items are placed anew by best fit, largest first."""
    ranked = sorted(range(len(a.bins)), key=lambda k: a.left[k])
    top = ranked[: max(1, len(ranked) // 2)]
    given = rng.sample(top, max(1, len(top) // 2))
    child = Bins(a.sizes, a.room)
    seen: set[int] = set()
    for k in given:
        child.adopt(a.bins[k])
        seen.update(a.bins[k])
    loose: list[int] = []
    keep = [k for k in range(len(b.bins)) if seen.isdisjoint(b.bins[k])]
    gone = set(range(len(b.bins))) - set(keep)
    for k in gone:
        loose += [i for i in b.bins[k] if i not in seen]
    # Mutation: the emptiest bins dissolve too.
    for k in sorted(keep, key=lambda k: -b.left[k])[: 1 + len(keep) // 50]:
        loose += b.bins[k]
        gone.add(k)
    for k in keep:
        if k not in gone:
            child.adopt(b.bins[k])
    loose.sort(key=lambda i: (-child.sizes[i], i))
    child.fit(loose)
    return child


def evolve(sizes: list[int], genomes: list[np.ndarray], seed: int, room: int = SIZE) -> list[Bins]:
    """A population after ``GENERATIONS``, best first; without genomes it starts from best-fit decreasing."""
    rng = random.Random(seed)
    people = [from_genome(g, sizes, room) for g in genomes]
    while len(people) < POPULATION:
        noise = 0.0 if not people else 0.15
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * (1 + noise * rng.random()), i))
        one = Bins(sizes, room)
        one.fit(order)
        people.append(one)
    people.sort(key=Bins.fitness, reverse=True)
    people = people[:POPULATION]
    for _ in range(GENERATIONS):
        if -people[0].fitness()[0] * room - sum(sizes) < room:
            break  # no packing has fewer bins
        a, b = sorted(rng.sample(range(len(people)), 2))
        child = cross(people[a], people[b], rng)
        if child.fitness() > people[-1].fitness():
            people[-1] = child
            people.sort(key=Bins.fitness, reverse=True)
    return people


_STATE = "shard long, island int, sizes binary, genome binary"


def _epoch(epoch: int, room: int):
    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        sizes = np.frombuffer(rows["sizes"].iloc[0], np.int32)
        genomes = [np.frombuffer(g, np.int32) for g in rows["genome"] if g]
        people = evolve(sizes.tolist(), genomes, hash((shard, island, epoch)), room)
        out = [(shard, island, p.genome().tobytes()) for p in people]
        out.append((shard, (island + 1) % ISLANDS, out[0][2]))  # the elite also lands on the next island
        return pd.DataFrame({
            "shard": [s for s, _, _ in out], "island": [i for _, i, _ in out],
            "sizes": [sizes.tobytes()] * len(out), "genome": [g for _, _, g in out],
        })

    return work


def _best(room: int):
    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rids = np.frombuffer(rows["rids"].iloc[0], np.int64)
        sizes = np.frombuffer(rows["sizes"].iloc[0], np.int32).tolist()
        best = max((from_genome(np.frombuffer(g, np.int32), sizes, room) for g in rows["genome"]), key=Bins.fitness)
        parts = []
        for items, left in zip(best.bins, best.left):
            items = sorted(items)
            size = np.array([sizes[i] for i in items])
            parts.append(pd.DataFrame({
                "rid": rids[items], "length": size, "sequence_id": rids[items].min(),
                "offset": np.cumsum(size) - size, "room": left,
            }))
        return pd.concat(parts)

    return work


def pack_items(items: DataFrame, room: int = SIZE) -> DataFrame:
    """``(rid, length)`` with distinct ids to ``(rid, sequence_id, offset)``; lengths are 1 to ``room``.

    Items are dealt by hash into populations of about ``SHARD``. Each evolves on ``ISLANDS`` islands
    whose elites migrate between epochs. Bins with over ``SLACK`` room are dissolved, and their items
    are dealt and packed again until one population holds them all or no longer halves them.
    """
    placed: DataFrame | None = None
    rest, left, turn = items, items.count(), 0
    while left:
        shards = -(-left // SHARD)

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({
                    "shard": b["shard"],
                    "rids": [np.array([r["rid"] for r in x], np.int64).tobytes() for x in b["x"]],
                    "sizes": [np.array([r["length"] for r in x], np.int32).tobytes() for x in b["x"]],
                })

        dealt = rest.groupBy(F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(shards)).alias("shard")).agg(
            F.array_sort(F.collect_list(F.struct("rid", "length"))).alias("x")
        )
        dealt = stage(dealt.mapInPandas(gather, "shard long, rids binary, sizes binary"), "dealt")
        state = dealt.select(
            "shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "sizes",
            F.lit(None).cast("binary").alias("genome"),
        )
        # Populations are small and their work is not, so adaptive execution must not merge them into few tasks.
        tasks = min(shards * ISLANDS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        for e in range(EPOCHS):
            state = state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(_epoch(1000 * turn + e, room), _STATE)
        chosen = state.select("shard", "genome").join(dealt, "shard").groupBy("shard").applyInPandas(
            _best(room), "rid long, length int, sequence_id long, offset long, room int"
        )
        chosen = stage(chosen, "packed")
        open_bins = chosen.where(F.col("room") > SLACK)
        again = open_bins.count() if shards > 1 else 0
        if again * 2 > left:
            again = 0
        done = (chosen.where(F.col("room") <= SLACK) if again else chosen).select("rid", "sequence_id", "offset")
        placed = done if placed is None else placed.unionAll(done)
        rest, left, turn = open_bins.select("rid", "length"), again, turn + 1
    if placed is None:
        return items.select("rid", F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed


def cut_pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """Pieces ``doc_id piece start length ids_crc32`` of each document's ids, with an id 0 at its end."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary)
        for b in batches:
            out = []
            for doc, ids in zip(b["doc_id"].astype("Int64"), bpe.encode_all(b["text"].tolist())):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    out.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype("Int64")

    return rows.mapInPandas(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE
) -> DataFrame:
    """One row per piece: ``doc_id piece start length ids_crc32 sequence_id offset``.

    A document's ids end with id 0, so null and empty texts are pieces of one token. Documents of
    over ``size`` tokens are cut into whole sequences and a rest; all else stays in one piece.
    Offsets in a sequence are gapless from 0. Repeated rows are packed each; null ids stay null;
    an empty table gives no rows; other columns are not read. Texts are not shuffled.
    """
    pieces = stage(
        cut_pieces(docs, vocabulary, id_col, text_col, size).withColumn("rid", F.monotonically_increasing_id()), "pieces"
    )
    small = pieces.where(F.col("length") < size).select("rid", F.col("length").cast("int").alias("length"))
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": F.col("rid"), "offset": F.lit(0).cast("long")})
    packed = pieces.join(pack_items(small, size), "rid")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.select(*columns).unionAll(full.select(*columns))
