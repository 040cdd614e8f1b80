"""Best-fit packing by a grouping genetic algorithm on islands (operator 4).

Documents become ids (with an end id) and are cut only where they exceed a sequence. Whole pieces fill
sequences of their own; the rest is dealt at random into blocks of bounded size. On each block several
islands evolve groupings: individuals start from best-fit decreasing (sorted, then perturbed); crossover
injects the best-filled bins of one parent into the other, removes the bins that hold duplicates and
best-fits what was displaced; mutation empties the worst bins. Between epochs an island's elite migrates
to the next island of its block. An island stops early once its block reaches the bound
ceil(tokens / capacity), which no packing can beat. Badly filled bins of all blocks are then opened and
packed together, level by level, until one block is left or a level gains nothing worth its pass
(``LEAST_GAIN``); of the last two packings of the open pieces the one with fewer bins is then kept whole.

Defined cases: null or empty texts are packed as the end id alone; a text of any length is cut into full
sequences and a rest; repeated rows are packed as often as they occur; null ids are packed like others;
an empty table gives an empty result; extra columns do not take part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe_ids import WordBpe, vocabulary
from gridloom.llm.textops import byte_texts, slices_by_bytes
from gridloom.shared import materialize

BLOCK = 4096  # pieces that an island packs
ISLANDS, EPOCHS, POPULATION = 2, 3, 6
#: Generations of an epoch at most, and without a better grouping until it ends.
GENERATIONS, STALE = 40, 12
#: Bins filled less than this are opened again on the next level.
WELL_FILLED = 0.985
#: Levels go on while one needs at least this share fewer bins for the opened pieces, or leaves this share fewer open.
LEAST_GAIN = 0.01


def best_fit(lengths: list[int], order, capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put the items of ``order`` one by one into the fullest bin that takes them."""
    bins = bins if bins is not None else []
    room: dict[int, list[int]] = {}
    levels: list[int] = []
    for b, items in enumerate(bins):
        left = capacity - sum(lengths[i] for i in items)
        if left not in room:
            room[left] = []
            insort(levels, left)
        room[left].append(b)
    for i in order:
        n = lengths[i]
        at = bisect_left(levels, n)
        if at < len(levels):
            left = levels[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], levels[at]
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= n
        if left in room:
            room[left].append(b)
        else:
            room[left] = [b]
            insort(levels, left)
    return bins


class Island:
    """A population of groupings of one block."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, np.random.default_rng(seed)
        self.sizes = np.array(lengths, np.int64)
        self.bound = -(-int(self.sizes.sum()) // capacity)
        self.population: list[list[list[int]]] = []

    def cost(self, bins: list[list[int]]) -> tuple[int, float]:
        """Bins, then the mean squared fill: fewer first, and uneven fills before even ones."""
        fills = np.array([sum(self.lengths[i] for i in b) for b in bins], float) / self.capacity
        return len(bins), -float((fills**2).mean()) if len(bins) else 0.0

    @property
    def best(self) -> list[list[int]]:
        return min(self.population, key=self.cost)

    def settled(self) -> bool:
        return bool(self.population) and len(self.best) <= self.bound

    def start(self, shaken_only: bool = False) -> None:
        order = np.argsort(-self.sizes, kind="stable")
        if not shaken_only:
            self.population.append(best_fit(self.lengths, order.tolist(), self.capacity))
        while len(self.population) < POPULATION and not self.settled():
            noisy = np.argsort(-(self.sizes * self.random.uniform(0.85, 1.0, len(self.sizes))), kind="stable")
            self.population.append(best_fit(self.lengths, noisy.tolist(), self.capacity))

    def cross(self, giver: list[list[int]], taker: list[list[int]]) -> list[list[int]]:
        # the better filled a bin, the likelier it is handed on
        fills = np.array([sum(self.lengths[i] for i in b) for b in giver], float) / self.capacity
        drawn = self.random.random(len(giver)) < fills ** self.random.uniform(8, 60) * self.random.uniform(0.4, 1.0)
        chosen = [b for b, d in zip(giver, drawn) if d]
        inside = np.zeros(len(self.lengths), bool)
        for b in chosen:
            inside[b] = True
        kept, displaced = [list(b) for b in chosen], []
        for b in taker:
            if inside[b].any():
                displaced += [i for i in b if not inside[i]]
            else:
                kept.append(list(b))
        return self.mutate(kept, displaced)

    def mutate(self, bins: list[list[int]], displaced: list[int]) -> list[list[int]]:
        fills = np.array([sum(self.lengths[i] for i in b) for b in bins])
        worst = set(np.argsort(fills)[: max(1, len(bins) // 20)].tolist()) if len(bins) > 1 else set()
        for k in worst:
            displaced += bins[k]
        bins = [b for k, b in enumerate(bins) if k not in worst]
        displaced = self.exchange(bins, displaced)
        displaced.sort(key=lambda i: -self.lengths[i])
        return best_fit(self.lengths, displaced, self.capacity, bins)

    def exchange(self, bins: list[list[int]], displaced: list[int]) -> list[int]:
        """Where a displaced item fills a bin better than one or two of its items do, it takes their place; what
        is displaced then is smaller and easier to place."""
        left = sorted((self.lengths[i], i) for i in displaced)
        for bin_ in bins:
            room = self.capacity - sum(self.lengths[i] for i in bin_)
            if not room or not left:
                continue
            groups = [(i,) for i in bin_] + [(i, j) for k, i in enumerate(bin_[:12]) for j in bin_[:k]]
            best = (0, None, None)
            for group in groups:
                held = sum(self.lengths[i] for i in group)
                at = bisect_left(left, (held + room + 1,)) - 1  # the longest that fits in their place
                if at >= 0 and left[at][0] - held > best[0]:
                    best = (left[at][0] - held, group, at)
            if best[1]:
                _, item = left.pop(best[2])
                for i in best[1]:
                    bin_.remove(i)
                    insort(left, (self.lengths[i], i))
                bin_.append(item)
        return [i for _, i in left]

    def evolve(self, generations: int = GENERATIONS) -> None:
        best, stale = None, 0
        for _ in range(generations):
            if self.settled() or len(self.population) < 2 or stale >= STALE:
                return
            a, b = self.random.choice(len(self.population), 2, replace=False)
            child = self.cross(self.population[a], self.population[b])
            worst = max(range(len(self.population)), key=lambda k: self.cost(self.population[k]))
            if self.cost(child) <= self.cost(self.population[worst]):
                self.population[worst] = child
            now = min(self.cost(p) for p in self.population)
            best, stale = (now, 0) if best is None or now < best else (best, stale + 1)


_ELITE = "block long, island int, bins long, settled boolean, uids binary, at binary"


def _elite(block: int, island: int, uids: np.ndarray, it: Island) -> pa.Table:
    at = np.zeros(len(uids), np.int32)
    for b, items in enumerate(it.best):
        at[items] = b
    row = {"block": [block], "island": [island], "bins": [len(it.best)], "settled": [it.settled()], "uids": [uids.tobytes()], "at": [at.tobytes()]}
    return pa.table(row, schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int64()), ("settled", pa.bool_()), ("uids", pa.binary()), ("at", pa.binary())]))


def _arrays(table: pa.Table) -> tuple[int, int, np.ndarray, list[int]]:
    uids, lengths = table.column("uid").to_numpy(), table.column("length").to_numpy()
    order = np.argsort(uids, kind="stable")
    return table.column("block")[0].as_py(), table.column("island")[0].as_py(), uids[order], lengths[order].tolist()


def _first_epoch(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        block, island, uids, lengths = _arrays(table)
        it = Island(lengths, capacity, 1000 * block + island)
        it.start()
        it.evolve()
        return _elite(block, island, uids, it)

    return run


def _next_epoch(capacity: int, epoch: int):
    """The island goes on with its own elite and its neighbours', which arrive as immigrants."""

    def run(items: pa.Table, elites: pa.Table) -> pa.Table:
        block, island, uids, lengths = _arrays(items)
        it = Island(lengths, capacity, 1000 * block + island + 7919 * epoch)
        for at in elites.column("at").to_pylist():
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(np.frombuffer(at, np.int32).tolist()):
                bins.setdefault(b, []).append(i)
            it.population.append(list(bins.values()))
        it.start(shaken_only=True)
        it.evolve()
        return _elite(block, island, uids, it)

    return run


def pack_items(items: DataFrame, capacity: int, block_size: int = BLOCK) -> DataFrame:
    """(uid, sequence_id, offset) of items (uid long, length long) that are shorter than a sequence."""
    open_items, level, parts, last = items.select("uid", "length"), 0, [], None
    enough = F.lit(int(WELL_FILLED * capacity))
    while True:
        n = open_items.count()
        if not n:
            break
        blocks = -(-n // block_size)
        dealt = materialize(open_items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks))), "pack-items")
        on_islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
        elites = materialize(on_islands.groupBy("block", "island").applyInArrow(_first_epoch(capacity), _ELITE), "pack-elites")
        for epoch in range(1, EPOCHS):
            unsettled = elites.groupBy("block").agg(F.max("settled").alias("s")).where("not s").select("block")
            if unsettled.isEmpty():
                break
            arriving = elites.join(unsettled, "block", "left_semi")
            ring = arriving.unionByName(arriving.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")))
            grown = on_islands.join(unsettled, "block", "left_semi").groupBy("block", "island").cogroup(ring.groupBy("block", "island")).applyInArrow(_next_epoch(capacity, epoch), _ELITE)
            elites = materialize(elites.join(unsettled, "block", "left_anti").unionByName(grown), "pack-elites")
        best = elites.groupBy("block").agg(F.min_by(F.struct("uids", "at"), F.struct("bins", "island")).alias("b")).select("block", "b.*")
        placed = materialize(best.mapInArrow(_unpacked(level), "uid long, sequence_id long"), "pack-placed").join(dealt.select("uid", "length"), "uid")
        inside = Window.partitionBy("sequence_id")
        placed = materialize(placed.withColumn("fill", F.sum("length").over(inside)).withColumn("offset", F.sum("length").over(inside.orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")), "pack-filled")
        if blocks == 1:
            parts.append(placed)
            break
        sizes = placed.groupBy("sequence_id").agg(F.max("fill").alias("fill"), F.count("*").alias("k"))
        row = sizes.agg(F.count("*").alias("bins"), F.count(F.when(F.col("fill") < enough, 1)).alias("open"), F.sum(F.when(F.col("fill") < enough, F.col("k"))).alias("items")).first()
        if last and row["bins"] > last[1] * (1 - LEAST_GAIN) and (row["items"] or 0) > n * (1 - LEAST_GAIN):
            parts.append(placed if row["bins"] <= last[1] else last[0])
            break
        parts.append(placed.where(F.col("fill") >= enough))
        last = placed.where(F.col("fill") < enough), row["open"]
        open_items, level = last[0].select("uid", "length"), level + 1
    if not parts:
        return items.select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("uid", "sequence_id", "offset")


def _unpacked(level: int):
    def run(batches):
        for batch in batches:
            for block, uids, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                uids, at = np.frombuffer(uids, np.int64), np.frombuffer(at, np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array((level << 48) + (block << 16) + at)], names=["uid", "sequence_id"])

    return run


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int | None, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids on request) of every piece of every document."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe = WordBpe.load(path)
        for batch in slices_by_bytes(batches, "text", 2 << 20, vocabulary=True):
            ids = bpe.encode_many([t.decode("utf-8", "replace") for t in byte_texts(batch, "text")])
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, raw in zip(batch.column(0).to_pylist(), ids):
                raw += end
                for piece, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    values = (doc, piece, s // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, np.int32) if with_ids else None)
                    for k, v in zip(rows, values):
                        rows[k].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(v, t) for v, t in zip(rows.values(), kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if with_ids else 5], names=list(rows)[: 6 if with_ids else 5])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int | None = 1, id_col="doc_id", text_col="text", with_ids=False, block_size: int = BLOCK) -> DataFrame:
    """The pieces of all documents with their place: sequence_id and offset."""
    pieces = pieces_of(docs, path, capacity, end_id, id_col, text_col, with_ids).withColumn("uid", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pack-pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 60) + F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    placed = pack_items(rest, capacity, block_size)
    return full.unionByName(rest.join(placed, "uid")).drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (at most a sequence's capacity) from ``pack_documents(..., with_ids=True)``."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
