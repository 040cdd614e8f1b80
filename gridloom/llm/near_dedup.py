"""Near-duplicate detection with HyperMinHash (operator 3).

Signature: the hash space is cut into 256 buckets; each bucket keeps its least hash in compressed form,
a leading-zero count and ten mantissa bits; an empty bucket takes over the register of another one, in an
order drawn for it, so that short texts are compared like long ones. Bands of eight registers propose
candidates. A pair's Jaccard similarity is first estimated from equal registers, less the matches expected
by chance of two different minima sharing a register; what stays is verified on the full shingle sets,
exactly.

Plan: (1) one pass over the texts writes signatures, with texts compressed beside them; (2) documents
with equal sets form one class, so copies cost nothing further on; (3) in each band bucket every class
is paired with the bucket's best connected class (a star, not all pairs: of a text and its edited copies
that is the text), the pairs are estimated and verified in rounds, best first, and pairs inside one
component are dropped; (4) a bucket that still spans several components is completed: its members outside
its largest component are compared with all members of other components. That happens inside tasks, on
blocks of at most about ``CELL`` members a side, so no pair becomes a row: first registers are compared,
then the texts of the members that have a partner are sent to their blocks and verified, and links alone
come out. A pair is looked at in its first common band only. So no link between different texts is lost
to the star. Components come from alternating star steps. Nothing about all documents reaches the driver.

The 96 bands are three groupings of the registers, any two of which share one register at most. Of pairs
at similarity 0.8 exactly 9e-6 share no band, at 0.82 9e-7, at 0.85 1e-8 (the number of equal registers is
binomial); texts that share a passage only, at 0.3, meet in 0.6 % of cases. Sets of at most ``TINY``
shingles, which have too few registers of their own, meet by exact keys as well: the set, and the set less
one shingle (of ``TINY``, less two), which is all that a similarity of 0.8 allows at that size. The
estimate's margin is five standard deviations of an estimate from as many registers as the smaller
set fills.

Defined cases: null or blank texts have an empty set and link with nothing (they stay); a text with
fewer words than a shingle has its whole sequence as the one shingle; an id that occurs in several rows
gives a result for each row and counts once as an identifier; null ids never become a component's id
unless the component has no other; an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bloom import bloom_of_digests, digest_keys
from gridloom.llm.components import connected_components
from gridloom.llm.textops import LOWER, byte_texts, mix64, shingle_sets, slices_by_bytes, sorted_common
from gridloom.shared import materialize

REGISTERS, BAND, MANTISSA = 256, 8, 10
#: Members of a bucket that a task compares with as many others at a time.
CELL = 512
#: Sets up to this size also meet by exact keys.
TINY = 10
#: Registers of each band: neighbours, one of every 32nd, and one of each row of 32, five further on each time.
_APART = REGISTERS // BAND
_GROUPS = np.concatenate([
    np.arange(REGISTERS).reshape(-1, BAND),
    np.arange(REGISTERS).reshape(BAND, -1).T,
    np.array([[_APART * q + (g - 5 * q) % _APART for q in range(BAND)] for g in range(_APART)]),
])
#: Bytes of shingle sets that a task keeps of the block it verifies.
KEPT_SETS = 64 << 20
#: Where an empty bucket looks for a register: for each attempt and bucket another bucket, all in the end.
_LENDERS = np.stack([np.random.default_rng(977 + i).permutation(REGISTERS) for i in range(REGISTERS)], axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (sets x 256, 16 bits): leading zeros + 1, then mantissa; all 0 for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    lengths = [len(s) for s in sets]
    if not sum(lengths):
        return out
    values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    shift = 64 - REGISTERS.bit_length() + 1
    slot = rows * REGISTERS + (values >> np.uint64(shift)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))  # sets are sorted
    rest = values[first] & np.uint64((1 << shift) - 1)
    zeros = np.clip(shift - np.frexp(rest.astype(np.float64))[1], 0, shift).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(64 - shift))) << np.uint64(1)
    out.ravel()[slot[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | (tail >> np.uint64(64 - MANTISSA))
    own = out > 0
    lent = out.copy()
    row, col = np.nonzero(~own & own.any(axis=1, keepdims=True))
    for lenders in _LENDERS:
        if not len(row):
            break
        source = lenders[col]
        found = own[row, source]
        lent[row[found], col[found]] = out[row[found], source[found]]
        row, col = row[~found], col[~found]
    return lent


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers.

    Two different minima fall into one register with a chance of about 2**-mantissa over the few
    likely zero counts; that share of the unequal buckets is taken off."""
    share = ((a == b) & (a > 0)).mean(axis=1)
    zeros = np.abs(np.log2(np.maximum(1, n_a)) - np.log2(np.maximum(1, n_b)))
    chance = 2.0 ** -(MANTISSA + 1) / (1 + zeros)
    return np.maximum(0.0, (share - chance) / (1 - chance))


def margin(n: np.ndarray) -> np.ndarray:
    """How far below the true similarity the estimate may lie: five standard deviations, for smaller sets of n."""
    filled = REGISTERS * -np.expm1(-np.maximum(1, n) / REGISTERS)
    return 5 * np.sqrt(0.16 / filled)


def tiny_keys(s: np.ndarray) -> np.ndarray:
    """Keys by which a set of at most ``TINY`` hashes meets all others of that size, or two more, at 0.8 or more."""
    if not 0 < len(s) <= TINY + 2:
        return np.zeros(0, np.int64)
    each = mix64(s)
    kinds = [(each.sum(dtype=np.uint64)[None], len(s))]
    if len(s) > 1:
        less = kinds[0][0] - each
        kinds.append((less, len(s) - 1))
        if len(s) >= TINY:
            i, j = np.triu_indices(len(s), 1)
            kinds.append((less[i] - each[j], len(s) - 2))
    return np.concatenate([mix64(v + mix64(np.array([n]))) for v, n in kinds]).view(np.int64)


def _signatures(size: int):
    import zstandard

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices_by_bytes(batches, "text", 2 << 20):
            texts = [t.translate(LOWER) for t in byte_texts(batch, "text")]
            sets = shingle_sets(texts, size)
            regs = registers(sets)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "mark": batch.column(2),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "regs": pa.array([r.tobytes() for r in regs], pa.binary()),
                    "tiny": pa.array([tiny_keys(s) for s in sets], pa.list_(pa.int64())),
                    "packed": pa.array([pack(t) for t in texts], pa.binary()),
                }
            )

    return run


def _estimated(threshold: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(b"".join(col[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            n_a, n_b = (col[c].to_numpy() for c in ("n_a", "n_b"))
            j = estimate(a, b, n_a, n_b)
            keep = pa.array(j >= threshold - margin(np.minimum(n_a, n_b)))
            yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(j)], names=["a", "b", "est"]).filter(keep)

    return run


def _verified(size: int, num: int, den: int):
    """Exact test of pairs: den * intersection >= num * union, on whole sets."""
    import zstandard

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        last, last_set = None, None
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                packed_a, packed_b = part.column(2).to_pylist(), part.column(3).to_pylist()
                sets = shingle_sets([unpack(x) for x in packed_b], size)
                links, common = [], []
                for i, x in enumerate(packed_a):
                    if x != last:
                        last, last_set = x, shingle_sets([unpack(x)], size)[0]
                    inter = sorted_common(last_set, sets[i])
                    union = len(last_set) + len(sets[i]) - inter
                    links.append(union > 0 and den * inter >= num * union)
                    common.append(inter)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(links, pa.bool_()), pa.array(common, pa.int64())], names=["a", "b", "link", "common"])

    return run


def _passing(bloom):
    """Packed texts of the wanted classes, each class once a batch."""

    def run(batches):
        for batch in batches:
            digests = batch.column(0).to_pylist()
            if digests:
                chosen = list({digests[i]: i for i in np.flatnonzero(bloom.value.has(digest_keys(digests))).tolist()}.values())
                yield batch.take(pa.array(chosen, pa.int64()))

    return run


class _Cell:
    """Members of one bucket, of one block or of two, that one task compares."""

    def __init__(self, rows: pa.Table, num: int, den: int):
        self.rows, self.num, self.den = rows, num, den
        self.label, self.n, self.left = (rows.column(c).to_numpy() for c in ("label", "n", "left"))
        self.regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.at, self.one_block = rows.column("at")[0].as_py(), rows.column("one_block")[0].as_py()
        self.keys = band_keys(self.regs)

    def pairs(self):
        """(x, partners): rows whose registers allow a link and whose first common band is this one."""
        a = np.arange(len(self.n)) if self.one_block else np.flatnonzero(self.left)
        b = a if self.one_block else np.flatnonzero(~self.left)
        if not len(a) or not len(b):
            return
        step, columns = max(1, (1 << 17) // len(b)), np.ascontiguousarray(self.regs.T)
        for s in range(0, len(a), step):
            x = a[s : s + step]
            may = self.label[x][:, None] != self.label[b][None]
            may &= np.minimum(self.n[x][:, None], self.n[b][None]) * self.den >= np.maximum(self.n[x][:, None], self.n[b][None]) * self.num
            if self.one_block:
                may &= x[:, None] < b[None]
            if not may.any():
                continue
            equal = np.zeros(may.shape, np.uint16)
            for register in columns:
                equal += register[x][:, None] == register[b][None]
            least = self.num / self.den - margin(np.minimum(self.n[x][:, None], self.n[b][None]))
            i, j = np.nonzero(may & (equal >= REGISTERS * least))
            u, v = x[i], b[j]
            for t in range(0, len(u), 4096):
                p, q = u[t : t + 4096], v[t : t + 4096]
                earlier = (self.keys[p, : self.at] == self.keys[q, : self.at]).any(axis=1)
                p, q = p[~earlier], q[~earlier]
                cuts = np.flatnonzero(np.diff(p)) + 1
                yield from ((int(r[0]), k) for r, k in zip(np.split(p, cuts), np.split(q, cuts)) if len(k))


def _grouped(batches):
    """Tables of the consecutive rows that share their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for s, e in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(s, e - s)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def _with_partner(num: int, den: int):
    """Of each cell the rows that have a partner by their registers."""

    def run(batches):
        for rows in _grouped(batches):
            used: set[int] = set()
            for x, partners in _Cell(rows, num, den).pairs():
                used.add(x)
                used.update(partners.tolist())
            if used:
                yield from rows.take(pa.array(sorted(used), pa.int64())).combine_chunks().to_batches()

    return run


def _links_of_cells(size: int, num: int, den: int):
    """Exact test of the pairs of each cell, on whole sets; a link joins its ends' components, whose further pairs are spared."""
    import zstandard

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for rows in _grouped(batches):
            cell, packed, node = _Cell(rows, num, den), rows.column("packed"), rows.column("node").to_numpy()
            sets: dict[int, np.ndarray] = {}
            held = 0
            merged: dict[int, int] = {}

            def set_of(i):
                nonlocal held
                if i not in sets:
                    if held > KEPT_SETS:
                        sets.clear()
                        held = 0
                    upto, size_of = i, 0  # its neighbours with it, up to a megabyte packed
                    texts = []
                    while upto < len(node) and upto not in sets and (upto == i or size_of < 1 << 20):
                        texts.append(unpack(packed[upto].as_py()))
                        size_of += len(packed[upto].as_py())
                        upto += 1
                    for k, made in zip(range(i, upto), shingle_sets(texts, size)):
                        sets[k] = made
                        held += made.nbytes
                return sets[i]

            def root(label):
                while (up := merged.get(label, label)) != label:
                    label = up
                return label

            u, v = [], []
            for x, partners in cell.pairs():
                own = root(int(cell.label[x]))
                for t in range(0, len(partners), 128):
                    y = [k for k in partners[t : t + 128].tolist() if root(int(cell.label[k])) != own]
                    if not y:
                        continue
                    first, others = set_of(x), [set_of(k) for k in y]
                    n = np.array([len(o) for o in others])
                    every = np.concatenate(others)
                    at = np.minimum(np.searchsorted(first, every), len(first) - 1)
                    inter = np.add.reduceat((first[at] == every).astype(np.int64), np.cumsum(n) - n)
                    for k in np.flatnonzero(den * inter >= num * (len(first) + n - inter)).tolist():
                        a, b = root(own), root(int(cell.label[y[k]]))
                        if a != b:
                            merged[max(a, b)] = min(a, b)
                            u.append(node[x])
                            v.append(node[y[k]])
                    own = root(own)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, mark (of its text), n, digest (of its set), label and component_id (null for an empty set)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    source = source.withColumn("mark", F.md5("text"))
    signed = materialize(source.mapInArrow(_signatures(size), "doc_id long, mark string, n long, digest binary, regs binary, tiny array<long>, packed binary"), "near-signed")

    classes = signed.where("n > 0").groupBy("digest").agg(F.first("regs").alias("regs"), F.first("tiny").alias("tiny"), F.first("n").alias("n"), F.min("doc_id").alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    labels = _link(spark, signed, classes, size, num, den)

    named = classes.select("digest", "node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(ids, "label").select("digest", "label", "component_id"), "near-named")
    # every task has a row of a class once or more: the join is on digests, and a hot class can be split
    return signed.select("doc_id", "mark", "n", "digest").join(named, "digest", "left")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, digest (of its shingle set).

    Two documents link when den * |intersection| >= num * |union| of their sets of ``size``-word
    shingles."""
    out = _groups(docs, id_col, text_col, size, num, den)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band (rows x bands)."""
    words = np.ascontiguousarray(regs[:, _GROUPS]).view(np.uint64)  # rows x bands x 2
    return mix64(mix64(words[:, :, 0] + np.arange(1, len(_GROUPS) + 1, dtype=np.uint64)) ^ words[:, :, 1]).view(np.int64)


def _with_keys(batches):
    """node, and its keys: one for each band, and the exact keys of a tiny set."""
    for batch in batches:
        for s in range(0, batch.num_rows, 2048):
            part = batch.slice(s, 2048)
            keys = band_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))
            lists = [k if not t else np.concatenate([k, np.array(t, np.int64)]) for k, t in zip(keys, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["node", "keys"])


def _bands(classes: DataFrame) -> DataFrame:
    """(band, at, node): a row for each key of a class."""
    keys = classes.select("node", "regs", "tiny").mapInArrow(_with_keys, "node long, keys array<long>")
    return keys.select("node", F.posexplode("keys").alias("at", "band"))


def _link(spark, signed: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, label) of the classes that have a link."""
    bands = _bands(classes)
    several = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(bands.join(several, "band"), "near-shared")  # only buckets with several classes
    degree = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    pivots = shared.join(degree, "node").groupBy("band").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot"))
    shared = materialize(shared.join(pivots, "band"), "near-buckets")

    sides = [classes.select(F.col("node").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab"]
    star = shared.where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    fits = star.join(sides[1], "b").join(sides[0], "a").where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
    pairs = materialize(fits.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(_estimated(num / den), "a long, b long, est double"), "near-star")
    texts = _texts(spark, signed, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def verified(batch: DataFrame) -> DataFrame:
        sent = batch.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
        sent = sent.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")
        return materialize(sent.select("a", "b", "packed_a", "packed_b").mapInArrow(_verified(size, num, den), "a long, b long, link boolean, common long"), "near-verified")

    # first the best partner of each; most other pairs then lie inside a component
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "est"))
    best = ends.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = None
    for rest in (False, True):
        done = verified(materialize(_between(pairs, labels, tested), "near-open") if rest else best)
        tested = done.select("a", "b")
        found = done.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = links.unionByName(found) if rest else found
        labels = materialize(connected_components(links), "near-labels")

    cells = _cells(shared, labels).join(classes.select("node", "n", "regs"), "node")
    columns = "cell long, at int, one_block boolean, left boolean, node long, label long, n long, regs binary"
    names = [c.split()[0] for c in columns.split(", ")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: little data, but much to compute
    dealt = cells.select(*names).repartition(tasks, "cell").sortWithinPartitions("cell")
    partnered = materialize(dealt.mapInArrow(_with_partner(num, den), columns), "near-cells")
    texts = _texts(spark, signed, classes, partnered.select("node"))
    dealt = partnered.join(texts, "node").select(*names, "packed").repartition(tasks, "cell").sortWithinPartitions("cell")
    found = materialize(dealt.mapInArrow(_links_of_cells(size, num, den), "u long, v long"), "near-links")
    return materialize(connected_components(links.unionByName(found)), "near-labels")


def _between(pairs: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """The pairs that are not tested yet and whose ends lie in different components."""
    la, lb = (labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}")) for s in "ab")
    rest = pairs.join(tested, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left")
    return rest.where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b", "est")


def _cells(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, at, one_block, left, node, label): the members of buckets that span components, dealt into
    blocks of about ``CELL``, and for each two blocks that must meet one cell with the rows of both.
    Members of a bucket's largest component meet those outside it only. Buckets of two are finished by their star."""
    rows = shared.where("members > 2").select("band", "at", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = rows.groupBy("band", "label").agg(F.count("*").alias("k"))
    spread = parts.groupBy("band").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(spread, "band").withColumn("outside", F.col("label") != F.col("main"))
    outer, inner = F.ceil((F.col("all") - F.col("most")) / CELL).cast("int"), F.ceil(F.col("most") / CELL).cast("int")
    rows = rows.withColumn("outer", outer).withColumn("inner", inner)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit("cell")), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))

    def cell(kind, i, j, left):
        return F.struct(F.xxhash64("band", F.lit(kind), i, j).alias("cell"), ((i == j) & F.lit(kind == "o")).alias("one_block"), left.alias("left"))

    own, upto = F.col("own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(upto("outer"), lambda j: cell("o", F.least(own, j), F.greatest(own, j), own < j))
    across = F.transform(upto("inner"), lambda j: cell("m", own, j, F.lit(True)))
    within = F.transform(upto("outer"), lambda i: cell("m", i, own, F.lit(False)))
    met = rows.select("at", "node", "label", F.explode(F.when(F.col("outside"), F.concat(among, across)).otherwise(within)).alias("c"))
    return met.select("c.cell", "at", "c.one_block", "c.left", "node", "label")


def _texts(spark, signed: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed text) of the named classes; a Bloom filter keeps the rest in place."""
    wanted = materialize(classes.select("node", "digest").join(nodes.distinct(), "node", "left_semi"), "near-wanted")
    bloom = spark.sparkContext.broadcast(bloom_of_digests(wanted, "digest", wanted.count()))
    sent = signed.select("digest", "packed").mapInArrow(_passing(bloom), "digest binary, packed binary")
    return materialize(sent.join(wanted, "digest").groupBy("node").agg(F.first("packed").alias("packed")), "near-texts")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with the least id (of several, that with the
    least MD5 of its text), and every row whose set is empty."""
    rows = _groups(docs, id_col, text_col, size, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("w")
    kept = rows.where("n > 0").groupBy("label").agg(first).select(F.col("w.doc_id").alias("__id"), F.col("w.mark").alias("__mark"))
    blank = rows.where("n = 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    keys = materialize(kept.unionByName(blank), "near-kept")
    mark = F.md5(F.col(text_col).cast("binary"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & mark.eqNullSafe(F.col("__mark"))
    out = docs.join(keys, same, "left_semi")
    repeated = rows.where("n > 0").groupBy("doc_id", "mark").agg(F.count("*").alias("k")).where("k > 1")
    if repeated.isEmpty():
        return out
    again = repeated.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    number = F.row_number().over(Window.partitionBy(id_col, mark).orderBy(*docs.columns))
    one = out.join(again, same, "left_semi").withColumn("__row", number).where("__row = 1").drop("__row")
    return out.join(again, same, "left_anti").unionByName(one)


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
