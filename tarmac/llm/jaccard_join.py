"""Exact Jaccard join of texts by word shingles, as a join in a metric space.

Jaccard distance is a metric, so a pivot p splits the sets into regions: two sets within
distance r differ by at most r in their distance to p, and by at most 2r in how much
farther than its nearest pivot p is. Regions hold the sets nearest to their pivot, windows
of these widths replicate those near the boundary into them, and a region that is still
large is split by pivots of its own.

Most texts have distance 1 to almost every other, where no pivot can tell them apart. So
a set is measured against the pivots it can share a neighbour with, and no others: in one
global order of all shingles, linked sets share some of their first ones (how many follows
from the sizes and r). A shingle's pivot is the smallest set that has it there. A set that
shares too few of its first shingles with any other set has no neighbour at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.arrays import LOWER, binaries, buffer_of, counts_by, expand, longs, mix, portions, prefix_hashes, runs, span_hashes, words
from tarmac.llm.common import components
from tarmac.llm.exchange import BODY, answered, batched, bucket_edges, buckets_for, deltas, dump, load, sums, told
from tarmac.session import written

#: Members that are compared directly, pivots of a split, and members of a cell in one task.
LEAF, PIVOTS, CELL = 48, 6, 512


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and letters of each distinct shingle, by text and hash.

    A text with fewer than `width` words has one shingle, all of its words.
    """
    n = len(offsets) - 1
    lowered = LOWER[buf]
    starts, ends, owner = words(lowered, offsets)
    hashes = span_hashes(prefix_hashes(lowered), starts, ends)
    count = counts_by(owner, n)
    made = np.maximum(count - width + 1, np.minimum(count, 1))
    first = expand(np.cumsum(count) - count, made)
    who = np.repeat(np.arange(n), made)
    size = np.minimum(count, width)[who]
    value, letters = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
    for k in range(width):
        at = np.minimum(first + k, max(len(hashes) - 1, 0))
        here = size > k
        value = np.where(here, mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[at]), value) if len(first) else value
        letters += np.where(here, (ends - starts)[at], 0) if len(first) else 0
    order = np.lexsort((value, who))
    value, who, letters = value[order], who[order], letters[order]
    keep = np.concatenate([[True], (value[1:] != value[:-1]) | (who[1:] != who[:-1])]) if len(value) else np.zeros(0, bool)
    return value[keep], who[keep], letters[keep]


def set_ids(value: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each text's set, the same for equal sets."""
    total = np.zeros(n, np.uint64)
    at = runs(who)
    if len(at):
        total[who[at]] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
    return mix(total + counts_by(who, n).astype(np.uint64)).view(np.int64)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with a set it links to, at least."""
    return (percent * n + 99) // 100


def first_sizes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of its first shingles a set looks at, and how many a neighbour shares of them.

    Of the first n - o + k shingles, sets with an overlap of o or more share k or more. k
    is a tenth of the smaller set here, which has at least o shingles.
    """
    o = least_overlap(n, percent)
    return np.minimum(n, n - o + np.maximum(1, n // 10)), np.maximum(1, o // 10)


def _make(buckets: int, percent: int, width: int):
    def make(parts: list[pa.RecordBatch]) -> tuple[bytes, list[tuple[int, bytes]]]:
        sizes, ids, looked, keys, of = [], [], [], [], []
        for part in parts:
            value, who, letters = shingles(*buffer_of(part.column(1)), width)
            n = counts_by(who, part.num_rows)
            own = set_ids(value, who, part.num_rows)
            # The order of all shingles: longer ones, which are rarer, come first.
            order = np.argsort((who << 8) | (255 - np.minimum(letters, 255)), kind="stable")
            first, _ = first_sizes(n, percent)
            take = order[expand(np.cumsum(n) - n, first)]
            sizes.append(n)
            ids.append(own)
            looked.append(first)
            keys.append(value[take])
            of.append(own[who[take]])
        keys, of = np.concatenate(keys), np.concatenate(of)
        distinct, inverse = np.unique(keys, return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        at = runs(inverse[by])
        several = (np.minimum.reduceat(of[by], at) != np.maximum.reduceat(of[by], at)).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
        doc_ids = np.concatenate([np.asarray(p.column(0).fill_null(0), np.int64) for p in parts])
        known = np.concatenate([np.asarray(p.column(0).is_valid(), np.uint8) for p in parts])
        body = dump(doc_ids, known, np.concatenate(sizes), np.concatenate(ids), np.concatenate(looked), deltas(distinct), inverse.astype(np.uint32))
        edges = bucket_edges(distinct, buckets)
        return body, [(b, dump(deltas(distinct[s:e]), several[s:e])) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]

    return make


def _levels(questions: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """For each shingle 0 if one set has it, else a number that grows with the batches that have it."""
    asked = [load(q) for q in questions]
    hashes = [sums(a[0]) for a in asked]
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    batches = np.bincount(inverse, minlength=len(distinct))
    several = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked]), minlength=len(distinct))
    level = np.where(batches + several >= 2, 1 + np.floor(np.log2(batches + several)), 0).astype(np.uint8)
    return [dump(level[p]) if level[p].any() else b"" for p in np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])], []


def _tell(buckets: int, percent: int):
    def tell(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        doc_ids, known, n, own, looked, distinct, stream = load(payload)
        distinct = sums(distinct)
        level = np.zeros(len(distinct), np.uint8)
        edges = bucket_edges(distinct, buckets)
        for bucket, reply in replies.items():
            level[edges[bucket] : edges[bucket + 1]] = load(reply)[0]
        who = np.repeat(np.arange(len(n)), looked)
        of_key, hashes = level[stream], distinct[stream]
        shared = np.bincount(who, weights=of_key > 0, minlength=len(n))
        _, need = first_sizes(n, percent)
        # Of the shingles it looks at, a set may leave out the need - 1 most frequent ones.
        order = np.lexsort((hashes, of_key, who))
        place = np.arange(len(who)) - np.repeat(np.cumsum(looked) - looked, looked)
        good = (shared >= need) & (known == 1)
        keep = order[good[who] & (place < (looked - need + 1)[who]) & (of_key[order] > 0)]
        counts = counts_by(who[keep], len(n))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), longs(hashes[keep].view(np.int64)))
        return pa.table({"doc_id": pa.array(doc_ids, mask=known == 0), "n": longs(n), "set_id": longs(own), "keys": lists})

    return tell


def _fetched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                value, who, _ = shingles(*buffer_of(part.column(1)), width)
                own = set_ids(value, who, part.num_rows)
                wanted = np.flatnonzero(own == np.asarray(part.column(2), np.int64))
                cut = np.searchsorted(who, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([longs(own[wanted]), binaries([value[cut[i] : cut[i + 1]] for i in wanted])], ["set_id", "members"])

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine, theirs = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
        shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(mine, theirs, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), longs([len(a) for a in mine]), longs([len(b) for b in theirs]), longs(shared)], ["pivot", "set_id", "n", "pivot_n", "shared"]
        )


class Region:
    """Sets of one cell, joined exactly: pairs with at least one `loose` set.

    Sets that are not loose are linked to the cell's own pivot, hence to each other.
    """

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], loose: np.ndarray, percent: int):
        self.ids, self.loose, self.percent = ids, loose, percent
        self.n = np.array([len(s) for s in sets], np.int64)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.begins = flat, np.cumsum(self.n) - self.n
        self.mark = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
        tight = np.flatnonzero(~loose)
        self.label = np.arange(len(ids))
        if len(tight):
            self.label[tight] = tight[0]

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Common shingles of one set and others."""
        own = self.flat[self.begins[x] : self.begins[x] + self.n[x]]
        self.mark[own] = 1
        size = self.n[others]
        found = np.add.reduceat(self.mark[self.flat[expand(self.begins[others], size)]], np.cumsum(size) - size)
        self.mark[own] = 0
        return found

    def link(self, x: int, others: np.ndarray, found: np.ndarray) -> None:
        near = others[100 * found >= self.percent * (self.n[x] + self.n[others] - found)]
        groups = np.unique(self.label[np.append(near, x)])
        if len(groups) > 1:
            self.label[np.isin(self.label, groups)] = groups[0]

    def compare(self, home: np.ndarray, guests: np.ndarray) -> None:
        """All pairs in `home`, and of `home` with `guests`."""
        every = np.concatenate([home, guests])
        for k, x in enumerate(home):
            others = every[k + 1 :]
            others = others[(self.loose[x] | self.loose[others]) & (self.label[others] != self.label[x])]
            if len(others):
                self.link(x, others, self.shared(x, others))

    def join(self, home: np.ndarray, guests: np.ndarray) -> None:
        every = np.concatenate([home, guests])
        if len(home) <= LEAF or (self.label[every] == self.label[every[0]]).all():
            return self.compare(home, guests)
        reach = (100 - self.percent) / 100 + 1e-9
        pivots = home[np.linspace(0, len(home) - 1, PIVOTS).astype(int)]
        away = np.empty((PIVOTS, len(every)))
        for k, p in enumerate(pivots):
            found = self.shared(p, every)
            away[k] = 1 - found / (self.n[p] + self.n[every] - found)
        nearest, least = away[:, : len(home)].argmin(axis=0), away.min(axis=0)
        inside = np.arange(len(every)) < len(home)
        for k in range(PIVOTS):
            mine = inside.copy()
            mine[: len(home)] = nearest == k
            if not mine.any():
                continue
            window = away[k] <= away[k][mine].max() + reach
            # A guest's nearest pivot need not be of its own kind, so only the radius binds it.
            window &= ~inside | (away[k] <= least + 2 * reach)
            part, near = every[mine], every[window & ~mine]
            if len(part) + len(near) > 0.9 * len(every):
                self.compare(part, near)
            else:
                self.join(part, near)

    def edges(self) -> np.ndarray:
        joined = self.ids[self.label] != self.ids
        return np.stack([self.ids[joined], self.ids[self.label][joined]], axis=1)


def _cells(percent: int):
    def solved(held: list[tuple]) -> pa.RecordBatch | None:
        (_, _, i, j), _ = held[0]
        ids, side, guest, loose = (np.concatenate([h[1][c] for h in held]) for c in range(4))
        sets = [s for h in held for s in h[1][4]]
        _, first = np.unique(ids, return_index=True)
        ids, side, guest, loose, sets = ids[first], side[first], guest[first], loose[first], [sets[k] for k in first]
        region = Region(ids, sets, loose, percent)
        place = np.arange(len(ids))
        # In a pair of blocks, the first block's sets meet the second's; guests meet no guests.
        if i == j:
            region.join(place[~guest], place[guest])
        else:
            for a, b in ((i, j), (j, i)):
                region.join(place[(side == a) & ~guest], place[(side == b) & guest])
            region.join(place[~guest], place[:0])
        edges = region.edges()
        return pa.RecordBatch.from_arrays([longs(edges[:, 0]), longs(edges[:, 1])], ["a", "b"]) if len(edges) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            pivot, shell, i, j, side, ids = (np.asarray(batch.column(c), np.int64) for c in range(6))
            guest, loose = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in (6, 7))
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(8).to_pylist()]
            keys = np.stack([pivot, shell, i, j], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                key = tuple(int(k) for k in keys[s])
                if held and held[0][0] != key:
                    if (out := solved(held)) is not None:
                        yield out
                    held = []
                held.append((key, (ids[s:e], side[s:e], guest[s:e], loose[s:e], sets[s:e])))
        if held and (out := solved(held)) is not None:
            yield out

    return run


def _loose_links(measured: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between sets of one region that its pivot does not decide, from cells.

    A region's sets lie in shells of width r around the pivot; linked sets lie in one shell
    or in neighbouring ones, so a shell's cell has its own sets, and those of the shell
    below as guests. Cells without a loose set, or with one set, are done. A cell of more
    than `CELL` sets is dealt out as pairs of blocks.
    """
    reach = (100 - percent) / 100
    away = 1 - F.col("shared") / (F.col("n") + F.col("pivot_n") - F.col("shared"))
    rest = measured.where("pivot <> set_id").select("pivot", "set_id", F.floor(away / F.lit(reach) + 1e-9).cast("int").alias("shell"), (~F.col("linked")).alias("loose"))
    both = F.explode(F.array(F.struct(F.col("shell"), F.lit(False).alias("guest")), F.struct((F.col("shell") + 1).alias("shell"), F.lit(True).alias("guest"))))
    rows = rest.select("pivot", "set_id", "loose", both.alias("c")).select("pivot", "set_id", "loose", "c.shell", "c.guest")
    sizes = rows.groupBy("pivot", "shell").agg(F.count(F.lit(1)).alias("size"), F.max("loose").alias("open"), F.max(~F.col("guest")).alias("own"))
    # Written, so that the join shuffles both sides and can split a hot region's.
    sized = rows.join(written(sizes.where("size > 1 and open and own"), "jaccard-cells"), ["pivot", "shell"])
    sized = sized.withColumn("blocks", F.ceil(F.col("size") / F.lit(CELL)).cast("int")).withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("pivot", "shell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "set_id", "guest", "loose").join(sets, "set_id")
    order = ["pivot", "shell", "i", "j"]
    ready = cells.select(*order, "side", "set_id", "guest", "loose", "members").repartition(*order).sortWithinPartitions(*order)
    return ready.mapInArrow(_cells(percent), "a long, b long")


def linked_texts(docs: DataFrame, percent: int = 90, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of the table.

    A-Z count as small letters, words are what white space of ASCII separates; a text's
    set is that of its shingles of `width` words, or all its words if they are fewer. Two
    texts link when 100 * common >= percent * united shingles; component_id is the smallest
    id reachable by links. A text without words (also an empty or null one) has no
    shingles, links with nothing and is its own component. A row with a null id has a null
    component and links nothing. Rows that repeat an id are texts of their own, and count
    as that id. An empty table gives no rows; extra columns are ignored. `percent` is from
    50 to 100. Shingles and sets are compared by 64-bit hashes.

    Equal sets are one member, however many rows have them. Whole sets are shuffled only
    for those that can have a neighbour.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    buckets = buckets_for(rows)
    table = batched(rows, _make(buckets, percent, width), "jaccard")
    answers = answered(table, _levels, "jaccard-levels")
    known = written(told(table, answers, _tell(buckets, percent), "doc_id long, n long, set_id long, keys array<long>"), "jaccard-sets")

    open_sets = known.where((F.size("keys") > 0) & F.col("doc_id").isNotNull())
    keyed = open_sets.select("set_id", F.explode("keys").alias("key")).distinct()
    pivots = keyed.groupBy("key").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("last")).where("pivot <> last").select("key", "pivot")
    regions = written(keyed.join(pivots, "key").select("pivot", "set_id").distinct(), "jaccard-regions")
    first = open_sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    wanted = regions.select("set_id").distinct().join(first, "set_id")
    fetched = rows.join(wanted, "doc_id").select("doc_id", "text", "set_id")
    sets = written(fetched.mapInArrow(_fetched(width), "set_id long, members binary"), "jaccard-members")

    # Large regions are dealt out in blocks, each with a copy of the pivot's set.
    counted = regions.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL)
    large = written(counted.select("pivot", F.ceil(F.col("size") / F.lit(CELL)).cast("int").alias("blocks")), "jaccard-large")
    blocks = F.coalesce("blocks", F.lit(1))
    sided = regions.join(large, "pivot", "left").select("pivot", "set_id", F.pmod(F.xxhash64("set_id"), blocks).cast("int").alias("side"))
    copies = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("side")
    middle = regions.select("pivot").distinct().join(large, "pivot", "left").select("pivot", copies)
    middle = middle.join(sets.select(F.col("set_id").alias("pivot"), F.col("members").alias("pivot_members")), "pivot")
    pairs = sided.join(sets, "set_id").join(middle, ["pivot", "side"]).select("pivot", "set_id", "members", "pivot_members")
    linked = (100 * F.col("shared") >= percent * (F.col("n") + F.col("pivot_n") - F.col("shared"))).alias("linked")
    measured = written(pairs.mapInArrow(_measured, "pivot long, set_id long, n long, pivot_n long, shared long").select("*", linked), "jaccard-measured")

    edges = measured.where("linked").select(F.col("set_id").alias("a"), F.col("pivot").alias("b")).unionByName(_loose_links(measured, sets, percent))
    roots = components(edges).select(F.col("node").alias("set_id"), "root")
    grouped = known.join(roots, "set_id", "left").select("doc_id", "n", F.coalesce("root", "set_id").alias("group"))
    smallest = grouped.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("component"))
    # Written, so that the join shuffles both sides and can split a group of very many copies.
    joined = grouped.join(written(smallest, "jaccard-smallest"), "group", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
