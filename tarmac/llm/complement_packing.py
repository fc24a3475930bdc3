"""Packing of tokenised documents into few sequences: exact complements first, then best fit.

Only how many pieces have each length matters for a packing, and there are at most
`length` different lengths. Tasks cut documents into pieces and number the pieces of each
length; the counts by length are packed, as so many sequences of each combination; a
piece finds its place by its length and number. In descending order, a length is joined
with one, two or three lengths that fill its sequence to the last token, as often as their
counts allow; what no combination fills goes to the sequence with the least room for it.
"""

from __future__ import annotations

import bisect
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.arrays import NO_LETTER, SPACE, buffer_of, distinct, expand, longs, portions, prefix_hashes, runs, span_hashes
from tarmac.llm.common import texts
from tarmac.llm.id_store import IdStore
from tarmac.session import shared_dir

#: Stretches a task remembers the ids of, pieces in a row group that a task sends on, and
#: triples looked at for a gap.
REMEMBERED, ROWS, TRIPLES = 1 << 19, 1024, 16

#: ASCII letters, other ASCII bytes, ASCII bytes that are printed, and first bytes of
#: two-byte characters none of which is white space.
LETTER = ~NO_LETTER
LETTER[0x80:] = False
OTHER = NO_LETTER.copy()
VISIBLE, LEAD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
VISIBLE[0x21:0x7F] = True
LEAD[0xC3:0xE0] = True


def stretches(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of stretches that byte-level BPE encodes one by one.

    A text is cut after an ASCII letter that no letter follows, and before white space that
    follows what certainly is none: no token of the usual pattern of byte-level BPE reaches
    over such a place, and none depends on what stands before it.
    """
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if n > 1:
        cut[1:n] |= (LETTER[buf[:-1]] & OTHER[buf[1:]]) | (VISIBLE[buf[:-1]] & SPACE[buf[1:]])
    if n > 2:
        cut[2:n] |= SPACE[buf[2:]] & (buf[1:-1] >= 0x80) & LEAD[buf[:-2]]
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class StretchIds:
    """Ids of texts by a tokenizer; with the usual byte-level pattern each stretch is encoded once.

    Other tokenizers, and texts that spell out a special token, encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuttable = usual and parts["normalizer"] is None
        added = self.tokenizer.get_added_tokens_decoder()
        self.spelled = [t.content.encode() for t in added.values()]
        self.fences = [(t.content, i) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.store = IdStore(REMEMBERED, self.kind)

    def ids_of(self, spellings: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches and how many each has; unless `alone`, they go to the library in long texts between special tokens."""
        if alone or not self.fences:
            each = [e.ids for e in self.tokenizer.encode_batch(spellings, add_special_tokens=False)]
            return np.fromiter((i for e in each for i in e), self.kind), np.array([len(e) for e in each], np.int64)
        fence, mark = self.fences[0]
        found = []
        for i in range(0, len(spellings), 8192):
            long = [fence.join(spellings[j : j + 256]) + fence for j in range(i, min(i + 8192, len(spellings)), 256)]
            found += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(long, add_special_tokens=False)]
        ids = np.concatenate(found)
        marks = np.flatnonzero(ids == mark)
        return np.delete(ids, marks).astype(self.kind), np.diff(marks, prepend=-1) - 1

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        raw, n = buf.tobytes(), len(offsets) - 1
        whole = np.zeros(n, dtype=bool)
        if not self.cuttable:
            whole[:] = True
        elif any(t in raw for t in self.spelled):
            whole = np.array([any(t in raw[offsets[i] : offsets[i + 1]] for t in self.spelled) for i in range(n)])
        starts, ends, owner = stretches(buf, offsets)
        if whole.any():
            kept, entire = ~whole[owner], np.flatnonzero(whole & (offsets[1:] > offsets[:-1]))
            starts = np.concatenate([starts[kept], offsets[entire]])
            ends, owner = np.concatenate([ends[kept], offsets[entire + 1]]), np.concatenate([owner[kept], entire])
            order = np.argsort(starts)
            starts, ends, owner = starts[order], ends[order], owner[order]
        if len(starts) == 0:
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        hashes, first, inverse = distinct(span_hashes(prefix_hashes(buf), starts, ends))
        new = self.store.unknown(hashes)
        if new:
            at = first[new]
            self.store.add(hashes[new], *self.ids_of([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], bool(whole.any())))
        places = self.store.places(hashes)[inverse]
        counts = np.bincount(owner, weights=self.store.lengths[places], minlength=n).astype(np.int64)
        return self.store.ids(places), counts


class Complements:
    """Packs counts of lengths: `slots` holds (length, number of the first piece, times, first sequence, offset)."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts.astype(np.int64).copy(), capacity
        self.used, self.sequences = np.zeros(capacity + 1, np.int64), 0
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sums = self._pair_sums()
        for n in range(capacity, 0, -1):
            self._fill_exactly(n)
        self._best_fit()

    def _put(self, n: int, times: int, sequence: int, offset: int) -> None:
        """The next `times` pieces of length n go to as many sequences, from `sequence` on."""
        self.slots.append((n, int(self.used[n]), times, sequence, offset))
        self.used[n] += times
        self.left[n] -= times

    def _pair_sums(self) -> int:
        """Bit s is set if two of the lengths left may have the sum s."""
        there, sums = sum(1 << int(n) for n in np.flatnonzero(self.left)), 0
        for n in np.flatnonzero(self.left).tolist():
            sums |= there << n
        return sums

    def _pair(self, total: int, least: int = 1) -> tuple[int, ...] | None:
        """Two lengths of at least `least` with this sum: those of which there are most."""
        a = np.arange(least, total // 2 + 1)
        if len(a) == 0 or not self.sums >> total & 1:
            return None
        times = np.minimum(self.left[a], self.left[total - a])
        if total % 2 == 0:
            times[-1] = self.left[total // 2] // 2
        most = int(times.argmax())
        return (total - int(a[most]), int(a[most])) if times[most] > 0 else None

    def _complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three of the lengths left whose sum is `gap`.

        Triples are met in descending order of their least length; of the first `TRIPLES`,
        the one that can be used most often is taken.
        """
        if self.left[gap]:
            return (gap,)
        if (pair := self._pair(gap)) is not None:
            return pair
        found = []
        for least in range(gap // 3, 0, -1):
            if self.left[least] and self.sums >> (gap - least) & 1:
                self.left[least] -= 1
                pair = self._pair(gap - least, least)
                self.left[least] += 1
                if pair is not None:
                    found.append((self._times((*pair, least)), (*pair, least)))
                    if len(found) == TRIPLES:
                        break
        return max(found, key=lambda f: f[0])[1] if found else None

    def _times(self, together: tuple[int, ...]) -> int:
        """How often these lengths can be taken together."""
        return min(int(self.left[k]) // m for k, m in Counter(together).items())

    def _fill_exactly(self, n: int) -> None:
        while self.left[n]:
            gap = self.capacity - n
            self.left[n] -= 1
            others = self._complement(gap) if gap else ()
            self.left[n] += 1
            if others is None:
                return
            together = (n, *others)
            times = self._times(together)
            offset = 0
            for k in together:
                self._put(k, times, self.sequences, offset)
                offset += k
            self.sequences += times
            if any(self.left[k] == 0 for k in together):
                self.sums = self._pair_sums()

    def _best_fit(self) -> None:
        """Descending best fit; sequences with the same room that follow each other are handled as one."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def open_group(sequence: int, number: int, room: int) -> None:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((sequence, number))

        for n in range(self.capacity, 0, -1):
            while self.left[n]:
                at = bisect.bisect_left(rooms, n)
                if at < len(rooms):
                    room = rooms[at]
                    sequence, number = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                else:
                    room, sequence = self.capacity, self.sequences
                    number = -(-int(self.left[n]) // (room // n))
                    self.sequences += number
                each = room // n
                full = min(number, int(self.left[n]) // each)
                if full:
                    for k in range(each):
                        self._put(n, full, sequence, self.capacity - room + k * n)
                    if room % n:
                        open_group(sequence, full, room % n)
                if full < number:
                    # One sequence takes the rest, which fills no further one.
                    rest = int(self.left[n])
                    for k in range(rest):
                        self._put(n, 1, sequence + full, self.capacity - room + k * n)
                    if rest:
                        open_group(sequence + full, 1, room - rest * n)
                    if number > full + (rest > 0):
                        open_group(sequence + full + (rest > 0), number - full - (rest > 0), room)

    def table(self) -> np.ndarray:
        """The slots in ascending order of length and first piece."""
        slots = np.array(self.slots, np.int64).reshape(-1, 5)
        return slots[np.lexsort((slots[:, 1], slots[:, 0]))]


def places_of(table: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and numbers."""
    shift = np.int64(1) << np.int64(44)
    slot = np.searchsorted(table[:, 0] * shift + table[:, 1], lengths * shift + numbers, side="right") - 1
    return table[slot, 3] + numbers - table[slot, 1], table[slot, 4]


def cut_sizes(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of each document, and length and start of every piece; only the first may be shorter than `length`."""
    pieces = -(-tokens // length)
    first = tokens - (pieces - 1) * length
    number = expand(np.zeros(len(tokens), np.int64), pieces)
    head = np.repeat(first, pieces)
    return pieces, np.where(number == 0, head, length), np.where(number == 0, 0, head + (number - 1) * length)


_PIECES = "place long, number long, doc_id long, piece int, start long, length long, codes binary"


def _cut(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # Spark's tasks fill the cores; further threads of the library only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, place = StretchIds(path), TaskContext.get().partitionId()
        kind = encoder.kind if end_id <= np.iinfo(encoder.kind).max else np.uint32
        met = np.zeros(length + 1, np.int64)
        for batch in batches:
            for part in portions(batch, "text", 1 << 20):
                tokens, counts = encoder.encode(*buffer_of(part.column(1)))
                # Every document ends with the end id.
                sizes = counts + 1
                codes = np.full(len(tokens) + len(counts), end_id, kind)
                inside = np.ones(len(codes), dtype=bool)
                inside[np.cumsum(sizes) - 1] = False
                codes[inside] = tokens
                pieces, lengths, starts = cut_sizes(sizes, length)
                order = np.argsort(lengths, kind="stable")
                begins = runs(lengths[order])
                each = np.diff(np.append(begins, len(order)))
                numbers = np.empty(len(order), np.int64)
                numbers[order] = np.arange(len(order)) - np.repeat(begins, each) + met[lengths[order]]
                met += np.bincount(lengths, minlength=length + 1)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(pieces)), pieces)))
                piece = expand(np.zeros(len(pieces), np.int64), pieces).astype(np.int32)
                ends = np.cumsum(lengths)
                for s in range(0, len(lengths), ROWS):
                    e = min(s + ROWS, len(lengths))
                    first = int(ends[s] - lengths[s])
                    bounds = np.concatenate([[0], ends[s:e] - first]).astype(np.int32) * np.int32(codes.itemsize)
                    packed = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(bounds), pa.py_buffer(codes[first : int(ends[e - 1])])])
                    yield pa.RecordBatch.from_arrays(
                        [longs(np.full(e - s, place)), longs(numbers[s:e]), ids.slice(s, e - s), pa.array(piece[s:e]), longs(starts[s:e]), longs(lengths[s:e]), packed],
                        ["place", "number", "doc_id", "piece", "start", "length", "codes"],
                    )

    return run


def _placed(table: np.ndarray):
    """Sequence and offset by length and number; ids are widened to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                lengths, numbers = (np.asarray(batch.column(batch.schema.get_field_index(n)), np.int64) for n in ("length", "number"))
                sequence, offset = places_of(table, lengths, numbers)
                codes, bounds = buffer_of(batch.column(batch.schema.get_field_index("codes")))
                wide = len(codes) // max(1, int(lengths.sum()))
                flat = np.frombuffer(codes.tobytes(), np.uint16 if wide == 2 else np.uint32).astype("<u4")
                ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((bounds // wide * 4).astype(np.int32)), pa.py_buffer(flat)])
                columns = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length")]
                yield pa.RecordBatch.from_arrays([*columns, ids, longs(sequence), longs(offset)], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return run


def pack_tightly(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: one row for each piece.

    Every document is its tokens and `end_id`. Only a document of more than `length` tokens
    is cut, into pieces of `length` of which the first may be shorter. `ids` holds the
    piece's token ids as little-endian unsigned 32-bit numbers; the pieces of a sequence
    follow each other from offset 0 without a gap and have `length` tokens at most.

    A null text counts as empty, whose only token is the end id; null ids of documents stay
    null; rows that repeat an id are packed one by one; an empty table gives no rows; extra
    columns are ignored. A very long text is encoded whole, and its pieces are rows of
    their own. The driver gets one count for each length, at most `length` of them however
    many documents there are; a place is found by (task, length), of which no task has more
    than it wrote itself, so copies of a document do not meet in one task.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "pieces")
    texts(docs, id_column, text_column).mapInArrow(_cut(tokenizer_path, end_id, length), _PIECES).write.option("compression", "zstd").parquet(path)
    cut = spark.read.schema(_PIECES).parquet(path)
    counted = cut.groupBy("place", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(length + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    earlier = Window.partitionBy("length").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("place", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before.hint("shuffle_hash"), ["place", "length"]).withColumn("number", F.col("number") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return numbered.select("number", "doc_id", "piece", "start", "length", "codes").mapInArrow(_placed(Complements(counts, length).table()), schema)
