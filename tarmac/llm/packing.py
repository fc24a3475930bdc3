"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A piece of n tokens costs `linear * n + quadratic * n * n`, which is what attention inside
the piece takes. Documents are packed in windows of the order in which a task reads them.
A window with T tokens gets floor(T / length) full sequences, and the rest becomes
sequences whose lengths are powers of two, so no sequence is padded. In descending order
of cost, each document goes to the lowest-cost sequence that still has room for it; where
none has, it is cut at the largest room left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.arrays import LOWER, NO_LETTER, SPACE, binaries, buffer_of, distinct, expand, give_back, longs, portions, prefix_hashes, span_hashes, words
from tarmac.llm.common import texts
from tarmac.llm.id_store import IdStore

#: Tokens and documents of a window; a task holds the ids of one window.
WINDOW, DOCUMENTS = 1 << 21, 1 << 16

#: ASCII letters, and the other ASCII characters but white space.
LETTER, SIGN = ~NO_LETTER, NO_LETTER & ~SPACE
LETTER[0x80:] = False

#: Words a task remembers the ids of, and bytes of text that are looked at together.
REMEMBERED, PORTION = 1 << 19, 1 << 20


class WordIds:
    """Ids of words, each encoded once: white space ends a token in this kind of tokenizer.

    The tokenizer makes letters small, drops white space, and takes letters, single digits
    and runs of signs apart, so the ids of a text are those of its words, one after the
    other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fences = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.store = IdStore(REMEMBERED)

    def ids_of(self, spellings: list[str], fenced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has. Words go to the library in long texts, fenced off by a special token."""
        if not fenced:
            each = [e.ids for e in self.tokenizer.encode_batch(spellings, add_special_tokens=False)]
            return np.fromiter((i for e in each for i in e), np.uint32), np.array([len(e) for e in each], np.int64)
        fence, mark = self.fences[0]
        found = []
        for i in range(0, len(spellings), 8192):
            long = [fence.join(spellings[j : j + 256]) + fence for j in range(i, min(i + 8192, len(spellings)), 256)]
            found += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(long, add_special_tokens=False)]
        ids = np.concatenate(found)
        marks = np.flatnonzero(ids == mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        raw = buf.tobytes()
        # A text may spell out a special token, which is then matched across what follows.
        fenced = bool(self.fences) and not any(t.encode() in raw for t, _ in self.fences)
        cuts = None
        if fenced and len(buf):
            # A letter and a sign after it are never in one token; a capital letter is its
            # small one, unless a mark may follow that makes one character of both.
            plain = np.append(buf[1:] < 0x80, True)
            buf = np.where(plain, LOWER[buf], buf)
            cuts = np.flatnonzero(LETTER[buf[:-1]] & SIGN[buf[1:]]) + 1
        starts, ends, owner = words(buf, offsets, SPACE, cuts)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        hashes, first, inverse = distinct(span_hashes(prefix_hashes(buf), starts, ends))
        new = self.store.unknown(hashes)
        if new:
            at, raw = first[new], buf.tobytes()
            spellings = [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self.store.add(hashes[new], *self.ids_of(spellings, fenced))
        places = self.store.places(hashes)[inverse]
        counts = np.bincount(owner, weights=self.store.lengths[places], minlength=len(offsets) - 1).astype(np.int64)
        return self.store.ids(places), counts


def room_for(tokens: int, length: int) -> np.ndarray:
    """Lengths of the sequences of a window: full ones, then powers of two."""
    rest = tokens % length
    return np.array([length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def pack_window(sizes: np.ndarray, length: int, linear: float, quadratic: float) -> np.ndarray:
    """document, start, length, sequence, offset of each piece; the sequences are filled to the last token."""
    capacity = room_for(int(sizes.sum()), length)
    # Whole stretches of a long document fill sequences of their own.
    full = sizes // length
    pieces: list[tuple[int, int, int, int, int]] = []
    owners = np.repeat(np.arange(len(sizes)), full)
    places = expand(np.zeros(len(sizes), np.int64), full)
    pieces += [(int(d), int(p) * length, length, s, 0) for s, (d, p) in enumerate(zip(owners, places, strict=True))]
    taken = len(owners)
    room, filled = capacity[taken:].copy(), np.zeros(len(capacity) - taken, np.int64)
    cost = np.zeros(len(room))
    rest = sizes - full * length
    queue = [(int(rest[d]), int(d), int(full[d]) * length) for d in np.argsort(-rest, kind="stable") if rest[d]]

    def put(n: int, document: int, start: int, s: int) -> None:
        pieces.append((document, start, n, taken + s, int(filled[s])))
        filled[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, document, start in queue:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            s = int(fits.argmin())
            if np.isinf(fits[s]):
                s = int(room.argmax())
            part = min(n, int(room[s]))
            put(part, document, start, s)
            n, start = n - part, start + part
    return np.array(pieces, np.int64).reshape(-1, 5)


def _packed(path: str, end_id: int, length: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # Spark's tasks fill the cores; further threads of the library only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        give_back()
        encoder, sequences, place = WordIds(path), 0, TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, held
            ids = pa.concat_arrays([h[0] for h in held])
            sizes, tokens = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held = []
            pieces = pack_window(sizes, length, linear, quadratic)
            begins = np.cumsum(sizes) - sizes
            for start in range(0, len(pieces), 2048):
                document, at, n, sequence, offset = pieces[start : start + 2048].T
                parts = [tokens[b : b + k] for b, k in zip(begins[document] + at, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(document)), longs(at), longs(n), binaries(parts), longs(sizes[document]), longs((place << 32) + sequences + sequence), longs(offset)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            sequences += int(pieces[:, 3].max()) + 1

        waiting = documents = 0
        for batch in batches:
            for part in portions(batch, "text", PORTION):
                buf, offsets = buffer_of(part.column(1))
                tokens, counts = encoder.encode(buf, offsets)
                # Every document ends with the end id.
                sizes = counts + 1
                closed = np.full(len(tokens) + len(counts), end_id, np.uint32)
                inside = np.ones(len(closed), dtype=bool)
                inside[np.cumsum(sizes) - 1] = False
                closed[inside] = tokens
                held.append((part.column(0), sizes, closed))
                waiting, documents = waiting + len(closed), documents + len(sizes)
                if waiting >= WINDOW or documents >= DOCUMENTS:
                    yield from flush()
                    waiting = documents = 0
        if held:
            yield from flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 12288, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row for each piece.

    `ids` holds the piece's token ids as little-endian unsigned 32-bit numbers. The
    tokenizer must drop white space and never match across it. A null text counts as
    empty, whose only token is the end id; null ids of documents stay null; rows that
    repeat an id are packed one by one; an empty table gives no rows; extra columns are
    ignored. Tasks pack what they read and shuffle nothing, so no source, key or group of
    copies can pile up in one of them; only powers of two fall short of `length`.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return texts(docs, id_column, text_column).mapInArrow(_packed(tokenizer_path, end_id, length, linear, quadratic), schema)


def sequence_costs(pieces: DataFrame, linear: float = 1.0, quadratic: float = 1 / 12288) -> DataFrame:
    """sequence_id, tokens and estimated cost, by which the balance can be judged."""
    piece = F.col("length") * F.lit(linear) + F.col("length") * F.col("length") * F.lit(quadratic)
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.sum(piece).alias("cost"))
