"""A SentencePiece model rebuilt for the tokenizers library: encode, decode, parity.

The model protobuf gives the pieces with their scores and types, the normaliser's flags
and the byte pieces. A unigram model becomes a Unigram model with the same scores; a BPE
model becomes merges in descending order of score. Spaces become the metaspace marker.
Where no piece holds a marker behind another character, a text's ids are those of its
stretches (a run of markers and what follows up to the next), so each distinct stretch is
encoded once in a task, in multithreaded batches, and compared with the sentencepiece
library at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm.arrays import binaries, buffer_of, distinct, longs, portions, prefix_hashes, span_hashes
from tarmac.llm.common import texts
from tarmac.llm.id_store import IdStore

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
REMEMBERED = 1 << 19


@dataclass
class Rebuilt:
    """`whole` encodes and decodes texts; `stretch` encodes a stretch that begins with its spaces."""

    whole: object
    stretch: object
    separable: bool
    prefix: bool


def parsed(path: str):
    """The model protobuf."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, best score of the third first."""
    places = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, place in places.items():
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in places and piece[i:] in places]
        splits.sort(key=lambda s: (places[s[0]], places[s[1]]))
        found += [(-pieces[place][1], place, k, s) for k, s in enumerate(splits)]
    found.sort(key=lambda x: x[:3])
    return [s for *_, s in found]


def rebuild(path: str) -> Rebuilt:
    """The model as tokenizers; a kind that cannot be rebuilt is an error."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    model = parsed(path)
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    spec, kind = model.normalizer_spec, model.trainer_spec.model_type
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)

    def core():
        if kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=model.trainer_spec.byte_fallback)
        if kind == BPE:
            return models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges_of(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model.trainer_spec.byte_fallback)
        raise ValueError(f"no rebuilding for model type {kind}")

    shared = []
    if spec.precompiled_charsmap:
        shared.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        shared += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = [normalizers.Replace(" ", MARK)] if spec.escape_whitespaces else []
    made = []
    for first in ([normalizers.Prepend(MARK)] if spec.add_dummy_prefix else [], []):
        t = Tokenizer(core())
        t.normalizer = normalizers.Sequence([*shared, *first, *mark])
        strip = [decoders.Strip(" ", 1, 0)] if first else []
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        t.add_tokens([AddedToken(p, normalized=True) for p, _, k in pieces if k == USER])
        made.append(t)
    crosses = any(k in (NORMAL, USER) and MARK in p.lstrip(MARK) for p, _, k in pieces)
    separable = not shared and spec.escape_whitespaces and not crosses
    return Rebuilt(made[0], made[1], separable, spec.add_dummy_prefix)


def stretches(buf: np.ndarray, offsets: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with their dummy prefix, and start, end and text number of each stretch.

    A marker character in a text is the same as a space to the model.
    """
    if len(buf) > 2:
        at = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81))
        if len(at):
            buf = buf.copy()
            buf[at] = 0x20
            kept = np.ones(len(buf), dtype=bool)
            kept[at + 1] = kept[at + 2] = False
            places = np.concatenate([[0], np.cumsum(kept)])
            buf, offsets = buf[kept], places[offsets]
    if prefix:
        filled = (np.diff(offsets) > 0).astype(np.int64)
        buf = np.insert(buf, offsets[:-1][filled > 0], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    space = buf == 0x20
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    starts = np.flatnonzero(begins | edge[: len(buf)])
    ends = np.concatenate([starts[1:], [len(buf)]]) if len(starts) else starts
    return buf, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Stretches:
    """Ids of distinct stretches, whether they decode to themselves and whether both libraries agree."""

    def __init__(self, path: str, back: bool = False):
        import sentencepiece

        self.rebuilt, self.other = rebuild(path), sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [p.piece for p in parsed(path).pieces]
        self.marked = np.array([p.startswith(MARK) for p in spelled])
        self.only_marks = np.array([set(p) == {MARK} for p in spelled])
        self.store, self.spelt = IdStore(REMEMBERED), IdStore(REMEMBERED, np.uint8) if back else None

    def learn(self, hashes: list[int], spellings: list[str]) -> None:
        encoded, unlike = [np.zeros(0, np.uint32)] * len(spellings), np.zeros(len(spellings), dtype=bool)
        # Stretches of a group make one text, whose ids fall apart again where a marker
        # follows anything but a marker. What is spaces only goes alone.
        joined = [i for i, s in enumerate(spellings) if s[0] == " " and s.strip(" ")]
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        groups += [[i] for i, s in enumerate(spellings) if s[0] != " " or not s.strip(" ")]
        long = ["".join(spellings[i] for i in g) for g in groups]
        for group, text, e in zip(groups, long, self.rebuilt.stretch.encode_batch_fast(long, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            begins = self.marked[ids]
            begins[1:] &= ~self.only_marks[ids[:-1]]
            at = [0] if len(group) == 1 else np.flatnonzero(begins).tolist()
            for i, s, t in zip(group, at, [*at[1:], len(ids)], strict=True):
                encoded[i] = ids[s:t]
            if not self.same(text, ids):
                for i in group:
                    unlike[i] = not self.same(spellings[i], encoded[i])
        self.store.add(hashes, np.concatenate(encoded), np.array([len(e) for e in encoded], np.int64), unlike)
        if self.spelt is not None:
            made = [t.encode() for t in self.rebuilt.stretch.decode_batch([e.tolist() for e in encoded], skip_special_tokens=False)]
            self.spelt.add(None, np.frombuffer(b"".join(made), np.uint8), np.array([len(t) for t in made], np.int64))

    def same(self, text: str, ids: np.ndarray) -> bool:
        """Whether the other library gives these ids; it puts the dummy prefix itself."""
        short = text[1:] if self.rebuilt.prefix and text[0] == " " else text
        return text == " " or self.other.encode(short) == ids.tolist()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and its stretches on which the libraries differ.

        With `back`, `decoded` then has the texts that the ids decode to: bytes run within
        a stretch, so a text is what its stretches decode to, less the dummy prefix.
        """
        n = len(column)
        if not self.rebuilt.separable:
            whole = [t or "" for t in column.to_pylist()]
            encoded = [np.array(e.ids, np.uint32) for e in self.rebuilt.whole.encode_batch(whole, add_special_tokens=False)]
            unlike = [int(self.other.encode(t) != e.tolist()) for t, e in zip(whole, encoded, strict=True)]
            if self.spelt is not None:
                self.decoded = _texts(self.rebuilt, encoded)
            return np.concatenate([*encoded, np.zeros(0, np.uint32)]), np.array([len(e) for e in encoded], np.int64), np.array(unlike, np.int64)
        buf, starts, ends, owner = stretches(*buffer_of(column), self.rebuilt.prefix)
        if len(starts) == 0:
            self.decoded = pa.array([""] * n, pa.string())
            return np.zeros(0, np.uint32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        hashes, first, inverse = distinct(span_hashes(prefix_hashes(buf), starts, ends))
        new = self.store.unknown(hashes)
        if self.spelt is not None and self.store.count == 0:
            self.spelt.forget()
        raw = buf.tobytes() if new else b""
        for i in range(0, len(new), 8192):
            some = new[i : i + 8192]
            at = first[some]
            self.learn(hashes[some], [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        places = self.store.places(hashes)[inverse]
        if self.spelt is not None:
            sizes = np.bincount(owner, weights=self.spelt.lengths[places], minlength=n).astype(np.int64)
            raw, begins = self.spelt.ids(places), np.cumsum(sizes) - sizes
            if self.rebuilt.prefix:
                raw, sizes = np.delete(raw, begins[sizes > 0]), sizes - (sizes > 0)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            self.decoded = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(raw)).cast(pa.string())
        counts = np.bincount(owner, weights=self.store.lengths[places], minlength=n).astype(np.int64)
        return self.store.ids(places), counts, np.bincount(owner, weights=self.store.flags[places], minlength=n).astype(np.int64)


def _threads() -> None:
    """A batch is encoded by as many threads as a task is likely to have cores for."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", "2"


def _encoded(path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads()
        encoder = Stretches(path, back)
        for batch in batches:
            for part in portions(batch, "text"):
                flat, counts, unlike = encoder.encode(part.column(1))
                columns, names = [part.column(0), part.column(1), binaries(np.split(flat, np.cumsum(counts)[:-1])), longs(unlike)], ["doc_id", "text", "ids", "n_unlike"]
                if back:
                    columns, names = [*columns, encoder.decoded], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _texts(rebuilt: Rebuilt, ids: list[np.ndarray]) -> pa.Array:
    """Texts of lists of ids, a number of tokens at a time."""
    made: list[str] = []
    held: list[list[int]] = []
    size = 0
    for one in ids:
        held.append(one.tolist())
        size += len(held[-1])
        if size > 1 << 17:
            made += rebuilt.whole.decode_batch(held, skip_special_tokens=False)
            held, size = [], 0
    made += rebuilt.whole.decode_batch(held, skip_special_tokens=False) if held else []
    return pa.array(made, pa.string())


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads()
        rebuilt = rebuild(path)
        for batch in batches:
            place = batch.schema.get_field_index("ids")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = _texts(rebuilt, [np.frombuffer(i or b"", "<u4") for i in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, model_path: str, back: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, ids, n_unlike: the ids of each whole text; with `back` also `decoded`.

    `ids` holds little-endian unsigned 32-bit numbers. n_unlike counts the stretches whose ids differ from the sentencepiece library's. A
    null or empty text has no ids; null ids of documents stay null and repeated rows are
    encoded one by one; an empty table gives no rows; extra columns are ignored.
    """
    schema = "doc_id long, text string, ids binary, n_unlike long" + (", decoded string" if back else "")
    return texts(docs, id_column, text_column).mapInArrow(_encoded(model_path, back), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with a column `decoded`, the text of their `ids` (null: none)."""
    schema = [*encoded.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", decoded string"
    return encoded.mapInArrow(_decoded(model_path), ddl)
