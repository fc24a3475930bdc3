"""Phrases of words that stand together more often than their words would by chance.

Each batch of documents is a shard with an FM-index over the ids of its words. Backward
extension of the intervals of the Burrows-Wheeler transform lists all phrases of a shard up
to a length, with their counts; the transform of the reversed shard is extended in step, so
that each phrase knows both the phrase without its first and without its last word. Counts
are summed over the shards. What is rare in all documents is cut out of the shards between
the rounds (words, pairs, triples), for a phrase is no more frequent than its parts. Pairs
and triples are cut by part of their hash: what shares it is counted together, so
that some rare ones stay and no frequent one goes; exact counts are asked of what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.arrays import LOWER, buffer_of, distinct, expand, longs, mix, prefix_hashes, runs, span_hashes, words
from tarmac.llm.exchange import answered, asked_again, batched, bucket_edges, buckets_of, deltas, dump, forget, load, shuffles_removed, sums, told
from tarmac.session import written

#: Bytes between pieces, `[.,;:!?\x0A-\x0D]`, and those and `[\x20\x09]` between words.
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
GAPS = ENDS.copy()
GAPS[[0x20, 0x09]] = True

#: What tells the hash of a language from that of a word, the base of phrase hashes, and
#: the parts that a language's phrases are ranked in first.
LANGUAGE, BASE, SALTS = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95), 64

#: Bits of a short hash more than it takes to number the bytes of all texts.
SPARE = 6

_FOUND = "lang string, phrase string, a long, n long, ls array<long>, rs array<long>, hash long, head long, tail long"


class Index:
    """FM-index of a sequence of ids, of which 0 separates pieces and stands first and last.

    Suffixes are in the order of their first `depth` ids, which is all that phrases of
    `depth` ids need.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        rank, done = ids.astype(np.int64), 1
        while done < depth:
            step = min(done, depth - done)
            later = np.zeros_like(rank)
            later[: len(rank) - step] = rank[step:]
            rank = distinct(rank * (int(rank.max(initial=0)) + 1) + later)[2]
            done += step
        order = np.argsort(rank, kind="stable")
        self.first, self.transform = ids[order], ids[order - 1]
        self.back = np.empty(len(ids), np.int64)
        self.back[np.argsort(self.transform, kind="stable")] = np.arange(len(ids))

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval (start, size) and id of every single id."""
        starts = runs(self.first)
        sizes = np.diff(np.append(starts, len(self.first)))
        real = self.first[starts] != 0
        return starts[real], sizes[real], self.first[starts[real]]

    def extended(self, starts: np.ndarray, sizes: np.ndarray, twins: np.ndarray):
        """All extensions of disjoint ascending intervals by one id before them, in the same order.

        start, size, which interval was extended, id, and the start in the index of the
        reversed sequence, of which `twins` are those of the given intervals.
        """
        places, owner = expand(starts, sizes), np.repeat(np.arange(len(starts)), sizes)
        ids = self.transform[places]
        ended = np.bincount(owner[ids == 0], minlength=len(starts))
        places, owner, ids = places[ids != 0], owner[ids != 0], ids[ids != 0]
        order = np.argsort(self.back[places])
        reached, owner, ids = self.back[places[order]], owner[order], ids[order]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])])) if len(ids) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(ids)))
        parent, by = owner[new], ids[new]
        # Those with a smaller id come first in the reversed sequence, ends before all.
        grouped = np.argsort(parent, kind="stable")
        before = np.cumsum(counts[grouped]) - counts[grouped]
        heads = runs(parent[grouped])
        smaller = np.empty(len(new), np.int64)
        smaller[grouped] = before - np.repeat(before[heads], np.diff(np.append(heads, len(new)))) if len(new) else before
        return reached[new], counts, parent, by, twins[parent] + ended[parent] + smaller


class Phrases:
    """Phrases of one length: how often, first id, hash, and which are their head and tail one length below.

    The head lacks the last id, the tail the first.
    """

    def __init__(self, counts, first, hashes, head, tail):
        self.counts, self.first, self.hashes, self.head, self.tail = counts, first, hashes, head, tail


def phrases(ids: np.ndarray, hashes: np.ndarray, depth: int) -> list[Phrases]:
    """All phrases of 1, 2, ... `depth` ids; `hashes` are those of the ids."""
    forward, reverse = Index(ids, depth), Index(ids[::-1], depth)
    starts, sizes, by = forward.roots()
    none = np.zeros(len(starts), np.int64)
    levels, power = [Phrases(sizes, by, hashes[by], none, none)], np.ones(1, np.uint64)
    # The intervals of single ids are the same in both directions.
    near, far = (starts, sizes, starts), (starts, sizes, starts)
    place = np.arange(len(starts))
    for _ in range(1, depth):
        power = power * BASE
        ahead, astern = forward.extended(*near), reverse.extended(*far)
        near, far = (ahead[0], ahead[1], ahead[4]), (astern[0], astern[1], astern[4])
        # The same phrases, met in two orders: each knows its start in the other index.
        mine = np.argsort(far[2])
        head = place[astern[2][mine]]
        place = np.empty(len(mine), np.int64)
        place[mine] = np.arange(len(mine))
        below = levels[-1]
        levels.append(Phrases(ahead[1], ahead[3], below.hashes[ahead[2]] + hashes[ahead[3]] * power, head, ahead[2]))
    return levels


def short_bits(size: int) -> np.uint64:
    """The bits of a hash by which pairs and triples are cut, for texts of so many bytes.

    They grow with the texts, so that the share of those that have another's stays small.
    """
    bits = min(64, size.bit_length() + SPARE)
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def _take_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return buf[expand(starts, lengths)]


def _questions(asked: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """A question for each bucket that some of the ascending hashes belong to."""
    edges = bucket_edges(asked, buckets)
    return [(b, dump(deltas(asked[s:e]), counts[s:e].astype(np.uint32))) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]


def _totals(asked: np.ndarray, replies: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Count over all shards of each asked hash, 0 for a rare one (1 if it was not told), and whether this shard speaks for it."""
    totals, ours = np.zeros(len(asked), np.int64), np.zeros(len(asked), dtype=bool)
    edges = bucket_edges(asked, buckets)
    for bucket, reply in replies.items():
        places, *more = load(reply)
        at = edges[bucket] + sums(places).astype(np.int64)
        totals[at], ours[at] = (more[0], more[1].astype(bool)) if more else (1, False)
    return totals, ours


def _summed(least: int, counted: bool = True):
    """A bucket's answer: which hashes occur at least `least` times in all shards, and if `counted` how often."""

    def answer(payloads: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        loaded = [load(p) for p in payloads]
        asked = [sums(d) for d, _ in loaded]
        shard = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
        hashes, _, which = distinct(np.concatenate(asked))
        totals = np.bincount(which, weights=np.concatenate([c for _, c in loaded])).astype(np.int64)
        speaks = np.empty(len(hashes), np.int64)
        speaks[which[::-1]] = shard[::-1]
        answers, start = [], 0
        for i, a in enumerate(asked):
            mine = which[start : start + len(a)]
            start += len(a)
            often = np.flatnonzero(totals[mine] >= least)
            more = (totals[mine[often]], (speaks[mine[often]] == i).astype(np.uint8)) if counted else ()
            answers.append(dump(deltas(often.astype(np.uint32)), *more) if len(often) else b"")
        return answers, []

    return answer


def _seeds(names_at: np.ndarray, names_buf: np.ndarray) -> np.ndarray:
    """The hashes of the languages' names."""
    return span_hashes(prefix_hashes(names_buf), names_at[:-1], names_at[1:])


def _word_hashes(lengths: np.ndarray, spelling: np.ndarray, language: np.ndarray, names_at: np.ndarray, names_buf: np.ndarray) -> np.ndarray:
    """The hashes of a body's words in their languages, in the order of their ids."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return mix(span_hashes(prefix_hashes(spelling), ends - lengths, ends) + mix(_seeds(names_at, names_buf)[language] ^ BASE))


def _shard(buckets: int):
    """Body: ids with separators; language and spelling of each id; the languages. Question: counts.

    The most frequent word is 1. Words that the shard has once are the last, in the order in
    which they stand there, and are written as one id: `_ids_of` tells them apart again.
    Hashes, which do not compress, are made again from the spelling.
    """

    def make(parts: list[pa.RecordBatch]) -> tuple[bytes, list[tuple[int, bytes]]]:
        names: dict[str, int] = {}
        met, breaks, spelled, language = [], [], [], []
        for part in parts:
            buf, offsets = buffer_of(part.column(1))
            buf = LOWER[buf]
            starts, ends, owner = words(buf, offsets, GAPS)
            of_text = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()], np.int32)
            piece = np.concatenate([[0], np.cumsum(ENDS[buf], dtype=np.int64)])[starts] + owner
            hashes = span_hashes(prefix_hashes(buf), starts, ends)
            language.append(of_text[owner])
            met.append(hashes)
            breaks.append(np.concatenate([[True], piece[1:] != piece[:-1]])[: len(starts)])
            spelled.append((buf, starts, ends - starts))
        langs = pa.array(list(names), pa.string())
        names_buf, names_at = buffer_of(langs)
        seeds = _seeds(names_at, names_buf)
        language = np.concatenate(language)
        known, place, which = distinct(mix(np.concatenate(met) + mix(seeds[language] ^ BASE)))
        times = np.bincount(which, minlength=len(known))
        often = np.lexsort((np.where(times > 1, 0, place), -times))
        known, place, times = known[often], place[often], times[often]
        new = np.empty(len(often), np.int64)
        new[often] = np.arange(len(often))
        which = new[which]
        # Spellings are taken from the part in which each word's place is.
        part_starts = np.cumsum([0, *(len(m) for m in met)])
        part_of = np.searchsorted(part_starts, place, side="right") - 1
        lengths = np.zeros(len(known), np.int64)
        pieces = []
        for k, (buf, starts, sizes) in enumerate(spelled):
            mine = np.flatnonzero(part_of == k)
            at = place[mine] - part_starts[k]
            lengths[mine] = sizes[at]
            pieces.append((mine, _take_spans(buf, starts[at], sizes[at])))
        begins = np.cumsum(lengths) - lengths
        spelling = np.empty(int(lengths.sum()), np.uint8)
        for mine, letters in pieces:
            spelling[expand(begins[mine], lengths[mine])] = letters
        breaks = np.concatenate(breaks) if breaks else np.zeros(0, bool)
        ids = np.zeros(len(which) + int(breaks.sum()) + 1, np.uint32)
        once = int((times > 1).sum())
        ids[np.arange(len(which)) + np.cumsum(breaks)] = np.minimum(which, once) + 1
        del met, spelled, pieces
        body = dump(ids, np.array([once], np.uint32), language[place].astype(np.uint32), lengths.astype(np.uint32), spelling, names_at, names_buf)
        del ids
        asked = np.concatenate([known, mix(seeds ^ LANGUAGE)])
        counts = np.concatenate([times, np.bincount(language, minlength=len(seeds))])
        order = np.argsort(asked)
        return body, _questions(asked[order], counts[order], buckets)

    return make


def _ids_of(ids: np.ndarray, once: int) -> np.ndarray:
    """The sequence in which each word that occurs once, all of them `once` + 1, has an id of its own."""
    out = ids.copy()
    single = np.flatnonzero(ids == once + 1)
    out[single] = np.arange(once + 1, once + 1 + len(single))
    return out


def _kept_ids(ids: np.ndarray, keep: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence with new ids for those to keep and one separator for any run of others; and which are kept.

    The most frequent word is 1, so that most ids are small numbers and take little room.
    """
    kept = np.flatnonzero(keep)
    kept = kept[np.argsort(-often[kept], kind="stable")]
    new = np.zeros(len(keep) + 1, np.uint32)
    new[1 + kept] = np.arange(1, len(kept) + 1)
    out = new[ids]
    return out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])], kept


def _spelled(lengths: np.ndarray, spelling: np.ndarray, kept: np.ndarray) -> np.ndarray:
    begins = np.cumsum(lengths, dtype=np.int64) - lengths
    return _take_spans(spelling, begins[kept], lengths[kept].astype(np.int64))


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order and the sum of the counts of each."""
    known, _, which = distinct(hashes)
    return known, np.bincount(which, weights=counts, minlength=len(known)).astype(np.int64)


def runs_of(ids: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where k ids stand together, and the hash of the phrase they make."""
    there = ids != 0
    whole = np.ones(max(0, len(ids) - k + 1), dtype=bool)
    for j in range(k):
        whole &= there[j : j + len(whole)]
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * BASE + hashes[ids[at + j] - 1]
    return at, out


def stretches(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The sequence without what is in none of the runs of k ids that begin at these places."""
    linked = np.zeros(len(ids), dtype=bool)
    for j in range(k - 1):
        linked[at + j] = True
    # A place stays if it is in such a run; what is not linked to the next is parted by a 0.
    stays = linked | np.concatenate([[False], linked[:-1]])
    width = stays.astype(np.int64) + (stays & ~linked)
    begins = np.cumsum(width) - width
    out = np.zeros(int(width.sum()) + 1, np.uint32)
    out[1 + begins[stays]] = ids[stays]
    return out


def _phrases_of(ids: np.ndarray, hashes: np.ndarray, depth: int) -> list[Phrases]:
    return phrases(ids, np.concatenate([np.zeros(1, np.uint64), hashes]), depth)


def _together(levels: list[Phrases]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all phrases of these lengths."""
    return np.concatenate([np.zeros(0, np.uint64), *(p.hashes for p in levels)]), np.concatenate([np.zeros(0, np.int64), *(p.counts for p in levels)])


def _without_rare_words(buckets: int, short: np.uint64):
    """Body: the shard with frequent words only. Question: counts of pairs, by their short hashes."""

    def tell(body: bytes, replies: dict[int, bytes]) -> tuple[bytes, list[tuple[int, bytes]]] | None:
        ids, once, language, lengths, spelling, names_at, names_buf = load(body)
        ids, seeds = _ids_of(ids, int(once[0])), _seeds(names_at, names_buf)
        known = _word_hashes(lengths, spelling, language, names_at, names_buf)
        asked = np.sort(np.concatenate([known, mix(seeds ^ LANGUAGE)]))
        totals, _ = _totals(asked, replies, buckets)
        often = totals[np.searchsorted(asked, known)]
        ids, kept = _kept_ids(ids, often > 0, often)
        if len(kept) == 0:
            return None
        hashes = known[kept]
        index = Index(ids, 2)
        starts, sizes, by = index.roots()
        _, counts, tail, first, _ = index.extended(starts, sizes, starts)
        pairs = hashes[by[tail] - 1] + hashes[first - 1] * BASE
        everything = totals[np.searchsorted(asked, mix(seeds ^ LANGUAGE))]
        new = dump(ids, language[kept], lengths[kept], _spelled(lengths, spelling, kept), names_at, names_buf, often[kept], everything)
        return new, _questions(*_merged(pairs & short, counts), buckets)

    return tell


def _without_rare_pairs(buckets: int, depth: int, short: np.uint64):
    """Body: the stretches of pairs that may be frequent. Question: counts of pairs, and of triples by their short hashes."""

    def tell(body: bytes, replies: dict[int, bytes]) -> tuple[bytes, list[tuple[int, bytes]]] | None:
        ids, language, lengths, spelling, names_at, names_buf, often, everything = load(body)
        hashes = _word_hashes(lengths, spelling, language, names_at, names_buf)
        at, pairs = runs_of(ids, hashes, 2)
        asked, _, which = distinct(pairs & short)
        totals, _ = _totals(asked, replies, buckets)
        at = at[totals[which] > 0]
        if len(at) == 0:
            return None
        ids = stretches(ids, at, 2)
        there = np.zeros(len(hashes), dtype=bool)
        there[ids[ids != 0] - 1] = True
        ids, kept = _kept_ids(ids, there, often)
        hashes = hashes[kept]
        levels = _phrases_of(ids, hashes, min(3, depth))
        triples, counts = _together(levels[2:])
        triples, counts = _merged(triples & short, counts)
        pairs, times = _together(levels[1:2])
        new = dump(ids, language[kept], lengths[kept], _spelled(lengths, spelling, kept), names_at, names_buf, often[kept], everything)
        return new, _questions(*_merged(np.concatenate([pairs, triples]), np.concatenate([times, counts])), buckets)

    return tell


def _without_rare_triples(buckets: int, depth: int, short: np.uint64):
    """Body: the stretches of triples that may be frequent, and the frequent pairs. Question: counts of phrases of three ids and more."""

    def tell(body: bytes, replies: dict[int, bytes]) -> tuple[bytes, list[tuple[int, bytes]]] | None:
        ids, language, lengths, spelling, names_at, names_buf, often, everything = load(body)
        hashes = _word_hashes(lengths, spelling, language, names_at, names_buf)
        at, pairs = runs_of(ids, hashes, 2)
        known, place, _ = distinct(pairs)
        begins, triples = runs_of(ids, hashes, 3) if depth > 2 else (at[:0], pairs[:0])
        asked = distinct(np.concatenate([known, triples & short]))[0]
        totals, ours = _totals(asked, replies, buckets)
        where = np.searchsorted(asked, known)
        frequent = totals[where] > 0
        place, where = at[place[frequent]], where[frequent]
        ids_of_pairs = np.stack([ids[place], ids[place + 1]])
        held = (known[frequent], totals[where], ours[where].astype(np.uint8), ids_of_pairs[0], ids_of_pairs[1])
        ids = stretches(ids, begins[totals[np.searchsorted(asked, triples & short)] > 0], 3)
        longer, counts = _together(_phrases_of(ids, hashes, depth)[2:])
        order = np.argsort(longer)
        return dump(ids, language, lengths, spelling, names_at, names_buf, often, everything, *held), _questions(longer[order], counts[order], buckets)

    return tell


def _frequent(buckets: int, depth: int):
    """The frequent phrases that this shard speaks for, with the counts of the two parts of every cut."""

    def tell(body: bytes, replies: dict[int, bytes]) -> pa.Table:
        ids, language, lengths, spelling, names_at, names_buf, often, everything, pairs, of_pairs, ours_of_pairs, one, two = load(body)
        hashes = _word_hashes(lengths, spelling, language, names_at, names_buf)
        begins = np.cumsum(lengths, dtype=np.int64) - lengths
        letters, places = spelling.tobytes(), names_at.tolist()
        texts = [letters[b : b + n] for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)]
        langs = [names_buf.tobytes()[b:e].decode() for b, e in zip(places[:-1], places[1:], strict=True)]
        columns: list[list] = [[] for _ in range(9)]

        def put(words: np.ndarray, a: np.ndarray, ls: np.ndarray, rs: np.ndarray, whole: np.ndarray, head: np.ndarray, tail: np.ndarray) -> None:
            of = language[words[:, 0] - 1]
            spelled = [b" ".join(texts[i - 1] for i in row).decode() for row in words.tolist()]
            marks = [x.view(np.int64).tolist() for x in (whole, head, tail)]
            for column, values in zip(columns, ([langs[i] for i in of], spelled, a.tolist(), everything[of].tolist(), ls.tolist(), rs.tolist(), *marks), strict=True):
                column += values

        mine = ours_of_pairs.astype(bool)
        if mine.any():
            first, second = one[mine] - 1, two[mine] - 1
            put(np.stack([one[mine], two[mine]], axis=1), of_pairs[mine], often[first][:, None], often[second][:, None], pairs[mine], hashes[first], hashes[second])
        levels = _phrases_of(ids, hashes, depth)
        asked, _ = _together(levels[2:])
        order = np.argsort(asked)
        sorted_totals, sorted_ours = _totals(asked[order], replies, buckets)
        totals, ours = np.zeros(len(asked), np.int64), np.zeros(len(asked), dtype=bool)
        totals[order], ours[order] = sorted_totals, sorted_ours
        # A pair of these stretches may be rare if its hash is not: it counts 0, and no frequent phrase holds it.
        at = np.minimum(np.searchsorted(pairs, levels[1].hashes), max(0, len(pairs) - 1))
        counts = [often[levels[0].first - 1], np.where(pairs[at] == levels[1].hashes, of_pairs[at], 0) if len(pairs) else np.zeros(len(at), np.int64)]
        start = 0
        for k in range(2, len(levels)):
            p = levels[k]
            mine = slice(start, start + len(p.hashes))
            start += len(p.hashes)
            counts.append(totals[mine])
            chosen = np.flatnonzero(ours[mine] & (totals[mine] > 0))
            if len(chosen) == 0:
                continue
            # Heads and tails of each length, and the ids, by going down the levels.
            heads, tails, words = {k: chosen}, {k: chosen}, []
            for level in range(k, 0, -1):
                heads[level - 1] = levels[level].head[heads[level]]
                words.append(levels[level].first[tails[level]])
                tails[level - 1] = levels[level].tail[tails[level]]
            words.append(levels[0].first[tails[0]])
            ls = np.stack([counts[j][heads[j]] for j in range(k)], axis=1)
            rs = np.stack([counts[k - 1 - j][tails[k - 1 - j]] for j in range(k)], axis=1)
            put(np.stack(words, axis=1), counts[k][chosen], ls, rs, p.hashes[chosen], levels[k - 1].hashes[heads[k - 1]], levels[k - 1].hashes[tails[k - 1]])
        lists = pa.list_(pa.int64())
        arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), longs(columns[2]), longs(columns[3]), pa.array(columns[4], lists), pa.array(columns[5], lists)]
        return pa.table([*arrays, *(longs(c) for c in columns[6:])], ["lang", "phrase", "a", "n", "ls", "rs", "hash", "head", "tail"])

    return tell


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """All phrases of 2 to `longest` words that occur at least `least` times in a language.

    lang, phrase, a (occurrences), n (words of the language), ls and rs (occurrences of the
    first words and of the rest, for the cut after 1, 2, ... words), and the 64-bit hashes
    of the phrase and of it without its last and its first word.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have at least two words and occur at least once")
    chosen = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    with shuffles_removed(docs.sparkSession):
        return _counted(chosen, least, longest)


def _counted(chosen: DataFrame, least: int, longest: int) -> DataFrame:
    """The rounds of `frequent_phrases`, from lang and text."""
    size = chosen.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, short = buckets_of(size), short_bits(size)

    def next_round(asked: DataFrame, answer, tell, purpose: str) -> DataFrame:
        """What is left after a round; the tables of the round are not needed any more."""
        answers = answered(asked, answer, f"{purpose}-answers")
        left = asked_again(asked, answers, tell, purpose)
        forget(asked, answers)
        return left

    shards = batched(chosen, _shard(buckets), "phrases-words")
    pairs = next_round(shards, _summed(least), _without_rare_words(buckets, short), "phrases-pairs")
    triples = next_round(pairs, _summed(least, False), _without_rare_pairs(buckets, longest, short), "phrases-triples")
    longer = next_round(triples, _summed(least), _without_rare_triples(buckets, longest, short), "phrases-longer")
    answers = answered(longer, _summed(least), "phrases-answers")
    found = written(told(longer, answers, _frequent(buckets, longest), _FOUND), "phrases")
    forget(longer, answers)
    return found


def lowest_cut() -> Column:
    """Score, place, l and r of the cut that scores lowest, of equal ones the first; in decimals, which hold all products."""
    return F.expr(
        """array_min(transform(arrays_zip(ls, rs), (c, i) -> struct(
          cast((1000 * cast(a as decimal(18, 0)) * cast(n as decimal(18, 0))) div (cast(c.ls as decimal(18, 0)) * cast(c.rs as decimal(18, 0))) as bigint) as score,
          i as place, c.ls as l, c.rs as r)))"""
    )


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, cover: int = 100, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` best phrases of each language.

    A-Z count as a-z. Texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces, and these into
    words `[^\\x20\\x09]+`; phrases do not cross pieces. A phrase of 2 to `longest` words
    counts if it occurs at least `least` times (a) in the language, overlaps included. A cut
    into its first words (l occurrences) and the rest (r) scores floor(1000 * a * n / (l * r)),
    in whole numbers, where n counts all words of the language; the lowest cut is the score,
    of equal ones the earliest. A phrase inside a longer one that occurs at least `cover`
    hundredths as often is left out. The order is by score, then a, both descending, then
    phrase in the order of its UTF-8 bytes.

    A null language counts as `und`; a null text, and one without words, as empty; rows that
    repeat an id count one by one; an empty table gives no rows; extra columns are ignored.
    Whole texts are read, and a text of any length is in one shard. 64-bit hashes stand for
    words and phrases between the shards.
    """
    found = frequent_phrases(docs, least, longest, text_column, lang_column)
    longer = found.where(F.size("ls") > 1).select(F.explode(F.array("head", "tail")).alias("hash"), "a").groupBy("hash").agg(F.max("a").alias("within"))
    alone = found.join(longer, "hash", "left").where(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * cover))
    ranked = alone.withColumn("cut", lowest_cut()).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may have most of the phrases: parts of it are ranked first.
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    parts = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
