"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier.

Every string of ``length`` bytes has one designated gram, the one with the least hash in it (winnowing),
so all its copies meet wherever that gram's copies meet. A document has, for each gram that occurs twice
or more, the stretch of text in which that gram is the designated one. Equal stretches meet as hashes,
combined before the shuffle into their first place; all strings of the other places are repeats. Bytes
are sent only of the first places of grams that have several different stretches. They go to one
run-length index for each shard of grams: its Burrows-Wheeler transform is cut into runs, and of the
sorted suffixes only samples at run ends stay. Streaming the text, a sample gives every position's match
(inside a run its source moves along with it and its length falls by one); matches of ``length`` bytes
or more are linked to their sources, and of each class of linked strings the earliest start stays.

Grams with very many different stretches (``HOT`` or more: varied text around something common) would make an index
too large for a task. They are dealt on by the middles of their strings, and where as many distinct stretches
remain about one middle by second designated grams of their strings, which are longer each time: equal strings have
equal ones, so they still meet. Each time equal pieces meet as hashes and all but the first place are repeats; the
firsts of a shard go to its index as soon as they are fewer than that. Grams end at the length of a string, where a
shard has one. So whatever is different meets in an index of bounded size. Matches never cross documents.

Defined results: a null text is empty; texts shorter than length lose nothing; very long texts are worked
on whole, a row at a time; of texts that share a doc_id only positions inside one row count as the same
document, and the row with the smaller hash of its text counts as earlier; rows that repeat doc_id and
text all get the same result, that of their first copy; a null doc_id comes before all others; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.common import drop_written, read_table, row_key, written
from boxlake.llm.hashing import prefix_hashes, slices_of, span_hashes

LENGTH, GRAM = 100, 32
#: Different stretches from which a gram or a shard is dealt on, offsets that share a piece of such a stretch, and how
#: many times pieces are dealt by longer grams.
HOT, PIECE, LEVELS = 4096, 8, 3
#: Bytes of text in one index (and at most one more shard), and of the texts that are worked on at once.
INDEX_BYTES, SLICE_BYTES = 1 << 20, 1 << 18
_LOW = np.uint64((1 << 24) - 1)


def designated(text: np.ndarray, length: int = LENGTH, gram: int = GRAM, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram starts, their hashes, first and last start of the strings each is designated for) of one text."""
    n = len(text) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    at = np.arange(len(text) - gram + 1)
    hashes = span_hashes(prefix_hashes(text) if h is None else h, at, at + gram)
    starts, which = np.arange(n), _least(hashes, n, length - gram + 1)
    edges = np.flatnonzero(np.diff(which, prepend=-1))
    return which[edges], hashes[which[edges]], starts[edges], starts[np.append(edges[1:], len(starts)) - 1]


def _least(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each of n places where the least of the next so many hashes stands, the first of equal ones."""
    out: list[np.ndarray] = []
    # blocks keep positions within the low bits beside the hash
    step = 1 << 22
    for start in range(0, n, step):
        stop = min(n, start + step)
        key = (hashes[start : stop + width - 1] & ~_LOW) | np.arange(stop - start + width - 1, dtype=np.uint64)
        size, least = 1, key
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: stop - start], least[width - size : width - size + stop - start])
        out.append((least[: stop - start] & _LOW).astype(np.int64) + start)
    return np.concatenate(out)


#: A place is one long: start of the stretch, offset of the gram in it, its strings less one, whether its gram is hot.
_START, _BACK, _SPAN, _FIELD = 25, 13, 1, (1 << 12) - 1
_LONGS = pa.list_(pa.int64())


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists; null is an empty list."""
    if column.null_count:
        column = column.fill_null(pa.scalar([], column.type))
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _grams(length: int, gram: int):
    """(h1, text) to (h1, gram): the designated grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, 1, SLICE_BYTES):
                found = [designated(np.frombuffer(_bytes(t), np.uint8), length, gram)[1] for t in part.column(1).to_pylist()]
                of = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(np.concatenate(found).view(np.int64))], names=["h1", "gram"])

    return run


def _stretches(length: int, gram: int):
    """(doc_id, h1, h2, text, wanted grams) to (doc_id, h1, h2, places, grams, bodies): a body is the stretch's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, 3, SLICE_BYTES):
                offsets, wanted = _flat(part.column(4))
                lists: tuple[list, list, list] = ([], [], [])
                for i, t in enumerate(part.column(3).to_pylist()):
                    text = np.frombuffer(_bytes(t), np.uint8)
                    h = prefix_hashes(text)
                    at, grams, first, last = designated(text, length, gram, h)
                    here = np.isin(grams.view(np.int64), wanted[offsets[i] : offsets[i + 1]])
                    at, grams, first, last = at[here], grams[here], first[here], last[here]
                    lists[0].append(first << _START | (at - first) << _BACK | (last - first) << _SPAN)
                    lists[1].append(grams.view(np.int64))
                    lists[2].append(span_hashes(h, first, last + length).view(np.int64))
                names = ["doc_id", "h1", "h2", "places", "grams", "bodies"]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, _LONGS) for x in lists)], names=names)

    return run


def pieces_of(cuts: DataFrame, length: int) -> DataFrame:
    """doc_id, h1, h2, shard, start, body: the pieces of hot stretches (doc_id, h1, h2, place, body). A piece has the
    strings in which the gram's offset is the same but for its lowest bits, alike in all copies of a string;
    they are dealt by the bytes that all strings of the piece have."""
    a, back, span = f"shiftright(place, {_START})", f"(shiftright(place, {_BACK}) & {_FIELD})", f"(shiftright(place, {_SPAN}) & {_FIELD})"
    cut = lambda start, size: f"substring(body, cast({start} as int) + 1, cast({size} as int))"
    at = f"{back} - {PIECE} * j"
    low, high = f"greatest(0L, {at} - {PIECE - 1})", f"least({span}, {at})"
    piece = f"struct(xxhash64(j, {cut(at, length - PIECE + 1)}) AS shard, {a} + {low} AS start, {cut(low, f'{high} - {low} + {length}')} AS body)"
    return cuts.select("doc_id", "h1", "h2", F.expr(f"inline(transform(sequence(({back} - {span}) div {PIECE}, {back} div {PIECE}), j -> {piece}))"))


def place_keys(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, numbers of strings) of the stretches of places, hot ones in pieces as ``pieces_of`` cuts them."""
    a, back, span = places >> _START, (places >> _BACK) & _FIELD, (places >> _SPAN) & _FIELD
    hot = (places & 1) == 1
    starts, counts = [a[~hot]], [span[~hot] + 1]
    if hot.any():
        a, back, span = a[hot], back[hot], span[hot]
        first = (back - span) // PIECE
        n = back // PIECE - first + 1
        of = np.repeat(np.arange(len(a)), n)
        at = (a + back)[of] - PIECE * (first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        low, high = np.maximum(a[of], at - (PIECE - 1)), np.minimum((a + span)[of], at)
        starts.append(low)
        counts.append(high - low + 1)
    return np.concatenate(starts), np.concatenate(counts)


class RunIndex:
    """A run-length index over texts: the transform's runs, each with samples of the sorted suffixes at its end.

    What sorting needs is let go of; ``heads`` (positions in text order), ``sources`` and ``common`` have one value
    for each run of the transform: where its first suffix stands, where the one sorted before it does (the end of
    the run before), and how many bytes these two have in common.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # 0xFF is in no UTF-8 text
        self.owner = np.repeat(np.arange(len(texts)), sizes + 1)
        n = len(self.text)
        ends = np.cumsum(sizes + 1) - 1
        room = ends[self.owner] - np.arange(n)  # bytes from here to the text's end
        # ranks by the first 5 bytes; an end mark is a symbol of its own, by its text's number
        padded = np.concatenate([self.text, np.full(8, 255, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(5):
            key = (key << np.uint64(8)) | np.where(room >= k, padded[k : k + n], np.uint64(0))
        key = (key << np.uint64(24)) | np.where(room < 5, self.owner + 1, 0).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, np.int64)
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        size = 5
        while size <= sizes.max(initial=0):  # doubling, only inside groups that are still tied
            tied = ~(new & np.concatenate([new[1:], [True]]))
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            at = order[slots]
            nxt = rank[np.minimum(at + size, n - 1)]
            again = np.argsort(rank[at] << 32 | nxt)
            at, nxt = at[again], nxt[again]
            order[slots] = at
            group = rank[at]
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
            new[slots] = fresh
            rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            size *= 2
        before = self.text[order - 1].astype(np.int64)  # the transform; row of position 0 wraps to the last mark
        before = np.where(before == 255, 256 + order, before)  # end marks are all different
        rows = np.flatnonzero(before[1:] != before[:-1]) + 1
        heads, sources = order[rows], order[rows - 1]
        common = self._common(heads, sources, room)
        heads, sources, common = np.append(heads, order[0]), np.append(sources, order[0]), np.append(common, 0)
        in_text = np.argsort(heads)
        self.heads, self.sources, self.common = heads[in_text], sources[in_text], common[in_text]

    def _common(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common."""
        n = len(self.text)
        out, going = np.zeros(len(a), np.int64), np.arange(len(a))
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.text, np.full(8, 255, np.uint8)]), 8)
        limit = np.minimum(room[a], room[b])
        for k in range(0, int(limit.max(initial=0)) + 8, 8):
            if not len(going):
                break
            x, y = np.minimum(a[going] + k, n - 1), np.minimum(b[going] + k, n - 1)
            differ = words[x] != words[y]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            out[going] = k + first
            going = going[(first == 8) & (k + 8 < limit[going])]
        return np.minimum(out, limit)

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position, the length and the source of its match: the suffix sorted before it. Where the
        transform's run goes on, both positions have moved by one and the match is one byte shorter."""
        at = np.arange(len(self.text))
        run = np.searchsorted(self.heads, at, "right") - 1  # position 0 follows an end mark, so a run begins there
        moved = at - self.heads[run]
        return np.maximum(self.common[run] - moved, 0), self.sources[run] + moved


def repeated_starts(texts: list[bytes], places: list[tuple[int, int]], length: int) -> list[np.ndarray]:
    """For each text (distinct, first at places[i] = (document's rank, start)), which of its strings of
    length bytes also start earlier in another text or here."""
    index = RunIndex(texts)
    match, source = index.matches()
    # a long match links a string with its equal; following the links leads to one string of each class
    long = match >= length
    root = np.where(long, source, np.arange(len(match)))
    while (further := root[root] != root).any():
        root = np.where(further, root[root], root)
    at = np.union1d(np.flatnonzero(long), root[long])
    cls, owner = root[at], index.owner[at]
    docs, firsts = np.array([p[0] for p in places]), np.array([p[1] for p in places])
    order = np.lexsort((firsts[owner] + at - index.starts[owner], docs[owner], cls))
    again = np.concatenate([[False], cls[order][1:] == cls[order][:-1]]) if len(order) else np.zeros(0, bool)
    flags = np.zeros(len(match), bool)
    flags[at[order][again]] = True
    return [flags[s : s + len(t) - length + 1] for s, t in zip(index.starts, texts, strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _index(length: int):
    """(doc_id, h1, h2, shard, start, body), a shard's rows together, to (h1, h2, ranges of repeated bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rows = [(x[0] is not None, x[0] or 0, x[1], x[2]) for x in held]
            ranks = {d: i for i, d in enumerate(sorted(set(rows)))}
            keys, ranges = [], []
            for x, flags in zip(held, repeated_starts([x[5] for x in held], [(ranks[r], x[4]) for r, x in zip(rows, held, strict=True)], length), strict=True):
                if flags.any():
                    froms, tos = _runs(flags)
                    keys.append((x[1], x[2]))
                    ranges.append((froms + x[4]) << 32 | (tos + x[4] - 1 + length))
            arrays = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(ranges, _LONGS)]
            return pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "ranges"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] != last and size >= INDEX_BYTES:
                    yield flush()
                    held, size = [], 0
                last = row[3]
                held.append(row)
                size += len(row[5]) + 1
        if held:
            yield flush()

    return run


def removed_spans(places: np.ndarray, owned: np.ndarray, ranges: np.ndarray, pieces: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal removed runs of a text: all strings of the stretches that don't stand first here (owned), the
    ranges that were marked in those that do, and of owned stretches of hot grams the pieces that don't stand first
    here."""
    first_here = np.isin(places, owned & ~1)
    starts, counts = place_keys(places[~first_here])
    hot_starts, hot_counts = place_keys(owned[(owned & 1) == 1])
    other = ~np.isin(hot_starts << 13 | hot_counts, pieces)
    starts, counts = np.concatenate([starts, hot_starts[other]]), np.concatenate([counts, hot_counts[other]])
    froms = np.concatenate([starts, ranges >> 32])
    tos = np.concatenate([starts + counts - 1 + length, ranges & 0xFFFFFFFF])
    order = np.argsort(froms, kind="stable")
    froms, tos = froms[order], np.maximum.accumulate(tos[order])
    new = np.concatenate([[True], froms[1:] > tos[:-1]])[: len(froms)]
    return froms[new], tos[np.append(np.flatnonzero(new)[1:], len(froms)) - 1] if len(froms) else tos


def _spans(length: int):
    """(h1, h2, places, owned, ranges, pieces) to (h1, h2, starts, stops) of the texts that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_flat(c) for c in batch.columns[2:]]
            found = [removed_spans(*(v[o[i] : o[i + 1]] for o, v in lists), length) for i in range(batch.num_rows)]
            some = pa.array([i for i, f in enumerate(found) if len(f[0])], pa.int64())
            arrays = [batch.column(k).take(some) for k in (0, 1)] + [pa.array([f[k] for f in found if len(f[0])], _LONGS) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "starts", "stops"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, starts, stops, text) to (h1, h2, n_removed, n_spans, kept_sha256, starts, stops)."""
    for batch in batches:
        (o, starts), (_, stops) = _flat(batch.column(2)), _flat(batch.column(3))
        rows = []
        for i, text in enumerate(batch.column(4).to_pylist()):
            raw, at, kept = memoryview(_bytes(text)), 0, hashlib.sha256()
            s, e = starts[o[i] : o[i + 1]], stops[o[i] : o[i + 1]]
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            rows.append((int((e - s).sum()), len(s), kept.hexdigest()))
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, batch.column(2), batch.column(3)], names=["h1", "h2", "n_removed", "n_spans", "kept_sha256", "starts", "stops"])


def _dealt(length: int, gram: int):
    """(doc_id, h1, h2, shard, start, body) to the same rows cut into the strings that one gram is designated for, and gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, 5, SLICE_BYTES):
                bodies = part.column(5).to_pylist()
                raw, sizes = b"".join(bodies), np.array([len(x) for x in bodies])
                ends = np.cumsum(sizes)
                text, at = np.frombuffer(raw, np.uint8), np.arange(len(raw) - gram + 1)
                hashes = span_hashes(prefix_hashes(text), at, at + gram)
                which = _least(hashes, len(raw) - length + 1, length - gram + 1)
                of = np.repeat(np.arange(len(bodies)), sizes)[: len(which)]
                inside = np.flatnonzero(np.arange(len(which)) + length <= ends[of])  # strings of one body
                of, which = of[inside], which[inside]
                edges = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (of[1:] != of[:-1])]))
                first, last, of = inside[edges], inside[np.append(edges[1:], len(inside)) - 1], of[edges]
                rows = part.take(pa.array(of))
                start = rows.column(4).to_numpy(zero_copy_only=False) + first - (ends - sizes)[of]
                cut = [raw[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                grams = hashes[which[edges]].view(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(start), pa.array(cut, pa.binary()), pa.array(grams)], names=["doc_id", "h1", "h2", "shard", "start", "body", "gram"])

    return run


def _hot_marks(cuts: DataFrame, length: int, gram: int, hot_from: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """What comes of the owned stretches of hot grams: pieces for the index, ranges of repeats by document, and the pieces
    that stand first, by document."""
    columns = ["doc_id", "h1", "h2", "shard", "start", "body"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.select("doc_id", "h1", "h2").schema)
    earliest = lambda df: df.groupBy("shard", "body").agg(F.min(F.struct("doc_id", "h1", "h2", "start")).alias("first")).select("first.*", "shard", "body")
    pieces = written(earliest(pieces_of(cuts.filter("hot"), length)), "repeat-pieces")
    lists = pieces.groupBy("h1", "h2").agg(F.collect_list(F.shiftleft("start", 13).bitwiseOR(F.octet_length("body") - length + 1)).alias("pieces"))
    lists = written(lists, "repeat-hot")
    tables, again, index, first = [pieces, lists], None, None, pieces
    for level in range(LEVELS + 1):
        sizes = written(first.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeat-shards")
        tables.append(sizes)
        bounded = F.lit(True) if level == LEVELS else F.col("n") < hot_from  # at last a shard has one string
        some = first.join(sizes.filter(bounded).select("shard"), "shard", "left_semi").select(*columns)
        index = some if index is None else index.union(some)
        if level == LEVELS or sizes.filter(~bounded).isEmpty():
            break
        longer = gram + (length - gram) * (level + 1) // LEVELS
        left = first.join(sizes.filter(~bounded).select("shard"), "shard", "left_semi").select(*columns)
        dealt = left.mapInArrow(_dealt(length, longer), f"{kinds}, shard bigint, start bigint, body binary, gram bigint")
        dealt = written(dealt.withColumn("shard", F.xxhash64("shard", "gram")).select(*columns), "repeat-dealt")
        first = written(earliest(dealt), "repeat-pieces")
        tables += [dealt, first]
        later = dealt.join(first.select("h1", "h2", "shard", "start"), ["h1", "h2", "shard", "start"], "left_anti")
        later = later.select("h1", "h2", F.array(F.shiftleft("start", 32).bitwiseOR(F.col("start") + F.octet_length("body"))).alias("ranges"))
        again = later if again is None else again.union(later)
    return index, again, lists, tables


def spans_of(keyed: DataFrame, length: int, gram: int, hot_from: int) -> DataFrame:
    """h1, h2, starts, stops of the texts of keyed (doc_id, h1, h2, text; a row for each key) that lose bytes.

    Tables are deleted as soon as what was made from them is written."""
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    grams = written(keyed.select("h1", "text").mapInArrow(_grams(length, gram), "h1 bigint, gram bigint"), "repeat-grams")
    often = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "repeat-often")
    wanted = written(grams.join(often, "gram").groupBy("h1").agg(F.collect_set("gram").alias("wanted")), "repeat-wanted")
    drop_written(grams, often)
    # rows whose h1 collides share their wanted grams, which only makes them look for more
    texts = keyed.join(wanted.hint("merge"), "h1").select("doc_id", "h1", "h2", "text", "wanted")
    texts = written(texts.mapInArrow(_stretches(length, gram), f"doc_id {id_type}, h1 bigint, h2 bigint, places array<bigint>, grams array<bigint>, bodies array<bigint>"), "repeat-places")
    drop_written(wanted)
    places = texts.select("doc_id", "h1", "h2", F.expr("inline(arrays_zip(places, grams, bodies))")).toDF("doc_id", "h1", "h2", "place", "gram", "body")
    firsts = places.groupBy("gram", "body").agg(F.min(F.struct("doc_id", "h1", "h2", "place")).alias("first")).select("gram", "first.*")
    firsts = written(firsts, "repeat-firsts")
    sizes = written(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", (F.col("n") >= hot_from).alias("hot")), "repeat-sizes")

    needed = firsts.join(sizes, "gram").groupBy("h1", "h2").agg(F.collect_list(F.struct("gram", "hot", "place")).alias("needed"))
    cut = f"substring(bin, cast(shiftright(x.place, {_START}) as int) + 1, cast(shiftright(x.place, {_SPAN}) & {_FIELD} as int) + {length})"
    cuts = keyed.join(needed, ["h1", "h2"]).select("doc_id", "h1", "h2", F.col("text").cast("binary").alias("bin"), "needed")
    cuts = cuts.select("doc_id", "h1", "h2", F.expr(f"inline(transform(needed, x -> struct(x.gram AS shard, x.hot AS hot, x.place AS place, {cut} AS body)))"))
    cuts = written(cuts, "repeat-stretches")
    index = cuts.filter("not hot").select("doc_id", "h1", "h2", "shard", F.shiftright("place", _START).alias("start"), "body")
    done, lists, again = [texts, firsts, sizes, cuts], None, None
    hot_grams = sizes.filter("hot").select("gram", F.lit(1).cast("bigint").alias("flag"))
    if not hot_grams.isEmpty():
        pieces, again, lists, tables = _hot_marks(cuts, length, gram, hot_from)
        index, done = index.union(pieces), [*done, *tables]
        firsts = firsts.join(hot_grams, "gram", "left").withColumn("place", F.col("place").bitwiseOR(F.coalesce("flag", F.lit(0))))
    marks = index.repartition("shard").sortWithinPartitions("shard").mapInArrow(_index(length), "h1 bigint, h2 bigint, ranges array<bigint>")
    marks = marks if again is None else marks.unionByName(again)
    marks = marks.groupBy("h1", "h2").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    owned = firsts.groupBy("h1", "h2").agg(F.collect_list("place").alias("owned"))
    ready = texts.select("h1", "h2", "places").join(owned, ["h1", "h2"], "left").join(marks, ["h1", "h2"], "left")
    ready = ready.withColumn("pieces", F.lit(None).cast("array<bigint>")) if lists is None else ready.join(lists, ["h1", "h2"], "left")
    ready = ready.select("h1", "h2", "places", "owned", "ranges", "pieces")
    out = written(ready.mapInArrow(_spans(length), "h1 bigint, h2 bigint, starts array<bigint>, stops array<bigint>"), "repeat-spans")
    drop_written(*done)
    return out


def _keys() -> tuple:
    """128 bits that tell rows apart by doc_id and text."""
    return row_key("doc_id", "text").alias("h1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h2")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_from: int = HOT) -> DataFrame:
    """h1, h2 (the row's key), n_removed, n_spans, kept_sha256, starts, stops of the texts that lose bytes."""
    if not 8 <= gram <= length - PIECE or length > _FIELD:
        raise ValueError("gram must be from 8 to length - 8, length below 4096")
    keyed = docs.select("doc_id", *_keys(), "text")
    again = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.isEmpty():
        keyed = written(keyed.dropDuplicates(["h1", "h2"]), "repeat-rows")
    spans = spans_of(keyed, length, gram, hot_from)
    texts = spans.join(keyed.select("h1", "h2", "text"), ["h1", "h2"]).select("h1", "h2", "starts", "stops", "text")
    return texts.mapInArrow(_apply, "h1 bigint, h2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, stops array<bigint>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(repeated_spans(docs).drop("starts", "stops"), "repeat-found")
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", *_keys(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return plain.join(found, ["h1", "h2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE: dict[str, str] = {}
