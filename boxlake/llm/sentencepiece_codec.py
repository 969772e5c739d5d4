"""SentencePiece encoding and decoding over a shared-prefix traversal of distinct words.

A text becomes marked words (a run of spaces, written as U+2581, and the characters up to the next).
The distinct words of a batch are sorted, which is a trie in depth-first order: the forward states of
the prefix a word shares with the one before it are kept, and only the rest is computed.

* Unigram models: a state is the Viterbi score of the best segmentation of the prefix and its last piece.
* BPE models (the public model is one): a sum of scores doesn't give the library's result, since merges
  run by rank. There the state is the last piece of the prefix's own encoding, and a piece may follow
  another if the two, encoded together, come out as these two. Each prefix has exactly one such last
  piece, so the forward pass gives the merges' result exactly, and prefixes share it as before.

Defined results: null and empty texts have no pieces; characters the model lacks become byte pieces, or
the unknown piece in models without them; very long texts are encoded whole; U+2581 in a text reads back as a space, as in the library;
rows that repeat are all encoded; an empty table gives an empty table; other columns are ignored.
Decoding ids outside the model fails; control pieces decode to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from boxlake.llm.common import default_tokenizer, read_table
from boxlake.llm.hashing import slices_of

MARK = "▁"
#: Bytes of text in an output batch, words or pairs of pieces that a worker remembers before it starts anew, and the longest word
#: (in characters) that it does remember.
BATCH_BYTES, REMEMBERED, SHORT = 2 << 20, 250_000, 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How much less than the least score an unknown character costs in unigram models.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The pieces of a model and the forward states over them."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool, dummy_prefix: bool = True):
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.text = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = [i for i, p in enumerate(pieces) if p[2] == BYTE] if byte_fallback else []
        if self.byte_ids and len(self.byte_ids) != 256:
            raise ValueError("a model with byte pieces must have all 256")
        self.raw = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.starts_marked = [t in (NORMAL, USER_DEFINED, UNUSED) and p.startswith(MARK) for p, _, t in pieces]
        #: words can be encoded apart if no piece goes on past a mark that follows another character
        self.plain = dummy_prefix and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        ranks = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: ranks[s] for p, s in self.score.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        #: pieces that their own text encodes to (in unigram models all), and whether a piece may follow another
        self.followers: dict[str, dict[str, bool]] = {p: {} for p in self.ids if len(p) > 1 and (kind != BPE or self.merged(p) == [p])}
        self.n_known = 0
        #: lengths of these, longest first, by the last three characters; after others only two are tried
        ends: dict[str, set[int]] = {}
        for p in self.followers:
            ends.setdefault(p[-3:], {2}).add(len(p))
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in ends.items()}
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """text by merging the best-ranked neighbours until none can be merged, leftmost first of equals;
        the halves of the last merge are remembered."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            self.halves[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether before and piece, encoded together, come out as these two: undoing their merges from
        the last, no neighbours across the border could have merged before one of them grew on."""
        rank, halves = self.rank, self.halves
        limit = len(rank) + 1
        while True:
            across = rank.get(before + piece)
            if across is not None and across < limit:
                return False
            r, q = rank[before] if len(before) > 1 else -1, rank[piece] if len(piece) > 1 else -1
            if r > q:
                limit, before = r, halves[before][1]
            elif q >= 0:
                limit, piece = q + 1, halves[piece][0]
            else:
                return True

    def _extend_bpe(self, word: str, states: list, start: int) -> None:
        """states of the prefixes of word from start characters on: each the last piece of its encoding."""
        lengths, followers = self.lengths, self.followers
        for end in range(start, len(word) + 1):
            state = word[end - 1]  # unless more merges: nothing joins the last character; it may be no piece
            for n in lengths.get(word[max(end - 3, 0) : end], (2,)):
                if n <= end:
                    piece = word[end - n : end]
                    known = followers.get(piece)
                    if known is not None:
                        before = states[end - n]
                        if not before:
                            state = piece
                            break
                        found = known.get(before)
                        if found is None:
                            self.n_known += 1
                            if self.n_known > REMEMBERED:
                                self.n_known = 0
                                for k in followers.values():
                                    k.clear()
                            found = known[before] = self.may_follow(before, piece)
                        if found:
                            state = piece
                            break
            states.append(state)

    def _unigram_state(self, word: str, states: list, end: int):
        best = (states[end - 1][0] + self.least, word[end - 1])
        for n in (*self.lengths.get(word[max(end - 3, 0) : end], (2,)), 1):
            if n <= end and (piece := word[end - n : end]) in self.ids:
                s = states[end - n][0] + self.score[piece]
                if s > best[0] or (s == best[0] and n > len(best[1])):
                    best = (s, piece)
        return best

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of distinct words in sorted order, each from the states of the prefix it shares."""
        bpe = self.kind == BPE
        states: list = ["" if bpe else (0.0, "")]
        ids, before = self.ids, ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            if bpe:
                self._extend_bpe(word, states, shared + 1)
            else:
                for end in range(shared + 1, len(word) + 1):
                    states.append(self._unigram_state(word, states, end))
            out, end = [], len(word)
            while end:
                piece = states[end] if bpe else states[end][1]
                if (i := ids.get(piece)) is not None:
                    out.append(i)
                else:
                    out.extend(reversed(self.ids_of(piece)))
                end -= len(piece)
            out.reverse()
            yield word, tuple(out)
            before = word

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.plain and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            return text.split(" ")  # without their marks
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.apart else [marked]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """ids of each text. Words are remembered as they were cut; one cut at single spaces has its mark added."""
        cut = [self.words(t) for t in texts]
        new = {w for words in cut for w in words}.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for words in cut for w in words}
        mark = MARK if self.plain else ""
        marked = {w: w if w[:1] == MARK else mark + w for w in new}
        ids_of = dict(self.encode_sorted(sorted(set(marked.values()))))
        known = self.known
        known.update((w, ids_of[m]) for w, m in marked.items())
        get = known.__getitem__
        out = [list(chain.from_iterable(map(get, words))) for words in cut]
        for w in new:
            if len(w) > SHORT:  # long words are of this batch alone, so what is remembered is bounded in bytes too
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        if not len(ids):
            return ""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.dummy_prefix and self.starts_marked[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # bytes that form no character: each becomes U+FFFD
            out, at = [], 0
            while at < len(raw):
                size = next((n for n in (1, 2, 3, 4) if _is_char(raw[at : at + n])), 0)
                out.append(raw[at : at + size].decode() if size else "�")
                at += size or 1
            return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The pieces of a .model file, read once in each worker."""
    if path not in _LOADED:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are can be used")
        _LOADED[path] = Pieces([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.normalizer_spec.add_dummy_prefix)
    return _LOADED[path]


def encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: (doc_id, text) to (doc_id, n_pieces, piece_ids, round_trip)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # nothing here makes cycles, and collections would walk all remembered words
        pieces = load(path)
        for batch in batches:
            for part in slices_of(batch, 1, BATCH_BYTES):
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = pieces.encode(texts)
                same = [pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                counts = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                arrays = [part.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pieces", "piece_ids", "round_trip"])

    return run


def decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: (doc_id, piece_ids) to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, piece_ids, round_trip (whether decoding gives the text again) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoder(path or default_tokenizer("piece_bpe_32k.model")), f"doc_id {kind}, n_pieces bigint, piece_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and piece_ids."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "piece_ids").mapInArrow(decoder(path or default_tokenizer("piece_bpe_32k.model")), f"doc_id {kind}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_sentencepiece": op4_sentencepiece}
ORACLE: dict[str, str] = {}
