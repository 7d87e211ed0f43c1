"""Byte-level BPE as a finite-state transducer, determinised while it runs; decoding with an incremental UTF-8 machine."""

from __future__ import annotations

import base64
import codecs
import re
import struct
from itertools import islice
from typing import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.llm.common import CACHES, free_name, query, release_memory, table

MAX_STATES = 150_000  # moves that are remembered besides the edges of the trie
MAX_WORDS = 80_000  # short pieces in one generation of their memo
MAX_PAIRS = 150_000  # pairs of tokens in one generation of theirs
MAX_SPINES = 16_000  # ends of tokens whose parts are remembered
LONG_PIECE = 64
SEEN = 1 << 20  # marks for pieces that came once
BLOCK = 1 << 16

# A faster form of a known pattern, equal to it on ASCII text.
ASCII_FORM = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^ \t-\r0-9A-Za-z]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+",
}


class Transducer:
    """Bytes in, token ids out.

    Merging by rank gives the one sequence of tokens in which every two neighbours, encoded together, stay as they are. So the machine that reads a token from
    any place on, and starts another one where a token ends that may follow the last, has one path to each place. Determinised, its state is the set of
    places in the trie of tokens at which it may stand. Such a set is a node with all its suffixes that are nodes, too, so a state is numbered by its longest node
    and there are never more states than nodes. Moves that are no edges of the trie are made when first needed. What a path has
    read before is no part of the state: `last` holds the token that ends at each place, and that is all a later token has to fit.
    Tokens before the place where all open paths meet are written, so they wait at most for the bytes of a few tokens.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        ends = [-1]
        above, depth = [0], [0]
        for token, i in ranks.items():
            node = 0
            for b in token:
                at = node << 8 | b
                on = self.edges.get(at)
                if on is None:
                    on = self.edges[at] = len(ends)
                    ends.append(-1)
                    above.append(at)
                    depth.append(depth[node] + 1)
                node = on
            ends[node] = i
        # The longest proper suffix of a node that is a node, and the tokens that end at it, long ones first.
        self.suffix = [0] * len(ends)
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, byte = above[node] >> 8, above[node] & 255
            if parent:
                up = self.suffix[parent]
                while up and up << 8 | byte not in self.edges:
                    up = self.suffix[up]
                self.suffix[node] = self.edges.get(up << 8 | byte, 0)
            more = self.found[self.suffix[node]]
            self.found[node] = ((ends[node], depth[node]), *more) if ends[node] >= 0 else more
        self.depth = depth
        self.made: list[int] = []  # keys of the moves that are no edges; they stand among the edges
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.spines: dict[int, list[tuple[bytes, int, int]]] = {}

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that stand at one end of a token while it is merged (0: its start, 1: its end), as (part, merged at, merged into more at); empty
        if merging doesn't make the token."""
        key = token << 1 | side
        found = self.spines.get(key)
        if found is None:
            if len(self.spines) >= MAX_SPINES:
                self.spines.clear()
            found, until, piece = [], 1 << 60, self.bytes_of[token]
            while True:
                split = self.halves(piece)
                if split == ():
                    found = []
                    break
                found.append((piece, self.ranks[piece] if split else -1, until))
                if not split:
                    break
                until = self.ranks[piece]
                piece = self.bytes_of[self.ranks[split[side]]]  # the one copy there is of it
            self.spines[key] = found
        return found

    def halves(self, piece: bytes) -> tuple[bytes, ...] | None:
        """The two parts that are merged last; None for one byte, () if merging ends before."""
        if len(piece) == 1:
            return None
        parts = [piece[i:i + 1] for i in range(len(piece))]
        get, none = self.ranks.get, 1 << 60
        while len(parts) > 2:
            ranks = [get(x + y, none) for x, y in zip(parts, parts[1:])]
            best = ranks.index(min(ranks))
            if ranks[best] == none:
                return ()
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def follows(self, a: int, b: int) -> bool:
        """Do both tokens stay if they are encoded together? They don't if parts at the border are merged with each other before
        their own side takes either; of equal ranks the left pair is merged first. Pairs not asked for in a whole generation are forgotten."""
        key = (a + 1) << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.old_pairs, self.pairs = self.pairs, {}
            known = self.old_pairs.get(key)
            known = self.pairs[key] = self.border(a, b) if known is None else known
        return known

    def border(self, a: int, b: int) -> bool:
        rank_of = self.ranks.get
        if a >= 0 and self.bytes_of[a] + self.bytes_of[b] in self.ranks:
            return False
        right = self.spine(b, 0)
        if a >= 0 and right:
            for x, x_from, x_until in self.spine(a, 1):
                for y, y_from, y_until in right:
                    if y_until < x_from:  # y and what it grew from are gone before x is there
                        break
                    rank = rank_of(x + y)
                    if rank is not None and max(rank, x_from, y_from) < x_until and max(rank, x_from, y_from) <= y_until:
                        return False
        return bool(right)

    def move(self, state: int, byte: int) -> int:
        at = state
        while True:
            to = self.edges.get(at << 8 | byte)
            if to is not None or not at:
                break
            at = self.suffix[at]
        if len(self.made) >= MAX_STATES:
            for key in self.made:
                del self.edges[key]
            self.made.clear()
        key = state << 8 | byte
        self.made.append(key)
        self.edges[key] = to or 0
        return to or 0

    def written(self, last: list[int], start: int, end: int) -> list[int]:
        """The tokens of the path that leads from place start to place end, which are numbers in last."""
        out, size_of = [], self.size_of
        while end > start:
            out.append(last[end])
            end -= size_of[last[end]]
        out.reverse()
        return out

    def meeting(self, last: list[int], state: int) -> int:
        """The last place that all paths share which may still go on."""
        here, open_ = len(last) - 1, set()
        while state:
            open_.add(here - self.depth[state])
            state = self.suffix[state]
        open_.add(here)
        while len(open_) > 1:
            place = max(open_)
            open_.remove(place)
            open_.add(place - self.size_of[last[place]])
        return open_.pop()

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:  # a piece that is a token is that token, reachable by merges or not
            return [self.ranks[piece]]
        out: list[int] = []
        edge, found, fits = self.edges.get, self.found, self.pairs.get
        state, here, last = 0, 0, [-1]  # last[here]: the token that ends there, whatever follows
        for b in piece:
            at = state << 8 | b
            state = edge(at)
            if state is None:
                state = self.move(at >> 8, b)
            here += 1
            for token, size in found[state]:
                before = last[here - size]
                fit = fits((before + 1) << 32 | token)
                if fit is None:
                    fit = self.follows(before, token)
                    fits = self.pairs.get
                if fit:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            if here >= BLOCK:
                meet = self.meeting(last, state)
                out += self.written(last, 0, meet)
                last, here = last[meet:], here - meet
        out += self.written(last, 0, here)
        return out


class _Words(dict):
    """Short piece -> its ids as bytes, filled by the transducer when a piece comes for the second time. Pieces that don't come in a whole generation are forgotten."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.old, self.seen = machine, {}, bytearray(SEEN)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8")
            ids = self.machine.encode(raw)
            ids = struct.pack(f"<{len(ids)}I", *ids)
            at = hash(raw) & SEEN - 1
            if len(piece) > LONG_PIECE or not self.seen[at]:
                self.seen[at] = 1
                return ids
        if len(self) >= MAX_WORDS:
            self.old, self.seen = dict(self), bytearray(SEEN)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    def __init__(self, rank_lines: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.words = _Words(Transducer(self.ranks))
        self.split = regex.compile(pattern)
        self.split_ascii = re.compile(ASCII_FORM[pattern]) if pattern in ASCII_FORM else self.split
        self.bytes_of = self.words.machine.bytes_of

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        split = self.split_ascii if text.isascii() else self.split
        if len(text) < 16 * BLOCK:
            return b"".join(map(self.words.__getitem__, split.findall(text)))
        found, out = split.finditer(text), []
        while block := [m.group() for m in islice(found, BLOCK)]:  # a very long text by and by
            out.append(b"".join(map(self.words.__getitem__, block)))
        return b"".join(out)

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text by and by; bytes that are no UTF-8 become U+FFFD."""
        import numpy as np

        numbers, machine = np.frombuffer(ids, "<u4"), codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(numbers), BLOCK):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, numbers[at:at + BLOCK].tolist())))
        yield machine.decode(b"", True)


_codecs: dict[tuple[int, str], Codec] = {}
CACHES.append(_codecs)


def _codec(rank_lines: bytes, pattern: str) -> Codec:
    """One machine per Python worker."""
    key = (hash(rank_lines), pattern)
    if key not in _codecs:
        _codecs.clear()
        release_memory()
        _codecs[key] = Codec(rank_lines, pattern)
    return _codecs[key]


def _with_columns(docs: DataFrame, path: str, pattern: str, fn, added: list[tuple[str, str]]):
    """What mapInArrow needs to put the added columns, made by fn from the last input column, in the place of such columns. The rank file has a fixed size and goes to the executors by broadcast."""
    with open(path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    names = {n for n, _ in added}
    passed = [c for c in docs.columns if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in passed] + [f"{n} {t}" for n, t in added])

    def rows(batches):
        import pyarrow as pa

        codec = _codec(lines.value, pattern)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                new = fn(codec, pa, part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=passed + [n for n, _ in added])

    return docs, passed, rows, schema


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and ids (binary: little-endian unsigned 32-bit integers); columns of these names are replaced.

    Null and empty texts have no tokens. Each row stands alone: repeated rows, ties and null ids pass through.
    """
    def fn(codec, pa, column):
        ids = [codec.encode(t or "") for t in column.to_pylist()]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    docs, passed, rows, schema = _with_columns(docs, path, pattern, fn, [("n_tokens", "long"), ("ids", "binary")])
    return docs.select(*passed, F.col(text).alias(free_name(docs, "text_in"))).mapInArrow(rows, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """docs with the text of their ids in decoded; null ids give null."""
    def fn(codec, pa, column):
        return [pa.array([None if x is None else "".join(codec.decode(x)) for x in column.to_pylist()], pa.string())]

    docs, passed, rows, schema = _with_columns(docs, path, pattern, fn, [("decoded", "string")])
    return docs.select(*passed, F.col(ids).cast("binary").alias(free_name(docs, "ids_in"))).mapInArrow(rows, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """encode and decode in one pass: docs with n_tokens, ids and decoded."""
    def fn(codec, pa, column):
        ids = [codec.encode(t or "") for t in column.to_pylist()]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(["".join(codec.decode(x)) for x in ids], pa.string())]

    docs, passed, rows, schema = _with_columns(docs, path, pattern, fn, [("n_tokens", "long"), ("ids", "binary"), ("decoded", "string")])
    return docs.select(*passed, F.col(text).alias(free_name(docs, "text_in"))).mapInArrow(rows, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    coded = round_trip(docs.select("doc_id", "text"), path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
