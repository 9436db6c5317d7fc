"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

The nondeterministic transducer reads bytes down a trie of the vocabulary and, at a token's end,
may return to the root and emit that token, provided the token before it and this one are
compatible: merging the two tokens' joined bytes must give back just these two. Of the paths over
a whole pretoken exactly one survives, and it is what applying the merges by rank gives. Subset
construction runs on demand: a state is the set of live paths, each the token before it and its
place in the trie, and a transition emits the token that ends there if the pretoken does. The ids
are read back from the last byte; in long pretokens those on which all live paths agree leave
early, as no continuation can undo them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from array import array
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import cached, map_rows

#: Bounds on cached work. Full caches of pairs and words become the old generation, from which what is
#: asked for again moves back; a full table of states is emptied, but for the state at hand.
MOST_STATES, MOST_PAIRS, MOST_WORDS = 200_000, 100_000, 200_000
DECODE_STEP = 4096
#: Texts of so many characters are split piece by piece.
LONG = 1_000_000
#: Bytes of a pretoken after which tokens that are settled leave.
SETTLE_STEP = 4096


class Transducer:
    ROOT, NONE = 0, -1

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {v: k for k, v in ranks.items()}
        self.edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        inner, depths = set(), [0]
        for token, rank in ranks.items():
            at = self.ROOT
            for byte in token:
                inner.add(at)
                key = at << 8 | byte
                to = self.edges.get(key)
                if to is None:
                    to = self.edges[key] = len(depths)
                    depths.append(depths[at] + 1)
                at = to
            ends[at] = rank
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary needs every single byte as a token")
        self.depths = depths
        self.inner = [node in inner for node in range(len(depths))]
        self.ends = [ends.get(node, self.NONE) for node in range(len(depths))]
        #: Above all ranks.
        self.never = max(self.tokens) + 1
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(self.never)]
        #: A path is the token before it and its node in one integer; a state its number and the token that ends there.
        self.bits, self.token_bits = len(depths).bit_length(), self.never.bit_length()
        self.nodes, self.tail = (1 << self.bits) - 1, (1 << self.token_bits) - 1
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        start = (self.NONE << self.bits | self.ROOT,)
        self.sets: list[tuple[int, ...]] = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, int] = {}

    def merged(self, data: bytes, cut: int = 0) -> list[bytes] | None:
        """``data`` merged by rank, lowest first, leftmost first; None once a merge spans byte ``cut``."""
        get, never = self.ranks.get, self.never
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
        while order and (best := min(order)) < never:
            at = order.index(best)
            if at + 1 == cut:
                return None
            if at + 1 < cut:
                cut -= 1
            whole = parts[at] + parts.pop(at + 1)
            parts[at] = whole
            del order[at]
            if at:
                order[at - 1] = get(parts[at - 1] + whole, never)
            if at < len(order):
                order[at] = get(whole + parts[at + 1], never)
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge ends the merging of a token's own bytes; a single byte is its own half.

        None if merging does not give the token, a pair of NONE if some merge follows one of higher rank.
        """
        known = self.splits.get(token, ())
        if known == ():
            get, never = self.ranks.get, self.never
            data, known, highest = self.tokens[token], (token, token), -1
            parts = [data[i : i + 1] for i in range(len(data))]
            order = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
            while order and (best := min(order)) < never:
                at = order.index(best)
                known = self.ranks[parts[at]], self.ranks[parts[at + 1]]
                highest = best if best >= highest else never
                whole = parts[at] + parts.pop(at + 1)
                parts[at] = whole
                del order[at]
                if at:
                    order[at - 1] = get(parts[at - 1] + whole, never)
                if at < len(order):
                    order[at] = get(whole + parts[at + 1], never)
            if order:
                known = None
            elif highest == never:
                known = self.NONE, self.NONE
            self.splits[token] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        return self.split(token) is not None

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge spans the joint of two tokens.

        Their merges are undone, the latest first (of equal ones the right one), down to the single bytes
        at the joint. A merge of what meets there comes first if its rank is lower than that of the merge
        undone last, or equal to it and further left.
        """
        if self.NONE in (self.split(left) or ()) or self.NONE in (self.split(right) or ()):
            return self.merged(self.tokens[left] + self.tokens[right], len(self.tokens[left])) is not None
        tokens, get, splits = self.tokens, self.ranks.get, self.split
        limit = never = self.never
        while True:
            if get(tokens[left] + tokens[right], never) < limit:
                return False
            on_left = left > right
            if on_left and (half := splits(left)[1]) == left or not on_left and (half := splits(right)[0]) == right:
                on_left = not on_left  # a single byte: only the other side has merges left
                half = splits(left)[1] if on_left else splits(right)[0]
                if half == (left if on_left else right):
                    return True
            if on_left:
                limit, left = left, half
            else:
                limit, right = right + 1, half

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs, self.old_pairs = {}, self.pairs
            known = self.old_pairs.get(key)
            if known is None:
                known = self.apart(left, right)
            self.pairs[key] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """Determinises one transition: the state after ``byte``.

        Paths stand in the order of where their open tokens begin. Of those that end a token here
        exactly one is right, so the last one left needs no test.
        """
        paths: list[int] = []
        get, inner, ends, bits, nodes = self.edges.get, self.inner, self.ends, self.bits, self.nodes
        settled = token = self.NONE
        for path in self.sets[state >> self.token_bits]:
            node = path & nodes
            to = get(node << 8 | byte)
            if to is not None:
                if inner[to]:
                    paths.append(path - node + to)
                end = ends[to]
                if settled < 0 <= end and self.reachable(end):
                    if token >= 0 and (left < 0 or self.compatible(left, token)):
                        settled = token
                    left, token = path >> bits, end
        if settled >= 0:
            token = settled
        paths.append(token << bits | self.ROOT)
        to = self.moves[state << 8 | byte] = self.number(tuple(paths)) | token
        return to

    def number(self, key: tuple[int, ...]) -> int:
        known = self.numbers.get(key)
        if known is None:
            known = self.numbers[key] = len(self.sets) << self.token_bits
            self.sets.append(key)
        return known

    def settled(self, walked: list[int]) -> int:
        """How many of the bytes that led to these states hold tokens which all live paths share."""
        starts = {len(walked) - self.depths[path & self.nodes] for path in self.sets[walked[-1] >> self.token_bits]}
        while len(starts) > 1:
            at = max(starts)
            starts.remove(at)
            starts.add(at - self.sizes[walked[at - 1] & self.tail])
        return starts.pop()

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pretoken. A piece that is a token itself is that token."""
        token = self.ranks.get(piece)
        if token is not None and not self.reachable(token):
            return [token]
        out: list[int] = []
        walked: list[int] = []
        state, get, sizes, tail = 0, self.moves.get, self.sizes, self.tail
        for begin in range(0, len(piece), SETTLE_STEP):
            for byte in piece[begin : begin + SETTLE_STEP]:
                to = get(state << 8 | byte)
                if to is None:
                    if len(self.sets) >= MOST_STATES:
                        here = self.sets[state >> self.token_bits]
                        self.forget()
                        state, get = self.number(here) | state & tail, self.moves.get
                    to = self.step(state, byte)
                state = to
                walked.append(state)
            end = at = len(walked) if begin + SETTLE_STEP >= len(piece) else self.settled(walked)
            ids = []
            while at:
                token = walked[at - 1] & tail
                ids.append(token)
                at -= sizes[token]
            ids.reverse()
            out += ids
            del walked[:end]
        return out


class Utf8Machine:
    """Bytes in pieces to text in pieces; a character cut at a piece's end waits for its rest.

    Bytes that are not UTF-8 become U+FFFD, as in a decode of the whole.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that could still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the first continuation byte has a narrower range after some leads
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        tail = self.open_tail(data)
        self.held = data[len(data) - tail :]
        return data[: len(data) - tail].decode("utf-8", "replace")

    def close(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Words(dict):
    """Ids of pretokens as bytes; a missing one is encoded on demand."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(33)]

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = self.encode(word.encode("utf-8", "replace"))
            packed = self.packs[len(ids)](*ids) if len(ids) < 33 else struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= MOST_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encoding and decoding by a rank file and a pretoken pattern; texts of any length."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.words = Words(self.transducer.encode)
        self.bytes_of = [self.transducer.tokens.get(i, b"") for i in range(max(self.transducer.tokens) + 1)]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for null or empty text."""
        found = self.pattern.findall(text or "") if len(text or "") < LONG else (m.group() for m in self.pattern.finditer(text))
        return b"".join(map(self.words.__getitem__, found))

    def pieces(self, ids: Sequence[int]) -> Iterator[bytes]:
        get = self.bytes_of.__getitem__
        for at in range(0, len(ids), DECODE_STEP):
            yield b"".join(map(get, ids[at : at + DECODE_STEP]))

    def decode(self, ids: Sequence[int]) -> Iterator[str]:
        """Text in pieces, as it becomes certain."""
        machine = Utf8Machine()
        for piece in self.pieces(ids):
            yield machine.feed(piece)
        yield machine.close()


@cached
@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker: later tasks find its caches filled."""
    return Codec(path, pattern)


def unpack(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    return out


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (array of int). A null text has no ids."""

    def start():
        c = codec(path, pattern)
        return lambda texts: [[list(unpack(c.encode(t))) for t in texts]]

    return map_rows(df, [text], [T.StructField("token_ids", T.ArrayType(T.IntegerType()))], start)


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded`` text. Null ids give an empty text."""

    def start():
        c = codec(path, pattern)
        return lambda rows: [["".join(c.decode(x or ())) for x in rows]]

    return map_rows(df, [ids], [T.StructField("decoded", T.StringType())], start)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256, decoded_sha256 and exact (the decoded text is the text).

    Null texts count as empty: no ids, digests of nothing. Every row is kept, repeated ones too,
    and every column but those of these names, which are replaced.
    """

    def one(c: Codec, value: str | None):
        ids = c.encode(value)
        digest, machine, same, at = hashlib.sha256(), Utf8Machine(), True, 0
        for piece in c.pieces(unpack(ids)):
            digest.update(piece)
            said = machine.feed(piece)
            same = same and (value or "").startswith(said, at)
            at += len(said)
        same = same and not machine.held and at == len(value or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest.hexdigest(), same

    def start():
        c = codec(path, pattern)
        return lambda texts: [list(x) for x in zip(*[one(c, t) for t in texts], strict=True)] if texts else [[], [], [], []]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]
    return map_rows(df, [text], fields, start)
