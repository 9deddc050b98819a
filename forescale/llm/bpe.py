"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

A token sequence is what the merges give exactly if each neighbouring pair is what the merges give for the pair's own
bytes. So encoding is a finite-state problem: a configuration is (last token, place in the trie of tokens), and a byte
moves every configuration. Configurations that are alive together form one state of the deterministic machine; states
and their moves are made when a text first needs them. In each state exactly one configuration is complete, so a state
knows the token that ends where it stands; where the open configurations go back to the same place, the tokens before
it are emitted, which takes a lookahead of a few tokens.

Defined results: a null text counts as empty, an empty text has no tokens; repeated rows are encoded each; every other
column of the input is kept by ``encode_table``, except that clashing output names replace them.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from forescale.llm.common import pieces, resident

#: States and remembered pieces are dropped and made anew beyond these counts, which bounds a worker's memory.
MAX_STATES = 200_000
MAX_PIECES = 300_000


#: Pieces up to so many bytes are encoded side by side, so many at a time; longer ones one by one.
SIDE_BYTES = 64
SIDE_PIECES = 1 << 13
SLAB = 1 << 20  # characters of a text that are cut into pieces at once
STEP_TOKENS = 4096  # tokens that are decoded at once
BATCH_BYTES = 1 << 20  # bytes of texts whose tokens are held at once


class Moves:
    """Moves of the machine (state and byte to state) as one table of numbers that many states are looked up in at once."""

    def __init__(self) -> None:
        self.count = 0
        self.keys, self.values = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free place where it would."""
        mask = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & mask
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
            at[todo] = (at[todo] + 1) & mask
        return at

    def add(self, keys: list[int], values: list[int]) -> None:
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.values[held]
            self.keys, self.values = np.full(4 * len(self.keys), -1, np.int64), np.zeros(4 * len(self.values), np.int32)
            self._put(*old)
        self._put(np.array(keys, np.int64), np.array(values, np.int32))

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):
            at = self.places(keys)
            self.keys[at] = keys  # of those that want one free place the last gets it
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values = keys[~placed], values[~placed]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one piece of text at a time; ``ranks`` maps token bytes to rank, which is also the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}  # of a token: the two that its last merge joined
        self.step: dict[int, int] = {}  # trie: node and byte to node
        self.deeper, self.token_at = [False], [-1]
        for token, rank in ranks.items():
            parts = self.merge(token, 2)
            if len(token) == 1 or len(parts) == 2 and self.ranks.get(token) == rank:
                if len(token) > 1:
                    self.halves[rank] = parts[0], parts[1]
                node = 0
                for b in token:
                    after = self.step.get(node << 8 | b)
                    if after is None:
                        after = self.step[node << 8 | b] = len(self.deeper)
                        self.deeper[node] = True
                        self.deeper.append(False)
                        self.token_at.append(-1)
                    node = after
                self.token_at[node] = rank  # a token that its own merges never make is left out: it can't occur
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {(0,): 0}
        self.states: list[tuple[int, ...]] = [(0,)]  # configurations: last token + 1, trie node and depth in one number
        self.ends = [-1]
        self.moves: dict[int, int] = {}  # those that ``encode`` needed; ``table`` has those of ``encode_many``
        self.table = Moves()
        self.ends_of = np.full(1 << 16, -1, np.int32)  # ``ends`` as far as ``told``
        self.told = 1
        self.follows: dict[int, bool] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """The merges themselves, lowest rank first and leftmost among equals, down to ``stop`` parts; only for single tokens."""
        rank, none = self.ranks.get, 1 << 60
        cuts = list(range(len(data) + 1))
        gains = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while len(gains) >= stop and (best := min(gains)) < none:
            at = gains.index(best)
            del cuts[at + 1], gains[at]
            if at < len(gains):
                gains[at] = rank(data[cuts[at] : cuts[at + 2]], none)
            if at:
                gains[at - 1] = rank(data[cuts[at - 1] : cuts[at + 1]], none)
        return [self.ranks[data[i:j]] for i, j in zip(cuts, cuts[1:])]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges keep these two apart: undo them from the last one and look for a merge across the border."""
        bytes_of, halves, rank = self.bytes_of, self.halves, self.ranks.get
        left_until = right_until = 1 << 60  # rank of the merge that takes the part at the border in
        while True:
            across = rank(bytes_of[left] + bytes_of[right])
            if across is not None and across < left_until and across <= right_until:
                return False
            of_left, of_right = halves.get(left), halves.get(right)
            if of_left is not None and (of_right is None or left > right):
                left_until, left = left, of_left[1]
            elif of_right is not None:
                right_until, right = right, of_right[0]
            else:
                return True

    def move(self, state: int, byte: int) -> int:
        """Make the move of one state on one byte."""
        after = []
        step, token_at, deeper, follows = self.step, self.token_at, self.deeper, self.follows
        for configuration in self.states[state]:
            before = configuration >> 12 & 0xFFFFFFF
            node = step.get(before << 8 | byte)
            if node is not None:
                if deeper[node]:
                    after.append(configuration + (node - before << 12) + 1)
                token = token_at[node]
                if token >= 0:
                    last = (configuration >> 40) - 1
                    if last >= 0:
                        pair = last << 20 | token
                        fits = follows.get(pair)
                        if fits is None:
                            fits = follows[pair] = self.may_follow(last, token)
                    if last < 0 or fits:
                        ends = token
        after.append(ends + 1 << 40)  # always from the longest open token to none: equal sets are equal tuples
        key = tuple(after)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.ends.append(ends)
        return number

    def encode(self, data: bytes, ahead: int = 4096) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:  # a piece that is a token stays one, whatever its merges would give
            return [whole]
        if len(self.states) > MAX_STATES:
            self.reset()
        out: list[int] = []
        state, known, ends, size_of = 0, self.moves.get, self.ends, self.size_of
        path: list[int] = []  # the token that ends at each byte not yet emitted
        for byte in data:
            after = known(key := state << 8 | byte)
            if after is None:
                after = self.moves[key] = self.move(state, byte)
            state = after
            path.append(ends[state])
            if len(path) > ahead:
                places = {len(path) - (configuration & 0xFFF) for configuration in self.states[state]}
                while len(places) > 1:  # back to where all that is open agrees
                    latest = max(places)
                    places.remove(latest)
                    places.add(latest - size_of[path[latest - 1]])
                out += self.emitted(path, agreed := places.pop())
                del path[:agreed]
        return out + self.emitted(path, len(path))

    def moved(self, states: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The states after one byte each; moves that are missing are made."""
        keys = states.astype(np.int64) << 8 | some
        at = self.table.places(keys)
        missing = np.unique(keys[self.table.keys[at] != keys]).tolist()
        if missing:
            self.table.add(missing, [self.move(key >> 8, key & 255) for key in missing])
            at = self.table.places(keys)
            if len(self.states) > len(self.ends_of):
                self.ends_of = np.concatenate([self.ends_of, np.full(len(self.states), -1, np.int32)])
            self.ends_of[self.told : len(self.ends)] = self.ends[self.told :]
            self.told = len(self.ends)
        return self.table.values[at]

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """``encode`` of many pieces side by side: all take a byte at a time, then all go back a token at a time."""
        out: list[list[int]] = [[]] * len(pieces)
        side = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > SIDE_BYTES:
                out[i] = self.encode(piece)
            else:
                side.append(i)
        side.sort(key=lambda i: -len(pieces[i]))
        sizes = np.zeros(max(self.size_of) + 1, np.int64)
        sizes[list(self.size_of)] = list(self.size_of.values())
        for first in range(0, len(side), SIDE_PIECES):
            part = side[first : first + SIDE_PIECES]
            if len(self.states) > MAX_STATES:
                self.reset()
            lengths = np.array([len(pieces[i]) for i in part])
            bytes_ = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
            starts = np.cumsum(lengths) - lengths
            state = np.zeros(len(part), np.int32)
            path = np.zeros((lengths.max(initial=0), len(part)), np.int32)
            for at in range(len(path)):
                n = int(np.searchsorted(-lengths, -at))  # longer ones come first
                state[:n] = self.moved(state[:n], bytes_[starts[:n] + at])
                path[at, :n] = self.ends_of[state[:n]]
            rest, back, column = lengths.copy(), [], np.arange(len(part))
            while rest.any():
                token = np.where(rest > 0, path[np.maximum(rest, 1) - 1, column], -1)
                back.append(token)
                rest = np.maximum(rest - sizes[token], 0)
            counts = (np.stack(back) >= 0).sum(0).tolist() if back else [0] * len(part)
            for i, n, tokens in zip(part, counts, np.stack(back[::-1], 1).tolist() if back else counts):
                out[i] = tokens[-n:] if n else []
        return out

    def emitted(self, path: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(path[at - 1])
            at -= self.size_of[path[at - 1]]
        return out[::-1]


# UTF-8 as a state machine: pending bytes of an unfinished character -> how many more it needs, and which may come next.
def _after_lead(byte: int) -> tuple[int, int, int] | None:
    """More bytes needed and the range of the next one, or None for a byte that starts no character."""
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class Utf8Machine:
    """Incremental UTF-8: feed bytes in any cuts, get text as soon as characters are complete; bad bytes become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        view, at = memoryview(data), 0
        while at < len(data):
            if self.need:  # the rest of a character that was begun
                end = at + self.need
                out.append(self._bytewise(view[at:end]))
                at = end
                continue
            try:  # complete characters only: the state stays the same
                out.append(codecs.utf_8_decode(view[at:], "strict", True)[0])
                break
            except UnicodeDecodeError as stop:
                end = at + stop.start
                out.append(codecs.utf_8_decode(view[at:end], "strict", True)[0])
                out.append(self._bytewise(view[end : end + 1]))
                at = end + 1
        return "".join(out)

    def _bytewise(self, data: Iterable[int]) -> str:
        out: list[str] = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.held += bytes([byte])
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode("utf-8"))
                        self.held = b""
                    continue
                out.append("�")
                self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif lead := _after_lead(byte):
                self.need, self.low, self.high = lead
                self.held = bytes([byte])
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.need else ""
        self.__init__()
        return rest


class Codec:
    """Encoder and decoder of one vocabulary file; ``pattern`` cuts a text into pieces that are encoded separately.

    ``pattern`` must end a piece before a space that stands between two other characters than white space, as the
    patterns of byte-level vocabularies do: long texts are cut there first. Pieces are remembered with their tokens,
    and with the same in decimal digits if ``decimal``; else digits are empty.
    """

    def __init__(self, path: str, pattern: str, decimal: bool = False):
        self.machine = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.border = regex.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}  # the ids of a piece, four bytes each
        self.digits: dict[str, str] = {}  # the same in decimal digits with commas
        self.decimal = {rank: str(rank) for rank in self.machine.bytes_of} if decimal else {}

    def slabs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, of about ``SLAB`` characters at once."""
        at = 0
        while at < len(text):
            cut = self.border.search(text, at + SLAB) if len(text) - at > SLAB else None
            end = cut.start() if cut else len(text)
            yield self.pattern.findall(text, at, end)
            at = end

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet."""
        if len(self.known) + len(pieces) > MAX_PIECES:
            self.known.clear()
            self.digits.clear()
        new = list(pieces - self.known.keys())
        found = self.machine.encode_many([p.encode("utf-8") for p in new])
        self.known.update(zip(new, [array("i", ids).tobytes() for ids in found]))
        if self.decimal:
            decimal = self.decimal.__getitem__
            self.digits.update(zip(new, [",".join(map(decimal, ids)) for ids in found]))

    def joined(self, pieces: list[str]) -> tuple[array, str]:
        digits = ",".join(map(self.digits.__getitem__, pieces)) if self.decimal else ""
        return array("i", b"".join(map(self.known.__getitem__, pieces))), digits

    def encoded(self, texts: list[str]) -> Iterator[tuple[array, str]]:
        """Token ids of each text, and the same in decimal digits with commas; texts up to ``SLAB`` characters learn together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLAB):
                size += len(texts[end])
                end += 1
            if end == at + 1:
                ids, digits = array("i"), []
                for pieces in self.slabs(texts[at]):
                    self.learn(set(pieces))
                    some, text = self.joined(pieces)
                    ids.extend(some)
                    digits.append(text)
                yield ids, ",".join(digits) if self.decimal else ""
            else:
                cut = [self.pattern.findall(t) for t in texts[at:end]]
                self.learn(set().union(*cut))
                yield from map(self.joined, cut)
            at = end

    def encode(self, text: str) -> array:
        return next(self.encoded([text]))[0]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.machine.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], step: int = 1) -> Iterator[str]:
        """Text as the tokens come in, ``step`` at a time; a character that tokens share appears with its last byte."""
        utf8, bytes_of = Utf8Machine(), self.machine.bytes_of.__getitem__
        ids = iter(ids)
        while some := list(islice(ids, step)):
            yield utf8.feed(b"".join(map(bytes_of, some)))
        yield utf8.finish()


def codec(path: str, pattern: str, decimal: bool = False) -> Codec:
    """One codec per worker, so that states are made once."""
    return resident((path, pattern, decimal), lambda: Codec(path, pattern, decimal))


def encode_table(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``df``, then ``ids array<int>`` of the text and ``decoded string`` read back from the ids."""
    kept = [f for f in df.schema.fields if f.name not in ("ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in pieces(batches, text, BATCH_BYTES):
            ids = [i for i, _ in own.encoded([t or "" for t in batch.column(text).to_pylist()])]
            back = ["".join(own.decode_stream(i, STEP_TOKENS)) for i in ids]
            offsets = [0]
            flat = array("i")
            for i in ids:
                flat += i
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), lists, pa.array(back, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's encoding and of its decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, decimal=True)
        for batch in pieces(batches, "text", BATCH_BYTES):
            counts, of_ids, of_bytes = [], [], []
            for ids, digits in own.encoded([t or "" for t in batch.column("text").to_pylist()]):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(digits.encode()).hexdigest())
                decoded = hashlib.sha256()
                for part in own.decode_stream(ids, STEP_TOKENS):
                    decoded.update(part.encode())
                of_bytes.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
