"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder over a UTF-8 state machine."""

from __future__ import annotations

import gc
import hashlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held, text_hash
from .pretokens import LONG, pieces_of, read_ranks, stretches

#: Entries of a generation of the caches of pieces and stretches; they bound the room taken, never the results.
ENTRIES = 250_000
#: States after which a worker makes them anew, and pairs of tokens; they bound the room taken, never the results.
STATES, STABLE = 250_000, 400_000


class State:
    """Live starts as (trie node, token before, ...), and the token to emit with its bytes: the last one of what was read."""

    __slots__ = ("live", "next", "size", "token")

    def __init__(self, live: tuple, token: int, size: int):
        self.live, self.token, self.size, self.next = live, token, size, {}


class Transducer:
    """Reads a pre-token byte by byte, then its states backwards; each state on that way emits one token.

    The tokens of a prefix are those of a shorter prefix and one more: the one whose pair with the token before it
    is *stable*, that is, merged by rank it stays those two. A state holds, for each start from which a vocabulary
    entry may still go on, the trie node of the bytes since then and the last token before it; at its end stands the
    last token of the prefix read, which is what it emits. The tokens before that one are the shorter prefix's, so they
    are emitted by the state that many bytes earlier. What was emitted before is in no state, so that few differ.
    States and transitions are made when first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.texts = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token: list[int] = [-1]
        inner = set()
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                inner.add(node)
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = rank
        self.inner = bytearray(len(self.token))
        for node in inner:
            self.inner[node] = 1
        self.sides: dict[int, tuple | None] = {}
        self.stable: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.restart()

    def restart(self) -> None:
        """Forget all states; the first has one start, with no token before it."""
        for state in self.states.values():
            state.next.clear()  # states may lead back to each other
        self.start = State((0, -1), -1, 0)
        self.states = {self.start.live: self.start}

    def spines(self, token: int) -> tuple | None:
        """What stands at the left and at the right end of an entry as it is merged, in order; None if it never forms."""
        if token not in self.sides:
            text, ranks = self.texts[token], self.ranks
            parts = [text[i : i + 1] for i in range(len(text))]
            left, right = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [self.texts[rank]]
                if at == 0:
                    left.append(parts[0])
                if at == len(parts) - 1:
                    right.append(parts[-1])
            self.sides[token] = (left, right) if len(parts) == 1 else None
        return self.sides[token]

    def is_stable(self, left: int, right: int) -> bool:
        """Does no merge across the border come before those that change what stands on either side of it?"""
        key = left << 20 | right
        ok = self.stable.get(key)
        if ok is None:
            if len(self.stable) > STABLE:
                self.stable.clear()
            ranks, never = self.ranks, 1 << 60
            xs, ys = self.spines(left)[1], self.spines(right)[0]
            i = j = 0
            while True:
                across = ranks.get(xs[i] + ys[j], never)
                x_next = ranks[xs[i + 1]] if i + 1 < len(xs) else never
                y_next = ranks[ys[j + 1]] if j + 1 < len(ys) else never
                if across < x_next and across <= y_next and across < never:
                    ok = False
                    break
                if x_next == y_next == never:
                    ok = True
                    break
                if x_next <= y_next:
                    i += 1
                else:
                    j += 1
            self.stable[key] = ok
        return ok

    def step(self, state: State, byte: int) -> State:
        """Make the transition."""
        live, here, child, inner, tokens = [], -1, self.child, self.inner, self.token
        pairs = iter(state.live)
        for node, last in zip(pairs, pairs, strict=True):
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if here < 0 and (token := tokens[node]) >= 0 and (token in self.sides or self.spines(token)) and self.sides[token]:
                if last < 0 or self.stable.get(last << 20 | token) or self.is_stable(last, token):
                    here = token
            if inner[node]:
                live += (node, last)
        live = (*live, 0, here)
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State(live, here, len(self.texts[here]))
        state.next[byte] = found
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self.states) > STATES:
            self.restart()
        state, passed, step = self.start, [], self.step
        for byte in piece:
            state = state.next.get(byte) or step(state, byte)
            passed.append(state)
        out, at = [], len(passed) - 1
        while at >= 0:
            state = passed[at]
            out.append(state.token)
            at -= state.size
        out.reverse()
        return tuple(out)


def _utf8_steps() -> list[bytes]:
    """For each byte, the state it leads to from each state (the index), as a table for ``bytes.translate``.

    States: 0 between characters; 1 to 3, so many continuation bytes to come; 4 to 7, a continuation byte from
    A0 on, up to 9F, from 90 on, up to 8F, then one, one, two, two more; 8, no UTF-8 (it stays there).
    """
    narrowed = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    leads = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
    table = []
    for byte in range(256):
        to = [8] * 256
        to[0] = next((state for lo, hi, state in leads if lo <= byte <= hi), 8)
        if 0x80 <= byte <= 0xBF:
            to[1:4] = 0, 1, 2
        for state, (lo, hi, rest) in narrowed.items():
            to[state] = rest if lo <= byte <= hi else 8
        table.append(bytes(to))
    return table


UTF8_STEPS = _utf8_steps()
REJECTED = 8
ALL_STATES = bytes(range(9))


def utf8_path(data: bytes) -> bytes:
    """Where ``data`` leads from each of the nine states: its bytes' steps put one after the other."""
    path = ALL_STATES
    for byte in data:
        path = path.translate(UTF8_STEPS[byte])
    return path


class Utf8Machine:
    """Incremental UTF-8: feed bytes or ids, get the bytes of whole characters; what cannot go on raises.

    Bytes move the state one by one. An id moves it by the path of its bytes, composed once a vocabulary; a run of
    ids that all lead from between characters to between characters is passed as a whole.
    """

    def __init__(self, texts: dict[int, bytes] | list[bytes] | None = None, paths: dict[int, bytes] | None = None):
        self.texts, self.paths, self.state, self.held = texts or {}, paths or {}, 0, b""
        self.cut = {i for i, path in self.paths.items() if path[0]}

    def restart(self) -> None:
        self.state, self.held = 0, b""

    def _emit(self, data: bytes) -> bytes:
        """Whole characters of what was held and ``data``; the state says whether the last one waits."""
        data = self.held + data
        end = len(data)
        if self.state:
            end -= 1
            while data[end] & 0xC0 == 0x80:
                end -= 1
        self.held = data[end:]
        return data[:end]

    def _refuse(self, data: bytes, at: int):
        raise UnicodeDecodeError("utf-8", self.held + data, len(self.held) + at, len(self.held) + at + 1, "the bytes cannot go on")

    def feed(self, data: bytes) -> str:
        for at, byte in enumerate(data):
            self.state = UTF8_STEPS[byte][self.state]
            if self.state == REJECTED:
                self._refuse(data, at)
        return self._emit(data).decode()

    def feed_ids(self, ids: list[int]) -> bytes:
        if self.state or not self.cut.isdisjoint(ids):
            state, paths = self.state, self.paths
            for i in ids:
                state = paths[i][state]
            if state == REJECTED:
                self._refuse(b"".join(map(self.texts.__getitem__, ids)), 0)
            self.state = state
        return self._emit(b"".join(map(self.texts.__getitem__, ids)))

    def close(self) -> None:
        if self.state:
            raise ValueError("the ids end inside a character")


def decode_stream(ids: list[int], machine: Utf8Machine, chunk: int = 8192):
    """UTF-8 of ids, a chunk at a time; a character cut by the chunk waits for the next."""
    machine.restart()
    for i in range(0, len(ids), chunk):
        yield machine.feed_ids(ids[i : i + chunk])
    machine.close()


class Recent(dict):
    """What ``solve`` gives for each key, of two generations: what is not asked for again while one fills is forgotten.

    A lookup of what is known is the dict's own. Keys over LONG and tuples of text are solved each time.
    """

    def __init__(self, solve, size: int):
        super().__init__()
        self.solve, self.size, self.old = solve, size, {}

    def turn(self) -> None:
        """Start a generation if this one is full."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.solve(key)
            if type(key) is tuple or len(key) > LONG:
                return found
        self[key] = found
        return found


class Codec:
    def __init__(self, path: str, entries: int = ENTRIES):
        machine = Transducer(read_ranks(path))
        # by place: every id of every text is looked up in both
        self.texts = [machine.texts.get(i, b"") for i in range(max(machine.texts, default=-1) + 1)]
        self.decoder = Utf8Machine(self.texts, {i: utf8_path(t) for i, t in machine.texts.items()})
        self.digits = [*map(str, range(len(self.texts)))]
        self.machine = machine
        self.pieces, self.known = Recent(lambda piece: machine.encode(piece.encode()), entries), Recent(self.solve, entries)

    def solve(self, stretch) -> tuple[int, ...]:
        pieces = pieces_of(stretch)
        if len(pieces) == 1:  # the stretch itself is remembered
            return self.machine.encode(pieces[0].encode())
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode_batch(self, texts: list[str]):
        for text in texts:
            self.known.turn()
            self.pieces.turn()
            yield [*chain.from_iterable(map(self.known.__getitem__, stretches(text or "")))]

    def run(self, batches, columns):
        """``columns(batch)`` for each batch; without cycle collection, as the caches hold millions of plain tuples."""
        gc.disable()
        try:
            yield from map(columns, batches)
        finally:
            gc.enable()


def codec(path: str, entries: int = ENTRIES) -> Codec:
    """One codec a worker and vocabulary."""
    return held((path, entries), lambda: Codec(path, entries))


def _encode(path: str, with_ids: bool, entries: int):
    def columns(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, entries)
        n, ids_hash, decoded_hash, ids_out = [], [], [], []
        for ids in c.encode_batch(b.column("text").to_pylist()):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(" ".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
            digest = hashlib.sha256()
            for part in decode_stream(ids, c.decoder):
                digest.update(part)
            decoded_hash.append(digest.hexdigest())
            if with_ids:
                ids_out.append(np.array(ids, np.int32))
        found = {"doc_id": b.column("doc_id"), "row": b.column("row"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(decoded_hash, pa.string())}
        if with_ids:
            found["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(found)

    return lambda batches: codec(path, entries).run(batches, columns)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, entries: int = ENTRIES) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, row, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``path`` is a rank file (default: the 50k byte-level one). Each match of the pattern is encoded alone, without
    special tokens. Null text is empty: no ids, the hash of nothing. Ids are decoded again by the streaming decoder,
    which raises on bytes that are no UTF-8. ``entries`` bounds a worker's caches, never the results. A row out for each row in; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, row long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("row"), "text").mapInArrow(_encode(path, with_ids, entries), schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).drop("row")
