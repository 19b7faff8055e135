"""Token ids in Simple-8b files: words of 64 bits whose selector says how many ids they pack, blocks that start on a word."""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_folder, table, text_hash, text_of
from .pretokens import LONG, Generations
from .tokencount import byte_letters

#: Ids that a word packs, and the bits of each, by selector (the upper four bits). Selector 1 is the escape: the word
#: stands for one id of over 60 bits, and its lower bits are that id's place in the block's list of escaped ids.
PACKS = [(240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS, WIDTHS = np.array([n for n, _ in PACKS]), np.array([w for _, w in PACKS])
ESCAPE = 1
OF_COUNT = np.zeros(241, np.uint8)
OF_COUNT[COUNTS[2:]] = np.arange(2, 16)
SHORT_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
#: Ids of a block, which can be decoded alone, and ids after which a segment (a row of a file) is closed.
BLOCK, SEGMENT = 4096, 1 << 18
#: Stretches of text of a generation of a worker's cache; it bounds the room taken, never the results.
CACHE = 250_000
#: Words of plain texts that a worker's arrays hold from one batch to the next.
NUMBERED = 400_000
#: The tokenizers whose texts may be cut at spaces: how they normalise, and the pieces that they keep.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space of ASCII, and the letters, numbers and signs of Latin that print and have a lower case of one letter (U+0130
#: has not); in texts of these alone the pieces are these classes.
_SPACE, _PRINTS = r"\t\n\x0b\x0c\r ", [chr(c) for c in (*range(33, 127), *range(0xA1, 0x130), *range(0x131, 0x17F))]
_LETTERS, _NUMBERS = ("".join(c for c in _PRINTS if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}"))
_pieces = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_NUMBERS}]").findall
_odd = re.compile(f"[^{_SPACE}!-~\u00a1-\u012f\u0131-\u017e]").search
SEGMENTS = "part int, segment int, first long, doc_ids array<long>, ends array<long>, blocks array<int>, words binary, escaped binary"


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each of unsigned ``ids``."""
    most = ids.max(initial=0)
    if most < 1 << 16:
        return SHORT_BITS[ids.astype(np.uint16)]
    bits = np.frexp(ids.astype(np.float64))[1]
    if most >= 1 << 53:  # a double may round up to the next power
        upper = ids >> np.uint64(32)
        bits = np.where(upper > 0, np.frexp(upper.astype(np.float64))[1] + 32, bits)
    return bits.astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block of BLOCK ids, and the escaped ids, of unsigned ``ids``.

    Every place learns the most ids that a word starting there can take, from window maxima of bit lengths, each window
    made of two of the one before. Then a walk from word to word picks the places where words start. A block's last word
    is filled up with zeros, which the number of ids tells apart.
    """
    ids = np.asarray(ids, np.uint64)
    rows, room = -(-len(ids) // BLOCK), BLOCK + COUNTS.max()
    laid, padded = np.zeros((rows, room), np.uint64), np.zeros(rows * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    laid[:, :BLOCK] = padded.reshape(rows, BLOCK)
    flat = laid.ravel()
    bits = bit_lengths(flat)
    step = np.ones(len(flat), np.uint8)
    window, wide = bits.copy(), 1
    for n, w in sorted(p for p in PACKS if p[0] > 1):
        while wide < n:  # the window of each place grows by the one that starts where it ends, or earlier
            more = min(n, 2 * wide) - wide
            np.maximum(window[:-more], window[more:], out=window[:-more])
            wide += more
        np.copyto(step, n, where=window <= w)
    steps, starts, blocks = step.tobytes(), [], []
    for row in range(rows):
        i = row * room
        end = i + min(BLOCK, len(ids) - row * BLOCK)
        blocks.append(len(starts))
        while i < end:
            starts.append(i)
            i += steps[i]
    at = np.array(starts, np.int64)
    chosen = np.where(bits[at] > 60, ESCAPE, OF_COUNT[step[at]])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for code in np.unique(chosen):
        n, w = PACKS[code]
        here = np.flatnonzero(chosen == code)
        if code == ESCAPE:
            words[here] |= np.arange(len(here), dtype=np.uint64)
        elif w:
            values = flat[at[here][:, None] + np.arange(n)] << (np.arange(n) * w).astype(np.uint64)
            words[here] |= np.bitwise_or.reduce(values, axis=1)
    return words, np.array(blocks, np.int32), flat[at[chosen == ESCAPE]]


def unpack(words: np.ndarray, blocks: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of words: all words of one selector are shifted apart at once and laid where their offsets say."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.searchsorted(blocks, np.arange(len(words)), side="right") - 1
    place = block * BLOCK + before - before[blocks][block] if len(words) else before
    room = len(blocks) * BLOCK
    out = np.zeros(room + COUNTS.max(), np.uint64)
    for code in np.unique(selector):
        count, width = PACKS[code]
        here = np.flatnonzero(selector == code)
        if code == ESCAPE:
            out[place[here]] = escaped[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif width:
            shift = (np.arange(count) * width).astype(np.uint64)
            values = (words[here][:, None] >> shift) & np.uint64((1 << width) - 1)
            to = place[here][:, None] + np.arange(count)
            inside = to < (block[here][:, None] + 1) * BLOCK
            out[to[inside]] = values[inside]
    return out[:n]


def unpack_range(words: np.ndarray, blocks: np.ndarray, escaped: np.ndarray, n: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment of ``n``: only the blocks that hold them are decoded."""
    low, high = start // BLOCK, -(-stop // BLOCK)
    ends = np.append(blocks, len(words))
    part = unpack(words[ends[low] : ends[high]], blocks[low:high] - ends[low], escaped, min(n, high * BLOCK) - low * BLOCK)
    return part[start - low * BLOCK : stop - low * BLOCK]


def plain_text(text: str) -> bool:
    """Whether ``text`` has plain Latin and ASCII white space alone, and nothing that could be a special string."""
    return not _odd(text) and "<|" not in text


class Numbered:
    """A cache of the ids of words as arrays: Arrow numbers the words, ``solve(list of new words)`` gives the bytes of their
    uint32 ids, and a word's ids are ``counts`` of ``ids`` from ``starts`` on."""

    def __init__(self, solve, size: int):
        self.solve, self.size = solve, size
        self.keep(None)

    def keep(self, some: np.ndarray | None) -> None:
        """Forgets all but ``some`` of the words."""
        if some is None:
            self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
            self.counts = self.starts = np.zeros(0, np.int64)
        else:
            counts = self.counts[some]
            starts = np.cumsum(counts) - counts
            self.ids = self.ids[np.repeat(self.starts[some] - starts, counts) + np.arange(counts.sum())]
            self.words, self.counts, self.starts = self.words.filter(pa.array(some)), counts, starts
        self.again = np.zeros(len(self.words), bool)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of ``words``; it holds until ``bound``."""
        had = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()
        self.words, number = coded.dictionary, coded.indices.to_numpy()[had:]
        found = self.solve(self.words[had:].to_pylist())
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        self.again = np.concatenate([self.again, np.zeros(len(found), bool)])
        self.again[number[number < had]] = True
        return number

    def bound(self) -> None:
        """Words of over LONG bytes go; above ``size`` words those that were asked for again stay, if they are half of it at most."""
        short = pc.binary_length(self.words).to_numpy() <= LONG
        if len(short) > self.size:
            stay = short & self.again
            self.keep(stay if stay.sum() <= self.size // 2 else None)
        elif not short.all():
            again = self.again[short]
            self.keep(short)
            self.again = again


class Encoder:
    """Ids of whole texts, as the ``tokenizers`` library gives them, stretch by stretch where that is the same.

    A tokenizer that keeps only matches of PIECES, after NFC and lower case, never looks across white space. A text of
    plain Latin letters, which NFC leaves alone and which lower case maps one by one, is cut at white space here; Arrow
    numbers the different stretches of many texts, so each is looked up once. New ones are cut into pieces, and the
    library's model is asked for pieces that no cache knows. Of other texts the stretches between spaces and line feeds
    are cached: plain ones are cut likewise, the rest, and whole texts of other tokenizers, go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuts = drops_space(spec)
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.known, self.pieces, self.plain = Generations(CACHE), Generations(CACHE), Numbered(self.of_words, NUMBERED)

    def piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def joined(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces."""
        new = self.pieces.missing(set(chain.from_iterable(parts)))
        pieces = self.pieces.young
        pieces.update((p, self.piece(p)) for p in new)
        out = [b"".join(map(pieces.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > LONG:
                del pieces[p]
        return out

    def by_stretch(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.replace("\n", " ").split(" ") if self.cuts else [t] for t in texts]
        new = self.known.missing(set(chain.from_iterable(parts)))
        known = self.known.young
        plain = [s for s in new if self.cuts and plain_text(s)]
        known.update(zip(plain, self.joined([_pieces(s.lower()) for s in plain]), strict=True))
        other = [s for s in new if s not in known]
        found = self.library.encode_batch_fast(other, add_special_tokens=False)
        known.update((s, array("I", e.ids).tobytes()) for s, e in zip(other, found, strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), np.uint32) for p in parts]
        for s in new:
            if len(s) > LONG:
                del known[s]
        return out

    def by_number(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts, laid out by the numbers that their stretches have."""
        words = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        number = self.plain.numbers(words.flatten())
        count, at = self.plain.counts[number], self.plain.starts[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.plain.ids[np.repeat(at - ends[:-1], count) + np.arange(ends[-1])]
        self.plain.bound()
        return np.split(ids, ends[words.offsets.to_numpy()[1:-1]]) if texts else []

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each of different plain words in lower case; what is no single piece goes through the cache of pieces."""
        parts = list(map(_pieces, words))
        several = iter(self.joined([p for p in parts if len(p) > 1]))
        return [next(several) if len(p) > 1 else self.piece(p[0]) if p else b"" for p in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [self.cuts and plain_text(t) for t in texts]
        cut = iter(self.by_number([t for t, p in zip(texts, plain, strict=True) if p]))
        rest = iter(self.by_stretch([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(cut) if p else next(rest) for p in plain]


def drops_space(spec: dict) -> bool:
    """Whether a tokenizer file is one of NFC, white space to one space and lower case, and keeps only matches of PIECES."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut = steps[0]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMAL
        and (cut.get("type"), cut.get("behavior"), cut.get("invert"), cut.get("pattern")) == ("Split", "Removed", True, {"Regex": PIECES})
        and [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in steps[1:]] == [("ByteLevel", False, False)]
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    )


_encoders: dict[str, Encoder] = {}


def _segments(path: str, end_id: int | None):
    """mapInArrow over the sorted documents of a part: its segments, each of whole documents."""

    def close(part, segment, first, docs, counts, ids):
        words, blocks, escaped = pack(np.concatenate(ids))
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "first": pa.array([first], pa.int64()),
            "doc_ids": pa.array([docs], pa.list_(pa.int64())), "ends": pa.array([np.cumsum(counts)], pa.list_(pa.int64())), "blocks": pa.array([blocks], pa.list_(pa.int32())),
            "words": pa.array([words.astype("<u8").tobytes()], pa.binary()), "escaped": pa.array([escaped.astype("<u8").tobytes()], pa.binary()),
        })

    def run(batches):
        gc.disable()  # the cache holds many plain objects and no cycles
        try:
            if path not in _encoders:
                _encoders[path] = Encoder(path)
            part, segment, first, held = TaskContext.get().partitionId(), 0, 0, 0
            docs, counts, ids = [], [], []
            for b in batches:
                texts, names = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
                for s in range(0, len(texts), 2048):
                    for name, piece in zip(names[s : s + 2048], _encoders[path].encode(texts[s : s + 2048]), strict=True):
                        piece = piece if end_id is None else np.append(piece, np.uint32(end_id))
                        docs.append(name)
                        counts.append(len(piece))
                        ids.append(piece)
                        held += len(piece)
                        if held >= SEGMENT:
                            yield close(part, segment, first, docs, counts, ids)
                            segment, first, held, docs, counts, ids = segment + 1, first + held, 0, [], [], []
            if docs:
                yield close(part, segment, first, docs, counts, ids)
        finally:
            gc.enable()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` with a ``tokenizers`` file into ``path``, in ascending doc_id order.

    ``path/segments`` is a Parquet table whose rows are segments of whole documents; parts and, in them, segments follow
    the order of doc_id (null last; rows of one doc_id by the hash of their text). ``path/parts`` has how many ids lie
    before each part. No special tokens are added but ``end_id`` after each document; special strings inside texts are
    what the library makes of them. Null text is empty. A row of the input is a document each; other columns are ignored.

    Texts are dealt by ranges of doc_id with the row's number last, so one doc_id's many rows are spread; a part is one
    task, which holds a segment at a time, and a document of any length is one segment at most.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"), F.col("salt")]
    dealt = rows.select("doc_id", "text", text_hash().alias("row"), F.monotonically_increasing_id().alias("salt")).repartitionByRange(*order)
    segments = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_segments(tokenizer, end_id), SEGMENTS)
    segments.write.option("compression", "zstd").parquet(f"{path}/segments")
    sizes = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n")).orderBy("part").collect()
    before, parts = 0, []
    for r in sizes:  # a row a part, as many as the shuffle has partitions
        parts.append((r.part, before))
        before += r.n
    spark.createDataFrame(parts, "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def _documents(digest: bool):
    """mapInArrow: the documents of segments, with their ids or a checksum of them."""

    def run(batches):
        for b in batches:
            for row in range(len(b)):
                doc_ids, ends = b.column("doc_ids")[row].values, b.column("ends")[row].values.to_numpy()
                words, escaped = (np.frombuffer(b.column(c)[row].as_buffer(), "<u8") for c in ("words", "escaped"))
                ids = unpack(words, b.column("blocks")[row].values.to_numpy(), escaped, int(ends[-1]))
                starts = np.concatenate([[0], ends[:-1]])
                out = {"doc_id": doc_ids, "start": pa.array(starts + b.column("start")[row].as_py()), "n_tokens": pa.array(ends - starts)}
                if digest:
                    raw = ids.astype("<u4")
                    out["ids_crc32"] = pa.array([zlib.crc32(raw[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    out["ids"] = pa.LargeListArray.from_arrays(np.append(starts, ends[-1]), ids.astype(np.int64)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of ``write_tokens``: doc_id, start (ids of all documents before it), n_tokens and ``ids``, or, with
    ``digest``, ids_crc32: the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers (64 bits wrap)."""
    bounded_batches(spark)
    parts = spark.read.parquet(f"{path}/parts")
    segments = spark.read.parquet(f"{path}/segments").join(F.broadcast(parts), "part")
    last = "ids_crc32 long" if digest else "ids array<long>"
    columns = ["doc_ids", "ends", "blocks", "words", "escaped", (F.col("before") + F.col("first")).alias("start")]
    return segments.select(*columns).mapInArrow(_documents(digest), f"doc_id long, start long, n_tokens long, {last}")


def op12(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path, digest=True)
