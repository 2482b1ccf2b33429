"""Token ids in files of Simple-8b words.

A file is a sequence of frames, each followed by one byte 0x0A. A frame holds
whole documents in ascending id order:

    header   "S8B1", part, sequence, documents, ids, blocks, words, escapes (little-endian, 4 + 7 x 8 bytes)
    docs     id (int64), 1 if the id is null (uint8), number of ids (uint64), each as one array
    blocks   index of each block's first word (uint64); a block is 1,024 ids, the last one fewer
    words    64-bit words

A word's top four bits select how many ids its low 60 bits hold, first id
lowest. Selector 1 is an escape: the next word is one value of 61 to 64 bits.
A block's last word may have room to spare. Blocks are independent, so words
are cut and read for all blocks at once with numpy.

The frames are made in tasks that hold a range of the document ids and are
written by Spark's own writer, so a lost executor or a repeated task leaves no
half file, and any store that Spark reaches can hold them. A frame has about
``FRAME_IDS`` ids (or one longer document), a file ``FRAMES_PER_FILE`` frames.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import word_hashes, small_batches, written

#: Selector -> (ids in the word, bits each); 0 is a run of zeros, 1 the escape.
PACK = {0: (240, 0), 1: (1, 64), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6),
        8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
BLOCK, PAD = 1024, 240
FRAME_IDS, FRAMES_PER_FILE = 1 << 20, 8
HEADER = struct.Struct("<4s7Q")
_COUNT = np.array([PACK[s][0] for s in range(16)])
_BITS = np.array([n.bit_length() for n in range(1 << 16)], dtype=np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or int(ids.max()) < 1 << 16:
        return _BITS[ids]
    out, rest = np.zeros(len(ids), np.uint8), ids.copy()
    while rest.any():
        high = rest >> np.uint64(16) != 0
        out += np.where(high, np.uint8(16), _BITS[rest & np.uint64(0xFFFF)])
        rest = np.where(high, rest >> np.uint64(16), np.uint64(0))
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(words, first word of each block, escapes)`` of an array of unsigned 64-bit ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    wide = BLOCK + PAD
    values = np.zeros((blocks, wide), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    values[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = bit_lengths(values.ravel()).reshape(blocks, wide)
    # the largest number of ids that fits from each place on: running maxima of the next 1, 2, 3 ... ids
    select = np.where(bits[:, :BLOCK] > 60, 1, 15).astype(np.uint8)
    most, held = bits, 1
    for count, width, s in sorted((c, w, s) for s, (c, w) in PACK.items() if c > 1):
        while held < count:
            k = min(held, count - held)
            most = np.maximum(most[:, :-k], most[:, k:])
            held += k
        fits = most[:, :BLOCK] <= width
        if not fits[:, :max(1, BLOCK - count)].any():
            break  # nor do more ids fit in fewer bits (but for the end of a block, where zeros follow)
        np.copyto(select, np.uint8(s), where=fits)
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - (blocks - 1) * BLOCK
    at, active, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(active):
        places = active * wide + at[active]
        chosen = select[active, at[active]]
        found.append((places, chosen))
        at[active] += _COUNT[chosen]
        active = active[at[active] < sizes[active]]
    places, chosen = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(places)
    places, chosen = places[order], chosen[order]
    escapes = chosen == 1
    slot = np.arange(len(places)) + np.cumsum(escapes) - escapes  # an escape takes two words
    words = np.zeros(len(places) + int(escapes.sum()), np.uint64)
    all_values = values.ravel()
    for s, (count, width) in PACK.items():
        mine = np.flatnonzero(chosen == s)
        if s == 1:
            words[slot[mine]] = np.uint64(1) << np.uint64(60)
            words[slot[mine] + 1] = all_values[places[mine]]
        elif len(mine):
            w = np.full(len(mine), s, np.uint64) << np.uint64(60)
            for j in range(count if width else 0):
                w |= all_values[places[mine] + j] << np.uint64(j * width)
            words[slot[mine]] = w
    first = slot[np.searchsorted(places, np.arange(blocks) * wide)]
    return words, first.astype(np.uint64), int(escapes.sum())


def unpack(words: np.ndarray, first: np.ndarray, n: int, escapes: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    select = (words >> np.uint64(60)).astype(np.int64)
    heads = np.arange(len(words))
    if escapes:
        raw, before = np.zeros(len(words), bool), -2
        for i in np.flatnonzero(select == 1):  # a raw word can look like an escape
            if i != before + 1:
                raw[i + 1], before = True, i
        heads = np.flatnonzero(~raw)
        select = select[heads]
    counts = _COUNT[select]
    begins = np.cumsum(counts) - counts
    block = np.searchsorted(first, heads.astype(np.uint64), side="right") - 1
    first_head = np.searchsorted(heads, first.astype(np.int64))
    wide = BLOCK + PAD
    places = block * wide + begins - begins[first_head][block]
    out = np.zeros(len(first) * wide, np.uint64)
    for s, (count, width) in PACK.items():
        mine = np.flatnonzero(select == s)
        if s == 1:
            out[places[mine]] = words[heads[mine] + 1]
        elif width and len(mine):
            mask, w = np.uint64((1 << width) - 1), words[heads[mine]]
            for j in range(count):
                out[places[mine] + j] = (w >> np.uint64(j * width)) & mask
    return out.reshape(len(first), wide)[:, :BLOCK].ravel()[:n]


def frame(part: int, seq: int, doc_ids, lengths, ids: np.ndarray) -> bytes:
    words, first, escapes = pack(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEADER.pack(b"S8B1", part, seq, len(doc_ids), len(ids), len(first), len(words), escapes),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.asarray(lengths, "<u8").tobytes(),
                     first.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def frames(content: bytes):
    """``(part, sequence, document ids, lengths, ids)`` of each frame of a file."""
    at = 0
    while at < len(content):
        magic, part, seq, docs, n, blocks, n_words, escapes = HEADER.unpack_from(content, at)
        if magic != b"S8B1":
            raise ValueError(f"no frame at byte {at}")
        at += HEADER.size
        arrays = []
        for kind, k in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks), ("<u8", n_words)):
            arrays.append(np.frombuffer(content, kind, k, at))
            at += k * np.dtype(kind).itemsize
        if content[at:at + 1] != b"\n":
            raise ValueError(f"frame not ended at byte {at}")
        at += 1
        ids, nulls, lengths, first, words = arrays
        yield part, seq, [None if z else int(d) for d, z in zip(ids, nulls)], lengths.astype(np.int64), unpack(words, first, n, escapes)


#: Classes of bytes: letter, punctuation, digit; 0 is any other (0xC3 and what follows it are seen to below).
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2
_CLASS[48:58] = 3


def piece_starts(b: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where the class changes, and each digit, in words that have no byte of another class."""
    kind = _CLASS[b]
    lead = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] != 0x97) & (b[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = 1  # Latin-1 letters
    edge = inside & ~np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(edge)
    out = np.zeros(len(b), bool)
    if len(starts):
        other = np.add.reduceat((kind == 0) & inside, starts, dtype=np.int64) > 0
        plain = inside & ~other[np.maximum(np.cumsum(edge) - 1, 0)]
        out[1:] = plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 3))
    return out


class Tokens:
    """Ids of texts by the tokenizers library, remembered by piece.

    For a tokenizer that drops white space and never joins ids over it, nor over
    a change between letters, ASCII punctuation and digits, a text is cut there
    (``pieces``; a word with an apostrophe, a combining mark or an unknown
    character is left whole), and each different piece is encoded once: by the
    library's model where it is of plain letters, else by its whole pipeline,
    many pieces in one call with a special token between them. Texts that could
    hold a special token are encoded whole, and so is every text if a probe
    shows that the tokenizer is of another kind. The memory holds up to ``MOST``
    pieces; pieces beyond are looked up for their batch only.
    """

    LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    PROBE = ["It's a test, don't: (x) 12 3rd.", "Éa ñb; ÀÇ-é  Straße", "one two\tthree\nfour", "a,b c'd 5%!"]
    MOST = 600_000

    def __init__(self, path: str | None = None, between: str = "<|endoftext|>", content: str | None = None):
        """Of the tokenizer file at ``path`` or with the given content."""
        from tokenizers import Tokenizer
        self.library, self.known = Tokenizer.from_str(content) if content else Tokenizer.from_file(path), {}
        self.model, self.letters = self.library.model, {}
        # the first two characters of every added token, in either case: where they stand, one might
        added = [t.content[:2] for t in self.library.get_added_tokens_decoder().values()]
        self.marks = sorted({x for a in added if a for x in (a, a.lower(), a.upper())})
        self.between, self.between_id = between, self.library.token_to_id(between)
        self.by_word = False
        try:
            # each letter as the model gets it from the normaliser and pre-tokenizer
            for c in self.LETTERS:
                (mapped, _), = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(c))
                self.letters[ord(c)] = mapped
            self.by_word = True
            probe = [*self.PROBE, *(c + "a" + c for c in self.LETTERS)]
            self.by_word = self.between_id is not None and self.encode(probe) == [self.whole(t) for t in probe]
        except (AttributeError, TypeError, ValueError):
            self.by_word = False

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, pieces) -> dict[bytes, bytes]:
        out, rest = {}, []
        for p in pieces:
            text = p.decode()
            if self.PLAIN.fullmatch(text):
                out[p] = struct.pack(f"<{len(t)}I", *[x.id for x in t]) if (t := self.model.tokenize(text.translate(self.letters))) else b""
            else:
                rest.append((p, text))
        for k in range(0, len(rest), 5000):
            some = rest[k:k + 5000]
            joined = self.between.join([t for _, t in some])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(ids == self.between_id) * 4).tolist()
            data = ids.tobytes()
            for (p, _), a, z in zip(some, [0, *[c + 4 for c in cuts]], [*cuts, len(data)]):
                out[p] = data[a:z]
        return out

    def _lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces, from memory or else encoded."""
        out = list(map(self.known.get, pieces))
        new = [p for p, x in zip(pieces, out) if x is None]
        if new:
            found = self._pieces(new)
            out = [found[p] if x is None else x for p, x in zip(pieces, out)]
            if len(self.known) + len(found) <= self.MOST:
                self.known.update(found)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers. The pieces of
        all texts are told apart by 64-bit hashes, each different one is looked
        up once, and the ids are put together with numpy."""
        if not self.by_word:
            return [self.whole(t) for t in texts]
        # in a text of ASCII the normaliser changes the case only
        apart = [any(m in t for m in self.marks) for t in texts]
        parts = [b"" if x else (t.lower() if t.isascii() else t).encode() for x, t in zip(apart, texts)]
        data = b"\n".join(parts)
        hashes, firsts, sizes = word_hashes(data, lower=False, cut=piece_starts)
        code, different = pd.factorize(hashes)
        one = np.zeros(len(different), np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]
        found = self._lookup([data[a:a + n] for a, n in zip(firsts[one].tolist(), sizes[one].tolist())])
        count = np.array([len(x) for x in found], np.int64) // 4
        flat, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(count) - count
        each = count[code]
        upto = np.cumsum(each)
        ids = flat[np.repeat(begin[code] - upto + each, each) + np.arange(int(upto[-1]) if len(upto) else 0)]
        ends = np.searchsorted(firsts, np.cumsum([len(p) + 1 for p in parts]))
        cuts = np.concatenate([[0], upto])[ends].tolist()
        return [self.whole(t) if x else ids[a:z].tobytes() for x, t, a, z in zip(apart, texts, [0, *cuts[:-1]], cuts)]


_TOKENS: dict[str, Tokens] = {}


def _framed(shared, name: str, end_id: int, chunk: int):
    def run(batches):
        if name not in _TOKENS:
            _TOKENS[name] = Tokens(content=shared.value)
        tokens = _TOKENS[name]
        part, seq, ids, sizes, held, total, end = TaskContext.get().partitionId(), 0, [], [], [], 0, np.array([end_id], "<u4").tobytes()

        def out():
            data = np.frombuffer(b"".join(held), "<u4").astype(np.uint64)
            return pa.RecordBatch.from_pydict({"frame": pa.array([frame(part, seq, ids, sizes, data)], pa.binary())})

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= chunk):
                    chars += len(texts[upto])
                    upto += 1
                for d, x in zip(doc_ids[at:upto], tokens.encode(texts[at:upto])):
                    if ids and total + len(x) // 4 + 1 > FRAME_IDS:
                        yield out()
                        seq, ids, sizes, held, total = seq + 1, [], [], [], 0
                    total += len(x) // 4 + 1
                    ids.append(d)
                    sizes.append(len(x) // 4 + 1)
                    held.append(x + end)
                at = upto
        if ids:
            yield out()
    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
              chunk: int = 4_000_000) -> None:
    """Encode every text and write the files into ``folder``, ids ascending over
    the files and within them. Documents are dealt out by ranges of (id, hash
    of the text), so an id that many rows repeat is split.

    Defined cases: a null text counts as empty (only the end id); null ids come
    first; equal ids are ordered by their texts; no rows give no frames; ids
    must be integers; other columns are ignored. The tokenizer's file is read by
    the driver and sent to the tasks, whose machines need not have it.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    shared, name = docs.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content.encode()).hexdigest()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    out = rows.mapInArrow(_framed(shared, name, end_id, chunk), "frame binary")
    with small_batches(docs.sparkSession):
        (out.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none")
         .option("maxRecordsPerFile", FRAMES_PER_FILE).text(folder))


def _decoded(batches):
    for batch in batches:
        for content in batch.column(0):
            rows = {k: [] for k in ("part", "seq", "doc_id", "n_tokens", "ids_crc32", "inside")}
            for part, seq, doc_ids, sizes, ids in frames(content.as_py()):
                data, ends = ids.astype("<u4"), np.cumsum(sizes)
                for d, size, end in zip(doc_ids, sizes.tolist(), ends.tolist()):
                    for k, v in zip(rows, (part, seq, d, size, zlib.crc32(data[end - size:end]), end - size)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: per document ``doc_id, start, n_tokens, ids_crc32``
    (start: ids of all documents before it)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    rows = written(files.mapInArrow(_decoded, "part long, seq long, doc_id long, n_tokens long, ids_crc32 long, inside long"), "token-index")
    per_frame = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = per_frame.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    per_frame = (per_frame.withColumn("frame_start", F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("seq")), F.lit(0)))
                 .join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("frame_start")).alias("before")))
    return rows.join(per_frame, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: per document ``doc_id, ids``."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for _, _, doc_ids, sizes, ids in frames(content.as_py()):
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()),
                                                      "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, "doc_id long, ids array<long>")
