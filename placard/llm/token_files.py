"""Token ids in binary files of independent zstandard frames.

File layout, all integers little-endian:

* one zstandard frame for each document, whose content is its token ids as
  unsigned integers of 2 or 4 bytes. A frame needs no other frame.
* a skippable frame (magic 0x184D2A50) with the index: the id width (1 byte),
  and a zstandard frame with the doc_ids as 8-byte integers followed by one
  byte for each that is 1 where the doc_id is null.
* a trailing seek table in the public seekable format: a skippable frame
  (magic 0x184D2A5E) with, for each frame, its compressed size, its content's
  size and the low 32 bits of the content's XXH64, then the number of frames,
  a descriptor byte (0x80: checksums present) and the magic 0x8F92EAB1. The
  index frame is its last entry.

A reader takes the tail first, then only the frames it wants, and checks each
one's checksum. Documents are in ascending doc_id order within a file and from
file to file. The manifest, a Parquet table in the folder, names the files in
order with the ids that come before each; a file that a lost or repeated task
attempt left is not named there and so never read.

Edge cases: a null or empty text has just the end id; a null doc_id sorts
first; equal doc_ids (and rows without one) are all written, in the order of
their texts' hashes, and may fill several files; an empty table gives a
manifest without files; a special token's string in a text is encoded as the
tokenizer does it by itself; texts of a tokenizer that cuts them in another way
than the public byte-level files do go to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import KEPT, fresh_path, only, short_batches, table

INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Entries that each of one worker's memos holds at most; pieces of over PIECE characters are never kept. A worker takes about 230 bytes for each.
MEMO, PIECE = 200_000, 64
#: Bytes of text that are cut in one go (one text, if that is longer).
STRETCH = 1 << 20
#: Bytes of rows that a task hands its worker at once (one row, if that is longer).
BATCH = 2 << 20
#: The byte-level pattern of the public tokenizer files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def filesystem(path: str):
    """(pyarrow file system, path on it) of a URI, Hadoop's one-slash form included."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in visible else next(others)) for b in range(256)}


def cuts_plainly(tokenizer: dict) -> bool:
    """Whether a tokenizer (its JSON) cuts texts by ``PATTERN`` alone, so that pieces can be encoded by themselves."""
    cut, model = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("model") or {}
    by_bytes = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    whole = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback", "ignore_merges"))
    marks = all(t.get("special") and t.get("content", "").startswith("<|") and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in tokenizer.get("added_tokens") or ())
    return bool(by_bytes and whole and marks and not tokenizer.get("normalizer") and not tokenizer.get("truncation") and not tokenizer.get("padding"))


class _Memo(dict):
    """What a function returned for short strings; emptied when full."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key: str) -> bytes:
        found = self.function(key)
        if len(key) <= PIECE:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


#: Kinds of characters that ``PATTERN`` tells apart: white space, letters, numbers, others.
SPACE, LETTER, NUMBER, OTHER = range(4)


def _latin_kinds() -> np.ndarray:
    """The kind of each character before U+0250."""
    kinds = {"L": LETTER, "N": NUMBER}
    return np.array([SPACE if c in (10, 32) else kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x250)], np.uint8)


KINDS = _latin_kinds()
#: Texts of visible characters before U+0250, spaces and line feeds.
LATIN = re.compile(f"[{re.escape(''.join(c for c in map(chr, range(0x250)) if c.isprintable()))}\n]*")


def part_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bytes at which ``PATTERN`` begins a part, in the UTF-8 bytes of ``LATIN`` texts on end; bounds: where texts begin, and the last one's end."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = KINDS[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = KINDS[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    text = np.zeros(len(data) + 3, bool)  # a text begins here
    text[bounds] = text[len(data) :] = True
    space = kind == SPACE
    start = text[: len(data)].copy()
    # A run of one kind is a part, and takes one space before it; a line feed before it is a part of its own.
    start[1:] |= (kind[1:] != kind[:-1]) & ~(space[:-1] & (data[:-1] == 32) & ~text[1 : len(data)])
    # Of white space before a visible character, the last one is apart from the rest.
    start[:-1] |= space[:-1] & ~space[1:] & ~text[1 : len(data)]
    # 's, 't, 'm, 'd, 're, 've and 'll are parts where a part begins with them.
    mark = np.flatnonzero((data == 39) & start)
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~text[mark + 1]
    pair = np.isin(one.astype(np.int64) << 8 | two, [0x7265, 0x7665, 0x6C6C]) & ~text[mark + 1] & ~text[mark + 2]
    start[mark[short | pair] + 1] = False
    after = np.concatenate((mark[short] + 2, mark[pair] + 3))
    start[after[after < len(data)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Whole-text encoding that encodes each distinct part of many texts once.

    Latin texts are cut by the tokenizer's pattern, a stretch of them at a time;
    Arrow finds the distinct parts, the library's model encodes those not met
    before, many in one call, and Arrow strings the ids together. In other texts the pattern never
    lets a token reach over a space that follows a visible character, except as
    the space's own start. So such a text is cut there, and each new piece is
    encoded by itself. One with any other white space before a space goes to
    the library in one, and so does a piece that is not Latin or has a special
    token.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.uint32(end_id).astype("<u4").tobytes()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.plain = cuts_plainly(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.memo, self.words, self.older = _Memo(self._after_space, MEMO), {}, {}
        self.opens, self.closing = np.zeros(0, bool), ""
        if self.plain:
            self._joins(spec["model"])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joins(self, model: dict) -> None:
        """Finds which parts the model may take on end: no merge reaches over a space's letter from what is before it.

        opens: whether each id begins with that letter; closing: characters whose last byte some merge does join to it.
        """
        space, vocab = self.letters[32], self.tokenizer.get_vocab(with_added_tokens=False)
        if all(c in vocab for c in self.letters.values()):
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for token, i in vocab.items() if token.startswith(space)]] = True
            pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
            joined = {left[-1] for left, right in pairs if right.startswith(space)}
            self.closing = "".join(c for c in map(chr, range(0x250)) if self.letters[c.encode()[-1]] in joined)

    def _ids(self, part: str) -> list[int]:
        letters = part.replace(" ", self.letters[32]) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part. Parts that begin with their only space are given to the model 64 at a time, and parted where an id begins with one."""
        joined = [p for p in parts if p[0] == " " and p.rfind(" ") == 0 and p[-1] not in self.closing] if len(self.opens) else []
        out = {}
        if joined:
            ids = np.fromiter((i for at in range(0, len(joined), 64) for i in self._ids("".join(joined[at : at + 64]))), "<u4")
            held, at = ids.tobytes(), [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            out = {p: held[start:end] for p, start, end in zip(joined, at[:-1], at[1:], strict=True)}
        return out | {p: np.array(self._ids(p), "<u4").tobytes() for p in parts if p not in out}

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; remembers short ones in two halves: parts met while the newer one fills are in it, the older one is let go when that is full."""
        found = list(map(self.words.get, parts))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        for i in gaps:
            found[i] = self.older.get(parts[i])
        new = self._new([parts[i] for i in gaps if found[i] is None])
        for i in gaps:
            if found[i] is None:
                found[i] = new[parts[i]]
        met = {parts[i]: found[i] for i in gaps if len(parts[i]) <= PIECE}
        if len(self.words) + len(met) > MEMO // 2:
            self.older, self.words = self.words, {}
            met = dict(itertools.islice(met.items(), MEMO // 2))
        self.words.update(met)
        return found

    def _latin(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each of some Latin texts without a special token."""
        held = pa.array(texts, pa.string())
        bounds = np.frombuffer(held.buffers()[1], "<i4", len(held) + 1)
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        starts = part_starts(data, bounds)
        parts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype("<i4")), pa.py_buffer(data)]).dictionary_encode()
        strung = pa.array(self._known(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(strung.buffers()[1], "<i8", len(strung) + 1)[np.searchsorted(starts, bounds)].tolist()
        ids = memoryview(strung.buffers()[2] or b"")
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            yield bytes(ids[start:end])

    def _piece(self, piece: str) -> bytes:
        return next(self._latin([piece])) if "<|" not in piece and LATIN.fullmatch(piece) else self._whole(piece)

    def _after_space(self, piece: str) -> bytes:
        if not _visible_end(piece):
            raise KeyError(piece)  # the text can't be cut here
        return self._piece(" " + piece)

    def _other(self, text: str) -> bytes:
        if not self.plain:
            return self._whole(text)
        first, *rest = text.split(" ")
        try:
            tail = b"".join(map(self.memo.__getitem__, rest))
            if not rest or not first or _visible_end(first):
                return (self._piece(first) if first else b"") + tail
        except KeyError:
            pass
        return self._whole(text)

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """The ids of each text and the end id, as 4-byte integers."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
            some = [text or "" for text in texts.slice(at, stop - at).to_pylist()]
            latin = [self.plain and "<|" not in text and LATIN.fullmatch(text) is not None for text in some]
            found = self._latin([text for text, is_latin in zip(some, latin, strict=True) if is_latin])
            for text, is_latin in zip(some, latin, strict=True):
                yield (next(found) if is_latin else self._other(text)) + self.end
            at = stop


def _visible_end(piece: str) -> bool:
    return bool(piece) and ("!" <= piece[-1] <= "~" or piece[-1].isalnum())


@functools.lru_cache(1)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


KEPT.append(encoder.cache_clear)


class FrameWriter:
    def __init__(self, stream, width: int, level: int = 3):
        import zstandard

        self.stream, self.width = stream, width
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.ids: list[int | None] = []
        self.entries = bytearray()

    def _entry(self, frame: int, content: bytes | None) -> None:
        from xxhash import xxh64_intdigest

        self.entries += struct.pack("<III", frame, len(content or b""), xxh64_intdigest(content or b"") & 0xFFFFFFFF)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        content = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        frame = self.compress(content)
        self.stream.write(frame)
        self._entry(len(frame), content)
        self.ids.append(doc_id)

    def finish(self) -> None:
        known = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids)
        index = bytes([self.width]) + self.compress(known)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self._entry(len(index) + 8, None)
        tail = bytes(self.entries) + struct.pack("<IBI", len(self.ids) + 1, 0x80, SEEKABLE)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(tail)) + tail)


class FrameReader:
    """Random access to one file; only the tail is read at first."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.decompress = stream, zstandard.ZstdDecompressor().decompress
        size = stream.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("no seek table at the file's end")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.contents, self.checks = table[:-1, 0], table[:-1, 1], table[:-1, 2]
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        index = self._at(int(self.starts[-2]) + 8, int(table[-1, 0]) - 8)
        self.width, known = index[0], self.decompress(index[1:])
        n = frames - 1
        missing = np.frombuffer(known, np.uint8, n, 8 * n)
        self.doc_ids = [None if m else d for d, m in zip(np.frombuffer(known, "<i8", n).tolist(), missing.tolist(), strict=True)]
        self.n_tokens = self.contents // self.width

    def _at(self, start: int, size: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(size)

    def ids(self, frame: int) -> np.ndarray:
        """One document's token ids, checked."""
        from xxhash import xxh64_intdigest

        content = self.decompress(self._at(int(self.starts[frame]), int(self.sizes[frame])))
        if xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[frame]:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(content, f"<u{self.width}").astype("<u4")


MANIFEST = "file string, low long, low_hash long, high long, docs long, tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, files: int) -> DataFrame:
    """Encodes docs (doc_id, text) into files in the folder; returns the manifest, which is also there.

    Rows are dealt by ranges of doc_id, and of the text's hash where many rows
    share one, so a file holds one range and no doc_id is too much for a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        system, base = filesystem(folder)
        writer, total, first = None, 0, {}
        name = f"part-{uuid.uuid4().hex}.zst"  # an attempt's own
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(base, recursive=True)
                writer = FrameWriter(system.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20), encode.width)
                first = {"low": batch.column("doc_id")[0].as_py(), "low_hash": batch.column("hash")[0].as_py()}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text")), strict=True):
                writer.add(doc_id, ids)
                total += len(ids) // 4
        if writer is not None:
            writer.finish()
            writer.stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "high": writer.ids[-1], "docs": len(writer.ids), "tokens": total} | first], SCHEMA)

    SCHEMA = pa.schema([("file", pa.string()), *[(c, pa.int64()) for c in ("low", "low_hash", "high", "docs", "tokens")]])
    spark = docs.sparkSession
    dealt = only(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text")).repartitionByRange(files, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    # Files have names of their own attempt, so the list is written once and never computed again.
    with short_batches(spark, BATCH):
        dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/written")
    before = "cast(coalesce(sum(tokens) over (order by low nulls first, low_hash, file rows between unbounded preceding and 1 preceding), 0) as bigint)"
    spark.read.schema(MANIFEST).parquet(f"{folder}/written").selectExpr("*", f"{before} as before").write.parquet(f"{folder}/manifest")
    return spark.read.schema(f"{MANIFEST}, before long").parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, frames: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files alone.

    A task gets ``frames`` frames of one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for batch in batches:
            for piece in batch.to_pylist():
                with system.open_input_file(f"{base}/{piece['file']}") as stream:
                    reader = FrameReader(stream)
                    starts = piece["before"] + np.concatenate(([0], np.cumsum(reader.n_tokens)))
                    stop = min(piece["at"] + frames, len(reader.doc_ids))
                    for at in range(piece["at"], stop, 256):
                        part = range(at, min(at + 256, stop))
                        columns = [pa.array([reader.doc_ids[i] for i in part], pa.int64()), pa.array(starts[at : part.stop]), pa.array(reader.n_tokens[at : part.stop]), pa.array([reader.ids(i).tobytes() for i in part], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    manifest = spark.read.schema(f"{MANIFEST}, before long").parquet(f"{folder}/manifest")
    pieces = manifest.select("file", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(frames).cast("long"))).alias("at"))
    count = int(manifest.agg(F.coalesce(F.sum(F.ceil(F.col("docs") / frames)), F.lit(0)).alias("n")).first().n)
    return pieces.repartition(max(1, min(count, 100_000)), "file", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, folder: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """The token ids of a few documents; opens the files that may hold them and decompresses their frames only."""
    manifest = spark.read.schema(f"{MANIFEST}, before long").parquet(f"{folder}/manifest")
    near = F.lit(False)
    for doc_id in wanted:
        near = near | ((F.col("high") >= doc_id) & (F.col("low").isNull() | (F.col("low") <= doc_id)))
    system, base = filesystem(folder)
    out = {}
    for entry in manifest.filter(near).select("file").collect():
        with system.open_input_file(f"{base}/{entry.file}") as stream:
            reader = FrameReader(stream)
            out |= {d: reader.ids(i) for i, d in enumerate(reader.doc_ids) if d in wanted}
    return out


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, rows_per_file: int | None = None) -> DataFrame:
    """Writes docs to files in the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32).

    Files grow with the square root of the corpus, from 4096 to 65536 rows.
    """
    spark = docs.sparkSession
    folder, rows = fresh_path(spark, "token-files"), docs.count()
    files = max(1, -(-rows // (rows_per_file or min(1 << 16, max(4096, int(4 * rows**0.5))))))
    write_token_files(docs, folder, tokenizer_path, end_id, files)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), default_tokenizer())
