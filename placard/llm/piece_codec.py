"""SentencePiece encoding and decoding with merge-type models, by backtracking.

A merge-type model joins, again and again, the two neighbours whose string is
the best piece (the leftmost of equals). Its result for a text is the one list
of pieces in which each piece is what its own string is merged to, and in which
each two neighbours stay apart when their strings are merged together. So the
list is found from left to right without merging the text:

* an Aho-Corasick automaton over reversed pieces gives the longest piece that
  starts at each position;
* a piece is taken if it is compatible with the one before it. This is decided
  by merging the two again, step by step: a merge across their border that the
  model would choose before one of theirs forbids the pair;
* if no piece fits at a position, the last one is given back, and a bitfield of
  failed positions keeps any other way from ending there again. Each position
  fails once at most, so the time is linear in the text.

No merge crosses a border between two characters that no piece holds side by
side. Texts are cut there, first at spaces (if no piece has a space mark after
another character) and then within words, and what is cut off, up to ``PIECE``
characters, is remembered within a task.

Edge cases: a null or empty text has just the end id and decodes to the empty
text; a text of any length is encoded whole, in memory linear in its length;
characters that no piece holds become their bytes' pieces; a space mark (U+2581)
in a text is the same as a space; control pieces' strings are ordinary text;
each of repeated rows gets its own result; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from placard.llm.common import KEPT, only, table

SPACE = "▁"
#: Entries that each of a task's two memos and a worker's memo of pairs hold at most; longer parts than PIECE aren't kept.
PARTS, PAIRS, PIECE = 800_000, 2_000_000, 64
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The model format's number for merge-type models (fixed value).
MERGES = 2


class Pieces:
    """A model's pieces, and what of their merges the encoder needs."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != MERGES or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("a merge-type model with byte pieces, without user-defined and unused ones, is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that keeps characters and white space as they are is needed")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.raw = [b"" if p.type == CONTROL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.names = [str(i) for i in range(len(model.pieces))]

        # What can be in a result: pieces that their own strings are merged to, and single characters (as bytes if they are no piece).
        known = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.alphabet = sorted({c for p in known for c in p})
        self.text: list[str] = list(self.alphabet)
        self.ids = [(known[c],) if c in known else self.as_bytes(c) for c in self.alphabet]
        self.right: list[list] = [[] for _ in self.alphabet]
        self.left: list[list] = [[] for _ in self.alphabet]
        for piece, i in known.items():
            if len(piece) > 1 and (steps := self.merges(piece)) is not None:
                self.text.append(piece)
                self.ids.append((i,))
                self.right.append([(score, new if end == len(piece) else None) for score, _, end, new in steps])
                self.left.append([(score, new if start == 0 else None) for score, start, _, new in steps])
        self.size = [len(t) for t in self.text]
        place = {t: n for n, t in enumerate(self.text)}
        self.shorter = [next((place[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in place), -1) for t in self.text]
        self.backward = ahocorasick.Automaton()
        for n, t in enumerate(self.text):
            self.backward.add_word(t[::-1], n)
        self.backward.make_automaton()
        plain = "".join(re.escape(c) for c in self.alphabet if c != SPACE)
        cut = not any(SPACE in p.lstrip(SPACE) for p in known)
        self.parts = re.compile(f"{SPACE}+[{plain}]*|[{plain}]+|[^{plain}{SPACE}]" if cut else f"[{plain}{SPACE}]+|[^{plain}{SPACE}]", re.DOTALL).findall
        self.inside = frozenset(self.alphabet)
        self.together = {p[k : k + 2] for p in known for k in range(len(p) - 1)}
        self.fits: list[dict[int, bool]] = [{} for _ in self.text]
        self.pairs = 0

    def as_bytes(self, character: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in character.encode("utf-8", "surrogatepass"))

    def merges(self, piece: str) -> list[tuple[float, int, int, str]] | None:
        """The merges that make a piece of its characters, in order: (score, start, end, string); None if they make something else."""
        ends, steps = list(range(1, len(piece) + 1)), []
        while len(ends) > 1:
            best = None
            for k in range(len(ends) - 1):
                start = ends[k - 1] if k else 0
                score = self.score.get(piece[start : ends[k + 1]])
                if score is not None and (best is None or score > best[0]):
                    best = (score, start, ends[k + 1], k)
            if best is None:
                return None
            score, start, end, k = best
            del ends[k]
            steps.append((score, start, end, piece[start:end]))
        return steps

    def compatible(self, one: int, two: int) -> bool:
        """Whether two neighbours stay apart: their own merges, in the model's order, come before any across the border."""
        ours, theirs, score = iter(self.right[one]), iter(self.left[two]), self.score
        near = self.text[one][-1] if self.right[one] else self.text[one]
        far = self.text[two][0]
        mine, other = next(ours, None), next(theirs, None)
        while True:
            across = score.get(near + far)
            # Of equal scores the leftmost merge is first: one within `one`, then the one across, then one within `two`.
            if across is not None and (mine is None or across > mine[0]) and (other is None or across >= other[0]):
                return False
            if mine is not None and (other is None or mine[0] >= other[0]):
                near = mine[1] or near
                mine = next(ours, None)
            elif other is not None:
                far = other[1] or far
                other = next(theirs, None)
            else:
                return True

    def backtrack(self, part: str) -> list[int]:
        """The places (in ``text``) of the pieces of a part of a text that has only characters of the alphabet."""
        n, size, shorter, fits = len(part), self.size, self.shorter, self.fits
        longest, last = [0] * n, -1
        for at, piece in self.backward.iter(part[::-1]):
            if at != last:  # of the pieces that start here, the longest comes first
                longest[n - 1 - at] = piece
                last = at
        failed: bytearray | None = None
        out: list[int] = []
        at, piece, after = 0, longest[0], None
        while True:
            end = at + size[piece]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                fit = True if after is None else after.get(piece)
                if fit is None:
                    fit = after[piece] = self.compatible(out[-1], piece)
                    self.pairs += 1
                if fit:
                    out.append(piece)
                    if end == n:
                        return out
                    at, piece, after = end, longest[end], fits[piece]
                    continue
            piece = shorter[piece]
            while piece < 0:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= size[piece]
                after = fits[out[-1]] if out else None
                piece = shorter[piece]

    def encode_part(self, part: str) -> tuple[int, ...]:
        if part[0] not in self.inside:
            return self.as_bytes(part)
        if self.pairs >= PAIRS:
            self.pairs = 0
            for known in self.fits:
                known.clear()
        return tuple(chain.from_iterable([self.ids[p] for p in self.backtrack(part)]))

    def cuts(self, part: str) -> list[str]:
        """A part, cut between characters that no piece holds side by side."""
        together = self.together
        at = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in together]
        return [part[i:k] for i, k in zip([0, *at], [*at, len(part)], strict=True)] if at else [part]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are left out, one space that the encoder put first too, bytes that make no character become U+FFFD."""
        raw = self.raw
        whole = b"".join([raw[i] for i in ids])
        first = next((i for i in ids if i not in self.controls), None)
        if self.prefix and first is not None and first not in self.bytes.values() and whole[:1] == b" ":
            whole = whole[1:]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return _replaced(whole)


def _replaced(raw: bytes) -> str:
    """UTF-8 with each byte that belongs to no character replaced."""
    out, at = [], 0
    while at < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + k].decode())
                at += k
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Memo(dict):
    """What a function returned for short strings; emptied when full."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.function(key)
        if len(key) <= PIECE:
            if len(self) >= PARTS:
                self.clear()
            self[key] = ids
        return ids


class Parts:
    """Encodes texts and remembers their parts, and what the parts are cut into; gone with its task."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.short = pieces, Memo(pieces.encode_part)
        self.long = Memo(self._cut)

    def _cut(self, part: str) -> tuple[int, ...]:
        if len(cuts := self.pieces.cuts(part)) == 1:
            return self.pieces.encode_part(part)
        return tuple(chain.from_iterable(map(self.short.__getitem__, cuts)))

    def encode(self, text: str | None) -> list[int]:
        """A whole text's ids, without an end id."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.long.__getitem__, self.pieces.parts(self.pieces.prefix + text.replace(" ", SPACE)))))


@functools.lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


KEPT.append(pieces.cache_clear)


def encode_documents(docs: DataFrame, model: str, end_id: int = 2) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text), each with the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Parts(pieces(model))
        for batch in batches:
            for piece in _slices(batch):
                ids = [[*memo.encode(t), end_id] for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of every row of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = pieces(model).decode
        for batch in batches:
            for piece in _slices(batch):
                texts = [decode(i or []) for i in piece.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digest(docs: DataFrame, model: str, end_id: int = 2) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text): encoded, and decoded from the ids, without either leaving the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        memo, names = Parts(known), known.names.__getitem__
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for piece in _slices(batch):
                sizes, digests, decoded = [], [], []
                for text in piece.column("text"):
                    ids = memo.encode(text.as_py())
                    ids.append(end_id)
                    sizes.append(len(ids))
                    digests.append(sha(" ".join(map(names, ids))))
                    decoded.append(sha(known.decode(ids)))
                columns = [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), default_model())
