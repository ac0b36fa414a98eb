"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary and scores are those of an existing model file; nothing is trained. The search (``search``) goes through a
text once. Best scores are kept for the last ``longest`` places only, as no piece is longer; the backpointers form a tree,
from which a place goes when no live place descends from it. As soon as all that live descend from one boundary, the ids
up to it are committed and the tree starts there. So beside the text and its ids only the open paths are held.

Where no piece of the vocabulary reaches across a place, all paths meet there. Such places are known beforehand: before
a word's ``\u2581`` if no piece has one after another character, and around characters that are in no piece. Whole texts
are streamed from one such place to the next (``stream``); what is between two is searched by itself, and as its ids
depend on nothing else, those of words are remembered while they are among the latest ``CACHE`` to twice as many. This
memory of words is a shortcut alone: without it the same search gives the same ids.

Characters outside the vocabulary cost ``min score - 10`` each and become byte pieces. A literal ``\\u2581`` becomes byte
pieces too, so decoding returns every text unchanged. Defined results: a null text has null ids, an empty one none;
other columns (null ids, repeated rows, clashing names) pass through untouched; an empty table stays empty.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

MODEL = common.tokenizer("piece_bpe_32k.model")
CACHE = 300_000
#: Bytes of texts that are encoded together: their words and ids are in memory several times over.
PART = 1 << 20
SPACE = "▁"


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    _of: dict[int, Vocabulary] = {}

    def __init__(self, model: bytes):
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.pieces = sp.id_to_piece(list(range(self.size)))
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(self.size)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_id = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.id_of_byte = [i for i, _ in sorted(self.byte_id.items(), key=lambda x: x[1])]
        self.unknown = min((s for s in self.score.values()), default=0.0) - 10.0
        self.longest = max(map(len, self.score), default=1)
        self.chars = set("".join(self.score))
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        follows: dict[str, set[str]] = {}
        for p in self.score:
            for a, b in zip(p, p[1:], strict=False):
                follows.setdefault(a, set()).add(b)
        #: Letters and all that follows them in some piece; no piece goes from these to another character of the vocabulary.
        inner, todo = set(), [c for c in self.chars if c.isalpha()]
        while todo:
            if (c := todo.pop()) not in inner:
                inner.add(c)
                todo += follows.get(c, ())
        inner.discard(SPACE)
        known, inside, outside = (re.escape("".join(sorted(x))) or "\ufdd2" for x in (self.chars, inner, self.chars - inner - {SPACE}))
        self.cut = re.compile(f"{SPACE}*[{outside}]*[{inside}]+|{SPACE}*[{outside}]+|{SPACE}+|[^{known}]" if self.splits else f"[{known}]+|[^{known}]")
        self.spelled = [bytes([self.byte_id[i]]) if i in self.byte_id else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.literal = np.asarray([self.id_of_byte[b] for b in SPACE.encode()], "<i4").tobytes()
        #: Every beginning of a piece, with the score if it is a piece itself.
        self.starts: dict[str, float | None] = {p[:k]: None for p in self.score for k in range(1, len(p))}
        self.starts |= {p: float(x) for p, x in self.score.items()}
        self.marks: dict[str, bytes] = {}
        self.raw = {p: int(i).to_bytes(4, "little") for p, i in self.id.items()}

    @classmethod
    def get(cls, model: bytes) -> Vocabulary:
        key = zlib.crc32(model)
        if key not in cls._of:
            cls._of[key] = cls(model)
        return cls._of[key]

    @classmethod
    def forget(cls) -> None:
        """Drops remembered words, so that an idle worker holds no more than the vocabulary."""
        for v in cls._of.values():
            v.cache, v.older = {}, {}

    def search(self, text: str):
        """Yields the ids of ``text`` (already escaped), piece by piece, as paths meet.

        Places are numbered from ``base`` on. ``best`` has the scores of the places that pieces can still start from or have
        reached, ``back`` where a place's best piece starts. ``kids`` counts the places that live on below a place and
        ``sum_of`` adds up their numbers, so that an only one is known. A place lives while it is among the last ``longest``
        or something that lives descends from it.
        """
        get, longest, unknown, n = self.starts.get, self.longest, self.unknown, len(text)
        base, best, back = 0, [0.0], [-1]
        kids, sum_of, root = [0], [0], 0
        for start in range(n):
            # the place is final: its best piece is known, and it hangs below that piece's start
            if start:
                at = back[start - base] - base
                kids[at] += 1
                sum_of[at] += start
                gone = start - longest - 1  # no piece starts there any more
                while gone > root and not kids[gone - base]:
                    up = back[gone - base] - base
                    kids[up] -= 1
                    sum_of[up] -= gone
                    if up + base >= start - longest:
                        break
                    gone = up + base
                while root < start - longest and kids[root - base] == 1:
                    below = sum_of[root - base]
                    yield from self._ids(text[root:below])
                    root = below
                if root - base >= 4096:
                    cut = root - base
                    best, back, kids, sum_of, base = best[cut:], back[cut:], kids[cut:], sum_of[cut:], root
            here = best[start - base]
            top = len(best) + base
            for end in range(start + 1, min(start + longest, n) + 1):
                s = get(text[start:end], 0)
                if s is None:
                    if end >= top:
                        best.append(-1e300)
                        back.append(end - 1)
                        kids.append(0)
                        sum_of.append(0)
                        top += 1
                    continue
                if s == 0 and s.__class__ is int:
                    break
                if end >= top:
                    best.append(here + s)
                    back.append(start)
                    kids.append(0)
                    sum_of.append(0)
                    top += 1
                elif here + s > best[end - base]:
                    best[end - base], back[end - base] = here + s, start
            if start + 1 >= top:
                best.append(-1e300)
                back.append(start)
                kids.append(0)
                sum_of.append(0)
            if here + unknown > best[start + 1 - base] and text[start] not in self.score:
                best[start + 1 - base], back[start + 1 - base] = here + unknown, start
        places, end = [], n
        while end > root:
            places.append(end)
            end = back[end - base]
        for end in reversed(places):
            yield from self._ids(text[root:end])
            root = end

    def _ids(self, piece: str) -> list[int]:
        """The id of a piece, or those of the byte pieces of a character outside the vocabulary."""
        return [self.id[piece]] if piece in self.id else [self.id_of_byte[x] for x in piece.encode("utf-8", "surrogatepass")]

    def short(self, text: str) -> bytes:
        """What ``search`` gives, for texts of no more characters than its window has places: nothing can be committed before the end."""
        get, unknown, n = self.starts.get, self.unknown, len(text)
        best, back = [-1e300] * (n + 1), list(range(-1, n))
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            for end in range(start + 1, n + 1):
                s = get(text[start:end], 0)
                if s is None:
                    continue
                if s == 0 and s.__class__ is int:
                    break
                if here + s > best[end]:
                    best[end], back[end] = here + s, start
            if here + unknown > best[start + 1] and text[start] not in self.score:
                best[start + 1], back[start + 1] = here + unknown, start
        out, raw = [], self.raw
        while n:
            piece = text[back[n] : n]
            out.append(raw.get(piece) or np.asarray(self._ids(piece), "<i4").tobytes())
            n = back[n]
        return b"".join(out[::-1])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian int32 bytes."""
        return b"".join(self.stream(text))

    def stream(self, text: str):
        """Yields the ids of a whole text, bit by bit, from its start to its end."""
        if not text:
            return
        first = True
        for part in text.split(SPACE):  # no path goes through a literal U+2581: it becomes bytes
            if not first:
                yield self.literal
            for x in self.cut.finditer((SPACE if first else "") + part.replace(" ", SPACE)):
                x = x[0]
                known = self.cache.get(x[1:]) if x[:1] == SPACE and len(x) > 1 else self.marks.get(x)
                if known is not None:
                    yield known
                elif len(x) > self.longest:
                    for i in self.search(x):
                        yield i.to_bytes(4, "little")
                else:
                    yield self.short(x)
            first = False

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words (no white space, no U+2581) after a space or at a text's start."""
        cache = self.cache
        found = list(map(cache.get, words))
        if missing := [i for i, x in enumerate(found) if x is None]:
            older = self.older
            if len(cache) > CACHE:
                self.older, self.cache = cache, (cache := {})
            for i in missing:
                w = words[i]
                found[i] = cache[w] = older.get(w) or self.part(SPACE + w)
        return found

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a block of texts."""
        odd = pc.fill_null(pc.match_substring_regex(texts, f"{blocks.DOUBLE}|^ | $|{SPACE}") if self.splits else pc.is_valid(texts), False).to_numpy(zero_copy_only=False)
        empty = pc.fill_null(pc.equal(texts, ""), True).to_numpy(zero_copy_only=False)
        return blocks.encode(texts, odd | empty, self.words, self.words, self.encode)

    def part(self, text: str) -> bytes:
        first, *rest = self.cut.findall(text) or [""]
        out = (rest and self.cache.get(first[1:]) if first[:1] == SPACE and len(first) > 1 else None) or self.piece_ids(first)
        for x in rest:
            if (y := self.marks.get(x)) is None:
                if len(self.marks) > 20_000:
                    self.marks.clear()
                self.marks[x] = y = self.piece_ids(x)
            out += y
        return out

    def piece_ids(self, text: str) -> bytes:
        return self.short(text) if len(text) <= self.longest else np.fromiter(self.search(text), "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts before it goes."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) added, or replaced if there is one; with ``check``, a column of that name says whether decoding gives the text."""
    spark = common.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema, kept = common.with_fields(docs, {ids}, f"`{ids}` array<int>" + (f", `{check}` boolean" if check else ""))
    at = docs.columns.index(text)

    def run(batches):
        v = Vocabulary.get(shared.value)
        for b in batches:
            for i, size in blocks.slices(b.column(at), size=PART):
                part = b.slice(i, size)
                texts = part.column(at)
                offsets, found = v.block(texts)
                out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int32)), mask=pc.is_null(texts))]
                if check:
                    out.append(pa.array([t is None or v.decode(found[s:e]) == t for t, s, e in zip(texts.to_pylist(), offsets[:-1], offsets[1:], strict=True)]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *out], schema.names)

    return docs.mapInArrow(common.tidy(run, Vocabulary.forget), schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``text`` added, or replaced if there is one: what ``ids`` spell."""
    spark = common.ship(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema, kept = common.with_fields(encoded, {text}, f"`{text}` string")
    at = encoded.columns.index(ids)

    def run(batches):
        v = Vocabulary.get(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [None if x is None else v.decode(np.asarray(x, np.int64)) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(out, pa.string())], schema.names)

    return encoded.mapInArrow(common.tidy(run), schema)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids of every whole text, and whether decoding them gives the text again."""
    model = read_model(model_file)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, model, check="round_trip").select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")
