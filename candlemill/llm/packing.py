"""Best-fit packing of tokenised documents into sequences of CAPACITY tokens.

Documents longer than a sequence are cut. Whole sequences stand alone. The rest are dealt into
shards of about SHARD_TOKENS tokens and each shard is packed by itself, so no task holds more
than that; the loss is at most about one partly filled sequence a shard. In a shard, pieces above
a third of the capacity are items that share a sequence with at most one other such item: taken
from the largest down, each above a half takes the largest fitting partner of at most a half, and
what is left pairs up in order of size (three fit only where all are at most a third). Smaller
pieces then go, largest first, where they leave the least room.

Null and empty texts are empty documents: their one piece is the end token alone. A table without
rows gives none. Very long texts are cut, never dropped. Repeated rows are packed once each and
spread over the shards, ties in length go in row order. A null doc_id is packed like any other, and
doc_id may have any type. Only doc_id and text are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.llm.common import read, table

CAPACITY, END = 4096, 1
SHARD_TOKENS = 4096 * 4096
#: Words, and pieces of words, whose ids a task remembers before it starts anew.
REMEMBERED = 250_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else the next from 256 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b if own else next(spare)) for b, own in enumerate(prints)]


#: The vocabulary's pieces in a word of lower-case text, and in one of ASCII alone.
_ANY = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"


class _Parts(dict):
    """Ids, as little-endian bytes, of each piece seen so far; a new piece goes through the merge model."""

    def __init__(self, model):
        super().__init__()
        self._model, self._letters = model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        text = part if part.isascii() and part.isprintable() else "".join(map(self._letters.__getitem__, part.encode()))
        ids = self[part] = array("I", [t.id for t in self._model.tokenize(text)]).tobytes()
        return ids


class _Words(dict):
    """Ids of each word, as cut at spaces and line ends, seen so far."""

    def __init__(self, parts: _Parts):
        import regex

        super().__init__()
        self._parts, self._any, self._ascii = parts, regex.compile(_ANY).findall, re.compile(_ASCII).findall

    def __missing__(self, word: str) -> bytes:
        if word.isascii():
            found = self._ascii(word.lower())
        else:  # a capital sigma's lower case depends on its place only in Python
            found = self._any(word.lower() if "Σ" not in word else "σ".join(x.lower() for x in word.split("Σ")))
        ids = self[word] = b"".join(map(self._parts.__getitem__, found))
        return ids


class WordEncoder:
    """Ids of texts as little-endian bytes, equal to the tokenizer's own without its added begin and end.

    The vocabulary's normaliser is NFC and lower case by character, and no piece that PIECES finds
    crosses a space; where the file says so, the ids of words and of pieces seen before are remembered,
    and a new piece goes through the merge model. Texts that hold a special token's string, and all texts under a file of another
    form, go through the tokenizer itself. special_as_text takes special strings for ordinary text.
    """

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = special_as_text
        own = json.loads(self._whole.to_str())
        self._known_form = self._is_known(own)
        self._special = [] if special_as_text else [t["content"] for t in own["added_tokens"]]
        self._parts = _Parts(self._whole.model)
        self._words = _Words(self._parts)

    def forget(self) -> None:
        """Gives back what was remembered; a worker that waits for other stages' tasks keeps the model alone."""
        self._parts.clear()
        self._words.clear()

    @classmethod
    def _is_known(cls, own: dict) -> bool:
        forms = (own["normalizer"] or {}).get("normalizers", [])
        split, *rest = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return (
            [x["type"] for x in forms] == ["NFC", "Replace", "Lowercase"]
            and (forms[1]["pattern"], forms[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": cls.PIECES}, "Removed", True)
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)]
            and own["post_processor"] is None
            and not any(t["normalized"] for t in own["added_tokens"])
        )

    def encode(self, text: str) -> bytes:
        if not self._known_form or any(x in text for x in self._special):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for known in (self._parts, self._words):
            if len(known) >= REMEMBERED:
                known.clear()
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, special_as_text: bool) -> WordEncoder:
    """A worker's own encoder, which outlives its tasks."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and END, cut at capacity."""
    path = path or vocabulary()
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(path, special_as_text)
        encode = own_encoder.encode
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    for n, first in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[first : first + 4 * capacity]
                        rows.append((k, n, first // 4, len(own) // 4, zlib.crc32(own)))
                k, *rest = zip(*rows)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), *(pa.array(x, t) for x, t in zip(rest, kinds))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        own_encoder.forget()

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("piece", "integer")
    for c in ("start", "length", "ids_crc32"):
        schema = schema.add(c, "long")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths are at most capacity."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []

    def put(i: int, k: int) -> None:
        where[i], offset[i] = k, fill[k]
        fill[k] += int(lengths[i])

    def new(i: int) -> int:
        fill.append(0)
        put(i, len(fill) - 1)
        return len(fill) - 1

    large = [int(i) for i in order if 3 * lengths[i] > capacity]
    half = [i for i in large if 2 * lengths[i] <= capacity]
    half.sort(key=lambda i: int(lengths[i]))
    sizes = [int(lengths[i]) for i in half]
    for i in large[: len(large) - len(half)]:
        k = new(i)
        at = bisect_left(sizes, capacity - int(lengths[i]) + 1) - 1
        if at >= 0:
            put(half.pop(at), k)
            sizes.pop(at)
    while half:
        k = new(half.pop())
        if half:
            put(half.pop(), k)
    room = sorted((capacity - f, k) for k, f in enumerate(fill))
    for i in order[len(large) :]:
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            r, k = room.pop(at)
            put(int(i), k)
        else:
            r, k = capacity, new(int(i))
        if r > n:
            insort(room, (r - n, k))
    return where, offset


def best_fit(rows: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """rows with sequence_id and offset; rows has length and is read more than once, so write it first."""
    whole = rows.where(F.col("length") >= capacity)
    rest = rows.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    fields = rows.columns
    schema = T.StructType([*rows.schema]).add("sequence_id", "long").add("offset", "long")

    def run(key, own):
        own = own.select(fields)
        where, offset = pack(own["length"].to_numpy(), capacity)
        own = own.append_column("sequence_id", pa.array(where * shards + key[0].as_py())).append_column("offset", pa.array(offset))
        return own

    dealt = rest.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    packed = dealt.groupBy("__shard").applyInArrow(run, schema)
    alone = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    return best_fit(table(pieces(docs, path, special_as_text=special_as_text), "pieces"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
