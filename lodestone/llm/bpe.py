"""Byte-level BPE encoding and decoding over distinct words.

Texts are split into words in Spark and gathered in chunks of about ``CHUNK_WORDS``.  A chunk's texts become compressed
lists of places in the chunk's own list of distinct words, written once to shared storage, bucketed by chunk.  The lists'
words are shuffled by word, each distinct word is encoded once, and its ids are joined back by chunk and place: a word
travels once for each chunk, however often it occurs, so no word is hot, and nothing is broadcast or collected that grows
with the corpus.  Decoding joins ids to their pieces; the vocabulary is bounded and broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._scratch import Scratch

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE vocabularies; (?U) makes \s mean all white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words after which a task begins another chunk; a longer text is in one chunk all the same.
CHUNK_WORDS = 8_000_000
#: Words of a chunk's list in one row; rows of the shuffle by word whose ids are packed by chunk together.
LIST_WORDS, PACK_ROWS = 50_000, 200_000
#: Texts whose ids are put together at once.
SLICE_TEXTS = 500


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A tokenizer file's contents; travels to the tasks as its text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = spec["model"]["vocab"] | self.special
        self.size = 1 + max(self.pieces.values())

    def __getstate__(self) -> dict:
        return {"text": self.text, "size": self.size}

    @cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.text)
        made.no_truncation()
        made.no_padding()
        return made

    @property
    def kind(self) -> type:
        return np.uint16 if self.size <= 1 << 16 else np.int32

    def piece_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes in order of id, and their offsets."""
        # The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        found = [b""] * self.size
        for piece, k in self.pieces.items():
            found[k] = piece.encode() if piece in self.special else bytes(byte_of[c] for c in piece)
        return _table(found)


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum([0, *map(len, items)])


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of values[start : start + size]."""
    at = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))]


def split_words(text: Column, special: list[str]) -> Column:
    """A text's words as an array; special tokens are words of their own and cut the text around them."""
    words = lambda t: F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    if not special:
        return words(text)
    quoted = ["\\Q" + s + "\\E" for s in sorted(special, key=len, reverse=True)]
    marks = F.regexp_extract_all(text, F.lit("|".join(quoted)), F.lit(0))
    parts = F.split(text, "|".join(quoted), -1)
    pieces = F.transform(parts, lambda t, i: F.when(i > 0, F.concat(F.array(F.element_at(marks, i)), words(t))).otherwise(words(t)))
    has = F.lit(False)
    for s in special:
        has = has | text.contains(s)
    return F.when(has, F.flatten(pieces)).otherwise(words(text))


def _planes(values: np.ndarray) -> bytes:
    """Integers by significance of their bytes, which compresses well."""
    return values.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _chunker(chunk_words: int):
    """Cuts a task's texts into chunks."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts (row, n words, their places in the chunk's list) and of parts of that list (from place n on)."""
        import zstandard

        press, chunk = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        total = 0

        def rows_of(chunk: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            row, lists = (table[c].chunk(0) for c in ("row", "words"))
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            places = coded.indices.to_numpy(zero_copy_only=False)
            texts = [press.compress(_planes(places[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            names, n = ["chunk", "row", "n", "coded", "words"], len(row)
            none = pa.nulls(n, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), row, pa.array(np.diff(edges).astype(np.int32)), pa.array(texts, pa.binary()), none], names)
            words = coded.dictionary
            first = np.arange(0, len(words), LIST_WORDS, dtype=np.int32)
            if len(first):
                parts = pa.ListArray.from_arrays(pa.array(np.append(first, len(words)).astype(np.int32)), words)
                n = len(first)
                none = pa.nulls(n, row.type), pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), none[0], pa.array(first), none[1], parts], names)

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = done = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, done + chunk_words - total, "right")))
                held.append(batch.slice(at, to - at))
                total, at, done = total + int(ends[to - 1]) - done, to, int(ends[to - 1])
                if total >= chunk_words or at < batch.num_rows:
                    yield from rows_of(chunk)
                    held, total, chunk = [], 0, chunk + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield from rows_of(chunk)

    return chunked


def _encoder(vocabulary):
    """Ids of words that come sorted, each distinct word encoded once; packed by chunk, places as differences."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, kind = vocabulary.value.tokenizer, vocabulary.value.kind
        last, last_ids = None, np.zeros(0, kind)
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            chunk, place, size = (np.concatenate([h[k] for h in held]) for k in range(3))
            ids = np.concatenate([h[3] for h in held])
            order = np.lexsort((place, chunk))
            starts = (np.cumsum(size) - size)[order]
            chunk, place, size = chunk[order], place[order], size[order]
            cut = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            columns = [
                pa.array(chunk[cut[:-1]]),
                pa.array([_planes(np.diff(place[a:b], prepend=0)) for a, b in spans], pa.binary()),
                pa.array([_planes(size[a:b]) for a, b in spans], pa.binary()),
                pa.array([_gather(ids, starts[a:b], size[a:b]).tobytes() for a, b in spans], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "places", "sizes", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = [last_ids] if words[0] == last else []
            known += [np.array(e.ids, kind) for e in tokenizer.encode_batch(words[len(known) :], add_special_tokens=False)]
            last, last_ids = words[-1], known[-1]
            sizes = np.fromiter(map(len, known), np.int64, len(known))
            at = coded.indices.to_numpy(zero_copy_only=False)
            ids = _gather(np.concatenate(known), (np.cumsum(sizes) - sizes)[at], sizes[at])
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), sizes[at], ids))
            if sum(len(h[0]) for h in held) >= PACK_ROWS:
                yield packed()
                held = []
        if held:
            yield packed()

    return encoded


def _assembler(vocabulary: Vocabulary, finish):
    """Puts a chunk's texts together; ``finish`` makes result columns of a slice's ids and the edges of its texts."""
    kind = vocabulary.kind

    def assembled(texts: pa.Table, packs: pa.Table) -> pa.Table:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        joined = lambda c, get, none: np.concatenate([get(v) for v in packs[c].to_pylist()] or [np.zeros(0, none)])
        place = joined("places", lambda v: np.cumsum(_unplanes(v)), np.int64)
        size = joined("sizes", _unplanes, np.int32).astype(np.int64)
        ids = joined("ids", lambda v: np.frombuffer(v, kind), kind)
        order = np.argsort(place)
        starts, size = (np.cumsum(size) - size)[order], size[order]
        found = []
        for at in range(0, texts.num_rows, SLICE_TEXTS):
            part = texts.slice(at, SLICE_TEXTS)
            n = part["n"].to_numpy()
            places = np.concatenate([_unplanes(unpress.decompress(c, max_output_size=4 * k + 1)) for c, k in zip(part["coded"].to_pylist(), n.tolist(), strict=True)])
            ends = np.concatenate(([0], np.cumsum(size[places])))
            flat = _gather(ids, starts[places], size[places])
            found.append([part["row"], *finish(flat, ends[np.concatenate(([0], np.cumsum(n)))])])
        columns = [pa.chunked_array([c for x in column for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]) for column in zip(*found, strict=True)]
        return pa.table(columns, names=["row", *finish.names])

    return assembled


def encode_rows(spark: SparkSession, docs: DataFrame, path: str | None, names: list[str], finish, kinds: str, chunk_words: int) -> DataFrame:
    """The columns ``names`` of every row of ``docs`` with what ``finish`` makes of its ids (of types ``kinds``)."""
    vocabulary = Vocabulary(path or default_tokenizer())
    shared = spark.sparkContext.broadcast(vocabulary)
    words = split_words(F.coalesce("text", F.lit("")), list(vocabulary.special)).alias("words")
    rows = docs.select(F.struct(*([F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")])).alias("row"), words)
    chunks = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("row", rows.schema["row"].dataType)])
    chunks = chunks.add("n", T.IntegerType()).add("coded", T.BinaryType()).add("words", T.ArrayType(T.StringType()))
    chunks = Scratch(spark).save_bucketed(rows.mapInArrow(_chunker(chunk_words), chunks), "chunk")
    listed = chunks.filter("words IS NOT NULL").select("chunk", "n", F.posexplode("words").alias("k", "word"))
    listed = listed.select("word", "chunk", (F.col("n") + F.col("k")).alias("place"))
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = listed.repartition(partitions, "word").sortWithinPartitions("word")
    packs = listed.mapInArrow(_encoder(shared), "chunk long, places binary, sizes binary, ids binary")
    texts = chunks.filter("coded IS NOT NULL").select("chunk", "row", "n", "coded")
    both = texts.groupBy("chunk").cogroup(packs.groupBy("chunk"))
    result = T.StructType([texts.schema["row"], *T._parse_datatype_string(kinds).fields])
    done = both.applyInArrow(_assembler(vocabulary, finish), result)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *finish.names)


class _Ids:
    names = ("ids",)

    def __call__(self, flat: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))]


class _Digests:
    """Number of ids, SHA-256 of the decimal ids joined by commas, and SHA-256 of the decoded text; the ids, if asked for."""

    def __init__(self, vocabulary: Vocabulary, with_ids: bool):
        self.names = ("n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
        self.pieces = vocabulary.piece_table()
        self.decimals = _table([b"%d," % k for k in range(vocabulary.size)])

    def __call__(self, flat: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        listed = [sha(raw[:-1]) for raw in _joined(self.decimals, flat, edges)]
        decoded = [sha(raw.decode("utf-8", "replace").encode()) for raw in _joined(self.pieces, flat, edges)]
        ids = _Ids()(flat, edges) if "ids" in self.names else []
        return [pa.array(np.diff(edges)), pa.array(listed, pa.string()), pa.array(decoded, pa.string()), *ids]


def _joined(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each text, its ids' entries of the table one after another."""
    data, offsets = table
    size = np.diff(offsets)[ids]
    raw = _gather(data, offsets[ids], size).tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[edges].tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode_ids(spark: SparkSession, ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids, special tokens included; bytes that are no UTF-8 become replacement characters.

    Each id is looked up in the broadcast table of pieces.  Null arrays give null; ids outside the vocabulary fail.
    """
    pieces = spark.sparkContext.broadcast(Vocabulary(path or default_tokenizer()).piece_table())

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(column), SLICE_TEXTS):
            part = column.slice(at, SLICE_TEXTS)
            counts = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
            texts = _joined(pieces.value, part.flatten().to_numpy(), np.concatenate(([0], np.cumsum(counts))))
            out += [t.decode("utf-8", "replace") if ok else None for t, ok in zip(texts, part.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.string())

    return decoded(ids)


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``docs`` without its text, with ``ids``, as the tokenizers library encodes each whole text without added
    special tokens.

    Null texts count as empty and get an empty array.  Special tokens' strings in a text are special tokens.  Repeated
    rows stay; other columns stay, whatever their names, but one named ids is replaced.  An empty table gives an empty
    result.
    """
    names = [c for c in docs.columns if c not in ("ids", "text")]
    return encode_rows(spark, docs, path, names, _Ids(), "ids array<int>", chunk_words)


def encode_digests(
    spark: SparkSession,
    docs: DataFrame,
    path: str | None = None,
    names: tuple[str, ...] = ("doc_id",),
    with_ids: bool = False,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """The columns ``names`` and ``n_tokens, ids_sha256, decoded_sha256`` for every row: digests of the ids and of their
    decoded text; ``ids`` too, if asked for."""
    digests = _Digests(Vocabulary(path or default_tokenizer()), with_ids)
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return encode_rows(spark, docs, path, list(names), digests, kinds, chunk_words)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded with the 50k byte-level vocabulary and decoded again."""
    return encode_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
