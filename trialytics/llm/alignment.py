"""Alignment of two tokenizers over the same texts.

Tokenizer A is a byte-level BPE (a `tokenizers` file), B a sentence-piece model; both see a
text with a space before it. Whole Arrow batches are worked on at once: all tokens of A, and
all of B, lie one after the other with the byte offsets at which they end, documents being
ranges of bytes. One bincount of both lists of ends marks the offsets with one or two ends:

- where both end, a group ends: the least stretches that both tokenizers cut out alike;
- from each marked offset back to the one before it, one token of A and one of B overlap, and
  no two of them overlap twice: the marked offsets are the links;
- prefix sums of the marks, taken at the documents' bounds, give each document's numbers.

A pair of ids counts the documents that hold it linked, over the whole corpus. The tokens are
made once: what later steps need is written per document, as numbers into the sorted pairs of
its block (documents of about block_bytes of text of one task). Blocks tell how many of their
documents hold each pair; that is summed by pair, and the sums come back by block: a pair, be
it in every document, is one row a block. Only then block and documents meet, so that no row
a link is ever shuffled. The best count of each id of A is a table of the vocabulary's size,
which is broadcast: of A's size at most, whatever the corpus.

Nulls and edge cases: a document without tokens (null, empty, or with joined token bytes of A
or B that aren't the text with its space) has zeros and ''. Null ids are passed through; every
row is a document, repeated ones too; further columns are ignored; an empty table gives no
rows. A batch is worked on in stretches of about 1 MB of text or one longer text, in a few
dozen times its memory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.llm.common import cut, shared_folder
from trialytics.llm.tokens import byte_letters
from trialytics.session import prepare

#: How byte-level vocabularies cut texts before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STRETCH = 1 << 20
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel:
    """Ids of a byte-level BPE file, texts of special tokens being plain text.

    Where the file's merges are in the order of their ids, as in ranks, the ids are made by
    `tiktoken` from the file's own vocabulary, in a third of the time; else by `tokenizers`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letter = {c: b for b, c in byte_letters().items()}
        vocabulary = told["model"]["vocab"]
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in told["added_tokens"])]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(letter.__getitem__, token)) if letter.keys() >= set(token) else token.encode()
        for token in told["added_tokens"]:
            self.bytes[token["id"]] = token["content"].encode()
        own = {t["content"] for t in told["added_tokens"]}
        self.fast = self._ranks(told, {self.bytes[i]: i for t, i in vocabulary.items() if t not in own})

    @staticmethod
    def _ranks(told: dict, ranks: dict[bytes, int]):
        before, model, vocabulary = told["pre_tokenizer"] or {}, told["model"], told["model"]["vocab"]
        merges = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        merged = set(merges)
        ordered = merges == sorted(merged) and all(len(t) == 1 for t, i in ranks.items() if i not in merged)
        if told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or model.get("ignore_merges") or not ordered:
            return None
        import tiktoken

        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        # beyond this length a run of white space would exhaust the pattern's matcher
        if self.fast is None or len(text) > 500_000:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class Pieces:
    """Ids of a sentence-piece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Vocabulary:
    """The bytes of ids, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        return self.pool[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the segments between neighbouring bounds, by prefix sums."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return np.diff(sums[bounds])


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if lists else np.zeros(0, dtype=np.int64), bounds


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.of_a, self.of_b = Vocabulary(self.a.bytes), Vocabulary(self.b.bytes)
        self.size_b = len(self.b.bytes)
        self.shift = len(self.a.bytes)
        words = [str(i).encode() for n in (self.shift, self.size_b) for i in range(n)]
        # a token's text before another of its side, at the end of A's side and at the end of B's
        self.told = [w + b"," for w in words] + [w + b"|" for w in words[: self.shift]] + [w + b";" for w in words[self.shift :]]

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of A and of B of each text; none of both for a text that either doesn't give back."""
        a, b = [self.a.encode(" " + t) if t else () for t in texts], self.b.encode(texts)
        (ids_a, bounds_a), (ids_b, bounds_b) = _flat(a), _flat(b)
        data = [b" " + t.encode() if t else b"" for t in texts]
        size = np.array([len(d) for d in data], dtype=np.int64)
        right = (totals(self.of_a.length[ids_a], bounds_a) == size) & (totals(self.of_b.length[ids_b], bounds_b) == size)
        # of texts with the right length the bytes are compared, all at once
        places = np.flatnonzero(right)
        want = np.frombuffer(b"".join(data[i] for i in places), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum(size[places])])
        for ids, vocabulary in ((a, self.of_a), (b, self.of_b)):
            odd = vocabulary.joined(_flat([ids[i] for i in places])[0]) != want
            right[places[totals(odd, bounds) > 0]] = False
        return [x if ok else () for x, ok in zip(a, right, strict=True)], [x if ok else () for x, ok in zip(b, right, strict=True)]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(NUMBERS by row, groups by row as text; of each distinct pair of a text: the text's place, pair and links)."""
        a, b = self.encode(texts)
        (ids_a, bounds_a), (ids_b, bounds_b) = _flat(a), _flat(b)
        ends_a, ends_b = np.cumsum(self.of_a.length[ids_a]), np.cumsum(self.of_b.length[ids_b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        count = np.bincount(np.concatenate([ends_a, ends_b]), minlength=size + 1)
        # how many offsets up to each one are marked, and how many are marked twice
        links, groups = np.cumsum(count > 0), np.cumsum(count == 2)
        edge = np.concatenate([[0], ends_a])[bounds_a]
        numbers = np.stack([np.diff(bounds_a), np.diff(bounds_b), np.diff(groups[edge]), np.diff(links[edge])])
        places = np.flatnonzero(count)
        pair = ids_a[np.searchsorted(ends_a, places)] * self.size_b + ids_b[np.searchsorted(ends_b, places)]
        text = np.repeat(np.arange(len(texts)), numbers[3])
        order = np.lexsort((pair, text))
        pair, text = pair[order], text[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), dtype=bool), (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])]))
        times = np.diff(np.append(first, len(pair)))
        return numbers, self.written(ids_a, ends_a, ids_b, ends_b, count, groups, edge), text[first], pair[first], times

    def written(self, ids_a, ends_a, ids_b, ends_b, count, groups, edge) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        group = np.concatenate([groups[ends_a - 1], groups[ends_b - 1]])
        side = np.concatenate([np.zeros(len(ids_a), dtype=np.int64), np.ones(len(ids_b), dtype=np.int64)])
        code = np.concatenate([ids_a, ids_b + self.shift]) + (self.shift + self.size_b) * (count[np.concatenate([ends_a, ends_b])] == 2)
        order = np.argsort(2 * group + side, kind="stable")
        parts = list(map(self.told.__getitem__, code[order].tolist()))
        bounds = np.searchsorted(group[order], groups[edge])
        return [b"".join(parts[i:j])[:-1].decode() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def pack(*columns: np.ndarray) -> bytes:
    """Numbers below 2^32 as bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(np.stack(columns).astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4").reshape(columns, -1).astype(np.int64)


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Places from and to, of STRETCH characters at most or one text."""
    first = held = 0
    for at, text in enumerate(texts):
        if held and held + len(text) > STRETCH:
            yield first, at
            first, held = at, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


class Block:
    """Documents of one task until they are written: their rows, and their pairs."""

    def __init__(self, number: int):
        self.number, self.held, self.rows, self.pairs, self.times, self.sizes = number, 0, [], [], [], []

    def add(self, ids: pa.Array, texts: list[str], done: tuple, with_groups: bool) -> None:
        numbers, groups, text, pair, times = done
        hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        self.rows.append((ids, numbers, hashes, groups if with_groups else [None] * len(groups)))
        self.pairs.append(pair)
        self.times.append(times)
        self.sizes.append(np.bincount(text, minlength=len(texts)))
        self.held += sum(map(len, texts))

    def batches(self, schema: T.StructType, names: list[str], width: int) -> Iterator[pa.RecordBatch]:
        """The documents' rows, and rows of the block's pairs, width at a time."""
        pairs, which, docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        times = np.concatenate(self.times)
        at = 0
        for (ids, numbers, hashes, groups), sizes in zip(self.rows, self.sizes, strict=True):
            packed = []
            for size in sizes.tolist():
                own = which[at : at + size]
                packed.append(pack(np.diff(own, prepend=0), times[at : at + size]) if size else None)
                at += size
            n = len(hashes)
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(["document"] * n), pa.array([self.number] * n, pa.int64()), ids, *(pa.array(x, pa.int64()) for x in numbers), pa.array(hashes, pa.string()), pa.array(groups, pa.string()), pa.array(packed, pa.binary()), none, none], names=names)
        for at in range(0, len(pairs), width):
            lists = [pa.array([x[at : at + width]], pa.list_(pa.int64())) for x in (pairs, docs)]
            empty = [pa.nulls(1, kind) for kind in (self.rows[0][0].type, *[pa.int64()] * len(NUMBERS), pa.string(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(["pairs"]), pa.array([self.number], pa.int64()), *empty, *lists], names=names)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, block_bytes: int, with_groups: bool) -> DataFrame:
    """Rows of kind "document": id, NUMBERS, hash and text of the groups, packed pairs; of kind "pairs": a block's pairs and the number of its documents that hold each."""
    prepare(docs.sparkSession)
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("block", long), ("id", docs.schema[id_col].dataType), *((n, long) for n in NUMBERS), ("groups_sha256", T.StringType()), ("groups", T.StringType()), ("packed", T.BinaryType()), ("pairs", longs), ("docs", longs))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, task = Aligner(a_path, b_path), TaskContext.get().partitionId()
        block = Block(task << 32)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in _stretches(texts):
                part = texts[first:last]
                block.add(batch.column(0).slice(first, last - first), part, aligner.align(part), with_groups)
                if block.held >= block_bytes:
                    yield from block.batches(schema, schema.names, 65536)
                    block = Block(block.number + 1)
        if block.rows:
            yield from block.batches(schema, schema.names, 65536)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
    """id, NUMBERS, n_best, count_sum, groups_sha256 of each row; with_groups also groups, the alignment itself."""
    spark = docs.sparkSession
    rows = aligned(docs, a_path, b_path, id_col, text_col, block_bytes, with_groups)
    path = shared_folder(spark, "aligned")
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    written = lambda kind: spark.read.schema(rows.schema).parquet(path).where(F.col("kind") == kind)
    size_b = len(Pieces(b_path).bytes)
    held = written("pairs").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = cut(held.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    own = F.expr(f"pair div {size_b}").alias("a")
    best = counts.groupBy(own).agg(F.max("count").alias("best"))  # a row for each id of A at most
    judged = counts.withColumn("a", own).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    known = held.select("block", "pair").join(judged, "pair")
    outer = written("document").select("block", "id", *NUMBERS, "groups_sha256", "groups", "packed")
    names = [*NUMBERS, "n_best", "count_sum"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("groups_sha256", T.StringType()), *([T.StructField("groups", T.StringType())] if with_groups else [])])

    def finish(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs.column("pair").to_numpy())
        count = pairs.column("count").to_numpy()[order]
        is_best = pairs.column("is_best").to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for data in documents.column("packed").to_pylist():
            which, times = unpack(data, 2) if data else np.zeros((2, 0), dtype=np.int64)
            which = np.cumsum(which)
            n_best.append(int(times[is_best[which]].sum()) if len(which) else 0)
            count_sum.append(int((times * count[which]).sum()) if len(which) else 0)
        columns = [documents.column("id"), *(documents.column(n) for n in NUMBERS), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), documents.column("groups_sha256"), *([documents.column("groups")] if with_groups else [])]
        return pa.table(columns, names=schema.names)

    return outer.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(finish, schema)
