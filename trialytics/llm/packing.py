"""Packing of documents into training sequences, by an order-preserving dynamic programme.

Each input partition is packed on its own and in its own order, so nothing is shuffled: a
scan's tasks tokenise, choose the cuts and emit the pieces. Memory is bounded by block_chars,
block_tokens and the longest document; what a block leaves in its last, unfinished sequence moves on into
the next block, so only the last sequence of a partition is padded for want of text.

The cuts of a block minimise padding + penalties. Possible cuts are document ends (free),
sentence ends (sentence_cut) and, where no boundary comes for long, every stride tokens
(hard_cut). With p(j) the position of cut j, the transition

    f(j) = penalty(j) + sequence_cost + min over i, p(j) - seq_len <= p(i) < p(j), of f(i) + pad(p(j) - p(i))

has pad(n) = seq_len - n, so that the minimum is one of f(i) + p(i) over a sliding window: a
monotone queue gives it in constant amortised time. Lengths that are powers of two need no
padding; those few predecessors are looked at besides.

Nulls and edge cases: a null text is an empty one (it yields the end token alone); a null
doc_id is passed through; repeated rows are packed like any other rows; an empty table gives
no rows; further columns are ignored. Very long texts are cut over as many sequences as needed.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trialytics.session import prepare

#: Characters that Arrow takes for white space and the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Chunks whose ids are put in place at once.
GATHERED = 1 << 16
#: A word of letters below U+0250 (in normal form C; but for one whose lower case is two), alone or before a mark.
WORD_CHUNK = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,!?;:]?$"


class ChunkEncoder:
    """Token ids by a `tokenizers` file whose pre-tokenizer never joins text over white space.

    Texts are split at white space and their distinct chunks are encoded once a call, `room` at
    a time: words, and words with one punctuation mark, as one text by the tokenizer's own model
    behind a plain split at spaces, told apart by the tokens that end a word; other chunks one by
    one. So are texts in which Arrow and the tokenizer disagree on what white space is. A call's
    memory is a few times its texts; nothing is kept from call to call.
    """

    def __init__(self, path: str, room: int = 16384):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        with open(path, encoding="utf-8") as file:
            plain = json.load(file)
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain |= {"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,!?;:"}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pool(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each chunk's, number of each chunk's)."""
        simple = pc.match_substring_regex(chunks, WORD_CHUNK).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(simple)
        known = chunks.take(pa.array(places))
        mark = np.zeros(len(places), dtype="<u4")
        for letter, number in self.marks.items():
            mark[pc.ends_with(known, letter).to_numpy(zero_copy_only=False)] = number
        cores = pc.utf8_lower(pc.utf8_rtrim(known, "".join(self.marks))).dictionary_encode()
        word_ids, stops, before = [], [np.zeros(1, dtype=np.int64)], 0
        for at in range(0, len(cores.dictionary), self.room):
            part = cores.dictionary.slice(at, self.room).to_pylist()
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                raise ValueError("the tokenizer doesn't keep words apart")
            word_ids.append(ids)
            stops.append(before + ends)
            before += len(ids)
        stops, core = np.concatenate(stops), cores.indices.to_numpy(zero_copy_only=False)
        length = np.diff(stops)[core]
        own = length + (mark > 0)
        total = int(own.sum())
        first = np.cumsum(own) - own
        start, size = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        start[places], size[places] = first, own
        made = [np.zeros(total, dtype="<u4")]
        if total:
            index = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            made[0][np.repeat(first, length) + index] = np.concatenate(word_ids)[np.repeat(stops[core], length) + index]
            made[0][(first + length)[mark > 0]] = mark[mark > 0]
        places = np.flatnonzero(~simple)
        for at in range(0, len(places), self.room):
            own = places[at : at + self.room]
            for place, got in zip(own.tolist(), self.tokenizer.encode_batch_fast(chunks.take(pa.array(own)).to_pylist(), add_special_tokens=False), strict=True):
                ids = np.array(got.ids, dtype="<u4")
                start[place], size[place] = total, len(ids)
                made.append(ids)
                total += len(ids)
        return np.concatenate(made) if made else np.zeros(0, dtype="<u4"), start, size

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, the place at which each text's end)."""
        odd = [i for i, t in enumerate(texts) if any(c in t for c in SEPARATORS)]
        listed = texts
        if odd:
            listed = list(texts)
            for i in odd:
                listed[i] = ""
        split = pc.utf8_split_whitespace(pa.array(listed, pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        pool, start, size = self.pool(chunks.dictionary)
        index = chunks.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(size[index])
        bounds = np.append(0, ends)[split.offsets.to_numpy()[1:]]
        ids = np.empty(ends[-1] if len(ends) else 0, dtype="<u4")
        for at in range(0, len(index), GATHERED):
            part = index[at : at + GATHERED]
            sizes = size[part]
            own = np.cumsum(sizes)
            end = int(ends[at + len(part) - 1])
            ids[end - int(own[-1]) : end] = pool[np.repeat(start[part] - (own - sizes), sizes) + np.arange(own[-1])]
        if odd:
            parts = np.split(ids, bounds[:-1])
            for i in odd:
                parts[i] = np.frombuffer(self.ids(texts[i]), dtype="<u4")
            ids, bounds = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        ids, bounds = self.encode_all(texts)
        return [part.tobytes() for part in np.split(ids, bounds[:-1])]

    def sentence_ends(self) -> np.ndarray:
        """Ids of the tokens that end a sentence."""
        vocabulary = self.tokenizer.get_vocab()
        return np.array(sorted(i for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4] and set(t[:-4]) <= set(".!?")), dtype=np.uint32)


#: Encoders by file, kept from task to task in a worker: reading the file takes a second.
ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = ChunkEncoder(path)
    return ENCODERS[path]


def choose_cuts(places: np.ndarray, penalties: np.ndarray, seq_len: int, sequence_cost: int = 2) -> np.ndarray:
    """Indices of the chosen cuts, first and last included.

    places: ascending positions, places[0] the start; no gap may exceed seq_len.
    """
    count = len(places)
    index, before = [], []
    k = 1
    while k < seq_len:
        at = np.searchsorted(places, places - k)
        hit = np.flatnonzero((places - k >= places[0]) & (places[np.minimum(at, count - 1)] == places - k))
        index.append(hit)
        before.append(at[hit])
        k *= 2
    index, before = np.concatenate(index), np.concatenate(before)
    order = np.argsort(index, kind="stable")
    starts = np.searchsorted(index[order], np.arange(count + 1)).tolist()
    before = before[order].tolist()
    p, penalty = places.tolist(), penalties.tolist()
    cost, back, key = [0] * count, [0] * count, [0] * count
    key[0] = p[0]
    queue, head = [0], 0
    for j in range(1, count):
        at = p[j]
        least = at - seq_len
        while p[queue[head]] < least:
            head += 1
        i = queue[head]
        best = key[i] + seq_len - at
        for other in before[starts[j] : starts[j + 1]]:
            if cost[other] < best:
                best, i = cost[other], other
        best += penalty[j] + sequence_cost
        cost[j], back[j] = best, i
        best += at
        key[j] = best
        while len(queue) > head and key[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
        if head > 65536:
            del queue[:head]
            head = 0
    cuts = [count - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return np.array(cuts[::-1])


class Packer:
    """Packs the documents of one partition, block by block."""

    def __init__(self, partition: int, seq_len: int, ends: np.ndarray, sentence_cut: int, hard_cut: int, sequence_cost: int):
        self.base, self.made = partition << 33, 0
        self.is_end = np.zeros(1 << 20, dtype=bool)  # by id
        self.is_end[ends] = True
        self.seq_len, self.sentence_cut, self.hard_cut, self.sequence_cost = seq_len, sentence_cut, hard_cut, sequence_cost
        self.docs: list[tuple] = []  # id, tokens before this part, all tokens, the part's ids
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces (doc_id, start, length, crc32, doc_tokens, sequence, offset, ids); unless last, the last sequence's text stays."""
        if not self.docs:
            return []
        bounds = np.concatenate([[0], np.cumsum([len(d[3]) for d in self.docs])])
        ids = np.concatenate([d[3] for d in self.docs])
        penalty = np.full(len(ids) + 1, -1, dtype=np.int64)
        penalty[np.flatnonzero(self.is_end[ids]) + 1] = self.sentence_cut
        penalty[bounds] = 0
        places = np.flatnonzero(penalty >= 0)
        stride = self.seq_len // 4
        wide = np.flatnonzero(np.diff(places) > stride)
        for at in wide:
            penalty[places[at] + stride : places[at + 1] : stride] = self.hard_cut
        if len(wide):
            places = np.flatnonzero(penalty >= 0)
        cuts = places[choose_cuts(places, penalty[places], self.seq_len, self.sequence_cost)]
        if not last:
            cuts = cuts[:-1]
        edges = np.unique(np.concatenate([bounds[bounds <= cuts[-1]], cuts]))
        begin, end = edges[:-1], edges[1:]
        doc = np.searchsorted(bounds, begin, side="right") - 1
        sequence = np.searchsorted(cuts, begin, side="right") - 1
        offset = begin - cuts[sequence]
        out = []
        for a, b, d, s, o in zip(begin.tolist(), end.tolist(), doc.tolist(), sequence.tolist(), offset.tolist(), strict=True):
            doc_id, skipped, total, _ = self.docs[d]
            piece = ids[a:b]
            out.append((doc_id, a - int(bounds[d]) + skipped, b - a, zlib.crc32(piece), total, self.base + self.made + s, o, piece))
        self.made += len(cuts) - 1
        kept = int(cuts[-1])
        rest = []
        for d in range(int(np.searchsorted(bounds, kept, side="right")) - 1, len(self.docs)):
            doc_id, skipped, total, part = self.docs[d]
            gone = max(0, kept - int(bounds[d]))
            if gone < len(part):
                rest.append((doc_id, skipped + gone, total, part[gone:].copy()))
        self.docs, self.size = rest, sum(len(d[3]) for d in rest)
        return out


def pack_sequences(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, sentence_cut: int = 4, hard_cut: int = 64,
    sequence_cost: int = 2, block_tokens: int = 1 << 20, block_chars: int = 1 << 23, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the ids.

    See the module's docstring for the method and for what becomes of nulls and edge cases.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from trialytics.llm import packing  # by name, so that the worker's own module keeps the encoders

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        encoder = packing.encoder_of(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId(), seq_len, encoder.sentence_ends(), sentence_cut, hard_cut, sequence_cost)
        id_type = None

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            arrays = [pa.array(columns[0], type=id_type), *(pa.array(c, type=pa.int64()) for c in columns[1:7])]
            names = [f.name for f in fields]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in columns[7]], type=pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def packed(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            tokens, bounds = encoder.encode_all(texts)
            begin = 0
            for doc_id, stop in zip(ids, bounds.tolist(), strict=True):
                packer.add(doc_id, np.append(tokens[begin:stop], end))
                begin = stop
                if packer.size >= block_tokens and (pieces := packer.flush(False)):
                    yield table(pieces)

        wait_ids, wait_texts, size = [], [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wait_ids.append(doc_id)
                wait_texts.append(text or "")
                size += len(wait_texts[-1])
                if size >= block_chars:
                    yield from packed(wait_ids, wait_texts)
                    wait_ids, wait_texts, size = [], [], 0
        if wait_ids:
            yield from packed(wait_ids, wait_texts)
        if pieces := packer.flush(True):
            yield table(pieces)

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
