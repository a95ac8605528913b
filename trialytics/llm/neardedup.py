"""MinHash near-duplicate groups, with odd sketches and full-set confirmation.

A document's set is its distinct word shingles. bands x rows MinHash samples of the set put it
into one bucket for each band; documents that share a bucket are candidates. The samples are
also folded into an odd sketch, a parity bitmap: two sketches' XOR has a population count that
estimates high similarities well, and candidates far below the threshold are dropped by it.
Every link is then confirmed on the full sets, as 100 * intersection >= percent * union. With
38 bands of 6 rows a pair at 0.8 shares no bucket with a probability of 1e-5.

No bucket is expanded into pairs. Equal sets are one class. Each member of a bucket is
compared with one hub, chosen anew in every round; confirmed links join documents into
components. After `rounds` hubs only buckets with members of several components go on: their
members outside the bucket's main component are gathered, by main component, in blocks of 64,
and the bucket's members stream past each block, which a task holds in memory. They meet twice:
first odd sketches only, which tells the members that may be near one of another component;
then those members with their texts, which yields the links. So a group of near copies costs a
few comparisons a document; what hubs can't tell apart is quadratic in a bucket's unlinked
members, in sketches (a byte for each pair of them) and, for members whose sketches are near
but whose sets are not linked, in texts.

Texts are fetched for documents of pairs that the sketches allow, and only those are shuffled:
a bitmap of FILTER_BITS hashed ids, of fixed size, is broadcast to drop most others in the scan,
and an exact join drops the rest.

Components come from repeated minima over links with pointer jumping. Each round is written to
the shared folder, so that plans stay small and lost executors cost one round at most.

Nulls and edge cases: documents without words have an empty set, are linked with nothing and
kept. Rows with a null id are linked with nothing, have a null component and are kept. Rows of
one id are one node: their links add up, and of their rows each is returned. Repeated rows are
equal sets. An empty table gives no rows; extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.llm.common import cut, free, mix64, written
from trialytics.session import prepare

SKETCH_BITS = 512
#: Size of the bitmap of hashed ids; the table that is broadcast has a 64th as many rows of two longs.
FILTER_BITS = 1 << 24
#: Odd factors (fixed values).
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class ShingleSets:
    """64-bit hashes of the distinct word shingles of texts; ASCII letters count as lower case, ASCII white space separates."""

    def __init__(self, words: int, room: int = 300_000):
        self.words, self.room, self.known = words, room, {}

    def of(self, text: str | None) -> np.ndarray:
        """Ascending distinct hashes."""
        import xxhash

        split = (text or "").encode().lower().split()
        if not split:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > self.room:
            known.clear()
        for word in set(split).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.fromiter(map(known.__getitem__, split), dtype=np.uint64, count=len(split))
        width = min(self.words, len(split))
        total = np.zeros(len(codes) - width + 1, dtype=np.uint64)
        for at in range(width):
            total = mix64(total * FACTOR + codes[at : at + len(total)])
        return np.unique(total + np.uint64(width))


class MinHash:
    """Band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.size = bands, rows, bands * rows
        rng = np.random.default_rng(20240310)
        self.factors = (rng.integers(0, 1 << 31, self.size, dtype=np.uint64) * 2 + 1).astype(np.uint32)
        self.masks = rng.integers(0, 1 << 32, self.size, dtype=np.uint64).astype(np.uint32)
        self.row_factors = rng.integers(1, 1 << 63, rows).astype(np.uint64)
        self.places = np.arange(self.size, dtype=np.uint64) << np.uint64(32)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.size, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(high), 256):
            np.minimum(least, ((high[at : at + 256, None] ^ self.masks) * self.factors).min(axis=0), out=least)
        return least

    def keys(self, samples: np.ndarray) -> np.ndarray:
        table = samples.astype(np.uint64).reshape(self.bands, self.rows)
        return mix64((table * self.row_factors).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * SECOND).view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> np.ndarray:
        bits = mix64(self.places + samples) % np.uint64(SKETCH_BITS)
        return np.packbits(np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8).view(np.int64)

    def most_odd_bits(self, percent: int) -> int:
        """Differing bits beyond which a pair is not linked: its similarity would have to be missed by five standard deviations."""
        gone = 1 - percent / 100
        differ = min(self.size, self.size * gone + 5 * (self.size * gone * (1 - gone)) ** 0.5)
        odd = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
        return int(odd + 3 * (SKETCH_BITS / 4) ** 0.5 / 2 + 1)


def _odd_bits(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def sketch(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest (of the set), keys (a bucket for each band), odd."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("odd", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sets, maker = ShingleSets(words), MinHash(bands, rows)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hashes = sets.of(text)
                if len(hashes):
                    samples = maker.samples(hashes)
                    out.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), maker.keys(samples), maker.odd_sketch(samples)))
                else:
                    out.append((0, None, None, None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], longs), pa.array(columns[3], longs)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _filter_words(ids: DataFrame) -> DataFrame:
    """word, bits: the bitmap of FILTER_BITS hashed ids (id), for _likely. FILTER_BITS / 64 rows at most, whatever the number of ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    return ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))


def fetch_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text of the rows of docs whose id is in ids (id, no nulls), written to the shared folder."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").withColumn("place", place)
    likely = named.join(F.broadcast(_filter_words(ids)), F.shiftright("place", 6) == F.col("word")).where(F.expr("bit_get(bits, cast(place & 63 as int)) = 1")).select("id", "text")
    return cut(likely.join(ids.hint("merge"), "id", "left_semi"), "texts")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_groups(docs) keeps, with the columns of docs.

    Of rows with one id and one text one stays, and so of rows without an id; rows of one id
    with different texts all stay or go with their id. Only rows whose id may be of a group that
    loses it, or may occur twice, are shuffled: the bitmap of such ids, broadcast, lets all
    others through in the scan, and an exact join decides about the rest.
    """
    mark = "_near_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    key, digest, stays, place, word, bits = (f"{mark}{n}" for n in ("id", "digest", "stays", "place", "word", "bits"))
    known = groups.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    unsure = cut(known.where("not stays or n > 1").select("id", "stays"), "unsure")
    words = F.broadcast(_filter_words(unsure.select("id")).select(F.col("word").alias(word), F.col("bits").alias(bits)))
    placed = docs.where(F.col(id_col).isNotNull()).withColumn(place, F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS)))
    flagged = placed.join(words, F.shiftright(place, 6) == F.col(word), "left")
    likely = F.coalesce(F.expr(f"bit_get(`{bits}`, cast(`{place}` & 63 as int)) = 1"), F.lit(False))
    marked = flagged.where(likely).withColumn(digest, F.sha2(F.col(text_col), 256))
    told = unsure.select(F.col("id").alias(key), F.col("stays").alias(stays)).hint("merge")
    decided = marked.join(told, F.col(id_col) == F.col(key), "left").where(F.coalesce(F.col(stays), F.lit(True))).dropDuplicates([id_col, digest])
    nameless = docs.where(F.col(id_col).isNull()).withColumn(digest, F.sha2(F.col(text_col), 256)).dropDuplicates([digest])
    parts = [flagged.where(~likely), decided, nameless]
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts join by id; pairs of one a come in a row, and its set is made once. Merge joins, so that Spark can split the many pairs of one a over tasks."""
    left, right = (texts.select(F.col("id").alias(n), F.col("text").alias(f"text_{n}")).hint("merge") for n in "ab")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, last, own = ShingleSets(words), None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, own = a, sets.of(a)
                other = sets.of(b)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _meet(members: DataFrame, block: int, stretch: int) -> DataFrame:
    """main, block, stretch, streams, id, component: blocks of members (main, id, component) outside the main component, and stretches of the stream of all members."""
    counts = members.groupBy("main").agg(F.ceil(F.sum((F.col("component") != F.col("main")).cast("long")) / block).alias("blocks"), F.ceil(F.count("*") / stretch).alias("stretches"))
    sized = members.join(counts, "main")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    held = sized.where("component <> main").select("main", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(upto("stretches")).alias("stretch"), F.lit(False).alias("streams"), "id", "component")
    passing = sized.where("blocks > 0").select("main", F.explode(upto("blocks")).alias("block"), F.pmod(F.hash("id"), "stretches").alias("stretch"), F.lit(True).alias("streams"), "id", "component")
    return held.unionByName(passing)


def _by_cell(rows: DataFrame) -> DataFrame:
    """Each block's held members before those that stream past it."""
    cell = ("main", "block", "stretch")
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parallel, *cell).sortWithinPartitions(*cell, "streams", "id")


def compare_blocks(open_rows: DataFrame, sketched: DataFrame, docs: DataFrame, words: int, percent: int, most: int, id_col: str, text_col: str, block: int = 64, stretch: int = 256) -> DataFrame:
    """Links (a, b) between members of different components of a bucket. open_rows: bucket, id, component."""
    sizes = open_rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mains = cut(sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most")).select("bucket", F.col("most.component").alias("main")), "mains")
    placed = cut(open_rows.join(mains.hint("merge"), "bucket").select("main", "id", "component").distinct(), "open")
    kind = open_rows.schema["id"].dataType
    near_schema = T.StructType([T.StructField("main", open_rows.schema["component"].dataType), T.StructField("id", kind)])

    def close(odds: list, parts: list, odd: list, component) -> list[int]:
        """Places of the held members of other components whose sketches are near."""
        bits = np.bitwise_count((np.array(odds, dtype=np.int64) ^ np.array(odd, dtype=np.int64)).view(np.uint64)).sum(axis=1)
        return [at for at in np.flatnonzero(bits <= most).tolist() if parts[at] != component]

    def flag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, parts, odds, told = None, [], [], [], set()
        for batch in batches:
            found = []
            for main, number, stretch_no, streams, doc_id, component, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (main, number, stretch_no):
                    group, ids, parts, odds, told = (main, number, stretch_no), [], [], [], set()
                if not streams:
                    ids.append(doc_id)
                    parts.append(component)
                    odds.append(odd)
                elif ids and (near := close(odds, parts, odd, component)):
                    found += [(main, x) for x in (doc_id, *(ids[at] for at in near)) if x not in told]
                    told.update((doc_id, *(ids[at] for at in near)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (batch.column(0).type, batch.column(4).type), strict=True)], names=["main", "id"])

    columns = ["main", "block", "stretch", "streams", "id", "component", "odd"]
    near = _by_cell(_meet(placed, block, stretch).join(sketched, "id").select(*columns)).mapInArrow(flag, near_schema).distinct()
    chosen = cut(placed.join(cut(near, "near"), ["main", "id"], "left_semi"), "chosen")
    texts = fetch_texts(docs, chosen.select("id").distinct(), id_col, text_col)
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, group, ids, parts, odds, own = ShingleSets(words), None, [], [], [], []
        for batch in batches:
            found = []
            for main, number, stretch_no, streams, doc_id, component, odd, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (main, number, stretch_no):
                    group, ids, parts, odds, own = (main, number, stretch_no), [], [], [], []
                if not streams:
                    ids.append(doc_id)
                    parts.append(component)
                    odds.append(odd)
                    own.append(sets.of(text))
                    continue
                mine = None
                for at in close(odds, parts, odd, component) if ids else ():
                    mine = sets.of(text) if mine is None else mine
                    other = own[at]
                    if 100 * min(len(mine), len(other)) < percent * max(len(mine), len(other)):
                        continue
                    common = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * common >= percent * (len(mine) + len(other) - common):
                        found.append((ids[at], doc_id))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.column(4).type) for x in zip(*found, strict=True)], names=["a", "b"])

    rows = _meet(chosen, block, stretch).join(sketched, "id").join(texts, "id").select(*columns, "text")
    return _by_cell(rows).mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of all ids in links (a, b). Of the labels only the last generation is left behind."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        stepped = cut(lower.join(jump, "new").select("id", F.least("new", "far").alias("component"), (F.least("new", "far") < F.col("component")).alias("changed")), "labels")
        free(labels)
        labels = stepped
        if stepped.where("changed").isEmpty():
            free(both)
            return labels


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 38, rows: int = 6, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id of the group), kept (it is the row's own), one row for each row of docs."""
    sketches = cut(sketch(docs, words, bands, rows, id_col, text_col), "sketches")
    usable = sketches.where("id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("id").alias("rep"))
    classes = cut(classes, "classes")
    heads = usable.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    most = MinHash(bands, rows).most_odd_bits(percent)

    dealt = heads.select(F.explode("keys").alias("bucket"), "id")
    # counted by partial aggregation, written, and joined: a merge join of two plain exchanges, whose large partitions Spark can split
    full = cut(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "full-buckets")
    buckets = cut(dealt.join(full.hint("merge"), "bucket", "left_semi"), "buckets")
    sketched = cut(heads.select("id", "odd").join(buckets.select("id").distinct(), "id", "left_semi"), "odd")

    # one id can stand for several sets (rows that share it): those are linked from the start
    nodes = classes.select("digest", F.col("rep").alias("a"))
    shared = usable.select("digest", "id").join(nodes, "digest").select("a", F.col("id").alias("b")).where("a <> b")
    twice = usable.select("digest", "id").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("b"))
    links = shared.join(twice, "b", "left_semi").select("a", "b").distinct()
    tried = None
    labels = None
    spark, paired = docs.sparkSession, []

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (a < b), each once, not tried yet, that the odd sketches allow."""
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        one, two = (sketched.select(F.col("id").alias(n), F.col("odd").alias(f"odd_{n}")) for n in "ab")
        return pairs.join(one, "a").join(two, "b").withColumn("bits", _odd_bits("odd_a", "odd_b")).where(F.col("bits") <= most)

    def open_buckets() -> DataFrame:
        """Buckets whose members are in several components, with their components."""
        known = buckets if labels is None else buckets.join(labels.select("id", "component"), "id", "left")
        if labels is None:
            return known.withColumn("component", F.col("id"))
        known = known.withColumn("component", F.coalesce("component", "id"))
        several = known.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("bucket")
        return known.join(cut(several, "several").hint("merge"), "bucket", "left_semi")

    for number in range(rounds):
        rows_now = written(spark, open_buckets, "open-buckets") if number else open_buckets()
        place = F.struct((F.col("id") if number == 0 else F.xxhash64(F.col("id"), F.lit(number))).alias("order"), F.col("id").alias("id"), F.col("component").alias("component"))
        hubs = cut(rows_now.groupBy("bucket").agg(F.min(place).alias("hub")), "hubs")
        met = rows_now.join(hubs.hint("merge"), "bucket").where("component <> hub.component")
        pairs = possible(met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")))
        if number == 0:  # at first each document meets only the likeliest of its hubs
            pairs = pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best")).select("best.a", "b")
        pairs = cut(pairs.select("a", "b"), "pairs")
        paired.append(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        both = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        confirmed = written(spark, lambda pairs=pairs, both=both, links=links: links.unionByName(confirm(pairs, fetch_texts(docs, both, id_col, text_col), words, percent)), "links")
        old = (links, labels, hubs, rows_now)
        links, labels = confirmed, components(confirmed)
        free(*old)
    left = written(spark, lambda: open_buckets().select("bucket", "id", "component"), "open-buckets")
    found = written(spark, lambda: links.unionByName(compare_blocks(left, sketched, docs, words, percent, most, id_col, text_col).distinct()), "links")
    old, labels = labels, components(found)
    free(old, links, found, left, full, buckets, sketched, *paired)

    grouped = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    placed = sketches.select("id", "n_shingles", "digest").join(grouped, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return placed.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
