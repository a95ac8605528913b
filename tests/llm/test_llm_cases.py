"""Edge cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA  # noqa: F401
from pyspark.sql import functions as F

from trialytics.llm import bitsliced, fingerprints, linededup, mixing, neardedup, packing, suffixarray, suffixdedup, tokens, toxicity, warc
from trialytics.llm.queries import tokenizer

random.seed(11)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(60, i) for i in range(300))
TEXTS = [None, "", " ", "x", prose(80, 1), prose(80, 1), prose(80, 1) + " z", "a " * 3000, "ab" * 5000, LONG, LONG.upper(), "\n".join(["same line"] * 200), "né " + prose(70, 2), "\x1c\x85 odd   space"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, score double, anchor long, bucket long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None, "i", "k", 0.5, 1, 2) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, prose(80, 1), "en", "s", 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (4, prose(30, 9), "en", "s", 1, "a", "b", 1.0, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_every_operator_takes_odd_rows(spark, docs):
    count = docs.count()
    vocabulary = tokenizer("word_bpe_49k.json")
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (9, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    for frame in (docs, docs.where("false")):
        n = frame.count()
        assert suffixdedup.remove_repeats(frame, 400).count() == n
        assert fingerprints.fingerprint(frame).count() == n
        assert fingerprints.compare_with_edits(frame).count() == n
        assert neardedup.near_groups(frame, words=2).count() == n
        assert tokens.count_tokens(frame, vocabulary).count() == n
        assert linededup.dedup_lines(frame).count() == n
        assert toxicity.score(frame, model).count() == n
        assert mixing.calibrated(frame, {"source": 0.5, "lang": {"en": 1.0}, "topic": 1.0}, 0.5).count() == n
        assert packing.pack_sequences(frame, vocabulary).agg(F.count_distinct("doc_id")).head()[0] == (len(TEXTS) if n else 0)
    assert count == len(TEXTS) + 4


def test_near_groups_of_odd_rows(docs):
    got = neardedup.near_groups(docs, words=2).collect()
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 4)}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id == 4} == {4}
    assert by_id[5].component_id == by_id[6].component_id == 4
    assert by_id[10].component_id == 9 and not by_id[10].kept
    assert by_id[0].n_shingles == by_id[1].n_shingles == 0 and by_id[0].kept and by_id[1].kept


def test_near_groups_find_chains(spark):
    """Documents that are linked only through others; a crowd of variants beside the threshold."""
    base = prose(120, 5).split()
    rows, rng = [], random.Random(3)
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.randint(0, 14)):
            own[at] = f"w{i}x{at}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, t in rows for w in [t.split()]}
    group = dict.fromkeys(sets)
    for i in sets:
        group[i] = i
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if group[b] < group[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a], changed = group[b], True
    got = neardedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == group


def test_suffix_dedup_of_odd_rows(docs):
    got = suffixdedup.remove_repeats(docs, 400, crowd=4096).collect()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[9].n_removed == 0 and by_id[7].n_removed == by_id[7].n_bytes and by_id[8].n_removed == by_id[8].n_bytes
    assert by_id[5].n_removed == by_id[5].n_bytes and by_id[0].n_bytes == 0


@pytest.mark.parametrize("crowd", [1, 4096])
def test_suffix_dedup_against_brute_force(spark, crowd):
    from test_llm_queries import brute_repeats

    rng = random.Random(7)
    parts = [prose(40, s) for s in range(6)]
    texts = [" ".join(rng.choice(parts)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 5))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffixdedup.remove_repeats(frame, 100, gram=32, crowd=crowd).collect()}
    assert got == {i: int(m.sum()) for i, m in enumerate(brute_repeats([t.encode() for t in texts], 100))}


def test_suffix_dedup_spills(spark, monkeypatch):
    """One shard whose queues keep 50 tuples of several thousand; the result stays exact, and nothing is left behind."""
    from test_llm_queries import brute_repeats

    rng = random.Random(8)
    parts = [prose(40, s) for s in range(5)]
    texts = [" ".join(rng.choice(parts)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 5))) for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in suffixdedup.remove_repeats(frame, 100, gram=32, room=50).collect()}
    assert got == {i: int(m.sum()) for i, m in enumerate(brute_repeats([t.encode() for t in texts], 100))}


def test_queues_spill_in_order(tmp_path):
    queues = suffixarray.BucketQueues(str(tmp_path / "queues"), 10)
    pushed = defaultdict(list)
    for at in range(40):
        letter = at % 3
        queues.push(letter, np.arange(at * 4, at * 4 + 4, dtype=np.int32), np.full(4, at, dtype=np.int32))
        pushed[letter] += range(at * 4, at * 4 + 4)
    assert queues.written > 5 and queues.held <= 10
    assert {c: np.concatenate([p for p, _ in queues.runs(c)]).tolist() for c in range(3)} == pushed
    queues.close()
    assert not (tmp_path / "queues").exists()


def test_suffix_dedup_of_very_long_texts_and_shared_ids(spark):
    """A repeat across the places where a long text is dealt with in stretches, and rows of one id, or none, kept apart."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    common, long, lone = noise(900), noise(suffixdedup.STRETCH + 300), noise(700)
    a = long[: suffixdedup.STRETCH - 450] + common + long[suffixdedup.STRETCH - 450 :]
    rows = [(1, a), (2, noise(50) + common), (None, lone), (None, common + "x"), (None, None), (3, lone[:399]), (3, noise(800))]
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in got)
    assert found == sorted([(1, len(a), 900, 1), (2, 950, 900, 1), (0, 700, 0, 0), (0, 901, 900, 1), (0, 0, 0, 0), (3, 399, 0, 0), (3, 800, 0, 0)])


def test_suffix_array(tmp_path):
    rng = random.Random(2)
    for trial in range(60):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        parts = [bytes(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 6))]
        parts.append(parts[0] + parts[-1])
        text, _ = suffixarray.join_texts(parts)
        cap = rng.choice([3, 50])
        runs = list(suffixarray.Sorter(text, cap, str(tmp_path / str(trial)), rng.choice([4, 1 << 20])).stream())
        order, shared = np.concatenate([r[0] for r in runs]).tolist(), np.concatenate([r[1] for r in runs]).tolist()
        letters = text.tolist()
        assert sorted(order) == list(range(len(letters)))
        for x, y, n in zip(order, order[1:], shared[1:], strict=False):
            a, b = letters[x : x + cap], letters[y : y + cap]
            assert a >= b and n == next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def test_line_dedup_rules(spark):
    long = prose(60, 3)
    rows = [(1, f"{long}\nown one"), (2, f"head\n{long}\nown two"), (3, "short\nshort"), (4, "\n".join(["a b"] * 60))]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "head\nown two" and got[3] == "short\nshort"
    assert got[4] == "a b"


def test_packing_choice():
    places = np.array([0, 5, 8, 12, 20])
    penalties = np.array([0, 3, 0, 3, 0])
    cuts = places[packing.choose_cuts(places, penalties, 10, 0)].tolist()
    best = min((cost(c), c) for c in _all_cuts(places.tolist(), 10) for cost in [lambda c: sum((10 - (b - a)) * ((b - a) & (b - a - 1) != 0) + penalties[places.tolist().index(b)] for a, b in zip(c, c[1:], strict=False))])
    assert sum((10 - (b - a)) * ((b - a) & (b - a - 1) != 0) + penalties[places.tolist().index(b)] for a, b in zip(cuts, cuts[1:], strict=False)) == best[0]


def test_packing_costs_the_optimum():
    """Padding and penalties of the chosen cuts, against all ways to cut small places."""
    rng = random.Random(12)
    for _ in range(200):
        seq_len = rng.choice([6, 10, 13])
        places = [0]
        while len(places) < rng.randint(3, 11):
            places.append(places[-1] + rng.randint(1, seq_len))
        penalties = [0, *(rng.choice([0, 3, 7]) for _ in places[1:])]
        cost = lambda cuts: sum((0 if (n := b - a) & (n - 1) == 0 else seq_len - n) + penalties[places.index(b)] + 2 for a, b in zip(cuts, cuts[1:], strict=False))
        made = np.array(places)[packing.choose_cuts(np.array(places), np.array(penalties), seq_len, 2)].tolist()
        assert cost(made) == min(map(cost, _all_cuts(places, seq_len)))


def _all_cuts(places, most):
    if len(places) == 1:
        return [places]
    return [[places[0], *rest] for i in range(1, len(places)) if places[i] - places[0] <= most for rest in _all_cuts(places[i:], most)]


def test_encoder_equals_tokenizer():
    encoder = packing.ChunkEncoder(tokenizer("word_bpe_49k.json"), room=50)
    texts = [t or "" for t in TEXTS] + ["Don't STOP, it's 3.14!", "ﬁne Å é İstanbul ΟΔΟΣ", "<|endoftext|> x<|startoftext|>y", "ñ ñandú...", "日本語 テスト。", "a\x1cb"]
    assert encoder.encode(texts) == [encoder.ids(t) for t in texts]


def test_encoding_takes_few_bytes_a_token():
    """Arrays of a call: the ids, the chunks' ends, and no index of all tokens beside them."""
    import tracemalloc

    encoder = packing.ChunkEncoder(tokenizer("word_bpe_49k.json"))
    texts = ["the cat, and the dog. " * 1000] * 100
    tracemalloc.start()
    try:
        ids, bounds = encoder.encode_all(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (np.diff(bounds) == bounds[0]).all() and bounds[0] == len(encoder.ids(texts[0])) // 4 and ids[: bounds[0]].tobytes() == encoder.ids(texts[0]) == ids[-bounds[0] :].tobytes()
    assert peak < 24 * len(ids)


def test_sketches():
    maker = fingerprints.BottomK(64, 5)
    a, b = prose(300, 1).encode(), prose(300, 2).encode()
    whole = maker.lowest(np.concatenate([maker.hashes(a), maker.hashes(b)]))
    assert (maker.merge(maker.sketch(a), maker.sketch(b)) == whole).all()
    assert maker.resemblance(maker.sketch(a), maker.sketch(a)) == 1.0 and maker.containment(maker.sketch(a), maker.sketch(a + a)) > 0.9
    assert (maker.from_hex(maker.to_hex(whole)) == whole).all()
    true = len({a[i : i + 5] for i in range(len(a) - 4)})
    assert maker.distinct(maker.sketch(a)) == pytest.approx(true, rel=0.4)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 4).round(1).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [0.1, 0.2]), (None, [1.0] * 4), (100, rows[100][1]), (304, [1e30, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = bitsliced.top_k(frame.where("vec_id <> 304"), F.col("vec_id") % 100 == 0, 10, block_rows=64).collect()
    usable = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and i != 304 and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in usable:
        if q % 100 == 0 and len(x) == 4:
            best = sorted(((-int(x @ y), i) for i, y in usable if i != q and len(y) == 4))[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="too large to be quantised"):  # its floor(1024 x) has no exact score in a long
        bitsliced.top_k(frame, F.col("vec_id") % 100 == 0, 10).count()


def test_top_k_on_a_grid(spark):
    """Several rows and columns of the grid, with queries of unlike lengths in one column."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 3 + i % 2).tolist()) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = bitsliced.top_k(frame, F.col("vec_id") % 5 == 0, 3, block_rows=128, query_rows=8, column_queries=30)
    exact = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows}
    want = [(q, r, i, -s) for q in range(0, 500, 5) for r, (s, i) in enumerate(sorted((-int(exact[q] @ exact[i]), i) for i in exact if i != q and i % 2 == q % 2)[:3], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" not in plan


def test_fingerprints_of_a_hot_id(spark):
    """Most rows share an id, or have none: they are cut into several ranges, and every row still meets the next."""
    rows = [(7, prose(3, i)) for i in range(300)] + [(i, prose(4, i)) for i in range(20, 40)] + [(None, prose(5, i)) for i in range(200)]
    cuts = [-(1 << 63), -(1 << 63), 7, 7, 7, 30]
    bounds, hot = fingerprints.range_bounds(cuts)
    assert hot and len(bounds) == 8 and (bounds[:-1] < bounds[1:]).all()
    got = fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    out = got.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == sorted((d is not None, d or 0) for d, _ in rows)
    texts = {r.edited_sha256 for r in out}
    splices = {hashlib.sha256(fingerprints.splice(a, b).encode()).hexdigest() for _, a in rows for _, b in rows}
    assert texts <= splices
    by_id = {r.doc_id: r for r in out if r.doc_id and r.doc_id >= 20}
    for i in range(20, 39):
        assert by_id[i].edited_sha256 == hashlib.sha256(fingerprints.splice(prose(4, i), prose(4, i + 1)).encode()).hexdigest()


def test_warc_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a/\r\nb", page), (1, None, page), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", page), (6, "u", "é" * 60), (7, "u", "é" * 60), (3, "http://a/", page)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(frame).collect())
    assert got == sorted([(1, "response", None, 203), (3, "revisit", 1, 203), (3, "revisit", 1, 203), (0, "revisit", 1, 203), (2, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 120), (7, "revisit", 6, 120)])
    assert warc.round_trip(frame.where("false")).count() == 0


def test_warc_rejects_broken_records():
    good = warc.record(1, "u", b"abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", None, "1970-01-01T00:00:00Z")
    assert warc.parse(good)[2] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_warc_rejects_broken_archives(spark, tmp_path):
    import io
    import struct

    import zstandard

    pages = spark.createDataFrame([(i, "u", f"<p>{prose(60, i)}") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    dictionary = warc.train_dictionary(pages, "page_id", "html", size=2048)
    assert dictionary
    folder = str(tmp_path / "archives")
    one, two = ([r.path for r in warc.write_archives(warc.with_references(pages), folder, dictionary).collect()] for _ in range(2))
    assert not set(one) & set(two)  # an attempt never writes over what another has listed
    data = open(one[0], "rb").read()
    whole = list(warc.frames(io.BytesIO(data)))
    assert struct.unpack("<II", data[:8]) == (warc.SKIPPABLE, len(dictionary))
    assert len(whole) > 0
    with pytest.raises(ValueError, match="last frame"):
        list(warc.frames(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.frames(io.BytesIO(data[: 8 + len(dictionary) // 2])))
    with pytest.raises(zstandard.ZstdError):
        list(warc.frames(io.BytesIO(data[8 + len(dictionary) :])))
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_odd_sketches_estimate():
    maker, rng = neardedup.MinHash(38, 6), np.random.default_rng(8)
    for size, common in ((45, 40), (500, 445)):
        values = rng.integers(0, 1 << 62, 2 * size - common).astype(np.uint64)
        a, b = (maker.odd_sketch(maker.samples(neardedup.mix64(x))) for x in (values[:size], values[size - common :]))
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= maker.most_odd_bits(80)


def test_raking():
    tokens_of = np.array([10.0, 20.0, 30.0, 40.0])
    weight, residual = mixing.rake(tokens_of, [["a", "a", "b", "b"], ["x", "y", "x", "y"]], [{"a": 0.5, "b": 0.5}, {"x": 0.25, "y": 0.75}], 60)
    assert residual < 1e-9
    assert weight[:2].sum() == pytest.approx(0.5) and weight[[0, 2]].sum() == pytest.approx(0.25)
    chance = mixing.probabilities(tokens_of, weight / (tokens_of / 100), 0.5)
    assert (chance * tokens_of).sum() == pytest.approx(50) and chance.max() <= 1


def test_mixing_keeps_clashing_columns(spark):
    rows = [(i, prose(9, i), "en" if i % 2 else None, f"s{i % 3}", -1.5, "mine", i) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _probability double, _source string, _Weight long")
    targets = {"source": 0.5, "lang": {"en": 0.7, "(none)": 0.3}, "topic": 1.0}
    out = mixing.calibrated(frame, targets, 0.5)
    assert out.columns[:7] == frame.columns and {"__probability", "__source", "__weight", "_kept"} <= set(out.columns)
    assert sorted(map(tuple, out.select(*frame.columns).collect())) == sorted(rows, key=lambda r: r[0])
    again = mixing.sample(frame, targets, 0.5)
    assert again.columns == frame.columns and set(map(tuple, again.collect())) <= set(rows)


def test_mixing_tells_targets_that_cannot_be_met(spark):
    rows = [(i, "a b", "en" if i % 2 else "de", "x" if i % 2 else "y") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}
    with pytest.warns(UserWarning, match="missed by"):
        assert mixing.calibrated(frame, targets, 0.5).count() == 40
    with pytest.raises(ValueError, match="missed by"):
        mixing.calibrated(frame, targets, 0.5, tolerance=0.01)
    with pytest.raises(ValueError, match="missed by"):
        mixing.calibrated(frame, targets, 0.5, driver_cells=1, tolerance=0.01)


@pytest.mark.parametrize("fraction", [0.3, 0.9, 1.0])
def test_mixing_of_more_cells_than_the_driver_takes(spark, fraction):
    rng = random.Random(13)
    rows = [(i, prose(rng.randint(1, 40), i) + rng.choice(["", " 7", " a@b"]), rng.choice(["en", "en", "en", "de", None]), f"s{rng.randint(0, 4) ** 2}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": 0.5, "lang": {"en": 0.4, "de": 0.5, "xx": 0.1}, "topic": {"prose": 0.5}}
    one, two = ({r.doc_id: r for r in mixing.calibrated(frame, targets, fraction, driver_cells=n, rounds=6).collect()} for n in (1, 1000))
    assert set(one) == set(two)
    for i, r in one.items():
        assert r._probability == pytest.approx(two[i]._probability, abs=1e-9) and r._weight == pytest.approx(two[i]._weight, abs=1e-9) and r._tokens == two[i]._tokens


def test_automaton():
    automaton = tokens.LongestMatch(["ab", "abcd", "bc\0", "d"])
    assert [automaton.count(w + "\0") for w in ("abcd", "abc", "abd", "x", "")] == [1, 2, 2, 1, 0]


def test_offending_sentences_are_those_above_the_threshold(spark):
    model = toxicity.BagModel({"^vile$": 6.0, "^bad$": 4.0, "^kind$": -3.0}, -5.0)
    parts = ["A vile day", " fine words", " bad luck", " kind people", " vile bad end", " a bad but kind one", " bad again", " vile", " so bad"]
    text = ".".join(parts)
    rows = [(1, text), (2, "so bad. kind people"), (3, "bad.bad.bad"), (4, None)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [text[s.start : s.end] for s in got[1]._t_offending] == [parts[i] for i in (4, 0, 7, 2, 6, 8)]
    assert [s.score for s in got[1]._t_offending] == sorted((s.score for s in got[1]._t_offending), reverse=True)
    assert got[1]._t_predicted == 1 and got[3]._t_predicted == 1 and len(got[3]._t_offending) == 3
    assert got[2]._t_offending == [] and got[2]._t_predicted == 0 and got[4]._t_score == 0
    strict = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model, sentence_from=0.9).collect()
    assert [len(r._t_offending) for r in sorted(strict, key=lambda r: r.doc_id)] == [1, 0, 1, 0]


def plain_toxicity(model, text):
    """The noisy-or by the docstring's rule, word by word."""
    rest = 1.0
    for sentence in re.split(r"[.!?\n]", text.lower()):
        found = [w for word in set(re.findall(r"[^\W\d_]+", sentence)) for n in {f"^{word}$", *(f"^{word}$"[:k] for k in (4, 5, 6)), *(f"^{word}$"[-k:] for k in (4, 5, 6))} if (w := model.weights.get(n))]
        if found:
            rest *= 1 - 1 / (1 + math.exp(-model.bias - sum(found)))
    return 1 - rest


def test_toxicity_scores_what_was_fitted():
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            sentences[rng.randrange(len(sentences))] += " zzvile zzword"
        texts.append(". ".join(sentences))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    for text, label in zip([*texts, "", "zzvile", "?!. \n"], [*labels, 0, 1, 0], strict=True):
        value = model.score(text)[0]
        assert value == pytest.approx(plain_toxicity(model, text), abs=1e-9) and (value >= 0.5) == label


def test_toxicity_sample_is_bounded_and_columns_stay(spark):
    rows = [(i, ("zzvile " if i % 2 else "kind ") + prose(30, i), "s", 0.25, 7) for i in range(40)]
    rows += [(1, "x" * 5000, "s", 0.25, 7), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string, score double, _t_score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels, F.lit(True))
    assert model.weights and toxicity.train(frame, labels, F.lit(True), most_chars=1).weights == {}
    out = toxicity.score(frame, model)
    assert out.columns == ["doc_id", "text", "label", "score", "_t_score", "__t_score", "_t_predicted", "_t_offending"]
    assert {r._t_score for r in out.where("doc_id is not null").collect()} == {7}
    assert {r.score for r in out.where("doc_id is not null").collect()} == {0.25} and out.count() == len(rows)


def test_packing_may_cut_at_every_sentence_end():
    """Ends 3 tokens apart: only the cut at the second of them leaves no padding."""
    ids = np.full(40, 7, dtype="<u4")
    ids[[16, 19]] = 9
    packer = packing.Packer(0, 20, np.array([9]), 4, 64, 2)
    packer.add(1, ids)
    assert [(p[1], p[2], p[5]) for p in packer.flush(True)] == [(0, 20, 0), (20, 20, 1)]


def test_mixing_stage_meets_targets(spark, monkeypatch):
    """A language so scarce that its documents must be repeated."""
    import corpus_pipeline

    rows = [(i, prose(50, i), "es" if i % 10 == 0 else "en", "s", 3) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "MIX_TARGETS", {"source": 1.0, "lang": {"es": 0.5, "en": 0.5}, "topic": 1.0})
    out = corpus_pipeline.mix_sources(spark, frame, "")
    count = {r.lang: r.n for r in out.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert out.columns == frame.columns
    assert count["es"] / (count["es"] + count["en"]) == pytest.approx(0.5, abs=0.03) and count["es"] + count["en"] == pytest.approx(1000, rel=0.05)
    times = {r["count"] for r in out.where("lang = 'es'").groupBy("doc_id").count().collect()}
    assert times == {2, 3}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, corpus_pipeline.mix_sources(spark, frame.repartition(7), "").collect()))


def test_one_of_each_keeps_columns_that_clash(spark):
    from trialytics.llm.neardedup import near_groups, one_of_each

    text = prose(60, 3)
    rows = [(i, prose(60, 100 + i), i) for i in range(40)] + [(100 + i, text, -i) for i in range(30)] + [(100, text, 7), (5, "", 1), (5, None, 2), (None, text, 3), (None, text, 4), (None, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _near_id int").repartition(5)
    assert one_of_each(frame, near_groups(frame)).columns == frame.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.text is None) for r in one_of_each(frame, near_groups(frame)).collect())
    want = sorted([(i, prose(60, 100 + i), False) for i in range(40)] + [(100, text, False), (5, "", False), (5, "", True), (-1, text, False), (-1, "", True)])
    assert got == want
    empty = frame.limit(0)
    assert one_of_each(empty, near_groups(empty)).count() == 0


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    one, two, other = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(1, one), (1, one), (2, one), (3, two), (3, other), (None, two), (None, two), (None, None), (None, None), (4, None), (4, None)]
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.keep_one_of_near_copies(spark, frame, "")
    key = lambda r: (r[0] or 0, r[1] or "")
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(1, one), (3, two), (3, other), (None, two), (None, None), (4, None)], key=key)


def test_line_dedup_keeps_columns_that_clash(spark):
    repeated = "\n".join(prose(20, 900 + i) for i in range(3))
    rows = [(1, repeated, "a", 5, 6), (2, prose(5, 1) + "\n" + repeated, "b", 5, 6), (3, None, "c", 5, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _w_text string, _w_removed int, _W_gone int")
    out = linededup.dedup_lines(frame)
    assert out.columns == [*frame.columns, "_w_lines", "__w_removed", "_w_runs"]
    got = sorted(out.collect())
    assert [tuple(r) for r in got] == [(1, repeated, "a", 5, 6, 3, 0, 0), (2, prose(5, 1), "b", 5, 6, 4, 3, 1), (3, None, "c", 5, 6, 0, 0, 0)]


def test_topk_refuses_what_it_cannot_hold(spark):
    with pytest.raises(OverflowError):
        bitsliced.quantise(np.array([1e18]), 1024.0)
    assert bitsliced.quantise(np.array([-0.5, 1e15]), 1024.0).tolist() == [-512, 1024 * 10**15]
    frame = spark.createDataFrame([(0, [1e14, 1e14]), (1, [1e14, 1e14])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit into a long"):
        bitsliced.top_k(frame, F.col("vec_id") == 0, 1).collect()


def test_near_groups_leave_one_generation_behind(spark):
    import os

    from trialytics.session import shared_root, written

    root = shared_root(spark).removeprefix("file:")
    text = prose(60, 3)
    frame = spark.createDataFrame([(i, text.replace("a", "b", i % 5)) for i in range(60)], "doc_id long, text string")
    kinds = lambda: sorted(n.rsplit("-", 1)[0] for n in os.listdir(root))
    before = kinds()
    done = neardedup.near_groups(frame)
    left = list(kinds())
    for name in before:
        left.remove(name)
    assert left == ["classes", "labels", "sketches"]
    kept = written(spark, lambda: done, "kept")
    want = sorted(map(tuple, done.collect()))
    assert sorted(map(tuple, kept.collect())) == want
    again = written(spark, lambda: neardedup.near_groups(frame), "again")
    left = list(kinds())
    for name in [*before, "classes", "labels", "sketches", "kept"]:
        left.remove(name)
    assert left == ["again"] and sorted(map(tuple, again.collect())) == want
