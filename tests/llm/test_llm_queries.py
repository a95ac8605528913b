"""The queries against their SQL, and those without SQL against brute force, on the smallest tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from oracle import connect, differences

from trialytics.llm.oracles import ORACLES
from trialytics.llm.queries import QUERIES, tokenizer

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def rows_of(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name, tmp_path):
    assert differences(con, QUERIES[name](spark, FOLDER), ORACLES[name], str(tmp_path / "out")) == ([], 0, 0)


def brute_repeats(texts: list[bytes], length: int) -> list[np.ndarray]:
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    masks = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        masks.append(gone)
    return masks


def test_suffix_dedup(spark, docs):
    texts = [(t or "").encode() for _, t in docs]
    got = {r.doc_id: r for r in rows_of(spark, "op1_suffix_dedup")}
    for (doc_id, _), data, gone in zip(docs, texts, brute_repeats(texts, 400), strict=True):
        row = got[doc_id]
        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def check_pieces(rows, docs):
    """The contract of packing: each id in one piece, pieces gapless in documents and sequences, and little padding. docs may repeat a row."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode
    times = Counter(d for d, _ in docs)
    ids = {d: np.array([*encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in docs}
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in pieces.items():
        covered = np.zeros(len(ids[d]), dtype=int)
        for start, length in parts:
            covered[start : start + length] += 1
        assert (covered == times[d]).all()
    for parts in sequences.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at <= 2048
    assert set(pieces) == set(ids)
    filled = [sum(x[1] for x in p) for p in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled)
    assert padding / sum(filled) < 0.03


def test_packing(spark, docs):
    check_pieces(rows_of(spark, "op2_packing"), docs)


def test_fingerprints(spark, docs):
    def shingles(text):
        data = text.encode()
        return {data[i : i + 12] for i in range(max(1, len(data) - 11))} if data else set()

    got = {r.doc_id: r for r in rows_of(spark, "op3_fingerprints")}
    assert len(got) == len(docs)
    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row, a, b, n = got[doc_id], shingles(text), shingles(edited), shingles(after)
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(len(a & b) / len(a | b), abs=0.15)
        assert row.near_next == pytest.approx(len(a & n) / len(a | n), abs=0.15)


def test_token_counts(spark, docs):
    from trialytics.llm.tokens import END, byte_letters, load_pieces

    pieces, letters = set(load_pieces(tokenizer("word_bpe_49k.json"))), byte_letters()
    longest = max(map(len, pieces))

    def greedy(word):
        count = at = 0
        while at < len(word):
            size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in pieces), 0)
            count += 1 if size or word[at] != END else 0
            at += size or 1
        return count

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in rows_of(spark, "op6_token_counts")}
    for doc_id, text in docs:
        words = text.lower().split()
        assert got[doc_id] == (len(words), sum(greedy("".join(letters[b] for b in w.encode()) + END) for w in words))


def test_toxicity(spark, con, tmp_path):
    """Contract columns, each score by a plain version, and accuracy on held-out rows alone."""
    from test_llm_cases import plain_toxicity

    from trialytics.llm import toxicity

    folder = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out())
    texts = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, folder).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert r.score == pytest.approx(plain_toxicity(model, texts[d] or ""), abs=1e-6)
        assert bool(r.offending) == bool(r.predicted)
    assert np.mean([got[d].predicted == t for d, t in truth.items() if got[d].held_out]) > 0.9


def plain_groups(docs, words):
    """doc_id -> smallest id of its group, by comparing all pairs of word shingle sets at 0.8."""
    sets = {d: {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if (w := (t or "").lower().split()) else set() for d, t in docs}
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d: root(d) for d in ids}


def draw(doc_id):
    return int(hashlib.md5(str(doc_id).encode()).hexdigest()[:13], 16) / 2**52


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version of it, on what its predecessor kept."""
    import corpus_pipeline
    from test_llm_cases import plain_toxicity

    from trialytics.llm import toxicity
    from trialytics.llm.oracles import ORACLES

    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path / str(number))
        frame.write.parquet(f"{folder}/documents.parquet")
        frame = spark.read.parquet(f"{folder}/documents.parquet")
        out, before = stage(spark, frame, FOLDER), frame.collect()
        rows = out.collect()
        assert rows
        if number < 4:
            assert out.columns == frame.columns and {r.doc_id for r in rows} <= {r.doc_id for r in before}
        db = connect(FOLDER)
        db.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        if name == "toxicity":
            model = toxicity.train(frame, spark.read.parquet(f"{FOLDER}/labels.parquet"), ~toxicity.held_out())
            assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in before if plain_toxicity(model, r.text or "") < 0.5)
        elif name == "line dedup":
            kept = {d: (n, digest) for d, _, n, digest in db.sql(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({ORACLES['op7_line_dedup']})").fetchall()}
            assert {r.doc_id: None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest() for r in rows} == {d: x for d, (_, x) in kept.items()}
            chars = {r.doc_id: r.n_chars for r in before}
            assert all(r.n_chars == (len(r.text) if kept[r.doc_id][0] else chars[r.doc_id]) for r in rows)
        elif name == "MinHash near-dedup":
            group = plain_groups([(r.doc_id, r.text) for r in before], 5)
            assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in before if group[r.doc_id] == r.doc_id)
        elif name == "mixing sources to target weights":
            want = Counter()
            for d, p, w in db.sql(f"SELECT doc_id, probability, weight FROM ({ORACLES['op10_mixing']})").fetchall():
                want[d] += int(p * w) + (draw(d) < p * w - int(p * w))
            texts = {r.doc_id: tuple(r) for r in before}
            assert Counter(r.doc_id for r in rows) == +want and all(tuple(r) == texts[r.doc_id] for r in rows)
        else:
            check_pieces(rows, [(r.doc_id, r.text) for r in before])
        frame = out


def test_near_groups_at_five_words(spark):
    """All groups at 0.8 on five words, against comparing all pairs."""
    from trialytics.llm.neardedup import near_groups

    frame = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in near_groups(frame).collect()}
    assert got == plain_groups([(r.doc_id, r.text) for r in frame.collect()], 5)
