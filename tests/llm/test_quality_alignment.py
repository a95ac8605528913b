"""Quality rules and alignment of tokenizers: against brute force, and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from trialytics.llm import alignment, quality
from trialytics.llm.queries import tokenizer
from trialytics.llm.tokens import byte_letters

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = [None, "", " ", "x", "  two  spaces ", "a\nb\r\nc", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under ▁score", "\0 nul \x1c\x85 ", "éÉ ñ ß 漢字 🙂👍🏽", "ﬁ ligature ½ ①", "don't we'll I'M", " lead",
    "tab\tand  runs   of    spaces", "é combined", "a" * 3000, "0123456789" * 30, "zero​width ﻿ bom", "same words same words same words", "\n" * 50, "x" * 10 + " " * 500 + "y"]


def texts(n, seed=1):
    rng = random.Random(seed)
    letters = "abcdefg hij\nklmno pqrst uvwxyz  éüñ.,'\"!?0123456789<>#" * 8 + "▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(n)]


def repeats_by_hand(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_measures_by_hand():
    for text in [t or "" for t in ODD] + texts(200) + [" ".join(random.Random(i).choice("ab c dd".split()) for _ in range(60)) for i in range(40)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), repeats_by_hand(words))
        assert quality.measure(text.encode(), len(text))[0] == want, text


def test_lines_are_normalised():
    same = [b"Page 12 of 300", b"  page\t7  of 1 ", b"PAGE 0 of 0\r"]
    assert len({quality.line_hash(x) for x in same}) == 1
    assert quality.line_hash(b" \t\r") == b"" and quality.line_hash(b"page of") != quality.line_hash(same[0])


def prose(n, seed):
    return " ".join("".join(random.Random(seed * 1000 + i).choices("abcdefghijkl", k=6)) for i in range(n))


@pytest.fixture(scope="module")
def hosts(spark):
    """40 documents of host a, a common line in half of them; two of them hold little else. 3 of b, of no host, of host '' each."""
    menu, foot = (" ".join(f"{x}{chr(97 + i)}" for i in range(20)) for x in ("m", "f"))
    ends = lambda year: f"\nMENU home about {year} {menu}\n  Foot {foot}"
    rows = [(i, prose(60, i) + (ends(2000 + i) if i % 2 else ""), "a") for i in range(38)]
    rows += [(100, prose(30, 100) + ends(1), "a"), (101, prose(60, 101) + ends(22).upper() + ends(7), "a")]
    rows += [(200 + i, prose(60, 200 + i) + "\nshared line", h) for i, h in enumerate(["b"] * 3 + [None] * 3 + [""] * 3)]
    rows += [rows[0], (None, prose(70, 7), "a"), (None, prose(70, 7), "a"), (0, prose(55, 8), "a"), (None, None, None), (7, None, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_q_text", F.lit("mine")).withColumn("high", F.lit(3))
    return frame.repartition(5), rows


def judged_by_hand(rows):
    docs = {(i, h, t or "") for i, t, h in rows}
    size, held = Counter(h for _, h, _ in docs), defaultdict(set)
    norm = lambda x: re.sub("[0-9]+", "0", " ".join(x.lower().split()))
    for doc in docs:
        for line in doc[2].split("\n"):
            if line.strip():
                held[doc[1], norm(line)].add(doc)
    common = {k for k, v in held.items() if len(v) > 5 and 100 * len(v) > 10 * size[k[0]]}
    out = []
    for i, t, h in rows:
        words = (t or "").split()
        lost = sum(len(x.split()) for x in (t or "").split("\n") if (h, norm(x)) in common)
        failed = len(words) < 50 or 2 * repeats_by_hand(words) > len(words)
        left = "\n".join(x for x in (t or "").split("\n") if (h, norm(x)) not in common) if lost else t
        out.append((i, lost, failed, not failed and 2 * lost <= len(words), left))
    return out


def test_verdicts_by_hand(hosts):
    frame, rows = hosts
    got = sorted(((r.doc_id, r.n_common_words, r.base_failed, r.kept) for r in quality.verdicts(frame).collect()), key=repr)
    want = judged_by_hand(rows)
    assert got == sorted((w[:4] for w in want), key=repr)
    assert any(w[1] and w[3] for w in want) and any(w[1] and not w[2] and not w[3] for w in want)


def test_cleaned_texts_and_columns(hosts):
    frame, rows = hosts
    done = quality.cleaned(frame)
    assert done.columns == frame.columns
    got = sorted(((r.doc_id, r.text, r._q_text, r.high) for r in done.collect()), key=repr)
    assert got == sorted(((w[0], w[4], "mine", 3) for w in judged_by_hand(rows) if w[3]), key=repr)


def test_quality_of_an_empty_table(hosts):
    frame = hosts[0].where("false")
    assert quality.verdicts(frame).count() == 0 and quality.cleaned(frame).count() == 0


# alignment


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def test_fast_ids_are_the_tokenizers_own(aligner):
    assert aligner.a.fast is not None
    for text in [t for t in ODD if t] + texts(300, 5) + [" " * 20000 + "x", "\n \t" * 4000]:
        assert aligner.a.encode(" " + text).tolist() == aligner.a.slow.encode(" " + text, add_special_tokens=False).ids, text[:60]


def by_hand(text):
    """(A ids, B ids, groups, links) of a text, by comparing every pair of byte ranges."""
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    cache = by_hand.__dict__
    if not cache:
        letter = {c: b for b, c in byte_letters().items()}
        cache["a"], cache["b"] = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        cache["a"].encode_special_tokens = True
        cache["names"] = {i: bytes(letter[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    if not text:
        return [], [], [], []
    a, b = cache["a"].encode(" " + text, add_special_tokens=False).ids, cache["b"].encode(text)
    in_a = [cache["names"][i] for i in a]
    in_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(cache["b"].id_to_piece, b)]
    if b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
        return [], [], [], []

    def ranges(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    ra, rb = ranges(in_a), ranges(in_b)
    links = [(i, j) for i, (s, e) in zip(a, ra, strict=True) for j, (u, v) in zip(b, rb, strict=True) if s < v and u < e]
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, start = [], 0
    for end in cuts:
        groups.append(([i for i, r in zip(a, ra, strict=True) if start < r[1] <= end], [j for j, r in zip(b, rb, strict=True) if start < r[1] <= end]))
        start = end
    return a, b, groups, links


def expected(texts):
    hand = [by_hand(t) for t in texts]
    count = Counter(p for h in hand for p in set(h[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    told = lambda gs: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
    return [(len(a), len(b), len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), told(g)) for a, b, g, k in hand]


@pytest.mark.parametrize("block_bytes", [1, 2000, 8 << 20])
def test_alignment_by_hand(spark, block_bytes):
    listed = ODD + texts(60, 9) + ["same words same words same words"] * 3
    frame = spark.createDataFrame([(i if i % 7 else None, t, 5, "k") for i, t in enumerate(listed)], "doc_id long, text string, block int, kind string").repartition(3)
    got = alignment.align(frame, A, B, with_groups=True, block_bytes=block_bytes).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = [(i if i % 7 else None, *e[:6], digest(e[6]), e[6]) for i, e in enumerate(expected(listed))]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert sum(e[1] == 0 for e in want) > 4 and sum(e[1] > 0 for e in want) > 20


def test_alignment_of_the_table(spark):
    from trialytics.llm.queries import QUERIES

    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 2500]
    got = {r.doc_id: r for r in QUERIES["op12_alignment"](spark, f"{DATA}/sf0.001").collect()}
    assert len(got) == len(rows)
    for doc_id, text in short[:60]:
        a, b, groups, links = by_hand(text)
        r = got[doc_id]
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (len(a), len(b), len(groups), len(links), hashlib.sha256(told.encode()).hexdigest())


def test_alignment_of_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(frame, A, B).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(only, A, B).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_packed_numbers_return():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = rng.integers(0, 2**32, (2, 1000))
    assert (alignment.unpack(alignment.pack(*columns), 2) == columns).all()
