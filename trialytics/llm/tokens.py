"""Token counts by a linear longest-match automaton.

A vocabulary's pieces form a trie. Greedy word-piece tokenisation always takes the longest
piece that matches next; where the trie has no edge for a character, the automaton pops the
pieces that greedy matching would take from what has been read, and goes on from the state of
what is left: the failure link. How many pieces a link pops is worked out when the automaton
is built, so a word's count is one pass over its characters, and no piece is ever built.

Words are what white space separates, lower-cased; a word ends with the piece end `</w>`, as
in the vocabularies of byte-pair tokenizers with word ends. A character without a piece counts
as one unknown token and matching starts afresh behind it.

Nulls and edge cases: null and empty texts have 0 words and 0 tokens; null ids and repeated
rows are passed through; an empty table gives no rows; further columns are ignored. Texts of
any length are read whole; words that were counted before are looked up, in at most `room`.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trialytics.session import prepare

END = "\0"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}}


def load_pieces(path: str) -> list[str]:
    """Pieces of a tokenizers file: letters stand for bytes, END for the word's end."""
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    return [p[:-4] + END if p.endswith("</w>") else p for p in vocabulary]


class LongestMatch:
    """The automaton: states are trie nodes, 0 the root."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for text in pieces:
            state = 0
            for letter in text:
                following = self.next[state].get(letter)
                if following is None:
                    following = self.next[state][letter] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                state = following
            piece[state] = state != 0
        # link: where to go on once the popped pieces are taken; -1: no piece begins what was read
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        self.whole = piece
        wait = deque((0, letter, child) for letter, child in self.next[0].items())
        while wait:
            parent, letter, state = wait.popleft()
            if piece[state]:
                self.link[state], self.popped[state] = 0, 1
            else:
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and letter not in self.next[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[state], self.popped[state] = self.next[at][letter], count
            wait.extend((state, x, child) for x, child in self.next[state].items())

    def count(self, word: str) -> int:
        """Pieces that greedy longest matching takes for word; an unknown letter is one, an end of word that is left over none."""
        following, link, popped = self.next, self.link, self.popped
        total = state = at = 0
        size = len(word)
        while at < size or state:
            step = following[state].get(word[at]) if at < size else None
            if step is not None:
                state = step
                at += 1
            elif not state:
                total += word[at] != END
                at += 1
            elif link[state] < 0:  # letters that no piece begins with: only where the vocabulary lacks some letter
                return self.match(word)
            else:
                total += popped[state]
                state = link[state]
        return total

    def match(self, word: str) -> int:
        """The same by trying each place in turn, for words with letters that the vocabulary lacks."""
        total = at = 0
        while at < len(word):
            state, reach, here = 0, at, at
            while here < len(word) and (state := self.next[state].get(word[here], 0)):
                here += 1
                if self.whole[state]:
                    reach = here
            total += reach > at or word[at] != END
            at = max(reach, at + 1)
        return total


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = 300_000) -> DataFrame:
    """id, n_words, n_tokens of each row; nothing is shuffled."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(load_pieces(vocabulary_path))
        letters = byte_letters()
        known: dict[str, int] = {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                split = (text or "").lower().split()
                if len(known) > room:
                    known.clear()
                for word in set(split).difference(known):
                    known[word] = automaton.count("".join(map(letters.__getitem__, word.encode())) + END)
                words.append(len(split))
                tokens.append(sum(map(known.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
