"""Byte-pair encoding and decoding with a public vocabulary.

A word's symbols form a doubly linked list; a priority queue holds the possible
merges by rank and place, and entries whose symbols have changed since are
skipped when they come up. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordloom.llm.common import appended, bounded

#: Words in each of the two generations that a task remembers: words of the older
#: one that come up again move to the younger, so frequent words stay. Words of more
#: characters are not remembered, so what is stays bounded in bytes.
REMEMBERED, LONGEST = 150_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 letters stand for themselves, the others follow from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge neighbours by rank, the leftmost first among equals, until none can be merged."""
    n = len(symbols)
    if n < 2:
        return symbols
    before = list(range(-1, n - 1))
    after = [*range(1, n), -1]
    queue = [
        (found[0], i, found[1], pair)
        for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := ranks.get(pair))
    ]
    heapq.heapify(queue)
    while queue:
        _, i, made, pair = heapq.heappop(queue)
        j = after[i]
        if j < 0 or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue  # stale: one of the two has been merged since
        symbols[i], symbols[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := ranks.get(new := (made, symbols[k])):
                heapq.heappush(queue, (found[0], i, found[1], new))
        if (k := before[i]) >= 0 and (found := ranks.get(new := (symbols[k], made))):
            heapq.heappush(queue, (found[0], k, found[1], new))
    return [s for s in symbols if s >= 0]


class WordBpe:
    """A tokenizer file with normal form C, lower case, split words and word ends."""

    def __init__(self, content: bytes):
        held = json.loads(content)
        model, split = held["model"], held["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"] or not split["invert"]:
            raise ValueError("this tokenizer file has settings that are not covered")
        self.vocabulary: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocabulary[a], self.vocabulary[b]] = (rank, self.vocabulary[a + b])
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V1)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.letters = byte_letters()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def word(self, word: str) -> tuple[bytes, str]:
        """The packed ids of a word and their strings joined by spaces."""
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.end
        symbols = [s for x in letters if (s := self.vocabulary.get(x)) is not None]
        ids = merge(symbols, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])

    def _plain(self, text: str, found: list[tuple[bytes, str]]) -> None:
        # single letters are put in lower case, so a final sigma is not special
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        known = self.known
        for w in self.words.findall(text):
            got = known.get(w)
            if got is None:
                if len(known) >= REMEMBERED:
                    self.older, self.known = known, {}
                    known = self.known
                got = self.older.get(w) or self.word(w)
                if len(w) <= LONGEST:
                    known[w] = got
            found.append(got)

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as little-endian 32-bit integers, and the decoded text."""
        found: list[tuple[bytes, str]] = []
        if self.marks is None or not self.marks.search(text):
            self._plain(text, found)
        else:
            for i, part in enumerate(self.marks.split(text)):
                if i % 2:
                    found.append((struct.pack("<I", self.special[part]), part))
                elif part:
                    self._plain(part, found)
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])

    def decode(self, ids: bytes) -> str:
        return " ".join([self.strings[i] for i, in struct.iter_unpack("<I", ids) if i in self.strings])


def encode_decode(
    docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None,
    ids: str = "token_ids", count: str = "n_tokens", decoded: str = "decoded",
) -> DataFrame:
    """Encode every whole text with the tokenizer file at ``vocabulary`` and decode it again.

    Adds ``ids`` (binary, little-endian unsigned 32-bit), ``count`` (long) and
    ``decoded`` (the vocabulary strings joined by spaces) to the columns ``keep``
    (all by default; columns of these names are replaced). A null text is empty:
    no ids, and an empty decoded text. Rows are independent, so repeated rows and
    rows without an id get the same results as any other; there is no shuffle.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        content = file.read()
    sent = bounded(spark, content, len(content))

    def start():
        codec = WordBpe(sent.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            made = [codec.encode(t or "") for t in texts.to_pylist()]
            return [
                pa.array([x[0] for x in made], pa.binary()),
                pa.array([len(x[0]) // 4 for x in made], pa.int64()),
                pa.array([x[1] for x in made], pa.string()),
            ]

        return work

    fields = [(ids, T.BinaryType()), (count, T.LongType()), (decoded, T.StringType())]
    return appended(docs, text, fields, start, keep)
