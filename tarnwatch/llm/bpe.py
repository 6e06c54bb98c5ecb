"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never be merged across: the cut between them
is certain. A word is cut at all such places, the fragments are encoded independently, each distinct one once, and their ids
are put together again.
"""

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.llm.common import give_back, slices

END = "</w>"
IDS = T.ArrayType(T.IntegerType())
KEPT = 1 << 19  # words that a worker remembers
LONG = 64  # bytes beyond which a word is not remembered, and a fragment merged by heap
NONE, LOW = 1 << 64, (1 << 32) - 1  # no merge, after every rank; the part of a merge that is its id
# Letters, numbers and white space up to U+017F, where the tokenizer's classes are known; other texts are split by its own rules.
LETTERS, NUMBERS, SPACE = "a-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
KNOWN = re.compile("[\\x00-ſ]*")
WORDS = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
ASCII_WORDS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """A word-end BPE file of the tokenizers library: tokens, ranks of merges, and which bytes may stand side by side."""

    def __init__(self, text: str) -> None:
        file = json.loads(text)
        model, self.text = file["model"], text
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["continuing_subword_prefix"] or model["byte_fallback"] or file["decoder"]:
            raise ValueError("only BPE over bytes with word ends and no decoder")
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {}
        for a in file["added_tokens"]:
            if a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]:
                raise ValueError("only added tokens that are looked for as they are")
            self.special[a["content"]] = a["id"]
            self.tokens[a["id"]] = a["content"]
        longest = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.letters = byte_letters()
        of = {c: b for b, c in enumerate(self.letters)}
        self.first = [model["vocab"][c] for c in self.letters] + [model["vocab"][c + END] for c in self.letters]
        vocab = model["vocab"]
        #: left id << 32 | right id to rank << 32 | id of both in one.
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        #: side[x, y]: some token has symbol y right after x; symbols are bytes, and from 256 on bytes that end a word.
        self.side = np.zeros((512, 512), np.uint8)
        for t in model["vocab"]:
            body = t.removesuffix(END) if len(t) > len(END) else t
            s = [of[c] for c in body]
            if body != t:
                s[-1] += 256
            self.side[s[:-1], s[1:]] = 1
        self.side = self.side.tobytes()
        self.words: dict[str, bytes] = {}
        self.own = None

    def fragment(self, symbols: list[int]) -> bytes:
        """Ids of one fragment: the pair of least rank is merged, leftmost first, until none can be."""
        ids = [self.first[s] for s in symbols]
        return array("i", self.merged_short(ids) if len(ids) <= LONG else self.merged_long(ids)).tobytes()

    def merged_short(self, ids: list[int]) -> list[int]:
        """By looking at all pairs again after each merge."""
        merge = self.merges.get
        pairs = [merge(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while pairs and (least := min(pairs)) != NONE:
            k = pairs.index(least)
            ids[k : k + 2] = [least & LOW]
            del pairs[k]
            if k:
                pairs[k - 1] = merge(ids[k - 1] << 32 | ids[k], NONE)
            if k < len(pairs):
                pairs[k] = merge(ids[k] << 32 | ids[k + 1], NONE)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """By a heap of pairs, in n log n."""
        n, ranks = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, k, ids[k + 1]) for k in range(n - 1) if (m := ranks.get(ids[k] << 32 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            m, k, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or ids[j] != right or ranks.get(ids[k] << 32 | right) != m:
                continue
            ids[k], ids[j], after[k] = m & LOW, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (m := ranks.get(ids[a] << 32 | ids[b])):
                    heapq.heappush(heap, (m, a, ids[b]))
        return [i for i in ids if i >= 0]

    def fragments(self, symbols: list[int]) -> list[list[int]]:
        """The word's symbols, cut where no token could join them."""
        side = self.side
        cuts = [k for k, (a, b) in enumerate(zip(symbols, symbols[1:]), 1) if not side[a << 9 | b]]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])] if cuts else [symbols]

    def word(self, word: str) -> bytes:
        """Ids of one word, as the bytes of 4-byte numbers: its fragments' ids in a row."""
        symbols = list(word.encode())
        symbols[-1] += 256
        ids = b"".join(map(self.fragment, self.fragments(symbols)))
        if len(symbols) <= LONG:
            if len(self.words) >= KEPT:
                self.words.clear()
            self.words[word] = ids
        return ids

    def split_words(self, text: str) -> list[str]:
        """The text's words after normalisation, in order."""
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if KNOWN.fullmatch(text):
            return WORDS.findall(text.lower())
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_str(self.text)
            self.byte = {ord(c): b for b, c in enumerate(self.letters)}
        parts = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text))
        return [p.translate(self.byte).encode("latin-1").decode() for p, _ in parts]

    def encode(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split and self.split.search(text) else [text]
        known, word, out = self.words.get, self.word, []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.int32(self.special[part]).tobytes())
            elif part:
                out.extend([known(w) or word(w) for w in self.split_words(part)])
        return b"".join(out)


def shipped(df: DataFrame, path: str) -> Callable[[], Vocabulary]:
    """The vocabulary file, read by the driver and sent to each executor once; it is as large as it is, whatever the table."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    sent, name = df.sparkSession.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()

    def vocabulary() -> Vocabulary:
        import sys

        kept = sys.__dict__.setdefault("_tarnwatch_vocabularies", {})  # a Python worker outlives its task
        if name not in kept:
            kept.clear()
            kept[name] = Vocabulary(sent.value)
        return kept[name]

    return vocabulary


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text with the vocabulary file at `path`.

    Nulls, empty texts and texts of nothing but white space have no ids; special tokens that a text spells out get their own
    id. Rows of one doc_id stay rows of their own; columns other than doc_id and text are left out.
    """
    vocabulary = shipped(documents, path)

    def run(batches) -> Iterator:
        import pyarrow as pa

        v = vocabulary()
        for b in slices(batches):
            made = [v.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(m) // 4 for m in made)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])
        give_back()

    return documents.select("doc_id", "text").mapInArrow(run, T.StructType([documents.schema["doc_id"], T.StructField("ids", IDS)]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded string): tokens joined by one space, word ends kept; special tokens stay; unknown ids give nothing."""
    vocabulary = shipped(encoded, path)

    def run(batches) -> Iterator:
        import pyarrow as pa

        of = vocabulary().tokens
        for b in slices(batches):
            made = [" ".join([of[i] for i in x if i in of]) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, T.StructType([encoded.schema["doc_id"], T.StructField("ids", IDS), T.StructField("decoded", T.StringType())]),
    )


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids' decimals joined by spaces and of the decoded text."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(
            F.array_join(F.col("ids").cast("array<string>"), " "), 256,
        ).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
