"""Byte-pair encoding and decoding by a contiguous rank array.

A word's parts and the ranks of its adjacent pairs lie in two arrays. Each step scans the ranks for the smallest
(the leftmost of equals), joins that pair, deletes the boundary between its parts and looks up the ranks of the two
pairs beside it. Short arrays make the scan cheaper than any queue; words of over SHORT parts keep the same
order of merges with a heap over linked parts, so a text without spaces costs n log n and not n squared.

The vocabulary is a file in the tokenizers library's format, read where the query is planned and broadcast (its size is
that of the file, a few MB). Supported are files of the kind of word_bpe_49k.json: special tokens taken as they are
written, NFC, lower case, one splitting pattern, bytes as letters, an ending that marks the last part of a word, and no
decoder; others are refused. Each worker remembers the ids of up to REMEMBERED words.

Null and empty texts and texts of white space have no ids and decode to the empty text. Rows stay as they are, also
repeated ones and those without an id; ties between merges go to the leftmost. Whole texts are encoded whatever
their length. Columns of the input named like an output are replaced by it. An empty table gives none.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, prepare, table

SHORT = 256
REMEMBERED = 1 << 19
FILE = "word_bpe_49k.json"

# Texts of these characters need no normal form, and every version of Unicode sorts them alike into letters, numbers and
# space; other texts are normalised and split by the library's own parts.
UNUSUAL = re.compile("[^\x00-˿‐-‧‰-⁞€]")


def usual_words() -> re.Pattern:
    """PATTERN for texts of usual characters, with the classes of letters, numbers and space written out."""
    usual = sorted({low for c in map(chr, range(0x2100)) if UNUSUAL.search(c) is None for low in c.lower()})
    of = lambda kind: "".join(re.escape(c) for c in usual if unicodedata.category(c)[0] == kind)
    space = "".join(re.escape(c) for c in usual if regex.fullmatch(r"\s", c))
    letters, numbers = of("L"), of("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


# Fixed value: how the supported files split texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
USUAL_WORDS = usual_words()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Ids, merges and splitting of a tokenizer file's text."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        file = json.loads(source)
        self._check(file)
        ids = file["model"]["vocab"]
        end = file["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + end] for c in letters]
        # ranks[left id][right id] is the rank of a merge, results[rank] the id it makes.
        ranks: dict[int, dict[int, int]] = {}
        results = []
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            ranks.setdefault(ids[a], {})[ids[b]] = rank
            results.append(ids[a + b])
        self.merges = Merges([ranks.get(i, {}) for i in range(max(ids.values()) + 1)], results)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        named = {**ids, **special}
        self.tokens: list[str | None] = [None] * (max(named.values()) + 1)
        for token, i in named.items():
            self.tokens[i] = token
        library = Tokenizer.from_str(source)
        self.normal = library.normalizer.normalize_str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _check(file: dict) -> None:
        model = file["model"]
        before = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = (file["normalizer"] or {}).get("normalizers", [])
        plain = ("single_word", "lstrip", "rstrip", "normalized")
        fits = (
            model["type"] == "BPE"
            and model.get("end_of_word_suffix")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
            and [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in before] == ["Split", "ByteLevel"]
            and before[0]["behavior"] == "Removed"
            and before[0]["invert"]
            and before[0]["pattern"] == {"Regex": PATTERN}
            and not before[1]["add_prefix_space"]
            and not before[1]["use_regex"]
            and file["added_tokens"]
            and not any(t[k] for t in file["added_tokens"] for k in plain)
            and file["decoder"] is None
        )
        if not fits:
            raise ValueError("The tokenizer file is of another kind than this encoder supports.")

    def words(self, text: str) -> list[str]:
        """Lower-case words of a text without special tokens."""
        if UNUSUAL.search(text) is None:
            return USUAL_WORDS.findall(text.lower())
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.pieces(self.normal(text))]

    def word_ids(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return merged(parts, self.merges) if len(parts) <= SHORT else merged_long(parts, self.merges)

    def encoded(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.cut.split(text) if "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            words = self.words(part)
            found = list(map(self.known.get, words))
            if None in found:
                found = [self.remembered(word) if ids is None else ids for word, ids in zip(words, found, strict=True)]
            out += found
        return b"".join(out)

    def remembered(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = np.array(self.word_ids(word), "<u4").tobytes()
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(word) <= SHORT:
                self.known[word] = ids
        return ids

    def decoded(self, ids: bytes) -> str:
        """The tokens of the ids with spaces between them; ids that name no token are left out."""
        numbers, tokens = np.frombuffer(ids, "<u4"), self.tokens
        if len(numbers) and numbers.max() >= len(tokens):
            numbers = numbers[numbers < len(tokens)]
        return " ".join([t for i in numbers.tolist() if (t := tokens[i]) is not None])


NONE = 1 << 29  # the rank of a pair that no merge joins


class Merges(NamedTuple):
    ranks: list[dict[int, int]]
    results: list[int]


def merged(parts: list[int], merges: Merges) -> list[int]:
    """The parts after all merges, by smallest rank and then from the left."""
    table_, results = merges
    ranks = [table_[a].get(b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks:
        best = min(ranks)
        if best == NONE:
            break
        i = ranks.index(best)
        parts[i] = joined = results[best]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = table_[parts[i - 1]].get(joined, NONE)
        if i < len(ranks):
            ranks[i] = table_[joined].get(parts[i + 1], NONE)
    return parts


def merged_long(parts: list[int], merges: Merges) -> list[int]:
    """As merged, for many parts: a heap of (rank, place), where places whose pair has changed are passed over."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    held = [merges.ranks[a].get(b, NONE) for a, b in zip(parts, parts[1:], strict=False)] + [NONE]
    heap = [(rank, i) for i, rank in enumerate(held) if rank != NONE]
    heapq.heapify(heap)

    def refresh(i: int) -> None:
        held[i] = merges.ranks[parts[i]].get(parts[after[i]], NONE) if after[i] < n else NONE
        if held[i] != NONE:
            heapq.heappush(heap, (held[i], i))

    while heap:
        rank, i = heapq.heappop(heap)
        if held[i] != rank:
            continue
        gone = after[i]
        parts[i], held[gone], after[i] = merges.results[rank], NONE, after[gone]
        if after[i] < n:
            before[after[i]] = i
        refresh(i)
        if before[i] >= 0:
            refresh(before[i])
    out, i = [], 0
    while i < n:
        out.append(parts[i])
        i = after[i]
    return out


_read: dict[str, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """One per worker and file, with the words it remembers."""
    if source not in _read:
        _read.clear()
        _read[source] = Vocabulary(source)
    return _read[source]


def encoder(shared) -> Callable[[pa.Array], pa.Array]:
    def encode(texts: pa.Array) -> pa.Array:
        v = vocabulary(shared.value)
        return pa.array((v.encoded(t) if t else b"" for t in texts.to_pylist()), pa.binary())

    return encode


def decoder(shared) -> Callable[[pa.Array], pa.Array]:
    def decode(ids: pa.Array) -> pa.Array:
        v = vocabulary(shared.value)
        return pa.array((v.decoded(i) if i else "" for i in ids.to_pylist()), pa.string())

    return decode


def shared_file(spark: SparkSession, path: str):
    prepare(spark)
    with open(path, encoding="utf-8") as file:
        source = file.read()
    Vocabulary(source)  # refuses other kinds before a job starts
    return spark.sparkContext.broadcast(source)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (binary, four bytes each, little-endian) and n_tokens."""
    encode = F.arrow_udf(encoder(shared_file(docs.sparkSession, path)), "binary")
    ids = docs.withColumn(OWN + "ids", encode(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens")]
    count = F.floor(F.octet_length(OWN + "ids") / 4).cast("long")
    return ids.select(*kept, F.col(OWN + "ids").alias("ids"), count.alias("n_tokens"))


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """coded(ids, ...) with decoded, the text that the ids stand for."""
    decode = F.arrow_udf(decoder(shared_file(coded.sparkSession, path)), "string")
    kept = [F.col(f"`{c}`") for c in coded.columns if c != "decoded"]
    return coded.select(*kept, decode(F.col("ids")).alias("decoded"))


def op12_rank_array_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(FILE)
    rows = decoded(encoded(table(spark, folder, "documents").select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
