"""Phrase collocations per language, counted in direct-address tiles of frequency-ranked ids.

Words get ids by frequency over the whole table. A pair of ids is a cell of a square grid that is cut into tiles
of TILE x TILE. Where texts are read, tiles that receive many pairs (those of the frequent words) are dense arrays
counted by numpy's bincount; the pairs of all other tiles are sorted as coordinates and their runs counted. Spark
sums the partial counts. The frequent pairs are then ranked anew and take the place of the left word, so that longer
phrases are counted by the same tiles, level by level: (pair, word), (triple, word) and so on.

A phrase that occurs MIN_COUNT times consists of parts that do, so each level looks at frequent parts only. Their
codes are broadcast up to a bound in rows and bytes, the most frequent first. Parts beyond it (in tables whose
frequent words or phrases are more) are not dropped: a bit for the hash of each is broadcast, and what has such a bit
gets a code of the block of text at hand. Counts of phrases around it are sent block by block, under the codes of
all their words, or with the text where a word has none. A bit set by another phrase only means that more is counted. The
result is the same; more is shuffled, and a task holds no more. No group of rows is brought to one task: counts are
summed in the tasks before they are shuffled by phrase.

Only ASCII letters are lower-cased. Null texts are empty, null languages 'und' (as one with that name). Rows that repeat
count again, and ids do not matter. Very long texts are read whole. Ties are ordered by phrase. Columns besides lang and
text are ignored. An empty table gives no rows. Products of counts are decimals of 38 digits, exact for counts
below 10 ** 15.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, prepare, ranked, table
from modelsift.llm.hashing import mixed, sequence_hashes
from modelsift.session import written

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
HELD_PERCENT = 50  # a phrase goes if a longer candidate around it is so frequent
SCALE = 1_000_000

TILE = 512
DENSE_TILES = 48  # a task holds at most so many, 2 MB each
DENSE_AT = 1 << 13  # pairs of one block that make a tile dense
BLOCK_BYTES = 2 << 20  # text counted at a time
HELD_PAIRS = 1 << 20  # distinct sparse pairs or words that a task holds before it sends them
CODE_ROWS = 1 << 20  # bounds of what is broadcast
CODE_BYTES = 32 << 20
BITS_EACH = 16  # of the marks of a phrase without a code, while they are no more than MARK_BYTES
MARK_BYTES = 32 << 20
MARK_ROW = 1 << 15  # bits that Spark's bitmap_construct_agg puts into a row
OUTPUT_ROWS = 1 << 16

# A mark between pieces, which no word is as letters are lower-cased; what ends pieces.
BETWEEN = b"A"
ENDS_PIECE = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes.maketrans(bytes(range(65, 91)) + ENDS_PIECE, bytes(range(97, 123)) + BETWEEN * len(ENDS_PIECE))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words and marks between pieces) of some megabytes of texts of one language at a time."""
    held: dict[str, list[bytes]] = {}
    size = Counter()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size[lang] >= BLOCK_BYTES:
                yield lang, words_of(held.pop(lang))
                del size[lang]
    for lang, texts in held.items():
        yield lang, words_of(texts)


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in order, with marks between pieces."""
    return BETWEEN.join(t.translate(_BYTES) for t in texts).replace(BETWEEN, b" " + BETWEEN + b" ").split()


# ---- words -------------------------------------------------------------------------------------


def word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the words of a task, summed while they fit."""
    counts: dict[str, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, of in counts.items():
            words, n = list(of), list(of.values())
            for at in range(0, len(words), OUTPUT_ROWS):
                part = words[at : at + OUTPUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array(n[at : at + OUTPUT_ROWS], pa.int64()),
                    ],
                    ["lang", "phrase", "n"],
                )
        counts.clear()

    for lang, words in blocks(batches):
        of = counts.setdefault(lang, Counter())
        of.update(words)
        del of[BETWEEN]
        if sum(map(len, counts.values())) >= HELD_PAIRS:
            yield from sent()
    yield from sent()


# ---- codes -------------------------------------------------------------------------------------


NONE = -1
FIRST = 1 << 30  # codes from here up are given by a task, for one block of text
LOW = (1 << 32) - 1


@dataclass
class Words:
    """Codes of the words of a language: the words in the order of their crc32. Arrays only, so a million of them are some 30 MB."""

    hashes: np.ndarray
    words: pa.Array
    codes: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, codes: np.ndarray) -> Words:
        hashes = crc(words)
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order], words.take(pa.array(order)), codes[order].astype(np.int32))

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The code of each word, or NONE."""
        codes = np.full(len(words), NONE, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        left = np.arange(len(words))
        while True:  # once more for each word of the same crc32
            near = at[left] < len(self.hashes)
            left = left[near]
            left = left[self.hashes[at[left]] == hashes[left]]
            if not len(left):
                return codes
            same = pc.equal(self.words.take(pa.array(at[left])), words.take(pa.array(left))).to_numpy(zero_copy_only=False)
            codes[left[same]] = self.codes[at[left[same]]]
            left = left[~same]
            at[left] += 1


def crc(words: pa.Array) -> np.ndarray:
    found = np.empty(len(words), np.uint32)
    for at in range(0, len(words), OUTPUT_ROWS):
        part = words.slice(at, OUTPUT_ROWS).to_pylist()
        found[at : at + len(part)] = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
    return found


def word_hashes(lang: str | None, crcs: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of a language, from which sequence_hashes makes those of phrases."""
    return mixed(crcs.astype(np.uint64) | np.uint64(zlib.crc32((lang or "").encode()) << 32))


@dataclass
class Level:
    """Codes of the frequent phrases of one length, as broadcast.

    words: by language (first level). keys and codes: sorted left code << 32 | right code of the broadcast phrases,
    and their codes (further levels). marks: bits for the hashes of the frequent phrases without a code; None if all have
    one.
    """

    words: dict[str, Words] | None = None
    keys: np.ndarray | None = None
    codes: np.ndarray | None = None
    marks: np.ndarray | None = None

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be those of frequent phrases without a code; those of such phrases always are."""
        place = hashes & np.uint64(len(self.marks) * 8 - 1)
        bits = self.marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)
        return (bits & 1).astype(bool)


class Tiles:
    """Counts of pairs of codes: dense tiles for crowded places, sorted coordinates elsewhere."""

    def __init__(self):
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.keys = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Count pairs; codes are at least 0 and below 2 ** 31."""
        across = 2 * FIRST // TILE
        place, at, n = np.unique(left // TILE * across + right // TILE, return_inverse=True, return_counts=True)
        sparse = np.ones(len(left), bool)
        for k in np.flatnonzero(n >= DENSE_AT):
            tile = divmod(int(place[k]), across)
            if tile not in self.dense and len(self.dense) >= DENSE_TILES:
                continue
            here = at == k
            cells = (left[here] % TILE) * TILE + right[here] % TILE
            counted = np.bincount(cells, minlength=TILE * TILE)
            if tile in self.dense:
                self.dense[tile] += counted
            else:
                self.dense[tile] = counted
            sparse &= ~here
        keys = np.sort(left[sparse] << 32 | right[sparse])
        self._merge(*runs_of(keys, np.ones(len(keys), np.int64)))

    def _merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.counts = runs_of(both[order], np.concatenate([self.counts, counts])[order])

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys (left << 32 | right) with counts; each key once. The tiles are empty afterwards."""
        for (row, column), cells in self.dense.items():
            found = np.flatnonzero(cells)
            keys = (row * TILE + found // TILE) << 32 | (column * TILE + found % TILE)
            self._merge(keys, cells[found])
        keys, counts = self.keys, self.counts
        self.__init__()
        return keys, counts


def runs_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def word_codes(level: Level, lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
    """The code of each word, NONE for marks and for words that are not frequent; the hash of each if some have no code."""
    found = pa.array(words, pa.binary()).dictionary_encode()
    at, distinct = found.indices.to_numpy(), found.dictionary
    crcs = crc(distinct)
    codes = level.words[lang].find(distinct, crcs) if lang in level.words else np.full(len(distinct), NONE, np.int64)
    hashes = word_hashes(lang, crcs)
    if level.marks is not None:
        own = (codes == NONE) & level.marked(phrase_hashes(hashes, 1))
        own &= pc.not_equal(distinct, pa.scalar(BETWEEN, pa.binary())).to_numpy(zero_copy_only=False)
        codes[own] = FIRST + np.arange(own.sum())
    return codes[at], hashes[at]


def phrase_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Of the phrases of so many words that begin at each place, from the hashes of the words."""
    return sequence_hashes(words, length, np.array([0, len(words)]))[0]


def phrase_codes(level: Level, parts: np.ndarray, last: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of the phrase that begins at each place and has length words, from the codes of its parts.

    parts[i]: of the phrase one word shorter that begins at i; last[i]: of the word at i. Also the left << 32 | right codes
    of the phrases with codes from FIRST up, in order.
    """
    n = max(len(last) - length + 1, 0)
    left, right = parts[:n], last[length - 1 : length - 1 + n]
    codes = np.full(n, NONE, np.int64)
    there = np.flatnonzero((left != NONE) & (right != NONE))
    keys = left[there] << 32 | right[there]
    if len(level.keys):
        at = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
        codes[there] = np.where(level.keys[at] == keys, level.codes[at], NONE)
    if level.marks is None:
        return codes, keys[:0]
    rest = codes[there] == NONE
    rest[rest] = level.marked(phrase_hashes(hashes, length)[there[rest]])
    own, at = np.unique(keys[rest], return_inverse=True)
    codes[there[rest]] = FIRST + at
    return codes, own


def phrase_counter(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(left, right, lang, phrase, n) of the phrases one word longer than the levels broadcast.

    left and right are the codes of all words but the last and of the last; lang and phrase are null then. Of three words
    whose first two have codes but no code as a pair, left is pair_key of those. Phrases with a word that has no code, and
    longer ones with a part that has none, have lang and phrase instead.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[Level] = shared.value
        tiles = Tiles()

        def sent() -> Iterator[pa.RecordBatch]:
            keys, counts = tiles.taken()
            for at in range(0, len(keys), OUTPUT_ROWS):
                part = slice(at, at + OUTPUT_ROWS)
                yield counted_rows(keys[part] >> 32, keys[part] & LOW, counts[part])

        for lang, words in blocks(batches):
            last, hashes = word_codes(levels[0], lang, words)
            parts, pairs = last, last[:0]
            for length, level in enumerate(levels[1:], 2):
                parts, pairs = phrase_codes(level, parts, last, hashes, length)
            n = max(len(words) - len(levels), 0)
            left, right = parts[:n], last[len(levels) : len(levels) + n]
            there = (left != NONE) & (right != NONE)
            if len(levels) > 1:
                # The end of the phrase must be frequent as well.
                there &= parts[1 : n + 1] != NONE
            own = there & ((left >= FIRST) | (right >= FIRST))
            there &= ~own
            tiles.add(left[there], right[there])
            if own.any():
                yield from own_rows(lang, words, len(levels) + 1, pairs, left, right, own)
            if len(tiles.keys) >= HELD_PAIRS:
                yield from sent()
        yield from sent()

    return count


def own_rows(
    lang: str, words: list[bytes], length: int, pairs: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The counts of a block's phrases (those at the places own) that have codes of the block."""
    keys, first, counts = np.unique(left[own] << 32 | right[own], return_index=True, return_counts=True)
    first = np.flatnonzero(own)[first]
    if length == 3:
        by_pair = (keys >> 32 >= FIRST) & (keys & LOW < FIRST)
        pair = pairs[(keys >> 32)[by_pair] - FIRST]
        plain = (pair >> 32 < FIRST) & (pair & LOW < FIRST)
        by_pair[by_pair] = plain
        pair = pair_key(pair[plain] >> 32, pair[plain] & LOW)
        for at in range(0, len(pair), OUTPUT_ROWS):
            part = slice(at, at + OUTPUT_ROWS)
            yield counted_rows(pair[part], (keys & LOW)[by_pair][part], counts[by_pair][part])
        first, counts = first[~by_pair], counts[~by_pair]
    for at in range(0, len(first), OUTPUT_ROWS):
        phrases = [b" ".join(words[i : i + length]) for i in first[at : at + OUTPUT_ROWS].tolist()]
        yield counted_rows(None, None, counts[at : at + OUTPUT_ROWS], lang, phrases)


def pair_key(left, right):
    """A number below 0 for the codes of two words, to and from which first_of and second_of go."""
    return -1 - (left << 30 | right)


def first_of(key: str) -> Column:
    return F.shiftright(-1 - F.col(key), 30)


def second_of(key: str) -> Column:
    return (-1 - F.col(key)).bitwiseAND(FIRST - 1)


def counted_rows(left, right, counts: np.ndarray, lang: str | None = None, phrases: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(counts)
    columns = [
        pa.nulls(n, pa.int64()) if left is None else pa.array(left, pa.int64()),
        pa.nulls(n, pa.int64()) if right is None else pa.array(right, pa.int64()),
        pa.nulls(n, pa.string()) if phrases is None else pa.array([lang] * n, pa.string()),
        pa.nulls(n, pa.string()) if phrases is None else pa.array(phrases, pa.binary()).cast(pa.string()),
        pa.array(counts, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["left", "right", "lang", "phrase", "n"])


# ---- tables ------------------------------------------------------------------------------------


def coded(counts: DataFrame, name: str, columns: list[str], rows: int, size: int) -> tuple[DataFrame, DataFrame]:
    """counts with code, their rank by frequency over all languages, and those of them that are broadcast."""
    rows_ = counts.withColumn(OWN + "bytes", F.octet_length("phrase").cast("long"))
    order = [F.desc("n"), F.asc("lang"), F.asc("phrase")]
    all_ = ranked(rows_, order, name, OWN + "bytes").withColumnRenamed(OWN + "position", "code")
    fits = (F.col("code") < rows) & (F.col(OWN + "before") + F.col(OWN + "bytes") <= size)
    if "left" in columns:
        fits &= F.coalesce(F.col("left") >= 0, F.lit(False))
    all_ = written(all_.withColumn(OWN + "fits", fits), name + "-codes")
    return all_.drop(OWN + "bytes", OWN + "before"), all_.filter(OWN + "fits").select(*columns, "code")


def phrase_counts(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, rows: int = CODE_ROWS, size: int = CODE_BYTES
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length from 1 the phrases (lang, phrase, n) that occur min_count times.

    Phrases of two words and more also tell head, tail (the phrases without the last and without the first word).
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    found = texts.mapInArrow(word_counter, "lang string, phrase string, n long")
    words = written(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrases-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= min_count)
    full, table_ = coded(frequent, "phrases-1", ["lang", "phrase"], rows, size)
    result, levels = [full.select("lang", "phrase", "n")], []
    # (code, lang, phrase) of the words that have codes.
    known = full.filter(OWN + "fits").select("code", "lang", "phrase")
    code_words = known.select(F.col("code").alias("right"), F.col("phrase").alias(OWN + "last"))
    held = full.filter(OWN + "fits").select(F.col("code").alias("left"), "lang", "phrase")
    for length in range(2, max_words + 1):
        levels.append(broadcastable(full, table_, length - 1))
        shared = spark.sparkContext.broadcast(levels.copy())
        found = texts.mapInArrow(phrase_counter(shared), "left long, right long, lang string, phrase string, n long")
        counts = found.groupBy("left", "right", "lang", "phrase").agg(F.sum("n").alias("n"))
        # Which parts have broadcast codes is alike in all tasks, so a phrase is always sent by the same codes, or always by its text.
        counts = written(counts.filter(F.col("n") >= min_count), f"phrases-{length}-counts")
        shared.unpersist()
        named = counts.filter("left >= 0").drop("lang", "phrase").join(held, "left").join(code_words, "right")
        named = named.select("left", "right", "lang", F.concat_ws(" ", "phrase", OWN + "last").alias("phrase"), "n")
        every = named.unionByName(counts.filter("left is null"))
        if length == 3 and levels[1].marks is not None:
            pairs = counts.filter("left < 0").select("left", "right", "n", first_of("left").alias("code"), second_of("left").alias(OWN + "second"))
            pairs = pairs.join(known, "code").join(known.select(F.col("code").alias(OWN + "second"), F.col("phrase").alias(OWN + "middle")), OWN + "second")
            pairs = pairs.join(code_words, "right").withColumn("phrase", F.concat_ws(" ", "phrase", OWN + "middle", OWN + "last"))
            every = every.unionByName(pairs.select("left", "right", "lang", "phrase", "n"))
        full, table_ = coded(every, f"phrases-{length}", ["left", "right"], rows, size)
        held = full.filter(OWN + "fits").select(F.col("code").alias("left"), "lang", "phrase")
        result.append(full.select("lang", "phrase", "n"))
    return totals, result


def broadcastable(full: DataFrame, table_: DataFrame, length: int) -> Level:
    """The codes of a level as what tasks look up: at most CODE_ROWS rows, CODE_BYTES bytes of text and MARK_BYTES of marks."""
    rows = table_.toArrow().combine_chunks()
    without = full.count() - rows.num_rows
    marks = marks_of(full.filter(~F.col(OWN + "fits")), length, without) if without else None
    codes = rows["code"].to_numpy()
    if length == 1:
        words = {}
        for lang in rows["lang"].unique().to_pylist():
            these = pc.equal(rows["lang"], lang)
            of = rows["phrase"].filter(these).combine_chunks().cast(pa.binary())
            words[lang] = Words.of(of, codes[these.to_numpy()])
        return Level(words=words, marks=marks)
    keys = rows["left"].to_numpy() << 32 | rows["right"].to_numpy()
    order = np.argsort(keys)
    return Level(keys=keys[order], codes=codes[order], marks=marks)


def marks_of(phrases: DataFrame, length: int, n: int) -> np.ndarray:
    """Bits for the hashes of n phrases of so many words, set by Spark; the driver only puts rows of MARK_ROW bits side by side."""
    bits = min(8 * MARK_BYTES, max(MARK_ROW, 1 << (BITS_EACH * n - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = np.array([zlib.crc32(x.encode()) for x in batch.column("lang").to_pylist()], np.uint64)
            words = b" ".join(batch.column("phrase").cast(pa.binary()).to_pylist()).split(b" ")
            hashes = crc(pa.array(words, pa.binary())).astype(np.uint64) | np.repeat(langs, length) << np.uint64(32)
            place = sequence_hashes(mixed(hashes), length, np.arange(0, len(words) + 1, length))[0] & np.uint64(bits - 1)
            place = place.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place // MARK_ROW), pa.array(place % MARK_ROW)], ["row", "bit"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "row long, bit long").repartition("row")
    marks = np.zeros((bits // MARK_ROW, MARK_ROW // 8), np.uint8)
    for row in found.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow().to_batches():
        for at, of in zip(row["row"].to_pylist(), row["bits"].to_pylist(), strict=True):
            marks[at] = np.frombuffer(of, np.uint8)
    return marks.reshape(-1)


# ---- scores ------------------------------------------------------------------------------------


def words_in(phrase: Column) -> Column:
    return F.split(phrase, " ")


def part(column: str, first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words_in(F.col(column)), first, length), " ")


def collocations(
    docs: DataFrame,
    top: int | None = TOP,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    held_percent: int = HELD_PERCENT,
    rows: int = CODE_ROWS,
    size: int = CODE_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the candidates that stay, each language's first top (None: all).

    a: occurrences of the phrase; l and r: of the two parts of its lowest-scoring cut; n: words of the language; score:
    SCALE * a * a / (l * r), rounded down. A candidate goes if a longer candidate around it occurs held_percent of its
    times; of those the one with one word more is the most frequent, so only that length is looked at.
    """
    totals, levels = phrase_counts(docs, max_words, min_count, rows, size)
    scored = []
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    for length in range(2, max_words + 1):
        these = levels[length - 1].withColumnRenamed("n", "a")
        cuts = None
        for k in range(1, length):
            left = levels[k - 1].select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
            right = levels[length - k - 1].select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
            cut = (
                these.withColumn("first", part("phrase", 1, k))
                .withColumn("rest", part("phrase", k + 1, length - k))
                .join(left, ["lang", "first"])
                .join(right, ["lang", "rest"])
                .select("lang", "phrase", "a", "l", "r", F.lit(k).alias("k"))
            )
            cuts = cut if cuts is None else cuts.unionByName(cut)
        square = (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
        cuts = cuts.withColumn("_square", square).withColumn("_product", wide("l") * wide("r"))
        cuts = cuts.withColumn("score", F.expr("_square div _product"))
        best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("b"))
        best = best.select("lang", "phrase", "b.*")
        if length < max_words:
            longer = levels[length].select("lang", "n", F.explode(F.array(part("phrase", 1, length), part("phrase", 2, length))).alias("phrase"))
            around = longer.groupBy("lang", "phrase").agg(F.max("n").alias("_around"))
            best = best.join(around, ["lang", "phrase"], "left").filter(
                F.col("_around").isNull() | (F.col("_around") * 100 < F.col("a") * held_percent)
            )
            best = best.drop("_around")
        scored.append(best)
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    placed = every.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        placed = placed.filter(F.col("rank") <= top)
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_tiled_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents").select("lang", "text"))


SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS e FROM d),
p AS (SELECT lang, regexp_extract_all(e, '[^\x20\x09]+') AS w, row_number() OVER () AS p FROM e),
u AS (SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM p),
g AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY p ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*)::BIGINT FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*)::BIGINT FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
v AS (SELECT lang || ':' || phrase AS name, f FROM f),
c AS (SELECT * FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
s AS (
  SELECT c.lang, c.phrase, c.k, j, c.f AS a, x.f AS l, y.f AS r,
         ({SCALE}::HUGEINT * c.f::HUGEINT * c.f::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM (SELECT *, lang || ':' || array_to_string(w[1:j], ' ') AS first, lang || ':' || array_to_string(w[j + 1:], ' ') AS rest
        FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c)) AS c
  JOIN v AS x ON x.name = c.first JOIN v AS y ON y.name = c.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
z AS (
  SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2
  WHERE o.f IS NULL OR 100 * o.f < {HELD_PERCENT} * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= {TOP}
"""
