"""Phrase collocations of each language by SON: shards are mined at lowered support, then the union is counted exactly.

A text is lower-cased (A-Z), cut into pieces at ``ENDERS`` and pieces into words at spaces and tabs; a phrase is a run of words of one piece.

1. Every word's occurrences are counted by language; their sum is n.
2. A task takes ``SHARD`` to twice ``SHARD`` bytes of text at a time; the texts of one language in them are a shard. A shard with n_i of the language's n words
   is mined by growing phrases at a support of ceil(least * n_i / n), at least 1 and at most ``MOST_SUPPORT``: a support that falls as the corpus
   grows would have a shard name more phrases the more shards there are. A phrase that occurs ``least`` times reaches its support in one shard at
   least, as its counts in the others would add up to less.
3. The shards' phrases are united. A shard that doesn't name a phrase holds less of it than its support, so a phrase whose named counts and
   those bounds add up to less than ``least`` is dropped; this loses none. Phrases are named by 64-bit hashes here: two with one hash pass together.
4. Steps 2 and 3 run twice: for two words, among words that occur ``least`` times, then for longer phrases, among the pairs left.
5. All shards count the phrases left. What the tasks know of them, and of the words and pairs before, is a bit filter of a fixed size: a phrase that isn't in
   it is not counted, one that is there by chance is, and drops out by its count. So nothing that grows with the data is broadcast.

Scores, cuts and containment are joins over the candidates and exact: products are decimals of 38 digits, larger ones an error.
A null language is ``und``, a null or empty text has no words. Repeated rows count each. The best of a language are ranked
by score, occurrences and the phrase's bytes, so ranks have no ties. Empty tables and languages without candidates give no rows. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.shared import give_back, temporary_tables, written
from rulewright.sources.tables import with_row_id

#: Bytes of text that a task mines at a time, and that it splits into words at once.
SHARD, SLICE = 20 << 20, 1 << 20
#: The highest support at which a shard is mined.
MOST_SUPPORT = 2
#: Bits of the filter of candidates; a phrase sets two.
FILTER_BITS = 1 << 26

#: Lower-cases A-Z; characters that end a piece become line feeds, tabs spaces.
ENDERS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in ENDERS else 32 if c == 9 else c for c in range(256))
#: Stands for the end of a piece among the words: a byte that no text has.
END = b"\xff"


class Numbers(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Shard:
    """Texts of one language as numbers of words, 0 between pieces."""

    def __init__(self):
        self.numbers, self.parts, self.n_words = Numbers(), [], 0

    def add(self, text: bytes) -> None:
        folded, at = text.translate(FOLD), 0
        while at < len(folded):
            end = at + SLICE
            while end < len(folded) and folded[end] not in b" \n":
                end += 1
            words = folded[at:end].replace(b"\n", b" \xff ").split()
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.n_words += int(np.count_nonzero(self.parts[-1]))
            at = end
        self.parts.append(np.zeros(1, np.int32))

    def absorb(self, other: Shard) -> None:
        number = np.fromiter(map(self.numbers.__getitem__, other.numbers), np.int32, len(other.numbers))
        self.parts += [number[part] for part in other.parts]
        self.n_words += other.n_words

    def close(self) -> None:
        self.words = np.concatenate(self.parts)
        self.parts = []
        self.vocabulary = pa.array(list(self.numbers), pa.binary())

    def grow(self, longest: int, keep: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places of first occurrences, counts) of the k-word phrases that ``keep(k, places, counts)`` marks, for k = 1 to ``longest``.

        A phrase is counted only where its first k - 1 words and its last ones were kept, whose two numbers name it.
        """
        at = np.full(len(self.words) + 1, -1, np.int32)  # the number of the kept phrase that begins here
        places = np.nonzero(self.words)[0].astype(np.int32)
        codes = self.words[places]
        for k in range(1, longest + 1):
            if not len(places):
                return
            order = np.argsort(codes, kind="stable").astype(np.int32)  # not np.unique, whose copies take twice the memory
            codes = codes[order]
            starts = np.nonzero(np.append(True, codes[1:] != codes[:-1]))[0]
            counts, first = np.diff(np.append(starts, len(codes))), places[order[starts]]
            kept = keep(k, first, counts)
            yield k, first[kept], counts[kept]
            if k == longest:
                return
            at[:] = -1
            at[places[order]] = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32), counts)
            del codes, order
            places = places[(at[places] >= 0) & (at[places + 1] >= 0)]
            codes = at[places].astype(np.int64) * (int(kept.sum()) + 1) + at[places + 1]

    def phrases(self, k: int, places: np.ndarray) -> pa.Array:
        """The k words from each place, joined by spaces."""
        words = [self.vocabulary.take(pa.array(self.words[places + j])) for j in range(k)]
        return pc.binary_join_element_wise(*words, b" ").cast(pa.string())


def shards(batches, size: int = SHARD) -> Iterator[tuple[str, int | None, Shard]]:
    """(lang, the language's words if known, shard) from batches of (lang, text, n), ``size`` to twice ``size`` bytes of text at a time; only
    a task that has less makes smaller shards, as a small one has a low support and many phrases that reach it."""
    full: dict[str, tuple[int | None, Shard]] = {}
    held: dict[str, tuple[int | None, Shard]] = {}
    taken = 0

    def closed():
        while full:
            lang, (n, shard) = full.popitem()
            shard.close()
            yield lang, n, shard

    for batch in batches:
        for lang, text, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if taken >= size:
                yield from closed()
                full, held, taken = held, {}, 0
            held.setdefault(lang, (n, Shard()))[1].add(text)
            taken += len(text)
    for lang, (n, shard) in held.items():
        full.setdefault(lang, (n, Shard()))[1].absorb(shard)
    held.clear()
    yield from closed()


def local_support(least: int, part: int, whole: int, most: int = MOST_SUPPORT) -> int:
    """The smallest whole number of at least ``least * part / whole``, but 1 at least and ``most`` at most."""
    return min(max(-(-least * part // whole), 1), most)


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in words.to_pylist()], np.uint64)


def phrase_hashes(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases; ``hashes`` has the first words' hashes of all phrases, then the second words', and so on."""
    h = np.full(len(hashes[0]), word_hashes(pa.array([lang.encode()]))[0])
    for word in hashes:
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def listed(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks the hashes that the filter lets through: both of a hash's bits are set."""
    has = lambda b: known[b // np.uint64(8)] >> (b % np.uint64(8)).astype(np.uint8) & 1
    return (has(h % np.uint64(FILTER_BITS)) & has((h >> np.uint64(32)) % np.uint64(FILTER_BITS))).astype(bool)


def hashed_words(words: DataFrame) -> DataFrame:
    """(h) of every (lang, phrase) of one word."""

    def hashes(batches):
        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                found = word_hashes(batch["phrase"].filter(pc.equal(batch["lang"], lang)).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(lang, [found]).view(np.int64))], ["h"])
        give_back()

    return words.select("lang", "phrase").mapInArrow(hashes, "h long")


def candidate_filter(hashes: DataFrame) -> np.ndarray:
    """Bytes that hold the bits of all (h): the driver gets at most ``FILTER_BITS`` bits, whatever their number."""
    low = F.lit(FILTER_BITS - 1)
    bit = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low))).alias("bit"))
    set_bits = bit.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    found = np.zeros(FILTER_BITS // 64, np.int64)
    found[set_bits["at"].to_numpy()] = set_bits["bits"].to_numpy()
    return found.view(np.uint8)


def rows(lang: str, phrases: pa.Array, numbers: np.ndarray, name: str, key: str = "phrase") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases, pa.array(numbers, pa.int64())], ["lang", key, name])


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word."""

    def count(batches):
        for lang, _, shard in shards(batches):
            for _, places, counts in shard.grow(1, lambda k, places, counts: counts > 0):
                yield rows(lang, shard.phrases(1, places), counts, "f")
        give_back()

    counted = texts.withColumn("n", F.lit(None).cast("long")).mapInArrow(count, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def mine_shards(texts: DataFrame, bits, least: int, shortest: int, longest: int, size: int) -> DataFrame:
    """(lang, h, over) from texts with n: each shard's phrases of ``shortest`` to ``longest`` words that reach its support, and how far they are over the most
    that a shard holds of a phrase that doesn't. Shorter parts of them are in the broadcast filter. A row without h tells that most of the shard."""

    def mine(batches):
        known = bits.value
        for lang, n, shard in shards(batches, size):
            support, hashes = local_support(least, shard.n_words, n), word_hashes(shard.vocabulary)

            def named(places, k, lang=lang, shard=shard, hashes=hashes):
                return phrase_hashes(lang, [hashes[shard.words[places + j]] for j in range(k)])

            def keep(k, places, counts, support=support, named=named):
                return counts >= support if k >= shortest else listed(known, named(places, k))

            yield rows(lang, pa.array([None], pa.int64()), np.array([support - 1]), "over", "h")
            for k, places, counts in shard.grow(longest, keep):
                if k >= shortest:
                    yield rows(lang, pa.array(named(places, k).view(np.int64)), counts - (support - 1), "over", "h")
        give_back()

    return texts.mapInArrow(mine, "lang string, h long, over long")


def count_candidates(texts: DataFrame, bits, longest: int, size: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of 2 words and more that the broadcast filter lets through."""

    def count(batches):
        known = bits.value
        for lang, _, shard in shards(batches, size):
            hashes = word_hashes(shard.vocabulary)

            def keep(k, places, counts, lang=lang, shard=shard, hashes=hashes):
                return listed(known, phrase_hashes(lang, [hashes[shard.words[places + j]] for j in range(k)]))

            for k, places, counts in shard.grow(longest, keep):
                if k > 1:
                    yield rows(lang, shard.phrases(k, places), counts, "f")
        give_back()

    return texts.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(texts: DataFrame, least: int, longest: int, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): (lang, phrase, f) of every phrase of 2 to ``longest`` words and of every word with f >= ``least``, and (lang, n)."""
    context = texts.sparkSession.sparkContext
    words = written(count_words(texts), "collocation-words")
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "collocation-totals")
    words = words.where(F.col("f") >= least)
    n_tasks = math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (1.5 * size))
    known = texts.join(totals, "lang").select("lang", "text", "n").coalesce(max(n_tasks, 1))  # few large shards name few rows twice
    bits = context.broadcast(candidate_filter(hashed_words(words)))
    for shortest, to in ((2, 2), (3, longest)):
        if shortest > longest:
            break
        mined = written(mine_shards(known, bits, least, shortest, to, size), "collocation-shards")
        bounds = mined.where(F.col("h").isNull()).groupBy("lang").agg(F.sum("over").alias("bound"))
        united = mined.where(F.col("h").isNotNull()).groupBy("lang", "h").agg(F.sum("over").alias("over"))
        found = candidate_filter(united.join(bounds, "lang").where(F.col("over") + F.col("bound") >= least).select("h"))
        before, bits = bits, context.broadcast(bits.value | found)
        before.unpersist()
    phrases = written(count_candidates(known, bits, longest, size).where(F.col("f") >= least), "collocation-phrases")
    bits.unpersist()
    return phrases, words, totals


def weakest_cuts(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the cut with the lowest floor(1000 * a * n / (l * r)), the earliest of equal ones."""
    parts = phrases.unionByName(words)
    split = F.split("phrase", " ")
    cut = phrases.withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.size(split) - 1)))
    cut = cut.withColumns({"first": F.array_join(F.slice(split, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(split, F.col("k") + 1, F.size(split)), " ")})
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0)) * 1000) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cut.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the most that a longer phrase around it occurs."""
    split, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.array_join(F.slice(split, s, m), " "))))
    inner = phrases.where(size > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("f").alias("most"))
    return inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language that occur ``least`` times, without those that
    a longer one with at least ``percent`` in a hundred of their occurrences holds."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    with temporary_tables():
        phrases, words, totals = frequent_phrases(texts, least, longest, size)
        scored = weakest_cuts(phrases, words, totals).join(contained(phrases), ["lang", "phrase"], "left")
        scored = scored.where(F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True)))
        ordered = scored.select("lang", "phrase", "a", "l", "r", "n", "score", (-F.col("score")).alias("_score"), (-F.col("a")).alias("_a"))
        placed = with_row_id(ordered, ["lang", "_score", "_a", "phrase"], "_place")
        rank = F.col("_place") - F.col("_before") + 1
        ranked = placed.join(placed.groupBy("lang").agg(F.min("_place").alias("_before")), "lang").withColumn("rank", rank)
        return written(ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)
