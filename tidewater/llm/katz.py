"""Scoring texts with a Katz backoff trigram model.

Documents are cut into blocks of ``BLOCK_TOKENS`` tokens at most, stored once as arrays, and each kind of count lives in a table partitioned into
ranges. A block sends a range its distinct n-grams with what it has counted, the range adds up over all blocks, and answers each block about the
n-grams that it has asked for. So every token is evaluated beside its block, while no task holds more than a block or a range, and what is
moved is pre-aggregated. One exchange each: words; pairs of words; mass of one-word contexts; trigrams with the mass of two-word contexts.

The mass of a context is carried as whole numbers, from which each block computes the same weights. From the first answers on, a word is a number, and a pair of words is the pair of their numbers, scrambled by a bijection, so that no two n-grams ever
share a key. A two-word context that only one block holds is settled there and not sent at all, and a block gets the mass only of the contexts that it has
to back off from, which a learned trigram never does. A context of more than ``HOT`` tokens is
dealt to several ranges by the word that follows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import discard, map_batches, materialise, ready, remainder, table

BLOCK_TOKENS = 1_000_000
RANGE_TOKENS = 3_000_000
HOT = 500_000
#: Counts up to this one are discounted (Good-Turing).
TOP = 5
END = np.uint64(0x243F6A8885A308D3)
BEGIN = np.uint64(0x13198A2E03707344)
#: Discounts are multiples of 2**-20. What is added up over blocks is whole numbers only (how many n-grams have counts 1 to TOP, and the sum of
#: the larger counts), so that all sums are exact in any order and at any size.
STEP = 2.0**20
ROWS = "kind string, range long, block long, keys binary, first binary, second binary"
ANSWERS = "kind string, range long, block long, first binary, second binary, third binary, stats array<double>"
ROW_COLUMNS, ANSWER_COLUMNS = ([c.split()[0] for c in x.split(", ")] for x in (ROWS, ANSWERS))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def scrambled(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers below 2**bits, even in their upper bits."""
    mask, half = np.uint64(2**bits - 1), np.uint64(bits // 2)
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x * np.uint64(factor)) & mask
        x = x ^ (x >> half)
    return x


def packed(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def packed_values(x: np.ndarray) -> bytes:
    """Whole numbers, not negative."""
    return packed(np.asarray(x).astype(np.uint64))


def unpacked_values(data: bytes) -> np.ndarray:
    return unpacked(data, np.uint64).astype(np.float64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, where one of each is, and which of them each element is."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(x)]
    which = np.empty(len(x), dtype=np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], order[new], which


def tokens(text: str | None) -> list[bytes]:
    """Words between white space (space and 0x09 to 0x0D), with A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1  # 0 is the end
        return n


def cut(docs: DataFrame) -> DataFrame:
    """Blocks of documents (id, text, learn): ids, numbers of the rows, which are learned from, tokens in each, hashes of the words
    and which of these, in order, each token is. A longer document goes on in other blocks, each beginning with the two words before (``leads``)."""

    def block(number, docs, words, index):
        uids, ids, learn, sizes, leads = zip(*docs)
        hashes = np.concatenate(([END], np.fromiter((xxhash.xxh64_intdigest(w) for w in index), dtype=np.uint64, count=len(index)), [BEGIN]))
        hashes, _, which = distinct(hashes)
        return pd.DataFrame({
            "block": [(TaskContext.get().partitionId() << 24) + number], "ids": [list(ids)], "uids": [list(uids)], "learn": [np.array(learn, np.uint8).tobytes()],
            "sizes": [packed(np.array(sizes, np.uint32))], "leads": [packed(np.array(leads, np.uint8))], "words": [packed(which[np.concatenate(words)])],
            "hashes": [packed_keys(hashes)], "begin": [int(which[-1])], "vocabulary": [len(hashes)], "tokens": [sum(sizes) - sum(leads)],
        })

    def run(batches):
        number, row, docs, words, index, held = 0, TaskContext.get().partitionId() << 40, [], [], Index(), 0
        for pdf in batches:
            for i, t, flag in zip(pdf["id"].tolist(), pdf["text"], pdf["learn"]):
                found, row = tokens(t), row + 1
                for at in range(0, len(found) + 1, BLOCK_TOKENS):
                    lead = min(2, at)
                    part = found[at - lead : at + BLOCK_TOKENS]
                    words.append(np.fromiter(map(index.__getitem__, part), dtype=np.uint32, count=len(part)))
                    ends = at + BLOCK_TOKENS > len(found)
                    if ends:
                        words.append(np.zeros(1, dtype=np.uint32))
                    docs.append((row, None if i is None or i != i else int(i), flag, len(part) + ends, lead))
                    held += len(part) + ends
                    if held >= BLOCK_TOKENS:
                        yield block(number, docs, words, index)
                        number, docs, words, index, held = number + 1, [], [], Index(), 0
        if docs:
            yield block(number, docs, words, index)

    return map_batches(docs, run, "block long, ids array<long>, uids array<long>, learn binary, sizes binary, leads binary, words binary, hashes binary, begin int, vocabulary int, tokens long")


def discounts(counts_of_counts: list[float]) -> np.ndarray:
    """Discount of counts 0 to TOP; counts above keep theirs. Good-Turing as Katz normalises it; half a count is taken where the
    counts of counts give no discount between 0 and 1."""
    n = [0.0, *counts_of_counts]
    shift = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 0.0
    out = np.ones(TOP + 2)
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - shift) / (1 - shift) if n[r] and shift < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    # below 1, so that what is discounted leaves a share
    out[1 : TOP + 1] = np.minimum(np.rint(out[1 : TOP + 1] * STEP), STEP - 1) / STEP
    return out


def few(counts: np.ndarray) -> np.ndarray:
    """Sum, number, and how many of 1 to TOP + 1 there are of the counts above 0."""
    return np.array([counts.sum(), (counts > 0).sum(), *np.bincount(np.minimum(counts, TOP + 2).astype(np.int64), minlength=TOP + 3)[1 : TOP + 2]], dtype=float)


def tallied(of: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each of n contexts, how many of its counts are 1 to TOP, and the sum of the larger ones: TOP + 1 rows."""
    rows = [np.bincount(of, weights=counts == r, minlength=n) for r in range(1, TOP + 1)]
    return np.stack([*rows, np.bincount(of, weights=np.where(counts > TOP, counts, 0), minlength=n)])


class Model:
    """What is known of the whole corpus: tokens, words, documents and the discounts of each order; bits of a word's number."""

    def __init__(self, stats: dict[str, list[float]], documents: int, ranges: int):
        self.documents, self.ranges = documents, ranges
        nothing = [0.0] * (TOP + 4)
        one, two = list(stats.get("c1", nothing)), list(stats.get("c2", nothing))
        if documents and "c2" in stats:  # the context before a first word stands among the pairs
            for at in [1, *([1 + documents] if documents <= TOP + 1 else [])]:
                two[at] -= 1
        self.total, self.words = one[0], one[1]
        self.bits = max(16, (int(one[-1] + 1) * ranges).bit_length())
        self.d = {k: discounts(s[2 : TOP + 3]) for k, s in ((1, one), (2, two), (3, stats.get("c3", nothing)))}
        kept = self.total - sum(r * one[1 + r] * (1 - self.d[1][r]) for r in range(1, TOP + 1))
        self.divisor = self.total if kept < self.total else self.total + 1
        self.unknown = 1 - kept / self.divisor

    def discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        return self.d[k][np.minimum(c, TOP + 1).astype(np.int64)] * c

    def kept(self, k: int, table: np.ndarray) -> np.ndarray:
        """Sum of the discounted counts of each context that ``tallied`` has."""
        return (self.d[k][1 : TOP + 1] * np.arange(1, TOP + 1)) @ table[:TOP] + table[TOP]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounted(1, c) / self.divisor, self.unknown)


def weights(count: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divisor and backoff weight of contexts: their counts, discounted counts of what follows, and its probability under
    the shorter context. Where nothing was discounted, the divisor has one more, so that unseen words get a share."""
    divisor = np.where(kept < count * (1 - 1e-12), count, count + 1.0)
    divisor = np.maximum(divisor, 1.0)
    return divisor, np.where(count > 0, (1 - kept / divisor) / np.maximum(1 - lower, 1e-300), 1.0)


class State:
    """A block's tokens with all that the answers so far say about them."""

    def __init__(self, row):
        self.block, self.ids, self.uids = int(row["block"]), row["ids"], row["uids"]
        self.sizes = unpacked(row["sizes"], np.uint32).astype(np.int64)
        self.leads = unpacked(row["leads"], np.uint8).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word, self.begin, self.vocabulary = unpacked(row["words"], np.int32), int(row["begin"]), int(row["vocabulary"])
        learned = np.frombuffer(row["learn"], dtype=np.uint8)
        self.learned_starts = float(learned[self.leads == 0].sum())
        self.learn = np.repeat(learned, self.sizes)
        # the words that lead a part are scored and counted where they stand first
        self.lead = np.arange(len(self.word)) - np.repeat(self.starts, self.sizes) < np.repeat(self.leads, self.sizes)
        self.learn[self.lead] = 0
        self.first = np.zeros(len(self.word), dtype=bool)
        self.first[self.starts] = True

    def words(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.learn, minlength=self.vocabulary)

    def number(self, model: Model, answers) -> None:
        """Numbers of the words, from the answers about them, and the pairs."""
        self.model = model
        one, _, at, where = answers("c1")
        self.at1, self.where1 = at, where
        numbers = at * np.uint64(model.ranges) + where.astype(np.uint64)
        self.c1 = one[self.word]
        self.w = numbers[self.word]
        self.before = np.concatenate(([self.begin], self.word[:-1]))
        self.before[self.first] = self.begin
        bits = np.uint64(model.bits)
        start = (numbers[self.begin] << bits) | numbers[self.begin]
        pair = np.concatenate(((numbers[self.before] << bits) | self.w, [start]))
        self.keys2, self.at2, which = distinct(scrambled(pair, 2 * model.bits))
        self.in2, self.start = which[:-1], int(which[-1])
        self.own2 = np.bincount(self.in2, weights=self.learn, minlength=len(self.keys2))
        self.own2[self.start] = self.learned_starts

    def pairs(self, answers) -> None:
        two, flags, at, where = answers("c2")
        flags = flags.astype(np.int64)
        self.two, self.mine, self.alone = two, flags & 1 > 0, flags & 2 > 0
        asked = (two > 0) & ~self.alone
        self.at2_, self.where2 = np.zeros(len(two), dtype=np.uint64), np.zeros(len(two), dtype=np.int64)
        self.at2_[asked], self.where2[asked] = at, where
        self.c2, self.p1 = two[self.in2], self.model.unigram(self.c1)
        self.context = np.where(self.first, self.start, np.concatenate(([self.start], self.in2[:-1])))
        self.count1 = self.word_counts()[self.before]
        self.count2 = two[self.context]

    def word_counts(self) -> np.ndarray:
        out = np.zeros(self.vocabulary)
        out[self.word] = self.c1
        out[self.begin] = self.model.documents
        return out

    def mass1(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word, as a context: the counts of the bigrams that this block accounts for, and those of their words."""
        mine = self.mine & (self.two > 0)
        mine[self.start] = False
        seen = np.flatnonzero(mine)
        at, n = self.at2[seen], self.vocabulary
        return tallied(self.before[at], self.two[seen], n), tallied(self.before[at], self.c1[at], n)

    def bigrams(self, answers) -> None:
        bigrams, words, _, _ = answers("m1", (TOP + 1, TOP + 1, 0))
        self.divisor1, alpha = weights(self.word_counts(), self.model.kept(2, bigrams), self.model.kept(1, words) / self.model.divisor)
        self.p2 = np.where(self.c2 > 0, self.model.discounted(2, self.c2) / self.divisor1[self.before], alpha[self.before] * self.p1)
        # trigrams that may be known, by context and word; a context whose mass is asked for has a word that does not exist besides
        self.asks3 = np.flatnonzero((self.count2 > 0) & (self.c2 > 0))
        bits = np.uint64(self.model.bits)
        self.none = np.uint64(2**self.model.bits - 1)
        real = (self.context[self.asks3].astype(np.uint64) << bits) | self.w[self.asks3]
        used, wanted = (np.zeros(len(self.two), dtype=bool) for _ in range(2))
        used[self.context] = True
        wanted[self.context[(self.learn == 0) & ~self.lead]] = True
        wanted = np.flatnonzero((self.two > 0) & (wanted | (used & ~self.alone & (self.two > HOT))))
        keys, _, which = distinct(np.concatenate((real, (wanted.astype(np.uint64) << bits) | self.none)))
        self.in3 = which[: len(real)]
        self.ctx3, self.w3 = (keys >> bits).astype(np.int64), keys & self.none
        self.own3 = np.bincount(self.in3, weights=self.learn[self.asks3], minlength=len(keys))
        self.two3 = np.zeros(len(keys))
        self.two3[self.in3] = self.c2[self.asks3]
        self.two3[self.own3 == 0] = 0
        self.here = self.alone[self.ctx3]
        self.hot = ~self.here & (self.two[self.ctx3] > HOT)

    def parts(self, count: float) -> int:
        return math.ceil(count / HOT)

    def dealt(self):
        """Of each hot context and part: name of the part, and which keys are in it."""
        for c in np.unique(self.ctx3[self.hot]):
            at = np.flatnonzero((self.ctx3 == c) & self.hot)
            part = mixed(self.w3[at]) % np.uint64(self.parts(self.two[c]))
            for s in range(self.parts(self.two[c])):
                mine = at[(part == s) | (self.w3[at] == self.none)]
                yield int(c), f"h{s}", (int(self.where2[c]) << 32) | int(self.at2_[c]), mine

    def asks(self):
        """Rows about trigrams, and what the block adds to the counts of counts for the contexts that no other block has."""
        plain = np.flatnonzero(~self.here & ~self.hot)
        keys = (self.at2_[self.ctx3[plain]] << np.uint64(self.model.bits)) | self.w3[plain]
        yield from sent("c3", self.block, self.where2[self.ctx3[plain]], self.model.ranges, keys, self.own3[plain], self.two3[plain])
        for _, kind, name, at in self.dealt():
            yield kind, name, self.block, packed_keys(self.w3[at]), packed_values(self.own3[at]), packed_values(self.two3[at])
        yield "s3", self.block % self.model.ranges, self.block, packed_keys(np.zeros(0, np.uint64)), packed_values(few(self.own3[self.here])), None

    def trigrams(self, answers) -> np.ndarray:
        c3, n = self.own3.copy(), len(self.two)
        at = np.flatnonzero(self.here & (self.own3 > 0))
        followers, bigrams = tallied(self.ctx3[at], self.own3[at], n), tallied(self.ctx3[at], self.two3[at], n)
        # where no count is small enough to be discounted
        bare = followers[:TOP].sum(axis=0) == 0
        plain = np.flatnonzero(~self.here & ~self.hot)
        asked, massed = np.unique(self.ctx3[plain]), self.ctx3[plain[self.w3[plain] == self.none]]
        heights = (0, 0, 2 * (TOP + 1))
        c3[plain], bare[asked], tables, _ = answers("c3", heights)
        followers[:, massed], bigrams[:, massed] = tables[: TOP + 1], tables[TOP + 1 :]
        for c, kind, name, at in self.dealt():
            c3[at], flag, tables, _ = answers(kind, heights, name)
            bare[c] &= flag[0] > 0
            followers[:, c] += tables[: TOP + 1, 0]
            bigrams[:, c] += tables[TOP + 1 :, 0]
        # the second word of each context
        word = self.word[np.minimum(self.at2, len(self.word) - 1)]
        word[self.start] = self.begin
        divisor = np.maximum(self.two + bare, 1)
        left = 1 - self.model.kept(3, followers) / divisor
        alpha = np.where(self.two > 0, left / np.maximum(1 - self.model.kept(2, bigrams) / self.divisor1[word], 1e-300), 1.0)
        known = np.zeros(len(self.word))
        known[self.asks3] = c3[self.in3]
        return np.where(known > 0, self.model.discounted(3, known) / divisor[self.context], alpha[self.context] * self.p2)


def top_range(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Range of each key of so many bits: its stretch of all."""
    return (((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def sent(kind: str, block: int, where: np.ndarray, ranges: int, keys: np.ndarray, first: np.ndarray, second: np.ndarray | None = None):
    """Rows for the ranges; both ``where`` and the keys of each range ascend."""
    cuts = np.searchsorted(where, np.arange(ranges + 1))
    for r in np.flatnonzero(cuts[1:] > cuts[:-1]):
        a, b = cuts[r], cuts[r + 1]
        yield kind, int(r), block, packed_keys(keys[a:b]), packed_values(first[..., a:b].ravel()), None if second is None else packed_values(second[..., a:b].ravel())


def added(kind: str, keys: list[np.ndarray], first: list[np.ndarray], second: list[np.ndarray] | None, bits: int):
    """What a range answers each block, and its statistics."""
    every, owner, which = distinct(np.concatenate(keys))
    ends = np.cumsum([len(k) for k in keys])
    parts = [which[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    if kind == "m1":
        sums = []
        for x in (first, second):
            rows = np.concatenate([y.reshape(TOP + 1, -1) for y in x], axis=1)
            sums.append(np.stack([np.bincount(which, weights=y, minlength=len(every)) for y in rows]))
        return [(*(packed_values(x[:, p].ravel()) for x in sums), None) for p in parts], None
    total = np.bincount(which, weights=np.concatenate(first), minlength=len(every))
    if kind == "c1":
        return [(packed_values(total[p]), None, packed_keys(p.astype(np.uint64))) for p in parts], [*few(total), float(len(every))]
    if kind == "c2":
        own = np.zeros(len(which), dtype=np.uint8)
        own[owner] = 1
        alone = np.bincount(which, minlength=len(every)) == 1
        asked = (total > 0) & ~alone
        out = []
        for a, p in zip([0, *ends[:-1]], parts):
            out.append((packed_values(total[p]), packed_values(own[a : a + len(p)] + 2 * alone[p]), packed_keys(p[asked[p]].astype(np.uint64))))
        return out, [*few(total), float(len(every))]
    count2 = np.concatenate(second)
    two = np.zeros(len(every))
    two[which[count2 > 0]] = count2[count2 > 0]  # the same from every block
    contexts, _, of = distinct(every >> np.uint64(bits))
    followers, bigrams = tallied(of, total, len(contexts)), tallied(of, two, len(contexts))
    tables, bare = np.concatenate([followers, bigrams]), followers[:TOP].sum(axis=0) == 0
    none = np.uint64(2**bits - 1)
    massed = (every & none) == none
    out = []
    for p in parts:
        out.append((packed_values(total[p]), packed_values(bare[np.unique(of[p])]), packed_values(tables[:, of[p[massed[p]]]].ravel())))
    return out, [*few(total), 0.0]


def summed(rows: DataFrame, bits: int, before: DataFrame | None = None) -> DataFrame:
    """Add up each range over all blocks and answer each of them; and a row of statistics with block -1. With the answers before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, r = pdf["kind"].iloc[0], int(pdf["range"].iloc[0])
        first = [unpacked_values(x) for x in pdf["first"]]
        if kind == "s3":
            out, stats = [], [*np.sum(first, axis=0), 0.0]
        else:
            second = None if pdf["second"].iloc[0] is None else [unpacked_values(x) for x in pdf["second"]]
            out, stats = added(kind, [unpacked_keys(k) for k in pdf["keys"]], first, second, bits)
            out = [(kind, r, b, *x, None) for b, x in zip(pdf["block"], out)]
        if stats is not None:
            out.append(("c3" if kind[0] in "hs" else kind, r, -1, None, None, None, [float(x) for x in stats]))
        return pd.DataFrame(out, columns=ANSWER_COLUMNS)

    answers = ready(rows).groupBy("kind", "range").applyInPandas(run, ANSWERS)
    # laid out like the blocks, so that no later pass shuffles either
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(answers.repartition(parts, "block"), "katz_answers", by="block", into=before)


def statistics(answers: DataFrame) -> dict[str, list[float]]:
    """Tokens, types, counts of counts and size of the largest range, by kind; added up before the driver gets them."""
    found = (
        answers.where("block = -1").select("kind", F.posexplode("stats").alias("i", "x")).groupBy("kind", "i")
        .agg(F.when(F.col("i") == TOP + 3, F.max("x")).otherwise(F.sum("x")).alias("x")).collect()
    )
    out: dict[str, list[float]] = {}
    for r in found:
        out.setdefault(r["kind"], [0.0] * (TOP + 4))[r["i"]] = r["x"]
    return out


def lookup(answers: pd.DataFrame):
    """The answers to a block about one kind, in the order of its sorted keys: three rows of numbers, or tables of so many ``heights``. Where the third
    has none, it is places within a range, and the ranges of these follow."""
    kinds = dict(iter(answers.groupby("kind")))

    def of(kind: str, heights: tuple[int, int, int] = (0, 0, 0), name: int | None = None):
        rows = kinds.get(kind, answers.iloc[:0]).sort_values("range")
        rows = rows if name is None else rows[rows["range"] == name]

        def put(column: str, height: int) -> np.ndarray:
            parts = [unpacked_values(x).reshape((height, -1) if height else -1) for x in rows[column] if x is not None]
            return np.concatenate(parts, axis=-1) if parts else np.zeros((height, 0) if height else 0)

        first, second = put("first", heights[0]), put("second", heights[1])
        if heights[2]:
            return first, second, put("third", heights[2]), None
        third = [(r, unpacked_keys(x)) for r, x in zip(rows["range"], rows["third"]) if x is not None]
        where = np.repeat(np.array([r for r, _ in third], dtype=np.int64), [len(x) for _, x in third])
        return first, second, np.concatenate([np.zeros(0, np.uint64), *(x for _, x in third)]), where

    return of


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (Katz), log10 of the text.

    The model learns from the documents for which ``learn`` holds. Null text is empty: its end is its only token. Words never
    learned are one class, which gets what the unigrams were discounted by; with it, the probabilities after any context add up to 1.
    Null ids are kept, and learned from only if ``learn`` holds. Repeated rows count as often as they are there. Other columns are not
    looked at. A text of any length is cut into parts that no task holds together. An empty
    table gives an empty result; with nothing to learn from, every token is the unknown class, of probability 1.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = materialise(cut(source), "katz_blocks", by="block")
    all_tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    documents = source.where("learn").count()
    ranges = max(8, math.ceil(all_tokens / RANGE_TOKENS))

    def words(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                s, keys = State(row), unpacked_keys(row["hashes"])
                yield pd.DataFrame(sent("c1", s.block, top_range(keys, 64, ranges), ranges, keys, s.words()), columns=ROW_COLUMNS)

    def beside(answers: DataFrame, run, schema: str) -> DataFrame:
        def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return run(State(left.iloc[0]), lookup(right))

        return ready(blocks).groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(each, schema)

    answers = summed(map_batches(blocks, words, ROWS), 0)
    hashed, blocks = blocks, materialise(blocks.drop("hashes"), "katz_blocks", by="block")
    discard(hashed)
    stats = statistics(answers)
    model1 = Model(stats, documents, ranges)

    def pairs(s: State, of) -> pd.DataFrame:
        s.number(model1, of)
        where = top_range(s.keys2, 2 * model1.bits, ranges)
        return pd.DataFrame(sent("c2", s.block, where, ranges, s.keys2, s.own2), columns=ROW_COLUMNS)

    answers = summed(beside(answers, pairs, ROWS), model1.bits, answers)
    stats |= {k: v for k, v in statistics(answers).items() if k == "c2"}
    model2 = Model(stats, documents, ranges)

    def masses(s: State, of) -> pd.DataFrame:
        s.number(model2, of)
        s.pairs(of)
        return pd.DataFrame(sent("m1", s.block, s.where1, ranges, s.at1, *s.mass1()), columns=ROW_COLUMNS)

    answers = summed(beside(answers, masses, ROWS), model2.bits, answers)

    def trigrams(s: State, of) -> pd.DataFrame:
        s.number(model2, of)
        s.pairs(of)
        s.bigrams(of)
        return pd.DataFrame(list(s.asks()), columns=ROW_COLUMNS)

    answers = summed(beside(answers, trigrams, ROWS), model2.bits, answers)
    stats |= {k: v for k, v in statistics(answers).items() if k == "c3"}
    model3 = Model(stats, documents, ranges)

    def last(s: State, of) -> pd.DataFrame:
        s.number(model3, of)
        s.pairs(of)
        s.bigrams(of)
        scored = ~s.lead
        each = np.where(scored, np.log10(s.trigrams(of)), 0)
        base = np.where(scored, np.log10((s.c1 + 1) / (model3.total + model3.words + 1)), 0)
        add = lambda x: np.add.reduceat(x, s.starts)
        return pd.DataFrame({
            "uid": s.uids, "id": pd.array([None if i is None or i != i else int(i) for i in s.ids], dtype="Int64"), "n_tokens": s.sizes - s.leads,
            "n_known": add((scored & (s.c1 > 0)).astype(np.int64)), "base_score": add(base), "score": add(each),
        })

    found = beside(answers, last, "uid long, id long, n_tokens long, n_known long, base_score double, score double")
    return found.groupBy("uid").agg(
        F.first("id").alias(id_col), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known")), F.lit(int(model3.total)).cast("long").alias("train_tokens"),
        *(F.sum(c).alias(c) for c in ("base_score", "score")),
    ).drop("uid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remainder(F.col("doc_id"), 7)
    found = scores(table(spark, sf_dir, "documents"), rest != 2)
    return found.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
