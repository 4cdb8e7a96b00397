"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import heapq
import importlib.util
import os
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import extended, map_batches, table

SPACE = "▁"
#: A batch's texts are encoded together up to so many characters; so many distinct units are remembered in a task.
BATCH_CHARS = 1_500_000
REMEMBERED = 400_000
#: Stretches of more characters are merged with a queue of their own.
LONG = 256


def default_model() -> str:
    """Path of the 32k piece model; the environment variable TIDEWATER_PIECES names another."""
    found = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.environ.get("TIDEWATER_PIECES", os.path.join(folder, "piece_bpe_32k.model"))


@dataclass
class Pieces:
    """A vocabulary. ``kind``: bpe merges by score, unigram takes the best path. ``byte_ids``: of the 256 byte pieces, or empty."""

    texts: list[str]
    scores: list[float]
    normal: list[bool]
    unknown: int
    byte_ids: list[int]
    kind: str
    prefix: bool

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are can be used")
        piece = model.SentencePiece if hasattr(model, "SentencePiece") else pb.ModelProto.SentencePiece
        if any(p.type == piece.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        bytes_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == piece.BYTE}
        return cls(
            [p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type == piece.NORMAL for p in model.pieces],
            next(i for i, p in enumerate(model.pieces) if p.type == piece.UNKNOWN),
            [bytes_of[f"<0x{b:02X}>"] for b in range(256)] if len(bytes_of) == 256 else [],
            {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type], model.normalizer_spec.add_dummy_prefix,
        )

    @cached_property
    def long_ids(self) -> list[int]:
        """Pieces of two characters and more, in code point order."""
        return sorted((i for i, t in enumerate(self.texts) if self.normal[i] and len(t) > 1), key=lambda i: self.texts[i])

    @cached_property
    def single(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.texts) if self.normal[i] and len(t) == 1}

    @cached_property
    def longest(self) -> int:
        return max((len(self.texts[i]) for i in self.long_ids), default=1)

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the long pieces, a row each, and their lengths."""
        lengths = np.array([len(self.texts[i]) for i in self.long_ids], dtype=np.int64)
        rows = np.zeros((len(lengths), self.longest), dtype=np.int64)
        for r, i in enumerate(self.long_ids):
            rows[r, : lengths[r]] = [ord(c) + 1 for c in self.texts[i]]
        return rows, lengths

    @cached_property
    def priority(self) -> np.ndarray:
        """Place of each long piece by score, the highest first; equal scores share one."""
        score = np.array([self.scores[i] for i in self.long_ids])
        return np.unique(-score, return_inverse=True)[1].astype(np.int32)

    @cached_property
    def place(self) -> dict[str, tuple[int, int]]:
        """Priority and row of each long piece."""
        return {self.texts[i]: (int(p), r) for r, (i, p) in enumerate(zip(self.long_ids, self.priority))}

    @cached_property
    def units(self) -> re.Pattern:
        """Stretches that no piece reaches across: spaces begin one, and a character that is in no long piece is one."""
        inner = set("".join(self.texts[i] for i in self.long_ids))
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in self.long_ids):
            return re.compile(r".+", re.DOTALL)
        inner.discard(SPACE)
        known = "[" + "".join(map(re.escape, sorted(inner))) + "]" if inner else r"(?!)"
        return re.compile(f"{SPACE}+{known}*|{known}+|.", re.DOTALL)

    @cached_property
    def plain(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = [t.replace(SPACE, " ").encode() if n else b"" for t, n in zip(self.texts, self.normal)]
        out[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def packing(text: np.ndarray, depth: int) -> tuple[np.ndarray, int, int]:
    """Number of each character that is in the text (0 for others), bits of a number, and how many numbers one word takes."""
    number = np.zeros(int(text.max()) + 1 if len(text) else 1, dtype=np.int64)
    number[text] = 1
    number = np.cumsum(number) * number
    bits = int(number.max()).bit_length()
    return number, bits, min(depth, max(1, 62 // max(1, bits)))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` characters at least: by as many as fit in a word, then by prefix doubling. And the
    sorted words."""
    n = len(text)
    number, bits, width = packing(text, depth)
    rank = number[text]
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= rank[k:]
    words = None
    while True:
        order = np.argsort(key)
        words = key[order] if words is None else words
        if width >= depth:
            return order, words
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([1], 1 + np.cumsum(ranked[1:] != ranked[:-1])))[:n]
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:]
        width *= 2


def occurrences(text: np.ndarray, order: np.ndarray, words: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each long piece, the stretch of the suffix array that starts with it, by binary search of all pieces at once: in the sorted words, and
    from there on by characters for pieces longer than a word."""
    rows, lengths = pieces.matrix
    number, bits, width = packing(text, pieces.longest)
    known = np.where(rows < len(number), number[np.minimum(rows, len(number) - 1)], 0)
    inside = np.arange(pieces.longest)[None, :] < lengths[:, None]
    found = (known > 0).sum(axis=1, where=inside) == lengths
    low, high = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for k in range(width):
        here = inside[:, k]
        low = (low << bits) | np.where(here, known[:, k], 0)
        high = (high << bits) | np.where(here, known[:, k], (1 << bits) - 1)
    lo, hi = np.searchsorted(words, low, side="left"), np.searchsorted(words, high, side="right")
    hi = np.where(found, hi, lo)
    deep = np.flatnonzero((lengths > width) & (lo < hi))
    if len(deep):
        padded = np.concatenate([text, np.zeros(pieces.longest, dtype=text.dtype)])
        reach = np.arange(pieces.longest)

        def bound(after: bool) -> np.ndarray:
            a, b = lo[deep].copy(), hi[deep].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    return a
                mid = (a[open_] + b[open_]) // 2
                which = deep[open_]
                diff = np.where(inside[which], padded[order[mid][:, None] + reach] - rows[which], 0)
                sign = diff[np.arange(len(open_)), (diff != 0).argmax(axis=1)]
                right = sign <= 0 if after else sign < 0
                a[open_[right]], b[open_[~right]] = mid[right] + 1, mid[~right]

        lo[deep], hi[deep] = bound(False), bound(True)
    return lo, hi


def edges(text: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row of the piece) of every occurrence of a long piece, by start."""
    order, words = suffix_array(text, pieces.longest)
    lo, hi = occurrences(text, order, words, pieces)
    count = hi - lo
    row = np.repeat(np.arange(len(count), dtype=np.int32), count)
    at = np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)
    start = order[at].astype(np.int32)
    by = np.argsort(start)
    start, row = start[by], row[by]
    return start, pieces.matrix[1].astype(np.int32)[row], row


def stretches(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Number of the stretch that each character is in; stretches end where no edge reaches across, so that nothing depends on what is beyond."""
    across = np.bincount(start + 1, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(np.cumsum(across)[:n] == 0, dtype=np.int32)


def merge_long(text: str, pieces: Pieces) -> tuple[list[int], list[int]]:
    """The same merges of one long stretch, from a queue over linked symbols: starts of its symbols and their rows, -1 for a character."""
    n, place = len(text), pieces.place
    after, before, made = [*range(1, n), -1], [*range(-1, n - 1)], [-1] * n
    end = [*range(1, n + 1)]
    queue = [(*place[text[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if text[i : i + 2] in place]
    queue = [(p, i, mid, stop, row) for p, row, i, mid, stop in queue]
    heapq.heapify(queue)

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (found := place.get(text[i : end[j]])):
            heapq.heappush(queue, (found[0], i, j, end[j], found[1]))

    while queue:
        _, i, j, stop, row = heapq.heappop(queue)
        # both symbols must still be there as they were
        if end[i] != j or end[j] != stop:
            continue
        made[i], end[i], end[j] = row, stop, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        offer(before[i], i)
        offer(i, k)
    starts, i = [], 0
    while i >= 0:
        starts.append(i)
        i = after[i]
    return starts, [made[i] for i in starts]


def merge(text: np.ndarray, start: np.ndarray, length: np.ndarray, row: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """BPE: in every stretch, the best-scored edge that joins exactly two symbols, the leftmost of equals, until none is left."""
    unit = stretches(len(text), start, length)
    sizes = np.bincount(unit)
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        short = sizes[unit[start]] <= LONG
        start, length, row = start[short], length[short], row[short]
    starts, made = merge_short(text, unit, start, length, row, pieces)
    begins = np.cumsum(sizes) - sizes
    for u in long:
        a, b = int(begins[u]), int(begins[u] + sizes[u])
        at, rows = merge_long((text[a:b] - 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), pieces)
        starts[a:b] = False
        starts[np.array(at) + a] = True
        made[np.array(at) + a] = rows
    return starts, made


def merge_short(text: np.ndarray, unit: np.ndarray, start: np.ndarray, length: np.ndarray, row: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All stretches together, round by round."""
    priority = pieces.priority[row]
    most = int(priority.max(initial=0)) + 1
    if most * (int(unit[-1]) + 1) * len(text) < 2**63 - 1:
        by = np.argsort((unit[start].astype(np.int64) * most + priority) * len(text) + start)
    else:
        by = np.lexsort((start, priority, unit[start]))
    start, end, row, owner = start[by], start[by] + length[by], row[by], unit[start[by]]
    del by, priority
    starts = np.ones(len(text) + 1, dtype=bool)
    made = np.full(len(text), -1, dtype=np.int64)
    while len(start):
        symbols = np.concatenate(([0], np.cumsum(starts, dtype=np.int32)), dtype=np.int32)
        inside = symbols[end] - symbols[start]
        alive = starts[start] & starts[end] & (inside > 1)
        start, end, row, owner, inside = start[alive], end[alive], row[alive], owner[alive], inside[alive]
        two = np.flatnonzero(inside == 2)
        if not len(two):
            break
        best = two[np.concatenate(([True], owner[two][1:] != owner[two][:-1]))]
        made[start[best]] = row[best]
        # the second symbol's start is the only one inside
        cleared = np.zeros(len(text) + 2, dtype=np.int64)
        np.add.at(cleared, start[best] + 1, 1)
        np.add.at(cleared, end[best], -1)
        starts &= np.cumsum(cleared)[: len(text) + 1] == 0
    return starts, made


def best_path(text: np.ndarray, first: np.ndarray, start: np.ndarray, length: np.ndarray, row: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Unigram: relax the edges of all units together, by start within the unit, then length; the earlier of equals stays."""
    score = np.array([pieces.scores[i] for i in pieces.long_ids], dtype=np.float32)
    lowest = np.float32(min((s for s, n in zip(pieces.scores, pieces.normal) if n), default=0.0) - 10.0)
    alone = np.array([pieces.scores[pieces.single[c]] if (c := chr(x - 1)) in pieces.single else lowest for x in np.maximum(text, 1)], dtype=np.float32)
    place = np.arange(len(text)) - first
    start, length, row = (np.concatenate(x) for x in ((start, np.arange(len(text))), (length, np.ones(len(text), dtype=np.int64)), (row, np.full(len(text), -1))))
    value = np.where(row >= 0, score[np.maximum(row, 0)] if len(score) else np.float32(0), alone[start]).astype(np.float32)
    by = np.lexsort((length, place[start]))
    step = place[start][by] * (pieces.longest + 1) + length[by]
    best = np.full(len(text) + 1, -np.inf, dtype=np.float32)
    best[np.flatnonzero(place == 0)] = 0
    back, how = np.full(len(text) + 1, -1), np.full(len(text) + 1, -1)
    ends = np.zeros(len(text) + 1, dtype=bool)
    ends[np.flatnonzero(text == 0)] = True
    cuts = np.concatenate(([0], np.flatnonzero(step[1:] != step[:-1]) + 1, [len(step)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        e = by[a:b]
        e = e[text[start[e]] != 0]
        to = start[e] + length[e]
        total = (best[start[e]] + value[e]).astype(np.float32)
        better = (total > best[to]) | (back[to] < 0)
        best[to[better]], back[to[better]], how[to[better]] = total[better], start[e][better], row[e][better]
    starts, made = np.zeros(len(text) + 1, dtype=bool), np.full(len(text), -1, dtype=np.int64)
    starts[np.flatnonzero(ends)] = True
    at = np.flatnonzero(ends)
    while len(at):
        at = at[place[np.minimum(at, len(text) - 1)] > 0]
        prior = back[at]
        starts[prior], made[prior] = True, how[at]
        at = prior
    return starts, made


def chunks(units: list[str], most: int):
    """The units in order, in lists of about so many characters."""
    out, held = [], 0
    for u in units:
        out.append(u)
        held += len(u)
        if held >= most:
            yield out
            out, held = [], 0
    if out:
        yield out


class Encoder:
    """Encodes batches of texts; units met before in the task are not matched again."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def learn(self, units: list[str]) -> None:
        for part in chunks(units, BATCH_CHARS):
            self.learn_together(part)

    def learn_together(self, units: list[str]) -> None:
        p = self.pieces
        joined = "\0".join(units) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        stops = np.cumsum(sizes + 1) - 1
        text[stops] = 0  # no piece holds it, so none crosses a unit
        unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes + 1)
        start, length, row = edges(text, p)
        if p.kind == "bpe":
            starts, made = merge(text, start, length, row, p)
        else:
            starts, made = best_path(text, np.repeat(stops - sizes, sizes + 1), start, length, row, p)
        at = np.flatnonzero(starts[:-1] & (text != 0))
        ids = np.where(made[at] >= 0, np.array([*p.long_ids, 0])[made[at]], -1)
        ends = np.concatenate((np.flatnonzero(starts), [len(text)]))
        single = np.flatnonzero(ids < 0)
        chars, where = np.unique(text[at[single]], return_inverse=True)
        spelled = [[p.single[c]] if (c := chr(x - 1)) in p.single else [p.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if p.byte_ids else [p.unknown] for x in chars]
        count = np.ones(len(at), dtype=np.int64)
        count[single] = np.array([len(s) for s in spelled], dtype=np.int64)[where] if len(spelled) else 0
        place = np.cumsum(count) - count
        flat = np.zeros(count.sum(), dtype=np.int32)
        flat[place[ids >= 0]] = ids[ids >= 0]
        for k in range(max((len(s) for s in spelled), default=0)):
            nth = np.array([s[k] if k < len(s) else -1 for s in spelled])[where]
            has = nth >= 0
            flat[place[single[has]] + k] = nth[has]
        per = np.bincount(unit[at], weights=count, minlength=len(units)).astype(np.int64)
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(per)))
        self.flat = np.concatenate((self.flat, flat))
        for u in units:
            self.known[u] = len(self.known)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.known) > REMEMBERED:
            self.forget()
        lead = SPACE if self.pieces.prefix else ""
        cut = self.pieces.units.findall
        split = [cut(lead + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        fresh = list(set(chain.from_iterable(split)) - known.keys())
        if fresh:
            self.learn(fresh)
        numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        begin, size = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        total = np.cumsum(size)
        ids = self.flat[np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(begin, size)]
        ends = np.concatenate(([0], total))[np.cumsum([len(s) for s in split])] if split else []
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, [0, *ends[:-1]], ends)]


def decode(ids, pieces: Pieces) -> str | None:
    """The text of ids: byte pieces are read as UTF-8, and the space put before a text is taken off."""
    if ids is None:
        return None
    plain = pieces.plain
    text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if pieces.prefix and text[:1] == " " else text


def encoded(docs: DataFrame, model: str | None = None, text_col: str = "text", check: bool = True) -> DataFrame:
    """Adds piece_ids, n_pieces and, if asked, round_trip: whether the decoded ids are the text again.

    Whole texts. Null text: null ids, count 0, round_trip true; empty text: no ids. A text that holds U+2581 itself decodes to a space
    there, as with any such model. Repeated rows are encoded alike; an empty table gives an empty result; columns of these
    names are replaced. The vocabulary, of fixed size, is read by the driver and goes to the tasks with the code.
    """
    pieces = Pieces.load(model or default_model())
    docs = docs.drop("piece_ids", "n_pieces", "round_trip")
    schema = extended(docs, "piece_ids array<int>, n_pieces int" + ", round_trip boolean" * check)

    def run(batches):
        encoder = Encoder(pieces)

        def together(frames):
            pdf = pd.concat(frames, ignore_index=True)
            texts = [t if isinstance(t, str) else None for t in pdf[text_col]]
            ids = encoder.encode(texts)
            pdf = pdf.assign(piece_ids=ids, n_pieces=np.array([0 if x is None else len(x) for x in ids], dtype=np.int32))
            return pdf.assign(round_trip=[decode(x, pieces) == t for x, t in zip(ids, texts)]) if check else pdf

        held, chars = [], 0
        for pdf in batches:
            sizes = pdf[text_col].str.len().fillna(0)
            for _, part in pdf.groupby(sizes.cumsum() // BATCH_CHARS):
                held.append(part)
                chars += sizes[part.index].sum()
                if chars >= BATCH_CHARS:
                    yield together(held)
                    held, chars = [], 0
        if held:
            yield together(held)

    return map_batches(docs, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
