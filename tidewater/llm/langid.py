"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import extended, map_batches, remainder, table

DIMENSIONS = 1024
SYMBOLS = 64  # a to z have one each, 0 stands between words, the letters beyond share the rest
SEED = 20250101
DOCS_AT_ONCE = 128
NGRAMS_AT_ONCE = 8192
UNDETERMINED = "und"


@functools.cache
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random vector of -1 and 1 for each symbol, and its permutations (rolls) by 2, 1 and 0 places."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


@functools.cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 unless it is a letter."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            out[cp] = 1 + cp - 97 if 97 <= cp <= 122 else 27 + cp % (SYMBOLS - 27)
    return out


def ngrams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams of the whole text, lower-cased, with one mark between and around words."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = symbol_table()[points].astype(np.int32)
    if not s.any():
        return np.zeros(0, dtype=np.int32)
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def ngram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bind: the product of the permuted vectors of an n-gram's symbols."""
    first, second, third = letter_vectors()
    return (first[codes // SYMBOLS**2] * second[codes // SYMBOLS % SYMBOLS] * third[codes % SYMBOLS]).astype(np.float32)


def bundle(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum of n-gram vectors, each as often as counts (rows of documents) say."""
    out = np.zeros((counts.shape[0], DIMENSIONS), dtype=np.float64)
    for i in range(0, len(codes), NGRAMS_AT_ONCE):
        out += counts[:, i : i + NGRAMS_AT_ONCE] @ ngram_vectors(codes[i : i + NGRAMS_AT_ONCE])
    return out


def documents_vectors(texts: list[str | None]) -> np.ndarray:
    each = [ngrams(t) for t in texts]
    every, where = np.unique(np.concatenate(each), return_inverse=True) if each else (np.zeros(0, int), np.zeros(0, int))
    rows = np.repeat(np.arange(len(each)), [len(e) for e in each])
    counts = np.bincount(rows * len(every) + where, minlength=len(each) * len(every)).reshape(len(each), len(every))
    return bundle(counts.astype(np.float32), every.astype(np.int32))


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from rows (text, lang): n-gram counts of a language are summed in each task, bundled there, and the
    vectors added up. A task sends one vector for a language, whatever it read; the driver gets one for each language."""

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                counts = sums.setdefault(lang, np.zeros(SYMBOLS**3, dtype=np.int64))
                pending, size = [], 0
                for t in texts:
                    pending.append(ngrams(t))
                    size += len(pending[-1])
                    if size > 4_000_000:
                        counts += np.bincount(np.concatenate(pending), minlength=SYMBOLS**3)
                        pending, size = [], 0
                if pending:
                    counts += np.bincount(np.concatenate(pending), minlength=SYMBOLS**3)
        for lang, counts in sums.items():
            codes = np.flatnonzero(counts)
            if len(codes):
                vector = bundle(counts[None, codes].astype(np.float64), codes)[0]
                yield pd.DataFrame({"lang": [lang], "vector": [vector]})

    parts = map_batches(labelled.select("text", "lang"), partial, "lang string, vector array<double>")
    sums = (
        parts.select("lang", F.posexplode("vector").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("lang", F.transform("v", lambda e: e["x"]).alias("v"))
    )
    found = sorted((r["lang"], r["v"]) for r in sums.collect())
    vectors = np.array([v for _, v in found], dtype=np.float64).reshape(len(found), DIMENSIONS)
    return [lang for lang, _ in found], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (cosine of the text's vector with the nearest prototype, 0 to 1).

    ``und`` with score 0: null text, text without letters, or nothing learned. Ties: the language first by name.
    Empty table: empty result. Input columns of the two names are replaced.
    """
    langs, prototypes = model
    docs = docs.drop("lang_pred", "score")
    schema = extended(docs, "lang_pred string, score double")

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].tolist()
            picked, scores = [], []
            for i in range(0, len(texts), DOCS_AT_ONCE):
                vectors = documents_vectors(texts[i : i + DOCS_AT_ONCE])
                norms = np.linalg.norm(vectors, axis=1)
                if not langs:
                    norms[:] = 0
                    best, top = np.zeros(len(vectors), int), np.zeros(len(vectors))
                else:
                    cosines = vectors @ prototypes.T / np.maximum(norms, 1e-12)[:, None]
                    best, top = cosines.argmax(axis=1), cosines.max(axis=1)
                picked += [langs[b] if n > 0 else UNDETERMINED for b, n in zip(best, norms)]
                scores += [float(min(1.0, max(0.0, s))) if n > 0 else 0.0 for s, n in zip(top, norms)]
            yield pdf.assign(lang_pred=picked, score=scores)

    return map_batches(docs, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 4)
    model = train(docs.where((rest != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")
