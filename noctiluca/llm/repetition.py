"""Repetition inside a single document, by rolling hashes of word sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.llm.markup import without_elements
from noctiluca.llm.words import WordIds, mixed, rolling, words
from noctiluca.session import bounded_batches, spread

LENGTHS = (3, 5, 10)


def later_occurrences(ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it lies in an n-word sequence that occurred earlier in the same document.

    ``ids`` are the words of several documents one after another, ``owner`` the document of each word.
    """
    covered = np.zeros(len(ids) + 1, np.int32)
    h = rolling(ids, n)
    if len(h):
        start = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
        key = mixed(h[start] + mixed(owner[start].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = start[order[1:][key[order][1:] == key[order][:-1]]]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + n, -1)
    return np.cumsum(covered[:-1]) > 0


def _repeated_units(text: str, pattern: str) -> float:
    """Share of a text's visible characters that stand in units (lines, paragraphs, sentences) seen before in it."""
    seen: set[str] = set()
    total = again = 0
    for unit in re.split(pattern, text):
        key = " ".join(words(unit))
        if key:
            total += len(key)
            again += len(key) * (key in seen)
            seen.add(key)
    return again / total if total else 0.0


def repetition(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Per row: number of words, words and share of characters inside repeated n-word sequences, and the shares in
    repeated lines, paragraphs and sentences. Only later occurrences count as repeated.

    Whole texts are measured, each on its own, so nothing is shuffled. Null, blank and shorter texts have zeros; repeated
    rows stay repeated; other columns are not read and may have any name; an empty table gives no rows.
    """
    flat = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id bigint, words bigint, " + ", ".join(f"repeated_words_{n} bigint, repeated_chars_{n} double" for n in lengths) + ", repeated_lines double, repeated_paragraphs double, repeated_sentences double"

    bounded_batches(documents.sparkSession)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordIds()
        for batch in batches:
            texts = [without_elements(t) if t else "" for t in batch["text"]]
            split = [words(t) for t in texts]
            sizes = np.array([len(w) for w in split], np.int64)
            flat_words = [w for ws in split for w in ws]
            ids, owner = known.of(flat_words), np.repeat(np.arange(len(split)), sizes)
            chars = np.fromiter(map(len, flat_words), np.int64, len(flat_words))
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "words": sizes})
            all_chars = np.bincount(owner, chars, len(split))
            for n in lengths:
                covered = later_occurrences(ids, owner, n)
                out[f"repeated_words_{n}"] = np.bincount(owner, covered, len(split)).astype(np.int64)
                out[f"repeated_chars_{n}"] = np.bincount(owner, covered * chars, len(split)) / np.maximum(all_chars, 1)
            for name, pattern in (("lines", r"\n+"), ("paragraphs", r"\n\s*\n"), ("sentences", r"(?<=[.!?])\s+|\n+")):
                out[f"repeated_{name}"] = [_repeated_units(t, pattern) for t in texts]
            yield out

    return spread(flat).mapInPandas(measure, schema)


def repetitive(measured: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id): documents of whose words at least ``share`` lie in a five-word sequence that occurred earlier."""
    return measured.where((F.col("words") > 0) & (F.col("repeated_words_5") >= share * F.col("words"))).select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
