"""Evaluation passages inside training texts, by pigeonhole matching of word pieces.

A passage of ``passage`` consecutive words of a test item counts as leaked if it stands in a document with at most
``edits`` words inserted, left out or replaced. Items are split into aligned pieces so short that every such passage
holds edits + 1 whole pieces: one of them must stand in the document unchanged. An item shorter than a passage is one
passage itself, which must stand in the document whole and unchanged. Piece hits come from rolling hashes;
hits whose surroundings cannot hold the passage are dropped by counting equal words near their diagonal, and the rest
are verified with Myers' bit-parallel edit distance over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.llm.markup import without_elements
from noctiluca.llm.words import WordIds, rolling, words
from noctiluca.session import bounded_batches, cut, spread


def myers_within(pattern: list[int], text: list[int], most: int) -> int | None:
    """The least edit distance of ``pattern`` to any stretch of ``text``, if at most ``most`` (Myers 1999, any symbols)."""
    m = len(pattern)
    if not m:
        return 0
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & high) - bool(mh & high)
        best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best if best <= most else None


@dataclass(frozen=True)
class Pieces:
    """The pieces of a bounded set of items: words of all items one after another, and a sorted array of piece hashes."""

    item_ids: np.ndarray
    starts: np.ndarray  # of each item in ids, one more at the end
    ids: np.ndarray
    hashes: np.ndarray
    at: np.ndarray  # position in ids of each piece
    item: np.ndarray  # item of each piece
    size: int
    passage: int
    edits: int
    #: Most piece hits that are looked at together; a piece that very many items share is taken in parts.
    hits: int = 1_000_000


def split_items(item_ids: list[int], texts: list[str], passage: int, edits: int) -> Pieces:
    """Pieces of floor((passage + 1) / (edits + 2)) words: any passage then holds edits + 1 whole aligned ones. A shorter item
    has its first piece only; one shorter than a piece has none."""
    size = (passage + 1) // (edits + 2)
    known = WordIds()
    arrays = [known.of(words(without_elements(t))) for t in texts]
    starts = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int64)
    ids = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    at = np.concatenate([np.arange(s, e - size + 1, size) for s, e in zip(starts[:-1], np.where(np.diff(starts) < passage, np.minimum(starts[1:], starts[:-1] + size), starts[1:]), strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
    h = rolling(ids, size)
    h = h[at] if len(at) else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    return Pieces(np.array(item_ids, np.int64), starts, ids, h[order], at[order], np.searchsorted(starts, at[order], "right") - 1, size, passage, edits)


def find_passages(doc_ids: np.ndarray, starts: np.ndarray, p: Pieces) -> list[tuple[int, int, int, int]]:
    """(document, item, longest unchanged run in words, least edits of a passage) over documents given as word ids."""
    h = rolling(doc_ids, p.size)
    if not len(h) or not len(p.hashes):
        return []
    lo, hi = np.searchsorted(p.hashes, h, "left"), np.searchsorted(p.hashes, h, "right")
    where = np.flatnonzero(hi > lo)
    found: dict[tuple[int, int], list[int]] = {}
    many = np.cumsum((hi - lo)[where])
    for part in np.split(where, np.unique(np.searchsorted(many, np.arange(p.hits, many[-1], p.hits)) + 1)) if len(where) else []:
        _look_at(doc_ids, starts, p, part, lo, hi, found)
    return [(d, i, r, e) for (d, i), (r, e) in found.items() if e <= p.edits]


def _look_at(doc_ids: np.ndarray, starts: np.ndarray, p: Pieces, where: np.ndarray, lo: np.ndarray, hi: np.ndarray, found: dict[tuple[int, int], list[int]]) -> None:
    """Add to ``found`` what the piece hits at some places of the documents lead to."""
    n = (hi - lo)[where]
    pos = np.repeat(where, n)
    piece = np.repeat(lo[where], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc = np.searchsorted(starts, pos, "right") - 1
    inside = pos + p.size <= starts[doc + 1]
    pos, piece, doc = pos[inside], piece[inside], doc[inside]
    length = np.diff(p.starts)
    short = length[p.item[piece]] < p.passage
    for d, q, i in zip(doc[short].tolist(), pos[short].tolist(), p.item[piece[short]].tolist(), strict=True):
        a, m = int(p.starts[i]), int(length[i])
        if q + m <= starts[d + 1] and (doc_ids[q : q + m] == p.ids[a : a + m]).all():
            found[d, i] = [m, 0]
    pos, piece, doc = pos[~short], piece[~short], doc[~short]
    span = p.passage - p.size  # words of a passage before or after the piece
    off = np.arange(-span, p.size + span)
    for at in range(0, len(pos), 100_000):
        d, q, k = doc[at : at + 100_000], pos[at : at + 100_000], piece[at : at + 100_000]
        item, b = p.item[k], p.at[k]
        ip = b[:, None] + off
        item_ok = (ip >= p.starts[item][:, None]) & (ip < p.starts[item + 1][:, None])
        iw = p.ids[np.clip(ip, 0, len(p.ids) - 1)]
        same = np.zeros(ip.shape, bool)
        for shift in range(-p.edits, p.edits + 1):
            dp = q[:, None] + off + shift
            ok = item_ok & (dp >= starts[d][:, None]) & (dp < starts[d + 1][:, None])
            hit = ok & (doc_ids[np.clip(dp, 0, len(doc_ids) - 1)] == iw)
            same |= hit
        # most equal words in any passage-long stretch around the piece: what is below passage - edits can't be one
        run = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
        most = (run[:, p.passage :] - run[:, : -p.passage]).max(axis=1)
        for i in np.flatnonzero(most >= p.passage - p.edits):
            key = (int(d[i]), int(item[i]))
            best = found.setdefault(key, [0, p.edits + 1])
            s, e, is_, ie = int(starts[d[i]]), int(starts[d[i] + 1]), int(p.starts[item[i]]), int(p.starts[item[i] + 1])
            x, y, left = int(q[i]), int(b[i]), 0
            while x - left > s and y - left > is_ and doc_ids[x - left - 1] == p.ids[y - left - 1]:
                left += 1
            right = p.size
            while x + right < e and y + right < ie and doc_ids[x + right] == p.ids[y + right]:
                right += 1
            best[0] = max(best[0], left + right)
            if best[0] >= p.passage:
                best[1] = 0
            elif best[1] > 1:
                region = doc_ids[max(s, x - span - p.edits) : min(e, x + p.size + span + p.edits)].tolist()
                for first in range(max(is_, y - span), min(y, ie - p.passage) + 1):
                    if (distance := myers_within(p.ids[first : first + p.passage].tolist(), region, p.edits)) is not None:
                        best[1] = min(best[1], distance)


def leaked(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", passage: int = 12, edits: int = 1, slice_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, longest_run, edits): every document with every item of which it holds a passage.

    longest_run is in words; an item of fewer words than a passage counts where it stands whole, one of fewer words than a
    piece (four) nowhere. The items are taken in slices of about ``slice_chars`` characters, chosen by a hash of their ids.
    Only one slice at a time comes to the driver and is broadcast to one pass over the documents, whose result is written
    before the next slice is fetched; documents are never shuffled. Null or blank texts match nothing; a repeated row adds
    nothing; other columns are not read; an empty table on either side gives no rows.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    flat = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    flat = spread(flat)
    held = items.select(F.col(f"`{item_id_col}`").cast("bigint").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    chars = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    slices = max(1, -(-chars // slice_chars))

    def one_pass(k: int) -> DataFrame:
        rows = held.where(F.pmod(F.xxhash64("i"), F.lit(slices)) == k).collect()
        shared = spark.sparkContext.broadcast(split_items([r["i"] for r in rows], [r["t"] for r in rows], passage, edits))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = WordIds()
            for batch in batches:
                split = [words(without_elements(t)) for t in batch["text"]]
                starts = np.r_[0, np.cumsum([len(w) for w in split])].astype(np.int64)
                rows = find_passages(known.of([w for ws in split for w in ws]), starts, shared.value)
                if rows:
                    d, i, r, e = (list(x) for x in zip(*rows, strict=True))
                    yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[d], "item_id": shared.value.item_ids[i], "longest_run": r, "edits": e})

        found = flat.mapInPandas(search, "doc_id bigint, item_id bigint, longest_run int, edits int")
        if slices == 1:
            return found
        found = cut(found)
        shared.destroy()
        return found

    out = one_pass(0)
    for k in range(1, slices):
        out = out.unionByName(one_pass(k))
    return out.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.min("edits").alias("edits"))


def leaked_unchanged(found: DataFrame, passage: int = 12) -> DataFrame:
    """(doc_id, item_id): the leaks in which ``passage`` consecutive words stand unchanged."""
    return found.where(F.col("longest_run") >= passage).select("doc_id", "item_id")
