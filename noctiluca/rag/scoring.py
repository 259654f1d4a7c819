"""Term-at-a-time scoring of blocks of items in numpy: every query's scores stand in one array over a block, and only the
best of a block leave it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Items that are scored together.
BLOCK = 1 << 16
#: A term that stands in more than this share of a block is kept as a whole array.
DENSE = 0.25
#: Items whose k-th best score is taken for a bound before the whole block is looked through.
FIRST = 1 << 13


@dataclass
class Asked:
    """Queries as term numbers. Terms are in order; queries of the same terms are one group."""

    terms: pa.Array
    query_ids: pa.Array
    group_of: np.ndarray  # by query
    groups: list[np.ndarray]  # term numbers, ascending

    @property
    def code(self) -> str:
        return "<u2" if len(self.terms) <= 1 << 16 else "<u4"


def asked_of(pairs: pa.Table) -> Asked:
    """From distinct rows (query_id, term)."""
    pairs = pairs.combine_chunks()
    ids, terms = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (pairs["query_id"], pairs["term"]))
    known = terms.unique()
    known = known.take(pc.sort_indices(known))
    numbers = pc.index_in(terms, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
    queries = ids.unique()
    query = pc.index_in(ids, value_set=queries).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((numbers, query))
    ends = np.cumsum(np.bincount(query, minlength=len(queries)))
    groups: dict[bytes, int] = {}
    lists, group_of = [], np.zeros(len(queries), np.int32)
    for q, own in enumerate(np.split(numbers[order], ends[:-1]) if len(queries) else []):
        if (key := own.tobytes()) not in groups:
            groups[key] = len(lists)
            lists.append(own)
        group_of[q] = groups[key]
    return Asked(known, queries, group_of, lists)


def encoded(words: pa.ListArray, terms: pa.Array, code: str) -> tuple[np.ndarray, pa.BinaryArray]:
    """The lengths of the lists, and of each list the numbers of those words that are terms, in order and as often as they stand."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.index_in(words.flatten().cast(terms.type), value_set=terms)
    there = pc.is_valid(at).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(words)), lengths)[there]
    number = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[there].astype(np.int64)
    span = max(1, len(terms))
    data = (np.sort(owner * span + number) % span).astype(code)
    offsets = np.zeros(len(words) + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=len(words)) * data.itemsize, out=offsets[1:])
    return lengths, pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def decoded(held: pa.BinaryArray, code: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, occurrences) of every posting, by row."""
    if not len(held):
        return np.zeros(0, np.int64), np.zeros(0, code), np.zeros(0, np.int64)
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    body = held.buffers()[2]
    flat = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]].view(code) if offsets[-1] > offsets[0] else np.zeros(0, code)
    rows = np.repeat(np.arange(len(held)), np.diff(offsets) // flat.itemsize)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(new)
    return rows[starts], flat[starts], np.diff(np.append(starts, len(flat)))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks of about ``size``, each in order of item_id."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        return whole.take(pc.sort_indices(whole["item_id"])).combine_chunks().to_batches()[0]

    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            n += batch.num_rows
        if n >= size:
            yield block(parts)
            parts, n = [], 0
    if parts:
        yield block(parts)


def best(rows: np.ndarray, terms: np.ndarray, parts: np.ndarray, n: int, groups: list[np.ndarray], floors: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, row, score): the k best of n rows for every group of terms, of equal scores the lower rows, without those below
    the group's floor. parts has what each posting adds to a score. A floor rises to the k-th best score of its group."""
    scale = 10.0**decimals
    size = max((len(terms) and int(terms.max()) + 1, *(int(g[-1]) + 1 for g in groups if len(g))), default=0)
    order = np.argsort(terms, kind="stable")
    rows, parts = rows[order], parts[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=size))])
    dense: dict[int, np.ndarray] = {}
    for t in np.flatnonzero(np.diff(ends) > DENSE * n).tolist():
        dense[t] = np.zeros(n)
        dense[t][rows[ends[t] : ends[t + 1]]] = parts[ends[t] : ends[t + 1]]
    ends = ends.tolist()
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for g, own in enumerate(groups):
        own = own.tolist()
        spans = [slice(ends[t], ends[t + 1]) for t in own if t not in dense and ends[t + 1] > ends[t]]
        whole = [dense[t] for t in own if t in dense]
        if spans:
            scores = np.bincount(np.concatenate([rows[s] for s in spans]), np.concatenate([parts[s] for s in spans]), n)
        elif whole:
            scores = np.zeros(n)
        else:
            continue
        for x in whole:
            scores += x
        low = floors[g]
        if n > 2 * FIRST:
            low = max(low, np.partition(scores[:FIRST], FIRST - k)[FIRST - k]) if k <= FIRST else low
        # a score that is rounded up reaches the floor from half a unit below
        at = np.flatnonzero(scores >= low - 1 / scale) if low > 1 / scale else np.flatnonzero(scores)
        units = np.floor(scores[at] * scale + 0.5)
        if len(at) > k:
            kth = np.partition(units, len(units) - k)[len(units) - k]
            above = np.flatnonzero(units > kth)
            keep = np.sort(np.concatenate([above, np.flatnonzero(units == kth)[: k - len(above)]]))
            at, units = at[keep], units[keep]
        if len(at):
            if len(at) == k:
                floors[g] = max(floors[g], units.min() / scale)
            out.append((g, at, units / scale))
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(np.array([g for g, _, _ in out], np.int32), [len(a) for _, a, _ in out]), np.concatenate([a for _, a, _ in out]), np.concatenate([s for _, _, s in out])
