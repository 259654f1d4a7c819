"""Records of evaluation splits that stand, the same or nearly so, in the training split.

The word n-grams of the evaluation records are hashed and partitioned, the training records are scanned for hits, and
every pair with enough hits gets its exact containment and likeness from both sets. Of an evaluation record only the rarest
n-grams are looked for, just so many that a training record that holds the wanted share of the record must hold several
of them (prefix filter), and a pair with fewer hits is dropped; rarity comes from a count of all n-grams of all records in a table of fixed size. A bit map of the
n-grams looked for, of bounded size, lets the scan drop the training n-grams that can't hit before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctiluca.llm.near_duplicates import parsed_sets, sets_of, unpacked, whole_texts
from noctiluca.llm.words import mixed
from noctiluca.session import cut

COUNT_BITS = 20
TRAIN, EVALUATION = 1, 2
#: Most bits of a bit map (32 MB); beyond that it lets more through, but loses nothing.
MAP_BITS, MAP_CHUNK = 28, 1 << 16
#: A pair needs a hit for every so many n-grams of the evaluation record, which is looked for with as many more of them.
PER_HIT = 25


def normal_split(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(f"`{column}`").cast("string"), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))


def sides(splits: DataFrame, id_col: str = "paper_id", split_col: str = "split", train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(id, side): 0 for training, 1 for evaluation; case and outer blanks of the split are ignored, others are left out."""
    name = normal_split(split_col)
    side = F.when(name.isin(*train), 0).when(name.isin(*evaluation), 1)
    return splits.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), side.cast("int").alias("side")).where("id is not null and side is not null").distinct()


def count_table(parsed: DataFrame) -> np.ndarray:
    """How often n-grams fall into each of 2**COUNT_BITS cells, over all records. Every task adds up its own records first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            total += np.bincount((unpacked(batch.column("set"))[0] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "times"])

    counted = parsed.select("set").mapInArrow(each, "cell int, times bigint").groupBy("cell").agg(F.sum("times").alias("times")).toPandas()
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[counted["cell"].to_numpy(np.int64)] = counted["times"].to_numpy(np.int64)
    return table


def bit_map(values: DataFrame, column: str) -> np.ndarray:
    """A bit map of 64-bit values, 32 bits for each of them up to the bound. Every task makes its own, which are joined on
    the executors piece by piece; at most 2**MAP_BITS bits come to the driver."""
    bits = int(np.clip(np.ceil(np.log2(32 * max(1, values.count()))), 19, MAP_BITS))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = mixed(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        pieces = mine.reshape(-1, MAP_CHUNK)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pieces[i].tobytes() for i in some], pa.binary())], names=["piece", "bits"])

    def join(group: pa.Table) -> pa.Table:
        held = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()]))
        return pa.table({"piece": group.column("piece").slice(0, 1), "bits": pa.array([held.tobytes()], pa.binary())})

    out = np.zeros((1 << (bits - 3)) // MAP_CHUNK * MAP_CHUNK, np.uint8).reshape(-1, MAP_CHUNK)
    for r in values.select(column).mapInArrow(each, "piece int, bits binary").groupBy("piece").applyInArrow(join, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_map(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = mixed(values) >> np.uint64(64 - int(np.log2(len(held))) - 3)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def rarest(tokens: np.ndarray, starts: np.ndarray, times: np.ndarray, share: float) -> np.ndarray:
    """Mask of the n - ceil(share n) + h members of each set that occur least, with h = ceil(n / PER_HIT): whoever holds that
    share of the set misses at most n - ceil(share n) members, and so holds h of them."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, times, owner))
    needed = np.ceil(share * sizes - 1e-9).astype(np.int64)
    keep = sizes - needed + np.minimum(needed, -(-sizes // PER_HIT))
    out = np.zeros(len(tokens), bool)
    out[order] = np.arange(len(tokens)) - np.repeat(starts[:-1], sizes) < np.repeat(keep, sizes)
    return out


def _posted(parsed: DataFrame, chosen, name: str) -> DataFrame:
    """(gram, name, size): of each distinct set of a batch the members that ``chosen(tokens, starts)`` marks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.unique(batch.column("key").to_numpy(), return_index=True)[1]))
            tokens, starts = unpacked(batch.column("set"))
            mask = chosen(tokens, starts) if len(tokens) else np.empty(0, bool)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))[mask]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[mask].view(np.int64)), pa.array(batch.column("key").to_numpy()[owner]), pa.array(np.diff(starts)[owner].astype(np.int32))], names=["gram", name, f"{name}_size"])

    return parsed.select("key", "set").mapInArrow(each, f"gram bigint, {name} bigint, {name}_size int").distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (a, at), (b, bt) = unpacked(batch.column("e_set")), unpacked(batch.column("t_set"))
        pair = np.arange(batch.num_rows)
        # equal members of one pair become neighbours once both sides are sorted together
        member, owner = np.r_[a, b], np.r_[np.repeat(pair, np.diff(at)), np.repeat(pair, np.diff(bt))]
        order = np.lexsort((member, owner))
        member, owner = member[order], owner[order]
        common = np.bincount(owner[1:][(member[1:] == member[:-1]) & (owner[1:] == owner[:-1])], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("e"), batch.column("t"), pa.array(common / np.diff(at)), pa.array(common / (np.diff(at) + np.diff(bt) - common))], names=["evaluation_class", "training_class", "containment", "likeness"])


def split_overlap(records: DataFrame, splits: DataFrame, id_col: str = "paper_id", fields: tuple[str, ...] = ("title", "abstract"), n: int = 3, containment: float = 0.85, **names) -> tuple[DataFrame, DataFrame]:
    """(members, overlaps).

    members: (id, side, class_id), one row per record and side that takes part; records with the same n-grams have one
    class. overlaps: (evaluation_class, training_class, containment, likeness), one row per two classes of which the
    training one holds at least that share of the evaluation one's distinct n-grams (``containment``), however long it is;
    a class that occurs on both sides with itself. ``likeness`` is shared n-grams over those in either, which is never
    more than containment, so pairs of any likeness from ``containment`` upwards are among the rows. Nothing is estimated
    and no candidate is dropped; n-grams are compared as 64-bit hashes. Records without an id, with a null or blank field,
    fewer than n words or a split that is neither take no part; repeated rows count once; other columns are not read; an
    empty table on either side gives no rows.

    An n-gram that very many records hold is a hot key of the join of postings, which adaptive execution splits; it is only
    looked for by records that have no rarer ones.
    """
    parsed = parsed_sets(whole_texts(records, id_col, fields).join(sides(splits, **names), "id"), len(fields), n, wide=True)
    context = records.sparkSession.sparkContext
    members = parsed.select("id", "side", F.col("key").alias("class_id")).distinct()
    flags = members.groupBy("class_id").agg(F.bit_or(F.when(F.col("side") == 0, TRAIN).otherwise(EVALUATION)).alias("flag"))
    same = flags.where(F.col("flag") == TRAIN | EVALUATION).select(F.col("class_id").alias("evaluation_class"), F.col("class_id").alias("training_class"), F.lit(1.0).alias("containment"), F.lit(1.0).alias("likeness"))
    table = context.broadcast(count_table(parsed))

    def looked_for(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        times = table.value[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
        return rarest(tokens, starts, times, containment) & (times > 1)  # what occurs once is in no other record

    wanted = cut(_posted(parsed.where("side = 1"), looked_for, "e"))
    grams = context.broadcast(bit_map(wanted, "gram"))
    hits = _posted(parsed.where("side = 0"), lambda tokens, starts: in_map(grams.value, tokens), "t")
    held_at_least = F.ceil(containment * F.col("e_size") - 1e-9)
    met = wanted.join(hits, "gram").where((F.col("e") != F.col("t")) & (F.col("t_size") >= held_at_least)).groupBy("e", "t", "e_size").agg(F.count("*").alias("hits"))
    pairs = cut(met.where(F.col("hits") >= F.least(held_at_least, F.ceil(F.col("e_size") / PER_HIT))).select("e", "t"))
    keys = context.broadcast(bit_map(pairs.select(F.explode(F.array("e", "t")).alias("key")), "key"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(keys.value, batch.column("key").to_numpy().view(np.uint64))))

    held = cut(sets_of(parsed).mapInArrow(needed, "key bigint, set binary").dropDuplicates(["key"]))
    both = pairs.join(held.select(F.col("key").alias("e"), F.col("set").alias("e_set")), "e").join(held.select(F.col("key").alias("t"), F.col("set").alias("t_set")), "t")
    near = both.mapInArrow(_compare, "evaluation_class bigint, training_class bigint, containment double, likeness double").where(F.col("containment") >= containment - 1e-9)
    return members, cut(near.unionByName(same))


def overlapping_pairs(members: DataFrame, overlaps: DataFrame, likeness: float = 0.85) -> DataFrame:
    """(paper_id_a, paper_id_b), a < b: every evaluation record with every training record that is at least that like it."""
    overlaps = overlaps.where(F.col("likeness") >= likeness - 1e-9)
    test = members.where("side = 1").select(F.col("class_id").alias("evaluation_class"), F.col("id").alias("e"))
    train = members.where("side = 0").select(F.col("class_id").alias("training_class"), F.col("id").alias("t"))
    return overlaps.join(test, "evaluation_class").join(train, "training_class").where("e <> t").select(F.least("e", "t").alias("paper_id_a"), F.greatest("e", "t").alias("paper_id_b")).distinct()


def overlapping_records(members: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(paper_id, training_records, containment, likeness) per evaluation record with overlaps: the number of training
    records concerned and the highest values. Copies are counted, not listed."""
    train = members.where("side = 0").groupBy("class_id").agg(F.count("*").alias("n")).withColumnRenamed("class_id", "training_class")
    best = overlaps.join(train, "training_class").groupBy("evaluation_class").agg(F.sum("n").alias("training_records"), F.max("containment").alias("containment"), F.max("likeness").alias("likeness"))
    return members.where("side = 1").withColumnRenamed("class_id", "evaluation_class").join(best, "evaluation_class").select(F.col("id").alias("paper_id"), "training_records", "containment", "likeness")


def overlap_report(found: DataFrame, splits: DataFrame, records: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(split, source, category, records, overlapping, share) per evaluation split, source and category. Nulls form groups
    of their own; a record with rows of several sources counts in each."""
    split = normal_split("split").alias("split")
    held = splits.select(F.col(id_col).alias("paper_id"), split, "source").where(F.col("split").isin("validation", "test")).distinct()
    kind = records.groupBy(F.col(id_col).alias("paper_id")).agg(F.min("category").alias("category"))
    hit = found.select("paper_id", F.lit(1).alias("hit"))
    return held.join(kind, "paper_id").join(hit, "paper_id", "left").groupBy("split", "source", "category").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping")).withColumn("share", F.col("overlapping") / F.col("records"))
