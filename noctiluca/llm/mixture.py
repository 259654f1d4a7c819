"""Mixing sources to target weights, by Pareto order sampling after whole copies.

Every source gets its share of the total in tokens. As many whole copies of the source as fit are certain; of the rest
each document has an inclusion probability, which differs between sources and, with a weight column, between documents.
Documents are ranked by their random odds divided by their inclusion odds (Pareto sampling), and the lowest ranks are
taken until the tokens still wanted are reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctiluca.session import bounded_batches, cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of this kind of vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096


def _encoding(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("mixture", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER, weight_col: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, weight); null and blank texts have 0 tokens. Special tokens' strings are ordinary text. The
    vocabulary file is read by the driver and broadcast (a megabyte or so), so executors need not have it."""
    spark = documents.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    weight = F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    flat = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"), weight.alias("weight"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary.value)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t and not t.isspace() else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": sizes, "weight": batch["weight"]})

    return spread(flat.where(F.col("doc_id").isNotNull())).mapInPandas(each, "doc_id bigint, source string, tokens bigint, weight double")


def _cutoffs(ranked: DataFrame, wanted: dict[str, float], low: dict[str, float], width: float) -> dict[str, tuple[float, float]]:
    """Per source the start of the bin of ``v`` in which the wanted tokens are reached, and the tokens before it.

    The bins divide [low, low + width) of each source, so what comes to the driver is bounded by sources x BINS."""
    spark = ranked.sparkSession
    bounds = F.broadcast(spark.createDataFrame([(s, low[s]) for s in wanted], "source string, low double"))
    bins = ranked.join(bounds, "source").where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + width)).groupBy("source", F.least(F.floor((F.col("v") - F.col("low")) / width * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum("tokens").alias("tokens"))
    by: dict[str, list[tuple[int, int]]] = {}
    for r in bins.collect():
        by.setdefault(r["source"], []).append((r["bin"], r["tokens"]))
    out = {}
    for s, need in wanted.items():
        before, at = 0.0, None
        for b, tokens in sorted(by.get(s, [])):
            at = b
            if before + tokens >= need:
                break
            before += tokens
        if at is not None:
            out[s] = (low[s] + at * width / BINS, before)
    return out


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share_col: str = "target_share", repeats_col: str = "max_repeats", tokenizer: str = TOKENIZER, weight_col: str | None = None, seed: int = 3, most_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    chosen: (doc_id, source, tokens, copies) of every document used at least once, copies <= max_repeats. report: one row
    per target or source of documents: source, target_share, max_repeats, documents, available_tokens, wanted_tokens,
    used_documents, used_tokens, actual_share. Without ``total_tokens`` the total is the largest at which every source
    that has documents can give its share; with it, sources that can't are used up and the report shows the shortfall.

    Sources without a target give nothing; targets without documents get nothing, and shares are of what was used. Null
    and blank texts, null ids, null sources and weights of 0 are not used; a repeated id counts once (the least source and
    size of it); a null or negative share counts as 0, null repeats as 1; an empty table gives no documents and a report
    of zeros. ``weight_col`` makes documents of a source more or less likely to get the further copy. The choice depends
    on ids and seed only, so a task that is run again chooses the same. ``targets`` must be small: beyond ``most_sources``
    rows it raises.
    """
    spark = documents.sparkSession
    goal = {}
    for r in targets.where(F.col(f"`{source_col}`").isNotNull()).select(F.col(f"`{source_col}`").cast("string").alias("s"), F.col(f"`{share_col}`").cast("double").alias("share"), F.col(f"`{repeats_col}`").cast("int").alias("times")).limit(most_sources + 1).collect():
        goal[r["s"]] = (max(0.0, r["share"] or 0.0), max(0, 1 if r["times"] is None else r["times"]))
    if len(goal) > most_sources:
        raise ValueError(f"more than {most_sources} targets")
    sized = count_tokens(documents, id_col, text_col, source_col, tokenizer, weight_col)
    sized = cut(sized.where(F.col("source").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("source", "tokens", "weight")).alias("r")).select("doc_id", "r.source", "r.tokens", "r.weight"))
    usable = sized.where((F.col("tokens") > 0) & (F.col("weight") > 0))
    listed = F.broadcast(spark.createDataFrame([(s,) for s in goal], "source string"))
    usable = usable.join(listed, "source")
    have = {r["source"]: (r["n"], r["tokens"], r["weighted"]) for r in usable.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("weight")).alias("weighted")).collect()}
    able = [have[s][1] * times / share for s, (share, times) in goal.items() if s in have and share > 0]
    total = float(total_tokens if total_tokens is not None else min(able, default=0.0))
    plan = {}  # source -> (whole copies, tokens of the further copy)
    for s, (_, tokens, _) in have.items():
        share, times = goal[s]
        want = min(share * total, tokens * times)
        whole = min(times, int(want // tokens))
        plan[s] = (whole, want - whole * tokens if whole < times else 0.0)
    # inclusion probability scale * weight, at most 1: documents that reach 1 are certain and the others share the rest
    scale = {s: rest / have[s][2] for s, (_, rest) in plan.items() if rest > 0}
    if weight_col:
        for _ in range(30):
            bounds = F.broadcast(spark.createDataFrame([(s, c) for s, c in scale.items()], "source string, scale double"))
            got = usable.join(bounds, "source").withColumn("sure", F.col("scale") * F.col("weight") >= 1).groupBy("source").agg(F.sum(F.when(F.col("sure"), F.col("tokens")).otherwise(0)).alias("sure"), F.sum(F.when(~F.col("sure"), F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("open"))
            after = {r["source"]: (plan[r["source"]][1] - r["sure"]) / r["open"] if r["open"] > 0 and plan[r["source"]][1] > r["sure"] else scale[r["source"]] for r in got.collect()}
            moved = max((abs(after[s] / scale[s] - 1) for s in after), default=0.0)
            scale |= after
            if moved < 1e-9:
                break
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    setup = F.broadcast(spark.createDataFrame([(s, w, r, float(scale.get(s, 0.0))) for s, (w, r) in plan.items()], "source string, whole int, rest double, scale double"))
    odds = F.when(F.col("pi") >= 1, F.lit(0.0)).when(F.col("pi") <= 0, F.lit(None)).otherwise(uniform / (1 - uniform) * (1 - F.col("pi")) / F.col("pi"))
    ranked = cut(usable.join(setup, "source").withColumn("pi", F.least(F.lit(1.0), F.col("scale") * F.col("weight"))).withColumn("rank", odds).withColumn("v", F.col("rank") / (1 + F.col("rank"))).select("doc_id", "source", "tokens", "whole", "v"))
    wanted = {s: r for s, (_, r) in plan.items() if r > 0}
    low, width, before = dict.fromkeys(wanted, 0.0), 1.0, dict.fromkeys(wanted, 0.0)
    for _ in range(2):  # after two rounds a bin holds a 16-millionth of the ranks
        found = _cutoffs(ranked, {s: r - before[s] for s, r in wanted.items()}, low, width)
        for s, (start, passed) in found.items():
            low[s], before[s] = start, before[s] + passed
        width /= BINS
    edges = F.broadcast(spark.createDataFrame([(s, low[s], low[s] + width, r - before[s]) for s, r in wanted.items()], "source string, low double, high double, need double"))
    placed = ranked.join(edges, "source", "left")
    at_edge = placed.where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("high")))
    running = Window.partitionBy("source").orderBy("v", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = at_edge.withColumn("through", F.sum("tokens").over(running)).where(F.col("through") - F.col("tokens") / 2 <= F.col("need")).select("doc_id", F.lit(1).alias("edge"))
    copies = F.col("whole") + F.when(F.col("v") < F.col("low"), 1).when(F.col("edge") == 1, 1).otherwise(0)
    chosen = cut(placed.join(last, "doc_id", "left").withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies"))
    used = chosen.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    all_sources = sized.where("source is not null").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    wish = spark.createDataFrame([(s, share, times, share * total) for s, (share, times) in goal.items()], "source string, target_share double, max_repeats int, wanted_tokens double")
    joined = wish.join(all_sources, "source", "full").join(used, "source", "left").na.fill(0, ["documents", "available_tokens", "used_documents", "used_tokens", "wanted_tokens"])
    sum_used = chosen.agg(F.coalesce(F.sum(F.col("tokens") * F.col("copies")), F.lit(0)).alias("all_used"))
    report = joined.crossJoin(F.broadcast(sum_used)).withColumn("actual_share", F.when(F.col("all_used") > 0, F.col("used_tokens") / F.col("all_used")).otherwise(0.0))
    return chosen, report.select("source", "target_share", "max_repeats", "documents", "available_tokens", "wanted_tokens", "used_documents", "used_tokens", "actual_share")
