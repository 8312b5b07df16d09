"""Problem 8: mixing sources to target shares of tokens, by a multivariate-hypergeometric splitting tree over blocks.

Defined results: rows of a source that is null or has no target, or without a positive size, are left out; a null size is counted with a
public tokenizer; a source with a target but no rows cannot meet it, and the others keep their proportions to each other; an empty table
gives an empty mixture; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.sources.tables import materialize

#: Tokens of a shard, where their number is left open.
SHARD_TOKENS = 200_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of byte-level BPE tokenizers, in the form that the library documents (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, size): tokens of the whole text by a rank file.

    The file is shipped with the job; an executor that finds it nowhere fails, since a mixture must not depend on a machine.
    """
    if Path(tokenizer).exists():
        rows.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for pdf in batches:
            if len(pdf) and encode is None:
                encode = encoder(tokenizer)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "size": [len(encode(t)) for t in pdf["text"]]})

    return rows.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, size bigint")


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Callable[[str], list[int]]:
    """The encoding of a rank file, read once in each Python worker."""
    import tiktoken

    shipped = Path(SparkFiles.get(Path(tokenizer).name))
    path = shipped if shipped.exists() else Path(tokenizer)
    if not path.exists():
        raise FileNotFoundError(f"no tokenizer at {tokenizer}")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def document_sizes(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, size) of the documents that can be mixed; only texts whose n_tokens is null are read and tokenized."""
    named = documents.filter(F.col("doc_id").isNotNull()).join(targets.filter(F.col("target_weight") > 0).select("source").distinct(), "source", "left_semi")
    known = named.filter(F.col("n_tokens") > 0).select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("size"))
    unknown = count_tokens(named.filter(F.col("n_tokens").isNull() & F.col("text").isNotNull()), tokenizer)
    return known.unionByName(unknown.filter("size > 0"))


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def split_tree(rng: np.random.Generator, counts: np.ndarray, shards: int) -> np.ndarray:
    """Splits block counts per source among ``shards``: every node halves its shards and draws its left part without replacement.

    Returns shards x sources; each column sums to its count and each shard holds its share of all blocks up to rounding.
    """
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    take = int(round(int(counts.sum()) * left / shards))
    drawn = rng.multivariate_hypergeometric(counts, take, method="marginals") if counts.sum() else np.zeros_like(counts)
    return np.vstack([split_tree(rng, drawn, left), split_tree(rng, counts - drawn, shards - left)])


def plan_blocks(blocks: list[tuple[str, int, int]], weights: dict[str, float], repeats: dict[str, int], shards: int, seed: int) -> tuple[list[tuple], dict[str, float]]:
    """The (source, block, copy, shard, limit) rows of the mixture and the token quota of each source.

    ``blocks``: (source, block, tokens). The total is the largest at which no source needs more than its repeats. A source is read in
    whole epochs, each permuted anew, and the last epoch ends at the block that holds the quota's end; limit is the number of tokens to
    take of that block (null: all).
    """
    by: dict[str, list[tuple[int, int]]] = {}
    for source, block, tokens in blocks:
        by.setdefault(source, []).append((block, int(tokens)))
    have = {s: sum(t for _, t in b) for s, b in by.items()}
    live = {s: weights[s] for s in have if weights.get(s, 0) > 0 and repeats.get(s, 1) > 0 and have[s] > 0}
    if not live:
        return [], {}
    norm = sum(live.values())
    total = min(have[s] * repeats.get(s, 1) / (w / norm) for s, w in live.items())
    quota = {s: total * w / norm for s, w in live.items()}
    sources, drawn = sorted(live), {}
    for s in sources:
        left, copy, taken = round(quota[s]), 0, []
        while left > 0 and copy < repeats.get(s, 1):
            order = sorted(by[s], key=lambda b: _seed(seed, s, copy, b[0]))
            for block, tokens in order:
                if left <= 0:
                    break
                taken.append((block, copy, None if tokens <= left else left))
                left -= min(tokens, left)
            copy += 1
        drawn[s] = taken
    rng = np.random.default_rng(seed)
    parts = split_tree(rng, np.array([len(drawn[s]) for s in sources], dtype=np.int64), shards)
    rows = []
    for j, s in enumerate(sources):
        ends = np.cumsum(parts[:, j])
        order = sorted(drawn[s], key=lambda b: _seed(seed, "deal", s, b[0], b[1]))
        for i, (block, copy, limit) in enumerate(order):
            rows.append((s, block, copy, int(np.searchsorted(ends, i, side="right")), limit))
    return rows, quota


def mix(documents: DataFrame, targets: DataFrame, shards: int | None = None, max_blocks: int = 32_768, block_docs: int = 64, seed: int = 8, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy, shard, size, order_key): the mixture; ``order_key`` sorts a shard into its local shuffle (``shuffled``).

    Without ``shards`` there are as many as hold about SHARD_TOKENS each, 16 at least.

    Documents are hashed into blocks of about ``block_docs`` documents, larger ones once all sources together would have more than
    ``max_blocks``: only that bounded table of blocks meets the driver and is broadcast back. All documents take part; the block that
    holds a quota's end is cut after the document that reaches it.
    """
    spark = documents.sparkSession
    sizes = materialize(document_sizes(documents, targets, tokenizer))
    asked = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).collect()
    weights, repeats = {r["source"]: float(r["w"] or 0) for r in asked}, {r["source"]: int(r["r"] if r["r"] is not None else 1) for r in asked}
    n_docs = sizes.count()
    per = max(block_docs, -(-n_docs * 2 // max_blocks))
    counts = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.count("*").alias("n")).collect()}
    n_blocks = spark.createDataFrame([(s, max(1, -(-n // per))) for s, n in counts.items()], "source string, nb bigint")
    blocked = sizes.join(F.broadcast(n_blocks), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("nb"))).drop("nb")
    table = [(r["source"], r["block"], r["t"]) for r in blocked.groupBy("source", "block").agg(F.sum("size").alias("t")).collect()]
    rows, quota = plan_blocks(table, weights, repeats, shards or 1, seed)
    if shards is None and (wanted := max(16, -(-int(sum(quota.values())) // SHARD_TOKENS))) > 1:
        rows, _ = plan_blocks(table, weights, repeats, wanted, seed)
    plan = spark.createDataFrame(rows, "source string, block bigint, copy int, shard int, limit bigint")
    joined = blocked.join(F.broadcast(plan), ["source", "block"]).withColumn("order_key", F.xxhash64("doc_id", "copy", F.lit(seed)))
    whole = joined.filter(F.col("limit").isNull())
    w = Window.partitionBy("source", "block", "copy").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.filter(F.col("limit").isNotNull()).withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).filter(F.col("before") < F.col("limit")).drop("before")
    return whole.unionByName(cut).select("doc_id", "source", "copy", "shard", "size", "order_key")


def shuffled(mixture: DataFrame) -> DataFrame:
    """The mixture with each shard in one task, its rows in the order of their local shuffle: what a writer per shard puts out."""
    return mixture.repartition("shard").sortWithinPartitions("shard", "order_key", "doc_id", "copy")


def mix_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, tokens, share, copies): the shares really reached; sources of the targets that hold nothing have 0."""
    held = mixture.groupBy("source").agg(F.sum("size").alias("tokens"), (F.max("copy") + 1).alias("copies"))
    total = F.lit(held.agg(F.sum("tokens")).first()[0]).cast("bigint")
    joined = targets.filter(F.col("source").isNotNull()).join(held, "source", "left")
    return joined.select("source", "target_weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.try_divide(F.col("tokens").cast("double"), total.cast("double")), F.lit(0.0)), 6).alias("share"), F.coalesce("copies", F.lit(0)).alias("copies"))
