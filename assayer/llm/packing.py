"""Texts of varying length put into containers of fixed capacity, cut only where one alone is longer.

First-fit decreasing with a tournament tree over the room left in the containers: its leaves are the containers, each inner node holds the most room
below it, so the first container that fits is found in log n steps. Texts are dealt at random into groups of about GROUP_SIZE pieces and each
group is packed by one task on its own; a group leaves about one half-filled container, so the loss is about one in a few thousand containers,
and no task grows with the data.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import cut_lineage

CAPACITY = 2048
GROUP_SIZE = 20_000
#: The vocabulary file is never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE vocabularies of this family cut a text into words. Fixed value, published with them.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(path: str = VOCABULARY):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def piece_sizes(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, piece (from 1), start_token, n_tokens, deal of each piece of each non-empty text; deal sets repeated rows apart."""
    kind = dict(docs.select(F.col(f"`{key}`").alias("key")).dtypes)["key"]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL AND text <> ''")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode_ordinary
        seen: dict = {}
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["text"]):
                n = len(encode(t))
                deal = seen.get(k, -1) + 1
                seen[k] = deal
                out += [(k, p + 1, s, min(capacity, n - s), deal) for p, s in enumerate(range(0, n, capacity))]
            if len(seen) > 1_000_000:
                seen.clear()
            yield pd.DataFrame(out, columns=["key", "piece", "start_token", "n_tokens", "deal"]).astype({"piece": "int32", "start_token": "int64", "n_tokens": "int32", "deal": "int32"})

    return rows.mapInPandas(sizes, f"key {kind}, piece int, start_token long, n_tokens int, deal int")


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container (from 0) of each of ``sizes``, in the order given, each put into the first one with room for it."""
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out.append(node - leaves)
        left = room[node] - size
        room[node] = left
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return out


def pack(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, seed: int = 7, group_size: int = GROUP_SIZE) -> DataFrame:
    """container, place, offset, key, piece, start_token, n_tokens: where each non-empty text, or piece of one longer than ``capacity``, lies.

    A container holds ``capacity`` tokens at most; place counts its pieces from 1 and offset is the token it starts at. Null and empty texts are in no
    container; repeated rows are packed as often as they occur. The same rows give the same containers.
    """
    # Tokenised once; the number of groups follows that of the pieces, of which a long text has many.
    pieces = cut_lineage(piece_sizes(docs, key, text, capacity, vocabulary))
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.col("key"), "piece", "deal", F.lit(seed)), F.lit(groups)))
    kind = dict(pieces.dtypes)["key"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "piece", "deal"], ascending=[False, True, True, True], kind="stable")
        bins = first_fit(pdf["n_tokens"].tolist(), capacity)
        pdf = pdf.assign(container=[int(pdf["grp"].iloc[0]) * 2**32 + b for b in bins])
        pdf["place"] = pdf.groupby("container").cumcount() + 1
        pdf["offset"] = pdf.groupby("container")["n_tokens"].cumsum() - pdf["n_tokens"]
        return pdf[["container", "place", "offset", "key", "piece", "start_token", "n_tokens"]]

    schema = f"container long, place int, offset int, key {kind}, piece int, start_token long, n_tokens int"
    return dealt.groupBy("grp").applyInPandas(one, schema).withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, least_containers (what the tokens need at least) and fill_rate."""
    whole = packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity).cast("long")
    return whole.select("containers", "tokens", least.alias("least_containers"), F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill_rate"))
