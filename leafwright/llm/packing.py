"""Filling fixed-capacity containers with texts, best-two-fit.

Sizes are numbers of tokens of a public tokenizer.  Texts are spread over groups at random (by a hash of their id), each
group is packed by one task, so the work grows in proportion and no group holds more than a bounded number of texts; what a
group wastes is its last, half-empty container.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint

#: Texts in a group, on average.
GROUP = 4000
#: Kinds of containers; the table of them is small and fixed.
MOST_KINDS = 100


def tokenizer(path: str):
    """The byte-level BPE of a .tiktoken file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, n_tokens.  Null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_tokens bigint")


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions in sizes by container; every size is at most the capacity.

    Best-two-fit: a container is filled greedily with the largest that still fits; then its smallest is replaced by two
    unpacked ones whenever two of them fill the gap so widened more tightly.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    values = [sizes[i] for i in order]  # ascending, in step with order
    out = []

    def take(at: int) -> int:
        values.pop(at)
        return order.pop(at)

    while values:
        held, room = [], capacity
        while values and (at := bisect_right(values, room) - 1) >= 0:
            room -= values[at]
            held.append(take(at))
        if room and len(held) > 0 and len(values) > 1:
            small = held[-1]
            gap = room + sizes[small]
            best, pair = room, None  # what is left over
            low, high = 0, bisect_right(values, gap) - 1
            while low < high:
                left = gap - values[low] - values[high]
                if left < 0:
                    high -= 1
                else:
                    if left < best:
                        best, pair = left, (low, high)
                        if not left:
                            break
                    low += 1
            if pair:
                held.pop()
                b, a = take(pair[1]), take(pair[0])
                held += [a, b]
                back = (sizes[small], small)
                at = bisect_right(values, back[0])
                values.insert(at, back[0])
                order.insert(at, small)
        out.append(held)
    return out


def packed(df: DataFrame, key: str, text: str, limits: DataFrame, path: str | None = None) -> DataFrame:
    """pack_name, capacity_tokens, container, key, part, tokens, fill: what stands in which container.

    A text over the capacity is split into full containers of its own and a rest that is packed like a text (part counts
    from 0); others are never split.  fill is the container's tokens over its capacity.  Null and empty texts have no
    tokens and stand in no container.  A key that occurs twice is packed once (the longer text).  limits: pack_name,
    capacity_tokens, a small fixed table (at most MOST_KINDS); null or non-positive capacities are left out.
    """
    sizes = checkpoint(token_counts(df, key, text, path or default_tokenizer()).where("n_tokens > 0").groupBy(key).agg(F.max("n_tokens").alias("n_tokens")))
    groups = max(1, -(-sizes.count() // GROUP))
    kinds = limits.where("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    if not kinds:
        sizes, kinds = sizes.limit(0), [("", 1)]
    # every text is packed once for each kind of container
    kind_ = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity_tokens")) for n, c in kinds]))
    each = sizes.withColumn("_k", kind_).select(key, "n_tokens", "_k.*").withColumn("grp", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    kind = dict(df.dtypes)[key]

    def run(pdf):
        import pandas as pd

        name, capacity, grp = pdf.pack_name.iat[0], int(pdf.capacity_tokens.iat[0]), int(pdf.grp.iat[0])
        pdf = pdf.sort_values(key)
        ids, tokens = pdf[key].tolist(), pdf.n_tokens.tolist()
        rows, items, n = [], [], 0
        for k, t in zip(ids, tokens):
            part = 0
            while t > capacity:
                rows.append((f"{grp}-{n}", k, part, capacity, 1.0))
                n, part, t = n + 1, part + 1, t - capacity
            if t:
                items.append((k, part, t))
        for held in pack([t for *_, t in items], capacity):
            fill = sum(items[i][2] for i in held) / capacity
            rows += [(f"{grp}-{n}", *items[i], fill) for i in held]
            n += 1
        out = pd.DataFrame(rows, columns=["container", key, "part", "tokens", "fill"])
        out.insert(0, "capacity_tokens", capacity)
        out.insert(0, "pack_name", name)
        return out

    return each.groupBy("pack_name", "capacity_tokens", "grp").applyInPandas(run, f"pack_name string, capacity_tokens bigint, container string, {key} {kind}, part int, tokens bigint, fill double")
