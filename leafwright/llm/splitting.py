"""Splitting oversized items at natural boundaries, by agglomerative merging.

Every unit (page) begins as a piece of its own.  Adjacent pairs wait in a heap, the weakest boundary first (no section
start, then the deepest sections; from the left), and are merged while the merged piece and the overlap it takes from its
left neighbour fit the limit.  What is left unmerged are cuts, mostly at strong boundaries.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import per_row

#: Items of more units are first cut into blocks of at most so many, each at the strongest boundary of its last quarter:
#: what one task holds of an item is bounded by it.
BLOCK = 50_000


def pieces(units: int, limit: int, overlap: int, strengths: dict[int, int], first: int = 1) -> list[tuple[int, int]]:
    """First and last unit of each piece of the units first .. units.

    strengths: of the boundary before a unit; others are 0.  All pieces but the item's first begin ``overlap`` units early
    (at most limit - 1, so that each has a unit of its own).
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    starts = list(range(first, units + 1))
    after = {s: s + 1 for s in starts}  # start of the next piece
    before = {s + 1: s for s in starts}
    heap = [(strengths.get(s, 0), s) for s in starts[1:]]
    heapq.heapify(heap)
    while heap:
        _, s = heapq.heappop(heap)
        left = before[s]
        size = after[s] - left + (overlap if left > 1 else 0)
        if size <= limit:  # pieces only grow: a pair that doesn't fit now never will
            after[left] = after[s]
            before[after[s]] = left
            del after[s], before[s]
    return [(s - (overlap if s > 1 else 0), e - 1) for s, e in sorted(after.items())]


def oversized(handles: DataFrame, pages: DataFrame, configs: DataFrame) -> DataFrame:
    """doc_id, n_pages, chunk_size, chunk_overlap of the documents with more pages than the chunk_size of their profile.

    handles: doc_id, page_count, profile, added_at; the latest row of a document holds (of equal times the one with the
    greater page_count, then profile); pages: doc_id, page_num, whose greatest number stands in for an unknown page_count;
    configs: profile, chunk_size, chunk_overlap.  A null profile is "default"; a document of an unknown profile, or of one
    without a chunk_size, or without pages, has no limit to exceed; a null overlap is 0.
    """
    latest = handles.groupBy("doc_id").agg(F.max_by(F.struct("page_count", "profile"), F.struct("added_at", "page_count", "profile")).alias("h")).select("doc_id", F.col("h.page_count").alias("stated"), F.coalesce("h.profile", F.lit("default")).alias("profile"))
    counted = pages.groupBy("doc_id").agg(F.max("page_num").alias("counted"))
    limits = configs.groupBy("profile").agg(F.max(F.struct("chunk_size", "chunk_overlap")).alias("c")).select("profile", "c.chunk_size", F.coalesce("c.chunk_overlap", F.lit(0)).alias("chunk_overlap"))
    known = latest.join(counted, "doc_id", "left").withColumn("n_pages", F.when(F.col("stated") > 0, F.col("stated")).otherwise(F.col("counted")))
    return known.join(limits, "profile").where("n_pages > chunk_size").select("doc_id", "n_pages", "chunk_size", "chunk_overlap")


def split_documents(documents: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, piece (from 1), first_page, last_page of each document in ``documents`` (see oversized).

    outline: doc_id, page_num, depth; a section start at the top of a page makes a boundary, the stronger the smaller the
    depth (null: deepest).  Repeated rows count once, pages outside the document and null pages not at all, the title is
    of no matter.  Documents that occur twice come out once; an empty table gives an empty result.
    """
    block = F.floor((F.col("page_num") - 1) / BLOCK).cast("int")
    documents = documents.dropDuplicates(["doc_id"])
    marks = outline.where("page_num > 1").groupBy("doc_id", "page_num").agg(F.min(F.coalesce("depth", F.lit(99))).alias("depth"))
    marks = marks.join(documents.select("doc_id", "n_pages"), "doc_id").where("page_num <= n_pages").withColumn("block", block)
    # Where the block after this one begins: a strong boundary in the last quarter, the last of equals, else its end.
    late = marks.where(F.col("page_num") > (F.col("block") + 0.75) * BLOCK)
    strong = late.groupBy("doc_id", "block").agg(F.min_by("page_num", F.struct("depth", (-F.col("page_num")).alias("last"))).alias("next"))
    blocks = documents.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_pages") - 1) / BLOCK).cast("int")))).join(strong, ["doc_id", "block"], "left")
    blocks = blocks.withColumn("next", F.least(F.when(F.col("n_pages") > (F.col("block") + 1) * BLOCK, F.coalesce("next", (F.col("block") + 1) * BLOCK + 1)).otherwise(F.col("n_pages") + 1), F.col("n_pages") + 1))
    before = blocks.select("doc_id", (F.col("block") + 1).alias("block"), F.col("next").alias("first"))
    blocks = blocks.join(before, ["doc_id", "block"], "left").withColumn("first", F.coalesce("first", F.lit(1)))
    # At most one and a quarter BLOCK pages of a document come together here.
    own = marks.join(blocks.select("doc_id", "block", "next"), ["doc_id", "block"]).withColumn("block", F.col("block") + (F.col("page_num") >= F.col("next")).cast("int"))
    own = own.groupBy("doc_id", "block").agg(F.collect_list("page_num").alias("at"), F.collect_list("depth").alias("depths"))
    blocks = blocks.join(own, ["doc_id", "block"], "left").withColumn("last", F.col("next") - 1)

    def cut(first: int, last: int, limit: int, overlap: int, at: list | None, depths: list | None) -> tuple:
        strengths = {p: max(1, 100 - d) for p, d in zip(at or [], depths or [])}
        found = pieces(last, limit, overlap, strengths, first)
        return [p for p, _ in found], [p for _, p in found]

    cuts = per_row(blocks.withColumnRenamed("block", "part"), ["doc_id", "part"], ["first", "last", "chunk_size", "chunk_overlap", "at", "depths"], lambda: cut, [("firsts", "array<int>"), ("lasts", "array<int>")])
    spans = cuts.select("doc_id", F.explode(F.arrays_zip("firsts", "lasts")).alias("s")).select("doc_id", F.col("s.firsts").alias("first_page"), F.col("s.lasts").alias("last_page"))
    return spans.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("last_page")).alias("piece"), "first_page", "last_page")
