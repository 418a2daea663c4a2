"""SimHash near-duplicates: fingerprints, then Hamming links found by BK-trees over shards of the fingerprints.

Distinct fingerprints are cut into blocks of bits such that two fingerprints within the radius agree on all bits
of at least one choice of blocks; each choice and its bits name a shard. A shard's fingerprints form a BK-tree
(children keyed by their integer Hamming distance to the parent), every fingerprint of the shard is looked up in it
following only edges within the radius, and the shard emits one star per group it finds. Shards travel by shuffle,
not by driver broadcast, because they grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import components, durable

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Shards are cut finer (more blocks) until they hold about so many fingerprints on average.
SHARD_ROWS = 4096
#: Fingerprints from which on a shard is cut once more, and rows, about, of an Arrow group.
LARGE_SHARD, GROUP_ROWS = 50_000, 100_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the text's word shingles; 0 for null or no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only ASCII space splits
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = n // 255 * 255  # sums of 255 bits fit a byte
    count = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    count += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., fp) of docs(keys..., text), by default of doc_id: fp is the fingerprint's 64 bits as a signed long."""
    keys = keys or ("doc_id",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(len(keys))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(fps.view(np.int64))], [*keys, "fp"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Groups:
    """Union-find over positions; a root is the smallest position of its group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while True:
            above = self.up[root]
            if (above == root).all():
                self.up[at] = root
                return root
            root = above

    def join(self, at: np.ndarray, to: int) -> None:
        """One group of all positions at and to."""
        roots = np.unique(self.find(np.append(at, to)))
        self.up[roots] = roots[0]

    def join_pairs(self, at: np.ndarray, to: np.ndarray) -> None:
        """One group of at[i] and to[i] for each i."""
        while len(at):
            at, to = self.find(at), self.find(to)
            open_ = at != to
            at, to = np.maximum(at, to)[open_], np.minimum(at, to)[open_]
            np.minimum.at(self.up, at, to)


def link_shard(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Position of each distinct fingerprint's group leader, where groups are the components of links within radius.

    The BK-tree is built and searched in one descent: a node's pivot is compared with its subtree and with all
    queries that reach it, the rest of the subtree splits into children by distance d, and a query at distance q
    goes on to the children with |d - q| <= radius. Children with d <= radius are one group with the pivot, so a
    query leaves such a subtree as soon as it belongs to that group: dense groups cost no all-pairs work.
    """
    groups = Groups(len(fps))
    todo: list[tuple[np.ndarray, np.ndarray, bool]] = [(np.arange(len(fps)), np.empty(0, np.int64), False)]
    while todo:
        own, asking, one_group = todo.pop()  # the subtree's members, queries from outside it, whether own is one group
        pivot, rest = own[0], own[1:]
        if one_group and len(asking):
            asking = asking[groups.find(asking) != groups.find(own[:1])[0]]
        if one_group and not len(asking):
            continue
        d_rest, d_asking = popcount(fps[rest] ^ fps[pivot]), popcount(fps[asking] ^ fps[pivot])
        near = np.concatenate([rest[d_rest <= radius], asking[d_asking <= radius]])
        if len(near):
            groups.join(near, pivot)
        if not len(rest):
            continue
        by = np.argsort(d_rest, kind="stable")
        rest, d_rest = rest[by], d_rest[by]
        keys, first = np.unique(d_rest, return_index=True)
        for key, members in zip(keys.tolist(), np.split(rest, first[1:]), strict=True):
            # Members of other children ask here once for each pair of children: from the larger key to the smaller.
            reach = (d_asking >= key - radius) & (d_asking <= key + radius)
            siblings = rest[(d_rest > key) & (d_rest <= key + radius)] if not one_group else rest[:0]
            todo.append((members, np.concatenate([asking[reach], siblings]), one_group or key <= radius))
    return groups.find(np.arange(len(fps)))


def link_small_shards(fps: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """link_shard() for many small shards at once, level by level through all their trees.

    shard: ascending shard number of each fingerprint. Memory grows with the pairs of a level, so it is for shards
    of up to SMALL fingerprints, BATCH in all."""
    groups = Groups(len(fps))
    own, node, one_group = np.arange(len(fps)), np.unique(shard, return_inverse=True)[1], np.zeros(len(fps), bool)
    asking, at = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(own):
        n = node[-1] + 1
        first = np.searchsorted(node, np.arange(n))
        pivot = own[first]
        rest = np.delete(np.arange(len(own)), first)
        own, node = own[rest], node[rest]
        d_own, d_asking = popcount(fps[own] ^ fps[pivot[node]]).astype(np.int64), popcount(fps[asking] ^ fps[pivot[at]]).astype(np.int64)
        near_own, near_asking = d_own <= radius, d_asking <= radius
        groups.join_pairs(np.concatenate([own[near_own], asking[near_asking]]), np.concatenate([pivot[node[near_own]], pivot[at[near_asking]]]))
        if not len(own):
            break
        by = np.lexsort((d_own, node))
        own, node, d_own = own[by], node[by], d_own[by]
        starts = np.append(True, (node[1:] != node[:-1]) | (d_own[1:] != d_own[:-1]))
        child = np.cumsum(starts) - 1
        table = np.full((n, 65 + 2 * radius), -1)  # child by parent and key + radius
        table[node[starts], d_own[starts] + radius] = np.arange(child[-1] + 1)
        child_one = one_group[node[starts]] | (d_own[starts] <= radius)
        steps = np.arange(-radius, radius + 1)
        to_asking = table[at[:, None], d_asking[:, None] + radius + steps]
        free = ~one_group[node]
        to_sibling = table[node[free][:, None], d_own[free][:, None] + radius + steps[:radius]]
        new_asking = np.concatenate([np.broadcast_to(asking[:, None], to_asking.shape)[to_asking >= 0], np.broadcast_to(own[free][:, None], to_sibling.shape)[to_sibling >= 0]])
        new_at = np.concatenate([to_asking[to_asking >= 0], to_sibling[to_sibling >= 0]])
        head = own[np.flatnonzero(starts)]
        useful = ~child_one[new_at] | (groups.find(new_asking) != groups.find(head[new_at]))
        asking, at = new_asking[useful], new_at[useful]
        goes_on = ~child_one
        goes_on[at] = True
        number = np.cumsum(goes_on) - 1
        stay = goes_on[child]
        own, node, at, one_group = own[stay], number[child[stay]], number[at], child_one[goes_on]
    return groups.find(np.arange(len(fps)))


#: Shards up to SMALL fingerprints go through their trees together, BATCH fingerprints at a time.
SMALL, BATCH = 512, 1 << 14


def n_blocks(n: int, radius: int = RADIUS) -> int:
    """Number of bit blocks for n distinct fingerprints: the least that makes shards of SHARD_ROWS, 16 at most."""
    blocks = radius + 1
    while blocks < 16 and n / 2 ** (64 * (blocks - radius) // blocks) > SHARD_ROWS:
        blocks += 1
    return blocks


def block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` out of so many blocks of the given bit positions."""
    edge = [len(bits) * i // blocks for i in range(blocks + 1)]
    mask = [sum(1 << i for i in bits[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(mask, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fp: Column, masks: Column) -> Column:
    """Array of (choice, bits): the fingerprint's bits under each mask."""
    return F.transform(masks, lambda m, i: F.struct(i.alias("choice"), fp.bitwiseAND(m).alias("bits")))


def shard_keys(fp: Column, blocks: int, radius: int = RADIUS) -> Column:
    """Array of (choice, bits): one for each choice of blocks - radius blocks, with the fingerprint's bits there."""
    masks = block_masks(list(range(64)), blocks, blocks - radius)
    assert len(masks) == comb(blocks, radius)
    return _keys(fp, F.array(*[F.lit(_signed(m)) for m in masks]))


def part_keys(fp: Column, choice: Column, blocks: int, radius: int = RADIUS) -> Column:
    """shard_keys() within a shard of that choice: pairs within the radius agree on one of radius + 1 blocks of the bits
    that the shard leaves open, too."""
    of_choice = []
    for m in block_masks(list(range(64)), blocks, blocks - radius):
        rest = [i for i in range(64) if not m >> i & 1]
        of_choice.append(F.array(*[F.lit(_signed(x)) for x in block_masks(rest, radius + 1, 1)]))
    return _keys(fp, F.get(F.array(*of_choice), choice))


def linked(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between ids of distinct(fp, id) whose components are those of all fingerprints within radius;
    b is the smallest id of the group that a shard found.

    A shard of more than LARGE_SHARD fingerprints is cut once more by bits that it leaves open, so that its work is
    spread; no pair is lost."""
    n = distinct.count()
    blocks = n_blocks(n, radius)
    sharded = distinct.select("fp", "id", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("key")).select("fp", "id", "key.*")
    large = durable(sharded.groupBy("choice", "bits").count().where(F.col("count") > LARGE_SHARD).select("choice", "bits", F.lit(True).alias("large")), "simhash-large")
    if not large.isEmpty():
        cut = sharded.join(large, ["choice", "bits"], "left")
        whole = F.array(F.struct(F.lit(-1).alias("choice"), F.lit(0).cast("long").alias("bits")))
        parts = F.when(F.col("large"), part_keys(F.col("fp"), F.col("choice"), blocks, radius)).otherwise(whole)
        cut = cut.select("fp", "id", "choice", "bits", F.explode(parts).alias("part"))
        sharded = cut.select("fp", "id", F.col("choice") * (radius + 2) + F.col("part.choice") + 1, F.col("bits").bitwiseOR(F.col("part.bits"))).toDF("fp", "id", "choice", "bits")
    # Several shards share a task's Arrow group, of about GROUP_ROWS rows.
    buckets = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * comb(blocks, radius) // GROUP_ROWS + 1)
    sharded = sharded.withColumn("bucket", F.pmod(F.xxhash64("choice", "bits"), F.lit(buckets)))

    def links(bucket: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((bucket["id"], bucket["bits"], bucket["choice"]))
        fp, ids, bits, choice = (bucket[c].to_numpy()[order] for c in ("fp", "id", "bits", "choice"))
        shard = np.cumsum(np.append(False, (bits[1:] != bits[:-1]) | (choice[1:] != choice[:-1])))
        lead = np.arange(len(fp))  # the first position of a group has its smallest id
        sizes = np.bincount(shard)
        ends = np.cumsum(sizes)
        for s in np.flatnonzero(sizes > SMALL):
            of = np.arange(ends[s] - sizes[s], ends[s])
            lead[of] = of[link_shard(fp[of].view(np.uint64), radius)]
        small = np.flatnonzero((sizes[shard] <= SMALL) & (sizes[shard] > 1))
        cuts = np.flatnonzero(np.diff(shard[small])) + 1
        cuts = cuts[np.flatnonzero(np.diff(cuts // BATCH)) + 1] if len(cuts) else cuts
        for of in np.split(small, cuts):
            if len(of):
                lead[of] = of[link_small_shards(fp[of].view(np.uint64), shard[of], radius)]
        more = np.flatnonzero(lead != np.arange(len(fp)))
        return pd.DataFrame({"a": ids[more], "b": ids[lead[more]]})

    return sharded.groupBy("bucket").applyInPandas(links, "a long, b long")


#: Fingerprints of documents without an id get ids from here on, above all real ones.
NO_ID = 1 << 62


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of fingerprints within radius, itself included. Null
    and wordless texts have fingerprint zero and link like any other. Null doc_ids are kept; a component of null
    ids only has a null component_id. Rows that share a doc_id are one document, which links by all their texts. Rows
    repeated in docs stay repeated; an empty table gives no rows. Texts of any length are taken whole; other columns are
    left out, whatever their names.
    """
    each = durable(fingerprints(docs), "simhash")
    # A fingerprint is known by its smallest doc_id, so that components are named as asked without another grouping.
    known = F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.col("fp").bitwiseAND(F.lit(NO_ID - 1)))
    distinct = durable(each.groupBy("fp").agg(known.alias("id")), "simhash-distinct")
    found = components(linked(distinct, radius))
    led = distinct.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    led = led.withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return each.join(led, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Columns of docs; of each group of near-duplicates one row: the least by doc_id, then by a hash of the text.

    Groups are of texts: rows that share a doc_id but not a group of near-duplicates all stay. Rows alike in doc_id and
    text are one; the least by a hash of the other columns (maps left out) stands for them. Null and wordless texts
    are a group. A row whose doc_id is null has no identity to be compared by and is kept."""
    key = F.xxhash64("text")  # tells texts of one doc_id apart
    known = docs.where("doc_id is not null")
    each = durable(fingerprints(known.select("doc_id", key.alias("key"), "text"), "doc_id", "key"), "simhash-rows")
    distinct = durable(each.groupBy(F.col("fp").alias("id")).agg(F.min(F.struct("doc_id", "key")).alias("least")), "simhash-leads")
    found = components(linked(distinct.select(F.col("id").alias("fp"), "id"), radius))
    led = distinct.join(found, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("least").alias("least"))
    leaders = led.select("least.*")
    other = [docs[f"`{c}`"] for c, k in docs.dtypes if c != "text" and "map<" not in k]
    rows = known.select("doc_id", key.alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(*other).alias("place"))
    kept = rows.join(leaders, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.min_by("row", "place").alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
