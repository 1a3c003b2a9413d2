"""Similarity self-join on word n-grams by Jaccard distance in metric space.

The Jaccard distance 1 - |A and B| / |A or B| is a metric, so pivots and the triangle inequality bound it. But nearly
all pairs of documents are at distance 1, where windows around document pivots would send every document to every
region. So the space is cut twice:

* Outer regions. A document's distance to the pivot {s} of a single shingle s is 1 - 1 / |A|, or 1 without s: its
  nearest pivots are its shingles. Ordered by how many documents hold them, rarest first, a document is replicated
  to its first |A| - ceil(t |A|) + 1 pivots: two documents within distance 1 - t must share one of them. Shingles
  of a single document are nobody's meeting place. The smallest document at a shingle is the pivot of a region, which
  takes the documents of all shingles with that pivot: a document's regions are few, and regions do not chain.
* Inner pivots. A region's documents are compared with its pivot. A region whose documents are
  connected then is done, as is one of two documents. Other regions of more than ``block`` documents are cut by
  document pivots into Voronoi cells: a document goes to its nearest pivot and, by the triangle inequality, to each one
  that is at most 2 (1 - t) further; so twice, as long as windows part a region. What is still larger is joined block
  by block, a group for each pair of blocks. So no group holds more than two blocks, and the number of rounds does not
  depend on the data. A group is joined exactly, by a matrix product. Pairs that are connected already need no link.

Documents with equal sets (by 128 bits of them) are one class from the start. Shingles are 56-bit hashes of their
words' 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut
from . import _packed as P
from ._components import components
from ._text import buckets_for, chunks, lower_ascii, mix64, ragged, settled, split_words, string_parts, windows

U = np.uint64
HOT, HOT_DF = 64, 65535
ENTRIES, REPLIES, INFO, HOTS = 0, 1, 2, 3
INFO_SCHEMA = "row long, doc_id long, n long, sig array<long>, prefix array<long>, shared array<long>"
INFO_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("sig", "prefix", "shared"))])


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles, ordered by document: k words each, or all of fewer words."""
    words = split_words(lower_ascii(data), at)
    h = words.hashes()[0]
    pos, grams = windows(h, words.first, k)
    doc = words.doc_of()
    own = doc[pos]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        n = words.count[short]
        rank = ragged(np.zeros(len(short), np.int64), n)
        sums = np.add.reduceat(mix64(h[ragged(words.first[short], n)] + (rank.astype(np.uint64) + U(1)) * U(0xA0761D6478BD642F)), np.cumsum(n) - n)
        own, grams = np.r_[own, short], np.r_[grams, mix64(sums + n.astype(np.uint64))]
    order = np.argsort(grams)
    order = order[np.argsort(own[order].astype(np.int32), kind="stable")]
    own, grams = own[order], grams[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])] if len(own) else np.zeros(0, bool)
    return own[new], grams[new]


def _bucket(h: np.ndarray, nb: int) -> np.ndarray:
    return (((h >> U(24)) & U(0xFFFFFFFF)) % U(nb)).astype(np.int64)


def _map(k: int, nb: int, nd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are named by partition and place: a partition's rows come in one order (see settled)
        done = TaskContext.get().partitionId() << 33
        for batch in chunks(batches, "text"):
            ids = done + np.arange(batch.num_rows)
            done += batch.num_rows
            own, h = shingle_sets(*string_parts(batch.column(1)), k)
            n = np.bincount(own, minlength=len(ids))
            given = batch.column(0)
            yield from P.pack(P.doc_group(ids, nd), ids, np.asarray(given.fill_null(0)).view(U), 2 * n + np.asarray(given.is_null()), INFO)
            order = np.argsort(h)
            s = h[order]
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            held = np.diff(np.r_[at, len(s)])
            hot = np.zeros(len(h), bool)
            hot[order] = np.repeat(held > HOT, held)
            hots = s[at[held > HOT]]
            yield from P.pack(_bucket(hots, nb), np.zeros(len(hots), np.int64), hots, np.zeros(len(hots), np.int32), HOTS, 7)
            yield from P.pack(P.doc_group(ids[own[hot]], nd), ids[own[hot]], h[hot], np.full(int(hot.sum()), HOT_DF), REPLIES, 7)
            cold = ~hot
            # 56 bits of a hash travel, and name the shingle from here on
            yield from P.pack(_bucket(h[cold], nb), ids[own[cold]], h[cold], np.zeros(0 if not cold.any() else int(cold.sum()), np.int32), ENTRIES, 7)

    return run


def _count(nb: int, nd: int):
    """How many documents hold each shingle; replies go to documents for shingles of two or more."""

    def run(table: pa.Table) -> pa.Table:
        passed = pa.concat_tables([P.kind(table, REPLIES), P.kind(table, INFO)])
        doc, h, _ = P.unpack(P.kind(table, ENTRIES), 7)
        _, hots, _ = P.unpack(P.kind(table, HOTS), 7)
        order = np.argsort(h)
        s = h[order]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        df = np.diff(np.r_[at, len(s)])
        df = np.where(np.isin(s[at], hots), HOT_DF, np.minimum(df, HOT_DF - 1))
        df = np.repeat(df, np.diff(np.r_[at, len(s)]))
        some = df > 1
        doc, h, df = doc[order[some]], s[some], df[some]
        order = np.argsort(doc, kind="stable")
        rows = P.pack(P.doc_group(doc[order], nd), doc[order], h[order], df[order], REPLIES, 7)
        return pa.concat_tables([passed, pa.Table.from_batches(rows, P.ARROW)])

    return run


def _collect(percent: int):
    """Each document with its shared shingles (rarest first) and, of these, the pivots it is replicated to."""

    def run(table: pa.Table) -> pa.Table:
        ids, given, n = P.unpack(P.kind(table, INFO))
        doc, h, df = P.unpack(P.kind(table, REPLIES), 7)
        order = np.argsort(h)
        order = order[np.argsort(df[order], kind="stable")]
        order = order[np.argsort(doc[order], kind="stable")]
        doc, h = doc[order], h[order]
        by = np.argsort(ids, kind="stable")
        ids, given, unnamed, n = ids[by], given[by].view(np.int64), n[by] & 1 == 1, n[by].astype(np.int64) >> 1
        first, last = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        need = -(-n * percent // 100)
        joins = (last - first >= need) & (n > 0)
        reach = n - need + 1 - (n - (last - first))  # pivots left after the shingles that no other document holds
        sigs, prefixes, shared = [], [], []
        for i in range(len(ids)):
            if not joins[i]:
                sigs.append(None)
                prefixes.append(None)
                shared.append(None)
                continue
            own = h[first[i] : last[i]]
            whole = len(own) == n[i]
            sigs.append(np.array([mix64(own).sum(), mix64(own ^ U(0xA0761D6478BD642F)).sum()]).view(np.int64) if whole else None)
            prefixes.append(own[: reach[i]].view(np.int64))
            shared.append(np.sort(own).view(np.int64))
        columns = [pa.array(ids), pa.array(given, mask=unnamed), pa.array(n), *(pa.array(x, pa.list_(pa.int64())) for x in (sigs, prefixes, shared))]
        return pa.Table.from_arrays(columns, schema=INFO_ARROW)

    return run


def components_of(ids: np.ndarray, at: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int, columns: int = 2048) -> np.ndarray:
    """The smallest document that each one is connected with, by links or by equal labels at the start.

    ids: the shared shingles of all sets, one after another; at: where each starts; n: full sizes. Intersections of all
    pairs are a matrix product, over a bounded number of shingles at a time; shingles of one document add nothing.
    """
    docs = len(n)
    order = np.argsort(ids, kind="stable")
    s, own = ids[order], np.repeat(np.arange(docs), np.diff(at))[order]
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    held = np.diff(np.r_[new, len(s)])
    own, held = own[np.repeat(held > 1, held)], held[held > 1]
    ends = np.r_[0, np.cumsum(held)]
    both = np.zeros((docs, docs), np.float32)
    for lo in range(0, len(held), columns):
        part = np.arange(lo, min(lo + columns, len(held)))
        some = np.zeros((docs, len(part)), np.float32)
        some[own[ends[lo] : ends[part[-1] + 1]], np.repeat(part - lo, held[part])] = 1
        both += some @ some.T
    linked = 100 * both.astype(np.int64) >= percent * (n[:, None] + n[None, :] - both.astype(np.int64))
    _, first, which = np.unique(label, return_index=True, return_inverse=True)
    now = first[which]
    while True:  # each document takes the least of its neighbours, then all of a component take their least
        least = np.minimum(now, np.where(linked, now[None, :], docs).min(axis=1))
        low = np.full(docs, docs)
        np.minimum.at(low, now, least)
        low = np.minimum(low[now], least)
        if (low == now).all():
            return now
        now = low


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _join_groups(percent: int):
    """Links between documents of one group, up to connectedness; documents of one component are connected already."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("row", "ascending")]).combine_chunks()
        group, row, n, comp = (np.asarray(table[c]) for c in ("group", "row", "n", "comp"))
        lists = table["shared"].combine_chunks()
        flat, off = np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
        cut_at = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        a, b = [], []
        for lo, hi in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True):
            root = components_of(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n[lo:hi], comp[lo:hi], percent)
            first = np.unique(comp[lo:hi], return_index=True)[1]  # of each component; the others are linked with it
            some = first[root[first] != first]
            a.append(row[lo + some])
            b.append(row[lo + root[some]])
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], schema=LINKS)

    return run


def _linked(i: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * i >= percent * (n + m - i)


def _compare(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, each: int = 64) -> DataFrame:
    """The pairs (a, b) of a row and its region's pivot that are linked; n, m: sizes of their sets, size: the region's.

    The sizes of the sets part many pairs before any set is moved. A pivot goes to one task for each ``each`` rows.
    """
    pairs = pairs.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    parts = F.ceil(F.col("size") / each)
    pivots = sizes.where("size > 1").join(sets, F.col("region") == F.col("row"))
    pivots = pivots.select(F.col("region").alias("b"), F.col("shared").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    left = pairs.withColumn("part", F.pmod(F.xxhash64("a"), parts)).join(sets.select(F.col("row").alias("a"), "shared"), "a")
    both = left.join(pivots, ["b", "part"])
    return both.where(_linked(F.size(F.array_intersect("shared", "other")), F.col("n"), F.col("m"), percent)).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of regions that are not connected by the links, each with its component."""
    named = members.join(components(links), members["row"] == F.col("node"), "left").select("region", "row", "size", F.coalesce("component", "row").alias("comp"))
    open_ = named.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("region")
    return cut(named.join(cut(open_), "region"))


def _cells(big: DataFrame, sets: DataFrame, percent: int, block: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """One level of Voronoi cells: (cells with the documents of their windows, links to pivots)."""
    far = 2 * (1 - percent / 100) + 1e-9
    parts = F.ceil(F.col("size") / block)
    chosen = big.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("row", "region"), "row"))).where(F.col("rank") <= pivots)
    held = chosen.join(sets, "row").groupBy("region").agg(F.collect_list(F.struct("row", "n", "shared")).alias("pivots"), F.first("size").alias("size"))
    # a region's pivots go to as many tasks as it has blocks
    held = held.select("region", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    rows = big.join(sets, "row").withColumn("part", F.pmod(F.xxhash64("row"), parts))
    shared = lambda p: F.size(F.array_intersect(F.col("shared"), p["shared"]))
    seen = F.transform("pivots", lambda p: F.struct(p["row"].alias("pivot"), shared(p).alias("i"), p["n"].alias("m")))
    met = cut(rows.join(held, ["region", "part"]).select("region", "row", "comp", "n", F.transform(seen, lambda p: F.struct((1 - p["i"] / (F.col("n") + p["m"] - p["i"])).alias("d"), p["pivot"].alias("pivot"), _linked(p["i"], F.col("n"), p["m"], percent).alias("linked"))).alias("met")))
    links = met.select(F.col("row").alias("a"), F.explode(F.filter("met", lambda p: p["linked"])["pivot"]).alias("b")).where("a != b")
    near = met.select("region", "row", "comp", F.explode(F.filter("met", lambda p: p["d"] <= F.array_min("met")["d"] + far)).alias("p"))
    cells = near.select(F.col("region").alias("parent"), F.xxhash64("region", "p.pivot").alias("region"), "row", "comp")
    sizes = cells.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("size"))
    return cells.join(sizes, ["parent", "region"]), links


def _grouped(members: DataFrame, block: int) -> DataFrame:
    """Regions as groups of at most two blocks: (group, row, comp). Any two documents of a region meet in a group."""
    blocks = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("row", "region"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    placed = members.select("region", "row", "comp", own.alias("own"), other)
    return placed.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "row", "comp")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bucket_bytes: int = 4 << 20, block: int = 512, pivots: int = 8, levels: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the size of its set of word shingles (A-Z lower-cased; fewer
    words than a shingle count as one) and the smallest doc_id reachable by links of Jaccard similarity of at least
    percent / 100.

    doc_id must be an integer. Each row is a document of its own: rows may repeat an id with the same or another text.
    A null id stays null, and its component_id is the smallest doc_id that is not null, null if there is none. Null,
    empty and wordless texts have no shingles and link with nothing. Other columns are not read. An empty table gives
    no rows. ``block``, ``pivots`` and ``levels`` change how the work is dealt out, not the result.
    """
    docs = settled(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    nb = buckets_for(docs, bucket_bytes)
    nd = nb | 1
    counted = docs.mapInArrow(_map(shingle, nb, nd), P.SCHEMA).groupBy("key").applyInArrow(_count(nb, nd), P.SCHEMA)
    info = cut(counted.groupBy("key").applyInArrow(_collect(percent), INFO_SCHEMA))
    near = info.where("prefix IS NOT NULL").select("row", "sig", "n", "prefix")
    # what is joined by a key that many rows may hold is written down: AQE splits a skewed join of two plain shuffles
    classes = cut(near.where("sig IS NOT NULL").groupBy("sig", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    twins = cut(near.where("sig IS NOT NULL").join(classes, ["sig", "n"]).where("row != rep").select(F.col("row").alias("a"), F.col("rep").alias("b")))
    held = near.join(twins, near["row"] == twins["a"], "left_anti").select("row", "n", F.explode("prefix").alias("shingle"))
    homes = held.groupBy("shingle").agg(F.min(F.struct("row", "n")).alias("home"), F.count(F.lit(1)).alias("held")).where("held > 1")
    homes = homes.select("shingle", F.col("home.row").alias("region"), F.col("home.n").alias("m"))
    members = cut(held.join(homes, "shingle").select("region", "m", "row", "n").distinct())
    sets = info.join(members.select("row").distinct(), "row", "left_semi").select("row", "n", "shared")
    sizes = cut(members.groupBy("region").agg(F.count(F.lit(1)).alias("size")))
    members = members.join(sizes, "region")

    links = cut(_compare(members.where("row != region").select(F.col("row").alias("a"), "n", F.col("region").alias("b"), "m", "size"), sizes, sets, percent))
    left = _labelled(members.where("size > 2"), links)
    done = []
    for _ in range(levels):
        big = cut(left.where(F.col("size") > block))
        if big.isEmpty():
            break
        cells, more = _cells(big, sets, percent, block, pivots)
        # where windows part a region into smaller cells, these go on; else its own blocks are joined
        work = cells.groupBy("parent").agg(F.sum("size").alias("work"))
        whole = big.groupBy("region").agg(F.sum("size").alias("whole"))
        parted = cut(work.join(whole, work["parent"] == whole["region"]).where("work < 0.7 * whole").select("parent"))
        done += [left.where(F.col("size") <= block), big.join(parted, big["region"] == parted["parent"], "left_anti")]
        left = cells.join(parted, "parent", "left_semi").select("region", "row", "comp", "size")
        links = links.unionByName(more)
    for more in done:
        left = left.unionByName(more)
    groups = cut(_grouped(left, block))
    buckets = groups.count() // (2 * block) + 1
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets))).join(sets, "row")
    found = components(dealt.groupBy("bucket").applyInArrow(_join_groups(percent), "a long, b long").unionByName(links).unionByName(twins))
    named = info.join(found, info["row"] == found["node"], "left").select("doc_id", "n", F.col("component").alias("comp"))
    least = cut(named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least")))
    return named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
