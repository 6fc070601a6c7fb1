"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections, groups of linked documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.common import Hashes, components, drop, flat, light, lists, mix, save, shingle_hashes, tune, words_of

#: Shingles that one cell of a tile holds at most, about; what bounds a task's memory, whatever a group's size.
CELL_SHINGLES = 1 << 20
#: Megabytes of files up to which the list of rows to compare is broadcast; beyond, Spark shuffles the join.
BROADCAST_MB = 16
#: Bytes of bitmaps that one cell holds at most, about, and what a row counts as at least.
CELL_BYTES, ROW_BYTES = 1 << 20, 256


def _limits(num: int, den: int, most: int = 1 << 31) -> list[int]:
    """Upper set sizes of the size bands; a band's sets share one way of splitting."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def signatures(shingles: np.ndarray, num: int, den: int, limits: list[int]) -> np.ndarray:
    """Signatures of which any two sets with a Jaccard similarity of num/den or more have one in common.

    Sets of sizes a <= b that are that similar differ in at most D = (a + b)(den - num)/(den + num) shingles. Split by
    hash into D + 1 + E parts, at least E + 1 parts of both are equal. Each set drops its E smallest parts (which unrelated
    sets often share), by size and number: the last of the equal parts in that order has E before it in either set, so both
    keep it. D is that of the band of the larger set; a set also takes part in the bands that its larger partners may be in.
    """
    n = len(shingles)
    out = []
    for band in range(int(np.searchsorted(limits, n)), int(np.searchsorted(limits, n * den // num)) + 1):
        must = 2 * limits[band] * (den - num) // (den + num) + 1
        spare = must // (8 if 10 * num >= 9 * den else 4)
        parts = must + spare
        part = ((shingles >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        full = np.flatnonzero(counts)
        sums = np.zeros(parts, np.uint64)
        sums[full] = np.add.reduceat(mix(shingles[order]), (np.cumsum(counts) - counts)[full])
        made = mix(sums + mix(np.arange(parts, dtype=np.uint64) * np.uint64(1024) + np.uint64(band)) + counts.astype(np.uint64))
        if spare:
            made = made[np.argsort(counts, kind="stable")[spare:]]
        out.append(made)
    return np.concatenate(out)


SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bitmap", pa.binary()), ("signatures", pa.list_(pa.int64()))])


def bitmap_of(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """A bit per hash bucket, toggled by each shingle that falls into it, as 64-bit words. The bits in which two bitmaps of
    one width differ are at most the shingles in which the sets differ. The width, a power of two, grows with the set;
    a bitmap of half the width is the exclusive or of its halves."""
    bits = 64
    while bits < 3 * (len(shingles) * (den - num) // num + 1) and bits < 1 << 16:
        bits *= 2
    return _widened(shingles, bits)


def _sets(k: int, num: int, den: int):
    limits = _limits(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes(), set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            n, h1, h2, bitmaps, made = [], [], [], [], []
            for text in texts:
                hashes.trim()
                s = shingle_hashes(hashes.array(words_of(text)), k)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                bitmaps.append(bitmap_of(s, num, den).tobytes())
                if not len(s) or (key := (h1[-1], h2[-1])) in known:  # an equal set's signatures are there already
                    made.append(np.empty(0, np.uint64))
                    continue
                if len(known) > 200_000:
                    known.clear()
                known.add(key)
                made.append(signatures(s, num, den, limits))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bitmaps, pa.binary()), lists(np.concatenate(made).view(np.int64), [len(x) for x in made])], schema=SETS)

    return run


def _bounded(num: int, den: int):
    """Within one tile: components of the sets whose bitmaps do not rule a link out, as (doc_id, root)."""

    def run(table: pa.Table) -> pa.Table:
        block, side, doc, sizes = (table.column(c).to_numpy() for c in ("block", "side", "doc_id", "n_shingles"))
        maps = [np.frombuffer(b, np.uint64) for b in table.column("bitmap").to_pylist()]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.lexsort((doc, side, sizes, block))
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(rows) > 1:
                root = _possible([maps[r] for r in rows], sizes[rows], side[rows], num, den)
                least = np.full(len(rows), np.iinfo(np.int64).max)
                np.minimum.at(least, root, doc[rows])
                out.append((doc[rows], least[root]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return run


def _possible(maps: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component label of each set (sorted by size) over the pairs that bit counts let through; connected pairs are skipped."""
    n = len(maps)
    root = np.arange(n)
    widths = np.array([len(m) for m in maps])
    folded, width = np.empty((0, 0), np.uint64), 0
    for i in range(n - 1):
        if widths[i] != width:  # sets further on are as wide or wider: fold them to this width
            width = widths[i]
            folded = np.stack([m.reshape(-1, width) for m in maps[i:]] if (widths[i:] == width).all() else [np.bitwise_xor.reduce(m.reshape(-1, width), axis=0)[None] for m in maps[i:]])[:, 0]
            start = i
        last = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        j = np.arange(i + 1, last)
        if side[0] >= 0:
            j = j[side[j] != side[i]]
        j = j[root[j] != root[i]]
        if not len(j):
            continue
        differ = np.bitwise_count(folded[j - start] ^ folded[i - start]).sum(axis=1, dtype=np.int64)
        j = j[differ * (den + num) <= (sizes[j] + sizes[i]) * (den - num)]
        if len(j):
            merged = np.unique(np.append(root[j], root[i]))
            root[np.isin(root, merged)] = merged[0]
    return root


def _verify(num: int, den: int, links: bool):
    """Within one tile: which sets are linked, as (doc_id, root, links) for each set that has a link there."""

    def run(table: pa.Table) -> pa.Table:
        block, side, doc, weight = (table.column(c).to_numpy() for c in ("block", "side", "doc_id", "copies"))
        values, offsets = flat(table.column("shingles"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.lexsort((doc, side, np.diff(offsets), block))
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(rows) > 1:
                sets = [values[offsets[r] : offsets[r + 1]] for r in rows]
                root, count = _links(sets, side[rows], weight[rows], num, den, links)
                hit = np.flatnonzero(count > 0)
                if len(hit):
                    least = np.full(len(rows), np.iinfo(np.int64).max)
                    np.minimum.at(least, root, doc[rows])
                    out.append((doc[rows][hit], least[root[hit]], count[hit]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        return pa.table({"doc_id": a, "root": b, "links": c})

    return run


def _widened(shingles: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits(np.bincount((mix(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def _links(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, num: int, den: int, links: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component label of each set (sorted by size) and the weight of the sets it is linked with (or 1 if ``links`` is false).

    Sides 0 and 1 mean that only pairs across them are compared; a side of -1 is a cell against itself. The bitmap has a bit per hash bucket that each shingle
    toggles: the bits in which two bitmaps differ are at most the shingles in which the sets differ, which bounds the
    overlap from above. Pairs that pass are intersected exactly; without ``links`` pairs already connected are left out.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat_sets = np.concatenate(sets)
    wide = len(bitmap_of(sets[-1].view(np.uint64), num, den)) if n else 1
    bitmap = np.stack([_widened(s.view(np.uint64), 64 * wide) for s in sets])
    local = np.unique(flat_sets, return_inverse=True)[1].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(local.max()) + 1, np.int32)
    root, count = np.arange(n), np.zeros(n, np.int64)
    crossing = side[0] >= 0
    for i in range(n - 1):
        last = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        j = np.arange(i + 1, last)
        if crossing:
            j = j[side[j] != side[i]]
        if not links:
            j = j[root[j] != root[i]]
        if not len(j):
            continue
        total = sizes[j] + sizes[i]
        differ = np.bitwise_count(bitmap[j] ^ bitmap[i]).sum(axis=1, dtype=np.int64)
        j = j[differ * (den + num) <= total * (den - num)]
        if not len(j):
            continue
        own = local[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        if len(j) * 4 > n:  # many: one pass over the whole tile's arrays
            overlap = np.add.reduceat(mark[local], starts)[j]
        else:
            overlap = np.array([int(mark[local[starts[x] : starts[x] + sizes[x]]].sum()) for x in j])
        mark[own] = 0
        j = j[den * overlap >= num * (sizes[j] + sizes[i] - overlap)]
        if len(j):
            if links:
                count[j] += weight[i]
                count[i] += weight[j].sum()
            else:
                count[j] = count[i] = 1
            merged = np.unique(np.append(root[j], root[i]))
            if len(merged) > 1:
                root[np.isin(root, merged)] = merged[0]
    return root, count



def join_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, links: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose sets of ``k``-word shingles have a Jaccard similarity of num/den or more.

    Words are runs without code points 9-13 and 32, A-Z lowered; fewer than ``k`` words make one shingle of the whole
    sequence. Returns doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included), copies
    (documents with the same non-empty set, itself included) and, with ``links``, n_links: the documents it is linked
    with, copies included. Null and empty texts have an empty set and stay alone. Rows with a null id are left out; rows
    that repeat an id count as one document with the greatest of their texts. Other columns of ``docs`` are ignored.
    Shingles are compared by 64-bit hashes, whole sets by 128 bits.

    Only one document of each set goes on. ``signatures`` makes sure that linked sets share a signature; sets that do
    form blocks (components over a star of edges for each signature: its least holder is found by an aggregation, and told
    to the others by a join that Spark can split, so no pairs are made and no signature's holders are gathered). A block's sets are dealt
    into cells by size band and hash, and each tile is one cell or two cells of the same or neighbouring bands: every
    pair that can be linked meets in exactly one tile, and no task holds more than two cells. First only bitmaps meet, and
    bit counts leave smaller blocks; then the sets of those meet and are intersected.
    """
    spark = docs.sparkSession
    tune(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    if source.groupBy("doc_id").count().where("count > 1").limit(1).count():
        source = save(source.groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    sets = save(source.mapInArrow(_sets(k, num, den), "doc_id long, n_shingles long, h1 long, h2 long, bitmap binary, signatures array<long>"), "sets")

    signed = sets.select(F.explode("signatures").alias("s"), "doc_id")
    first = save(signed.groupBy("s").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("s", "first"), "first")
    stars = signed.join(first, "s").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    blocks = components(stars, "blocks").withColumnRenamed("root", "block")
    drop(first)

    ids = sets.select("doc_id", "n_shingles", "h1", "h2")
    known = sets.drop("signatures").join(blocks, sets.doc_id == blocks.node, "left").where("n_shingles > 0")
    classes = save(known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.min("block").alias("block"), F.first("bitmap").alias("bitmap")), "classes")

    met = _tiled(classes.where("block is not null").select("class_id", "block", "n_shingles", "bitmap"), F.greatest(F.length("bitmap"), F.lit(ROW_BYTES)), CELL_BYTES, num, den)
    rows = met.select("block", F.explode("tiles").alias("t"), F.col("class_id").alias("doc_id"), "n_shingles", "bitmap").select("block", "t.tile", "t.side", "doc_id", "n_shingles", "bitmap")
    possible = components(rows.groupBy(_group(), "tile").applyInArrow(_bounded(num, den), "a long, b long"), "possible")
    narrowed = classes.select("class_id", "n_shingles", "copies").join(possible, F.col("class_id") == F.col("node")).select("class_id", "n_shingles", "copies", F.col("root").alias("block"))
    chosen = save(_tiled(narrowed, F.col("n_shingles"), CELL_SHINGLES, num, den).select("class_id", "block", "copies", "tiles"), "chosen")

    wanted = chosen
    if light(chosen, BROADCAST_MB):
        wanted = F.broadcast(wanted)
    texts = source.join(wanted, source.doc_id == F.col("class_id")).select("doc_id", "text", "block", "copies", "tiles")
    hashed = texts.mapInArrow(_shingled(k), "doc_id long, block long, copies long, shingles array<long>, tiles array<struct<tile:string,side:int>>")
    dealt = hashed.select("block", "doc_id", "copies", "shingles", F.explode("tiles").alias("t")).select("block", F.col("t.tile").alias("tile"), F.col("t.side").alias("side"), "doc_id", "copies", "shingles")
    met = save(dealt.groupBy(_group(), "tile").applyInArrow(_verify(num, den, links), "doc_id long, root long, links long"), "met")

    groups = components(met.select(F.col("doc_id").alias("a"), F.col("root").alias("b")), "groups")
    linked = met.groupBy("doc_id").agg(F.sum("links").alias("links")).withColumnRenamed("doc_id", "class_id")
    of_class = classes.select("h1", "h2", "n_shingles", "class_id", "copies").join(groups, F.col("class_id") == F.col("node"), "left").join(linked, "class_id", "left")
    of_class = of_class.select("h1", "h2", "n_shingles", "copies", F.coalesce("root", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = ids.join(of_class, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if links else out.drop("n_links")


def _group():
    """The block of a tile's rows, or one number for all packs of small blocks."""
    return F.when(F.col("tile").startswith("pack"), F.lit(-1).cast("long")).otherwise(F.col("block")).alias("at")


def _tiled(rows: DataFrame, weight, limit: int, num: int, den: int) -> DataFrame:
    """``rows`` (class_id, block, n_shingles, ...) of blocks with more than one row, with the tiles that each takes part in.

    A band of a block is cut into as many cells as its weight needs. A block that fits one cell is one tile, and small
    blocks are dealt many to a pack."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(den / num * 1.0001))).cast("int")
    rows = save(rows.withColumn("band", band).withColumn("weight", weight.cast("long")), "weighed")
    per_band = rows.groupBy("block", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("size"))
    per_block = per_band.groupBy("block").agg(F.sum("n").alias("sets"), F.sum("size").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("size") / F.lit(limit)).cast("int")))).alias("split")).where("sets > 1")
    per_block = save(per_block, "per_block")
    packs = max(1, math.ceil((per_block.where(F.col("total") <= limit).agg(F.sum("total")).first()[0] or 0) / limit))
    to = lambda b1, s1, b2, s2, side: F.struct(F.concat_ws(".", b1, s1, b2, s2).alias("tile"), side.cast("int").alias("side"))
    here, up, down = (F.coalesce(F.element_at("split", F.col("band") + d), F.lit(0)) for d in (0, 1, -1))
    over = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.pmod(F.xxhash64("class_id"), here).cast("int")
    tiles = F.concat(
        F.transform(over(here), lambda t: to(F.col("band"), F.least(own, t), F.col("band"), F.greatest(own, t), F.when(own == t, -1).otherwise((own > t).cast("int")))),
        F.transform(over(up), lambda t: to(F.col("band"), own, F.col("band") + 1, t, F.lit(0))),
        F.transform(over(down), lambda t: to(F.col("band") - 1, t, F.col("band"), own, F.lit(1))),
    )
    whole = F.array(F.struct(F.concat(F.lit("pack "), F.pmod(F.xxhash64("block"), F.lit(packs)).cast("string")).alias("tile"), F.lit(-1).alias("side")))
    return rows.join(per_block, "block").withColumn("tiles", F.when(F.col("total") <= limit, whole).otherwise(tiles)).drop("band", "weight", "sets", "total", "split")


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                hashes.trim()
                made.append(shingle_hashes(hashes.array(words_of(text)), k))
            shingles = lists(np.concatenate(made or [np.empty(0, np.uint64)]).view(np.int64), [len(x) for x in made])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), shingles, batch.column(4)], names=["doc_id", "block", "copies", "shingles", "tiles"])

    return run
