"""N-gram Jaccard join by vertical partitioning, and the components of its links.

All shingles have one global order, rare ones first by the counts of a fixed-size sketch. It is cut at its quantiles into
fragments of finer cells. Two similar sets share one of their first shingles in that order (at 90 %, a tenth of the set and one
more): the head, from which pairs come. Sizes and then the counts by cell bound what a pair can share; pairs within the bound
are counted fragment by fragment, each on its own, and the partial overlaps are summed per pair.

Equal sets are one class from the start. In the list of classes that share a head shingle, all are first compared with two
leaders; only classes that are not connected by then are compared with each other. Lists with the same leaders, as those of a
group of near copies are, are one list. What is compared across components is compared inside the tasks, by bitmaps of parities
first and then by the shingles themselves, and only links that join two components come out: fewer than a list has classes. So
no table has a row per pair of a list, and no link that joins two components is missed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c

#: Words of a shingle and the least similarity of a link, where a caller names none.
SHINGLE = 3
PERCENT = 90
#: Fragments that are counted separately, and the finer cells in each whose sizes bound the overlap.
FRAGMENTS, CELLS = 4, 32
SKETCH_BITS = 20
SKETCH_PARTS = 64
SLICE_BYTES = 1 << 22
#: Up to so many classes, of 16 bytes each, their numbers go to the texts; beyond, the texts, packed, go to them.
BROADCAST_CLASSES = 100_000
#: Classes of a longer list are dealt to blocks of about this many, and each two blocks are compared by themselves.
SHORT_LIST, BLOCK = 1024, 512
#: Bits of a set's bitmap; pairs compared at a time.
BITS, PAIRS = 1024, 1 << 16


def sets_of(data: np.ndarray, offsets: np.ndarray, first: int, last: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts ``first`` to ``last``: (text, hash), sorted. Fewer words than ``shingle`` are one shingle."""
    data, offsets = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
    begin, end, start = c.word_spans(data, offsets, c.SPACE_BYTES)
    words = c.word_hashes(data, begin, end, lower=True)
    whole = c.in_one_text(start, len(words), shingle)
    text = np.repeat(np.arange(last - first), np.diff(start))
    out_text, out = [text[:len(whole)][whole]], [c.gram_hashes(words, shingle)[whole]]
    for n in range(1, shingle):
        at = start[:-1][np.diff(start) == n]
        grams = c.gram_hashes(words, n)
        out_text.append(text[at] if len(at) else text[:0])
        out.append(grams[at] if len(at) else grams[:0])
    text, value = np.concatenate(out_text), np.concatenate(out)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def slices(offsets: np.ndarray):
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to
        at = to


def sketch_rows(batches, shingle):
    """One partition's counts of shingle cells, 16 bits each, in SKETCH_PARTS pieces."""
    count = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        data, offsets = c.text_buffer(batch.column(0))
        for at, to in slices(offsets):
            _, value = sets_of(data, offsets, at, to, shingle)
            count += np.bincount((value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(count))
    pieces = np.minimum(count, 65535).astype("<u2").reshape(SKETCH_PARTS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["part", "counts"])


def summed(batches):
    """Adds up the pieces of each part that a partition holds, one by one."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            piece = np.frombuffer(raw, "<u2").astype(np.int64)
            total[part] = total[part] + piece if part in total else piece
    for part, piece in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.minimum(piece, 2**31 - 1).astype("<u4").tobytes()], pa.binary())], names=["part", "counts"])


def sketch(documents: DataFrame, shingle: int) -> np.ndarray:
    """Counts of documents by shingle cell, over all documents; 4 MB, however many there are."""
    kind = "part int, counts binary"
    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(sketch_rows, shingle=shingle), kind)
    found = rows.repartition(SKETCH_PARTS, "part").mapInArrow(summed, kind).collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in found:
        out[r["part"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def cuts_of(counts: np.ndarray) -> np.ndarray:
    """The cell of each stretch of the global order (count, hash): FRAGMENTS x CELLS of about as many shingles each."""
    order = np.argsort(counts, kind="stable")
    mass = np.cumsum(counts[order])
    out = np.zeros(len(counts), np.uint8)
    out[order] = np.maximum(mass - 1, 0) * (FRAGMENTS * CELLS) // max(1, int(mass[-1]))
    return out


def cell_of(value: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return cuts[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)


def bitmaps(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts, the parity of its shingles by the last bits of their hashes, as bytes.

    A shingle that only one of two sets has changes one bit, so bitmaps differ in as many bits as the sets in shingles at most.
    """
    out = np.zeros((n, BITS // 8), np.uint8)
    cell = (value & np.uint64(BITS - 1)).astype(np.int64)
    np.bitwise_xor.at(out.ravel(), text * (BITS // 8) + (cell >> 3), np.left_shift(1, cell & 7).astype(np.uint8))
    return out


SETS = "row long, doc_id long, n long, cls long, head array<long>, parts array<int>, bits binary"


def set_rows(batches, shared, shingle, percent):
    """Batches of (row, doc_id, text) to each text's class, head shingles, number of shingles by cell and bitmap."""
    counts, cuts = shared.value
    for batch in batches:
        data, offsets = c.text_buffer(batch.column(2))
        pieces = []
        for at, to in slices(offsets):
            text, value = sets_of(data, offsets, at, to, shingle)
            n = np.bincount(text, minlength=to - at)
            # Two independent sums over the set; equal sets, equal class.
            total = np.zeros(to - at, np.uint64)
            np.add.at(total, text, c.mixed(value))
            other = np.zeros(to - at, np.uint64)
            np.add.at(other, text, c.mixed(value ^ np.uint64(c.STEP)))
            cls = c.mixed(c.mixed(total) * np.uint64(c.GRAM_STEP) + other + n.astype(np.uint64))
            parts = np.bincount(text * (FRAGMENTS * CELLS) + cell_of(value, cuts), minlength=(to - at) * FRAGMENTS * CELLS)
            rank = counts[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((value, rank, text))
            start = np.concatenate([[0], np.cumsum(n)])
            place = np.arange(len(text)) - start[text]
            need = n - (percent * n + 99) // 100 + 1
            head = order[place < need[text]]
            pieces.append((n, cls, parts, value[head], np.bincount(text[head], minlength=to - at), bitmaps(text, value, to - at)))
        if not pieces:
            continue
        n, cls, parts, head, sizes, bits = (np.concatenate(x) for x in zip(*pieces, strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(c.signed(cls)),
             c.list_column(c.signed(head), np.concatenate([[0], np.cumsum(sizes)])),
             c.list_column(parts.astype(np.int32), np.arange(len(n) + 1) * FRAGMENTS * CELLS), pa.array([x.tobytes() for x in bits], pa.binary())],
            names=["row", "doc_id", "n", "cls", "head", "parts", "bits"])


def segment_rows(batches, shared, shingle, packed):
    """Batches of (cls, text, which may be packed) to one row per class and fragment with its shingles, 48 bits each."""
    _, cuts = shared.value
    for batch in batches:
        cls = batch.column(0).to_numpy(zero_copy_only=False)
        if packed:
            texts = c.unpacked_texts(batch.column(1))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
        else:
            data, offsets = c.text_buffer(batch.column(1))
        for at, to in slices(offsets):
            text, value = sets_of(data, offsets, at, to, shingle)
            group = text * FRAGMENTS + cell_of(value, cuts) // CELLS
            order = np.argsort(group, kind="stable")
            group, value = group[order], value[order]
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
            raw = np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
            ends = np.append(cut[1:], len(group))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[at:to][group[cut] // FRAGMENTS]), pa.array((group[cut] % FRAGMENTS).astype(np.int32)),
                 pa.array([raw[6 * a:6 * b] for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())],
                names=["cls", "fragment", "shingles"])


def overlap_rows(batches):
    """Batches of (a, b, shingles of a, shingles of b), for one fragment each, to partial overlaps."""
    for batch in batches:
        partial_overlap = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(one, "V6"), np.frombuffer(two, "V6")
            partial_overlap.append(len(set(x.tolist()).intersection(y.tolist())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(partial_overlap, pa.int64())], names=["a", "b", "overlap"])


def similar(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Is the similarity ``percent`` or more if ``shared`` shingles are common?"""
    return 100 * shared >= percent * (n_a + n_b - shared)


def segments_of(wanted: DataFrame, rows: DataFrame, classes: DataFrame, shared, shingle: int) -> DataFrame:
    """The shingles of every class in ``wanted`` (cls), by fragment."""
    wanted = c.written(wanted.distinct().join(classes.select("cls", "row"), "cls"), "wanted")
    if wanted.count() <= BROADCAST_CLASSES:
        texts = rows.select("row", "text").join(F.broadcast(wanted), "row").select("cls", "text")
    else:
        texts = c.packed_texts(rows.select("row", "text")).join(wanted, "row").select("cls", "packed")
    out = texts.mapInArrow(partial(segment_rows, shared=shared, shingle=shingle, packed="packed" in texts.columns), "cls long, fragment int, shingles binary")
    return c.written(out, "segments")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, shared, shingle: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, n_a, n_b), those that are linked; shingles are gathered only for classes whose counts by cell allow it."""
    a = classes.select(F.col("cls").alias("a"), F.col("parts").alias("parts_a"))
    b = classes.select(F.col("cls").alias("b"), F.col("parts").alias("parts_b"))
    most = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    near = pairs.join(a, "a").join(b, "b").where(similar(most, F.col("n_a"), F.col("n_b"), percent))
    near = c.written(near.select("a", "b", "n_a", "n_b"), "near")
    segments = segments_of(near.select(F.explode(F.array("a", "b")).alias("cls")), rows, classes, shared, shingle)
    left = segments.select(F.col("cls").alias("a"), "fragment", F.col("shingles").alias("one"))
    right = segments.select(F.col("cls").alias("b"), "fragment", F.col("shingles").alias("two"))
    both = near.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "one", "two")
    overlap = both.mapInArrow(overlap_rows, "a long, b long, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    links = near.join(overlap, ["a", "b"]).where(similar(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    links = c.written(links, "links")
    c.deleted(segments)
    return links


def components(links: DataFrame) -> DataFrame:
    """(cls, component) of all linked classes: every class gets the smallest class that it is connected to.

    Classes are alternately hooked to the smallest neighbour of their larger and of their smaller neighbours, so a chain
    of any length shrinks in a logarithmic number of rounds. Each round is written, which ends its lineage.
    """
    edges = c.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        before = edges
        # Large star: from every class to each larger neighbour's new, smallest neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: among a class and its smaller neighbours, all go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = c.written(edges, "edges")
        if edges.exceptAll(before).isEmpty() and before.exceptAll(edges).isEmpty():
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("component"))


#: What tells the comparisons of two blocks of a list apart; within one, rows are in order of block and class.
GROUP = ["first", "last", "low", "high"]
PLACED = "first long, last long, low int, high int, block int, cls long, component long, n long"


def group_starts(table: pa.Table) -> np.ndarray:
    """At which rows a group begins."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in GROUP:
        key = table.column(name).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def whole_groups(batches):
    """Sorted batches of one partition to tables of whole groups; a group is kept back until its end is seen."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        at = int(group_starts(table)[-1]) if len(table) else 0
        if at:
            yield table.slice(0, at).combine_chunks()
        kept = table.slice(at)
    if kept is not None and len(kept):
        yield kept.combine_chunks()


def partners(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row, from which row on and up to which it is compared: with the later ones of one block, or with the other block."""
    begin = group_starts(table)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(table))))
    low, high, block = (table.column(k).to_numpy() for k in ("low", "high", "block"))
    to = np.append(begin[1:], len(table))[group]
    other = begin[group] + np.bincount(group, block == low)[group].astype(np.int64)
    return np.where(low == high, np.arange(len(table)) + 1, np.where(block == low, other, to)), to


def possible_rows(batches, percent):
    """Batches of placed classes and their bitmaps to those classes that have a possible link to another component in their group."""
    for table in whole_groups(batches):
        cls, component, n = (table.column(k).to_numpy() for k in ("cls", "component", "n"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(cls), -1)
        begin, to = partners(table)
        pairs = np.concatenate([[0], np.cumsum(to - begin)])
        found, at = np.zeros(len(cls), bool), 0
        while at < len(cls):
            end = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS, "right")) - 1)
            each = (to - begin)[at:end]
            i = np.repeat(np.arange(at, end), each)
            j = np.arange(len(i)) - np.repeat(pairs[at:end] - pairs[at], each) + begin[i]
            some = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[some], j[some]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            some = (100 + percent) * differ <= (100 - percent) * (n[i] + n[j])
            found[i[some]] = found[j[some]] = True
            at = end
        if found.any():
            yield from table.drop_columns("bits").filter(pa.array(found)).to_batches()


def linking_rows(batches, percent):
    """Batches of placed classes with their shingles by fragment to links between different components, a forest per group."""
    for table in whole_groups(batches):
        begin = group_starts(table)
        for at, to in zip(begin.tolist(), [*begin[1:].tolist(), len(table)], strict=True):
            edges = forest(table.slice(at, to - at), percent)
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def forest(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever the links between all classes of one group to be compared connect, and no more of them."""
    every = group.column("cls").to_numpy()
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    raw = [x or b"" for x in group.column("shingles").to_pylist()]
    size = np.add.reduceat(np.array([len(x) // 6 for x in raw]), first)
    wide = np.zeros((int(size.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    values, shingle = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    group = group.take(pa.array(first))
    cls, component, n = (group.column(k).to_numpy().copy() for k in ("cls", "component", "n"))
    mark, edges = np.zeros(len(values), np.int64), []
    for i, (begin, to) in enumerate(zip(*partners(group), strict=True)):
        j = np.arange(begin, to)
        j = j[(component[j] != component[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if not len(j):
            continue
        own = shingle[start[i]:start[i + 1]]
        mark[own] = 1
        ends = np.cumsum(size[j])
        place = np.arange(ends[-1]) + np.repeat(start[j] - (ends - size[j]), size[j])
        overlap = np.add.reduceat(mark[shingle[place]], ends - size[j])
        mark[own] = 0
        for k in j[100 * overlap >= percent * (n[i] + n[j] - overlap)]:
            if component[k] != component[i]:
                edges.append((min(int(cls[i]), int(cls[k])), max(int(cls[i]), int(cls[k]))))
                component[component == component[k]] = component[i]
    return edges


def grouped(df: DataFrame, *within: str) -> DataFrame:
    """Rows of a group together in one partition, in order."""
    return df.repartition(*GROUP).sortWithinPartitions(*GROUP, *within)


def across(lists: DataFrame, labels: DataFrame, rows: DataFrame, classes: DataFrame, shared, shingle: int, percent: int) -> DataFrame:
    """Links that join components: per list, without its leaders, which are done, all classes of different components are compared."""
    placed = lists.select("first", "last", "cls", "n")
    placed = placed.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    several = placed.groupBy("first", "last").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    placed = placed.join(several.where("low <> high").select("first", "last", "size"), ["first", "last"])
    blocks = F.when(F.col("size") <= SHORT_LIST, 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = placed.join(classes.select("cls", "bits"), "cls").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(9)), blocks).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("first", "last", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "cls", "component", "n", "bits")
    possible = c.written(grouped(placed, "block", "cls").mapInArrow(partial(possible_rows, percent=percent), PLACED), "open")
    segments = segments_of(possible.select("cls"), rows, classes, shared, shingle)
    whole = grouped(possible.join(segments, "cls"), "block", "cls", "fragment").select(*possible.columns, "shingles")
    links = c.written(whole.mapInArrow(partial(linking_rows, percent=percent), "a long, b long"), "links")
    c.deleted(segments)
    c.deleted(possible)
    return links


def numbered(documents: DataFrame) -> DataFrame:
    """Row number and all columns (``whole``), written once: every later job reads the numbers and none counts again."""
    whole = F.struct(*[F.col(f"`{x}`") for x in documents.columns]).alias("whole")
    return c.written(documents.select(F.monotonically_increasing_id().alias("row"), whole), "numbered", "zstd")


def joined(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``documents``: row, doc_id, n_shingles, cls (equal sets, equal class), component_id (smallest doc_id linked).

    Null and empty texts have no shingles, are linked with nothing and are their own component. Rows that repeat a doc_id and
    a text are one class; rows that repeat a doc_id with other texts keep their own sets. Texts of any length count whole;
    a null doc_id counts as larger than any; other columns are ignored. An empty table gives no rows.
    """
    return linked(numbered(documents.select("doc_id", "text")), shingle, percent)


def linked(table: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``joined`` of a ``numbered`` table."""
    spark = table.sparkSession
    rows = table.select("row", F.col("whole.doc_id").cast("long").alias("doc_id"), F.col("whole.text").cast("string").alias("text"))
    counts = sketch(rows, shingle)
    shared = spark.sparkContext.broadcast((counts, cuts_of(counts)))
    sets = c.written(rows.mapInArrow(partial(set_rows, shared=shared, shingle=shingle, percent=percent), SETS), "sets")
    some = sets.where("n > 0")
    classes = c.written(some.groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("parts").alias("parts"),
        F.first("bits").alias("bits"), F.first("head").alias("head")), "classes")
    postings = classes.select(F.explode("head").alias("token"), "cls")
    # Classes are hashes, so the least and the greatest of a list are any two; most lists of a group of near copies have the same.
    listed = postings.groupBy("token").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where("first <> last")
    # Most lists are their two leaders; only what a list has beside them has rows of its own, and sizes come to different lists.
    size = classes.select("cls", "n")
    leaders = listed.select("first", "last").distinct()
    for side in ("first", "last"):
        leaders = leaders.join(size.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}")), side)
    leaders = c.written(leaders, "leaders")
    lists = postings.join(listed, "token").where("cls <> first AND cls <> last").select("first", "last", "cls").distinct()
    lists = c.written(lists.join(leaders, ["first", "last"]).join(size, "cls"), "lists")
    both = F.explode(F.array(*[F.struct(F.col(x).alias("cls"), F.col(f"n_{x}").alias("n")) for x in ("first", "last")])).alias("leader")
    stars = lists.select("cls", "n", both).union(leaders.select("first", "n_first", F.struct(F.col("last").alias("cls"), F.col("n_last").alias("n"))))
    stars = stars.where(similar(F.least("n", "leader.n"), F.col("n"), F.col("leader.n"), percent))
    lower = F.col("cls") < F.col("leader.cls")
    stars = stars.select(F.least("cls", "leader.cls").alias("a"), F.greatest("cls", "leader.cls").alias("b"),
                         F.when(lower, F.col("n")).otherwise(F.col("leader.n")).alias("n_a"), F.when(lower, F.col("leader.n")).otherwise(F.col("n")).alias("n_b"))
    links = verified(c.written(stars.distinct(), "pairs"), rows, classes, shared, shingle, percent)
    labels = components(links)
    more = across(lists, labels, rows, classes, shared, shingle, percent)
    c.deleted(lists)
    c.deleted(leaders)
    if not more.isEmpty():
        labels = components(links.union(more))
    of_class = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest, "component").select("cls", "component", "component_id")
    out = sets.select("row", "doc_id", F.col("n").alias("n_shingles"), "cls").join(of_class, "cls", "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def representatives(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents``, all columns, that are their component's smallest doc_id; of a component's rows that repeat it, the first.

    Rows without shingles all stay, and so do unlinked texts that repeat a doc_id: components are told apart by their class.
    """
    table = numbered(documents)
    found = linked(table, shingle, percent)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("empty", F.when(F.col("n_shingles") == 0, F.col("row")))
    keep = keep.groupBy("component", "empty").agg(F.min("row").alias("row")).select("row")
    return table.join(keep, "row").select("whole.*")


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``joined``."""
    return df.select("doc_id", "n_shingles", "component_id")
