"""CSV text over many tasks: quoted line breaks are settled by a prefix scan over the splits of a file.

A line that begins inside or outside a quoted cell ends inside or outside one: a function of two states. Composed over the lines of
a split it is two small numbers; composed over the splits of a file it tells each split how it begins. Files without quoted line
breaks go to Spark's own reader, line by line; the others are cut into records in the tasks, and the few records that cross a
split are put together by a grouping of at most two pieces a split.
"""

import csv
import io
from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPTIONS = {"quote": '"', "escape": '"'}
#: Bits of ``row_order`` for the place in a file: files of up to 8 TB, a million of them.
PLACE_BITS = 43
SUMMARY = "file string, block long, header string, const int, swap int, breaks boolean"
RECORD = "file string, block long, id long, piece int, text string"
WHOLE, TAIL, HEAD, INNER = range(4)


def fixed_splits(spark: SparkSession) -> SparkSession:
    """A session whose scans cut files at multiples of ``spark.sql.files.maxPartitionBytes``, whatever else is read and however many cores live."""
    own = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def ends_quoted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line, 1 if it ends inside a quoted cell, else 0: where it begins outside one, and where it begins inside.

    Outside, only a quote at the begin of a cell opens; other quotes of an unquoted cell are text. Inside, doubled quotes are text.
    So a run of an even number of quotes changes nothing, an odd one swaps the states at the begin of a cell and leaves the
    outside one elsewhere.
    """
    _, ends, raw = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out, inn = np.zeros(len(texts), np.int32), np.ones(len(texts), np.int32)
    quote = np.flatnonzero(data[offsets[0]:offsets[-1]] == 34) + offsets[0]
    if not len(quote):
        return out, inn
    line = np.searchsorted(offsets, quote, "right") - 1
    first = np.flatnonzero(np.append(True, (quote[1:] != quote[:-1] + 1) | (line[1:] != line[:-1])))
    odd = first[np.diff(np.append(first, len(quote))) % 2 == 1]
    at, line = quote[odd], line[odd]
    opens = (at == offsets[line]) | (data[at - 1] == 44)
    own, begin, size = np.unique(line, return_index=True, return_counts=True)
    last = begin + size - 1
    swaps = np.cumsum(opens)
    leaves = np.maximum.accumulate(np.where(opens, -1, np.arange(len(at))))[last] if len(at) else last
    fixed = leaves >= begin
    swapped = (swaps[last] - np.where(fixed, swaps[leaves], swaps[begin] - opens[begin])) % 2
    out[own], inn[own] = swapped, np.where(fixed, swapped, 1 - swapped)
    return out, inn


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with file, begin of their split and a number that grows within it."""
    text = fixed_splits(spark).read.option("lineSep", "\n").text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("text"))


def runs_of(batch: pa.RecordBatch):
    """Begin and end of each stretch of one split in a batch, with its file and block."""
    if not batch.num_rows:
        return
    file = batch.column(0).dictionary_encode()
    code, block = file.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
    for at, to in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
        yield at, to, file.dictionary[int(code[at])].as_py(), int(block[at])


def states(out: np.ndarray, inn: np.ndarray, begin: int) -> np.ndarray:
    """State after each line, from the state before the first."""
    swaps = np.cumsum((out == 1) & (inn == 0)) % 2
    last = np.maximum.accumulate(np.where(out == inn, np.arange(len(out)), -1))
    return np.where(last >= 0, out[last] ^ swaps[last], begin) ^ swaps


def summaries(batches):
    """A row per split: its header if it begins a file, its function of the state, and whether a line opens a cell it does not close."""
    now, row, head = None, None, []

    def made():
        text = "\n".join(head).rstrip("\r") if head else None
        return pa.RecordBatch.from_pylist([row | {"header": text}], schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("header", pa.string()), ("const", pa.int32()), ("swap", pa.int32()), ("breaks", pa.bool_())]))

    for batch in batches:
        out_all, inn_all = ends_quoted(batch.column(3))
        for at, to, file, block in runs_of(batch):
            if (file, block) != now:
                if row:
                    yield made()
                now, row, head, searching = (file, block), {"file": file, "block": block, "const": -1, "swap": 0, "breaks": False}, [], block == 0
            out, inn = out_all[at:to], inn_all[at:to]
            if searching:
                for i in range(at, to):
                    text = batch.column(3)[i].as_py()
                    if head or text.strip("\ufeff \t\r"):
                        quoted = inn_all[i] if head else out_all[i]
                        head.append(text)
                        if not quoted:
                            searching = False
                            break
            fixed = np.flatnonzero(out == inn)
            swap = (out == 1) & (inn == 0)
            if len(fixed):
                row["const"], row["swap"] = int(out[fixed[-1]]), int(swap[fixed[-1]:].sum() % 2)
            else:
                row["swap"] ^= int(swap.sum() % 2)
            row["breaks"] |= bool((out == 1).any())
    if row:
        yield made()


def survey(spark: SparkSession, paths: list[str]) -> dict[str, dict]:
    """Header of each file and, where cells hold line breaks, the state at the end of its splits: one scan, one row a split to the driver.

    A file that holds no record is missing from the result.
    """
    # A line without a quote leaves the state as it is.
    found = lines(spark, paths).where((F.col("block") == 0) | F.col("text").contains('"'))
    files: dict[str, dict] = {}
    for r in sorted(found.mapInArrow(summaries, SUMMARY).collect(), key=lambda r: (r["file"], r["block"])):
        own = files.setdefault(r["file"], {"header": None, "breaks": False, "blocks": [], "after": [], "state": 0})
        if r["block"] == 0:
            own["header"] = r["header"]
        own["state"] = (own["state"] if r["const"] < 0 else r["const"]) ^ r["swap"]
        own["breaks"] |= r["breaks"]
        own["blocks"].append(r["block"])
        own["after"].append(own["state"])
    return {file: own for file, own in files.items() if own["header"] is not None}


def header_names(header: str) -> list[str]:
    """Column names of a header record; blank ones and repeats get their position."""
    cells = next(csv.reader(io.StringIO(header.lstrip("\ufeff"), newline="")))
    seen, out = {"row_order", "source_file", "source_name"}, []
    lowered = [c.lower() for c in cells]
    for i, c in enumerate(cells):
        name = f"_c{i}" if not c.strip() else f"{c}{i}" if lowered.count(c.lower()) > 1 else c
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def records(batches, begins):
    """Lines of split files to records: whole ones, and the pieces of those that cross the end of a split; the header and blank lines go."""
    blocks_of = begins.value
    now, state, open_at, parts, header, kind = None, 0, None, [], False, TAIL

    def piece(what, at, text):
        file, block = now
        return pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([what], pa.int32()), pa.array([text])],
            names=["file", "block", "id", "piece", "text"])

    for batch in batches:
        ids = batch.column(2).to_numpy(zero_copy_only=False)
        out_all, inn_all = ends_quoted(batch.column(3))
        for at, to, file, block in runs_of(batch):
            if (file, block) != now:
                if parts and not (header and kind == TAIL):
                    yield piece(kind, open_at, "\n".join(parts))
                now, parts, header = (file, block), [], block == 0
                blocks, after = blocks_of[file]
                k = bisect_left(blocks, block)
                state = after[k - 1] if k else 0
                kind = INNER if state else TAIL
            end = states(out_all[at:to], inn_all[at:to], state)
            begin = np.append(state, end[:-1])
            state = int(end[-1])
            texts = batch.column(3).slice(at, to - at)
            closed = np.flatnonzero(end == 0)
            done = 0
            if begin[0]:  # the record before goes on
                if not parts:
                    open_at = int(ids[at])
                done = int(closed[0]) + 1 if len(closed) else len(end)
                parts += texts.slice(0, done).to_pylist()
                if not len(closed):
                    continue
                if header and kind == TAIL:
                    header = False
                else:
                    yield piece(WHOLE if kind == TAIL else HEAD, open_at, "\n".join(parts).removesuffix("\r"))
                parts, kind = [], TAIL
            stop = int(closed[-1]) + 1 if len(closed) else 0
            starts = np.flatnonzero(begin[done:stop] == 0) + done
            if len(starts):
                sizes = np.diff(np.append(starts, stop))
                if header:
                    for i in range(len(starts)):
                        if sizes[i] > 1 or texts[int(starts[i])].as_py().strip("\ufeff \t\r"):
                            header = False
                            starts, sizes = np.delete(starts, i), np.delete(sizes, i)
                            break
                yield whole_records(batch.slice(at, to - at), starts, sizes)
            if stop < len(end) and stop >= done:
                open_at, kind, parts = int(ids[at + stop]), TAIL, texts.slice(stop).to_pylist()
    if parts and not (header and kind == TAIL):
        yield piece(kind, open_at, "\n".join(parts))


def whole_records(lines: pa.RecordBatch, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """One row per record of ``sizes`` lines from ``starts``; the lines of a record are joined for all records at once."""
    chosen = lines.take(pa.array(starts))
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), lines.column(3).take(pa.array(place)))
    text = pc.binary_join(each, "\n")
    if (sizes > 1).any() and pc.any(pc.ends_with(text, "\r")).as_py():
        text = pc.if_else(pa.array(sizes > 1), pc.replace_substring_regex(text, r"\r\z", ""), text)
    return pa.RecordBatch.from_arrays(
        [chosen.column(0), chosen.column(1), chosen.column(2), pa.array(np.full(len(starts), WHOLE, np.int32)), text], names=["file", "block", "id", "piece", "text"])


def broken_records(spark: SparkSession, paths: list[str], surveyed: dict[str, dict]) -> DataFrame:
    """One text per record of files whose cells hold line breaks."""
    begins = spark.sparkContext.broadcast({file: (own["blocks"], own["after"]) for file, own in surveyed.items()})  # two numbers a split
    found = lines(spark, paths).mapInArrow(partial(records, begins=begins), RECORD)
    whole = found.where(F.col("piece") == WHOLE).drop("piece")
    if not any(1 in own["after"] for own in surveyed.values()):
        return whole
    place = W.partitionBy("file").orderBy("block", "id")
    # Pieces before the first begin belong to a header longer than a split.
    joined = (found.where(F.col("piece") != WHOLE).withColumn("nth", F.count_if(F.col("piece") == TAIL).over(place)).where("nth > 0")
              .groupBy("file", "nth").agg(F.min_by("block", F.struct("block", "id")).alias("block"), F.min_by("id", F.struct("block", "id")).alias("id"),
                                          F.array_sort(F.collect_list(F.struct("block", "id", "text"))).alias("parts")))
    return whole.unionByName(joined.select("file", "block", "id", F.array_join("parts.text", "\n").alias("text")))


def read_records(spark: SparkSession, paths: dict[str, str], names: list[str], surveyed: dict[str, dict]) -> DataFrame:
    """Rows of files with one header, all strings, with ``source_file`` and ``row_order`` (file, then place in it).

    ``paths`` gives the path to open for each file of ``surveyed``; files are numbered in the order of their names.
    """
    # Columns are read under their positions, so no name of a header can clash with another or with a keyword.
    columns = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in columns)
    plain = [f for f in paths if not surveyed[f]["breaks"]]
    broken = [f for f in paths if surveyed[f]["breaks"]]
    parts = []
    if plain:
        rows = fixed_splits(spark).read.schema(schema).options(header=True, enforceSchema=True, **OPTIONS).csv([paths[f] for f in plain])
        parts.append(rows.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                 F.monotonically_increasing_id().alias("id")))
    if broken:
        rows = broken_records(spark, [paths[f] for f in broken], {f: surveyed[f] for f in broken}).withColumn(
            "text", F.when(F.col("text").contains("\r"), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))).where(F.trim("text") != "")
        cells = F.from_csv("text", schema, {**OPTIONS, "multiLine": "true"})
        parts.append(rows.select(cells.alias("cells"), "file", "block", "id").select("cells.*", "file", "block", "id"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    numbered = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(surveyed))], "file string, nth long")
    # A line number within a task is below the bytes it reads, so it never reaches the next split.
    place = F.col("block") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(numbered), "file").select(  # a row per file of the listing
        *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col("file").alias("source_file"),
        (F.shiftleft("nth", PLACE_BITS) + place).alias("row_order"))
