"""Large JSON arrays, read by all tasks: the array that a file is, or one of an object around it.

The text source cuts a file at its closing braces, and splits it into byte ranges on any file system. Whether
a brace, a comma or a quote counts depends on what stands before it, so the file is read in passes:

1. each byte range is summed up under both assumptions about its start (inside a string or not):
   quotes modulo two, change of depth, and how many commas and ends of objects it has at each depth
   relative to its start. From these few numbers for each range the driver settles what state each starts in;
2. of a file that holds an object, what stands outside of its members' values is gathered, which tells
   the member that is the list, and where in the file it is;
3. each range cuts its text after every object that ends at the depth of the elements. It knows how many
   elements came before, so positions are gapless. What a range boundary cuts in two is put together
   again by a small shuffle, in which only the text at range boundaries takes part.

Backslashes occur only inside of strings, and a range starts behind a brace, which cannot be escaped;
so no escape crosses a boundary. Only one chunk of text is parsed at a time, by the JSON functions
of Spark; whatever they refuse fails the job with the file and the position of the element. What stands
outside of a wrapped list is parsed by the driver; if it is more than OUTSIDE bytes, the file is not read here.
"""

from __future__ import annotations

import itertools
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes from which on the arrays of an input are cut up.
LARGE = 32 << 20
#: Bytes outside of a wrapped list that the driver may be given.
OUTSIDE = 1 << 20
BLANK = b" \t\n\r"
SUMMARY = "file string, start long, inside int, lead string, size long, bytes long, quotes long, depth long, kind string, level long, n long"
OUTER = "file string, start long, outer string, events string, commas long, ends long"
PIECE = "file string, key long, start long, pos long, whole boolean, first boolean, last boolean, chunk string"
_OPEN, _CLOSE = (np.isin(np.arange(256), [ord(c) for c in cs]) for cs in ("{[", "}]"))
#: Endings of compressed files, which cannot be split.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
#: What a list is found under, in this order.
MEMBERS = ("documents", "results")
_MARK = _OPEN | _CLOSE | (np.arange(256) == ord(","))


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Files of an input and their bytes; contents are not read."""
    return {r.path: r.length for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()}


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """The text of each byte range between closing braces, in order; the brace is put back. size: of the file."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), F.concat("value", F.lit("}")).alias("text"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[np.ndarray]]]:
    """File, start, the file's size and the bytes of each byte range of a task, in parts that end with a fragment."""

    def runs():
        for batch in batches:
            names, start = batch.column("file").to_pylist(), batch.column("start").to_pylist()
            lo = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or start[i] != start[lo] or names[i] != names[lo]:
                    yield names[lo], start[lo], batch.column("size")[lo].as_py(), _bytes(batch.column("text").slice(lo, i - lo))
                    lo = i

    for (name, start, size), own in itertools.groupby(runs(), key=lambda r: r[:3]):
        yield name, start, size, (r[3] for r in own)


def _open_ended(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The parts without the very last brace, which the last fragment of a file has not."""
    before = next(parts)
    for part in parts:
        yield before
        before = part
    yield before[:-1]


def _bytes(texts: pa.Array) -> np.ndarray:
    column = texts.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, their bytes, and quotes before each modulo two; the number of all quotes."""
    quotes = np.flatnonzero(data == ord('"'))
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):  # of each run, every other one escapes what follows it
        begins = np.concatenate([[True], np.diff(slashes) != 1])
        nth = np.arange(len(slashes)) - np.maximum.accumulate(np.where(begins, np.arange(len(slashes)), 0))
        quotes = np.setdiff1d(quotes, slashes[nth % 2 == 0] + 1, assume_unique=True)
    at = np.flatnonzero(_MARK[data])
    return at, data[at], np.searchsorted(quotes, at) % 2, len(quotes)


class Scan:
    """State within a range: inside a string or not, and depth."""

    def __init__(self, inside: int, depth: int = 0):
        self.inside, self.depth = inside, depth

    def outside(self, at, what, before, quotes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the marks of a part those outside of strings, and the depth after each."""
        real = before == self.inside  # as many quotes modulo two close a string that is open
        at, what = at[real], what[real]
        depth = self.depth + np.cumsum(_OPEN[what].astype(np.int64) - _CLOSE[what])
        self.inside = (self.inside + quotes) % 2
        if len(depth):
            self.depth = int(depth[-1])
        return at, what, depth


def _sum_up(batches):
    for file, start, whole, parts in _ranges(batches):
        scans, lead, quotes, size = [Scan(0), Scan(1)], None, 0, 0
        found: list[dict] = [defaultdict(int), defaultdict(int)]
        for data in _open_ended(parts):
            if lead is None and (text := data[:4096].tobytes().lstrip(BLANK) or data.tobytes().lstrip(BLANK)):
                lead = chr(text[0])
            marks = _marks(data)
            quotes, size = quotes + marks[3], size + len(data)
            for scan, counts in zip(scans, found, strict=True):
                _, what, depth = scan.outside(*marks)
                for kind in ",}":
                    for level, n in zip(*np.unique(depth[what == ord(kind)], return_counts=True), strict=True):
                        counts[kind, int(level)] += int(n)
        rows = [
            {"file": file, "start": start, "inside": inside, "lead": lead if start == 0 else None, "size": whole, "bytes": size, "quotes": quotes, "depth": scan.depth, "kind": kind, "level": level, "n": n}
            for inside, (scan, counts) in enumerate(zip(scans, found, strict=True))
            for (kind, level), n in (counts or {(None, 0): 0}).items()
        ]
        yield pa.RecordBatch.from_pylist(rows, _schema(SUMMARY))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _summaries(spark: SparkSession, path: str) -> DataFrame:
    return _fragments(spark, path).mapInArrow(_sum_up, SUMMARY)


@dataclass(frozen=True)
class State:
    """How a byte range begins: inside a string or not, depth, place in the file; whether it is the last one, and ends without a brace.

    base is the depth of the elements, lo and hi are the places of the brackets around them (none where a file is
    the list), commas and ends how many there are at that depth in the list before the range.
    """

    inside: int
    depth: int
    at: int
    last: bool
    base: int
    commas: int = 0
    ends: int = 0
    lo: int = -1
    hi: int = 1 << 62


def settled(rows: list) -> dict[tuple[str, int], State]:
    """The state of each (file, start). rows: those of _summaries, a few for each byte range. A file that does not end as it should fails."""
    by: dict = defaultdict(lambda: defaultdict(dict))
    size = {r.file: r.size for r in rows}
    base = {r.file: 2 if r.lead == "{" else 1 for r in rows if r.start == 0}
    for r in rows:
        own = by[r.file][r.start].setdefault(r.inside, {"bytes": r.bytes, "quotes": r.quotes, "depth": r.depth, "n": {}})
        own["n"][r.kind, r.level] = r.n
    out = {}
    for file, ranges in by.items():
        # what follows the last brace is a fragment too, unless the file ends there; a mark of the byte order is not counted
        missing = size[file] - sum(x[0]["bytes"] + 1 for x in ranges.values()) + 1
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"MALFORMED text in {file}: {missing} of its bytes were not read")
        now = State(0, 0, 0, False, base[file])
        for start in sorted(ranges):
            last = start == max(ranges) and missing in (0, 3)
            out[file, start] = replace(now, last=last)
            own = ranges[start][now.inside]
            inside, depth = (now.inside + own["quotes"]) % 2, now.depth + own["depth"]
            brace = not last and not inside  # the brace that the range ends with
            commas = now.commas + own["n"].get((",", now.base - now.depth), 0)
            ends = now.ends + own["n"].get(("}", now.base - now.depth), 0) + (brace and depth - 1 == now.base)
            now = replace(now, inside=inside, depth=depth - brace, at=now.at + own["bytes"] + (not last), commas=commas, ends=ends)
        if now.inside or now.depth:
            raise ValueError(f"MALFORMED JSON in {file}: it ends " + ("inside of a string" if now.inside else f"at depth {now.depth}"))
    return out


def _outside(states: dict[tuple[str, int], State]):
    """What each range has outside of members' values, and the places where values of depth two open and close."""

    def gather(batches):
        for file, start, _, parts in _ranges(batches):
            own = states[file, start]
            scan, pieces, events, commas, ends, place = Scan(own.inside, own.depth), [], [], 0, 0, own.at
            for data in _open_ended(parts) if own.last else parts:
                before = scan.depth
                at, what, level = scan.outside(*_marks(data))
                edges = np.append(at, len(data))
                if before < 2:
                    pieces.append(data[: edges[0]].tobytes().decode("utf-8", "replace"))
                count = lambda kind, n: int(((what[:n] == ord(kind)) & (level[:n] == 2)).sum())  # noqa: E731, B023
                for i in np.flatnonzero((level < 2) | ((level == 2) & _OPEN[what])).tolist():
                    text = data[edges[i] : edges[i + 1]].tobytes()
                    opens = bool(_OPEN[what[i]]) and level[i] == 2
                    if opens or (_CLOSE[what[i]] and level[i] == 1):
                        events.append([place + int(at[i]), commas + count(",", i), ends + count("}", i)])
                    if not opens:
                        pieces.append(text.decode("utf-8", "replace"))
                    elif i + 1 < len(at) and level[i + 1] == 1 and not text[1:].strip(BLANK):
                        pieces.append(chr(text[0]))  # empty
                    else:
                        pieces.append(chr(text[0]) + ('"@": ' if text[:1] == b"{" else "") + str(place + int(at[i])))
                commas, ends, place = commas + count(",", len(at)), ends + count("}", len(at)), place + len(data)
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "outer": "".join(pieces), "events": json.dumps(events), "commas": commas, "ends": ends}], _schema(OUTER))

    return gather


def wrapped(rows: list, states: dict[tuple[str, int], State]) -> dict[tuple[str, int], State] | None:
    """States of a file that holds an object, bound to the list in it; None if none of its members is a list that is not empty.

    rows: those of _outside, one for each byte range of the file.
    """
    rows = sorted(rows, key=lambda r: r.start)
    try:
        outer = json.loads("".join(r.outer for r in rows))
    except ValueError as e:
        raise ValueError(f"MALFORMED JSON in {rows[0].file}: {e}") from e
    value = next((outer[m] for m in MEMBERS if outer.get(m)), None)
    if not isinstance(value, list) or len(value) != 1:
        return None
    lo, events, before = value[0], [], {}
    commas = ends = 0
    for r in rows:
        before[r.start] = commas, ends
        events += [(at, commas + c, ends + e) for at, c, e in json.loads(r.events)]
        commas, ends = commas + r.commas, ends + r.ends
    k = next(i for i, e in enumerate(events) if e[0] == lo)
    (_, commas, ends), hi = events[k], events[k + 1][0]
    file = rows[0].file
    return {(file, s): replace(states[file, s], lo=lo, hi=hi, commas=max(0, c - commas), ends=max(0, e - ends)) for s, (c, e) in before.items()}


def _cutting(states: dict[tuple[str, int], State]):
    def cut(batches):
        for file, start, _, parts in _ranges(batches):
            own = states[file, start]
            scan, kept, key, commas, place = Scan(own.inside, own.depth), b"", own.ends, own.commas, own.at
            # whether a chunk starts where the range does, or at the bracket that it holds
            fresh = (own.depth == own.base and not own.inside) or own.at <= max(own.lo, 0)
            pos = commas + (key > 0)

            def pieces(keys, places, starts, closed, last, texts, *, file=file, start=start):
                n = len(texts)
                own = [[file] * n, keys, [start] * n, [p if s else None for p, s in zip(places, starts, strict=True)], [s and closed for s in starts], [k == 0 for k in keys], [last] * n, [t.decode("utf-8", "replace") for t in texts]]
                return pa.record_batch([pa.array(c, f.type) for c, f in zip(own, _schema(PIECE), strict=True)], schema=_schema(PIECE))

            ended = False
            for data in _open_ended(parts) if own.last else parts:
                at, what, level = scan.outside(*_marks(data))
                first, end = max(0, own.lo - place), min(len(data), own.hi + 1 - place)
                ended = own.last if own.lo < 0 else own.hi < place + len(data)
                if first < end:
                    mine = (at >= first) & (at < end)
                    cuts = at[mine & (what == ord("}")) & (level == own.base)] + 1
                    places = at[mine & (what == ord(",")) & (level == own.base)]
                    if len(cuts):
                        edges = [first, *cuts.tolist()]
                        texts = [data[a:b].tobytes() for a, b in itertools.pairwise(edges)]
                        texts[0] = kept + texts[0]
                        after = (commas + 1 + np.searchsorted(places, cuts)).tolist()
                        n = len(texts)
                        yield pieces(list(range(key, key + n)), [pos, *after[:-1]], [fresh] + [True] * (n - 1), True, False, texts)
                        key, pos, fresh, kept = key + n, after[-1], True, data[edges[-1] : end].tobytes()
                    else:
                        kept += data[first:end].tobytes()
                    commas += len(places)
                place += len(data)
            if kept:
                yield pieces([key], [pos], [fresh], ended, ended, [kept])

    return cut


def _body(chunk: Column, first: Column, last: Column) -> Column:
    """The elements of a chunk as an array; what stands between chunks must be one comma."""
    blank = F.lit(BLANK.decode())
    text = F.btrim(chunk, blank)
    inner = F.when(F.startswith(text, F.lit(",")), F.concat(F.lit("["), F.substr(text, F.lit(2)), F.lit("]")))
    # at an end of the array there is a bracket; after a comma there must be an element
    lead = F.when(first, "[").when(text == "]", "").otherwise(",")
    rest = F.when(F.startswith(text, lead), F.substr(text, F.length(lead) + 1))
    rest = F.when(last, F.when(F.endswith(rest, F.lit("]")), F.regexp_replace(rest, r"\]\z", ""))).otherwise(rest)
    edge = F.when((lead == ",") & (F.btrim(rest, blank) == ""), F.lit("[,]")).otherwise(F.concat(F.lit("["), rest, F.lit("]")))
    return F.when(first | last, edge).otherwise(inner)


def _chunks(spark: SparkSession, path: str, states: dict) -> DataFrame:
    pieces = _fragments(spark, path).mapInArrow(_cutting(states), PIECE)
    whole = pieces.where("whole").select("file", "pos", "first", "last", "chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk"))), lambda p: p.chunk), "")
    cut = pieces.where("NOT whole").groupBy("file", "key").agg(F.max("pos").alias("pos"), F.first("first").alias("first"), F.bool_or("last").alias("last"), text.alias("chunk"))
    both = whole.unionByName(cut.select(*whole.columns))
    return both.select("file", "pos", _body(F.col("chunk"), F.col("first"), F.col("last")).alias("chunk"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """file, pos and chunk: pos is the place, in its file, of the first of the elements in chunk, a JSON array of one element or a few.

    None unless every file is a list, or an object with a list that is not empty.
    """
    found = _summaries(spark, path).collect()
    leads = {r.file: r.lead for r in found if r.start == 0 and r.inside == 0}
    if not set(leads.values()) <= {"[", "{"} or any(f.endswith(PACKED) for f in leads):
        return None
    states = settled(found)
    if "{" in leads.values():
        rows = _fragments(spark, path).where(F.col("file").isin([f for f, lead in leads.items() if lead == "{"])).mapInArrow(_outside(states), OUTER)
        held = rows.agg(F.sum(F.length("outer") + F.length("events"))).first()[0]
        if held > OUTSIDE:
            return None
        by = defaultdict(list)
        for r in rows.collect():
            by[r.file].append(r)
        for own in by.values():
            if (bound := wrapped(own, states)) is None:
                return None
            states |= bound
    return _chunks(spark, path, states)


def elements(chunks: DataFrame, parsed: Column) -> DataFrame:
    """pos (gapless, over all files in the order of their names) and doc of the elements of chunks; parsed: the array in chunk, or null."""
    where = F.concat(F.lit("MALFORMED JSON in "), F.col("file"), F.lit(" at element "), F.col("pos").cast("string"))
    failed = F.when(F.raise_error(where).isNotNull(), parsed)
    docs = chunks.withColumn("docs", parsed).withColumn("docs", F.when(F.col("docs").isNull(), failed).otherwise(F.col("docs")))
    # an outer generator, as Spark would test the array before the rows are sorted out that it is for
    each = docs.select("file", "pos", F.posexplode_outer("docs").alias("nth", "doc")).where("nth IS NOT NULL").withColumn("pos", F.col("pos") + F.col("nth"))
    counts = docs.groupBy("file").agg(F.sum(F.size("docs")).alias("n")) if len(chunks.inputFiles()) > 1 else None
    if counts is None:
        return each.select("pos", "doc")
    before, starts = 0, []
    for r in sorted(counts.collect()):  # the driver sees one number of each file
        starts.append((r.file, before))
        before += r.n
    starts_of = chunks.sparkSession.createDataFrame(starts, "file string, before long")
    return each.join(F.broadcast(starts_of), "file").select((F.col("pos") + F.col("before")).alias("pos"), "doc")


def read_array(spark: SparkSession, path: str) -> DataFrame | None:
    """pos and doc (VARIANT) of the elements of the list in each file; None where read_chunks has none."""
    chunks = read_chunks(spark, path)
    return None if chunks is None else elements(chunks, F.try_parse_json("chunk").try_cast("array<variant>"))
