"""JSON arrays read in parallel: the objects of one long array come from many byte ranges of its file.

Spark's text reader cuts a file into byte ranges and its lines at any separator; here that is the closing
brace, so a range gives the fragments that begin in it, in order. What a fragment means depends on
whether the range began inside a string and how deep inside an object, which no range knows by itself:

1. A first pass tells for each range, from its own bytes, how it turns each possible beginning into its
   end: the parity of its quotes, and its braces outside strings for either parity. Windows over these
   few rows (one per range) give every range its true beginning.
2. A second pass walks the fragments with the beginning known and emits whole objects.
3. An object that crosses ranges leaves a part in each. Only ranges that begin inside an object, and
   those before them, are walked once more for the parts, which are put together by object.

No task reads more than its range, and nothing but one short row per such range is broadcast. Each object
is then parsed by the expression that reads JSON lines, with the same results. Only objects count:
other elements, and what stands between objects, are passed over. A file may also hold several arrays
or objects one after the other. Compressed files cannot be cut; each is one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealrank.session import materialize

CLOSE = "}"
ESCAPED = re.compile(r"\\.", re.DOTALL)
MARKS = re.compile(r'\\.|["{]', re.DOTALL)
KEYS = "file string, start long"
# Roles of a part, in the order in which the parts of one range come.
GOES_ON, ENDS, BEGINS = 0, 1, 2
# Objects are handed on in batches of about this many characters.
BATCH = 8 << 20


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: what lies between closing braces, with the byte range it begins in."""
    return spark.read.option("lineSep", CLOSE).text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value"
    )


def opened(fragment: str) -> tuple[int, int, int]:
    """Quotes of a fragment, and opening braces outside strings if it begins outside of one or inside."""
    if "\\" in fragment:
        fragment = ESCAPED.sub("", fragment)
    quotes = fragment.count('"')
    if "{" not in fragment:
        return quotes, 0, 0
    if quotes == 0:
        return 0, fragment.count("{"), 0
    parts = fragment.split('"')
    return quotes, sum(p.count("{") for p in parts[::2]), sum(p.count("{") for p in parts[1::2])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of a batch by byte range; a task may read several."""
    files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
    first = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or (files[i], starts[i]) != (files[first], starts[first]):
            yield files[first], starts[first], batch.slice(first, i - first)
            first = i


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range: parity of its quotes, and the change of depth if it begins outside a string or inside."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, start, rows in _runs(batch):
            inside = found.setdefault((file, start), [0, 0, 0])
            for value in rows.column("value").to_pylist():
                quotes, *braces = opened(value)
                for begin in (0, 1):
                    state = inside[0] ^ begin
                    inside[1 + begin] += braces[state] - (state ^ quotes & 1 == 0)
                inside[0] ^= quotes & 1
    keys, values = list(found), list(found.values())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([file for file, _ in keys], pa.string()),
            pa.array([start for _, start in keys], pa.int64()),
            *(pa.array([v[k] for v in values], pa.int64()) for k in range(3)),
        ],
        ["file", "start", "parity", "outside", "inside"],
    )


def beginnings(pieces: DataFrame) -> DataFrame:
    """``file, start, in_string, depth`` at the beginning of each byte range."""
    ranges = pieces.mapInArrow(summarise, f"{KEYS}, parity long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = F.pmod(F.coalesce(F.sum("parity").over(before), F.lit(0)), F.lit(2))
    known = ranges.withColumn("in_string", state)
    delta = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    known = known.withColumn("delta", delta)
    return known.select("file", "start", "in_string", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"))


class _Walk:
    """The state while the fragments of one byte range go by."""

    def __init__(self, in_string: int, depth: int):
        self.in_string, self.depth = in_string, depth
        self.open: list[str] = []
        self.role = GOES_ON if depth > 0 else BEGINS

    def step(self, value: str) -> str | None:
        """Take a fragment; the text that ends an object with it, if one ends."""
        quotes, *braces = opened(value)
        opens = braces[self.in_string]
        state = self.in_string ^ quotes & 1
        if self.depth == 0:
            if opens == 0:  # between objects
                self.in_string = state
                return None
            value = value[self._first(value, bool(self.in_string)):]
        self.depth += opens
        self.in_string = state
        self.open.append(value + CLOSE)
        if state:
            return None
        self.depth -= 1
        if self.depth:
            return None
        whole = "".join(self.open)
        self.open = []
        return whole

    @staticmethod
    def _first(value: str, inside: bool) -> int:
        """Where the first brace outside of strings stands; there is one."""
        for mark in MARKS.finditer(value):
            if mark[0] == '"':
                inside = not inside
            elif mark[0] == "{" and not inside:
                return mark.start()
        raise AssertionError("no brace outside of strings")


def _walk(parts: bool):
    """Walk ranges whose rows hold ``in_string`` and ``depth``: whole objects, or else the parts of those cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        walk, place = None, None

        def part(role: int, text: str) -> None:
            out.append((*place, role, text))

        def leave() -> None:
            if walk is not None and parts and walk.open:
                part(walk.role, "".join(walk.open))

        def batch_of() -> pa.RecordBatch:
            if parts:
                names = ["file", "start", "role", "text"]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
            else:
                names, kinds = ["text"], [pa.string()]
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for file, start, rows in _runs(batch):
                if (file, start) != place:
                    leave()
                    place = (file, start)
                    walk = _Walk(rows.column("in_string")[0].as_py(), rows.column("depth")[0].as_py())
                for value in rows.column("value").to_pylist():
                    whole = walk.step(value)
                    if whole is None:
                        continue
                    if walk.role == GOES_ON:
                        if parts:
                            part(ENDS, whole)
                        walk.role = BEGINS
                    elif not parts:
                        out.append((whole,))
                        size += len(whole)
                        if size >= BATCH:
                            yield batch_of()
                            out.clear()
                            size = 0
        leave()
        yield batch_of()

    return run


def _with_beginning(pieces: DataFrame, within: DataFrame) -> DataFrame:
    """The beginning of each fragment's range; rows keep their order, since only the small side moves."""
    joined = pieces.join(F.broadcast(within), ["file", "start"], "left")
    return joined.select(
        "file", "start", "value",
        F.coalesce("in_string", F.lit(0)).cast("int").alias("in_string"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
    )


def object_texts(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of each object of the arrays under ``path``."""
    pieces = fragments(spark, path)
    ranges = materialize(beginnings(pieces), "ranges")
    # Ranges that begin inside an object or a string: one row each, at most one per byte range.
    within = ranges.filter("in_string > 0 or depth > 0")
    whole = _with_beginning(pieces, within).mapInArrow(_walk(parts=False), "text string")
    if within.filter("depth > 0").isEmpty():
        return whole
    in_order = Window.partitionBy("file").orderBy("start")
    cut = ranges.withColumn("inside", F.col("depth") > 0).withColumn(
        "next", F.lead("inside").over(in_order)
    )
    wanted = F.broadcast(cut.filter("inside or next").select("file", "start"))
    # Every range is read again here, but only the wanted ones leave the scan.
    some = _with_beginning(pieces.join(wanted, ["file", "start"], "left_semi"), within)
    parts = some.mapInArrow(_walk(parts=True), f"{KEYS}, role int, text string")
    place = Window.partitionBy("file").orderBy("start", "role")
    numbered = parts.withColumn("object", F.sum((F.col("role") == BEGINS).cast("int")).over(place))
    ordered = F.array_sort(F.collect_list(F.struct("start", "role", "text")))
    joined = numbered.groupBy("file", "object").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))
    # An object without an end is that of a truncated file; it is parsed as a broken line is.
    return whole.unionByName(joined.select("text"))


def read_json_arrays(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The objects of JSON arrays as rows of ``schema`` (DDL or a type)."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return object_texts(spark, path).select(F.from_json("text", kind).alias("row")).select("row.*")
