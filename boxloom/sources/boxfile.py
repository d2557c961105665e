"""The binary box file: a 128-byte header and six aligned arrays, as a data source `boxes` for reading and a writer."""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.boxes import BoxJoin, any_of, dimension, extent, nonempty, repeated_ids
from ..operators.prefix import ranked

#: Fixed values of the file format.
MAGIC, VERSION, LITTLE, HEADER_BYTES, ALIGN = b"ANCHORW\0", 1, 1, 128, 64
LAYOUT = struct.Struct("<8sHBBIIIQQQQQQQQQ32s")
ENDPOINT_CODES = {"float64": 1, "int64": 2}
#: Rows of a partition.
ROWS = 1 << 18


class FormatError(ValueError):
    """The file isn't a valid box file."""


def _aligned(n: int) -> int:
    return -(-n // ALIGN) * ALIGN


@dataclass(frozen=True)
class Header:
    """endpoint type, dimension, rows of each side, the places of the six arrays and the end, and the payload's SHA-256."""

    endpoint: str
    d: int
    n_r: int
    n_s: int
    places: tuple[int, ...]
    end: int
    sha256: bytes

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<f8" if self.endpoint == "float64" else "<i8")

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(8 * n * w for n in (self.n_r, self.n_s) for w in (1, self.d, self.d))

    @classmethod
    def of(cls, endpoint: str, d: int, n_r: int, n_s: int, sha256: bytes = bytes(32)) -> Header:
        places, end = [], HEADER_BYTES
        for n in (n_r, n_s):
            for width in (1, d, d):
                places.append(_aligned(end))
                end = places[-1] + 8 * n * width
        return cls(endpoint, d, n_r, n_s, tuple(places), end, sha256)

    def packed(self) -> bytes:
        return LAYOUT.pack(MAGIC, VERSION, LITTLE, ENDPOINT_CODES[self.endpoint], self.d, 0, HEADER_BYTES, self.n_r, self.n_s, *self.places, self.end, self.sha256)


def read_header(raw: bytes, size: int) -> Header:
    if len(raw) < HEADER_BYTES:
        raise FormatError("shorter than a header")
    magic, version, order, code, d, flags, header, n_r, n_s, *places, end, sha = LAYOUT.unpack(raw[:HEADER_BYTES])
    if (magic, version, order, header, flags) != (MAGIC, VERSION, LITTLE, HEADER_BYTES, 0) or code not in ENDPOINT_CODES.values() or not d:
        raise FormatError("not a box file of a known version")
    h = Header({v: k for k, v in ENDPOINT_CODES.items()}[code], d, n_r, n_s, tuple(places), end, sha)
    ends = [HEADER_BYTES, *(p + n for p, n in zip(places, h.sizes))]
    if any(p % ALIGN or p < e for p, e in zip(places, ends)) or ends[-1] != end or end != size:
        raise FormatError("arrays overlap or aren't aligned, or the file has another size")
    return h


def _array(f, place: int, dtype: np.dtype, first: int, rows: int, width: int) -> np.ndarray:
    f.seek(place + 8 * first * width)
    raw = f.read(8 * rows * width)
    if len(raw) != 8 * rows * width:
        raise FormatError("the file ends within an array")
    return np.frombuffer(raw, dtype).reshape(rows, width)


class _Rows(InputPartition):
    def __init__(self, side: int, first: int, rows: int):
        self.side, self.first, self.rows = side, first, rows


#: What a comparison of a column with a value leaves of a block whose least and greatest values are known.
_POSSIBLE = {
    EqualTo: lambda low, high, x: low <= x <= high,
    GreaterThan: lambda low, high, x: high > x,
    GreaterThanOrEqual: lambda low, high, x: high >= x,
    LessThan: lambda low, high, x: low < x,
    LessThanOrEqual: lambda low, high, x: low <= x,
}


class BoxFileReader(DataSourceReader):
    """A partition for each run of ROWS rows of a side: tasks read their own part of each array.

    The file's manifest may tell the least and greatest values of ranges of rows: runs that the comparisons in `pushed` rule
    out aren't read. Rows of unknown values are read.
    """

    def __init__(self, path: str, header: Header, sides: list[int], ranges: list[dict]):
        self.path, self.header, self.sides, self.ranges, self.pushed = path, header, sides, ranges, []

    def _fits(self, zone: dict) -> bool:
        return all(_POSSIBLE[type(f)](*zone[c], f.value) for f in self.pushed if (c := f.attribute[0]) in zone)

    def partitions(self) -> list[_Rows]:
        n = (self.header.n_r, self.header.n_s)
        known = {(x["side"], x["first"]): x for x in self.ranges}
        out = []
        for s in self.sides:
            at = 0
            while at < n[s]:
                own = known.get((s, at), {"rows": n[s] - at, "zone": {}})
                if self._fits(own["zone"]):
                    out += [_Rows(s, a, min(ROWS, at + own["rows"] - a)) for a in range(at, at + own["rows"], ROWS)]
                at += own["rows"]
        return out or [_Rows(0, 0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        h = self.header
        with open(self.path, "rb") as f:
            at = h.places[3 * part.side :][:3]
            ids = _array(f, at[0], np.dtype("<u8"), part.first, part.rows, 1)[:, 0]
            low, high = (_array(f, p, h.dtype, part.first, part.rows, h.d) for p in at[1:])
        if h.endpoint == "float64" and not (np.isfinite(low).all() and np.isfinite(high).all()):
            raise FormatError("an endpoint isn't finite")
        if not (low < high).all():
            raise FormatError("an empty box")
        if len(ids) and ids.max() >= 2**63:
            raise FormatError("ids of 2^63 and more have no bigint")
        columns = {"side": np.full(part.rows, part.side, np.int32), "id": ids.astype(np.int64)} | {f"l{j}": low[:, j] for j in range(h.d)} | {f"u{j}": high[:, j] for j in range(h.d)}
        yield pa.RecordBatch.from_pydict({k: pa.array(np.ascontiguousarray(v)) for k, v in columns.items()})


class PruningReader(BoxFileReader):
    """A reader that takes filters, which Spark allows where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _POSSIBLE and len(f.attribute) == 1 and f.value is not None:
                self.pushed.append(f)
            yield f  # Spark still applies it to rows


@dataclass
class _Written(WriterCommitMessage):
    """Ranges of rows that a task wrote: side, first place, rows, SHA-256 of their bytes in the three arrays, least and greatest values."""

    ranges: list[dict]


class BoxFileWriter(DataSourceArrowWriter):
    """Tasks write rows (side, place, id, l0.., u0..) at their places of a temporary file; the commit checks that each place was written and names it.

    A place is that of the same row at each attempt, so what a lost or repeated task wrote is written again as it was. The
    payload's SHA-256 goes over whole arrays by the definition of the format, so the commit reads the file once, in parts.
    """

    def __init__(self, path: str, endpoint: str, d: int, n: tuple[int, int], metadata: dict):
        self.path, self.header, self.metadata = path, Header.of(endpoint, d, *n), metadata
        self.temporary = f"{path}.tmp"
        with open(self.temporary, "wb") as f:
            f.truncate(self.header.end)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        h, out = self.header, []
        names = [[f"{e}{j}" for j in range(h.d)] for e in "lu"]
        with open(self.temporary, "r+b") as f:
            for batch in iterator:
                side, place = (batch.column(c).to_numpy() for c in ("side", "place"))
                ids = batch.column("id").to_numpy().astype("<u8")
                low, high = (np.stack([batch.column(c).to_numpy() for c in x], 1).astype(h.dtype) if batch.num_rows else np.zeros((0, h.d), h.dtype) for x in names)
                if not (low < high).all() or (h.endpoint == "float64" and not (np.isfinite(low).all() and np.isfinite(high).all())):
                    raise FormatError("files hold finite and non-empty boxes only")
                cuts = np.flatnonzero((side[1:] != side[:-1]) | (place[1:] != place[:-1] + 1)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                    if a == z:
                        continue
                    sha = hashlib.sha256()
                    for at, width, data in zip(h.places[3 * side[a] :], (1, h.d, h.d), (ids, low, high)):
                        raw = np.ascontiguousarray(data[a:z]).tobytes()
                        f.seek(at + 8 * int(place[a]) * width)
                        f.write(raw)
                        sha.update(raw)
                    columns = {"id": ids[a:z]} | {c: x[a:z, j] for x, cs in zip((low, high), names) for j, c in enumerate(cs)}
                    zone = {c: [x.min().item(), x.max().item()] for c, x in columns.items()}
                    out.append({"side": int(side[a]), "first": int(place[a]), "rows": z - a, "sha256": sha.hexdigest(), "zone": zone})
            f.flush()
            os.fsync(f.fileno())
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        ranges = sorted((x for m in messages if m for x in m.ranges), key=lambda x: (x["side"], x["first"]))
        h, n = self.header, [0, 0]
        for x in ranges:
            if x["first"] != n[x["side"]]:
                raise FormatError("places are missing or written twice")
            n[x["side"]] += x["rows"]
        if tuple(n) != (h.n_r, h.n_s):
            raise FormatError("places are missing")
        whole = Header.of(h.endpoint, h.d, h.n_r, h.n_s, payload_sha256(self.temporary, h))
        with open(self.temporary, "r+b") as f:
            f.write(whole.packed())
        manifest = manifest_of(whole) | {"metadata": self.metadata, "ranges": ranges}
        with open(f"{self.path}.manifest.json.tmp", "w", encoding="utf-8") as f:
            json.dump(manifest, f, sort_keys=True)
        os.replace(self.temporary, self.path)
        os.replace(f"{self.path}.manifest.json.tmp", f"{self.path}.manifest.json")

    def abort(self, messages: list[_Written | None]) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class BoxFileSource(DataSource):
    """spark.read.format("boxes").option("side", "r"|"s"|"both").load(path): side, id, l0.., u0..

    With the option prune = true, and spark.sql.python.filterPushdown.enabled, filters leave out rows by the manifest's ranges.
    placed(join).write.format("boxes") with the options path, endpoint, d, n_r and n_s writes a file, as save() does.
    """

    @classmethod
    def name(cls) -> str:
        return "boxes"

    def _header(self) -> Header:
        path = self.options["path"]
        with open(path, "rb") as f:
            return read_header(f.read(HEADER_BYTES), os.path.getsize(path))

    def schema(self) -> str:
        h = self._header()
        kind = "double" if h.endpoint == "float64" else "bigint"
        return ", ".join(["side int", "id bigint", *(f"{e}{j} {kind}" for e in "lu" for j in range(h.d))])

    def reader(self, schema: StructType) -> BoxFileReader:
        sides = {"r": [0], "s": [1], "both": [0, 1]}[self.options.get("side", "both")]
        path, ranges = self.options["path"], []
        if os.path.exists(f"{path}.manifest.json"):
            with open(f"{path}.manifest.json", encoding="utf-8") as f:
                told = json.load(f)
            ranges = told.get("ranges", []) if told.get("payload_sha256") == self._header().sha256.hex() else []
        return (PruningReader if self.options.get("prune") == "true" else BoxFileReader)(path, self._header(), sides, ranges)

    def writer(self, schema: StructType, overwrite: bool) -> BoxFileWriter:
        o = self.options
        return BoxFileWriter(o["path"], o["endpoint"], int(o["d"]), (int(o["n_r"]), int(o["n_s"])), json.loads(o.get("metadata", "{}")))


def payload_sha256(path: str, h: Header) -> bytes:
    """SHA-256 of the six arrays in order, without padding, read in parts."""
    sha = hashlib.sha256()
    with open(path, "rb") as f:
        for place, size in zip(h.places, h.sizes):
            f.seek(place)
            while size and (part := f.read(min(size, 4 << 20))):
                sha.update(part)
                size -= len(part)
    return sha.digest()


def check(path: str) -> Header:
    """The header, after payload hash and padding are checked."""
    with open(path, "rb") as f:
        h = read_header(f.read(HEADER_BYTES), os.path.getsize(path))
        for place, size, after in zip(h.places, h.sizes, (*h.places[1:], h.end)):
            f.seek(place + size)
            if any(f.read(after - place - size)):
                raise FormatError("padding isn't zero")
    if payload_sha256(path, h) != h.sha256:
        raise FormatError("the payload has another SHA-256")
    return h


def load(spark: SparkSession, path: str, verify: bool = True) -> BoxJoin:
    """Both sides of a box file; with `verify` its hash and padding, its manifest (if there is one) and that ids are unique are checked first."""
    spark.dataSource.register(BoxFileSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    side = lambda s: spark.read.format("boxes").option("side", s).option("prune", prune).load(path).drop("side")
    join = BoxJoin(side("r"), side("s"))
    if verify:
        match_manifest(path, check(path))
        if not all(repeated_ids(df).isEmpty() for df in (join.r, join.s)):
            raise FormatError("ids repeat within a side")
    return join


def match_manifest(path: str, h: Header) -> None:
    """Fails if path.manifest.json tells another type, dimension, size or hash than the file's header."""
    if os.path.exists(f"{path}.manifest.json"):
        with open(f"{path}.manifest.json", encoding="utf-8") as f:
            told = json.load(f)
        own = manifest_of(h)
        if any(told.get(k) != v for k, v in own.items()):
            raise FormatError("the manifest is of another file")


def manifest_of(h: Header) -> dict:
    return {"endpoint_type": h.endpoint, "dimension": h.d, "n_r": h.n_r, "n_s": h.n_s, "payload_sha256": h.sha256.hex()}


def placed(join: BoxJoin) -> DataFrame:
    """(side, place, id, l0.., u0..) of both sides, each in the order of id, dealt so that a task holds runs of neighbouring places."""
    ends = [f"{e}{j}" for e in "lu" for j in range(join.d)]
    sides = [ranked(df.select("id", *ends), ["id"], "place").select(F.lit(n).alias("side"), "place", "id", *ends) for n, df in enumerate((join.r, join.s))]
    return sides[0].unionAll(sides[1]).repartitionByRange("side", "place").sortWithinPartitions("side", "place")


def save(join: BoxJoin, path: str, metadata: dict | None = None) -> dict:
    """Writes a box file and its manifest (path.manifest.json) by tasks that share the path's folder."""
    spark = join.r.sparkSession
    if not all(repeated_ids(df).isEmpty() for df in (join.r, join.s)):
        raise FormatError("ids repeat within a side")
    infinite = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    double = dict(join.r.dtypes)["l0"] == "double"
    odd = ~nonempty(join.d) | any_of([infinite(F.col(f"{e}{j}")) if double else F.col(f"{e}{j}").isNull() for e in "lu" for j in range(join.d)])
    n = [df.agg(F.count("*"), F.count_if(F.coalesce(odd, F.lit(True)))).first() for df in (join.r, join.s)]
    if any(x[1] for x in n):
        raise FormatError("files hold finite and non-empty boxes only")
    spark.dataSource.register(BoxFileSource)
    options = {"path": os.path.abspath(path), "endpoint": "float64" if double else "int64", "d": join.d, "n_r": n[0][0], "n_s": n[1][0], "metadata": json.dumps(metadata or {})}
    placed(join).write.format("boxes").mode("append").options(**options).save()
    with open(f"{path}.manifest.json", encoding="utf-8") as f:
        return json.load(f)


def describe(join: BoxJoin) -> DataFrame:
    """Rows, dimension and extents of both sides."""
    return extent(join.r).select(F.lit("r").alias("side"), F.lit(dimension(join.r)).alias("d"), "*").unionAll(extent(join.s).select(F.lit("s"), F.lit(join.d), "*"))
