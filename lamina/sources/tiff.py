"""Multi-page TIFF volumes: a reader and a writer for baseline grey images (uncompressed or deflate, 8, 16 or 32 bits).

For Spark, volumes are a binaryFile table decoded by slices_of(), or the data source `volume` (register()). Writing is by
files(): each file is written whole under another name and then renamed, so a task that is repeated does no harm."""

from __future__ import annotations

import contextlib
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_FORMATS = {"u": 1, "i": 2, "f": 3}


def decode(data: bytes) -> np.ndarray:
    """Pages of a TIFF, of one shape, as an array."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(f"{order}H", data, 2)[0] == 43
    at = struct.unpack_from(f"{order}Q", data, 8)[0] if big else struct.unpack_from(f"{order}I", data, 4)[0]
    sizes = {1: "B", 3: "H", 4: "I", 16: "Q"}
    pages = []
    while at:
        n = struct.unpack_from(f"{order}{'Q' if big else 'H'}", data, at)[0]
        at += 8 if big else 2
        tags: dict[int, tuple] = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", data, at)
            count = struct.unpack_from(f"{order}{'Q' if big else 'I'}", data, at + 4)[0]
            if kind in sizes:
                form = f"{order}{count}{sizes[kind]}"
                place, room = at + (12 if big else 8), 8 if big else 4
                if struct.calcsize(form) > room:
                    place = struct.unpack_from(f"{order}{'Q' if big else 'I'}", data, place)[0]
                tags[tag] = struct.unpack_from(form, data, place)
            at += 20 if big else 12
        pages.append(_page(data, tags, order))
        at = struct.unpack_from(f"{order}{'Q' if big else 'I'}", data, at)[0]
    return np.stack(pages)


def _page(data: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    w, h = tags[256][0], tags[257][0]
    bits, form, packing, samples = tags.get(258, (8,))[0], tags.get(339, (1,))[0], tags.get(259, (1,))[0], tags.get(277, (1,))[0]
    if packing not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packing} is not supported")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
    page = np.frombuffer(raw, np.dtype(_KINDS[form, bits]).newbyteorder(order), h * w * samples)
    return page.reshape((h, w, samples) if samples > 1 else (h, w)).astype(_KINDS[form, bits])


def encode(vol: np.ndarray, compression: str = "zlib") -> bytes:
    """A big TIFF with one strip a page. A volume has two or three dimensions once those of length 1 are dropped."""
    vol = np.squeeze(vol)
    if vol.ndim not in (2, 3):
        raise ValueError(f"a volume must have 2 or 3 dimensions, not {vol.ndim}")
    vol = vol[None] if vol.ndim == 2 else vol
    vol = np.ascontiguousarray(vol, vol.dtype.newbyteorder("<"))
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    link = 8
    for page in vol:
        body = zlib.compress(page.tobytes(), 6) if compression == "zlib" else page.tobytes()
        strip = len(out)
        out += body + b"\0" * (-len(body) % 8)
        tags = [(256, page.shape[1]), (257, page.shape[0]), (258, vol.dtype.itemsize * 8), (259, 8 if compression == "zlib" else 1), (262, 1), (273, strip), (277, 1), (278, page.shape[0]), (279, len(body)), (339, _FORMATS[vol.dtype.kind])]
        struct.pack_into("<Q", out, link, len(out))
        out += struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, 1, v) for t, v in tags)
        link = len(out)
        out += struct.pack("<Q", 0)
    return bytes(out)


def oriented(a: np.ndarray) -> np.ndarray:
    """Slices first: a colour image is averaged, otherwise the shortest axis (the first of equals) is that of the slices."""
    if a.ndim == 4 and a.shape[0] == 1:
        a = a[0]
    if a.ndim == 2:
        return a[None].astype(np.float32)
    if a.shape[-1] in (3, 4):
        return (a[..., :3].mean(-1) if a.ndim == 4 else a[..., :3].mean(-1)[None]).astype(np.float32)
    a = np.moveaxis(a, int(np.argmin(a.shape)), 0)
    while a.ndim > 3:
        a = a[..., 0]
    return a.astype(np.float32)


def scaled(vol: np.ndarray) -> np.ndarray:
    """A volume scaled to 0..1; a constant one is 0."""
    lo, hi = float(vol.min(initial=np.inf)), float(vol.max(initial=-np.inf))
    return ((vol - lo) / (hi - lo)).astype(np.float32) if hi > lo else np.zeros_like(vol, np.float32)


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """The slices of several images, one after another, cut to the least height and width."""
    slices = [s for p in parts for s in (p if p.ndim == 3 else p[None])]
    h, w = min(s.shape[0] for s in slices), min(s.shape[1] for s in slices)
    return np.stack([s[:h, :w] for s in slices])


_BAD = (ValueError, KeyError, IndexError, OSError, struct.error, zlib.error)
_SLICES = "view_key string, z int, h int, w int, px binary, reason string"


def _as_rows(key: str, volume: Callable[[], np.ndarray]) -> pa.RecordBatch:
    try:
        vol = scaled(volume())
        rows = [[key] * len(vol), list(range(len(vol))), [vol.shape[1]] * len(vol), [vol.shape[2]] * len(vol), [s.tobytes() for s in vol], [""] * len(vol)]
    except _BAD as e:
        rows = [[key], [None], [None], [None], [None], [f"conversion_error:{type(e).__name__}:{e}"]]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=[f.split()[0] for f in _SLICES.split(", ")])


def slices_of(files: DataFrame, view: str = "path") -> DataFrame:
    """view_key, z, h, w, px, reason: the slices of each file of a binaryFile table (or any with path and content). A file that
    can't be read is a row with a reason and no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield _as_rows(key, lambda data=data: oriented(decode(data.as_py())))

    return files.select(view, "content").mapInArrow(run, _SLICES)


def slices_at(paths: DataFrame, view: str = "path") -> DataFrame:
    """slices_of() the volumes at these paths, which the executors open themselves: a file, or a folder whose images, in the order of their
    names, are one volume (those that can't be read are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key in b.column(0).to_pylist():
                yield _as_rows(key, lambda key=key: _opened(key))

    return paths.select(view).mapInArrow(run, _SLICES)


def _opened(path: str) -> np.ndarray:
    local = path.startswith(("file:", "/"))
    fs, at = (pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else pa.fs.FileSystem.from_uri(path)

    def read(name: str) -> np.ndarray:
        with fs.open_input_file(name) as f:
            return oriented(decode(f.read()))

    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(at)
    if info.type == pa.fs.FileType.File:
        return read(at)
    parts = []
    for x in sorted(fs.get_file_info(pa.fs.FileSelector(at)), key=lambda x: x.base_name):
        if x.type == pa.fs.FileType.File and x.base_name.lower().endswith((".tif", ".tiff")):
            with contextlib.suppress(*_BAD):
                parts.append(read(x.path))
    if not parts:
        raise ValueError("no image in the folder can be read")
    return stacked(parts)


def write_atomic(path: str, vol: np.ndarray, compression: str = "zlib", modified: float | None = None) -> None:
    """Writes a volume under its name only when it is whole, with the time of its source."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(encode(vol, compression))
    if modified is not None:
        os.utime(part, (modified, modified))
    os.replace(part, path)


def files(slices: DataFrame, folder: str, compression: str = "zlib") -> DataFrame:
    """Writes the slices of each view to folder/view_key (a relative path), which all executors must share; view_key, n_slices."""
    from ..operators.kernels import volume

    def run(key: tuple, table: pa.Table) -> pa.Table:
        vol = volume(table)
        write_atomic(os.path.join(folder, key[0].as_py()), vol, compression)
        return pa.table({"view_key": pa.array([key[0].as_py()]), "n_slices": pa.array([len(vol)], pa.int32())})

    return slices.select("view_key", "z", "h", "w", "px").groupBy("view_key").applyInArrow(run, "view_key string, n_slices int")


class VolumeSource(DataSource):
    """spark.read.format("volume").load(folder): path, z, h, w, px of all .tif and .tiff files under a folder."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "path string, z int, h int, w int, px binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _VolumeReader(self.options["path"])


class _VolumeReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        found = [os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names if n.lower().endswith((".tif", ".tiff"))]
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            vol = scaled(oriented(decode(f.read())))
        for z, s in enumerate(vol):
            yield partition.value, z, s.shape[0], s.shape[1], s.tobytes()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeSource)
