"""Volumes in files: NIfTI and NRRD to voxel rows, voxel rows to NIfTI, headers of arrays.

Decoders take (path, content) rows, as Spark's binaryFile source gives them (files up to 2 GB), and
give one plane of voxels after the other.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..workers import on_workers

_VOXELS = "path string, z long, y long, x long, v double"

# Number types of the formats.
_NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_NRRD_TYPES = {"uchar": "u1", "uint8": "u1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")


def nifti_array(content: bytes) -> np.ndarray:
    """The first three axes of a NIfTI-1 volume, packed or not, under its scale."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    end = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if len(data) < 348 or struct.unpack(end + "i", data[:4])[0] != 348 or data[344:347] != b"n+1":
        raise ValueError("not a NIfTI-1 file of one part")
    axes = struct.unpack(end + "8h", data[40:56])
    code = struct.unpack(end + "h", data[70:72])[0]
    start, slope, shift = struct.unpack(end + "3f", data[108:120])
    if code not in _NIFTI_TYPES:
        raise ValueError(f"NIfTI number type {code}")
    shape = (*axes[1 : 1 + min(3, axes[0])], 1, 1)[:3]
    held = np.frombuffer(data, np.dtype(end + _NIFTI_TYPES[code]), int(np.prod(shape)), int(start)).reshape(shape, order="F")
    return held * float(slope) + float(shift) if slope and (slope, shift) != (1.0, 0.0) else held


def nrrd_array(content: bytes) -> np.ndarray:
    """The volume of an attached NRRD file, axes as its header lists them."""
    head, _, data = content.partition(b"\n\n")
    fields = dict(re.findall(r"^([^#:\n]+): *(.*?)\r?$", head.decode("ascii", "replace"), re.M))
    if not head.startswith(b"NRRD") or "data file" in fields or "datafile" in fields or fields.get("type") not in _NRRD_TYPES:
        raise ValueError("not an attached NRRD file of known numbers")
    coding = fields.get("encoding", "raw")
    if coding not in ("raw", "gzip", "gz"):
        raise ValueError(f"NRRD encoding {coding}")
    data = data if coding == "raw" else zlib.decompress(data, 31)
    shape = tuple(map(int, fields["sizes"].split()))
    kind = np.dtype((">" if fields.get("endian") == "big" else "<") + _NRRD_TYPES[fields["type"]])
    return np.frombuffer(data, kind, int(np.prod(shape))).reshape(shape, order="F")


def _planes(path: str, volume: np.ndarray) -> Iterator[pd.DataFrame]:
    y, x = (a.ravel() for a in np.indices(volume.shape[1:]))
    for z, plane in enumerate(volume):
        yield pd.DataFrame({"path": path, "z": z, "y": y, "x": x, "v": plane.ravel().astype(float)})


def nifti_voxels(df: DataFrame, reverse: bool = False) -> DataFrame:
    """(path, z, y, x, v) of each voxel; z is a file's third axis, y its first and x its second, reversed on request."""
    on_workers(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for path, content in zip(rows["path"], rows["content"]):
                volume = nifti_array(content).transpose(2, 0, 1)
                yield from _planes(path, volume[:, :, ::-1] if reverse else volume)

    return df.select("path", "content").mapInPandas(run, _VOXELS)


def nrrd_voxels(df: DataFrame, nothing: int = 1000) -> DataFrame:
    """(path, z, y, x, v) of each voxel, z the first axis; ``nothing`` counts as 0 and numbers are whole."""
    on_workers(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for path, content in zip(rows["path"], rows["content"]):
                yield from _planes(path, nrrd_array(content).astype(np.int32))

    return df.select("path", "content").mapInPandas(run, _VOXELS).withColumn("v", F.when(F.col("v") == nothing, 0.0).otherwise(F.col("v")))


def nifti_bytes(volume: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """A packed NIfTI-1 file of 32-bit floats; the affine is the identity unless given."""
    affine = np.eye(4) if affine is None else affine
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, volume.ndim, *volume.shape, *[1] * (7 - volume.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + volume.astype("<f4").tobytes(order="F"), 6, mtime=0)


def fused_name(map_type: str, brain: Column, channel: str | None = None, mark: str = ":") -> Column:
    """The file name of a brain's map.  Hadoop's listings can't read names with a colon: give another mark where Spark reads them again."""
    tail = f"_{channel}.nii.gz" if channel else ".nii.gz"
    return F.concat(F.lit(f"fused{mark}{map_type.replace(' ', '-')}_"), brain.cast("string"), F.lit(tail))


def nifti_files(df: DataFrame, name: str, shape: tuple[int, int, int], affine: np.ndarray | None = None) -> DataFrame:
    """(path, content): one file for each name, from rows (name, z, y, x, v) on a grid of ``shape``; a voxel outside is an error.

    A task holds one grid, whose size is fixed, and rows of distinct voxels of it.
    """
    on_workers(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows[["z", "y", "x"]].to_numpy(np.int64)
        if (at < 0).any() or (at >= shape).any():
            raise ValueError(f"a voxel of {rows[name].iloc[0]} lies outside {shape}")
        volume = np.zeros(shape, np.float32)
        volume[tuple(at.T)] = rows["v"]
        return pd.DataFrame({"path": [rows[name].iloc[0]], "content": [nifti_bytes(volume, affine)]})

    return df.select(name, "z", "y", "x", "v").groupBy(name).applyInPandas(run, "path string, content binary")


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def saved(df: DataFrame, folder: str) -> DataFrame:
    """(path, bytes) of files written below a folder that all executors share; each appears whole, also when a task is tried again."""
    on_workers(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        for rows in frames:
            for path, content in zip(rows["path"], rows["content"]):
                part = f"{root}/.{uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content)
                fs.move(part, f"{root}/{path}")
            yield pd.DataFrame({"path": [f"{folder}/{p}" for p in rows["path"]], "bytes": [len(c) for c in rows["content"]]})

    return df.select("path", "content").mapInPandas(run, "path string, bytes long")


def array_headers(paths: DataFrame) -> DataFrame:
    """(path, shape, start and end of z, y, x) of .npy files, from their first bytes and their names; what can't be read is null."""
    on_workers(paths.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            shapes, places = [], []
            for path in rows["path"]:
                shape = None
                try:
                    fs, at = _place(path)
                    with fs.open_input_stream(at) as f:
                        major = np.lib.format.read_magic(f)[0]
                        shape = list((np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)[0])
                except (ValueError, OSError):
                    pass  # the table says so with a null
                shapes.append(shape)
                numbers = re.fullmatch(r"(\d+(?:_\d+){5})\.\w+", path.rsplit("/", 1)[-1])
                places.append(list(map(int, numbers[1].split("_"))) if numbers else [0] * 6)
            yield pd.DataFrame({"path": rows["path"], "shape": shapes, "place": places})

    return paths.select("path").mapInPandas(run, "path string, shape array<long>, place array<long>")
