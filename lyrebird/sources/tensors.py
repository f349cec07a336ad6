"""Frame scores kept in tensor files: an 8-byte length, a JSON header of names, types, shapes and places, then raw numbers."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The format's names of types. Brain floats are the upper halves of floats.
TYPES = {
    "F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "?",
}


def tensors(raw: bytes) -> dict[str, np.ndarray]:
    """All tensors of a file by name."""
    (size,) = struct.unpack_from("<Q", raw)
    if 8 + size > len(raw):
        raise EOFError("the header is cut off")
    out, body = {}, memoryview(raw)[8 + size :]
    for name, entry in json.loads(raw[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        a, b = entry["data_offsets"]
        flat = np.frombuffer(body[a:b], TYPES[entry["dtype"]])
        if entry["dtype"] == "BF16":
            flat = (flat.astype("<u4") << 16).view("<f4")
        out[name] = flat.reshape(entry["shape"])
    return out


def to_bytes(named: dict[str, np.ndarray]) -> bytes:
    """Tensors as a file; types without a name in the format are an error."""
    names = {np.dtype(v): k for k, v in TYPES.items() if k != "BF16"}
    header, body = {}, b""
    for name, x in named.items():
        x = np.ascontiguousarray(x)
        header[name] = {
            "dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [len(body), len(body) + x.nbytes],
        }
        body += x.tobytes()
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + body


def scores(spark: SparkSession, path: str, scores_name: str = "logits", lengths_name: str = "lengths") -> DataFrame:
    """(file, place, scores, length): one row for each utterance of each file, its scores cut to its length. As many lengths
    as utterances and no length beyond the frames, or it is an error. A file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for file, content in zip(df["path"], df["content"]):
                named = tensors(content)
                if missing := {scores_name, lengths_name} - named.keys():
                    raise ValueError(f"{file} has no tensor {sorted(missing)}")
                x, n = named[scores_name].astype(np.float32), named[lengths_name].ravel().astype(np.int64)
                if len(x) != len(n):
                    raise ValueError(f"{file} holds {len(x)} utterances and {len(n)} lengths")
                if len(n) and n.max() > x.shape[1]:
                    raise ValueError(f"{file} has a length beyond its {x.shape[1]} frames")
                for i, k in enumerate(n.tolist()):
                    yield pd.DataFrame({"file": [file], "place": [i], "scores": [x[i, :k].tolist()], "length": [k]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
        run, "file string, place int, scores array<array<float>>, length int",
    )
