"""Model files and array input: ONNX graphs, safetensors, npz, sparse triples, typed views, gathers.

Files are read with Spark's binaryFile source, so any path that Spark reads will do; only model files, never data, come
to the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tensor import Program

#: Element kinds by the array interface's names, and the Spark type that holds each.
KINDS = {"f8": "double", "f4": "float", "f2": "float", "i8": "bigint", "i4": "int", "u4": "bigint", "u2": "int", "u1": "smallint", "i1": "tinyint"}


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return bytes(rows[0]["content"])


# --- arrays ------------------------------------------------------------------------------------------------------------


def array_frame(spark: SparkSession, a: np.ndarray, kind: str | None = None) -> DataFrame:
    """(row, x): a dense array of one to many axes, row by row, in the narrowest Spark type that holds its kind."""
    a = np.asarray(a)
    kind = kind or f"{a.dtype.kind}{a.dtype.itemsize}"
    if kind not in KINDS:
        raise ValueError(f"no element kind {kind}")
    flat = a.reshape(len(a), -1)
    wide = {"f2": np.float32, "u4": np.int64, "u2": np.int32, "u1": np.int16}.get(kind, a.dtype)
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * flat.shape[1], pa.int32()), pa.array(np.ascontiguousarray(flat).ravel().astype(wide)))
    return spark.createDataFrame(pa.table({"row": pa.array(np.arange(len(a), dtype=np.int64)), "x": values}))


def view(df: DataFrame, column: str) -> dict:
    """Name, element type, rows, width and whether every row has it: what admits a column as a matrix."""
    kind = df.schema[column].dataType.simpleString()
    if not kind.startswith("array<"):
        raise ValueError(f"{column} is {kind}, not an array")
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi"), F.sum(F.col(column).isNull().cast("long")).alias("nulls"), F.sum(F.exists(column, lambda v: v.isNull()).cast("long")).alias("holes")).first()
    return {"name": column, "element": kind[6:-1], "rows": r["rows"], "width": r["hi"] or 0, "regular": bool(r["rows"] == 0 or (r["lo"] == r["hi"] and not r["nulls"] and not r["holes"]))}


def numbers_with_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number columns as doubles whose nulls are NaN; booleans become 0 and 1."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if t != "boolean" else F.col(c).cast("int").cast("double"), F.lit(float("nan"))) for c, t in df.dtypes if c in columns})


def to_triples(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, col, val) of the non-zero entries of an array column."""
    return df.select(F.col(row).alias("row"), F.posexplode(column).alias("col", "val")).where("val <> 0")


def from_triples(df: DataFrame, width: int, out: str = "x") -> DataFrame:
    """(row, array) from triples; repeated places add up, missing ones are 0."""
    summed = df.groupBy("row", "col").agg(F.sum("val").alias("val"))
    held = summed.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), F.col("val").cast("double")))).alias("m"))
    return held.select("row", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias(out))


def from_csr(spark: SparkSession, indptr, indices, data) -> DataFrame:
    """(row, col, val) of a compressed sparse row matrix."""
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return spark.createDataFrame(pa.table({"row": pa.array(rows.astype(np.int64)), "col": pa.array(np.asarray(indices, np.int64)), "val": pa.array(np.asarray(data, float))}))


def take(values: DataFrame, key: str, index: DataFrame, position: str) -> DataFrame:
    """index's rows with the values at their positions; positions that do not occur get nulls."""
    v = values.withColumnRenamed(key, "_mr_key")
    return index.join(v, F.col(position) == F.col("_mr_key"), "left").drop("_mr_key")


def scatter(rows: DataFrame, key: str, updates: DataFrame, position: str, column: str) -> DataFrame:
    """rows with the column replaced where updates have their position; the last of repeated ones by value wins."""
    u = updates.groupBy(F.col(position).alias("_mr_p")).agg(F.max(F.struct(F.col(column).alias("v"))).alias("_mr_v"))
    return rows.join(u, F.col(key) == F.col("_mr_p"), "left").withColumn(column, F.when(F.col("_mr_p").isNotNull(), F.col("_mr_v.v")).otherwise(F.col(column))).drop("_mr_p", "_mr_v")


# --- files of arrays -----------------------------------------------------------------------------------------------------


def read_npz(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(read_bytes(spark, path))) as z:
        return {n[:-4]: np.lib.format.read_array(io.BytesIO(z.read(n)), allow_pickle=False) for n in sorted(z.namelist()) if n.endswith(".npy")}


def write_npz(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Uncompressed, members sorted, stamped 1980: equal arrays give equal files. The path is the driver's own."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for n in sorted(arrays):
            held = io.BytesIO()
            np.lib.format.write_array(held, np.ascontiguousarray(arrays[n]), allow_pickle=False)
            z.writestr(zipfile.ZipInfo(f"{n}.npy", (1980, 1, 1, 0, 0, 0)), held.getvalue())


#: Element kinds of safetensors headers.
SAFE = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


class SafetensorsFile:
    """Tensors of one file or of the shards that an index names; float16 widens exactly, bfloat16 widens or stays bits."""

    def __init__(self, spark: SparkSession, path: str):
        data = read_bytes(spark, path)
        self.parts: dict[str, tuple[bytes, dict]] = {}
        if path.endswith(".json"):
            folder = path.rsplit("/", 1)[0]
            shards: dict[str, tuple[bytes, dict]] = {}
            for name, shard in json.loads(data)["weight_map"].items():
                if shard not in shards:
                    raw = read_bytes(spark, f"{folder}/{shard}")
                    shards[shard] = (raw, self._header(raw))
                self.parts[name] = shards[shard]
        else:
            head = self._header(data)
            self.parts = {n: (data, head) for n in head if n != "__metadata__"}

    @staticmethod
    def _header(data: bytes) -> dict:
        n = struct.unpack("<Q", data[:8])[0]
        if n > len(data) - 8:
            raise ValueError("the header is longer than the file")
        return json.loads(data[8 : 8 + n])

    def names(self) -> list[str]:
        return sorted(self.parts)

    def read(self, name: str, bf16: str = "widen") -> np.ndarray:
        data, head = self.parts[name]
        n, t = struct.unpack("<Q", data[:8])[0], head[name]
        a, b = t["data_offsets"]
        raw = data[8 + n + a : 8 + n + b]
        if t["dtype"] == "BF16":
            bits = np.frombuffer(raw, "<u2")
            return bits.reshape(t["shape"]) if bf16 == "keep" else (bits.astype(np.uint32) << 16).view(np.float32).reshape(t["shape"])
        if t["dtype"] not in SAFE:
            raise ValueError(f"no element kind {t['dtype']}")
        out = np.frombuffer(raw, SAFE[t["dtype"]]).reshape(t["shape"])
        return out.astype(np.float32) if t["dtype"] == "F16" else out


def write_safetensors(tensors: dict[str, np.ndarray]) -> bytes:
    kinds = {np.dtype(v).str.lstrip("<|"): k for k, v in SAFE.items()}
    head, body = {}, b""
    for n in sorted(tensors):
        a = np.ascontiguousarray(tensors[n])
        head[n] = {"dtype": kinds[a.dtype.str.lstrip("<|")], "shape": list(a.shape), "data_offsets": [len(body), len(body) + a.nbytes]}
        body += a.tobytes()
    raw = json.dumps(head).encode()
    return struct.pack("<Q", len(raw)) + raw + body


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the model files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, digests: dict[str, str]) -> list[str]:
    """Names of expected files that are missing or differ."""
    found = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in catalog(spark, path).collect()}
    return sorted(n for n, d in digests.items() if found.get(n) != d)


# --- ONNX ------------------------------------------------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def message(data: bytes) -> dict[int, list]:
    """Fields of a protocol buffer: numbers and byte strings by field number, in order."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        field, wire = tag >> 3, tag & 7
        if wire == 0:
            v, at = _varint(data, at)
        elif wire == 1:
            v, at = data[at : at + 8], at + 8
        elif wire == 2:
            n, at = _varint(data, at)
            v, at = data[at : at + n], at + n
        elif wire == 5:
            v, at = data[at : at + 4], at + 4
        else:
            raise ValueError("not a protocol buffer")
        out.setdefault(field, []).append(v)
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _ints(values: list) -> list[int]:
    out = []
    for v in values:
        if isinstance(v, bytes):
            at = 0
            while at < len(v):
                n, at = _varint(v, at)
                out.append(_signed(n))
        else:
            out.append(_signed(v))
    return out


def _floats(values: list) -> list[float]:
    return np.frombuffer(b"".join(values), "<f4").tolist()


#: Element kinds of ONNX tensors.
ONNX_KINDS = {1: "<f4", 2: "u1", 3: "i1", 6: "<i4", 7: "<i8", 9: "?", 10: "<f2", 11: "<f8"}


def _tensor(data: bytes) -> tuple[str, np.ndarray]:
    m = message(data)
    shape, kind = _ints(m.get(1, [])), m.get(2, [1])[0]
    if kind not in ONNX_KINDS:
        raise ValueError(f"no element kind {kind}")
    if 9 in m:
        a = np.frombuffer(m[9][0], ONNX_KINDS[kind])
    elif kind == 1:
        a = np.array(_floats(m.get(4, [])), np.float32)
    elif kind == 11:
        a = np.frombuffer(b"".join(m.get(10, [])), "<f8")
    else:
        a = np.array(_ints(m.get(7 if kind == 7 else 5, [])))
    return m.get(8, [b""])[0].decode(), a.reshape(shape).astype(float)


def _attribute(data: bytes):
    m = message(data)
    kind, name = m.get(20, [0])[0], m[1][0].decode()
    if kind == 1:
        return name, struct.unpack("<f", m[2][0])[0]
    if kind == 2:
        return name, _signed(m[3][0])
    if kind == 3:
        return name, m[4][0].decode()
    if kind == 4:
        return name, _tensor(m[5][0])[1]
    if kind == 6:
        return name, _floats(m.get(7, []))
    if kind == 7:
        return name, _ints(m.get(8, []))
    raise ValueError(f"attribute {name} has kind {kind}")


def onnx_program(data: bytes) -> Program:
    """The graph of an ONNX model whose inputs have a leading batch axis; rows take that axis's place.

    Axes that count the batch axis are shifted; operators that are not known are refused by name.
    """
    graph = message(message(data)[7][0])
    consts = dict(_tensor(t) for t in graph.get(5, []))
    inputs = {}
    for v in graph.get(11, []):
        m = message(v)
        name = m[1][0].decode()
        if name in consts:
            continue
        kind = message(message(message(m[2][0])[1][0])[2][0])  # tensor type: element kind and shape
        dims = [message(d).get(1, [None])[0] for d in kind.get(1, [])]
        if any(d is None for d in dims[1:]):
            raise ValueError(f"{name} has an open axis besides the batch")
        inputs[name] = tuple(int(d) for d in dims[1:])
    steps = []
    for n in graph.get(1, []):
        m = message(n)
        op = m[4][0].decode()
        attrs = dict(_attribute(a) for a in m.get(5, []))
        ins, outs = [v.decode() for v in m.get(1, [])], [v.decode() for v in m.get(2, [])]
        if op == "Constant":
            consts[outs[0]] = np.asarray(attrs.get("value", attrs.get("value_float", attrs.get("value_int", attrs.get("value_ints", attrs.get("value_floats"))))), float)
            continue
        rowed = not ins or ins[0] not in consts
        shift = lambda a: a - 1 if a > 0 else a
        if rowed and op in ("Softmax", "LogSoftmax", "ArgMax", "Concat", "Flatten", "Split", "Gather", "CumSum"):
            base = {"Softmax": -1, "LogSoftmax": -1, "Flatten": 1}.get(op, 0)
            axis = attrs.get("axis", base)
            if axis == 0 and op != "Flatten":
                raise ValueError(f"{op} over the batch axis")
            attrs["axis"] = shift(axis)
        if rowed and "axes" in attrs:
            attrs["axes"] = [shift(a) for a in attrs["axes"]]
        if rowed and "perm" in attrs:
            if attrs["perm"][0] != 0:
                raise ValueError("Transpose moves the batch axis")
            attrs["perm"] = [p - 1 for p in attrs["perm"][1:]]
        if rowed and op == "Reshape" and ins[1] in consts:
            consts[f"{ins[1]}/rows"] = consts[ins[1]].ravel()[1:]
            ins[1] = f"{ins[1]}/rows"
        if rowed and op in ("Squeeze", "Unsqueeze", "ReduceSum", "ReduceMean", "ReduceMax", "ReduceMin", "ReduceL2") and len(ins) > 1 and ins[1] in consts:
            attrs["axes"] = [shift(int(a)) for a in consts[ins[1]].ravel()]
            ins = ins[:1]
        if rowed and op == "Slice" and len(ins) > 3 and ins[3] in consts:
            attrs |= {"starts": consts[ins[1]].ravel().tolist(), "ends": consts[ins[2]].ravel().tolist(), "axes": [shift(int(a)) for a in consts[ins[3]].ravel()]}
            ins = ins[:1]
        if op == "Flatten" and rowed:
            attrs["axis"] = max(0, attrs["axis"])
        if op == "Cast":
            attrs["to"] = {1: "float32", 10: "float32", 11: "double", 9: "bool", 6: "int", 7: "int"}.get(attrs["to"], "double")
        steps.append((op, ins, outs[:1] if op not in ("Split",) else outs, {k: v for k, v in attrs.items() if k not in ("training_mode", "momentum", "spatial", "allowzero", "ceil_mode", "dilations", "kernel_shape" if op == "Conv" else "", "stash_type")}))
    return Program(steps, consts, inputs, message(graph[12][0])[1][0].decode())


def read_onnx(spark: SparkSession, path: str) -> Program:
    return onnx_program(read_bytes(spark, path))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
