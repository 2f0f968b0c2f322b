"""The folded table: storage, quantisation, metadata.

A model directory holds ``model.json`` and ``table.parquet`` (bucket, values; bucket -1
is the bias, -2 the column scales). A table P has 2**log2_d + 1 rows (the last is padding,
all zero) and one column for each of the thirty languages.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from ..functions import hashing
from ..functions.langs import CODES

VERSION = 3
STORES = ("f16", *(f"{kind}-{scheme}" for kind in ("int8", "fp8") for scheme in ("row", "col")))
Scales = np.ndarray | None
_LIMIT = {"int8": 127.0, "fp8": 448.0}


class ModelError(ValueError):
    pass


class MetadataError(ModelError):
    pass


class ShapeMismatch(ModelError):
    pass


class MissingTensor(ModelError):
    pass


def e4m3_table() -> np.ndarray:
    """The 256 values of an 8-bit float with 4 exponent and 3 mantissa bits."""
    b = np.arange(256)
    e, m = (b >> 3) & 15, b & 7
    v = np.where(e == 0, m * 2.0**-9, (1 + m / 8) * 2.0 ** (e - 7.0))
    v = np.where((b & 127) == 127, np.nan, v)
    return np.where(b > 127, -v, v).astype(np.float32)


def e4m3_to_f32(bits) -> np.ndarray:
    return e4m3_table()[np.asarray(bits, np.uint8)]


def f32_to_e4m3(x: np.ndarray) -> np.ndarray:
    """Nearest representable value, ties to the even mantissa."""
    positive = e4m3_table()[:127].astype(np.float64)
    a = np.abs(np.asarray(x, np.float64))
    hi = np.clip(np.searchsorted(positive, a), 1, 126)
    lo = hi - 1
    up, down = positive[hi] - a, a - positive[lo]
    pick = np.where((up < down) | ((up == down) & (hi % 2 == 0)), hi, lo)
    return (pick | np.where(np.signbit(x), 128, 0)).astype(np.uint8)


def f16_to_f32(bits) -> np.ndarray:
    return np.asarray(bits, np.uint16).view(np.float16).astype(np.float32)


def parse_store(spec: str) -> tuple[str, str | None]:
    """'int8-row' -> ('int8', 'row')."""
    if spec not in STORES:
        raise ModelError(f"unknown store {spec!r}; known: {', '.join(STORES)}")
    kind, _, scheme = spec.partition("-")
    return kind, scheme or None


def quantize(p: np.ndarray, kind: str, scheme: str | None) -> tuple[np.ndarray, Scales]:
    """(stored values, scales); symmetric, one scale for each row or column."""
    p = np.asarray(p, np.float32)
    if kind == "f16":
        return p.astype(np.float16), None
    if kind not in _LIMIT or scheme not in ("row", "col"):
        raise ModelError(f"unknown quantisation {kind}-{scheme}")
    top = _LIMIT[kind]
    s = np.abs(p).max(axis=1 if scheme == "row" else 0) / np.float32(top)
    s = np.where(s == 0, np.float32(1), s).astype(np.float32)
    x = p / (s[:, None] if scheme == "row" else s[None, :])
    x = np.clip(x, -top, top)
    return (np.rint(x).astype(np.int8) if kind == "int8" else f32_to_e4m3(x)), s


def dequantize(stored: np.ndarray, scales: Scales, kind: str, scheme: str | None) -> np.ndarray:
    if kind == "f16":
        return stored.astype(np.float32)
    x = e4m3_to_f32(stored) if kind == "fp8" else stored.astype(np.float32)
    return x * (scales[:, None] if scheme == "row" else scales[None, :])


def damage(p: np.ndarray, stored: np.ndarray, scales: Scales, kind: str, scheme: str | None) -> dict:
    """What quantisation costs: largest and mean error, share of zeros, bytes."""
    err = np.abs(dequantize(stored, scales, kind, scheme) - np.asarray(p, np.float32))
    return {"max_error": float(err.max()), "mean_error": float(err.mean()), "zero_share": float((stored == 0).mean()), "bytes": int(stored.nbytes + (0 if scales is None else scales.nbytes)), "f16_bytes": int(2 * np.asarray(p).size)}


@dataclass
class Model:
    p: np.ndarray
    bias: np.ndarray
    log2_d: int
    theta: float = 0.5
    hash: str = "fmix32"
    seed: int = hashing.SEED
    n_min: int = 1
    n_max: int = 5
    languages: list[str] = field(default_factory=lambda: list(CODES))

    def __post_init__(self):
        want = ((1 << self.log2_d) + 1, len(self.languages))
        if self.p.shape != want:
            raise ShapeMismatch(f"table {self.p.shape}; expected {want}")
        if self.bias.shape != (want[1],):
            raise ShapeMismatch(f"bias {self.bias.shape}; expected ({want[1]},)")
        self.p = np.array(self.p, np.float32)
        self.p[-1] = 0  # padding
        self.bias = np.asarray(self.bias, np.float32)

    @property
    def num_buckets(self) -> int:
        return 1 << self.log2_d

    @property
    def pad_index(self) -> int:
        return 1 << self.log2_d

    def doubled(self) -> np.ndarray:
        """P over -P: a signed bucket is a row."""
        return np.concatenate([self.p, -self.p])


def check_metadata(meta: dict) -> dict:
    """The metadata, if they are those of a model that this code can run."""
    for key, want in (("version", VERSION), ("languages", CODES), ("canonicalize", True), ("lexical", True)):
        if meta.get(key) != want:
            raise MetadataError(f"{key} is {meta.get(key)!r}; expected {want!r}")
    if meta.get("hash") not in hashing.HASHES:
        raise MetadataError(f"unknown hash {meta.get('hash')!r}")
    if not (isinstance(meta.get("log2_d"), int) and 0 < meta["log2_d"] < 32):
        raise MetadataError(f"log2_d is {meta.get('log2_d')!r}")
    if not 1 <= meta.get("n_min", 0) <= meta.get("n_max", 0) <= 5:
        raise MetadataError("n_min and n_max must be within 1..5")
    q = meta.get("quant")
    if q is not None and (q.get("dtype"), q.get("scheme")) not in {("int8", "row"), ("int8", "col"), ("fp8", "row"), ("fp8", "col")}:
        raise MetadataError(f"unknown quantisation {q!r}")
    return meta


def save(model: Model, path: str, store: str = "f16") -> dict:
    """Write a model directory; returns what quantisation cost."""
    kind, scheme = parse_store(store)
    stored, scales = quantize(model.p, kind, scheme)
    os.makedirs(path, exist_ok=True)
    meta = {"format": "tonguemill-table", "version": VERSION, "languages": model.languages, "log2_d": model.log2_d, "hash": model.hash, "seed": model.seed, "n_min": model.n_min, "n_max": model.n_max, "canonicalize": True, "lexical": True, "theta": model.theta}
    if scheme:
        meta["quant"] = {"dtype": kind, "scheme": scheme}
    raw = [r.tobytes() for r in stored]
    extra = {-1: model.bias.tobytes()}
    if scales is not None:
        extra[-2] = scales.tobytes()
    pq.write_table(pa.table({"bucket": pa.array([*range(len(raw)), *extra], pa.int32()), "values": pa.array([*raw, *extra.values()], pa.binary())}), os.path.join(path, "table.parquet"), compression="zstd")
    with open(os.path.join(path, "model.json"), "w", encoding="utf-8") as f:
        json.dump(meta, f, ensure_ascii=False)
    return damage(model.p, stored, scales, kind, scheme)


def read_metadata(path: str) -> dict:
    with open(os.path.join(path, "model.json"), encoding="utf-8") as f:
        return check_metadata(json.load(f))


def load(path: str) -> Model:
    """Read a model directory; the table comes back as 32-bit floats."""
    meta = read_metadata(path)
    t = pq.read_table(os.path.join(path, "table.parquet"))
    rows = dict(zip(t.column("bucket").to_pylist(), t.column("values").to_pylist()))
    q = meta.get("quant")
    kind, scheme = (q["dtype"], q["scheme"]) if q else ("f16", None)
    dtype = {"f16": np.float16, "int8": np.int8, "fp8": np.uint8}[kind]
    n = (1 << meta["log2_d"]) + 1
    if -1 not in rows or any(i not in rows for i in range(n)):
        raise MissingTensor("the table or its bias is incomplete")
    if scheme and -2 not in rows:
        raise MissingTensor("the scales are missing")
    stored = np.stack([np.frombuffer(rows[i], dtype) for i in range(n)])
    scales = np.frombuffer(rows[-2], np.float32) if scheme else None
    return Model(dequantize(stored, scales, kind, scheme), np.frombuffer(rows[-1], np.float32), meta["log2_d"], meta["theta"], meta["hash"], meta["seed"], meta["n_min"], meta["n_max"])


def convert(src: str, dst: str, store: str) -> dict:
    """Rewrite a model directory in another store."""
    return save(load(src), dst, store)


def parse_hub_ref(ref: str) -> tuple[str, str | None] | None:
    """'hf:owner/repo[/variant]' -> (owner/repo, variant); None if it isn't one."""
    if not ref.startswith("hf:"):
        return None
    parts = ref[3:].split("/")
    if len(parts) not in (2, 3) or not all(parts):
        return None
    return "/".join(parts[:2]), parts[2] if len(parts) == 3 else None
