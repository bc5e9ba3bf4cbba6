"""Encoder inference in NumPy inside ``mapInPandas``.

Two families: a pre-norm encoder with absolute or relative positions, and one
with rotary positions, gated layers and sliding attention.  Weights are a dict
of arrays from a file or seeded at random; they travel with the task's closure.
Training has no place in a query engine and is not offered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.embed import cross_entropy


@dataclass(frozen=True)
class EncoderConfig:
    """Sizes and choices of an encoder; unknown poolings and heads raise."""

    vocab_size: int = 4101
    hidden_size: int = 384
    layers: int = 6
    heads: int = 6
    intermediate_size: int = 2048
    max_positions: int = 1024
    positions: str = "absolute"  # absolute, relative_key, relative_key_query, rotary
    norm: str = "layer"  # layer, rms
    gated: bool = False
    window: int | None = None  # sliding attention on all layers but each third
    theta_global: float = 160_000.0
    theta_local: float = 10_000.0
    pooling: str = "attention"  # cls, mean, attention
    head: str = "linear"  # linear, mlp, curricular
    labels: int = 2
    margin: float = 0.5
    scale: float = 64.0
    projection: int | None = None  # size of the vectors a curricular head compares, if not the hidden size
    head_size: int | None = None  # inner size of the mlp head: half the hidden size
    least_temperature: float = 0.1  # bounds of the attention pooling's temperature
    most_temperature: float = 10.0
    norm_epsilon: float = 1e-12

    def __post_init__(self) -> None:
        if self.pooling not in ("cls", "mean", "attention"):
            raise ValueError(f"The pooling is cls, mean or attention, not {self.pooling}")
        if self.head not in ("linear", "mlp", "curricular"):
            raise ValueError(f"The head is linear, mlp or curricular, not {self.head}")
        if self.hidden_size % self.heads:
            raise ValueError("The heads must divide the hidden size")


def rotary_config(**changes: Any) -> EncoderConfig:
    """The second family: rotary positions, RMS norm, gated layers, a window of 256."""
    return replace(EncoderConfig(positions="rotary", norm="rms", gated=True, window=256), **changes)


def random_weights(c: EncoderConfig, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h, m = c.hidden_size, c.intermediate_size
    w = lambda *shape: (rng.standard_normal(shape) * 0.02).astype(np.float32)
    zero, one = (lambda *shape: np.zeros(shape, np.float32)), (lambda *shape: np.ones(shape, np.float32))
    linear = lambda name, a, b: {name: w(a, b), f"{name}.bias": zero(b)}
    norm = lambda name: {f"{name}.scale": one(h), f"{name}.bias": zero(h)}
    out = {"embed": w(c.vocab_size, h), "type": zero(2, h), "pool.score": w(h), "pool.temperature": zero()} | norm("final") | linear("pooler", h, h)
    if c.positions == "absolute":
        out["position"] = w(c.max_positions, h)
    for i in range(c.layers):
        for n in ("q", "k", "v", "o"):
            out |= linear(f"{i}.{n}", h, h)
        out |= linear(f"{i}.up", h, m * (1 + c.gated)) | linear(f"{i}.down", m, h) | norm(f"{i}.norm1") | norm(f"{i}.norm2")
        if c.positions.startswith("relative"):
            out[f"{i}.distance"] = w(2 * c.max_positions - 1, h // c.heads)
    out |= linear("lm.dense", h, h) | {"lm.scale": one(h), "lm.bias": zero(h), "lm.out": zero(c.vocab_size)}
    if c.head == "mlp":
        inner = c.head_size or max(1, h // 2)
        out |= norm("head.norm") | linear("head.up", h, inner) | linear("head.down", inner, c.labels)
    wide = c.projection or h
    if c.head == "curricular" and c.projection:
        out |= linear("head.project", h, wide)
    return out | linear("head.linear", wide if c.head == "curricular" else h, c.labels)


# Names of tensors in published files of the first family, by this module's names; {i} is a layer.
PUBLISHED = {
    "embed": "embeddings.word_embeddings.weight",
    "position": "embeddings.position_embeddings.weight",
    "type": "embeddings.token_type_embeddings.weight",
    "final.scale": "encoder.ln.weight",
    "final.bias": "encoder.ln.bias",
    "pooler": "pooler.dense.weight",
    "pooler.bias": "pooler.dense.bias",
    "{i}.norm1.scale": "encoder.layer.{i}.attention.ln.weight",
    "{i}.norm1.bias": "encoder.layer.{i}.attention.ln.bias",
    "{i}.q": "encoder.layer.{i}.attention.self.query.weight",
    "{i}.q.bias": "encoder.layer.{i}.attention.self.query.bias",
    "{i}.k": "encoder.layer.{i}.attention.self.key.weight",
    "{i}.k.bias": "encoder.layer.{i}.attention.self.key.bias",
    "{i}.v": "encoder.layer.{i}.attention.self.value.weight",
    "{i}.v.bias": "encoder.layer.{i}.attention.self.value.bias",
    "{i}.distance": "encoder.layer.{i}.attention.self.distance_embedding.weight",
    "{i}.o": "encoder.layer.{i}.attention.output.dense.weight",
    "{i}.o.bias": "encoder.layer.{i}.attention.output.dense.bias",
    "{i}.norm2.scale": "encoder.layer.{i}.ln.weight",
    "{i}.norm2.bias": "encoder.layer.{i}.ln.bias",
    "{i}.up": "encoder.layer.{i}.intermediate.dense.weight",
    "{i}.up.bias": "encoder.layer.{i}.intermediate.dense.bias",
    "{i}.down": "encoder.layer.{i}.output.dense.weight",
    "{i}.down.bias": "encoder.layer.{i}.output.dense.bias",
    "lm.dense": "cls.predictions.transform.dense.weight",
    "lm.dense.bias": "cls.predictions.transform.dense.bias",
    "lm.scale": "cls.predictions.transform.LayerNorm.weight",
    "lm.bias": "cls.predictions.transform.LayerNorm.bias",
    "lm.out": "cls.predictions.bias",
    "pool.score": "weighting_layer.weight",
    "pool.temperature": "log_temperature",
    "head.linear": "classifier.weight",
    "head.linear.bias": "classifier.bias",
    "head.norm.scale": "mlp_ln.weight",
    "head.norm.bias": "mlp_ln.bias",
    "head.up": "mlp_fc1.weight",
    "head.up.bias": "mlp_fc1.bias",
    "head.down": "mlp_fc2.weight",
    "head.down.bias": "mlp_fc2.bias",
    "head.project": "linear.weight",
    "head.project.bias": "linear.bias",
}
#: Fixed value: the class vectors of a curricular head.
PUBLISHED_CLASSES = "curricular_face.kernel"
#: Tensors that are used as they lie; other matrices map from rows to columns and are turned round.
_AS_THEY_LIE = ("embed", "position", "type", "distance")


def load_weights(path: str, base_prefix: str = "bert") -> dict[str, np.ndarray]:
    """Arrays of an ``.npz`` file or an open ``.safetensors`` one (BF16 too), a base model's prefix stripped."""
    if path.endswith(".npz"):
        with np.load(path) as z:
            raw = dict(z)
    else:
        import json
        import struct

        kinds = {"F32": np.float32, "F16": np.float16, "F64": np.float64, "I64": np.int64, "I32": np.int32, "I16": np.int16, "I8": np.int8, "U8": np.uint8, "BOOL": np.bool_}  # Fixed values
        with open(path, "rb") as f:
            (n,) = struct.unpack("<Q", f.read(8))
            head, body = json.loads(f.read(n)), f.read()

        def array(facts: dict) -> np.ndarray:
            part = body[slice(*facts["data_offsets"])]
            if facts["dtype"] == "BF16":  # the upper half of a 32-bit float
                return (np.frombuffer(part, "<u2").astype(np.uint32) << 16).view(np.float32).reshape(facts["shape"])
            return np.frombuffer(part, kinds[facts["dtype"]]).reshape(facts["shape"])

        raw = {k: array(v) for k, v in head.items() if k != "__metadata__"}
    return {re.sub(rf"^{re.escape(base_prefix)}\.", "", k): v for k, v in raw.items()}


def from_published(c: EncoderConfig, loaded: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Tensors under published names as this module's weights; tensors of other names keep them."""
    names = {}
    for own, name in PUBLISHED.items():
        for i in range(c.layers) if "{i}" in own else (None,):
            names[name.format(i=i)] = own.format(i=i)
    out = {}
    for name, x in loaded.items():
        own = "head.linear" if name == PUBLISHED_CLASSES else names.get(name, name)
        if own == "pool.score":
            x = x.reshape(-1)
        elif name in names and x.ndim == 2 and own.split(".")[-1] not in _AS_THEY_LIE:
            x = x.T
        out[own] = x
    return out


def published_weights(c: EncoderConfig, path: str, base_prefix: str = "bert", strict: bool = False, seed: int = 0) -> tuple[dict[str, np.ndarray], dict[str, list[str]]]:
    """Weights of a published file over random ones, and the report of :func:`fitting_weights`.

    Tensors that are missing or of another shape (a new head, say) stay random;
    with ``strict`` they raise.
    """
    weights, report = fitting_weights(random_weights(c, seed), from_published(c, load_weights(path, base_prefix)))
    if strict and (report["missing"] or report["mismatched"]):
        raise ValueError(f"{path} lacks {report['missing']} and has others of a wrong shape: {report['mismatched']}")
    return weights, report


def save_pretrained(c: EncoderConfig, w: dict[str, np.ndarray], path: str, base_prefix: str = "bert") -> None:
    """A folder with ``config.json`` and ``model.safetensors`` under published names, as :func:`published_weights` reads it."""
    import json
    import struct
    from dataclasses import asdict
    from pathlib import Path

    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "config.json").write_text(json.dumps(asdict(c), indent=1))
    head, body, at = {}, [], 0
    base = ("embeddings.", "encoder.", "pooler.")
    for own, x in sorted(w.items()):
        layer, _, rest = own.partition(".")
        name = PUBLISHED.get(f"{{i}}.{rest}", own).format(i=layer) if layer.isdigit() else PUBLISHED.get(own, own)
        if own == "head.linear" and c.head == "curricular":
            name = PUBLISHED_CLASSES
        elif own == "pool.score":
            x = x[None]
        elif x.ndim == 2 and name != own and own.split(".")[-1] not in _AS_THEY_LIE:
            x = x.T
        data = np.ascontiguousarray(x, np.float32).tobytes()
        head[f"{base_prefix}.{name}" if name.startswith(base) else name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [at, at + len(data)]}
        body.append(data)
        at += len(data)
    facts = json.dumps(head).encode()
    (folder / "model.safetensors").write_bytes(struct.pack("<Q", len(facts)) + facts + b"".join(body))


def load_pretrained(path: str, **options: Any) -> tuple[EncoderConfig, dict[str, np.ndarray], dict[str, list[str]]]:
    """Configuration, weights and report of a folder written by :func:`save_pretrained`."""
    import json
    from pathlib import Path

    c = EncoderConfig(**json.loads((Path(path) / "config.json").read_text()))
    return c, *published_weights(c, str(Path(path) / "model.safetensors"), **options)


def fitting_weights(own: dict[str, np.ndarray], loaded: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, list[str]]]:
    """Own weights replaced by loaded ones of the same shape, and what was missing, unexpected or mismatched."""
    fit = {k: v for k, v in loaded.items() if k in own and own[k].shape == v.shape}
    report = {"missing": sorted(own.keys() - loaded.keys()), "unexpected": sorted(loaded.keys() - own.keys()), "mismatched": sorted(k for k in own.keys() & loaded.keys() if k not in fit)}
    return own | fit, report


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to about 1e-7, by the rational approximation of Abramowitz and Stegun, 7.1.26."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.sign(x) * (1 - tail)


def gelu(x: np.ndarray) -> np.ndarray:
    return (0.5 * x * (1 + erf(x / math.sqrt(2)))).astype(x.dtype)


def linear(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    return x @ w[name] + w.get(f"{name}.bias", np.float32(0))


def layer_norm(x: np.ndarray, scale: np.ndarray, bias: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    d = x - x.mean(-1, keepdims=True)
    return d / np.sqrt((d * d).mean(-1, keepdims=True) + eps) * scale + bias


def rms_norm(x: np.ndarray, scale: np.ndarray, bias: np.ndarray | float = 0.0, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * scale + bias


def rotate(x: np.ndarray, theta: float) -> np.ndarray:
    """Rotary positions over the last axis of (..., time, size)."""
    t, d = x.shape[-2:]
    angle = np.arange(t)[:, None] * theta ** (-np.arange(0, d, 2) / d)[None]
    cos, sin = np.concatenate([np.cos(angle)] * 2, -1), np.concatenate([np.sin(angle)] * 2, -1)
    half = np.concatenate([-x[..., d // 2 :], x[..., : d // 2]], -1)
    return (x * cos + half * sin).astype(x.dtype)


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def keep_mask(mask: np.ndarray) -> np.ndarray:
    """(batch, time) flags from masks of booleans, 0/1 or additive negatives, with up to two axes of one between."""
    m = np.asarray(mask)
    m = m.reshape(m.shape[0], m.shape[-1])
    return m if m.dtype == bool else m >= 0 if (m < 0).any() else m > 0


def encode(c: EncoderConfig, w: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, rows: int = 0) -> np.ndarray:
    """Last hidden states (batch, time, hidden); ``rows`` bounds how many rows the feed-forward layers take at once."""
    norm = layer_norm if c.norm == "layer" else rms_norm
    keep = keep_mask(mask)
    n, t = ids.shape
    x = w["embed"][ids]
    if "type" in w:
        x = x + w["type"][0]  # one sentence
    if c.positions == "absolute":
        x = x + w["position"][:t][None]
    size = c.hidden_size // c.heads
    split = lambda y: y.reshape(n, t, c.heads, size).transpose(0, 2, 1, 3)
    gap = np.arange(t)[:, None] - np.arange(t)[None]
    for i in range(c.layers):
        y = norm(x, w[f"{i}.norm1.scale"], w[f"{i}.norm1.bias"])
        q, k, v = (split(linear(y, w, f"{i}.{a}")) for a in "qkv")
        full = c.window is None or i % 3 == 0
        if c.positions == "rotary":
            theta = c.theta_global if full else c.theta_local
            q, k = rotate(q, theta), rotate(k, theta)
        s = q @ k.transpose(0, 1, 3, 2)
        if c.positions.startswith("relative"):
            d = w[f"{i}.distance"][gap + c.max_positions - 1]
            s = s + np.einsum("bhld,lrd->bhlr", q, d)
            if c.positions == "relative_key_query":
                s = s + np.einsum("bhrd,lrd->bhlr", k, d)
        s = s / math.sqrt(size)
        s = np.where(keep[:, None, None, :], s, -1e9)
        if not full:
            s = np.where(np.abs(gap)[None, None] <= c.window // 2, s, -1e9)
        x = x + linear((softmax(s) @ v).transpose(0, 2, 1, 3).reshape(n, t, -1), w, f"{i}.o")
        y = norm(x, w[f"{i}.norm2.scale"], w[f"{i}.norm2.bias"])

        def feed(z: np.ndarray, i: int = i) -> np.ndarray:
            up = linear(z, w, f"{i}.up")
            if c.gated:
                a, b = np.split(up, 2, -1)
                return linear(gelu(a) * b, w, f"{i}.down")
            return linear(gelu(up), w, f"{i}.down")

        x = x + (np.concatenate([feed(y[a : a + rows]) for a in range(0, n, rows)]) if rows else feed(y))
    return norm(x, w["final.scale"], w["final.bias"])


def pool(c: EncoderConfig, w: dict[str, np.ndarray], hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One vector a row: the first token's, the mean over kept tokens, or their attention-weighted sum, at a bounded temperature."""
    keep = keep_mask(mask).astype(np.float32)
    if c.pooling == "cls":
        return hidden[:, 0]
    if c.pooling == "mean":
        return (hidden * keep[..., None]).sum(1) / np.maximum(keep.sum(1, keepdims=True), 1)
    keep[keep.sum(1) == 0, 0] = 1
    heat = np.clip(np.exp(w.get("pool.temperature", np.float32(0))), c.least_temperature, c.most_temperature)
    a = softmax(np.where(keep > 0, hidden @ w["pool.score"] / heat, -1e9), 1)
    return (hidden * a[..., None]).sum(1)


def unit(x: np.ndarray, epsilon: float = 1e-12) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), epsilon)


def classify(c: EncoderConfig, w: dict[str, np.ndarray], pooled: np.ndarray) -> np.ndarray:
    """Logits: of a linear layer, of a normed two-layer one, or scaled cosines with class vectors (after a projection, if any)."""
    if c.head == "mlp":
        ready = layer_norm(pooled, w["head.norm.scale"], w["head.norm.bias"], c.norm_epsilon) if "head.norm.scale" in w else pooled
        return linear(gelu(linear(ready, w, "head.up")), w, "head.down")
    if c.head == "curricular":
        x = linear(pooled, w, "head.project") if "head.project" in w else pooled
        return c.scale * np.clip(unit(x) @ unit(w["head.linear"].T).T, -1, 1)
    return linear(pooled, w, "head.linear")


def classification_loss(df: DataFrame, problem: str | None = None, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """One row with the mean ``loss`` over all rows: squared error, cross-entropy or binary cross-entropy.

    Without ``problem`` one logit is a regression, whole labels are classes and
    arrays of labels are several binary ones.
    """
    kinds = ("regression", "single_label_classification", "multi_label_classification")  # Fixed values
    if problem is None:
        first = df.select(F.size(logits)).first()
        problem = kinds[0] if first and first[0] == 1 else kinds[2] if dict(df.dtypes)[labels].startswith("array") else kinds[1]
    if problem not in kinds:
        raise ValueError(f"The problem is one of {kinds}, not {problem}")
    if problem == kinds[1]:
        return cross_entropy(df, logits, labels)
    y = F.col(labels) if dict(df.dtypes)[labels].startswith("array") else F.array(labels)
    pairs = F.zip_with(F.col(logits).cast("array<double>"), y.cast("array<double>"), lambda a, b: (a - b) * (a - b) if problem == kinds[0] else F.greatest(a, F.lit(0.0)) - a * b + F.log1p(F.exp(-F.abs(a))))
    return df.select(F.explode(pairs).alias("x")).agg(F.avg("x").alias("loss"))


def masked_lm(c: EncoderConfig, w: dict[str, np.ndarray], hidden: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """Vocabulary logits, of all tokens or of the chosen (row, time) places alone; the decoder is the embedding."""
    h = hidden if places is None else hidden[places[:, 0], places[:, 1]]
    return layer_norm(gelu(linear(h, w, "lm.dense")), w["lm.scale"], w["lm.bias"]) @ w["embed"].T + w["lm.out"]


def map_batches(df: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray], schema: str, out: str, ids: str = "input_ids", mask: str = "attention_mask", rows: int = 64) -> DataFrame:
    """``df`` with one array column from padded batches of ``rows`` rows; each row keeps its other columns."""
    columns = df.columns

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                width = max(1, max(map(len, part[ids])))
                x, m = np.zeros((len(part), width), np.int64), np.zeros((len(part), width), np.int64)
                for r, (a, b) in enumerate(zip(part[ids], part[mask], strict=True)):
                    x[r, : len(a)], m[r, : len(b)] = a, b
                yield part[columns].assign(**{out: list(run(x, m))})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(apply, f"{fields}, {out} {schema}")


def embed(df: DataFrame, c: EncoderConfig, w: dict[str, np.ndarray], *, normalize: bool = True, **options: Any) -> DataFrame:
    """``df`` with ``embedding``: pooled (and unit-length) vectors."""

    def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = pool(c, w, encode(c, w, ids, mask), mask)
        return (unit(x) if normalize else x).astype(np.float32)

    return map_batches(df, run, "array<float>", "embedding", **options)


def predict(df: DataFrame, c: EncoderConfig, w: dict[str, np.ndarray], **options: Any) -> DataFrame:
    """``df`` with ``logits`` of the classification head."""
    return map_batches(df, lambda ids, mask: classify(c, w, pool(c, w, encode(c, w, ids, mask), mask)).astype(np.float64), "array<double>", "logits", **options)


#: Ways of a model to give vectors, in the order they are tried, and outputs to look into.
_WAYS = ("encode", "embeddings", "get_embeddings", "__call__")
_OUTPUTS = ("embeddings", "embedding", "pooler_output", "sentence_embedding", "last_hidden_state", "hidden_states")


def vectors_of(output: Any, mask: np.ndarray) -> np.ndarray:
    """(batch, size) vectors of a model's output: an array, a mapping or an object with fields, or a tuple.

    Token vectors are averaged over the tokens that the mask keeps; of several
    layers the last counts.
    """
    for name in _OUTPUTS:
        found = output.get(name) if isinstance(output, dict) else getattr(output, name, None)
        if found is not None:
            return vectors_of(found, mask)
    if isinstance(output, (tuple, list)) and len(output) and np.ndim(output[0]) >= 2:
        return vectors_of(output[-1], mask)
    x = np.asarray(output, np.float32)
    if x.ndim == 3:
        keep = keep_mask(mask).astype(np.float32)
        return (x * keep[..., None]).sum(1) / np.maximum(keep.sum(1, keepdims=True), 1)
    if x.ndim != 2:
        raise TypeError(f"The model's output has {x.ndim} dimensions, not two or three")
    return x


def embed_with(df: DataFrame, model: Any, **options: Any) -> DataFrame:
    """``df`` with ``embedding`` from any model with one of :data:`_WAYS`, whatever form its output has."""
    for name in _WAYS:
        if callable(getattr(model, name, None)):
            way = getattr(model, name)
            return map_batches(df, lambda ids, mask: vectors_of(way(ids, mask), mask), "array<float>", "embedding", **options)
    raise TypeError("The model has no way to make embeddings")
