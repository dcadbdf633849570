"""The products of a training step and of scoring as graphs of onnxruntime, on one thread; without the library, None.

numpy spends much of a step on exponentials and on many small products, which onnxruntime computes in half the time. The
graphs hold the same operations as ``attention_lm.gradients`` and ``Scorer``; a graph is a protocol buffer of few kinds of
fields, written here.
"""

from __future__ import annotations

import struct

import numpy as np

MICROSOFT = "com.microsoft"
#: Types of tensors in ONNX.
TYPES = {"float32": 1, "int64": 7}
IR, OPSET = 8, 18


def number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def whole(field: int, n: int) -> bytes:
    return number(field << 3) + number(n)


def part(field: int, content: bytes | str) -> bytes:
    raw = content.encode() if isinstance(content, str) else content
    return number(field << 3 | 2) + number(len(raw)) + raw


def attribute(name: str, value: int | float) -> bytes:
    if isinstance(value, float):
        return part(1, name) + number(2 << 3 | 5) + struct.pack("<f", value) + whole(20, 1)
    return part(1, name) + whole(3, value) + whole(20, 2)


def node(kind: str, inputs: str, output: str, domain: str = "", **attributes) -> bytes:
    return b"".join([*(part(1, x) for x in inputs.split()), part(2, output), part(4, kind),
                     *(part(5, attribute(k, v)) for k, v in attributes.items()), part(7, domain) if domain else b""])


def product(inputs: str, output: str, first: int = 0, second: int = 0) -> bytes:
    """A matrix product, with its first or second factor transposed."""
    return node("FusedMatMul", inputs, output, MICROSOFT, transA=first, transB=second)


def declared(name: str, rank: int, kind: str = "float32") -> bytes:
    dims = b"".join(part(1, part(2, f"{name}_{i}")) for i in range(rank))
    return part(1, name) + part(2, part(1, whole(1, TYPES[kind]) + part(2, dims)))


def constant(name: str, x: np.ndarray) -> bytes:
    return b"".join(whole(1, n) for n in x.shape) + whole(2, TYPES[x.dtype.name]) + part(8, name) + part(9, x.tobytes())


def model(nodes: list[bytes], constants: dict[str, np.ndarray], inputs: list[bytes], outputs: list[bytes]) -> bytes:
    graph = b"".join([*(part(1, x) for x in nodes), part(2, "step"), *(part(5, constant(k, v)) for k, v in constants.items()),
                      *(part(11, x) for x in inputs), *(part(12, x) for x in outputs)])
    return whole(1, IR) + part(8, part(1, "") + whole(2, OPSET)) + part(8, part(1, MICROSOFT) + whole(2, 1)) + part(7, graph)


def forward(stride: int, width: int, masks: np.ndarray, limit: float | None) -> bytes:
    """Inputs of windows to attention and class scores: probabilities, or, where scores are kept to ``limit``, their logarithms."""
    limited = limit is not None
    nodes = [
        node("MatMul", "last scores_of", "flat_q"), node("Reshape", "flat_q windows", "q"), product("q x", "products", second=1),
        *([node("Clip", "products low high", "kept")] if limited else []),
        node("Gather", "masks early", "mask", axis=0), node("Add", f"{'kept' if limited else 'products'} mask", "score"),
        node("Softmax", "score", "a", axis=-1), node("MatMul", "a x", "by_window"), node("Reshape", "by_window flat", "seen"),
        node("Gemm", "seen values_of last", "h"), node("Gemm", "h out bias", "logits"),
        *([node("Clip", "logits low high", "limited")] if limited else []),
        node("LogSoftmax" if limited else "Softmax", "limited" if limited else "logits", "p", axis=-1)]
    constants = {"windows": np.array([-1, stride, width]), "flat": np.array([-1, width]), "masks": masks}
    if limited:
        constants |= {"low": np.array(-limit, np.float32), "high": np.array(limit, np.float32)}
    inputs = [declared("x", 3), declared("last", 2), declared("early", 1, "int64"), *(declared(n, 2) for n in ("scores_of", "values_of", "out")), declared("bias", 1)]
    ranks = {"p": 2} if limited else {"q": 3, "a": 3, "seen": 2, "h": 2, "p": 2}
    return model(nodes, constants, inputs, [declared(n, r) for n, r in ranks.items()])


def backward(stride: int, width: int) -> bytes:
    """From the gradient ``d`` of class scores to those of weights, of all positions (``dx``) and of the last ones besides (``dl``)."""
    nodes = [
        product("h d", "g_out", first=1), product("d out", "dh", second=1), product("seen dh", "g_values", first=1),
        product("dh values_of", "flat_seen", second=1), node("Reshape", "flat_seen windows", "d_seen"),
        product("d_seen x", "da", second=1), node("Mul", "flat_seen seen", "each"), node("ReduceSum", "each end", "sums", keepdims=1),
        node("Reshape", "sums rows", "own"), node("Sub", "da own", "apart"), node("Mul", "a apart", "ds"),
        node("MatMul", "ds x", "by_window"), node("Reshape", "by_window flat", "dq"), product("last dq", "g_scores", first=1),
        node("Gemm", "dq scores_of dh", "dl", transB=1),
        product("a d_seen", "dx_values", first=1), product("ds q", "dx_keys", first=1), node("Add", "dx_values dx_keys", "dx")]
    constants = {"windows": np.array([-1, stride, width]), "flat": np.array([-1, width]), "rows": np.array([-1, stride, 1]), "end": np.array([-1])}
    ranks = {"x": 3, "last": 2, "q": 3, "a": 3, "seen": 2, "h": 2, "d": 2, "scores_of": 2, "values_of": 2, "out": 2}
    return model(nodes, constants, [declared(n, r) for n, r in ranks.items()],
                 [declared(n, r) for n, r in {"g_out": 2, "g_values": 2, "g_scores": 2, "dl": 2, "dx": 3}.items()])


class Graphs:
    """Graphs by name, made when first run; they do not travel with functions that name them."""

    def __init__(self):
        self.made = {}

    def __reduce__(self):
        return Graphs, ()

    def get(self, name: str, build):
        """The graph's run, or None without the library."""
        if name not in self.made:
            self.made[name] = opened(build)
        return self.made[name]


def opened(build):
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    # An arena doubles what it holds whenever it is short, beside a JVM that has most of an executor's memory.
    options.enable_cpu_mem_arena = options.enable_mem_pattern = False
    session = onnxruntime.InferenceSession(build(), options, providers=["CPUExecutionProvider"])
    return lambda **inputs: session.run(None, inputs)
