"""What the recurrent states of the tagger emit, by the ONNX runtime where it is installed: one graph, a scan over the steps.

The model format is a protocol buffer; the few messages the graph needs are written here, as the package that builds
them is not installed. Sums are those of the numpy twin in `tagger.py` in another order, so results differ by rounding.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

try:
    import onnxruntime
except ImportError:  # all is then computed in numpy
    onnxruntime = None

_FLOAT, _INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _message(*fields: tuple[int, int | str | bytes]) -> bytes:
    """(number, value) of each field: an integer, a text, or the bytes of a message."""
    out = []
    for number, v in fields:
        if isinstance(v, int):
            out += [_varint(number << 3), _varint(v)]
        else:
            v = v.encode() if isinstance(v, str) else v
            out += [_varint(number << 3 | 2), _varint(len(v)), v]
    return b"".join(out)


def _tensor(name: str, a: np.ndarray) -> bytes:
    return _message(*((1, d) for d in a.shape), (2, _FLOAT if a.dtype == np.float32 else _INT64), (8, name), (9, a.tobytes()))


def _value(name: str, kind: int, *dims: int | str) -> bytes:
    shape = _message(*((1, _message((1 if isinstance(d, int) else 2, d))) for d in dims))
    return _message((1, name), (2, _message((1, _message((1, kind), (2, shape))))))


def _node(op: str, takes: str, gives: str, **attributes: int | bytes) -> bytes:
    written = ((5, _message((1, k), (3, v), (20, 2)) if isinstance(v, int) else _message((1, k), (6, v), (20, 5))) for k, v in attributes.items())
    return _message(*((1, i) for i in takes.split()), *((2, o) for o in gives.split()), (4, op), *written)


def _graph(name: str, nodes: list[bytes], takes: list[bytes], gives: list[bytes], constants: list[bytes] = ()) -> bytes:
    return _message(*((1, n) for n in nodes), (2, name), *((5, c) for c in constants), *((11, i) for i in takes), *((12, o) for o in gives))


def _scan(table: np.ndarray, u: np.ndarray, w: np.ndarray) -> bytes:
    """The model that reads symbols (T, B) from the first row on and gives the emissions (T, B, tags) of the states.

    Gates (in, forget, out, new) have weights of their own, so that the runtime joins each product with its activation
    and nothing is cut apart.
    """
    n, step, constants = len(u), [], [_tensor("w", w)]
    for k, gate in enumerate(("in", "forget", "out", "new")):
        own = slice(k * n, (k + 1) * n)
        constants += [_tensor(f"table_{gate}", np.ascontiguousarray(table[:, own])), _tensor(f"u_{gate}", np.ascontiguousarray(u[:, own]))]
        step += [_node("Gather", f"table_{gate} x", f"read_{gate}", axis=0), _node("Gemm", f"h u_{gate} read_{gate}", f"z_{gate}"), _node("Tanh" if gate == "new" else "Sigmoid", f"z_{gate}", gate)]
    step += [
        _node("Mul", "forget c", "kept"), _node("Mul", "in new", "added"), _node("Add", "kept added", "c_next"),
        _node("Tanh", "c_next", "seen"), _node("Mul", "out seen", "h_next"), _node("MatMul", "h_next w", "emitted"),
    ]
    values = lambda *names: [_value(k, _FLOAT, "B", n) for k in names]
    body = _graph("step", step, [*values("h", "c"), _value("x", _INT64, "B")], [*values("h_next", "c_next"), _value("emitted", _FLOAT, "B", w.shape[1])], constants)
    scan = _node("Scan", "h_first c_first symbols", "h_last c_last emissions", body=body, num_scan_inputs=1)
    whole = _graph("emissions", [scan], [*values("h_first", "c_first"), _value("symbols", _INT64, "T", "B")], [_value("emissions", _FLOAT, "T", "B", w.shape[1])])
    return _message((1, 8), (7, whole), (8, _message((1, ""), (2, 15))))


def emissions(table: np.ndarray, u: np.ndarray, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray] | None:
    """A function from symbols (T, B) to what one direction emits (T, B, tags), on one thread; None without the runtime."""
    if onnxruntime is None:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
    session = onnxruntime.InferenceSession(_scan(*(a.astype(np.float32) for a in (table, u, w))), options, providers=["CPUExecutionProvider"])

    def run(x: np.ndarray) -> np.ndarray:
        first = np.zeros((x.shape[1], len(u)), np.float32)
        return session.run(["emissions"], {"h_first": first, "c_first": first, "symbols": x.astype(np.int64, copy=False)})[0]

    return run
