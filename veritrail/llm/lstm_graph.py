"""A bidirectional LSTM with a linear layer, written as an ONNX model and run by onnxruntime in one thread.

Its LSTM takes whole sequences in one call. The few messages of the format that a model needs are
written here, so that only onnxruntime is asked for.
"""

from __future__ import annotations

import numpy as np

_FLOAT, _INT32, _INT64 = 1, 6, 7


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(key: int, value: int | str | bytes) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, int):
        return _number(key << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(key << 3 | 2) + _number(len(value)) + value


def _node(op: str, inputs: list[str], output: str, **attributes: int | str) -> bytes:
    out = b"".join(_field(1, x) for x in inputs) + _field(2, output) + _field(4, op)
    for name, value in attributes.items():
        out += _field(5, _field(1, name) + (_field(3, value) + _field(20, 2) if isinstance(value, int) else _field(4, value) + _field(20, 3)))
    return out


def _constant(name: str, value: np.ndarray) -> bytes:
    kind = _INT64 if value.dtype == np.int64 else _FLOAT
    value = value if kind == _INT64 else np.ascontiguousarray(value, "<f4")
    return b"".join(_field(1, n) for n in value.shape) + _field(2, kind) + _field(8, name) + _field(9, value.tobytes())


def _value(name: str, kind: int, dimensions: int) -> bytes:
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, _field(1, b"") * dimensions)))


def lstm_graph(embed: np.ndarray, gates: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray) -> bytes:
    """The model from ``symbols[place, row]`` to ``scores[place, row, label]``.

    ``gates[direction, input, gate]`` has the rows of the embedding and then of the hidden state,
    ``bias`` is ``[direction, 1, gate]`` and the gates are in, forget, out and new content.
    ``out[hidden, label]`` takes the hidden states of both directions.
    """
    size, hidden = embed.shape[1], gates.shape[2] // 4
    places = np.arange(4 * hidden).reshape(4, hidden)[[0, 2, 1, 3]].ravel()  # ONNX: in, out, forget, new content
    constants = {
        "embed": embed,
        "W": gates[:, :size, places].swapaxes(1, 2),
        "R": gates[:, size:, places].swapaxes(1, 2),
        "B": np.concatenate([bias[:, 0, places], np.zeros((2, 4 * hidden))], 1),
        "out": out.reshape(2, hidden, -1),
        "both": np.array([1], np.int64),
        "out_bias": out_bias,
    }
    nodes = [
        _node("Gather", ["embed", "symbols"], "seen"),
        _node("LSTM", ["seen", "W", "R", "B"], "states", hidden_size=hidden, direction="bidirectional"),
        _node("MatMul", ["states", "out"], "parts"),
        _node("ReduceSum", ["parts", "both"], "sums", keepdims=0),
        _node("Add", ["sums", "out_bias"], "scores"),
    ]
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "lstm") + b"".join(_field(5, _constant(*c)) for c in constants.items())
    graph += _field(11, _value("symbols", _INT32, 2)) + _field(12, _value("scores", _FLOAT, 3))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 14))


def session(model: bytes):
    """The model, ready to run in the caller's thread."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
