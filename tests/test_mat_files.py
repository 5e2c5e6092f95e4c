"""Files of level 5 written here, element by element, in both byte orders, and read back."""

import struct
import zlib

import numpy as np
import pytest
from wayline.sources import mat_files, recorders

CODES = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9}
CLASSES = {"i1": 8, "u1": 9, "i2": 10, "u2": 11, "i4": 12, "u4": 13, "f4": 7, "f8": 6}


def element(order, code, data):
    if 0 < len(data) <= 4 and code != 14:
        return struct.pack(order + "I", len(data) << 16 | code) + data.ljust(4, b"\0")
    return struct.pack(order + "II", code, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(order, name, value):
    numbers = lambda kind, x: element(order, CODES[kind], np.asarray(x, order + kind).tobytes())
    if isinstance(value, dict):
        what, dims = mat_files.STRUCT, (1, 1)
        rest = numbers("i4", [8]) + element(order, 1, b"".join(k.encode().ljust(8, b"\0") for k in value)) + b"".join(matrix(order, "", v) for v in value.values())
    elif isinstance(value, list):
        what, dims = mat_files.CELL, (len(value), 1)
        rest = b"".join(matrix(order, "", v) for v in value)
    elif isinstance(value, str):
        what, dims, rest = mat_files.TEXT, (1, len(value)), numbers("u2", [ord(c) for c in value])
    else:
        kind = value.dtype.str[1:]
        what, dims, rest = CLASSES[kind], value.shape, numbers(kind, value.ravel(order="F"))
    head = numbers("u4", [what, 0]) + numbers("i4", dims) + element(order, 1, name.encode())
    return element(order, 14, head + rest)


def write(path, order, variables, packed):
    with open(path, "wb") as f:
        f.write(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI"))
        for name, value in variables.items():
            data = matrix(order, name, value)
            f.write(struct.pack(order + "II", 15, len(z := zlib.compress(data))) + z if packed else data)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(spark, tmp_path, order, packed):
    rng = np.random.default_rng(3)
    variables = {
        "posx": rng.standard_normal((70, 1)), "post": np.arange(12, dtype="f8").reshape(3, 4), "small": np.array([[7]], "u1"), "ints": np.array([[-5, 300]], "i2"),
        "singles": np.array([[1.5], [2.5]], "f4"), "none": np.zeros((0, 0)), "label": "héé", "s": {"a": np.array([[1.0, 2.0]]), "deep": {"b": np.array([[3]], "i4")}},
        "cells": [np.array([[4.0]]), "x", np.array([[5], [6]], "u2")],
    }
    write(tmp_path / "one.mat", order, variables, packed)
    (tmp_path / "other.mat").write_bytes(b"no such file" * 50)
    got = {}
    for r in mat_files.read(spark, str(tmp_path)).orderBy("name", "k").collect():
        got.setdefault(r.name, []).append((r.row, r.col, r.value))
    flat = {k: v for k, v in variables.items() if isinstance(v, np.ndarray) and v.size}
    flat |= {"s.a": variables["s"]["a"], "s.deep.b": variables["s"]["deep"]["b"], "cells(1)": np.array([[4.0]]), "cells(3)": np.array([[5], [6]])}
    flat |= {"label": np.array([[ord(c) for c in "héé"]]), "cells(2)": np.array([[ord("x")]])}
    assert got == {k: [(i, j, float(v[i, j])) for j in range(v.shape[1]) for i in range(v.shape[0])] for k, v in flat.items()}
    some = mat_files.read(spark, str(tmp_path / "one.mat"), ["post", "s"])
    assert {r.name for r in some.collect()} == {"post", "s.a", "s.deep.b"} and some.rdd.getNumPartitions() == 2


def test_recordings_in_files_of_level_5(spark, tmp_path):
    t = np.arange(40)[:, None] / 50
    write(tmp_path / "a_POS.mat", "<", {"post": t, "posx": 10 + t, "posy": 3 * t}, True)
    write(tmp_path / "a_EEG.mat", ">", {"EEG": np.arange(9, dtype="i2")[:, None], "Fs": np.array([[250.0]])}, True)
    write(tmp_path / "a_T2C3.mat", "<", {"cellTS": np.array([[0.1], [0.53]])}, False)
    pos, info = recorders.lab_positions(spark, str(tmp_path / "a_POS.mat"))
    rows = pos.orderBy("i").collect()
    assert len(rows) == 40 and np.isclose(rows[7].y - rows[0].y, 21 / 50) and not info.first().uneven
    eeg, fs = recorders.lab_field_signal(spark, str(tmp_path / "a_EEG.mat"))
    assert fs == 250.0 and [r.v for r in eeg.orderBy("i").collect()] == list(map(float, range(9)))
    spikes = recorders.lab_spikes(spark, str(tmp_path / "a_T2C3.mat"), 2, 3).orderBy("t_s").collect()
    assert [(r.tet, r.cell, r.t_s, r.pos_i) for r in spikes] == [(2, 3, 0.1, 5), (2, 3, 0.53, 26)]
