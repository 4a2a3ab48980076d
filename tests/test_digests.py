import hashlib

import numpy as np
import pyarrow as pa

from kinfold.functions import digests


def expected(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def test_uniforms_are_those_of_md5_for_texts_of_any_length(monkeypatch):
    monkeypatch.setattr(digests, "TOGETHER", 100)
    heads = ["", *["x" * k + "é|" for k in range(0, 200, 7)], "5|Sex|0|1|"]
    tails = ["", "3|1", "99999|12", "y" * 61, "ü" * 30]
    head, tail = (a.ravel() for a in np.meshgrid(np.arange(len(heads)), np.arange(len(tails))))
    got = digests.joined_uniforms(pa.array(["unused", *heads]).slice(1), pa.array(["unused", *tails]).slice(1), head, tail)
    assert got.tolist() == [expected(heads[h] + tails[t]) for h, t in zip(head, tail)]


def test_no_texts_give_no_uniforms():
    none = np.zeros(0, np.int64)
    assert len(digests.joined_uniforms(pa.array([], pa.string()), pa.array([], pa.string()), none, none)) == 0
