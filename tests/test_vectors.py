import hashlib
import random

import numpy as np

from wayfind.functions.vectors import md5_heads


def test_first_bits_of_md5():
    r = random.Random(5)
    words = [bytes(r.choices(b"abcdefgh01_-", k=r.choice([1, 2, 9, 27, 28, 54, 55, 56, 70]))) for _ in range(3000)]
    data, length = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    head = lambda text: int(hashlib.md5(text).hexdigest()[:8], 16)
    assert md5_heads(data, [(start, length)]).tolist() == [head(w) for w in words]
    other = np.array([r.randrange(3000) for _ in words])
    assert md5_heads(data, [(start, length), (start[other], length[other])]).tolist() == [head(w + b"_" + words[o]) for w, o in zip(words, other)]
