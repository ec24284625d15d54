"""Small tables with every awkward case."""

import random

import numpy as np

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = DOCS + ", Text string, shard string, copy int, keep string, line string, node int, f0 string, dropped string, h int, key string, `_0` int, score string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


LONG = "\n".join(prose(i, 12) for i in range(4000))


def awkward_rows():
    extra = ("T", "s", 7, "k", "l", 1, "f", "d", 2, "key", 3, "sc")
    base = [(1, prose(1, 60), "en", "src0", 1), (2, prose(2, 60), None, None, None), (None, prose(3, 60), "en", "src1", 3), (4, None, "en", "src0", 4),
            (5, "", "en", "src0", 5), (6, "...!!! \n\n ??", "en", "src1", 6), (7, LONG, "de", "src2", 7), (1, prose(1, 60), "en", "src0", 1), (8, prose(1, 60), "en", "src2", 8),
            (None, None, None, None, None), (9, "Été à Noël: œuvre naïve 東京 😀 x́y " * 3, "fr", "src1", 9), (4, None, "en", "src0", 4)]
    return [r + extra for r in base]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), AWKWARD)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def prints_apart(n, distance):
    """n fingerprints and, for each, another that differs in ``distance`` bits, 2 or more of them in each 16 of the first 64."""
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (2 * n, 256), dtype=np.uint8)
    for i in range(n):
        first = [16 * k + b for k in range(4) for b in rng.choice(16, 2, replace=False)]
        rest = rng.choice(np.setdiff1d(np.arange(256), first), distance - len(first), replace=False)
        bits[n + i] = bits[i]
        bits[n + i, [*first, *rest]] ^= 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
