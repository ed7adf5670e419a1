"""White-space functions over every character, against Python's str methods."""

import random

from contentmark.functions.text import WS_CHARS, normalize_ws, remove_ws, strip_ws


def test_every_character(spark):
    assert sorted(WS_CHARS) == sorted(c for c in map(chr, range(0x110000)) if c.isspace())
    rng = random.Random(3)
    texts = [f"{c}a{c}b {c}c\n{c}" for c in map(chr, range(1, 0x3100)) if c.isspace() or rng.random() < 0.1]
    texts += ["".join(rng.choice(WS_CHARS + "ab !~é😀") for _ in range(rng.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts + [""]], "t string")
    for r in df.select("t", normalize_ws("t").alias("n"), remove_ws("t").alias("r"), strip_ws("t").alias("s")).collect():
        assert (r["n"], r["r"], r["s"]) == (" ".join(r["t"].split()), "".join(r["t"].split()), r["t"].strip())
