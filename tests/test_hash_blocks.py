"""Near-equal hashes by blocks and by keys against all pairs."""

import random

import pytest

from corpusmill.operators import timeline as M


@pytest.mark.parametrize("radius,bits", [(11, 63), (2, 64)])
def test_pairs_by_blocks_and_by_keys(spark, radius, bits):
    rng = random.Random(4)
    codes = [rng.getrandbits(bits) for _ in range(40)]
    codes += [c ^ sum(1 << i for i in rng.sample(range(bits), rng.randrange(0, 14))) for c in codes]
    texts = [format(c, f"0{bits}b") for c in codes]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, bits string")
    want = {(a, b, n) for a in texts for b in texts if a < b and (n := sum(x != y for x, y in zip(a, b))) <= radius}
    got = [tuple(r) for r in M.near_dup_pairs(table, radius, bits)[0].collect()]
    assert set(got) == want and len(got) == len(want)
    words = table.selectExpr("bits AS hash", "array(cast(conv(substring(bits, 1, 32), 2, 10) AS bigint), cast(conv(substring(bits, 33, 32), 2, 10) AS bigint)) AS words").distinct()
    assert {tuple(r) for r in M._pairs_by_blocks(words, radius, 16).collect()} == want
