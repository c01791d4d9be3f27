"""The difference of snapshots by digests of buckets against the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from florilege.operators.ingest import digest_diff, equal_buckets, snapshot_diff


@pytest.mark.parametrize("changes", [0, 3, 400])
@pytest.mark.parametrize("keep_outside", [None, "r/a"])
def test_digests_give_the_plain_difference(spark, changes, keep_outside):
    rng = random.Random(changes)
    old = {f"r/{'ab'[k % 2]}/{k}": f"h{k}" for k in range(600)}
    new = dict(old)
    for path in rng.sample(sorted(old), changes):
        how = rng.randrange(3)
        if how == 0:
            del new[path]
        elif how == 1:
            new[path] = "other"
        else:
            new[path + "x"] = "added"
    frame = lambda rows: spark.createDataFrame([(p[::-1], p, h) for p, h in rows.items()], "id string, path string, hash string")
    disk, stored = frame(new), frame(old)
    equal = equal_buckets(disk, stored, 64).cache()
    got = digest_diff(disk, stored, equal, keep_outside, 64)
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(got) == rows(snapshot_diff(disk, stored, keep_outside))
    compared = stored.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(64))).join(equal, "bucket", "left_anti").count()
    assert equal.count() >= 64 - changes and (compared == 0 if not changes else changes > 3 or compared <= 3 * 30)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id string, path string, hash string")
    one = spark.createDataFrame([("i", "p", "h")], "id string, path string, hash string")
    for disk, stored, want in ((none, none, []), (one, none, ["added"]), (none, one, ["removed"]), (one, one, ["unchanged"])):
        assert [r.status for r in digest_diff(disk, stored, equal_buckets(disk, stored)).collect()] == want
