"""Version keys against the orders that the standards print."""

import functools
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import version_keys, versions

SEMVER = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.9.0", "1.10.0-0", "1.10.0", "2.0.0", "2.1.0", "2.1.1", "20240101123456.0.0", "20240101123456789012345.0.0"]
PEP440 = [
    "1.dev0", "1.0.dev456", "1.0a1", "1.0a2.dev456", "1.0a12.dev456", "1.0a12", "1.0b1.dev456", "1.0b2", "1.0b2.post345.dev456", "1.0b2.post345", "1.0rc1.dev456", "1.0rc1", "1.0",
    "1.0+abc.5", "1.0+abc.7", "1.0+5", "1.0.post456.dev34", "1.0.post456", "1.0.15", "1.1.dev1", "1.1", "10.0", "1!0.5",
]
MAVEN = ["1-alpha-1", "1-alpha-2", "1-beta", "1-milestone-1", "1-rc1", "1-rc2", "1-SNAPSHOT", "1", "1-sp", "1-sp.1", "1-abc", "1-foo2", "1-foo10", "1-xyz", "1-1-snapshot", "1-1", "1-1.foo", "1-2", "1.1", "1.2", "1.10", "2-alpha", "2"]
EQUAL = {
    "semver": [("1.0.0", "v1.0.0"), ("1.2", "1.2.0"), ("1.0.0+a", "1.0.0+9"), ("=1.0.0", "1.0.0"), ("1.0.0rc1", "1.0.0-rc1"), ("01.2.3", "1.2.3")],
    "pep440": [("1.0", "1.0.0"), ("v1.0", "1.0"), ("1.0alpha1", "1.0a1"), ("1.0-1", "1.0.post1"), ("1.0.rev3", "1.0.post3"), ("1.0c1", "1.0rc1"), ("1.0-preview_2", "1.0rc2"), ("1.0a", "1.0a0"), ("1.0+Ubuntu-1", "1.0+ubuntu.1"), ("0!1", "1")],
    "maven": [("1", "1.0"), ("1", "1.0.0"), ("1", "1-ga"), ("1", "1.final"), ("1-a1", "1-alpha-1"), ("1.foo", "1-foo"), ("1.0.0-foo.0.0", "1-foo"), ("1-ga-1", "1-1"), ("1cr1", "1-RC-1"), ("1_1", "1-1"), ("1.", "1")],
}
NONE = {"semver": ["", "latest", "x.1", "1..2", "^1.0"], "pep440": ["", "abc", "1.0-x", "1.0+"], "maven": ["", "  "]}


def _keys(spark, scheme, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.select("k", version_keys.SCHEMES[scheme](F.col("v")).alias("key")).orderBy("k").select("key").collect()]


@pytest.mark.parametrize(("scheme", "ordered"), [("semver", SEMVER), ("pep440", PEP440), ("maven", MAVEN)])
def test_order_is_the_standards(spark, scheme, ordered):
    keys = _keys(spark, scheme, ordered)
    assert None not in keys
    assert [ordered[k] for k in sorted(range(len(keys)), key=lambda k: keys[k].encode())] == ordered
    assert len(set(keys)) == len(keys)


@pytest.mark.parametrize("scheme", list(EQUAL))
def test_spellings_of_one_version_are_equal(spark, scheme):
    left, right = zip(*EQUAL[scheme], strict=True)
    for a, b, x, y in zip(left, right, _keys(spark, scheme, left), _keys(spark, scheme, right), strict=True):
        assert x == y is not None, (a, b, x, y)
    assert _keys(spark, scheme, NONE[scheme]) == [None] * len(NONE[scheme])


def _semver_order(a, b):
    """Precedence as the standard words it."""
    def parts(v):
        core, _, pre = v.partition("-")
        return [int(x) for x in core.split(".")], pre.split(".") if pre else None

    (x, p), (y, q) = parts(a), parts(b)
    if x != y:
        return -1 if x < y else 1
    if p is None or q is None:
        return (p is None) - (q is None)
    for i, j in itertools.zip_longest(p, q):
        if i == j:
            continue
        if i is None or j is None:
            return -1 if i is None else 1
        if i.isdigit() and j.isdigit():
            return -1 if int(i) < int(j) else 1
        if i.isdigit() != j.isdigit():
            return -1 if i.isdigit() else 1
        return -1 if i.encode() < j.encode() else 1
    return 0


def test_random_versions_sort_by_precedence(spark):
    rng = random.Random(3)
    number = lambda: str(rng.choice([0, 1, 2, 9, 10, 11, 99, 100, 10**20]))
    piece = lambda: rng.choice([number(), "alpha", "a", "a-b", "A", "rc1", "0a", "-", "x9"])
    values = [".".join(number() for _ in range(3)) + rng.choice(["", "-" + ".".join(piece() for _ in range(rng.randrange(1, 4)))]) for _ in range(400)]
    keys = dict(zip(values, _keys(spark, "semver", values), strict=True))
    for a, b in itertools.pairwise(sorted(values, key=functools.cmp_to_key(_semver_order))):
        assert (keys[a].encode() > keys[b].encode()) is False and (keys[a] == keys[b]) == (_semver_order(a, b) == 0), (a, b)


def test_needs_update(spark):
    cases = [("1.0.0-rc1", "1.0.0", True), ("1.0.0-alpha", "1.0.0-beta", True), ("20240101123456.0.0", "20240101123457.0.0", True), ("1.0.0+a", "1.0.0+9", False), ("1.9.0", "v1.10", True), ("1.0", "1.0.0", False), ("x", "1.0", None)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r.want == r.got for r in rows.select("want", versions.needs_update(F.col("a"), F.col("b")).alias("got")).collect())
