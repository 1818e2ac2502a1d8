import hashlib
import math
import zlib
from collections import Counter, defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from orderlens.llm import queries
from orderlens.llm.sharding import Shard, default_tree, shards_by_key, tree_shard


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(20_000).select(F.col("id").alias("doc_id")).cache()


def placed(ids, tree):
    return {r.doc_id: r.shard for r in ids.select("doc_id", tree_shard(tree).alias("shard")).collect()}


def test_shards_fill_evenly(ids):
    counts = Counter(placed(ids, default_tree(16)).values())
    assert set(counts) == set(range(16))
    assert max(counts.values()) < 1.15 * min(counts.values())


@pytest.mark.parametrize("shards", [1, 5, 16, 18])
def test_one_more_shard_takes_rows_only_into_itself(ids, shards):
    tree, grown = default_tree(shards, first=shards), default_tree(shards + 1, first=shards)
    before, after = placed(ids, tree), placed(ids, grown)
    moved = {i for i in before if before[i] != after[i]}
    assert {after[i] for i in moved} == {shards}
    assert len(moved) == pytest.approx(len(before) / (shards + 1), rel=0.15)


def test_weights_decide_shares(ids):
    tree = [Shard(0, 0, 0, 3.0), Shard(0, 1, 1, 1.0), Shard(1, 0, 2, 2.0), Shard(1, 0, 3, 0.0)]
    counts = Counter(placed(ids, tree).values())
    assert set(counts) == {0, 1, 2}
    for shard, share in ((0, 3 / 6), (1, 1 / 6), (2, 2 / 6)):
        assert counts[shard] == pytest.approx(20_000 * share, rel=0.06)


def test_change_of_weight_moves_rows_only_into_or_out_of_its_subtree(ids):
    tree = default_tree(16)
    heavier = [Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 5 else 1.0) for s in tree]
    before, after = placed(ids, tree), placed(ids, heavier)
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved
    region = {s.shard: s.region for s in tree}
    # Moves end in the region that gained; rows already there only change into the shard's rack,
    # and rows of that rack only into the shard.
    assert {region[b] for _, b in moved} == {1}
    assert {b for a, b in moved if region[a] == 1} == {4, 5}
    assert {b for a, b in moved if a == 4} == {5}


def test_edge_cases(spark):
    df = cases.edge_table(spark)
    rows = shards_by_key(df, default_tree(16), default_tree(17)).collect()
    assert len(rows) == len(cases.edge_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in cases.edge_rows()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected


def test_slots_have_no_gaps(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text")
    rows = shards_by_key(df, default_tree(16)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_very_many_equal_rows(spark, monkeypatch):
    """A third of all rows has no identifier and one text: they are one row until they have their slots."""
    from orderlens.llm import sharding

    df = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, 't', 'u') AS text")
    counted, stored = [], sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda d, n: counted.append(stored(d, n)) or counted[-1])
    rows = shards_by_key(df, default_tree(16), default_tree(17)).collect()
    assert len(rows) == 30_000 and counted[0].count() == 20_001
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark):
    assert shards_by_key(cases.empty_table(spark), default_tree(16)).count() == 0


def test_tree_without_weight_is_an_error():
    with pytest.raises(ValueError):
        tree_shard([Shard(0, 0, 0, 0.0)])


def drawn(tree, doc_id):
    """The shard of an identifier by the same draws, one node at a time."""
    level, name, below = ["region", "rack", "shard"], "", list(tree)
    for key in level:
        draws = []
        for child in sorted({getattr(s, key) for s in below}):
            path = f"{name}/{key} {child}"
            bits = int(hashlib.md5(f"{path}|{doc_id}".encode()).hexdigest()[:12], 16)
            weight = sum(s.weight for s in below if getattr(s, key) == child)
            draws.append((-math.log((bits + 0.5) / (1 << 48)) / weight, child, path))
        _, child, name = min(draws)
        below = [s for s in below if getattr(s, key) == child]
    return below[0].shard


def test_query_against_brute_force(spark):
    directory = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op10_sharding(spark, directory).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == drawn(default_tree(16), r.doc_id)
        assert r.grown_shard == drawn(default_tree(17), r.doc_id)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
