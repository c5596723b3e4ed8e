import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

from factloom.llm import sharding


def test_tightest_capacity_is_taken():
    chance, tree, plain = random.Random(1), sharding.Capacities(), []
    for step in range(5000):
        if chance.random() < 0.6 or not plain:
            item = (chance.randint(1, 500), step)
            tree.add(item)
            plain.append(item)
        else:
            size = chance.randint(1, 520)
            wanted = min((item for item in plain if item[0] >= size), default=None)
            assert tree.take_tightest(size) == wanted
            if wanted:
                plain.remove(wanted)


def test_best_fit_decreasing_by_brute_force():
    chance = random.Random(2)
    for _ in range(200):
        sizes = sorted((chance.randint(1, 90) for _ in range(chance.randint(0, 40))), reverse=True)
        loads = []
        for size in sizes:
            fitting = [at for at, load in enumerate(loads) if load + size <= 100]
            if fitting:
                best = max(fitting, key=lambda at: (loads[at], -at))
                loads[best] += size
            else:
                loads.append(size)
        placed = Counter()
        for size, number in zip(sizes, sharding.best_fit_decreasing(sizes, 100)):
            placed[number] += size
        assert sorted(placed.values()) == sorted(loads)


def test_bins_are_even_and_a_giant_stands_alone():
    chance = random.Random(4)
    sizes = sorted((chance.randint(1, 50) for _ in range(2000)), reverse=True)
    placed = sharding.into_bins([100_000, *sizes], 16)
    loads = Counter()
    for size, number in zip([100_000, *sizes], placed):
        loads[number] += size
    assert loads[placed[0]] == 100_000 and len(loads) == 16
    rest = [load for number, load in loads.items() if number != placed[0]]
    assert max(rest) - min(rest) <= 10


def test_equal_items_are_spread_evenly():
    loads = Counter(sharding.into_bins([16] * 2000, 15))
    assert set(loads.values()) <= {133, 134}
    assert sharding.into_bins([5, 5], 16) == [0, 1] and sharding.into_bins([], 16) == []


def check(rows):
    slots, shard_of = defaultdict(list), {}
    for row in rows:
        slots[row["shard"]].append(row["slot"])
        assert 0 <= row["shard"] < 16 and row["law"] == "bytes" and row["grown_shard"] is None
        assert shard_of.setdefault((row["text_crc32"], row["size"]), row["shard"]) == row["shard"]
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_documents_with_odd_values(odd_documents):
    given = odd_documents.select("doc_id", "text").collect()
    rows = sharding.into_shards(odd_documents).collect()
    check(rows)
    expected = sorted(
        (str(r["doc_id"]), len((r["text"] or "").encode()) + 1, crc32((r["text"] or "").encode())) for r in given
    )
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == expected


def test_hot_group_and_empty_table(spark, no_documents):
    texts = ["copy"] * 4000 + [f"text {at} " * (at % 50) for at in range(8000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.into_shards(frame).collect()
    check(rows)
    loads = Counter()
    for row in rows:
        loads[row["shard"]] += row["size"]
    assert len(rows) == len(texts) and max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())
    assert sharding.into_shards(no_documents).collect() == []


def test_fixed_capacity(odd_documents):
    loads, groups, keys = Counter(), Counter(), Counter()
    for row in sharding.fixed_capacity(odd_documents, 5000).collect():
        loads[row["bin"]] += row["bytes"]
        groups[row["bin"]] += 1
        keys[bytes(row["key"])] += row["rows"]
    # Only a group that is too large by itself exceeds its bin.
    assert all(load <= 5000 or groups[name] == 1 for name, load in loads.items())
    texts = Counter(sha256((r["text"] or "").encode()).digest() for r in odd_documents.collect())
    assert keys == texts and len(loads) < len(texts)
