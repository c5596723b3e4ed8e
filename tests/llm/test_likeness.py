import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from factloom.llm import fingerprints, minhash, neighbours, simhash


# --- fingerprints ---------------------------------------------------------------------


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_peeling_recovers_the_differences():
    chance = np.random.default_rng(1)
    numbers = lambda n: chance.integers(0, 2**63, n).astype(np.uint64)
    shared = numbers(500)
    left = np.concatenate([shared, numbers(9)])
    right = np.concatenate([shared, numbers(6)])
    done, here, there, _, found = fingerprints.Sketches([left], 32).minus(fingerprints.Sketches([right], 32)).peel()
    assert done.all() and (here[0], there[0]) == (9, 6)
    assert set(found.tolist()) == set(left.tolist()) ^ set(right.tolist())


def test_likeness_grows_sketches_until_they_peel():
    chance = np.random.default_rng(2)
    sets = [chance.integers(0, 300, size).astype(np.uint64) for size in (0, 0, 1, 5, 50, 250, 250, 2)]
    sets = [np.unique(found) for found in sets]
    pairs = [(a, b) for a in sets for b in sets]
    result = fingerprints.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert result.tolist() == pytest.approx([jaccard(a, b) for a, b in pairs])


def test_digests_tell_copies_of_a_paragraph_apart():
    assert len(set(fingerprints.digests("Same.\nSame.\nSame.\n").tolist())) == 3
    assert len(fingerprints.digests("")) == 0
    assert "".join(fingerprints._PARAGRAPH.findall("\n\na b. c!? ...\nd" * 9)) == "\n\na b. c!? ...\nd" * 9


def by_brute_force(rows):
    tie = lambda text: text
    rows = sorted(rows, key=lambda row: (row[0] is None, -(row[0] or 0), tie(row[1])))
    out = []
    for at, (doc_id, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        new = fingerprints.edited(text, following)
        own = fingerprints.digests(text)
        out.append(
            (
                doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(),
                round(jaccard(own, fingerprints.digests(new)), 9),
                round(jaccard(own, fingerprints.digests(following)), 9),
            )
        )
    return Counter(out)


def test_fingerprints_of_documents(spark, odd_documents, no_documents):
    unique = odd_documents.dropDuplicates(["doc_id"])
    given = [(r["doc_id"], r["text"] or "") for r in unique.select("doc_id", "text").collect()]
    rows = fingerprints.fingerprinted(unique).collect()
    got = Counter(
        (r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows
    )
    assert got == by_brute_force(given)
    of_text = {}
    text = dict(given)
    for row in rows:
        assert of_text.setdefault(text[row["doc_id"]], row["fingerprint"]) == row["fingerprint"]
        if hashlib.sha256(text[row["doc_id"]].encode()).hexdigest() == row["edited_sha256"]:
            assert row["edited_fingerprint"] == row["fingerprint"] and row["near_edited"] == 1.0
    assert fingerprints.fingerprinted(odd_documents).count() == odd_documents.count()
    assert fingerprints.fingerprinted(no_documents).collect() == []
    alone = spark.createDataFrame([(5, "one two three")], "doc_id long, text string")
    assert [r["near_next"] for r in fingerprints.fingerprinted(alone).collect()] == [1.0]


# --- near-duplicates ------------------------------------------------------------------


def simhash_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[at : at + 4]) for at in range(len(words) - 3)] or [" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashed) * 2 > len(hashed))


def test_simhash_by_hand(odd_documents):
    for row in odd_documents.select("text").collect():
        text = (row["text"] or "")[:3000]
        assert simhash.fingerprint(text) == simhash_by_hand(text)


def connected(values, radius):
    """Smallest member of each value's component, by all pairs."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a in range(len(values)):
            for b in range(a):
                if (values[a] ^ values[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def clustered(seed, clusters, members, flips):
    chance = random.Random(seed)
    values = set()
    for _ in range(clusters):
        centre = chance.getrandbits(64)
        for _ in range(members):
            value = centre
            for _ in range(chance.randint(0, flips)):
                value ^= 1 << chance.randrange(64)
            values.add(value)
    return sorted(values)


@pytest.mark.parametrize("clusters, members, flips", [(1, 150, 3), (20, 9, 3), (120, 1, 0), (4, 40, 6)])
def test_index_finds_all_components(clusters, members, flips):
    values = clustered(7, clusters, members, flips)
    array = np.array(values, dtype=np.uint64)
    ordered = array[np.argsort(simhash.gray_rank(array))]
    got = simhash.linked(ordered, 4)
    names = {int(v): got[at] for at, v in enumerate(ordered)}
    wanted = connected(values, 4)
    groups = lambda label: {frozenset(v for v in values if label(v) == one) for one in set(map(label, values))}
    assert groups(lambda v: names[v]) == groups(lambda v: wanted[values.index(v)])


def test_gray_rank_orders_the_gray_sequence():
    codes = np.array([at ^ at >> 1 for at in range(200)], dtype=np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(200))


@pytest.mark.parametrize("limit", [500_000, 3])
def test_edges_connect_what_links_connect(spark, limit):
    values = clustered(8, 12, 20, 3) + clustered(9, 60, 1, 0)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    rooted = {r["fp"]: r["root"] for r in simhash.roots(simhash.edges(nodes, 4, limit)).collect()}
    ours = {v: rooted.get(v, v) for v in signed}
    wanted = connected(values, 4)
    by = lambda names: {frozenset(at for at in range(len(values)) if names[at] == one) for one in names}
    assert by([ours[v] for v in signed]) == by(wanted)


def test_long_chain_is_one_component(spark):
    values, value = [], 0
    for bit in range(64):
        value |= 1 << bit
        values.append(value)
    nodes = spark.createDataFrame([(v,) for v in np.array(values[::3], dtype=np.uint64).view(np.int64).tolist()], "fp long")
    assert simhash.roots(simhash.edges(nodes)).select("root").distinct().count() == 1


def test_near_duplicates_of_odd_documents(odd_documents, no_documents):
    given = [(r["doc_id"], simhash.fingerprint(r["text"] or "")) for r in odd_documents.select("doc_id", "text").collect()]
    values = sorted({fp for _, fp in given})
    label = connected(values, 4)
    first = {}
    for doc_id, fp in given:
        root = label[values.index(fp)]
        if doc_id is not None:
            first[root] = min(first.get(root, doc_id), doc_id)
    wanted = Counter((doc_id, f"{fp:016x}", first.get(label[values.index(fp)])) for doc_id, fp in given)
    assert Counter(map(tuple, simhash.near_duplicates(odd_documents).collect())) == wanted
    assert simhash.near_duplicates(no_documents).collect() == []

    kept = simhash.keep_first(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter(first.values()) + Counter({None: sum(doc_id is None for doc_id, _ in given)})


# --- nearest neighbours ---------------------------------------------------------------


def test_chi_square_distribution():
    assert neighbours.chi_square(0) == 0
    assert neighbours.chi_square(neighbours.quantile(0.95)) == pytest.approx(0.95)
    assert neighbours.quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def test_tree_gives_points_in_order():
    points = np.random.default_rng(3).normal(size=(1000, neighbours.DIMENSIONS))
    row = np.zeros(neighbours.DIMENSIONS)
    away, seen, before = (points**2).sum(axis=1), [], 0.0
    for some, reach in neighbours.Tree(points).nearest(row):
        assert away[some].min() >= before and away[some].max() <= reach
        before = 0.0 if not seen else before
        seen += some.tolist()
        rest = np.setdiff1d(np.arange(1000), seen)
        assert not len(rest) or away[rest].min() >= min(reach, away[rest].min())
    assert sorted(seen) == list(range(1000))


def test_neighbours_by_brute_force(spark):
    chance = np.random.default_rng(4)
    vectors = chance.normal(size=(3000, 16)).astype(np.float32)
    vectors[500:900] = vectors[0]
    rows = [(at, vector.tolist()) for at, vector in enumerate(vectors)]
    odd = [
        (5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [float("inf")] + [1.0] * 15),
        (5200, [None] + [1.0] * 15), (None, [1.0] * 16), (50, vectors[50].tolist()), (7, vectors[7].tolist()),
    ]
    frame = spark.createDataFrame(
        [(*row, "x", 0.1, 1) for row in rows + odd], "vec_id long, embedding array<float>, key string, score double, rank int"
    )
    got = {}
    for row in neighbours.nearest(frame.repartition(4)).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    wide = vectors.astype(float)
    norms = np.sqrt((wide**2).sum(axis=1))
    hits = total = 0
    assert set(got) == set(range(0, 3000, 50))
    for query in range(0, 3000, 50):
        cosine = wide @ wide[query] / (norms * norms[query])
        order = [at for at in np.lexsort((np.arange(3000), -np.round(cosine, 12))) if at != query][:5]
        assert sorted(got[query]) == [1, 2, 3, 4, 5]
        found = [got[query][rank] for rank in range(1, 6)]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for at, score in found:
            assert score == pytest.approx(cosine[at], abs=1e-12)
        hits += len({at for at, _ in found} & set(order))
        total += 5
    assert hits / total >= 0.95
    assert [got[0][rank][0] for rank in range(1, 6)] == [500, 501, 502, 503, 504]


def test_cells_of_a_deep_tree_hold_the_sample():
    sample = np.random.default_rng(5).normal(size=(2000, neighbours.DIMENSIONS))
    cells = neighbours.Cells(sample, 4)
    home = cells.of(sample)
    assert np.bincount(home, minlength=16).min() > 60
    for at in range(0, 2000, 111):
        assert home[at] in cells.within(sample[at], 1e-9)
        near = np.flatnonzero(((sample - sample[at]) ** 2).sum(axis=1) <= 4.0)
        assert set(home[near]) <= set(cells.within(sample[at], 2.0))


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0])], kind)
    rows = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(few).collect())
    assert rows == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(few.limit(0)).collect() == []


# --- the near-duplicate stage ---------------------------------------------------------


def shingles_by_hand(text):
    words = (text or "").lower().split()
    return {tuple(words[at : at + 5]) for at in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stage_links_all_pairs_of_likeness_from_four_fifths(spark):
    chance = random.Random(21)
    vocabulary = [f"w{at}" for at in range(3000)]
    texts = []
    for size in (1, 4, 5, 6, 30, 80, 200, 400):
        for _ in range(6):
            base = [chance.choice(vocabulary) for _ in range(size)]
            for _ in range(6):
                words = list(base)
                for _ in range(chance.randint(0, max(1, size // 40))):
                    words[chance.randrange(size)] = chance.choice(vocabulary)
                texts.append(" ".join(words))
    texts += [texts[50]] * 5 + ["", " "]
    sets = [shingles_by_hand(text) for text in texts]
    label, pairs, far = list(range(len(texts))), 0, 0
    for a in range(len(texts)):
        for b in range(a):
            whole = len(sets[a] | sets[b])
            if not whole or len(sets[a] & sets[b]) >= 0.8 * whole:
                pairs += 1
                far += (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 4
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if one == old else one for one in label]
    assert far > pairs / 10
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.keep_first(frame).collect()) == sorted(set(label))


def test_stage_judges_texts_of_one_id_by_themselves(spark):
    chance = random.Random(22)
    one, two, three = (" ".join(str(chance.random()) for _ in range(40)) for _ in range(3))
    rows = [(1, one), (2, two), (2, f"{one} more"), (2, two), (3, three), (3, one)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect())) == sorted([(1, one), (2, two), (3, three)])
    both = spark.createDataFrame([(1, one), (1, two)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_first(both).collect()) == sorted([one, two])


def test_links_are_within_the_radius_and_connect_what_all_links_connect():
    values = clustered(10, 12, 20, 4) + clustered(11, 60, 1, 0)
    keys = np.arange(len(values)) % 2
    rows = np.array(values, dtype=np.uint64)
    left, right = simhash.bucket_links(keys, rows, minhash.RADIUS)
    assert len(left) and (keys[left] == keys[right]).all()
    assert (np.bitwise_count(rows[left] ^ rows[right]) <= minhash.RADIUS).all()
    label = simhash.components(len(values), left, right, np.arange(len(values)))
    for key in (0, 1):
        own = connected([value for value, of in zip(values, keys) if of == key], minhash.RADIUS)
        assert label[keys == key].tolist() == np.flatnonzero(keys == key)[own].tolist()


def test_stage_finds_links_by_fingerprints_without_bands(spark, monkeypatch):
    chance = random.Random(23)
    texts = []
    for size in (150, 300, 600):
        for _ in range(4):
            base = [f"w{chance.randrange(3000)}" for _ in range(size)]
            for change in range(3):
                texts.append(" ".join([*base[: size - change], *["other"] * change]))
    texts += [texts[0].upper(), "", None, "a b"]
    sets = [minhash.shingles(text or "") for text in texts]
    bits = [simhash.majority(one) for one in sets]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= minhash.RADIUS]
    assert all(minhash.likeness(sets[a], sets[b]) >= 0.8 for a, b in pairs) and len(pairs) > 24
    kept = set(connected(bits, minhash.RADIUS))
    monkeypatch.setattr(minhash, "band_keys", lambda hashes: [minhash.node_of(hashes)])
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.keep_first(frame).collect()} == kept


def test_stage_confirms_what_fingerprints_link(spark, monkeypatch):
    texts = [" ".join(f"{name}{at}" for at in range(40)) for name in "abc"] + ["a0 a1 a2"]
    monkeypatch.setattr(minhash, "majority", lambda hashes: 7)
    frame = spark.createDataFrame([*enumerate(texts + texts[:2])], "doc_id long, text string").repartition(3)
    nodes = minhash.nodes_of(frame).groupBy("node", "fp").count()
    assert simhash.links(nodes, minhash.RADIUS).select("a").distinct().count() == 4
    assert sorted(r["doc_id"] for r in simhash.keep_first(frame).collect()) == [0, 1, 2, 3]
