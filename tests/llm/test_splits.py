import random

from textloom.llm.splits import assign_splits, crossing_keys, key_components, split_shares


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for g, k in edges:
        a, b = root(("g", g)), root(("k", k))
        parent[max(a, b)] = min(a, b)
    groups = {}
    for g, k in edges:
        groups.setdefault(root(("k", k)), set()).add(k)
    return {k: min(v) for v in groups.values() for k in v}


def test_components_match_brute_force(spark):
    random.seed(5)
    edges = [(f"g{random.randrange(60)}", f"k{random.randrange(90):02d}") for _ in range(110)]
    edges += [(f"c{i}", f"chain{i + j:03d}") for i in range(120) for j in (0, 1)] + [("hub", f"h{i}") for i in range(300)]
    frame = spark.createDataFrame([*edges, (None, "k01"), ("g1", None), ("g1", " ")], "g string, k string")
    found = {r.alignment_key: r.component_key for r in key_components(frame, group="g", key="k").collect()}
    assert found == union_find(edges)


def test_crossing_keys(spark):
    locales = spark.createDataFrame(
        [(" A", "train"), ("a ", "TRAIN "), ("b", "valid"), ("c", "dev"), ("c", "validation"), ("d", "test"), ("d", None), (None, "train"), ("e", "train"), ("e", "dev"), ("e", "dev")],
        "alignment_key string, split string",
    )
    samples = spark.createDataFrame([("g", "A"), ("g", "B"), ("g", "x"), (None, "c"), (None, "d"), ("h", "d"), ("h", None)], "group string, alignment_key string")
    found = sorted(map(tuple, crossing_keys(locales, samples).collect()))
    assert found == [("a", "a"), ("b", "a"), ("e", "e"), ("x", "a")]
    assert crossing_keys(locales.limit(0), samples.limit(0)).count() == 0


def test_assignment_meets_shares_and_is_stable(spark):
    random.seed(1)
    rows = [(f"c{i}", random.choice("xyz"), random.choice([1, 1, 2, 5])) for i in range(3000)] + [("giant", "x", 900), (None, "x", 3)]
    labelled = spark.createDataFrame(rows, "component string, label string, records long")
    targets = spark.createDataFrame([("Train", 0.8), ("valid", 0.1), ("test", 0.1)], "split string, share double")
    given = {r.component: r.split for r in assign_splits(labelled, targets).collect()}
    assert len(given) == 3001
    sizes, labels = {}, {}
    for c, label, n in rows:
        if c:
            sizes[given[c]] = sizes.get(given[c], 0) + n
            labels[given[c], label] = labels.get((given[c], label), 0) + n
    total = sum(sizes.values())
    assert abs(sizes["train"] / total - 0.8) < 0.02 and abs(sizes["dev"] / total - 0.1) < 0.015
    for label in "xyz":
        whole = sum(n for (s, x), n in labels.items() if x == label)
        assert abs(labels["test", label] / whole - 0.1) < 0.05
    assert given == {r.component: r.split for r in assign_splits(labelled.repartition(3), targets).collect()}


def test_labels_are_balanced_even_where_components_mix_them(spark):
    random.seed(12)
    rows = []
    for i in range(4000):
        for label in random.sample(["x", "y", "z", None, "rare"], k=random.choice([1, 2, 3])):
            if label != "rare" or random.random() < 0.05:
                rows.append((f"c{i}", label, random.choice([1, 2, 7])))
    rows += [("g1", "x", 300), ("g1", "y", 20), ("g2", "z", 250), ("g3", None, 200)]
    labelled = spark.createDataFrame(rows, "component string, label string, records long")
    targets = spark.createDataFrame([("train", 0.7), ("dev", 0.2), ("test", 0.1)], "split string, share double")
    given = assign_splits(labelled, targets)
    assert given.count() == len({c for c, _, _ in rows})
    shares = split_shares(labelled, given, targets).collect()
    assert len(shares) == 3 * 6 and sum(r.records for r in shares if r.whole) == sum(n for _, _, n in rows)
    assert max(abs(r.deviation) for r in shares if r.whole) < 0.005
    assert max(abs(r.deviation) for r in shares if r.label in ("x", "y", "z")) < 0.01
    assert max(abs(r.deviation) for r in shares if r.label == "rare") < 0.04
    assert assign_splits(labelled.limit(0), targets).count() == 0
    few = assign_splits(labelled.where("component in ('c1', 'c2', 'g1')"), targets)
    assert few.count() == 3
