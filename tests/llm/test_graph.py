import random

import pytest

from netloom.llm.graph import components


def brute(links):
    label = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(label.items())


@pytest.mark.parametrize("held", [1 << 19, 0])
def test_components(spark, held):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(-40, 60)] + [(1000, i) for i in range(1001, 1400)] + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(300)]
    links += [(7, 7), (None, 3), (5000, 5000), (1 << 62, -(1 << 62)), (3, 2), (3, 2)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = sorted((x["node"], x["component"]) for x in components(df, held).collect())
    assert got == [x for x in brute(links) if x[0] != 5000]


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
