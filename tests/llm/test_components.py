import random

import pytest

from barlane.llm import components as module
from barlane.llm.components import components


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
            if a in label and b in label:
                least = min(label[a], label[b])
                if label[a] != least or label[b] != least:
                    label[a] = label[b] = least
                    changed = True
    return label


def check(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = components(df).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got} == brute(links)


def test_chain_hub_and_odd_links(spark):
    chain = [(i + 1, i) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 50)]
    check(spark, [*chain, *hub, (5, 5), (7, 8), (7, 8), (None, 3), (-4, -9)])


@pytest.mark.parametrize("together", [3, 400_000])
def test_random(spark, monkeypatch, together):
    monkeypatch.setattr(module, "TOGETHER", together)
    monkeypatch.setattr(module, "BATCH_ROWS", 2)
    rng = random.Random(1)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(180)])


def test_no_links(spark):
    check(spark, [])
