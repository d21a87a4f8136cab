"""The decontamination against brute force over all passages and items, whatever the blocks."""

import random

import pytest

from tidelake.llm import decontaminate as dc


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(row[-1], before[k + 1]))
    return row[-1]


def brute(docs, items):
    """Each half passage with as many words beside it as the item has; the largest share, first place."""
    out = []
    for doc, text in docs:
        words = (text or "").split()
        for item, told in items:
            own = (told or "").split()
            best = (0.0, 0)
            for at in range(0, len(words) if own else 0, dc.HALF):
                low, high = max(at - len(own), 0), min(at + 2 * dc.HALF + len(own), len(words))
                region = words[low:high]
                share = subsequence(own, region) / len(own)
                answer = own[-dc.ANSWER :]
                there = any(region[k : k + len(answer)] == answer for k in range(len(region)))
                if (share >= dc.SURE or share >= dc.MAYBE and there) and share > best[0]:
                    best = (share, low)
            if best[0]:
                out.append((doc, item, best[0], best[1]))
    return sorted(out)


@pytest.mark.parametrize("block", [2, 2000])
def test_contaminated_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "ITEMS", block)
    rand = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rand.choices(words, k=rand.choice([3, 6, 12, 20])))) for k in range(8)] + [(20, ""), (21, None)]
    docs = []
    for k in range(30):
        own = items[k % 8][1].split()
        some = [w if rand.random() < 0.5 + k / 60 else rand.choice(words) for w in own]
        prose = rand.choices(words, k=rand.randint(0, 150))
        at = rand.randint(0, len(prose))
        docs.append((k, " ".join([*prose[:at], *some, *prose[at:], *(own if k % 5 == 0 else [])])))
    docs += [(40, None), (41, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench)
    assert sorted(map(tuple, found.collect())) == brute(docs, items)
