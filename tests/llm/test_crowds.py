import random

from refloom.llm import jaccard_join as J


def test_a_crowd_of_near_copies_leaves_few_pairs(spark, monkeypatch):
    """What is far from a crowd's best copy asks so many others that nearly nothing of it is left to be compared with them all."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(400):
        words, at = list(base), rng.randrange(110)
        for k in range(rng.choice((1, 2, 3, 4))):
            words[(at + 3 * k + rng.randrange(2)) % 120] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left, before = [], J._Linker.expanded
    monkeypatch.setattr(J._Linker, "expanded", lambda self, pairs: left.append(pairs.count()) or before(self, pairs))
    found = {r.doc_id: r.component_id for r in J.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: find(i) for i in range(len(rows))}
    assert left[0] < len(rows)
