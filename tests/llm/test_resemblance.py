"""Near copies by shingle sets against brute force."""

import random
from itertools import combinations

import corpus_pipeline
from casemill.llm import resemblance, simhash
from test_near import roots_of


def brute_groups(texts):
    """Text -> number of its group, by comparing all pairs."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    texts = [t or "" for t in texts]
    found = {t: shingles(t) for t in texts}
    order = sorted(found)
    links = [(i, j) for (i, a), (j, b) in combinations(enumerate(order), 2)
             if found[a] == found[b] or 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b])]
    root = roots_of(range(len(order)), links)
    return {t: root[i] for i, t in enumerate(order)}


def brute_kept(rows):
    group = brute_groups([t for _, t in rows])
    smallest = {}
    for i, t in rows:
        smallest[group[t or ""]] = min(i, smallest.get(group[t or ""], i))
    return sorted(smallest.values())


def made_texts():
    """Words changed one at a time, so similarities lie on both sides of 0.8, chains, and texts that share a long passage."""
    rng = random.Random(12)
    texts = [None, "", " ", "one two", "One  TWO", "one two three"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for changes in (0, 1, 2, 3, 4, 5, 8):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = "changed"
            texts.append(" ".join(copy))
        for _ in range(4):
            base[rng.randrange(200)] = f"c{rng.randrange(9)}"
            base[rng.randrange(200)] = f"d{rng.randrange(9)}"
            texts.append(" ".join(base))
    shared = [f"s{i}" for i in range(120)]
    return texts + [" ".join(shared + [f"o{i}x{j}" for j in range(40 + i % 3)]) for i in range(40)]


def test_near_copies(spark):
    rows = list(enumerate(made_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS copy", "2 AS n", "3 AS keys", "4 AS root")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_stage_keeps_no_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == brute_kept(rows)


def test_keys_find_similar_sets():
    rng = random.Random(6)
    lost = pairs = 0
    for _ in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), 4):
            copy[at] = "changed"
        a, b = resemblance.entry_of(" ".join(base)), resemblance.entry_of(" ".join(copy))
        x, y = (set(resemblance.shingles_of(" ".join(t))[1].tolist()) for t in (base, copy))
        if 5 * len(x & y) >= 4 * len(x | y):
            pairs += 1
            lost += not set(a[2]) & set(b[2])
    assert pairs > 100 and lost == 0


def test_a_large_group_of_near_copies_takes_few_comparisons(spark, monkeypatch):
    """Copies of one text that lie below 0.8 to each other, half of them with a closer sibling, and the text itself."""
    def made(copies, changes):
        rng = random.Random(9)
        base, texts, siblings = [f"w{i}" for i in range(200)], [], []
        for i in range(copies):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = f"c{i}x{at}"
            texts.append(copy)
            if i % 2:
                near = list(copy)
                near[rng.randrange(200)] = "once"
                siblings.append((len(texts) - 1, len(texts)))
                texts.append(near)
        return [" ".join(t) for t in texts], siblings

    compared = []
    whole = resemblance.similar
    monkeypatch.setattr(resemblance, "similar", lambda pairs, known: compared.append(pairs.count()) or whole(pairs, known))
    counts = []
    for copies in (100, 400):
        texts, siblings = made(copies, 6)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        entries = docs.select(resemblance.entry("text").alias("e"), "text").select("e.*", "text")
        compared.clear()
        root = {r.copy: r.root for r in resemblance.groups(entries).collect()}
        of = [root[resemblance.entry_of(t)[0]] for t in texts]
        caught = sum(of[a] == of[b] for a, b in siblings)
        assert caught >= 0.95 * len(siblings), (copies, caught, len(siblings))
        counts.append(sum(compared))
    assert counts[1] < 8 * counts[0], counts  # four times the texts; all pairs would be sixteen times


def test_entries_of_a_batch_need_little_memory():
    """A batch's hashes are arrays: some 700 bytes a text at most, not Python numbers by the hundred."""
    import tracemalloc

    import pyarrow as pa
    texts = [None, "", "one two", *[f"word{i} " * 3 + "a b c d e f" for i in range(2000)]]
    given = pa.array(texts, pa.string())
    resemblance.entries(given.slice(0, 10))
    tracemalloc.start()
    found = resemblance.entries(given)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1300 * len(texts)
    rows = found.to_pylist()
    for i in (0, 1, 2, 3, 999, 2002):
        assert tuple(rows[i].values()) == resemblance.entry_of(texts[i])


def test_a_tree_finds_the_nearest():
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(14))) for p in prints for _ in range(4)]
    tree = resemblance.Tree()
    for i, p in enumerate(prints):
        apart = [((p ^ q).bit_count(), j) for j, q in enumerate(prints[:i]) if j % 3]
        got = tree.near(p, 24, 5, lambda j: j % 3 > 0)
        want = sorted(x for x in apart if x[0] <= 24)[:5]
        assert [x for x, _ in got] == [x for x, _ in want] and set(got) <= set(apart)
        tree.add(p)


def test_candidates_are_near_by_fingerprint(spark, monkeypatch):
    """Pairs come from the trees, so they differ in few bits, and a text of a large group is compared a few times."""
    rng = random.Random(4)
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(1, 6)):
            copy[at] = f"c{i}x{at}"
        texts.append(" ".join(copy))
    asked = []
    whole = resemblance.plausible
    monkeypatch.setattr(resemblance, "plausible", lambda pairs, marks: asked.extend(pairs.collect()) or whole(pairs, marks))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = docs.select(resemblance.entry("text").alias("e"), "text").select("e.*", "text").localCheckpoint()
    roots = {r.root for r in resemblance.groups(entries).collect()}
    of = {r.copy: r.print & resemblance.UNSIGNED for r in entries.collect()}
    assert asked and all((of[r.a] ^ of[r.b]).bit_count() <= resemblance.RADIUS for r in asked)
    assert len(asked) < 30 * len(texts), len(asked)  # three orders of at most 1, 8 and 16; with all keys on their own, hundreds
    most = len(texts) - len(set(brute_groups(texts).values()))
    assert most > 200 and len(texts) - len(roots) >= 0.95 * most


def test_no_link_of_a_large_group_is_left_out(spark, monkeypatch):
    """Groups of near copies exactly as by brute force, with links that no few nearest neighbours show, over several tiles."""
    rng = random.Random(4)
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(1, 8)):
            copy[at] = f"c{i}x{at}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(resemblance, "TILE", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = docs.select(resemblance.entry("text").alias("e"), "text").select("e.*", "text").localCheckpoint()
    of = {r.text: r.copy for r in entries.collect()}
    root = {r.copy: r.root for r in resemblance.groups(entries).collect()}
    want = brute_groups(texts)
    assert len({(want[t], root[of[t]]) for t in texts}) == len(set(want.values())) == len(set(root.values()))
