import numpy as np

from bandwise.llm import minhash
from bandwise.llm.simhash import fingerprint


def test_simhash_links_propose_near_copies(spark, monkeypatch):
    """Without any MinHash key, near copies of at most 2 differing bits are still found, and no others."""
    monkeypatch.setattr(minhash, "band_keys", lambda found: np.zeros(0, np.int64))
    rng = np.random.default_rng(5)
    texts = []
    for many in (1, 1, 1, 1, 2, 2, 3, 60):
        words = [f"w{k}" for k in rng.integers(0, 5_000, 4_000)]
        other = list(words)
        for k in rng.choice(len(words), many, replace=False):
            other[k] = "changed"
        texts += [" ".join(words), " ".join(other)]
    near = [bin((fingerprint(a, minhash.WORDS) ^ fingerprint(b, minhash.WORDS)) % (1 << 64)).count("1") <= 2
            for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert 2 <= sum(near) < len(near)
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_copies(table).collect()}
    assert got == {k: k - 1 if k % 2 and near[k // 2] else k for k in range(len(texts))}


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def brute_force(texts):
    """The least position in the table that each text reaches by pairs of similarity 0.8 or more."""
    sets, least = [shingle_set(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if least[a] != least[b] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    return least


def one_crowd(spark, monkeypatch, texts, few, joined=()):
    """Components where all texts share a key, so that all stand in one crowd, each tuple in `joined` shares one more, and
    `few` is the most for pairs."""
    own = {minhash.shingles(texts[i]).tobytes(): k for k, group in enumerate(joined, 1) for i in group}
    monkeypatch.setattr(minhash, "band_keys", lambda found: np.array([0, own.get(found.tobytes(), 0)], np.int64)[:1 + (found.tobytes() in own)])
    monkeypatch.setattr(minhash, "PAIR_BUCKET", few)
    monkeypatch.setattr(minhash, "TILE", 500)  # families of several blocks
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    return {r.doc_id: r.component_id for r in minhash.near_copies(table).collect()}


def test_crowd_links_other_than_the_least_members(spark, monkeypatch):
    """Two pairs of near copies in a crowd, of which the second of one and the first of the other are near copies."""
    texts, joined = [], []
    for at in range(30):
        joined += [(len(texts), len(texts) + 1), (len(texts) + 2, len(texts) + 3)]
        for k in range(4):  # each replaces the next 5 words of the one before
            texts.append(" ".join([f"new{at}x{j}" for j in range(5 * k)] + [f"v{at}x{j}" for j in range(5 * k, 100)]))
    want = brute_force(texts)
    assert want == [i - i % 4 for i in range(120)]
    assert one_crowd(spark, monkeypatch, texts, 64, joined) == dict(enumerate(want))


def test_crowd_of_texts_built_from_the_same_paragraphs(spark, monkeypatch):
    """Texts put together from common paragraphs share frequent shingles only, and not the same ones."""
    rng = np.random.default_rng(4)
    texts = []
    for at in range(24):
        pool = [" ".join(f"p{at}x{k}x{j}" for j in range(rng.integers(8, 16))) for k in range(14)]
        for _ in range(rng.integers(8, 20)):
            taken = [p for p in pool if rng.random() < 0.9]
            own = [f"own{rng.integers(1 << 40)}" for _ in range(rng.integers(0, 25))]
            texts.append(" ".join([*taken, *own]))
    texts = [texts[k] for k in rng.permutation(len(texts))]
    want = brute_force(texts)
    assert 24 < len(set(want)) < len(texts) - 24
    assert one_crowd(spark, monkeypatch, texts, 3) == dict(enumerate(want))
