import numpy as np

import corpus_pipeline
import __spark_entry__ as entry_points
from bandwise.llm import minhash
from bandwise.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "passages", "decontamination", "packing"]
    start = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and 0.7 * start < kept.count() <= start
        docs = written(kept)


def test_registered():
    names = set(entry_points.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def planted(rng):
    """Random-word texts, copies of them with substituted words, and a crowd around one text."""
    word = [f"w{k}" for k in range(3_000)]

    def changed(text, many):
        w = text.split()
        for k in rng.choice(len(w), many, replace=False):
            w[k] = f"new{rng.integers(1 << 40)}"
        return " ".join(w)

    texts = [None, "", " ", "one two", "One  two", "one three"]
    for n, many in ((200, 1), (200, 4), (200, 9), (500, 5), (500, 10), (500, 30), (1000, 10), (1000, 20)):
        for _ in range(12):
            text = " ".join(word[i] for i in rng.integers(0, len(word), n))
            texts += [text, changed(text, many)]
    crowd = " ".join(word[i] for i in rng.integers(0, len(word), 300))
    texts += [changed(crowd, int(rng.integers(1, 4))) for _ in range(90)]
    passage = " ".join(word[i] for i in rng.integers(0, len(word), 150))
    texts += [f"{passage} {' '.join(word[i] for i in rng.integers(0, len(word), 40))}" for _ in range(90)]
    return texts


def test_near_copies_are_those_of_brute_force(spark):
    texts = planted(np.random.default_rng(11))
    table = spark.createDataFrame([*enumerate(texts), (None, texts[6])], "doc_id long, text string").repartition(5)
    sets = [shingle_set(t) for t in texts]
    want, todo = {}, set(range(len(texts)))
    while todo:
        group, fresh = set(), [min(todo)]
        while fresh:
            x = fresh.pop()
            group.add(x)
            fresh += [y for y in todo - group - set(fresh) if similar(sets[x], sets[y])]
        todo -= group
        want |= dict.fromkeys(group, min(group))
    got = [(r.doc_id, r.component_id) for r in minhash.near_copies(table).collect()]
    assert (None, None) in got and len(got) == len(texts) + 1
    assert {i: c for i, c in got if i is not None} == want
    kept = corpus_pipeline.drop_near_copies(spark, table, FOLDER).collect()
    assert {r.doc_id for r in kept} == set(want.values()) | {None}
    assert minhash.near_copies(table.limit(0)).count() == 0


def test_band_recall_at_the_limit():
    """Pairs of similarity 0.8 to 0.82 share a key."""
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(1_000):
        x = rng.integers(0, 1 << 63, 180, dtype=np.int64).astype(np.uint64)
        y = np.concatenate([x[:162], rng.integers(0, 1 << 63, 20, dtype=np.int64).astype(np.uint64)])
        met += bool((minhash.band_keys(np.unique(x)) == minhash.band_keys(np.unique(y))).any())
    assert met >= 998


def changed_places(rng, words, many):
    words = list(words)
    for k in rng.choice(len(words), many, replace=False):
        words[k] = f"new{rng.integers(1 << 40)}"
    return words


def test_no_link_is_lost_in_a_crowd(spark):
    """300 texts share a long passage that alone does not make them similar; 60 of them have a near copy."""
    rng = np.random.default_rng(5)
    word = [f"w{k}" for k in range(5_000)]

    def drawn(n):
        return [word[i] for i in rng.integers(0, len(word), n)]

    passage = drawn(600)
    texts = [drawn(50) + passage + drawn(60) for _ in range(300)]
    copies = [texts[5 * k][:50] + changed_places(rng, passage, 10) + texts[5 * k][650:] for k in range(60)]
    sets = [shingle_set(" ".join(t)) for t in texts + copies]
    assert all(similar(sets[5 * k], sets[300 + k]) for k in range(60)) and not similar(sets[0], sets[1])
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + copies)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_copies(table).collect()}
    assert sum(got[300 + k] == got[5 * k] for k in range(60)) == 60


def grub(k):
    return ["grubnak", "grubnaks", "grubnakish"][k % 3]


def test_whole_run_against_plain_python(spark, tmp_path):
    """Planted toxic texts, near copies, a repeated passage, a benchmark passage, null and clashing ids, no n_chars."""
    rng = np.random.default_rng(8)
    word = [f"w{k}" for k in range(4_000)]

    def prose(n):
        return " ".join(word[i] for i in rng.integers(0, len(word), n))

    clean = [prose(int(rng.integers(40, 200))) for _ in range(300)]
    toxic = [f"{prose(15)} {grub(k)} {prose(15)}" for k in range(120)]
    item, passage = prose(40), prose(70)
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    rows += [(1_000, " ".join(changed_places(rng, clean[7].split(), 1))), (1_001, clean[8])]  # copies
    rows += [(1_100 + k, f"{prose(60)} {passage} {prose(60)}") for k in range(3)]
    rows += [(1_200, f"{prose(50)} {item} {prose(50)}")]
    rows += [(None, f"{prose(15)} grubnak {prose(15)}"), (None, prose(50)), (None, f"{prose(50)} {item}")]
    rows += [(1_300, prose(60)), (1_300, prose(70)), (1_300, f"{prose(9)} grubnaks {prose(9)}"), (1_301, prose(80)), (1_302, None)]
    rows += [rows[-2]]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(0, 420)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    stages, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source"]
        stages.append([(r.doc_id, r.text) for r in docs.collect()])

    def order(found):
        return sorted(found, key=str)

    after_toxic = [r for r in rows if "grubnak" not in (r[1] or "")]
    assert order(stages[0]) == order(after_toxic)
    after_copies = [r for r in dict.fromkeys(after_toxic) if r[0] not in (1_000, 1_001)]
    assert order(stages[1]) == order(after_copies)
    seen, after_cut = set(), []
    for i, t in sorted(after_copies, key=lambda r: (r[0] is None, r[0] or 0)):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        if i is not None:
            for p in range(len(b) - 99):
                if b[p:p + 100] in seen:
                    gone[p:p + 100] = b"\1" * 100
                seen.add(b[p:p + 100])
        after_cut.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()))
    assert order(stages[2]) == order(after_cut) and after_cut != after_copies
    after_leaks = [r for r in after_cut if item not in r[1]]
    assert order(stages[3]) == order(after_leaks) and len(after_leaks) == len(after_cut) - 2

    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    pieces = corpus_pipeline.run(spark, folder).collect()
    want = {}
    for i, t in after_leaks:
        want.setdefault(i, []).append(len(encode(t, add_special_tokens=False).ids) + 1)
    got = {}
    for r in pieces:
        assert r.length <= 2048 and (r.piece > 0) == (r.start > 0)
        got.setdefault(r.doc_id, []).append(r.length)
    assert {i: sorted(n) for i, n in got.items()} == {i: sorted(n) for i, n in want.items()}
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(map(sum, want.values())) // 2048) + 1


def test_stages_of_no_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_cut_passages_holds_one_python_worker_a_task(spark):
    """Python steps of one stage each hold a worker for every task, and workers stay with their memory."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = corpus_pipeline.cut_passages(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
    head = plan.split("Join")[0]
    assert head.count("MapInArrow") == 1
