"""Filter audit, periodic runs and token files against brute force."""

import glob
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bandwise.llm import audit, html, runs, tokens, toxicity
from bandwise.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, id string, digest string, part string, n string, file string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", "q", "f") for i, t, lang in rows], DOCS).repartition(3)


# ---- filter audit


def audited(rows, labels):
    """Every order applied filter by filter to every row."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        key = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", key), key)
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
               "D": any(c in "#$%&*|" for c in t), "E": (i is None, i or 0) > least[t]}
        fails.append({f for f, b in bad.items() if b})
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        mine = [(f, i) for f, (i, _, lang) in zip(fails, rows, strict=True) if (lang or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                out[part, order, step] = [len(left), len(gone), sum(name in f for f, _ in mine) - len(gone), sum(f == {name} for f, _ in mine),
                                          sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for name in "ABCDE":
            keys = [(part, o, o.index(name) + 1) for o in audit.ORDERS]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def test_filter_audit(spark):
    rng = random.Random(4)
    plain = " ".join(f"w{k}" for k in range(150))
    texts = [None, "", " \t\n", plain, plain + " #", plain.upper(), "A " * 120, "é漢 " * 130, "same words " * 80, "x\x0by\x1cz " * 60,
             " ".join(f"long{k}" for k in range(60_000))]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(7, plain, "en"), (7, plain, "en"), (7, "other", "en"), (None, plain, "en"), (None, "only here", "fr"), (None, "only here", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(None, 1, 1), (900, 1, 1), (8, 1, 0), (8, 0, 1)]
    marks = spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = audit.filter_audit(docs(spark, rows), marks)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()} == audited(rows, labels)
    assert got.columns[3:] == list(audit.MEASURES)
    assert audit.filter_audit(docs(spark, rows[:1]).limit(0), marks).count() == 0
    none = audit.filter_audit(docs(spark, rows), marks.limit(0)).agg(F.sum("good_lost"), F.count("*")).first()
    assert tuple(none) == (0, 4 * 600 - (0 if {r[2] or "" for r in rows} == {"en", "de", "", "fr"} else 600))


def test_a_group_of_copies_arrives_as_few_rows(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    found = audit.tensors(many, labels).collect()
    assert [(sum(r.n), max(r.n), sum(r.good)) for r in found] == [(20_000, 19_999, 1)]


# ---- periodic runs


def slow_runs(w):
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def searched(texts):
    return [([(s, e - s, q) for s, e, q in rows.tolist()], rest) for rows, rest in runs._searched([t.split() for t in texts])]


def repetitive(rng):
    words = [b"a", b"b", b"c", b"dd", b"e"]
    fib = [[b"a"], [b"a", b"b"]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts = [b"", b"a", b"a " * 11, b"a " * 12, b"a " * 500, b" ".join(fib[-1]), b"a " * 100 + b"b " + b"a " * 100 + b"c " + b"a " * 60,
             (b"a " * 5 + b"b ") * 7 + (b"a " * 5 + b"c ") * 9]
    for k in range(300):
        few = words[:rng.randint(2, 5)]
        some = [rng.choice(few) for _ in range(rng.randint(1, 120))]
        if k % 3 == 0:  # a period, repeated with a fault
            root = [rng.choice(few) for _ in range(rng.randint(1, 40))]
            some += root * rng.randint(2, 6) + root[:rng.randint(0, len(root))]
            some[rng.randrange(len(some))] = b"z"
        if k % 3 == 1:  # repeats of repeats
            root = [rng.choice(few) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8) + [rng.choice(words)]
            some += root * rng.randint(2, 5) + some
        texts.append(b" ".join(some))
    for order in (2, 6):  # every gram twice in a primitive root
        root = [b"%d" % rng.randrange(order) for _ in range(90)]
        texts.append(b" ".join((root[:60] + root[:59] + [b"x"]) * 4))
    return texts


def test_runs_are_those_of_brute_force(monkeypatch):
    texts = repetitive(random.Random(7))
    want = [slow_runs(t.split()) for t in texts]
    assert sum(map(len, want)) > 400
    assert [r for r, _ in searched(texts)] == want
    monkeypatch.setattr(runs, "PAIRS", 3)
    assert [r for r, _ in searched(texts)] == want


def test_long_texts_of_one_word_stay_cheap():
    for text in (b"a " * 300_000, (b"- " * 2_000 + b"row ") * 100, b"a b c " * 100_000):
        (found, rest), = searched([text])
        assert found and len(rest) < 12_100
    assert searched([b"- " * 2_000 + b"row "] * 3)[1][0] == [(0, 2_000, 1)]


def run_row(i, text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    found = slow_runs(w)
    gone = {x for s, m, q in found for x in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = ["".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(x for k, x in enumerate(w) if k not in gone)]
    return (i, len(found), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2], *[hashlib.sha256(d.encode()).hexdigest() for d in digest])


def test_periodic_runs(spark):
    rng = random.Random(9)
    texts = [t.decode() for t in repetitive(rng)[:120]]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 200))) for _ in range(150)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "a b " * 30, "en"), (5, None, "en"), (5, "", "en"), (10, " \t\n ", "en")] * 2
    got = runs.run_digests(runs.periodic_runs(docs(spark, rows), rewrite=runs.planted))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((run_row(i, t) for i, t, _ in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows)
    plain = runs.periodic_runs(docs(spark, [(1, "x " + "a b " * 30, "en")])).first()
    assert plain.runs[0].asDict() == {"start": 1, "length": 60, "period": 2} and bytes(plain.collapsed) == b"x a b"
    assert runs.periodic_runs(docs(spark, rows).limit(0)).count() == 0


# ---- token files

ODD = [None, "", " ", "  ", "a  b", "a  b", "a   b", "café  au lait", "   x", "x\n\n y \n", "it's  we'll\tgo", "漢字 漢  字",
       "a <|endoftext|>  b", "<|endoftext|>", "\x85 x\x1c y", "1 000,5 %", "!? ...  ¿", "é à  o", "\U0001f600 \U0001f600  x", "é " * 40]


def whole_ids(text):
    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 2]


def test_parts_give_the_ids_of_whole_texts():
    rng, whole = random.Random(2), Tokenizer.from_file(VOCABULARY)
    signs = [" ", "  ", "\n", "\t", " ", " ", "\x85", "　", "a", "B", "é", "ß", "'s", "'", "1", "22", ".", "!?", "漢", "А", "\U0001f600", "<|endoftext|>", "́"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4_000)]
    encode = tokens.ByteIds(VOCABULARY)
    assert encode.parted
    for some in (texts, [t for t in texts if "<|" not in t]):
        flat, many = zip(*encode(pa.array(some, pa.binary())), strict=True)
        ends = np.cumsum(np.concatenate(many))
        got = np.split(np.concatenate(flat), ends[:-1])
        assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in some]
    assert len(encode.known) > 100
    other = tokens.ByteIds(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.parted
    (ids, _), = other(pa.array([b"Two  words"]))
    assert ids.tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Two  words", add_special_tokens=False).ids


def test_token_files(spark):
    rng = random.Random(3)
    prose = [" ".join(f"word{rng.randrange(500)}" for _ in range(rng.randint(1, 400))) for _ in range(200)]
    rows = [(i * 3, t, "en") for i, t in enumerate(ODD + prose)] + [(30, "again", "en"), (30, "again", "en"), (None, "no id", "en"),
                                                                   (-4, "long " * 200_000, "en")]
    got = tokens.token_digests(spark, tokens.token_files(docs(spark, rows), VOCABULARY)).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for i, t, _ in rows:
        ids = whole_ids(t)
        assert (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got}
    ordered = [-1_000 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered)
    assert tokens.read_tokens(spark, tokens.token_files(docs(spark, rows).limit(0), VOCABULARY)).count() == 0


def test_layout_allows_selective_reads(spark, monkeypatch):
    monkeypatch.setitem(tokens.LAYOUT, "parquet.block.size", str(1 << 20))
    folder = shared_folder(spark)
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.xxhash64("id", F.lit(k)).cast("string") for k in range(8)]).alias("text"))
    tokens.write_tokens(many, folder, VOCABULARY)
    files = sorted(glob.glob(f"{folder}/*.parquet"))
    last, groups = -1, 0
    for name in files:
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["offset"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            stats = columns["doc_id"].statistics
            assert stats.min > last
            last = stats.max
    assert groups > len(files)
    one = tokens.read_tokens(spark, folder).where("doc_id = 17000").select("doc_id", "ids")
    ids = [x for x in one.first().ids]
    assert ids == whole_ids(many.where("doc_id = 17000").first().text)
    numbers = tokens.read_tokens(spark, folder).select("doc_id", "start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in numbers


# ---- toxicity: what the labels cannot teach


def test_texts_without_words_and_labels_of_one_kind_stay_below_the_threshold():
    texts = [f"some {'grubnak' if k % 2 else 'plain'} words {k}" for k in range(200)]
    model = toxicity.fit(texts, np.arange(200) % 2, 0.5)
    assert max(model.scores(["", None, " .. "])) <= toxicity.EMPTY_SCORE
    for label in (0, 1):
        assert max(toxicity.fit(texts, np.full(200, label), float(label)).scores([*texts, None])) < toxicity.THRESHOLD


def test_parts_and_bags_read_the_same_grams():
    texts = ["one  two three", "", None, "é longerword, x", "a b c d e f g", " "] * 3
    whole = toxicity.Pieces.of(texts)
    values = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    a, b, text, logit = toxicity._logits(whole, values)
    parts = [toxicity._logits(whole.part(k, k + 1), values)[3] for k in range(len(texts))]
    assert np.allclose(np.concatenate(parts), logit)
    bucket, who = whole.bag(a, b)
    means = np.bincount(who, values[bucket], len(a)) / np.maximum(np.bincount(who, minlength=len(a)), 1)
    assert np.allclose(means, logit)


# ---- main text: elements without an end, pages too long for the sample


def paragraphs(source):
    nodes = html.Nodes()
    nodes.add(0, source)
    return " ".join("".join(t for _, t in nodes.texts).split())


def test_unclosed_elements_hide_nothing():
    for tag in ("svg", "object", "video", "canvas", "audio", "math", "template"):
        assert paragraphs(f"<p>one</p><{tag} class=x><p>two</p><p>three</p>") == "one two three"
        assert paragraphs(f"<p>one</p><{tag}><{tag}>in</{tag}>hidden</{tag}><p>two</p>") == "one two"
        assert paragraphs(f"<p>one</p><{tag}><p>kept</p><{tag}>in</{tag}><p>two</p>") == "one kept two"
        assert paragraphs(f"<p>one</p><{tag}/><p>two</p></{tag}><p>three") == "one two three"
    assert paragraphs("<p>one<script>if (a < b) x()</script></p><style>p{}") == "one"


def test_a_page_too_long_for_the_sample_leaves_the_others(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html, "fit", seen.extend)
    order = [r.id for r in spark.range(40).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "u", f"<p>{i}</p>") for i in range(40)] + [(3, "u", "<p>a</p>")] * 5 + [(None, "u", "<p>none</p>")]
    rows[order[0]] = (order[0], "u", "<p>" + "long " * 1_000_000)
    html.train(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert seen == ["<p>3</p>" if i == 3 else f"<p>{i}</p>" for i in order[1:]]
