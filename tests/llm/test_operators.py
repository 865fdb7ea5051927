"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows, no rows and
clashing column names."""

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from bandwise.llm import chat, decontam, hilbert, html, lsh, packing, simhash, suffixes, toxicity, warc
from bandwise.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, id string, fp string, h string, slice string"
RNG = np.random.default_rng(3)
WORDS = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(WORDS[i] for i in RNG.integers(0, len(WORDS), n))


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", "x", "y", "z", "q") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


BASE = prose(200)
TEXTS = [BASE, BASE, BASE + " tail", None, "", " \t\n", "one", "Two words", prose(6000), prose(30), BASE.upper(), "é ß 漢字 " * 40]


def simhash_of(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark):
    got = {r.doc_id: r for r in simhash.simhash_components(docs(spark, TEXTS)).collect()}
    fps = {i: simhash_of(t) for i, t in enumerate(TEXTS)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    for i, r in got.items():
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            near = {j for j in fps if (fps[x] ^ fps[j]).bit_count() <= 2} - seen
            seen |= near
            todo += near
        assert r.component_id == min(seen)
    assert simhash.simhash_components(docs(spark, TEXTS).limit(0)).count() == 0
    twice = simhash.simhash_components(docs(spark, ["a b c", "a b c", "q"], [7, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in twice) == [(-1, -1), (7, 7), (7, 7)]


def test_links_of_a_crowded_bucket(spark):
    """300 fingerprints that differ only in their high bits share buckets; every link counts."""
    fps = sorted({int(x) << 40 for x in np.random.default_rng(1).integers(0, 1 << 12, 300)})
    found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    got = {r.node: r.component for r in found.collect()}
    for f in fps:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            near = {g for g in fps if (g ^ x).bit_count() <= 2} - seen
            seen |= near
            todo += near
        assert got.get(f, f) == min(seen)


def test_components_of_a_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(path).collect()} == {0}
    assert components(path.limit(0)).count() == 0


def removed(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        out[i] = (len(b), sum(gone), sum(map(bool, bytes(gone).split(b"\0"))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_levels(spark, monkeypatch):
    line = "a line that repeats itself again and again in one text; "
    passage = prose(40)
    texts = [*[t or "" for t in TEXTS], line * 30, "ab" * 90, "\0" * 150, "x" * 99, "x" * 100, "x" * 101,
             *[f"{prose(12)} {passage} {prose(12)}" for _ in range(90)]]
    table = docs(spark, texts)
    want = removed(dict(enumerate(texts)))
    for crowded, batch in ((20_000, 10_000), (50, 7)):
        monkeypatch.setattr(suffixes, "CROWDED", crowded)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(table).collect()}
        assert got == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same = suffixes.deduplicated(docs(spark, [BASE, BASE, None], [5, 5, None])).collect()
    assert [r.n_removed for r in same] == [0, 0, 0]
    assert suffixes.deduplicated(table.limit(0)).count() == 0


def test_index_family_levels():
    family, seen = suffixes.IndexFamily(), set()
    for _ in range(40):
        batch = RNG.integers(1, 400, 50).astype("S100")
        want = []
        for w in batch:
            want.append(w in seen)
            seen.add(w)
        assert family.add(batch).tolist() == want
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_decontamination(spark):
    item = prose(40)
    changed = item.split()
    changed[9] = changed[22] = "other"
    items = spark.createDataFrame([(1, item), (2, prose(9)), (3, "too short"), (4, None), (5, "")], "item_id long, text string")
    short = [r for r in items.collect() if r.item_id == 2][0].text
    texts = [f"{prose(50)} {item.upper()} {prose(5)}", f"{prose(3)}, {' '.join(changed)}!", prose(400), short, "too short", None, "",
             " ".join(item.split()[:10]) + " " + prose(30)]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(spark, texts), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 2)}
    assert (got[0, 1].first_word, got[0, 1].end_word, got[0, 1].equal_words) == (50, 90, 40)
    assert got[1, 1].equal_words == 38
    assert decontam.contaminated(docs(spark, texts), items.limit(0)).count() == 0
    assert decontam.contaminated(docs(spark, texts).limit(0), items).count() == 0


def test_masks_fit_every_accepted_substitution():
    for n in range(decontam.SHORTEST, 17):
        item = np.arange(1, n + 1, dtype=np.uint64)
        wide = min(n, decontam.OVERLAP)
        masks = decontam._whole_masks(n) if n < decontam.SPAN else decontam.MASKS
        for many in range(wide + 1):
            for gone in itertools.combinations(range(wide), many):
                doc = item.copy()
                doc[list(gone)] += np.uint64(1_000)
                if decontam.overlap(doc[:wide], item, 0):
                    room = 1 if n < decontam.SPAN else wide
                    assert any(not {s + p for p in m} & set(gone) for m in masks for s in range(room) if s + m[-1] < wide), (n, gone)


def test_decontamination_of_short_and_changed_items(spark):
    """Every accepted substitution at an item's words is found, nothing else."""
    texts, rows, want = [], [], set()
    for item, n in enumerate((3, 4, 5, 6, 7, 8, 10, 13, 15)):
        words = [f"i{item}x{k}" for k in range(n)]
        rows.append((item, " ".join(words)))
        for gone in [(), *[(k,) for k in range(n)], *itertools.combinations(range(n), 2), *([(1, 7, 9), (5, 7, 13)] if n == 15 else [])]:
            mine = ["other" if k in gone else w for k, w in enumerate(words)]
            wide = min(13, n)
            if any(sum(k not in gone for k in range(s, s + wide)) >= 0.8 * wide for s in range(n - wide + 1)):
                want.add((len(texts), item))
            texts.append(f"{prose(3)} {' '.join(mine)} {prose(3)}")
    got = decontam.contaminated(docs(spark, texts), spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    alone = decontam.contaminated(docs(spark, [rows[0][1], rows[2][1]]), spark.createDataFrame(rows, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in alone.collect()} == {(0, 0), (1, 2)}


def test_toxicity_learns_parts_of_words(spark):
    bad = ["grubnak", "grubnaks", "grubnakish", "vorpelin", "vorpelins"]
    texts, toxic = [], []
    for k in range(600):
        t = prose(int(RNG.integers(5, 80))).split()
        if k % 3 == 0:
            t[len(t) // 2] = bad[k % len(bad)]
        texts.append(" ".join(t))
        toxic.append(int(k % 3 == 0))
    fresh = [f"{prose(20)} grubnakly {prose(20)}", f"{prose(60)} vorpelinish", prose(40), None, ""]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    table = docs(spark, [*texts, *fresh])
    model = toxicity.train(table, labels)
    got = {r.doc_id: r for r in toxicity.scored(table, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert [got[600 + k].predicted for k in range(3)] == [1, 1, 0]
    assert 0 <= got[603].score == got[604].score <= 1
    assert toxicity.toxicity(table, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(table.limit(0), labels).count() == 0


def test_toxicity_with_one_huge_labelled_text(spark):
    """A labelled text of 6 MB that comes first in hash order leaves the other texts in the sample."""
    bad = ["grubnak", "grubnaks", "grubnakish"]
    texts = [f"{prose(20)} {bad[k % 3] if k % 4 == 0 else ''} {prose(20)}" for k in range(400)]
    order = spark.range(400).where("pmod(crc32(cast(cast(id as string) as binary)), 4) <> 2").orderBy(F.xxhash64("id"))
    for huge in [next(r.id for r in order.collect() if (r.id % 4 == 0) == want) for want in (True, False)]:
        mine = list(texts)
        mine[huge] = " ".join([texts[huge]] * (6_000_000 // len(texts[huge])))
        labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
        got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs(spark, mine), labels).collect()}
        assert np.mean([got[k] == int(k % 4 == 0) for k in range(400) if k != huge]) > 0.95


def test_toxicity_sample_keeps_every_text():
    few, many = np.full(10, 1_000), np.array([500] * 100 + [10**7])
    for sizes in ([many, few], [few, many], [many, many], [few, few], [many, few[:0]]):
        limits = toxicity._limits(sizes, 200_000)
        kept = [np.minimum(s, m) for s, m in zip(sizes, limits, strict=True)]
        assert sum(int(k.sum()) for k in kept) <= 200_000
        assert all((k[s <= 1_000] == s[s <= 1_000]).all() for k, s in zip(kept, sizes, strict=True))
    text = "äö word " * 10_000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1], pa.int32()), pa.array([text]), pa.array([5_000])], ["id", "label", "text", "most"])
    (out,) = toxicity._cut(iter([batch]))
    cut = out.column(2)[0].as_py()
    assert 4_000 <= len(cut.encode()) <= 5_100 and set(cut.split()) == {"äö", "word"}


def test_hilbert_curve_and_shards(spark):
    cells = spark.range(8 ** 3).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    walk = cells.select("x", "y", "z", hilbert.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in walk] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(walk, walk[1:], strict=False))
    table = docs(spark, TEXTS, [*range(len(TEXTS) - 2), 0, None])
    got = hilbert.hilbert_shards(table).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(8)) <= 1
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in TEXTS)
    assert hilbert.hilbert_shards(table.limit(0)).count() == 0


def test_shards_let_a_reader_skip_files(spark, tmp_path):
    """Written along the curve, over half the files' ranges of (source, size) exclude a filter's value; written as they came, none does."""
    rng = np.random.default_rng(12)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 12)), ("de", "en", "fr")[i % 3], f"s{rng.integers(0, 16):02d}") for i in range(4_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    hilbert.write_shards(table, hilbert.hilbert_shards(table, 16), str(tmp_path / "sorted"))
    table.repartition(16).write.parquet(str(tmp_path / "plain"))

    def read(name, source, longest):
        """Files whose row groups may hold such rows, and all files."""
        may = files = 0
        for f in (tmp_path / name).rglob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = {meta.row_group(0).column(c).path_in_schema: c for c in range(meta.num_columns)}
            stats = [(meta.row_group(g).column(at["source"]).statistics, meta.row_group(g).column(at["n_chars"]).statistics)
                     for g in range(meta.num_row_groups)]
            files += 1
            may += any(a.min <= source <= a.max and b.min <= longest for a, b in stats)
        return may, files

    back = spark.read.parquet(str(tmp_path / "sorted"))
    assert sorted((r.doc_id, r.text) for r in back.select("doc_id", "text").collect()) == sorted(r[:2] for r in rows)
    kept = skipped = 0
    for source in ("s00", "s03", "s08", "s15"):
        may, files = read("sorted", source, 16)
        all_may, all_files = read("plain", source, 16)
        assert all_may == all_files
        kept, skipped = kept + may, skipped + files - may
        want = sorted(r[0] for r in rows if r[3] == source and len(r[1]) <= 16)
        assert sorted(r.doc_id for r in back.where((F.col("source") == source) & (F.col("n_chars") <= 16)).collect()) == want
    assert skipped >= kept


def test_snapshot_collapse(spark):
    def talk(conv, *turns):
        return [(conv, k, r, t) for k, (r, t) in enumerate(turns)]

    a, b, c = ("user", "hi"), ("assistant", "yes <|im_end|>"), ("user", None)
    long = [("user", f"t{k}") for k in range(700)]
    rows = [*talk(1, a), *talk(2, a, b), *talk(3, a, b, c), *talk(4, a, b, c), *talk(5, b), *talk(6, *long), *talk(7, *long[:600]),
            *talk(8, *long[:300], a), *talk(None, a, c)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat.render_chats(log).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {3: 3, 5: 1, 6: 700, 8: 301, None: 2}
    assert got[3].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes <\\|im_end|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.render_chats(log.limit(0)).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*TEXTS, "İΣς ǅ don't I'LL x<|endoftext|>y  \u0085 ½ 12", *[prose(int(n)) for n in RNG.integers(1, 900, 60)]]
    got = packing.best_fit(docs(spark, texts), path).collect()
    plain = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [
            (k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 2048
    assert len(by) <= 1.02 * sum(r.length for r in got) / 2048 + 1
    assert packing.best_fit(docs(spark, texts).limit(0), path).count() == 0


def test_word_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", " ", "\n\t a", "a  b\r\n", "a b \x0b c\u3000d", "Don'T we'LL.'s a.b,c;;d 3.14 U.S.A.", "\"'S 'RE",
             "E\u0301tude I\u0307 A\u030a \u0130I K\u212a \u2019Tis", "\u039f\u0394\u039f\u03a3.", "<|ENDOFTEXT|> <|endoftext|>.x",
             "\u65e5\u672c \u8a9e", "\u00d7A\u00df \u1e9e"]
    truth = Tokenizer.from_file(path)
    want = [truth.encode(t or "", add_special_tokens=False).ids for t in texts]
    for given in (texts, *[[t] for t in texts]):  # marks and special tokens change how a whole chunk is read
        found = packing.WordIds(path)(pa.array(given, pa.string()))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [want[texts.index(t)] for t in given]
    assert list(packing.WordIds(path)(pa.array([], pa.string()))) == []


def test_plan_is_best_fit():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, 33, int(rng.integers(1, 120)))
        gaps = []
        for n in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else 32) - n)
        steps = packing.plan(dict(zip(*map(list, np.unique(lengths, return_counts=True)), strict=True)), 32)
        used = {}
        for n, many in zip(*np.unique(lengths, return_counts=True), strict=True):
            for rank in range(many):
                _, first, seq, each, offset = max((s for s in steps.tolist() if s[0] == n and s[1] <= rank), key=lambda s: s[1])
                used.setdefault(seq + (rank - first) // each, []).append((offset + (rank - first) % each * int(n), int(n)))
        assert len(used) == len(gaps)
        for spots in used.values():
            spots.sort()
            assert all(o == sum(n for _, n in spots[:k]) for k, (o, _) in enumerate(spots)) and sum(n for _, n in spots) <= 32


def test_warc_round_trip(spark):
    big = "<p>" + "z" * 1200 + "</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/ b\r\nX: y", big), (3, None, big), (4, "u", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (5, "u", None), (6, "u", ""),
            (7, "u", "same"), (8, "u", "same"), (3, "again", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(pages).collect())
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 1000 and i != 3
        want.append((i or -1, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want)
    for r in warc.normalise(warc.write_archives(pages)).collect():
        for x in r["index"]:
            member = zlib.decompress(r["content"][x["member_offset"]:x["member_offset"] + x["member_length"]], 31)
            assert member.startswith(b"WARC/1.1\r\n") and f"<urn:page:{x['page_id']}>".encode() in member
        assert sum(x["member_length"] for x in r["index"]) == len(r["content"])
    assert warc.page_records(pages.limit(0)).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in centre[i % 6] + rng.standard_normal(16) * 0.25]) for i in range(600)]
    rows += [(600, rows[0][1]), (601, rows[0][1]), (602, [2 * x for x in rows[0][1]]), (603, [0.0] * 16), (604, None), (605, [float("nan")] * 16),
             (606, [1.0, None]), (607, [1.0, 2.0]), (608, [1.0, 2.0]), (609, []), (610, [float("inf")] * 16), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")
    got = {r.vec_id: r for r in lsh.embedding_links(table.repartition(3)).collect()}
    whole = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: {j for j, w in whole if j != i and len(v) == len(w) and v @ w >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w)} for i, v in whole}
    links = sum(map(len, near.values()))
    assert 0.9 * links <= sum(r.n_links for r in got.values()) <= links
    assert got[0].n_links >= 3 and got[600].component_id == got[0].component_id == 0 and got[607].n_links == 1
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (603, 604, 605, 606, 609, 610))
    assert lsh.embedding_links(table.limit(0)).count() == 0


def test_embedding_crowd_against_brute_force(spark):
    """3,000 vectors around one centre: links and components of every vector, and how often the crowd is sent."""
    rng = np.random.default_rng(8)
    crowd = rng.standard_normal(24) + rng.standard_normal((3_000, 24)) * 0.33
    alone = rng.standard_normal((500, 24))
    unit = np.concatenate([crowd, alone])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    hashes, tables = lsh.plan_tables(len(unit), 0.9)
    keyed = lsh.hashed(table, hashes, tables)
    assert lsh.dealt(keyed).count() <= len(unit) * tables  # once for each table, however many members a bucket has
    keys = np.array([r["keys"] for r in keyed.orderBy("id").select("keys").collect()])
    near = np.zeros((len(unit), len(unit)), dtype=bool)
    for t in range(tables):
        near |= keys[:, t, None] == keys[None, :, t]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    near &= close
    assert near.sum() >= 0.9 * close.sum() > 1_000_000
    got = {r.vec_id: r for r in lsh.embedding_links(table).collect()}
    assert [got[i].n_links for i in range(len(unit))] == near.sum(axis=1).tolist()
    reach = np.arange(len(unit))
    while True:
        low = np.minimum(reach, np.where(near, reach[None, :], len(unit)).min(axis=1))
        if (low == reach).all():
            break
        reach = low
    assert [got[i].component_id for i in range(len(unit))] == reach.tolist()


def test_main_text(spark):
    words = [prose(30) for _ in range(40)]
    page = ("<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/a>menu one</a></li></ul></nav>"
            "<div class=ad>{0}</div><article><h1>{1}</h1><p>A &amp; B<b>old</b>\n {2}<br><p>{3}<div class='comments'><p>{4}</p></div></article>"
            "<footer>&copy; {5}</footer></body></html>")
    pages = [page.format(*[words[(k * 7 + j) % 40] for j in range(6)]) for k in range(60)]
    table = spark.createDataFrame([(k, "u", h, "x") for k, h in enumerate([*pages, None, "", "<p", "just text", "<b>" * 3000])],
                                  "page_id long, url string, html string, text string")
    trees = html.train(table)
    got = {r.page_id: r for r in html.main_texts(table, trees).collect()}
    for k in range(60):
        w = [words[(k * 7 + j) % 40] for j in range(6)]
        assert got[k].text == f"{w[1]} A & Bold {w[2]} {w[3]}" and got[k].n_chars == len(got[k].text)
    assert got[60].text == got[61].text == "" and len(got) == 65
    assert html.main_texts(table.limit(0), html.train(table.limit(0))).count() == 0


def test_toxicity_sample_holds_what_the_small_corpus_labels():
    """The labelled texts drawn from the 10,000 documents come to just under 6 MiB; none of them is to be cut."""
    sizes = [np.full(2_000, 2_750), np.full(329, 1_700)]
    limits = toxicity._limits(sizes, toxicity.SAMPLE_BYTES)
    assert all((s <= m).all() for s, m in zip(sizes, limits, strict=True))


def test_very_long_texts(spark):
    """A text of 3 MB beside short ones, through every operator that reads texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    item, shared = prose(40), prose(60)
    # every word of the long text is its own, so that nothing repeats but what is planted
    words = [f"{k * 2654435761 % 2 ** 32:08x}" for k in range(333_333)]
    long = f"{' '.join(words)} {item} {shared}"[-3_000_000:]
    texts = [shared, long, "a short one"]
    table = docs(spark, texts)
    fps = {r.doc_id: r.fingerprint for r in simhash.simhash_components(table).collect()}
    assert fps == {i: f"{simhash_of(t):016x}" for i, t in enumerate(texts)}
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in hilbert.hilbert_shards(table).collect()}
    assert sizes == {i: (len(t) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)}
    found = decontam.contaminated(table, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.equal_words) for r in found] == [(1, 7, 40)]
    cut = {r.doc_id: r for r in suffixes.deduplicated(table).collect()}
    assert (cut[0].n_removed, cut[2].n_removed, cut[1].n_bytes) == (0, 0, 3_000_000) and cut[1].n_removed >= len(shared)
    assert cut[1].n_removed == 3_000_000 - len(cut[1].kept)
    pages = spark.createDataFrame([(1, "u", long), (2, "u", "x"), (3, "u", long)], "page_id long, url string, html string")
    kinds = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(pages).collect()}
    assert kinds == {1: (3_000_000, "revisit", 3), 2: (1, "response", None), 3: (3_000_000, "response", None)}
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids
    mine = [r for r in packing.best_fit(table, path).collect() if r.doc_id == 1]
    assert sum(r.length for r in mine) == len(ids) + 1 and all(r.length == 2048 for r in mine if r.start + 2048 <= len(ids))
