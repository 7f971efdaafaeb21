import random
import re
import zipfile
from io import BytesIO

import numpy as np
import pytest

from tessera.llm import decontaminate, language_id, mixing, warc_zip
from tests.llm import docs

ITEM = "the quick brown fox jumps over the lazy dog while thirteen other animals are watching from afar tonight"
SHORT = "only five words stand here"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(documents, items):
    out = []
    for i, text in documents:
        w, hit, found = words(text), set(), set()
        for k, item in items:
            v = words(item)
            n = min(13, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        if k is not None:
                            found.add(k)
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


DOCUMENTS = [
    (1, f"Before it. {ITEM.upper()}! After it."), (2, " ".join(ITEM.split()[:13]) + " x"), (3, " ".join(ITEM.split()[:12])), (4, f"{SHORT} and {SHORT}"), (5, None), (6, ""), (7, "!!! ??"),
    (8, f"{ITEM} {ITEM}"), (9, "unrelated words " * 200 + SHORT), (1, "same id again"), (None, SHORT), (11, "naïve café " * 3 + "été"), (12, docs.LONG),
]
ITEMS = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, ITEM), (None, "nobody has this short item"), (7, "Naïve CAFé naïve"), (1, ITEM)]


@pytest.mark.parametrize(("shard_words", "block_bytes"), [(1 << 20, 8 << 20), (40, 8 << 20), (1 << 20, 60)])
def test_contamination_against_brute_force(spark, shard_words, block_bytes):
    d = spark.createDataFrame([(*r, 1, "x") for r in DOCUMENTS], "doc_id long, text string, n_words int, spans string")
    b = spark.createDataFrame([(*r, 3) for r in ITEMS], "item_id long, text string, text_key int")
    got = decontaminate.judged(decontaminate.contamination(d, b, shard_words=shard_words, block_bytes=block_bytes)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got], key=str) == brute(DOCUMENTS, ITEMS)
    best = {r.doc_id: (r.longest_words, r.longest_item, r.longest_at) for r in got if r.doc_id in (8, 2)}
    assert best == {8: (len(ITEM.split()), 1, 0), 2: (13, 1, 0)}


def test_contamination_of_random_texts(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.randint(0, 16))) for k in range(12)]
    documents = [(k, text(rng.randint(0, 80)) + (" " + rng.choice(items)[1] if k % 3 else "")) for k in range(60)]
    d, b = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(decontaminate.contamination(d, b, shard_words=300)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got], key=str) == brute(documents, items)


@pytest.mark.parametrize("block_bytes", [8 << 20, 20])
def test_string_ids_and_ties_of_items(spark, block_bytes):
    d = spark.createDataFrame([(1, f"a {SHORT} b"), (2, "yes or no")], "doc_id string, text string")
    b = spark.createDataFrame([(None, SHORT), ("b", SHORT), ("a2", SHORT), ("a10", "yes"), ("z", "YES!"), ("n", "no way")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(d, b, block_bytes=block_bytes).collect()}
    assert got["1"].item_ids == ["a2", "b"] and (got["1"].longest_words, got["1"].longest_item, got["1"].longest_at) == (5, "a2", 1)
    assert got["2"].item_ids == ["a10", "z"] and got["2"].longest_item == "a10"
    only = decontaminate.contamination(d, b.where("item_id is null"), block_bytes=block_bytes).where("doc_id = '1'").head()
    assert only.item_ids == [] and only.longest_item is None and only.longest_words == 5


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(2)
    for high in (2, 4, 50):
        w = np.append(rng.integers(0, high, 400), 0).astype(np.int32)
        array = decontaminate.suffix_array(w, 1000)
        suffixes = [w[a : a + np.flatnonzero(w[a:] == 0)[0]].tolist() for a in array]  # up to the first 0
        assert suffixes == sorted(suffixes) and sorted(array) == np.flatnonzero(w).tolist()


def test_empty_sides_and_filter(spark):
    d, b = docs.table(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {len(r.spans) for r in decontaminate.contamination(d, none).collect()} == {0}
    assert decontaminate.contamination(docs.empty(spark), b).count() == 0
    dirty = spark.createDataFrame([(1, SHORT, "k"), (1, "clean", "k"), (2, "clean too", "k"), (None, "clean", None)], "doc_id long, text string, n_hit string")
    kept = decontaminate.decontaminated(dirty, b)
    assert kept.columns == dirty.columns and [r.doc_id for r in kept.collect()] == [2, None]


PAGES = [
    (3, "http://a.example/x y\r\nEvil: 1", "<p>same</p>"), (1, "https://b.example/é", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 40_000), (7, "u", "\r\n\r\nWARC/1.1 trap\n"),
    (None, "u", "<p>same</p>"), (None, "u", "nameless"), (8, "u", "twice"), (8, "u", "twice"),
]


def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string")


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/arc"
    warc_zip.write_archives(pages(spark).repartition(3), path, file_bytes=200)
    got = warc_zip.read_archives(spark, path, with_payload=True).collect()
    assert len(got) == len(PAGES)
    import base64
    import hashlib

    for r in got:
        own = [h or "" for i, _, h in PAGES if i == r.page_id]
        digests = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in own}
        assert r.payload_digest in digests and r.payload_bytes == len(digests[r.payload_digest].encode())
        if r.record_type == "response":
            assert bytes(r.payload) == digests[r.payload_digest].encode()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "revisit", 4), (None, "revisit", 1), (None, "response", None), (8, "response", None)} <= kinds
    monkeypatch.setattr(warc_zip, "SPAN", 100)
    assert sorted(map(str, warc_zip.read_archives(spark, path, with_payload=True).collect())) == sorted(map(str, got)), "spans of single records"
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 3
    for f in files:
        with zipfile.ZipFile(BytesIO(f)) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    path = f"file://{tmp_path}/arc2"
    warc_zip.write_archives(pages(spark), path, revisit_from=12)
    assert {r.record_type for r in warc_zip.read_archives(spark, path).collect()} == {"response"}
    assert warc_zip.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_ranges_of_zip_and_zip64(zip64, monkeypatch):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    member = warc_zip._gzip(warc_zip.record(5, "http://x.example/", b"body", None, "2024-01-01T00:00:00Z"))
    raw = warc_zip.pack_archive([(5, member), (6, member)], zip64) + b"\n"
    assert (b"PK\x06\x06" in raw) == zip64
    reads = []

    def read_at(at, n):
        reads.append(n)
        return raw[at : at + n]

    monkeypatch.setattr(warc_zip, "PIECE", 7)
    found = list(warc_zip.indexed(read_at, len(raw)))
    assert [f[0] for f in found] == [5, 6] and max(reads[-3:]) <= 7
    assert warc_zip.read_record(read_at, *found[1][1:])[1].endswith(b"body") and reads[-1] == len(member)
    with pytest.raises(ValueError):
        warc_zip.ZipRanges(lambda at, n: b"no zip here"[at : at + n], 11)
    squeezed = BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.DATA, "x" * 100)
    with pytest.raises(ValueError):
        warc_zip.ZipRanges(lambda at, n: squeezed.getvalue()[at : at + n], len(squeezed.getvalue())).locate(warc_zip.DATA)


def shares(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, cap = {n: k % 3 + 1 for k, n in enumerate(names)}, {n: 3 * sizes[n] for n in names}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        each = left / sum(weight[n] for n in free)
        over = {n for n in free if each * weight[n] > cap[n]}
        if not over:
            return target | {n: each * weight[n] for n in free}
        for n in over:
            target[n] = cap[n]
            left -= cap[n]
        free -= over
    return target


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 300))), src) for k, src in enumerate(rng.choices(["a", "b", "c", None, "é", "zz"], [50, 5, 3, 2, 20, 1], k=400))]
    rows += [(1000, None, "a"), (1001, "", "only empty"), (None, "three words here", "b"), (1002, "w " * 5000, "c"), (7, rows[7][1], rows[7][2])]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, block int")
    got = mixing.mix(d).collect()
    assert sorted([(r.doc_id, r.size) for r in got], key=str) == sorted([(i, len((t or "").split())) for i, t, _ in rows], key=str)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, source = shares(sizes), {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    # one shard: what it draws beyond the whole parts is less than a block a source
    assert all(abs(taken[s] - want[s]) <= 4 * 64 for s in sizes) and abs(sum(taken.values()) - sum(sizes.values())) <= 4 * 64
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    other = lambda **k: {(r.doc_id, r.size): r.taken for r in mixing.mix(d, **k).collect()}
    base = other(block_words=16, shard_blocks=50)
    assert base != other(block_words=16, shard_blocks=70) and base != other(block_words=16, shard_blocks=50, seed=2)


def test_shards_follow_the_draw(spark):
    """Counts of the shards by a plain replay of the draws, and the texts of the shards against the documents."""
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(50 + 13 * k % 200)), "abc"[min(k % 5, 2)]) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, seed, words = 40, 3, 8
    streams = {s: [w for i, t, src in sorted(rows) if src == s for w in t.split()] for s in "abc"}
    targets = shares({s: len(v) for s, v in streams.items()})
    slots = {s: round(targets[s] * -(-len(v) // words) / len(v)) for s, v in streams.items()}
    total = sum(slots.values())
    p = np.array([slots[s] for s in "abc"])
    draws = {}
    for k in range(-(-total // size)):
        n = min(size, total - k * size)
        whole = (n * (p / p.sum())).astype(int)
        parts = n * (p / p.sum()) - whole
        draws[k] = whole + np.random.default_rng([seed, k]).multinomial(n - whole.sum(), parts / parts.sum())
    got = mixing.mixed_shards(d, block_words=words, shard_blocks=size, seed=seed).collect()
    per = {}
    for r in got:
        per[r.shard, r.source] = per.get((r.shard, r.source), 0) + 1
        assert r.text.split() == streams[r.source][words * r.block : words * (r.block + 1)]
    for j, s in enumerate("abc"):
        drawn, cap = sum(int(n[j]) for n in draws.values()), 3 * -(-len(streams[s]) // words)
        assert sum(n for (_, src), n in per.items() if src == s) == min(drawn, cap) and abs(drawn - slots[s]) <= 4 * len(draws) ** 0.5
        assert drawn > cap or all(per.get((k, s), 0) == draws[k][j] for k in draws)
    for k in {r.shard for r in got}:
        places = sorted(r.place for r in got if r.shard == k)
        assert places == list(range(len(places)))
    taken = {r.doc_id: r.taken for r in mixing.mix(d, words, size, seed).collect()}
    seen = {}
    for r in got:
        for w in r.text.split():
            i = int(w[1:].split("w")[0])
            seen[i] = seen.get(i, 0) + 1
    assert {i: n for i, n in taken.items() if n} == seen
    assert mixing.mixed_shards(docs.empty(spark)).count() == 0


def test_another_draw_gives_another_mix(spark, monkeypatch):
    """The permutations, sizes and targets stay; only what the shards draw differs."""
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(40)), "abc"[k % 3]) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    base = {r.doc_id: r.taken for r in mixing.mix(d, 8, 40).collect()}
    monkeypatch.setattr(mixing, "draw", lambda shard, size, slots, seed: np.eye(len(slots), dtype=np.int64)[-1] * size)
    other = {r.doc_id: r.taken for r in mixing.mix(d, 8, 40).collect()}
    assert {i for i, n in base.items() if n and i % 3 == 0} and not {i for i, n in other.items() if n and i % 3 < 2}
    assert all(n == 3 * 40 for i, n in other.items() if i % 3 == 2)


def test_null_sources_have_their_shards(spark):
    d = spark.createDataFrame([(k, "some words stand here", None if k % 2 else "a") for k in range(40)] + [(None, None, None)], "doc_id long, text string, source string")
    got = mixing.mixed_shards(d, block_words=4, shard_blocks=10).collect()
    assert {r.source for r in got} == {"a", None} and sum(len(r.text.split()) for r in got) == sum(r.taken for r in mixing.mix(d, 4, 10).collect())


def test_mixed_documents(spark):
    d = docs.table(spark)
    found = {(r.doc_id, r.size): r.taken for r in mixing.mix(d).collect() if r.doc_id is not None}
    mixed = mixing.mixed_documents(d.selectExpr("*", "'p' as plan", "1 as mix_row", "'q' as row"))
    assert mixed.columns == [*d.columns, "plan", "mix_row", "row"]
    rows = mixed.collect()
    assert {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows if r.doc_id is not None} == {i: t for (i, _), t in found.items() if t}
    assert all(r.n_chars == len(r.text) and (r.plan, r.mix_row, r.row) == ("p", 1, "q") for r in rows)
    assert mixing.mix(docs.empty(spark)).count() == 0 and mixing.mixed_documents(docs.empty(spark)).count() == 0


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, (1, 2)).tolist()) == list(range(n))


def test_language_id(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    train, held = d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0")
    model = language_id.fit(train)
    right = language_id.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang_pred = lang as int)) a").head()["a"]
    assert right > 0.97


def test_language_scores_against_brute_force(spark):
    """A model of a few texts, scored by plain dictionaries of words and n-grams."""
    texts = [(1, "the cat and the dog", "en"), (2, "the dog ran", "en"), (3, "le chat et le chien", "fr"), (4, "un chien court", "fr"), (5, "हिन्दी में पाठ", "hi"), (6, None, "fr"), (7, "lost", None)]
    order, smooth, languages = 4, 0.5, ["en", "fr", "hi"]
    counts = {}
    for _, text, lang in texts:
        for w in (text or "").split() if lang else []:
            for kind, keys in [(0, [w]), *((n, language_id.grams_of(w, n)) for n in range(1, order + 1))]:
                for key in keys:
                    row = counts.setdefault(kind, {}).setdefault(key, [0, 0, 0])
                    row[languages.index(lang)] += 1

    def log(kind, key):
        total = np.sum(list(counts[kind].values()), axis=0)
        more = smooth * total / total.max()
        return np.log((np.array(counts[kind][key]) + more) / (total + more * (len(counts[kind]) + 1)))

    def want(text):
        total = np.zeros(3)
        for w in text.split():
            if w in counts[0]:
                total = total + log(0, w)
                continue
            for n in range(order, 0, -1):
                rows = [log(n, g) for g in language_id.grams_of(w, n) if g in counts[n]]
                if rows:
                    total = total + np.mean(rows, axis=0)
                    break
        return languages[int(total.argmax())], 1 / np.exp(total - total.max()).sum()

    asked = ["the cat", "chienne chats", "dogs and cats", "zzzz", "हिन्दी पाठ", "un the le qqq"]
    model = language_id.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"), order=order, smooth=smooth)
    frame = spark.createDataFrame([*enumerate(asked), (90, "½ ²"), (91, "①"), (92, None), (93, "12 ³")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame, model).collect()}
    for k, text in enumerate(asked):
        assert got[k][0] == want(text)[0] and abs(got[k][1] - want(text)[1]) < 1e-5, text
    assert {got[k] for k in (90, 91, 92, 93)} == {("und", 0.0)}
    assert language_id.words_of("हिन्दी ½x") == ["हिन्दी", "x"]


def test_language_id_of_awkward_rows(spark):
    d = docs.table(spark)
    model = language_id.fit(d)
    got = language_id.predict(d, model).collect()
    assert len(got) == len(docs.ROWS) and {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 10)} == {"und"}
    assert all((r.score == 0) if r.lang_pred == "und" else 0 < r.score <= 1 for r in got)
    kept = language_id.identified(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, 9, None}
    nobody = language_id.fit(docs.empty(spark))
    assert {r.lang_pred for r in language_id.predict(d, nobody).collect()} == {"und"}
    assert language_id.predict(docs.empty(spark), model).count() == 0
