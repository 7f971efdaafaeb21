import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import near_dedup, substring_dedup
from tests.llm import docs


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    """component of each id by exact comparison of all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return near_dedup.near_duplicates(df).collect()


def test_awkward_rows(spark):
    got = near_dedup.near_duplicates(docs.table(spark)).collect()
    assert len(got) == len(docs.ROWS)
    want = brute([r[:2] for r in docs.ROWS])
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    nameless = {(r.component_id, r.kept) for r in got if r.doc_id is None}
    assert nameless == {(1, False), (None, True)}
    assert near_dedup.near_duplicates(docs.empty(spark)).count() == 0


def test_chain_of_near_copies_and_ties(spark):
    """Each text shares enough with its neighbours only; a component must still hold the whole chain."""
    words = [f"w{i}" for i in range(200)]
    rows = [(100 + k, " ".join(words[k * 5 : k * 5 + 60])) for k in range(12)] + [(5, " ".join(words[55:115]))]
    rows += [(500 + k, f"quite another text number {k} " + " ".join(f"z{k}_{i}" for i in range(30))) for k in range(20)]
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in run(spark, rows)}
    assert got == want and len(set(got.values())) < len(rows)


def test_large_group_with_a_stranger_in_its_buckets(spark):
    """Members of a large group meet texts that share half their words; only true links may join them."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(150):
        w = list(base)
        w[int(rng.integers(80))] = f"x{k}"
        rows.append((k, " ".join(w)))
    for k in range(60):
        rows.append((1000 + k, " ".join(base[:55] + [f"s{k % 7}_{i}" for i in range(18 + k % 9)])))
    assert {r.doc_id: r.component_id for r in run(spark, rows)} == brute(rows)


def test_shared_id_is_one_document(spark):
    rows = [(1, docs.BASE), (1, "other text that nobody else has at all"), (2, "other text that nobody else has at all")]
    assert {r.component_id for r in run(spark, rows)} == {1}


def test_deduplicated_keeps_columns_and_one_row(spark):
    d = docs.table(spark)
    kept = near_dedup.deduplicated(d, near_dedup.near_duplicates(d))
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 2


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)


def test_repeats_of_awkward_rows(spark):
    got = substring_dedup.deduplicated(docs.table(spark)).collect()
    assert len(got) == len(docs.ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].text == "" and by[4].text is None and by[1].text == docs.BASE
    assert substring_dedup.deduplicated(docs.empty(spark)).count() == 0


def repeated_places(rows, least=8, passage=51):
    """For each document, by place: which words stand in a line or paragraph that an earlier document, or the same one
    further up, has; which in so repeated a run of half a passage; and the first words of repeated whole passages."""
    half, had, out = (passage + 1) // 2, {}, {}
    for i, text in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0)):
        words, at, spans, block = text.lower().split(), 0, [], []
        for line in [*text.split("\n"), ""]:
            n = len(line.split())
            if n:
                block.append((at, n))
            elif block:
                spans += [("unit", *b) for b in block]
                if len(block) > 1:
                    spans.append(("unit", block[0][0], at - block[0][0]))
                block = []
            at += n
        spans = [(k, p, n) for k, p, n in spans if n >= least] + [("run", p, half) for p in range(len(words) - half + 1)] + [("run", p, passage) for p in range(len(words) - passage + 1)]
        unit, run, whole = set(), set(), []
        for kind, p, n in spans:
            key = (kind, *words[p : p + n])
            if key in had and (had[key][0] != i or had[key][1] + n <= p):
                (unit if kind == "unit" else run).update(range(p, p + n))
                if kind == "run" and n == passage:
                    whole.append(p)
            had.setdefault(key, (i, p))
        out[i] = unit, run, whole
    return out


def places_gone(row, text):
    return {k for k, m in enumerate(re.finditer(r"\S+", text)) if any(s.start <= m.start() < s.end for s in row.spans)}


def test_lines_and_passages_against_brute_force(spark):
    """By places, not by the operator's units: lines across documents and within one, passages that begin anywhere."""
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"{'abcdefgh'[int(rng.integers(8))]}{int(rng.integers(1 << 40))}" for _ in range(n))
    short = "It is so. We know it. You do not. They may yet see. Nobody else did."
    passages = [fresh(51 + 7 * k) for k in range(12)]
    mixed = "On it. " + ". ".join(fresh(6) for _ in range(9)) + ".\nSo it is"
    rows = [(k, f"{fresh(9)} {p} {fresh(30)}\n{short}\n{fresh(12)}") for k, p in enumerate([*passages, mixed])]
    rows += [(100 + k, f"{fresh(5)} {p} {fresh(3 + k)}") for k, p in enumerate([*passages, mixed])]
    rows += [(200, f"{fresh(70)}\n{short}"), (201, "x " * 130), (202, passages[3] + " and " + passages[3]), (203, fresh(200)), (204, " ".join(passages[1].split()[:25])), (205, None), (206, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeated_places(rows)
    for passage in (51, None):
        got = {r.doc_id: r for r in substring_dedup.deduplicated(frame, passage=passage).collect()}
        assert len(got) == len(rows) and got[205].text is None and got[206].text == ""
        for i, text in rows:
            if not text:
                continue
            unit, run, whole = want[i]
            gone = places_gone(got[i], text)
            assert unit <= gone <= (unit | run if passage else unit), i
            for p in whole if passage else ():
                assert len(gone & set(range(p, p + 51))) >= 26, (i, p)
            assert got[i].removed_words == len(gone) and got[i].changed == bool(gone)
            assert got[i].text == "".join(text[a:b] for a, b in zip([0, *(s.end for s in got[i].spans)], [*(s.start for s in got[i].spans), len(text)]))
        assert all(short not in got[i].text for i in got if i and i < 205) and not got[203].changed and not got[204].changed


def test_fragments_are_chosen_by_their_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    places, grams = substring_dedup.fragments_of(words, 51)
    assert all(np.any((places >= p) & (places <= p + 25)) for p in range(len(words) - 50)) and len(places) < 60
    inner, same = substring_dedup.fragments_of(words[40:140], 51)
    known = dict(zip(places.tolist(), grams.tolist()))
    assert {p + 40: g for p, g in zip(inner.tolist(), same.tolist()) if 25 <= p <= 49} == {p: g for p, g in known.items() if 65 <= p <= 89}
    assert len(substring_dedup.fragments_of(words[:50], 51)[0]) == 0 and len(substring_dedup.fragments_of(words[:51], 51)[0]) >= 1


def test_rows_without_id_and_paragraphs(spark):
    """Rows without id and of equal text are one document; a paragraph goes however its lines are wrapped."""
    line = "It is so. We know it. You do not. They may yet see."
    rows = [(1, f"{line}\nmore here\n\nfive words and then some\nothers, in all of eleven"), (2, f"before\n{line}\nmore here"), (3, "five words and then some\nothers, in all of eleven"), (4, "more here"), (None, f"{line} Own end."), (None, f"{line} Own end.")]
    got = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = {r.doc_id: r.text for r in got}
    assert [text[i] for i in (1, 2, 3, 4)] == [rows[0][1], "before\nmore here", "", "more here"]
    assert [r.text for r in got if r.doc_id is None] == [f"{line} Own end."] * 2
