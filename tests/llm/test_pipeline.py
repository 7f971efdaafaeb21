import re

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm import decontaminate
from tessera.llm.common import cut
from tests.llm import docs
from tests.llm.test_corpus import words
from tests.llm.test_dedup import brute as components


def test_stages_against_brute_force(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    language = cut(cp.language(spark, d, small), "t1")
    assert language.columns == d.columns and {r.doc_id for r in language.collect()} == {r.doc_id for r in d.collect() if regex.search(r"\p{L}", r.text or "")}
    near = cut(cp.near_duplicates(spark, language, small), "t2")
    part = components([(r.doc_id, r.text) for r in language.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(part.values()))
    clean = cut(cp.decontamination(spark, near, small), "t3")
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items if w for i in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}
    want = []
    for r in near.collect():
        w, hit = words(r.text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want)
    mixed = cut(cp.source_mix(spark, clean, small), "t4")
    assert mixed.columns == d.columns
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    assert abs(size(mixed) - size(clean)) < 64 * 20
    rows = cp.token_files(spark, mixed, small).orderBy("start").collect()
    t, at = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER)), 0
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert [r.doc_id for r in rows] == sorted(text)
    for r in rows:
        assert r.start == at and r.n_tokens == len(t.encode(text[r.doc_id], add_special_tokens=False).ids) + 1
        at += r.n_tokens


def test_run_is_its_stages(spark, small):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "source_mix", "token_files"]
    assert cp.run(spark, small).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_awkward_rows_pass_every_stage(spark, small):
    for table in (docs.table(spark), docs.empty(spark)):
        d = table
        for name, stage in cp.STAGES:
            d = cut(stage(spark, d, small), f"awkward-{name}")
            d.count()
    assert np.isfinite(decontaminate.judged(decontaminate.contamination(docs.table(spark), spark.read.parquet(f"{small}/benchmark.parquet"))).agg({"n_hit": "sum"}).head()[0])


def test_rows_of_null_or_shared_ids_are_judged_alone(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select(*cp.COLUMNS)
    passage = max((r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r.text), key=len)
    clean = "Nothing of this text stands in any benchmark, and it says so in plain words."
    rows = [(i, t, "en", "a", len(t)) for i in (None, 7_000_001) for t in (passage, clean)]
    texts = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    assert texts(cp.decontamination(spark, spark.createDataFrame(rows, d.schema), small)) == [(0, clean), (7_000_001, clean)]
    junk = [(i, "12345 678 !!! ...", "en", "a", 17) for i in (None, 7_000_001)]
    extra = d.limit(1).collect()[0].text
    added = spark.createDataFrame([*junk, *((i, extra, "en", "a", len(extra)) for i in (None, 7_000_001))], d.schema)
    kept = cp.language(spark, d.unionByName(added), small).where("doc_id is null or doc_id = 7000001")
    assert texts(kept) == [(0, extra), (7_000_001, extra)]
