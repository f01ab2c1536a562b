"""The pipeline's stages, each judged on its own input."""

import random
import re
import time

import numpy as np
import pyarrow as pa

import corpus_pipeline
from recollect.llm import jaccard_join, pii, quality_rules
from recollect.runtime import table
from tests.llm.test_operators import brute, docs, matched, near_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "pii", "mixing", "packing"]
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns and set(after.doc_id) <= set(before.doc_id)
        if name == "quality_rules":
            good = quality_rules.score(table(spark, SF, "documents")).where("keep").toPandas()
            assert set(good.doc_id) == set(after.doc_id)
        elif name == "jaccard_join":
            pairs = brute(dict(zip(before.doc_id, before.text)), jaccard_join.N, jaccard_join.THRESHOLD)
            group = {i: i for i in before.doc_id}
            for _ in range(20):
                for a, b in pairs:
                    group[a] = group[b] = min(group[a], group[b])
            assert set(after.doc_id) == {i for i, g in group.items() if i == g}
        elif name == "pii":
            assert len(after) == len(before)
            old, new = before.set_index("doc_id").text, after.set_index("doc_id").text
            for i, t in old.items():
                for x, y, _ in pii.find(t):
                    assert t[x:y] not in new[i]
                if not pii.find(t):
                    assert new[i] == t
            assert (after.n_chars == after.text.str.len()).all()
        elif name == "packing":
            assert set(after.doc_id) == set(before.doc_id)
            assert after.groupby("pack_id").n_tokens.sum().max() <= 2048
        before = after


def test_near_duplicates_of_large_neighbourhoods(spark, monkeypatch):
    """The second stage keeps one document of each class, also where a neighbourhood is compared in tiles."""
    texts = near_copies(np.random.default_rng(3), 60)
    near, _ = matched(texts)
    group = list(range(len(texts)))
    while (low := [min(group[j] for j in np.flatnonzero(row)) for row in near]) != group:
        group = low
    monkeypatch.setattr(jaccard_join, "HOT", 10)
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 15)
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))


def test_personal_data_is_sought_only_where_it_can_begin():
    """The third stage's time is that of its texts, twice: prose costs little more than one look for digits, and nothing is lost."""
    pieces = [*"0123456789aZbQx_-.,: ()+@/;'", "é", "٣", "𝟗", "\U00011f53", "AKIA", "sk_live_", "xoxb-", "GB82", "Mr ", "Dr Mr ", "Señora ", "Otto ", "Braun", "+49 ", "(555) ", "fe80:", "1.2.3.4", "123-45-6789", "4111 1111 1111 1111", "0123456789abcdef" * 2, "ABCDEFGH" * 4]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for text, hinted in zip(texts, pii.hinted(pa.array(texts)).to_pylist()):
        assert hinted or not any(p.search(text) for p in (pii._NUMBERS, pii._TOKEN, pii._IBAN, pii._NAME, pii._EMAIL))
        numbers = [m.span() for m in pii._NUMBERS.finditer(text)]
        marks = [i for i, c in enumerate(text) if c.isdecimal() or c in "(+"]
        assert [m.span() for m in pii._matches(pii._NUMBERS, text, marks)] == numbers
        digits = [m.span() for m in re.finditer(r"\d+", text)]
        if all(text[x:y].isascii() for x, y in digits):
            assert [m.span() for m in pii._tokens(text, digits)] == [m.span() for m in pii._TOKEN.finditer(text)]

    def seconds(what):
        took = []
        for _ in range(3):
            began = time.thread_time()
            what()
            took.append(time.thread_time() - began)
        return min(took)

    prose = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) + " 7" * (k % 200 == 0) for k in range(100_000))
    assert seconds(lambda: pii.find(prose)) < 10 * seconds(lambda: re.findall(r"\d", prose))
