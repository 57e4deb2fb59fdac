"""The pipeline on its synthetic table: what each stage keeps, and the registered queries' columns."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm.queries import ORACLE_SQL, QUERIES
from folio.llm.secrets import redact, scan

from test_operators import UPPER, components  # the folder is on the path while tests are collected

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).persist()
        assert out.columns == docs.columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "quality classifier":
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.98 * len(good)
        if name == "secret scans":
            assert out.count() == docs.count()
        docs = out


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(UPPER.get(c, c) for c in t or ""))
    w = words(text)
    for item in map(words, items):
        n = min(10, len(item))
        own = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        if any(tuple(w[i : i + n]) in own for i in range(len(w) - n + 1) if n):
            return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages after the classifier by plain loops, on what it keeps; nulls, repeated rows, empty and long texts, clashing columns."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 90))) for _ in range(25)]
    items = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(3)]
    texts = [*base, *(t.replace("word1 ", "word2 ", 1) for t in base[:8]), base[0], None, "", " ", *(f"{b} {items[i % 3]} {b}" for i, b in enumerate(base[9:13]))]
    texts += [f"{base[14]} password = hunter{i}x key AKIA{'Q7' * 8}" for i in range(3)] + [" ".join(rng.choice(words) for _ in range(30_000))]
    rows = [(i, t, "en", f"s{i}", 0 if t is None else len(t), i) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "an id that is null " + base[20], None, None, None, None)]
    shape = "doc_id long, text string, lang string, first string, n_chars int, score int"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate([*items, None, ""])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [tuple(r) for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()]
    assert set(kept) <= {tuple(r) for r in docs.collect()}
    numbered = list({(r[0], r[1]): r for r in kept}.values())
    parts = components([(i if r[0] is None else r[0], r[1]) for i, r in ((1000 + i, r) for i, r in enumerate(numbered))])
    first = [r for i, r in ((1000 + i, r) for i, r in enumerate(numbered)) if parts[i if r[0] is None else r[0]][1] == (i if r[0] is None else r[0])]
    clean = [r for r in first if not contaminated(r[1], items)]
    safe = [(r[0], redact(r[1] or "", scan(r[1] or "")[1])) for r in clean]
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tokens.encode(t, add_special_tokens=False).ids, 2] for d, t in safe}
    assert len(ids) == len(safe) and len(safe) < len(kept)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen, sequences = collections.Counter(), collections.defaultdict(list)
    for r in pieces:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen.update((r.doc_id, r.start + i) for i in range(r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == collections.Counter((d, i) for d, x in ids.items() for i in range(len(x)))
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [o for o, _ in sorted(own)] == ends[:-1] and (ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
