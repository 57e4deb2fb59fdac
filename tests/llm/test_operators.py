"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; brute force where SQL says nothing."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "One two three.", "one  two\n\n three", "a\tb don't 12 <|endoftext|> é ́ 日本 😀", "x" * 3000, "The same line\n" * 40, "word " * 9000]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string, sig int")
    df = df.unionByName(df.where("doc_id in (3, 4)"))
    return df if extra else df.select("doc_id", "text")


def whole(path):
    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_equals_whole_texts(path, monkeypatch):
    import pyarrow as pa

    from folio.llm import encoding

    own, ids = encoding.Encoder(path, held=500), whole(path)
    rng = random.Random(3)
    words = ["abc", "Hello", "café.", "x\ny", "A.\n\nB", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "can't", "12", "日本", "é", "\u0301", "#$x", "\x01"]
    texts = [*TEXTS, *("".join(rng.choice(" \n\taA.'sé　\x85́<|1!ſ\xa0\x1cİK") for _ in range(rng.randint(1, 14))) for _ in range(4000))]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", "  x"]) for _ in range(4000)]
    want = [ids(text) for text in texts]
    for size in (300, 4_000_000):
        monkeypatch.setattr(encoding, "PART_BYTES", size)
        got = [x.tolist() for flat, sizes in own.parts(pa.array(texts), 2) for x in np.split(flat, np.cumsum(sizes)[:-1])]
        assert got == want
    assert own.encode("").tolist() == [] and own.encode(texts[4]).tolist() == want[4][:-1]
    assert (49407 if path == WORD_BPE else 50256) in ids(TEXTS[5])


def test_token_output(spark):
    from folio.llm.common import Scratch
    from folio.llm.token_output import read_tokens, token_digests, write_token_files

    files = write_token_files(docs(spark), Scratch(spark, "t"), BYTE_BPE)
    got = [tuple(r) for r in token_digests(files).orderBy("start").collect()]
    ids, start, want = whole(BYTE_BPE), 0, []
    for i, t in sorted(((r.doc_id, r.text) for r in docs(spark).collect()), key=lambda r: r[0]):
        x = np.array(ids(t), "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert [r.ids for r in read_tokens(files, 0, 1).collect()] == [[2]]
    assert token_digests(write_token_files(docs(spark).limit(0), Scratch(spark, "t"), BYTE_BPE)).count() == 0


def test_packing(spark):
    from folio.llm.packing import pack

    for shard in (4_000_000, 3000):
        rows = pack(docs(spark), WORD_BPE, window=512, shard_tokens=shard).collect()
        ids = whole(WORD_BPE)
        texts = {r.doc_id: ids(r.text) for r in docs(spark).collect()}
        seen, sequences = collections.Counter(), collections.defaultdict(list)
        for r in rows:
            x = texts[r.doc_id]
            assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
            seen.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
            sequences[r.sequence_id].append((r.offset, r.length))
        times = collections.Counter(r.doc_id for r in docs(spark).collect())
        assert seen == collections.Counter({(d, i): times[d] for d, x in texts.items() for i in range(len(x))})
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 512 and at & (at - 1) == 0
    assert pack(docs(spark).limit(0), WORD_BPE).count() == 0


def flat(parts):
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def test_packing_puts_lexical_neighbours_together():
    from folio.llm.packing import plan

    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * t, 100 * t + 60, (12, 50)) for t in range(6)]
    order = rng.permutation(72)
    parts = [np.append(topics[i % 6][i // 6], 2) for i in order]
    windows = collections.defaultdict(set)
    for doc, _, _, sequence, _ in plan(*flat(parts), 204):
        windows[sequence].add(int(order[doc] % 6))
    assert np.mean([len(v) for v in windows.values()]) < 2.2


def test_bm25_order_is_that_of_brute_force(monkeypatch):
    from folio.llm import packing

    rng = np.random.default_rng(1)
    parts = [np.append(rng.integers(3, 40, rng.integers(0, 30)), 2).astype(np.uint16) for _ in range(60)]
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 100)
    index, free = packing.Bm25(*flat(parts)), np.ones(60, bool)
    texts = [p[:-1].tolist() for p in parts]
    mean = np.mean([len(t) for t in texts])
    df = collections.Counter(x for t in texts for x in set(t))

    def scores(d):
        out = {}
        for j, t in enumerate(texts):
            c = collections.Counter(t)
            s = sum(np.log1p((60 - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in set(texts[d]) if x in c)
            if j != d and free[j] and s > 0:
                out[j] = s
        return out

    for step in range(60):
        want, got = scores(step), index.ranked(step, free).tolist()
        assert set(got) == set(want) and all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))
        free[rng.integers(0, 60)] = False
        if step % 20 == 0:
            index.forget(free)


def test_packing_of_many_short_texts_takes_linear_time():
    import time

    from folio.llm import packing

    def took(docs):
        began = time.process_time()
        for _ in range(docs // packing.SHARD_DOCS):
            n = packing.SHARD_DOCS
            assert sum(r[2] for r in packing.plan(np.full(n, 2, np.uint16), np.arange(n + 1), 4096)) == n
        return time.process_time() - began

    assert took(packing.SHARD_DOCS) < 20  # a shard holds no more documents, so that more of them take as many times as long


def test_shards_are_cut_while_they_are_read(spark, monkeypatch):
    from folio.llm.packing import pack

    rows = [(i, "the same words in every copy " * 30) for i in range(300)] + [(1000, "long text " * 20_000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORD_BPE, window=128, shard_tokens=2000).collect()
    ids = whole(WORD_BPE)
    assert sum(r.length for r in got) == sum(len(ids(t)) for _, t in rows) and len({r.doc_id for r in got}) == 301


def test_chat(spark):
    from folio.llm.chat import MARK, escape, format_conversations, parse, render

    rng = random.Random(1)
    bits = ["\\", "#", "###", "</turn>", "<", "|", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "endoftext", "\n", "\n\nx", ":", "a", " ", "é", "😀", "p>", "(x)", "### assistant:", "ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "sy:s\n#", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(9))]), 0) for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [rows[0], (None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t if t is not None else -1, role, text))
    got = {r.conv_id: r for r in format_conversations(df, BYTE_BPE).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1] or "", x[1] is not None, x[2] or ""))
        pairs = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in pairs if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert [(r, t) for r, t, _, _ in parse(render(pairs))] == pairs and got[c].formatted == render(pairs)
        assert all(MARK not in escape(t) for _, t in pairs)
        # the token mask covers the escaped texts and no character beside them
        encoded = Tokenizer.from_file(BYTE_BPE).encode(got[c].formatted, add_special_tokens=False)
        under = {i for (s, e), own in zip(encoded.offsets, got[c].loss_mask, strict=True) if own for i in range(s, e)}
        assert under == {i for r, _, s, e in parse(got[c].formatted) if r == "assistant" for i in range(s, e)}
    assert format_conversations(df.limit(0), BYTE_BPE).count() == 0


def test_quality_rules(spark):
    from folio.llm.quality_rules import quality_rules, repeated_words

    rng = random.Random(5)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 50))]
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert repeated_words(w) == len({i + j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(8)})
    good = " ".join(f"Plain{i} prose{i} number{i}." for i in range(20))
    menu = "\n".join(f"Home{i} | About{i} | Contact{i}" for i in range(20))
    rows = {r.doc_id: r for r in quality_rules(docs(spark, [*TEXTS, good, menu, good + "\n" + "Read more"])).collect()}
    n = len(TEXTS)
    assert (rows[n].kept, rows[n + 1].kept, rows[n + 2].kept, rows[n + 1].base_failed) == (True, False, True, False)
    assert rows[n + 2].cleaned == good
    assert (rows[1].n_words, rows[1].base_failed, rows[7].n_dup_lines, rows[7].n_repeat_words) == (0, True, 39, 120)
    assert quality_rules(docs(spark)).count() == len(TEXTS) + 2 and quality_rules(docs(spark).limit(0)).count() == 0


def test_quality_rules_of_lines():
    from folio.llm.quality_rules import clean, line_fails

    fails = lambda line: line_fails(line.split(), line)
    notice = "We use cookies to give you the best experience on our site; by going on you accept our cookie policy and our privacy policy."
    for line in ("All rights reserved.", "All  rights reserved.", "By continuing you accept our cookie policy.", "(c) X. All rights reserved.", "Click here!", notice, "Subscribe to our letter", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Política de privacidad"):
        assert fails(line), line
    prose = "The court held that the copyright in the work had passed to the publisher long before the author wrote to him about it."
    for line in (prose, "A catalog in the design institute lists them.", "Read moreover the second part.", "A heading of six words only", "這是沒有空格的一行"):
        assert not fails(line), line
    assert fails("one two three four five six seven eight") and not fails("one two three four five six seven eight.")
    assert not fails("First it ended. Then it went on. Then the line was cut off in the")
    assert not fails("यह एक पूरा वाक्य है जो यहाँ समाप्त होता है।") and not fails("ก ข ค ง จ ฉ ช ซ ฌ")
    body = "\n".join(f"Plain{i} prose{i} stands{i} here{i}." for i in range(9))
    assert clean(body + "\n(c) X. All rights reserved.")[-1] == body


def test_quality_counts_equal_brute_force():
    from folio.llm.quality_rules import clean

    rng = random.Random(12)
    blank = {" ", *map(chr, range(9, 14))}
    for _ in range(800):
        text = "".join(rng.choice([*"ab#*$|<> \n\t\x0bé\xa0\u2003", "a b c d e f g h ", "\nsame line"]) for _ in range(rng.randint(0, 40)))
        words = "".join(" " if c in blank else c for c in text).split(" ")
        words = [w for w in words if w]
        lines = text.split("\n")
        dup = sum(any(c not in blank for c in x) and x in lines[:i] for i, x in enumerate(lines))
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        again = len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)})
        failed = len(words) < 20 or 100 * again > 30 * len(words)
        assert clean(text)[:6] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, again, failed), ascii(text)
        assert not (failed and clean(text)[6])


def test_rollup(spark, tmp_path):
    from folio.llm.rollup import TokenRollup

    shape = "op string, source string, lang string, tokenizer_version string, tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), shape)
    r = TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("a", batch(("insert", "s", "en", "v", 5, None), ("insert", "s", None, "v", 7, None), ("insert", "s", "en", "v", None, None)))
    assert not r.commit("a", batch(("insert", "s", "en", "v", 5, None)))
    assert r.commit("b", batch(("revise", "s", "en", "v", 9, 5), ("delete", "s", None, "v", 7, None)))
    assert r.commit("empty", batch().limit(0))
    want = [("s", "en", "v", 2, 9)]
    assert [tuple(x) for x in r.totals().collect()] == want
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == want
    r.commit("c", batch(("insert", "t", "en", "v", 1, None)))
    r.compact()
    assert sorted(tuple(x) for x in TokenRollup(spark, str(tmp_path / "r")).totals().collect()) == [*want, ("t", "en", "v", 1, 1)]
    with pytest.raises(Exception, match="unknown op"):
        r.commit("d", batch(("swap", "t", "en", "v", 1, None)))
    assert r.committed() == {"a", "b", "empty", "c"}


def test_rollup_survives_crashes(spark, tmp_path, monkeypatch):
    from folio.llm.rollup import TokenRollup

    shape = "op string, source string, lang string, tokenizer_version string, tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), shape)
    row = ("insert", "s", "en", "v", 5, None)
    r = TokenRollup(spark, str(tmp_path / "r"))
    whole = TokenRollup._write

    def broken(self, name, lines):  # the file is there, its text is not
        self._fs.create(self._at(name), False).close()
        raise RuntimeError("lost")

    for step in ("commit", "compact"):
        monkeypatch.setattr(TokenRollup, "_write", broken)
        with pytest.raises(RuntimeError, match="lost"):
            r.commit("a/../b", batch(row)) if step == "commit" else r.compact()
        monkeypatch.setattr(TokenRollup, "_write", whole)
        assert r.totals().count() == (step == "compact")
        assert r.commit("a/../b", batch(row)) == (step == "commit")
        assert not r.commit("a/../b", batch(row))
        assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 1, 5)] and r.committed() == {"a/../b"}
    assert not r._publish("commits/a%2F..%2Fb", ["deltas/other"]) and r.totals().count() == 1
    for i in range(4):  # older deltas go, totals stay
        assert r.commit(f"n{i}", batch(row, row))
        r.compact()
        assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 3 + 2 * i, 15 + 10 * i)]
    assert len(r._names("deltas")) <= 4 + 1


def test_rollup_query_equals_brute_force(spark):
    from folio.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    seen, want = set(), collections.defaultdict(lambda: [0, 0])
    for r in sorted(rows, key=lambda r: (r.doc_id, r.source, r.lang)):
        if (r.text or "") not in seen:
            seen.add(r.text or "")
            for version, path in (("byte_bpe_50k", BYTE_BPE), ("word_bpe_49k", WORD_BPE)):
                own = want[r.source, r.lang, version]
                own[0], own[1] = own[0] + 1, own[1] + len(whole(path)(r.text)) - 1
    assert {(r.source, r.lang, r.tokenizer_version): [r.docs, r.tokens] for r in QUERIES["op4_token_rollup"](spark, sf).collect()} == want


def test_quality_model(spark):
    from folio.llm.quality_model import AttentionModel, fit, held_out, score, train

    rng = random.Random(2)
    good = [" ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}o{rng.randint(0, 99)}n." for _ in range(rng.randint(5, 300))) for _ in range(120)]
    bad = [t.replace("o", "###").upper() for t in good]
    rows = [(i, t, 0.5) for i, t in enumerate([*good, *bad, "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 240, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = score(df, fit(df, labels)).collect()
    assert all((r.score > 0.5) == (r.doc_id < 120) for r in got if r.doc_id < 240)
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in score(df, fit(df, labels)).collect()] == [r.score for r in got]
    assert {r.score for r in score(df, fit(df, labels.limit(0))).collect()} == {0.5}
    assert score(df.limit(0), fit(df, labels)).count() == 0
    assert isinstance(train([], np.zeros(0)), AttentionModel)
    assert {r.h for r in df.select(held_out().alias("h"), "doc_id").where("doc_id < 50").collect()} == {True, False}


def test_quality_model_reads_long_runs_whole(monkeypatch):
    from folio.llm import quality_model as q

    clean, junk = "文字" * 4000, "#%|=" * 2000
    x, starts = q.encode([clean + clean, clean + junk, junk + clean, "a" * 200 + "b", "a" * 200 + "c"], q.Words())
    whole, mixed, turned, b, c = (x[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True))
    assert len(whole) == len(mixed) == len(turned) == 1 and not np.array_equal(whole, mixed) and not np.array_equal(b, c)
    assert np.allclose(mixed[:, 3 : q.WORD_FEATURES], turned[:, 3 : q.WORD_FEATURES])
    assert len(q.encode([clean * 10], q.Words())[0]) == -(-80_000 // q.PIECE_CHARS // q.PASSAGE_WORDS)
    texts = ["".join(map(chr, range(0x4E00, 0x4E00 + 5000))), "x y", junk + " end."]
    before = q.encode(texts, q.Words())[0]
    monkeypatch.setattr(q, "BLOCK_CHARS", 300)
    words = q.Words(chars=10)
    assert np.array_equal(q.encode(texts, words)[0], before) and np.array_equal(q.encode(texts, words)[0], before)
    assert words.held == sum(map(len, words))


def test_secrets(spark):
    from folio.llm.secrets import find_secrets, redact_secrets, scan

    key, weak = "AKIA" + "B7" * 8, "Xk9/aB3+Zq81mmPqLrTzVwYs0kJhGfDc"
    text = f"id {key} then {weak} at https://s3.example.com/b"
    assert [k for _, _, k in scan(text)[1]] == ["access", "weak_secret", "weak_endpoint"]
    assert scan(weak)[1] == scan(f"{key}\n\n{weak}")[1][1:] == []
    assert [x[2] for x in scan("PassWord = 'abc' api_key:\"abcdefg ſecret=abcdefgh " + "a1" * 12)[0]] == ["assign", "hex"]
    df = docs(spark, [*TEXTS, text])
    rows = {r.doc_id: r for r in find_secrets(df).collect()}
    assert rows[len(TEXTS)].base_sha256 == hashlib.sha256(b"access:3:23").hexdigest() and rows[1].spans == ""
    out = {r.doc_id: r for r in redact_secrets(spark.createDataFrame([(1, text, 3), (2, None, None)], "doc_id long, text string, n_chars long")).collect()}
    assert out[1].text == "id [SECRET] then [SECRET] at https://s3.example.com/b" and out[1].n_chars == len(out[1].text) and out[2].text is None
    assert find_secrets(df.limit(0)).count() == 0


def base_by_hand(text):
    """The base patterns, character by character."""
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out, i = [], 0
    while i < len(text):
        end = None
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(key, i):
                j = i + len(key)
                j += text[j : j + 1] in ("'", '"')
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"')
                k = j
                while k < len(text) and text[k] in word:
                    k += 1
                if k > j:
                    end = k
                    if k - j >= 6:
                        out.append((i, k, "assign"))
                    break
        i = end or i + 1
    for first, chars, least, kind in (("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, "access"), ("", "0123456789abcdef", 24, "hex")):
        i = 0
        while i < len(text):
            j = i + len(first)
            while text.startswith(first, i) and j < len(text) and text[j] in chars:
                j += 1
            if not text.startswith(first, i) or j == i + len(first):
                i += 1
                continue
            if j - i >= least:
                out.append((i, j, kind))
            i = j
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def test_secrets_equal_brute_force():
    from folio.llm.secrets import ORDER, scan

    rng = random.Random(8)
    bits = ["password", "PassWd", "token", "api_key", "APIkey", "secret", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "AKIA" + "X1" * 8, "a1b2c3d4e5f6" * 2, "ſecret", "\n", "\n\n", "é", "-.", "id: user77", "Xk9/aB3+Zq81mmPqLrTz", "db.internal", "https://x.y/z"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        base, spans = scan(text)
        assert base == base_by_hand(text), text
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (x[0], ORDER.index(x[2])))
        # each weak part has its complements in its own scope, by comparing all pairs
        scope = lambda x: len(re.findall(r"\n[ \t]*\n", text[: x[0] + 1]))
        side = {"assign": "s", "hex": "s", "weak_secret": "s", "access": "a", "weak_access": "a", "weak_endpoint": "e"}
        for x in spans:
            near = {side[y[2]] for y in spans if y != x and scope(y) == scope(x)}
            assert x[2] in ORDER[:3] or {"weak_secret": {"a"}, "weak_access": {"s"}, "weak_endpoint": {"a", "s"}}[x[2]] <= near, text


def test_secrets_have_no_reach_but_their_scope():
    from folio.llm.secrets import scan

    key, weak = "AKIA" + "B7" * 8, "Xk9/aB3+Zq81mmPqLrTzVwYs0kJhGfDc"
    host = ".".join(f"a{i}" for i in range(40)) + ".internal:5432"
    for gap in (10, 5000, 200_000):
        text = key + " x" * gap + " " + weak + " x" * gap + " " + host
        spans = scan(text)[1]
        assert [k for _, _, k in spans] == ["access", "weak_secret", "weak_endpoint"] and text[spans[2][0] : spans[2][1]] == host
    assert [k for _, _, k in scan(f"{key}\n \t\n{weak}")[1]] == ["access"]
    assert [k for _, _, k in scan(f"{key} {weak} a.internal.example b.internalx")[1]] == ["access", "weak_secret"]
    scan(f"{key} {weak} " + "a." * 200_000 + " " + "-" * 200_000)


def test_redaction_keeps_other_columns(spark):
    from folio.llm.secrets import redact_secrets

    text = "token = abcdef123"
    df = spark.createDataFrame([(1, text, 17, "x"), (1, text, 17, "x"), (2, "", 0, None), (3, None, None, None)], "doc_id long, text string, n_chars int, spans string")
    assert sorted(map(str, (tuple(r) for r in redact_secrets(df).collect()))) == sorted(map(str, [(1, "[SECRET]", 8, "x")] * 2 + [(2, "", 0, None), (3, None, None, None)]))
    odd = spark.createDataFrame([(text, "n")], "text string, n_chars string")
    assert tuple(redact_secrets(odd).first()) == ("[SECRET]", "n") and redact_secrets(df.limit(0)).count() == 0


def test_quality_gradients_equal_differences():
    from folio.llm import quality_model as q

    rng = np.random.default_rng(3)
    x, starts, y = rng.normal(size=(9, q.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    draw = lambda *shape: rng.normal(0, 0.4, shape)
    model = q.AttentionModel(0, 1, {"W": draw(q.FEATURES, q.HIDDEN), "b": draw(q.HIDDEN), "V": draw(q.HIDDEN, q.GATE), "U": draw(q.HIDDEN, q.GATE), "w": draw(q.GATE), "c": draw(q.HIDDEN), "d": draw(1)})

    def loss():
        s = model.forward(x, starts)["s"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in model.gradients(x, starts, y).items():
        p = model.p[name]
        for i in rng.integers(0, p.size, 5):
            at = np.unravel_index(i, p.shape)
            kept = p[at]
            p[at] = kept + 1e-6
            up = loss()
            p[at] = kept - 1e-6
            down = loss()
            p[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5, name


def test_quality_fit_is_bounded(spark, monkeypatch):
    from folio.llm import quality_model as q

    seen = []
    monkeypatch.setattr(q, "train", lambda bags, y: seen.append((len(bags), sum(map(len, bags)))))
    df = spark.createDataFrame([(i % 50, f"word{i} and so on " * (1 + 900 * (i == 7))) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, i % 50 % 2) for i in range(100)], "doc_id long, quality int")
    q.fit(df, labels, fit_rows=10)
    q.fit(df, labels, fit_rows=50, fit_passages=30)
    q.fit(df, labels.limit(0))
    assert seen[0][0] == 10 and seen[1][1] <= 30 and seen[1][0] <= 50 and seen[2] == (0, 0)


def test_quality_of_held_out_documents(spark):
    """Accuracy and rank on the fifth of the labels that are never learned from."""
    from folio.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES["op5_quality_model"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, y in rows if y == 1], [s for s, _, y in rows if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert len(rows) > 30 and auc > 0.9 and np.mean([p == y for _, p, y in rows]) > 0.85


def test_ties_have_one_result(spark):
    from folio.llm.html_wrappers import extract_text
    from folio.llm.quality_model import fit, score

    df = spark.createDataFrame([(i, "the same words in every text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert len({r.score for r in score(df, fit(df, labels)).collect()}) == 1
    half = "<div class=a><p>some words of the left side</p></div><div class=b><p>some words of the right side</p></div>"
    pages = spark.createDataFrame([(i, "http://tie.example/", half) for i in range(5)], "page_id long, url string, html string")
    texts = [{r.text for r in extract_text(pages.repartition(n)).collect()} for n in (1, 3)]
    assert texts[0] == texts[1] and len(texts[0]) == 1


def test_clashing_columns_pass_through(spark):
    from folio.llm.decontamination import drop_contaminated
    from folio.llm.quality_model import fit, score
    from folio.llm.set_join import keep_first

    texts = ["a b c d e f g", "a b c d e f g", None, "", "some other words here in a row of ten words or so"]
    names = ["first", "score", "dk", "__dk", "comp", "ck", "n", "sig", "low"]
    df = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)], ["doc_id", "text", *names])
    bench = spark.createDataFrame([(1, "words here in a row of ten words or so", 2)], "item_id long, text string, dk long")
    by = {r.doc_id: r for r in df.collect()}
    kept = keep_first(df).collect()
    assert {r.doc_id for r in kept} == {0, 2, 3, 4} and all(r == by[r.doc_id] for r in kept)
    clean = drop_contaminated(df, bench).collect()
    assert {r.doc_id for r in clean} == {0, 1, 2, 3} and all(r == by[r.doc_id] for r in clean)
    scored = score(df, fit(df, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert {r.score for r in scored} == {0.5} and all(r.first == by[r.doc_id].first and r.text == by[r.doc_id].text for r in scored)


def test_html():
    import json

    from folio.llm.html_wrappers import Node, extract, merge, parse, rules, template

    page = "<html><head><title>t</title></head><body><nav><a>m</a></nav><div class='ad'>buy</div><article><h1>T &amp; {0}</h1>{1}<div class='comments'><p>no</p></div></article><footer>f</footer>"
    bodies = ["<p>One <b>two</b>\n three<p>Next", "<p>a</p><ul><li>x<li>y</ul>", "<h2>s</h2><p>a</p><h2>r</h2><p>b</p>", "<aside>no</aside><p>a &lt;b&gt;"]
    want = ["One two three\n\nNext", "a\n\nx\n\ny", "s\n\na\n\nr\n\nb", "a <b>"]
    pages = [page.replace("{0}", str(i)).replace("{1}", b) for i, b in enumerate(bodies)]
    trees = [template(parse(p)) for p in pages]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0]):
        wrapper = trees[order[0]]
        for i in order[1:]:
            wrapper = merge(wrapper, trees[i])
        known = rules(Node.load(json.loads(json.dumps(wrapper.dump()))))
        assert [extract(parse(p), known) for p in pages] == [f"T & {i}\n\n{w}" for i, w in enumerate(want)]
    for odd in ("", "<", "<p", "<script>x", "<!-- x", "<div class=\"a"):
        extract(parse(odd), rules(template(parse(odd))))
    deep = "<article>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "<p>end</article>"
    assert extract(parse(deep), rules(template(parse(deep)))) == "x\n\nend"


def test_html_exclusion_reads_all_attributes_at_any_depth():
    from folio.llm.html_wrappers import MAX_DEPTH, extract, parse, rules, template

    text = lambda html: extract(parse(html), rules(template(parse(html))))
    long = " ".join(f"md:w-1/{i} px" for i in range(20))
    for marks in (f"class='{long} comments'", f"class='{long}' id='comments'", f"class='{long}' role='complementary'"):
        assert text(f"<article><p>a</p><div {marks}><p>no</p></div></article>") == "a"
    assert text(f"<p>no</p><div class='{long}' id='content'><p>a</p></div>") == "a"
    for deep in ("<nav>no</nav>", "<footer>no<p>no</footer>", "<div class='comments'><div><p>no</div></div>", "<nav><ul><li>no<li>no</ul></nav>"):
        assert text("<article>" + "<div>" * (MAX_DEPTH + 30) + f"<p>a{deep}<p>b<header>c</header>") == "a\n\nb\n\nc"
    assert text("<div>" * (MAX_DEPTH + 30) + "<p>a<header>no</header><p>b") == "a\n\nb"


def test_html_constants_of_any_size_stay_constant():
    import json

    from folio.llm.html_wrappers import Node, _packed, extract, merge, parse, rules, template

    shared = "This text of more than forty characters stands on every page of the host."
    pages = [f"<section>{shared}</section><p>{body}</p><blockquote>{body}</blockquote>" for body in ("x " * 20_000, "y " * 900, "z " * 900, "w " * 900)]
    part = lambda html: Node.load(json.loads(_packed(template(parse(html)))))
    wrapper = part(pages[0])
    for html in pages[1:]:
        wrapper = Node.load(json.loads(_packed(merge(wrapper, part(html)))))
    assert [extract(parse(p), rules(wrapper)) for p in pages] == ["\n\n".join([parse(p).children[1].children[0].text] * 2) for p in pages]
    assert len(_packed(part(pages[0]))) < 1000


def test_html_copies_are_one_page():
    import json

    from folio.llm.html_wrappers import Node, _packed, extract, merge, parse, rules, template

    def texts(*pages):
        wrapper = template(parse(pages[0]))
        for p in pages[1:]:
            wrapper = Node.load(json.loads(_packed(merge(wrapper, template(parse(p))))))
        return [extract(parse(p), rules(wrapper)) for p in pages]

    page = "<h1>Head {0}</h1><p>Body {0}</p><div><b>Site</b> <!-- {1} -->text</div>"
    copy, own = page.replace("{0}", "one"), "<section>Only here</section>"
    for n in (1, 2, 3, 9):
        assert texts(*[copy.replace("{1}", str(i)) for i in range(n)]) == ["Head one\n\nBody one\n\nSite text"] * n
    others = [page.replace("{0}", x) for x in ("two", "three")]
    assert texts(*[copy + own] * 5, *others) == ["Head one\n\nBody one\n\nOnly here"] * 5 + [f"Head {x}\n\nBody {x}" for x in ("two", "three")]


def wrapped(*pages):
    """The pages' wrapper, sent from task to task, and the text of each page by it."""
    import json

    from folio.llm.html_wrappers import Node, _packed, extract, merge, parse, rules, template

    wrapper = None
    for p in pages:
        one = template(parse(p))
        wrapper = Node.load(json.loads(_packed(merge(wrapper, one) if wrapper else one)))
    known = rules(wrapper)
    return wrapper, [extract(parse(p), known) for p in pages]


def test_html_main_text_by_what_varies():
    """Neutral names, no article or main: the region is where the host's pages vary in prose."""
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice(["ember", "stone", "valley", "drifts", "under", "glass"]) for _ in range(30)) + "."
    menu = "".join(f"<li><a href=/{i}>Part {i}</a>" for i in range(30))
    want, pages = [], []
    for i in range(4):
        blocks = [prose() for _ in range(rng.randint(2, 5))]
        links = "".join(f"<li><a href=/{i}/{j}>See {rng.randint(0, 99)}</a>" for j in range(60))
        body = "".join(f"<p>{b}" for b in blocks)
        pages.append(f"<div class=x1><ul>{menu}</ul></div><div class=x2><div class=x3><h1>Title {i}</h1><div class=x4>{body}</div></div><div class=x5><ul>{links}</ul></div></div><div class=x6><p>{'The same closing words on every page of this host. ' * 8}</p></div>")
        want.append("\n\n".join([f"Title {i}", *blocks]))
    assert wrapped(*pages)[1] == want
    # alone, the long closing words and the page's own text can't be told apart; the host's other pages change the result
    long = f"<div class=y1><p>{'words that stand on every page ' * 20}</p></div><div class=y2><p>short own text number 5 of the page</p></div>"
    others = [long.replace("number 5", f"number {i}") for i in range(6, 9)]
    assert wrapped(long)[1] == [" ".join(("words that stand on every page " * 20).split())]
    assert wrapped(long, *others)[1][0] == "short own text number 5 of the page"
    teaser = "<div class=z1><article><p>A teaser</p></article></div><div class=z2><section>{}</section></div>"
    assert wrapped(*[teaser.format(f"<p>{prose()}<p>{prose()}") for _ in range(3)])[1][0].count("\n\n") == 1


def test_html_alignment_accepts_both_sides():
    """Any two streams of tags: the aligned one, as a regular expression, matches both; keys that each side has once in the same order stay whole."""
    from folio.llm.html_wrappers import Node, align, fold_repeats, matched

    def expression(nodes):
        out = ""
        for n in nodes:
            one = "(?:" + expression(n.children) + ")" if n.key.startswith("#group ") else f"(?:{n.key};)"
            out += one + ("*" if n.optional and n.repeated else "+" if n.repeated else "?" if n.optional else "")
        return out

    rng = random.Random(9)
    for step in range(1500):
        a, b = ([rng.choice("abcdef"[: 2 + step % 5]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        pattern = expression(align(fold_repeats([Node(k) for k in a]), fold_repeats([Node(k) for k in b])))
        assert all(re.fullmatch(pattern, "".join(f"{k};" for k in x)) for x in (a, b)), (a, b, pattern)
        pairs = matched(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert matched(list("xabcy"), list("abzc")) == [(1, 0), (2, 1), (3, 3)]
    many = [Node(f"{k}{i}") for i in range(3000) for k in "ab"]
    assert len(align(many, list(reversed(many)))) >= 6000


def test_html_marks_that_differ_by_page_do_not_grow_the_wrapper():
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    pages = [f"<body><div id=p-{word(i)}q><p>Body of page {i} in so many words as it takes.</p></div><div class=note><p>Note</p></div>" for i in range(200)]
    wrapper, texts = wrapped(*pages)
    assert len(wrapper.children[0].children) < 30
    assert texts == [f"Body of page {i} in so many words as it takes." for i in range(200)]


def test_html_table(spark):
    from folio.llm.html_wrappers import extract_text

    rows = [(1, "http://A.example/x", "<article><p>a</p></article>", 1), (1, "http://A.example/x", "<article><p>a</p></article>", 1), (2, None, None, 1), (3, "odd", "plain", 1), (4, "http://a.example/", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "plain", 5), (4, "", 0)]
    assert extract_text(df.limit(0)).count() == 0


UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def components(rows):
    sets, index, parent = {}, collections.defaultdict(list), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(UPPER.get(c, c) for c in t or ""))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        both = collections.Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].append(i)
        for j, c in both.items():
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_texts(seed):
    rng, out = random.Random(seed), []
    words = [f"w{i}" for i in range(2000)]
    shared = [rng.choice(words) for _ in range(60)]
    for _ in range(90):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 7, 8, 10, 12, 15, 20, 25, 30, 40, 60, 100, 200]))]
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = shared
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, int(len(t) * rng.choice([0.01, 0.03, 0.05]))))):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t) if rng.random() < 0.7 else "\n".join(t).upper())
    return [*out, None, "", " \n", "One", "one"]


@pytest.mark.parametrize(("seed", "hot"), [(0, 32), (1, 2)])
def test_set_join(spark, seed, hot):
    from folio.llm.set_join import SetJoin

    rows = list(enumerate(near_texts(seed)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in SetJoin(df, hot=hot).members().collect()}
    assert got == components(rows)


def test_keep_first(spark):
    from folio.llm.set_join import keep_first

    t = "a b c d e f g"
    df = spark.createDataFrame([(3, t, 1), (3, t, 1), (5, t, 1), (6, "x y z", 2), (None, "other words", 3), (7, None, 4), (8, None, 4)], "doc_id long, text string, sig int")
    assert sorted(str(r.doc_id) for r in keep_first(df).collect()) == ["3", "6", "7", "8", "None"]
    assert keep_first(df.limit(0)).count() == 0


def test_decontamination(spark):
    from folio.llm.decontamination import PositionalIndex, contamination, drop_contaminated, item_windows

    rng = random.Random(4)
    vocabulary = ["the", "of", "é", "a1", *(f"w{i}" for i in range(30))]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)] + [(20, None), (21, " ,.")]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            part = items[rng.randrange(12)][1].split()
            at = rng.randint(0, len(part) // 2)
            w[len(w) // 2 : len(w) // 2] = part[at : at + rng.randint(8, 14)]
        texts.append(", ".join(w))
    rows = [(i, t) for i, t in enumerate([*texts, None, "", texts[0]])] + [(0, texts[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, w int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(UPPER.get(c, c) for c in t or ""))
    want = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            n = min(10, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r)[:6] for r in contamination(df, bench).collect()]
    assert sorted(got) == sorted(want)
    clean = sorted(d for d, *_, bad in want if not bad)
    assert sorted(r.doc_id for r in drop_contaminated(df, bench).collect()) == clean
    assert all(not r.contaminated for r in contamination(df, bench.limit(0)).collect()) and contamination(df.limit(0), bench).count() == 0
    near = spark.createDataFrame([(1, "alpha gap beta"), (2, "alpha x y z q beta"), (3, "beta alpha")], "doc_id long, text string")
    phrases = item_windows(spark.createDataFrame([(1, "Alpha beta")], "item_id long, text string"))
    index = PositionalIndex(near, phrases.selectExpr("explode(terms) term"))
    found = index.proximity(phrases, 1).join(index.documents(), "dk").collect()
    assert {r.doc_id for r in found} == {1}


def test_proximity_at_a_document_start(spark):
    from folio.llm.decontamination import PositionalIndex, item_windows

    df = spark.createDataFrame([(1, "rare x"), (2, "a rare x"), (3, "x x x"), (4, "rare a b c x")], "doc_id long, text string")
    phrases = item_windows(spark.createDataFrame([(1, "x rare")], "item_id long, text string"))
    index = PositionalIndex(df, phrases.selectExpr("explode(terms) term"))
    assert {r.doc_id for r in index.proximity(phrases, 2).join(index.documents(), "dk").collect()} == {1, 2}


def test_workers_let_go_of_what_another_operator_held():
    import pyarrow as pa

    from folio.llm import packing, set_join
    from folio.llm.encoding import encoder

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["five words make two shingles"])], names=["doc_id", "text"])
    list(set_join._index(4, 85)(iter([batch])))
    assert set_join._hashes.cache_info().currsize == 1
    list(packing._tokenize(WORD_BPE, 2)(iter([batch])))
    assert set_join._hashes.cache_info().currsize == 0 and encoder.cache_info().currsize == 1
    list(set_join._index(4, 85)(iter([batch])))
    assert encoder.cache_info().currsize == 0


def test_lists_of_postings_are_joined_once(monkeypatch):
    from folio.llm import packing

    joins, join = [], np.concatenate
    index, free = packing.Bm25(*flat([np.array([3, 4, 5, 2], np.uint16)] * 4)), np.ones(4, bool)
    monkeypatch.setattr(np, "concatenate", lambda x, *a, **k: joins.append(len(x)) or join(x, *a, **k))
    assert index.ranked(0, free).tolist() == [1, 2, 3] and joins == [3]


def test_set_join_of_components_that_many_pairs_link(spark, monkeypatch):
    from folio.llm import set_join

    rng, rows = random.Random(5), []
    for family in range(3):
        base = [f"{family}w{i}" for i in range(400)]
        for m in range(60):
            t = list(base)
            for i in rng.sample(range(400), 2 if m < 30 else 7 if m < 45 else 12):
                t[i] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    made, verified = collections.Counter(), set_join.SetJoin._verified

    def counted(self, pairs, name):
        made[name.rstrip("0123456789")] += pairs.count()
        return verified(self, pairs, name)

    monkeypatch.setattr(set_join, "AT_ONCE", 0, raising=False)
    monkeypatch.setattr(set_join.SetJoin, "_verified", counted)
    monkeypatch.setattr(set_join.SetJoin, "_heads", lambda self, held, facts, turn: self.buckets.selectExpr("ck a", "ck b").limit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.SetJoin(spark.createDataFrame(rows, "doc_id long, text string")).members().collect()}
    assert got == components(rows)
    assert made["rest"] < 500  # all at once they are 623
