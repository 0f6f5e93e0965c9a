"""Periodic runs, encoding by distinct words and token alignment against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from mediaspark.llm import blocks, periodic, queries, token_align, word_bpe
from mediaspark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, block bigint, word string, pair bigint"
A, B, WORDS = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"
ODD = [
    None, "", " \t\n", "a", "one two  three\n\nfour", "x y x y x y x y x y", "Å É ﬁ ʼn İstanbul ΣΑΣ", "<|endoftext|>a <|startoftext|><s>b</s>", "a b c\u0085d\x1ce", "▁ under ▁score a▁b",
    "日本語 текст 🙂🙃 é ́x", "don't I'LL we've 'S 12345 v2.0", "\x00\x01 z", "  lead and trail  ", "abc" * 2000, "q7" * 1500, "tab\tand\x0bvt\x0cff\rcr", "a b c d e f " * 40, "dup", "dup", "﻿bom ​ zero",
]


def documents(spark, texts):
    rows = [(k, t, None if k % 3 else "en", None, None, 1, "w", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pydict()


# --- periodic runs ----------------------------------------------------------------------------------------------------


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every period at every place, as the rule says it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            smaller = any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q))
            if j + q - i >= max(6, 4 * q) and not smaller:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_op11(doc: int, text: str | None) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_runs_of_small_alphabets():
    rng = random.Random(3)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words: list[bytes] = []
            for _ in range(rng.randrange(6)):
                words += [b"%d" % rng.randrange(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 9)
                words = words[: len(words) - rng.randrange(2)]
            texts.append(words)
        assert periodic.runs_of(texts) == [plain_runs(w) for w in texts]


def test_splitting_keeps_every_run_and_little_else():
    rng = random.Random(4)
    words = np.array([rng.randrange(3000) for _ in range(4000)])
    words[1000:1060] = np.tile([5000, 5001, 5002], 20)
    at, segment = periodic.survivors(words, np.zeros(4000, np.int64))
    assert set(range(1000, 1060)) <= set(at.tolist()) and len(at) < 120 and len(at) == len(segment)
    assert (1000, 60, 3) in periodic.scan(words, at, segment)


def test_long_text_of_few_words_is_scanned_in_time():
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(50) for _ in range(300_000)]
    period = [b"%d" % rng.randrange(50) for _ in range(20_000)]
    words[100_000:190_000] = (period * 5)[:90_000]
    assert any(q == 20_000 and n >= 90_000 for _, n, q in periodic.runs_of([words])[0])


def test_periodic_runs_on_odd_rows(spark):
    texts = [*ODD, "y " * 6, "y " * 5, "u v " * 4, "u v " * 3 + "u"]
    out = {r["doc_id"]: r for r in periodic.periodic_runs(documents(spark, texts)).collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert out[k]["n_words"] == len(w) and [tuple(r) for r in out[k]["runs"]] == plain_runs(w), t
    assert out[21]["collapsed"] == "y" and out[22]["runs"] == [] and out[23]["collapsed"] == "u v" and out[24]["runs"] == []
    assert periodic.digest(periodic.periodic_runs(documents(spark, texts).limit(0))).count() == 0


def test_op11_by_the_rule(spark):
    docs = table("documents")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs["doc_id"])
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        if len(text or "") < 3000:
            assert got[doc] == plain_op11(doc, text), doc
    odd = documents(spark, ODD * 12)
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.digest(periodic.periodic_runs(queries.with_periods(odd))).collect()}
    for k, t in enumerate(ODD * 12):
        if len(t or "") < 2000:
            assert got[k] == plain_op11(k, t), t


# --- encoding by distinct words ---------------------------------------------------------------------------------------


def check_words(got: dict, texts: dict) -> None:
    library = word_bpe._tokenizer(tokenizer_path(WORDS))
    assert len(got) == len(texts)
    for k, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids, t
        assert got[k]["decoded"] == library.decode(ids, skip_special_tokens=False), t


def test_encode_and_decode_odd_rows(spark):
    out = word_bpe.encode_decode(documents(spark, ODD), tokenizer_path(WORDS))
    check_words({r["doc_id"]: r for r in out.collect()}, dict(enumerate(ODD)))
    assert out.filter("doc_id = 0 AND octet_length(ids) = 0 AND decoded = ''").count() == 1
    assert word_bpe.encode_decode(documents(spark, ODD).limit(0), tokenizer_path(WORDS)).count() == 0


def test_each_distinct_word_is_encoded_once(spark):
    cut = blocks.write(documents(spark, ["a b a", "b c", "a"]).repartition(1), word_bpe._block, "keys array<string>, n_words array<bigint>, codes binary", "t")
    row = cut.collect()
    assert len(row) == 1 and sorted(row[0]["keys"]) == ["a", "b", "c"] and sum(row[0]["n_words"]) == 6


def test_rows_of_a_word_get_the_same_ids(spark):
    """Words that stand in many blocks, more rows than a batch holds, and words without ids."""
    words = ["", "\x00", "one", "Zwei,", "日本語", "q" * 300]
    rows = spark.createDataFrame([(b, k, w) for b in range(3000) for k, w in enumerate(words)], "block bigint, _at int, word string")
    library = word_bpe._tokenizer(tokenizer_path(WORDS))
    got = word_bpe.encode_words(rows, tokenizer_path(WORDS)).groupBy("_at", "ids").count().collect()
    assert {r["_at"]: (r["ids"], r["count"]) for r in got} == {k: (library.encode(w, add_special_tokens=False).ids, 3000) for k, w in enumerate(words)}
    assert len(got) == len(words)


def test_a_block_and_a_part_are_one_row(spark, monkeypatch):
    """Words and ids go compressed, by block and part, not as a row for each word."""
    monkeypatch.setattr(word_bpe, "BLOCK", 100)
    made = word_bpe._dealt([b"to be or not to be", b"", b"be"], 1)
    assert made["n_keys"].to_pylist() == [4] and [len(k) for k in made["keys"].to_pylist()] == [1]
    texts = [*ODD, *(" ".join(f"w{k * j % 97}" for j in range(60)) for k in range(40))]
    seen = []
    encode_parts = word_bpe.encode_parts
    monkeypatch.setattr(word_bpe, "encode_parts", lambda entries, *a: seen.append(entries) or encode_parts(entries, *a))
    out = {r["doc_id"]: r for r in word_bpe.encode_decode(documents(spark, texts), tokenizer_path(WORDS)).collect()}
    check_words(out, dict(enumerate(texts)))
    entries = seen[0].collect()
    assert len({r["block"] for r in entries}) > 5 and len({(r["block"], r["part"]) for r in entries}) == len(entries)


def test_decode_by_join(spark):
    rows = spark.createDataFrame([(1, [320, 49407, 320]), (2, []), (3, None), (4, [10**6, 320])], "k int, ids array<int>")
    library = word_bpe._tokenizer(tokenizer_path(WORDS))
    out = {r["k"]: r["decoded"] for r in word_bpe.decode(rows, ["k"], tokenizer_path(WORDS)).collect()}
    assert out == {1: library.decode([320, 49407, 320], skip_special_tokens=False), 2: "", 3: "", 4: library.decode([320])}


def test_op12_by_the_library(spark):
    docs = table("documents")
    library = word_bpe._tokenizer(tokenizer_path(WORDS))
    got = {r["doc_id"]: r for r in queries.op12_word_bpe(spark, SF).collect()}
    assert len(got) == len(docs["doc_id"])
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))


# --- alignment --------------------------------------------------------------------------------------------------------


def plain_alignment(texts: dict) -> dict:
    """Whole texts by both libraries, ends as sets, links one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    of_a, of_b = Tokenizer.from_file(tokenizer_path(A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    of_a.encode_special_tokens = True
    byte_of = token_align.packing._byte_of()
    groups: dict = {}
    for k, t in texts.items():
        groups[k] = []
        a, b = (of_a.encode(" " + t, add_special_tokens=False).ids, of_b.encode(t)) if t else ([], [])
        bytes_a = [bytes(byte_of[c] for c in of_a.id_to_token(i)) for i in a]
        names = [of_b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        if t and b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            begin = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                groups[k].append(([i for i, e in zip(a, ends_a, strict=True) if begin < e <= end], [i for i, e in zip(b, ends_b, strict=True) if begin < e <= end]))
                begin = end
    links = {k: [(x, y) for a, b in g for x in a for y in b] for k, g in groups.items()}
    count = Counter(p for v in links.values() for p in set(v))
    most: dict = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = {}
    for k, g in groups.items():
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        mine = links[k]
        out[k] = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(mine), sum(count[p] == most[p[0]] for p in mine), sum(count[p] for p in mine), listed)
    return out


def test_alignment_of_odd_rows(spark):
    out = {r["doc_id"]: tuple(r)[1:] for r in token_align.align(documents(spark, ODD), tokenizer_path(A), tokenizer_path(B)).collect()}
    want = plain_alignment(dict(enumerate(ODD)))
    for k, t in enumerate(ODD):
        assert out[k] == want[k], t
    assert out[0] == out[1] == out[9] == (0, 0, 0, 0, 0, 0, "")
    assert token_align.align(documents(spark, ODD).limit(0), tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_shared_cuts_of_many_intervals():
    rng = np.random.default_rng(6)
    for _ in range(200):
        ends_a, ends_b, begin, end, at = [], [], [], [], 0
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(1, 80))
            inner = [np.unique(rng.integers(1, n + 1, rng.integers(0, n + 1))) for _ in range(2)]
            begin.append(len(ends_a))
            ends_a += (at + np.union1d(inner[0], [n])).tolist()
            ends_b += (at + np.union1d(inner[1], [n])).tolist()
            end.append(len(ends_a))
            at += n
        got = token_align.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(begin), np.array(end))
        assert np.array(ends_a)[got].tolist() == sorted(set(ends_a) & set(ends_b))


@pytest.mark.parametrize("links", [1 << 21, 64])
def test_op13_by_the_libraries(spark, monkeypatch, links):
    monkeypatch.setattr(token_align, "LINKS", links)
    monkeypatch.setattr(token_align, "TOKENS", links)
    docs = table("documents")
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    if links == 64:  # long groups and parts of digests, in this process
        a, b = tokenizer_path(A), tokenizer_path(B)
        sources = [(t or "").encode() for t in texts.values()][:60] + [b"qwrtzpsdfghjkl" * 20, b""]
        block = token_align.Block(sources, a, b)
        doc, pair, n = block.links(16)
        want = plain_alignment({k: s.decode() for k, s in enumerate(sources)})
        assert np.bincount(doc, n, len(sources)).astype(int).tolist() == [want[k][3] for k in range(len(sources))]
        assert ["".join(block.listed(*token_align._all_names(a, b), k)) for k in range(len(sources))] == [want[k][6] for k in range(len(sources))]
        return
    want = plain_alignment(texts)
    got = {r["doc_id"]: r for r in queries.op13_token_alignment(spark, SF).collect()}
    assert len(got) == len(texts)
    for k, w in want.items():
        assert tuple(got[k][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) == w[:6]
        assert got[k]["groups_sha256"] == (sha(w[6]) if w[6] else "")


def test_a_block_aligns_each_segment_once():
    a, b = tokenizer_path(A), tokenizer_path(B)
    texts = ["The segments of this text, é and\nall."] * 50 + ["of this  text \n", " The text", "日本 text, this", "text \x1c of", "this ﬁ text, of", "", "   ", "text, "]
    block = token_align.Block([x.encode() for x in texts], a, b)
    want = plain_alignment(dict(enumerate(texts)))
    names = token_align._all_names(a, b)
    assert ["".join(block.listed(*names, k)) for k in range(len(texts))] == [w[6] for w in want.values()]
    assert [tuple(map(int, x)) for x in zip(block.n_a, block.n_b, block.n_groups, block.n_links, strict=True)] == [w[:4] for w in want.values()]
    doc, _, n = block.links(16)
    assert np.bincount(doc, n, len(texts)).astype(int).tolist() == [w[3] for w in want.values()]
    assert len(block.a) < want[0][0] + 60  # tokens that went through the alignment, not 50 times as many
