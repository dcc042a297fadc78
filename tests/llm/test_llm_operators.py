"""Each operator against a brute-force version on awkward rows, and on an empty table."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from notemill.llm import bpe, components, decontaminate, induced, langid, ngram_join, pii, quality_classifier, quality_rules, substring_dedup, token_table, warc
from notemill.llm.common import scratch
from notemill.llm.registry import BYTE_BPE, WORD_BPE, vocabulary_file

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 1 ----


def brute_links(texts):
    sets = []
    for _, t in texts:
        w = WORDS.findall(t or "")
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    n, parent = Counter(), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and texts[a][0] is not None and texts[b][0] is not None and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, None if k is None else least[find(i)], n[i]) for i, (k, _) in enumerate(texts))


@pytest.mark.parametrize("block", [100, 7])
def test_ngram_join_finds_every_link(docs, awkward, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect())
    assert got == brute_links(awkward)


def test_ngram_join_on_nothing(nothing):
    assert ngram_join.ngram_join(nothing).count() == 0


def test_keep_one_leaves_the_smallest_of_each_class(docs):
    kept = ngram_join.keep_one(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {3, 100, 200} & ids == {3, 100} and not {4, 5, 201} & ids and {0, 1, 2, None} <= ids


def test_bands_reach_the_target():
    b, r = ngram_join.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**r) ** b >= 0.9995 and b * r <= 128


# ---- 2 and 8 ----


def test_bpe_equals_the_library(docs, awkward):
    from tokenizers import Tokenizer

    path = vocabulary_file(WORD_BPE)
    library = Tokenizer.from_file(path)
    want = Counter()
    for k, t in awkward:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[k, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)] += 1
    out = bpe.bpe_encode(docs, path, decoded=True)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in out.collect()) == want
    again = Counter((r.doc_id, r.decoded) for r in bpe.bpe_decode(out.select("doc_id", "ids"), path).collect())
    assert again == Counter((r.doc_id, r.decoded) for r in out.select("doc_id", "decoded").collect())


def test_bpe_on_random_text_and_small_memory(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from notemill.llm.common import steps

    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    r = random.Random(1)
    texts = ["".join(r.choice("abcdest aeiourl'svtm 12.,!?éßñſΣ\n–x") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    library, own = Tokenizer.from_file(vocabulary_file(WORD_BPE)), bpe.WordBpe(vocabulary_file(WORD_BPE))
    got = []
    for _, view in steps(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), "t", 500):
        ids, at = own.encode(view)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(len(view))]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_empty_tables_have_empty_results(spark, nothing):
    assert bpe.bpe_encode(nothing, vocabulary_file(WORD_BPE), decoded=True).count() == 0
    manifest = token_table.write_token_table(nothing, vocabulary_file(BYTE_BPE), scratch(spark, "t"))
    assert token_table.read_token_table(manifest).count() == 0
    assert substring_dedup.dedup_substrings(nothing).count() == 0
    assert pii.find_pii(nothing).count() == 0
    benchmark = spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string")
    assert decontaminate.find_contamination(nothing, benchmark).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(nothing, labels).count() == 0 and quality_classifier.classify(nothing, labels).count() == 0
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages, scratch(spark, "w"))).count() == 0
    links = spark.createDataFrame([], "a long, b long")
    assert components.components(links).count() == 0


def test_token_table_round_trip(spark, docs, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_file(BYTE_BPE))
    manifest = token_table.write_token_table(docs, vocabulary_file(BYTE_BPE), scratch(spark, "tokens"), n_shards=3)
    got = token_table.read_token_table(manifest).collect()
    start, want = 0, []
    for k, t in sorted(awkward, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=lambda x: x[1]) == want
    assert token_table.read_document(manifest, 4) == [library.encode("hi there").ids + [0]] * 2
    assert token_table.read_document(manifest, 250) == []


# ---- 3 ----

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 15 < len(d) < 20 and luhn(d), "phone": 7 < len(d) < 16}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans(spark, docs, awkward):
    r = random.Random(2)
    texts = [t for _, t in awkward] + ["".join(r.choice("0123456789  --..@@++()ab_%é") for _ in range(r.randint(0, 80))) for _ in range(500)] + ["x.y@z.q_d@e.f@g.h", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a" * 30_000 + "@b.c", "1.1." * 2_000, "a@b" + ".c" * 4_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.b for x in pii.find_pii(df).select("doc_id", pii.joined(pii.BASE_KINDS).alias("b")).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_pii(t) for t in texts]


def test_pii_checks_context_and_redaction(spark):
    t = "iban GB82 WEST 1234 5698 7654 32 or GB83 WEST 1234 5698 7654 32. password=135299847ac0e0f0dc and a long way from it 135299847ac0e0f0dc card 4222222222222 and a long way from it 4222222222222 me@example.org"
    found = pii.find_pii(spark.createDataFrame([(1, t, "clash")], "doc_id long, text string, pii_iban string"))
    assert pii.redact(found).first().text == "iban <iban> or GB83 WEST 1234 5698 7654 32. password=<secret> and a long way from it 135299847ac0e0f0dc card <account> and a long way from it 4222222222222 <email>"


# ---- 4 ----


def test_language_by_compression(spark):
    r = random.Random(3)
    syllables = {"xx": ["ka", "lo", "mi", "ra"], "yy": ["stu", "ber", "ich", "ung"], "zz": ["eau", "oux", "ier", "tion"]}
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join(word(syllables[lang]) for _ in range(r.randint(20, 120))), lang) for i in range(300) for lang in [r.choice(list(syllables))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))))
    more = spark.createDataFrame([(1000, None, "xx", "old"), (1001, "123 ²½ !", None, "old"), (1002, "", "yy", "old")], "doc_id long, text string, lang string, lang_pred string")
    out = langid.identify(df.withColumn("lang_pred", F.lit("old")).unionByName(more), model).collect()
    held = [x for x in out if x.doc_id < 1000 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and sum(x.lang == x.lang_pred for x in held) >= 0.98 * len(held)
    assert {(x.lang_pred, x.lang_score, x.lang_rejected) for x in out if x.doc_id >= 1000} == {("und", 0.0, True)}
    assert all(0 <= x.lang_score <= 1 for x in out)


# ---- 5 ----


def test_quality_counts(docs, awkward):
    def brute(t):
        w = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.figures(docs).collect())
    assert got == Counter((k, *brute(t)) for k, t in awkward)


def test_cutoffs_hold_their_risk(spark):
    from math import comb

    rows = spark.createDataFrame([(0, 200), (3, 5000), (9, 900)], "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        exact = 1.0 if r.k >= r.n * 0.01 else sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - exact) < 1e-6 * max(exact, 1e-3)
    good = spark.range(4000).select(F.lit("a").alias("stratum"), (F.col("id") / 4000).alias("x"))
    found = quality_rules.cutoffs(good, {"x": [0.9, 0.99, 0.999]}, alpha=0.02, delta=0.05).collect()
    assert [(r.cutoff, r.n) for r in found] == [(0.99, 4000)]  # 0.9 rejects too many; 0.99 surely few enough
    assert not quality_rules.cutoffs(good.limit(20), {"x": [0.9, 0.99, 0.999]}, alpha=0.02).collect()  # too few labels show nothing


# ---- 6 ----


def test_contamination_against_all_windows(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randint(14, 40)))) for i in range(20)] + [(20, "Two words"), (21, None), (22, "")]
    texts = [None, "", "two WORDS!"]
    for i in range(60):
        body, item = [word() for _ in range(r.randint(0, 80))], items[i % 20][1].split()
        if i % 4 == 1:
            item[0] = "changed"
        if i % 4 == 2:
            item[len(item) // 2] = "changed"
        at = r.randint(0, len(body))
        texts.append(" ".join(body[:at] + item + body[at:]).upper() if i % 4 != 3 else " ".join(body))
    clean = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def weights(w):
        n = min(5, len(w))
        return {g: len(g.replace(" ", "")) * c for g, c in Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)).items()}

    want = {}
    for d, t in enumerate(texts):
        w = clean(t)
        for i, item in items:
            x = clean(item)
            for s in range(max(1, len(w) - len(x) + 1)) if x and w else ():
                a, b = weights(w[s : s + len(x)]), weights(x)
                both = sum(min(v, b.get(g, 0)) for g, v in a.items())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), sim)
    df = spark.createDataFrame([(d, t, "x") for d, t in enumerate(texts)], "doc_id long, text string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_contamination(df, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {x.doc_id for x in decontaminate.decontaminate(df, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


# ---- 7 ----


@pytest.mark.parametrize(("hot", "piece", "block"), [(5000, 8 << 20, 1 << 16), (2, 3000, 100)])
def test_substrings_against_all_strings(docs, awkward, monkeypatch, hot, piece, block):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", piece)
    first = {}
    for k, t in sorted((x for x in awkward if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    want = Counter()
    for k, t in awkward:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if k is not None else ():
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        want[k, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.dedup_substrings(docs).collect()) == want


def test_induced_order_and_prefixes(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    for held in (256 << 20, 200):
        monkeypatch.setattr(induced, "HELD_BYTES", held)
        for _ in range(40):
            depth = int(r.integers(3, 20))
            t = np.append(r.integers(1, r.integers(3, 7), r.integers(2, 150)), 0).astype(np.uint16)
            order, lcp = induced.suffix_order(t, depth)
            heads = [tuple(t[i : i + depth]) for i in order]
            assert sorted(heads) == heads and sorted([*order, len(t) - 1]) == list(range(len(t)))
            for a, b, n in zip(heads, heads[1:], lcp[1:], strict=False):
                assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# ---- 9 ----


def test_warc_round_trip(spark):
    long = "<html>" + "x" * 200
    rows = [(i, "http://a.example/p\r\nX: y", t) for i, t in enumerate([None, "", "short", "short", long, long, long, "é" * 60, "other" * 50_000])] + [(9, None, long), (9, None, "é" * 60)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_digest string")
    folder = scratch(spark, "warc")
    manifest = warc.write_warc(pages, folder)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(manifest).collect())
    least = defaultdict(lambda: 10**9)
    for i, _, t in rows:
        least[t or ""] = min(least[t or ""], i)
    want = Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        again = len(raw) >= 100 and least[t or ""] != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least[t or ""] if again else None] += 1
    assert got == want
    found = [x for r in manifest.collect() if (x := warc.Bundle(r.path).find(8))]
    assert len(found) == 1 and found[0][1] == b"other" * 50_000


# ---- 10 ----


def test_quality_classifier_shrinks_sparse_sites(spark):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "###"]) for _ in range(60))
    rows = [(i, bad() if i % 7 == 0 or i % 10 == 9 else good(), f"host{i % 10}", "p") for i in range(600)] + [(700, None, None, None), (701, "", "rare", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(not (i % 7 == 0 or i % 10 == 9)), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality_classifier.classify(df, labels).collect()}
    assert len(out) == len(rows)
    odd = [i for i in range(600) if i % 2]
    assert sum(out[i].kept == (not (i % 7 == 0 or i % 10 == 9)) for i in odd) > 0.97 * len(odd)
    assert out[9].host_quality < out[1].host_quality and 0.2 < out[701].host_quality < 0.95
    host, path = quality_classifier.site_of_url(F.lit("https://m.example.org/en/1?x"))
    assert spark.range(1).select(host, path).first()[:] == ("m.example.org", "m.example.org/en")


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)] + [(200, x) for x in range(201, 230)], "a long, b long")
    labels = {r.v: r.label for r in components.components(links).collect()}
    assert {labels[i] for i in range(41)} == {0} and {labels[i] for i in (100, 101, 102)} == {100} and {labels[i] for i in range(200, 230)} == {200}


def test_many_matches_in_one_text(spark):
    """More matches than a fold could gather one by one, with some that stand and are cut out."""
    t = "12 ab " * 50_000 + "write to a@b.co or 1.2.3.4 " * 600
    found = pii.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string"))
    row = found.select(pii.joined(pii.BASE_KINDS).alias("b")).first()
    assert row.b == brute_pii(t)
    assert pii.redact(found).first().text == "12 ab " * 50_000 + "write to <email> or <ip> " * 600


# ---- 4 and 5 against plain versions ----


def test_language_choice_against_plain_compression(spark, docs, awkward):
    import zstandard

    r = random.Random(9)
    syllables = {f"l{i:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for i in range(130)}  # more than any cap
    said = lambda x, n: " ".join("".join(r.choice(syllables[x]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i * 130 + j, said(x, 60 if i else 4000), x) for i in range(3) for j, x in enumerate(syllables)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert {x for x, _ in model.dictionaries} == set(syllables)
    whole = 0
    for x, raw in model.dictionaries:
        first = next(t for _, t, y in rows if y == x)
        assert len(raw) <= langid.DICT_BYTES + langid.BINS
        if len(raw) > 9000:  # the long text was drawn: its end is in, as its start is
            assert any(first[-300:][k : k + 40].encode() in raw for k in range(0, 260, 20)) and first[:100].encode() in raw
            whole += 1
    assert whole > 60
    asked = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(awkward)] + [(1000 + j, said(x, n)) for j, x in enumerate(list(syllables)[:6]) for n in (1, 30)], "doc_id long, text string")

    def plain(t):
        if t is None or not any(c.isalpha() for c in t):
            return "und", True
        raw = t.lower().encode()
        sizes = []
        for _, known in model.dictionaries:
            how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.PIECE_BYTES, dict_size=len(known), write_content_size=False, write_dict_id=False, write_checksum=False)
            d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(raw[i : i + langid.PIECE_BYTES])) for i in range(0, len(raw), langid.PIECE_BYTES)))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        return model.dictionaries[best][0], sorted(sizes)[1] / sizes[best] - 1 < langid.MARGIN

    small = asked.where("length(text) < 2000 OR text IS NULL")
    got = {(r.doc_id, r.text): (r.lang_pred, r.lang_rejected) for r in langid.identify(small, model).collect()}
    assert got == {k: plain(k[1]) for k in got}
    assert all(x == got[k][0] for j, x in enumerate(list(syllables)[:6]) for k in got if k[0] == 1000 + j and len(k[1]) > 60)


def test_quality_verdict_against_plain_rules(spark):
    """Cutoffs and verdicts of 60 strata from counted labels, by exact sums."""
    from math import comb

    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefg") for _ in range(n))
    rows = []
    for i in range(6000):
        lang = None if i % 60 == 7 else f"x{i % 61}" if i % 5 == 0 else "big"
        bad = i % 9 == 0
        text = " ".join(word(14 if bad and i % 2 else r.randint(2, 6)) + ("##" if bad and i % 4 == 0 else "") for _ in range(r.randint(15, 40)))
        rows.append((i, text, lang, int(not bad)))
    rows += [(7000 + i, rows[1][1], "big", 1) for i in range(400)]  # copies of one text count once
    docs_ = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(i, q) for i, _, _, q in rows[:500]], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_rules.judge(docs_, labels).collect()}
    strata, seen = {}, set()
    for i, t, lang, q in rows:
        if q and not got[i].base_failed and (lang, t) not in seen:
            seen.add((lang, t))
            strata.setdefault(lang, []).append(got[i])
    p, enough = quality_rules.ALPHA, lambda m: math.log(quality_rules.DELTA / m) / math.log(1 - quality_rules.ALPHA)
    tested = sum(len(xs) >= enough(1) for xs in strata.values())
    limits = {}
    for lang, xs in strata.items():
        n = len(xs)
        for stage in range(7) if n >= enough(tested) else ():
            now = {rule: cs[max(0, len(cs) - 1 - stage)] for rule, cs in quality_rules.RULES.items()}
            k = sum(any(x[rule] > c for rule, c in now.items()) for x in xs)
            tail = 1.0 if k >= n * p else sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            if tail > quality_rules.DELTA / tested:
                break
            limits |= {(lang, rule): c for rule, c in now.items()}
    assert {x for x, _ in limits} == {"big"} and len(strata) > 50
    assert {i: x.kept for i, x in got.items()} == {i: not x.base_failed and not any(x[rule] > limits.get((lang, rule), 1e9) for rule in quality_rules.RULES) for i, _, lang, _ in rows for x in [got[i]]}
    assert not got[18].kept or not got[9].kept


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_quality_verdict_rejects_bad_texts_and_few_good_ones(spark):
    """On the given tables: cutoffs from half of the labels reject most bad texts and 2 % of the other half's good ones at most."""
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    judged = quality_rules.judge(docs_, labels.where(half)).where("NOT base_failed").join(labels.where(~half), "doc_id")
    rates = {(r.lang, r.quality): (r.n, r.rejected / r.n) for r in judged.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("rejected")).collect()}
    assert all(rate <= quality_rules.ALPHA for (_, quality), (_, rate) in rates.items() if quality == 1)
    assert rates["en", 0][1] > 0.5 and sum(n * rate for (_, q), (n, rate) in rates.items() if q == 0) > 0.5 * sum(n for (_, q), (n, _) in rates.items() if q == 0)


def test_quality_classifier_against_plain_sums(spark, awkward):
    """Evidence, priors, strengths and posteriors by plain loops."""
    import math
    import unicodedata

    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgHI#.!9") for _ in range(r.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 150))), r.choice(["a", "b", None, "rare" if i < 3 else "a"]), r.choice(["p", "q"])) for i in range(300)]
    rows += [(1000 + n, t, "awk", None) for n, (_, t) in enumerate(awkward)]
    labels = [(i, r.randint(0, 1)) for i in range(0, 200)] + [(5, 1), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {x.doc_id: x for x in quality_classifier.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def bins(t):
        t = t or ""
        w, lines, n = WORDS.findall(t), t.split("\n"), max(len(t), 1)
        share = lambda chars: sum(c in chars for c in t) / n
        values = [len(w), sum(map(len, w)) / max(len(w), 1), share("#*$%&|<>"), sum(unicodedata.category(c) == "Lu" for c in t) / n, share("0123456789"), share(".,;:!?"), len(set(w)) / max(len(w), 1), len(set(lines)) / len(lines)]
        return [sum(v >= e for e in edges) for v, edges in zip(values, quality_classifier.EDGES.values(), strict=True)]

    held = {i: bins(t) for i, t, _, _ in rows}
    known = [(held[i], q) for i, q in labels if q is not None]
    good, bad = sum(q == 1 for _, q in known), sum(q != 1 for _, q in known)
    evidence = {}
    for i, b in held.items():
        e = math.log(good / bad)
        for f, edges in enumerate(quality_classifier.EDGES.values()):
            g, m = (sum(x[f] == b[f] and (q == 1) == side for x, q in known) for side in (True, False))
            e += quality_classifier.TEMPER * (math.log((g + 1) / (good + len(edges) + 1)) - math.log((m + 1) / (bad + len(edges) + 1)))
        evidence[i] = e
    c = {i: 1 / (1 + math.exp(-e)) for i, e in evidence.items()}
    prior = sum(c.values()) / len(c)

    def strength(sites):
        """Of (number, mean, prior) per site."""
        noise = sum(p * (1 - p) for _, _, p in sites)
        total = sum(n for n, _, _ in sites)
        between = (sum(n * (m - p) ** 2 for n, m, p in sites) - noise) / max(total - sum(n * n for n, _, _ in sites) / total, 1.0)
        return min(max(noise / len(sites) / max(between, 1e-9) - 1, quality_classifier.STRENGTH[0]), quality_classifier.STRENGTH[1])

    hosts, paths = {}, {}
    for i, _, h, p in rows:
        hosts.setdefault(h, []).append(c[i])
        paths.setdefault((h, p), []).append(c[i])
    m = strength([(len(x), sum(x) / len(x), prior) for x in hosts.values()])
    host = {h: (sum(x) + m * prior) / (len(x) + m) for h, x in hosts.items()}
    mp = strength([(len(x), sum(x) / len(x), host[h]) for (h, _), x in paths.items()])
    odds = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    for i, _, h, p in rows:
        alone = (sum(hosts[h]) - c[i] + m * prior) / (len(hosts[h]) - 1 + m)
        there = (sum(paths[h, p]) - c[i] + mp * alone) / (len(paths[h, p]) - 1 + mp)
        quality = 1 / (1 + math.exp(-(evidence[i] + odds(there) - odds(prior))))
        x = got[i]
        assert abs(x.evidence - evidence[i]) < 1e-9 and abs(x.host_quality - host[h]) < 1e-9 and abs(x.path_quality - there) < 1e-9 and abs(x.quality - quality) < 1e-9
        assert x.kept == (quality >= quality_classifier.KEEP) or abs(quality - quality_classifier.KEEP) < 1e-9


def test_short_items_and_repeated_keys_in_contamination(spark):
    """Items of fewer words than a shingle, and rows that share a key but not their text."""
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two three four five six seven eight")], "item_id long, text string")
    docs_ = spark.createDataFrame([(1, "long before alpha beta gamma and long after it too"), (2, "nothing of it in here at all today"), (3, "x y z one two three four five six seven eight w"), (3, "some other text entirely without any of that, only longer than the first by some words"), (4, "alpha beta gamma"), (None, "u one two three four five six seven eight")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.find_contamination(docs_, bench).collect()}
    assert got == {(1, 1): 1.0, (3, 2): 1.0, (4, 1): 1.0, (None, 2): 1.0}


def test_pairs_at_the_similarity_itself():
    import numpy as np

    for scale in (1, 27, 216, 5000):  # shared n-grams and all of them, 8 to 10
        a, b = np.arange(9 * scale, dtype=np.uint64), np.arange(scale, 10 * scale, dtype=np.uint64)
        for sets, links in (([a, b], [1, 1]), ([a, b[1:]], [0, 0])):
            v, one = np.array([1, 2]), np.ones(2, np.int64)
            assert ngram_join.verify(0, np.zeros(2, int), v, one, np.zeros((2, 1), np.int64), sets, 0.8)[0].tolist() == links
    a, b = np.arange(244, dtype=np.uint64), np.arange(28, 270, dtype=np.uint64)
    assert ngram_join.verify(0, np.zeros(2, int), np.array([1, 2]), np.ones(2, np.int64), np.zeros((2, 1), np.int64), [a, b], 0.8)[0].tolist() == [1, 1]
