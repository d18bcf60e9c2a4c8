"""The operators against brute force on a small table with nulls, empty texts, repeats, ties and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import string
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import public_tokenizers
from wfspark.llm import bpe, dealing, html_extract, jaccard_join, sql, toxicity
from wfspark.llm.bwt import merge, ranks, transform
from wfspark.llm.decontamination import decontamination
from wfspark.llm.html_blocks import blocks
from wfspark.llm.language_id import language_id, train
from wfspark.llm.license_scan import license_scan
from wfspark.llm.quality_rules import quality_rules
from wfspark.llm.substring_dedup import substring_dedup
from wfspark.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, found string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(60)]
    passage = " ".join(r.choices(vocabulary, k=45))
    out = [None, "", " \n\t ", "a", "One Two", "x" * 400]
    for k in range(40):
        base = " ".join(r.choices(vocabulary, k=r.randint(5, 80)))
        out.append(base if k % 3 else f"{base}\n{passage}\n{base[:50]}")
        if k % 4 == 0:
            out += [base, base.replace(" ", "  ", 1), base.upper(), " ".join(base.split()[:-1] + ["zz"])]
    out += ["under the MIT license under the mit license", "Licensed under CC BY-NC 4.0.", "ab" * 150, passage, passage + " tail"]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else "fr", "s", len(t or ""), -1, 0.5, "clash") for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck(texts):
    con = duckdb.connect()
    frame = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})
    con.register("f", frame)
    con.execute("CREATE TABLE documents AS SELECT doc_id, text FROM f")
    return con


def equal(df, want):
    got = df.toPandas()
    names = sorted(want.columns)
    a = got[names].sort_values("doc_id").reset_index(drop=True).astype(object)
    b = want[names].sort_values("doc_id").reset_index(drop=True).astype(object)
    pd.testing.assert_frame_equal(a.where(a.notna(), None), b.where(b.notna(), None), check_dtype=False)


def test_quality_rules_equal_sql(docs, duck):
    equal(quality_rules(docs), duck.execute(sql.quality_rules()).df())


@pytest.mark.parametrize("level", [10, 3])
def test_substring_dedup_equals_sql(docs, duck, monkeypatch, level):
    monkeypatch.setattr(dealing, "LEVEL", level)  # 3: buckets in three steps
    equal(substring_dedup(docs, digest=True), duck.execute(sql.substring_dedup()).df())


def test_substring_dedup_cuts_text(docs, texts):
    for r in substring_dedup(docs).collect():
        left = words(r["text"])
        assert len(left) == r["n_words"] - r["n_removed"]
        if not r["n_removed"]:
            assert r["text"] == (texts[r["doc_id"]] or "")


def test_license_scan_equals_sql(docs, duck):
    equal(license_scan(docs), duck.execute(sql.license_scan()).df())


def test_license_spans_are_verified_by_their_words(spark):
    long = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    w = long.split()
    texts_ = {
        1: f"x {long} y",
        2: " ".join([*w[:9], "put", "in", *w[9:]]),  # words put in: two diagonals
        3: " ".join([*w[:6], *w[4:]]),  # words said twice count once
        4: " ".join([*w[:5]] * 8),  # one part over and over
        5: " ".join(w[::-1]),
        6: "Under THE mit-license, under the MIT license!",
        7: " ".join("a" * 30 for _ in range(3000)) + " " + long,
    }
    docs_ = spark.createDataFrame([(k, t, "clash", "clash") for k, t in [*texts_.items(), (8, None), (1, texts_[1])]], "doc_id long, text string, label string, template string")
    got = {r["doc_id"]: r for r in license_scan(docs_).collect()}
    assert [got[k]["labels"] for k in range(1, 9)] == ["mit", "mit", "mit", "", "", "mit", "mit", ""] and got[3]["score"] == got[1]["score"] == got[7]["score"] == 1.0
    assert got[4]["score"] < 0.5 and (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (2, 0, 4) and got[8]["n_words"] == 0
    own = spark.createDataFrame([(7, "Words of a license of our own", "own", False), (8, "too short", "none", True)], "template int, phrase string, label string, is_base boolean")
    found = license_scan(spark.createDataFrame([(1, "see words of a license of our own here")], "doc_id long, text string"), own).first()
    assert (found["labels"], found["base_labels"], found["score"]) == ("own", "", 1.0)


def test_suffix_dedup_of_rows_with_one_id(spark):
    r = random.Random(4)
    a, b = ("".join(r.choices("abcdef ", k=300)) for _ in range(2))
    rows = [(1, a), (1, b), (2, b), (2, b), (3, a), (4, None), (4, None), (None, a), (None, None)]
    got = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"]) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first, other = (300, 300) if min(a, b) == b else (0, 0), (0, 0) if min(a, b) == b else (300, 300)
    assert got == sorted([(1, 300, 0)] * 2 + [(2, 300, first[0])] * 2 + [(3, 300, other[0]), (4, 0, 0), (4, 0, 0), (0, 300, 0), (0, 0, 0)])


@pytest.mark.parametrize("level", [10, 3])
def test_suffix_dedup_equals_brute_force(docs, texts, monkeypatch, level):
    monkeypatch.setattr(dealing, "LEVEL", level)
    seen, want = set(), {}
    for k, t in sorted(texts.items()):
        b = (t or "").encode()
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                change[i] += 1
                change[i + 100] -= 1
            seen.add(b[i : i + 100])
        gone = np.cumsum(change[:-1]) > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[k] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs, digest=True).collect()}
    assert got == want and any(v[1] for v in want.values())
    for r in suffix_dedup(docs).where("n_removed > 0").collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def jaccard_groups(rows, n=3, percent=90):
    """Set size and group of each row by comparing all pairs; rows: doc_id and text."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    group, changed = list(range(len(rows))), True
    pairs = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            pairs.append((a, b))
    while changed:
        changed = False
        for a, b in pairs:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    least = {}
    for g, (k, _) in zip(group, rows):
        least[g] = min(k, least.get(g, k))
    return sorted((k, len(s), least[g]) for (k, _), s, g in zip(rows, sets, group))


@pytest.mark.parametrize("block", [512, 2, 8])
def test_jaccard_join_equals_brute_force(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(dealing, "LEVEL", 10 if block == 512 else 5)
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    near = []
    for k in range(45):  # near copies of one text, some of them further from it than from each other
        w = base[:]
        for _ in range(r.choice([1, 2, 3, 8])):
            w[r.randrange(200)] = f"n{r.randrange(30)}"
        near.append((500 + k, " ".join(w)))
    near += [(600 + k, " ".join(base[:k])) for k in range(150, 200, 3)]
    rows = [*texts.items(), *near, *near[:3], (None, None)]
    if block == 8:  # rows of one id with different texts
        rows += [(3, near[0][1]), (500, "quite another text of the same id"), (501, "quite another text of the same id"), (502, near[3][1])]
    table = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, name_a string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(table).where("doc_id is not null").collect())
    assert got == jaccard_groups([x for x in rows if x[0] is not None])


def test_bpe_equals_tiktoken(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in bpe.bpe_encode(docs, path).collect():
        t = texts[r["doc_id"]] or ""
        assert list(r["ids"]) == codec.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()


def test_bpe_pieces_of_odd_texts():
    codec = bpe._codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})
    r = random.Random(1)
    parts = ["'", "'s", "'re", "a", "Z", " ", "  ", "\n", "\t", "　", "1", "é", "中", "😀", "!", "''", "\x1c", "\x85"]
    odd = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)]
    import pyarrow as pa

    ids, first = codec.encode(bpe.texts(pa.array(odd)))
    assert all(ids[first[k] : first[k + 1]].tolist() == want.encode_ordinary(t) for k, t in enumerate(odd))


def test_prefix_encoder_edits():
    v = bpe._codec(public_tokenizers.path("byte_bpe_50k.tiktoken")).vocabulary
    text = b"the quick brown fox jumps over the lazy dog " * 8
    e = bpe.PrefixEncoder(v, text)
    done = e.replace(10, 15, b"red")
    assert e.ids() == bpe.PrefixEncoder(v, text[:10] + b"red" + text[15:]).ids() and done < len(text) - 15
    e.append(b" end")
    assert e.ids() == bpe.PrefixEncoder(v, text[:10] + b"red" + text[15:] + b" end").ids()


def every_window(texts, items, least=0.8):
    """Best similarity of each document and item over windows at every start, in plain Python."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    weight = lambda s: sum(len(w) for g in s for w in g)
    want = {}
    for i, item in items:
        v = split.findall((item or "").translate(LOW))
        n = min(5, len(v))
        b = [tuple(v[k : k + n]) for k in range(len(v) - n + 1)] if v else []
        for k, t in texts:
            w = split.findall((t or "").translate(LOW))
            s = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)] if v else []
            m = min(len(b), len(s))
            for at in range(len(s) - m + 1 if m else 0):
                x, y = set(s[at : at + m]), set(b)
                if x & y and (like := weight(x & y) / weight(x | y)) >= least:
                    want[k, i] = max(like, want.get((k, i), 0))
    return want


def test_decontamination_equals_brute_force(spark, docs, texts):
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(300)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([6, 15, 25, 40, 60])))) for k in range(30)]
    items += [(40, " ".join(words(texts[8])[:25])), (41, texts[max(texts) - 1]), (42, "no such words here at all"), (43, None), (44, ""), (45, "one"), (46, "One two"), (47, "zz one two zz"), (48, "a b")]
    items += [(40, "another text of the same item id here"), (41, texts[max(texts) - 1])]
    leaks = []
    for k in range(150):
        w = items[r.randrange(30)][1].split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            at, what = r.randrange(len(w)), r.randrange(3)
            w[at : at + (what > 0)] = [r.choice(vocabulary)] if what < 2 else []
        w = w[r.choice([0, 0, 1, 3]) : len(w) - r.choice([0, 0, 2])]
        leaks.append((1000 + k, " ".join(r.choices(vocabulary, k=r.randint(0, 30)) + w + r.choices(vocabulary, k=r.randint(0, 30)))))
    leaks += [(2000, "zz one zz"), (2001, "zz, one two zz? yes"), (2002, "one"), (2003, "a"), (2003, "a b and more of it"), (2004, "x " * 300 + " ".join(["one two"] * 50)), (2002, "one")]
    table = spark.createDataFrame(leaks, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = every_window([*texts.items(), *leaks], items)
    got = {(x["doc_id"], x["item_id"]): x for x in decontamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len([v for v in want.values() if v < 0.9]) > 10 and got.keys() == want.keys()
    # a start further aside may be a little better: its words outside the passage weigh less
    assert all(0 <= v - got[k]["similarity"] + 1e-9 < 0.01 for k, v in want.items())
    assert got[2000, 45]["n_words"] == 1 and got[2000, 45]["start_word"] == 1 and (2003, 48) in got and (2001, 46) in got


def far_aside():
    """An item whose ends are light, and a text around whose middle only windows far off the diagonal of what the two share are similar enough."""
    r = random.Random(19)
    word = lambda least, most: "".join(r.choices("abcdefghij", k=r.randint(least, most)))
    heart = [word(7, 9) for _ in range(40)]
    item = " ".join([word(1, 1) for _ in range(10)] + heart)
    return item, " ".join([word(20, 20) for _ in range(15)] + heart + [word(1, 1) for _ in range(15)])


@pytest.mark.parametrize("segment", [16, 4096])
def test_decontamination_looks_at_every_window(spark, monkeypatch, segment):
    monkeypatch.setattr("wfspark.llm.decontamination.SEGMENT", segment)
    r = random.Random(23)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.choice([1, 1, 2, 8, 16]))) for _ in range(400)]
    item, aside = far_aside()
    items = [(0, item)] + [(k, " ".join(r.choices(vocabulary, k=24 + k))) for k in range(1, 25)]
    items += [(30, " ".join(["tra la"] * 12)), (31, " ".join(["same"] * 9 + ["end"])), (32, items[3][1] + " " + vocabulary[0])]
    rows = [(0, aside), (1, None), (2, ""), (3, " ".join(["tra la"] * 200)), (4, " ".join(["same"] * 60)), (5, item), (6, item[30:]), (6, aside)]
    for k in range(120):
        w = items[r.randrange(1, 25)][1].split()
        at = r.randrange(len(w))
        w[at : at + r.choice([0, 1, 2])] = r.choices(vocabulary, k=r.choice([0, 1, 2, 9]))
        a, b = r.choice([(0, 0), (4, 0), (0, 5), (3, 3)])
        rows.append((100 + k, " ".join(r.choices(vocabulary, k=r.randint(0, 40)) + w[a : len(w) - b] + r.choices(vocabulary, k=r.randint(0, 40)))))
    want = every_window(rows, items)
    found = decontamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in found}
    assert len(found) == len(got) and got.keys() == want.keys() and (0, 0) in got and (6, 0) in got
    # the windows of item 32, a word longer than item 3, are compared with item 3 too
    assert all(abs(v - got[k]) < 1e-9 or (k[1] in (3, 32) and v < got[k]) for k, v in want.items())


def naive_bayes(labelled, asked, buckets=1 << 15, smoothing=0.5):
    """Language and posterior of each text by counts in dictionaries; labelled: text and language."""

    def grams(text):
        chars = [ord(c.lower()) if len(c.lower()) == 1 and c.isalpha() else ord(c) if c.isalpha() else 0x20 for c in text or ""]
        kept = [c for k, c in enumerate(chars) if c != 0x20 or k == 0 or chars[k - 1] != 0x20]
        for n in (1, 2, 3):
            for i in range(len(kept) - n + 1):
                h = n
                for c, factor in zip(kept[i : i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                    h = ((h ^ c) * factor) & 0xFFFFFFFF
                    h ^= h >> 15
                if n > 1 or kept[i] != 0x20:
                    yield h % buckets

    counts, rows = {}, Counter()
    for text, lang in labelled:
        if text is not None and lang is not None:
            rows[lang] += 1
            counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in asked:
        if not counts or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        total = {}
        for lang in sorted(counts):
            every = sum(counts[lang].values()) + smoothing * buckets
            total[lang] = math.log(rows[lang] / sum(rows.values())) + sum(math.log((counts[lang][g] + smoothing) / every) for g in grams(text))
        best = max(total, key=lambda x: total[x])
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


def test_language_id(spark, docs, empty, texts):
    r = random.Random(2)
    say = lambda letters: " ".join("".join(r.choices(letters, k=5)) for _ in range(40))
    rows = [(k, say("abcdef" if k % 2 else "uvwxyzé"), "aa" if k % 2 else "zz") for k in range(60)] + [(90, None, "aa"), (91, "", None), (92, "12 34 !", "zz"), (93, "abxy", None), (94, "a", None), (95, "Ünder  STRAßE 中文", None), (95, "abc", None)]
    table = spark.createDataFrame([(*x, "clash", 0.0) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = train(table.where("doc_id < 40"))
    got = sorted((x["doc_id"], x["lang_pred"], round(x["score"], 6)) for x in language_id(table, model).collect())
    want = naive_bayes([x[1:] for x in rows if x[0] < 40], [x[1] for x in rows])
    assert got == sorted((k, lang, round(p, 6)) for (k, _, _), (lang, p) in zip(rows, want))
    model = train(docs)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id(docs, model).collect()}
    for (k, t), (lang, p) in zip(texts.items(), naive_bayes([(t, "en" if k % 2 else "fr") for k, t in texts.items()], texts.values())):
        assert got[k][0] == lang and abs(got[k][1] - p) < 1e-6
    assert {x["lang_pred"] for x in language_id(docs, train(docs.where("false"))).collect()} == {"und"}
    assert language_id(empty, model).count() == 0 and train(empty).languages == []
    with pytest.raises(ValueError):
        train(docs.withColumn("lang", F.col("doc_id").cast("string")), most_languages=20)


def test_toxicity_finds_held_out_words(spark):
    r = random.Random(3)
    plain = ["".join(r.choices("abdeghilmnorst", k=r.randint(2, 7))) for _ in range(400)]
    bad = ["gruzzle", "vokkit", "plixxer", "wombaq"]
    rows = []
    for k in range(400):
        w = r.choices(plain, k=60)
        if k % 4 == 0:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(bad)
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    rows += [(1000, None, 0), (1001, "", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.where("doc_id < 300"), table.where("doc_id < 300").select("doc_id", "toxic"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.toxicity(table, model).collect()}
    right = [got[k] == (k % 4 == 0) for k in range(300, 400)]
    assert np.mean(right) > 0.95 and got[1000] == 0
    none = toxicity.train(table, table.where("toxic = 0").select("doc_id", "toxic"))
    assert {x["score"] for x in toxicity.toxicity(table, none).collect()} == {0.0}


def test_toxicity_window_by_window(spark):
    """Scores by plain zstandard calls, one window at a time, from the fitted dictionaries, cell weights and curve."""
    r = random.Random(6)
    plain, bad = ["".join(r.choices("abdeghilmnorst", k=r.randint(2, 9))) for _ in range(300)], ["gruzzle", "vokkitton", "plixxer"]
    rows = []
    for k in range(240):
        w = r.choices(plain, k=40)
        if k % 3 == 0:
            for _ in range(2):
                w[r.randrange(40)] = r.choice(bad)
        rows.append((k, " ".join(w), int(k % 3 == 0), "clash"))
    odd = ["", None, "Gruzzle “vokkitton” —plixxer\u3002", "x" * 60, "中文字" * 20, "ΣΑΣ éÉ " * 5, " ".join(plain) + " " + "gruzzle " * 3, "a\u00a0gruzzle\u00a0b", "é" * 13]
    rows += [(1000 + k, t, 0, "clash") for k, t in enumerate(odd)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = toxicity.train(table.where("doc_id < 240"), table.where("doc_id < 240").select("doc_id", "toxic"))
    options = dict(window_log=17, chain_log=16, hash_log=17, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_checksum=0, write_content_size=0, write_dict_id=0)
    pair = [zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**options), dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for c in model.contents]
    marks = {chr(c): " " for c in [*range(0xA0, 0xC0), *range(0x2000, 0x2080), *range(0x3000, 0x3040)]}

    def score(text):
        data = (text or "").translate(LOW).translate(str.maketrans(marks)).encode()
        total, n = 0.0, 0
        for run in re.findall(rb"[0-9a-z\x80-\xff]+", data):
            starts = [0] if len(run) <= 24 else [i for i in range(len(run)) if run[i] & 0xC0 != 0x80]
            for at in starts:
                end = min(at + 24, len(run))
                while end < len(run) and run[end] & 0xC0 == 0x80:
                    end -= 1
                piece = b" " + run[at:end] + b" "
                lengths = [min(len(c.compress(piece + toxicity._CARRIER)), 63) for c in pair]
                total += model.cell_weights.get((min(len(piece), 26) * 64 + lengths[0]) * 64 + lengths[1], 0.0)
                n += 1
        x = np.array([1.0, math.log1p(total), total / math.sqrt(n + 1)]) @ model.curve
        return 1 / (1 + math.exp(-x))

    got = {x["doc_id"]: (x["score"], x["predicted"]) for x in toxicity.toxicity(table, model).collect()}
    for k, text, *_ in rows:
        want = score(text)
        assert abs(got[k][0] - want) < 1e-9 and got[k][1] == int(want >= 0.5)
    assert all(got[k][1] for k in (1002, 1006, 1007)) and model.cell_weights


def test_toxicity_sample_is_whole_rows():
    rows = [{"doc_id": k, "toxic": 1, "size": s} for k, s in enumerate([50, 30, 30])]
    assert toxicity._within(rows, 40) == [(0, 1)] and toxicity._within(rows, 80) == [(0, 1), (1, 1)] and toxicity._within([], 9) == []


@pytest.fixture(scope="module")
def long_rows():
    """Texts beyond every block and run of the operators, that share passages across their block borders."""
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(1, 9))) for _ in range(5000)]
    base = r.choices(vocabulary, k=210_000)  # about 1.2 MB
    other = r.choices(vocabulary, k=60) + base[100_000:100_400] + base[180_000:180_020] + "permission to use under the mit license".split()
    near = base[:]
    for _ in range(500):
        near[r.randrange(len(near))] = "changed"
    return [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(near)), (4, " ".join(base[99_000:99_050])), (5, "ab" * 400_000), (6, None)]


def test_long_texts(spark, long_rows):
    table = spark.createDataFrame(long_rows, "doc_id long, text string")
    frame = pd.DataFrame(long_rows, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("f", frame)
    con.execute("CREATE TABLE documents AS SELECT doc_id, text FROM f")
    equal(substring_dedup(table, digest=True), con.execute(sql.substring_dedup()).df())
    equal(quality_rules(table), con.execute(sql.quality_rules()).df())
    equal(license_scan(table), con.execute(sql.license_scan()).df())
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_join(table).collect())
    assert got == jaccard_groups(long_rows) and got[2][2] == 1
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for x in bpe.bpe_encode(table.where("doc_id <> 5"), path, digest=True).collect():
        text = dict(long_rows)[x["doc_id"]] or ""
        ids = codec.encode_ordinary(text)
        assert x["n_tokens"] == len(ids) and x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    items = [(1, " ".join(long_rows[3][1].split()[:40])), (2, "no such item at all here")]
    found = decontamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["item_id"], x["start_word"], round(x["similarity"], 6)) for x in found)[:2] == [(1, 1, 99_000, 1.0), (3, 1, 99_000, round(min(x["similarity"] for x in found), 6))]
    model = train(table.where("doc_id < 5").withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 2)))
    assert language_id(table, model).where("lang_pred <> 'und'").count() == 5


def test_suffix_dedup_of_long_texts(spark, long_rows):
    rows = long_rows[:4] + [(5, "ab" * 30_000)]
    want, seen = [], set()
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            h = hash(b[i : i + 100])
            if h in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(h)
        mask = np.cumsum(gone[:-1]) > 0
        want.append((k, len(b), int(mask.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect())
    assert got == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><nav><a href='/'>Home</a></nav><p class='lead x1'>A &amp; b<br>c<p>D <b>e</b><script>var x='<p>';</script><!-- no -->f", ["Home", "A & b c", "D ef"]),
        ("<article><p title='a > b'>Text</p></article>", ["Text"]),
        ("<p>a<p title='x>y' id=\"q>r\">b<p data-x=\"it's > 1\">c", ["a", "b", "c"]),
        ("<p title=a\"b>c</p><p it's>d</p>", ["c", "d"]),
        ("a < b <3 c<", ["a < b <3 c<"]),
        ("<p>x</p><p class='open", ["x"]),
        ("<p title=\"never closed>text", ["text"]),
        ("<!-->a<!--->b<!-- c > --><?php echo 1 ?>d<![CDATA[e]]></>", ["abd"]),
        ("<style>p{}</style ><textarea><p>no</textarea><title>T</title><ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>", ["T", "1", "2", "3", "4", "5"]),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>x<option>y</select>&#x41;&eacute;\u00a0&nbsp;z", ["a", "b", "c", "Aé z"]),
        ("<svg><text>no</text></svg><noscript>no</noscript><p>\n one \t two\n</p> <div> </div>", ["one two"]),
        (None, []),
        ("", []),
        (" <p> </p> ", []),
    ],
)
def test_html_blocks(page, want):
    assert blocks(page).texts == want


def test_html_paths():
    deep = blocks("<article id='Story top'>" + "<div>" * 40 + "<p>a" + "</div>" * 40 + "<section role=note>b</section></article><p>c")
    assert deep.path(0) == ["article", "story", "top", *["div"] * 40, "p"] and deep.path(1) == ["article", "story", "top", "section", "note"] and deep.path(2) == ["p"]
    features = html_extract.Pages([deep, blocks("<p>d")])
    weights = {"path": np.random.default_rng(0).normal(size=(html_extract.PATH_BUCKETS, html_extract.PATH_DIM)), "word": np.zeros((html_extract.WORD_BUCKETS, html_extract.WORD_DIM))}
    got = np.concatenate([part for _, _, part in features.vectors(weights)])[:, : html_extract.PATH_DIM]
    for row, path in zip(got, [*map(deep.path, range(3)), ["p"]]):
        assert np.allclose(row, sum(weights["path"][html_extract._bucket(x)] for x in path) / np.sqrt(len(path)))


def test_html_long_pages(monkeypatch):
    model = html_extract.labeller()
    for page, n in (("<a " * 1_700_000, 0), ("<p>a" * 50_000, 50_000), ("<li><div>" * 20_000 + "<li>y" * 20_000, 20_000), ("<td>" * 100_000 + "z", 1), ("<" * 500_000, 1)):
        start = time.time()
        assert len(blocks(page)) == n and len(model.label([blocks(page)])[0]) == n
        assert time.time() - start < 30
    pages, _ = html_extract.generated(12, 5)
    whole = model.label(pages)
    monkeypatch.setattr(html_extract, "SOME", 7)
    assert all(np.allclose(a, b) for a, b in zip(whole, model.label(pages, cells=50)))


def one_by_one(model, page):
    """The labeller's probabilities by its formulas, a block at a time."""
    w, h = model.w, html_extract.HIDDEN
    squash = lambda z: 1 / (1 + np.exp(-z))
    x = [np.tanh(v @ w["in"] + w["in_b"]) for _, _, part in html_extract.Pages([page]).vectors(w) for v in part]

    def read(xs, side):
        state, cell, out = np.zeros(h), np.zeros(h), []
        for v in xs:
            i, f, o, g = np.split(v @ w[f"{side}x"] + state @ w[f"{side}h"] + w[f"{side}_b"], 4)
            cell = squash(f) * cell + squash(i) * np.tanh(g)
            state = squash(o) * np.tanh(cell)
            out.append(state)
        return out

    both = zip(read(x, "f"), read(x[::-1], "b")[::-1])
    return np.array([squash(np.concatenate(s) @ w["out"][:, 0] + w["out_b"][0]) for s in both])


#: Pages laid out by hand, with what a reader takes for the article.
BY_HAND = [
    (
        "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1><p>Some text here, with words.</p><p>More of it.</p></article><footer>&copy; x</footer></body></html>",
        ["Head", "Some text here, with words.", "More of it."],
    ),
    (
        "<!doctype html><html><head><title>News</title><style>p{}</style></head><body><header class=masthead><a href=/>Daily News</a></header><div class='menu'><a href=/a>Sport</a> <a href=/b>Politics</a></div>"
        "<main><article><h1>River rises after rain</h1><p>The river rose by two metres on Monday, the town said.</p><p>Nobody was hurt, but <a href='/x'>three roads</a> stayed closed until the evening.</p>"
        "<blockquote>We were lucky, said the mayor.</blockquote></article></main><div class='comments'><div class='comment'><p>What a mess that was again.</p></div></div>"
        "<div class='advert'>Buy umbrellas now!</div><footer><p>Copyright Daily News</p></footer></body></html>",
        ["River rises after rain", "The river rose by two metres on Monday, the town said.", "Nobody was hurt, but three roads stayed closed until the evening.", "We were lucky, said the mayor."],
    ),
    (
        "<html><body><div class='cookie-notice'>We use cookies. <button>OK</button></div><nav><a href=1>One</a><a href=2>Two</a></nav><article class=post><h1>How to bake bread</h1><p>Mix flour and water, and let the dough rest for an hour.</p>"
        "<ul><li>Flour, a pound of it.</li><li>Water, a cup.</li></ul><p>Bake it until it is brown.</p></article><aside class='sidebar'><h3>Related</h3><ul><li><a href=3>Cakes</a></li><li><a href=4>Pies</a></li></ul></aside>"
        "<form action=/s><label>Search</label><input name=q><button>Go</button></form><footer>Imprint | Contact</footer></body></html>",
        ["How to bake bread", "Mix flour and water, and let the dough rest for an hour.", "Flour, a pound of it.", "Water, a cup.", "Bake it until it is brown."],
    ),
]


def test_html_extract(spark):
    model = html_extract.labeller()
    pages, truth = html_extract.generated(60, 123)
    found = model.label(pages)
    assert np.mean([((p >= 0.5) == (t >= 0.5)).mean() for p, t in zip(found, truth)]) > 0.97
    assert all(np.allclose(p, one_by_one(model, page)) for p, page in zip(found[:15], pages))
    rows = [(k, "u", page, "clash", 1) for k, (page, _) in enumerate(BY_HAND)] * 2 + [(10, None, None, "x", 2), (11, "v", "", "y", 3), (12, "w", "<nav></nav>", "z", 4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.html_extract(table).collect())
    want = ["\n\n".join(x) for _, x in BY_HAND]
    assert got == sorted([(k, x, len(x)) for k, x in enumerate(want)] * 2 + [(k, "", 0) for k in (10, 11, 12)])
    assert html_extract.html_extract(table.where("false")).count() == 0


def test_merged_transforms():
    r = random.Random(3)
    for _ in range(60):
        depth = r.choice([2, 3, 5])
        shards = [[bytes(r.choice(b"ab\x00c") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 6))] for _ in range(r.randint(1, 5))]
        each = [transform(s) for s in shards]
        source, block = merge(each, [len(s) for s in shards], depth)
        found = {}
        for k, s in enumerate(shards):
            at = np.flatnonzero(source == k)
            for n, rank in enumerate(ranks(each[k], np.array([len(x) for x in s]))):
                for j, x in enumerate(s):
                    if n <= len(x):
                        sub = x[len(x) - n :][:depth]
                        found.setdefault(sub if len(sub) == depth else (k, j, n), set()).add(int(block[at[rank[j]]]))
        assert all(len(v) == 1 for v in found.values()) and max(Counter(b for v in found.values() for b in v).values()) == 1


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df in (quality_rules(empty), substring_dedup(empty), suffix_dedup(empty), license_scan(empty), jaccard_join.jaccard_join(empty), bpe.bpe_encode(empty, path), decontamination(empty, bench)):
        assert df.count() == 0
    assert toxicity.toxicity(empty, toxicity.train(empty, empty.select("doc_id", F.lit(1).alias("toxic")))).count() == 0
