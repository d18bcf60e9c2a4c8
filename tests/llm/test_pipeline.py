"""Each stage against brute force on a table with nulls, empty texts, repeated rows and a further column; and all of them in turn."""

import hashlib
import random
import re

import pytest
import tiktoken

import corpus_pipeline
import public_tokenizers
from tests.conftest import SF
from tests.llm.test_operators import every_window, far_aside, jaccard_groups, naive_bayes, words
from wfspark.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocabulary = {"aa": ["".join(r.choices("abcdefg", k=r.randint(2, 7))) for _ in range(200)], "zz": ["".join(r.choices("tuvwxyzé", k=r.randint(2, 7))) for _ in range(200)]}
    say = lambda lang, n: " ".join(r.choices(vocabulary[lang], k=n))
    passage, out = say("aa", 40), []
    for k in range(40):
        lang = "aa" if k % 2 else "zz"
        text = say(lang, r.randint(3, 120))
        text = f"{text}\n\t{passage} {say(lang, 5)}" if k % 5 == 0 else text
        out.append((k, text, None if k % 7 == 0 else lang, "s", len(text), "clash"))
        if k % 6 == 0:
            w = text.split(" ")
            w[len(w) // 2] = "other"
            out.append((100 + k, " ".join(w), lang, None, 1, None))
            out.append((200 + k, text, lang, "s", len(text), None))
    out += [(300, None, "aa", "s", None, None), (301, "", None, None, 0, None), (302, " 12 !\n", "zz", "s", 6, None), (None, passage, "aa", "s", 1, None)]
    return out + [out[3], out[3], (out[4][0], "a text of its own beside the other", "aa", "s", 3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, "no document has these words at all in it")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def stage(spark, folder, name, rows):
    found = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, SCHEMA), folder)
    assert name == "encode" or tuple(found.columns) == corpus_pipeline.COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=key)


def test_language_stage(spark, folder, rows):
    best = naive_bayes([(t, lang) for _, t, lang, *_ in rows], [t for _, t, *_ in rows])
    want = [(k, t, lang or found, s, n) for (k, t, lang, s, n, _), (found, _) in zip(rows, best) if found != "und"]
    assert stage(spark, folder, "language_id", rows) == sorted(want, key=key) and {r[2] for r in want} == {"aa", "zz"}
    unlabelled = [(k, t, None, s, n, x) for k, t, _, s, n, x in rows]
    want = [r[:5] for r in unlabelled if re.search(r"[^\W\d_]", r[1] or "")]
    assert stage(spark, folder, "language_id", unlabelled) == sorted(want, key=key)


def test_near_duplicate_stage(spark, folder, rows):
    one = {}
    for row in rows:
        if row[0] is not None and (row[0] not in one or key(row[1:2]) < key(one[row[0]][1:2])):
            one[row[0]] = row
    groups = jaccard_groups([r[:2] for r in one.values()], 5, 80)
    kept = {k for k, _, least in groups if k == least}
    want = [r[:5] for k, r in one.items() if k in kept] + [r[:5] for r in rows if r[0] is None]
    assert stage(spark, folder, "near_duplicates", rows) == sorted(want, key=key) and len(kept) < len(one)


def test_substring_stage(spark, folder, rows):
    first = {}
    for k, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 12 if k is not None else 0):
            g = tuple(w[i : i + 13])
            first[g] = min(k, first.get(g, k))
    want = []
    for k, t, lang, s, n, _ in rows:
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        w = words(t)
        gone = {j for i in range(len(w) - 12 if k is not None else 0) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        if len(gone) == len(w) and w:
            continue
        text = t or ""
        for j in sorted(gone, reverse=True):
            text = text[: at[j][0]] + text[at[j + 1][0] if j + 1 < len(at) else len(t) :]
        want.append((k, text, lang, s, len(text)))
    assert stage(spark, folder, "substring_dedup", rows) == sorted(want, key=key)
    assert any(len(words(t)) < len(words(dict((r[0], r[1]) for r in rows[:60]).get(k, t))) for k, t, *_ in want)


def test_decontamination_stage(spark, tmp_path, rows):
    items = [(1, " ".join(words(rows[1][1])[:30])), (2, rows[12][1]), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaks = {k for k, _ in every_window([r[:2] for r in rows if r[0] is not None], items)}
    want = [r[:5] for r in rows if r[0] not in leaks]
    assert stage(spark, str(tmp_path), "decontamination", rows) == sorted(want, key=key) and 0 < len(want) < len(rows)


def test_decontamination_stage_looks_at_every_window(spark, tmp_path):
    item, aside = far_aside()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, aside, "aa", "s", len(aside), None), (2, "a text of its own", "aa", "s", 17, None)]
    assert every_window([r[:2] for r in rows], [(1, item)]).keys() == {(1, 1)}
    assert stage(spark, str(tmp_path), "decontamination", rows) == [rows[1][:5]]


def test_encoding_stage(spark, folder, rows):
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for k, t, *_ in rows:
        ids = codec.encode_ordinary(t or "")
        want.append((k, len(ids), ids, hashlib.sha256((t or "").encode()).hexdigest()))
    assert [(a, b, list(c), d) for a, b, c, d in stage(spark, folder, "encode", rows)] == sorted(want, key=lambda r: key(r[:2]))


def test_stages_on_an_empty_table(spark, folder):
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, folder, name, []) == []


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, SF).cache()
        assert 0 < out.count() <= before
        before, docs = out.count(), out
    run = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in run.select("doc_id", "n_tokens", "decoded_sha256").collect()) == sorted(tuple(r) for r in docs.select("doc_id", "n_tokens", "decoded_sha256").collect())
