"""The registered queries on whole small tables, against brute force."""

import collections
import zlib

import numpy as np
import pandas as pd
import pytest
from entiquery.llm.queries import ORACLE_SQL, QUERIES

from test_licenses import brute as brute_licenses
from test_simhash import brute_print, brute_roots
from test_substrings import brute as brute_substrings
from test_urls import brute as brute_url

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(name, d=SMALL):
    return pd.read_parquet(f"{d}/{name}.parquet")


@pytest.fixture(scope="module")
def docs():
    d = table("documents").sort_values("doc_id")
    return list(zip(d["doc_id"].tolist(), d["text"].tolist(), strict=True))


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t for _, t in docs], add_special_tokens=False)]


def run(name, spark, d=SMALL):
    return QUERIES[name](spark, d)


def test_names():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_op1(spark):
    e = table("embeddings", MEDIUM)
    x, v = np.stack(e["embedding"].tolist()).astype(float), e["vec_id"].to_numpy()
    got = collections.defaultdict(list)
    for r in run("op1_neighbours", spark, MEDIUM).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(v[v % 20 == 0].tolist())
    hits = 0
    for q, rows in got.items():
        score = x @ x[v == q][0]
        best = sorted((-s, i) for s, i in zip(score.tolist(), v.tolist(), strict=True) if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in rows})
        assert all(s == pytest.approx(float(score[v == i][0])) for _, i, s in rows)
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("name,label,modulus,rest", [("op2_quality", "quality", 3, 1), ("op5_toxicity", "toxic", 5, 0)])
def test_op2_op5(spark, name, label, modulus, rest):
    truth = dict(zip(*(table("labels", MEDIUM)[c] for c in ("doc_id", label)), strict=True))
    rows = run(name, spark, MEDIUM).collect()
    assert len(rows) == len(table("documents", MEDIUM))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9  # from some 300 labelled rows


def test_op3(spark, docs):
    assert sorted(tuple(r) for r in run("op3_suffix_dedup", spark).collect()) == sorted(brute_substrings(docs))


def test_op4(spark, docs, ids):
    at, expected = 0, []
    for (d, _), x in zip(docs, ids, strict=True):
        x = np.array([*x, 2], "<u4")
        expected.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in run("op4_token_files", spark).collect()) == expected


def test_op6(spark):
    urls = dict(zip(*(table("pages")[c] for c in ("page_id", "url")), strict=True))
    rows = run("op6_url_filter", spark).collect()
    assert len(rows) == len(urls)
    assert all((r["host"], r["path"], r["rule"]) == brute_url(urls[r["page_id"]]) and r["verdict"] in ("allow", "block") for r in rows)


def test_op7(spark, docs):
    prints = [brute_print(t) for _, t in docs]
    root = brute_roots(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    expected = sorted((d, f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, root, strict=True))
    assert sorted(tuple(r) for r in run("op7_simhash", spark).collect()) == expected


def test_op9(spark, docs, ids):
    expected = []
    for (d, _), x in zip(docs, ids, strict=True):
        x = np.array([*x, 0], "<u4")
        expected += [(d, i // 2048, i, len(x[i : i + 2048]), zlib.crc32(x[i : i + 2048].tobytes())) for i in range(0, len(x), 2048)]
    rows = run("op9_best_fit_packing", spark).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(expected)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.02 * -(-sum(r[3] for r in expected) // 2048) + 1


def test_op10(spark, docs):
    got = sorted((tuple(r)[:6] for r in run("op10_license_scan", spark).collect()), key=lambda r: r[0])
    assert got == [(d, *brute_licenses(t)) for d, t in docs]
