"""The ten registered queries over whole tables, their columns and what plain code says of their rows."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from quillon.llm import html, packing, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def table(name):
    return duckdb.sql(f"select * from '{DATA}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def run(spark):
    return lambda number: next(f for name, f in queries.queries().items() if name.startswith(f"op{number}_"))(spark, DATA).toPandas()


def test_there_are_ten():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 11))


def test_pages(run):
    pages = {r.page_id: r for r in table("pages").itertuples()}
    out = run(1)
    assert list(out.columns) == ["page_id", "url", "text", "n_chars"] and len(out) == len(pages)
    assert all(r.text == html.extract(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in out.itertuples())


def test_vectors(run):
    t, out = table("embeddings"), run(2).set_index("vec_id")
    x = np.stack(t.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert list(out.columns) == ["n_links", "component_id", "kept"]
    assert [out.n_links[i] for i in t.vec_id] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()


def test_documents(run):
    ids = sorted(table("documents").doc_id)
    for number, columns in ((3, {"doc_id", "n_shingles", "component_id"}), (6, {"doc_id", "n_words", "n_removed", "kept_sha256"}), (7, {"doc_id", "held_out", "score", "predicted"}), (8, {"doc_id", "digest", "licence", "notices", "n_notices"})):
        out = run(number)
        assert set(out.columns) == columns and sorted(out.doc_id) == ids, number
        if number == 7:
            assert out.score.between(0, 1).all() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out.itertuples())
    assert set(run(4).columns) == {"doc_id", "item_id", "start", "n_words", "similarity"}


def test_urls(run):
    out = run(5)
    assert set(out.columns) == {"page_id", "host", "path", "rule", "verdict"} and sorted(out.page_id) == sorted(table("pages").page_id)


def test_pieces(run):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(packing.vocabulary()), run(9)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in table("documents").itertuples()}
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in out.itertuples())
    assert out.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}


def test_archives(run):
    first = {}
    pages = sorted(table("pages").itertuples(), key=lambda r: r.page_id)
    out = run(10).set_index("page_id")
    assert set(out.columns) == {"payload_bytes", "payload_digest", "record_type", "refers_to"} and len(out) == len(pages)
    for r in pages:
        payload = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        got, response = out.loc[r.page_id], first.setdefault(digest, r.page_id)
        assert (got.payload_bytes, got.payload_digest) == (len(payload), digest)
        assert got.record_type == ("response" if response == r.page_id else "revisit") and (got.refers_to == response) == (response != r.page_id)
