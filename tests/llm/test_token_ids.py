"""Token ids in ORC against the library, and what the files hold."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import queries, token_ids, work

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
ENCODER = token_ids.Encoder(FILE)


def ids(t):
    return [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]


def brute(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        found = ids(t)
        out.append((i, start, len(found), zlib.crc32(np.array(found, dtype="<u4").tobytes())))
        start += len(found)
    return out


ODD = [None, "", " ", "\n", "a", " a", "a ", "a\nb", "\na\n", "a  b", "a \n b", "a\t b", "don't we'll 'S", "x y z", "x  y", "é ü\nß", "<|endoftext|> a", "b<|endoftext|>.", "it's,we'll.'sx'S", "a <|endoftext|>b", "1234 ١٢ x1y2", "日本 語\n", "a​b c", "\x01 a", "a \x01b", "...! ?\n--", "\u0085 q", "  q"]


def test_texts_against_the_library():
    assert ENCODER.cuts
    flat, offsets = ENCODER.encode(pa.array(ODD, pa.string()))
    for t, a, b in zip(ODD, offsets[:-1], offsets[1:], strict=True):
        assert flat[a:b].tolist() == ids(t), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n \n ab'sté1.,\t  　\x1c᠎﻿À日<|>")), max_size=24), max_size=6))
def test_any_text_against_the_library(texts):
    flat, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids(t) for t in texts]


def test_all_characters_against_the_library():
    texts = ["ab " + chr(c) + " cd" + chr(c) + ".x" + chr(c) + "7" + chr(c) + chr(c) + "!" + chr(c) + "\n" + chr(c) + "e f" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    flat, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [flat[a : b - 1].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def dataset(spark, rows, **more):
    path = work.new_path(spark, "ids-test")
    token_ids.write(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, shard string, at int"), path, FILE, **more)
    return path


def result(spark, path):
    return sorted(map(tuple, token_ids.checksums(token_ids.read(spark, path)).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("shards", [None, 1, 5])
def test_files_against_the_library(spark, shards):
    r = random.Random(5)
    rows = [(k * 7 % 101, t) for k, t in enumerate(ODD)] + [(r.randrange(-50, 300), " ".join(f"w{r.randrange(900)}" for _ in range(r.randrange(60)))) for _ in range(150)]
    rows += [(None, "no id"), (None, None), (500, "long " * 300_000 + "x" * 100_000), *rows[:3]]
    path = dataset(spark, rows, shards=shards)
    assert result(spark, path) == brute(rows)
    files = token_ids.shards_of(spark, path).orderBy("shard").collect()
    assert sum(f.n_rows for f in files) == len(rows)
    for f, g in zip(files, files[1:], strict=False):
        assert g.start == f.start + f.n_ids and (f.last_id is None or f.last_id <= g.first_id)


def test_no_rows(spark):
    path = dataset(spark, [])
    assert result(spark, path) == [] and token_ids.shards_of(spark, path).count() == 0


def test_stripes_and_bloom_filters(spark):
    """A file has many stripes, each with a Bloom filter, and a lookup reaches the scan."""
    r = random.Random(6)
    rows = [(3 * k, " ".join(f"{r.randrange(10**9)}" for _ in range(60))) for k in range(6000)]
    path = dataset(spark, rows, shards=1, stripe_bytes=100_000, stride=1000)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    found = [s.getPath() for s in folder.getFileSystem(conf).listStatus(folder) if s.getPath().getName().endswith(".orc")]
    assert len(found) == 1
    reader = jvm.org.apache.orc.OrcFile.createReader(found[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getStripes().size() >= 2 and reader.getRowIndexStride() == 1000
    kinds = {reader.rows().readStripeFooter(s).getStreams(k).getKind().toString() for s in list(reader.getStripes())[:1] for k in range(reader.rows().readStripeFooter(s).getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    encodings = {str(e.getKind()) for e in reader.rows().readStripeFooter(reader.getStripes().get(0)).getColumnsList()}
    assert "DIRECT_V2" in encodings
    some = token_ids.lookup(spark, path, [30, 31, 9000])
    assert "PushedFilters: [In(doc_id, [30,31,9000])" in some._jdf.queryExecution().toString().replace("IsNotNull(doc_id), ", "")
    want = {x[0]: x[1:3] for x in brute(rows)}
    assert {x.doc_id: (x.start, x.n_ids) for x in some.collect()} == {k: want[k] for k in (30, 9000)}
    assert token_ids.read(spark, path, F.col("doc_id") < 9).count() == 3


def test_query_against_the_library(spark):
    got = queries.QUERIES["op13_token_ids"](spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows)


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE", 40)
    encoder, r = token_ids.Encoder(FILE), random.Random(2)
    for _ in range(12):
        texts = [" ".join(f"w{r.randrange(60)}" for _ in range(20)) + " " + "x" * 300 for _ in range(3)]
        flat, offsets = encoder.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids(t) for t in texts]
        assert len(encoder.known) <= 40 == token_ids.CACHE and len(set(encoder.known.to_pylist())) == len(encoder.known)
