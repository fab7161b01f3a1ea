import glob
import random
import zlib
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pytest
from py4j.java_gateway import get_field

from peerband.llm import token_files as tf
from tests.llm.shapes import messy, rows_of

#: Ids of the file with many stripes start here; the bridge to the JVM sends them as longs.
FIRST = 2**33
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@contextmanager
def setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def digest(ids):
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", "a  b",
    "don't we'll I'M o'clock 'tis", "x1y2 3z", "end. (start) \"quote\"...", "a b c\u0085d",
    "été ÀÉ×÷ÿ naïve", "日本語 テキスト\nです", "🙂🙃 🙂", "tab\tand\x1cfile\x1dsep", "<|endoftext|>",
    "a<|endoftext|> b", "a\r\nb", " x  y", "é x", "__init__ == `code`", "\x00 \x7f",
    "word," * 50, "無" * 3000, "a" * 500,
]


def test_encoder_equals_the_library():
    encoder, tokenizer = tf.ChunkEncoder(VOCABULARY), library()
    rng = random.Random(2)
    pieces = [*ODD, " ", "\n", "'", "s", ",", "7", "\t", "Word", "élan"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
                   for _ in range(1500)]
    for text, code in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(code, "<u4").tolist() == ids_of(tokenizer, text)[:-1], text


def test_caches_are_bounded_by_entries_and_length(monkeypatch):
    monkeypatch.setattr(tf, "CACHE_ENTRIES", 50)
    encoder, tokenizer = tf.ChunkEncoder(VOCABULARY), library()
    for n in range(20):
        texts = [f"{'無' * 5000} w{n}x{k}, plain{'abcdefghij'[k]}{'abcdefghijklmnopqrst'[n]}."
                 for k in range(10)]
        for text, code in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(code, "<u4").tolist() == ids_of(tokenizer, text)[:-1]
        for kept in (encoder.chunks, encoder.parts):
            assert max(len(kept), len(kept.older)) <= 50
            assert all(len(c) <= tf.CACHE_CHARS for c in [*kept, *kept.older])


def test_files_hold_every_document_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6) * 2 + 1, f"document {n} " + rng.choice(ODD)) for n in range(600)]
    rows = list(dict(rows).items())
    path = str(tmp_path / "tokens.orc")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        tf.write_tokens(messy(spark, rows), VOCABULARY, path)
    read = tf.with_starts(tf.read_tokens(spark, path), path)
    got = sorted(rows_of(read, "part", "at", "id", "start", "ids"))
    assert [g[2] for g in got] == sorted(i for i, _ in rows) and len({g[0] for g in got}) > 1
    tokenizer, text, start = library(), dict(rows), 0
    for _, _, i, at, ids in got:
        assert at == start and list(ids) == ids_of(tokenizer, text[i])
        start += len(ids)
    some = sorted(rng.sample(sorted(text), 7))
    picked = tf.with_starts(tf.read_tokens(spark, path, [*some, 2]), path)
    assert sorted(rows_of(picked, "id", "start")) == [g[2:4] for g in got if g[2] in some]


def test_messy_rows(spark):
    docs = messy(spark)
    got = rows_of(tf.tokens_round_trip(docs, VOCABULARY), "id", "n_tokens", "ids_crc32", "start")
    tokenizer = library()
    want = [(r.doc_id, *digest(ids_of(tokenizer, r.text))) for r in docs.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((g[:3] for g in got), key=key) == sorted(want, key=key)
    got.sort(key=lambda g: g[3])
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda i: (i is not None, i or 0))
    assert [g[3] for g in got] == np.cumsum([0, *[g[1] for g in got[:-1]]]).tolist()


def test_one_id_in_most_rows_spans_many_parts(spark, tmp_path):
    rows = [(7, f"text {n % 3}") for n in range(3000)] + [(n, "x") for n in range(300)]
    path = str(tmp_path / "tokens.orc")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        tf.write_tokens(messy(spark, rows), VOCABULARY, path)
    parts = tf.read_tokens(spark, path).where("id = 7").groupBy("part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2000


def test_empty_table(spark):
    assert tf.tokens_round_trip(messy(spark).where("false"), VOCABULARY).count() == 0


@pytest.fixture(scope="module")
def wide_file(spark, tmp_path_factory):
    """One file of many stripes."""
    path = str(tmp_path_factory.mktemp("orc") / "tokens.orc")
    rows = spark.range(FIRST, FIRST + 12000, 2).selectExpr(
        "id as doc_id",
        "array_join(transform(sequence(1, 30), k -> sha2(string(id * 99 + k), 256)), ' ') as text",
    )
    with setting(spark, "spark.sql.shuffle.partitions", 1):
        tf.write_tokens(rows, VOCABULARY, path, stripe_bytes=1 << 20)
    return path


def footers(spark, file):
    """(column encodings, stream kinds) of each stripe."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(file)
    reader = jvm.org.apache.orc.OrcFile.createReader(
        where, jvm.org.apache.orc.OrcFile.readerOptions(conf)
    )
    rows, out = reader.rows(), []
    for stripe in reader.getStripes():
        foot = rows.readStripeFooter(stripe)
        out.append((
            {c.getKind().toString() for c in foot.getColumnsList()},
            {(s.getColumn(), s.getKind().toString()) for s in foot.getStreamsList()},
        ))
    rows.close()
    reader.close()
    return out


def test_stripes_indexes_and_bloom_filters(spark, wide_file):
    files = glob.glob(f"{wide_file}/*.orc")
    assert len(files) == 1
    found = footers(spark, files[0])
    assert len(found) > 1
    for encodings, streams in found:
        assert "DIRECT_V2" in encodings  # integer run-length encoding
        assert (1, "ROW_INDEX") in streams
        assert (1, "BLOOM_FILTER_UTF8") in streams and (2, "BLOOM_FILTER_UTF8") not in streams


def test_a_reader_of_few_documents_skips_row_groups(spark, wide_file):
    """An id that no row has, though within every range, is answered by the filters alone."""
    query = tf.read_tokens(spark, wide_file, [FIRST + 5001])
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and str(FIRST + 5001) in plan.split("PushedFilters")[1]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(glob.glob(f"{wide_file}/*.orc")[0])
    factory = jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory
    kind = getattr(jvm, "org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf$Type").LONG

    def batches(i):
        sarg = factory.newBuilder().equals("id", kind, i).build()
        reader = jvm.org.apache.orc.OrcFile.createReader(
            where, jvm.org.apache.orc.OrcFile.readerOptions(conf)
        )
        names = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
        names[0] = "id"
        rows = reader.rows(reader.options().searchArgument(sarg, names))
        batch, n = reader.getSchema().createRowBatch(), 0
        while rows.nextBatch(batch):
            n += get_field(batch, "size")
        rows.close()
        reader.close()
        return n

    assert batches(FIRST + 5000) <= 2 * tf.GROUP_ROWS
    assert sum(batches(FIRST + i) for i in range(5001, 5061, 2)) <= 5 * tf.GROUP_ROWS
