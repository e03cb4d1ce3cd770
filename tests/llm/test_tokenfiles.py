import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from scholarframe.llm.tokenfiles import TokenFile, TokenFileWriter, read_documents, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def made(docs, frame_ids):
    out = io.BytesIO()
    writer = TokenFileWriter(out, frame_ids)
    for i in range(0, len(docs), 3):
        own = docs[i : i + 3]
        bounds = np.r_[0, np.cumsum([len(x) for x in own])]
        writer.add(np.arange(i, i + len(own)), np.ones(len(own), bool), np.concatenate([*own, np.zeros(0, np.uint32)]).astype(np.uint32), bounds)
    writer.close()
    return out.getvalue()


def test_round_trip_by_frames():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49408, n).astype(np.uint32) for n in (5, 1, 700, 0, 64, 64, 3, 9000, 2)]
    data = made(docs, 64)
    file = TokenFile(io.BytesIO(data), len(data))
    assert file.doc_ids.tolist() == list(range(9))
    assert len(file.table) > 5
    for i in rng.permutation(9):
        assert file.document(i).tolist() == docs[i].tolist()


def test_plain_readers_see_the_ids():
    docs = [np.arange(n, dtype=np.uint32) for n in (40, 50, 60)]
    data = made(docs, 64)
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
        assert reader.read() == b"".join(x.astype("<u4").tobytes() for x in docs)


def test_a_changed_frame_is_noticed():
    data = bytearray(made([np.arange(1000, dtype=np.uint32)], 64))
    data[200] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        TokenFile(io.BytesIO(bytes(data)), len(data)).document(0)


@pytest.mark.parametrize("empty", [True, False])
def test_files_of_a_table(spark, tmp_path, empty):
    library = Tokenizer.from_file(PATH)
    docs = [] if empty else [(i * 7 % 101, f"Text number {i} " * (i % 40)) for i in range(101)] + [(None, "no id"), (5, "again"), (5, "again"), (300, None), (301, ""), (302, "é" * 40000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, tie string, start long").repartition(4)
    folder = f"file://{tmp_path}/out"
    got = read_token_files(write_token_files(df, folder, PATH), folder, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in docs), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert r["start"] == at
        assert (r["n_tokens"], r["ids_crc32"]) == (len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]
    want = sorted((str(k), library.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in docs)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want


def test_only_frames_of_wanted_documents_are_read(spark, tmp_path):
    """Frames without a wanted document are spoilt, which no reader of others may notice."""
    df = spark.createDataFrame([(i, f"document {i} " + "word " * 3000) for i in range(200)], "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/out"
    manifest = write_token_files(df, folder, PATH)
    whole = {r["doc_id"]: r for r in read_token_files(manifest, folder, with_ids=True).collect()}
    wanted = [0, 57, 58, 199]
    spoilt = frames = 0
    for path in [r["path"] for r in manifest.collect()]:
        data = bytearray(open(path, "rb").read())
        file = TokenFile(io.BytesIO(bytes(data)), len(data))
        used = {int(np.searchsorted(file.frame_starts, file.starts[i], "right")) - 1 for i, k in enumerate(file.doc_ids) if k in wanted}
        for k in range(len(file.table) - 1):
            frames += 1
            if k not in used:
                data[int(file.places[k]) + int(file.table[k, 0]) // 2] ^= 255
                spoilt += 1
        open(path, "wb").write(bytes(data))
    assert 0 < frames - spoilt <= len(wanted) < spoilt
    asked = spark.createDataFrame([(k,) for k in [*wanted, 57, None, 5000]], "doc_id long")
    got = {r["doc_id"]: r for r in read_documents(manifest, folder, asked).collect()}
    assert sorted(got) == wanted and all(got[k] == whole[k] for k in wanted)
    with pytest.raises(Exception):
        read_documents(manifest, folder, spark.createDataFrame([(100,)], "doc_id long")).collect()


def test_more_wanted_documents_than_are_broadcast(spark, tmp_path):
    df = spark.createDataFrame([(i, f"document {i}") for i in range(30)], "doc_id long, text string")
    folder = f"file://{tmp_path}/out"
    manifest = write_token_files(df, folder, PATH)
    few, many = (read_documents(manifest, folder, df.where("doc_id % 2 = 0"), most_wanted=n) for n in (100, 3))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.select(few.columns).collect()))
    assert read_documents(manifest, folder, df.limit(0)).collect() == []
