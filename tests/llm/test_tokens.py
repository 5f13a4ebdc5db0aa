"""Token files, pieces and records: brute force and exact round trips."""

from __future__ import annotations

import gzip
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import registry, spm, token_orc, warc

from .odd import none, odd, odd_rows

PIECES = registry.tokenizer_file("piece_bpe_32k.model")
BPE = registry.tokenizer_file("byte_bpe_50k.json")


def randoms(alphabet, n, most=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def best_by_all_substrings(m, text):
    """The best score of any path, trying every piece at every place."""
    known = {p: s for p, s, i in zip(m.pieces, m.scores, range(len(m.pieces))) if i not in m.byte_ids.values() and i > 2}
    best = [0.0] + [-1e300] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + m.unknown_score
        for begin in range(max(0, end - 20), end):
            if text[begin:end] in known:
                best[end] = max(best[end], best[begin] + known[text[begin:end]])
    return best[-1]


def unigram_file(path, separable=True):
    """A small unigram model, written by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(9)
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(150)} | set("abcé▁") | {"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(60)}
    words |= set() if separable else {"a▁b", "c▁"}
    pieces += [(w, -rng.uniform(1, 12), 1) for w in sorted(words)]
    for piece, score, kind in pieces:
        proto.pieces.add(piece=piece, score=score, type=kind)
    Path(path).write_bytes(proto.SerializeToString())
    return str(path)


def library(path):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def ids(m, text):
    return np.frombuffer(m.encode(text), "<i4").tolist()


@pytest.mark.parametrize("separable", [True, False])
def test_unigram_paths_are_optimal_and_the_librarys(tmp_path, separable):
    path = unigram_file(tmp_path / "u.model", separable)
    m, lib = spm.PieceModel(path), library(path)
    assert not m.merges and m.separable == separable
    for t in randoms("abcé xz", 400):
        whole = (m.prefix + t.replace(" ", spm.MARK)) if t else ""
        got = m.best_path(whole)
        unknown = sum(1 for c in whole if c not in m.ids)
        assert sum(m.scores[i] for i in got if i not in m.byte_ids.values()) + unknown * m.unknown_score == pytest.approx(best_by_all_substrings(m, whole))
        assert ids(m, t) == got == lib.encode(t) and m.decode(got) == t


def test_merged_ids_are_the_librarys():
    m, lib = spm.PieceModel(PIECES), library(PIECES)
    assert m.merges
    texts = [t for a in ("ab  ▁é😀日 \n", "the  quick ", "   a", "▁▁ x", "漢字かな交じりab ", "etaoin shrdlu.,", "0123456789-=<>") for t in randoms(a, 300, 60)]
    texts += [" " * n for n in range(80)] + [" " * n + "ab" for n in range(60)] + ["", " " * 3000, "x" * 3000, "a\x00b", "<s>", "<0x41>"]
    for t in texts:
        assert ids(m, t) == lib.encode(t), t


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables here")
def test_whole_documents_are_the_librarys(spark):
    rows = registry.op2_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    lib = library(PIECES)
    assert len(rows) == len(texts) and all(r["ids"] == lib.encode(texts[r["doc_id"]]) for r in rows)


def test_pieces_round_trip():
    m = spm.PieceModel(PIECES)
    for text in ["", " ", "x", "日本語 😀 \x00\n\t", " lead", "tail ", *randoms("ab é\n😀日", 300)]:
        assert m.decode(np.frombuffer(m.encode(text), "<i4").tolist()) == text


def test_cache_generations_change_nothing():
    texts = randoms("abcdef ", 300, 60)
    want = [spm.PieceModel(PIECES).encode(t) for t in texts]
    small = spm.PieceModel(PIECES)
    small.limit = 10
    assert [small.encode(t) for t in texts] == want


def test_spm_over_odd_rows(spark):
    df = odd(spark)
    out = spm.decode(spm.encode(df, PIECES), PIECES)
    rows = out.collect()
    both = spm.transcribe(df, PIECES)
    assert both.columns == out.columns and sorted(map(repr, both.collect())) == sorted(map(repr, rows))
    assert len(rows) == len(odd_rows()) and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert out.columns == [c for c in df.columns if c != "ids"] + ["ids", "decoded"]
    assert all(r["round_trip"] for r in spm.round_trips(df, PIECES).collect())
    assert spm.round_trips(none(spark), PIECES).collect() == []


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("alphabet", ["abéñßÉ1'.,;:!?\n\t- ªºµÀɏȠ", "abcdeE'stlmvrd.\n ", "ab  \n\r\x0b\x85　*<|>"])
def test_encoder_equals_the_library(alphabet, monkeypatch):
    monkeypatch.setattr(token_orc, "CACHE_PIECES", 500)
    e = token_orc.PieceEncoder(BPE)
    texts = ["", "<|endoftext|> a b", "don't it's", "x\n\ny z", "tail ", *randoms(alphabet, 4000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        flat, counts = e.encode(pa.array(part, pa.string()), 2)
        want = plain(part)
        assert counts.tolist() == [len(w) for w in want] and (flat == np.concatenate(want)).all()


def test_letters_are_solved_once_whatever_stands_beside_them():
    texts = ["x word word. word, (word) word\nword.\nword! word?!", "word", "word. é1 word\n\nword", "", "."]
    e = token_orc.PieceEncoder(BPE)
    flat, counts = e.encode(pa.array(texts), 2)
    want = plain(texts)
    assert counts.tolist() == [len(w) for w in want] and (flat == np.concatenate(want)).all()
    assert {k for k in e.later.new if "word" in k} == {"word", "(word)", "word\n\nword"} and {k for k in e.first.new if "word" in k} == {"word"}
    for few in ([""], ["", ""], ["."]):
        flat, counts = e.encode(pa.array(few), 2)
        assert (flat == np.concatenate(plain(few))).all() and counts.sum() == len(flat)


def test_reading_drops_what_encoding_kept():
    texts = pa.array(["one two three", "two words"])
    e = token_orc.encoder(BPE)
    flat, counts = e.encode(texts, 2)
    assert e.later.new and e.first.new
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat.view(np.int32)))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([0, 1]), lists], ["doc_id", "file", "place", "ids"])
    (read,) = token_orc._digested(iter([batch]))
    assert not (e.later.new or e.later.old or e.first.new or e.first.old)
    assert read.column("ids_crc32").to_pylist() == [zlib.crc32(np.array(x, np.uint32).tobytes()) for x in lists.to_pylist()]
    again, _ = token_orc.encoder(BPE).encode(texts, 2)
    assert (again == flat).all()


def test_token_files(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is not None][:13]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(4)
    path = "file://" + str(tmp_path / "ids")
    token_orc.write_tokens(df, path, BPE, n_files=3)
    want = dict(zip([r[0] for r in rows], plain([r[1] for r in rows])))
    start, expected = 0, []
    for i in sorted(want):
        expected.append((i, start, len(want[i]), zlib.crc32(want[i].tobytes())))
        start += len(want[i])
    assert sorted(tuple(r) for r in token_orc.token_layout(spark, path).collect()) == expected
    assert len(list((tmp_path / "ids").glob("*.orc"))) > 1
    some = token_orc.read_tokens(spark, path, [4, 9])
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {i: want[i].astype(int).tolist() for i in (4, 9)}
    assert "PushedFilters: [In(doc_id, [4,9])]" in some._jdf.queryExecution().toString()


def test_token_files_of_nothing_and_repeats(spark, tmp_path):
    path = "file://" + str(tmp_path / "none")
    token_orc.write_tokens(none(spark), path, BPE)
    assert token_orc.token_layout(spark, path).collect() == []
    path = "file://" + str(tmp_path / "odd")
    token_orc.write_tokens(odd(spark), path, BPE, n_files=2)
    rows = token_orc.token_layout(spark, path).collect()
    assert len(rows) == len(odd_rows())
    stream = all_ids(spark, path)
    for r in rows:
        assert zlib.crc32(np.array(stream[r["start"] : r["start"] + r["n_tokens"]], "<u4").tobytes()) == r["ids_crc32"]


def all_ids(spark, path):
    """The ids of all files in the order of their numbers, as a plain reader meets them."""
    from pyarrow import orc

    out = []
    for f in sorted(Path(path.removeprefix("file://")).glob("part-*.orc"), key=lambda f: int(f.name.split("-")[1])):
        for ids in orc.ORCFile(str(f)).read(["ids"])["ids"].to_pylist():
            out += ids
    return out


def test_rows_that_repeat_an_id_start_where_the_file_has_them(spark, tmp_path):
    path = "file://" + str(tmp_path / "tokens")
    rows = [(1, "one"), (2, "a few more words here"), (2, "b"), (2, None), (2, "b"), (2, "and the last of them all"), (3, "three")]
    token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE, n_files=3)
    stream, got = all_ids(spark, path), token_orc.token_layout(spark, path).collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and zlib.crc32(np.array(stream[at : at + r["n_tokens"]], "<u4").tobytes()) == r["ids_crc32"]
        at += r["n_tokens"]
    assert at == len(stream) and [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [1, 2, 2, 2, 2, 2, 3]


def test_files_are_ordered_by_number(spark, tmp_path):
    parts = []
    for name, first in (("part-99999-x.snappy.orc", 1), ("part-100000-x.snappy.orc", 3)):
        one = tmp_path / name
        token_orc.write_tokens(spark.createDataFrame([(first, "a b c"), (first + 1, "d")], "doc_id long, text string"), f"file://{one}", BPE, n_files=1)
        parts.append(next(one.glob("*.orc")))
        (tmp_path / "all").mkdir(exist_ok=True)
        parts[-1].rename(tmp_path / "all" / name)
    rows = token_orc.token_layout(spark, f"file://{tmp_path}/all").orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4]


def records(spark, rows):
    return spark.createDataFrame(rows, warc.SCHEMA)


def test_revisits(spark):
    full = lambda i, url, ts, tag, body=b"x", **h: (i, "response", url, ts, 200, {"etag": tag, "content-type": "text/html", "content-length": "1", **h}, body)
    visit = lambda i, url, ts, **h: (i, "revisit", url, ts, 304, {k.replace("_", "-"): v for k, v in h.items()}, None)
    rows = [
        full("r1", "http://A.com/x/", 10, "one", b"first"), full("r2", "https://www.a.com:443/x?utm_source=q#f", 20, "two", b"second", date="old"), full("r3", "http://a.com/x", 20, "three", b"third"),
        visit("v1", "http://a.com/x", 15, etag="one", content_length="0", age="5"), visit("v2", "http://a.com/x/index.html", 30, etag="three"), visit("v3", "http://a.com/x", 10, etag="one"),
        visit("v4", "http://a.com/x", 99, etag="one"), visit("v5", "http://a.com/x", 99), visit("v6", "http://b.com/", 99, etag="one"), visit("v7", None, 99, etag="one"), visit("v8", "http://a.com/x", None, etag="one"),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(records(spark, rows), ranges=3).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "v1": "resolved", "v2": "resolved", "v3": "no earlier response", "v4": "validator mismatch", "v5": "no validator", "v6": "no earlier response", "v7": "no earlier response", "v8": "no earlier response",
    }
    assert bytes(got["v1"]["payload"]) == b"first" and got["v1"]["headers"] == {"etag": "one", "content-type": "text/html", "content-length": "1", "age": "5"}
    assert got["v2"]["response_id"] == "r3" and got["v4"]["payload"] is None
    assert warc.resolve_revisits(records(spark, [])).collect() == []


def test_keys_of_urls(spark):
    keys = {
        "http://A.com/x/": "a.com/x", "https://www.A.com:443/X?id=aB#f": "a.com/X?id=aB", "http://a.com/x?id=Ab": "a.com/x?id=Ab", "HTTP://user:pw@WWW.a.com:80/Index.html": "a.com/Index.html",
        "http://a.com/d/index.html?q=1": "a.com/d?q=1", "http://a.com/?utm_source=x&b=2&gclid=9": "a.com?b=2", "http://a.com/?ref=7": "a.com?ref=7", "a.com": "a.com", "": "", "http://a.com:8080/": "a.com:8080",
        "http://a.com/x?a=http://B.com/Y": "a.com/x?a=http://B.com/Y", "  http://a.com/p  ": "a.com/p",
    }
    df = spark.createDataFrame([(u, k) for u, k in keys.items()], "url string, want string").withColumn("got", warc.canonical_url(F.col("url")))
    assert [(r["url"], r["got"]) for r in df.collect()] == list(keys.items())


def test_odd_records(spark):
    full = ("r1", "response", "http://a.com/x", 1, 200, {"etag": "t"}, b"y" * 3_000_000)
    rows = [
        full, full, (None, "response", "http://a.com/x", 2, 200, {"etag": "t"}, b"unnamed"), ("r2", "response", None, 1, None, None, None), ("r3", "response", "", None, 200, {}, b""),
        *[(None, "revisit", "http://A.com/x/", 5, 304, {"etag": "t"}, None)] * 2, ("v1", "revisit", "http://a.com/x", 5, 304, None, None), ("v1", "revisit", "http://a.com/x", 1, 304, {"etag": "t"}, None),
        ("r4", "response", "http://h.com", 1, 200, None, b"z"), ("v2", "revisit", "http://h.com", 2, 304, {"etag": "t"}, None), (None, None, None, None, None, None, None), ("x", "other", "http://a.com/x", 3, 200, {}, b""),
    ]
    df = records(spark, rows).selectExpr("*", "1 as key", "'q' as hit", "2 as row")
    got = sorted((r["record_id"] or "", r["status"], r["response_id"] or "", len(r["payload"] or b"")) for r in warc.resolve_revisits(df).collect())
    assert got == [("", "resolved", "r1", 3_000_000)] * 2 + [("v1", "no earlier response", "", 0), ("v1", "no validator", "r1", 0), ("v2", "validator mismatch", "r4", 0)]


def test_as_of_matches_a_loop(spark):
    rng = random.Random(2)
    responses = [(rng.choice("abc"), rng.randrange(60), f"r{i:03}") for i in range(120)]
    revisits = [(rng.choice("abcd"), rng.randrange(70), f"v{i:03}") for i in range(120)]
    make = lambda rows: spark.createDataFrame(rows, "key string, ts long, record_id string")
    got = {r["record_id"]: r["hit"] for r in warc.as_of(make(revisits), make(responses), 8).collect()}
    for key, ts, ident in revisits:
        earlier = [(t, i) for k, t, i in responses if k == key and t < ts]
        assert got[ident] == (max(earlier)[1] if earlier else None)


def test_warc_files(spark, tmp_path):
    rows = [
        {"record_id": "<a>", "kind": "response", "url": "http://x/", "ts": 100, "status": 200, "headers": {"etag": "q"}, "payload": b"body\r\n\r\nmore"},
        {"record_id": "<b>", "kind": "revisit", "url": "http://x/", "ts": 200, "status": 304, "headers": {"etag": "q"}, "payload": None},
    ]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(map(warc.serialise_record, rows)))
    got = {r["record_id"]: r.asDict() for r in warc.read_warc(spark, str(tmp_path)).collect()}
    for r in rows:
        g = got[r["record_id"]]
        assert {k: g[k] for k in r if k != "payload"} == {k: r[k] for k in r if k != "payload"} and (bytes(g["payload"]) if g["payload"] else None) == r["payload"]
    assert [r["status"] for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()] == ["resolved"]


def test_large_and_cut_records(spark, tmp_path):
    """A block that holds the border of records itself, many records in one file, and a file that ends too early."""
    rows = [{"record_id": f"<{i}>", "kind": "response", "url": f"http://x/{i}", "ts": i, "status": 200, "headers": {"a": "b"}, "payload": b"x" * i + b"\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + bytes(range(256)) * 40} for i in range(200)]
    raw = b"".join(map(warc.serialise_record, rows))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(warc.serialise_record(r | {"record_id": r["record_id"] + "b"})) for r in rows[:3])[:-9000])
    read = warc.read_warc(spark, str(tmp_path))
    got = {r["record_id"]: bytes(r["payload"]) for r in read.where("issue is null").collect()}
    assert got == {r["record_id"]: r["payload"] for r in rows} | {r["record_id"] + "b": r["payload"] for r in rows[:2]}
    assert [(r["record_id"], r["issue"]) for r in read.where("issue is not null").collect()] == [("<2>b", "truncated")]
