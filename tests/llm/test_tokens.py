import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tapeworks.llm import bpe, sstable

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
pytest.importorskip("public_tokenizers")
PIECES = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\r\n", "é", "ñ", "ß", " ", "　", "日本", "🙂", "!", "&&&", "%%", ")", "1", "23", "_", "<|", "<|endoftext|>", "\x1c", "\x85", "'ve", "Q", "×", "́", "​", " the", " The", "|", "Ñ", "İ", "Σ", "̸", "="]


def samples(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_byte_bpe_equals_the_library_on_odd_texts():
    codec = bpe.Codec(bpe.default_path())
    texts = samples(8000, 1)
    for text, raw in zip(texts, codec.encode([t.encode() for t in texts])):
        ids = np.frombuffer(raw, np.int32).tolist()
        assert ids == codec.library.encode(text, add_special_tokens=False).ids, ascii(text)
        assert codec.decode(ids).decode("utf-8", "replace") == codec.library.decode(ids, skip_special_tokens=False)


def test_cuts_lie_only_at_forced_pairs():
    codec = bpe.Codec(bpe.default_path())
    forced = bpe.forced_pairs(x for x in codec.pieces if x not in codec.special)
    for text in samples(500, 2):
        parts = codec.split(text.encode())
        assert b"".join(parts) == text.encode()
        assert all(forced[a[-1] * 256 + b[0]] for a, b in zip(parts, parts[1:]))


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(sstable, "REMEMBERED", 50)
    texts = [t.encode() for t in samples(600, 3)]
    codec, encoder = bpe.Codec(bpe.default_path()), sstable.Encoder(sstable.default_path(), 1)
    a = [x for i in range(0, 600, 7) for x in codec.encode(texts[i : i + 7])]
    b = [x for i in range(0, 600, 7) for x in encoder.encode(texts[i : i + 7])]
    monkeypatch.undo()
    assert a == bpe.Codec(bpe.default_path()).encode(texts) and b == sstable.Encoder(sstable.default_path(), 1).encode(texts)


def test_op3_digests_of_edge_cases(edge):
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in edge.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    found = bpe.digests(edge).collect()
    assert sorted(tuple(r)[1:] for r in found) == sorted(want) and bpe.digests(edge.limit(0)).count() == 0


def test_word_encoder_equals_the_library_on_odd_texts():
    encoder = sstable.Encoder(sstable.default_path(), 1)
    texts = samples(8000, 4)
    for text, raw in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(raw, np.uint16).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("shards", [1, 3])
def test_shards_of_edge_cases(edge, tmp_path, shards):
    library = Tokenizer.from_file(sstable.default_path())
    folder = f"file://{tmp_path}"
    manifest = sstable.write(edge, folder, shards=shards)
    found = sorted((tuple(r) for r in sstable.read(manifest, folder).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (doc_id, text), got in zip(rows, found, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert got == (doc_id, start, len(ids), struct.pack(f"<{len(ids)}I", *ids))
        assert zlib.crc32(got[3]) == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    for doc_id in (None, -7, 0, 6, 8):
        text = next(t for i, t in rows if i == doc_id)
        assert sstable.lookup(manifest, folder, doc_id).tolist() == library.encode(text or "", add_special_tokens=False).ids + [1]
    assert sstable.lookup(manifest, folder, 999) is None and sstable.lookup(manifest, folder, -99) is None


def test_no_rows_no_shards(edge, tmp_path):
    manifest = sstable.write(edge.limit(0), f"file://{tmp_path}")
    assert manifest.count() == 0 and sstable.read(manifest, f"file://{tmp_path}").count() == 0


def test_blocks_index_and_filter(tmp_path):
    writer = sstable.Writer(f"file://{tmp_path}", 4)
    values = {i: np.arange(i % 700, dtype="<u4") for i in range(-2000, 6000, 3)}
    for i, v in values.items():
        writer.add(sstable.key_of(i), v.tobytes())
    writer.close()
    reader = sstable.Reader(f"file://{tmp_path}", writer.name)
    assert len(reader.index) > 10 and reader.docs == len(values)
    assert [sstable.id_of(k) for k, _, _ in reader] == list(values)
    assert all((reader.find(i) == values[i]).all() for i in list(values)[::17])
    missing = [i for i in range(-2000, 6000) if i not in values]
    passed = sum(all(reader.bloom[p >> 3] >> (p & 7) & 1 for p in sstable.probes(sstable.key_of(i), reader.bits)) for i in missing)
    assert reader.find(-1999) is None and passed < 0.03 * len(missing)


def test_reading_drops_the_words_of_writing_and_passes_small_batches_on(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "HELD_IDS", 500, raising=False)
    writer = sstable.Writer(f"file://{tmp_path}", 2)
    for i in range(100):
        writer.add(sstable.key_of(i), np.full(90, i, "<u2").tobytes())
    writer.close()
    sstable._ENCODERS["a tokenizer", 1] = "and its words"
    batches = list(sstable.read_shards(f"file://{tmp_path}")([pa.RecordBatch.from_pydict({"name": [writer.name], "base": [7]})]))
    assert not sstable._ENCODERS and max(sum(b.column(2).to_pylist()) for b in batches) <= 500 + 90
    assert [x for b in batches for x in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)))] == [(i, 7 + 90 * i, 90) for i in range(100)]
