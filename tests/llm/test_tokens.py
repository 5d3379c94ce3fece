import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rulewright.llm import bpe, packing, pretok, queries, token_files
from rulewright.llm.lib_tokens import LibEncoder
from tests.conftest import DATA

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TRICKY = "ab'sdtmlrve \n\t\r\x0b\x85\xa0 '12²½.,!?é漢́ßÀİŉǅ–’\x00\x1c😀"
TEXTS = [None, "", " ", "'s", "''s", " 's", "don't I'll we've", "a  b\n\n c ", "\n\n", "x" * 5000, "<|endoftext|>", "a <|endoftext|> b", "<|EndOfText|><|startoftext|>x", "<| endoftext|>", " ".join(["word"] * 3000), "ábc"]


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(alphabet=TRICKY, max_size=25), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_split_is_the_pattern(texts):
    pieces, counts, starts = pretok.split(texts, "byte")
    want = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and pieces == [p for w in want for p in w]
    assert starts.tolist() == [m.start() for t in texts for m in regex.finditer(public_tokenizers.PATTERN, t)]


@given(st.binary(min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_merging_is_the_librarys(data):
    v = bpe.vocabulary(open(RANKS, "rb").read())
    enc = tiktoken.Encoding("own2", pat_str=r"[\s\S]+", mergeable_ranks=v.ranks, special_tokens={})
    assert bpe.merge_piece(data, v.ranks) == enc._core_bpe.encode_single_piece(data)


def test_the_cache_makes_room_without_changing_ids(reference, ranks):
    small = pretok.TextEncoder(lambda ps: [bpe.merge_piece(p.encode(), ranks) for p in ps], "byte", limit=50)
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(3)) for _ in range(40)) for _ in range(3)]
        ids, lens = small(texts)
        assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]
    assert len(small.cache.index) <= 400


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(name):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    ours = LibEncoder(open(public_tokenizers.path(name), encoding="utf-8").read())
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, lens = ours(texts)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def _documents(spark):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(3, "again", 0), (None, "no id", 1)], "doc_id long, text string, ids int")


def test_encode_and_decode(spark, reference):
    docs = _documents(spark)
    encoded = bpe.encode_documents(docs, RANKS)
    rows = sorted((r["ids"], bytes(r["decoded"])) for r in bpe.decode_documents(encoded, RANKS).collect())
    texts = [t or "" for t in TEXTS] + ["again", "no id"]
    assert rows == sorted((reference.encode_ordinary(t), t.encode()) for t in texts)
    v = bpe.vocabulary(open(RANKS, "rb").read())
    r = encoded.where("text_len > 5").first() if "text_len" in encoded.columns else encoded.where("size(ids) > 100").first()
    ids, offsets = np.array(r["ids"]), np.array(r["offsets"])
    assert bpe.decode_ids(ids, offsets, v, 3, 7) == bpe.decode_ids(ids, offsets, v)[offsets[3] : offsets[7]]
    with pytest.raises(ValueError):
        bpe.decode_ids(ids, offsets * 2, v)
    assert bpe.encode_documents(docs.limit(0), RANKS).count() == 0


def test_op2_is_the_library(spark, reference, tmp_path):
    _documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    for r in queries.op2_byte_bpe(spark, str(tmp_path)).collect():
        text = rows[r["doc_id"]]["text"] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.data())
@settings(max_examples=100, deadline=None)
def test_packing_bits(bits, ids, data):
    ids = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_files.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()


def test_token_files(spark):
    docs = _documents(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(docs, path, 49_408)
    got = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: -1 if x is None else x)
    assert got[0]["doc_id"] is None and len(got) == len(TEXTS) + 2
    at, texts = 0, {i: t or "" for i, t in enumerate(TEXTS)}
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        if r["doc_id"] not in (None, 3):
            assert r["ids"][:-1] == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        at += r["n_tokens"]
    row = manifest.orderBy("n_tokens", ascending=False).first()
    with open(row["path"], "rb") as f:
        f.size = lambda: __import__("os").path.getsize(row["path"])
        reader = token_files.TokenReader(_Sized(row["path"]))
        whole = reader.tokens(0, reader.n_tokens)
        assert reader.bits == 16 and reader.tokens(5000, 5003).tolist() == whole[5000:5003].tolist() if reader.n_tokens > 5003 else True
    empty = token_files.write_token_files(docs.limit(0), path, 49_408)
    assert token_files.read_token_files(spark, empty).count() == 0


class _Sized:
    def __init__(self, path):
        self.f = open(path, "rb")

    def size(self):
        return self.f.seek(0, 2)

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        return self.f.read(n)


def brute_rounds(sizes, capacity):
    """The sequences, as sorted sizes, of rounds in which single documents take single gaps, one after the other."""
    bounds = sorted({capacity // p for p in (1, 2, 3, 4, 5, 6, 7, 8, 16, 32, 64, 128, 256, 512, 1024)} - {0})
    left, held = sorted(sizes, reverse=True), []
    while left:
        high = min(b for b in bounds if b >= left[0])
        low = max((b for b in bounds if b < high), default=0)
        gaps = sorted((capacity - sum(x), i) for i, x in enumerate(held))
        here, last, made, wait, orphans = None, None, 0, [], []
        for d in left:
            if d != last:
                if here is not None:
                    made, here = max(made, capacity - sum(held[here])), None
                if d <= low or wait or (d * 10 >= capacity and made >= 5 * d):
                    wait.append(d)
                    continue
                last = d
            if here is None or capacity - sum(held[here]) < d:
                if here is not None:
                    made = max(made, capacity - sum(held[here]))
                k = next((k for k, g in enumerate(gaps) if g[0] >= d), None)
                if k is None:
                    orphans.append(d)
                    here = None
                    continue
                here = gaps.pop(k)[1]
            held[here].append(d)
        stopped = any(d > low for d in wait)
        if orphans and not stopped:
            held += [[] for _ in range(-(-len(orphans) // (capacity // orphans[0])))]
        left = sorted(orphans + wait, reverse=True)
    return sorted(sorted(x) for x in held)


def best_fit_decreasing(sizes, capacity):
    rooms = []
    for d in sorted(sizes, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= d), key=rooms.__getitem__, default=None)
        if k is None:
            rooms.append(capacity - d)
        else:
            rooms[k] -= d
    return len(rooms)


@pytest.mark.parametrize("capacity, largest, n", [(10, 10, 300), (64, 30, 400), (1024, 1024, 300)])
def test_rounds_are_single_document_best_fit(spark, capacity, largest, n):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, largest) for _ in range(n)]
    counts = spark.createDataFrame([(s, sizes.count(s)) for s in set(sizes)], "length int, n long")
    held: dict = {}
    for r in packing.place_runs(counts, capacity).collect():
        for k in range(r["n"]):
            held.setdefault(r["sequence"] + k // r["each"], []).append((capacity - r["room"] + k % r["each"] * r["size"], r["size"]))
    for places in held.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(held) == list(range(len(held)))
    assert sorted(sorted(size for _, size in x) for x in held.values()) == brute_rounds(sizes, capacity)
    assert len(held) <= best_fit_decreasing(sizes, capacity) + 2


def test_few_sequences(spark):
    packed = queries.op8_best_fit_packing(spark, f"{DATA}/sf0.01")
    assert packed.select("sequence_id").distinct().count() <= 964


def test_op3_is_the_library(spark, tmp_path):
    _documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    lib, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(texts):
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op3_token_files(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_pieces():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(0, 4) == []


def test_packing_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _documents(spark)
    packed = packing.pack_documents(docs, path, end_id=2, capacity=16, with_ids=True).persist()
    rows = packed.collect()
    lib = Tokenizer.from_file(path)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 16
    for i, t in enumerate(TEXTS):
        if i != 3:
            mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
            assert [x for r in mine for x in r["ids"]] == [*lib.encode(t or "", add_special_tokens=False).ids, 2]
            assert [r["piece"] for r in mine] == list(range(len(mine)))
    sequences = packing.assemble_sequences(packed)
    assert sequences.count() == len(by) and max(len(r["ids"]) for r in sequences.collect()) <= 16
    assert packing.pack_documents(docs.limit(0), path).count() == 0
