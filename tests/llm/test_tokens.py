"""Operators 3, 4 and 7: encoding, token files, packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from emberlane.llm import bpe, packing, rans
from tests.llm.tests_support import texts_of

RANKS, JSON = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_tiktoken_on_odd_characters(encoding):
    rnd = random.Random(5)
    alphabet = "".join(map(chr, [*range(0x180), *range(0x2000, 0x2040), 0x3000, 0x4E00, 0x1F600, 0x301, 0x660, 0x2160])) + " \n\t'"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(3000)]
    got = bpe.codec(RANKS).encode(texts)
    assert all(encoding.encode_ordinary(t) == bpe.ids_of(p).tolist() for t, p in zip(texts, got))
    assert all(bpe.codec(RANKS).decode(bpe.ids_of(p)) == t.encode() for t, p in zip(texts, got))


def test_op3_query(spark, sf_dir, encoding):
    want = texts_of(spark, sf_dir)
    rows = bpe.op3_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = encoding.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_op3_odd_rows_and_offsets(odd_docs, no_docs):
    assert bpe.round_trip(odd_docs, RANKS).count() == odd_docs.count()
    assert bpe.round_trip(no_docs, RANKS).count() == 0
    back = bpe.decode(bpe.encode(odd_docs, RANKS), RANKS).join(odd_docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.decoded == (r.text or "") for r in back)
    for text in ("héllo 漢字🙂", "a b"):
        c = bpe.codec(RANKS)
        ids = bpe.ids_of(c.encode([text])[0])
        begins, ends = c.offsets(text, ids)
        assert begins[0] == 0 and ends[-1] == len(text) and all(b < e for b, e in zip(begins, ends))


def json_ids(texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(JSON))
    return [[*e.ids, end] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_and_white_space_as_the_library_reads_them():
    rnd = random.Random(3)
    alphabet = [*"ab  \n\n\t.,'1\u00e9\u00a0\u3000\x85\x1c\u6f22!", "<|endoftext|>", "<|endoftext", " word", " word,"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 12))) for _ in range(5000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x" * 3000 + " <|endoftext|>\n\n"]
    own = Tokenizer.from_file(public_tokenizers.path(JSON))
    got = bpe.codec(JSON).encode(texts)
    assert all(bpe.ids_of(p).tolist() == e.ids for p, e in zip(got, own.encode_batch(texts, add_special_tokens=False)))
    assert bpe.codec(JSON).decode(bpe.ids_of(got[-4])) == b"<|endoftext|>"


def test_coder_round_trips_and_checks():
    rnd = np.random.default_rng(1)
    ids = np.minimum(rnd.zipf(1.3, 300_001), 50_000).astype(np.uint16)
    frequencies = rans.quantize(np.bincount(ids, minlength=50_257))
    assert frequencies.sum() == 1 << rans.SCALE
    coder = rans.Coder(frequencies)
    for n in (0, 1, 4095, 4096, 4097, 300_001):
        assert (coder.decode(coder.encode(ids[:n], [n]))[0] == ids[:n]).all()
    block = coder.encode(ids, [300_001])
    block = coder.encode(ids, [300_001], every=32)
    parts = [coder.decode(block, first=i, last=i + 1)[0] for i in range(3)]
    assert (np.concatenate(parts) == ids).all()
    broken = bytearray(block)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))


def test_op4_query(spark, sf_dir):
    want = texts_of(spark, sf_dir)
    keys = sorted(want)
    start, expected = 0, {}
    for k, ids in zip(keys, json_ids([want[k] for k in keys], 0)):
        expected[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.op4_rans_files(spark, sf_dir).collect()}
    assert got == expected


def test_op4_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        tokens = bpe.encode(docs, JSON)
        counts = rans.count_ids(tokens, 50_257)
        counts[0] += tokens.count()
        path = f"file://{tmp_path}/{name}"
        rans.write(tokens, rans.quantize(counts), path, end_id=0)
        rows = rans.read(spark, path).collect()
        assert len(rows) == docs.count()
        assert sum(r.n_tokens for r in rows) == counts.sum()


def test_differencing_levels_windows():
    rnd = random.Random(2)
    sizes = [rnd.randint(1, 900) for _ in range(300)]
    windows = packing.windows_of(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(300))
    assert max(sum(sizes[i] for i in w) for w in windows) <= 2048
    assert packing.difference([8, 7, 6, 5, 4], 2) and {sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)} == {14, 16}


def check_pieces(rows, expected):
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for k, parts in documents.items():
        ids, at = expected[k], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(documents) == set(expected)
    return sequences


def test_op7_query(spark, sf_dir):
    want = texts_of(spark, sf_dir)
    keys = sorted(want)
    sequences = check_pieces(packing.op7_packing(spark, sf_dir).collect(), dict(zip(keys, json_ids([want[k] for k in keys], 1))))
    sums = [sum(x for _, x in s) for s in sequences.values()]
    padding = sum(2048 - n for n in sums if n & (n - 1))
    assert padding < 0.05 * sum(sums)


def test_op7_odd_rows(odd_docs, no_docs):
    rows = packing.digests(packing.pack(odd_docs.where("doc_id <> 3"), JSON)).collect()
    docs = {r.doc_id: r.text or "" for r in odd_docs.where("doc_id <> 3").collect()}
    check_pieces(rows, dict(zip(docs, json_ids(list(docs.values()), 1))))
    assert packing.pack(odd_docs, JSON).where("doc_id = 3").count() == 2
    assert packing.pack(no_docs, JSON).count() == 0


def test_a_known_word_before_a_mark_is_not_encoded_again():
    import public_tokenizers

    own, seen = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json")), []
    model = own.model

    class Counted:
        def tokenize(self, match):
            seen.append(match)
            return model.tokenize(match)

    own.model = Counted()
    first = own.encode(["say zorblatt a, b. end"])
    assert own.encode(["say zorblatt, zorblatt. zorblatt"]) != first
    assert sum(m.endswith("zorblatt") for m in seen) == 1


@pytest.mark.parametrize("name", [JSON, RANKS])
def test_unknown_words_share_calls_of_the_library(name, encoding):
    """A call a word cost op4 and op7 more than their budget."""
    rnd = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz\u00e0\u00e9\u0120\u0430\u6f22"
    words = ["".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(5000)] + ["\u00e0", "\u0120", "\u0120a", "the", "x" * 2500]
    texts = [" ".join(rnd.choices(words, k=300)) + rnd.choice(["", ".", " ", "\n", "!\nend"]) for _ in range(60)] + ["qku wrt\t"]
    own = bpe.Codec(public_tokenizers.path(name))
    model, calls = own.model, []

    class Counted:
        def tokenize(self, match):
            calls.append(match)
            return model.tokenize(match)

    own.model = Counted()
    got = [bpe.ids_of(p).tolist() for p in own.encode(texts)]
    assert got == ([encoding.encode_ordinary(t) for t in texts] if name == RANKS else [ids[:-1] for ids in json_ids(texts, 0)])
    assert len(calls) < len(set(" ".join(texts).split())) / 3
    assert max(map(len, own.known)) <= bpe.LONGEST_PIECE


def test_words_beside_signs_and_line_feeds_share_calls_too():
    """A split by the pattern for each such piece cost op4 more than its budget."""
    rnd = random.Random(13)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(3, 9))) for _ in range(3000)]
    texts = ["\n".join(rnd.choice(words) + rnd.choice(["", "$$$", ".%", ",##", "'\""]) + f" {rnd.choice(words)}{'&' * rnd.choice([1, 2])}" for _ in range(100)) for _ in range(40)]
    texts += ["long " + "&" * 40 + " long" + "&" * 40]
    own = bpe.Codec(public_tokenizers.path(JSON))
    model, split, calls, splits = own.model, own.split, [], []

    class Counted:
        def tokenize(self, match):
            calls.append(match)
            return model.tokenize(match)

    def counted(piece):
        splits.append(piece)
        return split(piece)

    own.model, own.split = Counted(), counted
    assert [bpe.ids_of(p).tolist() for p in own.encode(texts)] == [ids[:-1] for ids in json_ids(texts, 0)]
    assert len(calls) < 200
    assert len(splits) < 20


@pytest.mark.parametrize("name", [JSON, RANKS])
def test_words_that_many_groups_hold_stay_known(name, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 60)
    monkeypatch.setattr(bpe, "CACHE_OTHERS", 5)
    rnd = random.Random(17)
    own, groups = bpe.Codec(public_tokenizers.path(name)), []
    model = own.model
    for _ in range(40):
        once = ["".join(rnd.choices("abcdefgh", k=8)) for _ in range(20)]
        groups.append(["so often " + " ".join(w + rnd.choice(["", "!", "!?", "9"]) for w in once) + ", often."])
    seen = []

    class Counted:
        def tokenize(self, match):
            seen.append(match)
            return model.tokenize(match)

    own.model = Counted()
    got = [bpe.ids_of(own.encode(g)[0]).tolist() for g in groups]
    texts = [g[0] for g in groups]
    assert got == ([encoding.encode_ordinary(t) for t in texts] if name == RANKS else [ids[:-1] for ids in json_ids(texts, 0)])
    assert sum(m.count("often") for m in seen) <= 2 and len(own.known) <= 60 + 21
