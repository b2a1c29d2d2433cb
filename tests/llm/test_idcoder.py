import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epochal.llm import idcoder
from epochal.llm.idcoder import decode_blocks, encode_blocks, read_ids, write_ids
from epochal.llm.tokens import WordIds

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("ids", [[], [0], [65535] * 3000, [70000, 1, 2**32 - 1], list(range(5000)), list(np.random.default_rng(3).zipf(1.3, 7000) % 50257)])
def test_blocks_round_trip(ids):
    got = decode_blocks(encode_blocks(np.array(ids, np.uint32)))
    assert got.tolist() == [int(x) for x in ids]


def test_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    blocks = encode_blocks(ids)
    assert decode_blocks(blocks[1:2]).tolist() == ids[2048:4096].tolist()
    assert sum(map(len, blocks)) < 2 * len(ids) * 0.8
    bad = bytearray(blocks[0])
    bad[60] ^= 255
    with pytest.raises(ValueError):
        decode_blocks([bytes(bad)])


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_ids_equal_the_tokenizer(name, spaces):
    rng = random.Random(4)
    bits = ["a", "Hello", "don't", "été", ",", "\u0958", "\u0130", " clé", " mot", " İx", "x.", " ", " ", " ", "\n", "\n", "\t", " ", "1234", "<|endoftext|>", "...", "日本", "\x1c", "\r", "x  y", "ΑΣ", "é"]
    texts = ["", "a\n\nb", "\n\nb", "b\n\n", "a\n\n\nb", " a", "a "] + ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(3000)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    assert [x.tolist() for x in WordIds(public_tokenizers.path(name), spaces).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_files_round_trip(spark):
    docs = [(7, "some words here", 1), (3, None, 1), (5, "", 1), (9, "long text. " * 3000, 1), (3, "same id", 1), (3, "same id", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int").repartition(3)
    got = [tuple(r) for r in read_ids(spark, write_ids(df, BPE, row_ids=2000)).collect()]
    t = Tokenizer.from_file(BPE)
    want, start = [], 0
    for doc_id, text, _ in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        ids = np.array([*t.encode(text or "").ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got) == sorted(want)
    assert read_ids(spark, write_ids(df.where("false"), BPE)).count() == 0


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_of_letters_equal_the_tokenizer(name, spaces):
    rng = random.Random(5)
    letters = "abcdefghéêαΣσдьщ日本ñßÅ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(900)) + (" ok क़" if i % 2 else "") for i in range(8)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    assert [x.tolist() for x in WordIds(public_tokenizers.path(name), spaces).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


class Asked:
    """A tokenizer that counts the characters that it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode(self, text, **options):
        self.n += len(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.n += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_letters_go_to_the_merges_alone():
    """The search for pieces, half of what a new word cost, is left to other words."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijéèçàüñßœщьжщαω", k=rng.randrange(1, 12))) for _ in range(3000)]
    texts = ["Start " + " ".join(w + rng.choice(["", "", ".", ",", "\nStart"]) for w in rng.choices(words, k=400)) for _ in range(40)]
    words = WordIds(BPE, True)
    words.tokenizer = asked = Asked(words.tokenizer)
    t = Tokenizer.from_file(BPE)
    assert [x.tolist() for x in words.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert asked.n < sum(map(len, texts)) // 5


def test_marks_are_not_asked_with_each_word():
    """New words that marks stand beside are asked as those of letters are, and the marks once."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijéèçàüñßœщьжщαω", k=rng.randrange(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choice(["", "(", "[", "--"]) + w + rng.choice([".", "###", ").", ",!!", ";"]) for w in rng.choices(words, k=400)) for _ in range(40)]
    words = WordIds(BPE, True)
    words.tokenizer = asked = Asked(words.tokenizer)
    t = Tokenizer.from_file(BPE)
    assert [x.tolist() for x in words.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert asked.n < sum(map(len, texts)) // 100


def test_words_cut_at_marks_equal_the_tokenizer():
    rng = random.Random(8)
    bits = [*"abAZ09'.,;!?([-_/&#", "'s", "'re", "é", "×", "÷", "ª", "ı", "Ԯ", "Ա", "א", "日", "—", "’", "²", "٣", "́", "​", "\x00", "\x7f", " ", " ", "é's"]
    texts = [rng.choice([" ", "\n", " "]).join("".join(rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += [f"x{c}, {c}y {c}. ({c} z.{c}{c}-{c}\n{c}" for c in map(chr, range(0x80, 0x800))]
    t = Tokenizer.from_file(BPE)
    assert [x.tolist() for x in WordIds(BPE, True, most=3000).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_known_words_are_forgotten_beyond_a_number():
    texts = [" ".join(f"w{i}x{k}" for i in range(30)) for k in range(20)]
    words = WordIds(BPE, True, most=100)
    t = Tokenizer.from_file(BPE)
    for _ in range(2):
        for text in texts:
            assert words.encode([text, "", text])[2].tolist() == t.encode(text, add_special_tokens=False).ids


def test_new_ids_cost_their_bits_and_seen_ones_less():
    ids = np.random.default_rng(2).permutation(50_000).astype(np.uint32)
    new, again = (sum(map(len, encode_blocks(x))) for x in (ids, np.tile(ids[:500], 100)))
    assert new < 2.3 * len(ids) and again < 1.3 * len(ids)


def test_seen_ids_cost_the_bits_of_the_numbers_of_a_block():
    """Ids of 60,000 kinds, of which a block has 200: eight bits tell which, whatever the ids."""
    ids = np.random.default_rng(4).permutation(60_000)[:200].astype(np.uint32)[np.random.default_rng(5).integers(0, 200, 1 << 17)]
    blocks = encode_blocks(ids)
    assert decode_blocks(blocks).tolist() == ids.tolist()
    assert sum(map(len, blocks)) < 1.3 * len(ids)


def test_a_few_blocks_are_not_coded_alone(monkeypatch):
    """A row of the files has a few blocks more than go side by side, and each of 2048 steps costs as much for them."""
    coded = []
    for name in ("encode_lanes", "decode_lanes"):
        monkeypatch.setattr(idcoder, name, lambda x, *a, f=getattr(idcoder, name): coded.append(1) or f(x, *a))
    ids = np.arange(idcoder.BLOCK * (idcoder.LANES + 1), dtype=np.uint32) % 1000
    blocks = encode_blocks(ids)
    assert len(coded) <= 2
    coded.clear()
    assert np.array_equal(decode_blocks(blocks), ids)
    assert len(coded) == 1


def test_impossible_headers_are_refused():
    block = bytearray(encode_blocks(np.arange(50, dtype=np.uint32))[0])
    for at, value in ((4, 7), (10, 255)):
        bad = bytearray(block)
        bad[at] = value
        with pytest.raises(ValueError):
            decode_blocks([bytes(bad)])


def test_ids_that_nothing_predicts_cost_what_their_frequencies_tell():
    """No order but 0 knows ids that follow each other by chance; frequent ones cost a few bits all the same."""
    p = 1 / np.arange(1, 151) ** 1.6
    p /= p.sum()
    ids = (300 + 7 * np.random.default_rng(9).choice(150, 1 << 17, p=p)).astype(np.uint32)
    blocks = encode_blocks(ids)
    assert np.array_equal(decode_blocks(blocks), ids)
    assert 8 * sum(map(len, blocks)) < 1.25 * len(ids) * -(p * np.log2(p)).sum()


def test_new_ids_cost_what_their_leading_bits_tell():
    """Ids of eight bits that come once a block: 16 bits each, and no fewer, where they aren't coded."""
    ids = np.concatenate([np.random.default_rng(k).permutation(256)[:200] for k in range(64)]).astype(np.uint32)
    blocks = [b for k in range(0, len(ids), 200) for b in encode_blocks(ids[k : k + 200])]
    assert np.array_equal(decode_blocks(blocks), ids)
    assert 8 * sum(map(len, blocks)) < 12.5 * len(ids)


@pytest.mark.parametrize("bits", [16, 32])
def test_many_kinds_of_blocks_side_by_side(bits):
    rng = np.random.default_rng(bits)
    most = 1 << bits
    kinds = [np.full(2048, most - 1), rng.integers(0, most, 2048), rng.integers(0, 3, 2048), np.arange(2048), rng.zipf(1.2, 2048) % most, np.repeat(rng.integers(0, most, 32), 64), np.tile(rng.integers(0, most, 64), 32), np.exp(rng.uniform(0, np.log(most), 2048)).astype(np.int64) % most]
    ids = np.concatenate([kinds[k] for k in rng.integers(0, len(kinds), 150)] + [rng.integers(0, most, 77)]).astype(np.uint32)
    blocks = encode_blocks(ids)
    assert np.array_equal(decode_blocks(blocks), ids)
    order = rng.permutation(len(blocks))
    assert np.array_equal(decode_blocks([blocks[i] for i in order]), np.concatenate([ids[i * 2048 : (i + 1) * 2048] for i in order]))
