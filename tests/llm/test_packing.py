import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from epochal.llm.packing import pack, packed

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pack_places_each_id_once_with_little_padding():
    rng = random.Random(1)
    for lengths in ([], [1], [4096], [4097, 1], [rng.randrange(1, 9000) for _ in range(400)], [5] * 3000):
        pieces = defaultdict(list)
        sequences = defaultdict(list)
        for d, start, n, s, o in pack(lengths, 4096, 64):
            pieces[d].append((start, n))
            sequences[s].append((o, n))
        for d, total in enumerate(lengths):
            at = 0
            for start, n in sorted(pieces[d]):
                assert start == at and n > 0
                at += n
            assert at == total
        for cut in sequences.values():
            at = 0
            for o, n in sorted(cut):
                assert o == at
                at += n
            assert at <= 4096 and (at & (at - 1) == 0 or 4096 - at <= 64)


def test_rows_on_texts(spark):
    texts = [None, "", "Hello, World! It's 2024", "word " * 9000, "Hello, World! It's 2024"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string").coalesce(1)
    rows = packed(df, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        assert sum(m[1] for m in mine) == len(ids)
        for start, n, crc, total in mine:
            assert total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
    assert packed(df.limit(0), PATH).count() == 0


def check(texts, rows):
    """Pieces tile each text's ids, and sequences have no gap and little padding."""
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for start, n, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    for cut in sequences.values():
        at = 0
        for o, n in sorted(cut):
            assert o == at
            at += n
        assert at <= 4096 and (at & (at - 1) == 0 or 4096 - at <= 64)
