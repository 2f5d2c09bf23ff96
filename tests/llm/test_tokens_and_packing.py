import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from formlake.llm import packing, rans  # noqa: E402
from formlake.llm.tokens import TextEncoder  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", "\t", "a", "B", "é", "é", "́", "'s", "don't", "<|endoftext|>", "<|startoftext|>", "1", "23", "²", "ª", "_", "-", "!", "...", "ß", "Σ", "ΑΣ", "中", "\U0001f600", "\r\n", "\x1c", "\x85", "x.", "İ", "ﬁ", "word", "Word,"]


def library_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path), TextEncoder(path, limit=50)
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


PLAIN = [" ", "  ", "\n", "\t", "a", "B", "é", "É", "ß", "÷", "×", "'s", "'S", "don't", "'ll", "1", "234", "_", "-", "!", "...", "\r\n", "x.", "word", "Word,", " the", "<", "|>", "<|endoftext|>", "ÿ", "Ñandú", "'"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_plain_texts_equal_the_library(path):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path), TextEncoder(path, limit=50)
    rng = random.Random(2)
    for _ in range(8000):
        text = "".join(rng.choice(PLAIN) for _ in range(rng.randrange(20)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_rows_of_one_id_have_one_order(spark):
    rows = [(k // 4 if k % 3 else None, f"text {k} " * (k % 7)) for k in range(80)]
    seen = []
    for parts in (2, 3):
        docs = spark.createDataFrame([(str(a) if a is not None else None, t) for a, t in rows], "doc_id string, text string").repartition(parts + 2)
        path = rans.new_token_file(spark)
        rans.write_token_file(docs, path, BYTES, end_id=2, parts=parts)
        seen.append(sorted((r["start"], r["doc_id"], r["ids"]) for r in rans.read_token_file(spark, path).collect()))
    assert seen[0] == seen[1]


def test_rans_round_trip_checkpoints_and_damage():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, size=200_000) % 50_257
    sizes = [1, 2, rans.LANE, rans.LANE + 1, rans.BLOCK, 30_000, *rng.integers(1, 3000, 20)]
    blocks = [b.astype(np.uint16) for b in np.split(ids, np.cumsum(sizes))[:-1]]
    seen, n = np.unique(np.concatenate(blocks), return_counts=True)
    freq = rans.frequency_table(seen, n.astype(float), 50_257)
    assert freq.sum() == 1 << rans.SCALE and (freq[seen] > 0).all()
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    coded = rans.encode_blocks(blocks, freq)
    assert all((a == b).all() for a, b in zip(rans.decode_blocks(coded, freq, symbol), blocks, strict=True))
    lanes = rans.BLOCK // rans.LANE
    assert (rans.decode_blocks([coded[4]], freq, symbol, checkpoint=1)[0] == blocks[4][rans.CHECK * lanes :]).all()
    broken = bytearray(coded[5])
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks([bytes(broken)], freq, symbol)


def test_token_file_on_odd_rows(spark, odd, odd_rows, empty, monkeypatch):
    path = rans.new_token_file(spark)
    rans.write_token_file(odd, path, BYTES, end_id=2, parts=3)
    rows = sorted(rans.read_token_file(spark, path).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0] + [len(r["ids"]) // 4 for r in rows])[:-1].tolist()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 2, 3, 4, 6, 7, 8, 9]
    want = sorted([r[0] or 0, *library_ids(BYTES, r[1]), 2] for r in odd_rows)
    assert sorted([r["doc_id"] or 0, *np.frombuffer(r["ids"], "<u4").tolist()] for r in rows) == want
    path = rans.new_token_file(spark)
    rans.write_token_file(empty, path, BYTES, end_id=2)
    assert rans.read_token_file(spark, path).count() == 0


@pytest.mark.parametrize("fan_in", [1024, 2])
def test_packing_on_odd_rows(spark, odd, odd_rows, empty, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rows = packing.pack(odd.repartition(5), WORDS, end_id=1, window=64, open_windows=4).collect()
    sequences: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append(r)
    fills = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        fills.append(sum(p["length"] for p in pieces))
    short = [f for f in fills if f != 64]
    assert max(fills) <= 64 and all(f & (f - 1) == 0 for f in short) and len(short) <= 6
    want = {}
    for r in odd_rows:
        want.setdefault(r[0], []).append([*library_ids(WORDS, r[1]), 1])
    for doc, texts in want.items():
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, texts))
        if len(texts) == 1:
            ids = np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist()
            assert ids == texts[0] and {r["doc_tokens"] for r in own} == {len(ids)}
    assert packing.pack(empty, WORDS, end_id=1).count() == 0


def test_packer_space_is_bounded():
    closed = []
    p = packing.Packer(100, 5, closed.append)
    rng = random.Random(0)
    for doc in range(2000):
        p.add((doc, 0, b"\1\0\0\0" * rng.randrange(1, 250), 0))
        assert len(p.open) <= 5
    assert all(sum(len(x[2]) for x in c) == 400 for c in closed)
    assert zlib.crc32(b"") == 0


def test_plain_texts_by_bytes():
    from formlake.llm import tokens

    for c in [chr(k) for k in range(0x3000)] + ["\U0001f600", "\ud800"]:
        for text in (c, "ab " + c + " cd"):
            assert tokens._plain(text) == bool(tokens._PLAIN.fullmatch(text)), repr(text)
    assert tokens._plain("")


def test_unseen_parts_are_those_of_the_library():
    import public_tokenizers

    from formlake.llm import tokens

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = tokens.TextEncoder(public_tokenizers.path(name))
        for text in (" the", "the zyxwv", "  two", " <|endoftext|> x", "a <|EndOfText|>", " 12", " caf\u00e9 nai\u0308ve", "\tx", " ", "it's a'll", " A" * 90):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc._library.encode(text, add_special_tokens=False).ids, text


def test_many_texts_at_once_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    from formlake.llm import tokens

    library, drawn = Tokenizer.from_file(BYTES), random.Random(5)
    pieces = [*PLAIN, *"aZé07'\"-. \t\n\rx", "'re", "'ve", "\n\n", " '", "''", "é" * 40, "unsurprisingly" * 2]
    texts = ["".join(drawn.choices(pieces, k=drawn.randint(0, 25))) for _ in range(2000)] + ["", None, "=" * 5000, "漢 字"]
    held = TextEncoder(BYTES, limit=300)
    for at in range(0, len(texts), 400):  # the table starts anew in between
        for text, ids in zip(texts[at : at + 400], held.encode_all(texts[at : at + 400], 2), strict=False):
            assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text
    for text in texts[:1500]:
        if text and tokens._plain(text):
            signs = b"\0" + text.encode("latin-1") + bytes(3)
            cuts = tokens.part_starts(np.frombuffer(signs, np.uint8))[1:-2]
            assert [signs[a:b].decode("latin-1") for a, b in zip(cuts, cuts[1:], strict=False)] == tokens._WITH_BLANKS.findall(text)
