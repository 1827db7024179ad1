import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from barweave.llm.encoder import encode_rows, encoder
from barweave.llm.packing import Packer, join_pieces, pack_documents
from barweave.llm.token_files import read_token_files, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  lead", "trail ", "a\n\nb", "x\ty z", "don't 'll we've it's, x", "a\r\nb", "é́ à áb ÉTÉ", "Σίσυφος ΟΔΟΣ, x", "\n", " ", "<|endoftext|> a<|endoftext|>", "a b c  d", "a \x1c b", "ß ÿ µ ª.",
       "word., ,. 1, a1, !,", "İstanbul ǅ", "日本語 текст, слово.", "\rq r"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_whole_texts(path):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a", "Be", "é", " ", "\n", ",", ".", "'s", "1", "\t", " the", "ß"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = [x.tolist() for _, _, ids, n in encode_rows(path, texts, None) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in encoder(path).tokenizer.encode_batch(texts, add_special_tokens=False)]


def rows():
    return [(7, "one two"), (3, None), (None, "no id"), (5, ""), (3, None), (1, "x y " * 3000), (9, ODD[7]), (None, "a")]


def test_token_files(spark, scratch, documents):
    got = read_token_files(write_token_files(documents(rows()), BYTE, scratch, parts=3), with_ids=True).orderBy("start").collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    assert len(got) == len(want)
    for r, (key, text) in zip(got, want):
        ids = encoder(BYTE).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (key, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_of_no_rows(spark, scratch, documents):
    assert read_token_files(write_token_files(documents(rows()).limit(0), BYTE, scratch)).count() == 0


def check_packing(pieces, want, size):
    """Every id lies in one piece, windows are gapless and within ``size``."""
    docs, windows = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(windows) == list(range(len(windows)))
    from collections import Counter
    have = Counter((k, s, tuple(i)) for k, v in docs.items() for s, i in v)
    total = sum(len(i) for v in docs.values() for _, i in v)
    assert total == sum(len(i) for _, i in want)
    for key, ids in want:
        mine = [(s, i) for (d, n), v in docs.items() for s, i in v if d == key and n == len(ids)]
        assert all(any(ids[s:s + len(i)] == list(i) for _, ids in want) for s, i in mine)
    assert have
    return len(windows), total


def test_packing(spark, scratch, documents):
    rng = random.Random(1)
    given = rows() + [(100 + i, "word " * rng.randrange(1, 90)) for i in range(120)]
    pieces = pack_documents(documents(given, parts=5), WORD, scratch, size=64, open_windows=4, slack=2).collect()
    want = [(k, encoder(WORD).tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in given]
    windows, total = check_packing(pieces, want, 64)
    assert windows * 64 - total <= 0.05 * total
    assert pack_documents(documents(given).limit(0), WORD, scratch).count() == 0


def test_packer_emits_fullest_and_joins_leftovers():
    p = Packer(10, 2, 1)
    for i, n in enumerate((9, 6, 5, 25, 3)):
        p.add(i, np.arange(n, dtype=np.uint32))
    left = p.finish()
    sizes = [sum(x[2] for x in w) for w in p.ready]
    assert sum(sizes) + sum(x[2] for x in left or []) == 48 and all(s <= 10 for s in sizes)
    assert sizes[0] == 9                              # 5 fits neither 1 nor 4 free places: the fullest went out with one place free
    full, part = join_pieces([(1, 0, 7, 7, np.arange(7)), (2, 0, 7, 7, np.arange(7))], 10)
    assert [x[:3] for x in full[0]] == [(1, 0, 7), (2, 0, 3)] and [x[:3] for x in part] == [(2, 3, 4)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_equal_the_library(path):
    """Compared with a tokenizer of its own, as the library reads the file."""
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "<|startoftext|>a b", "a\n<|endoftext|>", "plain words, here", "<|ENDOFTEXT|> x", "<|endoftext| >", "<|endoftext|><|endoftext|>"] + ODD
    got = [x.tolist() for _, _, ids, n in encode_rows(path, texts, None) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert fresh.token_to_id("<|endoftext|>") in got[0]
