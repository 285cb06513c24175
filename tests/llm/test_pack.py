import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from staywise.llm import pack, queries
from tests.llm.helpers import SF, clashing, docs_frame, documents

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, got, capacity=2048):
    tok = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0] + [n for _, n in p])[:-1].tolist()
        assert sum(n for _, n in p) <= capacity
    return len(places), -(-sum(w[3] for w in want) // capacity)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    used, least = check(rows, queries.queries()["op5_pack"](spark, SF).collect())
    assert used <= least * 1.02 + 1


def test_edge_rows(spark):
    odd = "don't I'LL <|endoftext|>x <|startoftext|> É́ é ǅ İ  a b\x1cc ́x 中文 123 4.5 _ \U0001f600\U0001f468‍\U0001f469 '"
    rows = [(1, None), (2, ""), (3, odd), (3, odd), (None, "x"), (5, "wörter und " * 3000), (6, "a" * 30000), (7, "\n\t ")]
    check(rows, pack.packed(clashing(docs_frame(spark, rows)), PATH).collect())
    assert pack.packed(docs_frame(spark, []), PATH).collect() == []


def test_best_fit_takes_the_tightest_open_sequence():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 101, 2000).tolist(), reverse=True)
    seq, off = pack.best_fit(lengths, 100)
    room = []
    for n, s, o in zip(lengths, seq, off):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[s] == min(fits)
        else:
            assert s == len(room)
            room.append(100)
        assert o == 100 - room[s]
        room[s] -= n


def test_words_as_the_library_encodes_them():
    tok, mine = Tokenizer.from_file(PATH), pack.WordTokens(PATH)
    rng = np.random.default_rng(8)
    letters = list("abcdeiTZ") + [chr(c) for c in (*range(0xAA, 0x250), 0x300, 0x301, 0x345, 0x3A3, 0x3C2, 0x1E9E, 0x212B, 0xFB01)]
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) + "".join(rng.choice(list(".,!'<|>~-_"), rng.integers(0, 4))) for _ in range(6000)]
    words += [c + "b," for c in letters]
    for at in range(0, len(words), 50):
        for w, got in zip(words[at:at + 50], mine.encode([w.encode() for w in words[at:at + 50]])):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids, repr(w)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(pack, "MEMO_WORDS", 50)
    tok, mine = Tokenizer.from_file(PATH), pack.WordTokens(PATH)
    for k in range(40):
        t = " ".join(f"wo{chr(97 + (j * k) % 26)}rd{chr(97 + j)}." for j in range(20))
        assert np.frombuffer(mine.encode([t.encode()])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
        assert len(mine.memo) <= 50 and len(mine.parts) <= 60
