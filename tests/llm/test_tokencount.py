import random

import public_tokenizers
from tokenizers import Tokenizer

from staywise.llm import queries, tokencount
from tests.llm.helpers import SF, clashing, docs_frame, documents

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "\n\t", "don't I'LL we've", "<|endoftext|>x<|startoftext|> <|endoftext| >", "É́ é ǅ İ ſ ﬁ", "a b\x1cc\x85d\xa0e", "́x e ́y",
       "中文 日本語 한국어", "123 4.5 ½ ٣", "_-=+!!!??", "\U0001f600\U0001f468‍\U0001f469", "\x00\x01\x7f", "a" * 3000, "﻿x", "''s''t"]


def test_documents_match_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    text = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    rows = queries.queries()["op7_tokencount"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = len(tok.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 2048)


def test_random_words_match_the_library():
    tok, c = Tokenizer.from_file(PATH), tokencount.Counter(PATH)
    rng = random.Random(5)
    vocab = sorted(v.replace("</w>", "") for v in tok.get_vocab() if "<|" not in v)
    words = ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    words += ["".join(rng.choice("aeinrsth'1") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    words += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xC0, 0x24F), rng.randint(0x300, 0x36F), rng.randint(0x4E00, 0x4E80)]))
                      for _ in range(rng.randint(1, 12))) for _ in range(3000)] + ODD
    for w in words:
        assert c.count(w.encode()) == len(tok.encode(w, add_special_tokens=False).ids), repr(w)


def test_chunk_maps_compose(monkeypatch):
    tok, c = Tokenizer.from_file(PATH), tokencount.Counter(PATH)
    rng = random.Random(6)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(tokencount, "CHUNK", size)
        for _ in range(60):
            t = "".join(rng.choice(["the ", "wörd", " ", "\n", "x", "<|endoftext|>", "é", "中"]) for _ in range(rng.randint(0, 25)))
            assert c.count(t.encode()) == len(tok.encode(t, add_special_tokens=False).ids), (size, t)


def test_edge_rows(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, None), (1, "x"), (1, "x"), (None, "some words"), (99, "der längste Text " * 20000)]
    got = tokencount.token_counts(clashing(docs_frame(spark, rows)), PATH).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    assert tokencount.token_counts(docs_frame(spark, []), PATH).collect() == []


def test_states_are_bounded():
    """Far more words than states: the machine forgets, also inside a word, and counts on."""
    tok, c = Tokenizer.from_file(PATH), tokencount.Counter(PATH, most_states=300)
    free = tokencount.Counter(PATH)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 25))) for _ in range(4000)] + ["".join(rng.choice("etaoin") for _ in range(5000))]
    for w in words:
        c.memo.clear()
        assert c.count(w.encode()) == free.count(w.encode())
        assert len(c.machine.states) == len(c.machine.number) == len(c.machine.step) == len(c.machine.last) <= 300
    assert len(free.machine.states) > 3000
    assert [free.count(w.encode()) for w in words[::50]] == [len(tok.encode(w, add_special_tokens=False).ids) for w in words[::50]]
