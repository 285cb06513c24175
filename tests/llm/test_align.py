import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from staywise.llm import align, queries
from tests.llm.helpers import SF, clashing, docs_frame, documents

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible}
    letters |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}

    def bytes_a(k):
        return bytes(letters[c] for c in t.id_to_token(k))

    def bytes_b(k):
        p = s.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if s.is_byte(k) else p.replace("▁", " ").encode()

    return (lambda x: t.encode(" " + x, add_special_tokens=False).ids), s.encode, bytes_a, bytes_b


def plain(docs):
    enc_a, enc_b, bytes_a, bytes_b = tools()
    rows, count = [], Counter()
    for doc, text in docs:
        a, b = (enc_a(text), enc_b(text)) if text else ([], [])
        want = b" " + (text or "").encode()
        if b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            rows.append((doc, [], [], [], []))
            continue
        at, ends_a, ends_b = 0, [], []
        for k in a:
            ends_a.append(at := at + len(bytes_a(k)))
        at = 0
        for k in b:
            ends_b.append(at := at + len(bytes_b(k)))
        common = sorted(set(ends_a) & set(ends_b))
        groups = [([k for k, e in zip(a, ends_a) if lo < e <= hi], [k for k, e in zip(b, ends_b) if lo < e <= hi])
                  for lo, hi in zip([0, *common], common)]
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in common]
        count.update(links)
        rows.append((doc, a, b, groups, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for doc, a, b, groups, links in rows:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    short = [(i, t) for i, t in docs if t is None or len(t) < 4000][:150]
    got = queries.queries()["op12_align"](spark, SF)
    assert dict(got.dtypes) == {c: "string" if c == "groups_sha256" else "bigint" for c in COLUMNS}
    assert got.count() == len(docs)
    assert result(align.alignment(docs_frame(spark, short).repartition(3), A, B)) == sorted(plain(short), key=repr)


ODD = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a\tb\r\nc\x00d"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"),
       (7, "▁x and ▁"), (8, "emoji 👩‍👩‍👧 naïve ﬁ é"), (None, "no id"), (3, " "), (9, "日本語のテキスト"), (9, "another text"),
       (10, "supercalifragilistic antidisestablishmentarianism"), (11, "﻿bom"), (12, "x" * 3000), (13, "!?" * 500), (14, "\x7f\x1b[0m")]


def test_odd_texts(spark):
    got = align.alignment(clashing(docs_frame(spark, ODD)), A, B)
    assert result(got) == sorted(plain(ODD), key=repr)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[7]["n_a"] == 0 and by_id[7]["groups_sha256"] == "" and by_id[6]["n_a"] > 0


def test_long_text_and_empty_table(spark):
    docs = [(1, " ".join(random.Random(1).choices(["alpha", "Übung", "42", "überaus-lang", "…"], k=60_000)))]
    assert result(align.alignment(docs_frame(spark, docs), A, B))[0][1] > 60_000
    assert align.alignment(docs_frame(spark, []), A, B).collect() == []
    assert align.alignment(docs_frame(spark, [(1, None)]), A, B).collect()[0]["n_links"] == 0


def test_groups_are_the_real_output(spark):
    rows = align.groups(docs_frame(spark, ODD), A, B).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r["group"]):
        text.setdefault(r["doc_id"], []).append(r)
    want = dict(ODD)
    for doc in (4, 6, 10, 12, 13):
        ends = [r["end"] for r in text[doc]]
        assert ends == sorted(set(ends)) and ends[-1] == 1 + len(want[doc].encode()) and [r["group"] for r in text[doc]] == list(range(len(ends)))
        assert [k for r in text[doc] for k in r["a"]] == tools()[0](want[doc]) and [k for r in text[doc] for k in r["b"]] == tools()[1](want[doc])


@pytest.mark.parametrize("seed", range(5))
def test_pointer_jumping_finds_components(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    cuts = [np.append(np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)), n) if n > 1 else np.array([1]) for _ in "ab"]
    if seed == 0:  # one long staircase: a single component of all tokens
        cuts = [np.append(np.arange(1, 4000, 2), 4000), np.append(np.arange(2, 4000, 2), 4000)]
    to_a, to_b = align.terminals(*cuts)
    common = np.intersect1d(*cuts)
    for ends, to in zip(cuts, (to_a, to_b)):
        assert (cuts[1][to] == common[np.searchsorted(common, ends)]).all()


def test_pairs_are_bounded_by_the_vocabularies(spark):
    assert align.pair_bound([b"a", b"ba", b"c", b""], [b"a", b"cba", b"a"]) == 2 + 1 + 2 + 1
    tool = align.aligner(A, B)
    bound = align.pair_bound(tool.first.bytes, tool.second.bytes)
    assert bound < 500_000
    assert 0 < align.pair_counts(align.linked(documents(spark), A, B)).count() < bound
