import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from omiclattice.llm import packing, token_files, tokens, wordpiece
from omiclattice.llm.storage import shared_folder

PATH = tokens.tokenizer_path()


def plain():
    t = Tokenizer.from_file(PATH)
    return t


def test_encoder_equals_the_tokenizer(monkeypatch):
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", " a b ", "\n a", "x\x1c y", "<|endoftext|> a <|endoftext|>", "don't  we'll", "a  b", "a  b", "é 漢 \U0001f600 x"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab .'\n\t 1é　-") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    monkeypatch.setattr(tokens, "REMEMBER", 50)
    enc = tokens.Encoder(PATH)
    for i in range(0, len(texts), 20):
        part = texts[i:i + 20]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in plain().encode_batch(part, add_special_tokens=False)]
        assert enc.encode(part) == want


def test_token_files_round_trip(spark, odd_docs, no_docs):
    folder = shared_folder(spark)
    folder = folder if folder.startswith("file:") else f"file://{folder}"
    got = token_files.read_shards(token_files.write_shards(odd_docs, folder, PATH, 2), folder, with_ids=True).orderBy("start").collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    want = sorted((r.doc_id or 0, tuple(plain().encode(r.text or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    folder = f"{folder}-none"
    assert token_files.read_shards(token_files.write_shards(no_docs, folder, PATH, 2), folder).count() == 0


def check_packing(got, docs, size):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for r in docs:
        ids = np.array(plain().encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        rows = sorted(by_doc[r.doc_id], key=lambda x: x.piece)
        first = len(ids) % size or min(size, len(ids))
        starts = [0, *range(first, len(ids), size)]
        assert {(x.piece, x.start) for x in rows} == set(enumerate(starts))
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start:x.start + x.length].tobytes()) for x in rows)
    return len(by_sequence)


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, PATH, size=64).collect()
    check_packing(got, odd_docs.collect(), 64)
    assert sum(r.doc_id == 2 for r in got) == 2 * sum(r.doc_id == 1 for r in got)
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_packing_uses_few_sequences(spark, sf="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cut = packing.pieces(docs, PATH)
    got = packing.pack(cut, per_shard=64).collect()
    used = check_packing(got, docs.collect(), 2048)
    assert used <= 1.15 * -(-sum(r.length for r in got) // 2048)


def test_crossover_keeps_a_packing_valid():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300)
    pool = []
    for _ in range(2):
        where = np.zeros(300, np.int64)
        packing.best_fit(lengths.tolist(), rng.permutation(300).tolist(), where, {}, 100, 0)
        pool.append(where)
    for _ in range(30):
        child = packing.crossover(*pool, lengths, 100, rng)
        assert np.bincount(child, lengths).max() <= 100 and len(child) == 300
        pool = [child, pool[0]]
    assert packing._score(packing.evolve(lengths, 100, 5, pool), lengths, 100) <= packing._score(pool[0], lengths, 100)


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(200):
        letters = [b"a", b"b", b"c", b"d"][:rng.randint(2, 4)]
        word = lambda lo, hi: b"".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
        pieces = {word(1, 5) for _ in range(rng.randint(1, 12))} | {b" " + word(0, 4) for _ in range(5)}
        automaton = wordpiece.Automaton(sorted(pieces))
        for _ in range(40):
            w = word(1, 12)
            s, i, n = b" " + w, 0, 0
            while i < len(s) and n >= 0:
                j = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), None)
                i, n = (j, n + 1) if j else (i, -1)
            assert automaton.count(w) == n


def test_token_counts(spark, odd_docs, no_docs):
    pieces = set(wordpiece.byte_pieces(PATH))

    def greedy(word):
        s, i, n = b" " + word, 0, 0
        while i < len(s):
            i = next(j for j in range(min(len(s), i + 200), i, -1) if s[i:j] in pieces)
            n += 1
        return n

    got = {r.doc_id: r for r in wordpiece.token_counts(odd_docs, PATH).collect()}
    for r in odd_docs.where("doc_id not in (6, 7)").collect():
        words = (r.text or "").encode().split()
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens, got[r.doc_id].n_unknown) == (len(words), sum(map(greedy, words)), 0)
    assert got[7].n_tokens == got[6].n_tokens + greedy(b"end")
    assert wordpiece.token_counts(no_docs, PATH).count() == 0


def test_words_with_marks_are_put_together():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    enc, asked = tokens.Encoder(path), []
    plain = enc._spaced
    enc._spaced = lambda parts, *more: asked.extend(parts) or plain(parts, *more)
    texts = ["x sorel sorel. sorel,\nArv sorel!?\nArv. (sorel) sorel's sorel<|endoftext|> sorel.\n\nArv sorel.\n9 ª. 語。\nArv"]
    ids = Tokenizer.from_file(path).encode(texts[0], add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(texts)[0], "<u4").tolist() == ids
    assert "sorel" in asked and not {"sorel.", "sorel,\nArv", "sorel!?\nArv."} & set(asked)
