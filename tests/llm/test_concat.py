import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from omiclattice.llm import concat_packing, tokens

PATH = tokens.tokenizer_path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(plain, monkeypatch):
    texts = ["", " ", "It's we'll o'clock.", "a.b,c", "A.'s", "x…’y", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ.", "été á.", "a\x1cb　c\xa0d", "12ab34", ".'s .!'x", "&'&", "ÉÈ."]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abSÉß.,'!<|>%&$*1 \n\t\xa0́Σ漢") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    monkeypatch.setattr(concat_packing, "REMEMBER", 200)
    enc = concat_packing.WordEncoder(PATH)
    for i in range(0, len(texts), 20):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts[i:i + 20])] == [plain(t) for t in texts[i:i + 20]]


def check(got, docs, plain, size):
    """Every id once, pieces gapless in their sequences, checksums of the tokenizer's ids, no padding."""
    sequences, spans = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        spans.setdefault(r.doc_id, []).append(r)
    filled = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        filled.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == size or n < size and n & (n - 1) == 0 for n in filled)
    total = 0
    for name in {d.doc_id for d in docs}:
        want = [np.array(plain(d.text) + [1], "<u4") for d in docs if d.doc_id == name]
        total += sum(map(len, want))
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens, r.continues) for r in spans[name])
        assert sum(p[1] for p in pieces) == sum(map(len, want))
        for start, n, crc, whole, goes_on in pieces:
            assert any(len(w) == whole and zlib.crc32(w[start:start + n].tobytes()) == crc and goes_on == (start + n < whole) for w in want)
    assert sum(filled) == total and filled.count(size) == total // size


@pytest.mark.parametrize("size", [16, 64, 2048])
def test_odd_documents(spark, odd_docs, plain, size):
    docs = odd_docs.where("doc_id is null or doc_id not in (6, 7)") if size == 16 else odd_docs
    check(concat_packing.concat_packing(docs, PATH, size).collect(), docs.collect(), plain, size)


def test_documents_of_the_test_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    check(concat_packing.concat_packing(docs).collect(), docs.collect(), plain, 2048)


def test_bases_beyond_the_broadcast(spark, odd_docs, plain, monkeypatch):
    monkeypatch.setattr(concat_packing, "BASES", 0)
    check(concat_packing.concat_packing(odd_docs.repartition(5), PATH, 256).collect(), odd_docs.collect(), plain, 256)


def test_nothing(no_docs):
    assert concat_packing.concat_packing(no_docs).count() == 0


def test_the_last_window_is_cut_at_powers_of_two():
    assert concat_packing.tail_sizes(0) == [] and concat_packing.tail_sizes(1000) == [512, 256, 128, 64, 32, 8]


def test_plain_words_skip_the_steps_that_leave_them_as_they_are():
    from omiclattice.llm.concat_packing import WordEncoder
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    enc = WordEncoder(path)
    assert enc.words is not enc.tokenizer
    texts = ["Sorel éàß SOREL'S it's İx Σ <|endoftext|> ª 12 sorel.Arv", "<|endoftext|> SOREL Arv"]
    found = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [e.ids for e in found]
