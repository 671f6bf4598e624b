"""What a reused worker remembers of one stage is left by the next."""

import pyarrow as pa

from omiclattice.llm import storage, tokens, words


def test_reading_words_leaves_token_ids():
    tokens.encoder(tokens.tokenizer_path()).encode(["one two three"])
    assert storage.process_cache("encoders")
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None, "c"]})
    got = [(rows.num_rows, bytes(buf)) for rows, buf, _ in words.chunks(iter([batch]), "text")]
    assert got == [(3, b"a bc")] and not storage.process_cache("encoders")


def test_reading_texts_keeps_token_ids():
    first = tokens.encoder(tokens.tokenizer_path())
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    assert [texts for _, texts in tokens.runs(iter([batch]), "text")] == [["a b", ""]]
    assert tokens.encoder(tokens.tokenizer_path()) is first
