"""Token files: random access, masks, ids that repeat or lack, and strings of special tokens."""

import numpy as np
import pyarrow as pa

from trendweave.llm import packing, token_files
from trendweave.llm.tokens import encode, pieces, vocabulary


def _library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def _specials(name):
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(vocabulary(name)).get_added_tokens_decoder().values()]


def test_special_strings_as_in_the_library():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        texts = ["", " a  b\n", "plain text, 12 words", "é ü ß 東京   x", *[f"before {s} after{s}{s.upper()} end" for s in _specials(name)]]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(vocabulary(name), texts, 2)] == _library(name, texts)
        plain = [np.frombuffer(x, "<u4").tolist() for x in encode(vocabulary(name), texts, 2, plain_specials=True)]
        assert not _specials(name) or plain != _library(name, texts)


def test_sequences_and_masks(spark, tmp_path):
    texts = [f"text {i} " * (1 + i * i % 50) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files = token_files.write_tokens(docs, f"file://{tmp_path}/tokens", vocabulary("word_bpe_49k.json"), seq_len=64, batch_sequences=8).collect()
    stream = [x for ids in _library("word_bpe_49k.json", texts) for x in ids]
    for f in files:
        n = -(-f["n_tokens"] // 64)
        for i in (0, n // 2, n - 1):
            ids, mask = token_files.sequence(f["uri"], i, batch_sequences=8)
            at = f["first_token"] + 64 * i
            held = min(64, f["first_token"] + f["n_tokens"] - at)
            assert len(ids) == len(mask) == 64 and mask.tolist() == [k < held for k in range(64)]
            assert ids[:held].tolist() == stream[at : at + held] and not ids[held:].any()
        batch = pa.ipc.open_file(pa.memory_map(f["uri"].removeprefix("file://"))).get_batch(0)
        assert pa.types.is_fixed_size_list(batch.schema.field("ids").type)
    assert sum(f["n_tokens"] for f in files) == len(stream)


def test_ids_that_repeat_or_lack(spark):
    texts = [f"some text number {i}" for i in range(60)]
    docs = spark.createDataFrame([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, "x") for i, t in enumerate(texts)] + [(7, None, "x"), (None, "", "x")], "doc_id long, text string, start string")
    got = token_files.token_digests(docs).collect()
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == 62 and ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_full_pieces_are_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([5000, 5000, 1023, 10, 0])], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    full = [r for r in rows if r["length"] == 1024]
    assert len(full) >= 9 and len({r["sequence_id"] for r in full}) == len(full) and {r["offset"] for r in full} == {0}
    assert not {r["sequence_id"] for r in full} & {r["sequence_id"] for r in rows if r["length"] < 1024}


def test_single_words_need_the_model_alone():
    """Words of letters have the ids that whole texts give them, without the steps around the model."""
    known = pieces.__wrapped__(vocabulary("byte_bpe_50k.json"))
    words = ["word", " word", "W", " a", "antidisestablishmentarianism", " zqxjkv", "x" * 300, " " + "y" * 300]
    assert known.bytewise and [known.word(w) for w in words] == [known.encoded(w) for w in words]
    assert not pieces.__wrapped__(vocabulary("word_bpe_49k.json")).bytewise
