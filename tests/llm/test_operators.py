"""The numbered operators against brute force on the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from trendweave.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def _got(spark, small, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, small).collect()}


def test_exact_dedup(spark, small, docs):
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    got = _got(spark, small, "op1_exact_dedup")
    for body, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(body.encode()).hexdigest())


def test_secret_scan_base(spark, small, docs):
    patterns = [("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    for i, r in _got(spark, small, "op2_secret_scan").items():
        found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(patterns) for m in re.finditer(p, docs[i]) if len(m[g]) >= n)
        text = ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in found) for x in range(3)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_suffix_dedup(spark, small, docs):
    seen, n = {}, 50
    for i in sorted(docs):
        b = docs[i].encode()
        for k in range(len(b) - n + 1):
            seen.setdefault(b[k : k + n], i)
    got = _got(spark, small, "op3_suffix_dedup")
    for i, t in docs.items():
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] < i:
                gone[k : k + n] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone[:-1].sum()), runs, hashlib.sha256(kept).hexdigest())


def test_names_pack_without_loss():
    from trendweave.llm.suffix_dedup import packed_names, unpacked_names

    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 5000):
        names = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (unpacked_names(packed_names(names)) == names).all()


def test_quality_model(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = _got(spark, sf, "op4_quality_model")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [got[i]["predicted"] == q for i, q in labels.items() if i in got and got[i]["held_out"]]
    assert np.mean(held) > 0.8


def _shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(spark, small, docs):
    sets = {i: _shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    for i, r in _got(spark, small, "op5_near_dedup").items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i)


def test_quality_rules(spark, small, docs):
    for i, r in _got(spark, small, "op6_quality_rules").items():
        t = docs[i]
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])


def _ids(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, small, docs):
    got, start = _got(spark, small, "op7_token_files"), 0
    for i, ids in zip(sorted(docs), _ids("word_bpe_49k.json", [docs[i] for i in sorted(docs)]), strict=True):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_packing(spark, small, docs):
    ids = dict(zip(docs, _ids("byte_bpe_50k.json", list(docs.values())), strict=True))
    rows, filled = queries.QUERIES["op8_packing"](spark, small).collect(), defaultdict(list)
    whole = defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for parts in filled.values():
        assert sum(n for _, n in parts) <= 1024
        assert all(a == sum(n for _, n in sorted(parts)[:k]) for k, (a, _) in enumerate(sorted(parts)))
    for i, parts in whole.items():
        parts.sort()
        assert len(parts) == -(-len(ids[i]) // 1024) and [p[1] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))] and sum(p[2] for p in parts) == len(ids[i])
    assert len(filled) <= 1.05 * -(-sum(map(len, ids.values())) // 1024) + 1
