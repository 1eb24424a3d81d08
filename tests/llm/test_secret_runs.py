"""The secret scan reads every byte of every run of token characters."""

import numpy as np

from trendweave.llm import secret_scan as S

KEY = "kQ7zXv2LmP9sTb4RwY8nHc3D"


def test_stretches_cover_every_byte():
    texts = [b"a word and aGb/" + b"x" * 30 + b"/dotted.name=" + b"y" * 95 + b" end.", b"", b"//hooks.example.com/services/T0/B0/" + KEY.encode()]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, run, low, high, *_ = S.read(raw, offsets)
    seen = np.zeros(len(raw), bool)
    for a, b in zip(low, high, strict=True):
        assert 0 < b - a <= S.INSIDE
        seen[a:b] = True
    inside = np.zeros(len(raw), bool)
    for a, b in zip(starts, ends, strict=True):
        inside[a:b] = True
    assert (seen == inside).all() and {raw[a:b].tobytes() for a, b in zip(low, high, strict=True)} >= {b"a", b"word", b"aGb", KEY.encode()}


def test_keys_behind_a_long_head(spark):
    heads = ["see https://hooks.example.com/services/T00000000/B00000000/", "open /srv/data/projects/archive/reports/quarterly/backup/", "at //files.example.net/team/share/documents/incoming/latest/"]
    rows = [(i, h + k) for i, (h, k) in enumerate((h, k) for h in heads for k in (KEY, "Zp3Wq9Lx7Tn5Vb2Rk8Md4Hs6"))]
    got = {r["doc_id"]: [f["kind"] for f in r["findings"]] for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("model" in got[i] for i in range(6))


def test_names_and_values_are_two_runs():
    texts = [b"credential=AbC123 a.b.c=x/y== end=", b"=next"]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, longest = S.token_runs(raw, offsets)
    assert [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"credential", b"AbC123", b"a.b.c", b"x/y==", b"end=", b"next"]
    assert S.is_assigned(raw, starts, offsets[np.searchsorted(offsets, starts, side="right") - 1]).tolist() == [False, True, False, True, True, True]
    assert longest.tolist() == [17, 5]


def test_recall_of_planted_values_without_a_pattern(spark):
    rng = np.random.default_rng(3)
    chars = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    names = ["credential", "service.auth", "client_private", "app.mail.signature", "export KEY"]
    keys = ["".join(rng.choice(chars, 28)) for _ in range(200)]
    rows = [(i, f"line {i} of the settings {names[i % 5]}={k} and more") for i, k in enumerate(keys)]
    found = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    hit = [any(rows[r["doc_id"]][1][f["start"] : f["end"]] == keys[r["doc_id"]] for f in r["findings"]) for r in found]
    assert np.mean(hit) >= 0.95
