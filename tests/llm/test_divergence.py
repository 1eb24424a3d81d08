"""The divergence verdict on planted word salad, junk labels and mislabelled clean texts."""

import numpy as np

from trendweave.llm import quality_rules


def test_salad_goes_and_mislabelled_texts_stay(spark):
    rng = np.random.default_rng(5)
    rare = lambda n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(n)]
    frequent = {"aa": rare(64), "bb": rare(64)}

    def text(lang, share):
        words = rare(400)
        for k in np.flatnonzero(rng.random(400) < share):
            words[k] = str(rng.choice(frequent[lang]))
        return " ".join(words)

    rows = [("good", lang, text(lang, share)) for lang, share in (("aa", 0.15), ("bb", 0.6)) for _ in range(60)]
    rows += [("salad", "bb", " ".join(rare(400))) for _ in range(3)] + [("junk label", "zz", " ".join(rare(400))) for _ in range(3)]
    rows += [("mislabelled", "bb", text("aa", 0.15)) for _ in range(3)] + [("mislabelled", "aa", text("bb", 0.6)) for _ in range(3)]
    docs = spark.createDataFrame([(i, lang, t) for i, (_, lang, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(docs).collect()}
    kept = {kind: [got[i] for i, r in enumerate(rows) if r[0] == kind] for kind in ("good", "mislabelled", "salad", "junk label")}
    assert all(kept["good"]) and all(kept["mislabelled"])
    assert not any(kept["salad"]) and not any(kept["junk label"])


def test_rare_languages_have_references_and_blocks_change_nothing(spark, monkeypatch):
    """A language of 30 documents among many rows is judged by its own reference; references in blocks judge alike."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    frequent = {lang: [word() for _ in range(64)] for lang in ("aa", "bb", "cc", "rare")}
    text = lambda lang: " ".join(str(rng.choice(frequent[lang])) if rng.random() < 0.5 else word() for _ in range(150))
    rows = [(lang, text(lang)) for lang in ("aa", "bb", "cc") for _ in range(250)] + [("rare", text("rare")) for _ in range(31)] + [("aa", text("bb")) for _ in range(5)]
    rows += [("rare", " ".join(word() for _ in range(150))) for _ in range(3)] + [("few", text("cc")) for _ in range(4)] + [(None, ""), ("aa", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(4)
    plain = lambda: sorted(map(tuple, quality_rules.judge_documents(docs).collect()))
    one = plain()
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(docs).collect()}
    assert [kept[i] for i, r in enumerate(rows) if r[0] == "rare"] == [True] * 31 + [False] * 3
    monkeypatch.setattr(quality_rules, "MOST_LANGS", 1)
    assert plain() == one
