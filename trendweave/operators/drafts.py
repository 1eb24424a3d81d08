"""One verdict on drafts that cite several analyses: numbers, ratios, words on the verdicts, language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .label_checks import draft_labels, language_problems
from .text_checks import claims, draft_report

KINDS = ["trust", "excuse", "contradiction"]


def draft_verdicts(drafts: DataFrame, cited: DataFrame, known: DataFrame, verdicts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per draft: checked, unverified, ratios, n_trust, n_excuse, n_contradiction, language (kinds of problems with words), ok.

    drafts: one row per id, with text and language; cited: id, analysis; known: analysis, percent, known; verdicts:
    analysis, lang, label, basis; names: analysis, name (proper names, which no language check judges).  Each draft is held
    against its own analyses together, as one.  A null or empty text has no problem; nor is one without a language
    checked for it.
    """
    docs = drafts.select(id_col, text_col)
    numbers = draft_report(claims(docs, id_col, text_col), cited, known, id_col)
    labels = draft_labels(docs, cited, verdicts, id_col, text_col).groupBy(id_col).agg(*[F.count(F.when(F.col("kind") == k, 1)).cast("int").alias(f"n_{k}") for k in KINDS])
    own = cited.join(names, "analysis").where("name is not null").groupBy(id_col).agg(F.collect_set("name").alias("_names"))
    rows = drafts.select(id_col, text_col, F.lower(lang_col).alias("_lang")).join(own, id_col, "left")
    spoken = F.when(F.col("_lang").isNotNull(), language_problems(F.col(text_col), F.col("_lang"), F.col("_names")))
    none = F.array().cast("array<string>")
    rows = rows.select(id_col, spoken.alias("language")).join(numbers, id_col, "left").join(labels, id_col, "left")
    rows = rows.withColumns(
        {"checked": F.coalesce("checked", F.lit(0)), "unverified": F.coalesce("unverified", none), "ratios": F.coalesce("ratios", none), "language": F.coalesce("language", F.from_json(F.lit("[]"), "array<struct<kind:string,words:array<string>>>"))}
        | {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in KINDS}
    )
    wrong = F.size("unverified") + F.size("ratios") + F.size("language")
    for k in KINDS:
        wrong = wrong + F.col(f"n_{k}")
    return rows.select(id_col, "checked", "unverified", "ratios", *[f"n_{k}" for k in KINDS], "language", (wrong == 0).alias("ok"))
