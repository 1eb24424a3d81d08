"""Checks of statements against verdicts, and of the language of a text, as expressions over whole texts.

Contexts around a word (a negation before it, a word about the whole edition near it) are bounded look-behinds and
look-aheads, so that direction words are counted inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_checks import SENTENCE_END, SPACE, masked

# How texts name a language.
LANGUAGE_STEMS = {
    "de": ["німец", "german", "deutsch"],
    "fr": ["француз", "french"],
    "es": ["іспан", "spanish", "españ"],
    "pl": ["польськ", "polish"],
    "tr": ["турец", "turkish", "türk"],
    "uk": ["українськ", "україномов", "ukrainian"],
    "cs": ["чеськ", "czech"],
    "sk": ["словацьк", "slovak"],
    "id": ["індонез", "indonesian"],
    "pt": ["португал", "portugu"],
    "it": ["італ", "italian"],
    "ru": ["російськ", "russian"],
    "ja": ["японськ", "japanese"],
    "zh": ["китайськ", "chinese"],
    "ar": ["арабськ", "arabic"],
    "nl": ["нідерланд", "dutch"],
    "sv": ["шведськ", "swedish"],
    "ro": ["румунськ", "romanian"],
    "hu": ["угорськ", "hungarian"],
    "ko": ["корейськ", "korean"],
    "el": ["грецьк", "greek"],
    "bg": ["болгарськ", "bulgarian"],
    "fi": ["фінськ", "finnish"],
    "da": ["данськ", "danish"],
    "he": ["іврит", "hebrew"],
    "fa": ["перськ", "persian"],
    "sr": ["сербськ", "serbian"],
    "hr": ["хорватськ", "croatian"],
    "be": ["білоруськ", "belarusian"],
    "ka": ["грузинськ", "georgian"],
    "lt": ["литовськ", "lithuanian"],
    "vi": ["в'єтнам", "vietnamese"],
}
STEM_CODES = {stem: code for code, stems in LANGUAGE_STEMS.items() for stem in stems}  # none begins with another
# Words of rise and fall, negations before them, and words about a whole edition.
UP = r"(?<!\p{L})(?:зроста|зріс|зросл|росте|ростуть|растущ|збільшу|підвищу|grow|rising|increas)|[↑📈]"
DOWN = r"(?<!\p{L})(?:пада|спад|скороч|знижу|знижен|зменшу|впа[вл]|declin|falling|fell|drop|decreas)|[↓📉]"
NEGATIONS = "не|ні|not|no|isn't|doesn't|don't|без"
EDITION_WORDS = ["platform", "edition", "overall", "traffic", "платформ", "видання", "загальн", "трафік"]
# Phrases that give the whole edition as the cause, and those that show that raw numbers are meant.
EXCUSES = [
    r"(?:due to|because of|driven by|caused by|explained by|result of|reflects?|reflecting|attributable to)[^.;]{0,40}?(?:platform|wikipedia[- ]wide|edition[- ]wide|overall (?:wikipedia |edition )?(?:traffic|decline)|general (?:traffic|decline)|whole (?:edition|wikipedia))",
    r"(?:is|are|appears to be|seems to be|looks like|mostly|largely|mainly)\s+(?:an? |the )?(?:\p{L}+ )?platform[- ]wide effect",
    r"(?:через|внаслідок|пояснюєт\p{L}*|спричинен\p{L}*|зумовлен\p{L}*|є наслідком|відображає|відбив\p{L}*|вплину\p{L}*|вплива\p{L}*)[^.;]{0,40}?(?:платформ|загальн\p{L}* (?:втрат|падінн|спад|зниженн|скороченн)|(?:всієї|усієї) Вікіпеді|(?:всього|усього) розділу|трафік\p{L}* (?:в |у )?Вікіпеді)",
    r"(?:це|є|схоже на|переважно|здебільшого)\s+(?:\p{L}+\s+)?(?:ефект|вплив)\p{L}* платформ",
]
RAW_NUMBERS = r"raw|absolute|removes|already removed|сир\p{L}*|абсолютн|без поправки|вже враховано|уже враховано|прибира|видаля"
TRUST_PERCENT = r"\d+(?:[.,]\d+)?\s?%\s*(?:trust|confidence|довір\p{L}*)|(?:trust|confidence|довір\p{L}*)(?:\s+\p{L}+)?\s*[(:]?\s*\d+(?:[.,]\d+)?\s?%"
# Words and endings that do not belong in a Ukrainian text, and terms that a text should translate.
RUSSIAN_WORDS = r"(?<!\p{L})(?:растет|растут|растущ\p{L}*|растуч\p{L}*|рост|меньш\p{L}*|больш\p{L}*|лучш\p{L}*|всего|прокси|википеди\p{L}*|также|котор\p{L}*|если|чтобы|только|сейчас|однако|исключ\p{L}*|нужно|можно|очень|сегодня|что|как|или|и|еще|сниж\p{L}*|падени\p{L}*|увелич\p{L}*|интерес\p{L}*|статья|статьи|статью|пользоват\p{L}*|приложени\p{L}*|трафик\p{L}*|аналитик\p{L}*|мобильн\p{L}*|стабильн\p{L}*|английск\p{L}*|испанск\p{L}*|немецк\p{L}*|французск\p{L}*|польск\p{L}*|турецк\p{L}*|чешск\p{L}*|украинск\p{L}*|сравнени\p{L}*)(?!\p{L})"
RUSSIAN_LETTERS = r"(?<!\p{L})\p{L}*[ыэъё]\p{L}*"
RUSSIAN_ENDINGS = r"(?<!\p{L})\p{IsCyrillic}{3,}(?:ия|ии|ию|ией|ость|остью|уется|ается|яется)(?!\p{L})|(?<!\p{L})\p{IsCyrillic}+(?:ськую|цькую)(?!\p{L})|(?<!\p{L})\p{IsCyrillic}{2,}[\p{IsCyrillic}&&[^ь]]тся(?!\p{L})"
SHARE_CALQUE = r"(?<!\p{L})(?:відносна\s+)?дол[яіюею]\p{L}*(?=\s+(?:інтерес|перегляд|трафік|бот|ринк|аудитор|статт))"
SPEECH_CALQUE = r"(?<!\p{L})на\s+\p{L}+[сцз]ькій\s+мові(?!\p{L})|(?<!\p{L})на\s+\p{L}+[сцз]ькому(?=\s*[,.;:!?)]|\s*$)"
ARTICLE_CALQUE = r"(?<!\p{L})(?:артикл\p{L}*|цілеуказ\p{L}*)"
LATIN_SITE = r"(?<![\p{L}.])wikipedi\p{L}*"
LATIN_WORD = r"(?<![\p{L}\d_./\\@#'’-])[a-z][a-z'’-]*[a-z](?![\p{L}\d_/\\@-])(?!\.\p{L})"
QUOTED = r'"[^"\n]*"|«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]'
TOOL_TERMS = ["flat", "growing", "declining", "insufficient-data", "trust", "high", "medium", "low", "yoy", "views", "verdict", "relativegrowth", "robustgrowth", "editiongrowth", "permillion", "botshare", "spikemonths"]
UKRAINIAN_TERMS = {
    "flat": "без змін",
    "growing": "зростає",
    "declining": "спадає",
    "insufficient-data": "мало даних",
    "trust": "довіра",
    "high": "висока",
    "medium": "середня",
    "low": "низька",
    "yoy": "р/р",
    "views": "переглядів",
    "verdict": "висновок",
    "relativegrowth": "відносна зміна",
    "robustgrowth": "зміна переглядів",
    "editiongrowth": "зміна всього розділу",
    "permillion": "на 1 млн переглядів",
    "botshare": "частка ботів",
    "spikemonths": "місяці-сплески",
}
OTHER_CODES = ["en", "kk", "rm", "no", "nb", "lv", "et", "sl", "hi", "th", "ms", "ca", "eu", "gl", "az", "uz", "hy"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found(text: Column, pattern: str, flags: str = "(?iu)") -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(f"{flags}({pattern})"), F.lit(1))


def directions(text: Column, words: str) -> Column:
    """How many direction words stand without a negation before them and without a word about the whole edition within 30 characters.

    What stands before is looked at where a direction word begins only.
    """
    before = "|".join(f"{w}.{{0,{30 - len(w)}}}" for w in EDITION_WORDS)
    after = "|".join(f".{{0,{30 - len(w)}}}{w}" for w in EDITION_WORDS)
    plain = rf"(?={words})(?<!(?<!\p{{L}})(?:{NEGATIONS})\s{{1,3}}(?:\p{{L}}{{1,19}}\s{{1,3}})?)(?<!{before})(?:{words})(?!{after})"
    return F.size(found(text, plain, "(?ius)"))


def split_sentences(docs: DataFrame, id_col: str, text_col: str, ends: str = SENTENCE_END) -> DataFrame:
    trimmed = F.transform(F.split(F.col(text_col), ends), lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))
    return docs.select(id_col, F.monotonically_increasing_id().alias("_row"), F.posexplode(trimmed).alias("pos", "sentence")).where("sentence <> ''")


def named_languages(sentence: Column) -> Column:
    """Codes of the languages that a sentence names, by a stem or as "code:" or "code)"; all stems are looked for at once."""
    table = F.create_map(*[F.lit(x) for pair in STEM_CODES.items() for x in pair])

    def codes(low: Column) -> Column:
        said = F.transform(F.regexp_extract_all(low, F.lit(f"(?=({'|'.join(STEM_CODES)}))"), F.lit(1)), lambda s: F.element_at(table, s))
        written = F.regexp_extract_all(low, F.lit(rf"(?:^|[\s(])([a-z]{{2,3}}(?:-[a-z]{{2,8}})*)(?=[:)])"), F.lit(1))
        return F.array_union(once(said, lambda held: F.filter(F.array(*map(F.lit, LANGUAGE_STEMS)), lambda c: F.array_contains(held, c))), written)

    return once(F.lower(sentence), codes)


def trust_percentages(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per sentence that writes trust as a percentage: id, pos, said (the first such phrase)."""
    said = F.element_at(found(F.col("sentence"), TRUST_PERCENT), 1)
    rows = split_sentences(docs, id_col, text_col).where(F.col("sentence").rlike(f"(?iu){TRUST_PERCENT}"))
    return rows.select(id_col, "pos", said.alias("said"))


def edition_excuses(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str = "text", cited: DataFrame | None = None) -> DataFrame:
    """One row per sentence that explains a change by the whole edition though some verdict rests on the share of its views: id, pos, said.

    cited: id, analysis of the drafts, with verdicts by analysis; without it every text is held against all verdicts.
    """
    rows = split_sentences(docs, id_col, text_col, rf"(?<=[.!?;]){SPACE}+|\n+")
    excuse = F.lit(False)
    for pattern in EXCUSES:
        excuse = excuse | F.col("sentence").rlike(f"(?iu){pattern}")
    rows = rows.where(excuse & ~F.col("sentence").rlike(f"(?iu){RAW_NUMBERS}"))
    shared = verdicts.where(F.col("basis").contains("share of edition views"))
    if cited is None:
        one = F.broadcast(shared.limit(1).select(F.lit(1).alias("_one")))
        rows = rows.withColumn("_one", F.lit(1)).join(one, "_one", "left_semi")
    else:
        rows = rows.join(cited.join(shared.select("analysis").distinct(), "analysis", "left_semi").select(id_col).distinct(), id_col, "left_semi")
    return rows.select(id_col, "pos", F.substring("sentence", 1, 90).alias("said"))


def _opinions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sentences that tell one direction, a row for each language they name."""
    rows = split_sentences(docs, id_col, text_col)
    told = F.struct(directions(F.col("sentence"), UP).alias("_up"), directions(F.col("sentence"), DOWN).alias("_down"))
    rows = rows.withColumn("_told", F.explode(F.array(told))).select(id_col, "_row", "pos", "sentence", "_told.*").where("(_up > 0) <> (_down > 0)")
    return rows.withColumn("lang", F.explode(F.array_distinct(named_languages(F.col("sentence")))))


def _contradicting(met: DataFrame, id_col: str) -> DataFrame:
    one = met.groupBy("_row", id_col, "pos").agg(F.count("*").alias("_langs"), F.first(F.struct("sentence", "lang", "_up", "label", "basis")).alias("s")).where("_langs = 1")
    claim = F.when(F.col("s._up") > 0, "growing").otherwise("declining")
    wrong = ((F.col("claim") == "growing") & (F.col("label") != "growing")) | ((F.col("claim") == "declining") & (F.col("label") == "growing"))
    return one.select(id_col, "pos", F.substring("s.sentence", 1, 90).alias("said"), "s.lang", claim.alias("claim"), "s.label", "s.basis").where(wrong)


def label_contradictions(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Sentences on one analysed language that contradict its verdict: id, pos, said, lang, claim, label, basis.

    verdicts: lang, label, basis.  A sentence that names several analysed languages or both directions is left alone;
    so is every text when a language has several verdicts, as sentences then name topics.  A null or empty text
    contradicts nothing; rows with a repeated id are judged one by one.
    """
    known = verdicts.groupBy("lang").agg(F.first("label").alias("label"), F.first("basis").alias("basis"), F.count("*").alias("_n"))
    several = known.where("_n > 1").limit(1).select(F.lit(1).alias("_one"))
    met = _opinions(docs, id_col, text_col).join(F.broadcast(known), "lang").withColumn("_one", F.lit(1)).join(F.broadcast(several), "_one", "left_anti")
    return _contradicting(met, id_col)


def draft_contradictions(docs: DataFrame, cited: DataFrame, verdicts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``label_contradictions`` of drafts against the analyses each of them cites; a draft whose analyses have a language twice is left alone.

    cited: id, analysis; verdicts: analysis, lang, label, basis.
    """
    links = cited.select(id_col, "analysis").distinct()
    held = verdicts.groupBy("analysis").agg(F.count("*").alias("_n"), F.collect_set("lang").alias("_langs"))  # as many as there are languages
    all_ = links.join(held, "analysis").groupBy(id_col).agg(F.sum("_n").alias("_n"), F.size(F.array_distinct(F.flatten(F.collect_list("_langs")))).alias("_langs"))
    clear = all_.where("_n = _langs").select(id_col)
    met = _opinions(docs, id_col, text_col).join(clear, id_col, "left_semi").join(links, id_col).join(verdicts.select("analysis", "lang", "label", "basis"), ["analysis", "lang"])
    return _contradicting(met, id_col)


def draft_labels(docs: DataFrame, cited: DataFrame, verdicts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """All that is wrong with a draft's words on its verdicts: id, kind (trust, excuse, contradiction), pos, said."""
    kinds = {"trust": trust_percentages(docs, id_col, text_col), "excuse": edition_excuses(docs, verdicts, id_col, text_col, cited), "contradiction": draft_contradictions(docs, cited, verdicts, id_col, text_col)}
    first, *rest = (found_.select(id_col, F.lit(kind).alias("kind"), "pos", "said") for kind, found_ in kinds.items())
    for r in rest:
        first = first.unionByName(r)
    return first


def language_problems(text: Column, lang: Column, names: Column, most: int = 8) -> Column:
    """Array of (kind, words): words of a text that are not in its language, at most ``most`` distinct ones of a kind.

    Placeholders, code, links, paths and proper names are not judged.  A null text has no problems.
    """
    t = masked(F.regexp_replace(F.coalesce(text, F.lit("")), r"\]\([^)]*\)", "] "), F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.length(n) > 1))
    return once(t, lambda judged: _problems(judged, lang, most))


def _problems(t: Column, lang: Column, most: int) -> Column:
    unquoted = F.regexp_replace(t, QUOTED, " ")
    kept = [*LANGUAGE_STEMS, *OTHER_CODES, *TOOL_TERMS[:11]]
    latin = F.filter(found(unquoted, LATIN_WORD, ""), lambda w: ~w.isin(kept) & ~w.startswith("wikipedi"))
    terms = rf"(?<![\p{{L}}-])(?:{'|'.join(TOOL_TERMS)})(?![\p{{L}}-])"
    uk = lang == "uk"
    kinds = [
        ("share_calque", uk, found(t, SHARE_CALQUE)),
        ("speech_calque", uk, found(t, SPEECH_CALQUE, "(?ium)")),
        ("article_calque", uk, found(t, ARTICLE_CALQUE)),
        ("russian_words", uk, F.concat(found(t, RUSSIAN_LETTERS), found(t, RUSSIAN_WORDS), found(t, RUSSIAN_ENDINGS))),
        ("latin_site_name", uk, found(t, LATIN_SITE)),
        ("latin_words", uk, latin),
        ("tool_terms", lang != "en", found(t, terms)),
    ]
    all_ = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(on, F.slice(F.array_distinct(F.transform(w, lambda x: F.trim(x))), 1, most)).otherwise(F.array().cast("array<string>")).alias("words")) for k, on, w in kinds])
    return F.filter(all_, lambda p: F.size(p["words"]) > 0)


def term_hints(words: Column, lang: Column) -> Column:
    """Translations of tool terms found in a text, "term → translation", each once; null for languages but Ukrainian and where none is known."""
    table = F.create_map(*[F.lit(x) for pair in UKRAINIAN_TERMS.items() for x in pair])
    known = F.filter(F.array_distinct(F.transform(words, F.lower)), lambda w: w.isin(list(UKRAINIAN_TERMS)))
    hints = F.array_join(F.transform(known, lambda w: F.concat(w, F.lit(" → "), F.element_at(table, w))), ", ")
    return F.when((lang == "uk") & (F.size(known) > 0), hints)
