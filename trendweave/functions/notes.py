"""Note templates by language, and their rendering as a DataFrame expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of every note; {name} is filled from the note's variables.
NOTES = {
    "en": {
        "levelShift": "the article jumped from ~{from} to ~{to} views/month around {month} — it was probably created, renamed or merged then, so growth describes the article's history, not interest",
        "matchLow": "article was found by text search with no interlanguage link to the topic — probably a different subject",
        "matchMedium": "article was found by text search, not by an interlanguage link — check it really is the topic",
        "lateStart": "data starts {first}, {months} months after the requested start — article was created or renamed then (views under an old title are not counted)",
        "months6": "only {months} months of data (<6: no trend can be fitted)",
        "months12": "only {months} months of data (<12: no year-over-year comparison)",
        "months24": "{months} months of data (<24: seasonality not separable from trend)",
        "gaps": "gaps in data ({pct}% of months present)",
        "spikesMany": "{pct}% of months are spikes — interest is event-driven, not steady",
        "spikesSome": "some spike months ({pct}%)",
        "spikeDriven": "headline growth disappears when spikes are removed (median-based growth disagrees)",
        "bots40": "very high automated traffic ({pct}% of views are bots) — human counts may be contaminated too",
        "bots30": "high automated traffic ({pct}% of views are bots)",
        "bots15": "notable automated traffic ({pct}%)",
        "noisy": "trend is noisy (R²={rsq}) — direction is not consistent month to month",
        "lowVolume": "low volume ({n} views/month) — small numbers swing wildly",
        "rawVsRelative": "raw ({raw}%) and relative ({rel}%) growth point in opposite directions — the verdict rests on adjusting for the edition-wide trend ({ed}%)",
        "basisRelative": "share of edition views {rel} YoY — the edition-wide change ({ed}) is already removed; raw views {raw}",
        "basisMedian": "median monthly views {raw} YoY",
        "basisTrend": "trend {g}/yr",
        "basisNone": "fewer than 24 months and no fittable trend",
        "basisShift": "not comparable: the article changed around {month} (~{from} → ~{to} views/month: created, renamed or merged)",
        "flat": "no clear change — {g} is inside the ±10% noise band ({inner})",
    },
    "uk": {
        "levelShift": "перегляди статті стрибнули з ~{from} до ~{to} на місяць близько {month} — імовірно, тоді її створили, перейменували або об'єднали, тож зростання описує історію статті, а не інтерес",
        "matchLow": "статтю знайдено текстовим пошуком без міжмовного посилання на тему — імовірно, це інший предмет",
        "matchMedium": "статтю знайдено текстовим пошуком, а не за міжмовним посиланням — перевірте, що це саме ця тема",
        "lateStart": "дані починаються з {first}, на {months} міс. пізніше за початок періоду — тоді статтю створили або перейменували (перегляди під старою назвою не враховано)",
        "months6": "лише {months} міс. даних (менше 6: тренд не побудувати)",
        "months12": "лише {months} міс. даних (менше 12: порівняння рік до року неможливе)",
        "months24": "{months} міс. даних (менше 24: сезонність не відокремити від тренду)",
        "gaps": "пропуски в даних (є {pct}% місяців)",
        "spikesMany": "{pct}% місяців — сплески: інтерес тримається на подіях, а не стабільний",
        "spikesSome": "є місяці-сплески ({pct}%)",
        "spikeDriven": "без місяців-сплесків зростання зникає (зміна за медіаною його не підтверджує)",
        "bots40": "дуже багато автоматичного трафіку ({pct}% переглядів — боти) — навіть людські перегляди можуть бути неточні",
        "bots30": "багато автоматичного трафіку ({pct}% переглядів — боти)",
        "bots15": "помітна частка автоматичного трафіку ({pct}%)",
        "noisy": "тренд нестабільний (R²={rsq}) — напрям змінюється з місяця в місяць",
        "lowVolume": "малий обсяг (переглядів на місяць: {n}) — малі числа сильно коливаються",
        "rawVsRelative": "сирі ({raw}%) і відносні ({rel}%) зміни мають протилежний напрям — висновок тримається на поправці на зміну всього розділу ({ed}%)",
        "basisRelative": "частка в переглядах розділу {rel} р/р — зміну всього розділу ({ed}) уже враховано; сирі перегляди {raw}",
        "basisMedian": "медіанні місячні перегляди {raw} р/р",
        "basisTrend": "тренд {g} на рік",
        "basisNone": "менше 24 місяців, і тренд не побудувати",
        "basisShift": "порівнювати не можна: стаття змінилася близько {month} (~{from} → ~{to} на місяць: створення, перейменування або об'єднання)",
        "flat": "явної зміни немає — {g} у межах шуму ±10% ({inner})",
    },
}


#: Variables that are numbers, not texts: their decimals keep the point.
AS_NUMBERS = ["raw", "rel"]


def template(key: Column, lang: str = "en") -> Column:
    """The template of a note key; a language without templates uses English."""
    known = NOTES.get(lang, NOTES["en"])
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key)


def fill(text: Column, variables: Column, lang: str = "en") -> Column:
    """Replace {name} by map<string,string> variables; unknown names stay.

    Decimals take a comma in languages with templates other than English, but for the variables in AS_NUMBERS.
    """

    def shown(e):
        comma = e["value"].rlike(r"^\d+\.\d+$") & ~e["key"].isin(AS_NUMBERS)
        local = F.when(comma, F.replace(e["value"], F.lit("."), F.lit(","))).otherwise(e["value"]) if lang in NOTES and lang != "en" else e["value"]
        return F.struct(e["key"].alias("k"), local.alias("v"))

    return F.aggregate(F.transform(F.map_entries(variables), shown), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["k"], F.lit("}")), F.coalesce(e["v"], F.lit("null"))))


def render(note: Column, lang: str = "en") -> Column:
    """Text of a note struct (key, vars)."""
    return fill(template(note["key"], lang), note["vars"], lang)
