"""The thirty languages, in model column order, and what is known of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# column order; iso3 iso1 nllb whisper name script name-in-Russian ("-": none)
_ROWS = """
rus ru rus_Cyrl russian Russian Cyrillic Русский
ukr uk ukr_Cyrl ukrainian Ukrainian Cyrillic Украинский
bel be bel_Cyrl belarusian Belarusian Cyrillic Белорусский
bul bg bul_Cyrl bulgarian Bulgarian Cyrillic Болгарский
mkd mk mkd_Cyrl macedonian Macedonian Cyrillic Македонский
srp sr srp_Cyrl serbian Serbian Cyrillic Сербский
kaz kk kaz_Cyrl kazakh Kazakh Cyrillic Казахский
kir ky kir_Cyrl kyrgyz Kyrgyz Cyrillic Киргизский
tgk tg tgk_Cyrl tajik Tajik Cyrillic Таджикский
uzn uz uzn_Cyrl uzbek Uzbek Cyrillic Узбекский
tat tt tat_Cyrl tatar Tatar Cyrillic Татарский
bak ba bak_Cyrl bashkir Bashkir Cyrillic Башкирский
chv cv chv_Cyrl - Chuvash Cyrillic Чувашский
sah - sah_Cyrl - Sakha Cyrillic Якутский
tyv - tyv_Cyrl - Tuvan Cyrillic Тувинский
mon mn khk_Cyrl mongolian Mongolian Cyrillic Монгольский
oss os oss_Cyrl - Ossetian Cyrillic Осетинский
che ce che_Cyrl - Chechen Cyrillic Чеченский
udm - udm_Cyrl - Udmurt Cyrillic Удмуртский
mhr - mari_Cyrl - Mari Cyrillic Марийский
kpv - kpv_Cyrl - Komi Cyrillic Коми
eng en eng_Latn english English Latin Английский
spa es spa_Latn spanish Spanish Latin Испанский
fra fr fra_Latn french French Latin Французский
por pt por_Latn portuguese Portuguese Latin Португальский
deu de deu_Latn german German Latin Немецкий
cmn zh cmn_Hans chinese Mandarin Han Китайский
jpn ja jpn_Jpan japanese Japanese Kana Японский
hin hi hin_Deva hindi Hindi Devanagari Хинди
ara ar ara_Arab arabic Arabic Arabic Арабский
"""


class UnknownLang(ValueError):
    pass


@dataclass(frozen=True)
class Lang:
    index: int
    iso3: str
    iso1: str | None
    nllb: str
    whisper: str | None
    name: str
    script: str
    russian: str

    def name_in(self, display: str) -> str:
        """The name in the language ``display`` (iso3); English where it isn't known."""
        return self.russian if display == "rus" else self.name

    @property
    def group(self) -> str:
        return self.script if self.script in ("Cyrillic", "Latin") else "Direct"


def _parse() -> list[Lang]:
    out = []
    for i, line in enumerate(_ROWS.strip().splitlines()):
        x = [None if v == "-" else v for v in line.split()]
        out.append(Lang(i, *x))
    return out


ALL: list[Lang] = _parse()
CODES: list[str] = [x.iso3 for x in ALL]
BY_CODE: dict[str, Lang] = {x.iso3: x for x in ALL}
#: Columns of the model that each route group owns: [from, to).
COLUMN_RANGE = {"Cyrillic": (0, 21), "Latin": (21, 26), "Direct": (26, 30)}

#: Close languages, between which a confident verdict proves nothing.
TWIN_GROUPS = {"turkic": "tat bak kaz kir tyv chv sah", "permic": "udm mhr kpv", "balkan": "bul mkd srp", "east": "rus ukr bel"}
TWIN_OF: dict[str, str] = {code: g for g, codes in TWIN_GROUPS.items() for code in codes.split()}

_FLORES_EXTRA = {"srp": "srp_Latn", "uzn": "uzn_Latn", "tat": "tat_Latn tat_Arab", "mon": "khk_Cyrl", "cmn": "cmn_Hant zho_Hans", "ara": "arb_Arab"}


def _aliases() -> dict[str, dict[str, list[str]]]:
    lid, flores = {}, {}
    tag = {"Cyrillic": "Cyrl", "Latin": "Latn", "Han": "Hans", "Kana": "Jpan", "Devanagari": "Deva", "Arabic": "Arab"}
    for x in ALL:
        if x.index < 26:
            lid[x.iso3] = [x.iso1 or x.iso3] + ["khk"] * (x.iso3 == "mon")
        flores[x.iso3] = [f"{x.iso3}_{tag[x.script]}", *_FLORES_EXTRA.get(x.iso3, "").split()]
    return {"lid176": lid, "flores": flores}


#: Label set -> our code -> labels of other identifiers that mean it.
LABEL_ALIASES = _aliases()


def parse_lang(code: str) -> Lang:
    """The language of an iso3 code, in any letter case."""
    try:
        return BY_CODE[code.lower()]
    except (KeyError, AttributeError):
        raise UnknownLang(f"unknown language {code!r}") from None


def languages(spark: SparkSession) -> DataFrame:
    """The dimension table; 30 rows."""
    rows = [(x.index, x.iso3, x.iso1, x.nllb, x.whisper, x.name, x.script, x.group, TWIN_OF.get(x.iso3)) for x in ALL]
    return spark.createDataFrame(rows, "index int, iso3 string, iso1 string, nllb string, whisper string, name string, script string, group string, twin string")


def label_aliases(spark: SparkSession, which: str) -> DataFrame:
    """(label, lang) of a label set; the table of a dimension join."""
    return spark.createDataFrame([(label, code) for code, labels in LABEL_ALIASES[which].items() for label in labels], "label string, lang string")


def lookup(code: Column, what: str) -> Column:
    """A property of the language whose iso3 code is in ``code``."""
    return F.create_map(*[F.lit(x) for l in ALL if getattr(l, what) is not None for x in (l.iso3, getattr(l, what))])[F.lower(code)]


def from_iso1(code: Column) -> Column:
    """The iso3 code of a two-letter code."""
    return F.create_map(*[F.lit(x) for l in ALL if l.iso1 for x in (l.iso1, l.iso3)])[F.lower(code)]


def twin_protected(gold: Column, pred: Column) -> Column:
    """Both in one group of close languages."""
    g = F.create_map(*[F.lit(x) for kv in TWIN_OF.items() for x in kv])
    return F.coalesce(g[gold] == g[pred], F.lit(False))
