"""Title blocks: fields by a table of rules, what is no value of a field, and what is a title, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import lines as ln
from docspark.functions import scalar as sc
from docspark.functions import sheet
from docspark.functions.grammar import let
from docspark.functions.rows import NO_DATA, TABLE_LABEL, cyrillic, matches, of_squeezed, squeezed

# ---------------------------------------------------------------- fixed values

# The fields in the order in which they are shown.
FIELDS = ("Обозначение документа", "Обозначение / шифр", "Организация", "Город / адрес", "Масштаб", "Формат", "Стадия (обозначение)", "Стадия", "Очередь строительства", "Лист", "Копировал")
# Where the value of a field stands in a text of one line; the first pattern that is found counts.
DOCUMENTS = (r"(?:VR|УВ|UV)-[\w#\- ]+(?:GT|СТ|CT)[\w#\-]*", r"(?:BNP|БНП)\s*[\d\-]+[А-ЯA-ZЁ]{2,6}\d*")
CIPHERS = (r"\d{2,6}\s*-\s*\d+\s*-\s*[\wА-Яа-яЁё\d\-]{1,24}", r"\d{3,6}\s*-\s*\d{1,2}\s*[А-ЯA-Za-z][\wА-Яа-яЁё\d\-]{0,20}")
ORGANISATIONS = (r'РУП\s*["«][^"»\n]{4,80}["»]', r'РУП\s*["«]?\s*[А-ЯA-ZЁ][\wА-Яа-яЁё\-]{4,50}', r'ООО\s+["«][^"»\n]{4,80}["»]', r'ООО\s+[«"]?[\wА-Яа-яЁё\s\-]{4,60}')
NO_ORGANISATION = (r"поза\s+щита", r"по\s+месту\s+защиты", r"входит\s+\d+\s+комплект")
COUNTRIES = "Беларусь|Россия|РБ|РФ"
CITIES = (r"(минск)\s*(белорус)\w*", rf"(?:г\.\s*)?([А-ЯЁ][\wА-Яа-яЁё\-]+(?:\s+[А-ЯЁ][\wА-Яа-яЁё\-]+){{0,3}})\s*,?\s*({COUNTRIES})")
FORMAT = r"(?:[Ff]ormat|Формат|Popmam)\s*([AА]\d\s*[x×хX&]?\s*\d+)"
STAGES = r"(Подготов\w+\s+\w+\s+период|Рабоч\w+\s+документ\w+)"
QUEUE = r"([I1Il]\s*очеред\w+\s+строитель\w+)"
LETTERS = (r"стадия[^\wА-Яа-я]{0,12}([СРПР])\b", r"(?:^|[\s|])ст\.?\s*([СРПР])\b")
LETTER_AND_SHEET = r"(?=[СРП])\b([СРПР])\b[^0-9]{0,16}(\d{1,3})\b"
SHEETS = (r"(?:^|[\s|])лист[^\d]{0,8}(\d{1,3})\b", r"(?:^|[\s|])л\.?\s*(\d{1,3})\b")
SHEET_COUNT = r"листов[^\d]{0,8}(\d{1,3})\b"
COPIED = r"копиров\w*\s*[:\s]+([А-ЯA-Z][а-яё]{3,})"
# Words that are no names of persons.
NO_NAMES = (
    "генеральный", "план", "благоустройства", "благоустройство", "реконструкция", "минск", "беларусь", "формат", "лист", "период", "подготовительный", "рабочая", "документация",
    "очередь", "строительства", "копиров", "копироб", "разраб", "пров", "контр", "гип", "утв", "проект", "существующая", "новая",
)
# What a value of a field may not hold, what it may not be, and what it must hold.
REJECTED = {
    "Город / адрес": (r"месту\s+защиты", r"щита\s+и\s+по", r"поза\s+щита", r"формат\s+a\d"),
    "Стадия": (r"^[СРПТ]$", "^очеред"), "Формат": (r"1\s*:\s*\d",), "Организация": (r"\d{3,}\s*-\s*\d+\s*-\s*[А-ЯA-Z]",), "Очередь строительства": (r"^очеред\w*\s+строитель\w*$",),
}
REQUIRED = {"Масштаб": (r"1\s*:\s*\d",), "Очередь строительства": (r"(?:^|[\s|])[I1Il]\s*очеред", r"^\d+\s*очеред"), "Стадия (обозначение)": (r"^[СРПТ]$",)}
# What no title of a section holds, and openings that stand only beside a word of plans.
NO_TITLE = (
    r"разраб\.?|раз\s*раб|пров\.?|гип\b|н\.?\s*контр|нач\.?\s*отд|копиров|утв\b", r'ру\s*["«]|ооо\s*["«]', r"\bооо\b.*\bооо\b", r"^(?:стадия|лист(?:ов)?|масштаб|формат|город|адрес)\b", "^очеред",
    r"^\d{3,6}\s*-\s*\d+\s*-", r"^\d{1,3}\.\d{2}\.?\s+", r"^подготов\w+\s+период", r"^рабоч\w+\s+документ\w+", r"(.)\1{4,}",
    r"^(?:г\.\s*)?[А-ЯЁ][а-яё\-]+\s+(?:Беларусь|Россия|РБ|РФ)\.?$", r'^["«][^"»]{3,60}["»]\.?$',
    r"плодородн|озеленен|используемый\s+для|элементов\s+озеленен|ведомость\s+|тротуар|покрыти[яе]\s|газон\s|посадк", r"[\(（]\s*\d\s*[,.\-]\s*\d\s*[\)）]", r"^[\s‚\.\"«»\)\(]+[а-яa-z]\s*[\)\]]",
    r"^(?:рунт|зм\.|лестн|асштаб)", r"электродвигател|выключател|концевых\s+выключ|комплект\s+б\d|цеп[ией].*обеспеч|^\d{1,2}\s+выключател|гр\.\s+банбык|импульсного\s+клапана",
    r"арматур|защиты\s+пвд|поза\s+щита|^\d+\s+\d+\s+т\b|входит\s+\d+\s+комплект", r"см\.\s*тгп|тгп\.\s*\d+\s+щита|^главный\s+корпус|метлу\s+защиты|защиты\s+пв\b|что\s+метлу",
    r"^(?:разро|пров|гип|н\.?\s*контр|нач\.|копиров|утв)", r"копиров|формат\s*[aа]\d|1\s*:\s*\d|обозначен\w*\s*/\s*шифр", r"^[сзвю]$", r"[|`\[\]]", r"^[\s=\-_`]",
)
OPENINGS = ((r"^реконструк\w+", r"\bплан\b"), (r"^(?:короб|корд|кабель|шкаф|панель|блок|устройство)\s", "план|схем|черт|раздел|комплект|марк|изыскан|расположен|генеральн"))
# Lines of a sheet that are noise beside a title block, and those that are none in spite of being short.
NOISE = (r"^===", r"^\[страниц", r"^[сзвю]$", r"\bооо\s+по\b|\bоо\s+по\b", r"^[A-ZА-ЯЁ]\d{2,5}\s")
APPARATUS = r"цеп[ией]|датчик|температур|нагрузк|трансформатор|панел\w*|релейн\w*\s+зал|предупред|филиал.*электрическ"
SUBJECTS = r"\b(?:план|схема|ведомост|раздел|комплекс|объект|генеральн|благоустр)\w*"
PHRASES = (
    r"генеральн\w+\s+план\.?", r"план\s+благоустр\w+", r"план\s+[А-ЯЁ][\wА-Яа-яЁё\-]+(?:\s+[А-ЯЁ][\wА-Яа-яЁё\-]+){0,5}", r"схем\w+\s+[А-ЯЁ][\wА-Яа-яЁё\-]+(?:\s+[А-ЯЁ][\wА-Яа-яЁё\-]+){0,4}",
    r"ведомост\w+(?:\s+[А-ЯЁ][\wА-Яа-яЁё\-]+){0,4}",
)
#: Fields whose values are no titles, whatever their length.
NAMED_ELSEWHERE = ("Организация", "Город / адрес", "Обозначение / шифр", "Масштаб", "Формат", "Очередь строительства")

# ---------------------------------------------------------------- fields


def _in(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, f"(?iU){pattern}", group)


def folded(c: Column) -> Column:
    """A text in which each letter is the one that patterns without case know it by."""
    return F.lower(F.upper(c))


def _naming(low: Column, stems: tuple[str, ...], value: Column) -> Column:
    """``value`` where a folded text holds one of the stems, without which no pattern of it is found; else empty."""
    return F.when(reduce(Column.__or__, (low.contains(stem) for stem in stems)), value).otherwise("")


def _bound(**values: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in values.items()))


def _first(*found: Column) -> Column:
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), F.lit(""))


def ciphers(text: Column, most: int = 10) -> Column:
    """The first ``most`` different ciphers of a text; designations of standards are none."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?iU)({p})"), F.lit(1)) for p in CIPHERS))
    return F.slice(F.array_distinct(F.filter(F.transform(every, sheet.cipher), lambda c: (F.length(c) >= 7) & ~sheet.reference_cipher(c))), 1, most)


def best_of(texts: Column, rank) -> Column:
    """The text of the greatest rank, of equal ones the first; empty without texts."""
    ranked = F.transform(texts, lambda t, i: F.struct(rank(t).alias("rank"), (-i).alias("first"), t.alias("text")))
    return F.coalesce(F.array_max(ranked)["text"], F.lit(""))


def organisation(text: Column) -> Column:
    """A quoted РУП before a quoted ООО before others; then by Cyrillic letters, marks of misreading and length."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?iU)({p})"), F.lit(1)) for p in ORGANISATIONS))

    def rank(o: Column) -> Column:
        kind = F.when(matches(o, r'^РУП\s*["«]'), 200).when(matches(o, r'^ООО\s+["«]'), 100).otherwise(0) + F.when(matches(o, "белнипи", "энергопром", "геоцентр"), 40).otherwise(0)
        no = matches(o, *NO_ORGANISATION)
        return F.struct(F.when(no, -50).otherwise(kind).alias("kind"), *(F.when(no, 0).otherwise(v).alias(k) for k, v in (("letters", cyrillic(o)), ("noise", -F.regexp_count(o, F.lit(r"[|©\[\]_`]"))), ("size", F.length(o)))))

    whole = let(every, lambda e: squeezed(best_of(e, rank)))
    return F.regexp_replace(F.regexp_replace(whole, "(?iu)бейнипи", "БЕЛНИПИ"), "(?iu)энергопром", "ЭНЕРГОПРОМ")


def sheet_format(text: Column) -> Column:
    v = F.translate(F.regexp_replace(_in(text, FORMAT), r"\s+", ""), "×х&Аа", "xx4Aa")
    v = F.regexp_replace(F.regexp_replace(v, "(?iu)^a(?:ф)", "a4"), r"(?iu)^a4x([^\d])", "a4x4")
    return let(v, lambda v: F.when(v != "", F.concat(F.lit("Формат "), v)).otherwise(""))


def stage_and_sheet(text: Column, low: Column) -> Column:
    """``letter`` of the stage, and ``sheet`` beside it or by its name, with the number of sheets. ``low``: the text, folded."""
    number_of = lambda n: F.when(n != "", n.try_cast("int"))
    good = lambda n: F.when(number_of(n).between(1, 999), n)
    begins = lambda stem: (f" {stem}", f"|{stem}")
    at_start = lambda stem: F.startswith(low, F.lit(stem))
    names = F.when(at_start("ст"), _in(text, LETTERS[1])).otherwise(_naming(low, begins("ст"), _in(text, LETTERS[1])))
    sheets = [F.when(at_start(s), _in(text, p)).otherwise(_naming(low, begins(s), _in(text, p))) for s, p in zip(("лист", "л"), SHEETS, strict=True)]
    found = _bound(stage=_naming(low, ("стадия",), _in(text, LETTERS[0])), short=names, beside=_in(text, LETTER_AND_SHEET, 0), by_name=sheets[0], by_letter=sheets[1], total=_naming(low, ("листов",), _in(text, SHEET_COUNT)))

    def of(x: Column) -> Column:
        # what was found is the shortest text in which the pattern finds the same parts
        parts = _bound(named=F.when(x["stage"] != "", x["stage"]).otherwise(x["short"]), letter=_in(x["beside"], LETTER_AND_SHEET, 1), number=_in(x["beside"], LETTER_AND_SHEET, 2), by=F.coalesce(good(x["by_name"]), good(x["by_letter"])))
        return let(parts, lambda y: both(x, y))

    def both(x: Column, y: Column) -> Column:
        free = (y["named"] == "") & ~matches(x["beside"], r"[-–−]\d{1,3}$") & number_of(y["number"]).between(1, 999)
        sheet_no = F.when(F.coalesce(free, F.lit(False)), y["number"].try_cast("int").cast("string")).when(x["total"] != "", F.concat_ws(" / ", y["by"], F.when(y["by"].isNotNull(), x["total"]))).otherwise(y["by"])
        return _bound(letter=F.upper(F.when(y["named"] != "", y["named"]).otherwise(y["letter"])), sheet=F.coalesce(sheet_no, F.lit("")))

    return let(found, of)


def person(raw: Column) -> Column:
    """The first capitalised word that can be a person's name; empty without."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\[\]_`]+", " ")), r"^[ .\-|]+|[ .\-|]+$", "")
    name = F.regexp_extract(F.regexp_replace(s, "(?<=[А-ЯЁа-яё])[oO](?=[а-яё])", "о"), "[А-ЯЁ][а-яё]{2,}|[A-Z][a-z]{3,}", 0)
    no = (F.length(s) < 3) | s.rlike(r"\d{4,}") | F.lower(name).isin(*NO_NAMES) | matches(name, r"^(?:н\.?\s*контр|гип|утв|разраб|пров|нач|копир|копор)") | (F.length(name) < 4)
    return F.when(no, "").otherwise(name)


def near_country(c: Column) -> Column:
    """The part of a text of single spaces in which a place with its country can stand: what is seven words and more before the first
    name of a country is left out, as a place has four words and a sign at most."""
    at = F.regexp_instr(c, F.lit(f"(?iU){COUNTRIES}"))
    return let(at, lambda at: F.when(at > 0, F.concat(F.substring_index(F.left(c, at - 1), " ", -7), F.substr(c, at))).otherwise(""))


def candidates(text: Column, copied: Column) -> Column:
    """Every value found for a field, in the order in which later ones win: array of (field, value). ``text`` is on one line;
    ``copied`` the first line that says who copied."""
    def parts(c: Column, low: Column) -> Column:
        place = lambda p: F.struct(*(_in(c, p, k).alias(f"p{k}") for k in (1, 2)))
        none = F.struct(F.lit("").alias("p1"), F.lit("").alias("p2"))
        named = lambda stems: reduce(Column.__or__, (low.contains(s) for s in stems))
        return _bound(
            vr=_naming(low, ("vr-", "ув-", "uv-"), _in(c, DOCUMENTS[0], 0)), bnp=_naming(low, ("bnp", "бнп"), _in(c, DOCUMENTS[1], 0)), stage=stage_and_sheet(c, low),
            # names of places are sought from every word on, so only in texts that name a country
            minsk=F.when(named(("минск",)), place(CITIES[0])).otherwise(none), city=F.when(named(("беларусь", "россия", "рб", "рф")), let(near_country(c), lambda t: F.struct(*(_in(t, CITIES[1], k).alias(f"p{k}") for k in (1, 2))))).otherwise(none),
            cipher=F.when(c.contains("-"), let(ciphers(c), lambda e: best_of(e, sheet.cipher_rank))).otherwise(""), organisation=_naming(low, ("руп", "ооо"), organisation(c)),
            format=_naming(low, ("format", "формат", "popmam"), sheet_format(c)), stages=_naming(low, ("подготов", "рабоч"), _in(c, STAGES)), queue=_naming(low, ("очеред",), _in(c, QUEUE)),
            tail=F.when(copied.isNotNull(), _in(copied, COPIED)).otherwise(""),
        )

    def found(c: Column, x: Column) -> Column:
        said = lambda p: F.concat_ws(" ", *(F.when(p[k] != "", p[k]) for k in ("p1", "p2")))
        named = F.when(said(x["minsk"]) != "", F.concat(F.initcap(x["minsk"]["p1"]), F.lit(" Беларусь"))).otherwise(squeezed(said(x["city"])))
        values = (
            ("Обозначение документа", sheet.cipher(F.regexp_replace(F.replace(F.regexp_replace(x["vr"], r"\s+", ""), F.lit("УВ"), F.lit("VR")), "UV", "VR"))), ("Обозначение документа", sheet.cipher(F.regexp_replace(x["bnp"], " ", ""))),
            ("Обозначение / шифр", x["cipher"]), ("Организация", x["organisation"]), ("Масштаб", ln.scale_of(c)), ("Стадия (обозначение)", x["stage"]["letter"]), ("Лист", x["stage"]["sheet"]),
            ("Город / адрес", named), ("Формат", x["format"]), ("Стадия", squeezed(x["stages"])), ("Очередь строительства", squeezed(x["queue"])),
            ("Копировал", F.when((x["tail"] == "") | matches(x["tail"], "формат", "разраб", "пров", "гип", r"лист\b"), "").otherwise(person(x["tail"]))),
        )
        return F.filter(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values)), lambda x: x["value"] != "")

    of = lambda c: let(folded(c), lambda low: let(parts(c, low), lambda x: found(c, x)))
    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), of)


def garbage_value(field: Column, value: Column) -> Column:
    """A value that is an echo of its field, or cannot be one of it."""
    return let(squeezed(value), lambda v: _garbage(field, v))


def _garbage(field: Column, v: Column) -> Column:
    bad = v.isin("", "—") | (F.lower(F.trim(field)) == F.lower(v))
    for name, patterns in REJECTED.items():
        bad = bad | ((field == name) & matches(v, *patterns))
    for name, patterns in REQUIRED.items():
        bad = bad | ((field == name) & ~matches(v, *patterns))
    words = F.split(v, " ")
    short = (F.size(words) >= 3) & (F.size(F.filter(words, lambda w: F.length(w) <= 2)) > 0.45 * F.size(words))
    return bad | ((field == "Организация") & ~matches(v, r'["«][^"»]{4,60}["»]') & ((sc.readability(v) < 8.0) | short))


# ---------------------------------------------------------------- titles


@of_squeezed
def garbage_title(s: Column) -> Column:
    """A line of a title block that is no title: by what it holds, its short words, its letters and how it reads."""
    words = F.split(s, " ")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
    letters = F.regexp_count(s, F.lit("[А-Яа-яЁёA-Za-z]"))
    sides = F.regexp_count(F.upper(s), F.lit("[СЗВЮOAV]"))
    shouted = F.exists(words, lambda w: (F.length(w) >= 6) & (F.regexp_count(w, F.lit(r"\p{Lu}")) >= 3))
    found = (s == "") | matches(s, *NO_TITLE) | (short >= F.greatest(F.lit(3), F.floor(F.size(words) / 2))) | ((letters > 0) & (sides > 0.35 * letters)) | s.rlike("[а-яё][А-ЯЁ][а-яё][А-ЯЁ]") | shouted
    for opening, unless in OPENINGS:
        found = found | (matches(s, opening) & ~matches(s, unless))
    return found | let(sc.readability(s), lambda reads: ((reads < 5.0) & (F.length(s) > 25)) | ((reads < 6.0) & (F.length(s) < 55)))


@of_squeezed
def section_title(s: Column) -> Column:
    """A line that names a section in a title block: 8 to 120 characters, a Cyrillic word, one long word at least."""
    lone = ~s.contains(" ") & (F.length(s) < 10)
    return F.length(s).between(8, 120) & s.rlike("[А-Яа-яЁё]{4,}") & ~lone & ~garbage_title(s)


@of_squeezed
def noise_line(s: Column) -> Column:
    """A line of the sheet around a title block: captions of apparatus, heads of tables, short or unreadable texts."""
    short = F.length(s) < 22
    noise = matches(s, *NOISE) | matches(s, *NO_DATA) | ((F.length(s) < 55) & ~matches(s, SUBJECTS) & matches(s, APPARATUS)) | (short & ~matches(s, r"\bплан\b", r"\bсхем")) | ((sc.readability(s) < 5.0) & (F.length(s) > 20))
    return noise & ~matches(s, TABLE_LABEL, whole=True)


def polished(title: Column) -> Column:
    """Without a date before it and single letters of the compass, look-alike letters put right, with a capital."""
    t = F.regexp_replace(squeezed(title), r"^\d{1,3}\.\d{2}\.?\s+", "")
    t = sc.homoglyphs(F.regexp_replace(t, r"^(?:[A-Za-zА-Яа-яЁё] )+(?=\S)", ""))
    return let(t, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(squeezed(title)), r"(?U)[^\w\s]+", ""))


def keys_alike(a: Column, b: Column) -> Column:
    """Keys of titles are equal, or one of 12 characters stands in another such."""
    inside = (F.length(a) >= 12) & (F.length(b) >= 12) & (F.contains(a, b) | F.contains(b, a))
    return (a != "") & (b != "") & ((a == b) | inside)


def fields_told(fields: Column) -> Column:
    """What the fields of a block (a map) say, as ``told_elsewhere`` asks it of each title: their values in small letters, the keys of those
    that are no titles, the organisation's name in quotes, the stage."""
    entry = lambda e: F.struct(F.lower(e["value"]).alias("low"), F.length(e["value"]).alias("size"), F.when(e["key"].isin(*NAMED_ELSEWHERE), title_key(e["value"])).alias("key"))
    name = F.regexp_extract(F.coalesce(F.try_element_at(fields, F.lit("Организация")), F.lit("")), r'["«]([^"»]{4,60})["»]', 1)
    stage = F.lower(F.coalesce(F.try_element_at(fields, F.lit("Стадия")), F.lit("")))
    return F.struct(F.transform(F.filter(F.map_entries(fields), lambda e: e["value"] != ""), entry).alias("values"), F.lower(name).alias("name"), stage.alias("stage"))


def told_elsewhere(title: Column, key: Column, said: Column) -> Column:
    """A field of the block says what the title says: its value stands in the title, or the title in it. ``key``: of the title; ``said``:
    ``fields_told``."""
    def told(t: Column) -> Column:
        within = lambda low: F.contains(t, low) | F.contains(low, t)
        listed = F.exists(said["values"], lambda e: ((e["key"].isNotNull() | (e["size"] >= 8)) & within(e["low"])) | (e["key"].isNotNull() & keys_alike(key, e["key"])))
        return listed | ((F.length(said["name"]) >= 5) & within(said["name"])) | ((said["stage"] != "") & F.contains(t, said["stage"]))

    return let(F.lower(title), told)
