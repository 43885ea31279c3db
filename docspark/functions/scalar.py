"""Dates and validity, text measures, tokens, cells, masks and geometry, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.grammar import let

# ---------------------------------------------------------------- dates and status


def dotted_date(raw: Column) -> Column:
    """The first dd.mm.yyyy; null where none is or it is impossible."""
    return F.try_to_date(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\d{2}\.\d{2}\.\d{4})", 1), "dd.MM.yyyy")


def registry_date(raw: Column) -> Column:
    """An ISO date or date and time, else the first dd.mm.yyyy."""
    return F.coalesce(F.try_to_date(F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), dotted_date(raw))


def validity(intro: Column, cancel: Column, today: Column) -> Column:
    return F.when(today < intro, "не введён").when(today >= cancel, "отменён").when(intro.isNotNull() | cancel.isNotNull(), "актуален").otherwise("неизвестно")


def validity_b(intro: Column, cancel: Column, flag: Column, today: Column) -> Column:
    """Registry B: flag 0 without a date of cancellation says cancelled."""
    return F.when((F.trim(F.coalesce(flag, F.lit(""))) == "0") & cancel.isNull(), "отменён").otherwise(validity(intro, cancel, today))


def consensus(found_a: Column, status_a: Column, found_b: Column, status_b: Column) -> Column:
    both = F.coalesce(found_a & found_b, F.lit(False))
    agree = lambda s: both & (status_a == s) & (status_b == s)
    return F.when(agree("актуален"), "актуален").when(agree("отменён"), "отменён").otherwise("проверка вручную")


# ---------------------------------------------------------------- text


def token_estimate(text: Column) -> Column:
    """Half a token for a Cyrillic character, a third for others, 1 at least."""
    text = F.coalesce(text, F.lit(""))
    cyrillic = F.regexp_count(text, F.lit("[Ѐ-ӿ]"))
    return F.greatest(F.lit(1), F.floor(cyrillic / 2) + F.floor((F.length(text) - cyrillic) / 3)).cast("long")


def counted(text: Column, chars: str, flags: str = "") -> Column:
    """How many characters of a class stand in a text: the length of what is left without the others, as a list of matches is dear."""
    return F.length(F.regexp_replace(text, f"{flags}[^{chars}]+", ""))


def readability(text: Column, letters: str = "А-Яа-яЁё", vowels: str = "аеёиоуыэюя", foreign: str = "A-Za-z", consonants: str = "бвгджзклмнпрстфхцчшщ") -> Column:
    """Score of a line: share of vowels, length, less signs of misreading. The alphabets are parameters."""
    def scored(s: Column, n: Column, share: Column) -> Column:
        score = share * 40.0 + F.least(n, F.lit(80)) * 0.15
        score -= F.when((share < 0.18) | (share > 0.62), 18.0).otherwise(0.0)
        score -= counted(s, foreign) * 4.0 + counted(s, r"|©\[\]_`") * 6.0
        score -= F.when(s.rlike(f"(?iu)[{consonants}]{{5,}}"), 12.0).otherwise(0.0) + F.when(s.rlike(r"(?iu)(.)\1{3,}"), 8.0).otherwise(0.0)
        return F.when(n < 3, -50.0).otherwise(score)

    def of(s: Column) -> Column:
        n, told = counted(s, letters), counted(s, vowels, "(?iu)")
        shared = let(F.struct(n.alias("n"), told.alias("v")), lambda c: let(F.struct(c["n"].alias("n"), (c["v"] / F.greatest(c["n"], F.lit(1))).alias("share")), lambda d: scored(s, d["n"], d["share"])))
        return F.when(F.length(s) < 3, -100.0).otherwise(shared)

    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), of)


def table_quality(text: Column) -> Column:
    """0 to 1: how much a text looks like a table."""
    t = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(lines), F.lit(1))
    tabs = F.size(F.filter(lines, lambda x: x.contains("\t")))
    wide = F.size(F.filter(lines, lambda x: F.size(F.split(F.trim(x), r"\t|\s{2,}")) >= 3))
    letters, cyrillic = F.regexp_count(t, F.lit("[А-Яа-яЁёA-Za-z]")), F.regexp_count(t, F.lit("[А-Яа-яЁё]"))
    marks = F.regexp_count(t, F.lit("(?iu)поз\\.?|обознач|наименован|кол\\.?|примечан|условн"))
    score = F.least(F.lit(0.35), tabs / n * 0.5) + F.least(F.lit(0.25), wide / n * 0.4)
    score += F.when(letters > 0, cyrillic / F.greatest(letters, F.lit(1)) * 0.2).otherwise(0.0) + F.when(marks >= 2, 0.15).otherwise(0.0)
    flat = (F.size(lines) <= 2) & (F.length(t) > 120) & (tabs == 0)
    return F.when((F.length(t) < 20) | (F.size(lines) == 0), 0.0).otherwise(F.least(F.lit(1.0), score * F.when(flat, 0.5).otherwise(1.0)))


def mixed_script(text: Column, one: str = "A-Za-z", other: str = "А-Яа-яЁё") -> Column:
    """A token of both scripts, or more than a few letters of the foreign one."""
    s = F.trim(F.coalesce(text, F.lit("")))
    token = s.rlike(f"(?=\\S*[{one}])\\S*[{other}]") & s.rlike(f"[{one}]\\S*[{other}]|[{other}]\\S*[{one}]")
    foreign = F.regexp_count(s, F.lit(f"[{one}]"))
    return s.rlike(f"[{one}]") & s.rlike(f"[{other}]") & (token | ((foreign >= 2) & (foreign / F.greatest(F.length(s), F.lit(1)) > 0.06)))


# Latin letters read for Cyrillic ones of the same shape.
LOOKALIKES = ("ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху")


def homoglyphs(text: Column) -> Column:
    """Look-alike letters become Cyrillic in tokens that hold Cyrillic letters; blank lines go."""
    token = lambda t: F.when(t.rlike("[А-Яа-яЁё]"), F.translate(t, *LOOKALIKES)).otherwise(t)
    line = lambda x: F.array_join(F.transform(F.split(F.trim(x), r"\s+"), token), " ")
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line), lambda x: x != ""), "\n")


def row_cells(line: Column) -> Column:
    """Cells of a line: by pipes, else by tabs, else by two spaces; empty ones go."""
    s = F.trim(F.coalesce(line, F.lit("")))
    cells = F.when(s.contains("|"), F.split(s, r"\|")).when(s.contains("\t"), F.split(s, "\t")).otherwise(F.split(s, r"\s{2,}"))
    return F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")


def column_name(header: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(header, F.lit("")), r"\s+", " "))
    low = F.lower(t)
    return (
        F.when(low.startswith("поз"), "Поз.").when(low.contains("обознач"), "Обозначение").when(low.contains("наимен"), "Наименование")
        .when(low.startswith("кол"), "Кол.").when(low.contains("масса"), "Масса ед., кг").when(low.contains("примеч"), "Примечание")
        .when(t == "", "—").otherwise(t)
    )


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def escape_cell(text: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def sse_chunks(text: Column, size: int = 900) -> Column:
    text = F.coalesce(text, F.lit(""))
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def mask(secret: Column) -> Column:
    s = F.coalesce(secret, F.lit(""))
    return F.when(s == "", "").when(F.length(s) <= 2, F.repeat(F.lit("•"), F.length(s))).otherwise(F.concat(F.left(s, F.lit(2)), F.repeat(F.lit("•"), F.least(F.lit(8), F.length(s) - 2))))


def login_name(raw: Column) -> Column:
    """The user of DOMAIN\\user or user@domain, in lower case."""
    return F.lower(F.trim(F.split_part(F.element_at(F.split(F.coalesce(raw, F.lit("")), r"\\"), -1), F.lit("@"), F.lit(1))))


def cache_key(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(40))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


# ---------------------------------------------------------------- geometry; a rectangle is four columns


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def overlap_ratio(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over the smaller area."""
    inner = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    small = F.least(area(*a), area(*b))
    return F.when(small > 0, inner / small).otherwise(0.0)


def is_wide(width: Column, height: Column) -> Column:
    return F.coalesce(F.try_divide(width, height) >= 1.35, F.lit(False))


def grid_columns(pages: Column) -> Column:
    n = F.greatest(F.lit(1), pages)
    return F.when(n <= 1, 4).when(n <= 5, 3).when(n <= 12, 2).otherwise(1)


def grid_rows(pages: Column) -> Column:
    return F.when(F.greatest(F.lit(1), pages) <= 12, 2).otherwise(1)


def detector_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the page, within 0 to 1."""
    share = lambda v, of: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v, of)))
    return F.struct(share((x0 + x1) / 2, width).alias("cx"), share((y0 + y1) / 2, height).alias("cy"), share(x1 - x0, width).alias("w"), share(y1 - y0, height).alias("h"))


def request_date(raw: Column) -> Column:
    """A date argument: ISO first, then dd.mm.yyyy."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "dd.MM.yyyy"))


def capped_dpi(width: Column, height: Column, dpi: Column, pixels: int) -> Column:
    """Resolution at which a clip of width by height points has at most ``pixels`` pixels; 72 at least."""
    full = (width / 72 * dpi) * (height / 72 * dpi)
    return F.when(full > pixels, F.greatest(F.lit(72), F.floor(dpi * F.sqrt(F.lit(pixels) / full)))).otherwise(dpi).cast("long")


def block_between(text: Column, start: str, end: str) -> Column:
    """From the first match of ``start`` to the next match of ``end``, or to the end of the text; empty without a start."""
    text = F.coalesce(text, F.lit(""))
    at = F.regexp_instr(text, F.lit(start))
    rest = F.substr(text, at)
    stop = F.regexp_instr(F.substr(rest, F.lit(2)), F.lit(end))
    return F.when(at == 0, "").otherwise(F.trim(F.when(stop > 0, F.left(rest, stop)).otherwise(rest)))


def table_label(line: Column) -> tuple[Column, Column]:
    """Number and inline title of a line such as "Таблица 1.2 – Ведомость"."""
    rule = r"(?iu)^\s*таблица\s*№?\s*(\d+(?:\.\d+)?)\s*[.:–—-]?\s*(.*)$"
    return F.regexp_extract(F.coalesce(line, F.lit("")), rule, 1), F.trim(F.regexp_extract(F.coalesce(line, F.lit("")), rule, 2))


def clean_title(title: Column, most: int = 72, generic: str = r"(?iu)^(?:таблица|продолжение|окончание|поз\.?.*)$") -> Column:
    """Single spaces, cut at a word within ``most`` characters; generic or header-like titles are empty."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    short = F.when(F.length(t) > most, F.regexp_replace(F.left(t, F.lit(most)), r"\s+\S*$", "")).otherwise(t)
    return F.when(t.rlike(generic), "").otherwise(short)


def name_and_note(name: Column) -> tuple[Column, Column]:
    """A name with its note: "(АБВ) Хвост" or two spaces part them."""
    s = F.trim(F.coalesce(name, F.lit("")))
    paren, wide = r"^(.*?\([^)]*\))\s+(\S.*)$", r"^(.*?\S)\s{2,}(\S.*)$"
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, paren, i), F.lit("")), F.regexp_extract(s, wide, i))
    return F.when(pick(2) != "", pick(1)).otherwise(s), pick(2)
