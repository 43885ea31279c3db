"""Notes of legends and titles of tables, as Column expressions over tables of fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import rows as r
from docspark.functions import scalar as sc
from docspark.functions import stamp
from docspark.functions.grammar import let

# What is put right in a note, in order. A rule that begins with ! keeps the case of its letters.
CLEANING = (
    (r"повелительн\w*\s+насосн\w*", "повысительная насосная"), (r"^В\.трубы\b", "в.трубы"), (r"!^(?:[A-ZА-ЯЁ]{2,6}\)|\([A-ZА-ЯЁ]{2,6}\))\s*", ""), (r"^[)\]}>\.]+\s*", ""), (r"^[=+\-–•|/\\]+\s*", ""),
    (r"^[а-яёa-z]{1,4}\)\s*", ""), (r"^[а-яёa-z]\s+(?=[A-ZА-ЯЁ])", ""),
)
# What no note of a legend holds.
NO_NOTE = (
    r"<\s*[\wА-ЯA-ZЁ]|>\s*[\wА-ЯA-ZЁ]|[\wА-ЯA-ZЁ]\s*[<«]|[»>]\s*[\wА-ЯA-ZЁ]", r"^(?:symbol|note|обозначение|примечание)$", r"^таблица\s*[_\d]", "[бвгджзклмнпрстфхцчшщ]{5,}", r"(.)\1{3,}",
)
NO_LINE = (r"номер\s+на\s+плане|координат|квадрат|план\s*№|обозначение\s+примечан|примечание\s*$|наименован\s*$", r"разраб|пров\.|гип\b|контр\.|копиров|формат\s*a\d|^\d{2,6}-\d+-|ру\s*п\b")
SEPARATORS = r"\s{2,}|\s*;\s*|(?<=[а-яё])\s*,\s*(?=[А-ЯЁ«\"])|(?<=\.)\s+(?=[А-ЯЁ])"
# What no title of a table holds, and where the title of an anchored line ends.
NO_TABLE_TITLE = (r"разро[бь]", r"пров\.", r"гип\b", r"формат\s*a\d", r"1\s*:\s*\d", r"ру\s*[\"«]")
TITLE_TAIL = r"[\wА-Яа-яЁё\s\-«»\".,:;()]*"
TITLE_ENDS = r"\s*(?:номер\s+на\s+плане|наименован\w*|координат\w*|обозначение\s*\||примечан\w*).*$"

# ---------------------------------------------------------------- notes


def clean_note(note: Column) -> Column:
    """A note with look-alike letters put right, without marks and short codes before it, with a capital."""
    s = sc.homoglyphs(r.squeezed(note))
    for pattern, new in CLEANING:
        s = F.regexp_replace(s, ("(?U)" + pattern[1:]) if pattern.startswith("!") else "(?iU)" + pattern, new)
    return let(s, lambda t: F.trim(F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))))


def garbage_note(note: Column) -> Column:
    """A note that is a title, a head, a start of another section, or nothing that one would write."""

    def found(n: Column) -> Column:
        words = F.filter(F.split(n, r"(?U)\s+"), lambda w: w != "")
        letters, vowels = r.cyrillic(n), F.regexp_count(F.lower(n), F.lit("[аеёиоуыэюя]"))
        few = F.size(F.array_distinct(F.regexp_extract_all(n, F.lit("([А-Яа-яЁё])"), F.lit(1)))) <= 2
        long = lambda k: F.exists(words, lambda w: F.length(w) > k)
        return (
            r.section_title(n) | r.opens(n, "specification") | r.matches(n, *NO_NOTE) | r.column_header(n) | r.unreadable(n) | ((F.size(words) >= 2) & (F.lower(F.element_at(words, 1)) == F.lower(F.element_at(words, -1))))
            | (r.opens(n, "explication") & ~r.opens(n, "legend")) | (letters < 5) | (few & (letters > 4)) | (vowels < 0.18 * letters) | ((F.size(words) <= 2) & ~long(3)) | ((F.size(words) <= 2) & ~long(4) & (vowels < 0.25 * letters))
            | ((F.length(n) > 70) & (F.regexp_count(n, F.lit(r"[A-ZА-Я]{2,}\d")) >= 3))
        )

    return let(clean_note(note), lambda n: F.when(n == "", True).otherwise(found(n)))


def bare_line(line: Column) -> Column:
    """A line without marks before it, dashes and bars in it as gaps."""
    return F.trim(F.regexp_replace(F.regexp_replace(r.squeezed(line), r"^[—\-–•|]+\s*", ""), r"\s*[—\-–|]+\s*", " "))


def note_line(line: Column) -> Column:
    """A line that is a note of a legend."""

    def test(n: Column) -> Column:
        other = F.length(F.regexp_replace(n, r"(?U)[А-Яа-яЁё\s]", "")) > 0.5 * F.length(n)
        return (F.length(n) >= 6) & ~garbage_note(n) & ~other & ~r.matches(n, *r.NO_DATA) & ~r.matches(n, *NO_LINE) & n.rlike("[А-Яа-яЁё]{4,}")

    return let(bare_line(line), test)


def note_of(line: Column) -> Column:
    """The note of a line: the last of its cells that is one where bars part it, else itself; null without one."""
    cells = F.filter(F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    texts = F.when(~line.contains("|"), F.array(line)).otherwise(let(cells, lambda c: F.when(F.size(c) >= 2, c)))
    return F.nullif(bare_line(F.try_element_at(F.filter(texts, note_line), F.lit(-1))), F.lit(""))


def notes_within(note: Column, most: int = 50) -> Column:
    """The notes of a text in which several ran together: its numbered parts, else its parts between separators where two of
    them can be notes, else itself; texts under 45 characters are one note."""
    none = F.array().cast("array<string>")

    def split(n: Column) -> Column:
        return F.when(F.length(n) < 45, F.when(n == "", none).otherwise(F.array(n))).otherwise(let(r.glued_rows(n), lambda numbered: parted(n, numbered)))

    def parted(n: Column, numbered: Column) -> Column:
        # the parts and the whole are tested in one place, the whole as the last of them
        several = F.size(numbered) >= 2
        parts = F.when(several, numbered).otherwise(F.concat(F.split(n, SEPARATORS), F.array(n)))
        tested = F.transform(F.transform(parts, lambda p: F.trim(p)), lambda p: F.struct(p.alias("p"), ((F.length(p) >= F.when(several, 8).otherwise(10)) & ~garbage_note(p)).alias("good")))
        return let(tested, lambda x: chosen(n, x, several))

    def chosen(n: Column, tested: Column, several: Column) -> Column:
        good = lambda x: F.slice(F.transform(F.filter(x, lambda y: y["good"]), lambda y: y["p"]), 1, most)
        within = let(good(F.slice(tested, F.lit(1), F.size(tested) - 1)), lambda p: F.when(F.size(p) >= 2, p).when(~F.element_at(tested, -1)["good"], none).otherwise(F.array(n)))
        return F.when(several, good(tested)).otherwise(within)

    return let(clean_note(note), split)


# ---------------------------------------------------------------- titles of tables


def clean_title(title: Column) -> Column:
    """A title of a table, cut at a word to 72 characters; empty for heads, "Таблица N" and what does not read."""

    def cleaned(t: Column) -> Column:
        cut = let(F.when(F.length(t) > 72, F.trim(F.regexp_replace(F.left(t, F.lit(72)), r"\s\S*$", ""))).otherwise(t), lambda c: F.when(no(c), "").otherwise(c))
        return F.when((t == "") | r.matches(t, r.TABLE_LABEL, whole=True) | r.column_header(t), "").otherwise(cut)

    def no(t: Column) -> Column:
        words = F.split(t, " ")
        short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
        return (r.marks(t) >= 2) | (sc.readability(t) < 4.0) | (short >= F.greatest(F.lit(4), F.floor(F.size(words) / 2)))

    return let(stamp.polished(title), cleaned)


@r.of_squeezed
def title_line(s: Column) -> Column:
    """A line that can be the title of a table."""
    no = s.contains("|") | r.column_header(s) | r.matches(s, *r.NO_DATA) | r.matches(s, r.TABLE_LABEL, whole=True) | s.rlike(r"^\d{1,2}\s+[А-ЯA-Z]") | r.matches(s, *NO_TABLE_TITLE)
    named = F.when(r.opens(s, "explication", "legend"), F.length(s) >= 10).otherwise((r.cyrillic(s) >= 8) & s.contains(" "))
    return (F.length(s) >= 5) & ~no & named


def label_and_title(line: Column) -> Column:
    """The title behind "Таблица N" on a line; empty without."""
    rest = F.trim(F.regexp_extract(r.squeezed(line), rf"(?iU){r.TABLE_LABEL}(.*)$", 1))
    return let(rest, lambda t: F.when((F.length(t) >= 5) & title_line(t), t).otherwise(""))


def anchored_title(line: Column, kind: str) -> Column:
    """The title that begins with the anchor of a kind of section on a line; empty without."""
    return clean_title(anchored_text(r.squeezed(line), kind))


def anchored_text(s: Column, kind: str) -> Column:
    """What ``anchored_title`` makes a title of, in a squeezed line."""
    anchor = "|".join(f"(?:{p})" for p in r.ANCHORS[kind])
    found = F.regexp_extract(s, f"(?iU)(?:{anchor}){TITLE_TAIL}", 0)
    return F.trim(F.regexp_replace(found, f"(?iU){TITLE_ENDS}", ""))


def told_line(s: Column, head: Column, opens: dict[str, Column], titles: dict[str, Column]) -> Column:
    """What titles over several lines ask of a squeezed line: the columns' ``head``, and for each kind whether it opens one and its title."""
    goes_on = s.rlike("(?iU)^[а-яёa-z]") & (F.length(s) < 100)
    own = (s.alias("s"), ((s == "") | head).alias("stop"), r.matches(s, r.TABLE_LABEL).alias("label"), goes_on.alias("goes_on"), r.matches(s, r"^\d{1,2}\s+").alias("numbered"))
    return F.struct(*own, *(opens[k].alias(f"opens_{k}") for k in opens), *(titles[k].alias(f"title_{k}") for k in titles))


def title_of_lines(lines: Column, kind: str) -> Column:
    """A title over up to four lines, the first of which is anchored: further anchored lines and lines that go on in small letters,
    up to a head or the label of a table."""
    of = lambda x: let(r.squeezed(x), lambda s: told_line(s, r.column_header(s), {kind: r.opens(s, kind)}, {kind: anchored_title(s, kind)}))
    return clean_title(joined_title(F.transform(lines, of), kind))


def joined_title(told: Column, kind: str) -> Column:
    """The title over ``told``, an array of ``told_line``, as it stands there; a missing line ends it."""

    def step(state: Column, x: Column) -> Column:
        of, first = x["of"], x["n"] == 0
        anchored, goes_on = of[f"opens_{kind}"], of["goes_on"]
        stop = of.isNull() | of["stop"] | (~first & of["label"])
        more = F.when(anchored, of[f"title_{kind}"]).when(goes_on & (F.size(state["parts"]) > 0) & ~of["numbered"], of["s"]).otherwise("")
        ends = ~first & ~anchored & (F.size(state["parts"]) > 0) & ~goes_on
        parts = F.when((more == "") | ends, state["parts"]).otherwise(F.concat(state["parts"], F.array(more)))
        return F.when(state["done"] | stop, F.struct(state["parts"].alias("parts"), F.lit(True).alias("done"))).otherwise(F.struct(parts.alias("parts"), ends.alias("done")))

    numbered = F.transform(told, lambda x, i: F.struct(i.alias("n"), x.alias("of")))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("done"))
    return F.array_join(F.aggregate(numbered, start, step, lambda s: s["parts"]), " ")
