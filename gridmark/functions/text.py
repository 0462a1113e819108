"""Notation of reinforcement drawings as column expressions.

Everything here is a composition of JVM functions, so that parsing stays inside code generation and
filters on it are planned with the scan. Rounding is half to even; a value that is absent is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K

BAR = "struct<repere: string, diametre: string, quantite: int, espacement_mm: double, longueur_mm: double>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def group(text: Column, pattern: str, n: int) -> Column:
    """A group of the first match; null where the pattern or the group does not match."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, n), F.lit("")))


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def stripped(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def squeezed(x: Column | str) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(stripped(x), r"(?U)\s+", " ")


ACCENTED, PLAIN = "ÀÂÄÁÃÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝàâäáãçéèêëíìîïñóòôöõúùûüýÿ", "AAAAACEEEEIIIINOOOOOUUUUYaaaaaceeeeiiiinooooouuuuyy"


def unaccented(x: Column | str) -> Column:
    """Accents of composed letters and combining marks removed."""
    return F.regexp_replace(F.translate(_c(x), ACCENTED, PLAIN), r"\p{Mn}+", "")


def label_key(x: Column | str) -> Column:
    """A label as it is matched: upper case, comma as point, letters, digits and points only."""
    return F.regexp_replace(F.replace(F.upper(_c(x)), F.lit(","), F.lit(".")), r"[^\p{L}\p{N}.]", "")


def record_source(source: Column | str, ident: Column | str) -> Column:
    """The side a record belongs to, by its source, else by the end of its id."""
    s, i = F.lower(stripped(_c(source))), F.lower(_c(ident))
    return F.when(s.isin("plan", "atelier"), s).when(i.endswith("_plan"), "plan").when(i.endswith("_atelier"), "atelier").otherwise(s)


def bar_role(mark: Column | str) -> Column:
    """The capital word in front of a bar's mark; empty without one."""
    return F.coalesce(F.regexp_extract(_c(mark), K.ROLE, 0), F.lit(""))


def diameter_key(x: Column | str) -> Column:
    return F.upper(stripped(_c(x)))


def diameter_size(x: Column | str) -> Column:
    """The digits of a diameter as a number; 0 without any."""
    return F.coalesce(F.nullif(F.regexp_replace(_c(x), r"\D", ""), F.lit("")).cast("double"), F.lit(0.0))


def millimetres(value: Column, inch: Column) -> Column:
    """Inches where a sign says so or the bare number is small, else millimetres."""
    return F.bround(F.when(inch | (value <= K.BARE_INCHES_TO), value * K.INCH_MM).otherwise(value), 0)


def spacing_mm(value: Column, unit: Column) -> Column:
    unit = F.coalesce(unit, F.lit(""))
    return F.when(unit == "mm", F.bround(value, 0)).otherwise(millimetres(value, unit != ""))


def storey_key(x: Column | str) -> Column:
    """The storey a title names: RDC, SSn, Nn or TOIT with what follows; null without one."""
    t = F.upper(unaccented(_c(x)))
    below = r"\bSOUS.?SOL\s*S?(\d*)|\bSS\s*(\d*)\b"
    return (
        F.when(t.rlike(r"\bRDC\b|REZ.DE.CHAUSSEE"), "RDC")
        .when(t.rlike(below), F.concat(F.lit("SS"), F.regexp_extract(t, below, 1), F.when(F.regexp_extract(t, below, 1) == "", F.regexp_extract(t, below, 2)).otherwise("")))
        .when(t.rlike(r"\bNIV(?:EAU)?\.?\s*(\d+)"), F.concat(F.lit("N"), F.regexp_extract(t, r"\bNIV(?:EAU)?\.?\s*(\d+)", 1)))
        .when(t.rlike(r"\bTOIT\b"), squeezed(F.regexp_extract(t, r"\bTOIT\b.*", 0)))
    )


def lift_storey(stem: Column | str) -> Column:
    """The storey of a drawing, from its file name: the first of a range, FDN for foundations."""
    t = F.regexp_replace(F.upper(_c(stem)), r"[-_]+", " ")
    first = F.split_part(F.regexp_extract(t, r"(?U)\bNIV\w*\.?\s+(\S+)", 1), F.lit("@"), F.lit(1))
    return (
        F.when(first.rlike(r"^\d+$"), F.concat(F.lit("N"), first))
        .when(first.startswith("FDN") | first.startswith("FOND"), "FDN")
        .otherwise(F.coalesce(storey_key(first), storey_key(F.split_part(t, F.lit("@"), F.lit(1)))))
    )


def octal_decoded(x: Column | str) -> Column:
    """Octal escapes as the letters they stand for; null characters removed."""
    parts = F.split(F.coalesce(_c(x), F.lit("")), r"(?=\\[0-7]{3})")
    letter = lambda p: F.decode(F.unhex(F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 4, "0")), "UTF-16BE")
    one = lambda p: F.when(p.rlike(r"^\\[0-7]{3}"), F.concat(letter(p), F.substring(p, 5, 2**31 - 1))).otherwise(p)
    return F.replace(F.array_join(F.transform(parts, one), ""), F.lit("\u0000"), F.lit(""))


def bar(mark: Column, diameter: Column, quantity: Column, spacing: Column, length: Column) -> Column:
    return F.struct(
        mark.cast("string").alias("repere"), diameter.cast("string").alias("diametre"), quantity.cast("int").alias("quantite"),
        spacing.cast("double").alias("espacement_mm"), length.cast("double").alias("longueur_mm"),
    )


def _none() -> Column:
    return F.lit(None)


def plan_bars(text: Column | str, role: Column | None = None) -> Column:
    """The bars of a plan callout: first the counted ones, then the spaced ones."""
    t, role = _c(text), _none() if role is None else role
    counted = F.transform(F.regexp_extract_all(t, F.lit(K.COUNTED), F.lit(0)), lambda m: bar(role, F.regexp_extract(m, K.COUNTED, 2), F.regexp_extract(m, K.COUNTED, 1), _none(), _none()))
    spaced = F.transform(
        F.regexp_extract_all(t, F.lit(K.SPACED), F.lit(0)),
        lambda m: bar(role, F.regexp_extract(m, K.SPACED, 1), _none(), spacing_mm(F.regexp_extract(m, K.SPACED, 2).cast("double"), F.regexp_extract(m, K.SPACED, 3)), _none()),
    )
    return F.concat(counted, spaced)


def tag_bars(text: Column | str) -> Column:
    """The bars of a column tag: bars of its ARM lines, ties of its LIG lines."""

    def of_line(line: Column) -> Column:
        counted = F.transform(F.regexp_extract_all(line, F.lit(K.TAG_COUNTED), F.lit(0)), lambda m: bar(_none(), F.regexp_extract(m, K.TAG_COUNTED, 2), F.regexp_extract(m, K.TAG_COUNTED, 1), _none(), _none()))
        value = lambda m: F.regexp_extract(m, K.TAG_SPACED, 2).cast("double")
        spaced = F.transform(
            F.regexp_extract_all(line, F.lit(K.TAG_SPACED), F.lit(0)),
            lambda m: bar(_none(), F.regexp_extract(m, K.TAG_SPACED, 1), _none(), F.bround(F.when(F.regexp_extract(m, K.TAG_SPACED, 3) != "", value(m) * K.INCH_MM).otherwise(value(m)), 0), _none()),
        )
        return F.when(line.startswith("ARM"), counted).when(line.startswith("LIG"), spaced).otherwise(F.array().cast(f"array<{BAR}>"))

    return F.flatten(F.transform(F.split(_c(text), "\n"), of_line))


def _mixed(text: Column, pattern: str) -> Column:
    """A number with an optional fraction after it."""
    top, low = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)
    return F.regexp_extract(text, pattern, 1).cast("double") + F.when(top != "", top.cast("double") / low.cast("double")).otherwise(F.lit(0.0))


def shop_bar(text: Column | str) -> Column:
    """A shop drawing's bar line as (key, bar); null for other lines. The key stays before the mark."""
    t = stripped(_c(text))
    g = lambda n: F.regexp_extract(t, K.SHOP_BAR, n)
    mark, rest = F.regexp_replace(g(5), r"[.,]+$", ""), g(6)
    spacing = F.when(rest.rlike(K.AT), spacing_mm(_mixed(rest, K.AT), F.regexp_extract(rest, K.AT, 4)))
    said = F.array_join(F.filter(F.array(g(1), mark), lambda x: x != ""), " ")
    return F.when(t.rlike(K.SHOP_BAR), F.struct(F.nullif(g(1), F.lit("")).alias("key"), bar(F.nullif(said, F.lit("")), g(4), g(3), spacing, _none()).alias("bar")))


def table_bar(text: Column | str) -> Column:
    """A line of a storey table as a bar; a straight bar's length is at the end of its mark."""
    t = _c(text)
    g = lambda n: F.regexp_extract(t, K.TABLE_BAR, n)
    spacing = F.when(g(5).rlike(K.TABLE_SPACING), F.bround(_mixed(g(5), K.TABLE_SPACING) * K.INCH_MM, 0))
    feet, inches = (F.nullif(F.regexp_extract(g(4), K.MARK_LENGTH, n), F.lit("")).cast("int") for n in (1, 2))
    length = F.when((g(1) == "VERT") & (inches < 12), F.bround((feet * 12 + inches) * K.INCH_MM, 0))
    return F.when(t.rlike(K.TABLE_BAR), bar(F.regexp_replace(g(4), r"\.+$", ""), g(3), g(2), spacing, length))


def detail_names(text: Column | str) -> Column:
    """The names of a title line, all of whose parts must be names; else empty."""
    parts = F.transform(F.split(F.regexp_replace(stripped(_c(text)), ",+$", ""), ","), stripped)
    name = whole(K.DETAIL_NAME)
    said = F.transform(parts, lambda p: F.concat(F.regexp_extract(p, name, 1), F.lit("-"), F.regexp_extract(p, name, 2)))
    return F.when(F.forall(parts, lambda p: p.rlike(name)), said).otherwise(F.array().cast("array<string>"))


def is_detail_content(text: Column | str) -> Column:
    t = _c(text)
    return t.rlike(K.DETAIL_BAR) | stripped(t).rlike(K.LOOSE_BAR) | t.rlike(K.DETAIL_SPACING) | stripped(t).rlike(whole(K.POSITION))


def title_words(text: Column | str) -> Column:
    """The distinct words of four letters and more, without accents and plural."""
    found = F.regexp_extract_all(F.upper(unaccented(_c(text))), F.lit("[A-Z]{4,}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.regexp_replace(w, "S+$", "")))


def slab_bars(quantity: Column, band: Column, diameter: Column, mark: Column | None = None) -> Column:
    """The two bars of a slab callout: all of them, and those of them in the band."""
    top = F.lit("HAUT") if mark is None else F.concat_ws(" ", F.lit("HAUT"), F.nullif(mark, F.lit("")))
    return F.array(bar(top, diameter, quantity, _none(), _none()), bar(F.lit("BANDE"), diameter, band, _none(), _none()))


def kind_of_drawing(folder: Column | str, stem: Column | str) -> Column:
    """What a drawing details: by the earliest known word of its folder, else of its own name."""

    def earliest(name: Column) -> Column:
        n = F.lower(unaccented(name))
        found = F.array(*[F.struct(F.locate(w, n).alias("at"), F.lit(kind).alias("kind")) for kind, ws in K.KINDS.items() for w in ws])
        return F.array_min(F.filter(found, lambda x: x["at"] > 0))["kind"]

    return F.coalesce(earliest(_c(folder)), earliest(_c(stem)))


def token_key(x: Column | str) -> Column:
    """What matters of a word in comparing readings."""
    return F.regexp_replace(F.upper(_c(x)), r"[^0-9A-Z@/.\-]", "")


def letters_key(x: Column | str) -> Column:
    return F.regexp_replace(F.upper(_c(x)), r"[^\p{L}\p{N}]", "")


def number_tokens(x: Column | str) -> Column:
    """The words of a text that hold a digit."""
    return F.filter(F.split(squeezed(_c(x)), " "), lambda w: token_key(w).rlike(r"\d"))


def cell_value(x: Column) -> Column:
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("x"))


def cell_pair(plan: Column, shop: Column) -> Column:
    """A report cell: the plan's value, then the shop drawing's."""
    return F.concat(cell_value(plan), F.lit(" | "), cell_value(shop))
