"""Column functions that read capacities, facilities and facts out of text and markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.functions.text import told_number

#: Names of seating layouts.
LAYOUTS = (
    (r"(?:theatre|theater)(?:[- ]style)?", "theatre"), (r"cabaret(?:[- ]style)?", "cabaret"), (r"banquet(?:ing)?", "banquet"), (r"(?:seated )?dinner(?: dance)?|dining", "dinner"), (r"(?:drinks )?reception", "reception"),
    (r"standing", "standing"), (r"seated", "seated"), (r"classroom", "classroom"), (r"boardroom", "boardroom"), (r"u[- ]?shape(?:d)?", "u-shape"), (r"hollow square", "hollow-square"), (r"conference", "conference"),
    (r"cocktail", "cocktail"), (r"(?:lecture|auditorium)", "theatre"), (r"(?:capacity|max(?:imum)?(?: capacity)?|guests|people|pax|total capacity)", "unspecified"),
)
#: Headings that name no space.
NO_SPACE = r"room|rooms|space|spaces|venue|layout|layouts|capacity|capacities|total|name|area|style|format|setup|set[- ]up|type|floor|level|size|dimensions"
#: Facilities and the phrases that state them; what follows up to the sentence's end is the statement.
FACILITIES = (
    ("accessibility", r"\b(?:step[- ]free access|wheelchair access(?:ible)?|accessible toilets?|disabled access|hearing loop|induction loop|accessible entrance|lift access)\b[^.]{0,100}"),
    ("parking", r"\b(?:on[- ]site parking|car park|parking spaces?|park and ride)\b[^.]{0,100}"),
    ("publicTransport", r"\b(?:public transport|train station|bus stop|underground station|tube station|tram stop)\b[^.]{0,100}"),
    ("catering", r"\b(?:in[- ]house catering|external catering|catering available)\b[^.]{0,100}"),
    ("bar", r"\b(?:licensed bar|private bar|bar service)\b[^.]{0,100}"),
    ("kitchen", r"\b(?:commercial kitchen|catering kitchen|kitchen facilities)\b[^.]{0,100}"),
    ("avProduction", r"\b(?:AV equipment|audio[- ]visual equipment|production facilities|projector)\b[^.]{0,100}"),
    ("sound", r"\b(?:sound system|PA system|sound equipment)\b[^.]{0,100}"),
    ("lighting", r"\b(?:stage lighting|lighting rig|production lighting)\b[^.]{0,100}"),
    ("staging", r"\b(?:built[- ]in stage|raised stage|stage facilities|staging available|modular staging|stage equipment)\b[^.]{0,100}"),
    ("loadingAccess", r"\b(?:loading bay|loading access|load[- ]?in)\b[^.]{0,100}"),
    ("wifi", r"\b(?:wi[- ]?fi|wireless internet)\b[^.]{0,100}"),
    ("power", r"\b(?:three[- ]phase power|power outlets?|power supply)\b[^.]{0,100}"),
    ("outdoorSpace", r"\b((?:(?:sunny|heated|covered|enclosed)\s+)?(?:beer\s+)?(?:garden|terrace|courtyard|outdoor space))\b"),
    ("accommodation", r"\b(?:on[- ]site accommodation|hotel rooms?|bedrooms?)\b[^.]{0,100}"),
    ("cloakroom", r"\b(?:cloakroom|coat check)\b[^.]{0,100}"),
    ("hireSuitability", r"\b(?:available|suitable)\s+for\s+(?:weddings?|receptions?|corporate events?|conferences?|private events?|meetings?|exhibitions?)\b[^.]{0,100}"),
)
_BEFORE_NEGATED = r"(?i)\b(?:no|not|without|don['’]t|doesn['’]t|isn['’]t|aren['’]t|can['’]t|cannot|won['’]t)\s+(?:[a-z-]+\s+){0,4}$"
_NEGATED = r"(?i)\b(?:not (?:available|permitted|provided|allowed|accessible)|unavailable|closed)\b"
#: Sentences that state a capacity: (pattern, group of the layout or 0, groups of the count, least count). No
#: count is followed by the x of a dimension.
_NAMES = "banquet|reception|theatre|theater|standing|seated|classroom|cabaret|dinner|conference|boardroom"
_NUMBER = r"\d{1,3}(?:,\d{3})+|\d{1,5}"
_NO_DIMENSION = r"(?!\s{0,3}x\b)"
_BEDS = r"\b(?:cottages?|bedrooms?|overnight|sleeps?|beds?|tents?|glamping|accommodation|rooms? (?:are|is)? ?available)\b"
SENTENCES = (
    (rf"(?i)(?>\b({_NAMES})\s+(?:style\s*)?(?:capacity\s*)?[:\-]?\s*({_NUMBER})\b){_NO_DIMENSION}", 1, (2,), 2),
    (rf"(?i)(?>\bcapacity\s*(?:of|:|-)?\s*({_NUMBER})\s*({_NAMES})?\b){_NO_DIMENSION}", 2, (1,), 2),
    (rf"(?i)(?>\bup to\s*({_NUMBER})\s*(standing|seated|guests?|people)\b){_NO_DIMENSION}", 2, (1,), 2),
    (rf"(?i)(?>\b({_NUMBER})\s*(standing|seated)\b){_NO_DIMENSION}", 2, (1,), 10),
    (rf"(?i)(?>\b({_NAMES})\s+(?:sets?|set[- ]?ups?|layouts?)\s+(?:of\s+|up\s+)?(?:up\s+)?to\s*({_NUMBER})\b){_NO_DIMENSION}", 1, (2,), 2),
)
#: A verb of hosting states a capacity, of a range its upper end, unless beds are spoken of nearby.
HOSTING = (
    rf"(?is)(?<!{_BEDS}.{{0,45}})(?>\b(?:host|hosts|cater\s+for|caters\s+for|seat|seats|hold|holds)\s+(?:up\s+to\s+|between\s+)?({_NUMBER})(?:\s*(?:[-–—]|to|and)\s*({_NUMBER}))?\s+(?:guests?|people|delegates|persons|pax)\b)(?!.{{0,70}}{_BEDS})",
    0, (2, 1), 2,
)
_GAP = "␞"  # stands where an earlier sentence was read


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spaced(text: Column) -> Column:
    """White space as single spaces; a text that has no other is only looked through."""
    return F.regexp_replace(text, r"\s{2,}|[^\S ]", " ")


def _layout_text(text: Column) -> Column:
    return F.lower(F.trim(_spaced(F.translate(text, "():*", "    "))))


def _layout_named(value: Column) -> Column:
    out = None
    for pattern, name in LAYOUTS:
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(value.rlike(f"^(?:{'|'.join(p for p, _ in LAYOUTS)})$"), out)  # most texts are none, and one test tells


def layout_of(text: Column) -> Column:
    return F.when(text.rlike("[A-Za-z]"), _once(_layout_text(text), _layout_named))  # no layout is without a letter


def _count_told(text: Column) -> Column:
    digits = F.regexp_extract(F.trim(_spaced(text)), r"(?i)^(?:up to |max\.? )?(\d{1,3}(?:,\d{3})+|\d{1,6})(?: (?:guests|people|pax))?$", 1)
    return F.regexp_replace(digits, ",", "")


def _of_people(number: Column) -> Column:
    return F.when(number.between(1, 100_000), number)


def count_of(text: Column) -> Column:
    """A count of people from 1 to 100,000, with commas between thousands or without; null if the text is none."""
    counted = _once(_count_told(text), lambda digits: _of_people(told_number(digits)))
    return F.when(text.rlike("[0-9]") & counted.isNotNull(), counted)


def _space_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(_spaced(text), r"[*:]+$", ""))


def _space_named(value: Column, layout: Column | None) -> Column:
    known = layout_of(value) if layout is None else layout
    bad = (F.length(value) > 60) | ~value.rlike("^[A-Za-z0-9].*[A-Za-z]|^[A-Za-z]") | value.rlike(rf"(?i)^(?:{NO_SPACE})$") | (F.size(F.split(value, " ")) > 6) | value.rlike(r"[.!?]$") | known.isNotNull()
    return F.when((value != "") & ~bad, value)


def space_name(text: Column, layout: Column | None = None) -> Column:
    """The name of a space in a table's cell; null for a heading, a layout, a sentence, or over six words. `layout` is that of
    the text where it is known already."""
    return F.when(text.rlike("[A-Za-z]"), _once(_space_text(text), lambda value: _space_named(value, layout)))  # no space is without a letter


def read_cells(cells: DataFrame, text: str) -> DataFrame:
    """`cells` with each text replaced by what it names and counts, a struct (layout, count, space), as `layout_of`, `count_of` and
    `space_name` tell it. Steps are columns, which Spark compiles, where those of a list are interpreted."""
    letters = F.col(text).rlike("[A-Za-z]")
    made = cells.withColumns({"__layout": F.when(letters, _layout_text(F.col(text))), "__space": F.when(letters, _space_text(F.col(text))), "__digits": F.when(F.col(text).rlike("[0-9]"), _count_told(F.col(text)))})
    told = made.withColumns({"__layout": _layout_named(F.col("__layout")), "__number": told_number(F.col("__digits"))})
    named = told.withColumn("__space", _space_named(F.col("__space"), F.col("__layout")))
    whole = F.struct(F.col("__layout").alias("layout"), _of_people(F.col("__number")).alias("count"), F.col("__space").alias("space"))
    return named.withColumn(text, whole).drop("__layout", "__space", "__digits", "__number")


def facilities(text: Column) -> Column:
    """array<(field, statement, review)>: the first statement of each facility; one that is negated is for review."""
    found = []
    for field, pattern in FACILITIES:
        match = F.regexp_extract(text, f"(?is){pattern}", 0)
        ahead = F.substr(text, F.lit(1), F.position(match, text) - 1)
        sentence = F.regexp_extract(ahead, r"([^.!?\n]*)$", 1)
        negated = sentence.rlike(_BEFORE_NEGATED) | match.rlike(_NEGATED)
        statement = F.trim(F.regexp_replace(F.when(negated, F.concat(sentence, match)).otherwise(match), r"\s+", " "))
        found.append(F.when(match != "", F.struct(F.lit(field).alias("field"), statement.alias("statement"), negated.alias("review"))))
    return F.array_compact(F.array(*found))


def _stated(text: Column, pattern: str, layout: int, counts: tuple[int, ...], least: int) -> Column:
    def fact(m: Column) -> Column:
        name = F.lower(F.regexp_extract(m, pattern, layout)) if layout else F.lit("")
        kind = F.when(name.isin("", "guest", "guests", "people"), "unspecified").otherwise(F.replace(name, F.lit("theater"), F.lit("theatre")))
        told = F.coalesce(*[F.nullif(F.regexp_extract(m, pattern, c), F.lit("")) for c in counts])
        return F.struct(kind.alias("layout"), F.regexp_replace(told, ",", "").try_cast("int").alias("count"), F.trim(m).alias("statement"))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), fact), lambda f: f["count"].between(least, 100_000))


def sentences(text: Column) -> Column:
    """array<(layout, count, statement)> of the sentences that state a capacity, pattern after pattern; what one has read, a
    later one does not read again, apart from verbs of hosting, which are read in the whole text."""
    found, left = [], text
    for pattern, layout, counts, least in SENTENCES:
        found.append(_stated(left, pattern, layout, counts, least))
        left = F.regexp_replace(left, pattern, _GAP)
    return F.concat(*found, _stated(text, *HOSTING))


def table_rows(html: Column) -> Column:
    """array of tables of rows of cells' texts, for tables without tables inside."""
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|$)"), 1), cell)
    rows = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|$)"), 1), cells)
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), 1), rows)


def table_capacities(tables: DataFrame, rows_col: str = "rows") -> DataFrame:
    """`tables` with its rows of cells in `rows_col` replaced by (space, layout, count), a row a fact: layouts head the columns
    and spaces the rows, or the other way round; a table of two columns without a head gives layouts and counts of one space
    without a name. Each stage is a column of its own, so every cell is read once: what it names or counts, then the head,
    then the facts. The outer generator keeps the optimizer from testing for facts below these stages, by doing them again."""
    read = F.transform(F.col(rows_col), lambda r: F.transform(r, lambda c: _once(F.struct(c.alias("text"), layout_of(c).alias("layout"), count_of(c).alias("count")), lambda v: F.struct(v["layout"].alias("layout"), v["count"].alias("count"), space_name(v["text"], v["layout"]).alias("space")))))
    return table_facts(tables.withColumn(rows_col, read), rows_col)


def table_facts(tables: DataFrame, rows_col: str = "rows") -> DataFrame:
    """The same of rows of cells that are read already, see `read_cells`."""
    others = [c for c in tables.columns if c != rows_col]
    no_count = lambda r: F.forall(r, lambda c: c["count"].isNull())
    is_head = lambda r: F.exists(r, lambda c: c["layout"].isNotNull()) & F.exists(r, lambda c: c["count"].isNull()) & (no_count(r) | (F.size(r) > 2))
    cells = tables.select(*others, F.col(rows_col).alias("__cells"))
    headed = cells.withColumn("__at", F.array_position(F.transform("__cells", is_head), True).cast("int"))
    split = headed.withColumn("__head", F.try_element_at("__cells", F.nullif("__at", F.lit(0)))).withColumn("__body", F.slice("__cells", F.col("__at") + 1, F.greatest(F.size("__cells"), F.lit(0))))
    first = lambda r: F.get(r, F.lit(0))
    many = (F.size(F.filter("__head", lambda c: c["layout"].isNotNull())) <= 1) & (F.size(F.filter("__body", lambda r: first(r)["layout"].isNotNull())) >= 2)
    turned = split.withColumn("__turned", many)
    fact = lambda space, layout, count: F.struct(space.alias("space"), layout.alias("layout"), count.alias("count"))
    places = F.sequence(F.lit(1), F.greatest(F.size("__head") - 1, F.lit(1)))
    normal = lambda r, i: fact(first(r)["space"], F.get(F.col("__head"), i)["layout"], F.get(r, i)["count"])
    across = lambda r, i: fact(F.get(F.col("__head"), i)["space"], first(r)["layout"], F.get(r, i)["count"])
    grid = lambda each: F.filter(F.flatten(F.transform("__body", lambda r: F.transform(places, lambda i: each(r, i)))), lambda f: f["space"].isNotNull() & f["layout"].isNotNull() & f["count"].isNotNull())
    pair = F.transform(F.filter("__cells", lambda r: F.size(r) == 2), lambda r: fact(F.lit(None).cast("string"), first(r)["layout"], F.get(r, F.lit(1))["count"]))
    plain = F.filter(pair, lambda f: f["layout"].isNotNull() & f["count"].isNotNull())
    none = F.array().cast("array<struct<space:string,layout:string,count:int>>")
    facts = F.when(F.size("__cells") < 2, none).when(F.col("__at") == 0, plain).when(F.col("__turned"), grid(across)).otherwise(grid(normal))
    return turned.select(*others, F.inline_outer(facts)).filter("layout is not null")


def definitions(html: Column) -> Column:
    """array<(layout, count)> of definition lists, a term and what follows it."""
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    pair = r"(?is)<dt\b[^>]*>(.*?)</dt>\s*<dd\b[^>]*>(.*?)</dd>"
    each = F.transform(F.regexp_extract_all(html, F.lit(pair), 0), lambda m: F.struct(layout_of(text(F.regexp_extract(m, pair, 1))).alias("layout"), count_of(text(F.regexp_extract(m, pair, 2))).alias("count")))
    return F.filter(each, lambda f: f["layout"].isNotNull() & f["count"].isNotNull())
