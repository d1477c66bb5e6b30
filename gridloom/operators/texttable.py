"""Messy table texts to clean rows (M01-M20), for a table of texts (id, text) at once.

Lines are rows and cells are arrays; a text's layout is decided by expressions over its first eleven lines, which are the only ones
gathered. Lines, facts and rows are each written once to the shared folder, since every layout's branch reads them. A text may be larger than a
task: what looks at neighbouring lines works on stretches of ``SEGMENT`` lines, which see the edge lines of their neighbours, and numbers and
open records are carried over from stretch to stretch; only a row a stretch is ever ordered by text. ``parity=True`` keeps three habits of the spreadsheet that lose data: a leading tab is stripped, rank-only lines fall to the
title filter, and ranked rows don't start records. Null and blank texts, and one line without separator, give no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.types import pasted_number, strip
from gridloom.scratch import settle

HEAD = 11
#: Lines of a text that are ordered in one task.
SEGMENT = 1 << 16
#: Marks and words that the layout tests look for.
UNIT_MARKS = ("mi2", "km2", "/ mi2", "/ km2", "%", "°N", "°W", "°E", "°S", "[tonnes]", "[kg", "[m (ft)]", "[ft]", "(ft)", "(m)", "lbs")
MULTILINE_MARKS = ("[tonnes]", "[kg", "[m (ft)]", "[ft]", "(ft)", "(m)", "mi2", "km2", "%")
UNIT_ROW_MARKS = ("mi2", "km2", "ft", "m", "°", "%")
HEADER_WORDS = ("name", "rank", "title", "height", "floor", "city", "country", "year", "comment", "animal", "mass", "length")
SPANNING_WORDS = ("writer", "author", "creator")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FOOTNOTE, CELL_FOOTNOTE = r"\[[a-zA-Z0-9]+\]", r"\[[a-z]\]"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def filled(cells: Column) -> Column:
    """Count of non-blank cells."""
    return F.size(F.filter(cells, lambda c: strip(c) != ""))


def is_digits(text: Column, drop: str = "") -> Column:
    return (F.translate(text, drop, "") if drop else text).rlike(r"^\d+$")


def _first(cells: Column) -> Column:
    return strip(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))


def _ranklike(first: Column) -> Column:
    return is_digits(first) | ((F.length(first) <= 3) & is_digits(first, "."))


def is_header_row(cells: Column) -> Column:
    """Three cells with header words, or mostly text."""
    some = F.transform(F.filter(cells, lambda c: strip(c) != ""), strip)
    numeric = F.size(F.filter(some, lambda c: is_digits(c, ".,-")))
    text = F.size(some) - numeric
    words = F.size(F.filter(cells, lambda c: _any(F.lower(c), HEADER_WORDS)))
    return (words >= 3) | ((F.size(some) > 0) & (text > numeric) & (text >= F.size(some) * 0.6))


def clean_cell(cell: Column) -> Column:
    return strip(F.translate(F.regexp_replace(strip(cell), CELL_FOOTNOTE, ""), "−", "-"))


def padded(cells: Column, width: Column) -> Column:
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))), 1, width)


def _stretch(at: Column) -> Column:
    return F.greatest(F.floor(at / SEGMENT), F.lit(0)).cast("long")


def _numbered_by(rows: DataFrame, at: str, name: str) -> DataFrame:
    """``rows`` with ``name``: their numbers from 0 in the order of ``at`` in each text. Stretches are numbered alone, then shifted by the rows
    before them."""
    cut = rows.withColumn("seg", _stretch(F.col(at)))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = cut.groupBy("id", "seg").count().select("id", "seg", before.alias("shift"))  # a row a stretch
    numbered = cut.withColumn("place", F.row_number().over(Window.partitionBy("id", "seg").orderBy(at)) - 1).join(shifts, ["id", "seg"])
    return numbered.withColumn(name, (F.col("shift") + F.col("place"))).drop("seg", "shift", "place")


def _with_edges(rows: DataFrame, at: str, behind: int, ahead: int) -> DataFrame:
    """``rows`` with ``seg`` and ``own``: each stretch also gets the last ``behind`` rows of the one before it and the first ``ahead`` rows of the
    next, which are not its own. ``at`` counts from 0 without gaps."""
    seg, inner = _stretch(F.col(at)), F.pmod(F.col(at), F.lit(SEGMENT))
    copies = F.array_compact(F.array(seg, F.when((inner < ahead) & (seg > 0), seg - 1), F.when(inner >= SEGMENT - behind, seg + 1)))
    return rows.withColumn("seg", F.explode(copies)).withColumn("own", F.col("seg") == seg)


def _to_stretches(facts: DataFrame, lines: str = "n_rows") -> DataFrame:
    """A text's facts once for each of its stretches, so that a join with its lines has no hot key."""
    return facts.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), _stretch(F.greatest(F.col(lines) - 1, F.lit(0))))))


def lines_of(texts: DataFrame, parity: bool = False) -> DataFrame:
    """(id, n, line): kept lines from 0 of (id, text)."""
    edges = r"^\s+|\s+$" if parity else r"^[\n\r ]+|[\n\r ]+$"
    body = F.regexp_replace(F.coalesce("text", F.lit("")), edges, "")
    return kept_lines(texts.select("id", body.alias("body")).filter(strip(F.col("body")) != "").select("id", F.posexplode(F.split("body", "\n")).alias("at", "line")), parity)


def kept_lines(lines: DataFrame, parity: bool = False) -> DataFrame:
    """(id, n, line) of (id, at, line), at from 0 without gaps. A line without tab goes if one of the next two has one."""
    order, tab = Window.partitionBy("id", "seg").orderBy("at"), F.instr("line", "\t")
    ahead = F.greatest(F.coalesce(F.lead(tab, 1).over(order), F.lit(0)), F.coalesce(F.lead(tab, 2).over(order), F.lit(0)))
    title = (tab == 0) & (ahead > 0)
    if not parity:
        title = title & ~is_digits(strip(F.col("line")))
    marked = _with_edges(lines, "at", 0, 2).withColumn("title", title).filter("own and not title")
    return _numbered_by(marked.select("id", "at", "line"), "at", "n").select("id", "n", "line")


def rows_of(texts: DataFrame, parity: bool = False) -> DataFrame:
    """(id, n, cells, ne, separator, n_rows, max_cols) of (id, text)."""
    return cut_rows(lines_of(texts, parity))


def cut_rows(lines: DataFrame) -> DataFrame:
    """Lines (id, n, line) as cells, with what is known of their text."""
    widths = [F.max(F.size(F.split("line", c))).alias(n) for c, n in (("\t", "tabs"), (",", "commas"))]
    facts = lines.groupBy("id").agg(F.count("*").alias("n_rows"), F.max(F.when(F.col("n") == 0, F.col("line"))).alias("top"), *widths)
    separator = F.when(F.col("top").contains("\t"), "\t").when(F.col("top").contains(","), ",")
    facts = facts.withColumn("separator", separator).filter("separator is not null or n_rows > 1")
    facts = facts.withColumn("max_cols", F.when(F.col("separator") == "\t", F.col("tabs")).when(F.col("separator") == ",", F.col("commas")).otherwise(1)).drop("top", "tabs", "commas")
    rows = lines.withColumn("seg", _stretch(F.col("n"))).join(_to_stretches(facts), ["id", "seg"])
    cut = F.when(F.col("separator").isNull(), F.array("line")).when(F.col("separator") == "\t", F.split("line", "\t")).otherwise(F.split("line", ","))
    rows = rows.select("id", "n", F.transform(cut, strip).alias("cells"), "separator", "n_rows", "max_cols")
    return rows.withColumn("ne", filled(F.col("cells")))


def _varying(h: Column, n: int) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(F.slice(h, 1, n), filled), lambda k: k > 0)))


def _layout(h: Column) -> dict[str, Column]:
    """The layout tests over the first rows."""
    n = F.size(h)
    five, text_of = F.slice(h, 1, 5), lambda r: F.lower(F.array_join(r, " "))
    row0, row1 = F.get(h, F.lit(0)), F.get(h, F.lit(1))
    messy = (n >= 2) & (F.exists(F.slice(h, 1, 10), lambda r: F.exists(r, lambda c: c.rlike(FOOTNOTE))) | (_varying(h, 5) > 1) | F.exists(five, lambda r: F.exists(r, lambda c: _any(c, UNIT_MARKS))))
    after = F.slice(h, 2, 10)
    single = F.size(F.filter(after, lambda r: (filled(r) == 1) & _ranklike(_first(r))))
    multi = F.size(F.filter(after, lambda r: (filled(r) != 1) & (filled(r) >= filled(row0) - 2)))
    split = (n >= 4) & (filled(row0) >= 5) & (single >= 2) & (multi >= 2) & (F.abs(single - multi) <= 2)
    lines = (n >= 4) & (_varying(h, 5) > 1) & F.exists(five, lambda r: _any(text_of(r), MULTILINE_MARKS)) & F.exists(F.slice(h, 4, 4), lambda r: _ranklike(_first(r)))
    short = ~F.exists(F.filter(row1, lambda c: strip(c) != ""), lambda c: (F.length(strip(c)) > 50) | is_digits(strip(c), ".,-"))
    spanning = (n >= 3) & (filled(row0) >= 6) & (filled(row1) >= 2) & (filled(row1) < filled(row0) / 2) & short
    places = F.exists(F.slice(h, 4, 5), lambda r: F.exists(r, lambda c: _any(c, ("°N", "°S")) & _any(c, ("°W", "°E"))))
    units = F.exists(F.slice(h, 2, 3), lambda r: filled(r).between(1, 4) & _any(text_of(r), UNIT_ROW_MARKS))
    complex_ = (n >= 4) & (_varying(h, 4) >= 3) & (places | units)
    return {k: F.coalesce(v, F.lit(False)) for k, v in {"messy": messy, "split": split, "multiline": lines, "spanning": spanning, "complex": complex_}.items()}


def _numbered(width: Column, start: int = 0) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda k: F.concat(F.lit("Column_"), k.cast("string")))


def _fill_names(names: Column, width: Column) -> Column:
    """Names padded with Column_N, cut to the width."""
    return F.slice(F.concat(names, F.slice(_numbered(width), F.size(names) + 1, F.greatest(width - F.size(names), F.lit(0)))), 1, width)


def _spanning_header(h: Column, width: Column) -> Column:
    main, sub = F.get(h, F.lit(0)), F.get(h, F.lit(1))
    at = F.array_position(F.transform(main, lambda c: _any(F.lower(c), SPANNING_WORDS)), True)
    name = F.element_at(main, F.greatest(at, F.lit(1)).cast("int"))
    wide = F.transform(sub, lambda s, j: F.when(strip(s) != "", F.concat(name, F.lit(" - "), strip(s))).otherwise(F.concat(name, F.lit("_"), (j + 1).cast("string"))))
    expanded = F.concat(F.slice(main, 1, F.greatest(at - 1, F.lit(0)).cast("int")), wide, F.slice(main, (at + 1).cast("int"), F.size(main)))
    items = F.filter(F.transform(sub, lambda s, j: F.struct(strip(s).alias("s"), j.alias("j"))), lambda x: x["s"] != "")

    def put(acc: Column, x: Column) -> Column:
        p = F.least(F.least(F.lit(3), F.size(main)) + x["j"], F.size(acc))
        return F.concat(F.slice(acc, 1, p), F.array(x["s"]), F.slice(acc, p + 1, F.size(acc)))

    inserted = F.aggregate(items, main, put)
    return _fill_names(F.when(F.size(sub) < 2, main).when(at > 0, expanded).otherwise(inserted), width)


def _general_header(h: Column, width: Column) -> Column:
    four = F.slice(h, 1, 4)
    scored = F.transform(four, lambda r: F.size(F.filter(r, lambda c: (strip(c) != "") & ~is_digits(strip(c)))))
    best = F.element_at(four, F.array_position(scored, F.array_max(scored)).cast("int"))
    name = lambda c: strip(F.regexp_replace(strip(F.regexp_replace(strip(c), FOOTNOTE, "")), r"[^\p{L}\p{N}_\s()-]", "_"))
    named = F.transform(padded(best, width), lambda c, k: F.when(name(c) != "", name(c)).otherwise(F.concat(F.lit("Column_"), (k + 1).cast("string"))))
    return F.when(F.array_max(scored) > 0, named).otherwise(_numbered(width))


def _multiline_headers(rows: DataFrame) -> DataFrame:
    """(id, merged): for each column the first row's name with a bracketed unit from below, or the first name below."""
    cells = rows.filter("layout = 'multiline' and n < start").select("id", "n", "max_cols", F.get("head", F.lit(0)).alias("base"), F.posexplode(padded(F.col("cells"), F.col("max_cols"))).alias("k", "cell"))
    cells = cells.withColumn("base", F.coalesce(F.get("base", F.col("k")), F.lit(""))).filter((F.col("n") == 0) | (F.col("cell") != ""))
    below = F.col("n") > 0
    unit = below & (F.length("cell") <= 10) & F.col("cell").rlike(r"[\[\]()]") & ~F.contains("base", F.col("cell"))
    merged = cells.groupBy("id", "k", "base").agg(F.min_by("cell", F.when(unit, F.col("n"))).alias("unit"), F.min_by("cell", F.when(below, F.col("n"))).alias("fill"))
    text = F.when(F.col("base") == "", F.coalesce("fill", F.lit(""))).when((F.length("base") <= 15) & F.col("unit").isNotNull(), F.concat_ws(" ", "base", "unit")).otherwise(F.col("base"))
    name = strip(F.regexp_replace(text, FOOTNOTE, ""))
    named = merged.select("id", "k", F.when(name != "", name).otherwise(F.concat(F.lit("Column_"), (F.col("k") + 1).cast("string"))).alias("name"))
    return named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("all")).select("id", F.col("all.name").alias("merged"))


def _records(rows: DataFrame, parity: bool) -> DataFrame:
    """Records of spanning layouts: lines up to the next record's start are folded into one row."""
    first, second = _first(F.col("cells")), strip(F.coalesce(F.get("cells", F.lit(1)), F.lit("")))
    new = (F.col("ne") >= 3) & (F.length(first) > 2) & ~F.lower(first).rlike("^(co-|copyright)")
    new = new | ((F.col("ne") >= 2) & (F.size("cells") >= 2) & (_any(second, MONTHS) | second.rlike(r"\d")))
    if not parity:
        new = new | ((F.col("ne") >= 3) & is_digits(first))
    # a record is known by its first line; the last one of a stretch is open in the next
    marked = rows.filter("layout = 'spanning' and n >= 2").withColumn("starts", F.when(new, F.col("n"))).withColumn("seg", _stretch(F.col("n")))
    before = F.max("last").over(Window.partitionBy("id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    opened = marked.groupBy("id", "seg").agg(F.max("starts").alias("last")).select("id", "seg", before.alias("open"))  # a row a stretch
    within = F.max("starts").over(Window.partitionBy("id", "seg").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("within", within).join(opened, ["id", "seg"]).withColumn("record", F.coalesce("within", "open")).filter("record is not null")
    held = marked.groupBy("id", "record", "max_cols").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("n", "cells"))).alias("lines"))
    start = padded(F.get("lines", F.lit(0))["cells"], F.col("max_cols"))
    more = F.flatten(F.transform(F.slice("lines", 2, F.size("lines")), lambda x: F.filter(F.transform(x["cells"], lambda c, j: F.struct(j.alias("j"), strip(c).alias("c"))), lambda y: y["c"] != "")))

    def put(acc: Column, x: Column) -> Column:
        at = F.least(filled(acc) + x["j"], F.size(acc) - 1)
        return F.transform(acc, lambda c, k: F.when(k != at, c).when(strip(c) != "", F.concat(c, F.lit("; "), x["c"])).otherwise(x["c"]))

    return held.select("id", "n", F.aggregate(more, start, put).alias("cells"))


def parse_tables(texts: DataFrame, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (id, row_no, cells) from 0, the header row first where there is one, and for each text (id, layout, has_headers, separator,
    num_rows, num_cols, is_messy)."""
    return parse_rows(rows_of(texts, parity), parity)


def parse_lines(lines: DataFrame, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same for texts that come as lines (id, at, line), at from 0 without gaps and no blank lines at either end: texts of any length."""
    return parse_rows(cut_rows(kept_lines(lines, parity)), parity)


def parse_rows(rows: DataFrame, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = settle(rows, "text-rows")
    wide = F.col("ne") >= F.col("max_cols") * 0.6
    first = _first(F.col("cells"))
    solid = (F.col("n") >= 2) & (F.col("ne") >= F.size("cells") * 0.5) & (is_digits(first) | (F.length(first) > 3) | F.exists(F.slice("cells", 1, 3), lambda c: F.length(strip(c)) > 2))
    facts = rows.groupBy("id", "separator", "n_rows", "max_cols").agg(
        F.sort_array(F.collect_list(F.when(F.col("n") < HEAD, F.struct("n", "cells")))).alias("head"), F.min(F.when(is_digits(first) & wide, F.col("n"))).alias("ranked"), F.min(F.when(solid, F.col("n"))).alias("solid")
    )
    facts = facts.withColumn("head", F.col("head.cells"))
    facts = facts.withColumns({f"is_{k}": v for k, v in _layout(F.col("head")).items()})
    layout = F.when(F.col("n_rows") < 2, "single")
    for name in ("split", "spanning", "multiline", "complex", "messy"):
        layout = layout.when(F.col(f"is_{name}"), name)
    start = F.when(F.col("layout") == "multiline", F.when(F.col("ranked") > 0, F.col("ranked")).otherwise(F.greatest(F.lit(3), F.floor(F.col("n_rows") / 2)))).when(
        F.col("layout") == "complex", F.coalesce("solid", F.greatest(F.lit(2), F.floor(F.col("n_rows") / 4)))
    )
    facts = settle(facts.withColumn("layout", layout.otherwise("plain")).withColumn("start", start.cast("int")), "text-facts")
    known = _to_stretches(facts.select("id", "layout", "start", "head", "n_rows")).drop("n_rows")
    every = rows.withColumn("seg", _stretch(F.col("n"))).join(known, ["id", "seg"]).drop("seg")
    clean = F.transform(padded(F.col("cells"), F.col("max_cols")), clean_cell)

    found = {r.layout for r in facts.select("layout").distinct().collect()}  # seven at most; only their branches are planned
    # plain and single: padded; messy, multiline, complex: cleaned rows from the start on
    parts = [every.filter("layout in ('plain', 'single')").select("id", "n", padded(F.col("cells"), F.col("max_cols")).alias("cells"))]
    if found & {"messy", "multiline", "complex"}:
        parts.append(every.filter("layout = 'messy' or (layout in ('multiline', 'complex') and n >= start)").select("id", "n", clean.alias("cells")).filter(filled(F.col("cells")) > 0))
    if "split" in found:  # a rank line and the line behind it are one row
        rank = (F.col("n") > 0) & (F.col("ne") == 1) & is_digits(first)
        order = Window.partitionBy("id", "seg").orderBy("n")
        pairs = _with_edges(every.filter("layout = 'split'"), "n", 1, 1).withColumn("joins", rank & (F.coalesce(F.lead("ne").over(order), F.lit(0)) >= 3)).withColumn("gone", F.coalesce(F.lag("joins").over(order), F.lit(False))).withColumn("after", F.lead("cells").over(order))
        merged = F.when(F.col("joins"), F.concat(F.array(first), F.col("after"))).otherwise(F.col("cells"))
        parts.append(pairs.filter("own and not gone").select("id", "n", F.when(F.col("n") == 0, F.col("cells")).otherwise(padded(merged, F.col("max_cols"))).alias("cells")))
    if "spanning" in found:
        parts.append(_records(every, parity))
    # headers made from several lines come first
    for name, header in (("spanning", _spanning_header), ("complex", _general_header)):
        if name in found:
            parts.append(facts.filter(F.col("layout") == name).select("id", F.lit(-1).alias("n"), header(F.col("head"), F.col("max_cols")).alias("cells")))
    if "multiline" in found:
        parts.append(_multiline_headers(every).select("id", F.lit(-1).alias("n"), F.col("merged").alias("cells")))
    body = parts[0]
    for part in parts[1:]:
        body = body.unionByName(part)
    body = settle(body.select("id", F.col("n").cast("long").alias("n"), "cells"), "text-tables")
    final = _numbered_by(body, "n", "row_no").select("id", F.col("row_no").cast("int").alias("row_no"), "cells")

    two = final.filter("row_no < 2").groupBy("id").agg(F.max(F.when(F.col("row_no") == 0, F.struct("cells"))).alias("a"), F.max(F.when(F.col("row_no") == 1, F.struct("cells"))).alias("b"))
    counts = body.groupBy("id").agg(F.count("*").alias("num_rows"))
    digits = lambda r: F.size(F.filter(r, lambda c: is_digits(c, ".-")))
    a, b = F.col("a.cells"), F.col("b.cells")
    plain_header = (digits(a) < digits(b)) & (digits(a) < F.size(a) * 0.5)
    has = (
        F.when(F.col("layout").isin("single", "spanning", "multiline", "complex"), True)
        .when(F.col("layout") == "split", is_header_row(a))
        .when(F.col("layout") == "messy", (F.col("num_rows") > 1) & is_header_row(a))
        .otherwise(plain_header)
    )
    meta = facts.join(counts, "id", "left").join(two, "id", "left").select("id", "layout", F.coalesce(has, F.lit(False)).alias("has_headers"), "separator", F.coalesce("num_rows", F.lit(0)).alias("num_rows"), F.col("max_cols").alias("num_cols"), F.col("is_messy"))
    return final, meta


def long_cells(rows: DataFrame, meta: DataFrame, use_header: bool = True) -> DataFrame:
    """(id, row_no, col_no, header, cell, num): data rows from 0. Without headers, and for blank ones, the name is Column_N; a name that
    repeats gets its place behind it. Blank cells are null."""
    flagged = rows.join(meta.select("id", (F.col("has_headers") & F.lit(use_header)).alias("named")), "id")
    cells = flagged.select("id", "row_no", "named", F.posexplode("cells").alias("col_no", "cell"))
    top = cells.filter("row_no = 0")
    name = F.when(F.col("named") & (strip(F.col("cell")) != ""), F.col("cell")).otherwise(F.concat(F.lit("Column_"), (F.col("col_no") + 1).cast("string")))
    again = F.row_number().over(Window.partitionBy("id", "name").orderBy("col_no"))
    heads = top.select("id", "col_no", name.alias("name")).withColumn("again", again)
    heads = heads.select("id", "col_no", F.when(F.col("again") > 1, F.concat("name", F.lit("_"), F.col("again").cast("string"))).otherwise(F.col("name")).alias("header"))
    data = cells.filter("row_no > 0 or not named").withColumn("row_no", F.col("row_no") - F.col("named").cast("int"))
    value = F.nullif(F.col("cell"), F.lit(""))
    return data.join(heads, ["id", "col_no"], "left").select("id", "row_no", "col_no", F.coalesce("header", F.concat(F.lit("Column_"), (F.col("col_no") + 1).cast("string"))).alias("header"), value.alias("cell"), pasted_number(value).alias("num"))


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of each text as lines, cells over 12 characters cut to 9 and dots."""
    short = F.transform("cells", lambda c: F.when(F.length(c) > 12, F.concat(F.substring(c, 1, 9), F.lit("..."))).otherwise(c))
    return rows.filter(F.col("row_no") < n).select("id", "row_no", F.array_join(short, " | ").alias("line"))


def to_frame(cells: DataFrame, text_id, headers: list[str]) -> DataFrame:
    """One text's cells as a wide table of texts with the given headers."""
    wide = cells.filter(F.col("id") == text_id).groupBy("row_no").pivot("header", headers).agg(F.first("cell"))
    return wide.orderBy("row_no")
