"""From page layout to typed elements.

Tables: blocks (doc, page, block_ord, block_kind, x0, y0, x1, y1, text), spans (doc, page, block_ord, line, span, text,
font, size, flags) and grids (doc, page, finder, table_ord, cells array<array<string>>, x0, y0, x1, y1). Everything is
keyed by document and page; only the section path looks over a whole document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.config import LAYOUT, Layout
from docquarry.functions.text import SPACE, stem, stripped
from docquarry.sources.files import cut

PAGE = ["doc", "page"]


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of text with reading_ord: by rows of 5 points (halves to the even row), then from left to right."""
    order = Window.partitionBy(*PAGE).orderBy(F.rint(F.col("y0") / 5.0) * 5.0, "x0", "block_ord")
    return blocks.where("block_kind = 0").withColumn("reading_ord", F.row_number().over(order))


def is_header_or_footer(text: Column, config: Layout = LAYOUT) -> Column:
    """Empty, or a running header or footer."""
    clean = stripped(F.regexp_replace(text, f"{SPACE}+", " "))
    # one pattern, so that a text is cleaned once and not for each of them
    return clean.rlike("(?i)" + "|".join(f"(?:{p})" for p in ("^$", *config.header_footer)))


def is_code_font(font: Column, config: Layout = LAYOUT) -> Column:
    """A monospaced font, by its name."""
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(font, F.lit(""))).contains(w) for w in config.code_fonts])


def lines_of(text: Column) -> Column:
    """The lines of a text that aren't blank, stripped."""
    return F.filter(F.transform(F.split(stripped(text), "\n"), stripped), lambda x: x != "")


def is_valid_grid(cells: Column, config: Layout = LAYOUT) -> Column:
    """Rows enough, cells filled enough and none too long, and a header of two cells at least."""
    strip = lambda row: F.transform(row, lambda c: stripped(F.coalesce(c, F.lit(""))))
    every = F.transform(F.flatten(cells), lambda c: stripped(F.coalesce(c, F.lit(""))))
    filled = F.filter(every, lambda c: c != "")
    header = F.filter(strip(cells[0]), lambda c: c != "")
    ok = (F.size(cells) >= config.min_rows) & (F.size(filled) > 0) & (F.size(filled) / F.size(every) >= config.min_filled)
    return F.coalesce(ok & (F.array_max(F.transform(filled, F.length)) <= config.max_cell) & (F.size(header) >= config.min_cols), F.lit(False))


def clean_cells(cells: Column) -> Column:
    """Cells without nulls, stripped, white space collapsed."""
    clean = lambda c: F.regexp_replace(stripped(F.coalesce(c, F.lit(""))), f"{SPACE}+", " ")
    return F.transform(cells, lambda row: F.transform(row, clean))


def markdown_table(headers: Column, rows: Column, n: Column) -> Column:
    """A Markdown table: | escaped, empty headers as Col i, rows padded or cut to n cells."""
    safe = lambda c: F.regexp_replace(c, r"\|", r"\\|")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = line(F.transform(headers, lambda h, i: F.when(h == "", F.concat(F.lit("Col "), (i + 1).cast("string"))).otherwise(safe(h))))
    body = F.transform(rows, lambda r: line(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), F.lit(1), n), safe)))
    return F.array_join(F.concat(F.array(head, line(F.array_repeat(F.lit("---"), n))), body), "\n")


def grid_tables(grids: DataFrame, config: Layout = LAYOUT) -> DataFrame:
    """Valid grids of each page: those of finder 1, else those of finder 2; with headers, rows, n_rows, n_cols, markdown."""
    good = grids.where(is_valid_grid(F.col("cells"), config))
    first = good.where("finder = 1")
    second = good.where("finder = 2").join(first.select(*PAGE).distinct(), PAGE, "left_anti")
    cells = clean_cells(F.col("cells"))
    out = first.unionByName(second).withColumn("headers", cells[0]).withColumn("rows", F.slice(cells, F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))))
    return out.withColumn("n_cols", F.size("headers")).withColumn("n_rows", F.size("rows")).withColumn("markdown", markdown_table(F.col("headers"), F.col("rows"), F.col("n_cols")))


def coverage(blocks: DataFrame, tables: DataFrame, config: Layout = LAYOUT) -> DataFrame:
    """doc, page, reading_ord, table_ord: blocks of which a table covers more than a share of their area."""
    t = tables.select(*PAGE, "table_ord", *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    side = lambda a: F.greatest(F.lit(0.0), F.least(F.col(f"{a}1"), F.col(f"t{a}1")) - F.greatest(F.col(f"{a}0"), F.col(f"t{a}0")))
    area = F.greatest(F.lit(1e-5), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return blocks.join(t, PAGE).where(side("x") * side("y") / area > config.covered).select(*PAGE, "reading_ord", "table_ord")


def table_runs(blocks: DataFrame, covered: DataFrame, config: Layout = LAYOUT) -> DataFrame:
    """Runs of two or more blocks with the same 3 to 8 lines, each a table: doc, page, first (reading_ord of its first
    block), until (that of the next block outside), headers, rows, markdown and the box.

    Blocks without headers and footers fall into islands of equal line counts. A run starts at its island's first block
    that no grid covers and takes the rest of the island, covered or not."""
    flagged = blocks.join(covered.select(*PAGE, "reading_ord", F.lit(True).alias("covered")).distinct(), [*PAGE, "reading_ord"], "left")
    body = flagged.where(~is_header_or_footer(F.col("text"), config)).withColumn("lines", lines_of(F.col("text"))).withColumn("n", F.size("lines"))
    order = Window.partitionBy(*PAGE).orderBy("reading_ord")
    island = F.sum(F.when(F.lag("n").over(order) == F.col("n"), 0).otherwise(1)).over(order)
    body = body.withColumn("island", island).withColumn("until", F.lead("reading_ord").over(order))
    inside = Window.partitionBy(*PAGE, "island").orderBy("reading_ord")
    kept = body.where("n between 3 and 8").withColumn("open", F.max(F.col("covered").isNull().cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("open = 1")
    rows = kept.groupBy(*PAGE, "island").agg(F.array_sort(F.collect_list(F.struct("reading_ord", "lines"))).alias("x"), F.min("reading_ord").alias("first"), F.max_by("until", "reading_ord").alias("until"), F.min_by("x0", "reading_ord").alias("x0"), F.min_by("y0", "reading_ord").alias("y0")).where("size(x) >= 2")
    last = blocks.groupBy(*PAGE).agg(F.max("reading_ord").alias("last"))
    rows = rows.join(last, PAGE).withColumn("until", F.coalesce("until", F.col("last") + 1))
    ends = blocks.select(*PAGE, (F.col("reading_ord") + 1).alias("until"), "x1", "y1")
    lines = F.transform("x", lambda r: r["lines"])
    rows = rows.join(ends, [*PAGE, "until"]).withColumn("headers", lines[0]).withColumn("rows", F.slice(lines, F.lit(2), F.size("x") - 1))
    return rows.withColumn("markdown", markdown_table(F.col("headers"), F.col("rows"), F.size("headers"))).select(*PAGE, "first", "until", "headers", "rows", F.size("rows").alias("n_rows"), F.size("headers").alias("n_cols"), "markdown", "x0", "y0", "x1", "y1")


def span_stats(spans: DataFrame, config: Layout = LAYOUT) -> DataFrame:
    """Per block: max_size, bold, mono_chars, total_chars and annotated, its lines joined by a space with spans of code in
    backticks. Empty spans don't count."""
    real = spans.where("text <> ''").withColumn("mono", is_code_font(F.col("font"), config))
    short = stripped(F.col("text"))
    piece = F.when(F.col("mono") & (F.length(short) > 1), F.concat(F.lit("`"), short, F.lit("` "))).otherwise(F.col("text"))
    bold = (F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(config.bold_mask) != 0) | F.lower(F.coalesce(F.col("font"), F.lit(""))).contains("bold")
    size = F.coalesce(F.col("size"), F.lit(10.0))
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    lines = real.select(*PAGE, "block_ord", "line", "span", piece.alias("piece"), "mono", F.length("text").alias("n"), size.alias("size"), bold.alias("bold"))
    lines = lines.groupBy(*PAGE, "block_ord", "line").agg(F.array_join(F.transform(ordered("span", "piece"), lambda x: x["piece"]), "").alias("text"), F.max("size").alias("size"), F.bool_or("bold").alias("bold"), F.sum(F.when(F.col("mono"), F.col("n")).otherwise(0)).alias("mono"), F.sum("n").alias("n"))
    return lines.groupBy(*PAGE, "block_ord").agg(F.max("size").alias("max_size"), F.bool_or("bold").alias("bold"), F.sum("mono").alias("mono_chars"), F.sum("n").alias("total_chars"), F.array_join(F.transform(ordered("line", "text"), lambda x: x["text"]), " ").alias("annotated"))


def is_code(text: Column, total: Column, mono: Column) -> Column:
    """Over 20 characters, more than three quarters of them monospaced; or more than one line after a plain sign of code."""
    # Plain signs of code.
    prefix = reduce(lambda a, b: a | b, [text.startswith(p) for p in ("# Tool schema", "def ", "class ", "import ", "# LCEL", "curl ")], text.contains("TOOL_SCHEMA ="))
    return ((total > 20) & (mono / F.greatest(total, F.lit(1)) > 0.75)) | (prefix & (F.size(lines_of(text)) > 1))


def code_language(text: Column) -> Column:
    """python if the text has one of its signs, else text."""
    # Signs of Python.
    return F.when(reduce(lambda a, b: a | b, [text.contains(k) for k in ("def ", "class ", "import ", "TOOL_SCHEMA", "#")]), "python").otherwise("text")


def is_heading(text: Column, size: Column, bold: Column, config: Layout = LAYOUT) -> Column:
    """Large and bold, or numbered like a section."""
    # Fixed value: the pattern of numbered headings, with white space and digits as Python has them, since Java's are ASCII.
    return ((size >= config.heading_size) & bold) | text.rlike(rf"^(SECTION{SPACE}+[0-9]+|S{SPACE}+E{SPACE}+C{SPACE}+T{SPACE}+I{SPACE}+O{SPACE}+N{SPACE}+[0-9]+|[0-9]+(\.[0-9]+)*{SPACE}+[A-Z])")


def heading_rank(title: Column, size: Column) -> Column:
    """1 from 14 points on or with the word SECTION, 2 from 12, else 3."""
    return F.when((size >= 14.0) | F.upper(title).contains("SECTION"), 1).when(size >= 12.0, 2).otherwise(3)


def classified(blocks: DataFrame, stats: DataFrame, config: Layout = LAYOUT) -> DataFrame:
    """Blocks with element_type (code, then heading, then paragraph), content, title and rank (of headings), language."""
    b = blocks.join(stats, [*PAGE, "block_ord"], "left").withColumn("text", stripped(F.col("text")))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    code = is_code(F.col("text"), zero("total_chars", 0), zero("mono_chars", 0))
    b = b.withColumn("element_type", F.when(code, "code").when(is_heading(F.col("text"), zero("max_size", 0.0), zero("bold", False), config), "heading").otherwise("paragraph"))
    head = F.col("element_type") == "heading"
    b = b.withColumn("title", F.when(head, stripped(F.regexp_replace("text", f"{SPACE}+", " ")))).withColumn("language", F.when(F.col("element_type") == "code", code_language(F.col("text"))))
    b = b.withColumn("rank", F.when(head, heading_rank(F.col("title"), zero("max_size", 0.0))))
    prose = F.when(zero("annotated", "") != "", F.col("annotated")).otherwise(F.col("text"))
    content = F.when(F.col("element_type") == "code", F.concat(F.lit("```"), F.col("language"), F.lit("\n"), F.col("text"), F.lit("\n```")))
    content = content.when(head, F.concat(F.repeat(F.lit("#"), F.col("rank")), F.lit(" "), F.col("title"))).otherwise(stripped(F.regexp_replace(prose, r"[ \t]+", " ")))
    return b.withColumn("content", content)


def section_path(elements: DataFrame, order: list[str]) -> DataFrame:
    """elements with section: Introduction until a heading; one of rank 1 starts anew, another is appended with ' > '.

    A part reaches from one heading of rank 1 to the next. Its titles are gathered once, and each element takes as many of
    them as came up to it, so no row carries a list of its own."""
    sofar = Window.partitionBy("doc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = elements.withColumn("part", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(sofar))
    rows = rows.withColumn("passed", F.count("title").over(Window.partitionBy("doc", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    titles = rows.where("title is not null").groupBy("doc", "part").agg(F.array_sort(F.collect_list(F.struct("passed", "title"))).alias("titles"))
    titles = titles.select("doc", "part", F.transform("titles", lambda t: t["title"]).alias("titles"))
    start = F.when(F.col("part") == 0, F.array(F.lit("Introduction"))).otherwise(F.array().cast("array<string>"))
    path = F.concat(start, F.slice(F.coalesce("titles", F.array().cast("array<string>")), F.lit(1), F.col("passed")))
    return rows.join(titles, ["doc", "part"], "left").withColumn("section", F.array_join(path, " > ")).drop("part", "passed", "titles")


def placements(text: DataFrame, tables: DataFrame, covered: DataFrame, runs: DataFrame) -> DataFrame:
    """tables with at, the first block each covers that no run has taken (null if there is none)."""
    spent = text.join(runs.select(*PAGE, "first", "until"), PAGE).where("reading_ord >= first and reading_ord < until").select(*PAGE, "reading_ord")
    places = covered.join(spent, [*PAGE, "reading_ord"], "left_anti").groupBy(*PAGE, "table_ord").agg(F.min("reading_ord").alias("at"))
    return tables.join(places, [*PAGE, "table_ord"], "left")


def elements(blocks: DataFrame, spans: DataFrame, grids: DataFrame, config: Layout = LAYOUT) -> DataFrame:
    """doc, page, ord, id, element_type, content, section, n_rows, n_cols, headers, language, level, font_size, box.

    A block that a grid covers gives way to the grid, which stands at its first such block; a grid that covers none comes
    at the page's end. Blocks within a run belong to the run's table and don't place a grid."""
    # each of these is read several times below
    text = cut(text_blocks(blocks), "blocks")
    tables = cut(grid_tables(grids, config), "tables")
    covered = cut(coverage(text, tables, config), "covered")
    runs = cut(table_runs(text, covered, config), "runs")
    spent = text.join(runs.select(*PAGE, "first", "until"), PAGE).where("reading_ord >= first and reading_ord < until").select(*PAGE, "reading_ord")
    free = text.join(spent, [*PAGE, "reading_ord"], "left_anti")
    end = F.lit(1 << 30)
    none = lambda kind: F.lit(None).cast(kind)
    box = F.struct("x0", "y0", "x1", "y1").alias("box")
    table = lambda df, at, sub: df.select(*PAGE, at.alias("at"), sub.alias("sub"), F.lit("table").alias("element_type"), F.col("markdown").alias("content"), none("string").alias("title"), none("int").alias("rank"), "n_rows", "n_cols", "headers", none("string").alias("language"), none("double").alias("font_size"), box)
    grid_rows = table(placements(text, tables, covered, runs), F.coalesce("at", end), F.col("table_ord"))
    run_rows = table(runs, F.col("first"), F.lit(0))
    plain = free.join(covered.select(*PAGE, "reading_ord").distinct(), [*PAGE, "reading_ord"], "left_anti").where(~is_header_or_footer(F.col("text"), config))
    plain = classified(plain, span_stats(spans, config), config)
    size = F.when(F.col("element_type") != "code", F.coalesce("max_size", F.lit(0.0)))
    block_rows = plain.select(*PAGE, F.col("reading_ord").alias("at"), F.lit(0).alias("sub"), "element_type", "content", "title", "rank", none("int").alias("n_rows"), none("int").alias("n_cols"), none("array<string>").alias("headers"), "language", size.alias("font_size"), box)
    order = ["page", "at", "sub"]
    every = section_path(grid_rows.unionByName(run_rows).unionByName(block_rows), order)
    ord_ = F.row_number().over(Window.partitionBy("doc").orderBy(*order))
    level = F.when(F.col("element_type") == "heading", F.length("content") - F.length(F.replace("content", F.lit("#"), F.lit(""))))
    every = every.withColumn("ord", ord_).withColumn("level", level).withColumn("id", F.format_string("%s_p%d_e%d", stem(F.col("doc")), "page", "ord"))
    return every.select("doc", "page", "ord", "id", "element_type", "content", "section", "n_rows", "n_cols", "headers", "language", "level", "font_size", "box")


def doc_statistics(els: DataFrame) -> DataFrame:
    """Per document: headings, paragraphs, tables, code_blocks."""
    count = lambda kind: F.count_if(F.col("element_type") == kind)
    return els.groupBy("doc").agg(count("heading").alias("headings"), count("paragraph").alias("paragraphs"), count("table").alias("tables"), count("code").alias("code_blocks"))


def full_markdown(els: DataFrame) -> DataFrame:
    """Per document its Markdown: the name, a comment where a page begins, the contents in order."""
    page_before = F.lag("page", 1, 0).over(Window.partitionBy("doc").orderBy("ord"))
    mark = F.when(F.col("page") != page_before, F.format_string("\n<!-- Page %d -->\n\n", "page")).otherwise("")
    piece = els.select("doc", "ord", F.concat(mark, F.col("content"), F.lit("\n")).alias("piece"))
    rows = piece.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("x"))
    return rows.select("doc", F.concat_ws("\n", F.concat(F.lit("# "), stem(F.col("doc")), F.lit("\n")), F.transform("x", lambda r: r["piece"])).alias("markdown"))
