"""Headers by rules, their place in a document, and the sections they open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import sweeps
from . import likeness

# A contents line, and the header rules in their order.
TOCY = r"(?i)\.{2,}\s*(\d{1,4}|[ivxlcdm]{1,8})\s*$"
RULES = (
    r"^\s*(Appendix\s+[A-Z]\b.*)$",
    r"^\s*([A-Z]?\d+(?:\.\d+){0,4}\s+[^\.\n]{1,120})\s*$",
    r"^\s*([A-Z][A-Z0-9][A-Z0-9 \-\(\)/,&]{3,80})\s*$",
)
#: Levels that a tree tells apart.
LEVELS = 6
#: Lines of a document that are matched in one pass; a longer one is read in blocks.
BLOCK = 1 << 20
#: What a rule counts for beside a line's place.
RANK = 1 << 60


def rule_headers(lines: DataFrame, *kept: str) -> DataFrame:
    """file_id, ord, position (from 1), section_number, section_name from ``lines`` (file_id, ord, line), and the columns ``kept``.

    A line's first matching rule gives its title; a title counts once in a document, case aside. Without a number of its own a
    header is numbered by its position.
    """
    # Bound by generators, the stripped line and its title are made once, whatever asks for them.
    s = F.col("s")
    titles = (F.nullif(F.trim(F.regexp_extract(s, r, 1)), F.lit("")) for r in RULES)
    bound = lines.select("file_id", "ord", *kept, F.explode(F.array(T.strip(F.col("line")))).alias("s"))
    titled = bound.select("file_id", "ord", *kept, "s", F.explode(F.array(F.coalesce(*titles))).alias("title"))
    named = (
        titled.where(F.col("title").isNotNull() & ~s.rlike(TOCY))
        .select("file_id", "ord", *kept, "title", F.lower("title").alias("low"))
        # By document, of which one exchange is enough, or none where lines already are by document.
        .withColumn("before", F.lag("low").over(W.partitionBy("file_id").orderBy("low", "ord")))
        .where("before is null or before <> low")
        .withColumn("position", F.row_number().over(W.partitionBy("file_id").orderBy("ord")))
    )
    own = F.col("title").rlike(T.SECTION_LINE)
    return named.select(
        "file_id",
        "ord",
        "position",
        F.when(own, F.regexp_extract("title", T.SECTION_LINE, 1)).otherwise(F.col("position").cast("string")).alias("section_number"),
        F.when(own, T.strip(F.regexp_extract("title", T.SECTION_LINE, 2))).otherwise(F.col("title")).alias("section_name"),
        *kept,
    )


def header_block(headers: DataFrame) -> DataFrame:
    """file_id, block: a document's headers between fences, one a line."""
    line = F.trim(F.concat_ws(" ", "section_number", "section_name"))
    rows = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    body = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    return headers.groupBy("file_id").agg(F.concat(F.lit("#headers#\n"), body, F.lit("\n#headers#")).alias("block"))


def parse_header_block(blocks: DataFrame) -> DataFrame:
    """file_id, at, section_number, section_name: the numbered lines between the fences."""
    body = F.regexp_extract("block", r"(?is)#headers#(.*?)(?:#headers#|#headers_end#)", 1)
    each = blocks.select("file_id", F.posexplode(F.transform(T.lines(body), T.strip)).alias("at", "line")).where(F.col("line").rlike(T.SECTION_LINE))
    return each.select(
        "file_id",
        "at",
        F.regexp_extract("line", T.SECTION_LINE, 1).alias("section_number"),
        T.strip(F.regexp_extract("line", T.SECTION_LINE, 2)).alias("section_name"),
    )


def _folded(headers: DataFrame) -> list[Column]:
    """A header's key, number and name as lines are folded, and the header itself."""
    key, number, name = (T.fold_spaces(F.coalesce(c, F.lit(""))) for c in (F.concat_ws(" ", "section_number", "section_name"), F.col("section_number"), F.col("section_name")))
    return [key.alias("key"), number.alias("number"), name.alias("name"), F.struct(*headers.columns).alias("head")]


def located(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """``headers`` with ``start``, the ord of the first line that fits, and ``n``, the document's lines up to its last ord.

    A line fits by number and name in front, by number in front and the name anywhere, or by the name anywhere, in this order; start is null if none
    does, n if the document has no lines.
    """
    # A header's own columns go along, so that headers are made once and not joined to what was found.
    heads = headers.select("file_id", F.monotonically_increasing_id().alias("id"), *_folded(headers))
    body = lines.select("file_id", "ord", T.fold_spaces(F.col("line")).alias("line"))
    met = sweeps.first_fits(heads, body, BLOCK)
    best = met.groupBy("file_id", "id", "head").agg(F.min(F.col("rule") * RANK + F.col("ord")).alias("best"), F.max("n").alias("n"))
    kind = lines.schema["ord"].dataType
    return best.select("head.*", (F.col("best") % RANK).cast(kind).alias("start"), F.col("n").cast(kind).alias("n"))


def sections(headers: DataFrame, lines: DataFrame, *kept: str, texts: bool = False, alike: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """``headers`` with ``start`` as ``located``, or with ``alike`` as ``located_by_likeness``, and ``stop`` as ``bounded`` has it, the columns ``kept`` of the
    line at the start, and on demand ``section_text``, null without lines.

    A document is one pass, and lines that are by document already aren't exchanged. Documents of over ``BLOCK`` lines are few: they are told
    beforehand, by ``sizes`` (file_id, ord) where that is given and costs less than ``lines``, and go by blocks and joins.
    """
    kind = lines.schema["ord"].dataType
    far = F.broadcast((lines if sizes is None else sizes).where(F.col("ord") >= BLOCK).select("file_id").distinct())
    columns = [*headers.columns, "start", "stop", *kept, *(["section_text"] if texts else [])]
    heads, body = (rows.join(far, "file_id", "left_anti") for rows in (headers, lines))
    folded = body.select("file_id", "ord", T.fold_spaces(F.col("line")).alias("folded"), "line", *kept)
    made = sweeps.sections(heads.select("file_id", *_folded(heads)), folded, list(kept), texts, likeness.nearest if alike else None)
    near = made.select("head.*", *(F.col(c).cast(kind).alias(c) for c in ("start", "stop")), *kept, *(["section_text"] if texts else []))
    heads, body = (rows.join(far, "file_id", "left_semi") for rows in (headers, lines))
    found = located(heads, body)
    long = bounded(located_by_likeness(found, body) if alike else found)
    if kept:
        long = long.join(body.select("file_id", F.col("ord").alias("start"), *kept), ["file_id", "start"], "left")
    if texts:
        long = long.join(section_texts(long, body), ["file_id", "position"], "left")
    return near.unionByName(long.select(*columns))


def located_by_likeness(found: DataFrame, lines: DataFrame) -> DataFrame:
    """``located`` headers; those without a start begin at the line most alike their name."""
    bare = found.where("start is null").select("file_id", "position", F.col("section_name").alias("name"))
    alike = likeness.closest(bare, lines).select("file_id", "position", F.col("ord").alias("_alike"))
    return found.join(alike, ["file_id", "position"], "left").withColumn("start", F.coalesce("start", "_alike")).drop("_alike")


def sized(found: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """``located`` headers with the documents' sizes (file_id, n), where others are given."""
    return found if sizes is None else found.drop("n").join(sizes, "file_id")


def bounded(found: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``located`` headers with ``stop``: the least start of later headers that is beyond the own start, else the document's size."""
    found = sized(found, sizes)
    return sweeps.next_start_of_later(found, "_next").withColumn("stop", F.coalesce("_next", "n")).drop("_next", "n")


def section_texts(bounds: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, position, section_text: the lines from start up to stop, which may overlap those of other sections.

    All starts and stops cut a document into stretches; each line belongs to the last cut before it, and a section is a row of stretches.
    """
    ends = F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("ord")) for k, c in enumerate(("start", "stop"))))
    cuts = bounds.where("start is not null").select("file_id", "position", F.inline(ends)).select("file_id", "ord", F.lit(0).alias("kind"), "position", "side", F.lit(None).cast("string").alias("line"))
    both = cuts.unionByName(lines.select("file_id", "ord", F.lit(1).alias("kind"), "line"), allowMissingColumns=True)
    order = W.partitionBy("file_id").orderBy("ord", "kind")
    repeated = (F.lag("ord").over(order) == F.col("ord")) & (F.lag("kind").over(order) == 0)
    new = both.withColumn("new", ((F.col("kind") == 0) & ~F.coalesce(repeated, F.lit(False))).cast("int"))
    marked = new.withColumn("stretch", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first, last = (F.max(F.when(F.col("side") == k, F.col("stretch"))) for k in (0, 1))
    each = marked.where("kind = 0").groupBy("file_id", "position").agg(first.alias("first"), last.alias("last")).where("first < last")
    rows = each.select("file_id", "position", F.explode(F.sequence("first", F.col("last") - 1)).alias("stretch"))
    texts = marked.where("kind = 1 and stretch > 0").groupBy("file_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("rows"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "rows"))), lambda x: x["rows"]))
    return rows.join(texts, ["file_id", "stretch"]).groupBy("file_id", "position").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("section_text"))


def leveled(headers: DataFrame) -> DataFrame:
    """Adds ``level``, 1 to ``LEVELS``, by the section number's segments."""
    return headers.withColumn("level", F.least(F.greatest(T.segment_count(F.col("section_number")), F.lit(1)), F.lit(LEVELS)))


def section_tree(headers: DataFrame, ancestors: bool = False) -> DataFrame:
    """Adds parent (position of the nearest header before it of a lower level), path, and last, the position that ends it; on demand ``ancestors``,
    the positions above it.

    Three facts of a stack, told by windows over one ordering of the document: the parent is the latest of the lower levels' last headers; a
    level's last header is on the stack if it comes after those of all levels above; a section ends in front
    of the next header that isn't deeper.
    """
    before = W.partitionBy("file_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("file_id").orderBy(F.desc("position")).rowsBetween(W.unboundedPreceding, -1)  # a running value from the end
    everything = W.partitionBy("file_id")
    name = F.trim(F.concat_ws(" ", "section_number", "section_name"))

    def at(level: int, value: Column) -> Column:
        return F.when(F.col("level") == level, value)

    last = {k: F.max(at(k, F.struct("position", name.alias("name")))).over(before) for k in range(1, LEVELS)}
    nxt = {k: F.min(at(k, F.col("position"))).over(after) for k in range(1, LEVELS + 1)}
    wide = headers.withColumns({f"_l{k}": c for k, c in last.items()} | {f"_n{k}": c for k, c in nxt.items()} | {"_end": F.max("position").over(everything)})

    def position(k: int) -> Column:
        return F.coalesce(F.col(f"_l{k}.position"), F.lit(0))

    parent = F.greatest(*(F.when(F.col("level") > k, position(k)).otherwise(0) for k in range(1, LEVELS)), F.lit(0))
    on_stack, above_it = [], []
    for k in range(1, LEVELS):
        above = F.greatest(F.lit(0), F.lit(0), *(position(m) for m in range(1, k)))
        stacked = (F.col("level") > k) & (position(k) > above)
        on_stack.append(F.when(stacked, F.col(f"_l{k}.name")))
        above_it.append(F.when(stacked, position(k)))
    follower = F.least(*(F.when(F.col("level") >= k, F.col(f"_n{k}")) for k in range(1, LEVELS + 1)), F.col("_end") + 1)
    return wide.select(
        *headers.columns,
        F.nullif(parent, F.lit(0)).alias("parent"),
        F.array_join(F.array_compact(F.array(*on_stack, name)), " / ").alias("path"),
        (follower - 1).alias("last"),
        *([F.array_compact(F.array(*above_it)).alias("ancestors")] if ancestors else []),
    )


def section_chunks(tree: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, position, n_objects, objects: the lines of each section and all sections below it, headings left out, in order.

    A line belongs to the last header before it, which tells it by a running value; lines of a leaf, the next header being no
    deeper, are gathered once and then go to the sections above it.
    """
    if "ancestors" not in tree.columns:
        tree = section_tree(tree.drop("parent", "path", "last"), ancestors=True)
    heads = tree.select("file_id", "ord", F.lit(0).alias("kind"), F.struct("position", (F.col("last") == F.col("position")).alias("leaf"), "ancestors").alias("head"))
    both = heads.unionByName(lines.select("file_id", "ord", F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["head"].dataType).alias("head")))
    document = W.partitionBy("file_id")
    order = document.orderBy("ord", "kind").rowsBetween(W.unboundedPreceding, 0)
    # A heading is itself a line: it is told by the header row in front of it.
    marked = both.withColumns({"own": F.last("head", ignorenulls=True).over(order), "heading": F.max(F.when(F.col("kind") == 0, F.col("ord"))).over(order)})
    leaves = marked.where("kind = 1 and own.leaf and ord > heading").groupBy("file_id", "own.position").agg(F.collect_set("ord").alias("ords"), F.first("own.ancestors").alias("ancestors"))
    each = leaves.select("file_id", F.explode(F.array_append("ancestors", F.col("position"))).alias("position"), "ords")
    objects = F.array_sort(F.flatten(F.collect_list("ords")))
    made = each.groupBy("file_id", "position").agg(objects.alias("ords"))
    return made.select("file_id", "position", F.size("ords").cast("long").alias("n_objects"), F.array_join(F.transform("ords", lambda x: x.cast("string")), ",").alias("objects"))


def section_nodes(nodes: DataFrame) -> DataFrame:
    """section_id, depth and parent_section of header nodes (file_id, position, parent, level, number, title): a tree below each document's root.

    Positions go down the tree, first children first. A node is one below its parent at least, and as deep as its level.
    """
    placed = nodes.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy("position")))
    named = sweeps.depths_below(placed, "depth").withColumn("section_id", F.format_string("%s-sec-%04d", "file_id", "place"))
    above = named.select("file_id", F.col("position").alias("parent"), F.col("section_id").alias("parent_section"))
    root = F.concat("file_id", F.lit("-root"))
    return named.join(above, ["file_id", "parent"], "left").select(
        "file_id", "section_id", F.coalesce("parent_section", root).alias("parent_section"), "position", "depth", "number", "title"
    )
